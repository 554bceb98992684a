import random

import corpus_pipeline
from corpus_pipeline import COLUMNS, STAGES
from edges import LONG

HEX = "0123456789abcdef" * 2


def build(spark, folder):
    rng = random.Random(1)
    draw = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    texts = {i: draw(60) for i in range(200)}
    toxic = {i: f"{draw(5)} clown moron {draw(4)}" for i in range(300, 420)}
    item = draw(40)
    near = draw(200).split()
    special = {
        500: " ".join(near),
        501: " ".join(near[:-3] + ["x", "y", "z"]),
        502: f"{draw(20)} {' '.join(item.split()[5:20]).upper()} {draw(20)}",
        503: f"{draw(10)} token = '{HEX}' {draw(10)}",
        504: None,
        505: "",
        506: LONG,
    }
    rows = [(i, t, "en", "s", len(t) if t is not None else None, "x") for i, t in (texts | toxic | special).items()]
    rows += [(None, "nameless but clean text", None, None, 23, "x"), (None, f"nameless {item}", "en", "s", 5, "x")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, spans string").repartition(4).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, int(i >= 300)) for i in (*texts, *toxic)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return texts, toxic, special


def test_stages(spark, tmp_path):
    texts, toxic, special = build(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert tuple(docs.columns) == COLUMNS
        path = f"{tmp_path}/{len(kept)}.parquet"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        kept[name] = docs.collect()
    ids = {name: sorted(r.doc_id if r.doc_id is not None else -1 for r in rows) for name, rows in kept.items()}
    clean = sorted([-1, -1, *texts, *special])
    assert ids["toxicity"] == clean
    assert ids["near duplicates"] == [i for i in clean if i != 501]
    leaked = [i for i in ids["near duplicates"] if i != 502]
    leaked.remove(-1)
    assert ids["benchmark decontamination"] == ids["secret scan"] == leaked
    final = {r.doc_id: r for r in kept["secret scan"]}
    assert HEX not in final[503].text and "[SECRET]" in final[503].text and final[503].n_chars == len(final[503].text)
    assert all(final[i].text == t for i, t in texts.items())
    assert final[504].text is None and final[504].n_chars is None
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in out) == leaked
    assert all(r.lossless and r.n_tokens == len(r.ids) for r in out)


def test_near_duplicates_with_repeated_and_missing_ids(spark):
    rng = random.Random(2)
    a, b, c, d, e = (" ".join(f"w{rng.randrange(3000)}" for _ in range(60)) for _ in range(5))
    rows = [(1, a, "en")] * 3 + [(9, a, "en"), (None, a, "en")]  # copies of one id, of another and of none
    rows += [(None, b, "en"), (None, b, "fr")]  # equal but for the language
    rows += [(2, c, "en"), (5, c, "en"), (5, d, "en")]  # one id on two texts
    rows += [(7, e, "en"), (6, e + " x", "en"), (8, "", "en"), (8, "", "en"), (None, None, "en")]
    docs = spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert tuple(kept.columns) == COLUMNS
    want = [(1, a, "en"), (None, b, "en"), (2, c, "en"), (5, d, "en"), (6, e + " x", "en"), (8, "", "en"), (8, "", "en"), (None, None, "en")]
    assert sorted(map(str, (tuple(r)[:3] for r in kept.collect()))) == sorted(map(str, want))


def test_empty_tables(spark, tmp_path):
    for name, ddl in (
        ("documents", "doc_id long, text string, lang string, source string, n_chars long"),
        ("labels", "doc_id long, quality int, toxic int"),
        ("benchmark", "item_id long, text string"),
    ):
        spark.createDataFrame([], ddl).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
