"""Language identification and toxicity: held-out accuracy on the given tables, and edge cases."""

import numpy as np
import pytest
from edges import documents, nothing

from larder.llm import language_id, toxicity
from larder.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def truth(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang").collect()
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").collect()
    return dict(map(tuple, docs)), {r.doc_id: r.toxic for r in labels}


def test_languages_of_held_out_documents(spark, truth):
    rows = [r for r in QUERIES["op4_language_id"](spark, FOLDER).collect() if r.held_out]
    assert len(rows) > 150 and np.mean([r.lang_pred == truth[0][r.doc_id] for r in rows]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edges(spark):
    frame = documents(spark, ["das ist ein Text über die Boote", "the boats are here", "...", "123 !"])
    model = language_id.train(spark.read.parquet(f"{FOLDER}/documents.parquet"))
    out = {r.doc_id: r for r in language_id.predict(frame, model).collect()}
    assert [out[i].lang_pred for i in (1, 2, 3, 102, 103)] == ["und"] * 5 and out[1].score == 0
    assert (out[100].lang_pred, out[101].lang_pred, out[4].lang_pred) == ("de", "en", "en")
    assert language_id.train(nothing(spark)) is None
    assert {r.lang_pred for r in language_id.predict(frame, None).collect()} == {"und"}
    assert language_id.predict(nothing(spark), model).collect() == []


def test_bounded_sample_learns_every_language(spark, truth):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = language_id.train(docs, per_language=20)
    assert model.languages == ["de", "en", "es", "fr"]
    rows = language_id.predict(docs.select("doc_id", "text"), model).collect()
    assert np.mean([r.lang_pred == truth[0][r.doc_id] for r in rows]) > 0.95


def test_language_scores_of_plain_naive_bayes(spark):
    """Counts, smoothing, priors and posteriors again, with dictionaries."""
    import math
    from collections import Counter

    texts = [("en", "the boats are here"), ("en", "and there"), ("fr", "les bateaux"), ("en", "the strait"), ("fr", "ici"), ("de", "das Boot")]
    df = spark.createDataFrame([(i, t, g) for i, (g, t) in enumerate(texts)], "doc_id long, text string, lang string")
    model = language_id.train(df, per_language=1_000_000)

    def buckets(text):
        data, offsets = np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())])
        points, bounds = language_id.characters(data, offsets)
        return [int(b) for found, _ in language_id.ngrams(points, bounds) for b in found]

    counts = {g: Counter(b for own, t in texts if own == g for b in buckets(t)) for g in ("de", "en", "fr")}
    got = {r.text: r for r in language_id.predict(df, model).collect()}
    for _, text in texts:
        logs = {}
        for g, own in counts.items():
            whole = sum(own.values()) + 0.5 * language_id.BUCKETS
            prior = sum(x == g for x, _ in texts) / len(texts)
            logs[g] = math.log(prior) + sum(math.log((own[b] + 0.5) / whole) for b in buckets(text))
        best = max(logs, key=logs.get)
        assert got[text].lang_pred == best
        assert got[text].score == pytest.approx(1 / sum(math.exp(v - logs[best]) for v in logs.values()), rel=1e-3)


def test_toxicity_of_held_out_documents(spark, truth):
    rows = [r for r in QUERIES["op7_toxicity"](spark, FOLDER).collect() if r.held_out and r.doc_id in truth[1]]
    y = np.array([truth[1][r.doc_id] for r in rows])
    p = np.array([r.predicted for r in rows])
    assert y[p == 1].mean() > 0.8 and p[y == 1].mean() > 0.5
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)


def test_toxicity_edges(spark):
    bad, good = ["you are a clown and a moron"] * 30, ["the boats came back from the strait"] * 60
    frame = documents(spark, bad + good)
    labels = spark.createDataFrame(
        [(100 + i, int(i < 30), 1) for i in range(90)] + [(None, 1, 1), (5, None, 1), (100, 0, 0)],
        "doc_id long, toxic int, quality int",
    )
    weights = toxicity.train(frame, labels, l1=1.0)
    assert 0 < len(weights) < 100
    out = toxicity.score(frame, weights).collect()
    assert len(out) == frame.count()
    assert {r.predicted for r in out if r.doc_id and 100 <= r.doc_id < 130} == {1}
    assert {r.predicted for r in out if r.doc_id and r.doc_id >= 130} == {0}
    empty = {r.score for r in out if r.doc_id in (1, 2, 3)}
    assert len(empty) == 1
    assert toxicity.train(frame, labels.where("false")) is None
    assert {r.score for r in toxicity.score(frame, None).collect()} == {0.0}
    assert toxicity.score(nothing(spark), weights).collect() == []


def test_weights_are_zero_below_the_threshold():
    lists = [np.array([k % 7, 50, toxicity.BIAS]) for k in range(400)]
    labels = np.array([float(k % 7 == 3) for k in range(400)])
    w = toxicity.ftrl(lists, labels, alpha=0.5, beta=1.0, l1=3.0, l2=0.0, epochs=4)
    assert w[3] > 1 and np.count_nonzero(w) <= 9
    strict = toxicity.ftrl(lists, labels, alpha=0.5, beta=1.0, l1=1e6, l2=0.0, epochs=2)
    assert np.count_nonzero(strict) == 1


def test_rare_toxic_rows_are_learnt_from_a_bounded_sample(spark):
    import random

    rng = random.Random(3)
    draw = lambda: " ".join(f"w{rng.randrange(400)}" for _ in range(12))
    rows = [(i, draw() + (" clown" if i < 30 else ""), int(i < 30)) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    weights = toxicity.train(docs, docs, max_rows=200)
    out = toxicity.score(docs, weights).select("toxic", "score").collect()
    assert min(r.score for r in out if r.toxic) > max(r.score for r in out if not r.toxic)


def test_ftrl_coordinate_by_coordinate():
    """The same updates with dictionaries and one number at a time."""
    import math
    import random

    rng = random.Random(3)
    lists = [np.array(sorted(rng.sample(range(60), rng.randrange(1, 12))) + [toxicity.BIAS], np.int32) for _ in range(80)]
    labels = np.array([float(any(f < 6 for f in own[:-1])) for own in lists])
    counts = np.array([rng.choice([1.0, 2.5]) for _ in lists])
    settings = dict(alpha=0.7, beta=1.0, l1=0.6, l2=0.1, epochs=3)
    z, n = {}, {}

    def weight(f):
        limit = 0.0 if f == toxicity.BIAS else settings["l1"]
        if abs(z.get(f, 0.0)) <= limit:
            return 0.0
        sign = 1 if z[f] > 0 else -1
        return -(z[f] - sign * limit) / ((settings["beta"] + math.sqrt(n[f])) / settings["alpha"] + settings["l2"])

    for _ in range(settings["epochs"]):
        for own, y, c in zip(lists, labels, counts):
            now = {int(f): weight(int(f)) for f in own}
            g = c * (1 / (1 + math.exp(-sum(now.values()))) - y)
            for f, w in now.items():
                before = n.get(f, 0.0)
                z[f] = z.get(f, 0.0) + g - (math.sqrt(before + g * g) - math.sqrt(before)) / settings["alpha"] * w
                n[f] = before + g * g
    got = toxicity.ftrl(lists, labels, counts, **settings)
    want = {f: weight(f) for f in z}
    assert {int(f) for f in np.flatnonzero(got)} == {f for f, w in want.items() if w}
    assert all(got[f] == pytest.approx(w) for f, w in want.items())
    assert 0 < sum(w != 0 for w in want.values()) < len(want)
