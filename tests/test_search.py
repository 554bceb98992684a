"""Search through posting lists against a plain look at every row."""

import random

import pytest
from pyspark.sql import functions as F

from larder.operators import search


@pytest.fixture(scope="module")
def catalogue(spark, tmp_path_factory):
    rng = random.Random(2)
    words = ["Ring", "string", "RINGER", "été", "Straße", "ab", "a", "x-y", "aaaa", "\U0001f600 box"]
    rows = [(f"S{i:05d}", " ".join(rng.choice(words) for _ in range(rng.randrange(4)))) for i in range(3000)]
    rows += [("S90000", None), ("S90001", ""), ("S90002", "needle in hay"), ("ring-1", "z")]
    df = spark.createDataFrame(rows, "sku string, name string")
    path = str(tmp_path_factory.mktemp("search") / "index")
    return rows, search.write_search_index(df, path, "sku", ["sku", "name"])


@pytest.mark.parametrize("term", ["ring", "RING", "in", "x-", "a", "", "aaaaa", "g r", "needle", "S0012", "été", "aß", "\U0001f600 b", "nowhere", "e in h"])
def test_same_rows_as_a_full_scan(spark, catalogue, term):
    rows, path = catalogue
    got = {tuple(r) for r in search.search(spark, path, "sku", ["sku", "name"], term).collect()}
    assert got == {r for r in rows if any(term.lower() in (v or "").lower() for v in r)}


def test_only_candidates_are_read(spark, catalogue):
    _, path = catalogue
    found = search.search(spark, path, "sku", ["sku", "name"], "needle")
    assert found.count() == 1
    assert "IN (S90002)" in found._jdf.queryExecution().toString() or "(sku = S90002)" in found._jdf.queryExecution().toString()


def test_many_candidates_are_joined(spark, catalogue, monkeypatch):
    rows, path = catalogue
    monkeypatch.setattr(search, "MOST_KEYS", 5)
    found = search.search(spark, path, "sku", ["sku", "name"], "ring")
    assert found.columns == ["sku", "name"]
    assert found.count() == sum("ring" in f"{a}\n{b or ''}".lower() for a, b in rows)


def test_groups(spark):
    got = spark.createDataFrame([("abab",), ("",), ("a",), ("ab",)], "t string").select(search.letter_groups(F.col("t")).alias("g")).collect()
    assert [sorted(r.g) for r in got] == [["ab", "aba", "ba", "bab"], [], [], ["ab"]]
    assert search.groups_of_term("ABAB") == ["aba", "bab"] and search.groups_of_term("a") == []


def test_the_lists_come_from_the_written_rows(spark, tmp_path):
    worked_out = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            worked_out.add(batch.num_rows)
            yield batch

    df = spark.range(100).selectExpr("cast(id as string) AS sku", "concat('ring ', id) AS name").mapInArrow(counted, "sku string, name string")
    path = search.write_search_index(df, str(tmp_path / "index"), "sku", ["sku", "name"])
    assert worked_out.value <= 200  # once for the ranges of the rows, once for the rows
    assert search.search(spark, path, "sku", ["sku", "name"], "ring 7").count() == 11
