import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.llm import top_k as module
from larder.llm.top_k import Lists, quantised, top_k, whole


def brute(ids, vectors, query_id, query, k):
    scored = sorted((-int(v @ query), int(i)) for i, v in zip(ids, vectors, strict=True) if i != query_id)
    return [(i, -s) for s, i in scored[:k]]


@pytest.mark.parametrize("spread", [1, 3, 2000])
def test_lists_against_all(spread):
    """Small values make ties, large ones need wide numbers."""
    rng = np.random.default_rng(spread)
    ids = rng.permutation(700)
    vectors = rng.integers(-spread, spread + 1, (700, 12))
    vectors[5:9] = vectors[4]
    vectors[100] = 0
    lists = Lists(ids, vectors)
    for q in [0, 5, 100, 699]:
        got = lists.best(ids[q], vectors[q], 20)
        assert list(zip(map(int, got[0]), map(int, got[1]), strict=True)) == brute(ids, vectors, ids[q], vectors[q], 20)


def test_search_stops_before_the_end(monkeypatch):
    """With one strong dimension the bound falls below the k-th score after a few steps."""
    rng = np.random.default_rng(2)
    vectors = np.zeros((4000, 4), np.int64)
    vectors[:, 0] = rng.permutation(4000)
    query = np.array([5, 0, 0, 0])
    lists = Lists(np.arange(4000), vectors)
    read = []
    real = np.flatnonzero
    monkeypatch.setattr(module.np, "flatnonzero", lambda x: read.append(len(x)) or real(x))
    ids, scores = lists.best(-1, query, 20)
    assert list(scores) == [5 * v for v in range(3999, 3979, -1)]
    assert len(read) < 4


def test_tables(spark, monkeypatch):
    monkeypatch.setattr(module, "CANDIDATES_PER_BLOCK", 90)
    monkeypatch.setattr(module, "LEAST_CANDIDATES", 50)
    monkeypatch.setattr(module, "QUERIES_PER_BLOCK", 7)
    rng = np.random.default_rng(4)
    data = [(int(i), [float(x) for x in rng.normal(size=6)], 1, "clash") for i in range(400)]
    data += [(1000, None, 1, "x"), (1020, [1.0, None], 1, "x"), (1040, [float("nan"), 1.0], 1, "x"), (None, [1.0] * 6, 1, "x")]
    data += [(1060, [float("inf")] * 6, 1, "x"), (1080, [], 1, "x"), (1100, [0.5, -0.5], 1, "x"), (7, data[7][1], 1, "x"), (20, data[20][1], 1, "x")]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int, score string")
    rows = frame.where(whole(F.col("embedding"))).select("vec_id", quantised(F.col("embedding")).alias("vector"), "score")
    plain = [
        (i, np.array([int(np.floor(np.float64(np.float32(x)) * 64)) for x in v] + [0] * (6 - len(v))))
        for i, v, _, _ in data
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    out = top_k(rows.where("vec_id % 20 = 0"), rows, k=15).collect()
    for q, query in dict((i, v) for i, v in plain if i % 20 == 0).items():
        got = [(r.vec_id, r.score) for r in sorted((r for r in out if r.query_id == q), key=lambda r: r.rank)]
        assert got == brute([i for i, _ in plain], np.array([v for _, v in plain]), q, query, 15)
    assert top_k(rows.where("false"), rows).collect() == top_k(rows, rows.where("false")).collect() == []
    assert {r.vec_id for r in top_k(rows.where("vec_id = 7"), rows.where("vec_id < 3")).collect()} == {0, 1, 2}
