import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from edges import documents, nothing

from larder.llm.exact_duplicates import coded, decoded, exact_duplicates
from larder.session import scratch_path


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    out = []
    for doc_id, text in rows:
        ids = groups[text or ""]
        keep = max((x for x in ids if x is not None), default=None)
        digest = hashlib.sha256((text or "").encode()).hexdigest()
        out.append((doc_id, keep, len(ids), keep is None or doc_id == keep, digest))
    return sorted(out, key=str)


def result(df, **options):
    return sorted(map(tuple, exact_duplicates(df, **options).collect()), key=str)


@pytest.mark.parametrize("first, count, reach", [(0, 1, 1), (0, 300, 300), (1 << 63, 5000, 1 << 63), (7 << 40, 900, 1 << 40)])
def test_code_round_trip(first, count, reach):
    rng = random.Random(count)
    prints = np.array(sorted({first + rng.randrange(reach) for _ in range(count)}), np.uint64)
    shift, unary, low = coded(prints, first)
    assert (decoded(len(prints), shift, unary, low, first) == prints).all()
    # Within a bit and a half of the entropy of a gap.
    ideal = len(prints) * (np.log2(reach / len(prints)) + 1.5)
    assert 8 * (len(unary) + len(low)) <= 1.1 * ideal + 64


# Fingerprints of four bits collide all the time; several owners; one owner.
@pytest.mark.parametrize("options", [{}, {"bits": 4}, {"owner_rows": 20}, {"bits": 9, "owner_rows": 20}])
def test_against_brute_force(spark, options):
    rng = random.Random(5)
    texts = [None, "", " ", "a", "A", "a ", "é", "é", "copy " * 3000] + [f"text {i}" for i in range(150)]
    rows = [(i, rng.choice(texts)) for i in range(400)] + [(i, "hot") for i in range(1000, 1300)]
    rows += [(None, "hot"), (None, "only nameless"), (None, "only nameless"), (3, "twice"), (3, "twice"), (None, None)]
    path = scratch_path(spark, "documents")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(7).write.parquet(path)
    assert result(spark.read.parquet(path), **options) == brute(rows)


def test_edges(spark):
    df = documents(spark, ["one", "one", "two"])
    assert result(df) == brute([(r.doc_id, r.text) for r in df.collect()])
    assert exact_duplicates(df).columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert exact_duplicates(nothing(spark)).collect() == []
