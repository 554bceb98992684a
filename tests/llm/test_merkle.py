import random
from hashlib import sha256

import pytest
from edges import documents, nothing
from pyspark.sql import functions as F

from larder.llm.merkle import leaf, manifest

SCHEMA = "k long, g string, d string, p string, position string, path string"
H = lambda *x: sha256("".join(x).encode()).hexdigest()


def tree(nodes):
    """Root and the path of every leaf, straight from the rule."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for i, path in enumerate(paths):
            pair = level[at[i] // 2 * 2 : at[i] // 2 * 2 + 2]
            path.append((at[i] % 2, [x for j, x in enumerate(pair) if j != at[i] % 2]))
            at[i] //= 2
        level = [H(*level[i : i + 2]) for i in range(0, len(level), 2)]
    return level[0], paths


def brute(rows):
    groups = {}
    for k, g, d, p, *_ in rows:
        groups.setdefault(g, []).append((k is not None, k or 0, d, p, k))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([r[2] for r in sorted(groups[g])]) for g in names}
    root, tops = tree([trees[g][0] for g in names])
    out = []
    for g, top in zip(names, tops, strict=True):
        subroot, paths = trees[g]
        for (_, _, d, p, k), path in zip(sorted(groups[g]), paths, strict=True):
            folded = p
            for side, other in path + top:
                folded = H(*other, folded) if side else H(folded, *other)
            out.append((k, d, subroot, root, "".join(x for _, o in path + top for x in o), folded, folded == root))
    return sorted(out, key=str)


def result(df, levels=12):
    got = manifest(df, key="k", group="g", digest="d", presented="p", block_levels=levels)
    return sorted(map(tuple, got.select("key", "leaf", "subroot", "root", "proof", "folded_root", "verified").collect()), key=str)


# Superblocks of two, four and 4,096 leaves; groups of every size around powers of two; null and repeated keys.
@pytest.mark.parametrize("levels", [1, 2, 12])
def test_against_brute_force(spark, levels):
    rng = random.Random(levels)
    rows, sizes = [], {None: 3, "": 1, "a": 1, "b": 2, "é": 9, "Z": 8, "z": 16, "hot": 77}
    for g, size in sizes.items():
        for i in range(size):
            d = H(str(rng.random()))
            rows.append((rng.choice([i, 5, None]), g, d, H("x") if rng.random() < 0.2 else d, "x", "x"))
    rows.append(rows[-1])
    assert result(spark.createDataFrame(rows, SCHEMA), levels) == brute(rows)


def test_one_leaf_and_no_leaf(spark):
    one = [(1, None, "ab", "ab", "x", "x")]
    assert result(spark.createDataFrame(one, SCHEMA)) == [(1, "ab", "ab", "ab", "", "ab", True)]
    assert result(spark.createDataFrame([], SCHEMA)) == []


def test_leaves_of_any_document(spark):
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    text = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    for df in (documents(spark), nothing(spark)):
        got = df.select(*fields, leaf(*map(F.col, fields)).alias("leaf")).collect()
        assert [r.leaf for r in got] == [H(*(text(r[f]) for f in fields)) for r in got]
        rows = df.select("doc_id", "lang", leaf(*map(F.col, fields)).alias("leaf"))
        found = manifest(rows, key="doc_id", group="lang", digest="leaf", presented="leaf").collect()
        assert len(found) == len(got) and all(r.verified for r in found)
