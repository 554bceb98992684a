"""Merkle manifest of a dataset by cogrouped subtree exchange.

Rows are leaves of one tree for each group, in key order; the groups' roots are the leaves of the last tree.  A tree is
cut into superblocks of 2^BLOCK_LEVELS neighbouring nodes.  Going up, each superblock is reduced to one node, round by
round, until one node is left.  Going down, a superblock is cogrouped with the outer nodes that its proofs need beyond
it; at the bottom leaves and outer nodes meet in one ``applyInPandas``, which reduces the superblock once more, joins the
two parts of each proof and folds it.  A task holds one superblock, whatever the size of its tree.

A node is the SHA-256 (lower-case hex) of its two children's digests as text; a child without a partner is hashed alone.
"""

from __future__ import annotations

from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.shared import stored
from larder.operators.ordering import number_rows

BLOCK_LEVELS = 12


def hashed(*values: str) -> str:
    return sha256("".join(values).encode()).hexdigest()


def written(value: Column) -> Column:
    """How a field enters a leaf: its UTF-8 byte count, a colon and the value, or a dash for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*fields: Column) -> Column:
    return F.sha2(F.concat(*[written(f) for f in fields]), 256)


def levels(nodes: list[str], n: int, block_levels: int) -> list[list[str]]:
    """The levels of a superblock from its nodes up to a single one; ``n`` nodes of its tree are on the lowest level.

    A superblock of a larger tree always climbs ``block_levels``, also where it holds a single node.
    """
    out = [nodes]
    for _ in range(min(block_levels, (n - 1).bit_length())):
        low = out[-1]
        out.append([hashed(*low[i : i + 2]) for i in range(0, len(low), 2)])
    return out


def steps(tree: list[list[str]], i: int) -> list[str]:
    """What node i of the lowest level is hashed with on its way up: L or R and the digest, or a dash for none."""
    out = []
    for level in tree[:-1]:
        other = i ^ 1
        out.append("-" if other >= len(level) else ("L" if i & 1 else "R") + level[other])
        i >>= 1
    return out


def fold(digest: str, path: list[str]) -> str:
    for step in path:
        other = step[1:]
        digest = hashed(other, digest) if step[0] == "L" else hashed(digest, other)
    return digest


def proof(path: list[str]) -> str:
    """The sibling digests of a path, one after another."""
    return "".join(step[1:] for step in path)


_NODES = "tree long, at long, digest string, n long"


def _reduced(nodes: DataFrame, block_levels: int) -> DataFrame:
    def run(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        n = int(block["n"].iloc[0])
        tree = levels(block.sort_values("at")["digest"].tolist(), n, block_levels)
        climbed = len(tree) - 1
        return pd.DataFrame({"tree": [key[0]], "at": [key[1]], "digest": tree[-1], "n": [(n + (1 << climbed) - 1) >> climbed]})

    return nodes.groupBy("tree", _block(block_levels)).applyInPandas(run, _NODES)


def _block(block_levels: int) -> Column:
    return F.shiftright("at", block_levels).alias("block")


def _rounds(nodes: DataFrame, block_levels: int) -> list[DataFrame]:
    """The nodes and every further round of superblock roots, down to one node for each tree."""
    out = [nodes]
    while (out[-1].agg(F.max("n")).first()[0] or 0) > 1:
        out.append(stored(_reduced(out[-1], block_levels)))
    return out


def _descended(nodes: DataFrame, outer: DataFrame, block_levels: int) -> DataFrame:
    """Outer paths of ``nodes`` from those of their superblocks: (tree, at, subroot, path)."""

    def run(key: tuple, block: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("at")
        tree = levels(block["digest"].tolist(), int(block["n"].iloc[0]), block_levels)
        beyond = list(above["path"].iloc[0])
        return pd.DataFrame(
            {
                "tree": block["tree"],
                "at": block["at"],
                "subroot": [above["subroot"].iloc[0]] * len(block),
                "path": [steps(tree, i) + beyond for i in range(len(block))],
            }
        )

    return (
        nodes.groupBy("tree", _block(block_levels))
        .cogroup(outer.withColumn("block", F.col("at")).groupBy("tree", "block"))
        .applyInPandas(run, "tree long, at long, subroot string, path array<string>")
    )


def _finished(root: str, block_levels: int):
    def run(key: tuple, block: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("at")
        tree = levels(block["digest"].tolist(), int(block["n"].iloc[0]), block_levels)
        beyond, subroot = list(above["path"].iloc[0]), above["subroot"].iloc[0]
        paths = [steps(tree, i) + beyond for i in range(len(block))]
        folded = [fold(d, p) for d, p in zip(block["presented"], paths, strict=True)]
        return pd.DataFrame(
            {
                "key": block["key"],
                "position": block["at"],
                "leaves": block["n"],
                "leaf": block["digest"],
                "subroot": subroot,
                "root": root,
                "proof": [proof(p) for p in paths],
                "folded_root": folded,
                "verified": [f == root for f in folded],
            }
        )

    return run


def manifest(
    rows: DataFrame, *, key: str, group: str, digest: str, presented: str, block_levels: int = BLOCK_LEVELS
) -> DataFrame:
    """One row per input row: key, group, position and leaves (of the group's tree), leaf, subroot, root, proof,
    folded_root, verified.

    ``digest`` is the column of leaf digests, ``presented`` that of the digests to be checked against the manifest: each
    is folded with the original siblings, and verified says whether that gives the root.  ``proof`` is the siblings'
    digests from the leaf up to the root; position and leaves say on which side they stand.  Leaves ascend by key, null
    first, equal keys by digest; groups ascend by their UTF-8 bytes, null first, and a null group is a group.  A group of
    one row has its leaf as subroot, a table of one group its subroot as root.  Repeated rows are leaves of their own.
    An empty table gives an empty result; other columns are not read.
    """
    kind = rows.schema[key].dataType.simpleString()
    leaves = rows.select(F.col(group).alias("group"), F.col(key).alias("key"), F.col(digest).alias("digest"), F.col(presented).alias("presented"))
    # Stored first: a sort by ranges reads its input twice, and leaves are hashes of whole texts.
    numbered = number_rows(stored(leaves), [F.col("group").asc_nulls_first(), F.col("key").asc_nulls_first(), "digest"], "global")
    groups = numbered.groupBy("group").agg(F.min("global").alias("first"), F.count(F.lit(1)).alias("n"))
    groups = stored(number_rows(groups, ["first"], "tree"))
    # Null and text apart, so that both are plain join keys.
    named = groups.select(F.col("group").isNull().alias("none"), F.coalesce("group", F.lit("")).alias("name"), "tree", "first", "n")
    nodes = stored(
        numbered.withColumn("none", F.col("group").isNull())
        .withColumn("name", F.coalesce("group", F.lit("")))
        .join(named, ["none", "name"])
        # pandas would turn whole numbers with nulls among them into floats.
        .select("tree", (F.col("global") - F.col("first")).alias("at"), "digest", "n", "presented", F.col("key").cast("string").alias("key"))
    )

    first = stored(_reduced(nodes.select("tree", "at", "digest", "n"), block_levels))
    rounds = _rounds(first, block_levels)
    subroots = rounds[-1].select("tree", F.col("digest").alias("subroot"))
    total = groups.count()
    last = subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("at"), F.col("subroot").alias("digest"), F.lit(total).alias("n"))
    tops = _rounds(stored(last), block_levels)
    top = tops[-1].first()
    root = top["digest"] if top else ""
    outer = tops[-1].select("tree", "at", F.col("digest").alias("subroot"), F.expr("cast(array() as array<string>)").alias("path"))
    for below in reversed(tops[:-1]):
        outer = _descended(below, outer, block_levels)

    outer = outer.select(F.col("at").alias("tree"), "path").join(subroots, "tree")
    outer = stored(outer.select("tree", F.lit(0).cast("long").alias("at"), "subroot", "path"))
    for below in reversed(rounds[:-1]):
        outer = stored(_descended(below, outer, block_levels))
    schema = "key string, position long, leaves long, leaf string, subroot string, root string, proof string, folded_root string, verified boolean"
    found = (
        nodes.groupBy("tree", _block(block_levels))
        .cogroup(outer.withColumn("block", F.col("at")).groupBy("tree", "block"))
        .applyInPandas(_finished(root, block_levels), schema)
    )
    return found.withColumn("key", F.col("key").cast(kind))
