"""Trie of conversation prefixes, rolled up by centroid decomposition.

Every distinct sequence of first turns is a node, its parent the sequence without the last turn.  Sequences are told apart
by 128 bits of a running sum of hashes of (turn, depth), which blocks of a conversation can add up apart from each other.

The sums over subtrees come from a centroid decomposition of the parent edges.  A node weighs as much as it has members,
so the weight of a subtree is known from counting: each member adds the turns it has from there on.  In a component the
nodes with more than half its weight below them form a path from the top; the last of them is the centroid.  Taking it
out leaves components of at most half the weight: the subtrees of its children, and what is around.  What lies below
the centroid is added up and given to the nodes on the path from the centroid to the top.  After log2(weight) rounds at most
every node has been a centroid and has its whole sum, however deep or broad the trie is.  Components above LOCAL_WEIGHT are
split by joins and aggregates; smaller ones go through the same steps within a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.llm import text_blocks as tb
from larder.llm.shared import stored
from larder.operators.ordering import number_rows

LOCAL_WEIGHT = 50_000
BLOCK_TURNS = 10  # log2 of the turns that one window adds up
ENDS_BLOCK = 12  # log2 of the conversation numbers that are written as one piece


def ordered_turns(
    messages: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """conv_id, position (from 0, by turn, null first), print (hash of role and text), size (code points of the text).

    Null roles and texts count as empty.  Rows of one turn stand in the order of their hashes.  Rows without a
    conversation are left out.
    """
    role_text, body = F.coalesce(F.col(role).cast("string"), F.lit("")), F.coalesce(F.col(text).cast("string"), F.lit(""))
    turns = messages.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        F.sha2(F.concat(F.octet_length(role_text), F.lit(":"), role_text, body), 256).alias("print"),
        F.length(body).cast("long").alias("size"),
    )
    # Numbered over the table, not by a window: one conversation may be a large part of all rows.
    numbered = number_rows(stored(turns), ["conv_id", F.col("turn").asc_nulls_first(), "print"], "place")
    firsts = numbered.groupBy("conv_id").agg(F.min("place").alias("first"))
    return numbered.join(firsts, "conv_id").select("conv_id", (F.col("place") - F.col("first")).alias("position"), "print", "size")


def _lanes(depth: Column) -> list[Column]:
    """Four numbers of 32 bits for a turn at its place; two billion of them add up without overflow."""
    whole = [F.xxhash64(F.lit(k), "print", depth) for k in (1, 2)]
    return [half for w in whole for half in (F.shiftrightunsigned(w, 32), w.bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))]


def _keys(lanes: list[Column]) -> list[Column]:
    """Two 64-bit numbers from four sums."""
    low = [x.bitwiseAND(F.lit(0xFFFFFFFF).cast("long")) for x in lanes]
    return [F.shiftleft(low[0], 32).bitwiseOR(low[1]), F.shiftleft(low[2], 32).bitwiseOR(low[3])]


def _prefixes(turns: DataFrame, members: DataFrame) -> DataFrame:
    """conv_id, depth, hi, lo, size, length: every prefix of every member, the empty one too."""
    names = [f"lane_{k}" for k in range(4)]
    rows = turns.select("conv_id", "depth", "size", *[x.alias(n) for x, n in zip(_lanes(F.col("depth")), names, strict=True)])
    rows = rows.withColumn("block", F.shiftright(F.col("depth") - 1, BLOCK_TURNS))
    within = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("n"), *[F.sum(n).alias(n) for n in names])
    lengths = blocks.groupBy("conv_id").agg(F.sum("n").alias("length"))
    earlier = blocks.select("conv_id", "block", *[F.sum(n).over(before).alias(f"earlier_{n}") for n in names]).where("block > 0")
    summed = rows.select("conv_id", "block", "depth", "size", *[F.sum(n).over(within).alias(n) for n in names])
    summed = summed.join(earlier, ["conv_id", "block"], "left")
    hi, lo = _keys([F.col(n) + F.coalesce(f"earlier_{n}", F.lit(0)) for n in names])
    zero = F.lit(0).cast("long")
    found = summed.select("conv_id", "depth", hi.alias("hi"), lo.alias("lo"), "size").unionByName(
        members.select("conv_id", zero.alias("depth"), zero.alias("hi"), zero.alias("lo"), zero.alias("size"))
    )
    return found.join(lengths, "conv_id", "left").withColumn("length", F.coalesce("length", zero))


def prefix_trie(turns: DataFrame, members: DataFrame, *, local_weight: int = LOCAL_WEIGHT) -> DataFrame:
    """One row per node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256, all of them long but the last.

    ``turns`` has conv_id, depth (1, 2, ... in each conversation), print and size; ``members`` has conv_id, each once,
    those without turns too.  A node's members are the conversations that begin with it; the root is the empty beginning.
    n_leaves counts the childless nodes of its subtree; saved_tokens adds up (n_convs - 1) * size of the last turn over
    its subtree; ends_sha256 is the hash of the members that end there, ascending, comma-joined.  Null members and turns
    of conversations that are no members are left out.  Without members there is no node; other columns are not read.
    """
    members = members.where("conv_id is not null").select("conv_id").distinct()
    turns = turns.select("conv_id", "depth", "print", "size").join(members, "conv_id", "left_semi")
    prefixes = stored(_prefixes(turns, members))
    nodes = prefixes.groupBy("depth", "hi", "lo").agg(
        F.min("conv_id").alias("name"),
        F.count(F.lit(1)).alias("n_convs"),
        F.sum(F.col("length") - F.col("depth") + 1).alias("weight"),
        F.min("size").alias("size"),
    )
    nodes = stored(nodes)
    # Which node, by the smallest member, every prefix is, and the one after it.
    named = prefixes.join(nodes.select("depth", "hi", "lo", "name"), ["depth", "hi", "lo"])
    named = stored(named.select("conv_id", "depth", "name", (F.col("depth") == F.col("length")).alias("ends")))
    following = named.select("conv_id", (F.col("depth") - 1).alias("depth"), F.col("name").alias("next"))
    paths = stored(named.join(following, ["conv_id", "depth"], "left").select("conv_id", "depth", "name", "next"))

    above = named.select(F.col("conv_id").alias("name"), (F.col("depth") + 1).alias("depth"), F.col("name").alias("parent"))
    nodes = nodes.select("name", "depth", "n_convs", "weight", "size").join(above, ["name", "depth"], "left")
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("name"), (F.col("depth") - 1).alias("depth"))
    nodes = stored(
        nodes.join(children.agg(F.count(F.lit(1)).alias("n_children")), ["name", "depth"], "left").na.fill(0, ["n_children"])
    )
    values = nodes.select(
        "name",
        "depth",
        "parent",
        "weight",
        F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("own_leaves"),
        ((F.col("n_convs") - 1) * F.col("size")).alias("own_saved"),
    )
    return (
        nodes.join(rolled_up(values, paths, ["leaves", "saved"], local_weight), ["name", "depth"])
        .join(_ends(named.where("ends")), ["name", "depth"], "left")
        .select(
            F.col("name").alias("conv_id"),
            "depth",
            F.col("parent").alias("parent_conv_id"),
            "n_convs",
            "n_children",
            F.col("leaves").alias("n_leaves"),
            F.col("saved").alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(sha256().hexdigest())).alias("ends_sha256"),
        )
    )


def rolled_up(nodes: DataFrame, paths: DataFrame, values: list[str], local_weight: int) -> DataFrame:
    """(name, depth, *values): for every node the sums of ``own_<value>`` over its subtree.

    ``nodes`` has name, depth, parent, weight (of the subtree; a node's own is positive) and the own values.  ``paths``
    has, for the conversation a node is named after, the node at each depth and the next one: whether one node is below
    another, and below which child, is one look into it.
    """
    state = nodes.withColumns({"top": F.lit(0).cast("long"), "top_depth": F.lit(0).cast("long")})
    state = stored(state.withColumns({f"added_{v}": F.lit(0).cast("long") for v in values}))
    component = ["top", "top_depth"]
    small, done = [], []
    while True:
        totals = stored(state.groupBy(*component).agg(F.max("weight").alias("total")))
        large = totals.where(F.col("total") > local_weight)
        if large.isEmpty():
            small.append(state)
            break
        small.append(state.join(large, component, "left_anti"))
        split = state.join(large, component)
        heavy = F.col("weight") * 2 > F.col("total")
        centroids = split.where(heavy).groupBy(*component).agg(F.max_by(F.struct("name", "depth", "weight"), "depth").alias("centroid"))
        split = split.join(centroids, component).withColumns({f"centroid_{c}": F.col(f"centroid.{c}") for c in ("name", "depth", "weight")})
        looked = paths.select(
            F.col("conv_id").alias("name"), F.col("depth").alias("centroid_depth"), F.col("name").alias("there"), "next"
        )
        split = split.join(looked, ["name", "centroid_depth"], "left")
        below = (F.col("depth") >= F.col("centroid_depth")) & F.coalesce(F.col("there") == F.col("centroid_name"), F.lit(False))
        split = stored(split.withColumn("below", below).withColumn("heavy", heavy).drop("centroid", "there"))
        sums = split.where("below").groupBy(*component).agg(*[F.sum(f"own_{v}").alias(f"sum_{v}") for v in values])
        split = split.join(sums, component)
        # A heavy node is the centroid or on its way to the top.
        given = {f"added_{v}": F.when(F.col("heavy"), F.col(f"added_{v}") + F.col(f"sum_{v}")).otherwise(F.col(f"added_{v}")) for v in values}
        split = split.withColumns(given)
        taken = F.col("below") & (F.col("depth") == F.col("centroid_depth"))
        done.append(split.where(taken).select("name", "depth", *[F.col(f"added_{v}").alias(v) for v in values]))
        rest = split.where(~taken).withColumns(
            {
                "weight": F.when(F.col("heavy"), F.col("weight") - F.col("centroid_weight")).otherwise(F.col("weight")),
                "top": F.when(F.col("below"), F.col("next")).otherwise(F.col("top")),
                "top_depth": F.when(F.col("below"), F.col("centroid_depth") + 1).otherwise(F.col("top_depth")),
            }
        )
        state = stored(rest.select(*state.columns))
    out = _solved(small, values, local_weight)
    for part in done:
        out = out.unionByName(part)
    return out


def _solved(parts: list[DataFrame], values: list[str], local_weight: int) -> DataFrame:
    """Components of bounded weight, dealt to tasks by a hash so that about ``local_weight`` of it meet in one group."""
    state = parts[0]
    for part in parts[1:]:
        state = state.unionByName(part)
    total = state.groupBy("top", "top_depth").agg(F.max("weight").alias("w")).agg(F.sum("w")).first()[0] or 0
    bucket = F.pmod(F.xxhash64("top", "top_depth"), F.lit(total // local_weight + 1)).alias("bucket")
    schema = "name long, depth long, " + ", ".join(f"{v} long" for v in values)

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("top", "ascending"), ("top_depth", "ascending"), ("depth", "ascending")])
        column = {c: rows.column(c).to_pylist() for c in rows.column_names}
        place = {key: i for i, key in enumerate(zip(column["name"], column["depth"], strict=True))}
        parent = [place.get((p, d - 1), -1) for p, d in zip(column["parent"], column["depth"], strict=True)]
        tops = list(zip(column["top"], column["top_depth"], strict=True))
        starts = [i for i in range(len(tops)) if not i or tops[i] != tops[i - 1]]
        own = list(zip(*[column[f"own_{v}"] for v in values], strict=True))
        sums = [list(x) for x in zip(*[column[f"added_{v}"] for v in values], strict=True)]
        for a, b in zip(starts, [*starts[1:], len(tops)], strict=True):
            parent[a] = -1
            decompose(list(range(a, b)), parent, column["weight"], own, sums)
        found = {"name": column["name"], "depth": column["depth"]} | {v: [s[k] for s in sums] for k, v in enumerate(values)}
        return pa.table({c: pa.array(x, pa.int64()) for c, x in found.items()})

    return state.withColumn("bucket", bucket).groupBy("bucket").applyInArrow(run, schema)


def decompose(nodes: list[int], parent: list[int], weight: list[int], own: list[tuple], sums: list[list]) -> None:
    """Centroid decomposition of one tree.  ``nodes`` ascend by depth, the top first; ``sums`` become subtree sums."""
    stack = [nodes]
    while stack:
        nodes = stack.pop()
        top = nodes[0]
        half = weight[top] / 2
        centroid = top
        for v in nodes:
            if weight[v] > half:
                centroid = v
        pieces: dict[int, list[int]] = {}  # by the child of the centroid that they hang on
        piece_of: dict[int, list[int]] = {}
        around, total = [], list(own[centroid])
        for v in nodes:
            if v == centroid:
                continue
            above = parent[v]
            piece = pieces.setdefault(v, []) if above == centroid else piece_of.get(above)
            if piece is None:
                around.append(v)
                continue
            piece.append(v)
            piece_of[v] = piece
            for k, x in enumerate(own[v]):
                total[k] += x
        v = centroid
        while True:
            for k, x in enumerate(total):
                sums[v][k] += x
            if v == top:
                break
            v = parent[v]
            weight[v] -= weight[centroid]
        stack += pieces.values()
        if around:
            stack.append(around)


def _ends(ends: DataFrame) -> DataFrame:
    """(name, depth, ends_sha256): the hash runs over the numbers of a node as they come, so none is held as a whole."""
    block = F.shiftright("conv_id", ENDS_BLOCK).alias("block")
    numbers = F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string"))
    pieces = ends.groupBy("name", "depth", block).agg(F.array_join(numbers, ",").alias("piece"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, sha256()
        out: list[tuple[int, int, str]] = []

        def found() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            out.clear()
            kinds = (pa.int64(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays(list(map(pa.array, columns, kinds)), names=["name", "depth", "ends_sha256"])

        for batch in batches:
            for name, depth, piece in zip(*(batch.column(c).to_pylist() for c in ("name", "depth", "piece")), strict=True):
                if (name, depth) != key:
                    if key is not None:
                        out.append((*key, digest.hexdigest()))
                    key, digest = (name, depth), sha256(piece.encode())
                else:
                    digest.update(b"," + piece.encode())
            yield found()
        if key is not None:
            out.append((*key, digest.hexdigest()))
        yield found()

    laid = pieces.repartition("name", "depth").sortWithinPartitions("name", "depth", "block")
    return laid.mapInArrow(tb.tidy(run), "name long, depth long, ends_sha256 string")
