"""Chat formatting by quotation linking.

Lines that begin with ``>`` quote an earlier message, ``>>`` one that it quoted in turn.  Adjacent lines of one level are a
passage.  Every quoted line is normalised, hashed and joined to the latest earlier message of its conversation that has
that line itself one level further out; a line that no message has so, because a mail client wrapped it anew or it is a
sentence out of a longer one, is joined by the sentences and word shingles of its passage.  The message most lines of a
reply point to, and of several the latest, is what it answers; deeper levels decide where the first does not.  Chains of
answers are then followed by pointer doubling, so that each message gets its thread and its depth, and its text without
the quotes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.llm import text_blocks as tb
from larder.llm.shared import stored
from larder.operators.ordering import number_rows

SHINGLE = 4  # words
TURN_BLOCK = 10  # log2 of the turns among which one window looks for a line

_MARKS = r"^[ \t>]*"  # no repeated group: it would cost the JVM a stack frame for every mark


def _level(line: Column) -> Column:
    """Number of quote marks in front of a line; spaces between them are allowed."""
    return F.length(F.regexp_replace(F.regexp_extract(line, _MARKS, 0), r"[^>]", ""))


def _bare(line: Column) -> Column:
    """A line without its quote marks and the space after them."""
    return F.when(_level(line) == 0, line).otherwise(F.regexp_replace(line, _MARKS + ">[ \t]?", ""))


_MARKED = re.compile(_MARKS)
_WORD = re.compile(r"[^\W_]+")
_SENTENCE_END = re.compile(r"[.!?\u2026]+(?=\s|$)|[\u3002\uff01\uff1f]+")


def _print(words: list[str]) -> int:
    """Hash of words in lower case with letters and digits only."""
    return int.from_bytes(blake2b(" ".join(words).encode(), digest_size=8).digest(), "little", signed=True)


def _prints(lines: list[str]) -> set[tuple[int, int, bool, int]]:
    """(level, hash of a line, whether the next is that line as a whole, hash) of a message.

    Beside whole lines these are what each line shares in: the lines, sentences, shingles and, where there is no shingle,
    the whole of its passage.  Lines without a word do not part a passage.
    """
    passages: list[tuple[int, list[tuple[str, int]], list[int], list[int]]] = []  # level, (word, line), line ends, sentence ends
    for line in lines:
        marks = _MARKED.match(line)[0]
        parts = [_WORD.findall(part) for part in _SENTENCE_END.split(line[len(marks) :].lower())]
        if not any(parts):
            continue
        level = marks.count(">")
        if not passages or passages[-1][0] != level:
            passages.append((level, [], [], []))
        _, words, breaks, ends = passages[-1]
        for k, part in enumerate(parts):
            words += [(w, len(breaks)) for w in part]
            if k < len(parts) - 1:
                ends.append(len(words))
        breaks.append(len(words))
    out = set()
    for level, tokens, breaks, ends in passages:
        words, n = [w for w, _ in tokens], len(tokens)
        own = [_print(words[a:b]) for a, b in zip([0, *breaks], breaks)]
        out |= {(level, x, True, x) for x in own}
        spans = {*zip([0, *breaks], breaks), *zip([0, *ends], [*ends, n])}
        spans |= {(k, min(k + SHINGLE, n)) for k in range(max(1, n - SHINGLE + 1))}
        for a, b in spans:
            if a < b:
                piece = _print(words[a:b])
                out |= {(level, own[k], False, piece) for k in range(tokens[a][1], tokens[b - 1][1] + 1)}
    return out


_BATCH_PRINTS = 50_000


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int32(), pa.int64(), pa.bool_(), pa.int64())
    for batch in batches:
        held: list[tuple[int, int, bool, int]] = []
        rows: list[int] = []
        for at in range(len(batch)):
            found = sorted(_prints(batch.column("lines")[at].as_py()))
            held += found
            rows += [at] * len(found)
            if held and (len(held) > _BATCH_PRINTS or at == len(batch) - 1):
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c).take(pa.array(rows)) for c in ("conv_id", "turn")),
                        *(pa.array(values, kind) for values, kind in zip(zip(*held), kinds)),
                    ],
                    names=["conv_id", "turn", "level", "line", "exact", "print"],
                )
                held, rows = [], []


def link_quotations(
    messages: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row per message: conv_id, turn, role, text without quotes, quoted (its lines of level 1), reply_to (a turn of
    the same conversation or null), thread (the turn its chain of answers begins with), depth (answers in between) and
    position (its place in the thread, from 0).

    A thread is a conversation built anew: its messages by position, every one behind what it answers, since only earlier
    turns can be answered.  Messages outside any chain are threads of their own.  A line of level n points to a message that has it at level n - 1, which has what it quotes n - 1
    steps further up; where none has, to the nearest level outside it.  Null and empty texts quote nothing and come back empty; a null conversation or turn quotes nothing
    and is not found.  Rows that repeat a turn are all returned; what any of them quotes counts for all.  Ties between
    earlier messages go to the later turn.  An empty table gives an empty result.
    """
    turns = messages.select(
        F.col(conv_id).alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        F.col(role).alias("role"),
        F.split(F.regexp_replace(F.coalesce(F.col(text).cast("string"), F.lit("")), "\r\n?", "\n"), "\n").alias("lines"),
    )
    known = turns.where("conv_id is not null and turn is not null")
    # Only conversations that quote at all go on.
    quoting = known.where(F.exists("lines", lambda x: _level(x) > 0)).select("conv_id").distinct()
    talk = known.join(quoting, "conv_id", "left_semi").select("conv_id", "turn", "lines")
    schema = T.StructType([talk.schema["conv_id"], talk.schema["turn"]])
    schema = schema.add("level", "integer").add("line", "long").add("exact", "boolean").add("print", "long")
    prints = talk.mapInArrow(tb.tidy(_batches), schema)
    quotes = stored(prints.where("level > 0").distinct())
    key = ["conv_id", "exact", "print"]
    # Of all others only those that are quoted somewhere in their conversation at a deeper level.
    deepest = quotes.groupBy(*key).agg(F.max("level").alias("deepest"))
    origins = stored(
        prints.join(deepest, key)
        .where("level < deepest")
        .select(*key, F.col("level").alias("held"), "turn", F.col("turn").alias("origin"))
        .distinct()
    )
    held = quotes.join(origins.select(*key, "held").distinct(), key).where("held < level")
    # Each line has one vote: for a message that has it as near to its own level as can be, and there as a whole line.
    votes = (
        _latest_before(held, origins, [*key, "held"])
        .where("source is not null")
        .groupBy("conv_id", "turn", "level", "line", "held", "exact", "source")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("conv_id", "turn", "level", "line")
        .agg(F.max(F.struct("held", "exact", "n", "source")).alias("best"))
    )
    replies = (
        votes.groupBy("conv_id", "turn", "level", "best.held", "best.source")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("conv_id", "turn")
        .agg(F.max(F.struct(-F.col("level"), "held", "n", "source")).alias("best"))
        .select("conv_id", "turn", F.col("best.source").alias("reply_to"))
    )
    chains = _placed(_chains(stored(replies)))
    own = F.transform(F.filter("lines", lambda x: _level(x) == 0), _bare)
    return (
        turns.withColumn("text", F.btrim(F.regexp_replace(F.array_join(own, "\n"), "\n{3,}", "\n\n"), F.lit("\n ")))
        .withColumn("quoted", F.size(F.filter("lines", lambda x: _level(x) == 1)))
        .join(chains, ["conv_id", "turn"], "left")
        .select(
            "conv_id",
            "turn",
            "role",
            "text",
            "quoted",
            "reply_to",
            F.coalesce("thread", "turn").alias("thread"),
            F.coalesce("depth", F.lit(0)).alias("depth"),
            F.coalesce("position", F.lit(0).cast("long")).alias("position"),
        )
    )


def _latest_before(asked: DataFrame, origins: DataFrame, key: list[str]) -> DataFrame:
    """``asked`` with ``source``, the largest turn below its own among ``origins`` of the same key; null for none.

    Turns are cut into blocks.  A window looks within a block; what earlier blocks of the key end with is a running
    maximum over one row per block.  So a line that stands in every message of a long conversation is no single task.
    """
    block = F.shiftright("turn", TURN_BLOCK).alias("block")
    last = origins.groupBy(*key, block).agg(F.max("origin").alias("last"))
    blocks = last.select(*key, "block").unionByName(asked.select(*key, block)).distinct().join(last, [*key, "block"], "left")
    over_blocks = Window.partitionBy(*key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select(*key, "block", F.max("last").over(over_blocks).alias("carried"))
    within = Window.partitionBy(*key, "block").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    both = asked.withColumn("origin", F.lit(None).cast("long")).unionByName(origins, allowMissingColumns=True)
    found = both.withColumn("block", block).withColumn("own", F.max("origin").over(within)).where("origin is null")
    return found.join(carried, [*key, "block"]).withColumn("source", F.coalesce("own", "carried")).drop("own", "carried", "block", "origin")


def _placed(chains: DataFrame) -> DataFrame:
    """Replies with their place in the thread, behind the message it begins with.

    Numbered over the table, not by a window: one thread may be a large part of all messages.
    """
    numbered = number_rows(chains, ["conv_id", "thread", "turn"], "place", start=1)
    firsts = numbered.groupBy("conv_id", "thread").agg(F.min("place").alias("first"))
    return numbered.join(firsts, ["conv_id", "thread"]).withColumn("position", F.col("place") - F.col("first") + 1).drop("place", "first")


def _chains(replies: DataFrame) -> DataFrame:
    """conv_id, turn, reply_to, thread and depth of all replies; each round doubles the steps that are known."""
    known = replies.withColumn("thread", F.col("reply_to")).withColumn("depth", F.lit(1))
    while True:
        further = known.select(
            "conv_id", F.col("turn").alias("thread"), F.col("thread").alias("beyond"), F.col("depth").alias("more")
        )
        known = stored(
            known.join(further, ["conv_id", "thread"], "left").select(
                "conv_id",
                "turn",
                "reply_to",
                F.coalesce("beyond", "thread").alias("thread"),
                (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
                F.col("beyond").isNotNull().alias("moved"),
            )
        )
        if known.where("moved").isEmpty():
            return known.drop("moved")
        known = known.drop("moved")
