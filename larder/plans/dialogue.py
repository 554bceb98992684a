"""Recent context of a conversation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.operators.windows import last_rows

KEPT_MESSAGES, SHOWN_CHARACTERS = 6, 100


# Headings that bracket the findings of a structured answer, and how much of them is shown.
FINDINGS, AFTER_FINDINGS, SHOWN_FINDINGS = "KEY FINDINGS", "BUSINESS RECOMMENDATIONS", 150


def _shown_text(shown: int) -> Column:
    """Start of a message; of a structured answer, the start of its findings."""
    content = F.col("content")
    after = F.substring(content, F.instr(content, FINDINGS) + len(FINDINGS), F.length(content))
    findings = F.trim(F.substring(F.substring_index(after, AFTER_FINDINGS, 1), 1, SHOWN_FINDINGS))
    return (
        F.when(F.col("role") == "user", F.concat(F.lit("User: "), F.substring(content, 1, shown)))
        .when(content.contains(FINDINGS), F.concat(F.lit("AI found: "), findings))
        .otherwise(F.concat(F.lit("AI: "), F.substring(content, 1, shown)))
    )


def recent_messages(
    messages: DataFrame, order: list[Column] | None = None, kept: int = KEPT_MESSAGES, shown: int = SHOWN_CHARACTERS
) -> DataFrame:
    """The last messages of each conversation as one text, oldest first, each cut to its first characters.

    Conversations of fewer than two messages have no context.  Each map task passes on at most ``kept``
    messages per conversation, so a very long conversation is no burden.
    """
    talk = messages.where(F.col("role").isin("user", "assistant"))
    order = order or [F.col("turn"), F.col("role"), F.col("content")]
    line = F.concat(_shown_text(shown), F.lit("..."))
    tail = last_rows(talk, ["conv_id"], order, kept).select("conv_id", "from_end", line.alias("line"))
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("from_end")).alias("o"), "line")))["line"]
    return (
        tail.groupBy("conv_id")
        .agg(F.array_join(ordered, "\n").alias("context"), F.count(F.lit(1)).alias("messages"))
        .where(F.col("messages") >= 2)
    )
