"""Substring search through posting lists of letter groups.

Every row is listed under the two- and three-letter groups of its texts.  A term of three letters or more can only stand in
rows that are listed under all of its three-letter groups, a term of two letters in those under that pair.  The lists are laid
out by group, so a search reads those of its own groups; what they have in common is looked up and checked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.session import spread
from larder.sources.catalog import write_keyed

LONGEST = 3
MOST_KEYS = 1000  # candidates that are passed to the scan as a list; more are joined


def _folded(column: str) -> Column:
    return F.lower(F.coalesce(F.col(column).cast("string"), F.lit("")))


def letter_groups(text: Column) -> Column:
    """The distinct two- and three-letter groups of a text."""

    def of(n: int) -> Column:
        starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - (n - 1))).otherwise(F.expr("cast(array() as array<int>)"))
        return F.transform(starts, lambda i: F.substring(text, i, n))

    return F.array_distinct(F.concat(of(2), of(LONGEST)))


def groups_of_term(term: str) -> list[str]:
    """Groups that a row must have to hold the term; none for a single letter."""
    low, n = term.lower(), min(len(term), LONGEST)
    return sorted({low[i : i + n] for i in range(len(low) - n + 1)}) if n > 1 else []


def write_search_index(df: DataFrame, path: str, key: str, columns: list[str]) -> str:
    """Rows under ``path``/rows, laid out by key, and their posting lists under ``path``/lists, laid out by group.

    ``key`` is unique and not null.
    """
    write_keyed(df, f"{path}/rows", key, [])
    groups = F.array_distinct(F.flatten(F.array(*[letter_groups(_folded(c)) for c in columns])))
    # From the rows as written: whatever made them is not worked out again, neither for the lists nor for their ranges.
    written = df.sparkSession.read.parquet(f"{path}/rows")
    postings = spread(written.select(key, *[c for c in columns if c != key])).select(F.explode(groups).alias("group"), F.col(key).alias("key"))
    # One group may be in every row: files follow ranges of group and key.
    write_keyed(postings, f"{path}/lists", "group", ["key"])
    return path


def search(spark: SparkSession, path: str, key: str, columns: list[str], term: str) -> DataFrame:
    """Rows of an index that hold the term, in any case, in one of the columns it was made of.

    An empty term is in every row.  Terms of a single letter have no list, and all rows are read.
    """
    rows = spark.read.parquet(f"{path}/rows")
    wanted = groups_of_term(term)
    if wanted:
        lists = spark.read.parquet(f"{path}/lists").where(F.col("group").isin(wanted))
        # A row is listed once under a group.
        common = lists.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(wanted)).select("key")
        few = [r[0] for r in common.limit(MOST_KEYS + 1).collect()]
        if len(few) <= MOST_KEYS:
            rows = rows.where(F.col(key).isin(few))
        else:
            rows = rows.join(common.withColumnRenamed("key", key), key, "left_semi").select(*rows.columns)
    found = F.lit(False)
    for c in columns:
        found = found | _folded(c).contains(term.lower())
    return rows.where(found)
