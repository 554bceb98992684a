"""The corpus pipeline: documents without toxic, near-duplicate and leaked ones, without secrets, as token ids.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's rows as Parquet in the
shared folder and hands them, read again, to the next.  All stages but the last return the columns of ``documents``.
Each works on every row that its predecessor kept; null and empty texts pass through all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm import byte_bpe, secrets, toxicity
from larder.llm.decontaminate import decontaminate
from larder.llm.near_duplicates import near_duplicates
from larder.llm.queries import byte_vocabulary
from larder.llm.shared import remove, stored, table
from larder.session import scratch_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject (score below 0.3).

    The model learns from labelled documents outside the held-out quarter.
    """
    docs = docs.select(*COLUMNS)
    weights = toxicity.train(docs, table(spark, sf_dir, "labels").where(~toxicity.fold()))
    return toxicity.score(docs, weights).where("predicted = 0").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, of the smallest id, of each group linked by 0.8 or more of their five-word shingles.

    Rows are told apart by a hash of id and text, and a row without an id comes after all others of its group.  Of rows
    that are equal in both, one stays.  Documents without words stay, repeated ones too.
    """
    docs = docs.select(*COLUMNS).withColumn("row_key", F.xxhash64("doc_id", "text"))
    found = near_duplicates(docs, words=5, percent=80, doc_id="row_key").where("n_shingles > 0")
    keys = stored(found.groupBy(F.col("doc_id").alias("row_key"), "component_id").agg(F.count(F.lit(1)).alias("n")))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")
    first = (
        docs.select("row_key", "doc_id")
        .join(keys, "row_key")
        .groupBy("component_id")
        .agg(F.min(order).alias("first"))
        .select("first.row_key")
    )
    dropped = keys.join(first, "row_key", "left_anti").select("row_key")
    repeated = keys.where("n > 1").select("row_key")
    single = docs.join(dropped.union(repeated).distinct(), "row_key", "left_anti").select(*COLUMNS)
    many = docs.join(repeated.join(first, "row_key", "left_semi"), "row_key", "left_semi")
    one = many.groupBy("row_key").agg(F.min(F.struct(*COLUMNS)).alias("row")).select("row.*")
    return single.unionByName(one)


def drop_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no ten consecutive words, and no whole shorter item, of the benchmark.

    Rows are told apart by a hash of id and text, so documents without an id are judged one by one.
    """
    docs = docs.select(*COLUMNS).withColumn("row_key", F.xxhash64("doc_id", "text"))
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"), doc_id="row_key")
    leaked = found.where("contaminated").select(F.col("doc_id").alias("row_key")).distinct()
    return docs.join(leaked, "row_key", "left_anti").select(*COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret in their texts replaced by [SECRET], n_chars counted anew where that happened."""
    found = secrets.scan(docs.select(*COLUMNS))
    clean = secrets.redacted(F.col("text"), F.col("spans"))
    return found.withColumn("clean", clean).select(
        "doc_id",
        F.col("clean").alias("text"),
        "lang",
        "source",
        F.when(F.size("spans") == 0, F.col("n_chars")).otherwise(F.length("clean").cast("long")).alias("n_chars"),
    )


def encode_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents, how many there are, and whether they decode to the very text."""
    ranks, pattern = byte_vocabulary()
    both = byte_bpe.encode(docs.select(*COLUMNS), ranks=ranks, pattern=pattern, decoded="decoded")
    whole = F.coalesce(F.col("decoded").cast("string") == F.coalesce("text", F.lit("")), F.lit(False))
    return both.select(
        "doc_id", "lang", "source", "n_chars", F.size("ids").cast("long").alias("n_tokens"), "ids", whole.alias("lossless")
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("benchmark decontamination", drop_leaked),
    ("secret scan", mask_secrets),
    ("byte-level BPE", encode_bytes),
]

# Trained weights and MinHash classes have no SQL form; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of ``sf_dir``."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
