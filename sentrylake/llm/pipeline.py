"""The stages of the corpus pipeline: each takes (spark, docs, sf_dir) and returns a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrylake.llm import exactdedup, gam, mixing, neardup, queries
from sentrylake.llm.common import remainder
from sentrylake.session import staged

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Null and empty texts are scored like any other; an empty table
    gives an empty table."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return gam.keep_good(docs, "doc_id", "text", labels, "doc_id", "quality", remainder("doc_id", 5) != 0)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of equal documents stays; null counts as empty, and an empty table gives an empty table."""
    return exactdedup.drop_copies(docs, "doc_id", "text")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, five-word Jaccard of 0.8 or more, stays."""
    return neardup.one_of_similar(docs, "doc_id", "text")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the target weights ask for, once for each epoch; a leaf's last one is cut where
    its quota ends. Rows are told apart by a number, as ids may be null or repeated; of other columns than those of
    documents none stays."""
    docs = staged(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()))
    chosen = queries.mixed(docs, ("_row",)).select("_row", "epoch", F.col("tokens").alias("_tokens"), "take_tokens")
    joined = docs.join(chosen, "_row")
    cut = F.col("take_tokens") < F.col("_tokens")
    text = F.when(cut, mixing.first_words(F.col("text"), F.col("take_tokens"))).otherwise(F.col("text"))
    return joined.select("doc_id", text.alias("text"), "lang", "source", F.when(cut, F.length(text).cast("bigint")).otherwise(F.col("n_chars")).alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 4,096 tokens; a null text is its end token alone."""
    return queries.packed(docs)


STAGES = [("quality classifier", quality), ("exact dedup", exact_copies), ("simhash near-dedup", near_copies), ("source mixing", mix), ("packing", pack)]
