"""From raw documents to token ids: quality rules, exact and near deduplication, mixing, encoding.

Every stage takes all that the stage before kept; the caller writes each result and reads it again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowbench.llm import mixing, quality_rules, simhash
from flowbench.llm.common import table, written
from flowbench.llm.exact_dedup import DigestIndex, text_digest
from flowbench.llm.queries import token_digests
from flowbench.session import shared_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that meet the newest policy."""
    kept = quality_rules.ledger(docs, prefix="ledger_").where(quality_rules.passes("v2", "ledger_fail_bits"))
    return kept.select(docs.columns)


def _key() -> Column:
    """The document's id as a join key that a null id has, too."""
    return F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("pipeline_key")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id; of rows that repeat it, one."""
    index = DigestIndex(spark, shared_folder(spark, "digest-index"), buckets=32)
    kept = index.absorb(docs).where("kept").select(_key(), F.col("digest").alias("pipeline_digest"))
    keyed = docs.select("*", _key(), text_digest(F.col("text")).alias("pipeline_digest")).join(kept, ["pipeline_key", "pipeline_digest"])
    # The join has dealt out the rows by these columns already.
    first = keyed.withColumn("pipeline_n", F.expr("row_number() OVER (PARTITION BY pipeline_key, pipeline_digest ORDER BY doc_id)"))
    return first.where("pipeline_n = 1").select(docs.columns)


def _numbered(docs: DataFrame) -> DataFrame:
    """The documents with a number for each row, written once: ids can be null or stand at several rows."""
    return written(docs.withColumn("pipeline_row", F.monotonically_increasing_id()), "numbered")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, one row: the one with the smallest id (null is largest; of rows with that id, the first)."""
    rows = _numbered(docs)
    ordered = F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "pipeline_row").alias("pipeline_id")
    groups = simhash.near_duplicates(rows.select(ordered, "text"), shingle=3, max_bits=2, id_col="pipeline_id")
    kept = groups.where("pipeline_id.pipeline_row = component_id.pipeline_row").select("pipeline_id.pipeline_row")
    return rows.join(kept, "pipeline_row", "left_semi").select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix takes it."""
    rows = _numbered(docs)
    times = F.expr("cast(taken div size AS int)").alias("pipeline_times")
    taken = mixing.mix(rows, row_col="pipeline_row").where("taken > 0").select(F.col("row").alias("pipeline_row"), times)
    joined = rows.join(taken, "pipeline_row")
    return joined.select(*docs.columns, F.explode(F.sequence(F.lit(1), "pipeline_times")).alias("pipeline_pass")).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, as digests."""
    return token_digests(docs)


STAGES = [("quality rules", quality), ("exact dedup", exact), ("SimHash near-dedup", near), ("mixing", mix), ("byte-level BPE", encode)]

# Near-duplicate links, the seeded selection and the merges of BPE are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
