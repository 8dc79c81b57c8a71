"""Exact deduplication against a persistent index of text digests, bucketed and sorted by digest."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowbench.llm.common import ascii_lower, written


def text_digest(text: Column) -> Column:
    """SHA-256 (binary) of the text after lower-casing A-Z only; null counts as empty. Texts of equal digest count as equal."""
    return F.unhex(F.sha2(ascii_lower(F.coalesce(text, F.lit(""))), 256))


class DigestIndex:
    """A table of every digest taken in so far and the row that stays for it.

    The files below ``path`` are the index: another session that opens the same path goes on with it. They are
    bucketed and sorted by digest, so that a batch is joined with them by a merge that shuffles the batch alone.
    Batches must be absorbed one after the other. The number of buckets stands beside the files: it cannot change, and
    opening the path with another number is an error (None takes the number that is there, or 64).
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None, id_type: str = "bigint"):
        self.spark = spark
        about = f"{path}/_about"  # a name that table scans pass over
        place = spark._jvm.org.apache.hadoop.fs.Path(about)
        if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
            found = spark.read.schema("buckets int").json(about).first()[0]
            if buckets not in (None, found):
                raise ValueError(f"the index has {found} buckets, not {buckets}")
            self.buckets = found
        else:
            self.buckets = buckets or 64
            spark.createDataFrame([(self.buckets,)], "buckets int").coalesce(1).write.json(about)
        self.name = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.name} (digest BINARY, keep_id {id_type}, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}'"
        )

    def table(self) -> DataFrame:
        """The index's rows: ``digest``, ``keep_id``, ``batch``."""
        return self.spark.table(self.name)

    def absorb(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
        """Deduplicates a batch against the index and itself, and appends its new digests.

        Returns ``id_col``, ``keep_id``, ``group_size``, ``kept``, ``digest`` and ``row`` for every row of the batch. Of equal texts in
        the batch that the index does not know yet, the row with the largest id stays (null is smallest; of repeated rows with that
        id, one). Of texts that the index knows, none stays and ``keep_id`` is the one kept earlier. ``group_size`` counts the
        batch's rows. ``row`` numbers the batch's rows as they were read. Other columns are not returned. An empty batch gives no row.

        ``batch`` names the batch. A job that died after its digests were appended, or while they were, absorbs the same rows under the
        same name again and gets the same answer; without a name every call is a new batch.
        """
        rows = written(
            docs.select(F.col(f"`{id_col}`").alias("id"), text_digest(F.col(f"`{text_col}`")).alias("digest"), F.monotonically_increasing_id().alias("row")), "digests"
        )
        groups = rows.groupBy("digest").agg(F.max(F.struct("id", "row")).alias("last"), F.count("*").alias("group_size"))
        batch = batch or uuid.uuid4().hex
        fresh = groups.join(self.table().hint("merge"), "digest", "left_anti").select(
            "digest", F.col("last.id").alias("keep_id"), F.lit(batch).alias("batch")
        )
        # One file for each bucket; the write is committed as a whole.
        fresh.repartition(self.buckets, "digest").write.insertInto(self.name)
        decided = groups.select("digest", "group_size", F.col("last.row").alias("last_row")).join(self.table().hint("merge"), "digest")
        # A text that very many rows share is one row here and a skewed partition there, which adaptive execution splits.
        return rows.join(decided, "digest").select(
            F.col("id").alias(id_col),
            "keep_id",
            "group_size",
            ((F.col("batch") == batch) & (F.col("row") == F.col("last_row"))).alias("kept"),
            "digest",
            "row",
        )
