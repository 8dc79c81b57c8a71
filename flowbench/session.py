"""Session settings and the two ways the engine cuts lineage or moves small tables."""

from __future__ import annotations

import posixpath
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A table is sent to every executor only after it was counted and found to have at most this many rows.
BROADCAST_ROWS = 100_000
# … and its texts this many bytes.
BROADCAST_BYTES = 64_000_000
_FIXED_WIDTH = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType, T.NullType)


def build_session(
    app: str = "flowbench",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """A session with adaptive execution on; cluster settings stay with the cluster unless given here."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        # Sessions of a busy source are merged before the shuffle, too.
        .config("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
        # Without this, every column expression records the Python stack that built it.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a scratch folder; a cluster without one is an error,
    because a machine-local folder is lost with its executor.
    """
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if root is None:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="flowbench-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(root)
    return root


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that all executors share."""
    return posixpath.join(_shared_root(spark), f"flowbench-{name}-{uuid.uuid4().hex}")


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    _shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


# Parts of at most so many rows are not worth dealing out.
ROWS_A_PART = 200_000


def dealt(df: DataFrame, name: str) -> DataFrame:
    """A table read from files, dealt out over all cores if one of its parts has over 1.5 times a core's share of the rows.

    Files of few row groups come in as many parts as others of their size, but all rows are in the few parts where a group lies.
    The rows of each part are counted first, which reads no column. Dealt rows go where the hash of their place in the files says:
    equal rows do not stay together, and no part is sorted for it. They are written as Parquet in the shared folder, for a filter
    on what is read would otherwise be worked out before they are dealt.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    parts = df.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n"))
    most, rows = parts.agg(F.max("n"), F.sum("n")).first()
    if not rows or most <= ROWS_A_PART or most * cores <= 1.5 * rows:
        return df
    path = shared_folder(spark, name)
    df.repartition(max(cores, df.rdd.getNumPartitions()), F.monotonically_increasing_id()).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once as Parquet in the shared folder and read from there, so that many passes do not work them out again.

    A table that comes in fewer parts than there are cores (a small file is one) is dealt out in as many as cores first.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    path = shared_folder(spark, name)
    (df.repartition(cores) if df.rdd.getNumPartitions() < cores else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _bytes_of(df: DataFrame) -> Column:
    """Bytes of a row's cells of no fixed width, as text."""
    wide = [F.col(f"`{f.name}`") for f in df.schema.fields if not isinstance(f.dataType, _FIXED_WIDTH)]
    sizes = [F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)).cast("bigint") for c in wide]
    return sum(sizes, F.lit(0).cast("bigint"))


def settled(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> tuple[DataFrame, int]:
    """Run a plan that is expected to give a small table once, so that later plans reuse its rows.

    Up to ``max_rows`` rows of ``max_bytes`` in all come back as a local table marked for broadcast, with their number. A larger
    result is checkpointed in full and left to an ordinary shuffle join, so no size of input is refused. Rows with texts or
    other cells of no fixed width are checkpointed and measured before they go to the driver.
    """
    if all(isinstance(f.dataType, _FIXED_WIDTH) for f in df.schema.fields):
        rows = df.limit(max_rows + 1).toArrow()
        if rows.num_rows <= max_rows:
            return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema)), rows.num_rows
        kept = checkpoint(df)
        return kept, kept.count()
    kept = checkpoint(df)
    n, size = kept.agg(F.count("*"), F.coalesce(F.sum(_bytes_of(kept)), F.lit(0))).first()
    if n > max_rows or size > max_bytes:
        return kept, n
    return F.broadcast(df.sparkSession.createDataFrame(kept.toArrow(), df.schema)), n


def settle(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The table of ``settled`` alone."""
    return settled(df, max_rows)[0]


# Classes, categories and the like that a fitting step takes to the driver.
MOST_CLASSES = 10_000


def few_rows(df: DataFrame, what: str, most: int = MOST_CLASSES) -> list:
    """The rows of a table that is small by its nature; more than ``most`` are an error, not a driver that runs out of memory."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} {what}")
    return rows
