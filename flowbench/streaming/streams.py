"""Flow streams: the batch rules and counts as Structured Streaming plans, and ways to run them to the end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowbench.functions.values import is_infinite, is_missing, strict_label
from flowbench.operators.metrics import binary_metrics, confusion
from flowbench.operators.rules import predict_rules
from flowbench.session import shared_folder


def read_stream(spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*.parquet", files_per_batch: int = 100) -> DataFrame:
    """A Parquet folder as a stream; new files are new flows."""
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(folder)
    )


def event_time(df: DataFrame, column: str, zone: str = "UTC") -> DataFrame:
    """The column as an instant, which watermarks need; a time without zone counts as ``zone``."""
    if isinstance(df.schema[column].dataType, (T.TimestampType, T.DateType)):
        return df.withColumn(column, F.col(column).cast("timestamp"))
    text = F.col(column).cast("string")
    bare = text.try_cast("timestamp_ntz")
    micros = F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), bare)
    local = F.to_utc_timestamp(F.timestamp_micros(micros), zone)
    zoned = text.rlike(r"(?i)\d:\d.*(z|utc|[+-]\d{2}:?\d{2})$")
    return df.withColumn(column, F.when(zoned, text.try_cast("timestamp")).otherwise(local))


# --- plans that work on streams and on tables --------------------------------------------------------------------


def label_counts(df: DataFrame, label: str) -> DataFrame:
    """Running counts of the strict label; the majority class is the larger one."""
    return df.groupBy(strict_label(label).alias("label")).agg(F.count("*").alias("n"))


def majority_class(counts: DataFrame) -> DataFrame:
    """The majority of finished counts; a tie goes to the smaller label."""
    return counts.agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("majority"), F.sum("n").alias("n"))


def rule_scores(df: DataFrame) -> DataFrame:
    """Flows with the prediction of the fixed rules; keeps no state."""
    return predict_rules(df)


def running_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Binary metrics of everything seen so far."""
    return binary_metrics(confusion(df, truth, predicted))


def running_quality(df: DataFrame, columns: list[str], time: str | None = None) -> DataFrame:
    """Rows, missing and infinite cells per column and the time range, as one running row."""
    aggregates = [F.count("*").alias("n_rows")]
    for c in columns:
        kind = df.schema[c].dataType
        aggregates.append(F.count(F.when(is_missing(F.col(c), kind), 1)).alias(f"missing_{c}"))
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            aggregates.append(F.count(F.when(is_infinite(F.col(c)), 1)).alias(f"infinite_{c}"))
    if time is not None:
        aggregates += [F.min(time).alias("earliest"), F.max(time).alias("latest")]
    return df.agg(*aggregates)


def detections_per_window(
    df: DataFrame, time: str, length: str = "10 minutes", slide: str | None = None, late: str = "10 minutes"
) -> DataFrame:
    """Flows and flagged flows per window; rows later than the watermark allows are dropped."""
    span = F.window(time, length, slide) if slide else F.window(time, length)
    return (
        df.withWatermark(time, late)
        .groupBy(span.alias("w"))
        .agg(F.count("*").alias("flows"), F.count(F.when(F.col("prediction") == 1, 1)).alias("flagged"))
        .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "flows", "flagged")
    )


def source_sessions(df: DataFrame, time: str, source: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Activity of each source between pauses of at least ``gap``."""
    return (
        df.withWatermark(time, late)
        .groupBy(F.session_window(time, gap).alias("w"), F.col(source))
        .agg(F.count("*").alias("flows"))
        .select(source, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "flows")
    )


# --- running to the end of the input -------------------------------------------------------------------------------


def final_state(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Runs a running aggregate over all available input and returns its last state.

    Executors write each state to the shared folder, so the state may outgrow the driver. A batch that is run
    again after a failure replaces its own output.
    """
    spark = stream.sparkSession
    folder = shared_folder(spark, "state")
    states: list[int] = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/state/{number}")
        states.append(number)

    run = (
        stream.writeStream.foreachBatch(keep).outputMode(mode)
        .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    )
    run.awaitTermination()
    if not states:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{folder}/state/{max(states)}")


def to_table(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """Appends all available output to a Parquet table and returns it; rows never pass through the driver."""
    spark = stream.sparkSession
    folder = folder or shared_folder(spark, "rows")
    run = (
        stream.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/rows")
        .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    )
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def committed_batches(spark: SparkSession, folder: str) -> list[str]:
    """Batches whose rows stand in an index in full: each left its name in the manifest after its rows were written."""
    manifest = f"{folder}/committed"
    path = spark._jvm.org.apache.hadoop.fs.Path(manifest)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return []
    return sorted(r["batch"] for r in spark.read.schema("batch string").json(f"{manifest}/*").distinct().collect())


def run_index(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """The rows of all committed batches; what a batch left that was never committed is not read."""
    folders = [f"{folder}/index/{b}" for b in committed_batches(spark, folder)]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def append_new_runs(stream: DataFrame, run_id: str, time: str, folder: str, late: str = "1 day") -> None:
    """Appends finished runs to the run index once each, however often and how late a run is reported again, also after restarts.

    Reports within ``late`` of each other are merged by state that the watermark frees; older ones are found in the index itself. Rows go to
    ``folder/index/<stream>-<batch>``, and the batch's name to the manifest ``folder/committed`` once they are there. A start reads the
    manifest, so runs that an earlier process appended are known. A batch that is run again replaces its own rows, and a new
    checkpoint (its stream has another name) replaces none.
    """
    once = stream.withWatermark(time, late).dropDuplicatesWithinWatermark([run_id])
    spark = stream.sparkSession
    done = set(committed_batches(spark, folder))

    def append(batch: DataFrame, number: int) -> None:
        own = f"{batch.sparkSession.sparkContext.getLocalProperty('sql.streaming.queryId')}-{number}"
        earlier = [f"{folder}/index/{n}" for n in sorted(done - {own})]
        if earlier:
            known = batch.sparkSession.read.schema(batch.schema).parquet(*earlier).select(run_id)
            batch = batch.join(known, run_id, "left_anti")
        batch.write.mode("overwrite").parquet(f"{folder}/index/{own}")
        named = batch.sparkSession.createDataFrame([(own,)], "batch string").coalesce(1)
        named.write.mode("overwrite").json(f"{folder}/committed/{own}")
        done.add(own)

    run = (
        once.writeStream.foreachBatch(append).option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True).start()
    )
    run.awaitTermination()
