"""Streams over the whole event table, run to the end and checked against the batch answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowbench.plans.catalog import query
from flowbench.plans.flows import flows_of, table
from flowbench.plans.queries_cleaning import round_all
from flowbench.plans.queries_metrics import rule_steps
from flowbench.session import shared_folder
from flowbench.plans.texts import COUNT_NAMES, SCORE_NAMES, SCORED_COLUMNS, STRICT, binary_metric_steps, on_flows
from flowbench.streaming import streams


def flow_stream(spark, sf_dir):
    """The event files as a stream of flows; their schema comes from the table, not from the stream."""
    schema = table(spark, sf_dir, "events").schema
    return flows_of(streams.read_stream(spark, sf_dir, schema, "events.parquet"))


@query("l1_running_labels", on_flows(f"SELECT {STRICT.format('label')} AS label, count(*) AS n FROM flows GROUP BY 1"))
def running_labels(spark, sf_dir):
    return streams.final_state(streams.label_counts(flow_stream(spark, sf_dir), "label"))


@query(
    "l1_running_majority",
    on_flows(
        f"SELECT y AS majority, CAST(t AS BIGINT) AS n FROM (SELECT y, k, sum(k) OVER () AS t FROM (SELECT {STRICT.format('label')} AS y, count(*) AS k FROM flows GROUP BY 1)) ORDER BY k DESC, y LIMIT 1"
    ),
)
def running_majority(spark, sf_dir):
    return streams.majority_class(streams.final_state(streams.label_counts(flow_stream(spark, sf_dir), "label")))


@query(
    "l2_running_metrics",
    on_flows(
        f"SELECT {SCORED_COLUMNS} FROM scored",
        **rule_steps("flows"),
        counted="SELECT " + ", ".join(
            f"count(CASE WHEN {STRICT.format('label')} = {t} AND prediction = {p} THEN 1 END) AS {n}" for n, t, p in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))
        ) + " FROM flagged",
        **binary_metric_steps("counted"),
    ),
)
def running_metrics(spark, sf_dir):
    scored = streams.rule_scores(flow_stream(spark, sf_dir)).withColumn("y", F.expr(STRICT.format("label")))
    out = streams.final_state(streams.running_metrics(scored, "y", "prediction"))
    return round_all(out, SCORE_NAMES).select(*COUNT_NAMES, *SCORE_NAMES)


@query("l3_scored_stream", on_flows("SELECT flow_id, prediction FROM flagged", **rule_steps("flows")))
def scored_stream(spark, sf_dir):
    return streams.to_table(streams.rule_scores(flow_stream(spark, sf_dir)).select("flow_id", "prediction"))


@query(
    "l4_running_quality",
    on_flows(
        "SELECT count(*) AS n_rows, count(*) - count(flow_bytes_s) AS missing_flow_bytes_s, count(CASE WHEN isinf(flow_bytes_s) THEN 1 END) AS infinite_flow_bytes_s, "
        "count(*) - count(dataset_source) AS missing_dataset_source, min(epoch_us(flow_start_ts)) AS earliest, max(epoch_us(flow_start_ts)) AS latest FROM flows"
    ),
)
def running_quality(spark, sf_dir):
    stream = streams.event_time(flow_stream(spark, sf_dir), "flow_start_ts")
    out = streams.final_state(streams.running_quality(stream, ["flow_bytes_s", "dataset_source"], "flow_start_ts"))
    return out.withColumns({c: F.unix_micros(c) for c in ("earliest", "latest")})


# The same flows as four files in the order of time, one for each micro-batch; every fiftieth flow arrives with the last file.
# A batch drops rows whose window ended before the watermark of the batch before it: ten minutes before the newest flow of
# the first two files, for the last one. A window is emitted once the watermark, at the end ten minutes before the newest flow, passes it.
_PARTS = 4
_ARRIVED = """SELECT *, CASE WHEN {late} THEN 3 ELSE CAST(floor(4 * (us - lo) / (hi - lo + 1)) AS INTEGER) END AS part
  FROM (SELECT *, min(us) OVER () AS lo, max(us) OVER () AS hi FROM (SELECT *, epoch_us(flow_start_ts) AS us FROM {source}))"""
_FLAGGED = {
    **rule_steps("flows"),
    "arrived": _ARRIVED.format(late="flow_id % 50 = 0", source="flagged"),
    "marks": "SELECT max(us) - 600000000 AS at_end, max(CASE WHEN part < 2 THEN us END) - 600000000 AS before_last FROM arrived",
}


def _windows(starts: str, length: int) -> str:
    return f"""SELECT s AS start_us, count(*) AS flows, CAST(sum(prediction) AS BIGINT) AS flagged
      FROM (SELECT prediction, part, unnest({starts}) AS s FROM arrived), marks
      WHERE s + {length} <= at_end AND (part < 3 OR s + {length} > before_last) GROUP BY 1"""


def arriving_flows(spark, sf_dir, delayed=None):
    """The events written to a new folder as ``_PARTS`` files in time order, and read from there one file at a time."""
    events = table(spark, sf_dir, "events")
    us = F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), F.col("ts"))
    lo, hi = events.agg(F.min(us), F.max(us)).first()
    part = F.floor(_PARTS * (us - lo) / (hi - lo + 1))
    if delayed is not None:
        part = F.when(F.expr(delayed), _PARTS - 1).otherwise(part)
    folder = shared_folder(spark, "arrivals")
    for i in range(_PARTS):
        events.where(part == i).coalesce(1).write.mode("append").parquet(folder)
    return flows_of(streams.read_stream(spark, folder, events.schema, files_per_batch=1))


@query("l5_detections_per_window", on_flows(_windows("[us // 600000000 * 600000000]", 600_000_000), **_FLAGGED))
def detections_per_window(spark, sf_dir):
    stream = streams.event_time(streams.rule_scores(arriving_flows(spark, sf_dir, "event_id % 50 = 0")), "flow_start_ts")
    out = streams.to_table(streams.detections_per_window(stream, "flow_start_ts"))
    return out.select(F.unix_micros("start").alias("start_us"), "flows", "flagged")


@query(
    "l5_detections_per_sliding_window",
    on_flows(_windows("[us // 600000000 * 600000000, us // 600000000 * 600000000 - 600000000]", 1_200_000_000), **_FLAGGED),
)
def detections_per_sliding_window(spark, sf_dir):
    stream = streams.event_time(streams.rule_scores(arriving_flows(spark, sf_dir, "event_id % 50 = 0")), "flow_start_ts")
    out = streams.to_table(streams.detections_per_window(stream, "flow_start_ts", "20 minutes", "10 minutes"))
    return out.select(F.unix_micros("start").alias("start_us"), "flows", "flagged")


# Files in time order; sessions that ended an hour before the newest flow are final.
@query(
    "l6_source_sessions",
    on_flows(
        """SELECT * FROM (SELECT src_host, min(us) AS start_us, max(us) + 86400000000 AS end_us, count(*) AS flows FROM
        (SELECT *, sum(fresh) OVER (PARTITION BY src_host ORDER BY us, flow_id ROWS UNBOUNDED PRECEDING) AS s FROM
          (SELECT src_host, flow_id, us, CASE WHEN us - lag(us) OVER (PARTITION BY src_host ORDER BY us, flow_id) <= 86400000000 THEN 0 ELSE 1 END AS fresh FROM
            (SELECT src_host, flow_id, epoch_us(flow_start_ts) AS us FROM flows))) GROUP BY src_host, s)
        WHERE end_us <= (SELECT max(epoch_us(flow_start_ts)) - 3600000000 FROM flows)"""
    ),
)
def source_sessions(spark, sf_dir):
    stream = streams.event_time(arriving_flows(spark, sf_dir), "flow_start_ts")
    out = streams.to_table(streams.source_sessions(stream, "flow_start_ts", "src_host", "1 day"))
    return out.select("src_host", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "flows")


@query("l7_run_index", "SELECT concat('run', user_id) AS run_id, 1 AS copies FROM (SELECT DISTINCT user_id FROM events)")
def run_index(spark, sf_dir):
    # Every host reports its run with each of its events, in every file; the index keeps the run once.
    stream = streams.event_time(arriving_flows(spark, sf_dir, "event_id % 50 = 0"), "flow_start_ts")
    reports = stream.select(F.expr("concat('run', src_host)").alias("run_id"), "flow_start_ts")
    folder = shared_folder(spark, "index")
    streams.append_new_runs(reports, "run_id", "flow_start_ts", folder)
    index = streams.run_index(spark, folder, reports.schema)
    return index.groupBy("run_id").agg(F.count("*").cast("int").alias("copies"))
