import datetime
import os
import subprocess
import sys

from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowbench.plans.flows import table
from flowbench.streaming import streams

SCHEMA = T.StructType().add("host", "string").add("ts", "timestamp").add("prediction", "integer")


def at(minute, hour=0):
    return datetime.datetime(2024, 1, 1, hour, minute, tzinfo=datetime.timezone.utc)


def add_file(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))


def run_append(spark, plan, folder):
    """One pass over what is there now; state and output are kept in the folder between passes."""
    run = (
        plan.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    )
    run.awaitTermination()
    return spark.read.schema(plan.schema).parquet(f"{folder}/out")


def test_late_rows_are_dropped_and_the_open_window_waits(spark, tmp_path):
    source = tmp_path / "in"
    add_file(spark, source, [("a", at(1), 1), ("a", at(2), 0), ("b", at(12), 1)])

    def plan():
        stream = streams.read_stream(spark, str(source), SCHEMA, files_per_batch=1)
        return streams.detections_per_window(stream, "ts", "10 minutes", late="10 minutes")

    first = run_append(spark, plan(), tmp_path)
    assert first.count() == 0  # the watermark is 00:02, no window is closed yet
    add_file(spark, source, [("a", at(40), 1)])
    run_append(spark, plan(), tmp_path)
    add_file(spark, source, [("late", at(3), 1), ("a", at(59), 0)])
    rows = {r["start"].minute: (r["flows"], r["flagged"]) for r in run_append(spark, plan(), tmp_path).collect()}
    # The row at 00:03 came after its window was closed. The watermark is now 00:49, so the windows from 00:40 on
    # are still open.
    assert rows == {0: (2, 1), 10: (1, 1)}


def test_sessions_end_after_a_pause(spark, tmp_path):
    source = tmp_path / "in"
    add_file(spark, source, [("a", at(0), 0), ("a", at(20), 0), ("a", at(55), 0), ("b", at(5), 0)])
    stream = streams.read_stream(spark, str(source), SCHEMA)
    rows = streams.final_state(streams.source_sessions(stream, "ts", "host", "30 minutes")).collect()
    assert sorted((r["host"], r["start"].minute, r["flows"]) for r in rows) == [("a", 0, 2), ("a", 55, 1), ("b", 5, 1)]


def test_a_run_reported_twice_is_kept_once(spark, tmp_path):
    source = tmp_path / "in"
    for minute in (0, 5):
        add_file(spark, source, [("run1", at(minute), 0), ("run2", at(minute), 0)])
    for _ in range(2):
        stream = streams.read_stream(spark, str(source), SCHEMA, files_per_batch=1)
        streams.append_new_runs(stream, "host", "ts", str(tmp_path / "index"))
    kept = streams.run_index(spark, str(tmp_path / "index"), stream.schema)
    assert sorted(r["host"] for r in kept.collect()) == ["run1", "run2"]


RESTARTED = """
import sys
sys.path.insert(0, {root!r})
from flowbench.session import build_session
from flowbench.streaming import streams
spark = build_session("restart", "local[2]", 2, {{"spark.ui.showConsoleProgress": "false"}})
stream = streams.read_stream(spark, {source!r}, {schema!r}, files_per_batch=1)
streams.append_new_runs(stream, "host", "ts", {folder!r})
"""


def test_run_index_outlives_its_process(spark, tmp_path):
    """Another process appends first. After the restart a late repeat, a batch that was never committed and a lost checkpoint change nothing."""
    source, folder = tmp_path / "in", tmp_path / "index"
    noon = lambda day: datetime.datetime(2024, 1, day, 12, tzinfo=datetime.timezone.utc)
    add_file(spark, source, [("run1", noon(1), 0), ("run2", noon(1), 0)])
    text = RESTARTED.format(root=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), source=str(source), folder=str(folder), schema=SCHEMA.simpleString()[7:-1].replace(":", " "))
    subprocess.run([sys.executable, "-c", text], check=True, timeout=120, capture_output=True)
    assert len(streams.committed_batches(spark, str(folder))) >= 1
    stream = lambda: streams.read_stream(spark, str(source), SCHEMA, files_per_batch=1)
    hosts = lambda: sorted(r["host"] for r in streams.run_index(spark, str(folder), stream().schema).collect())
    assert hosts() == ["run1", "run2"]
    # The watermark has long freed the state of the first runs when they are reported again.
    for day, run in ((5, "run3"), (9, "run1"), (14, "run2"), (15, "run4")):
        add_file(spark, source, [(run, noon(day), 0)])
    spark.createDataFrame([("run4", noon(15), 0)], SCHEMA).write.parquet(str(folder / "index" / "half-0"))
    streams.append_new_runs(stream(), "host", "ts", str(folder))
    assert hosts() == ["run1", "run2", "run3", "run4"]
    (folder / "checkpoint").rename(folder / "lost")
    add_file(spark, source, [("run5", noon(16), 0), ("run3", noon(16), 0)])
    streams.append_new_runs(stream(), "host", "ts", str(folder))
    assert hosts() == ["run1", "run2", "run3", "run4", "run5"]


def test_state_of_no_input(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = streams.read_stream(spark, str(tmp_path / "in"), SCHEMA)
    assert streams.final_state(stream.groupBy("host").count()).count() == 0


def test_event_time_of_zoneless_times(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    assert isinstance(events.schema["ts"].dataType, T.TimestampNTZType)
    moved = streams.event_time(events, "ts")
    assert isinstance(moved.schema["ts"].dataType, T.TimestampType)
    zone = spark.conf.get("spark.sql.session.timeZone")
    first = moved.agg(F.unix_micros(F.min("ts"))).first()[0]
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        assert moved.agg(F.unix_micros(F.min("ts"))).first()[0] == first
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
