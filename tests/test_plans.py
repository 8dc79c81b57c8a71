"""Plan shapes that have to hold for big tables."""

import re

import pytest
from pyspark.sql import functions as F

from flowbench.operators import encode, metrics, profile, rules, splits
from flowbench.plans import results
from flowbench.plans.flows import flows, runs, table
from flowbench.plans.queries_cleaning import COMMON, prepared
from flowbench.session import BROADCAST_ROWS, settled


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scans(df):
    return len(re.findall(r"FileScan", plan_of(df)))


PYTHON = re.compile(r"Python|Pandas|Arrow")


def test_profile_reads_the_table_once_per_part(spark, sf_dir):
    df = flows(spark, sf_dir)
    assert scans(profile.table_shape(df, "label")) == 1
    assert scans(profile.group_label_counts(df, "label", ["class", "dataset_source"])) == 1
    assert scans(profile.time_range(df, "label", ["flow_start_ts"])) == 1
    assert scans(profile.column_quality(df, "label")) == 1


def test_no_python_on_the_way(spark, sf_dir):
    df = prepared(spark, sf_dir)
    for plan in (
        rules.with_rules(flows(spark, sf_dir)),
        splits.random_parts(df, ["flow_id"], 0.2, 42, "label"),
        metrics.binary_metrics(metrics.confusion(df.withColumn("p", F.lit(1)), "label", "p")),
        metrics.roc_auc(df, "label", "flow_bytes_s"),
        metrics.threshold_counts(df.withColumn("p", F.lit(0.5)), "label", "p"),
        encode.anova_f(df, COMMON, "label"),
        results.latest_runs(runs(spark, sf_dir)),
    ):
        assert not PYTHON.search(plan_of(plan))


def test_applying_a_split_does_not_shuffle(spark, sf_dir):
    plan = plan_of(splits.random_parts(prepared(spark, sf_dir), ["flow_id"], 0.2, 42, "label"))
    assert "Exchange hashpartitioning" not in plan and "SinglePartition" not in plan and "Window" not in plan


def test_rules_are_one_narrow_stage(spark, sf_dir):
    assert "Exchange" not in plan_of(rules.with_rules(flows(spark, sf_dir)))


def test_columns_are_pruned(spark, sf_dir):
    plan = plan_of(profile.value_counts(table(spark, sf_dir, "events"), "event_type"))
    assert "ReadSchema: struct<event_type:string>" in plan
    plan = plan_of(table(spark, sf_dir, "events").where("event_id = 3").select("value"))
    assert "EqualTo(event_id,3)" in plan


def test_one_task_sees_ranges_not_rows(spark, sf_dir):
    """Every single-partition step sits above an aggregate over the score ranges or bins."""
    plan = plan_of(metrics.roc_auc(prepared(spark, sf_dir), "label", "flow_bytes_s"))
    below = plan.split("SinglePartition", 1)[1].lstrip()
    assert "HashAggregate(keys=[_range" in below.split("\n", 2)[1]


def test_small_tables_are_sent_and_large_ones_are_not(spark, tmp_path):
    small, n = settled(spark.range(10).toDF("a"))
    assert n == 10 and "LocalTableScan" in plan_of(small)
    large, m = settled(spark.range(50).toDF("a"), max_rows=20)
    assert m == 50 and "LocalTableScan" not in plan_of(large) and large.count() == 50
    assert BROADCAST_ROWS <= 100_000


def test_a_split_with_many_strata_does_not_broadcast(spark, monkeypatch):
    """Beyond the broadcast bound the cuts are checkpointed and joined by shuffle: same rows."""
    df = spark.range(2000).select(F.col("id").alias("k"), (F.col("id") % 40).alias("g"))
    expected = {r["k"] for r in splits.random_parts(df, ["k"], 0.25, 1, "g").where("part = 'test'").collect()}

    def tiny(frame, max_rows=5):
        return settled(frame, 5)

    monkeypatch.setattr(splits, "settled", tiny)
    monkeypatch.setattr(splits, "settle", lambda frame: tiny(frame)[0])
    monkeypatch.setattr(splits, "BROADCAST_ROWS", 5)
    parts = splits.random_parts(df, ["k"], 0.25, 1, "g")
    assert {r["k"] for r in parts.where("part = 'test'").collect()} == expected
    assert parts.count() == 2000


@pytest.mark.parametrize("n", [3, 40])
def test_wide_profile_is_cut_into_blocks(spark, n):
    wide = spark.range(5).select(*[F.col("id").cast("double").alias(f"c{i}") for i in range(n)])
    quality = profile.column_quality(wide, per_aggregate=16)
    assert quality.count() == n
