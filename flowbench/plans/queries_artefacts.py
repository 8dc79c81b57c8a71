"""Written and reloaded tables: every query writes its whole input to the shared folder and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowbench.operators import encode, metrics
from flowbench.operators.learners import FittedLearner, random_forest
from flowbench.plans.catalog import query
from flowbench.plans.flows import flows, runs, table
from flowbench.plans.prep import prepare_split, saved_membership
from flowbench.plans.queries_cleaning import prepared, round_all
from flowbench.plans.queries_learners import FEATURES, LEARNABLE, learnable_parts
from flowbench.plans.queries_metrics import _CLASS_STEPS, _CLASSES, pairs_of
from flowbench.plans.queries_splits import COMMON_SET, EVENTS, ranked_steps
from flowbench.plans.texts import on_flows, on_prepared, on_runs
from flowbench.session import shared_folder
from flowbench.sources import sinks
from flowbench.sources.artefacts import read_records, write_records
from flowbench.sources.tables import load_dataset, read_table
from flowbench.specs import DatasetSpec, SplitSpec

_TEST = "ceil(t * CAST(0.2 AS DOUBLE))"
_PLACED = ranked_steps("prepared", "flow_id", "CAST(label AS VARCHAR)", _TEST)
_PART = "CASE WHEN place <= quota THEN 'test' ELSE 'train' END"


@query("a1_csv_table", "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS price, max(o_orderkey) AS last_key FROM orders GROUP BY 1")
def csv_table(spark, sf_dir):
    folder = shared_folder(spark, "csv")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    orders.write.option("header", True).csv(folder)
    df = read_table(spark, folder, "csv", orders.schema)
    return df.groupBy("o_orderstatus").agg(
        F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("price"), F.max("o_orderkey").alias("last_key")
    )


@query("a4_train_test_pair", on_flows("SELECT 'train' AS part, label, count(*) AS n FROM flows WHERE class <> 'Botnet' GROUP BY 2 UNION ALL SELECT 'test', label, count(*) FROM flows WHERE class <> 'DDoS' GROUP BY 2"))
def train_test_pair(spark, sf_dir):
    folder = shared_folder(spark, "pair")
    df = flows(spark, sf_dir)
    # The two files spell the label differently.
    df.where("class <> 'Botnet'").withColumnRenamed("label", "Attack-Label").drop("class").write.parquet(f"{folder}/train")
    df.where("class <> 'DDoS'").withColumnRenamed("label", "attack_label").drop("class").write.parquet(f"{folder}/test")
    loaded = load_dataset(
        spark, DatasetSpec("pair", label="attack_label", train_path=f"{folder}/train", test_path=f"{folder}/test")
    )
    parts = [
        loaded[p].groupBy(F.lit(p).alias("part"), F.col(loaded["label"]).alias("label")).agg(F.count("*").alias("n"))
        for p in ("train", "test")
    ]
    return parts[0].unionByName(parts[1])


@query("a5_prepared_sink", on_prepared(f"SELECT {_PART} AS part, label, count(*) AS n, round(sum(flow_duration), 6) AS seconds FROM placed GROUP BY 1, 2", **_PLACED))
def prepared_sink(spark, sf_dir):
    root = shared_folder(spark, "prepared")
    split = prepare_split(flows(spark, sf_dir), EVENTS, COMMON_SET, SplitSpec("random_80_20"))
    folder = sinks.write_prepared(split.rows, split.metadata, root, "random_80_20")
    train, test = sinks.read_prepared(spark, folder)
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return both.groupBy("part", "label").agg(F.count("*").alias("n"), F.round(F.sum("flow_duration"), 6).alias("seconds"))


@query(
    "a7_confusion_csv",
    on_flows(
        "SELECT l AS true_label, " + ", ".join(f"CAST(coalesce(sum(CASE WHEN predicted = '{c}' THEN n END), 0) AS BIGINT) AS pred_{c}" for c in _CLASSES) + " FROM (SELECT truth AS l FROM pairs UNION SELECT predicted FROM pairs) LEFT JOIN pairs ON truth = l GROUP BY 1",
        **_CLASS_STEPS,
    ),
)
def confusion_csv(spark, sf_dir):
    folder = shared_folder(spark, "confusion")
    wide = metrics.confusion_table(pairs_of(spark, sf_dir))
    sinks.write_confusion(wide, folder)
    return read_table(spark, folder, "csv", wide.schema)


@query("a8_appended_index", on_runs("SELECT run_id, model_id, accuracy, CASE WHEN status = 'success' THEN f1_macro END AS late_column FROM runs"))
def appended_index(spark, sf_dir):
    folder = shared_folder(spark, "runs")
    df = runs(spark, sf_dir).select("run_id", "model_id", "accuracy", "f1_macro", "status")
    sinks.append_runs(df.where("status = 'failed'").drop("f1_macro", "status"), folder)
    sinks.append_runs(df.where("status = 'success'").withColumnRenamed("f1_macro", "late_column").drop("status"), folder)
    return sinks.read_runs(spark, folder, ["run_id", "model_id", "accuracy"])


@query("a9_final_sink", "SELECT o_orderkey, o_custkey AS used, concat('{\"status\":\"', o_orderstatus, '\"}') AS facts FROM orders")
def final_sink(spark, sf_dir):
    folder = shared_folder(spark, "final")
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("used"), F.struct(F.col("o_orderstatus").alias("status")).alias("facts")
    )
    sinks.write_final(rows, folder)
    as_csv = spark.read.schema("o_orderkey bigint, used bigint, facts string").option("header", True).option("escape", "\\").csv(f"{folder}/csv")
    as_json = spark.read.schema(rows.schema).json(f"{folder}/json").select("o_orderkey", F.col("facts.status").alias("status"))
    same = as_csv.join(as_json, "o_orderkey")
    return same.where(F.get_json_object("facts", "$.status") == F.col("status")).select("o_orderkey", "used", "facts")


@query(
    "a13_saved_preparation",
    on_flows(
        "SELECT flow_id, round((coalesce(x, (SELECT quantile_cont(x, 0.5) FROM fin)) - (SELECT avg(z) FROM filled)) / (SELECT stddev_pop(z) FROM filled), 6) AS flow_bytes_s, CAST(dense_rank() OVER (ORDER BY class) - 1 AS DOUBLE) AS class FROM fin",
        fin="SELECT flow_id, class, CASE WHEN isinf(flow_bytes_s) THEN NULL ELSE flow_bytes_s END AS x FROM flows",
        filled="SELECT coalesce(x, (SELECT quantile_cont(x, 0.5) FROM fin)) AS z FROM fin",
    ),
)
def saved_preparation(spark, sf_dir):
    folder = shared_folder(spark, "preparation")
    df = flows(spark, sf_dir).select("flow_id", "flow_bytes_s", "class")
    encode.Preparation.fit(df, exclude=["flow_id"]).save(spark, folder)
    again = encode.Preparation.load(spark, folder)
    return round_all(again.transform(df, keep=["flow_id"]), ["flow_bytes_s"])


@query("c10_saved_split", on_prepared(f"SELECT flow_id, {_PART} AS part, false AS made_again FROM placed", **_PLACED))
def saved_split(spark, sf_dir):
    folder = shared_folder(spark, "splits")
    df = prepared(spark, sf_dir)
    saved_membership(df, "label", SplitSpec("s1"), folder)
    # The second call finds the saved rows and does not look at its own fraction.
    saved, made = saved_membership(df, "label", SplitSpec("s1", fraction=0.5), folder)
    return saved.select("flow_id", "part", F.lit(made).alias("made_again"))


@query(
    "j20_saved_detector",
    on_flows("SELECT 'random_forest' AS kind, count(*) AS test_rows, CAST(0 AS BIGINT) AS changed, (SELECT count(*) FROM placed WHERE place > quota) AS training_rows FROM placed WHERE place <= quota", **LEARNABLE),
)
def saved_detector(spark, sf_dir):
    folder = shared_folder(spark, "detector")
    train, test = learnable_parts(spark, sf_dir)
    fitted = random_forest().fit(train, FEATURES, "y")
    fitted.save(spark, folder)
    again = FittedLearner.load(spark, folder, "random_forest")
    before = fitted.score(test).select("flow_id", F.col("prediction").alias("before"))
    after = again.score(test).select("flow_id", F.col("prediction").alias("after"))
    rows = before.join(after, "flow_id").agg(
        F.count("*").alias("test_rows"), F.count(F.when(F.col("before") != F.col("after"), 1)).alias("changed")
    )
    return rows.select(
        F.lit(again.kind).alias("kind"), "test_rows", "changed", F.lit(again.facts["training_rows"]).cast("bigint").alias("training_rows")
    )


@query(
    "a10_run_tree",
    "SELECT concat('run ', s_suppkey) AS run, s_acctbal / 10000 AS accuracy, s_suppkey * 3 AS tn, s_nationkey AS fp, s_suppkey % 7 AS tp, CASE WHEN s_nationkey % 2 = 0 THEN s_suppkey END AS threshold_rows, s_nationkey + 1 AS attacks FROM supplier",
)
def run_tree(spark, sf_dir):
    """A record file for every supplier, each in its run's folder, read back as a tree; some lack a field."""
    folder = shared_folder(spark, "run-tree")
    records = table(spark, sf_dir, "supplier").select(
        F.expr("concat('run ', s_suppkey)").alias("run"),
        F.expr("s_acctbal / 10000").alias("accuracy"),
        F.expr("array(array(s_suppkey * 3, CAST(s_nationkey AS BIGINT)), array(0L, s_suppkey % 7))").alias("confusion_matrix"),
        F.expr("CASE WHEN s_nationkey % 2 = 0 THEN s_suppkey END").alias("training_rows"),
        F.expr("map('0', 1L, '1', CAST(s_nationkey + 1 AS BIGINT))").alias("support"),
    )
    write_records(records, folder)
    found = read_records(spark, folder, "metrics.json", "part-*")
    return found.select(
        "run", "accuracy", F.expr("confusion_matrix[0][0]").alias("tn"), F.expr("confusion_matrix[0][1]").alias("fp"), F.expr("confusion_matrix[1][1]").alias("tp"),
        F.col("training_rows").alias("threshold_rows"), F.expr("support['1']").alias("attacks"),
    )
