"""Run index, joins over run records, figure tables and transfer matrices."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowbench.functions.names import flatten
from flowbench.functions.values import or_token
from flowbench.plans import results
from flowbench.plans.catalog import query
from flowbench.plans.flows import RUNS_SQL, runs, table
from flowbench.plans.texts import chain, on_runs
from flowbench.session import settle
from flowbench.sources.sinks import csv_ready, union_runs

# The four train/test directions of the transfer matrix.
DIRECTIONS = {
    "matrix_cic_train_cic_test": "cic_to_cic",
    "matrix_cic_train_botnet_test": "cic_to_botnet",
    "matrix_botnet_train_botnet_test": "botnet_to_botnet",
    "matrix_botnet_train_cic_test": "botnet_to_cic",
}
NATIVE, EXTERNAL = "matrix_cic_train_cic_test", "matrix_cic_train_botnet_test"

_LATEST = "SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY model_id, dataset_id ORDER BY run_id DESC) AS r FROM {0}) WHERE r = 1"


@query("f1_latest_runs", on_runs(_LATEST.format("runs")))
def newest_runs(spark, sf_dir):
    return results.latest_runs(runs(spark, sf_dir))


@query("f2_latest_successful_runs", on_runs(_LATEST.format("good"), good="SELECT * FROM runs WHERE lower(status) = 'success'"))
def newest_successful_runs(spark, sf_dir):
    return results.latest_runs(results.successful(runs(spark, sf_dir)))


_ARTEFACTS = "SELECT model_id, CAST(40 + duration_seconds % 3 AS BIGINT) AS seed, dataset_id AS split_id, concat('models/', run_id) AS path, duration_seconds AS modified FROM {0}"


@query("f3_newest_artefact", on_runs("SELECT path FROM artefacts WHERE model_id = 'model03' AND seed = 40 AND split_id = 'matrix_cic_train_cic_test' ORDER BY modified DESC, path DESC LIMIT 1", artefacts=_ARTEFACTS.format("runs")))
def latest_artefact(spark, sf_dir):
    artefacts = spark.sql(_ARTEFACTS.format("{r}"), r=runs(spark, sf_dir))
    return results.newest_artefact(artefacts, "model03", 40, "matrix_cic_train_cic_test")


@query("b25_filtered_runs", on_runs("SELECT * FROM runs WHERE lower(status) = 'success' AND dataset_id IN ('matrix_cic_train_cic_test', 'matrix_cic_train_botnet_test') AND model_id <> 'model00' AND f1_macro IS NOT NULL"))
def filtered_runs(spark, sf_dir):
    df = results.successful(runs(spark, sf_dir))
    return df.where(F.col("dataset_id").isin(NATIVE, EXTERNAL) & (F.col("model_id") != "model00") & F.col("f1_macro").isNotNull())


@query("b26_compact_metrics", on_runs("SELECT " + ", ".join(f"{k}" if k in ("run_id", "model_id", "dataset_id", "status", "accuracy", "f1_macro", "duration_seconds") else f"CAST(NULL AS {'VARCHAR' if v == 'string' else v.upper()}) AS {k}" for k, v in results.COMPACT_KEYS.items()) + " FROM runs"))
def compact_records(spark, sf_dir):
    return results.compact_metrics(runs(spark, sf_dir).withColumn("extra", F.lit(1)))


@query("k11_unfinished_runs", on_runs("SELECT run_id, model_id, status, error, accuracy FROM (SELECT run_id, model_id, 'blocked' AS status, 'no data' AS error, CAST(NULL AS DOUBLE) AS accuracy FROM runs WHERE status = 'failed')"))
def rows_of_unfinished_runs(spark, sf_dir):
    work = runs(spark, sf_dir).where("status = 'failed'").select("run_id", "model_id", "dataset_id")
    return results.unfinished_runs(work, "blocked", "no data").select("run_id", "model_id", "status", "error", "accuracy")


@query("a8_grown_index", on_runs("SELECT run_id, model_id, accuracy, NULL AS roc_auc FROM runs WHERE status = 'failed' UNION ALL SELECT run_id, model_id, NULL, f1_macro FROM runs WHERE status = 'success'"))
def grown_index(spark, sf_dir):
    df = runs(spark, sf_dir)
    old = df.where("status = 'failed'").select("run_id", "model_id", "accuracy")
    new = df.where("status = 'success'").select("run_id", "model_id", F.col("f1_macro").alias("roc_auc"))
    return union_runs(old, new)


@query("a9_csv_ready", "SELECT o_orderkey, concat('{\"status\":\"', o_orderstatus, '\",\"key\":', o_custkey, '}') AS facts, concat('[', o_custkey, ',', o_orderkey % 10, ']') AS pair FROM orders")
def nested_as_text(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.struct(F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("key")).alias("facts"),
        F.array(F.col("o_custkey"), F.expr("o_orderkey % 10")).alias("pair"),
    )
    return csv_ready(df)


@query("a11_flattened_records", 'SELECT run_id AS "id", status AS "run.status", accuracy AS "run.scores.accuracy", f1_macro AS "run.scores.f1_macro" FROM (' + RUNS_SQL + ")")
def flattened_records(spark, sf_dir):
    nested = runs(spark, sf_dir).select(
        F.col("run_id").alias("id"),
        F.struct("status", F.struct("accuracy", "f1_macro").alias("scores")).alias("run"),
    )
    return flatten(nested)


@query("b22_first_filled", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey WHEN o_orderkey % 2 = 0 THEN 0 ELSE -1 END AS zero_counts, CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 THEN o_custkey ELSE 7 END AS filled_map FROM orders")
def chains_of_fallbacks(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    # A zero is a value in the first chain; an empty map is none in the second.
    first = F.coalesce(F.expr("CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END"), F.expr("CASE WHEN o_orderkey % 2 = 0 THEN 0L END"), F.lit(-1))
    maps = [
        F.expr("CASE WHEN o_orderkey % 3 = 0 THEN CAST(map() AS map<string,bigint>) WHEN o_orderkey % 5 <> 0 THEN map('n', o_custkey) END"),
        F.expr("map('n', 7L)"),
    ]
    return df.select("o_orderkey", first.alias("zero_counts"), F.try_element_at(results.first_filled(*maps), F.lit("n")).alias("filled_map"))


# --- registry and manifest joins -----------------------------------------------------------------------------------


@query("d2_named_runs", on_runs("SELECT run_id, CASE WHEN n_nationkey < 9 THEN n_name ELSE 'unknown' END AS model_name FROM runs LEFT JOIN nation ON n_nationkey = CAST(substr(model_id, 6) AS BIGINT)"))
def named_runs(spark, sf_dir):
    models = table(spark, sf_dir, "nation").select(
        F.format_string("model%02d", F.col("n_nationkey")).alias("model_id"), F.expr("CASE WHEN n_nationkey < 9 THEN n_name END").alias("name")
    )
    joined = runs(spark, sf_dir).join(settle(models), "model_id", "left")
    return joined.select("run_id", or_token("name", "unknown").alias("model_name"))


@query("d8_work_list", on_runs("SELECT DISTINCT m.model_id, d.dataset_id FROM (SELECT DISTINCT model_id FROM runs) m, (SELECT unnest(['matrix_cic_train_cic_test', 'matrix_botnet_train_cic_test', 'new_set']) AS dataset_id) d WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.model_id = m.model_id AND r.dataset_id = d.dataset_id AND r.status = 'success' AND r.accuracy > 0.5)"))
def open_work(spark, sf_dir):
    df = runs(spark, sf_dir)
    sets = ["matrix_cic_train_cic_test", "matrix_botnet_train_cic_test", "new_set"]
    return results.work_list(df, sets, df.where("accuracy > 0.5"))


_ORDERED = ("model07", "model03", "model99", "model00")


@query("d5_listed_models", on_runs("SELECT CAST(pos AS INTEGER) AS pos, m AS model_id, n FROM (VALUES (0, 'model07'), (1, 'model03'), (2, 'model99'), (3, 'model00')) v(pos, m) LEFT JOIN (SELECT model_id, count(*) AS n FROM runs GROUP BY 1) r ON r.model_id = m"))
def listed_models(spark, sf_dir):
    counts = runs(spark, sf_dir).groupBy("model_id").agg(F.count("*").alias("n"))
    return results.reindex(counts, "model_id", _ORDERED).select("pos", "model_id", "n")


@query("g1_sorted_runs", on_runs("SELECT run_id, CASE WHEN status = 'failed' THEN NULL ELSE f1_macro END AS f1_macro FROM runs ORDER BY 2 DESC NULLS LAST"))
def sorted_runs(spark, sf_dir):
    df = runs(spark, sf_dir).select("run_id", F.expr("CASE WHEN status = 'failed' THEN NULL ELSE f1_macro END").alias("f1_macro"))
    return df.orderBy(F.desc_nulls_last("f1_macro"))


@query("g2_experiment_order", "SELECT DISTINCT concat('exp', o_custkey % 7) AS experiment_id, CASE WHEN o_custkey % 7 < 4 THEN CAST(9 - o_custkey % 7 AS BIGINT) END AS experiment_order FROM orders ORDER BY coalesce(experiment_order, 999), experiment_id")
def ordered_experiments(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select(
        F.expr("concat('exp', o_custkey % 7)").alias("experiment_id"),
        F.expr("CASE WHEN o_custkey % 7 < 4 THEN 9 - o_custkey % 7 END").alias("experiment_order"),
    )
    return results.by_experiment_order(df.distinct())


# --- figure tables -------------------------------------------------------------------------------------------------

# Result rows: the latest run of each model and direction stands for one (experiment, model) result.
_RESULTS = f"""SELECT model_id AS model, dataset_id AS experiment_id, accuracy, f1_macro AS f1, CASE WHEN status = 'failed' THEN NULL ELSE duration_seconds * 37 END AS training_seconds,
  CAST(duration_seconds AS BIGINT) % 500 AS tn, CAST(duration_seconds AS BIGINT) % 40 AS fp, CAST(duration_seconds AS BIGINT) % 30 AS fn, CAST(duration_seconds AS BIGINT) % 300 AS tp
  FROM {{latest}} WHERE NOT (model_id IN ('model05', 'model06') AND dataset_id = '{EXTERNAL}')"""
_RESULT_STEPS = {"latest": _LATEST.format("runs"), "results": _RESULTS.format(latest="latest")}
MODELS = [f"model{i:02d}" for i in (3, 1, 2, 5, 6, 7, 0)]


def result_rows(spark, sf_dir):
    return spark.sql(_RESULTS.format(latest="{l}"), l=results.latest_runs(runs(spark, sf_dir)))


_LISTED = "('model03','model01','model02','model05','model06','model07','model00')"


@query(
    "k3_metric_pivot",
    on_runs(
        f"SELECT model, max(CASE WHEN experiment_id = '{NATIVE}' THEN f1 END) AS {NATIVE}, max(CASE WHEN experiment_id = '{EXTERNAL}' THEN f1 END) AS {EXTERNAL} FROM results WHERE model IN {_LISTED} AND model <> 'model00' AND experiment_id IN ('{NATIVE}', '{EXTERNAL}') GROUP BY 1",
        **_RESULT_STEPS,
    ),
)
def pivot_of_metric(spark, sf_dir):
    return results.metric_pivot(result_rows(spark, sf_dir), "f1", [NATIVE, EXTERNAL], MODELS, baseline="model00")


@query(
    "k4_feature_sets",
    on_runs(
        f"SELECT model, max(CASE WHEN experiment_id = '{NATIVE}' THEN f1 END) AS common, max(CASE WHEN experiment_id = '{EXTERNAL}' THEN f1 END) AS \"full\" FROM results WHERE model IN {_LISTED} AND model <> 'model00' AND experiment_id IN ('{NATIVE}', '{EXTERNAL}') GROUP BY 1 HAVING count(DISTINCT experiment_id) = 2",
        **_RESULT_STEPS,
    ),
)
def compared_feature_sets(spark, sf_dir):
    return results.feature_set_comparison(result_rows(spark, sf_dir), (NATIVE, EXTERNAL), ("common", "full"), MODELS, baseline="model00")


@query("e18_models_with_both", on_runs(f"SELECT model_id FROM runs WHERE dataset_id IN ('{NATIVE}', '{EXTERNAL}') AND accuracy > 0.55 GROUP BY 1 HAVING count(DISTINCT dataset_id) = 2"))
def models_with_both(spark, sf_dir):
    df = runs(spark, sf_dir).where(F.col("dataset_id").isin(NATIVE, EXTERNAL) & (F.col("accuracy") > 0.55))
    return df.groupBy("model_id").agg(F.count_distinct("dataset_id").alias("k")).where("k = 2").select("model_id")


@query(
    "k5_training_times",
    on_runs(
        f"SELECT model, training_seconds, CASE WHEN s >= 3600 THEN concat(s // 3600, 'h ', (s % 3600) // 60, 'm') WHEN s >= 60 THEN concat(s // 60, 'm ', s % 60, 's') ELSE concat(s, 's') END AS training_text FROM (SELECT *, CAST(floor(training_seconds) AS BIGINT) AS s FROM results) WHERE experiment_id = '{NATIVE}' AND model IN {_LISTED} AND model <> 'model00' AND training_seconds IS NOT NULL",
        **_RESULT_STEPS,
    ),
)
def times_of_training(spark, sf_dir):
    return results.training_times(result_rows(spark, sf_dir), NATIVE, MODELS, baseline="model00")


@query("k6_detected_attacks", on_runs(f"SELECT model, tp FROM results WHERE experiment_id = '{EXTERNAL}' AND model IN {_LISTED}", **_RESULT_STEPS))
def attacks_detected(spark, sf_dir):
    return results.detected_attacks(result_rows(spark, sf_dir), EXTERNAL, MODELS)


@query(
    "k7_confusion_cells",
    on_runs(
        " UNION ALL ".join(
            f"SELECT '{a}' AS actual, '{p}' AS predicted, '{n}' AS name, {c} AS n FROM results WHERE experiment_id = '{NATIVE}' AND model = 'model03'"
            for a, p, n, c in (("benign", "benign", "true negatives", "tn"), ("benign", "malicious", "false positives", "fp"), ("malicious", "benign", "false negatives", "fn"), ("malicious", "malicious", "true positives", "tp"))
        ),
        **_RESULT_STEPS,
    ),
)
def cells_of_confusion(spark, sf_dir):
    return results.confusion_long(result_rows(spark, sf_dir), NATIVE, "model03")


# --- transfer ------------------------------------------------------------------------------------------------------

_DIRECTION = "CASE dataset_id " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in DIRECTIONS.items()) + " END"
_IN = "(" + ", ".join(f"'{d}'" for d in DIRECTIONS) + ")"


@query("e17_status_counts", on_runs(f"SELECT {_DIRECTION} AS direction, status, count(*) AS n FROM latest GROUP BY 1, 2", latest=_LATEST.format("runs")))
def counts_of_status(spark, sf_dir):
    return results.status_counts(runs(spark, sf_dir), DIRECTIONS)


def _best(dataset: str, column: str) -> str:
    return f"max(CASE WHEN dataset_id = '{dataset}' THEN {column} END)"


@query(
    "k8_transfer_table",
    on_runs(
        "SELECT model_id, na AS native_accuracy, ea AS external_accuracy, na - ea AS accuracy_drop, nf AS native_f1_macro, ef AS external_f1_macro, nf - ef AS f1_macro_drop "
        f"FROM (SELECT model_id, {_best(NATIVE, 'accuracy')} AS na, {_best(EXTERNAL, 'accuracy')} AS ea, {_best(NATIVE, 'f1_macro')} AS nf, {_best(EXTERNAL, 'f1_macro')} AS ef FROM recorded GROUP BY 1)",
        good=f"SELECT * FROM runs WHERE status = 'success' AND dataset_id IN ('{NATIVE}', '{EXTERNAL}')",
        latest=_LATEST.format("good"),
        recorded="SELECT * REPLACE (CASE WHEN CAST(right(run_id, 1) AS INTEGER) < 5 THEN accuracy / 2 ELSE accuracy END AS accuracy) FROM latest",
    ),
)
def transfers(spark, sf_dir):
    df = runs(spark, sf_dir)
    # Half of the runs have a saved record with another accuracy than the index; the record wins.
    saved = df.where("CAST(right(run_id, 1) AS INT) < 5").select("run_id", (F.col("accuracy") / 2).alias("accuracy"), "f1_macro")
    return results.transfer_table(df, NATIVE, EXTERNAL, saved)


@query(
    "k8_transfer_without_external",
    on_runs(
        f"SELECT model_id, {_best(NATIVE, 'accuracy')} AS native_accuracy, CAST(NULL AS DOUBLE) AS external_accuracy, CAST(NULL AS DOUBLE) AS accuracy_drop FROM latest WHERE dataset_id = '{NATIVE}' GROUP BY 1",
        good="SELECT * FROM runs WHERE status = 'success'",
        latest=_LATEST.format("good"),
    ),
)
def transfer_without_external(spark, sf_dir):
    out = results.transfer_table(runs(spark, sf_dir), NATIVE, "a set nobody ran")
    return out.select("model_id", "native_accuracy", "external_accuracy", "accuracy_drop")


_METRICS = ("status", "accuracy", "f1_macro", "duration_seconds")
_DROPS = {
    "accuracy_drop_original_to_other": ("accuracy", "cic_to_cic", "cic_to_botnet"),
    "f1_drop_original_to_other": ("f1_macro", "cic_to_cic", "cic_to_botnet"),
    "accuracy_drop_other_to_original": ("accuracy", "botnet_to_botnet", "botnet_to_cic"),
    "f1_drop_other_to_original": ("f1_macro", "botnet_to_botnet", "botnet_to_cic"),
}
_WIDE = "SELECT model_id, " + ", ".join(f"{_best(d, m)} AS {m}_{s}" for m in _METRICS for d, s in DIRECTIONS.items()) + " FROM latest GROUP BY 1"


@query(
    "k9_direction_matrix",
    on_runs(
        "SELECT *, " + ", ".join(f"{m}_{a} - {m}_{b} AS {n}" for n, (m, a, b) in _DROPS.items()) + " FROM wide",
        latest=_LATEST.format("runs"),
        wide=_WIDE,
    ),
)
def matrix_of_directions(spark, sf_dir):
    return results.direction_matrix(runs(spark, sf_dir), DIRECTIONS, _METRICS, _DROPS, "f1_macro_cic_to_botnet")


_F1_DROPS = {"f1_drop_cic_to_botnet": ("cic_to_cic", "cic_to_botnet"), "f1_drop_botnet_to_cic": ("botnet_to_botnet", "botnet_to_cic")}


@query(
    "k10_compact_matrix",
    on_runs(
        "SELECT model_id, " + ", ".join(f"{_best(d, 'status')} AS status_{s}, round_even({_best(d, 'accuracy')}, 4) AS acc_{s}, round_even({_best(d, 'f1_macro')}, 4) AS f1_{s}" for d, s in DIRECTIONS.items())
        + ", " + ", ".join(f"round_even({_best(A, 'f1_macro')} - {_best(B, 'f1_macro')}, 4) AS {n}" for n, A, B in (
            ("f1_drop_cic_to_botnet", "matrix_cic_train_cic_test", "matrix_cic_train_botnet_test"),
            ("f1_drop_botnet_to_cic", "matrix_botnet_train_botnet_test", "matrix_botnet_train_cic_test"),
        )) + " FROM latest GROUP BY 1",
        latest=_LATEST.format("runs"),
    ),
)
def matrix_in_brief(spark, sf_dir):
    return results.compact_matrix(runs(spark, sf_dir), DIRECTIONS, _F1_DROPS, "f1_cic_to_botnet")


# --- final results -------------------------------------------------------------------------------------------------

# Flat run records. Evaluation runs come from orders, training runs from customers, split records from nations and
# the model registry from regions. Many fields are null, and records named lost are not referred to, so that each fall-back
# is taken somewhere.
_EVALS = """SELECT concat('eval-', o_orderkey) AS run, o_orderkey AS k, concat('exp', o_custkey % 5) AS experiment_id, concat('model', o_custkey % 12) AS model,
  concat('split-', o_orderkey % 25) AS split_id, concat('set', o_orderkey % 3) AS dataset_id,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE concat('runs/train-', o_custkey, '/model.bin') END AS model_path,
  CASE WHEN o_orderkey % 3 = 0 THEN concat('split-', o_custkey % 25) END AS source_split,
  CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice END AS i_eval_s, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice / 2 END AS m_eval_s,
  CASE WHEN o_orderkey % 5 = 0 THEN o_custkey END AS own_train_s,
  CASE WHEN o_orderkey % 6 = 0 THEN concat('split-', o_orderkey % 10) END AS m_split,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderkey % 1000 END AS tn, o_orderkey % 97 AS fp, o_orderkey % 89 AS fn, o_orderkey % 83 AS tp,
  o_totalprice / 1000000 AS f1, CASE WHEN o_orderkey % 13 = 0 THEN o_orderkey % 5000 END AS m_rows, CASE WHEN o_orderkey % 17 = 0 THEN 5 END AS m_epochs
FROM {orders}"""
_TRAINS = """SELECT concat(CASE WHEN c_custkey % 6 = 5 THEN 'lost-' ELSE 'train-' END, c_custkey) AS run, c_custkey AS k, CASE WHEN c_custkey % 3 = 1 THEN concat('split-', c_custkey % 25) END AS split_id,
  concat('set', c_custkey % 4) AS dataset_id, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_acctbal END AS train_s,
  CASE WHEN c_custkey % 2 = 0 THEN c_custkey * 10 END AS full_rows, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey * 8 END AS used_rows,
  CASE WHEN c_custkey % 9 = 0 THEN c_custkey END AS row_cap, 10 AS epochs
FROM {customer}"""
_SPLITS = "SELECT concat(CASE WHEN n_nationkey < 20 THEN 'split-' ELSE 'lost-' END, n_nationkey) AS split_id, concat('set', n_regionkey) AS dataset_id, n_nationkey * 100 AS train_rows, n_nationkey * 25 AS test_rows FROM {nation}"


def record_tables(spark, sf_dir):
    """Manifest, run_info, metrics, summaries, splits and models in the shapes that saved records have."""
    evals = spark.sql(_EVALS, orders=table(spark, sf_dir, "orders"))
    trains = spark.sql(_TRAINS, customer=table(spark, sf_dir, "customer"))
    splits = spark.sql(_SPLITS, nation=table(spark, sf_dir, "nation"))
    none = lambda kind: F.lit(None).cast(kind)
    manifest = evals.select(
        "experiment_id",
        F.concat(F.lit("Experiment "), "experiment_id").alias("experiment_name"),
        F.expr("CASE WHEN experiment_id <> 'exp4' THEN 5 - CAST(right(experiment_id, 1) AS INT) END").cast("bigint").alias("experiment_order"),
        none("string").alias("evaluation_split_id"),
        F.lit("common").alias("feature_set_id"),
        "model",
        "run",
    )
    info = evals.select(
        "run", "split_id", "dataset_id", F.lit("common").alias("feature_set_id"), F.col("model").alias("model_id"),
        F.lit("unnamed").alias("model_name"), "model_path", F.lit(42).cast("bigint").alias("seed"),
        F.col("source_split").alias("source_training_split_id"), none("bigint").alias("train_row_cap"),
        none("array<string>").alias("feature_columns"), F.col("own_train_s").cast("double").alias("training_seconds"),
        F.col("i_eval_s").alias("evaluation_seconds"),
    ).unionByName(
        trains.select("run", "split_id", "dataset_id", F.col("train_s").cast("double").alias("training_seconds")),
        allowMissingColumns=True,
    )
    counts = "map<string,bigint>"
    metrics = evals.select(
        "run", F.col("m_split").alias("training_split_id"),
        *[(F.col("f1") * w).alias(n) for n, w in (("accuracy", 1.1), ("balanced_accuracy", 1.05), ("precision", 0.9), ("recall", 0.8), ("f1", 1.0), ("f1_macro", 0.7), ("f1_weighted", 0.75))],
        F.expr("CASE WHEN tn IS NOT NULL THEN array(array(tn, fp), array(fn, tp)) END").alias("confusion_matrix"),
        F.expr("CASE WHEN k % 3 = 0 THEN map('0', tn + fp, '1', fn + tp) WHEN k % 3 = 1 THEN CAST(map() AS map<string,bigint>) END").alias("support"),
        F.expr("CASE WHEN k % 10 = 0 THEN map('0', k, '1', k + 1) END").alias("training_label_counts"),
        none(counts).alias("training_sample_label_counts"), none(counts).alias("evaluation_label_counts"),
        F.expr("CASE WHEN k % 2 = 0 THEN array('a', 'b') ELSE CAST(array() AS array<string>) END").alias("feature_columns"),
        none("bigint").alias("full_training_rows"), F.col("m_rows").alias("training_rows"), none("bigint").alias("training_sample_rows"),
        none("bigint").alias("train_row_cap"), F.expr("CASE WHEN k % 8 = 0 THEN k END").alias("evaluation_rows"), F.col("m_eval_s").alias("evaluation_seconds"),
        F.col("m_epochs").cast("bigint").alias("epochs"), none("bigint").alias("batch_size"), none("double").alias("learning_rate"),
        F.expr("CASE WHEN k % 4 = 1 THEN 0.4D END").alias("threshold"), F.expr("CASE WHEN k % 4 = 1 THEN true END").alias("threshold_tuned"),
        none("boolean").alias("use_class_weight"), none("map<string,string>").alias("architecture"), none("map<string,string>").alias("params"),
    )
    summaries = trains.select(
        "run", "split_id", F.expr("CASE WHEN k % 4 = 0 THEN CAST(map() AS map<string,bigint>) WHEN k % 4 = 1 THEN map('0', k, '1', 2 * k) END").alias("training_label_counts"),
        F.expr("CASE WHEN k % 4 = 0 THEN map('0', 3 * k) END").alias("sampled_label_counts"),
        none(counts).alias("training_sample_label_counts"), none(counts).alias("label_counts"),
        F.expr("array('x', 'y', 'z')").alias("feature_columns"), F.col("full_rows").alias("full_training_rows"), F.col("used_rows").alias("training_rows"),
        none("bigint").alias("sampled_training_rows"), none("bigint").alias("training_sample_rows"), F.col("row_cap").alias("train_row_cap"),
        F.col("epochs").cast("bigint").alias("epochs"), F.lit(4096).cast("bigint").alias("batch_size"), F.lit(0.001).alias("learning_rate"), F.lit(0.5).alias("threshold"),
        F.lit(False).alias("threshold_tuned"), F.expr("k % 2 = 0").alias("use_class_weight"),
        F.expr("CASE WHEN k % 2 = 0 THEN map('hidden', '64') ELSE CAST(map() AS map<string,string>) END").alias("architecture"), F.expr("map('trees', CAST(k AS STRING))").alias("params"),
    )
    split_records = splits.select(
        "split_id", "dataset_id", F.struct(F.lit("random").alias("type")).alias("split_method"), "train_rows", "test_rows",
        F.expr("map('0', train_rows - 1, '1', 1L)").alias("train_label_distribution"),
        F.expr("map('0', test_rows - 1, '1', 1L)").alias("test_label_distribution"),
    )
    models = table(spark, sf_dir, "region").select(F.expr("concat('model', r_regionkey)").alias("model_id"), F.col("r_name").alias("name"))
    return manifest, info, metrics, summaries, split_records, models


_FINAL = """
SELECT e.experiment_id, concat('Experiment ', e.experiment_id) AS experiment_name, CASE WHEN e.experiment_id <> 'exp4' THEN CAST(5 - CAST(right(e.experiment_id, 1) AS INTEGER) AS BIGINT) END AS experiment_order,
  e.model, coalesce(r_name, 'unnamed') AS model_name, CAST(42 AS BIGINT) AS seed, e.trained_on AS trained_on_split, coalesce(ta.dataset_id, CASE WHEN t.run IS NULL THEN e.dataset_id ELSE t.dataset_id END) AS trained_on_dataset,
  e.split_id AS evaluated_on_split, e.dataset_id AS evaluated_on_dataset, 'common' AS feature_set, CASE WHEN tb.split_id IS NULL THEN '' ELSE 'random' END AS split_method,
  coalesce(t.full_rows, ta.train_rows) AS full_training_rows, coalesce(t.used_rows, e.m_rows) AS training_rows_used,
  CASE WHEN t.k % 4 = 0 THEN 3 * t.k WHEN t.k % 4 = 1 THEN t.k WHEN e.k % 10 = 0 THEN e.k END AS training_label_0,
  CASE WHEN t.k % 4 = 0 THEN NULL WHEN t.k % 4 = 1 THEN 2 * t.k WHEN e.k % 10 = 0 THEN e.k + 1 END AS training_label_1,
  CASE WHEN e.k % 8 = 0 THEN e.k ELSE tb.test_rows END AS evaluation_rows,
  CASE WHEN e.k % 3 = 0 THEN e.tn + e.fp ELSE tb.test_rows - 1 END AS evaluation_label_0, CASE WHEN e.k % 3 = 0 THEN e.fn + e.tp WHEN tb.split_id IS NOT NULL THEN 1 END AS evaluation_label_1,
  CASE WHEN e.k % 2 = 0 THEN 2 WHEN t.run IS NOT NULL THEN 3 ELSE 0 END AS num_features,
  CASE WHEN e.k % 2 = 0 THEN '["a","b"]' WHEN t.run IS NOT NULL THEN '["x","y","z"]' ELSE '[]' END AS feature_columns,
  f1 * CAST(1.1 AS DOUBLE) AS accuracy, f1, f1 * CAST(0.75 AS DOUBLE) AS f1_weighted,
  e.tn, CASE WHEN e.tn IS NOT NULL THEN e.fp END AS fp, CASE WHEN e.tn IS NOT NULL THEN e.fn END AS fn, CASE WHEN e.tn IS NOT NULL THEN e.tp END AS tp,
  CASE WHEN t.row_cap IS NOT NULL THEN t.row_cap WHEN coalesce(t.used_rows, e.m_rows) < coalesce(t.full_rows, ta.train_rows) THEN coalesce(t.used_rows, e.m_rows) END AS train_row_cap,
  CAST(coalesce(e.m_epochs, t.epochs) AS BIGINT) AS epochs, CASE WHEN t.run IS NOT NULL THEN CAST(4096 AS BIGINT) END AS batch_size,
  CASE WHEN e.k % 4 = 1 THEN 0.4::DOUBLE WHEN t.run IS NOT NULL THEN 0.5::DOUBLE END AS threshold, e.k % 4 = 1 AS threshold_tuned, coalesce(t.k % 2 = 0, false) AS use_class_weight,
  CASE WHEN t.run IS NULL THEN CAST(e.own_train_s AS DOUBLE) ELSE t.train_s END AS training_seconds, coalesce(e.i_eval_s, e.m_eval_s) AS evaluation_seconds,
  CASE WHEN t.run IS NULL THEN CAST(e.own_train_s AS DOUBLE) ELSE t.train_s END + coalesce(e.i_eval_s, e.m_eval_s) AS total_seconds,
  CASE WHEN t.run IS NULL THEN '{}' WHEN t.k % 2 = 0 THEN '{"hidden":"64"}' ELSE concat('{"trees":"', t.k, '"}') END AS model_configuration,
  coalesce(t.run, e.run) AS training_run, e.run AS evaluation_run
FROM (SELECT e.*, t0.run AS trun, coalesce(m_split, t0.split_id, source_split, CASE WHEN t0.run IS NULL THEN e.split_id END, '') AS trained_on
      FROM evals e LEFT JOIN trains t0 ON t0.run = split_part(e.model_path, '/', 2)) e
LEFT JOIN trains t ON t.run = e.trun LEFT JOIN splits ta ON ta.split_id = e.trained_on LEFT JOIN splits tb ON tb.split_id = e.split_id
LEFT JOIN region ON e.model = concat('model', r_regionkey)"""

_RECORD_STEPS = {"evals": _EVALS.format(orders="orders"), "trains": _TRAINS.format(customer="customer"), "splits": _SPLITS.format(nation="nation")}
_FINAL_COLUMNS = (
    "experiment_id experiment_name experiment_order model model_name seed trained_on_split trained_on_dataset evaluated_on_split evaluated_on_dataset feature_set split_method "
    "full_training_rows training_rows_used training_label_0 training_label_1 evaluation_rows evaluation_label_0 evaluation_label_1 num_features feature_columns accuracy f1 f1_weighted "
    "tn fp fn tp train_row_cap epochs batch_size threshold threshold_tuned use_class_weight training_seconds evaluation_seconds total_seconds model_configuration training_run evaluation_run"
).split()


@query("k1_final_results", chain(_FINAL, **_RECORD_STEPS))
def final_rows(spark, sf_dir):
    final = results.final_results(*record_tables(spark, sf_dir))
    texts = {c: F.to_json(c) for c in ("feature_columns", "model_configuration")}
    return final.withColumns(texts).select(*_FINAL_COLUMNS)


@query(
    "k2_results_of_split",
    "SELECT concat('exp', o_custkey % 5) AS experiment_id, concat('eval-', o_orderkey) AS evaluation_run FROM orders WHERE o_orderkey % 25 = 3",
)
def rows_of_one_split(spark, sf_dir):
    manifest, info, *rest = record_tables(spark, sf_dir)
    named = manifest.drop("evaluation_split_id").join(info.select("run", F.col("split_id").alias("evaluation_split_id")), "run")
    return results.final_results(named, info, *rest, evaluation_split="split-3").select("experiment_id", "evaluation_run")


@query("d4_training_runs", chain("SELECT e.run AS evaluation_run, coalesce(t.run, e.run) AS training_run, coalesce(m_split, t.split_id, source_split, CASE WHEN t.run IS NULL THEN e.split_id END, '') AS trained_on_split FROM evals e LEFT JOIN trains t ON t.run = split_part(e.model_path, '/', 2)", **_RECORD_STEPS))
def training_runs(spark, sf_dir):
    return results.final_results(*record_tables(spark, sf_dir)).select("evaluation_run", "training_run", "trained_on_split")


_MANIFEST = """SELECT concat('exp', c_custkey) AS experiment_id, CASE WHEN c_custkey % 2 = 0 THEN concat('Name ', c_custkey) END AS name, CASE WHEN c_custkey % 3 = 0 THEN c_custkey END AS "order",
  concat('split-', c_custkey % 25) AS evaluation_split_id FROM customer"""


@query(
    "d3_manifest_problems",
    chain(
        """SELECT experiment_id, model, run, problem FROM (
          SELECT experiment_id, model, run, unnest([
            CASE WHEN found IS NULL THEN 'run is missing' END,
            CASE WHEN found IS NOT NULL AND model <> found_model THEN 'model differs' END,
            CASE WHEN found IS NOT NULL AND wanted_split <> found_split THEN 'split differs' END,
            CASE WHEN found IS NOT NULL AND k % 29 = 0 THEN 'metrics are missing' END]) AS problem FROM
            (SELECT concat('exp', c_custkey) AS experiment_id, concat('model', c_nationkey % 12) AS model, concat('eval-', c_custkey * 11) AS run, concat('split-', c_custkey % 25) AS wanted_split, e.run AS found, e.k, e.model AS found_model, e.split_id AS found_split
             FROM customer LEFT JOIN evals e ON e.run = concat('eval-', c_custkey * 11))) WHERE problem IS NOT NULL""",
        **_RECORD_STEPS,
    ),
)
def problems_of_manifest(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    manifest = customers.select(
        F.expr("concat('exp', c_custkey)").alias("experiment_id"),
        F.expr("CASE WHEN c_custkey % 2 = 0 THEN concat('Name ', c_custkey) END").alias("name"),
        F.expr("CASE WHEN c_custkey % 3 = 0 THEN c_custkey END").alias("order"),
        F.expr("concat('split-', c_custkey % 25)").alias("evaluation_split_id"),
        F.lit("common").alias("feature_set_id"),
        F.expr("map(concat('model', c_nationkey % 12), concat('eval-', c_custkey * 11))").alias("runs"),
    )
    _, info, metrics, *_ = record_tables(spark, sf_dir)
    scored = metrics.withColumn("run", F.expr("CASE WHEN CAST(substring(run, 6) AS BIGINT) % 29 = 0 THEN concat('lost-', run) ELSE run END"))
    return results.manifest_problems(results.manifest_rows(manifest), info, scored)
