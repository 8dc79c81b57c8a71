"""Summaries over finished runs: latest runs, pivots, transfer tables and final result rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowbench.functions.values import short_duration
from flowbench.session import settle

# --- choosing runs -----------------------------------------------------------------------------------------------


def successful(runs: DataFrame) -> DataFrame:
    return runs.where(F.lower(F.col("status").cast("string")) == "success")


def latest_runs(runs: DataFrame, keys: Sequence[str] = ("model_id", "dataset_id"), order: str = "run_id") -> DataFrame:
    """The newest run of each key. An aggregate, not a sort: each task keeps one row per key before the shuffle."""
    rest = [c for c in runs.columns if c not in keys]
    newest = runs.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r"))
    return newest.select(*keys, "_r.*").select(*runs.columns)


def newest_artefact(
    artefacts: DataFrame, model_id: str, seed: int | None = None, split_id: str | None = None
) -> DataFrame:
    """The path of the newest matching model artefact (one row); no match is an error."""
    hits = artefacts.where(F.col("model_id") == model_id)
    if seed is not None:
        hits = hits.where(F.col("seed") == seed)
    if split_id is not None:
        hits = hits.where(F.col("split_id") == split_id)
    newest = hits.agg(F.max_by("path", F.struct("modified", "path")).alias("path"))
    wanted = f"no artefact of {model_id} with seed {seed} and split {split_id}"
    return newest.select(F.coalesce("path", F.raise_error(F.lit(wanted)).cast("string")).alias("path"))


def work_list(models: DataFrame, datasets: Sequence[str], finished: DataFrame) -> DataFrame:
    """``model_id, dataset_id`` pairs still to run: every model on each listed data set, minus finished runs."""
    wanted = models.select("model_id").distinct().withColumn("dataset_id", F.explode(F.array(*map(F.lit, datasets))))
    done = successful(finished).select("model_id", "dataset_id").distinct()
    return wanted.join(done, ["model_id", "dataset_id"], "left_anti")


def status_counts(runs: DataFrame, directions: Mapping[str, str]) -> DataFrame:
    """Latest runs per direction and status."""
    latest = latest_runs(runs.where(F.col("dataset_id").isin(*directions)))
    return latest.groupBy(_renamed("dataset_id", directions).alias("direction"), "status").agg(F.count("*").alias("n"))


def _renamed(column: str, names: Mapping[str, str]) -> Column:
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    return F.element_at(F.create_map(*pairs), F.col(column))


# --- fixed orders ------------------------------------------------------------------------------------------------


def reindex(df: DataFrame, key: str, order: Sequence[str], pos: str = "pos") -> DataFrame:
    """One row per listed key, in list order, null where the table has none. Other keys are left out."""
    listed = df.sparkSession.createDataFrame([(i, k) for i, k in enumerate(order)], f"{pos} int, {key} string")
    # The list is a literal of the caller and goes to every executor; it is never the preserved side of a broadcast.
    rows = df.join(F.broadcast(listed), key)
    absent = listed.join(df.select(key).where(F.col(key).isin(*order)).distinct(), key, "left_anti")
    return rows.unionByName(absent, allowMissingColumns=True).orderBy(pos)


def by_experiment_order(experiments: DataFrame) -> DataFrame:
    """Experiments by their order, 999 if they have none, then by id."""
    return experiments.orderBy(F.coalesce("experiment_order", F.lit(999)), "experiment_id")


# --- figure tables -----------------------------------------------------------------------------------------------


def metric_pivot(
    results: DataFrame,
    metric: str,
    experiments: Sequence[str],
    models: Sequence[str],
    baseline: str | None = None,
) -> DataFrame:
    """One row per model in the given order, one column per experiment. ``baseline`` names a model to leave out.

    Models without any result in these experiments do not appear.
    """
    chosen = results.where(F.col("experiment_id").isin(*experiments) & F.col("model").isin(*models))
    if baseline is not None:
        chosen = chosen.where(F.col("model") != baseline)
    wide = chosen.groupBy("model").agg(
        *[F.max(F.when(F.col("experiment_id") == e, F.col(metric))).alias(e) for e in experiments]
    )
    place = F.array_position(F.array(*map(F.lit, models)), F.col("model"))
    return wide.orderBy(place)


def feature_set_comparison(
    results: DataFrame, experiments: tuple[str, str], names: tuple[str, str], models: Sequence[str],
    metric: str = "f1", baseline: str | None = None,
) -> DataFrame:
    """The metric under two feature sets, for models that have a result under both."""
    chosen = results.where(F.col("experiment_id").isin(*experiments) & F.col("model").isin(*models))
    if baseline is not None:
        chosen = chosen.where(F.col("model") != baseline)
    both = chosen.groupBy("model").agg(
        F.count_distinct("experiment_id").alias("_k"),
        *[F.max(F.when(F.col("experiment_id") == e, F.col(metric))).alias(n) for e, n in zip(experiments, names)],
    )
    place = F.array_position(F.array(*map(F.lit, models)), F.col("model"))
    return both.where("_k = 2").drop("_k").orderBy(place)


def training_times(results: DataFrame, experiment: str, models: Sequence[str], baseline: str | None = None) -> DataFrame:
    """Training seconds and their text for each model of one experiment, in model order."""
    chosen = results.where((F.col("experiment_id") == experiment) & F.col("training_seconds").isNotNull())
    chosen = chosen.where(F.col("model").isin(*[m for m in models if m != baseline]))
    place = F.array_position(F.array(*map(F.lit, models)), F.col("model"))
    return chosen.select(
        "model", "training_seconds", short_duration("training_seconds").alias("training_text")
    ).orderBy(place)


def detected_attacks(results: DataFrame, experiment: str, models: Sequence[str]) -> DataFrame:
    """True positives of each model in one experiment, in model order."""
    place = F.array_position(F.array(*map(F.lit, models)), F.col("model"))
    chosen = results.where((F.col("experiment_id") == experiment) & F.col("model").isin(*models))
    return chosen.select("model", "tp").orderBy(place)


def confusion_long(results: DataFrame, experiment: str, model: str) -> DataFrame:
    """Four cells of one run as ``actual, predicted, name, n``; no row if the run is missing."""
    chosen = results.where((F.col("experiment_id") == experiment) & (F.col("model") == model))

    def cell(actual: str, predicted: str, name: str, column: str) -> Column:
        return F.struct(
            F.lit(actual).alias("actual"), F.lit(predicted).alias("predicted"), F.lit(name).alias("name"),
            F.col(column).cast("bigint").alias("n"),
        )

    cells = F.array(
        cell("benign", "benign", "true negatives", "tn"),
        cell("benign", "malicious", "false positives", "fp"),
        cell("malicious", "benign", "false negatives", "fn"),
        cell("malicious", "malicious", "true positives", "tp"),
    )
    return chosen.select(F.inline(cells))


# --- transfer ----------------------------------------------------------------------------------------------------


def transfer_table(runs: DataFrame, native: str, external: str, saved: DataFrame | None = None) -> DataFrame:
    """Latest successful run per model on its own and on a foreign data set, with the drops.

    ``saved`` (``run_id, accuracy, f1_macro``) holds metrics from the run records, which win over the index.
    A data set without runs gives null columns.
    """
    latest = latest_runs(successful(runs.where(F.col("dataset_id").isin(native, external))))
    if saved is not None:
        records = saved.select("run_id", F.col("accuracy").alias("_a"), F.col("f1_macro").alias("_f"))
        latest = latest.join(records, "run_id", "left").withColumns(
            {"accuracy": F.coalesce("_a", "accuracy"), "f1_macro": F.coalesce("_f", "f1_macro")}
        )

    def of(dataset: str, metric: str) -> Column:
        return F.max(F.when(F.col("dataset_id") == dataset, F.col(metric)))

    wide = latest.groupBy("model_id").agg(
        of(native, "accuracy").alias("native_accuracy"),
        of(external, "accuracy").alias("external_accuracy"),
        of(native, "f1_macro").alias("native_f1_macro"),
        of(external, "f1_macro").alias("external_f1_macro"),
    )
    return wide.select(
        "model_id",
        "native_accuracy",
        "external_accuracy",
        (F.col("native_accuracy") - F.col("external_accuracy")).alias("accuracy_drop"),
        "native_f1_macro",
        "external_f1_macro",
        (F.col("native_f1_macro") - F.col("external_f1_macro")).alias("f1_macro_drop"),
    ).orderBy(F.desc_nulls_last("external_f1_macro"), "model_id")


def direction_matrix(
    runs: DataFrame,
    directions: Mapping[str, str],
    metrics: Sequence[str],
    drops: Mapping[str, tuple[str, str, str]],
    order_by: str | None = None,
) -> DataFrame:
    """Latest runs as one row per model: ``<metric>_<direction>`` columns, then drops between two directions.

    ``drops`` maps a new column to (metric, from direction, to direction).
    """
    latest = latest_runs(runs.where(F.col("dataset_id").isin(*directions)))
    cells = [
        F.max(F.when(F.col("dataset_id") == d, F.col(m))).alias(f"{m}_{short}")
        for m in metrics
        for d, short in directions.items()
    ]
    wide = latest.groupBy("model_id").agg(*cells)
    wide = wide.withColumns(
        {n: F.col(f"{m}_{a}").try_cast("double") - F.col(f"{m}_{b}").try_cast("double") for n, (m, a, b) in drops.items()}
    )
    if order_by:
        wide = wide.orderBy(F.desc_nulls_last(order_by), "model_id")
    return wide


def compact_matrix(
    runs: DataFrame, directions: Mapping[str, str], drops: Mapping[str, tuple[str, str]], order_by: str
) -> DataFrame:
    """Status, accuracy and F1 of the latest runs per direction, with F1 drops, rounded to four places."""
    latest = latest_runs(runs.where(F.col("dataset_id").isin(*directions)))

    def of(d: str, c: str) -> Column:
        return F.max(F.when(F.col("dataset_id") == d, F.col(c)))

    wide = latest.groupBy("model_id").agg(
        *[
            of(d, c).alias(f"{name}_{short}")
            for d, short in directions.items()
            for name, c in (("status", "status"), ("acc", "accuracy"), ("f1", "f1_macro"))
        ]
    )
    wide = wide.withColumns({n: F.col(f"f1_{a}") - F.col(f"f1_{b}") for n, (a, b) in drops.items()})
    numbers = [c for c in wide.columns if c != "model_id" and not c.startswith("status_")]
    rounded = wide.withColumns({c: F.bround(F.col(c).try_cast("double"), 4) for c in numbers})
    return rounded.orderBy(F.desc_nulls_last(order_by), "model_id")


# --- run records ---------------------------------------------------------------------------------------------------

# The scalar columns of the run index.
COMPACT_KEYS = {
    "run_id": "string", "model_id": "string", "dataset_id": "string", "split_id": "string", "stage": "string",
    "status": "string", "runner": "string", "problem_type": "string", "accuracy": "double",
    "balanced_accuracy": "double", "precision_macro": "double", "recall_macro": "double", "f1_macro": "double",
    "precision_weighted": "double", "recall_weighted": "double", "f1_weighted": "double", "roc_auc": "double",
    "num_classes_true": "bigint", "num_classes_pred": "bigint", "duration_seconds": "double",
    "metrics_json_path": "string", "confusion_matrix_path": "string", "error": "string",
}


def compact_metrics(records: DataFrame) -> DataFrame:
    """The scalar columns of the run index; what a record lacks is null."""
    have = set(records.columns)
    return records.select(
        *[(F.col(k) if k in have else F.lit(None)).cast(kind).alias(k) for k, kind in COMPACT_KEYS.items()]
    )


def unfinished_runs(work: DataFrame, status: str, message: str) -> DataFrame:
    """Index rows for runs that failed, are blocked or lack a dependency: null metrics and a message."""
    if status not in ("failed", "blocked", "needs_dependency"):
        raise ValueError(f"not a status of an unfinished run: {status}")
    return compact_metrics(work.withColumns({"status": F.lit(status), "error": F.lit(message)}))


def first_filled(*maps: Column) -> Column:
    """The first map or array that is neither null nor empty."""
    return F.coalesce(*[F.when(F.size(m) > 0, m) for m in maps])


def manifest_rows(manifest: DataFrame) -> DataFrame:
    """``experiment_id, …, model, run`` from one row per experiment with a map of its runs."""
    return manifest.select(
        "experiment_id",
        F.coalesce("name", "experiment_id").alias("experiment_name"),
        F.col("order").alias("experiment_order"),
        "evaluation_split_id",
        "feature_set_id",
        F.explode("runs").alias("model", "run"),
    )


def manifest_problems(manifest: DataFrame, run_info: DataFrame, metrics: DataFrame) -> DataFrame:
    """``experiment_id, model, run, problem`` for runs that are missing or do not fit their experiment."""
    info = run_info.select(
        "run", F.col("model_id").alias("_model"), F.col("split_id").alias("_split"),
        F.col("feature_set_id").alias("_features"), F.lit(True).alias("_known"),
    )
    scored = metrics.select("run", F.lit(True).alias("_scored"))
    rows = manifest.join(info, "run", "left").join(scored, "run", "left")

    def differs(expected: str, found: str) -> Column:
        wanted = F.col(expected)
        return wanted.isNotNull() & (wanted != "") & ~wanted.eqNullSafe(F.col(found))

    known = F.coalesce("_known", F.lit(False))
    problems = F.array_compact(
        F.array(
            F.when(~known, F.lit("run is missing")),
            F.when(known & ~F.col("model").eqNullSafe(F.col("_model")), F.lit("model differs")),
            F.when(known & differs("evaluation_split_id", "_split"), F.lit("split differs")),
            F.when(known & differs("feature_set_id", "_features"), F.lit("feature set differs")),
            F.when(known & F.col("_scored").isNull(), F.lit("metrics are missing")),
        )
    )
    return rows.select("experiment_id", "model", "run", F.explode(problems).alias("problem"))


def _pre(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{prefix}{c}") for c in df.columns])


def final_results(
    manifest: DataFrame,
    run_info: DataFrame,
    metrics: DataFrame,
    summaries: DataFrame,
    splits: DataFrame,
    models: DataFrame,
    evaluation_split: str | None = None,
) -> DataFrame:
    """One row of 45 columns per manifest run, in experiment order.

    ``run_info``, ``metrics`` and ``summaries`` are keyed by ``run``, ``splits`` by ``split_id`` and ``models``
    by ``model_id``. A run whose training run is unknown counts as its own. ``evaluation_split`` filters the
    result only.
    """
    rows = manifest if evaluation_split is None else manifest.where(F.col("evaluation_split_id") == evaluation_split)
    rows = rows.select(
        "experiment_id", "experiment_name", "experiment_order", "model", F.col("run").alias("evaluation_run")
    )
    rows = rows.join(_pre(run_info, "i_"), F.col("evaluation_run") == F.col("i_run"))
    rows = rows.join(_pre(metrics, "m_"), F.col("evaluation_run") == F.col("m_run"))

    folder = F.element_at(F.split(F.col("i_model_path"), "/"), -2)
    rows = rows.withColumn("_candidate", folder)
    # The training run's own record: found by the model's folder, else the evaluation run itself.
    trained = _pre(run_info.select("run", "split_id", "dataset_id", "training_seconds"), "t_")
    rows = rows.join(trained, F.col("_candidate") == F.col("t_run"), "left")
    own = F.col("t_run").isNull()
    rows = rows.withColumns(
        {
            "training_run": F.coalesce("t_run", "evaluation_run"),
            "t_split_id": F.when(own, F.col("i_split_id")).otherwise(F.col("t_split_id")),
            "t_dataset_id": F.when(own, F.col("i_dataset_id")).otherwise(F.col("t_dataset_id")),
            "t_training_seconds": F.when(own, F.col("i_training_seconds")).otherwise(F.col("t_training_seconds")),
        }
    )
    rows = rows.join(_pre(summaries, "s_"), F.col("training_run") == F.col("s_run"), "left")
    rows = rows.withColumns(
        {
            "trained_on_split": F.coalesce(
                "m_training_split_id", "s_split_id", "i_source_training_split_id", "t_split_id", F.lit("")
            ),
            "evaluated_on_split": F.coalesce("i_split_id", F.lit("")),
        }
    )
    splits = settle(splits)  # runs without a split meet at one empty key
    rows = rows.join(_pre(splits, "a_"), F.col("trained_on_split") == F.col("a_split_id"), "left")
    rows = rows.join(_pre(splits, "b_"), F.col("evaluated_on_split") == F.col("b_split_id"), "left")
    named = settle(models.select(F.col("model_id").alias("r_model_id"), F.col("name").alias("r_name")))
    rows = rows.join(named, F.col("model") == F.col("r_model_id"), "left")

    trained_labels = first_filled(
        F.col("s_training_label_counts"), F.col("s_sampled_label_counts"), F.col("s_training_sample_label_counts"),
        F.col("s_label_counts"), F.col("m_training_label_counts"), F.col("m_training_sample_label_counts"),
    )
    evaluated_labels = first_filled(
        F.col("m_evaluation_label_counts"), F.col("m_support"), F.col("b_test_label_distribution")
    )
    features = F.coalesce(
        first_filled(F.col("m_feature_columns"), F.col("s_feature_columns"), F.col("i_feature_columns")),
        F.array().cast("array<string>"),
    )
    matrix = first_filled(F.col("m_confusion_matrix"))
    full_rows = F.coalesce("s_full_training_rows", "m_full_training_rows", "a_train_rows")
    used_rows = F.coalesce(
        "s_training_rows", "s_sampled_training_rows", "s_training_sample_rows", "m_training_rows", "m_training_sample_rows"
    )
    cap = F.coalesce("s_train_row_cap", "m_train_row_cap", "i_train_row_cap")
    inferred_cap = F.coalesce(cap, F.when(used_rows < full_rows, used_rows))
    evaluation_seconds = F.coalesce("i_evaluation_seconds", "m_evaluation_seconds")
    configuration = F.coalesce(
        first_filled(F.col("s_architecture"), F.col("s_params"), F.col("m_architecture"), F.col("m_params")),
        F.create_map().cast("map<string,string>"),
    )

    def cell(i: int, j: int) -> Column:
        return F.get(F.get(matrix, F.lit(i)), F.lit(j))

    final = rows.select(
        "experiment_id",
        "experiment_name",
        "experiment_order",
        "model",
        F.coalesce("r_name", "i_model_name", F.lit("")).alias("model_name"),
        F.col("i_seed").alias("seed"),
        "trained_on_split",
        F.coalesce("a_dataset_id", "t_dataset_id", F.lit("")).alias("trained_on_dataset"),
        "evaluated_on_split",
        F.coalesce("i_dataset_id", F.lit("")).alias("evaluated_on_dataset"),
        F.coalesce("i_feature_set_id", F.lit("")).alias("feature_set"),
        F.coalesce("b_split_method.type", F.lit("")).alias("split_method"),
        full_rows.alias("full_training_rows"),
        used_rows.alias("training_rows_used"),
        F.try_element_at(trained_labels, F.lit("0")).alias("training_label_0"),
        F.try_element_at(trained_labels, F.lit("1")).alias("training_label_1"),
        F.coalesce("m_evaluation_rows", "b_test_rows").alias("evaluation_rows"),
        F.try_element_at(evaluated_labels, F.lit("0")).alias("evaluation_label_0"),
        F.try_element_at(evaluated_labels, F.lit("1")).alias("evaluation_label_1"),
        F.size(features).alias("num_features"),
        features.alias("feature_columns"),
        *[F.col(f"m_{c}").alias(c) for c in ("accuracy", "balanced_accuracy", "precision", "recall", "f1", "f1_macro", "f1_weighted")],
        cell(0, 0).alias("tn"),
        cell(0, 1).alias("fp"),
        cell(1, 0).alias("fn"),
        cell(1, 1).alias("tp"),
        inferred_cap.alias("train_row_cap"),
        *[F.coalesce(f"m_{c}", f"s_{c}").alias(c) for c in ("epochs", "batch_size", "learning_rate", "threshold")],
        *[F.coalesce(f"m_{c}", f"s_{c}", F.lit(False)).alias(c) for c in ("threshold_tuned", "use_class_weight")],
        F.col("t_training_seconds").alias("training_seconds"),
        evaluation_seconds.alias("evaluation_seconds"),
        (F.col("t_training_seconds") + evaluation_seconds).alias("total_seconds"),
        configuration.alias("model_configuration"),
        "training_run",
        "evaluation_run",
    )
    return final.orderBy(F.coalesce("experiment_order", F.lit(999)), "experiment_id", "model")
