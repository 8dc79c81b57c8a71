"""Running detectors on a prepared split and keeping one record per run."""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowbench.operators import metrics
from flowbench.operators.baseline import Detector, FittedDetector
from flowbench.operators.splits import fitting_parts, folds
from flowbench.plans.results import compact_metrics, unfinished_runs
from flowbench.session import checkpoint, spread


def evaluate(fitted: FittedDetector, test: DataFrame, label: str, threshold: float | None = None) -> DataFrame:
    """One row of binary metrics. With a threshold, the probability decides and the default threshold is reported too."""
    scored = fitted.score(test)
    if threshold is None or "probability" not in scored.columns:
        return metrics.binary_metrics(metrics.confusion(scored, label, "prediction"))
    both = metrics.apply_threshold(scored, "probability", threshold)
    guesses = both.select(
        label,
        F.inline(
            F.array(
                F.struct(F.lit("chosen").alias("rule"), F.col("prediction").alias("guess")),
                F.struct(F.lit("default").alias("rule"), F.col("default_prediction").alias("guess")),
            )
        ),
    )
    return metrics.binary_metrics(metrics.confusion(guesses, label, "guess", by=["rule"]))


def cross_validation(detector: Detector, df: DataFrame, features: Sequence[str], label: str, key: Sequence[str], k: int = 5, seed: int = 42) -> DataFrame:
    """``fold, tn, fp, fn, tp``: the detector is fitted on all folds but one and scored on that one, for each fold."""
    numbered = folds(df.select(*dict.fromkeys([*key, *features, label])), key, k, seed).select("fold", *features, label)
    numbered = checkpoint(numbered)
    rows = None
    for i in range(k):
        fitted = detector.fit(numbered.where(F.col("fold") != i), features, label)
        scored = fitted.score(numbered.where(F.col("fold") == i))
        part = metrics.confusion(scored, label, "prediction", by=["fold"])
        rows = part if rows is None else rows.unionByName(part)
    return rows


def run_scores(fitted: FittedDetector, test: DataFrame, label: str) -> dict[str, object]:
    """The scores that a run's index row holds: macro and weighted means, class counts, and the area under the curve of a detector
    that gives probabilities (one class versus the rest if there are several). The test rows are scored once."""
    scored = fitted.score(test)
    columns = [c for c in ("probability", "probabilities") if c in scored.columns]
    kept = checkpoint(scored.select(F.col(label).alias("truth"), F.col("prediction").cast("int").alias("prediction"), *columns))
    pairs = metrics.class_pairs(kept, "truth", "prediction")
    found = metrics.class_metrics(pairs).first().asDict()  # one row
    several = found["num_classes_true"] > 2 or "probabilities" in columns
    area = None
    if columns == ["probability"]:
        area = metrics.roc_auc(kept, "truth", "probability").first()[0]
    elif columns:
        n = kept.agg(F.max(F.size("probabilities"))).first()[0]
        wide = kept.select("truth", *[F.get("probabilities", F.lit(i)).alias(f"p{i}") for i in range(n)])
        area = metrics.roc_auc_ovr(wide, "truth", {i: f"p{i}" for i in range(n)}).first()[0]
    return {**found, "roc_auc": area, "problem_type": "multiclass" if several else "binary"}


def tuned_threshold(
    detector: Detector, train: DataFrame, features: Sequence[str], label: str, key: Sequence[str], seed: int = 42
) -> tuple[FittedDetector, float]:
    """A detector fitted on nine tenths of the training rows, and the threshold chosen on the rest."""
    parts = spread(fitting_parts(train, key, 0.1, seed), "fitting")
    fitted = detector.fit(parts.where("part = 'fitting'"), features, label)
    scored = fitted.score(parts.where("part = 'validation'"))
    if "probability" not in scored.columns:
        return fitted, metrics.DEFAULT_THRESHOLD
    best = metrics.best_threshold(scored, label, "probability").first()
    return fitted, best["threshold"]


def run_detectors(
    detectors: Sequence[Detector],
    train: DataFrame,
    test: DataFrame,
    features: Sequence[str],
    label: str,
    dataset_id: str,
    stop_on_error: bool = False,
) -> DataFrame:
    """Fits and evaluates every detector on the same kept tables: one run-index row each.

    A detector that fails gives a row with status ``failed`` and its message, and the others go on.
    """
    spark = train.sparkSession
    columns = [*features, label]
    train, test = train.select(*columns).persist(), test.select(*columns).persist()
    rows = None
    try:
        for i, detector in enumerate(detectors):
            base = spark.createDataFrame(
                [(f"{i:04d}", detector.name, dataset_id)], "run_id string, model_id string, dataset_id string"
            )
            try:
                start = time.perf_counter()
                fitted = detector.fit(train, features, label)
                scores = run_scores(fitted, test, label)
                seconds = time.perf_counter() - start
                row = compact_metrics(
                    base.withColumns(
                        {
                            "status": F.lit("success"),
                            "duration_seconds": F.lit(seconds),
                            **{k: F.lit(v) for k, v in scores.items()},
                        }
                    )
                )
            except Exception as problem:
                if stop_on_error:
                    raise
                row = unfinished_runs(base, "failed", str(problem))
            rows = row if rows is None else rows.unionByName(row)
    finally:
        train.unpersist()
        test.unpersist()
    return rows
