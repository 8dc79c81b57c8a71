"""Evaluation of predictions: everything follows from grouped counts, so one pass over the rows is enough."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowbench.functions.values import ratio
from flowbench.operators.order import with_range
from flowbench.session import checkpoint, few_rows

COUNTS = ("tn", "fp", "fn", "tp")
DEFAULT_THRESHOLD = 0.5


def _count_of(truth: Column, predicted: Column, t: int, p: int, weight: Column | None = None) -> Column:
    hit = (truth == t) & (predicted == p)
    if weight is None:
        return F.count(F.when(hit, 1))
    return F.coalesce(F.sum(F.when(hit, weight)), F.lit(0))


def confusion(df: DataFrame, truth: str, predicted: str, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """tn, fp, fn, tp of 0/1 labels, per group if asked for. ``weight`` counts pre-aggregated rows."""
    t, p = F.col(truth).cast("int"), F.col(predicted).cast("int")
    w = None if weight is None else F.col(weight)
    cells = [_count_of(t, p, a, b, w).alias(n) for n, a, b in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))]
    return df.groupBy(*by).agg(*cells)


def binary_scores(tn: Column, fp: Column, fn: Column, tp: Column) -> dict[str, Column]:
    """Scores of a binary confusion matrix; a ratio without rows is 0."""
    total = tn + fp + fn + tp

    def f_score(p: Column, r: Column) -> Column:
        return ratio(F.lit(2.0) * p * r, p + r)

    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    precision_benign, recall_benign = ratio(tn, tn + fn), ratio(tn, tn + fp)
    f1, f1_benign = f_score(precision, recall), f_score(precision_benign, recall_benign)
    balanced = (recall_benign + recall) / 2
    return {
        "accuracy": ratio(tp + tn, total),
        "balanced_accuracy": balanced,
        "precision": precision,
        "recall": recall,
        "f1": f1,
        "precision_macro": (precision_benign + precision) / 2,
        "recall_macro": balanced,
        "f1_macro": (f1_benign + f1) / 2,
        "f1_weighted": ratio(f1_benign * (tn + fp) + f1 * (fn + tp), total),
    }


def binary_metrics(counts: DataFrame) -> DataFrame:
    """Adds scores, supports and predicted counts to rows that hold tn, fp, fn and tp."""
    tn, fp, fn, tp = (F.col(c) for c in COUNTS)
    return counts.withColumns(
        {
            **binary_scores(tn, fp, fn, tp),
            "support_0": tn + fp,
            "support_1": fn + tp,
            "predicted_0": tn + fn,
            "predicted_1": fp + tp,
        }
    )


def error_rates(counts: DataFrame) -> DataFrame:
    """Adds the false-alarm rate and the rate of attacks not detected."""
    tn, fp, fn, tp = (F.col(c) for c in COUNTS)
    return counts.withColumns({"false_alarm_rate": ratio(fp, fp + tn), "missed_rate": ratio(fn, fn + tp)})


def metrics_record(metrics: DataFrame) -> DataFrame:
    """The nested record that is saved for a run: scores, matrix, support, predicted counts and label names."""
    scores = [c for c in binary_scores(*(F.lit(0),) * 4)]
    pair = F.array(F.lit("0"), F.lit("1"))
    return metrics.select(
        *scores,
        F.array(F.array("tn", "fp"), F.array("fn", "tp")).alias("confusion_matrix"),
        F.map_from_arrays(pair, F.array("support_0", "support_1")).alias("support"),
        F.map_from_arrays(pair, F.array("predicted_0", "predicted_1")).alias("predicted_distribution"),
        F.map_from_arrays(pair, F.array(F.lit("benign"), F.lit("attack"))).alias("labels"),
    )


# --- several classes ------------------------------------------------------------------------------------------


def class_pairs(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Rows per (true, predicted) class: the only pass over the data that the functions below need."""
    return df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def per_class(pairs: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of every class that is true or predicted somewhere."""
    none = F.lit(0).cast("bigint")
    as_truth = pairs.select(
        F.col("truth").alias("label"),
        F.col("n").alias("support"),
        none.alias("predicted"),
        F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(none).alias("hits"),
    )
    as_guess = pairs.select(
        F.col("predicted").alias("label"), none.alias("support"), F.col("n").alias("predicted"), none.alias("hits")
    )
    sums = as_truth.unionByName(as_guess).groupBy("label").agg(
        *[F.sum(c).alias(c) for c in ("support", "predicted", "hits")]
    )
    precision, recall = ratio(F.col("hits"), F.col("predicted")), ratio(F.col("hits"), F.col("support"))
    return sums.withColumns({"precision": precision, "recall": recall}).withColumn(
        "f1", ratio(F.lit(2.0) * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    )


def class_metrics(pairs: DataFrame) -> DataFrame:
    """One row of accuracy, balanced accuracy (over classes that occur), macro and weighted scores."""
    rows = per_class(pairs)
    total = F.sum("support")

    def weighted(c: str) -> Column:
        return F.try_divide(F.sum(F.col(c) * F.col("support")), total)

    return rows.agg(
        F.try_divide(F.sum("hits"), total).alias("accuracy"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
        *[F.avg(c).alias(f"{c}_macro") for c in ("precision", "recall", "f1")],
        *[weighted(c).alias(f"{c}_weighted") for c in ("precision", "recall", "f1")],
        F.count(F.when(F.col("support") > 0, 1)).alias("num_classes_true"),
        F.count(F.when(F.col("predicted") > 0, 1)).alias("num_classes_pred"),
    )


def class_report(pairs: DataFrame) -> DataFrame:
    """Per-class rows followed by accuracy, macro and weighted average rows."""
    rows = per_class(pairs)
    scores = ("precision", "recall", "f1")
    classes = rows.select(F.col("label").cast("string").alias("label"), *scores, "support")
    total = F.sum("support")
    macro = rows.agg(*[F.avg(c).alias(c) for c in scores], total.alias("support")).select(
        F.lit("macro avg").alias("label"), *scores, "support"
    )
    weighted = rows.agg(
        *[F.try_divide(F.sum(F.col(c) * F.col("support")), total).alias(c) for c in scores], total.alias("support")
    ).select(F.lit("weighted avg").alias("label"), *scores, "support")
    hits = F.try_divide(F.sum("hits"), total)
    accuracy = rows.agg(*[hits.alias(c) for c in scores], total.alias("support")).select(
        F.lit("accuracy").alias("label"), *scores, "support"
    )
    return classes.unionByName(accuracy).unionByName(macro).unionByName(weighted)


def classes_of(pairs: DataFrame) -> list[str]:
    """Union of true and predicted classes, ascending; one value per class comes to the driver."""
    names = pairs.select("truth").union(pairs.select("predicted")).distinct().orderBy("truth")
    return [r[0] for r in few_rows(names, "classes")]


def confusion_table(pairs: DataFrame, classes: Sequence | None = None) -> DataFrame:
    """Wide matrix: ``true_label`` and one ``pred_<class>`` column per class, with 0 for pairs that never occur."""
    if classes is None:
        classes = classes_of(pairs)
    # A class that is only predicted still gets its row of zeros.
    only_guessed = pairs.select(F.col("predicted").alias("truth"), "predicted", F.lit(0).cast("bigint").alias("n"))
    cells = [
        F.sum(F.when(F.col("predicted") == F.lit(c), F.col("n")).otherwise(0)).cast("bigint").alias(f"pred_{c}")
        for c in classes
    ]
    wide = pairs.unionByName(only_guessed).groupBy(F.col("truth").alias("true_label")).agg(*cells)
    return wide.orderBy("true_label")


def confusion_cells(pairs: DataFrame, classes: Sequence | None = None) -> DataFrame:
    """The same matrix in long form: ``truth, predicted, n``."""
    if classes is None:
        classes = classes_of(pairs)
    wide = confusion_table(pairs, classes)
    cells = [
        F.struct(F.lit(c).alias("predicted"), F.col(f"`pred_{c}`").alias("n")) for c in classes
    ]
    return wide.select(F.col("true_label").alias("truth"), F.inline(F.array(*cells)))


# --- area under the curve -------------------------------------------------------------------------------------


def roc_auc(df: DataFrame, truth: str, score: str) -> DataFrame:
    """Exact area under the ROC curve of 0/1 truth, ties counted half; null if a class is absent.

    Rows are first tallied per score, and the tallies are kept: bounds of score ranges are quantiles of distinct scores,
    so a score that most rows share weighs no more than another. Ranges are summed apart and combined by their totals.
    """
    tallies = checkpoint(
        df.where(F.col(score).isNotNull())
        .groupBy(F.col(score).cast("double").alias("score"))
        .agg(
            F.count(F.when(F.col(truth) == 1, 1)).cast("double").alias("pos"),
            F.count(F.when(F.col(truth) == 0, 1)).cast("double").alias("neg"),
        )
    )
    ranged = with_range(tallies, "score")
    inside = W.partitionBy("_range").orderBy("score").rowsBetween(W.unboundedPreceding, -1)
    below = F.coalesce(F.sum("neg").over(inside), F.lit(0.0))
    per_range = (
        ranged.withColumn("_below", below)
        .groupBy("_range")
        .agg(
            F.sum(F.col("pos") * (F.col("_below") + F.col("neg") / 2)).alias("wins"),
            F.sum("pos").alias("pos"),
            F.sum("neg").alias("neg"),
        )
    )
    earlier = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # one row per range
    joined = per_range.withColumn("_before", F.coalesce(F.sum("neg").over(earlier), F.lit(0.0)))
    return joined.agg(
        F.sum("pos").alias("pos"),
        F.sum("neg").alias("neg"),
        F.sum(F.col("wins") + F.col("pos") * F.col("_before")).alias("wins"),
    ).select(
        F.when((F.col("pos") > 0) & (F.col("neg") > 0), F.col("wins") / (F.col("pos") * F.col("neg"))).alias("roc_auc")
    )


def roc_auc_by(df: DataFrame, keys: Sequence[str], truth: str, score: str) -> DataFrame:
    """The same area for each group; every (group, score range) is its own window."""
    tallies = checkpoint(
        df.where(F.col(score).isNotNull())
        .groupBy(*keys, F.col(score).cast("double").alias("score"))
        .agg(
            F.count(F.when(F.col(truth) == 1, 1)).cast("double").alias("pos"),
            F.count(F.when(F.col(truth) == 0, 1)).cast("double").alias("neg"),
        )
    )
    ranged = with_range(tallies, "score")
    inside = W.partitionBy(*keys, "_range").orderBy("score").rowsBetween(W.unboundedPreceding, -1)
    per_range = (
        ranged.withColumn("_below", F.coalesce(F.sum("neg").over(inside), F.lit(0.0)))
        .groupBy(*keys, "_range")
        .agg(
            F.sum(F.col("pos") * (F.col("_below") + F.col("neg") / 2)).alias("wins"),
            F.sum("pos").alias("pos"),
            F.sum("neg").alias("neg"),
        )
    )
    earlier = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    joined = per_range.withColumn("_before", F.coalesce(F.sum("neg").over(earlier), F.lit(0.0)))
    area = F.sum(F.col("wins") + F.col("pos") * F.col("_before")) / (F.sum("pos") * F.sum("neg"))
    return joined.groupBy(*keys).agg(F.when((F.sum("pos") > 0) & (F.sum("neg") > 0), area).alias("roc_auc"))


def roc_auc_ovr(df: DataFrame, truth: str, scores: Mapping[str, str]) -> DataFrame:
    """Mean one-versus-rest area over classes; ``scores`` maps a class to its probability column.

    Null if any class has no rows, as the area of that class is undefined.
    """
    cells = F.array(
        *[
            F.struct(F.lit(k).alias("label"), (F.col(truth) == F.lit(k)).cast("int").alias("hit"), F.col(c).alias("p"))
            for k, c in scores.items()
        ]
    )
    long = df.select(F.inline(cells))
    areas = roc_auc_by(long, ["label"], "hit", "p")
    return areas.agg(F.when(F.count("roc_auc") == len(scores), F.avg("roc_auc")).alias("roc_auc"))


# --- thresholds -----------------------------------------------------------------------------------------------


def _last_threshold(score: Column) -> Column:
    """The largest v in 4..95 with score >= v / 100, as exact doubles (4 stands for below all).

    No threshold is passed by a null or NaN score.
    """
    bounded = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))  # infinite scores have no place to round to
    near = F.floor(bounded * 100)
    up, down = (near + 1).cast("double") / 100, near.cast("double") / 100
    exact = F.when(bounded >= up, near + 1).when(bounded < down, near - 1).otherwise(near)
    passed = F.greatest(F.lit(4), F.least(F.lit(95), exact)).cast("int")
    return F.when(score.isNull() | F.isnan(score), F.lit(4)).otherwise(passed)


def threshold_counts(df: DataFrame, truth: str, score: str) -> DataFrame:
    """tn, fp, fn, tp at the thresholds 0.05, 0.06 … 0.95 for the rule ``score >= threshold``.

    Rows are binned to the last threshold they pass; running sums over at most 92 bins do the rest.
    """
    spark = df.sparkSession
    bins = df.groupBy(_last_threshold(F.col(score).cast("double")).alias("bin")).agg(
        F.count(F.when(F.col(truth) == 1, 1)).alias("pos"), F.count(F.when(F.col(truth) == 0, 1)).alias("neg")
    )
    zero = F.lit(0).cast("bigint")
    empty = spark.range(4, 96).select(F.col("id").cast("int").alias("bin"), zero.alias("pos"), zero.alias("neg"))
    full = bins.unionByName(empty).groupBy("bin").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    passed = W.orderBy(F.desc("bin")).rowsBetween(W.unboundedPreceding, W.currentRow)  # 92 rows
    failed = W.orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    return full.select(
        "bin",
        (F.col("bin").cast("double") / 100).alias("threshold"),
        F.sum("pos").over(passed).alias("tp"),
        F.sum("neg").over(passed).alias("fp"),
        F.coalesce(F.sum("pos").over(failed), zero).alias("fn"),
        F.coalesce(F.sum("neg").over(failed), zero).alias("tn"),
    ).where("bin >= 5")


def best_threshold(df: DataFrame, truth: str, score: str) -> DataFrame:
    """The threshold with the best (F1, balanced accuracy); ties keep 0.50, else the smallest threshold."""
    rows = binary_metrics(threshold_counts(df, truth, score))
    return rows.orderBy(
        F.desc("f1"), F.desc("balanced_accuracy"), F.desc(F.col("bin") == 50), F.asc("threshold")
    ).limit(1).drop("bin")


def apply_threshold(df: DataFrame, score: str, chosen: float, default: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Adds the 0/1 predictions under the chosen and the default threshold; a null or NaN score passes none."""
    value = F.col(score).cast("double")

    def passes(limit: float) -> Column:
        return F.coalesce((value >= F.lit(float(limit))) & ~F.isnan(value), F.lit(False)).cast("int")

    return df.withColumns({"prediction": passes(chosen), "default_prediction": passes(default)})
