"""Fitted detectors. Where SQL can follow the arithmetic, every prediction is checked; else the row and attack
counts and whether the detector beats the majority class."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowbench.functions.values import complete_rows
from flowbench.operators import metrics, splits
from flowbench.operators.anomaly import ClusterDetector, EnergyDetector
from flowbench.operators.baseline import MajorityBaseline
from flowbench.operators.boosting import AdaBoost
from flowbench.operators.deeptrees import DeepForest
from flowbench.operators.encode import anova_by_class
from flowbench.operators.encoders import EncodedNet, ReconstructionDetector
from flowbench.operators.external import ExternalDetector
from flowbench.operators.gaussian import GaussianNaiveBayes, LinearDiscriminant
from flowbench.operators.kernels import KernelSvm
from flowbench.operators.landmarks import LandmarkSvm
from flowbench.operators.leafwise import LeafWiseBoosting
from flowbench.operators.learners import (
    boosted_trees,
    decision_tree,
    encoded_network,
    encoded_softmax,
    linear_svm,
    network,
    random_forest,
    softmax,
)
from flowbench.operators.neighbours import NearestNeighbours
from flowbench.operators.nets import Network
from flowbench.operators.stumps import ExactAdaBoost
from flowbench.plans.catalog import query
from flowbench.plans.experiment import cross_validation, run_detectors, tuned_threshold
from flowbench.plans.flows import ATTACK_RULE, flows, flows_of, table
from flowbench.plans.queries_cleaning import COMMON, prepared, round_all
from flowbench.plans.queries_splits import _FOLD, KEY, ranked_steps
from flowbench.plans.texts import on_flows, on_prepared
from flowbench.session import dealt, spread

FEATURES = list(COMMON)

_LABELLED = f"""SELECT flow_id, {', '.join(COMMON)}, class, CASE {ATTACK_RULE} WHEN 'Attack' THEN 1 ELSE 0 END AS y
FROM flows WHERE flow_bytes_s IS NOT NULL AND NOT isinf(flow_bytes_s)"""
LEARNABLE = {"labelled": _LABELLED, **ranked_steps("labelled", "flow_id", "CAST(y AS VARCHAR)", "ceil(t * CAST(0.2 AS DOUBLE))")}


def learnable_parts(spark, sf_dir):
    """(train, test) of flows whose 0/1 label ``y`` follows from two features; written once with their part, for fits pass over them many times."""
    df = flows_of(dealt(table(spark, sf_dir, "events"), "events")).select(
        "flow_id", "class", *COMMON, F.expr(f"CASE {ATTACK_RULE} WHEN 'Attack' THEN 1 ELSE 0 END").alias("y")
    )
    parts = spread(splits.random_parts(spread(complete_rows(df, COMMON, "y"), "learnable"), KEY, 0.2, 42, "y"), "parts")
    return parts.where("part = 'train'").drop("part"), parts.where("part = 'test'").drop("part")


_FACTS = on_flows(
    "SELECT '{name}' AS detector, count(*) AS test_rows, CAST(sum(y) AS BIGINT) AS attacks, true AS {claim} FROM placed WHERE place <= quota",
    **LEARNABLE,
)


def facts_check(name: str, claim: str = "beats_majority") -> str:
    return _FACTS.replace("{name}", name).replace("{claim}", claim)


def beats_majority(detector, spark, sf_dir, features=FEATURES):
    """One row: the rows scored, the attacks among them, and whether balanced accuracy and accuracy exceed the
    majority's 0.5 and its share."""
    train, test = learnable_parts(spark, sf_dir)
    scored = detector.fit(train, features, "y").score(test)
    counts = metrics.binary_metrics(metrics.confusion(scored, "y", "prediction"))
    rows = F.col("support_0") + F.col("support_1")
    better = (F.col("balanced_accuracy") > 0.5) & (F.col("accuracy") >= F.col("support_0") / rows)
    return counts.select(
        F.lit(detector.name).alias("detector"), rows.alias("test_rows"), F.col("support_1").alias("attacks"), better.alias("beats_majority")
    )


@query("j4_boosted_trees", facts_check("boosted_trees"))
def boosted(spark, sf_dir):
    return beats_majority(boosted_trees(), spark, sf_dir)


def nearly_perfect(detector, spark, sf_dir, features=FEATURES, least=0.98):
    """The same facts, with a balanced accuracy that only a detector reaches that has found the rule behind the labels."""
    train, test = learnable_parts(spark, sf_dir)
    scored = detector.fit(train, features, "y").score(test)
    counts = metrics.binary_metrics(metrics.confusion(scored, "y", "prediction"))
    return counts.select(
        F.lit(detector.name).alias("detector"),
        (F.col("support_0") + F.col("support_1")).alias("test_rows"),
        F.col("support_1").alias("attacks"),
        (F.col("balanced_accuracy") >= least).alias("nearly_perfect"),
    )


@query("j4_leafwise_boosting", facts_check("leafwise_boosting", "nearly_perfect"))
def leafwise(spark, sf_dir):
    return nearly_perfect(LeafWiseBoosting(), spark, sf_dir)


@query("j5_random_forest", facts_check("random_forest"))
def forest(spark, sf_dir):
    return beats_majority(random_forest(), spark, sf_dir)


@query("j5_deep_forest", facts_check("deep_forest", "nearly_perfect"))
def unlimited_forest(spark, sf_dir):
    return nearly_perfect(DeepForest(), spark, sf_dir)


@query("j6_deep_tree", facts_check("deep_tree", "nearly_perfect"))
def unlimited_tree(spark, sf_dir):
    return nearly_perfect(DeepForest.one(), spark, sf_dir)


@query("j7_exact_stumps", facts_check("exact_adaboost", "nearly_perfect"))
def exact_stumps(spark, sf_dir):
    return nearly_perfect(ExactAdaBoost(), spark, sf_dir, least=0.95)


@query("j6_i7_selected_tree", facts_check("decision_tree"))
def selected_tree(spark, sf_dir):
    return beats_majority(decision_tree(), spark, sf_dir, COMMON)


@query("j12_softmax", facts_check("softmax", "detects_most"))
def softmax_regression(spark, sf_dir):
    return _detects_most(softmax(), spark, sf_dir)


def _detects_most(detector, spark, sf_dir, features=FEATURES):
    """The same facts for balanced detectors, which trade accuracy for recall: balanced accuracy above 0.8."""
    train, test = learnable_parts(spark, sf_dir)
    scored = detector.fit(train, features, "y").score(test)
    counts = metrics.binary_metrics(metrics.confusion(scored, "y", "prediction"))
    return counts.select(
        F.lit(detector.name).alias("detector"),
        (F.col("support_0") + F.col("support_1")).alias("test_rows"),
        F.col("support_1").alias("attacks"),
        (F.col("balanced_accuracy") > 0.8).alias("detects_most"),
    )


@query("j13_network", facts_check("network"))
def feed_forward(spark, sf_dir):
    return beats_majority(network(), spark, sf_dir)


@query("j13_rectified_network", facts_check("rectified_network", "nearly_perfect"))
def rectified_network(spark, sf_dir):
    return nearly_perfect(Network(), spark, sf_dir, least=0.95)


@query("j14_self_taught_softmax", facts_check("self_taught_softmax", "nearly_perfect"))
def self_taught(spark, sf_dir):
    return nearly_perfect(EncodedNet(), spark, sf_dir, least=0.9)


@query("j15_stacked_encoder_network", facts_check("stacked_encoder_network", "nearly_perfect"))
def stacked_network(spark, sf_dir):
    return nearly_perfect(EncodedNet.deep(), spark, sf_dir, least=0.9)


@query("j14_encoded_softmax", facts_check("encoded_softmax", "detects_most"))
def encoded_regression(spark, sf_dir):
    return _detects_most(encoded_softmax(), spark, sf_dir)


@query("j15_encoded_network", facts_check("encoded_network"))
def encoded_feed_forward(spark, sf_dir):
    return beats_majority(encoded_network(), spark, sf_dir)


@query("j11_linear_svm", facts_check("linear_svm", "detects_most"))
def support_vectors(spark, sf_dir):
    return _detects_most(linear_svm(), spark, sf_dir)


@query("j11_kernel_svm", facts_check("kernel_svm", "detects_most"))
def kernel_support_vectors(spark, sf_dir):
    return _detects_most(KernelSvm(), spark, sf_dir)


@query("j11_landmark_svm", facts_check("landmark_svm", "nearly_perfect"))
def landmark_support_vectors(spark, sf_dir):
    return nearly_perfect(LandmarkSvm(), spark, sf_dir, least=0.95)


@query("j7_adaboost", facts_check("adaboost"))
def boosted_stumps(spark, sf_dir):
    return beats_majority(AdaBoost(), spark, sf_dir)


@query(
    "j16_cluster_detector",
    on_flows(
        "SELECT part, count(*) AS n, CAST(sum(y) AS BIGINT) AS attacks, true AS majority_or_better FROM (SELECT y, CASE WHEN place <= quota THEN 'test' ELSE 'train' END AS part FROM placed) GROUP BY 1",
        **LEARNABLE,
    ),
)
def clusters(spark, sf_dir):
    # Each cluster predicts its majority, so on training rows the detector cannot fall below the overall majority.
    train, test = learnable_parts(spark, sf_dir)
    fitted = ClusterDetector().fit(train, FEATURES, "y")
    both = fitted.score(train).withColumn("part", F.lit("train")).unionByName(fitted.score(test).withColumn("part", F.lit("test")))
    hits, attacks, n = F.count(F.when(F.col("prediction") == F.col("y"), 1)), F.sum("y"), F.count("*")
    enough = (hits >= F.greatest(attacks, n - attacks)) | (F.col("part") == "test")
    return both.groupBy("part").agg(n.alias("n"), attacks.cast("bigint").alias("attacks"), enough.alias("majority_or_better"))


@query(
    "j17_energy_detector",
    on_flows(
        "SELECT count(*) AS normal_rows, CAST(floor(count(*) * CAST(0.05 AS DOUBLE)) AS BIGINT) AS flagged_floor, true AS flags_five_percent FROM placed WHERE place > quota AND y = 0",
        **LEARNABLE,
    ),
)
def energies(spark, sf_dir):
    # The threshold is the 95th percentile of the normal training rows, so 5 % of these lie above it.
    train, _ = learnable_parts(spark, sf_dir)
    fitted = EnergyDetector().fit(train, FEATURES, "y")
    normal = fitted.score(train.where("y = 0"))
    row = normal.agg(F.count("*").alias("normal_rows"), F.sum("prediction").alias("hits"))
    floor = F.floor(F.col("normal_rows") * F.lit(0.05)).cast("bigint")
    return row.select("normal_rows", floor.alias("flagged_floor"), (F.abs(F.col("hits") - floor) <= 1).alias("flags_five_percent"))


@query(
    "j17_autoencoder_energy",
    on_flows(
        "SELECT count(*) AS normal_rows, CAST(floor(count(*) * CAST(0.05 AS DOUBLE)) AS BIGINT) AS flagged_floor, true AS flags_five_percent FROM placed WHERE place > quota AND y = 0",
        **LEARNABLE,
    ),
)
def autoencoder_energies(spark, sf_dir):
    train, _ = learnable_parts(spark, sf_dir)
    fitted = ReconstructionDetector().fit(train, FEATURES, "y")
    row = fitted.score(train.where("y = 0")).agg(F.count("*").alias("normal_rows"), F.sum("prediction").alias("hits"))
    floor = F.floor(F.col("normal_rows") * F.lit(0.05)).cast("bigint")
    return row.select("normal_rows", floor.alias("flagged_floor"), (F.abs(F.col("hits") - floor) <= 1).alias("flags_five_percent"))


_NB = tuple(COMMON)


def _log_density(y: int) -> str:
    parts = " + ".join(f"ln(2 * pi() * (v{i}_{y} + e)) + ({c} - m{i}_{y}) * ({c} - m{i}_{y}) / (v{i}_{y} + e)" for i, c in enumerate(_NB))
    return f"ln(p_{y}) - 0.5 * ({parts})"


_NB_STEPS = {
    **ranked_steps("prepared", "flow_id", "CAST(label AS VARCHAR)", "ceil(t * CAST(0.2 AS DOUBLE))"),
    "train": "SELECT * FROM placed WHERE place > quota",
    "fitted": "SELECT CAST(1e-9 AS DOUBLE) * greatest(" + ", ".join(f"var_pop({c})" for c in _NB) + ") AS e, "
    + ", ".join(f"avg({c}) FILTER (label = {y}) AS m{i}_{y}, var_pop({c}) FILTER (label = {y}) AS v{i}_{y}" for i, c in enumerate(_NB) for y in (0, 1))
    + ", " + ", ".join(f"avg(CASE WHEN label = {y} THEN 1 ELSE 0 END) AS p_{y}" for y in (0, 1)) + " FROM train",
}


@query("j8_gaussian_naive_bayes", on_prepared(f"SELECT flow_id, CASE WHEN {_log_density(0)} >= {_log_density(1)} THEN 0 ELSE 1 END AS prediction, round(1 / (1 + exp(({_log_density(0)}) - ({_log_density(1)}))), 6) AS probability FROM placed, fitted WHERE place <= quota", **_NB_STEPS))
def naive_bayes(spark, sf_dir):
    parts = splits.random_parts(prepared(spark, sf_dir), KEY, 0.2, 42, "label")
    fitted = GaussianNaiveBayes().fit(parts.where("part = 'train'"), list(_NB), "label")
    scored = fitted.score(parts.where("part = 'test'"))
    return round_all(scored.select("flow_id", "prediction", "probability"), ["probability"])


_P = len(_NB)
_PLACES = range(1, _P + 1)


def _discriminant_check(shrunk: bool) -> str:
    """Every step in SQL: moments by class, correlations of class-centred rows, Gauss-Jordan elimination, linear scores."""
    cells = ", ".join(f"({c} - CASE label WHEN 0 THEN m{i}_0 ELSE m{i}_1 END) AS c{i}" for i, c in enumerate(_NB))
    divisor = "count(*)" if shrunk else "(count(*) - 2)"
    share = "least(noise, distance) / distance" if shrunk else "0"
    pairs = "[" + ", ".join("[" + ", ".join(f"avg(c{i} * c{j}) / sqrt(avg(c{i} * c{i}) * avg(c{j} * c{j}))" for j in range(_P)) + "]" for i in range(_P)) + "]"
    steps = {
        **_NB_STEPS,
        "means": "SELECT " + ", ".join(f"avg({c}) FILTER (label = {y}) AS m{i}_{y}" for i, c in enumerate(_NB) for y in (0, 1)) + ", " + ", ".join(f"avg(CASE WHEN label = {y} THEN 1 ELSE 0 END) AS p_{y}" for y in (0, 1)) + " FROM train",
        "centred": f"SELECT {cells} FROM train, means",
        "spreads": f"SELECT [{', '.join(f'sqrt(sum(c{i} * c{i}) / {divisor})' for i in range(_P))}] AS s, {pairs} AS corr, count(*) AS n FROM centred",
        "lengths": "SELECT avg(q * q) AS fourth FROM (SELECT " + " + ".join(f"(c{i} / s[{i + 1}]) * (c{i} / s[{i + 1}])" for i in range(_P)) + " AS q FROM centred, spreads)",
        "shrinkage": f"SELECT (fourth - squares) / ({_P} * n) AS noise, (squares - {_P}) / {_P} AS distance FROM (SELECT n, fourth, list_sum(list_transform(corr, lambda r: list_sum(list_transform(r, lambda v: v * v)))) AS squares FROM spreads, lengths)",
        "start": f"SELECT list_transform(corr, lambda r, i: list_concat(list_transform(r, lambda v, j: CASE WHEN i = j THEN CAST(1 AS DOUBLE) ELSE (1 - {share}) * v END), list_transform(range(1, {_P + 1}), lambda j: CASE WHEN i = j THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END))) AS m FROM spreads, shrinkage",
        "reduced": "SELECT 0 AS k, m FROM start",
    }
    for k in _PLACES:
        # One step of the elimination: row k is scaled, the others lose column k.
        before = "reduced" if k == 1 else f"reduced{k - 1}"
        steps[f"reduced{k}"] = f"SELECT list_transform(m, lambda r, i: list_transform(r, lambda v, j: CASE WHEN i = {k} THEN v / r[{k}] ELSE v - r[{k}] / m[{k}][{k}] * m[{k}][j] END)) AS m FROM {before}"
    weight = lambda i, y: "(" + " + ".join(f"m[{i + 1}][{_P + j + 1}] * m{j}_{y} / s[{j + 1}]" for j in range(_P)) + f") / s[{i + 1}]"
    steps["weights"] = "SELECT " + ", ".join(f"{weight(i, y)} AS w{i}_{y}" for i in range(_P) for y in (0, 1)) + f" FROM reduced{_P}, spreads, means"
    score = lambda y: f"(ln(p_{y}) + " + " + ".join(f"({c} - 0.5 * m{i}_{y}) * w{i}_{y}" for i, c in enumerate(_NB)) + ")"
    return on_prepared(
        f"SELECT flow_id, CASE WHEN {score(0)} >= {score(1)} THEN 0 ELSE 1 END AS prediction, round(1 / (1 + exp({score(0)} - {score(1)})), 6) AS probability FROM placed, means, weights WHERE place <= quota",
        **steps,
    )


def _discriminant(spark, sf_dir, shrinkage):
    parts = splits.random_parts(prepared(spark, sf_dir), KEY, 0.2, 42, "label")
    fitted = LinearDiscriminant(shrinkage).fit(parts.where("part = 'train'"), list(_NB), "label")
    scored = fitted.score(parts.where("part = 'test'"))
    return round_all(scored.select("flow_id", "prediction", "probability"), ["probability"])


@query("j10_linear_discriminant", _discriminant_check(False))
def discriminant(spark, sf_dir):
    return _discriminant(spark, sf_dir, None)


@query("j10_shrunk_discriminant", _discriminant_check(True))
def shrunk_discriminant(spark, sf_dir):
    return _discriminant(spark, sf_dir, "auto")


_KNN_D = "sqrt(" + " + ".join(f"((a.{c} - b.{c}) / s_{c}) * ((a.{c} - b.{c}) / s_{c})" for c in COMMON) + ")"


@query(
    "j9_nearest_neighbours",
    on_flows(
        """SELECT flow_id, CASE WHEN sum(CASE WHEN y = 1 THEN w ELSE 0 END) > sum(CASE WHEN y = 0 THEN w ELSE 0 END) THEN 1 ELSE 0 END AS prediction FROM
        (SELECT flow_id, y, CASE WHEN least0 = 0 THEN CASE WHEN d = 0 THEN 1.0 ELSE 0.0 END ELSE 1.0 / d END AS w FROM
          (SELECT *, min(d) OVER (PARTITION BY flow_id) AS least0 FROM
            (SELECT a.flow_id, b.y, """
        + _KNN_D
        + """ AS d, row_number() OVER (PARTITION BY a.flow_id ORDER BY """
        + _KNN_D
        + """, b.y) AS r FROM test a, train b, widths) WHERE r <= 5)) GROUP BY 1""",
        **LEARNABLE,
        test="SELECT * FROM placed WHERE place <= quota",
        train="SELECT * FROM placed WHERE place > quota",
        widths="SELECT " + ", ".join(f"CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END AS s_{c}" for c in COMMON) + " FROM train",
    ),
)
def nearest_neighbours(spark, sf_dir):
    train, test = learnable_parts(spark, sf_dir)
    return NearestNeighbours().fit(train, FEATURES, "y").score(test).select("flow_id", "prediction")


@query(
    "j18_scores_of_models",
    on_flows(
        "SELECT d AS detector, kind, count(*) AS n, true AS fits FROM placed, (VALUES ('softmax', 'probability'), ('random_forest', 'probability'), ('network', 'probability'), ('linear_svm', 'margin')) v(d, kind) WHERE place <= quota GROUP BY 1, 2",
        **LEARNABLE,
    ),
)
def scores_of_models(spark, sf_dir):
    """Probabilities lie in 0 to 1, margins have the sign of the prediction; a model gives one or the other."""
    train, test = learnable_parts(spark, sf_dir)
    out = None
    for detector in (softmax(), random_forest(), network(), linear_svm()):
        scored = detector.fit(train, FEATURES, "y").score(test)
        kind = "probability" if "probability" in scored.columns else "margin"
        value = F.col(kind)
        fits = (value >= 0) & (value <= 1) if kind == "probability" else (value > 0) == (F.col("prediction") == 1)
        part = scored.agg(F.count(kind).alias("n"), F.bool_and(fits).alias("fits")).select(F.lit(detector.name).alias("detector"), F.lit(kind).alias("kind"), "n", "fits")
        out = part if out is None else out.unionByName(part)
    return out


_MAJORITY = """SELECT 'majority' AS model_id, 'success' AS status, 'binary' AS problem_type, round(greatest(avg(y), 1 - avg(y)), 6) AS accuracy, CAST(0.5 AS DOUBLE) AS balanced_accuracy,
  CAST(2 AS BIGINT) AS num_classes_true, CAST(1 AS BIGINT) AS num_classes_pred, NULL AS error, true AS beats_majority FROM placed WHERE place <= quota"""


@query(
    "r1_run_detectors",
    on_flows(
        f"{_MAJORITY} UNION ALL SELECT 'decision_tree', 'success', 'binary', NULL, NULL, 2, 2, NULL, true FROM placed HAVING count(*) > 0 "
        "UNION ALL SELECT 'broken', 'failed', NULL, NULL, NULL, NULL, NULL, repeat('this detector cannot be fitted. ', 40), NULL FROM placed HAVING count(*) > 0",
        **LEARNABLE,
    ),
)
def all_detectors(spark, sf_dir):
    class Broken:
        name = "broken"

        def fit(self, train, features, label):
            raise ValueError("this detector cannot be fitted. " * 40)

    train, test = learnable_parts(spark, sf_dir)
    rows = run_detectors([MajorityBaseline(), decision_tree(), Broken()], train, test, FEATURES, "y", "flows")
    fixed = F.col("model_id") == "majority"  # its scores follow from the labels
    better = F.col("balanced_accuracy") >= F.when(fixed, 0.5).otherwise(0.95)
    return rows.select(
        "model_id", "status", "problem_type", F.when(fixed, F.round("accuracy", 6)).alias("accuracy"), F.when(fixed, F.col("balanced_accuracy")).alias("balanced_accuracy"),
        "num_classes_true", "num_classes_pred", "error", better.alias("beats_majority"),
    )


@query("r2_tuned_threshold", facts_check("softmax", "threshold_in_range"))
def tuned(spark, sf_dir):
    train, test = learnable_parts(spark, sf_dir)
    detector = softmax()
    fitted, threshold = tuned_threshold(detector, train, FEATURES, "y", KEY)
    both = metrics.apply_threshold(fitted.score(test), "probability", threshold)
    counts = metrics.binary_metrics(metrics.confusion(both, "y", "prediction"))
    return counts.select(
        F.lit(detector.name).alias("detector"),
        (F.col("support_0") + F.col("support_1")).alias("test_rows"),
        F.col("support_1").alias("attacks"),
        F.lit(0.05 <= threshold <= 0.95).alias("threshold_in_range"),
    )


# --- outside models, folds -----------------------------------------------------------------------------------------


class RateModel:
    """An outside model: a logistic curve over the packet rate, on arrays."""

    def predict_proba(self, rows):
        import numpy as np

        p = 1 / (1 + np.exp(-(rows[:, 0] - 3000) / 1000))
        return np.stack([1 - p, p], axis=1)

    def predict(self, rows):
        return (rows[:, 0] >= 3000) & (rows[:, 1] <= 3)


@query(
    "m_outside_model",
    on_flows("SELECT flow_id, CASE WHEN flow_packets_s >= 3000 AND total_bwd_packets <= 3 THEN 1 ELSE 0 END AS prediction, round(1 / (1 + exp(-(flow_packets_s - 3000) / 1000)), 6) AS probability FROM flows"),
)
def outside_model(spark, sf_dir):
    fitted = ExternalDetector(RateModel, ["flow_packets_s", "total_bwd_packets"])
    scored = fitted.score(flows(spark, sf_dir)).select("flow_id", "prediction", "probability")
    return round_all(scored, ["probability"])


_FOLD_NB = {
    "folded": f"SELECT *, {_FOLD} AS fold FROM prepared",
    "fitted": "SELECT f AS fold, CAST(1e-9 AS DOUBLE) * greatest(" + ", ".join(f"var_pop({c})" for c in _NB) + ") AS e, "
    + ", ".join(f"avg({c}) FILTER (label = {y}) AS m{i}_{y}, var_pop({c}) FILTER (label = {y}) AS v{i}_{y}" for i, c in enumerate(_NB) for y in (0, 1))
    + ", " + ", ".join(f"avg(CASE WHEN label = {y} THEN 1 ELSE 0 END) AS p_{y}" for y in (0, 1)) + " FROM folded, generate_series(0, 4) g(f) WHERE fold <> f GROUP BY f",
    "guessed": f"SELECT t.fold, label, CASE WHEN {_log_density(0)} >= {_log_density(1)} THEN 0 ELSE 1 END AS guess FROM folded t JOIN fitted ON t.fold = fitted.fold",
}


@query(
    "n6_cross_validation",
    on_prepared(
        "SELECT fold, " + ", ".join(f"count(CASE WHEN label = {t} AND guess = {p} THEN 1 END) AS {n}" for n, t, p in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))) + " FROM guessed GROUP BY 1",
        **_FOLD_NB,
    ),
)
def cross_validated(spark, sf_dir):
    """Naive Bayes fitted on four folds and scored on the fifth, for each of the five."""
    return cross_validation(GaussianNaiveBayes(), prepared(spark, sf_dir), list(_NB), "label", KEY, 5)


# --- features by class, time features, profiles of intervals -------------------------------------------------------


def _pair_anova(c: str) -> str:
    return (
        f"SELECT a.class, '{c}' AS feature, round((a.n * (a.m - g) * (a.m - g) + b.n * (b.m - g) * (b.m - g)) / ((a.n * a.v + b.n * b.v) / (a.n + b.n - 2)), 4) AS f_score FROM "
        f"(SELECT a.*, b.n AS bn, (a.n * a.m + b.n * b.m) / (a.n + b.n) AS g FROM mom_{c} a, mom_{c} b WHERE a.class <> 'Benign' AND b.class = 'Benign') a, mom_{c} b WHERE b.class = 'Benign'"
    )


@query(
    "n5_features_by_attack",
    on_prepared(
        " UNION ALL ".join(_pair_anova(c) for c in COMMON),
        **{f"mom_{c}": f"SELECT class, CAST(count({c}) AS DOUBLE) AS n, avg({c}) AS m, var_pop({c}) AS v FROM prepared GROUP BY 1" for c in COMMON},
    ),
)
def features_by_attack(spark, sf_dir):
    return round_all(anova_by_class(prepared(spark, sf_dir), COMMON, "class", "Benign"), ["f_score"], 4)


_FEATURE_SETS = {"all": tuple(COMMON), "time": ("flow_duration", "flow_bytes_s", "flow_packets_s")}


def _bayes_accuracy(name: str, features: tuple[str, ...]) -> str:
    """Rows, hits and detected attacks of naive Bayes on some features, from the moments in ``train``."""
    e = "(SELECT CAST(1e-9 AS DOUBLE) * greatest(" + ", ".join(f"var_pop({c})" for c in features) + ") FROM train)"
    moments = ", ".join(f"avg({c}) FILTER (label = {y}) AS m{i}_{y}, var_pop({c}) FILTER (label = {y}) + {e} AS v{i}_{y}" for i, c in enumerate(features) for y in (0, 1))
    shares = ", ".join(f"avg(CASE WHEN label = {y} THEN 1 ELSE 0 END) AS p_{y}" for y in (0, 1))
    log = lambda y: f"ln(p_{y}) - 0.5 * (" + " + ".join(f"ln(2 * pi() * v{i}_{y}) + ({c} - m{i}_{y}) * ({c} - m{i}_{y}) / v{i}_{y}" for i, c in enumerate(features)) + ")"
    guess = f"CASE WHEN {log(0)} >= {log(1)} THEN 0 ELSE 1 END"
    return (
        f"SELECT '{name}' AS subset, CAST({len(features)} AS BIGINT) AS n_features, count(*) AS test_rows, count(CASE WHEN guess = label THEN 1 END) AS hits, "
        f"count(CASE WHEN guess = 1 AND label = 1 THEN 1 END) AS detected FROM (SELECT label, {guess} AS guess FROM placed, (SELECT {moments}, {shares} FROM train) WHERE place <= quota)"
    )


@query("n3_time_features", on_prepared(" UNION ALL ".join(_bayes_accuracy(n, f) for n, f in _FEATURE_SETS.items()), **{k: v for k, v in _NB_STEPS.items() if k != "fitted"}))
def time_features(spark, sf_dir):
    """One detector on all features and on those that hold a time alone."""
    from flowbench.operators.select import resolve_features
    from flowbench.specs import FeatureSet

    parts = splits.random_parts(prepared(spark, sf_dir), KEY, 0.2, 42, "label")
    train, test = parts.where("part = 'train'"), parts.where("part = 'test'")
    out = None
    for name, wanted in _FEATURE_SETS.items():
        features = resolve_features(train, FeatureSet(name, wanted), [], "label")
        scored = GaussianNaiveBayes().fit(train, features, "label").score(test)
        part = scored.agg(
            F.count("*").alias("test_rows"), F.count_if(F.expr("prediction = label")).alias("hits"), F.count_if(F.expr("prediction = 1 AND label = 1")).alias("detected")
        ).select(F.lit(name).alias("subset"), F.lit(len(features)).cast("bigint").alias("n_features"), "test_rows", "hits", "detected")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "n8_interval_profile",
    on_flows(
        "SELECT start_us, flows, tuples, round(variance, 6) AS variance, 1 + CAST(flows > q1 AS INTEGER) + CAST(flows > q2 AS INTEGER) + CAST(flows > q3 AS INTEGER) + CAST(flows > q4 AS INTEGER) AS level FROM spans, "
        "(SELECT quantile_cont(CAST(flows AS DOUBLE), 0.2) AS q1, quantile_cont(CAST(flows AS DOUBLE), 0.4) AS q2, quantile_cont(CAST(flows AS DOUBLE), 0.6) AS q3, quantile_cont(CAST(flows AS DOUBLE), 0.8) AS q4 FROM spans)",
        spans="SELECT epoch_us(flow_start_ts) // 3600000000 * 3600000000 AS start_us, count(*) AS flows, count(DISTINCT (src_host, class)) AS tuples, var_pop(total_fwd_bytes) AS variance FROM flows GROUP BY 1",
    ),
)
def interval_profile(spark, sf_dir):
    from flowbench.operators.profile import interval_levels

    out = interval_levels(flows(spark, sf_dir), "flow_start_ts", 3600, ["src_host", "class"], "total_fwd_bytes")
    return round_all(out, ["variance"])
