import importlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowbench.operators.anomaly import ClusterDetector, EnergyDetector
from flowbench.operators.baseline import MajorityBaseline
from flowbench.operators.boosting import AdaBoost
from flowbench.operators.external import ExternalDetector
from flowbench.operators.gaussian import GaussianNaiveBayes, LinearDiscriminant
from flowbench.operators.kernels import KernelSvm
from flowbench.operators.learners import FittedLearner, boosted_trees, decision_tree, linear_svm, softmax
from flowbench.operators.neighbours import NearestNeighbours
from flowbench.plans.experiment import evaluate, run_detectors, tuned_threshold


@pytest.fixture(scope="module")
def three_classes(spark):
    draw = np.random.default_rng(5)
    y = np.repeat([0, 1, 2], 200)
    x = draw.normal(size=(600, 3)) + np.array([[0, 0, 0], [4, 0, 1], [0, 5, -1]])[y]
    rows = [(i, *map(float, r), int(k)) for i, (r, k) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "i long, a double, b double, c double, y int").persist()


@pytest.fixture(scope="module")
def two_classes(three_classes):
    return three_classes.where("y < 2").persist()


def accuracy(fitted, df):
    return fitted.score(df).agg(F.avg((F.col("prediction") == F.col("y")).cast("double"))).first()[0]


FEATURES = ["a", "b", "c"]


def test_majority_tie_goes_to_the_smaller_label(two_classes):
    fitted = MajorityBaseline().fit(two_classes, FEATURES, "y")
    assert fitted.majority == 0 and fitted.counts == {0: 200, 1: 200}
    with pytest.raises(ValueError):
        MajorityBaseline().fit(two_classes.where("y > 5"), FEATURES, "y")


@pytest.mark.parametrize("detector", [GaussianNaiveBayes(), LinearDiscriminant(), LinearDiscriminant(shrinkage=0.2), AdaBoost(rounds=25, settle_every=10), decision_tree(depth=4, anova_k=2, rfe_features=1)], ids=lambda d: d.name)
def test_three_classes(detector, three_classes):
    floor = 0.55 if detector.name == "decision_tree" else 0.9
    assert accuracy(detector.fit(three_classes, FEATURES, "y"), three_classes) > floor


def test_boosted_trees_of_three_classes(three_classes):
    assert accuracy(boosted_trees(rounds=3, depth=3).fit(three_classes, FEATURES, "y"), three_classes) > 0.9


@pytest.mark.parametrize("detector", [linear_svm(iterations=20), KernelSvm(size=32, iterations=20), softmax(20)], ids=lambda d: d.name)
def test_two_classes(detector, two_classes):
    assert accuracy(detector.fit(two_classes, FEATURES, "y"), two_classes) > 0.9


def test_discriminant_equals_numpy(three_classes):
    fitted = LinearDiscriminant().fit(three_classes, FEATURES, "y")
    rows = np.array([tuple(r) for r in three_classes.select(*FEATURES, "y").collect()])
    x, y = rows[:, :3], rows[:, 3].astype(int)
    means = np.array([x[y == k].mean(axis=0) for k in range(3)])
    scatter = sum((x[y == k] - means[k]).T @ (x[y == k] - means[k]) for k in range(3)) / (len(x) - 3)
    for k in range(3):
        assert fitted.weights[k] == pytest.approx(list(np.linalg.solve(scatter, means[k])), rel=1e-6)


def test_boosting_stops_at_a_perfect_split(spark):
    df = spark.createDataFrame([(float(i), int(i >= 50)) for i in range(100)], "x double, y int")
    fitted = AdaBoost(rounds=50, bins=200).fit(df, ["x"], "y")
    assert len(fitted.stumps) == 1
    scored = fitted.score(df)
    assert scored.where("prediction <> y").count() == 0


def test_boosting_with_one_class(spark):
    df = spark.createDataFrame([(1.0, 0), (2.0, 0)], "x double, y int")
    assert {r["prediction"] for r in AdaBoost(rounds=3).fit(df, ["x"], "y").score(df).collect()} == {0}


def brute_force(train, test, k, by_distance=True):
    out = []
    for q in test:
        total = np.zeros(len(train))
        for j in range(len(q)):
            gap = q[j] - train[:, j]
            total += gap * gap
        d = np.sqrt(total)
        order = np.lexsort((train[:, -1], d))[:k]
        near, y = d[order], train[order, -1].astype(int)
        w = (near == 0).astype(float) if near[0] == 0 else 1 / near
        if not by_distance:
            w = np.ones(len(near))
        sums = np.bincount(y, weights=w)
        out.append(int(np.argmax(sums)))
    return out


@pytest.mark.parametrize("by_distance", [True, False])
def test_neighbours_equal_brute_force(spark, by_distance):
    draw = np.random.default_rng(9)
    n = 900
    x = np.round(draw.normal(size=(n, 2)), 1)  # many equal distances
    x[: n // 3] = [0.3, 0.3]  # a third of the rows are copies
    y = draw.integers(0, 3, n)
    train = np.column_stack([x, y])
    test = np.vstack([np.round(draw.normal(size=(80, 2)), 1), np.repeat([[0.3, 0.3]], 40, axis=0), [[50.0, 50.0]]])
    left = spark.createDataFrame([(*map(float, r[:2]), int(r[2])) for r in train], "a double, b double, y int")
    right = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(test)], "i int, a double, b double")
    # Blocks of 20 rows force several blocks per cell and several crowds of test rows.
    fitted = NearestNeighbours(k=5, by_distance=by_distance, scale=False, pivots=6, block=20).fit(left, ["a", "b"], "y")
    got = [r["prediction"] for r in fitted.score(right).orderBy("i").collect()]
    expected = brute_force(train, test, 5, by_distance)
    assert len(got) == len(expected) and got == expected


def test_neighbours_with_fewer_rows_than_k(spark):
    train = spark.createDataFrame([(0.0, 0), (10.0, 1)], "a double, y int")
    fitted = NearestNeighbours(k=5).fit(train, ["a"], "y")
    test = spark.createDataFrame([(1.0,), (9.0,), (10.0,)], "a double")
    assert [r["prediction"] for r in fitted.score(test).orderBy("a").collect()] == [0, 1, 1]


def test_clusters_are_capped_by_classes(two_classes):
    fitted = ClusterDetector(clusters=50, starts=2).fit(two_classes, FEATURES, "y")
    assert fitted.model.summary is not None and len(fitted.model.clusterCenters()) == 2
    assert accuracy(fitted, two_classes) > 0.9
    one = ClusterDetector(clusters=50).fit(two_classes.where("y = 1"), FEATURES, "y")
    assert {r["prediction"] for r in one.score(two_classes).collect()} == {1}


def test_energy_is_the_mean_squared_gap(three_classes):
    fitted = EnergyDetector(encoding=1).fit(three_classes, FEATURES, "y")
    rows = fitted.energy(three_classes).select(*FEATURES, "energy").limit(20).collect()
    scale = np.array([fitted.stats[c] for c in FEATURES])
    axis = np.array(fitted.components)
    for r in rows:
        z = (np.array(r[:3]) - scale[:, 0]) / scale[:, 1] - np.array(fitted.centre)
        assert r["energy"] == pytest.approx(np.mean((z - axis.T @ (axis @ z)) ** 2))
    flagged = fitted.score(three_classes.where("y = 0")).agg(F.sum("prediction")).first()[0]
    assert flagged == 10  # 5 % of 200


def test_energy_without_normal_rows_uses_all(three_classes):
    fitted = EnergyDetector(encoding=2).fit(three_classes.where("y > 0"), FEATURES, "y")
    assert fitted.rule.threshold >= 0


def test_saved_detector(spark, two_classes, tmp_path):
    fitted = softmax(20).fit(two_classes, FEATURES, "y")
    fitted.save(spark, str(tmp_path / "m"))
    again = FittedLearner.load(spark, str(tmp_path / "m"), "softmax")
    assert again.features == FEATURES and again.facts["label_counts"] == {"0": 200, "1": 200}
    both = fitted.score(two_classes).select("i", F.col("probability").alias("p")).join(
        again.score(two_classes).select("i", "probability"), "i"
    )
    assert both.where("abs(p - probability) > 1e-12").count() == 0
    with pytest.raises(ValueError, match="not 'random_forest'"):
        FittedLearner.load(spark, str(tmp_path / "m"), "random_forest")
    with pytest.raises(ValueError, match="missing columns"):
        again.score(two_classes.drop("a"))


def test_threshold_is_tuned_and_both_are_reported(two_classes):
    fitted, threshold = tuned_threshold(softmax(20), two_classes, FEATURES, "y", ["i"])
    assert 0.05 <= threshold <= 0.95
    rows = {r["rule"]: r for r in evaluate(fitted, two_classes, "y", threshold).collect()}
    assert set(rows) == {"chosen", "default"} and rows["default"]["accuracy"] > 0.9


def test_a_failing_detector_does_not_stop_the_others(two_classes):
    class Broken:
        name = "broken"

        def fit(self, train, features, label):
            raise RuntimeError("no such library")

    rows = {r["model_id"]: r for r in run_detectors([Broken(), MajorityBaseline()], two_classes, two_classes, FEATURES, "y", "d").collect()}
    assert rows["broken"]["status"] == "failed" and rows["broken"]["accuracy"] is None and "library" in rows["broken"]["error"]
    assert rows["majority"]["status"] == "success" and rows["majority"]["accuracy"] == 0.5
    with pytest.raises(RuntimeError):
        run_detectors([Broken()], two_classes, two_classes, FEATURES, "y", "d", stop_on_error=True)


def test_outside_models_score_batches(two_classes):
    class Rule:
        def predict(self, rows):
            return (rows[:, 0] > 2).astype(int)

    class WithProbability(Rule):
        def predict_proba(self, rows):
            p = 1 / (1 + np.exp(2 - rows[:, 0]))
            return np.column_stack([1 - p, p])

    scored = ExternalDetector(WithProbability, ["a"]).score(two_classes)
    assert scored.where("(a > 2) <> (prediction = 1) OR abs(probability - 1 / (1 + exp(2 - a))) > 1e-9").count() == 0
    assert ExternalDetector(Rule, ["a"]).score(two_classes).where("probability IS NOT NULL").count() == 0


@pytest.mark.parametrize("name, module, made", [
    ("j4_boosted_trees", "queries_learners", ["boosted_trees"]),
    ("j5_random_forest", "queries_learners", ["random_forest"]),
    ("j11_kernel_svm", "queries_learners", ["KernelSvm"]),
    ("j17_energy_detector", "queries_learners", ["EnergyDetector"]),
    ("j18_scores_of_models", "queries_learners", ["softmax", "random_forest", "network", "linear_svm"]),
    ("j20_saved_detector", "queries_artefacts", ["random_forest"]),
])
def test_queries_use_the_detectors_defaults(monkeypatch, name, module, made):
    class Asked(Exception):
        pass

    class Stub:
        name = "stub"

        def fit(self, *args):
            raise Asked

    module, calls = importlib.import_module(f"flowbench.plans.{module}"), []
    for m in {module, importlib.import_module("flowbench.plans.queries_learners")}:
        monkeypatch.setattr(m, "learnable_parts", lambda *a: (None, None))
    for d in made:
        monkeypatch.setattr(module, d, lambda *a, d=d, **k: calls.append((d, a, k)) or Stub())
    if hasattr(module, "shared_folder"):
        monkeypatch.setattr(module, "shared_folder", lambda *a: "")
    with pytest.raises(Asked):
        importlib.import_module("__spark_entry__").queries()[name](None, "")
    assert calls == [(d, (), {}) for d in made]


def test_a_known_bound_leaves_few_cells_and_rows():
    from flowbench.operators.neighbours import _close, _visits

    rng = np.random.default_rng(3)
    rows, tests = rng.normal(size=(500, 4)), rng.normal(size=(20, 4))
    gaps = np.sqrt(((tests[:, None] - rows) ** 2).sum(axis=2))
    far = np.sort(gaps, axis=1)[:, 4]
    whole = np.ones(500, np.int64)
    for bound in (far, np.full(20, np.inf)):
        for test, close, d in _close(tests, bound, rows, whole, whole, 5):
            assert test.tolist() == np.repeat(np.arange(20), 5).tolist() and np.allclose(d.reshape(20, 5), np.sort(gaps, axis=1)[:, :5])
    import pandas as pd

    pivots, cells = rows[:50], {i: (1.0, 0.9) for i in range(50)}
    seen = [len(next(_visits(pivots, cells)([pd.DataFrame({"_q": range(20), "_v": list(tests), "far": f})]))) for f in (far, np.inf)]
    assert seen[0] < seen[1]
