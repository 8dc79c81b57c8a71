"""The random forest over blocks against MLlib's, its bound of depth, and what is left to MLlib."""

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.sql import functions as F

from flowbench.operators import deeptrees
from flowbench.operators.blockforest import BlockForest, ForestModel, _columns
from flowbench.operators.learners import TARGET, VECTOR, WEIGHT, FittedLearner, assemble, random_forest

CELLS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(1500, 3))
    y = ((x[:, 0] * x[:, 1] > 0) != (rng.random(1500) < 0.05)).astype(int)
    return spark.createDataFrame([(i, *map(float, r), int(k)) for i, (r, k) in enumerate(zip(x, y))], "i int, a double, b double, c double, y int").persist()


def test_forest_grows_over_blocks_and_comes_back(spark, table, tmp_path, monkeypatch):
    """MLlib grows no tree, and the saved model scores the same."""
    monkeypatch.setattr(RandomForestClassifier, "_fit", lambda self, rows: pytest.fail("grown node by node"))
    monkeypatch.setattr(deeptrees, "SMALL", 200)
    train, test = table.where("i % 4 > 0"), table.where("i % 4 = 0")
    fitted = random_forest(20).fit(train, CELLS, "y")
    assert isinstance(fitted.model, ForestModel) and len(fitted.model.forest.tops) == 20
    scored = fitted.score(test).toPandas().sort_values("i")
    assert (scored["prediction"] == scored["y"]).mean() > 0.85 and scored["probability"].between(0, 1).all() and scored["probability"].nunique() > 10
    fitted.save(spark, f"{tmp_path}/m")
    again = FittedLearner.load(spark, f"{tmp_path}/m", "random_forest").score(test).toPandas().sort_values("i")
    assert np.allclose(again["probability"], scored["probability"]) and (again["prediction"].to_numpy() == scored["prediction"].to_numpy()).all()


def test_probabilities_come_close_to_those_of_mllib(table):
    rows = assemble(table, CELLS, None).withColumn(TARGET, F.col("y").cast("double"))
    options = dict(featuresCol=VECTOR, labelCol=TARGET, numTrees=40, maxDepth=6, seed=3)
    own, theirs = (cls(**options).fit(rows).transform(rows).orderBy("i").select("probability", "rawPrediction", "prediction").toPandas() for cls in (BlockForest, RandomForestClassifier))
    p, q = (np.stack([v.toArray() for v in t["probability"]]) for t in (own, theirs))
    assert np.abs(p - q).mean() < 0.1 and np.corrcoef(p[:, 1], q[:, 1])[0, 1] > 0.9
    assert np.allclose(np.stack([v.toArray() for v in own["rawPrediction"]]), 40 * p) and (own["prediction"] == p.argmax(axis=1)).all()


@pytest.mark.parametrize("small", [20_000, 100])
@pytest.mark.parametrize("depth", [0, 1, 3])
def test_depth_is_bounded(table, monkeypatch, small, depth):
    """Whether nodes are split in blocks or in one task; nodes at the bound keep their shares."""
    monkeypatch.setattr(deeptrees, "SMALL", small)
    rows = assemble(table, CELLS, None).withColumn(TARGET, F.col("y").cast("double"))
    forest = BlockForest(featuresCol=VECTOR, labelCol=TARGET, numTrees=5, maxDepth=depth, seed=1).fit(rows).forest
    for t, top in enumerate(forest.tops):
        parts = {r["node"]: deeptrees.Part(**deeptrees.json.loads(r["body"])) for r in forest.parts.where(F.col("tree") == t).collect()}
        whole = deeptrees.grafted(top, parts)
        levels = deeptrees.Part(*(v.tolist() for v in (whole.feature, whole.limit, whole.left, whole.right, whole.weights))).levels()
        inner, weights = whole.left >= 0, np.asarray(whole.weights)
        assert levels.max() == depth and weights[0].sum() > 1000
        assert np.allclose(weights[inner], weights[whole.left[inner]] + weights[whole.right[inner]])


def test_what_blocks_lack_is_left_to_mllib(table):
    rows = assemble(table, CELLS, None).withColumn(TARGET, F.col("y").cast("double")).withColumn(WEIGHT, 1.0 + F.col("i") % 2)
    options = dict(featuresCol=VECTOR, labelCol=TARGET, numTrees=2, maxDepth=2)
    for other in (dict(impurity="entropy"), dict(subsamplingRate=0.5), dict(weightCol=WEIGHT)):
        assert isinstance(BlockForest(**options, **other).fit(rows), RandomForestClassificationModel)
    assert isinstance(BlockForest(**options, weightCol="y1").fit(rows.withColumn("y1", F.col("y") + 1.0)), ForestModel)


def test_labels_and_drawn_features(spark):
    """Labels that the training rows lack have a place, as in MLlib."""
    one = spark.createDataFrame([(1.0, 1), (2.0, 1)], "a double, y int")
    scored = random_forest(2).fit(one, ["a"], "y").score(one).toPandas()
    assert set(scored["prediction"]) == {1} and set(scored["probability"]) == {1.0}
    more = spark.createDataFrame([(float(i), 2 * (i > 9)) for i in range(20)], "a double, y int")
    scored = random_forest(9).fit(more, ["a"], "y").score(more).toPandas()
    assert (scored["prediction"] == scored["y"]).mean() > 0.8 and all(len(p) == 3 and p[1] == 0 for p in scored["probabilities"])
    assert [_columns(s, 21, 200) for s in ("auto", "sqrt", "all", "log2", "onethird", "4", "0.5")] == [5, 5, 21, 5, 7, 4, 11]
