"""Boosted trees over blocks against trees grown row by row and against MLlib's."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.sql import functions as F

from flowbench.operators.learners import TARGET, VECTOR, assemble, boosted_trees
from flowbench.sources.detectors import load_detector, save_detector

CELLS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(900, 3)), 1)
    y = ((x[:, 0] * x[:, 1] > 0) != (rng.random(900) < 0.05)).astype(int)
    return spark.createDataFrame([(i, *map(float, r), int(k)) for i, (r, k) in enumerate(zip(x, y))], "i int, a double, b double, c double, y int").persist()


def plain(x, target, depth, limits):
    """Values of the least-squares tree on the given limits."""
    out = np.full(len(x), target.mean())
    worth = lambda t: t.sum() ** 2 / len(t) if len(t) else 0.0
    best = (1e-9, None)
    for f in range(x.shape[1]) if depth else ():
        for v in limits[f]:
            low = x[:, f] <= v
            if 0 < low.sum() < len(x):
                gain = worth(target[low]) + worth(target[~low]) - worth(target)
                if gain > best[0] * (1 + 1e-9):
                    best = (gain, low)
    if best[1] is not None:
        for side in (best[1], ~best[1]):
            out[side] = plain(x[side], target[side], depth - 1, limits)
    return out


def test_margins_equal_those_of_plain_trees(table):
    """All rows and features: every tree follows from the table. Cells have few values, so bins are exact."""
    few = table.withColumns({c: F.round(F.col(c) * 4) / 4 for c in CELLS})
    fitted = boosted_trees(rounds=3, depth=3, rows=1.0, columns=1.0).fit(few, CELLS, "y")
    scored = fitted.score(few).toPandas().sort_values("i")
    x, sign = scored[CELLS].to_numpy(), 2.0 * scored["y"].to_numpy() - 1
    limits = [np.unique(x[:, f])[:-1] for f in range(3)]
    assert max(map(len, limits)) < 29
    margin = np.zeros(len(x))
    for round_ in range(3):
        target = sign if round_ == 0 else 4 * sign / (1 + np.exp(2 * sign * margin))
        margin += (1.0 if round_ == 0 else 0.1) * plain(x, target, 3, limits)
    assert np.allclose(scored["probability"], 1 / (1 + np.exp(-2 * margin)), atol=1e-5)
    assert (scored["prediction"] == (margin > 0)).all()


def test_as_good_as_the_library(spark, table):
    own = boosted_trees(rounds=20, depth=4).fit(table, CELLS, "y")
    theirs = GBTClassifier(featuresCol=VECTOR, labelCol=TARGET, maxIter=20, maxDepth=4, stepSize=0.1, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=42)
    rows = assemble(table, CELLS, None).withColumn(TARGET, F.col("y").cast("double"))
    share = lambda df: df.agg(F.avg((F.col("prediction") == F.col("y")).cast("double"))).first()[0]
    assert share(own.score(table)) > 0.9 and share(own.score(table)) > share(theirs.fit(rows).transform(rows)) - 0.02


def test_children_hold_the_rows_of_their_parent(table, monkeypatch):
    from flowbench.operators import levelboost

    counted = []
    monkeypatch.setattr(levelboost, "_best", lambda own, *more, plain=levelboost._best: counted.append(own[0, :, 1].sum()) or plain(own, *more))
    boosted_trees(rounds=1, depth=2, rows=1.0, columns=1.0).fit(table, CELLS, "y")
    assert counted[0] == 900 and sum(counted[1:]) == 900  # the larger child by subtraction


def test_saved_and_weighted(spark, table, tmp_path):
    three = table.withColumn("y", F.when(F.col("c") > 0.7, 2).otherwise(F.col("y")))
    for name, df in (("two", table), ("three", three)):
        fitted = boosted_trees(rounds=3, depth=3, balanced=True).fit(df, CELLS, "y")
        save_detector(spark, fitted, "boosted_trees", f"{tmp_path}/{name}")
        again = load_detector(spark, f"{tmp_path}/{name}", "boosted_trees")
        score = "probability" if name == "two" else "margins"
        rows = [[(r["prediction"], r[score]) for r in f.score(df).orderBy("i").collect()] for f in (fitted, again)]
        assert rows[0] == rows[1] and len({p for p, _ in rows[0]}) == (2 if name == "two" else 3)
