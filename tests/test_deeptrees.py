"""Trees without a limit of depth."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowbench.operators import deeptrees
from flowbench.operators.deeptrees import DeepForest, copies, grow


def stairs(spark, n):
    """Classes alternate along one feature: the purest split always cuts off one row, and the tree is as deep as there are rows."""
    return spark.range(n).select(F.col("id").cast("int").alias("id"), F.col("id").cast("double").alias("a"), (F.col("id") % 2).cast("int").alias("y"))


def test_depth_beyond_forty(spark):
    df = stairs(spark, 120)
    fitted = DeepForest.one(balanced=False).fit(df, ["a"], "y")
    assert fitted.depth() >= 40
    assert fitted.score(df).where("prediction <> y").count() == 0


@pytest.mark.parametrize("small", [20_000, 100])
def test_tree_fits_every_consistent_table(spark, monkeypatch, small):
    """With few rows a node in one task, upper nodes come from histograms and the rest is grafted; all rows are told apart in the end."""
    monkeypatch.setattr(deeptrees, "SMALL", small)
    rng = random.Random(2)
    rows = [(i, rng.gauss(0, 1), rng.gauss(0, 1), float(rng.randrange(4)), rng.randrange(3) * 2) for i in range(1500)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, y int")
    fitted = DeepForest.one().fit(df, ["a", "b", "c"], "y")
    scored = fitted.score(df).toPandas()
    assert (scored["prediction"] == scored["y"]).all() and (len(fitted.tops[0].left) > 1) == (small == 100)
    if small == 100:
        monkeypatch.setattr(deeptrees, "BROADCAST_NODES", 0)
        dealt = fitted.score(df).toPandas().sort_values("id")
        assert np.allclose(np.stack(dealt["probabilities"]), np.stack(scored.sort_values("id")["probabilities"]))


def test_forest(spark):
    rng = random.Random(3)
    rows = [(i, rng.gauss(0, 1), rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(1200)]
    df = spark.createDataFrame([(*r, int((r[1] * r[2] > 0) != (rng.random() < 0.05))) for r in rows], "id int, a double, b double, c double, y int")
    train, test = df.where("id % 4 > 0"), df.where("id % 4 = 0")
    fitted = DeepForest(trees=20).fit(train, ["a", "b", "c"], "y")
    row = fitted.score(test).agg(F.avg((F.col("prediction") == F.col("y")).cast("double")), F.min("probability"), F.max("probability"), F.countDistinct("probability")).first()
    assert row[0] > 0.85 and 0 <= row[1] < row[2] <= 1 and row[3] > 10


def test_grown_split_is_the_purest():
    rng = np.random.default_rng(5)
    x, y, w = rng.normal(size=(60, 2)), rng.integers(0, 2, 60), rng.uniform(0.5, 2, 60)
    part = grow(x, y, w, 2, 2, 3, np.random.default_rng(1))
    found = []
    for f in range(2):
        for v in np.sort(x[:, f])[:-1]:
            low = x[:, f] <= v
            if min(low.sum(), (~low).sum()) >= 3:
                gini = lambda s: sum(w[s]) - sum((w[s] * (y[s] == c)).sum() ** 2 for c in (0, 1)) / sum(w[s])
                found.append((gini(low) + gini(~low), f, v))
    best = min(found)
    assert part.feature[0] == best[1] and ((x[:, best[1]] <= part.limit[0]) == (x[:, best[1]] <= best[2])).all()


def test_copies_and_odd_tables(spark):
    times = copies(np.arange(200_000), 3, 42)
    assert abs(times.mean() - 1) < 0.01 and abs((times == 0).mean() - np.exp(-1)) < 0.005
    df = spark.createDataFrame([(1.0, None, 0), (None, 2.0, 0)], "a double, b double, y int")
    assert {r["prediction"] for r in DeepForest.one().fit(df, ["a", "b"], "y").score(df).collect()} == {0}
    same = spark.createDataFrame([(1.0, 0), (1.0, 0), (1.0, 1)], "a double, y int")
    assert {r["prediction"] for r in DeepForest.one(balanced=False).fit(same, ["a"], "y").score(same).collect()} == {0}
    with pytest.raises(ValueError):
        DeepForest().fit(df.limit(0), ["a"], "y")


def test_first_nodes_in_passes_of_bounded_size(spark, monkeypatch):
    """However few nodes a pass takes, the same trees come out; cells are coded once, and a pass counts only the features drawn for a node."""
    rng = random.Random(8)
    rows = [(i, rng.gauss(0, 1), rng.gauss(0, 1), rng.gauss(0, 1), 1.0, float(rng.randrange(3)), rng.randrange(2)) for i in range(1500)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, d double, e double, y int").coalesce(1).persist()
    monkeypatch.setattr(deeptrees, "SMALL", 60)
    found, asked, plain = [], [], deeptrees.DeepForest._weighed
    monkeypatch.setattr(deeptrees.DeepForest, "_weighed", lambda self, top, own, table, *more: asked.append(len(table)) or plain(self, top, own, table, *more))
    for cells in (4_000_000, 1):
        monkeypatch.setattr(deeptrees, "CELLS", cells)
        fitted = DeepForest(trees=3).fit(df, ["a", "b", "c", "d", "e"], "y")
        found.append([deeptrees.grafted(top, {}) for top in fitted.tops])
    assert max(asked) == 3 and all(len(t.left) > 20 for t in found[0])
    for one, two in zip(*found):
        paths = [sorted(zip(t.feature, t.limit, t.left >= 0, map(tuple, t.weights))) for t in (one, two)]
        assert paths[0] == paths[1]
