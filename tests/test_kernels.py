"""The kernel classifier against MLlib's linear one on the Fourier features as columns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowbench.operators import kernels
from flowbench.operators.blocks import Blocks
from flowbench.operators.kernels import KernelSvm, hinge_and_gradient
from flowbench.operators.learners import linear_svm

CELLS = ["a", "b"]


@pytest.fixture(scope="module")
def rings(spark):
    draw = np.random.default_rng(6)
    x = draw.normal(size=(900, 2))
    y = ((x**2).sum(axis=1) > 1.5).astype(int)
    return spark.createDataFrame([(i, *map(float, r), int(k)) for i, (r, k) in enumerate(zip(x, y))], "i int, a double, b double, y int").persist()


def objective(margins, y, coefficients, penalty=1e-4):
    w = len(y) / (2 * np.bincount(y, minlength=2)[y])
    return (w * np.maximum(0, 1 - np.where(y == 1, 1, -1) * margins)).sum() / w.sum() + 0.5 * penalty * (coefficients**2).sum()


def test_loss_comes_as_low_as_on_columns(spark, rings, monkeypatch):
    """No pass holds more columns than the table has features, and the loss is not above that of MLlib's fit on all Fourier columns."""
    widths, plain = [], Blocks.of
    monkeypatch.setattr(Blocks, "of", staticmethod(lambda df, x, *more, **named: widths.append(len(x)) or plain(df, x, *more, **named)))
    fitted = KernelSvm(size=48).fit(rings, CELLS, "y")
    assert widths == [2]
    linear = linear_svm()
    linear.scale = False
    wide = fitted.fourier.transform(rings).persist()
    other = linear.fit(wide, fitted.fourier.names, "y")
    scored = fitted.score(rings).toPandas().sort_values("i")
    theirs = other.score(wide).toPandas().sort_values("i")
    y = scored["y"].to_numpy()
    own = objective(scored["margin"].to_numpy(), y, fitted.weights[:, 0])
    assert own <= 1.01 * objective(theirs["margin"].to_numpy(), y, other.model.coefficients.toArray())
    assert (scored["prediction"] == (scored["margin"] > 0)).all() and (scored["prediction"] == y).mean() > 0.95
    cells = np.array(wide.orderBy("i").select(*fitted.fourier.names).collect())
    assert np.allclose(cells @ fitted.weights[:, 0] + fitted.offsets[0], scored["margin"])


def test_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(2)
    block = {"x": rng.normal(size=(60, 3)), "y": rng.integers(0, 2, 60), "w": rng.uniform(0.5, 2, 60)}
    ways, shifts, flat = rng.normal(size=(3, 5)), rng.uniform(0, 6, 5), rng.normal(size=6) / 5
    (loss, mass), gradient = hinge_and_gradient(block, flat, 1, ways, shifts)
    assert mass == pytest.approx(block["w"].sum())
    for i in range(6):
        step = np.zeros(6)
        step[i] = 1e-6
        up, down = (hinge_and_gradient(block, flat + s, 1, ways, shifts)[0][0] for s in (step, -step))
        assert gradient[i] == pytest.approx((up - down) / 2e-6, rel=1e-4, abs=1e-6)


def test_more_classes_and_a_class_without_rows(rings):
    df = rings.withColumn("y", F.when(F.col("a") > 0.8, 3).otherwise(F.col("y")))
    scored = KernelSvm(size=32, iterations=40).fit(df, CELLS, "y").score(df)
    row = scored.agg(F.avg((F.col("prediction") == F.col("y")).cast("double")), F.min(F.size("margins")), F.max(F.size("margins"))).first()
    assert row[0] > 0.85 and row[1:] == (4, 4) and kernels.KernelSvm(size=4, iterations=2).fit(rings.where("y = 1"), CELLS, "y").score(rings).where("prediction = 0").count() == 0
