"""Kernel classifiers against the exact dual on the full kernel matrix."""

import random

import numpy as np
import pytest

from flowbench.operators.landmarks import Kernel, LandmarkSvm, factor

CELLS = ["a", "b", "c"]


def table(spark, n, classes, start=0):
    rng = random.Random(start)
    rows = []
    for i in range(n):
        a, b, c = rng.gauss(0, 1), rng.gauss(0, 1), rng.gauss(0, 1)
        inside = a * a + b * b
        y = int(inside > 1.4) if classes == 2 else (0 if inside < 0.8 else 1 if a > 0 else 2)
        rows.append((i, a, b, c, y if rng.random() > 0.03 else rng.randrange(classes)))
    return spark.createDataFrame(rows, "id int, a double, b double, c double, y int"), np.array([r[1:4] for r in rows]), np.array([r[4] for r in rows])


def exact(k, y, top, passes=600):
    """Dual coordinate ascent on the whole kernel matrix until hardly anything moves."""
    alpha, f = np.zeros(len(y)), np.zeros(len(y))
    for _ in range(passes):
        most = 0.0
        for i in range(len(y)):
            new = min(max(alpha[i] + (1 - y[i] * f[i]) / k[i, i], 0.0), top[i])
            if new != alpha[i]:
                f += (new - alpha[i]) * y[i] * k[i]
                most = max(most, abs(new - alpha[i]))
                alpha[i] = new
        if most < 1e-5:
            break
    return f, alpha


@pytest.mark.parametrize("n,kind,settings", [(2000, "rbf", dict(gamma=0.5)), (400, "poly", dict(gamma=0.5, degree=2, coef0=1.0))])
def test_margins_come_close_to_the_exact_dual(spark, n, kind, settings):
    """Of 2,000 rows 300 are landmarks: margins differ by less than 0.1 on average from those of the kernel itself, and hardly a sign does."""
    df, x, y = table(spark, n, 2)
    fitted = LandmarkSvm(kernel=kind, landmarks=300, rounds=50, gap=1e-4, balanced=False, **settings).fit(df, CELLS, "y")
    x = (x - x.mean(axis=0)) / x.std(axis=0)
    f, alpha = exact(Kernel(kind, **settings).of(x, x), np.where(y == 1, 1.0, -1.0), np.ones(len(y)))
    own = fitted.margins(x)[:, 0]
    assert np.abs(own - f).mean() < 0.1 and ((own > 0) == (f > 0)).mean() > 0.99
    assert abs(fitted.facts["support_vectors"] - (alpha > 0).sum()) < 0.25 * (alpha > 0).sum()
    scored = fitted.score(df).orderBy("id").toPandas()
    assert np.allclose(scored["margin"], own) and (scored["prediction"] == (own > 0)).all()


def test_more_classes(spark):
    df, x, y = table(spark, 900, 3, 1)
    whole = LandmarkSvm(landmarks=100, gamma=0.7, gap=3e-3, rounds=30).fit(df.coalesce(1), CELLS, "y")
    scored = whole.score(df).toPandas()
    assert (scored["prediction"] == scored["y"]).mean() > 0.9 and len(scored["margins"][0]) == 3


def test_every_row_a_landmark_is_the_kernel():
    x = np.random.default_rng(1).normal(size=(60, 3))
    for kernel in (Kernel("rbf", 0.3), Kernel("poly", 0.4, 3, 1.0), Kernel("linear")):
        z = kernel.of(x, x) @ factor(kernel, x)
        assert np.allclose(z @ z.T, kernel.of(x, x), atol=1e-5)


def test_odd_tables(spark):
    df, _, _ = table(spark, 40, 2)
    assert set(LandmarkSvm("sigmoid", gamma=0.1, rounds=5).fit(df, CELLS, "y").score(df).toPandas()["prediction"]) <= {0, 1}
    one = df.where("y = 1")
    with pytest.raises(ValueError):
        LandmarkSvm("cubic").fit(df, CELLS, "y")
    with pytest.raises(ValueError):
        LandmarkSvm().fit(df.limit(0), CELLS, "y")
    assert set(LandmarkSvm().fit(one, CELLS, "y").score(df).toPandas()["prediction"]) == {1}


@pytest.mark.parametrize("run", [1, 7])
def test_settled_rows_are_not_mapped(monkeypatch, run):
    """Run by run a pass gives what visiting every row gives where runs are single rows, and the same hinge losses; rows that stay at their bounds are not mapped."""
    from flowbench.operators import landmarks

    monkeypatch.setattr(landmarks, "RUN", run)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 3))
    y = (x[:, 0] + 0.3 * x[:, 1] > 0).astype(float)
    kernel, top, parts = Kernel("rbf", 0.4), rng.uniform(0.5, 2, 300), 3
    into = factor(kernel, x[:40])
    z, w = kernel.of(x, x[:40]) @ into, np.zeros((into.shape[1], 1))
    mapped, alpha, sign = [], np.zeros(300), np.where(y == 1, 1.0, -1.0)

    class Into(np.ndarray):
        def __rmatmul__(self, values):
            mapped.append(len(values))
            return values @ np.asarray(self)

    block = {"x": x, "y": y, "w": top}
    for r in range(6):
        own, before = w[:, 0].copy(), alpha.copy()
        for i in np.random.default_rng([r, 300]).permutation(300):
            new = min(max(alpha[i] + (1 - sign[i] * (z[i] @ own)) / (parts * (z[i] @ z[i])), 0.0), top[i])
            own += parts * (new - alpha[i]) * sign[i] * z[i]
            alpha[i] = new
        mapped.clear()
        block = landmarks._ascend(block, kernel, x[:40], into.view(Into), w, [1], 1.0, parts, r)
        assert block["sums"][0, 0] == pytest.approx((top * np.maximum(0, 1 - sign * (z @ w[:, 0]))).sum()) and sum(mapped) <= 300
        if run == 1:
            assert block["sums"][1, 0] == pytest.approx(before.sum()) and np.allclose(block["alpha"][:, 0], alpha)
        assert (block["alpha"] >= 0).all() and (block["alpha"][:, 0] <= top + 1e-12).all()
        w = w + block["delta"]
        alpha = block["alpha"][:, 0].copy()
    assert sum(mapped) < 150
