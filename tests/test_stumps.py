"""Exact one-split trees against a plain search of all values, round by round."""

import math
import random

import numpy as np
import pytest

from flowbench.operators import stumps
from flowbench.operators.stumps import ExactAdaBoost, impurity, number_of, order_key


def plain(x, y, k, rounds, rate=1.0):
    """Feature, values around the limit, votes and weight of every round."""
    log, found = np.zeros(len(y)), []
    for _ in range(rounds):
        w = np.exp(log - log.max())
        truth = np.zeros((len(y), k))
        truth[np.arange(len(y)), y] = w
        whole, best = truth.sum(axis=0), None
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            sums = np.cumsum(truth[order], axis=0)
            v = x[order, f]
            for i in np.flatnonzero(v[1:] > v[:-1]):
                value = impurity(sums[i]) + impurity(whole - sums[i])
                if best is None or value < best[0] - 1e-10 * whole.sum():
                    best = (value, f, v[i], v[i + 1], sums[i])
        _, f, v, after, below = best
        low, high = int(np.argmax(below)), int(np.argmax(whole - below))
        error = 1 - (below[low] + (whole - below)[high]) / whole.sum()
        if error >= 1 - 1 / k:
            break
        alpha = rate * (math.log((1 - error) / error) + math.log(k - 1))
        found.append((f, v, after, low, high, alpha))
        log = log + alpha * (np.where(x[:, f] <= v, low, high) != y)
    return found


@pytest.mark.parametrize("k,fetched", [(2, 20_000), (3, 40)])
def test_rounds_equal_a_plain_search(spark, monkeypatch, k, fetched):
    """Values are dense and far more than the first intervals; with few fetched rows intervals are cut again and again."""
    monkeypatch.setattr(stumps, "FETCHED", fetched)
    rng = random.Random(k)
    rows = []
    for _ in range(1500):
        a, b, c = rng.gauss(0, 1), rng.uniform(-1e-3, 1e6), float(rng.randrange(-2, 3))
        y = (int(a > 0.1234) + int(b > 3.3e5) * int(c > 0)) % k
        rows.append((a, b, c, y if rng.random() > 0.15 else rng.randrange(k)))
    df = spark.createDataFrame(rows, "a double, b double, c double, y int")
    fitted = ExactAdaBoost(rounds=6, settle_every=4).fit(df, ["a", "b", "c"], "y")
    x, y = np.array([r[:3] for r in rows]), np.array([r[3] for r in rows])
    expected = plain(x, y, k, 6)
    assert len(fitted.stumps) == len(expected)
    for s, (f, v, after, low, high, alpha) in zip(fitted.stumps, expected):
        assert (s.feature, s.low, s.high) == ("abc"[f], low, high) and v <= s.limit < after and s.alpha == pytest.approx(alpha)


def test_order_of_keys():
    x = np.array([-np.inf, -1e300, -2.5, -1e-300, -0.0, 0.0, 5e-324, 1.0, 1e300])
    keys = order_key(x)
    assert (np.diff(keys) >= 0).all() and keys[4] == keys[5] and [number_of(int(k)) for k in keys] == x.tolist()


def test_odd_tables(spark):
    df = spark.createDataFrame([(1.0, 0), (None, 0), (2.0, 0)], "a double, y int")
    assert {r["prediction"] for r in ExactAdaBoost().fit(df, ["a"], "y").score(df).collect()} == {0}
    with pytest.raises(ValueError):
        ExactAdaBoost().fit(df.limit(0), ["a"], "y")
    clear = spark.createDataFrame([(float(i), int(i > 7)) for i in range(20)], "a double, y int")
    fitted = ExactAdaBoost().fit(clear, ["a"], "y")
    assert len(fitted.stumps) == 1 and 7 <= fitted.stumps[0].limit < 8


def test_intervals_of_one_value_are_not_searched(spark, monkeypatch):
    """Of values that very many rows share nothing is asked beyond the sum of a round, however few rows may be fetched."""
    monkeypatch.setattr(stumps, "FETCHED", 10)
    rng = random.Random(3)
    rows = [(float(rng.randrange(4)), float(rng.choice([0, 0, 0, 7])), rng.randrange(2)) for _ in range(600)]
    rows = [(a, b, int(a > 1.5) if rng.random() > 0.2 else y) for a, b, y in rows]
    df = spark.createDataFrame(rows, "a double, b double, y int")
    monkeypatch.setattr(stumps, "_sums_within", lambda *a: pytest.fail("cut further"))
    monkeypatch.setattr(stumps, "_inside", lambda *a: pytest.fail("looked into"))
    fitted = ExactAdaBoost(rounds=5).fit(df, ["a", "b"], "y")
    expected = plain(np.array([r[:2] for r in rows]), np.array([r[2] for r in rows]), 2, 5)
    assert [(s.feature, s.limit, s.low, s.high) for s in fitted.stumps] == [("ab"[f], v, low, high) for f, v, _, low, high, _ in expected]
