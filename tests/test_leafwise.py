"""Boosted trees split by split against a plain version that sorts raw cells."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowbench.operators.leafwise import LeafWiseBoosting, drawn, gradients

NAMES = ["a", "b", "c"]


def worth(g, h, s):
    t = max(abs(g) - s.l1, 0.0)
    return t * t / (h + s.l2) if h + s.l2 > 0 else 0.0


def best_split(x, g, h, rows, s, allowed, limits):
    """(gain, feature, limit) over every value below the largest; near-equal gains go to the first."""
    found = []
    for f in allowed:
        for v in limits[f]:
            low = rows[x[rows, f] <= v]
            high = rows[x[rows, f] > v]
            if min(len(low), len(high)) < s.least_rows or min(h[low].sum(), h[high].sum()) < s.least_hessian:
                continue
            gain = worth(g[low].sum(), h[low].sum(), s) + worth(g[high].sum(), h[high].sum(), s) - worth(g[rows].sum(), h[rows].sum(), s)
            found.append((gain, f, v))
    top = max((f[0] for f in found), default=0)
    if top <= s.least_gain + 1e-10:
        return None
    return next(f for f in found if f[0] >= top - 1e-9 * abs(top))


def grow(x, g, h, rows, s, allowed, limits):
    """Splits (path, feature, limit) in the order of their gains, and leaf values by path."""
    open_, splits = {"": rows}, []
    gains = {"": best_split(x, g, h, rows, s, allowed, limits) if s.depth != 0 else None}
    age = {"": 0}
    while len(open_) < s.leaves:
        ready = [p for p in open_ if gains[p]]
        if not ready:
            break
        p = min(ready, key=lambda p: (-gains[p][0], age[p]))
        _, f, v = gains[p]
        own = open_.pop(p)
        splits.append((p, f, v))
        for side, part in (("L", own[x[own, f] <= v]), ("R", own[x[own, f] > v])):
            open_[p + side] = part
            age[p + side] = len(age)
            deep = s.depth is not None and len(p) + 1 >= s.depth
            gains[p + side] = None if deep else best_split(x, g, h, part, s, allowed, limits)
    def value(r):
        gs = g[r].sum()
        return -s.rate * math.copysign(max(abs(gs) - s.l1, 0.0), gs) / (h[r].sum() + s.l2)
    return splits, {p: value(r) for p, r in open_.items()}


def paths(tree):
    """Splits and leaf values of a fitted tree by path."""
    splits, leaves, todo = {}, {}, [(0, "")]
    while todo:
        i, p = todo.pop()
        if tree.left[i] < 0:
            leaves[p] = tree.value[i]
        else:
            splits[p] = (tree.feature[i], tree.limit[i])
            todo += [(tree.left[i], p + "L"), (tree.right[i], p + "R")]
    return splits, leaves


def table(spark, classes, n, start):
    rng = random.Random(start)
    rows = []
    for _ in range(n):
        a, b, c = rng.randrange(30), round(rng.gauss(0, 1), 1), rng.choice([0.0, 1.0, 5.0])
        noise = rng.random() < 0.1
        rows.append((a, b, c, rng.randrange(classes) if noise else (int(a > 12) + int(b * c > 0.5)) % classes))
    df = spark.createDataFrame(rows, "a long, b double, c double, y int").coalesce(1)
    return df, np.array([r[:3] for r in rows], float), np.array([r[3] for r in rows])


@pytest.mark.parametrize(
    "classes,settings",
    [
        (2, dict(rounds=4, leaves=9, rows=1.0, columns=1.0, l2=1.0, l1=0.5, least_rows=5)),
        (2, dict(rounds=3, leaves=64, depth=3, rows=1.0, columns=0.7, l2=0.3, least_rows=1, balanced=False)),
        (3, dict(rounds=3, leaves=6, rows=0.8, columns=1.0, least_rows=3, settle_every=2)),
    ],
)
def test_every_split_equals_a_plain_version(spark, classes, settings):
    s = LeafWiseBoosting(**settings)
    df, x, y = table(spark, classes, 400, classes)
    fitted = s.fit(df, NAMES, "y")
    limits = [sorted(set(x[:, f]))[:-1] for f in range(3)]
    count = np.bincount(y, minlength=classes)
    w = (len(y) / (classes * count))[y] if s.balanced else np.ones(len(y))
    share = np.array([w[y == k].sum() for k in range(classes)])
    share = share / share.sum()
    start = [math.log(share[1] / share[0])] if classes == 2 else np.log(share).tolist()
    assert np.allclose(fitted.start, start)
    margin = np.tile(start, (len(y), 1))
    rng = np.random.default_rng(s.seed)
    for r in range(s.rounds):
        allowed = [np.sort(rng.permutation(3)[: max(1, round(s.columns * 3))]) for _ in start]
        g, h = gradients(margin, y, w)
        rows = np.flatnonzero(drawn(np.arange(len(y), dtype=np.uint64), r, s.rows, s.seed)) if s.rows < 1 else np.arange(len(y))
        for k in range(len(start)):
            splits, values = grow(x, g[:, k], h[:, k], rows, s, allowed[k], limits)
            own_splits, own_values = paths(fitted.trees[r][k])
            assert own_splits == {p: (f, v) for p, f, v in splits}
            assert own_values.keys() == values.keys() and np.allclose([own_values[p] for p in values], list(values.values()))
        for k in range(len(start)):
            margin[:, k] += fitted.trees[r][k].values(x)
    scored = fitted.score(df).toPandas()
    assert np.allclose(fitted.margins(x), margin)
    if classes == 2:
        p = 1 / (1 + np.exp(-margin[:, 0]))
        assert np.allclose(scored["probability"], p) and (scored["prediction"].to_numpy() == (p > 0.5)).all()
    else:
        assert (scored["prediction"].to_numpy() == margin.argmax(axis=1)).all()


def test_drawn_rows_and_odd_tables(spark):
    share = drawn(np.arange(100_000, dtype=np.uint64), 3, 0.9, 42)
    assert abs(share.mean() - 0.9) < 0.01
    assert (drawn(np.arange(100_000, dtype=np.uint64), 4, 0.9, 42) != share).any()
    df = spark.createDataFrame([(1.0, 0), (None, 0), (float("inf"), 0)], "a double, y int")
    one = LeafWiseBoosting(rounds=2).fit(df, ["a"], "y").score(df)
    assert {r["prediction"] for r in one.collect()} == {0}
    with pytest.raises(ValueError):
        LeafWiseBoosting().fit(df.limit(0), ["a"], "y")
    same = df.withColumn("a", F.lit(1.0)).withColumn("y", F.monotonically_increasing_id() % 2)
    flat = LeafWiseBoosting(rounds=3, least_rows=1).fit(same, ["a"], "y")
    assert all(len(t.left) == 1 for r in flat.trees for t in r)


@pytest.mark.parametrize("classes", [2, 3])
def test_passes_end_where_leaves_are_small(spark, monkeypatch, classes):
    """Trees are the same whether rows of small leaves are fetched, some of them or none; a chain of small leaves needs no pass for each."""
    from flowbench.operators import leafwise

    df, x, _ = table(spark, classes, 400, 7)
    plain, found = leafwise.Blocks.sums, {}
    for fetched in (0, 60, 20_000):
        passes = []
        monkeypatch.setattr(leafwise, "FETCHED", fetched)
        monkeypatch.setattr(leafwise.Blocks, "sums", lambda self, fn, small=False: passes.append(1) or plain(self, fn, small))
        fitted = LeafWiseBoosting(rounds=3, leaves=20, rows=0.8, columns=0.7, least_rows=2, least_hessian=1e-6).fit(df, NAMES, "y")
        found[fetched] = [paths(t) for r in fitted.trees for t in r], len(passes)
    assert found[20_000][1] <= 3 * 2 < found[60][1] <= found[0][1]
    for trees, _ in found.values():
        for (splits, leaves), (expected, values) in zip(trees, found[0][0]):
            assert splits == expected and leaves.keys() == values.keys() and np.allclose([leaves[p] for p in values], list(values.values()))
