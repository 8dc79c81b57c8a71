"""AdaBoost over one-split trees whose limits are exact: every place between two values of a feature is a candidate.

A round sums weights by class over some 255 intervals of each feature. Inside an interval the impurity of a split is concave in the weights that
fall below it, so the corners of what is possible bound it from below. Intervals that could hold a better split than the best one known are cut
further, by the order of floating-point numbers, until their rows are few enough to be looked at value by value. The others are settled without.
Rows are placed in the first intervals once, and each of these knows its smallest and largest value: one that holds a single value has no split inside.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowbench.functions.names import require_columns
from flowbench.functions.values import finite_or
from flowbench.operators.blocks import Block, Blocks
from flowbench.operators.boosting import FittedAdaBoost, Stump
from flowbench.operators.leafwise import SMALL_SUMS, _limits
from flowbench.session import few_rows

# Rows whose values come to the driver in one step, and parts into which a larger interval is cut.
FETCHED = 20_000
PARTS = 64
# Classes up to which all corners of an interval are tried; with more, intervals are cut until they are small.
CORNERS = 8
LOWEST, HIGHEST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def order_key(x: np.ndarray) -> np.ndarray:
    """64-bit integers in the order of the numbers."""
    bits = np.ascontiguousarray(x + 0.0).view(np.int64)
    return bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))


def number_of(key: int) -> float:
    bits = np.array([key], np.int64)
    return float((bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))).view(np.float64)[0])


def impurity(sums: np.ndarray) -> np.ndarray:
    """Gini impurity times the mass, along the last axis."""
    mass = sums.sum(axis=-1)
    return mass - np.divide((sums * sums).sum(axis=-1), mass, out=np.zeros_like(mass), where=mass > 0)


@dataclass
class _Interval:
    """Keys above ``low`` up to ``high`` of a feature, the weights by class below it, in it and above it, and its rows."""

    feature: int
    low: int
    high: int
    below: np.ndarray
    inside: np.ndarray
    rows: float


def _bounds(intervals: list[_Interval], whole: np.ndarray) -> np.ndarray:
    """By interval: no split inside has a smaller impurity."""
    if len(whole) > CORNERS or not intervals:
        return np.zeros(len(intervals))
    corners = np.array(list(itertools.product((0.0, 1.0), repeat=len(whole))))
    below = np.stack([i.below for i in intervals])[:, None] + corners * np.stack([i.inside for i in intervals])[:, None]
    return (impurity(below) + impurity(whole - below)).min(axis=1)


@dataclass
class ExactAdaBoost:
    """``rounds`` one-split trees by the least Gini impurity, weight updates scaled by ``rate``; two or more classes. Missing cells count as 0.

    Ties go to the first feature and the smallest limit. One class, or features without two values, give a model of one vote.
    """

    rounds: int = 200
    rate: float = 1.0
    settle_every: int = 20
    name: str = "exact_adaboost"

    def fit(self, train: DataFrame, features: Sequence[str], label: str) -> FittedAdaBoost:
        features = list(require_columns(train, features, numeric=True))
        y = F.col(label).cast("int")
        clean = train.select(*[finite_or(c).cast("double").alias(f"_f{i}") for i, c in enumerate(features)], y.alias("_y"))
        tallies = {r["_y"]: r["n"] for r in few_rows(clean.groupBy("_y").agg(F.count("*").alias("n")), "classes")}
        if not tallies:
            raise ValueError("the training table is empty")
        classes, rows = sorted(tallies), sum(tallies.values())
        only = min(tallies, key=lambda c: (-tallies[c], c))
        limits = _limits(clean, len(features), 255)
        if len(classes) < 2 or not any(limits):
            return FittedAdaBoost(features, classes, [Stump(features[0], 0.0, only, only, 1.0)])
        code = F.coalesce(*[F.when(F.col("_y") == c, F.lit(i)) for i, c in enumerate(classes)])
        raw = Blocks.of(clean, [F.col(f"_f{i}") for i in range(len(features))], {"y": code})
        edges = [order_key(np.array(v)) for v in limits]
        blocks = raw.updated(lambda b: {"key": np.ascontiguousarray(order_key(b["x"]).T), "y": b["y"].astype(np.int64)})
        raw.release()
        # An edge just below the largest value of an interval sets it apart, for very many rows may share it.
        ranges = _ranges(blocks, edges)
        edges = [np.union1d(e, high[:-1][low[:-1] < high[:-1]] - 1) for e, (low, high) in zip(edges, ranges)]
        ranges, k = _ranges(blocks, edges), len(classes)
        blocks = blocks.updated(lambda b: {**b, "code": _coded(b, edges, k)})
        sizes = [len(e) + 1 for e in edges]
        counts = blocks.sums(lambda b: [np.concatenate([np.bincount(c, minlength=n * k).reshape(n, k).sum(axis=1) for c, n in zip(b["code"], sizes)])])[0]
        # Votes with limits at the ends of intervals need no keys: rounds sum over blocks without them.
        stumps, votes, placed, shift = [], [], [], 0.0  # the shift keeps the mean weight near 1
        light, former = _light(blocks, [], k), None
        try:
            for _ in range(self.rounds):
                found = _best(blocks, light, votes, placed, shift, ranges, counts, k)
                if former is not None:
                    former, _ = None, former.release()
                if found is None:
                    break
                feature, at, low, high, error, mass = found
                shift += math.log(mass / rows)
                if error >= 1 - 1 / k:
                    break
                alpha = 1.0 if error <= 0 else self.rate * (math.log((1 - error) / error) + math.log(k - 1))
                stumps.append(Stump(features[feature], number_of(at), classes[low], classes[high], alpha))
                if error <= 0:
                    break
                votes.append((feature, at, low, high, alpha))
                place = int(np.searchsorted(edges[feature], at, "left"))
                if at >= ranges[feature][1][place] and len(placed) + 1 < self.settle_every:
                    placed.append((feature, place, low, high, alpha))
                else:
                    former, light, placed = light, _light(blocks, list(votes), k), []
        finally:
            for some in (blocks, light, former):
                if some is not None:
                    some.release()
        return FittedAdaBoost(features, classes, stumps or [Stump(features[0], 0.0, only, only, 1.0)])


def _coded(block: Block, edges: list[np.ndarray], k: int) -> np.ndarray:
    """A line for each feature: of each row the interval between its ascending edges, times the classes, plus the class."""
    kind = np.min_scalar_type((max(map(len, edges)) + 1) * k)
    return np.stack([(np.searchsorted(e, key, "left") * k + block["y"]).astype(kind) for e, key in zip(edges, block["key"])])


def _ranges(blocks: Blocks, edges: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """By feature the smallest and the largest key in each interval; of an empty one the first is above the second."""

    def one(block: Block) -> list[np.ndarray]:
        out = []
        for e, key in zip(edges, block["key"]):
            place = np.searchsorted(e, key, "left")
            low, high = np.full(len(e) + 1, HIGHEST), np.full(len(e) + 1, LOWEST)
            np.minimum.at(low, place, key)
            np.maximum.at(high, place, key)
            out += [low, high]
        return out

    found = blocks.rdd.map(one).treeReduce(lambda a, b: [(np.minimum, np.maximum)[i % 2](u, v) for i, (u, v) in enumerate(zip(a, b))])
    return list(zip(found[::2], found[1::2]))


def _light(blocks: Blocks, votes: list, k: int) -> Blocks:
    """The blocks without keys, with the logarithms of weights after all votes; worked out with the next sum."""
    kind = np.min_scalar_type(k)
    return blocks.stepped(lambda b: {"code": b["code"], "y": b["y"].astype(kind), "log": _logs(b, votes)}, cut=False)


def _logs(block: Block, votes: list, own: np.ndarray | slice = slice(None)) -> np.ndarray:
    """Logarithms of the rows' weights after the votes."""
    y = block["y"][own]
    log = np.zeros(len(y))
    for feature, at, low, high, alpha in votes:
        log += alpha * (np.where(block["key"][feature][own] <= at, low, high) != y)
    return log


def _sums(block: Block, placed: list, shift: float, sizes: list[int], k: int) -> np.ndarray:
    """By feature and its first intervals: weights of each class; ``placed`` votes come on top of the logarithms, with intervals in place of keys."""
    log = block["log"].copy()
    for feature, place, low, high, alpha in placed:
        log += alpha * (np.where(block["code"][feature] < (place + 1) * k, low, high) != block["y"])
    weight = np.exp(log - shift)
    return np.concatenate([np.bincount(code, weight, n * k).reshape(n, k) for code, n in zip(block["code"], sizes)])


def _tally(place: np.ndarray, weight: np.ndarray, y: np.ndarray, n: int, k: int) -> np.ndarray:
    """Weights of each class, and rows, by place."""
    tally = np.bincount(place.astype(np.int64) * k + y, weight, n * k).reshape(n, k)
    return np.column_stack([tally, np.bincount(place, minlength=n)])


def _inside(block: Block, votes: list, shift: float, asked: list[_Interval], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Interval, key and weights by class of every value in the intervals."""
    out = []
    for number, i in enumerate(asked):
        key = block["key"][i.feature]
        own = np.flatnonzero((key > i.low) & (key <= i.high))
        weight, y = np.exp(_logs(block, votes, own) - shift), block["y"][own]
        values, place = np.unique(key[own], return_inverse=True)
        sums = np.bincount(place * k + y, weight, len(values) * k).reshape(len(values), k)
        out.append((np.full(len(values), number), values, sums))
    return tuple(map(np.concatenate, zip(*out)))


def _best(blocks: Blocks, light: Blocks, votes: list, placed: list, shift: float, ranges: list[tuple[np.ndarray, np.ndarray]], counts: np.ndarray, k: int) -> tuple | None:
    """(feature, key of the limit, class below, class above, weighted error, weight of all rows) of the purest split."""
    sizes = [len(low) for low, _ in ranges]
    table = light.sums(lambda b: [_sums(b, placed, shift, sizes, k)], small=8 * sum(sizes) * k <= SMALL_SUMS)[0]
    whole = table[: sizes[0]].sum(axis=0)
    best: tuple | None = None  # impurity, feature, key, weights below

    def offer(feature: int, keys: np.ndarray, below: np.ndarray) -> None:
        """The weights below each of a feature's ascending keys."""
        nonlocal best
        above = whole - below
        fit = np.flatnonzero((below.sum(axis=1) > 0) & (above.sum(axis=1) > 1e-12 * whole.sum()))
        if not len(fit):
            return
        values = impurity(below[fit]) + impurity(above[fit])
        first = int(np.argmax(values <= values.min() + 1e-12 * whole.sum()))
        value, at = float(values[first]), fit[first]
        key = int(keys[at])
        near = best is not None and abs(value - best[0]) <= 1e-12 * whole.sum()
        if best is None or (not near and value < best[0]) or (near and (feature, key) < best[1:3]):
            best = (value, feature, key, below[at])

    def intervals(asked: list[tuple[int, int, int, np.ndarray, np.ndarray]], sums: np.ndarray) -> list[_Interval]:
        """Offers the edges and gives the intervals of more than one value; asked: feature, low, high, weights below, edges."""
        found, first = [], 0
        for feature, low, high, below, cuts in asked:
            n = len(cuts) + 1
            own, first = sums[first : first + n], first + n
            upto = np.cumsum(np.vstack([below, own[:, :k]]), axis=0)  # below each part, and all
            offer(feature, cuts, upto[1:-1])
            for place in np.flatnonzero(own[:, k] > 1).tolist():
                bottom = int(cuts[place - 1]) if place else low
                top = int(cuts[place]) if place < len(cuts) else high
                if top - bottom > 1:
                    found.append(_Interval(feature, bottom, top, upto[place], own[place, :k], own[place, k]))
        return found

    todo, first = [], 0
    for f, (low, high) in enumerate(ranges):
        own, rows, first = table[first : first + sizes[f]], counts[first : first + sizes[f]], first + sizes[f]
        upto = np.cumsum(np.vstack([np.zeros(k), own]), axis=0)
        # The limit is the largest value up to an edge.
        offer(f, np.maximum.accumulate(high)[:-1], upto[1:-1])
        todo += [_Interval(f, int(low[j]) - 1, int(high[j]), upto[j], own[j], rows[j]) for j in np.flatnonzero(low < high).tolist()]
    while True:
        # A rounding error must not drop an interval.
        bounds = _bounds(todo, whole)
        hopeful = np.flatnonzero(bounds < best[0] - 1e-12 * whole.sum()) if best is not None else np.arange(len(todo))
        hopeful = hopeful[np.argsort(bounds[hopeful], kind="stable")]
        todo = [todo[j] for j in hopeful]  # the lowest bounds first
        taken, rows = [], 0.0
        for i in todo:
            if rows + i.rows <= FETCHED:
                taken.append(i)
                rows += i.rows
        if not todo:
            break
        if taken:
            number, key, sums = map(np.concatenate, zip(*blocks.rdd.map(lambda b: _inside(b, votes, shift, taken, k)).collect()))
            order = np.lexsort((key, number))
            number, key = number[order], key[order]
            # The same value in several blocks is one.
            new = np.flatnonzero(np.r_[True, (number[1:] != number[:-1]) | (key[1:] != key[:-1])][: len(key)])
            number, key, sums = number[new], key[new], np.add.reduceat(sums[order], new, axis=0)
            for j, i in enumerate(taken):
                a, b = np.searchsorted(number, [j, j + 1])
                below = np.cumsum(np.vstack([i.below, sums[a:b]]), axis=0)[1:]
                inner = key[a:b] < i.high
                offer(i.feature, key[a:b][inner], below[inner])
            done = set(map(id, taken))
            todo = [i for i in todo if id(i) not in done]
        else:
            asked = []
            for i in todo:
                step = max(1, (i.high - i.low) // PARTS)
                asked.append((i.feature, i.low, i.high, i.below, np.array(range(i.low + step, i.high, step)[: 2 * PARTS], np.int64)))
            # Outer intervals of a feature are summed, too, and left out.
            sums = blocks.sums(lambda b: [_sums_within(b, votes, shift, [(f, lo, hi, c) for f, lo, hi, _, c in asked], k)])[0]
            todo = intervals(asked, sums)
    if best is None:
        return None
    _, feature, key, below = best
    above = whole - below
    low, high = int(np.argmax(below)), int(np.argmax(above))
    return feature, key, low, high, max(0.0, float(1 - (below[low] + above[high]) / whole.sum())), float(whole.sum())


def _sums_within(block: Block, votes: list, shift: float, asked: list[tuple[int, int, int, np.ndarray]], k: int) -> np.ndarray:
    """Weights of each class, and rows, between the cuts of the asked features, of the rows between a low and a high key."""
    parts = []
    for feature, low, high, cuts in asked:
        key = block["key"][feature]
        own = np.flatnonzero((key > low) & (key <= high))
        weight = np.exp(_logs(block, votes, own) - shift)
        parts.append(_tally(np.searchsorted(cuts, key[own], "left"), weight, block["y"][own], len(cuts) + 1, k))
    return np.concatenate(parts)
