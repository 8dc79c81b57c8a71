"""Multi-class AdaBoost over one-split trees, as weighted sums over blocks of rows.

A row's weight follows from the splits found so far and is folded into its block every ``settle_every`` rounds. Features are
binned once; a round is one sum of weights by bin and class.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowbench.functions.names import require_columns
from flowbench.functions.values import finite_or
from flowbench.operators.blocks import Block, Blocks
from flowbench.session import few_rows


@dataclass(frozen=True)
class Stump:
    feature: str
    limit: float
    low: int
    high: int
    alpha: float

    def vote(self) -> Column:
        return F.when(finite_or(self.feature) <= F.lit(self.limit), F.lit(self.low)).otherwise(F.lit(self.high))


@dataclass
class FittedAdaBoost:
    features: list[str]
    classes: list[int]
    stumps: list[Stump]

    def score(self, df: DataFrame) -> DataFrame:
        """Adds the class with the largest sum of weighted votes; a tie goes to the smaller class."""
        votes = {}
        for y in self.classes:
            total = F.lit(0.0)
            for s in self.stumps:
                # A split votes for one of two classes: only those that can vote for y matter to it.
                if y in (s.low, s.high):
                    total = total + F.when(s.vote() == y, F.lit(s.alpha)).otherwise(F.lit(0.0))
            votes[f"_v{y}"] = total
        wide = df.withColumns(votes)
        cols = [F.col(c) for c in votes]
        best = F.greatest(*cols) if len(cols) > 1 else cols[0]
        pick = F.coalesce(*[F.when(c == best, F.lit(y)) for c, y in zip(cols, self.classes)])
        out = wide.withColumn("prediction", pick.cast("int"))
        if len(self.classes) == 2:
            whole = sum(s.alpha for s in self.stumps) or 1.0
            out = out.withColumn("probability", cols[1] / F.lit(whole))
        return out.drop(*votes)


@dataclass
class AdaBoost:
    """``rounds`` one-split trees with weight updates scaled by ``rate``; limits are quantiles of the features."""

    rounds: int = 200
    rate: float = 1.0
    bins: int = 32
    settle_every: int = 20
    name: str = "adaboost"

    def fit(self, train: DataFrame, features: Sequence[str], label: str) -> FittedAdaBoost:
        features = require_columns(train, features, numeric=True)
        y = F.col(label).cast("int")
        clean = train.select(*[finite_or(c).alias(c) for c in features], y.alias("_y"))
        cuts = self._cuts(clean, features)
        usable = [c for c in features if cuts[c]]
        tallies = few_rows(clean.groupBy("_y").agg(F.count("*").alias("n")), "classes")
        classes = sorted(r["_y"] for r in tallies)
        if len(classes) < 2 or not usable:
            only = max(tallies, key=lambda r: (r["n"], -r["_y"]))["_y"]
            return FittedAdaBoost(list(features), classes, [Stump(features[0], 0.0, only, only, 1.0)])
        k, rows = len(classes), sum(r["n"] for r in tallies)
        code = F.coalesce(*[F.when(F.col("_y") == c, F.lit(i)) for i, c in enumerate(classes)])
        raw = Blocks.of(clean, [F.col(c) for c in usable], {"y": code})
        limits = [np.array(cuts[c]) for c in usable]
        blocks = raw.updated(lambda b: _binned(b, limits))
        raw.release()
        stumps: list[Stump] = []
        fresh: list[tuple[int, int, int, int, float]] = []
        shift = 0.0  # keeps the mean weight near 1, so that no exponent overflows
        try:
            for step in range(self.rounds):
                table = blocks.sums(lambda b: [_sums(b, fresh, shift, limits, k)])[0]
                feature, at, low, high, error, mass = _best_split(table, limits)
                shift += math.log(mass / rows)
                if error >= 1 - 1 / k:
                    break
                alpha = 1.0 if error <= 0 else self.rate * (math.log((1 - error) / error) + math.log(k - 1))
                stumps.append(Stump(usable[feature], float(limits[feature][at]), classes[low], classes[high], alpha))
                if error <= 0:
                    break
                fresh.append((feature, at, low, high, alpha))
                if len(fresh) >= self.settle_every and step + 1 < self.rounds:
                    settled, fresh = fresh, []
                    blocks = blocks.updated(lambda b, settled=settled: {**b, "log": _logs(b, settled)})
        finally:
            blocks.release()
        if not stumps:
            only = max(tallies, key=lambda r: (r["n"], -r["_y"]))["_y"]
            stumps = [Stump(usable[0], 0.0, only, only, 1.0)]
        return FittedAdaBoost(list(features), classes, stumps)

    def _cuts(self, clean: DataFrame, features: Sequence[str]) -> dict[str, list[float]]:
        steps = [i / self.bins for i in range(1, self.bins)]
        row = clean.agg(
            *[F.percentile_approx(c, steps, 10_000).alias(c) for c in features], *[F.max(c).alias(f"max|{c}") for c in features]
        ).first()
        return {c: sorted({v for v in (row[c] or []) if v < row[f"max|{c}"]}) for c in features}


def _binned(block: Block, limits: list[np.ndarray]) -> Block:
    """``bin`` (limits below the cell) instead of cells, and the logarithms of the weights to begin with."""
    kind = np.min_scalar_type(max(map(len, limits)))
    bins = np.stack([np.searchsorted(v, block["x"][:, f], "left") for f, v in enumerate(limits)], axis=1).astype(kind)
    return {"bin": bins, "y": block["y"].astype(np.int64), "log": np.zeros(len(bins))}


def _logs(block: Block, fresh: list[tuple[int, int, int, int, float]]) -> np.ndarray:
    """Logarithms of the rows' weights after the newest votes."""
    log = block["log"].copy()
    for feature, at, low, high, alpha in fresh:
        log += alpha * (np.where(block["bin"][:, feature] <= at, low, high) != block["y"])
    return log


def _sums(block: Block, fresh: list[tuple[int, int, int, int, float]], shift: float, limits: list[np.ndarray], k: int) -> np.ndarray:
    """Weights by bin and class, the bins of one feature after those of the other."""
    weight, parts = np.exp(_logs(block, fresh) - shift), []
    for f, v in enumerate(limits):
        n = len(v) + 1
        parts.append(np.bincount(block["bin"][:, f].astype(np.int64) * k + block["y"], weight, n * k).reshape(n, k))
    return np.concatenate(parts)


def _best_split(table: np.ndarray, limits: list[np.ndarray]) -> tuple[int, int, int, int, float, float]:
    """(feature, number of the limit, class below, class above, weighted error, weight of all rows) of the purest split.

    Ties go to the first feature, the smallest limit and the first class.
    """
    best, first = None, 0
    for f, v in enumerate(limits):
        own, first = table[first : first + len(v) + 1], first + len(v) + 1
        whole, below = own.sum(axis=0), own.cumsum(axis=0)[:-1]
        above = whole - below
        impurities = _impurity(below) + _impurity(above)
        at = int(impurities.argmin())
        if best is None or impurities[at] < best[0]:
            low, high = int(below[at].argmax()), int(above[at].argmax())
            error = max(0.0, float(1 - (below[at, low] + above[at, high]) / whole.sum()))
            best = (impurities[at], f, at, low, high, error, float(whole.sum()))
    return best[1:]


def _impurity(sums: np.ndarray) -> np.ndarray:
    """Gini impurity times the mass, along the last axis."""
    mass = sums.sum(axis=-1)
    return mass - np.divide((sums * sums).sum(axis=-1), mass, out=np.zeros_like(mass), where=mass > 0)
