"""Detectors with a closed form: Gaussian naive Bayes and linear discriminant, from class moments."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowbench.functions.names import require_columns
from flowbench.functions.values import finite_or
from flowbench.session import few_rows, settle


def _moments(train: DataFrame, features: Sequence[str], label: str) -> dict[int, dict]:
    """Rows, means and population variances of each class, in one pass; one row per class comes back."""
    cells = [f(finite_or(c)).alias(f"{n}|{c}") for c in features for n, f in (("m", F.avg), ("v", F.var_pop))]
    rows = few_rows(train.groupBy(F.col(label).cast("int").alias("y")).agg(F.count("*").alias("n"), *cells), "classes")
    if not rows:
        raise ValueError("the training table is empty")
    return {
        r["y"]: {"n": r["n"], "m": [r[f"m|{c}"] for c in features], "v": [r[f"v|{c}"] for c in features]}
        for r in sorted(rows, key=lambda r: r["y"])
    }


def _best_class(scores: dict[int, Column]) -> Column:
    """The class with the largest score; a tie goes to the smaller class."""
    best = F.greatest(*scores.values()) if len(scores) > 1 else next(iter(scores.values()))
    return F.coalesce(*[F.when(s == best, F.lit(y)) for y, s in scores.items()])


def _scored(df: DataFrame, scores: dict[int, Column]) -> DataFrame:
    """Adds ``prediction`` and, for two classes, the ``probability`` of the larger class."""
    names = {y: f"_log{y}" for y in scores}
    wide = df.withColumns({names[y]: s for y, s in scores.items()})
    cols = {y: F.col(n) for y, n in names.items()}
    out = wide.withColumn("prediction", _best_class(cols).cast("int"))
    if len(cols) == 2:
        low, high = sorted(cols)
        out = out.withColumn("probability", F.lit(1.0) / (F.lit(1.0) + F.exp(cols[low] - cols[high])))
    return out.drop(*names.values())


@dataclass
class FittedNaiveBayes:
    features: list[str]
    log_prior: dict[int, float]
    means: dict[int, list[float]]
    variances: dict[int, list[float]]

    def score(self, df: DataFrame) -> DataFrame:
        scores = {}
        for y, prior in self.log_prior.items():
            total = F.lit(prior - 0.5 * sum(math.log(2 * math.pi * v) for v in self.variances[y]))
            for c, m, v in zip(self.features, self.means[y], self.variances[y]):
                gap = finite_or(c) - F.lit(m)
                total = total - gap * gap / F.lit(2 * v)
            scores[y] = total
        return _scored(df, scores)


@dataclass
class GaussianNaiveBayes:
    """Every variance is widened by ``smoothing`` times the largest feature variance."""

    smoothing: float = 1e-9
    name: str = "gaussian_naive_bayes"

    def fit(self, train: DataFrame, features: Sequence[str], label: str) -> FittedNaiveBayes:
        features = require_columns(train, features, numeric=True)
        moments = _moments(train, features, label)
        total = sum(m["n"] for m in moments.values())
        widest = 0.0
        for i in range(len(features)):
            grand = sum(m["n"] * m["m"][i] for m in moments.values()) / total
            spread = sum(m["n"] * (m["v"][i] + (m["m"][i] - grand) ** 2) for m in moments.values()) / total
            widest = max(widest, spread)
        extra = self.smoothing * (widest or 1.0)  # features that are all constant keep a variance above 0
        return FittedNaiveBayes(
            list(features),
            {y: math.log(m["n"] / total) for y, m in moments.items()},
            {y: m["m"] for y, m in moments.items()},
            {y: [v + extra for v in m["v"]] for y, m in moments.items()},
        )


@dataclass
class FittedDiscriminant:
    features: list[str]
    weights: dict[int, list[float]]
    offsets: dict[int, float]

    def score(self, df: DataFrame) -> DataFrame:
        scores = {}
        for y, w in self.weights.items():
            total = F.lit(self.offsets[y])
            for c, x in zip(self.features, w):
                total = total + finite_or(c) * F.lit(x)
            scores[y] = total
        return _scored(df, scores)


@dataclass
class LinearDiscriminant:
    """Class means and one covariance for all classes.

    ``shrinkage`` pulls it towards a multiple of the identity; "auto" takes the share of Ledoit and Wolf (2004) from the data, with features
    scaled to the same spread. A singular covariance is inverted on the directions in which rows differ.
    """

    shrinkage: float | str | None = None
    name: str = "linear_discriminant"

    def fit(self, train: DataFrame, features: Sequence[str], label: str) -> FittedDiscriminant:
        features = require_columns(train, features, numeric=True)
        moments = _moments(train, features, label)
        n, k, d = sum(m["n"] for m in moments.values()), len(moments), len(features)
        means = settle(
            train.sparkSession.createDataFrame(
                [(y, *m["m"]) for y, m in moments.items()], "_y int, " + ", ".join(f"_m{i} double" for i in range(d))
            )
        )
        centred = train.join(means, F.col(label).cast("int") == F.col("_y")).select(
            *[(finite_or(c) - F.col(f"_m{i}")).alias(f"_c{i}") for i, c in enumerate(features)]
        )
        vectors = VectorAssembler(inputCols=[f"_c{i}" for i in range(d)], outputCol="v").transform(centred).select("v")
        # Rows are centred per class, so correlations and within-class deviations give the pooled covariance.
        corr = np.nan_to_num(Correlation.corr(vectors, "v").first()[0].toArray())
        within = np.sqrt([sum(m["n"] * m["v"][i] for m in moments.values()) / max(n - k, 1) for i in range(d)])
        if self.shrinkage is not None:
            # The shrunk estimate divides by the number of rows.
            within = within * math.sqrt(max(n - k, 1) / n)
        varied = within > 0
        corr = np.where(np.outer(varied, varied), corr, 0.0)
        if self.shrinkage == "auto":
            share = _ledoit_wolf(centred, corr, within, n)
            corr = (1 - share) * corr + share * np.diag(varied.astype(float))
        # Inverted at one scale for all features: widths differ by many powers of ten.
        spread = np.where(varied, within, 1.0)
        if self.shrinkage is None or self.shrinkage == "auto":
            inverse = np.linalg.pinv(corr, hermitian=True) / np.outer(spread, spread)
        else:
            cov = corr * np.outer(within, within)
            cov = (1 - self.shrinkage) * cov + self.shrinkage * np.trace(cov) / d * np.eye(d)
            inverse = np.linalg.pinv(cov, hermitian=True)
        weights, offsets = {}, {}
        for y, m in moments.items():
            mean = np.array(m["m"])
            w = inverse @ mean
            weights[y] = w.tolist()
            offsets[y] = float(math.log(m["n"] / n) - 0.5 * mean @ w)
        return FittedDiscriminant(list(features), weights, offsets)


def _ledoit_wolf(centred: DataFrame, corr: np.ndarray, within: np.ndarray, n: int) -> float:
    """Share of the identity that brings the estimate closest to the true covariance, from the rows' fourth moments in one aggregate."""
    own = [i for i, w in enumerate(within) if w > 0]
    if not own:
        return 0.0
    length = sum((F.pow(F.col(f"_c{i}") / F.lit(float(within[i])), 2) for i in own), F.lit(0.0))
    fourth = centred.agg(F.avg(length * length)).first()[0]
    squares, p = float((corr**2).sum()), len(own)
    noise, distance = (fourth - squares) / (p * n), (squares - p) / p
    return min(noise, distance) / distance if distance > 1e-12 else 0.0
