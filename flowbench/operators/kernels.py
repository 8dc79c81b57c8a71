"""Support-vector classifier with a Gaussian kernel through random Fourier features (Rahimi and Recht, 2007).

The fit keeps the scaled cells as blocks and works the Fourier features out in each pass, some rows at a time: kept as columns, they
would take several times the room of the cells.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowbench.functions.names import require_columns
from flowbench.functions.values import finite_or
from flowbench.operators.blocks import Block
from flowbench.operators.encode import standardise
from flowbench.operators.learners import _penalty
from flowbench.operators.nets import ROWS_AT_ONCE, labelled_blocks
from flowbench.operators.perceptron import least


@dataclass(frozen=True)
class FourierFeatures:
    """cos(w.x + b) columns; weights follow from the seed, the feature count and the kernel width."""

    features: tuple[str, ...]
    stats: dict[str, tuple[float, float]]
    gamma: float
    size: int
    seed: int

    @property
    def names(self) -> list[str]:
        return [f"_rff{i}" for i in range(self.size)]

    def drawn(self) -> tuple[np.ndarray, np.ndarray]:
        """Weights (scaled feature, column) and shifts of the columns."""
        draw, spread = random.Random(self.seed), math.sqrt(2 * self.gamma)
        columns = [([draw.gauss(0, spread) for _ in self.features], draw.uniform(0, 2 * math.pi)) for _ in range(self.size)]
        return np.array([w for w, _ in columns]).reshape(self.size, -1).T, np.array([b for _, b in columns])

    def transform(self, df: DataFrame) -> DataFrame:
        weights, shifts = self.drawn()
        clean = {f"_s{i}": finite_or(c) for i, c in enumerate(self.features)}
        scaled = standardise(df.withColumns(clean), {f"_s{i}": self.stats[c] for i, c in enumerate(self.features)})
        height, out = math.sqrt(2 / self.size), {}
        for name, own, shift in zip(self.names, weights.T.tolist(), shifts.tolist()):
            out[name] = F.lit(height) * F.cos(sum((F.lit(w) * F.col(s) for w, s in zip(own, clean)), F.lit(shift)))
        return scaled.withColumns(out).drop(*clean)


def _fourier(x: np.ndarray, weights: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    z = x @ weights
    z += shifts
    np.cos(z, out=z)
    z *= z.dtype.type(math.sqrt(2 / len(shifts)))
    return z


def hinge_and_gradient(block: Block, flat: np.ndarray, target: int, weights: np.ndarray, shifts: np.ndarray) -> list[np.ndarray]:
    """Weighted hinge loss of a linear margin on the Fourier features (``flat``: coefficients and offset), summed, its gradient, and the weights' sum."""
    kind, loss, total = block["x"].dtype, 0.0, np.zeros(len(flat))
    weights, shifts, own = weights.astype(kind), shifts.astype(kind), flat.astype(kind)
    for at in range(0, len(block["x"]), ROWS_AT_ONCE):
        rows = slice(at, at + ROWS_AT_ONCE)
        z = _fourier(block["x"][rows], weights, shifts)
        sign = np.where(block["y"][rows] == target, 1.0, -1.0)
        gap = np.maximum(0.0, 1 - sign * (z @ own[:-1] + own[-1]))
        loss += float((block["w"][rows] * gap).sum())
        slope = np.where(gap > 0, -sign * block["w"][rows], 0.0)
        total[:-1] += slope.astype(kind) @ z
        total[-1] += slope.sum()
    return [np.array([loss, block["w"].sum()]), total]


@dataclass
class FittedKernelSvm:
    kind: str
    features: list[str]
    fourier: FourierFeatures
    weights: np.ndarray  # of each Fourier feature, a column for each margin
    offsets: np.ndarray

    def score(self, df: DataFrame) -> DataFrame:
        """``prediction`` and ``margin`` of class 1, or the array ``margins`` of each class against the others."""
        require_columns(df, self.features, numeric=True)
        moments = np.array([self.fourier.stats[c] for c in self.features])
        # Sent to each task: bounded by the number of Fourier features.
        shared = df.sparkSession.sparkContext.broadcast((moments, *self.fourier.drawn(), self.weights, self.offsets))

        @F.pandas_udf("array<double>")
        def margins(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            moments, ways, shifts, weights, offsets = shared.value
            for cells in parts:
                x = np.stack(cells.to_numpy()) if len(cells) else np.empty((0, len(moments)))
                x = (x - moments[:, 0]) / np.where(moments[:, 1] == 0, 1.0, moments[:, 1])
                yield pd.Series(list(_fourier(x, ways, shifts) @ weights + offsets))

        out = df.withColumn("margins", margins(F.array(*[finite_or(c).cast("double") for c in self.features])))
        if len(self.offsets) == 1:
            out = out.withColumn("margin", F.col("margins")[0]).drop("margins")
            return out.withColumn("prediction", (F.col("margin") > 0).cast("int"))
        return out.withColumn("prediction", (F.array_position("margins", F.array_max("margins")) - 1).cast("int"))


@dataclass
class KernelSvm:
    """Gaussian-kernel classifier; ``gamma`` None is 1 / number of scaled features. Labels are codes from 0; more than two classes: a margin for each against the rest.

    The loss is MLlib's for linear classifiers: the weighted mean of the hinge and a penalty on the coefficients without the offset.
    """

    c: float = 1.0
    gamma: float | None = None
    size: int = 128
    iterations: int = 100
    balanced: bool = True
    seed: int = 42
    name: str = "kernel_svm"

    def fit(self, train: DataFrame, features: Sequence[str], label: str) -> FittedKernelSvm:
        features = list(require_columns(train, features, numeric=True))
        blocks, stats, classes = labelled_blocks(train, features, label, self.balanced)
        gamma = self.gamma if self.gamma is not None else 1.0 / len(features)
        fourier = FourierFeatures(tuple(features), stats, gamma, self.size, self.seed)
        ways, shifts = fourier.drawn()
        penalty, k = _penalty(self.c), max(2, classes[-1] + 1)
        found = []
        try:
            for target in [1] if k == 2 else range(k):
                # Blocks hold classes by their place; one that has no rows is at none.
                place = classes.index(target) if target in classes else -1

                def measured(flat: np.ndarray) -> tuple[float, np.ndarray]:
                    (loss, mass), gradient = blocks.sums(lambda b: hinge_and_gradient(b, flat, place, ways, shifts), small=True)
                    slope = gradient / mass
                    slope[:-1] += penalty * flat[:-1]
                    return float(loss / mass + 0.5 * penalty * (flat[:-1] ** 2).sum()), slope

                found.append(least(measured, np.zeros(self.size + 1), self.iterations, 1e-6))
        finally:
            blocks.release()
        flat = np.stack(found, axis=1)
        return FittedKernelSvm(self.name, features, fourier, flat[:-1], flat[-1])
