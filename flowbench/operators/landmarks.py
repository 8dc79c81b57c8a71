"""Kernel classifiers by landmarks: rows are mapped to kernel values with some training rows, and the dual of the hinge loss is solved there.

With the factor of the landmarks' kernel matrix (Williams and Seeger, 2001) the map's inner products equal the kernel on the landmarks and come close
elsewhere; with every row a landmark they are the kernel itself. The dual is solved by coordinate ascent inside each block; the blocks' steps are
added safely (Ma et al., 2015), so the result does not hang on how rows are dealt out. Multipliers stay with their rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowbench.functions.names import require_columns
from flowbench.functions.values import finite_or
from flowbench.operators.blocks import Block, Blocks
from flowbench.operators.encode import standardise
from flowbench.operators.nets import labelled_blocks

KERNELS = ("rbf", "poly", "sigmoid", "linear")
# Rows of a block whose margins are worked out together.
RUN = 500


@dataclass(frozen=True)
class Kernel:
    """``rbf``: exp(-gamma |x-y|²), ``poly``: (gamma xy + coef0) ** degree, ``sigmoid``: tanh(gamma xy + coef0), ``linear``: xy; each plus 1, which takes the place of an offset."""

    kind: str = "rbf"
    gamma: float = 1.0
    degree: int = 3
    coef0: float = 0.0

    def of(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        inner = x @ y.T
        if self.kind == "linear":
            return inner + 1.0
        if self.kind == "poly":
            return (self.gamma * inner + self.coef0) ** self.degree + 1.0
        if self.kind == "sigmoid":
            return np.tanh(self.gamma * inner + self.coef0) + 1.0
        squares = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1) - 2 * inner
        return np.exp(-self.gamma * np.maximum(squares, 0.0)) + 1.0

    def onto(self, y: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
        """``of`` with the same second table many times: ``rbf`` is one product of matrices, worked on in place."""
        if self.kind != "rbf":
            return lambda x: self.of(x, y)
        sides = np.vstack([2 * y.T, np.full(len(y), -1.0), -(y * y).sum(axis=1)]) * self.gamma

        def values(x: np.ndarray) -> np.ndarray:
            out = np.column_stack([x, (x * x).sum(axis=1), np.ones(len(x))]) @ sides
            np.minimum(out, 0.0, out=out)
            np.exp(out, out=out)
            out += 1.0
            return out

        return values


def factor(kernel: Kernel, landmarks: np.ndarray) -> np.ndarray:
    """Matrix that turns kernel values with the landmarks into coordinates; directions of no or negative weight are left out."""
    values, vectors = np.linalg.eigh(kernel.of(landmarks, landmarks))
    kept = values > 1e-10 * max(values.max(), 1e-300)
    return vectors[:, kept] / np.sqrt(values[kept])


@dataclass
class FittedLandmarks:
    kind: str
    features: list[str]
    stats: dict[str, tuple[float, float]]
    classes: list[int]
    kernel: Kernel
    landmarks: np.ndarray
    weights: np.ndarray  # of each landmark, a column for each margin
    facts: dict

    def margins(self, x: np.ndarray) -> np.ndarray:
        return self.kernel.of(x, self.landmarks) @ self.weights

    def score(self, df: DataFrame) -> DataFrame:
        """``prediction`` and ``margin`` of the larger class, or the array ``margins`` of each class against the others."""
        require_columns(df, self.features, numeric=True)
        # Sent to each task: bounded by the number of landmarks.
        shared = df.sparkSession.sparkContext.broadcast((self, np.array([self.stats[c] for c in self.features])))

        @F.pandas_udf("array<double>")
        def margins(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model, moments = shared.value
            for cells in parts:
                x = np.stack(cells.to_numpy()) if len(cells) else np.empty((0, len(moments)))
                x = (x - moments[:, 0]) / np.where(moments[:, 1] == 0, 1.0, moments[:, 1])
                yield pd.Series(list(model.margins(x)))

        out = df.withColumn("margins", margins(F.array(*[finite_or(c).cast("double") for c in self.features])))
        names = F.array(*map(F.lit, self.classes))
        if len(self.classes) == 2:
            out = out.withColumn("margin", F.col("margins")[0]).drop("margins")
            return out.withColumn("prediction", F.element_at(names, F.when(F.col("margin") > 0, 2).otherwise(1)).cast("int"))
        best = F.array_position("margins", F.array_max("margins")).cast("int")
        return out.withColumn("prediction", F.element_at(names, best).cast("int"))


@dataclass
class LandmarkSvm:
    """Hinge loss with weight ``c``, times rows / (classes * rows of the class) if ``balanced``. ``gamma`` None is 1 / features.

    ``landmarks`` training rows at most, those with the smallest hashes of their numbers, are a documented bound: more come closer to the kernel. Rounds end when
    the gap between primal and dual is below ``gap`` times the primal. More than two classes: one margin for each class against the rest.
    """

    kernel: str = "rbf"
    c: float = 1.0
    gamma: float | None = None
    degree: int = 3
    coef0: float = 0.0
    landmarks: int = 256
    rounds: int = 60
    gap: float = 1e-3
    balanced: bool = True
    seed: int = 42
    name: str = "landmark_svm"

    def fit(self, train: DataFrame, features: Sequence[str], label: str) -> FittedLandmarks:
        if self.kernel not in KERNELS:
            raise ValueError(f"unknown kernel {self.kernel!r}")
        features = list(require_columns(train, features, numeric=True))
        blocks, stats, classes = labelled_blocks(train, features, label, self.balanced)
        kernel = Kernel(self.kernel, self.gamma if self.gamma is not None else 1.0 / len(features), self.degree, self.coef0)
        chosen = _chosen(train, features, stats, self.landmarks, self.seed)
        into = factor(kernel, chosen)
        targets = [1] if len(classes) == 2 else list(range(len(classes)))
        if len(classes) == 1:
            blocks.release()
            return FittedLandmarks(self.name, features, stats, classes, kernel, chosen, np.zeros((len(chosen), 1)), {})
        w = np.zeros((into.shape[1], len(targets)))
        parts = blocks.rdd.count()
        now = blocks
        history = []
        for round_ in range(self.rounds):
            before = now
            now = before.stepped(lambda b, w=w, r=round_: _ascend(b, kernel, chosen, into, w, targets, self.c, parts, self.seed + r), cut=round_ % 10 == 9)
            delta, sums = now.sums(lambda b: [b["delta"], b["sums"]])
            before.release()
            # The sums are of the multipliers and weights that the round began with.
            hinge, alphas = sums
            size = 0.5 * (w * w).sum(axis=0)
            primal, dual = size + hinge, alphas - size
            history.append(float(((primal - dual) / np.maximum(primal, 1e-12)).max()))
            if round_ and history[-1] <= self.gap:
                break
            w = w + delta
        support = int(now.sums(lambda b: [np.array([(b["alpha"] > 1e-9).any(axis=1).sum()])])[0][0])
        now.release()
        return FittedLandmarks(self.name, features, stats, classes, kernel, chosen, into @ w, {"support_vectors": support, "gaps": history})


def _chosen(train: DataFrame, features: Sequence[str], stats, most: int, seed: int) -> np.ndarray:
    """Scaled cells of at most so many different rows; which ones follows from a hash of the cells."""
    cells = train.select(*[finite_or(c).cast("double").alias(f"_f{i}") for i, c in enumerate(features)]).distinct()
    by = F.xxhash64(F.lit(seed), *cells.columns)
    few = cells.orderBy(by, *cells.columns).limit(most)
    rows = standardise(few, {f"_f{i}": stats[c] for i, c in enumerate(features)}).toPandas()
    return rows.to_numpy(float)


def _ascend(block: Block, kernel: Kernel, landmarks: np.ndarray, into: np.ndarray, w: np.ndarray, targets: list[int], c: float, parts: int, seed: int) -> Block:
    """One pass of dual coordinate ascent over the block's rows for each margin; ``sums`` are hinge losses and multipliers before it.

    Rows come in runs of ``RUN``. A row whose multiplier is at its bound and would stay there by the margins at the beginning of its run is not visited in
    this pass; only visited rows are mapped, and a margin is a product with the landmarks' weights.
    """
    x, n = block["x"], len(block["x"])
    alpha = block["alpha"].copy() if "alpha" in block else np.zeros((n, len(targets)))
    top = c * block["w"]
    delta, sums, before = np.zeros_like(w), np.zeros((2, len(targets))), into @ w
    sums[1] = alpha.sum(axis=0)
    order = np.random.default_rng([seed, n]).permutation(n)
    own, onto = w.copy(), kernel.onto(landmarks)
    for start in range(0, n, RUN):
        run = order[start : start + RUN]
        values = onto(x[run])
        old, now = np.split(values @ np.hstack([before, into @ own]), 2, axis=1)
        for k, target in enumerate(targets):
            y, a, most, inner_w = np.where(block["y"][run] == target, 1.0, -1.0), alpha[run, k], top[run], own[:, k].copy()
            sums[0, k] += (most * np.maximum(0.0, 1 - y * old[:, k])).sum()
            slack = 1 - y * now[:, k]
            visited = np.flatnonzero(~(((a <= 0) & (slack <= 0)) | ((a >= most) & (slack >= 0))))
            z = values[visited] @ into
            squares = parts * (z * z).sum(axis=1)
            for place, i in enumerate(visited.tolist()):
                if squares[place] <= 0:
                    continue
                new = min(max(a[i] + (1 - y[i] * (z[place] @ inner_w)) / squares[place], 0.0), most[i])
                if new != a[i]:
                    step = (new - a[i]) * y[i]
                    a[i] = new
                    inner_w += parts * step * z[place]
                    delta[:, k] += step * z[place]
            alpha[run, k], own[:, k] = a, inner_w
    return {**block, "alpha": alpha, "delta": delta, "sums": sums}
