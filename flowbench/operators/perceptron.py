"""MLlib's multilayer perceptron, fitted by sums over blocks of rows: one pass gives loss and gradient as products of matrices.

Layers, loss, seeded start and fitted model are MLlib's. L-BFGS runs on the driver, on vectors whose size follows from the layers.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from flowbench.operators.blocks import Block, Blocks
from flowbench.operators.nets import ROWS_AT_ONCE, class_loss

# Steps that L-BFGS remembers.
MEMORY = 10


def unpacked(flat: np.ndarray, sizes: Sequence[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Weights and offsets of each layer, from MLlib's order."""
    out, at = [], 0
    for a, b in zip(sizes, sizes[1:]):
        out.append((flat[at : at + a * b].reshape(a, b), flat[at + a * b : at + a * b + b]))
        at += a * b + b
    return out


def loss_and_gradient(block: Block, flat: np.ndarray, sizes: Sequence[int]) -> list[np.ndarray]:
    """Cross entropy over the block's rows, summed, and its gradient; sigmoid layers below a softmax.

    Worked out in the precision of the cells and summed in 64 bits.
    """
    kind = block["x"].dtype
    layers, loss, total = unpacked(flat.astype(kind), sizes), 0.0, np.zeros(flat.shape)
    sums = unpacked(total, sizes)
    for at in range(0, len(block["x"]), ROWS_AT_ONCE):
        outs = [block["x"][at : at + ROWS_AT_ONCE]]
        y = block["y"][at : at + ROWS_AT_ONCE]
        for i, (w, b) in enumerate(layers):
            z = outs[-1] @ w
            z += b
            if i < len(layers) - 1:
                # The sigmoid, in place; beyond 80 it is 0 or 1 in any precision.
                np.exp(-np.clip(z, -80, 80, out=z), out=z)
                z += 1
                np.reciprocal(z, out=z)
            outs.append(z)
        part, delta = class_loss(outs[-1], y, np.ones(len(y), kind))
        loss += part
        for i in range(len(layers) - 1, -1, -1):
            sums[i][0][...] += outs[i].T @ delta
            sums[i][1][...] += delta.sum(axis=0)
            if i:
                delta = delta @ layers[i][0].T
                delta *= outs[i]
                delta *= 1 - outs[i]
    return [np.array([loss]), total]


def least(fn: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, iterations: int, tol: float) -> np.ndarray:
    """L-BFGS with a line search for the Wolfe conditions, until the gains of ten steps are below ``tol`` of the value."""
    value, g = fn(x)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    history = [value]
    for _ in range(iterations):
        if not np.linalg.norm(g) > tol * max(abs(value), 1e-12):
            break
        way, kept = -g, []
        for s, d in reversed(steps):
            a = (s @ way) / (s @ d)
            kept.append(a)
            way = way - a * d
        if steps:
            s, d = steps[-1]
            way = way * ((s @ d) / (d @ d))
        for (s, d), a in zip(steps, reversed(kept)):
            way = way + (a - (d @ way) / (s @ d)) * s
        slope = g @ way
        if slope >= 0:
            way, slope, steps = -g, -(g @ g), []
        low, high, t = 0.0, np.inf, 1.0 if steps else min(1.0, 1 / np.linalg.norm(g))
        found = None
        for _ in range(20):
            there, own = fn(x + t * way)
            if not there <= value + 1e-4 * t * slope:
                high = t
            elif own @ way < 0.9 * slope:
                low, found = t, (t, there, own)
            else:
                found = (t, there, own)
                break
            t = 2 * low if high == np.inf else (low + high) / 2
        if found is None:
            break
        t, value, own = found
        s, d = t * way, own - g
        x, g = x + s, own
        if s @ d > 1e-12 * (d @ d):
            steps = [*steps, (s, d)][-MEMORY:]
        history.append(value)
        if len(history) > 10 and history[-11] - value <= tol * max(abs(value), 1e-12):
            break
    return x


class BlockPerceptron(MultilayerPerceptronClassifier):
    """The estimator with its parameters; only the search for the weights is done here."""

    def _fit(self, dataset):
        names = {k: self.getOrDefault(k) for k in (self.featuresCol, self.labelCol, self.maxIter, self.tol, self.layers)}
        sizes = names[self.layers]
        rows = dataset.select(vector_to_array(F.col(names[self.featuresCol])).alias("x"), F.col(names[self.labelCol]).cast("double").alias("y"))
        blocks = Blocks.of(rows, F.col("x"), {"y": F.col("y")}, narrow=True)
        one = dataset.limit(1)
        try:
            # Fitted for no iterations, MLlib gives its start: the initial weights, or those drawn from the seed.
            start = super(BlockPerceptron, self.copy({self.maxIter: 0}))._fit(one).weights.toArray()

            def measured(flat: np.ndarray) -> tuple[float, np.ndarray]:
                loss, gradient = blocks.sums(lambda b: loss_and_gradient(b, flat, sizes))
                return float(loss[0]) / blocks.rows, gradient / blocks.rows

            found = least(measured, start, names[self.maxIter], names[self.tol])
        finally:
            blocks.release()
        return super(BlockPerceptron, self.copy({self.maxIter: 0, self.initialWeights: Vectors.dense(found)}))._fit(one)
