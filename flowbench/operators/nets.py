"""Feed-forward nets trained on all rows: rectified layers, dropout, mini-batches, AdamW, early stopping.

A step sums the gradients of one mini-batch over all blocks; a row's batch follows from a hash of its number and the epoch. Weights and
the optimiser's state are on the driver: their size follows from the layers.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowbench.functions.names import require_columns
from flowbench.functions.values import finite_or
from flowbench.operators.blocks import Block, Blocks
from flowbench.operators.encode import standard_stats, standardise
from flowbench.operators.leafwise import drawn, draws
from flowbench.session import few_rows

Layers = list[tuple[np.ndarray, np.ndarray]]

# Rows that go through the layers at once: what they put out stays in the cache of a core.
ROWS_AT_ONCE = 1024


@dataclass(frozen=True)
class Training:
    """``steps`` mini-batches make an epoch, each with an equal share of the rows. After ``patience`` epochs without a smaller loss on the
    validation share the best layers so far are taken; a share of 0 trains for all epochs."""

    epochs: int = 30
    steps: int = 4
    rate: float = 2e-2
    decay: float = 1e-4
    dropout: float = 0.1
    validation: float = 0.1
    patience: int = 6
    seed: int = 42


def new_layers(sizes: Sequence[int], rng: np.random.Generator) -> Layers:
    """Weights spread for rectified units (He et al., 2015), offsets of 0."""
    return [(rng.normal(0, np.sqrt(2 / a), (a, b)), np.zeros(b)) for a, b in zip(sizes, sizes[1:])]


def forward(layers: Layers, x: np.ndarray, dropout: float = 0.0, rng: np.random.Generator | None = None, rectified: int | None = None):
    """What each layer puts out, input first, and the masks of dropout; all but the last layer (or the first ``rectified``) cut off below 0."""
    hidden = len(layers) - 1 if rectified is None else rectified
    outs, masks = [x], []
    for i, (w, b) in enumerate(layers):
        z = outs[-1] @ w
        z += b
        mask = None
        if i < hidden:
            np.maximum(z, 0, out=z)
            if dropout and rng is not None and i < len(layers) - 1:
                mask = (rng.random(z.shape, dtype=z.dtype) >= dropout).astype(z.dtype) / z.dtype.type(1 - dropout)
                z = z * mask
        outs.append(z)
        masks.append(mask)
    return outs, masks


def backward(layers: Layers, outs: list[np.ndarray], masks: list, delta: np.ndarray, rectified: int | None = None) -> list[np.ndarray]:
    """Gradients by each layer's weights and offsets, from ``delta``, the gradient by the last layer's output."""
    hidden = len(layers) - 1 if rectified is None else rectified
    found: list[np.ndarray] = []
    for i in range(len(layers) - 1, -1, -1):
        if i < hidden:
            delta = delta * (outs[i + 1] > 0)
            if masks[i] is not None:
                delta = delta * masks[i]
        found = [outs[i].T @ delta, delta.sum(axis=0), *found]
        if i:
            delta = delta @ layers[i][0].T
    return found


def class_loss(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray]:
    """Weighted cross entropy of softmax outputs, summed, and its gradient by the outputs."""
    z = z - z.max(axis=1, keepdims=True)
    log_p = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
    k = y.astype(np.int64)
    delta = np.exp(log_p)
    delta[np.arange(len(z)), k] -= 1
    return float(-(w * log_p[np.arange(len(z)), k]).sum()), delta * w[:, None]


def square_loss(z: np.ndarray, x: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray]:
    """Weighted mean squared gap of each row, summed, and its gradient by the outputs."""
    gap = z - x
    return float((w[:, None] * gap * gap).sum() / x.shape[1]), 2 * gap * w[:, None] / x.shape[1]


def _part(block: Block, settings: Training) -> np.ndarray:
    """Whether a row is held back for validation."""
    rows = block["row"].astype(np.uint64)
    return drawn(rows, -1, settings.validation, settings.seed) if settings.validation else np.zeros(len(rows), bool)


def _as(kind: np.dtype, layers: Layers) -> Layers:
    return [(w.astype(kind, copy=False), b.astype(kind, copy=False)) for w, b in layers]


def _cells(block: Block, own: np.ndarray, before: Layers) -> np.ndarray:
    """The cells of some rows, or their codes by the rectified layers ``before``."""
    x = block["x"][own]
    return forward(before, x, rectified=len(before))[0][-1] if before else x


def gradient_sums(block: Block, layers: Layers, kind: str, settings: Training, epoch: int, step: int, rectified: int | None = None, before: Layers = ()) -> list[np.ndarray]:
    """Gradients over the block's rows of one mini-batch, the sum of their weights last; worked out in the precision of the cells, summed in 64 bits."""
    layers, before = _as(block["x"].dtype, layers), _as(block["x"].dtype, before)
    rows = block["row"].astype(np.uint64)
    # Slots of an epoch: a row's slot is its draw, cut into as many equal shares as there are steps.
    draw = draws(rows, epoch, settings.seed + 1)
    own = np.flatnonzero((draw < (step + 1) / settings.steps) & ~(draw < step / settings.steps))
    own = own[~_part({"row": block["row"][own]}, settings)]
    first = int(rows[0]) if len(rows) else 0
    rng = np.random.default_rng([settings.seed, epoch, step, first])
    total = [*(np.zeros(p.shape) for layer in layers for p in layer), np.zeros(1)]
    for at in range(0, len(own), ROWS_AT_ONCE):
        some = own[at : at + ROWS_AT_ONCE]
        x, w = _cells(block, some, before), block["w"][some].astype(block["x"].dtype)
        outs, masks = forward(layers, x, settings.dropout, rng, rectified)
        if kind == "classes":
            _, delta = class_loss(outs[-1], block["y"][some], w)
        else:
            _, delta = square_loss(outs[-1], x, w)
        for into, found in zip(total, [*backward(layers, outs, masks, delta, rectified), w.sum()]):
            into += found
    return total


def loss_sums(block: Block, layers: Layers, kind: str, settings: Training, held_back: bool, rectified: int | None = None, before: Layers = ()) -> list[np.ndarray]:
    """Loss and weight over the rows held back, or over the others."""
    layers, before = _as(block["x"].dtype, layers), _as(block["x"].dtype, before)
    own = np.flatnonzero(_part(block, settings) == held_back)
    total = np.zeros(2)
    for at in range(0, len(own), ROWS_AT_ONCE):
        some = own[at : at + ROWS_AT_ONCE]
        x, w = _cells(block, some, before), block["w"][some]
        z = forward(layers, x, rectified=rectified)[0][-1]
        loss = class_loss(z, block["y"][some], w)[0] if kind == "classes" else square_loss(z, x, w)[0]
        total += [loss, w.sum()]
    return [total]


def train(blocks: Blocks, layers: Layers, kind: str, settings: Training, rectified: int | None = None, before: Layers = ()) -> tuple[Layers, list[float]]:
    """Layers after training, and the loss by epoch (on the validation share, or else on all rows).

    With layers ``before``, which stay as they are, the net is trained on their codes; only rows that a step reads are coded.
    """
    first = [np.zeros_like(p) for layer in layers for p in layer]
    second = [np.zeros_like(p) for layer in layers for p in layer]
    best, history, since, t = (np.inf, layers), [], 0, 0
    held_back = settings.validation > 0
    for epoch in range(settings.epochs + 1):
        for step in range(settings.steps if epoch < settings.epochs else 0):
            now = layers
            # The first pass of an epoch measures the loss after the one before, too.
            measured = step == 0 and epoch > 0
            found = blocks.sums(lambda b: [*gradient_sums(b, now, kind, settings, epoch, step, rectified, before), *(loss_sums(b, now, kind, settings, held_back, rectified, before) if measured else [])])
            if measured and not _goes_on(history, found.pop()):
                return layers, history  # too few rows to hold any back
            if measured:
                best, since = ((history[-1], layers), 0) if history[-1] < best[0] - 1e-6 else (best, since + 1)
                if held_back and since >= settings.patience:
                    return best[1], history
            *gradient, mass = found
            if mass[0] <= 0:
                continue
            t += 1
            flat = [p for layer in layers for p in layer]
            out = []
            for i, (p, g) in enumerate(zip(flat, gradient)):
                g = g / mass[0]
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                move = (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)
                shrink = settings.decay * p if p.ndim == 2 else 0.0  # decay apart from the gradient, on weights alone
                out.append(p - settings.rate * (move + shrink))
            layers = [(out[i], out[i + 1]) for i in range(0, len(out), 2)]
    now = layers
    if _goes_on(history, blocks.sums(lambda b: loss_sums(b, now, kind, settings, held_back, rectified, before))[0]) and history[-1] < best[0]:
        best = (history[-1], layers)
    return (best[1] if held_back and history else layers), history


def _goes_on(history: list[float], measured: np.ndarray) -> bool:
    """Takes down a loss; False if there is no row to measure it on."""
    if measured[1] <= 0:
        return False
    history.append(float(measured[0] / measured[1]))
    return True


def matrix_of(df: DataFrame, features: Sequence[str], stats, others: dict) -> Blocks:
    """Blocks of scaled features in 32 bits, further columns and a row number."""
    names = {f"_o{i}": c for i, c in enumerate(others.values())}
    wide = df.select(*[finite_or(c).alias(f"_f{i}") for i, c in enumerate(features)], *[c.alias(n) for n, c in names.items()])
    wide = standardise(wide, {f"_f{i}": stats[c] for i, c in enumerate(features)})
    cells = [F.col(f"_f{i}") for i in range(len(features))]
    columns = {k: F.col(n) for k, n in zip(others, names)}
    return Blocks.of(wide, cells, {**columns, "row": F.monotonically_increasing_id()}, narrow=True)


def labelled_blocks(rows: DataFrame, features: Sequence[str], label: str, balanced: bool) -> tuple[Blocks, dict, list[int]]:
    """Blocks with class numbers and weights, the features' statistics, and the classes."""
    y = F.col(label).cast("int")
    tallies = {r["y"]: r["n"] for r in few_rows(rows.groupBy(y.alias("y")).agg(F.count("*").alias("n")), "classes")}
    if not tallies:
        raise ValueError("the training table is empty")
    classes, total = sorted(tallies), sum(tallies.values())
    stats = standard_stats(rows.select(*[finite_or(c).alias(c) for c in features]), features)
    code = F.coalesce(*[F.when(y == c, F.lit(i)) for i, c in enumerate(classes)])
    weight = F.coalesce(*[F.when(y == c, F.lit(total / (len(classes) * n) if balanced else 1.0)) for c, n in tallies.items()])
    return matrix_of(rows, features, stats, {"y": code, "w": weight}), stats, classes


def with_outputs(df: DataFrame, features: Sequence[str], stats, layers: Layers, out: str, rectified: int | None = None) -> DataFrame:
    """Adds the array of the last layer's outputs, computed in Arrow batches; the layers are sent to each task."""
    require_columns(df, features, numeric=True)
    shared = df.sparkSession.sparkContext.broadcast((layers, [stats[c] for c in features]))

    @F.pandas_udf("array<double>")
    def outputs(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own, moments = shared.value
        mean, spread = np.array(moments).T
        spread = np.where(spread == 0, 1.0, spread)
        for cells in parts:
            x = (np.stack(cells.to_numpy()) - mean) / spread if len(cells) else np.empty((0, len(mean)))
            yield pd.Series(list(forward(own, x, rectified=rectified)[0][-1]))

    return df.withColumn(out, outputs(F.array(*[finite_or(c).cast("double") for c in features])))


@dataclass
class FittedNet:
    kind: str
    features: list[str]
    stats: dict[str, tuple[float, float]]
    classes: list[int]
    layers: Layers
    history: list[float]

    def score(self, df: DataFrame) -> DataFrame:
        """``prediction`` and ``probability`` of the larger class, or the array ``probabilities`` for more classes."""
        raw = with_outputs(df, self.features, self.stats, self.layers, "_raw")
        top = F.array_max("_raw")
        e = raw.withColumn("_e", F.transform("_raw", lambda v: F.exp(v - top)))
        total = F.aggregate("_e", F.lit(0.0), lambda a, v: a + v)
        out = e.withColumn("probabilities", F.transform("_e", lambda v: v / total))
        best = F.array_position("_raw", top).cast("int")
        out = out.withColumn("prediction", F.element_at(F.array(*map(F.lit, self.classes)), best).cast("int")).drop("_raw", "_e")
        if len(self.classes) == 2:
            out = out.withColumn("probability", F.col("probabilities")[1]).drop("probabilities")
        return out


@dataclass
class Network:
    """Rectified layers with dropout. ``balanced`` weighs classes by rows / (classes * rows of the class)."""

    hidden: Sequence[int] = (64, 32)
    training: Training = Training()
    balanced: bool = False
    name: str = "rectified_network"

    def fit(self, train_rows: DataFrame, features: Sequence[str], label: str) -> FittedNet:
        features = list(require_columns(train_rows, features, numeric=True))
        blocks, stats, classes = labelled_blocks(train_rows, features, label, self.balanced)
        layers = new_layers([len(features), *self.hidden, len(classes)], np.random.default_rng(self.training.seed))
        try:
            layers, history = train(blocks, layers, "classes", self.training)
        finally:
            blocks.release()
        return FittedNet(self.name, features, stats, classes, layers, history)


