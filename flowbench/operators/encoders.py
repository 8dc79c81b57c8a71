"""Encoders of rectified layers learned without labels, and the detectors that use them: codes for a net, and energies of reconstruction."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowbench.functions.names import require_columns
from flowbench.functions.values import finite_or
from flowbench.operators.blocks import Blocks
from flowbench.operators.encode import standard_stats
from flowbench.operators.energy import EnergyRule
from flowbench.operators.nets import FittedNet, Layers, Training, forward, labelled_blocks, matrix_of, new_layers, train, with_outputs


def fit_autoencoder(blocks: Blocks, width: int, hidden: Sequence[int], settings: Training, stacked: bool = False) -> tuple[Layers, Layers, list[float]]:
    """Encoder and decoder of rectified layers ``hidden`` (the last is the code) before a linear output, and the loss by epoch.

    ``stacked`` first trains one layer at a time, each on the codes of those before it, and then all of them together.
    """
    rng = np.random.default_rng(settings.seed)
    sizes = [width, *hidden]
    layers = new_layers([*sizes, *reversed(sizes[:-1])], rng)
    if stacked and len(hidden) > 1:
        encoder: Layers = []
        decoder: Layers = []
        for a, b in zip(sizes, sizes[1:]):
            (into, back), _ = train(blocks, new_layers([a, b, a], rng), "cells", settings, before=encoder)
            encoder, decoder = [*encoder, into], [back, *decoder]
        layers = [*encoder, *decoder]
    layers, history = train(blocks, layers, "cells", settings)
    return layers[: len(hidden)], layers[len(hidden) :], history


@dataclass
class FittedEncoder:
    features: list[str]
    stats: dict[str, tuple[float, float]]
    encoder: Layers
    decoder: Layers
    history: list[float]

    def encode(self, df: DataFrame, out: str = "code") -> DataFrame:
        """Adds the array of a row's code."""
        return with_outputs(df, self.features, self.stats, self.encoder, out, rectified=len(self.encoder))

    def energy(self, df: DataFrame, out: str = "energy") -> DataFrame:
        """Adds the mean squared gap between a scaled row and its reconstruction."""
        require_columns(df, self.features, numeric=True)
        shared = df.sparkSession.sparkContext.broadcast(([*self.encoder, *self.decoder], [self.stats[c] for c in self.features]))

        @F.pandas_udf("double")
        def gaps(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            layers, moments = shared.value
            mean, spread = np.array(moments).T
            for cells in parts:
                x = (np.stack(cells.to_numpy()) - mean) / np.where(spread == 0, 1.0, spread) if len(cells) else np.empty((0, len(mean)))
                yield pd.Series(((forward(layers, x)[0][-1] - x) ** 2).mean(axis=1))

        return df.withColumn(out, gaps(F.array(*[finite_or(c).cast("double") for c in self.features])))


@dataclass
class Encoder:
    """An autoencoder over scaled features; labels are not read."""

    hidden: Sequence[int] = (64, 32)
    training: Training = Training(dropout=0.0)
    stacked: bool = False
    name: str = "encoder"

    def fit(self, train_rows: DataFrame, features: Sequence[str]) -> FittedEncoder:
        features = list(require_columns(train_rows, features, numeric=True))
        stats = standard_stats(train_rows.select(*[finite_or(c).alias(c) for c in features]), features)
        blocks = matrix_of(train_rows, features, stats, {"w": F.lit(1.0)})
        if not blocks.rows:
            raise ValueError("the training table is empty")
        try:
            encoder, decoder, history = fit_autoencoder(blocks, len(features), self.hidden, self.training, self.stacked)
        finally:
            blocks.release()
        return FittedEncoder(features, stats, encoder, decoder, history)


@dataclass
class EncodedNet:
    """A net on the codes of an encoder that was learned without labels and stays as it is.

    Without ``head`` layers the net is a softmax regression. ``stacked`` encoders are trained layer by layer.
    """

    hidden: Sequence[int] = (64, 32)
    head: Sequence[int] = ()
    stacked: bool = False
    balanced: bool = True
    training: Training = Training()
    name: str = "self_taught_softmax"

    @staticmethod
    def deep(**settings) -> "EncodedNet":
        """A stacked encoder under a net with one hidden layer."""
        return EncodedNet(**{"head": (64,), "stacked": True, "balanced": False, "name": "stacked_encoder_network", **settings})

    def fit(self, train_rows: DataFrame, features: Sequence[str], label: str) -> FittedNet:
        features = list(require_columns(train_rows, features, numeric=True))
        blocks, stats, classes = labelled_blocks(train_rows, features, label, self.balanced)
        try:
            # The encoder sees every row alike.
            alike = Blocks(blocks.rdd.map(lambda b: {**b, "w": np.ones(len(b["w"]))}), blocks.rows)
            encoder, _, _ = fit_autoencoder(alike, len(features), self.hidden, replace(self.training, dropout=0.0), self.stacked)
            top = new_layers([self.hidden[-1], *self.head, len(classes)], np.random.default_rng(self.training.seed))
            top, history = train(blocks, top, "classes", self.training, before=encoder)
        finally:
            blocks.release()
        return FittedNet(self.name, features, stats, classes, [*encoder, *top], history)


@dataclass
class FittedReconstruction:
    kind: str
    features: list[str]
    encoder: FittedEncoder
    rule: EnergyRule
    normal_label: int
    attack_label: int

    def energy(self, df: DataFrame, out: str = "energy") -> DataFrame:
        return self.encoder.energy(df, out)

    def score(self, df: DataFrame) -> DataFrame:
        """Energy, prediction and the probability of the attack label."""
        scored = self.rule.score(self.energy(df), "energy")
        flagged = F.when(F.col("prediction") == 1, F.lit(self.attack_label)).otherwise(F.lit(self.normal_label))
        return scored.withColumn("prediction", flagged.cast("int"))


@dataclass
class ReconstructionDetector:
    """An autoencoder fitted on normal rows; energies above a percentile of theirs are attacks. With fewer than two normal rows all count."""

    hidden: Sequence[int] = (16, 4)
    percentile: float = 0.95
    training: Training = Training(dropout=0.0)
    name: str = "autoencoder_energy"

    def fit(self, train_rows: DataFrame, features: Sequence[str], label: str, normal_label: int = 0, attack_label: int = 1) -> FittedReconstruction:
        normal = train_rows.where(F.col(label) == normal_label)
        if len(normal.take(2)) < 2:
            normal = train_rows
        encoder = Encoder(self.hidden, self.training).fit(normal, features)
        rule = EnergyRule.fit(encoder.energy(normal).select("energy"), "energy", self.percentile)
        return FittedReconstruction(self.name, encoder.features, encoder, rule, normal_label, attack_label)
