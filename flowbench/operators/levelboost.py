"""MLlib's gradient-boosted trees, fitted by sums over blocks of rows.

Loss, parameters and the meaning of margins are those of ``GBTClassifier``: each tree fits the negative gradient of the logistic loss by least squares,
level by level, on a share of the rows and, in each node, of the features. Cells are binned once. A pass over the rows counts the smaller child of
every split; the larger one follows by subtraction from their parent.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import asdict

import numpy as np
import pandas as pd
from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasPredictionCol, HasProbabilityCol, HasRawPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowbench.operators.blocks import Block, Blocks
from flowbench.operators.leafwise import Tree, _in_values, _limits, drawn, ends

# Rounds after which margins go to the checkpoint folder.
SETTLE_EVERY = 10


class BoostedTrees(Model, HasFeaturesCol, HasPredictionCol, HasRawPredictionCol, HasProbabilityCol, DefaultParamsReadable, DefaultParamsWritable):
    """The fitted trees; half the log odds of class 1 are the sum of their values."""

    trees = Param(Params._dummy(), "trees", "trees as JSON, with values that include their weights", TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(featuresCol="features", predictionCol="prediction", rawPredictionCol="rawPrediction", probabilityCol="probability")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        # Sent to each task: its size follows from rounds and depth.
        shared = dataset.sparkSession.sparkContext.broadcast([Tree(*map(np.array, t.values())) for t in json.loads(self.getOrDefault(self.trees))])

        @F.pandas_udf("array<double>")
        def raw(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for cells in batches:
                x = np.stack(cells.to_numpy()) if len(cells) else np.empty((0, 1))
                margin = sum((tree.values(x) for tree in shared.value), np.zeros(len(x)))
                yield pd.Series(list(np.stack([-margin, margin], axis=1)))

        name = {p: self.getOrDefault(p) for p in (self.featuresCol, self.predictionCol, self.rawPredictionCol, self.probabilityCol)}
        out = dataset.withColumn("_raw", raw(vector_to_array(F.col(name[self.featuresCol]))))
        p = 1 / (1 + F.exp(-2 * F.col("_raw")[1]))
        if name[self.probabilityCol]:
            out = out.withColumn(name[self.probabilityCol], array_to_vector(F.array(1 - p, p)))
        if name[self.predictionCol]:
            out = out.withColumn(name[self.predictionCol], (F.col("_raw")[1] > 0).cast("double"))
        if name[self.rawPredictionCol]:
            out = out.withColumn(name[self.rawPredictionCol], array_to_vector(F.col("_raw")))
        return out.drop("_raw")


class BlockBoosting(GBTClassifier):
    """The estimator with its parameters; only the trees are grown here. A leaf holds one row at least, whatever ``minInstancesPerNode`` says."""

    def _fit(self, dataset: DataFrame) -> BoostedTrees:
        get = self.getOrDefault
        weighted = self.isSet(self.weightCol)
        weight = F.col(get(self.weightCol)).cast("double") if weighted else F.lit(1.0)
        # A column beside the vector: its cells by place.
        rows = dataset.select(vector_to_array(F.col(get(self.featuresCol))).alias("x"), F.col(get(self.labelCol)).cast("double").alias("y"), weight.alias("w"))
        n = len(rows.select("x").first()["x"])
        wide = rows.select(*[F.col("x")[i].alias(f"_f{i}") for i in range(n)])
        limits = _limits(wide, n, get(self.maxBins))
        share, seed, rounds, rate = get(self.subsamplingRate), get(self.seed), get(self.maxIter), get(self.stepSize)
        columns = get(self.featureSubsetStrategy)
        columns = n if columns == "all" else max(1, math.ceil(float(columns) * n))
        others = {"y": F.col("y"), "row": F.monotonically_increasing_id(), **({"w": F.col("w")} if weighted else {})}
        blocks = Blocks.of(rows, F.col("x"), others).updated(lambda b: _binned(b, limits))
        trees: list[Tree] = []
        newest = None
        try:
            for round_ in range(rounds):
                before = blocks
                blocks = before.stepped(lambda b, newest=newest, r=round_: _begun(b, newest, r, share, seed), cut=round_ % SETTLE_EVERY == SETTLE_EVERY - 1)
                # The first tree fits the labels and counts whole, as in MLlib.
                newest = self._tree(blocks, [len(v) for v in limits], columns, 1.0 if round_ == 0 else rate, [seed % (1 << 63), round_])
                before.release()
                trees.append(_in_values(newest, limits))
        finally:
            blocks.release()
        model = BoostedTrees()
        for param in (self.featuresCol, self.predictionCol, self.rawPredictionCol, self.probabilityCol):
            model._set(**{param.name: get(param)})
        model._set(trees=json.dumps([asdict(t) for t in trees]))
        return model

    def _tree(self, blocks: Blocks, sizes: list[int], columns: int, weight: float, seed: list[int]) -> Tree:
        """A tree in bins; its values are means of the targets, times ``weight``."""
        depth, least = self.getOrDefault(self.maxDepth), self.getOrDefault(self.minInfoGain)
        width, tree = max(sizes) + 1, Tree([0], [0], [-1], [-1], [0.0])
        level: list[tuple] = [(0, None, None)]  # node to count, its sibling, their parent's sums
        for at_depth in range(depth):
            counted = [node for node, _, _ in level]
            found = blocks.sums(lambda b: [_sums(b, tree, counted, width)], small=True)[0]
            below: list[tuple] = []
            for table, (node, sibling, parent) in zip(found, level):
                for here, own in ((node, table), *(() if sibling is None else ((sibling, parent - table),))):
                    if here == 0:
                        tree.value[0] = weight * _mean(own[0].sum(axis=0))
                    split = _best(own, sizes, np.random.default_rng([*seed, here]).permutation(len(sizes))[:columns], least)
                    if split is None:
                        continue
                    tree.feature[here], tree.limit[here], *sides = split
                    tree.left[here], tree.right[here] = len(tree.left), len(tree.left) + 1
                    small = int(sides[1][1] < sides[0][1])
                    if at_depth + 1 < depth:
                        below.append((len(tree.left) + small, len(tree.left) + 1 - small, own))
                    for side in sides:
                        for values, new in ((tree.feature, 0), (tree.limit, 0), (tree.left, -1), (tree.right, -1), (tree.value, weight * _mean(side))):
                            values.append(new)
            level = below
            if not level:
                break
        return tree


def _mean(sums: np.ndarray) -> float:
    return float(sums[0] / sums[1]) if sums[1] > 0 else 0.0


def _best(table: np.ndarray, sizes: list[int], allowed: np.ndarray, least: float) -> tuple | None:
    """Feature, bin and the sums on both sides of the split that lessens the targets' variance most; ties go to the first feature and the smallest limit."""
    below = table.cumsum(axis=1)[:, :-1]
    whole = table.sum(axis=1, keepdims=True)
    above = whole - below
    # What subtraction leaves of an empty side is rounding.
    some = 1e-9 * whole[..., 1]
    usable = np.zeros(below.shape[:2], bool)
    for f in allowed:
        usable[f, : sizes[f]] = True
    usable &= (below[..., 1] > some) & (above[..., 1] > some)
    if not usable.any():
        return None
    worth = lambda s: np.divide(s[..., 0] ** 2, s[..., 1], out=np.zeros(s.shape[:-1]), where=s[..., 1] > 0)
    gain = np.where(usable, (worth(below) + worth(above) - worth(whole)) / np.maximum(whole[..., 1], 1e-300), -np.inf)
    if not gain.max() > max(least, 1e-10):
        return None
    f, at = divmod(int(np.argmax(gain >= gain.max() * (1 - 1e-9))), gain.shape[1])
    return int(f), int(at), below[f, at], above[f, at]


def _binned(block: Block, limits: list[list[float]]) -> Block:
    """``bin`` (a line for each feature: the smallest bin whose limit is at least the cell), the label as a sign, and margins of 0."""
    kind = np.uint8 if max(map(len, limits)) < 256 else np.uint16
    bins = np.stack([np.searchsorted(np.asarray(v), block["x"][:, f], "left").astype(kind) for f, v in enumerate(limits)])
    more = {"w": block["w"]} if "w" in block else {}
    return {"bin": bins, "sign": (2 * block["y"] - 1).astype(np.int8), "row": block["row"].astype(np.uint64), "margin": np.zeros(len(block["y"])), **more}


def _begun(block: Block, newest: Tree | None, round_: int, share: float, seed: int) -> Block:
    """The block as a round sees it: margins with the newest tree, the rows drawn and their targets."""
    margin, sign = block["margin"], block["sign"].astype(np.float64)
    whole = np.arange(len(margin))
    if newest is not None:
        margin = margin + np.asarray(newest.value)[ends(newest, block["bin"], whole)]
    own = np.flatnonzero(drawn(block["row"], round_, share, seed)) if share < 1 else whole
    target = sign if newest is None else 4 * sign / (1 + np.exp(np.clip(2 * sign * margin, -700, 700)))
    return {**block, "margin": margin, "own": own.astype(np.min_scalar_type(len(whole))), "target": target[own].astype(np.float32)}


def _sums(block: Block, tree: Tree, counted: list[int], width: int) -> np.ndarray:
    """Sums by counted node, feature and bin of targets and of rows (or their weights)."""
    bins, rows = block["bin"], block["own"].astype(np.int64)
    place = np.full(len(tree.left), -1)
    place[counted] = np.arange(len(counted))
    at = place[ends(tree, bins, rows)]
    here = np.flatnonzero(at >= 0)
    at, rows, target = at[here] * width, rows[here], block["target"][here].astype(np.float64)
    weight = block["w"][rows] if "w" in block else None
    out = np.zeros((len(counted), len(bins), width, 2))
    for f in range(len(bins)):
        cell = at + bins[f].take(rows)
        for j, values in enumerate((target if weight is None else weight * target, weight)):
            out[:, f, :, j] = np.bincount(cell, values, len(counted) * width).reshape(len(counted), width)
    return out
