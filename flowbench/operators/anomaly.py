"""Detectors that do not learn from labels: clusters with majority labels, and reconstruction energy."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import PCA
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowbench.functions.names import require_columns
from flowbench.functions.values import finite_or
from flowbench.operators.clusters import cluster_labels, default_label
from flowbench.operators.encode import standard_stats, standardise
from flowbench.operators.energy import EnergyRule
from flowbench.operators.learners import VECTOR, assemble
from flowbench.session import settle, spread


@dataclass
class FittedClusters:
    features: list[str]
    stats: dict[str, tuple[float, float]]
    model: KMeansModel
    mapping: DataFrame
    default: int

    def score(self, df: DataFrame) -> DataFrame:
        placed = self.model.transform(assemble(df, self.features, self.stats)).drop(VECTOR)
        names = self.mapping.select(F.col("cluster").alias("_cluster"), F.col("label").alias("_label"))
        joined = placed.join(names, "_cluster", "left")
        return joined.withColumn("prediction", F.coalesce("_label", F.lit(self.default)).cast("int")).drop("_cluster", "_label")


@dataclass
class ClusterDetector:
    """k-means with as many clusters as asked for, but not more than rows or classes; each cluster predicts its
    majority label."""

    clusters: int = 2
    iterations: int = 300
    starts: int = 10
    seed: int = 42
    name: str = "clusters"

    def fit(self, train: DataFrame, features: Sequence[str], label: str) -> FittedClusters:
        features = require_columns(train, features, numeric=True)
        sizes = train.groupBy(F.col(label).cast("int").alias("label")).agg(F.count("*").alias("n")).agg(
            F.sum("n").alias("rows"), F.count("*").alias("classes")
        ).first()
        k = max(1, min(self.clusters, sizes["rows"] or 0, sizes["classes"]))
        stats = standard_stats(train.select(*[finite_or(c).alias(c) for c in features]), features)
        # Read from files, each start of MLlib's k-means keeps the rows unpacked by itself; of a cached table it would unpack them in each pass.
        rows = spread(assemble(train, features, stats).select(VECTOR, F.col(label).cast("int").alias("label")), "clusters")
        if k == 1:
            # One cluster is its own centre; MLlib wants at least two.
            return _OneCluster(list(features), default_label(rows, "label"))
        fitted = [
            KMeans(k=k, maxIter=self.iterations, seed=self.seed + i, featuresCol=VECTOR, predictionCol="_cluster").fit(rows)
            for i in range(max(1, self.starts))
        ]
        model = min(fitted, key=lambda m: m.summary.trainingCost)
        mapping = settle(cluster_labels(model.transform(rows), "_cluster", "label").select("cluster", "label"))
        return FittedClusters(list(features), stats, model, mapping, default_label(rows, "label"))


@dataclass
class _OneCluster:
    features: list[str]
    label: int

    def score(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", F.lit(self.label).cast("int"))


@dataclass
class FittedEnergy:
    features: list[str]
    stats: dict[str, tuple[float, float]]
    centre: list[float]
    components: list[list[float]]
    rule: EnergyRule
    normal_label: int
    attack_label: int

    def energy(self, df: DataFrame, out: str = "energy") -> DataFrame:
        return _with_energy(df, self.features, self.stats, self.centre, self.components, out)

    def score(self, df: DataFrame) -> DataFrame:
        """Energy, prediction and the probability of the attack label."""
        scored = self.rule.score(self.energy(df), "energy")
        flagged = F.when(F.col("prediction") == 1, F.lit(self.attack_label)).otherwise(F.lit(self.normal_label))
        return scored.withColumn("prediction", flagged.cast("int"))


def _with_energy(df, features, stats, centre, components, out) -> DataFrame:
    """Mean squared gap between a scaled row and its projection on the components, as one column expression."""
    clean = {f"_s{i}": finite_or(c) for i, c in enumerate(features)}
    scaled = standardise(df.withColumns(clean), {f"_s{i}": stats[c] for i, c in enumerate(features)})
    gaps = [F.col(s) - F.lit(m) for s, m in zip(clean, centre)]
    codes = {
        f"_z{j}": sum((g * F.lit(w) for g, w in zip(gaps[1:], comp[1:])), gaps[0] * F.lit(comp[0]))
        for j, comp in enumerate(components)
    }
    coded = scaled.withColumns(codes)
    total: Column = F.lit(0.0)
    for i, g in enumerate(gaps):
        rest = g
        for j, comp in enumerate(components):
            rest = rest - F.col(f"_z{j}") * F.lit(comp[i])
        total = total + rest * rest
    return coded.withColumn(out, total / F.lit(float(len(features)))).drop(*clean, *codes)


@dataclass
class EnergyDetector:
    """Linear encoder and decoder fitted on normal rows; energies above their 95th percentile are attacks.

    With fewer than two normal rows all rows count as normal.
    """

    encoding: int = 32
    percentile: float = 0.95
    name: str = "reconstruction_energy"

    def fit(
        self, train: DataFrame, features: Sequence[str], label: str, normal_label: int = 0, attack_label: int = 1
    ) -> FittedEnergy:
        features = require_columns(train, features, numeric=True)
        stats = standard_stats(train.select(*[finite_or(c).alias(c) for c in features]), features)
        normal = train.where(F.col(label) == normal_label)
        if len(normal.take(2)) < 2:
            normal = train
        rows = assemble(normal, features, stats).select(VECTOR).persist()
        try:
            k = max(1, min(self.encoding, len(features) - 1))
            loadings = PCA(k=k, inputCol=VECTOR, outputCol="_z").fit(rows).pc.toArray()
        finally:
            rows.unpersist()
        components = [loadings[:, j].tolist() for j in range(k)]
        scaled = standardise(
            normal.select(*[finite_or(c).alias(c) for c in features]), {c: stats[c] for c in features}
        )
        row = scaled.agg(*[F.avg(c).alias(c) for c in features]).first()
        centre = [row[c] for c in features]
        energies = _with_energy(normal, features, stats, centre, components, "energy")
        rule = EnergyRule.fit(energies.select("energy"), "energy", self.percentile)
        return FittedEnergy(list(features), stats, centre, components, rule, normal_label, attack_label)
