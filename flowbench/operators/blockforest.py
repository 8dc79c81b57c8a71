"""MLlib's random forest, grown by sums over blocks of rows and finished by node.

Parameters and columns are those of ``RandomForestClassifier``: trees on Poisson samples, the best of a few features drawn at each node, a bound of depth.
The trees are those of ``deeptrees``, which splits large nodes between quantiles and small ones between any two values.
"""

from __future__ import annotations

import math

from pyspark.ml import Model
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param.shared import HasFeaturesCol, HasPredictionCol, HasProbabilityCol, HasRawPredictionCol
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowbench.operators.deeptrees import DeepForest, FittedForest
from flowbench.session import few_rows


class ForestModel(Model, HasFeaturesCol, HasPredictionCol, HasRawPredictionCol, HasProbabilityCol, MLWritable, MLReadable):
    """The fitted trees: probabilities are means of their shares by class, the raw prediction is the sum."""

    def __init__(self, forest: FittedForest | None = None):
        super().__init__()
        self._setDefault(featuresCol="features", predictionCol="prediction", rawPredictionCol="rawPrediction", probabilityCol="probability")
        self.forest = forest

    def _transform(self, dataset: DataFrame) -> DataFrame:
        forest = self.forest
        name = {p: self.getOrDefault(p) for p in (self.featuresCol, self.predictionCol, self.rawPredictionCol, self.probabilityCol)}
        out = forest.shared(dataset, vector_to_array(F.col(name[self.featuresCol])))
        place = {c: i for i, c in enumerate(forest.classes)}
        # A place for each label from 0, as in MLlib, also for those that the training rows lack.
        shares = F.array(*[F.col("probabilities")[place[c]] if c in place else F.lit(0.0) for c in range(max(2, max(place) + 1))])
        out = out.withColumn("_shares", shares).drop("probabilities")
        if name[self.probabilityCol]:
            out = out.withColumn(name[self.probabilityCol], array_to_vector(F.col("_shares")))
        if name[self.predictionCol]:
            out = out.withColumn(name[self.predictionCol], (F.array_position("_shares", F.array_max("_shares")) - 1).cast("double"))
        if name[self.rawPredictionCol]:
            out = out.withColumn(name[self.rawPredictionCol], array_to_vector(F.transform("_shares", lambda v: v * len(forest.tops))))
        return out.drop("_shares")

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, model: ForestModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        from flowbench.sources.detectors import save_detector

        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        save_detector(self.sparkSession, self.model.forest, "forest", f"{path}/forest")


class _Reader(MLReader):
    def load(self, path: str) -> ForestModel:
        from flowbench.sources.detectors import load_detector

        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = ForestModel(load_detector(self.sparkSession, f"{path}/forest", "forest"))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


class BlockForest(RandomForestClassifier):
    """The estimator with its parameters; only the trees are grown here.

    What the block trees lack (another impurity, weights that differ within a class, samples of part of the rows or without repetition) is left to MLlib.
    """

    def _fit(self, dataset: DataFrame):
        get = self.getOrDefault
        y = F.col(get(self.labelCol)).cast("int")
        weight = F.col(get(self.weightCol)).cast("double") if self.isSet(self.weightCol) else F.lit(1.0)
        found = few_rows(dataset.groupBy(y.alias("y")).agg(F.min(weight).alias("w"), F.max(weight).alias("most")), "classes")
        sampled = get(self.subsamplingRate) == 1.0 and get(self.bootstrap) == (get(self.numTrees) > 1)
        usual = get(self.impurity) == "gini" and sampled and get(self.minWeightFractionPerNode) == 0.0 and get(self.minInfoGain) == 0.0
        if not found or not usual or any(r["w"] != r["most"] or not r["w"] > 0 for r in found):
            return super()._fit(dataset)
        cells = vector_to_array(F.col(get(self.featuresCol)))
        n = len(dataset.select(cells.alias("x")).first()["x"])
        settings = DeepForest(get(self.numTrees), leaf=get(self.minInstancesPerNode), depth=get(self.maxDepth), seed=get(self.seed) % (1 << 63), name="forest")
        rows = dataset.select(cells.alias("x"), y.alias("y"), F.monotonically_increasing_id().alias("row"))
        forest = settings.grown(rows, [f"_f{i}" for i in range(n)], _columns(get(self.featureSubsetStrategy), n, settings.trees), {r["y"]: r["w"] for r in found})
        model = ForestModel(forest)
        for param in (self.featuresCol, self.predictionCol, self.rawPredictionCol, self.probabilityCol):
            model._set(**{param.name: get(param)})
        return model


def _columns(strategy: str, n: int, trees: int) -> int:
    """Features drawn at a node, by MLlib's names of strategies."""
    if strategy == "auto":
        strategy = "sqrt" if trees > 1 else "all"
    named = {"all": n, "sqrt": math.ceil(math.sqrt(n)), "log2": math.ceil(math.log2(n)), "onethird": math.ceil(n / 3)}
    if strategy in named:
        return max(1, named[strategy])
    # A whole number of features or a share of them.
    return min(n, int(strategy)) if strategy.isdigit() else max(1, min(n, math.ceil(float(strategy) * n)))
