"""Detectors on MLlib estimators under the one contract: ``fit(train, features, label)`` and ``score(df)``.

Features are scaled with population statistics of the training rows; missing cells become 0 before it.
Class weights, where asked for, are rows / (classes * rows of the class). Labels are integer codes from 0.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    LinearSVC,
    LogisticRegression,
    OneVsRest,
)
from pyspark.ml.feature import PCA, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowbench.functions.names import require_columns
from flowbench.functions.values import finite_or
from flowbench.operators.blockforest import BlockForest
from flowbench.operators.encode import anova_f, best_features, standard_stats, standardise, with_balanced_weights
from flowbench.operators.levelboost import BlockBoosting
from flowbench.operators.perceptron import BlockPerceptron
from flowbench.session import few_rows

VECTOR, TARGET, WEIGHT = "_x", "_y", "_w"
DEEPEST = 30  # MLlib's limit; stands for "no limit"


def assemble(df: DataFrame, features: Sequence[str], stats: dict[str, tuple[float, float]] | None) -> DataFrame:
    """The input plus one vector of scaled (or just finite) features in the given order."""
    require_columns(df, features, numeric=True)
    cells = {f"_f{i}": finite_or(c) for i, c in enumerate(features)}
    wide = df.withColumns(cells)
    if stats is not None:
        wide = standardise(wide, {f"_f{i}": stats[c] for i, c in enumerate(features)})
    out = VectorAssembler(inputCols=list(cells), outputCol=VECTOR).transform(wide)
    return out.drop(*cells)


def with_scores(df: DataFrame, classes: int) -> DataFrame:
    """``prediction`` as integer and, from the model's probability or else its raw margin, a score.

    Two classes: ``probability`` of class 1, or ``margin`` of a model without probabilities. More: the array ``probabilities`` or
    ``margins``. Neither, if the model has none.
    """
    out = df
    source = next((c for c in ("probability", "rawPrediction") if c in df.columns), None)
    if source is not None:
        values = vector_to_array(F.col(source))
        if classes == 2:
            out = out.withColumn("_score", F.element_at(values, -1))
        else:
            out = out.withColumn("_score", values)
    out = out.withColumn("prediction", F.col("prediction").cast("int"))
    out = out.drop("probability", "rawPrediction", VECTOR, "_encoded")
    if source is not None:
        one, many = ("probability", "probabilities") if source == "probability" else ("margin", "margins")
        out = out.withColumnRenamed("_score", one if classes == 2 else many)
    return out


@dataclass
class FittedLearner:
    """A fitted MLlib model with the feature order and statistics it needs."""

    kind: str
    features: list[str]
    stats: dict[str, tuple[float, float]] | None
    classes: int
    model: Transformer
    facts: dict = field(default_factory=dict)

    def score(self, df: DataFrame) -> DataFrame:
        return with_scores(self.model.transform(assemble(df, self.features, self.stats)), self.classes)

    def save(self, spark: SparkSession, path: str) -> None:
        """Model and a one-row description; an existing path is an error."""
        pipeline = self.model if isinstance(self.model, PipelineModel) else PipelineModel([self.model])
        pipeline.write().save(f"{path}/model")
        about = {
            "kind": self.kind, "features": self.features, "stats": self.stats, "classes": self.classes, "facts": self.facts,
        }
        spark.createDataFrame([(json.dumps(about),)], "about string").coalesce(1).write.json(f"{path}/about")

    @staticmethod
    def load(spark: SparkSession, path: str, kind: str | None = None) -> "FittedLearner":
        """A saved detector; another kind than the expected one is an error."""
        about = json.loads(spark.read.schema("about string").json(f"{path}/about").first()[0])
        if kind is not None and about["kind"] != kind:
            raise ValueError(f"the artefact holds {about['kind']!r}, not {kind!r}")
        stats = about["stats"]
        stats = None if stats is None else {c: tuple(v) for c, v in stats.items()}
        return FittedLearner(
            about["kind"], about["features"], stats, about["classes"], PipelineModel.load(f"{path}/model"), about["facts"]
        )


@dataclass
class Learner:
    """An estimator factory with the preparation it wants.

    ``make(n_features, n_classes)`` gives an estimator on the vector, target and, if weighted, weight columns.
    """

    name: str
    make: Callable[[int, int], Estimator]
    scale: bool = True
    balanced: bool = False
    anova_k: int | None = None
    rfe_features: int | None = None
    rfe_tree: dict = field(default_factory=dict)
    seed: int = 42

    def fit(self, train: DataFrame, features: Sequence[str], label: str) -> FittedLearner:
        features = require_columns(train, features, numeric=True)
        counts = {
            int(r["y"]): r["n"]
            for r in few_rows(train.groupBy(F.col(label).cast("int").alias("y")).agg(F.count("*").alias("n")), "classes")
        }
        if not counts:
            raise ValueError("the training table is empty")
        classes = max(2, max(counts) + 1)
        if self.anova_k is not None:
            k = max(1, min(self.anova_k, len(features)))
            chosen = {r["feature"] for r in best_features(anova_f(train, features, label), k).collect()}
            features = [c for c in features if c in chosen]
        stats = standard_stats(train.select(*[finite_or(c).alias(c) for c in features]), features) if self.scale else None
        rows = assemble(train, features, stats).withColumn(TARGET, F.col(label).cast("double"))
        if self.balanced:
            rows = with_balanced_weights(rows, TARGET, WEIGHT)
        rows = rows.select(VECTOR, TARGET, *([WEIGHT] if self.balanced else [])).persist()
        try:
            if self.rfe_features is not None and self.rfe_features < len(features):
                kept = eliminate_features(rows, len(features), max(1, self.rfe_features), self.balanced, self.seed, **self.rfe_tree)
                features = [features[i] for i in kept]
                stats = None if stats is None else {c: stats[c] for c in features}
                rows_kept = VectorSlicer(inputCol=VECTOR, outputCol="_kept", indices=kept).transform(rows)
                rows_fit = rows_kept.drop(VECTOR).withColumnRenamed("_kept", VECTOR)
            else:
                rows_fit = rows
            model = self.make(len(features), classes).fit(rows_fit)
        finally:
            rows.unpersist()
        facts = {"training_rows": sum(counts.values()), "label_counts": {str(k): v for k, v in sorted(counts.items())}}
        return FittedLearner(self.name, list(features), stats, classes, model, facts)


def eliminate_features(rows: DataFrame, n: int, wanted: int, weighted: bool, seed: int = 42, **tree) -> list[int]:
    """Positions of the features left after dropping the least important one, tree by tree; ``tree`` has the trees' settings."""
    kept = list(range(n))
    while len(kept) > wanted:
        sliced = VectorSlicer(inputCol=VECTOR, outputCol="_kept", indices=kept).transform(rows)
        one = _tree(DecisionTreeClassifier, weighted, seed=seed, **{"maxDepth": DEEPEST, **tree}).setFeaturesCol("_kept")
        weights = one.fit(sliced).featureImportances.toArray()
        kept.pop(min(range(len(kept)), key=lambda i: (weights[i], -i)))
    return kept


def _tree(cls, weighted: bool, **options):
    est = cls(featuresCol=VECTOR, labelCol=TARGET, **options)
    return est.setWeightCol(WEIGHT) if weighted else est


def boosted_trees(
    rounds: int = 200, depth: int = 6, rate: float = 0.1, rows: float = 0.8, columns: float = 0.8,
    balanced: bool = False, seed: int = 42,
) -> Learner:
    """Gradient-boosted trees; more than two classes become one model per class.

    There is no penalty on leaf weights and no leaf-wise growth, as in MLlib: depth limits the trees.
    """

    def make(n: int, k: int) -> Estimator:
        est = _tree(
            BlockBoosting, balanced, maxIter=rounds, maxDepth=depth, stepSize=rate, subsamplingRate=rows,
            featureSubsetStrategy=str(columns) if columns < 1 else "all", seed=seed,
        )
        if k == 2:
            return est
        options = {"weightCol": WEIGHT} if balanced else {}
        return OneVsRest(classifier=est, featuresCol=VECTOR, labelCol=TARGET, **options)

    return Learner("boosted_trees", make, scale=False, balanced=balanced, seed=seed)


def random_forest(
    trees: int = 200, depth: int | None = None, columns: str = "sqrt", balanced: bool = True, leaf: int = 1, seed: int = 42
) -> Learner:
    def make(n: int, k: int) -> Estimator:
        return _tree(
            BlockForest, balanced, numTrees=trees, maxDepth=DEEPEST if depth is None else min(depth, DEEPEST),
            featureSubsetStrategy=columns, minInstancesPerNode=leaf, seed=seed,
        )

    return Learner("random_forest", make, scale=False, balanced=balanced, seed=seed)


def decision_tree(
    depth: int | None = None, impurity: str = "gini", anova_k: int | None = 20, rfe_features: int | None = 10,
    balanced: bool = True, leaf: int = 1, seed: int = 42,
) -> Learner:
    """A tree on features chosen by ANOVA and then by elimination; pass None to skip a choice."""

    settings = {"maxDepth": DEEPEST if depth is None else min(depth, DEEPEST), "impurity": impurity, "minInstancesPerNode": leaf}

    def make(n: int, k: int) -> Estimator:
        return _tree(DecisionTreeClassifier, balanced, seed=seed, **settings)

    return Learner("decision_tree", make, balanced=balanced, anova_k=anova_k, rfe_features=rfe_features, rfe_tree=settings, seed=seed)


def _softmax(vector: str, balanced: bool, iterations: int) -> LogisticRegression:
    est = LogisticRegression(
        featuresCol=vector, labelCol=TARGET, family="multinomial", maxIter=iterations, standardization=False
    )
    return est.setWeightCol(WEIGHT) if balanced else est


def softmax(iterations: int = 1000, balanced: bool = True) -> Learner:
    return Learner("softmax", lambda n, k: _softmax(VECTOR, balanced, iterations), balanced=balanced)


def _network(vector: str, n: int, hidden: Sequence[int], k: int, iterations: int, seed: int):
    return BlockPerceptron(
        featuresCol=vector, labelCol=TARGET, layers=[n, *hidden, k], maxIter=iterations, blockSize=256, seed=seed
    )


def network(hidden: Sequence[int] = (64, 32), iterations: int = 100, seed: int = 42) -> Learner:
    """Feed-forward net: sigmoid layers and L-BFGS, no dropout."""
    return Learner("network", lambda n, k: _network(VECTOR, n, hidden, k, iterations, seed), seed=seed)


def encoded_softmax(encoding: int = 32, iterations: int = 1000, balanced: bool = True) -> Learner:
    """A linear encoder learned without labels, then softmax regression on the codes."""

    def make(n: int, k: int) -> Estimator:
        size = max(1, min(encoding, n))
        return Pipeline(
            stages=[PCA(k=size, inputCol=VECTOR, outputCol="_encoded"), _softmax("_encoded", balanced, iterations)]
        )

    return Learner("encoded_softmax", make, balanced=balanced)


def encoded_network(encoding: int = 32, hidden: Sequence[int] = (64,), iterations: int = 100, seed: int = 42) -> Learner:
    """A linear encoder, kept fixed, then a feed-forward net on the codes."""

    def make(n: int, k: int) -> Estimator:
        size = max(1, min(encoding, n))
        return Pipeline(
            stages=[PCA(k=size, inputCol=VECTOR, outputCol="_encoded"), _network("_encoded", size, hidden, k, iterations, seed)]
        )

    return Learner("encoded_network", make, seed=seed)


def linear_svm(c: float = 1.0, iterations: int = 100, balanced: bool = True) -> Learner:
    """Linear support-vector classifier; ``c`` is the inverse of the penalty. More than two classes become one model per class."""

    def make(n: int, k: int) -> Estimator:
        est = LinearSVC(featuresCol=VECTOR, labelCol=TARGET, maxIter=iterations, regParam=_penalty(c), standardization=False)
        if balanced:
            est = est.setWeightCol(WEIGHT)
        if k == 2:
            return est
        options = {"weightCol": WEIGHT} if balanced else {}
        return OneVsRest(classifier=est, featuresCol=VECTOR, labelCol=TARGET, **options)

    return Learner("linear_svm", make, balanced=balanced)


def _penalty(c: float) -> float:
    # The hinge loss is averaged over rows here but summed in the usual form, so only the order of C carries over.
    return 1e-4 / c

