"""Combining detectors by a vote weighted with their training accuracy."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def vote_weights(train: DataFrame, truth: str, detectors: Sequence[str]) -> dict[str, float]:
    """Training accuracy of each 0/1 prediction column, in one pass."""
    row = train.agg(*[F.avg((F.col(d) == F.col(truth)).cast("double")).alias(d) for d in detectors]).first()
    return {d: row[d] or 0.0 for d in detectors}


def weighted_vote(df: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """Adds the class with the larger sum of weights; a tie is benign."""
    yes = sum((F.when(F.col(d) == 1, F.lit(w)).otherwise(F.lit(0.0)) for d, w in weights.items()), F.lit(0.0))
    no = sum((F.when(F.col(d) == 0, F.lit(w)).otherwise(F.lit(0.0)) for d, w in weights.items()), F.lit(0.0))
    return df.withColumn("prediction", (yes > no).cast("int"))
