"""The detector contract and the majority-class baseline.

A detector has ``fit(train, features, label)`` and gives back a fitted one with ``score(df)``, which adds
``prediction`` and, where the method has one, ``probability`` of the positive class.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowbench.session import few_rows


class FittedDetector(Protocol):
    features: list[str]

    def score(self, df: DataFrame) -> DataFrame: ...


class Detector(Protocol):
    name: str

    def fit(self, train: DataFrame, features: Sequence[str], label: str) -> FittedDetector: ...


@dataclass
class FittedMajority:
    features: list[str]
    majority: int
    counts: dict[int, int]

    def score(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", F.lit(self.majority))


@dataclass
class MajorityBaseline:
    """Predicts the most common training class; a tie goes to the smaller label."""

    name: str = "majority"

    def fit(self, train: DataFrame, features: Sequence[str], label: str) -> FittedMajority:
        tallies = train.groupBy(F.col(label).cast("int").alias("y")).agg(F.count("*").alias("n"))
        counts = {r["y"]: r["n"] for r in few_rows(tallies, "classes")}
        if not counts:
            raise ValueError("the training table is empty")
        best = min(counts, key=lambda y: (-counts[y], y))
        return FittedMajority(list(features), best, counts)
