"""Anomaly flags from reconstruction energies."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowbench.functions.values import sigmoid
from flowbench.operators.order import exact_quantiles


@dataclass(frozen=True)
class EnergyRule:
    """Flags energies strictly above a percentile of the energies of normal training rows."""

    threshold: float

    @staticmethod
    def fit(normal: DataFrame, energy: str, percentile: float = 0.95) -> "EnergyRule":
        value = exact_quantiles(normal, {energy: [percentile]})[energy][0]
        if value is None:
            raise ValueError("no energies to take a threshold from")
        return EnergyRule(value)

    def score(self, df: DataFrame, energy: str) -> DataFrame:
        """Adds ``prediction`` and a ``probability``: a sigmoid around the threshold, scaled by the spread of
        the scored rows."""
        spread = (df.agg(F.stddev_pop(energy)).first()[0] or 0.0) + 1e-8
        e = F.col(energy)
        return df.withColumns(
            {
                "prediction": (e > F.lit(self.threshold)).cast("int"),
                "probability": sigmoid((e - F.lit(self.threshold)) / F.lit(spread)),
            }
        )


def energy_summary(df: DataFrame, part: str, energy: str) -> DataFrame:
    """Mean, population deviation and number of energies per part."""
    return df.groupBy(part).agg(
        F.avg(energy).alias("mean"), F.stddev_pop(energy).alias("std"), F.count(energy).alias("n")
    )
