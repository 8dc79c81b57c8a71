"""Choosing columns: feature sets, drop lists and final projections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowbench.functions.names import normalise_name, numeric_columns, require_columns
from flowbench.functions.values import finite_or
from flowbench.specs import ALL_NUMERIC, DatasetSpec, FeatureSet, SplitSpec


def merged_drops(dataset: DatasetSpec, split: SplitSpec) -> list[str]:
    """Normalised drop list: the data set's columns first if the split wants them, then the split's own."""
    names = [*(dataset.drop if split.use_dataset_drop else ()), *split.drop]
    return list(dict.fromkeys(normalise_name(c) for c in names))


def resolve_features(df: DataFrame, features: FeatureSet, drop: Sequence[str], label: str) -> list[str]:
    """Ordered feature names of a table. ``all numeric`` leaves out booleans, dropped columns and the label."""
    if isinstance(features.features, str):
        if features.features != ALL_NUMERIC:
            raise ValueError(f"unknown feature definition: {features.features}")
        blocked = {*drop, label}
        return [c for c in numeric_columns(df) if c not in blocked]
    return require_columns(df, [normalise_name(c) for c in features.features])


def final_projection(df: DataFrame, features: Sequence[str], label: str, extra: Sequence[str] = ()) -> DataFrame:
    """Features, then extra columns, then the label; a name wanted twice appears once, at its first place."""
    return df.select(*dict.fromkeys([*features, *extra, label]))


def features_and_label(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Scoring input: ordered features with non-finite cells as 0, and an integer label."""
    require_columns(df, [*features, label])
    return df.select(*[finite_or(c).alias(c) for c in features], F.col(label).cast("int").alias(label))
