"""From a raw flow table to train and test rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowbench.functions.names import find_label, normalise_columns, normalise_name, require_columns
from flowbench.functions.values import complete_rows, strict_label
from flowbench.operators.select import final_projection, merged_drops, resolve_features
from flowbench.operators.splits import membership, split_parts
from flowbench.sources.sinks import path_exists, under_root
from flowbench.specs import DatasetSpec, FeatureSet, SplitSpec


@dataclass
class PreparedSplit:
    """Rows with their part, and what was decided on the way."""

    rows: DataFrame
    features: list[str]
    label: str
    dropped_columns: list[str]
    split_columns: list[str]
    row_key: tuple[str, ...]
    source: DataFrame
    dataset: DatasetSpec
    feature_set: FeatureSet
    split: SplitSpec

    def part(self, name: str) -> DataFrame:
        return self.rows.where(F.col("part") == name).drop("part")

    @property
    def train(self) -> DataFrame:
        return self.part("train")

    @property
    def test(self) -> DataFrame:
        return self.part("test")

    def metadata(self, rows: DataFrame | None = None) -> DataFrame:
        """One row: ids, columns, and rows and labels per part, counted in ``rows`` if the split has been written."""
        n = F.count("*")
        counts = (self.rows if rows is None else rows).groupBy("part", F.col(self.label).cast("string").alias("label")).agg(n.alias("n"))

        def distribution(part: str):
            entries = F.collect_list(F.when(F.col("part") == part, F.struct("label", "n")))  # one entry per label
            return F.map_from_entries(F.array_sort(entries))

        def rows_of(part: str):
            return F.coalesce(F.sum(F.when(F.col("part") == part, F.col("n"))), F.lit(0))

        summary = counts.agg(
            rows_of("train").alias("train_rows"),
            rows_of("test").alias("test_rows"),
            distribution("train").alias("train_label_distribution"),
            distribution("test").alias("test_label_distribution"),
        )
        source_rows = self.source.count()
        prepared = F.col("train_rows") + F.col("test_rows")
        return summary.select(
            F.lit(self.split.split_id).alias("split_id"),
            F.lit(self.dataset.dataset_id).alias("dataset_id"),
            F.lit(self.feature_set.feature_set_id).alias("feature_set_id"),
            F.lit(self.label).alias("label_column"),
            F.struct(
                F.lit(self.split.method).alias("type"),
                F.lit(self.split.fraction).alias("fraction"),
                F.lit(self.split.seed).alias("seed"),
            ).alias("split_method"),
            F.array(*map(F.lit, self.features)).alias("feature_columns"),
            F.array(*map(F.lit, self.split_columns)).cast("array<string>").alias("split_columns"),
            F.array(*map(F.lit, self.dropped_columns)).cast("array<string>").alias("dropped_columns"),
            F.lit(source_rows).cast("bigint").alias("source_rows"),
            prepared.alias("prepared_rows"),
            (F.lit(source_rows) - prepared).alias("dropped_rows"),
            "train_rows",
            "test_rows",
            "train_label_distribution",
            "test_label_distribution",
        )


def prepare_split(
    df: DataFrame, dataset: DatasetSpec, feature_set: FeatureSet, split: SplitSpec, keep_key: bool = False
) -> PreparedSplit:
    """Rename, label, project, clean and cut a raw table.

    Only features and label must be present in a row; a missing group value removes nothing. Group columns
    serve the cut and are dropped after it. ``keep_key`` leaves the row key in the result.
    """
    named = normalise_columns(df)
    label = normalise_name(find_label(named.columns, normalise_name(dataset.label) if dataset.label else None))
    group = normalise_name(split.group) if split.group else None
    if group == "original_label":
        named = named.withColumn("original_label", F.col(label))
    labelled = named.withColumn(label, strict_label(label))

    drops = merged_drops(dataset, split)
    key = require_columns(labelled, [normalise_name(k) for k in split.row_key])
    features = [c for c in resolve_features(labelled, feature_set, [*drops, *key], label)]
    groups = require_columns(labelled, [group]) if group else []

    projected = final_projection(labelled, features, label, [*key, *groups])
    clean = complete_rows(projected, features, label)
    placed = SplitSpec(**{**split.__dict__, "row_key": tuple(key), "group": group})
    rows = split_parts(clean, label, placed)
    leave = [c for c in [*groups, *([] if keep_key else key)] if c not in features and c != label]
    return PreparedSplit(
        rows.drop(*leave), features, label, drops, groups, tuple(key), df, dataset, feature_set, placed
    )


def saved_membership(
    df: DataFrame, label: str, split: SplitSpec, folder: str
) -> tuple[DataFrame, bool]:
    """The split's assignment table from ``folder``, and whether it had to be made.

    An existing one is used as it is, whatever the split's settings say now.
    """
    spark = df.sparkSession
    path = under_root(folder, split.split_id)
    created = not path_exists(spark, path)
    if created:
        parts = split_parts(df, label, split)
        membership(parts, split.row_key, split.split_id).write.parquet(path)
    return spark.read.parquet(path), created
