"""Reading flow tables. Every read is an ordinary partitioned scan; nothing passes through the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from flowbench.functions.names import ColumnError, find_label, normalise_name
from flowbench.specs import DatasetSpec

SUFFIXES = {".csv": "csv", ".txt": "csv", ".parquet": "parquet", ".pq": "parquet"}


class SourceError(ValueError):
    """A table cannot be read as asked."""


def read_table(
    spark: SparkSession, path: str, format: str = "parquet", schema: T.StructType | str | None = None
) -> DataFrame:
    """A CSV (with header) or Parquet table. CSV without a schema takes one extra pass to infer it."""
    reader = spark.read
    kind = (format or "").lower()
    if kind == "csv":
        reader = reader.option("header", True)
        reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
        return reader.csv(path)
    if kind == "parquet":
        return (reader.schema(schema) if schema is not None else reader).parquet(path)
    raise SourceError(f"unsupported table format: {format!r}")


def read_by_suffix(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """The same, with the format taken from ``.csv``, ``.txt``, ``.parquet`` or ``.pq``."""
    lowered = path.lower().rstrip("/")
    for suffix, kind in SUFFIXES.items():
        if lowered.endswith(suffix):
            return read_table(spark, path, kind, schema)
    raise SourceError(f"unsupported table file: {path}")


def first_rows(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The first ``n`` rows under a stated order; without one, "first" means nothing in a distributed table."""
    if not order:
        raise SourceError("first_rows needs columns to order by")
    return df.orderBy(*order).limit(n)


def load_dataset(spark: SparkSession, spec: DatasetSpec) -> dict[str, DataFrame | str]:
    """``{label, full}`` for one table, or ``{label, train, test}`` for a pair whose label names agree."""
    if spec.path:
        df = read_table(spark, spec.path, spec.format)
        return {"label": find_label(df.columns, spec.label), "full": df}
    if spec.train_path and spec.test_path:
        train = read_table(spark, spec.train_path, spec.format)
        test = read_table(spark, spec.test_path, spec.format)
        names = [find_label(t.columns, spec.label) for t in (train, test)]
        if normalise_name(names[0], "lab") != normalise_name(names[1], "lab"):
            raise ColumnError(f"label columns differ: {names[0]} in train, {names[1]} in test")
        return {"label": names[0], "train": train, "test": test.withColumnRenamed(names[1], names[0])}
    raise SourceError(f"data set {spec.dataset_id!r} needs a path, or a train and a test path")
