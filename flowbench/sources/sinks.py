"""Writing prepared splits, metric records, matrices and the run index."""

from __future__ import annotations

import posixpath
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class SinkError(ValueError):
    """An output path is not allowed or is taken."""


def _fs_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on whatever file system it names."""
    system, target = _fs_path(spark, path)
    return system.exists(target)


def under_root(root: str, name: str) -> str:
    """``root/name``, refused if it would leave the root."""
    base = posixpath.normpath(root)
    full = posixpath.normpath(posixpath.join(base, name))
    if full == base or not full.startswith(base.rstrip("/") + "/"):
        raise SinkError(f"{name!r} does not lie under {root!r}")
    return full


def write_prepared(
    parts: DataFrame, metadata: DataFrame | Callable[[DataFrame], DataFrame] | None, root: str, split_id: str, overwrite: bool = False
) -> str:
    """Train and test rows in one write, one folder per part, next to a one-row JSON description.

    A description given as a function is made from the written rows, so the split is not computed again for it.

    Returns the split's folder. An existing split is refused unless ``overwrite`` is set.
    """
    spark = parts.sparkSession
    folder = under_root(root, split_id)
    if not overwrite and path_exists(spark, folder):
        raise SinkError(f"the prepared split already exists: {folder}")
    mode = "overwrite" if overwrite else "errorifexists"
    parts.write.mode(mode).partitionBy("part").parquet(f"{folder}/rows")
    if callable(metadata):
        metadata = metadata(spark.read.schema(parts.schema).parquet(f"{folder}/rows"))
    if metadata is not None:
        metadata.coalesce(1).write.mode(mode).json(f"{folder}/metadata")
    return folder


def read_prepared(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(train, test) rows of a prepared split; the part folder is pruned before any file is opened."""
    rows = spark.read.parquet(f"{folder}/rows")
    return tuple(rows.where(F.col("part") == p).drop("part") for p in ("train", "test"))


def json_text(df: DataFrame, out: str = "record") -> DataFrame:
    """Each row as one JSON text, nested values included, absent values left out."""
    return df.select(F.to_json(F.struct(*df.columns)).alias(out))


def _flat_cell(name: str, kind: T.DataType) -> Column:
    cell = F.col(f"`{name}`")
    if isinstance(kind, T.StructType):
        return F.to_json(cell)
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return F.to_json(cell)
    return cell


def csv_ready(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, the rest unchanged."""
    return df.select(*[_flat_cell(f.name, f.dataType).alias(f.name) for f in df.schema.fields])


def write_final(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """A result table as CSV with nested values as JSON text, and as JSON."""
    mode = "overwrite" if overwrite else "errorifexists"
    csv_ready(df).write.mode(mode).option("header", True).csv(f"{path}/csv")
    df.write.mode(mode).json(f"{path}/json")


def write_confusion(wide: DataFrame, path: str, overwrite: bool = False) -> None:
    """A confusion table as one CSV file with a header."""
    wide.coalesce(1).write.mode("overwrite" if overwrite else "errorifexists").option("header", True).csv(path)


# --- run index ------------------------------------------------------------------------------------------------


def append_runs(rows: DataFrame, path: str) -> None:
    """Appends finished runs; old files stay as they are even if the new rows have more columns."""
    rows.write.mode("append").parquet(path)


def read_runs(spark: SparkSession, path: str, order: list[str] | None = None) -> DataFrame:
    """The whole index: columns of all appends, with null where an older append lacked one.

    ``order`` lists known columns first; columns that appeared later follow.
    """
    df = spark.read.option("mergeSchema", True).parquet(path)
    if order:
        df = df.select(*[c for c in order if c in df.columns], *[c for c in df.columns if c not in order])
    return df


def union_runs(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old columns in their order, new ones last, gaps null."""
    return old.unionByName(new, allowMissingColumns=True)
