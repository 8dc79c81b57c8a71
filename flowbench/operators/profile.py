"""Profile of a labelled flow table: every count in a few aggregates, each a single scan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowbench.functions.names import normalise_name, numeric_columns
from flowbench.functions.values import as_column, is_infinite, is_missing, or_token, strict_label, utc_micros
from flowbench.operators.order import exact_quantiles
from flowbench.session import settle
from flowbench.specs import ALL_NUMERIC, FeatureSet

# Group and time columns a profile looks for.
GROUP_COLUMNS = ("class", "dataset_source", "capture_file", "label_source")
TIME_COLUMNS = ("timestamp", "flow_start_ts")


def value_counts(df: DataFrame, value: Column | str, name: str = "value") -> DataFrame:
    """Counts per value, null included, most common first."""
    tallies = df.groupBy(as_column(value).alias(name)).agg(F.count("*").alias("n"))
    return tallies.orderBy(F.desc("n"), F.asc_nulls_first(name))


def label_counts(df: DataFrame, label: str) -> DataFrame:
    """Counts of the strict binary label, ordered by label."""
    return df.groupBy(strict_label(label).alias("label")).agg(F.count("*").alias("n")).orderBy("label")


def group_label_counts(df: DataFrame, label: str, groups: Sequence[str]) -> DataFrame:
    """Benign, malicious and all rows by each value of each group column, in one pass over the table."""
    y = strict_label(label)
    cells = df.select(y.alias("_y"), *[or_token(g).alias(g) for g in groups])
    sets = cells.groupingSets([[g] for g in groups], *groups).agg(
        F.grouping_id().alias("_set"),
        F.sum(F.when(F.col("_y") == 0, 1).otherwise(0)).cast("bigint").alias("benign"),
        F.sum(F.when(F.col("_y") == 1, 1).otherwise(0)).cast("bigint").alias("malicious"),
    )
    # Every cell holds a text after or_token, so the only non-null key tells which set the row belongs to.
    which = F.coalesce(*[F.when(F.col(g).isNotNull(), F.lit(g)) for g in groups])
    return sets.select(
        which.alias("column"),
        F.coalesce(*[F.col(g) for g in groups]).alias("value"),
        (F.col("benign") + F.col("malicious")).alias("total"),
        "benign",
        "malicious",
    )


def _wide(df: DataFrame, label: str | None) -> tuple[list[str], list[str]]:
    columns = [c for c in df.columns if c != label]
    numeric = [c for c in numeric_columns(df) if c != label]
    return columns, numeric


def column_quality(df: DataFrame, label: str | None = None, per_aggregate: int = 100) -> DataFrame:
    """Missing and infinite cells of each column: ``column, kind, missing, infinite``.

    Wide tables are aggregated in blocks of columns, so that each aggregate stays inside compiled code.
    """
    columns, numeric = _wide(df, label)
    result = None
    for start in range(0, len(columns), per_aggregate):
        block = columns[start : start + per_aggregate]
        aggregates = []
        for c in block:
            col = F.col(f"`{c}`")
            aggregates.append(F.count(F.when(is_missing(col, df.schema[c].dataType), 1)).alias(f"{c}|m"))
            if c in numeric and isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)):
                aggregates.append(F.count(F.when(is_infinite(col), 1)).alias(f"{c}|i"))
        row = df.agg(*aggregates)
        cells = F.array(
            *[
                F.struct(
                    F.lit(c).alias("column"),
                    F.lit("numeric" if c in numeric else "other").alias("kind"),
                    F.col(f"`{c}|m`").alias("missing"),
                    (F.col(f"`{c}|i`") if f"{c}|i" in row.columns else F.lit(0).cast("bigint")).alias("infinite"),
                )
                for c in block
            ]
        )
        part = row.select(F.inline(cells))
        result = part if result is None else result.unionByName(part)
    return result


def table_shape(df: DataFrame, label: str | None = None) -> DataFrame:
    """One row: rows, columns, numeric and other columns besides the label, missing and infinite cells."""
    columns, numeric = _wide(df, label)
    missing, infinite = F.lit(0), F.lit(0)
    for c in columns:
        col, kind = F.col(f"`{c}`"), df.schema[c].dataType
        missing = missing + is_missing(col, kind).cast("int")
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            infinite = infinite + F.coalesce(is_infinite(col), F.lit(False)).cast("int")
    return df.agg(
        F.count("*").alias("n_rows"),
        F.sum(missing).cast("bigint").alias("missing"),
        F.sum(infinite).cast("bigint").alias("infinite"),
    ).select(
        "n_rows",
        F.lit(len(df.columns)).cast("bigint").alias("n_columns"),
        F.lit(len(numeric)).cast("bigint").alias("n_numeric"),
        F.lit(len(columns) - len(numeric)).cast("bigint").alias("n_other"),
        "missing",
        "infinite",
    )


def time_range(df: DataFrame, label: str, times: Sequence[str]) -> DataFrame:
    """Earliest and latest UTC time of each time column, and rows without a usable time by label."""
    y = strict_label(label)
    stamped = df.select(y.alias("_y"), *[utc_micros(c, df.schema[c].dataType).alias(c) for c in times])
    row = stamped.agg(
        *[f(F.col(c)).alias(f"{c}|{n}") for c in times for n, f in (("lo", F.min), ("hi", F.max))],
        *[F.count(F.when(F.col(c).isNull() & (F.col("_y") == k), 1)).alias(f"{c}|{k}") for c in times for k in (0, 1)],
    )
    cells = [
        F.struct(
            F.lit(c).alias("column"),
            F.col(f"`{c}|lo`").alias("earliest_us"),
            F.col(f"`{c}|hi`").alias("latest_us"),
            F.col(f"`{c}|0`").alias("missing_benign"),
            F.col(f"`{c}|1`").alias("missing_malicious"),
        )
        for c in times
    ]
    return row.select(F.inline(F.array(*cells)))


def table_summary(df: DataFrame, label: str, k: int = 30) -> DataFrame:
    """Table summary as ``item, label, n``: the row count, the column count and the ``k`` most common labels."""
    tallies = df.groupBy(F.col(label).cast("string").alias("label")).agg(F.count("*").alias("n"))
    none = F.lit(None).cast("string").alias("label")
    rows = tallies.agg(F.sum("n").alias("n")).select(F.lit("rows").alias("item"), none, "n")
    columns = rows.select(F.lit("columns").alias("item"), none, F.lit(len(df.columns)).cast("bigint").alias("n"))
    top = tallies.orderBy(F.desc("n"), F.asc_nulls_first("label")).limit(k)
    return rows.unionByName(columns).unionByName(top.select(F.lit("label").alias("item"), "label", "n"))


def compare_datasets(df: DataFrame, dataset: str, label: str, packets: str, benign: str = "benign") -> DataFrame:
    """Flows, packets, benign and malicious rows and malicious percent of each data set in a union."""
    is_benign = F.coalesce(F.col(label) == F.lit(benign), F.lit(False))
    sums = df.groupBy(F.col(dataset).alias("dataset")).agg(
        F.count("*").alias("flows"),
        F.sum(F.col(packets)).cast("bigint").alias("packets"),
        F.count(F.when(is_benign, 1)).alias("benign"),
    )
    malicious = F.col("flows") - F.col("benign")
    return sums.select(
        "*", malicious.alias("malicious"), (F.lit(100.0) * malicious / F.col("flows")).alias("malicious_percent")
    )


def interval_levels(
    df: DataFrame, time: str, seconds: int, tuples: Sequence[str], size: str, shares: Sequence[float] = (0.2, 0.4, 0.6, 0.8)
) -> DataFrame:
    """Traffic of each interval: flows, distinct tuples, variance of a size, and a level from 1 by quantiles of
    the flow counts."""
    micros = utc_micros(time, df.schema[time].dataType)
    start = F.floor(micros / F.lit(seconds * 1_000_000)) * F.lit(seconds * 1_000_000)
    spans = settle(
        df.groupBy(start.cast("bigint").alias("start_us")).agg(
            F.count("*").alias("flows"),
            F.count_distinct(F.struct(*tuples)).alias("tuples"),
            F.var_pop(size).alias("variance"),
        )
    )
    cuts = exact_quantiles(spans, {"flows": list(shares)})["flows"]
    level = sum(((F.col("flows") > F.lit(q)).cast("int") for q in cuts if q is not None), F.lit(1))
    return spans.withColumn("level", level)


# --- column sets ----------------------------------------------------------------------------------------------


def column_table(tables: Mapping[str, DataFrame], mode: str = "compare") -> DataFrame:
    """``dataset, column`` rows of several tables under one column-name rule."""
    spark = next(iter(tables.values())).sparkSession
    rows = [(name, normalise_name(c, mode)) for name, df in tables.items() for c in df.columns]
    return spark.createDataFrame(rows, "dataset string, column string").distinct()


def present_columns(df: DataFrame, dataset: str, columns: Sequence[str]) -> DataFrame:
    """``dataset, column`` rows for a union of data sets: a column is present where it holds any value."""
    counts = df.groupBy(F.col(dataset).alias("dataset")).agg(
        *[F.count(F.when(~is_missing(F.col(c), df.schema[c].dataType), 1)).alias(c) for c in columns]
    )
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n")) for c in columns])
    return counts.select("dataset", F.inline(cells)).where("n > 0").select("dataset", "column")


def column_overlap(columns: DataFrame, left: str, right: str) -> DataFrame:
    """Each column of two tables with ``both``, ``left`` or ``right`` as its place."""
    in_left = F.max((F.col("dataset") == left).cast("int"))
    in_right = F.max((F.col("dataset") == right).cast("int"))
    sides = columns.where(F.col("dataset").isin(left, right)).groupBy("column").agg(in_left.alias("l"), in_right.alias("r"))
    place = F.when(F.col("l") + F.col("r") == 2, "both").when(F.col("l") == 1, "left").otherwise("right")
    return sides.select("column", place.alias("place"))


def pairwise_common(columns: DataFrame) -> DataFrame:
    """Number of common columns of each pair of tables, and of all tables together (``*``)."""
    a, b = columns.alias("a"), columns.alias("b")
    pairs = (
        a.join(b, (F.col("a.column") == F.col("b.column")) & (F.col("a.dataset") < F.col("b.dataset")))
        .groupBy(F.col("a.dataset").alias("left"), F.col("b.dataset").alias("right"))
        .agg(F.count("*").alias("common"))
    )
    n = columns.agg(F.count_distinct("dataset").alias("n"))
    per_column = columns.groupBy("column").agg(F.count("*").alias("k"))
    everywhere = per_column.join(F.broadcast(n), F.col("k") == F.col("n")).agg(F.count("*").alias("common"))
    return pairs.unionByName(everywhere.select(F.lit("*").alias("left"), F.lit("*").alias("right"), "common"))


def missing_features(columns: DataFrame, needs: Mapping[str, Sequence[str]]) -> DataFrame:
    """Per data set and feature set: how many features it needs, which are absent, and whether it fits.

    ``columns`` holds ``dataset, column`` rows; a data set without any column does not appear.
    """
    have = columns.groupBy("dataset").agg(F.collect_set("column").alias("have"))  # a schema bounds this set
    wanted = F.array(
        *[
            F.struct(F.lit(name).alias("feature_set"), F.array(*map(F.lit, sorted(features))).alias("features"))
            for name, features in needs.items()
        ]
    )
    rows = have.select("dataset", "have", F.inline(wanted))
    absent = F.array_except("features", "have")
    return rows.select(
        "dataset",
        "feature_set",
        F.size("features").cast("bigint").alias("n_features"),
        F.array_join(absent, ",").alias("missing"),
        (F.size(absent) == 0).alias("compatible"),
    )


def feature_set_fit(df: DataFrame, sets: Sequence[FeatureSet], drop: Sequence[str] = (), mode: str = "main") -> DataFrame:
    """Which feature sets a table can serve: usable features and the missing ones."""
    spark = df.sparkSession
    present = {normalise_name(c, mode) for c in df.columns}
    numeric = {normalise_name(c, mode) for c in numeric_columns(df)}
    dropped = {normalise_name(c, mode) for c in drop}
    needed = []
    for s in sets:
        names = sorted(numeric - dropped) if s.features == ALL_NUMERIC else [normalise_name(c, mode) for c in s.features]
        needed += [(s.feature_set_id, c) for c in names]
    wanted = spark.createDataFrame(needed, "feature_set string, column string")
    have = spark.createDataFrame([(c,) for c in sorted(present)], "column string").withColumn("_here", F.lit(True))
    found = wanted.join(F.broadcast(have), "column", "left")  # a schema bounds this side
    return found.groupBy("feature_set").agg(
        F.count("*").alias("n_features"),
        F.array_join(F.sort_array(F.collect_list(F.when(F.col("_here").isNull(), F.col("column")))), ",").alias("missing"),
        F.bool_and(F.col("_here").isNotNull()).alias("compatible"),
    )


def profile_dataset(df: DataFrame, label: str) -> dict[str, DataFrame]:
    """All parts of a profile as small tables, keyed by name."""
    groups = [c for c in GROUP_COLUMNS if c in df.columns and c != label]
    times = [c for c in TIME_COLUMNS if c in df.columns]
    parts = {
        "shape": table_shape(df, label),
        "raw_labels": value_counts(df, label, "label"),
        "labels": label_counts(df, label),
        "quality": column_quality(df, label),
    }
    if groups:
        parts["groups"] = group_label_counts(df, label, groups)
    if times:
        parts["times"] = time_range(df, label, times)
    return parts
