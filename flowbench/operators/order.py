"""Exact order statistics without sending all rows to one task.

A global order is cut into ranges that depend on values only. Running totals are taken inside each range and
shifted by the totals of the ranges before it, so the only one-task step sees one row per range.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowbench.session import checkpoint

# Bounds of the number of ranges: enough for every task of a big cluster, few enough for the driver.
LEAST_RANGES, MOST_RANGES = 256, 8192
# Ranges of other values than numbers, at least: no range holds much more than a hundredth of the values.
LEAST_VALUE_RANGES = 128
# Up to this many values in all columns together Spark's own exact percentile (a value-to-count map per column) is used.
PERCENTILE_VALUES = 1_000_000


def range_count(spark: SparkSession) -> int:
    """Twice the shuffle parallelism, within bounds: each task sorts a range or two."""
    return min(max(LEAST_RANGES, 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))), MOST_RANGES)


def _numeric_bounds(df: DataFrame, column: str, ranges: int) -> list[float]:
    steps = ", ".join(f"{i / ranges!r}D" for i in range(1, ranges))
    row = df.agg(F.expr(f"percentile_approx(CAST(`{column}` AS DOUBLE), array({steps}), 10000)").alias("cuts")).first()
    return sorted({c for c in (row["cuts"] or []) if c is not None and math.isfinite(c)})


def with_range(
    df: DataFrame, column: str, out: str = "_range", ranges: int | None = None
) -> DataFrame:
    """Adds a range number that never decreases along the order of ``column``.

    Bounds of numbers are approximate quantiles. Other values are dealt out by Spark's range partitioner, whose sampled bounds
    are whole values, and kept: equal values share a range, and a range is a partition.
    """
    ranges = ranges or range_count(df.sparkSession)
    if isinstance(df.schema[column].dataType, T.NumericType):
        cuts = _numeric_bounds(df, column, ranges)
        if not cuts:
            return df.withColumn(out, F.lit(0))
        splits = [float("-inf"), *cuts, float("inf")]
        ranged = Bucketizer(splits=splits, inputCol="_value", outputCol=out, handleInvalid="keep").transform(
            df.withColumn("_value", F.col(column).cast("double"))
        )
        return ranged.withColumn(out, F.col(out).cast("int")).drop("_value")
    ranges = max(LEAST_VALUE_RANGES, 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return checkpoint(df.repartitionByRange(min(ranges, MOST_RANGES), column).withColumn(out, F.spark_partition_id()))


def running_before(df: DataFrame, order: str, totals: Mapping[str, str], ranges: int | None = None) -> DataFrame:
    """Adds, for each ``{out: value column}``, the sum of the values of all rows that come earlier in the order.

    ``order`` must be unique in ``df``: group by it first.
    """
    ranged = with_range(df, order, "_range", ranges)
    inside = W.partitionBy("_range").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    per_range = ranged.groupBy("_range").agg(*[F.sum(v).alias(o) for o, v in totals.items()])
    earlier = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # at most one row per range
    shift = per_range.select(
        "_range", *[F.coalesce(F.sum(o).over(earlier), F.lit(0)).alias(f"_shift_{o}") for o in totals]
    )
    local = ranged.withColumns(
        {f"_local_{o}": F.coalesce(F.sum(v).over(inside), F.lit(0)) for o, v in totals.items()}
    )
    joined = local.join(F.broadcast(shift), "_range")  # the range count bounds this side
    return joined.withColumns({o: F.col(f"_local_{o}") + F.col(f"_shift_{o}") for o in totals}).drop(
        "_range", *[f"_shift_{o}" for o in totals], *[f"_local_{o}" for o in totals]
    )


def codes(df: DataFrame, column: str, out: str = "code") -> DataFrame:
    """Each distinct non-null value with its position in ascending order, from 0."""
    values = df.select(column).where(F.col(column).isNotNull()).distinct().withColumn("_one", F.lit(1).cast("bigint"))
    return running_before(values, column, {out: "_one"}).drop("_one")


# --- exact percentiles ----------------------------------------------------------------------------------------


def _key(column: str, q: float) -> str:
    return f"{column}@{q!r}"


SLACK = 2e-4  # half the width, as a share of the values, of the bracket asked of a sketch


def exact_quantiles(
    df: DataFrame, wanted: Mapping[str, Sequence[float]], direct_limit: int = PERCENTILE_VALUES
) -> dict[str, list[float | None]]:
    """Interpolated percentiles of several columns, nulls and NaN left out.

    The first pass counts the values and sketches their quantiles. Few values: one aggregate with
    ``percentile``. Many values: the sketch brackets each wanted rank, a second pass counts what lies below and
    inside the bracket, and the bracket is narrowed the same way until few enough values lie inside to sort
    them. Sketch errors cost another pass, never exactness.
    """
    columns = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in wanted}
    # One sketch per column answers for all its ranks.
    points = {c: sorted({p for q in qs for p in (max(q - SLACK, 0.0), min(q + SLACK, 1.0))}) for c, qs in wanted.items()}
    first = df.agg(
        *[F.count(e).alias(f"n|{c}") for c, e in columns.items()],
        *[F.percentile_approx(e, points[c], 10_000).alias(f"s|{c}") for c, e in columns.items()],
    ).first()
    sizes = {c: first[f"n|{c}"] for c in wanted}
    # All columns of the one aggregate share the bound, the smallest first.
    small, held = [], 0
    for c in sorted(wanted, key=lambda c: sizes[c]):
        if held + sizes[c] <= direct_limit:
            small.append(c)
            held += sizes[c]
    result: dict[str, list[float | None]] = {}
    if small:
        row = df.agg(*[F.percentile(columns[c], F.array(*map(F.lit, wanted[c]))).alias(c) for c in small]).first()
        for c in small:
            result[c] = list(row[c]) if row[c] is not None else [None] * len(wanted[c])
    large = {c: wanted[c] for c in wanted if c not in result}
    if large:
        ranks, tried = {}, {}
        for c, qs in large.items():
            cut = dict(zip(points[c], first[f"s|{c}"]))
            for q in qs:
                position = (sizes[c] - 1) * q
                low = math.floor(position)
                ranks[_key(c, q)] = (c, low, position - low, sizes[c])
                tried[_key(c, q)] = (cut[max(q - SLACK, 0.0)], cut[min(q + SLACK, 1.0)])
        found = _values_at_ranks(df, columns, ranks, tried, direct_limit)
        for c, qs in large.items():
            result[c] = []
            for q in qs:
                low, high = found[_key(c, q)]
                part = ranks[_key(c, q)][2]
                result[c].append(low + (high - low) * part)
    return {c: result[c] for c in wanted}


def _values_at_ranks(df, columns, ranks, tried, direct_limit):
    """Values at zero-based ranks ``low`` and ``low + 1`` for each key; ``tried`` holds the first brackets."""
    bracket = {k: (-math.inf, math.inf) for k in ranks}
    below = {k: 0 for k in ranks}
    inside = {k: size for k, (_, _, _, size) in ranks.items()}
    open_keys = list(ranks)

    def within(value: Column, ends: tuple[float, float]) -> Column:
        return (value >= F.lit(ends[0])) & (value <= F.lit(ends[1]))

    def limited(k: str) -> Column:
        value = columns[ranks[k][0]]
        return F.when(within(value, bracket[k]), value)

    while open_keys:
        values = {k: columns[ranks[k][0]] for k in open_keys}
        counts = df.agg(
            *[F.count(F.when(v < F.lit(tried[k][0]), 1)).alias(f"b|{k}") for k, v in values.items()],
            *[F.count(F.when(within(v, tried[k]), 1)).alias(f"i|{k}") for k, v in values.items()],
        ).first()
        wide = []
        for k in open_keys:
            _, low, _, size = ranks[k]
            n_below, n_inside = counts[f"b|{k}"], counts[f"i|{k}"]
            covered = n_below <= low and min(low + 1, size - 1) < n_below + n_inside
            if covered and n_inside < inside[k]:
                bracket[k], below[k], inside[k] = tried[k], n_below, n_inside
                if n_inside > direct_limit and tried[k][0] < tried[k][1]:
                    wide.append(k)
            # An uncovered or unchanged bracket is left as it is: the sort below stays exact, only wider.
        open_keys = wide
        if open_keys:
            asked = []
            for k in open_keys:
                share = (ranks[k][1] - below[k]) / max(inside[k] - 1, 1)
                ends = [max(share - SLACK, 0.0), min(share + SLACK + 1 / inside[k], 1.0)]
                asked.append(F.percentile_approx(limited(k), ends, 10_000).alias(k))
            cuts = df.agg(*asked).first()
            tried = {k: tuple(cuts[k]) for k in open_keys}

    found = {k: (bracket[k][0],) * 2 for k in ranks if bracket[k][0] == bracket[k][1]}
    rest = [k for k in ranks if k not in found]
    if not rest:
        return found
    cells = F.filter(
        F.array(*[F.struct(F.lit(k).alias("k"), limited(k).alias("v")) for k in rest]), lambda c: c["v"].isNotNull()
    )
    tallies = df.select(F.inline(cells)).groupBy("k", "v").agg(F.count("*").alias("n"))
    places = {k: (ranks[k][1] - below[k], min(ranks[k][1] + 1, ranks[k][3] - 1) - below[k]) for k in rest}

    def hits(rows: DataFrame, k: Column) -> DataFrame:
        """The one or two values that hold the wanted places."""
        end = F.col("before") + F.col("n")
        at = F.element_at(F.create_map(*[F.lit(x) for key in rest for x in (key, F.array(*map(F.lit, places[key])))]), k)
        first, second = at[0], at[1]
        return rows.where(
            ((F.col("before") <= first) & (end > first)) | ((F.col("before") <= second) & (end > second))
        ).select(k.alias("k"), "v")

    narrow = [k for k in rest if inside[k] <= direct_limit]
    picked = []
    if narrow:
        # At most direct_limit values per key are left, so one window per key is small.
        earlier = W.partitionBy("k").orderBy("v").rowsBetween(W.unboundedPreceding, -1)
        small = tallies.where(F.col("k").isin(narrow)).withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        picked += hits(small, F.col("k")).collect()  # two values per key
    for k in rest:
        if k not in narrow:
            wide = running_before(tallies.where(F.col("k") == k).select("v", "n"), "v", {"before": "n"})
            picked += hits(wide, F.lit(k)).collect()
    for k in rest:
        values = sorted(r["v"] for r in picked if r["k"] == k)
        found[k] = (values[0], values[-1])
    return found


def most_frequent(df: DataFrame, columns: Sequence[str]) -> dict[str, str | None]:
    """Most frequent non-null text of each column; ties go to the smallest text. One pass for all columns."""
    cells = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]
    )
    tallies = (
        df.select(F.explode(cells).alias("c")).where(F.col("c.value").isNotNull())
        .groupBy("c.column", "c.value").agg(F.count("*").alias("n"))
    )
    best = tallies.groupBy("column").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("value"))
    found = {r["column"]: r["value"] for r in best.collect()}  # one row per column
    return {c: found.get(c) for c in columns}
