"""Reproducible train/test cuts.

Every row gets a hash of its key and the seed. A part is "the rows of a stratum whose hash is at or below the
stratum's cut", so applying a split is one comparison per row and does not shuffle. Finding the cut reads
nothing but the key, the stratum and what the table's own filters need, in two passes:

1. count each stratum and share the wanted number of rows (largest remainder);
2. hashes are uniform, so the cut lies close to the same share of the hash space: count the rows below a
   narrow bracket around it, keep the hashes inside (about 12 * sqrt(rows) of them) and drop the rest. A
   running total over these few hashes gives the cut.

A cut outside its bracket (odds below one in a million, or keys that are not unique) is searched over the
whole hash space instead: one more pass, same answer. Rows that share a key always stay together.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowbench.functions.names import normalise_columns
from flowbench.functions.values import same_group
from flowbench.session import BROADCAST_ROWS, settle, settled
from flowbench.specs import SplitSpec

PREFIX = 5  # hex digits of the cells of the whole-space search: 2 ** 20 cells
DIGITS = 13  # leading hex digits of a hash that are used as a number; a double holds them exactly
_SPACE = 16.0**DIGITS


class SplitError(ValueError):
    """A split cannot be made or does not fit the table."""


def row_hash(key: Sequence[str], seed: int) -> Column:
    """md5 text of seed and row key: uniform, and the same in any engine and any partition layout."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))


def _position(h: Column) -> Column:
    """The leading digits as a number from 0 up to, but not including, 16 ** DIGITS."""
    return F.conv(F.substring(h, 1, DIGITS), 16, 10).cast("bigint").cast("double")


def _leading_digits(share: Column) -> Column:
    """The hash prefix that lies at a share of the hash space; shares outside 0..1 count as 0 or almost 1."""
    spot = F.least(F.greatest(F.floor(share * F.lit(_SPACE)), F.lit(0)), F.lit(int(_SPACE) - 1))
    return F.lower(F.lpad(F.hex(spot.cast("bigint")), DIGITS, "0"))


def share_rows(strata: DataFrame, total: Column) -> DataFrame:
    """``stratum, n`` plus the stratum's quota of ``total`` rows: whole shares, then largest remainders.

    Products of row numbers are decimals of 38 digits: exact for up to 10**19 rows.
    """
    everything = W.partitionBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    n_all = F.sum("n").over(everything)
    shares = strata.withColumn("_all", n_all).withColumn("_total", total)
    product = "CAST(CAST(_total AS DECIMAL(19, 0)) * CAST(n AS DECIMAL(19, 0)) AS DECIMAL(38, 0))"
    shares = shares.withColumn("_whole", F.expr(f"{product} div CAST(_all AS DECIMAL(19, 0))"))
    shares = shares.withColumn("_part", F.expr(f"{product} % CAST(_all AS DECIMAL(19, 0))"))
    left = F.col("_total").cast("bigint") - F.sum("_whole").over(everything)
    place = F.row_number().over(W.partitionBy(F.lit(1)).orderBy(F.desc("_part"), "stratum"))
    return shares.select(
        "stratum", "n", (F.col("_whole") + F.when(place <= left, 1).otherwise(0)).cast("bigint").alias("quota")
    )


def strata_counts(df: DataFrame, stratum: Column) -> DataFrame:
    return df.groupBy(stratum.cast("string").alias("stratum")).agg(F.count("*").alias("n"))


def _hashed(df: DataFrame, key: Sequence[str], seed: int, stratum: Column) -> DataFrame:
    return df.select(stratum.cast("string").alias("stratum"), row_hash(key, seed).alias("h"))


def _holding_cells(cells: DataFrame) -> DataFrame:
    """The cell of each stratum in which the running row count reaches the quota, and what it still needs."""
    before = F.coalesce(
        F.sum("n").over(W.partitionBy("stratum").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
    )
    return (
        cells.withColumn("before", before)
        .where((F.col("before") < F.col("quota")) & (F.col("before") + F.col("n") >= F.col("quota")))
        .select("stratum", "cell", (F.col("quota") - F.col("before")).alias("need"))
    )


def _last_within(hashes: DataFrame) -> DataFrame:
    """``stratum, cut`` of hashes with counts ``n`` inside one cell: the last one whose running total fits."""
    running = F.sum("n").over(W.partitionBy("stratum").orderBy("h").rowsBetween(W.unboundedPreceding, W.currentRow))
    return (
        hashes.withColumn("running", running)
        .groupBy("stratum")
        .agg(F.max(F.when(F.col("running") <= F.col("need"), F.col("h"))).alias("cut"))
    )


def hash_cuts(df: DataFrame, key: Sequence[str], seed: int, stratum: Column, quotas: DataFrame) -> DataFrame:
    """``stratum, cut``: the largest hash that belongs to the stratum's first ``quota`` rows.

    ``quotas`` holds ``stratum, n, quota``. Strata with quota 0 get an empty cut, below every hash.
    """
    share = F.col("quota") / F.col("n")
    slack = F.lit(6.0) * F.sqrt(share * (1 - share) / F.col("n")) + F.lit(8.0) / F.col("n")
    wanted = quotas.where("quota > 0")
    # "g" follows every hex digit, so the upper end takes in all hashes with its prefix.
    brackets = wanted.select(
        "stratum", "quota", _leading_digits(share - slack).alias("lo"),
        F.concat(_leading_digits(share + slack), F.lit("g")).alias("hi"),
    )
    tallies = (
        _hashed(df, key, seed, stratum)
        .join(brackets, "stratum")
        .where(F.col("h") <= F.col("hi"))
        .groupBy("stratum", "quota", F.when(F.col("h") >= F.col("lo"), F.col("h")).alias("h"))
        .agg(F.count("*").alias("n"))
    )
    # The rows below the bracket are one entry without a hash, so they come first.
    upto = W.partitionBy("stratum").orderBy(F.asc_nulls_first("h")).rowsBetween(W.unboundedPreceding, W.currentRow)
    fits = F.max(F.when(F.col("running") <= F.col("quota"), F.col("h")))
    found, n_found = settled(
        tallies.withColumn("running", F.sum("n").over(upto))
        .groupBy("stratum", "quota")
        .agg(fits.alias("cut"), F.max("running").alias("covered"))
        .where("cut IS NOT NULL AND covered >= quota")
        .select("stratum", "cut")
    )
    cuts = found.unionByName(quotas.where("quota = 0").select("stratum", F.lit("").alias("cut")))
    # A settled quota table is local, so its rows are at hand without another job.
    n_wanted = len(wanted.limit(BROADCAST_ROWS + 1).collect())
    if n_found == n_wanted <= BROADCAST_ROWS:
        return F.broadcast(cuts)
    missed = settle(wanted.join(found, "stratum", "left_anti"))
    return settle(cuts.unionByName(_whole_space_cuts(df, key, seed, stratum, missed)))


def _whole_space_cuts(df: DataFrame, key: Sequence[str], seed: int, stratum: Column, quotas: DataFrame) -> DataFrame:
    """The same cuts from cells that are hash prefixes; a cell whose first hash is too frequent ends before it."""
    celled = (
        _hashed(df, key, seed, stratum)
        .join(quotas.select("stratum", "quota"), "stratum")
        .withColumn("cell", F.substring("h", 1, PREFIX))
    )
    per_cell = celled.groupBy("stratum", "quota", "cell").agg(F.count("*").alias("n"))
    holders = settle(_holding_cells(per_cell))
    hashes = celled.join(holders, ["stratum", "cell"]).groupBy("stratum", "need", "h").agg(F.count("*").alias("n"))
    # Every hash of an earlier cell is below the bare prefix, every hash of this cell above it.
    return (
        holders.join(_last_within(hashes), "stratum", "left")
        .select("stratum", F.coalesce("cut", "cell").alias("cut"))
    )


def assign(
    df: DataFrame, key: Sequence[str], seed: int, stratum: Column, quotas: DataFrame, inside: str, outside: str
) -> DataFrame:
    """Adds ``part``: ``inside`` for each stratum's first ``quota`` rows by hash, else ``outside``."""
    quotas = settle(quotas)
    cuts = hash_cuts(df, key, seed, stratum, quotas)
    marked = df.withColumn("_stratum", stratum.cast("string")).join(
        cuts.withColumnRenamed("stratum", "_stratum"), "_stratum", "left"
    )
    chosen = F.coalesce(row_hash(key, seed) <= F.col("cut"), F.lit(False))
    return marked.withColumn("part", F.when(chosen, inside).otherwise(outside)).drop("_stratum", "cut")


def _one_stratum() -> Column:
    return F.lit("*")


def _stratum_of(label: Column | str) -> Column:
    col = F.col(label) if isinstance(label, str) else label
    return F.coalesce(col.cast("string"), F.lit("<missing>"))


def random_parts(
    df: DataFrame, key: Sequence[str], fraction: float, seed: int = 42, label: Column | str | None = None
) -> DataFrame:
    """Exact random cut: ceil(rows * fraction) test rows, shared among labels if a label is given."""
    stratum = _one_stratum() if label is None else _stratum_of(label)
    total = F.ceil(F.col("_all") * F.lit(float(fraction)))
    quotas = share_rows(strata_counts(df, stratum), total)
    return assign(df, key, seed, stratum, quotas, "test", "train")


def can_stratify(df: DataFrame, label: Column | str) -> DataFrame:
    """One row: whether there are at least two classes and each has at least two rows."""
    tallies = strata_counts(df, _stratum_of(label))
    return tallies.agg(
        F.count("*").alias("classes"),
        F.min("n").alias("smallest"),
        F.coalesce((F.count("*") >= 2) & (F.min("n") >= 2), F.lit(False)).alias("can_stratify"),
    )


def checked_random_parts(
    df: DataFrame,
    key: Sequence[str],
    fraction: float = 0.2,
    seed: int = 42,
    method: str = "stratified",
    label: Column | str | None = None,
) -> DataFrame:
    """Split with argument checks; a stratified request falls back to random if a class is too small."""
    if not 0.0 < float(fraction) < 1.0:
        raise SplitError(f"the test fraction must lie between 0 and 1, got {fraction}")
    if method not in ("stratified", "random"):
        raise SplitError(f"unknown split method: {method}")
    if len(df.take(2)) < 2:
        raise SplitError("a table with fewer than 2 rows cannot be split")
    if method == "stratified":
        if label is None:
            raise SplitError("a stratified split needs a label")
        if not can_stratify(df, label).first()["can_stratify"]:
            label = None
    else:
        label = None
    return random_parts(df, key, fraction, seed, label)


def holdout_parts(
    df: DataFrame, key: Sequence[str], label: str, group: str, value: str, fraction: float = 0.2, seed: int = 42
) -> DataFrame:
    """Unseen-attack cut. ``label`` is 0/1. Held-out attacks are tested only, other attacks trained only.

    Benign rows are cut by fraction. A value without rows, or with benign rows, is an error.
    """
    if group not in df.columns:
        raise SplitError(f"no such group column: {group}")
    held = same_group(group, value)
    guard = df.agg(
        F.count(F.when(held, 1)).alias("rows"),
        F.count(F.when(held & ~F.coalesce(F.col(label) == 1, F.lit(False)), 1)).alias("not_attacks"),
        F.count(F.when(F.col(label) == 0, 1)).alias("benign"),
    ).first()
    if not guard["rows"]:
        raise SplitError(f"no rows with {group} = {value!r}")
    if guard["not_attacks"]:
        raise SplitError(f"{guard['not_attacks']} rows with {group} = {value!r} are not attacks")
    spark = df.sparkSession
    benign = guard["benign"]
    quota = math.ceil(benign * float(fraction))
    quotas = spark.createDataFrame([("benign", benign, quota)], "stratum string, n bigint, quota bigint")
    # Attacks form a stratum without quota: they never get a cut, so their part follows from the group alone.
    stratum = F.when(F.col(label) == 0, F.lit("benign")).otherwise(F.lit("attack"))
    parts = assign(df, key, seed, stratum, quotas, "test", "train")
    return parts.withColumn("part", F.when(held, F.lit("test")).otherwise(F.col("part")))


def external_parts(df: DataFrame) -> DataFrame:
    """Every row is a test row."""
    return df.withColumn("part", F.lit("test"))


def split_parts(df: DataFrame, label: str, spec: SplitSpec) -> DataFrame:
    """Adds ``part`` under the split's method; ``label`` holds 0/1."""
    if spec.method == "random":
        return random_parts(df, spec.row_key, spec.fraction, spec.seed, label if spec.stratify else None)
    if spec.method == "attack_family_holdout":
        if spec.group is None or spec.holdout is None:
            raise SplitError("a holdout split needs a group column and a value")
        return holdout_parts(df, spec.row_key, label, spec.group, spec.holdout, spec.fraction, spec.seed)
    if spec.method == "external_full":
        return external_parts(df)
    raise NotImplementedError(f"unknown split method: {spec.method}")


def cap_rows(df: DataFrame, key: Sequence[str], cap: int | None, seed: int = 42, label: str | None = None) -> DataFrame:
    """Exactly ``cap`` rows with the label shares kept; no cap, or one that is not smaller, keeps all rows."""
    if cap is None:
        return df
    stratum = _one_stratum() if label is None else _stratum_of(label)
    tallies = settle(strata_counts(df, stratum))
    rows = tallies.agg(F.sum("n")).first()[0] or 0
    if cap >= rows:
        return df
    if cap <= 0:
        raise SplitError("a row cap must be greater than 0")
    quotas = share_rows(tallies, F.lit(cap))
    return assign(df, key, seed, stratum, quotas, "keep", "leave").where("part = 'keep'").drop("part")


def balanced_rows(df: DataFrame, key: Sequence[str], label: str, size: int | None = None, seed: int = 42) -> DataFrame:
    """The same number of rows of each class: ``size`` in all, or as many as the smallest class has."""
    tallies = settle(strata_counts(df, _stratum_of(label)))
    facts = tallies.agg(F.min("n").alias("least"), F.count("*").alias("k")).first()
    each = facts["least"] if size is None else size // facts["k"]
    if each <= 0 or each > facts["least"]:
        raise SplitError(f"cannot take {each} rows of each class; the smallest class has {facts['least']}")
    quotas = tallies.withColumn("quota", F.lit(each).cast("bigint"))
    return assign(df, key, seed, _stratum_of(label), quotas, "keep", "leave").where("part = 'keep'").drop("part")


def fitting_parts(df: DataFrame, key: Sequence[str], fraction: float = 0.1, seed: int = 42) -> DataFrame:
    """Validation cut of a training table: floor(rows * fraction) rows, at least 1 and at most all but one."""
    tallies = settle(strata_counts(df, _one_stratum()))
    rows = tallies.agg(F.sum("n")).first()[0] or 0
    if rows < 2:
        raise SplitError("a validation cut needs at least 2 rows")
    quota = min(max(1, int(rows * fraction)), rows - 1)
    quotas = tallies.withColumn("quota", F.lit(quota).cast("bigint"))
    return assign(df, key, seed, _one_stratum(), quotas, "validation", "fitting")


def folds(df: DataFrame, key: Sequence[str], k: int, seed: int = 42) -> DataFrame:
    """Adds ``fold`` 0..k-1 from the row hash: near-equal folds without a shuffle."""
    return df.withColumn("fold", F.floor(_position(row_hash(key, seed)) / F.lit(_SPACE) * k).cast("int"))


def aligned_union(tables: Mapping[str, DataFrame], label: str, mode: str = "compare") -> DataFrame:
    """Tables cut to the columns they all have, stacked, with the table's name as ``dataset_source``."""
    renamed = {name: normalise_columns(df.drop("dataset_source"), mode) for name, df in tables.items()}
    first = next(iter(renamed.values()))
    common = [c for c in first.columns if all(c in df.columns for df in renamed.values())]
    if label not in common or len(common) < 2:
        raise SplitError(f"the tables share no features next to {label!r}: {common}")
    result = None
    for name, df in renamed.items():
        part = df.select(*common, F.lit(name).alias("dataset_source"))
        result = part if result is None else result.unionByName(part)
    return result


# --- saved membership -----------------------------------------------------------------------------------------


def membership(parts: DataFrame, key: Sequence[str], split_id: str) -> DataFrame:
    """The assignment table: row key, split and part. Positions are never stored."""
    return parts.select(*key, F.lit(split_id).alias("split_id"), "part")


def apply_membership(df: DataFrame, saved: DataFrame, key: Sequence[str], check: bool = True) -> tuple[DataFrame, DataFrame]:
    """(train, test) rows of a saved split. An empty part or a saved row the table lacks is an error."""
    key = list(key)
    if check:
        known = saved.join(df.select(*key), key, "left_anti")
        sizes = {r["part"]: r["n"] for r in saved.groupBy("part").agg(F.count("*").alias("n")).collect()}
        empty = [p for p in ("train", "test") if not sizes.get(p)]
        if empty:
            raise SplitError(f"the saved split has no rows in: {empty}")
        if known.take(1):
            raise SplitError("the saved split names rows that the table lacks")

    def rows(part: str) -> DataFrame:
        return df.join(saved.where(F.col("part") == part).select(*key), key, "left_semi")

    return rows("train"), rows("test")


def describe_parts(parts: DataFrame, label: str) -> DataFrame:
    """Rows per part and label, ordered."""
    return parts.groupBy("part", F.col(label).cast("string").alias("label")).agg(F.count("*").alias("n")).orderBy("part", "label")
