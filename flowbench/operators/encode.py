"""Feature preparation fitted on training rows only: imputing, scaling, category codes, label codes."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowbench.functions.names import ColumnError, column_kinds, require_columns
from flowbench.functions.values import class_text, finite_or_null, lenient_label
from flowbench.operators.order import codes, exact_quantiles, most_frequent
from flowbench.session import settle

UNKNOWN = -1


# --- statistics -----------------------------------------------------------------------------------------------


def mean_and_std(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column, mean, std`` with the population deviation; one pass for all columns."""
    row = df.agg(
        *[F.avg(F.col(c)).alias(f"{c}|m") for c in columns], *[F.stddev_pop(F.col(c)).alias(f"{c}|s") for c in columns]
    )
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.col(f"`{c}|m`").alias("mean"), F.col(f"`{c}|s`").alias("std"))
            for c in columns
        ]
    )
    return row.select(F.inline(cells))


def positive_weight(df: DataFrame, label: str) -> DataFrame:
    """One row: negative and positive rows and their quotient; a missing class is an error."""
    pos, neg = F.count(F.when(F.col(label) == 1, 1)), F.count(F.when(F.col(label) == 0, 1))
    failure = F.raise_error(F.lit("class weights need benign and malicious rows")).cast("double")
    return df.agg(neg.alias("negative"), pos.alias("positive")).withColumn(
        "positive_weight",
        F.when((F.col("negative") > 0) & (F.col("positive") > 0), F.col("negative") / F.col("positive")).otherwise(failure),
    )


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """``label, n, weight`` with weight = rows / (classes * rows of the class)."""
    tallies = settle(df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n")))
    facts = tallies.agg(F.sum("n").alias("rows"), F.count("*").alias("k")).first()
    rows, k = facts["rows"] or 0, facts["k"]
    return tallies.withColumn("weight", F.lit(float(rows)) / (F.lit(float(k)) * F.col("n")))


def with_balanced_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Rows with the weight of their class."""
    weights = settle(balanced_weights(df, label).select(F.col("label").alias("_class"), F.col("weight").alias(out)))
    return df.join(weights, F.col(label).eqNullSafe(F.col("_class")), "left").drop("_class")


def anova_f(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """``feature, f_score``: between-class over within-class variance. Null for a constant feature.

    Per-class means and variances come from one grouped pass; they merge without cancellation.
    """
    per_class = df.groupBy(label).agg(
        *[f(F.col(c)).alias(f"{c}|{n}") for c in features for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_pop))]
    )
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("feature"),
                F.col(f"`{c}|n`").cast("double").alias("n"),
                F.col(f"`{c}|m`").alias("m"),
                F.col(f"`{c}|v`").alias("v"),
            )
            for c in features
        ]
    )
    rows = per_class.select(F.inline(cells)).where("n > 0")
    # The between-class sum around the grand mean is n times the weighted variance of the class means.
    sums = rows.groupBy("feature").agg(
        F.count("*").alias("k"),
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.col("v")).alias("within"),
        F.collect_list(F.struct("n", "m")).alias("classes"),  # one entry per class
        (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("grand"),
    )
    between = F.aggregate(
        "classes", F.lit(0.0), lambda acc, c: acc + c["n"] * (c["m"] - F.col("grand")) * (c["m"] - F.col("grand"))
    )
    score = F.try_divide(between / (F.col("k") - 1), F.col("within") / (F.col("n") - F.col("k")))
    return sums.select("feature", F.when(F.col("k") > 1, score).alias("f_score"))


def anova_by_class(df: DataFrame, features: Sequence[str], classes: str, benign: str) -> DataFrame:
    """``class, feature, f_score`` of each attack class against benign rows, from one grouped pass."""
    moments = df.groupBy(F.col(classes).alias("class")).agg(
        *[f(F.col(c)).alias(f"{c}|{n}") for c in features for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_pop))]
    )
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("feature"), F.col(f"`{c}|n`").cast("double").alias("n"),
                F.col(f"`{c}|m`").alias("m"), F.col(f"`{c}|v`").alias("v"),
            )
            for c in features
        ]
    )
    rows = moments.select("class", F.inline(cells))
    base = rows.where(F.col("class") == benign).select(
        "feature", F.col("n").alias("bn"), F.col("m").alias("bm"), F.col("v").alias("bv")
    )
    pairs = rows.where(F.col("class") != benign).join(settle(base), "feature")
    grand = (F.col("n") * F.col("m") + F.col("bn") * F.col("bm")) / (F.col("n") + F.col("bn"))
    between = F.col("n") * F.pow(F.col("m") - grand, 2) + F.col("bn") * F.pow(F.col("bm") - grand, 2)
    within = (F.col("n") * F.col("v") + F.col("bn") * F.col("bv")) / (F.col("n") + F.col("bn") - 2)
    return pairs.select("class", "feature", F.try_divide(between, within).alias("f_score"))


def best_features(scores: DataFrame, k: int) -> DataFrame:
    """The ``k`` best features, at least one and at most all; ties by name, constant features last."""
    return scores.orderBy(F.desc_nulls_last("f_score"), "feature").limit(max(1, int(k)))


def correlation(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """``left, right, corr`` for each pair of features over the rows that have them all, from one pass; null beside a constant."""
    numbers = df.select(*[F.col(f"`{c}`").cast("double").alias(f"_f{i}") for i, c in enumerate(features)])
    rows = VectorAssembler(inputCols=numbers.columns, outputCol="_v", handleInvalid="skip").transform(numbers)
    matrix = Correlation.corr(rows.select("_v"), "_v").first()[0].toArray()  # features x features
    pairs = [(a, b, float(matrix[i, j])) for i, a in enumerate(features) for j, b in enumerate(features) if i < j]
    found = df.sparkSession.createDataFrame(pairs, "left string, right string, corr double")
    return found.withColumn("corr", F.when(~F.isnan("corr"), F.col("corr")))


# --- cleaning and alignment -----------------------------------------------------------------------------------


def clean_features(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Trimmed names, first of equal names, infinities as null, all-null columns removed."""
    seen: dict[str, int] = {}
    for i, c in enumerate(df.columns):
        seen.setdefault(c.strip(), i)
    names = list(seen)
    # Positions instead of names: equal source names cannot be told apart by name.
    numbered = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    out = []
    for name, i in seen.items():
        kind = df.schema.fields[i].dataType
        cell = F.col(f"_{i}")
        out.append((finite_or_null(cell) if isinstance(kind, (T.DoubleType, T.FloatType)) else cell).alias(name))
    cleaned = numbered.select(*out)
    filled = cleaned.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in names]).first()
    usable = [c for c in names if c in keep or filled[c] > 0]
    if not [c for c in usable if c not in keep]:
        raise ColumnError("no usable feature column is left after cleaning")
    return cleaned.select(*[F.col(f"`{c}`") for c in usable])


def align_to(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of ``schema`` in its order: absent ones are null, others are dropped."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f"`{f.name}`") if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in schema.fields
        ]
    )


def without(df: DataFrame, label: str, drop: Sequence[str] = ()) -> DataFrame:
    """Features only: the label has to exist, listed columns may be absent."""
    require_columns(df, [label])
    return df.drop(label, *drop)


# --- codes ----------------------------------------------------------------------------------------------------


def label_codes(labels: DataFrame, label: str = "label") -> DataFrame:
    """``label, code`` with codes in ascending label order, from 0."""
    return codes(labels.select(F.col(label).cast("string").alias("label")), "label")


def encode_labels(train: DataFrame, test: DataFrame, label: str, problem: str = "binary") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(train, test, mapping): labels normalised, then coded over the classes of both parts."""
    if problem not in ("binary", "multiclass"):
        raise ValueError(f"unknown problem type: {problem}")
    rule = lenient_label if problem == "binary" else class_text
    parts = [p.withColumn("class_name", rule(label)) for p in (train, test)]
    classes = parts[0].select("class_name").union(parts[1].select("class_name"))
    mapping = settle(label_codes(classes, "class_name"))
    coded = [
        p.join(mapping.withColumnRenamed("label", "class_name").withColumnRenamed("code", "label_code"), "class_name", "left")
        for p in parts
    ]
    return coded[0], coded[1], mapping


def value_ranges(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Smallest and largest finite value of each column, in one pass."""
    cells = {c: finite_or_null(c) for c in columns}
    row = df.agg(*[F.min(e).alias(f"lo|{c}") for c, e in cells.items()], *[F.max(e).alias(f"hi|{c}") for c, e in cells.items()]).first()
    return {c: (row[f"lo|{c}"], row[f"hi|{c}"]) for c in columns}


def scale_to_range(df: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """Features moved to 0..1 by fitted ranges; a constant feature is 0, a missing cell stays null."""
    return df.withColumns(
        {c: (finite_or_null(c) - F.lit(lo)) / F.lit((hi - lo) or 1.0) for c, (lo, hi) in ranges.items()}
    )


def one_hot(df: DataFrame, column: str, categories: Sequence[str]) -> DataFrame:
    """One 0/1 column ``<column>=<category>`` per fitted category; an unknown or missing cell is 0 everywhere."""
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return df.withColumns({f"{column}={v}": (text == F.lit(v)).cast("int") for v in categories})


# --- fitted preparation ---------------------------------------------------------------------------------------


@dataclass
class Preparation:
    """Everything learned from the training rows; apply it to any table with the same features."""

    numeric: list[str]
    categorical: list[str]
    medians: dict[str, float]
    modes: dict[str, str]
    means: dict[str, float]
    stds: dict[str, float]
    scale: bool
    schema_json: str
    categories: dict[str, DataFrame] = field(default_factory=dict, repr=False)

    @property
    def features(self) -> list[str]:
        return [*self.numeric, *self.categorical]

    @staticmethod
    def fit(train: DataFrame, exclude: Sequence[str] = (), scale: bool = True) -> "Preparation":
        """Median and mode imputing, population scaling and sorted category codes."""
        features = clean_features(train.drop(*exclude))
        numeric, categorical = column_kinds(features)
        medians: dict[str, float] = {}
        means: dict[str, float] = {}
        stds: dict[str, float] = {}
        if numeric:
            halves = exact_quantiles(features, {c: [0.5] for c in numeric})
            medians = {c: v[0] for c, v in halves.items()}
            if scale:
                filled = features.select(
                    *[F.coalesce(F.col(c).cast("double"), F.lit(medians[c])).alias(c) for c in numeric]
                )
                for r in mean_and_std(filled, numeric).collect():  # one row per feature
                    means[r["column"]], stds[r["column"]] = r["mean"], r["std"]
        modes = most_frequent(features, categorical) if categorical else {}
        prep = Preparation(numeric, categorical, medians, modes, means, stds, scale, features.schema.json())
        if categorical:
            # One pass collects the distinct texts of all columns.
            cells = F.array(
                *[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in categorical]
            )
            texts = features.select(F.inline(cells)).where(F.col("value").isNotNull()).distinct().persist()
            for c in categorical:
                prep.categories[c] = settle(codes(texts.where(F.col("column") == c), "value"))
            texts.unpersist()
        return prep

    def transform(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """Prepared doubles in feature order, plus the columns to keep."""
        schema = T.StructType.fromJson(json.loads(self.schema_json))
        have = set(df.columns)
        absent = {f.name: F.lit(None).cast(f.dataType) for f in schema.fields if f.name not in have}
        out = df.withColumns(absent) if absent else df
        cells: dict[str, Column] = {}
        for c in self.numeric:
            value = F.coalesce(finite_or_null(c), F.lit(self.medians[c]))
            if self.scale:
                spread = self.stds[c] or 1.0
                value = (value - F.lit(self.means[c])) / F.lit(spread)
            cells[c] = value
        out = out.withColumns(cells) if cells else out
        for c in self.categorical:
            known = self.categories[c].select(F.col("value").alias("_value"), F.col("code").alias("_code"))
            text = F.coalesce(F.col(c).cast("string"), F.lit(self.modes[c]))
            out = out.join(known, text == F.col("_value"), "left")
            out = out.withColumn(c, F.coalesce(F.col("_code"), F.lit(UNKNOWN)).cast("double")).drop("_value", "_code")
        return out.select(*keep, *self.features)

    def save(self, spark: SparkSession, path: str) -> None:
        """One JSON row of learned numbers and one table of category codes; an existing path is an error."""
        facts = {k: v for k, v in self.__dict__.items() if k != "categories"}
        spark.createDataFrame([(json.dumps(facts),)], "facts string").coalesce(1).write.json(f"{path}/facts")
        table = None
        for c, t in self.categories.items():
            part = t.select(F.lit(c).alias("column"), "value", F.col("code").cast("bigint").alias("code"))
            table = part if table is None else table.unionByName(part)
        if table is not None:
            table.write.partitionBy("column").parquet(f"{path}/categories")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Preparation":
        facts = json.loads(spark.read.schema("facts string").json(f"{path}/facts").first()[0])
        prep = Preparation(**facts)
        if prep.categorical:
            table = spark.read.schema("value string, code bigint, column string").parquet(f"{path}/categories")
            for c in prep.categorical:
                prep.categories[c] = settle(table.where(F.col("column") == c).select("value", "code"))
        return prep


def prepare_pair(
    train: DataFrame, test: DataFrame, label: str, problem: str = "binary", scale: bool = True, drop: Sequence[str] = (),
    keep: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame, DataFrame, Preparation]:
    """(train, test, label mapping, preparation): cleaned, aligned, imputed, scaled and coded on train alone."""
    coded_train, coded_test, mapping = encode_labels(train, test, label, problem)
    prep = Preparation.fit(train, exclude=[label, *drop, *keep], scale=scale)
    held = [*keep, "label_code"]
    return prep.transform(coded_train, held), prep.transform(coded_test, held), mapping, prep


def standardise(df: DataFrame, stats: dict[str, tuple[float, float]]) -> DataFrame:
    """Scaled features from fitted means and deviations: a zero deviation divides by 1, non-finite results are 0."""
    cells = {}
    for c, (mean, std) in stats.items():
        z = (F.col(c).cast("double") - F.lit(mean)) / F.lit(std or 1.0)
        cells[c] = F.coalesce(finite_or_null(z), F.lit(0.0))
    return df.withColumns(cells)


def standard_stats(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Means and population deviations of features, as fitted parameters."""
    return {r["column"]: (r["mean"], r["std"]) for r in mean_and_std(df, columns).collect()}  # one row per feature
