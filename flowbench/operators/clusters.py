"""Turning cluster numbers into class labels, and the k-means detector built on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowbench.session import settle


def cluster_labels(df: DataFrame, cluster: str, label: str) -> DataFrame:
    """``cluster, label, n``: the majority label of each cluster; a tie goes to the smaller label."""
    tallies = df.groupBy(F.col(cluster).alias("cluster"), F.col(label).alias("label")).agg(F.count("*").alias("n"))
    best = F.max_by(F.struct("label", "n"), F.struct("n", -F.col("label")))
    return tallies.groupBy("cluster").agg(best.alias("b")).select("cluster", "b.label", "b.n")


def default_label(df: DataFrame, label: str) -> int:
    """The majority label of all rows."""
    tallies = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    return tallies.orderBy(F.desc("n"), "label").first()["label"]


def predict_clusters(df: DataFrame, cluster: str, train: DataFrame, label: str) -> DataFrame:
    """Adds the label of each row's cluster; a cluster without training rows gets the overall majority."""
    mapping = settle(cluster_labels(train, cluster, label).select(F.col("cluster").alias("_c"), F.col("label").alias("_l")))
    default = default_label(train, label)
    joined = df.join(mapping, F.col(cluster) == F.col("_c"), "left")
    return joined.withColumn("prediction", F.coalesce("_l", F.lit(default))).drop("_c", "_l")
