"""Edge inputs that the given tables do not hold: huge counts, odd scores, tied scores, long shared prefixes."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from flowbench.functions.values import utc_micros
from flowbench.operators import metrics, order, splits
from flowbench.session import settled
from flowbench.streaming import streams


@pytest.mark.parametrize("n", [10**12, 4 * 10**14])
def test_quotas_of_huge_tables_are_exact(spark, n):
    strata = spark.createDataFrame([("a", n), ("b", 2 * n + 1), ("c", 7)], "stratum string, n long")
    total = n // 5 + 3
    rows = {r["stratum"]: r["quota"] for r in splits.share_rows(strata, F.lit(total)).collect()}
    everything = 3 * n + 8
    whole = {"a": total * n // everything, "b": total * (2 * n + 1) // everything, "c": total * 7 // everything}
    assert sum(rows.values()) == total
    assert all(0 <= rows[s] - whole[s] <= 1 for s in rows)
    capped = splits.share_rows(strata, F.lit(10**8)).agg(F.sum("quota")).first()[0]
    assert capped == 10**8


def test_null_and_nan_scores_pass_no_threshold(spark):
    rows = [(1, 0.9), (0, None), (1, None), (0, math.nan), (1, math.nan), (0, 0.1), (1, -math.inf), (0, math.inf)]
    df = spark.createDataFrame(rows, "y int, p double")
    for r in metrics.threshold_counts(df, "y", "p").collect():
        passed = [(y, p is not None and not math.isnan(p) and p >= r["threshold"]) for y, p in rows]
        assert (r["tp"], r["fp"]) == (passed.count((1, True)), passed.count((0, True)))
        assert (r["fn"], r["tn"]) == (passed.count((1, False)), passed.count((0, False)))
    found = [(r["prediction"], r["default_prediction"]) for r in metrics.apply_threshold(df, "p", 0.05).collect()]
    assert found == [(1, 1), (0, 0), (0, 0), (0, 0), (0, 0), (1, 0), (0, 0), (1, 1)]


def test_ranges_of_tied_scores_are_balanced(spark):
    """Almost all rows have one score; the ranges are cut by distinct scores all the same."""
    df = spark.range(200_000).select(
        (F.col("id") % 2).alias("y"), F.when(F.col("id") % 20 != 0, 0.0).otherwise(F.col("id") / 200_000).alias("p")
    )
    tallies = df.groupBy("p").agg(F.count("*").alias("n"))
    sizes = [r["count"] for r in order.with_range(tallies, "p").groupBy("_range").count().collect()]
    assert max(sizes) <= 0.02 * sum(sizes)
    area = metrics.roc_auc(df, "y", "p").first()[0]
    local = df.toPandas().sort_values("p")
    ranks = local["p"].rank()
    pos = int(local["y"].sum())
    want = (ranks[local["y"] == 1].sum() - pos * (pos + 1) / 2) / (pos * (len(local) - pos))
    assert area == pytest.approx(want)


def test_ranges_of_texts_with_a_long_shared_prefix(spark):
    stem = "https://host.example/" + "segment/" * 8
    df = spark.range(50_000).select(F.concat(F.lit(stem), F.col("id").cast("string")).alias("t"))
    sizes = [r["count"] for r in order.with_range(df, "t").groupBy("_range").count().collect()]
    assert max(sizes) <= 0.02 * sum(sizes)
    found = order.codes(df, "t").orderBy("code").collect()
    assert [r["t"] for r in found] == sorted(stem + str(i) for i in range(50_000))
    assert [r["code"] for r in found] == list(range(50_000))


def test_percentile_bound_holds_for_all_columns_together(spark):
    df = spark.range(3000).select(*[(F.col("id") * (i + 1)).cast("double").alias(f"c{i}") for i in range(4)])
    wanted = {f"c{i}": [0.25, 0.9] for i in range(4)}
    assert order.exact_quantiles(df, wanted, direct_limit=5000) == order.exact_quantiles(df, wanted)


def test_numbers_beyond_64_bits_are_no_time(spark):
    df = spark.createDataFrame([(1.7e18,), (1.7e9,), (None,)], "t double")
    assert [r[0] for r in df.select(utc_micros("t", df.schema["t"].dataType)).collect()] == [None, 1_700_000_000_000_000, None]


def test_event_time_honours_the_zone(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ'2024-01-01 09:00:00' AS a, '2024-01-01 09:00:00' AS b, '2024-01-01T09:00:00Z' AS c, TIMESTAMP'2024-01-01 09:00:00Z' AS d")
    nine = int(datetime.datetime(2024, 1, 1, 9, tzinfo=datetime.timezone.utc).timestamp())
    for column, utc, tokyo in (("a", nine, nine - 9 * 3600), ("b", nine, nine - 9 * 3600), ("c", nine, nine), ("d", nine, nine)):
        for zone, want in (("UTC", utc), ("Asia/Tokyo", tokyo)):
            assert streams.event_time(df, column, zone).select(F.unix_seconds(column)).first()[0] == want


def test_settled_counts_bytes_too(spark):
    texts = spark.range(20).select(F.repeat(F.lit("x"), 1000).alias("t"))
    small, n = settled(texts)
    assert n == 20 and "hint" in small._jdf.queryExecution().logical().toString().lower()
    large, n = settled(texts, max_bytes=5000)
    assert n == 20 and "hint" not in large._jdf.queryExecution().logical().toString().lower()
    assert large.count() == 20


def test_learnable_rows_are_written_once_and_dealt_over_the_cores(spark, sf_dir):
    from flowbench.plans.queries_learners import learnable_parts

    train, test = learnable_parts(spark, sf_dir)
    assert "from_json" not in train._jdf.queryExecution().toString() and "get_json_object" not in test._jdf.queryExecution().toString()
    assert spark.read.parquet(f"{sf_dir}/events.parquet").rdd.getNumPartitions() < spark.sparkContext.defaultParallelism
    from flowbench.session import spread

    kept = spread(spark.range(1000).coalesce(1), "test-spread")
    assert len(kept.inputFiles()) == spark.sparkContext.defaultParallelism and sorted(r[0] for r in kept.collect()) == list(range(1000))


def test_rows_of_a_task_are_one_block(spark):
    from flowbench.operators.blocks import Blocks

    df = spark.range(30_000).repartition(8)
    blocks = Blocks.of(df, [F.col("id")], {"y": F.col("id") % 2})
    sizes = blocks.rdd.map(lambda b: len(b["x"])).collect()
    assert sum(sizes) == 30_000 and len(sizes) == blocks.rdd.getNumPartitions() == 2
    blocks.release()


def test_neighbours_found_for_a_row_do_not_carry_its_cells(spark, monkeypatch):
    """Candidates come with the number of their row, tables between the steps are Parquet, and two rows of one hash stay apart."""
    from pyspark.sql import functions as F

    from flowbench.operators import neighbours

    schemas, plain = [], neighbours.FittedNeighbours._met
    monkeypatch.setattr(neighbours.FittedNeighbours, "_met", lambda self, visits, pick, schema: schemas.append(schema) or plain(self, visits, pick, schema))
    monkeypatch.setattr(neighbours.F, "xxhash64", lambda *c: F.lit(0).cast("bigint"))
    rows = spark.range(60).selectExpr("id", "cast(id % 20 as double) as a", "cast(id % 20 >= 10 as int) as y")
    fitted = neighbours.NearestNeighbours(k=3).fit(rows, ["a"], "y")
    assert fitted.train.inputFiles()
    assert fitted.score(rows).where("prediction <> y").count() == 0 and len(schemas) == 2 and not any("array" in s for s in schemas)
