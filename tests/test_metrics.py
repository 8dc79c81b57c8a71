import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowbench.operators import metrics, rules
from flowbench.operators.clusters import cluster_labels, predict_clusters
from flowbench.operators.energy import EnergyRule
from flowbench.operators.order import codes, exact_quantiles, most_frequent, running_before
from flowbench.operators.vote import vote_weights, weighted_vote


def counts(spark, tn, fp, fn, tp):
    return spark.createDataFrame([(tn, fp, fn, tp)], "tn long, fp long, fn long, tp long")


def test_binary_metrics(spark):
    row = metrics.binary_metrics(counts(spark, 50, 10, 5, 35)).first()
    assert row["accuracy"] == 0.85 and row["recall"] == 0.875
    assert row["precision"] == 35 / 45 and row["balanced_accuracy"] == (50 / 60 + 0.875) / 2
    assert (row["support_0"], row["support_1"], row["predicted_0"], row["predicted_1"]) == (60, 40, 55, 45)


def test_ratios_without_rows_are_zero(spark):
    row = metrics.binary_metrics(counts(spark, 4, 0, 6, 0)).first()
    assert row["precision"] == 0 and row["f1"] == 0
    empty = metrics.binary_metrics(counts(spark, 0, 0, 0, 0)).first()
    assert empty["accuracy"] == 0 and empty["f1_weighted"] == 0


def test_one_class_truth(spark):
    df = spark.createDataFrame([(1, 1, 0.5)] * 3 + [(1, 0, 0.2)], "t int, p int, s double")
    main = metrics.binary_metrics(metrics.confusion(df, "t", "p")).first()
    assert main["balanced_accuracy"] == 0.75 / 2
    lab = metrics.class_metrics(metrics.class_pairs(df, "t", "p")).first()
    assert lab["balanced_accuracy"] == 0.75
    assert metrics.roc_auc(df, "t", "s").first()[0] is None


def test_confusion_sums_to_rows_and_macro_is_the_mean(spark):
    draw = random.Random(1)
    df = spark.createDataFrame([(draw.choice("abc"), draw.choice("abcd")) for _ in range(500)], "t string, p string")
    pairs = metrics.class_pairs(df, "t", "p")
    assert metrics.confusion_cells(pairs).agg(F.sum("n")).first()[0] == 500
    assert metrics.confusion_cells(pairs).count() == 16
    rows = metrics.per_class(pairs).collect()
    one = metrics.class_metrics(pairs).first()
    assert one["f1_macro"] == pytest.approx(np.mean([r["f1"] for r in rows]))
    table = metrics.confusion_table(pairs).collect()
    assert [r["true_label"] for r in table] == list("abcd") and sum(table[3][1:]) == 0


def auc_by_pairs(rows):
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    return wins / (len(pos) * len(neg))


def test_auc_with_a_hot_score(spark):
    draw = random.Random(2)
    rows = [(draw.random() < 0.4, 0.5 if i % 3 == 0 else round(draw.random(), 2)) for i in range(600)]
    df = spark.createDataFrame([(int(y), s) for y, s in rows], "y int, s double")
    assert metrics.roc_auc(df, "y", "s").first()[0] == pytest.approx(auc_by_pairs(rows), abs=1e-12)
    same = df.withColumn("s", F.lit(0.3))
    assert metrics.roc_auc(same, "y", "s").first()[0] == 0.5


def test_threshold_ties_keep_one_half(spark):
    df = spark.createDataFrame([(1, 0.99), (0, 0.01)], "y int, p double")
    assert metrics.best_threshold(df, "y", "p").first()["threshold"] == 0.5


def test_threshold_takes_the_smallest_better_one(spark):
    df = spark.createDataFrame([(1, 0.30), (1, 0.30), (0, 0.22), (0, 0.95)], "y int, p double")
    # 0.23 to 0.30 give the same best score; 0.50 gives a worse one.
    assert metrics.best_threshold(df, "y", "p").first()["threshold"] == 0.23


def test_threshold_counts_at_exact_borders(spark):
    borders = [v / 100 for v in range(0, 101)]
    df = spark.createDataFrame([(1, b) for b in borders] + [(0, np.nextafter(b, 0).item()) for b in borders], "y int, p double")
    for r in metrics.threshold_counts(df, "y", "p").collect():
        assert r["tp"] == sum(b >= r["threshold"] for b in borders)
        assert r["fp"] == sum(np.nextafter(b, 0) >= r["threshold"] for b in borders)


def test_exact_quantiles_take_both_ways(spark):
    draw = random.Random(3)
    xs = [7.0 if i % 3 == 0 else draw.gauss(0, 50) for i in range(20_000)]
    df = spark.createDataFrame([(x, float(i)) for i, x in enumerate(xs)], "x double, i double").repartition(8)
    df = df.unionByName(spark.createDataFrame([(None, float("nan"))], "x double, i double"))
    qs = [0.0, 0.1, 0.5, 0.55, 0.95, 0.995, 1.0]
    for limit in (10**6, 500, 1):
        got = exact_quantiles(df, {"x": qs, "i": qs}, direct_limit=limit)
        assert got["x"] == pytest.approx(list(np.quantile(xs, qs)), abs=1e-9)
        assert got["i"] == pytest.approx(list(np.quantile(range(20_000), qs)), abs=1e-9)


def test_quantiles_of_nothing(spark):
    assert exact_quantiles(spark.createDataFrame([(None,)], "x double"), {"x": [0.5]}) == {"x": [None]}


def test_running_totals_and_codes(spark):
    df = spark.range(1000).select(F.col("id").alias("v"), (F.col("id") % 7).alias("n")).repartition(5)
    got = {r["v"]: r["before"] for r in running_before(df, "v", {"before": "n"}, ranges=16).collect()}
    total = 0
    for v in range(1000):
        assert got[v] == total
        total += v % 7
    words = ["b", "a", "Z", "é", "ab", "", "a" * 200, "a" * 199]
    found = codes(spark.createDataFrame([(w,) for w in words * 2 + [None]], "w string"), "w")
    assert {r["w"]: r["code"] for r in found.collect()} == {w: i for i, w in enumerate(sorted(words, key=str.encode))}


def test_modes_break_ties_by_text(spark):
    df = spark.createDataFrame([("b", None), ("a", None), ("a", None), ("b", None)], "x string, y string")
    assert most_frequent(df, ["x", "y"]) == {"x": "a", "y": None}


def test_rules_need_their_core_columns(spark):
    with pytest.raises(ValueError, match="flow_bytes_s"):
        rules.with_rules(spark.createDataFrame([(1.0,)], ["total_fwd_packets"]))


def test_syn_rule_without_ack_column(spark):
    base = {"total_fwd_packets": 30.0, "total_bwd_packets": 0.0, "total_fwd_bytes": 1.0, "total_bwd_bytes": 0.0,
            "flow_packets_s": 1.0, "flow_bytes_s": 1.0, "syn_flag_count": 1}
    df = spark.createDataFrame([tuple(base.values())], list(base))
    assert rules.with_rules(df).first()["rule_syn_flood"] is True
    assert rules.with_rules(df.withColumn("ack_flag_count", F.lit(2))).first()["rule_syn_flood"] is False
    assert rules.with_rules(df.withColumn("ack_flag_count", F.lit(None).cast("int"))).first()["rule_syn_flood"] is True


def test_golden_rule_hits(spark):
    from flowbench.plans.queries_metrics import usable_flows

    hits = {r["rule"]: r["hits"] for r in rules.rule_hits(usable_flows(spark, "/root/testdata/sf0.01")).collect()}
    expected = dict(extreme_rate=39, high_rate=267, syn_flood=1317, one_way_flood=358, amplification=103, interarrival_burst=158,
                    regular_small_packet_burst=118, control_packet_flood=65, reset_flood=35, subflow_burst=85, incomplete_tcp_burst=22)
    assert {k: hits[k] for k in expected} == expected


def test_clusters(spark):
    train = spark.createDataFrame([(0, 1), (0, 0), (1, 1), (1, 1), (1, 0)], "c int, y int")
    assert {r["cluster"]: r["label"] for r in cluster_labels(train, "c", "y").collect()} == {0: 0, 1: 1}
    got = predict_clusters(spark.createDataFrame([(0,), (1,), (9,)], "c int"), "c", train, "y").orderBy("c").collect()
    assert [r["prediction"] for r in got] == [0, 1, 1]


def test_energy_at_the_threshold_is_not_flagged(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.5,)], "e double")
    rows = EnergyRule(2.0).score(df, "e").orderBy("e").collect()
    assert [r["prediction"] for r in rows] == [0, 0, 1]
    spread = np.std([1, 2, 2.5]) + 1e-8
    assert rows[2]["probability"] == pytest.approx(1 / (1 + math.exp(-0.5 / spread)))


def test_vote(spark):
    train = spark.createDataFrame([(1, 1, 0), (0, 0, 0), (1, 1, 1), (0, 0, 1)], "y int, good int, bad int")
    weights = vote_weights(train, "y", ["good", "bad"])
    assert weights == {"good": 1.0, "bad": 0.5}
    rows = weighted_vote(spark.createDataFrame([(1, 0), (0, 1)], "good int, bad int"), weights).collect()
    assert [r["prediction"] for r in rows] == [1, 0]
