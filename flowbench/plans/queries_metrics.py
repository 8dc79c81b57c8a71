"""Detectors that SQL can express, evaluation metrics, thresholds and weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowbench.functions.values import class_text, sigmoid
from flowbench.operators import metrics, rules, splits
from flowbench.operators.clusters import cluster_labels, predict_clusters
from flowbench.operators.energy import EnergyRule, energy_summary
from flowbench.operators.vote import vote_weights, weighted_vote
from flowbench.plans.catalog import query
from flowbench.plans.flows import ATTACK_RULE, flows, table
from flowbench.plans.queries_cleaning import COMMON, prepared, round_all
from flowbench.plans.queries_splits import COMMON_SET, DDOS_HOLDOUT, EVENTS, KEY, holdout_steps, ranked_steps
from flowbench.plans.prep import prepare_split
from flowbench.plans.texts import (
    CLASS_TEXT,
    COUNT_NAMES,
    SCORE_NAMES,
    SCORED_COLUMNS,
    STRICT,
    binary_metric_steps,
    on_flows,
    on_prepared,
    ratio,
    rounded,
)

# --- rules -----------------------------------------------------------------------------------------------------

_HIGH = "(flow_packets_s >= 25000 OR b >= 1000000)"
_RULE_SQL = {
    "extreme_rate": "(flow_packets_s >= 100000 OR b >= 10000000)",
    "high_rate": _HIGH,
    "syn_flood": "(syn_flag_count >= 1 AND {ack} AND total_bwd_packets <= 1 AND (flow_packets_s >= 10000 OR total_fwd_packets >= 20))",
    "one_way_flood": "(total_bwd_packets = 0 AND total_fwd_packets >= 20 AND (flow_packets_s >= 5000 OR total_fwd_bytes >= 10000))",
    "amplification": "(total_bwd_packets >= 5 AND total_bwd_bytes >= 5 * (total_fwd_bytes + 1) AND b >= 500000)",
    "interarrival_burst": f"(total_fwd_packets + total_bwd_packets >= 40 AND flow_iat_mean <= 1000 AND flow_iat_std <= 5000 AND {_HIGH})",
    "regular_small_packet_burst": f"(total_fwd_packets + total_bwd_packets >= 40 AND packet_length_mean <= 256 AND packet_length_std <= 25 AND {_HIGH})",
    "control_packet_flood": f"(total_fwd_packets >= 20 AND fwd_act_data_packets <= 1 AND fwd_header_length >= 0.5 * (total_fwd_bytes + 1) AND {_HIGH})",
    "reset_flood": f"(rst_flag_count >= 3 AND total_bwd_packets <= 1 AND {_HIGH})",
    "subflow_burst": f"(subflow_fwd_packets >= 40 AND subflow_bwd_packets <= 1 AND {_HIGH})",
    "incomplete_tcp_burst": f"(syn_flag_count >= 1 AND ack_flag_count = 0 AND psh_flag_count = 0 AND fin_flag_count = 0 AND total_bwd_packets = 0 AND {_HIGH})",
}


def rule_steps(source: str, only_common: bool = False) -> dict[str, str]:
    """Steps ``ruled`` with each rule as a boolean and ``flagged`` with the prediction."""
    optional = ("interarrival_burst", "regular_small_packet_burst", "control_packet_flood", "reset_flood", "subflow_burst", "incomplete_tcp_burst")
    texts = {
        n: "false" if only_common and n in optional else t.format(ack="true" if only_common else "ack_flag_count = 0")
        for n, t in _RULE_SQL.items()
    }
    ruled = f"SELECT *, {', '.join(f'{t} AS {n}' for n, t in texts.items())} FROM (SELECT *, coalesce(flow_bytes_s, 0) AS b FROM {source})"
    strong = " OR ".join(rules.STRONG)
    votes = " + ".join(f"CAST({n} AS INTEGER)" for n in rules.SUPPORTING)
    flagged = f"SELECT *, {votes} AS votes, CASE WHEN {strong} OR {votes} >= 2 THEN 1 ELSE 0 END AS prediction FROM ruled"
    return {"ruled": ruled, "flagged": flagged}


# Flows whose rate is known and finite, with all optional columns.
_USABLE = "SELECT * FROM flows WHERE flow_bytes_s IS NOT NULL AND NOT isinf(flow_bytes_s)"


def usable_flows(spark, sf_dir):
    return flows(spark, sf_dir).where("flow_bytes_s IS NOT NULL AND abs(flow_bytes_s) <> double('Infinity')")


@query(
    "flagship_holdout_rules",
    on_prepared(
        f"SELECT {SCORED_COLUMNS} FROM scored",
        **holdout_steps("class", "ddos"),
        tested="SELECT * FROM parts WHERE part = 'test'",
        **rule_steps("tested", only_common=True),
        counted="SELECT " + ", ".join(
            f"CAST(sum(CASE WHEN label = {t} AND prediction = {p} THEN 1 ELSE 0 END) AS BIGINT) AS {n}" for n, t, p in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))
        ) + " FROM flagged",
        **binary_metric_steps("counted"),
    ),
)
def holdout_rules(spark, sf_dir):
    """Unseen-family evaluation of the fixed rules, end to end."""
    split = prepare_split(flows(spark, sf_dir), EVENTS, COMMON_SET, DDOS_HOLDOUT)
    scored = rules.predict_rules(split.test)
    result = metrics.binary_metrics(metrics.confusion(scored, "label", "prediction"))
    return round_all(result, SCORE_NAMES).select(*COUNT_NAMES, *SCORE_NAMES)


@query("j2_rule_predictions", on_flows("SELECT flow_id, CAST(votes AS INTEGER) AS votes, prediction FROM flagged", **rule_steps("flows")))
def rule_predictions(spark, sf_dir):
    # Null and infinite rates stay in: a null counts as 0, an infinite rate is extreme.
    return rules.with_rules(flows(spark, sf_dir)).select("flow_id", "votes", "prediction")


@query("j2_rules_common_columns", on_flows("SELECT flow_id, prediction FROM flagged", **rule_steps("flows", only_common=True)))
def rules_on_common_columns(spark, sf_dir):
    # Without the ACK column every flow counts as having no ACK, and six rules never fire.
    return rules.predict_rules(flows(spark, sf_dir).select("flow_id", *COMMON)).select("flow_id", "prediction")


@query(
    "e25_rule_hits",
    on_flows(
        " UNION ALL ".join(
            [f"SELECT '{n}' AS rule, CAST(sum(CAST({n} AS INTEGER)) AS BIGINT) AS hits FROM flagged" for n in _RULE_SQL]
            + ["SELECT 'final_predicted_malicious', CAST(sum(prediction) AS BIGINT) FROM flagged"]
        ),
        usable=_USABLE,
        **rule_steps("usable"),
    ),
)
def hits_of_rules(spark, sf_dir):
    return rules.rule_hits(usable_flows(spark, sf_dir))


_CALIBRATED = {
    **ranked_steps("prepared", "flow_id", "CAST(label AS VARCHAR)", "ceil(t * CAST(0.2 AS DOUBLE))"),
    "limits": "SELECT quantile_cont(flow_packets_s, 0.995) AS pr, quantile_cont(flow_bytes_s, 0.995) AS br, quantile_cont(CAST(syn_flag_count AS DOUBLE), 0.99) AS sy, "
    "quantile_cont(total_bwd_packets, 0.1) AS bp, quantile_cont(flow_duration, 0.1) AS du, quantile_cont(total_fwd_packets, 0.99) AS fp FROM placed WHERE place > quota AND label = 0",
    "voted": "SELECT flow_id, label, CAST(flow_packets_s > pr AS INTEGER) + CAST(flow_bytes_s > br AS INTEGER) + CAST(syn_flag_count > sy AND total_bwd_packets <= bp AS INTEGER) "
    "+ CAST(flow_duration <= du AND total_fwd_packets > fp AS INTEGER) AS votes FROM placed, limits WHERE place <= quota",
}


@query("j3_calibrated_rules", on_prepared("SELECT flow_id, label, votes, CASE WHEN votes >= 2 THEN 1 ELSE 0 END AS prediction FROM voted", **_CALIBRATED))
def calibrated_rules(spark, sf_dir):
    parts = splits.random_parts(prepared(spark, sf_dir), KEY, 0.2, 42, "label")
    train, test = (parts.where(F.col("part") == p) for p in ("train", "test"))
    model = rules.CalibratedRules.fit(train)
    return model.score(test).select("flow_id", "label", "votes", "prediction")


# --- binary metrics --------------------------------------------------------------------------------------------

_GUESSED = f"SELECT flow_id, class, {STRICT.format('label')} AS truth, CASE WHEN flow_duration < 0.03 OR urg_flag_count = 1 THEN 1 ELSE 0 END AS prediction FROM flows"
_COUNTED = "SELECT {by}" + ", ".join(
    f"count(CASE WHEN truth = {t} AND prediction = {p} THEN 1 END) AS {n}" for n, t, p in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))
) + " FROM guessed{group}"


def guessed(spark, sf_dir):
    df = flows(spark, sf_dir)
    return df.select(
        "flow_id",
        "class",
        F.expr(STRICT.format("label")).alias("truth"),
        F.expr("CASE WHEN flow_duration < 0.03 OR urg_flag_count = 1 THEN 1 ELSE 0 END").alias("prediction"),
    )


@query("e9_confusion", on_flows(_COUNTED.format(by="", group=""), guessed=_GUESSED))
def confusion_counts(spark, sf_dir):
    return metrics.confusion(guessed(spark, sf_dir), "truth", "prediction")


@query("e10_binary_metrics", on_flows(f"SELECT class, {SCORED_COLUMNS} FROM scored", guessed=_GUESSED, counted=_COUNTED.format(by="class, ", group=" GROUP BY class"), **binary_metric_steps("counted")))
def metrics_by_class(spark, sf_dir):
    # Each class has one kind of truth only, so several denominators are zero.
    counts = metrics.confusion(guessed(spark, sf_dir), "truth", "prediction", by=["class"])
    return round_all(metrics.binary_metrics(counts), SCORE_NAMES).select("class", *COUNT_NAMES, *SCORE_NAMES)


@query("n1_error_rates", on_flows(f"SELECT class, tn, fp, fn, tp, round({ratio('fp', 'fp + tn')}, 6) AS false_alarm_rate, round({ratio('fn', 'fn + tp')}, 6) AS missed_rate FROM counted", guessed=_GUESSED, counted=_COUNTED.format(by="class, ", group=" GROUP BY class")))
def rates_of_errors(spark, sf_dir):
    counts = metrics.confusion(guessed(spark, sf_dir), "truth", "prediction", by=["class"])
    return round_all(metrics.error_rates(counts), ["false_alarm_rate", "missed_rate"])


@query(
    "a6_metrics_record",
    on_flows(
        "SELECT round(accuracy, 6) AS accuracy, round(f1_weighted, 6) AS f1_weighted, concat('[[', tn, ',', fp, '],[', fn, ',', tp, ']]') AS matrix, "
        "concat('{\"0\":', support_0, ',\"1\":', support_1, '}') AS support, concat('{\"0\":', predicted_0, ',\"1\":', predicted_1, '}') AS predicted, '{\"0\":\"benign\",\"1\":\"attack\"}' AS labels FROM scored",
        guessed=_GUESSED,
        counted=_COUNTED.format(by="", group=""),
        **binary_metric_steps("counted"),
    ),
)
def record_of_metrics(spark, sf_dir):
    from flowbench.sources.sinks import json_text

    counts = metrics.confusion(guessed(spark, sf_dir), "truth", "prediction")
    text = json_text(metrics.metrics_record(metrics.binary_metrics(counts)))
    part = lambda path: F.get_json_object("record", path)
    return text.select(
        F.round(part("$.accuracy").cast("double"), 6).alias("accuracy"),
        F.round(part("$.f1_weighted").cast("double"), 6).alias("f1_weighted"),
        part("$.confusion_matrix").alias("matrix"),
        part("$.support").alias("support"),
        part("$.predicted_distribution").alias("predicted"),
        part("$.labels").alias("labels"),
    )


@query(
    "j1_majority_baseline",
    on_prepared(
        f"SELECT {SCORED_COLUMNS} FROM scored",
        **ranked_steps("prepared", "flow_id", "CAST(label AS VARCHAR)", "ceil(t * CAST(0.2 AS DOUBLE))"),
        major="SELECT label AS m FROM placed WHERE place > quota GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1",
        guessed="SELECT label AS truth, m AS prediction FROM placed, major WHERE place <= quota",
        counted=_COUNTED.format(by="", group=""),
        **binary_metric_steps("counted"),
    ),
)
def majority_baseline(spark, sf_dir):
    from flowbench.operators.baseline import MajorityBaseline

    parts = splits.random_parts(prepared(spark, sf_dir), KEY, 0.2, 42, "label")
    model = MajorityBaseline().fit(parts.where("part = 'train'"), COMMON, "label")
    counts = metrics.confusion(model.score(parts.where("part = 'test'")), "label", "prediction")
    return round_all(metrics.binary_metrics(counts), SCORE_NAMES).select(*COUNT_NAMES, *SCORE_NAMES)


# --- several classes -------------------------------------------------------------------------------------------

# A guess from the source and the key; "none" is guessed but never true.
_GUESS = """CASE WHEN dataset_source IS NULL THEN 'none' WHEN dataset_source = 'src0' THEN 'benign' WHEN dataset_source = 'src1' THEN 'bot'
  WHEN flow_duration < 0.05 THEN 'ddos_hoic' ELSE {truth} END"""
_CLASSED = f"SELECT flow_id, truth, {_GUESS.format(truth='truth')} AS predicted FROM (SELECT *, {CLASS_TEXT.format('label')} AS truth FROM flows)"
_PAIRS = "SELECT truth, predicted, count(*) AS n FROM classed GROUP BY 1, 2"
_PER_CLASS = f"""SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2.0 * precision * recall / (precision + recall) END AS f1 FROM
  (SELECT *, {ratio('hits', 'predicted')} AS precision, {ratio('hits', 'support')} AS recall FROM
    (SELECT label, CAST(sum(s) AS BIGINT) AS support, CAST(sum(p) AS BIGINT) AS predicted, CAST(sum(h) AS BIGINT) AS hits FROM
      (SELECT truth AS label, n AS s, 0 AS p, CASE WHEN truth = predicted THEN n ELSE 0 END AS h FROM pairs UNION ALL SELECT predicted, 0, n, 0 FROM pairs) GROUP BY 1))"""
_CLASS_STEPS = {"classed": _CLASSED, "pairs": _PAIRS, "per_class": _PER_CLASS}


def classed(spark, sf_dir):
    df = flows(spark, sf_dir).withColumn("truth", class_text("label"))
    return df.select("flow_id", "truth", F.expr(_GUESS.format(truth="truth")).alias("predicted"))


def pairs_of(spark, sf_dir):
    return metrics.class_pairs(classed(spark, sf_dir), "truth", "predicted")


@query(
    "e11_class_confusion",
    on_flows("SELECT a.l AS truth, b.l AS predicted, coalesce(n, 0) AS n FROM ls a CROSS JOIN ls b LEFT JOIN pairs ON truth = a.l AND predicted = b.l", **_CLASS_STEPS, ls="SELECT truth AS l FROM pairs UNION SELECT predicted FROM pairs"),
)
def class_confusion(spark, sf_dir):
    return metrics.confusion_cells(pairs_of(spark, sf_dir))


_CLASSES = ("benign", "bot", "ddos_hoic", "ddos_loic_http", "none")


@query(
    "a7_confusion_table",
    on_flows(
        "SELECT l AS true_label, " + ", ".join(f"CAST(coalesce(sum(CASE WHEN predicted = '{c}' THEN n END), 0) AS BIGINT) AS pred_{c}" for c in _CLASSES) + " FROM ls LEFT JOIN pairs ON truth = l GROUP BY 1",
        **_CLASS_STEPS,
        ls="SELECT truth AS l FROM pairs UNION SELECT predicted FROM pairs",
    ),
)
def wide_confusion(spark, sf_dir):
    return metrics.confusion_table(pairs_of(spark, sf_dir))


_MACRO = ("precision", "recall", "f1")


@query(
    "e12_class_metrics",
    on_flows(
        "SELECT round(sum(hits) / CAST(sum(support) AS DOUBLE), 6) AS accuracy, round(avg(CASE WHEN support > 0 THEN recall END), 6) AS balanced_accuracy, "
        + ", ".join(f"round(avg({c}), 6) AS {c}_macro" for c in _MACRO) + ", " + ", ".join(f"round(sum({c} * support) / sum(support), 6) AS {c}_weighted" for c in _MACRO)
        + ", count(CASE WHEN support > 0 THEN 1 END) AS num_classes_true, count(CASE WHEN predicted > 0 THEN 1 END) AS num_classes_pred FROM per_class",
        **_CLASS_STEPS,
    ),
)
def metrics_of_classes(spark, sf_dir):
    names = ["accuracy", "balanced_accuracy", *[f"{c}_{k}" for c in _MACRO for k in ("macro", "weighted")]]
    return round_all(metrics.class_metrics(pairs_of(spark, sf_dir)), names)


@query(
    "e13_class_report",
    on_flows(
        f"SELECT label, {rounded(_MACRO)}, support FROM per_class UNION ALL SELECT 'macro avg', " + ", ".join(f"round(avg({c}), 6)" for c in _MACRO) + ", CAST(sum(support) AS BIGINT) FROM per_class "
        "UNION ALL SELECT 'weighted avg', " + ", ".join(f"round(sum({c} * support) / sum(support), 6)" for c in _MACRO) + ", CAST(sum(support) AS BIGINT) FROM per_class "
        "UNION ALL SELECT 'accuracy', a, a, a, s FROM (SELECT round(sum(hits) / CAST(sum(support) AS DOUBLE), 6) AS a, CAST(sum(support) AS BIGINT) AS s FROM per_class)",
        **_CLASS_STEPS,
    ),
)
def report_of_classes(spark, sf_dir):
    return round_all(metrics.class_report(pairs_of(spark, sf_dir)), _MACRO)


# --- area under the curve ----------------------------------------------------------------------------------------


def auc_sql(source: str, truth: str, score: str) -> str:
    return (
        f"SELECT round((sum(CASE WHEN y = 1 THEN r END) - count(CASE WHEN y = 1 THEN 1 END) * (count(CASE WHEN y = 1 THEN 1 END) + 1) / 2.0) / "
        f"(CAST(count(CASE WHEN y = 1 THEN 1 END) AS DOUBLE) * count(CASE WHEN y = 0 THEN 1 END)), 9) AS roc_auc FROM "
        f"(SELECT {truth} AS y, rank() OVER (ORDER BY {score}) + (count(*) OVER (PARTITION BY {score}) - 1) / 2.0 AS r FROM {source})"
    )


@query("e14_roc_auc", on_prepared(auc_sql("prepared", "label", "flow_bytes_s")))
def area_under_curve(spark, sf_dir):
    return round_all(metrics.roc_auc(prepared(spark, sf_dir), "label", "flow_bytes_s"), ["roc_auc"], 9)


@query("e14_roc_auc_with_ties", auc_sql("lineitem", "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END", "l_quantity"))
def area_with_ties(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y"), "l_quantity"
    )
    return round_all(metrics.roc_auc(df, "y", "l_quantity"), ["roc_auc"], 9)


@query("f5_auc_of_many_scores", auc_sql("lineitem", "CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END", "l_extendedprice"))
def area_of_many_scores(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_linestatus") == "O", 1).otherwise(0).alias("y"), "l_extendedprice"
    )
    return round_all(metrics.roc_auc(df, "y", "l_extendedprice"), ["roc_auc"], 9)


_PROBABILITIES = """SELECT class AS truth, ack_flag_count / CAST(100 AS DOUBLE) AS p_benign, flow_duration * 10 AS p_ddos, rst_flag_count / CAST(5 AS DOUBLE) AS p_botnet FROM {flows}"""


def _one_area(name: str, column: str) -> str:
    return auc_sql("probs", f"CASE WHEN truth = '{name}' THEN 1 ELSE 0 END", column)


@query(
    "e15_roc_auc_ovr",
    on_flows(
        f"SELECT round(avg(roc_auc), 6) AS roc_auc FROM ({_one_area('Benign', 'p_benign')} UNION ALL {_one_area('DDoS', 'p_ddos')} UNION ALL {_one_area('Botnet', 'p_botnet')})",
        probs=_PROBABILITIES.format(flows="flows"),
    ),
)
def area_one_versus_rest(spark, sf_dir):
    df = spark.sql(_PROBABILITIES, flows=flows(spark, sf_dir))
    scores = {"Benign": "p_benign", "DDoS": "p_ddos", "Botnet": "p_botnet"}
    return round_all(metrics.roc_auc_ovr(df, "truth", scores), ["roc_auc"])


# --- thresholds --------------------------------------------------------------------------------------------------

# A score that grows with the rate, on a label the rate explains in part. Some scores are null, some are not a number: both pass
# no threshold.
_SCORED = f"SELECT flow_id, CASE {ATTACK_RULE} WHEN 'Attack' THEN 1 ELSE 0 END AS truth, CASE WHEN flow_id % 53 = 0 THEN NULL WHEN flow_id % 59 = 0 THEN CAST('NaN' AS DOUBLE) ELSE least(1.0, flow_packets_s / 8000 + (flow_id % 7) * CAST(0.03 AS DOUBLE)) END AS p FROM {{flows}}"
_PASSES = "coalesce(p >= {} AND NOT isnan(p), false)"


def scored(spark, sf_dir):
    text = _SCORED.replace("least(1.0,", "least(1D,").replace("{flows}", "{f}")
    return spark.sql(text, f=flows(spark, sf_dir))


_SWEEP_STEPS = {
    "scored_rows": _SCORED.format(flows="flows").replace("least(1.0,", "least(CAST(1 AS DOUBLE),"),
    "sweep": "SELECT v, v / CAST(100 AS DOUBLE) AS threshold, " + ", ".join(
        f"count(CASE WHEN truth = {t} AND {_PASSES.format('v / CAST(100 AS DOUBLE)')} = {p} THEN 1 END) AS {n}"
        for n, t, p in (("tn", 0, "false"), ("fp", 0, "true"), ("fn", 1, "false"), ("tp", 1, "true"))
    ) + " FROM scored_rows, generate_series(5, 95) g(v) GROUP BY v",
}


@query("d7_threshold_counts", on_flows("SELECT threshold, tn, fp, fn, tp FROM sweep", **_SWEEP_STEPS))
def counts_at_thresholds(spark, sf_dir):
    return metrics.threshold_counts(scored(spark, sf_dir), "truth", "p").select("threshold", "tn", "fp", "fn", "tp")


@query(
    "e26_best_threshold",
    on_flows(
        f"SELECT threshold, tn, fp, fn, tp, round(f1, 6) AS f1, round(balanced_accuracy, 6) AS balanced_accuracy FROM scored ORDER BY scored.f1 DESC, scored.balanced_accuracy DESC, CASE WHEN v = 50 THEN 0 ELSE 1 END, threshold LIMIT 1",
        **_SWEEP_STEPS,
        **binary_metric_steps("sweep"),
    ),
)
def threshold_choice(spark, sf_dir):
    best = metrics.best_threshold(scored(spark, sf_dir), "truth", "p")
    return round_all(best.select("threshold", "tn", "fp", "fn", "tp", "f1", "balanced_accuracy"), ["f1", "balanced_accuracy"])


@query(
    "j19_two_thresholds",
    on_flows(
        " UNION ALL ".join(
            f"SELECT '{rule}' AS rule, " + ", ".join(f"count(CASE WHEN truth = {t} AND {_PASSES.format(f'{limit}::DOUBLE')} = {p} THEN 1 END) AS {n}" for n, t, p in (("tn", 0, "false"), ("fp", 0, "true"), ("fn", 1, "false"), ("tp", 1, "true"))) + " FROM scored_rows"
            for rule, limit in (("chosen", 0.4), ("default", 0.5))
        ),
        **_SWEEP_STEPS,
    ),
)
def two_thresholds(spark, sf_dir):
    df = metrics.apply_threshold(scored(spark, sf_dir), "p", 0.4)
    both = df.select(
        "truth",
        F.inline(
            F.array(
                F.struct(F.lit("chosen").alias("rule"), F.col("prediction").alias("guess")),
                F.struct(F.lit("default").alias("rule"), F.col("default_prediction").alias("guess")),
            )
        ),
    )
    return metrics.confusion(both, "truth", "guess", by=["rule"]).select("rule", "tn", "fp", "fn", "tp")


@query("h_sigmoid", on_flows("SELECT flow_id, round(1 / (1 + exp(-(flow_packets_s - 3000) / 1000)), 6) AS p FROM flows"))
def sigmoid_scores(spark, sf_dir):
    x = (F.col("flow_packets_s") - 3000) / 1000
    return flows(spark, sf_dir).select("flow_id", F.round(sigmoid(x), 6).alias("p"))


# --- clusters, energies, votes -----------------------------------------------------------------------------------

_ASSIGNED = f"SELECT flow_id, {STRICT.format('label')} AS y, CAST(floor(flow_packets_s / 400) AS INTEGER) AS cluster FROM flows"
_MAPPING = "SELECT cluster, y AS label FROM (SELECT cluster, y, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, y) AS r FROM assigned WHERE flow_id % 5 <> 0 GROUP BY 1, 2) WHERE r = 1"


def _assigned(spark, sf_dir):
    return flows(spark, sf_dir).select(
        "flow_id", F.expr(STRICT.format("label")).alias("y"), F.floor(F.col("flow_packets_s") / 400).cast("int").alias("cluster")
    )


@query("e28_cluster_labels", on_flows("SELECT cluster, y AS label, n FROM (SELECT cluster, y, count(*) AS n, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, y) AS r FROM assigned GROUP BY 1, 2) WHERE r = 1", assigned=_ASSIGNED))
def labels_of_clusters(spark, sf_dir):
    return cluster_labels(_assigned(spark, sf_dir), "cluster", "y")


@query(
    "d6_cluster_predictions",
    on_flows("SELECT flow_id, coalesce(m.label, (SELECT y FROM assigned WHERE cluster < 300 GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS prediction FROM assigned LEFT JOIN mapping m USING (cluster)", assigned=_ASSIGNED, mapping=_MAPPING.replace("WHERE flow_id % 5 <> 0", "WHERE cluster < 300")),
)
def predictions_of_clusters(spark, sf_dir):
    # Clusters at and above 300 occur in scoring only and get the default label.
    df = _assigned(spark, sf_dir)
    seen = df.where("cluster < 300")
    return predict_clusters(df, "cluster", seen, "y").select("flow_id", "prediction")


_ENERGY = f"SELECT flow_id, {STRICT.format('label')} AS y, CASE WHEN flow_id % 4 = 0 THEN 'test' ELSE 'train' END AS part, (flow_duration - 0.05) * (flow_duration - 0.05) * 100 + total_bwd_packets / 50 AS energy FROM flows"
_ENERGY_STEPS = {
    "energies": _ENERGY.replace("0.05", "CAST(0.05 AS DOUBLE)"),
    "limit_row": "SELECT quantile_cont(energy, 0.95) AS t FROM energies WHERE part = 'train' AND y = 0",
    "spread": "SELECT stddev_pop(energy) + CAST(0.00000001 AS DOUBLE) AS s FROM energies WHERE part = 'test'",
}


def _energies(spark, sf_dir):
    text = _ENERGY.replace("0.05", "CAST(0.05 AS DOUBLE)").replace("FROM flows", "FROM {f}")
    return spark.sql(text, f=flows(spark, sf_dir))


@query("j17_energy_flags", on_flows("SELECT flow_id, CASE WHEN energy > t THEN 1 ELSE 0 END AS prediction, round(1 / (1 + exp(-(energy - t) / s)), 6) AS probability FROM energies, limit_row, spread WHERE part = 'test'", **_ENERGY_STEPS))
def energy_flags(spark, sf_dir):
    df = _energies(spark, sf_dir)
    rule = EnergyRule.fit(df.where("part = 'train' AND y = 0"), "energy")
    out = rule.score(df.where("part = 'test'"), "energy")
    return round_all(out.select("flow_id", "prediction", "probability"), ["probability"])


@query("e29_energy_summary", on_flows("SELECT part, round(avg(energy), 6) AS mean, round(stddev_pop(energy), 6) AS std, count(*) AS n FROM energies WHERE part = 'test' OR y = 0 GROUP BY 1", **_ENERGY_STEPS))
def summary_of_energies(spark, sf_dir):
    return round_all(energy_summary(_energies(spark, sf_dir).where("part = 'test' OR y = 0"), "part", "energy"), ["mean", "std"])


_BALLOTS = f"SELECT flow_id, {STRICT.format('label')} AS truth, CASE WHEN flow_id % 3 = 0 THEN 'test' ELSE 'train' END AS part, CASE WHEN flow_duration < 0.03 THEN 1 ELSE 0 END AS a, CASE WHEN syn_flag_count > 1 THEN 1 ELSE 0 END AS b, CASE WHEN total_fwd_packets > 40 THEN 1 ELSE 0 END AS c FROM flows"


@query(
    "n7_weighted_vote",
    on_flows(
        "SELECT flow_id, CASE WHEN a * wa + b * wb + c * wc > (1 - a) * wa + (1 - b) * wb + (1 - c) * wc THEN 1 ELSE 0 END AS prediction FROM ballots, "
        "(SELECT avg(CAST(a = truth AS INTEGER)) AS wa, avg(CAST(b = truth AS INTEGER)) AS wb, avg(CAST(c = truth AS INTEGER)) AS wc FROM ballots WHERE part = 'train') WHERE part = 'test'",
        ballots=_BALLOTS,
    ),
)
def vote_of_detectors(spark, sf_dir):
    df = spark.sql(_BALLOTS.replace("FROM flows", "FROM {f}"), f=flows(spark, sf_dir))
    weights = vote_weights(df.where("part = 'train'"), "truth", ["a", "b", "c"])
    return weighted_vote(df.where("part = 'test'"), weights).select("flow_id", "prediction")


@query("n4_correlations", on_prepared(" UNION ALL ".join(f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", round(corr({a}, {b}), 6) AS corr FROM prepared" for i, a in enumerate(COMMON) for b in COMMON[i + 1 :])))
def correlations(spark, sf_dir):
    from flowbench.operators.encode import correlation

    return round_all(correlation(prepared(spark, sf_dir), COMMON), ["corr"])


_SOURCES = "SELECT src_host, count(*) AS flagged, round(max(flow_packets_s), 6) AS top_rate FROM flagged WHERE prediction = 1 GROUP BY 1"


@query("n9_sources_to_drop", on_flows(_SOURCES, **rule_steps("flows")))
def sources_to_drop(spark, sf_dir):
    flagged = rules.predict_rules(flows(spark, sf_dir)).where("prediction = 1")
    return flagged.groupBy("src_host").agg(F.count("*").alias("flagged"), F.round(F.max("flow_packets_s"), 6).alias("top_rate"))
