"""Labels, cleaning, projection and feature preparation over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowbench.functions.names import in_feature_order
from flowbench.functions.values import (
    class_text,
    clock_text,
    complete_rows,
    finite_or_null,
    lenient_label,
    or_token,
    same_group,
    short_duration,
    strict_label,
    utc_micros,
    with_rates,
)
from flowbench.operators import encode
from flowbench.operators.order import codes, exact_quantiles, most_frequent
from flowbench.operators.select import features_and_label, final_projection, merged_drops, resolve_features
from flowbench.plans.catalog import query
from flowbench.plans.flows import flows, table
from flowbench.plans.texts import CLASS_TEXT, FEATURE_LIST, LENIENT, STRICT, on_flows, on_prepared
from flowbench.specs import ALL_NUMERIC, COMMON_FEATURES, DatasetSpec, FeatureSet, SplitSpec
from flowbench.session import few_rows

COMMON = list(COMMON_FEATURES)


def prepared(spark, sf_dir):
    """Complete rows of the common features with a strict 0/1 label, the raw label, key and groups."""
    df = flows(spark, sf_dir).select(
        "flow_id", "class", F.col("label").alias("original_label"), "dataset_source", strict_label("label").alias("label"), *COMMON
    )
    return complete_rows(df, COMMON, "label")


def round_all(df, names, digits=6):
    return df.withColumns({n: F.round(F.col(n), digits) for n in names})


# --- labels ----------------------------------------------------------------------------------------------------

# Raw labels of several shapes: padded, upper case, numbers as text, and unknown words.
_RAW = """CASE event_type WHEN 'click' THEN ' Benign ' WHEN 'view' THEN 'NORMAL' WHEN 'signup' THEN '0'
  WHEN 'error' THEN 'Legitimate' ELSE 'DDoS-LOIC HTTP' END"""


def _raw_labels(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.expr(_RAW).alias("raw"), "value")


@query("b14_strict_label", f"SELECT raw, {STRICT.format('raw')} AS label, count(*) AS n FROM (SELECT {_RAW} AS raw FROM events) GROUP BY 1, 2")
def strict_labels(spark, sf_dir):
    return _raw_labels(spark, sf_dir).groupBy("raw", strict_label("raw").alias("label")).agg(F.count("*").alias("n"))


@query("b14_strict_label_of_floats", "SELECT toxic, CASE WHEN toxic IS NULL THEN NULL ELSE 1 END AS label, count(*) AS n FROM (SELECT CAST(toxic AS DOUBLE) AS toxic FROM labels) GROUP BY 1, 2")
def strict_label_of_floats(spark, sf_dir):
    # A float zero reads "0.0", which is no benign text.
    df = table(spark, sf_dir, "labels").select(F.col("toxic").cast("double").alias("toxic"))
    return df.groupBy("toxic", strict_label("toxic").alias("label")).agg(F.count("*").alias("n"))


_RAW_OR_NULL = f"CASE WHEN event_id % 13 = 0 THEN NULL ELSE {_RAW} END"


@query(
    "b15_lenient_label",
    f"SELECT raw, CASE WHEN raw IS NULL THEN 'attack' ELSE {LENIENT.format('raw')} END AS label, count(*) AS n FROM (SELECT {_RAW_OR_NULL} AS raw FROM events) GROUP BY 1, 2",
)
def lenient_labels(spark, sf_dir):
    df = table(spark, sf_dir, "events").select(F.expr(_RAW_OR_NULL).alias("raw"))
    return df.groupBy("raw", lenient_label("raw").alias("label")).agg(F.count("*").alias("n"))


@query("b16_class_text", f"SELECT {CLASS_TEXT.format('raw')} AS class_name, count(*) AS n FROM (SELECT {_RAW_OR_NULL} AS raw FROM events) GROUP BY 1")
def class_texts(spark, sf_dir):
    df = table(spark, sf_dir, "events").select(F.expr(_RAW_OR_NULL).alias("raw"))
    return df.groupBy(class_text("raw").alias("class_name")).agg(F.count("*").alias("n"))


@query("b17_original_label", on_flows(f"SELECT original_label, label, count(*) AS n FROM (SELECT label AS original_label, {STRICT.format('label')} AS label FROM flows) GROUP BY 1, 2"))
def original_labels(spark, sf_dir):
    df = flows(spark, sf_dir).withColumn("original_label", F.col("label")).withColumn("label", strict_label("label"))
    return df.groupBy("original_label", "label").agg(F.count("*").alias("n"))


@query(
    "b18_label_codes",
    on_flows(
        "SELECT label, CAST(dense_rank() OVER (ORDER BY label) - 1 AS BIGINT) AS code, n FROM (SELECT label, count(*) AS n FROM named GROUP BY 1)",
        named=f"SELECT {CLASS_TEXT.format('label')} AS label FROM flows",
    ),
)
def coded_labels(spark, sf_dir):
    named = flows(spark, sf_dir).select(class_text("label").alias("label"))
    mapping = encode.label_codes(named)
    return named.groupBy("label").agg(F.count("*").alias("n")).join(mapping, "label").select(
        "label", F.col("code").cast("bigint").alias("code"), "n"
    )


@query(
    "b18_binary_codes",
    on_flows(f"SELECT label, CASE label WHEN 'attack' THEN CAST(0 AS BIGINT) ELSE CAST(1 AS BIGINT) END AS code, count(*) AS n FROM (SELECT {LENIENT.format('label')} AS label FROM flows) GROUP BY 1, 2"),
)
def binary_codes(spark, sf_dir):
    df = flows(spark, sf_dir).select("label")
    train, _, _ = encode.encode_labels(df, df, "label", "binary")
    return train.groupBy(F.col("class_name").alias("label"), F.col("label_code").cast("bigint").alias("code")).agg(F.count("*").alias("n"))


@query("b19_same_group", on_flows("SELECT lower(trim(label)) = 'ddos-loic-http' AS held, count(*) AS n FROM flows GROUP BY 1"))
def group_matches(spark, sf_dir):
    return flows(spark, sf_dir).groupBy(same_group("label", " DDoS-LOIC-HTTP").alias("held")).agg(F.count("*").alias("n"))


# --- times -----------------------------------------------------------------------------------------------------

_STAMPED = """SELECT event_id, CASE WHEN event_id % 17 = 0 THEN NULL ELSE CAST(user_id AS DOUBLE) + 0.5 END AS epoch_s,
  CASE WHEN event_id % 19 = 0 THEN 'not a time' WHEN event_id % 3 = 0 THEN concat(CAST(CAST(ts AS DATE) AS {S}), 'T08:15:30+02:00')
       WHEN event_id % 3 = 1 THEN concat(CAST(CAST(ts AS DATE) AS {S}), ' 06:15:30') ELSE CAST(CAST(ts AS DATE) AS {S}) END AS text_time, ts
FROM {events}"""


@query(
    "b20_utc_times",
    """SELECT event_id, CAST(round(epoch_s * 1000000) AS BIGINT) AS epoch_us, epoch_us(ts) AS ts_us,
      CASE WHEN event_id % 19 = 0 THEN NULL WHEN event_id % 3 = 2 THEN epoch_us(date_trunc('day', ts)) ELSE epoch_us(date_trunc('day', ts)) + 22530000000 END AS text_us
      FROM ("""
    + _STAMPED.replace("{S}", "VARCHAR").replace("{events}", "events")
    + ")",
)
def utc_times(spark, sf_dir):
    df = spark.sql(_STAMPED.replace("{S}", "STRING"), events=table(spark, sf_dir, "events"))
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return df.select(
        "event_id",
        utc_micros("epoch_s", kinds["epoch_s"]).alias("epoch_us"),
        utc_micros("ts", kinds["ts"]).alias("ts_us"),
        utc_micros("text_time", kinds["text_time"]).alias("text_us"),
    )


@query("b21_missing_token", on_flows("SELECT coalesce(dataset_source, '<missing>') AS value, coalesce(dataset_source, 'missing') AS lab_value, count(*) AS n FROM flows GROUP BY 1, 2"))
def missing_tokens(spark, sf_dir):
    df = flows(spark, sf_dir)
    return df.groupBy(or_token("dataset_source").alias("value"), or_token("dataset_source", "missing").alias("lab_value")).agg(F.count("*").alias("n"))


# --- projection and cleaning -----------------------------------------------------------------------------------

_ZEROED = ", ".join(
    f"CASE WHEN {c} IS NULL OR isinf({c}) THEN 0.0 ELSE {c} END AS {c}" if c == "flow_bytes_s" else f"CAST({c} AS DOUBLE) AS {c}"
    for c in COMMON
)


@query("b5_features_and_label", on_flows(f"SELECT {_ZEROED}, flow_id AS label FROM (SELECT * EXCLUDE (label) FROM flows)"))
def scoring_input(spark, sf_dir):
    # The key stands in for the label, so that every row can be told apart in the comparison.
    df = flows(spark, sf_dir).drop("label").withColumnRenamed("flow_id", "label")
    return features_and_label(df, COMMON, "label").withColumn("label", F.col("label").cast("bigint"))


@query("b6_without_columns", on_flows("SELECT * EXCLUDE (label, class, flow_start_ts) FROM flows"))
def without_columns(spark, sf_dir):
    return encode.without(flows(spark, sf_dir), "label", ["class", "flow_start_ts", "not_there"])


_NUMERIC_LEFT = (
    *COMMON[:9], "syn_flag_count", "urg_flag_count", "ack_flag_count", "rst_flag_count", "psh_flag_count", "fin_flag_count", "flow_iat_mean",
    "flow_iat_std", "packet_length_mean", "packet_length_std", "fwd_header_length", "fwd_act_data_packets",
)


@query(
    "b7_resolved_features",
    on_flows(" UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({i} AS BIGINT) AS place, count({c}) AS filled FROM flows" for i, c in enumerate(_NUMERIC_LEFT))),
)
def resolved_features(spark, sf_dir):
    df = flows(spark, sf_dir)
    dataset = DatasetSpec("events", drop=("Flow_ID", "src_host"))
    split = SplitSpec("all", drop=("subflow_fwd_packets", "subflow_bwd_packets", "src_host"))
    features = resolve_features(df, FeatureSet("all_numeric", ALL_NUMERIC), merged_drops(dataset, split), "label")
    counts = df.agg(*[F.count(c).alias(c) for c in features])
    cells = [
        F.struct(F.lit(c).alias("feature"), F.lit(i).cast("bigint").alias("place"), F.col(c).alias("filled"))
        for i, c in enumerate(features)
    ]
    return counts.select(F.inline(F.array(*cells)))


@query("b8_final_projection", on_flows(f"SELECT {FEATURE_LIST}, class, flow_id, label FROM flows"))
def projected(spark, sf_dir):
    return final_projection(flows(spark, sf_dir), [*COMMON, "flow_duration"], "label", ["class", "flow_id", "class"])


_TEXT_CELL = """CASE WHEN event_id % 7 = 0 THEN 'n/a' WHEN event_id % 11 = 0 THEN 'inf' WHEN event_id % 13 = 0 THEN NULL
  ELSE CAST(CAST(user_id AS DOUBLE) / 4 AS {S}) END"""


@query("b9_numbers_from_text", "SELECT event_id, CASE WHEN isinf(x) THEN NULL ELSE x END AS x FROM (SELECT event_id, TRY_CAST(" + _TEXT_CELL.replace("{S}", "VARCHAR") + " AS DOUBLE) AS x FROM events)")
def numbers_from_text(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    return df.select("event_id", finite_or_null(F.expr(_TEXT_CELL.replace("{S}", "STRING"))).alias("x"))


@query(
    "b10_complete_rows",
    on_flows(
        f"SELECT class, count(*) AS source_rows, count(CASE WHEN flow_bytes_s IS NOT NULL AND NOT isinf(flow_bytes_s) THEN 1 END) AS kept, "
        "count(*) - count(CASE WHEN flow_bytes_s IS NOT NULL AND NOT isinf(flow_bytes_s) THEN 1 END) AS dropped FROM flows GROUP BY 1"
    ),
)
def complete_row_counts(spark, sf_dir):
    df = flows(spark, sf_dir)
    kept = complete_rows(df, COMMON, "label").select("class", F.lit(0).alias("raw"), F.lit(1).alias("kept"))
    both = df.select("class", F.lit(1).alias("raw"), F.lit(0).alias("kept")).unionByName(kept)
    return both.groupBy("class").agg(
        F.sum("raw").alias("source_rows"), F.sum("kept").alias("kept"), (F.sum("raw") - F.sum("kept")).alias("dropped")
    )


@query(
    "b11_clean_features",
    on_flows("SELECT flow_id, flow_duration, CASE WHEN isinf(flow_bytes_s) THEN NULL ELSE flow_bytes_s END AS flow_bytes_s, class FROM flows"),
)
def cleaned_features(spark, sf_dir):
    df = flows(spark, sf_dir)
    messy = df.select(
        "flow_id",
        F.col("flow_duration").alias(" flow_duration"),
        F.col("total_fwd_bytes").alias("flow_duration "),
        "flow_bytes_s",
        F.lit(None).cast("double").alias("nothing"),
        "class",
    )
    return encode.clean_features(messy)


@query("b12_aligned_columns", on_flows("SELECT flow_bytes_s, CAST(NULL AS DOUBLE) AS absent, CAST(NULL AS VARCHAR) AS absent_text, flow_id FROM flows"))
def aligned_columns(spark, sf_dir):
    wanted = T.StructType.fromDDL("flow_bytes_s double, absent double, absent_text string, flow_id bigint")
    return encode.align_to(flows(spark, sf_dir), wanted)


@query("b23_feature_order", on_flows("SELECT syn_flag_count, flow_duration, total_fwd_packets, flow_id FROM flows"))
def feature_order(spark, sf_dir):
    return in_feature_order(flows(spark, sf_dir), ["syn_flag_count", "flow_duration", "total_fwd_packets"], keep=["flow_id"])


@query(
    "b24_flow_rates",
    on_flows(
        """SELECT flow_id, total_fwd_packets + total_bwd_packets AS total_packets, total_fwd_bytes + total_bwd_bytes AS total_bytes,
        (total_fwd_bytes + total_bwd_bytes) / greatest(d, 0.000001) AS flow_bytes_s, (total_fwd_packets + total_bwd_packets) / greatest(d, 0.000001) AS flow_packets_s
        FROM (SELECT *, CASE WHEN flow_id % 10 = 0 THEN 0.0::DOUBLE ELSE flow_duration END AS d FROM flows)"""
    ).replace("0.000001", "CAST(0.000001 AS DOUBLE)"),
)
def flow_rates(spark, sf_dir):
    df = flows(spark, sf_dir).withColumn("flow_duration", F.expr("CASE WHEN flow_id % 10 = 0 THEN 0D ELSE flow_duration END"))
    return with_rates(df).select("flow_id", "total_packets", "total_bytes", "flow_bytes_s", "flow_packets_s")


@query(
    "h_duration_texts",
    """SELECT o_orderkey, CASE WHEN s >= 3600 THEN concat(s // 3600, 'h ', (s % 3600) // 60, 'm') WHEN s >= 60 THEN concat(s // 60, 'm ', s % 60, 's') ELSE concat(s, 's') END AS short_text,
      concat(lpad(CAST(r // 3600 AS VARCHAR), CAST(greatest(2, length(CAST(r // 3600 AS VARCHAR))) AS INTEGER), '0'), ':', lpad(CAST((r % 3600) // 60 AS VARCHAR), 2, '0'), ':', lpad(CAST(r % 60 AS VARCHAR), 2, '0')) AS clock
      FROM (SELECT o_orderkey, CAST(floor(o_totalprice / 4) AS BIGINT) AS s, CAST(round_even(o_totalprice / 4, 0) AS BIGINT) AS r FROM orders)""",
)
def duration_texts(spark, sf_dir):
    seconds = F.col("o_totalprice") / 4
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", short_duration(seconds).alias("short_text"), clock_text(seconds).alias("clock")
    )


# --- statistics and preparation --------------------------------------------------------------------------------


@query("e19_majority_class", on_prepared("SELECT label AS majority, n FROM (SELECT label, count(*) AS n FROM prepared GROUP BY 1) ORDER BY n DESC, label LIMIT 1"))
def majority(spark, sf_dir):
    tallies = prepared(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"))
    return tallies.orderBy(F.desc("n"), "label").limit(1).select(F.col("label").alias("majority"), "n")


@query("e20_mean_and_std", on_prepared(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std FROM prepared" for c in COMMON)))
def means_and_stds(spark, sf_dir):
    return round_all(encode.mean_and_std(prepared(spark, sf_dir), COMMON), ["mean", "std"])


def _long(spark, values: dict, columns: str):
    return spark.createDataFrame(list(values.items()), columns)


@query("e21_medians", on_flows(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(quantile_cont(CASE WHEN isinf(CAST({c} AS DOUBLE)) THEN NULL ELSE CAST({c} AS DOUBLE) END, 0.5), 6) AS median FROM flows" for c in COMMON)))
def medians(spark, sf_dir):
    df = flows(spark, sf_dir).select(*[finite_or_null(c).alias(c) for c in COMMON])
    found = exact_quantiles(df, {c: [0.5] for c in COMMON})
    return round_all(_long(spark, {c: v[0] for c, v in found.items()}, "column string, median double"), ["median"])


@query("e22_modes", on_flows(" UNION ALL ".join(f"SELECT * FROM (SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value FROM flows WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, CAST({c} AS VARCHAR) LIMIT 1)" for c in ("class", "dataset_source", "label", "src_host"))))
def modes(spark, sf_dir):
    return _long(spark, most_frequent(flows(spark, sf_dir), ["class", "dataset_source", "label", "src_host"]), "column string, value string")


_POINTS = (0.1, 0.5, 0.95, 0.995)


@query(
    "e23_percentiles",
    on_prepared(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({q} AS DOUBLE) AS q, round(quantile_cont(CAST({c} AS DOUBLE), {q}), 6) AS value FROM prepared WHERE label = 0" for c in COMMON for q in _POINTS)),
)
def percentiles(spark, sf_dir):
    benign = prepared(spark, sf_dir).where("label = 0")
    found = exact_quantiles(benign, {c: _POINTS for c in COMMON})
    rows = [(c, q, v) for c, values in found.items() for q, v in zip(_POINTS, values)]
    return round_all(spark.createDataFrame(rows, "column string, q double, value double"), ["value"])


@query(
    "e23_percentiles_bracketed",
    " UNION ALL ".join(f"SELECT CAST({q} AS DOUBLE) AS q, round(quantile_cont(l_extendedprice, {q}), 6) AS value FROM lineitem" for q in _POINTS),
)
def bracketed_percentiles(spark, sf_dir):
    # A low limit makes the sketch-and-narrow way run, the one that billions of values would take.
    found = exact_quantiles(table(spark, sf_dir, "lineitem"), {"l_extendedprice": _POINTS}, direct_limit=1000)
    rows = list(zip(_POINTS, found["l_extendedprice"]))
    return round_all(spark.createDataFrame(rows, "q double, value double"), ["value"])


@query("e24_positive_weight", on_prepared("SELECT n AS negative, p AS positive, round(n / p, 6) AS positive_weight FROM (SELECT count(CASE WHEN label = 0 THEN 1 END) AS n, count(CASE WHEN label = 1 THEN 1 END) AS p FROM prepared)"))
def weight_of_positives(spark, sf_dir):
    return round_all(encode.positive_weight(prepared(spark, sf_dir), "label"), ["positive_weight"])


@query("e24_balanced_weights", on_prepared("SELECT class AS label, n, round(CAST(t AS DOUBLE) / (k * n), 6) AS weight FROM (SELECT class, count(*) AS n, sum(count(*)) OVER () AS t, count(*) OVER () AS k FROM prepared GROUP BY 1)"))
def weights_of_classes(spark, sf_dir):
    return round_all(encode.balanced_weights(prepared(spark, sf_dir), "class"), ["weight"])


def anova_sql(label: str, source: str, features=COMMON) -> str:
    one = (
        "SELECT '{c}' AS feature, round((sum(n * (m - g) * (m - g)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))), 4) AS f_score "
        "FROM (SELECT {y} AS y, CAST(count({c}) AS DOUBLE) AS n, avg({c}) AS m, var_pop({c}) AS v, any_value(g) AS g FROM {s}, (SELECT avg({c}) AS g FROM {s}) GROUP BY 1)"
    )
    return " UNION ALL ".join(one.format(c=c, y=label, s=source) for c in features)


@query("e27_anova_f", on_prepared(anova_sql("label", "prepared")))
def anova_scores(spark, sf_dir):
    return round_all(encode.anova_f(prepared(spark, sf_dir), COMMON, "label"), ["f_score"], 4)


@query("g4_best_features", on_prepared(f"SELECT * FROM ({anova_sql('class', 'prepared')}) ORDER BY f_score DESC, feature LIMIT 5"))
def five_best_features(spark, sf_dir):
    return round_all(encode.best_features(encode.anova_f(prepared(spark, sf_dir), COMMON, "class"), 5), ["f_score"], 4)


@query(
    "i1_standardised",
    on_prepared(
        "SELECT flow_id, " + ", ".join(f"round(({c} - (SELECT avg({c}) FROM prepared)) / (SELECT stddev_pop({c}) FROM prepared), 6) AS {c}" for c in COMMON) + " FROM prepared"
    ),
)
def standardised(spark, sf_dir):
    df = prepared(spark, sf_dir)
    stats = encode.standard_stats(df, COMMON)
    return round_all(encode.standardise(df, stats).select("flow_id", *COMMON), COMMON)


@query(
    "i2_median_imputed",
    on_flows(
        "SELECT flow_id, round(coalesce(x, (SELECT quantile_cont(x, 0.5) FROM fin)), 6) AS flow_bytes_s FROM fin",
        fin="SELECT flow_id, CASE WHEN isinf(flow_bytes_s) THEN NULL ELSE flow_bytes_s END AS x FROM flows",
    ),
)
def median_imputed(spark, sf_dir):
    df = flows(spark, sf_dir).select("flow_id", "flow_bytes_s")
    prep = encode.Preparation.fit(df, exclude=["flow_id"], scale=False)
    return round_all(prep.transform(df, keep=["flow_id"]), ["flow_bytes_s"])


@query(
    "i3_i4_category_codes",
    on_flows(
        """SELECT flow_id, CAST(coalesce(c1.code, -1) AS DOUBLE) AS dataset_source, CAST(coalesce(c2.code, -1) AS DOUBLE) AS class FROM
        (SELECT flow_id, coalesce(dataset_source, (SELECT dataset_source FROM train WHERE dataset_source IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS s, class FROM flows) f
        LEFT JOIN (SELECT v, dense_rank() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT dataset_source AS v FROM train WHERE dataset_source IS NOT NULL)) c1 ON f.s = c1.v
        LEFT JOIN (SELECT v, dense_rank() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT class AS v FROM train)) c2 ON f.class = c2.v""",
        train="SELECT * FROM flows WHERE class <> 'Botnet' AND (dataset_source IS NULL OR dataset_source <> 'src2')",
    ),
)
def category_codes(spark, sf_dir):
    df = flows(spark, sf_dir).select("flow_id", "dataset_source", "class")
    # Classes and sources that training rows never show get the unknown code.
    train = df.where("class <> 'Botnet' AND (dataset_source IS NULL OR dataset_source <> 'src2')")
    prep = encode.Preparation.fit(train, exclude=["flow_id"])
    return prep.transform(df, keep=["flow_id"])


@query(
    "i4_many_category_codes",
    "SELECT doc_id, CAST(dense_rank() OVER (ORDER BY encode(text)) - 1 AS BIGINT) AS code FROM documents",
)
def many_category_codes(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id", "text")
    return df.join(codes(df, "text"), "text").select("doc_id", F.col("code").cast("bigint").alias("code"))


@query(
    "i5_prepared_pair",
    on_flows(
        "SELECT flow_id, label_code, round((coalesce(x, (SELECT quantile_cont(x, 0.5) FROM train)) - (SELECT avg(z) FROM filled)) / (SELECT stddev_pop(z) FROM filled), 6) AS flow_bytes_s FROM test",
        fin=f"SELECT flow_id, class, CASE {LENIENT.format('label')} WHEN 'attack' THEN 0 ELSE 1 END AS label_code, CASE WHEN isinf(flow_bytes_s) THEN NULL ELSE flow_bytes_s END AS x FROM flows",
        train="SELECT * FROM fin WHERE class <> 'DDoS'",
        test="SELECT * FROM fin WHERE class <> 'Botnet'",
        filled="SELECT coalesce(x, (SELECT quantile_cont(x, 0.5) FROM train)) AS z FROM train",
    ),
)
def prepared_pair(spark, sf_dir):
    df = flows(spark, sf_dir).select("flow_id", "label", "class", "flow_bytes_s")
    train, test = df.where("class <> 'DDoS'"), df.where("class <> 'Botnet'")
    _, out, _, _ = encode.prepare_pair(train, test, "label", drop=["class"], keep=["flow_id"])
    return round_all(out.withColumn("label_code", F.col("label_code").cast("int")), ["flow_bytes_s"])


@query(
    "i6_selected_features",
    on_prepared(
        "SELECT feature, round(avg(value), 6) AS mean FROM (UNPIVOT (SELECT " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in COMMON)
        + f" FROM prepared) ON COLUMNS(*) INTO NAME feature VALUE value) WHERE feature IN (SELECT feature FROM ({anova_sql('label', 'prepared')}) ORDER BY f_score DESC, feature LIMIT 4) GROUP BY 1"
    ),
)
def selected_features(spark, sf_dir):
    df = prepared(spark, sf_dir)
    chosen = [r["feature"] for r in encode.best_features(encode.anova_f(df, COMMON, "label"), 4).collect()]
    return round_all(encode.mean_and_std(df, chosen).select(F.col("column").alias("feature"), "mean"), ["mean"])


@query(
    "n4_scaled_to_range",
    on_prepared("SELECT flow_id, " + ", ".join(f"({c} - (SELECT min({c}) FROM prepared)) / ((SELECT max({c}) FROM prepared) - (SELECT min({c}) FROM prepared)) AS {c}" for c in COMMON) + " FROM prepared"),
)
def scaled_to_range(spark, sf_dir):
    df = prepared(spark, sf_dir)
    return encode.scale_to_range(df, encode.value_ranges(df, COMMON)).select("flow_id", *COMMON)


@query("n4_one_hot", on_flows("SELECT flow_id, " + ", ".join(f"CASE WHEN dataset_source = '{v}' THEN 1 ELSE 0 END AS \"dataset_source={v}\"" for v in ("src0", "src1", "src2")) + " FROM flows"))
def one_hot_sources(spark, sf_dir):
    # The fourth source is not among the fitted categories, and some flows have none.
    df = flows(spark, sf_dir).select("flow_id", "dataset_source")
    found = few_rows(df.where("dataset_source <> 'src3'").select("dataset_source").distinct().orderBy("dataset_source"), "categories")
    return encode.one_hot(df, "dataset_source", [r[0] for r in found]).drop("dataset_source")
