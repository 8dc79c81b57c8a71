"""Sources, column rules over whole tables, and dataset profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowbench.functions.names import column_kinds, find_label, normalise_columns
from flowbench.functions.values import is_infinite
from flowbench.operators import profile
from flowbench.plans.catalog import query
from flowbench.plans.flows import flows
from flowbench.plans.texts import STRICT, on_flows
from flowbench.sources.tables import first_rows, read_by_suffix, read_table
from flowbench.specs import COMMON_FEATURES

# --- sources ---------------------------------------------------------------------------------------------------


@query(
    "a1_read_table",
    "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY 1, 2",
)
def read_whole_table(spark, sf_dir):
    df = read_table(spark, f"{sf_dir}/lineitem.parquet", "parquet")
    return df.groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity")
    )


@query(
    "a2_partitioned_scan",
    "SELECT event_type, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM events GROUP BY 1",
)
def partitioned_scan(spark, sf_dir):
    df = read_by_suffix(spark, f"{sf_dir}/events.parquet")
    return df.groupBy("event_type").agg(
        F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id")
    )


@query("a3_first_rows", "SELECT event_id, user_id, event_type, value FROM events ORDER BY event_id LIMIT 250")
def first_of_table(spark, sf_dir):
    df = read_by_suffix(spark, f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "value")
    return first_rows(df, 250, ["event_id"])


# --- column names ------------------------------------------------------------------------------------------------

_BY_CLASS = "count(*) AS n, round(sum(total_bwd_packets), 3) AS bwd, round(sum(total_fwd_bytes), 3) AS fwd_bytes"


@query("b1_main_names", on_flows(f"SELECT class, {_BY_CLASS} FROM flows GROUP BY 1"))
def main_names(spark, sf_dir):
    raw = flows(spark, sf_dir).select(
        F.col("class").alias("ClassLabel"),
        F.col("total_bwd_packets").alias(" Total Backward Packets"),
        F.col("total_fwd_bytes").alias("Total Length of Fwd Packets"),
        F.col("flow_bytes_s").alias("Flow Bytes/s"),
    )
    return normalise_columns(raw).groupBy("class").agg(
        F.count("*").alias("n"),
        F.round(F.sum("total_bwd_packets"), 3).alias("bwd"),
        F.round(F.sum("total_fwd_bytes"), 3).alias("fwd_bytes"),
    )


@query("b2_lab_names", on_flows("SELECT class AS attack_cat, round(max(flow_iat_mean), 6) AS flow_iat_mean, count(flow_bytes_s) AS flow_bytes_s FROM flows GROUP BY 1"))
def lab_names(spark, sf_dir):
    raw = flows(spark, sf_dir).select(
        F.col("class").alias("Attack-Cat "), F.col("flow_iat_mean").alias("Flow IAT.Mean"), F.col("flow_bytes_s").alias("Flow Bytes/s")
    )
    return normalise_columns(raw, "lab").groupBy("attack_cat").agg(
        F.round(F.max("flow_iat_mean"), 6).alias("flow_iat_mean"), F.count("flow_bytes_s").alias("flow_bytes_s")
    )


@query("b3_compare_names", on_flows("SELECT class AS class_label, round(sum(subflow_fwd_packets), 3) AS total_fwd_packets, round(sum(subflow_bwd_packets), 3) AS total_bwd_packets, max(src_host) AS dst_port FROM flows GROUP BY 1"))
def compare_names(spark, sf_dir):
    raw = flows(spark, sf_dir).select(
        F.col("class").alias("ClassLabel"),
        F.col("subflow_fwd_packets").alias("Subflow Fwd Packets"),
        F.col("subflow_bwd_packets").alias("Subflow Bwd Packets"),
        F.col("src_host").alias("Destination Port"),
    )
    return normalise_columns(raw, "compare").groupBy("class_label").agg(
        F.round(F.sum("total_fwd_packets"), 3).alias("total_fwd_packets"),
        F.round(F.sum("total_bwd_packets"), 3).alias("total_bwd_packets"),
        F.max("dst_port").alias("dst_port"),
    )


@query("b4_find_label", on_flows("SELECT label AS found_label, count(*) AS n FROM flows GROUP BY 1"))
def found_label(spark, sf_dir):
    raw = flows(spark, sf_dir).select(F.col("label").alias("Attack Label"), "flow_duration")
    name = find_label(raw.columns)
    return raw.groupBy(F.col(name).alias("found_label")).agg(F.count("*").alias("n"))


@query(
    "b13_column_kinds",
    on_flows(
        """SELECT column_name AS "column", CASE WHEN column_name IN ('flow_start_ts','label','class','dataset_source') THEN 'categorical' ELSE 'numeric' END AS kind, n AS filled
        FROM (UNPIVOT (SELECT CAST(count(flow_start_ts) AS BIGINT) AS flow_start_ts, count(label) AS label, count(class) AS class, count(dataset_source) AS dataset_source, count(flow_duration) AS flow_duration, count(flow_bytes_s) AS flow_bytes_s, count(syn_flag_count) AS syn_flag_count FROM flows) ON COLUMNS(*) INTO NAME column_name VALUE n)"""
    ),
)
def kinds_of_columns(spark, sf_dir):
    df = flows(spark, sf_dir).select(
        "flow_start_ts", "label", "class", "dataset_source", "flow_duration", "flow_bytes_s", "syn_flag_count"
    )
    numeric, _ = column_kinds(df)
    counts = df.agg(*[F.count(c).alias(c) for c in df.columns])
    cells = [
        F.struct(
            F.lit(c).alias("column"),
            F.lit("numeric" if c in numeric else "categorical").alias("kind"),
            F.col(c).alias("filled"),
        )
        for c in df.columns
    ]
    return counts.select(F.inline(F.array(*cells)))


# --- profile -----------------------------------------------------------------------------------------------------


@query("e1_raw_label_counts", on_flows("SELECT dataset_source AS value, count(*) AS n FROM flows GROUP BY 1"))
def raw_label_counts(spark, sf_dir):
    return profile.value_counts(flows(spark, sf_dir), "dataset_source")


@query("g3_most_common_first", on_flows("SELECT label AS value, count(*) AS n FROM flows GROUP BY 1 ORDER BY n DESC, value"))
def most_common_first(spark, sf_dir):
    return profile.value_counts(flows(spark, sf_dir), "label")


@query("e2_binary_label_counts", on_flows(f"SELECT {STRICT.format('label')} AS label, count(*) AS n FROM flows GROUP BY 1"))
def binary_label_counts(spark, sf_dir):
    return profile.label_counts(flows(spark, sf_dir), "label")


def _group_sql(column: str) -> str:
    return (
        f"SELECT '{column}' AS \"column\", coalesce({column}, '<missing>') AS value, count(*) AS total, "
        f"CAST(sum(1 - y) AS BIGINT) AS benign, CAST(sum(y) AS BIGINT) AS malicious FROM labelled GROUP BY 1, 2"
    )


@query(
    "e3_group_label_counts",
    on_flows(
        f"{_group_sql('class')} UNION ALL {_group_sql('dataset_source')}",
        labelled=f"SELECT class, dataset_source, {STRICT.format('label')} AS y FROM flows",
    ),
)
def group_label_counts(spark, sf_dir):
    return profile.group_label_counts(flows(spark, sf_dir), "label", ["class", "dataset_source"])


_QUALITY = ("flow_start_ts", "class", "dataset_source", *COMMON_FEATURES)


def _quality_sql(c: str) -> str:
    numeric = c in COMMON_FEATURES
    floating = numeric and c not in ("syn_flag_count", "urg_flag_count")
    infinite = f"count(CASE WHEN isinf({c}) THEN 1 END)" if floating else "0"
    return (
        f"SELECT '{c}' AS \"column\", '{'numeric' if numeric else 'other'}' AS kind, "
        f"count(*) - count({c}) AS missing, CAST({infinite} AS BIGINT) AS infinite FROM flows"
    )


@query("e4_missing_by_column", on_flows(" UNION ALL ".join(_quality_sql(c) for c in _QUALITY)))
def missing_by_column(spark, sf_dir):
    return profile.column_quality(flows(spark, sf_dir).select("label", *_QUALITY), "label")


@query("e5_infinite_cells", on_flows("SELECT class, count(CASE WHEN isinf(flow_bytes_s) THEN 1 END) AS infinite FROM flows GROUP BY 1"))
def infinite_cells(spark, sf_dir):
    hit = F.when(is_infinite(F.col("flow_bytes_s")), 1)
    return flows(spark, sf_dir).groupBy("class").agg(F.count(hit).alias("infinite"))


@query(
    "e6_time_range",
    on_flows(
        f"""SELECT 'flow_start_ts' AS "column", min(epoch_us(flow_start_ts)) AS earliest_us, max(epoch_us(flow_start_ts)) AS latest_us,
        count(CASE WHEN flow_start_ts IS NULL AND {STRICT.format('label')} = 0 THEN 1 END) AS missing_benign,
        count(CASE WHEN flow_start_ts IS NULL AND {STRICT.format('label')} = 1 THEN 1 END) AS missing_malicious FROM flows
        UNION ALL SELECT 'timestamp', CAST(min(src_host) * 1000000 AS BIGINT), CAST(max(src_host) * 1000000 AS BIGINT),
        count(CASE WHEN flow_id % 89 = 0 AND {STRICT.format('label')} = 0 THEN 1 END),
        count(CASE WHEN flow_id % 89 = 0 AND {STRICT.format('label')} = 1 THEN 1 END) FROM
          (SELECT flow_id, label, CASE WHEN flow_id % 89 = 0 THEN NULL ELSE src_host END AS src_host FROM flows)"""
    ),
)
def time_ranges(spark, sf_dir):
    seconds = F.expr("CASE WHEN flow_id % 89 = 0 THEN CAST('NaN' AS DOUBLE) ELSE CAST(src_host AS DOUBLE) END")
    df = flows(spark, sf_dir).withColumn("timestamp", seconds)
    return profile.time_range(df, "label", ["flow_start_ts", "timestamp"])


@query(
    "e7_table_shape",
    on_flows(
        """SELECT count(*) AS n_rows, CAST(29 AS BIGINT) AS n_columns, CAST(25 AS BIGINT) AS n_numeric, CAST(3 AS BIGINT) AS n_other,
        CAST(count(*) - count(dataset_source) + count(*) - count(flow_bytes_s) AS BIGINT) AS missing,
        count(CASE WHEN isinf(flow_bytes_s) THEN 1 END) AS infinite FROM flows"""
    ),
)
def shape_of_table(spark, sf_dir):
    return profile.table_shape(flows(spark, sf_dir), "label")


@query(
    "e8_table_summary",
    on_flows(
        """SELECT 'rows' AS item, NULL AS label, count(*) AS n FROM flows
        UNION ALL SELECT 'columns', NULL, CAST(29 AS BIGINT) WHERE EXISTS (SELECT 1 FROM flows)
        UNION ALL SELECT * FROM (SELECT 'label', CAST(src_host AS VARCHAR), count(*) AS n FROM flows GROUP BY src_host ORDER BY n DESC, CAST(src_host AS VARCHAR) LIMIT 30)"""
    ),
)
def summary_of_table(spark, sf_dir):
    return profile.table_summary(flows(spark, sf_dir), "src_host", 30)


@query(
    "e16_compare_datasets",
    on_flows(
        """SELECT dataset, count(*) AS flows, CAST(sum(packets) AS BIGINT) AS packets, count(CASE WHEN label = 'Benign' THEN 1 END) AS benign,
        count(*) - count(CASE WHEN label = 'Benign' THEN 1 END) AS malicious,
        round(100.0 * (count(*) - count(CASE WHEN label = 'Benign' THEN 1 END)) / count(*), 6) AS malicious_percent
        FROM (SELECT coalesce(dataset_source, 'none') AS dataset, label, total_fwd_packets + total_bwd_packets AS packets FROM flows) GROUP BY 1"""
    ),
)
def datasets_side_by_side(spark, sf_dir):
    df = flows(spark, sf_dir).select(
        F.coalesce("dataset_source", F.lit("none")).alias("dataset"),
        "label",
        (F.col("total_fwd_packets") + F.col("total_bwd_packets")).alias("packets"),
    )
    result = profile.compare_datasets(df, "dataset", "label", "packets", "Benign")
    return result.withColumn("malicious_percent", F.round("malicious_percent", 6))


# --- column sets -------------------------------------------------------------------------------------------------

# Each source fills other columns: the byte columns are empty in src0, the flag columns in src1.
_SIDE_COLUMNS = ("flow_duration", "total_fwd_bytes", "syn_flag_count", "rst_flag_count")
_SIDES = """
SELECT coalesce(dataset_source, 'src9') AS dataset, flow_duration,
  CASE WHEN dataset_source = 'src0' THEN NULL ELSE total_fwd_bytes END AS total_fwd_bytes,
  CASE WHEN dataset_source = 'src1' THEN NULL ELSE syn_flag_count END AS syn_flag_count,
  CASE WHEN dataset_source IN ('src1', 'src2') THEN NULL ELSE rst_flag_count END AS rst_flag_count
FROM {flows}"""
_PRESENT = " UNION ALL ".join(
    f"SELECT dataset, '{c}' AS \"column\" FROM sides GROUP BY 1 HAVING count({c}) > 0" for c in _SIDE_COLUMNS
)


def _present(spark, sf_dir):
    sides = spark.sql(_SIDES, flows=flows(spark, sf_dir))
    return profile.present_columns(sides, "dataset", _SIDE_COLUMNS)


@query(
    "d10_column_overlap",
    on_flows(
        """SELECT "column", CASE WHEN l + r = 2 THEN 'both' WHEN l = 1 THEN 'left' ELSE 'right' END AS place FROM
        (SELECT "column", max(CASE WHEN dataset = 'src0' THEN 1 ELSE 0 END) AS l, max(CASE WHEN dataset = 'src1' THEN 1 ELSE 0 END) AS r
         FROM present WHERE dataset IN ('src0', 'src1') GROUP BY 1)""",
        sides=_SIDES.format(flows="flows"),
        present=_PRESENT,
    ),
)
def overlap_of_columns(spark, sf_dir):
    return profile.column_overlap(_present(spark, sf_dir), "src0", "src1")


@query(
    "d10_pairwise_common",
    on_flows(
        """SELECT a.dataset AS "left", b.dataset AS "right", count(*) AS common FROM present a JOIN present b ON a."column" = b."column" AND a.dataset < b.dataset GROUP BY 1, 2
        UNION ALL SELECT '*', '*', count(*) FROM (SELECT "column" FROM present GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT dataset) FROM present))""",
        sides=_SIDES.format(flows="flows"),
        present=_PRESENT,
    ),
)
def common_columns(spark, sf_dir):
    return profile.pairwise_common(_present(spark, sf_dir))


@query(
    "d11_feature_set_fit",
    on_flows(
        """SELECT dataset, 'flags' AS feature_set, CAST(2 AS BIGINT) AS n_features,
          CASE WHEN max(CASE WHEN "column" = 'rst_flag_count' THEN 1 ELSE 0 END) = 0 AND max(CASE WHEN "column" = 'syn_flag_count' THEN 1 ELSE 0 END) = 0 THEN 'rst_flag_count,syn_flag_count'
               WHEN max(CASE WHEN "column" = 'rst_flag_count' THEN 1 ELSE 0 END) = 0 THEN 'rst_flag_count'
               WHEN max(CASE WHEN "column" = 'syn_flag_count' THEN 1 ELSE 0 END) = 0 THEN 'syn_flag_count' ELSE '' END AS missing,
          count(CASE WHEN "column" IN ('rst_flag_count', 'syn_flag_count') THEN 1 END) = 2 AS compatible FROM present GROUP BY 1
        UNION ALL SELECT dataset, 'sizes', CAST(2 AS BIGINT), CASE WHEN max(CASE WHEN "column" = 'total_fwd_bytes' THEN 1 ELSE 0 END) = 0 THEN 'total_fwd_bytes' ELSE '' END,
          count(CASE WHEN "column" IN ('total_fwd_bytes', 'flow_duration') THEN 1 END) = 2 FROM present GROUP BY 1""",
        sides=_SIDES.format(flows="flows"),
        present=_PRESENT,
    ),
)
def feature_sets_per_source(spark, sf_dir):
    needs = {"flags": ("rst_flag_count", "syn_flag_count"), "sizes": ("flow_duration", "total_fwd_bytes")}
    return profile.missing_features(_present(spark, sf_dir), needs)
