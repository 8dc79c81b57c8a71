"""The flow and run views that the registered queries and their SQL checks share.

``flows`` gives each event row the columns of a network flow; ``runs`` gives each order the columns of a
finished detector run. One text serves both engines: only the string type and the way to read the number ``k``
from the JSON in ``props`` differ. It is parsed once, below the columns that use it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FLOWS_TEXT = """
SELECT e AS flow_id, u AS src_host, ts AS flow_start_ts,
  CASE et WHEN 'error' THEN 'DDoS-HOIC' WHEN 'signup' THEN ' ddos-loic-http ' WHEN 'purchase' THEN 'Bot' ELSE 'Benign' END AS label,
  CASE et WHEN 'error' THEN 'DDoS' WHEN 'signup' THEN 'DDoS' WHEN 'purchase' THEN 'Botnet' ELSE 'Benign' END AS class,
  CASE WHEN e % 89 = 0 THEN NULL ELSE concat('src', CAST(u % 4 AS {S})) END AS dataset_source,
  dur AS flow_duration, fp AS total_fwd_packets, bp AS total_bwd_packets, fb AS total_fwd_bytes, bb AS total_bwd_bytes,
  CASE WHEN fp > 0 THEN fb / fp ELSE CAST(0 AS DOUBLE) END AS fwd_packet_length_mean,
  CASE WHEN bp > 0 THEN bb / bp ELSE CAST(0 AS DOUBLE) END AS bwd_packet_length_mean,
  (fp + bp) / dur AS flow_packets_s,
  CASE WHEN e % 97 = 0 THEN NULL WHEN e % 101 = 0 THEN CAST('Infinity' AS DOUBLE) ELSE (fb + bb) / dur END AS flow_bytes_s,
  CAST(CASE WHEN e % 3 = 0 THEN 1 + e % 4 ELSE 0 END AS BIGINT) AS syn_flag_count,
  CAST(e % 2 AS BIGINT) AS urg_flag_count,
  CAST(CASE WHEN e % 2 = 0 THEN 0 ELSE k END AS BIGINT) AS ack_flag_count,
  CAST(e % 5 AS BIGINT) AS rst_flag_count,
  CAST(CASE WHEN e % 4 = 0 THEN 0 ELSE 1 END AS BIGINT) AS psh_flag_count,
  CAST(CASE WHEN e % 3 = 0 THEN 0 ELSE 1 END AS BIGINT) AS fin_flag_count,
  v * CAST(10 AS DOUBLE) AS flow_iat_mean, v * CAST(40 AS DOUBLE) AS flow_iat_std,
  v * CAST(2 AS DOUBLE) AS packet_length_mean, CAST(e % 60 AS DOUBLE) AS packet_length_std,
  fp * CAST(20 AS DOUBLE) AS fwd_header_length, CAST(e % 6 AS BIGINT) AS fwd_act_data_packets,
  fp AS subflow_fwd_packets, bp AS subflow_bwd_packets
FROM (SELECT event_id AS e, user_id AS u, ts, event_type AS et, value AS v, k,
  CAST(1 + event_id % 200 AS DOUBLE) * CAST(0.0005 AS DOUBLE) AS dur, CAST(k AS DOUBLE) AS fp,
  CAST(CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id % 12 END AS DOUBLE) AS bp,
  value * CAST(10 AS DOUBLE) AS fb,
  CASE WHEN event_id % 3 = 0 THEN CAST(0 AS DOUBLE) ELSE value * CAST(user_id % 100 AS DOUBLE) END AS bb
  FROM (SELECT *, {K} AS k FROM {events}) p) b
"""

RUNS_TEXT = """
SELECT concat('2026', lpad(CAST(o_orderkey AS {S}), 10, '0')) AS run_id,
  concat('model', lpad(CAST(o_custkey % 12 AS {S}), 2, '0')) AS model_id,
  CASE o_orderkey % 4 WHEN 0 THEN 'matrix_cic_train_cic_test' WHEN 1 THEN 'matrix_cic_train_botnet_test'
    WHEN 2 THEN 'matrix_botnet_train_botnet_test' ELSE 'matrix_botnet_train_cic_test' END AS dataset_id,
  CASE o_orderstatus WHEN 'P' THEN 'failed' ELSE 'success' END AS status,
  o_totalprice / CAST(1000000 AS DOUBLE) AS f1_macro, o_totalprice / CAST(900000 AS DOUBLE) AS accuracy,
  CAST(o_custkey AS DOUBLE) AS duration_seconds
FROM {orders}
"""

ATTACK_RULE = "CASE WHEN flow_packets_s > 3000 AND total_bwd_packets <= 3 THEN 'Attack' ELSE 'Benign' END"


def _spark_text(text: str, spark: SparkSession, **tables: DataFrame) -> DataFrame:
    filled = text.replace("{S}", "STRING").replace("{K}", "from_json(props, 'k BIGINT').k")
    return spark.sql(filled, **tables)


def _check_text(text: str) -> str:
    text = text.replace("{S}", "VARCHAR").replace("{K}", "CAST(json_extract_string(props, '$.k') AS BIGINT)")
    return text.replace("{events}", "events").replace("{orders}", "orders").strip()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flows_of(events: DataFrame) -> DataFrame:
    """One flow per event, with raw labels, null groups, and null and infinite rates. Takes a table or a stream."""
    return _spark_text(FLOWS_TEXT, events.sparkSession, events=events)


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows_of(table(spark, sf_dir, "events"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One finished run per order: 12 models, 4 directions, about a third failed."""
    return _spark_text(RUNS_TEXT, spark, orders=table(spark, sf_dir, "orders"))


FLOWS_SQL = _check_text(FLOWS_TEXT)
RUNS_SQL = _check_text(RUNS_TEXT)
