"""Train/test cuts over whole tables, checked row by row against a ranking of the same hashes."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowbench.functions.names import normalise_columns
from flowbench.functions.values import lenient_label
from flowbench.operators import splits
from flowbench.plans.catalog import query
from flowbench.plans.flows import flows, table
from flowbench.plans.prep import prepare_split
from flowbench.plans.queries_cleaning import COMMON, prepared
from flowbench.plans.texts import LENIENT, on_flows, on_prepared
from flowbench.specs import COMMON_FEATURES, DatasetSpec, FeatureSet, SplitSpec

KEY = ["flow_id"]


def hashed(key: str, seed: int = 42) -> str:
    return f"md5('{seed}|' || CAST({key} AS VARCHAR))"


def ranked_steps(source: str, key: str, stratum: str, total: str, seed: int = 42) -> dict[str, str]:
    """Steps ending in ``placed``: every row of ``source`` with its stratum, hash rank and the stratum's quota.

    ``total`` is the wanted number of rows, in terms of ``t``, the number of all rows.
    """
    return {
        "sizes": f"SELECT {stratum} AS stratum, count(*) AS n FROM {source} GROUP BY 1",
        "shares": f"SELECT stratum, n, {total} AS total, ({total}) * n / CAST(t AS DOUBLE) AS exact FROM (SELECT *, sum(n) OVER () AS t FROM sizes)",
        "quotas": "SELECT stratum, n, floor(exact) + CASE WHEN row_number() OVER (ORDER BY exact - floor(exact) DESC, stratum) <= total - sum(floor(exact)) OVER () THEN 1 ELSE 0 END AS quota FROM shares",
        "placed": f"SELECT s.*, q.stratum AS stratum, q.quota, row_number() OVER (PARTITION BY q.stratum ORDER BY {hashed('s.' + key, seed)}) AS place FROM {source} s JOIN quotas q ON q.stratum = {stratum}",
    }


_TEST = "ceil(t * CAST(0.2 AS DOUBLE))"
_PART = "CASE WHEN place <= quota THEN 'test' ELSE 'train' END"


@query("c1_stratified_split", on_prepared(f"SELECT flow_id, label, {_PART} AS part FROM placed", **ranked_steps("prepared", "flow_id", "CAST(label AS VARCHAR)", _TEST)))
def stratified_split(spark, sf_dir):
    return splits.random_parts(prepared(spark, sf_dir), KEY, 0.2, 42, "label").select("flow_id", "label", "part")


@query(
    "c1_stratified_by_source",
    on_flows(f"SELECT flow_id, dataset_source, {_PART} AS part FROM placed", **ranked_steps("flows", "flow_id", "coalesce(dataset_source, '<missing>')", "ceil(t * CAST(0.37 AS DOUBLE))", 7)),
)
def stratified_by_source(spark, sf_dir):
    return splits.random_parts(flows(spark, sf_dir), KEY, 0.37, 7, "dataset_source").select("flow_id", "dataset_source", "part")


@query("c2_random_split", on_prepared(f"SELECT flow_id, {_PART} AS part FROM placed", **ranked_steps("prepared", "flow_id", "'*'", _TEST)))
def random_split(spark, sf_dir):
    return splits.random_parts(prepared(spark, sf_dir), KEY, 0.2, 42).select("flow_id", "part")


def holdout_steps(group: str, value: str) -> dict[str, str]:
    steps = {"benign": "SELECT flow_id FROM prepared WHERE label = 0", **ranked_steps("benign", "flow_id", "'*'", _TEST)}
    steps["parts"] = (
        f"SELECT p.*, CASE WHEN lower(trim({group})) = '{value}' THEN 'test' WHEN p.label = 1 THEN 'train' "
        f"WHEN b.place <= b.quota THEN 'test' ELSE 'train' END AS part FROM prepared p LEFT JOIN placed b USING (flow_id)"
    )
    return steps


@query("c3_family_holdout", on_prepared("SELECT flow_id, class, label, part FROM parts", **holdout_steps("class", "ddos")))
def family_holdout(spark, sf_dir):
    parts = splits.holdout_parts(prepared(spark, sf_dir), KEY, "label", "class", " DDOS ")
    return parts.select("flow_id", "class", "label", "part")


@query("c4_subtype_holdout", on_prepared("SELECT flow_id, original_label, label, part FROM parts", **holdout_steps("original_label", "ddos-loic-http")))
def subtype_holdout(spark, sf_dir):
    parts = splits.holdout_parts(prepared(spark, sf_dir), KEY, "label", "original_label", "DDoS-LOIC-HTTP")
    return parts.select("flow_id", "original_label", "label", "part")


@query("c5_external_full", on_flows("SELECT 'test' AS part, class, count(*) AS n FROM flows GROUP BY 2"))
def external_full(spark, sf_dir):
    return splits.external_parts(flows(spark, sf_dir)).groupBy("part", "class").agg(F.count("*").alias("n"))


@query("c6_capped_rows", on_prepared("SELECT flow_id, label FROM placed WHERE place <= quota", **ranked_steps("prepared", "flow_id", "CAST(label AS VARCHAR)", "CAST(floor(t / 7) AS BIGINT)")))
def capped_rows(spark, sf_dir):
    df = prepared(spark, sf_dir)
    return splits.cap_rows(df, KEY, df.count() // 7, 42, "label").select("flow_id", "label")


_DISPATCH = on_prepared(
    "SELECT 'random' AS method, part, count(*) AS n FROM (SELECT " + _PART + " AS part FROM placed) GROUP BY 2 "
    "UNION ALL SELECT 'attack_family_holdout', part, count(*) FROM (SELECT CASE WHEN class = 'Botnet' THEN 'test' WHEN p.label = 1 THEN 'train' WHEN b.place <= b.quota THEN 'test' ELSE 'train' END AS part "
    "FROM prepared p LEFT JOIN (SELECT flow_id, row_number() OVER (ORDER BY " + hashed("flow_id") + ") AS place, ceil(count(*) OVER () * CAST(0.2 AS DOUBLE)) AS quota FROM prepared WHERE label = 0) b USING (flow_id)) GROUP BY 2 "
    "UNION ALL SELECT 'external_full', 'test', count(*) FROM prepared",
    **ranked_steps("prepared", "flow_id", "CAST(label AS VARCHAR)", _TEST),
)


@query("c7_split_methods", _DISPATCH)
def split_methods(spark, sf_dir):
    df = prepared(spark, sf_dir)
    specs = [
        SplitSpec("r", "random"),
        SplitSpec("h", "attack_family_holdout", group="class", holdout="Botnet"),
        SplitSpec("e", "external_full"),
    ]
    tables = [
        splits.split_parts(df, "label", s).groupBy(F.lit(s.method).alias("method"), "part").agg(F.count("*").alias("n"))
        for s in specs
    ]
    return tables[0].unionByName(tables[1]).unionByName(tables[2])


@query("c8_can_stratify", on_flows("SELECT count(*) AS classes, min(n) AS smallest, count(*) >= 2 AND min(n) >= 2 AS can_stratify FROM (SELECT class, count(*) AS n FROM flows GROUP BY 1)"))
def stratifiable(spark, sf_dir):
    return splits.can_stratify(flows(spark, sf_dir), "class")


@query("c8_too_small_class", "SELECT count(*) AS classes, min(n) AS smallest, count(*) >= 2 AND min(n) >= 2 AS can_stratify FROM (SELECT event_id = (SELECT max(event_id) FROM events) AS c, count(*) AS n FROM events GROUP BY 1)")
def too_small_class(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    last = df.agg(F.max("event_id")).first()[0]
    return splits.can_stratify(df, F.col("event_id") == last)


@query(
    "c9_checked_split",
    on_flows(f"SELECT flow_id, {_PART} AS part FROM placed", named=f"SELECT flow_id, {LENIENT.format('label')} AS y FROM flows", **ranked_steps("named", "flow_id", "y", _TEST)),
)
def checked_split(spark, sf_dir):
    df = flows(spark, sf_dir)
    return splits.checked_random_parts(df, KEY, 0.2, 42, "stratified", lenient_label("label")).select("flow_id", "part")


@query(
    "c9_fallback_split",
    on_flows(f"SELECT flow_id, {_PART} AS part FROM placed", **ranked_steps("flows", "flow_id", "'*'", _TEST)),
)
def fallback_split(spark, sf_dir):
    # One class has a single row, so the stratified request falls back to an unstratified cut.
    df = flows(spark, sf_dir)
    last = df.agg(F.max("flow_id")).first()[0]
    return splits.checked_random_parts(df, KEY, 0.2, 42, "stratified", F.col("flow_id") == last).select("flow_id", "part")


_SAVED = {**ranked_steps("prepared", "flow_id", "CAST(label AS VARCHAR)", _TEST), "saved": f"SELECT flow_id, 's1' AS split_id, {_PART} AS part FROM placed"}


@query("a12_membership", on_prepared("SELECT flow_id, split_id, part FROM saved", **_SAVED))
def membership_table(spark, sf_dir):
    return splits.membership(splits.random_parts(prepared(spark, sf_dir), KEY, 0.2, 42, "label"), KEY, "s1")


@query("c11_applied_membership", on_prepared("SELECT 'train' AS part, class, count(*) AS n FROM prepared SEMI JOIN (SELECT * FROM saved WHERE part = 'train') USING (flow_id) GROUP BY 2 UNION ALL SELECT 'test', class, count(*) FROM prepared SEMI JOIN (SELECT * FROM saved WHERE part = 'test') USING (flow_id) GROUP BY 2", **_SAVED))
def applied_membership(spark, sf_dir):
    df = prepared(spark, sf_dir)
    saved = splits.membership(splits.random_parts(df, KEY, 0.2, 42, "label"), KEY, "s1")
    train, test = splits.apply_membership(df, saved, KEY)
    both = [p.groupBy(F.lit(n).alias("part"), "class").agg(F.count("*").alias("n")) for n, p in (("train", train), ("test", test))]
    return both[0].unionByName(both[1])


@query("d1_split_rows", on_prepared("SELECT * REPLACE (CAST(syn_flag_count AS DOUBLE) AS syn_flag_count, CAST(urg_flag_count AS DOUBLE) AS urg_flag_count) FROM prepared WHERE flow_id IN (SELECT flow_id FROM saved WHERE part = 'test')", **_SAVED))
def rows_of_split(spark, sf_dir):
    df = prepared(spark, sf_dir)
    saved = splits.membership(splits.random_parts(df, KEY, 0.2, 42, "label"), KEY, "s1")
    return splits.apply_membership(df, saved, KEY, check=False)[1]


_FIT = f"SELECT flow_id, CASE WHEN row_number() OVER (ORDER BY {hashed('flow_id')}) <= least(greatest(1, floor(count(*) OVER () * CAST(0.1 AS DOUBLE))), count(*) OVER () - 1) THEN 'validation' ELSE 'fitting' END AS part FROM prepared"


@query("c12_fitting_parts", on_prepared(_FIT))
def fitting_cut(spark, sf_dir):
    return splits.fitting_parts(prepared(spark, sf_dir), KEY).select("flow_id", "part")


@query("c13_split_description", on_prepared(f"SELECT {_PART} AS part, CAST(label AS VARCHAR) AS label, count(*) AS n FROM placed GROUP BY 1, 2", **ranked_steps("prepared", "flow_id", "CAST(label AS VARCHAR)", _TEST)))
def split_description(spark, sf_dir):
    return splits.describe_parts(splits.random_parts(prepared(spark, sf_dir), KEY, 0.2, 42, "label"), "label")


@query("g5_labels_in_order", on_prepared("SELECT CAST(label AS VARCHAR) AS label, 'test' AS part, count(*) AS n FROM prepared GROUP BY 1 ORDER BY 1"))
def labels_in_order(spark, sf_dir):
    return splits.describe_parts(splits.external_parts(prepared(spark, sf_dir)), "label")


_EACH = "SELECT flow_id, class FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY " + hashed("flow_id", 3) + ") AS place FROM flows) WHERE place <= {each}"


@query("c14_balanced_sample", on_flows(_EACH.format(each="(SELECT CAST(count(*) AS BIGINT) // 9 // 3 FROM flows)")))
def balanced_sample(spark, sf_dir):
    df = flows(spark, sf_dir)
    return splits.balanced_rows(df, KEY, "class", df.count() // 9, 3).select("flow_id", "class")


@query("n2_undersampled", on_flows(_EACH.format(each="(SELECT min(n) FROM (SELECT count(*) AS n FROM flows GROUP BY class))")))
def undersampled(spark, sf_dir):
    return splits.balanced_rows(flows(spark, sf_dir), KEY, "class", seed=3).select("flow_id", "class")


_PAIRED = "flow_duration, total_fwd_packets, total_bwd_packets, label"


@query(
    "c15_aligned_pair",
    on_flows(
        f"""SELECT dataset_source, label, count(*) AS n, round(sum(flow_duration), 6) AS flow_duration, round(sum(total_fwd_packets), 3) AS total_fwd_packets, round(sum(total_bwd_packets), 3) AS total_bwd_packets FROM (
        SELECT 'flows' AS dataset_source, {_PAIRED} FROM flows UNION ALL
        SELECT 'orders', CAST(o_custkey AS DOUBLE), CAST(o_orderkey % 50 AS DOUBLE), CAST(o_orderkey % 7 AS DOUBLE), o_orderstatus FROM orders) GROUP BY 1, 2"""
    ),
)
def aligned_pair(spark, sf_dir):
    # The second table names its columns differently and has one that the first lacks.
    left = normalise_columns(flows(spark, sf_dir).drop("subflow_fwd_packets", "subflow_bwd_packets"), "compare")
    right = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("double").alias("Flow Duration"),
        F.expr("CAST(o_orderkey % 50 AS DOUBLE)").alias("Subflow Fwd Packets"),
        F.expr("CAST(o_orderkey % 7 AS DOUBLE)").alias("Total Backward Packets"),
        F.col("o_orderstatus").alias("Label"),
        F.col("o_totalprice").alias("price"),
    )
    both = splits.aligned_union({"flows": left, "orders": right}, "label")
    return both.groupBy("dataset_source", "label").agg(
        F.count("*").alias("n"),
        F.round(F.sum("flow_duration"), 6).alias("flow_duration"),
        F.round(F.sum("total_fwd_packets"), 3).alias("total_fwd_packets"),
        F.round(F.sum("total_bwd_packets"), 3).alias("total_bwd_packets"),
    )


@query("d9_parts_together", on_prepared("SELECT class, label, count(*) AS n, round(sum(flow_duration), 6) AS seconds FROM prepared GROUP BY 1, 2"))
def parts_together(spark, sf_dir):
    df = prepared(spark, sf_dir)
    parts = splits.holdout_parts(df, KEY, "label", "class", "DDoS")
    train, test = (parts.where(F.col("part") == p) for p in ("train", "test"))
    return train.unionByName(test).groupBy("class", "label").agg(
        F.count("*").alias("n"), F.round(F.sum("flow_duration"), 6).alias("seconds")
    )


EVENTS = DatasetSpec("events", drop=("class", "dataset_source", "flow_start_ts", "src_host"))
COMMON_SET = FeatureSet("common", COMMON_FEATURES)
DDOS_HOLDOUT = SplitSpec("ddos_holdout", "attack_family_holdout", group="class", holdout="DDoS")


@query(
    "p1_prepared_split",
    on_prepared(f"SELECT flow_id, part, label, {', '.join(COMMON)} FROM parts", **holdout_steps("class", "ddos")).replace(
        f"label, {', '.join(COMMON)} FROM parts", "label, " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in COMMON) + " FROM parts"
    ),
)
def prepared_split(spark, sf_dir):
    split = prepare_split(flows(spark, sf_dir), EVENTS, COMMON_SET, DDOS_HOLDOUT, keep_key=True)
    return split.rows.select("flow_id", "part", "label", *COMMON)


_META = holdout_steps("original_label", "ddos-hoic")


@query(
    "p2_split_metadata",
    on_prepared(
        "SELECT (SELECT count(*) FROM flows) AS source_rows, count(*) AS prepared_rows, (SELECT count(*) FROM flows) - count(*) AS dropped_rows, "
        "count(CASE WHEN part = 'train' THEN 1 END) AS train_rows, count(CASE WHEN part = 'test' THEN 1 END) AS test_rows, "
        "count(CASE WHEN part = 'train' AND label = 0 THEN 1 END) AS train_0, count(CASE WHEN part = 'train' AND label = 1 THEN 1 END) AS train_1, "
        "count(CASE WHEN part = 'test' AND label = 0 THEN 1 END) AS test_0, count(CASE WHEN part = 'test' AND label = 1 THEN 1 END) AS test_1, "
        "'attack_family_holdout' AS method, 'label' AS label_column FROM parts",
        **_META,
    ),
)
def split_metadata(spark, sf_dir):
    spec = SplitSpec("hoic", "attack_family_holdout", group="original_label", holdout="DDoS-HOIC")
    meta = prepare_split(flows(spark, sf_dir), EVENTS, COMMON_SET, spec).metadata()
    return meta.select(
        "source_rows", "prepared_rows", "dropped_rows", "train_rows", "test_rows",
        F.expr("train_label_distribution['0']").alias("train_0"), F.expr("train_label_distribution['1']").alias("train_1"),
        F.expr("test_label_distribution['0']").alias("test_0"), F.expr("test_label_distribution['1']").alias("test_1"),
        F.col("split_method.type").alias("method"), "label_column",
    )


_FOLD = "CAST(floor(CAST(concat('0x', substr(" + hashed("flow_id") + ", 1, 13)) AS BIGINT) / CAST(4503599627370496 AS DOUBLE) * 5) AS INTEGER)"


@query("n6_folds", on_prepared(f"SELECT flow_id, {_FOLD} AS fold FROM prepared"))
def fold_numbers(spark, sf_dir):
    return splits.folds(prepared(spark, sf_dir), KEY, 5).select("flow_id", "fold")
