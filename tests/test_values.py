import datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import types as T

from flowbench.functions import names, values
from flowbench.operators import encode, profile
from flowbench.operators.select import features_and_label, merged_drops, resolve_features
from flowbench.specs import ALL_NUMERIC, DatasetSpec, FeatureSet, SplitSpec


def column(spark, cells, kind="string"):
    return spark.createDataFrame([(i, c) for i, c in enumerate(cells)], f"i int, x {kind}")


def result(df, expr):
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_strict_labels(spark):
    df = column(spark, [" Benign ", "NORMAL", "0", "0.0", "legitimate", "DDoS", "\tbenign\n"])
    assert result(df, values.strict_label("x")) == [0, 0, 0, 1, 1, 1, 0]
    with pytest.raises(PySparkException, match="a label is missing"):
        column(spark, [None]).select(values.strict_label("x")).collect()


def test_strict_labels_of_numbers(spark):
    assert result(column(spark, [0, 1], "int"), values.strict_label("x")) == [0, 1]
    assert result(column(spark, [0.0], "double"), values.strict_label("x")) == [1]


def test_lenient_labels(spark):
    df = column(spark, [" Benign ", "NORMAL", "0", "0.0", "legitimate", "DDoS", None, "Background", "FALSE"])
    expected = ["benign", "benign", "benign", "attack", "benign", "attack", "attack", "benign", "benign"]
    assert result(df, values.lenient_label("x")) == expected
    assert result(column(spark, ["DDoS-LOIC HTTP", None]), values.class_text("x")) == ["ddos_loic_http", "missing"]


def test_group_match_is_never_null(spark):
    df = column(spark, [" ddos ", "DDoS", "bot", None])
    assert result(df, values.same_group("x", "DDOS ")) == [True, True, False, False]


def test_numbers(spark):
    df = column(spark, ["1.5", "abc", "inf", "-Infinity", "NaN", None, "1e3"])
    assert result(df, values.finite_or_null("x")) == [1.5, None, None, None, None, None, 1000.0]
    assert result(df, values.finite_or("x")) == [1.5, 0, 0, 0, 0, 0, 1000.0]


def test_complete_rows_look_at_features_and_label_only(spark):
    df = spark.createDataFrame(
        [(1, 1.0, "a", None), (2, float("inf"), "a", "g"), (3, None, "a", "g"), (4, 2.0, None, "g"), (5, float("nan"), "a", "g"), (6, 3.0, "b", "g")],
        "i int, f double, y string, g string",
    )
    assert [r["i"] for r in values.complete_rows(df, ["i", "f"], "y").orderBy("i").collect()] == [1, 6]


def test_scoring_input_fills_zero_and_names_missing_columns(spark):
    df = spark.createDataFrame([(float("inf"), None, 1), (2.0, float("nan"), 0)], "a double, b double, y int")
    rows = features_and_label(df, ["b", "a"], "y").orderBy("y").collect()
    assert [tuple(r) for r in rows] == [(0.0, 2.0, 0), (0.0, 0.0, 1)]
    with pytest.raises(names.ColumnError, match="zz"):
        features_and_label(df, ["zz"], "y")


def test_names():
    assert [names.normalise_name(c) for c in (" Flow Bytes/s ", "Total Backward Packets", "ClassLabel", "Fwd-IAT.Mean")] == [
        "flow_bytes_s", "total_bwd_packets", "class", "fwdiatmean",
    ]
    assert [names.normalise_name(c, "lab") for c in (" Flow Bytes/s ", "Total Backward Packets", "ClassLabel", "Fwd-IAT.Mean")] == [
        "flow_bytes_s", "total_backward_packets", "classlabel", "fwd_iat_mean",
    ]
    assert names.normalise_name("Destination Port", "compare") == "dst_port"
    assert names.normalise_name("ClassLabel", "compare") == "class_label"
    assert names.normalise_name("Fwd IAT.Mean", "dotted") == "fwd_iat_mean"
    with pytest.raises(ValueError):
        names.normalise_name("x", "other")


def test_colliding_names_are_named(spark):
    df = spark.createDataFrame([(1, 2)], ["Total Length of Fwd Packets", "Fwd Packets Length Total"])
    with pytest.raises(names.ColumnError, match="Total Length of Fwd Packets.*Fwd Packets Length Total"):
        names.normalise_columns(df)


def test_find_label():
    assert names.find_label(["x", "Label", "class"]) == "Label"
    assert names.find_label(["x", "Attack-Cat"]) == "Attack-Cat"
    assert names.find_label(["x", "My Label"], "my_label") == "My Label"
    with pytest.raises(names.ColumnError):
        names.find_label(["x", "y"])
    with pytest.raises(names.ColumnError):
        names.find_label(["label"], "other")


def test_boolean_columns(spark):
    df = spark.createDataFrame([(True, 1, "a")], "b boolean, n int, s string")
    assert names.numeric_columns(df) == ["n"]
    assert names.column_kinds(df) == (["b", "n"], ["s"])
    assert resolve_features(df, FeatureSet("all", ALL_NUMERIC), [], "s") == ["n"]


def test_drop_lists_are_merged_in_order():
    data, split = DatasetSpec("d", drop=("Src IP", "b")), SplitSpec("s", drop=("b", "c"))
    assert merged_drops(data, split) == ["src_ip", "b", "c"]
    assert merged_drops(data, SplitSpec("s", drop=("c",), use_dataset_drop=False)) == ["c"]


def test_times(spark):
    def micros(text):
        return int(datetime.datetime.fromisoformat(text).replace(tzinfo=datetime.timezone.utc).timestamp() * 1e6)

    df = column(spark, ["2024-01-02 03:04:05", "2024-01-02T03:04:05Z", "2024-01-02T05:04:05+02:00", "2024-01-02", "soon", None])
    got = result(df, values.utc_micros("x", T.StringType()))
    assert got == [micros("2024-01-02 03:04:05")] * 3 + [micros("2024-01-02"), None, None]
    numbers = column(spark, [1.5, float("nan"), None], "double")
    assert result(numbers, values.utc_micros("x", T.DoubleType())) == [1_500_000, None, None]


def test_times_do_not_depend_on_the_session_zone(spark):
    df = column(spark, ["2024-01-02 03:04:05"])
    before = result(df, values.utc_micros("x", T.StringType()))
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert result(df, values.utc_micros("x", T.StringType())) == before
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_duration_texts(spark):
    df = column(spark, [0.4, 59.9, 61.0, 3725.0, 360000.0], "double")
    assert result(df, values.short_duration("x")) == ["0s", "59s", "1m 1s", "1h 2m", "100h 0m"]
    assert result(df, values.clock_text("x")) == ["00:00:00", "00:01:00", "00:01:01", "01:02:05", "100:00:00"]


def test_rates_use_the_duration_floor(spark):
    df = spark.createDataFrame([(0.0, 1.0, 1.0, 5.0, 5.0)], ["flow_duration", "total_fwd_packets", "total_bwd_packets", "total_fwd_bytes", "total_bwd_bytes"])
    row = values.with_rates(df).first()
    assert row["flow_packets_s"] == pytest.approx(2e6) and row["flow_bytes_s"] == pytest.approx(1e7)


def test_cleaning_drops_empty_and_repeated_columns(spark):
    df = spark.createDataFrame([(1.0, None, 5.0, 9)], "`a ` double, e double, b double, ` b` int")
    df = df.toDF("a ", "e", " b", "b")
    out = encode.clean_features(df)
    assert out.columns == ["a", "b"] and tuple(out.first()) == (1.0, 5.0)
    with pytest.raises(names.ColumnError):
        encode.clean_features(spark.createDataFrame([(None,)], "e double"))


def test_preparation_is_fitted_on_train_alone(spark):
    train = spark.createDataFrame([(1.0, "a"), (3.0, "b"), (None, "b"), (8.0, None)], "x double, c string")
    test = spark.createDataFrame([(100.0, "z", 1), (None, None, 2)], "x double, c string, i int")
    prep = encode.Preparation.fit(train, scale=False)
    assert prep.medians == {"x": 3.0} and prep.modes == {"c": "b"}
    assert [tuple(r) for r in prep.transform(test, ["i"]).orderBy("i").collect()] == [(1, 100.0, -1.0), (2, 3.0, 1.0)]
    without_c = spark.createDataFrame([(1.0,)], "x double")
    assert tuple(prep.transform(without_c).first()) == (1.0, 1.0)


def test_constant_feature_is_not_divided_by_zero(spark):
    df = spark.createDataFrame([(2.0, 1.0), (2.0, 3.0)], "c double, x double")
    stats = encode.standard_stats(df, ["c", "x"])
    assert [tuple(r) for r in encode.standardise(df, stats).orderBy("x").collect()] == [(0.0, -1.0), (0.0, 1.0)]


def test_both_classes_are_needed_for_weights(spark):
    with pytest.raises(PySparkException, match="benign and malicious"):
        encode.positive_weight(spark.createDataFrame([(1,)], "y int"), "y").collect()


def test_feature_set_fit(spark):
    df = spark.createDataFrame([(1, 2.0, "a")], "A int, B double, S string")
    sets = [FeatureSet("ok", ("a", "b")), FeatureSet("short", ("a", "q", "p")), FeatureSet("num", ALL_NUMERIC)]
    rows = {r["feature_set"]: r for r in profile.feature_set_fit(df, sets, drop=["b"]).collect()}
    assert rows["ok"]["compatible"] and rows["ok"]["n_features"] == 2
    assert not rows["short"]["compatible"] and rows["short"]["missing"] == "p,q"
    assert rows["num"]["n_features"] == 1


def test_profile_parts(spark):
    df = spark.createDataFrame(
        [("Benign", "a", 1.0, "2024-01-01 00:00:00"), ("x", None, float("inf"), "no"), ("x", "a", None, None)],
        "label string, class string, f double, timestamp string",
    )
    parts = profile.profile_dataset(df, "label")
    assert tuple(parts["shape"].first()) == (3, 4, 1, 2, 3, 1)
    groups = {(r["column"], r["value"]): (r["total"], r["benign"], r["malicious"]) for r in parts["groups"].collect()}
    assert groups == {("class", "a"): (2, 1, 1), ("class", "<missing>"): (1, 0, 1)}
    times = parts["times"].first()
    assert times["missing_benign"] == 0 and times["missing_malicious"] == 2


def test_column_overlap_of_tables(spark):
    a = spark.createDataFrame([(1, 2, 3)], ["Total Backward Packets", "x", "ClassLabel"])
    b = spark.createDataFrame([(1, 2)], ["total_bwd_packets", "y"])
    table = profile.column_table({"a": a, "b": b})
    places = {r["column"]: r["place"] for r in profile.column_overlap(table, "a", "b").collect()}
    assert places == {"total_bwd_packets": "both", "x": "left", "class_label": "left", "y": "right"}
    pairs = {(r["left"], r["right"]): r["common"] for r in profile.pairwise_common(table).collect()}
    assert pairs == {("a", "b"): 1, ("*", "*"): 1}
