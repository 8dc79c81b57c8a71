import pytest
from pyspark.sql import functions as F

from flowbench.operators import splits
from flowbench.plans.prep import prepare_split, saved_membership
from flowbench.sources import sinks
from flowbench.specs import DatasetSpec, FeatureSet, SplitSpec

KEY = ["k"]


@pytest.fixture(scope="module")
def rows(spark):
    """3,000 rows: half benign, a third in one family; x is a feature."""
    return spark.range(3000).select(
        F.col("id").alias("k"),
        F.expr("CASE WHEN id % 6 < 3 THEN 0 ELSE 1 END").alias("y"),
        F.expr("CASE WHEN id % 6 < 3 THEN 'Benign' WHEN id % 6 < 5 THEN ' DDoS ' ELSE 'Bot' END").alias("family"),
        F.col("id").cast("double").alias("x"),
    ).persist()


def parts_of(df):
    return {r["k"]: r["part"] for r in df.select("k", "part").collect()}


def test_sizes_are_exact_and_parts_complete(rows):
    parts = splits.random_parts(rows, KEY, 0.2, 42, "y")
    counts = {(r["part"], r["y"]): r["count"] for r in parts.groupBy("part", "y").count().collect()}
    assert counts == {("test", 0): 300, ("test", 1): 300, ("train", 0): 1200, ("train", 1): 1200}


def test_largest_remainder(spark):
    df = spark.range(101).select(F.col("id").alias("k"), F.expr("CASE WHEN id < 33 THEN 'a' WHEN id < 66 THEN 'b' ELSE 'c' END").alias("y"))
    tests = splits.random_parts(df, KEY, 0.2, 1, "y").where("part = 'test'")
    # ceil(101 * 0.2) = 21 rows: shares 6.86, 6.86 and 7.28, so a and b get the rows left over.
    assert {r["y"]: r["count"] for r in tests.groupBy("y").count().collect()} == {"a": 7, "b": 7, "c": 7}


def test_layout_does_not_matter(rows):
    first = parts_of(splits.random_parts(rows, KEY, 0.2, 42, "y"))
    again = parts_of(splits.random_parts(rows.repartition(13).orderBy(F.desc("x")), KEY, 0.2, 42, "y"))
    assert first == again
    assert first != parts_of(splits.random_parts(rows, KEY, 0.2, 43, "y"))


def test_whole_space_search_gives_the_same_cut(rows):
    stratum = splits._stratum_of("y")
    quotas = splits.settle(splits.share_rows(splits.strata_counts(rows, stratum), F.ceil(F.col("_all") * 0.2)))
    narrow = {r["stratum"]: r["cut"] for r in splits.hash_cuts(rows, KEY, 42, stratum, quotas).collect()}
    whole = {r["stratum"]: r["cut"] for r in splits._whole_space_cuts(rows, KEY, 42, stratum, quotas).collect()}
    hashes = rows.select(stratum.alias("s"), splits.row_hash(KEY, 42).alias("h"))
    for s in narrow:
        inside = [hashes.where((F.col("s") == s) & (F.col("h") <= cuts[s])).count() for cuts in (narrow, whole)]
        assert inside == [300, 300]


def test_copies_of_a_key_stay_together(spark):
    # A third of the rows share one key.
    df = spark.range(3000).select(F.expr("CASE WHEN id % 3 = 0 THEN 7 ELSE id END").alias("k"), F.lit(1).alias("y"))
    for seed in range(4):
        parts = splits.random_parts(df, KEY, 0.5, seed)
        assert parts.count() == 3000
        assert parts.where("k = 7").select("part").distinct().count() == 1
        assert parts.where("part = 'test'").count() <= 1500


def test_holdout(rows):
    parts = splits.holdout_parts(rows, KEY, "y", "family", "ddos")
    counts = {(r["part"], r["family"]): r["count"] for r in parts.groupBy("part", "family").count().collect()}
    assert counts == {("train", "Benign"): 1200, ("test", "Benign"): 300, ("test", " DDoS "): 1000, ("train", "Bot"): 500}


def test_holdout_guards(rows):
    with pytest.raises(splits.SplitError, match="no rows"):
        splits.holdout_parts(rows, KEY, "y", "family", "worm")
    with pytest.raises(splits.SplitError, match="not attacks"):
        splits.holdout_parts(rows, KEY, "y", "family", "benign")
    with pytest.raises(splits.SplitError, match="no such group"):
        splits.holdout_parts(rows, KEY, "y", "nothing", "benign")


def test_caps(rows):
    assert splits.cap_rows(rows, KEY, 5000, label="y").count() == 3000
    capped = splits.cap_rows(rows, KEY, 100, label="family").groupBy("family").count()
    assert {r["family"]: r["count"] for r in capped.collect()} == {"Benign": 50, " DDoS ": 33, "Bot": 17}
    with pytest.raises(splits.SplitError):
        splits.cap_rows(rows, KEY, 0)


def test_balanced_and_fitting(rows):
    balanced = splits.balanced_rows(rows, KEY, "family", 600).groupBy("family").count()
    assert {r["count"] for r in balanced.collect()} == {200}
    assert splits.balanced_rows(rows, KEY, "family").count() == 1500
    with pytest.raises(splits.SplitError):
        splits.balanced_rows(rows, KEY, "family", 3000)
    parts = splits.fitting_parts(rows, KEY)
    assert parts.where("part = 'validation'").count() == 300
    assert splits.fitting_parts(rows.limit(2), KEY).where("part = 'validation'").count() == 1
    with pytest.raises(splits.SplitError):
        splits.fitting_parts(rows.limit(1), KEY)


def test_argument_checks(rows):
    for bad in (0.0, 1.0, -1):
        with pytest.raises(splits.SplitError):
            splits.checked_random_parts(rows, KEY, bad, label="y")
    with pytest.raises(splits.SplitError):
        splits.checked_random_parts(rows, KEY, method="sorted", label="y")
    with pytest.raises(splits.SplitError):
        splits.checked_random_parts(rows.limit(1), KEY, label="y")
    with pytest.raises(NotImplementedError):
        splits.split_parts(rows, "y", SplitSpec("x", "by_day", row_key=("k",)))


def test_folds_cover_all_rows(rows):
    counts = [r["count"] for r in splits.folds(rows, KEY, 5).groupBy("fold").count().collect()]
    assert len(counts) == 5 and sum(counts) == 3000 and min(counts) > 480


def test_saved_membership(rows, tmp_path):
    spec = SplitSpec("s1", row_key=("k",))
    saved, made = saved_membership(rows, "y", spec, str(tmp_path))
    again, made_again = saved_membership(rows, "y", SplitSpec("s1", fraction=0.5, row_key=("k",)), str(tmp_path))
    assert made and not made_again
    train, test = splits.apply_membership(rows, again, KEY)
    assert (train.count(), test.count()) == (2400, 600)
    with pytest.raises(splits.SplitError, match="lacks"):
        splits.apply_membership(rows.where("k > 5"), saved, KEY)
    with pytest.raises(splits.SplitError, match="no rows in"):
        splits.apply_membership(rows, saved.where("part = 'test'"), KEY)


def test_prepared_split(spark, rows, tmp_path):
    raw = rows.select(
        F.col("k"), F.col("family").alias("ClassLabel"), F.col("family").alias("Label"),
        F.expr("CASE WHEN k % 100 = 0 THEN 'oops' ELSE CAST(x AS STRING) END").alias("Flow Bytes/s"),
    )
    split = prepare_split(
        raw,
        DatasetSpec("d", label="Label", drop=("class",)),
        FeatureSet("f", ("Flow Bytes/s",)),
        SplitSpec("h", "attack_family_holdout", row_key=("k",), group="original_label", holdout="DDoS"),
    )
    assert split.rows.columns == ["flow_bytes_s", "label", "part"]
    meta = split.metadata().first()
    assert meta["source_rows"] == 3000 and meta["dropped_rows"] == 30
    assert meta["train_rows"] + meta["test_rows"] == meta["prepared_rows"] == 2970
    assert meta["test_label_distribution"]["1"] == rows.where("family = ' DDoS ' AND k % 100 <> 0").count()

    folder = sinks.write_prepared(split.rows, split.metadata(), str(tmp_path), "h")
    train, test = sinks.read_prepared(spark, folder)
    assert (train.count(), test.count()) == (meta["train_rows"], meta["test_rows"])
    with pytest.raises(sinks.SinkError, match="exists"):
        sinks.write_prepared(split.rows, None, str(tmp_path), "h")
    sinks.write_prepared(split.rows, split.metadata(), str(tmp_path), "h", overwrite=True)
    for bad in ("../elsewhere", "/etc", "."):
        with pytest.raises(sinks.SinkError, match="does not lie"):
            sinks.under_root(str(tmp_path), bad)
