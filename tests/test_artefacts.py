import json

import pytest

from flowbench.functions.names import ColumnError, flatten
from flowbench.plans import results
from flowbench.sources import artefacts, sinks, tables
from flowbench.specs import DatasetSpec


def test_formats(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "i int, s string")
    df.write.parquet(str(tmp_path / "t.pq"))
    df.write.option("header", True).csv(str(tmp_path / "t.txt"))
    assert tables.read_by_suffix(spark, str(tmp_path / "t.pq")).count() == 2
    inferred = tables.read_by_suffix(spark, str(tmp_path / "t.txt"))
    assert inferred.schema["i"].dataType.typeName() == "integer" and inferred.where("s IS NULL").count() == 1
    for bad in (lambda: tables.read_table(spark, "x", "xlsx"), lambda: tables.read_by_suffix(spark, "x.json")):
        with pytest.raises(tables.SourceError):
            bad()
    with pytest.raises(tables.SourceError):
        tables.first_rows(df, 1, [])


def test_train_and_test_must_share_a_label(spark, tmp_path):
    spark.createDataFrame([(1, "a")], "x int, Label string").write.parquet(str(tmp_path / "a"))
    spark.createDataFrame([(1, "a")], "x int, class string").write.parquet(str(tmp_path / "b"))
    pair = DatasetSpec("p", label=None, train_path=str(tmp_path / "a"), test_path=str(tmp_path / "b"))
    with pytest.raises(ColumnError, match="differ"):
        tables.load_dataset(spark, pair)
    with pytest.raises(tables.SourceError):
        tables.load_dataset(spark, DatasetSpec("none"))


def write(path, record):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(record, indent=2))


def test_tree_of_run_records(spark, tmp_path):
    write(tmp_path / "r1" / "run_info.json", {"model_id": "m1", "split_id": "s1", "dataset_id": "d", "seed": 42, "model_path": "/gone/t1/model.bin", "feature_set_id": "common"})
    write(tmp_path / "t1" / "run_info.json", {"model_id": "m1", "split_id": "s0", "training_seconds": 60.0, "more": [1, 2]})
    write(tmp_path / "r1" / "metrics.json", {"accuracy": 0.9, "confusion_matrix": [[5, 1], [2, 3]], "support": {"0": 6, "1": 5}, "evaluation_seconds": 2.5, "threshold": 0.0})
    write(tmp_path / "t1" / "training_summary.json", {"label_counts": {"0": 70, "1": 10}, "training_label_counts": {}, "training_rows": 80, "full_training_rows": 100, "threshold": 0.4, "params": {"trees": "200"}})
    write(tmp_path / "splits" / "s1" / "metadata.json", {"split_id": "s1", "dataset_id": "d", "split_method": {"type": "random"}, "test_rows": 11, "train_rows": 100})
    read = {n: artefacts.read_records(spark, str(tmp_path), f"{n}.json") for n in ("run_info", "metrics", "training_summary", "metadata")}
    assert {r["run"] for r in read["run_info"].collect()} == {"r1", "t1"}
    manifest = spark.createDataFrame(
        [("e1", None, 1, "s1", "common", {"m1": "r1"})],
        "experiment_id string, name string, order int, evaluation_split_id string, feature_set_id string, runs map<string,string>",
    )
    rows = results.manifest_rows(manifest)
    assert results.manifest_problems(rows, read["run_info"], read["metrics"]).count() == 0
    models = spark.createDataFrame([("m2", "Other")], "model_id string, name string")
    final = results.final_results(rows, read["run_info"], read["metrics"], read["training_summary"], read["metadata"].drop("run"), models)
    assert len(final.columns) == 45
    row = final.first()
    assert (row["experiment_name"], row["training_run"], row["trained_on_split"], row["model_name"]) == ("e1", "t1", "s0", "")
    assert (row["training_label_0"], row["training_label_1"], row["evaluation_label_0"]) == (70, 10, 6)  # the empty map is passed over
    assert row["threshold"] == 0.0  # a zero is a value
    assert row["train_row_cap"] == 80  # fewer rows were used than there are
    assert (row["tn"], row["fp"], row["fn"], row["tp"]) == (5, 1, 2, 3)
    assert (row["training_seconds"], row["total_seconds"]) == (60.0, 62.5)
    assert row["model_configuration"] == {"trees": "200"} and row["evaluation_rows"] == 11 and row["split_method"] == "random"
    sinks.write_final(final, str(tmp_path / "final"))
    text = spark.read.option("header", True).option("escape", "\\").csv(str(tmp_path / "final" / "csv")).first()
    assert json.loads(text["model_configuration"]) == {"trees": "200"}


def test_total_time_needs_both_parts(spark, tmp_path):
    write(tmp_path / "r1" / "run_info.json", {"model_id": "m1", "split_id": "s1"})
    write(tmp_path / "r1" / "metrics.json", {"evaluation_seconds": 2.5})
    info, scores = (artefacts.read_records(spark, str(tmp_path), f"{n}.json") for n in ("run_info", "metrics"))
    rows = spark.createDataFrame([("e", "e", 1, "s1", "", "m1", "r1")], "experiment_id string, experiment_name string, experiment_order int, evaluation_split_id string, feature_set_id string, model string, run string")
    empty = spark.createDataFrame([], artefacts.TRAINING_SUMMARY + ", run string")
    splits = spark.createDataFrame([], artefacts.SPLIT_METADATA)
    models = spark.createDataFrame([], "model_id string, name string")
    row = results.final_results(rows, info, scores, empty, splits, models).first()
    assert row["training_run"] == "r1" and row["trained_on_split"] == "s1"
    assert row["total_seconds"] is None and row["num_features"] == 0 and row["threshold_tuned"] is False and row["tn"] is None
    assert results.manifest_problems(rows.withColumn("run", results.F.lit("r2")), info, scores).first()["problem"] == "run is missing"


def test_run_index_grows(spark, tmp_path):
    path = str(tmp_path / "index")
    sinks.append_runs(spark.createDataFrame([("r1", 0.5)], "run_id string, accuracy double"), path)
    sinks.append_runs(spark.createDataFrame([("r2", 0.6, 0.7)], "run_id string, accuracy double, roc_auc double"), path)
    df = sinks.read_runs(spark, path, ["run_id", "accuracy"])
    assert df.columns == ["run_id", "accuracy", "roc_auc"]
    assert {r["run_id"]: r["roc_auc"] for r in df.collect()} == {"r1": None, "r2": 0.7}


def test_flatten_keeps_odd_names(spark):
    df = spark.createDataFrame([((1, ("x",)), 2)], "`a b` struct<i:int,`n.m`:struct<s:string>>, c int")
    out = flatten(df)
    assert out.columns == ["a b.i", "a b.n.m.s", "c"] and tuple(out.first()) == (1, "x", 2)


def test_reindex_keeps_list_order(spark):
    df = spark.createDataFrame([("a", 1), ("c", 3), ("d", 4)], "m string, v int")
    assert [(r["m"], r["v"]) for r in results.reindex(df, "m", ["c", "b", "a"]).collect()] == [("c", 3), ("b", None), ("a", 1)]


def test_newest_artefact_must_exist(spark):
    df = spark.createDataFrame([("m", 1, "s", "p1", 1), ("m", 1, "s", "p2", 2)], "model_id string, seed int, split_id string, path string, modified int")
    assert results.newest_artefact(df, "m", 1).first()["path"] == "p2"
    with pytest.raises(Exception, match="no artefact"):
        results.newest_artefact(df, "m", 2).collect()


def test_records_of_one_small_file_are_written_by_many_tasks(spark, tmp_path):
    rows = spark.createDataFrame([(f"r{i}", i / 10) for i in range(40)], "run string, accuracy double").coalesce(1)
    artefacts.write_records(rows, str(tmp_path / "t"))
    files = [p.name for p in (tmp_path / "t").glob("run=*/part-*")]
    assert len(files) == 40 and len({f[:10] for f in files}) > 4
    found = artefacts.read_records(spark, str(tmp_path / "t"), "metrics.json", "part-*")
    assert {(r["run"], r["accuracy"]) for r in found.collect()} == {(f"r{i}", i / 10) for i in range(40)}
