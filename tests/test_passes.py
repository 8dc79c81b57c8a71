"""Fits pass over rows that are written once, and a pass works out no more than its step needs."""

import numpy as np
import pytest
from pyspark.sql import functions as F


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_the_parts_of_learnable_rows_are_not_worked_out_again(spark, sf_dir):
    from flowbench.plans.queries_learners import learnable_parts

    train, test = learnable_parts(spark, sf_dir)
    assert all("md5" not in plan_of(df) and "Join" not in plan_of(df) for df in (train, test))
    assert train.count() > test.count() > 0 and not {r[0] for r in train.select("flow_id").collect()} & {r[0] for r in test.select("flow_id").collect()}


def one_row_group(folder, rows):
    """A file of events that Spark reads in many parts, all but one of them empty; every tenth key is null and some repeat."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    rng = np.random.default_rng(4)
    keys = [None if i % 10 == 0 else i - i % 3 for i in range(rows)]
    table = pa.table({
        "event_id": pa.array(keys, pa.int64()), "ts": pa.array(np.arange(rows), pa.timestamp("us")), "user_id": rng.integers(0, 1500, rows),
        "event_type": np.where(rng.random(rows) < 0.2, "error", "click"), "value": rng.random(rows) * 100, "props": [f'{{"k": {k}}}' for k in rng.integers(0, 100, rows)],
    })
    pq.write_table(table, f"{folder}/events.parquet", row_group_size=rows)
    return str(folder)


def rows_by_part(df):
    return [n for n in df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]


@pytest.fixture
def short_parts(spark):
    """Files are read in parts of 256 KB, as those of 128 MB are of a large one."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k in before:
        spark.conf.set(k, str(256 * 1024))
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_a_file_of_one_row_group_is_dealt_over_the_cores(spark, tmp_path, short_parts):
    from flowbench.plans.queries_learners import learnable_parts
    from flowbench.session import dealt

    cores, n = spark.sparkContext.defaultParallelism, 240_000
    folder = one_row_group(tmp_path, n)
    events = spark.read.parquet(f"{folder}/events.parquet")
    assert events.rdd.getNumPartitions() >= cores and rows_by_part(events) == [n]
    even = dealt(events, "test-dealt")
    assert max(rows_by_part(even)) * cores <= 1.5 * n and even.schema == events.schema
    assert even.exceptAll(events).isEmpty() and events.exceptAll(even).isEmpty()
    train, _ = learnable_parts(spark, folder)
    parts = rows_by_part(train)
    assert max(parts) * cores <= 1.5 * sum(parts)


def test_small_and_even_tables_are_not_dealt(spark, sf_dir):
    from flowbench.session import dealt

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    even = spark.range(2_000_000).repartition(spark.sparkContext.defaultParallelism)
    for df in (events, events.where("false"), even):
        assert dealt(df, "test-dealt") is df


def test_a_tuned_detector_reads_its_parts_from_where_they_are_written(spark):
    from flowbench.plans.experiment import tuned_threshold

    class Kept:
        def fit(self, train, features, label):
            self.plan, self.rows = plan_of(train), train.count()
            return self

        def score(self, df):
            assert "md5" not in plan_of(df)
            return df.withColumn("probability", F.col("y").cast("double"))

    detector = Kept()
    rows = spark.range(100).select(F.col("id").alias("k"), F.col("id").cast("double").alias("x"), (F.col("id") % 2).cast("int").alias("y"))
    _, threshold = tuned_threshold(detector, rows, ["x"], "y", ["k"])
    assert "md5" not in detector.plan and detector.rows == 90 and 0 < threshold < 1


def test_a_perceptron_on_blocks_comes_as_low_as_that_of_mllib(spark):
    from pyspark.ml.classification import MultilayerPerceptronClassifier, MultilayerPerceptronClassificationModel
    from pyspark.ml.functions import array_to_vector

    from flowbench.operators import perceptron

    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 3))
    y = (x[:, 0] * x[:, 1] > 0.1).astype(float) + (x[:, 2] > 1)
    df = spark.createDataFrame([(v.tolist(), float(c)) for v, c in zip(x, y)], "x array<double>, y double").select(array_to_vector("x").alias("x"), "y")
    sizes = [3, 6, 4, 3]
    block = {"x": x, "y": y}
    losses = {}
    for kind in (MultilayerPerceptronClassifier, perceptron.BlockPerceptron):
        model = kind(featuresCol="x", labelCol="y", layers=sizes, maxIter=60, seed=7).fit(df)
        assert isinstance(model, MultilayerPerceptronClassificationModel)
        loss, gradient = perceptron.loss_and_gradient(block, model.weights.toArray(), sizes)
        losses[kind.__name__] = loss[0] / 600
    assert losses["BlockPerceptron"] <= losses["MultilayerPerceptronClassifier"] * 1.1 + 0.01
    flat, e = rng.normal(size=len(gradient)), 1e-6
    gradient = perceptron.loss_and_gradient(block, flat, sizes)[1]
    for i in range(0, len(flat), 5):
        move = np.eye(len(flat))[i] * e
        ends = [perceptron.loss_and_gradient(block, flat + s * move, sizes)[0][0] for s in (1, -1)]
        assert gradient[i] == pytest.approx((ends[0] - ends[1]) / (2 * e), rel=1e-4, abs=1e-5)


def test_only_the_rows_of_a_step_are_coded(monkeypatch):
    from flowbench.operators import nets
    from flowbench.operators.nets import Training

    rng = np.random.default_rng(0)
    block = {"x": rng.normal(size=(9000, 4)), "y": np.zeros(9000), "w": np.ones(9000), "row": np.arange(9000.0)}
    before, top = nets.new_layers((4, 3), rng), nets.new_layers((3, 2), rng)
    codes = nets.forward(before, block["x"], rectified=1)[0][-1]
    settings = Training(steps=4, dropout=0.0)
    expected = nets.gradient_sums({**block, "x": codes}, top, "classes", settings, 0, 1)
    seen, plain = [], nets.forward
    monkeypatch.setattr(nets, "forward", lambda layers, x, *a, **k: seen.append(len(x)) or plain(layers, x, *a, **k))
    found = nets.gradient_sums(block, top, "classes", settings, 0, 1, before=before)
    assert all(np.allclose(a, b) for a, b in zip(found, expected)) and sum(seen) < 2 * 9000 / 3


def test_clusters_are_fitted_on_rows_that_are_not_unpacked_in_each_pass(spark, monkeypatch):
    from flowbench.operators import anomaly

    plain, seen = anomaly.KMeans.fit, []
    monkeypatch.setattr(anomaly.KMeans, "fit", lambda self, df: seen.append((df.storageLevel.useMemory, len(df.inputFiles()))) or plain(self, df))
    df = spark.range(60).select(F.col("id").cast("double").alias("x"), (F.col("id") >= 30).cast("int").alias("y"))
    fitted = anomaly.ClusterDetector(starts=2).fit(df, ["x"], "y")
    assert len(seen) == 2 and all(not held and files for held, files in seen)
    assert fitted.score(df).where("prediction = y").count() == 60
