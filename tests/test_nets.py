"""Nets and encoders: gradients against numeric ones, batches, early stopping, reconstruction against principal components."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowbench.operators import nets
from flowbench.operators.blocks import Blocks
from flowbench.operators.encoders import EncodedNet, Encoder, ReconstructionDetector, fit_autoencoder
from flowbench.operators.leafwise import drawn
from flowbench.operators.nets import Network, Training


def block(n, width, classes, start=0):
    rng = np.random.default_rng(start)
    return {"x": rng.normal(size=(n, width)), "y": rng.integers(0, classes, n).astype(float), "w": rng.uniform(0.5, 2, n), "row": np.arange(n, dtype=float)}


@pytest.mark.parametrize("kind,sizes,dropout", [("classes", (4, 6, 5, 3), 0.0), ("classes", (4, 6, 3), 0.4), ("cells", (4, 3, 4), 0.0), ("cells", (4, 5, 2, 5, 4), 0.0)])
def test_gradients_equal_numeric_ones(kind, sizes, dropout):
    b, settings = block(200, 4, 3), Training(steps=2, dropout=dropout, validation=0.2)
    layers = nets.new_layers(sizes, np.random.default_rng(1))
    layers = [(w, np.full(len(o), 0.05)) for w, o in layers]
    *found, mass = nets.gradient_sums(b, layers, kind, settings, 3, 1)
    rows = b["row"].astype(np.uint64)
    own = np.flatnonzero(~drawn(rows, 3, 0.5, 43) & ~drawn(rows, -1, 0.2, 42))
    assert mass[0] == pytest.approx(b["w"][own].sum()) and 40 < len(own) < 120

    def loss(changed):
        rng = np.random.default_rng([settings.seed, 3, 1, 0])  # the same units are dropped
        z = nets.forward(changed, b["x"][own], dropout, rng)[0][-1]
        return nets.class_loss(z, b["y"][own], b["w"][own])[0] if kind == "classes" else nets.square_loss(z, b["x"][own], b["w"][own])[0]

    flat = [p for layer in layers for p in layer]
    for i, p in enumerate(flat):
        for at in list(np.ndindex(p.shape))[:: max(1, p.size // 7)]:
            e = 1e-6
            ends = []
            for sign in (1, -1):
                moved = [q.copy() for q in flat]
                moved[i][at] += sign * e
                ends.append(loss([(moved[k], moved[k + 1]) for k in range(0, len(moved), 2)]))
            assert found[i][at] == pytest.approx((ends[0] - ends[1]) / (2 * e), rel=1e-4, abs=1e-5)


def test_batches_make_an_epoch_and_do_not_depend_on_blocks():
    b, settings = block(1000, 4, 2), Training(steps=5, dropout=0.0, validation=0.1)
    layers = nets.new_layers((4, 3, 2), np.random.default_rng(2))
    parts = [{k: v[i : i + 130] for k, v in b.items()} for i in range(0, 1000, 130)]
    masses = []
    for step in range(5):
        whole = nets.gradient_sums(b, layers, "classes", settings, 0, step)
        summed = [sum(p) for p in zip(*[nets.gradient_sums(p, layers, "classes", settings, 0, step) for p in parts])]
        assert all(np.allclose(a, c) for a, c in zip(whole, summed))
        masses.append(whole[-1][0])
    held = nets.loss_sums(b, layers, "classes", settings, True)[0][1]
    assert sum(masses) + held == pytest.approx(b["w"].sum())


def curved(spark, n=1500):
    """Six cells that follow from one hidden number along a curve, and a class that follows from it, too."""
    df = spark.range(n).select(((F.col("id") * 7919) % n / F.lit(n) * 4 - 2).alias("t"))
    return df.select("t", F.abs("t").alias("a"), F.greatest("t", F.lit(0.0)).alias("b"), F.abs(F.abs("t") - 1).alias("c"), (F.col("t") * F.col("t")).alias("d"), (-F.col("t")).alias("e"), (F.abs("t") > 1.1).cast("int").alias("y"))


CELLS = ["t", "a", "b", "c", "d", "e"]


def test_reconstruction_beats_principal_components(spark):
    df = curved(spark)
    fitted = Encoder((24, 2), Training(epochs=60, dropout=0.0, validation=0.1, patience=60, rate=0.02)).fit(df, CELLS)
    x = df.select(*CELLS).toPandas().to_numpy()
    x = (x - x.mean(axis=0)) / x.std(axis=0)
    values = np.linalg.svd(x, compute_uv=False) ** 2
    linear = values[2:].sum() / x.size
    energies = fitted.energy(df).agg(F.avg("energy")).first()[0]
    assert energies < linear
    codes = fitted.encode(df).select(F.size("code").alias("n")).distinct().collect()
    assert [r["n"] for r in codes] == [2]


def test_stacked_layers_and_nets_on_codes(spark):
    df = curved(spark)
    train, test = df.where("pmod(hash(t), 5) > 0"), df.where("pmod(hash(t), 5) = 0")
    quick = Training(epochs=12, rate=0.05)
    for detector in (EncodedNet((16, 8), training=quick), EncodedNet.deep(hidden=(16, 8), head=(16,), training=quick), Network((16,), quick)):
        fitted = detector.fit(train, CELLS, "y")
        hit = fitted.score(test).agg(F.avg((F.col("prediction") == F.col("y")).cast("double")), F.min("probability"), F.max("probability")).first()
        assert hit[0] > 0.9 and 0 <= hit[1] <= hit[2] <= 1, detector.name


def test_more_classes_and_early_stopping(spark):
    df = curved(spark, 600).withColumn("k", F.when(F.col("t") < -0.7, 3).when(F.col("t") < 0.6, 5).otherwise(9))
    fitted = Network((12,), Training(epochs=60, patience=3, rate=0.05)).fit(df, CELLS, "k")
    assert len(fitted.history) < 60 and fitted.classes == [3, 5, 9]
    scored = fitted.score(df).select("prediction", "k", F.size("probabilities").alias("n"), F.aggregate("probabilities", F.lit(0.0), lambda a, v: a + v).alias("sum"))
    row = scored.agg(F.avg((F.col("prediction") == F.col("k")).cast("double")), F.min("n"), F.max(F.abs(F.col("sum") - 1))).first()
    assert row[0] > 0.95 and row[1] == 3 and row[2] < 1e-9


def test_energy_of_another_curve(spark):
    """Rows off the curve have larger energies than those on it."""
    df = curved(spark)
    odd = df.withColumn("a", F.col("a") + 3).withColumn("y", F.lit(1))
    fitted = ReconstructionDetector((16, 2), training=Training(epochs=40, dropout=0.0, rate=0.02)).fit(df.withColumn("y", F.lit(0)), CELLS, "y")
    on, off = (fitted.score(rows).agg(F.avg("prediction"), F.avg("energy")).first() for rows in (df, odd))
    assert on[0] == pytest.approx(0.05, abs=0.002) and off[0] > 0.5 and off[1] > 2 * on[1]


def test_odd_tables(spark):
    df = spark.createDataFrame([(1.0, None, 0), (None, 2.0, 0), (float("nan"), float("inf"), 0)], "a double, b double, y int")
    assert {r["prediction"] for r in Network((3,), Training(epochs=2)).fit(df, ["a", "b"], "y").score(df).collect()} == {0}
    for fit in (lambda d: Network().fit(d, ["a"], "y"), lambda d: Encoder().fit(d, ["a"])):
        with pytest.raises(ValueError):
            fit(df.limit(0))


def test_blocks_are_whole(spark):
    df = spark.range(25_000).repartition(4)
    blocks = Blocks.of(df, [F.col("id"), F.col("id") * 2], {"row": F.col("id")})
    n, total, second = blocks.sums(lambda b: [np.array(len(b["x"])), b["x"].sum(axis=0), np.array((b["x"][:, 0] == b["row"]).sum())])
    assert (n, second) == (25_000, 25_000) and total.tolist() == [312_487_500, 624_975_000]
    doubled = blocks.updated(lambda b: {**b, "x": 2 * b["x"]})
    assert doubled.sums(lambda b: [b["x"].sum()])[0] == 2 * 937_462_500
    doubled.release()


def test_stacked_encoder_keeps_its_shape(spark):
    blocks = Blocks.of(curved(spark, 300), [F.col(c) for c in CELLS], {"w": F.lit(1.0), "row": F.monotonically_increasing_id()})
    encoder, decoder, history = fit_autoencoder(blocks, 6, (5, 3), Training(epochs=3, dropout=0.0), stacked=True)
    assert [w.shape for w, _ in [*encoder, *decoder]] == [(6, 5), (5, 3), (3, 5), (5, 6)] and history[-1] <= history[0]
