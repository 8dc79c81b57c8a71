"""Every detector, saved here and loaded by another process, scores row by row the same."""

import os
import random
import subprocess
import sys

import numpy as np
import pytest

from flowbench.operators.anomaly import ClusterDetector, EnergyDetector
from flowbench.operators.baseline import MajorityBaseline
from flowbench.operators.boosting import AdaBoost
from flowbench.operators.deeptrees import DeepForest
from flowbench.operators.encoders import EncodedNet, ReconstructionDetector
from flowbench.operators.gaussian import GaussianNaiveBayes, LinearDiscriminant
from flowbench.operators.kernels import KernelSvm
from flowbench.operators.landmarks import LandmarkSvm
from flowbench.operators.leafwise import LeafWiseBoosting
from flowbench.operators.learners import encoded_softmax, linear_svm, random_forest, softmax
from flowbench.operators.neighbours import NearestNeighbours
from flowbench.operators.nets import Network, Training
from flowbench.sources.detectors import load_detector, save_detector

CELLS = ["a", "b", "c"]
QUICK = Training(epochs=2, steps=2)
DETECTORS = [
    MajorityBaseline(), GaussianNaiveBayes(), LinearDiscriminant(), AdaBoost(rounds=4), NearestNeighbours(k=3), ClusterDetector(starts=1), EnergyDetector(encoding=2),
    KernelSvm(size=6, iterations=5), softmax(5), random_forest(2, 3), linear_svm(iterations=5), encoded_softmax(2, 3), LandmarkSvm(landmarks=20, rounds=3), DeepForest(trees=3),
    LeafWiseBoosting(rounds=3), LeafWiseBoosting.by_level(rounds=2), Network((4,), QUICK), EncodedNet((3,), training=QUICK),
    EncodedNet.deep(hidden=(3, 2), training=QUICK), ReconstructionDetector((2,), training=QUICK),
]
OTHER = """
import sys
sys.path.insert(0, {root!r})
from flowbench.session import build_session
from flowbench.sources.detectors import load_detector
spark = build_session("other", "local[4]", 4, {{"spark.ui.showConsoleProgress": "false"}})
rows = spark.read.parquet({folder!r} + "/rows")
for name in {names!r}:
    load_detector(spark, {folder!r} + "/" + name, name).score(rows).write.parquet({folder!r} + "/scored-" + name)
"""


def same(x, y):
    x, y = (np.asarray(getattr(v, "toArray", lambda v=v: v)(), dtype=object) for v in (x, y))
    return x.shape == y.shape and all(u == v or (isinstance(u, float) and abs(u - v) < 1e-9) or (u != u and v != v) for u, v in zip(x.ravel(), y.ravel()))


def test_every_detector_in_another_process(spark, tmp_path):
    rng = random.Random(4)
    cells = [(i, rng.gauss(0, 1), rng.choice([None, 1.0, 2.5]), float(rng.randrange(9))) for i in range(240)]
    rows = spark.createDataFrame([(*r, int((r[1] + (r[2] or 0) > 0.8) != (rng.random() < 0.05))) for r in cells], "id int, a double, b double, c double, y int")
    rows.coalesce(1).write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows")
    before = {}
    for detector in DETECTORS:
        fitted = detector.fit(rows, CELLS, "y")
        save_detector(spark, fitted, detector.name, f"{tmp_path}/{detector.name}")
        before[detector.name] = {r["id"]: r.asDict() for r in fitted.score(rows).collect()}
    text = OTHER.format(root=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), folder=str(tmp_path), names=list(before))
    said = subprocess.run([sys.executable, "-c", text], timeout=300, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr[-3000:]
    for name, expected in before.items():
        after = {r["id"]: r.asDict() for r in spark.read.parquet(f"{tmp_path}/scored-{name}").collect()}
        assert after.keys() == expected.keys() and len(after) == 240
        for i, row in after.items():
            assert row.keys() == expected[i].keys() and all(same(row[c], expected[i][c]) for c in row), (name, row, expected[i])
    with pytest.raises(ValueError):
        load_detector(spark, f"{tmp_path}/majority", "softmax")


def test_what_cannot_be_saved_or_loaded(spark, tmp_path):
    with pytest.raises(TypeError):
        save_detector(spark, object(), "any", f"{tmp_path}/any")
    spark.createDataFrame([('{"kind": "any", "detector": {"is": "Popen", "state": {}}}',)], "about string").write.json(f"{tmp_path}/odd/about")
    with pytest.raises(ValueError):
        load_detector(spark, f"{tmp_path}/odd")
