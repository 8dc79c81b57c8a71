"""Any fitted detector as a folder: plain state as one row of JSON, tables as Parquet, MLlib models in their own format.

    <folder>/about          one row: kind and state; tables and models appear there by the number of their part
    <folder>/parts/<n>      a table or a model

State is what the detector's dataclass holds. Only classes listed in ``_classes`` are read back, so a folder cannot name others.
"""

from __future__ import annotations

import base64
import dataclasses
import json
import math
from typing import Any

import numpy as np
from pyspark.ml import Model, PipelineModel
from pyspark.sql import DataFrame, SparkSession


def _classes() -> dict[str, type]:
    """Classes that a saved detector may consist of, by the name in the folder."""
    from flowbench.operators import anomaly, baseline, boosting, deeptrees, encoders, energy, gaussian, kernels, landmarks, leafwise, learners, neighbours, nets, rules

    found = (
        baseline.FittedMajority, gaussian.FittedNaiveBayes, gaussian.FittedDiscriminant, boosting.FittedAdaBoost, boosting.Stump,
        neighbours.FittedNeighbours, neighbours.NearestNeighbours, anomaly.FittedClusters, anomaly._OneCluster, anomaly.FittedEnergy,
        energy.EnergyRule, rules.CalibratedRules, kernels.FittedKernelSvm, kernels.FourierFeatures, learners.FittedLearner,
        leafwise.FittedBoosting, leafwise.Tree, landmarks.FittedLandmarks, landmarks.Kernel, deeptrees.FittedForest, deeptrees.Part, nets.FittedNet, encoders.FittedEncoder, encoders.FittedReconstruction,
    )
    return {c.__name__.lstrip("_"): c for c in found}


class _Writer:
    def __init__(self, path: str):
        self.path, self.parts = path, 0

    def _part(self) -> str:
        self.parts += 1
        return f"{self.path}/parts/{self.parts - 1}"

    def plain(self, value: Any) -> Any:
        """The value in terms of JSON; whatever JSON lacks is an object that names its kind."""
        if isinstance(value, np.generic):
            value = value.item()
        if value is None or isinstance(value, (bool, int, str)):
            return value
        if isinstance(value, float):
            return value if math.isfinite(value) else {"float": repr(value)}
        if isinstance(value, np.ndarray):
            return {"array": value.dtype.str, "shape": list(value.shape), "bytes": base64.b64encode(np.ascontiguousarray(value).tobytes()).decode()}
        if isinstance(value, (list, tuple)):
            items = [self.plain(v) for v in value]
            return items if isinstance(value, list) else {"tuple": items}
        if isinstance(value, dict):
            return {"pairs": [[self.plain(k), self.plain(v)] for k, v in value.items()]}
        if isinstance(value, DataFrame):
            at = self.parts
            value.write.parquet(self._part())
            return {"table": at, "schema": value.schema.json()}
        if isinstance(value, Model):
            at = self.parts
            whole = value if isinstance(value, PipelineModel) else PipelineModel([value])
            whole.write().save(self._part())
            return {"model": at, "alone": not isinstance(value, PipelineModel)}
        name = type(value).__name__.lstrip("_")
        if _classes().get(name) is type(value):
            return {"is": name, "state": {f.name: self.plain(getattr(value, f.name)) for f in dataclasses.fields(value)}}
        raise TypeError(f"{type(value).__name__} cannot be saved")


def save_detector(spark: SparkSession, fitted: Any, kind: str, path: str) -> None:
    """Writes the detector; an existing folder is an error. The description is written last: without it the folder does not load."""
    state = _Writer(path).plain(fitted)
    spark.createDataFrame([(json.dumps({"kind": kind, "detector": state}),)], "about string").coalesce(1).write.json(f"{path}/about")


def load_detector(spark: SparkSession, path: str, kind: str | None = None) -> Any:
    """The detector of a folder; another kind than the expected one is an error."""
    from pyspark.sql.types import StructType

    about = json.loads(spark.read.schema("about string").json(f"{path}/about").first()[0])
    if kind is not None and about["kind"] != kind:
        raise ValueError(f"the folder holds {about['kind']!r}, not {kind!r}")
    classes = _classes()

    def value(v: Any) -> Any:
        if isinstance(v, list):
            return [value(x) for x in v]
        if not isinstance(v, dict):
            return v
        if "float" in v:
            return float(v["float"])
        if "array" in v:
            return np.frombuffer(base64.b64decode(v["bytes"]), v["array"]).reshape(v["shape"])
        if "tuple" in v:
            return tuple(value(x) for x in v["tuple"])
        if "pairs" in v:
            return {value(k): value(x) for k, x in v["pairs"]}
        if "table" in v:
            return spark.read.schema(StructType.fromJson(json.loads(v["schema"]))).parquet(f"{path}/parts/{v['table']}")
        if "model" in v:
            whole = PipelineModel.load(f"{path}/parts/{v['model']}")
            return whole.stages[0] if v["alone"] else whole
        if v.get("is") not in classes:
            raise ValueError(f"unknown class {v.get('is')!r} in a saved detector")
        return classes[v["is"]](**{k: value(x) for k, x in v["state"].items()})

    return value(about["detector"])
