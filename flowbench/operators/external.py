"""Scoring with a model from outside Spark: any object with ``predict`` and perhaps ``predict_proba``.

The model is loaded once per Python worker and sees batches of rows as arrays, never single rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowbench.functions.names import require_columns
from flowbench.functions.values import finite_or


@dataclass
class ExternalDetector:
    """A fitted outside model. ``load`` is called on the executors and returns it."""

    load: Callable[[], Any]
    features: Sequence[str]
    batch: int = 4096
    name: str = "external"

    def score(self, df: DataFrame) -> DataFrame:
        """Adds ``prediction`` and, if the model gives probabilities, that of the last class."""
        require_columns(df, self.features, numeric=True)
        load = self.load

        def make():
            model = load()

            def predict(rows: np.ndarray) -> dict[str, np.ndarray]:
                guess = np.asarray(model.predict(rows)).astype("int32")
                if hasattr(model, "predict_proba"):
                    p = np.asarray(model.predict_proba(rows), dtype="float64")
                    score = p[:, -1] if p.ndim == 2 else p
                else:
                    score = np.full(len(guess), np.nan)
                return {"prediction": guess, "probability": score}

            return predict

        kind = T.StructType([T.StructField("prediction", T.IntegerType()), T.StructField("probability", T.DoubleType())])
        apply = predict_batch_udf(
            make, return_type=kind, batch_size=self.batch, input_tensor_shapes=[[len(self.features)]]
        )
        scored = df.withColumn("_p", apply(F.array(*[finite_or(c) for c in self.features])))
        p = F.col("_p.probability")
        return scored.withColumns({"prediction": F.col("_p.prediction"), "probability": F.when(~F.isnan(p), p)}).drop("_p")
