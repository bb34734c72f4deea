"""Multinomial logistic regression without intercepts."""

from __future__ import annotations

import numpy as np
from pyspark.ml.linalg import DenseMatrix, DenseVector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vastlin.functions import scalar
from vastlin.models import base
from vastlin.models.logistic import with_margins


class SoftmaxRegression(base.Params):
    def fit(self, df: DataFrame) -> SoftmaxRegressionModel:
        data = base.prepare(df, self)
        try:
            most, invalid = data.rows.agg(F.max("label"), F.count_if((F.col("label") < 0) | (F.col("label") != F.floor("label")))).first()
            if invalid:
                raise ValueError("labels must be whole numbers from 0")
            fitted = base.fit("softmax", data, self, int(most) + 1)
        finally:
            data.rows.unpersist()
        return SoftmaxRegressionModel(fitted.coefficients.T, dict(self.params), fitted.history, fitted.state.flag)


class SoftmaxRegressionModel:
    def __init__(self, matrix: np.ndarray, params: dict, history: list[float] | None = None, flag: int = 0):
        self.matrix, self.params = np.asarray(matrix, float), base.DEFAULTS | params
        self.objectiveHistory, self.flag = history or [], int(flag)

    @property
    def coefficientMatrix(self) -> DenseMatrix:
        return DenseMatrix(*self.matrix.shape, self.matrix.ravel(order="F"))

    @property
    def interceptVector(self) -> DenseVector:
        return DenseVector(np.zeros(len(self.matrix)))

    @property
    def numClasses(self) -> int:
        return self.matrix.shape[0]

    @property
    def numFeatures(self) -> int:
        return self.matrix.shape[1]

    def transform(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.functions import array_to_vector

        p = self.params
        out = with_margins(df, p["featuresCol"], self.matrix.T, "_margins").withColumn("_p", scalar.softmax(F.col("_margins")))
        if p["rawPredictionCol"]:
            out = out.withColumn(p["rawPredictionCol"], array_to_vector("_margins"))
        if p["probabilityCol"]:
            out = out.withColumn(p["probabilityCol"], array_to_vector("_p"))
        if p["predictionCol"]:
            scaled = F.col("_p")
            if p["thresholds"]:
                t = F.array(*[F.lit(float(x)) for x in p["thresholds"]])
                scaled = F.zip_with("_p", t, lambda a, b: F.when(b == 0, F.when(a == 0, 0.0).otherwise(float("inf"))).otherwise(a / F.nullif(b, F.lit(0.0))))
            out = out.withColumn(p["predictionCol"], (F.array_position(scaled, F.array_max(scaled)) - 1).cast("double"))
        return out.drop("_margins", "_p")

    def save(self, path: str, spark: SparkSession) -> None:
        base.save(path, spark, "softmax", self.params, {"matrix": self.matrix})

    @classmethod
    def load(cls, path: str, spark: SparkSession) -> SoftmaxRegressionModel:
        params, a = base.load(path, spark, "softmax")
        return cls(a["matrix"], params)
