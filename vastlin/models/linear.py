"""Linear regression; the intercept is fitted as a coefficient."""

from __future__ import annotations

import numpy as np
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vastlin.functions import summary
from vastlin.models import base
from vastlin.models.logistic import with_margins


class LinearRegression(base.Params):
    def fit(self, df: DataFrame) -> LinearRegressionModel:
        data = base.prepare(df, self)
        try:
            mean, std = summary.label_moments(data.rows)
            if not std > 0:
                raise ValueError("the label has no spread")
            fitted = base.fit("linear", data, self, 1, mean / std, std)
        finally:
            data.rows.unpersist()
        return LinearRegressionModel(fitted.coefficients[:, 0], fitted.intercept, dict(self.params), fitted.history, fitted.state.flag)


class LinearRegressionModel:
    def __init__(self, coefficients: np.ndarray, intercept: float, params: dict, history: list[float] | None = None, flag: int = 0):
        self.coefficients, self.intercept, self.params = DenseVector(coefficients), intercept, base.DEFAULTS | params
        self.objectiveHistory, self.flag = history or [], int(flag)

    @property
    def numFeatures(self) -> int:
        return len(self.coefficients)

    def transform(self, df: DataFrame) -> DataFrame:
        out = with_margins(df, self.params["featuresCol"], self.coefficients.toArray(), "_margin")
        return out.withColumn(self.params["predictionCol"], F.col("_margin") + self.intercept).drop("_margin")

    def predict(self, features) -> float:
        return float(features.dot(self.coefficients)) + self.intercept

    def save(self, path: str, spark: SparkSession) -> None:
        base.save(path, spark, "linear", self.params, {"coefficients": self.coefficients.toArray(), "intercept": np.array([self.intercept])})

    @classmethod
    def load(cls, path: str, spark: SparkSession) -> LinearRegressionModel:
        params, a = base.load(path, spark, "linear")
        return cls(a["coefficients"], float(a["intercept"][0]), params)
