"""Binary logistic regression."""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.linalg import DenseVector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vastlin.functions import scalar, summary
from vastlin.models import base
from vastlin.operators.instances import vector_entries


def margin_of(features: Column, coefficients: np.ndarray) -> Column:
    """x b as a column expression over a vector column; the coefficients are a literal array."""
    b = F.array(*[F.lit(float(x)) for x in coefficients])
    return F.aggregate(vector_entries(features), F.lit(0.0), lambda s, e: s + e["value"] * F.element_at(b, (e["idx"] + 1).cast("int")))


def with_margins(df: DataFrame, features: str, coefficients: np.ndarray, name: str) -> DataFrame:
    """``df`` with x b (an array per class if there are several): expressions for few coefficients, else a vectorised map."""
    from collections.abc import Iterator

    import pyarrow as pa
    from pyspark.ml.functions import array_to_vector
    from pyspark.sql import types as T

    many = coefficients.ndim == 2
    if coefficients.size <= 2000:
        value = F.array(*[margin_of(F.col("_f"), c) for c in coefficients.T]) if many else margin_of(F.col("_f"), coefficients)
        kind = df.schema[features].dataType
        vector = array_to_vector(F.col(features).cast("array<double>")) if isinstance(kind, T.ArrayType) else F.col(features)
        return df.withColumn("_f", vector).withColumn(name, value).drop("_f")
    matrix = coefficients if many else coefficients[:, None]
    sent = df.sparkSession.sparkContext.broadcast(matrix)
    kept = [T.StructField(f.name, f.dataType) for f in df.schema.fields if f.name != features]
    if any("vector" in f.dataType.simpleString() or "matrix" in f.dataType.simpleString() for f in kept):
        raise ValueError("other vector columns must be dropped before a wide model is applied")
    kind = df.schema[features].dataType
    raw = df.withColumn("_e", vector_entries(array_to_vector(F.col(features).cast("array<double>")) if isinstance(kind, T.ArrayType) else F.col(features))).drop(features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        beta = sent.value
        for b in batches:
            e = b.column(b.num_columns - 1)
            flat, of = e.flatten(), np.repeat(np.arange(b.num_rows), np.diff(e.offsets.to_numpy()))
            idx, value = flat.field(0).to_numpy(), flat.field(1).to_numpy()
            out = np.stack([np.bincount(of, value * beta[idx, k], minlength=b.num_rows) for k in range(beta.shape[1])], 1)
            last = pa.array(list(out), pa.list_(pa.float64())) if many else pa.array(out[:, 0])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], last], [f.name for f in kept] + [name])

    return raw.mapInArrow(run, T.StructType([*kept, T.StructField(name, T.ArrayType(T.DoubleType()) if many else T.DoubleType())]))


class LogisticRegression(base.Params):
    """L-BFGS, or OWL-QN with an L1 part. Labels are 0 and 1."""

    def fit(self, df: DataFrame, initial: LogisticRegressionModel | None = None) -> LogisticRegressionModel:
        data = base.prepare(df, self)
        try:
            return self._fit(data, initial)
        finally:
            data.rows.unpersist()

    def _fit(self, data: base.Data, initial: LogisticRegressionModel | None) -> LogisticRegressionModel:
        found = {r["label"]: r["weight_sum"] for r in summary.label_histogram(data.rows).collect()}
        if summary.invalid_labels(data.rows) or max(found) > 1:
            raise ValueError("labels must be 0 and 1")
        zero, one = found.get(0.0, 0.0), found.get(1.0, 0.0)
        params = dict(self.params)
        if self.fitIntercept and not (zero and one):  # one class alone: no finite intercept
            return LogisticRegressionModel(np.zeros(data.features), math.inf if one else -math.inf, params, [])
        start = math.log(one / zero) if zero and one else 0.0
        given = None if initial is None else np.append(initial.coefficients.toArray(), initial.intercept)
        fitted = base.fit("logistic", data, self, 1, start, initial=given)
        return LogisticRegressionModel(fitted.coefficients[:, 0], fitted.intercept, params, fitted.history, fitted.state.flag)


class LogisticRegressionModel:
    """``transform`` adds raw scores, probabilities and the prediction; a column named "" is left out."""

    numClasses = 2

    def __init__(self, coefficients: np.ndarray, intercept: float, params: dict, history: list[float] | None = None, flag: int = 0):
        self.coefficients, self.intercept, self.params = DenseVector(coefficients), intercept, base.DEFAULTS | params
        self.objectiveHistory, self.flag = history or [], int(flag)

    @property
    def numFeatures(self) -> int:
        return len(self.coefficients)

    def threshold(self) -> float:
        """From ``thresholds`` (p0, p1) if set: p1 / (p0 + p1)."""
        pair = self.params["thresholds"]
        return pair[1] / (pair[0] + pair[1]) if pair else self.params["threshold"]

    def transform(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.functions import array_to_vector

        p = self.params
        out = with_margins(df, p["featuresCol"], self.coefficients.toArray(), "_margin") if math.isfinite(self.intercept) else df.withColumn("_margin", F.lit(0.0))
        out = out.withColumn("_margin", F.col("_margin") + F.lit(self.intercept))
        score = scalar.sigmoid(F.col("_margin"))
        if p["rawPredictionCol"]:
            out = out.withColumn(p["rawPredictionCol"], array_to_vector(F.array(-F.col("_margin"), F.col("_margin"))))
        if p["probabilityCol"]:
            out = out.withColumn(p["probabilityCol"], array_to_vector(F.array(scalar.sigmoid(-F.col("_margin")), score)))
        if p["predictionCol"]:
            out = out.withColumn(p["predictionCol"], (score > self.threshold()).cast("double"))
        return out.drop("_margin")

    def raw_threshold(self) -> float:
        """The margin above which the prediction is 1: the logit of the threshold."""
        t = self.threshold()
        return -math.inf if t <= 0 else math.inf if t >= 1 else math.log(t / (1 - t))

    def raw_to_prediction(self, raw) -> float:
        """From a raw prediction (-margin, margin)."""
        return float(raw[1] > self.raw_threshold())

    def predict(self, features) -> float:
        m = float(features.dot(self.coefficients)) + self.intercept
        return float((1 / (1 + math.exp(-m)) if m > -700 else 0.0) > self.threshold())

    def evaluate(self, df: DataFrame) -> dict[str, float]:
        """Weighted accuracy, log loss and area under the ROC curve of labelled rows."""
        from pyspark.ml.evaluation import BinaryClassificationEvaluator

        p = dict(self.params)
        scored = self.transform(df)
        w = F.col(p["weightCol"]) if p["weightCol"] else F.lit(1.0)
        y, q = F.col(p["labelCol"]).cast("double"), F.element_at(F.unwrap_udt(p["probabilityCol"])["values"], 2)
        row = scored.agg((F.sum(w * (y == F.col(p["predictionCol"])).cast("double")) / F.sum(w)).alias("accuracy"), (F.sum(-w * F.log(F.greatest(F.when(y > 0, q).otherwise(1 - q), F.lit(1e-15)))) / F.sum(w)).alias("log_loss")).first()
        auc = BinaryClassificationEvaluator(labelCol=p["labelCol"], rawPredictionCol=p["rawPredictionCol"]).evaluate(scored)
        return {"accuracy": row["accuracy"], "log_loss": row["log_loss"], "auc": auc}

    def coefficient_rows(self, spark: SparkSession) -> DataFrame:
        """(idx, coefficient), the intercept last."""
        values = [*self.coefficients.toArray().tolist(), float(self.intercept)]
        return spark.createDataFrame(list(enumerate(values)), "idx int, coefficient double")

    def save(self, path: str, spark: SparkSession) -> None:
        base.save(path, spark, "logistic", self.params, {"coefficients": self.coefficients.toArray(), "intercept": np.array([self.intercept])})

    @classmethod
    def load(cls, path: str, spark: SparkSession) -> LogisticRegressionModel:
        params, a = base.load(path, spark, "logistic")
        return cls(a["coefficients"], float(a["intercept"][0]), params)
