"""What the estimators share: parameters, preparation of the data, optimisation, and model files."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vastlin.functions import summary
from vastlin.operators.blocks import BlockMatrix, GridPartitioner, pack_rows
from vastlin.operators.dvector import DistVector, LocalVector
from vastlin.operators.instances import entries, instances, num_blocks, vector_entries, vector_size, with_any_row_index, with_row_index
from vastlin.operators.storage import persisted
from vastlin.plans.lbfgs import LBFGS, OWLQN, State
from vastlin.plans.objectives import Grid, Rows

#: Coefficients, over all classes, up to which they live on the driver when ``layout`` is "auto".
LOCAL_COEFFICIENTS = 50_000

DEFAULTS: dict[str, Any] = {
    "labelCol": "label", "featuresCol": "features", "weightCol": None, "predictionCol": "prediction", "rawPredictionCol": "rawPrediction", "probabilityCol": "probability",
    "regParam": 0.0, "elasticNetParam": 0.0, "maxIter": 100, "tol": 1e-6, "standardization": True, "fitIntercept": True, "checkpointInterval": 30, "threshold": 0.5, "thresholds": None,
    "colsPerBlock": 10_000, "rowsPerBlock": 10_000, "rowPartitions": 10, "colPartitions": 10, "eagerPersist": False, "numCorrections": 10,
    "generatingFeatureMatrixBuffer": 1000, "rowPartitionSplitNumOnGeneratingFeatureMatrix": 1, "compressFeatureMatrix": False, "layout": "auto", "rowKeys": None,
}


def snake(name: str) -> str:
    return re.sub(r"(?<!^)(?=[A-Z])", "_", name).lower()


class Params:
    """Keyword parameters in camel or snake case, with ``setX`` and ``getX`` for each."""

    def __init__(self, **given: Any):
        self.params = dict(DEFAULTS)
        names = {snake(k): k for k in DEFAULTS}
        for k, v in given.items():
            name = k if k in DEFAULTS else names.get(k)
            if name is None:
                raise TypeError(f"unknown parameter {k}")
            self._set(name, v)

    def _set(self, name: str, value: Any) -> Any:
        checks = {"colsPerBlock": 1, "rowsPerBlock": 1, "rowPartitions": 1, "colPartitions": 1, "numCorrections": 1, "generatingFeatureMatrixBuffer": 1, "rowPartitionSplitNumOnGeneratingFeatureMatrix": 1, "regParam": 0, "maxIter": 0, "tol": 0}
        if name in checks and value < checks[name]:
            raise ValueError(f"{name} must be at least {checks[name]}")
        if name == "elasticNetParam" and not 0 <= value <= 1:
            raise ValueError("elasticNetParam must be from 0 to 1")
        if name == "layout" and value not in ("auto", "local", "distributed"):
            raise ValueError("layout is auto, local or distributed")
        self.params[name] = value
        return self

    def __getattr__(self, name: str) -> Any:
        if name[:3] in ("set", "get") and len(name) > 3 and (p := name[3].lower() + name[4:]) in DEFAULTS:
            return (lambda v: self._set(p, v)) if name[:3] == "set" else (lambda: self.params[p])
        params = self.__dict__.get("params", {})
        names = {snake(k): k for k in DEFAULTS}
        if name in params:
            return params[name]
        if name in names and params:
            return params[names[name]]
        raise AttributeError(name)


@dataclass
class Data:
    """The bound training rows and what is known of them."""

    rows: DataFrame  # label, weight, features; persisted
    features: int
    total: dict[str, float]


def prepare(df: DataFrame, p: Params) -> Data:
    rows = persisted(instances(df, p.labelCol, p.featuresCol, p.weightCol), p.eagerPersist)
    total = summary.totals(rows)
    if not total["n"] or not total["w"]:
        rows.unpersist()
        raise ValueError("there is no row with weight")
    least, most = rows.agg(F.min(vector_size(F.col("features"))), F.max(vector_size(F.col("features")))).first()
    if least != most:
        rows.unpersist()
        raise ValueError(f"feature vectors have {least} to {most} components")
    return Data(rows, most, total)


def optimizer(p: Params, l1: Any | None) -> LBFGS:
    if l1 is None:
        return LBFGS(p.maxIter, p.numCorrections, p.tol)
    return OWLQN(l1, p.maxIter, p.numCorrections, p.tol)


@dataclass
class Fitted:
    coefficients: np.ndarray  # features x classes, on the data's scale
    intercept: float
    history: list[float]
    state: State


def fit(kind: str, data: Data, p: Params, classes: int = 1, intercept_init: float = 0.0, label_scale: float = 1.0, initial: np.ndarray | None = None) -> Fitted:
    """Fits on the standardized scale and brings the coefficients back (a feature without spread gets 0)."""
    with_intercept = p.fitIntercept and kind != "softmax"
    width = data.features + with_intercept
    l1, l2 = p.elasticNetParam * p.regParam / label_scale, (1 - p.elasticNetParam) * p.regParam / label_scale
    local = p.layout == "local" or (p.layout == "auto" and width * classes <= LOCAL_COEFFICIENTS)
    if local:
        return _fit_local(kind, data, p, classes, intercept_init, label_scale, with_intercept, width, l1, l2, initial)
    return _fit_grid(kind, data, p, classes, intercept_init, label_scale, with_intercept, width, l1, l2)


def _std(data: Data) -> DataFrame:
    flat = data.rows.select("weight", F.explode(vector_entries(F.col("features"))).alias("e")).select("weight", "e.idx", "e.value")
    return summary.feature_std(flat, data.total)


def _history(opt: LBFGS, objective: Any, x: Any) -> tuple[State, list[float]]:
    values, state = [], None
    for state in opt.iterations(objective, x):
        values.append(state.adjusted_value)
    return state, values


def _fit_local(kind, data, p, classes, intercept_init, label_scale, with_intercept, width, l1, l2, initial) -> Fitted:
    got = _std(data).toArrow()
    std = np.zeros(data.features)
    std[got.column("idx").to_numpy()] = got.column("std").to_numpy()
    scale = np.divide(1.0, std, out=np.zeros_like(std), where=std > 0)
    weight = np.ones_like(std) if p.standardization else scale * scale
    l1_of = np.full_like(std, l1) if p.standardization else l1 * scale
    # a feature without spread has no entries left, so its coefficient stays 0
    tail = [0.0] * with_intercept
    weight, l1_of = (np.repeat(np.concatenate((a, tail)), classes) for a in (weight, l1_of))
    rows = data.rows.where("weight > 0").select("label", "weight", vector_entries(F.col("features")).alias("entries"))
    objective = Rows.of(kind, rows, scale, width, classes, with_intercept, data.total["w"], l2, weight, label_scale, p.compressFeatureMatrix, p.rowsPerBlock)
    x = np.zeros(width * classes)
    if with_intercept:
        x[-1] = intercept_init
    if initial is not None:
        x[: data.features] = initial[: data.features] * std
        if with_intercept:
            x[-1] = initial[-1]
    state, history = _history(optimizer(p, LocalVector(l1_of) if l1 else None), objective, LocalVector(x))
    objective.close()
    raw = state.x.values.reshape(width, classes)
    coefficients = raw[: data.features] * scale[:, None] * label_scale
    return Fitted(coefficients, float(raw[-1, 0]) * label_scale if with_intercept else 0.0, history, state)


def _fit_grid(kind, data, p, classes, intercept_init, label_scale, with_intercept, width, l1, l2) -> Fitted:
    spark = data.rows.sparkSession
    kept = data.rows.where("weight > 0")
    indexed = with_row_index(kept, *p.rowKeys) if p.rowKeys else with_any_row_index(kept)
    n = int(data.total["count"])
    cols = min(p.colsPerBlock, width)
    per_row = min(p.rowsPerBlock, n)
    std = persisted(_std(data))
    cells = summary.standardized(entries(indexed), std)
    if p.compressFeatureMatrix:
        raw = BlockMatrix.of(entries(indexed), n, data.features, per_row, cols, True).entries()
        cells = summary.standardized(raw, std)
    if with_intercept:
        cells = cells.unionByName(indexed.select("row_id", F.lit(width - 1).cast("long").alias("idx"), F.lit(1.0).alias("value")))
    grid = GridPartitioner.requested(num_blocks(per_row, n), num_blocks(cols, width), p.rowPartitions, p.colPartitions)
    matrix = BlockMatrix.of(cells, n, width, per_row, cols).dealt(grid)
    matrix = matrix.persist()
    labels = persisted(pack_rows(indexed.withColumn("label", F.col("label") / label_scale), per_row))
    size, per_block = width * classes, cols * classes

    def spread(value) -> DistVector:
        """A value per feature, from std, repeated for each class; 0 for the intercept and features without spread."""
        rows = std.where("std > 0").select("idx", value.alias("value"))
        if classes > 1:
            each = rows.select("idx", "value", F.explode(F.sequence(F.lit(0), F.lit(classes - 1))).alias("k"))
            rows = each.select((F.col("idx") * classes + F.col("k")).alias("idx"), "value")
        return DistVector.from_long(rows, per_block, size).materialize()

    weight = spread(F.lit(1.0) if p.standardization else 1 / (F.col("std") * F.col("std")))
    penalty = spread(F.lit(float(l1)) if p.standardization else F.lit(float(l1)) / F.col("std")) if l1 else None
    objective = Grid(kind, matrix, labels, classes, data.total["w"], l2, weight)
    start = DistVector.zeros(spark, per_block, size, intercept_init if with_intercept else 0.0).materialize()
    state, history = _history(optimizer(p, penalty), objective, start)
    scaled = state.x.to_long().where("value <> 0")
    feature = F.floor(F.col("idx") / classes)
    back = scaled.where(feature < data.features).withColumn("f", feature).join(std.withColumnRenamed("idx", "f"), "f").where("std > 0").select("idx", (F.col("value") / F.col("std") * label_scale).alias("value")).toArrow()
    coefficients = np.zeros(data.features * classes)
    coefficients[back.column("idx").to_numpy()] = back.column("value").to_numpy()
    last = scaled.where(F.col("idx") == size - 1).select("value").first() if with_intercept else None
    objective.close()
    std.unpersist()
    for v in (weight, penalty, start, state.x, state.gradient, state.adjusted_gradient):
        if v is not None:
            v.release()
    return Fitted(coefficients.reshape(data.features, classes), float(last[0]) * label_scale if last else 0.0, history, state)


def save(path: str, spark: SparkSession, kind: str, params: dict, arrays: dict[str, np.ndarray], overwrite: bool = True) -> None:
    """One row: class, parameters as JSON, and the arrays with their shapes."""
    kept = {k: v for k, v in params.items() if v is None or isinstance(v, (str, int, float, bool, list))}
    row = [(kind, json.dumps(kept), {k: np.asarray(v, float).ravel().tolist() for k, v in arrays.items()}, {k: list(np.shape(v)) for k, v in arrays.items()})]
    frame = spark.createDataFrame(row, "kind string, params string, arrays map<string,array<double>>, shapes map<string,array<int>>")
    frame.coalesce(1).write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


def load(path: str, spark: SparkSession, kind: str) -> tuple[dict, dict[str, np.ndarray]]:
    row = spark.read.parquet(path).first()
    if row["kind"] != kind:
        raise ValueError(f"{path} holds a {row['kind']}")
    return json.loads(row["params"]), {k: np.array(v).reshape(row["shapes"][k]) for k, v in row["arrays"].items()}
