"""Objectives of generalized linear models: weighted means of losses over standardized features, with L2.

``Rows`` is for coefficients that fit on the driver: rows are packed once into cached blocks, and an evaluation is one
vectorised pass that broadcasts the coefficients (their size is checked by the caller) and adds up one gradient per partition.
``Grid`` is for more: a 2-D block matrix, coefficients and gradient as distributed vectors. Both give the same numbers.
The intercept is a last feature that is always 1; it is neither standardized nor penalised.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vastlin.operators.blocks import BlockMatrix
from vastlin.operators.dvector import DistVector, LocalVector
from vastlin.operators.storage import persisted, removed, written

LOSSES = ("logistic", "linear", "softmax")


def loss_and_multiplier(kind: str, labels: np.ndarray, weights: np.ndarray, scores: np.ndarray) -> tuple[float, np.ndarray]:
    """Summed loss, and its derivative by each score. ``scores`` is rows x classes."""
    if kind == "logistic":
        m = -scores[:, 0]
        log = np.where(m > 0, m + np.log1p(np.exp(-np.abs(m))), np.log1p(np.exp(-np.abs(m))))
        loss = weights * np.where(labels > 0, log, log - m)
        return float(loss.sum()), (weights * (1 / (1 + np.exp(np.clip(m, -700, 700))) - labels))[:, None]
    if kind == "linear":
        d = scores[:, 0] - labels
        return float((weights * d * d / 2).sum()), (weights * d)[:, None]
    top = np.maximum(scores.max(1, keepdims=True), 0)
    powers = np.exp(scores - top)
    total = powers.sum(1, keepdims=True)
    at = labels.astype(int)
    loss = weights * (np.log(total[:, 0]) + top[:, 0] - scores[np.arange(len(at)), at])
    p = powers / total
    p[np.arange(len(at)), at] -= 1
    return float(loss.sum()), weights[:, None] * p


def l2_penalty(beta: np.ndarray, l2: float, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """The penalty and its gradient; ``weight`` is 1 for penalised components on the standardized scale, 1 / std^2 otherwise."""
    return 0.5 * l2 * float((weight * beta * beta).sum()), l2 * weight * beta


@dataclass
class Rows:
    """The objective over packed rows; call it with a LocalVector."""

    kind: str
    packed: DataFrame
    features: int
    classes: int
    total_weight: float
    l2: float
    l2_weight: np.ndarray

    @classmethod
    def of(cls, kind: str, rows: DataFrame, scale: np.ndarray, features: int, classes: int, intercept: bool, total_weight: float, l2: float, l2_weight: np.ndarray, label_scale: float = 1.0, compress: bool = False, rows_per_block: int = 10_000) -> Rows:
        """From (label, weight, entries array<struct<idx,value>>). ``scale`` is 1 / std per feature, 0 to leave it out."""
        sc = rows.sparkSession.sparkContext
        sent = sc.broadcast(scale)

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, rows_per_block):
                    b = whole.slice(at, rows_per_block)
                    e = b.column(2)
                    size = np.diff(e.offsets.to_numpy())
                    flat = e.flatten()
                    idx, value = flat.field(0).to_numpy().astype(np.int64), flat.field(1).to_numpy()
                    of = np.repeat(np.arange(b.num_rows), size)
                    if compress:
                        value = value.astype(np.float32).astype(np.float64)
                    value = value * sent.value[idx]
                    keep = value != 0
                    of, idx, value = of[keep], idx[keep], value[keep]
                    if intercept:
                        n = b.num_rows
                        of, idx, value = np.concatenate((of, np.arange(n))), np.concatenate((idx, np.full(n, features - 1))), np.concatenate((value, np.ones(n)))
                    one = lambda x: pa.array([x], pa.binary())
                    yield pa.RecordBatch.from_arrays([one((b.column(0).to_numpy() / label_scale).tobytes()), one(b.column(1).to_numpy().tobytes()), one(of.astype(np.int32).tobytes()), one(idx.astype(np.int32).tobytes()), one(value.tobytes())], ["y", "w", "r", "c", "v"])

        packed = persisted(rows.select("label", "weight", "entries").mapInArrow(pack, "y binary, w binary, r binary, c binary, v binary"))
        return cls(kind, packed, features, classes, total_weight, l2, l2_weight)

    def __call__(self, x: LocalVector) -> tuple[float, LocalVector]:
        sent = self.packed.sparkSession.sparkContext.broadcast(x.values.reshape(self.features, self.classes))
        kind, classes = self.kind, self.classes

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            beta = sent.value
            loss, grad, some = 0.0, np.zeros_like(beta), False
            for batch in batches:
                for y, w, r, c, v in zip(*batch.columns, strict=True):
                    y, w, v = (np.frombuffer(a.as_buffer()) for a in (y, w, v))
                    r, c = (np.frombuffer(a.as_buffer(), np.int32) for a in (r, c))
                    scores = np.stack([np.bincount(r, v * beta[c, k], minlength=len(y)) for k in range(classes)], 1)
                    each, m = loss_and_multiplier(kind, y, w, scores)
                    loss += each
                    for k in range(classes):
                        grad[:, k] += np.bincount(c, v * m[r, k], minlength=len(grad))
                    some = True
            if some:
                yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([grad.tobytes()], pa.binary())], ["loss", "grad"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            loss, grad = 0.0, None
            for batch in batches:
                for a, g in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    g = np.frombuffer(g.as_buffer())
                    loss, grad = loss + a, g.copy() if grad is None else grad + g
            if grad is not None:
                yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([grad.tobytes()], pa.binary())], ["loss", "grad"])

        partial = self.packed.mapInArrow(run, "loss double, grad binary")
        parts = self.packed.rdd.getNumPartitions()
        while parts > 32:  # one row per partition: add them up in a tree before the driver
            parts = int(parts**0.5) + 1
            partial = partial.repartition(parts).mapInArrow(add, "loss double, grad binary")
        got = partial.collect()
        sent.unpersist()
        loss = sum(r["loss"] for r in got) / self.total_weight
        grad = sum((np.frombuffer(r["grad"]) for r in got), np.zeros(x.size)) / self.total_weight
        penalty, slope = l2_penalty(x.values, self.l2, self.l2_weight)
        return loss + penalty, LocalVector(grad + slope)

    def close(self) -> None:
        self.packed.unpersist()


@dataclass
class Grid:
    """The objective over a block matrix; call it with a DistVector of the matrix's column blocks."""

    kind: str
    matrix: BlockMatrix
    labels: DataFrame  # (rb, labels, weights)
    classes: int
    total_weight: float
    l2: float
    l2_weight: DistVector

    def __call__(self, x: DistVector) -> tuple[float, DistVector]:
        kind, classes = self.kind, self.classes

        def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                losses, values = [], []
                for y, w, s in zip(b.column(1), b.column(2), b.column(3), strict=True):
                    y, w = y.values.to_numpy(), w.values.to_numpy()
                    scores = s.values.to_numpy().reshape(-1, classes) if s.is_valid else np.zeros((len(y), classes))
                    loss, m = loss_and_multiplier(kind, y, w, scores)
                    losses.append(loss)
                    values.append(m.ravel())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(losses, pa.float64()), pa.array(values, pa.list_(pa.float64()))], ["pid", "loss", "values"])

        margins = self.matrix.times(x.df, classes).withColumnRenamed("pid", "rb")
        # a block of rows without entries has no margins and still has losses
        met = self.labels.join(margins, "rb", "left").select("rb", "labels", "weights", "values")
        multipliers, path = written(met.mapInArrow(multiply, "pid int, loss double, values array<double>"))
        loss = (multipliers.agg(F.sum("loss")).first()[0] or 0.0) / self.total_weight
        grad = self.matrix.transposed_times(multipliers.select("pid", "values"), classes)
        weight = self.total_weight
        grad = x.df.select("pid", F.col("values").alias("x")).join(grad, "pid", "left").select("pid", F.coalesce(F.transform("values", lambda v: v / weight), F.transform("x", lambda v: F.lit(0.0))).alias("values"))
        l2 = self.l2
        full = DistVector(grad, x.per_block, x.size).zip(lambda g, b, w: g + l2 * w * b, x, self.l2_weight).materialize()
        penalty = 0.5 * l2 * x.dot(x.zip(lambda a, b: a * b, self.l2_weight)) if l2 else 0.0
        removed(x.df.sparkSession, path)
        return loss + penalty, full

    def close(self) -> None:
        self.matrix.df.unpersist()
        self.labels.unpersist()
