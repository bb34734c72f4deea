"""Distributed vectors: a frame of blocks (pid, values), joined on the block number."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vastlin.functions import scalar
from vastlin.operators.instances import num_blocks
from vastlin.operators.storage import is_persisted, persisted, removed, written


@dataclass(frozen=True)
class DistVector:
    """Blocks of ``per_block`` values, the last of what remains; global index = pid * per_block + position."""

    df: DataFrame
    per_block: int
    size: int
    path: str | None = None  # of the table that holds it, if it was materialised

    def __post_init__(self) -> None:
        if self.per_block <= 0 or self.size <= 0:
            raise ValueError("sizes must be positive")

    @property
    def blocks(self) -> int:
        return num_blocks(self.per_block, self.size)

    @classmethod
    def zeros(cls, spark: SparkSession, per_block: int, size: int, last: float = 0.0) -> DistVector:
        """Zeros, but for the last component."""
        if per_block <= 0 or size <= 0:
            raise ValueError("sizes must be positive")
        n = num_blocks(per_block, size)
        tail = size - (n - 1) * per_block
        values = F.when(F.col("id") < n - 1, F.array_repeat(F.lit(0.0), per_block)).otherwise(F.concat(F.array_repeat(F.lit(0.0), tail - 1), F.array(F.lit(float(last)))))
        return cls(spark.range(n).select(F.col("id").cast("int").alias("pid"), values.alias("values")), per_block, size)

    @classmethod
    def of(cls, spark: SparkSession, values: list[float] | np.ndarray, per_block: int) -> DistVector:
        """From values on the driver."""
        values = np.asarray(values, float)
        rows = [(k, values[k * per_block : (k + 1) * per_block].tolist()) for k in range(num_blocks(per_block, len(values)))]
        return cls(spark.createDataFrame(rows, "pid int, values array<double>"), per_block, len(values))

    @classmethod
    def from_long(cls, rows: DataFrame, per_block: int, size: int) -> DistVector:
        """From (idx, value) rows; absent indices are 0, repeated ones add up."""
        n = num_blocks(per_block, size)
        pid, at = F.floor(F.col("idx") / per_block).cast("int"), F.pmod("idx", F.lit(per_block)).cast("int")
        found = rows.groupBy("idx").agg(F.sum("value").alias("value")).groupBy(pid.alias("pid")).agg(F.map_from_entries(F.collect_list(F.struct(at.alias("at"), "value"))).alias("m"))
        width = F.when(F.col("pid") < n - 1, per_block).otherwise(size - (n - 1) * per_block)
        spark = rows.sparkSession
        every = spark.range(n).select(F.col("id").cast("int").alias("pid")).join(found, "pid", "left")
        return cls(every.select("pid", F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("values")), per_block, size)

    def _with(self, df: DataFrame) -> DistVector:
        return DistVector(df, self.per_block, self.size)

    def map(self, f: Callable[[Column], Column]) -> DistVector:
        return self._with(self.df.select("pid", F.transform("values", f).alias("values")))

    def map_blocks(self, f: Callable[[Column, Column], Column]) -> DistVector:
        """``f`` of the block number and the block's array."""
        return self._with(self.df.select("pid", f(F.col("pid"), F.col("values")).alias("values")))

    def zip(self, f: Callable[..., Column], *others: DistVector) -> DistVector:
        """Component-wise ``f`` of this and other vectors of the same blocks; each join is on the block number."""
        for o in others:
            if (o.per_block, o.size) != (self.per_block, self.size):
                raise ValueError("vectors differ in size or blocks")
        joined = reduce(lambda a, b: a.join(b, "pid"), [o.df.select("pid", F.col("values").alias(f"v{k}")) for k, o in enumerate(others)], self.df)
        names = ["values", *(f"v{k}" for k in range(len(others)))]
        return self._with(joined.select("pid", F.transform(F.arrays_zip(*names), lambda z: f(*(z[n] for n in names))).alias("values")))

    def shift(self, d: float) -> DistVector:
        return self.map(lambda v: v + d)

    def scale(self, a: float) -> DistVector:
        return self.map(lambda v: v * a)

    def add(self, other: DistVector) -> DistVector:
        return self.zip(lambda x, y: x + y, other)

    def sub(self, other: DistVector) -> DistVector:
        return self.zip(lambda x, y: x - y, other)

    def axpy(self, a: float, other: DistVector) -> DistVector:
        return self.zip(lambda x, y: x + F.lit(float(a)) * y, other)

    @staticmethod
    def dots(pairs: list[tuple[DistVector, DistVector]]) -> list[float]:
        """All dot products in one job: vectors meet once per block, and one row of sums comes back."""
        if not pairs:
            return []
        distinct = list({id(v): v for p in pairs for v in p}.values())
        name = {id(v): f"v{k}" for k, v in enumerate(distinct)}
        joined = reduce(lambda a, b: a.join(b, "pid"), [v.df.select("pid", F.col("values").alias(name[id(v)])) for v in distinct])
        product = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        row = joined.agg(*[F.coalesce(F.sum(product(name[id(a)], name[id(b)])), F.lit(0.0)).alias(f"d{k}") for k, (a, b) in enumerate(pairs)]).first()
        return [float(x) for x in row]

    def dot(self, other: DistVector) -> float:
        return self.dots([(self, other)])[0]

    def norm(self) -> float:
        return self.dot(self) ** 0.5

    @staticmethod
    def combine(terms: list[tuple[float, DistVector]]) -> DistVector:
        """The linear combination of vectors: union, then one sum per block position."""
        terms = [(a, v) for a, v in terms if a != 0] or terms[:1]
        first = terms[0][1]
        if len(terms) == 1:
            return first.scale(terms[0][0])
        return first.scale(terms[0][0]).zip(lambda x, *ys: reduce(lambda s, t: s + F.lit(float(t[0])) * t[1], zip((a for a, _ in terms[1:]), ys, strict=True), x), *[v for _, v in terms[1:]])

    # the rules of the L1 optimiser
    def pseudo_gradient(self, gradient: DistVector, l1: DistVector) -> DistVector:
        return self.zip(scalar.pseudo_gradient, gradient, l1)

    def l1_value(self, l1: DistVector) -> float:
        return self.map(F.abs).dot(l1)

    def project(self, adjusted: DistVector) -> DistVector:
        return self.zip(scalar.project_direction, adjusted)

    def orthant_step(self, direction: DistVector, adjusted: DistVector, alpha: float) -> DistVector:
        return self.zip(lambda x, d, g: scalar.orthant_step(x, d, g, F.lit(float(alpha))), direction, adjusted)

    # storage
    def materialize(self) -> DistVector:
        """Written to the checkpoint folder, until ``release``."""
        df, path = written(self.df)
        return DistVector(df, self.per_block, self.size, path)

    def release(self) -> None:
        """Deletes what ``materialize`` wrote; the vector can't be read any more."""
        if self.path:
            removed(self.df.sparkSession, self.path)

    def persist(self, eager: bool = True) -> DistVector:
        return self._with(persisted(self.df, eager))

    def unpersist(self) -> None:
        self.df.unpersist()

    def is_persisted(self) -> bool:
        return is_persisted(self.df)

    def to_long(self) -> DataFrame:
        """(idx, value) of all components."""
        return self.df.select("pid", F.posexplode("values").alias("at", "value")).select((F.col("pid").cast("long") * self.per_block + F.col("at")).alias("idx"), "value")

    def nnz(self) -> int:
        return int(self.to_long().where("value <> 0").count())

    def to_numpy(self) -> np.ndarray:
        """On the driver, for sizes that it can hold."""
        return np.concatenate([np.array(r["values"]) for r in self.df.orderBy("pid").toLocalIterator()])

    def to_sparse(self):
        from pyspark.ml.linalg import Vectors

        values = self.to_numpy()
        at = np.flatnonzero(values)
        return Vectors.sparse(self.size, at.tolist(), values[at].tolist())


@dataclass(frozen=True)
class LocalVector:
    """The same operations over a numpy array on the driver, for vectors that fit there."""

    values: np.ndarray

    @property
    def size(self) -> int:
        return len(self.values)

    @staticmethod
    def dots(pairs: list[tuple[LocalVector, LocalVector]]) -> list[float]:
        return [float(a.values @ b.values) for a, b in pairs]

    def dot(self, other: LocalVector) -> float:
        return float(self.values @ other.values)

    def norm(self) -> float:
        return self.dot(self) ** 0.5

    @staticmethod
    def combine(terms: list[tuple[float, LocalVector]]) -> LocalVector:
        return LocalVector(sum(a * v.values for a, v in terms))

    def scale(self, a: float) -> LocalVector:
        return LocalVector(self.values * a)

    def sub(self, other: LocalVector) -> LocalVector:
        return LocalVector(self.values - other.values)

    def axpy(self, a: float, other: LocalVector) -> LocalVector:
        return LocalVector(self.values + a * other.values)

    def pseudo_gradient(self, gradient: LocalVector, l1: LocalVector) -> LocalVector:
        x, g, p = self.values, gradient.values, l1.values
        at_zero = np.where(g - p > 0, g - p, np.where(g + p < 0, g + p, 0.0))
        return LocalVector(np.where(p == 0, g, np.where(x != 0, g + np.sign(x) * p, at_zero)))

    def l1_value(self, l1: LocalVector) -> float:
        return float(np.abs(self.values) @ l1.values)

    def project(self, adjusted: LocalVector) -> LocalVector:
        return LocalVector(np.where(self.values * adjusted.values < 0, self.values, 0.0))

    def orthant_step(self, direction: LocalVector, adjusted: LocalVector, alpha: float) -> LocalVector:
        x = self.values
        orthant = np.where(x != 0, np.sign(x), np.sign(-adjusted.values))
        new = x + alpha * direction.values
        return LocalVector(np.where(np.sign(new) == orthant, new, 0.0))

    def materialize(self) -> LocalVector:
        return self

    def release(self) -> None:
        pass

    def to_numpy(self) -> np.ndarray:
        return self.values
