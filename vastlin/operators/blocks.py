"""2-D blocks of a sparse matrix, and their products with distributed vectors.

A block is (rb, cb, num_rows, num_cols, r, c, v): parallel arrays of in-block positions, sorted by row and column. Blocks that
a grid partitioner has dealt stay where they are cached: each part is sent the vector's pieces that it needs, multiplies
in numpy and adds up per target block, and only these sums move. Other blocks are joined with the pieces on the block number.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vastlin.operators.instances import num_blocks
from vastlin.operators.storage import persisted


#: Target blocks that a task adds up before it sends them on.
TARGETS = 64


@dataclass(frozen=True)
class GridPartitioner:
    """Deals a grid of blocks in rectangles; ids run down the rectangles' rows first."""

    row_blocks: int
    col_blocks: int
    rows_per_part: int
    cols_per_part: int

    @classmethod
    def suggested(cls, row_blocks: int, col_blocks: int, partitions: int) -> GridPartitioner:
        scale = 1.0 / math.sqrt(partitions)
        return cls(row_blocks, col_blocks, int(round(max(scale * row_blocks, 1.0))), int(round(max(scale * col_blocks, 1.0))))

    @classmethod
    def requested(cls, row_blocks: int, col_blocks: int, row_parts: int, col_parts: int) -> GridPartitioner:
        return cls(row_blocks, col_blocks, row_blocks // min(row_parts, row_blocks), col_blocks // min(col_parts, col_blocks))

    @property
    def row_partitions(self) -> int:
        return num_blocks(self.rows_per_part, self.row_blocks)

    @property
    def partitions(self) -> int:
        return self.row_partitions * num_blocks(self.cols_per_part, self.col_blocks)

    def part(self, i: int, j: int) -> int:
        return i // self.rows_per_part + j // self.cols_per_part * self.row_partitions

    def column(self, rb: str = "rb", cb: str = "cb"):
        return (F.floor(F.col(rb) / self.rows_per_part) + F.floor(F.col(cb) / self.cols_per_part) * self.row_partitions).cast("int")


@dataclass(frozen=True)
class BlockMatrix:
    df: DataFrame
    rows_per_block: int
    cols_per_block: int
    rows: int
    cols: int
    grid: GridPartitioner | None = None

    @classmethod
    def of(cls, entries: DataFrame, rows: int, cols: int, rows_per_block: int, cols_per_block: int, compress: bool = False) -> BlockMatrix:
        """From (row_id, idx, value). Compression rounds values to single precision; absent blocks have no entries."""
        rb, cb = F.floor(F.col("row_id") / rows_per_block).cast("int"), F.floor(F.col("idx") / cols_per_block).cast("int")
        cell = F.struct(F.pmod("row_id", F.lit(rows_per_block)).cast("int").alias("r"), F.pmod("idx", F.lit(cols_per_block)).cast("int").alias("c"), F.col("value").alias("v"))
        df = entries.where("value <> 0").groupBy(rb.alias("rb"), cb.alias("cb")).agg(F.sort_array(F.collect_list(cell)).alias("e"))
        height = F.least(F.lit(rows_per_block), F.lit(rows) - F.col("rb") * rows_per_block).cast("int")
        width = F.least(F.lit(cols_per_block), F.lit(cols) - F.col("cb") * cols_per_block).cast("int")
        value = F.transform(F.col("e"), lambda x: x["v"].cast("float").cast("double") if compress else x["v"])
        return cls(df.select("rb", "cb", height.alias("num_rows"), width.alias("num_cols"), F.col("e.r").alias("r"), F.col("e.c").alias("c"), value.alias("v")), rows_per_block, cols_per_block, rows, cols)

    def dealt(self, grid: GridPartitioner) -> BlockMatrix:
        """Placed by a grid partitioner, with its number in ``part``."""
        placed = self.df.drop("part").withColumn("part", grid.column()).repartition(grid.partitions, "part")
        return replace(self, df=placed, grid=grid)

    def persist(self) -> BlockMatrix:
        return replace(self, df=persisted(self.df))

    def zip_columns(self, pieces: DataFrame) -> DataFrame:
        """Blocks with the vector piece (pid, values) of their columns."""
        return self.df.join(pieces.select(F.col("pid").alias("cb"), "values"), "cb")

    def zip_rows(self, pieces: DataFrame) -> DataFrame:
        return self.df.join(pieces.select(F.col("pid").alias("rb"), "values"), "rb")

    def times(self, pieces: DataFrame, classes: int = 1) -> DataFrame:
        """(pid, values) of matrix x vector by row block; a vector with ``classes`` values per column gives as many per row."""
        if self.grid:
            first = (F.floor(F.col("pid") / self.grid.cols_per_part) * self.grid.row_partitions).cast("int")
            parts = F.sequence(first, first + self.grid.row_partitions - 1)
            return _added(self._met(pieces, parts, "rb", "cb", "r", "c", "num_rows", classes))
        return _product(self.zip_columns(pieces), "rb", "r", "c", "num_rows", classes)

    def transposed_times(self, pieces: DataFrame, classes: int = 1) -> DataFrame:
        if self.grid:
            first, step = F.floor(F.col("pid") / self.grid.rows_per_part).cast("int"), self.grid.row_partitions
            parts = F.sequence(first, first + (self.grid.partitions // step - 1) * step, F.lit(step))
            return _added(self._met(pieces, parts, "cb", "rb", "c", "r", "num_cols", classes))
        return _product(self.zip_rows(pieces), "cb", "c", "r", "num_cols", classes)

    def _met(self, pieces: DataFrame, parts: Column, target: str, source: str, out: str, into: str, size: str, classes: int) -> DataFrame:
        """(pid, values): per part, the sums for each target block. Each piece is sent to the parts listed; blocks don't move."""

        def run(blocks: pa.Table, sent: pa.Table) -> pa.Table:
            found = {pid: x.values.to_numpy().reshape(-1, classes) for pid, x in zip(sent.column("pid").to_pylist(), sent.column("values"), strict=True)}
            total: dict[int, np.ndarray] = {}
            for to, by, o, i, v, n in zip(*(blocks.column(c) for c in (target, source, out, into, "v", size)), strict=True):
                if (x := found.get(by.as_py())) is not None:
                    o, i, v = (a.values.to_numpy(zero_copy_only=False) for a in (o, i, v))
                    part = np.stack([np.bincount(o, v * x[i, k], minlength=n.as_py()) for k in range(classes)], 1).ravel()
                    to = to.as_py()
                    total[to] = total[to] + part if to in total else part
            return pa.table({"pid": pa.array(list(total), pa.int32()), "values": pa.array(list(total.values()), pa.list_(pa.float64()))})

        sent = pieces.select(F.explode(parts).alias("part"), F.col("pid").cast("int").alias("pid"), "values")
        return self.df.groupBy("part").cogroup(sent.groupBy("part")).applyInArrow(run, "pid int, values array<double>")

    def scaled_columns(self, pieces: DataFrame, f: Callable[[Column, Column], Column]) -> BlockMatrix:
        """The matrix of f(value, the vector's component of its column); columns without a piece go."""
        return self._scaled(self.zip_columns(pieces), "c", f)

    def scaled_rows(self, pieces: DataFrame, f: Callable[[Column, Column], Column]) -> BlockMatrix:
        return self._scaled(self.zip_rows(pieces), "r", f)

    def _scaled(self, met: DataFrame, at: str, f: Callable[[Column, Column], Column]) -> BlockMatrix:
        value = F.zip_with("v", at, lambda v, i: f(v, F.element_at("values", i + 1)))
        return replace(self, df=met.select("rb", "cb", "num_rows", "num_cols", "r", "c", value.alias("v")), grid=None)

    def each_row(self) -> DataFrame:
        """(row_id, indices, values) of every row, empty ones too."""
        cell = F.sort_array(F.collect_list(F.struct("idx", "value")))
        found = self.entries().groupBy("row_id").agg(cell.alias("e"))
        every = self.df.sparkSession.range(self.rows).select(F.col("id").alias("row_id")).join(found, "row_id", "left")
        return every.select("row_id", F.coalesce(F.col("e.idx"), F.array().cast("array<bigint>")).alias("indices"), F.coalesce(F.col("e.value"), F.array().cast("array<double>")).alias("values"))

    def entries(self) -> DataFrame:
        """(row_id, idx, value) of the stored entries."""
        return self.df.select("rb", "cb", F.explode(F.arrays_zip("r", "c", "v")).alias("e")).select(
            (F.col("rb").cast("long") * self.rows_per_block + F.col("e.r")).alias("row_id"), (F.col("cb").cast("long") * self.cols_per_block + F.col("e.c")).alias("idx"), F.col("e.v").alias("value")
        )

    def block_nnz(self) -> DataFrame:
        return self.df.select("rb", "cb", F.size("v").alias("nnz"))

    def cell(self, i: int, j: int) -> float:
        row = self.entries().where((F.col("row_id") == i) & (F.col("idx") == j)).select("value").first()
        return row[0] if row else 0.0


def _product(joined: DataFrame, target: str, out: str, into: str, size: str, classes: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}

        def flush() -> pa.RecordBatch:
            done = pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.list_(pa.float64()))], ["pid", "values"])
            total.clear()
            return done

        for b in batches:
            for to, o, i, v, n, x in zip(*b.columns, strict=True):
                o, i, v, x = (a.values.to_numpy(zero_copy_only=False) for a in (o, i, v, x))
                n, to = n.as_py(), to.as_py()
                x = x.reshape(-1, classes)
                part = np.stack([np.bincount(o, v * x[i, k], minlength=n) for k in range(classes)], 1).ravel()
                total[to] = total[to] + part if to in total else part
                if len(total) > TARGETS:
                    yield flush()
        yield flush()

    return _added(joined.select(target, out, into, "v", size, "values").mapInArrow(run, "pid int, values array<double>"))


def _added(partial: DataFrame) -> DataFrame:
    """The sums of (pid, values) per pid."""

    def add(table: pa.Table) -> pa.Table:
        total = np.sum([x.values.to_numpy() for x in table.column("values")], axis=0)
        return pa.table({"pid": pa.array([table.column("pid")[0].as_py()], pa.int32()), "values": pa.array([total], pa.list_(pa.float64()))})

    return partial.groupBy("pid").applyInArrow(add, "pid int, values array<double>")


def split_entries(entries: DataFrame, cols_per_block: int) -> DataFrame:
    """(row_id, cb, c, value): a row's entries by column block."""
    return entries.select("row_id", F.floor(F.col("idx") / cols_per_block).cast("int").alias("cb"), F.pmod("idx", F.lit(cols_per_block)).cast("int").alias("c"), "value")


def pack_rows(instances: DataFrame, rows_per_block: int) -> DataFrame:
    """(rb, labels, weights) from (row_id, label, weight), in row order."""
    row = F.struct("row_id", "label", "weight")
    packed = instances.groupBy(F.floor(F.col("row_id") / rows_per_block).cast("int").alias("rb")).agg(F.sort_array(F.collect_list(row)).alias("e"))
    return packed.select("rb", F.col("e.label").alias("labels"), F.col("e.weight").alias("weights"))


def stack_rows(vectors: list):
    """Vectors as the rows of one sparse matrix on the driver, by rows if there are fewer rows than columns, else by columns."""
    from pyspark.ml.linalg import SparseMatrix

    cells = [(i, int(j), float(v)) for i, x in enumerate(vectors) for j, v in (zip(x.indices, x.values, strict=True) if hasattr(x, "indices") else enumerate(x.toArray())) if v]
    rows, cols = len(vectors), vectors[0].size
    by_rows = rows < cols
    cells.sort(key=lambda c: (c[0], c[1]) if by_rows else (c[1], c[0]))
    major = [c[0] if by_rows else c[1] for c in cells]
    starts = np.searchsorted(major, np.arange((rows if by_rows else cols) + 1)).tolist()
    return SparseMatrix(rows, cols, starts, [c[1] if by_rows else c[0] for c in cells], [c[2] for c in cells], by_rows)


def to_matrix(vector, num_rows: int):
    """A flat sparse vector as a column-major sparse matrix: index = row + column * num_rows; repeats add up, zeros go."""
    from pyspark.ml.linalg import SparseMatrix

    at, inverse = np.unique(np.asarray(vector.indices, np.int64), return_inverse=True)
    value = np.bincount(inverse, vector.values, minlength=len(at)) if len(at) else np.zeros(0)
    at, value = at[value != 0], value[value != 0]
    cols = -(-vector.size // num_rows)
    starts = np.searchsorted(at // num_rows, np.arange(cols + 1))
    return SparseMatrix(num_rows, cols, starts.tolist(), (at % num_rows).tolist(), value.tolist())
