"""Training rows: binding columns, row indices, entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def instances(df: DataFrame, label: str = "label", features: str = "features", weight: str | None = None) -> DataFrame:
    """(label, weight, features): label and weight as doubles, weight 1 if unset. A null in any of them is an error."""
    kind = df.schema[features].dataType
    if isinstance(kind, T.ArrayType):
        from pyspark.ml.functions import array_to_vector

        vector = array_to_vector(F.col(features).cast("array<double>"))
    else:
        vector = F.col(features)
    bound = df.select(F.col(label).cast("double").alias("label"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("weight"), vector.alias("features"))
    null = F.col("label").isNull() | F.col("weight").isNull() | F.col("features").isNull()
    return bound.withColumn("label", F.when(null, F.raise_error("null label, weight or features")).otherwise(F.col("label")))


def vector_entries(features: Column) -> Column:
    """array<struct<idx,value>> of the non-zero entries of a vector column, dense or sparse, never made dense."""
    raw = F.unwrap_udt(features)
    dense = F.transform(raw["values"], lambda v, i: F.struct(i.cast("long").alias("idx"), v.alias("value")))
    sparse = F.zip_with(raw["indices"], raw["values"], lambda i, v: F.struct(i.cast("long").alias("idx"), v.alias("value")))
    return F.filter(F.when(raw["type"] == 0, sparse).otherwise(dense), lambda e: e["value"] != 0)


def vector_size(features: Column) -> Column:
    raw = F.unwrap_udt(features)
    return F.when(raw["type"] == 0, raw["size"]).otherwise(F.size(raw["values"]))


def entries(rows: DataFrame) -> DataFrame:
    """(row_id, idx, value, weight) from (row_id, weight, features)."""
    return rows.select("row_id", "weight", F.explode(vector_entries(F.col("features"))).alias("e")).select("row_id", "e.idx", "e.value", "weight")


def partition_sizes(df: DataFrame) -> DataFrame:
    """(part, n): rows of each partition that has some."""
    return df.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n"))


def with_row_index(df: DataFrame, *keys: str, name: str = "row_id") -> DataFrame:
    """Consecutive indices from 0 in the order of ``keys``, without one task that sorts everything.

    Rows are dealt by range, indexed within their range, and the ranges' sizes (one number each) give the starts. The keys
    should identify a row; rows that agree in all of them come in any order.
    """
    from pyspark.sql import Window

    from vastlin.operators.storage import checkpointed

    local = Window.partitionBy("_part").orderBy(*keys)
    dealt = df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id())
    # written once: a second run of the range sampling could deal the rows differently
    ranked = checkpointed(dealt.withColumn("_in", F.row_number().over(local)))
    sizes = ranked.groupBy("_part").agg(F.count("*").alias("n"))
    starts = sizes.select("_part", (F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).alias("_start"))
    return ranked.join(F.broadcast(starts), "_part").withColumn(name, F.coalesce("_start", F.lit(0)) + F.col("_in") - 1).drop("_part", "_in", "_start")


def with_any_row_index(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Consecutive indices from 0 in the order of partitions, without a shuffle: a partition's start and the place in it.

    The rows are written first, as their partitions must stay what they are between counting and numbering.
    """
    from pyspark.sql import Window

    from vastlin.operators.storage import checkpointed

    low = 1 << 33  # monotonically_increasing_id: the partition above this, the place in it below
    at = checkpointed(df.withColumn("_at", F.monotonically_increasing_id()))
    part = F.floor(F.col("_at") / low)
    sizes = at.groupBy(part.alias("_part")).agg(F.count("*").alias("n"))
    starts = sizes.select("_part", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    placed = at.withColumn("_part", part).join(F.broadcast(starts), "_part")  # a row per partition
    return placed.withColumn(name, F.col("_start") + F.pmod("_at", F.lit(low))).drop("_part", "_at", "_start")


def num_blocks(per_block: int, n: int) -> int:
    return (n - 1) // per_block + 1
