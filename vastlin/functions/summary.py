"""Weighted summaries: per-feature moments from entries, label histograms, label moments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ("mean", "variance", "count", "num_nonzeros", "max", "min", "norm_l1", "norm_l2")


def unbiased(sum_wxx: Column, sum_wx: Column, w: Column, ww: Column) -> Column:
    """Variance with reliability weights; 0 if its denominator isn't positive."""
    bottom = w - ww / w
    return F.when(bottom > 0, F.greatest((sum_wxx - sum_wx * sum_wx / w) / bottom, F.lit(0.0))).otherwise(0.0)


def totals(instances: DataFrame) -> dict[str, float]:
    """Count, sum of weights and of squared weights of rows with weight; a negative weight is an error."""
    row = instances.agg(F.count("*").alias("n"), F.count_if(F.col("weight") > 0).alias("count"), F.sum("weight").alias("w"), F.sum(F.col("weight") * F.col("weight")).alias("ww"), F.min("weight").alias("least")).first()
    if row.least is not None and row.least < 0:
        raise ValueError("weights must not be negative")
    return {"n": row.n, "count": row["count"], "w": row.w or 0.0, "ww": row.ww or 0.0}


def summarize(entries: DataFrame, total: dict[str, float], metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """(idx, one column per metric) of the entries (row_id, idx, value, weight) with value <> 0.

    Absent entries count as zeros: they pull max and min to 0 for features that some row lacks. Rows without weight
    take no part. Only the metrics asked for are computed.
    """
    unknown = set(metrics) - set(METRICS)
    if unknown:
        raise ValueError(f"unknown metrics {sorted(unknown)}")
    x, w = F.col("value"), F.col("weight")
    sums = entries.where("weight > 0 and value <> 0").groupBy("idx").agg(
        F.count("*").alias("k"), F.sum(w * x).alias("wx"), F.sum(w * x * x).alias("wxx"), F.max(x).alias("hi"), F.min(x).alias("lo"), F.sum(w * F.abs(x)).alias("l1")
    )
    lacks = F.col("k") < total["count"]
    columns = {
        "mean": F.col("wx") / total["w"] if total["w"] else F.lit(0.0),
        "variance": unbiased(F.col("wxx"), F.col("wx"), F.lit(total["w"]), F.lit(total["ww"])),
        "count": F.lit(total["count"]).cast("long"),
        "num_nonzeros": F.col("k"),
        "max": F.when(lacks, F.greatest("hi", F.lit(0.0))).otherwise(F.col("hi")),
        "min": F.when(lacks, F.least("lo", F.lit(0.0))).otherwise(F.col("lo")),
        "norm_l1": F.col("l1"),
        "norm_l2": F.sqrt("wxx"),
    }
    return sums.select("idx", *[columns[m].alias(m) for m in metrics])


def feature_std(entries: DataFrame, total: dict[str, float]) -> DataFrame:
    """(idx, std) of features with a non-zero entry; the rest have 0.

    Two passes, as a feature far from 0 would lose its variance to cancellation in one: means first, then squared
    differences, to which each absent entry adds the square of the mean.
    """
    w, bottom = total["w"], total["w"] - total["ww"] / total["w"] if total["w"] else 0.0
    kept = entries.where("weight > 0 and value <> 0")
    mean = kept.groupBy("idx").agg((F.sum(F.col("weight") * F.col("value")) / w).alias("mean"), F.sum("weight").alias("present"))
    off = F.col("value") - F.col("mean")
    apart = kept.join(mean, "idx").groupBy("idx").agg((F.sum(F.col("weight") * off * off) + (F.lit(w) - F.max("present")) * F.pow(F.max("mean"), F.lit(2.0))).alias("squares"))
    return apart.select("idx", (F.sqrt(F.greatest(F.col("squares") / bottom, F.lit(0.0))) if bottom > 0 else F.lit(0.0)).alias("std"))


def standardized(entries: DataFrame, std: DataFrame) -> DataFrame:
    """(row_id, idx, value): the entries divided by their feature's std, without features that have none."""
    return entries.join(std, "idx").where("std > 0").select("row_id", "idx", (F.col("value") / F.col("std")).alias("value"))


def label_histogram(instances: DataFrame) -> DataFrame:
    """(label, weight_sum, n) of valid labels: whole numbers from 0."""
    return instances.where((F.col("label") >= 0) & (F.col("label") == F.floor("label"))).groupBy("label").agg(F.sum("weight").alias("weight_sum"), F.count("*").alias("n"))


def invalid_labels(instances: DataFrame) -> int:
    """Rows whose label is negative, fractional or not a number."""
    return instances.where(~((F.col("label") >= 0) & (F.col("label") == F.floor("label"))) | F.isnan("label")).count()


def label_moments(instances: DataFrame) -> tuple[float, float]:
    """Weighted mean and standard deviation of the label."""
    total = totals(instances)
    if not total["w"]:
        return 0.0, 0.0
    mean = instances.agg(F.sum(F.col("weight") * F.col("label"))).first()[0] / total["w"]
    off = F.col("label") - mean
    bottom = total["w"] - total["ww"] / total["w"]
    return mean, (instances.agg(F.sum(F.col("weight") * off * off)).first()[0] / bottom) ** 0.5 if bottom > 0 else 0.0
