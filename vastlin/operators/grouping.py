"""Grouping and aggregation by key, as Catalyst plans it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grouped_by_sort(df: DataFrame, key: str, value: str, partitions: int) -> DataFrame:
    """(key, values): one shuffle by key, then a sort within partitions that leaves the values in order and the groups side by side."""
    dealt = df.select(key, value).repartition(partitions, key).sortWithinPartitions(key, value)
    return dealt.groupBy(key).agg(F.sort_array(F.collect_list(value)).alias("values"))


def aggregated_by_key(df: DataFrame, key: str, *sums: Column) -> DataFrame:
    """Hash aggregation in two phases: partial results per task before the shuffle, merged behind it."""
    return df.groupBy(key).agg(*sums)
