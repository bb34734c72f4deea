"""Readers, writers and a generator of training data."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def read_libsvm(spark: SparkSession, path: str, num_features: int | None = None) -> DataFrame:
    """(label, features). Without ``num_features`` the data are read once more to find it."""
    reader = spark.read.format("libsvm")
    return (reader.option("numFeatures", num_features) if num_features else reader).load(path)


def coefficients(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal(n)


def generate(spark: SparkSession, dimension: int = 100, splits: int = 100, records_per_split: int = 100, features_per_record: int = 10, seed: int = 7, noise: float = 0.1) -> DataFrame:
    """Labelled sparse records as libsvm text, one per row in ``value``: 1-based indices, three decimals.

    A split's records depend on the seed and its number alone. Labels follow random coefficients, and a share of ``noise`` is flipped.
    """
    if not 0 < features_per_record <= dimension:
        raise ValueError("features_per_record must be from 1 to dimension")
    sent = spark.sparkContext.broadcast(coefficients(seed, dimension))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for split in b.column(0).to_pylist():
                rnd, lines = np.random.default_rng([seed, split]), []
                for _ in range(records_per_split):
                    at = np.sort(rnd.choice(dimension, features_per_record, replace=False))
                    x = rnd.standard_normal(features_per_record).round(3)
                    label = int(x @ sent.value[at] > 0) ^ int(rnd.random() < noise)
                    lines.append(f"{label} " + " ".join(f"{i + 1}:{v:.3f}" for i, v in zip(at, x, strict=True)))
                yield pa.RecordBatch.from_arrays([pa.array(lines)], ["value"])

    return spark.range(0, splits, 1, splits).mapInArrow(run, "value string")


def write_text(lines: DataFrame, path: str) -> None:
    lines.write.mode("overwrite").text(path)
