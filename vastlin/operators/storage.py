"""Materialising intermediate frames so that lineage stays short and lost executors cost a read."""

from __future__ import annotations

import logging
import tempfile
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the folder in spark.checkpoint.dir, which all executors share; only where that is unset, to a temporary one."""
    _folder(df.sparkSession)
    return df.checkpoint()


def _folder(spark: SparkSession) -> str:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="vastlin-"))
    return sc.getCheckpointDir()


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` as a table in the checkpoint folder, and its path for ``removed``: plans stay short, and a lost executor costs a read."""
    spark = df.sparkSession
    path = f"{_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a written table; a failure only leaves files behind."""
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
    except Exception:
        logging.getLogger(__name__).warning("could not delete %s", path, exc_info=True)


def with_partition_ids(df: DataFrame) -> list[tuple[int, Row]]:
    """All rows on the driver, each with the number of its partition, in their order; for small frames."""
    return [(r[0], Row(**r[1].asDict())) for r in df.select(F.spark_partition_id(), F.struct(*df.columns)).collect()]


def persisted(df: DataFrame, eager: bool = True) -> DataFrame:
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    if eager:
        df.count()
    return df


def is_persisted(df: DataFrame) -> bool:
    level = df.storageLevel
    return level.useMemory or level.useDisk


def run_all(tasks: Iterable[Any], work: Callable[[Any], Any], threads: int = 4) -> list[Any]:
    """Runs independent driver-side jobs at once and waits for all; the first failure is raised."""
    with ThreadPoolExecutor(threads) as pool:
        return list(pool.map(work, tasks))
