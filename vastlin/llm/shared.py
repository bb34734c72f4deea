"""Cutting lineage, and connected components by distributed min-label propagation."""

from __future__ import annotations

import gc
import tempfile
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: A checkpoint keeps at least ``WAVES`` partitions a core; where the session's shuffles have over twice as many, up to ``MERGED`` share a file.
WAVES, MERGED = 8, 4


def files_of(spark: SparkSession) -> int | None:
    """How many files a checkpoint is written to, if these are fewer than its partitions: each file costs each executor two processes, which set its mode and its checksum's."""
    parts, least = int(spark.conf.get("spark.sql.shuffle.partitions")), WAVES * spark.sparkContext.defaultParallelism
    return max(least, -(-parts // MERGED)) if parts > 2 * least else None


def checkpointed(df: DataFrame, files: int | None = None, merge: bool = True) -> DataFrame:
    """``df`` written to the folder in spark.checkpoint.dir, which all executors share; only where that is unset, to a temporary one.

    Partitions are merged to at most ``files``, or as ``files_of`` says; rows stay the same. Without ``merge`` they stay as they are, with their keys.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="vastlin-checkpoint-"))
    files = (files or files_of(df.sparkSession)) if merge else None
    return (df.coalesce(files) if files else df).checkpoint()


def boxed(docs: DataFrame, text: str, name: str = "_text", **columns: Column) -> DataFrame:
    """The rows of ``docs`` as one column ``_row``, but for the text, beside that and the columns given: no name of ``docs`` clashes with another."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text] or [F.lit(None).cast("int").alias("_none")]
    return docs.select(F.struct(*rest).alias("_row"), F.col(text).alias(name), *(x.alias(c) for c, x in columns.items()))


def unboxed(df: DataFrame, names: list[str], **columns: Column) -> DataFrame:
    """The columns ``names`` of ``boxed`` rows, with those given, the text among them, in place of theirs or behind them."""
    own = [columns.get(c, F.col("_row").getField(c)).alias(c) for c in names]
    return df.select(*own, *(x.alias(c) for c, x in columns.items() if c not in names))


#: Bytes of an Arrow batch; Spark's default of 64 MB is held several times over by each task, in the JVM and in Python.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's limit of an Arrow batch to ``BATCH_BYTES``, if it is higher. A longer text still is a batch of its own."""
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(limit, None)
    if now is None or not now.rstrip("b").isdigit() or not 0 < int(now.rstrip("b")) <= BATCH_BYTES:
        spark.conf.set(limit, BATCH_BYTES)


def release(df: DataFrame) -> None:
    """Lets Spark delete the shuffle files of plans that are no longer referenced; otherwise they stay until the driver happens to collect garbage."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


#: A key is hot if it has this share of all rows, so at most its inverse are; the rows of each are dealt over ``SALTS`` tasks.
HOT_SHARE, SALTS = 1e-3, 64


def hot_keys(counts: DataFrame, key: str, n: str = "n") -> DataFrame:
    """The hot keys of (key, n), which is best checkpointed as it is read twice; at most 1 / HOT_SHARE, as small as a broadcast needs."""
    total = counts.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    return counts.where(F.col(n) >= max(HOT_SHARE * total, SALTS)).select(key)


def salted_join(rows: DataFrame, facts: DataFrame, key: str, hot: DataFrame, by: Column, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``facts`` on ``key``; rows of the keys in ``hot`` are dealt by the hash of ``by``, and their facts repeated for each salt."""
    mark = F.broadcast(hot.select(F.col(key).alias("_hot_key")))
    met = lambda df: df.join(mark, F.col(key) == F.col("_hot_key"), "left")
    one, all_ = F.array(F.lit(0).cast("long")), F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))
    dealt = met(rows).withColumn("_salt", F.when(F.col("_hot_key").isNotNull(), F.pmod(F.xxhash64(by), F.lit(SALTS))).otherwise(0)).drop("_hot_key")
    spread = met(facts).withColumn("_salt", F.explode(F.when(F.col("_hot_key").isNotNull(), all_).otherwise(one))).drop("_hot_key")
    return dealt.join(spread, [key, "_salt"], how).drop("_salt")


#: Links in a file of a round's checkpoint.
LINKS = 100_000


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b), bigint: root is the smallest node reachable.

    Alternates the large-star and small-star steps (Kiveris et al., 2014), which need a logarithmic number of
    rounds in practice; each round aggregates a minimum per node first, so a hot node is combined before the shuffle,
    and the links of a hub are dealt over several tasks where they meet its minimum.
    Self-loops are ignored, repeated edges count once.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = checkpointed(now)
    links, mark = now.count(), None
    for n in count():  # each round makes progress until nothing changes
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
        hub = F.col("n") >= max(HOT_SHARE * 2 * links, SALTS)  # few, since their shares add up to one
        large = salted_join(both, least.drop("n"), "u", least.where(hub), F.col("v")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small_min = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = salted_join(large, small_min.drop("n"), "u", small_min.where(hub), F.col("v")).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v")
        now = checkpointed(small.distinct(), max(edges.sparkSession.sparkContext.defaultParallelism, -(-links // LINKS)))  # a round adds no links
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if seen == mark:
            roots = now.select("v").distinct()
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots.select(F.col("v").alias("node"), F.col("v").alias("root")))
        links, mark = seen[0], seen
        del both, least, large, small_min, small
        if n % 4 == 3:
            release(now)
