"""Embedding near-duplicates: random-hyperplane sign hashing in several tables, exact cosines, connected components.

Equal vectors become one group first. Each group's vector goes to one bucket per table (the signs of ``bits``
projections). The number of bits follows the number of groups, so buckets keep their mean size, and the number of tables
follows from the recall wanted for a pair right at the threshold; both behave alike at every size.

A bucket is compared by matrix products in blocks. A bucket of more than ``BLOCK`` groups is dealt into blocks, and each pair of
blocks is a task of its own, so a hot bucket spreads over the cluster. A pair that meets in several tables
counts in the first one, which the signatures that travel with the vectors tell. Tasks return numbers of links and one edge per
group and block component, never pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vastlin.llm.shared import checkpointed, components

THRESHOLD = 0.95
#: Wanted share of the pairs at the threshold that meet in some table.
RECALL = 0.999
#: Mean groups in a bucket that the bits aim at, and groups in a block.
BUCKET, BLOCK = 64, 1024


def plan(groups: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """(bits, tables) for a number of groups."""
    bits = min(30, max(4, round(math.log2(max(groups, 2) / BUCKET))))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - meet)))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    big = np.abs(x).max(1, keepdims=True)
    x = x / np.where(big > 0, big, 1)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def signatures(vectors: DataFrame, dimension: int, bits: int, tables: int, seed: int = 5) -> DataFrame:
    """(vec, embedding, size) with the bucket of every table."""
    planes = np.random.default_rng(seed).standard_normal((dimension, bits * tables))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = 1 << np.arange(bits)
        for batch in batches:
            if batch.num_rows:
                sign = (_unit(_matrix(batch.column(1))) @ planes > 0).reshape(batch.num_rows, tables, bits)
                code = (sign * weight).sum(2).astype(np.int32)
                off = pa.array(np.arange(0, code.size + 1, tables, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(off, pa.array(code.ravel()))], ["vec", "embedding", "size", "codes"])

    kind = vectors.schema["embedding"].dataType.simpleString()
    return vectors.select("vec", "embedding", "size").mapInArrow(run, f"vec long, embedding {kind}, size long, codes array<int>")


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest index connected to each of n, over edges (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def compare(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (table, code, left, right, side, vec): links of every vector and an edge to its block component."""
    held: list[tuple[np.ndarray, ...]] = []
    of: tuple | None = None

    def emit() -> Iterator[pa.RecordBatch]:
        t, _, left, right = of
        vec, x, size, codes, side = (np.concatenate(c) for c in zip(*held, strict=True))
        if len(vec) < 2:
            return
        x = _unit(x)
        links = np.zeros(len(vec), np.int64)
        one = np.flatnonzero(side == 0)
        two = one if left == right else np.flatnonzero(side == 1)
        froms, tos = [], []
        for at in range(0, len(one), 256):
            rows = one[at : at + 256]
            i, j = np.nonzero(x[rows] @ x[two].T >= threshold - 1e-9)
            i, j = rows[i], two[j]
            ok = i < j if left == right else np.ones(len(i), bool)
            i, j = i[ok], j[ok]
            # exact in double precision, whatever the product's order of sums
            ok = np.einsum("ij,ij->i", x[i], x[j]) >= threshold
            for k in range(t):
                ok[ok] = codes[i[ok], k] != codes[j[ok], k]
            i, j = i[ok], j[ok]
            np.add.at(links, i, size[j])
            np.add.at(links, j, size[i])
            froms.append(i)
            tos.append(j)
        i, j = np.concatenate(froms) if froms else np.zeros(0, int), np.concatenate(tos) if tos else np.zeros(0, int)
        low = _forest(i, j, len(vec))
        use = np.flatnonzero(links)
        yield pa.RecordBatch.from_arrays([pa.array(vec[use]), pa.array(links[use]), pa.array(vec[low[use]])], ["vec", "links", "to"])

    for batch in batches:
        if not batch.num_rows:
            continue
        names = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(4)], 1)
        cut = np.flatnonzero((names[1:] != names[:-1]).any(1)) + 1
        rows = (batch.column(5).to_numpy(), _matrix(batch.column(6)), batch.column(7).to_numpy(), _matrix(batch.column(8)), batch.column(4).to_numpy())
        for i, j in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows], strict=True):
            if (name := tuple(names[i].tolist())) != of:
                if held:
                    yield from emit()
                of, held = name, []
            held.append(tuple(c[i:j] for c in rows))
    if held:
        yield from emit()


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Null, empty and zero vectors, and those with null or non-finite components, link with nothing; nor do vectors of a length
    other than the most common one with each other length (each length is compared on its own). A repeated id
    counts as that many vectors. Rows with a null id take no part and have themselves as component. Links are verified in double
    precision; those at the threshold are found with probability ``recall``, closer ones more surely.
    """
    e = F.col("embedding")
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("embedding"))
    fine = F.col("vec_id").isNotNull() & e.isNotNull() & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists(e, lambda v: v != 0)
    # -0.0 and 0.0 are the same component
    whole = rows.where(fine).withColumn("embedding", F.transform("embedding", lambda v: F.when(v == 0, F.abs(v)).otherwise(v)))
    groups = checkpointed(whole.groupBy("embedding").agg(F.min("vec_id").alias("vec"), F.count("*").alias("size")))
    results, edges = [], []
    for d, n in sorted((r[0], r[1]) for r in groups.groupBy(F.size("embedding")).count().collect()):
        bits, tables = plan(n, threshold, recall)
        own = groups.where(F.size("embedding") == d)
        signed = checkpointed(signatures(own, d, bits, tables))
        # vectors are fetched only for buckets with company, and travel once for each
        met = signed.select("vec", F.posexplode("codes").alias("table", "code"))
        count = met.groupBy("table", "code").agg(F.count("*").alias("n")).where("n > 1").select("table", "code", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
        met = met.join(count, ["table", "code"]).withColumn("block", F.pmod(F.xxhash64("vec", "table"), "blocks").cast("int"))
        # each block meets itself and every other block of its bucket once
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        met = met.select("*", other.alias("other"))
        side = F.when(F.col("block") <= F.col("other"), 0).otherwise(1)
        met = met.select("table", "code", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), side.alias("side"), "vec")
        dealt = met.join(signed, "vec").select("table", "code", "left", "right", "side", "vec", "embedding", "size", "codes")
        keys = ["table", "code", "left", "right"]
        dealt = dealt.repartition(*keys).sortWithinPartitions(*keys, "side", "vec")
        found = checkpointed(dealt.mapInArrow(lambda b: compare(b, threshold), "vec long, links long, to long"))
        results.append(found.groupBy("vec").agg(F.sum("links").alias("links")))
        edges.append(found.select(F.col("vec").alias("a"), F.col("to").alias("b")).where("a <> b").distinct())
    base = rows.where("vec_id is not null")
    alone = rows.where("vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"), F.lit(True).alias("kept"))
    if not results:
        return base.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"), F.lit(True).alias("kept")).unionByName(alone)
    links, all_edges = results[0], edges[0]
    for r, x in zip(results[1:], edges[1:], strict=True):
        links, all_edges = links.unionByName(r), all_edges.unionByName(x)
    roots = components(all_edges)
    of_group = groups.join(links, "vec", "left").join(roots.withColumnRenamed("node", "vec"), "vec", "left")
    # the smallest vec of a component's groups is its root, as each group is named by its smallest id
    of_group = of_group.select("embedding", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("root", "vec").alias("component_id"))
    out = whole.select("vec_id", "embedding").join(of_group, "embedding").select("vec_id", "n_links", "component_id")
    rest = rows.where("vec_id is not null").where(~F.coalesce(fine, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"))
    return out.unionByName(rest).withColumn("kept", F.col("vec_id") == F.col("component_id")).unionByName(alone)


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS c FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.c AS component_id, vec_id = c.c AS kept
FROM v JOIN c ON v.vec_id = c.a LEFT JOIN n ON v.vec_id = n.a
"""
