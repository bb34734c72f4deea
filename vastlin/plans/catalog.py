"""The query catalogue: name -> query, and name -> DuckDB SQL that gives the same rows.

Floating results are rounded, since sums run in different orders.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vastlin.functions import scalar, summary
from vastlin.operators import grouping
from vastlin.operators import instances as rows_of
from vastlin.operators.blocks import BlockMatrix, GridPartitioner, pack_rows, split_entries, stack_rows, to_matrix
from vastlin.operators.dvector import DistVector, LocalVector
from vastlin.plans.objectives import Grid, Rows, l2_penalty

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def near(c: Column, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(c, digits) + F.lit(0.0)


DIM = 64


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, label 0/1, weight 1 or 2, features) of ``embeddings``."""
    e = table(spark, sf_dir, "embeddings")
    bound = e.select(F.col("vec_id").alias("row_id"), (F.col("label") >= 5).cast("double").alias("y"), (1.0 + F.pmod("vec_id", F.lit(2))).alias("w"), array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    return bound.select("row_id", F.col("y").alias("label"), F.col("w").alias("weight"), "features")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows_of.entries(embeddings(spark, sf_dir))


def beta(name: str = "idx") -> Column:
    """Fixed coefficients for evaluations."""
    return (F.pmod(F.col(name) * 7, F.lit(13)) - 6) / 10.0


#: The same rows in SQL: r is (row_id, label, weight), x the entries.
ROWS = "r AS (SELECT vec_id AS row_id, CAST(label >= 5 AS DOUBLE) AS label, 1.0 + vec_id % 2 AS weight, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), x AS (SELECT row_id, label, weight, unnest(range(64)) AS idx, unnest(e) AS value FROM r)"
NONZERO = "x AS (SELECT * FROM x0 WHERE value <> 0)"
STD = "t AS (SELECT sum(weight) AS W, sum(weight * weight) AS W2, count(*) AS n FROM r), m AS (SELECT idx, sum(weight * value) / (SELECT W FROM t) AS mean FROM x GROUP BY idx), s AS (SELECT x.idx, sqrt(sum(weight * (value - mean) * (value - mean)) / (SELECT W - W2 / W FROM t)) AS std FROM x JOIN m USING (idx) GROUP BY x.idx)"
BETA = "((idx * 7) % 13 - 6) / 10.0"


@query(f"WITH {ROWS} SELECT row_id, label, CAST(weight AS DOUBLE) AS weight, 64 AS size FROM r")
def instance_projection(spark, sf_dir):
    return embeddings(spark, sf_dir).select("row_id", "label", "weight", rows_of.vector_size(F.col("features")).alias("size"))


@query(f"WITH {ROWS} SELECT row_id, count(*) AS nnz, round(sum(value), 6) + 0.0 AS total FROM x WHERE value <> 0 GROUP BY row_id")
def active_entries(spark, sf_dir):
    return cells(spark, sf_dir).groupBy("row_id").agg(F.count("*").alias("nnz"), near(F.sum("value")).alias("total"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_id FROM orders")
def row_index(spark, sf_dir):
    return rows_of.with_row_index(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")


@query("SELECT CAST(o_orderkey % 7 AS INTEGER) AS part, count(*) AS n FROM orders GROUP BY 1")
def partition_sizes(spark, sf_dir):
    dealt = table(spark, sf_dir, "orders").select("o_orderkey").repartitionById(7, F.pmod("o_orderkey", F.lit(7)).cast("int"))
    return rows_of.partition_sizes(dealt)


@query("SELECT o_custkey, count(*) AS n, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS orders FROM orders GROUP BY 1")
def grouped_by_sort(spark, sf_dir):
    found = grouping.grouped_by_sort(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", 8)
    return found.select("o_custkey", F.size("values").cast("long").alias("n"), F.array_join(F.transform("values", lambda v: v.cast("string")), ",").alias("orders"))


@query("SELECT l_suppkey, count(*) AS n, round(sum(l_quantity), 6) AS quantity FROM lineitem GROUP BY 1")
def aggregated_by_key(spark, sf_dir):
    return grouping.aggregated_by_key(table(spark, sf_dir, "lineitem"), "l_suppkey", F.count("*").alias("n"), near(F.sum("l_quantity")).alias("quantity"))


@query(f"WITH {ROWS} SELECT row_id, CAST(idx // 10 AS INTEGER) AS cb, CAST(idx % 10 AS INTEGER) AS c, round(value, 6) + 0.0 AS value FROM x WHERE value <> 0")
def split_by_column_block(spark, sf_dir):
    return split_entries(cells(spark, sf_dir), 10).select("row_id", "cb", "c", near(F.col("value")).alias("value"))


def matrix(spark, sf_dir, compress: bool = False) -> BlockMatrix:
    n = table(spark, sf_dir, "embeddings").agg(F.max("vec_id")).first()[0] + 1
    return BlockMatrix.of(cells(spark, sf_dir), n, DIM, 100, 10, compress)


@query(f"WITH {ROWS} SELECT CAST(row_id // 100 AS INTEGER) AS rb, CAST(idx // 10 AS INTEGER) AS cb, CAST(count(*) AS INTEGER) AS nnz, round(sum(value), 5) + 0.0 AS total FROM x WHERE value <> 0 GROUP BY ALL")
def feature_blocks(spark, sf_dir):
    m = matrix(spark, sf_dir)
    return m.df.select("rb", "cb", F.size("v").alias("nnz"), near(F.aggregate("v", F.lit(0.0), lambda s, v: s + v), 5).alias("total"))


@query(f"WITH {ROWS} SELECT row_id, idx, CAST(value AS FLOAT) AS value FROM x WHERE value <> 0")
def compressed_blocks(spark, sf_dir):
    return matrix(spark, sf_dir, True).entries().select("row_id", "idx", F.col("value").cast("float").alias("value"))


@query("WITH x AS (SELECT l_orderkey % 500 AS r, l_linenumber AS c, sum(l_quantity) AS v FROM lineitem WHERE l_orderkey % 3 = 0 GROUP BY ALL), n AS (SELECT unnest(range(500)) AS r) SELECT n.r AS row_id, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS columns, round(coalesce(sum(v), 0), 4) + 0.0 AS total FROM n LEFT JOIN x ON n.r = x.r GROUP BY n.r")
def matrix_rows(spark, sf_dir):
    """Every row of a matrix, those without entries too."""
    x = table(spark, sf_dir, "lineitem").where("l_orderkey % 3 = 0").groupBy((F.col("l_orderkey") % 500).alias("row_id"), F.col("l_linenumber").cast("long").alias("idx")).agg(F.sum("l_quantity").alias("value"))
    rows = BlockMatrix.of(x, 500, 10, 60, 4).each_row()
    joined = F.when(F.size("indices") > 0, F.array_join(F.transform("indices", lambda i: i.cast("string")), ","))
    return rows.select("row_id", joined.alias("columns"), near(F.aggregate("values", F.lit(0.0), lambda s, v: s + v), 4).alias("total"))


@query(f"WITH {ROWS} SELECT row_id, idx, round(value * {BETA}, 6) + 0.0 AS value FROM x WHERE value <> 0")
def columns_scaled(spark, sf_dir):
    found = matrix(spark, sf_dir).scaled_columns(fixed(spark).df, lambda v, b: v * b)
    return found.entries().select("row_id", "idx", near(F.col("value")).alias("value"))


@query(f"WITH {ROWS}, b AS (SELECT DISTINCT CAST(row_id // 100 AS INTEGER) AS rb, CAST(idx // 10 AS INTEGER) AS cb FROM x WHERE value <> 0), n AS (SELECT max(vec_id) // 100 + 1 AS rows FROM embeddings) SELECT rb, cb, CAST(rb // 2 + (cb // 3) * ceil(rows / 2.0) AS INTEGER) AS part FROM b, n")
def grid_partitions(spark, sf_dir):
    m = matrix(spark, sf_dir)
    grid = GridPartitioner(rows_of.num_blocks(100, m.rows), rows_of.num_blocks(10, DIM), 2, 3)
    return m.dealt(grid).df.select("rb", "cb", grid.column().alias("part"))


@query(f"WITH {ROWS} SELECT CAST(row_id // 100 AS INTEGER) AS rb, count(*) AS n, round(sum(label * weight), 6) + 0.0 AS dot FROM r GROUP BY 1")
def packed_labels(spark, sf_dir):
    p = pack_rows(embeddings(spark, sf_dir), 100)
    return p.select("rb", F.size("labels").cast("long").alias("n"), near(F.aggregate(F.zip_with("labels", "weights", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)).alias("dot"))


@query(f"WITH {ROWS} SELECT label, round(sum(weight), 6) AS weight_sum, count(*) AS n FROM r GROUP BY label")
def label_histogram(spark, sf_dir):
    return summary.label_histogram(embeddings(spark, sf_dir)).select("label", near(F.col("weight_sum")).alias("weight_sum"), "n")


@query("WITH r AS (SELECT o_totalprice / 100000 AS y, 1.0 + o_orderkey % 3 AS w FROM orders), t AS (SELECT sum(w) AS sw, sum(w * w) AS sww, sum(w * y) / sum(w) AS mean FROM r) SELECT round(max(mean), 6) AS mean, round(sqrt(sum(w * (y - mean) * (y - mean)) / max(sw - sww / sw)), 6) AS std FROM r, t")
def label_moments(spark, sf_dir):
    mean, std = summary.label_moments(table(spark, sf_dir, "orders").select((F.col("o_totalprice") / 100000).alias("label"), (1.0 + F.pmod("o_orderkey", F.lit(3))).alias("weight")))
    return spark.createDataFrame([(round(mean, 6), round(std, 6))], "mean double, std double")


@query(f"WITH {ROWS}, {STD}, a AS (SELECT idx, sum(weight * value * value) AS q, sum(weight * abs(value)) AS l1, max(value) AS hi, min(value) AS lo, count_if(value <> 0) AS k FROM x GROUP BY idx) SELECT idx, round(mean, 6) + 0.0 AS mean, round(std * std, 6) + 0.0 AS variance, n AS count, CAST(k AS BIGINT) AS num_nonzeros, round(hi, 6) + 0.0 AS max, round(lo, 6) + 0.0 AS min, round(l1, 5) + 0.0 AS norm_l1, round(sqrt(q), 6) + 0.0 AS norm_l2 FROM a JOIN m USING (idx) JOIN s USING (idx), t")
def weighted_summary(spark, sf_dir):
    s = summary.summarize(cells(spark, sf_dir), summary.totals(embeddings(spark, sf_dir)))
    return s.select("idx", *[near(F.col(c), 5 if c == "norm_l1" else 6).alias(c) if c not in ("count", "num_nonzeros") else F.col(c) for c in summary.METRICS])


@query(f"WITH {ROWS}, {STD} SELECT idx, round(std, 6) + 0.0 AS std FROM s")
def feature_std(spark, sf_dir):
    return summary.feature_std(cells(spark, sf_dir), summary.totals(embeddings(spark, sf_dir))).select("idx", near(F.col("std")).alias("std"))


@query(f"WITH {ROWS}, {STD} SELECT row_id, idx, round(value / std, 6) + 0.0 AS value FROM x JOIN s USING (idx) WHERE std <> 0 AND value <> 0")
def standardized_entries(spark, sf_dir):
    std = summary.feature_std(cells(spark, sf_dir), summary.totals(embeddings(spark, sf_dir)))
    return summary.standardized(cells(spark, sf_dir), std).select("row_id", "idx", near(F.col("value")).alias("value"))


def fixed(spark: SparkSession, classes: int = 1) -> DistVector:
    return DistVector.of(spark, [((i * 7) % 13 - 6) / 10.0 for i in range(DIM * classes)], 10 * classes)


@query(f"WITH {ROWS} SELECT row_id, round(sum(value * {BETA}), 6) + 0.0 AS margin FROM x GROUP BY row_id")
def block_margins(spark, sf_dir):
    out = matrix(spark, sf_dir).times(fixed(spark).df)
    at = out.select("pid", F.posexplode("values").alias("i", "margin")).select((F.col("pid").cast("long") * 100 + F.col("i")).alias("row_id"), "margin")
    return at.join(embeddings(spark, sf_dir).select("row_id"), "row_id").select("row_id", near(F.col("margin")).alias("margin"))


L2 = 0.3


def _evaluated(spark: SparkSession, value: float, gradient: DataFrame) -> DataFrame:
    """(what, idx, value): the loss and the gradient's components."""
    loss = spark.createDataFrame([("loss", -1, value)], "what string, idx long, value double")
    return loss.unionAll(gradient.select(F.lit("gradient"), "idx", "value")).withColumn("value", near(F.col("value")))


def evaluate(spark, sf_dir, kind: str) -> DataFrame:
    """Loss and gradient over packed rows, with coefficients on the driver."""
    classes = 3 if kind == "softmax" else 1
    e = embeddings(spark, sf_dir)
    rows = e.select("label", "weight", rows_of.vector_entries(F.col("features")).alias("entries"))
    objective = Rows.of(kind, rows, np.ones(DIM), DIM, classes, False, summary.totals(e)["w"], L2, np.ones(DIM * classes))
    value, gradient = objective(LocalVector(fixed(spark, classes).to_numpy()))
    objective.close()
    return _evaluated(spark, value, spark.createDataFrame(list(enumerate(gradient.values.tolist())), "idx long, value double"))


def evaluate_grid(spark, sf_dir, kind: str) -> DataFrame:
    """The same over a block matrix, with distributed coefficients and gradient."""
    classes = 3 if kind == "softmax" else 1
    e, m = embeddings(spark, sf_dir), matrix(spark, sf_dir)
    grid = GridPartitioner.requested(rows_of.num_blocks(m.rows_per_block, m.rows), rows_of.num_blocks(m.cols_per_block, m.cols), 2, 3)
    ones = fixed(spark, classes).map(lambda v: F.lit(1.0))
    objective = Grid(kind, m.dealt(grid).persist(), pack_rows(e, m.rows_per_block), classes, summary.totals(e)["w"], L2, ones)
    value, gradient = objective(fixed(spark, classes).materialize())
    objective.close()
    return _evaluated(spark, value, gradient.to_long())


def _evaluation_sql(loss: str, mult: str) -> str:
    penalty = f"{L2 / 2} * (SELECT sum(b * b) FROM (SELECT {BETA} AS b FROM range(64) AS t(idx)))"
    return f"""WITH {ROWS}, z AS (SELECT row_id, label, weight AS w, sum(value * {BETA}) AS s FROM x GROUP BY ALL),
f AS (SELECT row_id, {loss} AS loss, {mult} AS mult FROM z), t AS (SELECT sum(weight) AS W FROM r)
SELECT 'loss' AS what, CAST(-1 AS BIGINT) AS idx, round(sum(loss) / max(W) + {penalty}, 6) + 0.0 AS value FROM f, t
UNION ALL SELECT 'gradient', CAST(idx AS BIGINT), round(sum(value * mult) / max(W) + {L2} * {BETA}, 6) + 0.0 FROM x JOIN f USING (row_id), t GROUP BY idx"""


_OF = "(((idx * 3 + k) * 7) % 13 - 6) / 10.0"
OBJECTIVES = {
    "logistic": _evaluation_sql("w * (ln(1 + exp(-s)) + CASE WHEN label > 0 THEN 0 ELSE s END)", "w * (1 / (1 + exp(-s)) - label)"),
    "linear": _evaluation_sql("w * (s - label) * (s - label) / 2", "w * (s - label)"),
    "softmax": f"""WITH {ROWS}, z AS (SELECT row_id, label, weight AS w, k, sum(value * {_OF}) AS s FROM x, (SELECT unnest(range(3)) AS k) GROUP BY ALL),
p AS (SELECT *, exp(s) / sum(exp(s)) OVER (PARTITION BY row_id) AS p FROM z),
f AS (SELECT row_id, k, CASE WHEN k = label THEN -w * ln(p) ELSE 0 END AS loss, w * (p - CASE WHEN k = label THEN 1 ELSE 0 END) AS mult FROM p),
t AS (SELECT sum(weight) AS W FROM r), b AS (SELECT sum({_OF} * {_OF}) AS b FROM range(64) AS t(idx), (SELECT unnest(range(3)) AS k))
SELECT 'loss' AS what, CAST(-1 AS BIGINT) AS idx, round(sum(loss) / max(W) + {L2 / 2} * max(b), 6) + 0.0 AS value FROM f, t, b
UNION ALL SELECT 'gradient', CAST(idx * 3 + k AS BIGINT), round(sum(value * mult) / max(W) + {L2} * {_OF}, 6) + 0.0 FROM x JOIN f USING (row_id), t GROUP BY idx, k""",
}


def _objective_queries(kind: str) -> None:
    QUERIES[f"{kind}_objective"] = lambda spark, sf_dir: evaluate(spark, sf_dir, kind)
    QUERIES[f"{kind}_objective_distributed"] = lambda spark, sf_dir: evaluate_grid(spark, sf_dir, kind)
    ORACLES[f"{kind}_objective"] = ORACLES[f"{kind}_objective_distributed"] = OBJECTIVES[kind]


for _kind in OBJECTIVES:
    _objective_queries(_kind)


@query(f"WITH {ROWS}, {STD}, b AS (SELECT idx, std, {BETA} AS b FROM s) SELECT round(0.5 * 0.3 * sum(b * b), 6) AS standardized, round(0.5 * 0.3 * sum(CASE WHEN std = 0 THEN 0 ELSE b * b / (std * std) END), 5) AS original, round(0.3 * sum(abs(b)), 6) AS l1, round(0.3 * sum(CASE WHEN std = 0 THEN 0 ELSE abs(b) / std END), 6) AS l1_original FROM b")
def penalties(spark, sf_dir):
    std = np.zeros(DIM)
    for r in summary.feature_std(cells(spark, sf_dir), summary.totals(embeddings(spark, sf_dir))).collect():
        std[r["idx"]] = r["std"]
    b = fixed(spark).to_numpy()
    scale = np.divide(1.0, std, out=np.zeros(DIM), where=std > 0)
    values = [l2_penalty(b, L2, np.ones(DIM))[0], l2_penalty(b, L2, scale * scale)[0], LocalVector(b).l1_value(LocalVector(np.full(DIM, L2))), LocalVector(b).l1_value(LocalVector(L2 * scale))]
    return spark.createDataFrame([tuple(round(v, d) for v, d in zip(values, (6, 5, 6, 6), strict=True))], "standardized double, original double, l1 double, l1_original double")


def _vectors(spark, sf_dir) -> tuple[DistVector, DistVector]:
    """Two vectors from the first two columns of ``part``, scaled to O(1)."""
    p = table(spark, sf_dir, "part")
    n = p.agg(F.max("p_partkey")).first()[0] + 1
    one = lambda v: DistVector.from_long(p.select(F.col("p_partkey").alias("idx"), v.alias("value")), 300, n)
    return one(F.col("p_retailprice") / 1000), one(F.col("p_size") / 50.0 - 0.5)


PART = "v AS (SELECT p_partkey AS idx, p_retailprice / 1000 AS a, p_size / 50.0 - 0.5 AS b FROM part)"
ALL = f"{PART}, n AS (SELECT unnest(range((SELECT max(idx) + 1 FROM v))) AS idx), w AS (SELECT n.idx, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM n LEFT JOIN v USING (idx))"


@query(f"WITH {ALL} SELECT round(sum(a * b), 6) + 0.0 AS dot, round(sqrt(sum(a * a)), 6) AS norm, CAST(count_if(b <> 0) AS BIGINT) AS nnz FROM w")
def vector_products(spark, sf_dir):
    a, b = _vectors(spark, sf_dir)
    dot, square = DistVector.dots([(a, b), (a, a)])
    return spark.createDataFrame([(round(dot, 6) + 0.0, round(square**0.5, 6), b.nnz())], "dot double, norm double, nnz long")


def _vector_query(name: str, sql: str, make: Callable[[DistVector, DistVector], DistVector]) -> None:
    def f(spark, sf_dir):
        return make(*_vectors(spark, sf_dir)).to_long().select("idx", near(F.col("value")).alias("value"))

    QUERIES[name], ORACLES[name] = f, f"WITH {ALL} SELECT idx, round({sql}, 6) + 0.0 AS value FROM w"


_vector_query("vector_shift", "a + 1.5", lambda a, b: a.shift(1.5))
_vector_query("vector_scale", "-2.5 * a", lambda a, b: a.scale(-2.5))
_vector_query("vector_add", "a + b", lambda a, b: a.add(b))
_vector_query("vector_sub", "a - b", lambda a, b: a.sub(b))
_vector_query("vector_axpy", "a + 0.7 * b", lambda a, b: a.axpy(0.7, b))
_vector_query("vector_combine", "2 * a - 3 * b + 0.5 * (a + b)", lambda a, b: DistVector.combine([(2.0, a), (-3.0, b), (0.5, a.add(b))]))
_vector_query("vector_zip3", "a * b + a", lambda a, b: a.zip(lambda x, y, z: x * y + z, b, a))
_vector_query("direction_projection", "CASE WHEN b * (a - 1.2) < 0 THEN b ELSE 0 END", lambda a, b: b.project(a.shift(-1.2)))
_vector_query("orthant_step", "CASE WHEN sign(b + 0.4 * (a - 1.2)) = (CASE WHEN b <> 0 THEN sign(b) ELSE sign(-a) END) THEN b + 0.4 * (a - 1.2) ELSE 0 END", lambda a, b: b.orthant_step(a.shift(-1.2), a, 0.4))
_vector_query("pseudo_gradient", "CASE WHEN b <> 0 THEN (a - 1.2) + sign(b) * 0.3 WHEN a - 1.5 > 0 THEN a - 1.5 WHEN a - 0.9 < 0 THEN a - 0.9 ELSE 0 END", lambda a, b: b.pseudo_gradient(a.shift(-1.2), a.map(lambda v: F.lit(0.3))))


@query("SELECT CAST(range AS BIGINT) AS idx, CASE WHEN range = 24 THEN 1.5 ELSE 0.0 END AS value FROM range(25)")
def constant_vector(spark, sf_dir):
    return DistVector.zeros(spark, 10, 25, 1.5).to_long()


@query("SELECT p_partkey, round(CASE WHEN m > 0 THEN m + ln(1 + exp(-m)) ELSE ln(1 + exp(m)) END, 6) AS log1p_exp, round(1 / (1 + exp(-m)), 6) AS sigmoid, round(exp(m) / (exp(m) + exp(-m) + 1), 6) AS p0 FROM (SELECT p_partkey, p_size / 10.0 - 2.5 AS m FROM part)")
def scalar_functions(spark, sf_dir):
    m = F.col("p_size") / 10.0 - 2.5
    return table(spark, sf_dir, "part").select("p_partkey", near(scalar.log1p_exp(m)).alias("log1p_exp"), near(scalar.sigmoid(m)).alias("sigmoid"), near(scalar.softmax(F.array(m, -m, F.lit(0.0)))[0]).alias("p0"))


@query("SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CAST(v AS DOUBLE) AS v FROM (VALUES (0, 0, 1), (2, 0, 2), (1, 1, 3), (2, 3, 4)) AS t(i, j, v)")
def column_major_matrix(spark, sf_dir):
    from pyspark.ml.linalg import Vectors

    m = to_matrix(Vectors.sparse(12, [0, 2, 4, 11], [1.0, 2.0, 3.0, 4.0]), 3).toArray()
    return spark.createDataFrame([(int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m), strict=True)], "i int, j int, v double")


def _coefficients(spark: SparkSession, values, names: list[str], digits: int = 4) -> DataFrame:
    return spark.createDataFrame([(n, round(float(v), digits) + 0.0) for n, v in zip(names, values, strict=True)], "name string, value double")


ORDERS = "r AS (SELECT o_totalprice / 100000 AS y, o_custkey / 1000.0 AS x, 1.0 + o_orderkey % 3 AS w FROM orders)"


def _orders(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select((F.col("o_totalprice") / 100000).alias("label"), (1.0 + F.pmod("o_orderkey", F.lit(3))).alias("weight"), F.array(F.col("o_custkey") / 1000.0).alias("features"))


@query(
    f"WITH {ORDERS}, t AS (SELECT sum(w) AS sw, sum(w * w) AS sww, sum(w * y) / sum(w) AS my, sum(w * x) / sum(w) AS mx FROM r), c AS (SELECT sum(w * (x - mx) * (y - my)) / max(sw) AS xy, sum(w * (x - mx) * (x - mx)) / max(sw) AS xx, sqrt(sum(w * (y - my) * (y - my)) / max(sw - sww / sw)) AS sy, sum(w * (x - mx) * (x - mx)) / max(sw - sww / sw) AS vx FROM r, t), f AS (SELECT xy / (xx + 0.3 / sy * vx) AS b FROM c) SELECT 'coefficient' AS name, round(b, 4) + 0.0 AS value FROM f UNION ALL SELECT 'intercept', round(my - b * mx, 4) + 0.0 FROM f, t"
)
def fit_ridge(spark, sf_dir):
    from vastlin.models import LinearRegression

    m = LinearRegression(weightCol="weight", regParam=0.3, tol=1e-10).fit(_orders(spark, sf_dir))
    # the penalty is on the standardized scale: lambda / std(y) times var(x) here
    return _coefficients(spark, [m.coefficients[0], m.intercept], ["coefficient", "intercept"])


@query(
    f"WITH {ORDERS}, t AS (SELECT sum(w) AS sw, sum(w * w) AS sww, sum(w * y) / sum(w) AS my, sum(w * x) / sum(w) AS mx FROM r), c AS (SELECT sum(w * x * y) / max(sw) AS xy, sum(w * x * x) / max(sw) AS xx, sqrt(sum(w * (y - my) * (y - my)) / max(sw - sww / sw)) AS sy, sqrt(sum(w * (x - mx) * (x - mx)) / max(sw - sww / sw)) AS sx FROM r, t) SELECT 'coefficient' AS name, round(sign(xy) * greatest(abs(xy) - 0.5 * 0.3 * sx, 0) / (xx + 0.5 * 0.3 * sx * sx / sy), 4) + 0.0 AS value FROM c"
)
def fit_elastic_net(spark, sf_dir):
    from vastlin.models import LinearRegression

    m = LinearRegression(weightCol="weight", regParam=0.3, elasticNetParam=0.5, fitIntercept=False, tol=1e-10).fit(_orders(spark, sf_dir))
    return _coefficients(spark, m.coefficients, ["coefficient"])


@query("WITH p AS (SELECT l_linestatus = 'O' AS x, avg(CAST(l_quantity > 25 AS DOUBLE)) AS p FROM lineitem GROUP BY 1), b AS (SELECT ln(p / (1 - p)) AS b0 FROM p WHERE NOT x), c AS (SELECT ln(p / (1 - p)) AS b1 FROM p WHERE x) SELECT 'coefficient' AS name, round(b1 - b0, 3) + 0.0 AS value FROM b, c UNION ALL SELECT 'intercept', round(b0, 3) + 0.0 FROM b")
def fit_logistic_saturated(spark, sf_dir):
    from vastlin.models import LogisticRegression

    df = table(spark, sf_dir, "lineitem").select((F.col("l_quantity") > 25).cast("double").alias("label"), F.array((F.col("l_linestatus") == "O").cast("double")).alias("features"))
    m = LogisticRegression(tol=1e-12).fit(df)
    return _coefficients(spark, [m.coefficients[0], m.intercept], ["coefficient", "intercept"], 3)


@query("WITH n AS (SELECT l_returnflag AS g, CAST(floor(l_quantity / 17) AS INTEGER) AS k, count(*) AS n FROM lineitem GROUP BY ALL), p AS (SELECT g, k, ln(n / sum(n) OVER (PARTITION BY g)) AS l FROM n) SELECT g || k AS name, round(l - avg(l) OVER (PARTITION BY g), 3) + 0.0 AS value FROM p")
def fit_softmax_groups(spark, sf_dir):
    from vastlin.models import SoftmaxRegression

    flags = ["A", "N", "R"]
    df = table(spark, sf_dir, "lineitem").select(F.floor(F.col("l_quantity") / 17).cast("double").alias("label"), F.array(*[(F.col("l_returnflag") == g).cast("double") for g in flags]).alias("features"))
    m = SoftmaxRegression(tol=1e-12).fit(df).matrix
    return _coefficients(spark, m.T.ravel(), [f"{g}{k}" for g in flags for k in range(len(m))], 3)


@query()
def fit_logistic_embeddings(spark, sf_dir):
    from vastlin.models import LogisticRegression

    m = LogisticRegression(weightCol="weight", regParam=0.1, elasticNetParam=0.5).fit(embeddings(spark, sf_dir))
    return m.coefficient_rows(spark)


SPLIT = {"layout": "distributed", "colsPerBlock": 1, "rowsPerBlock": 700, "rowPartitions": 2, "colPartitions": 2, "tol": 1e-12}


@query("WITH p AS (SELECT p_partkey % 3 = 0 AS x, avg(CAST(p_size > 20 AS DOUBLE)) AS p FROM part GROUP BY 1), b AS (SELECT ln(p / (1 - p)) AS b0 FROM p WHERE NOT x), c AS (SELECT ln(p / (1 - p)) AS b1 FROM p WHERE x) SELECT 'coefficient' AS name, round(b1 - b0, 3) + 0.0 AS value FROM b, c UNION ALL SELECT 'intercept', round(b0, 3) + 0.0 FROM b")
def fit_logistic_distributed(spark, sf_dir):
    from vastlin.models import LogisticRegression

    df = table(spark, sf_dir, "part").select((F.col("p_size") > 20).cast("double").alias("label"), F.array((F.col("p_partkey") % 3 == 0).cast("double")).alias("features"))
    m = LogisticRegression(**SPLIT).fit(df)
    return _coefficients(spark, [m.coefficients[0], m.intercept], ["coefficient", "intercept"], 3)


@query("WITH n AS (SELECT p_partkey % 2 AS g, CAST(floor(p_size / 17) AS INTEGER) AS k, sum(1.0 + p_partkey % 5) AS n FROM part GROUP BY ALL), p AS (SELECT g, k, ln(n / sum(n) OVER (PARTITION BY g)) AS l FROM n) SELECT g || '/' || k AS name, round(l - avg(l) OVER (PARTITION BY g), 3) + 0.0 AS value FROM p")
def fit_softmax_distributed(spark, sf_dir):
    from vastlin.models import SoftmaxRegression

    of = F.col("p_partkey") % 2
    df = table(spark, sf_dir, "part").select(F.floor(F.col("p_size") / 17).cast("double").alias("label"), (1.0 + F.col("p_partkey") % 5).alias("weight"), F.array(*[(of == g).cast("double") for g in range(2)]).alias("features"))
    m = SoftmaxRegression(weightCol="weight", **SPLIT).fit(df).matrix
    return _coefficients(spark, m.T.ravel(), [f"{g}/{k}" for g in range(2) for k in range(len(m))], 3)


@query(
    """WITH r AS (SELECT p_retailprice / 1000 AS y, p_size / 10.0 AS x, 1.0 + p_partkey % 3 AS w FROM part),
t AS (SELECT sum(w) AS sw, sum(w * w) AS sww, sum(w * y) / sum(w) AS my, sum(w * x) / sum(w) AS mx FROM r),
c AS (SELECT sum(w * x * y) / max(sw) AS xy, sum(w * x * x) / max(sw) AS xx, sqrt(sum(w * (y - my) * (y - my)) / max(sw - sww / sw)) AS sy, sqrt(sum(w * (x - mx) * (x - mx)) / max(sw - sww / sw)) AS sx FROM r, t)
SELECT 'coefficient' AS name, round(sign(xy) * greatest(abs(xy) - 0.5 * 0.3 * sx, 0) / (xx + 0.5 * 0.3 * sx * sx / sy), 4) + 0.0 AS value FROM c"""
)
def fit_elastic_net_distributed(spark, sf_dir):
    from vastlin.models import LinearRegression

    df = table(spark, sf_dir, "part").select((F.col("p_retailprice") / 1000).alias("label"), (1.0 + F.pmod("p_partkey", F.lit(3))).alias("weight"), F.array(F.col("p_size") / 10.0).alias("features"))
    m = LinearRegression(weightCol="weight", regParam=0.3, elasticNetParam=0.5, fitIntercept=False, **SPLIT).fit(df)
    return _coefficients(spark, m.coefficients, ["coefficient"])


@query(f"WITH {ROWS}, z AS (SELECT row_id, 0.2 + sum(value * {BETA}) AS m FROM x GROUP BY row_id) SELECT row_id, round(1 / (1 + exp(-m)), 6) AS probability, CAST(1 / (1 + exp(-m)) > 0.6 AS DOUBLE) AS prediction FROM z")
def logistic_transform(spark, sf_dir):
    from vastlin.models import LogisticRegressionModel

    m = LogisticRegressionModel(np.array([((i * 7) % 13 - 6) / 10.0 for i in range(DIM)]), 0.2, {"threshold": 0.6})
    out = m.transform(embeddings(spark, sf_dir))
    return out.select("row_id", near(F.unwrap_udt("probability")["values"][1]).alias("probability"), "prediction")


@query("SELECT 'x' || i AS name, 3.0 AS value FROM range(10) AS t(i)")
def minimize_quadratic(spark, sf_dir):
    from vastlin.plans.lbfgs import LBFGS, quadratic

    s = LBFGS(50, 5).minimize(quadratic(), LocalVector(np.linspace(-10, 10, 10)))
    return _coefficients(spark, s.x.values, [f"x{i}" for i in range(10)])


@query("SELECT 'x' || i AS name, 1.5 AS value FROM range(10) AS t(i)")
def minimize_quadratic_l1(spark, sf_dir):
    from vastlin.plans.lbfgs import OWLQN, quadratic

    s = OWLQN(LocalVector(np.full(10, 3.0)), 100, 5).minimize(quadratic(), LocalVector(np.linspace(-10, 10, 10)))
    return _coefficients(spark, s.x.values, [f"x{i}" for i in range(10)])


@query("SELECT 'x' || i AS name, 3.0 AS value FROM range(10) AS t(i)")
def minimize_quadratic_distributed(spark, sf_dir):
    from vastlin.plans.lbfgs import LBFGS, quadratic

    s = LBFGS(50, 5).minimize(quadratic(), DistVector.of(spark, np.linspace(-10, 10, 10), 4))
    return _coefficients(spark, s.x.to_numpy(), [f"x{i}" for i in range(10)])


@query("SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CAST(v AS DOUBLE) AS v FROM (VALUES (0, 1, 2), (0, 4, 5), (2, 0, 7)) AS t(i, j, v)")
def stacked_rows(spark, sf_dir):
    from pyspark.ml.linalg import Vectors

    m = stack_rows([Vectors.sparse(5, [1, 4], [2.0, 5.0]), Vectors.sparse(5, [], []), Vectors.dense([7.0, 0, 0, 0, 0])]).toArray()
    return spark.createDataFrame([(int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m), strict=True)], "i int, j int, v double")


@query("SELECT CAST(400 AS BIGINT) AS n, CAST(4000 AS BIGINT) AS entries, CAST(400 AS BIGINT) AS increasing, CAST(400 AS BIGINT) AS labelled, true AS inside, true AS differ")
def generated_records(spark, sf_dir):
    from vastlin import sources

    parts = F.split("value", " ")
    at = F.transform(F.slice(parts, F.lit(2), F.size(parts) - 1), lambda x: F.split(x, ":")[0].cast("int"))
    lines = sources.generate(spark, 50, 4, 100, 10).select("value", parts[0].cast("double").alias("label"), at.alias("at"))
    return lines.agg(
        F.count("*").alias("n"), F.sum(F.size("at")).alias("entries"), F.count_if(F.array_sort(F.array_distinct("at")) == F.col("at")).alias("increasing"), F.count_if(F.col("label").isin(0.0, 1.0)).alias("labelled"),
        ((F.min(F.array_min("at")) >= 1) & (F.max(F.array_max("at")) <= 50)).alias("inside"), (F.count_distinct("value") > 390).alias("differ"),
    )
