import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from vastlin import sources
from vastlin.functions import summary
from vastlin.operators import instances as rows_of
from vastlin.operators.blocks import BlockMatrix, GridPartitioner, to_matrix
from vastlin.operators.dvector import DistVector
from vastlin.operators.storage import run_all

V1, V2 = np.arange(1.0, 9), np.array([-1.0, -2, 3, 5, 6, 7, 8, 9])


def test_vectors(spark):
    a, b = DistVector.of(spark, V1, 3), DistVector.of(spark, V2, 3)
    assert a.blocks == 3
    assert np.allclose(a.add(b).to_numpy(), V1 + V2)
    assert np.allclose(a.axpy(-2.5, b).to_numpy(), V1 - 2.5 * V2)
    assert np.allclose(DistVector.dots([(a, b), (a, a)]), [V1 @ V2, V1 @ V1])
    assert np.allclose(DistVector.combine([(2.0, a), (-1.0, b)]).to_numpy(), 2 * V1 - V2)
    assert DistVector.zeros(spark, 3, 7, 1.5).to_numpy().tolist() == [0] * 6 + [1.5]
    assert DistVector.of(spark, [0, 0, 0, 5, 0, 0, 8, 0], 3).to_sparse() == Vectors.sparse(8, [3, 6], [5, 8])
    with pytest.raises(ValueError):
        a.add(DistVector.of(spark, V1, 4))
    with pytest.raises(ValueError):
        DistVector.zeros(spark, 0, 5)


@pytest.mark.parametrize("per,n,blocks", [(2, 3, 2), (2, 4, 2), (2, 5, 3), (2, 6, 3), (3, 4, 2), (3, 5, 2), (3, 6, 2), (3, 7, 3)])
def test_num_blocks(per, n, blocks):
    assert rows_of.num_blocks(per, n) == blocks


def test_block_matrix(spark):
    rnd = np.random.default_rng(2)
    dense = rnd.normal(size=(7, 5)) * (rnd.random((7, 5)) < 0.6)
    dense[3] = 0
    cells = spark.createDataFrame([(int(i), int(j), float(dense[i, j])) for i, j in zip(*np.nonzero(dense), strict=True)], "row_id long, idx long, value double")
    m = BlockMatrix.of(cells, 7, 5, 3, 2)
    x = rnd.normal(size=5)
    out = np.zeros(9)
    for r in m.times(DistVector.of(spark, x, 2).df).collect():
        out[r.pid * 3 : r.pid * 3 + len(r["values"])] = r["values"]
    assert np.allclose(out[:7], dense @ x)
    back = np.zeros(6)
    for r in m.transposed_times(DistVector.of(spark, np.arange(7.0), 3).df).collect():
        back[r.pid * 2 : r.pid * 2 + len(r["values"])] = r["values"]
    assert np.allclose(back[:5], dense.T @ np.arange(7))
    for grid in (GridPartitioner(3, 3, 2, 1), GridPartitioner(3, 3, 1, 2), GridPartitioner(3, 3, 3, 3)):
        dealt = m.dealt(grid).persist()
        plan = dealt.times(DistVector.of(spark, x, 2).df)
        assert sorted((r.pid, *np.round(r["values"], 9)) for r in plan.collect()) == sorted((r.pid, *np.round(r["values"], 9)) for r in m.times(DistVector.of(spark, x, 2).df).collect())
        rows = DistVector.of(spark, np.arange(7.0), 3).df
        assert sorted((r.pid, *np.round(r["values"], 9)) for r in dealt.transposed_times(rows).collect()) == sorted((r.pid, *np.round(r["values"], 9)) for r in m.transposed_times(rows).collect())
        dealt.df.unpersist()
    assert [r.row_id for r in m.each_row().where("size(values) = 0").collect()] == [i for i in range(7) if not dense[i].any()]
    scaled = m.scaled_rows(DistVector.of(spark, np.arange(7.0), 3).df, lambda v, x: v * x)
    assert all(np.isclose(r.value, dense[r.row_id, r.idx] * r.row_id) for r in scaled.entries().collect())
    assert m.cell(0, 1) == dense[0, 1] and m.entries().count() == (dense != 0).sum()


@pytest.mark.parametrize("r,c,rp,cp", [(5, 4, 2, 3), (8, 6, 2, 3), (15, 4, 6, 1), (3, 15, 2, 6)])
def test_grid(r, c, rp, cp):
    g = GridPartitioner(r, c, rp, cp)
    parts = {g.part(i, j) for i in range(r) for j in range(c)}
    assert parts == set(range(g.partitions))
    assert GridPartitioner.suggested(r, c, 4).partitions > 0


def test_summary_golden(spark):
    rows = spark.createDataFrame([(0, 1.0, Vectors.dense(-1, 0, 6)), (1, 1.0, Vectors.dense(3, -3, 0)), (2, 0.0, Vectors.dense(9, 9, 9))], ["row_id", "weight", "features"])
    got = {r.idx: r for r in summary.summarize(rows_of.entries(rows), summary.totals(rows)).collect()}
    assert [got[i]["mean"] for i in range(3)] == [1, -1.5, 3]
    assert np.allclose([got[i]["variance"] for i in range(3)], [8, 4.5, 18])
    assert [got[i]["min"] for i in range(3)] == [-1, -3, 0] and [got[i]["max"] for i in range(3)] == [3, 0, 6]
    assert [got[i]["num_nonzeros"] for i in range(3)] == [2, 1, 1]
    std = {r.idx: r.std for r in summary.feature_std(rows_of.entries(rows), summary.totals(rows)).collect()}
    assert np.allclose([std[i] ** 2 for i in range(3)], [8, 4.5, 18])
    with pytest.raises(ValueError):
        summary.summarize(rows_of.entries(rows), summary.totals(rows), ("median",))
    with pytest.raises(ValueError):
        summary.totals(rows.withColumn("weight", rows["weight"] - 2))


def test_row_index_and_nulls(spark):
    got = rows_of.with_row_index(spark.range(100, 0, -7), "id").collect()
    assert sorted((r.row_id, r.id) for r in got) == list(enumerate(range(2, 101, 7)))
    bad = spark.createDataFrame([(None, Vectors.dense(1.0))], spark.createDataFrame([(1.0, Vectors.dense(1.0))], ["label", "features"]).schema)
    with pytest.raises(Exception, match="null label"):
        rows_of.instances(bad).collect()


def test_matrix_of_flat_vector():
    m = to_matrix(Vectors.sparse(6, [1, 2, 5], [1.0, 2.0, 3.0]), 2).toArray()
    assert m.tolist() == [[0, 2, 0], [1, 0, 3]]


def test_generator(spark, tmp_path):
    lines = sources.generate(spark, 20, 3, 10, 4)
    assert lines.orderBy("value").collect() == sources.generate(spark, 20, 3, 10, 4).orderBy("value").collect()
    sources.write_text(lines, str(tmp_path / "x"))
    df = sources.read_libsvm(spark, str(tmp_path / "x"), 20)
    assert df.count() == 30 and df.first().features.size == 20


def test_run_all():
    assert run_all(range(5), lambda x: x * x) == [0, 1, 4, 9, 16]


def test_indices_without_a_shuffle(spark):
    df = spark.range(0, 100, 1, 7).where("id % 11 <> 3")
    got = sorted(r.row_id for r in rows_of.with_any_row_index(df).collect())
    assert got == list(range(df.count()))


def test_collected_with_partitions(spark):
    from vastlin.operators.storage import with_partition_ids

    got = with_partition_ids(spark.range(0, 10, 1, 3))
    assert [r.id for _, r in got] == list(range(10)) and {p for p, _ in got} == {0, 1, 2}


def test_stacked_rows():
    from vastlin.operators.blocks import stack_rows

    wide = [Vectors.sparse(4, [1, 3], [2.0, 3.0]), Vectors.dense(1.0, 0, 0, 4)]
    assert np.allclose(stack_rows(wide).toArray(), [v.toArray() for v in wide])
    tall = [Vectors.dense(1.0, 0), Vectors.sparse(2, [1], [5.0]), Vectors.sparse(2, [], [])]
    assert np.allclose(stack_rows(tall).toArray(), [v.toArray() for v in tall])
