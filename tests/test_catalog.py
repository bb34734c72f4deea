"""Catalogue queries against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from vastlin.plans import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
CHEAP = [
    "instance_projection", "feature_blocks", "grid_partitions", "packed_labels", "label_moments", "feature_std", "block_margins", "logistic_objective", "softmax_objective", "vector_products", "pseudo_gradient", "scalar_functions", "logistic_transform", "minimize_quadratic_l1",
    "partition_sizes", "grouped_by_sort", "aggregated_by_key", "matrix_rows", "columns_scaled", "penalties", "standardized_entries", "stacked_rows", "generated_records", "logistic_objective_distributed",
    "linear_objective_distributed", "softmax_objective_distributed", "fit_softmax_distributed", "minimize_quadratic_distributed"]


@pytest.mark.parametrize("name", CHEAP)
def test_as_duckdb(spark, name):
    con = duckdb.connect()
    for t in os.listdir(DATA):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{t}'")
    got, expected = catalog.QUERIES[name](spark, DATA).toPandas(), con.sql(catalog.ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(expected.columns)
    rows = lambda f: sorted(map(repr, map(tuple, f[columns].values.tolist())))
    assert rows(got) == rows(expected)


def test_every_oracle_has_a_query():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
