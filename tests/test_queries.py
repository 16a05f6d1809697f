"""Every query against its SQL in DuckDB."""

import pytest
from oracle import compare, connect

from granary import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, sf, con, name):
    (columns, got), (expected_columns, expected) = compare(spark, sf, con, QUERIES[name], SQL[name])
    assert columns == expected_columns
    assert got == expected


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("partitions", [1, 7])
def test_same_result_for_any_partitioning(spark, sf, partitions, tmp_path):
    spark.read.parquet(f"{sf}/documents.parquet").repartition(partitions).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("greedy_chunks", "fixed_chunks", "structure_chunks"):
        rows = lambda d: sorted(map(str, QUERIES[name](spark, d).collect()))  # noqa: B023, E731
        assert rows(sf) == rows(str(tmp_path))
