"""Queries that SQL can express, against DuckDB."""

import duckdb
import pytest

from tallyloom.llm import queries

from ..conftest import SF


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    rel = con.sql(queries.oracle_sql()[name])
    at = [rel.columns.index(c) for c in df.columns]
    tidy = lambda r: tuple(round(v, 6) if isinstance(v, float) else v for v in r)
    assert sorted(tidy(r) for r in df.collect()) == sorted(tidy([r[i] for i in at]) for r in rel.fetchall())


def test_queries_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert {n.split("_")[0] for n in queries.queries()} == {f"op{i}" for i in range(1, 14)}
    assert {*queries.queries(), "pipeline"} <= set(names)
