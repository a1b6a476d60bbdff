"""Each query of the catalogue that has SQL equals what DuckDB returns."""

import os

import duckdb
import pytest

from folio.plans import catalogue, flow, pages, polishing, texts  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    cell = lambda v: f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted(columns), sorted(tuple(cell(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    got = duck.execute(catalogue.ORACLES[name])
    assert rows(df.columns, df.collect()) == rows([d[0] for d in got.description], got.fetchall())


def test_greedy_groups(spark):
    docs = spark.createDataFrame([(1, "en", "\n".join("x" * n for n in (10, 18, 55, 10)))], "doc_id long, lang string, text string")
    from folio.operators.nodes import greedy_groups

    assert [n.grp for n in greedy_groups(docs, 50).first().nodes] == [0, 0, 1, 2]
