"""Every query of the graph engine that has SQL, against it."""

import math
from pathlib import Path

import duckdb
import pytest
from graphtrust import catalog, runtime, suites  # noqa: F401  suites registers its queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "None"
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, con, name):
    want = con.sql(catalog.ORACLES[name])
    with runtime.scratch(spark):
        rows = catalog.QUERIES[name](spark, SF)
        columns = sorted(rows.columns)
        got = sorted(tuple(plain(r[c]) for c in columns) for r in rows.collect())
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[k]) for k in at) for r in want.fetchall()) and got


def test_fixed_values():
    from graphtrust.functions import text

    stop = "the and for with that this from are was were using based paper method approach results data model models study"
    assert list(text.STOP) == stop.split() and all(f"'{w}'" in catalog.ORACLES["jaccard_pairs"] for w in stop.split())


@pytest.mark.parametrize("name, change", [
    ("components_sparse", lambda q: q.withColumn("component", q["id"] * 0 + 1)), ("inverted_index_text", lambda q: q.selectExpr("item_id", "replace(text, '  ', ' ') text")),
    ("label_parse", lambda q: q.selectExpr("event_id", "label", "confidence", "nullif(error, 'json_decode_error') error")), ("cci_scores", lambda q: q.selectExpr("*", "0.0 x").drop("x").withColumn("mean_pagerank_drop_z", q["cci"] * 0)),
])
def test_sql_tells_a_wrong_operator(spark, con, name, change):
    want = con.sql(catalog.ORACLES[name])
    rows = change(catalog.QUERIES[name](spark, SF))
    columns = sorted(rows.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted(tuple(plain(r[c]) for c in columns) for r in rows.collect()) != sorted(tuple(plain(r[k]) for k in at) for r in want.fetchall())
