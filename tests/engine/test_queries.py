"""Every query against its SQL in DuckDB, on the small tables."""

import math

import duckdb
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from waymark.plans import catalogue

SF = "/root/testdata/sf0.001"


def plain(v):
    return ("nan" if math.isnan(v) else round(v, 6)) if isinstance(v, float) else None if v is None else str(v)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, db, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    if name not in catalogue.ORACLES:
        assert name == "parquet_footers"
        file = pq.ParquetFile(f"{SF}/nation.parquet").metadata.row_group(0)
        assert {r["name"] for r in df.collect()} == {file.column(i).path_in_schema for i in range(file.num_columns)}
        return
    found = db.execute(catalogue.ORACLES[name])
    order = [c[0] for c in found.description]
    assert sorted(order) == columns
    assert rows == sorted((tuple(plain(r[order.index(c)]) for c in columns) for r in found.fetchall()), key=str)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[:3] == ["query_id", "rank", "address_id"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
