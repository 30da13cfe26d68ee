"""The training-data queries on the smallest data, and DuckDB's answers where SQL can give them."""

import os

import pytest

import __spark_entry__ as entry
from tidemark.llm import queries

duckdb = pytest.importorskip("duckdb")
COLUMNS = {
    "p3_found": ["parent_asin", "field_name", "ref_id"], "p4_found": ["plan_id", "dim_name", "bucket"], "p5_found": ["session_id"], "p6_found": ["asin_a", "asin_b"], "p8_ids": ["doc_id", "ids"],
    "p9_found": ["item_id", "doc_id"], "p10_found": ["doc_id"], "p2_found": ["raw_id", "value_path", "owner_path"], "p7_found": ["parent_asin", "field_name", "pos", "item_text"],
}


@pytest.fixture(scope="module")
def tables(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf, tables, name):
    df = entry.queries()[name](spark, sf)
    got = sorted((tuple(r) for r in df.collect()), key=repr)
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
        assert len({repr(r) for r in got}) == len(got)
    if name in queries.ORACLES:
        result = tables.execute(queries.ORACLES[name])
        order = [[d[0] for d in result.description].index(c) for c in df.columns]
        assert sorted((tuple(r[i] for i in order) for r in result.fetchall()), key=repr) == got


def test_pairs_are_ordered_and_of_the_catalogue(spark, sf):
    pairs = entry.queries()["p6_found"](spark, sf)
    assert pairs.filter("asin_a >= asin_b").count() == 0
    catalog = spark.read.parquet(f"{sf}/product_catalog.parquet").selectExpr("parent_asin AS asin_a")
    assert pairs.join(catalog, "asin_a", "left_anti").count() == 0


@pytest.mark.parametrize("name", [n for n in COLUMNS if n in queries.QUERIES])
def test_partitioning_does_not_matter(spark, sf, tmp_path, name):
    want = sorted(repr(tuple(r)) for r in entry.queries()[name](spark, sf).collect())
    for t in ("product_catalog", "proxy_products", "turns", "documents", "benchmark_items", "sample_targets", "canonical_values"):
        spark.read.parquet(f"{sf}/{t}.parquet").repartition(5).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert sorted(repr(tuple(r)) for r in entry.queries()[name](spark, str(tmp_path)).collect()) == want
