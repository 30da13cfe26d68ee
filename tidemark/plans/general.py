"""Queries of the general data operators: nested records and packed fields."""

from __future__ import annotations

from tidemark.engine import table
from tidemark.operators import multivalue, nested


def p2_found(spark, sf_dir):
    return nested.value_rows(nested.shred(table(spark, sf_dir, "raw_products")))


def p2_objects(spark, sf_dir):
    return nested.apply_schema(nested.shred(table(spark, sf_dir, "raw_products")), "object")


def p7_found(spark, sf_dir):
    return multivalue.split_values(table(spark, sf_dir, "product_catalog"))


QUERIES = {f.__name__: f for f in (p2_found, p2_objects, p7_found)}
ORACLES: dict[str, str] = {}
