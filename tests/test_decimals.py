"""The queries that give decimals against their SQL; test_oracles ends at the spelling of their type names, before any row."""

import os

import duckdb
import pytest

from parcelry.plans import bindings

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver's tables aren't here")


@pytest.mark.parametrize("name, decimal", [("conformed_table", "decimal(18,2)"), ("districts_file", "decimal(28,2)"), ("materialised_table", "decimal(28,2)")])
def test_same_decimals(spark, name, decimal):
    con = duckdb.connect()
    for t in ("customer", "orders", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    cursor = con.execute(bindings.oracle_sql()[name])
    kinds = {c[0]: str(c[1]).lower() for c in cursor.description}
    df = bindings.queries()[name](spark, FOLDER)
    assert {c: {"string": "varchar"}.get(k, k) for c, k in df.dtypes} == kinds and decimal in kinds.values()
    got = sorted(tuple(r[c] for c in kinds) for r in df.collect())
    assert got and got == sorted(cursor.fetchall())
