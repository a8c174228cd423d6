"""Every query of the reference's operators against the SQL that must give the same rows, in DuckDB."""

import math
import os

import duckdb
import pytest

from parcelry.plans import bindings

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    return v.isoformat() if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(bindings.oracle_sql()))
def test_same_rows(spark, duck, name):
    df = bindings.queries()[name](spark, FOLDER)
    cursor = duck.execute(bindings.oracle_sql()[name])
    kinds = {c[0]: str(c[1]) for c in cursor.description}
    assert {f.name: KINDS.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields} == kinds
    columns = sorted(kinds)
    at = [list(kinds).index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in at) for r in cursor.fetchall()), key=repr)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got == want


def test_entry(spark):
    assert bindings.entry(spark, FOLDER).count() > 0


@pytest.mark.parametrize("name", ["rule_priority_join", "override_specific_general", "null_safe_multi_key_join", "fact_resolution", "pattern_join", "coverage_states", "paired_holders"])
def test_no_nested_loops_nor_single_partitions(spark, name):
    """Rule and cascade joins are equi-joins, and no window or sort gathers a whole table."""
    plan = bindings.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "SinglePartition" not in plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = bindings.queries()["coverage_gap"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_totalprice,450000.0)" in plan and "o_orderdate" not in plan
