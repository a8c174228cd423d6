"""Queries over whole tables, where a query of the same operator has SQL that takes only some rows."""

from parcelry.plans import bindings


def frame(spark, rows, schema, folder, name):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


def test_exchange_components_whole(spark, tmp_path):
    """Customers of every key and nation count, not only those of c_custkey < 400 and c_nationkey < 6."""
    frame(spark, [(41, 7), (450, 7), (5010, 12), (451, 12), (5000, 20), (5001, 24)], "c_custkey long, c_nationkey int", tmp_path, "customer")
    got = {(r.district, r.component) for r in bindings.queries()["exchange_components"](spark, str(tmp_path)).collect()}
    assert got == {(27, 27), (32, 27), (37, 27), (40, 40), (49, 49)}


def test_support_model_whole(spark, tmp_path):
    """Customers from key 200 on have their columns too."""
    frame(spark, [(3, "A", 1), (200, "A", 1), (12345, "B", 2)], "c_custkey long, c_mktsegment string, c_nationkey int", tmp_path, "customer")
    got = {(r.row, r.col) for r in bindings.queries()["support_model"](spark, str(tmp_path)).collect()}
    shares = {("cover:A:1", "share:A:3:1"), ("cover:A:1", "share:A:0:1"), ("cover:B:2", "share:B:5:2")}
    assert got == shares | {("count:A", "open:A:3"), ("count:A", "open:A:0"), ("count:B", "open:B:5")}


def test_exactly_once_whole(spark, tmp_path):
    """Missing and repeated cells of any zip and channel are told, not only those of zip % 6 = 0 and channels below C."""
    frame(spark, [(1, "AUTO", 1, 5.0), (7, "MACHINERY", 2, 5.0), (7, "MACHINERY", 2, 5.0), (12, "AUTO", 3, 5.0), (12, "MACHINERY", 3, 5.0)], "c_custkey long, c_mktsegment string, c_nationkey int, c_acctbal double", tmp_path, "customer")
    got = {(r.zip, r.fine, r.n, r.what) for r in bindings.queries()["exactly_once"](spark, str(tmp_path)).collect()}
    assert got == {(1, "MACHINERY", 0, "missing"), (7, "AUTO", 0, "missing"), (7, "MACHINERY", 2, "repeated")}


def test_fuzzy_candidates_whole(spark, tmp_path):
    """Labels of parts of any size are candidates."""
    frame(spark, [("blue kettle", "TIN", 50), ("red lamp", "BRASS", 5)], "p_name string, p_type string, p_size int", tmp_path, "part")
    got = {(r.name, r.label, r.rank) for r in bindings.queries()["fuzzy_candidates"](spark, str(tmp_path)).collect()}
    assert got == {("blue kettle", "blue kettle tin", 1), ("red lamp", "red lamp brass", 1)}
