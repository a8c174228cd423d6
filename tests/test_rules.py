import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parcelry.functions import norm
from parcelry.functions.text import jaro_winkler
from parcelry.operators.checks import Violation
from parcelry.operators import resolve, rules


def one(spark, expr):
    return spark.range(1).select(expr).first()[0]


@pytest.mark.parametrize("raw,want", [("123", "00123"), (" 1234.0 ", "01234"), ("123456", "12345"), ("", None), (None, None), ("00501", "00501")])
def test_key5(spark, raw, want):
    assert one(spark, norm.key5(F.lit(raw).cast("string"))) == want


@pytest.mark.parametrize("raw,want", [("12", "12"), ("0", None), ("abc", None), (None, None), ("0012", "12")])
def test_opaque(spark, raw, want):
    assert one(spark, norm.opaque_id(F.lit(raw).cast("string"))) == want


@pytest.mark.parametrize("x,want", [(123456789.0, 123457000.0), (0.000123456789, 0.000123457), (0.0, 0.0), (-98765.4321, -98765.4)])
def test_significant(spark, x, want):
    assert one(spark, norm.significant(F.lit(x))) == pytest.approx(want, rel=1e-12)


def test_labels_and_tokens(spark):
    assert one(spark, norm.label(F.lit("  a b "))) == "A B" and one(spark, norm.label(F.lit("  "))) is None
    assert one(spark, norm.token(F.lit(" (A) b/c-d. "))) == "a_b_c_d"
    assert one(spark, norm.joined_key(F.lit("a"), F.lit(None).cast("string"))) is None
    assert one(spark, norm.blank_null(F.lit(" BLANK "), "BLANK")) is None
    sets = {"a": F.array(*map(F.lit, "xyz")), "b": F.array(F.lit("y")), "c": F.array(F.lit("w"))}
    assert one(spark, norm.set_expression("a - b + c", sets)) == ["w", "x", "z"]


@given(st.text(alphabet="ABCD ", max_size=9), st.text(alphabet="ABCD ", max_size=9))
@settings(max_examples=300, deadline=None)
def test_jaro_winkler_as_in_duckdb(a, b):
    import duckdb

    want = duckdb.execute("SELECT jaro_winkler_similarity(?, ?)", [a, b]).fetchone()[0]
    assert jaro_winkler(a, b) == pytest.approx(want, abs=1e-9)


def test_priority_ties_and_nulls(spark):
    rows = spark.createDataFrame([(1, "a", "x"), (2, None, "x"), (3, "b", None), (4, None, None), (1, "a", "x")], "id int, p string, q string")
    r = rules.rule_table(spark, [(2, "a", None, "A"), (1, None, "x", "X"), (3, "b", None, "B1")], "o int, p string, q string, out string")
    got = sorted((x.id, x.out or "") for x in rules.priority_join(rows, r, {"p": "p", "q": "q"}, "o", ["out"]).collect())
    assert got == [(1, "X"), (1, "X"), (2, "X"), (3, "B1"), (4, "")]
    tied = r.unionByName(rules.rule_table(spark, [(3, "b", None, "B2")], "o int, p string, q string, out string"))
    assert [x.o for x in rules.tied_rules(tied, "o", ["out"], ["p"]).collect()] == [3]
    with pytest.raises(Violation, match="tied rules"):
        rules.priority_join(rows, tied, {"p": "p", "q": "q"}, "o", ["out"])


def test_placeholder_rows(spark):
    assert rules.rule_table(spark, [("", None), ("a", 1)], "k string, v int").count() == 1


@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3)), max_size=12))
@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_strict_maximum(spark, rows):
    df = spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(rows)], "k int, v int, i int")
    want = set()
    for k in {k for k, _ in rows}:
        vs = sorted((v for q, v in rows if q == k), reverse=True)
        if len(vs) > 1 and vs[0] > vs[1]:
            want.add((k, vs[0]))
    assert {(r.k, r.v) for r in rules.strict_maximum(df, ["k"], "v", ["i"]).collect()} == want


def test_listed_keys(spark):
    df = spark.createDataFrame([("a", 1), ("a|b", 2), ("b|c|", 3), (" d ", 4), (None, 5), ("", 6)], "k string, v int")
    assert {(r.k, r.v) for r in rules.listed_keys(df, "k", ["v"]).collect()} == {("a", 1), ("b", 2), ("b", 3), ("c", 3), ("d", 4)}


def test_positional_join(spark):
    a = spark.createDataFrame([("k", 3), ("k", 1), ("m", 5)], "k string, h int")
    b = spark.createDataFrame([("k", 9), ("n", 7)], "k string, h int")
    got = sorted((r.k, r.r, r.o_h, r.n_h) for r in rules.positional_join(a, b, ["k"], ["h"], ["h"], ("o_", "n_")).collect())
    assert got == [("k", 1, 1, 9), ("k", 2, 3, None), ("m", 1, 5, None), ("n", 1, None, 7)]


def test_relabel(spark):
    e = spark.createDataFrame([("a", "R"), ("b", "R"), ("c", "UNMAPPED")], "k string, route string")
    listed = spark.createDataFrame([("a", "L"), ("b", "L1"), ("b", "L2")], "k string, label string")
    got = {r.k: (r.listed_labels, r.new_label) for r in resolve.relabel(e, listed, ["k"], "label").collect()}
    assert got == {"a": (1, "L"), "b": (2, "R"), "c": (0, None)}
