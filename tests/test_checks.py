import pytest
from pyspark.sql import functions as F

from parcelry.operators import checks, export, ledger, profile, score
from parcelry.operators.checks import Violation


def status(df):
    return {r.check: (r.status, r.items) for r in df.collect()}


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_scope_fails_on_unknown_members(spark):
    df = frame(spark, [("a",), ("b",), ("z",)], "f string")
    assert checks.in_scope(df.where("f <> 'z'"), "f", ["a"], ["b"]).count() == 1
    with pytest.raises(Violation, match="neither"):
        checks.in_scope(df, "f", ["a"], ["b"])


def test_join_rate_floor(spark):
    a, b = frame(spark, [("x", 60.0), ("y", 40.0)], "k string, v double"), frame(spark, [("x",)], "k string")
    assert checks.join_rate(a, b, ["k"], "v", floor=0.6)[0].first().matched == 60
    with pytest.raises(Violation, match="worst"):
        checks.join_rate(a, b, ["k"], "v", floor=0.7)


def test_attach_fails_on_a_missing_key(spark):
    with pytest.raises(Violation, match="dimension"):
        checks.attach(frame(spark, [("x",)], "k string"), frame(spark, [("y", 1)], "k string, v int"), ["k"])


def test_signed_difference_is_empty_for_equal_tables(spark):
    a = frame(spark, [("x", 1), ("x", 2), (None, 3)], "k string, v int")
    assert checks.signed_difference(a, a, ["k"], ["v"]).count() == 0
    assert [tuple(r) for r in checks.signed_difference(a, a.where("v <> 3"), ["k"], ["v"]).collect()] == [(None, 3)]


LEDGER = "zip int, channel string, fine string, unit int, district string, rep string, m_rel double"
ROWS = [(i, "A", "A", i // 2, f"D{i // 2}", f"R{i // 2}", 1.0) for i in range(8)]


def test_clean_ledger_passes(spark):
    led = frame(spark, ROWS, LEDGER)
    spec = frame(spark, [("A", 4, 1.9, 2.1, "whole")], "channel string, k long, low double, high double, mode string")
    rows = checks.all_of([checks.cells_check(led, led.select("zip", "channel"), ["zip", "channel"]), checks.count_check(led, spec.select("channel", "k")), checks.band_check(led, spec), checks.mode_check(led, spec.select("channel", "mode")), checks.reps_check(led)])
    assert {r.status for r in rows.collect()} == {"pass"} and checks.verdict(rows).first()[0] == "pass"


def test_planted_defects(spark):
    bad = ROWS + [(3, "A", "A", 1, "D0", "R9", 0.5)]
    led = frame(spark, bad, LEDGER)
    spec = frame(spark, [("A", 5, 1.9, 2.1, "whole"), ("B", 1, 0.0, 1.0, "whole")], "channel string, k long, low double, high double, mode string")
    got = status(checks.cells_check(led, led.select("zip", "channel").distinct().where("zip < 7"), ["zip", "channel"]))
    assert got["one owner per cell"] == ("fail", ["3/A"]) and got["cells not expected"] == ("fail", ["7/A"]) and got["cells not placed"][0] == "pass"
    assert status(checks.count_check(led, spec.select("channel", "k")))["district count"] == ("fail", ["A 4 of 5", "B none of 1"])
    assert status(checks.band_check(led, spec))["final bands"] == ("fail", ["A/D0"])
    assert status(checks.mode_check(led, spec.select("channel", "mode")))["whole units"] == ("fail", ["A/1"])
    assert status(checks.reps_check(led))["one rep per district"] == ("fail", ["A/D0"])
    assert status(checks.dropped_check(led, frame(spark, [(0,), (9,)], "unit int")))["drops are empty"] == ("fail", ["0"])


def test_phantom_nan_and_names(spark):
    told = frame(spark, [("a", 0.5), ("b", float("nan")), ("c", 0.2)], "k string, share double")
    drawn = frame(spark, [("a", 0.5), ("b", 0.1)], "k string, share double")
    assert status(checks.phantom_check(told, drawn, ["k"]))["phantom shares"] == ("fail", ["b", "c"])
    names = frame(spark, [("North",), ("north ",), ("",), (None,), ("South",)], "district_name string")
    assert status(checks.names_check(names))["unique names"] == ("fail", ["(blank)", "(blank)", "north"])


def test_clipped_mode(spark):
    led = frame(spark, [(1, "A", "A", 1, "D1", "R", 1.0), (2, "A", "A", 1, "D2", "R", 1.0), (3, "A", "A", 2, "D2", "R", 1.0), (4, "A", "A", 3, "D3", "R", 1.0)], LEDGER)
    got = status(checks.mode_check(led, frame(spark, [("A", "clipped")], "channel string, mode string")))
    assert got["clipped units"] == ("fail", ["A/1/D2"]) and got["whole units"][0] == "pass"


def test_manifest_and_tracking(spark):
    e = frame(spark, [("a", "2025", "0" * 64), ("b", "2024", "xyz")], "name string, vintage string, sha256 string")
    got = status(checks.manifest_check(e, frame(spark, [("a",), ("c",)], "name string"), "2025"))
    assert got == {"manifest complete": ("fail", ["c"]), "one vintage": ("fail", ["b"]), "hash form": ("fail", ["b"])}
    f = frame(spark, [("x", "ledger.csv", None, 5), ("y", "ledger.csv", None, 5), ("y", "manifest.json", "id", 5), ("y", "map.png", None, 4), ("z", "manifest.json", "id", 1)], "folder string, file string, run_id string, modified int")
    assert status(checks.tracked(f)) == {"ledger without manifest": ("fail", ["x"]), "stale images": ("listed", ["y"]), "duplicate ids": ("fail", ["id"])}


def test_routes_and_partition(spark):
    dom = frame(spark, [(1, "f", "M"), (2, "f", "M")], "unit int, fine string, channel string")
    cells = frame(spark, [(1, "f", "M"), (2, "f", "N"), (3, "f", "N")], "unit int, fine string, channel string")
    assert status(checks.route_check(cells, dom, "N"))["routing"] == ("fail", ["2/f/N"])
    assert status(checks.partition_check(cells, cells, dom))["partition"] == ("fail", ["3/f"])
    c = checks.catalog({"s1": checks.route_check(cells, dom, "N"), "s2": checks.route_check(cells.limit(0), dom, "N")})
    assert {r.scenario: (r["pass"], r.fail) for r in c.collect()} == {"s1": (0, 1), "s2": (1, 0)}


def test_merge_and_export_guards(spark):
    led = frame(spark, ROWS, LEDGER)
    with pytest.raises(Violation, match="several parts"):
        ledger.merge([led, led], ["zip", "channel"])
    with pytest.raises(Violation, match="key twice"):
        ledger.long_export({"s": led.unionByName(led)}, ["zip", "channel"])
    with pytest.raises(Violation, match="mask"):
        ledger.long_export({"s": led}, ["zip", "channel"], frame(spark, [("R0", "M0")], "rep string, alias string"))


def test_guard(spark):
    ok = frame(spark, [("R001", 0.5), ("R002", 1.0), ("R003", 2.0)], "rep string, m_rel double")
    export.guard(ok, "m_rel", ["rep"], ["acme"])
    with pytest.raises(Violation, match="sentinel"):
        export.guard(ok.withColumn("rep", F.lit("an ＡＣＭＥ firm")), "m_rel", ["rep"], ["acme"])
    with pytest.raises(Violation, match="relative"):
        export.guard(ok.withColumn("m_rel", F.col("m_rel") * 7), "m_rel", ["rep"], [])
    with pytest.raises(Violation, match="forbidden"):
        export.guard(ok.withColumn("Divisor", F.lit(1)), "m_rel", [], [])


def test_shares(spark):
    cells = frame(spark, [("c1", 10.0), ("c2", 10.0), ("c3", 10.0)], "c string, m double")
    sales = frame(spark, [("c1", "a", 4.0), ("c1", "b", 2.0), ("c2", "a", 9.0), ("c2", "b", 6.0)], "c string, r string, v double")
    s = export.shares(sales, cells, ["c"], "r", "v", "m")
    got = {r.c: (r.share, round(r.share_free, 9), r.kind) for r in s.collect()}
    assert got == {"c1": ({"a": 0.4, "b": 0.2}, 0.4, "untapped"), "c2": ({"a": 0.9, "b": 0.6}, 0.0, "contested"), "c3": (None, 1.0, "vacant")}
    fixed = {r.c: r.share for r in export.repaired(s).collect()}
    assert fixed["c2"] == pytest.approx({"a": 0.6, "b": 0.4}) and fixed["c1"] == {"a": 0.4, "b": 0.2}
    moved = export.surrogate_moves(frame(spark, [("a", "R001"), ("b", "R002")], "n string, surrogate string"), frame(spark, [("a", "R001"), ("b", "R003")], "n string, surrogate string"), "n")
    assert [r.n for r in moved.collect()] == ["b"]


def test_rescaling_guard(spark):
    rates = frame(spark, [("A", 2.0)], "channel string, rate double")
    df = frame(spark, [("A", 3.0)], "channel string, m double")
    up = score.rescaled(df, rates, "channel", ["m"])
    assert up.first().m == 6 and score.rescaled(up, rates, "channel", ["m"], back=True).first().m == 3
    with pytest.raises(ValueError):
        score.rescaled(up, rates, "channel", ["m"])
    with pytest.raises(Violation, match="rate"):
        score.dollars(frame(spark, [("B", 1.0)], "channel string, m double"), rates, "channel", "m")


def test_profile_of_empty_columns(spark):
    df = frame(spark, [("a", None), ("b", None)], "x string, y string")
    assert [r.column_name for r in profile.unfilled(df).collect()] == ["y"]
