"""Reconciliation and audit: every check is rows (check, status, summary, items, counts)."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelry.operators.rules import null_safe_join

SCHEMA = "check string, status string, summary string, items array<string>, counts map<string, bigint>"
#: Items that a check row lists; counts hold all.
LISTED = 20


class Violation(ValueError):
    """A check that must hold doesn't."""


def check_row(name: str, offenders: DataFrame, item: Column, summary: str, status: str = "fail") -> DataFrame:
    """One row: `status` if there is any offender, else pass. The items are the first by their text."""
    listed = offenders.select(item.cast("string").alias("item"))
    first = listed.orderBy("item").limit(LISTED).agg(F.array_sort(F.collect_list("item")).alias("items"))
    n = listed.agg(F.count("*").alias("n"))
    return n.crossJoin(first).select(
        F.lit(name).alias("check"),
        F.when(F.col("n") == 0, "pass").otherwise(status).alias("status"),
        F.concat(F.col("n").cast("string"), F.lit(" " + summary)).alias("summary"),
        "items",
        F.create_map(F.lit("n"), F.col("n")).alias("counts"),
    )


def check_rows(name: str, groups: DataFrame, offenders: DataFrame, by: str, item: Column, summary: str, status: str = "fail") -> DataFrame:
    """check_row for every group at once: a row for each value of `by` in groups, whatever its offenders."""
    listed = offenders.select(by, item.cast("string").alias("item"))
    nth = F.row_number().over(Window.partitionBy(by).orderBy("item"))
    first = F.array_sort(F.collect_list(F.when(F.col("nth") <= LISTED, F.col("item"))))
    found = listed.withColumn("nth", nth).groupBy(by).agg(F.count("*").alias("n"), first.alias("items"))
    n = F.coalesce("n", F.lit(0).cast("long"))
    return groups.select(by).distinct().join(found, by, "left").select(
        by,
        F.lit(name).alias("check"),
        F.when(n == 0, "pass").otherwise(status).alias("status"),
        F.concat(n.cast("string"), F.lit(" " + summary)).alias("summary"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.create_map(F.lit("n"), n).alias("counts"),
    )


def verdict(checks: DataFrame) -> DataFrame:
    return checks.agg(F.when(F.bool_or(F.col("status") == "fail"), "fail").otherwise("pass").alias("verdict"))


def require(offenders: DataFrame, what: str) -> None:
    """Raise if there is any offender; names a few."""
    found = offenders.limit(5).collect()
    if found:
        raise Violation(f"{what}: {', '.join(str(tuple(r)) for r in found)}")


def all_of(frames: Iterable[DataFrame]) -> DataFrame:
    """One result set from heterogenous parts; what a part lacks is NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def signed_difference(source: DataFrame, target: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Keys whose measures differ: the source's rows and the target's, negated, summed together. No rows when the two agree."""
    neg = target.select(*keys, *((-F.col(m)).alias(m) for m in measures))
    total = source.select(*keys, *measures).unionByName(neg).groupBy(*keys).agg(*(F.sum(m).alias(m) for m in measures))
    return total.where(reduce(lambda a, b: a | b, [F.col(m) != 0 for m in measures]))


def tie_out(source: DataFrame, target: DataFrame, period: str, measures: list[str]) -> DataFrame:
    """period, measure, source, target and difference, a row for each measure."""

    def long(df: DataFrame, name: str) -> DataFrame:
        sums = df.groupBy(period).agg(*(F.sum(m).alias(m) for m in measures))
        return sums.unpivot([period], measures, "measure", name)

    both = long(source, "source_amount").join(long(target, "target_amount"), [period, "measure"], "full")
    zero = F.lit(0).cast("decimal(38,6)")
    return both.withColumn("difference", F.coalesce("source_amount", zero) - F.coalesce("target_amount", zero))


def flips(a: DataFrame, b: DataFrame, key: list[str], verdict_: str) -> DataFrame:
    """Keys on which two definitions disagree."""
    both = a.select(*key, F.col(verdict_).alias("first")).join(b.select(*key, F.col(verdict_).alias("second")), key, "full")
    return both.where(~F.col("first").eqNullSafe(F.col("second")))


# ---- scope

def in_scope(df: DataFrame, column: str, members: list[str], elsewhere: list[str], strict: bool = True) -> DataFrame:
    """Rows of the members; a value that neither list has is an error, not a silent drop."""
    if strict:
        require(df.where(~F.col(column).isin(members + elsewhere) | F.col(column).isNull()).select(column).distinct(), f"{column} in neither list")
    return df.where(F.col(column).isin(members))


def dropped_by_reason(df: DataFrame, dimension: DataFrame, key: str, mass: str, reasons: list[tuple[Column, str]]) -> tuple[DataFrame, DataFrame]:
    """(kept rows, reasons): the first reason that holds drops a row; reasons counts keys, rows and the share of the mass."""
    joined = df.join(dimension, key, "left")
    reason = reduce(lambda x, r: x.when(r[0], r[1]), reasons[1:], F.when(reasons[0][0], reasons[0][1]))
    told = joined.withColumn("reason", reason)
    total = df.agg(F.sum(mass).alias("_total"))
    lost = told.where("reason is not null").groupBy("reason").agg(F.countDistinct(key).alias("keys"), F.count("*").alias("rows"), F.sum(mass).alias("mass"))
    lost = lost.crossJoin(F.broadcast(total)).withColumn("share", F.try_divide(F.col("mass"), F.col("_total"))).drop("_total")
    return told.where("reason is null").select(*df.columns), lost


def join_rate(left: DataFrame, right: DataFrame, keys: list[str], amount: str, floor: float | None = None, worst: int = 8) -> tuple[DataFrame, DataFrame]:
    """(matched share of the amount, the keys that lose most); below the floor it raises."""
    known = right.select(*keys).distinct().withColumn("_hit", F.lit(True))
    told = left.join(known, keys, "left").withColumn("hit", F.col("_hit").isNotNull()).drop("_hit")
    rate = told.agg(F.sum(F.when(F.col("hit"), F.col(amount))).alias("matched"), F.sum(amount).alias("total"))
    lost = told.where(~F.col("hit")).groupBy(*keys).agg(F.sum(amount).alias("lost")).orderBy(F.desc("lost"), *keys).limit(worst)
    if floor is not None:
        r = rate.first()
        if not r.total or float(r.matched or 0) / float(r.total) < floor:
            raise Violation(f"only {r.matched} of {r.total} joins; worst: {[tuple(x) for x in lost.collect()]}")
    return rate, lost


def attach(df: DataFrame, dimension: DataFrame, keys: list[str], strict: bool = True) -> DataFrame:
    """df with the dimension's columns; a key that it lacks is an error."""
    if strict:
        require(df.join(dimension, keys, "left_anti").select(*keys).distinct(), "no such key in the dimension")
    return df.join(dimension, keys, "left")


# ---- the ledger's audit: cells (zip, fine, district, m_rel, rep) against what was declared

def cells_check(ledger: DataFrame, expected: DataFrame, cell: list[str]) -> DataFrame:
    """One owner per cell; no cell missing, none that isn't expected."""
    text = F.concat_ws("/", *cell)
    twice = ledger.groupBy(*cell).agg(F.countDistinct("district").alias("n")).where("n > 1")
    owned = ledger.where("district is not null")
    return all_of(
        [
            check_row("one owner per cell", twice, text, "cells with several owners"),
            check_row("cells not placed", expected.join(owned, cell, "left_anti"), text, "expected cells without owner"),
            check_row("cells not expected", owned.join(expected, cell, "left_anti").select(*cell).distinct(), text, "owned cells that nobody expected"),
        ]
    )


def count_check(ledger: DataFrame, spec: DataFrame) -> DataFrame:
    """spec: channel, k. As many districts as declared, in declared channels only."""
    n = ledger.groupBy("channel").agg(F.countDistinct("district").alias("n"))
    both = n.join(spec, "channel", "full").where(~F.col("n").eqNullSafe(F.col("k")))
    return check_row("district count", both, F.concat_ws(" ", "channel", F.coalesce(F.col("n").cast("string"), F.lit("none")), F.lit("of"), F.coalesce(F.col("k").cast("string"), F.lit("undeclared"))), "channels with another count")


def band_check(ledger: DataFrame, spec: DataFrame, slack: float = 1e-9) -> DataFrame:
    """spec: channel, low, high. Each district's drawn mass is in its channel's band."""
    mass = ledger.groupBy("channel", "district").agg(F.sum("m_rel").alias("mass"))
    out = mass.join(spec, "channel").where(~F.col("mass").between(F.col("low") - slack, F.col("high") + slack))
    return check_row("final bands", out, F.concat_ws("/", "channel", "district"), "districts outside their band")


def dropped_check(ledger: DataFrame, dropped: DataFrame) -> DataFrame:
    """dropped: unit. Only units without mass may be dropped."""
    mass = ledger.groupBy("unit").agg(F.sum("m_rel").alias("mass")).where("mass > 0")
    return check_row("drops are empty", dropped.join(mass, "unit"), F.col("unit").cast("string"), "dropped units that have mass")


def phantom_check(reported: DataFrame, drawn: DataFrame, key: list[str], tolerance: float = 1e-9) -> DataFrame:
    """Shares that are reported but not drawn, or not of that size; NaN offends first."""
    both = reported.select(*key, F.col("share").alias("told")).join(drawn.select(*key, F.col("share").alias("is")), key, "full")
    bad = F.isnan("told") | (F.abs(F.coalesce("told", F.lit(0.0)) - F.coalesce("is", F.lit(0.0))) > tolerance)
    return check_row("phantom shares", both.where(F.coalesce(bad, F.lit(False))), F.concat_ws("/", *key), "shares that the ledger doesn't back")


def planned_check(planned: DataFrame, drawn: DataFrame, key: list[str]) -> DataFrame:
    """Owners that vanished between plan and drawing, and owners that appeared."""
    text = F.concat_ws("/", *key)
    return all_of(
        [
            check_row("planned, not drawn", planned.select(*key).distinct().join(drawn, key, "left_anti"), text, "owners vanished"),
            check_row("drawn, not planned", drawn.select(*key).distinct().join(planned, key, "left_anti"), text, "owners appeared"),
        ]
    )


def mode_check(ledger: DataFrame, modes: DataFrame) -> DataFrame:
    """modes: channel, mode. In mode whole a unit has one owner; in mode clipped an owner of several units owns only whole ones."""
    own = ledger.join(modes, "channel")
    per_unit = own.groupBy("channel", "mode", "unit").agg(F.countDistinct("district").alias("owners"))
    split = per_unit.where("owners > 1")
    several = own.where("mode = 'clipped'").join(split.where("mode = 'clipped'").select("channel", "unit"), ["channel", "unit"], "left_semi")
    spread = own.where("mode = 'clipped'").groupBy("channel", "district").agg(F.countDistinct("unit").alias("units")).where("units > 1")
    clipped = several.select("channel", "district", "unit").distinct().join(spread, ["channel", "district"])
    return all_of(
        [
            check_row("whole units", split.where("mode = 'whole'"), F.concat_ws("/", "channel", F.col("unit").cast("string")), "units with several owners"),
            check_row("clipped units", clipped, F.concat_ws("/", "channel", F.col("unit").cast("string"), "district"), "owners beyond their unit"),
        ]
    )


def names_check(districts: DataFrame, name: str = "district_name") -> DataFrame:
    blank = districts.where(F.coalesce(F.trim(name), F.lit("")) == "").select(F.lit("(blank)").alias("item"))
    same = districts.where(F.trim(name) != "").groupBy(F.lower(F.trim(name)).alias("item")).count().where("count > 1").select("item")
    return check_row("unique names", blank.unionByName(same), F.col("item"), "names blank or used twice")


def file_names_check(names: DataFrame, name: str) -> DataFrame:
    """Names that would be one file on a store that ignores case."""
    same = names.groupBy(F.lower(F.trim(name)).alias("item")).count().where("count > 1")
    return check_row("file names", same, F.col("item"), "names that fall together")


def reps_check(ledger: DataFrame) -> DataFrame:
    several = ledger.where("rep is not null").groupBy("channel", "district").agg(F.countDistinct("rep").alias("n")).where("n > 1")
    return check_row("one rep per district", several, F.concat_ws("/", "channel", "district"), "districts with several reps")


def partition_check(units: DataFrame, fine: DataFrame, domains: DataFrame) -> DataFrame:
    """Every (unit, fine channel) lies in exactly one domain. fine is a small table."""
    n = domains.groupBy("unit", "fine").agg(F.count("*").alias("n"))
    all_ = units.select("unit").distinct().crossJoin(F.broadcast(fine.select("fine").distinct()))
    bad = all_.join(n, ["unit", "fine"], "left").where(F.coalesce("n", F.lit(0)) != 1)
    return check_row("partition", bad, F.concat_ws("/", F.col("unit").cast("string"), "fine"), "cells in no domain or several")


def route_check(cells: DataFrame, domains: DataFrame, fallback: str) -> DataFrame:
    """Purity: a cell's model channel is the one its domain names, or the fallback where no domain has it."""
    want = cells.join(domains.select("unit", "fine", F.col("channel").alias("want")), ["unit", "fine"], "left")
    bad = want.where(F.col("channel") != F.coalesce("want", F.lit(fallback)))
    return check_row("routing", bad, F.concat_ws("/", F.col("unit").cast("string"), "fine", "channel"), "cells routed elsewhere")


def manifest_check(entries: DataFrame, needed: DataFrame, vintage: str) -> DataFrame:
    """entries: name, vintage, sha256. All that is needed is there, of one vintage, with well-formed hashes."""
    return all_of(
        [
            check_row("manifest complete", needed.join(entries, "name", "left_anti"), F.col("name"), "entries missing"),
            check_row("one vintage", entries.where(F.col("vintage") != vintage), F.col("name"), "entries of another vintage"),
            check_row("hash form", entries.where(~F.coalesce(F.col("sha256"), F.lit("")).rlike("^[0-9a-f]{64}$")), F.col("name"), "malformed hashes"),
        ]
    )


def certificate(objective: Column, bound: Column, gap: Column, tolerance: float = 1e-6) -> Column:
    """What a solver's report certifies: invalid, none, feasible only, bounded or exact."""
    real = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    computed = F.abs(objective - bound) / F.greatest(F.abs(objective), F.lit(1e-9))
    agrees = gap.isNull() | (F.abs(computed - gap) <= tolerance + 1e-3 * F.abs(gap))
    return (
        F.when(objective.isNull(), "none")
        .when(~real(objective) | (bound.isNotNull() & (F.isnan(bound) | (bound > objective + tolerance * F.greatest(F.abs(objective), F.lit(1.0))))), "invalid")
        .when(bound.isNull() | ~real(bound), "feasible only")
        .when(~agrees, "invalid")
        .when(computed <= tolerance, "exact")
        .otherwise("bounded")
    )


def catalog(checks: dict[str, DataFrame]) -> DataFrame:
    """Checks of many scenarios: how many of each status, by scenario."""
    return by_status(all_of([df.withColumn("scenario", F.lit(name)) for name, df in checks.items()]))


def by_status(rows: DataFrame) -> DataFrame:
    """scenario, and how many of its checks have each status."""
    return rows.groupBy("scenario").pivot("status", ["pass", "fail", "listed", "unverified"]).count().na.fill(0)


def tracked(files: DataFrame) -> DataFrame:
    """files: folder, file, run_id (NULL unless a manifest), modified. Folders whose ledger lacks a manifest, images older than it, ids used twice."""
    has = lambda f: F.max(F.when(F.col("file") == f, F.col("modified")))
    by = files.groupBy("folder").agg(has("ledger.csv").alias("ledger"), has("manifest.json").alias("manifest"), F.min(F.when(F.col("file").rlike(r"\.png$"), F.col("modified"))).alias("image"))
    ids = files.where("run_id is not null").groupBy("run_id").agg(F.countDistinct("folder").alias("n")).where("n > 1")
    return all_of(
        [
            check_row("ledger without manifest", by.where("ledger is not null and manifest is null"), F.col("folder"), "folders"),
            check_row("stale images", by.where("image < ledger"), F.col("folder"), "folders", "listed"),
            check_row("duplicate ids", ids, F.col("run_id"), "run ids"),
        ]
    )


def compared(live: DataFrame, rebuilt: DataFrame, keys: list[str], amount: str) -> DataFrame:
    """Live and rebuilt amounts side by side, where they differ."""
    a = live.groupBy(*keys).agg(F.sum(amount).alias("live"))
    b = rebuilt.groupBy(*keys).agg(F.sum(amount).alias("rebuilt"))
    zero = F.lit(0).cast("decimal(38,6)")
    both = null_safe_join(a.withColumn("_a", F.lit(1)), b.withColumn("_b", F.lit(1)), keys, "left")
    only = null_safe_join(b, a, keys, "left_anti").withColumn("live", F.lit(None).cast("decimal(38,6)"))
    out = both.select(*keys, "live", "rebuilt").unionByName(only.select(*keys, "live", "rebuilt"))
    return out.withColumn("shortfall", F.coalesce("live", zero) - F.coalesce("rebuilt", zero)).where("shortfall <> 0")
