"""Outcome checks: every row of a source falls under one outcome of each check; outcomes are counted and weighed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelry.functions.norm import has_non_digit
from parcelry.operators.checks import all_of
from parcelry.operators.rules import in_or

#: A check: its source, its name, rows, and the outcome of each row.
Check = tuple[str, str, DataFrame, Column]
#: Routes that name no channel.
OPEN = ("unmapped", "several", "no rows", "no firm")


def counted(checks: list[Check], amount: str) -> DataFrame:
    """source, check, outcome, n, amount, pct_rows, pct_amount (of the check's rows and amount) for all checks. A check whose rows have no amount has NULL there."""
    parts = []
    for source, name, df, outcome in checks:
        total = F.sum(amount) if amount in df.columns else F.lit(None).cast("decimal(28,2)")
        parts.append(df.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"), total.alias("amount")).select(F.lit(source).alias("source"), F.lit(name).alias("check"), "outcome", "n", "amount"))
    w = Window.partitionBy("source", "check")
    pct = lambda c: F.round(100 * F.col(c).cast("double") / F.nullif(F.sum(c).over(w).cast("double"), F.lit(0.0)), 2)
    return all_of(parts).withColumns({"pct_rows": pct("n"), "pct_amount": pct("amount")})


def spread(df: DataFrame, by: list[str], channel: str, name: str) -> DataFrame:
    """By key: how many channels (name_k counts blank as one, name_c doesn't) and the only or smallest one (name_ch)."""
    blank = F.coalesce(channel, F.lit(""))
    return df.where(" AND ".join(f"{b} IS NOT NULL" for b in by)).groupBy(*by).agg(F.countDistinct(blank).alias(f"{name}_k"), F.countDistinct(channel).alias(f"{name}_c"), F.min(channel).alias(f"{name}_ch"))


def _route(c: str) -> Column:
    return F.when(F.col(f"{c}_c") == 0, "unmapped").when(F.col(f"{c}_c") == 1, F.col(f"{c}_ch")).otherwise("several")


def source_checks(s1: DataFrame, s2: DataFrame, overrides: DataFrame, out: list[str]) -> list[Check]:
    """Ten checks of how the second source's rows get a channel from the first's.

    s1: zip, firm, name, channel. s2: zip, firm, name, label. overrides: firm, name (NULL: any), channel. out: channels
    out of scope.
    """
    by_cell, by_name, by_firm = (spread(s1, by, "channel", n) for by, n in ((["zip", "firm", "name"], "cell"), (["firm", "name"], "nm"), (["firm"], "fm")))
    told1 = s1.join(by_cell, ["zip", "firm", "name"], "left").join(by_name, ["firm", "name"], "left")
    every = F.struct(F.count("*").alias("n"), F.countDistinct("channel").alias("k"), F.min("channel").alias("ch"))
    own = overrides.groupBy("firm", "name").agg(every.alias("o"))
    exact = own.where("name IS NOT NULL").withColumnRenamed("o", "exact")
    any_ = own.where("name IS NULL").select("firm", F.col("o").alias("any_"))
    told2 = s2.join(by_cell, ["zip", "firm", "name"], "left").join(by_name, ["firm", "name"], "left").join(by_firm, ["firm"], "left").join(exact, ["firm", "name"], "left").join(any_, ["firm"], "left")
    no_firm, named = F.col("firm").isNull(), F.col("nm_k").isNotNull()
    route = F.when(no_firm, "no firm").when(named, _route("nm")).when(F.col("fm_k").isNotNull(), _route("fm")).otherwise("no rows")
    told2 = told2.withColumn("route", route).withColumn("o", F.coalesce("exact", "any_"))
    k = F.col("o")["k"]
    against = (
        F.when(k.isNull(), "no override")
        .when(k == 0, "override blank")
        .when(k > 1, "override several")
        .when(F.col("route").isin(*OPEN), F.concat(F.lit("override fills "), "route"))
        .when(F.col("route") == F.col("o")["ch"], "same")
        .otherwise(F.concat(F.lit("override "), F.col("o")["ch"], F.lit(", route "), "route"))
    )
    one_or_more = lambda c, one, more: F.when(F.col(c) == 1, one).when(F.col(c) > 1, more)
    level = F.when(no_firm, "0").otherwise(F.coalesce(one_or_more("cell_k", "1", "2"), one_or_more("nm_k", "3", "4"), one_or_more("fm_k", "5", "6"), F.lit("7")))
    scope = lambda is_out, c: F.when(F.coalesce(is_out, F.lit(False)), F.concat(F.lit("out: "), c)).otherwise("in")
    of_firm = F.when(no_firm, "no firm").when(F.col("fm_k").isNull(), "no rows").when((F.col("fm_c") == 1) & (F.col("fm_k") == 1), F.col("fm_ch")).when(F.col("fm_c") == 0, "(blank)").otherwise("several")
    some = s2.where("firm IS NOT NULL")
    used = some.select("firm", "name").distinct().withColumn("used", F.lit(True))
    used_firm = some.select("firm").distinct().withColumn("used_firm", F.lit(True))
    keys = own.join(used, ["firm", "name"], "left").join(used_firm, ["firm"], "left")
    in_use = F.coalesce(F.when(F.col("name").isNull(), F.col("used_firm")).otherwise(F.col("used")), F.lit(False))
    form = F.concat(F.when(F.col("name").isNull(), "firm").otherwise("firm and name"), F.when(F.col("o")["n"] > 1, ", repeated").otherwise(""), F.when(k > 1, ", several channels").otherwise(""), F.when(in_use, "").otherwise(", not in use"))
    return [
        ("s1", "channels of a cell", told1, F.when(no_firm, "no firm").when(F.col("cell_k") > 1, "several in the cell").when(F.col("nm_k") > 1, "one in the cell, several in the firm").otherwise("one")),
        ("s1", "route", told1, F.when(no_firm, "no firm").when(F.col("nm_c") == 0, "unmapped").when(F.col("nm_c") > 1, "several").when(F.col("channel").isNull(), "one, row blank").otherwise("one")),
        ("s1", "scope", told1, scope((F.col("nm_c") == 1) & F.col("nm_ch").isin(*out), "nm_ch")),
        ("s2", "route", told2, F.col("route")),
        ("s2", "route level", told2, level),
        ("s2", "route against override", told2, against),
        ("s2", "scope", told2, scope(F.col("route").isin(*out), "route")),
        ("s2", "label and route", told2, F.concat("label", F.lit(" -> "), "route")),
        ("s2", "label and channel of the firm", told2, F.concat("label", F.lit(" -> "), of_firm)),
        ("override", "keys", keys, form),
    ]


def holder_moves(facts: DataFrame, old: DataFrame, new: DataFrame, place: str = "zip", holder: str = "holder") -> tuple[DataFrame, Column]:
    """What becomes of each fact's holder between two states (place, holder: one for each place)."""
    a, b = (df.select(place, F.col(holder).alias(n)) for df, n in ((old, "was"), (new, "is")))
    told = facts.join(a, place, "left").join(b, place, "left")
    was, is_ = F.col("was"), F.col("is")
    return told, F.when(was.isNull() & is_.isNull(), "no holder").when(was.isNull(), "new holder only").when(is_.isNull(), "no new holder").when(was == is_, "same holder").otherwise("other holder")


def key_form(c: Column, digits: int = 5) -> Column:
    n = F.length(c)
    return F.when(c.isNull() | (c == ""), "missing").when(has_non_digit(c), "non-digit").when(n == digits, f"{digits} digits").when(n < digits, f"under {digits} digits").otherwise(f"over {digits} digits")


def range_form(first: Column, last: Column, digits: int = 5) -> Column:
    return F.when(last.isNull(), "end missing").when(first == last, "same").when(F.left(first, F.lit(digits)) == F.left(last, F.lit(digits)), "within one key").otherwise("across keys")


def on_either_side(table: DataFrame, regions: DataFrame, key: str) -> tuple[DataFrame, Column]:
    both = table.select(key).distinct().withColumn("t", F.lit(True)).join(regions.select(key).distinct().withColumn("r", F.lit(True)), key, "full")
    return both, F.when(F.col("t").isNull(), "regions only").when(F.col("r").isNull(), "table only").otherwise("both")


def feed_audit(rows: DataFrame, marked: DataFrame, named: Column, company: Column, labels: list[str], amount: str) -> DataFrame:
    """Rows that a name, or a key among the marked ones, picks, by the company they resolve to: n, amount, pct of all picked."""
    g = in_or(rows, marked, named).groupBy(F.coalesce(company, F.lit("(dropped)")).alias("company"), *labels).agg(F.count("*").alias("n"), F.sum(amount).alias("amount"))
    total = g.agg(F.sum("amount").alias("total"))
    return g.crossJoin(F.broadcast(total)).withColumn("pct", F.round(100.0 * F.col("amount").cast("double") / F.nullif(F.col("total").cast("double"), F.lit(0.0)), 2)).drop("total")


def own_regions(df: DataFrame, company: Column, label: Column, region: Column, key: Column, holder: Column) -> DataFrame:
    return df.groupBy(company.alias("company"), label.alias("label")).agg(F.countDistinct(region).alias("regions"), F.countDistinct(key).alias("keys"), F.countDistinct(holder).alias("holders"))


def sellers(keys: DataFrame, sales: DataFrame, key: str, seller: str) -> DataFrame:
    """By key: whether nobody, one or several sell to it, how many, and the lowest."""
    told = keys.join(sales, key, "left").groupBy(key).agg(F.countDistinct(seller).alias("sellers"), F.min(seller).alias("lowest"))
    return told.select(key, F.when(F.col("sellers") == 0, "nobody").when(F.col("sellers") == 1, "one").otherwise("several").alias("covered"), "sellers", "lowest")
