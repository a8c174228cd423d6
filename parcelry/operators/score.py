"""Scores of scenarios: splits, sizes, extents, gates, ranks and labels. Every frame may carry a scenario among its keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelry.operators.checks import require


#: Points of a group that are hulled together.
PART = 50_000


def split_units(cells: DataFrame, by: list[str], unit: str, district: str) -> DataFrame:
    """Units that several districts share: owners, and cuts (owners - 1)."""
    n = cells.groupBy(*by, unit).agg(F.countDistinct(district).alias("owners"))
    return n.where("owners > 1").withColumn("cuts", F.col("owners") - 1)


def small_and_crowded(cells: DataFrame, by: list[str], unit: str, district: str, mass: str, tau: DataFrame, small: float = 0.20) -> DataFrame:
    """By unit: pieces under `small` tau in a split unit, and whether more districts own it than its mass needs plus one."""
    pieces = cells.groupBy(*by, unit, district).agg(F.sum(mass).alias("piece")).join(tau, by)
    n = pieces.groupBy(*by, unit).agg(
        F.count("*").alias("owners"),
        F.sum("piece").alias("mass"),
        F.count_if(F.col("piece") < small * F.col("tau")).alias("small"),
        F.first("tau").alias("tau"),
    )
    need = F.ceil(F.col("mass") / F.col("tau")) + 1
    return n.select(*by, unit, "owners", F.when(F.col("owners") > 1, F.col("small")).otherwise(F.lit(0)).alias("small_pieces"), (F.col("owners") > need).alias("crowded"))


def thin_links(edges: DataFrame, owners: DataFrame, border: str, least: float) -> DataFrame:
    """District parts in a unit whose border with the district's other units is short. owners: vertex, unit, district."""
    a = owners.select(F.col("vertex").alias("a"), F.col("unit").alias("ua"), F.col("district").alias("d"))
    b = owners.select(F.col("vertex").alias("b"), F.col("unit").alias("ub"), F.col("district").alias("db"))
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), border))
    cross = both.join(a, "a").join(b, "b").where("d = db and ua <> ub")
    return cross.groupBy("d", "ua").agg(F.sum(border).alias("border")).where(F.col("border") < least).select(F.col("d").alias("district"), F.col("ua").alias("unit"), "border")


def land_balance(cells: DataFrame, by: list[str], district: str, mass: str, land: str, least: float = 0.2) -> DataFrame:
    """Most over least land among a group's pieces that hold at least `least` of its mass."""
    pieces = cells.groupBy(*by, district).agg(F.sum(mass).alias("m"), F.sum(land).alias("a"))
    share = F.try_divide(F.col("m"), F.sum("m").over(Window.partitionBy(*by)))
    kept = pieces.withColumn("share", share).where(F.col("share") >= least)
    return kept.groupBy(*by).agg(F.count("*").alias("pieces"), F.max("a").alias("most"), F.min("a").alias("least")).where("pieces > 1").withColumn("ratio", F.col("most").cast("double") / F.nullif(F.col("least").cast("double"), F.lit(0).cast("double")))


def deviations(districts: DataFrame, by: list[str], mass: str) -> DataFrame:
    """Worst and mean relative deviation of districts from their group's mean."""
    mean = F.avg(mass).over(Window.partitionBy(*by))
    dev = F.abs(F.try_divide(F.col(mass), mean) - 1)
    return districts.withColumn("_d", dev).groupBy(*by).agg(F.max("_d").alias("worst"), F.avg("_d").alias("mean"))


def weighted_quantile(df: DataFrame, by: list[str], value: str, weight: str, q: float, name: str) -> DataFrame:
    """The smallest value up to which at least q of the weight lies."""
    pre = df.groupBy(*by, value).agg(F.sum(weight).alias("_w"))
    w = Window.partitionBy(*by)
    cum = F.sum("_w").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    return pre.withColumns({"_c": cum, "_t": F.sum("_w").over(w)}).where(F.col("_c") >= q * F.col("_t") - 1e-12).groupBy(*by).agg(F.min(value).alias(name))


def centroids(points: DataFrame, by: list[str], coordinates: list[str], weight: str) -> DataFrame:
    """Weighted means; plain ones where the weight sums to 0 or less."""
    w = F.sum(weight)
    return points.groupBy(*by).agg(*(F.when(w > 0, F.sum(F.col(c) * F.col(weight)) / F.nullif(w, F.lit(0).cast("double"))).otherwise(F.avg(c)).alias(c) for c in coordinates))


def doughnuts(cells: DataFrame, district: str, metro: str, mass: str, core: float = 0.5) -> DataFrame:
    """District and metro pairs: the district's share of the metro, the metro's of the district, and whether it holds the core."""
    pair = cells.where(F.col(metro).isNotNull()).groupBy(district, metro).agg(F.sum(mass).alias("m"))
    return pair.select(
        district,
        metro,
        (F.col("m") / F.nullif(F.sum("m").over(Window.partitionBy(metro)), F.lit(0).cast("double"))).alias("of_metro"),
        (F.col("m") / F.nullif(F.sum("m").over(Window.partitionBy(district)), F.lit(0).cast("double"))).alias("of_district"),
    ).withColumn("core", F.col("of_metro") >= core)


def dollars(districts: DataFrame, rates: DataFrame, channel: str, mass: str, strict: bool = True) -> DataFrame:
    """Masses at their channel's rate; a channel without one is an error."""
    if strict:
        require(districts.join(rates, channel, "left_anti").select(channel).distinct(), "no rate")
    return districts.join(rates, channel).withColumn("dollars", F.col(mass) * F.col("rate")).drop("rate")


def rescaled(df: DataFrame, rates: DataFrame, channel: str, columns: list[str], back: bool = False) -> DataFrame:
    """Columns times their channel's rate, or over it; a frame that says it is scaled isn't scaled again."""
    if not back and "scaled" in df.columns or back and "scaled" not in df.columns:
        raise ValueError("scaled already" if not back else "not scaled")
    out = df.join(rates, channel).withColumns({c: F.col(c) / F.col("rate") if back else F.col(c) * F.col("rate") for c in columns}).drop("rate")
    return out.drop("scaled") if back else out.withColumn("scaled", F.lit(True))


def dollar_gate(districts: DataFrame, window: DataFrame, waivers: DataFrame, whole_cap: float) -> DataFrame:
    """Each district's gate: inside its channel's window, or a whole-unit district under the cap, or waived for exactly its set of units.

    districts: channel, district, dollars, units (array). window: channel, low, high. waivers: channel, units.
    """
    units = F.array_sort("units")
    w = waivers.select("channel", F.array_sort("units").alias("_u"), F.lit(True).alias("_waived")).distinct()
    df = districts.withColumn("_u", units).join(window, "channel").join(w, ["channel", "_u"], "left")
    gate = (
        F.when(F.col("dollars").between(F.col("low"), F.col("high")), "window")
        .when((F.size("units") == 1) & (F.col("dollars") <= whole_cap) & (F.col("dollars") >= F.col("low")), "whole unit")
        .when(F.col("_waived"), "waived")
        .when(F.col("dollars") < F.col("low"), "under")
        .otherwise("over")
    )
    return df.withColumn("gate", gate).withColumn("passes", ~F.col("gate").isin("under", "over")).drop("_u", "_waived", "low", "high")


def eligible(df: DataFrame, reasons: dict[str, Column], name: str = "eligible") -> DataFrame:
    """reasons: what speaks against a row, when it does. Eligible rows have none."""
    against = F.array_compact(F.array(*(F.when(c, F.lit(r)) for r, c in reasons.items())))
    return df.withColumn("reasons", against).withColumn(name, F.size("reasons") == 0)


def ranked(df: DataFrame, order: list[tuple[str, bool]], ident: str, by: list[str] | None = None, name: str = "rank") -> DataFrame:
    """Lexicographic rank over (column, descending) in turn; a missing metric comes last whichever way; ties by id."""
    keys = [F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_last() for c, down in order]
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*(by or [F.lit(0)])).orderBy(*keys, ident)))


def review(df: DataFrame, splits: str, defects: str, by: list[str]) -> DataFrame:
    """Rows worth a look: one split more than the group's best, and fewer defects than every row at the best."""
    w = Window.partitionBy(*by)
    best = F.min(splits).over(w)
    at_best = F.min(F.when(F.col(splits) == F.col("_best"), F.col(defects))).over(w)
    out = df.withColumn("_best", best).withColumn("_at", at_best)
    return out.withColumn("review", (F.col(splits) == F.col("_best") + 1) & (F.col(defects) < F.col("_at"))).drop("_best", "_at")


def outcome(gates: list[tuple[Column, str]], passed: str = "ok") -> Column:
    """The first gate that fails names the outcome."""
    return F.coalesce(*(F.when(c, F.lit(n)) for c, n in gates), F.lit(passed))


def breaches(measures: DataFrame, ident: list[str], limits: DataFrame, columns: list[str]) -> DataFrame:
    """Measures beyond their limit, in long form. limits: measure, most."""
    long = measures.unpivot(ident, columns, "measure", "value")
    return long.join(limits, "measure").where(F.col("value") > F.col("most"))


def unmeasured(measures: DataFrame, ident: list[str], columns: list[str]) -> DataFrame:
    return measures.unpivot(ident, columns, "measure", "value").where(F.col("value").isNull() | F.isnan(F.col("value").cast("double"))).drop("value")


def summary(measures: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Mean, least and most of each measure over the rows that have it."""
    long = measures.unpivot(by, columns, "measure", "value").where(F.col("value").isNotNull() & ~F.isnan(F.col("value").cast("double")))
    return long.groupBy(*by, "measure").agg(F.avg("value").alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"), F.count("*").alias("n"))


def plan_point(units: DataFrame, by: list[str], k: Column, low: Column, high: Column) -> DataFrame:
    """A channel's plan: tau, units that must be split (over tau / 2), the largest symmetric delta that stays in the window, or why there is none."""
    g = units.groupBy(*by).agg(F.sum("mass").alias("mass"), F.collect_list(F.struct("unit", "mass")).alias("_u"))
    g = g.withColumn("k", k).withColumn("tau", F.col("mass") / F.col("k"))
    split = F.array_sort(F.transform(F.filter("_u", lambda u: u["mass"] > F.col("tau") / 2), lambda u: u["unit"]))
    g = g.withColumn("split", split).withColumns({"low": low, "high": high})
    delta = F.floor(F.least(F.col("tau") - F.col("low"), F.col("high") - F.col("tau")) / F.col("tau") * 1e4 + 1e-9) / 1e4
    reason = F.when(F.col("mass") <= 0, "no mass").when(F.col("tau") < F.col("low"), "tau under the window").when(F.col("tau") > F.col("high"), "tau over the window")
    return g.withColumns({"reason": reason}).withColumn("delta", F.when(F.col("reason").isNull(), delta)).drop("_u")


def next_k(districts: DataFrame, by: list[str], k: str) -> DataFrame:
    """All failing districts under: one district less; all over: one more; mixed or none: no new try."""
    failing = F.col("gate").isin("under", "over")
    g = districts.where(failing).groupBy(*by, k).agg(F.bool_and(F.col("gate") == "under").alias("u"), F.bool_and(F.col("gate") == "over").alias("o"))
    return g.select(*by, k, F.when(F.col("u"), F.col(k) - 1).when(F.col("o"), F.col(k) + 1).alias("next_k"))


def dispersion(points: DataFrame, by: list[str], x: str, y: str, weight: str) -> DataFrame:
    """Moment of inertia about the centroid, and the root mean square distance."""
    c = centroids(points, by, [x, y], weight).withColumnsRenamed({x: "_cx", y: "_cy"})
    d2 = F.pow(F.col(x) - F.col("_cx"), F.lit(2)) + F.pow(F.col(y) - F.col("_cy"), F.lit(2))
    g = points.join(c, by).groupBy(*by).agg(F.sum(F.col(weight) * d2).alias("inertia"), F.sum(weight).alias("_w"))
    return g.withColumn("rms", F.sqrt(F.col("inertia") / F.nullif(F.col("_w"), F.lit(0).cast("double")))).drop("_w")


def extents(points: DataFrame, by: list[str], x: str, y: str, hull_schema: str | None = None) -> DataFrame:
    """The largest distance between two points of each group: between corners of the convex hull, which a task finds per group part.

    Parts of a group, as many as its size asks for, are hulled first, and the corners of the parts, few, then meet: no task
    gets a large group's points.
    """
    parts = points.groupBy(*by).agg(F.ceil(F.count("*") / PART).alias("_parts"))
    parted = points.join(parts, by).withColumn("_part", F.pmod(F.xxhash64(x, y), F.col("_parts"))).drop("_parts")
    corners = hulls(hulls(parted, [*by, "_part"], x, y), by, x, y)
    a, b = corners.toDF(*by, "ax", "ay"), corners.toDF(*by, "bx", "by_")
    d = F.sqrt(F.pow(F.col("ax") - F.col("bx"), F.lit(2)) + F.pow(F.col("ay") - F.col("by_"), F.lit(2)))
    return a.join(b, by).groupBy(*by).agg(F.max(d).alias("extent"))


def hulls(points: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """The corners of each group's convex hull, by the monotone chain."""
    import pandas as pd

    keys = [f"{k} {dict(points.dtypes)[k]}" for k in by]

    def corners(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        p = sorted(set(zip(g[x].tolist(), g[y].tolist(), strict=True)))

        def half(ps):
            out: list[tuple] = []
            for q in ps:
                while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                    out.pop()
                out.append(q)
            return out

        h = p if len(p) < 3 else half(p)[:-1] + half(p[::-1])[:-1]
        return pd.DataFrame([(*key, *q) for q in h], columns=[*by, x, y])

    out = points.select(*by, F.col(x).cast("double").alias(x), F.col(y).cast("double").alias(y)).distinct()
    return out.groupBy(*by).applyInPandas(corners, ", ".join([*keys, f"{x} double", f"{y} double"])).select(*(by[:-1] if by[-1:] == ["_part"] else by), x, y)


def index_rows(manifests: DataFrame) -> DataFrame:
    """Flat rows of run manifests; an older name of the parent's key is read too."""
    has = set(manifests.columns)
    parent = [F.col(c) for c in ("parent_run", "parent") if c in has]
    flat = [c for c in ("run_id", "lane", "formulation", "folder", "status", "stop_reason", "started_at", "finished_at") if c in has]
    return manifests.select(*flat, (F.coalesce(*parent) if parent else F.lit(None).cast("string")).alias("parent_run"))


def hash_differences(listed: DataFrame, found: DataFrame) -> DataFrame:
    """Files (path, sha) that are listed but missing or different; extra files don't matter."""
    both = listed.join(found.select("path", F.col("sha").alias("_f")), "path", "left")
    return both.where(~F.col("_f").eqNullSafe(F.col("sha"))).select("path", F.when(F.col("_f").isNull(), "missing").otherwise("differs").alias("what"))


def name_parts(title: Column | str) -> Column:
    """The first city of a metro's title: 'A-B, S-T' -> 'A'."""
    t = F.col(title) if isinstance(title, str) else title
    return F.split(F.split_part(t, F.lit(","), F.lit(1)), "-")[0]


def every(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, columns)
