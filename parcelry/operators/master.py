"""A support master as sparse rows: which supports to open how often, and how a unit's mass is shared among them.

Columns are open:channel:support (n) and share:channel:support:unit (t). A row has a kind, bounds (NULL: none) and entries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelry.operators.checks import all_of
from parcelry.operators.graph import both_ways, stars


def _name(kind: str, *parts: str) -> Column:
    return F.concat_ws(":", F.lit(kind), *(F.col(p).cast("string") for p in parts))


def _entries(df: DataFrame, kind: str, row: list[str], terms: list[tuple[Column, Column]], low: Column, high: Column) -> DataFrame:
    """kind, row, col, coef, low, high: the terms (column, coefficient) of each row of df."""
    real = lambda c: c.cast("double")
    pairs = F.array(*(F.struct(c.alias("col"), real(x).alias("coef")) for c, x in terms))
    return df.select(F.lit(kind).alias("kind"), _name(kind, *row).alias("row"), F.explode(pairs).alias("e"), real(low).alias("low"), real(high).alias("high")).select("kind", "row", "e.col", "e.coef", "low", "high")


def master(supports: DataFrame, channels: DataFrame, masses: DataFrame, *, held: DataFrame, caps: DataFrame, places: DataFrame, floors: DataFrame, banned: DataFrame, near: DataFrame, borders: DataFrame) -> DataFrame:
    """All rows of the master: kind, row, col, coef, low, high.

    supports: channel, support, unit (its members). channels: channel, k, eta (least share of a unit), low, high (the band,
    in districts' masses). masses: channel, unit, mass (in districts' masses). held: channel, unit (whole or not at all).
    caps: channel, unit, cap (supports that may touch it). places: channel, unit, places. floors: channel, support, unit,
    floor (mass that a passage needs). banned: channel, support. near: channel, a, b (units that touch). borders: channel,
    unit, by, border (supports that may reach unit from by alone).
    """
    n, t = _name("open", "channel", "support"), _name("share", "channel", "support", "unit")
    none, zero, one = F.lit(None), F.lit(0.0), F.lit(1.0)
    opened = supports.select("channel", "support").distinct()
    own = supports.join(channels, "channel").join(masses, ["channel", "unit"])
    sized = opened.join(channels, "channel")
    # places that only one other member of the support touches
    inner = supports.join(both_ways_of(near), ["channel", "unit"]).join(supports.withColumnRenamed("unit", "by"), ["channel", "support", "by"])
    single = inner.groupBy("channel", "support", "unit").agg(F.countDistinct("by").alias("n"), F.min("by").alias("by")).where("n = 1")
    key = ["channel", "unit"]
    return all_of(
        [
            _entries(sized, "count", ["channel"], [(n, one)], F.col("k"), F.col("k")),
            _entries(supports, "cover", key, [(t, one)], one, one),
            _entries(own, "eta", ["channel", "support", "unit"], [(t, one), (n, -F.col("eta"))], zero, none),
            _entries(supports, "whole", ["channel", "support", "unit"], [(n, one), (t, -one)], zero, none),
            _entries(own, "band_lo", ["channel", "support"], [(t, F.col("mass"))], zero, none),
            _entries(sized, "band_lo", ["channel", "support"], [(n, -F.col("low"))], zero, none),
            _entries(own, "band_hi", ["channel", "support"], [(t, -F.col("mass"))], zero, none),
            _entries(sized, "band_hi", ["channel", "support"], [(n, F.col("high"))], zero, none),
            _entries(supports.join(held, key), "hold", ["channel", "support", "unit"], [(t, one), (n, -one)], zero, zero),
            _entries(supports.join(held, key).select("channel", "support").distinct(), "once", ["channel", "support"], [(n, one)], none, one),
            _entries(supports.join(caps, key), "contact", key, [(n, one)], none, F.col("cap")),
            _entries(supports.join(channels, "channel"), "eta_cap", key, [(n, one)], none, F.floor(1 / F.col("eta") + 1e-9)),
            _entries(supports.join(places, key), "count_cap", key, [(n, one)], none, F.col("places")),
            _entries(own.join(floors, ["channel", "support", "unit"]), "corridor", ["channel", "support", "unit"], [(t, F.col("mass")), (n, -F.col("floor"))], zero, none),
            _entries(single.join(borders, ["channel", "unit", "by"]), "border", ["channel", "unit", "by"], [(n, one)], none, F.col("border")),
            _entries(opened.join(banned, ["channel", "support"]), "ban", ["channel", "support"], [(n, one)], zero, zero),
        ]
    )


def both_ways_of(near: DataFrame) -> DataFrame:
    """channel, unit, by: every pair from either side."""
    return near.select("channel", F.col("a").alias("unit"), F.col("b").alias("by")).unionByName(near.select("channel", F.col("b").alias("unit"), F.col("a").alias("by"))).distinct()


def closure_violations(family: DataFrame, edges: DataFrame) -> DataFrame:
    """members, without: sets of a family (sorted arrays) less one member that are connected, not empty, and not in the family."""
    sets = family.select("members").distinct()
    less = sets.where(F.size("members") > 1).select("members", F.explode("members").alias("without")).withColumn("rest", F.array_remove("members", F.col("without")))
    lost = less.join(sets.select(F.col("members").alias("rest")), "rest", "left_anti")
    rests = lost.select("rest").distinct().withColumn("key", F.concat_ws(",", F.transform("rest", lambda x: x.cast("string"))))
    at = rests.select("key", F.explode("rest").alias("id"))
    node = lambda c: F.concat_ws("/", "key", F.col(c).cast("string"))
    within = at.withColumnRenamed("id", "a").join(both_ways(edges), "a").join(at.withColumnRenamed("id", "b"), ["key", "b"])
    found = stars(within.select(node("a").alias("a"), node("b").alias("b")))
    parts = at.withColumn("node", node("id")).join(found, "node", "left").groupBy("key").agg(F.countDistinct(F.coalesce("component", "node")).alias("parts"))
    whole = rests.join(parts.where("parts = 1"), "key", "left_semi").select("rest")
    return lost.join(whole, "rest", "left_semi").select("members", "without")
