"""The ledger: one row for each (place, fine channel), its owner and mass; and instances of a planning problem."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelry.operators.checks import Violation, require


def masses(extract: DataFrame, keys: list[str], mass: str = "m_rel") -> DataFrame:
    return extract.groupBy(*keys).agg(F.sum(mass).alias("mass"))


def positive_keys(extract: DataFrame, key: str, mass: str = "m_rel") -> DataFrame:
    """Keys whose mass over all channels is positive."""
    return extract.groupBy(key).agg(F.sum(mass).alias("_m")).where("_m > 0").select(key)


def subset(extract: DataFrame, keys: DataFrame) -> DataFrame:
    return extract.join(keys, keys.columns, "left_semi")


def instance(extract: DataFrame, channels: DataFrame, units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(channels with mass, tau and band, unit masses): tau is the mass for each of k districts, the band (1 +- delta) tau."""
    cells = extract.join(units, "zip").join(channels.select("channel", "fine"), "fine")
    per_unit = cells.groupBy("channel", "unit").agg(F.sum("m_rel").alias("mass"))
    k = channels.groupBy("channel").agg(F.first("k").alias("k"), F.first("delta").alias("delta"))
    total = per_unit.groupBy("channel").agg(F.sum("mass").alias("mass")).join(k, "channel")
    tau = total.withColumn("tau", F.col("mass") / F.col("k"))
    tau = tau.withColumns({"low": F.col("tau") * (1 - F.col("delta")), "high": F.col("tau") * (1 + F.col("delta"))})
    return tau, per_unit.withColumn("dropped", F.col("mass") <= 0)


def districts(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("channel", "district").agg(F.sum("m_rel").alias("drawn_mass"), F.countDistinct("zip").alias("zips"))


def long_export(ledgers: dict[str, DataFrame], key: list[str], masked: DataFrame | None = None) -> DataFrame:
    """All scenarios in one table; a key twice in a scenario is an error, and so is a rep that the masking table lacks."""
    out = None
    for name, df in ledgers.items():
        one = df.withColumn("scenario", F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    require(out.groupBy("scenario", *key).count().where("count > 1"), "key twice")
    if masked is not None:
        named = out.where("rep is not null").select("rep").distinct().join(masked, "rep", "left_anti")
        require(named, "rep without a mask")
        out = out.join(masked.select("rep", "alias"), "rep", "left").drop("rep").withColumnRenamed("alias", "rep")
    return out.withColumn("has_commercial_opportunity", F.col("m_rel") > 0)


def merge(parts: list[DataFrame], cell: list[str]) -> DataFrame:
    """Ledgers of disjoint cells as one, districts numbered anew through all parts, channel by channel."""
    all_ = None
    for i, df in enumerate(parts):
        one = df.withColumn("_part", F.lit(i))
        all_ = one if all_ is None else all_.unionByName(one)
    require(all_.groupBy(*cell).agg(F.countDistinct("_part").alias("n")).where("n > 1"), "cell in several parts")
    number = F.dense_rank().over(Window.partitionBy("channel").orderBy("_part", "district"))
    out = all_.withColumn("merged_district", number)
    for i, df in enumerate(parts):
        back = out.where(F.col("_part") == i).select(*df.columns)
        if not back.exceptAll(df).isEmpty() or not df.exceptAll(back).isEmpty():
            raise Violation("the merge changed rows")
    return out.drop("district", "_part").withColumnRenamed("merged_district", "district")


def named_districts(areas: DataFrame, district: list[str], area: str, mass: str) -> DataFrame:
    """Names from the two heaviest areas of each district; of equal names all but one get an ordinal, the heaviest district first."""
    ranked = areas.groupBy(*district, area).agg(F.sum(mass).alias("_m"))
    nth = F.row_number().over(Window.partitionBy(*district).orderBy(F.desc("_m"), area))
    top = ranked.withColumn("_n", nth)
    out = top.groupBy(*district).agg(F.sum("_m").alias("mass"), F.max(F.when(F.col("_n") == 1, F.col(area))).alias("_a"), F.max(F.when(F.col("_n") == 2, F.col(area))).alias("_b"))
    out = out.withColumn("_base", F.concat_ws("-", "_a", "_b"))
    same = F.count("*").over(Window.partitionBy("_base"))
    place = F.row_number().over(Window.partitionBy("_base").orderBy(F.desc("mass"), *district))
    out = out.withColumns({"_same": same, "_place": place})
    name = F.when(F.col("_same") > 1, F.concat_ws(" ", "_base", F.col("_place").cast("string"))).otherwise(F.col("_base"))
    return out.select(*district, "mass", name.alias("district_name"))


def channel_cells(ledger: DataFrame, order: str) -> DataFrame:
    """One owner for each (zip, channel): that of its first row, and how many rows say otherwise."""
    first = F.min_by("district", order).alias("district")
    named = ledger.groupBy("channel", "zip").agg(first, F.collect_set("district").alias("_all"), F.count("*").alias("rows"))
    return named.select("channel", "zip", "district", "rows", (F.size("_all") - 1).cast("long").alias("conflicts"))


def decoded(incumbent: DataFrame) -> DataFrame:
    """Districts from a solved plan (district, unit, share): shares as they are, but the largest of a unit takes what is left to 1."""
    w = Window.partitionBy("unit")
    order = F.row_number().over(w.orderBy(F.desc("share"), "district"))
    rest = 1 - (F.sum("share").over(w) - F.col("share"))
    return incumbent.withColumn("share", F.when(order == 1, rest).otherwise(F.col("share")))


def violations(rows: DataFrame, columns: DataFrame, entries: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """What an incumbent breaks. rows: row, low, high. columns: col, x, integer. entries: row, col, coef."""
    activity = entries.join(columns, "col").groupBy("row").agg(F.sum(F.col("coef") * F.col("x")).alias("activity"))
    told = rows.join(activity, "row", "left").withColumn("activity", F.coalesce("activity", F.lit(0.0)))
    by = F.greatest(F.coalesce(F.col("low") - F.col("activity"), F.lit(0.0)), F.coalesce(F.col("activity") - F.col("high"), F.lit(0.0)))
    broken = told.withColumn("by", by).where(F.col("by") > tolerance).select(F.lit("row").alias("kind"), F.col("row").cast("string").alias("name"), "by")
    frac = columns.where("integer").withColumn("by", F.abs(F.col("x") - F.round("x"))).where(F.col("by") > tolerance)
    return broken.unionByName(frac.select(F.lit("integrality").alias("kind"), F.col("col").cast("string").alias("name"), "by"))


def support_rows(supports: DataFrame, k: DataFrame) -> DataFrame:
    """The cover rows of a support master as sparse entries: each unit's shares sum to 1, each channel opens k supports.

    supports: channel, support, unit. k: channel, k. Gives row, col, coef.
    """
    share = supports.select(F.concat_ws(":", F.lit("cover"), "channel", "unit").alias("row"), F.concat_ws(":", F.lit("share"), "channel", "support", "unit").alias("col"), F.lit(1.0).alias("coef"))
    opened = supports.select("channel", "support").distinct().join(k, "channel").select(F.concat_ws(":", F.lit("count"), "channel").alias("row"), F.concat_ws(":", F.lit("open"), "channel", "support").alias("col"), F.lit(1.0).alias("coef"))
    return share.unionByName(opened)


def dealt(county: DataFrame, shares: DataFrame) -> DataFrame:
    """A county's population on its places by their share of its land; the total stays."""
    w = Window.partitionBy("county")
    part = F.col("land") / F.nullif(F.sum("land").over(w), F.lit(0).cast("double"))
    return shares.withColumn("_p", part).join(county, "county").withColumn("population", F.col("_p") * F.col("total")).drop("_p", "total")


def primary(bridge: DataFrame, key: str, value: str, weight: str) -> DataFrame:
    """The value of most weight for each key; ties go to the smallest."""
    w = Window.partitionBy(key).orderBy(F.desc(weight), value)
    return bridge.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(key, value)
