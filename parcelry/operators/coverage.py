"""Holders of cells, under alternative definitions of the labels, and facts merged by holder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelry.operators.rules import null_safe_join, positional_join


def lowest_holder(territories: DataFrame, cell: list[str], holder: str) -> DataFrame:
    """cell, its lowest holder (compared as it is typed, not as text) and how many it has."""
    return territories.where(F.col(holder).isNotNull()).groupBy(*cell).agg(F.min(holder).alias("holder"), F.countDistinct(holder).alias("n_holders"))


def covered(facts: DataFrame, holders: DataFrame, place: str, states: dict[str, str], channel: str, channels: DataFrame | None = None) -> DataFrame:
    """facts once for every state: state, channel, holder, n_holders and why there is none.

    states maps a state's name to the column that has the channel in it. NO CHANNEL: that column is NULL; NO MAP: the
    channel isn't among `channels`; NO HOLDER AT PLACE: it has no territory there; else COVERED.
    """
    stacked = F.explode(F.array(*(F.struct(F.lit(s).alias("state"), F.col(c).alias("_channel")) for s, c in states.items())))
    df = facts.withColumn("_s", stacked).select(*facts.columns, "_s.*")
    h = holders.withColumnRenamed(channel, "_channel")
    df = df.join(h, [place, "_channel"], "left")
    known = (channels or holders.select(channel)).distinct().select(F.col(channel).alias("_channel"), F.lit(True).alias("_known"))
    df = df.join(known, "_channel", "left")
    reason = F.when(F.col("_channel").isNull(), "NO CHANNEL").when(F.col("_known").isNull(), "NO MAP").when(F.col("holder").isNull(), "NO HOLDER AT PLACE").otherwise("COVERED")
    return df.withColumn("coverage", reason).withColumnRenamed("_channel", "state_channel").drop("_known")


def held_by(facts: DataFrame, territories: DataFrame, place: str, channel: str, seller: str, holder: str, name: str) -> DataFrame:
    """facts with a flag: does the seller hold the fact's cell?"""
    cells = territories.select(place, channel, F.col(holder).alias(seller)).distinct().withColumn("_held", F.lit(True))
    return facts.join(cells, [place, channel, seller], "left").withColumn(name, F.col("_held").isNotNull()).drop("_held")


def merged(parts: dict[str, tuple[DataFrame, str]], keys: list[str], holder: str = "holder") -> DataFrame:
    """One wide row for (keys, holder): each part's amount under its own holder column, 0 where it has none.

    parts maps a measure to (frame with keys, holder and that measure, its holder column).
    """
    stacked = None
    for measure, (df, own) in parts.items():
        row = df.select(*keys, F.col(own).alias(holder), *((F.col(m) if m == measure else F.lit(0)).cast("decimal(38,6)").alias(m) for m in parts))
        stacked = row if stacked is None else stacked.unionByName(row)
    return stacked.groupBy(*keys, holder).agg(*(F.sum(m).alias(m) for m in parts))


def paired(old: DataFrame, new: DataFrame, keys: list[str], holder: str) -> DataFrame:
    """The k-th old holder of a cell beside its k-th new one."""
    return positional_join(old.select(*keys, holder).distinct(), new.select(*keys, holder).distinct(), keys, [holder], [holder], ("old_", "new_"))


def placed(facts: DataFrame, pairs: DataFrame, keys: list[str], seller: str, old: str) -> DataFrame:
    """facts on one pair of their cell: the pair whose old holder sold, else the first. A fact is never repeated."""
    own = pairs.select(*keys, F.col(old).alias(seller), F.col("r").alias("_own")).where(F.col(seller).isNotNull())
    df = null_safe_join(facts, own, [*keys, seller]).withColumn("r", F.coalesce("_own", F.lit(1))).drop("_own")
    return null_safe_join(df, pairs, [*keys, "r"])


def dimension(territories: DataFrame, keys: list[str], holder: str, name: str) -> DataFrame:
    """One row for (keys, holder), with the one name that its holder has everywhere: the least."""
    from pyspark.sql import Window

    return territories.groupBy(*keys, holder).agg(F.min(name).alias("_n")).withColumn(name, F.min("_n").over(Window.partitionBy(holder))).drop("_n")


def allocated(parts: DataFrame, by: list[str], part: str, total: DataFrame, amount: str, name: str = "allocated") -> DataFrame:
    """A group's amount dealt out in proportion to its parts; groups whose parts sum to 0 get none."""
    from pyspark.sql import Window

    whole = F.sum(part).over(Window.partitionBy(*by))
    return parts.withColumn("_w", whole).join(total, by).withColumn(name, F.col(amount) * F.col(part) / F.nullif(F.col("_w"), F.lit(0).cast("double"))).drop("_w")


def not_net_zero(df: DataFrame, keys: list[str], amount: str) -> DataFrame:
    """The rows of keys whose amounts don't cancel."""
    return df.join(df.groupBy(*keys).agg(F.sum(amount).alias("_s")).where("_s <> 0").select(*keys), keys, "left_semi")


def bucket_and_all(df: DataFrame, keys: list[str], bucket: str, sums: list[str], all_: str = "ALL") -> DataFrame:
    """Sums by bucket, and over all buckets as one more: two grouping sets in one pass."""
    out = df.groupingSets([[*keys, bucket], keys], *keys, bucket).agg(*(F.sum(c).alias(c) for c in sums), F.grouping(bucket).alias("_g"))
    return out.withColumn(bucket, F.when(F.col("_g") == 1, all_).otherwise(F.col(bucket))).drop("_g")


def transfers(df: DataFrame, match: list[str], holder: str, old: str, new: str) -> DataFrame:
    """Giver and receiver of each amount that moved: rows of one key, one of which lost it and one of which got it."""
    giver = F.max(F.when(F.col(old) != 0, F.col(holder)))
    receiver = F.max(F.when(F.col(new) != 0, F.col(holder)))
    out = df.groupBy(*match).agg(giver.alias("giver"), receiver.alias("receiver"), F.sum(old).alias("given"), F.sum(new).alias("received"))
    return out.where(~F.col("giver").eqNullSafe(F.col("receiver")))


def books(df: DataFrame, holder: str, old: str, new: str) -> DataFrame:
    """Each holder's amount before and after, and the difference."""
    return df.groupBy(holder).agg(F.sum(old).alias("before"), F.sum(new).alias("after")).withColumn("delta", F.col("after") - F.col("before"))
