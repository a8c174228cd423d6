"""Exports without absolute amounts or names: masses over their median, shares, surrogate ids, and guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelry.functions.norm import significant
from parcelry.functions.text import folded
from parcelry.operators.checks import Violation, all_of, check_row


def descaled(df: DataFrame, amount: str, by: list[str] | None = None, name: str = "m_rel") -> DataFrame:
    """Amounts over the exact median of the positive ones (of their group): no absolute figure is left."""
    by = by or []
    d = df.where(F.col(amount) > 0).groupBy(*by).agg(F.percentile(amount, F.lit(0.5)).alias("_d"))
    out = df.join(d, by, "left") if by else df.crossJoin(F.broadcast(d))
    return out.withColumn(name, significant(F.col(amount) / F.nullif(F.col("_d"), F.lit(0).cast("double")))).drop("_d")


def shares(sales: DataFrame, cells: DataFrame, cell: list[str], rep: str, amount: str, mass: str) -> DataFrame:
    """Cells with the share of their mass that each rep sells, what is free, and their class: untapped, vacant or contested."""
    per = sales.groupBy(*cell, rep).agg(F.sum(amount).alias("_s")).where("_s > 0")
    joined = per.join(cells, cell).withColumn("_p", F.col("_s") / F.col(mass))
    maps = joined.groupBy(*cell).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(rep, "_p")))).alias("share"), F.sum("_p").alias("_t"), F.count("*").alias("_n"))
    out = cells.join(maps, cell, "left")
    kind = F.when(F.col("_n").isNull(), "vacant").when(F.col("_t") < 1, "untapped").otherwise("contested")
    return out.withColumns({"share_free": F.greatest(1 - F.coalesce("_t", F.lit(0.0)), F.lit(0.0)), "kind": kind}).drop("_t", "_n")


def headroom(share: Column | str, theta: float, target: float) -> Column:
    """The largest share after each has moved by theta towards the target."""
    s = F.col(share) if isinstance(share, str) else share
    return F.array_max(F.transform(F.map_values(s), lambda x: x + theta * (target - x)))


def repaired(df: DataFrame, share: str = "share") -> DataFrame:
    """Shares that sum to more than 1 are scaled to 1."""
    total = F.aggregate(F.map_values(share), F.lit(0.0), lambda a, x: a + x)
    return df.withColumn("_t", total).withColumn(share, F.when(F.col("_t") > 1, F.transform_values(share, lambda _, x: x / F.col("_t"))).otherwise(F.col(share))).drop("_t")


def share_checks(df: DataFrame, item: Column, share: str = "share", theta: float = 0.5, target: float = 0.5) -> DataFrame:
    values = F.map_values(share)
    return all_of(
        [
            check_row("share in [0, 1]", df.where(F.exists(values, lambda x: F.isnan(x) | (x < 0) | (x > 1 + 1e-9))), item, "cells"),
            check_row("headroom", df.where(headroom(share, theta, target) > 1 + 1e-9), item, "cells"),
        ]
    )


def surrogates(df: DataFrame, channel: str, name: str, amount: str, first: str, prefix: str = "R") -> DataFrame:
    """Ids by falling total, the reference channel's members first; ties by name."""
    t = df.groupBy(name).agg(F.sum(amount).alias("_t"), F.sum(F.when(F.col(channel) == first, F.col(amount))).alias("_f"))
    order = [F.col("_f").isNull(), F.desc("_f"), F.desc("_t"), F.col(name)]
    n = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order))
    return t.withColumn("surrogate", F.concat(F.lit(prefix), F.lpad(n.cast("string"), 3, "0"))).select(name, "surrogate")


def surrogate_moves(now: DataFrame, before: DataFrame, name: str) -> DataFrame:
    """Names whose surrogate isn't what it was."""
    both = now.join(before.select(name, F.col("surrogate").alias("was")), name, "full")
    return both.where(~F.col("surrogate").eqNullSafe(F.col("was")))


def channel_review(df: DataFrame, canonical: str, spelling: str, key: str, amount: str) -> DataFrame:
    """By channel: spellings, rows, cells, keys and the share of the amount."""
    total = F.sum("amount").over(Window.partitionBy())
    g = df.groupBy(canonical).agg(F.array_sort(F.collect_set(spelling)).alias("spellings"), F.count("*").alias("rows"), F.countDistinct(key).alias("keys"), F.sum(amount).alias("amount"))
    return g.withColumn("share", F.try_divide(F.col("amount"), total))


def guard(df: DataFrame, amount: str, texts: list[str], sentinels: list[str], most: float = 1e4, median: float = 1.0, tolerance: float = 1e-3, forbidden: tuple[str, ...] = ("divisor", "scale", "sales", "dollars")) -> None:
    """Raise unless the frame may leave: masses relative to a median of 1, none too large, no forbidden column, and no sentinel in any text, however it is spelt."""
    named = [c for c in df.columns if c.lower() in forbidden]
    if named:
        raise Violation(f"forbidden columns: {named}")
    figures = df.where(F.col(amount) > 0).agg(F.percentile(amount, F.lit(0.5)).alias("median"), F.max(amount).alias("most")).first()
    if figures.median is None or abs(figures.median - median) > tolerance or figures.most > most:
        raise Violation(f"masses aren't relative: median {figures.median}, largest {figures.most}")
    for c in texts:
        text = folded(F.col(c))
        bad = df.select(text.alias("t")).where(" OR ".join(f"contains(t, '{s.casefold()}')" for s in sentinels)) if sentinels else df.limit(0)
        if not bad.isEmpty():
            raise Violation(f"a sentinel in {c}")
