"""A list for people to decide: what stayed unresolved, and the candidates that evidence offers, best first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelry.functions.text import similarity
from parcelry.operators.rules import null_safe_join, top_k


def near_lengths(a: Column | str, b: Column | str, least: int) -> Column:
    """Whether two names' lengths let them be `least` similar: a Jaro-Winkler score of s needs a Jaro score of (s - 0.4) / 0.6, which is (2 + shorter / longer) / 3 at most."""
    ratio = 3 * ((least - 0.5) / 100 - 0.4) / 0.6 - 2
    n, m = F.length(a), F.length(b)
    return F.least(n, m) >= F.greatest(n, m) * (ratio - 1e-9)


def near_names(names: DataFrame, entities: DataFrame, name: str, entity: str, least: int = 85, k: int = 5) -> DataFrame:
    """For each distinct name, the k most similar entities that are similar enough: name, entity, sim. Both sides are name dimensions."""
    a = names.select(name).where(F.col(name).isNotNull()).distinct()
    s = a.join(entities.select(entity).distinct(), near_lengths(F.trim(name), F.trim(entity), least)).withColumn("sim", similarity(F.trim(name), F.trim(entity)))
    return top_k(s, [name], [F.desc("sim"), entity], k).where(F.col("sim") >= least).select(name, entity, "sim")


def review_list(facts: DataFrame, key: list[str], *, name: str, label: str, amount: str, seller: str, entity: str, routes: DataFrame, evidence: dict[str, tuple[DataFrame, list[str]]], cells: DataFrame, place: list[str], named: str = "NAME") -> DataFrame:
    """Groups of unresolved facts (by key, which includes name and label) with their candidates, scored and ranked.

    evidence: what a table of (its columns, entity) offers, by equality of these columns; the first named is direct
    evidence of the key. A candidate's score: 1 for each evidence, 1 if its route (routes: entity, route) is the group's
    label, the similarity of the names, and the share of the group's amount at places where it has a cell.
    """
    groups = facts.groupBy(*key).agg(F.sum(amount).alias("key_amount"), F.count("*").alias("n_rows"), F.countDistinct(seller).alias("n_sellers"))
    best = facts.groupBy(*key, seller).agg(F.sum(amount).alias("_a"))
    top = top_k(best, key, [F.desc("_a"), F.col(seller)], 1).select(*key, F.col(seller).alias("top_seller"))
    offers = None
    for what, (df, on) in evidence.items():
        one = groups.select(*key).join(df.select(*on, entity).distinct(), on).select(*key, entity, F.lit(what).alias("ev"))
        offers = one if offers is None else offers.unionByName(one)
    close = near_names(groups, routes, name, entity)
    offers = offers.unionByName(groups.select(*key).join(close, name).select(*key, entity, F.lit(named).alias("ev")))
    flags = [F.max(F.when(F.col("ev") == w, 1).otherwise(0)).alias(f"ev_{w.lower()}") for w in evidence]
    cand = offers.groupBy(*key, entity).agg(*flags)
    here = null_safe_join(facts.select(*key, *place, amount), cand, key, "inner").join(cells.select(*place, entity).distinct(), [*place, entity])
    overlap = here.groupBy(*key, entity).agg(F.sum(amount).alias("place_amount"))
    df = null_safe_join(null_safe_join(groups, top, key), cand, key)
    df = null_safe_join(df, overlap, [*key, entity]).join(routes.select(entity, "route").distinct(), entity, "left")
    is_there = F.col(entity).isNotNull()
    df = df.withColumn("place_amount", F.when(is_there, F.coalesce("place_amount", F.lit(0)).cast("double")))
    df = df.withColumn("ev_label", F.when(is_there, F.when(F.col("route") == F.col(label), 1).otherwise(0)))
    df = df.withColumn("ev_name", F.when(is_there, F.coalesce(similarity(F.trim(name), F.trim(entity)), F.lit(0)) / 100.0))
    share = F.coalesce(F.round(F.try_divide("place_amount", F.col("key_amount").cast("double")), 2), F.lit(0.0))
    score = sum((F.col(f"ev_{w.lower()}") for w in evidence), F.col("ev_label") + F.col("ev_name")) + share
    df = df.withColumn("score", F.round(score, 4))
    in_key = Window.partitionBy(*key)
    order = in_key.orderBy(F.col("score").desc_nulls_last(), F.col("place_amount").desc_nulls_last(), F.col(entity))
    return df.withColumns(
        {"n_candidates": F.count(entity).over(in_key), "rank_in_key": F.row_number().over(order), "rank_key": F.dense_rank().over(Window.partitionBy(label).orderBy(F.desc("key_amount")))}
    ).select(*key, "top_seller", "n_sellers", "n_rows", "key_amount", "rank_key", "n_candidates", "rank_in_key", entity, "route", *(f"ev_{w.lower()}" for w in evidence), "ev_label", "ev_name", "place_amount", "score")


def review_summary(reviewed: DataFrame, flags: list[str], amount: str = "key_amount") -> DataFrame:
    """By the best candidate's evidence, spelt out: groups, amount and its share."""
    text = F.concat_ws(" + ", *(F.when(F.col(f) > 0, F.lit(f.removeprefix("ev_").upper())) for f in flags))
    g = reviewed.where("rank_in_key = 1").withColumn("evidence", F.when(F.col("n_candidates") == 0, "NO CANDIDATE").otherwise(F.coalesce(F.nullif(text, F.lit("")), F.lit("NAME ONLY"))))
    s = g.groupBy("evidence").agg(F.count("*").alias("groups"), F.sum(amount).alias("amount"))
    return s.withColumn("pct", F.round(F.lit(100.0) * F.try_divide(F.col("amount").cast("double"), F.sum("amount").over(Window.partitionBy()).cast("double")), 2))
