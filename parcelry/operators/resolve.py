"""Which entity a fact belongs to: routes of entities, and cascades that resolve facts where the answer is unique."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelry.operators.rules import strict_maximum, unique_lookup


def entity_route(entities: DataFrame, labelled: DataFrame, owner: DataFrame, fallback: DataFrame, entity: list[str], label: str = "label") -> DataFrame:
    """entities (by the keys `entity`, the first of them the id) with a route and the basis it rests on.

    An owner's override comes first; then the one label that labelled rows of the entity have, then the one of all rows of
    its id; then the fallback table by id; else UNMAPPED. Several labels at a level skip it.
    """
    key, ident = entity, entity[:1]
    at_entity = unique_lookup(labelled.where(F.col(label).isNotNull()), key, label, "_at", "_k_at")
    at_id = unique_lookup(labelled.where(F.col(label).isNotNull()), ident, label, "_id", "_k_id")
    own = owner.groupBy(*key).agg(F.min(label).alias("_own"))
    rest = fallback.groupBy(*ident).agg(F.min(label).alias("_rest"))
    df = entities.join(own, key, "left").join(at_entity, key, "left").join(at_id, ident, "left").join(rest, ident, "left")
    route = F.coalesce("_own", "_at", "_id", "_rest", F.lit("UNMAPPED"))
    basis = (
        F.when(F.col("_own").isNotNull(), "OWNER")
        .when(F.col("_at").isNotNull(), F.concat(F.lit("ENTITY, ONE LABEL"), F.when(F.col("_k_id") > 1, F.lit(" OF SEVERAL AT ID")).otherwise(F.lit(""))))
        .when(F.col("_id").isNotNull(), "ID, ONE LABEL")
        .when(F.col("_rest").isNotNull(), "FALLBACK")
        .otherwise("UNMAPPED")
    )
    return df.select(*entities.columns, F.coalesce("_k_at", F.lit(0)).cast("long").alias("labels"), route.alias("route"), basis.alias("route_basis"))


def relabel(entities: DataFrame, listed: DataFrame, key: list[str], label: str, route: str = "route", missing: str = "UNMAPPED") -> DataFrame:
    """entities with a new label: a listed entity's one label; with none or several listed, its route."""
    one = unique_lookup(listed, key, label, "_listed", "listed_labels")
    return entities.join(one, key, "left").withColumn("listed_labels", F.coalesce("listed_labels", F.lit(0)).cast("long")).withColumn("new_label", F.coalesce("_listed", F.nullif(F.col(route), F.lit(missing)))).drop("_listed")


def resolve_facts(facts: DataFrame, candidates: DataFrame, cells: DataFrame, *, key: str, entity: str, label: str, place: list[str], code: str | None, fact: list[str]) -> DataFrame:
    """facts with the entity each reaches, where that is unique, and the rule that found it.

    facts: key (of candidates), label, place and code columns, identified by the columns `fact`. candidates: key, entity,
    route. cells: place, entity, weight. In order: the key's one entity; the one whose route is the fact's label; among
    those, the one with a cell at the fact's place; the one that all such facts of the key's code agree on; the one of
    strictly most weight at the place. What is left stays unresolved, with the reason.

    Every step is an aggregate by the fact's own columns, joined back null-safe: no row numbers over the whole table.
    """
    from parcelry.operators.rules import null_safe_join

    per_key = candidates.groupBy(key).agg(F.count("*").alias("n_all"), F.min(entity).alias("e_all"))
    f = facts.select(*fact).distinct()
    hit = f.join(candidates, key).where(F.col(label) == F.col("route"))
    by_label = hit.groupBy(key, label).agg(F.countDistinct(entity).alias("n_label"), F.min(entity).alias("e_label"))
    here = hit.join(cells, [*place, entity])
    by_place = here.groupBy(*fact).agg(F.countDistinct(entity).alias("n_place"), F.min(entity).alias("e_place"))
    top = strict_maximum(here.select(*fact, entity, "weight"), fact, "weight", [entity]).select(*fact, F.col(entity).alias("e_top"))
    df = null_safe_join(f, per_key, [key])
    df = null_safe_join(df, by_label, [key, label])
    df = null_safe_join(df, by_place, fact)
    df = null_safe_join(df, top, fact)
    split = F.col("n_label") > 1
    if code:
        sure = df.where(split & (F.col("n_place") == 1) & F.col(code).isNotNull())
        agreed = sure.groupBy(key, code, label).agg(F.countDistinct("e_place").alias("n_code"), F.min("e_place").alias("e_code"))
        df = null_safe_join(df, agreed, [key, code, label])
    else:
        df = df.withColumns({"n_code": F.lit(None).cast("long"), "e_code": F.lit(None).cast(dict(candidates.dtypes)[entity])})
    steps = [
        (F.col("n_all") == 1, "ONE ENTITY", "e_all"),
        (F.col("n_label") == 1, "MATCHED BY LABEL", "e_label"),
        (split & (F.col("n_place") == 1), "MATCHED BY PLACE", "e_place"),
        (split & (F.col("n_code") == 1), "MATCHED BY CODE", "e_code"),
        (split & F.col("e_top").isNotNull(), "MOST WEIGHT AT PLACE", "e_top"),
    ]
    basis = F.when(F.col(key).isNull(), "NO KEY").when(F.col("n_all").isNull(), "NO ENTITY")
    found = F.when(F.lit(False), F.col("e_all"))
    for when, name, value in steps:
        basis, found = basis.when(when, name), found.when(when, F.col(value))
    basis = basis.when(split, "SEVERAL MATCH").otherwise("NONE MATCHES")
    return null_safe_join(facts, df.select(*fact, basis.alias("basis"), found.alias("resolved")), fact)


def assign(facts: DataFrame, codes: DataFrame, key: str, code: str, entity: str) -> DataFrame:
    """Manual assignment over what was resolved: the table's exact code, then its NULL code (any), then `resolved`."""
    exact = codes.where(F.col(code).isNotNull()).groupBy(key, code).agg(F.min(entity).alias("_exact"))
    any_ = codes.where(F.col(code).isNull()).groupBy(key).agg(F.min(entity).alias("_any"))
    return facts.join(exact, [key, code], "left").join(any_, key, "left").withColumn("assigned", F.coalesce("_exact", "_any", "resolved")).drop("_exact", "_any")
