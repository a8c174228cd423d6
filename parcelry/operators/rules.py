"""Rule and override tables: joins that a nested loop would do, expressed as equi-joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rule_table(spark, rows: list[tuple], schema: str) -> DataFrame:
    """An inline constant table; a first column of '' marks a placeholder row and is left out."""
    df = spark.createDataFrame(rows, schema)
    first = df.columns[0]
    return df.where(F.col(first).isNull() | (F.col(first).cast("string") != ""))


def null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """An equi-join in which NULL equals NULL; the right side's keys go."""
    named = right.select(*(F.col(k).alias(f"_r_{k}") if k in keys else F.col(k) for k in right.columns))
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    out = left.join(named, on, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*(f"_r_{k}" for k in keys))


def tied_rules(rules: DataFrame, priority: str, outputs: list[str], by: list[str]) -> DataFrame:
    """Rules that could both be first with different outputs: a table that holds any has no defined result."""
    return rules.groupBy(priority, *by).agg(F.countDistinct(F.struct(*outputs)).alias("outputs")).where("outputs > 1")


def priority_join(rows: DataFrame, rules: DataFrame, on: dict[str, str], priority: str, outputs: list[str]) -> DataFrame:
    """rows with the outputs of the rule of lowest priority any of whose columns equals the row's (on: row column -> rule column).

    A disjunctive join is a nested loop in Spark. Here each rule column is one equi-join over the distinct values of one
    row column, the best rule per value is kept, and the bests are combined by priority. A table in which two rules of one
    priority want the same value and differ in their outputs has no defined result and raises; rules of one priority that
    meet in a row by different columns go by the smallest outputs.
    """
    from parcelry.operators.checks import require

    for theirs in on.values():
        require(tied_rules(rules.where(F.col(theirs).isNotNull()), priority, outputs, [theirs]).select(priority, theirs), "tied rules")
    best = F.struct(F.col(priority), *(F.col(c) for c in outputs))
    out, found = rows, []
    for i, (own, theirs) in enumerate(on.items()):
        one = rules.where(F.col(theirs).isNotNull()).groupBy(F.col(theirs).alias(f"_k{i}")).agg(F.min(best).alias(f"_b{i}"))
        out = out.join(one, out[own] == F.col(f"_k{i}"), "left")
        found.append(f"_b{i}")
    chosen = F.array_min(F.array_compact(F.array(*found)))
    out = out.withColumn("_best", chosen).select(*rows.columns, *(F.col(f"_best.{c}").alias(c) for c in outputs))
    return out


def override_join(rows: DataFrame, overrides: DataFrame, exact: list[str], wild: str, value: str, name: str = "override") -> DataFrame:
    """rows with the value of the override for their exact keys, else of the one whose `wild` key is NULL (any)."""
    general = [k for k in exact if k != wild]
    one = overrides.where(F.col(wild).isNotNull()).groupBy(*exact).agg(F.min(value).alias("_exact"))
    any_ = overrides.where(F.col(wild).isNull()).groupBy(*general).agg(F.min(value).alias("_any"))
    return rows.join(one, exact, "left").join(any_, general, "left").withColumn(name, F.coalesce("_exact", "_any")).drop("_exact", "_any")


def unique_lookup(df: DataFrame, keys: list[str], value: str, name: str | None = None, count: str = "k") -> DataFrame:
    """keys, how many distinct values they have, and the value where it is the only one: a lookup that can't fan out."""
    counted = df.groupBy(*keys).agg(F.countDistinct(value).cast("long").alias(count), F.min(value).alias("_v"))
    return counted.select(*keys, count, F.when(F.col(count) == 1, F.col("_v")).alias(name or value))


def strict_maximum(df: DataFrame, keys: list[str], by: str, ties: list[str]) -> DataFrame:
    """The row of each group that exceeds all others. A tie at the top has none, and neither has a single row: nothing is exceeded."""
    w = Window.partitionBy(*keys).orderBy(F.desc(by), *ties)
    return df.withColumn("_n", F.row_number().over(w)).withColumn("_next", F.lead(by).over(w)).where((F.col("_n") == 1) & (F.col(by) > F.col("_next"))).drop("_n", "_next")


def top_k(df: DataFrame, keys: list[str], order: list, k: int, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def pattern_join(rows: DataFrame, patterns: DataFrame, equal: list[str], text: str, pattern: str, how: str = "left") -> DataFrame:
    """rows with the patterns (ILIKE) that fit their text, among those that agree on the equal columns: the equality is the join's key."""
    right = patterns.select(*(F.col(c).alias(f"_p_{c}") if c in equal else F.col(c) for c in patterns.columns))
    on = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_p_{c}") for c in equal]) & F.expr(f"{text} ILIKE {pattern}")
    return rows.join(right, on, how).drop(*(f"_p_{c}" for c in equal))


def listed_keys(df: DataFrame, key: str, values: list[str], sep: str = "|") -> DataFrame:
    """(key, values) pairs from keys that may be lists: a key that any row carries alone uses only such rows, else the lists it is in."""
    parts = df.select(F.col(key).alias("_raw"), *values, F.explode(F.split(F.col(key), F.lit(f"\\{sep}"))).alias(key)).withColumn(key, F.nullif(F.trim(key), F.lit("")))
    parts = parts.where(F.col(key).isNotNull())
    single = ~F.col("_raw").contains(sep)
    alone = parts.where(single).select(key).distinct()
    return parts.where(single).unionByName(parts.where(~single).join(alone, key, "left_anti")).select(key, *values).distinct()


def positional_join(left: DataFrame, right: DataFrame, keys: list[str], left_order: list, right_order: list, prefixes: tuple[str, str]) -> DataFrame:
    """The k-th left row of a key beside its k-th right row; the shorter side is NULL from its end on."""
    a, b = prefixes

    def ranked(df: DataFrame, order: list, prefix: str) -> DataFrame:
        n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        return df.withColumn("r", n).select(*keys, "r", *(F.col(c).alias(f"{prefix}{c}") for c in df.columns if c not in keys))

    return ranked(left, left_order, a).join(ranked(right, right_order, b), [*keys, "r"], "full")


def match_counts(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """left's rows with hits (how many right rows agree) and outcome: NO VALUE, 0, 1 or 2+."""
    hits = right.groupBy(*keys).agg(F.count("*").alias("hits"))
    no_value = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    n = F.coalesce("hits", F.lit(0)).cast("long")
    return left.join(hits, keys, "left").withColumn("hits", n).withColumn("outcome", F.when(no_value, "NO VALUE").when(n == 0, "0").when(n == 1, "1").otherwise("2+"))


def in_or(df: DataFrame, keys: DataFrame, predicate: Column) -> DataFrame:
    """Rows whose key is among keys (columns of df), or that meet the predicate: one join that marks, one filter."""
    known = keys.distinct().withColumn("_in", F.lit(True))
    return df.join(known, keys.columns, "left").where(F.col("_in").isNotNull() | F.coalesce(predicate, F.lit(False))).select(*df.columns)
