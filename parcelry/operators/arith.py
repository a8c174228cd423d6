"""Integer arithmetic of plans: how many districts fit, how few splits, which allocations and covers exist."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import ceil, floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def forced_splits(mass: Column | str, cap: Column | str) -> Column:
    """ceil(mass / cap) - 1: cuts that no plan can avoid in a unit."""
    m, c = (F.col(x) if isinstance(x, str) else x for x in (mass, cap))
    return F.greatest(F.ceil(m / c - 1e-9) - 1, F.lit(0)).cast("long")


def k_range(mass: float, low: float, high: float) -> tuple[int, int]:
    """Counts k for which k districts in [low, high] can sum to the mass; empty if the first exceeds the second."""
    return ceil(mass / high - 1e-9), floor(mass / low + 1e-9)


def parts_in_window(mass: float, k: int, low: float, high: float) -> bool:
    return k * low - 1e-9 <= mass <= k * high + 1e-9


def allocations(parts: DataFrame, total: int, target: Column, most: int) -> DataFrame:
    """k districts dealt to parts so that the worst deviation of a part's mass per district from the target is least.

    parts: part, mass, in any order. A level for each part: (districts used) -> least worst deviation, joined with the next
    part's choices. Gives part, k. Parts are a plan's few components; levels are frames, states at most total + 1.
    """
    rows = parts.select("part", "mass").withColumn("target", target).orderBy("part").collect()
    spark = parts.sparkSession
    state = spark.createDataFrame([(0, 0.0, [])], "used int, worst double, taken array<int>")
    for r in rows:
        choice = spark.createDataFrame([(k, abs(float(r.mass) / k / float(r.target) - 1)) for k in range(1, most + 1)], "k int, dev double")
        nxt = state.crossJoin(F.broadcast(choice)).where(F.col("used") + F.col("k") <= total)
        nxt = nxt.select((F.col("used") + F.col("k")).alias("used"), F.greatest("worst", "dev").alias("worst"), F.array_append("taken", F.col("k")).alias("taken"))
        state = nxt.groupBy("used").agg(F.min(F.struct("worst", "taken")).alias("s")).select("used", "s.*")
    best = state.where(F.col("used") == total)
    names = F.array(*(F.lit(r.part) for r in rows)) if rows else F.array()
    return best.select(F.explode(F.arrays_zip(names.alias("part"), F.col("taken").alias("k"))).alias("p"), "worst").select("p.part", "p.k", "worst")


def sumset(choices: list[set[int]]) -> set[int]:
    """All sums of one choice from each set."""
    out = {0}
    for c in choices:
        out = {a + b for a in out for b in c}
    return out


def set_partitions(items: list) -> Iterator[list[list]]:
    """Every partition of the items into non-empty blocks."""
    if not items:
        yield []
        return
    head, rest = items[0], items[1:]
    for p in set_partitions(rest):
        yield [[head], *p]
        for i, block in enumerate(p):
            yield [*p[:i], [head, *block], *p[i + 1 :]]


def connected(block: Iterable, near: dict) -> bool:
    left = set(block)
    todo = [left.pop()] if left else []
    while todo:
        v = todo.pop()
        for w in near.get(v, ()):
            if w in left:
                left.remove(w)
                todo.append(w)
    return not left


def coarsenings(items: list, near: dict) -> Iterator[list[list]]:
    """Partitions whose blocks are all connected."""
    return (p for p in set_partitions(items) if all(connected(b, near) for b in p))


def covers(universe: frozenset, sets: dict[object, frozenset], count: int | None = None) -> Iterator[list]:
    """Exact covers of a small universe, the scarcest element first; dead ends are remembered."""
    order = sorted(universe, key=repr)
    bit = {e: 1 << i for i, e in enumerate(order)}
    masks = {name: sum(bit[e] for e in s) for name, s in sets.items() if s and s <= universe}
    holds = {b: sorted((n for n, m in masks.items() if m & b), key=repr) for b in bit.values()}
    dead: set[tuple[int, int]] = set()

    def go(left: int, used: int) -> Iterator[list]:
        if not left:
            if count is None or used == count:
                yield []
            return
        if (left, used) in dead or count is not None and used >= count:
            return
        b = min((b for b in holds if b & left), key=lambda b: sum(masks[n] & ~left == 0 for n in holds[b]))
        any_ = False
        for n in holds[b]:
            if masks[n] & ~left == 0:
                for rest in go(left & ~masks[n], used + 1):
                    any_ = True
                    yield [n, *rest]
        if not any_:
            dead.add((left, used))

    return go(sum(bit.values()), 0)


def conflict_core(universe: frozenset, sets: dict[object, frozenset]) -> frozenset:
    """A minimal part of the universe that can't be covered exactly by sets cut to it; empty if all can."""
    possible = lambda u: next(covers(u, {n: s & u for n, s in sets.items()}), None) is not None
    core = set(universe)
    if possible(frozenset(core)):
        return frozenset()
    for e in sorted(universe, key=repr):
        if not possible(frozenset(core - {e})):
            core.remove(e)
    return frozenset(core)


def region_table(units: DataFrame, by: list[str], low: float, high: float, cap: float) -> DataFrame:
    """By region: mass, the counts of districts that fit the window, and the splits that are forced."""
    g = units.groupBy(*by).agg(F.sum("mass").alias("mass"), F.sum(forced_splits("mass", F.lit(cap))).alias("forced_splits"), F.count("*").alias("units"))
    return g.withColumns({"k_low": F.ceil(F.col("mass") / high - 1e-9).cast("long"), "k_high": F.floor(F.col("mass") / low + 1e-9).cast("long")}).withColumn("fits", F.col("k_low") <= F.col("k_high"))


def grid(spark, axes: dict[str, list]) -> DataFrame:
    """All combinations of the axes' values, each with an id from its content (the first 16 hex digits of its SHA-256)."""
    out = None
    for name, values in axes.items():
        one = spark.createDataFrame([(str(v),) for v in values], f"{name} string")
        out = one if out is None else out.crossJoin(F.broadcast(one))
    return out.withColumn("run_id", run_id(sorted(axes)))


def run_id(columns: list[str]) -> Column:
    """Hex digits of the SHA-256 of 'a=1;b=2' over the columns in the given order."""
    text = F.concat_ws(";", *(F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns))
    return F.substring(F.sha2(text, 256), 1, 16)


def conforms(units: DataFrame, tau: Column, margin: float) -> DataFrame:
    """Units with the margin that rounding leaves them: how much of tau lies between their mass and the nearest whole count."""
    whole = F.greatest(F.round(F.col("mass") / tau), F.lit(1.0))
    return units.withColumn("margin", F.abs(F.col("mass") / tau - whole)).withColumn("conforms", F.col("margin") <= margin)


def nth_total(df: DataFrame, by: list[str], order: list, value: str, name: str) -> DataFrame:
    """Running totals in an order: what the first n hold together."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(value).over(w))
