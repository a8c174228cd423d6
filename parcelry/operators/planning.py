"""What surrounds a planning solver: exchange components, moves between districts, territory of empty cells, corridors.

A channel's map is one planning problem of bounded size (tens of thousands of places), and its passes move one place at a
time, each on the state that the last has left. Such passes run as grouped maps, one channel to a task; channels and
scenarios run side by side. What can be said as joins (scores of candidate moves, components, borders) is.
"""

from __future__ import annotations

from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelry.operators.graph import both_ways, components

GAIN = 1e-9


def exchange_components(planned: DataFrame) -> DataFrame:
    """planned: unit, district, share. Districts that shared units link, directly or not: district, component (its smallest)."""
    own = planned.where("share > 0").select("unit", "district").distinct()
    first = own.groupBy("unit").agg(F.min("district").alias("b"))
    edges = own.join(first, "unit").select(F.col("district").alias("a"), "b")
    return components(planned.select(F.col("district").alias("id")).distinct(), edges).select(F.col("id").alias("district"), "component")


def move_gains(cells: DataFrame, edges: DataFrame, planned: DataFrame, tau: DataFrame) -> DataFrame:
    """Moves of one place to a neighbouring district of its shared unit, and by how much the worse of the two improves.

    cells: channel, id, unit, district, mass. edges: a, b. planned: channel, unit, district, share. tau: channel, tau. A
    district keeps a place of positive mass in each unit that it is planned in.
    """
    by = ["channel", "district"]
    total = cells.groupBy(*by).agg(F.sum("mass").alias("total"))
    share = planned.where("share > 0").select("channel", "unit", "district").distinct()
    left = F.sum(F.when(F.col("mass") > 0, 1).otherwise(0)).over(Window.partitionBy("channel", "unit", "district"))
    own = cells.withColumn("_left", left).where("mass > 0 AND _left > 1").join(share, ["channel", "unit", "district"], "left_semi")
    near = cells.select("channel", F.col("id").alias("b"), F.col("district").alias("to"))
    moves = own.join(both_ways(edges).withColumnRenamed("a", "id"), "id").join(near, ["channel", "b"]).where("district <> to")
    moves = moves.join(share.withColumnRenamed("district", "to"), ["channel", "unit", "to"], "left_semi").select("channel", "id", "unit", "district", "to", "mass").distinct()
    moves = moves.join(total, by).join(total.toDF("channel", "to", "to_total"), ["channel", "to"]).join(tau, "channel")
    t = F.col("tau")
    before = F.greatest(F.abs(F.col("total") - t), F.abs(F.col("to_total") - t))
    after = F.greatest(F.abs(F.col("total") - F.col("mass") - t), F.abs(F.col("to_total") + F.col("mass") - t))
    return moves.withColumn("gain", before - after).where(F.col("gain") > GAIN * t).select("channel", "id", "unit", F.col("district").alias("from"), "to", "mass", "gain")


class _Map:
    """One channel's map: who owns what, kept up to date move by move."""

    def __init__(self, cells: pd.DataFrame, edges: pd.DataFrame):
        self.mass = dict(zip(cells["id"].tolist(), cells["mass"].tolist(), strict=True))
        self.unit = dict(zip(cells["id"].tolist(), cells["unit"].tolist(), strict=True))
        self.owner = {i: d for i, d in zip(cells["id"].tolist(), cells["district"].tolist(), strict=True) if d is not None and d == d}
        self.near: dict = {i: set() for i in self.mass}
        for a, b in zip(edges["a"].tolist(), edges["b"].tolist(), strict=True):
            if a in self.near and b in self.near and a != b:
                self.near[a].add(b)
                self.near[b].add(a)

    def region(self, district) -> set:
        return {i for i, d in self.owner.items() if d == district}

    def parts(self, places: set) -> list[set]:
        """Connected parts: the heaviest first, of equal ones that of the smallest place."""
        left, out = set(places), []
        while left:
            part, todo = set(), [left.pop()]
            while todo:
                v = todo.pop()
                part.add(v)
                fresh = self.near[v] & left
                left -= fresh
                todo.extend(fresh)
            out.append(part)
        return sorted(out, key=lambda p: (-round(sum(sorted(self.mass[i] for i in p)), 9), min(p)))

    def total_of(self, places: set) -> float:
        return sum(sorted(self.mass[i] for i in places))

    def total(self, district) -> float:
        return self.total_of(self.region(district))


class _Moves:
    """A map's admissible-looking moves by gain. After a move only what hangs on the two districts touched is worked out again."""

    def __init__(self, tau: float, shares: dict, m: _Map):
        self.tau, self.shares, self.m = tau, shares, m
        self.regions: dict = {}
        for i, d in m.owner.items():
            self.regions.setdefault(d, set()).add(i)
        self.totals = {d: m.total_of(r) for d, r in self.regions.items()}
        self.left: dict = {}
        for i, d in m.owner.items():
            self.count(i, d, 1)
        self.targets: dict = {}
        self.toward: dict = {}
        self.stamp: dict = {}
        self.heap: list = []
        for i in m.owner:
            self.look(i)
        for i in list(self.targets):
            self.rate(i)

    def count(self, i, d, by: int) -> None:
        if self.m.mass[i] > 0:
            key = self.m.unit[i], d
            self.left[key] = self.left.get(key, 0) + by

    def look(self, i) -> None:
        """The districts that place i might go to."""
        for to in self.targets.pop(i, ()):
            self.toward[to].discard(i)
        d, common = self.m.owner[i], self.shares.get(self.m.unit[i], ())
        if d in common and self.m.mass[i] > 0:
            found = {self.m.owner.get(y) for y in self.m.near[i]} & common - {d}
            if found:
                self.targets[i] = found
                for to in found:
                    self.toward.setdefault(to, set()).add(i)

    def rate(self, i) -> None:
        """Offers of place i at the totals of now; older ones no longer count."""
        self.stamp[i] = self.stamp.get(i, 0) + 1
        d, mass = self.m.owner[i], self.m.mass[i]
        if self.left.get((self.m.unit[i], d), 0) < 2:
            return
        for to in self.targets.get(i, ()):
            own, other = self.totals[d], self.totals[to]
            gain = max(abs(own - self.tau), abs(other - self.tau)) - max(abs(own - mass - self.tau), abs(other + mass - self.tau))
            if gain > GAIN * self.tau:
                heappush(self.heap, (-gain, i, to, self.stamp[i]))

    def next(self) -> tuple | None:
        """The best offer that is admissible: neither side may fall into more parts. Offers that aren't come back after the next move."""
        m, kept = self.m, []
        found = None
        while self.heap and found is None:
            offer = heappop(self.heap)
            _, i, to, stamp = offer
            if stamp != self.stamp[i]:
                continue
            rest = self.regions[m.owner[i]] - {i}
            if m.near[i] & m.parts(self.regions[to])[0] and len(m.parts(rest)) <= len(m.parts(rest | {i})):
                found = i, to
            else:
                kept.append(offer)
        for offer in kept:
            heappush(self.heap, offer)
        return found

    def move(self, i, to) -> None:
        m, d = self.m, self.m.owner[i]
        self.count(i, d, -1)
        self.count(i, to, 1)
        m.owner[i] = to
        self.regions[d].discard(i)
        self.regions[to].add(i)
        for x in (d, to):
            self.totals[x] = m.total_of(self.regions[x])
        for x in {i} | {y for y in m.near[i] if y in m.owner}:
            self.look(x)
            self.stamp[x] = self.stamp.get(x, 0) + 1
        touched = self.regions[d] | self.regions[to] | self.toward.get(d, set()) | self.toward.get(to, set()) | {i} | {y for y in m.near[i] if y in m.owner}
        for x in touched:
            if x in self.targets:
                self.rate(x)


def _swap(tau: float, shares: dict, m: _Map) -> list[tuple]:
    """The best admissible move again and again: the largest gain, ties by place and target."""
    done, moves = [], _Moves(tau, shares, m)
    while (best := moves.next()) is not None:
        i, to = best
        done.append((i, m.owner[i], to))
        moves.move(i, to)
    return done


def swapped(cells: DataFrame, edges: DataFrame, planned: DataFrame, tau: DataFrame) -> DataFrame:
    """The moves of the swap pass, in order: channel, step, id, from, to. Inputs as in move_gains."""
    kind = dict(cells.dtypes)
    shares = planned.where("share > 0").groupBy("channel", "unit").agg(F.collect_set("district").alias("shared"))
    rows = cells.join(tau, "channel").join(shares, ["channel", "unit"], "left").select("channel", "id", "unit", "district", "mass", "tau", "shared")
    own = edges.select("a", "b").join(cells.select(F.col("channel").alias("of"), F.col("id").alias("a")).distinct(), "a")

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty:
            return pd.DataFrame({c: [] for c in ("channel", "step", "id", "from", "to")})
        common = {u: set(s) for u, s in zip(left["unit"].tolist(), left["shared"].tolist(), strict=True) if s is not None and len(s) > 1}
        moves = _swap(float(left["tau"].iloc[0]), common, _Map(left, right))
        return pd.DataFrame([(key[0], n, *x) for n, x in enumerate(moves)], columns=["channel", "step", "id", "from", "to"])

    return rows.groupBy("channel").cogroup(own.groupBy("of")).applyInPandas(run, f"channel {kind['channel']}, step int, id {kind['id']}, from {kind['district']}, to {kind['district']}")


def _join_parts(m: _Map) -> list[tuple]:
    """Parts joined to their district over empty places: the fewest places, nearest first; no donor is emptied or cut, and the parts of all get fewer."""
    done, again = [], True
    empty = {i for i, w in m.mass.items() if w <= 0}
    while again:
        again = False
        for d in sorted(set(m.owner.values())):
            units = {m.unit[i] for i in m.region(d) if m.mass[i] > 0}
            for part in m.parts(m.region(d))[1:]:
                way = _way(m, part, d, {i for i in empty if m.unit[i] in units})
                if not way:
                    continue
                touched = {d} | {m.owner[i] for i in way if i in m.owner}
                before = {x: m.parts(m.region(x)) for x in touched}
                was = {i: m.owner.get(i) for i in way}
                m.owner.update(dict.fromkeys(way, d))
                after = {x: m.parts(m.region(x)) for x in touched}
                cut = any(not after[x] or len(after[x]) > len(before[x]) for x in touched - {d})
                if cut or sum(map(len, after.values())) >= sum(map(len, before.values())):
                    for i, x in was.items():
                        m.owner.pop(i) if x is None else m.owner.update({i: x})
                    continue
                done += [(i, d) for i in sorted(way)]
                again = True
    return done


def _way(m: _Map, part: set, district, allowed: set) -> list:
    """A shortest path of allowed places from the part to another place of its district."""
    came, queue = dict.fromkeys(part), sorted(part)
    for z in queue:
        for y in sorted(m.near[z]):
            if y in came:
                continue
            if m.owner.get(y) == district:
                way = []
                while z not in part:
                    way.append(z)
                    z = came[z]
                return way
            if y in allowed:
                came[y] = z
                queue.append(y)
    return []


def joined_parts(cells: DataFrame, edges: DataFrame) -> DataFrame:
    """Empty places claimed to join a district's parts: channel, id, district."""
    kind = dict(cells.dtypes)
    own = edges.select("a", "b").join(cells.select(F.col("channel").alias("of"), F.col("id").alias("a")).distinct(), "a")

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = _join_parts(_Map(left, right)) if len(left) else []
        return pd.DataFrame([(key[0], *x) for x in found], columns=["channel", "id", "district"])

    return cells.select("channel", "id", "unit", "district", "mass").groupBy("channel").cogroup(own.groupBy("of")).applyInPandas(run, f"channel {kind['channel']}, id {kind['id']}, district {kind['district']}")


def _lightest(weights: dict, near: dict, sources: set, targets: set) -> float:
    """Least sum of weights over a path's places, both ends in it; infinite if there is none."""
    best = {z: weights[z] for z in sources}
    heap = [(w, z) for z, w in best.items()]
    heapify(heap)
    while heap:
        w, z = heappop(heap)
        if z in targets:
            return w
        if w > best[z]:
            continue
        for y in near.get(z, ()):
            if (v := w + weights[y]) < best.get(y, float("inf")):
                best[y] = v
                heappush(heap, (v, y))
    return float("inf")


def corridors(places: DataFrame, edges: DataFrame, sides: DataFrame) -> DataFrame:
    """Units that a support must cross: the least mass that a path through the unit takes from any side to the others.

    places: unit, id, mass. sides: unit, side, id, the places of the unit that touch each side. Gives unit, corridor.
    """
    kind = dict(places.dtypes)["unit"]
    inner = edges.join(places.select(F.col("id").alias("a"), "unit"), "a").join(places.select(F.col("id").alias("b"), F.col("unit").alias("_u")), "b").where("unit = _u").select("unit", "a", "b")
    rows = (  # other is never null: pandas would make doubles of whole numbers, and of large ones others
        places.select("unit", F.lit("place").alias("kind"), "id", "mass", F.lit(None).cast("string").alias("side"), F.col("id").alias("other"))
        .unionByName(sides.select("unit", F.lit("side").alias("kind"), "id", F.lit(None).cast("double").alias("mass"), F.col("side").cast("string"), F.col("id").alias("other")))
        .unionByName(inner.select("unit", F.lit("edge").alias("kind"), F.col("a").alias("id"), F.lit(None).cast("double").alias("mass"), F.lit(None).cast("string").alias("side"), F.col("b").alias("other")))
    )

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        cells, links, touch = (g[g["kind"] == k] for k in ("place", "edge", "side"))
        weights = dict(zip(cells["id"].tolist(), cells["mass"].tolist(), strict=True))
        near: dict = {}
        for a, b in zip(links["id"].tolist(), links["other"].tolist(), strict=True):
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        at = {s: set(x["id"].tolist()) for s, x in touch.groupby("side")}
        worst = max((_lightest(weights, near, own, set().union(*(o for t, o in at.items() if t != s))) for s, own in at.items()), default=0.0) if len(at) > 1 else 0.0
        return pd.DataFrame({"unit": [key[0]], "corridor": [worst]})

    return rows.groupBy("unit").applyInPandas(run, f"unit {kind}, corridor double")


def margins(supports: DataFrame, places: DataFrame) -> DataFrame:
    """By support: the sum over its units of their heaviest place, which is what rounding may move."""
    top = places.groupBy("unit").agg(F.max("mass").alias("top"))
    return supports.join(top, "unit").groupBy("support").agg(F.sum("top").alias("margin"))


def diameters(supports: DataFrame, centres: DataFrame) -> DataFrame:
    """By support: the largest distance of two of its units' centres. A support has few units."""
    at = supports.join(centres, "unit").select("support", "x", "y")
    d = F.sqrt(F.pow(F.col("x") - F.col("x2"), F.lit(2)) + F.pow(F.col("y") - F.col("y2"), F.lit(2)))
    return at.join(at.toDF("support", "x2", "y2"), "support").groupBy("support").agg(F.max(d).alias("diameter"))
