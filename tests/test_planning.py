import itertools
import random

import pytest

from parcelry.operators import planning
from parcelry.operators.planning import _lightest

CELLS = "channel string, id int, unit string, district string, mass double"


def line(spark, n):
    return spark.createDataFrame([(i, i + 1) for i in range(n - 1)], "a int, b int")


def test_exchange_components(spark):
    planned = spark.createDataFrame([("u", "A", 0.5), ("u", "B", 0.5), ("v", "B", 1.0), ("w", "C", 0.4), ("w", "D", 0.6), ("x", "A", 0.0), ("x", "D", 1.0)], "unit string, district string, share double")
    assert {r.district: r.component for r in planning.exchange_components(planned).collect()} == {"A": "A", "B": "A", "C": "C", "D": "C"}


def test_swap_moves_toward_tau(spark):
    # places 0..5 on a line in one shared unit; A holds 0..3, B 4..5, all of mass 1, tau 3
    cells = spark.createDataFrame([("c", i, "u", "A" if i < 4 else "B", 1.0) for i in range(6)], CELLS)
    planned = spark.createDataFrame([("c", "u", "A", 0.5), ("c", "u", "B", 0.5)], "channel string, unit string, district string, share double")
    tau = spark.createDataFrame([("c", 3.0)], "channel string, tau double")
    gains = planning.move_gains(cells, line(spark, 6), planned, tau).collect()
    assert [(r.id, r["from"], r["to"], r.gain) for r in gains] == [(3, "A", "B", 1.0)]
    assert [(r.step, r.id, r["from"], r["to"]) for r in planning.swapped(cells, line(spark, 6), planned, tau).collect()] == [(0, 3, "A", "B")]


def test_swap_never_cuts_nor_empties(spark):
    # the move that would balance best, place 2, would cut A
    cells = spark.createDataFrame([("c", 0, "u", "A", 1.0), ("c", 1, "u", "A", 0.1), ("c", 2, "u", "A", 3.0), ("c", 3, "u", "A", 1.0), ("c", 9, "u", "B", 1.0)], CELLS)
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (2, 9)], "a int, b int")
    planned = spark.createDataFrame([("c", "u", "A", 0.5), ("c", "u", "B", 0.5)], "channel string, unit string, district string, share double")
    tau = spark.createDataFrame([("c", 3.05)], "channel string, tau double")
    assert planning.move_gains(cells, edges, planned, tau).count() == 1
    assert planning.swapped(cells, edges, planned, tau).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_swap_ends_where_no_move_is_left(spark, seed):
    rng = random.Random(seed)
    n = 5
    grid = {(x, y): x * n + y for x in range(n) for y in range(n)}
    rows = [("c", i, "u", "A" if x < 3 else "B", round(rng.random(), 2)) for (x, y), i in grid.items()]
    edges = spark.createDataFrame([(grid[x, y], grid[p]) for x, y in grid for p in ((x + 1, y), (x, y + 1)) if p in grid], "a int, b int")
    planned = spark.createDataFrame([("c", "u", "A", 0.5), ("c", "u", "B", 0.5)], "channel string, unit string, district string, share double")
    tau = spark.createDataFrame([("c", sum(r[4] for r in rows) / 2)], "channel string, tau double")
    moves = planning.swapped(spark.createDataFrame(rows, CELLS), edges, planned, tau).orderBy("step").collect()
    owner, worst = {r[1]: r[3] for r in rows}, []
    mass = {r[1]: r[4] for r in rows}
    half = sum(mass.values()) / 2
    for m in moves:
        assert owner[m.id] == m["from"]
        owner[m.id] = m["to"]
        worst.append(max(abs(sum(w for i, w in mass.items() if owner[i] == d) - half) for d in "AB"))
    assert worst == sorted(worst, reverse=True)
    after = spark.createDataFrame([("c", i, "u", owner[i], mass[i]) for i in owner], CELLS)
    assert planning.swapped(after, edges, planned, tau).count() == 0


def test_parts_are_joined_over_empty_places(spark):
    # A owns 0 and 3; 1 and 2 are empty, 1 without owner and 2 of B, which has 2 and 4 (4 next to 5)
    cells = spark.createDataFrame([("c", 0, "u", "A", 2.0), ("c", 1, "u", None, 0.0), ("c", 2, "u", "B", 0.0), ("c", 3, "u", "A", 1.0), ("c", 4, "v", "B", 1.0)], CELLS)
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "a int, b int")
    assert {(r.id, r.district) for r in planning.joined_parts(cells, edges).collect()} == {(1, "A"), (2, "A")}


def test_corridors_as_brute_force(spark):
    rng = random.Random(3)
    n = 7
    mass = {i: float(rng.randint(1, 9)) for i in range(n)}
    pairs = [(a, b) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.45]
    sides = {"l": {0, 1}, "r": {5, 6}}
    best = float("inf")
    for k in range(1, n + 1):
        for way in itertools.permutations(range(n), k):
            if way[0] in sides["l"] and way[-1] in sides["r"] and all((min(p), max(p)) in pairs for p in itertools.pairwise(way)):
                best = min(best, sum(mass[i] for i in way))
    places = spark.createDataFrame([("u", i, w) for i, w in mass.items()] + [("v", 50, 1.0)], "unit string, id int, mass double")
    touch = spark.createDataFrame([("u", s, i) for s, own in sides.items() for i in own] + [("v", "l", 50)], "unit string, side string, id int")
    got = {r.unit: r.corridor for r in planning.corridors(places, spark.createDataFrame(pairs, "a int, b int"), touch).collect()}
    assert got == {"u": best, "v": 0.0}
    assert _lightest({1: 2.0}, {}, {1}, {1}) == 2.0


def test_corridors_of_large_ids(spark):
    # doubles can't tell these ids apart
    n = 2**53
    places = spark.createDataFrame([("u", n + i, float(i + 1)) for i in range(4)], "unit string, id long, mass double")
    edges = spark.createDataFrame([(n + i, n + i + 1) for i in range(3)], "a long, b long")
    touch = spark.createDataFrame([("u", "l", n), ("u", "r", n + 3)], "unit string, side string, id long")
    assert [(r.unit, r.corridor) for r in planning.corridors(places, edges, touch).collect()] == [("u", 10.0)]


def moves_from_scratch(tau, shares, m):
    """The swap pass with every total and offer worked out anew before each move."""
    done = []
    while True:
        totals = {d: m.total(d) for d in set(m.owner.values())}
        left = {}
        for i, d in m.owner.items():
            left[m.unit[i], d] = left.get((m.unit[i], d), 0) + (m.mass[i] > 0)
        offers = []
        for i, d in m.owner.items():
            common = shares.get(m.unit[i], set())
            if d in common and m.mass[i] > 0 and left[m.unit[i], d] > 1:
                for to in {m.owner[y] for y in m.near[i]} & common - {d}:
                    gain = max(abs(totals[d] - tau), abs(totals[to] - tau)) - max(abs(totals[d] - m.mass[i] - tau), abs(totals[to] + m.mass[i] - tau))
                    if gain > planning.GAIN * tau:
                        offers.append((-gain, i, to))
        for _, i, to in sorted(offers):
            d = m.owner[i]
            rest = m.region(d) - {i}
            if m.near[i] & m.parts(m.region(to))[0] and len(m.parts(rest)) <= len(m.parts(rest | {i})):
                m.owner[i] = to
                done.append((i, d, to))
                break
        else:
            return done


def test_swap_as_from_scratch():
    import pandas as pd

    for seed in range(25):
        rng = random.Random(seed)
        n = 6
        cells = pd.DataFrame([{"id": n * r + c, "unit": f"u{c // 2}", "district": rng.choice("ABC"), "mass": rng.choice([0.0, 0.5, 1.0, 1.5, 2.25])} for r in range(n) for c in range(n)])
        edges = pd.DataFrame([{"a": n * r + c, "b": n * r2 + c2} for r in range(n) for c in range(n) for r2, c2 in ((r + 1, c), (r, c + 1)) if r2 < n and c2 < n])
        shares = {f"u{k}": set("ABC") for k in range(3)}
        tau = cells["mass"].sum() / 3
        want = moves_from_scratch(tau, shares, planning._Map(cells, edges))
        assert planning._swap(tau, shares, planning._Map(cells, edges)) == want
        if not seed:
            assert want
