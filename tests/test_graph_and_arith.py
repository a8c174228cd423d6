import itertools
import random

import pytest
from pyspark.sql import functions as F

from parcelry.operators import arith, graph, score


def graph_of(spark, n, edges, groups=None):
    v = spark.createDataFrame([(i, (groups or {}).get(i, 0)) for i in range(n)], "id int, g int")
    e = spark.createDataFrame(edges, "a int, b int")
    return v, e


def pieces(nodes, edges):
    left, out = set(nodes), 0
    while left:
        out += 1
        todo = [left.pop()]
        while todo:
            v = todo.pop()
            for a, b in edges:
                for x, y in ((a, b), (b, a)):
                    if x == v and y in left:
                        left.remove(y)
                        todo.append(y)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_articulation_as_brute_force(spark, seed):
    rng = random.Random(seed)
    edges = [(a, b) for a, b in itertools.combinations(range(14), 2) if rng.random() < 0.16]
    groups = {i: i % 2 for i in range(14)}
    inner = [(a, b) for a, b in edges if groups[a] == groups[b]]
    v, e = graph_of(spark, 14, edges, groups)
    want = set()
    for x in range(14):
        own = [i for i in range(14) if groups[i] == groups[x]]
        near = [(a, b) for a, b in inner if groups[a] == groups[x]]
        if pieces([i for i in own if i != x], [(a, b) for a, b in near if x not in (a, b)]) > pieces(own, near) - (not any(x in p for p in near)):
            want.add(x)
    assert {r.id for r in graph.articulation(v, e, "g").collect()} == want


def test_components_ignore_vertices_that_are_not_there(spark):
    v, e = graph_of(spark, 5, [(0, 1), (3, 9), (9, 4), (2, 2)])
    assert {r.id: r.component for r in graph.components(v, e).collect()} == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_growth_as_a_queue(spark, seed):
    rng = random.Random(seed)
    edges = [(a, b) for a, b in itertools.combinations(range(18), 2) if rng.random() < 0.14]
    owner = {i: rng.randint(1, 3) for i in rng.sample(range(18), 4)}
    v, e = graph_of(spark, 18, edges)
    got = {r.id: r.owner for r in graph.frontier(v, e, spark.createDataFrame(list(owner.items()), "id int, owner int")).collect()}
    queue = sorted(owner)
    for z in queue:
        for y in sorted({x for p in edges if z in p for x in p} - {z}):
            if y not in owner:
                owner[y] = owner[z]
                queue.append(y)
    assert got == owner


def test_subsets_with_a_cap(spark):
    v, e = graph_of(spark, 4, [(0, 1), (1, 2), (2, 3)])
    apart = spark.createDataFrame([(0, 2)], "a int, b int")
    got = {tuple(r.members) for r in graph.connected_subsets(v, e, 3, apart).collect()}
    assert got == {(0,), (1,), (2,), (3,), (0, 1), (1, 2), (2, 3), (1, 2, 3)}


def test_hull_and_extent(spark):
    rng = random.Random(3)
    pts = [(0, rng.gauss(0, 1), rng.gauss(0, 1)) for _ in range(300)] + [(1, 1.0, 1.0), (2, 0.0, 0.0), (2, 3.0, 4.0)]
    df = spark.createDataFrame(pts, "g int, x double, y double")
    want = {g: max(((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2) ** 0.5 for a in pts for b in pts if a[0] == b[0] == g) for g in (0, 1, 2)}
    assert {r.g: r.extent for r in score.extents(df, ["g"], "x", "y").collect()} == pytest.approx(want)


def test_k_means_recovers_centres(spark):
    rng = random.Random(5)
    pts = [(i, 10.0 * (i % 3) + rng.gauss(0, 0.3), rng.gauss(0, 0.3), 1.0) for i in range(300)]
    got = sorted(r.x for r in graph.k_means(spark.createDataFrame(pts, "id int, x double, y double, w double"), 3, "w").collect())
    assert got == pytest.approx([0, 10, 20], abs=0.2)


def test_partitions_and_coarsenings():
    assert [sum(1 for _ in arith.set_partitions(list(range(n)))) for n in range(6)] == [1, 1, 2, 5, 15, 52]
    path = {0: [1], 1: [0, 2], 2: [1]}
    assert sum(1 for _ in arith.coarsenings([0, 1, 2], path)) == 4


def test_covers_and_cores():
    sets = {"a": frozenset("12"), "b": frozenset("3"), "c": frozenset("23"), "d": frozenset("1")}
    got = sorted(sorted(c) for c in arith.covers(frozenset("123"), sets))
    assert got == [["a", "b"], ["c", "d"]]
    assert [sorted(c) for c in arith.covers(frozenset("123"), sets, count=3)] == []
    assert arith.conflict_core(frozenset("1234"), sets) == frozenset("4")
    assert arith.conflict_core(frozenset("123"), sets) == frozenset()


def test_small_arithmetic(spark):
    assert arith.k_range(10.0, 2.0, 3.0) == (4, 5) and arith.parts_in_window(10.0, 4, 2.0, 3.0) and not arith.parts_in_window(10.0, 6, 2.0, 3.0)
    assert arith.sumset([{1, 2}, {3}]) == {4, 5}
    got = spark.createDataFrame([(0.0,), (1.0,), (1.5,), (3.0,)], "m double").select(arith.forced_splits("m", F.lit(1.0))).collect()
    assert [r[0] for r in got] == [0, 0, 1, 2]


def test_allocations_as_brute_force(spark):
    mass = {"p": 10.0, "q": 21.0, "r": 33.0}
    df = spark.createDataFrame(list(mass.items()), "part string, mass double")
    best = min(max(abs(m / k / 8 - 1) for m, k in zip(mass.values(), ks, strict=True)) for ks in itertools.product(range(1, 6), repeat=3) if sum(ks) == 8)
    rows = arith.allocations(df, 8, F.lit(8.0), 5).collect()
    assert sum(r.k for r in rows) == 8 and rows[0].worst == pytest.approx(best)
