import math

import numpy as np
from pyspark.sql import functions as F

from parcelry.llm.mtree import Settings, Tree, top_k


def brute(rows, k, every):
    fine = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            fine[i] = [math.floor(1024 * x) for x in v]
    out = []
    for q in fine:
        if q % every == 0:
            got = sorted((-sum(a * b for a, b in zip(fine[q], fine[c], strict=True)), c) for c in fine if c != q)[:k]
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(got)]
    return sorted(out)


def test_tree_search_and_saving():
    rng = np.random.default_rng(0)
    x = (rng.normal(size=(20, 8))[rng.integers(0, 20, 5000)] * 900 + rng.normal(size=(5000, 8)) * 40).astype(np.int64)
    x[:400] = x[0]
    ids = rng.permutation(5000)
    tree = Tree(ids, x, Settings(page=32))
    for i in range(0, 5000, 250):
        score = x @ x[i]
        want = sorted(((-int(s), int(j)) for s, j in zip(score, ids, strict=True) if j != ids[i]))[:10]
        assert [(-a, b) for a, b in tree.search(x[i], int(ids[i]), 10)] == want
    assert tree.computed < 0.6 * 20 * 5000  # most vectors are never looked at


def test_large_values_are_exact():
    x = np.array([[2**40, 3], [2**40, 4], [-(2**40), 1]], np.int64)
    assert Tree(np.arange(3), x).search(np.array([2**40, 1]), -1, 2) == [(2**80 + 4, 1), (2**80 + 3, 0)]


def test_as_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=6).astype(np.float32).tolist()) for i in range(400)]
    rows += [(400 + i, rows[0][1]) for i in range(200)]
    rows += [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (902, [float("nan")] + [0.0] * 5), (1000, [float("inf")] + [0.0] * 5), (None, [1.0] * 6), (3, rows[3][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("cell", F.lit("x")).withColumn("label", F.lit(1))
    got = sorted(tuple(r) for r in top_k(df, Settings(cells=5, cell_rows=40, block_rows=90, together=3, page=16)).collect())
    assert got == brute(rows, 10, 100)


def test_few_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    assert top_k(spark.createDataFrame([], schema)).count() == 0
    got = top_k(spark.createDataFrame([(0, [1.0]), (1, [2.0])], schema)).collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 2 * 1024 * 1024)]


def test_lengths_that_differ(spark):
    rows = [(0, [1.0, 2.0]), (1, [3.0]), (2, [1.0, 1.0, 9.0]), (3, [2.0, 2.0])]
    got = sorted(tuple(r) for r in top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    padded = [(i, v + [0.0] * (3 - len(v))) for i, v in rows]
    assert got == brute(padded, 10, 100)
