import hashlib
import random
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parcelry.llm.suffixes import common, deduplicated, expanded, front_coded, merged


def brute(rows, n):
    count = Counter()
    data = [(d, (t or "").encode()) for d, t in rows]
    for _, b in data:
        count.update(b[i : i + n] for i in range(len(b) - n + 1))
    out = []
    for d, b in data:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - n + 1):
            if count[b[i : i + n]] > 1:
                gone[i : i + n] = True
        left = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        out.append((-1 if d is None else d, len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0]), hashlib.sha256(left).hexdigest()))
    return sorted(out)


@given(st.lists(st.lists(st.binary(max_size=6), max_size=12), min_size=1, max_size=9))
@settings(max_examples=200, deadline=None)
def test_merge(parts):
    sorted_runs = []
    for p in parts:
        p.sort()
        shared, rest = front_coded(p)
        assert expanded(shared, list(map(len, p)), rest) == p
        sorted_runs.append((p, shared))
    order, shared = merged(sorted_runs)
    got = [sorted_runs[i][0][j] for i, j in order]
    assert got == sorted(x for p in parts for x in p)
    assert shared == [common(a, b) for a, b in zip([b"", *got], got, strict=False)]


def test_as_brute_force(spark):
    rng = random.Random(4)
    text = lambda n: "".join(rng.choices("abcdé ", k=n))
    passage, other = text(90), text(55)
    rows = [(i, text(rng.randint(0, 300))) for i in range(50)]
    rows += [(100 + i, rows[i][1][:40] + passage[i % 20 :] + rows[i + 1][1]) for i in range(30)]
    rows += [(200 + i, text(10) + other + text(i)) for i in range(12)]
    rows += [(300, "ab" * 200), (301, "ab" * 25 + "c"), (302, "x" * 39), (303, "x" * 40), (304, "y" * 41), (305, None), (306, ""), (None, rows[3][1])]
    rows += [(307, text(120))] * 2 + [(308, "abc" * 30 + passage)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("first", F.lit("clash")).repartition(6)
    got = sorted((-1 if r.doc_id is None else r.doc_id, *tuple(r)[1:]) for r in deduplicated(docs, 40, digest=True).collect())
    assert got == brute(rows, 40)
    whole = {r.doc_id: r for r in deduplicated(docs, 40).collect()}
    assert [tuple(s) for s in whole[300].spans] == [(0, 400)] and whole[300].kept == b""


def test_empty(spark):
    assert deduplicated(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert [tuple(r)[1:4] for r in deduplicated(spark.createDataFrame([(1, "a" * 399)], "doc_id long, text string"), digest=True).collect()] == [(399, 0, 0)]


def test_forced_collisions():
    """Records of one hash that aren't equal are cut apart."""
    import numpy as np

    from parcelry.llm.suffixes import told_apart

    bodies = [b"a", b"b", b"a", b"c", b"d", b"d"]
    order, first, last = told_apart(np.arange(6), np.array([0, 3, 4]), np.array([3, 4, 6]), lambda i: bodies[i])
    assert [[bodies[x] for x in order[i:j]] for i, j in zip(first, last, strict=True)] == [[b"a", b"a"], [b"b"], [b"c"], [b"d", b"d"]]
