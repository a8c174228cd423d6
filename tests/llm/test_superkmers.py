import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from parcelry.llm.superkmers import deduplicated, minimisers


def brute(rows, k):
    first = {}
    split = [(d, (t or "").encode().split()) for d, t in rows]
    for d, w in split:
        for i in range(len(w) - k + 1):
            key = tuple(w[i : i + k])
            first[key] = min(first.get(key, (d, i)), (d, i))
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - k + 1):
            if first[tuple(w[i : i + k])] < (d, i):
                gone.update(range(i, i + k))
        left = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(left).hexdigest()))
    return sorted(out)


def rows_of():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)] + ["é", " x", "A"]
    passage = " ".join(rng.choices(vocabulary, k=60))
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 120)))) for i in range(60)]
    rows += [(100 + i, rows[i][1] + "\n" + passage + " \t" + rows[i + 1][1]) for i in range(30)]
    rows += [(200, passage * 3), (201, " ".join(["a"] * 500)), (202, None), (203, ""), (204, "  \n "), (205, "a " * 20), (205, "a " * 20)]
    return rows


def test_as_brute_force(spark):
    rows = rows_of()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("first", F.lit("clash")).withColumn("bucket", F.lit(1)).repartition(5)
    got = sorted(tuple(r) for r in deduplicated(docs, digest=True).collect())
    assert got == brute(rows, 20)
    whole = {r.doc_id: r.kept for r in deduplicated(docs).collect()}
    assert hashlib.sha256(whole[200].encode()).hexdigest() == next(x[3] for x in got if x[0] == 200)


def test_empty_and_null_ids(spark):
    assert deduplicated(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    text = " ".join(f"w{i}" for i in range(25))
    got = {r.doc_id: r.n_removed for r in deduplicated(spark.createDataFrame([(1, text), (None, text)], "doc_id long, text string")).collect()}
    assert got == {None: 0, 1: 25}


def test_minimisers():
    h = np.random.default_rng(0).integers(0, 2**63, 100, dtype=np.uint64)
    from parcelry.llm.common import windows

    g = windows(h, 3, salt=7)
    assert minimisers(h, 20, 3).tolist() == [g[i : i + 18].min() for i in range(81)]


def test_names_long_empty_and_repeated(spark):
    from parcelry.llm.superkmers import cleaned

    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(1, passage + " " + "long " * 40000, "x", 0), (2, passage + " mine", "x", 0), (2, passage + " mine", "x", 0), (3, None, "x", 0), (4, "", "x", 0), (None, "a b", "x", 0)]
    for name in ("_d", "_t", "_spans", "row", "spans", "doc_key", "text_key", "first", "last"):
        docs = spark.createDataFrame(rows, f"doc_id long, text string, {name} string, n_chars int")
        out = cleaned(docs)
        assert out.columns == docs.columns
        if name == "row":
            got = out.collect()
            assert sorted(r.text for r in got if r.doc_id == 2) == ["mine", "mine"] and {r.doc_id for r in got} == {1, 2, 3, 4, None} and {r.row for r in got} == {"x"}
        assert cleaned(docs.limit(0)).count() == 0 if name == "spans" else True
