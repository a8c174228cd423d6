import random

from pyspark.sql import functions as F

from parcelry.llm.tokengroups import Settings, joined


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = [(d, shingles(t)) for d, t in rows]
    root = list(range(len(sets)))
    links = [0] * len(sets)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            n = len(a & b)
            if n and 100 * n >= 75 * (len(a) + len(b) - n):
                root[find(i)] = find(j)
                links[i] += 1
                links[j] += 1
    least = {}
    for i, (d, _) in enumerate(sets):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(s), least[find(i)], links[i]) for i, (d, s) in enumerate(sets))


def rows_of(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    text = lambda n: rng.choices(vocabulary, k=n)
    rows = [(i, text(rng.randint(0, 80))) for i in range(80)]
    passage = text(30)
    for i in range(60):  # chains of edits: links that need not be transitive
        w = list(rows[rng.randrange(len(rows))][1])
        for _ in range(rng.randint(0, 3)):
            if w:
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((100 + i, w))
    rows += [(200 + i, passage + text(i)) for i in range(25)]
    base = text(60)
    for i in range(60):
        w = list(base)
        for _ in range(3):
            w[rng.randrange(60)] = rng.choice(vocabulary)
        rows.append((300 + i, w))
    rows = [(d, " ".join(w)) for d, w in rows]
    rows += [(400, None), (401, ""), (402, " \t\n"), (403, "One two"), (404, "one  TWO"), (405, "one two three"), (406, rows[0][1].upper()), (406, rows[0][1].upper()), (407, "É x"), (408, "é x")]
    return rows


def test_as_brute_force(spark):
    for seed, s in ((1, Settings()), (2, Settings(chunk=7, together=3))):
        rows = rows_of(seed)
        docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("c", F.lit("clash")).withColumn("n", F.lit(1)).repartition(5)
        assert sorted(tuple(r) for r in joined(docs, s).collect()) == brute(rows)


def test_empty(spark):
    assert joined(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = joined(spark.createDataFrame([(1, None), (None, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in got if r.doc_id == 1) == [(1, 0, 1, 0)] and {r.component_id for r in got if r.doc_id != 1} == {None}


def test_deduplicated_names_long_empty_and_repeated(spark):
    from parcelry.llm.tokengroups import deduplicated

    long_ = " ".join(f"w{i}" for i in range(30000))
    rows = [(1, long_, "m"), (2, long_ + " tail", "m"), (3, "a b c d e f", "m"), (3, "a b c d e f", "m"), (4, None, "m"), (4, None, "m"), (None, "q r s t u v", "m"), (5, "q r s t u v", "m")]
    for name in ("_one", "row", "doc_key"):
        docs = spark.createDataFrame(rows, f"doc_id long, text string, {name} string")
        out = deduplicated(docs)
        assert out.columns == docs.columns
        if name in ("_one", "row"):
            got = out.collect()
            assert sorted((r.doc_id or 0, r[2]) for r in got) == [(0, "m"), (1, "m"), (3, "m"), (4, "m"), (4, "m")]
    assert deduplicated(docs.limit(0)).count() == 0


def test_comparisons_within_a_group(spark):
    """Links by core and differences, and pairs that join what they join."""
    import numpy as np

    from parcelry.llm.tokengroups import Group

    rng = random.Random(4)
    base = [f"w{rng.randrange(500)}" for _ in range(60)]
    rows = [(i, " ".join(base[: 40 + i])) for i in range(12)] + [(50, " ".join(base[:40]))]
    docs = [shingles(t) for _, t in rows]
    # the kernel against brute force: core and differences
    flat = [np.array(sorted(hash(x) % 2**63 for x in d), np.uint64) for d in docs]
    n = np.array([len(x) for x in flat])
    g = Group(np.arange(len(flat)), n, np.ones(len(flat), np.int64), np.concatenate(flat))
    links, pairs = g.compared(np.arange(len(flat)), n, np.concatenate(flat))
    want = [sum(i != j and 100 * len(a & b) >= 75 * len(a | b) for j, b in enumerate(docs)) for i, a in enumerate(docs)]
    assert links.tolist() == want and len(pairs) < sum(want)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in joined(df).collect()) == brute(rows)


def test_many_partitions(spark):
    """Groups and their queries meet, however many partitions they are dealt to."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        rows = [r for r in rows_of(3) if r[0] < 100 or 300 <= r[0] < 400]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        assert sorted(tuple(r) for r in joined(docs, Settings(chunk=5, together=3)).collect()) == brute(rows)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
