import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelry.llm.mixing import Settings, mix, mixed, split, taken, targets


def test_targets():
    assert targets([100, 100, 100]) == pytest.approx([300 * 5 / 8, 300 * 2 / 8, 300 / 8])
    got = targets([10, 1000, 0, 50])
    assert got[0] == 30 and got[2] == 0
    assert sum(got) == pytest.approx(1060)
    assert all(t <= 3 * n + 1e-9 for t, n in zip(got, [10, 1000, 0, 50], strict=True))
    assert targets([]) == [] and targets([0]) == [0]


def test_split_is_exact():
    quotas = np.array([100, 3, 0, 57, 1])
    got = split(quotas, 7, 1)
    assert got.sum(axis=0).tolist() == quotas.tolist()
    assert got.sum(axis=1).max() - got.sum(axis=1).min() <= 1 and (got >= 0).all()
    assert (split(quotas, 7, 1) == got).all()
    # like dealing at random: the mean of many trees is the proportional share
    mean = np.mean([split(quotas, 7, seed) for seed in range(400)], axis=0)
    assert np.abs(mean - quotas / 7).max() < 0.5


def docs_of(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 60))), ["a", "B", "z", None][int(rng.choice(4, p=[0.1, 0.2, 0.5, 0.2]))]) for i in range(600)]
    rows += [(1000, "x " * 5, "a")] * 4 + [(1001, None, "z"), (1002, "", "B"), (None, "v v v", "a"), (1003, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash")).withColumn("block", F.lit(None).cast("int"))


def test_taken(spark):
    docs = docs_of(spark)
    s = Settings(block_words=500, shards=5)
    got = taken(docs, s).toPandas()
    assert len(got) == docs.count()
    assert (got.taken <= 3 * got["size"]).all()
    for (_, target), g in got.groupby(["source_size", "target"]):
        assert g["size"].sum() == g.source_size.iloc[0]
        assert abs(g.taken.sum() - target) <= max(5, 0.01 * target)
    again = taken(docs.repartition(7), s).toPandas()
    key = ["doc_id", "size", "taken"]
    assert sorted(map(tuple, got[key].fillna(-1).values.tolist())) == sorted(map(tuple, again[key].fillna(-1).values.tolist()))


def test_draws_and_rows(spark):
    docs = docs_of(spark)
    s = Settings(block_words=500, shards=5)
    draws = mix(docs, s).draws.toPandas()
    assert set(draws["shard"]) == set(range(5)) and not draws.duplicated(["doc_id", "fp", "copy", "pass"]).any()
    out = mixed(docs, s)
    assert out.columns == docs.columns and out.count() == len(draws)


def test_empty(spark):
    assert taken(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_the_tree_decides(spark, monkeypatch):
    from parcelry.llm import mixing

    docs = docs_of(spark)
    s = Settings(block_words=500, shards=5)
    rows = taken(docs, s).toPandas()
    # the quotas add up: a source's draws are those of all shards, and a row is taken once for each of its shards
    assert (rows.taken == rows["size"] * rows.shards.map(len)).all() and {x for v in rows.shards for x in v} == set(range(5))
    quotas = rows.groupby(["source_size", "target"]).source_draws.nunique()
    assert (quotas == 1).all()

    def to_one(quotas, shards, seed):
        out = np.zeros((shards, len(quotas)), np.int64)
        out[0] = quotas
        return out

    monkeypatch.setattr(mixing, "split", to_one)
    other = taken(docs, s).toPandas()
    assert {x for v in other.shards for x in v} == {0}


def test_sums_over_pieces_are_those_of_the_whole(spark):
    docs = docs_of(spark)
    key = lambda s: sorted((r.doc_id or -1, r.taken, tuple(r.shards)) for r in taken(docs, s).collect())
    assert key(Settings(block_words=100, shards=3, piece_blocks=2)) == key(Settings(block_words=100, shards=3, piece_blocks=1000))


def brute(rows, s):
    """The same mix in plain Python: which words each source's rows are taken for, from the draws' definition."""
    by = {}
    for d, t, source in rows:
        by.setdefault(source, []).append(len((t or "").split()))
    order = sorted(by, key=lambda x: (x is None, x or ""))
    return {source: (sum(by[source]), target) for source, target in zip(order, targets([sum(by[x]) for x in order], s), strict=True)}


def test_targets_as_brute_force(spark):
    docs = docs_of(spark)
    s = Settings(block_words=500, shards=5)
    want = brute([(r.doc_id, r.text, r.source) for r in docs.collect()], s)
    rows = taken(docs, s).toPandas()
    ids = {r.doc_id: r.source for r in docs.collect() if r.doc_id is not None}
    for r in rows.dropna(subset=["doc_id"]).itertuples():
        size, target = want[ids[int(r.doc_id)]]
        assert r.source_size == size and abs(r.target - target) < 1e-6


@pytest.mark.parametrize("name", ["row", "fp", "copy", "d", "f", "c", "shard", "place", "stretch", "_fp", "_d", "_shard"])
def test_names_of_ours_stay_theirs(spark, name):
    docs = spark.createDataFrame([(1, "a b", "x", "mine"), (2, None, None, "mine")], f"doc_id long, text string, source string, {name} string")
    out = mixed(docs, Settings(block_words=1, shards=2))
    assert out.columns == docs.columns and {r[3] for r in out.collect()} <= {"mine"}


def test_long_empty_and_repeated(spark):
    rows = [(1, "w " * 30000, "a"), (2, "", "a"), (3, None, "b")] + [(4, "x y", "b")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = taken(docs, Settings(block_words=50, shards=2)).collect()
    assert len(got) == 6 and all(r.taken <= 3 * r["size"] for r in got)
    assert mixed(docs.limit(0)).count() == 0


def spark_hash(*values):
    """The engine's 64-bit xxHash of a row: ints as 4 bytes, ("long", x) as 8, text as UTF-8; NULL leaves the seed as it is."""
    import struct

    import xxhash

    h = 42
    for v in values:
        if isinstance(v, tuple):
            v = None if v[1] is None else struct.pack("<q", v[1])
        elif isinstance(v, int):
            v = struct.pack("<i", v)
        elif isinstance(v, str):
            v = v.encode()
        if v is not None:
            h = xxhash.xxh64_intdigest(v, h)
    return h - (h >> 63 << 64)


def mixed_by_hand(rows, s):
    """taken and shards of every row, one draw after the other: {(doc_id, text, source, copy): (taken, shards)}."""
    copies, own = {}, []
    for d, t, source in rows:
        copies[d, t, source] = copies.get((d, t, source), 0) + 1
        own.append((d, t, source, copies[d, t, source]))
    order = sorted({x[2] for x in own}, key=lambda x: (x is None, x or ""))
    size = lambda x: len((x[1] or "").split())
    sizes = [sum(size(x) for x in own if x[2] == source) for source in order]
    out = {x: (0, []) for x in own}
    drawn, per_pass = [], []
    for no, (n, target) in enumerate(zip(sizes, targets(sizes, s), strict=True)):
        whole, n_blocks = int(target // n) if n else 0, max(1, round(n / s.block_words))
        rest = int(round(target - whole * n))
        blocks = {}
        for x in own:
            if x[2] == order[no]:
                fp = spark_hash(x[1], x[2])
                blocks.setdefault(spark_hash(s.seed, ("long", x[0]), ("long", fp), ("long", x[3])) % n_blocks, []).append((x, fp))
        per_pass.append(len(blocks))
        sequence = []
        for p in range(whole + 1):
            left = rest
            for nth, b in enumerate(sorted(blocks, key=lambda b: (spark_hash(s.seed, no, p, ("long", b)), b))):
                words = sum(size(x) for x, _ in blocks[b])
                if p < whole or words <= left:
                    sequence.append((p * len(blocks) + nth, [x for x, _ in blocks[b]]))
                elif left > 0:
                    some = sorted(((x, f) for x, f in blocks[b] if size(x)), key=lambda y: spark_hash(s.seed, p, ("long", y[0][0]), ("long", y[1]), ("long", y[0][3])))
                    room, take = left, []
                    for x, _ in some:
                        take.append(size(x) <= room)
                        room -= size(x) if take[-1] else 0
                    over = [i for i, t in enumerate(take) if not t]
                    if over:
                        i = min(over, key=lambda i: size(some[i][0]))
                        take[i] = abs(size(some[i][0]) - room) < room
                    sequence.append((p * len(blocks) + nth, [x for (x, _), t in zip(some, take, strict=True) if t]))
                if p == whole:
                    left -= words
        drawn.append(sequence)
    ends = np.cumsum(split(np.array([len(x) for x in drawn]), s.shards, s.seed), axis=0)
    for no, sequence in enumerate(drawn):
        for at, rows_ in sequence:
            shard = int(sum(ends[:, no] <= at))
            for x in rows_:
                out[x] = (out[x][0] + size(x), out[x][1] + [shard])
    return out


def test_taken_as_by_hand(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 40))), ["a", "B", "z", None][int(rng.choice(4, p=[0.1, 0.2, 0.5, 0.2]))]) for i in range(300)]
    rows += [(1000, "x x x", "a")] * 3 + [(1001, None, "z"), (1002, "", "B"), (None, "v v v", "a")]
    s = Settings(block_words=200, shards=4, piece_blocks=3)
    want = sorted((-1 if x[0] is None else x[0], taken_, sorted(shards)) for x, (taken_, shards) in mixed_by_hand(rows, s).items())
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.taken, list(r.shards)) for r in taken(docs, s).collect())
    assert got == want
    # and the mix itself has every row as often as it is taken
    from collections import Counter

    n = Counter(-1 if r.doc_id is None else r.doc_id for r in mixed(docs, s).collect())
    assert all(n[d] == sum(len(x[2]) for x in want if x[0] == d) for d in {x[0] for x in want})
