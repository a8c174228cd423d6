import zlib
from collections import Counter

from pyspark.sql import functions as F

from parcelry.llm.rendezvous import shard_of, sharded


def test_law(spark):
    rows = [(i, "é" * (i % 50)) for i in range(3000)] + [(3000, None), (None, "x"), (7, "again"), (7, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("clash"))
    got = sharded(docs, 40, slot_rows=13).collect()
    assert len(got) == len(rows)
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 40) and r.law == "key"
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(40))
    assert 30 < sum(r.grown_shard == 40 for r in got) < 130
    sizes = sorted((r.size, r.text_crc32) for r in got)
    assert sizes == sorted((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for _, t in rows)
    again = {(r.doc_id, r.shard) for r in sharded(docs.repartition(7), 40).collect()}
    assert again == {(r.doc_id, r.shard) for r in got}


def test_weights_and_growth(spark):
    df = spark.range(20000).select(shard_of(F.col("id"), 3, [1.0, 2.0, 5.0]).alias("a"), shard_of(F.col("id"), 4, [1.0, 2.0, 5.0, 2.0]).alias("b"))
    rows = df.collect()
    assert all(r.a == r.b or r.b == 3 for r in rows)
    n = Counter(r.a for r in rows)
    assert abs(n[2] / 20000 - 5 / 8) < 0.02 and abs(n[0] / 20000 - 1 / 8) < 0.02


def test_empty(spark):
    assert sharded(spark.createDataFrame([], "doc_id long, text string"), 40).count() == 0


def test_as_brute_force(spark):
    """The rule by hand: 64-bit xxHash of the id, then of the shard's number, seeded by it; the largest -w / ln(u) wins."""
    import math
    import struct

    import xxhash

    def shard(doc_id, n):
        best = None
        for i in range(n):
            h = xxhash.xxh64_intdigest(struct.pack("<i", i), xxhash.xxh64_intdigest(struct.pack("<q", doc_id), 42))
            u = ((h >> 11) + 0.5) / 2**53
            if best is None or -1.0 / math.log(u) > best[0]:
                best = (-1.0 / math.log(u), i)
        return best[1]

    docs = spark.range(300).selectExpr("id * 7919 AS doc_id", "cast(id AS string) AS text")
    got = sharded(docs, 40, weights=[1.0] * 40, grown_weight=1.0).collect()
    assert len(got) == 300 and all(r.shard == shard(r.doc_id, 40) and r.grown_shard == shard(r.doc_id, 41) for r in got)


def test_long_text_and_lost_weights(spark):
    docs = spark.createDataFrame([(1, "é" * 500_000)], "doc_id long, text string")
    assert sharded(docs, 3).first()["size"] == 1_000_016
