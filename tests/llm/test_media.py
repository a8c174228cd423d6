import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parcelry.llm import flac
from parcelry.llm.media import decoded, feature, features, padded, samples_at, stored


@given(st.lists(st.binary(min_size=1, max_size=400), min_size=1, max_size=6), st.integers(16, 200))
@settings(max_examples=150, deadline=None)
def test_round_trip(payloads, block):
    streams = flac.encode(payloads, block)
    assert flac.decode(streams) == payloads


def test_blocks_seeking_and_the_plain_decoder():
    rng = random.Random(2)
    payloads = [bytes(rng.choices(range(256), k=n)) for n in (1, 63, 1024, 1025, 5000)] + [b"abc " * 900, bytes(3000), b"\x00\xff" * 700, b"a" * 2500 + b"\xff" * 700]
    for p, s in zip(payloads, flac.encode(payloads), strict=True):
        for _, n, a, b in flac.Stream(s).bounds():
            _, at = flac._read_number(s, a + 4)
            assert (flac._plain(s, at + 3, n) == flac.decode_frames([s], [(0, n, a, b)])[0]).all()
        for first in (0, len(p) // 2, max(0, len(p) - 64)):
            assert flac.read_at(s, first, 64) == p[first : first + 64]


def test_other_subframes():
    bits = lambda *fields: int("1" + "".join(f"{v & (1 << w) - 1:0{w}b}" for v, w in fields), 2)

    def packed(*fields):
        n = sum(w for _, w in fields)
        pad = -n % 8
        return ((bits(*fields) << pad) & ((1 << n + pad) - 1)).to_bytes((n + pad) // 8, "big")

    assert flac._plain(packed((0, 8), (-5, 8)), 0, 4).tolist() == [-5] * 4  # constant
    assert flac._plain(packed((2, 8), (1, 8), (-2, 8)), 0, 2).tolist() == [1, -2]  # verbatim
    # a quantised linear predictor of order 1: coefficient 3, shift 1; an escaped partition of 4-bit residuals
    lpc = packed((32 << 1, 8), (10, 8), (3, 4), (1, 5), (3, 4), (0, 2), (0, 4), (15, 4), (4, 5), (1, 4), (-1, 4))
    assert flac._plain(lpc, 0, 3).tolist() == [10, (30 >> 1) + 1, ((16 * 3) >> 1) - 1]


def test_checksums():
    s = bytearray(flac.encode([b"some text " * 300])[0])
    for at, what in ((-3, "CRC-16"), (30, "MD5")):
        bad = bytearray(s)
        bad[at] ^= 1
        with pytest.raises(ValueError, match=what):
            flac.decode([bytes(bad)])
    first = flac.Stream(bytes(s)).bounds()[0]
    head = bytearray(s)
    head[first[2] + 2] ^= 0x01
    with pytest.raises(ValueError):
        flac.decode([bytes(head)])


def test_columns(spark):
    rows = [(1, "Hello"), (2, None), (3, ""), (4, "é" * 2000), (4, "é" * 2000), (None, "x" * 64)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("media", F.lit("clash"))
    media = stored(docs)
    got = sorted(((r.doc_id or 0), r) for r in features(decoded(media)).collect())
    for (d, r), (d2, t) in zip(got, sorted(((d or 0), t or "") for d, t in rows), strict=True):
        p = padded(t.encode())
        assert d == d2 and r.n_bytes == len(t.encode()) and r.payload_bytes == len(p) and len(p) % 64 == 0 and p
        assert r.payload_sha256 == hashlib.sha256(p).hexdigest() and r.tail_crc32 == zlib.crc32(p[-64:])
    assert len({(r.media_sha256, r.feature) for d, r in got if d == 4}) == 1
    blocks = decoded(media.where("doc_id = 4").limit(1))
    payload = padded(("é" * 2000).encode())
    own = blocks.first().blocks
    assert b"".join(bytes(b.pcm) for b in own) == payload
    assert [b.first_sample for b in own] == list(np.arange(len(own)) * flac.BLOCK)
    for first in (0, 1000, 1024, 3990):
        assert bytes(samples_at(blocks, first, 64).first().pcm) == payload[first : first + 64]
    assert features(decoded(stored(docs.limit(0)))).count() == 0


def test_query_as_brute_force(spark, tmp_path):
    """Every column by hand; the stored form through the sample-by-sample decoder."""
    from parcelry.llm.queries import op6_media_flac

    rows = [(1, "Hello world. " * 400), (2, None), (3, "ü" * 70000), (4, "Hello world. " * 400)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in op6_media_flac(spark, str(tmp_path)).collect()}
    for d, t in rows:
        p = padded((t or "").encode())
        (stream,) = flac.encode([p])
        samples = []
        for _, n, a, b in flac.Stream(stream).bounds():
            _, at = flac._read_number(stream, a + 4)
            samples += flac._plain(stream, at + 3, n).tolist()
        assert bytes(x + 128 for x in samples) == p
        crossings = sum((x < 0) != (y < 0) for x, y in zip(samples, samples[1:], strict=False))
        told = f"blocks={-(-len(p) // flac.BLOCK)};sum={sum(samples)};energy={sum(x * x for x in samples)};crossings={crossings}"
        assert feature(p, -(-len(p) // flac.BLOCK)) == told
        assert tuple(got[d])[1:] == (len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(stream), hashlib.sha256(stream).hexdigest(), told)


def test_linear_predictors_are_written():
    """Text is shorter with quantised predictors than with fixed ones, and both kinds of decoder read them."""
    text = ("It was the best of times, it was the worst of times. " * 60).encode()
    (stream,) = flac.encode([text])
    kinds = set()
    for _, n, a, b in flac.Stream(stream).bounds():
        _, at = flac._read_number(stream, a + 4)
        kinds.add(stream[at + 3] >> 1)
    assert any(k >= 32 for k in kinds) and flac.decode([stream]) == [text]
