"""Substring dedup by super-k-mer partitioning.

The k-mers are the windows of 20 consecutive words. A window's minimiser is the smallest hash among its m-grams of
words; equal windows have equal minimisers, and neighbouring windows mostly share theirs. A maximal run of windows with
one minimiser (a super-k-mer) travels as one packed string to the bucket of that minimiser, where all its windows are
spelt out again and sorted, so that each window's occurrences meet and are counted exactly. A task sends each distinct
window once: of what it has itself it knows that all but the first occurrence repeat. A passage that a third of all
documents share thus reaches its bucket once per task and not once per document.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelry.llm.common import KEY, binaries, buckets_for, hashes, keyed, keys, lean, mixed, release, runs, united, whole, windows, words

K, M = 20, 3
#: Words that a task looks at together; a longer document is looked at whole.
TOGETHER = 400_000
#: Input bytes (as stored) for each bucket.
BUCKET_BYTES = 2 << 20


def minimisers(h: np.ndarray, k: int, m: int) -> np.ndarray:
    """Of each window of k words, the smallest hash among its m-grams. h: the words' hashes."""
    g = windows(h, m, salt=7)
    need, have = k - m + 1, 1
    while have < need:  # minima over 1, 2, 4, ... neighbours
        step = min(have, need - have)
        g = np.minimum(g[:-step], g[step:])
        have += step
    return g


def _repeats(doc: np.ndarray, start: np.ndarray, w: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Of windows, each with its place (doc, start) and two independent hashes, those that also start at an earlier place."""
    order = np.lexsort((start, doc, v, w))
    w, v, d, s = w[order], v[order], doc[order], start[order]
    new = np.r_[True, (w[1:] != w[:-1]) | (v[1:] != v[:-1])] if len(w) else np.empty(0, bool)
    head = np.maximum.accumulate(np.where(new, np.arange(len(w)), 0))
    again = np.empty(len(w), bool)
    again[order] = (d != d[head]) | (s != s[head])
    return again


def _spans_of(flagged: np.ndarray, row: np.ndarray, start: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flagged windows, ascending by row and start, as covered word ranges: row, first word, word after the last."""
    r, s = row[flagged], start[flagged]
    if not len(r):
        return r, s, s
    a, b = runs(np.r_[True, (r[1:] != r[:-1]) | (s[1:] > s[:-1] + k)])
    return r[a], s[a], s[b - 1] + k


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (count[0] of them), first[1], ..."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


def _send(group: list[tuple[int, int, bytes]], k: int, m: int, buckets: int, squeeze) -> Iterator[tuple[int, bytes]]:
    """(bucket, packed) of some documents: (key, text key, text)."""
    group = sorted({x[:2]: x for x in group}.values())
    split = [words(t) for _, _, t in group]
    count = np.array([len(x) for x in split])
    flat = [w for x in split for w in x]
    if not len(flat):
        return
    ids = np.array([g[:2] for g in group], np.int64)
    h = hashes(flat)
    begin = np.cumsum(count) - count
    n = np.maximum(count - k + 1, 0)
    at = _ranges(begin, n)  # each window's first word in flat
    row = np.repeat(np.arange(len(group)), n)
    start = at - begin[row]
    if not len(at):
        return
    w, v, low = windows(h, k)[at], windows(mixed(h ^ np.uint64(0x5851F42D4C957F2D)), k, salt=3)[at], minimisers(h, k, m)[at]
    again = _repeats(ids[row, 0], start, w, v)
    first = ~again

    # spans known here go to a bucket too, which only passes them on
    r, s, e = _spans_of(again, row, start, k)
    if len(r):
        yield int(ids[r[0], 0]) % buckets, b"S" + squeeze(np.stack([ids[r, 0], ids[r, 1], s, e]).tobytes())

    at, row, start, low = at[first], row[first], start[first], low[first]
    a, b = runs(np.r_[True, (low[1:] != low[:-1]) | (at[1:] != at[:-1] + 1) | (row[1:] != row[:-1])])
    text = b" ".join(flat)
    size = np.fromiter(map(len, flat), np.int64, len(flat)) + 1
    offset = np.r_[0, np.cumsum(size)]
    dest = (low[a] % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(dest, kind="stable")
    dest, a, b = dest[order], a[order], b[order]
    lo, hi = offset[at[a]], offset[at[b - 1] + k] - 1
    heads = np.stack([ids[row[a], 0], ids[row[a], 1], start[a], b - a])
    for i, j in zip(*runs(np.r_[True, dest[1:] != dest[:-1]]), strict=True):
        body = b" ".join([text[x:y] for x, y in zip(lo[i:j].tolist(), hi[i:j].tolist(), strict=True)])
        yield int(dest[i]), b"K" + squeeze(struct.pack("<q", j - i) + heads[:, i:j].tobytes() + body)


def _meet(table: pa.Table, k: int) -> tuple[np.ndarray, ...]:
    """All that came to a bucket: the spans to remove (key, text key, first word, word after the last)."""
    grow = zstandard.ZstdDecompressor().decompress
    known, heads, h = [], [], []
    for blob in table.column("packed").to_pylist():
        raw = grow(blob[1:])
        if blob[:1] == b"S":
            known.append(np.frombuffer(raw, np.int64).reshape(4, -1))
        else:
            (n,) = struct.unpack_from("<q", raw)
            heads.append(np.frombuffer(raw, np.int64, 4 * n, 8).reshape(4, n))
            h.append(hashes(words(raw[8 + 32 * n :])))
    out = list(known)
    if heads:
        head, hs = np.concatenate(heads, axis=1), np.concatenate(h)
        n = head[3]
        begin = np.cumsum(n + k - 1) - (n + k - 1)
        at, row = _ranges(begin, n), np.repeat(np.arange(len(n)), n)
        start = at - begin[row] + head[2][row]
        again = _repeats(head[0][row], start, windows(hs, k)[at], windows(mixed(hs ^ np.uint64(0x5851F42D4C957F2D)), k, salt=3)[at])
        r, s, e = _spans_of(again, row, start, k)
        out.append(np.stack([head[0][r], head[1][r], s, e]))
    got = np.concatenate(out, axis=1) if out else np.empty((4, 0), np.int64)
    return tuple(got)


def repeated_spans(docs: DataFrame, k: int = K, m: int = M) -> DataFrame:
    """doc_key, text_key, first, last: ranges of words (last exclusive) covered by windows that start earlier elsewhere. They may overlap."""
    buckets = buckets_for(docs, BUCKET_BYTES)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(6).compress
        group: list[tuple[int, int, bytes]] = []
        room = TOGETHER * 6

        def out() -> Iterator[pa.RecordBatch]:
            rows = list(_send(group, k, m, buckets, squeeze))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "packed"])

        for batch in batches:
            for key, text_key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), binaries(batch.column(2)), strict=True):
                if text:
                    group.append((key, text_key, text))
                    room -= len(text)
                    if room <= 0:
                        yield from out()
                        group, room = [], TOGETHER * 6
        yield from out()

    def meet(table: pa.Table) -> pa.Table:
        a, b, s, e = _meet(table, k)
        release()
        return pa.table({"doc_key": a, "text_key": b, "first": s.astype(np.int32), "last": e.astype(np.int32)})

    sent = keyed(docs).select(*KEY, "text").mapInArrow(lean(send), "bucket int, packed binary")
    return sent.groupBy("bucket").applyInArrow(meet, "doc_key long, text_key long, first int, last int")


def without(own: list[bytes], spans: list[dict] | None) -> list[bytes]:
    """The words that no span covers."""
    if not spans:
        return own
    x = np.array([(s["first"], s["last"]) for s in spans], np.int64)
    left, at = [], 0
    for a, b in zip(*(y.tolist() for y in united(x[:, 0], x[:, 1])), strict=True):
        left += own[at:a]
        at = b
    return left + own[at:]


def cleaned(docs: DataFrame, k: int = K, m: int = M) -> DataFrame:
    """The rows of docs, with all their columns, text without the words that repeat (see deduplicated) and n_chars to match.

    A text that loses words is what is left, joined by one space; other texts, null and empty ones too, stay as they are.
    A row of which nothing is left goes. Repeated rows (equal id and text) are at one place and stay, each of them; no rows
    give no rows. Columns may have any names.
    """
    spans = repeated_spans(docs, k, m).groupBy(*KEY).agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    own = whole(docs).select("row", *(c.alias(n) for c, n in zip(keys("row."), KEY, strict=True)))
    joined = own.join(spans, list(KEY), "left")
    names, at = docs.columns, docs.columns.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(1).to_pylist()
            own = batch.column(0).flatten()
            texts: list[str | None] = []
            for t, found in zip(binaries(own[at]), spans, strict=True):
                texts.append(None if t is None else b" ".join(without(words(t), found)).decode("utf-8") if found else t.decode("utf-8"))
            columns = [pa.array(texts, pa.string()) if i == at else own[i] for i in range(len(names))]
            if "n_chars" in names:
                i = names.index("n_chars")
                size = pa.array([len(t) if f else n for t, f, n in zip(texts, spans, own[i].to_pylist(), strict=True)], own[i].type)
                columns[i] = size
            stays = pa.array([not f or bool(t) for t, f in zip(texts, spans, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays(columns, names).filter(stays)

    return joined.select("row", "spans").mapInArrow(lean(cut), docs.schema)


def deduplicated(docs: DataFrame, k: int = K, m: int = M, digest: bool = False) -> DataFrame:
    """Every document without the words that repeat: doc_id, n_words, n_removed, and kept (the words left, joined by one space).

    A word goes if a window of k words that covers it also starts earlier: in a smaller doc_id, or before it in the same
    document. Windows are those of the input. Texts of fewer than k words, empty and null ones lose nothing; null text
    has no words and keeps ''. Rows that share a doc_id are at the same place, so a copy of a row removes nothing from
    it. A null doc_id comes before all others. With digest, kept_sha256 (hex, of UTF-8) takes the place of kept.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for text, spans in zip(binaries(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                own = words(text)
                left = without(own, spans)
                n_words.append(len(own))
                n_removed.append(len(own) - len(left))
                body = b" ".join(left)
                kept.append(hashlib.sha256(body).hexdigest() if digest else body.decode("utf-8"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", name])

    name = "kept_sha256" if digest else "kept"
    kind = docs.schema["doc_id"].dataType.simpleString()
    spans = repeated_spans(docs, k, m).groupBy(*KEY).agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    joined = keyed(docs).join(spans, list(KEY), "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(lean(cut), f"doc_id {kind}, n_words long, n_removed long, {name} string")
