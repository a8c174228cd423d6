"""Suffix-array dedup: a distributed merge sort of suffixes that knows their common prefixes.

To be found: every string of LENGTH bytes that starts at two places. Sorting the suffixes of a whole corpus to that
depth would send each byte hundreds of times, so the suffix array is sparse: it holds the suffixes at anchors. The
anchor of a window of LENGTH bytes is where the hash of the next ANCHOR bytes is smallest, taken so that these lie within
the window. Equal windows have their anchors at equal offsets, and neighbouring windows mostly share theirs. A record is
a maximal run of windows with one anchor; its string is what these windows span, about 1.4 LENGTH.

1. Every anchor's hash goes to its bucket. Where a hash is there once, all windows of its record are unique. Records that
   are equal within a task, by a hash and then byte by byte, are repeats already, and one of them goes on for all.
2. Of the other anchors each task sorts the suffixes, by bucket, and sends the sorted run front-coded: the length of the
   prefix shared with the suffix before, and the rest.
3. A bucket merges its runs by a loser tree. Players carry the prefix they share with the last winner; unequal lengths
   decide a match without a look at the strings, equal ones let it begin behind the known prefix. So the merge also
   yields the prefixes that neighbours of the merged array share.
4. A window at offset o before its anchor equals another if the suffixes share LENGTH - o bytes and the contexts before
   the anchors o bytes. Both are classes of neighbours in a sorted array with shared prefixes not below that length.

A record's repeated windows overlap, so they cover one range of bytes.
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

from parcelry.llm.common import KEY, U64, binaries, buckets_for, kept, keyed, lean, mixed, runs, united

LENGTH = 400
#: Bytes of text that a task looks at together; a longer document is looked at whole.
TOGETHER = 2 << 20
BUCKET_BYTES = 8 << 20

_RNG = np.random.default_rng(9)
_OF_BYTE = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_R = U64(0x9E3779B97F4A7C15)
_R_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("r", ())) < n:
        for name, base in (("r", _R), ("i", _R_INVERSE)):
            steps = np.full(n, base, U64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=U64)
    return _powers["r"][:n], _powers["i"][:n]


class Hashed:
    """Hashes of any substrings of some bytes, from the sums of a polynomial's terms."""

    def __init__(self, data: np.ndarray):
        r, self.inverse = _power(len(data) + 1)
        self.sums = np.empty(len(data) + 1, U64)
        self.sums[0] = 0
        np.cumsum(_OF_BYTE[data] * r[:-1], out=self.sums[1:])

    def all(self, n: int) -> np.ndarray:
        """Of the n bytes from each place on."""
        return mixed((self.sums[n:] - self.sums[:-n]) * self.inverse[: len(self.sums) - n])

    def of(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        return mixed((self.sums[last] - self.sums[first]) * self.inverse[first])


def anchors(h: Hashed, sizes: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, ...]:
    """The records of some texts, one after the other in h: text, anchor's place, first window and last window (places in all)."""
    total = int(sizes.sum())
    none = np.empty(0, np.int64)
    if total < length:
        return none, none, none, none
    # 32 bits of hash, then the place: the smallest, and among equals the leftmost
    low = (h.all(anchor) & U64(0xFFFFFFFF00000000)) | np.arange(total - anchor + 1, dtype=U64)
    need, have = length - anchor + 1, 1
    while have < need:
        step = min(have, need - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    begin = np.cumsum(sizes) - sizes
    n = np.maximum(sizes - length + 1, 0)
    start = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    if not len(start):
        return none, none, none, none
    at = (low[start] & U64(0xFFFFFFFF)).astype(np.int64)
    text = np.repeat(np.arange(len(sizes)), n)
    a, b = runs(np.r_[True, (at[1:] != at[:-1]) | (text[1:] != text[:-1])])
    return text[a], at[a], start[a], start[b - 1]


def told_apart(order: np.ndarray, first: np.ndarray, last: np.ndarray, body) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of equal hashes, cut where the bodies differ after all."""
    cut: list[int] = []
    for i, j in zip(first[last - first > 1].tolist(), last[last - first > 1].tolist(), strict=True):
        own = [body(x) for x in order[i:j].tolist()]
        if any(x != own[0] for x in own[1:]):
            by = sorted(range(j - i), key=lambda x: (own[x], x))
            order[i:j] = order[i:j][by]
            cut += [i + x for x in range(1, j - i) if own[by[x]] != own[by[x - 1]]]
    if cut:
        first = np.sort(np.r_[first, np.array(cut, first.dtype)])
        last = np.r_[first[1:], last[-1]]
    return order, first, last


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """How long the prefix is that a and b share; they share `known` bytes for certain."""
    n = min(len(a), len(b))
    while known < n:  # in steps: mostly the difference isn't far
        step = min(64, n - known)
        x = int.from_bytes(a[known : known + step], "big") ^ int.from_bytes(b[known : known + step], "big")
        if x:
            return known + step - (x.bit_length() + 7) // 8
        known += step
    return n


def front_coded(strings: list[bytes]) -> tuple[list[int], bytes]:
    """Of sorted strings, the prefix each shares with the one before, and all that isn't shared."""
    shared, before, rest = [], b"", []
    for s in strings:
        n = common(before, s)
        shared.append(n)
        rest.append(s[n:])
        before = s
    return shared, b"".join(rest)


def expanded(shared: list[int], sizes: list[int], rest: bytes) -> list[bytes]:
    out, before, at = [], b"", 0
    for n, size in zip(shared, sizes, strict=True):
        before = before[:n] + rest[at : at + size - n]
        at += size - n
        out.append(before)
    return out


def merged(sorted_runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[tuple[int, int]], list[int]]:
    """Sorted runs with their shared prefixes, merged by a loser tree: (run, place) in order, and the prefix each shares with the one before."""
    k = 1
    while k < len(sorted_runs):
        k *= 2
    strings: list[bytes | None] = [r[0][0] if r[0] else None for r in sorted_runs] + [None] * (k - len(sorted_runs))
    known, place = [0] * k, [0] * k
    losers = [0] * k

    def match(a: int, b: int) -> tuple[int, int]:
        """(winner, loser) of two runs whose strings' shared prefixes with the same last winner are known."""
        x, y = strings[a], strings[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        p, q = known[a], known[b]
        if p != q:
            return (a, b) if p > q else (b, a)
        n = common(x, y, p)
        if x[n:] <= y[n:]:
            known[b] = n
            return a, b
        known[a] = n
        return b, a

    def build(node: int) -> int:
        if node >= k:
            return node - k
        winner, losers[node] = match(build(2 * node), build(2 * node + 1))
        return winner

    order, shared = [], []
    best = build(1)
    while strings[best] is not None:
        order.append((best, place[best]))
        shared.append(known[best])
        place[best] += 1
        i, (own, lcp) = place[best], sorted_runs[best]
        strings[best], known[best] = (own[i], lcp[i]) if i < len(own) else (None, 0)
        node = (best + k) >> 1
        while node:
            best, losers[node] = match(best, losers[node])
            node >>= 1
    return order, shared


def repeated(shared: np.ndarray, before: list[bytes], low: np.ndarray, high: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of records whose suffixes are sorted: the smallest and largest offset of a window that repeats; -1 for none.

    shared: prefixes that neighbouring suffixes share. before: the contexts before the anchors, backwards. low and high: the
    offsets of each record's windows.
    """
    n = len(low)
    by_context = sorted(range(n), key=before.__getitem__)
    left = np.zeros(n, np.int64)
    for i in range(1, n):
        left[i] = common(before[by_context[i - 1]], before[by_context[i]])
    place = np.empty(n, np.int64)
    place[by_context] = np.arange(n)
    least, most = np.full(n, -1), np.full(n, -1)
    for o in range(int(low.min()), int(high.max()) + 1):
        on = np.flatnonzero((low <= o) & (o <= high))
        if len(on) < 2:
            continue
        key = np.cumsum(shared < length - o)[on] * (n + 1) + np.cumsum(left < o)[place[on]]
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        hit = on[order[np.r_[same, False] | np.r_[False, same]]]
        most[hit] = o
        fresh = hit[least[hit] < 0]
        least[fresh] = o
    return least, most


def _columns(n: int, *columns: np.ndarray) -> bytes:
    return struct.pack("<q", n) + np.stack([np.asarray(c, np.int64) for c in columns]).tobytes()


def _flush(batches: Iterator[pa.RecordBatch], text_column: int, work) -> Iterator[pa.RecordBatch]:
    group, room = [], TOGETHER
    for batch in batches:
        columns = [binaries(batch.column(i)) if i == text_column else batch.column(i).to_pylist() for i in range(batch.num_columns)]
        for row in zip(*columns, strict=True):
            group.append(row)
            room -= len(row[text_column] or b"")
            if room <= 0:
                yield from work(group)
                group, room = [], TOGETHER
    if group:
        yield from work(group)


def _rows(found: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    if found:
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.binary())], ["bucket", "packed"])


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_key, text_key, first, last: ranges of bytes (last exclusive) covered by strings of `length` bytes that start elsewhere too. They may overlap."""
    anchor = max(1, length // 4)
    buckets = buckets_for(docs, BUCKET_BYTES)
    own = keyed(docs).where(F.octet_length("text") >= length).select(*KEY, F.col("text"))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(3).compress

        def work(group: list[tuple]) -> Iterator[pa.RecordBatch]:
            sizes = np.array([len(g[2]) for g in group], np.int64)
            keys = np.array([g[:2] for g in group], np.int64)
            begin = np.cumsum(sizes) - sizes
            joined = b"".join([g[2] for g in group])
            h = Hashed(np.frombuffer(joined, np.uint8))
            text, at, a, b = anchors(h, sizes, length, anchor)
            if not len(text):
                return
            whole = h.of(a, b + length) ^ mixed(((at - a) << 32 | (b - a)).astype(U64))
            order = np.argsort(whole, kind="stable")
            first, last = runs(np.r_[True, whole[order][1:] != whole[order][:-1]])
            order, first, last = told_apart(order, first, last, lambda i: joined[a[i] : b[i] + length])
            many = np.repeat(last - first > 1, last - first)
            rep = order[first]
            out = []
            known = np.sort(order[many])
            if len(known):
                t, x, y = text[known], a[known], b[known] + length
                s, e = runs(np.r_[True, (t[1:] != t[:-1]) | (x[1:] > y[:-1])])
                t, x, y = t[s], x[s] - begin[t[s]], y[e - 1] - begin[t[s]]
                out.append((int(keys[t[0], 0]) % buckets, b"S" + squeeze(_columns(len(t), keys[t, 0], keys[t, 1], x, y))))
            g = h.of(at[rep], at[rep] + anchor)
            to = (g % U64(buckets)).astype(np.int64)
            order = np.lexsort((rep, to))
            rep, g, to = rep[order], g[order], to[order]
            t = text[rep]
            for i, j in zip(*runs(np.r_[True, to[1:] != to[:-1]]), strict=True):
                c, d = rep[i:j], t[i:j]
                out.append((int(to[i]), b"A" + squeeze(_columns(j - i, g[i:j].view(np.int64), keys[d, 0], keys[d, 1], at[c] - begin[d], a[c] - begin[d], b[c] - begin[d]))))
            yield from _rows(out)

        yield from _flush(batches, 2, work)

    def screen(table: pa.Table) -> pa.Table:
        """Anchors whose hash is there more than once, as records; and spans passed on, which have no anchor."""
        grow = zstandard.ZstdDecompressor().decompress
        spans, found = [np.empty((4, 0), np.int64)], [np.empty((6, 0), np.int64)]
        for blob in table.column("packed").to_pylist():
            raw = np.frombuffer(grow(blob[1:]), np.int64)
            (spans if blob[:1] == b"S" else found).append(raw[1:].reshape(-1, int(raw[0])))
        s, f = np.concatenate(spans, axis=1), np.concatenate(found, axis=1)
        order = np.argsort(f[0], kind="stable")
        f = f[:, order]
        i, j = runs(np.r_[True, f[0][1:] != f[0][:-1]]) if f.shape[1] else (np.empty(0, np.int64),) * 2
        f = f[:, np.repeat(j - i > 1, j - i)]
        none = np.full(s.shape[1], -1)
        return pa.table({"doc_key": np.r_[f[1], s[0]], "text_key": np.r_[f[2], s[1]], "at": np.r_[f[3], none].astype(np.int32), "first": np.r_[f[4], s[2]].astype(np.int32), "last": np.r_[f[5], s[3]].astype(np.int32)})

    screened = kept(own.mapInArrow(lean(send), "bucket int, packed binary").groupBy("bucket").applyInArrow(screen, "doc_key long, text_key long, at int, first int, last int"))
    wanted = screened.where("at >= 0").groupBy(*KEY).agg(F.collect_set(F.struct("at", "first", "last")).alias("records"))

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(3).compress

        def work(group: list[tuple]) -> Iterator[pa.RecordBatch]:
            by: dict[int, list] = {}
            for doc_key, text_key, text, records in group:
                for r in records:
                    p, a, b = r["at"], r["first"], r["last"]
                    to = int.from_bytes(hashlib.blake2b(text[p : p + anchor], digest_size=6).digest(), "little") % buckets
                    by.setdefault(to, []).append((text[p : b + length], text[a:p][::-1], doc_key, text_key, p, a, b))
            out = []
            for to, found in by.items():
                found.sort(key=lambda f: f[0])
                shared, rest = front_coded([f[0] for f in found])
                heads = [[f[i] for f in found] for i in (2, 3, 4, 5, 6)]
                body = _columns(len(found), shared, *heads) + struct.pack("<q", len(rest)) + rest + b"".join([f[1] for f in found])
                out.append((to, squeeze(body)))
            yield from _rows(out)

        yield from _flush(batches, 2, work)

    def meet(table: pa.Table) -> pa.Table:
        grow = zstandard.ZstdDecompressor().decompress
        sorted_runs, heads, before = [], [], []
        for blob in table.column("packed").to_pylist():
            raw = grow(blob)
            (n,) = struct.unpack_from("<q", raw)
            head = np.frombuffer(raw, np.int64, 6 * n, 8).reshape(6, n)
            (size,) = struct.unpack_from("<q", raw, 8 + 48 * n)
            at = 16 + 48 * n
            sizes = head[5] + length - head[3]
            sorted_runs.append((expanded(head[0].tolist(), sizes.tolist(), raw[at : at + size]), head[0].tolist()))
            at += size
            own = []
            for m in (head[3] - head[4]).tolist():
                own.append(raw[at : at + m])
                at += m
            heads.append(head)
            before.append(own)
        order, shared = merged(sorted_runs)
        which, place = (np.array(x, np.int64) for x in zip(*order, strict=True))
        offset = np.cumsum([0, *(len(r[0]) for r in sorted_runs)])
        head = np.concatenate(heads, axis=1)[:, offset[which] + place]
        p, a, b = head[3], head[4], head[5]
        least, most = repeated(np.array(shared), [before[i][j] for i, j in order], p - b, p - a, length)
        hit = least >= 0
        return pa.table({"doc_key": head[1][hit], "text_key": head[2][hit], "first": (p - most)[hit].astype(np.int32), "last": (p - least + length)[hit].astype(np.int32)})

    suffixes = own.join(wanted, list(KEY)).select(*KEY, "text", "records").mapInArrow(lean(sort), "bucket int, packed binary")
    found = suffixes.groupBy("bucket").applyInArrow(meet, "doc_key long, text_key long, first int, last int")
    return screened.where("at < 0").drop("at").unionByName(found)


def deduplicated(docs: DataFrame, length: int = LENGTH, digest: bool = False) -> DataFrame:
    """Every document's bytes without those that repeat: doc_id, n_bytes, n_removed, n_spans (maximal removed ranges), spans, kept (binary).

    A byte goes if a string of `length` bytes that covers it starts at any other place too, in this document or another; so
    no copy is kept. Strings are those of the input and never cross documents. Every row is a place of its own: rows that
    are repeated remove each other. Null text counts as empty; texts shorter than `length` bytes lose nothing. With
    digest, kept_sha256 (hex) takes the place of spans and kept.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, spans, kept_ = [], [], [], []
            for text, found in zip(binaries(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                text = text or b""
                a, b = united(*np.array([(s["first"], s["last"]) for s in found or ()], np.int64).reshape(-1, 2).T)
                edges = [0, *(x for pair in zip(a.tolist(), b.tolist(), strict=True) for x in pair), len(text)]
                left = b"".join([text[i:j] for i, j in zip(edges[::2], edges[1::2], strict=True)])
                sizes.append(len(text))
                removed.append(len(text) - len(left))
                spans.append([{"first": i, "last": j} for i, j in zip(a.tolist(), b.tolist(), strict=True)])
                kept_.append(left)
            front = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(map(len, spans), pa.int64())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans"]
            if digest:
                yield pa.RecordBatch.from_arrays([*front, pa.array([hashlib.sha256(x).hexdigest() for x in kept_], pa.string())], [*names, "kept_sha256"])
            else:
                kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
                yield pa.RecordBatch.from_arrays([*front, pa.array(spans, kind), pa.array(kept_, pa.binary())], [*names, "spans", "kept"])

    spans = repeated_spans(docs, length).groupBy(*KEY).agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    joined = keyed(docs).join(spans, list(KEY), "left").select("doc_id", "text", "spans")
    tail = "kept_sha256 string" if digest else "spans array<struct<first: int, last: int>>, kept binary"
    return joined.mapInArrow(lean(cut), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, {tail}")
