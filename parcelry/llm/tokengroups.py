"""Exact n-gram Jaccard join by a token-group matrix.

A document is the set of its 5-word shingles, held as 64-bit hashes (tokens). Documents with equal sets are one class, of
so many documents. Similar classes are partitioned into groups; a group's row of the matrix is the union of its members'
tokens. A query (a class, against all groups but its own) can only be linked to a member of a group if it shares at least
75 % of its own tokens with the union; only then the group is opened and its members are compared.

1. Of each class some tokens (the smallest hashes) are dealt to buckets, where those of two classes or more are told from
   those of one. Let A and B be linked, so that they share c >= 75 % of either one's tokens. The j-th smallest common token
   is among the first n - ceil(0.75 n) + j of either; thus a class that has fewer than j tokens in common with any others
   among these has no link to another class. Here j = 15 % of n (of the smallest partner's).
2. The rest is partitioned: a class goes to the group of its hub, the most frequent of its dealt tokens, which near copies
   share. Hubs of many classes are cut by a min-hash, and what is still large by a hash, so that no group has more than a
   chunk of members, but for the chance of the hash. Groups are stored with their unions.
3. The unions are dealt to buckets by token, and a group gets back in how many groups each of its tokens is. Members are
   compared within their group. A member of which 75 % isn't in other groups is done. Of the others the rarest
   n - ceil(0.75 n) + j tokens are probes: a group that holds a linked class has at least j of them.
4. Groups that are hit j times get the query, bound its overlap with their union, and are opened if it suffices.

Within a group, near copies have most tokens in common. A pair's overlap is counted from the core (tokens that most
members have) and from what each member lacks of it or has beyond it, so that its work follows the differences.

Every pair of linked classes is seen from both sides, whatever the grouping, and counted; of the links only a spanning
forest of each comparison goes on, so that the links of thousands of near copies are never listed.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelry.llm.common import KEY, U64, binaries, buckets_for, forget, hashes, kept, keyed, keys, lean, mixed, whole, windows, words
from parcelry.llm.components import components

WORDS = 5
#: A link: 100 * shared >= PERCENT * united.
PERCENT = 75
#: Percent of a document's tokens that give j above.
SPARE = 15
#: Tokens that a task looks at together, and pairs that are compared at once.
TOGETHER = 1_000_000
CELLS = 2_000_000
BUCKET_BYTES = 4 << 20
SALTS = 64


@dataclass(frozen=True)
class Settings:
    #: Members of a group, and queries that meet a group together; and tokens of either.
    chunk: int = 2048
    together: int = 1024
    tokens: int = 2_000_000


def tokens(text: bytes | None, n: int = WORDS) -> np.ndarray:
    """The sorted distinct shingle hashes. Fewer than n words are one shingle; no words, none."""
    own = words((text or b"").lower())
    if not own:
        return np.empty(0, U64)
    h = hashes(own)
    return np.unique(windows(h, n)) if len(own) >= n else windows(h, len(own), salt=20 + len(own))


def linked(shared: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int):
    return 100 * shared >= PERCENT * (a + b - shared)


def least_shared(n: int | np.ndarray):
    """ceil(0.75 n): what any link shares with a set of n."""
    return -(-PERCENT * n // 100)


def _spare(n):
    return np.maximum(1, SPARE * n // 100)


def prefix(n):
    """How many of the smallest tokens are dealt out."""
    return np.minimum(n, n - least_shared(n) + _spare(n))


def _edges(x: np.ndarray) -> np.ndarray:
    """Where runs of equal neighbours begin, and the end."""
    return np.r_[0, np.flatnonzero(x[1:] != x[:-1]) + 1, len(x)] if len(x) else np.zeros(1, np.int64)


def _spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (count[0] of them), first[1], ..."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


def _pack(owner: list[int], label: list[int], sets: list[np.ndarray], buckets: int) -> list[tuple[int, bytes]]:
    """By bucket: owners, labels, how many tokens of each, and the tokens (32 bits beside those of the bucket)."""
    if not sets:
        return []
    size = np.array([len(t) for t in sets])
    flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    to = (flat % U64(buckets)).astype(np.int32)
    order = np.argsort(to, kind="stable")
    to, flat, row = to[order], (flat[order] >> U64(32)).astype(np.uint32), row[order]
    own, lab = np.array(owner, np.int64), np.array(label, np.int64)
    edges = _edges(to)
    out = []
    for i, j in zip(edges[:-1], edges[1:], strict=True):
        r = row[i:j]
        first = np.r_[0, np.flatnonzero(r[1:] != r[:-1]) + 1]
        of = r[first]
        count = np.diff(np.r_[first, j - i]).astype(np.int32)
        same = bool((own[of] == lab[of]).all())
        out.append((int(to[i]), struct.pack("<q?", len(of), same) + own[of].tobytes() + (b"" if same else lab[of].tobytes()) + count.tobytes() + flat[i:j].tobytes()))
    return out


def _unpack(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, label, token) of each token of a bucket."""
    owners, labels, tokens_ = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.uint32)]
    for b in blobs:
        n, same = struct.unpack_from("<q?", b)
        at = 9
        own = np.frombuffer(b, np.int64, n, at)
        at += 8 * n
        lab = own if same else np.frombuffer(b, np.int64, n, at)
        at += 0 if same else 8 * n
        count = np.frombuffer(b, np.int32, n, at)
        owners.append(np.repeat(own, count))
        labels.append(np.repeat(lab, count))
        tokens_.append(np.frombuffer(b, np.uint32, -1, at + 4 * n))
    return np.concatenate(owners), np.concatenate(labels), np.concatenate(tokens_)


def _shared(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, token, how many owners have it) of the tokens in this bucket that two owners or more have, by owner."""
    own, _, tok = _unpack(blobs)
    order = np.lexsort((own, tok))
    own, tok = own[order], tok[order]
    if len(own):
        once = np.r_[True, (own[1:] != own[:-1]) | (tok[1:] != tok[:-1])]
        own, tok = own[once], tok[once]
    edges = _edges(tok)
    df = np.repeat(np.diff(edges), np.diff(edges))
    on = df > 1
    own, tok, df = own[on], tok[on], df[on]
    order = np.argsort(own, kind="stable")
    return own[order], tok[order], df[order]


def _batch(names: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns), names)


def _packed(rows: list[tuple[int, bytes]], name: str) -> pa.RecordBatch:
    return _batch([name, "packed"], pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()))


def _parted(parts: int, by: np.ndarray, *columns: np.ndarray) -> list[tuple[int, bytes]]:
    """Columns of int64, int64, then int32s, packed by part of `by`."""
    to = (by % parts).astype(np.int64)
    order = np.argsort(to, kind="stable")
    to = to[order]
    edges = _edges(to)
    return [(int(to[i]), struct.pack("<q", j - i) + b"".join([c[order[i:j]].tobytes() for c in columns])) for i, j in zip(edges[:-1], edges[1:], strict=True)]


def _joined_parts(blobs: list[bytes], kinds: tuple) -> list[np.ndarray]:
    """What _parted packed, its parts one after the other."""
    out: list[list[np.ndarray]] = [[np.empty(0, k)] for k in kinds]
    for b in blobs:
        (n,) = struct.unpack_from("<q", b)
        at = 8
        for kind, own in zip(kinds, out, strict=True):
            own.append(np.frombuffer(b, kind, n, at))
            at += n * np.dtype(kind).itemsize
    return [np.concatenate(x) for x in out]


def _screen(docs: DataFrame) -> DataFrame:
    """Packed rows of two kinds. part -1: documents, their n and class (c, c2). Others: of classes' dealt tokens in one bucket, how many other classes have too, and the most frequent."""
    buckets = buckets_for(docs, BUCKET_BYTES)
    parts = _parts(buckets)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        docs_: list[tuple] = []
        total = 0

        def out() -> Iterator[pa.RecordBatch]:
            rows = [(b, b"T" + p) for b, p in _pack([c for c, _ in held], [c for c, _ in held], list(held.values()), buckets)]
            if docs_:
                rows.append((int(docs_[0][2]) % buckets, b"D" + np.array(docs_, np.int64).T.tobytes()))
            yield _packed(rows, "bucket")

        for batch in batches:
            for key, text_key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), binaries(batch.column(2)), strict=True):
                t = tokens(text)
                n = len(t)
                c, c2 = class_of(t)
                docs_.append((key, text_key, n, c, c2))
                if n and (c, c2) not in held:
                    p = int(prefix(n))
                    held[c, c2] = t[:p].copy()
                    total += p
                if total >= TOGETHER:
                    yield from out()
                    held, docs_, total = {}, [], 0
        if docs_:
            yield from out()

    def count(key: tuple, table: pa.Table) -> pa.Table:
        blobs = table.column("packed").to_pylist()
        own, tok, df = _shared([b[1:] for b in blobs if b[:1] == b"T"])
        edges = _edges(own)
        first, size = edges[:-1], np.diff(edges).astype(np.int32)
        by = np.lexsort((tok, df, own))  # of each class, the most frequent comes last
        top = by[edges[1:] - 1] if len(own) else np.empty(0, np.int64)
        hub = tok[top].astype(np.int64) << 24 ^ int(key[0].as_py())
        rows = [(-1, b[1:]) for b in blobs if b[:1] == b"D"] + _parted(parts, own[first] if len(own) else own, own[first] if len(own) else own, hub, size if len(own) else np.empty(0, np.int32), df[top].astype(np.int32))
        return pa.table({"part": pa.array([r[0] for r in rows], pa.int32()), "packed": pa.array([r[1] for r in rows], pa.binary())})

    sent = keyed(docs).select(*KEY, "text").mapInArrow(lean(send), "bucket int, packed binary")
    return kept(sent.groupBy("bucket").applyInArrow(count, "part int, packed binary"))


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for body in batch.column(0).to_pylist():
            yield _batch(["doc_key", "text_key", "n", "c", "c2"], *(pa.array(x) for x in np.frombuffer(body, np.int64).reshape(5, -1)))


def _parts(buckets: int) -> int:
    return max(1, buckets // 4)


def _summed(table: pa.Table) -> pa.Table:
    """Of a part's classes, the dealt tokens that other classes have too, of all buckets, and the hub."""
    c, hub, n, df = _joined_parts(table.column("packed").to_pylist(), (np.int64, np.int64, np.int32, np.int32))
    order = np.lexsort((hub, df, c))
    edges = _edges(c[order])
    own = c[order][edges[:-1]] if len(c) else c
    total = np.add.reduceat(n[order].astype(np.int64), edges[:-1]) if len(c) else np.empty(0, np.int64)
    last = order[edges[1:] - 1] if len(c) else np.empty(0, np.int64)
    return pa.table({"c": own, "shared": total, "hub": hub[last]})


def class_of(t: np.ndarray) -> tuple[int, int]:
    """128 bits that equal sets share."""
    a = mixed(t ^ U64(0x2545F4914F6CDD1D))
    return int(a.sum(dtype=U64).view(np.int64)), int(mixed(a).sum(dtype=U64).view(np.int64))


def _min_hash(t: np.ndarray) -> int:
    return int(mixed(t ^ U64(0x9FB21C651E98DF25)).min(keepdims=True).view(np.int64)[0])


class Group:
    """Members of the matrix's row: c, n, weight (documents of the class) and tokens, and their union."""

    def __init__(self, c: np.ndarray, n: np.ndarray, weight: np.ndarray, flat: np.ndarray):
        self.c, self.n, self.weight, self.flat = c, n, weight, flat
        self.union, at = np.unique(flat, return_inverse=True)
        row = np.repeat(np.arange(len(n)), n)
        df = np.bincount(at, minlength=len(self.union))
        self.core = 2 * df > len(n)
        # postings of tokens beyond the core: who has them; of the core: who lacks them
        extra = ~self.core[at]
        has, has_row = at[extra], row[extra]
        core = np.flatnonzero(self.core)
        place = np.full(len(self.union), -1)
        place[core] = np.arange(len(core))
        lacks, lacks_row = np.empty(0, np.int64), np.empty(0, np.int64)
        step = max(1, CELLS // max(1, len(core)))
        parts = []
        start = np.cumsum(n) - n
        for i in range(0, len(n), step):
            j = min(len(n), i + step)
            there = np.zeros((j - i, len(core)), bool)
            a, b = int(start[i]), int(start[j - 1] + n[j - 1])
            p = place[at[a:b]]
            on = p >= 0
            there[row[a:b][on] - i, p[on]] = True
            r, k = np.nonzero(~there)
            parts.append((core[k], r + i))
        if parts:
            lacks, lacks_row = (np.concatenate(x) for x in zip(*parts, strict=True))
        token, who = np.r_[has, lacks], np.r_[has_row, lacks_row]
        order = np.argsort(token, kind="stable")
        self.who = who[order]
        self.first = np.searchsorted(token[order], np.arange(len(self.union) + 1))

    @classmethod
    def read(cls, body: bytes) -> Group:
        m, total = struct.unpack_from("<qq", body)
        head = np.frombuffer(body, np.int64, 3 * m, 16).reshape(3, m)
        return cls(*head, np.frombuffer(body, U64, total, 16 + 24 * m))

    def compared(self, c: np.ndarray, n: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """Of queries (tokens one after the other): the documents that each is linked to here, but for its own class, and pairs of classes that join all that these links join."""
        links, pairs = np.zeros(len(c), np.int64), []
        label = np.arange(len(self.c))
        start = np.cumsum(n) - n
        at = np.minimum(np.searchsorted(self.union, flat), len(self.union) - 1)
        there = self.union[at] == flat
        query = np.repeat(np.arange(len(c)), n)
        overlap = np.bincount(query[there], minlength=len(c))
        opened = np.flatnonzero(100 * overlap >= PERCENT * n)  # the bound: other queries open nothing
        m = len(self.c)
        size = np.diff(self.first)[at] * there
        cost = np.cumsum(np.maximum(m, np.bincount(query, size, len(c))[opened]))
        i = 0
        while i < len(opened):  # as many queries at once as the pairs and postings allow
            j = max(i + 1, int(np.searchsorted(cost, (cost[i - 1] if i else 0) + CELLS, side="right")))
            own = opened[i:j]
            i = j
            where = _spread(start[own], n[own])
            ok = there[where]
            where, q = at[where][ok], np.repeat(np.arange(len(own)), n[own])[ok]
            in_core = self.core[where]
            count = self.first[where + 1] - self.first[where]
            to = np.repeat(q * m, count) + self.who[_spread(self.first[where], count)]
            plus = np.repeat(~in_core, count)
            cells = len(own) * m
            shared = (np.bincount(to[plus], minlength=cells) - np.bincount(to[~plus], minlength=cells)).reshape(len(own), m)
            shared += np.bincount(q[in_core], minlength=len(own))[:, None]
            hit = linked(shared, n[own][:, None], self.n[None, :]) & (c[own][:, None] != self.c[None, :])
            links[own] = hit @ self.weight
            for k in np.flatnonzero(hit.any(axis=1)).tolist():
                who = np.flatnonzero(hit[k])
                pairs.append((int(c[own[k]]), int(self.c[who[0]])))
                apart = np.unique(label[who])
                if len(apart) > 1:
                    for x in apart[1:].tolist():
                        pairs.append((int(self.c[apart[0]]), int(self.c[x])))
                    label[np.isin(label, apart)] = apart[0]
        return links, pairs


def _groups(sets: DataFrame, s: Settings) -> DataFrame:
    """g, members (packed), union (packed, sorted): the rows of the matrix, as a table."""

    def cut(df: DataFrame, by: list[str], part) -> DataFrame:
        parts = F.greatest(F.ceil(F.count("*") / s.chunk), F.ceil(F.sum("n") / s.tokens))
        large = df.groupBy(*by).agg(parts.alias("parts")).where("parts > 1")
        # a hub that many classes have is dealt over SALTS partitions on its way
        salted = large.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        own = df.withColumn("salt", F.pmod(F.xxhash64("c"), F.lit(SALTS)).cast("int"))
        out = own.join(salted, [*by, "salt"], "left").withColumn(f"{by[-1]}_part", F.pmod(part, F.coalesce("parts", F.lit(1))))
        return out.drop("parts", "salt")

    dealt = cut(cut(sets, ["hub"], F.col("low")), ["hub", "hub_part"], F.xxhash64("c"))

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        head = np.stack([table.column(x).to_numpy().astype(np.int64) for x in ("c", "n", "weight")])
        flat = b"".join(table.column("tokens").to_pylist())
        union = np.unique(np.frombuffer(flat, U64))
        body = struct.pack("<qq", head.shape[1], len(flat) // 8) + head.tobytes() + flat
        return pa.table({"g": [key[0].as_py()], "members": pa.array([body], pa.binary()), "tokens": pa.array([union.tobytes()], pa.binary())})

    keyed_ = dealt.select(F.xxhash64("hub", "hub_part", "hub_part_part").alias("g"), "c", "n", "weight", "tokens")
    return kept(keyed_.groupBy("g").applyInArrow(pack, "g long, members binary, tokens binary"))


def _matrix(groups: DataFrame, buckets: int) -> DataFrame:
    """The unions by bucket of their tokens: bucket, packed."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, sets, total = [], [], 0
        for batch in batches:
            for x, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                g.append(x)
                sets.append(np.frombuffer(body, U64))
                total += len(sets[-1])
                if total >= TOGETHER:
                    yield _packed(_pack(g, g, sets, buckets), "bucket")
                    g, sets, total = [], [], 0
        if g:
            yield _packed(_pack(g, g, sets, buckets), "bucket")

    return groups.select("g", "tokens").mapInArrow(lean(send), "bucket int, packed binary")


#: Kinds of rows that comparisons yield: links of a class (c, how many), pairs of classes. Probes have their bucket, 0 or more.
LINKS, PAIRS = -1, -2


def _found(c: np.ndarray, links: np.ndarray, pairs: list[tuple[int, int]]) -> list[tuple[int, bytes]]:
    on = links > 0
    out = [(LINKS, np.stack([c[on], links[on]]).tobytes())] if on.any() else []
    return out + ([(PAIRS, np.array(pairs, np.int64).T.copy().tobytes())] if pairs else [])


def _inside(groups: DataFrame, buckets: int) -> DataFrame:
    """kind, packed: what comparisons within the groups find, and the probes of members that may be linked elsewhere."""
    parts = _parts(buckets)

    def rated(key: tuple, table: pa.Table) -> pa.Table:
        g, tok, df = _shared(table.column("packed").to_pylist())
        rows = _parted(parts, g, g, tok.astype(np.int64) << 24 ^ int(key[0].as_py()), df.astype(np.int32))
        return pa.table({"part": pa.array([r[0] for r in rows], pa.int32()), "packed": pa.array([r[1] for r in rows], pa.binary())})

    def probe(left: pa.Table, right: pa.Table) -> pa.Table:
        of, token, df = _joined_parts(right.column("packed").to_pylist(), (np.int64, np.int64, np.int32))
        order = np.lexsort((token, of))
        of, token, df = of[order], token[order], df[order]
        rows: list[tuple[int, bytes]] = []
        owner, label, sets = [], [], []
        total = 0
        for g, body in zip(left.column("g").to_pylist(), left.column("members").to_pylist(), strict=True):
            own = Group.read(body)
            if len(own.c) > 1:
                rows += _found(own.c, *own.compared(own.c, own.n, own.flat))
            a, b = np.searchsorted(of, [g, g], side="left")[0], np.searchsorted(of, g, side="right")
            if a == b:
                continue
            name = (own.flat >> U64(32)).astype(np.int64) << 24 ^ (own.flat % U64(buckets)).astype(np.int64)
            at = a + np.minimum(np.searchsorted(token[a:b], name), b - a - 1)
            others = np.where(token[at] == name, df[at] - 1, 0)
            row = np.repeat(np.arange(len(own.n)), own.n)
            may = 100 * np.bincount(row[others > 0], minlength=len(own.n)) >= PERCENT * own.n
            order_ = np.lexsort((own.flat, others, row))
            start = np.cumsum(own.n) - own.n
            for i in np.flatnonzero(may).tolist():
                first = order_[start[i] : start[i] + int(prefix(own.n[i]))]
                owner.append(int(own.c[i]))
                label.append(g)
                sets.append(own.flat[first[others[first] > 0]])
                total += len(first)
                if total >= TOGETHER:
                    rows += _pack(owner, label, sets, buckets)
                    owner, label, sets, total = [], [], [], 0
        rows += _pack(owner, label, sets, buckets)
        return pa.table({"kind": pa.array([r[0] for r in rows], pa.int32()), "packed": pa.array([r[1] for r in rows], pa.binary())})

    rates = _matrix(groups, buckets).groupBy("bucket").applyInArrow(rated, "part int, packed binary")
    own = groups.select("g", "members", F.pmod("g", F.lit(parts)).cast("int").alias("part"))
    return kept(own.groupBy("part").cogroup(rates.groupBy("part")).applyInArrow(probe, "kind int, packed binary"))


def _hits(groups: DataFrame, inside: DataFrame, buckets: int) -> DataFrame:
    """c, g, hits: how many probes of a class are in the union of a group that isn't its own."""
    parts = _parts(buckets)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        g, _, tok = _unpack(left.column("packed").to_pylist())
        order = np.lexsort((g, tok))
        g, tok = g[order], tok[order]
        c, own, want = _unpack(right.column("packed").to_pylist())
        rows: list[tuple[int, bytes]] = []
        a, b = np.searchsorted(tok, want, side="left"), np.searchsorted(tok, want, side="right")
        ends = np.cumsum(b - a)
        at = 0
        while at < len(c):  # so many pairs at once
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CELLS, side="right")))
            count = (b - a)[at:to]
            x, y = np.repeat(c[at:to], count), g[_spread(a[at:to], count)]
            other = y != np.repeat(own[at:to], count)
            x, y = x[other], y[other]
            order = np.lexsort((y, x))
            x, y = x[order], y[order]
            if len(x):
                new = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
                rows += _parted(parts, x[new], x[new], y[new], np.diff(np.r_[new, len(x)]).astype(np.int32))
            at = to
        return pa.table({"part": pa.array([r[0] for r in rows], pa.int32()), "packed": pa.array([r[1] for r in rows], pa.binary())})

    def total(table: pa.Table) -> pa.Table:
        c, g, n = _joined_parts(table.column("packed").to_pylist(), (np.int64, np.int64, np.int32))
        order = np.lexsort((g, c))
        c, g, n = c[order], g[order], n[order].astype(np.int64)
        new = np.flatnonzero(np.r_[True, (c[1:] != c[:-1]) | (g[1:] != g[:-1])]) if len(c) else np.empty(0, np.int64)
        return pa.table({"c": c[new], "g": g[new], "hits": np.add.reduceat(n, new) if len(new) else n})

    probes = inside.where("kind >= 0").select(F.col("kind").alias("bucket"), "packed")
    met = _matrix(groups, buckets).groupBy("bucket").cogroup(probes.groupBy("bucket")).applyInArrow(meet, "part int, packed binary")
    return met.groupBy("part").applyInArrow(total, "c long, g long, hits long")


def _across(sets: DataFrame, groups: DataFrame, hits: DataFrame, s: Settings) -> DataFrame:
    """kind, packed: what queries find in groups that aren't their own."""
    need = F.greatest(F.lit(1), F.floor(F.col("n") * SPARE / 100))
    asked = kept(hits.join(sets.select("c", "n"), "c").where(F.col("hits") >= need).select("c", "g", "n"))
    parts = asked.groupBy("g").agg(F.greatest(F.ceil(F.count("*") / s.together), F.ceil(F.sum("n") / s.tokens)).cast("int").alias("parts"))
    queries = asked.join(parts, "g").withColumn("part", F.pmod(F.xxhash64("c"), "parts").cast("int")).select("g", "part", "c").join(sets.select("c", "n", "tokens"), "c")
    # both sides' keys are of one type: cogrouping deals them by hashes, which differ between types
    # a group is copied as often as its own queries need, and not at all without any
    rows = groups.select("g", "members").join(parts, "g").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[tuple[int, bytes]] = []
        if left.num_rows and right.num_rows:
            own = Group.read(left.column("members")[0].as_py())
            c = right.column("c").to_numpy()
            rows = _found(c, *own.compared(c, right.column("n").to_numpy(), np.frombuffer(b"".join(right.column("tokens").to_pylist()), U64)))
        return pa.table({"kind": pa.array([r[0] for r in rows], pa.int32()), "packed": pa.array([r[1] for r in rows], pa.binary())})

    return kept(rows.select("g", "part", "members").groupBy("g", "part").cogroup(queries.select("g", "part", "c", "n", "tokens").groupBy("g", "part")).applyInArrow(compare, "kind int, packed binary"))


def classes(docs: DataFrame, s: Settings = Settings()) -> tuple[DataFrame, DataFrame, DataFrame, list[DataFrame]]:
    """(documents, links, pairs, tables): doc_key, text_key, n, c (a class) of every row; c, links (rows of other classes that it links with); a, b: links between classes that join all that links join; the tables that only links and pairs read."""
    screened = _screen(docs)
    rows = screened.where("part = -1").select("packed").mapInArrow(lean(_unpacked), "doc_key long, text_key long, n long, c long, c2 long")
    reps = rows.where("n > 0").groupBy("c", "c2").agg(F.min(F.struct(*KEY)).alias("rep"), F.first("n").alias("size"), F.count("*").alias("weight"))
    counts = screened.where("part >= 0").groupBy("part").applyInArrow(_summed, "c long, shared long, hub long")
    smallest = F.ceil(F.col("size") * PERCENT / 100)
    need = F.greatest(F.lit(1), F.floor(smallest * SPARE / 100))
    left = reps.join(counts, "c").where(F.col("shared") >= need).select("c", "weight", "hub", "rep.*")
    own = keyed(docs).select(*KEY, "text").join(left, list(KEY)).select("c", "weight", "hub", "text")

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                sets = [tokens(t) for t in binaries(part.column(3))]
                yield _batch(
                    ["c", "weight", "hub", "n", "low", "tokens"],
                    *(part.column(k) for k in range(3)),
                    pa.array(map(len, sets), pa.int64()),
                    pa.array([_min_hash(t) for t in sets], pa.int64()),
                    pa.array([t.tobytes() for t in sets], pa.binary()),
                )

    spelt = own.mapInArrow(lean(spell), "c long, weight long, hub long, n long, low long, tokens binary")
    sets = kept(spelt.dropDuplicates(["c"]))  # rows that share id and text are one document
    buckets = buckets_for(sets, BUCKET_BYTES)
    groups = _groups(sets, s)
    inside = _inside(groups, buckets)
    across = _across(sets, groups, _hits(groups, inside, buckets), s)
    forget(sets, groups)
    found = inside.where("kind < 0").unionByName(across)

    def two(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body in batch.column(0).to_pylist():
                yield _batch(["a", "b"], *(pa.array(x) for x in np.frombuffer(body, np.int64).reshape(2, -1)))

    links = found.where(F.col("kind") == LINKS).select("packed").mapInArrow(two, "a long, b long").groupBy(F.col("a").alias("c")).agg(F.sum("b").alias("links"))
    pairs = found.where(F.col("kind") == PAIRS).select("packed").mapInArrow(two, "a long, b long")
    return rows.select(*KEY, "n", "c"), links, pairs, [inside, across]


def _labelled(docs: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    """doc_key, text_key, n, c of every row; of every class c with words its rows (alike), links, the smallest row of it (first: KEY) and the label of its component.

    Tables, so that what joins them reads plain shuffles, whose hot keys adaptive execution splits.
    """
    rows, links, pairs, tables = classes(docs, s)
    labels = kept(components(pairs)).withColumnRenamed("node", "c")
    own = rows.where("n > 0").groupBy("c").agg(F.count("*").alias("alike"), F.min(F.struct(*KEY)).alias("first"))
    found = kept(own.join(labels, "c", "left").join(links, "c", "left").select("c", "alike", "first", F.coalesce("links", F.lit(0)).cast("long").alias("links"), F.coalesce("component", "c").alias("label")))
    forget(labels, *tables)
    return rows, found


def deduplicated(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The rows of docs, with all their columns, less near duplicates: of each component the row of the smallest doc_id stays.

    If several rows have that doc_id, the one of the smallest text hash stays, and of equal rows one. Rows without words
    link with nothing and all stay. A null doc_id comes before all others, very long texts are looked at whole, no rows
    give no rows, and columns may have any names.
    """
    rows, own_classes = _labelled(docs, s)
    first = own_classes.groupBy("label").agg(F.min("first").alias("k")).select("k.*", F.lit(True).alias("one"))
    empty = rows.where("n = 0").select(*KEY, F.lit(False).alias("one")).distinct()
    own = whole(docs).select("row", *(c.alias(k) for c, k in zip(keys("row."), KEY, strict=True)))
    stay = own.join(first.unionByName(empty), list(KEY)).withColumn("nth", F.row_number().over(Window.partitionBy(*KEY).orderBy("doc_key")))
    return stay.where(~F.col("one") | (F.col("nth") == 1)).select("row.*")


def joined(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links (other rows it links with) of every row.

    Two rows link when 100 * shared >= 75 * united shingles; component_id is the smallest doc_id that links reach. Texts
    without words, null ones too, have no shingles and link with nothing. A null doc_id comes before all others, and a
    component that holds one has a null component_id. Repeated rows have equal sets and so link. Very long texts are
    looked at whole. No rows give no rows. Other columns of docs aren't looked at.
    """
    rows, own_classes = _labelled(docs, s)
    least = kept(own_classes.groupBy("label").agg(F.min("first")["doc_key"].alias("least")))
    told = kept(own_classes.join(least, "label").select("c", "least", (F.col("alike") - 1 + F.col("links")).alias("n_links")))
    forget(own_classes, least)
    has = F.col("n") > 0
    done = rows.join(told, "c", "left").select(*KEY, F.col("n").alias("n_shingles"), F.when(has, F.col("least")).otherwise(F.col("doc_key")).alias("least"), F.when(has, F.col("n_links")).otherwise(0).cast("long").alias("n_links"))
    null = F.lit(-(2**63)).cast("long")
    return done.select(F.nullif("doc_key", null).alias("doc_id"), "n_shingles", F.nullif("least", null).alias("component_id"), "n_links")
