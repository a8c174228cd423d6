"""Byte-level BPE by corpus-level merge replay.

The pieces of many documents are encoded together: each distinct piece once, all pieces of a batch in one linked
array of byte tokens. An inverted index maps a rank to the positions whose token pair merges to that rank. A heap hands
out the ranks in ascending order; a rank's merges are all applied, left to right, and only the pairs beside a merged
position are looked up anew. Each piece thus always merges its lowest-ranked pair first, the leftmost among equals,
which is the greedy rule of the reference encoders of this vocabulary format.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from parcelry.llm.common import lean


#: Distinct pieces whose ids a worker remembers (about 0.2 KB each); beyond, it starts over. A matter of speed only.
REMEMBERED = 1_000_000
#: Pairs of tokens whose merge a worker remembers.
PAIRS = 300_000


class Vocabulary:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.of_byte = [ranks[bytes([b])] for b in range(256)]
        self.text = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.text[rank] = token
        #: The rank that two bytes, or two tokens (a << 20 | b), merge to; -1 for none.
        self.of_bytes = [ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)]
        self.pairs: dict[int, int] = {}
        self.known: dict[str, bytes] = {}

    def _merge(self, key: int) -> int:
        if len(self.pairs) > PAIRS:
            self.pairs.clear()
        r = self.pairs[key] = self.ranks.get(self.text[key >> 20] + self.text[key & 0xFFFFF], -1)
        return r

    def replay(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece (none is empty), as little-endian unsigned 32-bit integers."""
        if not pieces:
            return []
        of_byte, of_bytes, get, look = self.of_byte, self.of_bytes, self.pairs.get, self._merge
        whole = [self.ranks.get(p, -1) for p in pieces]
        size = np.fromiter((len(p) if w < 0 else 1 for p, w in zip(pieces, whole, strict=True)), np.int64, len(pieces))
        end = np.cumsum(size)
        links = np.arange(1, end[-1] + 1)
        links[end - 1] = -1
        after = links.tolist()
        links = np.arange(-1, end[-1] - 1)
        links[end - size] = -1
        before = links.tolist()
        tokens: list[int] = []
        index: dict[int, list[int]] = {}
        for piece, known in zip(pieces, whole, strict=True):
            if known >= 0:
                tokens.append(known)
                continue
            i = len(tokens)
            tokens += [of_byte[b] for b in piece]
            for a, b in zip(piece, piece[1:], strict=False):
                if (r := of_bytes[a << 8 | b]) >= 0:
                    if r in index:
                        index[r].append(i)
                    else:
                        index[r] = [i]
                i += 1
        heap = list(index)
        heapify(heap)
        while heap:
            rank = heappop(heap)
            at = index.pop(rank, None)
            if at is None:
                continue
            if len(at) > 1:
                at.sort()
            for i in at:
                a, j = tokens[i], after[i]
                if a < 0 or j < 0:
                    continue
                key = a << 20 | tokens[j]
                r = get(key)
                if (look(key) if r is None else r) != rank:
                    continue
                tokens[i], tokens[j] = rank, -1
                k = after[i] = after[j]
                if k >= 0:
                    before[k] = i
                    key = rank << 20 | tokens[k]
                    r = get(key)
                    if r is None:
                        r = look(key)
                    if r >= 0:
                        if r in index:
                            index[r].append(i)
                        else:
                            index[r] = [i]
                            heappush(heap, r)
                k = before[i]
                if k >= 0:
                    key = tokens[k] << 20 | rank
                    r = get(key)
                    if r is None:
                        r = look(key)
                    if r >= 0:
                        if r in index:
                            index[r].append(k)
                        else:
                            index[r] = [k]
                            heappush(heap, r)
        left = np.array(tokens, np.int64)
        alive = left >= 0
        edges = np.r_[0, np.cumsum(np.add.reduceat(alive, end - size, dtype=np.int64)) * 4].tolist()
        ids = left[alive].astype("<u4").tobytes()
        return [ids[a:b] for a, b in zip(edges, edges[1:], strict=False)]

    def encode(self, texts: Iterable[str], remembered: int = REMEMBERED) -> list[bytes]:
        """Of each text, its ids as little-endian unsigned 32-bit integers."""
        if len(self.known) > remembered:
            self.known = {}
        known = self.known
        split = [self.split(t) for t in texts]
        fresh = list({p for pieces in split for p in set(pieces) if p not in known})
        for piece, ids in zip(fresh, self.replay([p.encode("utf-8") for p in fresh]), strict=True):
            known[piece] = ids
        return [b"".join([known[p] for p in pieces]) for pieces in split]

    def decode(self, ids: bytes) -> bytes:
        text = self.text
        return b"".join([text[i] for i in np.frombuffer(ids, "<u4").tolist()])


@lru_cache(maxsize=4)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    """From a rank file: a line holds a token in base 64 and its rank. A worker reads it once."""
    with open(path, "rb") as f:
        return Vocabulary({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}, pattern)


def encoded(docs: DataFrame, path: str, pattern: str, texts: int = 200) -> DataFrame:
    """Every document's ids, and the bytes that these decode to: doc_id, ids binary (little-endian unsigned 32-bit), decoded binary.

    path is the rank file's place on every machine, pattern cuts a text into the pieces that merge separately. Null
    text counts as empty and has no ids. Repeated rows are each answered. Columns besides doc_id and text don't matter.
    A batch of `texts` documents shares one replay.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path, pattern)
        for batch in batches:
            for i in range(0, batch.num_rows, texts):
                part = batch.slice(i, texts)
                ids = v.encode([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array(map(v.decode, ids), pa.binary())], ["doc_id", "ids", "decoded"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lean(run), f"doc_id {kind}, ids binary, decoded binary")


def digests(docs: DataFrame, path: str, pattern: str, texts: int = 200) -> DataFrame:
    """encoded(), with counts and digests in place of the ids and bytes, which then never leave the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path, pattern)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            for i in range(0, batch.num_rows, texts):
                part = batch.slice(i, texts)
                ids = v.encode([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(map(sha, ids)), pa.array([sha(v.decode(x)) for x in ids])],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lean(run), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def tokenised(docs: DataFrame, path: str, pattern: str, texts: int = 200, remembered: int = REMEMBERED) -> DataFrame:
    """doc_id, source, n_tokens and ids (as in encoded()) of every row; raises if a text's ids don't decode to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path, pattern)
        for batch in batches:
            for i in range(0, batch.num_rows, texts):
                part = batch.slice(i, texts)
                own = [t or "" for t in part.column(2).to_pylist()]
                ids = v.encode(own, remembered)
                if any(v.decode(x) != t.encode("utf-8") for x, t in zip(ids, own, strict=True)):
                    raise ValueError("a text's ids decode to another text")
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "source", "n_tokens", "ids"])

    kinds = {c: docs.schema[c].dataType.simpleString() for c in ("doc_id", "source")}
    return docs.select("doc_id", "source", "text").mapInArrow(lean(run), f"doc_id {kinds['doc_id']}, source {kinds['source']}, n_tokens bigint, ids binary")
