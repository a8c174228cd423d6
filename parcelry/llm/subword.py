"""Quality classifier: supervised subword embeddings.

A text's features are its words, the character n-grams of every "<word>", and its pairs of neighbouring words, each hashed
to a row of one table of vectors. A document is the mean of its features' vectors; a softmax over the two classes reads it.
Vectors and output weights are learnt together by stochastic gradient descent in numpy, on a bounded sample of labelled
rows. Scoring is linear up to the softmax, so what a word and its n-grams add to the class margin is one number, worked
out once per distinct word of a batch, and a pair's is a look into the table.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from parcelry.llm.common import ODD, U64, binaries, hashes, held_out, lean, mixed, sample, words

#: Texts that are scored together.
TEXTS = 500
#: Characters of words whose n-grams are hashed together: a bound of memory only.
SLICE = 1 << 18


@dataclass(frozen=True)
class Settings:
    #: Most labelled rows that are learnt from, the first by a hash of their id.
    sample: int = 4_000
    #: Most bytes of the sample's texts: a bound of the driver's memory.
    sample_bytes: int = 14_000_000
    rows: int = 1 << 16
    dim: int = 8
    shortest: int = 2
    longest: int = 4
    epochs: int = 6
    batch: int = 32
    rate: float = 0.5
    seed: int = 1


def features(own: list[bytes], s: Settings) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The table rows of words and of the n-grams of all their characters between < and >, and which word each is of, in parts of about SLICE characters."""
    yield (mixed(hashes(own)) & U64(s.rows - 1)).astype(np.int64), np.arange(len(own))
    text = [w.decode("utf-8", "replace") for w in own]
    ends = np.cumsum(np.fromiter(map(len, text), np.int64, len(text)) + 2)
    total = int(ends[-1]) if len(ends) else 0
    data = np.frombuffer(("<" + "><".join(text) + ">" + "\0" * s.longest).encode("utf-32-le", "surrogatepass"), np.uint32)
    for at in range(0, total, SLICE):
        m = min(SLICE, total - at)
        part = data[at : at + m + s.longest].astype(np.uint64)
        place = np.arange(at, at + m)
        of = np.searchsorted(ends, place, side="right")
        left = ends[of] - place  # characters from here to the word's end
        for n in range(s.shortest, s.longest + 1):
            h = np.full(m, ODD[n], U64)
            for j in range(n):
                h += part[j : j + m] * ODD[8 * n + j]
            on = left >= n
            yield (mixed(h[on]) & U64(s.rows - 1)).astype(np.int64), of[on]


def pairs(h: np.ndarray, doc: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """The table rows of neighbouring words (hashes h, of the texts doc), and which text each pair is of. Pairs of a word with itself share one row."""
    same = doc[1:] == doc[:-1]
    again = h[1:] == h[:-1]
    rows = (mixed(np.where(again, U64(1), h[:-1] * ODD[50] + h[1:] * ODD[51])) & U64(s.rows - 1)).astype(np.int64)
    return rows[same], doc[1:][same]


def grouped(own: list[bytes]) -> Iterator[list[bytes]]:
    """The words in lists of SLICE bytes at most; a longer word is by itself."""
    group: list[bytes] = []
    room = SLICE
    for w in own:
        if group and len(w) + 2 > room:
            yield group
            group, room = [], SLICE
        group.append(w)
        room -= len(w) + 2
    if group:
        yield group


class Model:
    """The margin (log odds of class 1 against 0) of each table row, and the bias."""

    def __init__(self, margin: np.ndarray, bias: float, s: Settings):
        self.margin, self.bias, self.s = margin, bias, s

    def parts(self, own: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Of each word the sum of its features' margins, and how many they are."""
        sums, n = np.zeros(len(own)), np.zeros(len(own))
        for rows, of in features(own, self.s):
            sums += np.bincount(of, self.margin[rows], len(own))
            n += np.bincount(of, minlength=len(own))
        return sums, n

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        """P(class 1) of each text; a word's part is worked out once for all of them."""
        split = [words(t) for t in texts]
        place: dict[bytes, int] = {}
        at = np.fromiter((place.setdefault(w, len(place)) for x in split for w in x), np.int64)
        z = np.full(len(texts), self.bias)
        if len(at):
            own = list(place)
            sums, n = (np.concatenate(x) for x in zip(*map(self.parts, grouped(own)), strict=True))
            doc = np.repeat(np.arange(len(split)), [len(x) for x in split])
            rows, of = pairs(hashes(own)[at], doc, self.s)
            count = np.bincount(doc, n[at], len(texts)) + np.bincount(of, minlength=len(texts))
            total = np.bincount(doc, sums[at], len(texts)) + np.bincount(of, self.margin[rows], len(texts))
            z += total / np.maximum(count, 1)
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def train(texts: list[bytes], labels: list[int], s: Settings = Settings()) -> Model:
    """By gradient descent over shuffled batches, the rate falling to 0. With one class only, its share is the score."""
    rng = np.random.default_rng(s.seed)
    y = np.array(labels, np.int64)
    share = (y.sum() + 1) / (len(y) + 2)
    bias = np.array([0.0, np.log(share / (1 - share))])
    if len(set(labels)) < 2:
        return Model(np.zeros(s.rows), float(bias[1]), s)
    ids, weights = [], []
    for t in texts:
        own = words(t)
        count = Counter(own)
        often = np.fromiter(count.values(), np.float64, len(count))
        c = np.zeros(s.rows)
        for rows, of in features(list(count), s) if own else ():
            c += np.bincount(rows, often[of], s.rows)
        if own:
            rows, _ = pairs(hashes(own), np.zeros(len(own), np.int64), s)
            c += np.bincount(rows, minlength=s.rows)
        i = np.flatnonzero(c)
        c = c[i]
        ids.append(i.astype(np.int32))
        weights.append((c / max(1.0, float(c.sum()))).astype(np.float32))
    vectors = rng.normal(0, 0.1, (s.rows, s.dim)).astype(np.float32)
    out = rng.normal(0, 0.1, (2, s.dim)).astype(np.float32)
    order, total, done = np.arange(len(y)), s.epochs * len(y), 0
    for _ in range(s.epochs):
        rng.shuffle(order)
        for b in range(0, len(order), s.batch):
            take = order[b : b + s.batch]
            rate = s.rate * (1 - done / total)
            n = np.array([len(ids[j]) for j in take])
            flat, w = np.concatenate([ids[j] for j in take]), np.concatenate([weights[j] for j in take])
            at = np.repeat(np.arange(len(take)), n)
            own = vectors[flat] * w[:, None]
            hidden = np.stack([np.bincount(at, own[:, d], len(take)) for d in range(s.dim)], axis=1)
            z = hidden @ out.T + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(take)), y[take]] -= 1
            back = (p @ out).astype(np.float32)
            out -= (rate * p.T @ hidden).astype(np.float32)
            bias -= rate * p.mean(axis=0)
            # a mean's features each get a small part of the gradient; the weights' size makes up for it
            np.add.at(vectors, flat, -(rate * 20.0) * back[at] * w[:, None])
            done += len(take)
    return Model(vectors.astype(np.float64) @ (out[1] - out[0]).astype(np.float64), float(bias[1] - bias[0]), s)


def learnt(docs: DataFrame, labels: DataFrame, label: str, s: Settings = Settings()) -> Model:
    """A model from labelled rows outside the held-out fold. Null labels and texts are not learnt from."""
    return train(*sample(docs, labels, label, s.sample, s.sample_bytes, s.seed), s)


def scored(docs: DataFrame, model: Model, threshold: float) -> DataFrame:
    """doc_id, held_out, score (of class 1) and predicted (1 from the threshold on) of every row.

    Texts without words, null ones too, get the bias's score. Very long texts and words are scored whole; repeated rows
    are scored each for itself, and equal texts alike; a score at the threshold is predicted 1; no rows give no rows. Other
    columns of docs, labels among them, aren't looked at.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.margin.astype(np.float32), model.bias, model.s))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        margin, bias, s = sent.value
        own = Model(margin.astype(np.float64), bias, s)
        for batch in batches:
            texts = binaries(batch.column(2))
            score = np.concatenate([own.scores(texts[i : i + TEXTS]) for i in range(0, len(texts), TEXTS)] or [np.empty(0)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(lean(run), f"doc_id {kind}, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, model: Model, threshold: float) -> DataFrame:
    """The rows of docs that score at least the threshold (see scored), unchanged: all their columns, whatever their names, and repeated rows as often as they are there."""
    sent = docs.sparkSession.sparkContext.broadcast((model.margin.astype(np.float32), model.bias, model.s))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        margin, bias, s = sent.value
        own = Model(margin.astype(np.float64), bias, s)
        for batch in batches:
            for i in range(0, batch.num_rows, TEXTS):
                part = batch.slice(i, TEXTS)
                yield part.filter(pa.array(own.scores(binaries(part.column(at))) >= threshold))

    return docs.mapInArrow(lean(run), docs.schema)
