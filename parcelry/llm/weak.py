"""Toxicity by weak supervision.

Many voters look at a text: lexicon voters (a word, or the beginning of words), pattern voters, and one that fires where
no entry of the lexicon shows. A voter that doesn't fire abstains, so it says nothing about texts in a language that it
doesn't know. A generative label model, fitted by expectation maximisation, says how often each voter fires on either class
and how that hangs on one other voter, its parent in a tree of dependencies: what two voters see together counts once. Its
posterior labels train and calibrate the classifier, a logistic regression on words and beginnings of words.

Labels of the sample serve to find the lexicon entries that become voters, as no list knows an unknown language's words,
and give the class balance. The label model and the classifier see votes and posteriors only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from parcelry.llm.common import binaries, held_out, lean, sample, words

#: Distinct words whose features a worker remembers; beyond, it starts over. A matter of speed only.
REMEMBERED = 200_000
EDGES = bytes(range(33, 48)) + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 127))
#: Makes EDGES spaces.
SPACED = bytes.maketrans(EDGES, b" " * len(EDGES))
#: A run of more bytes between spaces is taken for several words.
LONG = 64

#: Pattern voters; each votes toxic where it matches a lower-cased text.
PATTERNS = {
    "address": rb"\byou(?:'re| are| absolute| complete)? (?:an? |such an? )?\w+",
    "shouting": rb"!{2,}",
    "threat": rb"\b(?:shut up|go away|get lost|hate you|kill)\b",
    "masked": rb"\b\w+\*{2,}\w*",
}


@dataclass(frozen=True)
class Settings:
    #: Most labelled rows that are learnt from, the first by a hash of their id, and most bytes of their texts.
    sample: int = 5_000
    sample_bytes: int = 16_000_000
    voters: int = 60
    features: int = 2_048
    #: Standard deviations by which an entry's posterior labels must exceed chance for the classifier to use it.
    surprise: float = 5.0
    #: An entry must be in so many labelled texts.
    least: int = 3
    shortest: int = 4
    longest: int = 6
    rounds: int = 40
    seed: int = 2


def entries(word: bytes, s: Settings) -> Iterator[bytes]:
    """What a word shows to the voters and the classifier: itself without edges, and its beginnings (marked by a final -).

    A run of more than LONG bytes may hold many words. Each of its pieces between EDGES shows the same; a piece that is
    still longer, of a script without spaces or packed, shows from each of its characters on what a word that begins
    there would: itself, were it of shortest to longest bytes, and its beginnings. Entries may repeat.
    """
    w = word.lower().strip(EDGES)
    if w:
        yield w
        yield from (w[:n] + b"-" for n in range(s.shortest, s.longest + 1) if len(w) > n)
    if len(w) <= LONG:
        return
    for piece in w.translate(SPACED).split():
        yield piece
        inner = len(piece) if len(piece) > LONG else 1
        for i in range(inner):
            if piece[i] & 0xC0 != 0x80:
                for n in range(s.shortest, s.longest + 1):
                    if len(piece) - i > n:
                        yield piece[i : i + n] + b"-"
                    if inner > 1 and len(piece) - i >= n:
                        yield piece[i : i + n]


class Shown:
    """Which entries each text shows; only entries that `least` texts show are kept, as numbers."""

    def __init__(self, texts: list[bytes], s: Settings):
        known: dict[bytes, list[int]] = {}
        rows = []
        for t in texts:
            own: set[int] = set()
            runs: list[np.ndarray] = []
            for w in set(words(t)):
                if len(w) > LONG:  # as an array, and not remembered: a run may be as long as its text
                    runs.append(np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, entries(w, s)), np.uint64)))
                    continue
                got = known.get(w)
                if got is None:
                    got = known[w] = [xxhash.xxh3_64_intdigest(e) for e in entries(w, s)]
                own.update(got)
            rows.append(np.unique(np.concatenate([np.fromiter(own, np.uint64, len(own)), *runs])))
            if len(known) > 50_000:
                known.clear()
        key, n = np.unique(np.concatenate(rows), return_counts=True)
        self.key, self.n_texts, self.s = key[n >= s.least], len(texts), s
        for i, row in enumerate(rows):
            rows[i] = np.flatnonzero(np.isin(self.key, row, assume_unique=True)).astype(np.int32)
        self.rows = rows
        self.at, self.flat = np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate(rows)

    def sums(self, weight: np.ndarray) -> np.ndarray:
        """Of each entry, the weights of the texts that show it."""
        return np.bincount(self.flat, weight[self.at], len(self.key))

    def names(self, texts: list[bytes], chosen: np.ndarray) -> dict[int, bytes]:
        want = {int(self.key[i]): int(i) for i in chosen}
        out: dict[int, bytes] = {}
        for t in texts:
            if len(out) == len(want):
                break
            for w in set(words(t)):
                for e in entries(w, self.s):
                    if (i := want.get(xxhash.xxh3_64_intdigest(e))) is not None:
                        out[i] = e
        return out


def mined(shown: Shown, y: np.ndarray) -> np.ndarray:
    """Lexicon voters: the entries that most set class 1 apart, one at a time, leaving out those whose texts of class 1 others explain twice already."""
    s = shown.s
    one, zero = shown.sums(y.astype(float)), shown.sums(1.0 - y)
    n1, n0 = max(1, int(y.sum())), max(1, int(len(y) - y.sum()))
    ratio = np.log((one + 0.1) / n1) - np.log((zero + 0.1) / n0)
    good = np.flatnonzero((one >= s.least) & (ratio > 1.5))
    good = good[np.lexsort((shown.key[good], -ratio[good] * np.sqrt(one[good])))]
    hit = np.isin(shown.flat, good) & (y[shown.at] == 1)
    where: dict[int, list[int]] = {int(e): [] for e in good}
    for e, i in zip(shown.flat[hit].tolist(), shown.at[hit].tolist(), strict=True):
        where[e].append(i)
    seen, out = np.zeros(len(y), np.int64), []
    for e, at in where.items():
        if (seen[at] < 2).sum() >= s.least and len(out) < s.voters:
            out.append(e)
            seen[at] += 1
    return np.array(out, np.int64)


@dataclass
class LabelModel:
    """A tree of voters: P(class 1), each voter's parent (-1: none), and P(fire | class, whether the parent fires).

    A voter's accuracy is how its chances differ between the classes; the correlation of two voters given the class is
    how the chances of one differ with the other's vote.
    """

    prior: float
    parent: np.ndarray
    #: class, parent's vote, voter.
    fire: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(class 1) of each row of votes (rows by voters, 1 where a voter fires; one that doesn't abstains)."""
        ratio = np.log(self.fire[1]) - np.log(self.fire[0])
        up = self._up(votes)
        llr = (votes * (ratio[0] + up * (ratio[1] - ratio[0]))).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(llr + np.log(self.prior / (1 - self.prior)), -500, 500)))

    def _up(self, votes: np.ndarray) -> np.ndarray:
        """The parents' votes, 0 for none."""
        return np.where(self.parent >= 0, votes[:, np.maximum(self.parent, 0)], 0.0)


def dependencies(votes: np.ndarray, p: np.ndarray, least: float) -> np.ndarray:
    """Each voter's parent in the forest of most mutual information given the class, of edges that the data show (nats of all rows)."""
    n, m = votes.shape
    info = np.zeros((m, m))
    for r in (1 - p, p):
        total = r.sum() + 1e-9
        both = (votes * r[:, None]).T @ votes / total
        one = np.clip(np.diag(both), 1e-9, 1 - 1e-9)
        a, b = one[:, None], one[None, :]
        for joint, x, y in ((both, a, b), (a - both, a, 1 - b), (b - both, 1 - a, b), (1 - a - b + both, 1 - a, 1 - b)):
            q = np.clip(joint, 1e-12, 1)
            info += total * q * np.log(q / (x * y))
    parent, root = np.full(m, -1), list(range(m))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    near: dict[int, list[int]] = {i: [] for i in range(m)}
    edges = [(info[i, j], i, j) for i in range(m) for j in range(i) if info[i, j] >= least]
    for _, i, j in sorted(edges, reverse=True):
        x, y = find(i), find(j)
        if x != y:
            root[x] = y
            near[i].append(j)
            near[j].append(i)
    seen: set[int] = set()
    for start in range(m):
        todo = [start] if start not in seen else []
        seen.update(todo)
        while todo:
            i = todo.pop()
            for j in near[i]:
                if j not in seen:
                    seen.add(j)
                    parent[j] = i
                    todo.append(j)
    return parent


def fit(votes: np.ndarray, prior: float, trusted: np.ndarray, rounds: int, alone: int = 1, least: float = 8.0) -> LabelModel:
    """By expectation maximisation. The class balance (prior) is given and held, no other label is seen. It starts from: a text on which any trusted voter fires is of class 1. The tree of dependencies is found anew every ten rounds; the last `alone` voters, which only say that no other fires, aren't in it."""
    m = votes.shape[1]
    p = np.where(votes[:, trusted].any(axis=1) if trusted.any() else votes.any(axis=1), 0.9, 0.05)
    model = LabelModel(float(np.clip(prior, 0.01, 0.99)), np.full(m, -1), np.full((2, 2, m), 0.5))
    for step in range(rounds):
        if step % 10 == 5:
            model.parent[: m - alone] = dependencies(votes[:, : m - alone], p, least)
        up = model._up(votes)
        for c, r in enumerate((1 - p, p)):
            for v, on in enumerate((1 - up, up)):
                of = on * r[:, None]
                base = ((on * votes).sum(axis=0) + 0.05) / (on.sum(axis=0) + 1)  # of both classes: what few rows say leans on it
                model.fire[c, v] = np.clip(((of * votes).sum(axis=0) + base) / (of.sum(axis=0) + 1), 1e-4, 1 - 1e-4)
        new = model.posterior(votes)
        if step > 5 and np.abs(new - p).max() < 1e-6:
            break
        p = new
    return model


@dataclass
class Classifier:
    weight: dict[bytes, float]
    bias: float
    s: Settings
    labels: LabelModel | None = None
    voters: tuple = ()

    def __post_init__(self):
        self.known: dict[bytes, list[bytes]] = {}

    def score(self, text: bytes | None) -> float:
        known, weight = self.known, self.weight
        hit: set[bytes] = set()
        for w in set(words(text)):
            if len(w) > LONG:
                hit.update(e for e in entries(w, self.s) if e in weight)
                continue
            got = known.get(w)
            if got is None:
                got = known[w] = [e for e in entries(w, self.s) if e in weight]
            if got:
                hit.update(got)
        if len(known) > REMEMBERED:
            known.clear()
        return float(1 / (1 + np.exp(-np.clip(self.bias + sum(map(weight.__getitem__, sorted(hit))), -500, 500))))


def votes_of(texts: list[bytes], shown: Shown, lexicon: np.ndarray) -> np.ndarray:
    """A row for each text: the lexicon voters, the patterns, and silence."""
    patterns = [regex.compile(p) for p in PATTERNS.values()]
    out = np.zeros((len(texts), len(lexicon) + len(patterns) + 1))
    for i, (t, own) in enumerate(zip(texts, shown.rows, strict=True)):
        out[i, : len(lexicon)] = np.isin(lexicon, own)
        low = t.lower()
        out[i, len(lexicon) : -1] = [bool(p.search(low)) for p in patterns]
    out[:, -1] = ~out[:, : len(lexicon)].any(axis=1)
    return out


def train(texts: list[bytes], labels: list[int], s: Settings = Settings()) -> Classifier:
    """With one class only, or nothing that sets the classes apart, every text gets class 1's share."""
    y = np.array(labels, np.int64)
    share = (y.sum() + 1) / (len(y) + 2)
    flat = Classifier({}, float(np.log(share / (1 - share))), s)
    if len(set(labels)) < 2:
        return flat
    shown = Shown(texts, s)
    lexicon = mined(shown, y)
    if not len(lexicon):
        return flat
    votes = votes_of(texts, shown, lexicon)
    model = fit(votes, share, np.r_[np.ones(len(lexicon), bool), np.zeros(len(PATTERNS) + 1, bool)], s.rounds)
    p = model.posterior(votes)

    # the classifier's entries: those whose presence moves the posterior most
    n = shown.sums(np.ones(len(y)))
    gain = (shown.sums(p) - n * p.mean()) / np.sqrt(n * p.mean() * (1 - p.mean()) + 1e-9)
    chosen = np.flatnonzero(gain >= s.surprise)
    chosen = chosen[np.lexsort((shown.key[chosen], -gain[chosen]))][: s.features]
    if not len(chosen):
        return flat
    place = np.full(len(shown.key), -1)
    place[chosen] = np.arange(len(chosen))
    on = place[shown.flat] >= 0
    at, flat_ids = shown.at[on], place[shown.flat[on]]
    w, b = np.zeros(len(chosen)), flat.bias
    size, speed = np.zeros(len(chosen)) + 1e-8, 1e-8
    for _ in range(600):  # full gradient with a step for each weight
        z = np.bincount(at, w[flat_ids], len(y)) + b
        back = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - p
        g = np.bincount(flat_ids, back[at], len(chosen)) / len(y) + 1e-6 * w
        size += g * g
        speed += back.mean() ** 2
        w -= 1.0 * g / np.sqrt(size)
        b -= 1.0 * back.mean() / np.sqrt(speed)
    w = np.where(np.abs(w) > 0.05, w, 0.0)
    scale, shift = calibrated(np.bincount(at, w[flat_ids], len(y)) + b, p)
    names = shown.names(texts, np.r_[chosen, lexicon])
    keep = {names[e]: float(scale * w[i]) for i, e in enumerate(chosen.tolist()) if w[i]}
    return Classifier(keep, float(scale * b + shift), s, model, (*(names[e] for e in lexicon.tolist()), *PATTERNS, "silence"))


def calibrated(z: np.ndarray, t: np.ndarray) -> tuple[float, float]:
    """Scale and shift of a classifier's log odds z that fit the posterior labels t best."""
    x = np.stack([z, np.ones(len(z))], axis=1)
    v = np.array([1.0, 0.0])
    loss = lambda v: float(np.sum(np.logaddexp(0, x @ v) - t * (x @ v)) + 1e-3 * (v[0] - 1) ** 2)
    for _ in range(50):  # Newton's method with step halving
        p = 1 / (1 + np.exp(-np.clip(x @ v, -500, 500)))
        g = x.T @ (p - t) + np.array([2e-3 * (v[0] - 1), 0])
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag([2e-3, 1e-6])
        step, now = np.linalg.solve(h, g), loss(v)
        while loss(v - step) > now and np.abs(step).max() > 1e-9:
            step /= 2
        v = v - step
        if np.abs(step).max() < 1e-7:
            break
    return (float(v[0]), float(v[1])) if v[0] > 0 else (1.0, 0.0)


def learnt(docs: DataFrame, labels: DataFrame, label: str, s: Settings = Settings()) -> Classifier:
    """A classifier from labelled rows outside the held-out fold. Null labels and texts are not learnt from."""
    return train(*sample(docs, labels, label, s.sample, s.sample_bytes, s.seed), s)


def scored(docs: DataFrame, model: Classifier, threshold: float) -> DataFrame:
    """doc_id, held_out, score (of class 1) and predicted (1 from the threshold on) of every row.

    Texts without words, null ones too, get the bias's score. Very long texts are scored whole; repeated rows are scored
    each for itself, and equal texts alike; a score at the threshold is predicted 1; no rows give no rows. Other columns of
    docs, labels among them, aren't looked at.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.weight, model.bias, model.s))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Classifier(*sent.value)
        for batch in batches:
            score = np.array([own.score(t) for t in binaries(batch.column(2))], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(lean(run), f"doc_id {kind}, held_out boolean, score double, predicted int")
