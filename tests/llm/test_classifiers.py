import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelry.llm import subword, weak
from parcelry.llm.common import held_out

WORDS = [a + b for a in ("an", "ber", "col", "den", "éf") for b in ("dra", "go", "mis", "ta", "vel", "wu")]


def texts(n, seed):
    rng = random.Random(seed)
    return rng, [" ".join(rng.choices(WORDS, k=rng.randint(20, 60))) for _ in range(n)]


def quality(n, seed):
    """Clean texts, junk at the ends of words, and words repeated over and over."""
    rng, good = texts(n, seed)
    rows = []
    for i, t in enumerate(good):
        kind = i % 5
        if kind == 3:
            t = " ".join(w + rng.choice(["%%%", "$$$"]) for w in t.split())
        if kind == 4:
            t = " ".join(w for w in t.split()[:4] for _ in range(12))
        rows.append((t, int(kind < 3)))
    return rows


def toxic(n, seed):
    rng, good = texts(n, seed)
    rows = []
    for i, t in enumerate(good):
        w = t.split()
        if i % 4 == 0:
            bad = rng.choice([["grubsnout"], ["Mudhead,"], ["zonk" + rng.choice(WORDS)]])
            w[rng.randrange(len(w)) : 0] = bad
        rows.append((" ".join(w), int(i % 4 == 0)))
    return rows


@pytest.mark.parametrize("module,make,scores", [(subword, quality, lambda m, x: m.scores(x)), (weak, toxic, lambda m, x: np.array([m.score(t) for t in x]))])
def test_held_out_accuracy(module, make, scores):
    train, test = make(800, 1), make(200, 2)
    model = module.train([t.encode() for t, _ in train], [y for _, y in train])
    s = scores(model, [t.encode() for t, _ in test])
    y = np.array([y for _, y in test])
    assert s[y == 1].min() > s[y == 0].max()
    assert ((s >= 0.5) == y).mean() > 0.97


def test_label_model():
    rng = np.random.default_rng(0)
    y = rng.random(2000) < 0.3
    votes = np.stack([rng.random(2000) < np.where(y, a, b) for a, b in ((0.6, 0.01), (0.5, 0.02), (0.4, 0.01), (0.1, 0.1))], axis=1).astype(float)
    votes = np.c_[votes, votes[:, 0], ~votes[:, :3].any(axis=1)]
    m = weak.fit(votes, 0.3, np.array([True, True, True, False, False, False]), 60)
    twin, first = (4, 0) if m.parent[4] == 0 else (0, 4)
    assert m.parent[twin] == first  # the copied voter hangs on the one it copies, and adds nothing to it
    assert abs(m.fire[1][1][twin] - m.fire[0][1][twin]) < 0.05 and m.fire[1][1][twin] > 0.95
    other = [i for i in (1, 2) if m.parent[i] < 0]
    assert all(abs(m.fire[1][0][i] - (0.5, 0.4)[i - 1]) < 0.1 and m.fire[0][0][i] < 0.06 for i in other)
    p = m.posterior(votes)
    assert ((p > 0.5) == y)[votes[:, :3].any(axis=1)].mean() > 0.9


@pytest.mark.parametrize("module,label", [(subword, "quality"), (weak, "toxic")])
def test_frames(spark, module, label):
    rows = [(i, t, y) for i, (t, y) in enumerate(quality(300, 3) if label == "quality" else toxic(300, 3))]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, ""), (902, "word " * 30000), (0, rows[0][1]), (None, "x")], "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(5000, None), (None, 1), (900, 1)], f"doc_id long, {label} int").withColumn("text", F.lit("clash"))
    model = module.learnt(docs, labels, label)
    out = module.scored(docs, model, 0.3).collect()
    assert len(out) == 305 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    got = {r.doc_id: r for r in out}
    import zlib

    assert all(r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0) for r in out)
    right = [got[i].predicted == y for i, _, y in rows if got[i].held_out]
    assert np.mean(right) > 0.85
    # labels of the held-out fold change nothing
    flipped = labels.withColumn(label, F.when(held_out(), 1 - F.col(label)).otherwise(F.col(label)))
    again = module.scored(docs, module.learnt(docs, flipped, label), 0.3)
    assert {(r.doc_id, r.score) for r in again.collect()} == {(r.doc_id, r.score) for r in out}
    # nothing to learn from
    none = module.scored(docs, module.learnt(docs, labels.limit(0), label), 0.3).collect()
    assert len(none) == 305 and len({r.score for r in none}) == 1
    assert module.scored(docs.limit(0), model, 0.3).count() == 0


def test_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i, "x" * 100) for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    from parcelry.llm.common import sample

    assert len(sample(docs, labels, "quality", 50, 10**9, 1)[0]) == 50
    assert len(sample(docs, labels, "quality", 50, 1050, 1)[0]) == 10
    assert len(sample(docs, labels, "quality", 50, 10, 1)[0]) == 1


def test_scores_as_brute_force():
    """The margin of a text by hand: every feature of every word and pair, one after the other."""
    import xxhash

    from parcelry.llm.common import ODD

    M = 2**64 - 1

    def mixed(x):
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & M
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & M
        return x ^ (x >> 31)

    rows = quality(200, 5)
    model = subword.train([t.encode() for t, _ in rows], [y for _, y in rows], subword.Settings(epochs=2))
    s = model.s
    odd = [int(x) for x in ODD]

    def score(text):
        own = text.split()
        found = []
        for w in own:
            found.append(mixed(xxhash.xxh3_64_intdigest(w.encode())))
            c = [ord(x) for x in f"<{w}>"]
            for n in range(s.shortest, s.longest + 1):
                for i in range(len(c) - n + 1):
                    found.append(mixed((odd[n] + sum(c[i + j] * odd[8 * n + j] for j in range(n))) & M))
        h = [xxhash.xxh3_64_intdigest(w.encode()) for w in own]
        found += [mixed(1 if a == b else (a * odd[50] + b * odd[51]) & M) for a, b in zip(h, h[1:], strict=False)]
        margin = sum(model.margin[x % s.rows] for x in found) / len(found) if found else 0.0
        return 1 / (1 + np.exp(-(model.bias + margin)))

    cases = [t for t, _ in quality(25, 6)] + ["", "é", "a a", "ñandú 日本語 日本語"]
    assert np.allclose(model.scores([t.encode() for t in cases]), [score(t) for t in cases])
    # without the pairs the scores are others
    flat = subword.Model(model.margin.copy(), model.bias, s)
    flat.margin[mixed(1) % s.rows] = 0
    assert not np.allclose(flat.scores([b"x x x"]), model.scores([b"x x x"]))


def test_toxicity_as_brute_force():
    """The classifier's score by hand: the weights of all distinct entries that a text shows."""
    rows = toxic(400, 1)
    model = weak.train([t.encode() for t, _ in rows], [y for _, y in rows])
    for t, _ in toxic(40, 2):
        shown = {e for w in t.encode().split() for e in weak.entries(w, model.s)}
        z = model.bias + sum(model.weight.get(e, 0.0) for e in shown)
        assert model.score(t.encode()) == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-12)
    # the label model alone, without the classifier, tells the same texts apart
    assert len(model.voters) > 3 and model.labels.parent.shape == (len(model.voters),)


def test_accepted_keeps_columns(spark):
    rows = quality(200, 7)
    model = subword.train([t.encode() for t, _ in rows], [y for _, y in rows])
    docs = spark.createDataFrame([(1, rows[0][0], "x")] * 2 + [(2, rows[4][0], "y"), (3, None, "z"), (4, "long " * 50000, "w")], "doc_id long, text string, score string")
    want = [r for r in docs.collect() if model.scores([None if r.text is None else r.text.encode()])[0] >= 0.3]
    out = subword.accepted(docs, model, 0.3)
    assert out.columns == docs.columns and sorted(map(str, out.collect())) == sorted(map(str, want)) and sum(r.doc_id == 1 for r in want) == 2
    assert subword.accepted(docs.limit(0), model, 0.3).count() == 0
