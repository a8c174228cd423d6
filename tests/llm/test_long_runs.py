"""Texts without spaces: what stands far into a run counts too, in learning and in scoring."""

import random

import numpy as np

from parcelry.llm import subword, weak


def runs(n, seed, term, joint):
    """Runs of 40 to 80 neutral words, of every third text with the term at a place beyond byte 64; every text begins alike."""
    rng = random.Random(seed)
    neutral = [a + b for a in ("an", "ber", "col", "den", "fi") for b in ("dra", "go", "mis", "ta", "vel", "wu")]
    out = []
    for i in range(n):
        w = ["opening"] * 10 + rng.choices(neutral, k=rng.randint(40, 80))
        if i % 3 == 0:
            w.insert(rng.randrange(12, len(w)), term)
        out.append((joint.join(w).encode(), int(i % 3 == 0)))
    return out


def apart(scores, rows):
    y = np.array([y for _, y in rows])
    return ((np.array(scores) >= 0.5) == y).mean()


def test_toxicity_in_long_runs():
    spaced = weak.train(*map(list, zip(*runs(600, 1, "grubsnout", " "), strict=True)))
    for joint in ("...", ""):
        rows = runs(150, 2, "grubsnout", joint)
        own = weak.train(*map(list, zip(*runs(600, 1, "grubsnout", joint), strict=True)))
        for model in (spaced, own):
            assert apart([model.score(t) for t, _ in rows], rows) > 0.97


def test_quality_in_long_runs():
    rows = runs(600, 1, "%%%$$$%%%" * 3, "")
    model = subword.train(*map(list, zip(*rows, strict=True)))
    held = runs(150, 2, "%%%$$$%%%" * 3, "")
    assert apart(model.scores([t for t, _ in held]), held) > 0.97


def test_all_ngrams_of_long_words(monkeypatch):
    """Every byte of a word is in n-grams, in whatever slices they are hashed."""
    own = [b"ab", b"x" * 5 + bytes(range(97, 123)) * 40, b"y"]
    s = subword.Settings()
    model = subword.Model(np.random.default_rng(0).normal(size=s.rows), 0.0, s)
    want = model.parts(own)
    assert want[1].tolist() == [1 + sum(max(0, len(w) + 2 - n + 1) for n in range(s.shortest, s.longest + 1)) for w in own]
    monkeypatch.setattr(subword, "SLICE", 7)
    assert np.allclose(np.stack(model.parts(own)), np.stack(want)) and len(list(subword.grouped(own))) == 3
