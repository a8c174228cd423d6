import hashlib
import random

import pytest
from test_superkmers import brute as words_left
from test_tokengroups import brute as component_of

from parcelry.llm import mixing, pipeline
from parcelry.llm.common import kept


def corpus():
    rng = random.Random(0)
    good = [f"{a}{b}" for a in ("an", "ber", "col", "den") for b in ("dra", "go", "mis", "ta", "vel")]
    rows, labels = [], []
    for i in range(160):
        bad = i % 4 == 3
        words = [rng.choice(good) + (rng.choice(["%%%", "$$$"]) if bad else "") for _ in range(rng.randint(25, 60))]
        rows.append((i, " ".join(words), "en", f"s{i % 3}"))
        labels.append((i, 0 if bad else 1, 0))
    passage = " ".join(rng.choices(good, k=50))
    rows.append((200, rows[0][1], "en", "s1"))  # exact copy
    rows.append((201, rows[1][1] + " tail", "en", "s2"))  # near copy
    rows.append((202, passage + " " + " ".join(rng.choices(good, k=90)), "en", None))
    rows.append((203, passage + " " + " ".join(rng.choices(good, k=90)), "en", "s0"))
    rows.append((204, None, "en", "s0"))
    return [(*r, len(r[1] or "")) for r in rows], labels


def test_stages(spark, tmp_path):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    names = [n for n, _ in pipeline.STAGES]
    assert len(names) == 5
    seen = {}
    for i, (_, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if i < 4:
            assert out.schema.simpleString() == docs.schema.simpleString()
        docs = kept(out)
        rows_ = docs.collect()
        seen[i] = {r.doc_id: r for r in rows_}
        if i == 3:
            mixed = rows_
    bad = {i for i in range(160) if i % 4 == 3}
    assert not bad & set(seen[0]) and set(range(160)) - bad <= set(seen[0])
    assert {0, 1, 202, 203} <= set(seen[1]) and not {200, 201} & set(seen[1])
    assert seen[2][202].text == rows[162][1] and len(seen[2][203].text.split()) == 90 and seen[2][203].n_chars == len(seen[2][203].text)
    # brute force over what each stage got
    from parcelry.llm import subword
    from parcelry.llm.common import sample

    own = spark.read.parquet(str(tmp_path / "documents.parquet"))
    model = subword.train(*sample(own, spark.read.parquet(str(tmp_path / "labels.parquet")), "quality", subword.Settings().sample, subword.Settings().sample_bytes, subword.Settings().seed))
    assert set(seen[0]) == {d for d, t, *_ in rows if model.scores([None if t is None else t.encode()])[0] >= pipeline.QUALITY}
    texts = lambda i: [(d, r.text) for d, r in seen[i].items()]
    assert set(seen[1]) == {least for _, _, least, _ in component_of(texts(0))}
    left = {d: (n - gone, sha) for d, n, gone, sha in words_left(texts(1), 20)}
    assert set(seen[2]) == {d for d, (n, _) in left.items() if n or not seen[1][d].text}
    assert all(hashlib.sha256(" ".join((r.text or "").split()).encode()).hexdigest() == left[d][1] for d, r in seen[2].items())
    size = lambda rows, source: sum(len((r.text or "").split()) for r in rows if r.source == source)
    sources = ["s0", "s1", "s2", None]
    have = [size(seen[2].values(), s) for s in sources]
    for source, n, target in zip(sources, have, mixing.targets(have), strict=True):
        assert size(mixed, source) == pytest.approx(target, abs=max(60, 0.02 * n))
    assert set(seen[3]) <= set(seen[2])
    from collections import Counter

    from test_mixing import mixed_by_hand

    times = Counter(r.doc_id for r in mixed)
    by_hand = mixed_by_hand([(d, r.text, r.source) for d, r in seen[2].items()], mixing.Settings())
    assert {x[0]: len(shards) for x, (_, shards) in by_hand.items() if shards} == dict(times)
    assert all(len(r.ids) == 4 * r.n_tokens for r in seen[4].values())
    whole = pipeline.run(spark, str(tmp_path))
    assert sorted((r.doc_id or -1, r.n_tokens) for r in whole.collect()) == sorted((r.doc_id or -1, r.n_tokens) for r in docs.collect())
