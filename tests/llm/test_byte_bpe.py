import hashlib
import random
from functools import lru_cache

import numpy as np
import public_tokenizers as P
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parcelry.llm.byte_bpe import digests, encoded, vocabulary

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@lru_cache
def reference():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=vocabulary(PATH, P.PATTERN).ranks, special_tokens={})


def ids_of(texts):
    return [np.frombuffer(x, "<u4").tolist() for x in vocabulary(PATH, P.PATTERN).encode(texts)]


@given(st.lists(st.text(max_size=60), max_size=8))
@settings(max_examples=300, deadline=None)
def test_any_text(texts):
    assert ids_of(texts) == [reference().encode_ordinary(t) for t in texts]


def test_marks_and_long_runs():
    rng = random.Random(1)
    alphabet = list("ab \n\t\x1c\x85  'sté漢字12½٣!?-_\U0001f600힣")
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 30))) for _ in range(3000)] + ["a" * 20000, "!" * 9000, " " * 5000, "<|endoftext|>", "it'll they're"]
    assert ids_of(texts) == [reference().encode_ordinary(t) for t in texts]


def test_frames(spark):
    rows = [(1, "Hello wörld"), (2, None), (3, ""), (1, "Hello wörld"), (None, "x y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in digests(docs, PATH, P.PATTERN).collect())
    want = []
    for d, t in rows:
        ids = reference().encode_ordinary(t or "")
        want.append((d or 0, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)
    assert {(r.doc_id, bytes(r.decoded)) for r in encoded(docs, PATH, P.PATTERN).collect()} == {(d, (t or "").encode()) for d, t in rows}
    assert digests(docs.limit(0), PATH, P.PATTERN).count() == 0


def test_tokenised_names_long_empty_and_repeated(spark):
    from parcelry.llm.byte_bpe import tokenised

    rows = [(1, "s", "Hello wörld", "m"), (1, "s", "Hello wörld", "m"), (2, None, None, "m"), (3, "t", "", "m"), (4, "t", "ab " * 50000, "m")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, n_tokens string")
    got = tokenised(docs, PATH, P.PATTERN).collect()
    assert sorted((r.doc_id, r.source or "", np.frombuffer(bytes(r.ids), "<u4").tolist()) for r in got) == sorted((d, s or "", reference().encode_ordinary(t or "")) for d, s, t, _ in rows)
    assert all(r.n_tokens * 4 == len(r.ids) for r in got)
    assert tokenised(docs.limit(0), PATH, P.PATTERN).count() == 0
