"""From raw documents to encoded training text, in five stages; each works on all that the stage before it kept.

run(spark, sf_dir) applies STAGES to the documents of sf_dir. Between two stages the documents are written as Parquet to
the shared folder and read back, so that no stage is computed twice and a lost executor costs no more than its tasks.
Nulls, empty and long texts, repeated rows, empty tables and names of columns are dealt with as each operator says; a
stage looks at the columns of documents only, and all but the last return these.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from parcelry.llm import byte_bpe, mixing, subword, superkmers, tokengroups
from parcelry.llm.common import forget, kept, small_batches, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document whose score is below this goes.
QUALITY = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, unchanged. It is learnt from the labels of documents in `docs`."""
    model = subword.learnt(docs, table(spark, sf_dir, "labels"), "quality")
    return subword.accepted(docs.select(COLUMNS), model, QUALITY)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest doc_id. Documents without words are no duplicates."""
    small_batches(spark)
    return tokengroups.deduplicated(docs.select(COLUMNS))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 20 words or more that came before; a document of which nothing is left goes."""
    small_batches(spark)
    return superkmers.cleaned(docs.select(COLUMNS))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, each as often as the mix of sources takes it."""
    small_batches(spark)
    return mixing.mixed(docs.select(COLUMNS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is trained on: doc_id, source, the token ids, and how many they are. Text that the ids don't decode to raises."""
    small_batches(spark)
    return byte_bpe.tokenised(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, remembered=200_000)


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_duplicates), ("substring dedup", substrings), ("mixing sources to target weights", mixture), ("byte-level BPE encoding and decoding", encode)]

#: Learnt scores and hash-drawn mixes have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            out = kept(out)
            if i:
                forget(docs)
        docs = out
    return docs
