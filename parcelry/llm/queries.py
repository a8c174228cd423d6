"""The queries of this package: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from parcelry.llm.common import table


def op1_quality_subword(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parcelry.llm.subword import learnt, scored

    docs = table(spark, sf_dir, "documents")
    return scored(docs, learnt(docs, table(spark, sf_dir, "labels"), "quality"), 0.3)


def op2_token_group_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parcelry.llm.tokengroups import joined

    return joined(table(spark, sf_dir, "documents"))


def op3_mtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parcelry.llm.mtree import top_k

    return top_k(table(spark, sf_dir, "embeddings"))


def op4_mixing_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parcelry.llm.mixing import taken

    return taken(table(spark, sf_dir, "documents"))


def op5_superkmer_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parcelry.llm.superkmers import deduplicated

    return deduplicated(table(spark, sf_dir, "documents"), digest=True)


def op6_media_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parcelry.llm.common import kept
    from parcelry.llm.media import decoded, features, stored

    return features(kept(decoded(stored(table(spark, sf_dir, "documents")))))


def op7_toxicity_weak(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parcelry.llm.weak import learnt, scored

    docs = table(spark, sf_dir, "documents")
    return scored(docs, learnt(docs, table(spark, sf_dir, "labels"), "toxic"), 0.5)


def op8_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parcelry.llm.rendezvous import sharded

    return sharded(table(spark, sf_dir, "documents"), 40, weights=[1.0] * 40, grown_weight=1.0)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parcelry.llm.suffixes import deduplicated

    return deduplicated(table(spark, sf_dir, "documents"), digest=True)


def op10_byte_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    import public_tokenizers

    from parcelry.llm.byte_bpe import digests

    return digests(table(spark, sf_dir, "documents"), path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parcelry.llm.pipeline import run

    return run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_subword, op2_token_group_join, op3_mtree_topk, op4_mixing_tree, op5_superkmer_dedup, op6_media_flac, op7_toxicity_weak, op8_rendezvous_sharding, op9_suffix_dedup, op10_byte_bpe, pipeline)}


#: The words of a text, in DuckDB.
_WORDS = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Queries whose results SQL can express.
ORACLES: dict[str, str] = {
    "op2_token_group_join": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOW)} AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)
  UNION ALL SELECT doc_id, len(w) || ' ' || array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND 4
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r(d, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.d AND r.root < e.b)
SELECT d AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(root) AS component_id, CAST(coalesce(any_value(l.k), 0) AS BIGINT) AS n_links
FROM r LEFT JOIN n ON n.doc_id = d LEFT JOIN (SELECT a, count(*) AS k FROM e GROUP BY a) l ON l.a = d GROUP BY d
""",
    "op5_superkmer_dedup": f"""
WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
p AS (SELECT doc_id, i, w[i] AS word, CASE WHEN i + 19 <= len(w) THEN md5(array_to_string(w[i : i + 19], ' ')) END AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w)),
f AS (SELECT doc_id, i, word, k IS NOT NULL AND row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1 AS again FROM p),
g AS (SELECT doc_id, i, word, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM f),
t AS (SELECT doc_id, count(*) AS n, count(*) FILTER (gone) AS r, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM g GROUP BY doc_id)
SELECT d.doc_id, coalesce(t.n, 0) AS n_words, coalesce(t.r, 0) AS n_removed, sha256(coalesce(t.kept, '')) AS kept_sha256 FROM documents d LEFT JOIN t USING (doc_id)
""",
    "op9_suffix_dedup": """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, i, substring(h, 2 * i - 1, 2) AS b, CASE WHEN 2 * (i + 399) <= length(h) THEN md5(substring(h, 2 * i - 1, 800)) END AS k FROM (SELECT doc_id, h, unnest(range(1, length(h) // 2 + 1)) AS i FROM h)),
f AS (SELECT doc_id, i, b, k IS NOT NULL AND count(*) OVER (PARTITION BY k) > 1 AS again FROM p),
g AS (SELECT doc_id, i, b, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 399 PRECEDING AND CURRENT ROW) AS gone FROM f),
e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), FALSE) AS opens FROM g),
t AS (SELECT doc_id, count(*) AS n, count(*) FILTER (gone) AS r, count(*) FILTER (opens) AS s, string_agg(b, '' ORDER BY i) FILTER (NOT gone) AS kept FROM e GROUP BY doc_id)
SELECT d.doc_id, coalesce(t.n, 0) AS n_bytes, coalesce(t.r, 0) AS n_removed, coalesce(t.s, 0) AS n_spans, sha256(unhex(coalesce(t.kept, ''))) AS kept_sha256 FROM documents d LEFT JOIN t USING (doc_id)
""",
    "op3_mtree_topk": """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10
""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
