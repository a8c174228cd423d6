"""Sharding by rendezvous hashing.

A record goes to the shard whose score, from a hash of the record's stable key and the shard's number, is highest. A
new shard can only win records for itself, so n + 1 shards differ from n by the rows that the new one takes, a share of
about its weight. All expressions run in the JVM; the only shuffle carries keys and sizes, never texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelry.llm.common import kept


def shard_of(key: Column, n_shards: int, weights: list[float] | None = None) -> Column:
    """The shard, 0 to n_shards - 1, of a key. Equal scores go to the lower shard; null is a key like any other.

    weights: a positive weight for each shard. Without them the largest hash wins; with them the largest -w / ln(u) for
    u uniform in (0, 1), which gives shard i the share w_i / sum(w).
    """
    if n_shards < 1 or weights is not None and (len(weights) != n_shards or min(weights) <= 0):
        raise ValueError("one positive weight for each of at least one shard")
    scored = []
    for i in range(n_shards):
        h = F.xxhash64(key, F.lit(i))
        if weights is not None:
            u = (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / float(2**53)
            h = F.lit(-float(weights[i])) / F.log(u)
        scored.append(F.struct(h.alias("score"), F.lit(-i).alias("neg")))
    return -(F.greatest(*scored)["neg"] if n_shards > 1 else F.lit(0))


def sharded(docs: DataFrame, n_shards: int, weights: list[float] | None = None, grown_weight: float | None = None, slot_rows: int = 4096) -> DataFrame:
    """A row for each row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size is the text's UTF-8 bytes plus 16 (null text: 16, CRC 0). slot numbers a shard's rows from 0 without gaps.
    grown_shard is the shard when there is one more (of weight grown_weight, if weights are given). Repeated rows stay
    together, each with its own slot; a null doc_id is a key of its own; no rows give no rows.

    A shard's rows are numbered in pieces of about slot_rows rows (by another hash of the key, so the number of pieces
    follows the table): each piece counts from where the pieces before it end. No task gets a whole shard.
    """
    grown = None if weights is None else [*weights, 1.0 if grown_weight is None else grown_weight]
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = kept(
        docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32")).select(
            "*", shard_of(F.col("doc_id"), n_shards, weights).cast("int").alias("shard"), shard_of(F.col("doc_id"), n_shards + 1, grown).cast("int").alias("grown_shard")
        )
    )
    pieces = max(1, -(-rows.count() // (n_shards * slot_rows)))
    rows = rows.withColumn("piece", F.pmod(F.xxhash64(F.lit("piece"), "doc_id"), F.lit(pieces)).cast("int"))
    before = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("shard", "piece").count().select("shard", "piece", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "piece").orderBy("doc_id", "size", "text_crc32")
    return (
        rows.withColumn("nth", F.row_number().over(within) - 1)
        .join(offsets, ["shard", "piece"])
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("offset") + F.col("nth")).alias("slot"), "grown_shard")
    )
