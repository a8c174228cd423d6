"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's documents are dealt by hash into blocks of about equal words. A source's quota is a number of block draws:
whole passes over its blocks, each pass in a permutation of its own, then so many blocks of one more pass as its target
still asks for, the last of them only in part, by whole documents. A binary tree over the output shards splits the
quotas exactly: at each node the left half's draws are a multivariate hypergeometric sample of the node's. A shard thus
gets the mixture that dealing out all blocks at random would give it, and every draw goes to exactly one shard. A shard
takes the next draws of each source's permuted sequence and shuffles its documents locally. Positions in a sequence come
from sums over pieces of it, so no task gets all blocks of a source.

Only sources (a dimension) are gathered on the driver; blocks and documents stay distributed, and texts don't move.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelry.llm.common import WORD, bucket_count, kept, whole

WEIGHTS = (5.0, 2.0, 1.0)


@dataclass(frozen=True)
class Settings:
    weights: tuple[float, ...] = WEIGHTS
    #: A source is repeated so many times at most.
    most: float = 3.0
    shards: int = 16
    #: Words of a block, and blocks of a piece of a source's sequence.
    block_words: int = 1 << 14
    piece_blocks: int = 1 << 12
    seed: int = 4


def targets(sizes: list[int], s: Settings = Settings()) -> list[float]:
    """Of sources in their order: words to take. Weights repeat over the sources and share all words; a target stops at `most` times its source, and what it leaves is shared by weight among the others until none is above."""
    weight = [s.weights[i % len(s.weights)] for i in range(len(sizes))]
    out, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    left = float(sum(sizes))
    while open_:
        total = sum(weight[i] for i in sorted(open_))
        full = [i for i in sorted(open_) if left * weight[i] / total > s.most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = left * weight[i] / total
            break
        for i in full:
            out[i] = s.most * sizes[i]
            open_.remove(i)
        left -= sum(out[i] for i in full)
    return out


def split(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Draws of each source (columns) for each shard (rows): rows sum to equal loads, at most one apart, and columns to the quotas."""
    out = np.zeros((shards, len(quotas)), np.int64)
    total = int(quotas.sum())
    loads = np.full(shards, total // shards, np.int64)
    loads[: total % shards] += 1

    def node(first: int, last: int, have: np.ndarray) -> None:
        if last - first == 1:
            out[first] = have
            return
        middle = (first + last) // 2
        rng = np.random.default_rng([seed, first, last])
        want, left, rest = int(loads[first:middle].sum()), np.zeros_like(have), int(have.sum())
        for i, n in enumerate(have.tolist()):  # one margin after the other
            rest -= n
            left[i] = _hypergeometric(rng, n, rest, want)
            want -= int(left[i])
        node(first, middle, left)
        node(middle, last, have - left)

    node(0, shards, quotas.astype(np.int64))
    return out


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    if not good or not draws:
        return 0
    if not bad:
        return draws
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, draws))
    n = good + bad  # beyond numpy's range: the normal approximation, held to the possible
    mean = draws * good / n
    sd = (mean * (bad / n) * (n - draws) / (n - 1)) ** 0.5
    return int(min(max(round(rng.normal(mean, sd)), draws - bad, 0), good, draws))


def fingerprint(of: str = "") -> Column:
    return F.xxhash64(f"{of}text", f"{of}source")


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words) and fp, which with doc_id tells rows apart that aren't equal."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", size.alias("size"), fingerprint().alias("fp"))


@dataclass
class Mix:
    #: doc_id, fp, copy, source_no, size, source_size, target, source_draws (block draws of its source): a row for each row mixed.
    rows: DataFrame
    #: doc_id, fp, copy, size, pass, shard, place: a row for each time that a row is taken; place orders a shard.
    draws: DataFrame


def mix(docs: DataFrame, s: Settings = Settings()) -> Mix:
    """Plan a mix of docs (doc_id, text, source).

    Sources go by code point, null last, as a source of its own. Equal rows are numbered (copy) and taken each for
    itself; empty and null texts have size 0 and are drawn with their block, which takes no words. No rows give no rows.
    """
    spark = docs.sparkSession
    one = identified(docs).groupBy("doc_id", "fp", "source", "size").count().withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "count"))).drop("count")
    rows = kept(one)
    found = [(r.source, int(r.size)) for r in rows.groupBy("source").agg(F.sum("size").alias("size")).collect()]
    found.sort(key=lambda x: (x[0] is None, x[0] or ""))
    sizes = [n for _, n in found]
    goal = targets(sizes, s)
    plan = []
    for no, ((source, size), target) in enumerate(zip(found, goal, strict=True)):
        whole = int(target // size) if size else 0
        plan.append((source, no, size, target, max(1, round(size / s.block_words)), whole, int(round(target - whole * size))))
    schema = "source string, source_no int, source_size long, target double, n_blocks long, whole int, rest long"
    sources = spark.createDataFrame(plan, schema)
    numbered = rows.join(sources.withColumnRenamed("source", "name"), F.col("source").eqNullSafe(F.col("name"))).drop("name")

    def order(*parts: Column | str) -> Column:
        return F.xxhash64(F.lit(s.seed), *parts)

    numbered = numbered.withColumn("block", F.pmod(order("doc_id", "fp", "copy"), "n_blocks"))
    blocks = kept(numbered.groupBy("source_no", "block", "whole", "rest", "n_blocks").agg(F.sum("size").alias("words")))
    n_of = {r.source_no: r["count"] for r in blocks.groupBy("source_no").count().collect()}
    pieces = F.ceil(F.col("n_blocks") / s.piece_blocks)
    passes = blocks.withColumn("pass", F.explode(F.sequence(F.lit(0), "whole"))).withColumn("order", order("source_no", "pass", "block"))
    passes = passes.withColumn("piece", F.floor((F.col("order").cast("double") / 2.0**64 + 0.5) * pieces))
    piece = ["source_no", "pass", "piece"]
    before = Window.partitionBy("source_no", "pass").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = passes.groupBy(*piece).agg(F.sum("words").alias("w"), F.count("*").alias("n"))
    offsets = offsets.select(*piece, *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("w", "n")))
    along = Window.partitionBy(*piece).orderBy("order", "block")
    within = F.sum("words").over(along.rowsBetween(Window.unboundedPreceding, 0))
    passes = passes.withColumn("sum", within).withColumn("nth", F.row_number().over(along) - 1).join(offsets, piece)
    passes = passes.withColumn("sum", F.col("sum") + F.col("w_before")).withColumn("nth", F.col("nth") + F.col("n_before"))
    full = (F.col("pass") < F.col("whole")) | (F.col("sum") <= F.col("rest"))
    part = ~full & (F.col("sum") - F.col("words") < F.col("rest"))
    drawn = kept(passes.where(full | part).withColumn("full", full).withColumn("room", F.col("rest") - (F.col("sum") - F.col("words"))))

    quota = {r.source_no: r["count"] for r in drawn.groupBy("source_no").count().collect()}
    dealt = split(np.array([quota.get(i, 0) for i in range(len(plan))], np.int64), s.shards, s.seed)
    ends = np.cumsum(dealt, axis=0)
    table = spark.createDataFrame([(i, int(n_of.get(i, 0)), [int(x) for x in ends[:, i]]) for i in range(len(plan))], "source_no int, per_pass long, ends array<long>")
    at = F.col("pass") * F.col("per_pass") + F.col("nth")
    drawn = drawn.join(table, "source_no").withColumn("at", at).withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.col("at")))).select("source_no", "block", "pass", "full", "room", "shard")

    pairs = numbered.select("doc_id", "fp", "copy", "size", "source_no", "block").join(drawn, ["source_no", "block"])
    row = ["doc_id", "fp", "copy", "size", "pass", "shard"]

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        """Of a block that is taken in part, the rows that still fit, in permuted order, and the smallest left over if that comes nearer."""
        group = group.sort_values(["order", "doc_id", "fp", "copy"], kind="stable")
        left, take = int(group["room"].iloc[0]), []
        for n in group["size"]:
            take.append(n <= left)
            left -= n if n <= left else 0
        over = [i for i, t in enumerate(take) if not t]
        if over:
            i = min(over, key=lambda i: group["size"].iloc[i])
            take[i] = bool(group["size"].iloc[i] - left < left)
        return group.loc[take, row]

    kind = {f.name: f.dataType.simpleString() for f in pairs.schema}
    some = pairs.where(~F.col("full") & (F.col("size") > 0)).withColumn("order", order("pass", "doc_id", "fp", "copy"))
    fitted = some.groupBy("source_no").applyInPandas(fit, ", ".join(f"{c} {kind[c]}" for c in row))
    draws = pairs.where("full").select(row).unionByName(fitted).withColumn("place", order(F.lit("place"), "pass", "doc_id", "fp", "copy"))
    asked = spark.createDataFrame([(i, int(quota.get(i, 0))) for i in range(len(plan))], "source_no int, source_draws long")
    return Mix(numbered.join(asked, "source_no").select("doc_id", "fp", "copy", "source_no", "size", "source_size", "target", "source_draws"), draws)


def taken(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, size, source_size, target (its source's), taken, shards, source_draws of every row.

    taken: the words that the mix takes of it, repeats counted. shards: the output shards that the splitting tree gave it
    to, ascending, one for each time it is taken (empty: never). source_draws: its source's quota of block draws.
    Repeated rows are taken each for itself, null ids are ids like any other, a null or empty text takes no words, a very
    long text fills a block alone, and no rows give no rows. Other columns of docs aren't looked at.
    """
    m = mix(docs, s)
    sums = m.draws.groupBy("doc_id", "fp", "copy").agg(F.sum("size").alias("taken"), F.sort_array(F.collect_list("shard")).alias("shards"))
    sums = sums.select(F.col("doc_id").alias("d"), F.col("fp").alias("f"), F.col("copy").alias("c"), "taken", "shards")
    on = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("fp") == F.col("f")) & (F.col("copy") == F.col("c"))
    none = F.array().cast("array<int>")
    return m.rows.join(sums, on, "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("shards", none).alias("shards"), "source_draws")


def mixed(docs: DataFrame, s: Settings = Settings(), shuffled: bool = True) -> DataFrame:
    """The mix itself: the rows of docs with all their columns, each as often as it is taken (see taken).

    shuffled: a partition has a stretch of one shard's shuffled order. There are as many stretches as the session has
    shuffle partitions, and one for each shard at least. Columns may have any names.
    """
    m = mix(docs, s)
    number = Window.partitionBy("doc_id", "fp").orderBy(F.lit(0))
    own = whole(docs).select("row", F.col("row.doc_id").alias("doc_id"), fingerprint("row.").alias("fp"))
    own = own.withColumn("copy", F.row_number().over(number).cast("long"))
    draws = m.draws.select(F.col("doc_id").alias("d"), F.col("fp").alias("f"), F.col("copy").alias("c"), "shard", "place")
    on = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("fp") == F.col("f")) & (F.col("copy") == F.col("c"))
    out = own.join(draws, on)
    if shuffled:
        each = -(-bucket_count(docs.sparkSession) // s.shards)
        stretch = F.floor((F.col("place").cast("double") / 2.0**64 + 0.5) * each)
        out = out.withColumn("stretch", stretch).repartition(s.shards * each, "shard", "stretch").sortWithinPartitions("shard", "stretch", "place")
    return out.select("row.*")
