"""Exact top-k by inner product: best-first search in an M-tree.

The tree's top level is distributed: a bounded number of routing objects, drawn from the data, split all vectors into
cells of known covering radius, and large cells into blocks. Within a block a paged M-tree is loaded from above: a node
holds routing objects with covering radii and their distances to the node's own, a leaf holds vectors with theirs.

The distance is Euclidean. For a query q, an object p and a vector x, q.x = q.p + q.(x - p) <= q.p + |q| d(x, p), so

- a node around p with radius r cannot hold a score above q.p + |q| r: nodes are opened best bound first;
- an entry e below p can be dropped on q.p + |q| (d(e, p) + r_e) alone, by the stored distance, before q.e is computed.

A query first goes to the cell with the best bound; its k-th score there decides which other cells it must see at all.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelry.llm.common import forget, kept, lean

#: Bounds are floats, scores integers: a bound this little below a score still counts.
SLACK = 1e-9


@dataclass(frozen=True)
class Settings:
    k: int = 10
    scale: int = 1024
    every: int = 100
    #: Routing objects of the top level at most, one for so many rows.
    cells: int = 256
    cell_rows: int = 2048
    #: Rows of a block, queries that meet a block's tree together, entries of a page.
    block_rows: int = 16_384
    together: int = 16_384
    page: int = 128
    fan: int = 16
    seed: int = 3


class Tree:
    """An M-tree over integer vectors."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, s: Settings = Settings()):
        order = np.argsort(ids, kind="stable")
        self.ids, self.whole, self.s = ids[order], x[order], s
        #: Products are exact in doubles while they stay below 2 ** 53.
        self.exact = bool(not x.size or float(np.abs(x).max()) ** 2 * max(1, x.shape[1]) < 2**52)
        self.x = self.whole.astype(np.float64)
        self.opened = self.computed = 0
        rng = np.random.default_rng(s.seed)
        rows = np.arange(len(ids))
        center = self.x.mean(axis=0) if len(ids) else np.zeros(x.shape[1])
        self.root = self._load(rows, center, rng)

    def _distance(self, rows: np.ndarray, p: np.ndarray) -> np.ndarray:
        d = self.x[rows] - p
        return np.sqrt(np.einsum("ij,ij->i", d, d))

    def _load(self, rows: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> tuple:
        """(object, radius, None, rows and their distances to it) for a leaf, (object, radius, children, their objects, radii, distances) otherwise."""
        d = self._distance(rows, p)
        radius = float(d.max()) if len(d) else 0.0
        if len(rows) <= self.s.page:
            return p, radius, None, rows, d
        if radius == 0:  # all equal: pages in id order
            parts = [rows[i : i + self.s.page] for i in range(0, len(rows), self.s.page)]
        else:
            picks = rng.choice(rows, min(self.s.fan, len(rows)), replace=False)
            objects = np.unique(self.x[picks], axis=0)
            if len(objects) < 2:
                objects = np.stack([self.x[rows[int(d.argmax())]], self.x[rows[int(d.argmin())]]])
            own = np.argmin((objects * objects).sum(axis=1)[None, :] - 2 * self.x[rows] @ objects.T, axis=1)
            parts = [q for i in range(len(objects)) if len(q := rows[own == i])]
            if len(parts) == 1:
                half = np.argsort(d, kind="stable")
                parts = [rows[half[: len(half) // 2]], rows[half[len(half) // 2 :]]]
        children = [self._load(q, self.x[q[0]] if radius == 0 else self.x[q].mean(axis=0), rng) for q in parts]
        at = np.stack([c[0] for c in children])
        return p, radius, children, at, np.array([c[1] for c in children]), np.sqrt(((at - p) ** 2).sum(axis=1))

    def search(self, query: np.ndarray, own: int, k: int, least: float = -np.inf) -> list[tuple[int, int]]:
        """The k best (score, id), ties to the smaller id, without the id `own`; scores below `least` may be missing."""
        if not len(self.ids):
            return []
        q = query.astype(np.float64)
        norm = float(np.sqrt(q @ q))
        best: list[tuple[int, int]] = []  # a heap of (score, -id): the worst first
        floor = least
        slack = SLACK * (1 + norm * norm)
        qp = float(q @ self.root[0])
        todo, n = [(-(qp + norm * self.root[1]), 0, qp, self.root)], 1
        while todo:
            bound, _, qp, node = heapq.heappop(todo)
            if -bound + slack + 1e-6 * abs(bound) * SLACK < floor:
                break
            self.opened += 1
            if node[2] is None:
                rows = node[3][qp + norm * node[4] + slack >= floor]
                if not len(rows):
                    continue
                self.computed += len(rows)
                scores = self.x[rows] @ q if self.exact else np.array([sum(int(a) * int(b) for a, b in zip(v, query, strict=True)) for v in self.whole[rows]], object)
                for i in np.flatnonzero((scores >= floor) & (self.ids[rows] != own)):
                    item = (int(scores[i]), -int(self.ids[rows[i]]))
                    if len(best) < k:
                        heapq.heappush(best, item)
                    elif item > best[0]:
                        heapq.heapreplace(best, item)
                    if len(best) == k:
                        floor = max(floor, best[0][0])
            else:
                near = np.flatnonzero(qp + norm * (node[5] + node[4]) + slack >= floor)
                self.computed += len(near)
                scores = node[3][near] @ q
                for i, v, b in zip(near.tolist(), scores.tolist(), (scores + norm * node[4][near]).tolist(), strict=True):
                    if b + slack >= floor:
                        heapq.heappush(todo, (-b, n, v, node[2][i]))
                        n += 1
        return [(a, -b) for a, b in sorted(best, reverse=True)]


def quantised(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id and v: floor(scale * component) as integers. Null ids, null vectors and those with null or non-finite components are left out. Where lengths differ, a shorter vector counts as one with zeros behind it, as if it had no part in these components."""
    x = F.col("embedding")
    fine = F.col("vec_id").isNotNull() & x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf")))
    out = vectors.where(F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e.cast("double") * scale).cast("long")).alias("v"))
    least, most = out.agg(F.min(F.size("v")), F.max(F.size("v"))).first()
    return out if least == most else out.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(most) - F.size("v"))))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1).astype(np.int64) if len(c) else np.empty((0, 0), np.int64)


def top_k(vectors: DataFrame, s: Settings = Settings()) -> DataFrame:
    """query_id, rank, vec_id, score: of every query (a vec_id divisible by `every`) the k vectors of highest integer inner product.

    Ties go to the smaller vec_id, a query's own id is no candidate, and fewer candidates give fewer rows. Repeated rows
    (equal id and vector) count once. No vectors give no rows.
    """
    spark = vectors.sparkSession
    # every vector once, wherever its copies lie
    base = kept(quantised(vectors, s.scale).distinct())
    n = base.count()
    schema = "query_id long, rank int, vec_id long, score long"
    if not n:
        return spark.createDataFrame([], schema)
    n_cells = max(1, min(s.cells, n // s.cell_rows))
    picked = base.orderBy(F.xxhash64(F.lit(s.seed), "vec_id"), "vec_id").limit(n_cells).select("v").collect()
    objects = np.unique(np.array([r.v for r in picked], np.float64).reshape(len(picked), -1), axis=0)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1)).astype(np.float64)
            cell = np.argmin((objects * objects).sum(axis=1)[None, :] - 2 * x @ objects.T, axis=1) if len(x) else np.empty(0, np.int64)
            away = np.sqrt(((x - objects[cell]) ** 2).sum(axis=1)) if len(x) else np.empty(0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell, pa.int32()), pa.array(away, pa.float64())], ["vec_id", "v", "cell", "away"])

    placed = kept(base.mapInArrow(lean(assign), "vec_id long, v array<long>, cell int, away double"))
    cells = {r.cell: (r.n, r.radius) for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect()}
    forget(base)
    numbers = sorted(cells)
    radius = np.array([cells[c][1] for c in numbers])
    center = objects[numbers]
    split = np.array([-(-cells[c][0] // s.block_rows) for c in numbers])

    queries = placed.where(F.col("vec_id") % s.every == 0)
    parts = F.element_at(F.create_map(*[F.lit(int(v)) for pair in zip(numbers, split, strict=True) for v in pair]), F.col("cell"))
    blocks = placed.select("vec_id", "v", "cell", F.pmod(F.xxhash64("vec_id"), parts).cast("int").alias("part"))

    def route(first: bool):
        """Send a query to the blocks of its best cell, or of the others that may hold a score of at least its k-th so far."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids, q = b.column(0).to_numpy(zero_copy_only=False), _matrix(b.column(1)).astype(np.float64)
                least = b.column(2).to_numpy(zero_copy_only=False).astype(np.float64)
                if not len(ids):
                    continue
                norm = np.sqrt((q * q).sum(axis=1))
                bound = q @ center.T + norm[:, None] * radius[None, :] + SLACK * (1 + norm[:, None] ** 2)
                best = np.argmax(bound, axis=1)
                go = np.zeros(bound.shape, bool)
                if first:
                    go[np.arange(len(ids)), best] = True
                else:
                    go = ~(bound < least[:, None])
                    go[np.arange(len(ids)), best] = False
                row, col = np.nonzero(go)
                part = [np.arange(split[c]) for c in col]
                row, col = np.repeat(row, split[col]), np.repeat(col, split[col])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[row]), b.column(1).take(pa.array(row)), pa.array(least[row]), pa.array(np.array(numbers, np.int32)[col]), pa.array(np.concatenate(part) if part else np.empty(0), pa.int32())],
                    ["query_id", "q", "least", "cell", "part"],
                )

        return run

    def answer(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        ids = right.column("query_id").to_numpy()
        rows: list[tuple[int, int, int]] = []
        if len(ids) and left.num_rows:
            tree = Tree(left.column("vec_id").to_numpy(), _matrix(left.column("v")), s)
            for own, q, least in zip(ids.tolist(), _matrix(right.column("q")), right.column("least").to_pylist(), strict=True):
                rows += [(own, i, score) for score, i in tree.search(q, own, s.k, least)]
        a, b, c = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(c, pa.int64())})

    def met(asked: DataFrame, first: bool) -> DataFrame:
        sent = asked.mapInArrow(lean(route(first)), "query_id long, q array<long>, least double, cell int, part int")
        # a block goes to one task, but for those that more than `together` queries ask: to as many as these need
        by = ["cell", "part", "chunk"]
        much = sent.groupBy("cell", "part").agg(F.ceil(F.count("*") / s.together).cast("int").alias("chunks")).where("chunks > 1").collect()
        if much:  # rows of blocks, of which there are few
            chunks = spark.createDataFrame([tuple(r) for r in much], "cell int, part int, chunks int")
            n_of = F.coalesce("chunks", F.lit(1))
            sent = sent.join(chunks, ["cell", "part"], "left").withColumn("chunk", F.pmod(F.xxhash64(F.lit("chunk"), "query_id"), n_of).cast("int"))
            own = blocks.join(chunks, ["cell", "part"], "left").withColumn("chunk", F.explode(F.sequence(F.lit(0), n_of - 1)))
        else:
            sent, own = (x.withColumn("chunk", F.lit(0)) for x in (sent, blocks))
        left, right = own.select("vec_id", "v", *by), sent.select("query_id", "q", "least", *by)
        return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(answer, "query_id long, vec_id long, score long")

    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = lambda df: df.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= s.k)
    one = kept(best(met(queries.select("vec_id", "v", F.lit(float("-inf")).alias("least")), True)))
    floor = one.where(F.col("rank") == s.k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("least"))
    again = queries.select("vec_id", "v").join(floor, "vec_id", "left").select("vec_id", "v", F.coalesce("least", F.lit(float("-inf"))).alias("least"))
    two = met(again, False)
    return best(one.drop("rank").unionByName(two)).select("query_id", "rank", "vec_id", "score")
