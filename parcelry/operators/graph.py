"""Graphs as two frames: vertices (id) and edges (a, b). An edge never adds a vertex."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcelry.operators.checks import require


#: Edges for each file between rounds.
EDGES = 200_000


def scratch(spark: SparkSession, kind: str) -> str:
    """A new path where all executors see it: under spark.checkpoint.dir, or in a folder of our own if all runs in one process. Elsewhere an unset folder raises."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="parcelry-"))
        folder = spark.sparkContext.getCheckpointDir()
    return f"{folder}/{kind}-{uuid.uuid4().hex}"


def removed(df: DataFrame) -> None:
    """Delete the files of what kept() wrote, once nothing reads them any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/graph-" in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def kept(df: DataFrame, files: int | None = None) -> DataFrame:
    """df written where all executors see it (into so many files at most), and read back: it cuts the lineage of loops."""
    spark = df.sparkSession
    path = scratch(spark, "graph")
    (df.coalesce(files) if files else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def canonical(edges: DataFrame) -> DataFrame:
    """Each edge once, a < b, without loops."""
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def induced(vertices: DataFrame, edges: DataFrame, key: str | None = None) -> DataFrame:
    """Edges between vertices of the set, or of one group of it."""
    a = vertices.select(F.col("id").alias("a"), *([F.col(key).alias("_ga")] if key else []))
    b = vertices.select(F.col("id").alias("b"), *([F.col(key).alias("_gb")] if key else []))
    out = edges.join(a, "a").join(b, "b")
    return out.where("_ga = _gb").drop("_ga", "_gb") if key else out


def stars(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every node of edges (a, b); repeated edges and loops don't matter, no edges give no rows.

    Large stars and small stars by turns: each node links its larger neighbours, then itself and its smaller neighbours, to
    the smallest of them. The edges become stars around each component's smallest node in about log(nodes) rounds. A
    node's neighbours never meet in one task: a minimum is aggregated, then joined back. The loop ends when a round changes
    nothing; a round's table goes when the next one stands.
    """
    now = kept(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    files, state = max(1, now.count() // EDGES), None
    while True:
        two = both_ways(now)
        least = two.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = two.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        m = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(m, "a")
        small = small.select("a", F.col("m").alias("b")).unionByName(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        new = kept(small.distinct(), files)
        removed(now)
        now = new
        row = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if row == state:
            break
        state = row
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def components(vertices: DataFrame, edges: DataFrame, key: str | None = None) -> DataFrame:
    """vertices with component, the smallest id reachable (within the group `key`)."""
    found = stars(induced(vertices, canonical(edges), key).select("a", "b"))
    return vertices.join(found.select(F.col("node").alias("id"), F.col("component").alias("_c")), "id", "left").withColumn("component", F.coalesce("_c", "id")).drop("_c")


def frontier(vertices: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Breadth-first growth from seeds (id, owner) over the graph: id, owner, depth.

    It equals a queue that starts with the seeds in id order and takes neighbours in id order: a vertex gets the owner of
    the neighbour that was queued first. The place in the queue is the path of ids from the seed; paths of one depth
    compare like places. A step is a join and a minimum, so a whole depth is taken at once. What a depth reaches again is
    in it or in the one before; so a step reads two depths, and appends its own to the result.
    """
    spark = vertices.sparkSession
    folder = scratch(spark, "growth")
    two = kept(both_ways(induced(vertices, edges)))
    last, before, depth = kept(seeds.select("id", "owner", F.array(F.col("id")).alias("path"))), None, 0
    out = last.select("id", "owner", F.lit(0).alias("depth"))
    out.write.mode("append").parquet(folder)
    while True:
        depth += 1
        reach = last.join(two, last["id"] == two["a"]).select(F.col("b").alias("id"), "path", "owner").join(last.select("id"), "id", "left_anti")
        if before is not None:
            reach = reach.join(before.select("id"), "id", "left_anti")
        best = reach.groupBy("id").agg(F.min(F.struct("path", "owner")).alias("p"))
        new = kept(best.select("id", "p.owner", F.array_append("p.path", F.col("id")).alias("path")))
        if new.isEmpty():
            break
        new.select("id", "owner", F.lit(depth).alias("depth")).write.mode("append").parquet(folder)
        if before is not None:
            removed(before)
        before, last = last, new
    return spark.read.schema(out.schema).parquet(folder)


def reachable(vertices: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Ids that paths through the vertices join to a seed."""
    inside = seeds.join(vertices.select("id"), "id", "left_semi")
    return frontier(vertices, edges, inside.select("id", F.lit(0).alias("owner"))).select("id", "depth")


def staged_growth(vertices: DataFrame, edges: DataFrame, seeds: DataFrame, scopes: list[str]) -> DataFrame:
    """Growth in stages: first along edges within the first scope column's groups, then the next, last everywhere."""
    done = seeds.select("id", "owner").withColumn("stage", F.lit(0))
    for i, scope in enumerate([*scopes, None]):
        own = edges if scope is None else induced(vertices, edges, scope)
        grown = frontier(vertices, own, done.select("id", "owner")).where("depth > 0")
        done = kept(done.unionByName(grown.select("id", "owner", F.lit(i + 1).alias("stage"))))
    return done


def shortest_paths(vertices: DataFrame, edges: DataFrame, source: DataFrame, weight: str | None = None) -> DataFrame:
    """id, cost: least sum of vertex weights (or steps) from any source vertex, its own not counted; weights aren't negative.

    By rounds that start from what the round before made cheaper, until nothing gets cheaper.
    """
    w = vertices.select(F.col("id").alias("b"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("_w"))
    require(w.where("_w < 0").select("b"), "negative weights")
    two = kept(both_ways(induced(vertices, edges)).join(w, "b"))
    done = changed = kept(source.select("id", F.lit(0.0).alias("cost")).distinct())
    while True:
        step = changed.join(two, changed["id"] == two["a"]).select(F.col("b").alias("id"), (F.col("cost") + F.col("_w")).alias("cost"))
        new = kept(done.unionByName(step).groupBy("id").agg(F.min("cost").alias("cost")))
        changed = kept(new.join(done, ["id", "cost"], "left_anti"))
        if changed.isEmpty():
            return new
        removed(done)
        done = new


def quotient(vertices: DataFrame, edges: DataFrame, unit: str, measure: str | None = None) -> DataFrame:
    """Edges between units, with how many edges, and how much of a measure, cross."""
    a = vertices.select(F.col("id").alias("a"), F.col(unit).alias("ua"))
    b = vertices.select(F.col("id").alias("b"), F.col(unit).alias("ub"))
    cross = edges.join(a, "a").join(b, "b").where("ua <> ub").withColumns({"u": F.least("ua", "ub"), "v": F.greatest("ua", "ub")})
    return cross.groupBy("u", "v").agg(F.count("*").alias("edges"), *([F.sum(measure).alias(measure)] if measure else []))


def cut_edges(vertices: DataFrame, edges: DataFrame, district: str) -> DataFrame:
    """By pair of districts, the edges between them."""
    return quotient(vertices, edges, district)


def borders(vertices: DataFrame, edges: DataFrame, unit: str) -> DataFrame:
    """How many vertices of v touch u."""
    a = vertices.select(F.col("id").alias("a"), F.col(unit).alias("u"))
    b = vertices.select(F.col("id").alias("b"), F.col(unit).alias("v"))
    return both_ways(edges).join(a, "a").join(b, "b").where("u <> v").groupBy("u", "v").agg(F.countDistinct("b").alias("vertices"))


def pieces(ledger: DataFrame, edges: DataFrame, district: list[str], vertex: str, mass: str) -> DataFrame:
    """Connected pieces of each district on the graph: component, vertices, mass, and whether it is the main one (heaviest, then most vertices, then smallest id)."""
    v = ledger.select(F.col(vertex).alias("id"), *district, F.col(mass).alias("_m")).withColumn("_g", F.struct(*district))
    c = components(v, edges, "_g")
    g = c.groupBy(*district, "component").agg(F.count("*").alias("vertices"), F.sum("_m").alias("mass"))
    nth = F.row_number().over(Window.partitionBy(*district).orderBy(F.desc("mass"), F.desc("vertices"), "component"))
    return g.withColumn("main", nth == 1)


def contiguity(ledger: DataFrame, edges: DataFrame, district: list[str], vertex: str, mass: str) -> DataFrame:
    """By district: pieces, and the contiguity weight: a piece beyond the main one costs 1 and its mass over the mean district's."""
    p = pieces(ledger, edges, district, vertex, mass)
    tau = p.groupBy(*district).agg(F.sum("mass").alias("m")).agg(F.avg("m").alias("tau"))
    cost = F.when(~F.col("main"), 1 + F.coalesce(F.try_divide("mass", "tau"), F.lit(0.0))).otherwise(F.lit(0.0))
    return p.crossJoin(F.broadcast(tau)).groupBy(*district).agg(F.count("*").alias("pieces"), F.sum(cost).alias("weight"))


def connected_subsets(vertices: DataFrame, edges: DataFrame, most: int, apart: DataFrame | None = None) -> DataFrame:
    """All connected sets of at most `most` vertices, as sorted arrays. apart: pairs (a, b) that no set may hold.

    Level by level: a set grows by a neighbour of one of its members; equal sets meet and are kept once. A pair that is too
    far apart bars a set and all that contain it, so the bar is part of the join.
    """
    two = kept(both_ways(induced(vertices, edges)))
    level = kept(vertices.select(F.array("id").alias("members")).distinct())
    out = level
    for _ in range(most - 1):
        grown = level.withColumn("a", F.explode("members")).join(two, "a").where(~F.array_contains("members", F.col("b")))
        if apart is not None:
            far = both_ways(apart)
            hit = grown.select("members", "b", F.explode("members").alias("a")).join(far, ["a", "b"], "left_semi").select("members", "b").distinct()
            grown = grown.join(hit, ["members", "b"], "left_anti")
        level = kept(grown.select(F.array_sort(F.array_append("members", F.col("b"))).alias("members")).distinct())
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out


def articulation(vertices: DataFrame, edges: DataFrame, group: str) -> DataFrame:
    """Vertices whose loss would cut their group's part: a depth-first search per group, whose vertices must fit a task."""
    import pandas as pd

    inner = induced(vertices, edges, group).join(vertices.select(F.col("id").alias("a"), F.col(group).alias("_g")), "a")
    kind = dict(vertices.dtypes)

    def find(g: pd.DataFrame) -> pd.DataFrame:
        near: dict = {}
        for a, b in zip(g["a"].tolist(), g["b"].tolist(), strict=True):
            near.setdefault(a, []).append(b)
            near.setdefault(b, []).append(a)
        order, low, cut = {}, {}, set()
        for root in sorted(near):
            if root in order:
                continue
            order[root] = low[root] = len(order)
            stack, kids = [(root, None, iter(sorted(near[root])))], 0
            while stack:
                v, parent, rest = stack[-1]
                for w in rest:
                    if w not in order:
                        order[w] = low[w] = len(order)
                        stack.append((w, v, iter(sorted(near[w]))))
                        break
                    if w != parent:
                        low[v] = min(low[v], order[w])
                else:
                    stack.pop()
                    if parent is not None:
                        low[parent] = min(low[parent], low[v])
                        if parent == root:
                            kids += 1
                        elif low[v] >= order[parent]:
                            cut.add(parent)
            if kids > 1:
                cut.add(root)
        return pd.DataFrame({"id": sorted(cut)})

    return inner.groupBy("_g").applyInPandas(find, f"id {kind['id']}")


def nearest(points: DataFrame, sites: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Each point's nearest site, ties to the smaller id. Sites are few: a planning problem's centres."""
    s = F.broadcast(sites.select(F.col("id").alias("site"), F.col(x).alias("_sx"), F.col(y).alias("_sy")))
    d = F.sqrt(F.pow(F.col(x) - F.col("_sx"), F.lit(2)) + F.pow(F.col(y) - F.col("_sy"), F.lit(2)))
    best = F.min(F.struct(d.alias("d"), F.col("site").alias("site"))).alias("_b")
    return points.join(s).groupBy("id").agg(best).select("id", "_b.site", F.col("_b.d").alias("distance"))


def k_means(points: DataFrame, k: int, weight: str, rounds: int = 50, x: str = "x", y: str = "y") -> DataFrame:
    """k weighted centres: the heaviest point, then by weight times squared distance the farthest; then assignment and weighted means until nothing moves. Only centres are on the driver."""
    spark = points.sparkSession
    p = kept(points.select("id", F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.col(weight).cast("double").alias("w")))
    if p.where("w > 0").isEmpty():
        p = p.withColumn("w", F.lit(1.0))
    first = p.orderBy(F.desc("w"), "id").first()
    if first is None:
        return spark.createDataFrame([], "i int, x double, y double")
    centres = [(first.x, first.y)]
    while len(centres) < k:
        d = F.array_min(F.array(*(F.pow(F.col("x") - a, F.lit(2)) + F.pow(F.col("y") - b, F.lit(2)) for a, b in centres)))
        far = p.select("x", "y", "id", "w", d.alias("d"))
        best = far.orderBy(F.desc(F.col("w") * F.col("d")), "id").first()
        if best.w * best.d <= 0:
            best = far.orderBy(F.desc("d"), "id").first()
        if best.d <= 0:
            break
        centres.append((best.x, best.y))
    p = p.where("w > 0")
    for _ in range(rounds):
        near = F.array_min(F.array(*(F.struct((F.pow(F.col("x") - a, F.lit(2)) + F.pow(F.col("y") - b, F.lit(2))).alias("d"), F.lit(i).alias("i")) for i, (a, b) in enumerate(centres))))["i"]
        rows = p.groupBy(near.alias("i")).agg(F.sum("w").alias("w"), F.sum(F.col("x") * F.col("w")).alias("sx"), F.sum(F.col("y") * F.col("w")).alias("sy"), F.avg("x").alias("ax"), F.avg("y").alias("ay")).collect()
        new = list(centres)
        for r in rows:
            new[r.i] = (r.sx / r.w, r.sy / r.w) if r.w > 0 else (r.ax, r.ay)
        if all(abs(a - c) + abs(b - d) < 1e-9 for (a, b), (c, d) in zip(new, centres, strict=True)):
            break
        centres = new
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(centres)], "i int, x double, y double")
