"""Scores, graphs, arithmetic, runs and increments on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from parcelry.operators import arith, graph, ledger, score
from parcelry.operators.rules import rule_table
from parcelry.plans.audits import LEDGER, the_ledger
from parcelry.plans.registry import query, t
from parcelry.plans.resolution import CENTS, dollars
from parcelry.streaming import incremental


@query(f"WITH {LEDGER} SELECT channel, unit, count(DISTINCT district) AS owners, count(DISTINCT district) - 1 AS cuts FROM ledger GROUP BY ALL HAVING count(DISTINCT district) > 1")
def split_units(spark, d):
    return score.split_units(the_ledger(spark, d), ["channel"], "unit", "district")


_tau = "tau AS (SELECT channel, CAST(sum(CAST(m_rel AS DECIMAL(18,2))) AS DOUBLE) / 7 AS tau FROM ledger GROUP BY ALL)"


def tau_of(led):
    return led.groupBy("channel").agg((F.sum(F.col("m_rel").cast(CENTS)).cast("double") / 7).alias("tau"))


@query(f"""
WITH {LEDGER}, {_tau}, p AS (SELECT channel, unit, district, CAST(sum(CAST(m_rel AS DECIMAL(18,2))) AS DOUBLE) AS piece FROM ledger GROUP BY ALL),
n AS (SELECT channel, unit, count(*) AS owners, sum(piece) AS mass, count(*) FILTER (piece < 0.2 * tau) AS small, min(tau) AS tau FROM p JOIN tau USING (channel) GROUP BY ALL)
SELECT channel, unit, owners, CASE WHEN owners > 1 THEN small ELSE 0 END AS small_pieces, owners > ceil(mass / tau) + 1 AS crowded FROM n
""")
def small_crowded(spark, d):
    led = the_ledger(spark, d)
    return score.small_and_crowded(led.withColumn("m_rel", F.col("m_rel").cast(CENTS)).groupBy("channel", "unit", "district").agg(F.sum("m_rel").cast("double").alias("m_rel")), ["channel"], "unit", "district", "m_rel", tau_of(led))


@query("""
WITH p AS (SELECT c_mktsegment AS channel, c_nationkey AS unit, c_custkey % 4 AS district, CAST(sum(CAST(greatest(c_acctbal, 0) AS DECIMAL(18,2))) AS DOUBLE) AS m, sum(c_custkey) AS a FROM customer GROUP BY ALL),
k AS (SELECT * FROM (SELECT *, m / sum(m) OVER (PARTITION BY channel, unit) AS share FROM p) WHERE share >= 0.2)
SELECT channel, unit, count(*) AS pieces, CAST(max(a) AS BIGINT) AS most, CAST(min(a) AS BIGINT) AS least, round(CAST(max(a) AS DOUBLE) / nullif(CAST(min(a) AS DOUBLE), 0), 6) AS ratio FROM k GROUP BY ALL HAVING count(*) > 1
""")
def land_balance(spark, d):
    c = t(spark, d, "customer").select(F.col("c_mktsegment").alias("channel"), F.col("c_nationkey").alias("unit"), (F.col("c_custkey") % 4).alias("district"), F.greatest("c_acctbal", F.lit(0.0)).cast(CENTS).alias("m"), F.col("c_custkey").alias("land"))
    g = c.groupBy("channel", "unit", "district").agg(F.sum("m").cast("double").alias("m"), F.sum("land").alias("land"))
    return score.land_balance(g, ["channel", "unit"], "district", "m", "land").withColumn("ratio", F.round("ratio", 6))


_dist = f"{LEDGER}, dd AS (SELECT channel, district, CAST(sum(CAST(m_rel AS DECIMAL(18,2))) AS DOUBLE) AS mass, list_sort(list(DISTINCT unit)) AS units FROM ledger GROUP BY ALL)"


def districts_of(spark, d):
    led = the_ledger(spark, d)
    return led.groupBy("channel", "district").agg(F.sum(F.col("m_rel").cast(CENTS)).cast("double").alias("mass"), F.array_sort(F.collect_set("unit")).alias("units"))


@query(f"""
WITH {_dist}, m AS (SELECT *, avg(mass) OVER (PARTITION BY channel) AS mean FROM dd)
SELECT channel, round(max(abs(mass / mean - 1)), 6) AS worst, round(avg(abs(mass / mean - 1)), 6) AS mean FROM m GROUP BY ALL
""")
def district_deviation(spark, d):
    out = score.deviations(districts_of(spark, d), ["channel"], "mass")
    return out.select("channel", F.round("worst", 6).alias("worst"), F.round("mean", 6).alias("mean"))


@query(f"""
WITH {_dist}, r(channel, rate) AS (VALUES ('AUTOMOBILE', 2.0), ('BUILDING', 1.5), ('FURNITURE', 1.0), ('HOUSEHOLD', 0.5), ('MACHINERY', 3.0)),
x AS (SELECT dd.*, mass * rate AS dollars, avg(mass * rate) OVER (PARTITION BY dd.channel) AS mean FROM dd JOIN r USING (channel)), w AS (SELECT channel, units FROM dd WHERE district = 'D3')
SELECT x.channel, x.district, round(x.dollars, 3) AS dollars, CASE WHEN x.dollars BETWEEN 0.99 * mean AND 1.05 * mean THEN 'window' WHEN len(x.units) = 1 AND x.dollars <= 1e6 AND x.dollars >= 0.99 * mean THEN 'whole unit'
  WHEN EXISTS (SELECT 1 FROM w WHERE w.channel = x.channel AND w.units = x.units) THEN 'waived' WHEN x.dollars < 0.99 * mean THEN 'under' ELSE 'over' END AS gate FROM x
""")
def dollar_gate(spark, d):
    rates = rule_table(spark, [("AUTOMOBILE", 2.0), ("BUILDING", 1.5), ("FURNITURE", 1.0), ("HOUSEHOLD", 0.5), ("MACHINERY", 3.0)], "channel string, rate double")
    dd = score.dollars(districts_of(spark, d), rates, "channel", "mass")
    window = dd.groupBy("channel").agg((0.99 * F.avg("dollars")).alias("low"), (1.05 * F.avg("dollars")).alias("high"))
    out = score.dollar_gate(dd, window, dd.where("district = 'D3'").select("channel", "units"), 1e6)
    return out.select("channel", "district", F.round("dollars", 3).alias("dollars"), "gate")


_runs = """runs AS (SELECT l_suppkey AS run, l_suppkey % 4 AS lane, count(*) FILTER (l_returnflag = 'R') % 7 AS splits, count(*) FILTER (l_quantity > 45) % 9 AS defects, CASE WHEN l_suppkey % 9 = 0 THEN NULL ELSE max(l_extendedprice) END AS worst FROM lineitem GROUP BY l_suppkey)"""


def runs_of(spark, d):
    g = t(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("run")).agg((F.count_if(F.col("l_returnflag") == "R") % 7).alias("splits"), (F.count_if(F.col("l_quantity") > 45) % 9).alias("defects"), F.max("l_extendedprice").alias("worst"))
    return g.withColumn("lane", F.col("run") % 4).withColumn("worst", F.when(F.col("run") % 9 != 0, F.col("worst")))


@query(f"""
WITH {_runs}, b AS (SELECT *, min(splits) OVER (PARTITION BY lane) AS best FROM runs), c AS (SELECT *, min(CASE WHEN splits = best THEN defects END) OVER (PARTITION BY lane) AS at_best FROM b)
SELECT run, lane, splits, defects, CAST(row_number() OVER (PARTITION BY lane ORDER BY splits, defects, worst NULLS LAST, run) AS INTEGER) AS rank, splits = best + 1 AND defects < at_best AS review FROM c
""")
def rank_review(spark, d):
    ranked = score.ranked(runs_of(spark, d), [("splits", False), ("defects", False), ("worst", False)], "run", ["lane"])
    return score.review(ranked, "splits", "defects", ["lane"]).select("run", "lane", "splits", "defects", "rank", "review")


@query(f"""
WITH {_runs} SELECT run, concat_ws('; ', CASE WHEN splits > 4 THEN 'splits' END, CASE WHEN defects > 5 THEN 'defects' END, CASE WHEN worst IS NULL THEN 'unmeasured' END) AS reasons,
  splits <= 4 AND defects <= 5 AND worst IS NOT NULL AS eligible, CASE WHEN worst IS NULL THEN 'unmeasured' WHEN defects > 5 THEN 'defective' WHEN splits > 4 THEN 'split' ELSE 'ok' END AS outcome FROM runs
""")
def eligibility_outcome(spark, d):
    out = score.eligible(runs_of(spark, d), {"splits": F.col("splits") > 4, "defects": F.col("defects") > 5, "unmeasured": F.col("worst").isNull()})
    label = score.outcome([(F.col("worst").isNull(), "unmeasured"), (F.col("defects") > 5, "defective"), (F.col("splits") > 4, "split")])
    return out.select("run", F.array_join("reasons", "; ").alias("reasons"), "eligible", label.alias("outcome"))


@query(f"""
WITH {_runs}, l AS (SELECT run, 'splits' AS measure, CAST(splits AS DOUBLE) AS value FROM runs UNION ALL SELECT run, 'defects', CAST(defects AS DOUBLE) FROM runs)
SELECT run, l.measure, value, CAST(most AS DOUBLE) AS most FROM l JOIN (VALUES ('splits', 4.0), ('defects', 6.0)) AS m(measure, most) ON m.measure = l.measure WHERE value > most
""")
def shape_breaches(spark, d):
    limits = rule_table(spark, [("splits", 4.0), ("defects", 6.0)], "measure string, most double")
    r = runs_of(spark, d).select("run", F.col("splits").cast("double").alias("splits"), F.col("defects").cast("double").alias("defects"))
    return score.breaches(r, ["run"], limits, ["splits", "defects"]).select("run", "measure", "value", "most")


@query(f"""
WITH {_runs}, l AS (SELECT lane, 'splits' AS measure, CAST(splits AS DOUBLE) AS value FROM runs UNION ALL SELECT lane, 'worst', worst FROM runs)
SELECT lane, measure, round(avg(value), 4) AS mean, min(value) AS least, max(value) AS most, count(*) AS n FROM l WHERE value IS NOT NULL GROUP BY ALL
""")
def shape_summary(spark, d):
    r = runs_of(spark, d).select("lane", F.col("splits").cast("double").alias("splits"), "worst")
    return score.summary(r, ["lane"], ["splits", "worst"]).withColumn("mean", F.round("mean", 4))


@query(f"""
WITH {_dist}, g AS (SELECT dd.*, avg(mass) OVER (PARTITION BY channel) AS mean FROM dd), x AS (SELECT channel, CASE WHEN mass < 0.9 * mean THEN 'under' WHEN mass > 1.1 * mean THEN 'over' END AS gate FROM g)
SELECT channel, 7 AS k, CASE WHEN bool_and(gate = 'under') THEN 6 WHEN bool_and(gate = 'over') THEN 8 END AS next_k FROM x WHERE gate IS NOT NULL GROUP BY ALL
""")
def rerun_k(spark, d):
    from pyspark.sql import Window

    mean = F.avg("mass").over(Window.partitionBy("channel"))
    x = districts_of(spark, d).withColumn("mean", mean).withColumn("gate", F.when(F.col("mass") < 0.9 * F.col("mean"), "under").when(F.col("mass") > 1.1 * F.col("mean"), "over").otherwise("window"))
    return score.next_k(x.withColumn("k", F.lit(7)), ["channel"], "k")


@query("""
WITH u AS (SELECT c_mktsegment AS channel, c_nationkey AS unit, CAST(sum(CAST(greatest(c_acctbal, 0) AS DECIMAL(18,2))) AS DOUBLE) AS mass FROM customer GROUP BY ALL),
g AS (SELECT channel, sum(mass) AS mass, sum(mass) / 6 AS tau FROM u GROUP BY ALL), w AS (SELECT *, 0.8 * tau AS low, CASE channel WHEN 'BUILDING' THEN 0.9 ELSE 1.1 END * tau AS high FROM g)
SELECT channel, round(mass, 2) AS mass, round(tau, 4) AS tau, (SELECT string_agg(CAST(unit AS VARCHAR), ',' ORDER BY unit) FROM u WHERE u.channel = w.channel AND u.mass > w.tau / 2) AS split,
  CASE WHEN tau < low THEN 'tau under the window' WHEN tau > high THEN 'tau over the window' END AS reason, CASE WHEN tau BETWEEN low AND high THEN floor(least(tau - low, high - tau) / tau * 1e4 + 1e-9) / 1e4 END AS delta FROM w
""")
def plan_point(spark, d):
    u = t(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("channel"), F.col("c_nationkey").alias("unit")).agg(F.sum(F.greatest("c_acctbal", F.lit(0.0)).cast(CENTS)).cast("double").alias("mass"))
    out = score.plan_point(u, ["channel"], F.lit(6), 0.8 * F.col("tau"), F.when(F.col("channel") == "BUILDING", 0.9).otherwise(1.1) * F.col("tau"))
    split = F.nullif(F.array_join("split", ","), F.lit(""))
    return out.select("channel", F.round("mass", 2).alias("mass"), F.round("tau", 4).alias("tau"), split.alias("split"), "reason", "delta")


# ---- points: the first two components of the embeddings

POINTS = "pts AS (SELECT vec_id AS id, label AS g, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, 1.0 + vec_id % 5 AS w FROM embeddings)"


def points(spark, d):
    e = t(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("label").alias("g"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"), (1.0 + F.col("vec_id") % 5).alias("w"))


@query(f"""
WITH {POINTS}, v AS (SELECT g, x AS v, sum(w) AS w FROM pts GROUP BY ALL), c AS (SELECT g, v, sum(w) OVER (PARTITION BY g ORDER BY v) AS c, sum(w) OVER (PARTITION BY g) AS t FROM v)
SELECT g, min(v) AS r90 FROM c WHERE c >= 0.9 * t - 1e-12 GROUP BY ALL
""")
def weighted_quantile_r90(spark, d):
    return score.weighted_quantile(points(spark, d), ["g"], "x", "w", 0.9, "r90")


@query(f"WITH {POINTS} SELECT g, round(sum(x * w) / sum(w), 9) AS x, round(sum(y * w) / sum(w), 9) AS y FROM pts GROUP BY ALL")
def weighted_centroid(spark, d):
    c = score.centroids(points(spark, d), ["g"], ["x", "y"], "w")
    return c.select("g", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"))


@query(f"""
WITH {POINTS}, c AS (SELECT g, sum(x * w) / sum(w) AS cx, sum(y * w) / sum(w) AS cy FROM pts GROUP BY ALL)
SELECT g, round(sum(w * ((x - cx) ** 2 + (y - cy) ** 2)), 9) AS inertia, round(sqrt(sum(w * ((x - cx) ** 2 + (y - cy) ** 2)) / sum(w)), 9) AS rms FROM pts JOIN c USING (g) GROUP BY ALL
""")
def dispersion(spark, d):
    out = score.dispersion(points(spark, d), ["g"], "x", "y", "w")
    return out.select("g", F.round("inertia", 9).alias("inertia"), F.round("rms", 9).alias("rms"))


@query(f"WITH {POINTS} SELECT a.g, round(max(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)), 9) AS extent FROM pts a JOIN pts b ON a.g = b.g GROUP BY ALL")
def extent_allpairs(spark, d):
    return score.extents(points(spark, d), ["g"], "x", "y").select("g", F.round("extent", 9).alias("extent"))


@query(f"""
WITH {POINTS}, s AS (SELECT * FROM pts WHERE id % 200 = 1), r AS (SELECT p.id, s.id AS site, sqrt((p.x - s.x) ** 2 + (p.y - s.y) ** 2) AS dist, row_number() OVER (PARTITION BY p.id ORDER BY sqrt((p.x - s.x) ** 2 + (p.y - s.y) ** 2), s.id) AS n FROM pts p CROSS JOIN s)
SELECT id, site, round(dist, 9) AS distance FROM r WHERE n = 1
""")
def nearest_site(spark, d):
    p = points(spark, d)
    return graph.nearest(p, p.where("id % 200 = 1")).withColumn("distance", F.round("distance", 9))


@query(f"""
WITH {LEDGER}, p AS (SELECT district, unit AS metro, CAST(sum(CAST(m_rel AS DECIMAL(18,2))) AS DOUBLE) AS m FROM ledger WHERE unit <> 3 GROUP BY ALL),
s AS (SELECT district, metro, m / sum(m) OVER (PARTITION BY metro) AS of_metro, m / sum(m) OVER (PARTITION BY district) AS of_district FROM p)
SELECT district, metro, round(of_metro, 9) AS of_metro, round(of_district, 9) AS of_district, of_metro >= 0.5 AS core FROM s
""")
def doughnut(spark, d):
    led = the_ledger(spark, d).withColumn("metro", F.when(F.col("unit") != 3, F.col("unit")))
    cells = led.groupBy("district", "metro").agg(F.sum(F.col("m_rel").cast(CENTS)).cast("double").alias("m"))
    out = score.doughnuts(cells, "district", "metro", "m")
    return out.select("district", "metro", F.round("of_metro", 9).alias("of_metro"), F.round("of_district", 9).alias("of_district"), "core")


# ---- graph: nations, joined where much is sold between them

EDGES = """e0 AS (SELECT least(s_nationkey, c_nationkey) AS a, greatest(s_nationkey, c_nationkey) AS b, count(*) AS n FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE s_nationkey <> c_nationkey GROUP BY ALL),
edges AS (SELECT a, b, n FROM e0 WHERE n * 300 > (SELECT sum(n) FROM e0) AND (a + b) % 3 <> 0)"""


def edges(spark, d):
    line = t(spark, d, "lineitem").join(t(spark, d, "supplier"), F.col("s_suppkey") == F.col("l_suppkey")).join(t(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(t(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    e = line.where("s_nationkey <> c_nationkey").groupBy(F.least("s_nationkey", "c_nationkey").alias("a"), F.greatest("s_nationkey", "c_nationkey").alias("b")).agg(F.count("*").alias("n"))
    e = graph.kept(e)
    total = e.agg(F.sum("n").alias("total"))
    return graph.kept(e.crossJoin(F.broadcast(total)).where("n * 300 > total AND (a + b) % 3 <> 0").drop("total"))


def vertices(spark, d):
    return t(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("region"))


CHAIN = "v AS (SELECT c_custkey AS id, c_nationkey FROM customer), e AS (SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON b.id = a.id + 7 WHERE a.c_nationkey % 3 <> 0)"


@query(f"""
WITH RECURSIVE {CHAIN}, two AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), r(id, root) AS (SELECT id, id FROM v UNION SELECT two.b, r.root FROM r JOIN two ON two.a = r.id AND r.root <= two.b)
SELECT id, min(root) AS component FROM r GROUP BY ALL
""")
def components(spark, d):
    v = t(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_nationkey")
    e = v.where("c_nationkey % 3 <> 0").select(F.col("id").alias("a"), (F.col("id") + 7).alias("b")).join(v.select(F.col("id").alias("b")), "b", "left_semi")
    return graph.components(v, e).select("id", "component")


@query(f"""
WITH RECURSIVE {EDGES}, two AS (SELECT a, b FROM edges UNION ALL SELECT b, a FROM edges), r(id, depth) AS (SELECT 0, 0 UNION SELECT two.b, r.depth + 1 FROM r JOIN two ON two.a = r.id WHERE r.depth < 25)
SELECT id, min(depth) AS depth FROM r GROUP BY ALL
""")
def reachability(spark, d):
    return graph.reachable(vertices(spark, d), edges(spark, d), vertices(spark, d).where("id = 0"))


@query(f"""
WITH RECURSIVE {EDGES}, two AS (SELECT a, b FROM edges UNION ALL SELECT b, a FROM edges), w AS (SELECT n_nationkey AS id, 1.0 + n_nationkey % 3 AS w FROM nation),
r(id, cost, hops) AS (SELECT 0, CAST(0 AS DOUBLE), 0 UNION SELECT two.b, r.cost + w.w, r.hops + 1 FROM r JOIN two ON two.a = r.id JOIN w ON w.id = two.b WHERE r.hops < 12)
SELECT id, min(cost) AS cost FROM r GROUP BY ALL
""")
def shortest_paths(spark, d):
    v = vertices(spark, d).withColumn("w", 1.0 + F.col("id") % 3)
    return graph.shortest_paths(v, edges(spark, d), v.where("id = 0"), "w")


@query(f"""
WITH RECURSIVE {EDGES}, two AS (SELECT a, b FROM edges UNION ALL SELECT b, a FROM edges), v AS (SELECT n_nationkey AS id, n_regionkey AS region FROM nation), s(id, owner) AS (VALUES (0, 10), (6, 20), (17, 30)),
inner_ AS (SELECT two.a, two.b FROM two JOIN v x ON x.id = two.a JOIN v y ON y.id = two.b WHERE x.region = y.region),
g1(id, owner, depth) AS (SELECT id, owner, 0 FROM s UNION SELECT i.b, g1.owner, g1.depth + 1 FROM g1 JOIN inner_ i ON i.a = g1.id WHERE g1.depth < 25),
d1 AS (SELECT id, min(depth) AS depth FROM g1 GROUP BY ALL)
SELECT id, CASE WHEN id IN (SELECT id FROM s) THEN 0 ELSE 1 END AS stage FROM d1
UNION ALL SELECT id, 2 FROM (WITH RECURSIVE g2(id, depth) AS (SELECT id, 0 FROM d1 UNION SELECT two.b, g2.depth + 1 FROM g2 JOIN two ON two.a = g2.id WHERE g2.depth < 25) SELECT DISTINCT id FROM g2) WHERE id NOT IN (SELECT id FROM d1)
""")
def staged_growth(spark, d):
    seeds = rule_table(spark, [(0, 10), (6, 20), (17, 30)], "id int, owner int")
    return graph.staged_growth(vertices(spark, d), edges(spark, d), seeds, ["region"]).select("id", "stage")


@query(f"""
WITH {EDGES}, q AS (SELECT least(x.n_regionkey, y.n_regionkey) AS u, greatest(x.n_regionkey, y.n_regionkey) AS v, n FROM edges JOIN nation x ON x.n_nationkey = a JOIN nation y ON y.n_nationkey = b WHERE x.n_regionkey <> y.n_regionkey)
SELECT u, v, count(*) AS edges, CAST(sum(n) AS BIGINT) AS n FROM q GROUP BY ALL
""")
def quotient_graph(spark, d):
    return graph.quotient(vertices(spark, d), edges(spark, d), "region", "n")


@query(f"""
WITH {EDGES}, two AS (SELECT a, b FROM edges UNION ALL SELECT b, a FROM edges)
SELECT x.n_regionkey AS u, y.n_regionkey AS v, count(DISTINCT b) AS vertices FROM two JOIN nation x ON x.n_nationkey = a JOIN nation y ON y.n_nationkey = b WHERE x.n_regionkey <> y.n_regionkey GROUP BY ALL
""")
def border_vertices(spark, d):
    return graph.borders(vertices(spark, d), edges(spark, d), "region")


@query(f"""
WITH {EDGES}, q AS (SELECT least(a % 4, b % 4) AS u, greatest(a % 4, b % 4) AS v FROM edges WHERE a % 4 <> b % 4) SELECT u, v, count(*) AS edges FROM q GROUP BY ALL
""")
def cut_edges(spark, d):
    return graph.cut_edges(vertices(spark, d).withColumn("district", F.col("id") % 4), edges(spark, d), "district")


@query(f"""
WITH {EDGES}, two AS (SELECT a, b FROM edges UNION ALL SELECT b, a FROM edges), o AS (SELECT n_nationkey AS id, n_regionkey AS unit, n_nationkey % 4 AS district FROM nation)
SELECT x.district, x.unit, CAST(sum(n) AS BIGINT) AS border FROM (SELECT a, b, n FROM edges UNION ALL SELECT b, a, n FROM edges) e JOIN o x ON x.id = e.a JOIN o y ON y.id = e.b WHERE x.district = y.district AND x.unit <> y.unit GROUP BY ALL HAVING sum(n) < (SELECT 4 * avg(n) FROM edges)
""")
def thin_links(spark, d):
    e = edges(spark, d)
    owners = vertices(spark, d).select(F.col("id").alias("vertex"), F.col("region").alias("unit"), (F.col("id") % 4).alias("district"))
    mean = e.agg(4 * F.avg("n")).first()[0]
    return score.thin_links(e, owners, "n", mean or 0.0)


@query(f"""
WITH RECURSIVE {EDGES}, vv AS (SELECT n_nationkey AS id, n_nationkey % 4 AS district, CAST(n_nationkey + 1 AS DOUBLE) AS m FROM nation), two AS (SELECT a, b FROM edges UNION ALL SELECT b, a FROM edges),
inn AS (SELECT a, b FROM two JOIN vv x ON x.id = a JOIN vv y ON y.id = b WHERE x.district = y.district), r(id, root) AS (SELECT id, id FROM vv UNION SELECT inn.b, r.root FROM r JOIN inn ON inn.a = r.id),
c AS (SELECT id, min(root) AS component FROM r GROUP BY ALL), p AS (SELECT district, component, count(*) AS vertices, sum(m) AS mass FROM c JOIN vv USING (id) GROUP BY ALL),
q AS (SELECT *, row_number() OVER (PARTITION BY district ORDER BY mass DESC, vertices DESC, component) AS n FROM p), tau AS (SELECT avg(m) AS tau FROM (SELECT sum(mass) AS m FROM p GROUP BY district))
SELECT district, count(*) AS pieces, round(sum(CASE WHEN n > 1 THEN 1 + mass / tau ELSE 0 END), 9) AS weight FROM q, tau GROUP BY ALL
""")
def contiguity(spark, d):
    led = vertices(spark, d).withColumns({"district": F.col("id") % 4, "m": (F.col("id") + 1).cast("double")})
    out = graph.contiguity(led, edges(spark, d), ["district"], "id", "m")
    return out.withColumn("weight", F.round("weight", 9))


@query(f"""
WITH {EDGES}, two AS (SELECT a, b FROM edges UNION ALL SELECT b, a FROM edges), l1 AS (SELECT [n_nationkey] AS m FROM nation),
l2 AS (SELECT DISTINCT list_sort([a, b]) AS m FROM two), l3 AS (SELECT DISTINCT list_sort(list_append(l2.m, two.b)) AS m FROM l2 JOIN two ON (two.a = l2.m[1] OR two.a = l2.m[2]) WHERE NOT list_contains(l2.m, two.b))
SELECT array_to_string(m, ',') AS members, len(m) AS size FROM (SELECT m FROM l1 UNION ALL SELECT m FROM l2 UNION ALL SELECT m FROM l3)
""")
def connected_subsets(spark, d):
    s = graph.connected_subsets(vertices(spark, d), edges(spark, d), 3)
    return s.select(F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"), F.size("members").cast("long").alias("size"))


# ---- arithmetic

@query("""
WITH p AS (SELECT n_regionkey AS part, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS mass FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL), tot AS (SELECT sum(mass) / 9 AS target FROM p),
k AS (SELECT unnest([1, 2, 3, 4, 5]) AS k), c AS (SELECT part, k, abs(mass / k / target - 1) AS dev FROM p, tot, k),
s AS (SELECT c0.k AS k0, c1.k AS k1, c2.k AS k2, c3.k AS k3, c4.k AS k4, greatest(c0.dev, c1.dev, c2.dev, c3.dev, c4.dev) AS worst FROM c c0, c c1, c c2, c c3, c c4
  WHERE c0.part = 0 AND c1.part = 1 AND c2.part = 2 AND c3.part = 3 AND c4.part = 4 AND c0.k + c1.k + c2.k + c3.k + c4.k = 9)
SELECT 9 AS total, round(min(worst), 9) AS worst FROM s
""")
def allocation_dp(spark, d):
    c = t(spark, d, "customer").join(t(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    p = c.groupBy(F.col("n_regionkey").alias("part")).agg(F.sum(F.col("c_acctbal").cast(CENTS)).cast("double").alias("mass"))
    target = p.agg(F.sum("mass") / 9).first()[0]
    a = arith.allocations(p, 9, F.lit(target), 5)
    return a.agg(F.sum("k").cast("int").alias("total"), F.round(F.max("worst"), 9).alias("worst"))


@query("""
WITH u AS (SELECT n_regionkey AS region, n_nationkey AS unit, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS mass FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL), c AS (SELECT avg(mass) AS cap FROM u)
SELECT region, round(sum(mass), 2) AS mass, CAST(sum(greatest(ceil(mass / cap - 1e-9) - 1, 0)) AS BIGINT) AS forced_splits, count(*) AS units, CAST(ceil(sum(mass) / (1.3 * min(cap)) - 1e-9) AS BIGINT) AS k_low, CAST(floor(sum(mass) / (1.1 * min(cap)) + 1e-9) AS BIGINT) AS k_high,
  ceil(sum(mass) / (1.3 * min(cap)) - 1e-9) <= floor(sum(mass) / (1.1 * min(cap)) + 1e-9) AS fits FROM u, c GROUP BY ALL
""")
def forced_splits(spark, d):
    c = t(spark, d, "customer").join(t(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    u = c.groupBy(F.col("n_regionkey").alias("region"), F.col("n_nationkey").alias("unit")).agg(F.sum(F.col("c_acctbal").cast(CENTS)).cast("double").alias("mass"))
    cap = u.agg(F.avg("mass")).first()[0]
    return arith.region_table(u, ["region"], 1.1 * cap, 1.3 * cap, cap).withColumn("mass", F.round("mass", 2))


@query("""
SELECT k, mode, delta, substr(sha256('delta=' || delta || ';k=' || k || ';mode=' || mode), 1, 16) AS run_id
FROM (SELECT unnest(['4', '5', '6']) AS k), (SELECT unnest(['whole', 'clipped']) AS mode), (SELECT unnest(['0.05', '0.1']) AS delta)
""")
def grid_runs(spark, d):
    return arith.grid(spark, {"k": [4, 5, 6], "mode": ["whole", "clipped"], "delta": [0.05, 0.1]})


@query("""
SELECT event_type AS lane, count(*) AS runs, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k, min(ts) AS started_at, max(ts) AS finished_at, substr(sha256(event_type), 1, 8) AS id FROM events GROUP BY ALL
""")
def run_index(spark, d):
    e = t(spark, d, "events").withColumn("k", F.from_json("props", "k bigint")["k"])
    return e.groupBy(F.col("event_type").alias("lane")).agg(F.count("*").alias("runs"), F.sum("k").alias("k"), F.min("ts").alias("started_at"), F.max("ts").alias("finished_at")).withColumn("id", F.substring(F.sha2("lane", 256), 1, 8))


@query("""
SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events GROUP BY ALL
""")
def windowed_totals(spark, d):
    return incremental.windowed(t(spark, d, "events"), "ts", ["event_type"], "value").withColumn("total", dollars(F.col("total")))


@query("""
WITH l AS (SELECT s_nationkey AS county, s_suppkey AS place, s_acctbal + 1000 AS land FROM supplier), c AS (SELECT c_nationkey AS county, CAST(count(*) AS DOUBLE) AS total FROM customer GROUP BY ALL)
SELECT place, county, round(land / sum(land) OVER (PARTITION BY county) * total, 6) AS population FROM l JOIN c USING (county)
""")
def allocated_population(spark, d):
    land = t(spark, d, "supplier").select(F.col("s_nationkey").alias("county"), F.col("s_suppkey").alias("place"), (F.col("s_acctbal") + 1000).alias("land"))
    total = t(spark, d, "customer").groupBy(F.col("c_nationkey").alias("county")).agg(F.count("*").cast("double").alias("total"))
    return ledger.dealt(total, land).select("place", "county", F.round("population", 6).alias("population"))


@query("""
SELECT place, geoid FROM (SELECT *, row_number() OVER (PARTITION BY place ORDER BY land DESC, geoid) AS n FROM (SELECT c_nationkey AS place, c_mktsegment AS geoid, sum(CAST(c_acctbal AS DECIMAL(18,2))) AS land FROM customer GROUP BY ALL)) WHERE n = 1
""")
def primary_area(spark, d):
    b = t(spark, d, "customer").groupBy(F.col("c_nationkey").alias("place"), F.col("c_mktsegment").alias("geoid")).agg(F.sum(F.col("c_acctbal").cast(CENTS)).alias("land"))
    return ledger.primary(b, "place", "geoid", "land")


@query("""
WITH x AS (SELECT o_custkey AS unit, o_orderstatus AS district, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS m FROM orders GROUP BY ALL), s AS (SELECT unit, district, floor(m / sum(m) OVER (PARTITION BY unit) * 1000) / 1000 AS share FROM x),
r AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY share DESC, district) AS n, sum(share) OVER (PARTITION BY unit) AS t FROM s)
SELECT unit, district, round(CASE WHEN n = 1 THEN 1 - (t - share) ELSE share END, 6) AS share FROM r
""")
def decoded_shares(spark, d):
    from pyspark.sql import Window

    m = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("unit"), F.col("o_orderstatus").alias("district")).agg(F.sum(F.col("o_totalprice").cast(CENTS)).cast("double").alias("m"))
    s = m.withColumn("share", F.floor(F.col("m") / F.sum("m").over(Window.partitionBy("unit")) * 1000) / 1000)
    return ledger.decoded(s.select("unit", "district", "share")).withColumn("share", F.round("share", 6))


@query("""
WITH s AS (SELECT c_mktsegment AS channel, c_custkey % 10 AS support, c_nationkey AS unit FROM customer GROUP BY ALL)
SELECT 'cover:' || channel || ':' || unit AS row, 'share:' || channel || ':' || support || ':' || unit AS col, 1.0::DOUBLE AS coef FROM s
UNION ALL SELECT DISTINCT 'count:' || channel, 'open:' || channel || ':' || support, 1.0::DOUBLE FROM s
""")
def support_model(spark, d):
    """The support model of all customers; support_model is of a few, as its SQL says."""
    s = t(spark, d, "customer").select(F.col("c_mktsegment").alias("channel"), (F.col("c_custkey") % 10).alias("support"), F.col("c_nationkey").alias("unit")).distinct()
    return ledger.support_rows(s, s.select("channel").distinct().withColumn("k", F.lit(3)))


@query("""
WITH a AS (SELECT p_partkey AS path, sha256(p_name) AS sha FROM part WHERE p_partkey % 5 <> 0), f AS (SELECT p_partkey AS path, CASE WHEN p_partkey % 7 = 0 THEN 'x' ELSE sha256(p_name) END AS sha FROM part WHERE p_partkey % 11 <> 0)
SELECT a.path, CASE WHEN f.sha IS NULL THEN 'missing' ELSE 'differs' END AS what FROM a LEFT JOIN f ON f.path = a.path WHERE f.sha IS DISTINCT FROM a.sha
""")
def hash_differences(spark, d):
    p = t(spark, d, "part").select(F.col("p_partkey").alias("path"), F.sha2("p_name", 256).alias("sha"))
    found = p.where("path % 11 <> 0").withColumn("sha", F.when(F.col("path") % 7 == 0, "x").otherwise(F.col("sha")))
    return score.hash_differences(p.where("path % 5 <> 0"), found)
