"""Looks and reports on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from parcelry.operators import graph, looks, master, score
from parcelry.plans.audits import LEDGER, the_ledger
from parcelry.plans.registry import query, t
from parcelry.plans.resolution import CENTS


@query(f"""
WITH {LEDGER}, x AS (SELECT channel || ':' || n_regionkey AS district, zip, CAST(m_rel AS DECIMAL(18,2)) AS m FROM ledger JOIN nation ON n_nationkey = unit AND n_regionkey <> 4)
SELECT district, count(*) AS cells, CAST(sum(m) AS DOUBLE) AS mass FROM x GROUP BY ALL
""")
def relabelled_measure(spark, d):
    """The ledger under the regions' hierarchy, measured again; units of one region are outside."""
    dim = t(spark, d, "nation").where("n_regionkey <> 4").select(F.col("n_nationkey").alias("unit"), F.col("n_regionkey").cast("string").alias("region"))
    out = looks.relabelled(the_ledger(spark, d), dim, "unit", "region")
    return out.groupBy("district").agg(F.count("*").alias("cells"), F.sum(F.col("m_rel").cast(CENTS)).cast("double").alias("mass"))


@query("""
WITH RECURSIVE p AS (SELECT s_suppkey AS id, 0 AS part, s_nationkey % 4 AS district, 1 + s_suppkey % 5 AS area FROM supplier UNION ALL SELECT s_suppkey, 1, s_nationkey % 4, 1 FROM supplier WHERE s_suppkey % 3 = 0),
n AS (SELECT id || '/' || part AS v, id, district, area FROM p),
e AS (SELECT x.v AS a, y.v AS b FROM n x JOIN n y ON y.district = x.district AND x.v <> y.v AND ((x.v LIKE '%/0' AND y.v LIKE '%/0' AND y.id = x.id + 25) OR (x.v LIKE '%/1' AND y.v LIKE '%/1' AND y.id = x.id + 75))),
two AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), r(v, root) AS (SELECT v, v FROM n UNION SELECT two.b, r.root FROM r JOIN two ON two.a = r.v AND r.root <= two.b),
c AS (SELECT v, min(root) AS piece FROM r GROUP BY 1), g AS (SELECT district, piece, count(DISTINCT id) AS places, sum(area) AS area FROM n JOIN c USING (v) GROUP BY ALL)
SELECT district, piece, places, CAST(area AS BIGINT) AS area FROM (SELECT *, row_number() OVER (PARTITION BY district ORDER BY area DESC, piece) AS k FROM g) WHERE k > 1
""")
def multipart_pieces(spark, d):
    """Places of one or two parts; first parts touch the place 25 numbers on, second parts the one 75 on."""
    s = t(spark, d, "supplier")
    key, dist = F.col("s_suppkey"), (F.col("s_nationkey") % 4).alias("district")
    parts = s.select(key.alias("id"), F.lit(0).alias("part"), (1 + key % 5).alias("area")).unionByName(s.where(key % 3 == 0).select(key.alias("id"), F.lit(1).alias("part"), F.lit(1).cast("long").alias("area")))
    e = s.select(key.alias("a"), F.lit(0).alias("a_part"), (key + 25).alias("b"), F.lit(0).alias("b_part")).unionByName(s.where(key % 3 == 0).select(key.alias("a"), F.lit(1).alias("a_part"), (key + 75).alias("b"), F.lit(1).alias("b_part")))
    out = looks.part_pieces(parts, e, s.select(key.alias("id"), dist), "district")
    return out.select("district", "piece", F.size("places").cast("long").alias("places"), F.col("area").cast("long").alias("area"))


@query("""
WITH sc AS (SELECT c_nationkey AS run, c_mktsegment AS channel, count(*) AS k, CASE WHEN c_nationkey % 5 = 2 AND c_mktsegment = 'BUILDING' THEN NULL ELSE count(*) FILTER (c_acctbal > 0) END AS within10, count(*) FILTER (c_acctbal < 0) / 1000 AS worst, count(*) FILTER (c_custkey % 2 = 0) AS splits, count(*) FILTER (c_custkey % 3 = 0) AS thin, count(*) FILTER (c_custkey % 5 = 0) AS small FROM customer WHERE c_nationkey <> 7 GROUP BY c_nationkey, c_mktsegment),
f AS (SELECT run, sum(k) AS districts, CASE WHEN count(within10) = count(*) THEN sum(within10) END AS within10, round(100 * max(worst), 1) AS worst, sum(splits) AS splits, sum(thin) AS thin, sum(small) AS small FROM sc GROUP BY 1)
SELECT n_regionkey AS tier, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS INTEGER) AS rank, n_name AS id, CAST(districts AS BIGINT) AS districts, CAST(within10 AS BIGINT) AS within10, worst, CAST(splits AS BIGINT) AS splits, CAST(thin AS BIGINT) AS thin, CAST(small AS BIGINT) AS small, CASE WHEN n_nationkey % 4 <> 0 THEN CASE WHEN n_nationkey % 3 = 0 THEN 'fail' ELSE 'pass' END END AS verdict
FROM nation LEFT JOIN f ON f.run = n_nationkey
""")
def shortlist_index(spark, d):
    """A shortlist of runs (nations) by tier, with figures from their score files and verdicts; one run has no score, some no verdict."""
    from pyspark.sql import Window

    n, key, neg = t(spark, d, "nation"), F.col("c_custkey"), F.col("c_acctbal") < 0
    rank = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey"))
    entries = n.select(F.col("n_regionkey").alias("tier"), rank.alias("rank"), F.col("n_name").alias("id"), F.col("n_nationkey").alias("run"))
    g = t(spark, d, "customer").where("c_nationkey <> 7").groupBy(F.col("c_nationkey").alias("run"), F.col("c_mktsegment").alias("channel"))
    scores = g.agg(F.count("*").alias("k"), F.count_if(F.col("c_acctbal") > 0).alias("w"), (F.count_if(neg) / 1000).alias("worst"), F.count_if(key % 2 == 0).alias("splits"), F.count_if(key % 3 == 0).alias("thin"), F.count_if(key % 5 == 0).alias("small"))
    scores = scores.withColumn("within10", F.when(~((F.col("run") % 5 == 2) & (F.col("channel") == "BUILDING")), F.col("w")))
    verdicts = n.where("n_nationkey % 4 <> 0").select(F.col("n_nationkey").alias("run"), F.when(F.col("n_nationkey") % 3 == 0, "fail").otherwise("pass").alias("verdict"))
    return looks.shortlist(entries, scores, verdicts).drop("run")


@query("""
WITH x AS (SELECT n_nationkey AS id, CASE n_regionkey WHEN 0 THEN 'ok' WHEN 1 THEN 'review' WHEN 2 THEN 'fail' ELSE 'odd' END AS label, CASE WHEN n_nationkey % 6 <> 0 THEN n_nationkey * 7 % 11 END AS key, CASE WHEN n_nationkey % 2 = 0 THEN 'p' || (n_nationkey % 4) END AS pair FROM nation),
a AS (SELECT *, row_number() OVER (ORDER BY CASE label WHEN 'ok' THEN 1 WHEN 'review' THEN 2 WHEN 'fail' THEN 3 ELSE 4 END, key NULLS LAST, id) AS p FROM x), b AS (SELECT *, min(p) OVER (PARTITION BY label, coalesce(pair, 'id ' || id)) AS f FROM a)
SELECT id, label, key, pair, CAST(row_number() OVER (ORDER BY f, p) AS INTEGER) AS place FROM b
""")
def morning_report(spark, d):
    k, r = F.col("n_nationkey"), F.col("n_regionkey")
    label = F.when(r == 0, "ok").when(r == 1, "review").when(r == 2, "fail").otherwise("odd")
    x = t(spark, d, "nation").select(k.alias("id"), label.alias("label"), F.when(k % 6 != 0, k * 7 % 11).alias("key"), F.when(k % 2 == 0, F.concat(F.lit("p"), (k % 4).cast("string"))).alias("pair"))
    return looks.morning_order(x, ["ok", "review", "fail"])


@query("SELECT count(*) AS districts, CAST(5 AS BIGINT) AS colours, CAST(0 AS BIGINT) AS conflicts FROM nation")
def colours(spark, d):
    """Nations of one region are near each other: five colours suffice, and none meets itself."""
    n = t(spark, d, "nation").select(F.col("n_nationkey").alias("district"), "n_regionkey")
    x, y = n.toDF("a", "r"), n.toDF("b", "r")
    near = x.join(y, "r").where("a < b").select("a", "b")
    c = looks.coloured(n, near, 5)
    met = near.join(c.toDF("a", "ca"), "a").join(c.toDF("b", "cb"), "b").agg(F.count_if(F.col("ca") == F.col("cb")).alias("conflicts"))
    return c.agg(F.count("*").alias("districts"), F.countDistinct("colour").alias("colours")).crossJoin(met)


@query(f"""
WITH {LEDGER}, dom AS (SELECT DISTINCT unit, fine, CASE WHEN unit % 2 = 0 THEN 'even' ELSE 'odd' END AS channel FROM ledger WHERE fine <> 'MACHINERY')
SELECT dom.channel, unit, CAST(sum(CAST(m_rel AS DECIMAL(18,2))) AS DOUBLE) AS mass, count(*) AS cells FROM ledger JOIN dom USING (unit, fine) GROUP BY ALL
""")
def domain_masses(spark, d):
    led = the_ledger(spark, d).withColumn("m_rel", F.col("m_rel").cast(CENTS))
    dom = led.where("fine <> 'MACHINERY'").select("unit", "fine", F.when(F.col("unit") % 2 == 0, "even").otherwise("odd").alias("channel")).distinct()
    out = looks.domain_masses(led.select("zip", "fine", "m_rel"), led.select("zip", "unit").distinct(), dom)
    return out.select("channel", "unit", F.col("mass").cast("double").alias("mass"), F.col("cells").cast("long").alias("cells"))


@query(f"WITH {LEDGER} SELECT zip, fine, unit, m_rel FROM ledger WHERE fine = 'BUILDING' OR (fine = 'FURNITURE' AND unit IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1))")
def extract_cut(spark, d):
    """Cells of one region for one fine channel, and another fine channel wherever it is."""
    units = t(spark, d, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("unit"), F.lit("FURNITURE").alias("fine"))
    cells = units.unionByName(spark.createDataFrame([(None, "BUILDING")], "unit long, fine string"))
    return looks.cut(the_ledger(spark, d).select("zip", "fine", "unit", "m_rel"), cells)


@query(f"""
WITH {LEDGER}, v AS (SELECT l.channel, l.district, CAST(sum(CAST(l.zip * 1.5 AS DECIMAL(18,2)) * (length(l.channel))) AS DOUBLE) AS usd, count(DISTINCT unit) AS units FROM ledger l GROUP BY ALL), w AS (SELECT channel, 0.9 * avg(usd) AS low, 1.1 * avg(usd) AS high FROM v GROUP BY 1)
SELECT channel, district, round(usd, 2) AS dollars, CASE WHEN usd BETWEEN low AND high THEN 'window' WHEN units = 1 AND usd >= low AND usd <= 100 THEN 'whole unit' WHEN usd < low THEN 'under' ELSE 'over' END AS gate FROM v JOIN w USING (channel)
""")
def revalued_gate(spark, d):
    """The ledger's cells at the full extract's exact values, then at their channel's rate through the dollar gate."""
    led = the_ledger(spark, d)
    full = t(spark, d, "customer").select(F.col("c_custkey").alias("zip"), F.col("c_mktsegment").alias("channel"), (F.col("c_custkey") * 1.5).cast(CENTS).alias("m_rel"))
    cells = looks.revalued(led, full, ["zip", "channel"], "m_rel")
    dist = cells.groupBy("channel", "district").agg(F.sum("m_rel").cast("double").alias("mass"), F.collect_set("unit").alias("units"))
    rates = led.select("channel").distinct().withColumn("rate", F.length("channel").cast("double"))
    usd = score.dollars(dist, rates, "channel", "mass")
    window = usd.groupBy("channel").agg((0.9 * F.avg("dollars")).alias("low"), (1.1 * F.avg("dollars")).alias("high"))
    waivers = spark.createDataFrame([], "channel string, units array<bigint>")
    return score.dollar_gate(usd, window, waivers, 100.0).select("channel", "district", F.round("dollars", 2).alias("dollars"), "gate")


_MASTER = """
sup AS (SELECT DISTINCT 'r' || (s_suppkey % 3) AS channel, s_suppkey % 12 AS support, s_nationkey AS unit FROM supplier),
ch AS (SELECT DISTINCT channel, CASE channel WHEN 'r0' THEN 3 ELSE 2 END AS k, CASE channel WHEN 'r0' THEN 0.25 ELSE 0.4 END AS eta, 0.9 AS low, 1.1 AS high FROM sup),
ms AS (SELECT c.channel, n_nationkey AS unit, CAST(1 + n_nationkey % 5 AS DOUBLE) / 4 AS mass FROM nation CROSS JOIN ch c),
near AS (SELECT channel, p.n_nationkey AS a, q.n_nationkey AS b FROM ch, nation p, nation q WHERE q.n_nationkey = p.n_nationkey + 1 OR q.n_nationkey = p.n_nationkey + 5),
b2 AS (SELECT channel, a AS unit, b AS "by" FROM near UNION SELECT channel, b, a FROM near),
sg AS (SELECT s.channel, s.support, s.unit, min(b2."by") AS "by" FROM sup s JOIN b2 ON b2.channel = s.channel AND b2.unit = s.unit JOIN sup o ON o.channel = s.channel AND o.support = s.support AND o.unit = b2."by" GROUP BY ALL HAVING count(DISTINCT b2."by") = 1),
op AS (SELECT DISTINCT channel, support FROM sup), x AS (SELECT s.*, 'open:' || s.channel || ':' || support AS n, 'share:' || s.channel || ':' || support || ':' || s.unit AS t, ms.mass, k, eta, low, high FROM sup s JOIN ms ON ms.channel = s.channel AND ms.unit = s.unit JOIN ch ON ch.channel = s.channel),
o AS (SELECT op.*, 'open:' || op.channel || ':' || support AS n, k, eta, low, high FROM op JOIN ch ON ch.channel = op.channel),
r AS (SELECT 'count' AS kind, 'count:' || channel AS row, n AS col, 1.0 AS coef, k AS low, k AS high FROM o
 UNION ALL SELECT 'cover', 'cover:' || channel || ':' || unit, t, 1, 1, 1 FROM x
 UNION ALL SELECT 'eta', 'eta:' || channel || ':' || support || ':' || unit, t, 1, 0, NULL FROM x UNION ALL SELECT 'eta', 'eta:' || channel || ':' || support || ':' || unit, n, -eta, 0, NULL FROM x
 UNION ALL SELECT 'whole', 'whole:' || channel || ':' || support || ':' || unit, n, 1, 0, NULL FROM x UNION ALL SELECT 'whole', 'whole:' || channel || ':' || support || ':' || unit, t, -1, 0, NULL FROM x
 UNION ALL SELECT 'band_lo', 'band_lo:' || channel || ':' || support, t, mass, 0, NULL FROM x UNION ALL SELECT 'band_lo', 'band_lo:' || channel || ':' || support, n, -low, 0, NULL FROM o
 UNION ALL SELECT 'band_hi', 'band_hi:' || channel || ':' || support, t, -mass, 0, NULL FROM x UNION ALL SELECT 'band_hi', 'band_hi:' || channel || ':' || support, n, high, 0, NULL FROM o
 UNION ALL SELECT 'hold', 'hold:' || channel || ':' || support || ':' || unit, t, 1, 0, 0 FROM x WHERE unit % 4 = 0 UNION ALL SELECT 'hold', 'hold:' || channel || ':' || support || ':' || unit, n, -1, 0, 0 FROM x WHERE unit % 4 = 0
 UNION ALL SELECT DISTINCT 'once', 'once:' || channel || ':' || support, n, 1, CAST(NULL AS INTEGER), 1 FROM x WHERE unit % 4 = 0
 UNION ALL SELECT 'contact', 'contact:' || channel || ':' || unit, n, 1, NULL, 2 + unit % 3 FROM x WHERE unit % 2 = 1
 UNION ALL SELECT 'eta_cap', 'eta_cap:' || channel || ':' || unit, n, 1, NULL, floor(1 / eta + 1e-9) FROM x
 UNION ALL SELECT 'count_cap', 'count_cap:' || channel || ':' || unit, n, 1, NULL, 1 + unit FROM x
 UNION ALL SELECT 'corridor', 'corridor:' || channel || ':' || support || ':' || unit, t, mass, 0, NULL FROM x WHERE (support + unit) % 5 = 0 UNION ALL SELECT 'corridor', 'corridor:' || channel || ':' || support || ':' || unit, n, -(0.1 + support / 100.0), 0, NULL FROM x WHERE (support + unit) % 5 = 0
 UNION ALL SELECT 'border', 'border:' || channel || ':' || unit || ':' || "by", 'open:' || channel || ':' || support, 1, NULL, 1 + abs(unit - "by") % 3 FROM sg
 UNION ALL SELECT 'ban', 'ban:' || channel || ':' || support, n, 1, 0, 0 FROM o WHERE support = 7)
"""


@query(f"WITH {_MASTER} SELECT kind, row, col, round(CAST(coef AS DOUBLE), 9) AS coef, CAST(low AS DOUBLE) AS low, CAST(high AS DOUBLE) AS high FROM r")
def support_master(spark, d):
    """Every kind of row of the master, on supports that suppliers make."""
    s, n = t(spark, d, "supplier"), t(spark, d, "nation").select(F.col("n_nationkey").alias("unit"))
    sup = s.select(F.concat(F.lit("r"), (F.col("s_suppkey") % 3).cast("string")).alias("channel"), (F.col("s_suppkey") % 12).alias("support"), F.col("s_nationkey").alias("unit")).distinct()
    first = F.col("channel") == "r0"
    ch = sup.select("channel").distinct().select("channel", F.when(first, 3).otherwise(2).alias("k"), F.when(first, 0.25).otherwise(0.4).alias("eta"), F.lit(0.9).alias("low"), F.lit(1.1).alias("high"))
    every = n.crossJoin(F.broadcast(ch.select("channel")))
    near = every.select("channel", F.col("unit").alias("a"), F.explode(F.array(F.col("unit") + 1, F.col("unit") + 5)).alias("b")).join(n.withColumnRenamed("unit", "b"), "b").select("channel", "a", "b")
    both = near.select("channel", F.col("a").alias("unit"), F.col("b").alias("by")).unionByName(near.select("channel", F.col("b").alias("unit"), F.col("a").alias("by")))
    rows = master.master(
        sup,
        ch,
        every.select("channel", "unit", ((1 + F.col("unit") % 5) / 4).alias("mass")),
        held=every.where("unit % 4 = 0"),
        caps=every.where("unit % 2 = 1").select("channel", "unit", (2 + F.col("unit") % 3).alias("cap")),
        places=every.select("channel", "unit", (1 + F.col("unit")).alias("places")),
        floors=sup.where("(support + unit) % 5 = 0").select("channel", "support", "unit", (0.1 + F.col("support") / 100).alias("floor")),
        banned=sup.where("support = 7").select("channel", "support").distinct(),
        near=near,
        borders=both.select("channel", "unit", "by", (1 + F.abs(F.col("unit") - F.col("by")) % 3).alias("border")),
    )
    return rows.withColumn("coef", F.round("coef", 9))


@query("""
WITH e AS (SELECT p.n_nationkey AS a, q.n_nationkey AS b FROM nation p JOIN nation q ON q.n_nationkey IN (p.n_nationkey + 1, p.n_nationkey + 5)), two AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
f AS (SELECT [n_nationkey] AS m FROM nation WHERE n_nationkey % 7 <> 0 UNION ALL SELECT [a, b] FROM e WHERE a % 3 <> 0 UNION ALL SELECT DISTINCT list_sort([x.a, x.b, y.b]) FROM two x JOIN two y ON y.a = x.b AND y.b <> x.a WHERE (x.a + x.b + y.b) % 4 = 0),
l AS (SELECT DISTINCT m, unnest(m) AS w FROM f WHERE len(m) > 1), t AS (SELECT m, w, list_filter(m, lambda v: v <> w) AS r FROM l)
SELECT array_to_string(m, ',') AS members, w AS without FROM t WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.m = t.r) AND (len(r) = 1 OR EXISTS (SELECT 1 FROM two WHERE two.a = r[1] AND two.b = r[2]))
""")
def closure_gaps(spark, d):
    """A family of connected sets of up to three nations with gaps: what a closed family would also hold."""
    k = F.col("n_nationkey")
    n = t(spark, d, "nation").select(k.alias("a"))
    e = n.select("a", F.explode(F.array(F.col("a") + 1, F.col("a") + 5)).alias("b")).join(n.withColumnRenamed("a", "b"), "b").select("a", "b")
    two = graph.both_ways(e)
    three = two.toDF("x", "y").join(two.toDF("y", "z"), "y").where("z <> x").select(F.array_sort(F.array("x", "y", "z")).alias("members")).distinct()
    total = F.aggregate("members", F.lit(0).cast("long"), lambda a, x: a + x)
    family = n.where("a % 7 <> 0").select(F.array("a").alias("members")).unionByName(e.where("a % 3 <> 0").select(F.array("a", "b").alias("members"))).unionByName(three.where(total % 4 == 0))
    return master.closure_violations(family, e).select(F.array_join("members", ",").alias("members"), "without")
