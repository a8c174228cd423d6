"""Queries whose oracles enumerate: cut vertices, centres, coarsenings, covers; and outcome checks of two sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from parcelry.operators import arith, checks, graph, outcomes, planning
from parcelry.plans.registry import query, t
from parcelry.plans.resolution import CENTS
from parcelry.plans.scores import EDGES, edges, vertices


@query(f"""
WITH RECURSIVE {EDGES}, v AS (SELECT n_nationkey AS id, n_regionkey AS region FROM nation),
two AS (SELECT x.a, x.b, y.region FROM (SELECT a, b FROM edges UNION ALL SELECT b, a FROM edges) x JOIN v y ON y.id = x.a JOIN v z ON z.id = x.b AND z.region = y.region),
r(gone, d, root) AS (SELECT g.id, v.id, v.id FROM v g JOIN v ON v.region = g.region UNION SELECT r.gone, two.b, r.root FROM r JOIN two ON two.a = r.d AND two.b <> r.gone AND r.d <> r.gone AND r.root <> r.gone AND r.root <= two.b),
parts AS (SELECT gone, d, min(root) AS c FROM r WHERE d <> gone GROUP BY ALL), after AS (SELECT gone, count(DISTINCT c) AS n FROM parts GROUP BY 1),
r2(d, root) AS (SELECT id, id FROM v UNION SELECT two.b, r2.root FROM r2 JOIN two ON two.a = r2.d AND r2.root <= two.b),
whole AS (SELECT region, count(DISTINCT c) AS n FROM (SELECT d, min(root) AS c FROM r2 GROUP BY 1) JOIN v ON v.id = d GROUP BY 1),
alone AS (SELECT id FROM v WHERE id NOT IN (SELECT a FROM two))
SELECT v.id FROM v JOIN after ON after.gone = v.id JOIN whole USING (region) WHERE after.n > whole.n AND v.id NOT IN (SELECT id FROM alone)
""")
def articulation_points(spark, d):
    return graph.articulation(vertices(spark, d), edges(spark, d), "region")


@query("""
WITH x AS (SELECT c_mktsegment AS channel, c_custkey AS id, c_nationkey % 5 AS unit, CASE WHEN c_custkey % 3 = 0 THEN 'B' ELSE 'A' END AS district, CAST(1 + c_custkey % 4 AS DOUBLE) AS mass FROM customer),
e AS (SELECT p.id AS a, q.id AS b FROM x p JOIN x q ON q.id IN (p.id + 1, p.id + 2) AND q.channel = p.channel),
two AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
tot AS (SELECT channel, district, sum(mass) AS total FROM x GROUP BY ALL), tau AS (SELECT channel, sum(mass) / 2 AS tau FROM x GROUP BY ALL),
lf AS (SELECT channel, unit, district, count(*) AS n FROM x GROUP BY ALL),
mv AS (SELECT DISTINCT c.channel, c.id, c.unit, c.district AS "from", o.district AS "to", c.mass FROM x c JOIN lf ON lf.channel = c.channel AND lf.unit = c.unit AND lf.district = c.district AND lf.n > 1 JOIN two ON two.a = c.id JOIN x o ON o.id = two.b AND o.channel = c.channel AND o.district <> c.district JOIN lf l2 ON l2.channel = c.channel AND l2.unit = c.unit AND l2.district = o.district)
SELECT mv.channel, id, unit, "from", "to", mass, round(greatest(abs(p.total - tau), abs(q.total - tau)) - greatest(abs(p.total - mass - tau), abs(q.total + mass - tau)), 9) AS gain
FROM mv JOIN tot p ON p.channel = mv.channel AND p.district = mv."from" JOIN tot q ON q.channel = mv.channel AND q.district = mv."to" JOIN tau ON tau.channel = mv.channel
WHERE greatest(abs(p.total - tau), abs(q.total - tau)) - greatest(abs(p.total - mass - tau), abs(q.total + mass - tau)) > 1e-9 * tau
""")
def swap_gains(spark, d):
    """Two districts of unequal mass on a strip of places: most moves from the heavier to the lighter one gain."""
    key = F.col("c_custkey")
    cells = t(spark, d, "customer").select(F.col("c_mktsegment").alias("channel"), key.alias("id"), (F.col("c_nationkey") % 5).alias("unit"), F.when(key % 3 == 0, "B").otherwise("A").alias("district"), (1 + key % 4).cast("double").alias("mass"))
    near = cells.select("channel", F.col("id").alias("a"), F.explode(F.array(F.col("id") + 1, F.col("id") + 2)).alias("b"))
    e = near.join(cells.select("channel", F.col("id").alias("b")), ["channel", "b"]).select("a", "b")
    planned = cells.select("channel", "unit", "district", F.lit(1.0).alias("share")).distinct()
    tau = cells.groupBy("channel").agg((F.sum("mass") / 2).alias("tau"))
    return planning.move_gains(cells, e, planned, tau).withColumn("gain", F.round("gain", 9))


@query("""
WITH p AS (SELECT s_suppkey AS id, CAST(s_nationkey // 5 * 1000 + s_suppkey % 7 AS DOUBLE) AS x, CAST(s_nationkey // 5 * 500 + s_suppkey % 5 AS DOUBLE) AS y, CAST(1 + s_suppkey % 3 AS DOUBLE) AS w, s_nationkey // 5 AS blob FROM supplier)
SELECT CAST(round(sum(w * x) / sum(w), 6) AS DOUBLE) AS x, CAST(round(sum(w * y) / sum(w), 6) AS DOUBLE) AS y FROM p GROUP BY blob
""")
def k_means_centres(spark, d):
    """Five clouds far apart: the centres are the clouds' weighted means, whatever the start."""
    s = t(spark, d, "supplier")
    blob, key = F.floor(F.col("s_nationkey") / 5), F.col("s_suppkey")
    p = s.select(key.alias("id"), (blob * 1000 + key % 7).cast("double").alias("x"), (blob * 500 + key % 5).cast("double").alias("y"), (1 + key % 3).cast("double").alias("w"))
    return graph.k_means(p, 5, "w").select(F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


_PAIR = "(SELECT 1 FROM nation p, nation q WHERE p.n_regionkey = {a} AND q.n_regionkey = {b} AND abs(p.n_nationkey - q.n_nationkey) = 1)"


@query(f"""
WITH r AS (SELECT r_regionkey AS id FROM region), e AS (SELECT x.id AS a, y.id AS b FROM r x JOIN r y ON x.id <> y.id WHERE EXISTS {_PAIR.format(a="x.id", b="y.id")}),
g AS (SELECT a.l AS l0, b.l AS l1, c.l AS l2, d.l AS l3, e.l AS l4 FROM (SELECT 0 AS l) a, (SELECT unnest([0, 1]) AS l) b, (SELECT unnest([0, 1, 2]) AS l) c, (SELECT unnest([0, 1, 2, 3]) AS l) d, (SELECT unnest([0, 1, 2, 3, 4]) AS l) e
  WHERE c.l <= b.l + 1 AND d.l <= greatest(b.l, c.l) + 1 AND e.l <= greatest(b.l, c.l, d.l) + 1),
n AS (SELECT row_number() OVER () AS i, [l0, l1, l2, l3, l4] AS l FROM g),
m AS (SELECT i, x.id AS id, l[x.id + 1] AS block FROM n, r x),
s1 AS (SELECT DISTINCT p.i, p.block, p.id AS a, q.id AS b FROM m p JOIN m q ON q.i = p.i AND q.block = p.block JOIN e ON e.a = p.id AND e.b = q.id UNION SELECT i, block, id, id FROM m),
s2 AS (SELECT DISTINCT x.i, x.block, x.a, y.b FROM s1 x JOIN s1 y ON y.i = x.i AND y.block = x.block AND y.a = x.b),
s4 AS (SELECT DISTINCT x.i, x.block, x.a, y.b FROM s2 x JOIN s2 y ON y.i = x.i AND y.block = x.block AND y.a = x.b),
size AS (SELECT i, block, count(*) AS k FROM m GROUP BY ALL), ok AS (SELECT s.i FROM size s LEFT JOIN (SELECT i, block, count(*) AS c FROM s4 GROUP BY ALL) t ON t.i = s.i AND t.block = s.block GROUP BY s.i HAVING bool_and(t.c = k * k)),
txt AS (SELECT i, block, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS b, min(id) AS lo FROM m GROUP BY ALL)
SELECT string_agg(b, '|' ORDER BY lo) AS blocks FROM txt WHERE i IN (SELECT i FROM ok) GROUP BY i
""")
def coarsenings(spark, d):
    """All ways to part the regions into connected blocks; two regions touch where nations of neighbouring numbers do."""
    n = t(spark, d, "nation").select("n_nationkey", "n_regionkey").collect()
    near: dict = {}
    for p in n:
        for q in n:
            if p.n_regionkey != q.n_regionkey and abs(p.n_nationkey - q.n_nationkey) == 1:
                near.setdefault(p.n_regionkey, set()).add(q.n_regionkey)
    items = sorted({r.n_regionkey for r in n})
    rows = [("|".join(",".join(map(str, b)) for b in sorted(sorted(b) for b in blocks)),) for blocks in arith.coarsenings(items, near)]
    return spark.createDataFrame(rows, "blocks string")


@query("""
WITH r AS (SELECT n_nationkey // 2 AS s, list_sort(list(DISTINCT n_regionkey)) AS m FROM nation GROUP BY 1), c AS (SELECT a.s AS a, b.s AS b FROM r a JOIN r b ON a.s < b.s WHERE len(list_intersect(a.m, b.m)) = 0 AND len(a.m) + len(b.m) = 5)
SELECT CAST(s AS VARCHAR) AS sets FROM r WHERE len(m) = 5 UNION ALL SELECT a || ',' || b FROM c
UNION ALL SELECT x.s || ',' || y.s || ',' || z.s FROM r x JOIN r y ON x.s < y.s AND len(list_intersect(x.m, y.m)) = 0 JOIN r z ON y.s < z.s AND len(list_intersect(x.m, z.m)) = 0 AND len(list_intersect(y.m, z.m)) = 0 WHERE len(x.m) + len(y.m) + len(z.m) = 5
""")
def exact_covers(spark, d):
    """Choices of nation classes that hold every region exactly once."""
    rows = t(spark, d, "nation").groupBy(F.floor(F.col("n_nationkey") / 2).alias("s")).agg(F.collect_set("n_regionkey").alias("m")).collect()
    sets = {r.s: frozenset(r.m) for r in rows}
    found = [(",".join(map(str, sorted(c))),) for c in arith.covers(frozenset(range(5)), sets)]
    return spark.createDataFrame(found, "sets string")


# ---- outcome checks of two sources

_SOURCES = """
s1 AS (SELECT c_nationkey AS zip, CASE WHEN c_custkey % 23 <> 0 THEN c_custkey % 50 END AS firm, 'N' || (c_custkey % 3) AS name, CASE WHEN c_custkey % 7 <> 0 THEN CASE WHEN c_custkey % 50 < 30 THEN 'C' || (c_custkey % 50 % 4) ELSE c_mktsegment END END AS channel, CAST(c_acctbal AS DECIMAL(18,2)) AS amt FROM customer),
s2 AS (SELECT s_nationkey AS zip, CASE WHEN s_suppkey % 11 <> 0 THEN s_suppkey % 60 END AS firm, 'N' || (s_suppkey % 4) AS name, 'L' || (s_suppkey % 3) AS label, CAST(s_acctbal AS DECIMAL(18,2)) AS amt FROM supplier),
ov AS (SELECT p_partkey % 60 AS firm, CASE WHEN p_partkey % 2 = 0 THEN 'N' || (p_partkey % 4) END AS name, CASE WHEN p_partkey % 9 <> 0 THEN 'C' || (p_size % 2) END AS channel FROM part WHERE p_size <= 2),
cell AS (SELECT zip, firm, name, count(DISTINCT coalesce(channel, '')) AS k FROM s1 WHERE firm IS NOT NULL GROUP BY ALL),
nm AS (SELECT firm, name, count(DISTINCT coalesce(channel, '')) AS k, count(DISTINCT channel) AS kc, min(channel) AS ch FROM s1 WHERE firm IS NOT NULL GROUP BY ALL),
fm AS (SELECT firm, count(DISTINCT coalesce(channel, '')) AS k, count(DISTINCT channel) AS kc, min(channel) AS ch FROM s1 WHERE firm IS NOT NULL GROUP BY ALL),
ok AS (SELECT firm, name, count(*) AS n, count(DISTINCT channel) AS k, min(channel) AS ch FROM ov GROUP BY ALL),
rt AS (SELECT s2.*, CASE WHEN s2.firm IS NULL THEN 'no firm' WHEN nm.firm IS NOT NULL THEN CASE nm.kc WHEN 0 THEN 'unmapped' WHEN 1 THEN nm.ch ELSE 'several' END WHEN fm.firm IS NOT NULL THEN CASE fm.kc WHEN 0 THEN 'unmapped' WHEN 1 THEN fm.ch ELSE 'several' END ELSE 'no rows' END AS route,
  CASE WHEN s2.firm IS NULL THEN '0' WHEN cell.k = 1 THEN '1' WHEN cell.k > 1 THEN '2' WHEN nm.k = 1 THEN '3' WHEN nm.k > 1 THEN '4' WHEN fm.k = 1 THEN '5' WHEN fm.k > 1 THEN '6' ELSE '7' END AS level,
  coalesce(a.k, b.k) AS ok, CASE WHEN a.firm IS NOT NULL THEN a.ch ELSE b.ch END AS och
  FROM s2 LEFT JOIN nm ON nm.firm = s2.firm AND nm.name = s2.name LEFT JOIN fm ON fm.firm = s2.firm LEFT JOIN cell ON cell.zip = s2.zip AND cell.firm = s2.firm AND cell.name = s2.name LEFT JOIN ok a ON a.firm = s2.firm AND a.name = s2.name LEFT JOIN ok b ON b.firm = s2.firm AND b.name IS NULL),
p AS (SELECT 's1' AS source, 'channels of a cell' AS "check", CASE WHEN s1.firm IS NULL THEN 'no firm' WHEN cell.k > 1 THEN 'several in the cell' WHEN nm.k > 1 THEN 'one in the cell, several in the firm' ELSE 'one' END AS outcome, s1.amt FROM s1 LEFT JOIN cell ON cell.zip = s1.zip AND cell.firm = s1.firm AND cell.name = s1.name LEFT JOIN nm ON nm.firm = s1.firm AND nm.name = s1.name
 UNION ALL SELECT 's1', 'route', CASE WHEN s1.firm IS NULL THEN 'no firm' WHEN nm.kc = 0 THEN 'unmapped' WHEN nm.kc > 1 THEN 'several' WHEN s1.channel IS NULL THEN 'one, row blank' ELSE 'one' END, s1.amt FROM s1 LEFT JOIN nm ON nm.firm = s1.firm AND nm.name = s1.name
 UNION ALL SELECT 's2', 'route', route, amt FROM rt UNION ALL SELECT 's2', 'route level', level, amt FROM rt
 UNION ALL SELECT 's2', 'route against override', CASE WHEN ok IS NULL THEN 'no override' WHEN ok = 0 THEN 'override blank' WHEN ok > 1 THEN 'override several' WHEN route IN ('unmapped', 'several', 'no rows', 'no firm') THEN 'override fills ' || route WHEN route = och THEN 'same' ELSE 'override ' || och || ', route ' || route END, amt FROM rt
 UNION ALL SELECT 's2', 'scope', CASE WHEN route IN ('C3') THEN 'out: ' || route ELSE 'in' END, amt FROM rt
 UNION ALL SELECT 's1', 'scope', CASE WHEN nm.kc = 1 AND nm.ch IN ('C3') THEN 'out: ' || nm.ch ELSE 'in' END, s1.amt FROM s1 LEFT JOIN nm ON nm.firm = s1.firm AND nm.name = s1.name
 UNION ALL SELECT 's2', 'label and route', label || ' -> ' || route, amt FROM rt
 UNION ALL SELECT 's2', 'label and channel of the firm', s2.label || ' -> ' || CASE WHEN s2.firm IS NULL THEN 'no firm' WHEN fm.firm IS NULL THEN 'no rows' WHEN fm.kc = 1 AND fm.k = 1 THEN fm.ch WHEN fm.kc = 0 THEN '(blank)' ELSE 'several' END, s2.amt FROM s2 LEFT JOIN fm ON fm.firm = s2.firm
 UNION ALL SELECT 'override', 'keys', CASE WHEN name IS NULL THEN 'firm' ELSE 'firm and name' END || CASE WHEN n > 1 THEN ', repeated' ELSE '' END || CASE WHEN k > 1 THEN ', several channels' ELSE '' END || CASE WHEN NOT EXISTS (SELECT 1 FROM s2 WHERE s2.firm = ok.firm AND (ok.name IS NULL OR s2.name = ok.name)) THEN ', not in use' ELSE '' END, CAST(NULL AS DECIMAL(18,2)) FROM ok
 UNION ALL SELECT 's2', 'holder moves', CASE WHEN h.k IS NULL AND g.k IS NULL THEN 'no holder' WHEN h.k IS NULL THEN 'new holder only' WHEN g.k IS NULL THEN 'no new holder' WHEN h.k = g.k THEN 'same holder' ELSE 'other holder' END, rt.amt FROM rt LEFT JOIN (SELECT n_nationkey AS zip, n_regionkey AS k FROM nation WHERE n_nationkey % 4 <> 0) h ON h.zip = rt.zip LEFT JOIN (SELECT n_nationkey AS zip, CASE WHEN n_nationkey % 3 = 0 THEN 9 ELSE n_regionkey END AS k FROM nation WHERE n_nationkey % 5 <> 0) g ON g.zip = rt.zip
 UNION ALL SELECT 's1', 'key form', CASE WHEN z IS NULL OR z = '' THEN 'missing' WHEN translate(z, '0123456789', '') <> '' THEN 'non-digit' WHEN length(z) = 5 THEN '5 digits' WHEN length(z) < 5 THEN 'under 5 digits' ELSE 'over 5 digits' END, CAST(c_acctbal AS DECIMAL(18,2)) FROM (SELECT c_acctbal, CASE WHEN c_custkey % 19 = 0 THEN NULL WHEN c_custkey % 17 = 0 THEN '' WHEN c_custkey % 5 = 0 THEN c_name ELSE CAST(c_custkey * 37 AS VARCHAR) END AS z FROM customer)
 UNION ALL SELECT 'region', 'start and end', CASE WHEN n_nationkey % 6 = 0 THEN 'end missing' WHEN n_nationkey % 6 = 1 THEN 'same' WHEN n_nationkey % 6 = 2 THEN 'within one key' ELSE 'across keys' END, CAST(NULL AS DECIMAL(18,2)) FROM nation
 UNION ALL SELECT 'territory', 'table and regions', CASE WHEN a.k IS NULL THEN 'regions only' WHEN b.k IS NULL THEN 'table only' ELSE 'both' END, CAST(NULL AS DECIMAL(18,2)) FROM (SELECT n_nationkey AS k FROM nation WHERE n_nationkey % 3 <> 0) a FULL JOIN (SELECT n_nationkey AS k FROM nation WHERE n_nationkey % 4 <> 0) b ON a.k = b.k
 UNION ALL SELECT 's1', 'period', year(o_orderdate) || ' | ' || quarter(o_orderdate), CAST(o_totalprice AS DECIMAL(18,2)) FROM orders)
"""


@query(f"""
WITH {_SOURCES}, g AS (SELECT source, "check", outcome, count(*) AS n, sum(amt) AS amt FROM p GROUP BY ALL)
SELECT source, "check", outcome, n, CAST(amt AS DOUBLE) AS amount, round(100.0 * n / sum(n) OVER (PARTITION BY source, "check"), 2) AS pct_rows FROM g
""")
def outcome_checks(spark, d):
    """Fifteen checks of two sources, their overrides and regions, as one result set."""
    key, sup, part, nation = F.col("c_custkey"), F.col("s_suppkey"), F.col("p_partkey"), F.col("n_nationkey")
    text = lambda c: c.cast("string")
    amt = lambda c: F.col(c).cast(CENTS).alias("amt")
    c, n = t(spark, d, "customer"), t(spark, d, "nation")
    channel = F.when(key % 7 != 0, F.when(key % 50 < 30, F.concat(F.lit("C"), text(key % 50 % 4))).otherwise(F.col("c_mktsegment")))
    s1 = c.select(F.col("c_nationkey").alias("zip"), F.when(key % 23 != 0, key % 50).alias("firm"), F.concat(F.lit("N"), text(key % 3)).alias("name"), channel.alias("channel"), amt("c_acctbal"))
    s2 = t(spark, d, "supplier").select(F.col("s_nationkey").alias("zip"), F.when(sup % 11 != 0, sup % 60).alias("firm"), F.concat(F.lit("N"), text(sup % 4)).alias("name"), F.concat(F.lit("L"), text(sup % 3)).alias("label"), amt("s_acctbal"))
    ov = t(spark, d, "part").where("p_size <= 2").select((part % 60).alias("firm"), F.when(part % 2 == 0, F.concat(F.lit("N"), text(part % 4))).alias("name"), F.when(part % 9 != 0, F.concat(F.lit("C"), text(F.col("p_size") % 2))).alias("channel"))
    old = n.where(nation % 4 != 0).select(nation.alias("zip"), F.col("n_regionkey").alias("holder"))
    new = n.where(nation % 5 != 0).select(nation.alias("zip"), F.when(nation % 3 == 0, 9).otherwise(F.col("n_regionkey")).alias("holder"))
    z = F.when(key % 19 == 0, F.lit(None)).when(key % 17 == 0, "").when(key % 5 == 0, F.col("c_name")).otherwise(text(key * 37))
    m = nation % 6
    end = F.when(m == 0, F.lit(None)).when(m == 1, "00001-1").when(m == 2, "00001-2").otherwise("00002-1")
    regions = n.select(F.lit("00001-1").alias("start"), end.alias("end"))
    both = (n.where(nation % 3 != 0).select(nation.alias("key")), n.where(nation % 4 != 0).select(nation.alias("key")))
    o = t(spark, d, "orders").select(F.col("o_orderdate").alias("day"), amt("o_totalprice"))
    parts = outcomes.source_checks(s1, s2, ov, out=["C3"]) + [
        ("s2", "holder moves", *outcomes.holder_moves(s2, old, new)),
        ("s1", "key form", c.select(z.alias("z"), amt("c_acctbal")), outcomes.key_form(F.col("z"))),
        ("region", "start and end", regions, outcomes.range_form(F.col("start"), F.col("end"))),
        ("territory", "table and regions", *outcomes.on_either_side(*both, "key")),
        ("s1", "period", o, F.concat_ws(" | ", text(F.year("day")), text(F.quarter("day")))),
    ]
    out = outcomes.counted(parts, "amt")
    return out.select("source", "check", "outcome", "n", F.col("amount").cast("double").alias("amount"), "pct_rows")


@query("""
WITH x AS (SELECT c_mktsegment AS name, c_nationkey AS firm, c_custkey AS id, CAST(c_acctbal AS DECIMAL(18,2)) AS amt FROM customer),
f AS (SELECT DISTINCT firm FROM x WHERE id % 40 = 3), r AS (SELECT * FROM x WHERE firm IN (SELECT firm FROM f) OR name ILIKE '%BUILD%'),
g AS (SELECT CASE WHEN name = 'BUILDING' THEN 'B1' WHEN firm = 0 THEN NULL ELSE CAST(firm AS VARCHAR) END AS company, name, count(*) AS n, sum(amt) AS amount FROM r GROUP BY ALL)
SELECT coalesce(company, '(dropped)') AS company, name, n, CAST(amount AS DOUBLE) AS amount, CAST(round(CAST(100.0 AS DOUBLE) * CAST(amount AS DOUBLE) / CAST(sum(amount) OVER () AS DOUBLE), 2) AS DOUBLE) AS pct FROM g
""")
def feed_audit(spark, d):
    """One owner's rows in a feed, by name or by the firms that its marked rows have, under the company that each name resolves to."""
    x = t(spark, d, "customer").select(F.col("c_mktsegment").alias("name"), F.col("c_nationkey").alias("firm"), F.col("c_custkey").alias("id"), F.col("c_acctbal").cast(CENTS).alias("amt"))
    company = F.when(F.col("name") == "BUILDING", "B1").when(F.col("firm") != 0, F.col("firm").cast("string"))
    out = outcomes.feed_audit(x, x.where("id % 40 = 3").select("firm"), F.col("name").ilike("%BUILD%"), company, ["name"], "amt")
    return out.select("company", "name", "n", F.col("amount").cast("double").alias("amount"), "pct")


@query("""
SELECT CAST(c_nationkey AS VARCHAR) AS company, CASE c_mktsegment WHEN 'BUILDING' THEN 'BUILD' ELSE upper(trim(c_mktsegment)) END AS label, count(DISTINCT c_custkey % 7) AS regions, count(DISTINCT left(c_name, 15)) AS keys, count(DISTINCT c_custkey % 11) AS holders FROM customer WHERE c_nationkey <> 0 GROUP BY ALL
""")
def own_regions(spark, d):
    """Companies with regions of their own: regions, keys and holders (counts only, no names)."""
    c = t(spark, d, "customer").where("c_nationkey <> 0")
    label = F.when(F.col("c_mktsegment") == "BUILDING", "BUILD").otherwise(F.upper(F.trim("c_mktsegment")))
    return outcomes.own_regions(c, F.col("c_nationkey").cast("string"), label, F.col("c_custkey") % 7, F.left(F.col("c_name"), F.lit(15)), F.col("c_custkey") % 11)


@query("""
WITH z AS (SELECT DISTINCT c_nationkey AS zip FROM customer WHERE c_acctbal > 5000), s AS (SELECT DISTINCT s_nationkey AS zip, s_suppkey % 6 AS seller FROM supplier WHERE s_acctbal > 0),
k AS (SELECT z.zip, count(s.seller) AS sellers, min(s.seller) AS lowest FROM z LEFT JOIN s ON s.zip = z.zip GROUP BY ALL)
SELECT zip, CASE WHEN sellers = 0 THEN 'nobody' WHEN sellers = 1 THEN 'one' ELSE 'several' END AS covered, sellers, lowest FROM k
""")
def who_sells(spark, d):
    """The keys of a company, and who sells to them."""
    z = t(spark, d, "customer").where("c_acctbal > 5000").select(F.col("c_nationkey").alias("zip")).distinct()
    s = t(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_nationkey").alias("zip"), (F.col("s_suppkey") % 6).alias("seller"))
    return outcomes.sellers(z, s, "zip", "seller")


@query("""
WITH d AS (SELECT DISTINCT c_nationkey AS unit, c_mktsegment AS fine, CASE WHEN c_acctbal > 9900 THEN 'rich' ELSE 'base' END AS domain FROM customer), u AS (SELECT DISTINCT unit FROM d), f AS (SELECT DISTINCT fine FROM d),
n AS (SELECT unit, fine, count(*) AS n FROM d GROUP BY ALL), bad AS (SELECT CAST(u.unit AS VARCHAR) || '/' || f.fine AS item FROM u CROSS JOIN f LEFT JOIN n ON n.unit = u.unit AND n.fine = f.fine WHERE coalesce(n.n, 0) <> 1)
SELECT 'partition' AS "check", CASE WHEN count(*) = 0 THEN 'pass' ELSE 'fail' END AS status, CAST(count(*) AS VARCHAR) || ' cells in no domain or several' AS summary,
  coalesce((SELECT string_agg(item, ';' ORDER BY item) FROM (SELECT item FROM bad ORDER BY item LIMIT 20)), '') AS items FROM bad
""")
def partition_check(spark, d):
    c = t(spark, d, "customer")
    dom = c.select(F.col("c_nationkey").alias("unit"), F.col("c_mktsegment").alias("fine"), F.when(F.col("c_acctbal") > 9900, "rich").otherwise("base").alias("domain")).distinct()
    return checks.partition_check(dom, dom, dom).select("check", "status", "summary", F.array_join("items", ";").alias("items"))
