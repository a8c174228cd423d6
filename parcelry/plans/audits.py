"""Profiles, reconciliation, ledgers and exports on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from parcelry.functions import norm
from parcelry.operators import checks, export, ledger, profile, rules
from parcelry.plans.registry import query, t
from parcelry.plans.resolution import CENTS, dollars


# ---- profiles

@query("""
WITH l AS (
  UNPIVOT (SELECT CAST(c_nationkey AS VARCHAR) AS c_nationkey, c_mktsegment, CAST(CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_custkey % 3 END AS VARCHAR) AS code, c_name, CAST(c_acctbal AS DECIMAL(18,2)) AS w FROM customer)
  ON c_nationkey, c_mktsegment, code, c_name INTO NAME column_name VALUE value),
l2 AS (SELECT column_name, value, w FROM l UNION ALL SELECT 'code', NULL, CAST(c_acctbal AS DECIMAL(18,2)) FROM customer WHERE c_custkey % 10 = 0),
m AS (SELECT column_name, w, value, (value IS NULL OR trim(value) IN ('', '0')) AS gone FROM l2)
SELECT column_name, count(*) AS n_rows, count(DISTINCT CASE WHEN NOT gone THEN value END) AS n_distinct,
  round(100.0 * count(*) FILTER (gone) / count(*), 2) AS pct_missing_rows,
  round(CAST(100.0 AS DOUBLE) * CAST(sum(CASE WHEN gone THEN w ELSE 0 END) AS DOUBLE) / CAST(sum(w) AS DOUBLE), 2) AS pct_missing_weight,
  CAST(min(CASE WHEN NOT gone THEN length(value) END) AS INTEGER) AS min_length, CAST(max(CASE WHEN NOT gone THEN length(value) END) AS INTEGER) AS max_length,
  count(DISTINCT CASE WHEN NOT gone AND length(translate(value, '0123456789', '')) > 0 THEN value END) AS n_non_digit
FROM m GROUP BY ALL
""")
def column_profile(spark, d):
    c = t(spark, d, "customer")
    code = F.when(F.col("c_custkey") % 10 == 0, F.lit(None)).otherwise(F.col("c_custkey") % 3)
    own = c.select("c_nationkey", "c_mktsegment", code.alias("code"), "c_name", F.col("c_acctbal").cast(CENTS).alias("w"))
    return profile.column_profile(own, ["c_nationkey", "c_mktsegment", "code", "c_name"], "w").withColumn("pct_missing_rows", F.col("pct_missing_rows").cast("double"))


_pairs = "UNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, CAST({a} AS VARCHAR) AS va, CAST({b} AS VARCHAR) AS vb, w FROM x " for a, b in (("p_brand", "p_type"), ("p_brand", "band"), ("p_brand", "p_partkey"), ("p_type", "band"), ("p_type", "p_partkey"), ("band", "p_partkey"))
)


@query(f"""
WITH x AS (SELECT p_brand, p_type, p_size // 10 AS band, p_partkey, CAST(p_retailprice AS DECIMAL(18,2)) AS w FROM part),
l AS ({_pairs}), p AS (SELECT col_a, col_b, va, vb, sum(w) AS w FROM l WHERE va IS NOT NULL AND vb IS NOT NULL GROUP BY ALL),
n AS (SELECT *, count(*) OVER (PARTITION BY col_a, col_b, va) AS na, count(*) OVER (PARTITION BY col_a, col_b, vb) AS nb FROM p)
SELECT col_a, col_b, CASE WHEN na = 1 AND nb = 1 THEN '1:1' WHEN nb = 1 THEN 'one-many' WHEN na = 1 THEN 'many-one' ELSE 'many:many' END AS shape, count(*) AS pairs, CAST(sum(w) AS DOUBLE) AS weight FROM n GROUP BY ALL
""")
def key_pair_shape(spark, d):
    x = t(spark, d, "part").select("p_brand", "p_type", F.floor(F.col("p_size") / 10).alias("band"), "p_partkey", F.col("p_retailprice").cast(CENTS).alias("w"))
    return profile.pair_shape(x, ["p_brand", "p_type", "band", "p_partkey"], "w").withColumn("weight", dollars(F.col("weight")))


@query("""
WITH r AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 400000 GROUP BY 1),
x AS (SELECT CAST(c_acctbal AS DECIMAL(18,2)) AS w, CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_custkey END AS k FROM customer),
m AS (SELECT x.w, CASE WHEN x.k IS NULL THEN 'NO VALUE' WHEN r.n IS NULL THEN '0' WHEN r.n = 1 THEN '1' ELSE '2+' END AS outcome FROM x LEFT JOIN r ON r.k = x.k)
SELECT outcome, count(*) AS n, CAST(sum(w) AS DOUBLE) AS weight, round(100.0 * count(*) / (SELECT count(*) FROM m), 2) AS pct FROM m GROUP BY ALL
""")
def match_outcomes(spark, d):
    c = t(spark, d, "customer")
    k = F.when(F.col("c_custkey") % 13 != 0, F.col("c_custkey"))
    left = c.select(k.alias("k"), F.col("c_acctbal").cast(CENTS).alias("w"))
    right = t(spark, d, "orders").where("o_orderstatus = 'P' AND o_totalprice > 400000").select(F.col("o_custkey").alias("k"))
    g = rules.match_counts(left, right, ["k"]).groupBy("outcome").agg(F.count("*").alias("n"), dollars(F.sum("w")).alias("weight"))
    return g.withColumn("pct", F.round(F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy()), 2).cast("double"))


@query("""
WITH l AS (SELECT 'o_orderpriority' AS column_name, o_orderpriority AS value, CAST(o_totalprice AS DECIMAL(18,2)) AS w FROM orders UNION ALL SELECT 'day', strftime(o_orderdate, '%Y-%m-%d'), CAST(o_totalprice AS DECIMAL(18,2)) FROM orders),
g AS (SELECT column_name, value, sum(w) AS weight, count(*) AS n FROM l GROUP BY ALL),
r AS (SELECT *, round(100.0 * CAST(weight AS DOUBLE) / CAST(sum(weight) OVER (PARTITION BY column_name) AS DOUBLE), 2) AS pct, row_number() OVER (PARTITION BY column_name ORDER BY weight DESC, value) AS rank FROM g)
SELECT column_name, value, CAST(weight AS DOUBLE) AS weight, n, pct, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 40
""")
def label_topk(spark, d):
    o = t(spark, d, "orders").select("o_orderpriority", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.col("o_totalprice").cast(CENTS).alias("w"))
    return profile.label_frequency(o, ["o_orderpriority", "day"], "w").withColumn("weight", dollars(F.col("weight")))


_dup = "x AS (SELECT l_suppkey % 20 AS id, l_returnflag AS name, l_quantity AS q, l_linestatus AS s FROM lineitem)"


@query(f"""
WITH {_dup}, e AS (SELECT id, name, q, s, count(*) AS n FROM x GROUP BY ALL HAVING count(*) > 1), c AS (SELECT q, count(*) AS n FROM x GROUP BY ALL HAVING count(*) > 1),
i AS (SELECT id, count(*) AS n FROM x GROUP BY ALL HAVING count(DISTINCT name) > 1), m AS (SELECT name, count(*) AS n FROM x GROUP BY ALL HAVING count(DISTINCT id) > 1)
SELECT 'exact rows' AS kind, count(*) AS groups, CAST(coalesce(sum(n), 0) AS BIGINT) AS rows FROM e UNION ALL SELECT 'cell on 2+ rows', count(*), CAST(coalesce(sum(n), 0) AS BIGINT) FROM c
UNION ALL SELECT 'id on 2+ names', count(*), CAST(coalesce(sum(n), 0) AS BIGINT) FROM i UNION ALL SELECT 'name on 2+ ids', count(*), CAST(coalesce(sum(n), 0) AS BIGINT) FROM m
""")
def duplicate_taxonomy(spark, d):
    x = t(spark, d, "lineitem").select((F.col("l_suppkey") % 20).alias("id"), F.col("l_returnflag").alias("name"), F.col("l_quantity").alias("q"), F.col("l_linestatus").alias("s"))
    return profile.duplicates(x, ["q"], "id", "name")


@query("""
WITH c AS (SELECT o_custkey, count(DISTINCT o_orderstatus) AS statuses, count(DISTINCT o_orderpriority) AS priorities, count(DISTINCT CAST(o_orderdate AS DATE)) AS days FROM orders GROUP BY 1),
l AS (SELECT 'statuses' AS over, statuses AS n FROM c UNION ALL SELECT 'priorities', priorities FROM c UNION ALL SELECT 'days', days FROM c)
SELECT over, CASE WHEN n <= 1 THEN '1' WHEN n <= 5 THEN '2-5' ELSE '6+' END AS bucket, count(*) AS codes FROM l GROUP BY ALL
""")
def code_spread(spark, d):
    o = t(spark, d, "orders").select("o_custkey", F.col("o_orderstatus").alias("statuses"), F.col("o_orderpriority").alias("priorities"), F.to_date("o_orderdate").alias("days"))
    return profile.code_spread(o, "o_custkey", ["statuses", "priorities", "days"])


@query("""
WITH r AS (SELECT DISTINCT o_custkey AS k FROM orders), w AS (SELECT c_custkey AS k, c_mktsegment AS out FROM customer WHERE c_custkey % 7 <> 0 UNION ALL SELECT c_custkey, 'OTHER' FROM customer WHERE c_custkey % 11 = 0)
SELECT 'raw key not in crosswalk' AS defect, count(*) AS n FROM r WHERE k NOT IN (SELECT k FROM w)
UNION ALL SELECT 'crosswalk key not in raw', count(DISTINCT k) FROM w WHERE k NOT IN (SELECT k FROM r)
UNION ALL SELECT 'key on 2+ outputs', count(*) FROM (SELECT k FROM w GROUP BY k HAVING count(DISTINCT out) > 1)
""")
def crosswalk_proof(spark, d):
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("out"))
    walk = c.where("k % 7 <> 0").unionByName(c.where("k % 11 = 0").withColumn("out", F.lit("OTHER")))
    return profile.crosswalk_proof(t(spark, d, "orders").select(F.col("o_custkey").alias("k")), walk, ["k"], ["out"])


@query("""
SELECT table_name, string_agg(column_name || ' ' || kind, ', ' ORDER BY pos) AS line, count(*) AS n_columns FROM (VALUES
  ('nation', 1, 'n_nationkey', 'int'), ('nation', 2, 'n_name', 'string'), ('nation', 3, 'n_regionkey', 'int'),
  ('region', 1, 'r_regionkey', 'int'), ('region', 2, 'r_name', 'string'),
  ('supplier', 1, 's_suppkey', 'bigint'), ('supplier', 2, 's_name', 'string'), ('supplier', 3, 's_nationkey', 'int'), ('supplier', 4, 's_acctbal', 'double')) AS v(table_name, pos, column_name, kind) GROUP BY ALL
""")
def schema_catalogue(spark, d):
    return profile.schema_lines(profile.schema_rows(spark, {n: t(spark, d, n) for n in ("nation", "region", "supplier")}))


@query("""
SELECT * FROM (VALUES ('s_acctbal', 'double', 'decimal(18,2)'), ('s_comment', NULL, 'string'), ('s_nationkey', 'int', NULL)) AS v(column_name, type_a, type_b)
""")
def schema_difference(spark, d):
    s = t(spark, d, "supplier")
    other = s.withColumn("s_acctbal", F.col("s_acctbal").cast(CENTS)).withColumn("s_comment", F.lit("")).drop("s_nationkey")
    return profile.schema_difference(profile.schema_rows(spark, {"a": s}), profile.schema_rows(spark, {"b": other}))


# ---- reconciliation

@query("""
WITH a AS (SELECT l_suppkey, l_returnflag, CAST(l_extendedprice AS DECIMAL(18,2)) AS amount, l_quantity AS q FROM lineitem), b AS (SELECT * FROM a WHERE NOT (l_suppkey = 3 AND l_returnflag = 'A') UNION ALL SELECT 5, 'N', 12.34, 1.0),
u AS (SELECT l_suppkey, l_returnflag, amount, q FROM a UNION ALL SELECT l_suppkey, l_returnflag, -amount, -q FROM b)
SELECT l_suppkey, l_returnflag, CAST(sum(amount) AS DOUBLE) AS amount, sum(q) AS q FROM u GROUP BY ALL HAVING sum(amount) <> 0 OR sum(q) <> 0
""")
def signed_reconciliation(spark, d):
    a = t(spark, d, "lineitem").select("l_suppkey", "l_returnflag", F.col("l_extendedprice").cast(CENTS).alias("amount"), F.col("l_quantity").alias("q"))
    extra = spark.createDataFrame([(5, "N", 1.0)], "l_suppkey long, l_returnflag string, q double").withColumn("amount", F.lit("12.34").cast(CENTS))
    b = a.where(~((F.col("l_suppkey") == 3) & (F.col("l_returnflag") == "A"))).unionByName(extra)
    return checks.signed_difference(a, b, ["l_suppkey", "l_returnflag"], ["amount", "q"]).withColumn("amount", dollars(F.col("amount")))


_tie = "a AS (SELECT year(o_orderdate) AS period, CAST(o_totalprice AS DECIMAL(18,2)) AS gross, CAST(o_custkey AS DECIMAL(18,2)) AS comp, o_orderkey FROM orders), b AS (SELECT * FROM a WHERE o_orderkey % 1000 <> 7)"


@query(f"""
WITH {_tie}, x AS (SELECT period, 'gross' AS measure, sum(gross) AS s FROM a GROUP BY ALL UNION ALL SELECT period, 'comp', sum(comp) FROM a GROUP BY ALL), y AS (SELECT period, 'gross' AS measure, sum(gross) AS s FROM b GROUP BY ALL UNION ALL SELECT period, 'comp', sum(comp) FROM b GROUP BY ALL)
SELECT CAST(coalesce(x.period, y.period) AS INTEGER) AS period, coalesce(x.measure, y.measure) AS measure, CAST(x.s AS DOUBLE) AS source_amount, CAST(y.s AS DOUBLE) AS target_amount, CAST(coalesce(x.s, 0) - coalesce(y.s, 0) AS DOUBLE) AS difference FROM x FULL JOIN y ON y.period = x.period AND y.measure = x.measure
""")
def tie_out(spark, d):
    a = t(spark, d, "orders").select(F.year("o_orderdate").alias("period"), F.col("o_totalprice").cast(CENTS).alias("gross"), F.col("o_custkey").cast(CENTS).alias("comp"), "o_orderkey")
    out = checks.tie_out(a, a.where("o_orderkey % 1000 <> 7"), "period", ["gross", "comp"])
    return out.withColumns({c: dollars(F.col(c)) for c in ("source_amount", "target_amount", "difference")})


@query("""
WITH a AS (SELECT o_custkey, nullif(o_orderpriority, '5-LOW') AS p, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS live FROM orders GROUP BY ALL), b AS (SELECT o_custkey, nullif(o_orderpriority, '5-LOW') AS p, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS rebuilt FROM orders WHERE o_orderkey % 37 <> 1 GROUP BY ALL)
SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, coalesce(a.p, b.p) AS p, CAST(live AS DOUBLE) AS live, CAST(rebuilt AS DOUBLE) AS rebuilt, CAST(coalesce(live, 0) - coalesce(rebuilt, 0) AS DOUBLE) AS shortfall
FROM a FULL JOIN b ON a.o_custkey = b.o_custkey AND a.p IS NOT DISTINCT FROM b.p WHERE coalesce(live, 0) <> coalesce(rebuilt, 0)
""")
def live_vs_rebuilt(spark, d):
    a = t(spark, d, "orders").select("o_orderkey", "o_custkey", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("p"), F.col("o_totalprice").cast(CENTS).alias("amount"))
    out = checks.compared(a, a.where("o_orderkey % 37 <> 1"), ["o_custkey", "p"], "amount")
    return out.withColumns({c: dollars(F.col(c)) for c in ("live", "rebuilt", "shortfall")})


@query("""
WITH r AS (SELECT o.*, c_nationkey, CASE WHEN c_custkey IS NULL THEN 'unknown' WHEN c_nationkey > 20 THEN 'outside' WHEN o_totalprice < 20000 THEN 'small' END AS reason FROM orders o LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 19 <> 0)
SELECT reason, count(DISTINCT o_custkey) AS keys, count(*) AS rows, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS mass, round(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / CAST((SELECT sum(CAST(o_totalprice AS DECIMAL(18,2))) FROM orders) AS DOUBLE), 6) AS share
FROM r WHERE reason IS NOT NULL GROUP BY ALL
""")
def scope_drop_counts(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").cast(CENTS).alias("mass"))
    dim = t(spark, d, "customer").where("c_custkey % 19 <> 0").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    _, lost = checks.dropped_by_reason(o, dim, "o_custkey", "mass", [(F.col("c_nationkey").isNull(), "unknown"), (F.col("c_nationkey") > 20, "outside"), (F.col("mass") < 20000, "small")])
    return lost.select("reason", "keys", "rows", dollars(F.col("mass")).alias("mass"), F.round(dollars(F.col("mass")) / (dollars(F.col("mass")) / F.col("share").cast("double")), 6).alias("share"))


@query("""
WITH x AS (SELECT o_custkey, CAST(o_totalprice AS DECIMAL(18,2)) AS w, o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AS hit FROM orders)
SELECT 'RATE' AS part, CAST(NULL AS BIGINT) AS o_custkey, CAST(sum(w) FILTER (hit) AS DOUBLE) AS matched, CAST(sum(w) AS DOUBLE) AS total FROM x
UNION ALL SELECT * FROM (SELECT 'LOST', o_custkey, CAST(NULL AS DOUBLE), CAST(sum(w) AS DOUBLE) AS s FROM x WHERE NOT hit GROUP BY o_custkey ORDER BY s DESC, o_custkey LIMIT 8)
""")
def join_rate_floor(spark, d):
    o = t(spark, d, "orders").select("o_custkey", F.col("o_totalprice").cast(CENTS).alias("w"))
    rate, lost = checks.join_rate(o, t(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey")), ["o_custkey"], "w")
    a = rate.select(F.lit("RATE").alias("part"), F.lit(None).cast("long").alias("o_custkey"), dollars(F.col("matched")).alias("matched"), dollars(F.col("total")).alias("total"))
    return a.unionByName(lost.select(F.lit("LOST").alias("part"), "o_custkey", F.lit(None).cast("double").alias("matched"), dollars(F.col("lost")).alias("total")))


# ---- ledger: place customer, channel segment, unit nation, district and rep by key

LEDGER = """ledger AS (SELECT c_custkey AS zip, c_mktsegment AS channel, c_mktsegment AS fine, c_nationkey AS unit, 'D' || CAST((c_nationkey + c_custkey % 3) % 7 AS VARCHAR) AS district, 'R' || CAST(c_custkey % 11 AS VARCHAR) AS rep, greatest(c_acctbal, 0) AS m_rel FROM customer)"""


def the_ledger(spark, d):
    key = F.col("c_custkey")
    return t(spark, d, "customer").select(
        key.alias("zip"),
        F.col("c_mktsegment").alias("channel"),
        F.col("c_mktsegment").alias("fine"),
        F.col("c_nationkey").alias("unit"),
        F.concat(F.lit("D"), ((F.col("c_nationkey") + key % 3) % 7).cast("string")).alias("district"),
        F.concat(F.lit("R"), (key % 11).cast("string")).alias("rep"),
        F.greatest("c_acctbal", F.lit(0.0)).alias("m_rel"),
    )


@query(f"""
WITH {LEDGER}, expected AS (SELECT zip, channel FROM ledger WHERE unit <> 24 UNION ALL SELECT 1000000007, 'BUILDING'), spec AS (SELECT channel, CASE channel WHEN 'BUILDING' THEN 6 ELSE 7 END AS k FROM (SELECT DISTINCT channel FROM ledger)),
bands AS (SELECT channel, 0.98 * avg(m) AS low, 1.02 * avg(m) AS high FROM (SELECT channel, district, sum(m_rel) AS m FROM ledger GROUP BY ALL) GROUP BY ALL),
c AS (
  SELECT 'one owner per cell' AS "check", (SELECT count(*) FROM (SELECT zip, channel FROM ledger GROUP BY ALL HAVING count(DISTINCT district) > 1)) AS n, ' cells with several owners' AS s
  UNION ALL SELECT 'cells not placed', (SELECT count(*) FROM expected e WHERE NOT EXISTS (SELECT 1 FROM ledger l WHERE l.zip = e.zip AND l.channel = e.channel)), ' expected cells without owner'
  UNION ALL SELECT 'cells not expected', (SELECT count(*) FROM (SELECT DISTINCT zip, channel FROM ledger WHERE unit = 24)), ' owned cells that nobody expected'
  UNION ALL SELECT 'district count', (SELECT count(*) FROM (SELECT channel, count(DISTINCT district) AS n FROM ledger GROUP BY ALL) JOIN spec USING (channel) WHERE n <> k), ' channels with another count'
  UNION ALL SELECT 'final bands', (SELECT count(*) FROM (SELECT channel, district, sum(m_rel) AS m FROM ledger GROUP BY ALL) JOIN bands USING (channel) WHERE m < low - 1e-9 OR m > high + 1e-9), ' districts outside their band'
  UNION ALL SELECT 'drops are empty', (SELECT count(*) FROM (SELECT unit FROM ledger WHERE unit < 3 GROUP BY ALL HAVING sum(m_rel) > 0)), ' dropped units that have mass'
  UNION ALL SELECT 'whole units', (SELECT count(*) FROM (SELECT channel, unit FROM ledger WHERE channel NOT IN ('BUILDING', 'FURNITURE') GROUP BY ALL HAVING count(DISTINCT district) > 1)), ' units with several owners'
  UNION ALL SELECT 'clipped units', (SELECT count(*) FROM (SELECT DISTINCT channel, district, unit FROM ledger WHERE channel = 'FURNITURE') x WHERE (SELECT count(DISTINCT y.district) FROM ledger y WHERE y.channel = x.channel AND y.unit = x.unit) > 1 AND (SELECT count(DISTINCT z.unit) FROM ledger z WHERE z.channel = x.channel AND z.district = x.district) > 1), ' owners beyond their unit'
  UNION ALL SELECT 'one rep per district', (SELECT count(*) FROM (SELECT channel, district FROM ledger GROUP BY ALL HAVING count(DISTINCT rep) > 1)), ' districts with several reps'
  UNION ALL SELECT 'planned, not drawn', (SELECT count(*) FROM (SELECT DISTINCT channel FROM ledger)), ' owners vanished'
  UNION ALL SELECT 'drawn, not planned', (SELECT count(*) FROM (SELECT DISTINCT channel, district FROM ledger WHERE district = 'D0')), ' owners appeared')
SELECT "check", CASE WHEN n = 0 THEN 'pass' ELSE 'fail' END AS status, CAST(n AS VARCHAR) || s AS summary FROM c
""")
def ledger_audit(spark, d):
    led = the_ledger(spark, d)
    expected = led.where("unit <> 24").select("zip", "channel").unionByName(spark.createDataFrame([(1000000007, "BUILDING")], "zip long, channel string"))
    spec = led.select("channel").distinct().withColumn("k", F.when(F.col("channel") == "BUILDING", F.lit(6)).otherwise(F.lit(7)).cast("long"))
    mean = led.groupBy("channel", "district").agg(F.sum("m_rel").alias("m")).groupBy("channel").agg((0.98 * F.avg("m")).alias("low"), (1.02 * F.avg("m")).alias("high"))
    drawn = led.select("channel", "district").distinct()
    planned = drawn.where("district <> 'D0'").unionByName(drawn.select("channel", F.lit("D9").alias("district")).distinct())
    modes = led.select("channel").distinct().withColumn("mode", F.when(F.col("channel") == "BUILDING", "split").when(F.col("channel") == "FURNITURE", "clipped").otherwise("whole"))
    rows = checks.all_of(
        [
            checks.cells_check(led, expected, ["zip", "channel"]),
            checks.count_check(led, spec),
            checks.band_check(led, mean),
            checks.dropped_check(led, led.where("unit < 3").select("unit").distinct()),
            checks.mode_check(led, modes),
            checks.reps_check(led),
            checks.planned_check(planned, drawn, ["channel", "district"]),
        ]
    )
    return rows.select("check", "status", "summary")


@query("""
WITH x AS (SELECT s_suppkey, CASE WHEN s_suppkey % 11 = 0 THEN NULL ELSE s_acctbal END AS objective, CASE WHEN s_suppkey % 5 = 0 THEN NULL WHEN s_suppkey % 5 = 1 THEN s_acctbal WHEN s_suppkey % 5 = 2 THEN s_acctbal + 1 ELSE s_acctbal - abs(s_acctbal) * 0.01 END AS bound, CASE WHEN s_suppkey % 5 = 3 THEN 0.01 WHEN s_suppkey % 5 = 4 THEN 0.5 END AS gap FROM supplier)
SELECT s_suppkey, CASE WHEN objective IS NULL THEN 'none' WHEN bound > objective + 1e-6 * greatest(abs(objective), 1) THEN 'invalid' WHEN bound IS NULL THEN 'feasible only'
  WHEN gap IS NOT NULL AND abs(abs(objective - bound) / greatest(abs(objective), 1e-9) - gap) > 1e-6 + 1e-3 * abs(gap) THEN 'invalid' WHEN abs(objective - bound) / greatest(abs(objective), 1e-9) <= 1e-6 THEN 'exact' ELSE 'bounded' END AS tier FROM x
""")
def certificate_tiers(spark, d):
    key, bal = F.col("s_suppkey"), F.col("s_acctbal")
    m = key % 5
    objective = F.when(key % 11 != 0, bal)
    bound = F.when(m == 0, F.lit(None)).when(m == 1, bal).when(m == 2, bal + 1).otherwise(bal - F.abs(bal) * 0.01)
    gap = F.when(m == 3, F.lit(0.01)).when(m == 4, F.lit(0.5))
    x = t(spark, d, "supplier").select("s_suppkey", objective.alias("o"), bound.alias("b"), gap.alias("g"))
    return x.select("s_suppkey", checks.certificate(F.col("o"), F.col("b"), F.col("g")).alias("tier"))


@query("""
WITH a AS (SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN 'pass' ELSE 'fail' END AS v FROM supplier WHERE s_suppkey % 10 <> 1), b AS (SELECT s_suppkey, CASE WHEN s_acctbal > 1000 THEN 'pass' ELSE 'fail' END AS v FROM supplier WHERE s_suppkey % 10 <> 2)
SELECT coalesce(a.s_suppkey, b.s_suppkey) AS s_suppkey, a.v AS first, b.v AS second FROM a FULL JOIN b ON a.s_suppkey = b.s_suppkey WHERE a.v IS DISTINCT FROM b.v
""")
def verdict_flips(spark, d):
    s = t(spark, d, "supplier")
    v = lambda least, skip: s.where(F.col("s_suppkey") % 10 != skip).select("s_suppkey", F.when(F.col("s_acctbal") > least, "pass").otherwise("fail").alias("v"))
    return checks.flips(v(0, 1), v(1000, 2), ["s_suppkey"], "v")


@query(f"""
WITH {LEDGER}, u AS (SELECT channel, unit, sum(m_rel) AS mass FROM ledger GROUP BY ALL)
SELECT channel, round(sum(mass), 4) AS mass, 5 AS k, round(sum(mass) / 5, 4) AS tau, round(sum(mass) / 5 * (1 - 0.1), 4) AS low, round(sum(mass) / 5 * (1 + 0.1), 4) AS high FROM u GROUP BY ALL
""")
def instance_bands(spark, d):
    led = the_ledger(spark, d)
    ch = led.select("channel", "fine").distinct().withColumns({"k": F.lit(5), "delta": F.lit(0.1)})
    tau, _ = ledger.instance(led.select("zip", "fine", "m_rel"), ch, led.select("zip", "unit").distinct())
    return tau.select("channel", *(F.round(c, 4).alias(c) for c in ("mass",)), "k", *(F.round(c, 4).alias(c) for c in ("tau", "low", "high")))


@query(f"""
WITH {LEDGER}, a AS (SELECT * FROM ledger WHERE zip % 2 = 0), b AS (SELECT * FROM ledger WHERE zip % 2 = 1), u AS (SELECT 0 AS part, * FROM a UNION ALL SELECT 1, * FROM b)
SELECT zip, channel, CAST(dense_rank() OVER (PARTITION BY channel ORDER BY part, district) AS INTEGER) AS district, m_rel FROM u
""")
def ledger_merge(spark, d):
    led = the_ledger(spark, d)
    return ledger.merge([led.where("zip % 2 = 0"), led.where("zip % 2 = 1")], ["zip", "channel"]).select("zip", "channel", "district", "m_rel")


@query(f"""
WITH {LEDGER} SELECT scenario, zip, channel, district, 'M' || substr(rep, 2) AS rep, m_rel, m_rel > 0 AS has_commercial_opportunity FROM (SELECT 'one' AS scenario, * FROM ledger WHERE zip % 3 > 0 UNION ALL SELECT 'two', * FROM ledger WHERE zip % 3 < 2)
""")
def long_export(spark, d):
    led = the_ledger(spark, d)
    masked = led.select("rep").distinct().withColumn("alias", F.concat(F.lit("M"), F.substring("rep", 2, 9)))
    out = ledger.long_export({"one": led.where("zip % 3 > 0"), "two": led.where("zip % 3 < 2")}, ["zip", "channel"], masked)
    return out.select("scenario", "zip", "channel", "district", "rep", "m_rel", "has_commercial_opportunity")


@query("""
WITH a AS (SELECT c_mktsegment AS channel, c_custkey % 40 AS district, 'N' || CAST(c_nationkey % 6 AS VARCHAR) AS area, sum(CAST(c_acctbal AS DECIMAL(18,2))) AS m FROM customer GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY channel, district ORDER BY m DESC, area) AS n FROM a),
b AS (SELECT channel, district, sum(m) AS mass, concat_ws('-', max(CASE WHEN n = 1 THEN area END), max(CASE WHEN n = 2 THEN area END)) AS base FROM r GROUP BY ALL),
c AS (SELECT *, count(*) OVER (PARTITION BY base) AS same, row_number() OVER (PARTITION BY base ORDER BY mass DESC, channel, district) AS place FROM b)
SELECT channel, district, CAST(mass AS DOUBLE) AS mass, CASE WHEN same > 1 THEN base || ' ' || CAST(place AS VARCHAR) ELSE base END AS district_name FROM c
""")
def district_names(spark, d):
    a = t(spark, d, "customer").select(F.col("c_mktsegment").alias("channel"), (F.col("c_custkey") % 40).alias("district"), F.concat(F.lit("N"), (F.col("c_nationkey") % 6).cast("string")).alias("area"), F.col("c_acctbal").cast(CENTS).alias("m"))
    return ledger.named_districts(a, ["channel", "district"], "area", "m").withColumn("mass", dollars(F.col("mass")))


@query("""
WITH x AS (SELECT c_nationkey AS zip, c_mktsegment AS channel, c_custkey AS o, c_custkey % 6 AS district FROM customer)
SELECT channel, zip, arg_min(district, o) AS district, count(*) AS rows, count(DISTINCT district) - 1 AS conflicts FROM x GROUP BY ALL
""")
def channel_cells(spark, d):
    x = t(spark, d, "customer").select(F.col("c_nationkey").alias("zip"), F.col("c_mktsegment").alias("channel"), F.col("c_custkey").alias("o"), (F.col("c_custkey") % 6).alias("district"))
    return ledger.channel_cells(x, "o")


@query("""
WITH e AS (SELECT l_suppkey AS row, l_partkey % 50 AS col, sum(l_quantity) AS coef FROM lineitem WHERE l_linenumber = 1 GROUP BY ALL), c AS (SELECT DISTINCT l_partkey % 50 AS col, (l_partkey % 50) / 16.0 AS x, l_partkey % 50 < 25 AS integer FROM lineitem),
a AS (SELECT row, sum(coef * x) AS act FROM e JOIN c USING (col) GROUP BY ALL), r AS (SELECT s_suppkey AS row, 50.0 AS low, CASE WHEN s_suppkey % 2 = 0 THEN 2000.0 END AS high FROM supplier)
SELECT 'row' AS kind, CAST(r.row AS VARCHAR) AS name, greatest(coalesce(low - coalesce(act, 0), 0), coalesce(coalesce(act, 0) - high, 0)) AS by FROM r LEFT JOIN a ON a.row = r.row WHERE greatest(coalesce(low - coalesce(act, 0), 0), coalesce(coalesce(act, 0) - high, 0)) > 1e-6
UNION ALL SELECT 'integrality', CAST(col AS VARCHAR), abs(x - round(x)) FROM c WHERE integer AND abs(x - round(x)) > 1e-6
""")
def violations(spark, d):
    line = t(spark, d, "lineitem")
    col = F.col("l_partkey") % 50
    e = line.where("l_linenumber = 1").groupBy(F.col("l_suppkey").alias("row"), col.alias("col")).agg(F.sum("l_quantity").alias("coef"))
    c = line.select(col.alias("col"), (col / 16.0).cast("double").alias("x"), (col < 25).alias("integer")).distinct()
    r = t(spark, d, "supplier").select(F.col("s_suppkey").alias("row"), F.lit(50.0).alias("low"), F.when(F.col("s_suppkey") % 2 == 0, F.lit(2000.0)).alias("high"))
    return ledger.violations(r, c, e)


# ---- exports

@query("""
WITH m AS (SELECT quantile_cont(o_totalprice, 0.5) AS m FROM orders WHERE o_totalprice > 0),
r AS (SELECT o_orderkey, o_totalprice / m AS x FROM orders, m)
SELECT o_orderkey, round_even(x * pow(10.0, 5 - floor(log10(x))), 0) / pow(10.0, 5 - floor(log10(x))) AS m_rel FROM r
""")
def descale_median(spark, d):
    return export.descaled(t(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice").select("o_orderkey", "m_rel")


@query("""
WITH s AS (SELECT c_nationkey AS cell, c_mktsegment AS rep, sum(CAST(c_acctbal AS DECIMAL(18,2))) AS v FROM customer GROUP BY ALL), m AS (SELECT c_nationkey AS cell, CAST(sum(CAST(greatest(c_acctbal, 0) AS DECIMAL(18,2))) AS DOUBLE) * 0.9 AS mass FROM customer WHERE c_nationkey <> 4 GROUP BY ALL),
p AS (SELECT s.cell, s.rep, CAST(v AS DOUBLE) / mass AS share FROM s JOIN m USING (cell) WHERE v > 0)
SELECT cell, round(max(share + 0.5 * (0.5 - share)), 6) AS headroom, round(greatest(1 - sum(share), 0), 6) AS share_free, CASE WHEN sum(share) < 1 THEN 'untapped' ELSE 'contested' END AS kind, count(*) AS reps FROM p GROUP BY ALL
""")
def share_headroom(spark, d):
    c = t(spark, d, "customer")
    sales = c.select(F.col("c_nationkey").alias("cell"), F.col("c_mktsegment").alias("rep"), F.col("c_acctbal").cast(CENTS).alias("v"))
    sales = sales.groupBy("cell", "rep").agg(F.sum("v").cast("double").alias("v"))
    cells = c.where("c_nationkey <> 4").groupBy(F.col("c_nationkey").alias("cell")).agg((F.sum(F.greatest("c_acctbal", F.lit(0.0)).cast(CENTS)).cast("double") * 0.9).alias("mass"))
    s = export.shares(sales, cells, ["cell"], "rep", "v", "mass").where("share is not null")
    return s.select("cell", F.round(export.headroom("share", 0.5, 0.5), 6).alias("headroom"), F.round("share_free", 6).alias("share_free"), "kind", F.size("share").cast("long").alias("reps"))


@query("""
WITH x AS (SELECT s_name AS name, s_nationkey % 4 AS ch, CAST(s_acctbal AS DECIMAL(18,2)) AS v FROM supplier), g AS (SELECT name, sum(v) AS tot, sum(v) FILTER (ch = 2) AS f FROM x GROUP BY ALL)
SELECT name, 'R' || lpad(CAST(row_number() OVER (ORDER BY f IS NULL, f DESC, tot DESC, name) AS VARCHAR), 3, '0') AS surrogate FROM g
""")
def surrogate_ids(spark, d):
    x = t(spark, d, "supplier").select(F.col("s_name").alias("name"), (F.col("s_nationkey") % 4).alias("ch"), F.col("s_acctbal").cast(CENTS).alias("v"))
    return export.surrogates(x, "ch", "name", "v", 2)


@query("""
WITH x AS (SELECT upper(c_mktsegment) AS canonical, CASE WHEN c_custkey % 3 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END AS spelling, c_nationkey AS k, CAST(c_acctbal AS DECIMAL(18,2)) AS v FROM customer),
g AS (SELECT canonical, string_agg(DISTINCT spelling, ',' ORDER BY spelling) AS spellings, count(*) AS rows, count(DISTINCT k) AS keys, CAST(sum(v) AS DOUBLE) AS amount FROM x GROUP BY ALL)
SELECT canonical, spellings, rows, keys, amount, round(amount / sum(amount) OVER (), 6) AS share FROM g
""")
def channel_review(spark, d):
    spelling = F.when(F.col("c_custkey") % 3 == 0, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment"))
    x = t(spark, d, "customer").select(F.upper("c_mktsegment").alias("canonical"), spelling.alias("spelling"), F.col("c_nationkey").alias("k"), F.col("c_acctbal").cast(CENTS).alias("v"))
    r = export.channel_review(x, "canonical", "spelling", "k", "v")
    amount = dollars(F.col("amount"))
    return r.select("canonical", F.array_join("spellings", ",").alias("spellings"), "rows", "keys", amount.alias("amount"), F.round(amount / F.sum(amount).over(Window.partitionBy()), 6).alias("share"))


@query("""
SELECT coalesce(c_mktsegment, '') AS c_mktsegment, string_agg(DISTINCT CAST(c_nationkey % 4 AS VARCHAR), ',' ORDER BY CAST(c_nationkey % 4 AS VARCHAR)) AS areas, round(100.0 * CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) / CAST((SELECT sum(CAST(c_acctbal AS DECIMAL(18,2))) FROM customer) AS DOUBLE), 2) AS pct FROM customer GROUP BY ALL
""")
def label_mix(spark, d):
    area = (F.col("c_nationkey") % 4).cast("string")
    g = t(spark, d, "customer").withColumn("area", area).groupBy("c_mktsegment").agg(F.expr("listagg(DISTINCT area, ',') WITHIN GROUP (ORDER BY area)").alias("areas"), F.sum(F.col("c_acctbal").cast(CENTS)).alias("s"))
    return g.select("c_mktsegment", "areas", F.round(F.lit(100.0) * F.col("s").cast("double") / F.sum("s").over(Window.partitionBy()).cast("double"), 2).alias("pct"))


@query("""
SELECT c_nationkey AS place, count(*) AS n FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey % 5 = 0) AND (c_mktsegment = 'BUILDING' OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)) GROUP BY ALL
""")
def coverage_gap(spark, d):
    c, big = t(spark, d, "customer"), t(spark, d, "orders").where("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("_big", F.lit(True))
    held = t(spark, d, "supplier").where("s_suppkey % 5 = 0").select(F.col("s_nationkey").alias("c_nationkey")).distinct()
    gap = c.join(held, "c_nationkey", "left_anti").join(big, "c_custkey", "left").where((F.col("c_mktsegment") == "BUILDING") | F.col("_big").isNotNull())
    return gap.groupBy(F.col("c_nationkey").alias("place")).agg(F.count("*").alias("n"))


@query("""
SELECT CAST(year(o_orderdate) AS INTEGER) AS y, count(*) AS n FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-03-01' AND DATE '1998-02-28' AND o_custkey IN (SELECT c_custkey FROM customer GROUP BY ALL HAVING sum(c_acctbal) > 0) GROUP BY ALL
""")
def period_filter_positive_keys(spark, d):
    pos = ledger.positive_keys(t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_acctbal").alias("m_rel")), "o_custkey")
    return ledger.subset(t(spark, d, "orders").where(norm.in_period("o_orderdate", "1996-03-01", "1998-02-28")), pos).groupBy(F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"))
