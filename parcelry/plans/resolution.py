"""Keys, rules, entities and holders on the driver's tables.

A nation is a place, a part's brand and type an entity, a market segment a label or channel, a supplier a holder, a
customer a seller or an agent's code.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from parcelry.functions import norm
from parcelry.functions.text import similarity
from parcelry.operators import coverage, resolve, review, rules
from parcelry.plans.registry import query, t

CENTS = "decimal(18,2)"


def dollars(c):
    return c.cast("double")


@query("""
SELECT c_custkey, lpad(left(trim(CAST(c_custkey AS VARCHAR)), 5), 5, '0') AS key5,
  nullif(upper(trim(c_mktsegment)), '') AS label, nullif(CAST(c_custkey AS VARCHAR), '0') AS opaque,
  trim(regexp_replace(lower(trim(c_name)), '[ \\-/().]+', '_', 'g'), '_') AS token, split_part(c_name, '#', 2) AS part2,
  length(translate(c_name, '0123456789', '')) > 0 AS non_digit,
  CASE WHEN c_acctbal < 0 THEN 'DEBT' WHEN c_mktsegment LIKE 'BUILD%' THEN 'BUILD' WHEN c_name ILIKE '%#0000001%' THEN 'EARLY' END AS kind,
  CAST(c_nationkey AS VARCHAR) || '|' || nullif(upper(trim(c_mktsegment)), '') AS cell,
  greatest(c_acctbal, 0.0) AS positive, CAST(floor(CAST(c_acctbal AS DECIMAL(20,6)) * 100) AS BIGINT) AS hundredths
FROM customer
""")
def normalize_keys(spark, d):
    c = t(spark, d, "customer")
    kind = norm.first_match([(F.col("c_acctbal") < 0, "DEBT"), (F.col("c_mktsegment").like("BUILD%"), "BUILD"), (F.col("c_name").ilike("%#0000001%"), "EARLY")])
    return c.select(
        "c_custkey",
        norm.key5("c_custkey").alias("key5"),
        norm.label("c_mktsegment").alias("label"),
        norm.opaque_id("c_custkey").alias("opaque"),
        norm.token("c_name").alias("token"),
        F.split_part("c_name", F.lit("#"), F.lit(2)).alias("part2"),
        norm.has_non_digit("c_name").alias("non_digit"),
        kind.alias("kind"),
        norm.joined_key("c_nationkey", norm.label("c_mktsegment")).alias("cell"),
        F.greatest("c_acctbal", F.lit(0.0)).alias("positive"),
        norm.centimetres("c_acctbal").alias("hundredths"),
    )


@query("""
SELECT s_suppkey, CASE WHEN s_acctbal = 0 THEN s_acctbal ELSE round_even(s_acctbal * pow(10.0, 3 - floor(log10(abs(s_acctbal)))), 0) / pow(10.0, 3 - floor(log10(abs(s_acctbal)))) END AS significant,
  s_acctbal BETWEEN -100 AND 5000 AS in_band, abs(s_acctbal / nullif(5000.0, 0) - 1) AS deviation,
  2 * least(s_acctbal - 0.0, 10000.0 - s_acctbal) / 10000.0 AS headroom
FROM supplier
""")
def scalar_measures(spark, d):
    s = t(spark, d, "supplier")
    return s.select(
        "s_suppkey",
        norm.significant("s_acctbal", 4).alias("significant"),
        norm.within("s_acctbal", F.lit(-100.0), F.lit(5000.0)).alias("in_band"),
        norm.deviation("s_acctbal", F.lit(5000.0)).alias("deviation"),
        norm.headroom("s_acctbal", F.lit(0.0), F.lit(10000.0)).alias("headroom"),
    )


RULES = [(1, "Brand#1", None, None, "R1"), (2, None, "PROMO", None, "R2"), (3, "Brand#7", None, None, "R3"), (4, None, None, 7, "R4"), (5, None, "SMALL", None, "R5"), (6, "Brand#1", "LARGE", None, "R6")]
_rules = "(VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else repr(v) for v in r) + ")" for r in RULES) + ") AS r(rule_order, brand, kind, size, channel)"


@query(f"""
SELECT p_partkey, p_brand, p_type, p_size, channel, CAST(rule_order AS INTEGER) AS rule_order FROM (
  SELECT p.p_partkey, p.p_brand, p.p_type, p.p_size, r.channel, r.rule_order, row_number() OVER (PARTITION BY p.p_partkey ORDER BY r.rule_order) AS n
  FROM part p LEFT JOIN {_rules} ON p.p_brand = r.brand OR p.p_type = r.kind OR p.p_size = r.size) WHERE n = 1
""")
def rule_priority_join(spark, d):
    r = rules.rule_table(spark, RULES, "rule_order int, brand string, kind string, size int, channel string")
    return rules.priority_join(t(spark, d, "part").select("p_partkey", "p_brand", "p_type", "p_size"), r, {"p_brand": "brand", "p_type": "kind", "p_size": "size"}, "rule_order", ["channel"]).join(
        r.select(F.col("channel").alias("_c"), "rule_order"), F.col("channel") == F.col("_c"), "left"
    ).drop("_c")


OVERRIDES = [("Brand#2", "PROMO", "OV-PROMO"), ("Brand#2", None, "OV-ANY"), ("Brand#9", None, "OV-9"), ("Brand#11", "SMALL", "OV-S"), ("Brand#99", None, "NEVER")]
_over = "(VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else repr(v) for v in r) + ")" for r in OVERRIDES) + ") AS o(brand, kind, label)"


@query(f"""
WITH o AS (SELECT * FROM {_over})
SELECT p.p_partkey, p.p_brand, p.p_type, coalesce(e.label, w.label) AS override
FROM part p LEFT JOIN o e ON e.brand = p.p_brand AND e.kind = p.p_type LEFT JOIN o w ON w.brand = p.p_brand AND w.kind IS NULL
""")
def override_specific_general(spark, d):
    o = rules.rule_table(spark, OVERRIDES, "p_brand string, p_type string, label string")
    return rules.override_join(t(spark, d, "part").select("p_partkey", "p_brand", "p_type"), o, ["p_brand", "p_type"], "p_type", "label")


@query("""
SELECT o_custkey, count(DISTINCT o_orderstatus) AS k, CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN min(o_orderstatus) END AS only_status FROM orders GROUP BY o_custkey
""")
def unique_or_null_lookup(spark, d):
    return rules.unique_lookup(t(spark, d, "orders"), ["o_custkey"], "o_orderstatus", "only_status")


@query("""
WITH a AS (SELECT o_custkey AS k1, nullif(o_orderpriority, '5-LOW') AS k2, count(*) AS n FROM orders GROUP BY 1, 2),
     b AS (SELECT o_custkey AS k1, nullif(o_orderpriority, '5-LOW') AS k2, max(o_orderkey) AS top FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2)
SELECT a.k1, a.k2, a.n, b.top FROM a LEFT JOIN b ON a.k1 = b.k1 AND a.k2 IS NOT DISTINCT FROM b.k2
""")
def null_safe_multi_key_join(spark, d):
    o = t(spark, d, "orders").select(F.col("o_custkey").alias("k1"), F.nullif("o_orderpriority", F.lit("5-LOW")).alias("k2"), "o_orderkey", "o_orderstatus")
    a = o.groupBy("k1", "k2").agg(F.count("*").alias("n"))
    b = o.where("o_orderstatus = 'F'").groupBy("k1", "k2").agg(F.max("o_orderkey").alias("top"))
    return rules.null_safe_join(a, b, ["k1", "k2"])


@query("""
SELECT o_custkey, o_orderkey, price FROM (
  SELECT o_custkey, o_orderkey, floor(o_totalprice / 50000) AS price, row_number() OVER w AS n, lead(floor(o_totalprice / 50000)) OVER w AS nx
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY floor(o_totalprice / 50000) DESC, o_orderkey)) WHERE n = 1 AND price > nx
""")
def strict_maximum(spark, d):
    o = t(spark, d, "orders").select("o_custkey", "o_orderkey", F.floor(F.col("o_totalprice") / 50000).cast("double").alias("price"))
    return rules.strict_maximum(o, ["o_custkey"], "price", ["o_orderkey"])


@query("""
SELECT o_custkey, o_orderkey, o_totalprice, CAST(rank AS INTEGER) AS rank FROM (
  SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3
""")
def top_k_per_group(spark, d):
    return rules.top_k(t(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 3)


PATTERNS = [("ECONOMY", "%ring", "jewel"), ("ECONOMY", "red%", "red"), ("PROMO", "%WIDGET%", "widget"), ("SMALL", "%bolt", "bolt")]
_pat = "(VALUES " + ", ".join(str(p) for p in PATTERNS) + ") AS q(kind, pattern, tag)"


@query(f"""
SELECT p.p_partkey, p.p_type, p.p_name, q.pattern, q.tag FROM part p LEFT JOIN {_pat} ON p.p_type = q.kind AND p.p_name ILIKE q.pattern
""")
def pattern_join(spark, d):
    q = rules.rule_table(spark, PATTERNS, "p_type string, pattern string, tag string")
    return rules.pattern_join(t(spark, d, "part").select("p_partkey", "p_type", "p_name"), q, ["p_type"], "p_name", "pattern")


_lists = """
lists AS (SELECT DISTINCT CASE WHEN l_linenumber % 3 = 0 THEN CAST(l_suppkey % 40 AS VARCHAR) || '|' || CAST(l_partkey % 60 AS VARCHAR) || '|' ELSE CAST(l_suppkey % 40 AS VARCHAR) END AS ids, l_returnflag AS flag FROM lineitem)"""


@query(f"""
WITH {_lists}, parts AS (SELECT ids, trim(unnest(string_split(ids, '|'))) AS ident, flag FROM lists),
single AS (SELECT DISTINCT ident, flag FROM parts WHERE ids NOT LIKE '%|%' AND ident <> '')
SELECT ident, flag FROM single
UNION SELECT ident, flag FROM parts WHERE ids LIKE '%|%' AND ident <> '' AND ident NOT IN (SELECT ident FROM single)
""")
def list_key_precedence(spark, d):
    line = t(spark, d, "lineitem")
    one = (F.col("l_suppkey") % 40).cast("string")
    ids = F.when(F.col("l_linenumber") % 3 == 0, F.concat(one, F.lit("|"), (F.col("l_partkey") % 60).cast("string"), F.lit("|"))).otherwise(one)
    return rules.listed_keys(line.select(ids.alias("ident"), F.col("l_returnflag").alias("flag")).distinct(), "ident", ["flag"])


@query("""
SELECT s_nationkey, min(s_suppkey) AS holder, count(DISTINCT s_suppkey) AS n_holders FROM supplier GROUP BY s_nationkey
""")
def holder_lowest_id(spark, d):
    return coverage.lowest_holder(t(spark, d, "supplier"), ["s_nationkey"], "s_suppkey")


# cells: customer's place x segment; territories: suppliers hold (place, channel by key)
CHANNELS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
_channel = "CASE s_suppkey % 5 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CHANNELS)) + " END"
_terr = f"terr AS (SELECT s_nationkey AS place, {_channel} AS channel, s_suppkey AS holder_id, s_name FROM supplier WHERE s_suppkey % 5 <> 3)"
_cells = """
opp AS (SELECT c_nationkey AS place, c_mktsegment AS current_channel,
  CASE WHEN c_custkey % 4 = 0 THEN 'BUILDING' WHEN c_custkey % 9 = 0 THEN 'NONESUCH' WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END AS new_channel,
  CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS opp FROM customer GROUP BY ALL)"""
_h = "h AS (SELECT place, channel, min(holder_id) AS holder, count(DISTINCT holder_id) AS n_holders FROM terr GROUP BY ALL)"


def territories(spark, d):
    s = t(spark, d, "supplier").where("s_suppkey % 5 <> 3")
    channel = norm.first_match([(F.col("s_suppkey") % 5 == i, c) for i, c in enumerate(CHANNELS)])
    return s.select(F.col("s_nationkey").alias("place"), channel.alias("channel"), F.col("s_suppkey").alias("holder_id"), "s_name")


def opportunity(spark, d):
    key = F.col("c_custkey")
    new = F.when(key % 4 == 0, "BUILDING").when(key % 9 == 0, "NONESUCH").when(key % 7 == 0, F.lit(None)).otherwise(F.col("c_mktsegment"))
    c = t(spark, d, "customer").withColumn("new_channel", new)
    return c.groupBy(F.col("c_nationkey").alias("place"), F.col("c_mktsegment").alias("current_channel"), "new_channel").agg(F.sum(F.col("c_acctbal").cast(CENTS)).cast("double").alias("opp"))


_states = """
states AS (SELECT place, 'CURRENT' AS state, current_channel AS state_channel, opp FROM opp UNION ALL SELECT place, 'NEW', new_channel, opp FROM opp),
told AS (SELECT s.*, h.holder, h.n_holders, CASE WHEN s.state_channel IS NULL THEN 'NO CHANNEL' WHEN s.state_channel NOT IN (SELECT channel FROM terr) THEN 'NO MAP' WHEN h.holder IS NULL THEN 'NO HOLDER AT PLACE' ELSE 'COVERED' END AS coverage
         FROM states s LEFT JOIN h ON h.place = s.place AND h.channel = s.state_channel)"""


def covered(spark, d):
    terr = territories(spark, d)
    h = coverage.lowest_holder(terr, ["place", "channel"], "holder_id")
    return coverage.covered(opportunity(spark, d), h, "place", {"CURRENT": "current_channel", "NEW": "new_channel"}, "channel", terr.select("channel"))


@query(f"""
WITH {_terr}, {_cells}, {_h}, {_states},
g AS (SELECT state, coverage, count(*) AS cells, sum(CAST(opp AS DECIMAL(18,2))) AS total, count(DISTINCT holder) AS holders FROM told GROUP BY ALL)
SELECT state, coverage, cells, CAST(total AS DOUBLE) AS total, holders, round(100 * CAST(total AS DOUBLE) / CAST(sum(total) OVER (PARTITION BY state) AS DOUBLE), 2) AS pct FROM g
""")
def coverage_states(spark, d):
    from pyspark.sql import Window

    g = covered(spark, d).groupBy("state", "coverage").agg(F.count("*").alias("cells"), F.sum(F.col("opp").cast(CENTS)).alias("total"), F.countDistinct("holder").alias("holders"))
    pct = F.round(100 * F.col("total").cast("double") / F.sum("total").over(Window.partitionBy("state")).cast("double"), 2)
    return g.select("state", "coverage", "cells", dollars(F.col("total")).alias("total"), "holders", pct.alias("pct"))


@query(f"""
WITH {_terr}, {_cells}, {_h}, {_states},
v AS (
  SELECT 'CHANNEL' AS part, state, state_channel AS name, CAST(NULL AS VARCHAR) AS name2, CAST(opp AS DECIMAL(18,2)) AS amount FROM told
  UNION ALL SELECT 'RECLASSIFIED', CAST(NULL AS VARCHAR), current_channel, new_channel, CAST(opp AS DECIMAL(18,2)) FROM opp WHERE current_channel IS DISTINCT FROM new_channel
  UNION ALL SELECT 'COVERAGE', state, coverage, NULL, CAST(opp AS DECIMAL(18,2)) FROM told)
SELECT part, state, name, name2, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS amount FROM v GROUP BY ALL
""")
def state_views(spark, d):
    told, opp = covered(spark, d), opportunity(spark, d)
    amount = F.col("opp").cast(CENTS).alias("amount")
    from parcelry.operators.checks import all_of

    v = all_of(
        [
            told.select(F.lit("CHANNEL").alias("part"), "state", F.col("state_channel").alias("name"), F.lit(None).cast("string").alias("name2"), amount),
            opp.where(~F.col("current_channel").eqNullSafe(F.col("new_channel"))).select(F.lit("RECLASSIFIED").alias("part"), F.col("current_channel").alias("name"), F.col("new_channel").alias("name2"), amount),
            told.select(F.lit("COVERAGE").alias("part"), "state", F.col("coverage").alias("name"), amount),
        ]
    )
    return v.groupBy("part", "state", "name", "name2").agg(F.count("*").alias("n"), dollars(F.sum("amount")).alias("amount"))


@query(f"""
WITH {_terr}, f AS (SELECT c_custkey, c_nationkey AS place, c_mktsegment AS channel, c_custkey % (SELECT count(*) FROM supplier) AS seller FROM customer)
SELECT f.c_custkey, f.place, f.channel, f.seller, EXISTS (SELECT 1 FROM terr t WHERE t.place = f.place AND t.channel = f.channel AND t.holder_id = f.seller) AS held FROM f
""")
def held_by_seller(spark, d):
    n = t(spark, d, "supplier").agg(F.count("*").alias("n"))
    f = t(spark, d, "customer").crossJoin(F.broadcast(n)).select("c_custkey", F.col("c_nationkey").alias("place"), F.col("c_mktsegment").alias("channel"), (F.col("c_custkey") % F.col("n")).alias("seller"))
    return coverage.held_by(f, territories(spark, d), "place", "channel", "seller", "holder_id", "held")


# ---- entities

_labelled = "SELECT p_brand, p_type, CASE WHEN p_size % 10 = 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 'B2B' ELSE 'RETAIL' END WHEN p_size = 7 THEN 'RETAIL' END AS label FROM part"


@query(f"""
WITH lab AS ({_labelled}), e AS (SELECT DISTINCT p_brand, p_type FROM part),
own(p_brand, p_type, label) AS (VALUES ('Brand#3', 'PROMO', 'OWNED'), ('Brand#4', 'LARGE', 'OWNED')),
fb(p_brand, label) AS (VALUES ('Brand#5', 'FB'), ('Brand#6', 'FB')),
ke AS (SELECT p_brand, p_type, count(DISTINCT label) AS k, min(label) AS v FROM lab WHERE label IS NOT NULL GROUP BY ALL),
ki AS (SELECT p_brand, count(DISTINCT label) AS k, min(label) AS v FROM lab WHERE label IS NOT NULL GROUP BY ALL)
SELECT e.p_brand, e.p_type, coalesce(ke.k, 0) AS labels,
  coalesce(own.label, CASE WHEN ke.k = 1 THEN ke.v END, CASE WHEN ki.k = 1 THEN ki.v END, fb.label, 'UNMAPPED') AS route,
  CASE WHEN own.label IS NOT NULL THEN 'OWNER' WHEN ke.k = 1 THEN 'ENTITY, ONE LABEL' || CASE WHEN ki.k > 1 THEN ' OF SEVERAL AT ID' ELSE '' END
       WHEN ki.k = 1 THEN 'ID, ONE LABEL' WHEN fb.label IS NOT NULL THEN 'FALLBACK' ELSE 'UNMAPPED' END AS route_basis
FROM e LEFT JOIN own USING (p_brand, p_type) LEFT JOIN ke USING (p_brand, p_type) LEFT JOIN ki USING (p_brand) LEFT JOIN fb USING (p_brand)
""")
def entity_route_cascade(spark, d):
    p = t(spark, d, "part")
    label = F.when(F.col("p_size") % 10 == 0, F.when(F.col("p_partkey") % 2 == 0, "B2B").otherwise("RETAIL")).when(F.col("p_size") == 7, "RETAIL")
    own = rules.rule_table(spark, [("Brand#3", "PROMO", "OWNED"), ("Brand#4", "LARGE", "OWNED")], "p_brand string, p_type string, label string")
    fb = rules.rule_table(spark, [("Brand#5", "FB"), ("Brand#6", "FB")], "p_brand string, label string")
    return resolve.entity_route(p.select("p_brand", "p_type").distinct(), p.select("p_brand", "p_type", label.alias("label")), own, fb, ["p_brand", "p_type"])


_fact = """
cand AS (SELECT DISTINCT l_suppkey % 30 AS company, p_brand AS entity, CASE WHEN length(p_brand) = 7 THEN 'AUTOMOBILE' WHEN p_brand < 'Brand#2' THEN 'BUILDING' ELSE 'MACHINERY' END AS route
         FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity > 49 AND l_suppkey % 30 < 25),
cell AS (SELECT c_nationkey AS place, p_brand AS entity, floor(sum(CAST(l_extendedprice AS DECIMAL(18,2))) / 20000) AS weight
         FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE l_linenumber = 1 GROUP BY ALL),
f AS (SELECT o_orderkey, nullif(o_custkey % 30, 29) AS company, c_mktsegment AS label, c_nationkey AS place, CASE WHEN o_custkey % 3 > 0 THEN o_custkey % 17 END AS code
      FROM orders JOIN customer ON c_custkey = o_custkey),
opts AS (SELECT f.company, f.label, f.place, f.code, c.entity, c.route = f.label AS fits, cell.weight
         FROM (SELECT DISTINCT company, label, place, code FROM f) f LEFT JOIN cand c ON c.company = f.company LEFT JOIN cell ON cell.place = f.place AND cell.entity = c.entity),
told AS (SELECT company, label, place, code, coalesce(list_sort(list(DISTINCT entity) FILTER (entity IS NOT NULL)), []) AS known, coalesce(list_sort(list(DISTINCT entity) FILTER (fits)), []) AS fitting,
           coalesce(list_sort(list(DISTINCT entity) FILTER (fits AND weight IS NOT NULL)), []) AS here, coalesce(list_reverse_sort(list(DISTINCT {'w': weight, 'e': entity}) FILTER (fits AND weight IS NOT NULL)), []) AS heavy
         FROM opts GROUP BY company, label, place, code),
agreed AS (SELECT company, label, code, list(DISTINCT here[1]) AS names FROM told WHERE len(fitting) > 1 AND len(here) = 1 AND code IS NOT NULL GROUP BY company, label, code),
verdict AS (SELECT told.*, CASE WHEN told.company IS NULL THEN 'NO KEY' WHEN len(known) = 0 THEN 'NO ENTITY' WHEN len(known) = 1 THEN 'ONE ENTITY' WHEN len(fitting) = 0 THEN 'NONE MATCHES' WHEN len(fitting) = 1 THEN 'MATCHED BY LABEL'
             WHEN len(here) = 1 THEN 'MATCHED BY PLACE' WHEN len(names) = 1 THEN 'MATCHED BY CODE' WHEN len(heavy) > 1 AND heavy[1].w > heavy[2].w THEN 'MOST WEIGHT AT PLACE' ELSE 'SEVERAL MATCH' END AS basis, names
            FROM told LEFT JOIN agreed ON agreed.company = told.company AND agreed.label = told.label AND agreed.code = told.code),
r AS (SELECT f.*, basis, CASE basis WHEN 'ONE ENTITY' THEN known[1] WHEN 'MATCHED BY LABEL' THEN fitting[1] WHEN 'MATCHED BY PLACE' THEN here[1] WHEN 'MATCHED BY CODE' THEN names[1] WHEN 'MOST WEIGHT AT PLACE' THEN heavy[1].e END AS resolved
      FROM f JOIN verdict v ON v.company IS NOT DISTINCT FROM f.company AND v.label = f.label AND v.place = f.place AND v.code IS NOT DISTINCT FROM f.code)"""

def facts_resolved(spark, d):
    p, o, c = t(spark, d, "part"), t(spark, d, "orders"), t(spark, d, "customer")
    line = t(spark, d, "lineitem").join(p, F.col("p_partkey") == F.col("l_partkey"))
    route = F.when(F.length("p_brand") == 7, "AUTOMOBILE").when(F.col("p_brand") < "Brand#2", "BUILDING").otherwise("MACHINERY")
    company = F.col("l_suppkey") % 30
    cand = line.where((F.col("l_quantity") > 49) & (company < 25)).select(company.alias("company"), F.col("p_brand").alias("entity"), route.alias("route")).distinct()
    oc = o.join(c, F.col("c_custkey") == F.col("o_custkey"))
    weight = F.floor(F.sum(F.col("l_extendedprice").cast(CENTS)).cast("double") / 20000)
    cell = line.where("l_linenumber = 1").join(oc, F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("c_nationkey").alias("place"), F.col("p_brand").alias("entity")).agg(weight.alias("weight"))
    code = F.when(F.col("o_custkey") % 3 > 0, F.col("o_custkey") % 17)
    f = oc.select("o_orderkey", F.nullif(F.col("o_custkey") % 30, F.lit(29).cast("long")).alias("company"), F.col("c_mktsegment").alias("label"), F.col("c_nationkey").alias("place"), code.alias("code"))
    return resolve.resolve_facts(f, cand, cell, key="company", entity="entity", label="label", place=["place"], code="code", fact=["company", "label", "place", "code"])


@query(f"WITH {_fact} SELECT o_orderkey, basis, resolved FROM r")
def fact_resolution(spark, d):
    return facts_resolved(spark, d).select("o_orderkey", "basis", "resolved")


CODES = [(3, 5, "MAN-5"), (3, None, "MAN-ANY"), (8, None, "MAN-8"), (11, 2, "MAN-2")]


@query(f"""
WITH {_fact}, a(company, code, entity) AS (VALUES (3, 5, 'MAN-5'), (3, NULL, 'MAN-ANY'), (8, NULL, 'MAN-8'), (11, 2, 'MAN-2'))
SELECT r.o_orderkey, r.basis, coalesce(x.entity, y.entity, r.resolved) AS assigned FROM r LEFT JOIN a x ON x.company = r.company AND x.code = r.code LEFT JOIN a y ON y.company = r.company AND y.code IS NULL
""")
def manual_override(spark, d):
    a = rules.rule_table(spark, CODES, "company long, code long, entity string")
    return resolve.assign(facts_resolved(spark, d), a, "company", "code", "entity").select("o_orderkey", "basis", "assigned")


# ---- holders and facts

@query(f"""
WITH {_terr}, {_cells}, {_h}, {_states},
sale AS (SELECT s_nationkey AS place, l_suppkey AS seller, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS sales FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_linenumber = 2 GROUP BY ALL),
u AS (SELECT place, holder, CAST(opp AS DECIMAL(18,2)) AS old_opp, 0 AS new_opp, 0 AS sales FROM told WHERE state = 'CURRENT'
  UNION ALL SELECT place, holder, 0, CAST(opp AS DECIMAL(18,2)), 0 FROM told WHERE state = 'NEW'
  UNION ALL SELECT place, seller, 0, 0, sales FROM sale)
SELECT place, holder, CAST(sum(old_opp) AS DOUBLE) AS old_opp, CAST(sum(new_opp) AS DOUBLE) AS new_opp, CAST(sum(sales) AS DOUBLE) AS sales FROM u GROUP BY ALL
""")
def holder_fact_merge(spark, d):
    told = covered(spark, d)
    line = t(spark, d, "lineitem").where("l_linenumber = 2").join(t(spark, d, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    sale = line.groupBy(F.col("s_nationkey").alias("place"), F.col("l_suppkey").alias("seller")).agg(F.sum(F.col("l_extendedprice").cast(CENTS)).alias("sales"))
    m = coverage.merged(
        {"old_opp": (told.where("state = 'CURRENT'").withColumn("old_opp", F.col("opp").cast(CENTS)), "holder"), "new_opp": (told.where("state = 'NEW'").withColumn("new_opp", F.col("opp").cast(CENTS)), "holder"), "sales": (sale, "seller")},
        ["place"],
    )
    return m.select("place", "holder", *(dollars(F.col(x)).alias(x) for x in ("old_opp", "new_opp", "sales")))


_pairs = """
o AS (SELECT s_nationkey AS place, s_suppkey AS holder_id, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS r FROM supplier WHERE s_suppkey % 5 <> 3),
n AS (SELECT s_nationkey AS place, s_suppkey AS holder_id, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS r FROM supplier WHERE s_suppkey % 3 <> 1),
pr AS (SELECT coalesce(o.place, n.place) AS place, coalesce(o.r, n.r) AS r, o.holder_id AS old_holder_id, n.holder_id AS new_holder_id FROM o FULL JOIN n ON n.place = o.place AND n.r = o.r)"""


def pairs_of(spark, d):
    s = t(spark, d, "supplier").select(F.col("s_nationkey").alias("place"), F.col("s_suppkey").alias("holder_id"))
    return coverage.paired(s.where("holder_id % 5 <> 3"), s.where("holder_id % 3 <> 1"), ["place"], "holder_id")


@query(f"WITH {_pairs} SELECT place, CAST(r AS INTEGER) AS r, old_holder_id, new_holder_id FROM pr")
def paired_holders(spark, d):
    return pairs_of(spark, d)


@query(f"""
WITH {_pairs}, s AS (SELECT l_orderkey, l_linenumber, l_partkey, s_nationkey AS place, l_suppkey AS seller, l_extendedprice AS amount FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_quantity > 45),
x AS (SELECT s.place, s.seller, s.amount, pr.r, pr.old_holder_id, pr.new_holder_id FROM s LEFT JOIN pr a ON a.place = s.place AND a.old_holder_id = s.seller LEFT JOIN pr ON pr.place = s.place AND pr.r = coalesce(a.r, 1))
SELECT place, old_holder_id, new_holder_id, count(*) AS n, CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS sales FROM x GROUP BY ALL
""")
def sales_on_one_pair(spark, d):
    line = t(spark, d, "lineitem").where("l_quantity > 45").join(t(spark, d, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    s = line.select(F.col("s_nationkey").alias("place"), F.col("l_suppkey").alias("seller"), F.col("l_extendedprice").alias("amount"))
    x = coverage.placed(s, pairs_of(spark, d), ["place"], "seller", "old_holder_id")
    return x.groupBy("place", "old_holder_id", "new_holder_id").agg(F.count("*").alias("n"), dollars(F.sum(F.col("amount").cast(CENTS))).alias("sales"))


@query(f"""
WITH {_terr}, g AS (SELECT place, channel, holder_id, min(s_name) AS nm FROM terr GROUP BY ALL)
SELECT place, channel, holder_id, min(nm) OVER (PARTITION BY holder_id) AS s_name FROM g
""")
def territory_dimension(spark, d):
    return coverage.dimension(territories(spark, d), ["place", "channel"], "holder_id", "s_name")


# ---- base facts

_signed = "base AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag, CAST(l_extendedprice AS DECIMAL(18,2)) * CASE WHEN l_orderkey % 50 = 0 THEN 0 WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS amount FROM lineitem)"


def signed_lines(spark, d):
    sign = F.when(F.col("l_orderkey") % 50 == 0, 0).when(F.col("l_returnflag") == "R", -1).otherwise(1)
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", (F.col("l_extendedprice").cast(CENTS) * sign).alias("amount"))


@query(f"""
WITH {_signed}, k AS (SELECT l_orderkey FROM base GROUP BY 1 HAVING sum(amount) <> 0)
SELECT l_returnflag, count(*) AS n, count(DISTINCT l_orderkey) AS orders, CAST(sum(amount) AS DOUBLE) AS amount FROM base WHERE l_orderkey IN (SELECT l_orderkey FROM k) GROUP BY ALL
""")
def net_zero_filter(spark, d):
    kept = coverage.not_net_zero(signed_lines(spark, d), ["l_orderkey"], "amount")
    return kept.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.countDistinct("l_orderkey").alias("orders"), dollars(F.sum("amount")).alias("amount"))


@query("""
WITH p AS (SELECT l_orderkey, l_returnflag, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS part FROM lineitem GROUP BY ALL)
SELECT p.l_orderkey, p.l_returnflag, round(o_totalprice * part / nullif(sum(part) OVER (PARTITION BY p.l_orderkey), 0), 2) AS allocated FROM p JOIN orders ON o_orderkey = p.l_orderkey
""")
def ticket_allocation(spark, d):
    parts = t(spark, d, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(dollars(F.sum(F.col("l_extendedprice").cast(CENTS))).alias("part"))
    total = t(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice")
    return coverage.allocated(parts, ["l_orderkey"], "part", total, "o_totalprice").select("l_orderkey", "l_returnflag", F.round("allocated", 2).alias("allocated"))


@query("""
SELECT s_nationkey, CASE WHEN l_quantity < 10 THEN 'LOW' WHEN l_quantity < 30 THEN 'MID' ELSE 'HIGH' END AS bucket, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS amount FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL
UNION ALL SELECT s_nationkey, 'ALL', CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL
""")
def bucket_all_rollup(spark, d):
    bucket = F.when(F.col("l_quantity") < 10, "LOW").when(F.col("l_quantity") < 30, "MID").otherwise("HIGH")
    line = t(spark, d, "lineitem").join(t(spark, d, "supplier"), F.col("s_suppkey") == F.col("l_suppkey")).select("s_nationkey", bucket.alias("bucket"), F.col("l_extendedprice").cast(CENTS).alias("amount"))
    return coverage.bucket_and_all(line, ["s_nationkey"], "bucket", ["amount"]).withColumn("amount", dollars(F.col("amount")))


@query("""
WITH x AS (SELECT o_custkey % 200 AS k, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey % 9 ELSE o_custkey % 11 END AS holder, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE 0 END AS old, CASE WHEN o_orderkey % 2 = 1 THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE 0 END AS nw FROM orders),
g AS (SELECT k, max(CASE WHEN old <> 0 THEN holder END) AS giver, max(CASE WHEN nw <> 0 THEN holder END) AS receiver, sum(old) AS given, sum(nw) AS received FROM x GROUP BY ALL)
SELECT k, giver, receiver, CAST(given AS DOUBLE) AS given, CAST(received AS DOUBLE) AS received FROM g WHERE giver IS DISTINCT FROM receiver
""")
def transfers(spark, d):
    return coverage.transfers(moved(spark, d), ["k"], "holder", "old", "nw").withColumns({c: dollars(F.col(c)) for c in ("given", "received")})


def moved(spark, d):
    amount, even = F.col("o_totalprice").cast(CENTS), F.col("o_orderkey") % 2 == 0
    zero = F.lit(0).cast(CENTS)
    return t(spark, d, "orders").select((F.col("o_custkey") % 200).alias("k"), F.when(even, F.col("o_custkey") % 9).otherwise(F.col("o_custkey") % 11).alias("holder"), F.when(even, amount).otherwise(zero).alias("old"), F.when(even, zero).otherwise(amount).alias("nw"))


@query("""
WITH x AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN o_custkey % 9 ELSE o_custkey % 11 END AS holder, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE 0 END AS old, CASE WHEN o_orderkey % 2 = 1 THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE 0 END AS nw FROM orders)
SELECT holder, CAST(sum(old) AS DOUBLE) AS before, CAST(sum(nw) AS DOUBLE) AS after, CAST(sum(nw) - sum(old) AS DOUBLE) AS delta FROM x GROUP BY ALL
""")
def books(spark, d):
    return coverage.books(moved(spark, d), "holder", "old", "nw").withColumns({c: dollars(F.col(c)) for c in ("before", "after", "delta")})


def similar(named, labelled):
    a = named.select(F.col("p_name").alias("name")).distinct()
    k = labelled.select(F.concat("p_name", F.lit(" "), F.lower("p_type")).alias("label")).distinct()
    s = a.join(k, review.near_lengths("name", "label", 85)).withColumn("sim", similarity("name", "label"))
    return rules.top_k(s, ["name"], [F.desc("sim"), "label"], 5).where("sim >= 85")


@query("""
WITH a AS (SELECT DISTINCT p_name AS name FROM part), k AS (SELECT DISTINCT p_name || ' ' || lower(p_type) AS label FROM part), s AS (SELECT name, label, CAST(round(jaro_winkler_similarity(upper(name), upper(label)) * 100) AS INTEGER) AS sim FROM a CROSS JOIN k),
r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY sim DESC, label) AS rn FROM s)
SELECT name, label, sim, CAST(rn AS INTEGER) AS rank FROM r WHERE sim >= 85 AND rn <= 5
""")
def fuzzy_candidates(spark, d):
    """All pairs of distinct names and labels of the whole part table."""
    p = t(spark, d, "part")
    return similar(p, p)
