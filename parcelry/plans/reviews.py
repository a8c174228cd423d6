"""Lists for review, whole builds and small reports on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from parcelry.operators import coverage, planning, review, score
from parcelry.operators.checks import all_of
from parcelry.plans.audits import LEDGER, the_ledger
from parcelry.plans.registry import query, t
from parcelry.plans.resolution import CENTS, _fact, dollars, facts_resolved, signed_lines
from parcelry.plans.scores import EDGES, edges, vertices

_review = f"""{_fact},
u AS (SELECT r.company, 'Brand#' || r.company AS name, r.label, r.place, o.o_custkey % 50 AS seller, CAST(o.o_totalprice AS DECIMAL(18,2)) AS amount FROM r JOIN orders o USING (o_orderkey) WHERE r.resolved IS NULL AND r.company IS NOT NULL),
g AS (SELECT company, name, label, sum(amount) AS key_amount, count(*) AS n_rows, count(DISTINCT seller) AS n_sellers FROM u GROUP BY ALL),
tp AS (SELECT company, name, label, seller AS top_seller FROM (SELECT *, row_number() OVER (PARTITION BY company, name, label ORDER BY a DESC, seller) AS n FROM (SELECT company, name, label, seller, sum(amount) AS a FROM u GROUP BY company, name, label, seller)) WHERE n = 1),
routes AS (SELECT DISTINCT entity, route FROM cand), mp AS (SELECT DISTINCT l_suppkey % 30 AS company, p_brand AS entity FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity = 1 AND l_discount = 0),
nm0 AS (SELECT DISTINCT g.name, e.entity, CAST(round(jaro_winkler_similarity(upper(g.name), upper(e.entity)) * 100) AS INTEGER) AS sim FROM g CROSS JOIN (SELECT DISTINCT entity FROM routes) e),
nm AS (SELECT name, entity FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY sim DESC, entity) AS n FROM nm0) WHERE n <= 5 AND sim >= 85),
off AS (SELECT g.company, g.name, g.label, c.entity, 'C' AS ev FROM g JOIN (SELECT DISTINCT company, entity FROM cand) c USING (company) UNION ALL SELECT g.company, g.name, g.label, mp.entity, 'M' FROM g JOIN mp USING (company) UNION ALL SELECT g.company, g.name, g.label, nm.entity, 'N' FROM g JOIN nm USING (name)),
c1 AS (SELECT company, name, label, entity, max(CASE WHEN ev = 'C' THEN 1 ELSE 0 END) AS ev_company, max(CASE WHEN ev = 'M' THEN 1 ELSE 0 END) AS ev_map FROM off GROUP BY ALL),
ov AS (SELECT c1.company, c1.name, c1.label, c1.entity, CAST(sum(u.amount) AS DOUBLE) AS place_amount FROM c1 JOIN u USING (company, name, label) JOIN (SELECT DISTINCT place, entity FROM cell) z ON z.place = u.place AND z.entity = c1.entity GROUP BY ALL),
x AS (SELECT g.*, tp.top_seller, c1.entity, routes.route, c1.ev_company, c1.ev_map, CASE WHEN c1.entity IS NOT NULL THEN CASE WHEN routes.route = g.label THEN 1 ELSE 0 END END AS ev_label,
  CASE WHEN c1.entity IS NOT NULL THEN CAST(round(jaro_winkler_similarity(upper(g.name), upper(c1.entity)) * 100) AS INTEGER) / 100.0 END AS ev_name, CASE WHEN c1.entity IS NOT NULL THEN coalesce(ov.place_amount, 0) END AS place_amount
  FROM g JOIN tp USING (company, name, label) LEFT JOIN c1 USING (company, name, label) LEFT JOIN routes ON routes.entity = c1.entity LEFT JOIN ov ON ov.company = g.company AND ov.name = g.name AND ov.label = g.label AND ov.entity = c1.entity),
y AS (SELECT *, round(ev_company + ev_map + ev_label + ev_name + coalesce(round(place_amount / CAST(key_amount AS DOUBLE), 2), 0), 4) AS score FROM x),
rv AS (SELECT company, name, label, top_seller, n_sellers, n_rows, CAST(key_amount AS DOUBLE) AS key_amount, CAST(dense_rank() OVER (PARTITION BY label ORDER BY key_amount DESC) AS INTEGER) AS rank_key, count(entity) OVER (PARTITION BY company, name, label) AS n_candidates,
  CAST(row_number() OVER (PARTITION BY company, name, label ORDER BY score DESC NULLS LAST, place_amount DESC NULLS LAST, entity) AS INTEGER) AS rank_in_key, entity, route, ev_company, ev_map, ev_label, CAST(ev_name AS DOUBLE) AS ev_name, place_amount, CAST(score AS DOUBLE) AS score FROM y)"""


def reviewed(spark, d):
    o, p = t(spark, d, "orders"), t(spark, d, "part")
    line = t(spark, d, "lineitem").join(p, F.col("p_partkey") == F.col("l_partkey"))
    company = F.col("l_suppkey") % 30
    route = F.when(F.length("p_brand") == 7, "AUTOMOBILE").when(F.col("p_brand") < "Brand#2", "BUILDING").otherwise("MACHINERY")
    cand = line.where((F.col("l_quantity") > 49) & (company < 25)).select(company.alias("company"), F.col("p_brand").alias("entity"), route.alias("route")).distinct()
    mp = line.where("l_quantity = 1 AND l_discount = 0").select(company.alias("company"), F.col("p_brand").alias("entity")).distinct()
    oc = o.join(t(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    cell = line.where("l_linenumber = 1").join(oc, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("c_nationkey").alias("place"), F.col("p_brand").alias("entity")).distinct()
    u = facts_resolved(spark, d).where("resolved IS NULL AND company IS NOT NULL").join(o, "o_orderkey")
    u = u.select("company", F.concat(F.lit("Brand#"), F.col("company").cast("string")).alias("name"), "label", "place", (F.col("o_custkey") % 50).alias("seller"), F.col("o_totalprice").cast(CENTS).alias("amount"))
    return review.review_list(u, ["company", "name", "label"], name="name", label="label", amount="amount", seller="seller", entity="entity", routes=cand.select("entity", "route").distinct(), evidence={"COMPANY": (cand, ["company"]), "MAP": (mp, ["company"])}, cells=cell, place=["place"])


@query(f"WITH {_review} SELECT * FROM rv")
def review_list(spark, d):
    return reviewed(spark, d).withColumn("key_amount", dollars(F.col("key_amount")))


@query(f"""
WITH {_review}, e AS (SELECT CASE WHEN n_candidates = 0 THEN 'NO CANDIDATE' ELSE coalesce(nullif(concat_ws(' + ', CASE WHEN ev_company > 0 THEN 'COMPANY' END, CASE WHEN ev_map > 0 THEN 'MAP' END, CASE WHEN ev_label > 0 THEN 'LABEL' END), ''), 'NAME ONLY') END AS evidence, CAST(key_amount AS DECIMAL(18,2)) AS a FROM rv WHERE rank_in_key = 1)
SELECT evidence, groups, CAST(s AS DOUBLE) AS amount, CAST(round(100.0 * CAST(s AS DOUBLE) / CAST(sum(s) OVER () AS DOUBLE), 2) AS DOUBLE) AS pct FROM (SELECT evidence, count(*) AS groups, sum(a) AS s FROM e GROUP BY evidence)
""")
def review_summary(spark, d):
    s = review.review_summary(reviewed(spark, d), ["ev_company", "ev_map", "ev_label"])
    return s.withColumn("amount", dollars(F.col("amount")))


_base = """
base AS (SELECT l_orderkey, l_suppkey, l_linenumber % 3 AS product, CASE WHEN l_suppkey % 6 = 0 THEN 'M' ELSE NULL END AS rider, l_returnflag, CAST(l_extendedprice AS DECIMAL(18,2)) * CASE WHEN l_orderkey % 50 = 0 THEN 0 WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS amount
  FROM lineitem WHERE CAST(l_shipdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' AND l_linestatus = 'O'),
lab AS (SELECT l_orderkey, product, CASE WHEN count(DISTINCT rider) > 0 AND bool_or(l_returnflag = 'A') THEN 'DUAL' WHEN count(DISTINCT rider) > 0 THEN 'RIDER' ELSE 'PLAIN' END AS label FROM base GROUP BY ALL),
keep AS (SELECT l_orderkey FROM base GROUP BY ALL HAVING sum(amount) <> 0),
f AS (SELECT b.l_suppkey % 10 AS grp, CASE b.product WHEN 0 THEN 'P0' WHEN 1 THEN 'P1' ELSE 'P2' END AS bucket, lab.label, b.amount FROM base b JOIN lab USING (l_orderkey, product) WHERE b.l_orderkey IN (SELECT l_orderkey FROM keep))"""


@query(f"""
WITH {_base} SELECT grp, label, bucket, CAST(sum(amount) AS DOUBLE) AS amount FROM f GROUP BY ALL UNION ALL SELECT grp, label, 'ALL', CAST(sum(amount) AS DOUBLE) FROM f GROUP BY ALL
""")
def base_fact_build(spark, d):
    """The base build in one chain: period and status filter, a label by what a ticket's lines hold, net-zero tickets out, buckets and all."""
    line = t(spark, d, "lineitem").where(F.to_date("l_shipdate").between("1996-01-01", "1999-12-31") & (F.col("l_linestatus") == "O"))
    sign = F.when(F.col("l_orderkey") % 50 == 0, 0).when(F.col("l_returnflag") == "R", -1).otherwise(1)
    base = line.select("l_orderkey", "l_suppkey", (F.col("l_linenumber") % 3).alias("product"), F.when(F.col("l_suppkey") % 6 == 0, "M").alias("rider"), "l_returnflag", (F.col("l_extendedprice").cast(CENTS) * sign).alias("amount"))
    riders = F.countDistinct("rider") > 0
    lab = base.groupBy("l_orderkey", "product").agg(F.when(riders & F.bool_or(F.col("l_returnflag") == "A"), "DUAL").when(riders, "RIDER").otherwise("PLAIN").alias("label"))
    kept = coverage.not_net_zero(base, ["l_orderkey"], "amount").join(lab, ["l_orderkey", "product"])
    f = kept.select((F.col("l_suppkey") % 10).alias("grp"), F.concat(F.lit("P"), F.col("product").cast("string")).alias("bucket"), "label", "amount")
    return coverage.bucket_and_all(f, ["grp", "label"], "bucket", ["amount"]).select("grp", "label", "bucket", dollars(F.col("amount")).alias("amount"))


@query("""
WITH b AS (SELECT l_returnflag, l_linestatus, CASE WHEN l_suppkey % 50 = 0 THEN 'BLANK LABEL' WHEN l_returnflag = 'R' AND l_discount > 0.05 THEN 'RETURN, DISCOUNT' WHEN l_returnflag = 'R' THEN 'RETURN' WHEN l_tax = 0 THEN 'TAX FREE' ELSE 'OTHER' END AS row_type, CAST(l_extendedprice AS DECIMAL(18,2)) AS a FROM lineitem),
g AS (SELECT row_type, l_linestatus, count(*) AS n, CAST(sum(a) AS DOUBLE) AS amount FROM b GROUP BY ALL)
SELECT *, CAST(round(100.0 * n / sum(n) OVER (PARTITION BY l_linestatus), 2) AS DOUBLE) AS pct FROM g
""")
def label_path_audit(spark, d):
    from pyspark.sql import Window

    from parcelry.functions.norm import first_match

    r = F.col("l_returnflag") == "R"
    kind = first_match([(F.col("l_suppkey") % 50 == 0, "BLANK LABEL"), (r & (F.col("l_discount") > 0.05), "RETURN, DISCOUNT"), (r, "RETURN"), (F.col("l_tax") == 0, "TAX FREE")], "OTHER")
    g = t(spark, d, "lineitem").withColumn("row_type", kind).groupBy("row_type", "l_linestatus").agg(F.count("*").alias("n"), F.sum(F.col("l_extendedprice").cast(CENTS)).alias("a"))
    pct = F.round(F.lit(100.0).cast("double") * F.col("n") / F.sum("n").over(Window.partitionBy("l_linestatus")), 2)
    return g.select("row_type", "l_linestatus", "n", dollars(F.col("a")).alias("amount"), pct.alias("pct"))


@query(f"""
WITH {LEDGER}, p AS (SELECT unit AS state, count(DISTINCT CASE WHEN channel = 'BUILDING' THEN district END) AS building, count(DISTINCT CASE WHEN channel = 'MACHINERY' THEN district END) AS machinery FROM ledger GROUP BY ALL) SELECT state, building, machinery, building > 1 OR machinery > 1 AS split FROM p
""")
def state_territories(spark, d):
    g = the_ledger(spark, d).groupBy(F.col("unit").alias("state"))
    n = lambda c: F.countDistinct(F.when(F.col("channel") == c, F.col("district")))
    return g.agg(n("BUILDING").alias("building"), n("MACHINERY").alias("machinery")).withColumn("split", (F.col("building") > 1) | (F.col("machinery") > 1))


@query("""
WITH m AS (SELECT 'City' || c_nationkey || '-Town' || c_nationkey % 3 || ', S' || c_nationkey % 5 AS title, c_mktsegment AS channel, CAST(c_acctbal AS DECIMAL(18,2)) AS w FROM customer),
g AS (SELECT channel, title, sum(w) AS w FROM m GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY w DESC, title) AS n FROM g)
SELECT channel, split_part(split_part(title, ',', 1), '-', 1) AS city, CAST(w AS DOUBLE) AS weight, CAST(n AS INTEGER) AS rank FROM r WHERE n <= 4
""")
def top_metros(spark, d):
    from parcelry.operators.rules import top_k

    k = F.col("c_nationkey")
    title = F.concat(F.lit("City"), k.cast("string"), F.lit("-Town"), (k % 3).cast("string"), F.lit(", S"), (k % 5).cast("string"))
    g = t(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("channel"), title.alias("title")).agg(F.sum(F.col("c_acctbal").cast(CENTS)).alias("w"))
    return top_k(g, ["channel"], [F.desc("w"), "title"], 4).select("channel", score.name_parts("title").alias("city"), dollars(F.col("w")).alias("weight"), "rank")


@query("""
WITH RECURSIVE sh AS (SELECT DISTINCT c_nationkey AS unit, c_nationkey % 5 + 5 * (c_custkey % 12) AS district FROM customer),
e AS (SELECT DISTINCT x.district AS a, y.district AS b FROM sh x JOIN sh y USING (unit)), r(d, root) AS (SELECT DISTINCT district, district FROM sh UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.d AND r.root <= e.b)
SELECT d AS district, min(root) AS component FROM r GROUP BY ALL
""")
def exchange_components(spark, d):
    """Over all customers. Nations of one remainder share districts, so that the whole table has several components."""
    unit = F.col("c_nationkey")
    return planning.exchange_components(t(spark, d, "customer").select(unit.alias("unit"), (unit % 5 + 5 * (F.col("c_custkey") % 12)).alias("district"), F.lit(1.0).alias("share")))


_sup = "sup AS (SELECT DISTINCT s_suppkey % 15 AS support, s_nationkey AS unit FROM supplier)"


@query(f"""
WITH {_sup}, top AS (SELECT c_nationkey AS unit, max(c_acctbal) AS top FROM customer GROUP BY ALL), ctr AS (SELECT n_nationkey AS unit, CAST(n_nationkey AS DOUBLE) AS x, CAST(n_nationkey * n_nationkey % 11 AS DOUBLE) AS y FROM nation),
m AS (SELECT support, round(sum(top), 6) AS margin FROM sup JOIN top USING (unit) GROUP BY ALL), w AS (SELECT a.support, round(max(sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2)), 9) AS diameter FROM sup a JOIN sup b USING (support) JOIN ctr p ON p.unit = a.unit JOIN ctr q ON q.unit = b.unit GROUP BY ALL)
SELECT support, margin, diameter FROM m JOIN w USING (support)
""")
def support_measures(spark, d):
    sup = t(spark, d, "supplier").select((F.col("s_suppkey") % 15).alias("support"), F.col("s_nationkey").alias("unit")).distinct()
    places = t(spark, d, "customer").select(F.col("c_nationkey").alias("unit"), F.col("c_acctbal").alias("mass"))
    k = F.col("n_nationkey")
    ctr = t(spark, d, "nation").select(k.alias("unit"), k.cast("double").alias("x"), (k * k % 11).cast("double").alias("y"))
    return planning.margins(sup, places).join(planning.diameters(sup, ctr), "support").select("support", F.round("margin", 6).alias("margin"), F.round("diameter", 9).alias("diameter"))


def not_once(led, zips, fines):
    want = zips.select("zip").distinct().crossJoin(F.broadcast(fines.select("fine").distinct()))
    have = led.groupBy("zip", "fine").agg(F.count("*").alias("n"))
    out = want.join(have, ["zip", "fine"], "left").where(F.coalesce("n", F.lit(0)) != 1)
    return out.select("zip", "fine", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.when(F.col("n").isNull(), "missing").otherwise("repeated").alias("what"))


@query(f"""
WITH {LEDGER}, want AS (SELECT z.zip, f.fine FROM (SELECT DISTINCT zip FROM ledger) z CROSS JOIN (SELECT DISTINCT fine FROM ledger) f), have AS (SELECT zip, fine, count(*) AS n FROM ledger GROUP BY ALL)
SELECT w.zip, w.fine, coalesce(h.n, 0) AS n, CASE WHEN h.n IS NULL THEN 'missing' ELSE 'repeated' END AS what FROM want w LEFT JOIN have h ON h.zip = w.zip AND h.fine = w.fine WHERE coalesce(h.n, 0) <> 1
""")
def exactly_once(spark, d):
    """Of every vertex and every fine channel of the ledger, what isn't there exactly once."""
    led = the_ledger(spark, d)
    return not_once(led, led, led)


@query("""
WITH b AS (SELECT l_orderkey, CAST(l_extendedprice AS DECIMAL(18,2)) * CASE WHEN l_orderkey % 50 = 0 THEN 0 WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS a FROM lineitem), k AS (SELECT l_orderkey, sum(a) AS s FROM b GROUP BY ALL)
SELECT 'CHECK' AS layer, 'net-zero tickets dropped' AS part, count(*) AS n, CAST(0 AS DOUBLE) AS amount FROM k WHERE s = 0
UNION ALL SELECT 'CHECK', 'kept and dropped make the whole', 0, CAST((SELECT sum(a) FROM b) - (SELECT sum(s) FROM k WHERE s <> 0) AS DOUBLE) UNION ALL SELECT 'DATA', 'tickets kept', count(*), CAST(sum(s) AS DOUBLE) FROM k WHERE s <> 0
""")
def one_result_set(spark, d):
    """Layers of a run as one table: data and the checks that must be zero."""
    b = signed_lines(spark, d)
    k = b.groupBy("l_orderkey").agg(F.sum("amount").alias("s"))
    whole = b.agg(F.sum("amount").alias("w")).crossJoin(k.where("s <> 0").agg(F.sum("s").alias("s")))
    return all_of(
        [
            k.where("s = 0").agg(F.lit("CHECK").alias("layer"), F.lit("net-zero tickets dropped").alias("part"), F.count("*").alias("n"), F.lit(0.0).alias("amount")),
            whole.select(F.lit("CHECK").alias("layer"), F.lit("kept and dropped make the whole").alias("part"), F.lit(0).cast("long").alias("n"), dollars(F.col("w") - F.col("s")).alias("amount")),
            k.where("s <> 0").agg(F.lit("DATA").alias("layer"), F.lit("tickets kept").alias("part"), F.count("*").alias("n"), dollars(F.sum("s")).alias("amount")),
        ]
    )
