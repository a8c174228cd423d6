"""Readers and writers on the driver's tables: each writes a format to the shared folder and reads it back."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from parcelry.functions import norm
from parcelry.functions.text import folded
from parcelry.operators import checks, export, ledger, profile, rules, score
from parcelry.operators.graph import scratch
from parcelry.plans.audits import LEDGER, the_ledger
from parcelry.plans.registry import query, t
from parcelry.plans.resolution import CENTS
from parcelry.sources import readers, writers


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def table_by_name(spark, d):
    t(spark, d, "nation").createOrReplaceTempView("parcelry_named")
    return readers.table(spark, "parcelry_named").select("n_nationkey", "n_name", "n_regionkey")


@query("SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name || ', Ltd' AS name, CAST(s_nationkey AS VARCHAR) AS nation, CAST(NULL AS VARCHAR) AS rep FROM supplier")
def delimited_aliases(spark, d):
    """A semicolon file with commas in its text, a byte order mark and headers of other spellings."""
    s = t(spark, d, "supplier")
    path = scratch(spark, "delimited")
    lines = s.select(F.concat_ws(";", "s_suppkey", F.concat("s_name", F.lit(", Ltd")), "s_nationkey").alias("line"))
    writers.text_file(path, "﻿Supp_Key;Supplier Name;NATION\n" + "".join(f"{r.line}\n" for r in lines.toLocalIterator()))
    return readers.picked(readers.delimited(spark, path), {"id": ["supp key"], "name": ["supplier name"], "nation": [], "rep": []}, optional=("rep",))


@query("""
SELECT lpad(CAST(s_suppkey AS VARCHAR), 5, '0') AS z, 'N' || CAST(s_nationkey AS VARCHAR) AS channel, abs(s_acctbal) AS m_rel, CAST(CASE WHEN s_suppkey % 3 = 0 THEN 0.25 ELSE 0.5 END AS DOUBLE) AS share_r, CAST(CASE WHEN s_suppkey % 3 = 0 THEN 0.75 ELSE 0.5 END AS DOUBLE) AS share_free FROM supplier
""")
def columnar_extract(spark, d):
    s = t(spark, d, "supplier")
    part = F.when(F.col("s_suppkey") % 3 == 0, 0.25).otherwise(0.5)
    cells = s.select(F.lpad(F.col("s_suppkey").cast("string"), 5, "0").alias("z"), F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("channel"), F.abs("s_acctbal").alias("m_rel"), F.create_map(F.lit("r"), part).alias("share"), (1 - part).alias("share_free"))
    rows = cells.orderBy("z").collect()
    path = scratch(spark, "extract") + ".json.gz"
    columns = {c: [r[c] for r in rows] for c in cells.columns}
    writers.gzipped(path, json.dumps({"format": "cells/1", **columns}))
    got = readers.extract(spark, path, "cells/1")
    return got.select("z", "channel", "m_rel", F.col("share")["r"].alias("share_r"), "share_free")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS nation, n_name AS name, CASE WHEN n_regionkey = 2 THEN '' ELSE CAST(n_regionkey AS VARCHAR) END AS region FROM nation")
def reference_dimension(spark, d):
    n = t(spark, d, "nation")
    path = scratch(spark, "reference") + ".csv.gz"
    rows = n.select(F.col("n_nationkey").alias("nation"), F.col("n_name").alias("name"), F.when(F.col("n_regionkey") != 2, F.col("n_regionkey").cast("string")).alias("region"))
    writers.csv_gz(rows, path, ["nation"])
    return readers.reference(spark, path, ["nation", "name", "region"])


@query("""
SELECT CAST(s_suppkey AS VARCHAR) AS a, CAST(s_nationkey AS VARCHAR) AS b, CASE s_suppkey % 3 WHEN 0 THEN 'proposed' WHEN 1 THEN 'approved' ELSE 'rejected' END AS status, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE s_acctbal END AS gap_km FROM supplier
""")
def connector_list(spark, d):
    s = t(spark, d, "supplier")
    m = F.col("s_suppkey") % 3
    status = F.when(m == 0, "proposed").when(m == 1, "approved").otherwise("rejected")
    gap = F.when(F.col("s_suppkey") % 7 == 0, "unknown").otherwise(F.col("s_acctbal").cast("string"))
    path = scratch(spark, "connectors")
    rows = s.select(F.col("s_suppkey").alias("a"), F.col("s_nationkey").alias("b"), F.lit("road").alias("kind"), F.lit("x").alias("crossing"), gap.alias("gap_km"), status.alias("status"), F.lit("s").alias("source"))
    rows.write.option("header", True).csv(path)
    return readers.connectors(spark, path).select("a", "b", "status", "gap_km")


_NEAR = "pairs AS (SELECT x.n_nationkey AS a, y.n_nationkey AS b FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey)"


@query(f"WITH {_NEAR}, k AS (SELECT n_nationkey AS id FROM nation WHERE n_regionkey <> 0) SELECT CAST(a AS VARCHAR) AS a, CAST(b AS VARCHAR) AS b FROM pairs WHERE a <> b AND a IN (SELECT id FROM k) AND b IN (SELECT id FROM k)")
def adjacency_list(spark, d):
    """Loops and neighbours outside the set (here: of one region) are in the file, and not in the result."""
    n = t(spark, d, "nation")
    x, y = n.select(F.col("n_nationkey").alias("a"), "n_regionkey"), n.select(F.col("n_nationkey").alias("b"), "n_regionkey")
    path = scratch(spark, "adjacency")
    x.join(y, "n_regionkey").select("a", "b", F.lit("Peñón").alias("name")).write.option("header", True).option("sep", "|").option("encoding", "ISO-8859-1").csv(path)
    keys = n.where("n_regionkey <> 0").select(F.col("n_nationkey").cast("string").alias("id"))
    return readers.adjacency(spark, path, keys)


@query("""
WITH c AS (SELECT r_regionkey, r_name AS channel, count(*) AS k FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY ALL)
SELECT channel, CAST(k AS INTEGER) AS k, CASE r_regionkey % 3 WHEN 0 THEN 'whole' WHEN 1 THEN 'clipped' ELSE 'split' END AS mode, n_name AS unit FROM c JOIN nation ON n_regionkey <> 0 AND (r_regionkey = 0 OR n_regionkey <> r_regionkey)
""")
def scenario_domains(spark, d):
    """A scenario in TOML, with set expressions as domains: all nations but those of the first region and of the channel's own."""
    rows = t(spark, d, "region").join(t(spark, d, "nation"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_regionkey", "r_name").agg(F.sort_array(F.collect_list("n_name")).alias("names")).orderBy("r_regionkey").collect()
    first = rows[0].r_name
    text = ['[scenario]\nname = "all"\ndelta = 0.1\n[sets]']
    text += [f'"{r.r_name}" = {json.dumps(r.names)}' for r in rows] + [f"EVERY = {json.dumps([n for r in rows for n in r.names])}"]
    for r in rows:
        spare = f"EVERY - {first}" + ("" if r.r_name == first else f" - {r.r_name}")
        text.append(f'[channels."{r.r_name}"]\nk = {len(r.names)}\nmode = "{readers.MODES[r.r_regionkey % 3]}"\ndomain = "{spare.replace("MIDDLE EAST", "MIDEAST")}"')
    s = readers.scenario("\n".join(text).replace('"MIDDLE EAST" = [', 'MIDEAST = ['))
    return readers.channel_rows(spark, s).join(readers.domain_units(spark, s), "channel").select("channel", "k", "mode", "unit")


@query(f"""
WITH {LEDGER} SELECT 'all' AS scenario, lpad(CAST(zip AS VARCHAR), 5, '0') AS zip_code, channel AS model_channel, CASE WHEN zip % 50 = 0 THEN NULL ELSE district END AS district, rep, m_rel FROM ledger
""")
def ledger_round_trip(spark, d):
    led = the_ledger(spark, d)
    own = F.when(F.col("zip") % 50 != 0, F.col("district"))
    rows = led.select(F.lit("all").alias("scenario"), F.lpad(F.col("zip").cast("string"), 5, "0").alias("zip_code"), F.col("channel").alias("model_channel"), own.alias("district"), "rep", "m_rel")
    path = scratch(spark, "ledger")
    writers.ledger(rows, path)
    back = readers.ledger(spark, path)
    if back.columns != readers.LEDGER:
        raise checks.Violation(f"another header: {back.columns}")
    return back.select("scenario", "zip_code", "model_channel", "district", "rep", "m_rel")


@query(f"WITH {LEDGER} SELECT channel, district, CAST(sum(CAST(m_rel AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS drawn_mass, count(DISTINCT zip) AS zips FROM ledger GROUP BY ALL")
def districts_file(spark, d):
    led = the_ledger(spark, d).withColumn("m_rel", F.col("m_rel").cast(CENTS))
    path = scratch(spark, "districts")
    out = ledger.districts(led)
    out.write.option("header", True).csv(path)
    back = spark.read.schema(out.schema).option("header", True).csv(path)
    return back.withColumn("drawn_mass", F.col("drawn_mass").cast("decimal(28,2)"))


def _folders(spark, d):
    root = scratch(spark, "runs")
    for r in t(spark, d, "nation").orderBy("n_nationkey").toLocalIterator():
        run = {"run_id": f"id{r.n_nationkey}", "status": "done", ("parent" if r.n_nationkey % 2 else "parent_run"): r.n_name}
        writers.text_file(f"{root}/n{r.n_nationkey}/manifest.json", json.dumps(run))
        writers.text_file(f"{root}/n{r.n_nationkey}/score.txt", f"splits: {r.n_regionkey}\n" + ("" if r.n_nationkey % 5 else f"worst {r.n_nationkey / 8}\n") + f"rows {r.n_nationkey:06d} of it\n")
    return root


@query("SELECT 'id' || CAST(n_nationkey AS VARCHAR) AS run_id, 'n' || CAST(n_nationkey AS VARCHAR) AS folder, n_name AS parent_run FROM nation")
def run_folders(spark, d):
    return score.index_rows(readers.manifests(spark, _folders(spark, d))).select("run_id", "folder", "parent_run")


@query("SELECT CAST(n_regionkey AS VARCHAR) AS splits, CASE WHEN n_nationkey % 5 = 0 THEN CAST(n_nationkey / 8 AS DOUBLE) END AS worst, lpad(CAST(n_nationkey AS VARCHAR), 6, '0') AS items FROM nation")
def text_reports(spark, d):
    got = readers.report_fields(spark, f"{_folders(spark, d)}/*/score.txt", {"splits": r"splits: (\d+)", "worst": r"worst ([0-9.]+)", "items": r"rows (\d+) of"})
    return got.select("splits", F.col("worst").cast("double").alias("worst"), "items")


@query("SELECT 40 AS rows, 40 AS keys, 0 AS unweighted, TRUE AS again, TRUE AS centred")
def seeded_fixture(spark, d):
    """What must hold of a seeded sample by weight and of its masses: its size, no key twice, no row without weight, the same rows from any partitioning, a median of 1."""
    c = t(spark, d, "customer").withColumn("w", F.greatest("c_acctbal", F.lit(0.0)))
    a, b = (readers.sampled(x, 40, "w", 11, "c_custkey") for x in (c, c.repartition(5)))
    m = readers.synthetic_masses(a, "c_custkey", 11)
    out = a.agg(F.count("*").cast("int").alias("rows"), F.countDistinct("c_custkey").cast("int").alias("keys"), F.count_if(F.col("w") <= 0).cast("int").alias("unweighted"))
    again = a.select("c_custkey").exceptAll(b.select("c_custkey")).agg((F.count("*") == 0).alias("again"))
    centred = m.agg((F.abs(F.percentile("m_rel", F.lit(0.5)) - 1) < 1e-12).alias("centred"))
    return out.crossJoin(again).crossJoin(centred)


@query("SELECT o_custkey, count(*) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS total FROM orders GROUP BY ALL HAVING count(*) > 1")
def materialised_table(spark, d):
    from parcelry.operators.graph import kept

    o = kept(t(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("orders"), F.sum(F.col("o_totalprice").cast(CENTS)).cast("decimal(28,2)").alias("total")))
    return o.where("orders > 1")


@query("SELECT CAST(s_suppkey AS VARCHAR) AS supplier, CAST(s_nationkey AS BIGINT) AS nation, CAST(s_acctbal AS DECIMAL(18,2)) AS amount FROM supplier")
def conformed_table(spark, d):
    target = spark.createDataFrame([], "supplier string, nation bigint, amount decimal(18,2)")
    path = scratch(spark, "conformed")
    rows = writers.conformed(t(spark, d, "supplier"), target, {"s_suppkey": "supplier", "s_nationkey": "nation", "s_acctbal": "amount"})
    writers.keyed_parquet(rows, path, ["supplier"], ["nation"])
    return spark.read.schema(target.schema).parquet(path)


@query("SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name, TRUE AS same_bytes FROM supplier")
def byte_stable_csv(spark, d):
    s = t(spark, d, "supplier").select("s_suppkey", "s_name")
    paths = [scratch(spark, "stable") + ".csv.gz" for _ in range(2)]
    for i, path in enumerate(paths):
        writers.csv_gz(s.repartition(i + 2), path, ["s_suppkey"])
    sums = spark.read.format("binaryFile").load(paths).agg((F.countDistinct(F.sha2("content", 256)) == 1).alias("same_bytes"))
    return readers.reference(spark, paths[0], ["s_suppkey", "s_name"]).crossJoin(F.broadcast(sums))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def json_lines_index(spark, d):
    n = t(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    path = scratch(spark, "index") + ".jsonl"
    for _ in range(2):  # the second takes the place of the first
        writers.json_lines(n, path, ["n_nationkey"])
    return spark.read.schema(n.schema).json(path)


@query("""
SELECT 1 AS line, 'CREATE TABLE nations (' AS text UNION ALL SELECT 2, '  id INTEGER NOT NULL,' UNION ALL SELECT 3, '  name VARCHAR,' UNION ALL SELECT 4, '  balance DOUBLE,' UNION ALL SELECT 5, '  PRIMARY KEY (id)' UNION ALL SELECT 6, ');'
""")
def load_script(spark, d):
    n = t(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("id"), F.col("n_name").alias("name"), F.lit(0.0).alias("balance"))
    lines = writers.load_script(n, "nations", ["id"]).splitlines()
    return spark.createDataFrame(list(enumerate(lines, 1)), "line int, text string")


@query("""
WITH n AS (SELECT r_regionkey, r_name, count(*) AS n, row_number() OVER (ORDER BY r_regionkey) AS i FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name)
SELECT 1 AS line, '| region | name | nations |' AS text UNION ALL SELECT 2, '|---|---|---|' UNION ALL SELECT CAST(i + 2 AS INTEGER), '| ' || r_regionkey || ' | ' || r_name || ' | ' || n || ' |' FROM n
""")
def markdown_table(spark, d):
    n = t(spark, d, "region").join(t(spark, d, "nation"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.col("r_regionkey").alias("region"), F.col("r_name").alias("name")).agg(F.count("*").alias("nations"))
    return spark.createDataFrame(list(enumerate(writers.markdown(n, ["region"]).splitlines(), 1)), "line int, text string")


@query("SELECT unnest(['relative', 'absolute', 'sentinel', 'column']) AS payload, unnest([TRUE, FALSE, FALSE, FALSE]) AS leaves")
def egress_guard(spark, d):
    """Which payloads may leave: masses over their median; not absolute ones, not a name in another spelling, not a divisor."""
    c = t(spark, d, "customer").where("c_acctbal > 0")
    fine = export.descaled(c.select("c_mktsegment", "c_acctbal"), "c_acctbal").select("c_mktsegment", "m_rel")
    payloads = {
        "relative": fine,
        "absolute": c.select("c_mktsegment", F.col("c_acctbal").alias("m_rel")),
        "sentinel": fine.withColumn("c_mktsegment", F.when(F.col("c_mktsegment") == "BUILDING", "Ｂuilding").otherwise("x")),
        "column": fine.withColumn("Divisor", F.lit(2.0)),
    }
    rows = []
    for name, df in payloads.items():
        try:
            export.guard(df, "m_rel", ["c_mktsegment"], ["building"] if name == "sentinel" else ["nobody"])
            rows.append((name, True))
        except checks.Violation:
            rows.append((name, False))
    return spark.createDataFrame(rows, "payload string, leaves boolean")


# ---- scalars and filters

@query("""
SELECT s_suppkey, s_suppkey % 4 < 2 AS finite, lower(s_name) AS folded, round(sqrt(power(s_suppkey - 3, 2) + power(s_nationkey - 4, 2)), 9) AS distance, power(s_suppkey - 3, 2) + power(s_nationkey - 4, 2) AS squared,
  array_to_string(list_sort(list_filter(list_distinct([s_nationkey, s_suppkey % 5, 1]), lambda x: x <> 1 AND x <> s_nationkey % 5)), ',') AS members FROM supplier
""")
def scalar_extras(spark, d):
    s = t(spark, d, "supplier")
    key, nation = F.col("s_suppkey").cast("double"), F.col("s_nationkey").cast("double")
    m = F.col("s_suppkey") % 4
    value = F.when(m < 2, key).when(m == 2, F.lit(float("nan"))).otherwise(F.lit(float("-inf")))
    sets = {"a": F.array("s_nationkey", F.col("s_suppkey") % 5, F.lit(1).cast("long")), "b": F.array(F.lit(1).cast("long")), "c": F.array((F.col("s_nationkey") % 5).cast("long"))}
    sets = {k: F.transform(v, lambda x: x.cast("long")) for k, v in sets.items()}
    wide = F.concat(F.lit("ﬁ"), F.col("s_name"))  # a ligature, which the folding takes apart
    return s.select("s_suppkey", norm.finite(value).alias("finite"), F.substring(folded(wide), 3, 1000).alias("folded"), F.round(norm.distance(key, nation, F.lit(3.0), F.lit(4.0)), 9).alias("distance"), norm.squared_distance(key, nation, F.lit(3.0), F.lit(4.0)).alias("squared"), F.array_join(norm.set_expression("a - b - c", sets), ",").alias("members"))


@query("""
WITH x AS (SELECT CASE WHEN n_nationkey % 4 = 0 THEN ' ' || lower(n_name) || ' ' ELSE n_name END AS name FROM nation UNION ALL SELECT n_name || CASE WHEN n_regionkey = 1 THEN '' ELSE '2' END FROM nation),
k AS (SELECT lower(trim(name)) AS item FROM x GROUP BY 1 HAVING count(*) > 1)
SELECT 'file names' AS "check", CASE WHEN count(*) = 0 THEN 'pass' ELSE 'fail' END AS status, CAST(count(*) AS VARCHAR) || ' names that fall together' AS summary, coalesce(string_agg(item, ';' ORDER BY item), '') AS items FROM k
""")
def file_name_collisions(spark, d):
    n = t(spark, d, "nation")
    a = n.select(F.when(F.col("n_nationkey") % 4 == 0, F.concat(F.lit(" "), F.lower("n_name"), F.lit(" "))).otherwise(F.col("n_name")).alias("name"))
    b = n.select(F.concat("n_name", F.when(F.col("n_regionkey") == 1, "").otherwise("2")).alias("name"))
    return checks.file_names_check(a.unionByName(b), "name").select("check", "status", "summary", F.array_join("items", ";").alias("items"))


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def strict_scope(spark, d):
    """Segments are either in scope or known to be planned elsewhere; any other would raise."""
    c = t(spark, d, "customer")
    return checks.in_scope(c, "c_mktsegment", ["BUILDING", "MACHINERY"], ["AUTOMOBILE", "FURNITURE", "HOUSEHOLD"]).select("c_custkey", "c_mktsegment")


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) OR s_acctbal > 9000")
def in_or_predicate(spark, d):
    keys = t(spark, d, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("s_nationkey"))
    return rules.in_or(t(spark, d, "supplier"), keys, F.col("s_acctbal") > 9000).select("s_suppkey", "s_name")


@query("SELECT s_suppkey, n_name FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def strict_attach(spark, d):
    dim = t(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return checks.attach(t(spark, d, "supplier").select("s_suppkey", "s_nationkey"), dim, ["s_nationkey"]).select("s_suppkey", "n_name")


@query("SELECT CAST(n AS INTEGER) AS candidates, count(*) AS cells FROM (SELECT ps_n AS n FROM (SELECT l_orderkey, count(DISTINCT l_suppkey) AS ps_n FROM lineitem GROUP BY 1)) GROUP BY 1")
def set_size_histogram(spark, d):
    return profile.set_sizes(t(spark, d, "lineitem"), ["l_orderkey"], "l_suppkey", "candidates", "cells")


@query("""
WITH g AS (SELECT n_regionkey, n_name, CASE WHEN n_nationkey % 6 = 0 THEN NULL ELSE count(*) END AS n FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_regionkey, n_name, n_nationkey)
SELECT *, CAST(row_number() OVER (ORDER BY CASE WHEN n_regionkey = 3 THEN 0 ELSE 1 END, n DESC NULLS LAST, n_name) AS INTEGER) AS place FROM g
""")
def report_order(spark, d):
    g = t(spark, d, "nation").join(t(spark, d, "supplier"), F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey", "n_name", "n_nationkey").agg(F.count("*").alias("c"))
    rows = g.select("n_regionkey", "n_name", F.when(F.col("n_nationkey") % 6 != 0, F.col("c")).alias("n"))
    return profile.report(rows, [F.when(F.col("n_regionkey") == 3, 0).otherwise(1), F.desc_nulls_last("n"), "n_name"], "place")


# ---- fail-closed checks

_ROWS = 'SELECT "check", CASE WHEN n = 0 THEN \'pass\' ELSE fails END AS status, CAST(n AS VARCHAR) || s AS summary FROM c'


@query(f"""
WITH r AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 9 = 0 THEN CAST('NaN' AS DOUBLE) ELSE 0.5 END AS told FROM supplier), w AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 5 = 0 THEN 0.4 ELSE 0.5 END AS is_ FROM supplier WHERE s_suppkey % 7 <> 0),
c AS (SELECT 'phantom shares' AS "check", count(*) AS n, 'fail' AS fails, ' shares that the ledger doesn''t back' AS s FROM r LEFT JOIN w USING (k) WHERE isnan(told) OR abs(told - coalesce(is_, 0)) > 1e-9
UNION ALL SELECT 'unique names', (SELECT count(*) FROM supplier WHERE s_suppkey % 8 = 0) + (SELECT count(*) FROM (SELECT lower(n) FROM (SELECT CASE WHEN s_suppkey % 10 < 2 THEN 'North ' || (s_suppkey // 10) ELSE s_name END AS n, s_suppkey FROM supplier WHERE s_suppkey % 8 <> 0) GROUP BY 1 HAVING count(*) > 1)), 'fail', ' names blank or used twice'
UNION ALL SELECT 'routing', (SELECT count(*) FROM customer WHERE (CASE WHEN c_custkey % 17 = 0 THEN 'stray' WHEN c_nationkey < 5 THEN 'fallback' ELSE c_mktsegment END) <> CASE WHEN c_nationkey < 5 THEN 'fallback' ELSE c_mktsegment END), 'fail', ' cells routed elsewhere'
UNION ALL SELECT 'manifest complete', (SELECT count(*) FROM nation WHERE n_nationkey % 6 = 0), 'fail', ' entries missing'
UNION ALL SELECT 'one vintage', (SELECT count(*) FROM nation WHERE n_nationkey % 6 <> 0 AND n_nationkey % 7 = 0), 'fail', ' entries of another vintage'
UNION ALL SELECT 'hash form', (SELECT count(*) FROM nation WHERE n_nationkey % 6 <> 0 AND n_nationkey % 5 = 0), 'fail', ' malformed hashes')
{_ROWS}
""")
def closed_checks(spark, d):
    """Shares that nothing backs, names, routing and the manifest of the reference files."""
    s, c, n = t(spark, d, "supplier"), t(spark, d, "customer"), t(spark, d, "nation")
    key = F.col("s_suppkey")
    told = s.select(key.alias("k"), F.when(key % 9 == 0, F.lit(float("nan"))).otherwise(0.5).alias("share"))
    is_ = s.where(key % 7 != 0).select(key.alias("k"), F.when(key % 5 == 0, 0.4).otherwise(0.5).alias("share"))
    name = F.when(key % 8 == 0, F.lit("  ")).when(key % 10 < 2, F.concat(F.when(key % 2 == 0, "north ").otherwise("NORTH "), F.floor(key / 10).cast("string"))).otherwise(F.col("s_name"))
    stray = F.when(F.col("c_custkey") % 17 == 0, "stray").when(F.col("c_nationkey") < 5, "fallback").otherwise(F.col("c_mktsegment"))
    cells = c.select(F.col("c_custkey").alias("unit"), F.col("c_nationkey").cast("string").alias("fine"), stray.alias("channel"))
    domains = c.where("c_nationkey >= 5").select(F.col("c_custkey").alias("unit"), F.col("c_nationkey").cast("string").alias("fine"), F.col("c_mktsegment").alias("channel"))
    nk = F.col("n_nationkey")
    entries = n.where(nk % 6 != 0).select(F.col("n_name").alias("name"), F.when(nk % 7 == 0, "2019").otherwise("2020").alias("vintage"), F.when(nk % 5 == 0, "ABC").otherwise(F.sha2("n_name", 256)).alias("sha256"))
    rows = checks.all_of(
        [
            checks.phantom_check(told, is_, ["k"]),
            checks.names_check(s.select(name.alias("district_name"))),
            checks.route_check(cells, domains, "fallback"),
            checks.manifest_check(entries, n.select(F.col("n_name").alias("name")), "2020"),
        ]
    )
    return rows.select("check", "status", "summary")


@query("""
WITH x AS (SELECT n_name AS scenario, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal < 0) AS bad, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal < -900) AS odd FROM nation)
SELECT scenario, CAST((bad = 0) AS BIGINT) + CAST((odd = 0) AS BIGINT) AS pass, CAST((bad > 0) AS BIGINT) AS fail, CAST((odd > 0) AS BIGINT) AS listed, CAST(0 AS BIGINT) AS unverified FROM x
""")
def catalog_audit(spark, d):
    """Two checks of every nation as a scenario of its own, in one pass, counted by status."""
    n, s, c = t(spark, d, "nation"), t(spark, d, "supplier"), t(spark, d, "customer")
    every = n.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("scenario"))
    bad = s.where("s_acctbal < 0").select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("item"))
    odd = c.where("c_acctbal < -900").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("item"))
    named = lambda df: df.join(every, "k")
    rows = checks.check_rows("negative suppliers", every, named(bad), "scenario", F.col("item"), "suppliers").unionByName(checks.check_rows("very negative customers", every, named(odd), "scenario", F.col("item"), "customers", "listed"))
    return checks.by_status(rows)


@query(f"""
WITH f AS (SELECT 'r' || n_nationkey AS folder, n_nationkey AS k FROM nation),
c AS (SELECT 'ledger without manifest' AS "check", (SELECT count(*) FROM f WHERE k % 4 = 0) AS n, 'fail' AS fails, ' folders' AS s
UNION ALL SELECT 'stale images', (SELECT count(*) FROM f WHERE k % 3 = 0), 'listed', ' folders'
UNION ALL SELECT 'duplicate ids', (SELECT count(*) FROM (SELECT k % 20 FROM f WHERE k % 4 <> 0 GROUP BY 1 HAVING count(*) > 1)), 'fail', ' run ids')
{_ROWS}
""")
def run_tracking(spark, d):
    n = t(spark, d, "nation")
    k = F.col("n_nationkey")
    folder = F.concat(F.lit("r"), k.cast("string")).alias("folder")
    none = F.lit(None).cast("string")
    led = n.select(folder, F.lit("ledger.csv").alias("file"), none.alias("run_id"), F.lit(10).alias("modified"))
    man = n.where(k % 4 != 0).select(folder, F.lit("manifest.json").alias("file"), (k % 20).cast("string").alias("run_id"), F.lit(11).alias("modified"))
    png = n.select(folder, F.lit("map.png").alias("file"), none.alias("run_id"), F.when(k % 3 == 0, 9).otherwise(12).alias("modified"))
    return checks.tracked(led.unionByName(man).unionByName(png)).select("check", "status", "summary")


@query("""
SELECT c_custkey, CAST(c_nationkey AS BIGINT) AS rated, CAST(c_custkey * (c_nationkey + 2) AS DOUBLE) AS there, CAST(c_custkey AS DOUBLE) AS back FROM customer
""")
def rescaled_masses(spark, d):
    c = t(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("channel"), F.col("c_custkey").cast("double").alias("m"))
    rates = t(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("channel"), (F.col("n_nationkey") + 2.0).alias("rate"))
    there = score.rescaled(c, rates, "channel", ["m"])
    back = score.rescaled(there, rates, "channel", ["m"], back=True).select("c_custkey", F.round("m", 9).alias("back"))
    return there.select("c_custkey", F.col("channel").alias("rated"), F.col("m").alias("there")).join(back, "c_custkey")


@query("""
WITH cells AS (SELECT n_nationkey AS nation, seg, (n_nationkey + 1) * 2000 AS m FROM nation, (SELECT DISTINCT c_mktsegment AS seg FROM customer)),
s AS (SELECT c_nationkey AS nation, c_mktsegment AS seg, 'r' || (c_custkey % 4) AS rep, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS a FROM customer GROUP BY ALL HAVING sum(CAST(c_acctbal AS DECIMAL(18,2))) > 0),
p AS (SELECT nation, seg, sum(round(a / m, 6)) AS t, count(*) AS reps FROM s JOIN cells USING (nation, seg) GROUP BY ALL)
SELECT nation, seg, CASE WHEN p.t IS NULL THEN 'vacant' WHEN p.t < 1 THEN 'untapped' ELSE 'contested' END AS kind, coalesce(reps, 0) AS reps, round(greatest(1 - coalesce(p.t, 0), 0), 4) AS share_free, round(least(coalesce(p.t, 0), 1), 4) AS after_repair FROM cells LEFT JOIN p USING (nation, seg)
""")
def share_build(spark, d):
    """Cells by what their reps sell of them: vacant, untapped or contested; shares beyond 1 are repaired."""
    c = t(spark, d, "customer")
    seg = c.select(F.col("c_mktsegment").alias("seg")).distinct()
    cells = t(spark, d, "nation").select(F.col("n_nationkey").alias("nation"), ((F.col("n_nationkey") + 1) * 2000).cast("double").alias("m")).crossJoin(F.broadcast(seg))
    own = c.groupBy(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("seg"), F.concat(F.lit("r"), (F.col("c_custkey") % 4).cast("string")).alias("rep")).agg(F.sum(F.col("c_acctbal").cast(CENTS)).cast("double").alias("a"))
    built = export.repaired(export.shares(own, cells, ["nation", "seg"], "rep", "a", "m"))
    after = F.aggregate(F.map_values("share"), F.lit(0.0), lambda a, x: a + x)
    return built.select("nation", "seg", "kind", F.coalesce(F.size("share"), F.lit(0)).cast("long").alias("reps"), F.round("share_free", 4).alias("share_free"), F.round(F.coalesce(after, F.lit(0.0)), 4).alias("after_repair")).withColumn("reps", F.greatest("reps", F.lit(0).cast("long")))
