"""Looks and reports: pieces by parts, other labels for the same cells, shortlists, orders of a report, colours."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelry.operators.checks import Violation, attach
from parcelry.operators.graph import components

#: Districts that colours are dealt to on the driver.
SMALL = 10_000


def relabelled(cells: DataFrame, dimension: DataFrame, unit: str, label: str, channel: str = "channel", district: str = "district") -> DataFrame:
    """Cells with their unit's label in place of the district, as 'channel:label', to be measured like districts; units that the dimension lacks have no row."""
    told = cells.drop(district).join(dimension.select(unit, label), unit)
    return told.withColumn(district, F.concat_ws(":", channel, label)).drop(label)


def part_pieces(parts: DataFrame, part_edges: DataFrame, owners: DataFrame, district: str) -> DataFrame:
    """Separate pieces that districts have by parts of their places, beyond each one's largest: district, piece (its smallest part), places, area.

    parts: id, part, area. part_edges: a, a_part, b, b_part. owners: id, district.
    """
    name = lambda place, part: F.concat_ws("/", F.col(place).cast("string"), F.col(part).cast("string"))
    own = parts.join(owners, "id").select(name("id", "part").alias("id"), F.col("id").alias("place"), "area", district)
    e = part_edges.select(name("a", "a_part").alias("a"), name("b", "b_part").alias("b"))
    got = components(own, e, district).groupBy(district, F.col("component").alias("piece")).agg(F.sort_array(F.collect_set("place")).alias("places"), F.sum("area").alias("area"))
    nth = F.row_number().over(Window.partitionBy(district).orderBy(F.desc("area"), "piece"))
    return got.withColumn("_n", nth).where("_n > 1").drop("_n")


def shortlist(entries: DataFrame, scores: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Entries (tier, rank, id, run) with their run's figures, summed over channels, and its verdict; what a run lacks is NULL.

    scores: run, channel, k, within10, worst, splits, thin, small. verdicts: run, verdict. within10 is NULL if a channel's is.
    """
    whole = F.when(F.count("within10") == F.count("*"), F.sum("within10")).alias("within10")
    figures = scores.groupBy("run").agg(F.sum("k").alias("districts"), whole, F.round(100 * F.max("worst"), 1).alias("worst"), *(F.sum(c).alias(c) for c in ("splits", "thin", "small")))
    return entries.join(figures, "run", "left").join(verdicts, "run", "left")


def morning_order(points: DataFrame, labels: list[str], key: str = "key", pair: str = "pair") -> DataFrame:
    """points with their place in a report: by label (unknown ones last), then by key (NULL last), then by id; a pair's second stands behind its first where both have one label. A report is small."""
    known = F.array_position(F.array(*map(F.lit, labels)), F.col("label"))
    by_label = F.when(known > 0, known).otherwise(len(labels) + 1)
    first = points.withColumn("_p", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(by_label, F.asc_nulls_last(key), "id")))
    together = Window.partitionBy("label", F.coalesce(pair, F.concat(F.lit("id "), F.col("id").cast("string"))))
    return first.withColumn("_f", F.min("_p").over(together)).withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_f", "_p"))).drop("_p", "_f")


def coloured(districts: DataFrame, near: DataFrame, colours: int) -> DataFrame:
    """district, colour (from 0): districts with many neighbours first, each the colour that fewest of its neighbours have, then the least used. On the driver, for SMALL districts at most."""
    ids = [r[0] for r in districts.select("district").distinct().limit(SMALL + 1).collect()]
    if len(ids) > SMALL:
        raise Violation(f"more than {SMALL} districts to colour")
    around: dict = {d: set() for d in ids}
    for a, b in near.select("a", "b").collect():
        if a != b and a in around and b in around:
            around[a].add(b)
            around[b].add(a)
    out: dict = {}
    used: Counter = Counter()
    for d in sorted(ids, key=lambda d: (-len(around[d]), d)):
        worn = Counter(out[x] for x in around[d] & out.keys())
        out[d] = min(range(colours), key=lambda c: (worn[c], used[c], c))
        used[out[d]] += 1
    kind = districts.schema["district"].dataType.simpleString()
    return districts.sparkSession.createDataFrame(list(out.items()), f"district {kind}, colour int")


def domain_masses(extract: DataFrame, units: DataFrame, domains: DataFrame) -> DataFrame:
    """channel, unit, mass, cells: what each channel's domain (unit, fine, channel) holds of an extract (zip, fine, m_rel)."""
    cells = extract.join(units, "zip").groupBy("unit", "fine").agg(F.sum("m_rel").alias("m"), F.count("*").alias("n"))
    return cells.join(domains, ["unit", "fine"]).groupBy("channel", "unit").agg(F.sum("m").alias("mass"), F.sum("n").alias("cells"))


def cut(extract: DataFrame, cells: DataFrame, unit: str = "unit", fine: str = "fine") -> DataFrame:
    """Rows whose (unit, fine) is among the cells; a cell without unit takes its fine channel everywhere."""
    exact = cells.where(F.col(unit).isNotNull()).select(unit, fine).distinct().withColumn("_c", F.lit(True))
    any_ = cells.where(F.col(unit).isNull()).select(fine).distinct().withColumn("_f", F.lit(True))
    told = extract.join(exact, [unit, fine], "left").join(any_, [fine], "left")
    return told.where(F.col("_c").isNotNull() | F.col("_f").isNotNull()).select(*extract.columns)


def revalued(ledger: DataFrame, full: DataFrame, key: list[str], value: str) -> DataFrame:
    """A ledger's cells at the full extract's value; a cell that the extract lacks is an error."""
    return attach(ledger.drop(value), full.select(*key, value), key)
