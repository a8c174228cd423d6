"""Readers: schema first, keys as text, and errors instead of guesses."""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelry.operators.checks import Violation, require

LEDGER = ["scenario", "zip_code", "current_channel", "state", "model_channel", "district", "district_channels", "rep", "county", "cbsa", "place", "district_name", "m_rel", "reason"]
SEPARATORS = ",\t;|"
#: Bytes of a file from which its separator is told.
SNIFFED = 8192
#: What a channel may do with a unit.
MODES = ("whole", "clipped", "split")


def table(spark: SparkSession, name: str) -> DataFrame:
    """A table by a name that is only known at run time."""
    return spark.sql("SELECT * FROM IDENTIFIER(:name)", args={"name": name})


def tables(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}


def separator(lines: list[str]) -> str:
    """The separator that most lines hold as often as the header does, outside quotes; of several the one the header holds most; a comma if none."""
    bare = [re.sub(r'"[^"]*"', "", x) for x in lines if x.strip()] or [""]
    agree = lambda s: sum(x.count(s) == bare[0].count(s) for x in bare) if s in bare[0] else 0
    return max(SEPARATORS, key=lambda s: (agree(s), bare[0].count(s), s == ","))


def head(spark: SparkSession, path: str, size: int = SNIFFED) -> list[str]:
    """The whole lines among a file's first bytes (one line at least), read with a limit on rows."""
    lines, room = [], size
    for r in spark.read.text(path).limit(size).toLocalIterator():
        if lines and len(r.value) + 1 > room:
            break
        lines.append(r.value)
        room -= len(r.value) + 1
    return lines


def delimited(spark: SparkSession, path: str) -> DataFrame:
    """Delimited text, all columns text; the separator is found in the first 8 KiB, a byte order mark is dropped."""
    lines = head(spark, path)
    if not lines:
        raise Violation(f"{path} is empty")
    df = spark.read.option("header", True).option("sep", separator(lines)).csv(path)
    return df.toDF(*(c.lstrip("﻿").strip() for c in df.columns))


def picked(df: DataFrame, wanted: dict[str, list[str]], optional: tuple[str, ...] = ()) -> DataFrame:
    """Columns by any of their aliases, case and underscores aside, under the name wanted; a missing one is an error."""
    plain = lambda c: re.sub(r"[^a-z0-9]", "", c.lower())
    have = {}
    for c in df.columns:
        have.setdefault(plain(c), c)
    out = []
    for name, aliases in wanted.items():
        found = next((have[plain(a)] for a in [name, *aliases] if plain(a) in have), None)
        if found is None and name not in optional:
            raise Violation(f"no column {name}, nor {aliases}, among {df.columns}")
        out.append(F.col(f"`{found}`").alias(name) if found else F.lit(None).cast("string").alias(name))
    return df.select(*out)


EXTRACT = T.StructType(
    [
        T.StructField("format", T.StringType()),
        T.StructField("z", T.ArrayType(T.StringType())),
        T.StructField("channel", T.ArrayType(T.StringType())),
        T.StructField("m_rel", T.ArrayType(T.DoubleType())),
        T.StructField("share", T.ArrayType(T.MapType(T.StringType(), T.DoubleType()))),
        T.StructField("share_free", T.ArrayType(T.DoubleType())),
    ]
)


def extract(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """A columnar JSON extract (gzip too) as rows; the tag, equal lengths, keys and values are checked, all failures in one error."""
    raw = spark.read.schema(EXTRACT).option("multiLine", True).json(path)
    columns = [f.name for f in EXTRACT.fields[1:]]
    wrong = raw.where((F.col("format") != tag) | F.col("format").isNull() | ~(F.size("z") == F.greatest(*(F.size(c) for c in columns))) | ~(F.size("z") == F.least(*(F.size(c) for c in columns))))
    require(wrong.select("format", *(F.size(c).alias(c) for c in columns)), "not an extract of this form")
    rows = raw.select(F.inline(F.arrays_zip(*columns)))
    bad = {
        "bad keys": F.count_if(~F.coalesce(F.col("z").rlike("^[0-9]{5}$"), F.lit(False))),
        "bad masses": F.count_if(F.coalesce(F.isnan("m_rel") | (F.col("m_rel") < 0) | (F.col("m_rel") == float("inf")), F.lit(True))),
        "bad shares": F.count_if(F.exists(F.map_values("share"), lambda x: F.isnan(x) | (x < 0))),
        "cells twice": F.count("*") - F.countDistinct("z", "channel"),
    }
    found = {k: v for k, v in rows.agg(*(c.alias(k) for k, c in bad.items())).first().asDict().items() if v}
    if found:
        raise Violation(f"{path}: {found}")
    return rows


def reference(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A dimension from CSV (gzip too), all text; empty stays an empty string."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path).na.fill("")


def connectors(spark: SparkSession, path: str) -> DataFrame:
    df = reference(spark, path, ["a", "b", "kind", "crossing", "gap_km", "status", "source"]).withColumn("gap_km", F.col("gap_km").try_cast("double"))
    require(df.where(~F.col("status").isin("proposed", "approved", "rejected")).select("a", "b", "status"), "unknown status")
    return df


def adjacency(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """A pipe-delimited Latin-1 list of neighbours: no loops, both ends in the set (keys: id)."""
    df = spark.read.option("header", True).option("sep", "|").option("encoding", "ISO-8859-1").csv(path)
    a, b = df.columns[:2]
    df = df.select(F.trim(a).alias("a"), F.trim(b).alias("b")).where("a <> b")
    return df.join(keys.select(F.col("id").alias("a")), "a", "left_semi").join(keys.select(F.col("id").alias("b")), "b", "left_semi").distinct()


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """A ledger back from CSV: text, but for m_rel. The header's order is the file's own."""
    df = spark.read.option("header", True).csv(path)
    unknown = [c for c in df.columns if c not in LEDGER]
    if unknown or "m_rel" not in df.columns:
        raise Violation(f"not a ledger: {df.columns}")
    return df.withColumn("m_rel", F.col("m_rel").cast("double"))


def manifests(spark: SparkSession, folder: str, file: str = "manifest.json") -> DataFrame:
    """Every run's manifest under a folder, with the folder it is in."""
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", file).option("multiLine", True).json(folder)
    return df.withColumn("folder", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1))


def report_fields(spark: SparkSession, path: str, fields: dict[str, str]) -> DataFrame:
    """Figures from text reports: a pattern with one group for each field; NULL where it doesn't fit."""
    df = spark.read.text(path, wholetext=True)
    value = lambda p: F.nullif(F.regexp_extract("value", p, 1), F.lit(""))
    return df.select(F.col("_metadata.file_path").alias("path"), *(value(p).alias(n) for n, p in fields.items()))


@dataclass(frozen=True)
class Channel:
    name: str
    k: int
    domain: str = ""
    mode: str = "whole"
    delta: float = 0.0
    fine: tuple[str, ...] = ()


@dataclass(frozen=True)
class Scenario:
    name: str
    delta: float
    sets: dict[str, tuple[str, ...]] = field(default_factory=dict)
    channels: tuple[Channel, ...] = ()
    planned_elsewhere: tuple[str, ...] = ()


def scenario(text: str) -> Scenario:
    """A scenario from TOML; unknown modes and counts below 1 are errors."""
    raw = tomllib.loads(text)
    head = raw["scenario"]
    channels = []
    for name, c in raw.get("channels", {}).items():
        if not isinstance(c.get("k"), int) or c["k"] < 1:
            raise Violation(f"{name}: k must be a positive integer")
        if c.get("mode", "whole") not in MODES:
            raise Violation(f"{name}: unknown mode {c['mode']}")
        channels.append(Channel(name, c["k"], c.get("domain", ""), c.get("mode", "whole"), float(c.get("delta", head.get("delta", 0.0))), tuple(c.get("fine", ()))))
    return Scenario(head["name"], float(head.get("delta", 0.0)), {k: tuple(v) for k, v in raw.get("sets", {}).items()}, tuple(channels), tuple(head.get("planned_elsewhere", ())))


def channel_rows(spark: SparkSession, s: Scenario) -> DataFrame:
    rows = [(c.name, f, c.k, c.mode, c.domain, c.delta) for c in s.channels for f in c.fine or (c.name,)]
    return spark.createDataFrame(rows, "channel string, fine string, k int, mode string, domain string, delta double")


def domain_units(spark: SparkSession, s: Scenario) -> DataFrame:
    """channel, unit: the members of each channel's domain, a set expression over the scenario's sets."""
    rows = []
    for c in s.channels:
        parts = c.domain.split()
        lost = [p for p in parts[::2] if p not in s.sets]
        if lost or not parts or any(p not in "+-" for p in parts[1::2]):
            raise Violation(f"{c.name}: domain {c.domain!r} isn't an expression over {sorted(s.sets)}")
        own = set(s.sets[parts[0]])
        for op, name in zip(parts[1::2], parts[2::2], strict=True):
            own = own - set(s.sets[name]) if op == "-" else own | set(s.sets[name])
        rows += [(c.name, u) for u in sorted(own)]
    return spark.createDataFrame(rows, "channel string, unit string")


def sampled(df: DataFrame, n: int, weight: str, seed: int, key: str) -> DataFrame:
    """n rows without replacement, the chance by weight: the smallest -ln(u) / w, u from a hash of the key and the seed."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 11).cast("double") + 0.5) / float(2**53)
    order = -F.log(u) / F.col(weight)
    return df.where(F.col(weight) > 0).orderBy(order, key).limit(n)


def synthetic_masses(df: DataFrame, key: str, seed: int, sigma: float = 1.0, name: str = "m_rel") -> DataFrame:
    """Log-normal masses of median 1, from hashes of the key: the same at every run and partitioning."""
    u = lambda i: (F.shiftrightunsigned(F.xxhash64(F.lit(seed + i), key), 11).cast("double") + 0.5) / float(2**53)
    normal = F.sqrt(-2 * F.log(u(0))) * F.cos(2 * 3.141592653589793 * u(1))
    out = df.withColumn("_m", F.exp(sigma * normal))
    middle = out.agg(F.percentile("_m", F.lit(0.5)).alias("_d"))
    return out.crossJoin(F.broadcast(middle)).withColumn(name, F.col("_m") / F.col("_d")).drop("_m", "_d")
