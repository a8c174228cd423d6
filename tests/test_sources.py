import gzip
import json
import os

import pytest
from pyspark.sql import functions as F

from parcelry.operators.checks import Violation
from parcelry.sources import readers, writers
from parcelry.streaming import incremental


def put(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


@pytest.mark.parametrize("sep", [",", "\t", ";", "|"])
def test_delimited_and_aliases(spark, tmp_path, sep):
    p = put(tmp_path / "a.txt", "﻿" + sep.join(["Zip_Code", "CHANNEL", "M Rel"]) + "\n" + sep.join(["01234", "x", "1.5"]) + "\n")
    df = readers.picked(readers.delimited(spark, p), {"zip": ["zip code"], "channel": [], "m_rel": [], "rep": []}, optional=("rep",))
    assert [tuple(r) for r in df.collect()] == [("01234", "x", "1.5", None)]
    with pytest.raises(Violation, match="no column"):
        readers.picked(df, {"nothing": ["nil"]})


def extract(**more):
    return {"format": "t1", "z": ["00001", "00002"], "channel": ["a", "a"], "m_rel": [1.0, 0.0], "share": [{"r": 0.5}, {}], "share_free": [0.5, 1.0]} | more


def test_extract(spark, tmp_path):
    p = str(tmp_path / "e.json.gz")

    def write(x):
        with gzip.open(p, "wt") as f:
            json.dump(x, f)
        return p

    assert readers.extract(spark, write(extract()), "t1").count() == 2
    for wrong, what in (({"format": "t2"}, "form"), ({"z": ["00001"]}, "form"), ({"z": ["1", "00002"], "m_rel": [-1.0, 1.0]}, "bad keys.*bad masses"), ({"z": ["00001", "00001"]}, "cells twice")):
        with pytest.raises(Violation, match=what):
            readers.extract(spark, write(extract(**wrong)), "t1").collect()


def test_reference_keeps_empty_text(spark, tmp_path):
    p = put(tmp_path / "r.csv", "zcta,state\n00501,NY\n00502,\n")
    assert [tuple(r) for r in readers.reference(spark, p, ["zcta", "state"]).collect()] == [("00501", "NY"), ("00502", "")]
    c = put(tmp_path / "c.csv", "a,b,kind,crossing,gap_km,status,source\n1,2,road,x,0.5,approved,s\n")
    assert readers.connectors(spark, c).first().gap_km == 0.5
    with pytest.raises(Violation, match="status"):
        readers.connectors(spark, put(tmp_path / "d.csv", "a,b,kind,crossing,gap_km,status,source\n1,2,road,x,0.5,maybe,s\n"))


def test_adjacency(spark, tmp_path):
    p = put(tmp_path / "n.txt", "a|b|name\n1|2|Peñas\n1|1|x\n2|9|y\n2|1|z\n", "latin-1")
    keys = spark.createDataFrame([("1",), ("2",)], "id string")
    assert {(r.a, r.b) for r in readers.adjacency(spark, p, keys).collect()} == {("1", "2"), ("2", "1")}


def test_ledger_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("s", "00501", "D1", 1.25), ("s", "00502", None, 0.0)], "scenario string, zip_code string, district string, m_rel double")
    writers.ledger(rows, str(tmp_path / "l"))
    back = readers.ledger(spark, str(tmp_path / "l"))
    assert back.columns == readers.LEDGER
    assert {(r.zip_code, r.district, r.m_rel) for r in back.collect()} == {("00501", "D1", 1.25), ("00502", None, 0.0)}


def test_manifests_and_reports(spark, tmp_path):
    for i in (1, 2):
        os.makedirs(tmp_path / f"runs/r{i}")
        put(tmp_path / f"runs/r{i}/manifest.json", json.dumps({"run_id": f"id{i}", "status": "done", "parent" if i == 1 else "parent_run": "p"}))
        put(tmp_path / f"runs/r{i}/score.txt", f"splits: {i}\nworst 0.{i}\n")
    from parcelry.operators.score import index_rows

    m = index_rows(readers.manifests(spark, str(tmp_path / "runs")))
    assert {(r.run_id, r.folder, r.parent_run) for r in m.collect()} == {("id1", "r1", "p"), ("id2", "r2", "p")}
    f = readers.report_fields(spark, str(tmp_path / "runs/*/score.txt"), {"splits": r"splits: (\d+)", "none": r"none: (\d+)"})
    assert {(r.splits, r.none) for r in f.collect()} == {("1", None), ("2", None)}


def test_scenario(spark):
    s = readers.scenario('[scenario]\nname = "s"\ndelta = 0.1\n[sets]\nx = ["a", "b"]\n[channels.M]\nk = 3\nmode = "clipped"\nfine = ["f", "g"]\n')
    assert s.sets == {"x": ("a", "b")} and readers.channel_rows(spark, s).count() == 2 and s.channels[0].delta == 0.1
    with pytest.raises(Violation, match="positive"):
        readers.scenario('[scenario]\nname = "s"\n[channels.M]\nk = 0\n')


def test_byte_stable_files(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, "a,\"x\"")], "k int, v string")
    for i in (1, 2):
        writers.csv_gz(df.repartition(i), str(tmp_path / f"{i}.gz"), ["k"])
        writers.json_lines(df.repartition(i), str(tmp_path / f"{i}.jsonl"), ["k"])
    assert (tmp_path / "1.gz").read_bytes() == (tmp_path / "2.gz").read_bytes()
    assert (tmp_path / "1.jsonl").read_bytes() == (tmp_path / "2.jsonl").read_bytes() == b'{"k": 1, "v": "a,\\"x\\""}\n{"k": 2, "v": "b"}\n'


def test_keys_and_schemas(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(Violation, match="key twice"):
        writers.keyed_parquet(df, str(tmp_path / "p"), ["k"])
    writers.keyed_parquet(df, str(tmp_path / "p"), ["k", "v"])
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    target = spark.createDataFrame([], "v string, n bigint")
    assert writers.conformed(df, target, {"k": "n"}).schema.simpleString() == "struct<v:string,n:bigint>"
    with pytest.raises(Violation, match="no columns"):
        writers.conformed(df, target)
    assert "PRIMARY KEY (k)" in writers.load_script(df, "t", ["k"]) and writers.markdown(df, ["v"]).splitlines()[2] == "| 1 | a |"


def test_samples_are_stable(spark):
    df = spark.range(500).withColumn("w", F.col("id") % 10)
    a = {r.id for r in readers.sampled(df, 50, "w", 1, "id").collect()}
    assert a == {r.id for r in readers.sampled(df.repartition(7), 50, "w", 1, "id").collect()} and len(a) == 50 and all(i % 10 for i in a)
    m = readers.synthetic_masses(df, "id", 3)
    assert m.agg(F.percentile("m_rel", F.lit(0.5))).first()[0] == pytest.approx(1.0)


def test_table_by_name(spark):
    spark.range(3).createOrReplaceTempView("some_table")
    assert readers.table(spark, "some_table").count() == 3


def test_stream_equals_batch(spark, tmp_path):
    rows = [(f"2024-01-01 {h:02d}:{m:02d}:00", "ab"[m % 2], 1.5) for h in range(6) for m in range(0, 60, 7)]
    df = spark.createDataFrame(rows, "t string, k string, v double").withColumn("ts", F.col("t").cast("timestamp"))
    for h in range(6):
        df.where(F.hour("ts") == h).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    live = incremental.windowed(incremental.stream(spark, str(tmp_path / "in"), df), "ts", ["k"], "v")
    q = incremental.into(live, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    got = {(r.start, r.k, r.n, r.total) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.start, r.k, r.n, r.total) for r in incremental.windowed(df, "ts", ["k"], "v").collect()}
    assert got and got <= want  # windows that the watermark has closed
