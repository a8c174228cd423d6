"""Writers: fixed columns and order. Distributed where data is large; byte-stable single files where a file is the product."""

from __future__ import annotations

import csv
import gzip
import io
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelry.operators.checks import Violation, require
from parcelry.sources.readers import LEDGER

#: Rows that a single-file writer may gather on the driver, and rows of a Markdown table; more raise.
SMALL = 2_000_000
TABLE = 10_000


def conformed(df: DataFrame, target: DataFrame, rename: dict[str, str] | None = None) -> DataFrame:
    """df in a target's columns, order and types; a column that can't be found is an error."""
    df = df.withColumnsRenamed(rename or {})
    lost = [f.name for f in target.schema.fields if f.name not in df.columns]
    if lost:
        raise Violation(f"no columns {lost}")
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in target.schema.fields))


def ledger(df: DataFrame, path: str) -> None:
    """A ledger as CSV files with the fixed header, whatever columns are missing empty."""
    columns = [F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in LEDGER]
    df.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def keyed_parquet(df: DataFrame, path: str, key: list[str], partition: list[str] | None = None) -> None:
    """Parquet under a primary key that is checked, as Spark enforces none."""
    require(df.groupBy(*key).count().where("count > 1"), "key twice")
    require(df.where(" OR ".join(f"{k} IS NULL" for k in key)).select(*key), "key with NULL")
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition) if partition else w).parquet(path)


def _gathered(df: DataFrame, order: list[str] | None, most: int = SMALL) -> list[dict]:
    rows = (df.orderBy(*order) if order else df).limit(most + 1).collect()
    if len(rows) > most:
        raise Violation(f"more than {most} rows for one file")
    return [r.asDict(recursive=True) for r in rows]


def csv_gz(df: DataFrame, path: str, order: list[str]) -> None:
    """One gzip CSV that is the same bytes whenever the rows are: a total order and no time stamp."""
    text = io.StringIO()
    w = csv.DictWriter(text, df.columns, lineterminator="\n")
    w.writeheader()
    w.writerows(_gathered(df, order))
    _replace(path, gzip.compress(text.getvalue().encode(), mtime=0))


def json_lines(df: DataFrame, path: str, order: list[str]) -> None:
    """A JSON Lines index, put in place at once."""
    lines = [json.dumps(r, sort_keys=True, ensure_ascii=False, default=str) + "\n" for r in _gathered(df, order)]
    _replace(path, "".join(lines).encode())


def text_file(path: str, text: str) -> None:
    """A text as one file, put in place at once."""
    _replace(path, text.encode())


def gzipped(path: str, text: str) -> None:
    """A text as one gzip file without a time stamp."""
    _replace(path, gzip.compress(text.encode(), mtime=0))


def _replace(path: str, data: bytes) -> None:
    """Written beside the path, in whatever store it is, then renamed."""
    spark = SparkSession.active()
    jvm = spark._jvm
    to, part = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.part")
    fs = to.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(part, True)
    out.write(bytearray(data))
    out.close()
    fs.delete(to, False)
    if not fs.rename(part, to):
        raise OSError(f"{path} can't be put in place")


def markdown(df: DataFrame, order: list[str] | None = None) -> str:
    """A small frame as a Markdown table; one of more than TABLE rows raises."""
    rows = [list(r.values()) for r in _gathered(df, order, TABLE)]
    cell = lambda v: "" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(cell, r)) + " |" for r in rows]) + "\n"


def load_script(df: DataFrame, name: str, key: list[str]) -> str:
    """DDL of a table like df, with its primary key, for a warehouse to load the export into."""
    kinds = {"string": "VARCHAR", "double": "DOUBLE", "bigint": "BIGINT", "int": "INTEGER", "boolean": "BOOLEAN", "date": "DATE"}
    columns = [f"  {f.name} {kinds.get(f.dataType.simpleString(), f.dataType.simpleString().upper())}{' NOT NULL' if f.name in key else ''}" for f in df.schema.fields]
    return f"CREATE TABLE {name} (\n" + ",\n".join([*columns, f"  PRIMARY KEY ({', '.join(key)})"]) + "\n);\n"
