"""What is in a table: columns, keys, duplicates and how datasets meet."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelry.functions.norm import has_non_digit, missing


def long_form(df: DataFrame, columns: list[str], row: list[str], weight: str | None = None) -> DataFrame:
    """A row for each cell: row keys, weight, column_name, value (as text)."""
    text = df.select(*row, *([weight] if weight else []), *(F.col(c).cast("string").alias(c) for c in columns))
    return text.unpivot([*row, *([weight] if weight else [])], columns, "column_name", "value")


def column_profile(df: DataFrame, columns: list[str], weight: str) -> DataFrame:
    """By column: rows, distinct values, percent missing by rows and by weight, lengths, and values that aren't all digits."""
    cells = long_form(df, columns, [], weight)
    gone = missing("value")
    there = F.when(~gone, F.col("value"))
    return cells.groupBy("column_name").agg(
        F.count("*").alias("n_rows"),
        F.countDistinct(there).alias("n_distinct"),
        F.round(100.0 * F.count_if(gone) / F.count("*"), 2).alias("pct_missing_rows"),
        F.round(F.lit(100.0) * F.sum(F.when(gone, F.col(weight)).otherwise(0)).cast("double") / F.sum(weight).cast("double"), 2).alias("pct_missing_weight"),
        F.min(F.length(there)).alias("min_length"),
        F.max(F.length(there)).alias("max_length"),
        F.countDistinct(F.when(has_non_digit(there), there)).alias("n_non_digit"),
    )


def pair_shape(df: DataFrame, columns: list[str], weight: str) -> DataFrame:
    """For each two columns: do values pair 1:1, one to many, many to one or many to many, in rows' pairs and weight."""
    parts = []
    for i, a in enumerate(columns):
        for b in columns[i + 1 :]:
            parts.append(F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.col(a).cast("string").alias("va"), F.col(b).cast("string").alias("vb")))
    long = df.select(weight, F.explode(F.array(*parts)).alias("p")).select(weight, "p.*").where("va is not null and vb is not null")
    pairs = long.groupBy("col_a", "col_b", "va", "vb").agg(F.sum(weight).alias("w"))
    na = F.count("*").over(Window.partitionBy("col_a", "col_b", "va"))
    nb = F.count("*").over(Window.partitionBy("col_a", "col_b", "vb"))
    shape = F.when((F.col("na") == 1) & (F.col("nb") == 1), "1:1").when(F.col("nb") == 1, "one-many").when(F.col("na") == 1, "many-one").otherwise("many:many")
    told = pairs.withColumns({"na": na, "nb": nb}).withColumn("shape", shape)
    return told.groupBy("col_a", "col_b", "shape").agg(F.count("*").alias("pairs"), F.sum("w").alias("weight"))


def label_frequency(df: DataFrame, columns: list[str], weight: str, k: int = 40) -> DataFrame:
    """The k heaviest values of each column, with their share of its weight."""
    cells = long_form(df, columns, [], weight).groupBy("column_name", "value").agg(F.sum(weight).alias("weight"), F.count("*").alias("n"))
    share = F.round(100.0 * F.col("weight").cast("double") / F.sum("weight").over(Window.partitionBy("column_name")).cast("double"), 2)
    rank = F.row_number().over(Window.partitionBy("column_name").orderBy(F.desc("weight"), F.col("value").asc_nulls_last()))
    return cells.withColumns({"pct": share, "rank": rank}).where(F.col("rank") <= k)


def duplicates(df: DataFrame, cell: list[str], ident: str, name: str) -> DataFrame:
    """How often: exact rows, cells on several rows, ids under several names, names under several ids."""
    exact = df.groupBy(*df.columns).count().where("count > 1").agg(F.lit("exact rows").alias("kind"), F.count("*").alias("groups"), F.coalesce(F.sum("count"), F.lit(0)).alias("rows"))
    cells = df.groupBy(*cell).count().where("count > 1").agg(F.lit("cell on 2+ rows").alias("kind"), F.count("*").alias("groups"), F.coalesce(F.sum("count"), F.lit(0)).alias("rows"))

    def several(key: str, other: str, kind: str) -> DataFrame:
        g = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.countDistinct(other).alias("n"), F.count("*").alias("rows")).where("n > 1")
        return g.agg(F.lit(kind).alias("kind"), F.count("*").alias("groups"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"))

    return exact.unionByName(cells).unionByName(several(ident, name, "id on 2+ names")).unionByName(several(name, ident, "name on 2+ ids"))


def code_spread(df: DataFrame, code: str, others: list[str]) -> DataFrame:
    """How many codes have one value, 2 to 5, or more, of each other column."""
    counts = df.where(F.col(code).isNotNull()).groupBy(code).agg(*(F.countDistinct(c).alias(c) for c in others))
    long = counts.unpivot([code], others, "over", "n")
    bucket = F.when(F.col("n") <= 1, "1").when(F.col("n") <= 5, "2-5").otherwise("6+")
    return long.groupBy("over", bucket.alias("bucket")).agg(F.count("*").alias("codes"))


def crosswalk_proof(raw: DataFrame, walk: DataFrame, keys: list[str], output: list[str]) -> DataFrame:
    """A crosswalk's defects: raw keys it lacks, keys it has that no row does, and keys on several outputs."""
    r, w = raw.select(*keys).distinct(), walk.select(*keys).distinct()
    several = walk.groupBy(*keys).agg(F.countDistinct(F.struct(*output)).alias("n")).where("n > 1")
    rows = [("raw key not in crosswalk", r.join(w, keys, "left_anti")), ("crosswalk key not in raw", w.join(r, keys, "left_anti")), ("key on 2+ outputs", several)]
    out = None
    for name, df in rows:
        one = df.agg(F.lit(name).alias("defect"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


def schema_rows(spark, frames: dict[str, DataFrame]) -> DataFrame:
    """An information schema: table_name, ordinal_position, column_name, data_type."""
    rows = [(t, i + 1, f.name, f.dataType.simpleString()) for t, df in frames.items() for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "table_name string, ordinal_position int, column_name string, data_type string")


def schema_lines(rows: DataFrame) -> DataFrame:
    """One line per table."""
    one = F.concat_ws(" ", "column_name", "data_type")
    in_order = F.array_sort(F.collect_list(F.struct("ordinal_position", one.alias("c"))))
    return rows.groupBy("table_name").agg(F.array_join(F.transform(in_order, lambda s: s["c"]), ", ").alias("line"), F.count("*").alias("n_columns"))


def schema_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Columns that one schema lacks or types differently."""
    left = a.select("column_name", F.col("data_type").alias("type_a"))
    return left.join(b.select("column_name", F.col("data_type").alias("type_b")), "column_name", "full").where(~F.col("type_a").eqNullSafe(F.col("type_b")))


def unfilled(df: DataFrame) -> DataFrame:
    """Columns that no row fills."""
    counts = df.agg(*(F.count(c).alias(c) for c in df.columns))
    return counts.unpivot([], df.columns, "column_name", "n").where("n = 0").select("column_name")


def set_sizes(df: DataFrame, cell: list[str], member: str, size: str = "size", cells: str = "cells") -> DataFrame:
    """How many cells have so many distinct members."""
    per = df.groupBy(*cell).agg(F.countDistinct(member).cast("int").alias(size))
    return per.groupBy(size).agg(F.count("*").alias(cells))


def report(df: DataFrame, order: list, place: str) -> DataFrame:
    """A report's rows with their place in its order. A report is small: it is what a reader is shown."""
    return df.withColumn(place, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))
