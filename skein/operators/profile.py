"""Profiles of table contents: value samples, entropies, information content."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.catalog import Catalog

SALTS = 64


def _scalars(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if f.dataType.typeName() not in ("array", "map", "struct", "binary")]


def unpivoted(df: DataFrame, table: str) -> DataFrame:
    """(table_name, column_name, value) of every scalar column, values as text; one scan."""
    cells = F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("value"))
        for c in _scalars(df)
    ])
    return df.select(F.lit(table).alias("table_name"), F.explode(cells).alias("c")).select("table_name", "c.*")


#: Types of which a 64-bit hash is one to one.
NARROW = ("boolean", "byte", "short", "integer", "long", "float", "double", "date", "timestamp", "timestamp_ntz")


def _hashed(df: DataFrame, codes: dict[str, int]) -> DataFrame:
    """(code, a, b) of every value of the columns in ``codes``: its hash, of 64 bits where that
    tells all values apart, else of 128. Nulls are left out."""

    def cell(name: str, code: int) -> Column:
        value = F.col(f"`{name}`")
        b = F.lit(0).cast("long") if df.schema[name].dataType.typeName() in NARROW else F.xxhash64(F.lit(1), value)
        return F.struct(F.lit(code).alias("code"), F.when(value.isNotNull(), F.xxhash64(value)).alias("a"), b.alias("b"))

    return df.select(F.explode(F.array(*[cell(*x) for x in codes.items()])).alias("c")).select("c.*").where("a IS NOT NULL")


def _entropies(tables: list[tuple[DataFrame, str]]) -> DataFrame:
    """Shannon entropy in bits of each column's values; nulls are left out. Values are counted by
    their hashes, rows of a fixed size, in one shuffle after partial counts."""
    names = [(t, c) for df, t in tables for c in _scalars(df)]
    if not names:
        return tables[0][0].sparkSession.createDataFrame([], "table_name string, column_name string, entropy double")
    code = {n: k for k, n in enumerate(names)}
    cells = [_hashed(df, {c: code[t, c] for c in _scalars(df)}) for df, t in tables if _scalars(df)]
    counts = reduce(DataFrame.unionByName, cells).groupBy("code", "a", "b").count()
    # -sum(p log p) = log n - sum(c log c) / n
    h = F.log2(F.sum("count").cast("double")) - F.sum(F.col("count") * F.log2(F.col("count").cast("double"))) / F.sum("count")
    name = F.get(F.array(*[F.struct(F.lit(t).alias("table_name"), F.lit(c).alias("column_name")) for t, c in names]), F.col("code"))
    each = counts.groupBy("code").agg(F.greatest(h, F.lit(0.0)).alias("entropy"))
    return each.select(name.alias("n"), "entropy").select("n.*", "entropy")


def column_entropy(df: DataFrame, table: str) -> DataFrame:
    """(table_name, column_name, entropy) of one table's columns."""
    return _entropies([(df, table)])


def entropies(catalog: Catalog, tables: list[str]) -> DataFrame:
    """``column_entropy`` of all tables: their cells are put together first, so they share one
    shuffle."""
    return _entropies([(catalog.scan(t), t) for t in tables])


def information_content(entropy: DataFrame, row_counts: DataFrame) -> DataFrame:
    """Sum of a table's column entropies and the entropy of its row identity, log2(rows)."""
    sums = entropy.groupBy("table_name").agg(F.sum("entropy").alias("h"))
    rows = F.when(F.col("row_count") > 0, F.log2(F.col("row_count").cast("double")))
    joined = row_counts.join(sums, "table_name", "left")
    return joined.select("table_name", (F.coalesce("h", F.lit(0.0)) + F.coalesce(rows, F.lit(0.0))).alias("information"))


def value_samples(catalog: Catalog, tables: list[str], n: int = 20) -> DataFrame:
    """(table_name, column_name, values): each column's first ``n`` distinct values in order; a
    null is a member and comes first."""
    cells = reduce(DataFrame.unionByName, [unpivoted(catalog.scan(t), t) for t in tables]).distinct()
    # First within salts, then among these: no task sorts all values of a column, none collects more than n.
    cells = cells.withColumn("salt", F.pmod(F.hash("value"), F.lit(SALTS)))
    order = (F.col("value").isNotNull(), F.col("value"))
    few = cells.withColumn("r", F.row_number().over(Window.partitionBy("table_name", "column_name", "salt").orderBy(*order))).where(F.col("r") <= n)
    few = few.withColumn("r", F.row_number().over(Window.partitionBy("table_name", "column_name").orderBy(*order))).where(F.col("r") <= n)
    grouped = few.groupBy("table_name", "column_name").agg(F.array_sort(F.collect_list(F.struct("r", "value"))).alias("s"))
    return grouped.select("table_name", "column_name", F.transform("s", lambda x: F.coalesce(x["value"], F.lit("\0null"))).alias("values"))
