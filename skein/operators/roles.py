"""Roles of tables in a schema: reference, entity and detail tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .rounds import settled


def key_columns(foreign_keys: DataFrame) -> DataFrame:
    """(table_name, fk_columns): key columns, counted once for each key that has them."""
    n = foreign_keys.groupBy(F.col("constrained_table").alias("table_name"))
    return n.agg(F.sum(F.size("constrained_columns")).cast("long").alias("fk_columns"))


def reference_tables(tables: DataFrame, foreign_keys: DataFrame, ratio: float = 0.5) -> DataFrame:
    """(table_name): several columns, several of them in keys, and these at least ``ratio``."""
    joined = tables.join(key_columns(foreign_keys), "table_name")
    rule = (F.col("column_count") > 1) & (F.col("fk_columns") > 1) & (F.col("fk_columns") / F.col("column_count") >= ratio)
    return joined.where(rule).select("table_name")


def reference_groups(references: DataFrame, foreign_keys: DataFrame) -> DataFrame:
    """(signature, tables): reference tables that have the same keys, two or more."""
    one = F.concat("referred_table", F.lit("("), F.array_join(F.array_sort("constrained_columns"), ","), F.lit(")"))
    keys = foreign_keys.join(references, foreign_keys.constrained_table == references.table_name)
    signed = keys.groupBy("table_name").agg(F.array_join(F.array_sort(F.collect_list(one)), ";").alias("signature"))
    grouped = signed.groupBy("signature").agg(F.array_join(F.array_sort(F.collect_list("table_name")), ",").alias("tables"), F.count("*").alias("n"))
    return grouped.where("n > 1").select("signature", "tables")


def entity_tables(ranked: DataFrame, references: DataFrame, neighbours: DataFrame) -> DataFrame:
    """(table_name): taken greedily by position, each removing its neighbours; reference tables
    and those without a neighbour are never taken.

    The greedy order is a matter of neighbours alone: a round takes every table that comes before
    all its neighbours that are left, and removes theirs. Rounds are joins, as many as the longest
    chain of tables that wait for each other; ties of a position go by name.
    """
    free = ranked.join(references, "table_name", "left_anti").join(neighbours.select("table_name").distinct(), "table_name", "left_semi")
    left = settled(free.select("table_name", "position"))
    other = left.select(F.col("table_name").alias("neighbour"))
    pairs = neighbours.where("table_name <> neighbour").select("table_name", "neighbour").distinct()
    pairs = settled(pairs.join(left, "table_name", "left_semi").join(other, "neighbour", "left_semi").select("table_name", "neighbour"))
    taken = left.select("table_name").where("false")
    while left.limit(1).count():
        at = left.select(F.col("table_name").alias("neighbour"), F.struct("position", F.col("table_name").alias("name")).alias("at"))
        least = pairs.join(at, "neighbour").groupBy("table_name").agg(F.min("at").alias("least"))
        first = F.coalesce(F.struct("position", F.col("table_name").alias("name")) < F.col("least"), F.lit(True))
        now = settled(left.join(least, "table_name", "left").select("table_name", "position", first.alias("first")))
        new = now.where("first").select("table_name")
        taken = taken.union(new)
        removed = pairs.join(new, "table_name").select(F.col("neighbour").alias("table_name")).distinct()
        left = settled(now.where("NOT first").join(removed, "table_name", "left_anti").select("table_name", "position"))
    return taken


def detail_tables(entities: DataFrame, references: DataFrame, foreign_keys: DataFrame, primary: DataFrame) -> DataFrame:
    """(entity, detail): tables whose keys all refer to the entity, by columns of its primary
    key, and that are neither entities nor reference tables. ``primary``: (table_name, pk)."""
    keyed = foreign_keys.join(primary, F.col("referred_table") == F.col("table_name")).withColumn(
        "ok", F.size(F.array_except("referred_columns", "pk")) == 0
    )
    one = keyed.groupBy(F.col("constrained_table").alias("detail")).agg(
        F.min("referred_table").alias("entity"), F.count_distinct("referred_table").alias("n"), F.bool_and("ok").alias("ok")
    )
    found = one.where("n = 1 AND ok AND detail <> entity").join(entities.select(F.col("table_name").alias("entity")), "entity", "left_semi")
    for taken in (entities, references):
        found = found.join(taken.select(F.col("table_name").alias("detail")), "detail", "left_anti")
    return found.select("entity", "detail")


def reference_pairs(references: DataFrame, foreign_keys: DataFrame, sims: DataFrame) -> DataFrame:
    """(reference, target): each reference table with the most similar table it refers to."""
    keys = foreign_keys.join(references, foreign_keys.constrained_table == references.table_name)
    pairs = keys.select(F.col("constrained_table").alias("a"), F.col("referred_table").alias("b")).distinct()
    best = Window.partitionBy("a").orderBy(F.round("sim", 9).desc(), "b")
    ranked = pairs.join(sims, ["a", "b"]).withColumn("r", F.row_number().over(best)).where("r = 1")
    return ranked.select(F.col("a").alias("reference"), F.col("b").alias("target"))


def entity_pairs(entities: DataFrame, neighbours: DataFrame, sims: DataFrame, times: int = 5) -> DataFrame:
    """(entity, neighbour, copy): each entity with its most similar neighbour, ``times`` times."""
    best = Window.partitionBy("a").orderBy(F.round("sim", 9).desc(), "b")
    near = neighbours.select(F.col("table_name").alias("a"), F.col("neighbour").alias("b")).join(entities.select(F.col("table_name").alias("a")), "a", "left_semi")
    ranked = near.join(sims, ["a", "b"]).withColumn("r", F.row_number().over(best)).where("r = 1")
    return ranked.select(F.col("a").alias("entity"), F.col("b").alias("neighbour"), F.explode(F.sequence(F.lit(1), F.lit(times))).alias("copy"))
