"""Table importance: a random walk along foreign keys, weighted by column entropies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rounds import iterated, settled


def selectivity(entropy: DataFrame, information: DataFrame, keys: DataFrame, exact: bool = True) -> DataFrame:
    """(table_name, column_name, pr, q) of each key column.

    ``exact``: H(A) / (H(T) + sum over all columns a of (q-1) H(a)), where q is the number of
    keys that contain A. Otherwise H(A) / (q H(T)), which keeps a table's sum at 1 at most.
    """
    used = keys.select("table_name", "column_name").groupBy("table_name", "column_name").agg(F.count("*").alias("q"))
    columns = entropy.groupBy("table_name").agg(F.sum("entropy").alias("columns_h"))
    joined = used.join(entropy, ["table_name", "column_name"]).join(information, "table_name").join(columns, "table_name")
    whole = F.col("information") + (F.col("q") - 1) * F.col("columns_h") if exact else F.col("q") * F.col("information")
    return joined.select("table_name", "column_name", F.coalesce(F.try_divide("entropy", whole), F.lit(0.0)).alias("pr"), "q")


def key_ends(foreign_keys: DataFrame, both: bool) -> DataFrame:
    """(table_name, column_name, other) by the first column pair of each key; ``both``: from
    either end. Keys of a table to itself are left out."""
    ends = foreign_keys.where("constrained_table <> referred_table").select(
        F.col("constrained_table").alias("table_name"), F.get("constrained_columns", F.lit(0)).alias("column_name"), F.col("referred_table").alias("other"),
        F.col("referred_table").alias("back_table"), F.get("referred_columns", F.lit(0)).alias("back_column"),
    )
    out = ends.select("table_name", "column_name", "other")
    if both:
        out = out.unionByName(ends.select(F.col("back_table").alias("table_name"), F.col("back_column").alias("column_name"), F.col("table_name").alias("other")))
    return out


def transition_matrix(tables: DataFrame, entropy: DataFrame, information: DataFrame, foreign_keys: DataFrame, both: bool = True) -> DataFrame:
    """(src, dst, p) in long form: key steps, and what is left as the step to itself."""
    ends = key_ends(foreign_keys, both)
    pr = selectivity(entropy, information, ends, exact=not both)
    steps = ends.join(pr, ["table_name", "column_name"]).groupBy(F.col("table_name").alias("src"), F.col("other").alias("dst")).agg(F.sum("pr").alias("p"))
    away = steps.groupBy("src").agg(F.sum("p").alias("away"))
    stay = tables.select(F.col("table_name").alias("src")).join(away, "src", "left")
    stay = stay.select("src", F.col("src").alias("dst"), (1 - F.coalesce("away", F.lit(0.0))).alias("p"))
    return steps.unionByName(stay)


def stationary(matrix: DataFrame, iterations: int = 50, tolerance: float | None = None) -> DataFrame:
    """(table_name, share) after a number of steps of the walk from a uniform start, or, with a
    tolerance, once no share changes by more.

    A step joins the shares to the matrix, which has a row for each pair of joined tables and
    one for each table itself, and adds them up by destination.
    """
    matrix = settled(matrix.select("src", "dst", "p"))
    names = settled(matrix.select(F.col("src").alias("table_name")).distinct())
    n = max(1, names.count())

    def step(now: DataFrame, _: int) -> DataFrame:
        flow = matrix.join(now.withColumnRenamed("table_name", "src"), "src")
        return flow.groupBy(F.col("dst").alias("table_name")).agg(F.sum(F.col("share") * F.col("p")).alias("share"))

    return iterated(names.withColumn("share", F.lit(1 / n)), step, iterations, "table_name", "share", tolerance)
