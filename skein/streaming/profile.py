"""An extension: column profiles kept up to date as files arrive in a table's folder.

Value counts are a stateful streaming aggregation; each trigger replaces a small table of
entropies, which the batch operators read like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.profile import unpivoted


def arriving(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """Rows of Parquet files as they come to ``folder``."""
    return spark.readStream.schema(schema).parquet(folder)


def value_counts(rows: DataFrame, table: str) -> DataFrame:
    """(table_name, column_name, value, n) of a batch or a stream, nulls left out."""
    return unpivoted(rows, table).where("value IS NOT NULL").groupBy("table_name", "column_name", "value").agg(F.count("*").alias("n"))


def entropies(counts: DataFrame) -> DataFrame:
    """(table_name, column_name, rows, entropy) in bits from value counts."""
    n = F.sum("n")
    h = F.log2(n.cast("double")) - F.sum(F.col("n") * F.log2(F.col("n").cast("double"))) / n
    return counts.groupBy("table_name", "column_name").agg(n.alias("rows"), F.greatest(h, F.lit(0.0)).alias("entropy"))


def keep_profile(rows: DataFrame, table: str, out: str, checkpoint: str) -> StreamingQuery:
    """Starts a query that writes the entropies of all rows so far to ``out`` at each trigger."""

    def replace(counts: DataFrame, _: int) -> None:
        entropies(counts).coalesce(1).write.mode("overwrite").parquet(out)

    stream = value_counts(rows, table).writeStream.outputMode("complete").option("checkpointLocation", checkpoint)
    return stream.foreachBatch(replace).start()
