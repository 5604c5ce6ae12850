"""What several operators share: reading tables, cutting lineage, scalars."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: White space as the contracts define it: space, tab, \n, \v, \f, \r. Fixed value.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
WORD_CLASS = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shared(spark: SparkSession) -> str:
    """The checkpoint folder: ``spark.checkpoint.dir``. Only a local master may fall back to a
    temporary folder, since there driver and executors are one process."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir", None)
        if shared is None and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or os.path.join(tempfile.gettempdir(), "skein-checkpoints"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and forget its lineage. For slim results: the
    files are uncompressed, and Spark removes them only if the session was started with
    ``spark.cleaner.referenceTracking.cleanCheckpoints``."""
    _shared(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """As ``cut``, for larger results: a compressed Parquet table in the shared folder. It is
    removed by ``dropped``, or when the driver ends with its session still running."""
    spark = df.sparkSession
    path = f"{_shared(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path, compression="zstd")
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Remove the table behind a result of ``stored``, once nothing reads it any more."""
    for file in df.inputFiles()[:1]:
        folder = file.rsplit("/", 1)[0]
        if folder.rsplit("/", 1)[-1].startswith("table-"):
            _remove(df.sparkSession, folder)


def _remove(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    if sc._jsc is not None and not sc._jsc.sc().isStopped():
        place = sc._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(sc._jsc.hadoopConfiguration()).delete(place, True)


#: A key is hot if it has more than this many rows and more than one in ``MANY`` of all rows, so
#: there are fewer than ``MANY`` hot keys and their list may be broadcast at any scale.
HOT = 200
MANY = 1000
SALTS = 32


def salted_join(many: DataFrame, one: DataFrame, key: list[str], sizes: DataFrame, size: str, total: int, spread: Column) -> DataFrame:
    """Inner join of ``many`` to ``one``, which has a row a key (no nulls). ``sizes``, best a
    materialised frame, has each key's number of rows in ``many`` in ``size``; ``total`` is their
    sum. The rows of a hot key are dealt by ``spread`` (an integer) over several tasks, each with
    its copy of the row of ``one``; without hot keys it is a plain join. ``one`` is never sent to
    every executor, as it would pass through the driver."""
    hot = sizes.where(F.col(size) > max(HOT, total // MANY)).select(*key, F.lit(1).alias("_hot"))
    if not hot.limit(1).count():
        return many.join(one.hint("merge"), key)
    hot = F.broadcast(hot)
    salt = F.when(F.col("_hot").isNull(), 0).otherwise(F.pmod(spread, F.lit(SALTS))).cast("int").alias("_salt")
    salts = F.when(F.col("_hot").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    left = many.join(hot, key, "left").select(*many.columns, salt)
    right = one.join(hot, key, "left").select(*one.columns, F.explode(salts).alias("_salt"))
    return left.join(right.hint("merge"), [*key, "_salt"]).drop("_salt")


def packed(df: DataFrame, *columns: Column) -> DataFrame:
    """The whole row as one struct ``_row`` beside ``columns``, so that no column of the table
    can clash with those an operator makes; ``unpacked`` takes it apart again."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), *columns)


def unpacked(columns: list[str], **new: Column) -> list[Column]:
    """The columns of a packed row, those in ``new`` replaced in place or put at the end."""
    kept = [new.get(c, F.col("_row").getField(c)).alias(c) for c in columns]
    return kept + [v.alias(c) for c, v in new.items() if c not in columns]


def partitions(df: DataFrame, most: int = 20_000) -> int:
    """Shuffle partitions of the session, which a cluster sizes to its data."""
    return min(most, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def word_count(text: Column) -> Column:
    """Number of words in a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_CLASS)), F.lit(0)).cast("long")


def octets(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def arrow_batches(
    df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType
) -> DataFrame:
    """``mapInArrow`` on rows that hold whole texts: the session's batch size is lowered to 1000
    rows (unless it was set), as a batch exists in several copies on either side. What a task's
    batches took is given back at its end, as idle workers stay and count for their executor."""
    conf = df.sparkSession.conf
    if conf.get(BATCH) == "10000":
        conf.set(BATCH, "1000")

    def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(released, schema)


def arrow_map(
    df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str
) -> DataFrame:
    """``f`` on each Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := f(batch)) is not None:
                yield out

    return arrow_batches(df, run, schema)
