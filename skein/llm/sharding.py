"""Contiguous shards of near-equal bytes, by global prefix sums from partition totals.

Rows are ordered by text hash, so equal texts lie together. The order is cut in ranges of the
hash, whose number grows with the rows; their totals, a row a range, give each range its global
offset, and prefix sums within a range the rest. A group of equal texts is first counted in
salted parts, so a text that a third of all rows repeat is spread over many of them. Prefix sums
of rows, taken along with those of bytes, number the rows of the shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import octets, stored, table

PER_RANGE = 50_000
BITS = 20


def shards(docs: DataFrame, n: int = 24, overhead: int = 8) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for each row of ``docs``.

    A row weighs its text's UTF-8 bytes (null: none) plus ``overhead``. Shard k of n takes the
    rows whose middle lies in the k-th n-th of all bytes; a group of equal texts that weighs no
    more than the heaviest row, or a hundredth of a shard, goes with its middle and stays
    whole. ``slot`` numbers the rows of a shard from 0 without gaps, in the same order. A null
    text and an empty one are equal texts. Rows that repeat each count; null ids come first
    among equal texts. Fewer rows than shards leave shards empty; an empty table gives an
    empty result. Other columns, of whatever name, are not looked at.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select(
        "doc_id",
        (octets(F.col("text")) + overhead).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("h"),
    )
    rows = stored(slim)
    whole = rows.agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"), F.max("size").alias("most")).first()
    all_bytes = max(1, whole["bytes"] or 0)
    together = max(all_bytes // (100 * n), whole["most"] or 0)
    bits = min(BITS, max(3, (whole["rows"] // PER_RANGE).bit_length()))  # of the number of ranges, and of salts
    group = ["h", "text_crc32", "size"]
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(8 << bits)).cast("int").alias("salt")
    rows = rows.select("doc_id", *group, salt)
    span = F.shiftrightunsigned(F.col("h"), 64 - bits).cast("int").alias("span")
    parts = rows.groupBy(*group, "salt").agg(F.count("*").alias("n")).select("*", span)
    parts = stored(parts.withColumn("weight", F.col("n") * F.col("size")))
    # A row for each range: at most 2 ** BITS of them, so one task takes their sums.
    before = Window.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    offsets = parts.groupBy("span").agg(F.sum("weight").alias("b"), F.sum("n").alias("r"))
    offsets = offsets.select(
        "span", F.coalesce(F.sum("b").over(before), zero).alias("byte_base"), F.coalesce(F.sum("r").over(before), zero).alias("row_base")
    )
    order = Window.partitionBy("span").orderBy(*group, "salt").rowsBetween(Window.unboundedPreceding, -1)
    equal = Window.partitionBy("span", *group)
    placed = (
        parts.withColumn("bytes_before", F.coalesce(F.sum("weight").over(order), zero))
        .withColumn("rows_before", F.coalesce(F.sum("n").over(order), zero))
        .withColumn("first", F.min("bytes_before").over(equal))
        .withColumn("group_bytes", F.sum("weight").over(equal))
        .join(offsets, "span")
        .select(
            *group, "salt", "group_bytes",
            (F.col("byte_base") + F.col("bytes_before")).alias("start"),
            (F.col("byte_base") + F.col("first")).alias("group_start"),
            (F.col("row_base") + F.col("rows_before")).alias("row_start"),
        )
    )
    rank = Window.partitionBy(*group, "salt").orderBy("doc_id")
    ranked = rows.withColumn("k", F.row_number().over(rank) - 1).join(placed, [*group, "salt"])
    own = F.col("start") + F.col("k") * F.col("size") + F.expr("size div 2")
    middle = F.when(F.col("group_bytes") <= together, F.col("group_start") + F.expr("group_bytes div 2")).otherwise(own)
    shard = F.least(F.lit(n - 1), F.floor(middle * n / all_bytes)).cast("int").alias("shard")
    # Shards are contiguous in the order, so a row's slot is its number less its shard's first.
    numbered = stored(ranked.select("doc_id", "size", "text_crc32", shard, (F.col("row_start") + F.col("k")).alias("number")))
    firsts = numbered.groupBy("shard").agg(F.min("number").alias("base"))  # a row for each of n shards
    slot = (F.col("number") - F.col("base")).cast("long").alias("slot")
    return numbered.join(F.broadcast(firsts), "shard").select("doc_id", "size", "text_crc32", "shard", slot)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
