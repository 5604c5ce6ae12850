"""Mixing sources to target weights, in words, with DataFrame operations only.

The words of a source are one stream, packed into blocks of fixed length. The mix has a quota
of block slots for each source; every slot draws its output shard, so a shard's source counts
are multinomial while each source's total is its quota. The slots of a source, numbered
through the shards, go through a pseudorandom permutation of its block indices (a
swap-or-not network, keyed by source), and blocks are joined to slots by index.

Streams are cut in hash buckets, so that a source with a third of all rows is spread out:
prefix sums run within a bucket and over the few bucket totals of a source.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, cut, packed, partitions, salted_join, stored, table, unpacked, word_count

CHUNK = 4096


@dataclass(frozen=True)
class Mix:
    """``weights`` go to the sources in code point order (null last), repeating; the mix has
    ``share`` times all words; no source gives more than ``cap`` times its size."""

    weights: tuple[int, ...] = (5, 2, 1)
    share: float = 1.5
    cap: int = 2
    block: int = 64
    buckets: int = 1024
    shards: int = 1024
    rounds: int = 16
    seed: int = 7


def _key(source: Column) -> Column:
    return F.when(source.isNull(), "n").otherwise(F.concat(F.lit("s"), source.cast("string")))


def _hash() -> Column:
    return F.xxhash64("doc_id", "text", "source")


def _sized(docs: DataFrame, mix: Mix) -> DataFrame:
    """(doc_id, hash, source, key, bucket, size) of every row."""
    h = _hash()
    return docs.select(
        "doc_id",
        h.alias("hash"),
        "source",
        _key(F.col("source")).alias("key"),
        F.pmod(h, F.lit(mix.buckets)).cast("int").alias("bucket"),
        word_count(F.col("text")).alias("size"),
    )


def plan(sized: DataFrame, mix: Mix) -> DataFrame:
    """One row per source: key, ord, source_size, target, n_blocks, quota.

    Targets fill up evenly: with capped sources taken in the order of cap / weight, the level
    at which the rest share what is left is the first that no further cap lies below.
    """
    sources = sized.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), "source")
    every = Window.partitionBy()
    cycle = F.array(*map(F.lit, mix.weights))
    w = sources.withColumn("ord", F.row_number().over(order) - 1).withColumn(
        "weight", F.element_at(cycle, (F.col("ord") % len(mix.weights) + 1).cast("int")).cast("double")
    )
    w = w.withColumn("limit", F.col("source_size") * float(mix.cap)).withColumn(
        "full_at", F.col("limit") / F.col("weight")
    )
    by_level = Window.orderBy("full_at", "ord").rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumn("_all", F.sum("source_size").over(every) * mix.share).withColumn(
        "level",
        F.try_divide(
            F.col("_all") - F.coalesce(F.sum("limit").over(by_level), F.lit(0.0)),
            F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(by_level), F.lit(0.0)),
        ),
    )
    level = F.min(F.when(F.col("full_at") >= F.col("level"), F.struct("full_at", "ord", "level"))).over(every)
    w = w.withColumn("level", level["level"])
    target = F.least("limit", F.coalesce(F.col("level") * F.col("weight"), F.col("limit")))
    blocks = F.ceil(F.col("source_size") / mix.block).cast("long")
    quota = F.least(
        F.col("n_blocks") * mix.cap,
        F.round(F.coalesce(F.try_divide(F.col("target") * F.col("n_blocks"), "source_size"), F.lit(0.0))).cast("long"),
    )
    w = w.withColumn("target", target).withColumn("n_blocks", blocks).withColumn("quota", quota)
    return w.select("key", "ord", "source_size", "target", "n_blocks", "quota")


def placed(sized: DataFrame, planned: DataFrame, mix: Mix) -> DataFrame:
    """``sized`` with its source's plan and ``start``, the place of its first word in the
    source's stream (ordered by bucket, doc_id, hash)."""
    totals = sized.groupBy("key", "bucket").agg(F.sum("size").alias("n"))
    over = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.withColumn("base", F.coalesce(F.sum("n").over(over), F.lit(0))).join(planned, "key").drop("n")
    within = (
        Window.partitionBy("key", "bucket").orderBy("doc_id", "hash").rowsBetween(Window.unboundedPreceding, -1)
    )
    rows = sized.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0)))
    return rows.join(bases, ["key", "bucket"]).withColumn("start", F.col("base") + F.col("before")).drop("base", "before")


def permuted(x: Column, n: Column, key: Column, mix: Mix) -> Column:
    """The place of index ``x`` in a pseudorandom permutation of 0 to n-1."""
    seed = F.lit(mix.seed)

    def swap(at: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(seed, key, r), n) - at, n)
        coin = F.xxhash64(seed, key, r, F.greatest(at, other)).bitwiseAND(F.lit(1))
        return F.when(coin == 1, other).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(mix.rounds)), x, swap)


def _counted(df: DataFrame, first: str, count: str, name: str) -> DataFrame:
    """A row for each of ``count`` numbers from ``first`` on, by chunks of bounded size."""
    chunks = df.where(f"{count} > 0").withColumn(
        "_c", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"({count} - 1) div {CHUNK}")))
    )
    lo = F.col("_c") * CHUNK
    hi = F.least(lo + CHUNK, F.col(count)) - 1
    return chunks.withColumn(name, F.explode(F.sequence(lo + F.col(first), hi + F.col(first)))).drop("_c")


def slots(planned: DataFrame, mix: Mix) -> DataFrame:
    """(key, shard, slot, block): what each slot of each output shard takes."""
    parts = planned.where("quota > 0").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(mix.buckets - 1))))
    lo = F.expr(f"quota * part div {mix.buckets}")
    hi = F.expr(f"quota * (part + 1) div {mix.buckets}")
    parts = parts.select("key", lo.alias("lo"), (hi - lo).alias("n")).repartition(partitions(planned), "key", "lo")
    draw = F.pmod(F.xxhash64(F.lit(mix.seed), F.lit("shard"), "key", "r"), F.lit(mix.shards)).cast("int")
    counts = _counted(parts, "lo", "n", "r").groupBy("key", draw.alias("shard")).agg(F.count("*").alias("c"))
    through = Window.partitionBy("key").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("base", F.coalesce(F.sum("c").over(through), F.lit(0)))
    counts = counts.join(planned.select("key", "n_blocks"), "key").repartition(partitions(planned), "key", "shard")
    ranked = _counted(counts, "base", "c", "r")
    block = permuted(F.pmod("r", "n_blocks"), F.col("n_blocks"), F.col("key"), mix)
    return ranked.select("key", "shard", (F.col("r") - F.col("base")).alias("slot"), block.alias("block"))


def pieces(rows: DataFrame, mix: Mix) -> DataFrame:
    """A row for each part of a document that lies in one block: ``block``, ``at`` (its first
    word in the document), ``words``."""
    first = F.expr(f"start div {mix.block}")
    last = F.expr(f"(start + size - 1) div {mix.block}")
    b = rows.where("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
    at = F.greatest(F.col("block") * mix.block - F.col("start"), F.lit(0))
    end = F.least((F.col("block") + 1) * mix.block - F.col("start"), F.col("size"))
    return b.withColumn("at", at).withColumn("words", end - at)


ROW = ["key", "bucket", "doc_id", "hash", "start", "size"]


def _taken(docs: DataFrame, mix: Mix) -> tuple[DataFrame, DataFrame]:
    """Placed rows, and their pieces with ``times``, how often the mix takes each."""
    sized = cut(_sized(docs, mix))
    planned = cut(plan(sized, mix))
    rows = placed(sized, planned, mix)
    times = slots(planned, mix).groupBy("key", "block").agg(F.count("*").alias("times"))
    return rows, pieces(rows, mix).join(times, ["key", "block"])


def mixed_sizes(docs: DataFrame, mix: Mix | None = None) -> DataFrame:
    """(doc_id, size, source_size, target, taken), a row for each row of ``docs``.

    A null text has no words, a null source is a source of its own. Rows without words are
    taken 0 times. Sources without words have the target 0. Rows that repeat an id and a text
    each count. An empty table gives an empty result. No row is taken more than ``cap`` times.
    """
    mix = mix or Mix()
    rows, parts = _taken(docs, mix)
    per_row = parts.select(
        *ROW, "source_size", "target", (F.col("words") * F.col("times")).alias("taken")
    )
    nothing = rows.select(*ROW, "source_size", "target", F.lit(0).cast("long").alias("taken"))
    copies = nothing.groupBy(*ROW, "source_size", "target").agg(F.count("*").alias("copies"))
    sums = (
        per_row.withColumn("copies", F.lit(0).cast("long"))
        .unionByName(copies.withColumn("taken", F.lit(0).cast("long")))
        .groupBy(*ROW, "source_size", "target")
        .agg(F.sum("taken").alias("taken"), F.sum("copies").alias("copies"))
    )
    each = sums.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return each.select("doc_id", "size", "source_size", "target", F.col("taken").cast("long"))


def mixed(docs: DataFrame, mix: Mix | None = None) -> DataFrame:
    """``docs`` as the mix takes them: a row for the words taken once or more and a row for
    those taken twice, without the words that it leaves out. Whole texts stay as they are,
    others are the taken words joined by spaces. ``n_chars``, if there is one, is set anew.

    A row without words (a null or empty text) isn't taken. A null source is one of its own.
    Rows that repeat an id, a text and a source each have their own words in the stream and are
    taken each by itself, so none comes back more than ``cap`` times; their other columns are
    those of one of them. An empty table gives an empty result. Columns of any name stay.
    """
    mix = mix or Mix()
    rows, parts = _taken(docs, mix)
    piece = F.struct("at", "words", "times")
    # Repeated rows are told apart by their start in the source's stream, and stay apart.
    chosen = parts.groupBy("doc_id", "hash", "start", "size").agg(F.array_sort(F.collect_set(piece)).alias("_pieces"))
    named = F.col("doc_id").isNull().alias("_none"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id")
    key = ["_none", "_id", "_hash"]
    chosen = stored(chosen.select(*named, F.col("hash").alias("_hash"), "start", "size", "_pieces"))
    # One copy of each text, to which every row of its own that is taken is joined.
    one = packed(docs, *named, _hash().alias("_hash"), F.col("text").alias("text")).dropDuplicates(key)
    sizes = chosen.groupBy(*key).agg(F.count("*").alias("n"))
    joined = salted_join(chosen, one, key, sizes, "n", chosen.count(), F.xxhash64("start"))
    joined = joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(mix.cap)))).withColumn(
        "_p", F.filter("_pieces", lambda p: p["times"] >= F.col("_copy"))
    )
    joined = joined.where(F.size("_p") > 0)
    total = F.aggregate("_p", F.lit(0).cast("long"), lambda a, p: a + p["words"])
    words = F.array_remove(F.split("text", SPACE_CLASS), "")
    some = F.array_join(
        F.flatten(F.transform("_p", lambda p: F.slice(F.col("_w"), (p["at"] + 1).cast("int"), p["words"].cast("int")))), " "
    )
    joined = joined.withColumn("_whole", total == F.col("size")).withColumn(
        "_w", F.when(~F.col("_whole"), words)
    )
    # Named twice, so that the words are not split anew for every piece.
    text = F.when(F.col("_whole"), F.col("text")).when(F.size("_w") > 0, some)
    new = {"text": F.col("_new")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("_new").cast("long")
    return joined.withColumn("_new", text).select(*unpacked(docs.columns, **new))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_sizes(table(spark, sf_dir, "documents"))
