"""Exact top-k by inner product: Fagin's threshold algorithm over sorted lists of each dimension.

Candidates lie in blocks. A block has, for each dimension, the list of its rows sorted by their
entry. A query reads all lists from the end that its sign favours, some places at a time; each
row that it meets is scored in full at once. No row further down can score more than the sum of
the query's entries times those at the places reached, so reading ends when that bound is below
the k-th best score: by then every other row of the block is beaten, ties included.

Every query first meets one block, whose k-th score is its floor for all others, so most of what
lies far from it is left early. Queries are dealt in groups, and a task has one block and one
group, each of bounded size. Scores are whole numbers, so no rounding breaks a tie.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, stored, table

#: Vectors become whole numbers. Fixed value.
SCALE = 256
#: Rows of a block and queries of a group, at most about.
BLOCK, GROUP = 8_192, 2_048
FIRST = 16


class Lists:
    """A block's rows and, for each dimension, their order by it."""

    def __init__(self, x: np.ndarray, key: np.ndarray):
        self.x, self.key = x, key
        self.order = np.argsort(x, axis=0, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(x, self.order, axis=0)

    def top(self, q: np.ndarray, own: np.ndarray, k: int, floor: int | None) -> tuple[np.ndarray, np.ndarray, int]:
        """(rows, scores, places read): the ``k`` best rows for ``q`` that aren't ``own``, of
        those that reach ``floor``; ties by ``key``."""
        n = len(self.x)
        used = np.flatnonzero(q)
        seen = own.copy()
        rows, scores = np.zeros(0, np.int64), np.zeros(0, self.x.dtype)
        falling = q[used] > 0
        at, step = 0, FIRST
        while at < n:
            top = np.where(falling, self.sorted[n - 1 - at, used], self.sorted[at, used])
            bound = top @ q[used]
            least = scores[-1] if len(scores) == k else None
            if floor is not None and (least is None or floor > least):
                least = floor
            if least is not None and bound < least:
                break
            upto = min(n, at + step)
            new = np.zeros(n, bool)
            new[self.order[at:upto, used[~falling]]] = True
            new[self.order[n - upto : n - at, used[falling]]] = True
            if not len(used):
                new[:] = True
            met = np.flatnonzero(new & ~seen)
            if len(met):
                seen[met] = True
                got = self.x[met] @ q
                if floor is not None:
                    met, got = met[got >= floor], got[got >= floor]
                rows, scores = np.concatenate([rows, met]), np.concatenate([scores, got])
                best = np.lexsort((self.key[rows], -scores))[:k]
                rows, scores = rows[best], scores[best]
            at, step = upto, step * 2
            if seen.all():
                break
        return rows, scores, at


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _exact(x: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as doubles where every score is exact in them, which multiplies faster, or as
    whole numbers of any size where a score could leave a long."""
    most = int(max(x.max(), -x.min())) * int(max(q.max(), -q.min())) * x.shape[1]
    kind = np.float64 if most < 1 << 53 else np.int64 if most < 1 << 63 else object
    return x.astype(kind), q.astype(kind)


def _searched(rows: DataFrame, asks: DataFrame, k: int) -> DataFrame:
    """(number, query_id, vec_id, score): for each query of ``asks`` (block, part, number,
    query_id, q, floor) the best of that block's ``rows`` (block, part, key, id, x)."""

    def search(block: pa.Table, queries: pa.Table) -> Iterator[pa.RecordBatch]:
        names = ["number", "query_id", "vec_id", "score"]
        if not block.num_rows or not queries.num_rows:
            return
        x, q = _exact(_matrix(block["x"]), _matrix(queries["q"]))
        ids = block["id"].combine_chunks()
        none = ids.is_null().to_numpy(zero_copy_only=False)
        plain = ids.fill_null(0).to_numpy()
        lists = Lists(x, np.lexsort((plain, none)).argsort())
        found: tuple[list, list, list] = [], [], []
        asked = zip(queries["query_id"].to_pylist(), queries["floor"].to_pylist(), strict=True)
        for i, (query, floor) in enumerate(asked):
            best, scores, _ = lists.top(q[i], (plain == query) & ~none, k, floor)
            found[0].append(np.full(len(best), i))
            found[1].append(best)
            found[2].extend(map(int, scores))
        at, best = np.concatenate(found[0]).astype(np.int64), np.concatenate(found[1]).astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [queries["number"].combine_chunks().take(pa.array(at)), queries["query_id"].combine_chunks().take(pa.array(at)), ids.take(pa.array(best)), pa.array(found[2], pa.int64())],
            names,
        )

    def whole(block: pa.Table, queries: pa.Table) -> pa.Table:
        schema = pa.schema([("number", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
        return pa.Table.from_batches(search(block, queries), schema)

    both = rows.groupBy("block", "part").cogroup(asks.groupBy("block", "part"))
    return both.applyInArrow(whole, "number long, query_id long, vec_id long, score long")


def top(vectors: DataFrame, is_query: F.Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``vectors`` for which ``is_query`` holds
    the ``k`` other rows with the highest inner product of entries times 256, rounded down.

    Rows whose vector is null or holds a null, NaN or infinite entry take no part. Vectors meet
    those of their own length alone, so a query whose length no other has gets no row; vectors
    without an entry take no part. Ids are integers. Ties go to the smaller id, null ids last. Rows that have the query's id are its
    own and no candidates; rows that repeat are candidates each, and a query that repeats is
    answered as often, its ranks from 1 each time. A score that leaves a long, or an entry beyond
    one, fails. Fewer than ``k`` others: all of them. An empty table gives an empty result. Other
    columns aren't looked at.
    """
    bad = F.exists(vec_col, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    x = F.transform(vec_col, lambda c: F.floor(c.cast("double") * SCALE))
    usable = vectors.where(F.size(vec_col) > 0).where(~bad)
    rows = stored(usable.select(F.col(id_col).cast("long").alias("id"), x.alias("x"), F.coalesce(is_query, F.lit(False)).alias("asks")).withColumn("number", F.monotonically_increasing_id()))
    counts = rows.agg(F.count("*").alias("n"), F.count_if("asks").alias("q")).first()
    blocks, parts = max(1, -(-counts["n"] // block)), max(1, -(-counts["q"] // group))
    length = F.size("x").cast("long")
    # A block has rows of one length; its number holds both.
    place = (length * F.lit(blocks) + F.pmod(F.xxhash64("number"), F.lit(blocks))).alias("block")
    part = F.pmod(F.xxhash64(F.lit(1), "number"), F.lit(parts)).alias("part")
    queries = rows.where("asks").select("number", F.col("id").alias("query_id"), F.col("x").alias("q"), length.alias("length"), part)
    candidates = rows.select(place, "id", "x")
    each = candidates.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))

    # Every query meets the block of its own number first.
    home = F.col("length") * blocks + F.pmod(F.xxhash64("number"), F.lit(blocks))
    first = queries.select(home.alias("block"), "part", "number", "query_id", "q", F.lit(None).cast("long").alias("floor"))
    near = stored(_searched(each, first, k))
    floors = near.groupBy("number").agg(F.count("*").alias("n"), F.min("score").alias("least"))
    floors = floors.where(F.col("n") >= k).select("number", F.col("least").alias("floor"))
    others = queries.join(floors, "number", "left").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    others = others.withColumn("block", F.col("length") * blocks + F.col("other")).where(F.col("block") != home)
    far = _searched(each, others.select("block", "part", "number", "query_id", "q", "floor"), k)
    found = stored(near.union(far)) if blocks > 1 else near
    if blocks > 1:
        dropped(near)
    # The best k of each query's k a block.
    ranked = found.groupBy("number", "query_id").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("vec_id").isNull().alias("none"), "vec_id"))), 1, k).alias("best"))
    return ranked.select("query_id", F.posexplode("best").alias("at", "b")).select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.s")).alias("score")
    )


def op12_fagin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
