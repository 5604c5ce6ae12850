"""The number of clusters: k-means for every k at once, and the silhouettes of all of them.

A round of Lloyd's algorithm is one scan of the vectors for all k together: each batch is compared
with the centres of every k, and adds up, for each (k, cluster), its vectors' number, sum and squared
norms. What reaches the driver are the centres alone, a number of rows that ``most`` bounds. The
silhouette on squared distances needs no pairs: a vector's mean squared distance to a cluster follows
from the cluster's number, sum and squared norms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of ``x`` to those of ``c``, by differences, which lose no digits."""
    return np.stack([((x - row) ** 2).sum(axis=1) for row in c], axis=1)


def _nearest(x: np.ndarray, centres: dict[int, np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    for k, c in centres.items():
        yield k, _squares(x, c).argmin(axis=1)


def _sums(vectors: DataFrame, centres: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each k the number, sum and sum of squared norms of each cluster's vectors."""
    sent = vectors.sparkSession.sparkContext.broadcast(centres)
    d = next(iter(centres.values())).shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        total = {k: np.zeros((len(c), d + 2)) for k, c in known.items()}
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(0))
                full = np.concatenate([np.ones((len(x), 1)), (x**2).sum(axis=1, keepdims=True), x], axis=1)
                for k, own in _nearest(x, known):
                    np.add.at(total[k], own, full)
        rows = [(k, c, row.tolist()) for k, t in total.items() for c, row in enumerate(t)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.list_(pa.float64())))], ["k", "c", "s"])

    parts = vectors.mapInArrow(run, "k int, c int, s array<double>").select("k", "c", F.posexplode("s").alias("i", "x"))
    out = {k: np.zeros((len(c), d + 2)) for k, c in centres.items()}
    for k, c, i, x in parts.groupBy("k", "c", "i").agg(F.sum("x")).collect():  # k (k + 1) / 2 centres in all
        out[k][c, i] = x
    return {k: (t[:, 0], t[:, 2:], t[:, 1]) for k, t in out.items()}


def cluster_numbers(vectors: DataFrame, id_col: str, vec_col: str, most: int = 19, rounds: int = 10, seed: int = 43) -> DataFrame:
    """(k, silhouette, chosen): for each k from 2 to ``most`` (less than the vectors there are) the
    mean silhouette of ``rounds`` rounds of k-means, and whether it is the best, the least k of
    equal ones.

    Every k starts from the first k vectors by a seeded hash of their id, so k is the only thing
    that differs. A cluster that loses all its vectors keeps its centre. Rows with a null id or a
    null vector, or with a null, NaN or infinite entry, are left out; vectors must have one
    length. A vector alone in its cluster has the silhouette 0. With fewer than three vectors the
    result is empty.
    """
    bad = F.exists(vec_col, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    usable = vectors.where(F.col(id_col).isNotNull() & (F.size(vec_col) > 0)).where(~bad)
    usable = usable.select(F.col(id_col).alias("id"), F.transform(vec_col, lambda c: c.cast("double")).alias("v"))
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("id").cast("string")))
    first = [r["v"] for r in usable.orderBy(draw, "id", "v").limit(most + 1).collect()]
    spark = vectors.sparkSession
    schema = "k int, silhouette double, chosen boolean"
    if len(first) < 3:
        return spark.createDataFrame([], schema)
    start = np.array(first)
    centres = {k: start[:k] for k in range(2, min(most, len(first) - 1) + 1)}
    only = usable.select("v")
    for _ in range(rounds):
        found = _sums(only, centres)
        centres = {k: np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], centres[k]) for k, (n, s, _) in found.items()}
    stats = _sums(only, centres)
    sent = spark.sparkContext.broadcast((centres, stats))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, of = sent.value
        total = {k: [0.0, 0] for k in known}
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(0))
                for k, own in _nearest(x, known):
                    n, s, square = of[k]
                    mean = s / np.maximum(n, 1)[:, None]
                    # Mean squared distance: to the cluster's mean, and the spread around that.
                    away = _squares(x, mean) + (square / np.maximum(n, 1) - (mean**2).sum(axis=1))[None]
                    away[:, n == 0] = np.inf
                    rows = np.arange(len(x))
                    size = n[own]
                    a = away[rows, own] * size / np.maximum(size - 1, 1)
                    away[rows, own] = np.inf
                    other = away.min(axis=1)
                    value = np.where((size > 1) & np.isfinite(other), (other - a) / np.maximum(np.maximum(a, other), 1e-300), 0.0)
                    total[k][0] += float(value.sum())
                    total[k][1] += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([t[0] for t in total.values()], pa.float64()), pa.array([t[1] for t in total.values()], pa.int64())], ["k", "s", "n"])

    scores = only.mapInArrow(run, "k int, s double, n long").groupBy("k").agg((F.sum("s") / F.sum("n")).alias("s")).collect()
    best = max(scores, key=lambda r: (round(r["s"], 12), -r["k"]))["k"]
    return spark.createDataFrame([(r["k"], r["s"], r["k"] == best) for r in sorted(scores)], schema)
