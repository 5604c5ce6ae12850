"""Whitening of embeddings by column aggregates over the upper triangle.

Entries become whole numbers, and the distinct vectors are the fit list. A first aggregation has
their number and sums. One more aggregation has the sums of the products of centred
entries for every pair of dimensions: its groups are the rows of the upper triangle, and SQL
generated for each column sums the products of the row's entry with that column's (an expression
for each single pair is the same sums, but 2,080 of them overflow a generated method, and take 30
seconds to plan whatever the input). The driver assembles the covariance from these sums alone, a
number a pair however many rows there are, and LAPACK decomposes it. Projections are generated
expressions too, so no row leaves the JVM.

Entries are centred at the whole number nearest to their mean before they are multiplied. The
half that is left at most is taken off in whole numbers of any size, so the covariance is exact,
whatever the order in which tasks end.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

#: Entries are multiplied by SCALE, rounded down and moved by SHIFT. Fixed values.
SCALE, SHIFT = 64, 1_000_000
#: Columns of the triangle that a group of the aggregation has at most.
WIDTH = 64
#: Eigenvalues at or below this share of their sum are no variance but rounding.
NOISE = 1e-11


@dataclass(frozen=True)
class Fit:
    """What the fit list gives: its length, sums by dimension, and the components as columns."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def _usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, x): the rows without null, NaN or infinite entries, as whole numbers."""
    bad = F.exists(vec_col, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    x = F.transform(vec_col, lambda c: F.floor(c.cast("double") * SCALE) + F.lit(SHIFT).cast("long"))
    return vectors.where(F.col(vec_col).isNotNull()).where(~bad).select(F.col(id_col).alias("id"), x.alias("x"))


def centred_products(y: DataFrame, d: int, kind: str = "long") -> np.ndarray:
    """Sums over ``y`` (arrays ``y`` of d centred entries) of the products of all pairs of
    dimensions, as a symmetric matrix of objects. A row of the upper triangle is a group, a
    column of it an expression, ``WIDTH`` columns to a group; partial sums are all that is
    shuffled."""
    blocks = f"explode(sequence(i div {WIDTH}, {(d - 1) // WIDTH})) AS b"
    each = y.selectExpr("y", "posexplode(y) AS (i, v)")
    each = each.selectExpr("y", "i", "v", blocks) if d > WIDTH else each.selectExpr("y", "i", "v", "0 AS b")
    column = [f"b * {WIDTH} + {t}" for t in range(min(d, WIDTH))]
    sums = [F.expr(f"sum(CASE WHEN i <= {j} THEN CAST(v AS {kind}) * get(y, {j}) END)").alias(f"p{t}") for t, j in enumerate(column)]
    found = np.zeros((d, d), object)
    for i, b, *row in each.groupBy("i", "b").agg(*sums).collect():  # d rows a column block
        for j, p in enumerate(row[: d - b * WIDTH], b * WIDTH):
            if j >= i:
                found[i, j] = found[j, i] = p
    return found


def fitted(x: DataFrame, d: int) -> Fit:
    """The components of the distinct vectors ``x`` (of d entries, at least one row)."""
    each = x.selectExpr("posexplode(x) AS (i, v)").groupBy("i")
    rows = sorted(each.agg(F.count("*"), F.sum("v")).collect())
    n, sums = rows[0][1], [r[2] for r in rows]
    centre = [(2 * s + n) // (2 * n) for s in sums]
    moved = x.selectExpr(f"transform(x, (v, i) -> v - get(array({', '.join(f'{m}L' for m in centre)}), i)) AS y")
    products = centred_products(moved, d)  # a long holds them wherever it holds the deviations
    left = [s - n * m for s, m in zip(sums, centre, strict=True)]
    # n sum(yy) - sum(y) sum(y) in whole numbers is n * n times the covariance.
    cov = np.array([[(n * products[i, j] - left[i] * left[j]) / (n * n) for j in range(d)] for i in range(d)], np.float64)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(d)])  # one of two, the same in each run
    return Fit(n, sums, values, vectors * signs, float(np.trace(cov)))


def _array(values: list[str], kind: str) -> str:
    """Numbers as one array constant in SQL."""
    return f"CAST(array({', '.join(values)}) AS array<{kind}>)"


def _projected(x: DataFrame, fit: Fit, most: int, *columns: str) -> DataFrame:
    """``columns`` of ``x`` and ``w``: an array of its centred entries on the first components,
    each over the root of its variance (null for a component without variance).

    Components are constants of a few nested expressions. An expression for each of the products
    gives the same sums, but its generated code takes hundreds of MB of the driver's memory."""
    d, shown = len(fit.sums), min(most, len(fit.sums))
    w = []
    for k in range(shown):
        if fit.values[k] <= NOISE * fit.trace or fit.trace <= 0:
            w.append("NULL")
            continue
        scale = 1 / np.sqrt(fit.values[k])
        w.append(_array([f"{float(fit.vectors[i, k] * scale)!r}D" for i in range(d)], "double"))
    centred = f"zip_with(x, {_array([f'{s}L' for s in fit.sums], 'bigint')}, (v, s) -> (v * {fit.n}L - s) / {fit.n}D)"
    product = "aggregate(zip_with(c, p, (a, b) -> a * b), 0D, (s, v) -> s + v)"
    # As an argument ``c`` is made once a row, as a column it would be for each component.
    return x.selectExpr(*columns, f"get(transform(array({centred}), c -> transform({_array(w, 'array<double>')}, p -> {product})), 0) AS w")


def identity_error(x: DataFrame, fit: Fit, most: int) -> float | None:
    """Largest absolute entry of the whitened fit list's covariance less the identity, over the
    components that have variance; null without any."""
    kept = [k for k in range(min(most, len(fit.sums))) if fit.trace > 0 and fit.values[k] > NOISE * fit.trace]
    if not kept:
        return None
    w = _projected(x, fit, most)
    # A last entry of 1 gives the sums as well: what rounding has left of the means.
    own = w.selectExpr("concat(filter(w, c -> c IS NOT NULL), array(1D)) AS y")
    sums = centred_products(own, len(kept) + 1, "double").astype(np.float64) / fit.n
    cov = sums[:-1, :-1] - np.outer(sums[:-1, -1], sums[:-1, -1])
    return float(np.abs(cov - np.eye(len(kept))).max())


def whitened(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", most: int = 16) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): a row for each usable
    row of ``vectors`` and each of the first ``most`` components (as many as there are dimensions
    if those are fewer).

    Rows whose vector is null or holds a null, NaN or infinite entry are left out. Vectors of
    several lengths are whitened apart, each length by its own fit list; those without an entry
    have no component and so no row. A row that repeats comes back as often, and counts once in
    the fit list; ids may be null and of any type. A component without variance (all vectors
    equal, or fewer of them than dimensions) has ``whitened`` null and ``explained`` 0, or null
    if there is no variance at all. ``deviation`` is exact; where it would leave a long the query
    fails (ARITHMETIC_OVERFLOW), as it does for entries beyond 1e17. Equal eigenvalues keep
    LAPACK's order. An empty table gives an empty result. Other columns aren't looked at.
    """
    usable = _usable(vectors, id_col, vec_col)
    fit_list = stored(usable.select("x").distinct())  # read by three aggregations
    lengths = sorted(r[0] for r in fit_list.select(F.size("x")).distinct().collect() if r[0])
    out = None
    for d in lengths or [0]:
        x = fit_list.where(F.size("x") == d)
        fit = fitted(x, d) if d else Fit(1, [], np.zeros(0), np.zeros((0, 0)), 0.0)
        error = identity_error(x, fit, most)
        shown = min(most, d)
        explained = [float(max(v, 0) / fit.trace) if fit.trace > 0 else None for v in fit.values[:shown]]
        rows = usable.where(F.size("x") == d) if d else usable.where("false")
        deviation = f"aggregate(zip_with(x, {_array([f'{s}L' for s in fit.sums], 'bigint')}, (v, s) -> v * {fit.n}L - s), 0L, (a, v) -> a + v * v) AS deviation"
        own = _projected(rows.selectExpr("id", "x", deviation), fit, most, "id", "deviation")
        share = F.get(F.expr(_array(["NULL" if e is None else f"{e!r}D" for e in explained], "double")), F.col("k"))
        part = own.select("id", "deviation", "w", F.explode(F.lit(list(range(shown))).cast("array<int>")).alias("k")).select(
            "id", (F.col("k") + 1).alias("component"), F.lit(fit.n).cast("long").alias("n"), "deviation", F.get("w", "k").alias("whitened"),
            share.alias("explained"), F.lit(error).cast("double").alias("identity_error"),
        )
        out = part if out is None else out.union(part)
    return out


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")
