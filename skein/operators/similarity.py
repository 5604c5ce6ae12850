"""Similarities of tables and vectors, in long form (a, b, sim), a < b unless said otherwise."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vector as V

#: Rows of a block at most, and blocks at least once there are ``SMALL`` rows in each.
BLOCK, BLOCKS, SMALL = 32_768, 16, 2048
#: Rows whose products are taken at once.
STRIP = 128


def tfidf(docs: DataFrame, tokens: Column, key: str = "table_name") -> DataFrame:
    """(key, term, tfidf): term counts times ln((1+n)/(1+df))+1, rows of length 1."""
    terms = docs.select(key, F.explode(tokens).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    df = terms.groupBy("term").agg(F.count("*").alias("df"))
    n = docs.agg(F.count("*").alias("docs"))
    weighted = terms.join(df, "term").join(F.broadcast(n)).select(
        key, "term", (F.col("tf") * (F.log((1 + F.col("docs")) / (1 + F.col("df"))) + 1)).alias("w")
    )
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return weighted.select(key, "term", (F.col("w") / length).alias("tfidf"))


def term_cosine(vectors: DataFrame, key: str = "table_name") -> DataFrame:
    """(a, b, sim) of rows that share a term, by a join on terms."""
    a = vectors.select(F.col(key).alias("a"), "term", F.col("tfidf").alias("x"))
    b = vectors.select(F.col(key).alias("b"), "term", F.col("tfidf").alias("y"))
    return a.join(b, "term").where("a < b").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("sim"))


def all_pairs(names: DataFrame, sims: DataFrame) -> DataFrame:
    """Every pair a < b of a catalog's tables; pairs that ``sims`` lacks have 0."""
    a, b = names.select(F.col("table_name").alias("a")), names.select(F.col("table_name").alias("b"))
    return a.join(b, F.col("a") < F.col("b")).join(sims, ["a", "b"], "left").select("a", "b", F.coalesce("sim", F.lit(0.0)).alias("sim"))


def mirrored(sims: DataFrame, diagonal: float | None = None) -> DataFrame:
    """Both orders of each pair and, if wanted, the diagonal."""
    both = sims.select("a", "b", "sim").union(sims.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim"))
    if diagonal is None:
        return both
    own = both.select("a").distinct().select("a", F.col("a").alias("b"), F.lit(diagonal).alias("sim"))
    return both.union(own)


def above(sims: DataFrame, threshold: float) -> DataFrame:
    return sims.where(F.col("sim") > threshold)


def column_minmax(sims: DataFrame) -> DataFrame:
    """Min-max by column b of the mirrored matrix: not symmetric, a is the row."""
    w = Window.partitionBy("b")
    lo, hi = F.min("sim").over(w), F.max("sim").over(w)
    return mirrored(sims).select("a", "b", F.coalesce(F.try_divide(F.col("sim") - lo, hi - lo), F.lit(0.0)).alias("sim"))


def column_percentile(sims: DataFrame, p: float = 0.25) -> DataFrame:
    return mirrored(sims).groupBy("b").agg(F.percentile("sim", p).alias("p"))


def minmax_edges(edges: DataFrame) -> DataFrame:
    """Edge weights scaled to 0..1 over the whole graph; equal weights are an error."""
    w = Window.partitionBy()
    lo, hi = F.min("weight").over(w), F.max("weight").over(w)
    scaled = F.when(hi > lo, (F.col("weight") - lo) / (hi - lo)).otherwise(F.raise_error(F.lit("all edge weights are equal")).cast("double"))
    return edges.withColumn("weight", scaled)


def softmax_edges(edges: DataFrame) -> DataFrame:
    """exp(w) / sum of exp(w); a null weight counts as 1."""
    e = F.exp(F.coalesce("weight", F.lit(1.0)))
    return edges.withColumn("weight", e / F.sum(e).over(Window.partitionBy()))


def average_similarity(vectors: DataFrame, key: str, vec: str = "embedding") -> DataFrame:
    """Mean cosine of each vector to all, itself included: its product with the mean of all unit
    vectors, so one aggregation instead of all pairs."""
    units = vectors.select(key, V.l2_normalized(F.col(vec)).alias("u"))
    means = units.select(F.posexplode("u")).groupBy("pos").agg(F.avg("col").alias("m"))
    mean = means.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]).alias("mean"))
    return units.join(F.broadcast(mean)).select(key, V.dot(F.col("u"), F.col("mean")).alias("avg_sim"))


def _blocks(vectors: DataFrame, key: str, vec: str, extra: list[str]) -> DataFrame:
    """Pairs of row blocks (i, j): each row as left in all j and as right in all i. Up to
    ``BLOCK`` x ``BLOCKS`` rows each is sent to a fixed number of blocks, so what is shuffled grows
    with the rows; beyond, blocks stay as large, so that two of them fit in a task."""
    n = vectors.count()
    k = max(1, min(BLOCKS, -(-n // SMALL)), -(-n // BLOCK))
    rows = vectors.select(F.col(key).alias("id"), F.col(vec).alias("v"), *extra).withColumn("blk", F.pmod(F.xxhash64("id"), F.lit(k)).cast("int"))
    every = F.sequence(F.lit(0), F.lit(k - 1))
    left = rows.select(F.col("blk").alias("i"), F.explode(every).alias("j"), F.lit(0).alias("side"), "id", "v", *extra)
    right = rows.select(F.explode(every).alias("i"), F.col("blk").alias("j"), F.lit(1).alias("side"), "id", "v", *extra)
    return left.select("i", "j", "side", "id", "v", *extra).union(right.select("i", "j", "side", "id", "v", *extra))


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.array(list(vectors), np.float64)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of x to those of y, by their products; those of which
    products leave too few digits are taken from the differences."""
    size = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None]
    square = size - 2 * (x @ y.T)
    i, j = np.nonzero(~(square > 1e-6 * size))
    for k in range(0, len(i), 1 << 16):
        p, q = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
        square[p, q] = ((x[p] - y[q]) ** 2).sum(axis=1)
    return np.sqrt(square)


def nearest(vectors: DataFrame, key: str, vec: str = "embedding") -> DataFrame:
    """(id, nearest, sim): the other vector of largest cosine; ties go to the smaller id."""

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf.side == 0].sort_values("id"), pdf[pdf.side == 1].sort_values("id")
        if a.empty or b.empty:
            return pd.DataFrame({"id": [], "near": [], "sim": []})
        x, y = _matrix(a.v), _matrix(b.v)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-300)
        own, other, found = a.id.to_numpy(), b.id.to_numpy(), []
        for k in range(0, len(x), STRIP):
            s = np.round(x[k : k + STRIP] @ y.T, 12)
            s[own[k : k + STRIP, None] == other[None]] = -2
            at = s.argmax(axis=1)
            found.append(pd.DataFrame({"id": own[k : k + STRIP], "near": other[at], "sim": s[np.arange(len(at)), at]}))
        out = pd.concat(found)
        return out[out.sim > -2]

    found = _blocks(vectors, key, vec, []).groupBy("i", "j").applyInPandas(best, "id long, near long, sim double")
    top = F.max_by(F.struct("near", "sim"), F.struct("sim", -F.col("near")))
    return found.groupBy("id").agg(top.alias("t")).select(F.col("id").alias(key), F.col("t.near").alias("nearest"), F.col("t.sim").alias("sim"))


def label_distances(vectors: DataFrame, key: str, label: str, vec: str = "embedding") -> DataFrame:
    """(id, own, label, total, n): the sum of each vector's Euclidean distances to each label's
    vectors and their number, by blocks; a row for each vector, label and block pair."""

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf.side == 0], pdf[pdf.side == 1]
        if a.empty or b.empty:
            return pd.DataFrame({"id": [], "own": [], "label": [], "total": [], "n": []})
        x, y = _matrix(a.v), _matrix(b.v)
        out = []
        for lab, rows in b.reset_index(drop=True).groupby(label).groups.items():
            z = y[np.array(rows)]
            d = np.concatenate([distances(x[k : k + STRIP], z).sum(axis=1) for k in range(0, len(x), STRIP)])
            out.append(pd.DataFrame({"id": a.id.to_numpy(), "own": a[label].to_numpy(), "label": lab, "total": d, "n": len(z)}))
        return pd.concat(out)

    blocks = _blocks(vectors, key, vec, [label])
    found = blocks.groupBy("i", "j").applyInPandas(sums, "id long, own int, label int, total double, n long")
    return found.groupBy("id", "own", "label").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def centroids(vectors: DataFrame, label: str, vec: str = "embedding") -> DataFrame:
    """(label, centroid, n): mean vectors."""
    dims = vectors.select(label, F.posexplode(vec)).groupBy(label, "pos").agg(F.avg(F.col("col").cast("double")).alias("m"), F.count("*").alias("n"))
    mean = F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"])
    return dims.groupBy(label).agg(mean.alias("centroid"), F.max("n").alias("n"))


def nearest_centroid(vectors: DataFrame, centres: DataFrame, key: str, label: str, vec: str = "embedding") -> DataFrame:
    """(key, nearest, sim): the label of the centroid with largest cosine (labels are few)."""
    packed = centres.agg(F.array_sort(F.collect_list(F.struct(F.col(label).alias("label"), "centroid"))).alias("all"))
    scored = vectors.join(F.broadcast(packed)).select(
        key,
        F.transform("all", lambda c: F.struct(F.round(V.cosine(F.col(vec), c["centroid"]), 12).alias("sim"), (-c["label"]).alias("neg"))).alias("s"),
    )
    best = F.array_max("s")
    return scored.select(key, (-best["neg"]).alias("nearest"), best["sim"].alias("sim"))


def jaccard(samples: DataFrame) -> DataFrame:
    """(t1, c1, t2, c2, sim) of the columns of different tables that share a value."""
    cells = samples.select("table_name", "column_name", F.size("values").alias("n"), F.explode("values").alias("value"))
    a = cells.select(F.col("table_name").alias("t1"), F.col("column_name").alias("c1"), F.col("n").alias("n1"), "value")
    b = cells.select(F.col("table_name").alias("t2"), F.col("column_name").alias("c2"), F.col("n").alias("n2"), "value")
    shared = a.join(b, "value").where("t1 < t2").groupBy("t1", "c1", "t2", "c2", "n1", "n2").agg(F.count("*").alias("both"))
    return shared.select("t1", "c1", "t2", "c2", (F.col("both") / (F.col("n1") + F.col("n2") - F.col("both"))).alias("sim"))


def greedy_mean(matrix: np.ndarray) -> float:
    """Mean of the entries picked greedily, largest first, each row and column once."""
    m, picks = matrix.astype(float).copy(), []
    for _ in range(min(m.shape)):
        i, j = np.unravel_index(m.argmax(), m.shape)
        picks.append(m[i, j])
        m[i, :] = m[:, j] = -np.inf
    return float(np.mean(picks)) if picks else 0.0


def value_overlap(samples: DataFrame) -> DataFrame:
    """(a, b, sim) for each pair of tables that shares a value: greedy matching of columns."""
    sims = jaccard(samples)
    sizes = samples.groupBy("table_name").agg(F.count("*").alias("k"))
    pairs = sims.join(sizes.select(F.col("table_name").alias("t1"), F.col("k").alias("k1")), "t1").join(
        sizes.select(F.col("table_name").alias("t2"), F.col("k").alias("k2")), "t2"
    )

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = {c: i for i, c in enumerate(sorted(set(pdf.c1)))}
        cols = {c: i for i, c in enumerate(sorted(set(pdf.c2)))}
        m = np.zeros((int(pdf.k1.iloc[0]), int(pdf.k2.iloc[0])))
        for r in pdf.itertuples():
            m[rows[r.c1], cols[r.c2]] = r.sim
        return pd.DataFrame({"a": [pdf.t1.iloc[0]], "b": [pdf.t2.iloc[0]], "sim": [greedy_mean(m)]})

    return pairs.groupBy("t1", "t2").applyInPandas(match, "a string, b string, sim double")


def table_documents(columns: DataFrame) -> DataFrame:
    return T.name_documents(columns)


def table_similarity(columns: DataFrame) -> DataFrame:
    """Cosine of the tables' identifier TF-IDF, every pair."""
    docs = table_documents(columns)
    return all_pairs(docs, term_cosine(tfidf(docs, T.identifier_tokens(F.col("doc")))))
