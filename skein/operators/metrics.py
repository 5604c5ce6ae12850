"""Measures of clusterings and of labelled vectors, each a one-row DataFrame."""

from __future__ import annotations

from functools import reduce
from math import pi

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import similarity as S


def contingency(rows: DataFrame, truth: str, found: str) -> DataFrame:
    """(t, p, n): how many rows have both labels; only pairs that occur."""
    return rows.groupBy(F.col(truth).cast("string").alias("t"), F.col(found).cast("string").alias("p")).agg(F.count("*").alias("n"))


def _margins(table: DataFrame) -> DataFrame:
    a, b, every = Window.partitionBy("t"), Window.partitionBy("p"), Window.partitionBy()
    return table.withColumn("a", F.sum("n").over(a)).withColumn("b", F.sum("n").over(b)).withColumn("all", F.sum("n").over(every))


def mutual_information(table: DataFrame) -> DataFrame:
    """(mutual_information, h_truth, h_found) in nats."""
    m = _margins(table)
    n = F.col("all").cast("double")
    share = F.col("n") / n
    mi = F.sum(share * F.log(F.col("n") * n / (F.col("a") * F.col("b").cast("double"))))
    h = lambda c: -F.sum(share * F.log(F.col(c) / n))
    return m.agg(F.greatest(mi, F.lit(0.0)).alias("mutual_information"), h("a").alias("h_truth"), h("b").alias("h_found"))


def log_factorial(x: Column) -> Column:
    """ln(x!): of numbers up to 20 by the exact factorial, else by Stirling's series, whose error
    is below 1e-13 there."""
    v = F.greatest(x.cast("double"), F.lit(1.0))
    series = 1 / (12 * v) - 1 / (360 * v**3) + 1 / (1260 * v**5) - 1 / (1680 * v**7)
    far = v * F.log(v) - v + 0.5 * F.log(2 * pi * v) + series
    return F.when(x <= 20, F.log(F.factorial(F.least(x, F.lit(20)).cast("int")).cast("double"))).otherwise(far)


def expected_mutual_information(table: DataFrame) -> DataFrame:
    """(emi): its expectation under random labels with the same cluster sizes.

    The hypergeometric probabilities need log factorials, which Stirling's series gives in an
    expression.
    """
    m = _margins(table)
    a = m.groupBy("t", "all").agg(F.first("a").alias("a")).groupBy("a", "all").agg(F.count("*").alias("ka"))
    b = m.groupBy("p").agg(F.first("b").alias("b")).groupBy("b").agg(F.count("*").alias("kb"))
    pairs = a.join(b, how="cross")
    lo = F.greatest(F.lit(1), F.col("a") + F.col("b") - F.col("all"))
    cells = pairs.withColumn("k", F.explode(F.sequence(lo, F.least("a", "b"))))
    a_, b_, k_, n_ = F.col("a"), F.col("b"), F.col("k"), F.col("all")
    above = [a_, b_, n_ - a_, n_ - b_]
    below = [n_, k_, a_ - k_, b_ - k_, n_ - a_ - b_ + k_]
    p = F.exp(sum(map(log_factorial, above), F.lit(0.0)) - sum(map(log_factorial, below), F.lit(0.0)))
    k, n = F.col("k").cast("double"), F.col("all").cast("double")
    term = k / n * F.log(n * k / (F.col("a") * F.col("b").cast("double"))) * p * F.col("ka") * F.col("kb")
    return cells.agg(F.coalesce(F.sum(term), F.lit(0.0)).alias("emi"))


def adjusted_mutual_information(table: DataFrame) -> DataFrame:
    """(ami), by the arithmetic mean of the entropies; 1 where both have one cluster."""
    joined = mutual_information(table).join(expected_mutual_information(table), how="cross")
    half = (F.col("h_truth") + F.col("h_found")) / 2
    same = (F.abs(F.col("h_truth")) < 1e-12) & (F.abs(F.col("h_found")) < 1e-12)
    value = F.try_divide(F.col("mutual_information") - F.col("emi"), half - F.col("emi"))
    return joined.select(F.when(same, 1.0).otherwise(F.coalesce(value, F.lit(1.0))).alias("ami"))


def _pairs(x: Column) -> Column:
    return x.cast("double") * (x - 1) / 2


def pair_counts(table: DataFrame) -> DataFrame:
    """(both, truth, found, pairs): pairs of rows together in both, in one, and all."""
    a = table.groupBy("t").agg(F.sum("n").alias("a")).agg(F.sum(_pairs(F.col("a"))).alias("truth"))
    b = table.groupBy("p").agg(F.sum("n").alias("b")).agg(F.sum(_pairs(F.col("b"))).alias("found"))
    c = table.agg(F.sum(_pairs(F.col("n"))).alias("both"), _pairs(F.sum("n")).alias("pairs"))
    return c.join(a, how="cross").join(b, how="cross")


def rand_index(table: DataFrame) -> DataFrame:
    value = F.try_divide(F.expr("pairs + 2 * both - truth - found"), "pairs")
    return pair_counts(table).select(F.coalesce(value, F.lit(1.0)).alias("rand_index"))


def adjusted_rand_index(table: DataFrame) -> DataFrame:
    expected = F.try_divide(F.col("truth") * F.col("found"), "pairs")
    value = F.try_divide(F.col("both") - expected, (F.col("truth") + F.col("found")) / 2 - expected)
    return pair_counts(table).select(F.coalesce(value, F.lit(1.0)).alias("adjusted_rand_index"))


def cluster_stats(rows: DataFrame, label: str) -> DataFrame:
    sizes = rows.groupBy(label).agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("clusters"), F.avg("n").alias("mean_size"), F.max("n").alias("max_size"), F.min("n").alias("min_size"))


def aligned(truth: DataFrame, found: DataFrame, strict: bool = False) -> DataFrame:
    """(table_name, t, p): found labels for the truth's tables. A table that ``found`` lacks has
    label 0, or is an error if strict; one that the truth lacks is an error."""
    joined = truth.select("table_name", F.col("cluster_id").alias("t"), F.lit(True).alias("known")).join(
        found.select("table_name", F.col("cluster_id").alias("p")), "table_name", "full"
    )
    fail = lambda s: F.raise_error(F.concat(F.lit(s), "table_name")).cast("int")
    p = F.when(F.col("known").isNull(), fail("not in the truth: ")).otherwise(
        F.coalesce("p", fail("not clustered: ") if strict else F.lit(0))
    )
    return joined.select("table_name", "t", p.alias("p"))


def report(truth: DataFrame, found: DataFrame) -> DataFrame:
    """(name, value) of all measures of a clustering against a truth."""
    table = contingency(aligned(truth, found), "t", "p")
    one = [mutual_information(table).select("mutual_information"), adjusted_mutual_information(table), rand_index(table), adjusted_rand_index(table)]
    stats = [(cluster_stats(df, "cluster_id"), prefix) for df, prefix in ((found, "output_"), (truth, "groundtruth_"))]
    rows = [(df, c, c) for df in one for c in df.columns] + [(df, c, prefix + c) for df, prefix in stats for c in df.columns]
    return reduce(DataFrame.unionByName, [df.select(F.lit(n).alias("name"), F.col(c).cast("double").alias("value")) for df, c, n in rows])


def missing_and_extra(truth: DataFrame, found: DataFrame) -> DataFrame:
    """(table_name, kind): tables only in one of the two."""
    t, f = truth.select("table_name"), found.select("table_name")
    return t.join(f, "table_name", "left_anti").withColumn("kind", F.lit("missing")).unionByName(f.join(t, "table_name", "left_anti").withColumn("kind", F.lit("extra")))


def completed(truth: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` with the tables that it lacks as one more cluster."""
    top = found.agg((F.coalesce(F.max("cluster_id"), F.lit(-1)) + 1).alias("cluster_id"))
    lost = truth.select("table_name").join(found, "table_name", "left_anti").join(F.broadcast(top))
    return found.select("table_name", "cluster_id").unionByName(lost.select("table_name", "cluster_id"))


def key_belonging(foreign_keys: DataFrame, assignment: DataFrame) -> DataFrame:
    """(belonging): share of keys within a cluster; null without keys."""
    c = assignment.select("table_name", "cluster_id")
    e = foreign_keys.join(c.select(F.col("table_name").alias("constrained_table"), F.col("cluster_id").alias("x")), "constrained_table", "left")
    e = e.join(c.select(F.col("table_name").alias("referred_table"), F.col("cluster_id").alias("y")), "referred_table", "left")
    same = F.coalesce(F.col("x") == F.col("y"), F.lit(False)).cast("int")
    return e.agg(F.try_divide(F.sum(same), F.count("*")).alias("belonging"))


def cut_quality(assignment: DataFrame, distances: DataFrame, by_size: bool = False) -> DataFrame:
    """(quality): over clusters, K (separation - cohesion) / n. Separation is the smallest mean
    distance to another cluster (1 without one), cohesion the mean distance within (1 for one
    table); K is the number of clusters, or the cluster's size. ``distances``: (a, b, d), a<b."""
    c = assignment.select("table_name", "cluster_id")
    both = distances.union(distances.select(F.col("b").alias("a"), F.col("a").alias("b"), "d"))
    d = both.join(c.select(F.col("table_name").alias("a"), F.col("cluster_id").alias("x")), "a").join(
        c.select(F.col("table_name").alias("b"), F.col("cluster_id").alias("y")), "b"
    )
    mean = d.groupBy("x", "y").agg(F.avg("d").alias("m"))
    sep = mean.where("x <> y").groupBy("x").agg(F.min("m").alias("sep"))
    coh = mean.where("x = y").select("x", F.col("m").alias("coh"))
    size = c.groupBy(F.col("cluster_id").alias("x")).agg(F.count("*").alias("size"))
    every = Window.partitionBy()
    per = size.join(sep, "x", "left").join(coh, "x", "left")
    per = per.withColumn("k", F.col("size") if by_size else F.count("*").over(every)).withColumn("n", F.sum("size").over(every))
    return per.agg(F.sum(F.col("k") * (F.coalesce("sep", F.lit(1.0)) - F.coalesce("coh", F.lit(1.0))) / F.col("n")).alias("quality"))


def silhouette(vectors: DataFrame, key: str, label: str, vec: str = "embedding") -> DataFrame:
    """(silhouette): mean over vectors of (b - a) / max(a, b), Euclidean; 0 for singletons."""
    sums = S.label_distances(vectors, key, label, vec)
    own = F.col("own") == F.col("label")
    per = sums.groupBy("id").agg(
        F.max(F.when(own, F.try_divide("total", F.col("n") - 1))).alias("a"),
        F.min(F.when(~own, F.col("total") / F.col("n"))).alias("b"),
    )
    s = F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))
    return per.agg(F.avg(s).alias("silhouette"))


def _to_centroids(vectors: DataFrame, label: str, vec: str) -> DataFrame:
    """(label, spread, squares, n, centroid): mean distance and sum of squares to the centroid."""
    from ..functions.vector import distance

    centres = S.centroids(vectors, label, vec)
    d = vectors.join(F.broadcast(centres), label).select(label, "centroid", distance(F.col(vec), F.col("centroid")).alias("d"))
    return d.groupBy(label).agg(F.avg("d").alias("spread"), F.sum(F.col("d") ** 2).alias("squares"), F.count("*").alias("n"), F.first("centroid").alias("centroid"))


def centroid_distances(vectors: DataFrame, label: str, vec: str = "embedding") -> DataFrame:
    """(a, b, d) between the centroids of labels, a < b."""
    from ..functions.vector import distance

    c = S.centroids(vectors, label, vec)
    a, b = c.select(F.col(label).alias("a"), F.col("centroid").alias("x")), c.select(F.col(label).alias("b"), F.col("centroid").alias("y"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", distance(F.col("x"), F.col("y")).alias("d"))


def davies_bouldin(vectors: DataFrame, label: str, vec: str = "embedding") -> DataFrame:
    from ..functions.vector import distance

    c = _to_centroids(vectors, label, vec)
    a = c.select(F.col(label).alias("a"), F.col("spread").alias("sa"), F.col("centroid").alias("x"))
    b = c.select(F.col(label).alias("b"), F.col("spread").alias("sb"), F.col("centroid").alias("y"))
    ratio = F.try_divide(F.col("sa") + F.col("sb"), distance(F.col("x"), F.col("y")))
    worst = a.join(b, F.col("a") != F.col("b")).groupBy("a").agg(F.max(ratio).alias("r"))
    return worst.agg(F.avg(F.coalesce("r", F.lit(0.0))).alias("davies_bouldin"))


def calinski_harabasz(vectors: DataFrame, label: str, vec: str = "embedding") -> DataFrame:
    from ..functions.vector import distance

    c = _to_centroids(vectors, label, vec)
    whole = S.centroids(vectors.select(F.lit(0).alias("one"), vec), "one", vec).select(F.col("centroid").alias("middle"))
    per = c.join(F.broadcast(whole)).agg(
        F.sum(F.col("n") * distance(F.col("centroid"), F.col("middle")) ** 2).alias("between"),
        F.sum("squares").alias("within"), F.sum("n").alias("n"), F.count("*").alias("k"),
    )
    return per.select(F.try_divide(F.expr("between * (n - k)"), F.expr("within * (k - 1)")).alias("calinski_harabasz"))


def confusion(rows: DataFrame, gold: str, found: str) -> DataFrame:
    """(label, precision, recall, f1) by class, with 1e-6 in the denominators."""
    counts = rows.groupBy(F.col(gold).alias("g"), F.col(found).alias("p")).agg(F.count("*").alias("n"))
    by = lambda c, name: counts.groupBy(F.col(c).alias("label")).agg(F.sum("n").alias(name))
    hit = counts.where("g = p").select(F.col("g").alias("label"), F.col("n").alias("hit"))
    joined = by("g", "gold").join(by("p", "found"), "label", "full").join(hit, "label", "left").na.fill(0, ["gold", "found", "hit"])
    precision, recall = F.col("hit") / (F.col("found") + 1e-6), F.col("hit") / (F.col("gold") + 1e-6)
    return joined.select("label", precision.alias("precision"), recall.alias("recall"), (2 * precision * recall / (precision + recall + 1e-6)).alias("f1"))


def percentile_sizes(assignment: DataFrame) -> DataFrame:
    sizes = assignment.groupBy("cluster_id").agg(F.count("*").alias("n"))
    return sizes.agg(F.percentile("n", 0.2).alias("p20"), F.percentile("n", 0.9).alias("p90"))


def dot_layout(assignment: DataFrame) -> DataFrame:
    """(table_name, cluster_id, x, y): clusters on a ring, their tables on a ring around each,
    scaled to -1..1."""
    by, ring = Window.partitionBy("cluster_id").orderBy("table_name"), Window.orderBy("cluster_id")
    size = F.count("*").over(Window.partitionBy("cluster_id"))
    top = F.max("c").over(Window.partitionBy()) + 1
    d = assignment.withColumn("c", F.dense_rank().over(ring) - 1).withColumn("i", F.row_number().over(by) - 1).withColumn("s", size)
    turn, own = 2 * F.pi() * F.col("c") / top, 2 * F.pi() * F.col("i") / F.col("s")
    r = F.when(F.col("s") > 1, 0.25).otherwise(0.0)
    d = d.withColumn("x", F.cos(turn) + r * F.cos(own)).withColumn("y", F.sin(turn) + r * F.sin(own))
    every = Window.partitionBy()
    unit = lambda c: F.coalesce(2 * F.try_divide(F.col(c) - F.min(c).over(every), F.max(c).over(every) - F.min(c).over(every)) - 1, F.lit(0.0))
    return d.select("table_name", "cluster_id", unit("x").alias("x"), unit("y").alias("y"))
