"""The foreign-key graph and analytics on graphs of tables.

Edges are (src, dst, weight), src < dst, one a pair. Graphs of a catalog's size run their
iterations in one grouped call; edges themselves are built and joined as relations.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .rounds import iterated, settled

#: Largest number of edges that a grouped call takes in.
MOST = 2_000_000


def edges(foreign_keys: DataFrame, loops: bool = False) -> DataFrame:
    """Undirected edges of the keys; parallel keys are one edge."""
    a, b = F.col("constrained_table"), F.col("referred_table")
    pairs = foreign_keys.select(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")).distinct()
    return (pairs if loops else pairs.where("src <> dst")).withColumn("weight", F.lit(1.0))


def similar_edges(graph: DataFrame, sims: DataFrame, floor: float = 0.5) -> DataFrame:
    """Edges with their tables' similarity as weight, without those under ``floor``."""
    s = sims.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), "sim").distinct()
    return graph.drop("weight").join(s, ["src", "dst"]).where(F.col("sim") >= floor).withColumnRenamed("sim", "weight")


def with_similar(graph: DataFrame, sims: DataFrame, threshold: float) -> DataFrame:
    """Edges for similar tables besides; an edge of both kinds keeps the larger weight."""
    more = sims.where(F.col("sim") > threshold).select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), F.col("sim").alias("weight"))
    return graph.unionByName(more).groupBy("src", "dst").agg(F.max("weight").alias("weight"))


def both_ways(graph: DataFrame) -> DataFrame:
    back = graph.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    return graph.select("src", "dst", "weight").union(back)


def degree(names: DataFrame, graph: DataFrame) -> DataFrame:
    """(table_name, degree); a loop counts twice."""
    ends = graph.select(F.explode(F.array("src", "dst")).alias("table_name"))
    counts = ends.groupBy("table_name").agg(F.count("*").alias("degree"))
    return names.select("table_name").join(counts, "table_name", "left").select("table_name", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def neighbours(graph: DataFrame) -> DataFrame:
    """(table_name, neighbour), both directions."""
    return both_ways(graph).select(F.col("src").alias("table_name"), F.col("dst").alias("neighbour"))


def non_neighbours(names: DataFrame, graph: DataFrame) -> DataFrame:
    """(table_name, other): tables without an edge to it, itself included."""
    n = names.select("table_name")
    pairs = n.join(n.select(F.col("table_name").alias("other")), how="cross")
    return pairs.join(neighbours(graph).withColumnRenamed("neighbour", "other"), ["table_name", "other"], "left_anti")


def incoming(foreign_keys: DataFrame) -> DataFrame:
    """(table_name, keys): ids of the keys that refer to a table."""
    return foreign_keys.groupBy(F.col("referred_table").alias("table_name")).agg(F.array_sort(F.collect_list("fk_id")).alias("keys"))


def _grouped(names: DataFrame, graph: DataFrame, f, schema: str) -> DataFrame:
    """``f(names, src, dst, weight)`` (places of names) in one group; a frame of rows back."""
    rows = graph.select("src", "dst", F.col("weight").cast("double").alias("weight")).unionByName(
        names.select(F.col("table_name").alias("src"), F.lit(None).cast("string").alias("dst"), F.lit(None).cast("double").alias("weight"))
    )

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > MOST:
            raise ValueError("the graph is too large for one group")
        every = sorted(pdf.src[pdf.dst.isna()])
        at = {n: i for i, n in enumerate(every)}
        e = pdf[pdf.dst.notna()].sort_values(["src", "dst"])
        return f(every, e.src.map(at).to_numpy(), e.dst.map(at).to_numpy(), e.weight.to_numpy())

    return rows.groupBy().applyInPandas(run, schema)


def components(names: DataFrame, graph: DataFrame) -> DataFrame:
    """(table_name, component): the component's first table by name. Each round takes the least
    label among neighbours and then that label's own label; it ends when none changes."""
    near = settled(neighbours(graph).distinct())
    labels = settled(names.select("table_name", F.col("table_name").alias("component")))
    while True:
        heard = near.join(labels.select(F.col("table_name").alias("neighbour"), "component"), "neighbour")
        heard = heard.groupBy("table_name").agg(F.min("component").alias("heard"))
        lower = labels.join(heard, "table_name", "left").select("table_name", F.col("component").alias("was"), F.least("component", "heard").alias("component"))
        jump = labels.select(F.col("table_name").alias("component"), F.col("component").alias("on"))
        new = settled(lower.join(jump, "component").select("table_name", "was", F.least("component", "on").alias("component")))
        labels = new.select("table_name", "component")
        if not new.where("component <> was").limit(1).count():
            return labels


def pagerank(names: DataFrame, graph: DataFrame, damping: float = 0.85, iterations: int = 100, tolerance: float | None = 1e-6) -> DataFrame:
    """(table_name, page_rank) of the undirected weighted graph; mass of tables without an edge
    goes to all. With a tolerance it stops when the total change is below n times that.

    A round joins ranks to edges and adds them up. Tables without an edge have one rank, which
    follows from their number alone, so no round needs a sum over all tables.
    """
    ways = both_ways(graph)
    out = ways.groupBy("src").agg(F.sum("weight").alias("out")).where("out > 0")
    steps = settled(ways.join(out, "src").select("src", "dst", (F.col("weight") / F.col("out")).alias("p")))
    linked = settled(names.select("table_name").join(out.select(F.col("src").alias("table_name")), "table_name", "left_semi"))
    n = names.count()
    if not n:
        return names.select("table_name", F.lit(0.0).alias("page_rank"))
    lone = n - linked.count()
    ranks = [1 / n]  # of a table without an edge, round by round
    for _ in range(iterations):
        ranks.append(damping * lone * ranks[-1] / n + (1 - damping) / n)

    def step(now: DataFrame, k: int) -> DataFrame:
        flow = steps.join(now.withColumnRenamed("table_name", "src"), "src").groupBy(F.col("dst").alias("table_name"))
        return flow.agg((damping * F.sum(F.col("page_rank") * F.col("p")) + F.lit(ranks[k + 1])).alias("page_rank"))

    start = linked.select("table_name", F.lit(1 / n).alias("page_rank"))
    found = iterated(start, step, iterations, "table_name", "page_rank", None if tolerance is None else n * tolerance, F.sum)
    others = names.select("table_name").join(linked, "table_name", "left_anti")
    return found.unionByName(others.select("table_name", F.lit(ranks[-1]).alias("page_rank")))


def _adjacent(n: int, src, dst) -> list[list[int]]:
    out: list[set[int]] = [set() for _ in range(n)]
    for a, b in zip(src, dst, strict=True):
        if a != b:
            out[int(a)].add(int(b))
            out[int(b)].add(int(a))
    return [sorted(x) for x in out]


def path_shares(adjacent: list[list[int]]) -> tuple[np.ndarray, dict[tuple[int, int], float]]:
    """Shares of shortest paths through each node and each edge, over ordered pairs."""
    n = len(adjacent)
    node, edge = np.zeros(n), {}
    for s in range(n):
        order, before = [], [[] for _ in range(n)]
        paths, far = np.zeros(n), np.full(n, -1)
        paths[s], far[s] = 1, 0
        queue = deque([s])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in adjacent[v]:
                if far[w] < 0:
                    far[w] = far[v] + 1
                    queue.append(w)
                if far[w] == far[v] + 1:
                    paths[w] += paths[v]
                    before[w].append(v)
        share = np.zeros(n)
        for w in reversed(order):
            for v in before[w]:
                part = paths[v] / paths[w] * (1 + share[w])
                key = (min(v, w), max(v, w))
                edge[key] = edge.get(key, 0.0) + part
                share[v] += part
            if w != s:
                node[w] += share[w]
    return node, edge


def betweenness(names: DataFrame, graph: DataFrame) -> DataFrame:
    """(table_name, betweenness): normalised, unweighted, ends left out."""

    def run(every, src, dst, _):
        n = len(every)
        node, _ = path_shares(_adjacent(n, src, dst))
        return pd.DataFrame({"table_name": every, "betweenness": node / max(1, (n - 1) * (n - 2))})

    return _grouped(names, graph, run, "table_name string, betweenness double")


def edge_betweenness(names: DataFrame, graph: DataFrame) -> DataFrame:
    def run(every, src, dst, _):
        n = len(every)
        _, edge = path_shares(_adjacent(n, src, dst))
        rows = [(every[a], every[b], x / max(1, n * (n - 1))) for (a, b), x in sorted(edge.items())]
        return pd.DataFrame(rows, columns=["src", "dst", "betweenness"])

    return _grouped(names, graph, run, "src string, dst string, betweenness double")


def link_quality(graph: DataFrame, assignment: DataFrame) -> DataFrame:
    """One row, ``quality``: over clusters, the share of edges inside less the square of the
    share of edges that touch it."""
    c = assignment.select("table_name", "cluster_id")
    e = graph.join(c.select(F.col("table_name").alias("src"), F.col("cluster_id").alias("x")), "src").join(
        c.select(F.col("table_name").alias("dst"), F.col("cluster_id").alias("y")), "dst"
    )
    touch = e.select(F.explode(F.array_distinct(F.array("x", "y"))).alias("cluster_id"), (F.col("x") == F.col("y")).cast("int").alias("inside"))
    per = touch.groupBy("cluster_id").agg(F.sum("inside").alias("i"), F.count("*").alias("t"))
    total = graph.agg(F.count("*").alias("e"))
    share = F.col("i") / F.col("e") - (F.col("t") / F.col("e")) ** 2
    return per.join(F.broadcast(total)).agg(F.coalesce(F.sum(share), F.lit(0.0)).alias("quality"))


def walks(graph: DataFrame, per_node: int = 100, length: int = 10, seed: int = 43) -> DataFrame:
    """(walk_id, tables): seeded uniform random walks from every table with an edge, one join a
    step; the next table is the neighbour of least hash."""
    near = both_ways(graph).select("src", "dst")
    now = near.select("src").distinct().withColumn("walk", F.explode(F.sequence(F.lit(0), F.lit(per_node - 1))))
    now = now.select(F.concat_ws("#", "src", "walk").alias("walk_id"), F.array("src").alias("tables"), F.col("src").alias("at"))
    for step in range(1, length):
        choice = F.min_by("dst", F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(str(step)), "walk_id", "dst")))
        now = now.join(near, F.col("at") == F.col("src")).groupBy("walk_id", "tables").agg(choice.alias("at"))
        now = now.select("walk_id", F.concat("tables", F.array("at")).alias("tables"), "at")
    return now.select("walk_id", "tables")


def node2vec(graph: DataFrame, size: int = 64, window: int = 10, per_node: int = 100, length: int = 10, seed: int = 43) -> DataFrame:
    """(table_name, embedding): Word2Vec on the walks (p = q = 1)."""
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    model = Word2Vec(vectorSize=size, windowSize=window, minCount=0, seed=seed, maxIter=1, inputCol="tables", outputCol="v").fit(walks(graph, per_node, length, seed))
    return model.getVectors().select(F.col("word").alias("table_name"), vector_to_array("vector").alias("embedding"))


def zscore_rank(metrics: DataFrame, columns: list[str]) -> DataFrame:
    """``metrics`` with ``z``, the sum of the columns' z-scores (sample deviation; 0 counts as
    1), and ``position`` by it."""
    w = Window.partitionBy()
    z = None
    for c in columns:
        sd = F.stddev_samp(c).over(w)
        one = (F.col(c) - F.avg(c).over(w)) / F.when(F.coalesce(sd, F.lit(0.0)) == 0, F.lit(1.0)).otherwise(sd)
        z = one if z is None else z + one
    ranked = metrics.withColumn("z", z)
    return ranked.withColumn("position", F.row_number().over(Window.orderBy(F.round("z", 9).desc(), "table_name")))


def cluster_graph(foreign_keys: DataFrame, assignment: DataFrame, centres: DataFrame) -> DataFrame:
    """(src, dst, weight) between clusters that a key joins, weighted by their centroids'
    cosine. ``centres``: (cluster_id, centroid)."""
    from ..functions.vector import cosine

    c = assignment.select("table_name", "cluster_id")
    e = foreign_keys.join(c.select(F.col("table_name").alias("constrained_table"), F.col("cluster_id").alias("x")), "constrained_table")
    e = e.join(c.select(F.col("table_name").alias("referred_table"), F.col("cluster_id").alias("y")), "referred_table").where("x <> y")
    e = e.select(F.least("x", "y").alias("src"), F.greatest("x", "y").alias("dst")).distinct()
    v = lambda side: centres.select(F.col("cluster_id").alias(side), F.col("centroid").alias(f"v_{side}"))
    return e.join(v("src"), "src").join(v("dst"), "dst").select("src", "dst", cosine(F.col("v_src"), F.col("v_dst")).alias("weight"))


def cluster_key(names: DataFrame) -> DataFrame:
    """(cluster_id, key): a hash of each cluster's sorted tables."""
    return names.groupBy("cluster_id").agg(F.md5(F.to_json(F.array_sort(F.collect_list("table_name")))).alias("key"))


def intra_cluster_graph(foreign_keys: DataFrame, assignment: DataFrame, sims: DataFrame) -> DataFrame:
    """Complete graphs within clusters, weight half the similarity; key pairs have weight 1."""
    c = assignment.select("table_name", "cluster_id")
    a, b = c.withColumnRenamed("table_name", "src"), c.withColumnRenamed("table_name", "dst")
    inside = a.join(b, "cluster_id").where("src < dst").join(sims.select(F.col("a").alias("src"), F.col("b").alias("dst"), "sim"), ["src", "dst"])
    pairs = inside.select("src", "dst", (F.col("sim") / 2).alias("weight"))
    return pairs.unionByName(edges(foreign_keys)).groupBy("src", "dst").agg(F.max("weight").alias("weight"))
