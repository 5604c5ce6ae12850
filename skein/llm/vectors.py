"""Near-duplicate vectors by a robust-pruned flat graph.

Vectors are dealt to the shards of their nearest few centroids, so shards overlap. Every shard
builds a flat graph: candidate neighbours, robust-pruned so that a kept neighbour is not
hidden behind a nearer one. The adjacency lists that a vector has in several shards are
united. A vector asks the shard of its nearest centroid, its home, and the homes of all vectors
in range of it in any of its shards. A shard searches from its medoid, greedily and in step for
all that ask; once within range the search widens to everything in range that the lists reach.
The homes of what it finds are asked next, until nobody reaches another shard, so a dense
cluster that is cut in many shards is walked whole. A partner counts in its home only, hence
once. What is found is verified by cosine in double precision, and recall is audited against
brute force for a sample of queries.

Equal vectors are one node with a count. A shard beyond ``most`` vectors is searched in blocks
of that size and asked by ``asked`` vectors at a time, so a dense cluster needs no more memory,
only more tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, stored, table
from .components import components, forest


@dataclass(frozen=True)
class Graph:
    """``sample``: largest number of vectors that centroids are fitted on; ``shard``: vectors a
    centroid should have; ``overlap``: centroids a vector goes to; ``asked``: vectors that a
    search task takes; ``recall``: least share of links in an audit."""

    threshold: float = 0.95
    sample: int = 20_000
    shard: int = 1_000
    overlap: int = 3
    most: int = 8_000
    asked: int = 2_000
    degree: int = 24
    candidates: int = 48
    jumps: int = 6
    alpha: float = 1.2
    beam: int = 32
    audit: int = 64
    recall: float = 0.9
    seed: int = 3


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def centroids(sample: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Spherical k-means on unit vectors."""
    rng = np.random.default_rng(seed)
    c = sample[rng.choice(len(sample), min(k, len(sample)), replace=False)]
    for _ in range(8):
        own = np.concatenate([(sample[i : i + 4096] @ c.T).argmax(axis=1) for i in range(0, len(sample), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, own, sample)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 1e-9, total / np.maximum(norm, 1e-9), c)
    return c


def pruned(x: np.ndarray, at: int, near: np.ndarray, g: Graph) -> np.ndarray:
    """Robust pruning: of the candidates, nearest first, those not much nearer to one kept."""
    near = near[near != at]
    distance = np.round(1.0 - x[near] @ x[at], 9)
    order = np.lexsort(((near - at) % len(x), distance))  # ties: each node has others first
    near, distance = near[order], distance[order]
    between = np.round(1.0 - x[near] @ x[near].T, 9)
    alive, kept = np.ones(len(near), bool), []
    for i in range(len(near)):
        if alive[i]:
            kept.append(i)
            if len(kept) == g.degree:
                break
            alive &= ~(g.alpha * between[i] < distance)
    return near[kept]


def adjacency(x: np.ndarray, home: np.ndarray, g: Graph) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The shard's graph: lists pruned from the nearest vectors and some far ones, and besides
    a few random nodes in range, so that a dense cluster is crossed in few steps. And for each
    vector the homes of all in range."""
    n, rng = len(x), np.random.default_rng(g.seed)
    out: list[np.ndarray] = []
    reach: list[np.ndarray] = []
    take = min(g.candidates, n - 1)
    for lo in range(0, n, 1024):
        sims = x[lo : lo + 1024] @ x.T
        turn = (np.arange(n)[None] - np.arange(lo, lo + len(sims))[:, None]) % n
        sims -= turn * (1e-8 / n)
        top = np.argpartition(-sims, take, axis=1)[:, : take + 1] if take else np.zeros((len(sims), 1), int)
        far = rng.integers(0, n, (len(sims), 8))
        for i, near in enumerate(np.concatenate([top, far], axis=1)):
            within = np.flatnonzero(sims[i] >= g.threshold - 1e-6)
            reach.append(np.unique(home[within]))
            jumps = within[rng.integers(0, len(within), g.jumps)] if len(within) > g.degree else within[:0]
            out.append(np.union1d(pruned(x, lo + i, np.unique(near), g), jumps))
    return out, reach


def reversed_too(x: np.ndarray, lists: list[np.ndarray], g: Graph) -> list[np.ndarray]:
    """The lists with reverse edges, pruned again where they are too many."""
    src = np.repeat(np.arange(len(lists)), [len(v) for v in lists])
    dst = np.concatenate(lists) if lists else np.zeros(0, int)
    both = np.unique(np.stack([np.concatenate([src, dst]), np.concatenate([dst, src])]), axis=1)
    starts = np.searchsorted(both[0], np.arange(len(lists) + 1))
    out = []
    for i in range(len(lists)):
        near = both[1][starts[i] : starts[i + 1]]
        out.append(near if len(near) <= 4 * g.degree else pruned(x, i, near, g))
    return out


def searched(x: np.ndarray, lists: list[np.ndarray], queries: np.ndarray, g: Graph) -> Iterator[tuple[int, np.ndarray]]:
    """For each query (place in ``x``, or a vector), the nodes in range that the search finds."""
    n = len(x)
    width = max((len(v) for v in lists), default=0)
    table = np.full((n, max(1, width)), -1, np.int64)
    for i, v in enumerate(lists):
        table[i, : len(v)] = v
    medoid = int((x @ unit(x.mean(axis=0, keepdims=True) + 1e-12)[0]).argmax())
    for lo in range(0, len(queries), 256):
        q = queries[lo : lo + 256]
        m = len(q)
        seen = np.zeros((m, n), bool)
        beam = np.full((m, g.beam), -1)
        score = np.full((m, g.beam), -np.inf)
        beam[:, 0], score[:, 0], seen[:, medoid] = medoid, q @ x[medoid], True
        done = np.zeros((m, n), bool)
        rows = np.arange(m)
        while True:
            open_score = np.where((beam >= 0) & ~done[rows[:, None], beam], score, -np.inf)
            pick = open_score.argmax(axis=1)
            live = np.flatnonzero(open_score[rows, pick] > -np.inf)
            if not len(live):
                break
            node = beam[live, pick[live]]
            done[live, node] = True
            near = table[node]
            fresh = (near >= 0) & ~seen[live[:, None], near]
            sims = np.einsum("rd,rkd->rk", q[live], x[near])
            r, k = np.nonzero(fresh)
            seen[live[r], near[r, k]] = True
            joined = np.concatenate([beam[live], np.where(fresh, near, -1)], axis=1)
            scores = np.concatenate([score[live], np.where(fresh, sims, -np.inf)], axis=1)
            best = np.argsort(-scores, axis=1)[:, : g.beam]
            beam[live] = np.take_along_axis(joined, best, 1)
            score[live] = np.take_along_axis(scores, best, 1)
        for i in range(m):
            # Widen from what the beam has in range until the lists reach nothing more in range.
            found = beam[i][score[i] >= g.threshold - 1e-6]
            tried = np.zeros(n + 1, bool)  # the last place is that of -1
            tried[found] = tried[-1] = True
            front = found
            while len(front):
                near = np.zeros(n + 1, bool)
                near[table[front]] = True
                near = np.flatnonzero(near & ~tried)
                tried[near] = True
                front = near[x[near] @ q[i] >= g.threshold - 1e-6]
                found = np.concatenate([found, front])
            yield lo + i, found


def _scaled(vec_col: str) -> Column:
    """The vector over its largest component, so that no square leaves the range of doubles; null
    for one that links with nothing (null, zero, or with a null or a number that isn't finite)."""
    v = F.transform(vec_col, lambda c: c.cast("double"))
    most = F.array_max(F.transform(v, F.abs))
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.when(~bad & (most > 0), F.transform(v, lambda c: c / most))


def _nodes(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(node, v, n): classes of equal usable vectors, by their smallest id, and their sizes."""
    usable = vectors.select(F.col(id_col).cast("long").alias("id"), _scaled(vec_col).alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    return usable.groupBy("v").agg(F.min("id").alias("node"), F.count("*").alias("n"))


def _assigned(nodes: DataFrame, centre: np.ndarray, g: Graph) -> DataFrame:
    """(node, n, v, c, home): each node in the shards of its nearest centroids."""
    sent = nodes.sparkSession.sparkContext.broadcast(centre)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        for b in batches:
            if not b.num_rows:
                continue
            x = unit(np.array(b.column(2).to_pylist(), np.float64))
            k = min(g.overlap, len(c))
            near = np.argsort(-(x @ c.T), axis=1, kind="stable")[:, :k]
            rows = np.repeat(np.arange(len(x)), k)
            home = np.repeat(near[:, 0], k)
            columns = [b.column(0).take(pa.array(rows)), b.column(1).take(pa.array(rows))]
            columns += [pa.array(list(x[rows]), pa.list_(pa.float64())), pa.array(near.reshape(-1).astype(np.int32)), pa.array(home.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["node", "n", "v", "c", "home"])

    return nodes.select("node", "n", "v").mapInArrow(run, "node long, n long, v array<double>, c int, home int")


def _matrix(t: pa.Table) -> np.ndarray:
    flat = t["v"].combine_chunks()
    return np.asarray(flat.values).reshape(len(flat), -1)


def linked(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", graph: Graph | None = None) -> DataFrame:
    """(id, n_links, component_id, kept), a row for each row of ``vectors``.

    Vectors that are null, zero, or hold a null or a number that isn't finite link with nothing
    (0 links, their own component), and so does a row with a null id. Vectors of several lengths
    are linked within each length. Rows that repeat an id and a vector count each. Ids are
    integers. An empty table gives an empty result, and a table of one vector no links.
    """
    g = graph or Graph()
    nodes = cut(_nodes(vectors, id_col, vec_col))
    named = nodes.select("v", F.col("n").alias("n_links"), F.col("node").alias("root")).where("false")
    for d, total in sorted(map(tuple, nodes.groupBy(F.size("v")).count().collect())):  # a row for each length
        named = named.union(_named(nodes.where(F.size("v") == d), total, g))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), _scaled(vec_col).alias("w"))
    joined = rows.join(named, (F.col("w") == F.col("v")) & F.col("id").isNotNull(), "left")
    component = F.coalesce("root", "id")
    return joined.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def _named(nodes: DataFrame, total: int, g: Graph) -> DataFrame:
    """(v, n_links, root) of ``nodes`` (``total`` rows, of one length)."""
    rate = min(1.0, g.sample / total)
    draw = F.pmod(F.xxhash64(F.lit(g.seed), "node"), F.lit(1 << 30)) / float(1 << 30)
    some = nodes.where(draw < rate).orderBy("node").select("v").limit(int(1.2 * g.sample) + 1).toPandas()
    few = unit(np.array(some["v"].tolist())) if len(some) else unit(np.array([nodes.first()["v"]]))
    centre = centroids(few, max(1, min(total // g.shard, len(few) // 8)), g.seed)
    shards = cut(_assigned(nodes, centre, g))
    found = _walked(shards, *_united(shards, g), g)
    total_links = found.groupBy("node").agg(F.sum("n_links").alias("n_links"))
    joined = components(found.where("root <> node").select(F.col("node").alias("a"), F.col("root").alias("b")))
    joined = joined.withColumnRenamed("node", "member")
    both = nodes.join(total_links, "node", "left").join(joined, F.col("node") == F.col("member"), "left")
    return both.select("v", (F.coalesce("n_links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"))


def _lists(near: pa.ChunkedArray, ids: np.ndarray) -> list[np.ndarray]:
    """Lists of ids as places in ``ids``, without what isn't there."""
    flat = near.combine_chunks()
    v, ends = np.asarray(flat.values), np.asarray(flat.offsets)
    order = np.argsort(ids)
    at = order[np.searchsorted(ids[order], v).clip(max=len(ids) - 1)]
    there = ids[at] == v
    return [at[lo:hi][there[lo:hi]] for lo, hi in zip(ends[:-1], ends[1:], strict=True)]


def _united(shards: DataFrame, g: Graph) -> tuple[DataFrame, DataFrame]:
    """``shards`` in blocks (c, block) of ``most`` vectors at most, with the block's graph made
    of each node's united adjacency list; and (node, c), the shards that a node asks first."""
    sizes = shards.groupBy("c").agg(F.count("*").alias("size"))  # a row for each centroid
    parts = F.ceil(F.col("size") / g.most).cast("int")
    split = shards.join(F.broadcast(sizes), "c").withColumn("parts", parts)
    split = split.withColumn("block", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))

    def build(t: pa.Table) -> pa.Table:
        x, ids = _matrix(t), t["node"].to_numpy()
        lists, reach = adjacency(x, t["home"].to_numpy(), g)
        return pa.table({"node": t["node"], "near": pa.array([ids[v] for v in lists], pa.list_(pa.int64())), "reach": pa.array(reach, pa.list_(pa.int32()))})

    built = split.select("c", "block", "node", "v", "home").groupBy("c", "block").applyInArrow(build, "node long, near array<long>, reach array<int>")
    built = stored(built)
    near, reach = (F.array_distinct(F.flatten(F.collect_list(k))).alias(k) for k in ("near", "reach"))
    united = cut(built.groupBy("node").agg(near, reach))  # a row of each list for each of few shards

    def ready(t: pa.Table) -> pa.Table:
        ids = t["node"].to_numpy()
        lists = reversed_too(_matrix(t), _lists(t["near"], ids), g)
        return t.set_column(t.schema.get_field_index("near"), "near", pa.array([ids[v] for v in lists], pa.list_(pa.int64())))

    columns = ["c", "block", "parts", "node", "n", "v", "home", "near"]
    joined = split.join(united.select("node", "near"), "node").select(*columns)
    graph = joined.groupBy("c", "block").applyInArrow(ready, "c int, block int, parts int, node long, n long, v array<double>, home int, near array<long>")
    return cut(graph), cut(united.select("node", F.explode("reach").alias("c")))


def _walked(shards: DataFrame, graph: DataFrame, asks: DataFrame, g: Graph) -> DataFrame:
    """(node, n_links, root): links counted at each shard that a node asks, and edges of
    components. Shards that a node hears of are asked in the next round, each once."""
    points = shards.where("c = home").select("node", "v")
    done, found = asks, None
    while asks.limit(1).count():
        new = cut(_search(graph, points.join(asks, "node"), g))
        found = new if found is None else found.union(new)
        heard = new.select("node", F.explode("reach").alias("c")).distinct()
        asks = cut(heard.join(done, ["node", "c"], "left_anti"))
        done = done.union(asks)
    return found.select("node", "n_links", "root")


def _search(graph: DataFrame, asks: DataFrame, g: Graph) -> DataFrame:
    """(node, n_links, root, reach): for ``asks`` (node, v, c) what shard c has in range."""
    sizes = asks.groupBy("c").agg(F.ceil(F.count("*") / g.asked).cast("int").alias("turns"))
    parts = graph.groupBy("c").agg(F.max("parts").alias("parts"))
    shape = F.broadcast(cut(sizes.join(parts, "c")))  # a row for each centroid
    turns = F.explode(F.sequence(F.lit(0), F.col("turns") - 1))
    base = graph.drop("parts").join(shape, "c").select("c", turns.alias("i"), F.col("block").alias("j"), "node", "n", "v", "home", "near", F.lit(False).alias("ask"))
    turn = F.pmod(F.xxhash64("node"), F.col("turns")).cast("int")
    blocks = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    none = F.array().cast("array<bigint>")
    ask = asks.join(shape, "c").select("c", turn.alias("i"), blocks.alias("j"), "node", F.lit(0).cast("long").alias("n"), "v", F.lit(0).alias("home"), none.alias("near"), F.lit(True).alias("ask"))

    def search(t: pa.Table) -> pa.Table:
        asked = t["ask"].to_numpy()
        base, query = t.filter(pa.array(~asked)), t.filter(pa.array(asked))
        x, ids, n, q = _matrix(base), base["node"].to_numpy(), base["n"].to_numpy(), _matrix(query)
        q_ids, home, c = query["node"].to_numpy(), base["home"].to_numpy(), t["c"][0].as_py()
        counts, a, b, size = np.zeros(len(q), np.int64), [q_ids[:0]], [q_ids[:0]], 0
        reach: list[np.ndarray] = [home[:0]] * len(q)
        if len(base):
            for i, found in searched(x, _lists(base["near"], ids), q, g):
                exact = found[(x[found] @ q[i]) >= g.threshold]
                exact = exact[ids[exact] != q_ids[i]]
                counts[i] = n[exact[home[exact] == c]].sum()
                reach[i] = np.unique(home[exact])
                a.append(np.full(len(exact), q_ids[i]))
                b.append(ids[exact])
                size += len(exact)
                if size > 1 << 20:
                    node, root = forest(np.concatenate(a), np.concatenate(b))
                    a, b, size = [node], [root], 0
        node, root = forest(np.concatenate(a), np.concatenate(b))
        # Links of a query, and a spanning forest of all links: a row for each node at most.
        counts, roots = np.concatenate([counts, np.zeros(len(node), np.int64)]), np.concatenate([q_ids, root])
        return pa.table({"node": np.concatenate([q_ids, node]), "n_links": counts, "root": roots, "reach": pa.array(reach + [home[:0]] * len(node), pa.list_(pa.int32()))})

    return base.union(ask).groupBy("c", "i", "j").applyInArrow(search, "node long, n_links long, root long, reach array<int>")


def audit(vectors: DataFrame, found: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", graph: Graph | None = None) -> float:
    """Share of the links of a sample of vectors, found by brute force, that ``found`` counts."""
    g = graph or Graph()
    nodes = _nodes(vectors, id_col, vec_col)
    some = nodes.orderBy(F.xxhash64(F.lit(g.seed), "node")).limit(g.audit).select("node", "v").collect()
    if not some:
        return 1.0
    asked: dict[int, list] = {}
    for r in some:
        asked.setdefault(len(r["v"]), []).append((r["node"], r["v"]))
    sent = vectors.sparkSession.sparkContext.broadcast({d: (np.array([i for i, _ in x]), unit(np.array([v for _, v in x]))) for d, x in asked.items()})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = b.column(1).value_lengths().to_numpy()
            for d, (ids, q) in sent.value.items():
                own = np.flatnonzero(size == d)
                if len(own):
                    hit = (unit(np.array(b.column(1).take(pa.array(own)).to_pylist())) @ q.T >= g.threshold).T
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(hit @ b.column(0).to_numpy()[own])], ["id", "k"])

    true = nodes.select("n", "v").mapInArrow(count, "id long, k long").groupBy("id").agg((F.sum("k") - 1).alias("true"))
    both = true.join(found.select("id", "n_links"), "id").agg(F.sum("true"), F.sum(F.least("true", "n_links"))).first()
    return both[1] / both[0] if both[0] else 1.0


def audited(vectors: DataFrame, found: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", graph: Graph | None = None) -> float:
    """``audit``; raises if that is less than ``recall``."""
    share = audit(vectors, found, id_col, vec_col, graph)
    if share < (least := (graph or Graph()).recall):
        raise RuntimeError(f"the audit found {share:.3f} of the links, less than {least}")
    return share


def op8_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found = cut(linked(vectors))
    return found.withColumn("audit_recall", F.lit(audited(vectors, found))).withColumnRenamed("id", "vec_id")
