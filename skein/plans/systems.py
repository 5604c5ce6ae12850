"""Systems that cluster a catalog's tables, and the runner that scores them."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.encoders import Encoder, HashedTfidf
from ..operators import clustering as C
from ..operators import ensemble as E
from ..operators import graph as G
from ..operators import importance as I
from ..operators import metrics as M
from ..operators import profile as P
from ..operators import roles as R
from ..operators import similarity as S
from ..operators import triplets as X
from ..sources.catalog import Catalog
from ..sources.files import log_run


@dataclass
class Context:
    """What all systems derive from a catalog; each part is one plan, built once."""

    catalog: Catalog
    encoder: Encoder
    profiled: list[str]
    floor: float = 0.5
    similar: float = 0.0
    seed: int = 43

    @cached_property
    def names(self) -> DataFrame:
        return self.catalog.tables().select("table_name")

    @cached_property
    def docs(self) -> DataFrame:
        return T.name_documents(self.catalog.columns())

    @cached_property
    def keys(self) -> DataFrame:
        return self.catalog.foreign_keys()

    @cached_property
    def vectors(self) -> DataFrame:
        return self.encoder.encode(self.docs)

    @cached_property
    def sims(self) -> DataFrame:
        """Cosine of the tables' vectors, a < b."""
        return cosine_pairs(self.vectors)

    @cached_property
    def graph(self) -> DataFrame:
        found = G.similar_edges(G.edges(self.keys), self.sims, self.floor)
        return G.with_similar(found, self.sims, self.similar) if self.similar > 0 else found

    @cached_property
    def ranked(self) -> DataFrame:
        facts = G.degree(self.names, self.graph).join(G.pagerank(self.names, self.graph), "table_name").join(G.betweenness(self.names, self.graph), "table_name")
        return G.zscore_rank(facts, ["page_rank", "degree", "betweenness"])

    @cached_property
    def references(self) -> DataFrame:
        return R.reference_tables(self.catalog.tables(), self.keys)

    @cached_property
    def value_similarity(self) -> DataFrame:
        samples = P.value_samples(self.catalog, self.profiled, 20)
        return S.all_pairs(self.names, S.value_overlap(samples))


def cosine_pairs(vectors: DataFrame) -> DataFrame:
    """(a, b, sim), a < b, of a catalog's vectors."""
    from ..functions.vector import cosine

    a = vectors.select(F.col("table_name").alias("a"), F.col("embedding").alias("x"))
    b = vectors.select(F.col("table_name").alias("b"), F.col("embedding").alias("y"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", F.coalesce(cosine(F.col("x"), F.col("y")), F.lit(0.0)).alias("sim"))


def _distances(sims: DataFrame) -> DataFrame:
    return sims.select("a", "b", (1 - F.col("sim")).alias("d"))


def clustered(vectors: DataFrame, method: str, k: int | None = None, seed: int = 43) -> DataFrame:
    simple = {"affinity": C.affinity, "dbscan": C.dbscan, "optics": C.optics}
    if method in simple:
        return simple[method](vectors)
    return C.by_k(vectors, k or C.determine_k(vectors, method, seed=seed), method, seed)


def training_pairs(c: Context) -> DataFrame:
    """(position, anchor, positive): detail pairs, then reference pairs, then entity pairs."""
    near = G.neighbours(c.graph)
    entities = R.entity_tables(c.ranked, c.references, near)
    primary = c.catalog.tables().select("table_name", "pk")
    sims = S.mirrored(c.sims)
    detail = R.detail_tables(entities, c.references, c.keys, primary)
    reference = R.reference_pairs(c.references, c.keys, sims)
    entity = R.entity_pairs(entities, near, sims)
    parts = [
        detail.select(F.lit(0).alias("position"), F.col("entity").alias("anchor"), F.col("detail").alias("positive")),
        reference.select(F.lit(1).alias("position"), F.col("reference").alias("anchor"), F.col("target").alias("positive")),
        entity.select((F.lit(2) + F.col("copy")).alias("position"), F.col("entity").alias("anchor"), F.col("neighbour").alias("positive")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def embedding_clusters(c: Context, method: str = "affinity") -> DataFrame:
    """The encoder's vectors alone."""
    return clustered(c.vectors, method, seed=c.seed)


def trained_clusters(c: Context, method: str = "affinity", margin: float = 0.3) -> DataFrame:
    """The main system: triplets from schema roles fine-tune the encoder, then clustering."""
    triplets = X.constrained_triplets(training_pairs(c), S.column_minmax(c.sims), margin)
    tuned = c.encoder.finetune(triplets, c.docs)
    return clustered(tuned.encode(c.docs), method, seed=c.seed)


def communities(c: Context) -> DataFrame:
    return C.greedy_modularity(c.names, G.edges(c.keys))


def communities_and_vectors(c: Context, alpha: float = 0.66) -> DataFrame:
    return E.weighted_meta(c.names, C.label_propagation(c.names, c.graph), C.affinity(c.vectors), alpha)


def nodes_and_edges(c: Context, alpha: float = 0.5) -> DataFrame:
    weights = c.graph.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("weight").alias("sim"))
    return E.weighted_meta(c.names, C.affinity_precomputed(c.names, weights), C.affinity(c.vectors), alpha)


def within_clusters(c: Context) -> DataFrame:
    """Vectors' clusters as complete graphs with the keys, clustered again."""
    inner = G.intra_cluster_graph(c.keys, C.affinity(c.vectors), c.sims)
    return C.affinity_precomputed(c.names, inner.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("weight").alias("sim")))


def clusters_of_clusters(c: Context) -> DataFrame:
    """Clusters joined where Louvain joins them in the graph of keys between clusters."""
    first = C.affinity(c.vectors, 0.9)
    centres = S.centroids(first.join(c.vectors, "table_name"), "cluster_id")
    g = G.cluster_graph(c.keys, first, centres).select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), "weight")
    ids = first.select(F.col("cluster_id").cast("string").alias("table_name")).distinct()
    joined = C.louvain(ids, g).select(F.col("table_name").cast("int").alias("cluster_id"), F.col("cluster_id").alias("meta"))
    return first.join(joined, "cluster_id").select("table_name", F.col("meta").alias("cluster_id"))


def walk_clusters(c: Context) -> DataFrame:
    vectors = G.node2vec(G.edges(c.keys), seed=c.seed)
    found = C.affinity(vectors)
    return M.completed(c.names, found)


def evidence_ensemble(c: Context) -> DataFrame:
    """Linkages on names and on values, divisive clusterings of the key graph; a meta-clustering
    of each kind, and one of these."""
    g = G.edges(c.keys)
    text, value = _distances(S.table_similarity(c.catalog.columns())), _distances(c.value_similarity)
    kinds = ("single", "complete", "average")
    tree = E.Tree(
        c.names,
        [
            E.Tree(c.names, [lambda k=k: C.linkage(c.names, text, k) for k in kinds]),
            E.Tree(c.names, [lambda k=k: C.linkage(c.names, value, k) for k in kinds]),
            E.Tree(c.names, [lambda h=h: C.link_clusters(c.names, g, h) for h in ("betweenness", "spectral")]),
        ],
    )
    return tree.assignment()


def given_clusters(c: Context, clusters: list[list[str]]) -> DataFrame:
    """A clustering that someone (or a language model) gave, completed by what it lacks."""
    rows = [(t.lower(), i) for i, ts in enumerate(clusters) for t in ts]
    found = c.catalog.spark.createDataFrame(rows, C.ASSIGNMENT).join(c.names, "table_name", "left_semi")
    return M.completed(c.names, found)


def table_importance(c: Context, both: bool = True, iterations: int = 50) -> DataFrame:
    """(table_name, share), by the walk along keys."""
    h = P.entropies(c.catalog, c.profiled)
    content = P.information_content(h, c.catalog.row_counts())
    return I.stationary(I.transition_matrix(c.names, h, content, c.keys, both), iterations)


SYSTEMS: dict[str, Callable[[Context], DataFrame]] = {
    "trained": trained_clusters,
    "embedding": embedding_clusters,
    "communities": communities,
    "communities_and_vectors": communities_and_vectors,
    "nodes_and_edges": nodes_and_edges,
    "within_clusters": within_clusters,
    "clusters_of_clusters": clusters_of_clusters,
    "walks": walk_clusters,
    "evidence": evidence_ensemble,
}


def run(c: Context, system: str, truth: DataFrame, scenario: str = "", log: str | None = None) -> DataFrame:
    """(name, value): the measures of a system's clustering; errors propagate."""
    began = time.time()
    found = SYSTEMS[system](c)
    measures = M.report(truth, found)
    if log:
        log_run(measures, log, scenario, system, time.time() - began)
    return measures


def context(catalog: Catalog, profiled: list[str] | None = None, encoder: Encoder | None = None) -> Context:
    return Context(catalog, encoder or HashedTfidf(), profiled or catalog.names)
