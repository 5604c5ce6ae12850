"""Ensembles of clusterings."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import clustering as C


def together(assignment: DataFrame) -> DataFrame:
    """(a, b): pairs in one cluster, a < b."""
    c = assignment.select("table_name", "cluster_id")
    return c.select(F.col("table_name").alias("a"), "cluster_id").join(c.select(F.col("table_name").alias("b"), "cluster_id"), "cluster_id").where("a < b").select("a", "b").distinct()


def co_association(names: DataFrame, assignments: list[DataFrame], weights: list[float] | None = None) -> DataFrame:
    """(a, b, sim): weighted share of the clusterings that have a pair in one cluster."""
    weights = weights or [1 / len(assignments)] * len(assignments)
    votes = reduce(DataFrame.unionByName, [together(x).withColumn("w", F.lit(float(w))) for x, w in zip(assignments, weights, strict=True)])
    sums = votes.groupBy("a", "b").agg(F.sum("w").alias("sim"))
    n = names.select("table_name")
    pairs = n.select(F.col("table_name").alias("a")).join(n.select(F.col("table_name").alias("b")), F.col("a") < F.col("b"))
    return pairs.join(sums, ["a", "b"], "left").select("a", "b", F.coalesce("sim", F.lit(0.0)).alias("sim"))


def meta_linkage(names: DataFrame, assignments: list[DataFrame], method: str = "single") -> DataFrame:
    """Agglomerative clustering on one minus the co-association."""
    sims = co_association(names, assignments)
    return C.linkage(names, sims.select("a", "b", (1 - F.col("sim")).alias("d")), method)


def weighted_meta(names: DataFrame, first: DataFrame, second: DataFrame, alpha: float = 0.66) -> DataFrame:
    """Affinity propagation on alpha times the first and 1 - alpha times the second."""
    return C.affinity_precomputed(names, co_association(names, [first, second], [alpha, 1 - alpha]))


Clusterer = Callable[[], DataFrame]


@dataclass
class Tree:
    """A cluster tree: leaves are clusterings, inner nodes meta-clusterings of their children,
    built in dependency order as one plan."""

    names: DataFrame
    children: list[Tree | Clusterer] = field(default_factory=list)
    method: str = "single"

    def assignment(self) -> DataFrame:
        found = [c.assignment() if isinstance(c, Tree) else c() for c in self.children]
        return found[0] if len(found) == 1 else meta_linkage(self.names, found, self.method)


def flat_tree(names: DataFrame, clusterers: list[Clusterer]) -> Tree:
    return Tree(names, list(clusterers))


def grouped_tree(names: DataFrame, clusterers: list[tuple[dict[str, str], Clusterer]], levels: list[str]) -> Tree:
    """A tree in which clusterers that agree on an attribute are joined first, level by level;
    groups of one are passed on."""
    if not levels:
        return Tree(names, [c for _, c in clusterers])
    groups: dict[str, list] = {}
    for attributes, c in clusterers:
        groups.setdefault(attributes.get(levels[0], ""), []).append((attributes, c))
    return Tree(names, [grouped_tree(names, g, levels[1:]) if len(g) > 1 else g[0][1] for _, g in sorted(groups.items())])
