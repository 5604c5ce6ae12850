"""Connected components of an edge list, distributed.

Each round lowers every node's label to the smallest label among its neighbours and then
jumps to the label of that label. Labels are written to the shared checkpoint folder
between rounds. Nothing but one count per round reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, salted_join


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its local component) for every node of the edges a-b."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = np.minimum(new, new[label])
        while not np.array_equal(new, jumped := new[new]):
            new = jumped
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            node, root = forest(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            keep = node != root
            yield pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.array(root[keep])], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """``edges``: long columns a, b without nulls. Returns (node, root): every node that has
    an edge to another node, with the smallest node that it reaches.

    Self-loops and repeated edges are ignored. Groups of any size: a batch of edges is first
    replaced by a spanning forest, so a clique costs as many rows as it has members.
    """
    forested = edges.where("a <> b").select(F.col("a").cast("long"), F.col("b").cast("long"))
    forested = forested.mapInArrow(_contract, "a long, b long")
    both = forested.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
        forested.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    both = cut(both.distinct())
    total = both.count()
    labels = cut(both.groupBy("u").agg(F.least("u", F.min("v")).alias("l"), F.count("*").alias("d")))
    degrees = labels.select(F.col("u").alias("v"), "d")
    while True:
        # The edges of a hub are dealt over several tasks.
        own = labels.select(F.col("u").alias("v"), "l")
        near = salted_join(both, own, ["v"], degrees, "d", total, F.col("u"))
        near = near.groupBy("u").agg(F.min("l").alias("m"))
        lower = labels.join(near.hint("merge"), "u").select("u", F.col("l").alias("was"), F.least("l", "m").alias("l"))
        # Labels pass by no driver: hints keep joins from becoming broadcasts.
        # Many nodes come to have one label: a join of slim rows, split by AQE where it is skewed.
        jump = own.select(F.col("v").alias("l"), F.col("l").alias("j"))
        new = cut(lower.join(jump.hint("merge"), "l").select("u", "was", F.least("l", "j").alias("l")))
        changed = new.where("l <> was").limit(1).count()
        labels = new.select("u", "l")
        if not changed:
            return labels.select(F.col("u").alias("node"), F.col("l").alias("root"))
