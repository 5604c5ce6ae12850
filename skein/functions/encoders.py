"""Encoders of table texts to vectors: a plug-in interface with a deterministic default."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from . import vector as V


class Encoder(Protocol):
    def encode(self, docs: DataFrame) -> DataFrame:
        """(table_name, embedding) of (table_name, doc)."""

    def finetune(self, triplets: DataFrame, docs: DataFrame) -> Encoder:
        """An encoder adapted to (anchor, positive, negative) names."""


def hashed_entries(docs: DataFrame, key: str, tokens, size: int) -> DataFrame:
    """(key, entries): TF-IDF weights of the tokens, summed with hashed signs in hashed slots;
    entries are (slot, x) by slot, null for a row without tokens."""
    from ..operators.similarity import tfidf

    terms = tfidf(docs, tokens, key)
    slot = F.pmod(F.xxhash64("term"), F.lit(size)).cast("int")
    sign = F.when(F.xxhash64(F.lit("sign"), "term").bitwiseAND(F.lit(1)) == 1, 1.0).otherwise(-1.0)
    sums = terms.groupBy(key, slot.alias("slot")).agg(F.sum(F.col("tfidf") * sign).alias("x"))
    return docs.select(key).join(sums.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("slot", "x"))).alias("entries")), key, "left")


def hashed_tfidf(docs: DataFrame, key: str, tokens, size: int) -> DataFrame:
    """(key, embedding): ``hashed_entries`` as vectors of all ``size`` entries."""
    return hashed_entries(docs, key, tokens, size).select(key, V.dense(F.col("entries"), size).alias("embedding"))


class HashedTfidf:
    """TF-IDF of identifier tokens, hashed with signs to ``size`` dimensions, unit length; and,
    after fine-tuning, a linear map learned with a triplet hinge loss."""

    def __init__(self, size: int = 256, matrix: np.ndarray | None = None) -> None:
        self.size, self.matrix = size, matrix

    def encode(self, docs: DataFrame) -> DataFrame:
        out = hashed_tfidf(docs, "table_name", T.identifier_tokens(F.col("doc")), self.size)
        return out if self.matrix is None else self._mapped(out)

    def _mapped(self, vectors: DataFrame) -> DataFrame:
        matrix = self.matrix

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                x = np.array(pdf.embedding.tolist()) @ matrix
                x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-10)
                yield pd.DataFrame({"table_name": pdf.table_name, "embedding": list(x)})

        return vectors.mapInPandas(run, "table_name string, embedding array<double>")

    def finetune(self, triplets: DataFrame, docs: DataFrame, margin: float = 0.5, rate: float = 0.05, epochs: int = 4) -> HashedTfidf:
        vectors = self.encode(docs)
        rows = triplets
        for c in ("anchor", "positive", "negative"):
            rows = rows.join(vectors.select(F.col("table_name").alias(c), F.col("embedding").alias(f"v_{c}")), c)
        got = rows.select("v_anchor", "v_positive", "v_negative").toPandas()  # as many as triplets of a catalog's tables
        m = np.eye(self.size) if self.matrix is None else self.matrix.copy()
        a, p, n = (np.array(got[c].tolist()).reshape(-1, self.size) for c in got.columns)
        for _ in range(epochs):
            for i in range(0, len(a), 32):
                x, y, z = a[i : i + 32], p[i : i + 32], n[i : i + 32]
                dy, dz = (x - y) @ m, (x - z) @ m
                active = (dy**2).sum(axis=1) - (dz**2).sum(axis=1) + margin > 0
                if active.any():
                    grad = 2 * ((x - y)[active].T @ dy[active] - (x - z)[active].T @ dz[active]) / active.sum()
                    m -= rate * grad
        return HashedTfidf(self.size, m)


class PromptDescriber:
    """Describes tables by their rendered prompt; the place for a language model."""

    def __init__(self, kind: str = "plain") -> None:
        self.template = T.PROMPTS[kind]

    def describe(self, facts: DataFrame) -> DataFrame:
        """(table_name, doc) of facts with columns named as the prompt's variables."""
        values = {c: F.col(c).cast("string") for c in facts.columns}
        return facts.select("table_name", T.rendered(self.template, **values).alias("doc"))
