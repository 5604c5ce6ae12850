"""Toxicity by a chain of linear classifiers.

Label columns are predicted one after the other; each model is a logistic regression on the
words of a text (whole and by their first characters, so that inflected forms of a stem agree)
and a few shape figures, and on the probabilities of the labels before it. These are
out-of-fold predictions in training, so a later model sees what it will see in use.

The models are fitted on the driver from a bounded sample: of each combination of labels at
most about ``per_class`` documents, by hash; of these only hashed features are sent.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches, arrow_map, table

PUNCTUATION = ".,;:!?\"'()[]{}|*#$%&<>-_…»«"
CACHE = 50_000


@dataclass(frozen=True)
class Chain:
    labels: tuple[str, ...] = ("quality", "toxic")
    per_class: int = 2000
    features: int = 500
    folds: int = 4
    penalty: float = 1e-4
    steps: int = 300
    seed: int = 5


def word_features(word: str) -> list[int]:
    """Hashes of the word without outer punctuation and of its first 4, 5 and 6 characters."""
    w = word.strip(PUNCTUATION)
    if not w:
        return []
    out = [zlib.crc32(w.encode("utf-8", "replace"))]
    out += [zlib.crc32(b"\x01" + w[:k].encode("utf-8", "replace")) for k in (4, 5, 6) if len(w) >= k]
    return out


def shape(text: str, words: list[str], distinct: int) -> list[float]:
    """Figures on the look of a text."""
    n, size = max(1, len(words)), max(1, len(text))
    marks = sum(map(text.count, "!#*$%&|<>"))
    upper = sum(map(str.isupper, text)) / size
    return [np.log1p(len(words)), distinct / n, size / n / 10, marks / size, upper, text.count("\n") / n]


N_SHAPE = 6


def _parts(raw: bytes | None) -> tuple[str, list[str], set[str]]:
    text = (raw or b"").decode("utf-8", "replace")
    words = text.lower().split()
    return text, words, set(words)


@dataclass
class Design:
    """Rows of ones in some of ``width`` columns, and of dense figures after those."""

    ones: list[np.ndarray]
    width: int
    dense: np.ndarray

    def __post_init__(self) -> None:
        self.flat = np.concatenate([*self.ones, np.zeros(0, np.int64)]).astype(np.int64)
        self.row = np.repeat(np.arange(len(self.ones)), [len(x) for x in self.ones])

    def take(self, rows: np.ndarray) -> Design:
        return Design([self.ones[i] for i in np.flatnonzero(rows)], self.width, self.dense[rows])

    def times(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, v[self.flat], len(self.ones)) + self.dense @ v[self.width :]

    def transposed(self, e: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(self.flat, e[self.row], self.width), self.dense.T @ e])


@dataclass
class Linear:
    weight: np.ndarray
    bias: float

    def logit(self, x: Design) -> np.ndarray:
        return x.times(self.weight) + self.bias


def logistic(x: Design, y: np.ndarray, weight: np.ndarray, chain: Chain) -> Linear:
    """L2-penalised logistic regression by accelerated gradient steps."""
    d = x.width + x.dense.shape[1]
    share = weight / weight.sum()
    u = np.ones(d)
    for _ in range(20):  # the largest eigenvalue of the weighted second moments bounds the curvature
        u = x.transposed(share * x.times(u / (np.linalg.norm(u) + 1e-12)))
    rate = 4.0 / (1.1 * float(np.linalg.norm(u)) + 1.0)
    w = v = np.zeros(d + 1)
    for k in range(chain.steps):
        p = 1 / (1 + np.exp(-np.clip(x.times(v[:d]) + v[d], -30, 30)))
        e = (p - y) * share
        new = v - rate * np.append(x.transposed(e) + chain.penalty * v[:d], e.sum())
        v = new + (k / (k + 3)) * (new - w)
        w = new
    return Linear(w[:d], float(w[d]))


@dataclass
class Model:
    """A fitted chain: the selected features' columns, scaling, a model and a threshold each, and
    the out-of-fold probabilities of the sample, which are not sent to executors."""

    labels: tuple[str, ...]
    column: dict[int, int]
    centre: np.ndarray
    scale: np.ndarray
    linear: list[Linear]
    threshold: list[float]
    outside: np.ndarray | None = None
    cache: dict[str, tuple[int, ...]] = field(default_factory=dict)

    def columns(self, words: set[str]) -> list[int]:
        if len(self.cache) > CACHE:
            self.cache.clear()
        known, found = self.cache, set()
        for w in words:
            at = known.get(w)
            if at is None:
                at = known[w] = tuple(c for h in word_features(w) if (c := self.column.get(h)) is not None)
            if at:
                found.update(at)
        return list(found)

    def score(self, texts: Sequence) -> np.ndarray:
        """(texts, labels): probabilities, each label's from the text and the ones before."""
        d = len(self.column)
        out = np.zeros((len(texts), len(self.labels)))
        for i, raw in enumerate(texts):
            text, words, distinct = _parts(raw.as_py() if isinstance(raw, pa.Scalar) else raw)
            at = self.columns(distinct)
            s = (np.array(shape(text, words, len(distinct))) - self.centre) / self.scale
            for k, m in enumerate(self.linear):
                z = m.bias + m.weight[at].sum() + s @ m.weight[d : d + N_SHAPE] + out[i, :k] @ m.weight[d + N_SHAPE :]
                out[i, k] = 1 / (1 + np.exp(-min(30.0, max(-30.0, float(z)))))
        return out


class Features:
    """Which document has which hashed feature, and which features tell most about a label."""

    def __init__(self, hashes: list[np.ndarray]) -> None:
        every = np.concatenate([*hashes, np.zeros(0, np.uint32)])
        self.kinds, self.at = np.unique(every, return_inverse=True)
        self.sizes = [len(h) for h in hashes]
        self.row = np.repeat(np.arange(len(hashes)), self.sizes)

    def selected(self, y: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
        """Numbers of the features whose presence in ``rows`` tells most about ``y``: by the
        z-score of the log odds ratio."""
        at, label = self.at[rows[self.row]], y[self.row][rows[self.row]]
        pos = np.bincount(at, label, len(self.kinds)) + 0.5
        neg = np.bincount(at, 1 - label, len(self.kinds)) + 0.5
        n_pos, n_neg = y[rows].sum() + 1, (1 - y[rows]).sum() + 1
        odds = np.log(pos / (n_pos - pos + 0.5)) - np.log(neg / (n_neg - neg + 0.5))
        z = np.abs(odds) / np.sqrt(1 / pos + 1 / neg)
        z[pos + neg < 4] = 0
        best = np.argsort(-z, kind="stable")[:n]
        return best[z[best] > 2]

    def chosen(self, y: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
        """The features selected for any label, from ``rows`` alone."""
        return np.unique(np.concatenate([self.selected(y[:, k], rows, n) for k in range(y.shape[1])]))

    def ones(self, chosen: np.ndarray) -> list[np.ndarray]:
        """For each document the places in ``chosen`` of the features that it has."""
        place = np.full(len(self.kinds), -1)
        place[chosen] = np.arange(len(chosen))
        found = place[self.at]
        return [x[x >= 0] for x in np.split(found, np.cumsum(self.sizes)[:-1])]


def best_threshold(p: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """Threshold of fewest weighted errors, half-way to the next probability; never under a
    half, as what is flagged is lost."""
    order = np.argsort(p)
    p, y, weight = p[order], y[order], weight[order]
    missed = np.concatenate([[0], np.cumsum(weight * y)])
    false = np.concatenate([(weight * (1 - y))[::-1].cumsum()[::-1], [0]])
    edges = np.concatenate([[0.0], (p[1:] + p[:-1]) / 2, [1.0]])
    errors = missed + false
    best = np.flatnonzero(errors == errors.min())
    return float(np.clip(edges[best].mean(), 0.5, 0.95))


def fit(hashes: list[np.ndarray], shapes: np.ndarray, y: np.ndarray, weight: np.ndarray, chain: Chain) -> Model:
    """``y``: (documents, labels) of 0 and 1; ``weight``: what each sampled document stands for."""
    n, n_labels = y.shape
    known = Features(hashes)
    centre, scale = shapes.mean(axis=0), shapes.std(axis=0) + 1e-6
    dense = (shapes - centre) / scale
    fold = np.random.default_rng(chain.seed).permutation(n) % chain.folds
    # A fold's features are chosen from the other folds, so that its labels stay unseen.
    outer = [known.chosen(y, fold != f, chain.features) for f in range(chain.folds)]
    rows = [known.ones(c) for c in outer]
    every = known.chosen(y, np.ones(n, bool), chain.features)
    ones = known.ones(every)
    linear, thresholds = [], []
    for k in range(n_labels):
        t = y[:, k]
        outside = np.full(n, t.mean())
        for f in range(chain.folds):
            test = fold == f
            if test.any() and (~test).any():
                part = Design(rows[f], len(outer[f]), dense)
                m = logistic(part.take(~test), t[~test], weight[~test], chain)
                outside[test] = 1 / (1 + np.exp(-np.clip(m.logit(part.take(test)), -30, 30)))
        linear.append(logistic(Design(ones, len(every), dense), t, weight, chain))
        thresholds.append(best_threshold(outside, t, weight))
        dense = np.concatenate([dense, outside[:, None]], axis=1)
    column = {int(h): i for i, h in enumerate(known.kinds[every])}
    return Model(chain.labels, column, centre, scale, linear, thresholds, dense[:, -n_labels:])


def sample(docs: DataFrame, labels: DataFrame, chain: Chain) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Hashed features, shapes, labels and weights of the bounded sample."""
    names = list(chain.labels)
    full = labels.select("doc_id", *[F.col(k).cast("int").alias(k) for k in names]).dropna()
    full = full.where(" AND ".join(f"{k} IN (0, 1)" for k in names))
    # Rows that repeat an id's labels are one; an id whose labels contradict each other is left out.
    agree = [c for k in names for c in (F.min(k).alias(k), F.max(k).alias(f"{k}_most"))]
    full = full.groupBy("doc_id").agg(*agree).where(" AND ".join(f"{k} = {k}_most" for k in names)).select("doc_id", *names)
    counts = {tuple(r[k] for k in names): r["n"] for r in full.groupBy(*names).agg(F.count("*").alias("n")).collect()}
    if not counts:
        return [], np.zeros((0, N_SHAPE)), np.zeros((0, len(names))), np.zeros(0)
    rate = {c: min(1.0, chain.per_class / n) for c, n in counts.items()}
    code = F.concat_ws(",", *names)
    rates = F.create_map(*[F.lit(x) for c, r in rate.items() for x in (",".join(map(str, c)), r)])
    draw = F.pmod(F.xxhash64(F.lit(chain.seed), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    some = full.where(draw < rates[code])
    joined = docs.select("doc_id", F.col("text").cast("binary").alias("t")).join(F.broadcast(some), "doc_id")
    # One text an id, the least of several, so that the sample is bounded whatever repeats.
    joined = joined.groupBy("doc_id", *names).agg(F.min("t").alias("t"))

    def features(b: pa.RecordBatch) -> pa.RecordBatch:
        hashed, shapes = [], []
        for raw in b.column(0):
            text, words, distinct = _parts(raw.as_py())
            found = {h for w in distinct for h in word_features(w)}
            hashed.append(np.array(sorted(found), np.uint32).tobytes())
            shapes.append(shape(text, words, len(distinct)))
        columns = [pa.array(hashed, pa.binary()), pa.array(shapes, pa.list_(pa.float64())), *b.columns[1:]]
        return pa.RecordBatch.from_arrays(columns, ["h", "s", *names])

    schema = "h binary, s array<double>, " + ", ".join(f"{k} int" for k in names)
    rows = arrow_map(joined.select("t", *names), features, schema).collect()
    rows = sorted((tuple(r[k] for k in names), bytes(r["h"]), tuple(r["s"])) for r in rows)
    y = np.array([r[0] for r in rows], float).reshape(-1, len(names))
    weight = np.array([1 / rate[r[0]] for r in rows])
    return [np.frombuffer(r[1], np.uint32) for r in rows], np.array([r[2] for r in rows]).reshape(-1, N_SHAPE), y, weight


def scored(docs: DataFrame, labels: DataFrame, chain: Chain | None = None) -> DataFrame:
    """``docs`` (with doc_id, text) and a column p_<label> and is_<label> for each label.

    ``labels`` has doc_id and a column of 0 and 1 for each label; rows with other values or
    nulls are not learned from, nor are ids whose rows contradict each other. Of several texts
    with one id the least is learned from. A null text counts as empty; empty texts get the probability of
    their shape. If no document is labelled all probabilities are 0 and nothing is flagged.
    Rows are scored alone and whole, repeated rows alike; columns of the same names are
    replaced.
    """
    chain = chain or Chain()
    hashes, shapes, y, weight = sample(docs, labels, chain)
    model = fit(hashes, shapes, y, weight, chain) if len(y) else None
    if model:
        model.outside = None
    sent = docs.sparkSession.sparkContext.broadcast(model)
    new = [*(f"p_{k}" for k in chain.labels), *(f"is_{k}" for k in chain.labels)]
    kept = [c for c in docs.columns if c not in new]
    schema = docs.select(*kept).schema
    for k in new:
        schema = schema.add(k, "double" if k.startswith("p_") else "boolean")

    at = kept.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for b in batches:
            texts = b.column(at).cast(pa.binary())  # invalid UTF-8 must not fail
            p = model.score(texts) if model else np.zeros((b.num_rows, len(chain.labels)))
            cutoffs = model.threshold if model else [2.0] * len(chain.labels)
            flags = p > np.array(cutoffs)
            columns = [*b.columns, *map(pa.array, p.T.copy()), *map(pa.array, flags.T.copy())]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in schema])

    return arrow_batches(docs.select(*kept), run, schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = scored(docs.select("doc_id", "text"), labels)
    return found.select(
        "doc_id", "p_quality", "p_toxic", F.col("is_toxic").alias("toxic"), (~F.col("is_toxic")).alias("kept")
    )
