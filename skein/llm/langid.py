"""Language identification with a byte convolutional network in numpy.

Bytes (A-Z folded) are embedded; filters of several widths run over windows of fixed length,
their maxima over the window go through a softmax. Since a filter's response is a sum over its
taps of a function of one byte, each tap is a table of 256 rows, and two neighbouring taps one
of 65,536: a width of four is two look-ups. All windows of a text are scored and weighted by
their bytes, so whole texts count.

Windows overlap by a filter's width less one, so no place of a text is hidden from any filter.
The network is fitted on the driver on all windows of a bounded sample of rows: for each
language about ``docs_per_lang`` different training texts, by hash, each of them whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches, arrow_map, remainder, table

UNKNOWN = "und"
FOLD = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


@dataclass(frozen=True)
class Net:
    window: int = 192
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 12
    embedding: int = 8
    docs_per_lang: int = 250
    epochs: int = 6
    batch: int = 64
    rate: float = 0.01
    seed: int = 11


Params = dict[str, np.ndarray]


def windows(text: bytes, net: Net) -> tuple[np.ndarray, np.ndarray]:
    """The text in windows of fixed length that overlap by the widest filter less one byte, the
    last one zero-padded, and each window's number of bytes that are not in the one before."""
    raw = text.translate(FOLD)
    step = net.window - max(net.widths) + 1
    rows = 1 + max(0, -(-(len(raw) - net.window) // step))
    flat = np.zeros((rows - 1) * step + net.window, np.uint8)
    flat[: len(raw)] = np.frombuffer(raw, np.uint8)
    sizes = np.full(rows, step)
    sizes[0] = min(len(raw), net.window)
    if rows > 1:
        sizes[-1] = len(raw) - net.window - (rows - 2) * step
    return np.lib.stride_tricks.sliding_window_view(flat, net.window)[::step], sizes


def _taps(p: Params, width: int) -> np.ndarray:
    """(width, 256, filters): what each byte adds at each tap."""
    return np.einsum("be,wef->wbf", p["embed"], p[f"w{width}"])


def _pooled(grid: np.ndarray, taps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest response of each filter in each window, and where."""
    width, n = len(taps), grid.shape[1]
    out = sum(taps[k][grid[:, k : n - width + 1 + k]] for k in range(width))
    at = out.argmax(axis=1)
    return np.take_along_axis(out, at[:, None, :], 1)[:, 0], at


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(grid: np.ndarray, label: np.ndarray, n_labels: int, net: Net) -> Params:
    """Adam on the cross-entropy of windows; only the places that won the pooling get gradients."""
    rng = np.random.default_rng(net.seed)
    p: Params = {"embed": rng.normal(0, 0.5, (256, net.embedding))}
    for w in net.widths:
        p[f"w{w}"] = rng.normal(0, 0.4, (w, net.embedding, net.filters))
    p["bias"] = np.zeros(len(net.widths) * net.filters)
    p["out"] = rng.normal(0, 0.2, (len(net.widths) * net.filters, n_labels))
    p["out_bias"] = np.zeros(n_labels)
    first = {k: np.zeros_like(v) for k, v in p.items()}
    second = {k: np.zeros_like(v) for k, v in p.items()}
    step = 0
    for _ in range(net.epochs):
        order = rng.permutation(len(grid))
        for lo in range(0, len(order), net.batch):
            rows = order[lo : lo + net.batch]
            g, y = grid[rows], label[rows]
            taps = {w: _taps(p, w) for w in net.widths}
            pooled = {w: _pooled(g, taps[w]) for w in net.widths}
            hidden = np.concatenate([pooled[w][0] for w in net.widths], axis=1) + p["bias"]
            active = np.maximum(hidden, 0)
            error = _softmax(active @ p["out"] + p["out_bias"])
            error[np.arange(len(y)), y] -= 1
            error /= len(y)
            grads = {"out": active.T @ error, "out_bias": error.sum(axis=0)}
            back = (error @ p["out"].T) * (hidden > 0)
            grads["bias"] = back.sum(axis=0)
            grads["embed"] = np.zeros_like(p["embed"])
            for i, w in enumerate(net.widths):
                b = back[:, i * net.filters : (i + 1) * net.filters]
                tap_grad = np.zeros((w, 256, net.filters))
                filters = np.broadcast_to(np.arange(net.filters), b.shape)
                for k in range(w):
                    won = np.take_along_axis(g, pooled[w][1] + k, 1)
                    np.add.at(tap_grad[k], (won, filters), b)
                grads[f"w{w}"] = np.einsum("wbf,be->wef", tap_grad, p["embed"])
                grads["embed"] += np.einsum("wbf,wef->be", tap_grad, p[f"w{w}"])
            step += 1
            for k, grad in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.999 * second[k] + 0.001 * grad**2
                p[k] -= net.rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return p


class Classifier:
    """Fitted network in look-up form."""

    def __init__(self, p: Params, langs: list[str], net: Net) -> None:
        self.p, self.langs, self.net = p, langs, net
        self.out, self.bias = p["out"].astype(np.float32), p["bias"].astype(np.float32)
        self.pairs, self.singles = {}, {}
        for w in net.widths:
            taps = _taps(p, w).astype(np.float32)
            pairs = [(taps[k][:, None] + taps[k + 1][None]).reshape(65536, -1) for k in range(0, w - 1, 2)]
            self.pairs[w], self.singles[w] = pairs, taps[w - 1] if w % 2 else None

    def windows(self, grid: np.ndarray) -> np.ndarray:
        """Probabilities of the languages for each window."""
        n = grid.shape[1]
        two = (grid[:, :-1].astype(np.uint16) << 8) | grid[:, 1:]
        hidden = []
        for w in self.net.widths:
            span = n - w + 1
            out = self.pairs[w][0][two[:, :span]]
            for k, table in enumerate(self.pairs[w][1:], 1):
                out += table[two[:, 2 * k : 2 * k + span]]
            if self.singles[w] is not None:
                out += self.singles[w][grid[:, w - 1 : w - 1 + span]]
            hidden.append(out.max(axis=1))
        active = np.maximum(np.concatenate(hidden, axis=1) + self.bias, 0)
        return _softmax(active @ self.out + self.p["out_bias"])

    def texts(self, raw: list[bytes]) -> np.ndarray:
        """Probabilities of the languages for each text, windows weighted by their bytes."""
        total = np.zeros((len(raw), len(self.langs)))
        held: list[tuple[int, np.ndarray, np.ndarray]] = []
        size = 0
        for i, text in enumerate(raw):
            grid, sizes = windows(text, self.net)
            for lo in range(0, len(grid), 2048):
                held.append((i, grid[lo : lo + 2048], sizes[lo : lo + 2048]))
                size += len(held[-1][1])
                if size >= 2048:
                    self._add(held, total)
                    held, size = [], 0
        if held:
            self._add(held, total)
        return total / np.maximum(total.sum(axis=1, keepdims=True), 1e-12)

    def _add(self, held: list[tuple[int, np.ndarray, np.ndarray]], total: np.ndarray) -> None:
        grid = np.concatenate([g for _, g, _ in held])
        weight = np.concatenate([s for _, _, s in held])
        row = np.repeat([i for i, _, _ in held], [len(g) for _, g, _ in held])
        for lo in range(0, len(grid), 256):
            part = slice(lo, lo + 256)
            np.add.at(total, row[part], self.windows(grid[part]) * weight[part, None])


def sample(docs: DataFrame, learn: str, net: Net) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Training windows, their labels and the languages, from the bounded sample."""
    known = docs.where(f"lang IS NOT NULL AND text IS NOT NULL AND ({learn})")
    counts = sorted((r["lang"], r["n"]) for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect())
    langs = [lang for lang, _ in counts]
    if not langs:
        return np.zeros((0, net.window), np.uint8), np.zeros(0, np.int64), []
    few = F.create_map(*[F.lit(x) for lang, n in counts for x in (lang, min(1.0, net.docs_per_lang / n))])
    draw = F.pmod(F.xxhash64(F.lit(net.seed), "doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    some = known.where(draw < few[F.col("lang")]).select("lang", F.col("text").cast("binary").alias("text"))
    some = some.dropDuplicates(["lang", "text"])  # a row that repeats is learned from once
    place = {lang: i for i, lang in enumerate(langs)}

    def pick(b: pa.RecordBatch) -> pa.RecordBatch:
        labels, rows = [], []
        for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            grid, _ = windows(text.as_py(), net)
            rows += [w.tobytes() for w in grid]
            labels += [place[lang]] * len(grid)
        return pa.RecordBatch.from_arrays([pa.array(labels, pa.int32()), pa.array(rows, pa.binary())], ["y", "x"])

    got = sorted((r["y"], bytes(r["x"])) for r in arrow_map(some, pick, "y int, x binary").collect())
    grid = np.frombuffer(b"".join(x for _, x in got), np.uint8).reshape(-1, net.window)
    return grid, np.array([y for y, _ in got], np.int64), langs


def identified(docs: DataFrame, learn: str, net: Net | None = None) -> DataFrame:
    """(doc_id, learned, lang_pred, score) for each row of ``docs`` (doc_id, text, lang).

    ``learn``: condition in SQL; only rows that meet it and have a text and a lang are learned
    from. Predictions look at the text alone. A null text, or one without a letter, is ``und``
    with score 0, and so is every text if nothing could be learned. A sole language has score
    1. Repeated rows give repeated results; texts of any length are read whole. An empty table
    gives an empty result; other columns, of whatever name, are not looked at.
    """
    net = net or Net()
    grid, label, langs = sample(docs, learn, net)
    model = Classifier(fit(grid, label, len(langs), net), langs, net) if langs else None
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for b in batches:
            raw = [x.as_py() for x in b.column(2)]
            lettered = [x is not None and any(map(str.isalpha, x.decode("utf-8", "replace"))) for x in raw]
            names, scores = [UNKNOWN] * len(raw), [0.0] * len(raw)
            at = [i for i, ok in enumerate(lettered) if ok]
            if model is not None and at:
                p = model.texts([raw[i] for i in at])
                for i, k, s in zip(at, p.argmax(axis=1).tolist(), p.max(axis=1).tolist(), strict=True):
                    names[i], scores[i] = model.langs[k], min(1.0, float(s))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "learned", "lang_pred", "score"]
            )

    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.expr(f"coalesce({learn}, false)").alias("learned"), F.col("text").cast("binary").alias("t")
    )
    return arrow_batches(slim, predict, "doc_id long, learned boolean, lang_pred string, score double")


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identified(docs.withColumn("r", remainder(F.col("doc_id"), 4)), "r <> 2")
    return found.select("doc_id", (~F.col("learned")).alias("held_out"), "lang_pred", "score")
