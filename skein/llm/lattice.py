"""Subword lattice likelihood: the probability of a text under all its segmentations.

The pieces and their scores are those of an existing piece model. A score is an unnormalised log
weight; a temperature makes the scores a distribution, and they are adapted to the training
documents by a few rounds of expectation maximisation over all their distinct words, with the
existing distribution as a prior. A text is a sequence of tokens, its words and one end. A word's
bytes, after one space, form a lattice whose edges are pieces; a forward recursion in log space
sums all paths. As no piece spans two words, a text's log marginal is the sum of its words' and
the end's.

Every distinct word of the corpus is scored once. Documents are dealt to blocks by hash; each
block's dictionary (a word and its score a row) meets the block's documents again, so tokens
themselves are never shuffled, and a very frequent word costs a row a block.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import log10

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import octets, remainder, salted_join, stored, table

VOCABULARY = "piece_bpe_32k.model"
BLOCK_BYTES = 8 << 20
ROUNDS = 3
PRIOR = 0.01
TEMPERATURE = 4000.0
RULED_OUT = -1e8
CELLS = 1 << 21
ROWS = 100_000
LONG_WORD = 2048
STARTS = 1 << 14
SPACE = b" \t\n\x0b\x0c\r"
HASH = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(0x100000001B3)


class Pieces:
    """Pieces by a rolling hash, and their natural-log scores."""

    def __init__(self, pieces: list[bytes]) -> None:
        self.pieces = pieces
        self.longest = max(map(len, pieces))
        hashes = np.array([self._one(p) for p in pieces], np.uint64)
        if len(np.unique(hashes)) != len(hashes):
            raise ValueError("pieces collide")
        self.bits = max(8, (8 * len(pieces)).bit_length())
        self.slot = np.zeros(1 << self.bits, np.uint64)
        self.id = np.full(1 << self.bits, -1, np.int32)
        ids, at = np.arange(len(pieces)), self._at(hashes)
        while len(ids):
            free = self.id[at] < 0
            self.slot[at[free]], self.id[at[free]] = hashes[ids[free]], ids[free]
            rest = self.slot[at] != hashes[ids]
            ids, at = ids[rest], (at[rest] + 1) & (len(self.slot) - 1)

    @staticmethod
    def _one(piece: bytes) -> int:
        h = 14695981039346656037
        for b in piece:
            h = ((h ^ (b + 1)) * int(STEP)) & 0xFFFFFFFFFFFFFFFF
        return h

    def _at(self, h: np.ndarray) -> np.ndarray:
        return ((h * HASH) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Ids of the pieces with these hashes, or -1."""
        at = self._at(h)
        out = np.where(self.slot[at] == h, self.id[at], -1)
        todo = np.flatnonzero((self.slot[at] != h) & (self.id[at] >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & (len(self.slot) - 1)
            hit = self.slot[at[todo]] == h[todo]
            out[todo[hit]] = self.id[at[todo[hit]]]
            todo = todo[~hit & (self.id[at[todo]] >= 0)]
        return out

    def edges(self, grid: np.ndarray) -> list[np.ndarray]:
        """For words of one length (a row of bytes each): for each piece length, the ids of the
        pieces at each start."""
        n, length = grid.shape
        h = np.full((n, length), np.uint64(14695981039346656037))
        out = []
        codes = grid.astype(np.uint64) + np.uint64(1)
        for k in range(min(length, self.longest)):
            h = (h[:, : length - k] ^ codes[:, k:]) * STEP
            out.append(self.find(h.reshape(-1)).reshape(n, length - k))
        return out


def forward(edges: list[np.ndarray], scores: np.ndarray, length: int) -> np.ndarray:
    """Log of the sums over all paths to each place of the words, by the lattice's recursion."""
    n = len(edges[0])
    alpha = np.full((n, length + 1), -np.inf)
    alpha[:, 0] = 0.0
    for i in range(1, length + 1):
        into = [alpha[:, i - k - 1] + scores[edges[k][:, i - k - 1]] for k in range(min(i, len(edges)))]
        alpha[:, i] = np.logaddexp.reduce(into, axis=0) if len(into) > 1 else into[0]
    return alpha


def expected(edges: list[np.ndarray], scores: np.ndarray, length: int, count: np.ndarray, total: np.ndarray) -> None:
    """Adds to ``total`` how often each piece is expected in the words, ``count`` times each."""
    alpha = forward(edges, scores, length)
    beta = np.full_like(alpha, -np.inf)
    beta[:, length] = 0.0
    for i in range(length - 1, -1, -1):
        out = [beta[:, i + k + 1] + scores[edges[k][:, i]] for k in range(min(length - i, len(edges)))]
        beta[:, i] = np.logaddexp.reduce(out, axis=0) if len(out) > 1 else out[0]
    for k, ids in enumerate(edges):
        x, y = np.nonzero(ids >= 0)
        used = ids[x, y]
        p = alpha[x, y] + scores[used] + beta[x, y + k + 1] - alpha[x, length]
        total += np.bincount(used, np.exp(p) * count[x], len(total))


class LongWord:
    """A very long word, whose edges are found for some thousand starts at a time: memory is a
    few numbers a byte, whatever the pieces' lengths."""

    def __init__(self, word: bytes, known: Pieces, scores: np.ndarray) -> None:
        self.codes, self.known, self.scores = np.frombuffer(b" " + word, np.uint8), known, scores
        self.length = len(self.codes)

    def _edges(self, lo: int) -> np.ndarray:
        """(starts, piece lengths): ids of the pieces at each start from ``lo`` on."""
        part = self.codes[lo : lo + STARTS + self.known.longest - 1]
        out = np.full((min(STARTS, self.length - lo), self.known.longest), -1, np.int64)
        for k, ids in enumerate(self.known.edges(part[None])):
            out[: ids.shape[1], k] = ids[0, : len(out)]
        return out

    def forward(self) -> np.ndarray:
        alpha = np.full(self.length + self.known.longest, -np.inf)
        alpha[0] = 0.0
        for lo in range(0, self.length, STARTS):
            for i, ids in enumerate(self._edges(lo), lo):
                to = alpha[i + 1 : i + 1 + len(ids)]
                np.logaddexp(to, alpha[i] + self.scores[ids], out=to)
        return alpha[: self.length + 1]

    def expected(self, count: float, total: np.ndarray) -> None:
        """As the function of this name, for this word."""
        alpha = self.forward()
        beta = np.full(self.length + self.known.longest, -np.inf)
        beta[self.length] = 0.0
        for lo in reversed(range(0, self.length, STARTS)):
            edges = self._edges(lo)
            for j in range(len(edges) - 1, -1, -1):
                beta[lo + j] = np.logaddexp.reduce(beta[lo + j + 1 : lo + j + 1 + edges.shape[1]] + self.scores[edges[j]])
            x, k = np.nonzero(edges >= 0)
            used = edges[x, k]
            p = alpha[lo + x] + self.scores[used] + beta[lo + x + k + 1] - alpha[self.length]
            total += np.bincount(used, np.exp(p) * count, len(total))


def grouped(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.Table]:
    """Batches joined to some ``rows`` rows each."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def by_length(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(places, grid of bytes, length) of the words of no more than ``LONG_WORD`` bytes, with the
    space before each, by length, in parts of bounded size."""
    lens = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(lens, kind="stable")
    order = order[: np.searchsorted(lens[order], LONG_WORD, "right")]
    lo = 0
    while lo < len(order):
        length = int(lens[order[lo]])
        hi = min(int(np.searchsorted(lens[order], length, "right")), lo + max(1, CELLS // (8 * (length + 1))))
        at = order[lo:hi]
        grid = np.frombuffer(b"".join([b" " + words[i] for i in at.tolist()]), np.uint8)
        yield at, grid.reshape(len(at), length + 1), length + 1
        lo = hi


def existing(path: str) -> tuple[list[bytes], np.ndarray]:
    """The model's pieces without white space inside, as bytes, and its scores as natural logs of
    a distribution. Pieces that its scores rule out (``RULED_OUT``) are left out. Its 256 single bytes, which it falls back on, get the least of the scores,
    so every text has a probability."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    score: dict[bytes, float] = {}
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i).replace("\u2581", " ").encode()
        if model.get_score(i) < RULED_OUT:
            continue
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)) and piece[1:].translate(None, SPACE) == piece[1:]:
            score[piece] = model.get_score(i)
    least = min(score.values())
    for b in range(256):
        score.setdefault(bytes([b]), least)
    logs = np.array(list(score.values())) / TEMPERATURE
    return list(score), logs - np.logaddexp.reduce(logs)


def _padded(scores: np.ndarray) -> np.ndarray:
    return np.append(scores, -np.inf)  # at -1: no piece


def _blocks(docs: DataFrame, id_col: str, text_col: str, learn: str, n: int) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit("").cast("binary"))
    return docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.expr(learn).alias("learn"),
        text.alias("t"),
        F.pmod(F.xxhash64(id_col, text_col), F.lit(n)).cast("int").alias("block"),
    )


def _dictionary(block: pa.Table) -> pa.Table:
    """(block, word, n): the block's words, and how often its training documents have each."""
    counts: Counter[bytes] = Counter()
    others: set[bytes] = set()
    for learn, text in zip(block["learn"], block["t"], strict=True):
        words = text.as_py().lower().split()
        if learn.as_py():
            counts.update(words)
        else:
            others.update(words)
    others.difference_update(counts)
    words = [*counts, *others]
    n = np.concatenate([np.fromiter(counts.values(), np.int64, len(counts)), np.zeros(len(others), np.int64)])
    key = pa.array(np.full(len(words), block["block"][0].as_py(), np.int32))
    return pa.table({"block": key, "word": pa.array(words, pa.binary()), "n": pa.array(n)})


def estimate(words: DataFrame, pieces: list[bytes], scores: np.ndarray, rounds: int) -> np.ndarray:
    """Log scores of the pieces, adapted to all (word, c) rows with c > 0."""
    spark = words.sparkSession
    first = np.exp(scores)
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast((pieces, scores))

        def tally(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            pieces, scores = sent.value
            known, now = Pieces(pieces), _padded(scores)
            total = np.zeros(len(pieces))
            for b in grouped(batches):
                c = b.column("c").to_numpy().astype(float)
                found = b.column("word").to_pylist()
                for at, grid, length in by_length(found):
                    expected(known.edges(grid), now, length, c[at], total)
                for i, w in enumerate(found):
                    if len(w) > LONG_WORD:
                        LongWord(w, known, now).expected(c[i], total)
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["piece", "e"])

        found = words.where("c > 0").select("word", "c").mapInArrow(tally, "piece long, e double")
        rows = found.groupBy("piece").agg(F.sum("e").alias("e")).collect()  # as many as there are pieces, at most
        total = np.zeros(len(pieces))
        for piece, e in rows:
            total[piece] = e
        weight = total + PRIOR * first * max(1.0, total.sum())
        scores = np.log(weight / weight.sum())
    return scores


def lattice_scores(
    docs: DataFrame,
    learn: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    path: str | None = None,
    rounds: int = ROUNDS,
) -> DataFrame:
    """(id, learned, n_tokens, n_known, train_tokens, base_score, score) for each row of ``docs``.

    ``learn``: a condition in SQL; documents that meet it (null: no) are learned from. Tokens
    are the words of the text with A-Z lower-cased, and one end. ``base_score`` is the add-one
    unigram's, ``score`` the lattice's, both log10. A null text is an empty one: its end alone.
    Repeated rows count and come back as often as they are there. Without any training document
    the base is log10(1/1) a token and the pieces keep their scores (an end: a half). Words of
    any length are scored whole. Blocks, and so memory, are bounded by the block size and the
    longest text. Ids are integers or null. An empty table gives an empty result; columns other
    than those named, of whatever name, are not looked at.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    size = docs.agg(F.sum(octets(F.col(text_col))).alias("s")).first()["s"] or 0
    n_blocks = max(1, -(-size // BLOCK_BYTES))
    learn = f"coalesce({learn}, false)"
    blocks = _blocks(docs, id_col, text_col, learn, n_blocks)
    entries = blocks.groupBy("block").applyInArrow(_dictionary, "block int, word binary, n long")
    entries = stored(entries)
    words = stored(entries.groupBy("word").agg(F.sum("n").alias("c"), F.count("*").alias("blocks")))
    ends = docs.where(learn).count()
    got = words.agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v"), F.sum("blocks").alias("b")).first()
    train, kinds = (got["n"] or 0) + ends, got["v"] + (ends > 0)
    floor = log10(train + kinds + 1)

    pieces, scores = existing(path)
    scores = estimate(words, pieces, scores, rounds if train > ends else 0)
    end = (ends + 1) / (train + 2)
    sent = docs.sparkSession.sparkContext.broadcast((pieces, scores))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, now = Pieces(sent.value[0]), _padded(sent.value[1])
        for b in grouped(batches):
            found, out = b.column("word").to_pylist(), np.zeros(b.num_rows)
            for at, grid, length in by_length(found):
                out[at] = forward(known.edges(grid), now, length)[:, length]
            for i, w in enumerate(found):
                if len(w) > LONG_WORD:
                    out[i] = LongWord(w, known, now).forward()[-1]
            p = (out + np.log(1 - end)) / np.log(10)
            yield from pa.table({"word": b.column("word"), "c": b.column("c"), "p": p}).to_batches(max_chunksize=10_000)

    scored = words.select("word", "c").mapInArrow(score, "word binary, c long, p double")
    # A frequent word has a row in every block, so its rows are dealt over several tasks.
    scored = salted_join(entries.select("block", "word"), scored, ["word"], words, "blocks", got["b"] or 0, F.col("block"))
    end_known, end_base, end_score = int(ends > 0), log10(ends + 1) - floor, log10(end)

    def total(block: pa.Table, entry: pa.Table) -> pa.Table:
        place = {w: i for i, w in enumerate(entry["word"].to_pylist())}
        c = entry["c"].to_numpy()
        base, p = np.log10(c + 1.0) - floor, entry["p"].to_numpy()
        known = c > 0
        rows = []
        for text in block["t"]:
            words = text.as_py().lower().split()
            at = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
            rows.append((len(words) + 1, int(known[at].sum()) + end_known, float(base[at].sum()) + end_base, float(p[at].sum()) + end_score))
        tokens, have, b, s = zip(*rows, strict=True) if rows else ((), (), (), ())
        return pa.table({
            "id": block["id"], "learned": block["learn"], "n_tokens": pa.array(tokens, pa.int64()), "n_known": pa.array(have, pa.int64()),
            "train_tokens": pa.array([train] * len(rows), pa.int64()), "base_score": pa.array(b, pa.float64()), "score": pa.array(s, pa.float64()),
        })

    out = "id long, learned boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return blocks.groupBy("block").cogroup(scored.groupBy("block")).applyInArrow(total, out)


def op1_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("r", remainder(F.col("doc_id"), 7))
    scored = lattice_scores(docs, "r <> 2")
    return scored.select(
        F.col("id").alias("doc_id"), (~F.col("learned")).alias("held_out"),
        "n_tokens", "n_known", "train_tokens", "base_score", "score",
    )
