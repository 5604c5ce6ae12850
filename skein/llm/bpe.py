"""Byte-level BPE encoding and decoding, equal to the ``tiktoken`` library's.

Pre-tokenisation uses no regular expression. Every code point has a class; a class is a
function from scanner states to scanner states. These functions are closed under composition,
so their compositions have small numbers, and a blocked scan with a composition table gives
the state before every character: each block is first reduced to one function, these are
scanned in turn, and then each block is run from its entry state. State and class together
tell where a token starts. Slices not seen before are merged together, one merge a round in
each; results are cached by slice.

An executor keeps several Python workers alive, idle ones too, and each holds a vocabulary of its
own. So the pairs are in arrays, and texts are taken a bounded part at a time.

Texts are UTF-8; invalid bytes become U+FFFD. Null texts count as empty: no ids. Texts and
slices of any length are encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, table

RANKS = "byte_bpe_50k.tiktoken"
CACHE = 100_000
SCAN = 128
PART = 1 << 17
LONG = 96
NONE = np.int64(1 << 40)

# Classes of characters, some by what follows.
L, N, O, A1, A2, S_MID, S_LAST, W_LAST, RESET = range(9)
# States before a character: a token starts here; in letters, digits, others; after a space
# that joins what follows; in white space; one or two more letters of a contraction.
START, IN_L, IN_N, IN_O, AFTER_SPACE, IN_W, ONE_MORE, TWO_MORE = range(8)

#: White_Space of Unicode. Fixed values.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _step(state: int, kind: int) -> tuple[int, bool]:
    """Next state, and whether a token starts at the character."""
    if kind == RESET:
        return START, True
    if kind == S_MID:
        return IN_W, state != IN_W
    if kind == S_LAST:
        return AFTER_SPACE, True
    if kind == W_LAST:
        return START, True
    if kind == L and state in (ONE_MORE, TWO_MORE):
        return (START if state == ONE_MORE else ONE_MORE), False
    if kind in (L, N):
        own = IN_L if kind == L else IN_N
        return own, state not in (own, AFTER_SPACE)
    if state in (IN_O, AFTER_SPACE):
        return IN_O, False
    return {O: IN_O, A1: ONE_MORE, A2: TWO_MORE}[kind], True


@lru_cache(1)
def _scanner() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Step table, start table, composition table, state of each function from START's number."""
    step = np.array([[_step(s, k)[0] for k in range(9)] for s in range(8)], np.uint8)
    starts = np.array([[_step(s, k)[1] for k in range(9)] for s in range(8)])
    same = tuple(range(8))
    known = {same: 0}
    basic = []
    for k in range(9):
        basic.append(known.setdefault(tuple(int(x) for x in step[:, k]), len(known)))
    todo = list(known)
    while todo:
        f = todo.pop()
        for g in list(known):
            for h in (tuple(g[x] for x in f), tuple(f[x] for x in g)):
                if h not in known:
                    known[h] = len(known)
                    todo.append(h)
    functions = np.array(list(known), np.uint8)
    m = len(known)
    compose = np.zeros((m, m), np.uint16)
    for f, i in known.items():
        for g, j in known.items():
            compose[i, j] = known[tuple(g[x] for x in f)]
    return step, starts, compose, functions, np.array(basic, np.uint16)


def _scan(f: np.ndarray, compose: np.ndarray) -> np.ndarray:
    """Composition of all functions before each one."""
    n = len(f)
    if n <= 64:
        out = np.zeros(n, np.uint16)
        for i in range(1, n):
            out[i] = compose[out[i - 1], f[i - 1]]
        return out
    rows = -(-n // SCAN)
    grid = np.zeros(rows * SCAN, np.uint16)
    grid[:n] = f
    grid = np.ascontiguousarray(grid.reshape(rows, SCAN).T)
    total = np.zeros(rows, np.uint16)
    for row in grid:
        total = compose[total, row]
    at = _scan(total, compose)
    out = np.empty_like(grid)
    for j, row in enumerate(grid):
        out[j] = at
        at = compose[at, row]
    return out.T.reshape(-1)[:n]


@lru_cache(1)
def _kinds() -> np.ndarray:
    """L, N, O, S_MID for each code point."""
    first = {"L": L, "N": N}
    kinds = np.array([first.get(unicodedata.category(chr(c))[0], O) for c in range(0x110000)], np.uint8)
    kinds[WHITE] = S_MID
    return kinds


def classes(codes: np.ndarray, seps: np.ndarray) -> np.ndarray:
    """Class of each code point; ``seps``: places of separators between texts."""
    kind = _kinds()[codes]
    kind[seps] = RESET
    after = np.append(kind[1:], RESET)
    last = (kind == S_MID) & (after != S_MID) & (after != RESET)
    kind[last] = np.where(codes[last] == 0x20, S_LAST, W_LAST)
    quote = np.flatnonzero(codes == 0x27)
    if len(quote):
        padded = np.concatenate([codes, [0, 0]])
        a, b = padded[quote + 1], padded[quote + 2]
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = np.zeros(len(quote), bool)
        for x, y in ("re", "ve", "ll"):
            two |= (a == ord(x)) & (b == ord(y))
        kind[quote[one]] = A1
        kind[quote[two]] = A2
    return kind


def boundaries(codes: np.ndarray, seps: np.ndarray) -> np.ndarray:
    """Places where tokens (and separators) start."""
    _, starts, compose, functions, basic = _scanner()
    kind = classes(codes, seps)
    before = functions[:, START][_scan(basic[kind], compose)]
    return np.flatnonzero(starts[before, kind])


def parts(texts: Iterable[str]) -> Iterator[list[str]]:
    """``texts`` in turn, of ``PART`` characters together at most; a longer text stands alone."""
    some, size = [], 0
    for text in texts:
        if some and size + len(text) > PART:
            yield some
            some, size = [], 0
        some.append(text)
        size += len(text)
    if some:
        yield some


class Vocabulary:
    """Ranks of a byte-level vocabulary, with a table of the pairs that merge."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        size = max(self.ranks.values()) + 1
        self.byte_id = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.decimal = [b"%d" % i for i in range(size)]
        self.text = {self.decimal[i]: t for t, i in self.ranks.items()}
        self.length = np.zeros(size, np.int64)
        self.bytes = [b""] * size
        for t, i in self.ranks.items():
            self.length[i], self.bytes[i] = len(t), t
        pairs = (
            z
            for t, i in self.ranks.items()
            for k in range(1, len(t))
            if (x := self.ranks.get(t[:k])) is not None and (y := self.ranks.get(t[k:])) is not None
            for z in ((x << 32) | y, i)
        )
        keys, values = np.fromiter(pairs, np.int64).reshape(-1, 2).T
        self.bits = max(12, (4 * len(keys)).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int64)
        self.merged = np.full(1 << self.bits, -1, np.int32)
        at = self._hash(keys)
        while len(keys):
            free = self.slots[at] < 0
            self.slots[at[free]] = keys[free]
            mine = self.slots[at] == keys
            self.merged[at[mine]] = values[mine]
            keys, values, at = keys[~mine], values[~mine], (at[~mine] + 1) & (len(self.slots) - 1)
        self.cache: dict[str, bytes] = {}

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _pair(self, x: int, y: int) -> int | None:
        """Id that two neighbours merge to, if any."""
        key = (x << 32) | y
        at = (key * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> (64 - self.bits)
        while (slot := self.slots.item(at)) >= 0:
            if slot == key:
                return self.merged.item(at)
            at = (at + 1) & (len(self.slots) - 1)
        return None

    def _rank(self, keys: np.ndarray) -> np.ndarray:
        at = self._hash(keys)
        slot = self.slots[at]
        out = np.where(slot == keys, self.merged[at], NONE)
        todo = np.flatnonzero((slot != keys) & (slot >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & (len(self.slots) - 1)
            slot = self.slots[at[todo]]
            hit = slot == keys[todo]
            out[todo[hit]] = self.merged[at[todo[hit]]]
            todo = todo[~hit & (slot >= 0)]
        return out

    def merge(self, slices: list[bytes]) -> list[list[int]]:
        """Ids of each slice (none is empty)."""
        ids = self.byte_id[np.frombuffer(b"".join(slices), np.uint8)]
        word = np.repeat(np.arange(len(slices)), np.fromiter(map(len, slices), np.int64, len(slices)))
        done_ids, done_word = [], []
        while len(ids):
            rank = np.full(len(ids), NONE)
            inside = np.flatnonzero(word[:-1] == word[1:])
            rank[inside] = self._rank((ids[inside] << 32) | ids[inside + 1])
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            least = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(ids))))
            ended = least == NONE
            done_ids.append(ids[ended])
            done_word.append(word[ended])
            hits = np.flatnonzero((rank == least) & ~ended)
            if not len(hits):
                break
            at = hits[np.append(True, word[hits[1:]] != word[hits[:-1]])]
            ids[at] = rank[at]
            keep = ~ended
            keep[at + 1] = False
            ids, word = ids[keep], word[keep]
        all_ids, all_word = np.concatenate(done_ids), np.concatenate(done_word)
        order = np.argsort(all_word, kind="stable")
        ends = np.cumsum(np.bincount(all_word, minlength=len(slices))).tolist()
        flat = all_ids[order].tolist()
        return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def merge_long(self, piece: bytes) -> list[int]:
        """Ids of one slice, in time near-linear in its length."""
        first = self.byte_id[np.frombuffer(piece, np.uint8)]
        ranks = self._rank((first[:-1] << 32) | first[1:])
        ids, n = first.tolist(), len(first)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(ranks.tolist()) if r != NONE]
        heapq.heapify(heap)
        while heap:
            r, i, x, y = heapq.heappop(heap)
            j = nxt[i] if ids[i] == x else n
            if j >= n or ids[j] != y:
                continue
            ids[i], ids[j] = r, -1
            nxt[i] = k = nxt[j]
            if k < n:
                prv[k] = i
                if (q := self._pair(r, ids[k])) is not None:
                    heapq.heappush(heap, (q, i, r, ids[k]))
            if (h := prv[i]) >= 0 and (q := self._pair(ids[h], r)) is not None:
                heapq.heappush(heap, (q, h, ids[h], r))
        return [x for x in ids if x >= 0]

    def learn(self, slices: list[str]) -> None:
        """Put the ids of all slices in the cache, as decimal text."""
        if len(self.cache) > CACHE:
            self.cache.clear()
        new = set(slices).difference(self.cache)
        raw = {s: s.encode() for s in new}
        short = []
        for s, b in raw.items():
            if (i := self.ranks.get(b)) is not None:
                self.cache[s] = self.decimal[i]
            elif len(b) > LONG:
                self.cache[s] = b" ".join([self.decimal[i] for i in self.merge_long(b)])
            else:
                short.append(s)
        if short:
            dec = self.decimal
            for s, ids in zip(short, self.merge([raw[s] for s in short]), strict=True):
                self.cache[s] = b" ".join([dec[i] for i in ids])

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        """The ids of each text as decimal numbers joined by spaces."""
        return [ids for some in parts(texts) for ids in self._encode(some)]

    def _encode(self, texts: list[str]) -> list[bytes]:
        joined = "\n".join(texts) + "\n"
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        seps = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
        starts = boundaries(codes, seps)
        ends = np.append(starts[1:], len(codes))
        real = ~np.isin(starts, seps, assume_unique=True)
        starts, ends = starts[real], ends[real]
        slices = [joined[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        self.learn(slices)
        known, until = self.cache.__getitem__, np.searchsorted(starts, seps).tolist()
        return [b" ".join(map(known, slices[a:b])) for a, b in zip([0, *until[:-1]], until, strict=True)]

    def decode(self, ids: bytes) -> bytes:
        """The bytes that decimal ids, joined by spaces, stand for."""
        return b"".join(map(self.text.__getitem__, ids.split()))


@lru_cache(4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _texts(column: pa.Array) -> Iterator[str]:
    return ((x.as_py() or b"").decode("utf-8", "replace") for x in column)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, ids array<int>, offsets array<long>): a token's id and where its bytes start."""
    path = path or public_tokenizers.path(RANKS)

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        v = vocabulary(path)
        ids = [np.array(x.split(), np.int64) for x in v.encode(_texts(b.column(1)))]
        offsets = [np.cumsum(v.length[x]) - v.length[x] for x in ids]
        arrays = [b.column(0), pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())), pa.array(offsets, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(arrays, ["id", "ids", "offsets"])

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary"))
    return arrow_map(slim, batch, "id long, ids array<int>, offsets array<long>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(id, text binary) of what ``encode`` returned. Each token's bytes go to its offset, so a
    row whose offsets don't fit its ids raises an error."""
    path = path or public_tokenizers.path(RANKS)

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        v = vocabulary(path)
        out = []
        for ids, offsets in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            size = v.length[np.array(ids or [], np.int64)]
            if not np.array_equal(np.cumsum(size) - size, np.array(offsets or [], np.int64)):
                raise ValueError("offsets and ids differ")
            out.append(b"".join([v.bytes[i] for i in ids or []]))
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["id", "text"])

    return arrow_map(encoded.select("id", "ids", "offsets"), batch, "id long, text binary")


DIGEST = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Encodes every text, decodes the ids, and returns digests of both, one row per row."""
    path = path or public_tokenizers.path(RANKS)

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        v = vocabulary(path)
        n_tokens, encoded, decoded = [], [], []
        for some in parts(_texts(b.column(1))):  # the ids of a whole batch are never held
            for ids in v.encode(some):
                n_tokens.append(ids.count(b" ") + bool(ids))
                encoded.append(hashlib.sha256(ids).hexdigest())
                decoded.append(hashlib.sha256(v.decode(ids)).hexdigest())
        columns = [b.column(0), pa.array(n_tokens, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary"))
    return arrow_map(slim, batch, DIGEST)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
