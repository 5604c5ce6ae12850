"""A tokeniser for cells and texts: words, punctuation, ideographs and numbers apart.

A batch of texts is one array of code points. Each code point has a class from a table, and all
token boundaries of the batch come from comparing classes of neighbours, so no loop runs over
characters, and texts of any length are one pass. Only texts that aren't ASCII are folded one by
one beforehand (lower case, accents off); the others are folded at once.

Rules, in order. Control and format characters and U+FFFD go. White space and ideographs end a
token, an ideograph is one itself. ASCII digits start a number; commas and points belong to what
they follow, so a number keeps those inside and after it. A number's commas go; one with three or
more parts between points isn't a value, and becomes its parts with a point between two of them.
Text is lower-cased, its combining marks go, and each punctuation character is a token (all of
ASCII's, ``_`` too, and category P).
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ranges of ideographs that are tokens of their own. Fixed values.
IDEOGRAPHS = (
    (0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F),
    (0x2B740, 0x2B81F), (0x2B820, 0x2CEAF), (0xF900, 0xFAFF), (0x2F800, 0x2FA1F),
)
WORD, SPACE, GONE, PUNCTUATION, IDEOGRAPH, DIGIT, MARK, COMBINING = range(8)

#: Code points of a pass, each of which takes some 100 bytes while it lasts.
PASS = 1 << 20
#: Type of the result.
TOKENS = "array<struct<token: string, number: boolean, start: int, stop: int>>"


@cache
def classes() -> np.ndarray:
    """The class of each code point; commas and points are ``MARK``."""
    out = np.full(sys.maxunicode + 1, WORD, np.uint8)
    for cp in range(sys.maxunicode + 1):
        c = chr(cp)
        kind = unicodedata.category(c)
        if c in "\t\n\r" or kind[0] == "Z":
            out[cp] = SPACE
        elif kind in ("Cc", "Cf") or cp == 0xFFFD:
            out[cp] = GONE
        elif kind[0] == "P" or 32 < cp < 127 and not c.isalnum():
            out[cp] = PUNCTUATION
        elif kind == "Mn":
            out[cp] = COMBINING
    for lo, hi in IDEOGRAPHS:
        out[lo : hi + 1] = IDEOGRAPH
    out[ord("0") : ord("9") + 1] = DIGIT
    out[[ord(","), ord(".")]] = MARK
    return out


@cache
def _parts(c: str) -> int:
    return len(unicodedata.normalize("NFD", c))


def folded(text: str) -> tuple[str, np.ndarray]:
    """The text in lower case with letters and combining marks apart, and the place that each of
    them has in ``text``."""
    if text.isascii():
        return text.lower(), np.arange(len(text))
    low = text.replace("İ", "i").lower()  # the one letter that would become longer, by a mark
    return unicodedata.normalize("NFD", low), np.repeat(np.arange(len(text)), [_parts(c) for c in low])


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def scanned(texts: list[str | None]) -> pa.ListArray:
    """The tokens of each text, of type ``TOKENS``; null for null. ``start`` and ``stop`` are
    places of code points in the text. Texts are scanned ``PASS`` code points at a time (or one
    longer text), so memory doesn't grow with a batch."""
    parts, lo, size = [], 0, 0
    for k, text in enumerate(texts):
        n = len(text or "")
        if size and size + n > PASS:
            parts.append(_scanned(texts[lo:k]))
            lo, size = k, 0
        size += n
    parts.append(_scanned(texts[lo:]))
    return pa.concat_arrays(parts) if len(parts) > 1 else parts[0]


def _scanned(texts: list[str | None]) -> pa.ListArray:
    table = classes()
    cp, at, text_of = _cleaned(texts, table)
    kind = table[cp]

    def before(x: np.ndarray, none) -> np.ndarray:
        """The value of the character before, in the same text."""
        out = np.empty_like(x)
        out[:1], out[1:] = none, x[:-1]
        out[np.concatenate([[True], text_of[1:] != text_of[:-1]])[: len(x)]] = none
        return out

    # A mark is of a number if the last character before it that is no mark is a digit.
    n = len(cp)
    new_text = np.concatenate([[True], text_of[1:] != text_of[:-1]])[:n]
    anchor = np.maximum.accumulate(np.where((kind != MARK) | new_text, np.arange(n), 0)) if n else np.zeros(0, np.int64)
    number = (kind == DIGIT) | ((kind == MARK) & (kind[anchor] == DIGIT))
    run = number & ~before(number, False)
    # Combining marks end a number, but no word.
    kept = ~(number & (cp == ord(","))) & (kind != COMBINING)
    cp, at, text_of, kind, number, run = (x[kept] for x in (cp, at, text_of, kind, number, run))
    run_id = np.cumsum(run) - 1
    digit = kind == DIGIT
    part = digit & (run | ~before(digit, False))
    parts = np.bincount(run_id[part], minlength=run.sum()) if run.any() else np.zeros(0, np.int64)
    many = np.zeros(len(cp), bool)
    many[number] = parts[run_id[number]] > 2
    # Of a run of many parts one point stays between two of them.
    so_far = np.cumsum(part)
    first_of_run = np.zeros(len(cp), np.int64)
    first_of_run[number] = (so_far - part)[np.flatnonzero(run)][run_id[number]]
    last_part = np.zeros(len(cp), bool)
    last_part[number] = (so_far[number] - first_of_run[number]) == parts[run_id[number]]
    point = many & ~digit
    idle = point & (~before(digit, False) | last_part)
    word = (kind == WORD) & ~number
    single = ((kind == PUNCTUATION) | (kind == IDEOGRAPH) | ((kind == MARK) & ~number) | point) & (kind != SPACE)
    start = single | (word & ~before(word, False)) | (number & ~point & np.where(many, part, run))
    kept = (kind != SPACE) & ~idle
    cp, at, text_of, number, point, start = (x[kept] for x in (cp, at, text_of, number, point, start))

    first = np.flatnonzero(start)
    last = np.concatenate([first[1:], [len(cp)]])[: len(first)]
    width = 1 + (cp >= 0x80) + (cp >= 0x800) + (cp >= 0x10000)
    ends = np.concatenate([[0], np.cumsum(width)])
    data = cp.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
    offsets = np.concatenate([ends[first], ends[-1:]]).astype(np.int32)
    token = pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data))
    flags = pa.array((number & ~point)[first])
    item = pa.StructArray.from_arrays([token, flags, pa.array(at[first].astype(np.int32)), pa.array((at[last - 1] + 1).astype(np.int32))], ["token", "number", "start", "stop"])
    counts = np.bincount(text_of[first], minlength=len(texts))
    bounds = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    empty = np.array([t is None for t in texts], bool)
    return pa.ListArray.from_arrays(pa.array(bounds), item, mask=pa.array(empty)) if empty.any() else pa.ListArray.from_arrays(pa.array(bounds), item)


def _cleaned(texts: list[str | None], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the texts without control characters, folded, their places in their text
    and the text's number. A run of texts that are ASCII is one text here."""
    parts, lo = [(np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64))], 0
    for plain, run in groupby([t or "" for t in texts], str.isascii):
        run = list(run)
        if plain:
            size = np.array([len(t) for t in run])
            points = _points("".join(run).lower())
            at, of = np.arange(len(points)) - np.repeat(np.cumsum(size) - size, size), np.repeat(np.arange(lo, lo + len(run)), size)
            kept = table[points] != GONE
            parts.append((points[kept], at[kept], of[kept]))
        else:
            parts += [(*one, np.full(len(one[0]), k)) for k, t in enumerate(run, lo) for one in [_cleaned_one(t, table)]]
        lo += len(run)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _cleaned_one(text: str, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    points = _points(text)
    kept = np.flatnonzero(table[points] != GONE)
    if len(kept) < len(points):
        text = points[kept].tobytes().decode("utf-32-le", "surrogatepass")
    low, at = folded(text)
    return _points(low), kept[at]


def tokens(text: Column) -> Column:
    """An array of (token, number, start, stop) for each text; null for null, empty for a text
    without a token. Text is taken whole."""

    def scan(texts: pa.Array) -> pa.Array:
        return scanned(texts.to_pylist())

    return F.arrow_udf(scan, TOKENS)(text)


def pieces(word: str, vocabulary: dict[str, int], unknown: str, longest: int = 64) -> list[str]:
    """Greedy longest match from the left, later pieces marked ``##``; a word with a stretch that
    no piece matches, or of more than ``longest`` characters, is unknown as a whole."""
    out, lo = [], 0
    if len(word) > longest:
        return [unknown]
    while lo < len(word):
        mark = "##" if lo else ""
        hi = next((h for h in range(len(word), lo, -1) if mark + word[lo:h] in vocabulary), None)
        if hi is None:
            return [unknown]
        out.append(mark + word[lo:hi])
        lo = hi
    return out


def number_features(token: str, cap: int = 10) -> tuple[int, int, int, int]:
    """Magnitude, precision, first and last digit of a number of one or two parts, capped."""
    parts = [p for p in token.split(".") if p]
    size, fine = (len(token), 0) if len(parts) == 1 else (len(parts[0]), len(parts[1]))
    return min(size, cap), min(fine, cap), int(parts[0][0]), int(parts[-1][-1])
