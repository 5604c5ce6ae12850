"""The tokeniser against a character-by-character version, and on real tables."""

import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skein.functions import tokens as K


def space(c):
    return c in "\t\n\r" or unicodedata.category(c) in ("Zs", "Zl", "Zp")


def punctuation(c):
    return unicodedata.category(c)[0] == "P" or c.isascii() and 32 < ord(c) < 127 and not c.isalnum()


def plain(text):
    """[(token, is a number)] by the rules, one character after another."""
    text = "".join(c for c in text if space(c) or unicodedata.category(c) not in ("Cc", "Cf") and c != "�")
    stretches = []  # [characters, is a number]
    for c in text:
        if c in ",." and stretches:
            stretches[-1][0] += c
        elif stretches and stretches[-1][1] == (c in "0123456789"):
            stretches[-1][0] += c
        else:
            stretches.append([c, c in "0123456789"])
    out = []
    for stretch, number in stretches:
        if number:
            value = stretch.replace(",", "")
            parts = [p for p in value.split(".") if p]
            if len(parts) <= 2:
                out.append((value, True))
            else:
                for k, p in enumerate(parts):
                    out += [(".", False)] * (k > 0) + [(p, True)]
            continue
        for lo, hi in K.IDEOGRAPHS:
            stretch = "".join(f" {c} " if lo <= ord(c) <= hi else c for c in stretch)
        for item in stretch.split():
            item = "".join(c for c in unicodedata.normalize("NFD", item.lower()) if unicodedata.category(c) != "Mn")
            word = ""
            for c in item:
                if punctuation(c):
                    out += [(word, False)] * bool(word) + [(c, False)]
                    word = ""
                else:
                    word += c
            out += [(word, False)] * bool(word)
    return out


def found(texts):
    return [None if t is None else [(x["token"], x["number"]) for x in t] for t in K.scanned(texts).to_pylist()]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Crème 3,000.5-x", [("creme", False), ("3000.5", True), ("-", False), ("x", False)]),
        ("1.2.3", [("1", True), (".", False), ("2", True), (".", False), ("3", True)]),
        ("..1..2..3..", [(".", False), (".", False), ("1", True), (".", False), ("2", True), (".", False), ("3", True)]),
        ("a_b 中文x", [("a", False), ("_", False), ("b", False), ("中", False), ("文", False), ("x", False)]),
        ("7. 8.,9 ,5", [("7.", True), ("8.9", True), (",", False), ("5", True)]),
        ("​A\u0000b�", [("ab", False)]),
        ("İstanbul ΟΔΟΣ", [("istanbul", False), ("οδος", False)]),
        ("\U00020000\U0002f800", None),
        ("", []), (" \t\n ", []), ("a≠b`", None), ("12中34", None),
    ],
)
def test_rules(text, want):
    assert found([text]) == [plain(text)]
    if want is not None:
        assert plain(text) == want


ALPHABET = st.sampled_from(list("aBß0123,,..  _-$`\t\n\u0000​éÉÉñ中文豈が한İΣς≠` 　\U00020001🙂‘”"))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(ALPHABET, max_size=30), st.text(max_size=12)), max_size=6))
def test_equals_the_plain_version(texts):
    assert found(texts) == [None if t is None else plain(t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.text(ALPHABET, max_size=40))
def test_spans_are_places_of_the_text(text):
    last = 0
    for t in K.scanned([text]).to_pylist()[0]:
        assert last <= t["start"] < t["stop"] <= len(text)
        last = t["stop"]
        inner = [x for x, _ in plain(text[t["start"] : t["stop"]])]
        assert "".join(inner) == t["token"] or t["token"] == "."


def test_column(spark):
    df = spark.createDataFrame([(1, "A 1,5"), (2, None), (3, ""), (4, "x " * 50_000)], "id int, text string")
    rows = {r.id: r.t for r in df.select("id", K.tokens(F.col("text")).alias("t")).collect()}
    assert [tuple(x) for x in rows[1]] == [("a", False, 0, 1), ("15", True, 2, 5)]
    assert rows[2] is None and rows[3] == [] and len(rows[4]) == 50_000


def test_pieces_and_numbers():
    vocabulary = {k: 0 for k in ("un", "##able", "##a", "u")}
    assert K.pieces("unable", vocabulary, "?") == ["un", "##able"] and K.pieces("unx", vocabulary, "?") == ["?"] and K.pieces("u" * 65, vocabulary, "?") == ["?"]
    assert K.number_features("1234") == (4, 0, 1, 4) and K.number_features("12.345") == (2, 3, 1, 5) and K.number_features("7.") == (2, 0, 7, 7)
    assert K.number_features("1" * 30) == (10, 0, 1, 1)
