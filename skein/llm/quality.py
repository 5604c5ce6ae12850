"""Quality rules, lines first, with DataFrame operations only.

Each line is judged by rules on punctuation, navigation and boilerplate; lines that fail are
removed, and a document that loses too much of its text is rejected. Documents with too few
words or too much repetition are rejected besides. Everything happens within a row, so nothing
is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CLASS, WORD_CLASS, packed, table, unpacked

#: Phrases of boilerplate lines, in lower case, of English, German, French and Spanish pages. A
#: rule of this operator, fixed values.
BOILERPLATE = (
    "all rights reserved", "cookie", "copyright", "enable javascript", "licensed under", "lorem ipsum",
    "powered by", "privacy policy", "sign in", "sign up", "skip to content", "subscribe to", "terms of service",
    "terms of use", "alle rechte vorbehalten", "datenschutzerklärung", "impressum", "nutzungsbedingungen",
    "zum inhalt springen", "aller au contenu", "conditions d.utilisation", "mentions légales",
    "politique de confidentialité", "tous droits réservés", "aviso legal", "ir al contenido",
    "política de privacidad", "términos de uso", "todos los derechos reservados",
)
#: What ends a sentence: a mark, then closing quotes or brackets, then white space or the end.
ENDED = r"""[.!?…。！？]["'»”’)\]]*([\x20\x09-\x0D]|\z)"""
SYMBOLS = "[#*$%&|<>]"
WINDOW = 5


@dataclass(frozen=True)
class Rules:
    """``unended``: words from which on a line needs a mark that ends a sentence, somewhere
    (a point inside a number or a name doesn't end one).
    ``marks``: largest share of a line's characters that are neither letters, digits, white
    space nor common punctuation. ``pipes``: separators from which on a line is navigation.
    ``phrase_words``: longest line that a phrase makes boilerplate. ``most_lost``: largest share
    of the words' characters that a document may lose."""

    unended: int = 12
    marks: float = 0.15
    pipes: int = 3
    phrase_words: int = 30
    most_lost: float = 0.5
    least_words: int = 10
    most_repeated: int = 20


def line_fails(rules: Rules, line: str = "x", words: str = "n") -> str:
    """SQL condition on a line and its number of words: it fails a rule."""
    phrases = "|".join(BOILERPLATE)
    strange = _sql(r"""[^\p{L}\p{M}\p{N}\s.,;:?'"()\-]""")
    return (
        f"(regexp_count({line}, '[|»›•]') >= {rules.pipes}"
        f" OR ({words} >= {rules.unended} AND NOT {line} RLIKE '{_sql(ENDED)}')"
        f" OR ({words} <= {rules.phrase_words} AND {line} RLIKE '(?iu){phrases}')"
        f" OR regexp_count({line}, '{strange}') > {rules.marks} * length({line}))"
    )


def _sql(pattern: str) -> str:
    return pattern.replace("\\", "\\\\").replace("'", "\\'")


def judged(docs: DataFrame, rules: Rules | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with the columns n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, clean_text (the text without lines that fail; null for null), lost (the share
    of word characters in those lines) and kept; columns of these names are replaced.

    A null text has no words, so it fails; so does an empty one. Rows are judged alone: repeated
    rows give repeated results, an empty table an empty one. Texts of any length are judged
    whole. Lines end at \\n; those without a word never fail.
    """
    rules = rules or Rules()
    space = _sql(SPACE_CLASS)
    # The row is packed, so that no name of its columns can clash with those used here.
    df = packed(docs, F.col(text_col).alias("_text"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    df = df.withColumn("_w", F.expr(f"array_remove(split(_t, '{space}'), '')"))
    df = df.withColumn("_lines", F.expr(f"filter(split(_t, '\\n'), x -> x RLIKE '[^{space[1:-2]}]')"))
    df = df.withColumn("n_words", F.size("_w").cast("long"))
    df = df.withColumn("word_chars", F.length(F.array_join("_w", "")).cast("long"))
    df = df.withColumn("n_symbols", F.regexp_count("_t", F.lit(SYMBOLS)).cast("long"))
    df = df.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    # Each word is hashed once, and each window from its words' hashes.
    df = df.withColumn("_wh", F.expr("transform(_w, w -> xxhash64(w))"))
    following = ", ".join(f"get(_wh, i + {k})" for k in range(1, WINDOW))
    hashes = f"CASE WHEN n_words > {WINDOW} THEN transform(slice(_wh, 1, cast(n_words AS int) - {WINDOW - 1}), (h, i) -> xxhash64(h, {following})) END"
    df = df.withColumn("_h", F.expr(hashes))
    # Windows with their places, sorted; the places of those that equal a neighbour, sorted.
    ordered = "CASE WHEN size(array_distinct(_h)) < size(_h) THEN sort_array(transform(_h, (h, i) -> struct(h, i))) END"
    df = df.withColumn("_s", F.expr(ordered))
    twice = """array_sort(transform(filter(transform(_s, (x, k) -> struct(x.i AS i,
        (k > 0 AND get(_s, k - 1).h = x.h) OR coalesce(get(_s, k + 1).h = x.h, false) AS d)), x -> x.d), x -> x.i))"""
    df = df.withColumn("_at", F.expr(twice))
    covered = f"""aggregate(zip_with(_at, slice(_at, 2, size(_at)), (a, b) -> least({WINDOW}, coalesce(b - a, {WINDOW}))),
        0L, (t, x) -> t + x)"""
    df = df.withColumn("n_repeat_words", F.coalesce(F.expr(covered), F.lit(0)).cast("long"))
    df = df.withColumn(
        "base_failed",
        (F.col("n_words") < rules.least_words)
        | (F.col("n_repeat_words") * 100 > F.col("n_words") * rules.most_repeated),
    )
    counted = f"transform(_lines, x -> struct(x AS x, regexp_count(x, '{_sql(WORD_CLASS)}') AS n))"
    every = f"transform(split(_t, '\\n'), x -> struct(x AS x, regexp_count(x, '{_sql(WORD_CLASS)}') AS n))"
    fails = line_fails(rules, "p.x", "p.n")
    df = df.withColumn("_bad", F.expr(f"transform(filter({counted}, p -> {fails}), p -> p.x)"))
    df = df.withColumn(
        "lost",
        F.coalesce(
            F.try_divide(
                F.expr(f"length(array_join(array_remove(split(array_join(_bad, '\\n'), '{space}'), ''), ''))"), "word_chars"
            ),
            F.lit(0.0),
        ),
    )
    clean = F.when(F.size("_bad") == 0, F.col("_text")).otherwise(
        F.expr(f"array_join(transform(filter({every}, p -> NOT (p.n > 0 AND {fails})), p -> p.x), '\\n')")
    )
    new = {k: F.col(k) for k in [*BASE[:-1], "lost"]}
    new |= {"clean_text": clean, "kept": ~F.col("base_failed") & (F.col("lost") <= rules.most_lost)}
    columns = [c for c in docs.columns if c not in new]
    return df.select(*unpacked(columns, **new))


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents")).select("doc_id", *BASE, F.round("lost", 6).alias("lost"))
