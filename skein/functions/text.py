"""Column functions on identifiers, numbers, cells and prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def identifier_tokens(name: Column) -> Column:
    """Lower-cased parts of an identifier: split at white space and ``_ . , ; : -``, then at case
    changes. Digits and letters beyond ASCII vanish."""
    parts = F.split(name, r"[\s_.,;:\-]+")
    words = F.flatten(F.transform(parts, lambda p: F.regexp_extract_all(p, F.lit("([A-Z]?[a-z]+|[A-Z]+(?![a-z]))"), F.lit(1))))
    return F.transform(words, F.lower)


def word_tokens(text: Column) -> Column:
    """Lower-cased runs of two or more ASCII word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9_]{2,})"), F.lit(1))


def name_documents(columns: DataFrame) -> DataFrame:
    """(table_name, doc): the table's name and its columns' names, in catalog order."""
    names = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "column_name"))), lambda x: x["column_name"])
    grouped = columns.groupBy("table_name").agg(names.alias("names"))
    return grouped.select("table_name", F.concat_ws(" ", "table_name", F.array_join("names", " ")).alias("doc"))


def value_documents(columns: DataFrame, samples: DataFrame) -> DataFrame:
    """(table_name, doc): the name, then each column's name with its sampled values."""
    cell = F.concat_ws(" ", "column_name", F.array_join("values", " "))
    joined = columns.join(samples, ["table_name", "column_name"])
    parts = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", cell.alias("cell")))), lambda x: x["cell"])
    return joined.groupBy("table_name").agg(F.concat_ws(" ", F.first("table_name"), F.array_join(parts, " ")).alias("doc"))


def key_descriptions(tables: DataFrame, foreign_keys: DataFrame) -> DataFrame:
    """(table_name, text): a sentence for each key of the table and each key that refers to it."""
    columns = F.array_join("constrained_columns", ", ")
    own = foreign_keys.select(
        F.col("constrained_table").alias("table_name"), F.lit(0).alias("side"), "fk_id",
        F.concat(F.lit("Key ("), columns, F.lit(") refers to "), "referred_table", F.lit(".")).alias("s"),
    )
    incoming = foreign_keys.select(
        F.col("referred_table").alias("table_name"), F.lit(1).alias("side"), "fk_id",
        F.concat("constrained_table", F.lit(" refers to it by ("), columns, F.lit(").")).alias("s"),
    )
    sentences = own.unionByName(incoming).groupBy("table_name").agg(F.array_sort(F.collect_list(F.struct("side", "fk_id", "s"))).alias("all"))
    text = F.array_join(F.transform("all", lambda x: x["s"]), " ")
    return tables.select("table_name").join(sentences, "table_name", "left").select("table_name", F.coalesce(text, F.lit("")).alias("text"))


#: Prompts by kind; ``${name}`` is filled from a column of that name.
PROMPTS = {
    "full": "Say in one paragraph what table ${table_name} is for. Columns: ${schema}. Primary key: ${pk}. ${fk_description} Sample: ${sample_data}. Description:",
    "without_data": "Say in one paragraph what table ${table_name} is for. Columns: ${schema}. Primary key: ${pk}. ${fk_description} Description:",
    "without_schema": "Say in one paragraph what table ${table_name} is for. Sample: ${sample_data}. Description:",
    "without_name": "Say in one paragraph what a table is for. Columns: ${schema}. Primary key: ${pk}. Description:",
    "name_only": "Say in one paragraph what a table called ${table_name} is for. Description:",
    "plain": "${table_name} ${schema}",
}


def rendered(template: str, **values: Column) -> Column:
    out = F.lit(template)
    for name, value in values.items():
        if "${" + name + "}" in template:
            out = F.replace(out, F.lit("${" + name + "}"), F.coalesce(value, F.lit("")))
    return out


def completion(text: Column) -> Column:
    """What follows the last ``Description:`` of a completion."""
    return F.trim(F.element_at(F.split(text, "Description:"), -1))


def number_features(token: Column, cap: int = 10) -> Column:
    """(magnitude, precision, first, last) of a number in text: digits before and after the
    point, its first and last digit; each capped."""
    whole = F.regexp_replace(F.split_part(token, F.lit("."), F.lit(1)), r"\D", "")
    frac = F.regexp_replace(F.split_part(token, F.lit("."), F.lit(2)), r"\D", "")
    digits = F.concat(whole, frac)
    digit = lambda s: F.coalesce(F.try_to_number(F.nullif(s, F.lit("")), F.lit("9")).cast("int"), F.lit(cap))
    return F.struct(
        F.least(F.length(whole), F.lit(cap)).alias("magnitude"), F.least(F.length(frac), F.lit(cap)).alias("precision"),
        F.least(digit(F.substring(digits, 1, 1)), F.lit(cap)).alias("first"), F.least(digit(F.right(digits, F.lit(1))), F.lit(cap)).alias("last"),
    )


def cut_cell(value: Column, width: int = 20) -> Column:
    return F.substring(value.cast("string"), 1, width)


def _split(text: Column) -> Column:
    return F.array_remove(F.split(text, r"\s+"), "")


def snippets(text: Column, n: int = 10) -> Column:
    """The text's words in snippets of ``n`` at most."""

    def of(words: Column) -> Column:
        starts = F.when(F.size(words) > 0, F.sequence(F.lit(1), F.size(words), F.lit(n))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))

    # As a lambda's variable the words are split once a text, not once for every snippet.
    return F.get(F.transform(F.array(_split(text)), of), F.lit(0))


def snippet_count(text: Column, n: int = 10) -> Column:
    """How many ``snippets`` a text has; null for null."""
    return F.ceil(F.size(_split(text)) / n).cast("int")


def with_snippets(text: Column, wanted: Column, n: int = 10) -> Column:
    """``wanted``, an array of structs, each with ``value``: the snippet of the text that its
    ``at`` numbers from 0, empty beyond the last."""

    def of(words: Column) -> Column:
        return F.transform(wanted, lambda w: w.withField("value", F.array_join(F.slice(words, w["at"] * n + 1, F.lit(n)), " ")))

    return F.get(F.transform(F.array(_split(text)), of), F.lit(0))


def cell_index(row: Column, column: Column, width: Column) -> Column:
    return row * width + column


def cell_place(index: Column, width: Column) -> Column:
    return F.struct(F.floor(index / width).cast("int").alias("row"), (index % width).cast("int").alias("column"))


DEGREES = (32, 32, 64, 256)


def tree_index(position: Column, degrees: tuple[int, ...] = DEGREES) -> Column:
    """Each level's place in one numbering of all levels. No place (-1): the number of all
    nodes; a place beyond the level's degree: the end of that level."""
    total = sum(degrees)
    offsets = [sum(degrees[:i]) for i in range(len(degrees))]
    size, start = F.array(*map(F.lit, degrees)), F.array(*map(F.lit, offsets))

    def one(p: Column, i: Column) -> Column:
        return F.when(p < 0, F.lit(total)).when(p >= F.get(size, i), F.lit(total)).otherwise(p + F.get(start, i))

    return F.transform(position, one)


def address_range(address: Column) -> Column:
    """0-based bounds of a spreadsheet range such as ``A5:CB43``."""

    def number(letters: Column) -> Column:
        chars = F.filter(F.split(F.upper(letters), ""), lambda c: c != "")
        return F.aggregate(chars, F.lit(0), lambda a, c: a * 26 + F.ascii(c) - 64) - 1

    part = lambda i, g: F.regexp_extract(F.split_part(address, F.lit(":"), F.lit(i)), r"([A-Za-z]+)(\d+)", g)
    row = lambda s: s.cast("int") - 1
    return F.struct(
        row(part(1, 2)).alias("row_from"), row(part(-1, 2)).alias("row_to"),
        number(part(1, 1)).alias("column_from"), number(part(-1, 1)).alias("column_to"),
    )


#: Labels of annotated cells. Fixed values.
CELL_LABELS = {"metadata": 0, "notes": 1, "data": 2, "top_attribute": 3, "left_attribute": 4, "derived": 5}


def cell_label(name: Column) -> Column:
    pairs = [F.lit(x) for k, v in CELL_LABELS.items() for x in (k, v)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), name), F.lit(-1))


def scaled(values: Column, ranges: list[float]) -> Column:
    """Format features: each value capped at its range and divided by it."""
    top = F.array(*[F.lit(float(r)) for r in ranges])
    return F.transform(values, lambda v, i: F.least(v, F.get(top, i)) / F.get(top, i))


def f1(precision: Column, recall: Column) -> Column:
    return F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))


def clean_text(text: Column) -> Column:
    """Without control characters and U+FFFD, any white space as a space, CJK set apart."""
    t = F.regexp_replace(text, r"[\t\n\r\p{Zs}]", " ")
    t = F.regexp_replace(t, r"[\p{C}\x{FFFD}]", "")
    return F.regexp_replace(t, r"([\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}])", " $1 ")


def spaced_punctuation(text: Column) -> Column:
    return F.regexp_replace(text, r"([\p{P}$+<=>^`|~])", " $1 ")


def plain_number(text: Column) -> Column:
    """A number without thousands separators; more than one point splits it in several."""
    t = F.regexp_replace(text, r"(?<=\d),(?=\d)", "")
    return F.when(F.size(F.split(t, r"\.")) > 2, F.split(t, r"\.")).otherwise(F.array(t))
