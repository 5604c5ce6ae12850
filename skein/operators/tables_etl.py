"""From sheets and web tables to token sequences: cells, formats, tokens, masks.

A table is (table_id, texts, regions, tree JSON); its cells and tokens are rows. Text rules that
built-in functions can't express run in Arrow-batched pandas functions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import tokens as K

UNKNOWN, SEPARATOR, EMPTY, MASK, CLS, VALUE = "[UNK]", "[SEP]", "[EMP]", "[MASK]", "[CLS]", "[VAL]"


def cells(tables: DataFrame) -> DataFrame:
    """(table_id, row, column, value): a row for each cell of ``texts``."""
    rows = tables.select("table_id", F.posexplode("texts").alias("row", "line"))
    return rows.select("table_id", "row", F.posexplode("line").alias("column", "value"))


def within_caps(tables: DataFrame, rows: int = 256, columns: int = 256) -> DataFrame:
    widest = F.aggregate("texts", F.lit(0), lambda a, r: F.greatest(a, F.size(r)))
    return tables.where((F.size("texts") <= rows) & (widest <= columns))


def with_headers(tables: DataFrame, hierarchical: bool) -> DataFrame:
    """Tables whose headers have several rows or columns, or those that don't."""
    deep = (F.col("top_header_rows") > 1) | (F.col("left_header_columns") > 1)
    return tables.where(deep if hierarchical else ~deep)


def merged_cells(cell: DataFrame, regions: DataFrame) -> DataFrame:
    """``cell`` with its merged region's first cell (first_row, first_column), or its own.

    Regions are expanded to the cells they cover, so this is an equi-join; a region is at most
    the table's size.
    """
    covered = regions.withColumn("row", F.explode(F.sequence("row_from", "row_to"))).withColumn("column", F.explode(F.sequence("column_from", "column_to")))
    covered = covered.groupBy("table_id", "row", "column").agg(F.min(F.struct("row_from", "column_from")).alias("r"))
    joined = cell.join(covered, ["table_id", "row", "column"], "left")
    return joined.select(*cell.columns, F.coalesce("r.row_from", "row").alias("first_row"), F.coalesce("r.column_from", "column").alias("first_column"))


def format_features(cell: DataFrame) -> DataFrame:
    """``cell`` (with data_type, bold, borders and colours) and ``format``: 0/1 flags."""
    flag = lambda c: F.coalesce(F.col(c).cast("int"), F.lit(0))
    names = ["merged", "data_type", "formula", "bold", "top_border", "bottom_border", "left_border", "right_border", "fill", "font_color", "italic"]
    flags = [flag(c) if c in cell.columns else F.lit(0) for c in names]
    return cell.withColumn("format", F.array(*flags))


TOKEN = "token string, id int, magnitude int, precision int, first int, last int"
#: Features of a token that is no number.
NO_NUMBER = (11, 11, 11, 11)


def _entries(token: str, vocabulary: dict[str, int]) -> list[tuple]:
    """What a word or number becomes: pieces, or one token with its number's features. A number
    that isn't in the vocabulary as a whole is ``[VAL]``."""
    unk = vocabulary.get(UNKNOWN, 0)
    if token[0] in "0123456789":
        name = token if token in vocabulary and "." not in token else VALUE
        return [(name, vocabulary.get(name, unk), *K.number_features(token))]
    return [(p, vocabulary.get(p, unk), *NO_NUMBER) for p in K.pieces(token, vocabulary, UNKNOWN)]


def _of_cells(texts: pa.Array, vocabulary: dict[str, int], most: int) -> tuple[np.ndarray, pa.Table]:
    """(cell of each token, tokens): each cell's tokens after a separator, an empty cell's one
    token of its own, the first ``most`` of them. Each distinct word of the batch is cut once."""
    lists = K.scanned(texts.to_pylist())
    words = lists.flatten().field(0).dictionary_encode()
    entries = [_entries(w, vocabulary) for w in words.dictionary.to_pylist()]
    special = [(t, vocabulary.get(t, 0), *NO_NUMBER) for t in (SEPARATOR, EMPTY)]
    size = np.array([len(e) for e in entries], np.int64)
    bounds = np.concatenate([[0], np.cumsum(size)])
    sep, emp = int(bounds[-1]), int(bounds[-1]) + 1
    column = [pa.array(x, t) for x, t in zip(zip(*[x for e in entries for x in e], *special), (pa.string(), *[pa.int32()] * 5), strict=True)]
    per_cell = np.diff(np.asarray(lists.offsets))
    at = np.asarray(words.indices).astype(np.int64)
    count = size[at]
    # Places of all pieces of all words, in order.
    flat = np.repeat(bounds[at] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum()) if len(at) else at
    cell_of = np.repeat(np.repeat(np.arange(len(per_cell)), per_cell), count)
    blank = np.setdiff1d(np.arange(len(per_cell)), cell_of)
    cell_of = np.concatenate([np.arange(len(per_cell)), blank, cell_of])
    flat = np.concatenate([np.full(len(per_cell), sep), np.full(len(blank), emp), flat])
    order = np.argsort(cell_of, kind="stable")
    cell_of, flat = cell_of[order], flat[order]
    place = np.arange(len(flat)) - np.searchsorted(cell_of, cell_of)
    kept = place < most
    names = ["token", "id", "magnitude", "precision", "first", "last"]
    table = pa.table({"order": pa.array(place[kept].astype(np.int32)), **{n: c.take(pa.array(flat[kept])) for n, c in zip(names, column, strict=True)}})
    return cell_of[kept], table


def cell_tokens(text: str | None, vocabulary: dict[str, int], most: int = 8) -> list[tuple]:
    """The tokens of one cell: (token, id, magnitude, precision, first, last)."""
    return [tuple(r.values())[1:] for r in _of_cells(pa.array([text], pa.string()), vocabulary, most)[1].to_pylist()]


def tokens(cell: DataFrame, vocabulary: dict[str, int], most: int = 8) -> DataFrame:
    """(table_id, row, column, order, token, id, magnitude, ...): a row for each token of each
    cell. The vocabulary is a few ten thousand entries and goes to every executor."""
    sent = cell.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                at, out = _of_cells(b.column(3), sent.value, most)
                keys = pa.table({n: b.column(i).take(pa.array(at)) for i, n in enumerate(("table_id", "row", "column"))})
                for n in out.column_names:
                    keys = keys.append_column(n, out[n])
                yield from keys.combine_chunks().to_batches()

    kind = dict(cell.dtypes)["table_id"]
    return cell.select("table_id", "row", "column", "value").mapInArrow(run, f"table_id {kind}, row int, column int, order int, {TOKEN}")


def kinds(cell: DataFrame, vocabulary: dict[str, int], most: int = 8) -> DataFrame:
    """(table_id, row, column, kind, ids): what ``sheets.cell_kinds`` makes of ``tokens``, where
    (table_id, row, column) tells cells apart. A row for each cell, as its tokens are made, so no
    token is shuffled."""
    sent = cell.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                at, out = _of_cells(b.column(3), sent.value, most)
                number = out["magnitude"].to_numpy() != NO_NUMBER[0]
                text = ~number & ~pc.is_in(out["token"], pa.array([SEPARATOR, EMPTY])).to_numpy()
                has = [np.bincount(at[x], minlength=b.num_rows) > 0 for x in (number, text)]
                bounds = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=b.num_rows))])
                of_cell = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), out["id"].combine_chunks())
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array((has[0] + 2 * has[1]).astype(np.int32)), of_cell], ["table_id", "row", "column", "kind", "ids"])

    kind = dict(cell.dtypes)["table_id"]
    return cell.select("table_id", "row", "column", "value").mapInArrow(run, f"table_id {kind}, row int, column int, kind int, ids array<int>")


def ids(token_rows: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Tokens with their ids from (token, id); unknown ones have the id of ``[UNK]``."""
    unk = vocabulary.where(F.col("token") == UNKNOWN).agg(F.coalesce(F.max("id"), F.lit(0)).alias("_unk"))
    return token_rows.drop("id").join(vocabulary, "token", "left").join(F.broadcast(unk)).withColumn("id", F.coalesce("id", "_unk")).drop("_unk")


def _number_of(*key: Column | str, seed: int) -> Column:
    """32 bits drawn by the key."""
    named = [F.col(c) if isinstance(c, str) else c for c in key]
    text = F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in named])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def _chance(*key: Column | str, seed: int) -> Column:
    return _number_of(*key, seed=seed) / float(1 << 32)


def sampled_cells(cell: DataFrame, text_rate: float = 0.5, value_rate: float = 0.1, seed: int = 43) -> DataFrame:
    """``cell`` with ``valid``: headers always, other cells by chance, numbers less often."""
    number = F.coalesce(F.col("value").rlike(r"^\s*[-+]?[\d.,]+%?\s*$"), F.lit(False))
    rate = F.when(number, value_rate).otherwise(text_rate)
    header = F.coalesce(F.col("is_header"), F.lit(False)) if "is_header" in cell.columns else F.lit(False)
    return cell.withColumn("valid", (header | (_chance("table_id", "row", "column", seed=seed) < rate)).cast("int"))


def masked(token_rows: DataFrame, vocabulary: dict[str, int], rate: float = 0.15, seed: int = 43, whole_cell: bool = False) -> DataFrame:
    """Tokens with ``label`` (the id to predict, or -1) and ``id`` masked: of those chosen 80%
    become the id of ``[MASK]``, 10% a random id of the vocabulary, 10% stay. ``whole_cell``
    chooses cells, not tokens."""
    key = ["table_id", "row", "column"] if whole_cell else ["table_id", "row", "column", "order"]
    special = F.col("token").isin(SEPARATOR, CLS, EMPTY)
    chosen = ~special & (_chance(*key, seed=seed) < rate)
    how = _chance(*key, "order", F.lit("how"), seed=seed) if whole_cell else _chance(*key, F.lit("how"), seed=seed)
    # Ids are the places of the vocabulary's tokens, 0 to its size less one.
    other = F.pmod(_number_of(*key, "order", F.lit("id"), seed=seed), F.lit(len(vocabulary))).cast("int")
    new = F.when(chosen & (how < 0.8), F.lit(vocabulary[MASK])).when(chosen & (how < 0.9), other).otherwise(F.col("id"))
    return token_rows.withColumn("label", F.when(chosen, F.col("id")).otherwise(-1)).withColumn("id", new)


def sequences(token_rows: DataFrame, vocabulary: dict[str, int], most: int = 2048) -> DataFrame:
    """(table_id, length, tokens, indicator, rows, columns): a table's tokens in cell order,
    after the token ``[CLS]``; ``indicator`` numbers cells from 1. Longer ones are left out."""
    cell = F.dense_rank().over(Window.partitionBy("table_id").orderBy("row", "column"))
    item = F.struct("row", "column", "order", "id", cell.alias("cell"))
    ordered = token_rows.withColumn("item", item).groupBy("table_id").agg(F.array_sort(F.collect_list("item")).alias("all"))
    pick = lambda c, start: F.concat(F.array(F.lit(start)), F.transform("all", lambda x: x[c]))
    out = ordered.select(
        "table_id", (F.size("all") + 1).alias("length"), pick("id", vocabulary[CLS]).alias("tokens"), pick("cell", 0).alias("indicator"),
        pick("row", -1).alias("rows"), pick("column", -1).alias("columns"),
    )
    return out.where(F.col("length") <= most)


def pooled(states: DataFrame, how: str = "avg") -> DataFrame:
    """(table_id, indicator, vector): token states (table_id, indicator, state) of a cell summed
    or averaged."""
    dims = states.select("table_id", "indicator", F.posexplode("state")).groupBy("table_id", "indicator", "pos").agg((F.avg if how == "avg" else F.sum)("col").alias("m"))
    return dims.groupBy("table_id", "indicator").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]).alias("vector"))


def annotated(cell: DataFrame, annotations: DataFrame) -> DataFrame:
    """``cell`` with the label of the annotated range (table_id, address, name) that covers it;
    -1 without one. Ranges are expanded to cells, the last range by address wins."""
    r = annotations.withColumn("r", T.address_range(F.col("address"))).select("table_id", "name", "address", "r.*")
    covered = r.withColumn("row", F.explode(F.sequence("row_from", "row_to"))).withColumn("column", F.explode(F.sequence("column_from", "column_to")))
    label = covered.groupBy("table_id", "row", "column").agg(F.max_by("name", "address").alias("name"))
    return cell.join(label, ["table_id", "row", "column"], "left").withColumn("label", T.cell_label(F.col("name"))).drop("name")


def sheet_id(blob: Column, sheet: Column) -> Column:
    return F.concat_ws("-", blob, sheet)


def joined_folds(flat: DataFrame, folds: DataFrame) -> DataFrame:
    """Sheets of a flat repository with their fold and part, by file and table."""
    return flat.join(folds, ["file_name", "table_id"])
