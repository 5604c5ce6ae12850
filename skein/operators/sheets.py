"""Sheets with header trees: cells' paths in both trees, windows by a token budget, sequences.

A sheet is a row (table_id, texts, regions, top_tree, left_tree). A tree is JSON: a node has its
cell (``RI``, ``CI``) and children (``Cd``); the root has no cell. What a header tree says about a
cell is found by an interval join: each node is a rectangle of cells, its own cell or, for a leaf,
the data that it heads as well, and a cell takes the last rectangle that covers it.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.text import DEGREES, tree_index
from . import tables_etl as Z

LEVELS = len(DEGREES)
NODES = "struct<state: string, nodes: array<struct<row: int, column: int, leaf: boolean, path: array<int>>>>"
REGION = "array<struct<FirstRow: int, LastRow: int, FirstColumn: int, LastColumn: int>>"


def unfolded(tree: str | None) -> dict:
    """A tree's nodes below the root, depth first, with their paths: the number of each ancestor
    among its siblings and its own, the last level of the deepest branch in the last place, -1
    elsewhere. ``state`` is ``none`` without a node, ``deep`` for more levels than paths have,
    ``wide`` if a node has more children than its level allows, ``broken`` if it can't be read."""
    try:
        root = json.loads(tree) if tree else None
        if not root or not root["Cd"]:
            return {"state": "none", "nodes": []}
        rows, stack, deepest = [], [(root, ())], 0
        while stack:
            node, path = stack.pop()
            children = node["Cd"] or []
            deepest = max(deepest, len(path))
            rows.append((node, path, len(children)))
            stack += [(c, (*path, k)) for k, c in reversed(list(enumerate(children)))]
        if deepest > LEVELS:
            return {"state": "deep", "nodes": []}
        first = LEVELS - deepest
        if any(n and n > DEGREES[first + len(path)] for _, path, n in rows):
            return {"state": "wide", "nodes": []}
        full = lambda path: [-1] * first + list(path) + [-1] * (LEVELS - first - len(path))
        nodes = [{"row": int(node["RI"]), "column": int(node["CI"]), "leaf": not n, "path": full(path)} for node, path, n in rows[1:]]
        return {"state": "ok", "nodes": nodes}
    except (ValueError, KeyError, TypeError, AttributeError):
        return {"state": "broken", "nodes": []}


def nodes(tree: Column) -> Column:
    """``unfolded`` for a column of trees."""

    def run(trees: pa.Array) -> pa.Array:
        path = pa.list_(pa.int32())
        node = pa.struct([("row", pa.int32()), ("column", pa.int32()), ("leaf", pa.bool_()), ("path", path)])
        return pa.array([unfolded(t) for t in trees.to_pylist()], pa.struct([("state", pa.string()), ("nodes", pa.list_(node))]))

    return F.arrow_udf(run, NODES)(tree)


def _rectangles(tree: Column, regions: Column, height: Column, width: Column, top: bool) -> Column:
    """(row_from, row_to, column_from, column_to, path, order) for each node of the tree: its own
    cell, and for a leaf the data below (or right of) it, over its merged region's width."""

    def of(n: Column, i: Column) -> Column:
        inside = lambda r: n["row"].between(r["FirstRow"], r["LastRow"]) & n["column"].between(r["FirstColumn"], r["LastColumn"])
        merged = F.try_element_at(F.filter(regions, inside), F.lit(1))
        span = lambda a, b, own: (F.coalesce(merged[a], own), F.coalesce(merged[b], own))
        own = F.struct(n["row"].alias("row_from"), n["row"].alias("row_to"), n["column"].alias("column_from"), n["column"].alias("column_to"), n["path"].alias("path"), (2 * i).alias("order"))
        if top:
            a, b = span("FirstColumn", "LastColumn", n["column"])
            data = F.struct((n["row"] + 1).alias("row_from"), (height - 1).alias("row_to"), a.alias("column_from"), b.alias("column_to"), n["path"].alias("path"), (2 * i + 1).alias("order"))
        else:
            a, b = span("FirstRow", "LastRow", n["row"])
            data = F.struct(a.alias("row_from"), b.alias("row_to"), (n["column"] + 1).alias("column_from"), (width - 1).alias("column_to"), n["path"].alias("path"), (2 * i + 1).alias("order"))
        return F.when(n["leaf"], F.array(own, data)).otherwise(F.array(own))

    return F.flatten(F.transform(tree["nodes"], of))


def placed(sheets: DataFrame, rows: int = 256, columns: int = 256) -> DataFrame:
    """(table_id, row, column, value, top, left): each cell with its paths in the top and the left
    header tree, [-1, -1, -1, -1] where no node heads it.

    A tree without a node, or one with too many children in a level, gives way to the cell's own
    column (row) number in the last place, if that level has so many. A tree of more levels than
    a path has leaves all paths empty. A sheet is left out, and no other with it, if a tree can't
    be read, a node or a leaf's merged region lies outside the sheet, it has no id, or the sheet is
    larger than ``rows`` x ``columns``; the first row says how wide it is. Ids tell sheets apart. Of several regions over one cell the first counts, of several nodes
    over one cell the last, depth first.
    """
    height, width = F.size("texts"), F.size(F.try_element_at("texts", F.lit(1)))
    sized = sheets.where((F.size("texts") > 0) & F.col("table_id").isNotNull()).select(
        "table_id", "texts", F.coalesce("regions", F.array().cast(REGION)).alias("regions"), height.alias("height"), width.alias("width"),
        nodes(F.col("top_tree")).alias("top"), nodes(F.col("left_tree")).alias("left"),
    )
    sized = sized.where((F.col("height") <= rows) & (F.col("width") <= columns) & (F.col("width") > 0))
    for side in ("top", "left"):
        sized = sized.withColumn(f"{side}_of", _rectangles(F.col(side), F.col("regions"), F.col("height"), F.col("width"), side == "top"))
    low = lambda c: c["row_from"].isNull() | c["column_from"].isNull() | (c["row_from"] < 0) | (c["column_from"] < 0)
    empty = lambda c: (c["row_to"] < c["row_from"]) | (c["column_to"] < c["column_from"])
    out = lambda c: ~empty(c) & (low(c) | (c["row_to"] >= F.col("height")) | (c["column_to"] >= F.col("width")))
    bad = [(F.col(side)["state"] == "broken") | F.exists(f"{side}_of", out) for side in ("top", "left")]
    good = sized.where(~(bad[0] | bad[1]))
    facts = [F.col(f"{side}.state").alias(f"_{side}") for side in ("top", "left")]
    cell = good.select("table_id", "height", "width", *facts, F.posexplode("texts").alias("row", "line"))
    cell = cell.select("table_id", "row", F.posexplode("line").alias("column", "value"), "height", "width", "_top", "_left")
    cell = cell.where(F.col("column") < F.col("width"))
    none = F.array(*[F.lit(-1)] * LEVELS)
    for side, along, across, size in (("top", "column", "row", "width"), ("left", "row", "column", "height")):
        lines = good.select(F.col("table_id").alias("_id"), F.explode(f"{side}_of").alias("r")).select("_id", "r.*")
        lines = lines.where(F.col("row_from") <= F.col("row_to")).where(F.col("column_from") <= F.col("column_to"))
        # Intervals along the header become equal keys; those across it stay a range.
        lines = lines.select("_id", F.explode(F.sequence(f"{along}_from", f"{along}_to")).alias("_along"), F.col(f"{across}_from").alias("_from"), F.col(f"{across}_to").alias("_to"), "path", "order")
        covers = (F.col("_id") == F.col("table_id")) & (F.col("_along") == F.col(along)) & F.col(across).between(F.col("_from"), F.col("_to"))
        flat = F.when(F.col(f"_{side}").isin("none", "wide") & (F.col(size) <= DEGREES[-1]), F.array(*[F.lit(-1)] * (LEVELS - 1), F.col(along))).otherwise(none)
        found = cell.join(lines, covers, "left").groupBy(*cell.columns).agg(F.max_by("path", "order").alias("_path"))
        cell = found.select(*cell.columns, F.coalesce("_path", flat).alias(side))
    return cell.select("table_id", "row", "column", "value", "top", "left")


def pivoted(facts: DataFrame, table_id: str, rows: tuple[str, str], columns: tuple[str, str], value: Column) -> DataFrame:
    """A sheet for each ``table_id`` of ``facts``: two levels of row headers, two of column
    headers, ``value`` aggregated in the cells (empty where there is nothing), with both trees
    and the merged regions of the upper levels. Header values are shown as text, in order."""
    r, c = [F.col(x) for x in rows], [F.col(x) for x in columns]
    body = facts.groupBy(table_id, *rows, *columns).agg(value.cast("string").alias("_v"))
    side = lambda a, b: F.array_sort(F.collect_set(F.struct(a.alias("a"), b.alias("b"))))
    whole = body.groupBy(table_id).agg(side(*r).alias("r"), side(*c).alias("c"), F.map_from_entries(F.collect_list(F.struct(F.struct(r[0].alias("a"), r[1].alias("b"), c[0].alias("c"), c[1].alias("d")).alias("k"), F.col("_v").alias("v")))).alias("m"))
    text = lambda x: F.coalesce(x.cast("string"), F.lit(""))
    blank = F.array(F.lit(""), F.lit(""))
    first = lambda xs: F.transform(xs, lambda x, i: F.when((i == 0) | ~F.get(xs, i - 1)["a"].eqNullSafe(x["a"]), text(x["a"])).otherwise(""))
    whole = whole.withColumns({"_r": first(F.col("r")), "_c": first(F.col("c"))})
    value = lambda x, y: text(F.try_element_at("m", F.struct(x["a"].alias("a"), x["b"].alias("b"), y["a"].alias("c"), y["b"].alias("d"))))
    line = lambda x, i: F.concat(F.array(F.get("_r", i), text(x["b"])), F.transform("c", lambda y: value(x, y)))
    texts = F.concat(F.array(F.concat(blank, "_c"), F.concat(blank, F.transform("c", lambda y: text(y["b"])))), F.transform("r", line))

    def groups(name: str) -> Column:
        """(start, stop) of each run of equal first values, in cells."""
        xs = F.col(name)
        starts = F.filter(F.sequence(F.lit(0), F.size(xs) - 1), lambda i: (i == 0) | ~F.get(xs, i - 1)["a"].eqNullSafe(F.get(xs, i)["a"]))
        return F.transform(starts, lambda s, k: F.struct((s + 2).alias("start"), (F.coalesce(F.get(starts, k + 1), F.size(xs)) + 1).alias("stop")))

    def tree(name: str, top: bool) -> Column:
        at = lambda line, place: (F.lit(line).alias("RI"), place.alias("CI")) if top else (place.alias("RI"), F.lit(line).alias("CI"))
        leaf = lambda i: F.struct(*at(1, i), F.array().cast("array<int>").alias("Cd"))
        node = lambda g: F.struct(*at(0, g["start"]), F.transform(F.sequence(g["start"], g["stop"]), leaf).alias("Cd"))
        return F.to_json(F.struct(F.lit(-1).alias("RI"), F.lit(-1).alias("CI"), F.transform(groups(name), node).alias("Cd")))

    region = lambda a, b, c, d: F.struct(a.alias("FirstRow"), b.alias("LastRow"), c.alias("FirstColumn"), d.alias("LastColumn"))
    regions = F.concat(F.transform(groups("c"), lambda g: region(F.lit(0), F.lit(0), g["start"], g["stop"])), F.transform(groups("r"), lambda g: region(g["start"], g["stop"], F.lit(0), F.lit(0))))
    return whole.select(F.col(table_id).cast("string").alias("table_id"), texts.alias("texts"), regions.alias("regions"), tree("c", True).alias("top_tree"), tree("r", False).alias("left_tree"))


def budget_windows(cell: DataFrame, budget: int, back: int = 3) -> DataFrame:
    """(table_id, row, column, length, window, repeated): the cells of each table in windows of
    less than ``budget`` tokens, a start token included.

    A window takes cells in reading order until the next one would reach the budget. The one after
    it starts ``back`` rows before the row of that cell, or as few rows less as are needed to
    start later than this window did; a row that reaches the budget by itself is cut, and its
    rest is in no window. ``repeated`` marks cells that an earlier window has. ``cell`` has
    (table_id, row, column, length); rows are numbered from 0, and rows without a cell count.

    Where a window starts depends on where the last one ended, so starts come from a fold over
    each table's rows, with their running totals only; tables, not rows, must fit in a task.
    """
    totals = cell.groupBy("table_id", "row").agg(F.sum("length").alias("n"))
    running = totals.withColumn("n", F.sum("n").over(Window.partitionBy("table_id").orderBy("row")))
    sums = running.groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct("row", "n"))).alias("s"))
    upto = lambda s, r: F.coalesce(F.element_at(F.filter(s, lambda x: x["row"] <= r), -1)["n"], F.lit(0))
    dense = sums.select("table_id", F.transform(F.sequence(F.lit(0), F.element_at("s", -1)["row"]), lambda r: F.when(r < F.element_at("s", 1)["row"], F.lit(0)).otherwise(upto(F.col("s"), r))).alias("p"))
    empty = F.array().cast("array<struct<start: int, cut: int>>")

    def step(acc: Column, i: Column) -> Column:
        p = F.col("p")
        before = F.when(acc["start"] > 0, F.get(p, acc["start"] - 1)).otherwise(F.lit(0))
        over = (acc["start"] <= i) & (1 + F.get(p, i) - before >= budget)
        start = F.when(i - back > acc["start"], i - back)
        for k in range(back - 1, -1, -1):
            start = start.when(i - k > acc["start"], i - k)
        start = start.otherwise(i + 1)
        more = F.concat(acc["windows"], F.array(F.struct(acc["start"].alias("start"), i.alias("cut"))))
        return F.struct(F.when(over, start).otherwise(acc["start"]).alias("start"), F.when(over, more).otherwise(acc["windows"]).alias("windows"))

    def row(acc: Column, i: Column) -> Column:
        # A row may end several windows, each of which starts later; after it none reaches it.
        return F.aggregate(F.sequence(F.lit(0), F.lit(back + 1)), acc, lambda a, _: step(a, i))

    n = F.size("p")
    folded = F.aggregate(F.sequence(F.lit(0), n - 1), F.struct(F.lit(0).alias("start"), empty.alias("windows")), row)
    last = F.when(F.col("f.start") < n, F.array(F.struct(F.col("f.start").alias("start"), n.alias("cut")))).otherwise(empty)
    windows = dense.select("table_id", "p", folded.alias("f")).select("table_id", "p", F.posexplode(F.concat("f.windows", last)).alias("window", "w"))
    before = F.when(F.col("w.start") > 0, F.get("p", F.col("w.start") - 1)).otherwise(F.lit(0))
    lines = windows.select("table_id", "window", F.col("w.cut").alias("cut"), before.alias("before"), F.explode(F.sequence("w.start", F.least(F.col("w.cut"), n - 1))).alias("row"), "p")
    lines = lines.select("table_id", "window", "row", "cut", (F.when(F.col("row") > 0, F.get("p", F.col("row") - 1)).otherwise(F.lit(0)) - F.col("before")).alias("used"))
    ahead = cell.withColumn("_in_row", F.sum("length").over(Window.partitionBy("table_id", "row").orderBy("column")))
    both = ahead.join(lines, ["table_id", "row"])
    kept = both.where((F.col("row") < F.col("cut")) | (1 + F.col("used") + F.col("_in_row") < budget))
    first = F.min("window").over(Window.partitionBy("table_id", "row", "column"))
    return kept.select(*cell.columns, "window", (F.col("window") > first).alias("repeated"))


#: What a cell is to a sequence.
LEFT_OUT, PLAIN, BLANK, HIDDEN = range(4)


def cell_kinds(token_rows: DataFrame) -> DataFrame:
    """(table_id, row, column, kind, ids): 0 for an empty cell, 1 for one of numbers alone, 2 for
    text, 3 for both; and its token ids in order."""
    body = F.col("token") != Z.SEPARATOR
    number = body & (F.col("magnitude") != Z.NO_NUMBER[0])
    word = body & (F.col("token") != Z.EMPTY) & (F.col("magnitude") == Z.NO_NUMBER[0])
    each = token_rows.groupBy("table_id", "row", "column").agg(
        F.coalesce(F.bool_or(number), F.lit(False)).alias("_n"), F.coalesce(F.bool_or(word), F.lit(False)).alias("_w"),
        F.transform(F.array_sort(F.collect_list(F.struct("order", "id"))), lambda x: x["id"]).alias("ids"),
    )
    kind = F.when(F.col("_n") & F.col("_w"), 3).when(F.col("_w"), 2).when(F.col("_n"), 1).otherwise(0)
    return each.select("table_id", "row", "column", kind.alias("kind"), "ids")


def marked(
    cell: DataFrame, header_rows: int, header_columns: int, text_rate: float = 0.5, value_rate: float = 0.1,
    rate: float = 0.2, most: int = 20, blank_rate: float = 0.3, seed: int = 43, always: Column | None = None, left_out: bool = True,
) -> DataFrame:
    """``cell`` (of ``cell_kinds``) with ``mark``: left out, plain, blank or hidden.

    Empty cells are left out; of the others headers stay, and data by chance: text at
    ``text_rate``, any with a number at ``value_rate``, all for which ``always`` holds (such as a label that is to be learned). At most ``most`` cells of a table, and
    ``rate`` of its weight (a text cell weighs 2, one of numbers 1), are blanked or hidden,
    numbers never. Hidden ones are drawn first, two fifths to three fifths of that. Blanks are
    drawn without replacement from each header row, each header column, their corner and the
    data: 1 to 3 of each, about ``blank_rate``; then as many of them as are still allowed. All
    draws are by a seeded hash, so they depend on neither order nor partitions. Cells that are
    left out have no part in that; without ``left_out`` they go before anything is shuffled.
    """
    key = ("table_id", "row", "column")
    in_header = (F.col("row") < header_rows) | (F.col("column") < header_columns)
    chance = Z._chance(*key, seed=seed)
    if always is not None:
        in_header = in_header | F.coalesce(always, F.lit(False))
    taken = (F.col("kind") > 0) & (in_header | (chance < F.when(F.col("kind") == 2, text_rate).otherwise(value_rate)))
    if not left_out:
        cell, taken = cell.where(taken), F.lit(True)
    weight = F.when(~taken, 0).when(F.col("kind") == 1, 1).otherwise(2)
    share = 0.4 + Z._chance("table_id", F.lit("share"), seed=seed) / 5
    bucket = (
        F.when((F.col("row") < header_rows) & (F.col("column") < header_columns), 0)
        .when(F.col("row") < header_rows, 1 + F.col("row"))
        .when(F.col("column") < header_columns, header_rows + 1 + F.col("column"))
        .otherwise(header_rows + header_columns + 1)
    )
    table = Window.partitionBy("table_id")
    draw = Z._number_of(*key, F.lit("draw"), seed=seed)
    order = [F.col("_draw"), F.col("row"), F.col("column")]
    a = cell.withColumns({"_taken": taken, "_weight": weight, "_share": share, "_bucket": bucket, "_draw": draw})
    a = a.withColumn("_most", F.least(F.lit(most), F.floor(F.sum("_weight").over(table) * rate)).cast("int"))
    loose = F.col("_taken") & (F.col("_weight") == 2)
    a = a.withColumn("_hide", loose & (Z._chance(*key, F.lit("hide"), seed=seed) < rate * F.col("_share")))
    a = a.withColumn("_nth", F.row_number().over(Window.partitionBy("table_id", "_hide").orderBy(*order)))
    a = a.withColumn("_hidden", F.col("_hide") & (F.col("_nth") <= F.floor(F.col("_most") * F.col("_share"))))
    a = a.withColumn("_n_hidden", F.count_if("_hidden").over(table))
    a = a.withColumn("_may", loose & ~F.col("_hide"))
    own = Window.partitionBy("table_id", "_bucket", "_may")
    size = F.count("*").over(own)
    one = (size < 6) & (Z._chance("table_id", "_bucket", F.lit("one"), seed=seed) < blank_rate)
    quota = F.when(one, 1).otherwise(F.least(F.greatest(F.lit(1), F.floor(size * blank_rate)), F.lit(3)))
    a = a.withColumn("_nth", F.row_number().over(own.orderBy(*order))).withColumn("_drawn", F.col("_may") & (F.col("_nth") <= quota))
    a = a.withColumn("_n_drawn", F.count_if("_drawn").over(table)).withColumn("_nth", F.row_number().over(Window.partitionBy("table_id", "_drawn").orderBy(*order)))
    allowed = F.least(F.col("_n_drawn"), F.col("_most") - F.col("_n_hidden"))
    mark = F.when(~F.col("_taken"), LEFT_OUT).when(F.col("_hidden"), HIDDEN).when(F.col("_drawn") & (allowed > 1) & (F.col("_nth") <= allowed), BLANK).otherwise(PLAIN)
    return a.select(*cell.columns, mark.alias("mark"))


def _next_in_ring(item: Column, *order: str) -> Column:
    """``item`` of the next row by ``order``, which begins with a hash ``_h``, in rings of rows
    whose hash shares its first bits: after a ring's last row comes its first."""
    ring = Window.partitionBy(F.shiftrightunsigned("_h", 52)).orderBy(*order)
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return F.coalesce(F.lead(item).over(ring), F.first(item).over(whole))


def choices(snippets: DataFrame, seed: int = 43) -> DataFrame:
    """(table_id, k, ids, other): each snippet beyond a table's first with one of another table:
    the next by a seeded hash, in rings of snippets whose hash shares its first bits. Alone in
    its ring, or next to its own table, it has none and is left out."""
    many = snippets.where("k > 0").withColumn("_h", F.xxhash64(F.lit(seed), "table_id", "k"))
    other = _next_in_ring(F.struct("table_id", "ids"), "_h", "table_id", "k", "ids")
    paired = many.withColumn("_o", other).where(F.col("_o.table_id") != F.col("table_id"))
    return paired.select("table_id", "k", "ids", F.col("_o.ids").alias("other"))


def wanted_snippets(texts: DataFrame, tables: DataFrame, pairs: int = 4, seed: int = 43) -> DataFrame:
    """(table_id, row, column, value): those snippets of ``texts`` (table_id, text) that sequences
    of ``tables`` (table_id) may have, as ``choices`` would pair all of them. Row 0 is a table's
    first snippet, in column 0; rows k its first ``pairs`` others that have a partner, in column 1,
    with the partner in column 0.

    Rings take every snippet's key, but no text. Texts are counted and then meet the few keys
    that are left, so only what is wanted needs to be cut into tokens. Texts with the same id are
    told apart by their hash.
    """
    own = tables.select("table_id").distinct()
    sized = texts.select("table_id", T.snippet_count(F.col("text")).alias("_n"), F.xxhash64("text").alias("_text"))
    rest = F.when(F.col("_n") > 1, F.sequence(F.lit(1), F.col("_n") - 1))
    # By number, as few bytes become many keys.
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = sized.repartition(parts, "table_id").join(own.withColumn("_own", F.lit(True)), "table_id", "left").select("table_id", "_text", "_own", F.explode(rest).alias("k"))
    keys = keys.withColumn("_h", F.xxhash64(F.lit(seed), "table_id", "k"))
    paired = keys.withColumn("_o", _next_in_ring(F.struct("table_id", "_text", "k"), "_h", "table_id", "k", "_text")).where(F.col("_own") & (F.col("_o.table_id") != F.col("table_id")))
    few = paired.withColumn("_nth", F.row_number().over(Window.partitionBy("table_id").orderBy("k"))).where(F.col("_nth") <= pairs)
    want = lambda text, at, k, column: F.struct(text.alias("text"), at.alias("at"), F.col("table_id"), k.alias("row"), F.lit(column).alias("column"))
    mine = F.struct(F.col("table_id").alias("source"), want(F.col("_text"), F.col("k"), F.col("k"), 1).alias("w"))
    others = F.struct(F.col("_o.table_id").alias("source"), want(F.col("_o._text"), F.col("_o.k"), F.col("k"), 0).alias("w"))
    first = own.select(F.col("table_id").alias("source"), want(F.lit(None).cast("long"), F.lit(0), F.lit(0), 0).alias("w"))
    wants = few.select(F.explode(F.array(mine, others)).alias("e")).select("e.*").union(first).groupBy("source").agg(F.collect_list("w").alias("wants"))
    # The keys are hashed, so that texts needn't be sorted.
    met = texts.withColumn("_text", F.xxhash64("text")).join(wants.hint("shuffle_hash"), F.col("table_id") == F.col("source"))
    asked = F.filter("wants", lambda w: w["text"].isNull() | (w["text"] == F.col("_text")))
    found = met.select(F.explode(T.with_snippets(F.col("text"), asked)).alias("s")).where("s.value <> ''")
    # Equal rows of texts are a partner once.
    each = found.groupBy("s.table_id", "s.row", "s.column", "s.value").count()
    return each.select("table_id", "row", "column", F.explode(F.array_repeat("value", F.when(F.col("row") == 0, F.col("count").cast("int")).otherwise(1))).alias("value"))


def assembled(
    cell: DataFrame, vocabulary: dict[str, int], snippets: DataFrame | None = None, most: int = 512, pairs: int = 4,
    context: int = 8, seed: int = 43, permuted: bool = True,
) -> DataFrame:
    """(table_id, length, tokens, indicator, rows, columns, labels, blanks, choices): a sequence for each
    table of ``cell`` (``marked``), of ``most`` tokens at most (longer ones are left out).

    It has a start token and the table's first snippet (``context`` tokens); the cells that aren't
    left out, in reading order, a blank one as separator and empty token and a hidden one with
    ``[MASK]`` for its tokens; then the blanked cells themselves, in a seeded order if
    ``permuted``; then up to ``pairs`` further snippets, each with one of another table, as many
    as the budget holds, in a seeded order. ``blanks`` has, for a blank cell's two tokens, minus
    their places in the sequence, and those places for the first two tokens of the cell that
    belongs there. ``choices`` is 1 for the first two tokens of a snippet of this table, 0 of
    another, -1 elsewhere. ``indicator`` is twice the cell's number (its separator one less),
    negative where a part has no place in the table; rows and columns are -1 there.
    ``snippets`` has (table_id, k, ids), numbered from 0, separator first, and ``choices`` pairs
    all of them; or it has ``truth`` too, 1 for a snippet of this table and 0 for its partner, and
    only those that may be taken.

    All parts of a table meet once, so ``cell`` is computed once.
    """
    sep, empty, mask, start = (vocabulary[t] for t in (Z.SEPARATOR, Z.EMPTY, Z.MASK, Z.CLS))
    lit = lambda *x: F.array(*[F.lit(i) for i in x])
    none, nowhere = F.lit(-1), F.lit(-1).cast("long")

    def part(stage: int, order: Column, tokens: Column, r: Column = none, c: Column = none, mark: Column = F.lit(PLAIN), at: Column = nowhere, truth: Column = none, own: Column | None = None, k: Column = F.lit(0)) -> Column:
        own = F.lit(None).cast("array<int>") if own is None else own
        return F.struct(
            F.lit(stage).alias("stage"), order.alias("order"), r.alias("r"), c.alias("c"), mark.alias("mark"), tokens.alias("tokens"),
            at.alias("at"), truth.alias("truth"), own.alias("own"), k.alias("k"),
        )

    used = cell.where(F.col("mark") != LEFT_OUT)
    shown = (
        F.when(F.col("mark") == BLANK, lit(sep, empty))
        .when(F.col("mark") == HIDDEN, F.transform("ids", lambda x, i: F.when(i == 0, x).otherwise(mask)))
        .otherwise(F.col("ids"))
    )
    place = F.col("row").cast("long") * (1 << 31) + F.col("column")
    order = Z._number_of("table_id", "row", "column", F.lit("paste"), seed=seed) if permuted else place
    body = part(1, place, shown, F.col("row"), F.col("column"), F.col("mark"), place, own=F.when(F.col("mark") == HIDDEN, F.col("ids")))
    paste = part(2, order, F.col("ids"), mark=F.lit(BLANK), at=place)
    every = used.select("table_id", F.explode(F.when(F.col("mark") == BLANK, F.array(body, paste)).otherwise(F.array(body))).alias("p"))
    if snippets is not None:
        if "truth" not in snippets.columns:
            first = snippets.where("k = 0").select("table_id", "k", none.alias("truth"), "ids")
            both = F.array(F.struct(F.lit(1).alias("truth"), "ids"), F.struct(F.lit(0).alias("truth"), F.col("other").alias("ids")))
            snippets = first.union(choices(snippets, seed).select("table_id", "k", F.explode(both).alias("e")).select("table_id", "k", "e.*")) if pairs else first
        mixed = Z._number_of("table_id", "k", "truth", F.lit("choice"), seed=seed)
        pair = part(3, mixed, F.col("ids"), truth=F.col("truth"), k=F.col("k"))
        text = F.when(F.col("k") == 0, part(0, F.lit(0).cast("long"), F.slice("ids", 2, context))).otherwise(pair)
        every = every.union(snippets.where("table_id IS NOT NULL").select("table_id", text.alias("p")))
    # Pairs come in order of k, after all other parts, as long as there is room.
    table, extra, size = Window.partitionBy("table_id"), F.col("p.stage") == 3, F.size("p.tokens")
    run = table.orderBy("p.k")
    every = every.withColumns({
        "_used": F.sum(F.when(~extra, size)).over(table) + 1, "_cells": F.count_if(F.col("p.stage") == 1).over(table),
        "_sum": F.sum(F.when(extra, size)).over(run), "_nth": F.dense_rank().over(run),
    })
    fits = ~extra | (F.col("_nth") <= pairs + 1) & (F.col("_used") + F.col("_sum") <= most)
    every = every.where((F.col("_cells") > 0) & (F.col("_used") <= most) & fits).select("table_id", "p")
    # Places in the sequence are running totals of the parts' lengths.
    line = table.orderBy("p.stage", "p.order", "p.at", "p.k", "p.truth", "p.tokens")
    fill = lambda x: F.transform("p.tokens", lambda t, i: x(i))
    n = F.row_number().over(line)
    every = every.withColumn("n", n - F.count_if(F.col("p.stage") == 0).over(table))
    every = every.withColumn("begin", F.coalesce(F.sum(F.size("p.tokens")).over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1)
    hole = F.max(F.when((F.col("p.stage") == 1) & (F.col("p.mark") == BLANK), F.col("begin"))).over(Window.partitionBy("table_id", "p.at"))
    every = every.withColumn("hole", hole)
    number = (F.col("n") + 1) * 2
    sign = F.when(F.col("p.stage") >= 2, -1).otherwise(1)
    hidden = F.transform("p.tokens", lambda t, i: F.when((F.col("p.mark") == HIDDEN) & (F.col("p.stage") == 1) & (i > 0), F.get("p.own", i)).otherwise(-1))
    every = every.select(
        "table_id", "begin", "p.tokens", hidden.alias("labels"),
        fill(lambda i: F.when(F.col("p.stage") == 0, -2).otherwise(sign * (number - F.when(i == 0, 1).otherwise(0)))).alias("indicator"),
        fill(lambda i: F.col("p.r")).alias("rows"), fill(lambda i: F.col("p.c")).alias("columns"),
        fill(lambda i: F.when((F.col("p.mark") == BLANK) & (F.col("p.stage") == 1), -(F.col("begin") + i)).when((F.col("p.mark") == BLANK) & (F.col("p.stage") == 2) & (i < 2), F.col("hole") + i).otherwise(0)).alias("blanks"),
        fill(lambda i: F.when(i < 2, F.col("p.truth")).otherwise(-1)).alias("choices"),
    )
    names = ["tokens", "indicator", "rows", "columns", "labels", "blanks", "choices"]
    item = F.struct("begin", *names)
    whole = every.groupBy("table_id").agg(F.array_sort(F.collect_list(item)).alias("all"))
    head = {"tokens": start, "indicator": -1, "rows": -1, "columns": -1, "labels": -1, "blanks": 0, "choices": -1}
    joined = [F.concat(F.array(F.lit(head[c]).cast("long")), F.flatten(f"all.{c}").cast("array<long>")).alias(c) for c in names]
    out = whole.select("table_id", *joined)
    return out.select("table_id", F.size("tokens").alias("length"), *names).where(F.col("length") <= most)


def titled(cell: DataFrame, titles: DataFrame, vocabulary: dict[str, int], most: int = 256, context: int = 7) -> DataFrame:
    """(table_id, length, tokens, indicator, rows, columns): sequences to tell a table's type by.

    After the start token come ``context`` tokens of the title (``titles``: table_id, ids,
    separator first; a table may have none), then every cell of ``cell`` (``cell_kinds``) that
    isn't empty, in reading order. Longer sequences than ``most`` are left out."""
    plain = cell.withColumn("mark", F.when(F.col("kind") > 0, PLAIN).otherwise(LEFT_OUT))
    first = titles.select("table_id", F.lit(0).alias("k"), "ids")
    return assembled(plain, vocabulary, first, most, 0, context).select("table_id", "length", "tokens", "indicator", "rows", "columns")


def batches(sequences: DataFrame, size: int, fill: dict[str, int], multiple: int = 8, seed: int = 43) -> DataFrame:
    """``sequences`` (table_id, length, arrays) with ``batch`` and ``width``, each array in ``fill``
    padded with its value there to the batch's width: its longest length, rounded up to a
    multiple.

    Batches have ``size`` sequences of nearly one length, so little is padding. They are numbered
    along one order of all sequences, by length and a seeded hash: parts of that order are
    counted, offsets of parts added up (parts are as many as lengths times 256 at most), and only
    a part is sorted in one task.
    """
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("table_id").cast("string")))
    each = sequences.withColumn("_draw", draw).withColumn("_part", F.substring("_draw", 1, 2))
    parts = each.groupBy("length", "_part").agg(F.count("*").alias("_n"))
    parts = parts.withColumn("_base", F.sum("_n").over(Window.orderBy("length", "_part")) - F.col("_n")).drop("_n")
    rank = F.row_number().over(Window.partitionBy("length", "_part").orderBy("_draw", "table_id")) - 1
    numbered = each.withColumn("_rank", rank).join(parts, ["length", "_part"])
    numbered = numbered.withColumn("batch", F.floor((F.col("_base") + F.col("_rank")) / size).cast("long"))
    longest = F.max("length").over(Window.partitionBy("batch"))
    out = numbered.withColumn("width", (F.ceil(longest / multiple) * multiple).cast("int"))
    padded = {c: F.concat(c, F.array_repeat(F.lit(v).cast("long"), F.col("width") - F.size(c))) for c, v in fill.items()}
    return out.withColumns(padded).select(*sequences.columns, "batch", "width")


def room_for(counts: dict[int, int], most: int) -> list[tuple[int, int, int, int]]:
    """(length, from, to, new length): ranks of strings that move to a shorter length, which has
    fewer than ``most`` of its own: longest strings first, to the nearest length with room."""
    room = {n: max(0, most - c) for n, c in counts.items()}
    out = []
    for n in sorted(counts, reverse=True):
        rank = most
        for k in range(n - 1, min(counts) - 1, -1):
            moved = min(counts[n] - rank, room.get(k, 0))
            if moved > 0:
                out.append((n, rank, rank + moved, k))
                rank, room[k] = rank + moved, room[k] - moved
    return out


def string_repository(strings: DataFrame, most: int = 500, shortest: int = 2, longest: int = 8, seed: int = 43) -> DataFrame:
    """(length, id, ids): up to ``most`` token strings of each length, from ``strings`` (id, ids).

    Strings of fewer tokens than ``shortest`` are left out, longer ones than ``longest`` are cut.
    Each length keeps those with the least seeded hashes; what is left over goes on to shorter
    lengths that have room, by a piece of it at a seeded offset. The samples are bounded and
    mergeable: parts of a length keep their least hashes first, so no task sorts a whole one, and
    the driver gets one number a length.
    """
    lengths = longest - shortest + 1
    own = strings.where(F.size("ids") >= shortest).select(F.least(F.size("ids"), F.lit(longest)).alias("n"), "id", F.slice("ids", 1, longest).alias("ids"))
    own = own.withColumn("draw", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("id").cast("string"))))
    counts = {n: 0 for n in range(shortest, longest + 1)} | {r[0]: r[1] for r in own.groupBy("n").count().collect()}
    part = F.substring("draw", 3, 2)
    nth = lambda w: F.row_number().over(w.orderBy("draw", "id")) - 1
    least = own.withColumn("_p", part).withColumn("_k", nth(Window.partitionBy("n", "_p"))).where(F.col("_k") < most * lengths).drop("_p", "_k")
    ranked = least.withColumn("k", nth(Window.partitionBy("n"))).where(F.col("k") < most * lengths)
    moves = room_for(counts, most)
    target = F.when(F.col("k") < most, F.col("n"))
    for n, lo, hi, new in moves:
        target = target.when((F.col("n") == n) & (F.col("k") >= lo) & (F.col("k") < hi), new)
    kept = ranked.withColumn("length", target).where("length IS NOT NULL")
    spare = F.size("ids") - F.col("length") + 1
    offset = F.pmod(F.conv(F.substring("draw", 9, 8), 16, 10).cast("long"), spare).cast("int") + 1
    return kept.select("length", "id", F.slice("ids", offset, F.col("length")).alias("ids"))


#: Distance that separates what mustn't see each other. Fixed value.
FAR = 100


#: Distances that a batch of rows has at most, unless one row has more.
PAIRS = 1 << 20


def _apart(paths: list[list[int] | None]) -> Callable[[slice], np.ndarray]:
    """A function of a part of the ``paths`` (each the nodes on it): by how many nodes they differ
    from all paths, -1 if one is null. Each distinct path is compared once."""
    codes: dict[tuple[int, ...] | None, int] = {}
    which = np.array([codes.setdefault(None if p is None else tuple(p), len(codes)) for p in paths])
    on = np.zeros((len(codes), sum(DEGREES)), np.float32)
    for p, k in codes.items():
        on[k, list(p or ())] = 1
    size, null = on.sum(axis=1), np.array([p is None for p in codes])

    def rows(part: slice) -> np.ndarray:
        own = which[part]
        found = (size[own, None] + size - 2 * on[own] @ on.T).astype(np.int32)
        found[null[own]] = found[:, null] = -1
        return found[:, which]

    return rows


def attention(tokens: DataFrame, both: str = "max") -> DataFrame:
    """(table_id, place, distances): how far each token of a sequence is from every other, in
    order of their places; ``tokens`` has (table_id, place, indicator, top, left).

    Two cells are as far as the nodes that only one of their header paths has, in the top tree or
    the left one, the larger of both (or their sum: ``both`` = "add"). The start token (indicator
    -1) is near all, padding (0) is ``FAR`` from all. Only separators of cells (odd, above 0) see
    each other as they are; any other pair is ``FAR`` + 1 times as far, so a token sees what has no
    distance from it, its own cell. A row has an array, so pairs of tokens are never joined;
    sequences, not tables, must fit in a task, their distances needn't.
    """
    # By number, as a few small sequences are much work.
    parts = int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    path = lambda c: F.filter(tree_index(F.col(c)), lambda i: i < sum(DEGREES)).alias(c)
    each = tokens.select("table_id", "place", "indicator", path("top"), path("left")).repartition(parts, "table_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        rows = sorted(zip(*(t[c].to_pylist() for c in ("place", "indicator", "top", "left")), range(len(t)), strict=True), key=lambda r: [(x is not None, x) if x is not None else (False,) for x in r])
        top, left = (_apart([r[k] for r in rows]) for k in (2, 3))
        i = np.array([2 if r[1] is None else r[1] for r in rows])  # null is neither start, padding nor separator
        start, padding, separator = i == -1, i == 0, (i > 0) & (i % 2 == 1)
        places = t["place"].take([r[4] for r in rows]).combine_chunks()
        step = max(1, PAIRS // len(rows))
        for at in range(0, len(rows), step):
            part = slice(at, at + step)
            a, b = top(part), left(part)
            far = np.maximum(a, b) if both == "max" else a + b
            null = far < 0 if both == "max" else (a < 0) | (b < 0)
            near = start[part, None] | start
            far = (np.where(near, 0, far) + FAR * (padding[part, None] | padding)) * np.where(separator[part, None] & separator, 1, FAR + 1)
            values = pa.array(far.astype(np.int32).ravel(), mask=(null & ~near).ravel())
            lists = pa.ListArray.from_arrays(np.arange(len(far) + 1, dtype=np.int32) * len(rows), values)
            yield pa.RecordBatch.from_arrays([t["table_id"].slice(at, len(far)).combine_chunks(), places[part], lists], ["table_id", "place", "distances"])

    kind = {c: tokens.schema[c].dataType.simpleString() for c in ("table_id", "place")}
    return each.groupBy("table_id").applyInArrow(run, f"table_id {kind['table_id']}, place {kind['place']}, distances array<int>")
