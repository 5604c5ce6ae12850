"""Queries of tokens, sheets and sequences. Sheets are made of growing tables: pages of customers,
and sums of line items by supplier with headers of two levels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import tokens as K
from ..operators import sheets as H
from ..operators import tables_etl as Z
from ..operators.rounds import settled
from .registry import _table, query

#: Customers of a page, tokens of a window, suppliers of a sheet.
PAGE, BUDGET, GROUP = 25, 128, 10
HEADER = ("key", "name", "balance", "segment")
LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: A small vocabulary for the token queries.
TOKENS = {t: i for i, t in enumerate([Z.UNKNOWN, Z.SEPARATOR, Z.EMPTY, Z.MASK, Z.CLS, Z.VALUE, "customer", *HEADER, "#", "-", *LETTERS, *("##" + c for c in LETTERS)])}

# SQL of the tokeniser
_IDEOGRAPH = "".join(rf"\x{{{lo:X}}}-\x{{{hi:X}}}" for lo, hi in K.IDEOGRAPHS)
_PUNCTUATION = r"!-/:-@\[-`{-~\p{P}"
_RAW = rf"[0-9][0-9,.]*|[{_IDEOGRAPH}]|[{_PUNCTUATION}]|[^\s\p{{Z}}0-9{_PUNCTUATION}{_IDEOGRAPH}]+"
_PARTS = "list_filter(string_split(replace(t, ',', ''), '.'), lambda y: y <> '')"


def words_sql(text: str) -> str:
    """The tokens of a text, as a list."""
    number = f"CASE WHEN len({_PARTS}) > 2 THEN list_filter(flatten(list_transform({_PARTS}, lambda y: ['.', y])), lambda y, i: i > 1) ELSE [replace(t, ',', '')] END"
    return f"flatten(list_transform(regexp_extract_all(lower(strip_accents({text})), '{_RAW}'), lambda t: CASE WHEN t[1] BETWEEN '0' AND '9' THEN {number} ELSE [t] END))"


@query(
    "document_tokens",
    f"""SELECT doc_id, len(w)::INT AS n_tokens, len(list_filter(w, lambda t: t[1] BETWEEN '0' AND '9'))::INT AS n_numbers, md5(array_to_string(w, ' ')) AS digest
    FROM (SELECT doc_id, {words_sql("coalesce(text, '')")} AS w FROM documents)""",
)
def document_tokens(s: SparkSession, d: str) -> DataFrame:
    t = _table(s, d, "documents").select("doc_id", K.tokens(F.coalesce("text", F.lit(""))).alias("t"))
    return t.select(
        "doc_id", F.size("t").alias("n_tokens"), F.size(F.filter("t", lambda x: x["number"])).alias("n_numbers"),
        F.md5(F.array_join(F.transform("t", lambda x: x["token"]), " ")).alias("digest"),
    )


# Pages of customers



def cells_sql(page: int = PAGE) -> str:
    return f"""pages AS (SELECT 'page-' || (c_custkey // {page}) AS table_id, row_number() OVER (PARTITION BY c_custkey // {page} ORDER BY c_custkey)::INT AS r,
    [c_custkey::VARCHAR, c_name, c_acctbal::VARCHAR, c_mktsegment] AS line FROM customer),
lines AS (SELECT * FROM pages UNION ALL SELECT DISTINCT table_id, 0, {list(HEADER)} FROM pages),
cells AS (SELECT table_id, r AS "row", unnest(range(4))::INT AS "column", unnest(line) AS value FROM lines)"""


CELLS = cells_sql()


def _pages(s: SparkSession, d: str, size: int = PAGE) -> DataFrame:
    line = F.array(F.col("c_custkey").cast("string"), "c_name", F.col("c_acctbal").cast("string"), "c_mktsegment")
    page = F.concat(F.lit("page-"), F.expr(f"c_custkey div {size}").cast("string")).alias("table_id")
    body = F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "line"))), lambda x: x["line"])
    rows = _table(s, d, "customer").select(page, "c_custkey", line.alias("line"))
    return rows.groupBy("table_id").agg(F.concat(F.array(F.array(*map(F.lit, HEADER))), body).alias("texts"))


@query("sheet_cells", f"WITH {CELLS} SELECT * FROM cells")
def sheet_cells(s, d):
    return Z.cells(_pages(s, d))


_FIRST = "CASE " + " ".join(f"WHEN starts_with(w, '{x}') THEN '{x}'" for x in ("customer", *HEADER)) + " ELSE w[1] END"
_VOCABULARY = f"vocabulary AS (SELECT {list(TOKENS)} AS v)"
_ID = "list_position(v, {0}) - 1"
_TOKENS_OF_CELLS = f"""{_VOCABULARY},
words AS (SELECT table_id, "row", "column", unnest({words_sql("value")}) AS w, generate_subscripts({words_sql("value")}, 1) AS k FROM cells),
cut AS (SELECT *, w[1] BETWEEN '0' AND '9' AS number, list_prepend({_FIRST}, list_transform(string_split(substr(w, length({_FIRST}) + 1), ''), lambda c: '##' || c)) AS p,
    list_filter(string_split(w, '.'), lambda y: y <> '') AS q FROM words),
fit AS (SELECT table_id, "row", "column", k, number, q, w, CASE WHEN number THEN ['[VAL]'] WHEN length(w) > 64 OR NOT list_has_all(v, list_filter(p, lambda x: x <> '##')) THEN ['[UNK]'] ELSE list_filter(p, lambda x: x <> '##') END AS p FROM cut, vocabulary),
flat AS (SELECT *, unnest(p) AS token, generate_subscripts(p, 1) AS j FROM fit),
every AS (SELECT table_id, "row", "column", 0 AS k, 0 AS j, '[SEP]' AS token, false AS number, NULL AS q, NULL AS w FROM cells
    UNION ALL SELECT c.table_id, c."row", c."column", 1, 1, '[EMP]', false, NULL, NULL FROM cells c ANTI JOIN words USING (table_id, "row", "column")
    UNION ALL SELECT table_id, "row", "column", k, j, token, number, q, w FROM flat),
numbered AS (SELECT *, (row_number() OVER (PARTITION BY table_id, "row", "column" ORDER BY k, j) - 1)::INT AS o FROM every),
tokens AS (SELECT table_id, "row", "column", o AS "order", token, ({_ID.format("token")})::INT AS id,
    (CASE WHEN number THEN least(10, CASE WHEN len(q) = 1 THEN length(w) ELSE length(q[1]) END) ELSE 11 END)::INT AS magnitude,
    (CASE WHEN number THEN least(10, CASE WHEN len(q) = 1 THEN 0 ELSE length(q[2]) END) ELSE 11 END)::INT AS precision,
    (CASE WHEN number THEN q[1][1]::INT ELSE 11 END)::INT AS first, (CASE WHEN number THEN q[-1][-1]::INT ELSE 11 END)::INT AS last FROM numbered, vocabulary WHERE o < 8)"""

TOKEN_SQL = f"{CELLS}, {_TOKENS_OF_CELLS}"


def _page_tokens(s: SparkSession, d: str, size: int = PAGE) -> DataFrame:
    return Z.tokens(Z.cells(_pages(s, d, size)), TOKENS)


def _page_kinds(s: SparkSession, d: str, size: int = PAGE) -> DataFrame:
    return Z.kinds(Z.cells(_pages(s, d, size)), TOKENS)


@query("sheet_tokens", f"WITH {TOKEN_SQL} SELECT * FROM tokens")
def sheet_tokens(s, d):
    return _page_tokens(s, d)


def _draw(*key: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', '43', {', '.join(key)})), 1, 8))::BIGINT"


_AT = ("table_id", '"row"', '"column"')
_HOW = _draw(*_AT, '"order"', "'how'") + " / 4294967296.0"


@query(
    "masked_tokens",
    f"""WITH {TOKEN_SQL}, m AS (SELECT *, token NOT IN ('[SEP]', '[CLS]', '[EMP]') AND {_draw(*_AT, '"order"')} / 4294967296.0 < 0.15 AS chosen FROM tokens)
    SELECT table_id, "row", "column", "order", CASE WHEN NOT chosen THEN id WHEN {_HOW} < 0.8 THEN {TOKENS[Z.MASK]}
    WHEN {_HOW} < 0.9 THEN ({_draw(*_AT, '"order"', '"order"', "'id'")} % {len(TOKENS)})::INT ELSE id END AS id, CASE WHEN chosen THEN id ELSE -1 END AS label FROM m""",
)
def masked_tokens(s, d):
    return Z.masked(_page_tokens(s, d), TOKENS).select("table_id", "row", "column", "order", "id", "label")


@query(
    "token_sequences",
    f"""WITH {TOKEN_SQL}, g AS (SELECT table_id, (count(*) + 1)::INT AS length, '{TOKENS[Z.CLS]} ' || string_agg(id, ' ' ORDER BY "row", "column", "order") AS tokens,
    '0 ' || string_agg("row" * 4 + "column" + 1, ' ' ORDER BY "row", "column", "order") AS indicator FROM tokens GROUP BY table_id) SELECT * FROM g WHERE length <= 2048""",
)
def token_sequences(s, d):
    q = Z.sequences(_page_tokens(s, d), TOKENS)
    return q.select("table_id", "length", F.array_join("tokens", " ").alias("tokens"), F.array_join("indicator", " ").alias("indicator"))


@query(
    "sampled_cells",
    rf"""WITH {CELLS} SELECT *, ({_draw(*_AT)} / 4294967296.0 < CASE WHEN regexp_matches(value, '^\s*[-+]?[\d.,]+%?\s*$') THEN 0.1 ELSE 0.5 END)::INT AS valid FROM cells""",
)
def sampled_cells(s, d):
    return Z.sampled_cells(Z.cells(_pages(s, d)))


@query(
    "token_windows",
    f"""WITH RECURSIVE {TOKEN_SQL}, len AS (SELECT table_id, "row", "column", count(*) AS n FROM tokens GROUP BY ALL),
tot AS (SELECT table_id, "row" AS r, sum(sum(n)) OVER (PARTITION BY table_id ORDER BY "row") AS p FROM len GROUP BY table_id, "row"),
size AS (SELECT table_id, max(r) + 1 AS rows FROM tot GROUP BY table_id),
cuts AS (SELECT b.table_id, b.start, min(t.r) FILTER (1 + t.p - coalesce(a.p, 0) >= {BUDGET}) AS cut, any_value(coalesce(a.p, 0)) AS used
    FROM (SELECT table_id, r AS start FROM tot) b JOIN tot t ON t.table_id = b.table_id AND t.r >= b.start LEFT JOIN tot a ON a.table_id = b.table_id AND a.r = b.start - 1 GROUP BY b.table_id, b.start),
walk AS (SELECT table_id, 0 AS w, 0 AS start FROM size UNION ALL
    SELECT c.table_id, w + 1, CASE WHEN cut - 3 > c.start THEN cut - 3 WHEN cut - 2 > c.start THEN cut - 2 WHEN cut - 1 > c.start THEN cut - 1 WHEN cut > c.start THEN cut ELSE cut + 1 END
    FROM walk JOIN cuts c USING (table_id, start) JOIN size USING (table_id) WHERE cut IS NOT NULL AND NOT (cut = c.start AND cut + 1 >= rows)),
inrow AS (SELECT *, sum(n) OVER (PARTITION BY table_id, "row" ORDER BY "column") AS upto FROM len),
kept AS (SELECT i.table_id, "row", "column", n AS length, w AS "window" FROM walk JOIN cuts c USING (table_id, start) JOIN inrow i ON i.table_id = walk.table_id AND i."row" >= walk.start
    LEFT JOIN tot a ON a.table_id = i.table_id AND a.r = i."row" - 1 WHERE c.cut IS NULL OR i."row" < c.cut OR i."row" = c.cut AND 1 + coalesce(a.p, 0) - c.used + upto < {BUDGET})
SELECT table_id, "row", "column", length, "window"::INT AS "window", "window" > min("window") OVER (PARTITION BY table_id, "row", "column") AS repeated FROM kept""",
)
def token_windows(s, d):
    lengths = _page_kinds(s, d).select("table_id", "row", "column", F.size("ids").cast("long").alias("length"))
    return H.budget_windows(lengths, BUDGET)


_CHANCE = lambda *key: f"{_draw(*key)} / 4294967296.0"
_ORDER = 'ORDER BY draw, "row", "column"'
MARK_SQL = f"""{TOKEN_SQL},
kinds AS (SELECT table_id, "row", "column", (CASE WHEN n AND w THEN 3 WHEN w THEN 2 WHEN n THEN 1 ELSE 0 END)::INT AS kind FROM (
    SELECT table_id, "row", "column", bool_or(token <> '[SEP]' AND magnitude <> 11) AS n, bool_or(token NOT IN ('[SEP]', '[EMP]') AND magnitude = 11) AS w FROM tokens GROUP BY ALL)),
a AS (SELECT *, kind > 0 AND ("row" < 1 OR "column" < 1 OR {_CHANCE(*_AT)} < CASE WHEN kind = 2 THEN 0.5 ELSE 0.1 END) AS taken, 0.4 + {_CHANCE("table_id", "'share'")} / 5 AS share,
    CASE WHEN "row" < 1 AND "column" < 1 THEN 0 WHEN "row" < 1 THEN 1 WHEN "column" < 1 THEN 2 ELSE 3 END AS bucket, {_draw(*_AT, "'draw'")} AS draw FROM kinds),
b AS (SELECT *, CASE WHEN NOT taken THEN 0 WHEN kind = 1 THEN 1 ELSE 2 END AS weight FROM a),
c AS (SELECT *, least(20, floor(sum(weight) OVER (PARTITION BY table_id) * 0.2::DOUBLE))::INT AS most, weight = 2 AND {_CHANCE(*_AT, "'hide'")} < 0.2::DOUBLE * share AS hide FROM b),
d AS (SELECT *, hide AND row_number() OVER (PARTITION BY table_id, hide {_ORDER}) <= floor(most * share) AS hidden, weight = 2 AND NOT hide AS may FROM c),
e AS (SELECT *, count(*) OVER (PARTITION BY table_id, bucket, may) AS size, row_number() OVER (PARTITION BY table_id, bucket, may {_ORDER}) AS nth FROM d),
f AS (SELECT *, may AND nth <= CASE WHEN size < 6 AND {_CHANCE("table_id", "bucket", "'one'")} < 0.3 THEN 1 ELSE least(greatest(1, floor(size * 0.3::DOUBLE)), 3) END AS drawn FROM e),
g AS (SELECT *, least(count(*) FILTER (drawn) OVER (PARTITION BY table_id), most - count(*) FILTER (hidden) OVER (PARTITION BY table_id)) AS allowed,
    row_number() OVER (PARTITION BY table_id, drawn {_ORDER}) AS place FROM f)"""


def _page_marks(s: SparkSession, d: str, left_out: bool = True) -> DataFrame:
    return H.marked(_page_kinds(s, d), 1, 1, left_out=left_out)


@query("cell_marks", f"""WITH {MARK_SQL} SELECT table_id, "row", "column", kind, CASE WHEN NOT taken THEN 0 WHEN hidden THEN 3 WHEN drawn AND allowed > 1 AND place <= allowed THEN 2 ELSE 1 END AS mark FROM g""")
def cell_marks(s, d):
    return _page_marks(s, d).drop("ids")


@query("table_sequences")
def table_sequences(s, d):
    """Pages as sequences with blanks, and snippets of the document of the same number."""
    docs = _table(s, d, "documents").select(F.concat(F.lit("page-"), F.col("doc_id").cast("string")).alias("table_id"), "text")
    snippets = Z.kinds(H.wanted_snippets(docs, _pages(s, d)), TOKENS, 20)
    out = H.assembled(_page_marks(s, d, left_out=False), TOKENS, snippets.select("table_id", F.col("row").alias("k"), F.col("column").alias("truth"), "ids"))
    return out.select("table_id", "length", *[F.array_join(c, " ").alias(c) for c in ("tokens", "indicator", "labels", "blanks", "choices")])


SEQUENCE_SQL = f"""{TOKEN_SQL}, seqs AS (SELECT table_id, (count(*) + 1)::INT AS length, list_prepend({TOKENS[Z.CLS]}, list(id ORDER BY "row", "column", "order")) AS tokens FROM tokens GROUP BY table_id)"""


@query(
    "padded_batches",
    f"""WITH {SEQUENCE_SQL}, n AS (SELECT *, (row_number() OVER (ORDER BY length, md5('43|' || table_id)) - 1) // 8 AS batch FROM seqs WHERE length <= 2048),
    w AS (SELECT *, (ceil(max(length) OVER (PARTITION BY batch) / 8.0) * 8)::INT AS width FROM n)
    SELECT table_id, length, batch, width, array_to_string(list_concat(tokens, list_transform(range(width - length), lambda x: 0)), ' ') AS tokens FROM w""",
)
def padded_batches(s, d):
    seqs = Z.sequences(_page_tokens(s, d), TOKENS).select("table_id", "length", F.col("tokens").cast("array<long>").alias("tokens"))
    return H.batches(seqs, 8, {"tokens": 0}).withColumn("tokens", F.array_join("tokens", " "))


#: Customers of a small page.
SMALL = 8


@query(
    "titled_sequences",
    f"""WITH {cells_sql(SMALL)}, {_TOKENS_OF_CELLS},
    full_cells AS (SELECT table_id, "row", "column", dense_rank() OVER (PARTITION BY table_id ORDER BY "row", "column") AS n, "order", id FROM tokens
        SEMI JOIN (SELECT table_id, "row", "column" FROM tokens WHERE token NOT IN ('[SEP]', '[EMP]')) USING (table_id, "row", "column")),
    titles AS (SELECT table_id, list(id ORDER BY "order")[2:8] AS t FROM tokens WHERE "row" = 1 AND "column" = 3 GROUP BY table_id),
    body AS (SELECT table_id, list(id ORDER BY n, "order") AS ids, list(2 * (n + 1) - CASE WHEN "order" = 0 THEN 1 ELSE 0 END ORDER BY n, "order") AS ind FROM full_cells GROUP BY table_id)
    SELECT table_id, (1 + len(t) + len(ids))::INT AS length, array_to_string(list_concat([{TOKENS[Z.CLS]}], t, ids), ' ') AS tokens,
    array_to_string(list_concat([-1], list_transform(t, lambda x: -2), ind), ' ') AS indicator FROM body JOIN titles USING (table_id) WHERE 1 + len(t) + len(ids) <= 256""",
)
def titled_sequences(s, d):
    """Small pages, titled by the segment of their first customer."""
    cells = _page_kinds(s, d, SMALL)
    titles = cells.where("row = 1 AND column = 3").select("table_id", "ids")
    return H.titled(cells, titles, TOKENS).select("table_id", "length", *[F.array_join(c, " ").alias(c) for c in ("tokens", "indicator")])


@query("string_repository")
def string_repository(s, d):
    """Names of parts as token strings, a bounded sample of each length."""
    names = _table(s, d, "part").select(F.col("p_partkey").alias("table_id"), F.lit(0).alias("row"), F.lit(0).alias("column"), F.concat_ws(" ", "p_name", "p_type").alias("value"))
    strings = Z.kinds(names, TOKENS, 33).select(F.col("table_id").alias("id"), F.slice("ids", 2, 32).alias("ids"))
    return H.string_repository(strings).select("length", "id", F.array_join("ids", " ").alias("ids"))


# Sums of line items with headers of two levels

_SIDE = """{0} AS (SELECT DISTINCT sheet, {1} AS a, {2} AS b FROM facts), {0}s AS (SELECT sheet, a, b, (row_number() OVER (PARTITION BY sheet ORDER BY a, b) + 1)::INT AS at,
    dense_rank() OVER (PARTITION BY sheet ORDER BY a) - 1 AS i, row_number() OVER (PARTITION BY sheet, a ORDER BY b) - 1 AS j FROM {0}),
{0}_all AS (SELECT * FROM {0}s UNION ALL SELECT sheet, NULL, NULL, k, NULL, NULL FROM (SELECT DISTINCT sheet FROM facts), (VALUES (0), (1)) h(k))"""
_PATH = """CASE WHEN {0}.i IS NULL THEN '-1 -1 -1 -1' WHEN {1}.at >= 1 THEN '-1 -1 ' || {0}.i || ' ' || {0}.j WHEN {0}.j = 0 THEN '-1 -1 ' || {0}.i || ' -1' ELSE '-1 -1 -1 -1' END"""


HEADER_SQL = f"""facts AS (SELECT l_suppkey // {GROUP} AS sheet, year(l_shipdate)::INT AS y, quarter(l_shipdate)::INT AS q, l_returnflag AS f, l_linestatus AS s, sum(l_quantity)::BIGINT AS v FROM lineitem GROUP BY ALL),
{_SIDE.format("r", "y", "q")}, {_SIDE.format("c", "f", "s")},
placed AS (SELECT r.sheet::VARCHAR AS table_id, r.at AS "row", c.at AS "column", CASE WHEN r.at = 0 THEN CASE WHEN c.j = 0 THEN c.a ELSE '' END WHEN r.at = 1 THEN coalesce(c.b, '')
    WHEN c.at = 0 THEN CASE WHEN r.j = 0 THEN r.a::VARCHAR ELSE '' END WHEN c.at = 1 THEN r.b::VARCHAR ELSE coalesce(v::VARCHAR, '') END AS value,
    {_PATH.format("c", "r")} AS top, {_PATH.format("r", "c")} AS "left"
FROM r_all r JOIN c_all c ON r.sheet = c.sheet LEFT JOIN facts f ON f.sheet = r.sheet AND f.y = r.a AND f.q = r.b AND f.f = c.a AND f.s = c.b)"""


def _placed(s: SparkSession, d: str) -> DataFrame:
    items = _table(s, d, "lineitem").select(
        F.expr(f"l_suppkey div {GROUP}").alias("sheet"), F.year("l_shipdate").alias("y"), F.quarter("l_shipdate").alias("q"),
        F.col("l_returnflag").alias("f"), F.col("l_linestatus").alias("s"), "l_quantity",
    )
    # Far smaller than the items, and read by three branches of the plan.
    sheets = settled(H.pivoted(items, "sheet", ("y", "q"), ("f", "s"), F.sum("l_quantity").cast("long")))
    return H.placed(sheets)


@query("header_paths", f"WITH {HEADER_SQL} SELECT * FROM placed")
def header_paths(s, d):
    path = lambda c: F.array_join(c, " ").alias(c)
    return _placed(s, d).select("table_id", "row", "column", "value", path("top"), path("left"))


_AWAY = " + ".join("CASE WHEN a.{0}[%d] = b.{0}[%d] THEN 0 ELSE (a.{0}[%d] >= 0)::INT + (b.{0}[%d] >= 0)::INT END" % (k, k, k, k) for k in range(1, 5))


@query(
    "attention_distances",
    f"""WITH {HEADER_SQL}, cells AS (SELECT table_id, row_number() OVER (PARTITION BY table_id ORDER BY "row", "column") AS n, string_split(top, ' ')::INT[] AS t, string_split("left", ' ')::INT[] AS l FROM placed WHERE value <> ''),
    tokens AS (SELECT table_id, 2 * n - 1 + k AS place, 2 * n - 1 + k AS i, t, l FROM cells, (VALUES (0), (1)) s(k) UNION ALL SELECT DISTINCT table_id, 0, -1, [-1, -1, -1, -1], [-1, -1, -1, -1] FROM cells),
    pairs AS (SELECT a.table_id, a.place, b.place AS other, CASE WHEN a.i = -1 OR b.i = -1 THEN 0 ELSE greatest({_AWAY.format("t")}, {_AWAY.format("l")}) END * CASE WHEN a.i > 0 AND b.i > 0 AND a.i % 2 = 1 AND b.i % 2 = 1 THEN 1 ELSE 101 END AS d
        FROM tokens a JOIN tokens b USING (table_id))
    SELECT table_id, place::BIGINT AS place, sum(d)::BIGINT AS total, md5(string_agg(d, ' ' ORDER BY other)) AS digest FROM pairs GROUP BY table_id, place""",
)
def attention_distances(s, d):
    """Sums by supplier as sequences: a start token, and two tokens for each cell with a value."""
    cells = _placed(s, d).where("value <> ''").withColumn("n", F.row_number().over(Window.partitionBy("table_id").orderBy("row", "column")))
    tokens = cells.select("table_id", F.explode(F.array(2 * F.col("n") - 1, 2 * F.col("n"))).alias("place"), "top", "left")
    start = cells.select("table_id").distinct().select("table_id", F.lit(0).alias("place"), *[F.array(*[F.lit(-1)] * 4).alias(c) for c in ("top", "left")])
    tokens = tokens.unionByName(start).withColumn("indicator", F.when(F.col("place") == 0, -1).otherwise(F.col("place")))
    found = H.attention(tokens)
    total = F.aggregate("distances", F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select("table_id", F.col("place").cast("long").alias("place"), total.alias("total"), F.md5(F.array_join("distances", " ")).alias("digest"))
