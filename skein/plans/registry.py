"""Queries of the schema-clustering operators, by name, with their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vector as V
from ..operators import cluster_number as B
from ..operators import clustering as C
from ..operators import ensemble as E
from ..operators import graph as G
from ..operators import importance as I
from ..operators import metrics as M
from ..operators import profile as P
from ..operators import records as N
from ..operators import roles as R
from ..operators import similarity as S
from ..operators import tables_etl as Z
from ..operators import triplets as X
from ..operators.rounds import settled
from ..sources import catalog as K
from ..sources.files import table_lines, truth
from . import systems as Y

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: Clusters of the star schema's tables, by hand.
STAR_TRUTH = {
    "places": ["region", "nation"], "sales": ["customer", "orders", "lineitem"], "supply": ["part", "supplier"],
    "text": ["documents", "labels", "benchmark", "pages"], "streams": ["events", "conversations"], "vectors": ["embeddings"],
}
STAR_COLUMNS = {
    "region": "r_regionkey int,r_name string", "nation": "n_nationkey int,n_name string,n_regionkey int",
    "customer": "c_custkey bigint,c_name string,c_nationkey int,c_acctbal double,c_mktsegment string",
    "supplier": "s_suppkey bigint,s_name string,s_nationkey int,s_acctbal double",
    "part": "p_partkey bigint,p_name string,p_brand string,p_type string,p_size int,p_retailprice double",
    "orders": "o_orderkey bigint,o_custkey bigint,o_orderstatus string,o_totalprice double,o_orderdate timestamp_ntz,o_orderpriority string",
    "lineitem": "l_orderkey bigint,l_partkey bigint,l_suppkey bigint,l_linenumber int,l_quantity double,l_extendedprice double,"
    "l_discount double,l_tax double,l_returnflag string,l_linestatus string,l_shipdate timestamp_ntz",
    "events": "event_id bigint,ts timestamp_ntz,user_id bigint,event_type string,value double,props string",
    "documents": "doc_id bigint,text string,lang string,source string,n_chars bigint", "labels": "doc_id bigint,quality int,toxic int",
    "embeddings": "vec_id bigint,embedding array<float>,label int", "pages": "page_id bigint,url string,html string",
    "benchmark": "item_id bigint,text string", "conversations": "conv_id bigint,turn bigint,role string,text string",
}
#: Tables whose columns are all profiled.
PROFILED = sorted(set(STAR_COLUMNS) - {"embeddings"})


def _values(rows: list[tuple]) -> str:
    cell = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return "(VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + ")"


COLUMN_ROWS = [(t, i, *c.split(" ")) for t in sorted(STAR_COLUMNS) for i, c in enumerate(STAR_COLUMNS[t].split(","))]
KEY_ROWS = [(i, t, c[0], rt, rc[0]) for i, (t, c, rt, rc) in enumerate(K.STAR_KEYS, 1)]
MINI_KEYS = [(i, t, c[0], rt, rc[0]) for i, (t, c, rt, rc) in enumerate([(t, *k) for t in sorted(K.MINI) for k in K.MINI[t][2]], 1)]
TRUTH_ROWS = [(t, i, k) for i, (k, ts) in enumerate(STAR_TRUTH.items()) for t in ts]

COLS = f"cols AS (SELECT * FROM {_values(COLUMN_ROWS)} v(table_name, ordinal, column_name, data_type))"
NAMES = "names AS (SELECT DISTINCT table_name FROM cols)"
FK = f"fk AS (SELECT * FROM {_values(KEY_ROWS)} v(fk_id, ct, cc, rt, rc))"
MINI_FK = f"fk AS (SELECT * FROM {_values(MINI_KEYS)} v(fk_id, ct, cc, rt, rc))"
EDGES = "edges AS (SELECT DISTINCT least(ct, rt) AS src, greatest(ct, rt) AS dst FROM fk WHERE ct <> rt)"
BOTH = "ways AS (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges)"
TRUTH = f"truth AS (SELECT * FROM {_values(TRUTH_ROWS)} v(table_name, cluster_id, label))"
DOCS = """docs AS (SELECT table_name, table_name || ' ' || string_agg(column_name, ' ' ORDER BY ordinal) AS doc FROM cols GROUP BY table_name)"""
TFIDF = """terms AS (SELECT table_name, term, count(*) AS tf FROM (
    SELECT table_name, lower(unnest(regexp_extract_all(doc, '[A-Z]?[a-z]+|[A-Z]+'))) AS term FROM docs) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM terms GROUP BY term),
raw AS (SELECT table_name, term, tf * (ln((1 + (SELECT count(*) FROM docs)) / (1 + df)::DOUBLE) + 1) AS w FROM terms JOIN dfs USING (term)),
tfidf AS (SELECT table_name, term, w / sqrt(sum(w * w) OVER (PARTITION BY table_name)) AS x FROM raw)"""
SIMS = """shared AS (SELECT p.table_name AS a, q.table_name AS b, sum(p.x * q.x) AS sim FROM tfidf p JOIN tfidf q USING (term)
    WHERE p.table_name < q.table_name GROUP BY ALL),
sims AS (SELECT n.table_name AS a, m.table_name AS b, coalesce(sim, 0) AS sim FROM names n JOIN names m ON n.table_name < m.table_name
    LEFT JOIN shared s ON s.a = n.table_name AND s.b = m.table_name),
mir AS (SELECT a, b, sim FROM sims UNION ALL SELECT b, a, sim FROM sims)"""
ALL_SIMS = f"{COLS}, {NAMES}, {DOCS}, {TFIDF}, {SIMS}"
EMB = "emb AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"
DIMS = "dims AS (SELECT vec_id, label, unnest(v) AS x, unnest(range(len(v))) AS pos FROM emb)"
CENTRES = """means AS (SELECT label, pos, avg(x) AS m FROM dims GROUP BY ALL),
centres AS (SELECT label, list(m ORDER BY pos) AS c FROM means GROUP BY label)"""
CONT = "cont AS (SELECT lang AS t, source AS p, count(*) AS n FROM documents GROUP BY ALL)"


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _r(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _sims(s: SparkSession, d: str) -> DataFrame:
    return S.table_similarity(K.star(s, d).columns())


# Catalog and scans


@query("list_tables", f"WITH {COLS}, {FK} SELECT table_name, count(*)::INT AS column_count, (SELECT count(*) FROM fk WHERE ct = table_name)::INT AS fk_count FROM cols GROUP BY table_name")
def list_tables(s, d):
    return K.star(s, d).tables().select("table_name", "column_count", "fk_count")


@query("list_columns", f"WITH {COLS} SELECT table_name, ordinal, column_name, data_type FROM cols")
def list_columns(s, d):
    return K.star(s, d).columns()


@query("foreign_keys", f"WITH {FK} SELECT fk_id, ct AS constrained_table, cc AS constrained_columns, rt AS referred_table, rc AS referred_columns FROM fk")
def foreign_keys(s, d):
    k = K.star(s, d).foreign_keys()
    return k.withColumns({c: F.array_join(c, ",") for c in ("constrained_columns", "referred_columns")})


@query("table_foreign_keys", f"WITH {FK} SELECT fk_id, rt AS referred_table FROM fk WHERE ct = 'lineitem'")
def table_foreign_keys(s, d):
    return K.star(s, d).foreign_keys("lineitem").select("fk_id", "referred_table")


@query("primary_keys", f"SELECT * FROM {_values([(t, ','.join(c)) for t, c in K.STAR_PRIMARY.items()] + [('lineitem', '')])} v(table_name, pk)")
def primary_keys(s, d):
    return K.star(s, d).tables().select("table_name", F.array_join("pk", ",").alias("pk"))


@query("table_row_counts", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in sorted(STAR_COLUMNS)))
def table_row_counts(s, d):
    return K.star(s, d).row_counts()


@query("limited_scan", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 100")
def limited_scan(s, d):
    return K.star(s, d).scan("orders", 100).select("o_orderkey", "o_custkey", "o_orderstatus")


@query("full_scan", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def full_scan(s, d):
    return K.star(s, d).scan("customer")


@query("records", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def records(s, d):
    return K.star(s, d).records("supplier").select("record.*")


@query("distinct_values", "SELECT DISTINCT p_type FROM part")
def distinct_values(s, d):
    return K.star(s, d).distinct("part", "p_type")


@query("distinct_values_sample", "SELECT DISTINCT o_orderpriority FROM orders ORDER BY 1 LIMIT 20")
def distinct_values_sample(s, d):
    return K.star(s, d).distinct("orders", "o_orderpriority", 20)


@query("sql_passthrough", "SELECT n_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def sql_passthrough(s, d):
    return K.star(s, d).sql("SELECT n_name, count(*) AS customers FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey GROUP BY n_name")


@query("truth_flatten", f"SELECT * FROM {_values([('a', 'x'), ('b', 'x'), ('c', 'y_p'), ('d', 'y_q')])} v(table_name, label)")
def truth_flatten(s, d):
    nested = {"x": ["A", "b"], "y": {"p": ["c"], "q": ["D"]}}
    return truth(s, nested, 1).select("table_name", "label")


# Profiles and importance


def _entropy_sql() -> str:
    scalar = [(t, c) for t, _, c, k in COLUMN_ROWS if t in PROFILED]
    counts = " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS k FROM {t} WHERE {c} IS NOT NULL GROUP BY {c}" for t, c in scalar)
    rows = " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in sorted(STAR_COLUMNS))
    return f"""counts AS ({counts}), rows_of AS ({rows}),
shares AS (SELECT *, k / sum(k) OVER (PARTITION BY table_name, column_name)::DOUBLE AS p FROM counts),
ent AS (SELECT table_name, column_name, greatest(-sum(p * log2(p)), 0) AS entropy FROM shares GROUP BY ALL),
info AS (SELECT r.table_name, coalesce(sum(entropy), 0) + coalesce(log2(nullif(any_value(row_count), 0)), 0) AS information
    FROM rows_of r LEFT JOIN ent e ON e.table_name = r.table_name GROUP BY r.table_name)"""


ENTROPY = _entropy_sql()


@query("column_entropy", f"WITH {ENTROPY} SELECT table_name, column_name, round(entropy, 6) AS entropy FROM ent")
def column_entropy(s, d):
    return _r(P.entropies(K.star(s, d), PROFILED), "entropy")


def _information(s, d):
    c = K.star(s, d)
    h = settled(P.entropies(c, PROFILED))  # a row a column, read several times
    return c, h, P.information_content(h, c.row_counts())


@query("table_information_content", f"WITH {ENTROPY} SELECT table_name, round(information, 6) AS information FROM info")
def table_information_content(s, d):
    return _r(_information(s, d)[2], "information")


def _walk_sql(both: bool) -> str:
    ends = "SELECT ct AS t, cc AS c, rt AS o FROM fk WHERE ct <> rt" + (" UNION ALL SELECT rt, rc, ct FROM fk WHERE ct <> rt" if both else "")
    whole = "q * information" if both else "information + (q - 1) * ch"
    return f"""{FK}, {COLS}, {NAMES}, {ENTROPY}, ends AS ({ends}), used AS (SELECT t, c, count(*) AS q FROM ends GROUP BY ALL),
ch AS (SELECT table_name, sum(entropy) AS ch FROM ent GROUP BY table_name),
pr AS (SELECT t, c, coalesce(entropy / nullif({whole}, 0), 0) AS pr FROM used JOIN ent e ON e.table_name = t AND e.column_name = c
    JOIN info i ON i.table_name = t JOIN ch ON ch.table_name = t),
steps AS (SELECT t AS src, o AS dst, sum(pr) AS p FROM ends JOIN pr USING (t, c) GROUP BY ALL),
matrix AS (SELECT * FROM steps UNION ALL SELECT table_name, table_name, 1 - coalesce((SELECT sum(p) FROM steps WHERE src = table_name), 0) FROM names)"""


@query("join_selectivity", f"WITH {_walk_sql(False)} SELECT t AS table_name, c AS column_name, round(pr, 6) AS pr FROM pr")
def join_selectivity(s, d):
    c, h, content = _information(s, d)
    return _r(I.selectivity(h, content, I.key_ends(c.foreign_keys(), False)).select("table_name", "column_name", "pr"), "pr")


@query("transition_matrix", f"WITH {_walk_sql(False)} SELECT src, dst, round(p, 6) AS p FROM matrix")
def transition_matrix(s, d):
    c, h, content = _information(s, d)
    return _r(I.transition_matrix(c.tables(), h, content, c.foreign_keys(), both=False), "p")


def _share_sql(both: bool) -> str:
    return f"""WITH RECURSIVE {_walk_sql(both)},
s AS (SELECT 0 AS i, table_name AS t, 1 / (SELECT count(*) FROM names)::DOUBLE AS share FROM names
    UNION ALL SELECT s.i + 1, m.dst, sum(share * p) FROM s JOIN matrix m ON m.src = s.t WHERE s.i < 50 GROUP BY s.i, m.dst)
SELECT t AS table_name, round(share, 6) AS share FROM s WHERE i = 50"""


@query("stationary_50", _share_sql(False))
def stationary_50(s, d):
    c, h, content = _information(s, d)
    return _r(I.stationary(I.transition_matrix(c.tables(), h, content, c.foreign_keys(), both=False), 50), "share")


@query("table_importance_50", _share_sql(True))
def table_importance_50(s, d):
    c, h, content = _information(s, d)
    return _r(I.stationary(I.transition_matrix(c.tables(), h, content, c.foreign_keys()), 50), "share")


# Graph


@query("fk_edges", f"WITH {FK}, {EDGES} SELECT src, dst FROM edges")
def fk_edges(s, d):
    return G.edges(K.star(s, d).foreign_keys()).select("src", "dst")


@query("fk_degree", f"WITH {COLS}, {NAMES}, {FK}, {EDGES}, {BOTH} SELECT table_name, count(src) AS degree FROM names LEFT JOIN ways ON src = table_name GROUP BY table_name")
def fk_degree(s, d):
    c = K.star(s, d)
    return G.degree(c.tables(), G.edges(c.foreign_keys()))


@query("fk_neighbors", f"WITH {FK}, {EDGES}, {BOTH} SELECT src AS table_name, dst AS neighbour FROM ways")
def fk_neighbors(s, d):
    return G.neighbours(G.edges(K.star(s, d).foreign_keys()))


@query("non_neighbors", f"""WITH {COLS}, {NAMES}, {FK}, {EDGES}, {BOTH} SELECT a.table_name, b.table_name AS other FROM names a, names b
    WHERE NOT EXISTS (SELECT 1 FROM ways WHERE src = a.table_name AND dst = b.table_name)""")
def non_neighbors(s, d):
    c = K.star(s, d)
    return G.non_neighbours(c.tables(), G.edges(c.foreign_keys()))


@query("incoming_keys", f"WITH {FK} SELECT rt AS table_name, string_agg(fk_id::VARCHAR, ',' ORDER BY fk_id) AS keys FROM fk GROUP BY rt")
def incoming_keys(s, d):
    k = G.incoming(K.star(s, d).foreign_keys())
    return k.select("table_name", F.array_join("keys", ",").alias("keys"))


@query("fk_components", f"""WITH RECURSIVE {COLS}, {NAMES}, {FK}, {EDGES}, {BOTH},
r AS (SELECT table_name AS t, table_name AS o FROM names UNION SELECT r.t, dst FROM r JOIN ways ON src = r.o)
SELECT t AS table_name, min(o) AS component FROM r GROUP BY t""")
def fk_components(s, d):
    c = K.star(s, d)
    return G.components(c.tables(), G.edges(c.foreign_keys()))


RANK = f"""{COLS}, {NAMES}, {FK}, {EDGES}, {BOTH}, n AS (SELECT count(*)::DOUBLE AS n FROM names),
deg AS (SELECT table_name, count(src) AS degree FROM names LEFT JOIN ways ON src = table_name GROUP BY table_name),
jump AS (SELECT a.table_name AS src, b.table_name AS dst, 0.15 / n + CASE WHEN degree = 0 THEN 0.85 / n ELSE
    0.85 * (SELECT count(*) FROM ways w WHERE w.src = a.table_name AND w.dst = b.table_name) / degree END AS p
    FROM deg a, names b, n),
s AS (SELECT 0 AS i, table_name AS t, 1 / n AS pr FROM names, n
    UNION ALL SELECT s.i + 1, j.dst, sum(pr * p) FROM s JOIN jump j ON j.src = s.t WHERE s.i < 20 GROUP BY s.i, j.dst)"""


@query("fk_pagerank_20", f"WITH RECURSIVE {RANK} SELECT t AS table_name, round(pr, 6) AS page_rank FROM s WHERE i = 20")
def fk_pagerank_20(s, d):
    c = K.star(s, d)
    return _r(G.pagerank(c.tables(), G.edges(c.foreign_keys()), iterations=20, tolerance=None), "page_rank")


@query("zscore_rank", f"""WITH RECURSIVE {RANK}, f AS (SELECT t AS table_name, pr, degree FROM s JOIN deg ON table_name = t WHERE i = 20),
z AS (SELECT table_name, (pr - avg(pr) OVER ()) / stddev_samp(pr) OVER () + (degree - avg(degree) OVER ()) / stddev_samp(degree) OVER () AS z FROM f)
SELECT table_name, round(z, 6) AS z, row_number() OVER (ORDER BY round(z, 9) DESC, table_name)::INT AS position FROM z""")
def zscore_rank(s, d):
    c = K.star(s, d)
    g = G.edges(c.foreign_keys())
    facts = G.pagerank(c.tables(), g, iterations=20, tolerance=None).join(G.degree(c.tables(), g), "table_name")
    return _r(G.zscore_rank(facts, ["page_rank", "degree"]).select("table_name", "z", "position"), "z")


@query("betweenness")
def betweenness(s, d):
    c = K.star(s, d)
    return _r(G.betweenness(c.tables(), G.edges(c.foreign_keys())), "betweenness")


@query("edge_betweenness")
def edge_betweenness(s, d):
    c = K.star(s, d)
    return _r(G.edge_betweenness(c.tables(), G.edges(c.foreign_keys())), "betweenness")


@query("link_quality", f"""WITH {FK}, {EDGES}, {TRUTH}, e AS (SELECT x.cluster_id AS x, y.cluster_id AS y FROM edges JOIN truth x ON x.table_name = src JOIN truth y ON y.table_name = dst),
t AS (SELECT x AS c, (x = y)::INT AS i FROM e UNION ALL SELECT y, 0 FROM e WHERE x <> y),
per AS (SELECT c, sum(i) AS i, count(*) AS t FROM t GROUP BY c)
SELECT round(sum(i / m - (t / m) * (t / m)), 6) AS quality FROM per, (SELECT count(*)::DOUBLE AS m FROM edges)""")
def link_quality(s, d):
    return _r(G.link_quality(G.edges(K.star(s, d).foreign_keys()), truth(s, STAR_TRUTH)), "quality")


@query("random_walks", f"""WITH RECURSIVE {FK}, {EDGES}, {BOTH}, w AS (
    SELECT src || '#' || k AS walk_id, src AS tables, src AS here, 1 AS step FROM (SELECT DISTINCT src FROM ways), range(100) r(k)
    UNION ALL SELECT walk_id, tables || '>' || dst, dst, step + 1 FROM (
        SELECT w.*, dst, row_number() OVER (PARTITION BY walk_id ORDER BY md5('43|' || step || '|' || walk_id || '|' || dst)) AS r FROM w JOIN ways ON src = here WHERE step < 10) WHERE r = 1)
SELECT walk_id, tables FROM w WHERE step = 10""")
def random_walks(s, d):
    w = G.walks(G.edges(K.star(s, d).foreign_keys()))
    return w.select("walk_id", F.array_join("tables", ">").alias("tables"))


@query("node2vec_neighbors")
def node2vec_neighbors(s, d):
    v = G.node2vec(G.edges(K.star(s, d).foreign_keys()), size=16)
    return X.most_similar(S.mirrored(Y.cosine_pairs(v))).select("anchor", "positive")


# Text


@query("identifier_tokens", f"""WITH {COLS} SELECT table_name, column_name, array_to_string(list_transform(regexp_extract_all(column_name, '[A-Z]?[a-z]+|[A-Z]+'), lambda x: lower(x)), ' ') AS tokens FROM cols""")
def identifier_tokens(s, d):
    c = K.star(s, d).columns()
    return c.select("table_name", "column_name", F.array_join(T.identifier_tokens(F.col("column_name")), " ").alias("tokens"))


@query("name_documents", f"WITH {COLS}, {DOCS} SELECT table_name, doc FROM docs")
def name_documents(s, d):
    return T.name_documents(K.star(s, d).columns())


@query("key_descriptions", f"""WITH {COLS}, {NAMES}, {FK}, s AS (
    SELECT ct AS t, 0 AS side, fk_id, 'Key (' || cc || ') refers to ' || rt || '.' AS s FROM fk
    UNION ALL SELECT rt, 1, fk_id, ct || ' refers to it by (' || cc || ').' FROM fk)
SELECT table_name, coalesce(string_agg(s, ' ' ORDER BY side, fk_id), '') AS text FROM names LEFT JOIN s ON t = table_name GROUP BY table_name""")
def key_descriptions(s, d):
    c = K.star(s, d)
    return T.key_descriptions(c.tables(), c.foreign_keys())


@query("prompt_render", f"""WITH {COLS} SELECT table_name, 'Say in one paragraph what a table called ' || table_name || ' is for. Description:' AS prompt,
    table_name || ' ' || string_agg(column_name, ' ' ORDER BY ordinal) AS plain FROM cols GROUP BY table_name""")
def prompt_render(s, d):
    docs = T.name_documents(K.star(s, d).columns())
    schema = F.expr("substring(doc, length(table_name) + 2)")
    return docs.select("table_name", T.rendered(T.PROMPTS["name_only"], table_name=F.col("table_name")).alias("prompt"), T.rendered(T.PROMPTS["plain"], table_name=F.col("table_name"), schema=schema).alias("plain"))


@query("completion_text", f"WITH {COLS}, {NAMES} SELECT table_name, 'about ' || table_name AS text FROM names")
def completion_text(s, d):
    t = K.star(s, d).tables()
    return t.select("table_name", T.completion(F.concat(F.lit("Description: no. Description:  about "), "table_name")).alias("text"))


@query("tfidf_terms", f"WITH {COLS}, {DOCS}, {TFIDF} SELECT table_name, term, round(x, 6) AS tfidf FROM tfidf")
def tfidf_terms(s, d):
    docs = T.name_documents(K.star(s, d).columns())
    return _r(S.tfidf(docs, T.identifier_tokens(F.col("doc"))), "tfidf")


@query("document_terms", """WITH w AS (SELECT source, unnest(regexp_extract_all(lower(text), '[a-z0-9_]{2,}')) AS term FROM documents)
SELECT source, count(*) AS words, count(DISTINCT term) AS terms FROM w GROUP BY source""")
def document_terms(s, d):
    words = _table(s, d, "documents").select("source", F.explode(T.word_tokens(F.col("text"))).alias("term"))
    counts = words.groupBy("source", "term").agg(F.count("*").alias("n"))
    return counts.groupBy("source").agg(F.sum("n").alias("words"), F.count("*").alias("terms"))


@query(
    "record_tfidf",
    """WITH w AS (SELECT p_partkey, unnest(regexp_extract_all(lower(concat_ws(' ', p_name, p_brand, p_type)), '[a-z0-9_]{2,}')) AS term FROM part),
t AS (SELECT p_partkey, term, count(*) AS tf FROM w GROUP BY ALL), d AS (SELECT term, count(*) AS df FROM t GROUP BY term),
r AS (SELECT p_partkey, term, tf * (ln((1 + (SELECT count(*) FROM part)) / (1 + df)::DOUBLE) + 1) AS x FROM t JOIN d USING (term))
SELECT p_partkey, term, round(x / sqrt(sum(x * x) OVER (PARTITION BY p_partkey)), 6) AS tfidf FROM r""",
)
def record_tfidf(s, d):
    """Rows as documents."""
    docs = _table(s, d, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("doc"))
    return _r(S.tfidf(docs, T.word_tokens(F.col("doc")), "p_partkey"), "tfidf")


@query("tfidf_cosine_pairs", f"WITH {ALL_SIMS} SELECT a, b, round(sim, 6) AS sim FROM sims")
def tfidf_cosine_pairs(s, d):
    return _r(_sims(s, d), "sim")


@query("similar_tables", f"WITH {ALL_SIMS} SELECT a, b, round(sim, 6) AS sim FROM sims WHERE sim > 0.1")
def similar_tables(s, d):
    return _r(S.above(_sims(s, d), 0.1), "sim")


@query("number_features", """WITH t AS (SELECT DISTINCT l_extendedprice::DECIMAL(12, 2)::VARCHAR AS token FROM lineitem),
p AS (SELECT token, split_part(token, '.', 1) AS w, split_part(token, '.', 2) AS f FROM t)
SELECT token, least(length(w), 10)::INT AS magnitude, least(length(f), 10)::INT AS precision, left(w, 1)::INT AS first, right(f, 1)::INT AS last FROM p""")
def number_features(s, d):
    t = _table(s, d, "lineitem").select(F.col("l_extendedprice").cast("decimal(12,2)").cast("string").alias("token")).distinct()
    return t.select("token", T.number_features(F.col("token")).alias("n")).select("token", "n.*")


@query("cell_truncate", "SELECT p_partkey, substr(p_name, 1, 8) AS cell FROM part")
def cell_truncate(s, d):
    return _table(s, d, "part").select("p_partkey", T.cut_cell(F.col("p_name"), 8).alias("cell"))


@query("text_snippets", r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents)
SELECT doc_id, ceil(len(w) / 10.0)::INT AS snippets, coalesce(array_to_string(w[1:10], ' '), '') AS first FROM w""")
def text_snippets(s, d):
    t = _table(s, d, "documents").select("doc_id", T.snippets(F.col("text")).alias("s"))
    return t.select("doc_id", F.size("s").alias("snippets"), F.coalesce(F.get("s", F.lit(0)), F.lit("")).alias("first"))


@query("layout_index", "SELECT l_orderkey, l_linenumber, (l_orderkey * 7 + l_linenumber)::BIGINT AS i, ((l_orderkey * 7 + l_linenumber) // 7)::INT AS r, ((l_orderkey * 7 + l_linenumber) % 7)::INT AS c FROM lineitem")
def layout_index(s, d):
    t = _table(s, d, "lineitem").select("l_orderkey", "l_linenumber", T.cell_index(F.col("l_orderkey"), F.col("l_linenumber"), F.lit(7)).alias("i"))
    return t.withColumn("p", T.cell_place(F.col("i"), F.lit(7))).select("l_orderkey", "l_linenumber", "i", F.col("p.row").alias("r"), F.col("p.column").alias("c"))


@query("tree_index", """SELECT DISTINCT l_linenumber, CASE WHEN l_linenumber >= 32 THEN 384 ELSE l_linenumber END::INT AS a, 384 AS b, 69 AS c, 384 AS d FROM lineitem""")
def tree_index(s, d):
    t = _table(s, d, "lineitem").select("l_linenumber").distinct()
    i = T.tree_index(F.array(F.col("l_linenumber"), F.lit(-1), F.lit(5), F.lit(300)))
    return t.select("l_linenumber", *[F.get(i, F.lit(k)).alias(c) for k, c in enumerate("abcd")])


@query(
    "address_range",
    """SELECT p_partkey, chr(65 + p_size % 26) || (p_partkey % 500 + 1) || ':' || chr((65 + p_partkey % 26)::INT) || chr(65 + p_size % 26) || (p_partkey % 500 + p_size) AS address,
    (p_partkey % 500)::INT AS row_from, (p_partkey % 500 + p_size - 1)::INT AS row_to, p_size % 26 AS column_from, ((p_partkey % 26 + 1) * 26 + p_size % 26)::INT AS column_to FROM part""",
)
def address_range(s, d):
    """A range of a sheet for each part, written as a spreadsheet would."""
    letter = lambda c: F.char(F.lit(65) + F.col(c) % 26)
    row = F.col("p_partkey") % 500
    address = F.concat(letter("p_size"), (row + 1).cast("string"), F.lit(":"), letter("p_partkey"), letter("p_size"), (row + F.col("p_size")).cast("string"))
    t = _table(s, d, "part").select("p_partkey", address.alias("address"))
    return t.select("p_partkey", "address", T.address_range(F.col("address")).alias("r")).select("p_partkey", "address", "r.*")


@query("format_scaling", "SELECT p_partkey, round(least(p_size, 20) / 20.0, 6) AS size, round(least(p_retailprice, 1000) / 1000, 6) AS price FROM part")
def format_scaling(s, d):
    v = T.scaled(F.array(F.col("p_size").cast("double"), "p_retailprice"), [20, 1000])
    return _r(_table(s, d, "part").select("p_partkey", F.get(v, F.lit(0)).alias("size"), F.get(v, F.lit(1)).alias("price")), "size", "price")


@query("clean_text", r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '[\t\n\r\p{Zs}]', ' ', 'g'), '[\p{C}\x{FFFD}]', '', 'g'),
    '([\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}])', ' \1 ', 'g') AS clean FROM pages""")
def clean_text(s, d):
    return _table(s, d, "pages").select("page_id", T.clean_text(F.col("html")).alias("clean"))


# Similarity, vectors


@query("column_minmax_similarity", f"""WITH {ALL_SIMS} SELECT a, b, round(coalesce((sim - min(sim) OVER (PARTITION BY b)) / nullif(max(sim) OVER (PARTITION BY b) - min(sim) OVER (PARTITION BY b), 0), 0), 6) AS sim FROM mir""")
def column_minmax_similarity(s, d):
    return _r(S.column_minmax(_sims(s, d)), "sim")


@query("p25_similarity", f"WITH {ALL_SIMS} SELECT b, round(quantile_cont(sim, 0.25), 6) AS p FROM mir GROUP BY b")
def p25_similarity(s, d):
    return _r(S.column_percentile(_sims(s, d)), "p")


@query("fk_similar_edges", f"WITH {ALL_SIMS}, {FK}, {EDGES} SELECT src, dst, round(sim, 6) AS weight FROM edges JOIN sims ON a = src AND b = dst WHERE sim >= 0.05")
def fk_similar_edges(s, d):
    return _r(G.similar_edges(G.edges(K.star(s, d).foreign_keys()), _sims(s, d), 0.05), "weight")


WEIGHTS = f"{ALL_SIMS}, {FK}, {EDGES}, w AS (SELECT src, dst, sim AS weight FROM edges JOIN sims ON a = src AND b = dst WHERE sim >= 0.0)"


@query("minmax_edges", f"WITH {WEIGHTS} SELECT src, dst, round((weight - min(weight) OVER ()) / (max(weight) OVER () - min(weight) OVER ()), 6) AS weight FROM w")
def minmax_edges(s, d):
    return _r(S.minmax_edges(G.similar_edges(G.edges(K.star(s, d).foreign_keys()), _sims(s, d), 0.0)), "weight")


@query("softmax_weights", f"WITH {WEIGHTS} SELECT src, dst, round(exp(weight) / sum(exp(weight)) OVER (), 6) AS weight FROM w")
def softmax_weights(s, d):
    return _r(S.softmax_edges(G.similar_edges(G.edges(K.star(s, d).foreign_keys()), _sims(s, d), 0.0)), "weight")


@query("l2_normalize", f"WITH {EMB} SELECT vec_id, round(list_sum(v) / greatest(sqrt(list_sum(list_transform(v, lambda x: x * x))), 1e-10), 6) AS total FROM emb")
def l2_normalize(s, d):
    u = _table(s, d, "embeddings").select("vec_id", V.l2_normalized(F.col("embedding")).alias("u"))
    return _r(u.select("vec_id", F.aggregate("u", F.lit(0.0), lambda a, x: a + x).alias("total")), "total")


@query("average_similarity", f"""WITH {EMB}, u AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS u FROM emb),
d AS (SELECT unnest(u) AS x, unnest(range(len(u))) AS pos FROM u), m AS (SELECT list(a ORDER BY pos) AS m FROM (SELECT pos, avg(x) AS a FROM d GROUP BY pos))
SELECT vec_id, round(list_inner_product(u, m), 6) AS avg_sim FROM u, m""")
def average_similarity(s, d):
    return _r(S.average_similarity(_table(s, d, "embeddings"), "vec_id"), "avg_sim")


@query("embedding_nearest", f"""WITH {EMB}, p AS (SELECT a.vec_id, b.vec_id AS nearest, round(list_cosine_similarity(a.v, b.v), 12) AS sim FROM emb a JOIN emb b ON a.vec_id <> b.vec_id)
SELECT vec_id, nearest, round(sim, 6) AS sim FROM p QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, nearest) = 1""")
def embedding_nearest(s, d):
    return _r(S.nearest(_table(s, d, "embeddings"), "vec_id"), "sim")


@query("label_centroids", f"WITH {EMB}, {DIMS} SELECT label, pos::INT AS pos, round(avg(x), 6) AS m FROM dims GROUP BY ALL")
def label_centroids(s, d):
    return _r(S.centroids(_table(s, d, "embeddings"), "label").select("label", F.posexplode("centroid").alias("pos", "m")), "m")


NEAREST = f"""{EMB}, {DIMS}, {CENTRES}, near AS (SELECT vec_id, e.label, c.label AS nearest, round(list_cosine_similarity(v, c), 12) AS sim FROM emb e, centres c
    QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, c.label) = 1)"""


@query("nearest_centroid", f"WITH {NEAREST} SELECT vec_id, nearest, round(sim, 6) AS sim FROM near")
def nearest_centroid(s, d):
    e = _table(s, d, "embeddings")
    return _r(S.nearest_centroid(e, S.centroids(e, "label"), "vec_id", "label"), "sim")


@query("centroid_distance", f"WITH {EMB}, {DIMS}, {CENTRES} SELECT a.label AS a, b.label AS b, round(list_distance(a.c, b.c), 6) AS d FROM centres a JOIN centres b ON a.label < b.label")
def centroid_distance(s, d):
    return _r(M.centroid_distances(_table(s, d, "embeddings"), "label"), "d")


@query("silhouette", f"""WITH {EMB}, m AS (SELECT a.vec_id, a.label AS own, b.label, sum(list_distance(a.v, b.v)) AS total, count(*) AS n FROM emb a, emb b GROUP BY ALL),
p AS (SELECT vec_id, max(CASE WHEN own = label THEN total / nullif(n - 1, 0) END) AS a, min(CASE WHEN own <> label THEN total / n END) AS b FROM m GROUP BY vec_id)
SELECT round(avg(coalesce((b - a) / greatest(a, b), 0)), 6) AS silhouette FROM p""")
def silhouette(s, d):
    return _r(M.silhouette(_table(s, d, "embeddings"), "vec_id", "label"), "silhouette")


SPREAD = f"""{EMB}, {DIMS}, {CENTRES}, spread AS (SELECT e.label, avg(list_distance(v, c)) AS s, sum(list_distance(v, c) * list_distance(v, c)) AS sq, count(*) AS n, any_value(c) AS c
    FROM emb e JOIN centres k ON k.label = e.label GROUP BY e.label)"""


@query("davies_bouldin", f"""WITH {SPREAD}, w AS (SELECT a.label, max((a.s + b.s) / list_distance(a.c, b.c)) AS r FROM spread a JOIN spread b ON a.label <> b.label GROUP BY a.label)
SELECT round(avg(r), 6) AS davies_bouldin FROM w""")
def davies_bouldin(s, d):
    return _r(M.davies_bouldin(_table(s, d, "embeddings"), "label"), "davies_bouldin")


@query("calinski_harabasz", f"""WITH {SPREAD}, mid AS (SELECT list(a ORDER BY pos) AS m FROM (SELECT pos, avg(x) AS a FROM dims GROUP BY pos))
SELECT round(sum(n * list_distance(c, m) * list_distance(c, m)) * (sum(n) - count(*)) / (sum(sq) * (count(*) - 1)), 6) AS calinski_harabasz FROM spread, mid""")
def calinski_harabasz(s, d):
    return _r(M.calinski_harabasz(_table(s, d, "embeddings"), "label"), "calinski_harabasz")


#: Integer and text columns of the sales tables.
OVERLAP = [(t, c) for t, _, c, k in COLUMN_ROWS if t in ("region", "nation", "customer", "supplier", "part", "orders") and k in ("int", "bigint", "string")]


def _samples(s, d) -> DataFrame:
    c = K.star(s, d)
    tables = sorted({t for t, _ in OVERLAP})
    few = K.Catalog(s, {}, sources={t: c.scan(t).select(*[x for u, x in OVERLAP if u == t]) for t in tables})
    return P.value_samples(few, tables, 20)


SAMPLES = "samples AS (" + " UNION ALL ".join(f"SELECT '{t}' AS t, '{c}' AS c, v FROM (SELECT DISTINCT {c}::VARCHAR AS v FROM {t} ORDER BY v NULLS FIRST LIMIT 20)" for t, c in OVERLAP) + ")"


@query("value_samples", f"WITH {SAMPLES} SELECT t AS table_name, c AS column_name, string_agg(v, '|' ORDER BY v) AS vals FROM samples GROUP BY ALL")
def value_samples(s, d):
    return _samples(s, d).select("table_name", "column_name", F.array_join("values", "|").alias("vals"))


@query("column_jaccard", f"""WITH {SAMPLES}, k AS (SELECT t, c, count(*) AS n FROM samples GROUP BY ALL)
SELECT a.t AS t1, a.c AS c1, b.t AS t2, b.c AS c2, round(count(*) / (x.n + y.n - count(*))::DOUBLE, 6) AS sim
FROM samples a JOIN samples b ON a.v = b.v AND a.t < b.t JOIN k x ON x.t = a.t AND x.c = a.c JOIN k y ON y.t = b.t AND y.c = b.c GROUP BY a.t, a.c, b.t, b.c, x.n, y.n""")
def column_jaccard(s, d):
    return _r(S.jaccard(_samples(s, d)), "sim")


@query("value_overlap")
def value_overlap(s, d):
    return _r(S.value_overlap(_samples(s, d)), "sim")


# Roles and triplets


@query("reference_tables", f"""WITH {MINI_FK}, n AS (SELECT * FROM {_values([(t, len(c)) for t, (c, _, _) in K.MINI.items()])} v(t, k))
SELECT t AS table_name FROM n JOIN (SELECT ct, count(*) AS f FROM fk GROUP BY ct) ON ct = t WHERE k > 1 AND f > 1 AND f / k::DOUBLE >= 0.5""")
def reference_tables(s, d):
    c = K.mini(s)
    return R.reference_tables(c.tables(), c.foreign_keys())


@query("reference_groups", f"""WITH {MINI_FK}, g AS (SELECT ct, string_agg(rt || '(' || cc || ')', ';' ORDER BY rt || '(' || cc || ')') AS signature FROM fk WHERE ct IN ('like', 'purchase') GROUP BY ct)
SELECT signature, string_agg(ct, ',' ORDER BY ct) AS tables FROM g GROUP BY signature HAVING count(*) > 1""")
def reference_groups(s, d):
    c = K.mini(s)
    return R.reference_groups(R.reference_tables(c.tables(), c.foreign_keys()), c.foreign_keys())


def _mini_roles(s):
    c = K.mini(s)
    g = G.edges(c.foreign_keys())
    facts = G.degree(c.tables(), g).join(G.pagerank(c.tables(), g), "table_name").join(G.betweenness(c.tables(), g), "table_name")
    ranked = G.zscore_rank(facts, ["page_rank", "degree", "betweenness"])
    references = R.reference_tables(c.tables(), c.foreign_keys())
    return c, g, ranked, references, R.entity_tables(ranked, references, G.neighbours(g))


@query("entity_tables")
def entity_tables(s, d):
    return _mini_roles(s)[4]


@query("detail_tables", f"""WITH {MINI_FK}, k AS (SELECT ct, min(rt) AS entity, count(DISTINCT rt) AS n, bool_and(rc = 'id') AS ok FROM fk GROUP BY ct)
SELECT entity, ct AS detail FROM k WHERE n = 1 AND ok AND entity IN ('user', 'product') AND ct NOT IN ('user', 'product', 'like', 'purchase')""")
def detail_tables(s, d):
    c, _, _, references, entities = _mini_roles(s)
    return R.detail_tables(entities, references, c.foreign_keys(), c.tables().select("table_name", "pk"))


POSITIVES = f"{ALL_SIMS}, pos AS (SELECT a AS anchor, b AS positive, sim FROM mir QUALIFY row_number() OVER (PARTITION BY a ORDER BY round(sim, 9) DESC, b) = 1)"


@query("most_similar_tables", f"WITH {POSITIVES} SELECT anchor, positive, round(sim, 6) AS sim FROM pos")
def most_similar_tables(s, d):
    return _r(X.most_similar(S.mirrored(_sims(s, d))), "sim")


NEGATIVES = f"""{POSITIVES}, p25 AS (SELECT a, quantile_cont(sim, 0.25) AS p FROM mir GROUP BY a),
c AS (SELECT anchor, positive, m.b AS c, m.sim, m.sim < pos.sim - 0.3 AS hard FROM pos JOIN mir m ON m.a = anchor JOIN p25 ON p25.a = anchor
    WHERE m.b <> positive AND (m.sim < pos.sim - 0.3 OR m.sim > p)),
neg AS (SELECT anchor, positive, c AS negative FROM c QUALIFY row_number() OVER (PARTITION BY anchor, positive ORDER BY hard DESC,
    CASE WHEN hard THEN -round(sim, 9) ELSE round(sim, 9) END, c) = 1)"""


def _negatives(s, d):
    sims = S.mirrored(_sims(s, d))
    return X.semi_hard_negatives(X.most_similar(sims).select("anchor", "positive"), sims)


@query("semi_hard_negatives", f"WITH {NEGATIVES} SELECT anchor, positive, negative FROM neg")
def semi_hard_negatives(s, d):
    return _negatives(s, d)


@query("triplet_pairs", f"WITH {NEGATIVES} SELECT anchor AS sentence1, positive AS sentence2, 1 AS label FROM neg UNION ALL SELECT anchor, negative, 0 FROM neg")
def triplet_pairs(s, d):
    return X.labelled_pairs(_negatives(s, d))


@query("enriched_triplets", f"WITH {NEGATIVES} SELECT x.doc AS anchor, y.doc AS positive, z.doc AS negative FROM neg JOIN docs x ON x.table_name = anchor JOIN docs y ON y.table_name = positive JOIN docs z ON z.table_name = negative")
def enriched_triplets(s, d):
    docs = T.name_documents(K.star(s, d).columns()).withColumnRenamed("doc", "text")
    return X.enriched(_negatives(s, d), docs)


@query("triplet_purity", f"""WITH {NEGATIVES}, {TRUTH} SELECT round(avg((x.cluster_id = y.cluster_id)::INT), 6) AS positive_purity, round(avg((x.cluster_id <> z.cluster_id)::INT), 6) AS negative_purity
FROM neg JOIN truth x ON x.table_name = anchor JOIN truth y ON y.table_name = positive JOIN truth z ON z.table_name = negative""")
def triplet_purity(s, d):
    return _r(X.purity(_negatives(s, d), truth(s, STAR_TRUTH)), "positive_purity", "negative_purity")


ORD = f"{COLS}, {NAMES}, ord AS (SELECT table_name, row_number() OVER (ORDER BY table_name) - 1 AS place FROM names)"
PLACE = "('0x' || substr(md5('43|' || {}), 1, 8))::BIGINT % (SELECT count(*) FROM names)"


@query("random_triplets", f"""WITH {ORD} SELECT n.table_name AS anchor, p.table_name AS positive, q.table_name AS negative FROM names n
    JOIN ord p ON p.place = {PLACE.format("n.table_name || '|positive'")} JOIN ord q ON q.place = {PLACE.format("n.table_name || '|negative'")}""")
def random_triplets(s, d):
    return X.random_triplets(K.star(s, d).tables())


@query("neighbor_triplets", f"""WITH {ORD}, {FK}, {EDGES}, {BOTH}, k AS (SELECT unnest(range(1, 6)) AS k),
near AS (SELECT src AS anchor, dst AS c, k FROM ways, k
    UNION ALL SELECT n.table_name, o.table_name, k FROM names n, k JOIN ord o ON o.place = {PLACE.format("n.table_name || '|' || k")} WHERE n.table_name NOT IN (SELECT src FROM ways)),
far AS (SELECT a.table_name AS anchor, b.table_name AS c, k FROM names a, names b, k WHERE a.table_name <> b.table_name
    AND NOT EXISTS (SELECT 1 FROM ways WHERE src = a.table_name AND dst = b.table_name)),
p AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY anchor, k ORDER BY md5('43|' || anchor || '|' || c || '|' || k)) = 1),
q AS (SELECT * FROM far QUALIFY row_number() OVER (PARTITION BY anchor, k ORDER BY md5('43|' || anchor || '|' || c || '|' || k || '|n')) = 1)
SELECT p.anchor, p.c AS positive, q.c AS negative FROM p JOIN q USING (anchor, k)""")
def neighbor_triplets(s, d):
    c = K.star(s, d)
    g = G.edges(c.foreign_keys())
    return X.neighbour_triplets(c.tables(), G.neighbours(g), G.non_neighbours(c.tables(), g), 5)


@query("similarity_triplets", f"""WITH {POSITIVES} SELECT anchor, positive, b AS negative FROM pos JOIN mir ON a = anchor AND b <> positive
    QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY md5('43|' || anchor || '|' || b)) = 1""")
def similarity_triplets(s, d):
    return X.similarity_triplets(S.mirrored(_sims(s, d)))


@query("threshold_triplets", f"""WITH {ALL_SIMS}, {FK}, {EDGES}, {BOTH}, p AS (SELECT a, b AS positive FROM mir JOIN ways ON src = a AND dst = b WHERE sim > 0.05),
q AS (SELECT a, b AS negative FROM mir WHERE sim < 0.05 AND NOT EXISTS (SELECT 1 FROM ways WHERE src = a AND dst = b)
    QUALIFY row_number() OVER (PARTITION BY a ORDER BY round(sim, 9), b) <= 10)
SELECT a AS anchor, positive, negative FROM p JOIN q USING (a)
    QUALIFY row_number() OVER (PARTITION BY a, positive ORDER BY md5('43|' || a || '|' || positive || '|' || negative)) = 1""")
def threshold_triplets(s, d):
    return X.threshold_triplets(G.neighbours(G.edges(K.star(s, d).foreign_keys())), S.mirrored(_sims(s, d)), 0.05, 0.05)


@query("truth_triplets", f"""WITH {TRUTH} SELECT x.table_name AS anchor, y.table_name AS positive, z.table_name AS negative FROM truth x
    JOIN truth y ON y.cluster_id = x.cluster_id AND y.table_name <> x.table_name JOIN truth z ON z.cluster_id <> x.cluster_id
    QUALIFY row_number() OVER (PARTITION BY x.table_name, y.table_name ORDER BY md5('43|' || x.table_name || '|' || y.table_name || '|' || z.table_name)) <= 4""")
def truth_triplets(s, d):
    return X.truth_triplets(truth(s, STAR_TRUTH))


@query("constrained_triplets")
def constrained_triplets(s, d):
    c = Y.context(K.mini(s))
    c.floor = -1.0
    return X.constrained_triplets(Y.training_pairs(c), S.column_minmax(c.sims))


@query("low_similarity_triplets", f"""WITH {POSITIVES}, p25 AS (SELECT a, quantile_cont(sim, 0.25) AS p FROM mir GROUP BY a),
low AS (SELECT anchor, positive, b AS c FROM pos JOIN mir m ON m.a = anchor AND b <> positive JOIN p25 ON p25.a = anchor WHERE m.sim > p
    QUALIFY row_number() OVER (PARTITION BY anchor, positive ORDER BY round(m.sim, 9), b) <= 5)
SELECT anchor, positive, c AS negative FROM low QUALIFY row_number() OVER (PARTITION BY anchor, positive ORDER BY md5('43|' || anchor || '|' || c)) = 1""")
def low_similarity_triplets(s, d):
    sims = S.mirrored(_sims(s, d))
    return X.low_similarity_triplets(X.most_similar(sims).select("anchor", "positive"), sims)


# Metrics


@query("contingency", f"WITH {CONT} SELECT t, p, n FROM cont")
def contingency(s, d):
    return M.contingency(_table(s, d, "documents"), "lang", "source")


def _cont(s, d) -> DataFrame:
    return M.contingency(_table(s, d, "documents"), "lang", "source")


MARGINS = f"{CONT}, m AS (SELECT *, sum(n) OVER (PARTITION BY t) AS a, sum(n) OVER (PARTITION BY p) AS b, sum(n) OVER ()::DOUBLE AS tot FROM cont)"


@query("mutual_information", f"""WITH {MARGINS} SELECT round(sum(n / tot * ln(n * tot / (a * b))), 6) AS mutual_information,
    round(-sum(n / tot * ln(a / tot)), 6) AS h_truth, round(-sum(n / tot * ln(b / tot)), 6) AS h_found FROM m""")
def mutual_information(s, d):
    return _r(M.mutual_information(_cont(s, d)), "mutual_information", "h_truth", "h_found")


EMI = f"""{MARGINS}, mi AS (SELECT sum(n / tot * ln(n * tot / (a * b))) AS mi, -sum(n / tot * ln(a / tot)) AS ht, -sum(n / tot * ln(b / tot)) AS hp FROM m),
xa AS (SELECT a::BIGINT AS a, any_value(tot)::BIGINT AS n FROM m GROUP BY t, a), xb AS (SELECT b::BIGINT AS b FROM m GROUP BY p, b),
k AS (SELECT a, b, n, unnest(range(greatest(1, a + b - n), least(a, b) + 1)) AS k FROM xa, xb),
emi AS (SELECT sum(k / n::DOUBLE * ln(n * k / (a * b)::DOUBLE) * exp(lgamma(a + 1) + lgamma(b + 1) + lgamma(n - a + 1) + lgamma(n - b + 1)
    - lgamma(n + 1) - lgamma(k + 1) - lgamma(a - k + 1) - lgamma(b - k + 1) - lgamma(n - a - b + k + 1))) AS emi FROM k)"""


@query("adjusted_mutual_information", f"WITH {EMI} SELECT round((mi - emi) / ((ht + hp) / 2 - emi), 6) AS ami FROM mi, emi")
def adjusted_mutual_information(s, d):
    return _r(M.adjusted_mutual_information(_cont(s, d)), "ami")


PAIR_COUNTS = """q AS (SELECT (SELECT sum(n * (n - 1) / 2.0) FROM cont) AS c, (SELECT sum(a * (a - 1) / 2.0) FROM (SELECT sum(n) AS a FROM cont GROUP BY t)) AS x,
    (SELECT sum(b * (b - 1) / 2.0) FROM (SELECT sum(n) AS b FROM cont GROUP BY p)) AS y, (SELECT sum(n) * (sum(n) - 1) / 2.0 FROM cont) AS m)"""
PAIRS = f"{CONT}, {PAIR_COUNTS}"


@query("rand_index", f"WITH {PAIRS} SELECT round((m + 2 * c - x - y) / m, 6) AS rand_index FROM q")
def rand_index(s, d):
    return _r(M.rand_index(_cont(s, d)), "rand_index")


@query("adjusted_rand_index", f"WITH {PAIRS} SELECT round((c - x * y / m) / ((x + y) / 2 - x * y / m), 6) AS adjusted_rand_index FROM q")
def adjusted_rand_index(s, d):
    return _r(M.adjusted_rand_index(_cont(s, d)), "adjusted_rand_index")


@query("centroid_rand_index", f"""WITH {NEAREST}, cont AS (SELECT label AS t, nearest AS p, count(*) AS n FROM near GROUP BY ALL), {PAIR_COUNTS}
SELECT round((c - x * y / m) / ((x + y) / 2 - x * y / m), 6) AS adjusted_rand_index FROM q""")
def centroid_rand_index(s, d):
    e = _table(s, d, "embeddings")
    near = S.nearest_centroid(e, S.centroids(e, "label"), "vec_id", "label").join(e.select("vec_id", "label"), "vec_id")
    return _r(M.adjusted_rand_index(M.contingency(near, "label", "nearest")), "adjusted_rand_index")


@query("cluster_stats", "SELECT count(*) AS clusters, avg(n) AS mean_size, max(n) AS max_size, min(n) AS min_size FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)")
def cluster_stats(s, d):
    return M.cluster_stats(_table(s, d, "documents"), "source")


@query("percentile_sizes", "SELECT quantile_cont(n, 0.2)::DOUBLE AS p20, quantile_cont(n, 0.9)::DOUBLE AS p90 FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang)")
def percentile_sizes(s, d):
    return M.percentile_sizes(_table(s, d, "documents").select(F.col("lang").alias("cluster_id")))


@query("fk_belongingness", f"WITH {FK}, {TRUTH} SELECT avg((x.cluster_id = y.cluster_id)::INT) AS belonging FROM fk JOIN truth x ON x.table_name = ct JOIN truth y ON y.table_name = rt")
def fk_belongingness(s, d):
    return M.key_belonging(K.star(s, d).foreign_keys(), truth(s, STAR_TRUTH))


@query("sim_quality", f"""WITH {ALL_SIMS}, {TRUTH}, d AS (SELECT x.cluster_id AS x, y.cluster_id AS y, avg(1 - sim) AS m FROM mir JOIN truth x ON x.table_name = a JOIN truth y ON y.table_name = b GROUP BY ALL),
c AS (SELECT cluster_id AS c, coalesce((SELECT min(m) FROM d WHERE x = cluster_id AND y <> cluster_id), 1) AS sep, coalesce((SELECT m FROM d WHERE x = cluster_id AND y = cluster_id), 1) AS coh
    FROM (SELECT DISTINCT cluster_id FROM truth))
SELECT round(sum((SELECT count(*) FROM c) * (sep - coh) / (SELECT count(*) FROM truth)::DOUBLE), 6) AS quality FROM c""")
def sim_quality(s, d):
    dist = _sims(s, d).select("a", "b", (1 - F.col("sim")).alias("d"))
    return _r(M.cut_quality(truth(s, STAR_TRUTH), dist), "quality")


@query(
    "missing_extra_tables",
    """SELECT coalesce(c.k, o.k)::VARCHAR AS table_name, CASE WHEN o.k IS NULL THEN 'missing' ELSE 'extra' END AS kind
    FROM (SELECT c_custkey AS k FROM customer WHERE c_custkey % 3 > 0) c FULL JOIN (SELECT DISTINCT o_custkey AS k FROM orders) o ON c.k = o.k WHERE c.k IS NULL OR o.k IS NULL""",
)
def missing_extra_tables(s, d):
    """Customers that should have orders and have none, or have some and shouldn't."""
    t = _table(s, d, "customer").where("c_custkey % 3 > 0").select(F.col("c_custkey").cast("string").alias("table_name"))
    return M.missing_and_extra(t, _table(s, d, "orders").select(F.col("o_custkey").cast("string").alias("table_name")).distinct())


@query("confusion_f1", """WITH p AS (SELECT quality AS g, (n_chars >= 1500)::INT AS p FROM labels JOIN documents USING (doc_id)),
k AS (SELECT unnest([0, 1]) AS label), c AS (SELECT label, (SELECT count(*) FROM p WHERE g = label) AS gold, (SELECT count(*) FROM p WHERE p = label) AS found,
    (SELECT count(*) FROM p WHERE g = label AND p = label) AS hit FROM k),
r AS (SELECT label, hit / (found + 1e-6) AS precision, hit / (gold + 1e-6) AS recall FROM c)
SELECT label::INT AS label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(2 * precision * recall / (precision + recall + 1e-6), 6) AS f1 FROM r""")
def confusion_f1(s, d):
    rows = _table(s, d, "labels").join(_table(s, d, "documents").select("doc_id", "n_chars"), "doc_id").select("quality", (F.col("n_chars") >= 1500).cast("int").alias("found"))
    return _r(M.confusion(rows, "quality", "found"), "precision", "recall", "f1")


@query("label_counts", "SELECT toxic, count(*) AS n FROM labels GROUP BY toxic")
def label_counts(s, d):
    return _table(s, d, "labels").groupBy("toxic").agg(F.count("*").alias("n"))


@query("metric_report")
def metric_report(s, d):
    c = K.star(s, d)
    return _r(M.report(truth(s, STAR_TRUTH), C.greedy_modularity(c.tables(), G.edges(c.foreign_keys()))), "value")


@query("dot_layout")
def dot_layout(s, d):
    return _r(M.dot_layout(truth(s, STAR_TRUTH)), "x", "y")


# Ensembles

BUCKETS = [(t, len(c.split(",")) % 3, t[0]) for t, c in sorted(STAR_COLUMNS.items())]


def _labelings(s: SparkSession) -> list[DataFrame]:
    b = s.createDataFrame(BUCKETS, "table_name string, cluster_id int, letter string")
    return [truth(s, STAR_TRUTH), b.select("table_name", "cluster_id"), b.select("table_name", F.ascii("letter").alias("cluster_id"))]


LABELS = f"{TRUTH}, b AS (SELECT * FROM {_values(BUCKETS)} v(table_name, k, letter)), l AS (SELECT table_name, cluster_id AS x, k AS y, letter AS z FROM truth JOIN b USING (table_name))"


@query("co_association", f"WITH {LABELS} SELECT p.table_name AS a, q.table_name AS b, round(((p.x = q.x)::INT + (p.y = q.y)::INT + (p.z = q.z)::INT) / 3.0, 6) AS sim FROM l p JOIN l q ON p.table_name < q.table_name")
def co_association(s, d):
    return _r(E.co_association(K.star(s, d).tables(), _labelings(s)), "sim")


@query("weighted_co_association", f"WITH {LABELS} SELECT p.table_name AS a, q.table_name AS b, round(0.66 * (p.x = q.x)::INT + 0.34 * (p.y = q.y)::INT, 6) AS sim FROM l p JOIN l q ON p.table_name < q.table_name")
def weighted_co_association(s, d):
    return _r(E.co_association(K.star(s, d).tables(), _labelings(s)[:2], [0.66, 0.34]), "sim")


@query("meta_linkage")
def meta_linkage(s, d):
    return E.meta_linkage(K.star(s, d).tables(), _labelings(s))


# Clusterings and systems (no SQL form)


def _on_star(f: Callable[[Y.Context], DataFrame]) -> Query:
    def run(s, d):
        c = Y.context(K.star(s, d), sorted({t for t, _ in OVERLAP}))
        c.floor = 0.05
        return f(c)

    return run


def _simple(f) -> Query:
    return _on_star(lambda c: f(c.names, G.edges(c.keys)))


for _name, _f in {
    "label_propagation": C.label_propagation, "louvain": C.louvain, "greedy_modularity": C.greedy_modularity, "girvan_newman": C.girvan_newman,
    "link_clusters": C.link_clusters, "affinity_reduced": C.affinity_reduced,
}.items():
    QUERIES[_name] = _simple(_f)
for _method in ("single", "average", "complete"):
    QUERIES[f"linkage_{_method}"] = _on_star(lambda c, m=_method: C.linkage(c.names, S.table_similarity(c.catalog.columns()).select("a", "b", (1 - F.col("sim")).alias("d")), m))
for _method in ("affinity", "dbscan", "optics"):
    QUERIES[f"{_method}_clusters"] = _on_star(lambda c, m=_method: Y.clustered(c.vectors, m))
for _method in ("kmeans", "bisecting", "agglomerative", "spectral"):
    QUERIES[f"{_method}_k"] = _on_star(lambda c, m=_method: C.by_k(c.vectors, 4, m))
for _name, _f in Y.SYSTEMS.items():
    QUERIES[f"system_{_name}"] = _on_star(_f)
del _name, _f, _method


@query("cluster_keys", "SELECT o_custkey AS cluster_id, md5(to_json(list(o_orderkey::VARCHAR ORDER BY o_orderkey::VARCHAR))::VARCHAR) AS key FROM orders GROUP BY o_custkey")
def cluster_keys(s, d):
    """Each customer's orders as a cluster."""
    return G.cluster_key(_table(s, d, "orders").select(F.col("o_orderkey").cast("string").alias("table_name"), F.col("o_custkey").alias("cluster_id")))


@query("given_clusters", f"WITH {COLS}, {NAMES} SELECT table_name, CASE WHEN table_name IN ('orders', 'customer') THEN 0 WHEN table_name = 'part' THEN 1 ELSE 2 END::INT AS cluster_id FROM names")
def given_clusters(s, d):
    return Y.given_clusters(Y.context(K.star(s, d)), [["orders", "customer", "invented"], ["part"]])


# Tables as documents


@query("table_lines")
def table_json(s, d):
    return table_lines(_table(s, d, "region"), "region")


@query("pooled_vectors", f"WITH {EMB}, {DIMS} SELECT label, pos::INT AS pos, round(sum(x), 4) AS m FROM dims GROUP BY ALL")
def pooled_vectors(s, d):
    e = _table(s, d, "embeddings").select(F.lit("t").alias("table_id"), F.col("label").alias("indicator"), F.transform("embedding", lambda x: x.cast("double")).alias("state"))
    return _r(Z.pooled(e, "sum").select(F.col("indicator").alias("label"), F.posexplode("vector").alias("pos", "m")), "m", digits=4)


@query("representative_records")
def representative_records(s, d):
    return N.representative(_table(s, d, "part"))


@query("projected_vectors")
def projected_vectors(s, d):
    return _r(N.projected(_table(s, d, "embeddings"), "vec_id"), "x0", "x1", digits=4)


@query("cluster_numbers")
def cluster_numbers(s, d):
    """How well every number of clusters from 2 to 19 fits the vectors."""
    return _r(B.cluster_numbers(_table(s, d, "embeddings"), "vec_id", "embedding"), "silhouette")


from . import sheet_queries  # noqa: E402, F401  its queries use the parts above
