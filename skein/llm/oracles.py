"""SQL for DuckDB, for the operators that SQL can express."""

from __future__ import annotations

from .quality import BOILERPLATE, ENDED, Rules


def quality_sql(rules: Rules | None = None) -> str:
    """The quality rules over ``documents``."""
    r = rules or Rules()
    space, word = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]+"
    strange = r"""[^\p{L}\p{M}\p{N}\s.,;:?''"()\-]"""
    phrases, ended = "|".join(BOILERPLATE), ENDED.replace("'", "''")
    count = lambda s, p: f"len(regexp_extract_all({s}, '{p}'))"
    fails = (
        f"({count('x', '[|»›•]')} >= {r.pipes} OR {count('x', strange)} > {r.marks} * length(x)"
        f" OR (NOT regexp_matches(x, '{ended}') AND {count('x', word)} >= {r.unended})"
        f" OR (regexp_matches(x, '(?i){phrases}') AND {count('x', word)} <= {r.phrase_words}))"
    )
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{word}') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{word}')) AS l FROM d),
g AS (SELECT doc_id, unnest(range(1, greatest(len(w) - 3, 1))) AS i, w FROM w WHERE len(w) >= 5),
k AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4]) AS n FROM g),
rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM k WHERE n > 1) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    coalesce(n_repeat, 0)::BIGINT AS n_repeat_words,
    length(array_to_string(regexp_extract_all(array_to_string(list_filter(l, lambda x: {fails}), chr(10)), '{word}'), '')) AS bad FROM w LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, n_words < {r.least_words} OR 100 * n_repeat_words > {r.most_repeated} * n_words AS base_failed, coalesce(bad / nullif(word_chars, 0)::DOUBLE, 0) AS lost FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND lost <= {r.most_lost} AS kept, round(lost, 6) AS lost FROM f"""


#: Inner products of whole numbers, every query against every other row.
FAGIN_SQL = """WITH e AS (SELECT vec_id, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS x FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
p AS (SELECT q.vec_id AS query_id, v.vec_id, list_sum(list_transform(list_zip(q.x, v.x), lambda z: z[1] * z[2]))::BIGINT AS score
    FROM e q JOIN e v ON q.vec_id % 50 = 0 AND v.vec_id IS DISTINCT FROM q.vec_id AND len(q.x) = len(v.x)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id NULLS LAST)::INT AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""

#: The CRC-32 of an id's digits, bit by bit.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(c) + 1), lambda i: ascii(c[i])::BIGINT)), lambda a, b:
    list_reduce(list_prepend(xor(a, b), range(8)), lambda v, k: xor(v >> 1, (v & 1) * 3988292384))), 4294967295)"""

#: Every prefix of every conversation, grouped; subtrees by joining each node to its ancestors.
TRIE_SQL = f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list({{'r': r, 'x': x}} ORDER BY turn NULLS FIRST, sha256(length(r) || ':' || r || x)) AS s FROM t GROUP BY conv_id),
h AS (SELECT conv_id, s, {_CRC} % 4 AS h FROM (SELECT *, conv_id::VARCHAR AS c FROM o)),
b AS (SELECT h.conv_id, list_concat(coalesce(p.s[1:h.h], []), h.s[h.h + 1:]) AS s FROM h LEFT JOIN o p ON p.conv_id = h.conv_id - h.conv_id % 20),
e AS (SELECT conv_id, s, unnest(range(len(s) + 1)) AS d FROM b),
m AS (SELECT conv_id, d, s[1:d] AS path, len(s) AS n FROM e),
n AS (SELECT path, d, min(conv_id) AS c, count(*) AS n, sha256(coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends,
    coalesce(len(regexp_extract_all(path[d].x, '[^\\x20\\x09-\\x0D]+')), 0) AS w FROM m GROUP BY path, d),
k AS (SELECT path[1:d - 1] AS path, count(*) AS k FROM n WHERE d > 0 GROUP BY ALL),
f AS (SELECT n.*, coalesce(k, 0) AS k FROM n LEFT JOIN k USING (path)),
a AS (SELECT path, n, w, k, d, unnest(range(d + 1)) AS up FROM f),
s AS (SELECT path[1:up] AS path, count(*) FILTER (k = 0) AS leaves, sum((n - 1) * w) AS saved FROM a GROUP BY ALL)
SELECT f.c AS conv_id, f.d::BIGINT AS depth, p.c AS parent_conv_id, f.n AS n_convs, f.k AS n_children, leaves AS n_leaves, saved::BIGINT AS saved_tokens,
    f.ends AS ends_sha256 FROM f JOIN s USING (path) LEFT JOIN n p ON f.d > 0 AND p.path = f.path[1:f.d - 1]"""

ORACLE_SQL = {"op10_quality": quality_sql(), "op12_fagin": FAGIN_SQL, "op13_trie": TRIE_SQL}
