"""Whitening, exact top-k and the prefix trie against plain versions, and on odd rows."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from skein.llm import topk, trie, whitening

FOLDER = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")
VECTORS = "vec_id long, embedding array<double>, label int"


def clashing(df, names):
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("x") for c in names.split()})


def plain_whitening(rows, most=16):
    """{(row, component): (n, deviation, whitened, explained)} of rows of one length."""
    x = np.array([np.floor(64 * np.array(v, float)) for v in rows]).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    y = fit - sums / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    w = (x * n - sums) / n @ vectors
    deviation = ((n * x - sums) ** 2).sum(axis=1)
    return {(i, k + 1): (n, int(deviation[i]), w[i, k] / np.sqrt(values[k]), values[k] / values.sum()) for i in range(len(x)) for k in range(min(most, x.shape[1]))}


def same_whitening(found, want):
    found = {(r[0], r[1]): r for r in found}
    assert found.keys() == want.keys()
    signs = defaultdict(set)
    for key, (n, deviation, w, explained) in want.items():
        r = found[key]
        assert (r.n, r.deviation) == (n, deviation)
        assert abs(r.explained - explained) <= 1e-9 and r.identity_error <= 1e-9 and abs(abs(r.whitened) - abs(w)) <= 1e-8
        if abs(w) > 1e-6:
            signs[key[1]].add(np.sign(r.whitened * w))
    assert all(len(s) == 1 for s in signs.values())


def test_whitening_equals_a_plain_version(spark):
    e = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    rows = e.orderBy("vec_id").collect()
    want = {(rows[i].vec_id, k): v for (i, k), v in plain_whitening([r.embedding for r in rows]).items()}
    same_whitening(whitening.op11_whitening(spark, FOLDER).collect(), want)


@pytest.mark.parametrize("d", [1, 3, 70])
def test_whitening_takes_any_number_of_dimensions(spark, d):
    draw = np.random.default_rng(d)
    rows = draw.normal(size=(200, d)) * draw.uniform(0.5, 3, d) + 1e3
    rows = [*rows.tolist(), rows[0].tolist(), rows[1].tolist()]
    df = clashing(spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>"), "x y i v b w c0 w0 id n component")
    same_whitening(whitening.whitened(df).collect(), plain_whitening(rows))


def test_whitening_on_odd_rows(spark):
    odd = [
        (1, [0.5, 1.0], 0), (2, None, 0), (3, [None, 1.0], 0), (4, [NAN, 1.0], 0), (5, [INF, 0.0], 0), (6, [], 0), (None, [1.5, -1.0], None),
        (1, [0.5, 1.0], 0), (7, [0.0, 0.25], 0), (8, [2.0], 0), (9, [2.0, 2.0, 2.0], 1),
    ]
    found = whitening.whitened(spark.createDataFrame(odd, VECTORS)).collect()
    two = [[0.5, 1.0], [1.5, -1.0], [0.5, 1.0], [0.0, 0.25]]
    want = plain_whitening(two)
    assert sorted((r.id is None, r.id or 0, r.component) for r in found) == sorted([(False, 1, 1), (False, 1, 1), (False, 1, 2), (False, 1, 2), (True, 0, 1), (True, 0, 2), (False, 7, 1), (False, 7, 2), (False, 8, 1), (False, 9, 1), (False, 9, 2), (False, 9, 3)])
    for r in found:
        if r.id in (8, 9):  # one vector of its length: no variance
            assert (r.n, r.deviation, r.whitened, r.explained, r.identity_error) == (1, 0, None, None, None)
        else:
            i = {None: 1, 1: 0, 7: 3}[r.id]
            assert (r.n, r.deviation) == want[i, r.component][:2] and abs(abs(r.whitened) - abs(want[i, r.component][2])) < 1e-9
    assert whitening.whitened(spark.createDataFrame([], VECTORS)).collect() == []
    line = spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(5)], "vec_id long, embedding array<double>")
    found = whitening.whitened(line).collect()  # rank one of two dimensions
    assert {(r.component, r.whitened is None) for r in found} == {(1, False), (2, True)} and {r.explained for r in found if r.component == 2} == {0.0} or max(r.explained for r in found if r.component == 2) < 1e-12


def plain_top(rows, is_query, k=5):
    ok = [(i, np.floor(256 * np.array(v, float)).astype(np.int64)) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    out = []
    for i, q in ok:
        if is_query(i):
            scored = sorted(((-int(v @ q), j is None, j or 0) for j, v in ok if j != i and len(v) == len(q)))[:k]
            out += [(i, n, None if none else j, -s) for n, (s, none, j) in enumerate(scored, 1)]
    return sorted(out, key=repr)


def test_top_k_equals_a_plain_version(spark):
    e = spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()
    found = sorted((tuple(r) for r in topk.op12_fagin(spark, FOLDER).collect()), key=repr)
    assert found == plain_top([(r.vec_id, r.embedding) for r in e], lambda i: i % 50 == 0)


def test_top_k_in_many_blocks_and_groups(spark):
    draw = np.random.default_rng(5)
    rows = [(i, draw.normal(size=4).round(1).tolist()) for i in range(300)]
    rows += [(300 + i, [0.5, 0.5, -0.5, 0.0]) for i in range(100)]  # a third are one vector: ties everywhere
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "id x asks number block part key q floor n")
    found = topk.top(df, df.vec_id % 3 == 0, block=40, group=25)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == plain_top(rows, lambda i: i % 3 == 0)


def test_top_k_on_odd_rows(spark):
    odd = [
        (0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [None, 1.0]), (4, [NAN, 0.0]), (5, [-INF, 0.0]), (50, [0.0, 0.0]), (None, [0.5, 0.5]),
        (100, [1.0]), (7, [0.25, 0.0]), (8, []), (150, [1e9, 1e9]), (9, [2.0, 2.0]),
    ]
    found = topk.top(spark.createDataFrame(odd, "vec_id long, embedding array<double>"), _multiple())
    assert sorted((tuple(r) for r in found.collect()), key=repr) == plain_top(odd, lambda i: i is not None and i % 50 == 0)
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert topk.top(empty, _multiple()).collect() == []
    twice = spark.createDataFrame([(0, [1.0]), (0, [1.0]), (1, [2.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk.top(twice, _multiple()).collect())) == [(0, 1, 1, 131072)] * 2 + [(0, 2, 1, 131072)] * 2


def _multiple():
    from pyspark.sql import functions as F

    return F.col("vec_id") % 50 == 0


def test_reading_ends_early(spark):
    draw = np.random.default_rng(1)
    x = np.floor(draw.normal(size=(5000, 3)) * 20).astype(np.int64)
    lists = topk.Lists(x, np.arange(5000))
    for q in (np.array([3, -2, 1]), np.array([0, 5, 0]), np.zeros(3, np.int64)):
        rows, scores, places = lists.top(q, np.zeros(5000, bool), 5, None)
        best = np.lexsort((np.arange(5000), -(x @ q)))[:5]
        assert rows.tolist() == best.tolist() and scores.tolist() == (x @ q)[best].tolist()
        assert places < 2500 or not q.any()
    rows, _, places = lists.top(np.array([3, -2, 1]), np.zeros(5000, bool), 5, 10**9)
    assert not len(rows) and not places  # a floor that nothing reaches


def plain_trie(rows, rebuild=True):
    own = defaultdict(list)
    key = lambda r, x: hashlib.sha256(f"{len(r)}:{r}{x}".encode()).digest()[:16]
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, key(r or "", x or ""), r or "", x or ""))
    own = {c: [v[3:] for v in sorted(vs)] for c, vs in own.items()}
    seqs = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4 if rebuild else 0
        seqs[c] = own.get(c - c % 20, [])[:h] + own[c][h:]
    members, kids, leaves, saved, out = defaultdict(list), defaultdict(set), {}, {}, []
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    for p in members:
        if p:
            kids[p[:-1]].add(p)
    for p in sorted(members, key=len, reverse=True):
        w = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = (len(members[p]) - 1) * w + sum(saved[k] for k in kids[p])
        ends = ",".join(str(c) for c in sorted(members[p]) if len(seqs[c]) == len(p))
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


COLUMNS = "conv_id long, turn long, role string, text string"


def found_trie(df, **how):
    return sorted((tuple(r) for r in trie.prefix_trie(df, **how).collect()), key=repr)


def test_trie_equals_a_plain_version(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in trie.op13_trie(spark, FOLDER).collect()), key=repr) == plain_trie(rows)


@pytest.mark.parametrize(("block", "fan", "n"), [(1, 2, 40), (3, 2, 80), (4, 3, 1), (50, 64, 150)])
def test_trie_in_blocks_of_any_size(spark, block, fan, n):
    draw = random.Random(block)
    rows = [(c, t, draw.choice(["u", None, ""]), draw.choice(["a", "a b", None])) for c in draw.sample(range(900), n) for t in range(draw.randint(1, 6))]
    rows += [(1000 + i, t, "u", f"same {t}") for i in range(n // 3) for t in range(4)]  # a third of all are equal
    df = clashing(spark.createDataFrame(rows, COLUMNS), "rank key keys n v block pos least l r depth w")
    assert found_trie(df, block=block, fan=fan) == plain_trie(rows)


def test_trie_on_odd_rows(spark):
    odd = [
        (20, 0, "u", "one two"), (20, 1, "a", None), (20, None, None, "first"), (20, None, None, "first"), (21, 0, "u", "x"), (None, 3, "u", "no one"),
        (22, 5, "ab", "c"), (23, 5, "a", "bc"), (-7, 0, "u", "x"), (41, 1, "u", ""), (41, 1, "u", "tie"), (43, 0, "u", "word " * 20_000),
    ]
    assert found_trie(spark.createDataFrame(odd, COLUMNS), block=2, fan=2) == _negative(odd)
    assert found_trie(spark.createDataFrame([], COLUMNS)) == []
    alone = [(5, 0, None, None)]
    assert found_trie(spark.createDataFrame(alone, COLUMNS), rebuild=False) == plain_trie(alone, rebuild=False)
    deep = [(c, t, "u", "w") for c, n in ((1, 300), (2, 299), (3, 300), (4, 1)) for t in range(n)]
    assert found_trie(spark.createDataFrame(deep, COLUMNS), rebuild=False, block=2, fan=2) == plain_trie(deep, rebuild=False)


def _negative(rows):
    """A remainder of a negative id is Spark's and SQL's, not Python's."""
    shift = [(None if c is None else c if c >= 0 else c, t, r, x) for c, t, r, x in rows]
    own = {c for c, *_ in rows if c is not None}
    assert all(c >= 0 or -(-c // 20) * -20 not in own and (c % -20 == c) for c in own)
    return plain_trie(shift)


def test_ids_are_hashed_piece_by_piece(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 3)
    rows = [(i, 0, "u", "same") for i in range(50)] + [(60, 0, "u", "other")]
    assert found_trie(spark.createDataFrame(rows, COLUMNS), rebuild=False, block=5, fan=2) == plain_trie(rows, rebuild=False)
