"""What the findings of round 3 say of the library."""

import numpy as np
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.functions import tokens as K
from skein.functions import vector as V
from skein.operators import metrics as M
from skein.operators import profile as P
from skein.operators import records as N
from skein.operators import sheets as H
from skein.operators import similarity as S
from skein.operators import tables_etl as Z
from skein.plans import sheet_queries as Q


def test_snippets_split_a_text_once(spark):
    """A text of many words in time: one split of it takes milliseconds."""
    import time

    df = spark.range(1).select(F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(200_000)), lambda i: F.concat(F.lit("w"), i))).alias("t")).localCheckpoint()
    began = time.time()
    found = df.select(T.snippets(F.col("t")).alias("s")).select(F.size("s").alias("n"), F.get("s", F.lit(19_999)).alias("last")).first()
    assert found.n == 20_000 and found.last == " ".join(f"w{i}" for i in range(199_991, 200_001))
    assert time.time() - began < 60
    odd = spark.createDataFrame([(None,), ("",), ("  ",), (" a  b ",)], "t string")
    assert [r[0] for r in odd.select(T.snippets(F.col("t"))).collect()] == [[], [], [], ["a b"]]


def test_tokens_are_scanned_in_bounded_passes(monkeypatch):
    sizes, one = [], K._scanned
    monkeypatch.setattr(K, "PASS", 50)
    monkeypatch.setattr(K, "_scanned", lambda texts: sizes.append(sum(len(t or "") for t in texts)) or one(texts))
    texts = ["Alpha 1,234.5 beta", None, "", "x" * 120, *[f"word {i} of 日本 1.2.3" for i in range(40)]]
    assert K.scanned(texts).to_pylist() == [one([t]).to_pylist()[0] for t in texts] and len(sizes) > 10
    assert all(n <= 50 or n == 120 for n in sizes) and K.scanned([]).to_pylist() == []


def test_kinds_of_cells_without_a_row_a_token(spark):
    texts = ["customer 12", "7,5 8", "", None, "zz?", "日本 name", "key", "3", " " * 4, "Customer#000000001 x " * 9]
    rows = [("t", k // 4, k % 4, x) for k, x in enumerate(texts)]
    cell = spark.createDataFrame(rows, "table_id string, row int, column int, value string").repartition(3)
    for most in (1, 8, 20):
        want = sorted(map(tuple, H.cell_kinds(Z.tokens(cell, Q.TOKENS, most)).collect()))
        found = Z.kinds(cell, Q.TOKENS, most)
        assert sorted(map(tuple, found.collect())) == want and len(want) == len(texts)


def test_each_vector_goes_to_a_bounded_number_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(S, "SMALL", 4)
    monkeypatch.setattr(S, "BLOCK", 500)
    for n in (200, 1000):
        rows = spark.range(n).selectExpr("id", "array(float(id), 1.0f) AS embedding")
        assert S._blocks(rows, "id", "embedding", []).count() == 2 * n * S.BLOCKS


def test_distances_by_products():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(40, 8)) + 1000, rng.normal(size=(50, 8)) + 1000
    y[:10], y[10:20] = x[:10], x[10:20] + 1e-9
    want = np.sqrt(((x[:, None] - y[None]) ** 2).sum(axis=2))
    assert np.abs(S.distances(x, y) - want).max() < 1e-9 and (S.distances(x, x).diagonal() == 0).all()


def test_blocks_give_what_one_block_gives(spark, monkeypatch):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(60, 5)).astype(np.float32)
    v[50:] = v[:10]
    rows = spark.createDataFrame([(i, [float(c) for c in x], i % 3) for i, x in enumerate(v)], "id long, embedding array<float>, label int")
    one = [sorted(map(tuple, S.nearest(rows, "id").collect())), M.silhouette(rows, "id", "label").first()[0]]
    monkeypatch.setattr(S, "SMALL", 7)
    assert sorted(map(tuple, S.nearest(rows, "id").collect())) == one[0]
    assert abs(M.silhouette(rows, "id", "label").first()[0] - one[1]) < 1e-12


def test_entropies_count_hashes_of_a_fixed_size(spark):
    rows = [(i % 4, float(i % 2), "x" * 50 + str(i % 8), None, i % 3 == 0) for i in range(24)]
    df = spark.createDataFrame(rows, "a int, b double, c string, d string, `e.f` boolean")
    found = P.column_entropy(df, "t")
    share = {r.column_name: round(r.entropy, 9) for r in found.collect()}
    assert share == {"a": 2.0, "b": 1.0, "c": 3.0, "e.f": round(np.log2(3) - 2 / 3, 9)}
    assert "cast(a" not in found._jdf.queryExecution().analyzed().toString().lower()


def test_the_norm_of_a_vector_is_taken_once(spark):
    """20,000 entries in time: one norm takes milliseconds, one for every entry minutes."""
    import time

    v = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(20_000)), lambda i: i.cast("double")).alias("v")).localCheckpoint()
    began = time.time()
    found = np.array(v.select(V.l2_normalized(F.col("v"))).first()[0])
    assert time.time() - began < 10 and abs(np.linalg.norm(found) - 1) < 1e-12 and np.allclose(found[-1] / found[0], 20_000)
    odd = spark.createDataFrame([([0.0, 0.0],), (None,), ([],)], "v array<double>")
    assert [r[0] for r in odd.select(V.l2_normalized(F.col("v"))).collect()] == [[0.0, 0.0], None, []]


def test_dense_vectors_of_entries(spark):
    rows = [([(0, 1.5), (3, -2.0)],), ([],), (None,), ([(4, 1.0)],)]
    df = spark.createDataFrame(rows, "e array<struct<slot: int, x: double>>")
    assert [r[0] for r in df.select(V.dense(F.col("e"), 5)).collect()] == [[1.5, 0, 0, -2.0, 0], [0.0] * 5, [0.0] * 5, [0, 0, 0, 0, 1.0]]


def test_representative_records_of_plain_groups(spark):
    """A row of each group, whole; equal rows count once, rows without words have a vector of zeros."""
    words = ["alpha beta gamma", "delta epsilon zeta", "eta theta iota"]
    rows = [(f"{words[i % 3]}", f"{words[i % 3]} w{i % 30}") for i in range(90)]
    df = spark.createDataFrame(rows, "`x` string, c string")
    found = N.representative(df, 3).collect()
    assert len(found) == 3 and {r.x for r in found} == set(words) and all((r.x, r.c) in rows for r in found)
    few = spark.createDataFrame([("b", 1), ("a", 2)], "x string, c int")
    assert [tuple(r) for r in N.representative(few, 3).collect()] == [("a", 2), ("b", 1)]


def test_attention_of_a_long_sequence(spark, monkeypatch):
    """3,000 tokens, 9 million distances in time: paths are compared once each, not once a pair."""
    import time

    monkeypatch.setattr(H, "PAIRS", 1 << 18, raising=False)
    path = lambda a, b: F.array(F.lit(-1), F.lit(-1), a.cast("int"), b.cast("int"))
    tokens = spark.range(3000).select(F.lit(7).alias("table_id"), F.col("id").cast("int").alias("place"), F.col("id").cast("int").alias("indicator"), path(F.col("id") % 7, F.col("id") % 3), path(F.col("id") % 5, F.lit(-1)))
    tokens = tokens.toDF("table_id", "place", "indicator", "top", "left").localCheckpoint()
    began = time.time()
    found = H.attention(tokens).select("place", F.size("distances").alias("n"), F.get("distances", F.lit(1)).alias("d"), F.md5(F.array_join("distances", " "))).orderBy("place").collect()
    assert time.time() - began < 15 and [r.place for r in found] == list(range(3000)) and {r.n for r in found} == {3000}
    far = [max(2 * (i % 7 != 1) + 2 * (i % 3 != 1), 2 * (i % 5 != 1)) + 100 * (i == 0) for i in range(3000)]
    assert [r.d for r in found] == [f * (1 if i % 2 else 101) for i, f in enumerate(far)]
    odd = spark.createDataFrame([(None, 1, None, None, [0, 0, 0, 0]), (None, 0, -1, [0, 0, 0, 0], None), (None, 2, 3, [1, 0, 0, 0], [1, 0, 0, 0])], "table_id int, place int, indicator int, top array<int>, left array<int>")
    for both, want in (("max", [[0, 0, 0], [0, 0, 202], [0, 202, 0]]), ("add", [[0, 0, 0], [0, None, None], [0, None, 0]])):
        assert [(r.table_id, r.place, r.distances) for r in H.attention(odd, both).orderBy("place").collect()] == [(None, k, want[k]) for k in range(3)]
