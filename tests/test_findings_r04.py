"""What the finding of round 4 says of table_sequences."""

import random

from pyspark.sql import functions as F

from skein.functions import text as T
from skein.functions import tokens as K
from skein.operators import sheets as H
from skein.operators import tables_etl as Z
from skein.plans import sheet_queries as Q

FOLDER = "/root/testdata/sf0.001"


def test_only_snippets_that_sequences_may_have_are_cut_into_tokens(spark, monkeypatch):
    frames, one = [], Z.kinds
    monkeypatch.setattr(Z, "kinds", lambda cell, *a: frames.append(cell) or one(cell, *a))
    found = Q.table_sequences(spark, FOLDER)
    pages, cells = 6, 4 * (150 + 6)
    assert sum(f.count() for f in frames) <= cells + pages * (1 + 2 * 4)
    # Cells and snippets go to Python once each, not once for every part of a sequence.
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 2
    assert found.count() == pages


def texts(spark, ids):
    draw = random.Random(4)
    rows = [(i, " ".join(draw.choice(["alpha", "beta", "x", "12"]) for _ in range(draw.choice([0, 5, 10, 11, 45, 200])))) for i in ids]
    return spark.createDataFrame([*rows, ("n0", None), ("n1", ""), ("n2", "  "), (None, "a b " * 30)], "table_id string, text string").repartition(5)


def snippets(df):
    return df.select("table_id", F.posexplode(T.snippets(F.col("text"))).alias("k", "value"))


def test_wanted_snippets_are_those_that_all_would_give(spark):
    df = texts(spark, [f"t{i}" for i in range(300)])
    tables = spark.createDataFrame([(f"t{i}",) for i in [*range(0, 300, 2), 4, 999]] + [("n0",), ("n1",), (None,)], "table_id string")
    every = snippets(df).select("table_id", "k", F.array(F.col("value")).alias("ids"))
    few = [r[0] for r in tables.distinct().collect()]
    want = {(r.table_id, 0, 0, r.ids[0]) for r in every.where("k = 0").collect() if r.table_id in few and r.table_id}
    pairs = {}
    for r in sorted(H.choices(every).collect(), key=lambda r: r.k):
        if r.table_id in few and len(pairs.setdefault(r.table_id, [])) < 4:
            pairs[r.table_id].append(r)
    for r in [r for rows in pairs.values() for r in rows]:
        want |= {(r.table_id, r.k, 1, r.ids[0]), (r.table_id, r.k, 0, r.other[0])}
    found = [tuple(r) for r in H.wanted_snippets(df, tables).collect()]
    assert len(found) == len(set(found)) and set(found) == want and len(want) > 300
    assert H.wanted_snippets(df, tables.where("false")).collect() == [] and H.wanted_snippets(df.where("false"), tables).collect() == []


def test_repeated_ids_and_rows(spark):
    """Two texts of one id, and equal rows: each has its first snippet; no snippet has one of its own table."""
    df = texts(spark, ["a", "a", *[f"t{i}" for i in range(40)]])
    df = df.union(df.where("table_id = 't3'"))
    found = sorted(map(tuple, H.wanted_snippets(df, df.select("table_id")).collect()), key=str)
    first = sorted((r.table_id, r.value) for r in snippets(df).where("k = 0 AND table_id IS NOT NULL").collect())
    assert sorted((r[0], r[3]) for r in found if r[1] == 0) == first
    rest = [r for r in found if r[1]]
    assert len({r[:3] for r in rest}) == len(rest) and len(rest) % 2 == 0 and len(rest) > 20
    assert found == sorted(map(tuple, H.wanted_snippets(df.repartition(3, "text"), df.select("table_id")).collect()), key=str)


def test_sequences_of_pairs_made_already(spark):
    vocabulary = {t: i for i, t in enumerate([Z.UNKNOWN, Z.SEPARATOR, Z.EMPTY, Z.MASK, Z.CLS, Z.VALUE, "alpha", "beta", "x"])}
    df = texts(spark, [f"t{i}" for i in range(40)])
    draw = random.Random(5)
    rows = [(f"t{t}", r, c, draw.choice(["alpha", "x beta", "12", "", None])) for t in range(0, 50, 3) for r in range(6) for c in range(4)]
    cell = H.marked(Z.kinds(spark.createDataFrame(rows, "table_id string, row int, column int, value string"), vocabulary), 1, 1).localCheckpoint()
    every = Z.kinds(snippets(df).select("table_id", F.col("k").alias("row"), F.lit(0).alias("column"), "value"), vocabulary, 20).select("table_id", F.col("row").alias("k"), "ids")
    few = Z.kinds(H.wanted_snippets(df, cell), vocabulary, 20).select("table_id", F.col("row").alias("k"), F.col("column").alias("truth"), "ids")
    for most in (40, 110, 512):
        want = sorted(map(tuple, H.assembled(cell, vocabulary, every, most).collect()))
        assert sorted(map(tuple, H.assembled(cell, vocabulary, few, most).collect())) == want
    assert len(want) == 17 and any(1 in r[-1] for r in want)


def test_ascii_texts_are_folded_at_once(monkeypatch):
    one, seen = K.folded, []
    texts = ["Ab 1,2.5", None, "", "A\x00B\x7fc\tD", "Été İ 日本", "a\u200bB", "x" * 30, "e\u0301 1.2.3", *[f"Name#{i} {i}.5" for i in range(200)]]
    want = [K.scanned([t]).to_pylist()[0] for t in texts]
    monkeypatch.setattr(K, "folded", lambda t: seen.append(t) or one(t))
    assert K.scanned(texts).to_pylist() == want and len(seen) == 3
    assert [x["token"] for x in want[3]] == ["abc", "d"] and [(x["start"], x["stop"]) for x in want[3]] == [(0, 5), (6, 7)]


def test_marks_without_the_cells_left_out(spark):
    draw = random.Random(6)
    rows = [(f"t{t}", r, c, draw.choice(["ab", "c d", "12", "a 7", "", None])) for t in range(30) for r in range(8) for c in range(5)]
    cell = Z.kinds(spark.createDataFrame(rows, "table_id string, row int, column int, value string"), Q.TOKENS).localCheckpoint()
    want = sorted(map(tuple, H.marked(cell, 1, 1).where(f"mark <> {H.LEFT_OUT}").collect()))
    assert sorted(map(tuple, H.marked(cell, 1, 1, left_out=False).collect())) == want and 0 < len(want) < len(rows)
