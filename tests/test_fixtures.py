"""Small schemas and partitions with values worked out by hand or by direct pair counts."""

import itertools
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators import clustering as C
from skein.operators import ensemble as E
from skein.operators import graph as G
from skein.operators import metrics as M
from skein.operators import roles as R
from skein.operators import similarity as S
from skein.operators import tables_etl as Z
from skein.operators import triplets as X
from skein.plans import systems as Y
from skein.sources import catalog as K
from skein.sources import files

TRUTH = {"user": 0, "profile": 0, "address": 0, "product": 1, "category": 1, "like": 2, "purchase": 2, "log": 3}
FOUND = {"user": 0, "profile": 0, "address": 1, "product": 1, "category": 1, "like": 2, "purchase": 0, "log": 2}


def frame(spark, mapping):
    return spark.createDataFrame(list(mapping.items()), "table_name string, cluster_id int")


def values(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


@pytest.fixture(scope="module")
def mini(spark):
    c = K.mini(spark)
    return c, c.tables(), c.foreign_keys(), G.edges(c.foreign_keys())


def test_graph_figures(mini):
    _, tables, _, g = mini
    assert values(G.degree(tables, g), "table_name", "degree") == {"user": 4, "product": 3, "like": 2, "purchase": 2, "profile": 1, "address": 1, "category": 1, "log": 0}
    b = values(G.betweenness(tables, g), "table_name", "betweenness")
    assert b["user"] == pytest.approx(0.452381, abs=1e-6) and b["product"] == pytest.approx(0.261905, abs=1e-6) and b["like"] == pytest.approx(0.142857, abs=1e-6)
    p = values(G.pagerank(tables, g, iterations=200, tolerance=None), "table_name", "page_rank")
    assert p["user"] == pytest.approx(0.269357, abs=1e-6) and p["log"] == pytest.approx(0.020979, abs=1e-6)
    assert sum(p.values()) == pytest.approx(1)
    groups = values(G.components(tables, g), "table_name", "component")
    assert groups["log"] == "log" and len(set(groups.values())) == 2


def test_zscores(mini):
    _, tables, _, g = mini
    facts = G.degree(tables, g).join(G.pagerank(tables, g, iterations=200, tolerance=None), "table_name").join(G.betweenness(tables, g), "table_name")
    z = values(G.zscore_rank(facts, ["page_rank", "degree", "betweenness"]), "table_name", "z")
    assert z["user"] == pytest.approx(5.557337, abs=1e-5) and z["log"] == pytest.approx(-3.430078, abs=1e-5)


def test_roles(spark, mini):
    c, tables, keys, g = mini
    references = R.reference_tables(tables, keys)
    assert {r[0] for r in references.collect()} == {"like", "purchase"}
    facts = G.degree(tables, g).join(G.pagerank(tables, g), "table_name").join(G.betweenness(tables, g), "table_name")
    ranked = G.zscore_rank(facts, ["page_rank", "degree", "betweenness"])
    entities = R.entity_tables(ranked, references, G.neighbours(g))
    assert {r[0] for r in entities.collect()} == {"user", "product"}
    details = R.detail_tables(entities, references, keys, tables.select("table_name", "pk"))
    assert {tuple(r) for r in details.collect()} == {("user", "profile"), ("user", "address")}


def test_partition_measures(spark, mini):
    table = M.contingency(M.aligned(frame(spark, TRUTH), frame(spark, FOUND)), "t", "p")
    mi = M.mutual_information(table).first()
    assert mi["mutual_information"] == pytest.approx(0.670216, abs=1e-6)
    assert (mi["h_truth"], mi["h_found"]) == (pytest.approx(1.320888, abs=1e-6), pytest.approx(1.082196, abs=1e-6))
    assert M.expected_mutual_information(table).first()[0] == pytest.approx(0.536398, abs=1e-6)
    assert M.adjusted_mutual_information(table).first()[0] == pytest.approx(0.201186, abs=1e-6)
    assert M.rand_index(table).first()[0] == pytest.approx(0.714286, abs=1e-6)
    assert M.adjusted_rand_index(table).first()[0] == pytest.approx(0.157895, abs=1e-6)
    assert M.key_belonging(mini[2], frame(spark, TRUTH)).first()[0] == pytest.approx(3 / 7)
    assert G.link_quality(mini[3], frame(spark, TRUTH)).first()[0] == pytest.approx(-0.408163, abs=1e-6)


def test_rand_index_by_pairs(spark):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 4, 60), rng.integers(0, 5, 60)
    rows = spark.createDataFrame([(int(x), int(y)) for x, y in zip(a, b, strict=True)], "t int, p int")
    same = [(a[i] == a[j]) == (b[i] == b[j]) for i, j in itertools.combinations(range(60), 2)]
    assert M.rand_index(M.contingency(rows, "t", "p")).first()[0] == pytest.approx(np.mean(same))


def test_identical_partitions(spark):
    found = {k: 9 - v for k, v in TRUTH.items()}
    report = values(M.report(frame(spark, TRUTH), frame(spark, found)), "name", "value")
    assert report["ami"] == pytest.approx(1) and report["rand_index"] == 1 and report["adjusted_rand_index"] == 1
    assert report["output_clusters"] == 4 and report["groundtruth_max_size"] == 3


def test_alignment_and_repair(spark):
    short = frame(spark, {"user": 1})
    assert values(M.aligned(frame(spark, TRUTH), short), "table_name", "p")["log"] == 0
    with pytest.raises(Exception, match="not clustered"):
        M.aligned(frame(spark, TRUTH), short, strict=True).collect()
    with pytest.raises(Exception, match="not in the truth"):
        M.aligned(short, frame(spark, TRUTH)).collect()
    assert values(M.completed(frame(spark, TRUTH), short), "table_name", "cluster_id")["log"] == 2


def test_truth_levels():
    nested = {"x": ["A", "b"], "y": {"p": ["c"], "q": {"r": ["d"], "s": ["e"]}}}
    assert files.flatten_truth(nested) == {"x": ["a", "b"], "y": ["c", "d", "e"]}
    assert files.flatten_truth(nested, 1) == {"x": ["a", "b"], "y_p": ["c"], "y_q": ["d", "e"]}
    assert files.flatten_truth(nested, 9) == files.flatten_truth(nested, 2)
    assert files.depth(nested) == 3
    with pytest.raises(ValueError):
        files.flatten_truth({"x": ["a"], "y": ["A"]})


def test_cut_quality(spark):
    d = spark.createDataFrame([("a", "b", 1.0), ("a", "c", 10.0), ("b", "c", 9.0)], "a string, b string, d double")
    two, one = frame(spark, {"a": 0, "b": 0, "c": 1}), frame(spark, {"a": 0, "b": 0, "c": 0})
    assert M.cut_quality(two, d).first()[0] == pytest.approx(11.333333, abs=1e-6)
    assert M.cut_quality(one, d).first()[0] == pytest.approx(-1.888889, abs=1e-6)
    m = np.array([[0, 1, 10], [1, 0, 9], [10, 9, 0.0]])
    assert C.quality_of(np.array([0, 0, 1]), m) == pytest.approx(11.333333, abs=1e-6)
    assert list(C.linkage_labels(m, "single")) == [0, 0, 2]


def test_greedy_matching():
    assert S.greedy_mean(np.array([[0.9, 0.8], [0.85, 0.1], [0.2, 0.3]])) == pytest.approx(0.6)
    assert S.greedy_mean(np.zeros((0, 3))) == 0


def test_tfidf(spark):
    docs = spark.createDataFrame([("1", "user name"), ("2", "user id"), ("3", "product id")], "table_name string, doc string")
    sims = S.all_pairs(docs, S.term_cosine(S.tfidf(docs, T.identifier_tokens(F.col("doc")))))
    found = {(r.a, r.b): r.sim for r in sims.collect()}
    assert found["1", "2"] == pytest.approx(0.428046, abs=1e-6) and found["1", "3"] == 0


def test_text_functions(spark):
    one = spark.range(1)
    pick = lambda c: one.select(c).first()[0]
    assert pick(T.identifier_tokens(F.lit("customerAddressID_2"))) == ["customer", "address", "id"]
    assert pick(T.identifier_tokens(F.lit("ABCd"))) == ["ab", "cd"]
    assert tuple(pick(T.number_features(F.lit("12.50")))) == (2, 2, 1, 0)
    assert pick(T.tree_index(F.array(*map(F.lit, [0, -1, 5, 300])))) == [0, 384, 69, 384]
    assert tuple(pick(T.address_range(F.lit("A5:CB43")))) == (4, 42, 0, 79)
    assert [len(x.split()) for x in pick(T.snippets(F.lit(" ".join("w" * 23))))] == [10, 10, 3]
    assert pick(T.completion(F.lit("Description: a Description: b "))) == "b"
    assert pick(T.cell_label(F.lit("derived"))) == 5 and pick(T.cell_label(F.lit("?"))) == -1
    assert pick(T.clean_text(F.lit("a\tb\u0000中"))) == "a b 中 "
    assert pick(T.plain_number(F.lit("3,000.5"))) == ["3000.5"] and pick(T.plain_number(F.lit("1.2.3"))) == ["1", "2", "3"]
    assert pick(T.f1(F.lit(0.0), F.lit(0.0))) == 0


def test_edge_weights(spark):
    e = spark.createDataFrame([("a", "b", 0.0), ("b", "c", 0.0)], "src string, dst string, weight double")
    assert [r.weight for r in S.softmax_edges(e).collect()] == [0.5, 0.5]
    with pytest.raises(Exception, match="equal"):
        S.minmax_edges(e).collect()


def blobs():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.05, (6, 2)) for c in ((0, 0), (5, 0), (0, 5))])
    return [(f"t{i:02d}", [float(v) for v in row]) for i, row in enumerate(x)]


@pytest.mark.parametrize("method", ["affinity", "dbscan", "kmeans", "agglomerative", "spectral", "bisecting"])
def test_clusterings_find_blobs(spark, method):
    vectors = spark.createDataFrame(blobs(), "table_name string, embedding array<double>")
    found = values(Y.clustered(vectors, method, 3), "table_name", "cluster_id")
    groups = [{found[f"t{i:02d}"] for i in range(k, k + 6)} for k in (0, 6, 12)]
    assert all(len(g) == 1 for g in groups) and len(set.union(*groups)) == 3


def test_determine_k(spark):
    vectors = spark.createDataFrame(blobs(), "table_name string, embedding array<double>")
    assert C.determine_k(vectors, "agglomerative", most=5) == 3


def two_cliques(spark):
    pairs = [(a, b) for g in ("abcd", "wxyz") for a, b in itertools.combinations(g, 2)] + [("d", "w")]
    names = spark.createDataFrame([(c,) for c in "abcdwxyz"], "table_name string")
    return names, spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src string, dst string, weight double")


@pytest.mark.parametrize("f", [C.louvain, C.greedy_modularity, C.girvan_newman, C.link_clusters])
def test_communities_find_cliques(spark, f):
    found = values(f(*two_cliques(spark)), "table_name", "cluster_id")
    assert len({found[c] for c in "abcd"}) == 1 and len({found[c] for c in "wxyz"}) == 1 and found["a"] != found["z"]


def test_spectral_cut():
    adjacent = [{1, 2}, {0, 2}, {0, 1, 3}, {2, 4, 5}, {3, 5}, {3, 4}]
    assert C._fiedler_edge(adjacent) == (2, 3)


def test_label_propagation(spark):
    names, g = two_cliques(spark)
    apart = g.where("NOT (src = 'd' AND dst = 'w')")
    found = values(C.label_propagation(names, apart), "table_name", "cluster_id")
    assert len({found[c] for c in "abcd"}) == 1 and len({found[c] for c in "wxyz"}) == 1 and found["a"] != found["z"]


def test_ensembles(spark):
    names, _ = two_cliques(spark)
    labels = [frame(spark, {c: int(c > "d") for c in "abcdwxyz"})] * 2 + [frame(spark, {c: i for i, c in enumerate("abcdwxyz")})]
    sims = {(r.a, r.b): r.sim for r in E.co_association(names, labels).collect()}
    assert sims["a", "b"] == pytest.approx(2 / 3) and sims["a", "z"] == 0
    found = values(E.meta_linkage(names, labels), "table_name", "cluster_id")
    assert len({found[c] for c in "abcd"}) == 1 and found["a"] != found["z"]
    tree = E.grouped_tree(names, [({"kind": "x"}, lambda: labels[0]), ({"kind": "x"}, lambda: labels[1]), ({"kind": "y"}, lambda: labels[2])], ["kind"])
    assert tree.assignment().count() == 8


def test_triplets(spark, mini):
    c, tables, keys, g = mini
    near = G.neighbours(g)
    found = X.neighbour_triplets(tables, near, G.non_neighbours(tables, g), 3).collect()
    edges = {(r.table_name, r.neighbour) for r in near.collect()}
    assert all((t.anchor, t.positive) in edges or t.anchor == "log" for t in found) and all((t.anchor, t.negative) not in edges for t in found)
    assert sorted(map(tuple, X.random_triplets(tables).collect())) == sorted(map(tuple, X.random_triplets(tables.repartition(3)).collect()))
    purity = X.purity(X.truth_triplets(frame(spark, TRUTH)), frame(spark, TRUTH)).first()
    assert tuple(purity) == (1.0, 1.0)
    train, test = X.split(X.truth_triplets(frame(spark, TRUTH)))
    assert train.count() + test.count() == X.truth_triplets(frame(spark, TRUTH)).count()


def test_constrained_triplets(mini):
    ctx = Y.context(mini[0])
    ctx.floor = -1.0
    pairs = Y.training_pairs(ctx)
    found = X.constrained_triplets(pairs, S.column_minmax(ctx.sims)).collect()
    assert found and all(len({t.anchor, t.positive, t.negative}) == 3 for t in found)


def test_walk(spark):
    from skein.operators import importance as I

    m = spark.createDataFrame([("a", "b", 0.5), ("a", "a", 0.5), ("b", "a", 1.0)], "src string, dst string, p double")
    share = values(I.stationary(m, 500, 1e-9), "table_name", "share")
    assert share["a"] == pytest.approx(2 / 3, abs=1e-6) and sum(share.values()) == pytest.approx(1)


def test_entities_equal_a_greedy_pass(spark):
    draw = random.Random(6)
    names = [f"t{i:02}" for i in range(60)]
    edges = {frozenset(draw.sample(names, 2)) for _ in range(90)}
    near = [(a, b) for e in edges for a, b in (tuple(e), tuple(e)[::-1])] + [("t01", "t01")]
    position = {n: draw.randint(1, 40) for n in names}
    references = set(draw.sample(names, 8))
    taken, gone = set(), set()
    for n in sorted(names, key=lambda n: (position[n], n)):
        if n not in references and n not in gone and any(n in e for e in edges):
            taken.add(n)
            gone |= {m for e in edges if n in e for m in e}
    found = R.entity_tables(spark.createDataFrame(list(position.items()), "table_name string, position int"), spark.createDataFrame([(n,) for n in references], "table_name string"), spark.createDataFrame(near, "table_name string, neighbour string"))
    assert sorted(r.table_name for r in found.collect()) == sorted(taken)


def test_tokens(spark):
    vocab = {"[UNK]": 0, "[SEP]": 1, "[EMP]": 2, "un": 3, "##able": 4, "##a": 5, "[MASK]": 6, "[CLS]": 7}
    assert Z.cell_tokens("unable 7 12.5", vocab | {"7": 9, "[VAL]": 10}) == [("[SEP]", 1, *Z.NO_NUMBER), ("un", 3, *Z.NO_NUMBER), ("##able", 4, *Z.NO_NUMBER), ("7", 9, 1, 0, 7, 7), ("[VAL]", 10, 2, 1, 1, 5)]
    assert [t[0] for t in Z.cell_tokens("a " * 20, vocab)] == ["[SEP]"] + ["[UNK]"] * 7
    assert [t[0] for t in Z.cell_tokens("", vocab)] == ["[SEP]", "[EMP]"]
    cell = spark.createDataFrame([("t", 0, 0, "unable"), ("t", 0, 1, "12.5"), ("t", 1, 0, None)], "table_id string, row int, column int, value string")
    toks = Z.tokens(cell, vocab)
    assert Z.sequences(toks, vocab).first().tokens == [7, 1, 3, 4, 1, 0, 1, 2]
    hidden = Z.masked(toks, vocab, 1.0).where("label >= 0").collect()
    assert len(hidden) == 3 and all(r.id == 6 or 0 <= r.id < 8 for r in hidden)
    regions = spark.createDataFrame([("t", 0, 0, 0, 1)], "table_id string, row_from int, row_to int, column_from int, column_to int")
    merged = {(r.row, r.column): (r.first_row, r.first_column) for r in Z.merged_cells(cell, regions).collect()}
    assert merged[0, 1] == (0, 0) and merged[1, 0] == (1, 0)
    notes = spark.createDataFrame([("t", "A1:B1", "data")], "table_id string, address string, name string")
    assert {(r.row, r.column): r.label for r in Z.annotated(cell, notes).collect()} == {(0, 0): 2, (0, 1): 2, (1, 0): -1}


def test_files(spark, tmp_path):
    line = {"Title": "x", "ID": "1", "Texts": [["a", "b"], ["1", "2"]], "MergedRegions": [], "TopHeaderRowsNumber": 1, "LeftHeaderColumnsNumber": 0}
    (tmp_path / "t.json").write_text(json.dumps(line) + "\nnot json\n")
    assert files.read_table_lines(spark, str(tmp_path / "t.json")).first().Texts == [["a", "b"], ["1", "2"]]
    (tmp_path / "v.txt").write_text("x\ny\n")
    assert values(files.read_vocabulary(spark, str(tmp_path / "v.txt")), "token", "id") == {"x": 0, "y": 1}
    (tmp_path / "truth.yaml").write_text("clusters:\n  a: [X, y]\n  b: [z]\n")
    assert values(files.read_truth(spark, str(tmp_path / "truth.yaml")), "table_name", "label") == {"x": "a", "y": "a", "z": "b"}
    once = files.cached(spark.range(3).toDF("x"), str(tmp_path / "cache"), "k", 1)
    assert files.cached(spark.range(9).toDF("x"), str(tmp_path / "cache"), "k", 1).count() == once.count() == 3


def test_runner(spark, mini, tmp_path):
    ctx = Y.context(mini[0])
    report = values(Y.run(ctx, "communities", frame(spark, TRUTH), "mini", str(tmp_path)), "name", "value")
    assert 0 <= report["rand_index"] <= 1
    assert files.read_runs(spark, str(tmp_path)).where("system = 'communities'").count() == len(report)
