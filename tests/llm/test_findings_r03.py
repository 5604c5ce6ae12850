"""What the findings of round 3 say of the training-data operators."""

import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from skein.llm import bpe, common, components, simhash, whitening


def test_joins_of_links_and_components_pass_by_the_driver(spark, monkeypatch):
    """No table becomes a broadcast, however small it looks."""
    plans, cut = [], components.cut

    def seen(df):
        df.collect()
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    monkeypatch.setattr(components, "cut", seen)
    fps = spark.range(200).selectExpr("id AS node", "id * 3 AS f0")
    found = simhash.links(fps)
    assert found.count()
    found.collect()
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert components.components(found).count()
    assert len(plans) > 3 and not any("Broadcast" in p for p in plans)


def crowd(spark, n, monkeypatch, part):
    """Rows that agree in the one sample, unlike but for a chain of pairs in places of its order."""
    rng = np.random.default_rng(9)
    monkeypatch.setattr(simhash, "PART", part)
    monkeypatch.setattr(simhash, "SHARE", 4)
    sample = np.random.default_rng(1).choice(192, simhash.BITS, replace=False)
    free = np.setdiff1d(np.arange(192), sample)
    bits = rng.integers(0, 2, (n, 192), np.uint8)
    bits[:, sample] = bits[0, sample]
    for k in range(1, 30):
        bits[k] = bits[k - 1]
        bits[k, rng.choice(free, 30, replace=False)] ^= 1
    rows = [(i, *x) for i, x in enumerate(np.packbits(bits, axis=1).view("<i8").tolist())]
    df = spark.createDataFrame(rows, "node long, f0 long, f1 long, f2 long")
    found = simhash.alike(df, 32, n, samples=1).collect()
    away = (bits[:, None, :] != bits[None, :, :]).sum(axis=2)
    assert all(away[r.a, r.b] <= 32 and r.a != r.b for r in found)
    a, b = np.nonzero((away <= 32) & ~np.eye(n, dtype=bool))
    roots = [dict(zip(*(x.tolist() for x in components.forest(np.array(p), np.array(q))), strict=True)) for p, q in ((a, b), ([r.a for r in found], [r.b for r in found]))]
    assert roots[0] == roots[1] and len(found) <= 3 * n
    assert set(range(30)) <= set(roots[0])


def test_a_bucket_compares_all_its_pairs(spark, monkeypatch):
    crowd(spark, 300, monkeypatch, 1 << 20)


def test_a_hot_bucket_compares_pairs_across_its_parts(spark, monkeypatch):
    crowd(spark, 700, monkeypatch, 16)


def test_spanning_edges_join_as_all_do():
    rng = np.random.default_rng(3)
    for n, m in ((1, 0), (50, 30), (200, 5000), (2000, 1500)):
        a, b = rng.integers(0, n, (2, m))
        kept = simhash._spanning(a, b, n)
        for x, y in ((a, b), (a[kept], b[kept])):
            keep = x != y
            got = components.forest(x[keep], y[keep])
            want = got if x is a else want
            assert all(np.array_equal(p, q) for p, q in zip(got, want, strict=True))
        assert len(kept) == len(want[0]) - len(np.unique(want[1]))


def test_whitening_has_small_plans(spark):
    """Expressions as many as the products filled the driver's memory with generated code."""
    draw = np.random.default_rng(7)
    rows = [(i, v.tolist()) for i, v in enumerate(draw.normal(size=(100, 64)))]
    found = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    code = found._jdf.queryExecution().debug().codegenToSeq()
    assert sum(len(code.apply(k)._2()) for k in range(code.size())) < 60_000


@pytest.fixture
def traced():
    tracemalloc.start()
    yield tracemalloc.get_traced_memory
    tracemalloc.stop()


def test_a_worker_holds_a_small_vocabulary(traced):
    """Four workers of an executor hold one each."""
    v = bpe.Vocabulary(public_tokenizers.path(bpe.RANKS))
    assert v.merge([b"tokens"]) and traced()[0] < 27e6


def test_tokens_of_many_texts_are_made_in_bounded_memory(traced):
    v = bpe.vocabulary(public_tokenizers.path(bpe.RANKS))
    texts = ["one two three, four " * 500] * 100
    v.encode(texts[:1])
    before = traced()[0]
    tracemalloc.reset_peak()
    ids = v.encode(iter(texts))
    assert len(ids) == 100 and len(set(ids)) == 1 and traced()[1] - before < 25e6


def test_parts_hold_every_text_in_order():
    texts = ["a" * n for n in (0, 5, bpe.PART, bpe.PART + 1, 1, 2, bpe.PART - 3, 1, 0)]
    found = list(bpe.parts(texts))
    assert [x for part in found for x in part] == texts
    assert [len(part) for part in found] == [2, 1, 1, 3, 2] and not list(bpe.parts([]))


def test_long_slices_merge_as_short_ones_do():
    v = bpe.vocabulary(public_tokenizers.path(bpe.RANKS))
    rng = np.random.default_rng(3)
    pieces = [bytes(rng.choice(list(b"aeinrst h\xc3\xa9."), n).tolist()) for n in (1, 2, 90, 500)]
    assert [v.merge_long(x) for x in pieces] == v.merge(pieces)


def test_a_task_gives_its_memory_back(spark):
    """The pool's memory goes back when a task's batches end."""

    class Pool:
        def release_unused(self):
            given.append(1)

    given = []

    class Rows:
        sparkSession = spark

        def mapInArrow(self, run, schema):
            return run

    batch = pa.RecordBatch.from_pydict({"x": [1]})
    run = common.arrow_batches(Rows(), lambda batches: batches, "x long")
    with pytest.MonkeyPatch.context() as m:
        m.setattr(pa, "default_memory_pool", Pool)
        rows = run(iter([batch, batch]))
        assert next(rows) is batch and not given
        assert list(rows) == [batch] and given == [1]
