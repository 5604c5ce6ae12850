"""SimHash near-duplicates by a grid over segment bit counts.

A fingerprint is cut in segments of two bits; the vector of their bit counts is an embedding
in which the Manhattan distance never exceeds the Hamming distance. A range join on each half
word (sixteen segments) of that vector sends both sides to the grid cells at distance one at
most from their own, and pairs that meet in a cell are verified by their exact Hamming distance.

Of 64-bit fingerprints that differ in four bits at most, one half differs in two at most, so the
two joins find every pair.

Documents of a given similarity need wider fingerprints and a wider limit: the share of differing
bits is the angle between the texts' shingle vectors over pi, so at a similarity of 0.8 some 15% of
all bits differ, and a half is as close as the grid asks in 15% of the pairs alone. There, pairs
meet by samples of bits instead: all fingerprints that agree in a sample are a bucket, and all pairs
of a bucket are compared by their exact distance, save those that the distances to its first member
decide. A bucket gives the links of a spanning forest, at most one a member. Samples are as many as
are needed for a pair at the limit to agree in one of them, by construction.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, pi

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MANY, arrow_map, cut, packed, partitions, salted_join, stored, table, unpacked
from .components import components, forest

BLOCK = 1 << 17
#: The pipeline's stage: shingles of five words, alike from a Jaccard similarity of 0.8 on. The
#: number of differing bits varies around what is expected, so ``SLACK`` standard deviations more
#: are let pass.
WIDTH, LONGS, SIMILARITY, SLACK = 5, 6, 0.8, 1.6
#: Samples and bits of each. A pair of similarity 0.8 agrees in a sample with a chance of 4.4%, so
#: in one at least with 94%; two unrelated ones do with 1 in 500,000. A corpus far beyond ten
#: million documents needs wider samples, and 18% more of them for each bit.
SAMPLES, BITS = 64, 19
#: Members of a salted part of a hot bucket, and the share of documents by which hot ones are told.
PART, SHARE = 2_048, 64
U = np.uint64


def mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th long of a shingle's hash: the hash itself, or a mix of it that looks unrelated."""
    if not k:
        return h
    x = h + U(k * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def fingerprint(text: bytes | None, width: int = 4, seed: int = 42, longs: int = 1) -> list[int]:
    """The SimHash of a text, 64 bits a long: ASCII case folded, ``width``-word shingles with
    repeats, XXH64; a bit is set if over half the hashes have it. No words (or null): 0."""
    words = (text or b"").lower().split()
    n = len(words)
    if not n:
        return [0] * longs
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    if n < width:
        starts, stops = [0], [len(joined)]
    else:
        starts = np.concatenate([[0], ends[:-1] + 1])[: n - width + 1].tolist()
        stops = ends[width - 1 :].tolist()
    ones = np.zeros((longs, 64), np.int64)
    for k in range(0, len(starts), BLOCK):
        h = np.array([digest(joined[a:b], seed) for a, b in zip(starts[k : k + BLOCK], stops[k : k + BLOCK], strict=True)], U)
        for i in range(longs):
            bits = np.unpackbits(mixed(h, i).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            ones[i] += bits.sum(axis=0, dtype=np.int64)
    packed_bits = np.packbits(ones * 2 > len(starts), axis=1)
    return [int.from_bytes(row.tobytes(), "big") for row in packed_bits]


def _names(longs: int) -> list[str]:
    return [f"f{i}" for i in range(longs)]


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, longs: int = 1
) -> DataFrame:
    """(id, key, f0, ...): the fingerprint of each whole text in signed longs, and a hash of id
    and text; rows are kept as they are."""
    names = _names(longs)

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(x.as_py(), width, longs=longs) for x in b.column(1)], U).view(np.int64)
        return pa.RecordBatch.from_arrays([b.column(0), b.column(2), *map(pa.array, fps.T.copy())], ["id", "key", *names])

    key = F.xxhash64(id_col, text_col).alias("key")
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("t"), key)
    return arrow_map(slim, batch, "id long, key long, " + ", ".join(f"{f} long" for f in names))


def _counts(fp: str, half: int) -> str:
    """Bit counts of one half's sixteen segments, two bits each, as SQL."""
    bits = f"(shiftrightunsigned({fp}, {32 * half}) & 4294967295L)"
    return f"((shiftrightunsigned({bits}, 1) & 1431655765L) + ({bits} & 1431655765L))"


def _cells(own: str) -> str:
    """Codes of the cells at Manhattan distance 1 at most from the bit counts ``own``, as SQL."""
    up = [f"CASE WHEN (shiftright({own}, {j}) & 3) < 2 THEN {own} + {1 << j}L END" for j in range(0, 32, 2)]
    down = [f"CASE WHEN (shiftright({own}, {j}) & 3) > 0 THEN {own} - {1 << j}L END" for j in range(0, 32, 2)]
    return f"array_compact(array({own}, {', '.join([*up, *down])}))"


def _distance(names: list[str]) -> str:
    return " + ".join(f"bit_count(a{f} ^ b{f})" for f in names)


def _spanning(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Which of the edges a-b between 0..n-1 to keep so that they join what all of them join: in
    rounds, each group's earliest edge to another."""
    label, kept = np.arange(n), []
    while True:
        x, y = label[a], label[b]
        live = np.flatnonzero(x != y)
        if not len(live):
            return np.sort(np.concatenate(kept)) if kept else live
        first = np.full(n, len(a))
        np.minimum.at(first, x[live], live)
        np.minimum.at(first, y[live], live)
        kept.append(np.unique(first[first < len(a)]))
        nodes, root = forest(x[kept[-1]], y[kept[-1]])
        new = np.arange(n)
        new[nodes] = root
        label = new[label]


def _within(w: np.ndarray, bits: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (places a, b) that join what all pairs within ``limit`` of whole buckets ``w`` join.

    Every pair is compared, except those that distances to the bucket's first row decide: two rows
    near it are joined by it, and two whose distances to it differ by more than the limit are
    further apart than that."""
    n = len(w)
    start = np.concatenate([[True], w[1:] != w[:-1]])
    first = np.maximum.accumulate(np.where(start, np.arange(n), 0))
    rank = np.arange(n) - first
    away = np.bitwise_count(bits ^ bits[first]).sum(axis=1, dtype=np.int64)
    near = away <= limit
    at = np.flatnonzero(near & (rank > 0))
    a, b, some = at, first[at], [(at[:0], at[:0])]
    at, lag = np.flatnonzero(rank > 0), 1
    while len(at) or len(some) > 1:
        other = at - lag
        maybe = ~(near[at] & near[other]) & (np.abs(away[at] - away[other]) <= limit)
        x, y = at[maybe], other[maybe]
        hit = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1) <= limit
        some.append((x[hit], y[hit]))
        lag += 1
        at = at[rank[at] >= lag]
        if not len(at) or sum(len(x) for x, _ in some) > BLOCK:
            a, b = (np.concatenate([k, *[x[side] for x in some]]) for side, k in enumerate((a, b)))
            kept, some = _spanning(a, b, n), [(at[:0], at[:0])]
            a, b = a[kept], b[kept]
    return a, b


def _whole(batches: Iterator[pa.RecordBatch], longs: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The sorted rows (w, node, f0, ...) of ``batches``, cut between buckets."""
    rest: list[tuple] = []
    joined = lambda: tuple(map(np.concatenate, zip(*rest, strict=True)))
    for batch in batches:
        if not batch.num_rows:
            continue
        w, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        bits = np.stack([batch.column(2 + i).to_numpy() for i in range(longs)], axis=1).view(U)
        other = np.flatnonzero(w != w[-1])
        k = int(other[-1]) + 1 if len(other) else 0
        if k or rest and rest[0][0][0] != w[0]:
            rest.append((w[:k], node[:k], bits[:k]))
            yield joined()
            rest = []
        rest.append((w[k:], node[k:], bits[k:]))
    if rest:
        yield joined()


def _compared(limit: int, longs: int):
    """Pairs within ``limit`` of the sorted rows (w, node, f0, ...) that join what all such pairs
    of a bucket ``w`` join; a bucket must fit in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w, node, bits in _whole(batches, longs):
            a, b = _within(w, bits, limit)
            yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], ["a", "b"])

    return run


def _crossed(limit: int, longs: int):
    """Pairs within ``limit`` of rows of different roots, one at least of each two roots: of the
    sorted rows (w, part, side, node, root, f0, ...) those of side 1 against all of side 0 of the
    same part, which come first and are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            w, part, side, node, root = (batch.column(i).to_numpy() for i in range(5))
            bits = np.stack([batch.column(5 + i).to_numpy() for i in range(longs)], axis=1).view(U)
            new = np.flatnonzero((w[1:] != w[:-1]) | (part[1:] != part[:-1]) | (side[1:] != side[:-1])) + 1
            for lo, hi in zip([0, *new.tolist()], [*new.tolist(), len(w)], strict=True):
                if (w[lo], part[lo]) != key:
                    key, held = (w[lo], part[lo]), []
                if not side[lo]:
                    held.append((node[lo:hi], root[lo:hi], bits[lo:hi]))
                    continue
                if not held:
                    continue
                held = [tuple(map(np.concatenate, zip(*held, strict=True)))]
                other, theirs, those = held[0]
                step = max(1, BLOCK // len(other))
                for k in range(lo, hi, step):
                    own = slice(k, min(hi, k + step))
                    near = np.bitwise_count(bits[own, None] ^ those[None]).sum(axis=2) <= limit
                    i, j = np.nonzero(near & (root[own, None] != theirs[None]))
                    _, one = np.unique(np.stack([root[own][i], theirs[j]]), axis=1, return_index=True)
                    if len(one):
                        yield pa.RecordBatch.from_arrays([pa.array(node[own][i[one]]), pa.array(other[j[one]])], ["a", "b"])

    return run


def alike(fps: DataFrame, limit: int, total: int, samples: int = SAMPLES, bits: int = BITS) -> DataFrame:
    """(a, b): pairs of ``fps`` (``total`` rows node, f0, ..., no two fingerprints equal) at
    Hamming distance ``limit`` or less that join whatever the pairs that meet in a bucket join;
    some come several times.

    A bucket that holds more than a thousandth of all is told from every 64th fingerprint, and
    split in parts by a hash; the first ones of its parts are a bucket of their own. So the list
    of hot buckets is bounded. What its parts leave apart is compared across them: the rows outside
    the bucket's largest group so far go to each part. A group of near copies, of any size, is one
    by then; only for texts that agree in a sample without being alike does this grow with the
    square of their number (over ``PART``).
    """
    names = [c for c in fps.columns if c != "node"]
    draw = np.random.default_rng(samples)

    def sample(i: int) -> str:
        chosen = np.zeros(64 * len(names), np.uint8)
        chosen[draw.choice(len(chosen), bits, replace=False)] = 1
        masks = np.packbits(chosen).view(np.int64).tolist()
        return f"xxhash64({i}, {', '.join(f'{f} & {m}L' for f, m in zip(names, masks, strict=True) if m)})"

    def compared(rows: DataFrame) -> DataFrame:
        rows = rows.select("w", "node", *names)
        return rows.repartition(partitions(rows), "w").sortWithinPartitions("w", *names).mapInArrow(_compared(limit, len(names)), "a long, b long")

    each = fps.selectExpr(f"explode(array({', '.join(map(sample, range(samples)))})) AS w", "node", *names)
    some = each.where(f"pmod(xxhash64({', '.join(names)}), {SHARE}) = 0").groupBy("w").count()
    hot = cut(some.where(F.col("count") > max(8, total // (MANY * SHARE))).select("w", F.expr(f"count * {SHARE} div {PART} + 1").alias("parts")))
    if not hot.limit(1).count():
        return compared(each)
    part = F.expr(f"pmod(xxhash64(0, {', '.join(names)}), parts)")
    dealt = each.join(F.broadcast(hot), "w", "left")
    crowd = dealt.where("parts IS NOT NULL").withColumn("part", part)
    least = F.min(F.struct(*names, "node")).alias("first")
    firsts = crowd.groupBy("w", "part").agg(least).select("w", "first.node", *[f"first.{f}" for f in names])
    split = dealt.withColumn("w", F.when(F.col("parts").isNull(), F.col("w")).otherwise(F.xxhash64("w", part)))
    found = cut(compared(split.select("w", "node", *names).union(firsts)))
    roots = components(found).withColumnRenamed("node", "_node")
    rooted = crowd.where("parts > 1").join(roots.hint("merge"), F.col("node") == F.col("_node"), "left")
    rooted = stored(rooted.select("w", "parts", "part", "node", F.coalesce("root", "node").alias("root"), *names))
    sizes = rooted.groupBy("w", "root").count().groupBy("w").agg(F.max_by("root", "count").alias("main"), F.count("*").alias("groups"))
    apart = cut(sizes.where("groups > 1").select("w", "main"))  # of hot buckets, so bounded
    if not apart.limit(1).count():
        return found
    left = rooted.join(F.broadcast(apart), "w")
    held = left.select("w", F.col("part").cast("long").alias("part"), F.lit(0).alias("side"), "node", "root", *names)
    sent = left.where("root <> main").select("w", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(1).alias("side"), "node", "root", *names)
    both = held.union(sent)
    both = both.repartition(partitions(both), "w", "part").sortWithinPartitions("w", "part", "side")
    return found.union(both.mapInArrow(_crossed(limit, len(names)), "a long, b long"))


def links(fps: DataFrame, limit: int = 4) -> DataFrame:
    """Pairs (a, b) of ``fps`` (node, f0, ...), a < b, at Hamming distance ``limit`` or less that
    are close in some half (a pair may come several times). Of one long and four bits: all.

    Such a pair differs in 2 bits at most in one half, so a cell lies within 1 of the counts of
    both. Where its counts are equal it is taken in their own cell, where they differ by 1 in the
    cell of a's counts, else in each cell between them (two at most). Of one long, it is taken
    in the low half if that differs in 2 bits at most; else the high half differs in one at most,
    and a needs no cell but its own there.
    """
    names = [c for c in fps.columns if c != "node"]
    fps = fps.repartition(partitions(fps), "node")
    single = len(names) == 1 and limit == 4
    found = None
    for half in range(2 * len(names)):
        f, side = names[half // 2], half % 2
        own = fps.selectExpr("node", *names, f"{_counts(f, side)} AS own")
        a, b = (
            own.selectExpr(f"{cells} AS cell", f"node AS {k}", *[f"{x} AS {k}{x}" for x in names])
            for k, cells in (("a", "own" if single and side else f"explode({_cells('own')})"), ("b", f"explode({_cells('own')})"))
        )
        own_a, own_b = _counts(f"a{f}", side), _counts(f"b{f}", side)
        verify = f"a < b AND {_distance(names)} <= {limit} AND ({own_a} = cell OR ({own_b} <> cell AND {own_a} <> {own_b}))"
        if single:
            verify += f" AND bit_count((a{f} ^ b{f}) & 4294967295L) {'>' if side else '<='} 2"
        pairs = a.join(b.hint("merge"), "cell").where(verify)  # no broadcast: it would be built on the driver.select("a", "b")
        found = pairs if found is None else found.union(pairs)
    return found


def limit_of(similarity: float, longs: int, slack: float = SLACK) -> int:
    """Differing bits that shingle vectors of this Jaccard similarity are expected to have, and
    ``slack`` standard deviations more."""
    n, share = 64 * longs, acos(2 * similarity / (1 + similarity)) / pi
    return int(n * share + slack * (n * share * (1 - share)) ** 0.5)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, longs: int = 1, limit: int = 4
) -> DataFrame:
    """(id, key, f0, ..., root, component_id), one row per row of ``docs``.

    ``component_id`` is the smallest id among the documents that links reach (links: ``limit``
    bits or fewer), ``root`` a number of that component. A null text counts as empty and has
    fingerprint 0, which links like any other; null ids are never chosen as a component's id,
    unless all are null. Ids are integers. Repeated rows come back as often as they came in.
    An empty table gives an empty result.
    """
    names = _names(longs)
    rows = stored(fingerprints(docs, id_col, text_col, width, longs))
    total = rows.count()
    # Equal fingerprints are one node; numbers are kept as written, so they are told only once.
    node = F.col("f0") if longs == 1 else F.monotonically_increasing_id()
    classes = rows.groupBy(*names).agg(F.min("id").alias("first"), F.count("*").alias("copies"))
    classes = cut(classes.withColumn("node", node))
    found = classes.select("node", *names)
    found = links(found, limit) if longs == 1 else alike(found, limit, classes.count())
    joined = components(found).withColumnRenamed("node", "member")
    rooted = classes.join(joined.hint("merge"), F.col("node") == F.col("member"), "left")
    rooted = cut(rooted.select(*names, "first", "copies", F.coalesce("root", "node").alias("root")))
    ids = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("kinds"))
    named = salted_join(rooted, ids, ["root"], ids, "kinds", total, F.xxhash64(*names))
    named = named.select(*names, "copies", "root", "component_id")
    return salted_join(rows, named, names, classes, "copies", total, F.col("key")).select("id", "key", *names, "root", "component_id")


def one_of_each(docs: DataFrame, width: int = WIDTH, longs: int = LONGS, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` (with doc_id, text) without all but one document of each near-duplicate group:
    the one with the smallest doc_id stays (null ids come last; of several texts with that id
    the one of least hash, of rows that repeat it one). Texts without a word are one group. An
    empty table gives an empty result; columns of any name stay."""
    found = near_duplicates(docs, width=width, longs=longs, limit=limit_of(similarity, longs))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("f")
    keep = found.groupBy("root").agg(first).select(F.col("f.key").alias("_key"))
    keyed = packed(docs, "doc_id", F.xxhash64("doc_id", "text").alias("_key"))
    # The join's partitioning serves the removal of repeated rows as well.
    kept = keyed.join(keep, "_key", "left_semi").dropDuplicates(["_key", "doc_id"])
    return kept.select(*unpacked(docs.columns))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"),
        "component_id",
    )
