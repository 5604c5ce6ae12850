"""The prefix trie of conversations, as a Cartesian tree over their sorted order.

A turn becomes 16 bytes of a SHA-256 digest, a conversation the sequence of its digests; texts go
no further. Conversations are sorted by sequence and numbered by offsets of their ranges; one join
gives each the length of the prefix it shares with the one before it (its LCP). The array of LCPs,
with each conversation's own length between its two, is a Cartesian tree of all shared prefixes: a
node of height l is a maximal stretch of entries at least l, so it lies between the nearest smaller
entry on either side.

These are found in blocks of consecutive conversations, in parallel. A block answers what it can
by itself, and finishes the nodes that lie within it. What remains open depends on its minima
alone: the entries smaller than all before them, or than all after them, in the block. They, with
sums and minima of the conversations between them, are a far shorter array of the same kind, whose
blocks are answered in the same way, until one is left. Entries of equal height in one stretch are
one node. A node whose parent is more than one turn shorter stands for several, which are then
made one by one; there are never more of them than turns.

Sums over a node's subtree come from its stretch: of conversations, of the words that each shares
with the one before it, and of conversations that the one before them is a prefix of.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import dropped, partitions, stored, table, word_count

#: Conversations of a block, and blocks that are joined to one on each further level.
BLOCK, FAN = 4_096, 64
#: Every conversation takes its first turns from the one whose id is the last multiple of FAMILY;
#: how many of them, fewer than SHARED, its id's checksum says. Fixed values.
FAMILY, SHARED = 20, 4
#: Digest of no bytes.
NOTHING = hashlib.sha256(b"").hexdigest()
#: Ids that are hashed as one piece.
PIECE = 4_096

ELEMENT = "block long, pos long, v int, own_words long, own_ends long, least long, words long, ends long"
OUT = ELEMENT + ", kind string, l long, r long, up int, parent long, ask long"


def digest(role: Column, text: Column) -> Column:
    """16 bytes of the turn; the role's length stands before it, so no two turns read alike."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 32))


def sequences(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's (digest, words) in order of turn, null first; equal
    turns in order of their digest. Turns without a conv_id belong to none."""
    item = F.struct(F.col("turn").isNotNull().alias("late"), "turn", digest(F.col("role"), F.col("text")).alias("d"), word_count(F.coalesce(F.col("text"), F.lit(""))).alias("w"))
    each = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), item.alias("item"))
    both = each.groupBy("conv_id").agg(F.sort_array(F.collect_list("item")).alias("all"))
    return both.select("conv_id", F.transform("all", lambda x: F.struct(x["d"].alias("d"), x["w"].alias("w"))).alias("turns"))


def rebuilt(own: DataFrame) -> DataFrame:
    """``own`` (conv_id, turns) with each conversation's first turns taken from the first
    conversation of its family. A family has ``FAMILY`` ids, so no row meets more."""
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(SHARED)).cast("int")
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    bases = own.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, SHARED - 1).alias("first"))
    both = own.withColumns({"h": h, "base": base}).join(bases, "base", "left")
    head = F.slice(F.coalesce("first", F.slice("turns", 1, 0)), F.lit(1), F.col("h"))
    return both.select("conv_id", F.concat(head, F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))


def ranked(convs: DataFrame) -> DataFrame:
    """(rank, conv_id, keys, w): conversations numbered from 0 in order of their digests ``keys``,
    equal ones by id; ``w`` has each turn's words. Ranges end within equal conversations too."""
    keys = F.transform("turns", lambda t: t["d"]).alias("keys")
    ordered = convs.select("conv_id", keys, F.transform("turns", lambda t: t["w"]).alias("w"))
    ordered = ordered.repartitionByRange(partitions(ordered), "keys", "conv_id").sortWithinPartitions("keys", "conv_id")
    place = F.monotonically_increasing_id()
    rows = stored(ordered.select(place.alias("place"), "conv_id", "keys", "w"))
    part = F.shiftright("place", 33)
    # A row for each partition, whose number the session bounds.
    sizes = rows.groupBy(part.alias("part")).count().withColumn("base", F.sum("count").over(Window.orderBy("part")) - F.col("count"))
    rank = (F.col("base") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))).alias("rank")
    return rows.withColumn("part", part).join(F.broadcast(sizes.drop("count")), "part").select(rank, "conv_id", "keys", "w")


def shared(rows: DataFrame) -> DataFrame:
    """(rank, conv_id, n, lcp, same, words): with the conversation before it each shares ``lcp``
    turns of ``words`` words (-1 for the first); ``same`` is 1 if that one is a prefix of it."""
    before = rows.select((F.col("rank") + 1).alias("rank"), F.col("keys").alias("last"))
    both = rows.join(before, "rank", "left")
    least = F.least(F.size("keys"), F.size("last"))
    differ = F.array_position(F.zip_with(F.slice("keys", F.lit(1), least), F.slice("last", F.lit(1), least), lambda a, b: a == b), False)
    lcp = F.when(F.col("last").isNull(), -1).when(differ == 0, least).otherwise(differ - 1).cast("int")
    with_lcp = both.select("rank", "conv_id", F.size("keys").alias("n"), lcp.alias("lcp"), F.size("last").alias("m"), "w")
    words = F.aggregate(F.slice("w", F.lit(1), F.greatest(F.col("lcp"), F.lit(0))), F.lit(0).cast("long"), lambda a, w: a + w)
    return with_lcp.select("rank", "conv_id", "n", "lcp", F.coalesce((F.col("lcp") == F.col("m")).cast("long"), F.lit(0)).alias("same"), words.alias("words"))


def nearest_smaller(v: np.ndarray) -> np.ndarray:
    """For each entry the place of the nearest smaller one before it; -1 without one."""
    out = np.full(len(v), -1, np.int64)
    stack: list[int] = []
    for i, x in enumerate(v.tolist()):
        while stack and v[stack[-1]] >= x:
            stack.pop()
        if stack:
            out[i] = stack[-1]
        stack.append(i)
    return out


class _Least:
    """Minima of any stretch, by minima of stretches of powers of two."""

    def __init__(self, x: np.ndarray):
        self.rows = [x]
        while 2 << (len(self.rows) - 1) <= len(x):
            last, half = self.rows[-1], 1 << (len(self.rows) - 1)
            self.rows.append(np.minimum(last[:-half], last[half:]))

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        k = np.frexp((hi - lo).astype(np.float64))[1] - 1
        out = np.empty(len(lo), np.int64)
        for j in np.unique(k):
            at = k == j
            out[at] = np.minimum(self.rows[j][lo[at]], self.rows[j][hi[at] - (1 << j)])
        return out


def block_of(pos, v, own_words, own_ends, least, words, ends) -> tuple[dict, dict, dict]:
    """One block of entries in order. ``own_*`` belong to an entry, ``least``, ``words`` and
    ``ends`` to it and all that it stands for up to the next one. Returns

    * nodes: those that lie within the block (``l`` and ``r`` are the entries at their ends, both
      smaller), with sums over the stretch from l to r less what belongs to l itself; the
      parent's height ``up``; and its left end in ``parent``, or an entry of the parent in
      ``ask`` if the next level has to say;
    * places: for each entry its node's left end, or the entry to ``ask`` for it;
    * rest: the entries that are smaller than all before them, or than all after them.
    """
    n = len(v)
    left = nearest_smaller(v)
    right = n - 1 - nearest_smaller(v[::-1])[::-1]
    right[right == n] = n  # n: none
    # Open to the left: the first entry of that height stands for all of them in the block.
    first: dict[int, int] = {}
    for i in np.flatnonzero(left < 0).tolist():
        first.setdefault(int(v[i]), i)
    ask = np.full(n, -1, np.int64)
    open_left = np.flatnonzero(left < 0)
    ask[open_left] = pos[[first[int(x)] for x in v[open_left]]] if len(open_left) else []
    starts = np.where(left >= 0, pos[left], -1)

    inside = np.flatnonzero((left >= 0) & (right < n))
    key = left[inside] * (int(v.max()) + 2) + v[inside]
    node = inside[np.unique(key, return_index=True)[1]]
    lo, hi = left[node], right[node]
    total = lambda own, x: np.concatenate([[0], np.cumsum(x)])[hi] - np.concatenate([[0], np.cumsum(x)])[lo] - own[lo]
    at = np.where(v[lo] >= v[hi], lo, hi)
    nodes = {
        "pos": pos[node], "v": v[node], "least": _Least(least).of(lo, hi) if len(node) else np.zeros(0, np.int64), "words": total(own_words, words),
        "ends": total(own_ends, ends), "l": pos[lo], "r": pos[hi], "up": v[at], "parent": starts[at], "ask": np.where(starts[at] < 0, ask[at], -1),
    }
    smallest = np.minimum.accumulate(v)
    kept = np.concatenate([[True], v[1:] < smallest[:-1]])
    later = np.minimum.accumulate(v[::-1])[::-1]
    kept |= np.concatenate([v[:-1] < later[1:], [True]])
    r = np.flatnonzero(kept)
    rest = {
        "pos": pos[r], "v": v[r], "own_words": own_words[r], "own_ends": own_ends[r],
        "least": np.minimum.reduceat(least, r), "words": np.add.reduceat(words, r), "ends": np.add.reduceat(ends, r),
    }
    return nodes, {"pos": pos, "v": v, "parent": starts, "ask": ask}, rest


def _answered(entries: DataFrame) -> DataFrame:
    """``block_of`` for each block of ``entries``: rows of kind node, place and rest."""
    names = [c.split(" ")[0] for c in OUT.split(", ")]
    kinds = [pa.string() if "string" in c else pa.int32() if c.endswith(" int") else pa.int64() for c in OUT.split(", ")]
    schema = pa.schema(list(zip(names, kinds, strict=True)))
    absent = {"parent": -1, "ask": -1}

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("pos")
        block = t["block"][0].as_py()
        columns = [t[c].to_numpy() for c in ("pos", "v", "own_words", "own_ends", "least", "words", "ends")]
        parts = []
        for kind, rows in zip(("node", "place", "rest"), block_of(*columns), strict=True):
            n = len(rows["pos"])
            rows = rows | {"block": np.full(n, block), "kind": [kind] * n}
            arrays = []
            for c, k in zip(names, kinds, strict=True):
                x = rows.get(c)
                if x is None:
                    arrays.append(pa.nulls(n, k))
                elif c in absent:
                    arrays.append(pa.array(x, k, mask=np.asarray(x) == absent[c]))
                else:
                    arrays.append(pa.array(x, k))
            parts.append(pa.Table.from_arrays(arrays, schema=schema))
        return pa.concat_tables(parts)

    return entries.groupBy("block").applyInArrow(run, OUT)


def tree(entries: DataFrame, blocks: int, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """(nodes, places) of the Cartesian tree over ``entries`` in ``blocks`` blocks. Nodes have
    their left end in ``l``, their height in ``v``, and those of their parent in ``parent`` and
    ``up`` (null and -1 at the top)."""
    answered = stored(_answered(entries))
    of = lambda kind, *columns: answered.where(F.col("kind") == kind).select(*columns)
    columns = ["v", "l", "r", "least", "words", "ends", "up", "parent", "ask"]
    nodes, places = of("node", *columns), of("place", "pos", "parent", "ask")
    if blocks > 1:
        rest = of("rest", (F.floor(F.col("block") / fan)).cast("long").alias("block"), *[c.split(" ")[0] for c in ELEMENT.split(", ")][1:])
        upper, above = tree(rest, -(-blocks // fan), fan)
        # At most FAN * BLOCK entries ask for one place, as they lie in one block.
        above = above.select(F.col("pos").alias("ask"), F.col("parent").alias("found"))
        told = lambda df, *c: df.join(above, "ask", "left").select(*c, F.coalesce("parent", "found").alias("parent"))
        return told(nodes, *columns[:7]).union(upper), told(places, "pos")
    return nodes.drop("ask"), places.drop("ask")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of the ids of each key, whose pieces come one after another and in order."""

    def out(rows: list[tuple]) -> pa.RecordBatch:
        arrays = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.string()))]
        return pa.RecordBatch.from_arrays(arrays, ["rank", "depth", "ends_sha256"])

    now, first, depth, state = None, None, None, None
    for b in batches:
        done: list[tuple] = []
        for key, start, turns, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if key == now:
                state.update(b"," + ids.encode())
                continue
            if state is not None:
                done.append((first, depth, state.hexdigest()))
            now, first, depth, state = key, start, turns, hashlib.sha256(ids.encode())
        yield out(done)
    if state is not None:
        yield out([(first, depth, state.hexdigest())])


def ends(rows: DataFrame) -> DataFrame:
    """(rank, depth, ends_sha256): for each group of equal conversations, by its first rank and
    its number of turns, the digest of their ids in ascending order. Ids are joined in pieces of ``PIECE`` ranks, by any task; a
    group's pieces then stream through one hash, as SHA-256 takes its input in order."""
    key = F.unhex(F.sha2(F.aggregate("keys", F.lit(b""), lambda a, k: F.concat(a, k)), 256)).alias("key")
    each = rows.select(key, F.size("keys").alias("depth"), "rank", F.floor(F.col("rank") / PIECE).alias("piece"), F.struct("rank", "conv_id").alias("id"))
    pieces = each.groupBy("key", "depth", "piece").agg(F.min("rank").alias("start"), F.sort_array(F.collect_list("id")).alias("ids"))
    joined = pieces.select("key", "start", "depth", F.array_join(F.transform("ids", lambda x: x["conv_id"].cast("string")), ",").alias("ids"))
    dealt = joined.repartition(partitions(rows), "key").sortWithinPartitions("key", "start")
    return dealt.mapInArrow(_hashed, "rank long, depth int, ends_sha256 string")


def prefix_trie(turns: DataFrame, rebuild: bool = True, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """A row for each distinct sequence of first turns (role, text) of the conversations in
    ``turns`` (conv_id, turn, role, text): conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256. conv_id is the node's smallest member, n_convs the conversations
    that begin with it, n_children the nodes one turn longer, n_leaves the childless nodes of its
    subtree, itself included, saved_tokens the words that its subtree needs only once, and
    ends_sha256 the digest of the ids of those that end at it. ``rebuild`` first gives each
    conversation the first turns of its family's.

    A null role or text counts as empty, a null turn comes first, and turns of one number in one
    conversation come in order of their digests; a row that repeats is a turn that repeats. Turns
    with a null conv_id belong to no conversation. An empty text has no words. A conversation left
    without turns is a member of the root. Conversations may be equal, in any number. An empty
    table has no node. conv_id is an integer; other columns aren't looked at. A conversation is
    one row of 16 bytes a turn, so its turns, not their texts, must fit into a task.
    """
    convs = stored(sequences(turns))  # read twice where conversations are rebuilt
    rows = ranked(rebuilt(convs) if rebuild else convs)
    dropped(convs)
    total = rows.count()
    pairs = stored(shared(rows))
    zero, none = F.lit(0).cast("long"), F.lit((1 << 63) - 1).cast("long")
    # Entry 2r is the LCP of conversation r with the one before it, entry 2r + 1 its own length.
    lcp = F.struct((F.col("rank") * 2).alias("pos"), F.col("lcp").alias("v"), F.col("words").alias("own_words"), F.col("same").alias("own_ends"), none.alias("least"), "words", F.col("same").alias("ends"))
    own = F.struct((F.col("rank") * 2 + 1).alias("pos"), F.col("n").alias("v"), zero.alias("own_words"), zero.alias("own_ends"), F.col("conv_id").alias("least"), zero.alias("words"), zero.alias("ends"))
    last = F.struct((F.col("rank") * 2 + 2).alias("pos"), F.lit(-1).alias("v"), zero.alias("own_words"), zero.alias("own_ends"), none.alias("least"), zero.alias("words"), zero.alias("ends"))
    each = F.when(F.col("rank") == total - 1, F.array(lcp, own, last)).otherwise(F.array(lcp, own))
    entries = pairs.select(F.floor(F.col("rank") / block).cast("long").alias("block"), F.explode(each).alias("e")).select("block", "e.*")
    nodes, _ = tree(entries, max(1, -(-total // block)), fan)
    nodes = stored(nodes)

    # Parents by their left end and height, and how many children point at them.
    key = nodes.select(F.col("l").alias("parent"), F.col("v").alias("up"), F.col("least").alias("up_least"))
    children = nodes.where("up >= 0").groupBy(F.col("parent").alias("l"), F.col("up").alias("v")).agg(F.count("*").alias("n_children"))
    full = nodes.join(key, ["parent", "up"], "left").join(children, ["l", "v"], "left")
    rank = (F.col("l") / 2).cast("long")
    full = full.select(rank.alias("rank"), "v", "up", "least", "up_least", F.coalesce("n_children", zero).alias("n_children"), ((F.col("r") - F.col("l")) / 2).cast("long").alias("n"), "words", "ends")
    deep = full.withColumn("depth", F.explode(F.sequence(F.col("up") + 1, F.col("v"))))

    # Words before each turn of a conversation, for the node whose first member it is.
    before = rows.select("rank", "conv_id", F.posexplode(F.concat(F.array(F.lit(0).cast("long")), "w")).alias("depth", "word"))
    running = Window.partitionBy("rank").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("rank", "depth", F.coalesce(F.sum("word").over(running), zero).alias("before"))
    out = deep.join(before, ["rank", "depth"]).join(ends(rows), ["rank", "depth"], "left")
    inner = F.col("depth") < F.col("v")
    parent = F.when(F.col("depth") > F.col("up") + 1, F.col("least")).otherwise(F.col("up_least"))
    return out.select(
        F.col("least").alias("conv_id"), F.col("depth").cast("long").alias("depth"), parent.alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.when(inner, F.lit(1)).otherwise(F.col("n_children")).cast("long").alias("n_children"), (F.col("n") - F.col("ends")).alias("n_leaves"),
        (F.col("words") - (F.col("n") - 1) * F.col("before")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"),
    )


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))
