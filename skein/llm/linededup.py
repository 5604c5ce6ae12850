"""Line deduplication by content-defined chunks of lines, with DataFrame operations only.

Lines without a word are left out of account. A rolling hash over the hashes of a line and its
predecessor is taken at every line; a boundary lies where it is no larger than one of its two
neighbours. That depends on nearby lines alone, so an insertion shifts no boundary beyond them,
and of any three lines in a row that two texts share, one boundary at least is the same in both.
The two lines at a boundary are the seed of a chunk, and so is a line of ``long_line`` words or
more. Seeds that occur more than once in all documents are compared with the first occurrence
(smallest doc_id, then place), and widened line by line to both sides as long as the lines are
equal to those around the first. Neighbouring boundaries are two lines apart at most, so two
lines on either side reach the next seed and longer chunks arise from several. All chunks found
are removed, so the first occurrence alone stays.

Up to here lines are known by their hashes, which are all that is shuffled; then the bytes of
the lines to be removed and of their first occurrences are compared: a hash that stands for
several texts removes none of them. A repeat of three lines or more, or of one line of
``long_line`` words, is always found whole; one of two short lines only where a boundary falls
between them in both texts (about half).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT, SALTS, cut, dropped, packed, salted_join, stored, table, unpacked, word_count

REACH = 2
WORD = r"[^\x20\x09-\x0D]"


@dataclass(frozen=True)
class Chunking:
    """``bits``: of the lines' hashes that are used (fewer only in tests of what collides)."""

    long_line: int = 40
    bits: int = 64


def _split(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _worded(text: Column) -> Column:
    """The lines that have a word: (x, i), the line and its number."""
    every = F.transform(_split(text), lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    return F.filter(every, lambda p: p["x"].rlike(WORD))


def _hash(line: Column, how: Chunking) -> Column:
    return F.shiftright(F.xxhash64(line), 64 - how.bits)


def hashed(docs: DataFrame, how: Chunking) -> DataFrame:
    """(doc_id, _doc, _h, _long): for the lines that have a word their hashes, and whether they
    are long; ``_doc`` is a hash of id and text."""
    df = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("_doc"), F.transform(_worded(F.col("text")), lambda p: p["x"]).alias("_lines"))
    long = lambda x: (F.length(x) >= 2 * how.long_line - 1) & (word_count(x) >= how.long_line)
    return df.select("doc_id", "_doc", F.transform("_lines", lambda x: _hash(x, how)).alias("_h"), F.transform("_lines", long).alias("_long"))


def seeds(lines: DataFrame) -> DataFrame:
    """(_doc, hash, lo, hi): the seeds of all documents, as places among their lines."""
    # Named twice in each step, so that no array is computed anew for every element.
    pairs = F.transform("_h", lambda x, k: F.when(k > 0, F.xxhash64(F.get("_h", k - 1), x)))
    df = lines.withColumn("_r", pairs)

    def boundary(r: Column, k: Column) -> Column:
        before, after = F.get("_r", k - 1), F.get("_r", k + 1)
        lowest = (r <= before) | (r <= after) | (before.isNull() & after.isNull())
        return F.when(F.coalesce(lowest, F.lit(False)), F.struct(r.alias("hash"), (k - 1).alias("lo"), (k + 1).alias("hi")))

    def alone(long: Column, k: Column) -> Column:
        return F.when(long & (F.size("_h") > 0), F.struct(F.xxhash64(F.get("_h", k)).alias("hash"), k.alias("lo"), (k + 1).alias("hi")))

    found = F.array_compact(F.concat(F.transform("_r", boundary), F.transform("_long", alone)))
    # Outer, as Spark would infer a filter from an inner one and compute all steps within it.
    each = df.select("_doc", F.explode_outer(found).alias("s")).where("s IS NOT NULL")
    return each.select("_doc", "s.*")


def _alike(a: Column, b: Column) -> Column:
    """How many leading elements two arrays share."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    end = F.array_position(same, F.lit(False))
    return F.when(end > 0, end - 1).otherwise(F.size(same)).cast("int")


def matches(docs: DataFrame, how: Chunking) -> DataFrame:
    """(doc_id, hash, cuts, firsts): by equal hashes, the chunks (lo, hi) that a document should
    lose and those that it has as the first; ``hash`` is that of id and text."""
    lines = stored(hashed(docs, how))
    each = seeds(lines)
    # A seed that occurs once needs nothing more: documents are told which of theirs repeat.
    twice = cut(each.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1"))
    total = twice.agg(F.sum("n")).first()[0] or 0
    mine = salted_join(each, twice, ["hash"], twice, "n", total, F.col("_doc"))
    mine = mine.groupBy(F.col("_doc").alias("_key")).agg(F.collect_set(F.struct("hash", "n", "lo", "hi")).alias("_again"))
    known = lines.join(mine.hint("merge"), F.col("_doc") == F.col("_key"))

    def context(s: Column) -> Column:
        h = F.col("_h")
        return F.struct(
            s["hash"].alias("hash"), s["n"].alias("n"), s["lo"].alias("lo"), s["hi"].alias("hi"),
            F.slice(h, s["lo"] + 1, s["hi"] - s["lo"]).alias("seed"),
            F.reverse(F.slice(h, F.greatest(s["lo"] - REACH, F.lit(0)) + 1, F.least(s["lo"], F.lit(REACH)))).alias("before"),
            F.slice(h, s["hi"] + 1, F.lit(REACH)).alias("after"),
        )

    around = F.explode_outer(F.transform("_again", context)).alias("s")
    again = stored(known.select("doc_id", "_doc", around).where("s IS NOT NULL").select("doc_id", "_doc", "s.*"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_doc", "lo")
    firsts = again.groupBy("hash", "seed").agg(
        F.min(place).alias("first"), F.min_by(F.struct("before", "after"), place).alias("around"), F.count("*").alias("k"), F.max("n").alias("n")
    )
    # The places of a seed that occurs very often are dealt over several tasks.
    salts = F.when(F.col("n") > HOT, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    firsts = firsts.where("k > 1").select("hash", "seed", "first", "around", F.explode(salts).alias("salt"))
    salted = again.withColumn("salt", F.when(F.col("n") > HOT, F.pmod("_doc", F.lit(SALTS))).otherwise(0).cast("int"))
    gone = salted.join(firsts, ["hash", "seed", "salt"]).where(place != F.col("first"))
    up, down = _alike(F.col("before"), F.col("around.before")), _alike(F.col("after"), F.col("around.after"))
    size = F.col("hi") - F.col("lo")

    def chunk(lo: Column) -> Column:
        return F.struct((lo - F.col("up")).alias("lo"), (lo + size + F.col("down")).alias("hi"))

    gone = gone.withColumn("up", up).withColumn("down", down)
    own = gone.select("doc_id", "_doc", chunk(F.col("lo")).alias("c"), F.lit(None).alias("f"))
    first = gone.select("first.doc_id", "first._doc", F.lit(None).alias("c"), chunk(F.col("first.lo")).alias("f"))
    both = own.union(first).groupBy("doc_id", F.col("_doc").alias("hash"))
    found = stored(both.agg(F.collect_set("c").alias("cuts"), F.collect_set("f").alias("firsts")))
    dropped(lines)
    dropped(again)
    return found


def _numbers(chunks: str) -> Column:
    """The places of the lines in some chunks, each once."""
    return F.array_distinct(F.flatten(F.transform(chunks, lambda c: F.sequence(c["lo"], c["hi"] - 1))))


def _without(docs: DataFrame, found: DataFrame, kept_hashes: list[int], how: Chunking) -> DataFrame:
    """``deduplicated`` before bytes are compared, and ``_compare``: the lines that matter, with
    their hashes. Lines with one of ``kept_hashes`` are not removed."""
    gone = found.select(F.col("doc_id").alias("_id"), F.col("hash").alias("_hash"), F.col("cuts").alias("_cuts"), F.col("firsts").alias("_firsts"))
    df = packed(docs, "doc_id", "text", F.xxhash64("doc_id", "text").alias("_h"))
    # By a shuffle at any size, so that work grows in proportion.
    df = df.join(gone.hint("merge"), (F.col("_h") == F.col("_hash")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    hit = F.col("_cuts").isNotNull()
    df = df.withColumn("_all", F.when(hit, _split(F.col("text")))).withColumn("_worded", F.when(hit, _worded(F.col("text"))))
    line = lambda k: F.get("_worded", k)
    some = F.array_distinct(F.concat(_numbers("_cuts"), _numbers("_firsts")))
    compare = F.transform(some, lambda k: F.struct(_hash(line(k)["x"], how).alias("hash"), F.get("_worded", k + F.size("_all") * 0)["x"].alias("line")))
    # A chunk takes the lines without words between its lines along.
    span = F.transform("_cuts", lambda c: F.sequence(line(c["lo"])["i"], F.get("_worded", c["hi"] - 1)["i"]))
    out = F.array_distinct(F.flatten(span))
    if kept_hashes:
        keep = F.filter("_worded", lambda p: _hash(p["x"], how).isin(kept_hashes))
        out = F.array_except(out, F.transform(keep, lambda p: p["i"]))
    df = df.withColumn("_out", out)
    kept = F.array_except(F.sequence(F.lit(0), F.size("_all") - 1), "_out")

    def joined(numbers: Column) -> Column:
        return F.when(hit & (F.size("_all") > 0), F.array_join(F.transform(numbers, lambda i: F.get("_all", i)), "\n"))

    df = df.withColumn("_left", joined(kept)).withColumn("_lost", joined(F.col("_out")))
    cut_up = hit & (F.size("_out") > 0)
    new = {
        "text": F.when(cut_up, F.col("_left")).otherwise(F.col("text")),
        "n_removed_lines": F.when(hit, F.size("_out")).otherwise(0).cast("long"),
        "n_removed_words": word_count(F.col("_lost")),
    }
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(cut_up, F.length("_left")).otherwise(F.col("_row").getField("n_chars")).cast("long")
    columns = [c for c in docs.columns if c not in ("n_removed_lines", "n_removed_words")]
    return df.select(F.struct(*unpacked(columns, **new)).alias("_row"), F.when(hit, compare).alias("_compare"))


def deduplicated(docs: DataFrame, how: Chunking | None = None) -> DataFrame:
    """``docs`` with ``text`` freed of repeated chunks, and n_removed_lines, n_removed_words.

    A null text stays null, an empty one empty. A text that loses all its lines becomes empty.
    Lines without a word go with the chunk that they lie in, and stay elsewhere. Rows that
    repeat both id and text count as one document and get the same result; null ids come last.
    Texts and chunks of any size are compared whole. An empty table gives an empty result.
    ``n_chars``, if there is one, is set anew where lines were removed; columns called
    n_removed_lines or n_removed_words are replaced, others of any name stay as they are.
    """
    how = how or Chunking()
    found = matches(docs.select("doc_id", "text"), how)
    done = stored(_without(docs, found, [], how))
    # Each task sends one line a hash; where the least and the greatest differ, a hash lies.
    lines = done.select(F.explode_outer("_compare").alias("c")).where("c IS NOT NULL").select("c.*")
    lies = lines.groupBy("hash").agg(F.min("line").alias("a"), F.max("line").alias("b")).where("a <> b")
    lies = [r["hash"] for r in lies.select("hash").collect()]  # of 64 bits: none, in all likelihood
    if lies:
        done = _without(docs, found, lies, how)
    return done.select("_row.*")


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return deduplicated(docs)
