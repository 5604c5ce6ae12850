"""Training triplets (anchor, positive, negative) of tables.

All random choices order candidates by a seeded hash of the names, so they don't depend on how
rows are partitioned. ``sims`` is mirrored: (a, b, sim), a the anchor.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _draw(*columns: Column | str, seed: int = 43) -> Column:
    """A text to order candidates by, without order of its own; any SQL engine has it too."""
    named = [F.col(c) if isinstance(c, str) else c for c in columns]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in named]))


def _place(*columns: Column | str, n: Column, seed: int = 43) -> Column:
    """A number from 0 to n - 1, drawn by the columns."""
    return F.pmod(F.conv(F.substring(_draw(*columns, seed=seed), 1, 8), 16, 10).cast("long"), n)


def _first(df: DataFrame, by: list[str], *order: Column, n: int = 1) -> DataFrame:
    ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.where(F.col("_r") <= n).drop("_r")


def random_triplets(names: DataFrame, seed: int = 43) -> DataFrame:
    """One for each of ``names`` (table_name, ordinal from 0), with any positive and negative; they
    may equal the anchor. Places are drawn and joined, so no pairs are formed."""
    n = F.lit(max(1, names.count()))
    anchors = names.select(F.col("table_name").alias("anchor"))
    for role in ("positive", "negative"):
        other = names.select(F.col("table_name").alias(role), F.col("ordinal").cast("long").alias("_at"))
        anchors = anchors.withColumn("_at", _place("anchor", F.lit(role), n=n, seed=seed)).join(other, "_at").drop("_at")
    return anchors


def neighbour_triplets(names: DataFrame, neighbours: DataFrame, non_neighbours: DataFrame, k: int = 1, seed: int = 43) -> DataFrame:
    """A random neighbour (any table, if it has none) and a random table without an edge, ``k``
    times for each anchor. ``names``: (table_name, ordinal from 0)."""
    copies = F.explode(F.sequence(F.lit(1), F.lit(k)))
    lone = names.select(F.col("table_name").alias("anchor")).join(neighbours.select(F.col("table_name").alias("anchor")), "anchor", "left_anti")
    lone = lone.withColumn("k", copies).withColumn("_at", _place("anchor", "k", n=F.lit(max(1, names.count())), seed=seed))
    lone = lone.join(names.select(F.col("table_name").alias("c"), F.col("ordinal").cast("long").alias("_at")), "_at").select("anchor", "c", "k")
    near = neighbours.select(F.col("table_name").alias("anchor"), F.col("neighbour").alias("c")).withColumn("k", copies).unionByName(lone)
    p = _first(near, ["anchor", "k"], _draw("anchor", "c", "k", seed=seed)).withColumnRenamed("c", "positive")
    far = non_neighbours.select(F.col("table_name").alias("anchor"), F.col("other").alias("c")).where("anchor <> c")
    q = _first(far.withColumn("k", copies), ["anchor", "k"], _draw("anchor", "c", "k", F.lit("n"), seed=seed)).withColumnRenamed("c", "negative")
    return p.join(q, ["anchor", "k"]).select("anchor", "positive", "negative")


def most_similar(sims: DataFrame) -> DataFrame:
    """(anchor, positive, sim): the most similar other table."""
    best = _first(sims.where("a <> b"), ["a"], F.round("sim", 9).desc(), F.col("b"))
    return best.select(F.col("a").alias("anchor"), F.col("b").alias("positive"), "sim")


def similarity_triplets(sims: DataFrame, seed: int = 43) -> DataFrame:
    """The most similar table as positive, a random other as negative."""
    p = most_similar(sims).drop("sim")
    rest = sims.where("a <> b").select(F.col("a").alias("anchor"), F.col("b").alias("c")).join(p, "anchor").where("c <> positive")
    q = _first(rest, ["anchor"], _draw("anchor", "c", seed=seed))
    return q.select("anchor", "positive", F.col("c").alias("negative"))


def threshold_triplets(neighbours: DataFrame, sims: DataFrame, high: float = 0.7, low: float = 0.3, n: int = 10, seed: int = 43) -> DataFrame:
    """Neighbours above ``high`` with one of the ``n`` least similar others below ``low``."""
    near = neighbours.select(F.col("table_name").alias("a"), F.col("neighbour").alias("b"))
    p = near.join(sims, ["a", "b"]).where(F.col("sim") > high).select("a", F.col("b").alias("positive"))
    q = sims.where("a <> b").join(near, ["a", "b"], "left_anti").where(F.col("sim") < low)
    q = _first(q, ["a"], F.round("sim", 9), F.col("b"), n=n).select("a", F.col("b").alias("negative"))
    pairs = p.join(q, "a")
    return _first(pairs, ["a", "positive"], _draw("a", "positive", "negative", seed=seed)).select(F.col("a").alias("anchor"), "positive", "negative")


def truth_triplets(assignment: DataFrame, k: int = 4, seed: int = 43) -> DataFrame:
    """Every ordered pair of a cluster with ``k`` random tables of other clusters."""
    c = assignment.select("table_name", "cluster_id")
    p = c.select(F.col("table_name").alias("anchor"), "cluster_id").join(c.select(F.col("table_name").alias("positive"), "cluster_id"), "cluster_id").where("anchor <> positive")
    o = c.select(F.col("table_name").alias("negative"), F.col("cluster_id").alias("other"))
    pairs = p.join(o, F.col("cluster_id") != F.col("other"))
    picked = _first(pairs, ["anchor", "positive"], _draw("anchor", "positive", "negative", seed=seed), n=k)
    return picked.select("anchor", "positive", "negative")


def semi_hard_negatives(pairs: DataFrame, sims: DataFrame, margin: float = 0.3) -> DataFrame:
    """``pairs`` (anchor, positive) with the most similar table that is at least ``margin`` less
    similar than the positive, or else the least similar above the anchor's 25th percentile;
    pairs for which there is neither are left out."""
    s = sims.where("a <> b")
    p25 = s.groupBy("a").agg(F.percentile("sim", 0.25).alias("p25"))
    own = s.select(F.col("a").alias("anchor"), F.col("b").alias("positive"), F.col("sim").alias("near"))
    c = pairs.join(own, ["anchor", "positive"]).join(s.select(F.col("a").alias("anchor"), F.col("b").alias("c"), "sim"), "anchor").where("c <> positive")
    c = c.join(p25.withColumnRenamed("a", "anchor"), "anchor")
    hard = F.col("sim") < F.col("near") - margin
    order = F.when(hard, -F.round("sim", 9)).otherwise(F.round("sim", 9))
    best = _first(c.where(hard | (F.col("sim") > F.col("p25"))), ["anchor", "positive"], hard.desc(), order, F.col("c"))
    return best.select("anchor", "positive", F.col("c").alias("negative"))


def constrained_triplets(pairs: DataFrame, sims: DataFrame, margin: float = 0.3, once: bool = True) -> DataFrame:
    """As ``semi_hard_negatives``, in the order of ``pairs`` (position, anchor, positive): a
    table that was an anchor before is no negative any more (``once``), and an anchor doesn't
    get the same negative twice. The sequence is catalog-sized and runs in one group."""
    rows = pairs.select("position", "anchor", "positive").join(
        sims.where("a <> b").groupBy(F.col("a").alias("anchor")).agg(F.collect_list(F.struct("b", "sim")).alias("all")), "anchor"
    )

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        used: dict[str, set[str]] = {}
        out = []
        for r in pdf.sort_values(["position", "anchor", "positive"]).itertuples():
            s = {x["b"]: round(x["sim"], 9) for x in r.all}
            p25 = pd.Series(list(s.values())).quantile(0.25)
            free = [c for c in sorted(s) if c not in (r.anchor, r.positive) and not (once and c in used)]
            hard = [c for c in free if s[c] < s[r.positive] - margin and c not in used.get(r.anchor, ())]
            soft = [c for c in free if s[c] > p25]
            pick = max(hard, key=lambda c: (s[c], c)) if hard else min(soft, key=lambda c: (s[c], c)) if soft else None
            if pick is not None:
                used.setdefault(r.anchor, set()).add(pick)
                out.append((r.anchor, r.positive, pick))
        return pd.DataFrame(out, columns=["anchor", "positive", "negative"])

    return rows.groupBy().applyInPandas(run, "anchor string, positive string, negative string")


def low_similarity_triplets(pairs: DataFrame, sims: DataFrame, k: int = 5, seed: int = 43) -> DataFrame:
    """``pairs`` with one of the ``k`` least similar tables above the 25th percentile."""
    s = sims.where("a <> b")
    p25 = s.groupBy(F.col("a").alias("anchor")).agg(F.percentile("sim", 0.25).alias("p25"))
    c = pairs.join(s.select(F.col("a").alias("anchor"), F.col("b").alias("c"), "sim"), "anchor").where("c <> positive").join(p25, "anchor").where("sim > p25")
    low = _first(c, ["anchor", "positive"], F.round("sim", 9), F.col("c"), n=k)
    return _first(low, ["anchor", "positive"], _draw("anchor", "c", seed=seed)).select("anchor", "positive", F.col("c").alias("negative"))


def labelled_pairs(triplets: DataFrame) -> DataFrame:
    """(sentence1, sentence2, label): positives 1, negatives 0."""
    pairs = F.array(F.struct(F.col("positive").alias("s"), F.lit(1).alias("label")), F.struct(F.col("negative").alias("s"), F.lit(0).alias("label")))
    exploded = triplets.select("anchor", F.explode(pairs).alias("p"))
    return exploded.select(F.col("anchor").alias("sentence1"), F.col("p.s").alias("sentence2"), F.col("p.label").alias("label"))


def enriched(triplets: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Names replaced by descriptions (table_name, text)."""
    out = triplets
    for c in ("anchor", "positive", "negative"):
        d = descriptions.select(F.col("table_name").alias(c), F.col("text").alias(f"{c}_text"))
        out = out.join(d, c)
    return out.select(*[F.col(f"{c}_text").alias(c) for c in ("anchor", "positive", "negative")])


def purity(triplets: DataFrame, assignment: DataFrame) -> DataFrame:
    """(positive_purity, negative_purity): positives in the anchor's cluster, negatives not."""
    c = assignment.select("table_name", "cluster_id")
    out = triplets
    for k in ("anchor", "positive", "negative"):
        out = out.join(c.select(F.col("table_name").alias(k), F.col("cluster_id").alias(f"c_{k}")), k)
    share = lambda cond: F.avg(F.when(cond, 1.0).otherwise(0.0))
    return out.agg(share(F.col("c_anchor") == F.col("c_positive")).alias("positive_purity"), share(F.col("c_anchor") != F.col("c_negative")).alias("negative_purity"))


def split(triplets: DataFrame, parts: int = 10, seed: int = 43) -> tuple[DataFrame, DataFrame]:
    """Training and evaluation rows, one in ``parts`` for the latter, by hash."""
    part = _place(*triplets.columns, n=F.lit(parts), seed=seed)
    return triplets.where(part > 0), triplets.where(part == 0)
