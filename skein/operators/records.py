"""Representative records of a table, and projections for plots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vector as V
from ..functions.encoders import hashed_entries

SIZE = 256
ENTRIES = "array<struct<slot: int, x: double>>"


def record_documents(df: DataFrame) -> DataFrame:
    """(row_id, doc, record): each row's values as one text."""
    values = F.concat_ws(" ", *[F.col(f"`{c}`").cast("string") for c in df.columns])
    return df.select(F.xxhash64(*df.columns).alias("row_id"), values.alias("doc"), F.struct("*").alias("record"))


def _norm(entries: str) -> Column:
    return F.sqrt(F.aggregate(entries, F.lit(0.0), lambda a, e: a + e["x"] * e["x"]))


def representative(df: DataFrame, k: int = 5, seed: int = 0) -> DataFrame:
    """``k`` rows at most: TF-IDF of the rows' words, k-means, and of each cluster the row nearest
    to its centroid by cosine. Fewer than ``k`` rows, or rows without words: the first ``k`` in
    order."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import array_to_vector

    docs = record_documents(df).select("row_id", "doc").dropDuplicates(["row_id"])
    n, words = docs.agg(F.count("*"), F.sum(F.size(T.word_tokens(F.col("doc"))))).first()
    if n < k or not words:
        return df.orderBy(*df.columns).limit(k)
    # Rows have few of the slots: they are kept, clustered and compared as their entries.
    x = hashed_entries(docs, "row_id", T.word_tokens(F.col("doc")), SIZE).select("row_id", F.coalesce("entries", F.array().cast(ENTRIES)).alias("x"))
    unit = V.once(F.greatest(_norm("x"), F.lit(1e-10)), lambda n: F.transform("x", lambda e: F.struct(e["slot"].alias("slot"), (e["x"] / n).alias("x"))))
    x = x.select("row_id", unit.alias("x"))
    whole = x.withColumn("whole", array_to_vector(V.dense(F.col("x"), SIZE)))
    rows = VectorAssembler(inputCols=["whole"], outputCol="features").transform(whole).select("row_id", "x", "features").persist()
    model = KMeans(k=k, seed=seed).fit(rows)
    centres = df.sparkSession.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(model.clusterCenters())], "prediction int, c array<double>").withColumn("n", V.norm(F.col("c")))
    dot = F.aggregate("x", F.lit(0.0), lambda a, e: a + e["x"] * F.get("c", e["slot"]))
    s = F.round(F.try_divide(dot, _norm("x") * F.col("n")), 9)
    scored = model.transform(rows).join(F.broadcast(centres), "prediction").select("prediction", "row_id", s.alias("s"))
    best = scored.groupBy("prediction").agg(F.min(F.struct(F.isnull("s").alias("none"), (-F.col("s")).alias("away"), "row_id")).alias("best"))
    chosen = [r[0] for r in best.select("best.row_id").collect()]  # k at most
    rows.unpersist()
    return record_documents(df).where(F.col("row_id").isin(chosen)).dropDuplicates(["row_id"]).select("record.*")


def projected(vectors: DataFrame, key: str, vec: str = "embedding", dims: int = 2) -> DataFrame:
    """(key, x0, x1, ...): the first principal components, for plots."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = vectors.select(key, array_to_vector(V.doubles(F.col(vec))).alias("features"))
    out = PCA(k=dims, inputCol="features", outputCol="p").fit(rows).transform(rows).withColumn("p", vector_to_array("p"))
    return out.select(key, *[F.get("p", F.lit(i)).alias(f"x{i}") for i in range(dims)])
