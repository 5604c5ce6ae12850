"""Other sources and sinks: truth files, JSON lines, sheets, vocabularies, caches, run logs."""

from __future__ import annotations

import hashlib
import json
import time
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REGION = "array<struct<FirstRow: int, LastRow: int, FirstColumn: int, LastColumn: int>>"
TABLE_JSON = (
    "Title string, ID string, Texts array<array<string>>, MergedRegions " + REGION + ", TopHeaderRowsNumber int, "
    "LeftHeaderColumnsNumber int, Height int, Width int, TopTreeRoot variant, LeftTreeRoot variant"
)


def flatten_truth(clusters: dict[str, Any], level: int = 0) -> dict[str, list[str]]:
    """A nested ground truth as {label: tables}. At level 0 each top label owns every table under
    it; each further level splits labels by their sub-labels, joined by ``_``. Levels beyond
    the depth mean the deepest one. Names are lower-cased; a table twice is an error."""

    def tables(node: Any) -> list[str]:
        return [str(x).lower() for x in node] if isinstance(node, list) else [t for v in node.values() for t in tables(v)]

    def walk(label: str, node: Any, left: int) -> dict[str, list[str]]:
        if isinstance(node, list) or left == 0:
            return {label: tables(node)}
        return {k: v for sub, child in node.items() for k, v in walk(f"{label}_{sub}", child, left - 1).items()}

    out = {k: v for label, node in clusters.items() for k, v in walk(str(label), node, level).items()}
    every = [t for v in out.values() for t in v]
    if len(every) != len(set(every)):
        raise ValueError("a table is in two clusters")
    return out


def depth(clusters: Any) -> int:
    return 0 if isinstance(clusters, list) else 1 + max((depth(v) for v in clusters.values()), default=0)


def truth(spark: SparkSession, clusters: dict[str, Any], level: int = 0) -> DataFrame:
    """(table_name, cluster_id, label) of a ground truth."""
    flat = flatten_truth(clusters, level)
    rows = [(t, i, label) for i, (label, ts) in enumerate(flat.items()) for t in ts]
    return spark.createDataFrame(rows, "table_name string, cluster_id int, label string")


def read_truth(spark: SparkSession, path: str, level: int = 0) -> DataFrame:
    """A YAML ground truth from any store that Spark reads."""
    import yaml

    text = spark.read.text(path, wholetext=True).first()[0]
    return truth(spark, yaml.safe_load(text)["clusters"], level)


def read_table_lines(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines tables, one a line; lines that don't parse are dropped."""
    raw = spark.read.text(path)
    parsed = raw.select(F.from_json("value", TABLE_JSON, {"mode": "PERMISSIVE"}).alias("t"))
    return parsed.where("t.Texts IS NOT NULL").select("t.*")


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def read_script(spark: SparkSession, path: str) -> DataFrame:
    """Whole texts of DDL files."""
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "script")


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(token, id): one token a line, numbered from 0 in file order."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.posexplode(F.split(F.regexp_replace("value", "\n$", ""), "\n")).alias("id", "token"))


def table_lines(rows: DataFrame, title: str, n: int = 10, width: int = 20) -> DataFrame:
    """The table's first rows as one JSON line: header and cells, cut to ``width`` characters."""
    cells = F.array(*[F.substring(F.coalesce(F.col(c).cast("string"), F.lit("")), 1, width) for c in rows.columns])
    header = F.array(*[F.lit(c[:width]) for c in rows.columns])
    body = rows.orderBy(*rows.columns).limit(n).agg(F.array_sort(F.collect_list(cells)).alias("body"))
    texts = F.concat(F.array(header), F.col("body"))
    return body.select(
        F.to_json(
            F.struct(
                F.lit(title).alias("Title"),
                texts.alias("Texts"),
                F.array().cast(REGION).alias("MergedRegions"),
                F.lit(1).alias("TopHeaderRowsNumber"),
                F.lit(0).alias("LeftHeaderColumnsNumber"),
                F.size(texts).alias("Height"),
                F.lit(len(rows.columns)).alias("Width"),
            )
        ).alias("value")
    )


def cached(df: DataFrame, folder: str, *key: Any) -> DataFrame:
    """``df`` from a Parquet cache under a hash of ``key``; computed and written if not there."""
    spark = df.sparkSession
    name = hashlib.sha256(json.dumps(key, default=str, sort_keys=True).encode()).hexdigest()[:32]
    path = f"{folder}/{name}.parquet"
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def log_run(metrics: DataFrame, folder: str, scenario: str, system: str, seconds: float) -> None:
    """Appends a run's metrics to the ``runs`` log."""
    out = metrics.withColumns({"scenario": F.lit(scenario), "system": F.lit(system), "seconds": F.lit(float(seconds)), "at": F.lit(time.time())})
    out.write.mode("append").parquet(f"{folder}/runs.parquet")


def read_runs(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/runs.parquet")
