"""Catalog of a relational database: tables, columns, keys, as DataFrames.

A catalog comes from a folder of Parquet tables, with keys declared beside it, or from a JDBC
database's information schema. It is small: a row for each table, column or key.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FK_SCHEMA = "fk_id int, constrained_table string, constrained_columns array<string>, referred_table string, referred_columns array<string>"
COLUMN_SCHEMA = "table_name string, ordinal int, column_name string, data_type string"

#: Keys of the driver's star schema, which Parquet can't declare.
STAR_KEYS = [
    ("nation", ["n_regionkey"], "region", ["r_regionkey"]),
    ("customer", ["c_nationkey"], "nation", ["n_nationkey"]),
    ("supplier", ["s_nationkey"], "nation", ["n_nationkey"]),
    ("orders", ["o_custkey"], "customer", ["c_custkey"]),
    ("lineitem", ["l_orderkey"], "orders", ["o_orderkey"]),
    ("lineitem", ["l_partkey"], "part", ["p_partkey"]),
    ("lineitem", ["l_suppkey"], "supplier", ["s_suppkey"]),
    ("labels", ["doc_id"], "documents", ["doc_id"]),
]
STAR_PRIMARY = {
    "region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"],
    "part": ["p_partkey"], "orders": ["o_orderkey"], "events": ["event_id"], "documents": ["doc_id"],
    "labels": ["doc_id"], "embeddings": ["vec_id"], "pages": ["page_id"], "benchmark": ["item_id"],
    "conversations": ["conv_id", "turn"],
}
STAR_TABLES = [
    "benchmark", "conversations", "customer", "documents", "embeddings", "events", "labels", "lineitem", "nation",
    "orders", "pages", "part", "region", "supplier",
]


@dataclass
class Catalog:
    """``schema``: each table's columns as (name, type); ``keys``: foreign keys as
    (table, columns, referred table, referred columns); ``primary``: columns by table."""

    spark: SparkSession
    schema: dict[str, list[tuple[str, str]]]
    keys: list[tuple[str, list[str], str, list[str]]] = field(default_factory=list)
    primary: dict[str, list[str]] = field(default_factory=dict)
    sources: dict[str, DataFrame] = field(default_factory=dict)

    @classmethod
    def from_folder(cls, spark: SparkSession, folder: str, names: list[str], keys=(), primary=None) -> Catalog:
        sources = {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in sorted(names)}
        schema = {n: [(f.name, f.dataType.simpleString()) for f in df.schema] for n, df in sources.items()}
        return cls(spark, schema, list(keys), dict(primary or {}), sources)

    @classmethod
    def from_jdbc(cls, spark: SparkSession, url: str, schema: str = "public", **options: str) -> Catalog:
        """Reads a database's information schema; tables are scanned only when asked for."""

        def read(query: str) -> DataFrame:
            return spark.read.format("jdbc").options(url=url, query=query, **options).load()

        columns = read(
            "SELECT table_name, column_name, data_type FROM information_schema.columns "
            f"WHERE table_schema = '{schema}' ORDER BY table_name, ordinal_position"
        ).collect()
        found: dict[str, list[tuple[str, str]]] = {}
        for r in columns:
            found.setdefault(r[0], []).append((r[1], r[2]))
        usage = "information_schema.key_column_usage"
        rows = read(
            "SELECT k.constraint_name, k.table_name, k.column_name, r.table_name, r.column_name "
            f"FROM information_schema.referential_constraints c JOIN {usage} k ON k.constraint_name = c.constraint_name "
            f"JOIN {usage} r ON r.constraint_name = c.unique_constraint_name AND r.ordinal_position = k.position_in_unique_constraint "
            f"WHERE k.table_schema = '{schema}' ORDER BY k.constraint_name, k.ordinal_position"
        ).collect()
        keys: dict[str, tuple[str, list[str], str, list[str]]] = {}
        for name, t, c, rt, rc in rows:
            key = keys.setdefault(name, (t, [], rt, []))
            key[1].append(c)
            key[3].append(rc)
        own = read(
            f"SELECT k.table_name, k.column_name FROM information_schema.table_constraints c JOIN {usage} k "
            f"ON k.constraint_name = c.constraint_name WHERE c.constraint_type = 'PRIMARY KEY' AND k.table_schema = '{schema}' "
            "ORDER BY k.table_name, k.ordinal_position"
        ).collect()
        primary: dict[str, list[str]] = {}
        for t, c in own:
            primary.setdefault(t, []).append(c)
        sources = {t: spark.read.format("jdbc").options(url=url, dbtable=f'"{t}"', **options).load() for t in found}
        return cls(spark, found, sorted(keys.values(), key=lambda k: k[0]), primary, sources)

    @property
    def names(self) -> list[str]:
        return sorted(self.schema)

    def tables(self) -> DataFrame:
        fk = {t: sum(k[0] == t for k in self.keys) for t in self.names}
        rows = [(t, i, len(self.schema[t]), fk[t], self.primary.get(t, [])) for i, t in enumerate(self.names)]
        return self.spark.createDataFrame(rows, "table_name string, ordinal int, column_count int, fk_count int, pk array<string>")

    def columns(self) -> DataFrame:
        rows = [(t, i, c, kind) for t in self.names for i, (c, kind) in enumerate(self.schema[t])]
        return self.spark.createDataFrame(rows, COLUMN_SCHEMA)

    def foreign_keys(self, table: str | None = None) -> DataFrame:
        rows = [(i, *k) for i, k in enumerate(self.keys, 1) if table in (None, k[0])]
        return self.spark.createDataFrame(rows, FK_SCHEMA)

    def scan(self, table: str, limit: int | None = None, order: list[str] | None = None) -> DataFrame:
        """A table, or its first rows in a stated order."""
        df = self.sources[table]
        return df if limit is None else df.orderBy(*(order or self.primary.get(table) or df.columns)).limit(limit)

    def records(self, table: str) -> DataFrame:
        return self.scan(table).select(F.struct("*").alias("record"))

    def distinct(self, table: str, column: str, limit: int | None = None) -> DataFrame:
        """Distinct values of a column; ``limit`` takes the first in order, None all."""
        values = self.scan(table).select(column).distinct()
        return values if limit is None else values.orderBy(column).limit(limit)

    def row_counts(self) -> DataFrame:
        each = [
            self.scan(t).agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(t).alias("table_name"), "row_count")
            for t in self.names
        ]
        return reduce(DataFrame.unionByName, each)

    def register(self) -> None:
        """Every table as a temporary view."""
        for t, df in self.sources.items():
            df.createOrReplaceTempView(t)

    def sql(self, text: str) -> DataFrame:
        """A query on the tables; ``{name}`` stands for a table."""
        return self.spark.sql(text, **{t: df for t, df in self.sources.items() if "{" + t + "}" in text})


def star(spark: SparkSession, folder: str) -> Catalog:
    return Catalog.from_folder(spark, folder, STAR_TABLES, STAR_KEYS, STAR_PRIMARY)


#: A small schema with every role: entities, details, references and an isolated table.
MINI = {
    "user": (["id", "name", "email"], ["id"], []),
    "profile": (["id", "bio"], ["id"], [(["id"], "user", ["id"])]),
    "address": (["id", "user_id", "city"], ["id"], [(["user_id"], "user", ["id"])]),
    "category": (["id", "label"], ["id"], []),
    "product": (["id", "title", "price", "category_id"], ["id"], [(["category_id"], "category", ["id"])]),
    "like": (["user_id", "product_id"], ["user_id", "product_id"], [(["user_id"], "user", ["id"]), (["product_id"], "product", ["id"])]),
    "purchase": (["user_id", "product_id", "qty"], ["user_id", "product_id"], [(["user_id"], "user", ["id"]), (["product_id"], "product", ["id"])]),
    "log": (["id", "message"], ["id"], []),
}


def mini(spark: SparkSession) -> Catalog:
    schema = {t: [(c, "string") for c in cols] for t, (cols, _, _) in MINI.items()}
    keys = [(t, cols, rt, rc) for t in sorted(MINI) for cols, rt, rc in MINI[t][2]]
    return Catalog(spark, schema, keys, {t: pk for t, (_, pk, _) in MINI.items()})
