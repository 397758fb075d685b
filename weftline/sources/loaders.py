"""Readers: format probing, lenient CSV, bulk-load dialects, JSON, Arrow files."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.scalars import split_list, text_to

#: Formats in the order in which they are looked for.
PROBED = (".arrow", ".parquet", ".csv")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_table(spark: SparkSession, folder: str, name: str, schema: T.StructType | str | None = None, required: bool = False) -> DataFrame:
    """Reads ``name`` in the first format there is; its extension doesn't matter.

    Without any file the result is empty (with ``schema``), or with ``required`` an
    error; an existing empty file is neither.
    """
    stem = os.path.join(folder, os.path.splitext(name)[0])
    for suffix in PROBED:
        if _exists(spark, stem + suffix):
            if suffix == ".parquet":
                return spark.read.parquet(stem + suffix)
            if suffix == ".arrow":
                return read_arrow(spark, stem + suffix)
            reader = spark.read.option("header", True).option("nullValue", "")
            return reader.schema(schema).csv(stem + suffix) if schema else reader.option("inferSchema", True).csv(stem + suffix)
    if required:
        raise FileNotFoundError(f"no file for table {name} in {folder}")
    return spark.createDataFrame([], schema or T.StructType([]))


def read_arrow(spark: SparkSession, path: str) -> DataFrame:
    """Arrow IPC files of a path or folder, one task for each file, batch by batch."""
    from weftline.sources.arrow_ipc import ArrowSource

    spark.dataSource.register(ArrowSource)
    return spark.read.format("arrow_ipc").load(path)


def read_bulk_csv(spark: SparkSession, path: str, schema: T.StructType | str, dialect: str = "header") -> DataFrame:
    """CSV as a database bulk load reads it: "header" (empty is null) or "plain" (no header, backslash escapes)."""
    reader = spark.read.schema(schema).option("quote", '"').option("mode", "FAILFAST").option("nullValue", "")
    if dialect == "header":
        return reader.option("header", True).option("escape", '"').csv(path)
    return reader.option("header", False).option("escape", "\\").csv(path)


def read_as_text_then_cast(spark: SparkSession, path: str, types: dict[str, str]) -> DataFrame:
    """CSV read as text, then some columns cast; empty text and what can't be cast become null."""
    raw = spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return raw.select(*[text_to(F.col(c), types[c]).alias(c) if c in types else F.col(c) for c in raw.columns])


EDGE_TYPES = {"src_id": "bigint", "dst_id": "bigint", "weight": "double", "valid_from": "double", "valid_to": "double"}


def normalized_edges(raw: DataFrame) -> DataFrame:
    """Edge rows with years as whole numbers, "+" for a missing sign and "person" for a missing end type."""
    blank = lambda c, default: F.when(F.trim(F.coalesce(c, F.lit(""))) == "", F.lit(default)).otherwise(F.trim(c))
    return raw.withColumns({
        "valid_from": F.col("valid_from").cast("int"), "valid_to": F.col("valid_to").cast("int"), "sign": blank(F.col("sign"), "+"),
        "src_type": blank(F.col("src_type"), "person"), "dst_type": blank(F.col("dst_type"), "person"),
    })


def read_json_batch(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A file that holds one JSON list of records."""
    reader = spark.read.option("multiLine", True).option("mode", "PERMISSIVE")
    return (reader.schema(schema) if schema else reader).json(path)


def flatten_entities(df: DataFrame) -> DataFrame:
    """Records with lists as flat columns: lists of values are joined with ";"."""
    flat = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.ArrayType):
            flat.append(F.array_join(F.transform(f.name, lambda x: x.cast("string")), ";").alias(f.name))
        elif isinstance(f.dataType, T.StructType | T.MapType):
            flat.append(F.to_json(f.name).alias(f.name))
        else:
            flat.append(F.col(f.name))
    return df.select(*flat)


def tags(column: str):
    return split_list(F.col(column))


def table_facts(spark: SparkSession) -> DataFrame:
    """``table_name, column_name, kind`` of the session's tables and views."""
    rows = [(t.name, c.name, c.dataType) for t in spark.catalog.listTables() for c in spark.catalog.listColumns(t.name)]
    return spark.createDataFrame(rows, "table_name string, column_name string, kind string")
