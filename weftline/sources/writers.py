"""Writers: contract tables with keys and a manifest, versioned graph exports, partitioned logs."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.operators.graph import active, with_closures
from weftline.operators.ranking import dense_ids
from weftline.session import BROADCAST_ROWS
from weftline.sources.contract import conform


def with_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows without a key get the next numbers above those there are, in an order that tells them apart."""
    missing = df.filter(F.col(key).isNull())
    top = df.agg(F.coalesce(F.max(key), F.lit(0))).first()[0]
    numbered = dense_ids(missing.drop(key), order, key, int(top) + 1)
    return df.filter(F.col(key).isNotNull()).unionByName(numbered.select(*[F.col(key).cast(df.schema[key].dataType).alias(key) if c == key else F.col(c) for c in df.columns]))


def write_table(df: DataFrame, path: str, schema: T.StructType | None = None, kind: str = "parquet", mode: str = "overwrite", partition: list[str] | None = None) -> int:
    """Writes a table in the form of its contract and returns its rows, counted on the way."""
    seen = Observation()
    df = (conform(df, schema) if schema else df).observe(seen, F.count(F.lit(1)).alias("rows"))
    writer = df.write.mode(mode).partitionBy(*(partition or []))
    if kind == "csv":
        writer.option("header", True).option("escape", '"').option("emptyValue", "").csv(path)
    else:
        writer.option("compression", "zstd").format(kind).save(path)
    return seen.get["rows"]


def export(spark: SparkSession, tables: dict[str, tuple[DataFrame, T.StructType]], folder: str, kind: str = "csv") -> dict[str, int]:
    """Writes tables of a contract and a manifest with their rows."""
    rows = {name: write_table(df, f"{folder}/{name}", schema, kind) for name, (df, schema) in tables.items()}
    manifest = spark.createDataFrame([(json.dumps({"tables": rows}, sort_keys=True),)], "value string")
    manifest.coalesce(1).write.mode("overwrite").text(f"{folder}/manifest")
    return rows


def temporal_history(versions: DataFrame, closures: DataFrame) -> DataFrame:
    """All versions with their closures, without row ids."""
    return with_closures(versions, closures).drop("row_id")


def final_active(versions: DataFrame, closures: DataFrame, names: DataFrame, year: int) -> DataFrame:
    """Versions active in a year with the names of both ends (``id, name``)."""
    now = with_closures(versions, closures).filter(active(year))
    ends = [names.select(F.col("id").alias(k), F.col("name").alias(f"{k}_name")) for k in ("src", "dst")]
    return now.join(ends[0], "src", "left").join(ends[1], "dst", "left")


def append_log(df: DataFrame, path: str, year: str = "event_year") -> int:
    """Adds rows to a log laid out by year."""
    return write_table(df, path, mode="append", partition=[year])


def write_json_batch(df: DataFrame, path: str, limit: int = BROADCAST_ROWS) -> int:
    """Writes a short table as one JSON list in one file that is there whole or not at all; ValueError beyond ``limit`` rows.

    Nulls are written, and the order is that of the rows' JSON text. Returns the rows.
    """
    rows = df.count()
    if rows > limit:
        raise ValueError(f"{rows} rows are no batch; write a table instead")
    text = F.to_json(F.struct(*[F.col(c) for c in df.columns]), {"ignoreNullFields": "false"})
    one = df.agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list(text)), ","), F.lit("]")).alias("value"))
    hidden = f"{path}.making-{uuid.uuid4().hex}"
    one.coalesce(1).write.text(hidden)
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    part = next(f.getPath() for f in fs.listStatus(hadoop.Path(hidden)) if f.getPath().getName().startswith("part-"))
    fs.delete(hadoop.Path(path), False)
    fs.rename(part, hadoop.Path(path))
    fs.delete(hadoop.Path(hidden), True)
    return rows


def load_or_compile(spark: SparkSession, path: str, stamp: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path`` if it was compiled whole from inputs with this stamp, else made, written and read back."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    where = f"{path}/stamp={stamp}"
    if not fs.exists(hadoop.Path(where + "/_SUCCESS")):
        make().write.mode("overwrite").option("compression", "zstd").parquet(where)
    return spark.read.parquet(where)
