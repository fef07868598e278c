"""Shared pieces of the corpus operators: lineage cuts, checked broadcasts, distributed ranks."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The six ASCII white-space characters that every word rule here splits on.
WS_CHARS = " \t\n\x0b\x0c\r"
WS_CLASS = r"[\x20\x09-\x0D]"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

#: Rows of fixed-width columns (tens of bytes each) up to which a side is broadcast; above it the join shuffles.
BROADCAST_ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``; where it is unset, a local one in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "/tmp/checkpoints/tracemill"
        os.makedirs(base, exist_ok=True)
    return base


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lost executors cost no recomputation of what lies before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``cut`` wrote and that nothing reads any more."""
    for table in tables:
        jvm = table.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(table._cut_path)
        path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores put before each until no column of ``df`` has it in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only if the table (already cut, so counting reads footers) has at most ``rows`` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def strip_ws(col: Column) -> Column:
    """Delete every ASCII white-space character; null counts as empty."""
    out = F.coalesce(col, F.lit(""))
    for ch in WS_CHARS:
        out = F.replace(out, F.lit(ch), F.lit(""))
    return out


def utf8_words(col: Column) -> Column:
    """Number of white-space separated words; null counts as none."""
    return F.regexp_count(F.coalesce(col, F.lit("")), F.lit(WORD_PATTERN)).cast("long")


def gapless_rank(df: DataFrame, keys: list[str], bucket: str, order: list[Column], name: str) -> DataFrame:
    """0-based rank within ``keys`` over (bucket, order), without putting a whole key in one task.

    Rows are ranked inside (keys, bucket); the offset of a bucket is the running count over the buckets before
    it, a table of one row per (keys, bucket). The table is joined back with broadcast only if it is small.
    ``df`` should be cut before, as it is read twice.
    """
    counts = df.groupBy(*keys, bucket).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    offsets = offsets.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(bucket).alias("_b"), "_before")
    offsets = small_side(cut(offsets, "offsets"))
    inside = Window.partitionBy(*keys, bucket).orderBy(*order)
    ranked = df.withColumn("_rn", F.row_number().over(inside) - 1)
    cond = F.col(bucket).eqNullSafe(F.col("_b"))
    for i, k in enumerate(keys):
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    drop = ["_rn", "_before", "_b", *[f"_k{i}" for i in range(len(keys))]]
    return ranked.join(offsets, cond).withColumn(name, F.col("_rn") + F.col("_before")).drop(*drop)
