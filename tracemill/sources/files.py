"""Scans of files in any store that Spark reads: CSV, JSON lines, folders of records, word lists and key lists."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracemill.functions.text import strip

#: Quoted fields may hold line breaks, quotes are doubled inside them, and a null is told from an empty field.
CSV = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"', "nullValue": "\\N", "emptyValue": "", "lineSep": "\n", "maxCharsPerColumn": "-1"}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share; a local one only where none is set, in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "/tmp/checkpoints/tracemill"
    return f"{base}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """The rows dealt, by some columns or all, to as many tasks as a shuffle has: a table of few bytes a row is one task's work otherwise."""
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(n, *(by or df.columns))


def _path(spark: SparkSession, path: str):
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def exists(spark: SparkSession, path: str) -> bool:
    at, store = _path(spark, path)
    return store.exists(at)


def scan_csv(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """CSV with a header; without a schema every column is a string, so ids keep their zeros."""
    reader = spark.read.options(**CSV)
    return (reader.schema(schema) if schema is not None else reader).csv(path)


def scan_jsonl(spark: SparkSession, path: str, schema: StructType | str, strict: bool = True) -> DataFrame:
    """One JSON object a line. Strict scans fail on a bad line, lenient ones skip bad and blank lines."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    fields = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    lines = spark.read.text(path).select(F.from_json("value", fields.add("_bad", "string"), {"columnNameOfCorruptRecord": "_bad"}).alias("r"), "value")
    fields = [f.name for f in fields.fields if f.name != "_bad"]
    return lines.where((strip(F.col("value")) != "") & F.col("r").isNotNull() & F.col("r._bad").isNull()).select(*[F.col(f"r.`{f}`") for f in fields])


def scan_records(spark: SparkSession, folder: str, schema: StructType | str) -> DataFrame:
    """All JSON records below a folder with the name of their file's folder in ``part``."""
    found = spark.read.schema(schema).option("recursiveFileLookup", "true").json(folder)
    return found.select("*", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("part"))


def union_present(spark: SparkSession, paths: Iterable[str], read: Callable[[str], DataFrame]) -> DataFrame | None:
    """The rows of the paths that exist, missing columns null; None if none exists."""
    out = None
    for path in paths:
        if exists(spark, path):
            out = read(path) if out is None else out.unionByName(read(path), allowMissingColumns=True)
    return out


def first_path(spark: SparkSession, candidates: Iterable[str], pattern: str | None = None) -> str | None:
    """The first candidate that exists, else the shortest path that a glob pattern finds."""
    for path in candidates:
        if exists(spark, path):
            return path
    if pattern is None:
        return None
    at, store = _path(spark, pattern)
    found = [s.getPath().toString() for s in store.globStatus(at) or []]
    return min(found, key=lambda p: (len(p), p), default=None)


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """The distinct words of a text file with one a line, stripped and sorted."""
    words = spark.read.text(path).select(strip(F.col("value")).alias("word")).where("word <> \'\'")
    return words.distinct().orderBy("word")


def stop_after(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows; without an order whichever partitions give them first, so a scan stops early."""
    return (df.orderBy(*order) if order else df).limit(n)


def joined_deltas(df: DataFrame, by: str, order: str, *texts: str) -> DataFrame:
    """The pieces of a token stream joined in order, one row a stream; null pieces are left out."""
    pieces = F.array_sort(F.collect_list(F.struct(F.col(order), *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in texts])))
    out = df.groupBy(by).agg(pieces.alias("_pieces"))
    return out.select(by, *[F.array_join(F.col(f"_pieces.{c}"), "").alias(c) for c in texts])


def parse_keys(text: str, prefix: str) -> list[str]:
    """Values of the assignments in a key file whose names begin with a prefix, without repeats, in order."""
    found = re.findall(rf"(?m)^\s*(?:export\s+)?({re.escape(prefix)}\w*)\s*=\s*([^\n]*?)\s*$", text)
    return list(dict.fromkeys(v.strip("\"'") for _, v in found if v.strip("\"'")))
