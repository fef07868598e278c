"""Sinks: CSV, JSON lines, split outputs, manifests, one text a row, upserts, batches and state files."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracemill.sources.files import CSV, _path, scan_jsonl

BOM = "\ufeff"


def write_csv(df: DataFrame, path: str, columns: list[str], mode: str = "overwrite") -> None:
    """The given columns in order, all fields quoted, a header in every file."""
    options = {k: v for k, v in CSV.items() if k not in ("multiLine", "maxCharsPerColumn")}
    df.select(*[F.col(f"`{c}`") for c in columns]).write.mode(mode).options(**options, quoteAll="true").csv(path)


def write_marked_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """One CSV file that begins with a byte order mark, for spreadsheets; one task writes it, so for reports only."""
    line = F.to_csv(F.struct(*[F.col(f"`{c}`") for c in columns]), {"quoteAll": "true", "escape": '"', "nullValue": "\\N", "emptyValue": ""})
    head = df.sparkSession.range(1).select(F.lit(0).alias("_o"), F.lit(BOM + ",".join(columns)).alias("value"))
    rows = head.unionByName(df.select(F.lit(1).alias("_o"), line.alias("value")))
    rows.coalesce(1).sortWithinPartitions("_o").select("value").write.mode("overwrite").text(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One object a line, nulls kept, characters beyond ASCII as they are."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def csv_from_jsonl(spark: SparkSession, source: str, path: str, schema: str, columns: list[str]) -> None:
    """The CSV made anew of the JSON lines, which are the source of truth."""
    write_csv(scan_jsonl(spark, source, schema, strict=False), path, columns)


def write_split(df: DataFrame, path: str, valid: Column) -> None:
    """Three outputs: valid, invalid and all rows; the check is made once, as a partition column of one write."""
    df.withColumn("_part", F.when(F.coalesce(valid, F.lit(False)), "valid").otherwise("invalid")).write.mode("overwrite").partitionBy("_part").parquet(path)


def read_split(spark: SparkSession, path: str, part: str = "all") -> DataFrame:
    rows = spark.read.parquet(path)
    return (rows if part == "all" else rows.where(F.col("_part") == part)).drop("_part")


def write_manifest(df: DataFrame, path: str, *measures: Column) -> None:
    """One line of JSON with aggregates of ``df``."""
    df.agg(*measures).select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_texts(df: DataFrame, folder: str, id_col: str, text_col: str) -> None:
    """A folder of text a row, named by its id; for few rows only."""
    df.select(id_col, text_col).write.mode("overwrite").partitionBy(id_col).text(folder)


def upsert(index: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """The index with the updates' values where they have any, and their new keys; one row a key on both sides."""
    old, new = index.alias("o"), updates.alias("u")
    joined = old.join(new, F.col(f"o.{key}") == F.col(f"u.{key}"), "full")
    own = set(updates.columns)
    return joined.select(*[F.coalesce(F.col(f"u.{c}"), F.col(f"o.{c}")).alias(c) if c in own else F.col(f"o.{c}").alias(c) for c in index.columns])


def _versions(spark: SparkSession, path: str) -> list[int]:
    at, store = _path(spark, path)
    if not store.exists(at):
        return []
    names = [f.getPath().getName() for f in store.listStatus(at)]
    return sorted(int(m[1]) for m in map(re.compile(r"^v([0-9]{12})[.]json$").match, names) if m)


def write_state(spark: SparkSession, path: str, state: dict) -> None:
    """The next version of a small state in the folder ``path``; it counts from the moment its file has its name.

    Written under another name and renamed to one that no version has, so a run that ends in between leaves the version
    before it in force. A second writer of the same version fails. The version before is kept, older ones go.
    """
    found = _versions(spark, path)
    number = found[-1] + 1 if found else 1
    beside, store = _path(spark, f"{path}/.v{number:012d}-{uuid.uuid4().hex}")
    stream = store.create(beside, False)
    stream.write(bytearray(json.dumps(state, sort_keys=True).encode()))
    stream.close()
    at, _ = _path(spark, f"{path}/v{number:012d}.json")
    if store.exists(at) or not store.rename(beside, at):
        raise OSError(f"cannot put the state at {path}")
    for old in found[:-1]:
        store.delete(_path(spark, f"{path}/v{old:012d}.json")[0], False)


def read_state(spark: SparkSession, path: str) -> dict | None:
    """The newest version of a state, None before the first."""
    found = _versions(spark, path)
    return json.loads("".join(r["value"] for r in spark.read.text(f"{path}/v{found[-1]:012d}.json", wholetext=True).collect())) if found else None


def write_in_batches(df: DataFrame, path: str, key: str, every: int, work: Callable[[DataFrame], DataFrame], most: int | None = None) -> int:
    """``work`` over the rows of ``df`` in batches of about ``every``, each written and then committed; the batches still missing.

    A batch is the rows whose hash of ``key`` falls to it, so a run after an end, however it came, goes on behind the
    last committed batch and writes a half-written one anew: each row is in the output once. The number of batches is
    fixed by the first run. ``most`` ends the run after so many batches. Null keys are one batch's.
    """
    spark = df.sparkSession
    state = read_state(spark, f"{path}/state") or {"batches": max(1, -(-df.count() // every)), "done": 0}
    last = state["batches"] if most is None else min(state["batches"], state["done"] + most)
    for batch in range(state["done"], last):
        rows = df.where(F.pmod(F.xxhash64(F.col(key)), F.lit(state["batches"])) == batch)
        work(rows).write.mode("overwrite").parquet(f"{path}/batches/{batch:09d}")
        state = state | {"done": batch + 1}
        write_state(spark, f"{path}/state", state)
    return state["batches"] - state["done"]


def read_batches(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The rows of all committed batches."""
    done = (read_state(spark, f"{path}/state") or {"done": 0})["done"]
    paths = [f"{path}/batches/{batch:09d}" for batch in range(done)]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
