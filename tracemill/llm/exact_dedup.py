"""Exact dedup: group by a 128-bit content hash, keep one row, compare bytes inside groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import cut, small_side, strip_ws


#: A group is hot above this many rows, or above a HOT_GROUPS-th of all rows if that is more; so at most HOT_GROUPS are.
HOT_ROWS = 1_000
HOT_GROUPS = 100_000


def _keeper(n: str, i: str) -> Column:
    """Most code points first, then the smallest id; a null id comes last."""
    return F.max(F.struct(F.col(n), -F.col(i)))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hex_digits: int = 32) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without ASCII white space. Of equal texts the row with the most code points
    in the original stays, then the smallest id. The group key is the first 128 bits of the text's SHA-256
    (``hex_digits`` lowers that in tests to force collisions); the bytes of every row of a group are compared with
    those of its keeper, and hashes shared by different texts are regrouped by the text itself.

    Null text counts as empty, so all null, empty and blank texts form one group. A null id ranks behind other
    ids. Rows that repeat both id and text are one document: each carries ``kept`` of it and counts in
    ``group_size``. Empty input gives an empty result; other columns are ignored, so names cannot clash.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_t"))
    base = rows.select("_id", F.coalesce(F.length("_t"), F.lit(0)).alias("_n"), F.sha2(strip_ws(F.col("_t")), 256).alias("_sha"))
    base = cut(base.withColumn("_h", F.unhex(F.rpad(F.substring("_sha", 1, hex_digits), 32, "0"))), "dedup-rows")

    groups = base.groupBy("_h").agg(F.count(F.lit(1)).alias("_size"), _keeper("_n", "_id").alias("_k")).where("_size > 1")
    groups = cut(groups.select("_h", "_size", F.col("_k._n").alias("_kn"), (-F.col("_k.col2")).alias("_kid")), "dedup-groups")

    # Hot groups meet their rows by broadcast (fixed-width rows of a proven number), the rest by a shuffle without them.
    hot_rows = max(HOT_ROWS, base.count() // HOT_GROUPS)
    hot = F.broadcast(groups.where(F.col("_size") > hot_rows))
    rest, cold = base.join(hot, "_h", "left_anti"), groups.where(F.col("_size") <= hot_rows)
    is_k = F.col("_id").eqNullSafe(F.col("_kid")) & (F.col("_n") == F.col("_kn"))
    parts = F.ceil(F.col("_size") / F.lit(hot_rows)).cast("long").alias("_parts")
    members = base.join(hot, "_h").unionByName(rest.join(cold, "_h")).select("_id", "_n", "_sha", "_h", is_k.alias("_is_k"), parts)

    # Bytes: the texts of grouped rows only. Ids are fixed-width, so that side is broadcast if its count allows. A hot
    # group is compared in parts, each with a copy of the keeper: copies number at most all rows by ``hot_rows``, twice.
    ids = small_side(cut(members.distinct(), "dedup-members"))
    texts = rows.alias("r").join(ids.alias("m"), F.expr("r._id <=> m._id AND coalesce(length(r._t), 0) = m._n"))
    texts = texts.select("m._id", "m._n", "m._sha", "m._h", "m._is_k", "m._parts", strip_ws(F.col("r._t")).alias("_norm"))
    texts = cut(texts.where(F.sha2("_norm", 256) == F.col("_sha")), "dedup-texts")
    keepers = texts.where("_is_k").dropDuplicates(["_h", "_sha"])
    keepers = keepers.select(F.col("_h").alias("_kh"), F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_kp"), F.col("_norm").alias("_knorm"))
    part = F.pmod(F.xxhash64("_id", "_n"), F.col("_parts"))
    bad = texts.join(keepers, (F.col("_h") == F.col("_kh")) & (part == F.col("_kp"))).where("_norm <> _knorm").select("_h").distinct()
    bad = cut(bad, "dedup-collisions")

    joined = base.join(hot, "_h").unionByName(rest.join(cold, "_h", "left"))
    out = joined.select(
        "_h",
        F.col("_id").alias(id_col),
        F.coalesce("_kid", "_id").alias("keep_id"),
        F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("_size").isNull() | is_k).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )
    if bad.isEmpty():
        return out.drop("_h")
    clash = texts.join(bad, "_h", "left_semi")
    # ``texts`` has distinct (id, n, sha) rows of the members joined with every input row, so counts are of rows.
    again = clash.groupBy("_norm").agg(F.count(F.lit(1)).alias("_size"), _keeper("_n", "_id").alias("_k"))
    again = again.select(F.col("_norm").alias("_gn"), "_size", F.col("_k._n").alias("_kn"), (-F.col("_k.col2")).alias("_kid"))
    fixed = clash.join(again, F.col("_norm") == F.col("_gn")).select(
        F.col("_id").alias(id_col),
        F.col("_kid").alias("keep_id"),
        F.col("_size").alias("group_size"),
        is_k.alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )
    return out.join(bad, "_h", "left_anti").drop("_h").unionByName(fixed)


ORACLE_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(length(text), 0) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept,
       text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
"""
