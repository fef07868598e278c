"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.llm.common import cut, gapless_rank, small_side, utf8_words

WEIGHTS = (3, 1, 2)
SHARE = 1.5
LIMIT = 2
SEED = 20
#: Hash cells of a (source, size class), so that a hot source is ranked by many tasks.
CELLS = 64


def offset(seed: int = SEED) -> float:
    """The one random offset of the systematic sample."""
    return random.Random(seed).random()


def source_targets(sizes: DataFrame, share: float = SHARE, limit: int = LIMIT, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target): weighted shares, stopped at ``limit`` times the source's size.

    The excess goes to the others by weight until none is above. That is the level L with
    sum(min(limit * size, L * weight)) = share * total: ordered by limit * size / weight, the sources before the
    first one that its level doesn't overfill are the stopped ones; beyond it the levels fall. One row a source, so a
    plain window is enough.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights)) + 1)
    per = per.withColumn("w", weight).withColumn("cap", F.col("source_size").cast("double") * limit)
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    per = per.withColumn("level", (total * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(rest))
    level = F.max(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.col("level"))).over(Window.partitionBy())
    target = F.least(F.col("cap"), F.coalesce(level * F.col("w"), F.col("cap")))
    return per.withColumn("target", target).select("source", "source_size", "target")


def _bucket() -> Column:
    """Size class (the top four bits of the size) and hash cell: the coarse part of the sampling order."""
    bits = "length(bin(size))"
    return F.expr(f"(({bits} * 16 + shiftright(size, greatest({bits} - 4, 0))) * {CELLS} + conv(substring(_md5, 1, 4), 16, 10) % {CELLS})").cast("long")


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = SEED, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row: id, source, size, source_size, target (its source's) and copies, the times the mix takes it.

    Each document of a source has target / source_size expected copies. Their prefix sum over (size class, hash
    cell, size, hash of the id) plus one random offset gives a copy for each integer boundary it crosses, so a
    source's words come near its target and no document is taken more than ``LIMIT`` times. The order is fixed by
    the rows, so reruns agree.

    Null texts have size 0; null sources are one source, last in order; null ids are ordered by an empty hash.
    Repeated rows are rows of their own. A source without words has target 0 and is taken 0 times. Columns named in
    ``carry`` come along, so that rows which share an id can be told apart; all others are ignored.
    """
    sizes = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), utf8_words(F.col(text_col)).alias("size"), F.xxhash64(F.col(text_col)).alias("_tie"), *carry)
    sizes = sizes.withColumn("_md5", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    sizes = cut(sizes.withColumn("_bucket", _bucket()), "mix-sizes")
    targets = cut(source_targets(sizes), "mix-targets").withColumnRenamed("source", "_source")
    ranked = gapless_rank(sizes, ["source"], "_bucket", [F.col("size"), F.col("_md5"), F.col("doc_id"), F.col("_tie")], "_rank")
    out = ranked.join(small_side(targets), F.col("source").eqNullSafe(F.col("_source")))
    each = F.coalesce(F.try_divide("target", F.col("source_size").cast("double")), F.lit(0.0))
    crossed = F.floor((F.col("_rank") + 1) * each + F.lit(offset(seed))) - F.floor(F.col("_rank") * each + F.lit(offset(seed)))
    return out.select(F.col("doc_id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", crossed.cast("long").alias("copies"), *carry)


ORACLE_SQL = rf"""
WITH RECURSIVE s AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(CAST(doc_id AS VARCHAR)) AS h FROM documents),
p AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
             ([3.0, 1.0, 2.0])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w
      FROM s GROUP BY source),
c AS (SELECT *, source_size::DOUBLE * 2 AS cap, sum(source_size) OVER () AS total FROM p),
v AS (SELECT *, (total::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
      FROM c WINDOW o AS (ORDER BY cap / w, source NULLS LAST)),
t AS (SELECT source, source_size,
             least(cap, coalesce(max(CASE WHEN level <= cap / w THEN level END) OVER () * w, cap)) AS target FROM v),
b AS (SELECT *, (length(bin(size)) * 16 + (size >> greatest(length(bin(size)) - 4, 0))) * {CELLS}
             + ('0x' || substr(h, 1, 4))::BIGINT % {CELLS} AS bucket FROM s),
r AS (SELECT b.*, t.source_size, t.target, target / source_size::DOUBLE AS e,
             row_number() OVER (PARTITION BY b.source ORDER BY bucket, size, h, doc_id) - 1 AS k
      FROM b JOIN t ON b.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(size * coalesce(floor((k + 1) * e + {offset()!r}::DOUBLE) - floor(k * e + {offset()!r}::DOUBLE), 0) AS BIGINT) AS taken
FROM r
""".replace("WITH RECURSIVE", "WITH")
