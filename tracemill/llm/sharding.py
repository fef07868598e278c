"""Sharding by balanced label propagation, in DataFrame functions only."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.llm.common import cut, gapless_rank

SHARDS = 16
#: Hash cells that a group of linked rows is moved in; a group larger than a shard moves cell by cell.
CELLS = 64


def _pick(values: list[int], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), index + 1)


def _loads(units: DataFrame, n_shards: int) -> list[int]:
    """Rows per shard: as many numbers as shards, whatever the input."""
    got = {r["shard"]: r["n"] for r in units.groupBy("shard").agg(F.sum("c").alias("n")).collect()}
    return [int(got.get(j, 0)) for j in range(n_shards)]


def _start(units: DataFrame, caps: list[int]) -> DataFrame:
    """Start within the quotas: units lie along a line group by group, and every shard takes its quota's share of the line."""
    part = F.substring("gid", 1, 1)
    sums = units.groupBy(part.alias("part")).agg(F.sum("c").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # At most 256 rows, one per first byte of a group id.
    sums = sums.select(F.col("part").alias("_part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("part").orderBy("gid", "cell").rowsBetween(Window.unboundedPreceding, -1)
    lined = units.withColumn("part", part).withColumn("upto", F.coalesce(F.sum("c").over(inside), F.lit(0))).join(F.broadcast(sums), F.col("part") == F.col("_part"))
    linked, total = int(units.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]), sum(caps)
    shard = F.lit(len(caps) - 1)
    for j, end in reversed(list(enumerate(accumulate(caps)))):
        shard = F.when((F.col("ahead") + F.col("upto")) * F.lit(total).cast("decimal(20,0)") < F.lit(end * linked).cast("decimal(38,0)"), j).otherwise(shard)
    return cut(lined.select("gid", "cell", "c", shard.cast("int").alias("shard")), "shard-units")


def _round(units: DataFrame, caps: list[int], n_shards: int) -> tuple[DataFrame, int]:
    """One round: units ask for a shard that holds more of their group; requests are granted up to the free quota.

    The units and the number of moves: each raises the sum of squares of what shards hold of groups, so rounds end.
    """
    free = [cap - load for cap, load in zip(caps, _loads(units, n_shards), strict=True)]
    held = units.groupBy("gid", "shard").agg(F.sum("c").alias("held"))
    # At most n_shards entries a group, the fullest first; ties go to the lower shard.
    at = F.sort_array(F.collect_list(F.struct("held", (-F.col("shard")).alias("s"))), asc=False)
    spread = held.groupBy("gid").agg(at.alias("at")).where(F.size("at") > 1).withColumnRenamed("gid", "_g")
    asked = units.join(spread, F.col("gid") == F.col("_g"), "left")
    own = F.get(F.filter("at", lambda x: x["s"] == -F.col("shard")), F.lit(0))
    # The fullest shard that has room for the unit; units only move to a shard that holds more of their group.
    goal = F.get(F.filter("at", lambda x: (x > F.col("own")) & (F.col("c") <= _pick(free, -x["s"]))), F.lit(0))
    asked = asked.withColumn("own", own).withColumn("to", -goal["s"])
    asked = cut(asked.select("gid", "cell", "c", "shard", "to"), "shard-asked")
    part = F.substring("gid", 1, 1)
    wanted = asked.where("to IS NOT NULL").withColumn("part", part)
    sums = wanted.groupBy("to", "part").agg(F.sum("c").alias("n"))
    before = Window.partitionBy("to").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("to").alias("_to"), F.col("part").alias("_part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("to", "part").orderBy("gid", "cell").rowsBetween(Window.unboundedPreceding, 0)
    # One row per shard and first byte of a group id: at most 256 * n_shards rows.
    granted = wanted.withColumn("upto", F.sum("c").over(inside)).join(F.broadcast(sums), (F.col("to") == F.col("_to")) & (F.col("part") == F.col("_part")))
    granted = granted.where(F.col("ahead") + F.col("upto") <= _pick(free, F.col("to")))
    moved = granted.select("gid", "cell", "c", F.col("to").alias("shard"))
    rest = asked.join(granted.select(F.col("gid").alias("_g"), F.col("cell").alias("_c")), (F.col("gid") == F.col("_g")) & (F.col("cell") == F.col("_c")), "left_anti")
    moved = moved.withColumn("moved", F.lit(True)).unionByName(rest.select("gid", "cell", "c", "shard", F.lit(False).alias("moved")))
    moved = cut(moved, "shard-units")
    return moved.drop("moved"), moved.where("moved").count()


def shard_rows(docs: DataFrame, n_shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32, law, shard, slot, grown_shard: shard row counts at most one apart (law ``rows``).

    Rows are linked when their texts are equal (null counts as empty). Linked rows start
    in units of (group, hash cell), laid into the shards group by group; each round a unit moves to the fullest shard of
    its group that has room within its quota of ceil or floor(rows / n_shards), until no unit moves. Rows without
    links cut none wherever they are; they fill the shards up to their quotas. Slots count from 0 within a shard.

    Sizes are UTF-8 bytes plus 1, so 1 for null and empty texts. Null ids are ordered by an empty hash, repeated
    rows are rows of their own, and an empty input gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    md5 = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.octet_length(text).cast("long").alias("bytes"), F.crc32(text).alias("crc"), F.unhex(F.md5(text)).alias("gid"), md5.alias("h"))
    base = base.withColumn("part", F.conv(F.substring("h", 1, 3), 16, 10).cast("int")).withColumn("cell", F.col("part") % CELLS)
    base = cut(base, "shard-rows")
    total = base.count()
    caps = [total // n_shards + (j < total % n_shards) for j in range(n_shards)]

    groups = cut(base.groupBy("gid").agg(F.count(F.lit(1)).alias("g")).where("g > 1").select(F.col("gid").alias("_g")), "shard-groups")
    linked = base.join(groups, F.col("gid") == F.col("_g"), "left_semi")
    units = linked.groupBy("gid", "cell").agg(F.count(F.lit(1)).alias("c"))
    units, moves = _start(cut(units, "shard-units"), caps), 1
    while moves:
        units, moves = _round(units, caps, n_shards)
    loads = _loads(units, n_shards)
    return _place(base, groups, units, caps, loads, id_col)


def _place(base: DataFrame, groups: DataFrame, units: DataFrame, caps: list[int], loads: list[int], id_col: str) -> DataFrame:
    """Exact quotas: linked rows beyond a shard's quota and all rows without links fill the shards that have room."""
    keyed = units.select(F.col("gid").alias("_g"), F.col("cell").alias("_c"), "shard")
    linked = base.join(keyed, (F.col("gid") == F.col("_g")) & (F.col("cell") == F.col("_c"))).drop("_g", "_c")
    order = [F.col("h"), F.col("id")]
    over = [j for j, (cap, load) in enumerate(zip(caps, loads, strict=True)) if load > cap]
    loose = base.join(groups, F.col("gid") == F.col("_g"), "left_anti")
    if over:
        ranked = gapless_rank(cut(linked, "shard-linked"), ["shard"], "part", order, "_r")
        fits = F.col("_r") < _pick(caps, F.col("shard"))
        linked, spilled = ranked.where(fits).drop("_r"), ranked.where(~fits).drop("_r", "shard")
        loose = loose.unionByName(spilled)
    room = [max(0, cap - load) for cap, load in zip(caps, loads, strict=True)]
    loose = gapless_rank(cut(loose, "shard-loose"), [], "part", order, "_r")
    shard = F.lit(len(caps) - 1)
    for j, end in reversed(list(enumerate(accumulate(room)))):
        shard = F.when(F.col("_r") < end, j).otherwise(shard)
    placed = linked.unionByName(loose.withColumn("shard", shard.cast("int")).drop("_r"))
    slotted = gapless_rank(cut(placed, "shard-placed"), ["shard"], "part", order, "slot")
    return slotted.select(
        F.col("id").alias(id_col),
        (F.col("bytes") + 1).alias("size"),
        F.col("crc").alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
