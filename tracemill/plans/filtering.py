"""Queries of the row filters, of column picks, and of work that is committed in batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.functions import boxed, compare, text
from tracemill.operators import filters, pick
from tracemill.plans.registry import query
from tracemill.sources import files, sinks


@query("SELECT doc_id, lang, quality FROM (SELECT d.doc_id, CASE WHEN d.doc_id % 9 = 4 THEN NULL ELSE d.lang END AS lang, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)) WHERE lang IS NOT NULL AND quality IS NOT NULL")
def complete_rows(t):
    """Rows without a null in two of three columns."""
    rows = t("documents").select("doc_id", F.when(F.col("doc_id") % 9 != 4, F.col("lang")).alias("lang"), F.lit(None).cast("string").alias("note"))
    return filters.without(filters.complete(rows.join(t("labels").select("doc_id", "quality"), "doc_id", "left"), "lang", "quality"), "note")


_ANSWERS = """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN NULL ELSE o_totalprice END AS g, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN o_totalprice * 1.004::DOUBLE WHEN 2 THEN o_totalprice * 1.2::DOUBLE ELSE o_totalprice END AS p FROM orders"""


def _answers(t):
    k, x = F.col("o_orderkey"), F.col("o_totalprice")
    told = F.when(k % 5 == 0, F.lit(None)).when(k % 5 == 1, x * 1.004).when(k % 5 == 2, x * 1.2).otherwise(x)
    return t("orders").select("o_orderkey", F.when(k % 6 != 0, x).cast("string").alias("g"), told.cast("string").alias("p"))


@query(f"SELECT o_orderkey FROM ({_ANSWERS}) WHERE abs(p - g) <= greatest(0.01::DOUBLE * greatest(abs(p), abs(g)), 1e-5::DOUBLE)")
def correct_rows(t):
    return filters.correct(_answers(t), compare.official, "p", "g").select("o_orderkey")


@query(f"SELECT o_orderkey, p IS NULL AS silent FROM ({_ANSWERS}) WHERE g IS NOT NULL AND p IS DISTINCT FROM g")
def discrepancies(t):
    return filters.discrepant(_answers(t), "p", "g").select("o_orderkey", F.col("p").isNull().alias("silent"))


@query("SELECT o_orderkey, o_orderpriority AS label FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderkey % 7 <> 3")
def allowed_labels(t):
    """An allow-list over labels some of which are null."""
    rows = t("orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 3, F.col("o_orderpriority")).alias("label"))
    return filters.allowed(rows, "label", ["1-URGENT", "2-HIGH"])


@query("""SELECT rule, n FROM (SELECT count(*) FILTER (p_partkey % 10 = 3) AS a, count(*) FILTER (p_partkey % 10 IN (3, 4) OR p_partkey % 4 = 1 AND p_size <> 7) AS b, count(*) FILTER (p_partkey % 13 = 0) AS c FROM part),
(SELECT unnest(['one box', 'box is the answer', 'known family']) AS rule, unnest([1, 2, 3]) AS i), LATERAL (SELECT CASE i WHEN 1 THEN a WHEN 2 THEN b ELSE c END AS n)""")
def training_violations(t):
    """Targets with a second box, none, or another answer, and rows without a family, counted by rule."""
    k, n = F.col("p_partkey"), F.col("p_size").cast("string")
    told = F.when(k % 4 == 1, F.lit("7")).otherwise(n)
    target = F.concat(F.lit("so "), boxed.with_box(told), F.when(k % 10 == 3, boxed.with_box(F.lit("x"))).otherwise(F.lit("")))
    target = F.when((k % 10 == 4), F.regexp_replace(target, r"\}", "")).otherwise(target)
    rows = t("part").select(target.alias("target"), n.alias("answer"), F.when(k % 13 != 0, F.col("p_type")).alias("family"))
    boxes = F.size(F.split("target", r"\\boxed\{")) - 1
    return filters.violations(rows, {"one box": boxes == 1, "box is the answer": boxed.last_balanced(F.col("target")) == F.col("answer"), "known family": F.col("family").isNotNull()})


@query("SELECT doc_id::VARCHAR AS id, text[1:40] AS prompt, lang AS category, 'none' AS source_model FROM documents")
def canonical_columns(t):
    """Columns found by their aliases in any case, all others dropped, and a default for one that is missing."""
    docs = t("documents").select(F.col("doc_id").alias("DOC_ID"), F.substring("text", 1, 40).alias("Question"), F.col("lang").alias("Type"), "source")
    return pick.canonical(docs, {"id": ["doc_id"], "prompt": ["question"], "category": ["type", "lang"], "source_model": ["model"]}, {"source_model": "none"})


@query("SELECT conv_id, turn, md5(rtrim(CASE WHEN contains(text, 'e') THEN left(text, position('e' IN text) - 1) ELSE text END)) AS asked FROM conversations")
def suffix_and_marker(t):
    """A suffix put behind every turn, and what stands before the marker in it."""
    marked = F.concat("text", F.lit("\n\nPut your answer in a box."))
    before = text.before_first(F.when(F.contains("text", F.lit("e")), marked).otherwise(F.concat("text", F.lit("e"))), "e")
    return t("conversations").select("conv_id", "turn", F.md5(F.rtrim(before)).alias("asked"))


@query("SELECT o_orderkey, md5(o_orderkey::VARCHAR) AS made FROM orders")
def resumed_batches(t):
    """Work in batches of about 500 rows that ends after two of them, twice, and then goes on to the end."""
    orders = t("orders").select("o_orderkey")
    path = files.scratch(orders.sparkSession, "batches")
    work = lambda rows: rows.withColumn("made", F.md5(F.col("o_orderkey").cast("string")))
    sinks.write_in_batches(orders, path, "o_orderkey", max(500, orders.count() // 8), work, most=2)
    while sinks.write_in_batches(orders, path, "o_orderkey", 1, work, most=3):  # the first run fixed the batches
        pass
    return sinks.read_batches(orders.sparkSession, path, "o_orderkey long, made string")
