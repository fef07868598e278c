"""Corpus curation: joins, dedup, caps, fills, splits and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracemill.functions import text
from tracemill.operators import rank
from tracemill.plans.registry import query

SEEDED = "md5('7:' || doc_id)"


def seeded(seed: int = 7):
    return rank.seeded(F.col("doc_id").cast("string"), seed=seed)


@query("""WITH d AS (SELECT doc_id, md5(lower(regexp_replace(text, '[\\s\\p{Z}]+', '', 'g'))) AS k FROM documents)
SELECT k, min(doc_id) AS first_id, max(doc_id) AS last_id FROM d GROUP BY ALL""")
def dedup_keep_first_last(t):
    d = t("documents").select("doc_id", F.md5(text.norm(F.col("text"))).alias("k"))
    return rank.first_last(d, ["k"], "doc_id", "first_id", "last_id")


@query("SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rn FROM documents) WHERE rn <= 5")
def cap_per_type(t):
    return rank.cap_per_group(t("documents").select("doc_id", "source", "n_chars"), ["source"], [F.desc("n_chars"), F.col("doc_id")], 5).select("doc_id", "source")


@query("""SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_linenumber, l_partkey) AS rn FROM lineitem WHERE l_returnflag = 'N') WHERE rn = 1""")
def best_per_key_shortest(t):
    rows = t("lineitem").where("l_returnflag = 'N'").select("l_orderkey", "l_linenumber", "l_quantity", "l_partkey")
    return rank.keep_first(rows, ["l_orderkey"], [F.col("l_quantity"), F.col("l_linenumber"), F.col("l_partkey")]).select("l_orderkey", "l_linenumber")


@query("""WITH a AS (SELECT l_returnflag AS cat, l_orderkey AS problem, l_orderkey * 8 + l_linenumber AS seq, l_quantity FROM lineitem),
b AS (SELECT *, row_number() OVER (PARTITION BY cat, problem ORDER BY l_quantity, seq) - 1 AS depth, count(*) OVER (PARTITION BY cat, problem) AS n_traces, min(seq) OVER (PARTITION BY cat, problem) AS seen FROM a),
c AS (SELECT *, row_number() OVER (PARTITION BY cat ORDER BY depth, n_traces, seen, seq) AS pick FROM b)
SELECT cat, problem, seq, depth FROM c WHERE pick <= 1500""")
def even_depth_fill(t):
    a = t("lineitem").select(F.col("l_returnflag").alias("cat"), F.col("l_orderkey").alias("problem"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"), "l_quantity")
    out = rank.depth_fill(a, "cat", "problem", [F.col("l_quantity"), F.col("seq")], "seq", 1500)
    return out.select("cat", "problem", "seq", F.col("depth").cast("long").alias("depth"))


@query(f"""SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {SEEDED}, doc_id) AS turn FROM documents""")
def interleave_round_robin(t):
    """Position of a row in its label; ordering by (turn, label) interleaves the labels."""
    out = rank.placed(t("documents").select("doc_id", "lang"), ["lang"], [F.col("doc_id")], seeded())
    return out.select("doc_id", "lang", (F.col("_pos") + 1).alias("turn"))


@query(f"""WITH d AS (SELECT doc_id, lang, count(*) OVER (PARTITION BY lang) AS n FROM documents), v AS (SELECT *, unnest(range(0, ceil(700 / n)::BIGINT)) AS variation FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY variation, {SEEDED}, doc_id) AS rn FROM v) SELECT doc_id, lang, variation FROM r WHERE rn <= 700""")
def upsample_to_target(t):
    out = rank.upsample(t("documents").select("doc_id", "lang"), ["lang"], [F.col("doc_id")], 700, seeded())
    return out.withColumn("variation", F.col("variation").cast("long"))


@query(f"""WITH a AS (SELECT doc_id, lang, row_number() OVER (ORDER BY lang, {SEEDED}, doc_id) - 1 AS pos, count(*) OVER () AS n FROM documents)
SELECT doc_id, lang, pos % ceil(n / 32)::BIGINT AS batch FROM a""")
def stratified_batches(t):
    return rank.stratified_batches(t("documents").select("doc_id", "lang"), "lang", [F.col("doc_id")], 32, seeded())


@query(f"""WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {SEEDED}, doc_id) AS rn FROM documents)
SELECT doc_id, lang, CASE WHEN rn <= 10 THEN 'holdout' ELSE 'train' END AS split FROM r WHERE rn <= 60""")
def holdout_cap_split(t):
    return rank.holdout_split(t("documents").select("doc_id", "lang"), ["lang"], [seeded(), F.col("doc_id")], 10, 50)


@query("""WITH u AS (SELECT doc_id, quality AS v, 0 AS src FROM labels WHERE toxic = 0 UNION ALL SELECT doc_id, quality, 1 FROM labels UNION ALL SELECT doc_id, -1, 2 FROM documents)
SELECT doc_id, arg_min(v, src) AS v, min(src) AS src FROM u GROUP BY ALL""")
def priority_coalesce(t):
    labels = t("labels").select("doc_id", F.col("quality").alias("v"), "toxic")
    sources = [labels.where("toxic = 0").drop("toxic"), labels.drop("toxic"), t("documents").select("doc_id", F.lit(-1).alias("v"))]
    return rank.first_wins([s.withColumn("src", F.lit(i)) for i, s in enumerate(sources)], "doc_id")


@query("SELECT doc_id, source FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)")
def resume_anti_join(t):
    return t("documents").select("doc_id", "source").join(t("labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def semi_join_solution(t):
    return t("documents").select("doc_id", "source").join(t("labels").where("toxic = 1"), "doc_id", "left_semi")


@query("SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL OR quality = 1")
def optional_match_filter(t):
    return t("documents").select("doc_id").join(t("labels").select("doc_id", "quality"), "doc_id", "left").where("quality IS NULL OR quality = 1")


@query("""WITH weak AS (SELECT source FROM documents JOIN labels USING (doc_id) GROUP BY source HAVING avg(quality) < 0.85::DOUBLE) SELECT doc_id, source FROM documents WHERE source IN (SELECT source FROM weak)""")
def weak_category_semi(t):
    docs = t("documents").select("doc_id", "source")
    weak = docs.join(t("labels"), "doc_id").groupBy("source").agg(F.avg("quality").alias("acc")).where("acc < 0.85D")
    return docs.join(weak, "source", "left_semi").select("doc_id", "source")


@query("""WITH m AS (SELECT c_nationkey, arg_max(c_name, c_custkey) AS last_name FROM customer GROUP BY ALL) SELECT s_suppkey, last_name FROM supplier LEFT JOIN m ON s_nationkey = c_nationkey""")
def lookup_last_wins(t):
    dim = rank.keep_first(t("customer").select("c_nationkey", "c_custkey", F.col("c_name").alias("last_name")), ["c_nationkey"], [F.desc("c_custkey")])
    return t("supplier").join(dim, F.col("s_nationkey") == F.col("c_nationkey"), "left").select("s_suppkey", "last_name")


@query("""SELECT doc_id, coalesce(CASE quality WHEN 1 THEN 'good' WHEN 0 THEN 'bad' END, CASE WHEN n_chars < 500 THEN 'short' ELSE 'unknown' END) AS kind FROM documents LEFT JOIN labels USING (doc_id)""")
def lookup_with_fallback(t):
    joined = t("documents").select("doc_id", "n_chars").join(t("labels"), "doc_id", "left")
    known = F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "bad")
    return joined.select("doc_id", F.coalesce(known, F.when(F.col("n_chars") < 500, "short").otherwise("unknown")).alias("kind"))


@query("""WITH a AS (SELECT s_nationkey AS k, sum(s_acctbal) AS v FROM supplier GROUP BY ALL), b AS (SELECT c_nationkey AS k, sum(c_acctbal) AS v FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY ALL)
SELECT coalesce(a.k, b.k) AS k, round(coalesce(a.v, 0) + coalesce(b.v, 0), 2) AS total, a.k IS NULL AS only_b, b.k IS NULL AS only_a FROM a FULL JOIN b ON a.k = b.k""")
def outer_module_merge(t):
    a = t("supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.sum("s_acctbal").alias("va"))
    b = t("customer").where("c_mktsegment = 'BUILDING'").groupBy(F.col("c_nationkey").alias("k")).agg(F.sum("c_acctbal").alias("vb"))
    j = a.join(b, "k", "full")
    return j.select("k", F.round(F.coalesce("va", F.lit(0.0)) + F.coalesce("vb", F.lit(0.0)), 2).alias("total"), F.col("va").isNull().alias("only_b"), F.col("vb").isNull().alias("only_a"))


@query("""WITH p AS (SELECT event_type AS k, count(*) / sum(count(*)) OVER () AS p FROM events WHERE event_id % 2 = 0 GROUP BY ALL), q AS (SELECT event_type AS k, count(*) / sum(count(*)) OVER () AS q FROM events WHERE event_id % 2 = 1 GROUP BY ALL)
SELECT round(sum(abs(coalesce(p, 0) - coalesce(q, 0))) / 2, 6) AS tv FROM p FULL JOIN q USING (k)""")
def tv_distance(t):
    """Total variation distance of two distributions, from one pass."""
    odd = F.col("event_id") % 2 == 1
    c = t("events").groupBy("event_type").agg(F.count_if(~odd).alias("a"), F.count_if(odd).alias("b"))
    both = Window.partitionBy()
    c = c.select((F.col("a") / F.sum("a").over(both)).alias("p"), (F.col("b") / F.sum("b").over(both)).alias("q"))
    return c.agg(F.round(F.sum(F.abs(F.col("p") - F.col("q"))) / 2, 6).alias("tv"))


@query("""SELECT s_suppkey AS id, s_name AS name, NULL AS segment FROM supplier UNION ALL SELECT c_custkey, c_name, c_mktsegment FROM customer""")
def union_all_ragged(t):
    a = t("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    b = t("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return a.unionByName(b, allowMissingColumns=True)


@query("""WITH u AS (SELECT 0 AS src, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark), k AS (SELECT *, md5(lower(regexp_replace(text, '[\\s\\p{Z}]+', '', 'g'))) AS k FROM u)
SELECT src, id FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY src, id) AS rn FROM k) WHERE rn = 1""")
def union_distinct_norm(t):
    a = t("documents").select(F.lit(0).alias("src"), F.col("doc_id").alias("id"), "text")
    u = a.unionByName(t("benchmark").select(F.lit(1).alias("src"), F.col("item_id").alias("id"), "text"))
    u = u.select("src", "id", F.md5(text.norm(F.col("text"))).alias("k"))
    return rank.keep_first(u, ["k"], [F.col("src"), F.col("id")]).select("src", "id")


@query("""SELECT doc_id, copy FROM (SELECT doc_id, unnest(range(1, CASE quality WHEN 1 THEN 3 ELSE 2 END)) AS copy FROM labels)""")
def oversample_copies(t):
    out = rank.oversample(t("labels").select("doc_id", "quality"), F.when(F.col("quality") == 1, 2).otherwise(1))
    return out.select("doc_id", F.col("copy").cast("long").alias("copy"))


@query("""SELECT 'docs_only' AS side, count(*) AS n FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT 'labels_only', count(*) FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)
UNION ALL SELECT 'both', count(*) FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)""")
def set_diff_counts(t):
    a, b = t("documents").select("doc_id"), t("labels").select("doc_id")
    count = lambda df, name: df.agg(F.lit(name).alias("side"), F.count(F.lit(1)).alias("n"))
    return count(a.subtract(b), "docs_only").union(count(b.subtract(a), "labels_only")).union(count(a.intersect(b), "both"))


@query("""WITH a AS (SELECT n_nationkey AS k, n_name AS v FROM nation WHERE n_nationkey < 20), b AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 4 = 0 THEN lower(n_name) ELSE n_name END AS v FROM nation WHERE n_nationkey > 5)
SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'only_b' WHEN b.k IS NULL THEN 'only_a' WHEN a.v = b.v THEN 'same' ELSE 'differs' END AS status FROM a FULL JOIN b ON a.k = b.k""")
def config_diff(t):
    n = t("nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v"))
    a = n.where("k < 20").withColumnRenamed("v", "va")
    b = n.where("k > 5").select("k", F.when(F.col("k") % 4 == 0, F.lower("v")).otherwise(F.col("v")).alias("vb"))
    status = F.when(F.col("va").isNull(), "only_b").when(F.col("vb").isNull(), "only_a").when(F.col("va") == F.col("vb"), "same").otherwise("differs")
    return a.join(b, "k", "full").select("k", status.alias("status"))


@query("""WITH c AS (SELECT vec_id, label, unnest(range(1, 65)) AS cell, unnest(embedding) AS v FROM embeddings), s AS (SELECT label, cell, sign(sum(v::DOUBLE)) AS s FROM c GROUP BY ALL)
SELECT label, cell, count(*) FILTER (sign(v) = s) AS agree, round(sum(CASE WHEN sign(v) = s THEN v::DOUBLE ELSE 0 END) / greatest(1, count(*) FILTER (sign(v) = s)), 4) AS merged FROM c JOIN s USING (label, cell) GROUP BY ALL""")
def ties_sign_elect(t):
    """TIES merge on the long form: elect each cell's sign by mass, then average what agrees."""
    c = t("embeddings").select("label", F.posexplode("embedding").alias("p", "v")).select("label", (F.col("p") + 1).cast("long").alias("cell"), F.col("v").cast("double").alias("v"))
    pos = c.groupBy("label", "cell").agg(
        F.signum(F.sum("v")).alias("s"),
        F.count_if(F.col("v") > 0).alias("np"), F.sum(F.when(F.col("v") > 0, F.col("v")).otherwise(0.0)).alias("sp"),
        F.count_if(F.col("v") < 0).alias("nn"), F.sum(F.when(F.col("v") < 0, F.col("v")).otherwise(0.0)).alias("sn"),
    )
    agree = F.when(F.col("s") > 0, F.col("np")).when(F.col("s") < 0, F.col("nn")).otherwise(0)
    mass = F.when(F.col("s") > 0, F.col("sp")).when(F.col("s") < 0, F.col("sn")).otherwise(0.0)
    return pos.select("label", "cell", agree.alias("agree"), F.round(mass / F.greatest(F.lit(1), agree), 4).alias("merged"))
