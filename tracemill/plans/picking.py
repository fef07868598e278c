"""Orders, samples, fills, text-key joins, JSON fields, vector measures and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracemill.functions import jsons, puzzle, text
from tracemill.operators import pick
from tracemill.plans.registry import query
from tracemill.sources import files
from tracemill.streaming import limits


@query("SELECT * FROM (SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderpriority DESC, o_totalprice, o_orderkey LIMIT 50 OFFSET 20)")
def mixed_order_page(t):
    return pick.page(t("orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), [F.col("o_orderpriority").desc(), F.col("o_totalprice"), F.col("o_orderkey")], 50, 20)


@query("SELECT doc_id FROM documents ORDER BY md5('7:' || doc_id), doc_id LIMIT 100")
def seeded_sample(t):
    return pick.sample(t("documents").select("doc_id"), 100, F.col("doc_id"), seed=7)


@query("""SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5('3:' || doc_id), doc_id) AS k FROM documents) WHERE k <= 5""")
def seeded_sample_per_group(t):
    return pick.sample_per_group(t("documents").select("source", "doc_id"), ["source"], 5, F.col("doc_id"), seed=3)


@query("""SELECT c_custkey, c_mktsegment, c_acctbal >= (SELECT min(v) FROM (SELECT x.c_acctbal AS v FROM customer x WHERE x.c_mktsegment = c.c_mktsegment ORDER BY v DESC LIMIT 20)) AS kept FROM customer c""")
def trimmed_to_largest(t):
    """Values that reach the 20th largest of their segment."""
    return pick.at_least_kth(t("customer").select("c_custkey", "c_mktsegment", "c_acctbal"), ["c_mktsegment"], "c_acctbal", 20).select("c_custkey", "c_mktsegment", "kept")


@query("SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal, s_suppkey LIMIT 5")
def worst_five(t):
    return pick.page(t("supplier").select("s_suppkey", "s_acctbal"), [F.col("s_acctbal"), F.col("s_suppkey")], 5)


@query("""WITH r AS (SELECT o_orderkey, o_orderpriority AS b, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS k FROM orders),
s AS (SELECT o_orderkey, 'overflow' AS placed FROM r WHERE k > 40 ORDER BY o_orderkey LIMIT 40) SELECT o_orderkey, b AS placed FROM r WHERE k <= 40 UNION ALL SELECT * FROM s""")
def bounded_fill(t):
    """Buckets of 40 rows and one for the first 40 that find theirs full."""
    rows = t("orders").select("o_orderkey", F.col("o_orderpriority").alias("b"))
    return pick.fill_buckets(rows, "b", [F.col("o_orderkey")], 40, "overflow").select("o_orderkey", "placed")


@query("""SELECT doc_id, copy FROM (SELECT doc_id, unnest(range(1, CASE WHEN lang = 'en' THEN 4 ELSE 2 END)) AS copy FROM documents) ORDER BY md5('5:' || doc_id || ':' || copy), doc_id, copy LIMIT 300""")
def capped_mix(t):
    """Three copies of one language, one of the others, shuffled, the first 300 rows."""
    docs = t("documents").select("doc_id", "lang")
    sources = [(docs.where("lang = 'en'"), 3), (docs.where("lang IS DISTINCT FROM 'en'"), 1)]
    return pick.mixed(sources, F.col("doc_id"), 300, seed=5).select("doc_id", "copy")


@query(r"""WITH k AS (SELECT doc_id, md5(lower(regexp_replace(text, '\s+', '', 'g'))) AS h FROM documents WHERE text IS NOT NULL), f AS (SELECT h, min(doc_id) AS first FROM k GROUP BY h)
SELECT k.doc_id, f.first FROM k JOIN f USING (h)""")
def joined_on_normalised_text(t):
    docs = t("documents").where("text IS NOT NULL").select("doc_id", F.md5(text.norm(F.col("text"))).alias("h"))
    first = docs.groupBy(F.col("h").alias("h2")).agg(F.min("doc_id").alias("first"))
    return pick.joined_on_text(docs, first, F.col("h"), F.col("h2")).select("doc_id", "first")


@query("""WITH w AS (SELECT n_nationkey AS k, lower(n_name) AS w FROM nation), p AS (SELECT k, w, length(w) AS n, list_transform(range(1, length(w) + 1), lambda i: strpos(w, substr(w, i, 1))) AS p FROM w)
SELECT a.k AS cipher, b.k AS word FROM p a JOIN p b ON a.n = b.n AND a.p = b.p""")
def words_by_pattern(t):
    """Encrypted words and the vocabulary words of one length and pattern of repeats."""
    vocab = t("nation").select(F.col("n_nationkey").alias("word"), F.lower("n_name").alias("w"))
    codes = vocab.select(F.col("word").alias("cipher"), text.caesar(F.col("w"), 5).alias("c"))
    key = lambda c: F.concat_ws("/", F.length(c).cast("string"), text.pattern_of(c))
    return codes.join(F.broadcast(vocab), key(F.col("c")) == key(F.col("w"))).select("cipher", "word")


@query("""WITH a AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS k FROM lineitem), b AS (SELECT l_orderkey, l_linenumber AS right_l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS k FROM lineitem WHERE l_quantity > 25)
SELECT l_orderkey, l_linenumber, right_l_linenumber FROM a JOIN b USING (l_orderkey, k)""")
def zipped_by_place(t):
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return pick.zipped(rows.drop("l_quantity"), rows.where("l_quantity > 25").drop("l_quantity"), "l_orderkey", "l_linenumber")


ROUTES = (("en", "large", "north"), ("de", "small", "south"), ("_default", "middle", "east"))


@query("""SELECT doc_id, CASE lang WHEN 'en' THEN 'large' WHEN 'de' THEN 'small' ELSE 'middle' END AS model, CASE lang WHEN 'en' THEN 'north' WHEN 'de' THEN 'south' ELSE 'east' END AS provider FROM documents""")
def routed(t):
    """Model and provider of a label, or the default's."""
    docs = t("documents").select("doc_id", "lang")
    routes = docs.sparkSession.createDataFrame(ROUTES, "label string, model string, provider string")
    default = next(r for r in ROUTES if r[0] == "_default")
    out = docs.join(F.broadcast(routes), F.col("lang") == F.col("label"), "left")
    return out.select("doc_id", F.coalesce("model", F.lit(default[1])).alias("model"), F.coalesce("provider", F.lit(default[2])).alias("provider"))


@query("""WITH g AS (SELECT user_id, count(*) AS g, count(*) FILTER (event_type = 'purchase') AS c FROM events GROUP BY ALL)
SELECT round(avg((c > 0)::INT), 6) AS pass_at_g, round(avg((c = g)::INT), 6) AS all_correct, round(avg((c > 0 AND c < g)::INT), 6) AS mixed, round(avg(c / g), 2) AS mean_rate, min(g) AS floor, least(min(CASE WHEN c > 0 THEN c END), 100) AS target FROM g""")
def group_outcomes(t):
    """pass@G, all-correct and mixed shares of groups; the floor is the smallest group, the target the smallest count above zero."""
    g = t("events").groupBy("user_id").agg(F.count(F.lit(1)).alias("g"), F.count_if(F.col("event_type") == "purchase").alias("c"))
    share = lambda x: F.round(F.avg(F.expr(x).cast("int")), 6)
    return g.agg(share("c > 0").alias("pass_at_g"), share("c = g").alias("all_correct"), share("c > 0 AND c < g").alias("mixed"), F.round(F.avg(F.col("c") / F.col("g")), 2).alias("mean_rate"), F.min("g").alias("floor"), F.least(F.min(F.when(F.col("c") > 0, F.col("c"))), F.lit(100)).alias("target"))


@query("""SELECT event_type, event_id, row_number() OVER w AS n, (sum((value > 50)::INT) OVER w)::BIGINT AS correct FROM events WINDOW w AS (PARTITION BY event_type, user_id ORDER BY event_id)""")
def running_counters(t):
    return pick.running(t("events").select("event_type", "user_id", "event_id", "value"), ["event_type", "user_id"], [F.col("event_id")], F.coalesce(F.col("value") > 50, F.lit(False))).select("event_type", "event_id", "n", "correct")


@query("""WITH s AS (SELECT vec_id, label, list_reverse_sort(list_transform(embedding, lambda x: (x * x)::DOUBLE)) AS s FROM (SELECT vec_id, label, embedding::DOUBLE[] AS embedding FROM embeddings)),
e AS (SELECT vec_id, label, list_sum(s[1:8]) / list_sum(s) AS e FROM s) SELECT label, count(*) AS n, round(avg(e), 6) AS mean, round(min(e), 6) AS min FROM e GROUP BY ALL""")
def kept_energy(t):
    """Share of a vector's energy in its eight largest entries, by label."""
    squares = F.sort_array(F.transform(F.col("embedding").cast("array<double>"), lambda x: x * x), asc=False)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    e = t("embeddings").select("label", squares.alias("s")).select("label", (total(F.slice("s", 1, 8)) / total(F.col("s"))).alias("e"))
    return e.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("e"), 6).alias("mean"), F.round(F.min("e"), 6).alias("min"))


@query("""WITH x AS (SELECT label, unnest(range(1, 65)) AS i, unnest(embedding::DOUBLE[]) AS v FROM embeddings), m AS (SELECT label, i, avg(v) AS v FROM x GROUP BY ALL),
r AS (SELECT label, i, round(v, 6) AS v, row_number() OVER (PARTITION BY label ORDER BY round(v, 6) DESC, i) AS k FROM m) SELECT label, i AS dimension, v AS weight, k AS rank FROM r WHERE k <= 12""")
def centroid_top_dimensions(t):
    """The twelve largest entries of every label's centroid."""
    x = t("embeddings").select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "v"))
    m = x.groupBy("label", (F.col("i") + 1).cast("long").alias("dimension")).agg(F.round(F.avg("v"), 6).alias("weight"))
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("weight"), "dimension"))
    return m.withColumn("rank", rank).where("rank <= 12")


@query("""WITH a AS (SELECT n_regionkey AS r, n_nationkey AS c, (n_nationkey % 5 + 1) * 0.5::DOUBLE AS v FROM nation), b AS (SELECT n_nationkey AS c, n_nationkey % 4 AS k, (n_nationkey % 3 - 1)::DOUBLE AS v FROM nation)
SELECT r AS i, k AS j, round(sum(a.v * b.v) * 16 / sqrt(8), 6) AS delta FROM a JOIN b USING (c) GROUP BY ALL""")
def adapter_delta(t):
    """Scaled product of two factor matrices in coordinates, alpha over the root of the rank: a join and a sum."""
    n = t("nation")
    left = n.select(F.col("n_regionkey").alias("i"), F.col("n_nationkey").alias("m"), ((F.col("n_nationkey") % 5 + 1) * 0.5).alias("x"))
    right = n.select(F.col("n_nationkey").alias("m"), (F.col("n_nationkey") % 4).alias("j"), (F.col("n_nationkey") % 3 - 1).cast("double").alias("y"))
    return left.join(right, "m").groupBy("i", "j").agg(F.round(F.sum(F.col("x") * F.col("y")) * 16 / F.sqrt(F.lit(8.0)), 6).alias("delta"))


@query("""SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[a-z]+')) AS word FROM documents) GROUP BY word""")
def vocabulary(t):
    """Lower-case words of all documents with their counts."""
    return t("documents").select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]+"), 0)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH r AS (SELECT doc_id, lang, length(text) AS n, row_number() OVER (PARTITION BY lang ORDER BY length(text) DESC NULLS LAST, doc_id) AS k FROM documents) SELECT doc_id, lang FROM r WHERE k <= 10
UNION ALL SELECT doc_id, 'top' FROM (SELECT doc_id FROM documents ORDER BY length(text) DESC NULLS LAST, doc_id LIMIT 15)""")
def caps_after_global_order(t):
    """One order, cut per category or as a whole."""
    order = [F.length("text").desc_nulls_last(), F.col("doc_id")]
    docs = t("documents").select("doc_id", "lang", "text")
    per = pick.cap_per_group(docs, ["lang"], order, 10).select("doc_id", "lang")
    return per.unionByName(pick.page(docs, order, 15).select("doc_id", F.lit("top").alias("lang")))


@query(r"""WITH r AS (SELECT conv_id, turn, conv_id % 5 AS k, turn::VARCHAR AS answer FROM conversations)
SELECT conv_id, turn, CASE WHEN k IN (0, 1) THEN '<think>work ' || answer || '</think>' || chr(10) || '\boxed{' || answer || '}' END AS cot, CASE WHEN k = 4 THEN NULL ELSE k END AS field FROM r""")
def reply_fields(t):
    """Objects inside replies: two sound ones, one without tags, one that does not end in a box, one that never closes."""
    k, answer = F.col("conv_id") % 5, F.col("turn").cast("string")
    good = F.concat(F.lit("<think>work "), answer, F.lit("</think>\n\\boxed{"), answer, F.lit("}"))
    cot = F.when(k <= 1, good).when(k == 2, F.concat(F.lit("no tags\n\\boxed{"), answer, F.lit("}"))).otherwise(F.concat(good, F.lit("\nmore")))
    body = F.to_json(F.struct(cot.alias("cot"), F.struct(k.alias("deep")).alias("in")))
    raw = F.when(k == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(k == 4, F.concat(F.lit("x "), F.substring(body, 1, 30))).otherwise(F.concat(F.lit("x "), body, F.lit(" tail }")))
    deep = F.get_json_object(jsons.first_object(raw), "$.in.deep").cast("long")
    return t("conversations").select("conv_id", "turn", jsons.checked_trace(raw, answer).alias("cot"), deep.alias("field"))


@query("""SELECT n_regionkey, 'key | name' || chr(10) || string_agg(n_nationkey || ' | ' || n_name, chr(10) ORDER BY n_nationkey) AS text FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k FROM nation) WHERE k <= 3 GROUP BY ALL""")
def tables_as_text(t):
    rows = t("nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("r"))
    cells = F.transform("r", lambda x: F.array(x["n_nationkey"].cast("string"), x["n_name"]))
    return rows.select("n_regionkey", jsons.table_text(F.array(F.lit("key"), F.lit("name")), cells, 3).alias("text"))


@query("""WITH l AS (SELECT l_orderkey, list(l_quantity ORDER BY l_linenumber) AS x FROM lineitem GROUP BY ALL)
SELECT l_orderkey, round(list_avg(x), 6) AS mean, list_max(x) AS largest, round(0.25::DOUBLE * list_avg(x) + 0.75::DOUBLE * list_avg(list_reverse_sort(x)[1:2]), 6) AS blend, list_transform(range(1, greatest(8, len(x)) + 1), lambda i: (i <= len(x))::INT) AS mask,
0.5::DOUBLE * (l_orderkey % 2 = 0)::INT + 0.3::DOUBLE * (l_orderkey % 4 = 0)::INT AS format, (l_orderkey % 3 = 0)::INT + 0.2::DOUBLE * (l_orderkey % 2 = 0)::INT AS environment FROM l""")
def losses_and_rewards(t):
    x = t("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity"))).alias("s")).select("l_orderkey", F.col("s.l_quantity").alias("x"))
    k = F.col("l_orderkey")
    return x.select(
        "l_orderkey", F.round(puzzle.mean_loss(F.col("x")), 6).alias("mean"), puzzle.minmax_loss(F.col("x")).alias("largest"), F.round(puzzle.blended_loss(F.col("x"), 2, 0.25), 6).alias("blend"), puzzle.attention_mask(F.col("x"), 8).alias("mask"),
        puzzle.format_reward(k % 2 == 0, k % 4 == 0).alias("format"), puzzle.environment_reward(k % 3 == 0, k % 2 == 0).alias("environment"),
    )


@query("SELECT event_id, user_id FROM events WHERE event_type = 'purchase'")
def streamed_append(t):
    """A filtered stream appended to files twice from one checkpoint: the second run finds nothing new."""
    events = t("events")
    spark = events.sparkSession
    path, checkpoint = files.scratch(spark, "stream"), files.scratch(spark, "stream-state")
    for _ in range(2):
        limits.append_to(limits.stream_of(events).where("event_type = 'purchase'").select("event_id", "user_id"), path, checkpoint)
    return spark.read.schema("event_id long, user_id long").parquet(path)


@query("SELECT event_type, count(*) AS n, count(*) FILTER (value > 50) AS correct FROM events GROUP BY ALL")
def streamed_counters(t):
    events = t("events")
    spark = events.sparkSession
    path, checkpoint = files.scratch(spark, "counters"), files.scratch(spark, "counters-state")
    limits.counters_to(limits.stream_of(events), "event_type", "value > 50", path, checkpoint)
    rows = spark.read.option("recursiveFileLookup", "true").parquet(path)
    return rows.groupBy("event_type").agg(F.max_by("n", "batch").alias("n"), F.max_by("correct", "batch").alias("correct"))


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6::DOUBLE AS at, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
s AS (SELECT user_id, 0::BIGINT AS k, NULL::BIGINT AS event_id, []::DOUBLE[] AS recent, -1e300::DOUBLE AS until, false AS cooling FROM (SELECT DISTINCT user_id FROM events)
UNION ALL SELECT e.user_id, e.k, e.event_id, CASE WHEN e.at < s.until THEN s.recent WHEN len(list_filter(s.recent, lambda x: x >= e.at - 3600)) + 1 >= 3 THEN [] ELSE list_append(list_filter(s.recent, lambda x: x >= e.at - 3600), e.at) END,
CASE WHEN e.at >= s.until AND len(list_filter(s.recent, lambda x: x >= e.at - 3600)) + 1 >= 3 THEN e.at + 86400 ELSE s.until END, e.at < s.until FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1)
SELECT user_id AS key, event_id AS event, cooling FROM s WHERE k > 0""")
def streamed_rate_limits(t):
    """Three events of a user within an hour start a cooldown of a day."""
    events = t("events")
    spark = events.sparkSession
    path, checkpoint = files.scratch(spark, "limits"), files.scratch(spark, "limits-state")
    limits.append_to(limits.rate_limits(limits.stream_of(events), "user_id", "ts", "event_id", 3600.0, 3, 86400.0), path, checkpoint)
    return spark.read.schema("key long, event long, cooling boolean").parquet(path)
