"""Chat adapters, caps, match modes, operations, operator groups, tensor names, ranks and router use."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracemill.functions import chat, classify, keys, parse, puzzle
from tracemill.operators import merge, ranks
from tracemill.plans.cases import cases_sql, with_cases
from tracemill.plans.registry import query

TEMPLATES = {"sums": "Add with care.\n{problem}\nEnd with \\boxed{}.", "general": "{problem}\nEnd with \\boxed{}."}
ADAPTERS = {
    "en": chat.Adapter("boxed", ("problem",), ("solution",)),
    "de": chat.Adapter("asked", ("problem", "question"), ("solution", "generated"), ("answer", "expected"), "In steps.", 20),
    "fr": chat.Adapter("contest", ("problem",), ("solution",), ("answer",), "With rigour.", category="sums"),
}


@query(r"""WITH d AS (SELECT doc_id, lang, text, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS s, (doc_id % 90)::VARCHAR AS a, CASE WHEN doc_id % 2 = 0 THEN 'sums' ELSE 'x' END AS c FROM documents WHERE text <> ''),
r AS (SELECT doc_id, 'boxed' AS source, c AS category, s, 'so \boxed{' || a || '}' AS cot, a FROM d WHERE lang = 'en'
UNION ALL SELECT doc_id, 'asked', c, s, CASE WHEN doc_id % 3 = 0 THEN 'Twenty letters and more.' ELSE 'In steps.' || chr(10) || 'Answer: ' || a END, a FROM d WHERE lang = 'de' AND doc_id % 3 < 2
UNION ALL SELECT doc_id, 'contest', 'sums', s, 'With rigour.' || chr(10) || 'Answer: ' || a, a FROM d WHERE lang NOT IN ('en', 'de') OR lang IS NULL)
SELECT doc_id, source, category, md5(CASE category WHEN 'sums' THEN 'Add with care.' || chr(10) ELSE '' END || s || chr(10) || 'End with \boxed{}.') AS asked,
'<think>' || chr(10) || cot || chr(10) || '</think>' || chr(10) || '\boxed{' || a || '}' AS said FROM r""")
def chat_adapters(t):
    """Three sources with other columns and rules become rows of one chat form; the rest of the languages are of the third."""
    docs, a = t("documents"), (F.col("doc_id") % 90).cast("string")
    kind = F.when(F.col("doc_id") % 2 == 0, "sums").otherwise("x")
    case = F.col("doc_id") % 3
    given = {
        "en": docs.where("lang = 'en'").select("doc_id", F.col("text").alias("problem"), F.concat(F.lit("<think>so \\boxed{"), a, F.lit("}</think> ")).alias("solution")),
        "de": docs.where("lang = 'de'").select("doc_id", F.lit("").alias("problem"), F.col("text").alias("question"), F.when(case == 0, "Twenty letters and more.").when(case == 2, "Too short.").alias("generated"), a.alias("expected")),
        "fr": docs.where("lang NOT IN ('en', 'de') OR lang IS NULL").select("doc_id", F.col("text").alias("problem"), F.concat(F.lit(" \\boxed{"), a, F.lit("} ")).alias("boxed"), a.alias("answer")),
    }
    parts = [chat.adapt(rows, ADAPTERS[name], kind, TEMPLATES, "general", ("doc_id",)) for name, rows in given.items()]
    made = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return made.select("doc_id", "source", "category", F.md5(F.col("messages")[0]["content"]).alias("asked"), F.col("messages")[1]["content"].alias("said"))


@query("""WITH l AS (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey, l_quantity) AS ids, list(CASE WHEN l_quantity < 20 THEN -100 ELSE l_partkey END ORDER BY l_linenumber, l_partkey, l_quantity) AS y FROM lineitem GROUP BY ALL),
k AS (SELECT * FROM l WHERE len(list_filter(y, lambda v: v <> -100)) > 0)
SELECT l_orderkey, 'drop' AS way, list_sum(ids)::BIGINT AS s, len(y)::INT AS n FROM k WHERE len(ids) <= 4 UNION ALL SELECT l_orderkey, 'cut', list_sum(ids[:4])::BIGINT, len(y[:4])::INT FROM k WHERE len(list_filter(y[:4], lambda v: v <> -100)) > 0""")
def training_caps(t):
    """Sequences of at most four tokens that have something to learn, longer ones left out or cut."""
    y = F.when(F.col("l_quantity") < 20, F.lit(-100).cast("long")).otherwise(F.col("l_partkey").cast("long"))
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_partkey").cast("long").alias("id"), "l_quantity", y.alias("y"))))
    seqs = t("lineitem").groupBy("l_orderkey").agg(rows.alias("r")).select("l_orderkey", F.col("r.id").alias("ids"), F.col("r.y").alias("y"))
    total = F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("s")
    parts = [chat.cap_tokens(seqs, "ids", "y", 4, way == "drop").select("l_orderkey", F.lit(way).alias("way"), total, F.size("y").alias("n")) for way in ("drop", "cut")]
    return parts[0].unionByName(parts[1])


@query("""WITH m AS (SELECT l_orderkey, l_linenumber, l_quantity > 25 AS a, l_linenumber % 2 = 0 AND l_linenumber <> 3 AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, a AND b AS "both", a AS answer, b AS boxed, a OR b AS either FROM m""")
def match_modes(t):
    """Every line under the four ways to call it right; the third line's box has no verdict."""
    a, b = F.col("l_quantity") > 25, F.when(F.col("l_linenumber") != 3, F.col("l_linenumber") % 2 == 0)
    return t("lineitem").select("l_orderkey", "l_linenumber", *[classify.matched(m, a, b).alias(m) for m in ("both", "answer", "boxed", "either")])


PROMPTS = [
    ("In Alice's Wonderland, equations change. now, determine the result for: 34@21",),
    ("In Alice's Wonderland, equations change: 1+2. now, determine the result for: 3421 ",),
    ("ALICE in WONDERLAND: Equations. Now, determine the result for: 5",),
    ("Write the Roman form",), ("A decrypt task with mass",), ("The mass of a planet",), ("Convert 5 liter",), ("Convert 5",), ("An 8-bit word",), ("",),
]


@query(f"""WITH p AS (SELECT p_partkey, x, lower(x) AS w FROM {cases_sql("part", "p_partkey", PROMPTS, "x")})
SELECT p_partkey, CASE WHEN regexp_matches(w, 'alice') AND regexp_matches(w, 'wonderland') AND regexp_matches(w, 'equations')
THEN CASE WHEN regexp_matches(string_split(x, 'now, determine the result for:')[-1], '[[:punct:]]') THEN 'equation_symbolic' ELSE 'equation_numeric' END
WHEN regexp_matches(w, 'roman') THEN 'numeral' WHEN regexp_matches(w, 'cipher|encrypted|decrypt') THEN 'cipher' WHEN regexp_matches(w, 'gravity|planet|mass') THEN 'gravity'
WHEN regexp_matches(w, 'convert') AND regexp_matches(w, 'unit|meter|gram|liter') THEN 'unit_conversion' WHEN regexp_matches(w, 'bit|binary') THEN 'bit_manipulation' ELSE 'other' END AS family FROM p""")
def task_families(t):
    return with_cases(t("part"), "p_partkey", PROMPTS, "x").select("p_partkey", classify.task_family(F.col("x")).alias("family"))


@query("""WITH x AS (SELECT p_partkey, p_partkey * 37 % 1000 AS a, p_size % 13 AS b FROM part), f AS (SELECT *, reverse(a::VARCHAR)::BIGINT AS ra, reverse(b::VARCHAR)::BIGINT AS rb,
list_sum(list_transform(string_split(a::VARCHAR, ''), lambda d: d::BIGINT)) AS da, list_sum(list_transform(string_split(b::VARCHAR, ''), lambda d: d::BIGINT)) AS db FROM x),
o AS (SELECT p_partkey, unnest(['sub', 'sub_abs', 'add', 'mul', 'rev_a_mul_rev_b_then_rev', 'rev_a_sub_rev_b', 'rev_a_add_rev_b', 'digit_sum_sub', 'digit_sum_add', 'digit_sum_mul', 'concat_ab', 'concat_ba', 'mod', 'floor_div']) AS op,
unnest([a - b, abs(a - b), a + b, a * b, reverse((ra * rb)::VARCHAR)::BIGINT, ra - rb, ra + rb, da - db, da + db, da * db, (a::VARCHAR || b::VARCHAR)::BIGINT, (b::VARCHAR || a::VARCHAR)::BIGINT, CASE WHEN b <> 0 THEN a % b END, CASE WHEN b <> 0 THEN a // b END]) AS result FROM f)
SELECT p_partkey, op, result::BIGINT AS result FROM o""")
def numeric_operations(t):
    """Fourteen operations on two numbers, also by 0 and with ending zeros."""
    made = puzzle.numeric_operations(F.col("p_partkey") * 37 % 1000, F.col("p_size") % 13)
    return t("part").select("p_partkey", F.explode(made).alias("m")).select("p_partkey", "m.op", F.col("m.result").cast("long").alias("result"))


@query("""WITH e AS (SELECT p_partkey, unnest([1, 2, 3, 4]) AS k, unnest(['+', '-', CASE WHEN p_size % 2 = 0 THEN '+' ELSE '*' END, NULL]) AS op, p_size FROM part)
SELECT p_partkey, op, count(*) AS n, string_agg((p_size + k) || ',' || k || ',' || (p_size * k), ';' ORDER BY k) AS examples FROM e WHERE op IS NOT NULL GROUP BY p_partkey, op""")
def examples_by_operator(t):
    """The lines of a prompt grouped by their operator, in page order; lines of another form count for none."""
    size = F.col("p_size")
    ops = (F.lit("+"), F.lit("-"), F.when(size % 2 == 0, "+").otherwise("*"), F.lit(" and "))
    lines = [F.concat((size + k).cast("string"), op, F.lit(f"{k} = "), (size * k).cast("string")) for k, op in enumerate(ops, 1)]
    rows = t("part").select("p_partkey", F.posexplode(parse.equations(F.concat_ws("\n", *lines))).alias("k", "e"))
    parsed = rows.select("p_partkey", "k", parse.operands(F.col("e.x")).alias("x"), F.col("e.y").alias("out")).where("x IS NOT NULL")
    one = F.struct("k", F.concat_ws(",", "x.a", "x.b", "out").alias("s"))
    grouped = parsed.groupBy("p_partkey", F.col("x.op").alias("op")).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(one)).alias("all"))
    return grouped.select("p_partkey", "op", "n", F.concat_ws(";", "all.s").alias("examples"))


@query("""WITH k AS (SELECT p_partkey AS p, p_size % 3 AS w, p_size % 4 AS n, 'layers.' || p_partkey AS m FROM part), e AS (SELECT *, unnest(range(0, CASE WHEN w = 0 THEN 1 ELSE n END)) AS i FROM k)
SELECT p, 'base_model.model.backbone.' || m || CASE w WHEN 0 THEN '.experts.w0' WHEN 1 THEN '.experts.' || i || '.up_proj' ELSE '.experts.' || i || '.down_proj' END || '.lora_A.default.weight' AS key,
'model.' || m || '.experts.w' || w AS path, 'A' AS side FROM e""")
def adapter_keys(t):
    """Names of adapter tensors under the new root, one per expert of a fused one, with module and side of the old name."""
    key = F.concat(F.lit("base_model.model.model.layers."), F.col("p_partkey").cast("string"), F.lit(".experts.w"), (F.col("p_size") % 3).cast("string"), F.lit(".lora_A.default.weight"))
    rows = t("part").select(F.col("p_partkey").alias("p"), key.alias("old"), (F.col("p_size") % 4).alias("experts"))
    names = F.explode(keys.expert_keys(keys.backbone_key(F.col("old")), F.col("experts"))).alias("key")
    return rows.select("p", names, keys.module_path(F.col("old")).alias("path"), keys.adapter_side(F.col("old")).alias("side"))


@query("""WITH v AS (SELECT l_suppkey AS b, l_returnflag AS c, l_extendedprice::DOUBLE * CASE l_returnflag WHEN 'A' THEN 1.5 WHEN 'N' THEN 0.25 ELSE 1 END AS w, row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS k FROM lineitem),
f AS (SELECT b, count(*) AS u FROM v WHERE k <= 4 GROUP BY b), r AS (SELECT *, row_number() OVER (PARTITION BY b, k <= 4 ORDER BY w DESC, c, k) AS o FROM v JOIN f USING (b))
SELECT b AS block, c AS component, count(*) FILTER (k <= 4 OR o <= 60 - u) AS rank FROM r GROUP BY ALL""")
def allocated_ranks(t):
    """Sixty ranks for each supplier, four at least for each component, the rest by weighted value."""
    order = Window.partitionBy("l_suppkey", "l_returnflag").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    rows = t("lineitem").select(F.col("l_suppkey").alias("block"), F.col("l_returnflag").alias("component"), (F.row_number().over(order) - 1).alias("place"), F.col("l_extendedprice").cast("double").alias("value"))
    # A value has those before it in its component before it in its block too: one that 60 precede gets none of 60 ranks.
    rows = rows.where("place < 60")
    return ranks.allocate_ranks(rows, "block", "component", "place", "value", 60, 4, {"A": 1.5, "N": 0.25})


@query("""WITH x AS (SELECT vec_id, unnest(range(0, 64)) AS i, unnest(embedding::DOUBLE[]) AS v FROM embeddings), r AS (SELECT i, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, i) AS k FROM x),
p AS (SELECT i, count(*) AS n FROM r WHERE k <= 6 GROUP BY i), e AS (SELECT g.i, coalesce(n, 0) AS n FROM range(0, 64) AS g(i) LEFT JOIN p USING (i))
SELECT i::INT AS expert, n AS picks, n / (sum(n) OVER ())::DOUBLE AS share FROM e""")
def router_use(t):
    """How often each of 64 experts is among the six that a row's scores pick."""
    return ranks.router_use(t("embeddings").select(F.col("embedding").cast("array<double>").alias("scores")), "scores", 64, 6)


#: Cells of three sources: every third vector is a source's row, tensors are every fourth dimension; values are whole, so that sums are exact.
_CELLS = "SELECT vec_id % 3 AS source, vec_id // 3 AS line, i AS place, i % 4 AS tensor, round(embedding[i + 1]::DOUBLE * 10000)::BIGINT AS v FROM embeddings, range(64) r(i) WHERE i < len(embedding)"


def _cells(t):
    e = t("embeddings").select("vec_id", F.posexplode("embedding").alias("place", "x"))
    return e.select(F.expr("vec_id % 3").alias("source"), F.expr("vec_id div 3").alias("line"), F.col("place").cast("long").alias("place"), F.expr("place % 4").cast("long").alias("tensor"), F.round(F.col("x").cast("double") * 10000).cast("long").alias("v"))


@query(f"""WITH c AS ({_CELLS}), k AS (SELECT source, tensor, ceil(count(*) * 0.2::DOUBLE)::BIGINT AS k FROM c GROUP BY ALL),
r AS (SELECT c.*, abs(v) AS size, row_number() OVER (PARTITION BY source, tensor ORDER BY abs(v) DESC) AS rn FROM c),
l AS (SELECT r.source, r.tensor, r.size AS least FROM r JOIN k ON r.source = k.source AND r.tensor = k.tensor AND r.rn = k.k),
t AS (SELECT r.line, r.place, r.v FROM r JOIN l USING (source, tensor) WHERE size >= least),
s AS (SELECT line, place, sum(v) AS total FROM t GROUP BY ALL)
SELECT line, place, round(avg(v), 6) AS v FROM t JOIN s USING (line, place) WHERE total <> 0 AND sign(v) = sign(total) GROUP BY ALL""")
def trimmed_sign_merge(t):
    """The largest fifth of every source's tensors, cells merged by the mean of the values with the elected sign."""
    kept = merge.trimmed(_cells(t), ["source", "tensor"], "v", 0.2)
    return merge.elected(kept, ["line", "place"], "v").select("line", "place", F.round("v", 6).alias("v"))


@query(f"""SELECT line, place, round(sum(v / 0.7::DOUBLE * CASE source WHEN 0 THEN 0.5::DOUBLE ELSE 0.25::DOUBLE END), 6) AS v FROM ({_CELLS}) WHERE substr(md5('7:' || source || ':' || line || ':' || place), 1, 8) >= '{int(0.3 * 16**8):08x}' GROUP BY ALL""")
def dropped_linear_merge(t):
    """Three in ten cells of every source dropped, the rest scaled up and added by weight."""
    kept = merge.dropped(_cells(t), ["source", "line", "place"], "v", 0.3, seed=7)
    return merge.linear(kept, ["line", "place"], "v", F.when(F.col("source") == 0, 0.5).otherwise(0.25)).select("line", "place", F.round("v", 6).alias("v"))
