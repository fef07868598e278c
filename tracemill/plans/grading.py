"""Answer extraction, grading, rollouts and rewards."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from tracemill.functions import boxed, compare, puzzle
from tracemill.operators import rank
from tracemill.plans.registry import query

KEY = "l_orderkey * 8 + l_linenumber"
#: Traces made of lineitem: nested, repeated, unclosed and missing boxes. The oracle builds the same strings.
TRACE_SQL = f"""SELECT l_orderkey, l_linenumber, l_quantity::INT AS gold, CASE ({KEY}) % 5 WHEN 0 THEN '<think>a</think> \\boxed{{' || l_quantity::INT || '}}'
WHEN 1 THEN 'x \\boxed{{1}} y \\boxed{{\\frac{{' || l_quantity::INT || '}}{{2}}}}' WHEN 2 THEN 'z \\boxed{{' || l_quantity::INT WHEN 3 THEN 'no box ' || l_quantity::INT ELSE '\\boxed{{}}' END AS trace FROM lineitem"""


def traces(t):
    k = F.expr(f"({KEY}) % 5")
    n = F.col("l_quantity").cast("int").cast("string")
    trace = F.when(k == 0, F.concat(F.lit("<think>a</think> \\boxed{"), n, F.lit("}"))).when(k == 1, F.concat(F.lit("x \\boxed{1} y \\boxed{\\frac{"), n, F.lit("}{2}}")))
    trace = trace.when(k == 2, F.concat(F.lit("z \\boxed{"), n)).when(k == 3, F.concat(F.lit("no box "), n)).otherwise("\\boxed{}")
    return t("lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("gold"), trace.alias("trace"))


def _case(*values: str) -> str:
    return " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values))


@query(f"""SELECT l_orderkey, l_linenumber, CASE ({KEY}) % 5 {_case("gold::VARCHAR", "'\\frac{' || gold || '}{2}'", "NULL", "NULL", "''")} END AS box FROM ({TRACE_SQL})""")
def boxed_last_balanced(t):
    return traces(t).select("l_orderkey", "l_linenumber", boxed.last_balanced(F.col("trace")).alias("box"))


@query(f"""SELECT l_orderkey, l_linenumber, CASE ({KEY}) % 5 {_case("gold::VARCHAR", "'1'", "NULL", "NULL", "''")} END AS first_box,
CASE ({KEY}) % 5 {_case("gold::VARCHAR", "'1'", "gold::VARCHAR", "NULL", "''")} END AS first_or_tail FROM ({TRACE_SQL})""")
def boxed_first_or_tail(t):
    c = F.col("trace")
    return traces(t).select("l_orderkey", "l_linenumber", boxed.first_balanced(c).alias("first_box"), boxed.first_or_tail(c).alias("first_or_tail"))


@query(f"""SELECT l_orderkey, l_linenumber, CASE ({KEY}) % 5 {_case("gold::VARCHAR", "'\\frac{' || gold", "gold::VARCHAR", "''", "''")} END AS flat,
CASE ({KEY}) % 5 {_case("gold::VARCHAR", "'\\frac{' || gold", "gold::VARCHAR", "gold::VARCHAR", "''")} END AS answer, ({KEY}) % 5 = 0 AS ok FROM ({TRACE_SQL})""")
def boxed_flat_and_fallback(t):
    """Flat regex extraction, the fallback chain (an empty box gives an empty answer) and well-formedness."""
    c = F.col("trace")
    answer = boxed.with_fallbacks(c)
    return traces(t).select("l_orderkey", "l_linenumber", boxed.last_flat(c).alias("flat"), answer.alias("answer"), boxed.well_formed(c).alias("ok"))


def _answers(t):
    gold = F.round(F.col("l_extendedprice"), 2)
    off = F.expr("l_orderkey % 4")
    pred = F.when(off == 0, gold).when(off == 1, gold * 1.005).when(off == 2, gold * 1.05).otherwise(gold + 1)
    return t("lineitem").select("l_orderkey", "l_linenumber", gold.alias("g"), pred.alias("p"), off.alias("k"))


ANSWERS_SQL = """SELECT l_orderkey, l_linenumber, round(l_extendedprice, 2) AS g, CASE l_orderkey % 4 WHEN 0 THEN round(l_extendedprice, 2) WHEN 1 THEN round(l_extendedprice, 2) * 1.005::DOUBLE
WHEN 2 THEN round(l_extendedprice, 2) * 1.05::DOUBLE ELSE round(l_extendedprice, 2) + 1 END AS p FROM lineitem"""


@query(f"""SELECT l_orderkey, l_linenumber, abs(p - g) <= greatest(0.01::DOUBLE * greatest(abs(p), abs(g)), 1e-5::DOUBLE) AS ok FROM ({ANSWERS_SQL})""")
def official_compare(t):
    ok = compare.official(F.col("p").cast("string"), F.col("g").cast("string"))
    return _answers(t).select("l_orderkey", "l_linenumber", ok.alias("ok"))


@query(f"""SELECT l_orderkey, l_linenumber, p = g OR abs(p - g) <= 1e-6::DOUBLE OR abs(p - g) <= 0.01::DOUBLE * abs(g) AS tolerant,
p = g OR abs(p - g) <= 0.01::DOUBLE * greatest(1, abs(g)) AS near FROM ({ANSWERS_SQL})""")
def tolerance_match(t):
    p, g = F.col("p").cast("string"), F.col("g").cast("string")
    return _answers(t).select("l_orderkey", "l_linenumber", compare.tolerant(p, g).alias("tolerant"), compare.lower_or_near(p, g).alias("near"))


@query("""WITH r AS (SELECT p_partkey, p_partkey % 3 AS k, p_size AS n, p_size + (p_partkey % 5 = 2)::INT AS m, CASE WHEN p_partkey % 7 = 3 THEN reverse(p_name) ELSE p_name END AS w, p_name, p_size * (1 + (p_partkey % 9) / 400.0)::DOUBLE AS x FROM part),
s AS (SELECT *, lpad(bin(m), 8, '0') AS bits FROM r)
SELECT p_partkey, CASE k WHEN 0 THEN bits = n::VARCHAR OR list_sum(list_transform(range(1, 9), lambda i: substr(bits, i, 1)::INT << (8 - i)::INT)) = n WHEN 1 THEN abs(x - n) <= greatest(0.01::DOUBLE * greatest(1.0::DOUBLE, n), 1e-4::DOUBLE)
 ELSE replace(lower(w), ' ', '') = replace(lower(p_name), ' ', '') END AS ok FROM s""")
def type_aware_verify(t):
    """Sizes in binary digits, some of another number; numbers that drift from theirs; and names in other case, some reversed."""
    part = F.col("p_partkey")
    k, n = part % 3, F.col("p_size")
    kind = F.when(k == 0, "bit").when(k == 1, "gravity").otherwise("cipher")
    bits = F.lpad(F.bin((n + F.when(part % 5 == 2, 1).otherwise(0)).cast("long")), 8, "0")
    name = F.upper(F.when(part % 7 == 3, F.reverse("p_name")).otherwise(F.col("p_name")))
    pred = F.when(k == 0, bits).when(k == 1, (n * (1 + (part % 9) / 400.0)).cast("string")).otherwise(name)
    gold = F.when(k == 2, F.concat(F.col("p_name"), F.lit("'"))).otherwise(n.cast("string"))
    return t("part").select("p_partkey", compare.by_type(pred, gold, kind).alias("ok"))


@query("""SELECT (SELECT count(*) FROM orders) AS n, count(*) FILTER (o_orderstatus = 'F') AS correct, round(count(*) FILTER (o_orderstatus = 'F') / (SELECT count(*) FROM orders), 6) AS score
FROM orders JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity > 45) ON o_orderkey = l_orderkey""")
def score_over_solution(t):
    """Correct submissions over all of the solution: unmatched rows count as wrong."""
    made = t("lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    joined = t("orders").select("o_orderkey", "o_orderstatus").join(made.withColumn("has", F.lit(1)), "o_orderkey", "left")
    ok = F.count_if((F.col("has") == 1) & (F.col("o_orderstatus") == "F"))
    return joined.agg(F.count(F.lit(1)).alias("n"), ok.alias("correct"), F.round(ok / F.count(F.lit(1)), 6).alias("score"))


GROUPS_SQL = "SELECT user_id, count(*) AS g, sum((event_type = 'purchase')::INT) AS c FROM events GROUP BY ALL"


def groups(t):
    return t("events").groupBy("user_id").agg(F.count(F.lit(1)).alias("g"), F.count_if(F.col("event_type") == "purchase").alias("c"))


@query(f"""SELECT CASE WHEN c = 0 THEN 'all_wrong' WHEN c = g THEN 'all_correct' ELSE 'mixed' END AS bucket, count(*) AS n, round(avg(c / g), 6) AS pass_rate FROM ({GROUPS_SQL}) GROUP BY ALL""")
def pass_rate_buckets(t):
    bucket = F.when(F.col("c") == 0, "all_wrong").when(F.col("c") == F.col("g"), "all_correct").otherwise("mixed")
    return groups(t).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("c") / F.col("g")), 6).alias("pass_rate"))


@query("""WITH e AS (SELECT *, count(*) FILTER (event_type = 'purchase') OVER (PARTITION BY user_id) AS c, count(*) OVER (PARTITION BY user_id) AS g FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY length(props), event_id) AS k FROM e WHERE c > 0 AND c < g AND event_type = 'purchase')
SELECT user_id, event_id, k AS rank FROM r WHERE k <= 2""")
def raft_shortest_k(t):
    """The two shortest correct samples of every mixed group."""
    own = Window.partitionBy("user_id")
    good = F.col("event_type") == "purchase"
    e = t("events").withColumn("c", F.sum(good.cast("int")).over(own)).withColumn("g", F.count(F.lit(1)).over(own))
    e = rank.numbered(e.where((F.col("c") > 0) & (F.col("c") < F.col("g")) & good), ["user_id"], [F.length("props"), F.col("event_id")], "k")
    return e.where("k <= 2").select("user_id", "event_id", F.col("k").cast("long").alias("rank"))


@query(f"SELECT user_id, round(greatest(0.1::DOUBLE, 1 - c / g), 6) AS weight FROM ({GROUPS_SQL})")
def curriculum_weight(t):
    return groups(t).select("user_id", F.round(puzzle.curriculum_weight(F.col("c") / F.col("g")), 6).alias("weight"))


@query("""SELECT event_id, coalesce(value, 0) - (sum(coalesce(value, 0)::DECIMAL(18, 4)) OVER w)::DOUBLE / count(*) OVER w AS advantage FROM events WINDOW w AS (PARTITION BY user_id)""")
def group_advantage(t):
    v = F.coalesce("value", F.lit(0.0))
    own = Window.partitionBy("user_id")
    mean = F.sum(v.cast("decimal(18,4)")).over(own).cast("double") / F.count(F.lit(1)).over(own)  # exact sums in any order
    return t("events").select("event_id", (v - mean).alias("advantage"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 2.5 WHEN l_returnflag = 'A' THEN 2.0 WHEN l_quantity > 10 THEN -0.5 ELSE -1.0 END::DOUBLE AS reward,
-greatest(0, least(1, (l_quantity - 20) / 20.0::DOUBLE)) AS penalty FROM lineitem""")
def rewards_and_penalty(t):
    reward = puzzle.combined_reward(F.col("l_returnflag") == "A", F.col("l_linestatus") == "F", F.col("l_quantity") > 10)
    return t("lineitem").select("l_orderkey", "l_linenumber", reward.cast("double").alias("reward"), puzzle.overlong_penalty(F.col("l_quantity"), 20, 40).alias("penalty"))


@query("""WITH c AS (SELECT conv_id, list('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) ORDER BY turn, role, text) AS m, arg_max(text, (turn, role, text)) AS last FROM conversations GROUP BY ALL)
SELECT conv_id, md5(array_to_string(m, '')) AS rendered, md5(last) AS last_text, len(m) AS n_turns FROM c""")
def chat_render(t):
    """ChatML rendering and last message of every conversation; a conversation is bounded by its own turns."""
    rows = t("conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    one = lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["text"], F.lit("<|im_end|>\n"))
    return rows.select("conv_id", F.md5(F.array_join(F.transform("m", one), "")).alias("rendered"), F.md5(F.element_at("m", -1)["text"]).alias("last_text"), F.size("m").cast("long").alias("n_turns"))


@query("""WITH o AS (SELECT l_orderkey, list(l_partkey::INT ORDER BY l_linenumber, l_partkey) AS ids FROM lineitem GROUP BY ALL)
SELECT l_orderkey, array_to_string(list_transform(range(1, len(ids) + 1), lambda i: CASE WHEN i <= 2 THEN '-100' ELSE ids[i]::VARCHAR END), ',') AS labels,
array_to_string(list_concat(ids, list_transform(range(0, greatest(0, 8 - len(ids))), lambda i: 0)), ',') AS padded FROM o""")
def mask_and_pad(t):
    o = t("lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", F.col("l_partkey").cast("int").alias("id")))).alias("r"))
    o = o.withColumn("ids", F.transform("r", lambda x: x["id"]))
    return o.select("l_orderkey", F.array_join(puzzle.mask_prefix(F.col("ids"), F.lit(2)), ",").alias("labels"), F.array_join(puzzle.pad_right(F.col("ids"), 8, 0), ",").alias("padded"))


@query("""WITH o AS (SELECT l_orderkey, list(l_quantity ORDER BY l_quantity DESC) AS q FROM lineitem GROUP BY ALL)
SELECT l_orderkey, round(list_sum(q[1:2]) / len(q[1:2]), 6) AS topk_loss FROM o""")
def topk_token_loss(t):
    o = t("lineitem").groupBy("l_orderkey").agg(F.collect_list("l_quantity").alias("q"))
    return o.select("l_orderkey", F.round(puzzle.topk_mean(F.col("q"), 2), 6).alias("topk_loss"))


@query("""WITH e AS (SELECT user_id, date_trunc('hour', ts) AS h, event_id, (event_type = 'purchase')::INT AS ok FROM events)
SELECT event_id, round(avg(ok) OVER (PARTITION BY user_id ORDER BY event_id), 6) AS running FROM e""")
def running_accuracy(t):
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    return t("events").select("event_id", F.round(F.avg((F.col("event_type") == "purchase").cast("int")).over(w), 6).alias("running"))


@query("""SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS last_hour FROM events""")
def rate_window(t):
    """Events of a user in the hour up to each event."""
    w = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-3_600_000_000, 0)
    return t("events").select("event_id", F.count(F.lit(1)).over(w).alias("last_hour"))


def _digit(n: Column, d: int) -> Column:
    return F.floor(n / d) % 10


@query("""WITH r AS (SELECT p_partkey, p_partkey % 3999 + 1 AS n FROM part), d AS (SELECT *, (['','M','MM','MMM'])[n // 1000 + 1] || (['','C','CC','CCC','CD','D','DC','DCC','DCCC','CM'])[n // 100 % 10 + 1]
|| (['','X','XX','XXX','XL','L','LX','LXX','LXXX','XC'])[n // 10 % 10 + 1] || (['','I','II','III','IV','V','VI','VII','VIII','IX'])[n % 10 + 1] AS roman FROM r) SELECT p_partkey, roman, n AS value FROM d""")
def roman_numerals(t):
    rows = t("part").select("p_partkey", puzzle.to_roman(F.col("p_partkey") % 3999 + 1).alias("roman"))
    return rows.withColumn("value", puzzle.from_roman(F.col("roman")).cast("long"))


@query("""SELECT p_partkey, lpad(bin((p_size * 5) % 256), 8, '0') AS bits, lpad(bin(xor(((x << 3) | (x >> 5)) & 255, 255 - x)), 8, '0') AS mixed FROM (SELECT *, ((p_size * 5) % 256)::BIGINT AS x FROM part)""")
def bit_transforms(t):
    x = ((F.col("p_size") * 5) % 256).cast("int")
    mixed = puzzle.rotate_left(x, 3).bitwiseXOR(F.bitwise_not(x).bitwiseAND(F.lit(255)))
    return t("part").select("p_partkey", puzzle.bits8(x).alias("bits"), puzzle.bits8(mixed).alias("mixed"))


@query("""SELECT l_partkey, round(avg(2 * l_extendedprice / (l_quantity * l_quantity)), 4) AS g, quantile_disc(l_extendedprice / l_quantity, 0.5) AS unit_factor FROM lineitem GROUP BY ALL""")
def gravity_and_unit_fit(t):
    """Mean of 2d/t^2 and the lower median of y/x over each group's examples."""
    d, x = F.col("l_extendedprice"), F.col("l_quantity")
    lower_median = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY l_extendedprice / l_quantity)")
    return t("lineitem").groupBy("l_partkey").agg(F.round(F.avg(2 * d / (x * x)), 4).alias("g"), lower_median.alias("unit_factor"))


RULES = (("add", "a + b"), ("sub", "a - b"), ("absdiff", "abs(a - b)"), ("mul", "a * b"), ("max", "greatest(a, b)"), ("min", "least(a, b)"))
EXAMPLES_SQL = """SELECT l_orderkey AS k, l_linenumber::BIGINT AS a, l_quantity::BIGINT AS b, CASE l_orderkey % 7 WHEN 0 THEN l_linenumber + l_quantity WHEN 1 THEN abs(l_linenumber - l_quantity)
WHEN 2 THEN l_linenumber * l_quantity WHEN 3 THEN greatest(l_linenumber, l_quantity) ELSE l_linenumber - l_quantity + (l_orderkey % 7 = 6)::INT * l_linenumber END::BIGINT AS y FROM lineitem"""


def _examples(t):
    sql = EXAMPLES_SQL.replace("::BIGINT", "").replace("(l_orderkey % 7 = 6)::INT", "int(l_orderkey % 7 = 6)")
    body = sql[len("SELECT ") : sql.index(" FROM lineitem")]
    rows = t("lineitem").selectExpr(*[x.strip() for x in body.split(", ", 3)[:3]], body.split(", ", 3)[3])
    return rows.select("k", *[F.col(c).cast("long").alias(c) for c in "aby"])


@query(f"""WITH e AS ({EXAMPLES_SQL}), r AS (SELECT k, {', '.join(f"bool_and({x} = y) AS {n}" for n, x in RULES)}, count(*) AS n FROM e GROUP BY ALL)
SELECT k, n, CASE {' '.join(f"WHEN {n} THEN '{n}'" for n, _ in RULES)} END AS rule, {' + '.join(f'{n}::INT' for n, _ in RULES)} AS fits FROM r""")
def rule_crossjoin_all_match(t):
    """The first rule of the library that every example of a problem obeys, all rules tested in one pass."""
    tests = [F.bool_and(F.expr(f"{x} = y")).alias(n) for n, x in RULES]
    r = _examples(t).groupBy("k").agg(*tests, F.count(F.lit(1)).alias("n"))
    rule, fits = None, F.lit(0)
    for n, _ in RULES:
        rule = F.when(F.col(n), n) if rule is None else rule.when(F.col(n), n)
        fits = fits + F.col(n).cast("int")
    return r.select("k", "n", rule.alias("rule"), fits.alias("fits"))


@query("""WITH w AS (SELECT n_name AS plain, translate(lower(n_name), 'abcdefghijklmnopqrstuvwxyz', 'defghijklmnopqrstuvwxyzabc') AS cipher FROM nation),
p AS (SELECT plain, cipher, unnest(range(1, length(plain) + 1)) AS i FROM w), m AS (SELECT substr(cipher, i, 1) AS c, lower(substr(plain, i, 1)) AS p FROM p)
SELECT c, min(p) AS p, count(*) AS n, count(DISTINCT p) = 1 AS consistent FROM m GROUP BY ALL""")
def cipher_map_bijective(t):
    """Letter map from word pairs, with the letters that map one way."""
    w = t("nation").select(F.lower("n_name").alias("plain")).withColumn("cipher", F.translate("plain", "abcdefghijklmnopqrstuvwxyz", "defghijklmnopqrstuvwxyzabc"))
    m = w.select(F.explode(F.arrays_zip(F.split("cipher", "").alias("c"), F.split("plain", "").alias("p"))).alias("z")).select("z.c", "z.p")
    return m.groupBy("c").agg(F.min("p").alias("p"), F.count(F.lit(1)).alias("n"), (F.count_distinct("p") == 1).alias("consistent"))
