"""Document fingerprints by a homomorphic multiset hash, in DataFrame functions only.

The hash of a text is the sum of wide vectors hashed from its paragraphs, so order of paragraphs does not matter and
a paragraph is inserted or deleted by adding or subtracting its vector. A paragraph's vector has two parts:

* 64 counters modulo 2**32: how many of its three-word shingles have each bit of a 64-bit hash set. With the number of
  shingles n, 2 * counter - n is a sum of random signs, whose angle to another text's estimates the share of shingles
  that both have;
* four 64-bit hashes of the exact paragraph, summed modulo 2**32, which tell apart what the counters cannot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.llm.common import WS_CLASS, cut, small_side

LANES = 32
EXACT = 4
#: Rows of a bucket of neighbouring ids, and the most buckets there are; a bucket is sorted in one task.
BUCKET_ROWS = 512
MAX_BUCKETS = 100_000
#: Slices of ids with about equal row counts, and the hexadecimal digits that rows without an id are dealt by.
SLICES = 128
NULL_DIGITS = 3
PAIR = (1 << 32) | 1
LOW = (1 << 32) - 1


def with_vectors(texts: DataFrame, keys: list[str], text_col: str = "_text") -> DataFrame:
    """keys and ``vec``: 64 counters, n, and the exact sums of each text. ``keys`` must tell rows apart.

    If the rows of a key are already in one partition, the sums need no shuffle. Null counts as empty.
    """
    paragraphs = texts.select(*keys, F.explode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("_p"))
    words = F.filter(F.split("_p", f"{WS_CLASS}+"), lambda w: w != "")
    exact = [F.xxhash64(F.lit(k), F.col("_p")).bitwiseAND(F.lit(LOW)).alias(f"_x{k}") for k in range(EXACT)]
    rows = paragraphs.select(*keys, words.alias("_w"), *exact)
    # A shingle that the paragraph cuts off is hashed from the words it has.
    shingles = F.transform("_w", lambda w, i: F.xxhash64(w, F.get("_w", i + 1), F.get("_w", i + 2)))
    rows = rows.select(*keys, *[f"_x{k}" for k in range(EXACT)], F.posexplode_outer(shingles).alias("_i", "_h"))
    first = F.coalesce(F.col("_i"), F.lit(0)) == 0
    sums = [F.coalesce(F.expr(f"sum(shiftrightunsigned(_h, {i}) & {PAIR}L)"), F.lit(0)).alias(f"_s{i}") for i in range(LANES)]
    sums += [F.sum(F.when(first, F.col(f"_x{k}")).otherwise(0)).alias(f"_y{k}") for k in range(EXACT)]
    out = rows.groupBy(*keys).agg(F.count("_h").alias("_units"), *sums)
    lanes = [F.col(f"_s{i}").bitwiseAND(F.lit(LOW)) for i in range(LANES)] + [F.shiftrightunsigned(f"_s{i}", 32) for i in range(LANES)]
    return out.select(*keys, F.array(*lanes, F.col("_units"), *[F.col(f"_y{k}").bitwiseAND(F.lit(LOW)) for k in range(EXACT)]).alias("vec"))


def add(a: Column, b: Column, sign: int = 1) -> Column:
    """Vector of the union (or, with sign -1, the difference) of two multisets of paragraphs."""
    return F.zip_with(a, b, lambda x, y: (x + sign * y).bitwiseAND(F.lit(LOW)))


def render(vec: Column) -> Column:
    """The fingerprint as a string: equal exactly for equal vectors."""
    return F.lower(F.array_join(F.transform(vec, F.hex), "."))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: 1 for equal vectors, else the cosine of the two sums of signs, 0 if either has no words."""
    n = 2 * LANES

    def signs(v: Column) -> Column:
        return F.transform(F.slice(v, 1, n), lambda x: (2 * x - F.element_at(v, n + 1)).cast("double"))

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)

    x, y = signs(a), signs(b)
    cosine = F.try_divide(dot(x, y), F.sqrt(dot(x, x) * dot(y, y)))
    return F.when(a == b, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(cosine, F.lit(0.0)))))


def _buckets(docs: DataFrame, id_col: str, text_col: str) -> tuple[Column, DataFrame]:
    """The bucket of a row, and (bucket, next bucket, next first id) of every bucket; the last leads to the first.

    Ids are cut at their approximate quantiles into slices of about equal row counts and each slice evenly into
    buckets, so a few far ids widen the buckets of their own slice only: whatever the ids, a bucket has about a
    SLICES-th of the rows at most, but for rows that share one id. Null ids come last, by the leading digits of
    their texts' hashes, which is the order that they have among themselves.
    """
    marks = [i / SLICES for i in range(1, SLICES)]
    found = docs.agg(F.min(id_col).alias("lo"), F.max(id_col).alias("hi"), F.count(id_col).alias("n"), F.percentile_approx(id_col, marks, 20 * SLICES).alias("cuts")).first()
    lo, hi, n = found["lo"] or 0, found["hi"] or 0, found["n"]
    cuts = sorted({c for c in found["cuts"] or [] if c > lo})
    bounds = [float(x) for x in (lo, *cuts, hi)]
    per = max(1, -(-min(n // BUCKET_ROWS, MAX_BUCKETS) // (len(cuts) + 1)))
    edges = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.lit(None).cast("array<bigint>")
    at = F.size(F.filter(edges, lambda e: e <= F.col(id_col))) if cuts else F.lit(0)
    begin, width = [F.get(F.array(*[F.lit(x) for x in xs]), at) for xs in (bounds[:-1], [max(1.0, y - x) for x, y in zip(bounds, bounds[1:])])]
    inside = F.floor((F.col(id_col).cast("double") - begin) * F.lit(float(per)) / width)
    last = (len(cuts) + 1) * per
    nulls = F.lit(last) + F.conv(F.substring(F.md5(text_col), 1, NULL_DIGITS), 16, 10).cast("long")
    bucket = F.when(F.col(id_col).isNull(), nulls).otherwise(at * F.lit(per) + F.least(F.lit(per - 1), F.greatest(F.lit(0), inside))).cast("long")
    firsts = docs.select(bucket.alias("_b"), F.col(id_col).alias("_id")).groupBy("_b").agg(F.min("_id").alias("_first"))
    order, all_rows = Window.orderBy("_b"), Window.partitionBy()
    firsts = firsts.withColumn("_lowest", F.min("_b").over(all_rows))
    firsts = firsts.select("_b", "_first", F.coalesce(F.lead("_b").over(order), F.col("_lowest")).alias("_nb"))
    return bucket, cut(firsts, "fp-buckets")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_chars, edited_sha256, vec, edited_vec, next_vec: fingerprints of each text, its edited text and the next one.

    The edited text has its last floor(n_chars / 4) code points replaced by the first as many (or all) of the next
    document's, in ascending id; the last one is followed by the first. Texts meet their neighbours in buckets of
    ids, shuffled once; at a bucket's end the first text of the next bucket, fetched apart, takes that place.

    Null texts count as empty. Null ids come last, repeated ids follow each other in order of their texts' hashes; a
    single row is its own neighbour; an empty input gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    bucket, firsts = _buckets(rows, "_id", "_text")
    order = Window.partitionBy("_b").orderBy(F.col("_id").asc_nulls_last(), F.md5("_text"))
    heads = small_side(firsts.select(F.col("_b").alias("_hb"), "_first"))
    heads = rows.withColumn("_b", bucket).join(heads, (F.col("_b") == F.col("_hb")) & F.col("_id").eqNullSafe(F.col("_first"))).groupBy("_hb").agg(F.min(F.struct(F.md5("_text"), F.col("_text"))).alias("_t"))
    heads = heads.join(firsts.select("_b", "_nb"), F.col("_hb") == F.col("_nb")).select(F.col("_b").alias("_lb"), F.col("_nb"), F.col("_t._text").alias("_head"))
    heads = cut(heads, "fp-heads")

    near = rows.withColumn("_b", bucket).withColumn("_rn", F.row_number().over(order)).withColumn("_lead", F.lead("_text").over(order))
    near = near.join(heads, F.col("_b") == F.col("_lb"), "left")
    n, last = F.length("_text"), F.col("_lead").isNull()
    k = F.floor(n / 4).cast("int")
    donor = F.coalesce(F.col("_lead"), F.col("_head"))
    start, donated = F.substring("_text", F.lit(1), n - k), F.substring(donor, F.lit(1), k)
    near = near.select(
        "_b", "_rn", "_id", n.cast("long").alias("_n"), start.alias("_start"), donated.alias("_donated"), F.substring("_text", n - k + 1, k).alias("_gone"),
        F.when(last, F.col("_nb")).otherwise(F.col("_b")).alias("_jb"),
        F.when(last, 1).otherwise(F.col("_rn") + 1).alias("_jr"),
    )
    # Both texts share the paragraphs before the edited one: these are hashed once, and each text adds its own end.
    near = near.withColumn("_tail", F.substring_index("_start", "\n", -1)).withColumn("_sha", F.unhex(F.sha2(F.concat("_start", "_donated"), 256)))
    shared = F.when(F.contains("_start", F.lit("\n")), F.substring("_start", F.lit(1), F.length("_start") - F.length("_tail") - 1))
    keys = ["_b", "_rn", "_id", "_n", "_sha", "_jb", "_jr", "_kind"]
    parts = near.select(*keys[:-1], F.posexplode(F.array(shared, F.concat("_tail", "_gone"), F.concat("_tail", "_donated"))).alias("_kind", "_text"))
    vectors = with_vectors(parts.where("_text IS NOT NULL"), keys)
    made = vectors.groupBy(*keys[:-1]).agg(*[F.max(F.when(F.col("_kind") == j, F.col("vec"))).alias(f"_v{j}") for j in range(3)])
    whole = [F.when(F.col("_v0").isNull(), F.col(v)).otherwise(add(F.col("_v0"), F.col(v))).alias(name) for v, name in (("_v1", "vec"), ("_v2", "edited_vec"))]
    made = made.select(*keys[:-1], *whole)
    made = cut(made, "fp-vectors")
    after = made.select(F.col("_b").alias("_b2"), F.col("_rn").alias("_r2"), F.col("vec").alias("next_vec"))
    out = made.join(after, (F.col("_jb") == F.col("_b2")) & (F.col("_jr") == F.col("_r2")))
    return out.select(F.col("_id").alias(id_col), F.col("_n").alias("n_chars"), F.lower(F.hex("_sha")).alias("edited_sha256"), "vec", "edited_vec", "next_vec")
