"""Rank allocation against the greedy rule, match modes and caps on edge rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tracemill.functions import chat, classify, keys
from tracemill.operators import merge, ranks


def greedy(parts, total, least, priority):
    rank = {c: min(least, len(v)) for c, v in parts.items()}
    while sum(rank.values()) < total:
        left = [(-v[rank[c]] * priority.get(c, 1.0), c) for c, v in parts.items() if rank[c] < len(v)]
        if not left:
            break
        rank[min(left)[1]] += 1
    return rank


@pytest.mark.parametrize("total,least", [(0, 0), (3, 1), (6, 1), (7, 2), (50, 0), (2, 2)])
def test_ranks_are_greedy(spark, total, least):
    parts = {"a": [9.0, 4.0, 4.0, 1.0], "b": [8.0, 8.0], "c": [4.0, 4.0, 0.0]}
    priority = {"b": 0.5}
    rows = [("x", c, i, v) for c, vs in parts.items() for i, v in enumerate(vs)] + [("x", "a", 9, None)]
    made = ranks.allocate_ranks(spark.createDataFrame(rows, "b string, c string, i int, v double"), "b", "c", "i", "v", total, least, priority)
    assert {r["c"]: r["rank"] for r in made.collect()} == greedy(parts, total, least, priority)


def test_router_counts_unused_experts_and_ties(spark):
    logits = spark.createDataFrame([([1.0, 1.0, 0.0],), ([0.0, None, 2.0],), (None,)], "s array<double>")
    assert {r["expert"]: r["picks"] for r in ranks.router_use(logits, "s", 4, 1).collect()} == {0: 1, 1: 0, 2: 1, 3: 0}
    assert all(r["share"] == 0 for r in ranks.router_use(logits.limit(0), "s", 2, 1).collect())


def test_unknown_mode_is_refused(spark):
    with pytest.raises(ValueError):
        classify.matched("any", F.lit(True), F.lit(True))


def test_caps_leave_out_rows_without_labels(spark):
    rows = spark.createDataFrame([(1, [1, 2, 3], [-100, -100, 3]), (2, [1], [-100]), (3, [1, 2], [1, 2]), (4, [], []), (5, None, None)], "k int, ids array<int>, y array<int>")
    assert [r["k"] for r in chat.cap_tokens(rows, "ids", "y", 2, True).collect()] == [3]
    assert [r["k"] for r in chat.cap_tokens(rows, "ids", "y", 2, False).collect()] == [3]


def test_other_keys_and_nulls(spark):
    rows = spark.createDataFrame([("plain", 2), (None, 2), ("m.experts.w2.x", 0), ("m.experts.w2.x", 2)], "k string, n int")
    got = [tuple(r) for r in rows.select(keys.expert_keys(F.col("k"), F.col("n")), keys.module_path(F.col("k")), keys.adapter_side(F.col("k"))).collect()]
    assert got == [(["plain"], None, None), (None, None, None), ([], None, None), (["m.experts.0.down_proj.x", "m.experts.1.down_proj.x"], None, None)]


def test_thresholds_by_histograms_are_the_kth_largest(spark, monkeypatch):
    monkeypatch.setattr(merge, "BINS", 4)
    rng = random.Random(6)
    groups = {
        "spread": [rng.uniform(0, 1) ** 8 * 1e6 for _ in range(300)],
        "ties": [float(rng.randint(0, 3)) for _ in range(200)],
        "one": [5.0],
        "equal": [2.0] * 50,
        None: [-1e308, 1e308, 0.0, 1e-300, 3.0],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("one", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    for share in (0.01, 0.2, 0.5, 1.0):
        got = {r["g"]: r["threshold"] for r in merge.kth_largest(df, ["g"], F.col("v"), share).collect()}
        assert got == {g: sorted(vs, reverse=True)[math.ceil(len(vs) * share) - 1] for g, vs in groups.items()}


def test_merges_of_small_adapters(spark):
    rng = random.Random(9)
    rows = [(s, c, rng.randint(-9, 9)) for s in range(3) for c in range(40)]
    df = spark.createDataFrame(rows, "source long, cell long, v long")
    kept = []
    for s in range(3):
        own = [(abs(v), c, v) for t, c, v in rows if t == s]
        least = sorted((a for a, *_ in own), reverse=True)[math.ceil(40 * 0.3) - 1]
        kept += [(s, c, v) for a, c, v in own if a >= least]
    trimmed = merge.trimmed(df, ["source"], "v", 0.3)
    assert sorted(tuple(r) for r in trimmed.select("source", "cell", "v").collect()) == sorted(kept)
    want = {}
    for c in range(40):
        vs = [v for _, d, v in kept if d == c]
        sign = (sum(vs) > 0) - (sum(vs) < 0)
        if sign:
            same = [v for v in vs if v * sign > 0]
            want[c] = sum(same) / len(same)
    assert {r["cell"]: r["v"] for r in merge.elected(trimmed, ["cell"], "v").collect()} == pytest.approx(want)
    some = merge.dropped(df, ["source", "cell"], "v", 0.25).collect()
    assert len(some) < len(rows) and all(r["v"] == dict(((s, c), v) for s, c, v in rows)[r["source"], r["cell"]] / 0.75 for r in some)
