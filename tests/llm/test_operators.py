"""The corpus operators against plain versions, with nulls, blanks, ties, repeats, long texts and empty tables."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracemill.llm import exact_dedup, fingerprints, html_extract, line_dedup, mixing, ngram_join, quality, secrets, sharding, textarrays
from tracemill.llm.bpe import SpeculativeBPE, bpe_round_trip
from tracemill.llm.queries import bpe_vocab_path

SCHEMA = "doc_id long, text string, source string, _n string, id string"
RNG = random.Random(5)
VOCABULARY = ["".join(RNG.choice("abcdefghij") for _ in range(RNG.randint(2, 7))) for _ in range(300)]


def prose(n, rng):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def corpus():
    rng = random.Random(11)
    base = [prose(rng.randint(1, 60), rng) for _ in range(40)]
    texts = [*base, *base[:6], None, "", " \t\n", None, "one", "One", "a  b", "a b"]
    long = prose(4000, rng)
    texts += [long, long + " end"]
    for t in base[:12]:  # near copies
        w = t.split()
        w[len(w) // 2] = "edited"
        texts.append(" ".join(w))
    texts += ["shared line\n" + prose(20, rng) for _ in range(8)]
    return [(i * 3, t, None if i % 9 == 0 else f"s{i % 4}", "x", "y") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def duck(sql, rows):
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows], "source": [r[2] for r in rows]}))
    r = con.execute(sql)
    names = [d[0] for d in r.description]
    return sorted(tuple(x[names.index(c)] for c in sorted(names)) for x in r.fetchall())


def got(df):
    return sorted(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())


def test_exact_dedup(docs, rows, empty):
    want = duck(exact_dedup.ORACLE_SQL, rows)
    assert got(exact_dedup.exact_dedup(docs)) == want
    assert got(exact_dedup.exact_dedup(docs, hex_digits=1)) == want  # all groups collide, the bytes tell them apart
    assert exact_dedup.exact_dedup(empty).count() == 0


@pytest.mark.parametrize("hex_digits", [32, 1])
def test_exact_dedup_of_hot_groups_and_null_and_repeated_ids(spark, monkeypatch, hex_digits):
    monkeypatch.setattr(exact_dedup, "HOT_ROWS", 3)
    data = [(i, "the same  text" if i % 3 else "the same text") for i in range(40)]
    data += [(None, "the same text"), (None, None), (None, ""), (90, "twice"), (90, "twice"), (91, "twice"), (92, "thing"), (92, "other")]
    made = exact_dedup.exact_dedup(spark.createDataFrame(data, "doc_id long, text string"), hex_digits=hex_digits)
    want = []
    for i, t in data:
        group = [(j, u or "") for j, u in data if (u or "").replace(" ", "") == (t or "").replace(" ", "")]
        best = min(group, key=lambda g: (-len(g[1]), g[0] is None, g[0] or 0))
        sha = hashlib.sha256((t or "").replace(" ", "").encode()).hexdigest()
        want.append((i, best[0], len(group), i == best[0] and len(t or "") == len(best[1]), sha))
    key = lambda r: tuple((v is None, v) for v in r)
    out = [tuple(r) for r in made.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()]
    assert sorted(out, key=str) == sorted(want, key=str) and sorted(map(key, out), key=str) == sorted(map(key, want), key=str)


def test_line_dedup(docs, rows, empty):
    made = line_dedup.drop_boilerplate(docs)
    assert set(docs.columns) < set(made.columns)
    key = lambda x: [(v is None, str(v)) for v in x]
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows], "source": [r[2] for r in rows]}))
    want = con.execute(f"SELECT doc_id, text, n_lines, n_dropped FROM ({line_dedup.ORACLE_SQL})").fetchall()
    out = [tuple(r) for r in made.select("doc_id", "text", "n_lines", "n_dropped").collect()]
    assert sorted(out, key=key) == sorted(want, key=key)
    assert line_dedup.drop_boilerplate(empty).count() == 0


def test_mixing(docs, rows, empty):
    made = mixing.mix(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
    assert got(made) == duck(mixing.ORACLE_SQL, rows)
    totals = {r["source_size"]: r["target"] for r in made.collect()}
    assert abs(sum(totals.values()) - 1.5 * sum(totals)) < 1e-6 and all(t <= 2 * s for s, t in totals.items())
    assert mixing.mix(empty).count() == 0


def test_sharding(docs, rows, empty):
    made = sharding.shard_rows(docs).toPandas()
    counts = made.groupby("shard").size().reindex(range(16), fill_value=0)
    assert len(made) == len(rows) and counts.max() - counts.min() <= 1
    for _, g in made.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    text = dict((r[0], r[1] or "") for r in rows)
    assert all(made["size"] == [len(text[i].encode()) + 1 for i in made["doc_id"]])
    spread = made.assign(t=made["doc_id"].map(text)).groupby("t")["shard"].nunique()
    assert (spread > 1).sum() <= 1  # groups stay together as far as the quotas of so few rows let them
    assert sharding.shard_rows(empty).count() == 0


def test_sharding_hot_group(spark):
    df = spark.createDataFrame([(i, "same" if i % 3 == 0 else f"t{i}") for i in range(300)], "doc_id long, text string")
    made = sharding.shard_rows(df).toPandas()
    counts = made.groupby("shard").size()
    assert len(counts) == 16 and counts.max() - counts.min() <= 1


def test_sharding_gathers_groups(spark):
    hot = spark.createDataFrame([(i, "same" if i % 3 == 0 else f"t{i}") for i in range(3000)], "doc_id long, text string")
    made = sharding.shard_rows(hot).toPandas()
    assert made[made["doc_id"] % 3 == 0]["shard"].nunique() <= 7  # a third of the rows needs six of 16 shards
    pairs = spark.createDataFrame([(i, f"t{i // 2}") for i in range(1000)], "doc_id long, text string")
    made = sharding.shard_rows(pairs).toPandas()
    assert (made.groupby(made["doc_id"] // 2)["shard"].nunique() > 1).sum() <= 20


def test_fingerprints(spark, docs, rows, empty):
    made = fingerprints.edited_fingerprints(docs).select("*", fingerprints.render(F.col("vec")).alias("f")).toPandas().set_index("doc_id")
    order = sorted(rows)
    texts = [r[1] or "" for r in order]
    whole = []
    for k, r in enumerate(order):
        own, after = texts[k], texts[(k + 1) % len(texts)]
        cut = len(own) // 4
        edited = own[: len(own) - cut] + after[:cut]
        assert made.loc[r[0], "edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert list(made.loc[r[0], "next_vec"]) == list(made.loc[order[(k + 1) % len(order)][0], "vec"])
        whole += [(2 * r[0], own), (2 * r[0] + 1, edited)]
    plain = {r["k"]: r["vec"] for r in fingerprints.with_vectors(spark.createDataFrame(whole, "k int, _text string"), ["k"]).collect()}
    assert all(list(made.loc[r[0], "vec"]) == plain[2 * r[0]] and list(made.loc[r[0], "edited_vec"]) == plain[2 * r[0] + 1] for r in order)
    by_text = {}
    for r, t in zip(order, texts, strict=True):
        by_text.setdefault(t, set()).add(made.loc[r[0], "f"])
    assert all(len(v) == 1 for v in by_text.values()) and len({f for v in by_text.values() for f in v}) == len(by_text)
    assert fingerprints.edited_fingerprints(empty).count() == 0
    parts = spark.createDataFrame([(0, "a b c\nd e"), (1, "d e\na b c"), (2, "a b c"), (3, "d e")], "k int, _text string")
    v = {r["k"]: r["vec"] for r in fingerprints.with_vectors(parts, ["k"]).collect()}
    assert v[0] == v[1] and [(x + y) % 2**32 for x, y in zip(v[2], v[3], strict=True)] == v[0]


@pytest.mark.parametrize("width", [1, 4])
def test_fingerprints_of_far_null_and_repeated_ids(spark, monkeypatch, width):
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", width)
    rng = random.Random(3)
    ids = [*range(30), 5, 5, 2**62, 2**63 - 1, -(2**63), -(2**40), None, None, None]
    data = [(i, prose(rng.randint(1, 30), rng)) for i in ids] + [(None, None)]
    table = spark.createDataFrame(data, "doc_id long, text string")
    order = sorted(data, key=lambda r: (r[0] is None, r[0] or 0, hashlib.md5((r[1] or "").encode()).hexdigest()))
    want = []
    for k, (i, t) in enumerate(order):
        own, after = t or "", order[(k + 1) % len(order)][1] or ""
        gone = len(own) // 4
        want.append((str(i), len(own), hashlib.sha256((own[: len(own) - gone] + after[:gone]).encode()).hexdigest()))
    made = fingerprints.edited_fingerprints(table).select("doc_id", "n_chars", "edited_sha256").collect()
    assert sorted((str(r[0]), r[1], r[2]) for r in made) == sorted(want)
    one = fingerprints.edited_fingerprints(spark.createDataFrame([(7, "a b c d")], "doc_id long, text string")).collect()
    assert [(r["doc_id"], r["vec"] == r["next_vec"]) for r in one] == [(7, True)]
    bucket, _ = fingerprints._buckets(table.where("doc_id IS NOT NULL"), "doc_id", "text")
    sizes = [r["count"] for r in table.where("doc_id IS NOT NULL").groupBy(bucket).count().collect()]
    assert max(sizes) <= 5  # 5 comes three times; far ids do not gather the others


def brute_components(rows):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(fold))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return sorted((find(i), i, len(s)) for i, s in sets.items())


def test_ngram_join(docs, rows, empty):
    assert sorted((c, i, n) for i, n, c in map(tuple, ngram_join.near_components(docs).collect())) == brute_components(rows)
    assert ngram_join.near_components(empty).count() == 0


def test_ngram_join_edits_and_frequent_shingles(spark, monkeypatch):
    rng = random.Random(3)
    common, out = prose(60, rng), []
    for i in range(70):
        w = (prose(rng.randint(4, 90), rng) + (" " + common if i % 2 else "")).split()
        out.append((len(out), " ".join(w)))
        for _ in range(rng.randint(0, 2)):
            x = list(w)
            for _ in range(max(1, len(x) // 40)):
                x[rng.randrange(len(x))] = rng.choice(VOCABULARY)
            out.append((len(out), " ".join(x)))
    monkeypatch.setattr(ngram_join, "OFTEN", 10)
    df = spark.createDataFrame(out, "doc_id long, text string")
    assert sorted((c, i, n) for i, n, c in map(tuple, ngram_join.near_components(df).collect())) == brute_components(out)


def test_bpe(docs, rows, empty):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe_vocab_path())
    made = {r["doc_id"]: r for r in bpe_round_trip(docs, bpe_vocab_path()).collect()}
    for i, t, *_ in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(made[i]["ids"], "<u4").tolist() == ids and made[i]["decoded"] == lib.decode(ids, skip_special_tokens=False)
    assert bpe_round_trip(empty, bpe_vocab_path()).count() == 0


def test_bpe_pairs_and_odd_texts():
    from tokenizers import Tokenizer

    bpe, lib = SpeculativeBPE(bpe_vocab_path()), Tokenizer.from_file(bpe_vocab_path())
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 50256, 3000), rng.integers(0, 50256, 3000)
    ok = bpe.compatible(a, b)
    assert all((bpe.merge(bpe.token_bytes[x] + bpe.token_bytes[y]) == [x, y]) == o for x, y, o in zip(a.tolist(), b.tolist(), ok.tolist(), strict=True))
    bits = ["a", " ", "  ", "\n", "é", "<|endoftext|>", "'s", "1", "中", "😀", "\x85", "the", "x" * 90, "!!", "𠀀", "՘"]
    pick = random.Random(2)
    texts = ["".join(pick.choice(bits) for _ in range(pick.randint(0, 25))) for _ in range(1500)]
    for t, ids in zip(texts, bpe.encode_batch(texts), strict=True):
        want = lib.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want and bpe.decode(ids) == lib.decode(want, skip_special_tokens=False)


def test_html(spark):
    page = (
        "<html><head><title>x</title></head><body><header><h1>Site</h1></header><div id='cookie-notice'>We use</div><aside>Side</aside><main>"
        "<article><h1>Title {0}</h1><p>A <a href=x>li</a>nk &amp; b<p>Second<script>x</p></script> bit&nbsp;here<ul><li>one<li>two {0}</ul>"
        "<form>f</form><section class='comments'>c<p>d</section></article></main><footer>F</footer></body>"
    )
    rows = [(i, "http://h.example/1" if i < 3 else "http://g.example/1", page.format(i)) for i in range(4)]
    rows += [(4, None, None), (5, "", ""), (6, "http://k.example", "plain  text &lt; tags")]
    made = html_extract.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string"))
    text = {r["page_id"]: r["text"] for r in made.collect()}
    assert all(text[i] == f"Title {i} A link & b Second bit here one two {i}" for i in range(4))
    assert (text[4], text[5], text[6]) == ("", "", "plain text < tags")
    assert html_extract.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def extracted(spark, rows):
    made = html_extract.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string"))
    return {r["page_id"]: r["text"] for r in made.collect()}


def test_html_constant_text_is_dropped_and_all_slots_stay(spark):
    named = "<body><article><h1>T{0}</h1><p>Text {0}</p><div class='x'>Read our terms</div><p>Buy now</p></article></body>"
    plain = "<body><div class='a'><p>Left {0}</p></div><div class='c'><p>Always here</p></div><div class='b'><p>Right {0}</p></div></body>"
    rows = [(i, "http://a.example/1", named.format(i)) for i in range(6)] + [(10 + i, "http://b.example/1", plain.format(i)) for i in range(6)]
    rows += [(20 + i, "http://c.example/1", named.format(0)) for i in range(6)]  # copies are one page
    text = extracted(spark, rows)
    assert all(text[i] == f"T{i} Text {i}" and text[10 + i] == f"Left {i} Right {i}" for i in range(6))
    assert all(text[20 + i] == "T0 Text 0 Read our terms Buy now" for i in range(6))


def test_html_every_page_of_a_host_counts(spark):
    long = "<body><main>" + "<h2>h</h2><p>x</p>" * 1200 + "</main></body>"
    rows = [(0, "http://a.example/1", long)]
    rows += [(i, "http://a.example/1", f"<body><main><p>Short</p></main><article><p>Body {i}</p></article><div class='z'>Fixed</div></body>") for i in range(1, 9)]
    text = extracted(spark, rows)
    assert all(text[i] == f"Body {i}" for i in range(1, 9)) and text[0].count("x") == 1200
    assert extracted(spark, rows[::-1]) == text


def test_html_deep_pages(spark):
    deep = "<body><div><article><p>First</p>" + "<div>" * 3000 + "<nav>Menu</nav>deep" + "</div>" * 3000 + "<p>Last</p></article></div></body>"
    assert extracted(spark, [(0, "http://a.example/1", deep)])[0] == "First deep Last"


def test_quality(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(120):
        bad = i % 3 == 0
        lines = [prose(15, rng).capitalize() + "." for _ in range(6)]
        if bad:
            lines[1:5] = [" | ".join(prose(8, rng).split()) + " ###" for _ in range(4)]
        rows.append((i, "\n".join(lines)))
        labels.append((i, int(not bad)))
    rows += [(1000, None), (1001, ""), (1002, "word " * 20000)]
    d, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    made = {r["doc_id"]: r["score"] for r in quality.score_documents(d, lab).collect()}
    assert all((made[i] >= 0.5) == bool(q) for i, q in labels) and made[1000] == made[1001] and all(0 <= s <= 1 for s in made.values())
    assert {r["score"] for r in quality.score_documents(d, lab.limit(0)).collect()} == {0.5}


def test_quality_of_repeated_null_and_clashing_rows(spark):
    rng = random.Random(14)
    good = [prose(30, rng).capitalize() + ".\n" + prose(12, rng).capitalize() + "." for _ in range(60)]
    bad = ["$$$ " + " ### ".join(prose(3, rng).upper() for _ in range(9)) + " %%%\n!!! " + prose(2, rng) for _ in range(60)]
    rows = [(i, t, "s") for i, t in enumerate(x for pair in zip(good, bad, strict=True) for x in pair)]
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i, *_ in rows] + [(None, 1)], "doc_id long, quality int")
    docs = spark.createDataFrame([*rows, rows[0], rows[0], (None, good[0], "s"), (None, None, None), (500, "", "s")], "doc_id long, text string, Score string").repartition(3)
    made = quality.score_documents(docs, labels)
    assert made.columns == ["doc_id", "text", "score"]
    got = made.withColumn("held", quality.held_out(F.col("doc_id"))).collect()
    held = [r for r in got if r["held"] and r["doc_id"] < 120]
    assert len(held) > 20 and all((r["score"] >= 0.5) == (r["doc_id"] % 2 == 0) for r in held)
    by_text = {}
    for r in got:
        by_text.setdefault(r["text"] or "", set()).add(r["score"])
    assert len(got) == 125 and all(len(v) == 1 for v in by_text.values())
    assert quality.score_documents(docs.limit(0), labels).count() == 0
    alone = quality.score_documents(docs, labels.limit(0))
    assert alone.columns == made.columns and {r["score"] for r in alone.collect()} == {0.5}


def test_marginals_by_enumeration():
    rng = np.random.default_rng(0)
    emit, trans, count = rng.normal(size=7), rng.normal(size=(2, 2)), np.array([4, 0, 3])
    good, _ = quality.marginals(emit, count, trans)
    at = 0
    for n in (4, 3):
        p = np.zeros(n)
        total = 0
        for code in range(2**n):
            y = [(code >> k) & 1 for k in range(n)]
            w = np.exp(sum(emit[at + k] for k in range(n) if y[k]) + sum(trans[y[k], y[k + 1]] for k in range(n - 1)))
            total += w
            p += w * np.array(y)
        assert np.allclose(good[at : at + n], p / total)
        at += n


def test_secrets(spark, empty):
    key = hashlib.sha256(b"k").hexdigest()[:40]
    rows = [(1, f'some words token = "{key}" more words'), (2, "tionmentinglichkeitsch reads queelleaiierelletion well"), (3, "see mail5.example.com or a.b.92@mail6.example.com"), (4, None), (5, "")]
    made = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r["doc_id"], r["word_pos"], r["secret"]) for r in made] == [(1, 4, key)]


def test_secrets_later_and_short_runs(spark):
    a, b = (hashlib.sha256(x).hexdigest()[:40] for x in (b"a", b"b"))
    words = [f"https://host.example.com/path?token={a}", f"{a}:{b}", f"{a},{b}", f'{{"api_key":"{a}","secret":"{b}"}}', "password=hunter2abc", "the note: something password: required"]
    made = secrets.scan(spark.createDataFrame(list(enumerate(words)), "doc_id long, text string")).collect()
    want = {(i, w.index(k), k) for i, w in enumerate(words[:4]) for k in (a, b) if k in w} | {(4, 9, "hunter2abc")}
    assert {(r["doc_id"], r["char_pos"], r["secret"]) for r in made} == want and len(made) == len(want)


def test_secrets_recall_and_precision(spark):
    """Planted secrets of several makes against hard others, in prose whose words the scan has to learn; neither is made as the labelled findings are."""
    rng = random.Random(31)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    token = lambda n, abc=alphabet: "".join(rng.choice(abc) for _ in range(n))
    language = ["".join(rng.choice(("ba", "con", "der", "el", "fin", "gra", "ho", "in", "ker", "lo", "men", "no", "per", "qua", "ri", "so", "ten", "ur", "ver", "wil")) for _ in range(rng.randint(2, 4))) for _ in range(200)]
    words = lambda n: [rng.choice(language) for _ in range(n)]
    makes = [lambda: "AKIA" + token(16, alphabet[:26] + "234567"), lambda: "ghp_" + token(36), lambda: token(40, "0123456789abcdef"), lambda: token(32), lambda: "eyJ" + token(30) + "." + token(40), lambda: token(44).replace("a", "/").replace("b", "+")]
    others = [lambda: "-".join(words(4)), lambda: "_".join(words(3)), lambda: "".join(words(5)), lambda: "/".join(["src", *words(3)]) + ".py", lambda: "".join(w.capitalize() for w in words(4)), lambda: "www." + words(1)[0] + ".example.com", lambda: token(16, "0123456789"), lambda: "x" * 24, lambda: "Zk9" * 8]
    rows, planted = [], set()
    for i in range(300):
        text = words(12)
        if i % 2:
            secret = makes[i // 2 % len(makes)]()
            text[5:8] = rng.choice([["token", "=", f'"{secret}"'], ["api_key", ":", secret], ["password", "is", secret], ["Authorization:", "Bearer", secret]])
            planted.add((i, secret))
        else:
            text[5:6] = [others[i // 2 % len(others)]()]
        rows.append((i, " ".join(text)))
    made = {(r["doc_id"], r["secret"]) for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    hit = len(made & planted)
    assert hit >= 0.9 * len(planted) and hit >= 0.9 * len(made), (hit, len(planted), len(made), sorted(made - planted)[:9], sorted(planted - made)[:9])


def test_secrets_are_whole_and_fingerprints_are_none(spark):
    h = lambda x, f=hashlib.sha256: f(x.encode()).hexdigest()
    uuid = lambda x: "-".join((h(x)[:8], h(x)[8:12], h(x)[12:16], h(x)[16:20], h(x)[20:32]))
    public = [f"merged in commit {h('a', hashlib.sha1)} last week", f"the image sha256:{h('b')} was pulled", f"ETag: \"{h('c', hashlib.md5)}\" came back", f"checksum {h('d')} of the file", f"see {uuid('e')} for more"]
    public += [f"request id {uuid('f')} failed", f"md5 {h('g', hashlib.md5)} matches", f"revision {h('h', hashlib.sha1)}.", f"user_id={uuid('i')}", f"digest: {h('j')}", f"its fingerprint is {h('k', hashlib.sha1)} now"]
    whole = {"password=Tr0ub4dor&3!x9Q": "Tr0ub4dor&3!x9Q", 'api_key = "p@ss#W0rd$ecret%99"': "p@ss#W0rd$ecret%99", "secret: 'a1$B2%c3^D4'": "a1$B2%c3^D4", f"https://host.example.com/?token={h('m')[:40]}&page=2": h("m")[:40]}
    rows = list(enumerate([*public, *whole]))
    made = [(r["doc_id"], r["secret"]) for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    wrong = [m for m in made if m[0] < len(public)]
    assert len(wrong) <= 1, wrong
    assert {m for m in made if m[0] >= len(public)} == {(len(public) + i, v) for i, v in enumerate(whole.values())}


def test_secrets_of_repeated_null_and_empty_rows(spark, empty):
    key = hashlib.sha256(b"q").hexdigest()[:40]
    rows = [(1, f'token = "{key}"', "a"), (1, f'token = "{key}"', "a"), (None, f'token = "{key}"', "b"), (2, "word " * 50_000 + f'token = "{key}"', "c")]
    made = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string, candidate string")).collect()
    assert sorted((str(r["doc_id"]), r["secret"]) for r in made) == [("1", key), ("1", key), ("2", key), ("None", key)]
    assert secrets.scan(empty).count() == 0


def test_words_across_pieces():
    rng = random.Random(8)
    texts = [prose(30, rng), "x" * 900_000 + " tail", "", None, prose(120_000, rng), "a" * 300_000 + "  b\t" + prose(5, rng)]
    w = textarrays.words(*textarrays.text_bytes(pa.array(texts)))
    split = [(t or "").split() for t in texts]
    assert w.count.tolist() == [len(s) for s in split]
    by_word = {}
    for word, h in zip([x for s in split for x in s], w.hash.tolist(), strict=True):
        assert by_word.setdefault(word, h) == h
    assert len(set(by_word.values())) == len(by_word)
    parts = list(textarrays.slices(pa.record_batch({"a": [b"12", None, b"123456789", b""], "b": [b"", b"1", b"", b"12"]}), (0, 1), 3))
    assert [p.num_rows for p in parts] == [2, 1, 1]


def test_subsets_of_two():
    tokens, owner = np.arange(9, dtype=np.uint64), np.array([0, 0, 0, 1, 1, 3, 4, 4, 4])
    sig, own = ngram_join._subsets_of_two(tokens, owner, 5)
    assert np.bincount(own, minlength=5).tolist() == [3, 1, 0, 0, 3] and len(set(sig.tolist())) == len(sig)


def test_parities_never_exceed_the_difference():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64)) for n in (1, 9, 300, 2000)]
    sets += [np.unique(np.r_[sets[2][40:], rng.integers(0, 1 << 62, 20).astype(np.uint64)]), np.zeros(0, np.uint64)]
    bits = ngram_join.parities(np.concatenate(sets), np.array([len(x) for x in sets])).view(np.uint64)
    for i in range(len(sets)):
        assert sum(int(x).bit_count() for x in bits[:, i]) <= len(sets[i])
        for j in range(i):
            flipped = sum(int(a ^ b).bit_count() for a, b in zip(bits[:, i], bits[:, j], strict=True))
            assert flipped <= len(np.setxor1d(sets[i], sets[j]))


def test_narrow_bands_reach_all_linked_sizes():
    n = np.arange(4, 100_000)
    band = lambda x: np.searchsorted(ngram_join.NARROW, x, "right") - 1
    assert (band(5 * n // 4) - band(n)).max() <= ngram_join.NARROW_REACH
    assert (band(n) - band((4 * n + 4) // 5)).max() <= ngram_join.NARROW_REACH


def test_linked_sets_share_a_signature_that_pairs_them():
    rng = np.random.default_rng(3)
    common = np.unique(rng.integers(0, 1 << 63, 3000).astype(np.uint64))
    often = common[::2].copy()
    sets = []
    for size in [*range(4, 40), 60, 90, 146, 300]:
        base = rng.choice(often, size, replace=False)
        for edits in (0, size // 20, size // 9, size // 6):
            keep = rng.choice(base, size - edits, replace=False)
            sets.append(np.unique(np.r_[keep, rng.choice(common, edits)]))
            sets.append(np.unique(np.r_[base, rng.choice(common, edits)]))
    sig, owner = ngram_join.signatures(np.concatenate(sets), np.array([len(s) for s in sets]), often)
    held = [set(sig[owner == i].tolist()) for i in range(len(sets))]
    links = 0
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 0 < both < max(len(sets[i]), len(sets[j])) and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                links += 1
                assert any(x & 3 == 0 and x in held[j] or x & 3 and x ^ 1 in held[j] for x in held[i])
    assert links > 50
