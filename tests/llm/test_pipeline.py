"""The pipeline against plain Python over rows with null, repeated and clashing ids, and on empty tables."""

import hashlib
import random
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from tracemill.llm import line_dedup, mixing, quality
from tracemill.llm.queries import bpe_vocab_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row string, _kept string, copies string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fixture_rows():
    rng = random.Random(21)
    vocabulary = ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows, labels = [], []
    for i in range(90):
        if i % 4 == 3:
            text = "\n".join(" | ".join(prose(6).split()) + " ### $$" for _ in range(4))
        else:
            text = "\n".join(prose(rng.randint(8, 20)).capitalize() + "." for _ in range(rng.randint(2, 5)))
            text += "\nFollow us on all channels today." if i % 3 == 0 else ""
        rows.append([i, text, "en", f"s{i % 3}"])
        labels.append((i, int(i % 4 != 3), 0))
    near = lambda t: t.replace(t.split()[9], "edited", 1) + "\n" + prose(1)
    long = "\n".join(prose(15).capitalize() + "." for _ in range(20))
    rows += [[200 + i, long if i == 0 else near(long), "en", None] for i in range(4)]
    rows += [[4, near(long), "en", "s1"], [None, near(long), "en", "s1"], [None, prose(30), "en", "s2"]]  # an id with a near copy and an unlike text
    rows += [list(rows[0]), list(rows[0]), list(rows[0])]  # one row four times
    rows += [[5, rows[8][1], "en", "s0"], [300, None, "en", "s0"], [301, "", "en", "s0"], [302, prose(3), "en", "s9"]]
    return [(*r, None if r[1] is None else len(r[1]), "x", "y", "z") for r in rows], labels


def plain_near(rows):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for r in rows:
        w = WORD.findall((r[1] or "").translate(fold))
        sets.append({tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    order = lambda i: (rows[i][0] is None, rows[i][0] or 0, i)
    return [rows[min(g, key=order)] for g in groups.values()]


def plain_lines(rows):
    pages, seen = {}, Counter()
    for r in rows:
        if r[1] is not None and r[1] not in pages.setdefault(r[3], set()):
            pages[r[3]].add(r[1])
            seen.update((r[3], x) for x in set(r[1].split("\n")) if WORD.search(x))
    bad = {k for k, n in seen.items() if n >= line_dedup.MIN_PAGES and n > line_dedup.RATIO * len(pages[k[0]])}
    out = []
    for r in rows:
        text = None if r[1] is None else "\n".join(x for x in r[1].split("\n") if (r[3], x) not in bad)
        out.append((r[0], text, r[2], r[3], None if text is None else len(text)))
    return out


def plain_mix(rows):
    size = lambda r: len(WORD.findall(r[1] or ""))
    names = sorted({r[3] for r in rows}, key=lambda s: (s is None, s))
    own = {s: sum(size(r) for r in rows if r[3] == s) for s in names}
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), mixing.SHARE * sum(own.values())
    while open_:  # those above twice their size stop there, the rest is shared anew
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = [s for s in open_ if share[s] > 2 * own[s]]
        target |= {s: 2.0 * own[s] for s in full} if full else share
        left -= sum(2 * own[s] for s in full)
        open_ -= set(full) if full else set(open_)
    out = []
    for s in names:
        bucket = lambda r, h: (size(r).bit_length() or 1) * 16 + (size(r) >> max(size(r).bit_length() - 4, 0))
        keyed = [(hashlib.md5(b"" if r[0] is None else str(r[0]).encode()).hexdigest(), r) for r in rows if r[3] == s]
        keyed.sort(key=lambda x: (bucket(x[1], x[0]) * mixing.CELLS + int(x[0][:4], 16) % mixing.CELLS, size(x[1]), x[0]))
        each = target[s] / own[s] if own[s] else 0.0
        for k, (_, r) in enumerate(keyed):
            out += [r] * (int((k + 1) * each + mixing.offset()) - int(k * each + mixing.offset()))
    return out


def write(spark, folder, rows, labels):
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_pipeline_against_plain_python(spark, tmp_path):
    from tokenizers import Tokenizer

    rows, labels = fixture_rows()
    write(spark, tmp_path, rows, labels)
    model = quality.train(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    kept = [r for r in rows if quality.score(model, pa.array([r[1]], pa.string()))[0] >= 0.5]
    near = plain_near(plain_lines(kept))
    assert len(rows) > len(kept) > len(near)
    lib = Tokenizer.from_file(bpe_vocab_path())
    want = []
    for r in plain_mix(near):
        ids = lib.encode(r[1] or "", add_special_tokens=False).ids
        hashes = [hashlib.sha256(x).hexdigest() for x in (b"".join(i.to_bytes(4, "little") for i in ids), lib.decode(ids, skip_special_tokens=False).encode())]
        want.append((r[0], len(ids), *hashes))
    got = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    key = lambda x: (x[0] is None, x)
    assert Counter(map(tuple, got)) == Counter(want), (sorted(map(tuple, got), key=str)[:5], sorted(want, key=str)[:5])


def test_repeated_ids_are_kept_apart(spark, tmp_path):
    rows, _ = fixture_rows()
    docs = spark.createDataFrame(rows, SCHEMA)
    same = docs.where("doc_id = 0")
    assert same.count() == 4
    mixed = corpus_pipeline.mix_sources(spark, same, str(tmp_path)).count()
    assert mixed <= 8  # twice each at most
    near = corpus_pipeline.keep_one_near(spark, docs, str(tmp_path)).collect()
    assert sum(r["doc_id"] == 0 for r in near) == 1
    # Id 4 has a text of its own and is the smallest of the near copies; of the null ids one row is a copy, the other is not.
    assert sum(r["doc_id"] == 4 for r in near) == 2 and sum(r["doc_id"] is None for r in near) == 1
    assert not any(r["doc_id"] in range(200, 204) for r in near)


def test_pipeline_of_empty_tables(spark, tmp_path):
    write(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_line_dedup_passes_clashing_columns(spark):
    rows = [(i, "menu\nown %d" % i, "h", "a", "b", "c", "d", "e") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _host string, _rules string, _KEPT string, n_lines string, _all string")
    made = line_dedup.drop_boilerplate(docs).orderBy("doc_id").collect()
    assert [(r["text"], r["_host"], r["_rules"], r["_KEPT"], r["_all"], r["n_lines"], r["n_dropped"]) for r in made] == [(f"own {i}", "a", "b", "c", "e", 2, 1) for i in range(5)]
    assert line_dedup.drop_boilerplate(docs.where(F.lit(False))).count() == 0
