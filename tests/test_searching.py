"""The search solvers against brute force on small puzzles."""

import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tracemill.functions import gates, transform
from tracemill.functions.puzzle import GATES
from tracemill.operators import equations, search

OPS = {"add": lambda x, y: x + y, "abs_diff": lambda x, y: abs(x - y), "mul": lambda x, y: x * y, "concat": lambda x, y: x * 100 + y, "rev_concat": lambda x, y: y * 100 + x}


def assigned(known, symbols):
    """Every way to give the symbols digits, none twice."""
    if not symbols:
        yield known
        return
    first = symbols[0]
    for v in [known[first]] if first in known else [d for d in range(10) if d not in known.values()]:
        yield from assigned({**known, first: v}, symbols[1:])


def votes_of(examples, question):
    votes = Counter()

    def go(k, known, ops):
        left, out = examples[k] if k < len(examples) else (question, None)
        for m in assigned(known, left[:2] + left[3:]):
            x, y = m[left[0]] * 10 + m[left[1]], m[left[3]] * 10 + m[left[4]]
            for name in [ops[left[2]]] if left[2] in ops else OPS:
                v = str(OPS[name](x, y))
                if out is None:
                    votes[v] += int(v) <= 9999
                elif len(v) == len(out) and int(v) <= 9999:
                    now = dict(m)
                    if all(s == d if s.isdigit() else now.setdefault(s, int(d)) == int(d) and list(now.values()).count(int(d)) == 1 for s, d in zip(out, v, strict=True)):
                        go(k + 1, now, {**ops, left[2]: name})

    go(0, {}, {})
    return +votes


def told(votes):
    if not votes:
        return None, "none", 0, 0
    best = max(votes.values())
    first = [a for a, n in votes.items() if n == best]
    return (first[0] if len(first) == 1 else None), ("ok" if len(first) == 1 else "tie"), sum(votes.values()), len(votes)


def puzzles():
    rng, out = random.Random(7), []
    for k in (3, 4, 5):
        symbols = rng.sample("!@#$%^&~?:", 10)
        hide = lambda n, width=2: "".join(symbols[int(c)] for c in str(n).zfill(width))  # noqa: E731, B023
        ops = {"{": rng.choice(["add", "mul", "abs_diff"]), "|": rng.choice(["concat", "rev_concat", "add"])}
        examples = []
        for sign in "{|{":
            x, y = rng.randint(10, 99), rng.randint(10, 99)
            shown = hide(OPS[ops[sign]](x, y), 1)
            examples.append((hide(x) + sign + hide(y), str(OPS[ops[sign]](x, y))[0] + shown[1:] if k == 4 else shown))
        out.append((examples, hide(rng.randint(10, 99)) + ("}" if k == 5 else "{") + hide(rng.randint(10, 99))))
    return [*out, ([("aa+bb", "ab"), ("ab+aa", "1111")], "aa+bb"), ([("ab|cd", "1234"), ("ab|ca", "1231")], "ab|dc")]


HEAD = "In Alice's Wonderland, a secret set of transformation rules is applied to equations. Below are a few examples:\n"


def test_cryptarithms_by_brute_force(spark):
    made = puzzles()
    rows = [(k, HEAD + "\n".join(f"{a} = {b}" for a, b in ex) + f"\nNow, determine the result for: {q}") for k, (ex, q) in enumerate(made)]
    df = spark.createDataFrame([*rows, (100, "nothing"), (101, None)], "k long, p string")
    got = {r["k"]: tuple(r)[1:] for r in search.cryptarithms(df, "k", F.col("p"), nodes=10**7).collect()}
    assert got.pop(100) == got.pop(101) == (None, "unparsed", 0, 0)
    assert got == {k: told(votes_of(*m)) for k, m in enumerate(made)} and {"ok", "tie"} <= {g[1] for g in got.values()}
    few = {r["k"]: tuple(r)[1:] for r in search.cryptarithms(df, "k", F.col("p"), nodes=300).collect()}
    assert any(v[1] == "open" for v in few.values()) and all(v == got[k] for k, v in few.items() if k in got and v[1] != "open")


def deciphered(examples, question, words):
    forth, back = {}, {}
    for c, p in examples:
        if len(c) != len(p) or any((a == " ") != (b == " ") for a, b in zip(c, p, strict=True)):
            return None, "conflict", 0
        for a, b in zip(c, p, strict=True):
            if a.isalpha() and b.isalpha() and (forth.setdefault(a, b) != b or back.setdefault(b, a) != a):
                return None, "conflict", 0
    show = lambda w, m: "".join(m.get(x, "?") if x.isalpha() else x for x in w)
    if "?" not in show(question, forth):
        return show(question, forth), "mapped", 1
    found = set()

    def go(left, known, done):
        if not left:
            found.add(" ".join(done))
        elif "?" not in show(left[0], forth):
            go(left[1:], known, [*done, show(left[0], forth)])
        else:
            for v in (v for v in words if len(v) == len(left[0])):
                now = dict(known)
                if all((a == b) if not a.isalpha() else (now[a] == b if a in now else b not in now.values() and now.setdefault(a, b) == b) for a, b in zip(left[0], v, strict=True)):
                    go(left[1:], now, [*done, v])

    go(question.split(" "), forth, [])
    return (min(found) if len(found) == 1 else None), ("none" if not found else "recovered" if len(found) == 1 else "ambiguous"), len(found)


def test_ciphers_by_brute_force(spark):
    rng, abc = random.Random(8), "abcdefghijklmnopqrstuvwxyz"
    words = sorted({"".join(rng.choice("abcde") for _ in range(rng.randint(2, 4))) for _ in range(60)} | {"planet", "garden", "castle", "forest"})
    made = []
    for k in range(40):
        hide = str.maketrans(abc, "".join(rng.sample(abc, 26)))
        plain = [" ".join(rng.choices(words, k=rng.randint(1, 2))) for _ in range(rng.randint(1, 2))]
        question = " ".join(rng.choices(words, k=rng.randint(1, 3))) + (" xyzzyx" if k % 11 == 0 else "") + ("-," if k % 7 == 0 else "")
        made.append(([(p.translate(hide), p) for p in plain] + ([("zz", "xy")] if k % 15 == 7 else []), question.translate(hide)))
    rows = [(k, "Secret encryption.\n" + "\n".join(f"{a} -> {b}" for a, b in ex) + "\nNow, decrypt the following text: " + q) for k, (ex, q) in enumerate(made)]
    df = spark.createDataFrame([*rows, (200, None)], "k long, p string")
    vocabulary = spark.createDataFrame([(w,) for w in words], "word string")
    got = {r["k"]: tuple(r)[1:] for r in search.cipher_words(df, "k", F.col("p"), vocabulary, nodes=10**6).collect()}
    assert got.pop(200) == (None, "unparsed", 0)
    assert got == {k: deciphered(ex, q, words) for k, (ex, q) in enumerate(made)}
    assert {"mapped", "recovered", "ambiguous", "none", "conflict"} <= {v[1] for v in got.values()}


def test_gates_are_the_first_that_fit(spark):
    plain = {name: (n, sql) for name, n, sql in GATES}
    tried = [("CONST_0", lambda b: 0), ("CONST_1", lambda b: 1)]
    for i in range(8):
        tried += [(f"b[{i}]", lambda b, i=i: b[i]), (f"NOT_b[{i}]", lambda b, i=i: 1 - b[i])]
    for n in (2, 3, 4):
        for at in combinations(range(8), n):
            for name, (arity, sql) in plain.items():
                if arity == n:
                    f = lambda b, at=at, sql=sql: eval(sql, dict(zip("abcd", [b[i] for i in at], strict=False))) & 1  # noqa: E731, S307
                    shown = f"{name}({','.join(f'b[{i}]' for i in at)})"
                    tried += [(shown, f)] + ([(f"NOT_{shown}", lambda b, f=f: 1 - f(b))] if n == 2 else [])
    assert [name for name, *_ in gates.candidates()] == [name for name, _ in tried]
    rng, rows, want = random.Random(2), [], {}
    bits = lambda x: [x >> (7 - i) & 1 for i in range(8)]
    for k, n in enumerate((1, 3, 6, 70, 130, 255)):
        xs, q = rng.sample(range(256), n), rng.randrange(256)
        out = [rng.choice(tried)[1] for _ in range(8)] if k != 2 else [lambda b: sum(b[:5]) % 2] * 8
        ys = [[f(bits(x)) for f in out] for x in xs]
        found = [next(((name, f) for name, f in tried if all(f(bits(x)) == y[j] for x, y in zip(xs, ys, strict=True))), ("unknown", None)) for j in range(8)]
        want[k] = ([name for name, _ in found], None if any(f is None for _, f in found) else "".join(str(f(bits(q))) for _, f in found))
        lines = "\n".join(f"{x:08b} -> {''.join(map(str, y))}" for x, y in zip(xs, ys, strict=True))
        rows.append((k, f"A secret rule.\n{lines}\nNow, determine the output for: {q:08b}"))
    df = spark.createDataFrame([*rows, (90, None), (91, "Now, determine the output for: 00000000")], "k long, p string")
    got = {r["k"]: (r["rules"], r["answer"]) for r in gates.per_bit(df, "k", F.col("p")).collect()}
    assert got.pop(90) == got.pop(91) == (None, None) and got == want


@pytest.mark.parametrize(
    ("lines", "question", "want"),
    [
        (["ab = ba", "cd = dc", "xy = yx"], "aa", ("bb", 1.0, "character map")),
        (["12+34 = 46", "20+31 = 51"], "11+22", ("33", 0.9, "add")),
        (["ab+cd = cdab", "xy+zw = zwxy", "ab-cd = abcd"], "pq+rs", ("rspq", 0.9, "concat_ba")),
        (["ab+cd = cdab"], "pq*rs", (None, 0.0, None)),
        (["ab = xy"], "abc", ("xy", 0.3, "part of the map")),
        (["a=b = x", "c=x"], "a=b", (None, 0.0, None)),
        (["12/00 = 1", "34/00 = 2"], "11/00", (None, 0.0, None)),
        ([], "ab", (None, 0.0, None)),
    ],
)
def test_transforms(spark, lines, question, want):
    prompt = HEAD + "\n".join(lines) + f"\nNow, determine the result for: {question}"
    made = transform.equation_transform(spark.createDataFrame([(prompt,), (None,)], "p string"), F.col("p")).collect()
    assert tuple(made[0])[1:] == want and tuple(made[1])[1:] == (None, 0.0, None)


def test_equations_turned_and_signed(spark):
    groups = {
        1: [("12", "+", "34", "46"), ("20", "+", "05", "25"), ("11", "+", "12", None)],
        2: [("12", "+", "34", "22+"), ("90", "+", "12", "78"), ("10", "+", "15", None)],
        3: [("12", "-", "34", "-22"), ("50", "*", "3", "150"), ("10", "/", "4", None)],
        4: [("12", "+", "34", "999999"), ("1", "+", "2", None)],
    }
    rows = [(k, i, a, op, b, y, y is None) for k, g in groups.items() for i, (a, op, b, y) in enumerate(g)]
    got = {r["key"]: r for r in equations.solved(spark.createDataFrame(rows, "key long, i int, a string, op string, b string, y string, asked boolean")).collect()}
    assert (got[1]["rule"], got[1]["answer"]) == ("addition", "23")
    assert (got[2]["fmt"], got[2]["answer"]) == ("suffix", "5+") and not got[2]["reversed_operands"]
    assert got[3]["unseen"] and got[3]["answer"] == "6"
    assert got[4]["rule"] is None and got[4]["answer"] is None and len(got[4]["rejected"]) == 4 * len((*equations.COMMON, *equations.RARE))


def test_cryptarithms_of_many_assignments_are_searched_whole(spark):
    made = [([("ab}cd", "abcd")], "ae}fb"), ([("ab}cd", "cdab"), ("ef{ab", "gh")], "ga{eb")]
    rows = [(k, HEAD + "\n".join(f"{a} = {b}" for a, b in ex) + f"\nNow, determine the result for: {q}") for k, (ex, q) in enumerate(made)]
    got = {r["k"]: tuple(r)[1:] for r in search.cryptarithms(spark.createDataFrame(rows, "k long, p string"), "k", F.col("p")).collect()}
    assert got == {k: told(votes_of(*m)) for k, m in enumerate(made)} and max(g[2] for g in got.values()) > 25_000


def test_ciphers_of_many_combinations_are_counted_whole(spark, monkeypatch):
    monkeypatch.setattr(search, "PAIRS", 5000)
    abc = "abcdefghijklm"
    words = sorted({"".join(x) for x in combinations(abc, 3)} | {"".join(reversed(x)) for x in combinations(abc, 3)} | {"noq", "nop"})
    made = [([("zz", "yy")], "def ghi"), ([("zz", "yy")], "def efg"), ([("zy", "no")], "zyx"), ([("zy", "no")], "zyx def"), ([("zy", "no"), ("xw", "pa")], "zyx xyz def fed"), ([("zyx", "nop")], "zyx zyv")]
    rows = [(k, "Secret encryption.\n" + "\n".join(f"{a} -> {b}" for a, b in ex) + "\nNow, decrypt the following text: " + q) for k, (ex, q) in enumerate(made)]
    got = {r["k"]: tuple(r)[1:] for r in search.cipher_words(spark.createDataFrame(rows, "k long, p string"), "k", F.col("p"), spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    assert got == {k: deciphered(ex, q, words) for k, (ex, q) in enumerate(made)}
    assert got[0][2] > 25_000 and got[5] == ("nop noq", "recovered", 1)
