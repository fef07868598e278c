"""Wrapper induction: reading broken pages, simple tree matching by brute force, and templates over whole hosts."""

import random
import time
from functools import lru_cache

import pytest

from tracemill.llm import html_extract, html_tree


def text_of(html):
    return html_extract.main_text(html_tree.parse(html))


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<article><p>x</p><script>if(a<b){}</script><p>main text", "x main text"),
        ("<article><p>x</p><script>var t='</p>';a</scriptx></script ><p>y", "x y"),
        ("<article><p>x<style>p<b{}</style> z", "x z"),
        ("<article><p>x<script>never closed <p>y", "x"),
        ("<article><p>let <math><mi>x</mi></math> be<p><svg><text>s</text></svg>", "let x be s"),
        ("<article><p>1 < 2 &lt; 3 &amp; a<3</p>", "1 < 2 < 3 & a<3"),
        ("<article><p class='market-share'>a</p><div class='hidden-gems'>b</div><section id='related-work'>c</section><p title='the hidden class=ad'>d", "a b c d"),
        ("<article><p>a</p><div class='cookie-notice'>n</div><div class=ad>n</div><div id='ad-12'>n</div><ul class='related-posts'><li>n</ul><div role=banner>n</div><p hidden>n</p><p>z", "a z"),
        ("<article><p>a</p><div class='ad>lost</div><p>b</p>", "a lost b"),  # the quote is never closed
        ("<article><p title=\"a > b\">c</p>", "c"),
        ("<body><div class='page-header'>h</div><article><div class='header'>Title</div><p>t</article>", "Title t"),
        ("<article><p>a</p><!-- <p>no</p> --><p>b<!-- open", "a b"),
        ("<article><select><option>n</select><textarea><p>n</textarea><button>n</button><p>b", "b"),
    ],
)
def test_broken_and_named_pages(html, want):
    assert text_of(html) == want


@pytest.mark.parametrize("part", ['<a "x ', '<a x="y ', "<a x='", "<", "</", "<!--", "<a ", "<script>", "</p", '<a b= " c', '<div class="', "&", "<b", "<p>", "<p><div>"])
def test_a_megabyte_of_anything_is_read_in_linear_time(part):
    took = []
    for n in (250_000, 1_000_000):
        began = time.time()
        text_of("<article>" + part * (n // len(part)))
        took.append(time.time() - began)
    assert took[1] < max(2.0, 8 * took[0])


def tree(rng, depth=0):
    if depth == 3 or rng.random() < 0.3:
        return f"<p>{rng.choice('xyz')}</p>"
    return f"<{(tag := rng.choice(['div', 'section']))}>" + "".join(tree(rng, depth + 1) for _ in range(rng.randint(0, 3))) + f"</{tag}>"


def test_matching_is_simple_tree_matching():
    rng = random.Random(3)
    for _ in range(150):
        a, b = (html_tree.parse("".join(tree(rng) for _ in range(rng.randint(1, 3)))) for _ in range(2))

        @lru_cache(None)
        def best(x, y, a=a, b=b):
            if a.label[x] != b.label[y]:
                return 0
            if a.text[x] is not None:
                return 1 + (a.text[x] == b.text[y])
            kx, ky = a.kids[x], b.kids[y]
            m = [[0] * (len(ky) + 1) for _ in range(len(kx) + 1)]
            for i, p in enumerate(kx):
                for j, q in enumerate(ky):
                    m[i + 1][j + 1] = max(m[i][j + 1], m[i + 1][j], m[i][j] + best(p, q))
            return 1 + m[-1][-1]

        found = html_tree.aligned(a, b)
        # A matching of that score: the nodes above the matched leaves match too, and orders are kept.
        assert sorted(found.values()) == [found[x] for x in sorted(found)]
        up = lambda page: {c: k for k, kids in enumerate(page.kids) for c in kids}
        ua, ub = up(a), up(b)
        for x, y in found.items():
            while x:
                assert a.label[x] == b.label[y]
                x, y = ua[x], ub[y]
            assert y == 0
        leaves = sum(1 + (a.text[x] == b.text[y]) for x, y in found.items())
        inner = {ua[x] for x in found}
        assert leaves + len(inner) <= best(0, 0)
        same = html_tree.aligned(a, a)
        assert same == {k: k for k in a.leaves()}


def test_long_lists_are_paired_by_equal_subtrees():
    rng = random.Random(5)
    texts = [str(rng.random()) for _ in range(3000)]
    a = html_tree.parse("".join(f"<p>{t}</p>" for t in texts))
    kept = [t for t in texts if rng.random() < 0.9]
    b = html_tree.parse("<p>new</p>" + "".join(f"<p>{t}</p>" for t in kept) + "<p>end</p>")
    met = html_tree.aligned(a, b)
    assert sum(a.text[x] == b.text[y] for x, y in met.items()) == len(kept)


def extracted(spark, rows, parts=3):
    made = html_extract.extract_main_text(spark.createDataFrame([(*r, "c", "d") for r in rows], "page_id long, url string, html string, Host string, refs string").repartition(parts))
    return sorted(((r["page_id"], r["text"]) for r in made.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def plainly(rows):
    """The same by the same reading and matching, counted in plain Python over all pages of a host, every page a reference."""
    hosts = {}
    for _, url, html in rows:
        hosts.setdefault(html_extract.host_of(url), set()).add(html or "")
    out = []
    for i, url, html in rows:
        pages = [html_tree.parse(h) for h in sorted(hosts[html_extract.host_of(url)])]
        own, gone = html_tree.parse(html or ""), set()
        for ref in pages:
            counts = {}
            for page in pages:
                for x, y in html_tree.aligned(page, ref).items():
                    counts[y] = counts.get(y, 0) + (page.text[x] == ref.text[y])
            template = {y for y, n in counts.items() if n >= max(5, -(-9 * len(pages) // 10))}
            gone |= {x for x, y in html_tree.aligned(own, ref).items() if y in template and own.text[x] == ref.text[y]}
        out.append((i, html_extract.main_text(own, gone)))
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def test_hosts_against_plain_python(spark):
    rows = []
    # No telling names, lists of any length, a text that stands on all pages at moving places.
    for i in range(12):
        items = "".join(f"<div><p>Item {i} {k}</p></div>" for k in range(i % 4))
        rows.append((i, "http://a.example/1", f"<body><div><p>Welcome to us</p></div>{items}<section><p>Story {i}</p><p>Read our terms</p></section><div><p>Call us now</p></div></body>"))
    # A notice on 39 of 40 pages.
    for i in range(40):
        notice = "" if i == 7 else "<p>Our shop is open</p>"
        rows.append((100 + i, "http://b.example/1", f"<body><article><h1>T {i}</h1>{notice}<p>Body {i}</p></article></body>"))
    # Near copies of a rare layout keep what they share.
    rows += [(200 + i, "http://c.example/1", f"<body><article><p>Plain {i}</p></article></body>") for i in range(30)]
    rows += [(300 + i, "http://c.example/1", f"<body><article class='recipe'><h2>Cake</h2><p>The same long real paragraph of the story.</p><p>Edit {i}</p></article></body>") for i in range(5)]
    # Copies count once; null, empty and repeated rows; a null url is a host.
    rows += [(400, "http://d.example/1", "<article><p>One</p><p>Two</p></article>")] * 6 + [(None, None, None), (401, None, ""), (402, None, "plain &amp; text")]
    got = extracted(spark, rows)
    assert got == plainly(rows) == extracted(spark, rows[::-1], 5)
    text = dict(got)
    assert text[3] == "Item 3 0 Item 3 1 Item 3 2 Story 3" and text[105] == "T 5 Body 5" and text[107] == "T 7 Body 7"
    assert text[302] == "Cake The same long real paragraph of the story. Edit 2" and text[400] == "One Two" and text[402] == "plain & text"
    assert extracted(spark, []) == []


def test_pages_meet_references_by_salted_hosts(spark, monkeypatch):
    rows = [(i, "http://a.example/1", f"<body><article><p>Fixed</p><p>Own {i}</p></article></body>") for i in range(20)]
    want = extracted(spark, rows)
    monkeypatch.setattr(html_extract, "BROADCAST_CHARS", 0)
    assert extracted(spark, rows) == want and want[3] == (3, "Own 3")
