"""HTML extraction by wrapper induction: pages of a host are aligned by simple tree matching, what varies is content.

A few pages of every host, chosen by hash, are its references. Every page's tree of blocks is matched with each of them.
A text of a reference that stands, at its matched place, on nearly all distinct pages of the host is template and dropped;
all other texts of the page's article stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import cut
from tracemill.llm.html_tree import Page, aligned, code, parse

#: Reference pages a host; a template text that one of them lacks is found by the others.
REFERENCES = 3
#: A text is template if this share of the host's distinct pages has it, and at least so many: few pages share text by chance.
TEMPLATE_SHARE, TEMPLATE_PAGES = 0.9, 5
#: Characters of references up to which they are broadcast; beyond, pages meet them by their host, in SALTS parts each.
BROADCAST_CHARS, SALTS = 50_000_000, 64
#: Parsed references that a task remembers.
REMEMBERED = 200


def host_of(url: str | None) -> str:
    return re.sub(r"^\w+://([^/?#]*).*$", r"\1", url or "", flags=re.S).lower()


def main_text(page: Page, dropped: set[int] | frozenset[int] = frozenset()) -> str:
    """The texts of a page's article that are not dropped: of the outermost articles (else mains) of the label with most text, else of all."""
    leaves = page.leaves()
    mass: dict[tuple[bool, int], int] = {}
    for k in leaves:
        size = 0 if k in dropped else len(page.text[k])
        for region, is_article in ((page.article[k], True), (page.main[k], False)):
            if region is not None:
                mass[is_article, region] = mass.get((is_article, region), 0) + size
    best = max(((n > 0, is_article, n, region) for (is_article, region), n in mass.items()), default=None)
    region = best[3] if best else None
    return " ".join(page.text[k] for k in leaves if k not in dropped and (region is None or region in (page.article[k], page.main[k])))


class Remembered:
    """Parsed references by host, the latest ones."""

    def __init__(self) -> None:
        self.pages: dict[tuple[str, str], Page] = {}

    def __call__(self, host: str, html: str) -> Page:
        if (host, html) not in self.pages:
            if len(self.pages) >= REMEMBERED:
                self.pages.pop(next(iter(self.pages)))
            self.pages[host, html] = parse(html)
        return self.pages[host, html]


def _matches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, page, ref, node) of every text that stands at its matched place in a reference, and one row with no node a page."""
    known = Remembered()
    schema = pa.schema([("host", pa.string()), ("page", pa.int64()), ("ref", pa.int32()), ("node", pa.int32())])
    for batch in batches:
        rows = []
        for html, host, refs in zip(*(batch.column(i) for i in range(1, 4)), strict=True):
            host, refs, text = host.as_py(), refs.as_py() or [], html.as_py() or ""
            own, mark = parse(text), code.__wrapped__(0, text)
            rows.append((host, mark, None, None))
            for r, ref in enumerate(refs):
                page = known(host, ref)
                if own.texts.isdisjoint(page.texts):
                    continue  # no text can stand at its matched place
                rows += [(host, mark, r, y) for x, y in aligned(own, page).items() if own.text[x] == page.text[y]]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = Remembered()
    for batch in batches:
        texts = []
        for html, host, refs, template in zip(*(batch.column(i) for i in range(1, 5)), strict=True):
            own, gone = parse(html.as_py() or ""), set()
            nodes = {(t["ref"], t["node"]) for t in template.as_py() or []}
            for r, ref in enumerate(refs.as_py() or []):
                if any(r == ref_of for ref_of, _ in nodes) and not own.texts.isdisjoint((page := known(host.as_py(), ref)).texts):
                    gone |= {x for x, y in aligned(own, page).items() if (r, y) in nodes and own.text[x] == page.text[y]}
            texts.append(main_text(own, gone))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(5), pa.array(texts, pa.string())], names=["id", "url", "text"])


def references(pages: DataFrame) -> DataFrame:
    """(host, refs): up to REFERENCES distinct pages of every host, those with the smallest hashes, whatever the order of rows."""
    firsts = [F.min(F.struct(F.xxhash64("html", F.lit(k)).alias("h"), "html")).getField("html").alias(f"r{k}") for k in range(REFERENCES)]
    made = pages.where("html IS NOT NULL AND html <> ''").groupBy("host").agg(*firsts)
    return made.select("host", F.array_distinct(F.array(*[f"r{k}" for k in range(REFERENCES)])).alias("refs"))


def _beside(pages: DataFrame, table: DataFrame, small: bool) -> DataFrame:
    """Pages with their host's row of ``table``; a hot host's pages are dealt out, so that none waits for one task."""
    if small:
        return pages.join(F.broadcast(table), "host", "left")
    salted = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return pages.withColumn("salt", F.pmod(F.xxhash64("id", "html"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")


def induce_wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> tuple[DataFrame, bool]:
    """(host, refs, template) of every host, and whether the table may be broadcast.

    ``template`` lists the (ref, node) texts of the references that nearly all distinct pages have at their matched place.
    Exact copies of a page count once, or a page with copies would make its own text template. Matches are counted by
    text and host after partial sums, so a hot host costs its templates' rows only.
    """
    rows = pages.select(F.lit(None).cast("long").alias("id"), F.col(html_col).alias("html"), _host(F.col(url_col)).alias("host"))
    refs = cut(references(rows), "wrappers-refs")
    chars = refs.agg(F.sum(F.aggregate("refs", F.lit(0).cast("long"), lambda s, r: s + F.length(r)))).first()[0] or 0
    small = chars <= BROADCAST_CHARS
    met = _beside(rows, refs, small).select("id", "html", "host", "refs").mapInArrow(_matches, "host string, page long, ref int, node int")
    seen = met.groupBy("host", "page", "ref", "node").agg(F.lit(1).alias("one")).groupBy("host", "ref", "node").agg(F.count(F.lit(1)).alias("n"))
    seen = cut(seen, "wrappers-seen")
    total = seen.where("node IS NULL").select("host", F.col("n").alias("total"))
    common = seen.where(f"node IS NOT NULL AND n >= {TEMPLATE_PAGES}").join(total, "host").where(F.col("n") >= F.ceil(F.col("total") * TEMPLATE_SHARE))
    template = common.groupBy("host").agg(F.collect_list(F.struct("ref", "node")).alias("template"))  # as many as the references have texts
    return cut(refs.join(template, "host", "left"), "wrappers"), small


def _host(url):
    return F.lower(F.regexp_replace(F.coalesce(url, F.lit("")), r"(?s)^\w+://([^/?#]*).*$", "$1"))


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url and text of every page: the blocks of its article in page order, joined by one space.

    Character references are decoded, white space inside a block becomes one space. Null and empty pages give an
    empty text; a page without tags is its own text. Null urls are one host. Repeated rows are read each; other
    columns are ignored, whatever their names; an empty table gives an empty result. Broken markup takes time linear in
    its length to read: a quote or comment that nothing closes is looked for once.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    rules, small = induce_wrappers(rows)
    joined = _beside(rows.withColumn("host", _host(F.col("url"))), rules, small).select("id", "html", "host", "refs", "template", "url")
    out = joined.mapInArrow(_texts, "id long, url string, text string")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text")
