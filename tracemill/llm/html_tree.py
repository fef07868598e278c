"""Pages as trees of blocks, and simple tree matching between two of them."""

from __future__ import annotations

import hashlib
import html as html_lib
import re
from collections import Counter
from functools import lru_cache

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose inside is no markup; it ends at their own closing tag, whatever stands before, and is no text of the page.
RAW = frozenset("script style textarea title iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: An opening tag ends an open element of these.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table article section div main body td th blockquote aside nav header footer form".split())
BOILER_TAGS = frozenset("nav footer aside form button dialog menu head select template".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
#: A class or id is boilerplate if all parts of it between hyphens and underscores are roles, places or numbers, one of them a role.
ROLES = frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsors sponsored promo promos promotion promotions banner banners cookie cookies consent gdpr notice "
    "notices alert alerts sidebar nav navbar navigation menu menus breadcrumb breadcrumbs footer masthead comment comments disqus respond replies related recommended recommendations "
    "share sharing social newsletter newsletters subscribe signup popup modal overlay widget widgets toolbar pagination pager skip hidden".split()
)
PLACES = frozenset(
    "bar box block area list item items section container wrapper wrap inner outer link links icon icons button buttons thread main top bottom left right site page global primary "
    "secondary slot unit body text count author meta label title posts articles stories topics content group row column panel policy".split()
)
HEADERS = re.compile(r"^(?:site|page|top|main)?[-_]?header$")

TEXT = re.compile(r"[^<]+|<")
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
#: What ends a tag, or begins a quoted value in it: quotes count after an equals sign only.
STOP = re.compile(r">|=\s*[\"']")
ATTR = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")

#: Pairs of children that one step of the matching compares, and pairs a page; beyond them equal subtrees are anchors, and what lies between is paired in order.
STEP_PAIRS, PAGE_PAIRS, MATCH_DEPTH = 2_500, 100_000, 40


@lru_cache(maxsize=50_000)
def code(at: int, text: str) -> int:
    """64-bit code of a text at a place, the same in every process."""
    salt = at.to_bytes(8, "little", signed=True)
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8, salt=salt).digest(), "little", signed=True)


def is_role(token: str, in_article: bool) -> bool:
    """Whether a class or id names a part of the page that is not its text."""
    if HEADERS.match(token):
        return not in_article
    parts = [p for p in re.split(r"[-_]+", token) if p and not p.isdigit()]
    return any(p in ROLES for p in parts) and all(p in ROLES or p in PLACES for p in parts)


def element(tag: str, attrs: str, in_article: bool) -> tuple[str, bool]:
    """The label of an element and whether it is boilerplate by name."""
    boiler, tokens = tag in BOILER_TAGS or (tag == "header" and not in_article), []
    if attrs.strip():
        for m in ATTR.finditer(attrs):
            name = m[1].lower()
            if name in ("class", "id", "role", "hidden", "aria-hidden"):
                value = (m[2] or m[3] or m[4] or "").lower()
                if name in ("class", "id"):
                    tokens += value.split()
                elif name == "role":
                    boiler |= value in BOILER_ROLES
                else:
                    boiler |= name == "hidden" or value == "true"
    if tag not in ("html", "body", "main"):
        boiler |= any(is_role(t, in_article) for t in tokens)
    return f"{tag} {' '.join(sorted({re.sub(r'[0-9]+', '', t) for t in tokens}))}".strip(), boiler


class Page:
    """The blocks of a page outside named boilerplate, in page order: labels, texts of leaves (else None), children, and regions.

    ``article`` and ``main`` of a node are the codes of the outermost article and main around it, by their labels from the root.
    """

    def __init__(self) -> None:
        self.label, self.text, self.kids, self.article, self.main = ["#root"], [None], [[]], [None], [None]

    def add(self, up: int, label: str, text: str | None, article: int | None, main: int | None) -> int:
        self.label.append(label)
        self.text.append(text)
        self.kids.append([])
        self.article.append(article)
        self.main.append(main)
        self.kids[up].append(len(self.label) - 1)
        return len(self.label) - 1

    def leaves(self) -> list[int]:
        return [k for k, t in enumerate(self.text) if t is not None]

    def measure(self) -> None:
        """``sig``: a code of the whole subtree; ``size``: its nodes; ``weight``: its match with itself, a leaf counting two.

        ``texts`` are the texts of all leaves; ``plain`` tells nodes that hold one text and nothing else.
        """
        n = len(self.label)
        self.texts = {t for t in self.text if t is not None}
        self.plain = [len(kids) == 1 and self.text[kids[0]] is not None for kids in self.kids]
        self.sig, self.size, self.weight = [0] * n, [1] * n, [1] * n
        for k in range(n - 1, -1, -1):
            if self.text[k] is not None:
                self.sig[k], self.weight[k] = hash(("#", self.text[k])), 2
            else:
                self.sig[k] = hash((self.label[k], *[self.sig[c] for c in self.kids[k]]))
                self.size[k] += sum(self.size[c] for c in self.kids[k])
                self.weight[k] += sum(self.weight[c] for c in self.kids[k])


class Scanner:
    """Tags and texts of a page in one pass: what cannot be closed is looked for once."""

    def __init__(self, html: str):
        self.html, self.absent, self.lower = html, set(), None

    def find(self, mark: str, at: int) -> int:
        if mark in self.absent:
            return -1
        found = self.html.find(mark, at)
        if found < 0:
            self.absent.add(mark)
        return found

    def tag_end(self, at: int) -> int:
        """Place behind the tag whose name ends at ``at``; a quote that nothing closes ends at the next >. -1 without one."""
        while True:
            m = STOP.search(self.html, at) if ">" not in self.absent else None
            if m is None:
                self.absent.add(">")
                return -1
            if m[0] == ">":
                return m.end()
            close = self.find(m[0][-1], m.end())
            if close < 0:
                close = self.find(">", m.end())
                return close + 1 if close >= 0 else -1
            at = close + 1

    def raw_end(self, tag: str, at: int) -> int:
        """Place behind the closing tag of a raw element, or the end of the page."""
        if self.lower is None:
            self.lower = self.html.lower() if len(self.html.lower()) == len(self.html) else re.sub(r"[A-Z]+", lambda m: m[0].lower(), self.html)
        while (at := self.lower.find("</" + tag, at)) >= 0:
            at += 2 + len(tag)
            if at >= len(self.html) or self.html[at] in " \t\n\f\r/>":
                end = self.find(">", at)
                return end + 1 if end >= 0 else len(self.html)
        return len(self.html)


def parse(html: str) -> Page:
    """The page's blocks. Broken markup is read the way browsers do where that matters for text."""
    page, scan = Page(), Scanner(html)
    # Open elements: tag, node, boilerplate, path code, article, main.
    stack: list[tuple[str, int, bool, int, int | None, int | None]] = [("#root", 0, False, 0, None, None)]
    opened: Counter = Counter()
    run: list[str] = []

    def flush() -> None:
        words = " ".join("".join(run).split())
        run.clear()
        if words:
            _, node, _, _, article, main = stack[-1]
            page.add(node, "#text", words, article, main)

    def pop(k: int) -> None:
        if any(x[0] in BLOCK for x in stack[k:]):
            flush()
        opened.subtract(x[0] for x in stack[k:])
        del stack[k:]

    def close_one(tags: set[str], stops: set[str] | frozenset[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in tags:
                pop(k)
                return
            if stack[k][0] in stops:
                return

    at, n = 0, len(html)
    while at < n:
        if html[at] != "<":
            m = TEXT.match(html, at)
            if not stack[-1][2]:
                run.append(html_lib.unescape(m[0]) if "&" in m[0] else m[0])
            at = m.end()
            continue
        if html.startswith("<!--", at):
            end = scan.find("-->", at + 4)
            at = end + 3 if end >= 0 else n
            continue
        if html.startswith(("<!", "<?"), at):
            end = scan.find(">", at)
            at = end + 1 if end >= 0 else n
            continue
        m = TAG.match(html, at)
        end = scan.tag_end(m.end()) if m else -1
        if m is None and html.startswith("</", at) and at + 2 < n and not html[at + 2].isspace():
            bogus = scan.find(">", at)  # a comment to browsers
            at = bogus + 1 if bogus >= 0 else n
            continue
        if m is None or end < 0:
            # No tag: the sign alone is text, or all the rest if no tag can end any more.
            rest = html[at:] if ">" in scan.absent else "<"
            if not stack[-1][2]:
                run.append(html_lib.unescape(rest))
            at += len(rest)
            continue
        tag, attrs, at = m[2].lower(), html[m.end() : end - 1], end
        if m[1]:
            if tag == "br":
                flush()
            elif opened[tag] > 0:
                close_one({tag}, frozenset() if tag in SCOPE or tag in ("html", "body") else SCOPE)
            continue
        if tag in RAW:
            if not attrs.rstrip().endswith("/"):
                at = scan.raw_end(tag, at)
            continue
        if tag in BLOCK and tag not in ("br", "button", "option") and opened["p"] > 0:
            close_one({"p"}, SCOPE)
        if tag in ENDS and any(opened[x] > 0 for x in ENDS[tag]):
            close_one(ENDS[tag], {"ul", "ol", "dl", "table", "select", "div", "article", "section"})
        if tag == "body" and opened["head"] > 0:
            pop(next(k for k, x in enumerate(stack) if x[0] == "head"))
        if tag in BLOCK:
            flush()
        if tag in VOID or (attrs.rstrip().endswith("/") and tag not in BLOCK and tag != "a"):
            continue
        _, node, boiler, path, article, main = stack[-1]
        label, named = element(tag, attrs, opened["article"] > 0)
        boiler |= named
        if tag in BLOCK:
            path = code(path, label)
            if not boiler:
                article = path if tag == "article" and article is None else article
                main = path if tag == "main" and main is None else main
                node = page.add(node, label, None, article, main)
        stack.append((tag, node, boiler, path, article, main))
        opened[tag] += 1
    flush()
    page.measure()
    return page


def aligned(a: Page, b: Page) -> dict[int, int]:
    """Leaves of ``a`` with the leaves of ``b`` that simple tree matching puts beside them.

    Nodes of one label match, and as many of their children as keep both orders; equal texts count double. Equal
    subtrees at both ends of two lists of children are matched first, which the best matching allows.
    """
    out: dict[int, int] = {}
    memo: dict[tuple[int, int], int] = {}
    budget = [PAGE_PAIRS]

    def score(x: int, y: int, depth: int) -> int:
        if a.sig[x] == b.sig[y]:
            return a.weight[x]
        if a.label[x] != b.label[y]:
            return 0
        if a.text[x] is not None:
            return 1
        if a.plain[x] and b.plain[y]:
            return 2
        if (x, y) not in memo:
            kx, ky = a.kids[x], b.kids[y]
            if depth >= MATCH_DEPTH or len(kx) * len(ky) > budget[0]:
                common = Counter(a.sig[c] for c in kx) & Counter(b.sig[c] for c in ky)
                memo[x, y] = 1 + sum(common.values())
            else:
                memo[x, y] = 1 + sum(s for _, _, s in pairs(kx, ky, depth + 1))
        return memo[x, y]

    def pairs(ka: list[int], kb: list[int], depth: int) -> list[tuple[int, int, int]]:
        head = 0
        while head < min(len(ka), len(kb)) and a.sig[ka[head]] == b.sig[kb[head]]:
            head += 1
        tail = 0
        while tail < min(len(ka), len(kb)) - head and a.sig[ka[-1 - tail]] == b.sig[kb[-1 - tail]]:
            tail += 1
        ends = [*zip(ka[:head], kb[:head], strict=True), *zip(ka[len(ka) - tail :], kb[len(kb) - tail :], strict=True)]
        out = [(x, y, a.weight[x]) for x, y in ends]
        return out + between(ka[head : len(ka) - tail], kb[head : len(kb) - tail], depth)

    def between(ka: list[int], kb: list[int], depth: int) -> list[tuple[int, int, int]]:
        if not ka or not kb:
            return []
        if len(ka) * len(kb) <= min(STEP_PAIRS, budget[0]):
            budget[0] -= len(ka) * len(kb)
            return best(ka, kb, depth)
        # Equal subtrees that stand once on either side, in an order that both keep, part the lists.
        once_a, once_b = Counter(a.sig[x] for x in ka), Counter(b.sig[y] for y in kb)
        place = {b.sig[y]: j for j, y in enumerate(kb) if once_b[b.sig[y]] == 1}
        chain = increasing([(i, place[a.sig[x]]) for i, x in enumerate(ka) if once_a[a.sig[x]] == 1 and a.sig[x] in place])
        if not chain:
            waiting: dict[str, list[int]] = {}
            for y in reversed(kb):
                waiting.setdefault(b.label[y], []).append(y)
            return [(x, waiting[a.label[x]].pop(), 1) for x in ka if waiting.get(a.label[x])]
        out, i0, j0 = [], 0, 0
        for i, j in [*chain, (len(ka), len(kb))]:
            out += between(ka[i0:i], kb[j0:j], depth)
            if i < len(ka):
                out.append((ka[i], kb[j], a.weight[ka[i]]))
            i0, j0 = i + 1, j + 1
        return out

    def best(ka: list[int], kb: list[int], depth: int) -> list[tuple[int, int, int]]:
        w = [[score(x, y, depth) for y in kb] for x in ka]
        m = [[0] * (len(kb) + 1) for _ in range(len(ka) + 1)]
        for i in range(len(ka)):
            for j in range(len(kb)):
                m[i + 1][j + 1] = max(m[i][j + 1], m[i + 1][j], m[i][j] + w[i][j])
        out, i, j = [], len(ka), len(kb)
        while i and j:
            if w[i - 1][j - 1] and m[i][j] == m[i - 1][j - 1] + w[i - 1][j - 1]:
                i, j = i - 1, j - 1
                out.append((ka[i], kb[j], w[i][j]))
            elif m[i][j] == m[i - 1][j]:
                i -= 1
            else:
                j -= 1
        return out

    todo = [(0, 0, 0)]
    while todo:
        x, y, depth = todo.pop()
        if a.text[x] is not None:
            out[x] = y
        elif a.sig[x] == b.sig[y]:
            out.update((x + k, y + k) for k in range(a.size[x]) if a.text[x + k] is not None)
        else:
            todo += [(i, j, depth + 1) for i, j, _ in pairs(a.kids[x], b.kids[y], min(depth, MATCH_DEPTH - 2))]
    return out


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, in order of the first, whose seconds increase."""
    from bisect import bisect_left

    ends: list[int] = []
    at: list[int] = []
    before = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        p = bisect_left(ends, j)
        if p == len(ends):
            ends.append(j)
            at.append(k)
        else:
            ends[p], at[p] = j, k
        before[k] = at[p - 1] if p else -1
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]
