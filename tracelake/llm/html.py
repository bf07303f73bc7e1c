"""Main-text extraction with a site style tree (operator 2).

All pages of a host are merged into one style tree.  A node is the path of
block elements (tag and first class or id, digits blanked); it keeps in how
many pages it stands, which sequences of children it shows there, and which
texts its leaves hold (digits blanked; outside articles, a text that is nearly
all links counts as presentation, the same everywhere).  Importance is
entropy-based: a node whose pages show many presentations is important, a leaf
is the more important the fewer pages share its texts, and an inner node
combines its own presentation with its children's importance, less so the more
children it has.  A branch of which every node is of low importance is noise and
is removed from each page, inside articles as well as outside.

Few pages say little, so importance is drawn to a prior, which counts as
``PRIOR_PAGES`` pages: 1 inside article and main elements, 0.5 elsewhere.  So a
box that all pages repeat goes from 3 pages on, inside an article from 8.  Pages
with the same texts count once, so copies of a page do not make it presentation.

Statistics cannot tell unique adverts and reader comments from content, so names
are a prior of weight: scripts, styles, forms, menus, footers, asides, and
elements whose class or role, or the id of a box, names an advert, notice, menu,
side bar or comments, with nothing but general words beside, are noise; headers
are, outside articles.  With an article or main element the text is taken inside
it: in the articles if they hold half of the main element's text or more.

Counting is relational, on hashes: one row per page and node, style or text.
Nodes that one page shows alone are important; they reach their host's tree
only as a count by parent, so the tree has one row for each path of two pages
or more.  Of removed branches only the topmost nodes are joined with the pages.

Defined cases: null or empty html gives empty text; a url without a host
counts as the host ''; repeated rows give a row each; unclosed and stray tags
follow the usual rules of HTML; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import stored

_TOKEN = re.compile(r"""<!--(?:>|->|.*?(?:-->|\Z))|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""", re.S)
_NAMES = re.compile(r"""(?:^|[\s"'/])(class|id|role)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""", re.I)
_RAW = {x: re.compile(rf"</{x}(?=[\s/>])", re.I) for x in ("script", "style", "textarea", "title", "iframe", "noscript", "xmp", "noembed", "noframes")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that an opening tag of these names ends, up to the list or table it is in.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
_NOISE_TAGS = frozenset("nav footer aside form script style noscript template iframe object svg canvas button select input textarea dialog menu search head datalist audio video map".split())
_NOISE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adslot sponsor sponsored sponsors promo promos promotion banner banners cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login sidebar sidebars aside widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs topbar toolbar footer copyright share sharing social related recommended comments comment commentlist respond reply replies disqus pagination pager search contentinfo complementary".split()
)
#: Words that may stand beside a noise word in one name.
_GENERAL = frozenset("a all area bar block body bottom box btn button center col column container content desktop global group head heading holder id in inner item items layout left link links list lower main mobile module nav new outer page pane panel post posts primary region right row secondary section site slot small space sticky sub sys table text title top unit upper user users view wrap wrapper zone".split())
_HEADERS = frozenset("header masthead sitehead".split())
#: Elements whose id is the slug of their text rather than a name.
_SLUGGED = frozenset("h1 h2 h3 h4 h5 h6 section p a dt li".split())
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
GAMMA, PRIOR_PAGES, PRIOR_INSIDE, PRIOR_OUTSIDE = 0.9, 3, 1.0, 0.5
_DIGITS = re.compile(r"\d+")

_known: dict[tuple, tuple[int, bool, bool]] = {}


def _node(parent: int, tag: str, rest: str) -> tuple[int, bool, bool]:
    """Hash of the element's path, whether its names make it noise, and whether they make it a header."""
    key = (parent, tag, rest)
    if (have := _known.get(key)) is not None:
        return have
    names = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in reversed(list(_NAMES.finditer(rest)))} if rest else {}
    first = (names.get("class") or names.get("id") or "").split()
    sign = tag + ("." + re.sub(r"\d+", "0", first[0]) if first else "")
    noise, head = tag in _NOISE_TAGS, tag == "header"
    if tag not in ("html", "body", "main"):
        own = [v for k, v in names.items() if k != "id" or tag not in _SLUGGED]
        for token in " ".join(own).split():
            words = {w.lower() for w in _WORD.findall(token)}
            named = words & _NOISE_NAMES
            if words <= _NOISE_NAMES | _GENERAL:  # "related-work" or "search-history" name other things
                noise |= bool(named) if tag != "article" else bool(named & {"comment", "comments", "reply", "ad", "advert", "sponsored"})
            head |= bool(words & _HEADERS) and words <= _HEADERS | _GENERAL
    article = names.get("role", "").lower() in ("article", "main")
    h = xxhash.xxh64_intdigest(f"{parent} {sign}") >> 1
    if len(_known) > 200_000:
        _known.clear()
    _known[key] = have = (h, noise, head or article and None)
    return have


class Page:
    """The blocks of a page, and its nodes with their children."""

    def __init__(self, html: str):
        #: (paths of the open elements, noise, inside an article, inside main, text, whether it is nearly all links)
        self.blocks: list[tuple[tuple[int, ...], bool, bool, bool, str, bool]] = []
        self.inside: dict[int, bool] = {0: False}
        self.children: dict[int, list[list[int]]] = {}
        self._stack: list[tuple[str, int, bool, bool, bool, list[int]]] = [("", 0, False, False, False, [])]
        self._open: dict[str, int] = {}
        self._text: list[str] = []
        self._in_link, self._linked = False, 0
        self._parse(html)

    def _flush(self) -> None:
        if self._text:
            raw = "".join(self._text)
            text = " ".join(unescape(raw).split())
            if text:
                top = self._stack[-1]
                self.blocks.append((tuple(s[1] for s in self._stack), top[2], top[3], top[4], text, 5 * self._linked >= 4 * len(raw)))
            self._text.clear()
            self._linked = 0

    def _pop(self) -> None:
        tag, path, *_, children = self._stack.pop()
        self._open[tag] -= 1
        self.children.setdefault(path, []).append(children)

    def _push(self, tag: str, rest: str) -> None:
        _, parent, noise, article, main, siblings = self._stack[-1]
        path, own, head = _node(parent, tag, rest)
        own |= bool(head) and not article
        siblings.append(path)
        article, main = article or tag == "article" and not own, main or tag == "main" or head is None
        self.inside[path] = article or main
        self._stack.append((tag, path, noise or own, article, main, []))
        self._open[tag] = self._open.get(tag, 0) + 1

    def _start(self, tag: str, rest: str) -> None:
        if tag == "br":
            self._text.append(" ")
            return
        if tag == "a":
            self._in_link = True
        block = tag in _BLOCK
        if block:
            self._flush()
            if self._open.get("p"):
                while self._stack[-1][0] not in _BLOCK:
                    self._pop()
                if self._stack[-1][0] == "p":
                    self._pop()
            if tag in _ENDS:
                ends, within = _ENDS[tag]
                for i in range(len(self._stack) - 1, 0, -1):
                    name = self._stack[i][0]
                    if name in within:
                        break
                    if name in ends:
                        while len(self._stack) > i:
                            self._pop()
                        break
        if tag in _VOID:
            return
        if block or _node(self._stack[-1][1], tag, rest)[1]:
            self._push(tag, rest)

    def _end(self, tag: str) -> None:
        if tag in _BLOCK:
            self._flush()
        elif tag == "a":
            self._in_link = False
        if self._open.get(tag):
            while True:
                last = self._stack[-1][0]
                self._pop()
                if last == tag:
                    break

    def _add(self, text: str) -> None:
        top = self._stack[-1]
        if not (top[2] and top[0] not in _BLOCK):  # inline noise is dropped at once
            self._text.append(text)
            self._linked += len(text) if self._in_link else 0

    def _parse(self, html: str) -> None:
        at, end = 0, len(html)
        while at < end:
            m = _TOKEN.search(html, at)
            if m is None:
                self._add(html[at:])
                break
            if m.start() > at:
                self._add(html[at : m.start()])
            at = m.end()
            tag = m[2] or m[5]
            if not tag:
                continue
            tag = tag.lower()
            if m[1] or m[4]:
                self._end(tag)
                continue
            rest = m[3] if m[2] else m[6]
            if tag in _RAW:
                close = _RAW[tag].search(html, at)
                at = close.start() if close else end
                continue
            self._start(tag, rest)
        self._flush()
        while len(self._stack) > 1:
            self._pop()
        self.children.setdefault(0, []).append(self._stack[0][5])

    def kept(self, removed: frozenset[int]) -> list[str]:
        """Texts of the blocks to keep; paths in `removed` are of low importance."""
        own = [b for b in self.blocks if not b[1]]
        articles, main = [b for b in own if b[2]], [b for b in own if b[3]]
        size = lambda blocks: sum(len(b[4]) for b in blocks)
        inside = main if main and 2 * size(articles) < size(main) else articles
        return [b[4] for b in inside or own if not removed.intersection(b[0])]

    def version(self) -> int:
        """The same for pages that say the same."""
        return _hash("\n".join(b[4] for b in self.blocks if not b[1]))


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1


def _observed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per page and distinct (node, kind, value): kind 0 a style (sequence of children), 1 a text of the node."""
    for batch in batches:
        out: list[tuple] = []
        for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            if not html:
                continue
            page = Page(html)
            version = page.version()
            parent = {c: p for p, lists in page.children.items() for children in lists for c in children}
            rows = {(p, 0, _hash(" ".join(map(str, children))), len(children)) for p, lists in page.children.items() for children in lists}
            rows |= {(b[0][-1], 1, 0 if b[5] and not (b[2] or b[3]) else _hash(_DIGITS.sub("0", b[4])), 0) for b in page.blocks}
            out += [(host, version, p, parent.get(p, -1), page.inside[p], kind, value, n) for p, kind, value, n in rows]
        columns = list(zip(*out, strict=True)) if out else [[]] * 8
        types = [*[pa.int64()] * 4, pa.bool_(), pa.int32(), pa.int64(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, types, strict=True)], ["host", "version", "path", "parent", "inside", "kind", "value", "n"])


_TREE = "host long, path long, pages long, importance double, highest double, top boolean"


def _importance(least: float):
    """Importance of the nodes of one host, from the leaves up, and which are the topmost of branches under `least`.

    Rows: path, parent, pages, importance of the styles and of the texts, the mean number of children, and how many
    children stand on one page only; those are as important as can be.
    """

    def run(table: pa.Table) -> pa.Table:
        rows = {r["path"]: r for r in table.to_pylist()}
        children: dict[int, list[int]] = {}
        for p, r in rows.items():
            if r["parent"] in rows and r["parent"] != p:
                children.setdefault(r["parent"], []).append(p)
        value: dict[int, float] = {}
        highest: dict[int, float] = {}
        order, todo = [], [p for p, r in rows.items() if r["parent"] not in rows or r["parent"] == p]
        while todo:
            order.append(p := todo.pop())
            todo += children.get(p, [])
        for p in reversed(order):
            r, own = rows[p], children.get(p, [])
            parts = [(value[c], rows[c]["pages"]) for c in own] + [(1.0, r["alone"])] * bool(r["alone"])
            if r["texts"] is not None:
                parts.append((r["texts"], r["pages"]))
            below = sum(v * n for v, n in parts) / sum(n for _, n in parts) if parts else 1.0
            weight = GAMMA ** (r["n"] or 0)
            value[p] = below if not own and not r["alone"] else (1 - weight) * (r["styles"] if r["styles"] is not None else 1.0) + weight * below
            highest[p] = max([value[p], *(highest[c] for c in own), *([1.0] * bool(r["alone"])), *([r["texts"]] if r["texts"] is not None else [])])
        low = {p for p in order if p and highest[p] < least}
        top = [p in low and rows[p]["parent"] not in low for p in order]
        columns = [[rows[p]["host"] for p in order], order, [rows[p]["pages"] for p in order], [value[p] for p in order], [highest[p] for p in order], top]
        types = [pa.int64()] * 3 + [pa.float64()] * 2 + [pa.bool_()]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, types, strict=True)], ["host", "path", "pages", "importance", "highest", "top"])

    return run


def style_tree(pages: DataFrame, least: float = 0.3) -> DataFrame:
    """(host, path, pages, importance, highest, top) of every node that two pages or more of a host show.

    highest is the greatest importance in the branch, top marks the topmost node of a branch under `least`; pages has
    host (long) and html.
    """
    seen = pages.mapInArrow(_observed, "host long, version long, path long, parent long, inside boolean, kind int, value long, n int")
    counts = seen.groupBy("host", "path", "parent", "inside", "kind", "value").agg(F.count_distinct("version").alias("k"), F.max("n").alias("n"))
    style, text = F.col("kind") == 0, F.col("kind") == 1
    per = counts.groupBy("host", "path", "parent", "inside").agg(
        F.sum(F.when(style, F.col("k"))).alias("pages"),
        F.sum(F.when(style, F.col("k") * F.log("k"))).alias("klogk"),
        F.avg(F.when(text, F.log("k"))).alias("logk"),
        (F.sum(F.when(style, F.col("k") * F.col("n"))) / F.sum(F.when(style, F.col("k")))).alias("n"),
    )
    # entropies to the base of the number of pages, drawn to the prior
    m = F.greatest(F.coalesce("pages", F.lit(1)), F.lit(1)).cast("double")
    prior = F.when(F.col("inside"), PRIOR_INSIDE).otherwise(PRIOR_OUTSIDE)
    drawn = lambda x: (m * F.when(m > 1, F.greatest(F.lit(0.0), x)).otherwise(1.0) + PRIOR_PAGES * prior) / (m + PRIOR_PAGES)
    styles = drawn((F.log(m) - F.col("klogk") / m) / F.log(m))
    texts = F.when(F.col("logk").isNotNull(), drawn(1 - F.col("logk") / F.log(m)))
    per = stored(per.select("host", "path", "parent", m.cast("long").alias("pages"), styles.alias("styles"), texts.alias("texts"), "n"))
    alone = per.where("pages = 1").groupBy("host", F.col("parent").alias("path")).agg(F.count("*").alias("alone"))
    shown = per.where("pages > 1").join(alone, ["host", "path"], "left").withColumn("alone", F.coalesce("alone", F.lit(0)))
    return shown.groupBy("host").applyInArrow(_importance(least), _TREE)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for html, removed in zip(batch.column("html").to_pylist(), batch.column("removed").to_pylist(), strict=True):
            texts.append("\n".join(Page(html).kept(frozenset(removed or ()))) if html else "")
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def main_text(pages: DataFrame, least_importance: float = 0.3, most_paths: int = 500_000) -> DataFrame:
    """page_id, url, text.  Branches of which all nodes are under least_importance go."""
    host = F.xxhash64(F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host.alias("host"))
    low = style_tree(rows.select("host", "html"), least_importance).where("top")
    low = stored(low.groupBy(F.col("host").alias("l_host")).agg(F.collect_list("path").alias("removed"), F.count("*").alias("n_paths")))
    small = (low.agg(F.sum("n_paths")).first()[0] or 0) <= most_paths
    joined = rows.join(F.broadcast(low) if small else low, F.col("host") == F.col("l_host"), "left")
    return joined.select("page_id", "url", "html", "removed").mapInArrow(_extracted, "page_id long, url string, text string")
