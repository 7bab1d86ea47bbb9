"""HTML extraction with site style trees.

Every page is parsed once into its elements and text blocks.  The elements of a host's pages that have the same labels (tag,
classes, role) from the root down are one node of the site style tree, which is held as a table of nodes with

* presentation: the entropy of the sequences of child labels that the node shows, over the pages that have it;
* content: one minus the mean, over the texts seen at the node, of the entropy of how a text spreads over those pages.  A text
  on every page counts 0, one on a single page 1.

On a page, an element without elements in it has its node's content as importance; any other has
(1 - gamma ** l) * presentation + gamma ** l * (mean over its children and own text), l being how many different sequences its node
shows.  A branch all of whose elements have an importance below ``low`` leaves the page.  Tags and class words only settle
ties: below ``high``, branches that they mark, or that lie outside the article a page marks (article, main, role=main), go as well.

A clean-up of what the contract names follows, as it may be unique to each page: marked elements (class words that say nothing
else than menu, advert, comments and the like; a list in an article that is called a menu, only if it has links) and, on pages with a marked article, what lies outside it.  Words that say more, such as
share-price or article-header, never remove by themselves, and nothing on a heading does.  Inside the marked article, paragraphs, headings,
lists, quotes and tables without a class of their own are the content asked for, however often a site repeats them.

Statistics are sums over (node, text) and (node, sequence), made in each task before they meet, so a host with a third of all
pages is no hot key.  The nodes seen on ``least_pages`` pages or more are broadcast if they number ``most_nodes`` at most, else
joined.  Parsed pages are staged; html is never shuffled.  Null html, and an empty table, give empty texts and no rows; a page without a host or
whose nodes were seen on too few pages is judged by the marks; where the tree would leave nothing of a page, the marks alone
judge it; a branch at ``low`` or ``high``
exactly stays; an element without an end tag ends with its parent; repeated rows are pages of their own; pages may be of any length and depth; columns but page_id, url and html are ignored, whatever their names.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenledger.llm.common import stage, table
from tokenledger.llm.pieces import blocks as cut
from tokenledger.llm.url_filter import with_host_and_path

#: Elements whose content is text up to their end tag, or the end of the page.
RAW = "script|style|textarea|title|iframe|xmp"
#: Elements that go whole where they are closed and hold no block; else they are elements like others, which end with their parent.
SOFT = "svg|select|noscript|template"
BLOCK = "p|div|article|main|section|body|html|ul|ol|li|dl|table|h[1-6]|form|footer|header|aside|nav|pre|blockquote|figure"
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>{RAW})(?=[\s/>])[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    rf"|<(?P<soft>{SOFT})(?=[\s/>])[^>]*>(?:(?!</?(?:{BLOCK})[\s/>]|<(?P=soft)[\s/>]).)*?</(?P=soft)\s*>"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|</?[a-z][^>]*>|<[!?/][^>]*>",
    re.S | re.I,
)
ATTR = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img object canvas "
                   "math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom msub msup msubsup munder mover munderover mmultiscripts mtable mtr mtd semantics annotation".split())
NOISE_TAGS = frozenset("head nav header footer aside form script style noscript template iframe button select textarea dialog menu svg object input".split())
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent notice notices gdpr nav navbar navigation "
    "menu menus breadcrumb breadcrumbs sidebar header footer masthead comment comments disqus reply replies respond share sharing social related newsletter "
    "subscribe signup login search popup modal overlay copyright contentinfo complementary alert dialog toolbar widget pagination pager".split()
)
#: Words that alone take an element out of a line of text.
AD_WORDS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion".split())
#: A list in an article that only these words mark is a menu if it has links.
MENU_WORDS, LISTS = frozenset(("menu", "menus")), frozenset(("ul", "ol", "dl", "table"))
#: Words that say nothing about what an element holds.
PLACES = frozenset("site page top bottom left right main list bar box block slot area section links buttons button icons wrapper wrap container inner outer row col unit form thread item".split())
MAIN, HEADINGS = frozenset(("article", "main")), frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose text is content wherever the main part of a page holds them.
FLOW = frozenset("article main p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre table thead tbody tfoot tr td th caption figure figcaption section body html".split())
CLOSES = {"p": ("p",), "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p")}
#: Opened blocks end these.
OPEN_FORMS = ("option", "optgroup", "select")
P_ENDERS = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split())
SPACES = re.compile(r"[\x20\x09-\x0D\xa0\s]+")
GAMMA, LOW, HIGH, LEAST_PAGES, MOST_NODES = 0.9, 0.5, 0.9, 5, 1_000_000
#: Marks of an element: by a word or tag that says noise, by one that may, main content, a flow element without a class.
STRONG, WEAK, IS_MAIN, BARE_FLOW, IS_AD, MENU = 1, 2, 4, 8, 16, 32
DOM = "row long, page_id long, url string, sited boolean, node array<long>, parent array<int>, mark array<int>, at array<int>, text array<string>"


def judged(tag: str, attrs: str, in_main: bool) -> tuple[str, int]:
    """(label, marks) of an element."""
    mark = IS_MAIN * (tag in MAIN) | (WEAK if tag == "header" and in_main else STRONG) * (tag in NOISE_TAGS)
    names = []
    if attrs and not attrs.isspace():
        for m in ATTR.finditer(attrs):
            tokens = (m[2] or m[3] or m[4] or "").lower().split()
            if m[1].lower() != "id":
                names += tokens
            mark |= IS_MAIN * (m[1].lower() == "role" and "main" in tokens)
            for t in tokens if tag not in HEADINGS else ():
                words = {w for w in re.split(r"[^a-z]+", t) if w}
                if not words.isdisjoint(NOISE_WORDS):
                    mark |= STRONG if words <= NOISE_WORDS | PLACES else WEAK
                    mark |= IS_AD * (not words.isdisjoint(AD_WORDS))
                    mark |= MENU * (in_main and tag in LISTS and words - PLACES <= MENU_WORDS)
    if not names:
        return tag, mark | BARE_FLOW * (tag in FLOW)
    return f"{tag}.{'.'.join(re.sub('[0-9]+', '#', n) for n in sorted(set(names)))}", mark


class Dom:
    """Elements in page order (the root is number 0) with node, parent and marks; text blocks with their element."""

    def __init__(self, page: str | None, host: str = ""):
        self.node, self.parent, self.mark, self.at, self.text = [xxhash.xxh3_64_intdigest(host)], [-1], [BARE_FLOW], [], []
        stack, open_main = [("", 0)], 0
        opened: dict[str, int] = {}  # elements of a tag on the stack, so that an end tag without one costs nothing
        words: list[str] = []
        menus = 0  # lists that may be menus, open or without a link
        muted, depth = "", 0  # a marked element within a line: its text goes, the line stays whole

        def flush():
            if words:
                text = SPACES.sub(" ", entities.unescape("".join(words))).strip()
                words.clear()
                if text:
                    self.at.append(stack[-1][1])
                    self.text.append(text)

        at, page = 0, page or ""
        for m in TOKEN.finditer(page):
            if m.start() > at and not muted:
                words.append(page[at : m.start()])
            at = m.end()
            tag = m["tag"]
            if tag is None:
                if m["raw"] is not None and m["raw"].lower() == "title":
                    flush()
                continue
            tag = tag.lower()
            if tag in INLINE:
                if tag == "a" and menus and "href" in m["attrs"]:
                    for _, i in stack:
                        self.mark[i] &= ~MENU
                    menus = 0
                if muted:
                    depth += 0 if tag != muted else -1 if m["end"] else 1
                    muted = muted if depth > 0 else ""
                elif not m["end"] and tag not in VOID and ("=" in m["attrs"]) and judged(tag, m["attrs"], False)[1] & (STRONG | IS_AD) == STRONG | IS_AD:
                    muted, depth = tag, 1
                continue
            muted = ""
            flush()
            if tag in VOID:
                continue
            if m["end"]:
                while opened.get(tag):
                    gone, i = stack.pop()
                    opened[gone] -= 1
                    open_main -= self.mark[i] & IS_MAIN > 0
                    if gone == tag:
                        break
                continue
            closes = CLOSES.get(tag) or (("p",) if tag in P_ENDERS else ())
            if tag in P_ENDERS or tag == "p":
                closes += OPEN_FORMS
            while len(stack) > 1 and stack[-1][0] in closes:
                gone, i = stack.pop()
                opened[gone] -= 1
                open_main -= self.mark[i] & IS_MAIN > 0
            label, mark = judged(tag, m["attrs"], open_main > 0)
            open_main += mark & IS_MAIN > 0
            above = stack[-1][1]
            stack.append((tag, len(self.node)))
            self.node.append(xxhash.xxh3_64_intdigest(label, seed=self.node[above]))
            self.parent.append(above)
            self.mark.append(mark)
            menus += mark & MENU > 0
            opened[tag] = opened.get(tag, 0) + 1
        if not muted:
            words.append(page[at:])
        flush()
        self.mark = [m & ~STRONG if m & MENU else m for m in self.mark]  # a list of dishes, say


def kept(parent: list[int], mark: list[int], at: list[int], tree=None, low: float = LOW, high: float = HIGH, clean: bool = True) -> tuple[list[bool], int]:
    """(whether each block stays, how many the tree removed).  tree: (presentation, gamma ** l, content) of each element's node, nan where it is not known; None: no tree."""
    n = len(parent)
    strong, main, flow = [False] * n, [False] * n, [False] * n
    weak = [False] * n
    above_main = [False] * n
    for i in range(n):  # parents come first
        p = parent[i]
        m, in_main = mark[i], p >= 0 and main[p]
        strong[i] = bool(m & STRONG) or (p >= 0 and strong[p])
        weak[i] = bool(m & WEAK) or (p >= 0 and weak[p])
        main[i] = in_main or bool(m & IS_MAIN)
        flow[i] = bool(m & BARE_FLOW) and (flow[p] if in_main else True) if p >= 0 else True
    has_main = any(main[e] and not strong[e] for e in at)
    for i in range(n - 1, 0, -1):
        if main[i] or above_main[i]:
            above_main[parent[i]] = True
    marked = [strong[e] or (has_main and not main[e]) for e in range(n)]
    by_marks = [not (clean and marked[e]) for e in at]
    if tree is None:
        return by_marks, 0
    pres, weight, content = tree
    texts, sums, count, gone = [0] * n, [0.0] * n, [0] * n, [True] * n
    for e in at:
        texts[e] += 1
    for i in range(n - 1, -1, -1):
        if pres[i] != pres[i]:  # nothing known about the node
            own = 1.0
        elif not count[i]:
            own = content[i] if texts[i] else 0.0
        else:
            s, c = (sums[i] + content[i], count[i] + 1) if texts[i] else (sums[i], count[i])
            own = (1 - weight[i]) * pres[i] + weight[i] * s / c
        bound = high if strong[i] or weak[i] or (has_main and not main[i] and not above_main[i]) else low
        gone[i] = gone[i] and own < bound and not (main[i] and flow[i] and not strong[i] and not weak[i])
        if i:
            p = parent[i]
            sums[p] += own
            count[p] += 1
            gone[p] = gone[p] and gone[i]
    stay = [ok and not gone[e] for ok, e in zip(by_marks, at, strict=True)]
    if any(by_marks) and not any(stay):
        return by_marks, 0
    return stay, sum(gone[e] for e in at)


def main_text(page: str | None) -> str:
    """Main text of a page by itself, without its site's tree."""
    d = Dom(page)
    return "\n".join(t for t, ok in zip(d.text, kept(d.parent, d.mark, d.at)[0], strict=True) if ok)


def lists(values: list[list], kind: pa.DataType) -> pa.ListArray:
    flat = [x for v in values for x in v]
    if kind == pa.int64():
        flat = np.array(flat, np.uint64).view(np.int64)
    return pa.ListArray.from_arrays(np.r_[0, np.cumsum([len(v) for v in values])].astype(np.int32), pa.array(flat, kind))


def parsed(pages: DataFrame) -> DataFrame:
    """The pages (page_id, url, html) as rows of DOM, staged."""
    pages = with_host_and_path(pages.select("page_id", "url", "html")).select(F.monotonically_increasing_id().alias("row"), "page_id", "url", "host", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in cut(batches, "html", 1_000_000):
            doms = [Dom(t, h) for t, h in zip(b["html"].to_pylist(), b["host"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b["row"], b["page_id"], b["url"], pa.array([h != "" for h in b["host"].to_pylist()]), lists([d.node for d in doms], pa.int64()), lists([d.parent for d in doms], pa.int32()),
                 lists([d.mark for d in doms], pa.int32()), lists([d.at for d in doms], pa.int32()), lists([d.text for d in doms], pa.string())],
                names=["row", "page_id", "url", "sited", "node", "parent", "mark", "at", "text"])

    return stage(pages.mapInArrow(run, DOM), "dom")


def seen_on(node: list[int], parent: list[int], at: list[int], text: list[str]) -> tuple[dict[int, int], dict[tuple[int, int], int]]:
    """A page's (sequence of child nodes by node, count by node and text), as 64-bit values."""
    kids: dict[int, list[int]] = {}
    for i in range(1, len(node)):
        some = kids.setdefault(parent[i], [])
        if not some or some[-1] != node[i]:
            some.append(node[i])
    shapes: dict[int, int] = {}
    for i, x in enumerate(node):
        shapes[x] = hash((shapes.get(x, 0), *kids.get(i, ())))
    counts: dict[tuple[int, int], int] = {}
    for e, t in zip(at, text, strict=True):
        key = (node[e], xxhash.xxh3_64_intdigest(t) - 2**63)
        counts[key] = counts.get(key, 0) + 1
    return shapes, counts


def site_styles(dom: DataFrame, least_pages: int = LEAST_PAGES) -> DataFrame:
    """The site style trees of staged pages: (node, pages, styles, presentation, content) of the nodes on enough pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, bool, int], int] = {}
        logs: dict[tuple[int, bool, int], float] = {}

        def out() -> pa.RecordBatch:
            node, is_text, value = zip(*total, strict=True) if total else ((), (), ())
            made = pa.RecordBatch.from_arrays(
                [pa.array(node, pa.int64()), pa.array(is_text, pa.bool_()), pa.array(value, pa.int64()), pa.array(total.values(), pa.int64()), pa.array([logs.get(k, 0.0) for k in total], pa.float64())],
                names=["node", "is_text", "value", "total", "clogc"])
            total.clear()
            logs.clear()
            return made

        for b in batches:
            for row in zip(*(b[c] for c in ("node", "parent", "at", "text")), strict=True):
                shapes, counts = seen_on(*(x.as_py() for x in row))
                for n, s in shapes.items():
                    total[n, False, s] = total.get((n, False, s), 0) + 1
                for (n, t), c in counts.items():
                    total[n, True, t] = total.get((n, True, t), 0) + c
                    if c > 1:
                        logs[n, True, t] = logs.get((n, True, t), 0.0) + c * np.log(c)
                if len(total) > 200_000:
                    yield out()
        yield out()

    seen = dom.where("sited").select("node", "parent", "at", "text").mapInArrow(run, "node long, is_text boolean, value long, total long, clogc double")
    by_value = seen.groupBy("node", "is_text", "value").agg(F.sum("total").alias("n"), F.sum("clogc").alias("clogc"))
    shape, n = ~F.col("is_text"), F.col("n")
    # Entropy of a text over pages: log N - sum c log c / N; a node's sequences count its pages
    by_node = by_value.groupBy("node").agg(
        F.sum(F.when(shape, n)).alias("pages"), F.count_if(shape).alias("styles"), F.sum(F.when(shape, n * F.ln(n))).alias("plogp"), F.avg(F.when(~shape, F.ln(n) - F.col("clogc") / n)).alias("spread"))
    base = F.ln("pages")
    return by_node.where(F.col("pages") >= max(2, least_pages)).select(
        "node", "pages", "styles", (1 - F.col("plogp") / F.col("pages") / base).alias("presentation"), F.coalesce(F.greatest(F.lit(0.0), 1 - F.col("spread") / base), F.lit(0.0)).alias("content"))


def extract(pages: DataFrame, low: float = LOW, high: float = HIGH, least_pages: int = LEAST_PAGES, most_nodes: int = MOST_NODES, gamma: float = GAMMA, clean: bool = True) -> DataFrame:
    """(page_id, url, text, n_chars, n_blocks, n_by_tree) a row of pages (page_id, url, html); n_by_tree of n_blocks blocks left through the tree."""
    dom = parsed(pages)
    styles = stage(site_styles(dom, least_pages).select("node", F.col("presentation").alias("pres"), F.pow(F.lit(gamma), F.col("styles")).alias("weight"), "content"), "styles")
    if styles.count() <= most_nodes:
        found = styles.toArrow().sort_by("node")
        known = dom.sparkSession.sparkContext.broadcast([found[c].to_numpy() for c in ("node", "pres", "weight", "content")])
        dom = dom.withColumn("known", F.lit(None).cast("array<struct<node:long,pres:double,weight:double,content:double>>"))
    else:
        known = None
        parts = dom.where("sited").select("row", F.explode(F.array_distinct("node")).alias("node")).withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(32)))
        salted = styles.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(31).cast("long"))))
        of_row = parts.join(salted, ["node", "salt"]).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("node", "pres", "weight", "content"))).alias("known"))  # bounded by the page
        dom = dom.join(of_row, "row", "left")

    def looked_up(nodes: np.ndarray, table_: list[np.ndarray]) -> list[list[float]]:
        if not len(table_[0]):
            return [np.full(len(nodes), np.nan).tolist()] * 3
        i = np.minimum(np.searchsorted(table_[0], nodes), len(table_[0]) - 1)
        there = table_[0][i] == nodes
        return [np.where(there, c[i], np.nan).tolist() for c in table_[1:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for node, parent, mark, at, text, sited, own in zip(*(b[c] for c in ("node", "parent", "mark", "at", "text", "sited", "known")), strict=True):
                table_ = known.value if known is not None else [own.values.field(i).to_numpy() for i in range(4)] if own.is_valid else [np.empty(0)] * 4
                tree = looked_up(node.values.to_numpy(), table_) if sited.as_py() else None
                at, text = at.as_py(), text.as_py()
                stay, n = kept(parent.as_py(), mark.as_py(), at, tree, low, high, clean)
                rows.append(("\n".join(t for t, ok in zip(text, stay, strict=True) if ok), len(at), n))
            got, n_blocks, by_tree = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [b["page_id"], b["url"], pa.array(got, pa.string()), pa.array([len(t) for t in got], pa.int64()), pa.array(n_blocks, pa.int64()), pa.array(by_tree, pa.int64())],
                names=["page_id", "url", "text", "n_chars", "n_blocks", "n_by_tree"])

    return dom.select("page_id", "url", "node", "parent", "mark", "at", "text", "sited", "known").mapInArrow(run, "page_id long, url string, text string, n_chars long, n_blocks long, n_by_tree long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
