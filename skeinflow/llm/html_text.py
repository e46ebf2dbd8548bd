"""Main text of web pages: site templates and boilerplate elements go, blocks of the article stay.

A page is read into blocks with one pass over its tags, closing what HTML lets authors leave open. Every element with
text, whatever it is, has a hash of its subtree. Spark counts, for each host, on how many different pages (by their main
text, so copies of a page count once) a subtree stands; one on at least MIN_PAGES pages and on at least MIN_SHARE of the
host's is the host's template. A block goes if template subtrees cover all of its text, so a label or link that recurs
takes no paragraph with it. Where the page marks an article (or a main part), blocks in it stay whatever recurs: headings
such as "References" stand on every page of a host and are text all the same. A host's list of these is bounded: there are at most 1 / MIN_SHARE times as many as an
average page has subtrees.

The second step needs no other pages, and so serves hosts that have few: elements that are menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles or comments go by element, role or name; if the page marks an article
(or a main part), only that counts. A name is a class or id, read as one word without its hyphens; only outside the article
does its first part count for it, so `notice-period` or `cookie-recipe` in an article are no notices.

Work grows with the page's length alone: no end of a tag is looked for twice, and elements stand at most DEPTH deep (one
deeper ends the one that it stands in, as in browsers). A quote that is never closed ends with its tag.

A null or empty page has an empty text. A null url, or one without a host, belongs to the empty host. Repeated rows give
repeated results and count as one page. An empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cuts import cut
from .texts import small_batches, table

MIN_PAGES = 10
MIN_SHARE = 0.5
#: Template hashes (of all hosts) that are sent to every task; with more, pages are dealt to SLICES of their host and joined.
SENT_HASHES = 500_000
SLICES = 64
DEPTH = 512

#: Element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
GONE = frozenset("script style head title noscript template iframe svg math canvas object embed audio video nav footer aside form button select input textarea label dialog menu search datalist map noembed noframes applet".split())
#: Starting one of these ends an open one of those, up to the nearest of the stops.
CLOSES = {
    "li": ("li", ("ul", "ol", "menu", "dir")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")),
    "thead": ("tr td th tbody thead", ("table",)), "tbody": ("tr td th tbody thead", ("table",)), "tfoot": ("tr td th tbody thead", ("table",)), "option": ("option", ("select", "datalist")),
}
ENDS_P = BLOCKS - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "legend", "option"}
#: Names of classes and ids that mark what is no main text, and what may follow some of them.
_PLACE = "(?:links?|buttons?|icons?|bars?|box|boxes|lists?|sections?|areas?|blocks?|wrap|wrapper|container|panel|widgets?|forms?|posts?|articles?|stories|content|items?|media|tools?)"
NAMES = re.compile(
    r"^(?:ads?|adv|adverts?|advertis\w+|ads(?:ense|by\w+)|ad(?:box|slot|unit|banner|wrapper|container)|\w*banners?|sponsor(?:s|ed)?|promos?|promotion(?:s|al)?|cookies?(?:bar|box|policy|law|popup|message|warning|overlay|modal|alert)?"
    r"|\w*(?:cookies?|gdpr|privacy)(?:notice|consent|banner)\w*|gdpr|consent(?:bar|box|manager|popup|overlay|modal|message)?|\w*notices?|notifications?"
    r"|newsletters?\w*|subscri(?:be|ption)\w*|paywall|\w*sidebars?|\w*menus?|nav|nav(?:bar|igation|menu|list|links)|\w+nav|breadcrumbs?|footers?|\w+footer|masthead|\w*comments?(?:list|section|form|area)?"
    rf"|disqus\w*|respond|replies|(?:shar(?:e|ing)|social|related|recommended|search|skip|login|signup|popups?|modal|overlay|widgets?|comments?|footer|toolbar){_PLACE}*|paginat(?:ion|or)|pager|hidden|disclaimer)$"
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(?:!|\?)[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)", re.S)
_TO_END = re.compile(r"""[^>"']*>""")
_VALUE_OR_END = re.compile(r"""=\s*(["'])|>""")
_OPEN = re.compile(r"<[a-zA-Z/!][^<>]*\Z")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")


class _Element:
    __slots__ = ("tag", "gone", "inside", "hashed", "shape", "first", "p")

    def __init__(self, tag: str, gone: bool, inside: bool, shape: bytes, first: int = 0):
        self.tag, self.gone, self.inside, self.shape, self.first = tag, gone, inside, shape, first
        self.hashed: list[bytes] = []  # texts and subtrees that it holds
        self.p = 0  # where on the stack the paragraph stands that a block would end


class _Quotes:
    """Where a quote closes; that there is none further on is found out once."""

    def __init__(self, page: str):
        self.page, self.none = page, {}

    def close(self, quote: str, at: int) -> int:
        if quote in self.none:
            return -1
        found = self.page.find(quote, at)
        if found < 0:
            self.none[quote] = True
        return found

    def tag_end(self, at: int) -> int:
        """Place after the > that ends the tag whose attributes start at `at`; 0 if the page ends first."""
        m = _TO_END.match(self.page, at)
        while not m:
            m = _VALUE_OR_END.search(self.page, at)
            if not m:
                return 0
            if m[1]:
                shut = self.close(m[1], m.end())
                at, m = (shut if shut >= 0 else m.end()) + (shut >= 0), None
        return m.end()


def _is_gone(tag: str, attributes: str, inside: bool) -> tuple[bool, bytes]:
    """(does the element go, what of it enters the hash)."""
    if not attributes or attributes.isspace():
        return tag in GONE or tag == "header" and not inside, b""
    found = {m[0].lower(): html.unescape(m[1] or m[2] or m[3]) for m in _ATTRIBUTE.findall(attributes)}
    shape = f"{found.get('class', '')}#{found.get('role', '')}".encode()
    if tag in GONE or tag == "header" and not inside:
        return True, shape
    if tag in ("html", "body", "article", "main") and not any(NAMES.match(t) and t.startswith("comment") for t in re.split(r"[^a-z]+", found.get("class", "").lower())):
        return False, shape
    if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", "")):
        return True, shape
    if found.get("role", "").lower() in ROLES:
        return True, shape
    for name in f"{found.get('class', '')} {found.get('id', '')}".lower().split():
        words = [w for w in re.split(r"[^a-z]+", name) if w]
        if words and (NAMES.match("".join(words)) or not inside and (NAMES.match(words[0]) or "header" in words)):
            return True, shape
    return False, shape


def parse(page: str) -> tuple[list[str], list[tuple[int, int, int]], list[int], bool]:
    """(blocks of text in page order, subtrees (hash, first run of text, the run after its last), block of each run: -1 for one that goes by its element, are the blocks those of a marked article)."""
    blocks: list[list[str]] = [[]]
    in_article: list[bool] = [False]
    subtrees: list[tuple[int, int, int]] = []
    block_of: list[int] = []
    stack = [_Element("", False, False, b"")]
    open_tags: Counter[str] = Counter()
    quotes = _Quotes(page)

    def text(raw: str) -> None:
        top = stack[-1]
        if raw:
            said = html.unescape(raw) if "&" in raw else raw
            if not top.gone:
                blocks[-1].append(said)
            if not said.isspace():
                block_of.append(-1 if top.gone else len(blocks) - 1)
                top.hashed.append(" ".join(said.split()).encode("utf-8", "surrogatepass"))

    def split() -> None:
        if blocks[-1]:
            blocks.append([])
            in_article.append(stack[-1].inside)
        else:
            in_article[-1] = stack[-1].inside

    def start(e: _Element) -> None:
        while len(stack) > DEPTH:
            close()
        e.p = len(stack) if e.tag == "p" else 0 if e.tag in BLOCKS or e.tag == "button" else stack[-1].p
        stack.append(e)
        open_tags[e.tag] += 1

    def close() -> None:
        e = stack.pop()
        open_tags[e.tag] -= 1
        if e.hashed:
            h = xxhash.xxh64(e.tag.encode("utf-8", "surrogatepass") + b"\0" + e.shape + b"\0" + b"\1".join(e.hashed)).digest()
            subtrees.append((int.from_bytes(h, "little", signed=True), e.first, len(block_of)))
            stack[-1].hashed.append(h)
        if e.tag in BLOCKS:
            split()

    def close_to(k: int) -> None:
        while len(stack) > k:
            close()

    at = 0
    while True:
        m = _TAG.search(page, at)
        end = quotes.tag_end(m.end()) if m and m[2] else m.end() if m else 0
        if not end:
            open_tag = _OPEN.search(page, at)  # a tag that the page's end cuts off is no text
            text(page[at : open_tag.start()] if open_tag else page[at : m.start()] if m else page[at:])
            break
        text(page[at : m.start()])
        at = end
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:  # an end tag closes up to its start, if that is open
            if tag == "br":
                text(" ")
            if open_tags[tag]:
                close_to(next(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag))
            continue
        attributes = page[m.end() : end - 1]
        if tag in ENDS_P and stack[-1].p:
            close_to(stack[-1].p)
        if tag in CLOSES:
            ended, stops = CLOSES[tag][0].split(), CLOSES[tag][1]
            if any(open_tags[t] for t in ended):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in stops:
                        break
                    if stack[k].tag in ended:
                        close_to(k)
        top = stack[-1]
        inside = top.inside or tag in ("article", "main")
        gone, shape = _is_gone(tag, attributes, top.inside)
        gone = gone or top.gone
        if tag in BLOCKS and not gone:
            start(_Element(tag, gone, inside, shape, len(block_of)))
            split()
            if tag == "hr":
                close()
            continue
        if tag in VOID:
            if tag == "br":
                text(" ")
            continue
        if attributes.endswith("/") and (top.gone or tag in ("svg", "math")):
            continue
        if gone and tag in BLOCKS and not top.gone:
            split()
        start(_Element(tag, gone, inside, shape, len(block_of)))
        if tag in RAW:
            shut = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            if not shut:
                break
            at = shut.start()
    close_to(1)
    marked = any(in_article[i] and b for i, b in enumerate(blocks))
    told = [" ".join("".join(b).split()) if in_article[i] or not marked else "" for i, b in enumerate(blocks)]
    return told, subtrees, block_of, marked


def main_text(page: str, templates: frozenset[int] = frozenset()) -> str:
    """Blocks joined by line ends, without those all of whose text template subtrees hold and that no marked article holds."""
    told, subtrees, block_of, marked = parse(page)
    depth = [0] * (len(block_of) + 1)  # in how many template subtrees each run lies, as steps
    for h, first, last in subtrees if templates and not marked else ():
        if h in templates:
            depth[first] += 1
            depth[last] -= 1
    rest = {i for i, within in zip(block_of, accumulate(depth)) if not within}
    return "\n".join(b for i, b in enumerate(told) if b and i in rest)


def parts(told: list[str], subtrees: list[tuple[int, int, int]], block_of: list[int]) -> list[int]:
    """Hashes of a page's subtrees, but for those that hold the whole main text: these are the page, not a part of it."""
    said = [r for r, i in enumerate(block_of) if i >= 0 and told[i]]
    return sorted({h for h, first, last in subtrees if said and not (first <= said[0] and said[-1] < last)})


def host(url: str):
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def _pages(batch: pa.RecordBatch, column: int) -> list[str]:
    return [x or "" for x in batch.column(column).to_pylist()]


def site_templates(pages: DataFrame, url: str = "url", page: str = "html", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(host, templates): the subtree hashes that recur on the host's pages."""

    def subtrees(batches):
        for batch in batches:
            parsed = [parse(x) for x in _pages(batch, 1)]
            whole = [xxhash.xxh64_intdigest("\n".join(filter(None, told)).encode("utf-8", "surrogatepass")) - (1 << 63) for told, *_ in parsed]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(whole, pa.int64()), pa.array([parts(*x[:3]) for x in parsed], pa.list_(pa.int64()))], names=["host", "whole", "parts"])

    read = pages.select(host(url).alias("host"), F.col(page).cast("string"))
    different = cut(read.mapInArrow(subtrees, "host string, whole bigint, parts array<bigint>").groupBy("host", "whole").agg(F.first("parts").alias("parts")))  # read twice, parsed once
    size = different.groupBy("host").agg(F.count("*").alias("n_pages")).withColumnRenamed("host", "_host")
    counted = different.select("host", F.explode("parts").alias("part")).groupBy("host", "part").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    often = counted.join(size, F.col("host") == F.col("_host")).where(F.col("n") >= min_share * F.col("n_pages"))
    return often.groupBy("host").agg(F.collect_list("part").alias("templates"))


def extract(pages: DataFrame, keep: list[str], url: str = "url", page: str = "html", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """Per row of pages: `keep` and text."""
    small_batches(pages.sparkSession)
    templates = cut(site_templates(pages, url, page, min_pages, min_share).select(F.col("host").alias("_host"), "templates"))
    held = [f"_k{i}" for i in range(len(keep))]
    read = pages.select(*(F.col(c).alias(k) for c, k in zip(keep, held)), host(url).alias("_at"), F.col(page).cast("string").alias("html"))
    n_hashes = templates.agg(F.coalesce(F.sum(F.size("templates") + 1), F.lit(0))).first()[0]
    if n_hashes <= SENT_HASHES:
        met = read.join(F.broadcast(templates), F.col("_at") == F.col("_host"), "left")  # of checked size; pages stay where they are
    else:
        sliced = templates.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))))
        read = read.withColumn("_own", F.pmod(F.xxhash64("html"), F.lit(SLICES)).cast("int"))
        met = read.join(sliced, (F.col("_at") == F.col("_host")) & (F.col("_own") == F.col("_slice")), "left")
    met = met.select(*held, "html", "templates")

    def texts(batches):
        for batch in batches:
            known = batch.column(len(held) + 1).to_pylist()
            made = [main_text(x, frozenset(t or ())) for x, t in zip(_pages(batch, len(held)), known)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(held)], pa.array([x.encode("utf-8", "replace").decode() for x in made], pa.string())], names=[*held, "text"])

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in met.schema if f.name in held)
    return met.mapInArrow(texts, f"{types}, text string").select(*(F.col(k).alias(c) for c, k in zip(keep, held)), "text")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"), ["page_id", "url"]).withColumn("n_chars", F.length("text").cast("long"))
