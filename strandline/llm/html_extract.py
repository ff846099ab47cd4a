"""Main text of web pages by consensus host paths.

Each page's containers are scored by the running text of their paragraphs; the best container's generalised path of tags
and classes is the page's vote. Votes are counted for each host in Spark. Pages are then read again with their host's
winning path; a page where that path finds no text, or that has no host, uses its own best container.

Tags, roles and hidden elements that are never an article are left out for certain. Words of a class or id only hint at
that: "right-sidebar" names a sidebar or a layout with one. A hint is dropped where the element holds the page's article:
most of its running text with its heading, or with little of it elsewhere; see ``_asides``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.shared import lookup, small_batches, stored

#: Hosts whose winning paths are broadcast, at most; more of them meet their pages in a shuffle join.
HOSTS = 200_000

#: Characters of a generalised path at most; longer ones are a hash of the whole with their end.
PATH_BYTES = 300

#: Elements whose content is never text of an article: read to their end tag or else the page's end, or only if they have one.
RAW, CLOSED = "script|style|iframe|textarea|title", "noscript|template|select|svg|math|object"

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

#: Elements that begin a new block of text.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html label legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)

#: Start tags that end an open paragraph, and open elements that some start tags end.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("ul ol dl table article section div main body html aside nav footer header form blockquote".split())

CONTAINERS = frozenset("article body div main section td center".split())
PARAGRAPHS = frozenset("p pre blockquote li dd td h1 h2 h3 h4 h5 h6 div article section main center body".split())

#: Elements, roles and words of classes or ids that mark anything but the article.
ASIDE_TAGS = frozenset("nav footer aside button dialog label legend menu".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert".split())
ASIDE_WORDS = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr menu modal nav navbar "
    "navigation newsletter notice notices pager pagination popup promo promoted promotion related replies reply respond share sharing sidebar signup "
    "social sponsor sponsored subscribe toolbar widget masthead topbar".split()
)

#: Pairs of such words of one class or id: a site's header is none of the article's, whose own header may hold its title.
ASIDE_PAIRS = (frozenset(("site", "header")), frozenset(("site", "branding")), frozenset(("global", "header")))

#: Words whose elements hold links or buttons; prose under such a word is an article's own.
LINK_WORDS = frozenset("share sharing social toolbar widget".split())

#: Words beside a hint, and tags, that speak for an article.
TEXT_WORDS, TEXT_TAGS = frozenset("article body content entry main post story text".split()), frozenset("article main section".split())

#: Hints of an element, from none to the one that is dropped most easily.
NONE, STRONG, WEAK, LINKS = range(4)

#: Shares of a page's running text: an element with the first is its article although it has a weak hint, with the second if
#: nothing else speaks against it; the third is the most that may lie elsewhere. Least prose, and most of it in links.
WEAK_SHARE, STRONG_SHARE, ELSEWHERE, PROSE, LINKED = 0.25, 0.5, 0.25, 200, 0.2

_VALUE = r"""\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>"'][^\s>]*+)"""
_RAW_TAG = r"(?=[\s/>])[^>]*>.*?"
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?P<raw>{RAW}){_RAW_TAG}(?:</(?P=raw)\s*>|\Z)|<(?P<closed>{CLOSED})(?=[\s/>])[^>]*(?<!/)>.*?</(?P=closed)\s*>"
    rf"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*+)(?P<rest>(?:[\s/]++|[^\s/>][^\s/>=]*+(?:{_VALUE})?+)*+)>|<(?P<cut>/?[a-z][^\s/<>]*+)[^<>]*+>|<[!?/][^>]*>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""([^\s/>][^\s/>=]*+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*+)))?+""")
NAMES = frozenset(("class", "id", "role", "hidden", "aria-hidden"))
WORD = re.compile(r"[a-z]+")


class Element:
    __slots__ = ("aside", "chars", "header", "hint", "links", "parent", "path", "score", "tag", "titled", "within")

    def __init__(self, tag: str, parent: Element | None, path: str, aside: bool, hint: int = NONE):
        self.tag, self.parent, self.path, self.aside, self.hint, self.score = tag, parent, path, aside, hint, 0.0
        self.chars = self.links = 0  # of all text in it
        #: In a header; in an article, main or section; in a header that is in one of these.
        self.header = tag == "header" or (parent is not None and parent.header)
        self.within = tag in ("article", "main", "section") or (parent is not None and parent.within)
        self.titled = parent is not None and (parent.titled or (tag == "header" and parent.within))


def _bounded(path: str) -> str:
    """The path, or if it is long a hash of it with its end: different paths stay different."""
    if len(path) <= PATH_BYTES:
        return path
    return "#" + xxhash.xxh3_128_hexdigest(path.encode("utf-8", "surrogatepass")) + path[33 - PATH_BYTES :]


def _opened(tag: str, rest: str, parent: Element) -> Element:
    name, aside, hints, words = tag, parent.aside or tag in ASIDE_TAGS, set(), set()
    if rest and not rest.isspace():
        for key, *values in ATTRIBUTE.findall(rest):
            key = key.lower()
            if key not in NAMES:
                continue
            value = unescape("".join(values)).lower()
            if key == "class" and value:
                name = tag + "." + ".".join(sorted(set(re.sub(r"\d+", "#", value).split())))
            if key in ("class", "id"):
                found = set(WORD.findall(value))
                words |= found
                hints |= (ASIDE_WORDS & found).union(*(pair for pair in ASIDE_PAIRS if pair <= found))
            elif key == "role":
                aside |= value in ASIDE_ROLES
            elif key == "hidden" or (key == "aria-hidden" and value == "true"):
                aside |= key == "hidden" or tag not in ("body", "html")
    hint = NONE
    if tag not in ("body", "html") and (hints or tag == "form"):
        hint = LINKS if hints and hints <= LINK_WORDS else WEAK if tag in TEXT_TAGS or TEXT_WORDS & words else STRONG
    return Element(tag, parent, _bounded(f"{parent.path}/{name}"), aside, hint)


def blocks(html: str) -> Iterator[tuple[Element, str, int]]:
    """(innermost block or container, text, characters of it in links) of every block of text, in page order."""
    top = Element("html", None, "", False)
    now, within, links = top, [], 0
    link_depth = 0
    at = 0

    def text() -> tuple[Element, str, int] | None:
        words = " ".join("".join(within).split())
        holder = now
        while holder.parent is not None and holder.tag not in BLOCKS:
            holder = holder.parent
        return (holder, words, links) if words else None

    for m in TOKEN.finditer(html):
        if m.start() > at:
            piece = html[at : m.start()]
            piece = unescape(piece) if "&" in piece else piece
            within.append(piece)
            links += len(piece) if link_depth else 0
        at = m.end()
        tag, ends, rest = m["tag"], m["end"], m["rest"] or ""
        if m["cut"]:  # a quote that isn't closed: a tag whose attributes can't be told
            tag, ends = m["cut"].lstrip("/"), m["cut"][0] == "/"
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br":
            within.append(" ")
            continue
        if tag in BLOCKS:
            if found := text():
                yield found
            within, links = [], 0
        if ends:
            spot = now
            while spot.parent is not None and spot.tag != tag:
                if spot.tag in SCOPES and tag not in SCOPES:
                    break
                spot = spot.parent
            if spot.parent is not None and spot.tag == tag:
                now = spot.parent
            if tag == "a":
                link_depth = 0
            continue
        if tag in VOID or (rest.endswith("/") and tag not in BLOCKS):
            continue
        if tag == "html":
            continue
        if tag in BLOCKS:
            spot = now
            while spot.parent is not None and spot.tag not in SCOPES:
                if spot.tag == "p" or spot.tag in CLOSES.get(tag, ()):
                    now = spot.parent
                spot = spot.parent
        now = _opened(tag, rest, now)
        link_depth |= tag == "a"
    within.append(unescape(html[at:]))
    if found := text():
        yield found


def _chain(element: Element | None) -> Iterator[Element]:
    while element is not None:
        yield element
        element = element.parent


def _asides(found: list[tuple[Element, str, int]]) -> set[int]:
    """The ids of elements whose hints hold; ``found`` are the blocks that aren't left out for certain.

    A hint is dropped if it names links but the element holds prose, if it is weak and the element holds a good share of the
    page's running text, or if the element holds most of that and the page's leading element (a first heading, article or
    main element without a hint of its own) is in it, or is nowhere and little running text lies elsewhere.
    """
    hinted: dict[int, Element] = {}
    leads: list[Element] = []
    total = 0
    for holder, text, links in found:
        total += max(0, len(text) - 2 * links)
        for spot in _chain(holder):
            spot.chars += len(text)
            spot.links += links
            if spot.hint:
                hinted.setdefault(id(spot), spot)
            elif spot.tag in ("h1", "article", "main") and not any(x is spot for x in leads):
                leads.append(spot)
    if not hinted:
        return set()
    depth = {k: sum(1 for _ in _chain(e)) for k, e in hinted.items()}
    holds: set[int] = set()
    for key in sorted(hinted, key=lambda k: depth[k]):
        e = hinted[key]
        running = max(0, e.chars - 2 * e.links)
        if any(id(x) in holds for x in _chain(e.parent)):
            continue
        if e.hint == LINKS and e.chars >= PROSE and e.links < LINKED * e.chars:
            continue
        if e.hint == WEAK and running >= WEAK_SHARE * total:
            continue
        if running > STRONG_SHARE * total:
            inside = e.tag in ("article", "main") or any(any(x is e for x in _chain(lead)) for lead in leads)
            plain = [lead for lead in leads if not any(x.hint for x in _chain(lead)) and not any(x is lead for x in _chain(e))]
            free = sum(max(0, len(text) - 2 * links) for holder, text, links in found if not any(x is e or (x.hint and id(x) in hinted and depth[id(x)] >= depth[key]) for x in _chain(holder)))
            if inside or (not plain and free < ELSEWHERE * running):
                continue
        holds.add(key)
    return holds


def page_blocks(html: str | None) -> list[tuple[Element, str, int]]:
    """The blocks that may be text of an article; a header element's only if it holds a heading within a container."""
    found = [x for x in blocks(html or "") if not x[0].aside]
    if left_out := _asides(found):
        found = [x for x in found if not any(id(e) in left_out for e in _chain(x[0]))]
    return [x for x in found if not x[0].header or (x[0].titled and x[0].tag[0] == "h" and x[0].tag[1:].isdigit())]


def best_path(found: list[tuple[Element, str, int]]) -> str | None:
    """The path of the container with the most running text: a block counts for the container around it, half for the next."""
    scored: list[Element] = []
    for holder, text, links in found:
        gain = (len(text) - 2 * links) * (1.0 if holder.tag in PARAGRAPHS else 0.3)
        share = 1.0
        spot = holder if holder.tag in CONTAINERS else holder.parent
        while spot is not None and share > 0.2:
            if spot.tag in CONTAINERS:
                if not spot.score:
                    scored.append(spot)
                spot.score += gain * share or 1e-9
                share /= 2
            spot = spot.parent
    if found and not scored:
        return ""  # text outside any container: the page itself
    best = max(scored, key=lambda e: e.score * (1.5 if e.tag in ("article", "main") else 1.0), default=None)
    return best.path if best is not None and best.score > 0 else None


def text_under(found: list[tuple[Element, str, int]], path: str | None) -> str:
    """Blocks under every element of that path, joined by line ends."""
    if path is None:
        return ""
    under: dict[int, bool] = {}
    out = []
    for holder, text, _ in found:
        if id(holder) not in under:
            spot = holder
            while spot is not None and spot.path != path:
                spot = spot.parent
            under[id(holder)] = spot is not None
        if under[id(holder)]:
            out.append(text)
    return "\n".join(out)


def _votes(pages: DataFrame) -> DataFrame:
    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = [best_path(page_blocks(x)) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(paths, pa.string())], ["host", "path"])

    return pages.select("host", "html").mapInArrow(vote, "host string, path string")


def winning_paths(pages: DataFrame) -> DataFrame:
    """(host, path, pages): the path with the most votes of each host; ties go to the last path in order."""
    votes = stored(_votes(pages.where("host <> ''")).groupBy("host", "path").count(), "path-votes")
    chosen = F.max(F.when(F.col("path").isNotNull(), F.struct("count", "path")))["path"]
    return votes.groupBy("host").agg(chosen.alias("path"), F.sum("count").alias("pages"))


def extracted(pages: DataFrame) -> DataFrame:
    """All columns of ``pages`` (url, html, ...) with text, the page's main text (empty if there is none).

    A null or empty page gives an empty text. A null url, or one without a host, takes no part in a vote; the page is read
    by its own best container. A column named text is replaced. Repeated rows give repeated rows; an empty table none. A very long page is parsed whole, by one task.
    """
    small_batches(pages.sparkSession)
    pages = pages.drop("text", "_host", "_path")
    names = pages.columns
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    hosted = pages.withColumn("html", F.col("html").cast("string")).withColumn("_host", host)
    winners = stored(winning_paths(hosted.select(F.col("_host").alias("host"), "html")), "host-paths")
    if winners.count() <= HOSTS:  # paths are at most PATH_BYTES long: under 80 MB
        named = F.broadcast(winners.select(F.col("host").alias("_h"), F.col("path").alias("_path")))
        joined = hosted.join(named, F.col("_host") == F.col("_h"), "left").drop("_h")
    else:
        joined = lookup(hosted, winners.withColumnsRenamed({"host": "_host", "path": "_path"}), "_host", "pages", hosted.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for html, path in zip(batch.column("html").to_pylist(), batch.column("_path").to_pylist(), strict=True):
                found = page_blocks(html)
                texts.append(text_under(found, path) or text_under(found, best_path(found)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(texts, pa.string())], [*names, "text"])

    schema = hosted.select(*names).schema.add("text", "string")
    return joined.select(*names, "_path").mapInArrow(read, schema)
