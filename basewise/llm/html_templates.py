"""Main text of web pages by site template removal.

Every element's subtree is hashed.  Spark counts, for every host, on how many different pages each hash stands;
subtrees that recur on many of them are the site's template and are deleted, as are elements whose
tag, role or class says that they are no article text.  Where a page marks its article, only what is in it is kept; since texts themselves may
recur, a paragraph, heading or list item in it is taken for template only where it stands in the articles of most of the host's pages.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lower_az, stash

LEAST_PAGES = 5  # a template's subtree stands on so many different pages of its host at least
LEAST_SHARE = 0.05  # and on this share of them
MOST, MOST_PAGES = 0.5, 10  # what stands in articles is template on over this share of the host's different pages, and on so many of them at least
HELD = 2_000_000  # template hashes that are broadcast at most; more come by a join
SALTS = 16  # parts of a host in that join

TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+>|[^>]*(?:>|\Z))|<[!?/][^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
#: What HTML says of its elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - {"option", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html", "head", "legend"}
CLOSED_BY = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
#: Elements, roles and words of class names that hold no article text.
NO_TEXT = RAW | frozenset("nav header footer aside form head template svg math canvas button select datalist dialog menu object audio video map search".split())
ROLES = frozenset("navigation banner contentinfo search complementary dialog alertdialog alert menu menubar form".split())
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements sponsor sponsored promo promotion banner menu nav navbar navigation breadcrumb breadcrumbs sidebar topbar toolbar "
    "header footer masthead cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup social share sharing related comment comments disqus "
    "pagination pager widget widgets login skip".split()
)
SPEAKERS = frozenset("comment comments reply replies disqus".split())
#: A class that names one of the first and one of the second, whatever else, holds what readers wrote.
READERS = frozenset("reader readers user users visitor visitors guest guests customer customers viewer viewers community".split())
SAID = frozenset("comment comments reply replies review reviews feedback response responses opinion opinions discussion discussions letters".split())
#: Words that say where or in what form something stands, and nothing of what it is.
NEUTRAL = frozenset(
    "site page main top bottom left right center inner outer upper lower global primary secondary fixed sticky floating js c l u o is block box bar area wrap wrapper container content "
    "section region panel row col column list item items link links button buttons btn icon icons group set title heading text form field input count thread posts articles stories topics "
    "mobile desktop small large big mini first last slot unit space bottombar the my app".split()
)
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote".split())


class Page:
    """A page's elements and texts, in page order.

    elements: [tag, parent, no_text, hash (its last bit tells what hashes() says), subtree has paragraphs or headings]; texts: (element, block, text), block a number that changes
    where a block starts or ends.
    """

    def __init__(self, source: str):
        self.elements: list[list] = [["", -1, False, 0, False]]
        self.texts: list[tuple[int, int, str]] = []
        self.block = 0
        self.open = [0]
        self.at: dict[str, list[int]] = {}  # where open elements of each name stand in open
        self.marks: list[list[str]] = [[]]
        at = 0
        while at < len(source):
            m = TOKEN.search(source, at)
            self._text(source[at : m.start()] if m else source[at:])
            if not m:
                break
            at = m.end()
            name = (m[2] or "").lower()
            if m[1] and name:
                self._end(name)
            elif name and m[0].endswith(">"):
                self._start(name, m[3][:-1])
                if name in RAW:
                    stop = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(source, at)
                    at = stop.start() if stop else len(source)
        while len(self.open) > 1:
            self._pop()

    def _text(self, text: str) -> None:
        if text:
            text = html.unescape(text)
            self.texts.append((self.open[-1], self.block, text))
            self.marks[-1].append(" ".join(text.split()))

    def _start(self, name: str, attributes: str) -> None:
        if name in CLOSES_P:
            self._close(("p",), ("article", "main", "div", "section", "td", "th", "li"))
        if name in CLOSED_BY:
            self._close(tuple(CLOSED_BY[name][0].split()), CLOSED_BY[name][1])
        if name in BLOCK:
            self.block += 1
        if name in VOID:
            self.marks[-1].append(f"<{name}>")
            if name == "br":
                self.texts.append((self.open[-1], self.block, " "))
            return
        self.elements.append([name, self.open[-1], no_text(name, attributes), 0, name in TEXT_TAGS])
        self.at.setdefault(name, []).append(len(self.open))
        self.open.append(len(self.elements) - 1)
        self.marks.append([f"<{name}>"])

    def _close(self, names: tuple[str, ...], fence: tuple[str, ...]) -> None:
        """End the nearest open element of names, unless one of fence is nearer."""
        nearest = max((self.at[n][-1] for n in names if self.at.get(n)), default=0)
        if nearest and nearest > max((self.at[n][-1] for n in fence if self.at.get(n)), default=0):
            while len(self.open) > nearest:
                self._pop()

    def _end(self, name: str) -> None:
        if places := self.at.get(name):
            nearest = places[-1]
            while len(self.open) > nearest:
                self._pop()
        if name in BLOCK:
            self.block += 1

    def _pop(self) -> None:
        own, mark = self.elements[self.open.pop()], self.marks.pop()
        self.at[own[0]].pop()
        own[3] = xxhash.xxh64_intdigest("\0".join(mark).encode("utf-8", "replace")) - (1 << 63)
        self.marks[-1].append(str(own[3]))
        self.elements[own[1]][4] |= own[4]
        if own[0] in BLOCK:
            self.block += 1

    def regions(self) -> list[bool]:
        """For each element, whether it stands in the page's article; all do where none is marked."""
        under = [False] * len(self.elements)  # whether the element or one around it holds no text
        for k, (_, parent, bare, _, _) in enumerate(self.elements):
            under[k] = k > 0 and (bare or under[parent])
        for marked in ("article", "main"):
            inside = [False] * len(self.elements)
            for k, (tag, parent, bare, _, _) in enumerate(self.elements):
                inside[k] = k > 0 and not bare and (inside[parent] or (tag == marked and not under[parent]))
            if any(inside):
                return inside
        return [True] * len(self.elements)

    def hashes(self) -> list[int]:
        """The different hashes of subtrees that may be template; odd for paragraphs, headings and list items of a marked article, else even."""
        return list({code for code in self._codes() if code is not None})

    def _codes(self) -> list[int | None]:
        inside = self.regions()
        marked = not all(inside)
        out: list[int | None] = []
        for k, own in enumerate(self.elements):
            text = marked and inside[k] and (own[4] or own[0] not in BLOCK or own[0] == "li")
            if k == 0 or own[0] in ("html", "body", "article", "main") or (text and own[0] not in TEXT_TAGS and own[0] != "li"):
                out.append(None)
            else:
                out.append(own[3] | 1 if text else own[3] & ~1)
        return out

    def text(self, template: frozenset[int] | set[int]) -> str:
        gone = [False] * len(self.elements)
        inside, codes = self.regions(), self._codes()
        for k, (_, parent, bare, _, _) in enumerate(self.elements):
            gone[k] = k > 0 and (gone[parent] or bare or (codes[k] is not None and codes[k] in template))
        blocks: dict[int, list[str]] = {}
        for k, block, text in self.texts:
            if inside[k] and not gone[k]:
                blocks.setdefault(block, []).append(text)
        return " ".join(filter(None, (" ".join("".join(parts).split()) for parts in blocks.values())))


def no_text(name: str, attributes: str) -> bool:
    """Whether tag, role, class, id or hiding of an element say that it holds no article text.

    A class or id counts when all its parts do: `site-header` and `cookie-notice` say so, `share-price` and `header-image-post` do not.  One that names
    readers and what they write counts, too: `reader-comments`, `user-review`.
    """
    if name in NO_TEXT:
        return True
    if not attributes.strip() or name in ("html", "body", "main"):
        return False
    found = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "").lower() for m in ATTRIBUTE.finditer(attributes)}
    if "hidden" in found or found.get("aria-hidden") == "true" or found.get("role") in ROLES or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", "")):
        return True
    for own in f"{found.get('class', '')} {found.get('id', '')}".split():
        parts = {x for x in re.split(r"[^a-z0-9]+", own) if not x.isdigit()} - {""}
        if parts & READERS and parts & SAID and (name != "article" or parts <= READERS | SAID | NEUTRAL):
            return True
        if parts & (SPEAKERS if name == "article" else WORDS) and parts <= WORDS | SPEAKERS | NEUTRAL:
            return True
    return False


def host(url: str) -> F.Column:
    at = F.instr(url, "://")
    return lower_az(F.regexp_extract(F.when(at > 0, F.substr(F.col(url), at + 3)).otherwise(""), r"^[^/?#]*", 0))


def templates(pages: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Return (host, hashes): the template of every host that has one.

    A hash counts once for each different page text of the host, so copies of a page make no template.  The shares bound a
    host's list to 1 / least_share times the subtrees of an average page.  What stands in articles (odd hashes) has to be on MOST of the pages.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = [Page(x or "") for x in batch.column(1).to_pylist()]
            texts = [xxhash.xxh64_intdigest(p.text(frozenset()).encode("utf-8", "replace")) - (1 << 63) for p in read]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.int64()), pa.array([p.hashes() for p in read], pa.list_(pa.int64()))], ["host", "page", "hashes"])

    rows = pages.select(host(url_col).alias("host"), F.col(html_col).alias("html")).mapInArrow(run, "host string, page long, hashes array<long>")
    rows = stash(rows.groupBy("host", "page").agg(F.first("hashes").alias("hashes")), "html-subtrees")
    sizes = rows.groupBy("host").agg(F.count("*").alias("pages"))
    counts = rows.select("host", F.explode("hashes").alias("hash")).groupBy("host", "hash").agg(F.count("*").alias("n")).filter(F.col("n") >= least_pages)
    inner = F.pmod("hash", F.lit(2)) == 1
    often = F.when(inner, (F.col("n") >= MOST_PAGES) & (F.col("n") > F.col("pages") * MOST)).otherwise(F.col("n") >= F.col("pages") * least_share)
    return counts.join(sizes, "host").filter(often).groupBy("host").agg(F.sort_array(F.collect_list("hash")).alias("hashes"))


def main_text(pages: DataFrame, keep: list[str], url_col: str = "url", html_col: str = "html", held: int = HELD, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """Return keep, text and n_chars (code points) for every row.

    Null and empty html have an empty text.  Pages whose url is null or has no `://` make up one host, the empty one.  Repeated rows give
    repeated rows; an empty table gives none; columns other than keep are ignored.  Blocks are joined by
    one space and white space (of Unicode) within a block becomes one.
    """
    spark = pages.sparkSession
    found = stash(templates(pages, least_pages, least_share, url_col, html_col), "html-templates")
    total = found.agg(F.sum(F.size("hashes"))).first()[0] or 0
    rows = pages.select(*keep, host(url_col).alias("__host"), F.col(html_col).alias("__html"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*keep).schema)
    shared = None
    if total <= held:
        shared = spark.sparkContext.broadcast({r.host: frozenset(r.hashes) for r in found.toLocalIterator()})
    else:
        parts = found.select(F.col("host").alias("__h"), F.col("hashes").alias("__hashes"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__s"))
        rows = rows.withColumn("__salt", F.pmod(F.xxhash64("__html"), F.lit(SALTS)).cast("int"))
        rows = rows.join(parts, (F.col("__host") == F.col("__h")) & (F.col("__salt") == F.col("__s")), "left").drop("__h", "__s", "__salt")
    width = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none: frozenset[int] = frozenset()
        for batch in batches:
            hosts, sources = batch.column(width).to_pylist(), batch.column(width + 1).to_pylist()
            own = [shared.value.get(h, none) for h in hosts] if shared else [frozenset(x or ()) for x in batch.column(width + 2).to_pylist()]
            texts = [Page(x or "").text(t) for x, t in zip(sources, own, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*keep, "text", "n_chars"])

    return rows.mapInArrow(run, f"{fields}, text string, n_chars long")


def op3_query(pages: DataFrame) -> DataFrame:
    return main_text(pages, ["page_id", "url"])
