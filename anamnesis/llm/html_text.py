"""Main text of web pages, with site templates removed.

Every page is cut into elements once a pass. The first pass hashes each
element's subtree (its tags and texts) and Spark counts, per host, on how many
pages with different main text a subtree stands; those on at least
``LEAST_PAGES`` pages, and at least the binary logarithm of the host's number of
pages, are template, so that a section's banner counts on a host of any size. The
second pass drops them, and what by tag, role or class is no article: menus,
headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments.
If a page has a main element or articles, only these are read, and their prose
blocks stay even if the site repeats them.

A host's list of templates may be long: short ones are sent to every task once,
long ones are joined by subtree, so that a page meets only what stands on it.

What an element is by its class or id is asked of whole names: ``ad-box`` is an
advert, ``share-price`` and ``has-sidebar`` are not, and nothing that holds an
article or a main element is noise by its name.

Defined cases: null or empty html gives empty text; a url without a host counts
as host ''; unclosed and misplaced tags are repaired like a browser's in the
common cases, and stray quotes belong to the tag; pages of any length and depth of
nesting are read whole without recursion; pages of one host with one main text but
different subtrees count by the least list of these; repeated rows each give their
row; an empty table gives none; columns other than page_id, url and html are not
read, whatever their names.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anamnesis.llm.common import settle, small_batches, table

LEAST_PAGES = 5
MOST_BROADCAST, SALTS = 1_000_000, 32
# Element names by their role in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("script style head title nav footer aside form noscript template iframe svg math object canvas button select textarea menu dialog label input option audio video xmp noembed noframes".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote li dt dd td th figcaption".split())
BLOCK = PROSE | frozenset("html body div section article main header footer nav aside form ul ol dl table thead tbody tfoot tr figure hr address details summary fieldset caption center".split())
#: An open p ends where one of these begins.
ENDS_P = BLOCK - frozenset("html body td th tr thead tbody tfoot caption".split())
ITEMS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}

# Parts of class names that say what is no article, and parts that
# only say where or what kind of box something is.
NOISE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent gdpr notice popup modal newsletter subscribe sidebar side aside widget related recommended share sharing social"
    " comment comments commentlist replies reply respond disqus nav navbar navigation menu breadcrumb breadcrumbs footer header masthead toolbar pagination pager login signup".split()
)
BOXES = frozenset(
    "area bar block box btn button buttons container content group inner item items left link links list main outer page panel post posts right row section site slot top bottom unit wrap wrapper form thread primary secondary global".split()
)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_OPEN = re.compile(r"</?([A-Za-z][^\s/>]*+)")
# What may stand between a tag's name and its end; a quote only counts behind an equals sign.
_INSIDE = re.compile(r"""(?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+|(?=>)))?+)*+>""")
_ATTRIBUTE = re.compile(r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"'][^\s>]*+)|(?=>)))?+""")
_HIDES = re.compile(r"(?i)display\s*:\s*none")
_HOST = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")


def names_noise(names: str) -> bool:
    """Whether a class or id says that the element is no article: some name has a part
    that says so, and no part but such and kinds of boxes."""
    for name in names.split():
        parts = [x.lower() for x in _PARTS.findall(name)]
        if not NOISE.isdisjoint(parts) and all(x in NOISE or x in BOXES or x.isdigit() for x in parts):
            return True
    return False


class Element:
    """A node: tag, whether it is hidden by tag or role, or by its class no article, or
    an article beside the main ones, and children (elements or text)."""

    __slots__ = ("beside", "children", "digest", "hidden", "named", "tag")

    def __init__(self, tag: str, attributes: str = "") -> None:
        self.tag, self.children, self.digest = tag, [], 0
        self.hidden, self.named, self.beside = tag in HIDDEN, False, False
        if attributes and not self.hidden:
            found: dict[str, str] = {}
            for m in _ATTRIBUTE.finditer(attributes):
                found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
            named = names_noise(f"{found.get('class', '')} {found.get('id', '')}")
            self.beside = tag == "article" and named
            self.named = named and tag not in ("html", "body", "article", "main")
            self.hidden = found.get("role", "").lower() in _ROLES or found.get("aria-hidden") == "true" or "hidden" in found or bool(_HIDES.search(found.get("style", "")))

    @property
    def noise(self) -> bool:
        return self.hidden or self.named


class _Open:
    """The open elements, with the places of every tag's and of the blocks."""

    def __init__(self, root: Element) -> None:
        self.stack = [root]
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def push(self, e: Element) -> None:
        self.places.setdefault(e.tag, []).append(len(self.stack))
        if e.tag in BLOCK and e.tag != "p":
            self.blocks.append(len(self.stack))
        self.stack.append(e)

    def last(self, tags: tuple[str, ...]) -> int:
        """Place of the innermost of some tags, or 0."""
        return max([self.places[t][-1] for t in tags if self.places.get(t)], default=0)

    def cut(self, place: int) -> None:
        """Close everything from a place on."""
        while len(self.stack) > place:
            e = self.stack.pop()
            self.places[e.tag].pop()
            if self.blocks and self.blocks[-1] == len(self.stack):
                self.blocks.pop()


_HOLDERS = ("table", "article", "main", "body")


def parse(page: str) -> Element:
    """The tree of a page; unclosed elements end where browsers end them.

    Time grows with the page: a tag is read once, and open elements are found by
    their tag. A page whose last tag is cut off takes every tag from there on as
    ending at its next angle bracket.
    """
    root = Element("")
    open_ = _Open(root)
    at, size, strict = 0, len(page), True
    most = page.rfind(">")
    while at < size:
        begin = page.find("<", at)
        if begin < 0:
            begin = size
        if begin > at:
            open_.stack[-1].children.append(page[at:begin])
        if begin == size:
            break
        if page.startswith("<!--", begin):
            short = 4 if page.startswith(">", begin + 4) else 5 if page.startswith("->", begin + 4) else 0
            end = page.find("-->", begin + 4)
            at = begin + short + 1 if short else size if end < 0 else end + 3
            continue
        m = _OPEN.match(page, begin)
        if not m:
            # A declaration, or a bracket that begins nothing.
            end = page.find(">", begin) if begin < most and page[begin + 1 : begin + 2] in ("!", "?", "/") else -1
            if end < 0:
                open_.stack[-1].children.append("<")
                at = begin + 1
            else:
                at = end + 1
            continue
        if begin > most:
            # Cut off within its last tag.
            break
        inside = _INSIDE.match(page, m.end()) if strict else None
        if inside:
            at = inside.end()
        else:
            strict = False
            at = page.find(">", m.end()) + 1
        tag, attributes = m[1].lower(), page[m.end() : at - 1]
        if page[begin + 1] == "/":
            place = open_.last((tag,))
            if place and not (tag in PROSE and open_.last(_HOLDERS) > place):
                open_.cut(place)
            continue
        if tag in ENDS_P or tag in ITEMS:
            ended = ITEMS.get(tag, ()) + (("p",) if tag in ENDS_P else ())
            place = open_.last(ended)
            if place and place >= (open_.blocks[-1] if open_.blocks else 0):
                open_.cut(place)
        element = Element(tag, attributes)
        open_.stack[-1].children.append(element)
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I).search(page, at)
            element.children.append(page[at : end.start() if end else size])
            close = page.find(">", end.end()) if end else -1
            at = size if close < 0 else close + 1
        elif tag not in VOID and not attributes.endswith("/"):
            open_.push(element)
    _unname_holders(root)
    return root


def _unname_holders(root: Element) -> None:
    """What holds an article or a main element that can be seen is no noise by its name."""
    order, parent = [root], {id(root): None}
    for e in order:
        for c in e.children:
            if not isinstance(c, str) and not c.hidden:
                parent[id(c)] = e
                order.append(c)
    for e in order:
        if e.tag == "main" or e.tag == "article" and not e.beside:
            up = parent[id(e)]
            while up is not None and up.named:
                up.named = False
                up = parent[id(up)]


def _digest(root: Element) -> int:
    """Hash of a subtree's tags and texts, white space aside; set on every element."""
    order = [root]
    for e in order:
        order += [c for c in e.children if not isinstance(c, str)]
    for e in reversed(order):
        parts = [e.tag, *[" ".join(c.split()) if isinstance(c, str) else f"<{c.digest}>" for c in e.children]]
        e.digest = xxhash.xxh64_intdigest("\x00".join(parts).encode("utf-8", "surrogatepass")) - (1 << 63)
    return root.digest


def main_elements(root: Element) -> list[Element]:
    """The article; of several, the main element, or without one all outermost
    articles in page order that are no comments or the like by their class. Else
    the main element, the body, or all."""
    found: dict[str, list[Element]] = {"article": [], "main": [], "body": []}
    outer, todo = [], [(root, False)]
    while todo:
        e, within = todo.pop()
        if e.tag in found:
            found[e.tag].append(e)
        if e.tag == "article" and not within:
            outer.append(e)
            within = True
        if not e.noise:
            todo += [(c, within) for c in e.children if not isinstance(c, str)]
    if len(found["article"]) > 1 and found["main"]:
        return found["main"][:1]
    outer.reverse()
    return [e for e in outer if not e.beside] or outer or next((found[t][:1] for t in ("main", "body") if found[t]), [root])


def blocks(root: Element, template: frozenset[int] = frozenset()) -> list[str]:
    """Texts of the main elements' blocks in page order, without noise and template."""
    tops = main_elements(root)
    inside = tops[0].tag in ("article", "main")
    out: list[str] = []
    run: list[str] = []

    def end() -> None:
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            if text:
                out.append(text)
            run.clear()

    for top in tops:
        # Entries are (children to come, whether in prose, whether a block ends there).
        todo = [(iter(top.children), False, False)]
        while todo:
            children, in_prose, ends = todo[-1]
            c = next(children, None)
            if c is None:
                todo.pop()
                if ends:
                    end()
            elif isinstance(c, str):
                run.append(c)
            elif c.noise or c.tag == "header" and not inside:
                continue
            elif c.tag in VOID:
                run.append(" ")
            else:
                prose = in_prose or c.tag in PROSE
                if template and c.digest in template and not (inside and prose):
                    continue
                if c.tag in BLOCK:
                    end()
                todo.append((iter(c.children), prose, c.tag in BLOCK))
        end()
    return out


def subtrees(root: Element) -> list[int]:
    """Digests of the elements that a template may be: blocks of the main elements
    that are no noise by themselves; in an article or main element, no prose."""
    _digest(root)
    todo = main_elements(root)
    inside, found = todo[0].tag in ("article", "main"), set()
    while todo:
        for c in todo.pop().children:
            if not isinstance(c, str) and not c.noise and not (inside and c.tag in PROSE):
                if c.tag in BLOCK:
                    found.add(c.digest)
                todo.append(c)
    return sorted(found)


def host_of(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


def _page_marks(pages: DataFrame) -> DataFrame:
    """(host, main, digests) of every page: narrow rows for counting."""
    schema = pa.schema([("host", pa.string()), ("main", pa.int64()), ("digests", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, mains, digests = [], [], []
            for url, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                root = parse(page or "")
                digests.append(subtrees(root))
                hosts.append(host_of(url))
                mains.append(xxhash.xxh64_intdigest("\n".join(blocks(root))) - (1 << 63))
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(mains, pa.int64()), pa.array(digests, schema.field(2).type)], schema=schema)

    small_batches(pages)
    return pages.select("url", "html").mapInArrow(run, "host string, main long, digests array<long>")


def site_templates(pages: DataFrame, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(host, digest): the subtrees that recur over a host's pages.

    Pages of one host with the same main text count once, so that copies of an
    article are no template. Counts are summed before each shuffle.
    """
    own = _page_marks(pages).groupBy("host", "main").agg(F.min("digests").alias("digests"))
    marked = own.select("host", F.explode(F.concat("digests", F.array(F.lit(None).cast("long")))).alias("digest"))
    counts = marked.groupBy("host", "digest").agg(F.count("*").alias("n"))
    sizes = counts.filter("digest IS NULL").select("host", F.col("n").alias("pages"))
    often = counts.filter((F.col("digest").isNotNull()) & (F.col("n") >= least_pages)).join(sizes, "host")
    return often.filter(F.col("n") >= F.log2("pages")).select("host", "digest")


def _own_templates(own: DataFrame, templates: DataFrame) -> DataFrame:
    """(__host, __key, template) of each page text that holds templates, by a join on
    single subtrees. One subtree may stand on all pages of a host, so pages are
    salted and every template repeated for each salt."""
    schema = pa.schema([("__host", pa.string()), ("__key", pa.string()), ("digests", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = [subtrees(parse(page or "")) for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(1).cast(pa.string()), pa.array(digests, schema.field(2).type)], schema=schema)

    marks = own.select("__host", "__key", "html").mapInArrow(run, "__host string, __key string, digests array<long>")
    single = marks.groupBy("__host", "__key").agg(F.min("digests").alias("digests")).select("__host", "__key", F.explode("digests").alias("digest"))
    salted = single.withColumn("__salt", F.pmod(F.xxhash64("__key"), F.lit(SALTS)).cast("int"))
    each = templates.withColumnRenamed("host", "__host").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(each, ["__host", "digest", "__salt"]).groupBy("__host", "__key").agg(F.collect_list("digest").alias("template"))


def extract(pages: DataFrame, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(page_id, url, text, n_chars) of every page.

    Up to MOST_BROADCAST template digests are sent to every task, so that no page
    moves; beyond, each page is joined with those of its own subtrees.
    """
    templates = settle(site_templates(pages, least_pages))
    own = pages.select("page_id", "url", "html")
    held = None
    if templates.count() <= MOST_BROADCAST:
        lists = templates.groupBy("host").agg(F.array_sort(F.collect_list("digest")).alias("digests")).toArrow()
        held = pages.sparkSession.sparkContext.broadcast({h.as_py(): np.array(x.values) for h, x in zip(lists.column(0), lists.column(1), strict=True)})
        joined = own
    else:
        host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), _HOST.pattern, 1))
        keyed = own.withColumns({"__host": host, "__key": F.md5(F.coalesce("html", F.lit("")).cast("binary"))})
        joined = keyed.join(_own_templates(keyed, templates), ["__host", "__key"], "left").select("page_id", "url", "html", "template")
    key = pages.schema["page_id"].dataType.simpleString()

    def standing(root: Element, sent: np.ndarray) -> frozenset[int]:
        """The page's subtrees that are in its host's sorted list."""
        found = np.array(subtrees(root), np.int64)
        if not len(found):
            return frozenset()
        at = np.minimum(np.searchsorted(sent, found), len(sent) - 1)
        return frozenset(found[sent[at] == found].tolist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = held.value if held else None
        for batch in batches:
            urls, texts = batch.column(1).to_pylist(), []
            joint = [None] * len(urls) if held else batch.column(3).to_pylist()
            for url, page, template in zip(urls, batch.column(2).to_pylist(), joint, strict=True):
                root = parse(page or "")
                sent = lists.get(host_of(url)) if held else None
                if sent is not None:
                    template = standing(root, sent)
                elif template:
                    _digest(root)
                texts.append("\n".join(blocks(root, frozenset(template or ()))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    small_batches(pages)
    return joined.mapInArrow(run, f"page_id {key}, url string, text string, n_chars long")


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
