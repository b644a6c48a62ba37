"""HTML extraction with site template removal.

A page is read into a tree of elements, and every subtree gets two hashes: one of its tags, classes and text, and one of its place and shape (the tags and classes
on the way to it and within it, in order, without text). Spark counts per host on how many pages each hash stands, where pages whose text by the rules below is equal count as
one: what stands only on copies of a page is no template's. A subtree on at least SHARE of a host's pages, and on MANY at least, is a template's
and is deleted: by its text wherever it stands; by its shape, as of a menu or an advert that is filled anew for each page, if it is built (has a class or an id, blocks
inside, or a tag such as nav or footer; runs of links alike count as one) and holds at most PART of the text of the pages it stands on, but not inside what holds most of its page's text, where lists and quotations of an article may be alike.

Templates are deleted first. What is left goes through rules, for hosts with too few pages to count: the text of
article elements, else of main, else of the body, without navigation, headers, footers, sidebars, notices, adverts, forms, reader comments and scripts.
The elements html, body, main and article are never deleted as templates.

Defined results: a null or empty html has the text ''; a page that is cut off ends where it is cut; a url without a host belongs to the host ''; a null page_id or
url is kept; repeated rows count as one page and are all kept; pages of any length are read whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import cut, small_batches, table

#: A template's subtree stands on this share of its host's pages, and on so many.
SHARE, MANY = 0.5, 8
#: The most of its pages' text that a template without a text of its own holds.
PART = 0.3
#: Bytes of template lists up to which they are broadcast; beyond, pages are joined with them by host.
BROADCAST = 16_000_000

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
# Fixed values of the HTML standard: elements without content, with raw content, and those that stand as blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
#: An open element of the value's kind ends where one of the key's kind begins.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table td th article section main body html div nav select".split())
DROPPED = frozenset("nav footer aside form script style noscript template iframe svg math canvas object button select textarea dialog menu head title audio video".split())
MARKED = re.compile(r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|sponsor(?:ed)?|promo(?:tion)?s?|banners?|cookies?|consent|gdpr|notices?|alerts?|newsletters?|subscribe|subscription|signup|popup|modal|overlay|sidebar|side|aside|menus?|nav|navbar|navigation|breadcrumbs?|topbar|masthead|header|footer|comments?|replies|disqus|share|sharing|social|related|recommend(?:ed|ations)?|widgets?|toolbar|pagination|pager|login|search|skip)(?:$|[\s_-])", re.I)
ROLES = frozenset("navigation banner complementary contentinfo search form dialog alert menu menubar alertdialog".split())
WHOLE = frozenset(("html", "body", "main", "article", "#page"))
#: Elements that are parts of a page's frame without a class too.
FRAMES = frozenset("nav footer header aside form dialog menu".split())
PAGES = frozenset(("html", "body", "#page"))


class Node:
    __slots__ = ("built", "children", "digest", "drop", "free", "link", "mark", "shape", "size", "tag")

    def __init__(self, tag: str, mark: str = "", drop: bool = False):
        self.tag, self.mark, self.drop, self.children = tag, mark, drop, []
        self.digest, self.shape, self.size, self.link, self.built, self.free = 0, 0, 0, 0, bool(mark) or tag in FRAMES, True


def _open(tag: str, attributes: str) -> Node:
    mark, drop = "", tag in DROPPED
    if attributes.strip(" /"):
        a = {m[1].lower(): entities.unescape(next((v for v in m.groups()[1:] if v is not None), "")) for m in ATTRIBUTE.finditer(attributes)}
        mark = f"{a.get('class', '')} {a.get('id', '')}".strip()
        drop = drop or "hidden" in a or a.get("role", "").lower() in ROLES or a.get("aria-hidden", "").lower() == "true" or (tag not in WHOLE and bool(mark) and MARKED.search(mark) is not None)
    return Node(tag, mark, drop)


def tree(page: str) -> Node:
    top = Node("#page")
    stack, at = [top], 0
    for m in iter(lambda: TOKEN.search(page, at), None):
        if m.start() > at:
            stack[-1].children.append(page[at : m.start()])
        at = m.end() if m.end() > m.start() else m.start() + 1
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if stack[i].tag in ("article", "body", "html", "td", "th") and tag not in ("body", "html", "article", "table", "tr", "tbody", "thead", "tfoot"):
                    break
            continue
        if tag in BLOCKS:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag in SCOPES:
                    break
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in ENDS.get(tag, ()):
                del stack[i:]
                break
            if stack[i].tag in SCOPES and not (tag == "tr" and stack[i].tag in ("td", "th")):
                break
        node = _open(tag, m[3] or "")
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*/?>", re.I).search(page, at)
            node.children.append(page[at : end.start() if end else len(page)])
            at = end.end() if end else len(page)
        elif tag not in VOID and not (m[3] or "").rstrip().endswith("/"):
            stack.append(node)
    if at < len(page):
        stack[-1].children.append(page[at:])
    return top


def _walk(top: Node):
    """Nodes with the children ahead of their parents, without recursion."""
    order, stack = [], [top]
    while stack:
        n = stack.pop()
        order.append(n)
        stack.extend(c for c in n.children if isinstance(c, Node))
    return reversed(order)


def _signed(text: str) -> int:
    d = xxh3_64_intdigest(text.encode(errors="surrogatepass"))
    return d - (1 << 64) if d >= 1 << 63 else d


def hashed(top: Node) -> Node:
    """With both hashes, the size of the text, and whether a shape may go by its count."""
    bare: dict[int, str] = {}
    order = list(_walk(top))
    for n in order:
        inner, forms = [], []
        for c in n.children:
            if isinstance(c, Node):
                inner.append(f"\x1e{c.digest}")
                if not (forms and forms[-1] == bare[id(c)] and c.link == c.size):  # a list of links is one, however long
                    forms.append(bare[id(c)])
                n.size += 0 if c.tag in RAW else c.size
                n.link += c.link
                n.built |= c.built or c.tag in BLOCKS
            else:
                text = " ".join(c.split())
                inner.append(text)
                n.size += len(text)
        n.link = n.size if n.tag == "a" else n.link
        n.digest = _signed("\x1d".join((n.tag, n.mark, "\x1f".join(inner))))
        bare[id(n)] = str(_signed("\x1d".join((n.tag, n.mark, *forms))))
    most = top.size / 2
    way = {id(top): ""}
    for n in reversed(order):
        own = way[id(n)] + f"/{n.tag}.{n.mark}"
        n.shape = _signed(own + "\x1d" + bare[id(n)])
        inside = not n.free or (n.tag not in PAGES and n.size >= most)
        for c in n.children:
            if isinstance(c, Node):
                way[id(c)], c.free = own, not inside
    return top


def subtree_hashes(page: str) -> tuple[int, dict[int, float]]:
    """The hash of the text by rules alone, and the hashes of the elements that hold text, each with the part of the page's text that counts against it."""
    out: dict[int, float] = {}
    top = hashed(tree(page))
    whole = max(1, top.size)
    for n in _walk(top):
        if n.tag not in WHOLE and (n.size or n.tag in RAW):
            out[n.digest] = 0.0
            if n.built and n.tag not in RAW:
                out[n.shape] = out.get(n.shape, 0.0) + n.size / whole
    return _signed(_text(top, frozenset())), out


def _template(n: Node, templates: frozenset[int]) -> bool:
    return n.tag not in WHOLE and (n.digest in templates or (n.free and n.built and n.shape in templates))


def _roots(top: Node, templates: frozenset[int]) -> list[Node]:
    """The outermost articles that are not dropped, else the main elements, else the page."""
    for wanted in ("article", "main"):
        found, stack = [], [top]
        while stack:
            n = stack.pop()
            if n.tag == wanted:
                found.append(n)
                continue
            stack.extend(c for c in reversed(n.children) if isinstance(c, Node) and not c.drop and not _template(c, templates))
        if found:
            return found
    return [top]


def main_text(page: str | None, templates: frozenset[int] = frozenset()) -> str:
    return _text(hashed(tree(page)) if templates else tree(page), templates) if page else ""


def _text(top: Node, templates: frozenset[int]) -> str:
    blocks: list[str] = []
    for root in _roots(top, templates):
        own: list[str] = []
        stack: list = [root]
        while stack:
            x = stack.pop()
            if x is None:
                blocks.append("".join(own))
                own = []
            elif isinstance(x, str):
                own.append(x)
            elif not x.drop and not (x.tag == "header" and root.tag == "#page") and not _template(x, templates):
                inner = [" "] if x.tag == "br" else x.children
                if x.tag in BLOCKS or x is root:
                    stack.append(None)
                    stack.extend(reversed(inner))
                    stack.append(None)
                else:
                    stack.extend(reversed(inner))
        blocks.append("".join(own))
    clean = (" ".join(entities.unescape(b).split()) for b in blocks)
    return "\n\n".join(b for b in clean if b)


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [subtree_hashes(h.as_py() or "") for h in batch.column(1)]
        ends = pa.array([0, *accumulate(len(f) for _, f in found)], pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array([x for _, f in found for x in part(f)], kind)) for part, kind in ((dict.keys, pa.int64()), (dict.values, pa.float64()))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m for m, _ in found], pa.int64()), *lists], names=["host", "main", "hashes", "parts"])


def templates(pages: DataFrame, share: float = SHARE, many: int = MANY, part: float = PART) -> DataFrame:
    """host, hashes: of subtrees that recur on a host. Each stands on a share of its pages, so a host's list is no longer than a few pages."""
    own = small_batches(pages.select(host_of(F.col("url")).alias("host"), "html")).mapInArrow(_hashes, "host string, main long, hashes array<long>, parts array<double>")
    # One scan counts both: a host's pages under a null hash, each subtree under its own. Copies of a page count once.
    pairs = F.concat(F.array(F.struct(F.lit(None).cast("long").alias("hash"), F.lit(0.0).alias("part"))), F.arrays_zip(F.col("hashes").alias("hash"), F.col("parts").alias("part")))
    counts = own.select("host", "main", F.inline(pairs)).groupBy("host", "hash").agg(F.count_distinct("main").alias("n"), F.avg("part").alias("part"))
    counts = cut(counts.filter((F.col("n") >= many) & (F.col("part") <= part)))
    # Only what a host's list will hold is collected.
    sizes = counts.filter("hash is null").select("host", F.col("n").alias("pages"))
    kept = counts.filter("hash is not null").join(sizes, "host").filter(F.col("n") >= F.col("pages") * share)
    return kept.groupBy("host").agg(F.collect_list("hash").alias("hashes"))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h, frozenset(t or ())) for h, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, share: float = SHARE, many: int = MANY) -> DataFrame:
    """page_id, url, text, n_chars for every row."""
    found = cut(templates(pages, share, many).withColumnRenamed("host", "t_host"))
    size = found.agg(F.coalesce(F.sum(8 * F.size("hashes") + F.length("t_host") + 64), F.lit(0))).first()[0]
    if size <= BROADCAST:
        found = F.broadcast(found)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").join(found, host_of(F.col("url")) == F.col("t_host"), "left")
    return small_batches(rows.select("page_id", "url", "html", "hashes")).mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
