"""Main text of HTML pages by wrapper induction.

Each page is parsed to a tree. Pages of one host that are built alike (a layout) share a wrapper: what is constant over
them is template, what varies fills slots. A node is a candidate for the template if, counted over all differing pages of
the layout, more than half have a node of that name with the same text. Whole trees are then aligned by simple tree
matching with a few trees of the layout; candidates that meet their like in the same place are template and are cut off.
The slots are the content, but for those whose element or name says that they are something else: menus and adverts vary
from page to page, too.
"""

from __future__ import annotations

import html
import marshal
import re
import sys
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.common import lean, slices, splitmix, table, written
from siltstone.llm.shingles import TABLE, _powers
from siltstone.llm.url_filter import host_and_path

#: Trees of a layout that a page is aligned with; whether a node is constant is counted over all pages.
REFERENCES = 5
# Element names of HTML by what they do.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
BLOCK = CLOSES_P | frozenset("body br caption dd dt html legend li option summary tbody td tfoot th thead tr".split())
CLOSES_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}}
SCOPE = frozenset("table ul ol dl select article aside nav section div body html".split())
#: Never content, and never content unless the page's main part is in it.
DROPPED = frozenset("head script style noscript template nav footer aside button select input textarea iframe svg canvas dialog menu object embed audio video title datalist".split())
DROPPED_ROUND = frozenset("form header".split())
#: Elements that a page is built of; which of them there are tells its layout.
STRUCTURE = frozenset("div section article main nav header footer aside table form center".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
# Words of classes and ids that say what a part is: anywhere, and outside an article only, where they may not name a part of the text.
APART = frozenset("ads adsense sidebar nav navbar navigation breadcrumb breadcrumbs footer newsletter comment comments commentlist disqus pagination pager".split())
APART_OUTSIDE = APART | frozenset(
    "ad adv banner promo promotion side aside menu header masthead foot cookie cookies consent gdpr notice notices notification alert popup modal overlay subscribe signup login share sharing social respond replies related recommended widget widgets toolbar skip copyright legal hidden".split()
)
APART_STARTS = ("advert", "sponsor")
#: A name that starts with one of these tells what the part hasn't got, or how it is laid out.
NEGATIONS = frozenset("no not non without has have with is hide".split())
TOKEN = re.compile(r"""<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']+|"[^"]*"|'[^']*'|["'])*+)>?|[^<]+|<""", re.S)
ATTR = re.compile(r"""([^\s=/>"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|([^\s=/>"']+)""")
BLOCKS, HIDDEN, NAMED, NAMED_INSIDE = 1, 2, 4, 8  # flags of an element


class Page:
    """A page's elements in page order, the root first, as columns; its text as pieces.

    ``end`` is the first element behind an element's last, ``first`` and ``last`` are where its pieces begin and end. The
    edges of a block are pieces of one space.
    """

    __slots__ = ("names", "attrs", "flags", "parent", "end", "first", "last", "pieces")

    def __init__(self) -> None:
        self.names, self.attrs, self.flags, self.parent, self.end, self.first, self.last = ["#root"], [""], [0], [-1], [0], [0], [0]
        self.pieces: list[str] = []


def attributes(attrs: str) -> dict[str, str]:
    return {m[1].lower() if m[1] else m[5].lower(): m[2] or m[3] or m[4] or "" for m in ATTR.finditer(attrs)}


@lru_cache(20_000)
def flags_of(attrs: str) -> int:
    """What an element's attributes say of it."""
    got = attributes(attrs)
    out = 0
    if "hidden" in got or got.get("aria-hidden") == "true" or got.get("role", "").lower() in ROLES or "display:none" in got.get("style", "").replace(" ", "").lower():
        out |= HIDDEN
    for name in (got.get("class", "") + " " + got.get("id", "")).lower().split():
        words = re.split("[-_]+", name)
        if words[0] not in NEGATIONS:
            if not APART.isdisjoint(words) or any(w.startswith(APART_STARTS) for w in words):
                out |= NAMED | NAMED_INSIDE
            elif not APART_OUTSIDE.isdisjoint(words):
                out |= NAMED
    return out


def parse(text: str) -> Page:
    """The tree of a page, in time linear in its length; unclosed and misplaced tags are mended the way browsers do in the common cases, a tag that never ends runs to the end of the page. Any string gives a tree."""
    page = Page()
    stack = [0]
    opened: dict[str, list[int]] = {}  # where in the stack the open elements of a name are
    scopes: list[int] = []  # and the containers, which an end tag doesn't reach through

    def close(to: int) -> None:
        while len(stack) > to:
            v = stack.pop()
            if page.flags[v] & BLOCKS:
                page.pieces.append(" ")
            page.end[v], page.last[v] = len(page.names), len(page.pieces)
            if stack:
                opened[page.names[v]].pop()
                if scopes and scopes[-1] == len(stack):
                    scopes.pop()

    def close_nearest(names: Iterable[str]) -> None:
        at = max((opened[n][-1] for n in names if opened.get(n)), default=0)
        if at > (scopes[-1] if scopes else 0):
            close(at)

    at, n = 0, len(text)
    while at < n:
        m = TOKEN.match(text, at)
        at = m.end()
        name = m[2]
        if name is None:
            if m[0][0] != "<" or len(m[0]) == 1:
                page.pieces.append(html.unescape(m[0]))
            continue
        name = name.lower()
        if m[1]:
            if opened.get(name) and (name in SCOPE or opened[name][-1] > (scopes[-1] if scopes else 0)):
                close(opened[name][-1])
            continue
        attrs = m[3]
        if name in CLOSES_P:
            close_nearest(("p",))
        if name in CLOSES_SAME:
            close_nearest(CLOSES_SAME[name])
        v = len(page.names)
        page.names.append(name)
        page.attrs.append(attrs)
        page.flags.append((BLOCKS if name in BLOCK else 0) | (flags_of(attrs) if "=" in attrs or "hidden" in attrs else 0))
        page.parent.append(stack[-1])
        page.first.append(len(page.pieces))
        if name in BLOCK:
            page.pieces.append(" ")
        page.end.append(v + 1)
        page.last.append(len(page.pieces))
        if name in RAW:
            end = _raw_end(name).search(text, at)
            at = end.end() if end else n
        elif name not in VOID and not (attrs.endswith("/") and name in ("svg", "path")):
            opened.setdefault(name, []).append(len(stack))
            if name in SCOPE:
                scopes.append(len(stack))
            stack.append(v)
    close(0)
    return page


@lru_cache(64)
def _raw_end(name: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I)


def apart(page: Page) -> list[bool]:
    """Of each element, whether it says that it isn't content.

    Elements that never are say so by themselves. A form, a header or what a name sets apart doesn't if the page's main
    part (an article, a main element or the title) is in it. Inside an article or main element a header is part of it,
    and only names that can't be those of its parts are heeded.
    """
    n = len(page.names)
    inside, holds, title = [False] * n, [False] * n, [False] * n
    for v in range(1, n):
        up = page.parent[v]
        inside[v] = inside[up] or page.names[v] in ("article", "main")
    for v in range(n - 1, 0, -1):
        up, name = page.parent[v], page.names[v]
        part = name in ("article", "main") and not page.flags[v] & (NAMED_INSIDE | HIDDEN)
        title[up] |= title[v] or name == "h1"
        holds[up] |= holds[v] or part
    out = [False] * n
    for v in range(1, n):
        name, flag = page.names[v], page.flags[v]
        if name in DROPPED or flag & HIDDEN:
            out[v] = True
        elif name in DROPPED_ROUND:
            out[v] = not holds[v] and not (name == "form" and title[v]) and not (name == "header" and inside[v])
        if name not in ("html", "body", "main") and flag & (NAMED_INSIDE if inside[v] else NAMED):
            out[v] |= inside[page.parent[v]] or not (holds[v] or title[v])
    return out


def keys(page: Page) -> np.ndarray:
    """Of each element, a hash of its name and of the text below it, white space aside; 0 without text. One pass over the text, whatever the depth."""
    raw = [p.encode("utf-8", "surrogatepass") for p in page.pieces]
    data = np.frombuffer(b"".join(raw), np.uint8)
    solid = data > 32
    power, inverse = _powers(max(16, len(data).bit_length()))
    upto = np.concatenate(([0], np.cumsum(solid)))
    place = upto[np.concatenate(([0], np.cumsum([len(x) for x in raw], dtype=np.int64)))]
    label = np.array(labels(page), np.uint64)
    a, b = place[page.first], place[page.last]
    with np.errstate(over="ignore"):
        prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(TABLE[data[solid]] * power[: upto[-1]], dtype=np.uint64)))
        out = splitmix((prefix[b] - prefix[a]) * inverse[a] ^ splitmix(label + np.uint64(1) << np.uint64(20)))
    return np.where(a == b, np.uint64(0), out | np.uint64(1)).view(np.int64)


def layout(page: Page, key: np.ndarray, host: str) -> int:
    """A hash of the host and of what kinds of parts the page is built of: the elements below the first element with several that have text."""
    children: dict[int, list[int]] = {}
    for v in range(1, len(page.names)):
        if key[v]:
            children.setdefault(page.parent[v], []).append(v)
    at = next((v for v, name in enumerate(page.names) if name == "body"), 0)
    while len(below := children.get(at, [])) == 1 and page.names[below[0]] not in ("article", "main"):
        at = below[0]
    kinds = sorted({f"{page.names[v]}.{_kind(page.attrs[v])}" for v in below if page.names[v] in STRUCTURE})
    return int.from_bytes(blake2b("\n".join([host, *kinds]).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


@lru_cache(20_000)
def _kind(attrs: str) -> str:
    return " ".join(sorted(c for c in attributes(attrs).get("class", "").split() if not any(x.isdigit() for x in c)))


#: What a node with an equal key weighs in a matching, against 1 for a pair of nodes that only share a name; more than a page has nodes.
SAME = 1 << 40


class Node:
    """A node of a tree for matching: its name's hash, its key if that may be template's (else 0), its children, how many nodes it has, and its number in its page."""

    __slots__ = ("label", "key", "children", "size", "number")

    def __init__(self, label: int, key: int, number: int):
        self.label, self.key, self.number, self.size = label, key, number, 1
        self.children: list[Node] = []


def skeleton(parent: list[int], labels: list[int], key: list[int], constant: set[int]) -> tuple[list[int], list[int], list[int], list[int]]:
    """Parent, label, key and number of the nodes whose key is in ``constant`` and of those above them, whose key is 0. All other nodes vary, so none of them can be template."""
    wanted = [k in constant for k in key]
    for v in range(len(key) - 1, 0, -1):
        if wanted[v]:
            wanted[parent[v]] = True
    number = [v for v, w in enumerate(wanted) if w]
    place = {v: i for i, v in enumerate(number)}
    return [place.get(parent[v], -1) for v in number], [labels[v] for v in number], [key[v] if key[v] in constant else 0 for v in number], number


def tree(parent: list[int], labels: list[int], key: list[int], number: list[int]) -> Node:
    """The root of a skeleton's tree."""
    nodes = [Node(*x) for x in zip(labels, key, number, strict=True)]
    for v in range(1, len(nodes)):
        nodes[parent[v]].children.append(nodes[v])
    for v in range(len(nodes) - 1, 0, -1):
        nodes[parent[v]].size += nodes[v].size
    return nodes[0]


def matching(a: Node, b: Node, same: int = 1) -> tuple[int, list[tuple[Node, Node]]]:
    """Simple tree matching: the weight of the best set of node pairs of two trees that keeps levels and order, and the pairs. Nodes with the same key match as a whole, as one pair, and weigh ``same`` for each of their nodes; other pairs weigh 1."""
    if a.label != b.label:
        return 0, []
    if a.key and a.key == b.key:
        return a.size * same, [(a, b)]
    x, y, pairs, total = a.children, b.children, [(a, b)], 1
    lo = 0
    while lo < min(len(x), len(y)) and x[lo].key and (x[lo].key, x[lo].label) == (y[lo].key, y[lo].label):
        lo += 1  # the same at both ends is matched in the best way already
    hi = 0
    while hi < min(len(x), len(y)) - lo and x[-1 - hi].key and (x[-1 - hi].key, x[-1 - hi].label) == (y[-1 - hi].key, y[-1 - hi].label):
        hi += 1
    for i in [*range(lo), *range(-hi, 0)]:
        total += x[i].size * same
        pairs.append((x[i], y[i]))
    x, y = x[lo : len(x) - hi], y[lo : len(y) - hi]
    inner = [[matching(c, d, same) for d in y] for c in x]
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(1, len(x) + 1):
        for j in range(1, len(y) + 1):
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + inner[i - 1][j - 1][0])
    i, j = len(x), len(y)
    while i and j:
        w, below = inner[i - 1][j - 1]
        if w and best[i][j] == best[i - 1][j - 1] + w:
            pairs += below
            i, j = i - 1, j - 1
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return total + best[len(x)][len(y)], pairs


class Wrapper:
    """A layout's template: the keys that are constant over its pages, and trees (from ``skeleton``) that tell where."""

    def __init__(self, constant: Iterable[int], skeletons: Iterable[tuple[list[int], list[int], list[int], list[int]]]):
        self.constant = set(constant)
        self.trees = [tree(*x) for x in skeletons]

    def template(self, parent: list[int], labels: list[int], key: list[int]) -> set[int]:
        """The nodes of a page that are template: constant, and matched with the same in a reference."""
        if self.constant.isdisjoint(key):
            return set()
        sys.setrecursionlimit(1 << 20)  # trees are walked as deep as they are
        own = tree(*skeleton(parent, labels, key, self.constant))
        return {x.number for t in self.trees for x, y in matching(own, t, SAME)[1] if x.key and x.key == y.key}


def labels(page: Page) -> list[int]:
    return [zlib.crc32(n.encode("utf-8", "surrogatepass")) for n in page.names]


def content(page: Page, gone: list[bool], template: set[int]) -> str:
    """The text of a page as one line: its blocks in page order, joined by a space, without the elements that are ``gone`` or template. If nothing else were left, nothing is taken for template.

    Where articles or main elements hold at least half of what is left, the rest is dropped: it surrounds them.
    """
    names, end, first, last, pieces = page.names, page.end, page.first, page.last, page.pieces
    for cut in (template, set()) if template else (set(),):
        spans, parts, v, at = [], [], 0, 0
        inside = 0  # the end of the article at hand
        while v < len(names):
            if gone[v] or v in cut:
                spans.append((at, first[v]))
                at, v = last[v], end[v]
                continue
            if v >= inside and names[v] in ("article", "main"):
                inside = end[v]
                parts.append((first[v], last[v]))
            v += 1
        spans.append((at, len(pieces)))
        whole = _joined(pieces, spans)
        if parts:
            within = _joined(pieces, _within(spans, parts))
            if 2 * len(within) >= len(whole):
                whole = within
        if whole:
            return whole
    return ""


def _within(spans: list[tuple[int, int]], parts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What of some spans lies in some parts; both are in order and don't overlap."""
    out, i = [], 0
    for lo, hi in parts:
        while i < len(spans) and spans[i][1] <= lo:
            i += 1
        j = i
        while j < len(spans) and spans[j][0] < hi:
            out.append((max(spans[j][0], lo), min(spans[j][1], hi)))
            j += 1
        i = max(i, j - 1)
    return out


def _joined(pieces: list[str], spans: list[tuple[int, int]]) -> str:
    return " ".join(" ".join("".join(pieces[a:b]) for a, b in spans if a < b).split())


def main_text(text: str, wrapper: Wrapper | None = None) -> str:
    """The content of a single page."""
    page = parse(text)
    return content(page, apart(page), wrapper.template(page.parent, labels(page), keys(page).tolist()) if wrapper else set())


def wrappers(pages: DataFrame, n: int = REFERENCES, id_col: str = "page_id", url_col: str = "url", text_col: str = "html") -> DataFrame:
    """``layout, wrapper binary`` of every layout with at least three differing pages and something constant.

    Pages with the same text count once. What is constant is counted over all pages, by groupings with map-side
    combination, so a hot host is no large group. The references are up to ``n`` pages, the smallest under as many hash
    functions.
    """
    host, _ = host_and_path(F.col(url_col))

    @lean
    def shape(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            out: list[tuple] = []
            for where, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                page = parse(text or "")
                key = keys(page)
                if key[0]:
                    full = np.flatnonzero(key)  # elements without text hold none with
                    number = np.zeros(len(key), np.int64)
                    number[full] = np.arange(len(full))
                    up = number[np.maximum(np.array(page.parent)[full], 0)]
                    out.append((layout(page, key, where or ""), int(key[0]), key[full].tolist(), np.concatenate((up, np.array(labels(page))[full])).astype(np.uint32).tobytes()))
            columns = [pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns, ["layout", "root", "keys", "shape"])

    shapes = pages.select(host.alias("host"), F.col(text_col).alias("html")).mapInArrow(shape, "layout long, root long, keys array<long>, shape binary")
    shapes = written(shapes.dropDuplicates(["layout", "root"]), "shapes")
    sizes = shapes.groupBy("layout").agg(F.count(F.lit(1)).alias("pages")).filter("pages > 2")
    counts = shapes.select("layout", F.explode(F.array_distinct("keys")).alias("key")).groupBy("layout", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    constant = counts.join(sizes, "layout").filter("2 * n > pages").groupBy("layout").agg(F.collect_list("key").alias("constant"))  # fewer than two pages' nodes
    references = shapes.groupBy("layout").agg(F.array_distinct(F.array(*[F.min_by(F.struct("keys", "shape"), F.xxhash64(F.lit(i), "root")) for i in range(n)])).alias("references"))

    @lean
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for known, refs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                trees = []
                for r in refs:
                    up, label = np.frombuffer(r["shape"], np.uint32).reshape(2, -1).tolist()
                    if not set(known).isdisjoint(r["keys"]):
                        trees.append(skeleton(up, label, r["keys"], set(known)))
                met = {k for t in trees for k in t[2]} - {0}
                out.append(zlib.compress(marshal.dumps((list(met), trees)), 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["layout", "wrapper"])

    return constant.join(references, "layout").select("layout", "constant", "references").mapInArrow(pack, "layout long, wrapper binary")


def extract(pages: DataFrame, n: int = REFERENCES, id_col: str = "page_id", url_col: str = "url", text_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` for every row, from its whole html (null: empty).

    Character references are decoded, white space inside a block is one space, blocks are joined in page order by one
    space. A page without text gives an empty text. Pages whose url is null or has no host are taken for one host's.
    Repeated rows are each returned; an empty table gives no rows; other columns are not read.

    The html itself is never shuffled: a page meets its layout's wrapper as its packed tree. Where no layout has a wrapper
    there is nothing to meet, and the pages are read where they are.
    """
    host, _ = host_and_path(F.col(url_col))
    known = written(wrappers(pages, n, id_col, url_col, text_col), "wrappers").withColumnRenamed("layout", "of")

    @lean
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 3):
            layouts, packed = [], []
            for where, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                page = parse(text or "")
                key = keys(page)
                layouts.append(layout(page, key, where or ""))
                packed.append(zlib.compress(marshal.dumps((page.names, page.parent, page.end, page.first, page.last, page.pieces, apart(page))), 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(layouts, pa.int64()), pa.array(packed, pa.binary())], ["page_id", "url", "layout", "packed"])

    @lean
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        load = lru_cache(64)(lambda raw: Wrapper(*marshal.loads(zlib.decompress(raw))))
        for batch in slices(batches, 2):
            texts = []
            for packed, own in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                page = Page()
                page.names, page.parent, page.end, page.first, page.last, page.pieces, gone = marshal.loads(zlib.decompress(packed))
                texts.append(content(page, gone, load(own).template(page.parent, labels(page), keys(page).tolist()) if own else set()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    @lean
    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            texts = [main_text(x or "") for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    first = T.StructField("page_id", pages.schema[id_col].dataType)
    made = T.StructType([first, *T._parse_datatype_string("url string, text string, n_chars long").fields])
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host.alias("host"), F.col(text_col).alias("html"))
    if not known.limit(1).count():
        return rows.select("page_id", "url", "html").mapInArrow(alone, made)
    rows = rows.mapInArrow(pack, T.StructType([first, *T._parse_datatype_string("url string, layout long, packed binary").fields]))
    joined = rows.hint("merge").join(known, F.col("layout") == F.col("of"), "left").select("page_id", "url", "packed", "wrapper")
    return joined.mapInArrow(finish, made)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: the main text of every page."""
    return extract(table(spark, sf_dir, "pages"))
