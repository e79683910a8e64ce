"""Main text of pages by wrapper induction.

Pages of one host are aligned, as DOM trees, with reference pages of the host,
one for each of its common layouts, by simple tree matching.  Nodes whose text
is the same on the aligned pages become the layout's template; the others are
its slots.  A page's main text is what stands in its slots: in the article or
main elements whose slots vary, where the page marks any, else in all of it,
but for elements that never hold an article (menus, footers, forms and the
like).  A class or id that sounds like an advert, a sidebar or comments decides
only where the wrapper leaves it open: an element that holds most of what varies
over the host is content, whatever its name.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: A node is template if its text is the same on this share of so many aligned pages of different text.
SAME_SHARE, SAME_PAGES = 0.9, 4
#: Templates are broadcast up to this size in all, and joined by host beyond it.
BROADCAST_BYTES = 32 << 20
#: Layouts of a host that get a reference page, and to which depth below the root pages of one layout are alike.
LAYOUTS, LAYOUT_DEPTH = 4, 3
#: Of several article elements those are read whose slots vary at least by this share of the one that varies most.
VARY_SHARE = 0.1

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
#: Never part of an article.
DROPPED = frozenset("script style noscript template iframe object svg canvas math audio video map head title nav footer aside form button select input textarea menu dialog search noembed noframes xmp".split())
CLOSES_P = BLOCK - frozenset("body html caption dd dt legend li summary tbody td tfoot th thead tr".split())
#: What a start tag ends, up to the element that holds both.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",)),
    "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tbody", "thead", "tfoot"), ("table",)), "thead": (("tbody", "thead", "tfoot"), ("table",)), "tfoot": (("tbody", "thead", "tfoot"), ("table",)),
}
LANDMARKS = ("article", "main")

_TOKEN = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
#: Names (class or id, split at punctuation and case) of what isn't article: adverts, notices and comments, and the page's furniture.
_ADVERTS = re.compile(r"(?:^|[^a-z])(?:ads?|adverts?|advertisements?|adsense|adslot|banners?|sponsor(?:ed|s)?|promos?|promotions?)(?:$|[^a-z])")
_NOTICES = re.compile(r"(?:^|[^a-z])(?:cookies?|consent|gdpr|notices?|popups?|modals?|overlay|newsletters?|subscribe|subscriptions?|comments?|commentlist|respond|replies|disqus)(?:$|[^a-z])")
_FURNITURE = re.compile(r"(?:^|[^a-z])(?:sidebars?|menus?|nav|navbar|navigation|breadcrumbs?|footers?|masthead|share|sharing|social|related|recommend(?:ed|ations)?|widgets?|toolbar|pagination|pager|login|signup|search|skip)(?:$|[^a-z])")
ADVERT, NOTICE, FURNITURE = 3, 2, 1
#: Blocks that are text rather than a part of the page.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
_HEADER_NAMES = re.compile(r"(?:^|[^a-z])(?:header|topbar|site-?head)(?:$|[^a-z])")
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Element:
    """tag, whether it never is article, what its name says, and its parts: text and elements in page order."""

    __slots__ = ("tag", "out", "named", "header", "parts", "block")

    def __init__(self, tag: str, out: bool = False, named: int = 0, header: bool = False):
        self.tag, self.out, self.named, self.header, self.parts, self.block = tag, out, named, header, [], -1


def _marks(tag: str, attributes: str) -> tuple[bool, int, bool]:
    """(never article, what its name says or 0, header of the page unless inside an article)."""
    out, named, header = tag in DROPPED, 0, tag == "header"
    if attributes and not out:
        for name, a, b, c in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), unescape(a or b or c)
            if name in ("class", "id"):
                if tag not in ("body", "html", "main", "article") or name == "class":
                    value = _CAMEL.sub("-", value).lower()
                    if tag in ("body", "html", "main"):
                        continue
                    named = max(named, ADVERT if _ADVERTS.search(value) else NOTICE if _NOTICES.search(value) else FURNITURE if _FURNITURE.search(value) else 0)
                    header |= bool(_HEADER_NAMES.search(value))
            elif name == "role":
                out |= value.strip().lower() in _ROLES
            elif name == "hidden":
                out |= tag not in ("body", "html")
            elif name == "aria-hidden":
                out |= value.strip().lower() == "true" and tag not in ("body", "html")
            elif name == "style":
                out |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE))
    return out, named, header


def parse(html: str) -> Element:
    """A tolerant tree: missing ends are implied, stray ends passed over, raw texts left out."""
    root = Element("#root")
    stack, open_ = [root], Counter()

    def close(k: int) -> None:
        """End the elements from the k-th on."""
        for x in stack[k:]:
            open_[x.tag] -= 1
        del stack[k:]

    at, size = 0, len(html)
    find = _TOKEN.search
    while at < size:
        m = find(html, at)
        if m is None:
            stack[-1].parts.append(html[at:])
            break
        if m.start() > at:
            stack[-1].parts.append(html[at : m.start()])
        at = m.end()
        end, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if end:
            for k in range(len(stack) - 1, 0, -1) if open_[tag] else ():
                if stack[k].tag == tag:
                    close(k)
                    break
                if tag not in BLOCK and stack[k].tag in BLOCK:
                    break  # an inline end doesn't end the block it stands in
            continue
        if tag in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    close(k)
                    break
                if stack[k].tag in BLOCK:
                    break
        elif tag in ENDS:
            these, upto = ENDS[tag]
            for k in range(len(stack) - 1, 0, -1) if any(open_[x] for x in these) else ():
                if stack[k].tag in these:
                    close(k)
                    break
                if stack[k].tag in upto:
                    break
        if tag in BLOCK and open_["head"]:
            close(next(k for k, x in enumerate(stack) if x.tag == "head"))
        element = Element(tag, *_marks(tag, attributes))
        stack[-1].parts.append(element)
        if tag in RAW:
            over = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.IGNORECASE).search(html, at)
            at = over.end() if over else size
        elif tag not in VOID and not (attributes.endswith("/") and tag in ("svg", "path", "use")):
            stack.append(element)
            open_[tag] += 1
    return root


def _walk(root: Element) -> Iterator[tuple[Element, str | None, bool]]:
    """(element, None, True) at a start, (element, None, False) at an end, (element, text, True) for text."""
    stack = [(root, iter(root.parts))]
    yield root, None, True
    while stack:
        element, parts = stack[-1]
        for part in parts:
            if isinstance(part, str):
                yield element, part, True
            else:
                yield part, None, True
                stack.append((part, iter(part.parts)))
                break
        else:
            stack.pop()
            yield element, None, False


class Tree:
    """The block elements of a page in page order: tag, parent, children, and their own text's checksum and length."""

    __slots__ = ("tags", "kids", "sums", "sizes")

    def __init__(self, tags, kids, sums, sizes):
        self.tags, self.kids, self.sums, self.sizes = tags, kids, sums, sizes

    @classmethod
    def of(cls, root: Element) -> Tree:
        tags, kids, texts, open_ = ["#root"], [[]], [[]], [0]
        skip = 0
        root.block = 0
        for element, text, start in _walk(root):
            if element is root and text is None:
                continue
            if text is not None:
                if not skip:
                    texts[open_[-1]].append(text)
            elif element.tag in ("head", "script", "style", "template", "noscript"):
                skip += 1 if start else -1
            elif element.tag in BLOCK and not skip:
                if start:
                    element.block = len(tags)
                    kids[open_[-1]].append(len(tags))
                    open_.append(len(tags))
                    tags.append(element.tag)
                    kids.append([])
                    texts.append([])
                else:
                    open_.pop()
        said = [" ".join(unescape("".join(t)).split()) if t else "" for t in texts]
        return cls(tags, kids, [zlib.crc32(s.encode("utf-8", "surrogatepass")) for s in said], [len(s) for s in said])

    def path(self, node: int) -> set[int]:
        """The node and those above it (none for -1)."""
        parent = {k: i for i, x in enumerate(self.kids) for k in x}
        out = set()
        while node is not None and node >= 0:
            out.add(node)
            node = parent.get(node)
        return out

    def below(self, node: int) -> list[int]:
        """The node and those below it."""
        out, todo = [], [node]
        while todo:
            out.append(todo.pop())
            todo += self.kids[out[-1]]
        return out

    def layout(self) -> int:
        """The checksum of the tags down to LAYOUT_DEPTH, repeated neighbours taken once."""
        said, level = [], [0]
        for _ in range(LAYOUT_DEPTH):
            kids = [self.kids[i] for i in level]
            said += ["/".join(t for t, before in zip((self.tags[k] for k in x), [None, *(self.tags[k] for k in x)]) if t != before) for x in kids]
            level = [k for x in kids for k in x]
        return zlib.crc32("|".join(said).encode())

    def dump(self) -> str:
        return json.dumps([self.tags, self.kids, self.sums, self.sizes], separators=(",", ":"))

    @classmethod
    def load(cls, data: str) -> Tree:
        return cls(*json.loads(data))


def _rows(last: np.ndarray, weights: np.ndarray, x: np.ndarray, y: np.ndarray) -> Iterator[np.ndarray]:
    """The rows of the table of best sums over beginnings of y, one for each further entry of x, after row ``last``."""
    for p in x:
        row = np.zeros_like(last)
        np.maximum.accumulate(np.maximum(last[1:], last[:-1] + weights[p][y]), out=row[1:])
        yield row
        last = row


def _best_pairs(weights: np.ndarray, x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """Places in x and y, ascending in both, of largest total weight; x and y: rows and columns of ``weights``.

    Only every so-manieth row of the table is kept, and those between are made
    again, so that memory grows with len(y) times the root of len(x).
    """
    step = math.isqrt(len(x)) + 1
    kept = [np.zeros(len(y) + 1, np.int64)]
    for n, row in enumerate(_rows(kept[0], weights, x, y), 1):
        if n % step == 0:
            kept.append(row)
    out, p, q = [], len(x), len(y)
    for k in range(len(kept) - 1, -1, -1):
        if not q:
            break
        table = [kept[k], *_rows(kept[k], weights, x[k * step : p], y)]
        while p > k * step and q:
            now, before = table[p - k * step], table[p - k * step - 1]
            if now[q] == before[q]:
                p -= 1
            elif now[q] == now[q - 1]:
                q -= 1
            else:
                p, q = p - 1, q - 1
                out.append((p, q))
    return out


def match(a: Tree, b: Tree) -> dict[int, int]:
    """Simple tree matching: node of a -> node of b, with the most nodes matched, order and parents kept.

    How many nodes of two subtrees match depends on their shapes alone, so it is
    worked out once for two shapes.  Children of equal shape at the start and
    end of two lists match whole, which is never worse; what lies between goes
    through a table, whose time grows with the product of the lists.
    """
    known: dict[tuple, int] = {}

    def shapes(t: Tree) -> list[int]:
        out = [0] * len(t.tags)
        for i in range(len(out) - 1, -1, -1):  # children stand after their parents
            out[i] = known.setdefault((t.tags[i], *[out[k] for k in t.kids[i]]), len(known))
        return out

    of_a, of_b = shapes(a), shapes(b)
    shape = list(known)  # tag and the children's shapes, which stand before
    size: list[int] = []
    for x in shape:
        size.append(1 + sum(size[k] for k in x[1:]))
    memo: dict[tuple[int, int], int] = {}

    def ends(x, y) -> tuple[int, int]:
        n, lo, hi = min(len(x), len(y)), 0, 0
        while lo < n and x[lo] == y[lo]:
            lo += 1
        while hi < n - lo and x[-1 - hi] == y[-1 - hi]:
            hi += 1
        return lo, hi

    def score(c: int, d: int) -> int:
        if c == d:
            return size[c]
        if shape[c][0] != shape[d][0]:
            return 0
        return memo[c, d] if len(shape[c]) > 1 and len(shape[d]) > 1 else 1

    def weights(x, y) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows, columns = ({c: k for k, c in enumerate(dict.fromkeys(z))} for z in (x, y))
        return np.array([[score(c, d) for d in columns] for c in rows], np.int64), np.array([rows[c] for c in x]), np.array([columns[d] for d in y])

    def inner(x, y) -> tuple[int, tuple, tuple]:
        lo, hi = ends(x, y)
        return sum(size[c] for c in (*x[:lo], *x[len(x) - hi :])), x[lo : len(x) - hi], y[lo : len(y) - hi]

    # pairs of shapes with children, each after those below it that its table asks for
    order = [(of_a[0], of_b[0])] if of_a[0] != of_b[0] and a.kids[0] and b.kids[0] else []
    while order:
        c, d = order[-1]
        if (c, d) in memo:
            order.pop()
            continue
        sure, x, y = inner(shape[c][1:], shape[d][1:])
        below = [(e, f) for e in dict.fromkeys(x) for f in dict.fromkeys(y) if e != f and shape[e][0] == shape[f][0] and len(shape[e]) > 1 and len(shape[f]) > 1 and (e, f) not in memo]
        if below:
            order += below
            continue
        order.pop()
        memo[c, d] = 1 + sure
        if x and y:
            w, ix, iy = weights(x, y)
            last = np.zeros(len(y) + 1, np.int64)
            for row in _rows(last, w, ix, iy):
                last = row
            memo[c, d] += int(last[-1])

    found, todo = {}, [(0, 0)]
    while todo:
        i, j = todo.pop()
        found[i] = j
        x, y = a.kids[i], b.kids[j]
        if not x or not y:
            continue
        lo, hi = ends([of_a[k] for k in x], [of_b[k] for k in y])
        todo += zip(x[:lo], y[:lo])
        todo += zip(x[len(x) - hi :], y[len(y) - hi :])
        x, y = x[lo : len(x) - hi], y[lo : len(y) - hi]
        if x and y:
            todo += [(x[p], y[q]) for p, q in _best_pairs(*weights([of_a[k] for k in x], [of_b[k] for k in y]))]
    return found


class Wrapper:
    """A layout's reference tree, its template nodes, its content nodes (article or main), and the node that holds most of what varies."""

    __slots__ = ("layout", "tree", "constant", "content", "holder")

    def __init__(self, layout: int, tree: Tree, constant: frozenset[int], content: frozenset[int], holder: int):
        self.layout, self.tree, self.constant, self.content, self.holder = layout, tree, constant, content, holder

    def apply(self, page: Tree, aligned: dict[int, int]) -> Reading:
        same = {i for i, j in aligned.items() if j in self.constant and page.sums[i] == self.tree.sums[j] and page.sizes[i] == self.tree.sizes[j]}
        above = self.tree.path(self.holder)
        return Reading(same, {i for i, j in aligned.items() if j in self.content}, {i for i, j in aligned.items() if j in above})


class Reading:
    """Of a page: the nodes that bear the template's text, its content nodes, and those that hold most of what varies."""

    __slots__ = ("template", "content", "holds")

    def __init__(self, template: set[int], content: set[int], holds: set[int]):
        self.template, self.content, self.holds = template, content, holds


def aligned_with(page: Tree, layout: int, references: list[tuple[int, Tree]]) -> tuple[int, dict[int, int]]:
    """Which reference a page goes by, and its alignment: that of its own layout, else that with which most nodes match."""
    own = next((k for k, (x, _) in enumerate(references) if x == layout), None)
    some = range(len(references)) if own is None else [own]
    found = [(k, match(page, references[k][1])) for k in some]
    return max(found, key=lambda f: (len(f[1]), -f[0]))


def judge(tree: Tree, seen: dict[int, tuple[int, int, int]]) -> tuple[list[int], list[int], int]:
    """Template nodes, content nodes and holder of a reference; seen: by node, pages aligned, those of equal text, characters of the others.

    An article of which most is the same on all pages is one that the host
    repeats, not boilerplate: its nodes are no template.
    """
    count = len(tree.tags)
    constant = {j for j, (n, same, _) in seen.items() if n >= SAME_PAGES - 1 and same >= SAME_SHARE * n}
    pages = max((n for n, _, _ in seen.values()), default=0) or 1
    varies, stays = [0.0] * count, [0] * count
    for j, (_, _, other) in seen.items():
        varies[j] = 0.0 if j in constant else other / pages
        stays[j] = tree.sizes[j] if j in constant else 0
    for i in range(count - 1, -1, -1):  # children stand after their parents
        if tree.tags[i] in DROPPED:
            varies[i] = 0.0
        else:
            varies[i] += sum(varies[k] for k in tree.kids[i])
        stays[i] += sum(stays[k] for k in tree.kids[i])
    marks, todo = [], [0]
    while todo:
        i = todo.pop()
        if tree.tags[i] in LANDMARKS:
            marks.append(i)
        elif tree.tags[i] not in DROPPED:
            todo += tree.kids[i]
    for i in marks:
        if varies[i] < stays[i]:
            constant -= set(tree.below(i))
    most = max((varies[i] for i in marks), default=0.0)
    content = [i for i in marks if varies[i] >= VARY_SHARE * most] if 2 * sum(varies[i] for i in marks) >= varies[0] > 0 else []
    holder = 0
    while varies[0] and (down := [k for k in tree.kids[holder] if 2 * varies[k] >= varies[0]]):
        holder = max(down, key=lambda k: varies[k])
    return sorted(constant), sorted(content), holder if varies[0] else -1


def _named_out(root: Element) -> set[int]:
    """The identities of elements that their names put out.

    A name decides on any part of the page.  On an inline element only an
    advert's does, others where its block says nothing else; furniture's on a
    paragraph or heading only where all it says are links.
    """
    found: set[int] = set()
    gone = links = 0
    inline = [0]  # named inline elements open, by open block
    says: list[list] = [[False, False, []]]  # by open block: says anything beside them, and beside links, and they
    for element, text, start in _walk(root):
        if text is not None:
            if not gone and text.strip():
                says[-1][0] |= not inline[-1]
                says[-1][1] |= not links
            continue
        if element.out:
            gone += 1 if start else -1
        if element.tag == "a":
            links += 1 if start else -1
        if element.tag in BLOCK:
            if start:
                inline.append(0)
                says.append([False, False, []])
                continue
            inline.pop()
            other, unlinked, named = says.pop()
            says[-1][1] |= unlinked
            if not other:
                found.update(named)
            if element.named > (FURNITURE if element.tag in TEXTUAL and unlinked else 0):
                found.add(id(element))
        elif element.named == ADVERT:
            found.add(id(element))
        elif element.named:
            inline[-1] += 1 if start else -1
            if start:
                says[-1][2].append(id(element))
    if not says[0][0]:
        found.update(says[0][2])
    return found


def blocks(root: Element, reading: Reading | None = None) -> list[str]:
    """The article's blocks in page order.

    Read are the content elements that the wrapper names; without one, the
    page's own article or main elements, and without those all of it; nowhere
    what bears the template's text.
    """
    template, content, holds = (reading.template, reading.content, reading.holds) if reading else (set(), set(), set())
    named = _named_out(root)
    out = lambda e: e.out or (id(e) in named and e.block not in holds)
    depth, found_content, tags = 0, False, set()
    for element, text, start in _walk(root):
        if text is None and out(element):
            depth += 1 if start else -1
        elif text is None and start and not depth and element.tag in LANDMARKS:
            tags.add(element.tag)
            found_content |= element.block in content
    marked = next((t for t in LANDMARKS if t in tags), None)
    region = (lambda e: e.block in content) if found_content else (lambda e: e.tag == marked)
    found: list[str] = []
    held: list[str] = []
    gone = inside = 0
    own = [0]

    def flush() -> None:
        text = " ".join(unescape("".join(held)).split())
        if text and own[-1] not in template:
            found.append(text)
        held.clear()

    for element, text, start in _walk(root):
        if text is not None:
            if not gone and (inside or not marked):
                held.append(text)
            continue
        dropped = out(element) or (element.header and not inside)
        if element.tag in BLOCK or dropped:
            flush()
        elif element.tag == "br":
            held.append(" ")
        if dropped:
            gone += 1 if start else -1
        if element.block >= 0 and element.tag != "#root":
            if start:
                own.append(element.block)
            else:
                own.pop()
        if marked and region(element):
            inside += 1 if start else -1
    flush()
    return found


def main_text(html: str | None, wrappers: list[Wrapper] | None = None) -> str:
    root = parse(html or "")
    if not wrappers:
        return "\n\n".join(blocks(root))
    page = Tree.of(root)  # also numbers the blocks
    k, aligned = aligned_with(page, page.layout(), [(w.layout, w.tree) for w in wrappers])
    return "\n\n".join(blocks(root, wrappers[k].apply(page, aligned)))


def host(url: Column) -> Column:
    """The host of a URL in lower case; null where there is none."""
    found = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    return F.when(found != "", found)


_REFERENCES = "array<struct<page_id: bigint, layout: bigint, tree: string>>"
_WRAPPERS = "array<struct<layout: bigint, tree: string, constant: array<int>, content: array<int>, holder: int>>"


def induce(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """host, wrappers (one for each of its common layouts), of hosts with enough pages.

    Every page takes part, by the reference of its layout or the one that it
    matches best.  Pages of equal text count once, so that copies of one article
    don't make it template; counts are summed before they are moved, so a hot
    host is no heavier than another.
    """

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Tree.of(parse(t.as_py() or "")) for t in batch.column(2)]
            whole = [zlib.crc32(",".join(map(str, t.sums)).encode()) for t in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([t.dump() for t in found], pa.string()), pa.array(whole, pa.int64()), pa.array([t.layout() for t in found], pa.int64())], names=["host", "page_id", "tree", "whole", "layout"])

    light = pages.select(host(F.col("url")).alias("host"), F.col("page_id").cast("long").alias("page_id"), "html").where(F.col("host").isNotNull())
    light = scratch.save(light.mapInArrow(trees, "host string, page_id long, tree string, whole long, layout long"), "trees")
    distinct = light.groupBy("host", "whole").agg(F.min(F.struct("page_id", "layout", "tree")).alias("p")).select("host", "p.*")
    distinct = scratch.save(distinct, "distinct")
    layouts = scratch.save(distinct.groupBy("host", "layout").agg(F.min(F.struct("page_id", "layout", "tree")).alias("p"), F.count("*").alias("n")), "layouts")
    place = F.row_number().over(Window.partitionBy("host").orderBy(F.col("n").desc(), "p.page_id", "layout"))
    first = layouts.withColumn("place", place).where((F.col("place") == 1) | (F.col("n") >= SAME_PAGES) & (F.col("place") <= LAYOUTS)).groupBy("host").agg(F.sort_array(F.collect_list(F.struct("place", "p"))).alias("r"))
    enough = layouts.groupBy("host").agg(F.sum("n").alias("n")).where(F.col("n") >= SAME_PAGES).select("host")
    references = scratch.save(first.join(enough, "host").select("host", F.col("r.p").cast(_REFERENCES).alias("references")), "references")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[str, list[tuple[int, Tree]]] = {}
            counts: dict[tuple[str, int, int], list[int]] = {}
            for name, page_id, layout, tree, references in zip(*(batch.column(k).to_pylist() for k in range(4)), batch.column(4)):
                if name not in known:
                    known[name] = [(r["layout"], r["page_id"], Tree.load(r["tree"])) for r in references.as_py()]
                if any(page_id == p for _, p, _ in known[name]):
                    continue
                a = Tree.load(tree)
                k, found = aligned_with(a, layout, [(x, t) for x, _, t in known[name]])
                b = known[name][k][2]
                for i, j in found.items():
                    if b.sizes[j] or a.sizes[i]:
                        n = counts.setdefault((name, k, j), [0, 0, 0])
                        same = a.sums[i] == b.sums[j] and a.sizes[i] == b.sizes[j]
                        n[0] += 1
                        n[1] += same
                        n[2] += 0 if same else a.sizes[i]
            rows = [(*key, *n) for key, n in counts.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["host", "layout", "node", "n", "same", "varying"])

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for references, nodes in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                wrappers = []
                for k, r in enumerate(references):
                    constant, content, holder = judge(Tree.load(r["tree"]), {x["node"]: (x["n"], x["same"], x["varying"]) for x in nodes if x["layout"] == k})
                    wrappers.append({"layout": r["layout"], "tree": r["tree"], "constant": constant, "content": content, "holder": holder})
                out.append(wrappers)
            kind = pa.list_(pa.struct([("layout", pa.int64()), ("tree", pa.string()), ("constant", pa.list_(pa.int32())), ("content", pa.list_(pa.int32())), ("holder", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], names=["host", "wrappers"])

    joined = distinct.join(references, "host").select("host", "page_id", "layout", "tree", "references")
    sums = [F.sum(c).alias(c) for c in ("n", "same", "varying")]
    counts = joined.mapInArrow(align, "host string, layout int, node int, n long, same long, varying long").groupBy("host", "layout", "node").agg(*sums)
    nodes = counts.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("layout", "node", "n", "same", "varying"))).alias("nodes"))  # at most the references'
    return scratch.save(references.join(nodes, "host").mapInArrow(judged, f"host string, wrappers {_WRAPPERS}"), "wrappers")


def extract(pages: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row.

    Null or empty html gives an empty text; pages without host, and of hosts
    with too few pages to compare, are read without template; pages of any
    length and depth are read whole; repeated rows give equal texts, and of
    layouts that tie the one with the smallest page_id comes first; an empty
    table gives an empty result; other columns are not read.
    """
    scratch = scratch or Scratch(pages.sparkSession, "html")
    wrappers = induce(pages, scratch)
    size = wrappers.agg(F.sum(F.aggregate("wrappers", F.lit(0).cast("long"), lambda n, w: n + F.length(w["tree"]) + 8 * F.size(w["constant"])))).first()[0] or 0
    # the whole set of wrappers is broadcast only while it is small
    right = F.broadcast(wrappers) if size <= BROADCAST_BYTES else wrappers
    rows = pages.select("page_id", "url", "html", host(F.col("url")).alias("host")).join(right, "host", "left").select("page_id", "url", "html", "host", "wrappers")
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[str, list[Wrapper]] = {}
            texts = []
            for html, name, found in zip(batch.column(2), batch.column(3).to_pylist(), batch.column(4)):
                if found.is_valid and name not in known:
                    known[name] = [Wrapper(w["layout"], Tree.load(w["tree"]), frozenset(w["constant"]), frozenset(w["content"]), w["holder"]) for w in found.as_py()]
                texts.append(main_text(html.as_py(), known.get(name)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
