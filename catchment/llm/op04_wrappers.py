"""HTML extraction by inferred wrappers.

Method.  A page becomes a stream of block tags and texts with all implied end
tags, a tree.  The tag streams of one host are aligned one after another into
a union-free regular expression, the host's wrapper: streams are aligned by a
longest common subsequence of their tags; what only one side has becomes an
optional group, neighbours (or neighbouring sequences of two or three) that
repeat become a repeated group, and texts become numbered slots.  Every page
then runs along its host's wrapper, and texts are counted by slot: outside an
article, a text that stands in one slot on at least ``TEMPLATE_PAGES``
different pages, and on at least half of those that have the slot, is template
(in other slots too: an optional group can move a part).  Slots are also judged by the parts around them: article, menu,
header, footer, side bar, notice, advert, form, script, comment section.  A
class, id or role names such a part only as a whole (``sidebar``,
``cookie-notice``, not ``no-sidebar``), never on html, body, main or article,
nor, but for comments and related pages, on what holds the page's only article
or main elements.  Extraction keeps the texts of article slots or, on a page
without an article or main element, of all slots that are neither template nor
judged away.  A text that finds no slot is judged by the elements around it.

Order.  Alignment depends on the order of its streams, so that order is fixed
by the streams alone: equal ones of a host count once, are dealt to ``FAN`` x
``FAN`` groups by a hash, aligned in byte order, and the groups' wrappers are
aligned by ``FAN`` in order of their numbers.  Partitions, batches, retries
and repeated pages change nothing.

Scale.  Only distinct streams of tags (no text) are shuffled, and each task
reads its groups as a sorted stream with one wrapper in memory, so a host with
a third of all pages is spread over ``FAN`` x ``FAN`` groups; its last step
reads at most ``FAN`` wrappers.  Counts of texts are grouped sums of three
hashes a row.  Wrappers join back to pages by host; adaptive execution
broadcasts them if their written size is small, or splits a hot host.

Defined results: null and empty html give an empty text; a null url, or one
without host, counts to the host ``''``; unclosed tags end where HTML ends
them, a page without ``</body>`` at its end; elements nested deeper than
``MAX_DEPTH`` count to the one at that depth, but menus, footers and the like
and articles stay parts of their own at any depth; ``br`` is white space; very
long pages are read whole, and streams of any length are aligned alike;
repeated rows each get their row and count once among the pages of a host and
of a slot; an empty table gives an empty result; extra columns are not carried
on.
"""

from __future__ import annotations

import functools
import html
import json
import math
import re
import sys
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buffers import slices, text_buffer
from .op03_url_rules import url_host
from .stage import ship_package, written

#: A text outside the article that is in its slot on so many different pages of a host, and on half of
#: those that have the slot, is template.
TEMPLATE_PAGES = 5
MAX_DEPTH, FAN = 200, 256
#: Frames of Python for streams nested ``MAX_DEPTH`` deep, with groups in groups.
FRAMES = 20_000
GROUP_WIDTHS = (1, 2, 3)

# HTML elements that are blocks, that hold no content, and whose text isn't markup.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search "
    "section summary table caption tbody td tfoot th thead title tr ul "
    "script style noscript template iframe object svg math canvas audio video button select textarea".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
DROPPED_TAGS = frozenset(
    "head title nav menu footer aside form script style noscript template iframe object svg math canvas audio video "
    "button select textarea dialog search".split()
)
DROPPED_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent "
    "gdpr notice notices alert disclaimer sidebar sidebars aside menu menus nav navbar navigation breadcrumb breadcrumbs "
    "footer comment comments disqus reply replies respond related recommended share sharing social newsletter subscribe "
    "popup modal overlay login signup search widget widgets pagination pager toolbar masthead".split()
)
MAIN_NAMES = frozenset("article main".split())
# Parts that have articles of their own.
OTHERS_NAMES = frozenset("comment comments disqus reply replies respond related recommended".split())
# Their names tell of the page or the article, not that they are another part.
UNNAMED_TAGS = MAIN_NAMES | {"html", "body"}
# An open element of the left kinds ends where one of the right kinds begins.
ENDED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"},
    "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"},
    "option": {"option", "optgroup"}, "thead": {"tbody", "tfoot"}, "tbody": {"tbody", "tfoot"}, "head": {"body"},
}
SCOPE = {"ul", "ol", "menu", "dl", "table", "select", "body", "html", "article", "section", "div", "nav"}

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S
)
_NAMES = re.compile(r"""(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)

TEXT = "#"


def label_of(tag: str, attributes: str) -> str:
    """The tag, marked ``!`` if its names say it is no content (``!!``: not even with an article in it),
    ``*`` if they say it is the main part."""
    if attributes and tag not in UNNAMED_TAGS:
        tokens = " ".join(m.group(1).strip("\"'") for m in _NAMES.finditer(attributes)).lower().split()
        names = [set(re.findall("[a-z]+", t)) for t in tokens]
        dropped = [n for n in names if n and n <= DROPPED_NAMES]
        if dropped:
            return tag + ("!!" if any(n & OTHERS_NAMES for n in dropped) else "!")
        if any(n & MAIN_NAMES and not n & DROPPED_NAMES for n in names):
            return tag + "*"
    return tag


def below(label: str, keep: int) -> int:
    """The ``keep`` of texts in an element, by that of what encloses it."""
    tag = label.rstrip("!*")
    if label.endswith("!") or tag in DROPPED_TAGS or (tag == "header" and keep < 2):
        return 0
    return 2 if keep and (tag in MAIN_NAMES or label.endswith("*")) else keep


def unnamed(nodes: list) -> tuple[list, bool]:
    """The nodes, elements that hold an article or main element without their
    ``!``, and whether there is one that counts."""
    out, some = [], False
    for label, kids in nodes:
        if label != TEXT:
            kids, holds = unnamed(kids)
            label = label[:-1] if holds and label.endswith("!") and not label.endswith("!!") else label
            some |= below(label, 1) == 2 or (holds and below(label, 1) > 0)
        out.append((label, kids))
    return out, some


def parse(page: str) -> list:
    """The page's blocks: nested ``(label, kids)``, texts as ``("#", text)``."""
    root: list = []
    stack: list[tuple[str, list, int]] = [("", root, 1)]
    words: list[str] = []
    opened: Counter[str] = Counter()
    hidden = shown = False

    def flush() -> None:
        if words:
            text = " ".join(html.unescape("".join(words)).split())
            if text:
                stack[-1][1].append((TEXT, text))
            words.clear()

    def close(tag: str, scope: set[str]) -> None:
        if not opened[tag]:
            return
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth][0] == tag:
                opened.subtract(name for name, _, _ in stack[depth:])
                del stack[depth:]
                return
            if stack[depth][0] in scope:
                return

    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        if m is None:
            words.append(page[at:])
            break
        words.append(page[at : m.start()])
        at = m.end()
        if m.group(2) is None:
            continue
        tag = m.group(2).lower()
        if tag not in BLOCKS:
            if tag == "br":
                words.append(" ")
            continue
        flush()
        if m.group(1):
            close(tag, set())
            continue
        close("p", SCOPE - {"p"})
        for open_tag in [t for t, ends in ENDED_BY.items() if tag in ends]:
            close(open_tag, SCOPE)
        if tag in VOID:
            continue
        kids: list = []
        label, around = label_of(tag, m.group(3)), stack[-1][2]
        keep = below(label, around)
        shown |= keep == 2
        hidden |= not around and below(label, 1) == 2
        if len(stack) >= MAX_DEPTH and keep == around and tag not in RAW:
            kids = stack[-1][1]  # too deep for an element of its own that changes nothing
        else:
            stack[-1][1].append((label, kids))
        if tag in RAW:
            over = re.compile(f"</{tag}\\b[^>]*>", re.I).search(page, at)
            kids.append((TEXT, "raw"))
            at = over.end() if over else end
        else:
            stack.append((tag, kids, keep))
            opened[tag] += 1
    flush()
    return unnamed(root)[0] if hidden and not shown else root


class Item:
    """A part of a wrapper: a tag with parts, a text slot, or a repeated sequence."""

    __slots__ = ("label", "opt", "rep", "kids", "slot")

    def __init__(self, label, opt=False, rep=False, kids=()):  # noqa: ANN001
        self.label, self.opt, self.rep, self.kids = label, opt, rep, list(kids)
        self.slot = -1

    def dump(self) -> list:
        return [self.label, int(self.opt), int(self.rep), [k.dump() for k in self.kids]]

    @staticmethod
    def load(x: list) -> Item:
        return Item(x[0], bool(x[1]), bool(x[2]), [Item.load(k) for k in x[3]])


def wrapper_of(nodes: list) -> list[Item]:
    """The wrapper of one page: its own stream with repeats folded."""
    return fold([Item(label, kids=() if label == TEXT else wrapper_of(kids)) for label, kids in nodes])


def merged(a: Item, b: Item) -> Item:
    """One part for two that match."""
    kids = fold(align(a.kids, b.kids)) if a.kids or b.kids else []
    return Item(a.label, a.opt or b.opt, a.rep or b.rep, kids)


def fold(items: list[Item]) -> list[Item]:
    """Neighbouring equal sequences of one to three parts become one that repeats."""
    for width in GROUP_WIDTHS:
        out: list[Item] = []
        for item in items:
            out.append(item)
            if len(out) <= width:
                continue
            if width == 1:
                if out[-1].label == out[-2].label != "+":
                    b, a = out.pop(), out.pop()
                    both = merged(a, b)
                    both.rep = True
                    out.append(both)
                continue
            tail = out[-width:]
            group = out[-width - 1] if len(out) > width else None
            if group is not None and group.label == "+" and [k.label for k in group.kids] == [k.label for k in tail]:
                group.kids = [merged(a, b) for a, b in zip(group.kids, tail, strict=True)]
                del out[-width:]
            elif len(out) >= 2 * width and [k.label for k in out[-2 * width : -width]] == [k.label for k in tail]:
                kids = [merged(a, b) for a, b in zip(out[-2 * width : -width], tail, strict=True)]
                del out[-2 * width :]
                out.append(Item("+", rep=True, kids=kids))
        items = out
    return items


def key(item: Item) -> str:
    return item.label if item.label != "+" else "+" + " ".join(k.label for k in item.kids)


def common(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence.  A row of the table is an
    integer whose zero bits are the places of y where the length grows; every
    so many rows one is remembered, and those between are made again on the
    way back, so memory is about len(y) * sqrt(len(x)) bits."""
    if not x or not y:
        return []
    whole = (1 << len(y)) - 1
    at: dict[str, int] = {}
    for j, name in enumerate(y):
        at[name] = at.get(name, 0) | 1 << j

    def rows(start: int, row: int, end: int) -> list[int]:
        out = [row]
        for name in x[start:end]:
            hits = row & at.get(name, 0)
            row = ((row + hits) | (row - hits)) & whole
            out.append(row)
        return out

    step = math.isqrt(len(x)) + 1
    saved = [whole]
    for start in range(0, len(x) - step, step):
        saved.append(rows(start, saved[-1], start + step)[-1])
    pairs, j = [], len(y)
    for block in range(len(saved) - 1, -1, -1):
        start = block * step
        table = rows(start, saved[block], min(start + step, len(x)))
        i = len(table) - 1
        while i and j:
            if table[i] >> (j - 1) & 1:
                j -= 1
            elif not table[i - 1] >> (j - 1) & 1:
                i -= 1
            else:
                i, j = i - 1, j - 1
                pairs.append((start + i, j))
    return pairs[::-1]


def align(a: list[Item], b: list[Item]) -> list[Item]:
    """Both sides in one sequence: matching parts merged, others optional."""
    x, y = [key(i) for i in a], [key(i) for i in b]
    lo = hi = 0
    while lo < min(len(x), len(y)) and x[lo] == y[lo]:
        lo += 1
    while hi < min(len(x), len(y)) - lo and x[-1 - hi] == y[-1 - hi]:
        hi += 1
    pairs = [(i, i) for i in range(lo)]
    pairs += [(lo + i, lo + j) for i, j in common(x[lo : len(x) - hi], y[lo : len(y) - hi])]
    pairs += [(len(x) - k, len(y) - k) for k in range(hi, 0, -1)]
    out, i, j = [], 0, 0
    for p, q in [*pairs, (len(a), len(b))]:
        for only in (*a[i:p], *b[j:q]):
            only.opt = True
            out.append(only)
        if p < len(a) and q < len(b):
            out.append(merged(a[p], b[q]))
        i, j = p + 1, q + 1
    return out


def pattern(items: list[Item]) -> str:
    """The wrapper as a regular expression over tags and text slots."""
    out = []
    for i in items:
        body = TEXT if i.label == TEXT else pattern(i.kids) if i.label == "+" else f"<{i.label}>{pattern(i.kids)}</{i.label}>"
        sign = {(0, 0): "", (0, 1): "+", (1, 0): "?", (1, 1): "*"}[int(i.opt), int(i.rep)]
        out.append(f"({body}){sign}" if sign else body)
    return "".join(out)


def text_hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


class Wrapper:
    """A host's wrapper; its text slots are numbered in page order."""

    def __init__(self, items: list[Item]) -> None:
        self.items = items

    @staticmethod
    def of(page: str) -> Wrapper:
        return Wrapper(wrapper_of(parse(page)))

    def add(self, other: Wrapper) -> None:
        self.items = fold(align(self.items, other.items))

    def dump(self) -> str:
        return json.dumps([i.dump() for i in self.items], separators=(",", ":"))

    @staticmethod
    def load(text: str) -> Wrapper:
        return Wrapper([Item.load(i) for i in json.loads(text)])

    def number(self) -> Wrapper:
        slots = 0

        def walk(items: list[Item]) -> None:
            nonlocal slots
            for i in items:
                if i.label == TEXT:
                    i.slot, slots = slots, slots + 1
                walk(i.kids)

        walk(self.items)
        return self

    def texts(self, nodes: list) -> list[tuple[int, int, str]]:
        """(keep, slot, text) of a page's text blocks, in order.  ``keep`` is 0
        for no content, 1 for content, 2 for that of an article; the slot -1
        if there is none."""
        found: list[tuple[int, int, str]] = []

        def within(item: Item, label: str) -> Item | None:
            if item.label != "+":
                return item if item.label == label else None
            return next((i for kid in item.kids if (i := within(kid, label)) is not None), None)

        def place(items: list[Item], at: int, label: str) -> tuple[int, Item | None]:
            for j in (*range(at, len(items)), *range(at)):
                if (item := within(items[j], label)) is not None:
                    return j, item
            return at, None

        def walk(nodes: list, items: list[Item], keep: int) -> None:
            at = 0
            for label, kids in nodes:
                at, item = place(items, at, label)
                if label == TEXT:
                    found.append((keep, -1 if item is None else item.slot, kids))
                else:
                    walk(kids, item.kids if item is not None else [], below(label, keep))

        walk(nodes, self.items, 1)
        return found


def main_texts(found: list[tuple[int, int, str]], template: frozenset[int]) -> list[str]:
    """The blocks to keep: those of articles, else all that are no template."""
    top = max((k for k, _, _ in found), default=0)
    return [t for k, _, t in found if k and k == top and (k == 2 or text_hash(t) not in template)]


@functools.lru_cache(1024)
def loaded(wrapper: str | None) -> Wrapper:
    sys.setrecursionlimit(max(FRAMES, sys.getrecursionlimit()))
    return Wrapper.load(wrapper or "[]").number()


@functools.lru_cache(1024)
def shared_texts(template: str | None) -> frozenset[int]:
    return frozenset(json.loads(template or "[]"))


def page_batches(batches: Iterator[pa.RecordBatch], html_at: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of bounded bytes of html."""
    sys.setrecursionlimit(max(FRAMES, sys.getrecursionlimit()))
    for batch in batches:
        _, offsets = text_buffer(batch.column(html_at))
        for a, b in slices(offsets):
            yield batch.slice(a, b - a)


def infer_wrappers(pages: DataFrame, host: str = "host", html_col: str = "html") -> DataFrame:
    """(host, wrapper) of all hosts, the stream of every page aligned."""

    def streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in page_batches(batches, 1):
            some = {
                (name, Wrapper.of(page or "").dump())
                for name, page in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)
            }
            names, dumps = zip(*some, strict=True) if some else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(dumps, pa.string())], names=["host", "wrapper"])

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted rows of (host, group, wrapper) to one wrapper a group."""
        sys.setrecursionlimit(max(FRAMES, sys.getrecursionlimit()))
        now, whole = None, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([now[0]], pa.string()), pa.array([now[1]], pa.int64()), pa.array([whole.dump()], pa.string())],
                names=["host", "part", "wrapper"],
            )

        for batch in batches:
            for name, group, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now == (name, group):
                    whole.add(Wrapper.load(text))
                    continue
                if now is not None:
                    yield row()
                now, whole = (name, group), Wrapper.load(text)
        if now is not None:
            yield row()

    def step(parts: DataFrame, groups: int, order: str) -> DataFrame:
        dealt = parts.select("host", F.pmod("part", F.lit(groups)).alias("group"), "wrapper", "part")
        ranked = dealt.repartition("host", "group").sortWithinPartitions("host", "group", order)
        return ranked.select("host", "group", "wrapper").mapInArrow(aligned, "host string, part long, wrapper string")

    parts = pages.select(host, html_col).mapInArrow(streams, "host string, wrapper string").distinct()
    parts = step(parts.withColumn("part", F.xxhash64("wrapper")), FAN * FAN, "wrapper")
    return step(step(parts, FAN, "part"), 1, "part").select("host", "wrapper")


def template_texts(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(host, template) from rows of host, html and the host's wrapper: a list
    of hashes of the texts outside articles that pages share."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in page_batches(batches, 1):
            rows = set()
            for name, page, w in zip(*(c.to_pylist() for c in part.columns), strict=True):
                mark = text_hash(page or "")
                for keep, slot, text in loaded(w).texts(parse(page or "")):
                    if keep == 1 and slot >= 0:
                        rows |= {(name, slot, text_hash(text), mark), (name, slot, None, mark)}
            columns = zip(*rows, strict=True) if rows else [()] * 4
            types = [pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["host", "slot", "text", "mark"]
            )

    placed = pages.select("host", html_col, "wrapper").mapInArrow(places, "host string, slot long, text long, mark long")
    counted = written(placed.distinct().groupBy("host", "slot", "text").count(), "slot-texts")
    of_slot = counted.filter("text is null").select("host", "slot", F.col("count").alias("n_slot"))
    shared = counted.filter(f"text is not null and count >= {TEMPLATE_PAGES}")
    return (
        shared.join(of_slot, ["host", "slot"]).filter("2 * count >= n_slot")
        .groupBy("host").agg(F.to_json(F.sort_array(F.collect_set("text"))).alias("template"))
    )


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text, n_chars of every row."""
    ship_package(pages.sparkSession)
    known = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"),
        url_host(F.col(url_col)).alias("host"),
    )
    wrappers = written(infer_wrappers(known), "wrappers")
    judged = written(
        wrappers.join(template_texts(known.join(wrappers, "host")), "host", "left"), "judged-wrappers"
    )
    kind = pages.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in page_batches(batches, 2):
            texts = [
                "\n".join(main_texts(loaded(w).texts(parse(page or "")), shared_texts(template)))
                for page, w, template in zip(*(c.to_pylist() for c in part.columns[2:]), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=[id_col, url_col, "text", "n_chars"],
            )

    joined = known.join(judged, "host", "left").select("id", "url", "html", "wrapper", "template")
    return joined.mapInArrow(work, f"`{id_col}` {kind}, `{url_col}` string, text string, n_chars long")
