"""HTML extraction by wrapper induction over the pages of a host.

1. A page is read, in time linear in its length, into block texts and the tree of its block elements, in which alike siblings are one node.
   Pages of one host are counted by this shape, and the host's wrapper is the merge of all its shapes by simple tree matching: the largest
   matching that keeps order and ancestors. As siblings of a shape differ, a node of the wrapper has at most one partner in it, and the best
   matching below a pair is a heaviest increasing subsequence; no page is too long or too deep for it. Of class, id and role a node's key has the words that
   are on a hundredth of the host's pages or more (``RARE``): rarer ones could not carry template, and made-up names would make wrappers as large as the
   host, where now there are at most a hundred times as many words as on a page. Shapes are merged by hash part first, then the parts' wrappers; a merge only adds
   nodes, so every page's shape is in the wrapper. Each node of the wrapper is a slot.
2. Every page is aligned to its host's wrapper by the same matching. Over all pages, a block text counts once for each different
   page of the host that has it in that slot; texts on ``CONSTANT_SHARE`` of the different pages that have the slot are constant and
   so template. They must be on a fifth of the host's pages, 2 at least and ``CONSTANT_PAGES`` at most, and on a hundredth in any case. Texts that move between
   slots count over the whole page in the same way (slot ``PAGE``). Copies of a page count once, so an article that was copied stays content; and
   so does what edits of one article share: half of the pages that have a text must have more text that varies than text that would be constant.
3. Varying slots are content, except those below elements for menus, headers, footers, side bars, notices, adverts, forms and
   comments, by tag, role or class. Role and class say nothing on ``html``, ``body``, ``main`` and ``article``, nor on an element of the
   wrapper that is above half of the host's varying slots or more and above most of their text (``spared``). Of a page with ``article`` elements all that is in
   them counts, constant or not, else what varies in ``main``, else all that varies and is not mostly links.

Wrappers and constants go back to the pages by host: broadcast if the table is within ``BROADCAST_BYTES``, else by a join that
Spark may split for a hot host.

Defined cases: null or empty html gives an empty text; null url is a host of its own; repeated rows each give a row; equal texts of a page
all stay, in its order; very long pages are read whole; a tag that does not end before the text does is text; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from html import unescape

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from veilmark.llm.common import read_table, written

PARTS = 64  # of a host's shapes, each merged by a task of its own
CONSTANT_SHARE = 0.6
CONSTANT_PAGES = 5
RARE = 100  # words and texts on fewer than one in so many pages of a host are no template
PAGE = -2  # as a slot: the whole page
BROADCAST_BYTES = 32 << 20
LONG_SHAPE = 20_000  # characters; longer shapes are not remembered

_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_TAG_END = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_RAW = frozenset("script style noscript template iframe svg textarea select title head canvas audio video".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_DROP_TAGS = frozenset("nav footer aside form dialog menu".split())
_NO_WORDS = frozenset("html body main article".split())  # their class, id and role drop nothing
_DROP_WORDS = frozenset(
    "nav navbar navigation menu footer sidebar aside ad ads advert advertisement advertising banner promo promotion sponsor sponsored cookie cookies consent "
    "gdpr notice alert popup modal overlay newsletter subscribe subscription comment comments disqus share sharing social related breadcrumb breadcrumbs "
    "pagination pager widget toolbar login signup search masthead respond replies reply contentinfo complementary".split()
)
_CLOSES = {  # an open element of these ends where the key starts
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
}
_FENCE = frozenset("table ul ol dl div section article aside nav main form body html header footer blockquote td th".split())
_ENDS = {tag: frozenset({"p", *_CLOSES.get(tag, ()), *(_HEADINGS if tag in _HEADINGS else ())}) for tag in _BLOCKS}


class Node:
    """A node of a shape: siblings of one key are one."""

    __slots__ = ("key", "kids", "at", "of")

    def __init__(self, key: str):
        self.key, self.kids, self.at = key, [], -1
        self.of: dict[str, Node] = {}  # a page's kids by key

    def text(self) -> str:
        out: list[str] = []
        todo: list[Node | str] = [self]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x)
                continue
            out.append(x.key)
            if x.kids:
                out.append("(")
                todo.append(")")
                for i, k in enumerate(reversed(x.kids)):
                    todo += ([" "] if i else []) + [k]
        return "".join(out)


class _Named:
    """An element whose words would drop what is below it, with the next one above."""

    __slots__ = ("node", "up", "verdict")

    def __init__(self, node: Node, up: _Named | None):
        self.node, self.up, self.verdict = node, up, None


class _Open:
    """An open element. ``named`` holds for its headings too, ``named_else`` for other blocks; ``ends`` are the tags since the last fence."""

    __slots__ = ("tag", "node", "drop", "named", "named_else", "header", "article", "main", "heading", "ends")

    def __init__(self, tag, node, drop, named, named_else, header, article, main, heading, ends):
        self.tag, self.node, self.drop, self.named, self.named_else, self.header = tag, node, drop, named, named_else, header
        self.article, self.main, self.heading, self.ends = article, main, heading, ends


class Block:
    """``drop`` is by tag; ``named`` is the nearest element above whose words would drop the block."""

    __slots__ = ("text", "links", "node", "drop", "named", "article", "main")

    def __init__(self, text, links, of: _Open):
        self.text, self.links, self.node, self.article, self.main = text, links, of.node, of.article, of.main
        self.drop = of.drop or of.header and not of.heading
        self.named = of.named if of.heading else of.named_else


class Tags:
    """``(name, closing, attributes, start, end)`` of tags, from ``at`` on; comments and the like have no name.

    Each character is passed over once: a quote that nothing closes is no quote, and once a tag would run to the end of the text because
    of its quotes, quotes count no more.
    """

    def __init__(self, html: str):
        self.html, self.at, self.quotes = html, 0, {'"', "'"}

    def __iter__(self) -> Iterator[tuple[str, bool, str, int, int]]:
        html, n = self.html, len(self.html)
        while (start := html.find("<", self.at)) >= 0:
            if html.startswith(("<!", "<?"), start):
                comment = html.startswith("<!--", start)
                end = html.find("-->" if comment else ">", start + 2)
                self.at = n if end < 0 else end + (3 if comment else 1)
                yield "", False, "", start, self.at
            elif m := _NAME.match(html, start + 1):
                at = m.end()
                while (e := _TAG_END.search(html, at)) and e[0] != ">":
                    close = html.find(e[0], e.end()) if e[0] in self.quotes else -1
                    if close < 0:
                        self.quotes.discard(e[0])
                    at = e.end() if close < 0 else close + 1
                if e:
                    self.at = e.end()
                    yield m[1].lower(), m[0][0] == "/", html[m.end() : e.start()], start, self.at
                elif self.quotes:
                    self.quotes = set()  # and once more from the same place
                else:
                    return  # no tag ends from here on
            else:
                self.at = start + 1


def words_of(attributes: str) -> set[str]:
    """Words of class, id and role."""
    return {x for x in re.split(r"[^a-z]+", " ".join(x[1] or x[2] or x[3] for x in _ATTRIBUTE.findall(attributes)).lower()) if x} if attributes else set()


def page_words(html: str | None) -> set[str]:
    """The words on a page's block elements."""
    return set().union(*(words_of(attributes) for tag, closing, attributes, _, _ in Tags(html or "") if attributes and not closing and tag in _BLOCKS))


def parse(html: str | None, common: frozenset[str] | None = None) -> tuple[Node, list[Block]]:
    """The shape, with the ``common`` words (all if not given), and the non-empty blocks of a page, in order."""
    html, root = html or "", Node("page")
    top = _Open("", root, False, None, None, False, 0, False, False, frozenset())
    stack, blocks, buf, links, in_link, articles = [top], [], [], 0, 0, 0
    open_tags: dict[str, int] = {}
    endless: set[str] = set()

    def say(s: str) -> None:
        nonlocal links
        s = unescape(s)
        buf.append(s)
        if in_link:
            links += len(s)

    def flush() -> None:
        nonlocal links
        if buf and (text := " ".join("".join(buf).split())):
            blocks.append(Block(text, links, stack[-1]))
        buf.clear()
        links = 0

    def end_last(tags) -> None:
        """Ends the last open element that has one of the tags, and what is open in it."""
        done = False
        while not done:
            done = stack[-1].tag in tags
            open_tags[stack.pop().tag] -= 1

    tags, said = Tags(html), 0
    for tag, closing, attributes, start, end in tags:
        if start > said:
            say(html[said:start])
        said = end
        if not tag:
            continue
        if closing:
            if tag == "a":
                in_link = max(0, in_link - 1)
            elif tag in _BLOCKS:
                flush()
                if open_tags.get(tag):
                    end_last((tag,))
            continue
        if tag in _RAW and not attributes.endswith("/"):
            if tag not in endless:
                close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, end)
                if not close:
                    endless.add(tag)
                if close or tag != "head":
                    said = tags.at = close.end() if close else len(html)
            continue
        if tag == "br":
            buf.append(" ")
            continue
        if tag == "a":
            in_link = 1
        if tag not in _BLOCKS:
            continue
        flush()
        closes = _ENDS[tag]
        while not closes.isdisjoint(stack[-1].ends):  # a paragraph ends where any block starts; items end where the next starts
            end_last(closes)
        names = words_of(attributes)
        up = stack[-1]
        key = ".".join([tag, *sorted(names if common is None else names & common)])
        node = up.node.of.get(key)
        if node is None:
            node = up.node.of[key] = Node(key)
            up.node.kids.append(node)
        drop = up.drop or tag in _DROP_TAGS
        if tag == "header" and not (up.article or up.main):
            drop = True
        named, named_else = up.named, up.named_else
        if tag not in _NO_WORDS:
            if not _DROP_WORDS.isdisjoint(names):
                named, named_else = _Named(node, named), _Named(node, named_else)
            elif "header" in names and tag != "header":
                named_else = _Named(node, named_else)
                if not (up.article or up.main):  # the heading of an article may stand in such a header
                    named = _Named(node, named)
        article = up.article
        if tag == "article" and not drop and not article:
            articles += 1
            article = articles
        ends = frozenset() if tag in _FENCE else up.ends
        if tag not in ends and (tag not in _FENCE or tag in ("td", "th")):
            ends = ends | {tag}
        stack.append(_Open(tag, node, drop, named, named_else, up.header or tag == "header", article, up.main or tag == "main" or "main" in names, up.heading or tag in _HEADINGS, ends))
        open_tags[tag] = open_tags.get(tag, 0) + 1
    if said < len(html):
        say(html[said:])
    flush()
    return root, blocks


def number(root: Node) -> None:
    """Numbers the nodes in preorder."""
    todo, at = [root], 0
    while todo:
        node = todo.pop()
        node.at, at = at, at + 1
        todo += reversed(node.kids)


def read_shape(text: str) -> Node:
    root, stack = None, []
    for token in re.findall(r"[^\s()]+|[()]", text):
        if token == "(":
            stack.append(last)
        elif token == ")":
            stack.pop()
        else:
            last = Node(token)
            if stack:
                stack[-1].kids.append(last)
            else:
                root = last
    number(root)
    return root


def _heaviest(pairs: list[tuple[int, int]], weights: list[int]) -> list[int]:
    """Numbers of the pairs of the heaviest subsequence in which both parts increase; ``pairs`` by the first part, then the second downwards."""
    if all(a[0] < b[0] and a[1] < b[1] for a, b in zip(pairs, pairs[1:])):
        return list(range(len(pairs)))
    seconds = {j: r for r, j in enumerate(sorted({j for _, j in pairs}), 1)}
    best: list[tuple[int, int]] = [(0, -1)] * (len(seconds) + 1)  # a Fenwick tree of (weight, last pair)
    before = []
    for p, (_, j) in enumerate(pairs):
        r, top = seconds[j] - 1, (0, -1)
        while r > 0:
            top, r = max(top, best[r]), r & (r - 1)
        before.append(top[1])
        r, own = seconds[j], (top[0] + weights[p], p)
        while r < len(best):
            best[r] = max(best[r], own)
            r += r & -r
    r, top = len(seconds), (0, -1)
    while r > 0:
        top, r = max(top, best[r]), r & (r - 1)
    out, p = [], top[1]
    while p >= 0:
        out.append(p)
        p = before[p]
    return out[::-1]


def match_trees(a: Node, b: Node) -> tuple[int, list[tuple[Node, Node]]]:
    """Simple tree matching: its size and its pairs."""
    if a.key != b.key:
        return 0, []
    pairs, below = [(a, b)], []  # all pairs of equal paths, parents first; and for each those of its kids
    for x, y in pairs:
        at: dict[str, list[int]] = {}
        for j, k in enumerate(y.kids):
            at.setdefault(k.key, []).append(j)
        own = [(i, j) for i, k in enumerate(x.kids) for j in reversed(at.get(k.key, ()))]
        below.append((len(pairs), own))
        pairs += [(x.kids[i], y.kids[j]) for i, j in own]
    size, chosen = [1] * len(pairs), [[]] * len(pairs)
    for p in range(len(pairs) - 1, -1, -1):
        first, own = below[p]
        if own:
            chosen[p] = [first + k for k in _heaviest(own, size[first : first + len(own)])]
            size[p] += sum(size[k] for k in chosen[p])
    out, todo = [], [0]
    while todo:
        p = todo.pop()
        out.append(pairs[p])
        todo += chosen[p]
    return size[0], out


def merge(wrapper: Node, shape: Node) -> None:
    """Adds to the wrapper what the shape has besides it, in its place."""
    pairs = match_trees(wrapper, shape)[1]
    partner = {id(b): a for a, b in pairs}
    for a, b in pairs:
        kids, at = [], 0
        for kid in b.kids:
            if mine := partner.get(id(kid)):
                while a.kids[at] is not mine:
                    kids.append(a.kids[at])
                    at += 1
                kids.append(mine)
                at += 1
            else:
                kids.append(kid)
        a.kids = kids + a.kids[at:]


def induce(shapes: list[str]) -> str:
    """The wrapper of shapes, most frequent first."""
    wrapper = read_shape(shapes[0])
    for s in shapes[1:]:
        merge(wrapper, read_shape(s))
    return wrapper.text()


@lru_cache(64)
def _wrapper(text: str) -> Node:
    return read_shape(text)


def _slots(wrapper: str, shape: str) -> dict[int, int]:
    return {b.at: a.at for a, b in match_trees(_wrapper(wrapper), read_shape(shape))[1]}


_known_slots = lru_cache(4096)(_slots)


def slots(wrapper: str, shape: str) -> dict[int, int]:
    """Slot (number in the wrapper) by node (number in the shape)."""
    return (_known_slots if len(wrapper) + len(shape) <= LONG_SHAPE else _slots)(wrapper, shape)


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def aligned(html: str | None, wrapper: str, common: frozenset[str] | None = None) -> tuple[list[tuple[Block, int]], Callable[[Node], int]]:
    """The blocks with the slot that each is in, and the slot of a node; -1 where the wrapper has none."""
    root, blocks = parse(html, common)
    number(root)
    at = slots(wrapper, root.text()) if blocks else {}
    return [(b, at.get(b.node.at, -1)) for b in blocks], lambda node: at.get(node.at, -1)


@lru_cache(1024)
def spared(wrapper: str, varying: str | None) -> frozenset[int]:
    """Slots whose words drop nothing: they are above half of the varying slots or more and above most of their text.

    ``varying`` is JSON of ``[slot, characters]``.
    """
    text = dict(json.loads(varying)) if varying else {}
    order = [_wrapper(wrapper)]
    for node in order:
        order += node.kids
    out: dict[int, tuple[int, int]] = {}
    for node in reversed(order):
        below = [out[k.at] for k in node.kids]
        out[node.at] = int(node.at in text) + sum(n for n, _ in below), text.get(node.at, 0) + sum(size for _, size in below)
    all_n, all_size = out[0]
    return frozenset(slot for slot, (n, size) in out.items() if 2 * n >= all_n and 2 * size > all_size)


def _falls(named: _Named | None, above: Callable[[Node], int], free: frozenset[int]) -> bool:
    """Whether one of the elements is not spared; remembered with each."""
    chain = []
    while named is not None and named.verdict is None:
        chain.append(named)
        named = named.up
    verdict = named is not None and named.verdict
    for x in reversed(chain):
        verdict = x.verdict = verdict or above(x.node) not in free
    return verdict


def main_text(html: str | None, wrapper: str, constants: frozenset[tuple[int, int]], varying: str | None = None, common: frozenset[str] | None = None) -> str:
    blocks, above = aligned(html, wrapper, common)
    free = spared(wrapper, varying)
    left = []
    for b, slot in blocks:
        if b.drop or _falls(b.named, above, free):
            continue
        if not b.article:
            h = _hash(b.text)
            if (slot, h) in constants or (PAGE, h) in constants:
                continue
        left.append(b)
    if any(b.article for b in left):
        left = [b for b in left if b.article]
    elif any(b.main for b in left):
        left = [b for b in left if b.main]
    else:
        left = [b for b in left if b.links * 2 <= len(b.text)]
    return "\n\n".join(b.text for b in left)


@lru_cache(1024)
def _constants(text: str | None) -> frozenset[tuple[int, int]]:
    return frozenset(map(tuple, json.loads(text))) if text else frozenset()


@lru_cache(1024)
def _common(text: str | None) -> frozenset[str]:
    return frozenset((text or "").split())


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"://([^/?#]*)", 1))


def _map(df: DataFrame, rows, schema: str) -> DataFrame:
    """``rows(dict of lists) -> iterable of tuples`` over slices of the partitions."""
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string()}
    types = [kinds[f.split()[1]] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                out = list(rows(batch.slice(at, 1024).to_pydict()))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=names)

    return df.mapInArrow(run, schema)


def common_words(pages: DataFrame) -> DataFrame:
    """``(host, common)`` for ``pages(host, html)``: the words on one in ``RARE`` of a host's pages or more, in one string."""

    def counted(b: dict):
        seen: Counter = Counter()
        for host, html in zip(b["host"], b["html"]):
            seen[host, None] += 1
            seen.update((host, w) for w in page_words(html))
        return ((host, w, n) for (host, w), n in seen.items())

    counts = _map(pages, counted, "host string, word string, n long").groupBy("host", "word").agg(F.sum("n").alias("n"))
    counts = written(counts, "class-words")
    all_pages = counts.where("word is null").select("host", F.col("n").alias("pages"))
    kept = counts.join(all_pages, "host").where((F.col("n") * RARE >= F.col("pages")))
    return kept.groupBy("host").agg(F.array_join(F.sort_array(F.collect_list("word")), " ").alias("common"))


def induce_wrappers(pages: DataFrame) -> DataFrame:
    """``(host, wrapper)`` for ``pages(host, html, common)``; ``common`` may be left out."""
    if "common" not in pages.columns:
        pages = pages.withColumn("common", F.lit(None).cast("string"))
    of = lambda c: None if c is None else _common(c)
    shapes = _map(pages, lambda b: ((h, parse(x, of(c))[0].text()) for h, x, c in zip(b["host"], b["html"], b["common"])), "host string, shape string")
    counts = shapes.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("n"))

    def merged(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n", "shape"], ascending=[False, True])
        return pd.DataFrame({"host": rows["host"].iloc[:1], "shape": [induce(rows["shape"].tolist())], "n": [int(rows["n"].sum())]})

    for by in (["host", F.pmod(F.xxhash64("shape"), F.lit(PARTS))], ["host"]):  # parts first, so that a host with very many shapes is no single task
        counts = counts.groupBy(*by).applyInPandas(merged, "host string, shape string, n long")
    return counts.select("host", F.col("shape").alias("wrapper"))


def _with_model(pages: DataFrame, models: DataFrame, small: bool) -> DataFrame:
    return pages.join(F.broadcast(models) if small else models, "host")


def _of_differing_pages(seen: DataFrame, constants: DataFrame) -> DataFrame:
    """Those of the constants whose pages, half of them or more, have more text that varies than constant text."""
    fixed = constants.select("host", "block").distinct()
    whole = seen.where((F.col("slot") == PAGE) & F.col("block").isNotNull()).select("host", "page", "block", "chars")
    on = whole.join(fixed.withColumn("fixed", F.lit(1)), ["host", "block"], "left")
    pages = on.groupBy("host", "page").agg((2 * F.sum(F.when(F.col("fixed") == 1, F.col("chars")).otherwise(0)) <= F.sum("chars")).alias("differs"))
    votes = whole.join(fixed, ["host", "block"]).join(pages, ["host", "page"]).groupBy("host", "block").agg(F.count(F.lit(1)).alias("n"), F.count_if("differs").alias("differing"))
    return constants.join(votes.where(2 * F.col("differing") >= F.col("n")).select("host", "block"), ["host", "block"]).select(*constants.columns)


def extract(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text)`` for ``pages(page_id, url, html)``."""
    pages = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host_of(F.col("url")).alias("host"))
    words = written(common_words(pages.select("host", "html")), "common-words")
    small = (words.agg(F.sum(F.length("common") + F.length("host"))).first()[0] or 0) <= BROADCAST_BYTES
    models = induce_wrappers(_with_model(pages.select("host", "html"), words, small)).join(words, "host")
    models = written(models, "wrappers")
    small = (models.agg(F.sum(F.length("wrapper") + F.length("common") + F.length("host"))).first()[0] or 0) <= BROADCAST_BYTES

    def block_rows(b: dict):
        """Each text of each slot, and each slot (``block`` null), with the characters of its different texts."""
        for host, html, wrapper, common in zip(b["host"], b["html"], b["wrapper"], b["common"]):
            page, of, long = _hash(html or ""), {}, {}
            for x, slot in aligned(html, wrapper, _common(common))[0]:
                if not x.drop:
                    h = _hash(x.text)
                    long[h] = len(x.text)
                    of.setdefault(slot, set()).add(h)
                    of.setdefault(PAGE, set()).add(h)
            for slot, blocks in of.items():
                yield host, slot, None, page, sum(long[h] for h in blocks)
                for h in blocks:
                    yield host, slot, h, page, long[h]

    seen = _map(_with_model(pages.select("host", "html"), models, small), block_rows, "host string, slot long, block long, page long, chars long")
    seen = written(seen.distinct(), "blocks")
    counts = seen.groupBy("host", "slot", "block").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"))
    counts = written(counts.where("block is null or n >= 2"), "block-counts")
    sizes = counts.where("block is null").select("host", "slot", F.col("n").alias("pages"), F.col("chars").alias("all_chars"))
    most = F.greatest(F.least(F.lit(CONSTANT_PAGES), F.greatest(F.lit(2), F.ceil(F.col("pages") / 5))), F.ceil(F.col("pages") / RARE))
    hosts = sizes.where(F.col("slot") == PAGE).select("host", most.alias("least"))
    constants = counts.where("block is not null").join(sizes, ["host", "slot"]).join(hosts, "host").where((F.col("n") >= CONSTANT_SHARE * F.col("pages")) & (F.col("n") >= F.col("least")))
    constants = written(_of_differing_pages(seen, constants.select("host", "slot", "block", "chars")), "constants")
    # at most 1 / CONSTANT_SHARE texts for each block of a slot's pages, so a host's list is short
    lists = constants.groupBy("host").agg(F.to_json(F.sort_array(F.collect_list(F.array("slot", "block")))).alias("constants"))
    fixed = constants.groupBy("host", "slot").agg(F.sum("chars").alias("fixed"))
    left = sizes.where(F.col("slot") >= 0).join(fixed, ["host", "slot"], "left").select("host", "slot", (F.col("all_chars") - F.coalesce("fixed", F.lit(0))).alias("chars")).where("chars > 0")
    left = left.groupBy("host").agg(F.to_json(F.sort_array(F.collect_list(F.array("slot", "chars")))).alias("varying"))
    models = written(models.join(lists, "host", "left").join(left, "host", "left"), "models")
    longs = sum((F.coalesce(F.length(c), F.lit(0)) for c in ("wrapper", "constants", "varying", "common")), F.length("host"))
    small = (models.agg(F.sum(longs)).first()[0] or 0) <= BROADCAST_BYTES

    def texts(b: dict):
        for page, url, html, wrapper, constants, varying, common in zip(*(b[c] for c in ("page_id", "url", "html", "wrapper", "constants", "varying", "common"))):
            yield page, url, main_text(html, wrapper, _constants(constants), varying, _common(common))

    joined = _with_model(pages, models, small).select(F.col("page_id").cast("long").alias("page_id"), "url", "html", "wrapper", "constants", "varying", "common")
    return _map(joined, texts, "page_id long, url string, text string")


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages").select("page_id", "url", "html")).withColumn("n_chars", F.length("text").cast("long"))
