"""Main text of web pages by equivalence-class template deduction.

Tokens of a page are its block elements, each by its role (the path of tag and class names from the root), and the
words of its text, each by the role of the element that holds it. Boxes near the root without a name also have their place among
their like as a part of the role. A host's pages are told apart by layout first: by the elements that hold their text. A token's
occurrence vector says how often it occurs in each page of a layout; tokens with equal vectors are an equivalence class. Vectors are compared by sums that any order of
partial aggregation gives: pages, occurrences, and hashes of (page, count). A class is valid if it is in enough pages,
and if its elements, once a page each, come in one order. Valid classes are split by the slot of other classes in
which they lie, and so nest into the layout's template. What is in no class is the slots' text. The slot with the most of it
is the main one. Extracted is the article around it if there is one, or else the slots with much text together with
their headings; text that is wholly the words of one class is the template's and left out.

Element names that the HTML standard gives to other things than the text (menus, forms) are left out wherever they
stand. Words of class names decide between slots only where text alone does not tell, such as reader comments.
Pages of hosts with fewer than LEAST_PAGES pages, and pages without the slots of their layout, have no template:
their article or main elements are taken, or else all text outside boilerplate elements.
"""

from __future__ import annotations

import html as _html
import re
from array import array
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import small_batches, steps, task, written

#: A class is valid if its tokens are in at least this part of a layout's pages and in LEAST_PAGES of them, and if this part of these has its elements in one order.
SUPPORT, LEAST_PAGES, ORDERED = 0.5, 3, 0.9
#: A page's vector says which elements hold how many of PARTS parts of its text. Layouts begin at vectors that differ from each
#: other by so much that what they share is less than ALIKE of what they hold together, sought among the LEADERS commonest vectors
#: of a host (and its others go to the most alike); a layout has at least LAYOUT of its host's pages, and LEAST_PAGES.
PARTS, ALIKE, LEADERS, LAYOUT = 4, 0.4, 64, 0.05
#: Boxes without a name have their place in the role down to this depth below the body.
PLACED_DEPTH, PLACED = 2, frozenset("div section table".split())
#: Words are the template's if their class has at least this many.
LEAST_WORDS = 3
#: A slot counts beside the main one if it holds this part of that one's text, and not half of it in links.
LARGE = 0.25
#: Up to this many tokens (some 100 bytes each in a worker) all hosts' templates are broadcast; more are joined by host. A host has twice as many as a page of it on average at most.
BROADCAST_TOKENS = 200_000
#: Tokens that a task adds up before it passes them on.
HELD = 400_000
#: Bits of a token's number and of a page's part in a vector: sums over two billion pages fit a long. Of a host with ten
#: million tokens one of those that matter has another's number with probability 0.00002, and then is in no class.
TOKEN_BITS, VECTOR_BITS = 40, 32

# Element names and class words of the HTML standard and of common use.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
OUTSIDE = frozenset("head nav footer aside form script style textarea title noscript iframe template xmp noembed noframes button select option dialog menu svg math canvas audio video object label".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINER = frozenset("article body center div html main section table tbody td tr".split())
ENDS_P = BLOCK - {"br", "caption", "head", "html", "body", "option", "legend", "tbody", "td", "tfoot", "th", "thead", "tr"}
WORDS_OUTSIDE = frozenset(
    """ad ads adbox adsense advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus
    discussion footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices notification pagination pager popup promo
    promotion recommended related replies reply responses share sharing sidebar sidenav signup skip social sponsor sponsored subscribe subscription
    toolbar topbar widget widgets""".split()
)
COMMENT_WORDS = frozenset("comment comments disqus discussion replies reply responses".split())
#: Words beside which a boilerplate word in a class name is a state of the whole and not the name of a part.
STATE_WORDS = frozenset("has have is no not off on open show shows sticky with without".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES_OUTSIDE = frozenset("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar toolbar".split())

TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)
NAME_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
#: A tag without any of these has no attribute that is looked at.
READ = re.compile("class|id|role|hidden", re.I)
RAW_ENDS = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for name in RAW}


def _names(rest: str) -> tuple[str, int, bool]:
    """What a tag's attributes add to its role, whether their words mark boilerplate (1) or comments (2), and whether the element is hidden."""
    if "=" not in rest and "hidden" not in rest or not READ.search(rest):
        return "", 0, False
    a: dict[str, str] = {}
    for k, x, y, z in ATTRIBUTE.findall(rest):
        a.setdefault(k.lower(), x or y or z)
    names = sorted(set((a.get("class", "") + " " + a.get("id", "")).split()))
    mark = int(a.get("role", "").lower() in ROLES_OUTSIDE)
    for name in names:
        words = {w.lower() for w in NAME_WORDS.findall(name)}
        if words & WORDS_OUTSIDE and not words & STATE_WORDS:
            mark = max(mark, 2 if words & COMMENT_WORDS else 1)
    return ("." + re.sub(r"\d+", "0", " ".join(names)) if names else ""), mark, "hidden" in a or a.get("aria-hidden") == "true"


def _short(number):
    """A hash in TOKEN_BITS bits, the last one left for the kind of the token: even are elements, odd are words."""
    return number >> (65 - TOKEN_BITS) << 1


#: By role the number of an element and the seed of its words.
_roles: dict[str, tuple[int, int]] = {}


def _role(path: str) -> tuple[int, int]:
    found = _roles.get(path)
    if found is None:
        if len(_roles) > 100_000:
            _roles.clear()
        found = _roles[path] = _short(xxhash.xxh64_intdigest(path)), xxhash.xxh64_intdigest(path, 1)
    return found


def element_token(path: str) -> int:
    """The number of an element's role: even, those of words are odd."""
    return _role(path)[0]


def word_token(seed: int, word: str) -> int:
    """The number of a word in elements whose role gives this seed."""
    return _short(xxhash.xxh64_intdigest(word, seed)) | 1


_TOP = ("", "html", "body")


class Element:
    """An open tag: `path` is its role, or that of the block around an inline element; `out` says that it, or one around it, is no part of a text."""

    __slots__ = ("chars", "depth", "frame", "kids", "mark", "name", "out", "parent", "path", "seed", "token")

    def __init__(self, name: str, parent: Element | None, path: str, mark: int, out: bool) -> None:
        self.name, self.parent, self.path, self.mark, self.out = name, parent, path, mark, out
        self.token, self.seed = _role(path)
        self.chars = 0
        self.depth = 0 if parent is None or name in _TOP else parent.depth + 1
        self.kids: dict[str, int] | None = None
        self.frame: Element | None = None

    def placed(self, name: str) -> str:
        """What the place of a next nameless box adds to its role."""
        if name not in PLACED or self.depth >= PLACED_DEPTH:
            return ""
        self.kids = self.kids or {}
        n = self.kids[name] = self.kids.get(name, 0) + 1
        return f"[{n}]" if n > 1 else ""

    def up(self) -> Iterator[Element]:
        e: Element | None = self
        while e is not None:
            yield e
            e = e.parent


OPEN, TEXT, BREAK = range(3)
_CELLS = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_HOLDS = frozenset("ul ol dl table select nav header footer aside blockquote form".split())

#: What short tags are: name, whether it ends an element, attributes, and what _names says of them.
_tags: dict[str, tuple[str, bool, str, tuple[str, int, bool]]] = {}


def _tag(m: re.Match) -> tuple[str, bool, str, tuple[str, int, bool]]:
    """What a match of TOKEN is; the name is empty if it is no tag."""
    if m.lastindex is None:
        return "", False, "", ("", 0, False)
    end, name, rest = m.group(1, 2, 3) if m.lastindex == 3 else m.group(4, 5, 6)
    name = name.lower()
    found = name, bool(end), rest, ("", 0, False) if end or name in VOID or name in RAW else _names(rest)
    if len(m[0]) <= 100:
        if len(_tags) > 20_000:
            _tags.clear()
        _tags[m[0]] = found
    return found


def parsed(page: str) -> list[tuple[int, Element, str]]:
    """A page in order: elements opened, raw texts with the element that holds them, and breaks between blocks."""
    top = Element("", None, "", 0, False)
    items: list[tuple[int, Element, str]] = []
    stack = [top]
    at, n = 0, len(page)
    search, known, add = TOKEN.search, _tags.get, items.append
    while at < n:
        m = search(page, at)
        if m is None:
            add((TEXT, top, page[at:]))
            break
        start, end = m.span()
        if start > at:
            add((TEXT, top, page[at:start]))
        at = end
        tag = m[0]
        name, ends, rest, (extra, mark, hidden) = known(tag) or _tag(m)
        if not name:
            if tag.startswith("<![CDATA["):
                add((TEXT, top, _html.escape(tag[9:].removesuffix("]]>"))))
            continue
        block = name in BLOCK
        if block:
            add((BREAK, top, ""))
        if ends:
            for i in range(len(stack) - 1, 0, -1):
                held = stack[i].name
                if held == name:
                    del stack[i:]
                    top = stack[-1]
                    break
                if held in ("article", "main", "body", "html", "td", "table") and name not in CONTAINER and not block:
                    break
            continue
        if name in VOID:
            continue
        if name in ENDS_P or name in _CELLS:
            own = _CELLS.get(name, ("p",))
            for i in range(len(stack) - 1, 0, -1):
                held = stack[i].name
                if held in own:
                    del stack[i:]
                    top = stack[-1]
                    break
                if held in CONTAINER or held in _HOLDS:
                    break
        if name in RAW:
            close = RAW_ENDS[name].search(page, at)
            at = close.end() if close else n
            continue
        if rest.endswith("/") and name in ("svg", "math", "path"):
            continue
        whole = name in ("html", "body", "article", "main")
        out = top.out or name in OUTSIDE or (hidden and not whole) or (name == "header" and not any(x.name in ("article", "main") for x in stack))
        top = Element(name, top, f"{top.path}/{name}{extra or top.placed(name)}" if block else top.path, 0 if whole else mark, out)
        stack.append(top)
        add((OPEN, top, ""))
    return items


def joined(pieces: list[tuple[Element, str]]) -> str:
    """A block's text: white space is single, and none is around it."""
    return " ".join("".join(t for _, t in pieces).split())


def blocks(items: list[tuple[int, Element, str]]) -> Iterator[list[tuple[Element, str]]]:
    """Runs of text between breaks, outside the elements that are no part of a text: pieces with the elements that hold them, references decoded."""
    pieces: list[tuple[Element, str]] = []
    for kind, e, raw in items:
        if kind == TEXT and not e.out:
            if pieces and pieces[-1][0].path != e.path:
                yield pieces
                pieces = []
            pieces.append((e, _html.unescape(raw)))
        elif kind == BREAK and pieces:
            yield pieces
            pieces = []
    if pieces:
        yield pieces


def text_vector(items: list[tuple[int, Element, str]]) -> list[int]:
    """Which block elements below the body hold how much of a page's text: tokens, shifted by three bits, and PARTS parts of it, rounded."""
    own: dict[int, int] = {}
    opened = [e for kind, e, _ in items if kind == OPEN and not e.out]
    total = 0
    for kind, e, raw in items:
        if kind == TEXT and not e.out:
            n = len(raw.strip())
            own[id(e)] = own.get(id(e), 0) + n
            total += n
    held: dict[int, int] = {}
    for e in reversed(opened):
        n = own.get(id(e), 0)
        if n and e.name not in _TOP:
            if e.name in BLOCK:
                held[e.token] = held.get(e.token, 0) + n
            own[id(e.parent)] = own.get(id(e.parent), 0) + n
    levels = ((t, int(PARTS * n / total + 0.5)) for t, n in held.items())
    return sorted(t << 3 | min(n, PARTS) for t, n in levels if n)


def likeness(a: list[int], b: list[int]) -> float:
    """What two vectors share as a part of what they hold together."""
    x, y = ({v >> 3: v & 7 for v in vector} for vector in (a, b))
    both = sum(max(x.get(t, 0), y.get(t, 0)) for t in x.keys() | y.keys())
    return sum(min(x[t], y[t]) for t in x.keys() & y.keys()) / both if both else 1.0


def nearest(vector: list[int], layouts: list[list[int]]) -> int:
    """The place of the most alike layout, the first of several."""
    return max(range(len(layouts)), key=lambda i: (likeness(vector, layouts[i]), -i))


def _layout(items: list[tuple[int, Element, str]], layouts: list | None) -> int:
    """The place of a page's layout among those of its host."""
    return nearest(text_vector(items), [x["vector"] for x in layouts]) if layouts and len(layouts) > 1 else 0


def _occurrences(items: list[tuple[int, Element, str]], elements: array, words: bytearray) -> None:
    """Adds the number of each element, and the hash of each word, outside the elements that are no part of a text. No Python code runs for a word."""
    for kind, e, raw in items:
        if e.out:
            continue
        if kind == TEXT:
            words += b"".join(map(xxhash.xxh64_digest, _html.unescape(raw).split(), repeat(e.seed)))
        elif kind == OPEN and e.name in BLOCK:
            elements.append(e.token)


def _counted(pages: list[str], layouts: list[list | None] | None = None, found: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How often each token occurs in each page: places of pages, tokens and counts, in the order of pages and tokens. Layouts of pages are added to `found`."""
    elements, words = array("Q"), bytearray()
    ends = np.zeros((len(pages) + 1, 2), np.int64)
    for i, page in enumerate(pages):
        if page:
            items = parsed(page)
            _occurrences(items, elements, words)
            if found is not None:
                found[i] = _layout(items, layouts[i])
        ends[i + 1] = len(elements), len(words) // 8
    place = np.arange(len(pages), dtype=np.uint64) << np.uint64(TOKEN_BITS)
    hashes = np.frombuffer(words, ">u8").astype(np.uint64)
    keys = np.concatenate([np.frombuffer(elements, np.uint64), _short(hashes) | np.uint64(1)])
    keys |= np.concatenate([np.repeat(place, np.diff(ends[:, i])) for i in range(2)])
    keys, times = np.unique(keys, return_counts=True)
    return (keys >> np.uint64(TOKEN_BITS)).astype(np.int64), (keys & np.uint64((1 << TOKEN_BITS) - 1)).astype(np.int64), times.astype(np.int64)


def page_tokens(page: str) -> dict[int, int]:
    """How often each token occurs in a page, outside the elements that are no part of a text."""
    _, tokens, times = _counted([page])
    return dict(zip(tokens.tolist(), times.tolist(), strict=True))


#: What stands for a token where a class's order is counted.
ORDER = -2


def _reduced(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Arrays (host and token in one number, pages, times, vector) summed up by the first, in its order."""
    key, *sums = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return key[first], *[np.add.reduceat(x[order], first) for x in sums]


def _counter(rows) -> Iterator[pa.RecordBatch]:
    """Sums of the pages (host, page, html) of a task by host, layout and token."""
    names: dict[tuple[str, int], int] = {}  # fewer than 1 << (63 - TOKEN_BITS): each has a token, and only some are held
    parts: list[tuple[np.ndarray, ...]] = []

    def emitted(rows: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        place = pa.array(rows[0] >> TOKEN_BITS, pa.int32())
        hosts = pa.DictionaryArray.from_arrays(place, pa.array([h for h, _ in names], pa.string())).cast(pa.string())
        layouts = pa.array([k for _, k in names], pa.int32()).take(place)
        token = rows[0] & ((1 << TOKEN_BITS) - 1)
        return pa.RecordBatch.from_arrays([hosts, layouts, *[pa.array(x, pa.int64()) for x in (token, *rows[1:])]], names=["host", "layout", "token", "pages", "times", "vector"])

    for batch, lo, hi, own in rows:
        hosts, texts = (batch.column(i).slice(lo, hi - lo).to_pylist() for i in (0, 2))
        pages = batch.column(1).slice(lo, hi - lo).to_numpy()
        found = [0] * (hi - lo)
        place, token, times = _counted(texts, [x for (x,) in own], found)
        if not len(place):
            continue
        host = np.zeros(hi - lo, np.int64)
        for i in np.unique(place).tolist():
            host[i] = names.setdefault((hosts[i], found[i]), len(names))
        parts.append(_reduced([(host[place] << TOKEN_BITS | token, np.ones(len(times), np.int64), times, _mixed(pages[place], times))]))
        if sum(len(x[0]) for x in parts) > HELD:
            parts = [_reduced(parts)]
            if len(parts[0][0]) > HELD // 2:
                yield emitted(parts[0])
                parts, names = [], {}
    if parts:
        yield emitted(_reduced(parts))


def _mixed(page: np.ndarray, times: np.ndarray) -> np.ndarray:
    """VECTOR_BITS bits for each (page, count): sums of them cannot overflow."""
    from weftline.llm.common import mixed

    return (mixed(page.view(np.uint64) + times.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - VECTOR_BITS)).astype(np.int64)


def host_of(url: F.Column) -> F.Column:
    """A URL's host in lower case; empty if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's pages (host, html) counted by text vector; empty pages are left out."""
    counts: Counter = Counter()
    held = 0

    def emitted() -> pa.RecordBatch:
        columns = [pa.array([h for h, _ in counts], pa.string()), pa.array([list(v) for _, v in counts], pa.list_(pa.int64())), pa.array(list(counts.values()), pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["host", "vector", "pages"])

    with task(__name__):
        for batch in batches:
            texts = batch.column(1)
            for lo, hi in steps(_sizes(texts)):
                for host, page in zip(batch.column(0).slice(lo, hi - lo).to_pylist(), texts.slice(lo, hi - lo).to_pylist(), strict=True):
                    if page:
                        key = host, tuple(text_vector(parsed(page)))
                        counts[key] += 1
                        held += len(key[1]) + 4 if counts[key] == 1 else 0
                        if held > HELD:
                            yield emitted()
                            counts.clear()
                            held = 0
        yield emitted()


def _leaders(rows: pd.DataFrame) -> pd.DataFrame:
    """Of a host's commonest vectors (host, rank, vector), in order, those that are unlike all before."""
    found: list[list[int]] = []
    for vector in rows.sort_values("rank").vector:
        v = [int(x) for x in vector]
        if all(likeness(v, x) < ALIKE for x in found):
            found.append(v)
    return pd.DataFrame({"host": [rows.host.iloc[0]], "leaders": [found]})


def _assigned(vectors: DataFrame, layouts: DataFrame, least: float) -> DataFrame:
    """(host, layout, pages, vector) of layouts (host, leaders), most alike to at least `least` of vectors (host, vector, pages); layouts without pages are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, given, pages, leaders = (c.to_pylist() for c in batch.columns)
            sums: Counter = Counter()
            for host, v, n, found in zip(hosts, given, pages, leaders, strict=True):
                k = nearest(v, found) if len(found) > 1 else 0
                if likeness(v, found[k]) >= least:
                    sums[host, k] += n
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in sums], pa.string()), pa.array([k for _, k in sums], pa.int32()), pa.array(list(sums.values()), pa.int64())], names=["host", "layout", "pages"])

    side = layouts.select(F.col("host").alias("__host"), "leaders")
    met = vectors.join(side, F.col("host") == F.col("__host")).select("host", "vector", "pages", "leaders")
    sums = met.mapInArrow(run, "host string, layout int, pages long").groupBy("host", "layout").agg(F.sum("pages").alias("pages"))
    return sums.join(side, F.col("host") == F.col("__host")).select("host", "layout", "pages", F.get("leaders", F.col("layout")).alias("vector"))


def page_layouts(pages: DataFrame) -> DataFrame:
    """(host, layout, vector, all_pages) of the layouts of pages (host, html), numbered by the pages they have; hosts of fewer than LEAST_PAGES pages are left out.

    Pages are counted by vector in each task and then summed up; the layouts of a host are sought among LEADERS vectors, and all its vectors are summed by layout.
    """
    small_batches(pages.sparkSession)
    vectors = written(pages.select("host", "html").mapInArrow(_vectors, "host string, vector array<long>, pages long").groupBy("host", "vector").agg(F.sum("pages").alias("pages")))
    hosts = vectors.groupBy(F.col("host").alias("__host")).agg(F.sum("pages").alias("of")).filter(F.col("of") >= LEAST_PAGES)
    rank = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("pages"), "vector"))
    first = vectors.withColumn("rank", rank).filter(F.col("rank") <= LEADERS).join(hosts, F.col("host") == F.col("__host"), "left_semi")
    leaders = written(first.select("host", "rank", "vector").groupBy("host").applyInPandas(_leaders, "host string, leaders array<array<long>>"))
    support = _assigned(vectors, leaders, ALIKE).join(hosts, F.col("host") == F.col("__host")).drop("__host")
    enough = support.withColumn("rank", F.row_number().over(Window.partitionBy("host").orderBy(F.desc("pages"), "vector"))).filter(
        (F.col("rank") == 1) | ((F.col("pages") >= LEAST_PAGES) & (F.col("pages") >= LAYOUT * F.col("of")))
    )
    kept = written(enough.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("rank", "vector"))).alias("l")).select("host", F.col("l.vector").alias("leaders")))
    return written(_assigned(vectors, kept, 0.0).select("host", "layout", "vector", F.col("pages").alias("all_pages")))


def _by_host(layouts: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """(host, layouts) with an array of layouts in order, each a vector and the columns that `own` has for it."""
    names = [c for c in own.columns if c not in ("host", "layout")] if own is not None else []
    rows = layouts.select("host", "layout", "vector")
    if own is not None:
        side = own.select(F.col("host").alias("__host"), F.col("layout").alias("__layout"), *names)
        rows = rows.join(side, (F.col("host") == F.col("__host")) & (F.col("layout") == F.col("__layout")), "left")
    held = F.array_sort(F.collect_list(F.struct("layout", "vector", *names)))
    return rows.groupBy("host").agg(held.alias("layouts"))


def classes(pages: DataFrame, layouts: DataFrame | None = None) -> DataFrame:
    """(host, layout, token, class, pages, all_pages, once) of the tokens of pages (host, html) that are in enough pages of their layout, by equivalence class.

    One shuffle of sums by (host, layout, token), which tasks add up before it; pages are not shuffled. Without layouts a host is one.
    """
    if layouts is None:
        whole = pages.groupBy("host").agg(F.count("*").alias("all_pages")).filter(F.col("all_pages") >= LEAST_PAGES)
        layouts = written(whole.select("host", F.lit(0).alias("layout"), F.array().cast("array<long>").alias("vector"), "all_pages"))
    given = pages.select("host", F.xxhash64("host", "html").alias("page"), "html")
    sums = _with_templates(given, _by_host(layouts), ["layouts"], _counter)("host string, layout int, token long, pages long, times long, vector long")
    counts = sums.groupBy("host", "layout", "token").agg(*[F.sum(c).alias(c) for c in ("pages", "times", "vector")]).filter(f"pages >= {LEAST_PAGES}")
    side = layouts.select(F.col("host").alias("__host"), F.col("layout").alias("__layout"), "all_pages")
    enough = counts.join(side, (F.col("host") == F.col("__host")) & (F.col("layout") == F.col("__layout"))).filter(F.col("pages") >= SUPPORT * F.col("all_pages"))
    return enough.select("host", "layout", "token", F.xxhash64("pages", "times", "vector").alias("class"), "pages", "all_pages", (F.col("times") == F.col("pages")).alias("once"))


def _known(tokens: DataFrame) -> DataFrame:
    """(host, layout, tokens, classes) of the tokens that a template may use: elements that occur once, and words of classes with LEAST_WORDS of them."""
    word = F.col("token") % 2 != 0
    place = ["host", "layout", "class"]
    many = tokens.filter(word).groupBy(*place).agg(F.count("*").alias("n")).filter(f"n >= {LEAST_WORDS}")
    words = tokens.filter(word).join(many, place, "left_semi").select("host", "layout", "token", "class")
    pairs = F.array_sort(F.collect_list(F.struct("token", "class")))
    rows = tokens.filter(~word & F.col("once")).select("host", "layout", "token", "class").union(words)
    return rows.groupBy("host", "layout").agg(pairs.alias("p")).select("host", "layout", F.col("p.token").alias("tokens"), F.col("p.class").alias("classes"))


def _with_templates(pages: DataFrame, templates: DataFrame, names: list[str], run: Callable) -> Callable[[str], DataFrame]:
    """run(rows) over batches of rows (the columns of pages, then `names` of the page's host): broadcast if they are few, else joined by host."""
    small_batches(pages.sparkSession)
    inner = [f for f in templates.schema["layouts"].dataType.elementType.names if f in ("vector", "tokens")]
    size = F.aggregate("layouts", F.lit(4), lambda n, x: n + sum((F.coalesce(F.array_size(x[f]), F.lit(0)) for f in inner), F.lit(4)))
    many = templates.agg(F.sum(size)).first()[0] or 0
    k = len(pages.columns)
    if many <= BROADCAST_TOKENS:
        own = {r["host"]: tuple([x.asDict() for x in r[n]] for n in names) for r in templates.collect()}
        known = pages.sparkSession.sparkContext.broadcast(own)
        place = pages.columns.index("host")
        none = (None,) * len(names)

        def pick(part: pa.RecordBatch) -> list[tuple]:
            return [known.value.get(h, none) for h in part.column(place).to_pylist()]

        given = pages
    else:
        side = templates.select(F.col("host").alias("__host"), *names)
        given = pages.join(side, F.col("host") == F.col("__host"), "left").select(*pages.columns, *names)

        def pick(part: pa.RecordBatch) -> list[tuple]:
            return list(zip(*[c.to_pylist() for c in part.columns[k:]], strict=True))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with task(__name__):
            yield from run(((batch, lo, hi, pick(batch.slice(lo, hi - lo))) for batch in batches for lo, hi in steps(_sizes(batch.column(k - 1)))))

    return lambda schema: given.mapInArrow(work, schema)


def _sizes(texts: pa.Array) -> list[int]:
    import pyarrow.compute as pc

    return [n or 0 for n in pc.binary_length(texts).to_pylist()]


class _Words:
    """Which blocks of a page are a class's own words."""

    def __init__(self, known: dict[int, int]) -> None:
        self.known = known

    def template(self, pieces: list[tuple[Element, str]]) -> bool:
        own = None
        for e, t in pieces:
            for w in t.split():
                of = self.known.get(word_token(e.seed, w))
                if of is None or own not in (None, of):
                    return False
                own = of
        return own is not None


def _frames(items: list[tuple[int, Element, str]], known: dict[int, int]) -> list[Element]:
    """The page's elements of the host's classes, in order; every element's `frame` is the nearest of them around it, or itself."""
    found = []
    for kind, e, _ in items:
        if kind == OPEN:
            e.frame = e.parent.frame if e.parent else None
            if e.name in BLOCK and e.token in known:
                e.frame = e
                found.append(e)
    return found


def _decoded(held: dict[tuple, dict[int, int]], key: tuple, layout: dict) -> dict[int, int]:
    """The classes of a layout's tokens, kept in `held`."""
    if key not in held:
        if len(held) > 256:
            held.clear()
        held[key] = dict(zip(layout["tokens"] or (), layout["classes"] or (), strict=True))
    return held[key]


#: Bits of an element in a template.
IS_OUT, IS_MARKED, IS_ARTICLE, IS_MAIN, IS_PAGE = 1, 2, 4, 8, 16
_FLAGS = {"article": IS_ARTICLE, "main": IS_MAIN, "html": IS_PAGE, "body": IS_PAGE}
SLOTS = "host string, layout int, token long, class long, parent long, flags long, pages long, own long, links long, heads long"


def _slots(rows) -> Iterator[pa.RecordBatch]:
    """Sums over a task's pages (host, html) by layout: of each element in a class its class, the element around it and its slot's text; and the orders of classes (token ORDER)."""
    sums: dict[tuple, list[int]] = {}

    def emitted() -> pa.RecordBatch:
        keys, values = list(sums), list(sums.values())
        names = [x.split()[0] for x in SLOTS.split(", ")]
        columns = [pa.array([k[i] for k in keys], (pa.string(), pa.int32())[i] if i < 2 else pa.int64()) for i in range(6)] + [pa.array([v[i] for v in values], pa.int64()) for i in range(4)]
        return pa.RecordBatch.from_arrays(columns, names=names)

    decoded: dict[tuple, dict[int, int]] = {}
    for batch, lo, hi, own in rows:
        hosts, pages = (c.slice(lo, hi - lo).to_pylist() for c in batch.columns[:2])
        for host, page, (layouts,) in zip(hosts, pages, own, strict=True):
            if not layouts or not page:
                continue
            items = parsed(page)
            place = _layout(items, layouts)
            known = _decoded(decoded, (host, place), layouts[place])
            if not known:
                continue
            frames = _frames(items, known)
            order: dict[int, list[int]] = {}
            slots: dict[int, list[int]] = {}
            for e in frames:
                order.setdefault(known[e.token], []).append(e.token)
                slots[e.token] = [1, 0, 0, 0]
            words = _Words(known)
            for pieces in blocks(items):
                e = pieces[0][0]
                if e.frame is not None and not words.template(pieces):
                    n = len(joined(pieces))
                    x = slots[e.frame.token]
                    x[1] += n
                    x[2] += min(n, sum(len(t.strip()) for y, t in pieces if any(z.name == "a" for z in y.up())))
                    x[3] += n * any(y.name in HEADINGS for y in e.up())
            for e in frames:
                above = e.parent.frame if e.parent else None
                marked = any(y.mark for y in e.up())
                flags = IS_OUT * e.out + IS_MARKED * marked + _FLAGS.get(e.name, 0)
                x = sums.setdefault((host, place, e.token, known[e.token], above.token if above else 0, flags), [0, 0, 0, 0])
                for i, v in enumerate(slots[e.token]):
                    x[i] += v
            for c, tokens_ in order.items():
                sums.setdefault((host, place, ORDER, c, hash(tuple(tokens_)), 0), [0, 0, 0, 0])[0] += 1
            if len(sums) > 50_000:
                yield emitted()
                sums.clear()
    yield emitted()


def nested(rows: pd.DataFrame) -> tuple[list[int], set[int]]:
    """The elements to extract and the valid classes of one layout, from rows (token, class, parent, flags, pages, own, links, heads).

    Rows of ORDER have a hash of an order of the class as parent. Its rows are as many as the tokens that half of the layout's pages share: twice those of a page of it at most.
    """
    order = rows[rows.token == ORDER]
    by_class = order.groupby("class").pages
    valid = set((by_class.max() >= ORDERED * by_class.sum()).loc[lambda x: x].index.tolist())
    valid |= set(rows["class"]) - set(order["class"])
    nodes: dict[int, dict] = {}
    for token, of in rows[rows.token != ORDER].groupby("token"):
        top = of.sort_values(["pages", "parent", "flags"]).iloc[-1]  # the usual place of the element
        nodes[int(token)] = {"class": int(top["class"]), "parent": int(top["parent"]), "flags": int(top["flags"]), **{c: int(of[c].sum()) for c in ("own", "links", "heads")}}
    for node in nodes.values():  # elements of classes without an order are no part of the template: their slots join those around them
        while node["parent"] in nodes and nodes[node["parent"]]["class"] not in valid:
            node["parent"] = nodes[node["parent"]]["parent"]
    for node in list(nodes.values()):
        if node["class"] not in valid and node["parent"] in nodes:
            for c in ("own", "links", "heads"):
                nodes[node["parent"]][c] += node[c]
    nodes = {t: n for t, n in nodes.items() if n["class"] in valid}

    def line(t: int) -> list[int]:
        out = []
        while t in nodes and t not in out:
            out.append(t)
            t = nodes[t]["parent"]
        return out

    for t, node in nodes.items():  # a class is split by the slot of another in which its elements lie
        outer = next((x for x in line(t) if nodes[x]["class"] != node["class"]), 0)
        node["part"] = (node["class"], outer)
    prose = {t: n["own"] - n["links"] for t, n in nodes.items() if not n["flags"] & IS_OUT and n["own"] > 2 * n["links"]}
    if not prose or not max(prose.values()):
        return [], valid
    clean = {t: v for t, v in prose.items() if not nodes[t]["flags"] & IS_MARKED}
    if clean and max(clean.values()) >= 0.1 * max(prose.values()):
        prose = clean
    main = max(prose, key=lambda t: (prose[t], t))
    for bit in (IS_ARTICLE, IS_MAIN):
        for t in line(main):
            if nodes[t]["flags"] & bit:
                return [t], valid
    large = [t for t in prose if prose[t] >= LARGE * prose[main]]
    shared = [t for t in line(main) if all(t in line(x) for x in large)]
    heading = lambda t: nodes[t]["own"] > 0 and 2 * nodes[t]["heads"] >= nodes[t]["own"]
    inside = lambda t: bool(nodes[t]["flags"] & IS_PAGE)
    if not shared or inside(shared[0]) and shared[0] != main:
        tops = [t for t in large if not any(x in large for x in line(t)[1:])]
        heads = [t for t in nodes if heading(t) and not nodes[t]["flags"] & IS_OUT and inside(nodes[t]["parent"] if nodes[t]["parent"] in nodes else t) and not set(line(t)) & set(tops)]
        return sorted([*tops, *heads]), valid
    top = shared[0]
    for t in shared[1:]:  # what is around it, while that adds nothing but headings
        gained = [x for x in nodes if t in line(x) and top not in line(x) and nodes[x]["own"] > 0 and not nodes[x]["flags"] & IS_OUT]
        if inside(t) or not all(heading(x) for x in gained):
            break
        top = t
    return [top], valid


def deduced(pages: DataFrame, layouts: DataFrame | None = None) -> DataFrame:
    """(host, layout, region, tokens, classes) of the layouts of pages (host, html) that have a template: elements to extract, and the words of valid classes.

    Templates are two aggregations over (host, layout, token) sums, so a host with a third of all pages is summed in parts.
    """
    layouts = page_layouts(pages) if layouts is None else layouts
    tokens = written(classes(pages, layouts))
    known = written(_known(tokens))
    slots = _with_templates(pages, _by_host(layouts, known), ["layouts"], _slots)(SLOTS)
    sums = slots.groupBy("host", "layout", "token", "class", "parent", "flags").agg(*[F.sum(c).alias(c) for c in ("pages", "own", "links", "heads")])

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        region, valid = nested(rows)
        return pd.DataFrame({"host": [rows.host.iloc[0]], "layout": [rows.layout.iloc[0]], "region": [region], "valid": [sorted(valid)]})

    found = written(written(sums).groupBy("host", "layout").applyInPandas(one, "host string, layout int, region array<long>, valid array<long>"))
    pairs = F.filter(F.arrays_zip("tokens", "classes"), lambda x: (x["tokens"] % 2 != 0) & F.array_contains("valid", x["classes"]))
    met = known.join(found, ["host", "layout"]).filter(F.size("region") > 0)
    return written(met.select("host", "layout", "region", pairs.alias("p")).select("host", "layout", "region", F.col("p.tokens").alias("tokens"), F.col("p.classes").alias("classes")))


def _inside(e: Element, tops: set[int]) -> bool:
    return any(id(x) in tops for x in e.up())


def extracted(page: str | None, region: list[int] | None = None, known: dict[int, int] | None = None, items: list | None = None) -> str:
    """The text of a page: that of its elements of `region` without blocks of `known` words, or else of its article or main elements, or all of it, outside boilerplate."""
    if not page:
        return ""
    items = items or parsed(page)
    found = list(blocks(items))
    for pieces in found:
        for e, t in pieces:
            n = len(t.strip())
            for x in e.up():
                x.chars += n
    opened = [e for kind, e, _ in items if kind == OPEN and not e.out]
    wanted = set(region or ())
    for tops in ([e for e in opened if e.name in BLOCK and e.token in wanted], [e for e in opened if e.name in ("article", "main")], None):
        if tops is not None and not tops:
            continue
        ids = None if tops is None else {id(e) for e in tops}
        inner = [b for b in found if ids is None or _inside(b[0][0], ids)]
        size = [sum(len(t.strip()) for _, t in b) for b in inner]
        if known and tops and tops[0].token in wanted:
            words = _Words(known)
            fixed = {i for i, b in enumerate(inner) if words.template(b)}
            if 2 * sum(size[i] for i in fixed) <= sum(size):  # else copies of one page: their text is no template
                inner = [b for i, b in enumerate(inner) if i not in fixed]
        # An element that its class names call boilerplate is none if most of the text is in it; comments always are.
        bare: dict[int, bool] = {}
        for e in {id(e): e for b in inner for e, _ in b}.values():
            bare[id(e)] = not any(x.mark == 2 or (x.mark == 1 and 2 * x.chars <= sum(size)) for x in _below(e, ids))
        for all_ in (False, True):
            text = " ".join(filter(None, (joined([p for p in b if all_ or bare[id(p[0])]]) for b in inner)))
            if text:
                return text
    return ""


def _below(e: Element, tops: set[int] | None) -> Iterator[Element]:
    """The elements around e up to the first of the tops, without it."""
    for x in e.up():
        if tops is not None and id(x) in tops:
            return
        yield x


def _texts(carry: list[str], schema):
    def run(rows) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        k = len(carry)
        decoded: dict[tuple, dict[int, int]] = {}
        for batch, lo, hi, own in rows:
            part = batch.slice(lo, hi - lo)
            out = []
            for host, page, (layouts,) in zip(part.column(k).to_pylist(), part.column(k + 1).to_pylist(), own, strict=True):
                if not layouts or not page:
                    out.append(extracted(page))
                    continue
                items = parsed(page)
                place = _layout(items, layouts)
                region = layouts[place]["region"]
                out.append(extracted(page, region, _decoded(decoded, (host, place), layouts[place]) if region else None, items))
            held = [c.cast(arrow.field(i).type) if c.type != arrow.field(i).type else c for i, c in enumerate(part.columns[:k])]
            yield pa.RecordBatch.from_arrays([*held, pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], schema=arrow)

    return run


def main_texts(pages: DataFrame, carry: list[str], url: str = "url", html: str = "html") -> DataFrame:
    """For each row: the carried columns, text, n_chars. Null or empty html gives an empty text; pages without a host are one host.

    Each row is a page of its host, repeated rows too. Pages themselves are not shuffled while the hosts' templates
    fit a broadcast of a checked size; four passes read them.
    """
    from pyspark.sql import types as T

    rows = pages.select(host_of(F.col(f"`{url}`")).alias("host"), F.col(f"`{html}`").alias("html"))
    layouts = page_layouts(rows)
    found = _by_host(layouts, deduced(rows, layouts))
    keep = [c for c in carry if c not in ("text", "n_chars")]
    # Carried columns get names of their own on the way, as any name may clash.
    given = pages.select(*[F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(keep)], host_of(F.col(f"`{url}`")).alias("host"), F.col(f"`{html}`").alias("html"))
    names = [f"__c{i}" for i in range(len(keep))]
    schema = T.StructType([*given.select(*names).schema.fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    out = _with_templates(given, found, ["layouts"], _texts(names, schema))(schema)
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], "text", "n_chars")
