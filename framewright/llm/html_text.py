"""Main text of web pages by wrappers inferred for each host as union-free regular expressions.

A page is a stream of runs: neighbouring blocks of text under one path of block elements, a repeated group where there are
several. The wrapper of a host starts as one page's stream, and every further page is aligned with it along the longest common
subsequence: a run that only one side has becomes optional, a run whose text differs becomes a slot, a run with the same text on
all pages stays a constant. Wrappers are aligned with each other in the same way, so each task folds its own pages and the
partial wrappers of a host, however many, are merged in rounds of bounded groups.

The wrapper then reads the pages: the text under slots tells, among the elements that a page has, which hold the host's own
text. Constants are the template's: those outside an article, and inside one those that most of the host's pages have. Elements that
say what they are by tag, role or a whole name are never text; of those whose name only partly says so, the wrapper drops the
constants and keeps the slots.
"""

from __future__ import annotations

import html as html_lib
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from framewright.llm.common import cut, few, small_batches, tidied

#: Up to so many hosts the wrappers are broadcast, if they have MOST_NODES nodes of 40 bytes at most together; else they are joined by host.
BROADCAST_HOSTS = 20_000
MOST_NODES = 500_000
#: Partial wrappers that one task merges, about.
MERGED = 64
#: Pages that must share a constant before it counts as the template's.
LEAST_PAGES = 3
#: A task hands a host's partial wrapper on when it has more nodes than this, and starts another.
PARTIAL_NODES = 2_000
#: Orders of paths that a wrapper remembers the alignment of, and hosts whose wrappers a task remembers.
REMEMBERED = 1_000
HELD_HOSTS = 256
#: A node on fewer than one page in so many of its host is left to the page's own evidence.
RARE = 1_000

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>"
    r"|<(script|style|noscript|template|textarea|svg|iframe|title|select|object|canvas)\b(?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][\w:-]*)((?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+|[^>]*)>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_BLOCKS = frozenset("html head body p div h1 h2 h3 h4 h5 h6 li ul ol dl dt dd table thead tbody tfoot tr td th caption section article main header footer nav aside form fieldset blockquote pre figure figcaption address details summary hr center menu dialog hgroup".split())
_VOID = frozenset("br hr img input meta link source wbr col area base embed param track".split())
#: Elements that end an open one of the same kind, and the elements that this doesn't reach beyond.
_ENDS = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table"))}
_LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd table thead tbody tr td th blockquote pre figure figcaption caption".split())
_PARAGRAPHS = frozenset("p li dt dd blockquote pre figcaption caption".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_ARTICLE = frozenset(("article", "main"))
_FURNITURE = frozenset("head nav footer aside form button menu dialog".split())
#: Words in a class, an id or a role that say what an element is; those of _TOPICS can also be what an article is about.
_HINTS = frozenset("ad ads advert adverts advertisement sponsor sponsored nav navbar navigation breadcrumb breadcrumbs sidebar footer comment comments cookie cookies consent popup modal newsletter subscribe pagination pager disqus responses replies complementary contentinfo masthead".split())
_TOPICS = frozenset("widget promo banner menu notice notices share sharing social related toolbar login search alert skip toc".split())
_OUTER_HINTS = frozenset("header top topbar".split())
#: Words beside a hint that tell where or in what form it stands, not what else an element is about.
_FORMS = frozenset("main top bottom left right side inner outer header footer site page post article entry blog user reader readers section area region block blocks box boxes wrap wrapper container inner holder slot unit units list lists item items link links button buttons bar bars icon icons panel form thread count body content text title heading label message msg group row col column desktop mobile primary secondary global local sub fixed sticky google media network posts articles stories signup image images video".split())
#: First words of classes that tell a state and not what the element is.
_STATES = frozenset("no has with without is not hide show".split())


def _attributes(text: str) -> dict[str, str]:
    """Names in lower case and values; the first of a repeated name counts."""
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return found


def _says(value: str, hints: frozenset) -> int:
    """2 if one of the names in value is a hint, but for words that only tell its place or form; 1 if one begins or ends with a hint beside other words."""
    said = 0
    for name in value.split():
        words = [w for w in re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()) if w and not w.isdigit()]
        if words and words[0] not in _STATES and any(w in hints for w in words):
            whole = all(w in hints or w in _FORMS for w in words)
            said = max(said, 2 if whole else int(words[0] in hints or words[-1] in hints))
    return said


def _looked_at(tag: str, attributes: str, block: bool, in_article: bool) -> tuple[str, bool, bool]:
    """How the element shows in a path; whether it is furniture; whether it may be, if the wrapper finds the same text on other pages."""
    gone = tag in _FURNITURE or (tag == "header" and not in_article)
    if not attributes.strip(" /\n\t"):
        return tag, gone, False
    found = _attributes(attributes)
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in re.sub(r"\s", "", found.get("style", "")).lower()
    names = (found.get("class", "").split() or found.get("id", "").split() or [""])[0]
    mark = f"{tag}.{re.sub(r'[0-9]+', 'N', names)}" if names else tag
    if not block or gone or hidden or tag in _ARTICLE or tag in ("body", "html"):
        return mark, gone or hidden, False
    strong = _HINTS | (frozenset() if in_article else _OUTER_HINTS)
    said = max(_says(found.get("class", "") + " " + found.get("role", ""), strong | _TOPICS), _says(found.get("id", ""), strong if in_article else strong | _TOPICS))
    if tag in _HEADINGS:
        return mark, False, False
    if tag in _PARAGRAPHS and _says(found.get("class", ""), _HINTS) < 2:
        return mark, False, said > 0
    return mark, said == 2, said == 1


class Page(NamedTuple):
    """parents, paths and tags of its block elements, paths as hashes; blocks: (element, text, suspect) in order."""

    parents: list[int]
    paths: list[int]
    tags: list[str]
    blocks: list[tuple[int, str, bool]]


def parsed(page: str) -> Page:
    """The blocks of text between block tags that aren't furniture; each is one line, character references decoded."""
    parents, paths, tags, blocks = [-1], [0], [""], []
    stack: list[tuple[str, int, bool, bool]] = []  # tag, its element or that of the block around it, furniture, suspect
    open_: dict[str, int] = defaultdict(int)
    texts: list[str] = []

    def flush() -> None:
        text = " ".join(html_lib.unescape("".join(texts)).split()) if texts else ""
        texts.clear()
        if text:
            blocks.append((stack[-1][1] if stack else 0, text, bool(stack) and stack[-1][3]))

    def close(down_to: int) -> None:
        while len(stack) > down_to:
            open_[stack.pop()[0]] -= 1

    def innermost(kinds: tuple[str, ...], within: tuple[str, ...] = ()) -> int | None:
        if not any(open_[k] for k in kinds):
            return None
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in kinds:
                return i
            if stack[i][0] in within:
                return None
        return None

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at and not (stack and stack[-1][2]):
            texts.append(page[at : m.start()])
        at = m.end()
        if m[3] is None:
            continue
        tag = m[3].lower()
        block = tag in _BLOCKS
        if m[2]:
            if block:
                flush()
            if (i := innermost((tag,))) is not None:
                if any(s[1] != stack[-1][1] for s in stack[i:]):
                    flush()
                close(i)
            continue
        if tag in _VOID:
            if block:
                flush()
            elif tag in ("br", "wbr"):
                texts.append(" " * (tag == "br"))
            continue
        if block:
            flush()
            if tag not in ("html", "body") and (i := innermost(("p",))) is not None:
                close(i)
            if tag in _ENDS and (i := innermost(*_ENDS[tag])) is not None:
                close(i)
            if tag == "body" and (i := innermost(("head",))) is not None:
                close(i)
        above, gone, suspect = stack[-1][1:] if stack else (0, False, False)
        mark, own_gone, own_suspect = _looked_at(tag, m[4] or "", block, bool(open_["article"] or open_["main"]))
        if block:
            parents.append(above)
            paths.append(xxhash.xxh64_intdigest(mark, paths[above]) >> 1)
            tags.append(tag)
            above = len(paths) - 1
        stack.append((tag, above, gone or own_gone, suspect or own_suspect))
        open_[tag] += 1
    if not (stack and stack[-1][2]):
        texts.append(page[at:])
    flush()
    return Page(parents, paths, tags, blocks)


class Run(NamedTuple):
    """Neighbouring blocks of one path: a repeated group if there are several."""

    path: int
    hash: int  # of its texts
    size: int
    blocks: range


def runs(page: Page) -> list[Run]:
    found: list[Run] = []
    of = [page.paths[element] for element, _, _ in page.blocks]
    ends = [i for i in range(1, len(of)) if of[i] != of[i - 1]]
    for a, b in zip([0, *ends], [*ends, len(of)], strict=True):
        if a < b:
            texts = [page.blocks[i][1] for i in range(a, b)]
            found.append(Run(of[a], (xxhash.xxh64_intdigest("\n".join(texts)) >> 1) | 1, sum(map(len, texts)), range(a, b)))
    return found


class Wrapper:
    """nodes in order: [path, hash of the constant text or 0 for a slot, characters, pages, repeated]; one on fewer pages than
    the wrapper has is optional."""

    def __init__(self, nodes: list[list[int]], pages: int):
        self.nodes, self.pages = nodes, pages
        self.known: dict[tuple[int, ...], list[list[int] | None]] = {}
        self._index()

    @classmethod
    def of(cls, found: list[Run]) -> Wrapper:
        return cls([[r.path, r.hash, r.size, 1, int(len(r.blocks) > 1)] for r in found], 1)

    def _index(self) -> None:
        self.places: dict[int, list[int]] = defaultdict(list)
        for i, node in enumerate(self.nodes):
            self.places[node[0]].append(i)

    def match(self, paths: tuple[int, ...]) -> list[int]:
        """The place of the node that each path is aligned with, or -1, on a longest common subsequence: a path that stands
        often can be its twin from the start, one beside it, or its twin from the end."""
        total, seen = Counter(paths), Counter()
        pairs: list[tuple[int, int]] = []
        for i, path in enumerate(paths):
            places, k = self.places.get(path, ()), seen[path]
            seen[path] += 1
            from_end = len(places) - (total[path] - k)
            pairs += [(places[j], i) for j in sorted({k - 1, k, k + 1, from_end}, reverse=True) if 0 <= j < len(places)]
        found = [-1] * len(paths)
        for place, i in _longest_rising(pairs):
            found[i] = place
        return found

    def aligned(self, paths: tuple[int, ...]) -> list[list[int] | None]:
        """The nodes that paths are aligned with."""
        if paths not in self.known:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[paths] = [self.nodes[k] if k >= 0 else None for k in self.match(paths)]
        return self.known[paths]

    def align(self, other: Wrapper) -> None:
        """Match all that other matches too."""
        paths = tuple(node[0] for node in other.nodes)
        nodes = self.aligned(paths)
        if None in nodes:  # what other alone has goes behind the last node that both have
            place = {id(node): i for i, node in enumerate(self.nodes)}
            news: dict[int, list[list[int]]] = defaultdict(list)
            before, grown = -1, []
            for node, path in zip(nodes, paths, strict=True):
                if node is None:
                    node = [path, -1, 0, 0, 0]
                    news[before].append(node)
                else:
                    before = place[id(node)]
                grown.append(node)
            self.nodes = [n for i in range(-1, len(self.nodes)) for n in ([self.nodes[i]] if i >= 0 else []) + news.get(i, [])]
            self._index()
            self.known[paths] = nodes = grown
        self.pages += other.pages
        for node, (_, h, size, seen, repeated) in zip(nodes, other.nodes, strict=True):
            node[1:] = h if node[1] in (-1, h) else 0, node[2] + size, node[3] + seen, node[4] | repeated

    def prune(self) -> None:
        """Leave out what is RARE, so that a wrapper has no more nodes than so many of its pages."""
        kept = [n for n in self.nodes if n[3] * RARE >= self.pages]
        if len(kept) < len(self.nodes):
            self.__init__(kept, self.pages)

    def row(self, host: str) -> dict:
        columns = list(zip(*self.nodes, strict=True)) or [()] * 5
        return {"host": host} | dict(zip(_NAMES, [*map(list, columns), self.pages], strict=True))

    @classmethod
    def from_row(cls, r: dict) -> Wrapper:
        return cls([list(n) for n in zip(*(r[c] for c in _NAMES[:-1]), strict=True)], r["pages"])


WRAPPER = "path array<long>, hash array<long>, size array<long>, seen array<long>, repeated array<long>, pages long"
_NAMES = [c.split()[0] for c in WRAPPER.split(", ")]
_SCHEMA = pa.schema([("host", pa.string()), *[(c, pa.list_(pa.int64())) for c in _NAMES[:-1]], ("pages", pa.int64())])


def _longest_rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs (place, i) with rising places; pairs of one i must come with falling places."""
    tails: list[int] = []
    last: list[int] = []
    before = [-1] * len(pairs)
    for n, (place, _) in enumerate(pairs):
        k = bisect_left(tails, place)
        before[n] = last[k - 1] if k else -1
        tails[k : k + 1], last[k : k + 1] = [place], [n]
    found, n = [], last[-1] if last else -1
    while n >= 0:
        found.append(pairs[n])
        n = before[n]
    return found[::-1]


def main_text(html: str | None, wrapper: Wrapper | None = None) -> str:
    """The main text of a page, read by its host's wrapper; without one, by the page's own evidence."""
    page = parsed(html or "")
    found = runs(page)
    nodes = wrapper.aligned(tuple(r.path for r in found)) if wrapper and wrapper.pages >= LEAST_PAGES else [None] * len(found)
    fixed = [bool(n and n[1] == r.hash and n[3] >= LEAST_PAGES) for n, r in zip(nodes, found, strict=True)]
    if all(fixed):  # copies of one page show nothing
        nodes, fixed = [None] * len(found), [False] * len(found)
    usual = {i for r, n, same in zip(found, nodes, fixed, strict=True) if same and 2 * n[3] > wrapper.pages for i in r.blocks}
    weight, size, constant = [0.0] * len(page.parents), [0] * len(page.parents), [False] * len(page.blocks)
    for run, node, same in zip(found, nodes, fixed, strict=True):
        for i in run.blocks:
            element, text, _ = page.blocks[i]
            weight[element] += 0 if same else node[2] / node[3] / len(run.blocks) if node else len(text)
            size[element] += len(text)
            constant[i] = same
    kids: dict[int, list[int]] = defaultdict(list)
    for i in range(len(page.parents) - 1, 0, -1):  # children come after their parents
        weight[page.parents[i]] += weight[i]
        size[page.parents[i]] += size[i]
        kids[page.parents[i]].append(i)
    marked: dict[int, list[int]] = defaultdict(list)
    inside = [False] * len(page.parents)
    for i in range(1, len(page.parents)):
        inside[i] = inside[page.parents[i]]
        if page.tags[i] in _ARTICLE and not inside[i]:
            inside[i] = True
            marked[page.paths[i]].append(i)
    best = max(marked.values(), key=lambda group: sum(size[i] for i in group), default=[])
    article = any(size[i] for i in best)
    region = best if article else _densest(page, weight, kids)
    within = [False] * len(page.parents)
    for i in region:
        within[i] = True
    for i in range(1, len(page.parents)):
        within[i] = within[i] or within[page.parents[i]]

    def own(i: int) -> bool:
        element, _, suspect = page.blocks[i]
        return within[element] and not (constant[i] and (suspect or (page.tags[element] not in _HEADINGS and (not article or i in usual))))

    return "\n".join(text for i, (_, text, _) in enumerate(page.blocks) if own(i))


def _densest(page: Page, weight: list[float], kids: dict[int, list[int]]) -> list[int]:
    """The elements of one path round most of the weight: the steps go down while one path has 60 % of the weight and is no leaf."""
    group = [0]
    while True:
        inside: dict[int, list[int]] = defaultdict(list)
        for i in group:
            for kid in kids.get(i, ()):
                inside[page.paths[kid]].append(kid)
        total = sum(weight[i] for g in inside.values() for i in g)
        own = sum(weight[i] for i in group) - total
        best = max(inside.values(), key=lambda g: sum(weight[i] for i in g), default=None)
        if best is None or page.tags[best[0]] in _LEAVES or own > 0.4 * total or sum(weight[i] for i in best) < 0.6 * total:
            return group
        group = best


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, WRAPPER) of every host of pages (host, html), from all its pages."""

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Wrapper] = {}  # no more hosts than the task has pages
        for batch in batches:
            for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                if found := runs(parsed(html or "")):
                    if host in held:
                        held[host].align(Wrapper.of(found))
                    else:
                        held[host] = Wrapper.of(found)
                    if len(held[host].nodes) > PARTIAL_NODES:
                        yield pa.RecordBatch.from_pylist([held.pop(host).row(host)], _SCHEMA)
        for first in range(0, len(held), 1_000):
            yield pa.RecordBatch.from_pylist([held[h].row(h) for h in list(held)[first : first + 1_000]], _SCHEMA)

    def merged(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (-r["pages"], r["path"], r["hash"]))
        whole = Wrapper.from_row(rows[0])
        for r in rows[1:]:
            whole.align(Wrapper.from_row(r))
        whole.prune()
        return pa.Table.from_pylist([whole.row(rows[0]["host"])], _SCHEMA)

    found = cut(pages.select("host", "html").mapInArrow(tidied(folded), f"host string, {WRAPPER}"), "wrappers")
    while True:
        counts = cut(found.groupBy("host").agg(F.count("*").alias("_c")), "counts")
        most = counts.agg(F.max("_c")).first()[0] or 0
        if most <= 1:
            return found
        dealt = found.join(few(counts, BROADCAST_HOSTS), "host").withColumn("_g", F.pmod(F.xxhash64("path", "hash", "pages"), F.ceil(F.col("_c") / MERGED)))
        found = cut(dealt.groupBy("host", "_g").applyInArrow(lambda t: merged(t.drop_columns(["_c", "_g"])), f"host string, {WRAPPER}"), "wrappers")


def extracted(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every row.

    Null and empty html, and pages without text of their own: empty text. A null or odd url belongs to the host ''. Repeated
    rows are extracted alike. An empty table gives none. Other columns are not read.
    """
    small_batches(pages.sparkSession)
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), host.alias("host"))
    found = cut(wrappers(rows), "wrappers")
    nodes = found.agg(F.sum(F.size("path"))).first()[0] or 0

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Wrapper | None] = {}
        for batch in batches:
            out = []
            for i, (h, page) in enumerate(zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True)):
                if h not in held:
                    if len(held) >= HELD_HOSTS:
                        held.clear()
                    row = {c: batch.column(c)[i].as_py() for c in _NAMES}
                    held[h] = Wrapper.from_row(row) if row["pages"] else None
                out.append(main_text(page, held[h]))
            yield pa.RecordBatch.from_pydict({"page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(out, pa.string())})

    wrapped = few(found, BROADCAST_HOSTS) if nodes <= MOST_NODES else found
    out = rows.join(wrapped, "host", "left").mapInArrow(tidied(texts), "page_id long, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op7_html_extraction(spark, sf_dir: str) -> DataFrame:
    """extracted() of all pages; its docstring tells what odd rows give."""
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))
