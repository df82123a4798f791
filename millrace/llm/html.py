"""Main text of web pages by nearest-url page differencing.

Pages are sorted by host, path and id; each is paired with the neighbour on its host whose path has more
in common with its own. The text lines of the two are aligned by longest common subsequence, and lines
that they share are template and go. Differencing alone cannot tell a menu whose entries change from page
to page, nor a page whose neighbour is a copy of its article. So markup has a say: lines in elements that
are furniture by tag, role or class go as well, and where an article or main element holds most of the
remaining text, its lines stay and the others go. Alignment decides the pages without such an element.

The sort moves keys only. Sorted partitions find neighbours by themselves; the first and last keys of the
partitions, two rows per partition, are stitched on the driver. Pairs then exchange line digests, not texts.

Defined cases: null or empty html gives an empty text; a null url or one without ``://`` has an empty host
and is paired like any other. Rows that are equal in id, url and html get equal results. A page that is
alone on its host is not differenced. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.scratch import write_table
from millrace.llm.urls import host_of, path_of

_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*+)")
_TO_END = re.compile(r"(?:[^>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+>")  # a quote counts after an equals sign only
_RAW = {t: re.compile(rf"</{t}(?![^\s/>])[^>]*+>?", re.I) for t in "script style noscript template svg iframe textarea select title".split()}
_INLINE = frozenset("a abbr acronym area audio b bdi bdo big canvas cite code data del dfn em embed font i img input ins kbd label map mark meter object output picture progress q rp rt ruby s samp small source span strike strong sub sup time tt u var video wbr".split())
_CONTAINER = frozenset("address article aside blockquote body button center dd details dialog div dl dt fieldset figure footer form head header html li main menu nav ol section table tbody td tfoot th thead tr ul".split())
_FURNITURE = frozenset("nav footer aside form head menu dialog fieldset button".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
_NEXT_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr",)}
_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
_CLASS = frozenset(
    "nav navbar menu menubar aside footer masthead ad ads adv banner alert notice notices modal overlay related recommended share sharing social reply replies respond "
    "subscribe subscription signup login pager widget toolbar search skip".split()
)
_CLASS_START = ("advert", "breadcrumb", "comment", "consent", "cookie", "disqus", "gdpr", "navigation", "newsletter", "pagination", "popup", "promo", "sidebar", "sponsor")
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
_BLANK = re.compile(r"\s+")

MAIN, FURNITURE, FREE = 0, 1, 2
Line = tuple[str, int, float]  # text, zone, share of the text that is inside links


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes): kind is text, cdata, open or close. One pass: no character is scanned more than a few times, whatever the page."""
    start = seek = 0
    last, quoted = page.rfind(">"), True
    while (lt := page.find("<", seek)) >= 0:
        after = page[lt + 1 : lt + 2]
        if after in ("!", "?"):
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                end = len(page) if end < 0 else end + 3
            elif page.startswith("<![CDATA[", lt):
                end = page.find("]]>", lt)
                yield "text", page[start:lt], ""
                yield "cdata", page[lt + 9 : end if end >= 0 else len(page)], ""
                start = end = len(page) if end < 0 else end + 3
            else:
                end = page.find(">", lt)
                end = len(page) if end < 0 else end + 1
            if lt > start:
                yield "text", page[start:lt], ""
            start = seek = end
            continue
        name = _NAME.match(page, lt) if lt < last else None
        if not name:
            if lt >= last:
                break  # no tag ends after this
            seek = lt + 1
            continue
        found = _TO_END.match(page, name.end()) if quoted else None
        quoted = found is not None  # after a quote that never ends, quotes aren't believed any more
        end = found.end() if found else page.index(">", name.end()) + 1
        if lt > start:
            yield "text", page[start:lt], ""
        tag = name[1].lower()
        if page[lt + 1] == "/":
            yield "close", tag, ""
        elif tag in _RAW and page[end - 2] != "/":
            stop = _RAW[tag].search(page, end)
            end = stop.end() if stop else len(page)
        else:
            yield "open", tag, page[name.end() : end - 1]
        start = seek = end
    if start < len(page):
        yield "text", page[start:], ""


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in _ATTRIBUTE.finditer(text)} if text.strip(" /") else {}


def _marked(attrs: dict[str, str]) -> bool:
    """Furniture by attributes."""
    if not attrs:
        return False
    words = re.split(r"[^a-z0-9]+", f"{attrs.get('class', '')} {attrs.get('id', '')}")
    hidden = "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "")
    return hidden or attrs.get("role") in _ROLE or any(w in _CLASS or w.startswith(_CLASS_START) for w in words if w)


@dataclass(slots=True)
class _Element:
    parent: int
    tag: str
    by_tag: bool
    by_mark: bool
    header: bool
    main: bool
    first: int  # its lines are [first, stop)
    stop: int = -1
    cut: int = -1  # first line after a paragraph that opens in it; where it never ends, it is taken to end there
    size: int = 0


def _parsed(page: str) -> tuple[list[tuple[str, bool, bool, float]], list[_Element]]:
    """Lines (text, in a marked paragraph, heading, link share) and elements in page order."""
    lines: list[tuple[str, bool, bool, float]] = []
    elements = [_Element(-1, "", False, False, False, False, 0)]
    stack, parts, linked, link, marked, heading = [0], [], 0, False, False, False
    opened: Counter[str] = Counter()

    def end_line() -> None:
        nonlocal parts, linked
        text = _BLANK.sub(" ", "".join(parts)).strip()
        if text:
            lines.append((text, marked, heading, min(1.0, linked / len(text))))
        parts, linked = [], 0

    def pop(closed: bool) -> None:
        e = elements[stack.pop()]
        opened[e.tag] -= 1
        e.stop = len(lines) if closed or e.cut < 0 else e.cut

    for kind, name, more in tokens(page):
        if kind in ("text", "cdata"):
            text = entities.unescape(name) if kind == "text" and "&" in name else name
            parts.append(text)
            if link:
                linked += len(text)
            continue
        closing = kind == "close"
        if name == "a":
            link = not closing
        if name in _INLINE:
            continue
        end_line()
        if name == "br":  # a new line of the same paragraph
            continue
        link, marked, heading = link and name != "body", False, False
        if closing:
            if opened[name] > 0:
                while elements[stack[-1]].tag != name:
                    pop(elements[stack[-1]].tag in _NEXT_ENDS)
                pop(True)
            continue
        attrs = _attributes(more)
        if name in _CONTAINER:
            if more.endswith("/"):
                continue
            if elements[stack[-1]].tag in _NEXT_ENDS.get(name, ()):
                pop(True)
            main = name in ("article", "main") or attrs.get("role") in ("main", "article") or attrs.get("itemprop") == "articlebody"
            words = re.split(r"[^a-z0-9]+", f"{attrs.get('class', '')} {attrs.get('id', '')}") if attrs else []
            if main:
                _paragraph(elements[stack[-1]], len(lines))
            elements.append(_Element(stack[-1], name, name in _FURNITURE, name not in ("html", "body") and _marked(attrs), name == "header" or "header" in words, main, len(lines)))
            stack.append(len(elements) - 1)
            opened[name] += 1
        else:
            marked, heading = _marked(attrs), name in _HEADING
            if name == "p" or heading:
                _paragraph(elements[stack[-1]], len(lines))
    end_line()
    while stack:
        pop(elements[stack[-1]].tag in ("", "html", "body"))
    return lines, elements


def _paragraph(e: _Element, at: int) -> None:
    if e.cut < 0 and at > e.first:
        e.cut = at


def page_lines(page: str) -> list[Line]:
    """Text lines in page order with their zones.

    Furniture is an element by its tag, or one marked by class, id or role, unless it holds the page's main
    element or half of its text; in a header only headings stay, and only inside the main element. The main
    element is the largest article or main element; others count as well from a quarter of its size on. A
    furniture element that never ends is taken to end at the first paragraph after its first line.
    """
    lines, elements = _parsed(page)
    before = [0]
    for text, *_ in lines:
        before.append(before[-1] + len(text))
    within = [0] * len(elements)  # the line at which the last furniture element around an element ends
    for k, e in enumerate(elements):
        e.size = before[e.stop] - before[e.first]
        if k:
            around = elements[e.parent]
            within[k] = max(within[e.parent], around.stop if around.by_tag else 0)
    mains = [k for k, e in enumerate(elements) if e.main and e.size and within[k] <= e.first]
    largest = lambda among: max(among, key=lambda k: elements[k].size, default=None)
    best = largest([k for k in mains if not elements[k].by_mark] or mains)
    inside = lambda k: k > best and elements[best].first <= elements[k].first and elements[k].stop <= elements[best].stop
    if best is not None:  # an article inside a main element is the closer one, where it has most of the text; those that do are nested
        best = max([k for k in mains if inside(k) and not elements[k].by_mark and 2 * elements[k].size >= elements[best].size], default=best)
    spared, k = set(), -1 if best is None else best
    while k >= 0:
        spared.add(k)
        k = elements[k].parent
    whole = {k for k in mains if k == best or (4 * elements[k].size >= elements[best].size and not inside(k) and k not in spared)}
    furniture, headers, main = ([0] * (len(lines) + 1) for _ in range(3))  # of each line: how many such elements hold it, as steps
    for k, e in enumerate(elements):
        for steps, holds in ((furniture, e.by_tag or (e.by_mark and k not in spared and 2 * e.size < before[-1])), (headers, e.header and k not in spared), (main, k in whole)):
            if holds:
                steps[e.first] += 1
                steps[e.stop] -= 1
    out: list[Line] = []
    f = h = m = 0
    for i, (text, marked, heading, links) in enumerate(lines):
        f, h, m = f + furniture[i], h + headers[i], m + main[i]
        zone = FURNITURE if marked or f or (h and not (m and heading)) else MAIN if m else FREE
        out.append((text, zone, links))
    return out


def _row_lengths(a: list[int], b: list[int]) -> list[int]:
    """Length of the longest common subsequence of a and every prefix of b, by bit-parallel rows."""
    where: dict[int, int] = defaultdict(int)
    for j, y in enumerate(b):
        where[y] |= 1 << j
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
    out = [0]
    for j in range(len(b)):
        out.append(out[-1] + (not v >> j & 1))
    return out


def common_lines(a: list[int], b: list[int], dense: int = 200_000) -> set[int]:
    """Indices of a's lines in a longest common subsequence of a and b."""
    start, stop_a, stop_b = 0, len(a), len(b)
    while start < min(stop_a, stop_b) and a[start] == b[start]:
        start += 1
    while stop_a > start and stop_b > start and a[stop_a - 1] == b[stop_b - 1]:
        stop_a, stop_b = stop_a - 1, stop_b - 1
    found = set(range(start)) | set(range(stop_a, len(a)))
    a, b, shift = a[start:stop_a], b[start:stop_b], start
    where: dict[int, list[int]] = defaultdict(list)
    for j in range(len(b) - 1, -1, -1):
        where[b[j]].append(j)
    matches = sum(len(where.get(x, ())) for x in a)
    if not matches:
        return found
    if matches > dense and len(a) > 1:  # many repeated lines: halve a, and split b where the halves match most
        half = len(a) // 2
        left, right = _row_lengths(a[:half], b), _row_lengths(a[half:][::-1], b[::-1])[::-1]
        cut = max(range(len(b) + 1), key=lambda j: left[j] + right[j])
        return found | {i + shift for i in common_lines(a[:half], b[:cut], dense)} | {i + half + shift for i in common_lines(a[half:], b[cut:], dense)}
    ends: list[int] = []  # least end in b of a subsequence of each length, with a chain of matched lines
    chains: list[tuple | None] = []
    for i, x in enumerate(a):
        for j in where.get(x, ()):
            k = bisect_left(ends, j)
            chain = (i, chains[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                chains.append(chain)
            elif j < ends[k]:
                ends[k] = j
                chains[k] = chain
    chain = chains[-1]
    while chain:
        found.add(chain[0] + shift)
        chain = chain[1]
    return found


def settled(lines: list[Line]) -> bool:
    """Whether the main element holds most of the text that is not furniture."""
    size = {z: sum(len(t) for t, zone, _ in lines if zone == z) for z in (MAIN, FREE)}
    return size[MAIN] > 0 and size[MAIN] >= size[FREE]


def main_text(lines: list[Line], shared: set[int]) -> str:
    """The main element's lines where it settles the page; otherwise what neither furniture, nor a shared line, nor a list of links is."""
    if settled(lines):
        return "\n".join(t for t, zone, _ in lines if zone == MAIN)
    free = [(i, t) for i, (t, zone, links) in enumerate(lines) if zone != FURNITURE and links < 0.7]
    kept = [t for i, t in free if i not in shared]
    if 5 * sum(map(len, kept)) < sum(len(t) for _, t in free) and not any(len(t) > 80 for t in kept):
        kept = [t for _, t in free]  # the neighbour is a copy: what they share is the article
    return "\n".join(kept)


def _keyed(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """page_id as text (pandas would turn longs with nulls into doubles), url, html, and a key that equal rows share."""
    url, text = F.col(url_col).cast("string"), F.col(html_col).cast("string")
    page = F.col(id_col).cast("string")
    key = F.concat_ws("|", F.coalesce(page, F.lit("-")), F.coalesce(F.hex(F.xxhash64(url)), F.lit("-")), F.coalesce(F.hex(F.xxhash64(text)), F.lit("-")))
    return pages.select(page.alias("page_id"), url.alias("url"), text.alias("html"), key.alias("key"))


def neighbours(keys: DataFrame) -> DataFrame:
    """keys: host, path, key; one row per key. Gives (key, n_key): the partner's key, null for a page alone on its host."""
    order = ["host", "path", "key"]

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, before, held = TaskContext.get().partitionId(), None, None
        # held: the row before, not yet given out because its follower was unknown
        for b in batches:
            out = []
            for row in b[order].itertuples(index=False, name=None):
                if held is not None:
                    out.append(_choose(before, held, row))
                    before = held
                held = row
            if out:
                yield _frame(out, part)
        if held is not None:
            yield _frame([_choose(before, held, None)], part)

    def _choose(before, row, after):
        near = [(_common(x[1], row[1]), x is before, x[2]) for x in (before, after) if x is not None and x[0] == row[0]]
        common, earlier, key = max(near, key=lambda x: x[:2], default=(-1, False, None))
        return (*row, key, common, earlier, before is None, after is None)

    def _frame(rows, part):
        return pd.DataFrame(rows, columns=[*order, "n_key", "common", "earlier", "first", "last"]).assign(part=part)

    schema = "host string, path string, key string, n_key string, common int, earlier boolean, first boolean, last boolean, part int"
    linked = keys.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(link, schema)
    linked = write_table(linked, "neighbours")
    ends = linked.where("first or last").orderBy("part", F.desc("first")).collect()  # two rows a partition
    better: dict[str, tuple] = {}
    for x, y in zip(ends, ends[1:], strict=False):
        if x["part"] != y["part"] and x["host"] == y["host"]:
            for row, other, earlier in ((x, y, False), (y, x, True)):
                had = better.get(row["key"], (row["common"], row["earlier"], None))
                better[row["key"]] = max(had, (_common(other["path"], row["path"]), earlier, other["key"]), key=lambda z: z[:2])
    stitched = [(x["key"], better.get(x["key"], (0, False, None))[2] or x["n_key"]) for x in ends]
    inner = linked.where("not (first or last)").select("key", "n_key")
    return inner.unionByName(keys.sparkSession.createDataFrame(stitched, "key string, n_key string")) if stitched else inner


def _common(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def shared_lines(keyed: DataFrame) -> DataFrame:
    """key and ``shared``: indices of lines that the page shares with its neighbour, where that can matter: an article's lines stay."""

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parsed = [page_lines(x or "") for x in b["html"]]
            b["lines"] = [[xxhash.xxh64_intdigest(t) - (1 << 63) for t, _, _ in lines] for lines in parsed]
            b["settled"] = [settled(lines) for lines in parsed]
            yield b[["host", "path", "key", "settled", "lines"]]

    rows = keyed.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "key", "html")
    lines = write_table(rows.mapInPandas(digest, "host string, path string, key string, settled boolean, lines array<long>").dropDuplicates(["key"]), "lines")
    pairs = neighbours(lines.drop("lines", "settled")).where("n_key is not null")
    both = pairs.join(lines.where("not settled").select("key", "lines"), "key").join(lines.select(F.col("key").alias("n_key"), F.col("lines").alias("n_lines")), "n_key")

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["shared"] = [sorted(common_lines(x.tolist(), y.tolist())) for x, y in zip(b["lines"], b["n_lines"], strict=True)]
            yield b[["key", "shared"]]

    return both.select("key", "lines", "n_lines").mapInPandas(align, "key string, shared array<int>").where("size(shared) > 0")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every page."""
    keyed = _keyed(pages, id_col, url_col, html_col)
    rows = keyed.join(write_table(shared_lines(keyed), "shared"), "key", "left").select("page_id", "url", "html", "shared")

    def text_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            shared = [set() if s is None else set(s.tolist()) for s in b["shared"]]
            text = [main_text(page_lines(x or ""), s) for x, s in zip(b["html"], shared, strict=True)]
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": text, "n_chars": [len(t) for t in text]})

    out = rows.mapInPandas(text_of, "page_id string, url string, text string, n_chars long")
    return out.withColumn("page_id", F.col("page_id").cast("long"))
