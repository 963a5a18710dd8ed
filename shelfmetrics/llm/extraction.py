"""Main text of web pages: structural blocks, then differencing against the pages with the nearest URLs of the host."""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import released, written

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp noembed noframes".split())
#: Elements that end a line of text.
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements whose text is never an article's.
_NEVER = frozenset("script style noscript template head title svg math canvas iframe object embed audio video textarea select option button datalist noembed noframes xmp".split())
#: Elements that hold what surrounds an article.
_AROUND = frozenset("nav footer aside form menu dialog search".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
#: Words of class and id names by which pages mark what isn't the article.
_MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs header masthead topbar footer "
    "bottombar sidebar aside widget widgets related recommended comments comment respond replies cookie cookies consent notice notices gdpr popup modal overlay newsletter subscribe "
    "subscription signup login share sharing social toolbar pagination pager skip copyright disclaimer".split()
)
#: Elements whose lines are an article's running text; what stands in an article otherwise may be a template's.
_RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th caption figcaption".split())
_REPLIES = frozenset("comment comments reply replies related recommended sponsored".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME_WORDS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

_LINES = "page_id long, host string, path string, hashes array<long>"
_SHARED = "page_id long, shared array<int>"
_TEXT = "page_id long, url string, text string, n_chars long, n_structure long, n_shared long"


@dataclass
class Line:
    text: str
    inside: bool  # in an article or main element
    around: bool  # in an element, or under a name, that marks what surrounds an article
    running: bool  # in a paragraph, heading, list, quotation or table cell


def _marked(tag: str, attributes: str, in_article: bool) -> tuple[bool, bool]:
    """Whether an element holds what surrounds an article, and whether it is hidden."""
    around, hidden = tag in _AROUND or tag == "header" and not in_article, False
    if attributes.strip():
        for name, *values in _ATTRIBUTE.findall(attributes):
            value = html.unescape("".join(values))
            name = name.lower()
            if name in ("class", "id") and tag not in ("html", "body", "main"):
                # an article's own name says little but for comments, and a header in an article is its heading
                marks = _REPLIES if tag == "article" else _MARKS - {"header"} if in_article else _MARKS
                around |= not marks.isdisjoint(w for x in value.split() for w in _NAME_WORDS.findall(_CAMEL.sub("-", x).lower()))
            elif name == "role":
                around |= value.strip().lower() in _ROLES
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
                hidden = True
    return around, hidden


def lines_of(page: str | None) -> list[Line]:
    """The page's blocks of text in order, with white space made single; markup, scripts and styles are gone.

    Unclosed tags, stray ends and broken tags are borne as browsers do: an end tag closes the nearest open element of
    its name, and paragraphs, list items and cells close their forerunners. A ``<`` that opens no tag is text.
    """
    page = page or ""
    out: list[Line] = []
    # open elements: tag, article depth, surrounding depth, unseen depth, running depth
    stack: list[tuple[str, int, int, int, int]] = [("", 0, 0, 0, 0)]
    is_open: Counter[str] = Counter()
    buffer: list[str] = []

    def flush() -> None:
        if buffer:
            # decoded only now, so that a reference next to a tag is whole
            text = " ".join(html.unescape("".join(buffer)).split())
            buffer.clear()
            if text and not stack[-1][3]:
                out.append(Line(text, stack[-1][1] > 0, stack[-1][2] > 0, stack[-1][4] > 0))

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            buffer.append(page[at:])
            break
        if m.start() > at:
            buffer.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if page[at - 1] != ">":
            # a quotation mark without its fellow: the tag ends at the next end of one
            at = page.find(">", at) + 1 or n
        if m[1]:
            if is_open[tag]:
                # what is searched through is closed, so each element is seen once
                depth = next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag)
                if any(s[0] in _BLOCK or s[2:4] != stack[depth - 1][2:4] for s in stack[depth:]):
                    flush()
                is_open.subtract(s[0] for s in stack[depth:])
                del stack[depth:]
            elif tag in _BLOCK:
                flush()
            continue
        if tag == "br":
            buffer.append(" ")
            continue
        if tag in _BLOCK or tag in _NEVER:
            flush()
        if tag in _VOID:
            continue
        if tag in _BLOCK and stack[-1][0] == "p" or tag in _CLOSED_BY and stack[-1][0] in _CLOSED_BY[tag]:
            is_open[stack.pop()[0]] -= 1
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if m[3].rstrip().endswith("/") and tag not in _BLOCK:
            continue
        _, inside, around, unseen, running = stack[-1]
        is_around, hidden = _marked(tag, m[3], inside > 0)
        if is_around or hidden:
            flush()
        stack.append((tag, inside + (tag in ("article", "main")), around + is_around, unseen + (hidden or tag in _NEVER), running + (tag in _RUNNING)))
        is_open[tag] += 1
    flush()
    return out


def shared_lines(a: list[int], b: list[int], most_bits: int = 1 << 26) -> list[int]:
    """The places in ``a`` of a longest common subsequence with ``b``.

    Lines that the other page lacks, and common ends, are cut off first. The rest takes |a| * |b| / 64 steps of bit-parallel
    rows. Up to ``most_bits`` the rows are kept and traced back; beyond, ``a`` is cut in half, and ``b`` where the halves' sequences are longest together.
    """
    common = set(a) & set(b)
    places = [k for k, v in enumerate(a) if v in common]
    x, y = [a[k] for k in places], [v for v in b if v in common]
    head = 0
    while head < min(len(x), len(y)) and x[head] == y[head]:
        head += 1
    tail = 0
    while tail < min(len(x), len(y)) - head and x[-1 - tail] == y[-1 - tail]:
        tail += 1
    found, todo = [*range(head), *range(len(x) - tail, len(x))], [(head, len(x) - tail, head, len(y) - tail)]
    while todo:
        i, j, p, q = todo.pop()
        if i == j or p == q:
            continue
        if j - i == 1 or (j - i) * (q - p) <= most_bits:
            found += [i + k for k in _traced(x[i:j], y[p:q])]
            continue
        mid = (i + j) // 2
        before, after = _lengths(x[i:mid], y[p:q]), _lengths(x[mid:j][::-1], y[p:q][::-1])
        cut = p + int((before + after[::-1]).argmax())
        todo += [(i, mid, p, cut), (mid, j, cut, q)]
    return [places[k] for k in sorted(found)]


def _places(y: list[int]) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for k, v in enumerate(y):
        out.setdefault(v, []).append(k)
    return out


def _rows(x: list[int], y: list[int]) -> Iterator[int]:
    """For each line of x a row of bits: a zero bit k says that the sequence of x up to it gets longer at y[k]."""
    places, masks = _places(y), {}
    full = (1 << len(y)) - 1
    row = full
    for v in x:
        if v not in masks and len(places.get(v, ())) > 1:
            masks[v] = sum(1 << k for k in places[v])
        step = row & (masks[v] if v in masks else 1 << places[v][0] if v in places else 0)
        row = ((row + step) | (row - step)) & full
        yield row


def _lengths(x: list[int], y: list[int]) -> np.ndarray:
    """The length of a longest common subsequence of x with each beginning of y."""
    row = deque(_rows(x, y), 1).pop()
    bits = np.unpackbits(np.frombuffer(row.to_bytes(-(-len(y) // 8), "little"), np.uint8), bitorder="little")[: len(y)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _traced(x: list[int], y: list[int]) -> list[int]:
    """The places in x of the sequence, by keeping all rows."""
    rows = [(1 << len(y)) - 1, *_rows(x, y)]
    places = _places(y)
    found, j = [], len(y)
    length = lambda row, upto: upto - (row & (1 << upto) - 1).bit_count()
    for i in range(len(x) - 1, -1, -1):
        if length(rows[i], j) < length(rows[i + 1], j):
            # the last place that still leaves a sequence one shorter before it
            j = places[x[i]][bisect_left(places[x[i]], j) - 1]
            found.append(i)
    return found


def main_text(lines: list[Line], shared: set[int]) -> tuple[str, int, int]:
    """The article's lines, and how many others structure and differencing have deleted.

    Lines of surrounding elements go. Where the page has an article element, lines outside of it go, and in it those shared lines
    that are not running text: pages of a host repeat sentences and whole articles in paragraphs, which are text all the same. Elsewhere, all shared
    lines go. Differencing that leaves nothing, as for two copies of a page, deletes nothing.
    """
    kept = [k for k, x in enumerate(lines) if not x.around]
    if any(lines[k].inside for k in kept):
        kept = [k for k in kept if lines[k].inside]
        own = [k for k in kept if lines[k].running or k not in shared]
    else:
        own = [k for k in kept if k not in shared]
    own = own or kept
    return "\n".join(lines[k].text for k in own), len(lines) - len(kept), len(kept) - len(own)


def _hash(text: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _hash_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes = [[_hash(x.text) for x in lines_of(p)] for p in batch.column(3).to_pylist()]
        yield pa.record_batch([*batch.columns[:3], pa.array(hashes, pa.list_(pa.int64()))], names=["page_id", "host", "path", "hashes"])


def _difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, hashes, before, after = (c.to_pylist() for c in batch.columns)
        shared = [sorted({k for other in (b, c) if other for k in shared_lines(h or [], other)}) for h, b, c in zip(hashes, before, after, strict=True)]
        yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(shared, pa.list_(pa.int32()))], names=["page_id", "shared"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, urls, pages, shared = (c.to_pylist() for c in batch.columns)
        found, structure, differencing = zip(*(main_text(lines_of(p), set(s or ())) for p, s in zip(pages, shared, strict=True)), strict=True) if ids else ([], [], [])
        texts = [t.encode("utf-8", "replace").decode() for t in found]
        columns = ((ids, pa.int64()), (urls, pa.string()), (texts, pa.string()), ([len(t) for t in texts], pa.int64()), (structure, pa.int64()), (differencing, pa.int64()))
        yield pa.record_batch([pa.array(c, k) for c, k in columns], names=[x.split()[0] for x in _TEXT.split(", ")])


def extract_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """The main text of every page.

    Pages are sorted by host and URL path, and each is paired with the pages just before and after it on its host.
    Their lines of text are aligned by longest common subsequence; what a page shares with either neighbour is
    template, and goes. Pages without lines are nobody's neighbours. Structure decides what differencing can't: see ``main_text``.

    Neighbours are found on line hashes alone, by range partitions of (host, path): a host's size doesn't matter. The
    first and last rows of each range partition, two a partition, give its neighbours across partitions.

    Returns page_id, url, text (lines joined by a newline; empty if none), n_chars (code points), n_structure and n_shared (lines
    that structure and differencing have deleted). Null or empty html: an
    empty text. Null URL: host and path are empty. Equal URLs are ordered by page_id and pair like others. Null ids and
    repeated ids: rows with an equal id must be equal pages, else either's decisions may serve both; a page with a null id
    is not compared. No rows: no rows. Extra columns are ignored.
    """
    address = F.coalesce(F.col(url), F.lit(""))
    host = F.lower(F.regexp_extract(address, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    path = F.regexp_extract(address, r"^(?:(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*)?([^?#]*)", 1)
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), host.alias("host"), path.alias("path"), F.col(page).alias("html"), F.col(url).alias("url"))
    order = ["host", "path", "page_id"]
    parts = max(1, int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    light = rows.select("page_id", "host", "path", "html").mapInArrow(released(_hash_lines), _LINES).where(F.size("hashes") > 0).dropDuplicates(["page_id"])
    ranged = light.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    sorted_pages = written(ranged.withColumn("_at", F.monotonically_increasing_id()), "page-lines").withColumn("_part", F.shiftright("_at", 33))

    inside = Window.partitionBy("_part").orderBy("_at")
    row = F.struct("host", "hashes")
    paired = sorted_pages.select("page_id", "host", "hashes", "_part", "_at", F.lag(row).over(inside).alias("_before"), F.lead(row).over(inside).alias("_after"))
    # the outer neighbours of each partition: one row for each
    edges = sorted_pages.groupBy("_part").agg(F.min_by(row, "_at").alias("_first"), F.max_by(row, "_at").alias("_last"))
    along = Window.orderBy("_part")
    outer = edges.select("_part", F.lag("_last").over(along).alias("_outer_before"), F.lead("_first").over(along).alias("_outer_after"))
    joined = paired.join(outer, "_part")
    before, after = F.coalesce("_before", "_outer_before"), F.coalesce("_after", "_outer_after")
    near = joined.select(
        "page_id", "hashes", F.when(before["host"] == F.col("host"), before["hashes"]).alias("before"), F.when(after["host"] == F.col("host"), after["hashes"]).alias("after")
    )
    shared = near.mapInArrow(released(_difference), _SHARED)
    decided = rows.join(shared, "page_id", "left").select("page_id", "url", "html", "shared")
    return decided.mapInArrow(released(_extract), _TEXT)
