"""The main text of web pages: lines that a page shares with its nearest neighbour of the host are its frame.

1. ``page_lines`` reads a page once: blocks become lines, in order, each in the page's article, outside of it, or open
   (where a page names no article). Scripts, styles, comments of the markup and hidden elements give no line.
2. Pages of a host stand in the order of their paths (range partitions and their totals, so a host with a third of all
   pages is no task of its own). Of the page before and the page after, the one with the longer common path is the
   nearest; the earlier one on a tie. Pages of a host with the same lines outside the article count once.
3. The lines of both are aligned by a longest common subsequence (bit-parallel, in linear memory), and those that both
   have are deleted, wherever the page doesn't itself say that they are its article: copies and shared passages of
   articles are text, not frame.
4. What no neighbour shares, but is marked as frame, goes too: elements such as nav, footer, aside and form, roles, and
   classes or ids with the words below.

An open line stays where the neighbour shares it if that neighbour is a copy rather than a page of the same frame: it has
more than four fifths of the page's open text. Then the other neighbour is asked; where both are copies nothing is deleted.

Nulls and odd rows: a null or empty page has the empty text; a page without a host is compared with none; rows that repeat
a page get the same text, ids aren't read; an unclosed element ends with the one around it; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from html import unescape
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, with_running_totals, written

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(?P<raw>script|style|title|noscript|template|iframe|svg|textarea)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<[!?][^>]*>"""
    r"""|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<attributes>(?:[^>"']|"[^"]{0,20000}"|'[^']{0,20000}'){0,4000}+)>|<(?P<end2>/?)(?P<tag2>[a-z][^\s/>]*)(?P<attributes2>[^>]*)>""",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

BLOCKS = set(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu"
    " nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: An open element of the second kind ends where one of the first begins.
CLOSES = {t: {"p"} for t in BLOCKS - {"button", "td", "th", "body", "html"}} | {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
#: Elements and roles that are frame wherever they stand; then words of classes and ids. Those of the layout don't count
#: where an article begins inside of them.
FRAME = set("nav footer aside form button select option dialog menu search".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
LAYOUT = set("nav navbar navigation menu menubar topbar toolbar header masthead footer colophon sidebar side rail aside widget widgets banner form search modal overlay popup".split())
NEVER = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification alert newsletter subscribe subscription signup signin login register"
    " paywall breadcrumb breadcrumbs pagination pager copyright related recommended recommendations trending share sharing social comment comments commentlist disqus reply replies respond skip".split()
)
CONTENT = set("content article post entry story main articlebody prose".split())

MAIN, OPEN, MARKED = 0, 1, 2


class _Element:
    __slots__ = ("tag", "frame", "soft", "region", "inline")

    def __init__(self, tag: str, frame: bool, soft: bool, region: int, inline: bool):
        self.tag, self.frame, self.soft, self.region, self.inline = tag, frame, soft, region, inline


def _kind_of(tag: str, attributes: str, in_article: bool) -> tuple[bool, bool, int]:
    """(frame, only by a word of the layout, 2: article, 1: perhaps, 0: neither)."""
    given = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)} if attributes.strip(" /") else {}
    names = {x.lower() for k in ("class", "id") if k in given for x in _NAME.findall(given[k])}
    role = given.get("role", "").lower()
    hidden = "hidden" in given or given.get("aria-hidden", "").lower() == "true" or bool(_HIDDEN.search(given.get("style", "")))
    if tag in ("html", "body"):
        return False, False, 0
    if tag in FRAME or role in ROLES or hidden or names & NEVER:
        return True, False, 0
    article = tag in ("article", "main") or role in ("article", "main") or given.get("itemprop", "").lower() == "articlebody"
    if article:
        return False, False, 2
    if (tag == "header" or names & LAYOUT) and not in_article:
        return True, True, 0
    return False, False, 1 if names & CONTENT else 0


def page_lines(html: str) -> list[tuple[str, int]]:
    """(text, MAIN, OPEN or MARKED) of every block of a page that has text, in order."""
    lines: list[tuple[str, tuple[_Element, ...], bool]] = []  # text, open elements, whether all of it is links in a list
    stack: list[_Element] = []
    buffer: list[str] = []
    linked = unlinked = 0
    links = 0

    def flush() -> None:
        nonlocal linked, unlinked
        if buffer:
            text = " ".join("".join(buffer).split())
            if text:
                listed = any(e.tag == "li" for e in stack)
                lines.append((text, tuple(stack), bool(linked and not unlinked and listed)))
            buffer.clear()
        linked = unlinked = 0

    def text(raw: str) -> None:
        nonlocal linked, unlinked
        if raw:
            buffer.append(unescape(raw) if "&" in raw else raw)
            if raw.strip():
                linked, unlinked = (linked + 1, unlinked) if links else (linked, unlinked + 1)

    at = 0
    for m in _TOKEN.finditer(html):
        text(html[at : m.start()])
        at = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        if tag == "br":
            buffer.append(" ")
        elif m["end"] or m["end2"]:
            if tag == "a":
                links = max(0, links - 1)
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k].tag == tag), -1)
            if k >= 0 and not (stack[k].inline and any(not e.inline for e in stack[k + 1 :])):
                flush()
                del stack[k:]
            elif tag in BLOCKS:
                flush()
        elif tag in BLOCKS:
            flush()
            ends = CLOSES.get(tag, ())
            while stack and (stack[-1].tag in ends or stack[-1].inline):
                stack.pop()
            if tag not in VOID:
                frame, soft, region = _kind_of(tag, m["attributes"] or m["attributes2"] or "", any(e.region == 2 for e in stack))
                if region == 2:
                    for e in stack:
                        if e.soft or e.tag == "form":
                            e.frame = False
                stack.append(_Element(tag, frame, soft, region, False))
        elif tag not in VOID:
            if tag == "a":
                links += 1
            attributes = m["attributes"] or m["attributes2"] or ""
            if attributes.strip(" /") and tag != "a":
                frame, soft, _ = _kind_of(tag, attributes, True)
                if frame:
                    flush()
                    stack.append(_Element(tag, True, soft, 0, True))
    text(html[at:])
    flush()

    def region_of(around: tuple[_Element, ...]) -> int:
        return -1 if any(e.frame for e in around) else max((e.region for e in around), default=0)

    regions = [region_of(around) for _, around, _ in lines]
    best = max(regions, default=0)
    if best == 2:
        return [(t, MAIN if r == 2 else MARKED) for (t, _, _), r in zip(lines, regions, strict=True)]
    kinds = [OPEN if r == best and not listed else MARKED for (_, _, listed), r in zip(lines, regions, strict=True)] if best >= 0 else []
    if OPEN not in kinds:  # words of the layout were all there was
        kinds = [MARKED if any(e.frame and not e.soft for e in around) else OPEN for _, around, _ in lines]
    return [(t, k) for (t, _, _), k in zip(lines, kinds, strict=True)]


def _prefix_lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Lengths of the longest common subsequences of ``a`` and each prefix of ``b``."""
    places: dict[int, int] = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    ones = (1 << len(b)) - 1
    v = ones
    for x in a:
        if u := v & places.get(x, 0):
            v = ((v + u) | (v - u)) & ones
    bits = np.unpackbits(np.frombuffer(v.to_bytes((len(b) + 7) // 8 or 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Places in ``a`` of a longest common subsequence of ``a`` and ``b``."""
    found: list[int] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, k, j, n = todo.pop()
        while i < k and j < n and a[i] == b[j]:
            found.append(i)
            i, j = i + 1, j + 1
        while i < k and j < n and a[k - 1] == b[n - 1]:
            k, n = k - 1, n - 1
            found.append(k)
        if i == k or j == n:
            continue
        if k - i == 1:
            if a[i] in b[j:n]:
                found.append(i)
            continue
        middle = (i + k) // 2
        before = _prefix_lengths(a[i:middle], b[j:n])
        after = _prefix_lengths(a[middle:k][::-1], b[j:n][::-1])[::-1]
        cut = j + int(np.argmax(before + after))
        todo += [(i, middle, j, cut), (middle, k, cut, n)]
    return sorted(found)


def _place(url: str | None) -> tuple[str | None, str]:
    try:
        parts = urlsplit(url or "")
        return (parts.hostname or None), parts.path
    except ValueError:
        return None, ""


def _parsed(pages: DataFrame, url_col: str, html_col: str, *, with_text: bool) -> DataFrame:
    """Each page's host, path and outer lines (hashes; weights: characters of open ones), or what its text is made from."""
    names = [c for c in pages.columns if c != html_col] if with_text else []
    kept = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in names)
    keys = "_host string, _path string, _digest binary, _hashes array<long>, _weights array<int>"
    texts = "_host string, _digest binary, _main string, _open array<string>, _places array<int>, _outer int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for url, html in zip(batch.column(url_col).to_pylist(), batch.column(html_col).to_pylist(), strict=True):
                lines = page_lines(html or "")
                host, path = _place(url)
                outer = [(t, k) for t, k in lines if k != MAIN]
                hashes = np.frombuffer(b"".join(hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=8).digest() for t, _ in outer), "<i8")
                weights = np.array([len(t) if k == OPEN else 0 for t, k in outer], np.int32)
                digest = hashlib.blake2b(hashes.tobytes() + weights.tobytes(), digest_size=16).digest()
                if with_text:
                    main = " ".join(t for t, k in lines if k == MAIN)
                    places = [i for i, (_, k) in enumerate(outer) if k == OPEN]
                    rows.append((host, digest, main, [t for t, k in outer if k == OPEN], places, len(outer)))
                else:
                    rows.append((host, path, digest, hashes, weights))
            columns = list(zip(*rows, strict=True))
            if with_text:
                arrays = [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.list_(pa.string())), pa.array(columns[4], pa.list_(pa.int32())), pa.array(columns[5], pa.int32())]
            else:
                arrays = [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.binary()), pa.array(columns[3], pa.list_(pa.int64())), pa.array(columns[4], pa.list_(pa.int32()))]
            shown = (texts if with_text else keys).split(", ")
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *arrays], names=[*names, *[x.split(" ")[0] for x in shown]])

    given = pages if with_text else pages.select(url_col, html_col)
    return given.mapInArrow(run, ", ".join(x for x in (kept, texts if with_text else keys) if x))


def _nearest(path: str, before: str | None, after: str | None) -> list[int]:
    """The neighbours (0: before, 1: after) that are there, the one of the longer common path first."""

    def common(x: str) -> int:
        n = min(len(x), len(path))
        return next((i for i in range(n) if x[i] != path[i]), n)

    return [k for _, k in sorted((-common(x), k) for k, x in enumerate((before, after)) if x is not None)]


def shared_lines(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Rows (_host, _digest, _shared): the places of outer lines that a page shares with its nearest neighbour."""
    outer = _parsed(pages, url_col, html_col, with_text=False).where(F.col("_host").isNotNull())
    once = outer.groupBy("_host", "_digest").agg(F.min("_path").alias("_path"), F.first("_hashes").alias("_hashes"), F.first("_weights").alias("_weights"))
    ordered = with_running_totals(once.withColumn("_one", F.lit(1).cast("long")), ["_host", "_path", "_digest"], {"_at": "_one"}, "pages").drop("_one", "total__at")
    other = ordered.select(F.col("_host").alias("_other"), "_path", "_hashes", "_at")
    before = other.select("_other", F.col("_path").alias("_path0"), F.col("_hashes").alias("_hashes0"), (F.col("_at") + 1).alias("_at"))
    after = other.select(F.col("_other").alias("_other1"), F.col("_path").alias("_path1"), F.col("_hashes").alias("_hashes1"), (F.col("_at") - 1).alias("_at"))
    met = ordered.join(before, "_at", "left").join(after, "_at", "left")
    same0, same1 = F.col("_other") == F.col("_host"), F.col("_other1") == F.col("_host")
    met = met.select("_host", "_digest", "_path", "_hashes", "_weights", *[F.when(same, F.col(f"{c}{k}")).alias(f"{c}{k}") for k, same in ((0, same0), (1, same1)) for c in ("_path", "_hashes")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, digests, shared = [], [], []
            for row in batch.to_pylist():
                weights, total = row["_weights"], sum(row["_weights"])
                for k in _nearest(row["_path"], row["_path0"], row["_path1"]):
                    places = common_lines(row["_hashes"], row[f"_hashes{k}"])
                    if total and 5 * sum(weights[i] for i in places) > 4 * total:
                        continue  # a copy
                    if places:
                        hosts.append(row["_host"])
                        digests.append(row["_digest"])
                        shared.append(places)
                    break
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(digests, pa.binary()), pa.array(shared, pa.list_(pa.int32()))], names=["_host", "_digest", "_shared"])

    return met.mapInArrow(run, "_host string, _digest binary, _shared array<int>")


def main_texts(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The columns of ``pages`` but for the html, with text, n_chars, n_shared (outer lines deleted since the nearest
    page has them) and n_marked (those deleted by marks alone)."""
    with small_batches(pages.sparkSession):
        shared = written(shared_lines(pages, url_col, html_col), "shared-lines")
    keep = [c for c in pages.columns if c not in (html_col, "text", "n_chars", "n_shared", "n_marked")]
    found = _parsed(pages.select(*keep, html_col), url_col, html_col, with_text=True)
    joined = found.join(shared.withColumnsRenamed({"_host": "_h", "_digest": "_d"}), (F.col("_host") == F.col("_h")) & (F.col("_digest") == F.col("_d")), "left")
    lines = F.arrays_zip(F.col("_open").alias("t"), F.col("_places").alias("p"))
    left = F.when(F.size("_open") == 0, F.array().cast("array<string>")).otherwise(F.transform(F.filter(lines, lambda x: ~F.array_contains(F.col("_shared"), x.p)), lambda x: x.t))
    joined = joined.withColumn("_left", F.when(F.col("_shared").isNull(), F.col("_open")).otherwise(left))
    text = F.when(F.size("_open") == 0, F.col("_main")).otherwise(F.array_join("_left", " "))
    n_shared = F.coalesce(F.size("_shared"), F.lit(0))
    return joined.select(
        *keep,
        text.alias("text"),
        F.length(text).cast("long").alias("n_chars"),
        n_shared.cast("long").alias("n_shared"),
        (F.col("_outer") - n_shared - F.size("_left")).cast("long").alias("n_marked"),
    )
