"""Many markers in one pass over each text, by an Aho-Corasick automaton of them all.

The automaton is built in each Python worker from the marker list, which is sent there in groups of bounded size; a
longer list means one more pass over the texts for each further group. Texts are never exploded: what a hit is told with
is its place, and the number of the piece (line, say) that it begins in.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of markers that one automaton is made of at most (a longer marker has one of its own).
GROUP_CHARS = 2_000_000
_BUILT: dict[tuple[str, ...], object] = {}


def _automaton(markers: tuple[str, ...]):
    """The worker's automaton for these markers; the last one stays for the next task."""
    if markers not in _BUILT:
        import ahocorasick

        built = ahocorasick.Automaton()
        for m in markers:
            built.add_word(m, m)
        built.make_automaton()
        _BUILT.clear()
        _BUILT[markers] = built
    return _BUILT[markers]


def found_in(text: str, markers: tuple[str, ...], piece_end: str | None = None) -> list[tuple[int, str, int, int, int]]:
    """(piece, marker, first place, hits, hits that don't overlap) of each marker in each piece of a text; places count
    from the text's beginning, and no hit reaches over the end of a piece."""
    ends = [i for i, c in enumerate(text) if c == piece_end] if piece_end and piece_end in text else []
    out: dict[tuple[int, str], list[int]] = {}
    at = 0
    for end, marker in _automaton(markers).iter(text):
        begin = end - len(marker) + 1
        while at < len(ends) and ends[at] < end:
            at += 1
        # ends[at-1] is the last end of a piece before the hit's last character
        if ends and at and ends[at - 1] >= begin:
            continue
        row = out.get((at, marker))
        if row is None:
            out[at, marker] = [begin, 1, 1, end + 1]
        else:
            row[1] += 1
            if begin >= row[3]:
                row[2] += 1
                row[3] = end + 1
    return [(piece, m, *row[:3]) for (piece, m), row in out.items()]


def _groups(markers: DataFrame) -> list[tuple[str, ...]]:
    groups, size = [[]], 0
    for m in sorted({r[0] for r in markers.distinct().toLocalIterator() if r[0]}):
        if size and size + len(m) > GROUP_CHARS:
            groups.append([])
            size = 0
        groups[-1].append(m)
        size += len(m)
    return [tuple(g) for g in groups if g]


def marker_hits(texts: DataFrame, text_col: str, markers: DataFrame, piece_end: str | None = None) -> DataFrame:
    """A row for each row of ``texts``, piece and marker that stands in it: the other columns of ``texts``, piece (from 0),
    marker, first (place in the text, from 0), hits (overlapping ones included) and apart (from the left, not overlapping).

    ``markers`` has one column. ``_row`` tells rows of ``texts`` apart that are equal in all other columns; it holds for one
    evaluation. Null texts and null or empty markers have no hits; a marker that holds ``piece_end`` is never found.
    """
    keep = [c for c in texts.columns if c != text_col]
    rows = texts.select(text_col, *keep, F.monotonically_increasing_id().alias("_row"))
    keep = [*keep, "_row"]
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)

    def found(group: tuple[str, ...]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, hits = [], []
                for i, text in enumerate(batch.column(0).to_pylist()):
                    here = found_in(text, group, piece_end) if text else []
                    at += [i] * len(here)
                    hits += here
                pieces, names, first, n, apart = zip(*hits, strict=True) if hits else ([],) * 5
                told = batch.select(keep).take(pa.array(at, pa.int64()))
                counts = [pa.array(x, pa.int32()) for x in (first, n, apart)]
                yield pa.RecordBatch.from_arrays([*told.columns, pa.array(pieces, pa.int32()), pa.array(names, pa.string()), *counts], names=[*keep, "piece", "marker", "first", "hits", "apart"])

        return rows.mapInArrow(run, f"{kinds}, piece int, marker string, first int, hits int, apart int")

    groups = _groups(markers)
    if not groups:
        return found(("",)).where(F.lit(False))
    out = found(groups[0])
    for group in groups[1:]:
        out = out.unionByName(found(group))
    return out


def pages_of_markers(hits: DataFrame, page: str) -> DataFrame:
    """marker, pages (different ones that have it), hits and apart, of rows of :func:`marker_hits`."""
    return hits.groupBy("marker").agg(F.countDistinct(page).alias("pages"), F.sum("hits").alias("hits"), F.sum("apart").alias("apart"))
