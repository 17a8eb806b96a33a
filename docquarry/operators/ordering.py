"""Two orders of the same things compared: which rows stand out of place, and as few of them as possible."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.elements import html_elements
from ..sources.shared import written


def in_place(ranks: list[int]) -> list[bool]:
    """Which of the ranks (all different) are in the longest increasing run; of several, the one that takes earlier places."""
    tails, length = [], []
    for rank in reversed(ranks):  # how long a run can be that begins here
        at = bisect_left(tails, -rank)
        tails[at : at + 1] = [-rank]
        length.append(at + 1)
    need, kept = max(length, default=0), []
    for n in reversed(length):
        kept.append(n == need)
        need -= n == need
    return kept


def out_of_place(pairs: DataFrame, group: str, id_col: str, position: str, place: str) -> DataFrame:
    """group, id of the fewest rows that must be moved so that ``position`` and ``place`` give the same order in each group.

    A list is cut wherever all rows before the cut also come first by place: a run may be sought in each part alone. Parts
    of one row are right at once; only the others go to Python, where a worker holds one part and a batch. Equal positions
    or places are told apart by the id.
    """
    ranked = pairs.select(group, id_col, F.col(position).alias("_position"), F.row_number().over(Window.partitionBy(group).orderBy(place, id_col)).alias("_rank"))
    listed = Window.partitionBy(group).orderBy("_position", id_col)
    placed = ranked.withColumns({"_number": F.row_number().over(listed), "_top": F.max("_rank").over(listed)})
    first = F.coalesce(F.lag("_top").over(listed) == F.col("_number") - 1, F.lit(True))
    moved = placed.withColumn("_first", first).where(~(F.col("_first") & (F.col("_top") == F.col("_number"))))
    moved = moved.select(group, id_col, "_number", "_first", "_rank").sortWithinPartitions(group, "_number")  # groups are whole since the windows

    def seek(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for frame in frames:
            held.append(frame)
            if frame["_first"].any():
                rows = pd.concat(held, ignore_index=True)
                starts = rows["_first"].to_numpy().nonzero()[0].tolist()
                held = [rows[starts[-1] :]]
                yield judged(rows[: starts[-1]], starts)
        if held:
            rows = pd.concat(held, ignore_index=True)
            yield judged(rows, [0, len(rows)])

    def judged(rows: pd.DataFrame, cuts: list[int]) -> pd.DataFrame:
        ranks = rows["_rank"].tolist()
        kept = [k for a, b in zip(cuts, cuts[1:]) for k in in_place(ranks[a:b])]
        return rows.loc[[not k for k in kept], [group, id_col]]

    return moved.mapInPandas(seek, T.StructType([pairs.schema[group], pairs.schema[id_col]]))


def _faults(met: DataFrame, group: str, id_col: str) -> DataFrame:
    """group, id and fault; met: group, id, _at (null if not listed), _n (how often), _place (null if not in the document)."""
    rules = F.array(F.when(F.col("_place").isNull(), F.lit("missing-target")), F.when(F.col("_n") > 1, F.lit("repeated")))
    faults = met.where("_n > 0").select(group, id_col, F.explode(F.array_compact(rules)).alias("fault"))
    moved = out_of_place(met.where("_n > 0 AND _place IS NOT NULL"), group, id_col, "_at", "_place")
    return faults.unionByName(moved.withColumn("fault", F.lit("out-of-place")))


def order_faults(listed: DataFrame, document: DataFrame, group: str, id_col: str = "id") -> DataFrame:
    """group, id and fault of a list (group, id, position) against the document (group, id, place): missing-target (not in the
    document), repeated (listed again), out-of-place. The first of a repeated id counts; rows without a group or an id don't."""
    known = f"`{group}` IS NOT NULL AND `{id_col}` IS NOT NULL"
    places = document.where(known).groupBy(group, id_col).agg(F.min("place").alias("_place"))
    once = listed.where(known).groupBy(group, id_col).agg(F.min("position").alias("_at"), F.count("*").alias("_n"))
    return _faults(once.join(places, [group, id_col], "left"), group, id_col)


def contents_faults(pages: DataFrame, key: str, attribute: str, html_col: str = "html") -> DataFrame:
    """key, id and fault of pages' tables of contents, which are the elements with ``attribute``: links to the page's own ids as
    ``order_faults`` has them, and no-contents (null id) for pages without such a link. Each page is read once."""
    href, elements = F.col("attributes")["href"], html_elements(pages.where(F.col(key).isNotNull()).select(key, html_col), html_col, attribute)
    link = (F.col("tag") == "a") & F.col("parent_card").isNotNull() & href.startswith("#")
    uses = F.array(F.when(link, F.struct(F.lit(True).alias("link"), F.expr("substr(attributes['href'], 2)").alias("id"))), F.when(F.col("id").isNotNull(), F.struct(F.lit(False).alias("link"), F.col("id"))))
    flat = elements.select(key, "number", F.explode(F.array_compact(uses)).alias("_u")).select(key, "number", "_u.*")
    at = lambda c: F.min(F.when(c, F.col("number")))
    met = written(flat.groupBy(key, "id").agg(at(F.col("link")).alias("_at"), F.count_if("link").alias("_n"), at(~F.col("link")).alias("_place")), "contents")
    none = pages.select(key).where(F.col(key).isNotNull()).distinct().join(met.where("_n > 0").select(key), key, "left_anti")
    return _faults(met, key, "id").unionByName(none.select(key, F.lit(None).cast("string").alias("id"), F.lit("no-contents").alias("fault")))
