"""Interval and lookup joins that tell which owner a page, section or form belongs to.

Dimensions are small tables of closed intervals; a null end is open. Intervals are cut to the span of the points and dealt to
buckets of a width that makes at most about ``EXPAND`` of them, so a point meets the intervals of its bucket by equality
(a broadcast hash join where small) and is then compared with their ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets that all intervals are spread to, about.
EXPAND = 1_000_000


def _met(points: DataFrame, point: str, intervals: DataFrame, low: str, high: str) -> DataFrame:
    """Points with all intervals that hold them, as _low and _high beside the intervals' columns."""
    span = points.agg(F.min(point).cast("long").alias("a"), F.max(point).cast("long").alias("b")).first()
    first, last = (0, -1) if span["a"] is None else (span["a"], span["b"])
    cut = intervals.withColumn("_low", F.greatest(F.coalesce(F.col(low).cast("long"), F.lit(first)), F.lit(first)))
    cut = cut.withColumn("_high", F.least(F.coalesce(F.col(high).cast("long"), F.lit(last)), F.lit(last))).where("_low <= _high")
    total = cut.agg(F.sum(F.col("_high") - F.col("_low") + 1)).first()[0] or 0
    width = max(1, -(-total // EXPAND))
    bucket = lambda c: F.floor(F.col(c) / F.lit(width)).cast("long")
    spread = cut.withColumn("_bucket", F.explode(F.sequence(bucket("_low"), bucket("_high"))))
    met = points.withColumn("_bucket", F.floor(F.col(point) / F.lit(width)).cast("long")).join(spread, "_bucket")
    return met.where((F.col(point) >= F.col("_low")) & (F.col(point) <= F.col("_high"))).drop("_bucket", "_low", "_high")


def interval_members(points: DataFrame, point: str, intervals: DataFrame, low: str, high: str) -> DataFrame:
    """Every point with every closed interval that holds it (points without one are left out)."""
    return _met(points, point, intervals, low, high)


def first_owner(points: DataFrame, key: str, point: str, intervals: DataFrame, low: str, high: str, order: str, owner: str, alias: str = "owner") -> DataFrame:
    """``points`` with the first interval (by ``order``) that holds each point; null without one."""
    slim = intervals.select(F.col(low).alias("_l"), F.col(high).alias("_h"), F.struct(F.col(order).alias("o"), F.col(owner).alias("w")).alias("_s"))
    at = points.select(F.col(point).alias("_at")).where("_at IS NOT NULL").distinct()
    best = _met(at, "_at", slim, "_l", "_h").groupBy("_at").agg(F.min("_s")["w"].alias(alias))
    return points.join(best, points[point] == best["_at"], "left").drop("_at")


def chapter(points: DataFrame, point: str, ranges: DataFrame, default: str = "unassigned", front: str = "front-matter") -> DataFrame:
    """First range by order; ``default`` outside all, ``front`` where there is no page number."""
    out = first_owner(points, point, point, ranges, "low", "high", "ord", "slug", "_chapter")
    return out.withColumn("chapter_id", F.when(F.col(point).isNull(), front).otherwise(F.coalesce("_chapter", F.lit(default)))).drop("_chapter")


def with_override(rows: DataFrame, overrides: DataFrame, key: str, value: str, *fallbacks: Column, alias: str = "owner") -> DataFrame:
    """The override where the key has one, even if that is null; else the first fallback that isn't null."""
    o = overrides.select(F.col(key).alias("_key"), F.col(value).alias("_value"), F.lit(True).alias("_has"))
    out = rows.join(o, rows[key] == o["_key"], "left")  # Spark broadcasts it where its size allows
    return out.withColumn(alias, F.when(F.col("_has"), F.col("_value")).otherwise(F.coalesce(*fallbacks))).drop("_key", "_value", "_has")


def first_lookup(rows: DataFrame, dimension: DataFrame, key: str, order: str) -> DataFrame:
    """Left lookup that takes the first of several rows with the same key."""
    w = Window.partitionBy(key).orderBy(order)
    return rows.join(dimension.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn"), key, "left")


def titles_of(rows: DataFrame, key: str, ids: str, dimension: DataFrame, alias: str) -> DataFrame:
    """key and the titles of an array of ids, in its order; unknown ids are dropped."""
    flat = rows.select(F.col(key).alias("_key"), F.posexplode(ids).alias("_at", "_id"))
    found = flat.join(dimension.select(F.col("id").alias("_id"), "title"), "_id").groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("_at", "title"))).alias("_all"))
    return found.select(F.col("_key").alias(key), F.transform("_all", lambda x: x["title"]).alias(alias))


def union_index(*kinds: DataFrame) -> DataFrame:
    """All record kinds in one table, absent columns null, in the order given."""
    parts = [k.withColumn("_kind", F.lit(i)) for i, k in enumerate(kinds)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def overlay(rows: DataFrame, decisions: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Curated values over found ones. Each decision must meet exactly one row: see ``overlay_faults``."""
    d = decisions.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    out = rows.join(d, key, "left")
    return out.withColumns({c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in columns}).drop(*[f"_{c}" for c in columns])


def overlay_faults(rows: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """Decisions that meet no row or several."""
    return decisions.select(key).join(rows.groupBy(key).agg(F.count("*").alias("n")), key, "left").where("n IS NULL OR n <> 1")
