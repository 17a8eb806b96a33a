"""Sharding: global prefix sums of byte sizes, cut at equal targets into contiguous shards.

Each row lies where the middle of its bytes lies, so shards follow the id and any shard's size differs from the
target by less than one row. Sizes come from all rows; per-partition totals give the offsets.

Defined results: null text has size 1 and the crc32 of no bytes (0); null ids come first; equal ids are ordered by
size and crc32; repeated rows each get a slot of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import utf8_length, with_running_totals


def shard_by_bytes(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, size, text_crc32, law, shard, slot and grown_shard of every row. ``slot`` counts from 0 in each shard."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    text = F.col(text_col)
    sized = docs.select(
        F.col(id_col),
        (utf8_length(text) + 1).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit(1).cast("long").alias("one"),
    )
    rows = with_running_totals(sized, [id_col, "size", "text_crc32"], {"before": "size", "index": "one"}, "shards")
    rows = rows.withColumn("shard", F.expr(f"CAST(((2 * before + size) * {shards}) DIV (2 * total_before) AS INT)"))
    first = rows.groupBy("shard").agg(F.min("index").alias("first_index"))  # a row for each shard
    return rows.join(F.broadcast(first), "shard").select(
        id_col,
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("index") - F.col("first_index")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
