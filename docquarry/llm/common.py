"""What the operators share: the shared folder, tables cut off from their lineage, and ordered prefix sums."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` where the cluster names one.

    A folder given to ``SparkContext.setCheckpointDir`` will do too. Only in local mode, where both are unset, a temporary
    folder is made and set; on a cluster that is an error, since executors don't see the driver's folders.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        if given.isDefined():
            return given.get().rstrip("/")
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir is unset: name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="docquarry-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again: lineage ends there, lost executors don't matter."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def utf8_length(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def with_running_totals(df: DataFrame, order: list[str], weights: dict[str, str], name: str) -> DataFrame:
    """Global exclusive running totals in the order of ``order`` (nulls first), without a single-task window.

    The rows are range-partitioned by ``order`` and written once, so partition numbers are settled. Each partition
    adds up its own rows; the totals of the partitions (one row each, so bounded by their number) give the offsets.
    ``weights`` maps a new column to the long column that it totals; ``total_<new>`` gets the grand total.
    Rows equal in all of ``order`` may stand in any order among themselves; a salt keeps them off one task.
    """
    salted = df.withColumn("_salt", F.monotonically_increasing_id())
    keys = [*order, "_salt"]
    parted = salted.repartitionByRange(*[F.col(k).asc_nulls_first() for k in keys]).withColumn("_part", F.spark_partition_id())
    rows = written(parted, name)
    totals = rows.groupBy("_part").agg(*[F.sum(w).alias(f"_sum_{k}") for k, w in weights.items()])
    before, whole = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(1))
    bases = totals.select(
        "_part",
        *[F.coalesce(F.sum(f"_sum_{k}").over(before), F.lit(0)).alias(f"_base_{k}") for k in weights],
        *[F.sum(f"_sum_{k}").over(whole).alias(f"total_{k}") for k in weights],
    )
    inside = Window.partitionBy("_part").orderBy(*[F.col(k).asc_nulls_first() for k in keys]).rowsBetween(Window.unboundedPreceding, -1)
    out = rows
    for k, w in weights.items():
        out = out.withColumn(f"_in_{k}", F.coalesce(F.sum(w).over(inside), F.lit(0)))
    out = out.join(F.broadcast(bases), "_part")
    for k in weights:
        out = out.withColumn(k, F.col(f"_base_{k}") + F.col(f"_in_{k}"))
    return out.drop("_salt", "_part", *[f"_base_{k}" for k in weights], *[f"_in_{k}" for k in weights])


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 500) -> Iterator[None]:
    """While it holds, Python workers get at most so many rows at a time. For jobs that run inside it, not lazy ones."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


class IdFilter:
    """A Bloom filter of one hash over a written table of ids: bitmaps of 32,768 bits, at most 16 MB in all.

    It lets every id of the table through and keeps most others off a shuffle; a join must follow. Beyond about ten
    million ids it lets more and more through, which costs time but changes nothing.
    """

    BLOCK = 32_768

    def __init__(self, ids: DataFrame):
        self.bits = 1 << min(27, max(16, (16 * ids.count()).bit_length()))
        spot = self._spot(ids.columns[0])
        block, place = (F.floor(spot / self.BLOCK)).cast("int"), spot % self.BLOCK
        self.maps = ids.select(block.alias("_block"), place.alias("_place")).groupBy("_block").agg(F.bitmap_construct_agg("_place").alias("_map"))

    def _spot(self, column: str) -> Column:
        return F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(self.bits))

    def marked(self, df: DataFrame, column: str) -> DataFrame:
        """``df`` with _maybe: whether the id may be in the table (false for null)."""
        spot = self._spot(column)
        place = spot % self.BLOCK
        out = df.withColumns({"_block": F.when(F.col(column).isNotNull(), F.floor(spot / self.BLOCK).cast("int")), "_place": place})
        out = out.join(F.broadcast(self.maps), "_block", "left")
        byte = F.conv(F.hex(F.substring(F.col("_map"), F.floor(F.col("_place") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        bit = byte.bitwiseAND(F.pow(F.lit(2.0), F.col("_place") % 8).cast("int")) != 0
        return out.withColumn("_maybe", F.coalesce(bit, F.lit(False))).drop("_block", "_place", "_map")
