"""Numbers and running totals over whole tables, without a window that one task must hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written


def numbered_rows(df: DataFrame, *order: str, name: str = "ord", start: int = 1) -> DataFrame:
    """``df`` with the place of each row in the order of the columns ``order`` (nulls first), from ``start`` on.

    Rows are dealt by ranges of the order and written once, so that they stay where they are. Each partition numbers its
    own rows; what comes before it is the sum of the counts of the partitions before, which are as many numbers as there are
    partitions and are added up on the driver. Rows equal in all of ``order`` lie in one partition and may stand in any
    order among themselves: name a column that tells them apart.
    """
    keys = [F.col(c).asc_nulls_first() for c in order]
    rows = written(df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), "ranges")
    before, bases = start - 1, []
    for part, n in sorted((r["_part"], r["count"]) for r in rows.groupBy("_part").count().collect()):
        bases.append((part, before))
        before += n
    if not bases:
        return rows.drop("_part").withColumn(name, F.lit(None).cast("long"))
    base = df.sparkSession.createDataFrame(bases, "_part int, _base long")
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*keys))
    return rows.withColumn("_inside", inside).join(F.broadcast(base), "_part").withColumn(name, F.col("_base") + F.col("_inside")).drop("_part", "_base", "_inside")
