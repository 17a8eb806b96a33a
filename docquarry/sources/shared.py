"""Tables for a while: in the folder that driver and executors share, or, where they are small, in the plan itself."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Rows that a table may have to be held in the plan (query tables, their terms, the candidates of selective queries).
SMALL = 20_000


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Only in local mode, where it is unset, a temporary one is made and set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir is unset: name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="docquarry-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df``, written once and read back: lineage ends there and lost executors don't matter."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(df: DataFrame, name: str) -> tuple[DataFrame, list | None]:
    """``df`` computed once: (table in the plan, its rows) up to ``SMALL`` rows, else (written table, None)."""
    some = df.limit(SMALL + 1).toArrow()
    if some.num_rows > SMALL:
        return written(df, name), None
    return df.sparkSession.createDataFrame(some, df.schema), some.to_pylist()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library wrote."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[str]:
    """A folder inside the shared one that is gone afterwards; for jobs that run inside the block."""
    path = fresh_path(spark, name)
    try:
        yield path
    finally:
        remove(spark, path)
