"""Published tables without a gap: every version has a folder of its own, and a small file says which folder it is.

The file of version n is first written under another name and then renamed, without replacing one that is there. That
one step publishes: a reader finds the old version or the new one, never neither, and of two publishers that built on
the same version the second finds its number taken and fails, with its folder removed.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .shared import remove

_DIGITS, _END = 9, ".version"


class Outrun(Exception):
    """Another publisher was faster: read the current version and build on that."""


def _system(spark: SparkSession, target: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path, path(target).getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, target: str) -> list[int]:
    """The numbers that are published, in order."""
    path, fs = _system(spark, target)
    if not fs.exists(path(target)):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path(target))]
    return sorted(int(n.removesuffix(_END)) for n in names if n.endswith(_END) and not n.startswith("."))


def _file(target: str, number: int) -> str:
    return f"{target}/{number:0{_DIGITS}d}{_END}"


def folder_of(spark: SparkSession, target: str, number: int) -> str:
    path, fs = _system(spark, target)
    stream = fs.open(path(_file(target, number)))
    try:
        return f"{target}/{bytes(stream.readAllBytes()).decode()}"
    finally:
        stream.close()


def current(spark: SparkSession, target: str) -> tuple[int, str | None]:
    """(number, folder) of the newest version; (0, None) where there is none."""
    found = versions(spark, target)
    return (found[-1], folder_of(spark, target, found[-1])) if found else (0, None)


def publish(spark: SparkSession, target: str, write: Callable[[str], None], based_on: int, verify: Callable[[str], bool] = lambda folder: True) -> int:
    """``write`` fills a new folder, which becomes version ``based_on`` + 1 if ``verify`` agrees.

    Raises :class:`Outrun` if that number is taken and ValueError if ``verify`` refuses; the folder goes in both cases.
    """
    path, fs = _system(spark, target)
    name, number = f"data-{uuid.uuid4().hex}", based_on + 1
    folder, draft = f"{target}/{name}", f"{target}/.draft-{uuid.uuid4().hex}"
    try:
        if versions(spark, target)[-1:] != ([based_on] if based_on else []):
            raise Outrun(f"{target}: version {based_on} is not the current one")
        write(folder)
        if not verify(folder):
            raise ValueError(f"{target}: the new version was refused")
        stream = fs.create(path(draft), False)
        stream.write(name.encode())
        stream.close()
        context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(path(target).toUri() if "://" in target else fs.getUri(), spark._jsc.hadoopConfiguration())
        options = spark._sc._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.valueOf("NONE")
        try:
            context.rename(path(fs.makeQualified(path(draft)).toString()), path(fs.makeQualified(path(_file(target, number))).toString()), options)
        except Exception as e:
            if fs.exists(path(_file(target, number))):
                raise Outrun(f"{target}: version {number} was published by another") from e
            raise
    except BaseException:
        remove(spark, folder)
        fs.delete(path(draft), False)
        raise
    return number


def publish_table(df: DataFrame, target: str, based_on: int, verify: Callable[[DataFrame], bool] = lambda df: True) -> int:
    """:func:`publish` of one table as Parquet."""
    spark = df.sparkSession
    return publish(spark, target, lambda folder: df.write.parquet(folder), based_on, lambda folder: verify(spark.read.parquet(folder)))


def read_current(spark: SparkSession, target: str) -> DataFrame:
    number, folder = current(spark, target)
    if folder is None:
        raise ValueError(f"{target}: nothing is published")
    return spark.read.parquet(folder)


def drop_old(spark: SparkSession, target: str, keep: int = 2) -> list[int]:
    """Remove all versions but the ``keep`` newest; their numbers. Readers of an older one must have ended."""
    gone = versions(spark, target)[: -max(1, keep)]
    path, fs = _system(spark, target)
    for number in gone:
        remove(spark, folder_of(spark, target, number))
        fs.delete(path(_file(target, number)), False)
    return gone
