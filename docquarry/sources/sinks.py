"""Sinks: JSON and Parquet tables, safe embedding, sitemaps, state URLs and publication by stage, check and rename."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_index(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def safe_json(value: Column) -> Column:
    """JSON that can stand in a page: no angle bracket opens a tag."""
    return F.replace(F.to_json(value), F.lit("<"), F.lit("\\u003c"))


def escaped(value: Column) -> Column:
    """HTML text."""
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        value = F.replace(value, F.lit(char), F.lit(name))
    return value


def filled(template: str, **values: Column) -> Column:
    """A template with {{name}} places filled; blanks at line ends go."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{{" + name + "}}"), F.coalesce(value, F.lit("")))
    return F.regexp_replace(out, "[ \\t]+(?=\n|$)", "")


def sitemap(urls: DataFrame, column: str = "url") -> DataFrame:
    """The lines of a sitemap, in the order of the addresses."""
    lines = urls.select(F.concat(F.lit("<url><loc>"), escaped(F.col(column)), F.lit("</loc></url>")).alias("value")).orderBy("value")
    return lines


def state_url(base: Column, **parameters: Column) -> Column:
    """base?name=value&... without empty parameters."""
    parts = [F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"{k}="), F.url_encode(v))) for k, v in parameters.items()]
    query = F.concat_ws("&", *parts)
    return F.when(query == "", base).otherwise(F.concat(base, F.lit("?"), query))


def publish(spark: SparkSession, df: DataFrame, target: str, verify: Callable[[DataFrame], bool]) -> bool:
    """Write beside the target, verify what was written, then swap by renames; a failure leaves the old table."""
    staged, old = f"{target}.{uuid.uuid4().hex}.staged", f"{target}.{uuid.uuid4().hex}.old"
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(target).getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        df.write.parquet(staged)
        if not verify(spark.read.parquet(staged)):
            return False
        there = fs.exists(path(target))
        if there and not fs.rename(path(target), path(old)):
            return False
        if not fs.rename(path(staged), path(target)):
            if there:
                fs.rename(path(old), path(target))
            return False
        if there:
            fs.delete(path(old), True)
        return True
    finally:
        fs.delete(path(staged), True)
