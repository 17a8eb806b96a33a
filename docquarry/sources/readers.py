"""Sources: tables in JSON and Parquet, files with their digests, HTML, text embedded in pages, URL parameters, PDF text."""

from __future__ import annotations

from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parquet_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that holds one JSON array, by an explicit schema."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def inline_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Constant rows with their order in ``ord``."""
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"ord int, {schema}")


def file_manifest(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path (relative to the folder), length and sha256 of all files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    bare = F.regexp_replace("path", "^[a-z]+:/+", "/")
    return files.select(F.replace(bare, F.lit(folder.rstrip("/") + "/"), F.lit("")).alias("path"), "length", F.sha2("content", 256).alias("sha256"))


def is_pdf(content: Column) -> Column:
    return F.substring(content, 1, 4) == F.lit(b"%PDF")


@F.pandas_udf(T.StringType())
def _unescaped(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unescape(v))


def unescape_entities(value: Column) -> Column:
    """Named and numbered entities to their characters. Texts with the five commonest alone stay in the JVM."""
    plain = value
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(name), F.lit(char))
    other = value.rlike("&(?!(?:lt|gt|quot|amp|#39);)[#A-Za-z]") | value.rlike("&amp;(?:[#A-Za-z])")
    return F.when(other, _unescaped(F.when(other, value))).otherwise(plain)


def html_text(html: Column, between: str = " ") -> Column:
    """Text of HTML: tags give way to ``between``, entities to their characters."""
    return unescape_entities(F.regexp_replace(html, "<[^>]+>", between))


def html_attributes(html: Column, name: str, tag: str = "[a-zA-Z][a-zA-Z0-9]*") -> Column:
    """Values of an attribute in document order."""
    return F.regexp_extract_all(html, F.lit(f'<{tag}\\s[^>]*?\\b{name}="([^"]*)"'), F.lit(1))


def embedded_json(html: Column, marker: str, schema: str) -> Column:
    """The array in the script element that has ``marker``; a malformed one counts as empty."""
    body = F.regexp_extract(html, f"(?s)<script[^>]*\\b{marker}\\b[^>]*>(.*?)</script>", 1)
    return F.coalesce(F.from_json(body, f"array<struct<{schema}>>", {"mode": "PERMISSIVE"}), F.from_json(F.lit("[]"), f"array<struct<{schema}>>"))


def url_parameter(url: Column, name: str) -> Column:
    """A decoded query parameter; '' if absent."""
    return F.coalesce(F.try_url_decode(F.parse_url(url, F.lit("QUERY"), F.lit(name))), F.lit(""))


def with_allowed(rows: DataFrame, column: str, options: DataFrame, option: str) -> DataFrame:
    """``rows`` with '' in ``column`` wherever its value is none of the options, however many there are."""
    known = options.select(F.col(option).alias("_option")).distinct()
    met = rows.join(known, rows[column] == known["_option"], "left")
    return met.withColumn(column, F.coalesce("_option", F.lit(""))).drop("_option")


class _Cards(HTMLParser):
    """Elements that carry an attribute, with the text inside them, however deep."""

    VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}

    def __init__(self, attribute: str):
        super().__init__()
        self.attribute, self.stack, self.rows = attribute, [], []

    def handle_starttag(self, tag, attrs):
        value = dict(attrs).get(self.attribute)
        row = None
        if value is not None:
            row = [value, tag, len([s for s in self.stack if s[1] is not None]), []]
            self.rows.append(row)
        if tag not in self.VOID:
            self.stack.append((tag, row))

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                break

    def handle_data(self, data):
        for _, row in self.stack:
            if row is not None:
                row[3].append(data)


def html_cards(pages: DataFrame, attribute: str, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """A row for each element with ``attribute``: its value, tag, depth among such elements and whole text."""
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, html in zip(batch[id_col], batch[html_col]):
                parser = _Cards(attribute)
                parser.feed(html or "")
                out += [(key, i, *row[:3], "".join(row[3])) for i, row in enumerate(parser.rows)]
            yield pd.DataFrame(out, columns=[id_col, "ord", "value", "tag", "depth", "text"])

    return pages.select(id_col, html_col).mapInPandas(run, f"{id_col} {kind}, ord int, value string, tag string, depth int, text string")


def pdf_pages(spark: SparkSession, path: str) -> DataFrame:
    """pdf_page and raw_text of PDF files, where a PDF library is installed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        from pypdf import PdfReader

        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                pages = PdfReader(io.BytesIO(content)).pages
                yield pd.DataFrame([(name, i + 1, p.extract_text() or "") for i, p in enumerate(pages)], columns=["path", "pdf_page", "raw_text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, pdf_page int, raw_text string")
