"""Queries for the rules on page text, on pages that are built from all documents with the forms of the printed source:
wide digits, carriage returns, page numbers with blanks inside, letters' headers, form titles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import extraction as E
from ..operators import site as W
from ..operators import validation as V
from .catalogue import registered, table

_WIDE = "translate({}, '0123456789', '０１２３４５６７８９')"
_SQUEEZED = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"


def _wide(digits):
    return F.translate(digits.cast("string"), X.DIGITS, X.FULL_DIGITS)


# the text's line ends become two line ends each, since a carriage return is one of its own
_SHOWN = r"regexp_replace(list_aggregate(list_transform(string_split('１１４年 1月 2日 農授金字第１號' || chr(10) || chr(10) || replace(text, chr(10), chr(10) || chr(10)), chr(10)), lambda l: rtrim(l)), 'string_agg', chr(10)), '\n+$', '')"


@registered(
    f"""WITH p AS (SELECT doc_id, text, {_SHOWN} AS shown FROM documents)
SELECT doc_id, CASE WHEN doc_id > 2 THEN doc_id - 2 END AS printed_page, md5(CASE WHEN doc_id > 2 THEN shown ELSE shown || repeat(chr(10), 2) || 'x' END) AS raw_md5,
    md5({_SQUEEZED.format("'114年 1月 2日 農授金字第1號 ' || text || CASE WHEN doc_id > 2 THEN '' ELSE ' x' END")}) AS search_md5, true AS has_text FROM p"""
)
def page_texts(spark, d):
    """The whole text of every page, for readers and for the search, after the printed number is gone. The first pages have
    none; their last line stays."""
    own = F.when(F.col("doc_id") > 2, F.concat(F.lit(" "), _wide(F.floor((F.col("doc_id") - 2) / 10)), F.lit("　 "), ((F.col("doc_id") - 2) % 10).cast("string"), F.lit(" \r\n"))).otherwise(F.lit("x"))
    digits = F.when((F.col("doc_id") > 2) & (F.col("doc_id") < 12), F.concat(_wide(F.col("doc_id") - 2), F.lit(" \r\n"))).otherwise(own)
    text = F.concat(F.lit("１１４年 1月 2日 農授金字第１號\r\n"), F.replace(F.col("text"), F.lit("\n"), F.lit("\r\n")), F.lit("\r\n"), digits)
    pages = table(spark, d, "documents").select("doc_id", F.col("doc_id").alias("pdf_page"), text.alias("raw_text"))
    ranges = spark.createDataFrame([(0, "all", 0, None)], "ord int, slug string, low int, high int")
    md5 = lambda c: F.md5(F.col(c).cast("binary"))
    return W.build_pages(pages, ranges).select("doc_id", "printed_page", md5("raw_text").alias("raw_md5"), md5("search_text").alias("search_md5"), "has_text")


_RANGES = [(0, "second", 300, 50_000), (1, "first", 0, 400)]
_SUBJECT = _SQUEEZED.format("split_part(text, chr(10), 1)")


@registered(
    f"""WITH r(ord, program, a, b) AS (VALUES {", ".join(map(str, _RANGES))}), l AS (
    SELECT r.ord, r.program, doc_id AS printed_page, (doc_id % 200 + 1) || '年1月2日' AS date, '農授金字第' || (doc_id * 37 + 1000000) || '號' AS document_number,
        left(CASE WHEN {_SUBJECT} = '' THEN '說明：x' ELSE {_SUBJECT} END, 240) AS title
    FROM documents JOIN r ON doc_id BETWEEN a AND b)
SELECT printf('interpretation-%03d', row_number() OVER (ORDER BY ord, printed_page)) AS id, program, printed_page, date, document_number, title FROM l"""
)
def letter_records(spark, d):
    """A letter of wide digits on every page, after one whose header isn't understood; two ranges overlap."""
    k = F.col("doc_id")
    header = F.concat(F.lit("【農業部"), _wide(k % 200 + 1), F.lit("年 1月２日\n農授金字第"), _wide(k * 37 + 1_000_000), F.lit("號函】"))
    text = F.concat(F.lit("【另函】主旨：無\n"), header, F.lit("\n主旨：　"), F.substring_index("text", "\n", 1), F.lit("\n說明：x"))
    pages = table(spark, d, "documents").select(k.cast("int").alias("printed_page"), text.alias("raw_text"))
    ranges = spark.createDataFrame(_RANGES, "ord int, program string, page_start int, page_end int")
    return E.letters(pages, ranges).select("id", "program", F.col("printed_page").cast("long").alias("printed_page"), "date", "document_number", "title")


@registered("SELECT printf('form-%03d', row_number() OVER (ORDER BY doc_id)) AS id, doc_id AS printed_page, '附件' || (doc_id * 7) || '申請書' AS title FROM documents")
def form_records(spark, d):
    """Each page names one form, twice and behind a number of its own, and has lines that only speak of forms."""
    title = F.concat(F.lit("附件"), _wide(F.col("doc_id") * 7), F.lit("申請書"))
    text = F.concat_ws("\n", F.col("text"), F.concat(F.lit("（１）、"), title), F.lit("應檢具申請書附表"), F.lit("申請書，一式"), title)
    pages = table(spark, d, "documents").select(F.col("doc_id").alias("printed_page"), text.alias("raw_text"))
    return E.form_titles(pages).select("id", "printed_page", "title")


@registered("SELECT p_partkey FROM part WHERE p_partkey % 3 = 0")
def untold_titles(spark, d):
    """Titles with attachment numbers, editions and the form's other name; a third aren't in their source."""
    k = F.col("p_partkey")
    title = F.concat(F.lit("附件 "), _wide(F.col("p_size")), F.lit("-"), F.col("p_name"), F.lit("申請書及審核表-３版"))
    other = F.when(k % 3 == 1, F.concat(F.lit("見 "), F.upper("p_name"), F.lit(" 申請書 及檢核表。"))).when(k % 3 == 2, F.concat(F.col("p_name"), F.lit("申請書及審核表"))).otherwise(F.concat("p_name", F.lit("申請書")))
    rows = table(spark, d, "part").select("p_partkey", title.alias("title"), other.alias("source"))
    return V.untold(rows, "p_partkey", F.col("source"), F.col("title"), F.lit("")).select("p_partkey")


_ROC = "((year({0}) - 1911) || '/' || strftime({0}, '%m/%d'))"


@registered(
    f"""WITH e AS (SELECT event_id, CAST(ts AS DATE) AS a, CAST(ts AS DATE) + 30 AS b FROM events)
SELECT event_id, CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN '官方資料所載受理期間：自 ' || {_ROC.format("a")} || ' 起' WHEN 2 THEN '官方資料所載受理期限：至 ' || {_ROC.format("b")} ELSE '官方資料所載受理期間：' || {_ROC.format("a")} || '－' || {_ROC.format("b")} END AS period FROM e"""
)
def application_periods(spark, d):
    k, day = F.col("event_id") % 4, F.col("ts").cast("date")
    start, end = F.when(k.isin(1, 3), day.cast("string")), F.when(k.isin(2, 3), F.date_add(day, 30).cast("string"))
    return table(spark, d, "events").select("event_id", X.period(start, end).alias("period"))
