"""Rules that turn page text into rows: letters, forms, questions and answers, task marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import unicode as U
from .markers import marker_hits
from .numbering import numbered_rows

# Dates, numbers and issuers in a letter's header.
HEADER_DATE = r"(?:中華民國)?\s*([0-9０-９]+)\s*年\s*([0-9０-９]+)\s*月\s*([0-9０-９]+)\s*日"
HEADER_NUMBER = r"^[㐀-鿿A-Za-z]+字第[A-Za-z0-9]+號$"
HEADER_ISSUER = r"^(?:行政院農業委員會(?:農業金融局)?|農業部)"
LOOSE_NUMBER = r"(?:農授(?:林務)?|農金(?:三)?|農牧)字第?\s*[A-Za-z0-9０-９\s]+號"
# Words that make a line a form's title, and words that speak against it.
FORM_WORDS = ("申請書", "審核表", "查驗紀錄", "切結書", "檢核表", "證明書", "調查表")
FORM_STOPS = ("應", "檢具", "提出", "已檢", "立切結", "確認簽章", "函令摘要", "主旨", "□")
# List labels, answer marks, question marks and phrases that end a list of questions.
MARKER = r"(?m)(?:^|[）)])\s*([一二三四五六七八九十]+)\s*[、．.]"
ANSWER, QUESTION_MARKS = r"答\s*[:：]?", "[？?﹖]"
SCOPE_BREAKS = ("專案農貸諮詢專線", "相關書表配合訂定修正")
# Tasks and the words that mark them, in order.
TASKS = (
    ("eligibility", "申請資格", ("貸款對象", "申貸資格", "申請資格")),
    ("purpose", "貸款用途", ("貸款用途", "資金用途")),
    ("amount", "貸款額度", ("貸款額度", "最高貸款額度")),
    ("term", "貸款期限／寬緩期", ("貸款期限", "貸款期間", "寬緩期", "寬限期")),
    ("interest", "利率", ("貸款利率", "利率依", "利率如下")),
    ("documents", "應備文件", ("應檢具", "應檢附")),
    ("post-loan-management", "貸放後管理", ("貸放後", "貸後", "用途查驗", "經營狀況查驗")),
)


def header_fields(header: Column, nfkc=U.nfkc) -> Column:
    """struct<date, document_number>; null unless the whole header is understood, in compatibility form."""
    c = F.regexp_replace(nfkc(header) if nfkc else header, f"[{X.PAGE_SPACE}]+", "")
    c = F.regexp_replace(c, "^【(.*)】$", "$1")
    part = lambda i: X.ascii_digits(F.regexp_extract(c, HEADER_DATE, i))
    date = F.concat(*[x for i, unit in ((1, "年"), (2, "月"), (3, "日")) for x in (part(i).cast("int").cast("string"), F.lit(unit))])
    first = F.regexp_extract(c, HEADER_DATE, 0)
    at = F.instr(c, first)
    rest = F.concat(F.substring(c, F.lit(1), at - 1), F.substring(c, at + F.length(first), F.length(c)))
    rest = F.regexp_replace(F.regexp_replace(rest, "(?:函|公告)$", ""), HEADER_ISSUER, "")
    good = c.rlike(HEADER_DATE) & rest.rlike(HEADER_NUMBER) & ~rest.startswith("日") & ~rest.rlike("[年月日()（）]|中華民國")
    return F.when(good, F.struct(date.alias("date"), rest.alias("document_number")))


def bracket_headers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("【[^】]+】"), F.lit(0))


def loose_references(pages: DataFrame, key: str, text: str, nfkc=U.nfkc) -> DataFrame:
    """A row for each document number in running text: key, place on the page and the number without blanks."""
    found = F.regexp_extract_all(F.col(text), F.lit(LOOSE_NUMBER), F.lit(0))
    return pages.select(key, F.posexplode(found).alias("place", "raw")).select(key, "place", X.canonical_source_number(F.col("raw"), nfkc).alias("document_number"))


def subject(body: Column) -> Column:
    """The subject of a letter, at most 240 characters; null without one."""
    got = F.regexp_extract(body, "(?s)主旨\\s*[：:]\\s*(.+?)(?=\n(?:說明|依據|公告事項)\\s*[：:]|\n函令摘要|$)", 1)
    return F.when(got != "", F.substring(X.search_text(got), 1, 240))


def split_blocks(pages: DataFrame, key: str, text: str, opening: str) -> DataFrame:
    """A row for each match of ``opening``: its number, the match and the text up to the next one (or the end)."""
    marks = F.regexp_extract_all(F.col(text), F.lit(f"({opening})"), F.lit(1))
    parts = F.split(F.col(text), opening, -1)
    rows = pages.select(key, F.posexplode(F.arrays_zip(marks.alias("mark"), F.slice(parts, 2, 1 << 30).alias("body"))).alias("number", "b"))
    return rows.select(key, (F.col("number") + 1).alias("number"), F.col("b.mark").alias("mark"), F.col("b.body").alias("body")).where("mark IS NOT NULL")


def letters(pages: DataFrame, ranges: DataFrame) -> DataFrame:
    """Letters of pages (printed_page, raw_text) inside the given ranges (ord, program, page_start, page_end).

    They are numbered by range, page and place; a block counts if its header is understood and it states a subject. Pages in
    two ranges count in both.
    """
    wanted = ranges.select(F.col("ord").alias("range"), "program", F.explode(F.sequence("page_start", "page_end")).alias("printed_page"))
    inside = pages.select("printed_page", "raw_text").join(wanted.select("printed_page").distinct(), "printed_page", "left_semi")
    blocks = split_blocks(inside, "printed_page", "raw_text", "【[^】]+】").withColumns({"h": header_fields(F.col("mark")), "title": subject(F.col("body"))})
    found = blocks.where("h IS NOT NULL AND title IS NOT NULL").join(wanted, "printed_page")
    out = numbered_rows(found, "range", "printed_page", "number", name="ord")
    return out.select(
        X.numbered("interpretation", F.col("ord")).alias("id"), "program", "printed_page", "number", F.col("mark").alias("source_header"), "h.date", "h.document_number",
        "title", (F.col("printed_page") + 2).alias("pdf_page"),
    )


def classify_candidates(sources: DataFrame, detections: DataFrame) -> DataFrame:
    """Sources first, then detections: ord, canonical, page, subject, disposition and duplicate_of.

    The first row of a (number, page, subject) counts; later ones are duplicates of it. A first row whose number and page
    are among the sources is promoted, others await review.
    """
    both = sources.select(F.lit(0).alias("pass"), "ord", "canonical", "page", "subject").unionByName(detections.select(F.lit(1).alias("pass"), "ord", "canonical", "page", "subject"))
    both = numbered_rows(both.withColumnRenamed("ord", "_at"), "pass", "_at", name="ord").drop("_at").withColumn("id", X.numbered("candidate", F.col("ord")))
    w = Window.partitionBy("canonical", "page", X.normalize(F.col("subject"))).orderBy("ord")
    first = F.first("id").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    known = sources.select("canonical", "page").distinct().withColumn("known", F.lit(True))
    out = both.withColumn("rn", F.row_number().over(w)).withColumn("first_id", first).join(known, ["canonical", "page"], "left")
    kind = F.when(F.col("rn") > 1, "duplicate-detection").when(F.col("known"), "promoted-to-source-index").otherwise("pending-review")
    return out.select("id", "ord", "canonical", "page", "subject", kind.alias("disposition"), F.when(F.col("rn") > 1, F.col("first_id")).alias("duplicate_of"))


def form_titles(pages: DataFrame, key: str = "printed_page", text: str = "raw_text") -> DataFrame:
    """Lines that are a form's title, once for each page, in page and line order."""
    lines = pages.where(F.col(key).isNotNull()).select(key, F.posexplode(F.split(text, "\n")).alias("line", "raw")).withColumn("t", X.search_text(F.col("raw")))
    any_of = lambda words: F.col("t").rlike("|".join(words))
    lines = lines.where(F.length("t").between(5, 60) & any_of(FORM_WORDS))
    lines = lines.withColumn("t", F.trim(F.regexp_replace("t", r"^[一二三四五六七八九十、.．()（）0-9０-９\s]+", "")))
    lines = lines.where(~any_of(FORM_STOPS) & ~F.col("t").rlike("[，,；]") & (F.length("t") >= 5))
    first = lines.groupBy(key, "t").agg(F.min("line").alias("line"))
    numbered = numbered_rows(first, key, "line", name="ord")
    return numbered.select(X.numbered("form", F.col("ord")).alias("id"), key, F.col("t").alias("title"))


def promote_forms(candidates: DataFrame, whitelist: DataFrame, key: str = "printed_page") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Promoted candidates (all of a listed page), excluded ones, and listed pages without any (must be empty)."""
    listed = whitelist.select(key).distinct()
    return candidates.join(listed, key, "left_semi"), candidates.join(listed, key, "left_anti"), listed.join(candidates, key, "left_anti")


def question_marks(paragraphs: DataFrame) -> DataFrame:
    """Labels in paragraphs (group_id, unit, text): one row each, with the place of the label and its number."""
    flags = F.regexp_extract_all(F.col("text"), F.lit(MARKER), F.lit(1))
    rest = F.split(F.col("text"), MARKER, -1)
    rows = paragraphs.select("group_id", "unit", "text", F.posexplode(F.arrays_zip(flags.alias("label"), F.slice(rest, 2, 1 << 30).alias("after"))).alias("at", "m"))
    rows = rows.select("group_id", "unit", "at", F.col("m.label").alias("label"), F.col("m.after").alias("after"), X.numeral(F.col("m.label")).alias("number"), "text")
    return rows.where("number IS NOT NULL")


def questions(paragraphs: DataFrame) -> DataFrame:
    """Question and answer pairs of paragraphs (group_id, unit, text).

    A label counts if the text up to the next label's paragraph has an answer or question mark. A pair ends at the next label that
    counts or at the first phrase that ends the list, if that lies in a later paragraph; else at the group's end.
    """
    marks = question_marks(paragraphs)
    broken = F.lit(False)
    for phrase in SCOPE_BREAKS:
        broken = broken | F.contains(F.col("after"), F.lit(phrase))
    marks = marks.withColumn("is_break", broken)
    order = Window.partitionBy("group_id").orderBy("unit", "at")
    marks = marks.withColumn("next_unit", F.lead("unit").over(order))
    body = paragraphs.select(F.col("group_id").alias("g"), F.col("unit").alias("u"), F.col("text").alias("t"))

    def upto(rows: DataFrame, end: str) -> DataFrame:
        inside = rows.join(body, (F.col("group_id") == F.col("g")) & (F.col("u") > F.col("unit")) & (F.col(end).isNull() | (F.col("u") < F.col(end))), "left")
        more = inside.groupBy("group_id", "unit", "at").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("u", "t"))), lambda x: x["t"]), "\n").alias("more"))
        return rows.join(more, ["group_id", "unit", "at"]).withColumn("segment", F.concat_ws("\n", "after", F.nullif("more", F.lit("")))).drop("more")

    tried = upto(marks.where("NOT is_break"), "next_unit")
    counted = tried.where(F.col("segment").rlike(ANSWER) | F.col("segment").rlike(QUESTION_MARKS)).drop("segment", "next_unit")
    counted = counted.withColumn("next_kept", F.lead("unit").over(order))
    breaks = marks.where("is_break").select(F.col("group_id").alias("bg"), F.col("unit").alias("bu"))
    ends = counted.join(breaks, (F.col("group_id") == F.col("bg")) & (F.col("bu") >= F.col("unit")), "left").groupBy("group_id", "unit", "at").agg(F.min("bu").alias("break_unit"))
    later = lambda c: F.when(F.col(c) > F.col("unit"), F.col(c))
    bounded = counted.join(ends, ["group_id", "unit", "at"]).withColumn("end", F.least(later("next_kept"), later("break_unit")))
    out = upto(bounded, "end")
    parts = F.split("segment", ANSWER, 2)
    bare = lambda c: F.regexp_replace(c, f"^[{X.SPACE}]+|[{X.SPACE}]+$", "")
    answer = F.when(F.size(parts) > 1, X.heading_trimmed(bare(F.get(parts, F.lit(1)))))
    status = F.when(F.coalesce(answer, F.lit("")) == "", "start-only").otherwise("complete")
    return out.select("group_id", "number", "label", bare(F.get(parts, F.lit(0))).alias("question"), F.nullif(answer, F.lit("")).alias("answer"), F.col("unit").alias("start_unit"), F.col("end").alias("end_unit"), status.alias("range_status"))


def traceable(answer: Column, source: Column) -> Column:
    """Whether the answer stands in the source, white space aside."""
    return F.contains(X.compact(source), X.compact(answer))


def missing_numbers(items: DataFrame, group: str, number: str) -> DataFrame:
    """For each group the numbers from 1 to its largest that don't occur."""
    found = items.groupBy(group).agg(F.collect_set(number).alias("have"), F.max(number).alias("most"))
    return found.select(group, F.explode(F.array_except(F.expr("sequence(1, most)"), "have")).alias("missing"))


def earliest_marks(texts: DataFrame, tasks: DataFrame, paragraph_end: str = "\n") -> DataFrame:
    """For each owner and task the first paragraph (page, paragraph) with one of its markers, and the first such marker.

    texts: owner, page, text, read once for all tasks; tasks: task, task_ord, markers (array).
    """
    markers = tasks.select("task", F.posexplode("markers").alias("marker_ord", "marker"))
    found = marker_hits(texts.select("owner", "page", "text"), "text", markers.select("marker"), piece_end=paragraph_end)
    met = found.join(markers, "marker")
    best = met.groupBy("owner", "task").agg(F.min(F.struct("page", F.col("piece").alias("paragraph"), "marker_ord", "marker")).alias("b"))
    return best.select("owner", "task", "b.page", "b.paragraph", "b.marker")


def single_anchor(mappings: DataFrame) -> DataFrame:
    """page and anchor, where exactly one task is mapped to the page; else a null anchor."""
    return mappings.groupBy("page").agg(F.when(F.count("*") == 1, F.first("anchor")).alias("anchor"))
