"""Tables that a site is assembled from: pages, index records, projections, link targets, hubs and work pages.

Dimensions (loans, sections, groups) are small and named by id; facts (pages, letters, forms, updates) may be large. Joins
are left to Spark's choice by size.

Defined results: null ids meet nothing; empty arrays count 0; ties are broken by id; empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import unicode as U
from . import ownership as O

# Labels of index records, of relations without a loan, and patterns of pages whose layout matters.
KINDS = {"page": "原文頁面", "loan": "貸款索引", "interpretations": "函釋", "faq": "常見問答", "forms": "書表附件", "appendices": "附錄附件"}
DISASTER, COMMON, DEFAULT = "天然災害", "共同規定", "政策農貸"
COMPLEX = ("貸款項目 貸款額度", "貸款項目 貸款用途", "申請書", "審核表", "查驗紀錄", "檢核表", "切結書", "常見問答", "常見問題")


# --- paths and labels ------------------------------------------------------------------------------------------------


def padded_page(pdf_page: Column) -> Column:
    return F.format_string("page-%03d", pdf_page.cast("int"))


def evidence_url(pdf_page: Column) -> Column:
    return F.concat(F.lit("versions/114/pages/"), padded_page(pdf_page), F.lit(".html"))


def canonical_url(origin: str, path: Column) -> Column:
    """A folder's own page is named by the folder."""
    return F.concat(F.lit(origin), F.regexp_replace(path, "index\\.html$", ""))


def relative_path(source: Column, target: Column) -> Column:
    """``target`` as seen from the page ``source``: up over the folders that are not shared, then down."""
    a, b = F.split(source, "/"), F.split(target, "/")
    folders = F.slice(a, F.lit(1), F.size(a) - 1)
    same = F.transform(folders, lambda x, i: F.coalesce((x == F.get(b, i)) & (i < F.size(b) - 1), F.lit(False)))
    differ = F.filter(F.transform(same, lambda s, i: F.when(~s, i)), lambda i: i.isNotNull())
    shared = F.coalesce(F.array_min(differ), F.size(folders))
    up = F.array_repeat(F.lit(".."), F.size(folders) - shared)
    return F.array_join(F.concat(up, F.slice(b, shared + 1, F.size(b))), "/")


def url_path(url: Column) -> Column:
    return F.substring_index(F.substring_index(url, "#", 1), "?", 1)


def url_fragment(url: Column) -> Column:
    return F.when(F.contains(url, F.lit("#")), F.regexp_extract(url, "#(.*)$", 1)).otherwise(F.lit(""))


def url_page(url: Column) -> Column:
    """The page number in the name of an evidence page; null without one."""
    return F.nullif(F.regexp_extract(url_path(url), "page-([0-9]{3})\\.html$", 1), F.lit("")).cast("int")


def anchor_id(task: Column, page: Column) -> Column:
    return F.concat(F.lit("reading-"), task, F.lit("-"), page.cast("string"))


def group_label(group_id: Column, title: Column, special: dict[str, str]) -> Column:
    """A special group's own label, else the year and month in the title, else the title."""
    own = F.create_map(*[F.lit(x) for pair in special.items() for x in pair])[group_id] if special else F.lit(None)
    return F.coalesce(own, F.nullif(F.regexp_extract(title, "[0-9]+年[0-9]+月", 0), F.lit("")), title)


def relation_label(loan_titles: Column, section_ids: Column) -> Column:
    """Loans by name, else disaster rules, common rules or the rest."""
    has = lambda *ids: F.arrays_overlap(section_ids, F.array(*map(F.lit, ids)))
    return (
        F.when(F.size(loan_titles) > 0, F.array_join(loan_titles, "、"))
        .when(has("natural-disaster-rules"), DISASTER)
        .when(has("policy-loan-regulations", "agricultural-development-fund-rules"), COMMON)
        .otherwise(DEFAULT)
    )


# --- pages -----------------------------------------------------------------------------------------------------------


def page_map(spark: SparkSession, n_pages: int, front: int, anchors: DataFrame) -> DataFrame:
    """Every page of a book: pdf_page, printed_page, how it was mapped and whether it was checked (anchors: pdf_page)."""
    pages = spark.range(1, n_pages + 1).select(F.col("id").cast("int").alias("pdf_page"))
    checked = anchors.select(F.col("pdf_page").cast("int").alias("pdf_page")).distinct().withColumn("_hit", F.lit(True))
    out = pages.join(checked, "pdf_page", "left")
    return out.select(
        "pdf_page",
        X.printed_page(F.col("pdf_page"), front).alias("printed_page"),
        F.when(F.col("pdf_page") <= front, "front-matter").otherwise("continuous-offset").alias("mapping_method"),
        F.when(F.col("_hit"), "checked-anchor").otherwise("not-individually-checked").alias("verification_status"),
    )


def build_pages(raw: DataFrame, ranges: DataFrame, front: int = 2, nfkc=U.nfkc) -> DataFrame:
    """Page records of (pdf_page, raw_text): printed page, chapter, display and search text, whether there is text."""
    pages = raw.withColumn("printed_page", X.printed_page(F.col("pdf_page"), front))
    pages = O.chapter(pages, "printed_page", ranges)
    shown = X.display_text(F.col("raw_text"), F.col("printed_page"))
    pages = pages.withColumn("raw_text", shown).withColumn("search_text", X.search_text(F.col("raw_text"), nfkc))
    return pages.withColumn("has_text", F.length(X.squeeze(F.col("raw_text"))) > 0)


def unprinted_anchors(raw: DataFrame, anchors: DataFrame) -> DataFrame:
    """Anchors (pdf_page, printed_page) whose printed number isn't among the last eight lines of the page."""
    lines = F.split(F.coalesce("raw_text", F.lit("")), "\n", -1)
    tail = F.transform(U.nfkc_each(F.slice(lines, F.greatest(F.size(lines) - 7, F.lit(1)), F.lit(8))), lambda t: X.search_text(t, None))
    met = anchors.join(raw.select("pdf_page", tail.alias("_tail")), "pdf_page", "left")
    return met.where(~F.coalesce(F.array_contains("_tail", F.col("printed_page").cast("string")), F.lit(False))).drop("_tail")


def render_mode(printed_page: Column, search_text: Column, has_text: Column, forced: list[tuple[int, int]], patterns: tuple[str, ...] = COMPLEX) -> Column:
    """preview without text, hybrid where the layout matters (front matter, forced ranges, patterns), else text."""
    complex_ = printed_page.isNull()
    for a, b in forced:
        complex_ = complex_ | printed_page.between(a, b)
    for p in patterns:
        complex_ = complex_ | F.contains(search_text, F.lit(p))
    return F.when(~has_text, "preview").when(F.coalesce(complex_, F.lit(False)), "hybrid").otherwise("text")


def rendering_rules(pages: DataFrame) -> DataFrame:
    """Only the pages that aren't plain text, each with its reason."""
    reason = F.when(F.col("render_mode") == "hybrid", "layout").otherwise("no-text-layer")
    return pages.where("render_mode <> 'text'").select("pdf_page", "render_mode", reason.alias("reason"), F.lit("needs-review").alias("review_status"))


def review_status(found: DataFrame) -> DataFrame:
    """found: section, pdf_page, pending. For each section the distinct pages reviewed and pending, in order."""
    pages = lambda c: F.sort_array(F.collect_set(F.when(c, F.col("pdf_page"))))
    return found.groupBy("section").agg(pages(~F.col("pending")).alias("reviewed_pages"), pages(F.col("pending")).alias("pending_pages"))


def group_paragraphs(groups: DataFrame, pages: DataFrame) -> DataFrame:
    """group_id, unit and text: the paragraphs of the pages of each group (page_start, page_end), numbered in order."""
    met = O.interval_members(pages.select("printed_page", "raw_text"), "printed_page", groups.select("group_id", "page_start", "page_end"), "page_start", "page_end")
    flat = met.select("group_id", "printed_page", F.posexplode(X.paragraphs(F.col("raw_text"))).alias("at", "text"))
    return flat.select("group_id", (F.row_number().over(Window.partitionBy("group_id").orderBy("printed_page", "at")) - 1).alias("unit"), "text")


def placed_anchors(paragraphs: DataFrame, mappings: DataFrame) -> DataFrame:
    """paragraphs (pdf_page, paragraph, ...) with the anchors mapped to them, in the order of the mappings (ord)."""
    by = mappings.groupBy("pdf_page", "paragraph").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "anchor"))), lambda x: x["anchor"]).alias("anchors"))
    return paragraphs.join(by, ["pdf_page", "paragraph"], "left").withColumn("anchors", F.coalesce("anchors", F.array().cast("array<string>")))


def page_contexts(pages: DataFrame, loans: DataFrame, sections: DataFrame) -> DataFrame:
    """Pages with the loan that owns them (loan_url, loan_title) and the section (section_url, section_title), null without."""
    owned = O.first_owner(pages, "pdf_page", "printed_page", loans, "page_start", "page_end", "ord", "id", "loan_id")
    out = owned.join(loans.select(F.col("id").alias("loan_id"), F.col("title").alias("loan_title"), F.col("detail_url").alias("loan_url")), "loan_id", "left")
    s = sections.select(F.col("id").alias("chapter_id"), F.col("title").alias("section_title"))
    out = out.join(s, "chapter_id", "left")
    return out.withColumn("section_url", F.when(F.col("section_title").isNotNull(), F.concat(F.lit("versions/114/sections/"), "chapter_id", F.lit("/index.html"))))


def deep_links(contexts: DataFrame, mappings: DataFrame) -> DataFrame:
    """pdf_page and url: the loan's page at the one task mapped to the page, else the evidence page itself."""
    single = mappings.groupBy(F.col("pdf_page")).agg(F.when(F.count("*") == 1, F.first("anchor")).alias("anchor"))
    met = contexts.select("pdf_page", "loan_url").join(single, "pdf_page", "left")
    own = F.concat(evidence_url(F.col("pdf_page")), F.lit("#pdf-page-"), F.col("pdf_page").cast("string"))
    return met.select("pdf_page", F.coalesce(F.concat("loan_url", F.lit("#"), "anchor"), own).alias("url"))


# --- groups, letters, updates ----------------------------------------------------------------------------------------


def group_slugs(programs: DataFrame, loans: DataFrame, overrides: DataFrame, common: str, common_slug: str) -> DataFrame:
    """program and slug: the common one, a loan's override or its id. A program that is neither is an error."""
    named = programs.select("program").distinct().join(loans.select(F.col("title").alias("program"), F.col("id").alias("loan_id")), "program", "left")
    met = O.with_override(named, overrides, "loan_id", "slug", F.col("loan_id").cast("string"), alias="slug")
    unknown = F.raise_error(F.concat(F.lit("unknown program: "), F.col("program"))).cast("string")
    return met.select("program", F.when(F.col("program") == common, F.lit(common_slug)).when(F.col("loan_id").isNull(), unknown).otherwise(F.col("slug")).alias("slug"))


def program_order(programs: DataFrame, loans: DataFrame, common: str) -> DataFrame:
    """The programs that occur: the common one first, then in the order of the loans."""
    met = programs.select("program").distinct().join(loans.select(F.col("title").alias("program"), F.col("ord").alias("_at")), "program", "left")
    return met.withColumn("place", F.row_number().over(Window.orderBy((F.col("program") == common).desc(), "_at", "program"))).drop("_at")


def letter_projection(letters: DataFrame, slugs: DataFrame) -> DataFrame:
    """Letters for the lookup: a key for each (repeats numbered), program slug, year and evidence page."""
    again = F.row_number().over(Window.partitionBy("id").orderBy("ord"))
    key = F.when(again > 1, F.concat(F.col("id").cast("string"), F.lit("-duplicate-"), again.cast("string"))).otherwise(F.col("id").cast("string"))
    out = letters.withColumn("lookup_key", key).join(slugs, "program", "left")
    return out.withColumns({"year": X.roc_year(F.col("date")), "evidence_url": evidence_url(F.col("pdf_page"))})


def update_projection(updates: DataFrame, loans: DataFrame, sections: DataFrame, labels: dict[str, str]) -> DataFrame:
    """Updates for the lookup: label of the type, event date and year, titles of loans and sections, relation."""
    named = O.titles_of(updates, "id", "loan_ids", loans.select("id", "title"), "loan_titles")
    of = O.titles_of(updates, "id", "section_ids", sections.select("id", "title"), "section_titles")
    none = F.array().cast("array<string>")
    out = updates.join(named, "id", "left").join(of, "id", "left").withColumns({"loan_titles": F.coalesce("loan_titles", none), "section_titles": F.coalesce("section_titles", none)})
    event = F.coalesce(X.event_date(F.col("published"), F.col("effective"), F.col("version_date")), F.lit(""))
    label = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])[F.col("source_type")]
    return out.withColumns({"type_label": label, "event_date": event, "lookup_year": F.substring(event, 1, 4), "relation": relation_label(F.col("loan_titles"), F.col("section_ids"))})


# Words of a notice that goes beyond a single disaster.
BEYOND = ("免息", "利息", "展延", "規定", "辦法", "表單", "證明書", "專案")


def routine_notice(source_type: Column, title: Column) -> Column:
    """Announcements of loans after a single disaster, which the gateway shows and the index leaves out."""
    about = (source_type == "announcement") & F.contains(title, F.lit("天然災害")) & F.contains(title, F.lit("低利貸款"))
    return F.coalesce(about & ~title.rlike("|".join(BEYOND)), F.lit(False))


def owners_of(rows: DataFrame, key: str, ids: str, owners: DataFrame) -> DataFrame:
    """key and id of every owner named in an array column; unknown and repeated ones are left out."""
    flat = rows.select(key, F.explode(ids).alias("id")).distinct()
    return flat.join(owners.select("id"), "id")


def counts_per_owner(owners: DataFrame, **facts: DataFrame) -> DataFrame:
    """Owners (id) with a number for each kind of fact (tables with an id column that names the owner); 0 without any."""
    out = owners
    for name, rows in facts.items():
        n = rows.where("id IS NOT NULL").groupBy("id").agg(F.count("*").alias(name))
        out = out.join(n, "id", "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("long"))
    return out


# --- targets, hubs, work pages ---------------------------------------------------------------------------------------


def toc_targets(toc: DataFrame, loans: DataFrame, section_paths: DataFrame, slugs: DataFrame) -> DataFrame:
    """Rows of a table of contents (id, kind) with the page each leads to, by the first rule that fits; null without one."""
    met = toc.join(loans.select(F.col("id"), F.lit(True).alias("_loan")), "id", "left").join(section_paths.select("id", F.col("path").alias("_path")), "id", "left")
    base = F.regexp_replace("id", "-interpretations$", "")
    met = met.withColumn("_base", base).join(slugs.select(F.col("id").alias("_base"), F.col("slug").alias("_slug")), "_base", "left")
    target = (
        F.when(F.col("_loan"), F.concat(F.lit("loans/"), "id", F.lit("/index.html")))
        .when(F.col("_path").isNotNull(), F.col("_path"))
        .when(F.col("kind") == "interpretation", F.concat(F.lit("interpretations/index.html#group-"), F.coalesce("_slug", "_base")))
        .when(F.col("id") == "natural-disaster-rules", F.lit("versions/114/sections/natural-disaster-rules/index.html"))
        .when(F.col("kind") == "faq", F.concat(F.lit("faq/index.html#item-"), "id"))
        .when(F.col("kind").isin("appendix", "attachment"), F.concat(F.lit("forms/index.html#item-"), "id"))
    )
    return met.withColumn("target", target).drop("_loan", "_path", "_base", "_slug")


def quick_index(groups: DataFrame, loans: DataFrame, aliases: DataFrame) -> DataFrame:
    """groups (group_ord, title, items: array<struct<id, title>>) row by row, each item with the page it leads to."""
    flat = groups.select("group_ord", F.col("title").alias("group_title"), F.posexplode("items").alias("item_ord", "i")).select("group_ord", "group_title", "item_ord", "i.*")
    met = flat.join(loans.select("id", F.lit(True).alias("_loan")), "id", "left").join(aliases.select("id", F.col("section_id").alias("_section")), "id", "left")
    target = (
        F.when(F.col("_loan"), F.concat(F.lit("loans/"), "id", F.lit("/index.html")))
        .when(F.col("id").isin("interpretations", "faq", "forms"), F.concat("id", F.lit("/index.html")))
        .when(F.col("id") == "appendices", F.lit("forms/index.html"))
        .otherwise(F.concat(F.lit("versions/114/sections/"), F.coalesce("_section", "id"), F.lit("/index.html")))
    )
    return met.withColumn("target", target).drop("_loan", "_section")


def shortcuts(rows: DataFrame, context: str) -> DataFrame:
    """Shortcuts whose list of kinds names the context, in their order."""
    return rows.where(F.array_contains(F.transform(F.split("kind", ","), lambda k: F.trim(k)), context)).orderBy("order", "id")


def section_hubs(sections: DataFrame, pages: DataFrame, updates: DataFrame) -> DataFrame:
    """Sections with their pages, first page and updates. sections: id, page_start, page_end; updates: id, section_ids."""
    inside = O.interval_members(pages.select("pdf_page", "printed_page"), "printed_page", sections.select("id", "page_start", "page_end"), "page_start", "page_end")
    n = inside.groupBy("id").agg(F.count("*").alias("n_pages"), F.min("pdf_page").alias("first_page"))
    told = owners_of(updates.withColumnRenamed("id", "update_id"), "update_id", "section_ids", sections)
    out = counts_per_owner(sections.join(n, "id", "left"), n_updates=told)
    return out.withColumn("n_pages", F.coalesce("n_pages", F.lit(0)).cast("long"))


def work_pages(loans: DataFrame, pages: DataFrame, tasks: DataFrame, letters: DataFrame, forms: DataFrame, updates: DataFrame) -> DataFrame:
    """A row for each loan: its pages, mapped tasks, letters, forms and updates, and its first page.

    loans: id, page_start, page_end; tasks, letters, forms: id of the loan; updates: id, loan_ids.
    """
    inside = O.interval_members(pages.select("pdf_page", "printed_page"), "printed_page", loans.select("id", "page_start", "page_end"), "page_start", "page_end").select("id", "pdf_page")
    told = owners_of(updates.withColumnRenamed("id", "update_id"), "update_id", "loan_ids", loans)
    out = counts_per_owner(loans, n_pages=inside, n_tasks=tasks, n_letters=letters, n_forms=forms, n_updates=told)
    return out.join(inside.groupBy("id").agg(F.min("pdf_page").alias("first_page")), "id", "left")


# --- the search index ------------------------------------------------------------------------------------------------


def index_record(rows: DataFrame, kind: str, **columns: Column) -> DataFrame:
    """Records of one kind: id, type, title, text, headings, breadcrumb, scope, scope_group, pdf_page, printed_page, url and more.

    Type, headings and breadcrumb follow from the kind and the title where they aren't given.
    """
    given = {"type": F.lit(KINDS[kind]), "headings": F.array(columns["title"]), "breadcrumb": F.array(F.lit(KINDS[kind]), columns["title"])} | columns
    return rows.select(*[c.alias(name) for name, c in given.items()])


def search_index(pages: DataFrame, loans: DataFrame, letters: DataFrame, faq: DataFrame, forms: DataFrame, appendices: DataFrame) -> DataFrame:
    """All six kinds as search records, with owners and deep links, numbered by kind and id in ``kind_ord``.

    pages: pdf_page, printed_page, title, search_text, chapter_id, loan_id, url; loans: id, title, category, page_start,
    detail_url; letters: id, title, document_number, date, program, slug, pdf_page, loan_id; faq, appendices: id, title,
    pdf_page; forms: id, title, pdf_page, loan_id.
    """
    c, text = F.col, lambda *parts: F.concat_ws(" ", *parts)
    loan_scope = lambda i: F.when(i.isNotNull(), F.concat(F.lit("loan:"), i.cast("string")))
    item = lambda folder: F.concat(F.lit(f"{folder}/index.html#item-"), c("id").cast("string"))
    key = lambda prefix, i="id": F.concat(F.lit(f"{prefix}-"), c(i).cast("string"))
    label = lambda kind: F.lit(KINDS[kind])
    printed = F.coalesce(c("printed_page").cast("string"), F.lit("目錄"))
    parts = [
        index_record(
            pages, "page", id=padded_page(c("pdf_page")), title=c("title"), scope=F.coalesce(loan_scope(c("loan_id")), F.concat(F.lit("section:"), c("chapter_id"))), scope_group=loan_scope(c("loan_id")), pdf_page=c("pdf_page"), url=c("url"),
            text=text(c("title"), F.replace(c("search_text"), F.lit("日農授金字第"), F.lit("日 農授金字第")), F.lit("手冊頁"), printed, F.lit("PDF頁"), c("pdf_page").cast("string")),
        ),
        index_record(
            loans, "loan", id=key("loan"), title=c("title"), scope=loan_scope(c("id")), scope_group=loan_scope(c("id")), pdf_page=c("page_start") + 2, url=c("detail_url"),
            text=text(c("title"), c("category"), F.lit("函釋 原文 手冊頁"), c("page_start").cast("string")),
        ),
        index_record(
            letters, "interpretations", id=key("interpretations"), title=c("title"), scope=F.concat(F.lit("interpretation-group:"), c("slug")), scope_group=loan_scope(c("loan_id")), pdf_page=c("pdf_page"), url=item("interpretations"),
            text=text(c("title"), c("document_number"), c("date"), c("program"), label("interpretations"), c("pdf_page").cast("string")), document_number=c("document_number"), date=c("date"), loan_program=c("program"),
        ),
        index_record(faq, "faq", id=key("faq"), title=c("title"), scope=F.concat(F.lit("faq:"), c("id").cast("string")), scope_group=F.lit(None).cast("string"), pdf_page=c("pdf_page"), url=item("faq"), text=text(c("title"), label("faq"), c("pdf_page").cast("string"))),
        index_record(forms, "forms", id=key("forms"), title=c("title"), scope=F.coalesce(loan_scope(c("loan_id")), F.lit("form:common")), scope_group=loan_scope(c("loan_id")), pdf_page=c("pdf_page"), url=item("forms"), text=text(c("title"), label("forms"), c("pdf_page").cast("string"))),
        index_record(appendices, "appendices", id=key("forms"), title=c("title"), scope=F.lit("appendix"), scope_group=F.lit(None).cast("string"), pdf_page=c("pdf_page"), url=item("forms"), text=text(c("title"), label("appendices"), c("pdf_page").cast("string"))),
    ]
    return O.union_index(*parts).withColumnRenamed("_kind", "kind_ord")
