"""Registered queries of the site's tables and of the rules that hold them together, with their SQL.

Nations stand in for loans (fourteen pages each), regions for sections, documents for pages, customers for letters,
suppliers for forms, events for updates and parts for the rows of a table of contents. Rules are asked of tables that have
faults, so every query finds some.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import ownership as O
from ..operators import search as S
from ..operators import site as W
from ..operators import validation as V
from ..sources import readers
from .catalogue import RANK_SQL, records, registered, scored_sql, table


def loans(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_nationkey")
    return table(spark, d, "nation").select(
        n.alias("ord"), n.cast("string").alias("id"), F.col("n_name").alias("title"), F.col("n_regionkey").cast("string").alias("category"), (n * 14 + 1).alias("page_start"), (n * 14 + 12).alias("page_end"), F.concat(F.lit("loans/"), n.cast("string"), F.lit("/index.html")).alias("detail_url")
    )


LOANS = "loans AS (SELECT n_nationkey AS ord, CAST(n_nationkey AS VARCHAR) AS id, n_name AS title, CAST(n_regionkey AS VARCHAR) AS category, n_nationkey * 14 + 1 AS page_start, n_nationkey * 14 + 12 AS page_end, 'loans/' || n_nationkey || '/index.html' AS detail_url FROM nation)"


def sections(spark: SparkSession, d: str) -> DataFrame:
    r = F.col("r_regionkey")
    return table(spark, d, "region").select(r.alias("ord"), F.concat(F.lit("s"), r.cast("string")).alias("id"), F.col("r_name").alias("title"), (r * 80 + 1).alias("page_start"), (r * 80 + 70).alias("page_end"))


SECTIONS = "sections AS (SELECT r_regionkey AS ord, 's' || r_regionkey AS id, r_name AS title, r_regionkey * 80 + 1 AS page_start, r_regionkey * 80 + 70 AS page_end FROM region)"


def pages(spark: SparkSession, d: str) -> DataFrame:
    p = (F.col("doc_id") + 1).cast("int")
    text = F.concat(F.col("text"), F.lit("\n "), F.col("doc_id").cast("string"), F.lit(" "))
    return table(spark, d, "documents").select(p.alias("pdf_page"), X.printed_page(p).alias("printed_page"), text.alias("raw_text"), F.col("lang"))


PAGES = "pages AS (SELECT CAST(doc_id + 1 AS INTEGER) AS pdf_page, CASE WHEN doc_id + 1 > 2 THEN CAST(doc_id - 1 AS INTEGER) END AS printed_page, text || chr(10) || ' ' || doc_id || ' ' AS raw_text, lang FROM documents)"


def updates(spark: SparkSession, d: str) -> DataFrame:
    u, day = F.col("user_id"), F.col("ts").cast("date").cast("string")
    ids = F.when(u % 5 == 0, F.array().cast("array<string>")).otherwise(F.array((u % 25).cast("string"), (u % 31).cast("string")))
    parts = F.when(u % 2 == 0, F.array(F.lit("natural-disaster-rules"))).when(u % 3 == 0, F.array(F.lit("s1"), F.lit("s9"))).otherwise(F.array(F.lit("policy-loan-regulations")))
    return table(spark, d, "events").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("source_type"), F.when(u % 4 != 0, day).alias("published"), day.alias("effective"), F.lit(None).cast("string").alias("version_date"), ids.alias("loan_ids"), parts.alias("section_ids")
    )


UPDATES = """updates AS (SELECT event_id AS id, event_type AS source_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day,
    CASE WHEN user_id % 5 = 0 THEN []::VARCHAR[] ELSE [CAST(user_id % 25 AS VARCHAR), CAST(user_id % 31 AS VARCHAR)] END AS loan_ids,
    CASE WHEN user_id % 2 = 0 THEN ['natural-disaster-rules'] WHEN user_id % 3 = 0 THEN ['s1', 's9'] ELSE ['policy-loan-regulations'] END AS section_ids FROM events)"""


def letters(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    c = table(spark, d, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select(
        k.alias("ord"), (k % 997).alias("id"), F.col("c_mktsegment").alias("title"), F.col("c_name").alias("document_number"), F.concat((k % 20 + 90).cast("string"), F.lit("年1月2日")).alias("date"), F.col("n_name").alias("program"), F.col("c_nationkey").cast("string").alias("loan_id"), (k % 400 + 1).cast("int").alias("pdf_page")
    )


LETTERS = "letters AS (SELECT c_custkey AS ord, c_custkey % 997 AS id, c_mktsegment AS title, c_name AS document_number, (c_custkey % 20 + 90) || '年1月2日' AS date, n_name AS program, CAST(c_nationkey AS VARCHAR) AS loan_id, CAST(c_custkey % 400 + 1 AS INTEGER) AS pdf_page FROM customer JOIN nation ON c_nationkey = n_nationkey)"


def _overrides(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("3", "third"), ("4", "fourth")], "loan_id string, slug string")


def slugs(spark: SparkSession, d: str) -> DataFrame:
    return W.group_slugs(letters(spark, d), loans(spark, d), _overrides(spark), "ALGERIA", "common")


SLUG = "CASE WHEN program = 'ALGERIA' THEN 'common' WHEN loan_id = '3' THEN 'third' WHEN loan_id = '4' THEN 'fourth' ELSE loan_id END"


# --- pages -----------------------------------------------------------------------------------------------------------


@registered(
    """SELECT CAST(p AS INTEGER) AS pdf_page, CASE WHEN p > 2 THEN CAST(p - 2 AS INTEGER) END AS printed_page, CASE WHEN p <= 2 THEN 'front-matter' ELSE 'continuous-offset' END AS mapping_method,
    CASE WHEN p IN (SELECT doc_id FROM labels) THEN 'checked-anchor' ELSE 'not-individually-checked' END AS verification_status FROM range(1, 360) t(p)"""
)
def page_map(spark, d):
    return W.page_map(spark, 359, 2, table(spark, d, "labels").select(F.col("doc_id").alias("pdf_page")))


_RANGES = "coalesce((SELECT arg_min(id, ord) FROM sections WHERE printed_page BETWEEN page_start AND page_end), 'unassigned')"


@registered(
    f"""WITH {SECTIONS}, {PAGES} SELECT pdf_page, printed_page, CASE WHEN printed_page IS NULL THEN 'front-matter' ELSE {_RANGES} END AS chapter_id, true AS has_text,
    raw_text <> '' AND printed_page IS NOT NULL AND doc_id = printed_page AS number_stood FROM pages JOIN documents ON doc_id + 1 = pdf_page"""
)
def built_pages(spark, d):
    ranges = sections(spark, d).select("ord", F.col("id").alias("slug"), F.col("page_start").alias("low"), F.col("page_end").alias("high"))
    raw = pages(spark, d).select("pdf_page", "raw_text", F.col("raw_text").alias("before"))
    built = W.build_pages(raw, ranges)
    return built.select("pdf_page", "printed_page", "chapter_id", "has_text", F.coalesce(F.col("pdf_page") - 1 == F.col("printed_page"), F.lit(False)).alias("number_stood"))


@registered(f"WITH {PAGES} SELECT pdf_page, printed_page FROM pages WHERE printed_page IS NOT NULL AND NOT list_contains(list_transform(string_split(raw_text, chr(10))[-8:], lambda x: trim(x)), CAST(printed_page AS VARCHAR))")
def unprinted_anchors(spark, d):
    p = pages(spark, d)
    return W.unprinted_anchors(p, p.where("printed_page IS NOT NULL").select("pdf_page", "printed_page")).select("pdf_page", "printed_page")


_MODE = "CASE WHEN lang = 'fr' THEN 'preview' WHEN printed_page IS NULL OR printed_page BETWEEN 15 AND 29 OR printed_page BETWEEN 309 AND 357 OR contains(raw_text, 'License') THEN 'hybrid' ELSE 'text' END"


@registered(f"WITH {PAGES}, m AS (SELECT pdf_page, {_MODE} AS render_mode FROM pages) SELECT pdf_page, render_mode, CASE render_mode WHEN 'hybrid' THEN 'layout' ELSE 'no-text-layer' END AS reason, 'needs-review' AS review_status FROM m WHERE render_mode <> 'text'")
def rendering_rules(spark, d):
    mode = W.render_mode(F.col("printed_page"), F.col("raw_text"), F.col("lang") != "fr", [(15, 29), (309, 357)], ("License",))
    return W.rendering_rules(pages(spark, d).withColumn("render_mode", mode))


@registered("""SELECT source AS section, array_to_string(list_sort(list_distinct(list(n_chars % 97) FILTER (WHERE lang = 'en'))), ',') AS reviewed, coalesce(array_to_string(list_sort(list_distinct(list(n_chars % 97) FILTER (WHERE lang <> 'en'))), ','), '') AS pending FROM documents GROUP BY source""")
def review_status(spark, d):
    found = table(spark, d, "documents").select(F.col("source").alias("section"), (F.col("n_chars") % 97).alias("pdf_page"), (F.col("lang") != "en").alias("pending"))
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return W.review_status(found).select("section", joined("reviewed_pages").alias("reviewed"), joined("pending_pages").alias("pending"))


@registered(
    f"""WITH {LOANS}, {SECTIONS}, {PAGES}, c AS (SELECT pdf_page, printed_page, CASE WHEN printed_page IS NULL THEN 'front-matter' ELSE {_RANGES} END AS chapter_id FROM pages)
SELECT pdf_page, (SELECT arg_min(title, ord) FROM loans WHERE printed_page BETWEEN page_start AND page_end) AS loan_title, (SELECT arg_min(detail_url, ord) FROM loans WHERE printed_page BETWEEN page_start AND page_end) AS loan_url,
    s.title AS section_title, CASE WHEN s.id IS NOT NULL THEN 'versions/114/sections/' || s.id || '/index.html' END AS section_url FROM c LEFT JOIN sections s ON s.id = c.chapter_id"""
)
def page_contexts(spark, d):
    return _contexts(spark, d).select("pdf_page", "loan_title", "loan_url", "section_title", "section_url")


def _contexts(spark: SparkSession, d: str) -> DataFrame:
    ranges = sections(spark, d).select("ord", F.col("id").alias("slug"), F.col("page_start").alias("low"), F.col("page_end").alias("high"))
    return W.page_contexts(O.chapter(pages(spark, d), "printed_page", ranges), loans(spark, d), sections(spark, d))


def _mappings(spark: SparkSession, d: str) -> DataFrame:
    """Tasks mapped to pages: suppliers, on the pages of their keys."""
    s = table(spark, d, "supplier")
    return s.select(((F.col("s_suppkey") * F.col("s_suppkey")) % 300 + 1).cast("int").alias("pdf_page"), (F.col("s_suppkey") % 3).cast("int").alias("paragraph"), F.col("s_suppkey").alias("ord"), W.anchor_id(F.lit("t"), F.col("s_suppkey")).alias("anchor"))


_MAPPINGS = "mappings AS (SELECT CAST((s_suppkey * s_suppkey) % 300 + 1 AS INTEGER) AS pdf_page, CAST(s_suppkey % 3 AS INTEGER) AS paragraph, s_suppkey AS ord, 'reading-t-' || s_suppkey AS anchor FROM supplier)"
_URL = "coalesce((SELECT arg_min(detail_url, ord) FROM loans WHERE printed_page BETWEEN page_start AND page_end) || '#' || (SELECT CASE WHEN count(*) = 1 THEN min(anchor) END FROM mappings m WHERE m.pdf_page = pages.pdf_page), 'versions/114/pages/page-' || printf('%03d', pdf_page) || '.html#pdf-page-' || pdf_page)"


@registered(f"WITH {LOANS}, {PAGES}, {_MAPPINGS} SELECT pdf_page, {_URL} AS url FROM pages")
def deep_links(spark, d):
    return W.deep_links(_contexts(spark, d), _mappings(spark, d))


@registered(f"WITH {LOANS}, {PAGES}, {_MAPPINGS}, t AS (SELECT pdf_page, {_URL} AS url FROM pages) SELECT pdf_page FROM t WHERE url <> 'versions/114/pages/page-' || printf('%03d', pdf_page) || '.html#pdf-page-' || pdf_page")
def deep_link_faults(spark, d):
    """Records that all name their evidence page, against the links that their mappings call for."""
    stated = pages(spark, d).select("pdf_page", F.concat(W.evidence_url(F.col("pdf_page")), F.lit("#pdf-page-"), F.col("pdf_page").cast("string")).alias("url"))
    return V.changed(stated, W.deep_links(_contexts(spark, d), _mappings(spark, d)), "pdf_page", "url")


@registered(
    f"""WITH {_MAPPINGS}, l AS (SELECT CAST(doc_id + 1 AS INTEGER) AS pdf_page, CAST(unnest(range(len(string_split(text, chr(10))))) AS INTEGER) AS paragraph FROM documents)
SELECT l.pdf_page, l.paragraph, coalesce((SELECT string_agg(anchor, ' ' ORDER BY ord) FROM mappings m WHERE m.pdf_page = l.pdf_page AND m.paragraph = l.paragraph), '') AS anchors FROM l"""
)
def placed_anchors(spark, d):
    lines = table(spark, d, "documents").select((F.col("doc_id") + 1).cast("int").alias("pdf_page"), F.posexplode(F.split("text", "\n", -1)).alias("paragraph", "line"))
    return W.placed_anchors(lines, _mappings(spark, d)).select("pdf_page", "paragraph", F.array_join("anchors", " ").alias("anchors"))


@registered(f"WITH {LOANS}, {PAGES} SELECT id AS group_id, count(*) AS n, min(pdf_page) AS first_page FROM loans JOIN pages ON printed_page BETWEEN page_start AND page_end GROUP BY id")
def group_pages(spark, d):
    """Paragraphs of the pages of each group; every page here is one paragraph."""
    p = pages(spark, d).select("printed_page", F.concat(F.lit("p"), F.col("pdf_page").cast("string")).alias("raw_text"))
    units = W.group_paragraphs(loans(spark, d).select(F.col("id").alias("group_id"), "page_start", "page_end"), p)
    return units.groupBy("group_id").agg(F.count("*").alias("n"), F.min(F.substring("text", 2, 9).cast("int")).alias("first_page"))


# --- groups, letters, updates ----------------------------------------------------------------------------------------


@registered(f"WITH {LETTERS} SELECT DISTINCT program, {SLUG} AS slug FROM letters")
def group_slugs(spark, d):
    return slugs(spark, d)


@registered(f"WITH {LETTERS}, p AS (SELECT DISTINCT program, loan_id FROM letters) SELECT program, CAST(row_number() OVER (ORDER BY program = 'KENYA' DESC, CAST(loan_id AS INTEGER)) AS INTEGER) AS place FROM p")
def program_order(spark, d):
    return W.program_order(letters(spark, d), loans(spark, d), "KENYA").select("program", "place")


@registered(
    f"""WITH {LETTERS} SELECT ord, CASE WHEN row_number() OVER (PARTITION BY id ORDER BY ord) > 1 THEN id || '-duplicate-' || row_number() OVER (PARTITION BY id ORDER BY ord) ELSE CAST(id AS VARCHAR) END AS lookup_key,
    {SLUG} AS slug, CAST(ord % 20 + 90 AS VARCHAR) AS year, 'versions/114/pages/page-' || printf('%03d', pdf_page) || '.html' AS evidence_url FROM letters"""
)
def letter_projection(spark, d):
    return W.letter_projection(letters(spark, d), slugs(spark, d)).select("ord", "lookup_key", "slug", "year", "evidence_url")


LABELS = {"click": "Click", "view": "View", "error": "Fault"}
_RELATION = "CASE WHEN titles <> '' THEN titles WHEN list_contains(section_ids, 'natural-disaster-rules') THEN '天然災害' WHEN list_contains(section_ids, 'policy-loan-regulations') THEN '共同規定' ELSE '政策農貸' END"
_PROJECTED = f"""{LOANS}, {UPDATES}, flat AS (SELECT id, unnest(loan_ids) AS loan, generate_subscripts(loan_ids, 1) AS place FROM updates),
named AS (SELECT flat.id, string_agg(title, '、' ORDER BY place) AS titles FROM flat JOIN loans ON loans.id = loan GROUP BY flat.id),
p AS (SELECT u.*, coalesce(titles, '') AS titles FROM updates u LEFT JOIN named USING (id))"""


@registered(f"WITH {_PROJECTED} SELECT id, CASE source_type WHEN 'click' THEN 'Click' WHEN 'view' THEN 'View' WHEN 'error' THEN 'Fault' END AS type_label, day AS event_date, substr(day, 1, 4) AS lookup_year, {_RELATION} AS relation FROM p")
def update_projection(spark, d):
    out = W.update_projection(updates(spark, d), loans(spark, d), sections(spark, d), LABELS)
    return out.select("id", "type_label", "event_date", "lookup_year", "relation")


@registered(f"WITH {LOANS}, {UPDATES} SELECT DISTINCT u.id AS update_id, l.id AS id FROM (SELECT id, unnest(loan_ids) AS loan FROM updates) u JOIN loans l ON l.id = loan")
def updates_of_loans(spark, d):
    return W.owners_of(updates(spark, d).withColumnRenamed("id", "update_id"), "update_id", "loan_ids", loans(spark, d)).select("update_id", "id")


@registered("SELECT CAST(n_nationkey AS VARCHAR) AS id, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS n_letters, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS n_forms FROM nation")
def loan_counts(spark, d):
    forms = table(spark, d, "supplier").select(F.col("s_nationkey").cast("string").alias("id"))
    return W.counts_per_owner(loans(spark, d).select("id"), n_letters=letters(spark, d).select(F.col("loan_id").alias("id")), n_forms=forms)


@registered(
    """WITH s AS (SELECT event_id AS id, CAST(CASE WHEN contains(lower(event_type), 'c') THEN 80000 ELSE 0 END AS BIGINT) AS score, CASE WHEN user_id % 4 <> 0 THEN CAST(CAST(ts AS DATE) AS VARCHAR) END AS event_date FROM events)
SELECT id, score, CAST(row_number() OVER (ORDER BY score DESC, coalesce(event_date, '') DESC, id) AS INTEGER) AS rank FROM s WHERE score > 0"""
)
def update_order(spark, d):
    from ..operators import lookup as L

    u = updates(spark, d).withColumn("event_date", F.col("published")).withColumn("ord", F.col("id"))
    none = F.lit("")
    found = L.scored_rows(u, F.lit("C"), L.update_score(F.lit("C"), F.col("source_type"), none, none, none, none))
    from pyspark.sql import Window

    return found.select("id", "score", F.row_number().over(Window.orderBy(*L.update_order())).alias("rank"))


# --- targets, hubs, work pages ---------------------------------------------------------------------------------------

_KIND = "CASE p_size % 5 WHEN 0 THEN 'interpretation' WHEN 1 THEN 'faq' WHEN 2 THEN 'appendix' WHEN 3 THEN 'attachment' ELSE 'chapter' END"
_TOC = f"toc AS (SELECT p_partkey, {_KIND} AS kind, CASE WHEN p_partkey < 30 THEN CAST(p_partkey AS VARCHAR) WHEN p_partkey < 60 THEN 's' || (p_partkey % 7) WHEN p_size % 5 = 0 THEN (p_partkey % 40) || '-interpretations' WHEN p_partkey % 11 = 0 THEN 'natural-disaster-rules' ELSE 'i' || p_partkey END AS id FROM part)"


@registered(
    f"""WITH {LOANS}, {SECTIONS}, {_TOC} SELECT p_partkey, CASE WHEN toc.id IN (SELECT id FROM loans) THEN 'loans/' || toc.id || '/index.html' WHEN toc.id IN (SELECT id FROM sections) THEN 'sections/' || toc.id
    WHEN kind = 'interpretation' THEN 'interpretations/index.html#group-' || CASE regexp_replace(toc.id, '-interpretations$', '') WHEN '3' THEN 'third' WHEN '4' THEN 'fourth' ELSE regexp_replace(toc.id, '-interpretations$', '') END
    WHEN toc.id = 'natural-disaster-rules' THEN 'versions/114/sections/natural-disaster-rules/index.html' WHEN kind = 'faq' THEN 'faq/index.html#item-' || toc.id WHEN kind IN ('appendix', 'attachment') THEN 'forms/index.html#item-' || toc.id END AS target FROM toc"""
)
def toc_targets(spark, d):
    k, kinds = F.col("p_partkey"), ["interpretation", "faq", "appendix", "attachment", "chapter"]
    name = F.when(k < 30, k.cast("string")).when(k < 60, F.concat(F.lit("s"), (k % 7).cast("string"))).when(F.col("p_size") % 5 == 0, F.concat((k % 40).cast("string"), F.lit("-interpretations")))
    name = name.when(k % 11 == 0, "natural-disaster-rules").otherwise(F.concat(F.lit("i"), k.cast("string")))
    toc = table(spark, d, "part").select("p_partkey", F.get(F.array(*map(F.lit, kinds)), F.col("p_size") % 5).alias("kind"), name.alias("id"))
    paths = sections(spark, d).select("id", F.concat(F.lit("sections/"), "id").alias("path"))
    return W.toc_targets(toc, loans(spark, d), paths, _overrides(spark).withColumnRenamed("loan_id", "id")).select("p_partkey", "target")


@registered(
    """WITH i AS (SELECT n_regionkey AS group_ord, CASE WHEN n_nationkey % 6 = 0 THEN 'faq' WHEN n_nationkey % 6 = 1 THEN 'appendices' WHEN n_nationkey % 6 = 2 THEN 'fund-operating-rules' WHEN n_nationkey % 6 = 3 THEN 'x' ELSE CAST(n_nationkey AS VARCHAR) END AS id, n_name AS title FROM nation)
SELECT r_name AS group_title, title, CASE WHEN id = 'faq' THEN 'faq/index.html' WHEN id = 'appendices' THEN 'forms/index.html' WHEN id = 'fund-operating-rules' THEN 'versions/114/sections/agricultural-development-fund-rules/index.html'
    WHEN id = 'x' THEN 'versions/114/sections/x/index.html' ELSE 'loans/' || id || '/index.html' END AS target FROM i JOIN region ON r_regionkey = group_ord"""
)
def quick_index(spark, d):
    n, k = table(spark, d, "nation"), F.col("n_nationkey")
    name = F.when(k % 6 == 0, "faq").when(k % 6 == 1, "appendices").when(k % 6 == 2, "fund-operating-rules").when(k % 6 == 3, "x").otherwise(k.cast("string"))
    items = n.groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.sort_array(F.collect_list(F.struct(name.alias("id"), F.col("n_name").alias("title")))).alias("items"))
    groups = items.join(table(spark, d, "region"), "r_regionkey").select(F.col("r_regionkey").alias("group_ord"), F.col("r_name").alias("title"), "items")
    aliases = spark.createDataFrame([("fund-operating-rules", "agricultural-development-fund-rules")], "id string, section_id string")
    return W.quick_index(groups, loans(spark, d), aliases).select("group_title", "title", "target")


@registered(
    f"""WITH {SECTIONS}, {PAGES}, {UPDATES} SELECT id, (SELECT count(*) FROM pages WHERE printed_page BETWEEN page_start AND page_end) AS n_pages, (SELECT min(pdf_page) FROM pages WHERE printed_page BETWEEN page_start AND page_end) AS first_page,
    (SELECT count(*) FROM updates u WHERE list_contains(u.section_ids, sections.id)) AS n_updates FROM sections"""
)
def section_hubs(spark, d):
    return W.section_hubs(sections(spark, d), pages(spark, d), updates(spark, d)).select("id", "n_pages", "first_page", "n_updates")


@registered(
    f"""WITH {LOANS}, {PAGES}, {UPDATES} SELECT id, (SELECT count(*) FROM pages WHERE printed_page BETWEEN page_start AND page_end) AS n_pages, (SELECT min(pdf_page) FROM pages WHERE printed_page BETWEEN page_start AND page_end) AS first_page,
    (SELECT count(*) FROM customer WHERE c_nationkey = ord) AS n_letters, (SELECT count(*) FROM supplier WHERE s_nationkey = ord) AS n_forms, (SELECT count(*) FROM updates u WHERE list_contains(u.loan_ids, loans.id)) AS n_updates, 0::BIGINT AS n_tasks FROM loans"""
)
def work_pages(spark, d):
    forms = table(spark, d, "supplier").select(F.col("s_nationkey").cast("string").alias("id"))
    told = letters(spark, d).select(F.col("loan_id").alias("id"))
    out = W.work_pages(loans(spark, d), pages(spark, d), forms.where(F.lit(False)), told, forms, updates(spark, d))
    return out.select("id", "n_pages", "first_page", "n_letters", "n_forms", "n_updates", "n_tasks")


def _index(spark: SparkSession, d: str) -> DataFrame:
    p = _contexts(spark, d).withColumn("search_text", X.search_text(F.col("raw_text"))).withColumn("title", F.col("chapter_id"))
    p = p.join(W.deep_links(p, _mappings(spark, d)), "pdf_page")
    told = letters(spark, d).join(slugs(spark, d), "program")
    faq = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.substring("text", 1, 20).alias("title"), F.lit(1).alias("pdf_page"))
    form = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("title"), F.lit(2).alias("pdf_page"), F.when(F.col("s_nationkey") != 3, F.col("s_nationkey").cast("string")).alias("loan_id"))
    extra = table(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("title"), F.lit(3).alias("pdf_page"))
    return W.search_index(p, loans(spark, d), told, faq, form, extra)


@registered(
    f"""WITH {LOANS}, {SECTIONS}, {PAGES}, {LETTERS}, o AS (SELECT pdf_page, (SELECT arg_min(id, ord) FROM loans WHERE printed_page BETWEEN page_start AND page_end) AS loan_id, CASE WHEN printed_page IS NULL THEN 'front-matter' ELSE {_RANGES} END AS chapter_id FROM pages)
SELECT 'page-' || printf('%03d', pdf_page) AS id, '原文頁面' AS type, coalesce('loan:' || loan_id, 'section:' || chapter_id) AS scope, 'loan:' || loan_id AS scope_group, pdf_page FROM o
UNION ALL SELECT 'loan-' || id, '貸款索引', 'loan:' || id, 'loan:' || id, page_start + 2 FROM loans
UNION ALL SELECT 'interpretations-' || id, '函釋', 'interpretation-group:' || {SLUG}, 'loan:' || loan_id, pdf_page FROM letters
UNION ALL SELECT 'faq-' || item_id, '常見問答', 'faq:' || item_id, NULL, 1 FROM benchmark
UNION ALL SELECT 'forms-' || s_suppkey, '書表附件', CASE WHEN s_nationkey = 3 THEN 'form:common' ELSE 'loan:' || s_nationkey END, CASE WHEN s_nationkey <> 3 THEN 'loan:' || s_nationkey END, 2 FROM supplier
UNION ALL SELECT 'forms-' || r_regionkey, '附錄附件', 'appendix', NULL, 3 FROM region"""
)
def search_index(spark, d):
    return _index(spark, d).select("id", "type", "scope", "scope_group", "pdf_page")


_BEGIN = {"原文頁面": "section:", "貸款索引": "loan:", "函釋": "interpretation-group:", "常見問答": "faq:", "書表附件": "loan:"}


@registered(
    f"""WITH {LOANS}, {PAGES}, {LETTERS}, twice AS (SELECT id FROM letters GROUP BY id HAVING count(*) > 1)
SELECT 'page-' || printf('%03d', pdf_page) AS id, 'scope' AS fault FROM pages WHERE EXISTS (SELECT 1 FROM loans WHERE printed_page BETWEEN page_start AND page_end)
UNION ALL SELECT 'interpretations-' || l.id, 'id-twice' FROM letters l JOIN twice USING (id)
UNION ALL SELECT 'forms-' || s_suppkey, 'scope' FROM supplier WHERE s_nationkey = 3
UNION ALL SELECT 'forms-' || r_regionkey, 'type' FROM region
UNION ALL SELECT 'forms-' || r_regionkey, 'id-twice' FROM region JOIN supplier ON s_suppkey = r_regionkey UNION ALL SELECT 'forms-' || s_suppkey, 'id-twice' FROM region JOIN supplier ON s_suppkey = r_regionkey
UNION ALL SELECT 'interpretations-' || id, 'owner' FROM letters WHERE loan_id = '7' UNION ALL SELECT 'loan-7', 'owner'
UNION ALL SELECT 'forms-' || s_suppkey, 'owner' FROM supplier WHERE s_nationkey = 7
UNION ALL SELECT 'page-' || printf('%03d', pdf_page), 'owner' FROM pages WHERE printed_page BETWEEN 99 AND 110"""
)
def index_faults(spark, d):
    """The index against rules that it breaks: pages of loans, common forms, appendices, repeated ids, a loan unknown."""
    owners = loans(spark, d).where("id <> '7'").select(F.concat(F.lit("loan:"), "id").alias("scope"))
    return V.index_faults(_index(spark, d), owners, _BEGIN)


# --- rules -----------------------------------------------------------------------------------------------------------


@registered(
    """SELECT coalesce(c.n_nationkey, s.k) AS n_nationkey, unnest(list_filter([CASE WHEN s.k IS NULL THEN 'missing-right' END, CASE WHEN c.n_nationkey IS NULL THEN 'missing-left' END, CASE WHEN greatest(s.n, 1) > 1 THEN 'repeated' END, CASE WHEN c.n_nationkey IS NOT NULL AND s.k IS NOT NULL AND s.name IS DISTINCT FROM c.n_name THEN 'name' END], lambda x: x IS NOT NULL)) AS fault
FROM nation c FULL JOIN (SELECT s_nationkey + 1 AS k, count(*) AS n, min(s_name) AS name FROM supplier GROUP BY 1) s ON s.k = c.n_nationkey"""
)
def parity_faults(spark, d):
    left = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("name"))
    right = table(spark, d, "supplier").select((F.col("s_nationkey") + 1).alias("n_nationkey"), F.col("s_name").alias("name"))
    return V.parity_faults(left, right, "n_nationkey", ["name"])


_LINKS = """links AS (SELECT page_id AS source, regexp_replace(href, '#.*$', '') AS path, CASE WHEN contains(href, '#') THEN regexp_extract(href, '#(.*)$', 1) ELSE '' END AS fragment
    FROM (SELECT page_id, unnest(regexp_extract_all(html, '<[a-zA-Z][a-zA-Z0-9]*\\s[^>]*?\\bhref="([^"]*)"', 1)) || CASE WHEN page_id % 2 = 0 THEN '#a' ELSE '' END AS href FROM pages) x)"""


@registered(
    f"""WITH {_LINKS}, t AS (SELECT DISTINCT path FROM links WHERE length(path) > 5), i AS (SELECT path, 'a' AS fragment FROM t WHERE length(path) > 8)
SELECT source, path, fragment, CASE WHEN path NOT IN (SELECT path FROM t) THEN 'no-page' ELSE 'no-id' END AS fault FROM links WHERE path NOT IN (SELECT path FROM t) OR (fragment <> '' AND path NOT IN (SELECT path FROM i))"""
)
def unresolved_links(spark, d):
    """Links of all pages; of the pages they lead to, those with short names are missing or have no ids."""
    href = F.concat(F.col("href"), F.when(F.col("page_id") % 2 == 0, "#a").otherwise(""))
    links = table(spark, d, "pages").select("page_id", F.explode(readers.html_attributes(F.col("html"), "href")).alias("href"))
    links = links.select(F.col("page_id").alias("source"), F.regexp_replace(href, "#.*$", "").alias("path"), W.url_fragment(href).alias("fragment"))
    known = links.select("path").distinct().where(F.length("path") > 5)
    targets = known.select("path", F.explode(F.when(F.length("path") > 8, F.array(F.lit(""), F.lit("a"))).otherwise(F.array(F.lit("")))).alias("fragment"))
    return V.unresolved_links(links, targets)


@registered(f"WITH {LETTERS}, n AS (SELECT *, count(*) OVER (PARTITION BY title, pdf_page) AS same FROM letters) SELECT ord AS id, 'reparse' AS fault FROM n WHERE title <> upper(program) UNION ALL SELECT ord, 'twice' FROM n WHERE same > 1")
def reparse_faults(spark, d):
    rows = letters(spark, d).select(F.col("ord").alias("id"), F.col("title").alias("document_number"), "pdf_page", "program")
    return V.reparse_faults(rows, F.upper("program"))


@registered("SELECT item_id AS id FROM benchmark WHERE NOT contains(coalesce((SELECT regexp_replace(text, '\\s+', '', 'g') FROM documents WHERE doc_id = item_id), ''), regexp_replace(substr(text, 1, 2), '\\s+', '', 'g')) AND NOT contains(coalesce((SELECT regexp_replace(text, '\\s+', '', 'g') FROM documents WHERE doc_id = item_id + 1), ''), regexp_replace(substr(text, 1, 2), '\\s+', '', 'g'))")
def weak_evidence(spark, d):
    """Excerpts of benchmark items on the pages of their ids: those that stand on neither."""
    decisions = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.substring("text", 1, 2).alias("excerpt"), F.array("item_id", F.col("item_id") + 1).alias("evidence_pages"))
    return V.weak_evidence(decisions, table(spark, d, "documents").select(F.col("doc_id").alias("page"), "text"))


@registered(
    """WITH r AS (SELECT event_type AS source_id, count(*) AS hits, count(*) FILTER (WHERE value > 20) AS candidates, count(DISTINCT user_id) * 20 AS out_of_scope, CAST(max(ts) AS DATE) AS through, (SELECT CAST(max(ts) AS DATE) + 1 FROM events) AS verified FROM events GROUP BY 1)
SELECT source_id, 'hits' AS fault FROM r WHERE hits < candidates + out_of_scope UNION ALL SELECT source_id, 'reviewed-through' FROM r WHERE through < verified"""
)
def lineage_faults(spark, d):
    e = table(spark, d, "events")
    last = e.agg((F.max("ts").cast("date") + F.expr("INTERVAL 1 DAY")).cast("date").alias("verified_through"))
    r = e.groupBy(F.col("event_type").alias("source_id")).agg(F.count("*").alias("hits"), F.count_if(F.col("value") > 20).alias("candidates"), (F.countDistinct("user_id") * 20).alias("out_of_scope"), F.max("ts").cast("date").alias("reviewed_through"))
    return V.lineage_faults(r.join(F.broadcast(last)))


@registered("""WITH p AS (SELECT page_id, len(regexp_extract_all(html, '<li>')) AS li, len(regexp_extract_all(html, '<b>')) AS b FROM pages) SELECT page_id, 'list' AS fault FROM p WHERE NOT li BETWEEN 2 AND 6 UNION ALL SELECT page_id, 'bold' FROM p WHERE NOT b BETWEEN 1 AND 3""")
def structure_faults(spark, d):
    return V.structure_faults(table(spark, d, "pages"), {"list": ("<li>", 2, 6), "bold": ("<b>", 1, 3)})


@registered("SELECT page_id, 'script' AS fault FROM pages WHERE contains(html, '<script') UNION ALL SELECT page_id, 'noise' FROM pages WHERE regexp_matches(html, '%%%|###') UNION ALL SELECT page_id, 'local-path' FROM pages WHERE contains(html, '/root/')")
def forbidden_tokens(spark, d):
    return V.forbidden_tokens(table(spark, d, "pages"), "page_id", "html", {"script": ("<script",), "noise": ("%%%", "###"), "local-path": ("/root/",)})


@registered("SELECT page_id, token FROM pages, (VALUES ('lang=\"en\"'), ('<nav>'), ('the ')) t(token) WHERE NOT contains(html, token)")
def missing_tokens(spark, d):
    return V.without_tokens(table(spark, d, "pages"), "page_id", "html", ['lang="en"', "<nav>", "the "])


@registered("SELECT source, count(DISTINCT lang) AS n_values FROM documents GROUP BY source HAVING count(DISTINCT lang) > 1")
def inconsistent_groups(spark, d):
    return V.inconsistent(table(spark, d, "documents"), "source", "lang")


_AUDIT = "lower(regexp_replace({}, '[^\\p{{L}}\\p{{M}}\\p{{N}}]+', '', 'g'))"


@registered(f"SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE NOT contains({_AUDIT.format('c_name || c_mktsegment')}, {_AUDIT.format('n_name')}) AND NOT contains({_AUDIT.format('c_name || c_mktsegment')}, CAST(c_nationkey * 7 AS VARCHAR))")
def untold_sources(spark, d):
    c = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return V.untold(c, "c_custkey", F.concat("c_name", "c_mktsegment"), F.col("n_name"), (F.col("c_nationkey") * 7).cast("string"))


@registered("""WITH g AS (SELECT c_mktsegment AS name, list(c_custkey ORDER BY c_acctbal DESC, c_custkey)[:3] AS got FROM customer GROUP BY 1), f AS (SELECT c_mktsegment AS name, list(c_custkey ORDER BY c_acctbal DESC, c_custkey)[:CASE WHEN c_mktsegment < 'C' THEN 2 ELSE 3 END] AS e FROM customer GROUP BY c_mktsegment)
SELECT name FROM g JOIN f USING (name) WHERE got <> e""")
def fixture_faults(spark, d):
    """The richest three of each segment, against fixtures of which some name two."""
    from ..operators import lookup as L

    ranked = L.ranked_in_groups(table(spark, d, "customer"), "c_mktsegment", F.desc("c_acctbal"), F.col("c_custkey")).where("rank <= 3")
    results = ranked.select(F.col("c_mktsegment").alias("name"), F.col("c_custkey").alias("id"), "rank")
    fixtures = results.groupBy("name").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("expected"))
    return V.fixture_faults(results, fixtures.withColumn("expected", F.when(F.col("name") < "C", F.slice("expected", 1, 2)).otherwise(F.col("expected"))))


_QUERIES = ("the license", "eau pour", "no5x", "zzzz nothing")
_RESULTS = "WITH " + ", ".join(scored_sql(q, name=f"s{i}") if not i else scored_sql(q, name=f"s{i}").split("FROM documents\n), ", 1)[1] for i, q in enumerate(_QUERIES))
_RESULTS += ", a AS (" + " UNION ALL ".join(f"SELECT {i} AS query_id, type, {RANK_SQL} FROM s{i}" for i in range(len(_QUERIES))) + ") "


@registered(_RESULTS + "SELECT query_id FROM a GROUP BY query_id HAVING NOT bool_or(rank <= 10 AND type = 'en')")
def queries_without_top(spark, d):
    """Queries with results but no English one among the first ten."""
    r = records(spark, d)
    found = S.search(r, S.query_table(r, *_QUERIES), proximity=False, spread=False)
    return V.without_top(found, 10, F.col("type") == "en")


_ONE = "public license"


@registered(
    f"""WITH {scored_sql(_ONE)}, b AS (SELECT ord, {RANK_SQL} FROM s), a AS (SELECT ord, CAST(row_number() OVER (ORDER BY score + CASE type WHEN 'fr' THEN 60 WHEN 'en' THEN 0 ELSE 0 END DESC, coalesce(pdf_page, 0), ord) AS INTEGER) AS rank FROM s),
m AS (SELECT a.rank AS ra, b.rank AS rb FROM (SELECT * FROM a WHERE rank <= 10) a FULL JOIN (SELECT * FROM b WHERE rank <= 10) b USING (ord))
SELECT 0 AS query_id, count(*) FILTER (WHERE ra IS NOT NULL AND rb IS NOT NULL) AS stayed, count(*) FILTER (WHERE rb IS NULL) AS came, count(*) FILTER (WHERE ra IS NULL) AS went, coalesce(bool_or(ra = 1 AND rb = 1), false) AS same_first FROM m HAVING count(*) > 0"""
)
def ranking_changes(spark, d):
    """The first ten of a query before and after an intent that prefers French."""
    r = records(spark, d)
    intents = readers.inline_table(spark, [("i", ["license"], ["fr"], 60)], "id string, triggers array<string>, preferred_types array<string>, boost int")
    plain = S.search(r, _ONE, proximity=False, spread=False)
    return V.ranking_changes(plain, S.search(r, _ONE, intents=intents, proximity=False, spread=False))


@registered("""SELECT page_id, regexp_replace(regexp_replace(url, '#.*$', ''), '\\?.*$', '') AS path, CASE WHEN contains(url, '#') THEN regexp_extract(url, '#(.*)$', 1) ELSE '' END AS fragment FROM pages""")
def url_split(spark, d):
    return table(spark, d, "pages").select("page_id", W.url_path(F.col("url")).alias("path"), W.url_fragment(F.col("url")).alias("fragment"))


@registered("SELECT n_nationkey, '../' || n_nationkey || '/index.html' AS sibling, '../../faq/index.html' AS up, 'https://x.org/loans/' || n_nationkey || '/' AS canonical FROM nation")
def relative_paths(spark, d):
    own = F.concat(F.lit("loans/"), F.col("n_nationkey").cast("string"), F.lit("/index.html"))
    up = W.relative_path(own, F.lit("faq/index.html"))
    return table(spark, d, "nation").select("n_nationkey", W.relative_path(F.lit("loans/other/index.html"), own).alias("sibling"), up.alias("up"), W.canonical_url("https://x.org/", own).alias("canonical"))


@registered(
    """SELECT role, count(*) AS groups, CAST(sum(n) AS BIGINT) AS units, count(*) FILTER (WHERE n > 2) AS complete FROM (SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY conv_id, role) GROUP BY role"""
)
def summary_of_groups(spark, d):
    per = table(spark, d, "conversations").groupBy("conv_id", "role").agg(F.count("*").alias("n"))
    return per.groupBy("role").agg(F.count("*").alias("groups"), F.sum("n").alias("units"), F.count_if(F.col("n") > 2).alias("complete"))
