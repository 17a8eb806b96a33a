"""The registered queries of the engine's own operators, and the SQL that each must agree with.

The driver's tables stand in for the documents that the operators were made for: ``documents`` for search records,
``pages`` for HTML, ``conversations`` for questions and answers, ``events`` for updates, ``orders`` for intervals.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import extraction as E
from ..operators import lookup as L
from ..operators import ownership as O
from ..operators import search as S
from ..operators import validation as V
from ..operators.markers import marker_hits, pages_of_markers
from ..operators.numbering import numbered_rows
from ..sources import readers, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def registered(sql: str | None = None) -> Callable:
    def keep(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return readers.parquet_table(spark, d, name)


def records(spark: SparkSession, d: str) -> DataFrame:
    """Documents as search records."""
    title = F.substring_index("text", "\n", 1)
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("ord"),
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("id"),
        F.col("lang").alias("type"),
        title.alias("title"),
        "text",
        F.array(title).alias("headings"),
        F.array("lang", "source").alias("breadcrumb"),
        F.col("source").alias("scope"),
        F.col("lang").alias("scope_group"),
        F.concat(F.lit("no"), F.col("doc_id").cast("string"), F.lit("x")).alias("document_number"),
        (F.col("n_chars") % 359).cast("int").alias("pdf_page"),
    )


def _norm(x: str) -> str:
    return f"regexp_replace(regexp_replace(lower({x}), '\\s+', ' ', 'g'), '^ | $', '', 'g')"


RECORDS_SQL = f"""
r AS (
    SELECT doc_id AS ord, lang AS type, source AS scope, lang AS scope_group, CAST(n_chars % 359 AS INTEGER) AS pdf_page,
        {_norm("split_part(text, chr(10), 1)")} AS f_title, {_norm("split_part(text, chr(10), 1)")} AS f_headings,
        {_norm("lang || ' ' || source")} AS f_breadcrumb, {_norm("text")} AS f_body, 'NO' || doc_id || 'X' AS f_number
    FROM documents
)"""


def _list(items: list[str]) -> str:
    return "[" + ", ".join("'" + i.replace("'", "''") + "'" for i in items) + "]::VARCHAR[]"


def scored_sql(query: str, related: list[str] | None = None, where: str = "TRUE", extra: str = "0", name: str = "s") -> str:
    """CTEs r and ``name``: records with evidence for one query, with their scores."""
    terms, w = list(dict.fromkeys(query.split())), S.WEIGHTS
    n = lambda field, words: f"len(list_filter({_list(words)}, lambda t: contains(f_{field}, t)))"
    fields = ("title", "headings", "breadcrumb", "body", "number")
    rel = related or []
    d = " + ".join(n(f, terms) for f in fields)
    r = " + ".join(n(f, rel) for f in fields)
    exact = f"contains(f_number, '{query.replace(' ', '').upper()}')"
    score = f"""{n("title", terms)} * {w["title"]} + {n("headings", terms)} * {w["headings"]} + {n("breadcrumb", terms)} * {w["breadcrumb"]} + {n("body", terms)} * {w["body"]}
        + {n("title", rel)} * {w["concept_title"]} + {n("body", rel)} * {w["concept_body"]}
        + CASE WHEN f_title = '{query}' THEN {w["exact_title"]} WHEN contains(f_title, '{query}') AND {len(query)} >= 2 THEN {w["phrase_title"]} ELSE 0 END
        + CASE WHEN {len(query)} >= 8 AND contains(f_body, '{query}') THEN {w["phrase_body"]} ELSE 0 END
        + CASE WHEN {exact} THEN {w["exact_number"]} ELSE 0 END
        + CASE WHEN {len(terms)} > 1 AND {n("body", terms)} = {len(terms)} THEN {w["all_terms"]} ELSE 0 END + {extra}"""
    kind = f"CASE WHEN {exact} THEN 'exact-document' WHEN {d} > 0 THEN 'direct' ELSE 'related' END"
    return f"{RECORDS_SQL}, {name} AS (SELECT ord, type, scope, scope_group, pdf_page, f_body, CAST({score} AS BIGINT) AS score, {kind} AS match_kind FROM r WHERE ({where}) AND ({d} + {r} > 0 OR {exact}))"


RANK_SQL = "CAST(row_number() OVER (ORDER BY score DESC, coalesce(pdf_page, 0), ord) AS INTEGER) AS rank"


def _top(rows: DataFrame, n: int = 50) -> DataFrame:
    return S.page_of(rows, 1, n).select("ord", "score", "match_kind", "rank")


@registered(f"WITH {scored_sql('that with')} SELECT ord, score, match_kind, rank FROM (SELECT *, {RANK_SQL} FROM s) WHERE rank <= 20")
def search_basic(spark, d):
    return _top(S.search(records(spark, d), "that with", proximity=False, spread=False), 20)


@registered(f"WITH {scored_sql('the and', where='''scope IN ('src1', 'src2') OR scope_group IN ('src1', 'src2')''')} SELECT ord, score, match_kind, rank FROM (SELECT *, {RANK_SQL} FROM s)")
def search_scoped(spark, d):
    found = S.search(records(spark, d), "the and", scopes="src1,src2", proximity=False, spread=False)
    return found.select("ord", "score", "match_kind", "rank")


@registered(f"WITH {scored_sql('eau pour', where='''type = 'fr' ''')} SELECT ord, score, match_kind, rank FROM (SELECT *, {RANK_SQL} FROM s)")
def search_typed(spark, d):
    return S.search(records(spark, d), "eau pour", type_filter="fr", proximity=False, spread=False).select("ord", "score", "match_kind", "rank")


@registered(f"WITH {scored_sql('no17x')} SELECT ord, score, match_kind, rank FROM (SELECT *, {RANK_SQL} FROM s)")
def search_document_number(spark, d):
    return S.search(records(spark, d), "no17x", proximity=False, spread=False).select("ord", "score", "match_kind", "rank")


@registered(f"WITH {scored_sql('license version public')} SELECT ord, score, match_kind, rank FROM (SELECT *, {RANK_SQL} FROM s) WHERE rank <= 50")
def search_multi_term(spark, d):
    return _top(S.search(records(spark, d), "license version public", proximity=False, spread=False))


CONCEPTS = [("c1", ["license", "licence", "permission"], None, None), ("c2", None, ["public license"], ["version", "software"]), ("c3", ["idiot", "moron"], None, None)]


def concepts(spark: SparkSession) -> DataFrame:
    return readers.inline_table(spark, CONCEPTS, "id string, terms array<string>, trigger_terms array<string>, related_terms array<string>").withColumnRenamed("ord", "concept_ord")


@registered(f"WITH {scored_sql('public license', ['licence', 'permission', 'version', 'software'])} SELECT ord, score, match_kind, rank FROM (SELECT *, {RANK_SQL} FROM s) WHERE rank <= 50")
def search_concepts(spark, d):
    return _top(S.search(records(spark, d), "public license", concepts(spark), proximity=False, spread=False))


INTENTS = [("i1", ["license"], ["en", "fr"], 60), ("i2", ["public"], ["de", "en"], 30)]


@registered(
    f"WITH {scored_sql('public license', extra='''CASE type WHEN 'en' THEN 90 WHEN 'fr' THEN 60 WHEN 'de' THEN 30 ELSE 0 END''')} SELECT ord, score, match_kind, rank FROM (SELECT *, {RANK_SQL} FROM s) WHERE rank <= 50"
)
def search_intents(spark, d):
    intents = readers.inline_table(spark, INTENTS, "id string, triggers array<string>, preferred_types array<string>, boost int")
    return _top(S.search(records(spark, d), "public license", intents=intents, proximity=False, spread=False))


@registered()
def search_diversified(spark, d):
    found = S.search(records(spark, d), "license idiot", proximity=False)
    return found.select("ord", "score", "adjusted_score", F.col("place").cast("int").alias("place"))


@registered()
def search_proximity(spark, d):
    return S.search(records(spark, d), "public license", proximity=True, spread=False).select("ord", "score", F.col("distance").cast("int").alias("distance"), "rank")


@registered()
def search_snippets(spark, d):
    shown = S.with_snippets(S.page_of(S.search(records(spark, d), "public license", proximity=False, spread=False), 1))
    from ..functions.unicode import highlight

    return shown.select("ord", "rank", F.col("snippet.start").alias("start"), F.col("snippet.end").alias("end"), F.array_join(highlight(F.col("text"), F.col("snippet")), "|").alias("marks"))


BATCH = ("that with", "eau pour", "license", "der die und", "no5x")
BATCH_SQL = "WITH " + RECORDS_SQL + ", " + ", ".join(scored_sql(q, name=f"s{i}").split(f"FROM documents\n), ", 1)[1] for i, q in enumerate(BATCH))
BATCH_SQL += ", a AS (" + " UNION ALL ".join(f"SELECT {i} AS query_id, ord, pdf_page, score FROM s{i}" for i in range(len(BATCH))) + ") "


@registered(BATCH_SQL + "SELECT query_id, ord, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, coalesce(pdf_page, 0), ord) AS INTEGER) AS rank FROM a) WHERE rank <= 20")
def search_batch(spark, d):
    r = records(spark, d)
    return S.search(r, S.query_table(r, *BATCH), proximity=False, spread=False).where("rank <= 20").select("query_id", "ord", "score", "rank")


@registered(f"WITH {scored_sql('license')} SELECT coalesce(type, 'all') AS type, count(*) AS n FROM s GROUP BY ROLLUP(type)")
def facet_counts(spark, d):
    r = records(spark, d)
    asked = S.expand_queries(S.validate_queries(S.query_table(r, "license")), None)
    return S.facets(S.score_records(S.prepare_records(r), asked)).select("type", "n")


@registered(f"WITH {scored_sql('the')} SELECT ord, rank FROM (SELECT *, {RANK_SQL} FROM s) WHERE rank BETWEEN 21 AND 40")
def page_of_results(spark, d):
    return S.page_of(S.search(records(spark, d), "the", proximity=False, spread=False), 2).select("ord", "rank")


@registered("SELECT * FROM (VALUES (0, true, false, 2), (1, true, true, 0), (2, false, false, 1), (3, false, false, 17)) t(query_id, ok, empty, n_terms)")
def query_limits(spark, d):
    many = " ".join(f"t{i}" for i in range(17))
    asked = S.validate_queries(S.query_table(table(spark, d, "region"), "Two  words two", "  ", "x" * 257, many))
    return asked.select("query_id", "ok", "empty", F.size("terms").alias("n_terms"))


# --- lookups -------------------------------------------------------------------------------------------------------

_FORM = "regexp_replace(lower({}), '[\\s，。；：！？、（）「」『』【】《》〈〉／/%％﹪﹖?.,:;()\\[\\]{{}}]', '', 'g')"


def _form(x: str) -> str:
    return _FORM.format(x)


@registered(
    f"""WITH p AS (SELECT p_partkey, {_form("p_name")} AS t, {_form("p_brand")} AS b, {_form("p_type")} AS y,
    {_form("p_name || ' ' || p_type || ' ' || p_brand")} AS body FROM part),
s AS (SELECT p_partkey, CAST(CASE WHEN t = 'brand#13' THEN 80000 WHEN contains(t, 'brand#13') THEN 70000 WHEN contains(b, 'brand#13') THEN 50000
    WHEN contains(y, 'brand#13') THEN 40000 WHEN contains(body, 'brand#13') THEN 30000 ELSE 0 END AS BIGINT) AS score FROM p)
SELECT p_partkey, score, CAST(row_number() OVER (ORDER BY score DESC, p_partkey) AS INTEGER) AS rank FROM s WHERE score > 0"""
)
def lookup_tiered_title(spark, d):
    q = F.lit("Brand#13")
    score = L.letter_score(q, F.col("p_brand"), F.lit(""), F.col("p_name"), F.col("p_type"), F.col("p_brand"))
    return L.looked_up(table(spark, d, "part"), q, score, F.col("p_partkey")).select("p_partkey", "score", F.col("rank").cast("int").alias("rank"))


_NUMBER_SQL = """SELECT c_custkey, CAST(CASE WHEN length('{d}') >= 4 AND regexp_replace(c_name, '[^0-9]', '', 'g') = '{d}' THEN 100000
    WHEN length('{d}') >= 4 AND CAST(c_custkey AS VARCHAR) = '{d}' THEN 90000 WHEN contains(lower(c_name), '{d}') THEN 70000 WHEN contains(lower(c_mktsegment), '{d}') THEN 50000 ELSE 0 END AS BIGINT) AS score, '{d}' AS query FROM customer"""


@registered("SELECT * FROM (" + " UNION ALL ".join(_NUMBER_SQL.format(d=d) for d in ("000000123", "123", "1023", "17")) + ") WHERE score > 0")
def lookup_numbers(spark, d):
    """Digits count as a number from four on; fewer are only looked for in the texts."""
    c, out = table(spark, d, "customer"), None
    for q in ("000000123", "123", "1023", "17"):
        score = L.letter_score(F.lit(q), F.col("c_name"), F.col("c_custkey").cast("string"), F.col("c_name"), F.lit(""), F.col("c_mktsegment"))
        found = L.scored_rows(c, F.lit(q), score).select("c_custkey", "score", F.lit(q).alias("query"))
        out = found if out is None else out.unionByName(found)
    return out


@registered(
    f"""WITH c AS (SELECT conv_id, turn, role, text, lead(text) OVER w AS answer, lead(role) OVER w AS next_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
s AS (SELECT conv_id, turn, CAST(CASE WHEN contains({_form("text")}, 'theand') THEN 60000 WHEN contains({_form("text || ' ' || coalesce(answer, '')")}, 'theand') THEN 40000 ELSE 0 END AS BIGINT) AS score FROM c WHERE role = 'user')
SELECT conv_id, turn, score FROM s WHERE score > 0"""
)
def lookup_qa(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    pairs = table(spark, d, "conversations").withColumn("answer", F.lead("text").over(w)).where("role = 'user'")
    score = L.question_score(F.lit("the and"), F.col("text"), F.coalesce("answer", F.lit("")))
    return L.looked_up(pairs, F.lit("the and"), score, F.col("conv_id"), F.col("turn")).select("conv_id", "turn", "score")


@registered(
    f"""WITH s AS (SELECT page_id, {_form("regexp_replace(html, '<[^>]+>', ' ', 'g')")} AS b FROM pages)
SELECT page_id, CAST(CASE WHEN contains(b, 'varof') THEN 50000 ELSE 30002 END AS BIGINT) AS score FROM s WHERE contains(b, 'varof') OR (contains(b, 'var') AND contains(b, 'of'))"""
)
def lookup_updates_and(spark, d):
    body = F.regexp_replace("html", "<[^>]+>", " ")
    score = L.update_score(F.lit("var of"), F.lit(""), F.lit(""), F.lit(""), F.lit(""), body)
    return L.scored_rows(table(spark, d, "pages"), F.lit("var of"), score).select("page_id", "score")


@registered(
    """WITH e AS (SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS event_date, event_type FROM events)
SELECT event_id, event_date, CAST(row_number() OVER (ORDER BY event_date DESC, event_id) AS INTEGER) AS rank FROM e
WHERE event_type = (SELECT min(event_type) FROM events) AND substr(event_date, 1, 4) = (SELECT max(substr(event_date, 1, 4)) FROM e)"""
)
def lookup_filters(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("event_type").alias("source_type"), F.col("ts").cast("date").cast("string").alias("event_date"))
    first = e.agg(F.min("source_type").alias("k"), F.max(F.substring("event_date", 1, 4)).alias("y")).first()
    found = L.filter_updates(e, kind=first["k"], year=first["y"])
    latest_first = found.withColumn("_day", -F.unix_date(F.col("event_date").cast("date")))
    return numbered_rows(latest_first, "_day", "event_id", name="rank").select("event_id", "event_date", F.col("rank").cast("int").alias("rank"))


@registered("SELECT DISTINCT event_type AS value FROM events")
def filter_options(spark, d):
    return L.filter_options(table(spark, d, "events"), "event_type").withColumnRenamed("event_type", "value")


@registered(
    """SELECT c_custkey, c_mktsegment, CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS INTEGER) AS rank FROM customer"""
)
def ranked_in_groups(spark, d):
    return L.ranked_in_groups(table(spark, d, "customer"), "c_mktsegment", F.desc("c_acctbal"), F.col("c_custkey")).select("c_custkey", "c_mktsegment", "rank")


# --- ownership -----------------------------------------------------------------------------------------------------

RANGES = [("alpha", 1, 100), ("beta", 90, 180), ("gamma", 181, 250), ("delta", 300, 358), ("open", 340, None), ("before", None, 0)]
RANGES_SQL = "i(ord, slug, low, high) AS (VALUES " + ", ".join(f"({i}, '{s}', {'-1e9::INT' if a is None else a}, {'1e9::INT' if b is None else b})" for i, (s, a, b) in enumerate(RANGES)) + ")"


def ranges(spark: SparkSession) -> DataFrame:
    return readers.inline_table(spark, RANGES, "slug string, low int, high int")


@registered(
    f"""WITH {RANGES_SQL}, p AS (SELECT doc_id, CAST(n_chars % 359 AS INTEGER) AS page FROM documents)
SELECT doc_id, page, (SELECT arg_min(slug, ord) FROM i WHERE page BETWEEN low AND high) AS owner FROM p"""
)
def interval_owner(spark, d):
    pages = table(spark, d, "documents").select("doc_id", (F.col("n_chars") % 359).cast("int").alias("page"))
    return O.first_owner(pages, "doc_id", "page", ranges(spark), "low", "high", "ord", "slug").select("doc_id", "page", "owner")


@registered(
    f"""WITH {RANGES_SQL}, p AS (SELECT doc_id, CASE WHEN n_chars % 7 = 0 THEN NULL ELSE CAST(n_chars % 359 AS INTEGER) END AS page FROM documents)
SELECT doc_id, CASE WHEN page IS NULL THEN 'front-matter' ELSE coalesce((SELECT arg_min(slug, ord) FROM i WHERE page BETWEEN low AND high), 'unassigned') END AS chapter_id FROM p"""
)
def chapter_of_page(spark, d):
    pages = table(spark, d, "documents").select("doc_id", F.when(F.col("n_chars") % 7 != 0, (F.col("n_chars") % 359).cast("int")).alias("page"))
    return O.chapter(pages, "page", ranges(spark)).select("doc_id", "chapter_id")


@registered(f"WITH {RANGES_SQL} SELECT slug, doc_id FROM i JOIN documents ON CAST(n_chars % 359 AS INTEGER) BETWEEN low AND high")
def section_pages(spark, d):
    pages = table(spark, d, "documents").select("doc_id", (F.col("n_chars") % 359).cast("int").alias("page"))
    return O.interval_members(pages, "page", ranges(spark), "low", "high").select("slug", "doc_id")


@registered(
    """SELECT n_nationkey, CASE WHEN n_nationkey = 1 THEN 'special' WHEN n_nationkey = 2 THEN NULL ELSE r_name END AS owner FROM nation LEFT JOIN region ON n_regionkey = r_regionkey"""
)
def owner_override(spark, d):
    n = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    o = spark.createDataFrame([(1, "special"), (2, None)], "n_nationkey int, value string")
    return O.with_override(n, o, "n_nationkey", "value", F.col("r_name")).select("n_nationkey", "owner")


@registered(
    """SELECT 'document' AS kind, count(*) AS n, count(number) AS numbered FROM (SELECT lang AS number FROM documents) UNION ALL
SELECT 'page', count(*), 0 FROM pages UNION ALL SELECT 'item', count(*), 0 FROM benchmark"""
)
def union_index(spark, d):
    a = table(spark, d, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.col("lang").alias("number"))
    b = table(spark, d, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"))
    c = table(spark, d, "benchmark").select(F.lit("item").alias("kind"), F.col("item_id").alias("id"))
    return O.union_index(a, b, c).groupBy("kind").agg(F.count("*").alias("n"), F.count("number").alias("numbered"))


@registered("SELECT doc_id, coalesce(CASE WHEN l.toxic = 1 THEN 'review' END, lang) AS disposition FROM documents LEFT JOIN labels l USING (doc_id)")
def decision_overlay(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.col("lang").alias("disposition"))
    decided = table(spark, d, "labels").select("doc_id", F.when(F.col("toxic") == 1, "review").alias("disposition"))
    return O.overlay(rows, decided, "doc_id", ["disposition"]).select("doc_id", "disposition")


@registered("SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def overlay_faults(spark, d):
    english = table(spark, d, "documents").where("lang = 'en'").select("doc_id")
    return O.overlay_faults(english, table(spark, d, "labels"), "doc_id").select("doc_id")


@registered("SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def first_lookup(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    return O.first_lookup(c, table(spark, d, "nation"), "n_nationkey", "n_name").select("c_custkey", "n_name")


@registered(
    """SELECT n_regionkey AS id, string_agg(n_name, '|' ORDER BY n_name) AS titles FROM nation GROUP BY n_regionkey"""
)
def titles_of_ids(spark, d):
    n = table(spark, d, "nation")
    ids = n.groupBy(F.col("n_regionkey").alias("region")).agg(F.transform(F.sort_array(F.collect_list(F.struct("n_name", "n_nationkey"))), lambda x: x["n_nationkey"]).alias("ids"))
    out = O.titles_of(ids, "region", "ids", n.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("title")), "titles")
    return out.select(F.col("region").alias("id"), F.array_join("titles", "|").alias("titles"))


# --- windows and sequences -----------------------------------------------------------------------------------------


@registered(
    """WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber) AS rn,
    first_value(l_orderkey) OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber) AS f FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN rn > 1 THEN 'duplicate' ELSE 'first' END AS disposition, CASE WHEN rn > 1 THEN f END AS duplicate_of FROM l"""
)
def candidate_dedupe(spark, d):
    w = Window.partitionBy("l_partkey", "l_suppkey").orderBy("l_orderkey", "l_linenumber")
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.row_number().over(w).alias("rn"), F.first("l_orderkey").over(w).alias("f"))
    return rows.select("l_orderkey", "l_linenumber", F.when(F.col("rn") > 1, "duplicate").otherwise("first").alias("disposition"), F.when(F.col("rn") > 1, F.col("f")).alias("duplicate_of"))


@registered(
    """WITH p AS (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS rn FROM part)
SELECT p_partkey, CASE WHEN rn > 1 THEN p_name || '-duplicate-' || rn ELSE p_name END AS key FROM p"""
)
def duplicate_suffix(spark, d):
    rn = F.row_number().over(Window.partitionBy("p_name").orderBy("p_partkey"))
    return table(spark, d, "part").select("p_partkey", F.when(rn > 1, F.concat("p_name", F.lit("-duplicate-"), rn.cast("string"))).otherwise(F.col("p_name")).alias("key"))


@registered(
    """SELECT o_orderkey, lag(o_orderkey) OVER w AS previous, lead(o_orderkey) OVER w AS following FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"""
)
def lead_lag_sequence(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", F.lag("o_orderkey").over(w).alias("previous"), F.lead("o_orderkey").over(w).alias("following"))


@registered(
    """WITH b AS (SELECT doc_id, unnest(string_split(text, '. ')) AS body, generate_subscripts(string_split(text, '. '), 1) - 1 AS number FROM documents)
SELECT doc_id, CAST(number AS INTEGER) AS number, CAST(length(body) AS INTEGER) AS size FROM b WHERE number > 0"""
)
def block_slices(spark, d):
    return E.split_blocks(table(spark, d, "documents"), "doc_id", "text", "\\. ").select("doc_id", "number", F.length("body").alias("size"))


TASKS = [("law", ["license", "licensed"]), ("insult", ["idiot", "moron", "clown"]), ("number", ["+1 (", "@mail"])]


@registered(
    "WITH t(task, markers) AS (VALUES "
    + ", ".join(f"('{t}', {_list(m)})" for t, m in TASKS)
    + """), l AS (SELECT source AS owner, doc_id AS page, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS paragraph FROM documents),
f AS (SELECT owner, task, page, paragraph, list_filter(markers, lambda m: contains(text, m))[1] AS marker FROM l, t)
SELECT owner, task, page, CAST(paragraph AS INTEGER) AS paragraph, marker FROM (SELECT *, row_number() OVER (PARTITION BY owner, task ORDER BY page, paragraph) AS rn FROM f WHERE marker IS NOT NULL) WHERE rn = 1"""
)
def earliest_marker(spark, d):
    texts = table(spark, d, "documents").select(F.col("source").alias("owner"), F.col("doc_id").alias("page"), "text")
    tasks = readers.inline_table(spark, TASKS, "task string, markers array<string>").withColumnRenamed("ord", "task_ord")
    return E.earliest_marks(texts, tasks).select("owner", "task", "page", "paragraph", "marker")


@registered(
    """WITH g AS (SELECT l_orderkey, max(l_linenumber) AS most FROM lineitem GROUP BY 1)
SELECT l_orderkey, CAST(m AS INTEGER) AS missing FROM (SELECT l_orderkey, unnest(range(1, most + 1)) AS m FROM g) x
WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = x.l_orderkey AND l.l_linenumber = x.m)"""
)
def missing_numbers(spark, d):
    return E.missing_numbers(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber")


@registered(
    """SELECT o_custkey, string_agg(o_orderkey, ',' ORDER BY o_orderdate, o_orderkey) AS keys FROM orders GROUP BY o_custkey"""
)
def group_to_list(spark, d):
    rows = table(spark, d, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderdate", "o_orderkey"))).alias("all"))
    return rows.select("o_custkey", F.array_join(F.transform("all", lambda x: x["o_orderkey"].cast("string")), ",").alias("keys"))


# --- HTML, URLs and text -------------------------------------------------------------------------------------------


@registered("""SELECT page_id, unnest(regexp_extract_all(html, '<[a-zA-Z][a-zA-Z0-9]*\\s[^>]*?\\bhref="([^"]*)"', 1)) AS href FROM pages""")
def html_links(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(readers.html_attributes(F.col("html"), "href")).alias("href"))


@registered(
    """SELECT page_id, md5(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''),
    '&copy;', '©'), '&middot;', '·'), '&amp;?', '&', 'g')) AS text_md5 FROM pages"""
)
def html_text(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(readers.html_text(F.col("html")).cast("binary")).alias("text_md5"))


_BROKEN_SQL = """CASE page_id % 3 WHEN 0 THEN replace(html, '<h1', '<h2') WHEN 1 THEN replace(html, '<p>', '<p id="twice">') ELSE html END"""


@registered(
    f"""WITH p AS (SELECT page_id, len(regexp_extract_all(h, '(?i)<h1[ >]')) AS h, regexp_extract_all(h, '\\sid="([^"]*)"', 1) AS ids FROM (SELECT page_id, {_BROKEN_SQL} AS h FROM pages))
SELECT page_id, 'main-heading' AS fault FROM p WHERE h <> 1 UNION ALL SELECT page_id, 'id-twice' FROM p WHERE len(ids) > len(list_distinct(ids))"""
)
def html_page_faults(spark, d):
    """All pages, of which a third lost the main heading and a third got an id several times."""
    third = F.col("page_id") % 3
    html = F.when(third == 0, F.replace(F.col("html"), F.lit("<h1"), F.lit("<h2"))).when(third == 1, F.replace(F.col("html"), F.lit("<p>"), F.lit('<p id="twice">'))).otherwise(F.col("html"))
    return V.page_faults(table(spark, d, "pages").withColumn("html", html))


@registered()
def html_cards(spark, d):
    return readers.html_cards(table(spark, d, "pages"), "class").select("page_id", "ord", "value", "tag", "depth", F.length("text").alias("n_chars"))


@registered(
    """SELECT page_id, regexp_extract(url, '^([a-z]+):', 1) AS protocol, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host FROM pages"""
)
def url_parts(spark, d):
    return table(spark, d, "pages").select("page_id", F.parse_url("url", F.lit("PROTOCOL")).alias("protocol"), F.parse_url("url", F.lit("HOST")).alias("host"))


@registered("SELECT page_id, starts_with(url, 'https://') AND regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1) IN ('site1.example.com', 'host1.example.com') AS allowed FROM pages")
def host_allowlist(spark, d):
    return table(spark, d, "pages").select("page_id", V.official_url(F.col("url"), ("site1.example.com", "host1.example.com")).alias("allowed"))


@registered("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '/list' ELSE '/list?q=' || source || '&lang=' || lang END AS url FROM documents")
def state_urls(spark, d):
    keep = lambda c: F.when(F.col("doc_id") % 3 != 0, F.col(c))
    return table(spark, d, "documents").select("doc_id", sinks.state_url(F.lit("/list"), q=keep("source"), lang=keep("lang")).alias("url"))


@registered()
def paragraph_reflow(spark, d):
    both = X.bound({"p": X.paragraphs(F.col("text"))}, lambda x: F.struct(F.size(x["p"]).alias("n_paragraphs"), F.md5(F.array_join(x["p"], "\n").cast("binary")).alias("md5")))
    return table(spark, d, "documents").select("doc_id", F.explode(F.array(both)).alias("x")).select("doc_id", "x.*")


@registered("SELECT doc_id FROM documents WHERE regexp_replace(text, '\\s+', '', 'g') <> regexp_replace(replace(text, ', ', ' '), '\\s+', '', 'g')")
def whitespace_invariant(spark, d):
    """Reflowed texts that lost their commas on the way: every one must be found, and no other."""
    rows = table(spark, d, "documents").select("doc_id", "text", F.array_join(X.paragraphs(F.replace(F.col("text"), F.lit(", "), F.lit(" "))), "\n").alias("shown"))
    return V.changed_text(rows, "text", "shown").select("doc_id")


@registered(f"SELECT doc_id, md5({_norm('text')}) AS form_md5, md5({_form('text')}) AS lookup_md5 FROM documents")
def normalized_forms(spark, d):
    md5 = lambda c: F.md5(c.cast("binary"))
    return table(spark, d, "documents").select("doc_id", md5(X.normalize(F.col("text"))).alias("form_md5"), md5(X.lookup_form(F.col("text"))).alias("lookup_md5"))


@registered("SELECT event_id, (year(ts) - 1911) || '/' || strftime(ts, '%m/%d') AS roc FROM events")
def roc_dates(spark, d):
    return table(spark, d, "events").select("event_id", X.roc_date(F.col("ts").cast("date").cast("string")).alias("roc"))


@registered("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def content_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


# --- sets, counts and rules ----------------------------------------------------------------------------------------


@registered(
    """SELECT l_returnflag, count(*) AS n, count(*) FILTER (WHERE l_linestatus = 'O') AS open, count(*) FILTER (WHERE l_linestatus = 'F') AS filled FROM lineitem GROUP BY l_returnflag"""
)
def disposition_counts(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count_if(F.col("l_linestatus") == "O").alias("open"), F.count_if(F.col("l_linestatus") == "F").alias("filled"))


@registered("SELECT count(*) - count(DISTINCT text) AS duplicates FROM documents")
def duplicate_count(spark, d):
    return table(spark, d, "documents").agg((F.count("*") - F.countDistinct("text")).alias("duplicates"))


@registered("SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unknown_references(spark, d):
    return V.unknown(table(spark, d, "documents"), "doc_id", table(spark, d, "labels"), "doc_id")


@registered("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)")
def orphan_lineage(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "events"), F.col("c_custkey") == F.col("user_id"), "left_anti").select("c_custkey")


@registered(
    """SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'left' ELSE 'right' END AS side
FROM (SELECT doc_id FROM documents WHERE lang = 'en') a FULL JOIN (SELECT doc_id FROM labels) b ON a.doc_id = b.doc_id WHERE a.doc_id IS NULL OR b.doc_id IS NULL"""
)
def set_symmetric_diff(spark, d):
    return V.difference(table(spark, d, "documents").where("lang = 'en'"), table(spark, d, "labels"), "doc_id")


@registered("SELECT doc_id FROM labels WHERE quality <> toxic")
def changed_values(spark, d):
    labels = table(spark, d, "labels")
    return V.changed(labels.select("doc_id", F.col("quality").alias("v")), labels.select("doc_id", F.col("toxic").alias("v")), "doc_id", "v")


@registered(
    """SELECT event_id, CAST(row_number() OVER (ORDER BY CAST(ts AS DATE) DESC, event_id) AS INTEGER) AS rank FROM events ORDER BY rank LIMIT 3"""
)
def event_date_order(spark, d):
    top = table(spark, d, "events").withColumn("day", F.col("ts").cast("date")).orderBy(F.desc("day"), "event_id").limit(3)
    return top.select("event_id", F.row_number().over(Window.orderBy(F.desc("day"), "event_id")).alias("rank"))


@registered("SELECT event_id, try_cast(CASE WHEN event_id % 5 = 0 THEN '2024-02-30' ELSE CAST(CAST(ts AS DATE) AS VARCHAR) END AS DATE) IS NOT NULL AS valid FROM events")
def valid_dates(spark, d):
    text = F.when(F.col("event_id") % 5 == 0, "2024-02-30").otherwise(F.col("ts").cast("date").cast("string"))
    return table(spark, d, "events").select("event_id", V.valid_date(text).alias("valid"))


@registered(
    f"""WITH {scored_sql("public license")}, k AS (SELECT *, {RANK_SQL} FROM s)
SELECT 0 AS query_id, count(*) AS shown, count(*) FILTER (WHERE type = 'en') AS relevant, count(*) FILTER (WHERE type = 'en') * 1000 // count(*) AS precision_thousandths FROM k WHERE rank <= 10 HAVING count(*) > 0"""
)
def precision_at_k(spark, d):
    return V.precision_at(S.search(records(spark, d), "public license", proximity=False, spread=False), 10, F.col("type") == "en")


@registered("SELECT event_type, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.5) AS p50, max(value) AS most FROM events GROUP BY event_type")
def percentile_nearest_rank(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(V.nearest_rank("value", 0.95).alias("p95"), V.nearest_rank("value", 0.5).alias("p50"), F.max("value").alias("most"))


@registered(
    """WITH v AS (SELECT c_mktsegment, c_acctbal, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) - 1 AS i, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer)
SELECT c_mktsegment, c_acctbal AS p95 FROM v WHERE i = least(n - 1, CAST(floor(n * 0.95::DOUBLE) AS BIGINT))"""
)
def percentile_floor_rank(spark, d):
    return V.at_floor_rank(table(spark, d, "customer"), "c_mktsegment", "c_acctbal", 0.95, "p95")


KEYWORDS = ("license", "the", "eau", "idiot")


@registered(" UNION ALL ".join(f"SELECT '{k}' AS keyword, count(*) FILTER (WHERE contains(lower(text), '{k}')) AS n, CAST(sum(length(lower(text)) - length(replace(lower(text), '{k}', ''))) // {len(k)} AS BIGINT) AS hits FROM documents" for k in KEYWORDS))
def keyword_hits(spark, d):
    words = readers.inline_table(spark, [(k,) for k in KEYWORDS], "keyword string").select("keyword")
    found = marker_hits(table(spark, d, "documents").select("doc_id", F.lower("text").alias("t")), "t", words)
    counts = found.groupBy(F.col("marker").alias("keyword")).agg(F.count("*").alias("n"), F.sum("apart").alias("hits"))
    return words.join(counts, "keyword", "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n", "hits")})


@registered(
    f"""WITH k AS (SELECT unnest({_list(list(KEYWORDS))}) AS marker), p AS (SELECT page_id, url, marker, lower(html) AS t FROM pages, k)
SELECT marker, count(DISTINCT split_part(url, '/', 3)) AS pages, CAST(sum((length(t) - length(replace(t, marker, ''))) // length(marker)) AS BIGINT) AS apart FROM p WHERE contains(t, marker) GROUP BY marker"""
)
def hosts_of_keywords(spark, d):
    """Each keyword's hosts, and its hits in all pages."""
    words = readers.inline_table(spark, [(k,) for k in KEYWORDS], "keyword string").select("keyword")
    pages = table(spark, d, "pages").select(F.element_at(F.split("url", "/"), 3).alias("host"), F.lower("html").alias("t"))
    return pages_of_markers(marker_hits(pages, "t", words), "host").select("marker", "pages", "apart")


@registered("SELECT source, count(*) AS total, count(*) FILTER (WHERE lang = 'en') AS en, count(*) FILTER (WHERE lang = 'fr') AS fr FROM documents GROUP BY source HAVING count(*) <> count(*) FILTER (WHERE lang IN ('en', 'fr'))")
def inventory_equation(spark, d):
    """Sources whose documents aren't all English or French."""
    c = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("total"), F.count_if(F.col("lang") == "en").alias("en"), F.count_if(F.col("lang") == "fr").alias("fr"))
    return V.inventory_faults(c, "total", ["en", "fr"])


@registered(
    """WITH r AS (SELECT event_type, CASE WHEN count(*) FILTER (WHERE value < 0) = 0 THEN 'complete' ELSE 'partial' END AS status, CAST(CAST(max(ts) AS DATE) AS VARCHAR) AS reviewed FROM events GROUP BY 1)
SELECT CASE WHEN bool_and(status = 'complete') THEN 'complete' ELSE 'partial' END AS coverage_status, min(reviewed) AS verified_through FROM r"""
)
def coverage_status(spark, d):
    e = table(spark, d, "events").groupBy("event_type").agg(F.when(F.count_if(F.col("value") < 0) == 0, "complete").otherwise("partial").alias("status"), F.max("ts").cast("date").cast("string").alias("reviewed_through"))
    return V.coverage_status(e)


@registered("SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2")
def value_distribution(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))


@registered("SELECT DISTINCT source AS scope FROM documents UNION SELECT DISTINCT lang FROM documents")
def scope_set(spark, d):
    r = table(spark, d, "documents")
    return r.select(F.explode(F.array("source", "lang")).alias("scope")).distinct()


@registered(
    """WITH s AS (SELECT o_orderkey, lag(o_orderkey) OVER a AS p, lead(o_orderkey) OVER a AS n, lag(o_orderkey) OVER b AS tp, lead(o_orderkey) OVER b AS tn
    FROM orders WINDOW a AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), b AS (PARTITION BY o_custkey ORDER BY o_orderkey))
SELECT o_orderkey FROM s WHERE p IS DISTINCT FROM tp OR n IS DISTINCT FROM tn"""
)
def sequence_rule(spark, d):
    """Neighbours stated by date, held against the order of the keys."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    stated = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.lag("o_orderkey").over(w).alias("p"), F.lead("o_orderkey").over(w).alias("n"))
    return V.sequence_faults(stated, "o_custkey", "o_orderkey", "p", "n").select("o_orderkey")


@registered("""SELECT page_id, regexp_extract(url, '[?&]page=([^&#]*)', 1) AS page, regexp_extract(url, '[?&]ref=([^&#]*)', 1) AS ref FROM pages""")
def url_parameters(spark, d):
    return table(spark, d, "pages").select("page_id", readers.url_parameter(F.col("url"), "page").alias("page"), readers.url_parameter(F.col("url"), "ref").alias("ref"))


@registered("""SELECT page_id, '<url><loc>' || replace(replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') || '</loc></url>' AS line FROM pages""")
def sitemap_lines(spark, d):
    return table(spark, d, "pages").select("page_id", F.concat(F.lit("<url><loc>"), sinks.escaped(F.col("url")), F.lit("</loc></url>")).alias("line"))


@registered("""SELECT p_partkey, '{"name":"' || p_name || '\\u003c","size":' || p_size || '}' AS json FROM part""")
def safe_embedding(spark, d):
    return table(spark, d, "part").select("p_partkey", sinks.safe_json(F.struct(F.concat("p_name", F.lit("<")).alias("name"), F.col("p_size").alias("size"))).alias("json"))


@registered("SELECT o_orderkey, CASE WHEN length(CAST(o_orderkey * 37 AS VARCHAR)) >= 6 THEN 'no' || (o_orderkey * 37) ELSE '' END AS number FROM orders")
def number_queries(spark, d):
    return table(spark, d, "orders").select("o_orderkey", X.number_query(F.concat(F.lit("No. "), (F.col("o_orderkey") * 37).cast("string"), F.lit("號"))).alias("number"))


@registered(f"SELECT item_id, CAST(len(list_distinct(list_filter(regexp_split_to_array({_norm('text')}, '[\\s,;]+'), lambda t: t <> ''))) AS INTEGER) AS n_tokens, CAST(length(regexp_replace(text, '\\s+', '', 'g')) AS INTEGER) AS n_compact FROM benchmark")
def token_counts(spark, d):
    b = table(spark, d, "benchmark")
    return b.select("item_id", F.size(X.tokens(X.normalize(F.col("text")))).alias("n_tokens"), F.length(X.compact(F.col("text"))).alias("n_compact"))


_MARKED_SQL = (
    "WITH t(task, markers) AS (VALUES "
    + ", ".join(f"('{t}', {_list(m)})" for t, m in TASKS)
    + "), m AS (SELECT source AS owner, task, min(doc_id) AS page FROM documents, t WHERE len(list_filter(markers, lambda m: contains(text, m))) > 0 GROUP BY 1, 2) "
)


def _marked(spark: SparkSession, d: str) -> DataFrame:
    return earliest_marker(spark, d).select("owner", "task", "page")


@registered(_MARKED_SQL + "SELECT owner, task FROM (SELECT DISTINCT source AS owner FROM documents), (SELECT task FROM t) EXCEPT SELECT owner, task FROM m")
def unmapped_tasks(spark, d):
    tasks = readers.inline_table(spark, TASKS, "task string, markers array<string>").select("task")
    every = table(spark, d, "documents").select(F.col("source").alias("owner")).distinct().join(F.broadcast(tasks))
    return every.join(_marked(spark, d), ["owner", "task"], "left_anti")


@registered(_MARKED_SQL + "SELECT page, CASE WHEN count(*) = 1 THEN min(task) END AS anchor FROM m GROUP BY page")
def single_anchors(spark, d):
    return E.single_anchor(_marked(spark, d).withColumn("anchor", F.col("task")))


@registered("SELECT text AS text, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return V.duplicates(table(spark, d, "documents"), "text")


@registered("SELECT doc_id FROM documents WHERE lang = 'en' INTERSECT SELECT doc_id FROM labels WHERE quality = 1")
def set_intersection(spark, d):
    return table(spark, d, "documents").where("lang = 'en'").select("doc_id").intersect(table(spark, d, "labels").where("quality = 1").select("doc_id"))


@registered("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def set_except(spark, d):
    return table(spark, d, "documents").select("doc_id").subtract(table(spark, d, "labels").select("doc_id"))


@registered("SELECT doc_id, CAST(length(text) AS INTEGER) AS size, CASE WHEN doc_id > 2 THEN doc_id - 2 END AS printed FROM documents")
def printed_pages(spark, d):
    return table(spark, d, "documents").select("doc_id", F.length("text").alias("size"), X.printed_page(F.col("doc_id")).alias("printed"))


@registered()
def table_fingerprint(spark, d):
    return V.table_hash(table(spark, d, "documents"))
