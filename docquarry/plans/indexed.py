"""Queries over saved and published tables: the gram index and its upkeep."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import digest_tree as T
from ..operators import gram_index as G
from ..operators import search as S
from ..sources.shared import fresh_path
from .catalogue import RECORDS_SQL, records, registered, scored_sql, table

# selective terms, a number, a term that the scan must answer, one that nothing has, an empty and a refused query
ASKED = ("license version public", "idiot moron", "no17x", "public license", "eau", "zzzzz", " ", "x" * 300)


def _batch_sql(source: str, queries: tuple[str, ...]) -> str:
    live = [(i, q) for i, q in enumerate(queries) if q.strip() and len(q) <= S.MAX_QUERY]
    parts = ", ".join(scored_sql(q, name=f"s{i}").split("FROM documents\n), ", 1)[1] for i, q in live)
    rows = " UNION ALL ".join(f"SELECT {i} AS query_id, ord, pdf_page, score, match_kind FROM s{i}" for i, _ in live)
    ranked = "CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, coalesce(pdf_page, 0), ord) AS INTEGER) AS rank"
    return f"WITH {RECORDS_SQL.replace('FROM documents', f'FROM {source}')}, {parts}, a AS ({rows}) SELECT query_id, ord, score, match_kind, {ranked} FROM a"


@registered(_batch_sql("documents", ASKED))
def search_indexed(spark, d):
    """All documents are indexed; a table of queries is answered from the index."""
    index = G.build(records(spark, d), fresh_path(spark, "index"))
    found = G.search(index, S.query_table(index.records, *ASKED), proximity=False, spread=False)
    return found.select("query_id", "ord", "score", "match_kind", "rank")


# what happens to a document between two states of the table, by its id: it is new, gets another text, or goes
_LATER_SQL = """(SELECT doc_id, CASE WHEN doc_id % 7 = 1 THEN 'public license moron ' || text ELSE text END AS text, lang, source, n_chars FROM documents WHERE doc_id % 7 <> 2)"""


def _states(spark, d):
    """All documents but the new ones, and all but those that went, with the changed texts."""
    now = records(spark, d)
    seventh = F.col("ord") % 7
    changed = F.when(seventh == 1, F.concat(F.lit("public license moron "), F.col("text"))).otherwise(F.col("text"))
    later = now.where(seventh != 2).withColumn("text", changed)
    title = F.substring_index("text", "\n", 1)
    return now.where(seventh != 0), later.withColumn("title", title).withColumn("headings", F.array(title))


@registered("SELECT doc_id AS ord, CASE doc_id % 7 WHEN 0 THEN 'new' WHEN 1 THEN 'changed' ELSE 'deleted' END AS change FROM documents WHERE doc_id % 7 < 3")
def index_changes(spark, d):
    before, later = _states(spark, d)
    return G.changes(G.build(before, fresh_path(spark, "index")), later)


@registered(_batch_sql(_LATER_SQL, ASKED[:4]))
def search_refreshed(spark, d):
    """The index follows a table in which a seventh each is new, changed and deleted."""
    before, later = _states(spark, d)
    target = fresh_path(spark, "index")
    index = G.refresh(G.build(before, target), target, later)
    found = G.search(index, S.query_table(index.records, *ASKED[:4]), proximity=False, spread=False)
    return found.select("query_id", "ord", "score", "match_kind", "rank")


@registered("SELECT doc_id, CASE WHEN doc_id % 97 = 0 THEN 'changed' WHEN doc_id % 97 = 1 THEN 'removed' ELSE 'added' END AS change FROM documents WHERE doc_id % 97 < 3")
def changed_rows(spark, d):
    """Two builds of the documents that differ in a few rows; the trees' differing leaves lead to them."""
    docs, k = table(spark, d, "documents"), F.col("doc_id") % 97
    before = T.write_by_leaf(docs.where(k != 2), fresh_path(spark, "build"), "doc_id")
    after = T.write_by_leaf(docs.where(k != 1).withColumn("text", F.when(k == 0, F.concat("text", F.lit(" "))).otherwise(F.col("text"))), fresh_path(spark, "build"), "doc_id")
    return T.changed_rows(before, after, "doc_id")


@registered("SELECT 1 AS roots, count(*) AS n FROM documents")
def build_orders(spark, d):
    """Four builds in different orders of rows and columns: one root."""
    docs = table(spark, d, "documents")
    builds = [docs, docs.orderBy("text"), docs.repartition("source", "doc_id").select(*sorted(docs.columns, reverse=True)), docs.where("lang = 'en'").union(docs.where("coalesce(lang, '') <> 'en'"))]
    roots = [T.digest_tree(b, "doc_id").where("level = 0").select("digest", "n") for b in builds]
    every = roots[0].union(roots[1]).union(roots[2]).union(roots[3])
    return every.agg(F.countDistinct("digest").cast("int").alias("roots"), F.max("n").alias("n"))
