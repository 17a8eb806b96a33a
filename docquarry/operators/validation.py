"""Quality rules: each returns the rows that break it, so a clean table gives none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .markers import marker_hits

# Hosts of official sources, kinds of sources and bases of relations.
HOSTS = ("law.afna.gov.tw", "afna.gov.tw", "www.afna.gov.tw", "moa.gov.tw", "www.moa.gov.tw", "wm.moa.gov.tw", "agribank.com.tw", "www.agribank.com.tw")
SOURCE_TYPES = ("regulation", "administrative-rule", "interpretation", "announcement", "faq", "form", "disaster-measure", "other-official")
BASES = ("explicit-title", "explicit-subject", "explicit-body", "common-rule", "disaster-rule", "bank-product", "human-reviewed")


def valid_date(value: Column) -> Column:
    """Null, or a calendar date written YYYY-MM-DD."""
    return value.isNull() | (value.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & F.try_to_date(value).isNotNull())


def official_url(url: Column, hosts: tuple[str, ...] = HOSTS) -> Column:
    return F.coalesce((F.try_parse_url(url, F.lit("PROTOCOL")) == "https") & F.try_parse_url(url, F.lit("HOST")).isin(*hosts), F.lit(False))


def changed_text(rows: DataFrame, before: str, after: str) -> DataFrame:
    """Rows whose texts differ in more than white space."""
    return rows.where(X.compact(F.col(before)) != X.compact(F.col(after)))


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def unknown(rows: DataFrame, ids: str, known: DataFrame, key: str) -> DataFrame:
    """Distinct ids (of a column, or of an array column) that a table doesn't know."""
    flat = rows.select((F.explode(ids) if rows.schema[ids].dataType.typeName() == "array" else F.col(ids)).alias("id")).distinct()
    return flat.join(known.select(F.col(key).alias("id")), "id", "left_anti")


def difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Symmetric difference by key: side is 'left' or 'right'."""
    a, b = left.select(key).distinct().withColumn("_a", F.lit(True)), right.select(key).distinct().withColumn("_b", F.lit(True))
    return a.join(b, key, "full").where("_a IS NULL OR _b IS NULL").select(key, F.when(F.col("_a"), "left").otherwise("right").alias("side"))


def changed(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Keys of both sides whose values differ."""
    r = right.select(key, F.col(value).alias("_other"))
    return left.select(key, value).join(r, key).where(~F.col(value).eqNullSafe(F.col("_other"))).select(key)


def update_faults(updates: DataFrame, loans: DataFrame, sections: DataFrame) -> DataFrame:
    """id and the broken rule of each official update."""
    w = Window.partitionBy("title", "document_number", X.event_date(F.col("published"), F.col("effective"), F.col("version_date")))
    rules = {
        "required": F.coalesce(F.col("title"), F.lit("")) == "",
        "source-type": ~F.coalesce(F.col("source_type").isin(*SOURCE_TYPES), F.lit(False)),
        "relation-basis": ~F.coalesce(F.col("relation_basis").isin(*BASES), F.lit(False)),
        "date": ~(valid_date(F.col("published")) & valid_date(F.col("effective")) & valid_date(F.col("version_date"))),
        "no-date": F.coalesce("published", "effective", "version_date").isNull(),
        "period": F.col("period.start") > F.col("period.end"),
        "url": ~official_url(F.col("source_url")),
        "duplicate": F.col("_same") > 1,
    }
    found = updates.withColumn("_same", F.count("*").over(w)).select("id", F.explode(F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in rules.items()]), lambda x: x.isNotNull())).alias("fault"))
    for ids, known, name in (("loan_ids", loans, "unknown-loan"), ("section_ids", sections, "unknown-section")):
        flat = updates.select(F.col("id").alias("u"), F.explode(ids).alias("id")).join(known.select("id"), "id", "left_anti")
        found = found.union(flat.select(F.col("u").alias("id"), F.lit(name).alias("fault")))
    return found.distinct()


def coverage_status(reviews: DataFrame) -> DataFrame:
    """complete if every source is, and the date up to which all are reviewed."""
    return reviews.agg(F.when(F.bool_and(F.col("status") == "complete"), "complete").otherwise("partial").alias("coverage_status"), F.min("reviewed_through").alias("verified_through"))


def sequence_faults(rows: DataFrame, group: str, order: str, previous: str, following: str) -> DataFrame:
    """Rows whose stated neighbours aren't the neighbours in order."""
    w = Window.partitionBy(group).orderBy(order)
    out = rows.withColumns({"_p": F.lag(order).over(w), "_n": F.lead(order).over(w)})
    return out.where(~F.col(previous).eqNullSafe(F.col("_p")) | ~F.col(following).eqNullSafe(F.col("_n"))).drop("_p", "_n")


def page_faults(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Pages without exactly one main heading, or with an id twice."""
    ids = F.regexp_extract_all(html_col, F.lit(r'\sid="([^"]*)"'), F.lit(1))
    heads = F.regexp_count(F.col(html_col), F.lit("(?i)<h1[ >]"))
    twice = F.size(ids) > F.size(F.array_distinct(ids))
    found = pages.select(id_col, F.explode(F.filter(F.array(F.when(heads != 1, F.lit("main-heading")), F.when(twice, F.lit("id-twice"))), lambda x: x.isNotNull())).alias("fault"))
    return found


def inventory_faults(counts: DataFrame, total: str, parts: list[str]) -> DataFrame:
    """Rows where the total isn't the sum of its parts."""
    whole = F.lit(0)
    for p in parts:
        whole = whole + F.coalesce(F.col(p), F.lit(0))
    return counts.where(F.col(total) != whole)


def parity_faults(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of two tables that should say the same: key and missing-right, missing-left, repeated or the columns that differ."""
    side = lambda df, s: df.groupBy(key).agg(F.count("*").alias(f"_{s}"), *[F.min(c).alias(f"_{s}_{c}") for c in columns])
    met = side(left, "l").join(side(right, "r"), key, "full")
    rules = [F.when(F.col("_r").isNull(), F.lit("missing-right")), F.when(F.col("_l").isNull(), F.lit("missing-left")), F.when(F.greatest("_l", "_r") > 1, F.lit("repeated"))]
    both = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    rules += [F.when(both & ~F.col(f"_l_{c}").eqNullSafe(F.col(f"_r_{c}")), F.lit(c)) for c in columns]
    return met.select(key, F.explode(F.filter(F.array(*rules), lambda x: x.isNotNull())).alias("fault"))


def unresolved_links(links: DataFrame, targets: DataFrame) -> DataFrame:
    """Links (source, path, fragment) to a page that isn't there, or to an id that the page hasn't. targets: path, fragment."""
    pages = targets.select("path").distinct().withColumn("_page", F.lit(True))
    ids = targets.where("fragment <> ''").select("path", "fragment").distinct().withColumn("_id", F.lit(True))
    met = links.join(pages, "path", "left").join(ids, ["path", "fragment"], "left")
    fault = F.when(F.col("_page").isNull(), "no-page").when((F.col("fragment") != "") & F.col("_id").isNull(), "no-id")
    return met.withColumn("fault", fault).where("fault IS NOT NULL").select("source", "path", "fragment", "fault")


def reparse_faults(letters: DataFrame, parsed: Column) -> DataFrame:
    """Letters (id, document_number, pdf_page) that a strict parse reads otherwise, or whose number and page occur twice."""
    same = F.count("*").over(Window.partitionBy("document_number", "pdf_page"))
    rules = [F.when(~parsed.eqNullSafe(F.col("document_number")), F.lit("reparse")), F.when(F.col("_same") > 1, F.lit("twice"))]
    return letters.withColumn("_same", same).select("id", F.explode(F.filter(F.array(*rules), lambda x: x.isNotNull())).alias("fault"))


def weak_evidence(decisions: DataFrame, pages: DataFrame, id_col: str = "id") -> DataFrame:
    """Decisions (id, excerpt, evidence_pages) whose excerpt stands on none of their pages (page, text), white space aside."""
    flat = decisions.select(id_col, X.compact(F.col("excerpt")).alias("_e"), F.explode_outer("evidence_pages").alias("page"))
    met = flat.join(pages.select("page", X.compact(F.col("text")).alias("_t")), "page", "left")
    held = met.groupBy(id_col).agg(F.coalesce(F.bool_or((F.col("_e") != "") & F.contains("_t", F.col("_e"))), F.lit(False)).alias("_held"))
    return held.where("NOT _held").select(id_col)


def index_faults(records: DataFrame, owners: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Index records that are incomplete or out of scope: id and fault. kinds: a type and what its scope begins with.

    owners: scope, for every scope that a record's scope_group may name.
    """
    again = F.count("*").over(Window.partitionBy("id"))
    begins = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])[F.col("type")]
    met = records.withColumn("_again", again).join(owners.select(F.col("scope").alias("scope_group"), F.lit(True).alias("_owner")).distinct(), "scope_group", "left")
    rules = [
        F.when(F.col("_again") > 1, F.lit("id-twice")),
        F.when(begins.isNull(), F.lit("type")),
        F.when(begins.isNotNull() & ~F.coalesce(F.col("scope").startswith(begins), F.lit(False)), F.lit("scope")),
        F.when(F.col("scope_group").isNotNull() & F.col("_owner").isNull(), F.lit("owner")),
        F.when(F.coalesce(X.squeeze(F.col("title")), F.lit("")) == "", F.lit("title")),
        F.when(F.coalesce(F.col("url"), F.lit("")).rlike("^$|^/|^[a-z]+:"), F.lit("url")),
    ]
    return met.select("id", F.explode(F.filter(F.array(*rules), lambda x: x.isNotNull())).alias("fault"))


def lineage_faults(reviews: DataFrame) -> DataFrame:
    """Sources whose hits are fewer than their candidates and what is out of scope, or reviewed only before the verified date."""
    rules = [
        F.when(F.col("hits") < F.col("candidates") + F.coalesce("out_of_scope", F.lit(0)), F.lit("hits")),
        F.when(F.col("reviewed_through") < F.col("verified_through"), F.lit("reviewed-through")),
    ]
    return reviews.select("source_id", F.explode(F.filter(F.array(*rules), lambda x: x.isNotNull())).alias("fault"))


def structure_faults(pages: DataFrame, rules: dict[str, tuple[str, int, int]], id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Pages on which a pattern occurs too seldom or too often. rules: name to (pattern, least, most)."""
    n = lambda p: F.regexp_count(F.col(html_col), F.lit(p))
    found = [F.when(~n(p).between(a, b), F.lit(name)) for name, (p, a, b) in rules.items()]
    return pages.select(id_col, F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("fault"))


def forbidden_tokens(rows: DataFrame, id_col: str, text_col: str, tokens: dict[str, str | tuple[str, ...]]) -> DataFrame:
    """Rows with something that mustn't be published (scripts, residues, local paths): id and the kind's name, once.

    Each text is read once for all tokens."""
    kinds = rows.sparkSession.createDataFrame([(k, t) for k, group in tokens.items() for t in ((group,) if isinstance(group, str) else group)], "fault string, marker string")
    found = marker_hits(rows.select(id_col, text_col), text_col, kinds.select("marker"))
    return found.join(F.broadcast(kinds), "marker").select("_row", id_col, "fault").distinct().drop("_row")


def without_tokens(rows: DataFrame, id_col: str, text_col: str, tokens: list[str]) -> DataFrame:
    """Rows that lack a token that must be there: id and token."""
    lacking = F.filter(F.array(*map(F.lit, tokens)), lambda t: ~F.contains(F.coalesce(F.col(text_col), F.lit("")), t))
    return rows.select(id_col, F.explode(lacking).alias("token"))


def inconsistent(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Groups that don't all say the same, with the number of different values."""
    return rows.groupBy(group).agg(F.countDistinct(value).alias("n_values")).where("n_values > 1")


def untold(rows: DataFrame, id_col: str, text: Column, title: Column, number: Column) -> DataFrame:
    """Rows of which neither a spelling of the title (``text.title_variants``) nor the number stands in the text of the
    source, letters and digits alone."""
    held = lambda form: (form != "") & F.contains(F.col("_f"), form)
    by_title = F.exists(X.title_variants(title), lambda t: held(X.audit_form(t)))
    return rows.withColumn("_f", X.audit_form(text)).where(~F.coalesce(by_title | held(X.audit_form(number)), F.lit(False))).select(id_col)


def fixture_faults(results: DataFrame, fixtures: DataFrame) -> DataFrame:
    """Fixtures (name, expected: ids in order) that the results (name, id, rank) don't meet in this order."""
    got = results.groupBy("name").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("got"))
    none = fixtures.join(got, "name", "left").withColumn("got", F.coalesce("got", F.slice("expected", 1, 0)))
    return none.where(~F.col("got").eqNullSafe(F.col("expected"))).select("name")


def without_top(results: DataFrame, k: int, wanted: Column) -> DataFrame:
    """Queries with no wanted row among the first k."""
    return results.groupBy("query_id").agg(F.coalesce(F.bool_or((F.col("rank") <= k) & wanted), F.lit(False)).alias("_hit")).where("NOT _hit").select("query_id")


def ranking_changes(before: DataFrame, after: DataFrame, k: int = 10) -> DataFrame:
    """For each query: how many of the first k stayed, came and went, and whether the first row is the same."""
    side = lambda df, s: df.where(F.col("rank") <= k).select("query_id", "ord", F.col("rank").alias(f"_{s}"))
    met = side(before, "b").join(side(after, "a"), ["query_id", "ord"], "full")
    return met.groupBy("query_id").agg(
        F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("stayed"),
        F.count_if(F.col("_b").isNull()).alias("came"),
        F.count_if(F.col("_a").isNull()).alias("went"),
        F.coalesce(F.bool_or((F.col("_a") == 1) & (F.col("_b") == 1)), F.lit(False)).alias("same_first"),
    )


def table_hash(df: DataFrame) -> DataFrame:
    """One row: number of rows and a hash that doesn't depend on their order. Equal for equal builds."""
    row = F.xxhash64(*[F.col(c) for c in sorted(df.columns)])
    return df.select(row.alias("h")).agg(F.count("*").alias("rows"), F.bit_xor("h").alias("xor"), F.sum(F.pmod("h", F.lit(1 << 31))).alias("sum"))


def precision_at(results: DataFrame, k: int, relevant: Column) -> DataFrame:
    """Share of relevant rows among each query's first k (in thousandths, rounded down)."""
    return results.where(F.col("rank") <= k).groupBy("query_id").agg(F.expr("count(*)").alias("shown"), F.count_if(relevant).alias("relevant")).withColumn("precision_thousandths", F.expr("relevant * 1000 DIV shown"))


def nearest_rank(column: str, share: float) -> Column:
    """The ceil(n * share)-th smallest value."""
    return F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY {column})")


def at_floor_rank(rows: DataFrame, group: str, column: str, share: float, alias: str) -> DataFrame:
    """The value at place floor(n * share) of each group, counted from 0, at most the last. No group is gathered in a row."""
    w = Window.partitionBy(group)
    placed = rows.where(F.col(column).isNotNull()).select(group, F.col(column).alias(alias), (F.row_number().over(w.orderBy(column)) - 1).alias("_at"), F.count("*").over(w).alias("_n"))
    return placed.where(F.col("_at") == F.least(F.col("_n") - 1, F.floor(F.col("_n") * F.lit(share)))).drop("_at", "_n")
