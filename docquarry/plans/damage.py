"""Queries on orders that should agree, and on rules tried on damaged tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import mutations as M
from ..operators import ordering as O
from ..operators import validation as V
from .catalogue import registered, table


@registered(
    """WITH RECURSIVE t AS (SELECT l_orderkey AS k, l_linenumber AS i, min(l_shipdate) AS s FROM lineitem WHERE NOT (l_returnflag = 'R' AND l_linenumber % 4 = 0) GROUP BY ALL),
a AS (SELECT l_orderkey AS k, l_linenumber AS i, min(l_partkey) AS f, count(*) AS n FROM lineitem GROUP BY ALL),
d AS (SELECT k, i, s, row_number() OVER (PARTITION BY k ORDER BY f, i) AS p FROM a JOIN t USING (k, i)),
c AS (SELECT k, p, s, i, [p] AS path FROM d UNION ALL SELECT d.k, d.p, d.s, d.i, list_append(c.path, d.p) FROM c JOIN d ON c.k = d.k AND d.p > c.p AND (d.s, d.i) > (c.s, c.i)),
b AS (SELECT k, path FROM (SELECT k, path, row_number() OVER (PARTITION BY k ORDER BY len(path) DESC, path) AS r FROM c) WHERE r = 1)
SELECT k AS l_orderkey, i AS l_linenumber, 'missing-target' AS fault FROM a ANTI JOIN t USING (k, i)
UNION ALL SELECT k, i, 'repeated' FROM a WHERE n > 1
UNION ALL SELECT k, i, 'out-of-place' FROM d JOIN b USING (k) WHERE NOT list_contains(path, p)"""
)
def order_faults(spark, d):
    """Lines of all orders, listed by their parts, against the order of their shipment; returned fourth lines aren't there."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("position"), F.col("l_shipdate").alias("place"), "l_returnflag")
    return O.order_faults(lines, lines.where("NOT (l_returnflag = 'R' AND l_linenumber % 4 = 0)"), "l_orderkey", "l_linenumber")


@registered(
    """SELECT page_id, unnest(CASE page_id % 5 WHEN 1 THEN ['_a'] WHEN 2 THEN ['_d'] WHEN 3 THEN ['_a'] WHEN 4 THEN [NULL] ELSE [] END) AS id,
    CASE page_id % 5 WHEN 1 THEN 'out-of-place' WHEN 2 THEN 'missing-target' WHEN 3 THEN 'repeated' ELSE 'no-contents' END AS fault FROM pages WHERE page_id % 5 <> 0"""
)
def contents_faults(spark, d):
    """All pages get contents: right ones, ones in another order, with a target that isn't there, with one twice, and none."""
    k = F.col("page_id") % 5
    links = F.when(k == 1, F.array(*map(F.lit, "bac"))).when(k == 2, F.array(*map(F.lit, "abdc"))).when(k == 3, F.array(*map(F.lit, "abca"))).when(k == 4, F.array().cast("array<string>")).otherwise(F.array(*map(F.lit, "abc")))
    nav = F.concat(F.lit("<details data-contents>"), F.array_join(F.transform(links, lambda x: F.concat(F.lit('<a href="#_'), x, F.lit('">x</a>'))), ""), F.lit("</details>"))
    html = F.concat(nav, F.col("html"), F.lit('<h2 id="_a">a</h2><a href="#_c">c</a><h2 id="_b">b</h2><h2 id="_c">c</h2>'))
    return O.contents_faults(table(spark, d, "pages").select("page_id", html.alias("html")), "page_id", "data-contents")


def _damaged(spark, d):
    """Records, their mirror, owners, links, pages, turns and reviews, with damage of many kinds."""
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    key, owner = F.col("c_custkey").cast("string"), F.concat(F.lit("loan:"), F.col("c_nationkey").cast("string"))
    records = c.select(key.alias("id"), F.lit("page").alias("type"), F.lit("section:x").alias("scope"), owner.alias("scope_group"), F.col("c_name").alias("title"), F.concat(key, F.lit(".html")).alias("url"), F.col("c_custkey").alias("k"))
    turns = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("o"), "turn", F.col("conv_id").alias("k"))
    w = Window.partitionBy("o").orderBy("turn")
    turns = turns.withColumns({"before": F.lag("turn").over(w), "after": F.lead("turn").over(w)})
    suppliers = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_suppkey").cast("string").alias("source"), F.concat(F.col("s_suppkey").cast("string"), F.lit(".html")).alias("path"), F.lit("top").alias("fragment"))
    tables = {
        "records": M.Table(records, ("id", "scope_group")),
        "mirror": M.Table(c.select(key.alias("id"), F.col("c_name").alias("title")), ("id",)),
        "owners": M.Table(n.select(F.concat(F.lit("loan:"), F.col("n_nationkey").cast("string")).alias("scope"), F.col("n_nationkey").alias("k")), ("scope",)),
        "links": M.Table(suppliers, ("source", "path")),
        "targets": M.Table(suppliers.select("k", "path", "fragment"), ("path",)),
        "turns": M.Table(turns, ("o",)),
        "reviews": M.Table(suppliers.select("k", F.col("source").alias("source_id"), F.lit(9).alias("hits"), F.lit(5).alias("candidates"), F.lit(4).alias("out_of_scope"), F.lit("2024-02-02").alias("reviewed_through"), F.lit("2024-01-01").alias("verified_through")), ("source_id",)),
    }
    seventh, third = F.col("k") % 7 == 0, F.col("k") % 3 == 0
    mutations = [
        M.Mutation("type-unknown", "records", seventh, {"type": F.lit("other")}),
        M.Mutation("scope-wrong", "records", seventh, {"scope": F.lit("loan:x")}),
        M.Mutation("owner-gone", "owners", third, copies=0),
        M.Mutation("title-blank", "records", seventh, {"title": F.lit(" ")}),
        M.Mutation("url-absolute", "records", seventh, {"url": F.lit("https://x")}),
        M.Mutation("record-gone", "records", seventh, copies=0),
        M.Mutation("record-twice", "records", seventh, copies=2),
        M.Mutation("page-gone", "targets", third, copies=0),
        M.Mutation("id-gone", "targets", third, {"fragment": F.lit("")}),
        M.Mutation("next-lost", "turns", seventh, {"after": F.lit(None).cast("int")}),
        M.Mutation("hits-too-few", "reviews", third, {"hits": F.lit(8)}),
        M.Mutation("review-too-old", "reviews", third, {"reviewed_through": F.lit("2023-12-31")}),
        M.Mutation("scope-longer", "records", seventh, {"scope": F.lit("section:y")}),  # harmless
    ]
    rules = {
        "index": lambda t: V.index_faults(t["records"].drop("k"), t["owners"], {"page": "section:"}),
        "parity": lambda t: V.parity_faults(t["records"], t["mirror"], "id", ["title"]),
        "links": lambda t: V.unresolved_links(t["links"].drop("k"), t["targets"].drop("k")),
        "sequence": lambda t: V.sequence_faults(t["turns"], "o", "turn", "before", "after").select("o"),
        "lineage": lambda t: V.lineage_faults(t["reviews"]),
    }
    return M.corruption_matrix(tables, mutations, rules), mutations


_MATRIX = """WITH c AS (SELECT count(*) AS n FROM customer WHERE c_custkey % 7 = 0), o AS (SELECT count(*) AS n FROM customer WHERE c_nationkey % 3 = 0), s AS (SELECT count(*) AS n FROM supplier WHERE s_suppkey % 3 = 0),
l AS (SELECT count(*) - count(DISTINCT conv_id) AS n FROM conversations WHERE conv_id % 7 = 0),
e AS (SELECT 'type-unknown' AS mutation, 'index' AS rule, 'type' AS fault, n FROM c UNION ALL SELECT 'scope-wrong', 'index', 'scope', n FROM c UNION ALL SELECT 'owner-gone', 'index', 'owner', n FROM o
    UNION ALL SELECT 'title-blank', 'index', 'title', n FROM c UNION ALL SELECT 'title-blank', 'parity', 'title', n FROM c UNION ALL SELECT 'url-absolute', 'index', 'url', n FROM c
    UNION ALL SELECT 'record-gone', 'parity', 'missing-left', n FROM c UNION ALL SELECT 'record-twice', 'index', 'id-twice', 2 * n FROM c UNION ALL SELECT 'record-twice', 'parity', 'repeated', n FROM c
    UNION ALL SELECT 'page-gone', 'links', 'no-page', n FROM s UNION ALL SELECT 'id-gone', 'links', 'no-id', n FROM s UNION ALL SELECT 'next-lost', 'sequence', 'sequence', n FROM l
    UNION ALL SELECT 'hits-too-few', 'lineage', 'hits', n FROM s UNION ALL SELECT 'review-too-old', 'lineage', 'reviewed-through', n FROM s)"""


@registered(_MATRIX + " SELECT mutation, rule, fault, n FROM e WHERE n > 0")
def corruption_matrix(spark, d):
    """Five rules over seven tables, thirteen kinds of damage: the damage each rule finds, and nothing in the tables as they are."""
    return _damaged(spark, d)[0]


@registered(_MATRIX + " SELECT m AS mutation, count(e.rule) > 0 AS caught, coalesce(string_agg(rule || ':' || fault, ' ' ORDER BY rule || ':' || fault), '') AS rules FROM (SELECT '' AS m UNION ALL SELECT 'scope-longer' UNION ALL SELECT DISTINCT mutation FROM e) LEFT JOIN e ON m = mutation AND n > 0 GROUP BY m")
def mutation_verdicts(spark, d):
    return M.mutation_verdicts(*_damaged(spark, d))
