"""Queries over the elements and links of all pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import addresses as A
from ..sources import elements as H
from ..sources import readers
from .catalogue import registered, table


@registered(r"""SELECT page_id, tag, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(regexp_replace(html, '(?s)<script.*?</script>', '<script>', 'g'), '<([a-zA-Z][a-zA-Z0-9]*)', 1)) AS tag FROM pages) GROUP BY ALL""")
def element_counts(spark, d):
    found = H.html_elements(table(spark, d, "pages").select("page_id", "html"))
    return found.groupBy("page_id", "tag").agg(F.count("*").alias("n"))


_FAULTY = """CASE page_id % 3 WHEN 0 THEN replace(html, '<h1', '<h2') WHEN 1 THEN replace(html, '<p>', '<p id="twice">') ELSE html END"""


@registered(
    f"""WITH p AS (SELECT page_id, len(regexp_extract_all(h, '(?i)<h1[ >]')) AS h, len(regexp_extract_all(h, '<p id="twice">')) AS ids FROM (SELECT page_id, {_FAULTY} AS h FROM pages))
SELECT page_id, 'main-heading' AS fault FROM p WHERE h <> 1 UNION ALL SELECT page_id, 'id-twice' FROM p WHERE ids > 1 UNION ALL SELECT page_id, 'canonical' FROM pages WHERE page_id % 4 <> 0"""
)
def element_faults(spark, d):
    """All pages: a third lost the main heading, a third got an id several times; a fourth has a right canonical link."""
    third, html = F.col("page_id") % 3, F.col("html")
    html = F.when(third == 0, F.replace(html, F.lit("<h1"), F.lit("<h2"))).when(third == 1, F.replace(html, F.lit("<p>"), F.lit('<p id="twice">'))).otherwise(html)
    right = F.when(F.col("page_id") % 4 == 0, F.col("page_id")).otherwise(F.col("page_id") + 1)
    html = F.replace(html, F.lit("<head>"), F.concat(F.lit('<head><link rel="canonical" href="/p/'), right.cast("string"), F.lit('">')))
    pages = table(spark, d, "pages").select("page_id", F.concat(F.lit("/p/"), F.col("page_id").cast("string")).alias("address"), html.alias("html"))
    return H.element_faults(H.html_elements(pages), "page_id", "address")


# links as the pages have them, and one of each kind more
_EXTRA = ("../up?q=1#here", "./x/../y", "../../../../../out", "?only=query", "#part", "https://else.example/a/../b", "mailto:a@b", "")
_BASE = "split_part(split_part(url, '#', 1), '?', 1)"


@registered(
    r"""WITH l AS (
    SELECT page_id, url, unnest(list_distinct(regexp_extract_all(html, '<[a-zA-Z][a-zA-Z0-9]*\s[^>]*?\bhref="([^"]*)"', 1) || ["""
    + ", ".join(f"'{x}'" for x in _EXTRA)
    + rf"""])) AS link FROM pages
), b AS (
    SELECT *, regexp_extract(url, '^[a-z]+://[^/?#]*') AS root, regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.\-]*:|^//') AS external, regexp_extract(link, '^[^?#]*') AS own,
        {_BASE} AS plain, split_part(url, '#', 1) AS page
    FROM l
), f AS (
    SELECT *, string_split(ltrim(CASE WHEN starts_with(own, '/') THEN own ELSE regexp_replace(substr(plain, length(root) + 1), '[^/]*$', '') || own END, '/'), '/') AS parts FROM b
), r AS (
    SELECT *, list_reduce(parts, lambda a, p: CASE WHEN p = '..' AND a = '' THEN chr(1) WHEN p = '..' AND regexp_matches(a, '^\x01+$') THEN a || chr(1) WHEN p = '..' THEN regexp_replace(a, '(/|^|(\x01))[^/\x01]*$', '\2')
        WHEN p = '.' THEN a ELSE a || '/' || p END, '') AS folded FROM f
)
SELECT page_id, link, external,
    CASE WHEN external THEN regexp_replace(link, '#.*$', '') WHEN own = '' THEN CASE WHEN contains(link, '?') THEN plain || regexp_extract(link, '\?[^#]*') ELSE page END
        ELSE root || CASE WHEN replace(folded, chr(1), '') = '' THEN '/' ELSE replace(folded, chr(1), '') END || CASE WHEN contains(link, '?') THEN regexp_extract(link, '\?[^#]*') ELSE '' END END AS address,
    CASE WHEN contains(link, '#') THEN regexp_extract(link, '#(.*)$', 1) ELSE '' END AS fragment,
    CASE WHEN external OR own = '' THEN 0 ELSE length(folded) - length(replace(folded, chr(1), '')) END AS escapes
FROM r"""
)
def resolved_links(spark, d):
    pages = table(spark, d, "pages")
    links = F.array_distinct(F.concat(readers.html_attributes(F.col("html"), "href"), F.array(*map(F.lit, _EXTRA))))
    rows = pages.select("page_id", "url", F.explode(links).alias("link")).withColumn("t", A.resolved(F.col("url"), F.col("link")))
    return rows.select("page_id", "link", "t.external", "t.address", "t.fragment", "t.escapes")


@registered(
    "SELECT page_id, unnest(['escapes', 'no-page', 'no-id']) AS fault FROM pages"
)
def link_faults(spark, d):
    """Every page has five links more: to itself, to one of its ids, above the root, to no page, and to an id that it lacks."""
    pages = table(spark, d, "pages").select("page_id", F.col("url").alias("page"))
    asked = F.array(F.lit(""), F.lit("#top"), F.lit("../../../../../../x"), F.lit("./no/such/page"), F.lit("#missing"))
    links = pages.select("page_id", "page", F.explode(asked).alias("link"))
    ids = pages.select(F.col("page").alias("address"), F.lit("top").alias("fragment"))
    faults = A.link_faults(links.select("page", "link").distinct(), pages.select(F.col("page").alias("address")), ids)
    return pages.join(faults, "page").select("page_id", "fault")
