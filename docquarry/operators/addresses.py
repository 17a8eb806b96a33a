"""Links as written, resolved from the page that they stand on, and held against the pages and ids that there are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def _folded(path: Column) -> Column:
    """struct<path, escapes>: without . and .. parts; escapes counts the .. that climb above the root."""
    kind = "struct<kept:array<string>,escapes:int>"
    parts = F.split(F.regexp_replace(path, "^/", ""), "/", -1)
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("escapes")).cast(kind)

    def step(acc: Column, part: Column) -> Column:
        up, n = part == "..", F.size(acc["kept"])
        kept = F.when(up, F.slice(acc["kept"], F.lit(1), F.greatest(n - 1, F.lit(0)))).when(part == ".", acc["kept"]).otherwise(F.array_append(acc["kept"], part))
        return F.struct(kept.alias("kept"), (acc["escapes"] + F.when(up & (n == 0), 1).otherwise(0)).alias("escapes")).cast(kind)

    def told(acc: Column) -> Column:
        folder = path.rlike(r"(?:^|/)\.\.?$") & (F.size(acc["kept"]) > 0)  # a last . or .. names a folder
        return F.struct(F.concat(F.lit("/"), F.array_join(acc["kept"], "/"), F.when(folder, F.lit("/")).otherwise(F.lit(""))).alias("path"), acc["escapes"].alias("escapes"))

    return F.aggregate(parts, start, step, told)


def resolved(page: Column, link: Column) -> Column:
    """struct<address, fragment, external, escapes> of a link on a page whose address has a host.

    A link with a scheme or host of its own is external and stays as it is. Others take the page's: an empty path means
    the page itself, with its query unless the link has one; a path from the root replaces the page's, any other replaces
    what follows the last slash. Parts . and .. are folded. A null page or link gives null.
    """
    of = lambda c, i: F.regexp_extract(c, _PARTS, i)
    has_query = link.rlike(r"^[^#]*\?")
    external = (of(link, 1) != "") | (of(link, 2) != "") | link.startswith("//")
    own, base = of(link, 3), F.when(of(page, 3) == "", F.lit("/")).otherwise(of(page, 3))
    folded = _folded(F.when(own.startswith("/"), own).otherwise(F.concat(F.regexp_replace(base, "[^/]*$", ""), own)))
    path = F.when(own == "", base).otherwise(folded["path"])
    query = F.when(has_query | (own != ""), F.when(has_query, F.concat(F.lit("?"), of(link, 4))).otherwise(F.lit(""))).otherwise(F.when(page.rlike(r"^[^#]*\?"), F.concat(F.lit("?"), of(page, 4))).otherwise(F.lit("")))
    inside = F.concat(of(page, 1), F.lit("://"), of(page, 2), path, query)
    address = F.when(external, F.regexp_replace(link, "#.*$", "")).otherwise(inside)
    escapes = F.when(external | (own == ""), 0).otherwise(folded["escapes"])
    out = F.struct(address.alias("address"), of(link, 5).alias("fragment"), external.alias("external"), escapes.alias("escapes"))
    return F.when(page.isNotNull() & link.isNotNull(), out)


def link_faults(links: DataFrame, pages: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows (page, link, fault) of inner links that climb above the root, lead to no page, or to an id that its page lacks.

    links: page (address), link; pages: address; ids: address, fragment. Addresses are compared without fragment.
    """
    at = lambda c: F.regexp_replace(c, "#.*$", "")
    told = links.withColumn("t", resolved(F.col("page"), F.col("link"))).where("NOT t.external").select("page", "link", "t.address", "t.fragment", "t.escapes")
    known = pages.select(at("address").alias("address")).distinct().withColumn("_page", F.lit(True))
    marks = ids.select(at("address").alias("address"), "fragment").distinct().withColumn("_id", F.lit(True))
    met = told.join(known, "address", "left").join(marks, ["address", "fragment"], "left")
    fault = F.when(F.col("escapes") > 0, "escapes").when(F.col("_page").isNull(), "no-page").when((F.col("fragment") != "") & F.col("_id").isNull(), "no-id")
    return met.select("page", "link", fault.alias("fault")).where("fault IS NOT NULL")
