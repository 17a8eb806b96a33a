"""The elements of HTML pages as rows: a table function that is joined laterally to a table of pages."""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_ROW = "number int, parent int, depth int, tag string, id string, attributes map<string,string>, line int, card int, parent_card int, text string"


class _Reader(HTMLParser):
    """Elements in the order of their beginnings. An end tag closes all up to the nearest open element of its name; one
    without such an element is passed over."""

    def __init__(self, attribute: str | None):
        super().__init__()
        self.attribute, self.rows, self.open, self.cards = attribute, [], [], 0

    def handle_starttag(self, tag, attrs):
        given = {k: v or "" for k, v in reversed(attrs)}  # the first of an attribute counts
        above = self.rows[self.open[-1]] if self.open else None
        card = None
        if self.attribute is not None and self.attribute in given:
            card, self.cards = self.cards, self.cards + 1
        around = None if above is None else above["card"] if above["card"] is not None else above["parent_card"]
        row = {"number": len(self.rows), "parent": None if above is None else above["number"], "depth": len(self.open), "tag": tag, "id": given.get("id"), "attributes": given, "line": self.getpos()[0], "card": card, "parent_card": around, "text": []}
        self.rows.append(row)
        if tag not in _VOID:
            self.open.append(row["number"])

    def handle_endtag(self, tag):
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.rows[self.open[i]]["tag"] == tag), None)
        if at is not None:
            del self.open[at:]

    def handle_data(self, data):
        if self.open:
            self.rows[self.open[-1]]["text"].append(data)


@F.udtf(returnType=_ROW)
class HtmlElements:
    """For (html, attribute): a row for each element with its own text. Those that carry ``attribute`` are cards; they are
    numbered, and each element knows the nearest card around it. A null page has none."""

    def eval(self, html: str, attribute: str):
        reader = _Reader(attribute)
        reader.feed(html or "")
        reader.close()
        for row in reader.rows:
            yield tuple((row | {"text": "".join(row["text"])}).values())


def html_elements(pages: DataFrame, html_col: str = "html", attribute: str | None = None) -> DataFrame:
    """The other columns of ``pages`` with every element of each page."""
    return pages.lateralJoin(HtmlElements(F.col(html_col).outer(), F.lit(attribute).cast("string"))).drop(html_col)


def cards(elements: DataFrame, key: str) -> DataFrame:
    """key, card, parent_card, tag, attributes and text (its own and that of what stands inside, but not inside inner
    cards; blanks squeezed) of every card."""
    own = elements.withColumn("_in", F.coalesce("card", "parent_card")).where("_in IS NOT NULL")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("number", "text"))), lambda x: x["text"]), " ")
    texts = own.groupBy(key, F.col("_in").alias("card")).agg(F.trim(F.regexp_replace(text, "\\s+", " ")).alias("text"))
    return elements.where("card IS NOT NULL").select(key, "card", "parent_card", "tag", "attributes").join(texts, [key, "card"])


def element_faults(elements: DataFrame, key: str, address: str | None = None) -> DataFrame:
    """Rows (key, fault) of pages without exactly one main heading, with an id twice, or with a canonical link that is
    missing or isn't ``address`` (a column of the elements)."""
    pages = elements.groupBy(key)
    headings = pages.agg(F.count_if(F.col("tag") == "h1").alias("n")).where("n <> 1").select(key, F.lit("main-heading").alias("fault"))
    twice = elements.where("id IS NOT NULL").groupBy(key, "id").count().where("count > 1").select(key, F.lit("id-twice").alias("fault")).distinct()
    out = headings.unionByName(twice)
    if address:
        right = (F.col("tag") == "link") & (F.lower(F.col("attributes")["rel"]) == "canonical") & (F.col("attributes")["href"] == F.col(address))
        out = out.unionByName(pages.agg(F.count_if(right).alias("n")).where("n = 0").select(key, F.lit("canonical").alias("fault")))
    return out
