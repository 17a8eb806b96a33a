"""Elements against hand-made pages, links against the rules of relative addresses."""

from urllib.parse import urljoin

from pyspark.sql import functions as F

from docquarry.operators import addresses as A
from docquarry.sources import elements as H

PAGE = """<html><body><h1 id="a">T</h1><div data-card="1" id="a">one <b>two</b><section data-card="2">inner<br>text</section> three</div></p><p data-card>last<p>end"""


def test_elements_and_cards(spark):
    pages = spark.createDataFrame([(0, PAGE, "x"), (1, None, "y"), (2, "plain", "z"), (0, "<i>", "again")], "k int, html string, tag_of string")
    rows = H.html_elements(pages, attribute="data-card").where("tag_of = 'x'").orderBy("number").collect()
    assert [(r.tag, r.parent, r.depth, r.card, r.parent_card) for r in rows] == [
        ("html", None, 0, None, None), ("body", 0, 1, None, None), ("h1", 1, 2, None, None), ("div", 1, 2, 0, None), ("b", 3, 3, None, 0), ("section", 3, 3, 1, 0), ("br", 5, 4, None, 1),
        ("p", 1, 2, 2, None), ("p", 7, 3, None, 2),
    ]
    every = H.html_elements(pages, attribute="data-card")
    found = H.cards(every.where("tag_of = 'x'"), "k").orderBy("card").collect()
    assert [(r.card, r.parent_card, r.tag, r.attributes["data-card"], r.text) for r in found] == [(0, None, "div", "1", "one three two"), (1, 0, "section", "2", "innertext"), (2, None, "p", "", "last end")]
    assert sorted(map(tuple, H.element_faults(every.where("tag_of = 'x'"), "k", "tag_of").collect())) == [(0, "canonical"), (0, "id-twice")]
    assert every.where("k = 1 OR k = 2").count() == 0 and H.html_elements(pages.limit(0)).count() == 0


def test_addresses(spark):
    bases = ["http://h/a/b/c.html?q=1#f", "http://h", "https://h/", "http://h/a/b/"]
    links = ["x", "./x", "../x", "../../../x", "/x/./y/../z", "?k=v", "#f2", "", "x?y=1#z", "https://o/a/../b", "//o/x", "mailto:a@b", "..", ".", "a/b/..", "../..", "x/."]
    rows = [(b, k) for b in bases for k in links]
    got = spark.createDataFrame(rows, "b string, k string").withColumn("t", A.resolved(F.col("b"), F.col("k"))).select("b", "k", "t.*").collect()
    for r in got:
        if not r.external:
            whole = r.address + (f"#{r.fragment}" if r.fragment else "")
            wanted = urljoin(r.b, r.k) if r.k else r.b.split("#")[0]
            assert whole == (wanted if r.b != "http://h" or r.k not in ("?k=v", "#f2", "") else wanted.replace("http://h", "http://h/", 1)), r
    by = {(r.b, r.k): (r.external, r.escapes) for r in got}
    assert by[bases[0], "../../../x"] == (False, 1) and by[bases[0], "../x"] == (False, 0) and by[bases[1], ".."] == (False, 1) and by[bases[0], "//o/x"][0] and by[bases[0], "mailto:a@b"][0]
    odd = spark.createDataFrame([(None, "x"), ("http://h/", None)], "b string, k string").select(A.resolved(F.col("b"), F.col("k")).alias("t")).collect()
    assert [r.t for r in odd] == [None, None]
