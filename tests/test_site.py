"""The site's tables on small fixtures, and each rule on a clean table and on one corruption after the other."""

import os
import shutil
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from docquarry.functions import text as X
from docquarry.operators import site as W
from docquarry.operators import validation as V


def test_display_text_drops_the_last_printed_number(spark):
    cases = [("a\n3\nb\n ３ \n\n", 3, "a\n3\nb"), ("3\na\nb\nc\nd\ne\nf", 3, "3\na\nb\nc\nd\ne\nf"), ("a \n3", None, "a\n3"), (None, 3, ""), ("1月2日農授金字", 9, "1月2日 農授金字"), ("3", 3, "")]
    df = spark.createDataFrame([(i, t, p) for i, (t, p, _) in enumerate(cases)], "i int, t string, p int")
    assert [r.x for r in df.orderBy("i").select(X.display_text(F.col("t"), F.col("p")).alias("x")).collect()] == [x for *_, x in cases]


def test_paragraphs_of_long_texts(spark):
    lines = ["line of text"] * 3000 + ["", "一、item", "more。", "next"]
    got = spark.createDataFrame([("\n".join(lines),)], "t string").select(X.paragraphs(F.col("t")).alias("p")).first().p
    assert got == [" ".join(["line of text"] * 3000), "一、itemmore。".replace("itemmore", "item more"), "next"]


def test_pages(spark):
    raw = spark.createDataFrame([(1, "cover"), (2, ""), (3, "規則\n1"), (4, " \n")], "pdf_page int, raw_text string")
    ranges = spark.createDataFrame([(0, "rules", 1, 9)], "ord int, slug string, low int, high int")
    built = W.build_pages(raw, ranges)
    got = {r.pdf_page: (r.printed_page, r.chapter_id, r.raw_text, r.search_text, r.has_text) for r in built.collect()}
    assert got == {1: (None, "front-matter", "cover", "cover", True), 2: (None, "front-matter", "", "", False), 3: (1, "rules", "規則", "規則", True), 4: (2, "rules", "", "", False)}
    modes = built.withColumn("render_mode", W.render_mode(F.col("printed_page"), F.col("search_text"), F.col("has_text"), [(7, 9)], ("規則",)))
    assert sorted((r.pdf_page, r.render_mode, r.reason) for r in W.rendering_rules(modes).collect()) == [(1, "hybrid", "layout"), (2, "preview", "no-text-layer"), (3, "hybrid", "layout"), (4, "preview", "no-text-layer")]
    anchors = spark.createDataFrame([(3, 1), (4, 2), (9, 7)], "pdf_page int, printed_page int")
    assert sorted(r.pdf_page for r in W.unprinted_anchors(raw, anchors).collect()) == [4, 9]
    assert W.build_pages(raw.limit(0), ranges).count() == 0


def test_unknown_programs_fail(spark):
    loans = spark.createDataFrame([("a", "A", 0)], "id string, title string, ord int")
    none = spark.createDataFrame([], "loan_id string, slug string")
    programs = spark.createDataFrame([("A",), ("all",)], "program string")
    assert {r.program: r.slug for r in W.group_slugs(programs, loans, none, "all", "common").collect()} == {"A": "a", "all": "common"}
    with pytest.raises(Exception, match="unknown program: B"):
        W.group_slugs(programs.union(spark.createDataFrame([("B",)], "program string")), loans, none, "all", "common").collect()


def test_labels_and_paths(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    path = lambda a, b: one(W.relative_path(F.lit(a), F.lit(b)))
    for a, b in [("index.html", "faq/index.html"), ("a/b/c.html", "a/d/e.html"), ("a/b/c.html", "a/b/c.html"), ("a/b.html", "b.html"), ("a/b/c/d.html", "a/x.html"), ("a/b.html", "a/b/c.html")]:
        assert path(a, b) == os.path.relpath(b, os.path.dirname(a) or ".")
    assert one(W.url_page(F.lit("x/page-012.html?q#f"))) == 12 and one(W.url_page(F.lit("x/page.html"))) is None
    assert one(W.group_label(F.lit("g"), F.lit("增修 114年10月 問答"), {"h": "H"})) == "114年10月" and one(W.group_label(F.lit("h"), F.lit("x"), {"h": "H"})) == "H"
    assert one(W.routine_notice(F.lit("announcement"), F.lit("天然災害低利貸款地區"))) and not one(W.routine_notice(F.lit("announcement"), F.lit("天然災害低利貸款展延")))
    rows = spark.createDataFrame([("a", "loan, faq", 2), ("b", "faq", 1), ("c", "loan", 3)], "id string, kind string, order int")
    assert [r.id for r in W.shortcuts(rows, "faq").collect()] == ["b", "a"]


def corrupted(spark, rows, schema, changes, rule):
    """The rule on the rows, and on the rows with each change (position, column, value) or one row more."""
    names = [c.split()[0] for c in schema.split(", ")]
    assert not rule(spark.createDataFrame(rows, schema)).collect()
    for change in changes:
        bad = [list(r) for r in rows]
        if len(change) == 3:
            bad[change[0]][names.index(change[1])] = change[2]
        else:
            bad.append(list(change[0]))
        assert rule(spark.createDataFrame([tuple(r) for r in bad], schema)).collect(), change


def test_index_rules_find_corruptions(spark):
    owners = spark.createDataFrame([("loan:a",)], "scope string")
    rows = [("p1", "page", "T", "section:x", "loan:a", "p.html"), ("l1", "loan", "L", "loan:a", None, "l.html")]
    changes = [(0, "id", "l1"), (0, "type", "other"), (0, "scope", "loan:a"), (0, "scope", None), (0, "scope_group", "loan:b"), (1, "title", " "), (1, "title", None), (1, "url", "/l.html"), (1, "url", "https://x"), (1, "url", None)]
    corrupted(spark, rows, "id string, type string, title string, scope string, scope_group string, url string", changes, lambda t: V.index_faults(t, owners, {"page": "section:", "loan": "loan:"}))


def test_parity_links_and_lineage_find_corruptions(spark):
    right = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    corrupted(spark, [("a", 1), ("b", 2)], "k string, v int", [(0, "v", 3), (0, "k", "c"), (("b", 2),), (1, "v", None)], lambda t: V.parity_faults(t, right, "k", ["v"]))
    targets = spark.createDataFrame([("p.html", ""), ("p.html", "top"), ("q.html", "")], "path string, fragment string")
    corrupted(spark, [("s", "p.html", "top"), ("s", "q.html", "")], "source string, path string, fragment string", [(0, "fragment", "end"), (1, "path", "r.html"), (1, "fragment", "top")], lambda t: V.unresolved_links(t, targets))
    corrupted(spark, [("s", 5, 3, 2, "2024-01-02", "2024-01-01")], "source_id string, hits int, candidates int, out_of_scope int, reviewed_through string, verified_through string", [(0, "hits", 4), (0, "candidates", 9), (0, "reviewed_through", "2023-12-31")], V.lineage_faults)


def test_letters_and_decisions_find_corruptions(spark):
    parsed = X.canonical_source_number(F.col("raw"))
    rows = [(1, "農授字第1號", 3, "農授字第 1 號函"), (2, "農授字第2號", 3, "農授字第2號")]
    corrupted(spark, rows, "id int, document_number string, pdf_page int, raw string", [(0, "document_number", "農授字第9號"), (0, "raw", None), ((3, "農授字第2號", 3, "農授字第2號"),)], lambda t: V.reparse_faults(t, parsed))
    pages = spark.createDataFrame([(1, "one  two"), (2, "three")], "page int, text string")
    rows = [("a", "onetwo", [2, 1]), ("b", "thr ee", [2])]
    corrupted(spark, rows, "id string, excerpt string, evidence_pages array<int>", [(0, "excerpt", "four"), (0, "evidence_pages", [2]), (1, "evidence_pages", None), (1, "evidence_pages", [9]), (1, "excerpt", ""), (1, "excerpt", None)], lambda t: V.weak_evidence(t, pages))


def test_page_rules_find_corruptions(spark):
    rules = {"h1": ("<h1", 1, 1), "main": ("<main", 1, 1)}
    changes = [(0, "html", "<main><h1><h1>"), (0, "html", "<h1>")]
    corrupted(spark, [(1, "<main><h1>")], "page_id int, html string", changes, lambda t: V.structure_faults(t, rules))
    corrupted(spark, [(1, "ok")], "page_id int, html string", [(0, "html", "a /root/x")], lambda t: V.forbidden_tokens(t, "page_id", "html", {"path": "/root/"}))
    corrupted(spark, [(1, "--accent --ink")], "page_id int, html string", [(0, "html", "--ink"), (0, "html", None)], lambda t: V.without_tokens(t, "page_id", "html", ["--accent", "--ink"]))
    corrupted(spark, [("v", "1"), ("w", "2")], "file string, revision string", [(("v", "2"),)], lambda t: V.inconsistent(t, "file", "revision"))
    corrupted(spark, [(1, "The Title, No 5", "title", "x")], "id int, page string, title string, number string", [(0, "page", "other"), (0, "title", "")], lambda t: V.untold(t, "id", F.col("page"), F.col("title"), F.col("number")))
    fixtures = spark.createDataFrame([("q", ["a", "b"]), ("none", [])], "name string, expected array<string>")
    corrupted(spark, [("q", "a", 1), ("q", "b", 2)], "name string, id string, rank int", [(0, "rank", 3), (1, "id", "c"), (("none", "x", 1),)], lambda t: V.fixture_faults(t, fixtures))


def test_the_rest_works_without_the_subpackage(tmp_path):
    """The entry, its queries and SQL, with the folders of the training-data operators gone."""
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(here, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse"))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(n.startswith('op') and n[2].isdigit() for n in e.queries()))"], cwd=tmp_path / "repo", env=os.environ | {"PYTHONPATH": ""}, capture_output=True, text=True)
    n, sql, any_op = said.stdout.split()
    assert int(n) > 110 and int(sql) > 100 and any_op == "False", said.stderr
