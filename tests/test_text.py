"""Text rules on literals, Han text included."""

import pytest
from pyspark.sql import functions as F

from docquarry.functions import text as X
from docquarry.functions import unicode as U
from docquarry.operators import extraction as E


def one(spark, *columns):
    return spark.range(1).select(*columns).first()[0]


@pytest.mark.parametrize(
    "given, form",
    [("  Ａ\u3000b\n\tC ", "a b c"), ("ﬁne", "fine"), (None, ""), ("\ufeff x\u00a0y", "x y"), ("１２３", "123")],
)
def test_normalize(spark, given, form):
    assert one(spark, X.normalize(F.lit(given), U.nfkc)) == form
    assert U.normalize_text(given) == form


def test_tokens_keep_order_and_drop_repeats(spark):
    assert one(spark, X.tokens(F.lit("b a，b、c;；d"))) == ["b", "a", "c", "d"]


def test_numbers(spark):
    assert one(spark, X.canonical_number(F.lit(" 農授金字 第1a2b號 "))) == "農授金字第1A2B號"
    assert one(spark, X.canonical_source_number(F.lit("農授金字第1a號函"))) == "農授金字第1a號"
    assert one(spark, X.number_query(F.lit("農授金字第1147467200A號"))) == "農授金1147467200a"
    assert one(spark, X.number_query(F.lit("第12345號"))) == ""


def test_layout_and_paragraphs(spark):
    assert one(spark, X.layout_spaces(F.lit("貸 款　額 度 5 ％ and  b"))) == "貸款額度 5％ and b"
    assert one(spark, X.layout_spaces(F.lit("6日 農授金字第1號"))) == "6日 農授金字第1號"
    text = "一、貸款\n對象\n（一）農民。\n下一段\n\nabc\ndef"
    assert one(spark, X.paragraphs(F.lit(text))) == ["一、貸款對象", "（一）農民。", "下一段", "abc def"]
    assert one(spark, X.paragraphs(F.lit(""))) == []


def test_dates(spark):
    assert one(spark, X.roc_date(F.lit("2024-02-29"))) == "113/02/29"
    assert one(spark, X.roc_date(F.lit("2024-02-30"))) is None
    assert one(spark, X.roc_year(F.lit("95年6月6日"))) == "95"
    assert one(spark, X.numeral(F.lit("二十四"))) == 24


@pytest.mark.parametrize(
    "header, date, number",
    [
        ("【行政院農業委員會95年6月6日農授金字第0955080001號函】", "95年6月6日", "農授金字第0955080001號"),
        ("【農業部 113年 1月 2日 農授金字第1135000001A號公告】", "113年1月2日", "農授金字第1135000001A號"),
        ("【中華民國一〇〇年農授金字第1號】", None, None),
        ("【95年6月6日另農授金字1號】", None, None),
    ],
)
def test_header(spark, header, date, number):
    got = one(spark, E.header_fields(F.lit(header), U.nfkc))
    assert (got and got["date"], got and got["document_number"]) == (date, number)


def test_questions(spark):
    rows = [
        ("g", 0, "一、誰可申請？"), ("g", 1, "答：農民。（其他事項）"), ("g", 2, "二、期限多久？答:五年"), ("g", 3, "補充"), ("g", 4, "三、專案農貸諮詢專線"), ("g", 5, "結尾"),
    ]
    got = E.questions(spark.createDataFrame(rows, "group_id string, unit int, text string")).orderBy("number").collect()
    assert [(r.number, r.question, r.answer, r.end_unit) for r in got] == [(1, "誰可申請？", "農民。", 2), (2, "期限多久？", "五年\n補充", 4)]


def test_candidates(spark):
    kinds = "ord int, canonical string, page int, subject string"
    sources = spark.createDataFrame([(0, "A", 1, "x")], kinds)
    found = spark.createDataFrame([(0, "A", 1, "X "), (1, "A", 1, "y"), (2, "B", 2, "z"), (3, "B", 2, "z")], kinds)
    got = E.classify_candidates(sources, found).orderBy("ord").collect()
    assert [(r.disposition, r.duplicate_of) for r in got] == [
        ("promoted-to-source-index", None), ("duplicate-detection", "candidate-001"), ("promoted-to-source-index", None), ("pending-review", None), ("duplicate-detection", "candidate-004"),
    ]


def test_snippets_stay_in_bounds_and_mark_originals():
    text = "前言" * 100 + "農民👨‍👩‍👧貸款Ａ１２３" + "後記" * 200
    got = U.snippet(text, ["貸款a123"], ["農民"])
    assert [text[m["start"] : m["end"]] for m in got["matches"]] == ["農民", "貸款Ａ１２３"]
    assert got["end"] - got["start"] <= 320 and [m["kind"] for m in got["matches"]] == ["related", "direct"]
    assert U.snippet("abc", ["x"], []) == {"start": 0, "end": 3, "matches": []}




def test_compatibility_forms_get_few_texts_at_a_time(spark):
    """Whole texts go to Python by plain functions, which get 100 rows at a time however many there are."""
    from docquarry.functions import unicode as U
    from docquarry.operators import search as S

    rows = spark.range(10).select(F.col("id").alias("ord"), F.lit("Ｌｏａｎ é 貸款").alias("title"), F.lit("ﬁ½").alias("text"))
    plan = S.prepare_records(rows).select("*", U.nfkc_each(F.array("title", F.lit(None).cast("string"))).alias("each"))
    assert "BatchEvalPython" in plan._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan._jdf.queryExecution().executedPlan().toString()
    assert {(r.f_title, r.f_body, tuple(r.each)) for r in plan.collect()} == {("loan é 貸款", "fi1⁄2", ("Loan é 貸款", None))}
