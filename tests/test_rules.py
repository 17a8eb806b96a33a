"""Rules for page text against plain loops over the characters, with wide forms, all line ends and repeats."""

import random
import re
import unicodedata

from pyspark.sql import functions as F

from docquarry.functions import text as X
from docquarry.operators import extraction as E
from docquarry.operators import lookup as L
from docquarry.operators import markers as M
from docquarry.operators import numbering
from docquarry.operators import validation as V

PIECES = ["日", "農授金字", "農業", "甲", "1", "１２", "², ", " ", "  ", "　", "\t", "\n", "\r\n", "\r", "\x0b", "\x1c", " ", "§", "％", "%", "／", "/", "○", "】", "，", "ab", "c", "ﬁ", "①", "﻿"]


def han(c):
    return "㐀" <= c <= "鿿"


def made(rng, n):
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 14))) for _ in range(n)] + [None, "", " \n", "日 \n農授金字", "１１４年"]


def plain_search(text):
    parts = re.split(r"(\s+)", unicodedata.normalize("NFKC", text or ""))
    out = parts[0]
    for blank, after in zip(parts[1::2], parts[2::2]):
        left = out[-1:]
        keep = not (left and after and han(left) and han(after[0])) or (left == "日" and after.startswith("農授金字"))
        out += (" " if keep else "") + after
    return out.replace("§", " ").strip()


def plain_display(text, printed):
    lines = (text or "").replace("\r", "\n").splitlines()
    for i in reversed(range(max(0, len(lines) - 6), len(lines))):
        if printed is not None and "".join(unicodedata.normalize("NFKC", lines[i]).split()) == str(printed):
            lines = lines[:i] + lines[i + 1 :]
            break
    shown = [x.rstrip() for x in lines]
    while shown and not shown[0]:
        shown = shown[1:]
    while shown and not shown[-1]:
        shown = shown[:-1]
    return "\n".join(shown).replace("日農授金字", "日 農授金字")


def plain_layout(line):
    marks = set("，。；：！？、（）「」『』【】《》〈〉／/%％﹪○０１２３４５６７８９")
    parts = re.split("([ \t　]+)", line)
    out = parts[0]
    for after in parts[2::2]:
        left, right = out[-1:], after[:1]
        drop = left != "" and right != "" and (han(left) or left in marks) and (han(right) or right in marks)
        if left == "日" and after.startswith("農授金字"):
            drop = False
        out += ("" if drop or (left.isdigit() and right and right in "％﹪%") else " ") + after
    return out.strip()


def got(spark, column, texts, **more):
    rows = [(i, t, *[v[i] for v in more.values()]) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "i int, t string" + "".join(f", {k} int" for k in more))
    return [r.x for r in df.repartition(2).withColumn("x", column).orderBy("i").collect()]


def test_page_text(spark):
    rng = random.Random(11)
    texts = made(rng, 400)
    assert got(spark, X.search_text(F.col("t")), texts) == [plain_search(t) for t in texts]
    printed = [rng.choice([None, 1, 12, 112]) for _ in texts]
    assert got(spark, X.display_text(F.col("t"), F.col("p")), texts, p=printed) == [plain_display(t, p) for t, p in zip(texts, printed)]
    ends = ["a\n1 2\n", "a\r\n１ 2\r\n\r\n", "1\n2\n3\n4\n5\n6\n12", "12\n2\n3\n4\n5\n6\n7", "x\r12\ry", "a\x0b　⑫"]
    assert got(spark, X.display_text(F.col("t"), F.lit(12)), ends) == [plain_display(t, 12) for t in ends]


def test_layout(spark):
    rng = random.Random(12)
    lines = ["".join(rng.choice([p for p in PIECES if p not in ("\n", "\r\n", "\r", "\x0b", "\x1c", " ", "﻿")]) for _ in range(rng.randint(0, 12))) for _ in range(400)] + ["甲 ／ 乙", "甲 ○ 乙", "5 ％", "x ％ 甲"]
    assert got(spark, X.layout_spaces(F.col("t")), lines) == [plain_layout(t) for t in lines]


def test_variants_and_periods(spark):
    cases = {
        "附件 2-申請書及審核表-3版": ["附件 2-申請書及審核表-3版", "申請書及審核表", "附件 2-申請書及檢核表-3版", "申請書及檢核表"],
        "附件３、切結書--12 版": ["附件３、切結書--12 版", "切結書"],
        "查驗紀錄": ["查驗紀錄"],
        "附件說明": ["附件說明", "說明"],
    }
    assert got(spark, X.title_variants(F.col("t")), list(cases)) == list(cases.values())
    one = lambda a, b: spark.range(1).select(X.period(F.lit(a), F.lit(b)).alias("x")).first().x
    assert one("2024-01-02", "2024-03-04") == "官方資料所載受理期間：113/01/02－113/03/04"
    assert one(None, "2024-03-04") == "官方資料所載受理期限：至 113/03/04" and one("2024-01-02", None) == "官方資料所載受理期間：自 113/01/02 起" and one(None, None) == ""
    rows = spark.createDataFrame([(0, "x 申請書 及檢核表", "附件 1-申請書及審核表-2版", None), (1, "申請書", "切結書", "A-1"), (2, "no. a1", "切結書", "A-1"), (3, "STRASSE", "Straße", "")], "i int, s string, t string, n string")
    assert [r.i for r in V.untold(rows, "i", F.col("s"), F.col("t"), F.col("n")).collect()] == [1]


def test_update_words_are_parted_by_white_space(spark):
    score = lambda q, body: spark.range(1).select(L.update_score(F.lit(q), *[F.lit("")] * 4, F.lit(body))).first()[0]
    assert score("甲,乙", "甲字乙") == 0 and score("乙 乙", "甲字乙") == 30002 and score("甲　乙", "甲字乙") == 30002 and score("甲", "甲字乙") == 50000


def test_letters(spark):
    body = "主旨：有 關\n貸款\n說明：x"
    pages = [
        (5, f"【農業部113年1月2日農授金字第１１３５００１號函】\n{body}【無】主旨：y"), (6, f"前文【農業部 １１３年 1月 3日\n農授金字第2號公告】{body}【農業部113年1月4日農授金字第3號函】無"),
        (9, f"【農業部113年1月2日農授金字第4號函】{body}"), (None, f"【農業部113年1月2日農授金字第5號函】{body}"), (7, None),
    ]
    ranges = spark.createDataFrame([(0, "b", 6, 7), (1, "a", 4, 6)], "ord int, program string, page_start int, page_end int")
    rows = E.letters(spark.createDataFrame(pages, "printed_page int, raw_text string"), ranges).orderBy("id").collect()
    assert [(r.id, r.program, r.printed_page, r.number, r.date, r.document_number, r.title, r.pdf_page) for r in rows] == [
        ("interpretation-001", "b", 6, 1, "113年1月3日", "農授金字第2號", "有關貸款", 8), ("interpretation-002", "a", 5, 1, "113年1月2日", "農授金字第1135001號", "有關貸款", 7),
        ("interpretation-003", "a", 6, 1, "113年1月3日", "農授金字第2號", "有關貸款", 8),
    ]
    assert E.letters(spark.createDataFrame([], "printed_page int, raw_text string"), ranges).count() == 0


def test_numbers_without_one_task(spark):
    rng = random.Random(4)
    rows = [(rng.choice([None, 1, 2, 3]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "a int, b int").repartition(7)
    found = numbering.numbered_rows(df, "a", "b", name="n", start=0)
    assert [(r.a, r.b) for r in found.orderBy("n").collect()] == sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])) and sorted(r.n for r in found.collect()) == list(range(500))
    assert numbering.numbered_rows(df.limit(0), "a").count() == 0
    plan = E.form_titles(spark.createDataFrame([(1, "申請書一二三")], "printed_page int, raw_text string"))._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan


def plain_hits(text, markers, end):
    out, at = [], 0
    for piece, line in enumerate((text or "").split(end) if end else [text or ""]):
        for m in sorted(set(markers) - {"", None}):
            places = [i for i in range(len(line)) if line.startswith(m, i)]
            if places:
                out.append((piece, m, at + places[0], len(places), line.count(m)))
        at += len(line) + 1
    return out


def test_markers(spark, monkeypatch):
    rng = random.Random(8)
    texts = ["".join(rng.choice(["a", "b", "ab", "貸款", "😀", "\n", " "]) for _ in range(rng.randint(0, 40))) for _ in range(200)] + [None, "", "\n\n", "ab\nab"]
    words = ["a", "ab", "ba", "aab", "貸款", "款😀", "😀", "b\nb", "", None, "ab"]
    df, markers = spark.createDataFrame(list(enumerate(texts)), "i int, t string"), spark.createDataFrame([(w,) for w in words], "m string")
    for most, end in ((2_000_000, "\n"), (3, "\n"), (3, None)):
        monkeypatch.setattr(M, "GROUP_CHARS", most)
        rows = M.marker_hits(df, "t", markers, piece_end=end).collect()
        expected = [(i, *h) for i, t in enumerate(texts) for h in plain_hits(t, words, end)]
        assert sorted((r.i, r.piece, r.marker, r["first"], r.hits, r.apart) for r in rows) == sorted(expected)
    counts = {r.marker: (r.pages, r.hits) for r in M.pages_of_markers(M.marker_hits(df, "t", markers), "i").collect()}
    assert counts["a"] == (sum("a" in (t or "") for t in texts), sum((t or "").count("a") for t in texts))
    assert M.marker_hits(df, "t", markers.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "x /root/ /root/ ###"), (1, "%%% ###"), (2, "fine"), (3, None)], "i int, t string")
    faults = V.forbidden_tokens(twice, "i", "t", {"noise": ("%%%", "###"), "path": ("/root/",)}).collect()
    assert sorted(map(tuple, faults)) == [(1, "noise"), (1, "noise"), (1, "path")]
