"""Search evidence, overrides, rules (with corrupted tables) and sinks."""

from pyspark.sql import functions as F

from docquarry.operators import lookup as L
from docquarry.operators import ownership as O
from docquarry.operators import search as S
from docquarry.operators import validation as V
from docquarry.sources import readers, sinks

RECORDS = [
    (0, "頁面", "貸款額度", "貸款額度 最高五百萬元", "loan:a", None, None, 3),
    (1, "貸款索引", "青年貸款", "青年貸款 辦法", "loan:b", "loan:b", None, 1),
    (2, "頁面", "其他", "無關", "loan:a", None, "農授金字第0991234567號", 2),
    (3, "頁面", "上限", "上限說明", "loan:c", None, None, 2),
]
CONCEPTS = [(0, None, ["最高額度"], ["上限"]), (1, ["青年", "青壯年"], None, None)]


def table(spark):
    return spark.createDataFrame(RECORDS, "ord int, type string, title string, text string, scope string, scope_group string, document_number string, pdf_page int")


def concepts(spark):
    return spark.createDataFrame(CONCEPTS, "concept_ord int, terms array<string>, trigger_terms array<string>, related_terms array<string>")


def found(df):
    return [(r.ord, r.match_kind) for r in df.orderBy("rank").collect()]


def test_evidence(spark):
    run = lambda q, **k: found(S.search(table(spark), q, concepts(spark), proximity=False, spread=False, **k))
    assert run("貸款額度") == [(0, "direct")]
    assert run("最高額度") == [(3, "related")]
    assert run("額度") == [(0, "direct")]  # a part of a task phrase doesn't trigger it
    assert run("0991234567") == [(2, "exact-document")]
    assert run("青壯年") == [(1, "related")]
    assert run("不存在") == [] and run("") == [] and run("x" * 300) == []
    assert run("貸款", scopes="loan:b") == [(1, "direct")] and run("貸款", type_filter="頁面") == [(0, "direct")]


def test_intents_need_evidence(spark):
    intents = spark.createDataFrame([(["貸款"], ["頁面"], 40)], "triggers array<string>, preferred_types array<string>, boost int")
    rows = S.search(table(spark), "貸款", intents=intents, proximity=False, spread=False).collect()
    assert {r.ord: r.intent_boost for r in rows} == {0: 40, 1: 0}


def test_compatibility_forms_are_found(spark):
    wide = [(0, "Ａ類", "ＡＢＣ１２３ ﬁle", "㈱ ①②", "s", None, "農授金字第０９９１２３４５６７號", 1), (1, "b", "abc123 file", "(株) 12", "s", None, None, 2), (2, "b", None, "", "s", None, None, 3)]
    df = spark.createDataFrame(wide, table(spark).schema)
    run = lambda q, **k: {r.ord: r for r in S.search(df, q, proximity=False, spread=False, **k).collect()}
    for q in ("abc123", "ＡＢＣ１２３", "file", "ﬁle", "(株)", "㈱", "12"):
        assert set(run(q)) == {0, 1}, q
    assert run("0991234567")[0].match_kind == run("０９９１２３４５６７")[0].match_kind == "exact-document"
    assert run("ａｂｃ１２３ ﬁle")[1].score == run("abc123 file")[1].score >= S.WEIGHTS["exact_title"]
    intents = spark.createDataFrame([(["ＡＢＣ１２３", None], ["b"], 40)], "triggers array<string>, preferred_types array<string>, boost int")
    assert {o: r.intent_boost for o, r in run("abc123", intents=intents).items()} == {0: 0, 1: 40}
    terms = spark.createDataFrame([(0, None, ["ｘｙｚ"], ["ﬁle"])], "concept_ord int, terms array<string>, trigger_terms array<string>, related_terms array<string>")
    assert {o: r.match_kind for o, r in run("xyz", concepts=terms).items()} == {0: "related", 1: "related"}


def test_diversity(spark):
    rows = [(i, "p", f"t{i}", "word", "s" if i < 5 else f"s{i}", None, None, i) for i in range(8)]
    df = spark.createDataFrame(rows, "ord int, type string, title string, text string, scope string, scope_group string, document_number string, pdf_page int")
    got = S.search(df, "word", proximity=False).orderBy("place").collect()
    assert [r.ord for r in got] == [0, 1, 5, 6, 7, 2, 3, 4]
    assert [r.adjusted_score for r in got] == [45, 45, 45, 45, 45, 27, 9, -9]


def test_override_may_be_null(spark):
    rows = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "x")], "id string, found string")
    over = spark.createDataFrame([("a", "y"), ("b", None)], "id string, value string")
    got = O.with_override(rows, over, "id", "value", F.col("found"))
    assert {r.id: r.owner for r in got.collect()} == {"a": "y", "b": None, "c": "x"}


def test_update_tiers(spark):
    score = lambda q, **k: spark.range(1).select(L.update_score(F.lit(q), *[F.lit(k.get(c, "")) for c in ("title", "number", "programs", "sections", "body")])).first()[0]
    assert score("農授金字第1147467200號", number="農授金字第1147467200號") == 100000
    assert score("甲 乙", title="甲乙") == 90000 and score("甲", title="甲乙") == 80000
    assert score("甲", programs="甲") == 70000 and score("甲", sections="甲") == 65000 and score("甲", body="甲") == 50000
    assert score("甲 丙", body="甲乙丙") == 30002 and score("2928", body="2928") == 0 and score("，") == 0


UPDATE = "id string, title string, source_type string, document_number string, published string, effective string, version_date string, period struct<start: string, end: string>, source_url string, loan_ids array<string>, section_ids array<string>, relation_basis string"


def test_update_rules_find_corruptions(spark):
    good = ("u1", "t", "faq", "n", "2024-01-02", None, None, ("2024-01-01", "2024-02-01"), "https://www.moa.gov.tw/x", ["a"], [], "common-rule")
    known = spark.createDataFrame([("a",)], "id string")
    faults = lambda *rows: {r.fault for r in V.update_faults(spark.createDataFrame(list(rows), UPDATE), known, known).collect()}
    with_ = lambda i, v: good[:i] + (v,) + good[i + 1 :]
    assert faults(good) == set()
    for i, v, name in ((1, "", "required"), (2, "x", "source-type"), (4, "2024-02-30", "date"), (4, None, "no-date"), (7, ("2024-03-01", "2024-02-01"), "period"), (8, "http://www.moa.gov.tw/", "url"), (9, ["b"], "unknown-loan"), (11, "x", "relation-basis")):
        assert name in faults(with_(i, v)), name
    assert faults(good, with_(0, "u2")) == {"duplicate"}


def test_rules_on_sequences_and_sets(spark):
    rows = spark.createDataFrame([("g", 1, None, 2), ("g", 2, 1, 3), ("g", 3, 1, None)], "g string, p int, prev int, next int")
    assert [r.p for r in V.sequence_faults(rows, "g", "p", "prev", "next").collect()] == [3]
    a, b = (spark.createDataFrame([(x,) for x in s], "k string") for s in ("ab", "bc"))
    assert {tuple(r) for r in V.difference(a, b, "k").collect()} == {("a", "left"), ("c", "right")}
    assert V.table_hash(a.union(b)).collect() == V.table_hash(b.union(a)).collect()


def test_publication_keeps_the_old_table_on_failure(spark, tmp_path):
    target = str(tmp_path / "t")
    assert sinks.publish(spark, spark.range(3), target, lambda df: df.count() == 3)
    assert not sinks.publish(spark, spark.range(5), target, lambda df: False)
    assert spark.read.parquet(target).count() == 3
    assert sinks.publish(spark, spark.range(5), target, lambda df: df.count() == 5)
    assert spark.read.parquet(target).count() == 5 and len(list(tmp_path.iterdir())) == 1


def test_embedding_and_urls(spark):
    row = spark.range(1).select(
        sinks.safe_json(F.struct(F.lit("</script>").alias("a"))).alias("j"),
        sinks.state_url(F.lit("/x"), q=F.lit("a b"), p=F.lit("")).alias("u"),
        readers.url_parameter(F.lit("https://h/x?q=a%20b"), "q").alias("q"),
        readers.embedded_json(F.lit('<script data-lookup-data>[{"a": 1}]</script>'), "data-lookup-data", "a: int").alias("e"),
        readers.embedded_json(F.lit("<script data-lookup-data>[{</script>"), "data-lookup-data", "a: int").alias("bad"),
    ).first()
    assert row.j == '{"a":"\\u003c/script>"}' and row.u == "/x?q=a+b" and row.q == "a b" and row.e[0].a == 1 and not row.bad


def test_file_manifest(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.txt").write_text("x")
    got = readers.file_manifest(spark, str(tmp_path)).collect()
    assert [(r.path, r.length) for r in got] == [("d/a.txt", 1)] and len(got[0].sha256) == 64


def test_open_and_wide_intervals_have_owners(spark, monkeypatch):
    from docquarry.operators import ownership

    points = spark.createDataFrame([(i, p) for i, p in enumerate([None, -5, 0, 7, 8, 9, 10_000_000, 5_000_000])], "i int, p long")
    ranges = spark.createDataFrame([(0, "low", None, 0), (1, "mid", 8, 9), (2, "wide", 10, 9_000_000), (3, "all", None, None), (4, "none", 9, 8)], "ord int, slug string, low long, high long")
    expected = {0: None, 1: "low", 2: "low", 3: "all", 4: "mid", 5: "mid", 6: "all", 7: "wide"}
    for most in (1_000_000, 5):
        monkeypatch.setattr(ownership, "EXPAND", most)
        got = ownership.first_owner(points, "i", "p", ranges, "low", "high", "ord", "slug").collect()
        assert {r.i: r.owner for r in got} == expected
        members = ownership.interval_members(points, "p", ranges, "low", "high").collect()
        assert sorted((r.i, r.slug) for r in members if r.slug != "all") == [(1, "low"), (2, "low"), (4, "mid"), (5, "mid"), (7, "wide")] and len(members) == 12
    assert ownership.first_owner(points.limit(0), "i", "p", ranges, "low", "high", "ord", "slug").count() == 0


def test_entities_and_options(spark):
    from html import unescape

    from docquarry.sources import readers

    texts = ["a &lt; b &amp;amp; c", "&copy; &middot; &#39; &#x4e00;", "&amp;lt;", "plain", "&notit; &amp", None, "&amp;copy;"]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", readers.unescape_entities(F.col("t")).alias("u")).orderBy("i").collect()
    assert [r.u for r in got] == [t and unescape(t) for t in texts]
    options = spark.range(12_000).select(F.col("id").cast("string").alias("o"))
    rows = spark.createDataFrame([(0, "11999"), (1, "x"), (2, None)], "i int, v string")
    assert sorted((r.i, r.v) for r in readers.with_allowed(rows, "v", options, "o").collect()) == [(0, "11999"), (1, ""), (2, "")]


def test_loose_references(spark):
    from docquarry.operators import extraction

    pages = spark.createDataFrame([(1, "依農授字第 123 號及農金三字第456號辦理"), (2, "無")], "page int, text string")
    got = [(r.page, r.place, r.document_number) for r in extraction.loose_references(pages, "page", "text").collect()]
    assert got == [(1, 0, "農授字第123號"), (1, 1, "農金三字第456號")]
