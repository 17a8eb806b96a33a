"""The gram index against the scan, its upkeep against a new build, and publication with two writers and a reader."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from docquarry.operators import gram_index as G
from docquarry.operators import search as S
from docquarry.plans import catalogue as C
from docquarry.sources import readers, versions

COLUMNS = ["query_id", "ord", "score", "match_kind"]


def made(spark, rng, n, first=0):
    words = ["loan", "Ｌｏａｎ", "limit", "貸款額度", "貸款", "a", "ab", "農業 部", "ſmall", "İx", "😀😀😀", "no-1", ".*", "\\E", "x" * 60]
    rows = []
    for i in range(first, first + n):
        text = None if rng.random() < 0.1 else " ".join(rng.choice(words) for _ in range(rng.randint(0, 12)))
        rows.append((i, rng.choice(["貸款索引", "t", None]), rng.choice(words), text, [rng.choice(words), None], rng.choice(["s1", "s2", None]), None, f"字第{i * 37}號"))
    return spark.createDataFrame(rows, "ord long, type string, title string, text string, keywords array<string>, scope string, scope_group string, document_number string")


QUERIES = ["loan limit", "貸款額度", "貸款", "a", "small ab", "字第37號", "37", "😀😀😀", ".*x \\e", "nothing here", "İx i̇x", " ", "y" * 300, "x" * 60]


def rows_of(df, columns=COLUMNS):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_index_finds_what_the_scan_finds(spark, tmp_path, monkeypatch):
    records = S.save_prepared(made(spark, random.Random(1), 400).coalesce(2), str(tmp_path / "prepared"))
    index = G.build(records, str(tmp_path / "i"))
    asked = S.query_table(records, *QUERIES)
    monkeypatch.setattr(G, "SCAN_SHARE", 1.0)
    concepts = readers.inline_table(spark, [("c", ["loan", "貸款額度", "zz"], None, None)], "id string, terms array<string>, trigger_terms array<string>, related_terms array<string>").withColumnRenamed("ord", "concept_ord")
    options = {"concepts": concepts, "scopes": "s1,s2", "proximity": False, "spread": False}
    found = rows_of(G.search(index, asked, **options))
    assert found == rows_of(S.search(records, asked, **options)) and len(found) > 100
    shares = {r.query_id: r for r in G.read_shares(index, asked).collect()}
    assert 11 not in shares and 12 not in shares and shares[3].scanned and shares[3].read == 400
    assert not shares[0].scanned and shares[9].read == 0 and shares[5].read < 100
    for q in (" ", "y" * 300):
        nothing = G.search(index, q)
        assert nothing.count() == 0 and "parquet" not in nothing._jdf.queryExecution().optimizedPlan().toString().lower()


def test_no_record_meets_a_selective_query_by_a_nested_loop(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(G, "SCAN_SHARE", 1.0)
    index = G.build(made(spark, random.Random(2), 100), str(tmp_path / "i"))
    plan = G.search(index, "limit", spread=False)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_tables_of_many_queries_go_through_the_shared_folder(spark, tmp_path, monkeypatch):
    from docquarry.sources import shared

    records = S.save_prepared(made(spark, random.Random(3), 60).coalesce(2), str(tmp_path / "prepared"))
    index = G.build(records, str(tmp_path / "i"))
    monkeypatch.setattr(shared, "SMALL", 2)
    asked = S.query_table(records, *QUERIES)
    options = {"proximity": False, "spread": False}
    assert rows_of(G.search(index, asked, **options)) == rows_of(S.search(records, asked, **options))


def test_refresh_equals_a_new_build(spark, tmp_path):
    rng = random.Random(5)
    before, target = made(spark, rng, 150), str(tmp_path / "i")
    index = G.build(before, target)
    later = made(spark, rng, 40).union(before.where("ord between 40 and 119")).union(made(spark, rng, 30, 150)).union(before.where("ord = 60"))
    later = later.coalesce(2).cache()
    new, again = G.refresh(index, target, later), G.build(later, str(tmp_path / "j"))
    assert new.number == 2 and new.n_records == again.n_records == later.count()
    assert rows_of(new.records.drop("slice"), sorted(again.records.drop("slice").columns)) == rows_of(again.records.drop("slice"), sorted(again.records.drop("slice").columns))
    flat = lambda i: rows_of(i.postings.select("gram", F.explode("ords").alias("ord")), ["gram", "ord"])
    assert flat(new) == flat(again) and rows_of(new.grams, ["gram", "n"]) == rows_of(again.grams, ["gram", "n"])
    assert G.changes(new, later).count() == 0
    with pytest.raises(versions.Outrun):
        G.refresh(index, target, before)
    with pytest.raises(ValueError, match="lacks"):
        G.refresh(new, target, later.withColumn("extra", F.lit(1)))
    rules = G.RULES
    G.RULES = rules + 1
    try:
        with pytest.raises(ValueError, match="rules"):
            G.opened(spark, target)
    finally:
        G.RULES = rules


def test_odd_tables(spark, tmp_path):
    records = made(spark, random.Random(6), 3)
    empty = G.build(records.limit(0), str(tmp_path / "e"))
    assert G.search(empty, "loan").count() == 0 and G.refresh(empty, str(tmp_path / "e"), records).n_records == 3
    with pytest.raises(Exception, match="without ord"):
        G.build(records.withColumn("ord", F.lit(None).cast("long")), str(tmp_path / "n"))


def test_a_reader_never_finds_nothing(spark, tmp_path):
    target, seen, stop = str(tmp_path / "t"), set(), threading.Event()
    table = lambda k: spark.range(k * 10)
    assert versions.publish_table(table(1), target, 0) == 1

    def read():
        while not stop.is_set():
            seen.add(versions.read_current(spark, target).count())

    reader = threading.Thread(target=read)
    reader.start()
    for k in range(2, 6):
        assert versions.publish_table(table(k), target, k - 1) == k
    stop.set()
    reader.join()
    assert seen <= {10, 20, 30, 40, 50} and versions.read_current(spark, target).count() == 50
    with pytest.raises(versions.Outrun):
        versions.publish_table(table(9), target, 4)
    outrun = []

    def late(folder):  # another writer is faster while this one writes
        versions.publish_table(table(6), target, 5)
        table(7).write.parquet(folder)

    with pytest.raises(versions.Outrun):
        versions.publish(spark, target, late, 5, lambda f: outrun.append(f) or True)
    import os

    assert versions.read_current(spark, target).count() == 60 and not os.path.exists(outrun[0])
    with pytest.raises(ValueError, match="refused"):
        versions.publish_table(table(8), target, 6, lambda df: df.count() == 0)
    assert versions.drop_old(spark, target, keep=2) == [1, 2, 3, 4] and versions.versions(spark, target) == [5, 6]
    assert len([n for n in os.listdir(target) if n.startswith("data-")]) == 2


def test_registered_queries_go_through_the_index(spark, small):
    from docquarry.plans import indexed

    assert C.QUERIES["search_indexed"] is indexed.search_indexed


def test_postings_are_shuffled_as_lists(spark, monkeypatch):
    """A worker joins the records of a gram before the shuffle, in runs of records; repeats and blocks make no difference."""
    prepared = S.prepare_records(made(spark, random.Random(8), 120).coalesce(1))
    prepared = prepared.union(prepared.where("ord < 5"))
    pairs = {(g, r.ord) for r in prepared.collect() for f in S.FIELDS for t in [r[f"f_{f}"]] for g in (ord(t[i]) << 42 | ord(t[i + 1]) << 21 | ord(t[i + 2]) for i in range(len(t) - 2))}
    for size in (G.CHUNK, 100):
        monkeypatch.setattr(G, "CHUNK", size)
        some = G._some_postings(prepared, 3, 4)
        flat = G._postings(prepared, 3, 4).select("gram", F.explode("ords").alias("ord")).collect()
        assert len(flat) == len(pairs) and {(r.gram, r.ord) for r in flat} == pairs
        assert size == 100 or some.count() < len(pairs) / 2
    plan = G._postings(prepared, 3, 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Generate" not in plan
