"""Each stage of the pipeline against plain code over its own input."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from docquarry.llm import ngram_join  # noqa: E402
from docquarry.llm.common import written  # noqa: E402

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = out[name] = written(stage(spark, docs, FOLDER), name)
    return out


def test_stages_keep_the_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "language", "near_copies", "personal_data", "packing"]
    for name in ("quality", "language", "near_copies", "personal_data"):
        assert stages[name].columns == stages["documents"].columns


def test_quality_rejects_noise_and_keeps_clean_documents(spark, stages):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    kept = stages["quality"].join(labels, "doc_id").groupBy("quality").count()
    all_ = labels.groupBy("quality").count()
    kept, all_ = ({r["quality"]: r["count"] for r in x.collect()} for x in (kept, all_))
    assert kept[1] >= 0.98 * all_[1] and kept.get(0, 0) <= 0.2 * all_[0]


def test_language_keeps_documents_of_known_languages(stages):
    before, after = stages["quality"].count(), stages["language"].count()
    assert 0.98 * before <= after <= before


def test_one_row_of_each_group_of_near_copies_stays(stages):
    from test_llm import plain_components

    rows = [(r.doc_id, r.text) for r in stages["language"].collect()]
    least = {c for _, c in plain_components(rows, 5, 80, 100).values()}
    assert {r.doc_id for r in stages["near_copies"].collect()} == least
    assert all(ngram_join.shingle_set(t, 5) for i, t in rows if i not in least)


def test_personal_data_goes(stages):
    pattern = re.compile(r"[\w.]+@[\w.]+\.com|\+1 \(\d{3}\) \d{3}-\d{4}|\b\d{1,3}(?:\.\d{1,3}){3}\b|(?i:token) = \"\w{40}\"")
    before = {r.doc_id: r.text for r in stages["near_copies"].collect()}
    after = {r.doc_id: (r.text, r.n_chars) for r in stages["personal_data"].collect()}
    found = 0
    for i, text in before.items():
        new, n = after[i]
        assert n == len(new)
        hits = pattern.findall(text)
        found += len(hits)
        assert not set(hits) & set(pattern.findall(new))
        if not re.search(r"\d", text):
            assert new == text
    assert found > 20


def test_packing_covers_every_document(stages):
    rows = stages["packing"].toPandas()
    assert set(rows.doc_id) == {r.doc_id for r in stages["personal_data"].select("doc_id").collect()}
    whole = rows.groupby("doc_id").agg({"length": "sum", "doc_tokens": "first"})
    assert (whole.length == whole.doc_tokens).all()
    filled = rows.groupby("sequence_id").length.sum()
    assert filled.max() <= 1024 and np.mean(filled) > 1000


def test_run_gives_the_last_stage(spark, stages):
    key = ["doc_id", "start", "length", "ids_crc32"]
    got = corpus_pipeline.run(spark, FOLDER).select(key)
    assert got.exceptAll(stages["packing"].select(key)).count() == 0 and got.count() == stages["packing"].count()


def test_an_empty_table_passes_through(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where(F.lit(False))
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
    assert docs.count() == 0


CLASHING = ["quality", "good", "evidence", "_found", "_new", "_text", "_block", "_row", "_id", "id", "key", "score", "row", "_key", "_host"]


def test_odd_rows_and_clashing_columns_pass_every_stage(spark):
    """Null, blank and very long texts, repeated and null ids, repeated rows, and columns named as the operators' own."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    clean = docs.where("lang = 'en' AND length(text) > 400").orderBy("doc_id").first()
    rng, some = np.random.default_rng(1), clean.text.split()
    long = "\n".join(" ".join(rng.choice(some, 14)) for _ in range(20_000))
    odd = [(9001, None), (9002, ""), (9003, " \n "), (9004, long), (9005, clean.text + " My number is 123-45-6789."), (9006, clean.text), (9006, clean.text), (9006, clean.text[::-1]), (None, clean.text + " End.")]
    rows = docs.unionByName(spark.createDataFrame([(i, t, "en", clean.source, len(t or "")) for i, t in odd], docs.schema))
    rows = written(rows.withColumns({c: F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))) for c in CLASHING}), "odd")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = written(stage(spark, rows, "/root/testdata/sf0.001"), name)
        assert kept.columns == rows.columns and 0 < kept.count() <= rows.count()
        bad = [F.col(c) != F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))) for c in CLASHING]
        assert kept.where(F.greatest(*[b.cast("int") for b in bad]) > 0).count() == 0
        rows = kept
    texts = [(r.doc_id, r.text) for r in rows.collect()]
    assert not any(i in (9001, 9002, 9003) for i, _ in texts) and len([t for i, t in texts if i == 9004]) == 1
    assert len([1 for i, t in texts if t == clean.text]) == 1  # of the copies one stays
    packed = written(corpus_pipeline.STAGES[-1][1](spark, rows, ""), "packed").groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id for r in packed} == {i for i, _ in texts}
