"""How much the similarity join shuffles for a set."""

import numpy as np
from pyspark.sql import functions as F

from docquarry.llm import ngram_join


def test_a_set_has_few_and_short_signatures(spark):
    rng = np.random.default_rng(1)
    sizes = np.array([60, 200, 400, 1000, 5000])
    values = rng.integers(0, 1 << 63, sizes.sum()).astype(np.uint64)
    for p, most in ((80, 0.75), (90, 0.3)):
        _, owner = ngram_join.signatures(values, sizes, ngram_join.bands(p, 100))
        each = np.bincount(owner)
        assert (each > 0).all() and (each[1:] < most * sizes[1:]).all(), each
    docs = spark.createDataFrame([(i, " ".join(map(str, rng.integers(0, 1000, 300)))) for i in range(5)], "id long, text string")
    rows = ngram_join._signature_rows(docs, 5, 80, 100)
    assert rows.columns == ["key", "sig"] and rows.where("sig < 0 OR sig >= 1L << 40").count() == 0 and rows.count() > 5 * 60


def test_links_survive_signatures_that_agree_by_chance(spark, monkeypatch):
    """Even where nearly all signatures agree, the result is that of comparing all pairs."""
    rng = np.random.default_rng(2)
    base = [list(map(str, rng.integers(0, 10_000, 80))) for _ in range(6)]
    texts = [" ".join(b) for b in base] + [" ".join([*b[:-2], "x", "y"]) for b in base[:4]] + ["one two", "one two", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [ngram_join.shingle_set(t, 5) for t in texts]
    label = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                label[i] = min(label[i], label[j])
    # the workers see the signatures' length through the rows' function
    for bits in (ngram_join.SIG_BITS, 3):
        monkeypatch.setattr(ngram_join, "SIG_BITS", bits)
        found = {r.doc_id: r.component_id for r in ngram_join.link_documents(docs).collect()}
        assert [found[i] for i in range(len(texts))] == label


def test_parities_rule_out_long_texts_that_are_half_alike(spark):
    """Pairs of long texts that aren't similar enough go without their texts; no similar pair does, whatever the sizes."""
    rng = np.random.default_rng(3)
    long = list(map(str, rng.integers(0, 100_000, 4000)))
    other = list(map(str, rng.integers(0, 100_000, 4000)))
    texts = [long, long[:2000] + other[:2000], [*long[:3900], "x"], [*long, *other[:250]], other, long[:30], [*long[:29], "x"]]
    texts = [" ".join(t) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    classes = ngram_join._describe(docs, 5).withColumn("rep", F.col("id"))
    pairs = classes.select(F.col("key").alias("a_key")).crossJoin(classes.select(F.col("key").alias("b_key")))
    found = {(r.a, r.b) for r in ngram_join._maybe_similar(pairs, classes, 80, 100).collect()}
    sets = [ngram_join.shingle_set(t, 5) for t in texts]
    assert found == {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j and 100 * len(a & b) >= 80 * len(a | b)}
    assert {(0, 2), (0, 3)} <= found


def test_parities_never_exceed_the_differences():
    rng = np.random.default_rng(4)
    pool = rng.integers(0, 1 << 63, 60_000).astype(np.uint64)
    sizes = np.array([1, 511, 512, 513, 700, 1100, 5000, 40_000])
    sets = [np.sort(rng.choice(pool, n, replace=False)) for n in sizes]
    cells = ngram_join.parities(np.concatenate(sets), sizes)
    assert [8 * len(c) for c in cells] == [512, 512, 512, 1024, 1024, 2048, 8192, 32_768]
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            x, y = ngram_join._folded([cells[i], cells[j]], min(len(cells[i]), len(cells[j])))
            assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))
    assert ngram_join.parities(np.empty(0, np.uint64), np.zeros(1, np.int64)) == [bytes(64)]


def test_a_tile_gives_fewer_pairs_than_rows(spark):
    """Where all classes of a signature may be similar, a forest of the pairs goes on, and never one that is refuted."""
    n = 120
    named = spark.range(n).select(F.col("id").alias("key"), F.col("id").alias("rep"), F.col("id").alias("label"), F.lit(100).cast("long").alias("n_shingles"), F.lit(bytes(64)).alias("parity"))
    members = spark.range(n).select(F.lit(7).cast("long").alias("sig"), F.lit(0).cast("long").alias("pivot"), F.col("id").alias("key"))
    pair = lambda df: {(r.a_key, r.b_key) for r in df.collect()}
    assert len(pair(ngram_join._pairs_within(members, named, 80, 100))) == n * (n - 1) // 2
    rows = ngram_join._pairs_within(members, named, 80, 100, 1)
    first = pair(rows)
    assert rows.count() == len(first) == n - 1
    group = {i: {i} for i in range(n)}
    for a, b in first:
        both = group[a] | group[b]
        group |= dict.fromkeys(both, both)
    assert len(group[0]) == n
    wrong = spark.createDataFrame(sorted(first), "a_key long, b_key long")
    more = pair(ngram_join._pairs_within(members, named, 80, 100, 2, wrong))
    assert n - 1 < len(more) < 2 * n and not more & first


def test_rounds_of_refuted_pairs_find_every_link(spark, monkeypatch):
    """Texts about as alike as the limit, which parities can't tell apart: the result is that of comparing all pairs."""
    rng = np.random.default_rng(5)
    base, texts = list(map(str, rng.integers(0, 100_000, 515))), []
    for i in range(60):
        at, m = int(rng.integers(0, 440)), int(rng.integers(20, 60))
        texts.append(" ".join([*base[:at], *(f"{i}-{k}" for k in range(m)), *base[at + m :]]))
    sets, label = [ngram_join.shingle_set(t, 5) for t in texts], list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((label[i], label[j]))
                label = [x if v == y else v for v in label]
    named, writes = [], ngram_join.written
    monkeypatch.setattr(ngram_join, "SIG_BITS", 1)
    monkeypatch.setattr(ngram_join, "written", lambda df, name: (named.append(name), writes(df, name))[1])
    found = {r.doc_id: r.component_id for r in ngram_join.link_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [found[i] for i in range(len(texts))] == label and 1 < len(set(label)) < len(texts)
    assert named.count("refuted-pairs") >= 1


def test_labels_and_digests_of_signatures_are_one_pass(spark):
    """The rows of a signature are met once for labels and digests: each round has fewer shuffles and broadcasts for the driver."""
    named = spark.range(9).select(F.col("id").alias("key"), F.col("id").alias("rep"), F.col("id").alias("label"), F.lit(100).cast("long").alias("n_shingles"), F.lit(bytes(64)).alias("parity"))
    members = spark.range(18).select((F.col("id") % 2).alias("sig"), F.lit(0).cast("long").alias("pivot"), F.floor(F.col("id") / 2).alias("key"))
    rows = ngram_join._pairs_within(members, named, 80, 100, 1)
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 3
    assert sorted(r.sig for r in rows.collect()) == [0] * 8  # both signatures hold the same classes
