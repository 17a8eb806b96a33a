"""The operators of docquarry.llm against plain code, with nulls, empty and long texts, ties, repeats and empty tables."""

import hashlib
import os
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from docquarry.llm import bpe, binary_output, fingerprints, language, ngram_join, packing, pii, quality, queries, sharding, tokens, topk  # noqa: E402

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
TEXTS = [None, "", " ", "A b\n\nc d", "a b c", "a b c", "x" * 3000, "don't <|endoftext|> ²½ 日本 😀\t\n", "word " * 2500, "é́ Σας İ", "\n"]


def table(spark, texts=TEXTS):
    """Ids with a null and a repeat, and a column that clashes with the operators' own names."""
    rows = [(i, t, "en", "src", 0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + [(None, "no id", None, None, 1), rows[4]], "doc_id long, text string, lang string, source string, shard int")


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.fixture(scope="module")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


# --- sharding --------------------------------------------------------------------------------------------------------


def plain_shards(rows, n):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, len((r[1] or "").encode()), zlib.crc32((r[1] or "").encode())))
    total, before, first, out = sum(len((t or "").encode()) + 1 for _, t in rows), 0, {}, []
    for i, (k, t) in enumerate(rows):
        size = len((t or "").encode()) + 1
        s = (2 * before + size) * n // (2 * total)
        out.append((k, size, zlib.crc32((t or "").encode()), s, i - first.setdefault(s, i)))
        before += size
    return out


def test_shards(spark, documents):
    for df in (table(spark), documents):
        got = [(r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in sharding.shard_by_bytes(df).collect()]
        expected = plain_shards([(r.doc_id, r.text) for r in df.collect()], 16)
        assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert sharding.shard_by_bytes(table(spark).limit(0)).count() == 0


# --- fingerprints ----------------------------------------------------------------------------------------------------


def test_fingerprints(spark, documents):
    got = fingerprints.fingerprint_documents(documents, blocks=7).orderBy("doc_id").collect()
    docs = documents.orderBy("doc_id").collect()
    by_text = defaultdict(set)
    for i, (r, d) in enumerate(zip(got, docs, strict=True)):
        after, half = docs[(i + 1) % len(docs)].text, len(d.text) // 2
        edited = d.text[: len(d.text) - half] + after[:half]
        assert r.n_chars == len(d.text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (r.near_edited == 1) == (sorted(d.text.split("\n")) == sorted(edited.split("\n")))
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        by_text[tuple(sorted(d.text.split("\n")))].add(r.fingerprint)
    assert all(len(v) == 1 for v in by_text.values()) and len({v.pop() for v in by_text.values()}) == len(by_text)


@pytest.mark.parametrize("blocks", [1, 3, 40, 600])
def test_every_row_meets_the_next(spark, blocks):
    rng = random.Random(blocks)
    rows = [(rng.choice([None, 7, 7, 7, i, i - 500]), f"text {rng.randint(0, 60)}", i) for i in range(400)] + [(9000, None, 0), (None, "", 0)]
    got = fingerprints.with_next(spark.createDataFrame(rows, "doc_id long, text string, block int").select("doc_id", "text"), "doc_id", "text", blocks).collect()
    # whatever the order of equal ids, each row follows one and the ids follow in order
    key = lambda i: (i is not None, i or 0)
    assert sorted(((r.id, r.text) for r in got), key=repr) == sorted(((i, t or "") for i, t, _ in rows), key=repr)
    assert sorted(r.next.text for r in got) == sorted(r.text for r in got)
    ids = sorted((r[0] for r in rows), key=key)
    after = {a: b for a, b in zip(ids, [*ids[1:], ids[0]])}
    by_id = defaultdict(set)
    for r in got:
        by_id[r.id].add(r.text)
    assert all(r.next.text in by_id[r.id] | by_id[after[r.id]] for r in got)


def test_hot_ids_are_split(spark):
    docs = spark.range(4000).select(F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 3 == 1, F.lit(5)).otherwise(F.col("id")).cast("long").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / 64 for i in range(1, 64)], 640)).first()[0]
    dealt = docs.select(fingerprints._block_number(F.col("doc_id"), F.xxhash64("text"), cuts).alias("b")).groupBy("b").count()
    assert dealt.agg(F.max("count")).first()[0] < 100


def test_fingerprint_changes_by_one_paragraph(spark):
    v = lambda t: fingerprints.vector(F.lit(t))
    r = spark.range(1).select(
        fingerprints.as_hex(v("a\nb\nb")).alias("a"),
        fingerprints.as_hex(fingerprints.insert(v("b\na"), F.lit("b"))).alias("b"),
        fingerprints.as_hex(fingerprints.delete(v("b\nc\nb\na"), F.lit("c"))).alias("c"),
        fingerprints.likeness(v("a\nb"), v("b\na")).alias("same"),
    ).first()
    assert r.a == r.b == r.c and r.same == 1
    assert fingerprints.fingerprint_documents(table(spark)).count() == len(TEXTS) + 2
    assert fingerprints.fingerprint_documents(table(spark).limit(0)).count() == 0


# --- tokens ----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("kind, path", [("byte", BYTE), ("word", WORD)])
def test_encoders_agree_with_the_library(kind, path):
    rng = random.Random(1)
    alphabet = [" ", "  ", "\n", "a", "B", "é", "1", "²", "'", "s", "ll", "!", "_", "\t", "　", "日", "😀", "́", "\xa0", "-", "Σ", "<|endoftext|>"]
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 14))) for _ in range(3000)]
    whole = Tokenizer.from_file(path)
    for t, ids in zip(texts, tokens.encoder(kind, path).encode(texts)):
        assert ids.tolist() == whole.encode(t, add_special_tokens=False).ids, repr(t)


def test_joined_pieces_are_told_apart():
    whole, rng = Tokenizer.from_file(WORD), random.Random(3)
    pieces = ["".join(rng.choice("abcxyzéß日") for _ in range(rng.randint(1, 30))) for _ in range(9000)] + ["'", "1", "²", "!!", "</", "<|", "|>", "😀"]
    each = tokens._batch(whole)(pieces)
    assert tokens._ended(whole, "</w>")(pieces) == each
    assert tokens._ended(whole, "no such end")(pieces) == each
    assert tokens._ended(whole, "</w>")([]) == []


def test_rank_array_agrees_with_the_library(spark):
    whole, pairs = Tokenizer.from_file(BYTE), bpe.BytePairs(BYTE)
    rng = random.Random(2)
    for piece in ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzé!1") for _ in range(rng.choice([1, 3, 9, 40, 300, 900]))) for _ in range(300)]:
        for p in pairs._pieces.findall(piece):
            assert pairs.merge(p.encode()) == whole.encode(p, add_special_tokens=False).ids
    for t in TEXTS:
        ids = pairs.encode_text(t or "")
        assert ids == whole.encode(t or "", add_special_tokens=False).ids and pairs.decode(ids) == whole.decode(ids, skip_special_tokens=False)
    back = bpe.decode_documents(bpe.encode_documents(table(spark), BYTE), BYTE)
    assert sorted(r.text for r in back.collect()) == sorted([t or "" for t in TEXTS] + ["no id", TEXTS[4]])


def test_round_trip_digests(spark, documents):
    whole = Tokenizer.from_file(BYTE)
    texts = {r.doc_id: r.text for r in documents.collect()}
    for r in bpe.round_trip_digests(documents, BYTE).collect():
        ids = whole.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(whole.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_elias_fano():
    rng = random.Random(3)
    for n, bound in [(1, 0), (1, 5), (200, 200), (1000, 10**6), (77, 3), (0, 0)]:
        values = np.array(sorted(rng.randint(0, bound) for _ in range(n)), np.int64)
        ef = binary_output.EliasFano.of(values, bound)
        assert ef.all().tolist() == values.tolist() == [ef.select(i) for i in range(n)]
    docs = [np.array([1, 2, 3], np.uint32), np.array([], np.uint32), np.array([65535], np.uint32)]
    image = binary_output.Image(binary_output.write_image(docs, 7, 2))
    assert [image.document(i).tolist() for i in range(3)] == [[1, 2, 3], [], [65535]] and image.first == 7
    with pytest.raises(ValueError):
        binary_output.write_image([np.array([65536], np.uint32)], 0, 2)


@pytest.mark.parametrize("docs_each", [1024, 3])
def test_token_files(spark, documents, docs_each):
    whole = Tokenizer.from_file(WORD)
    for df in (documents, table(spark)):
        got = binary_output.read_token_files(binary_output.write_token_files(df, WORD)).collect()
        rows = sorted(((r.doc_id, r.text) for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
        start, expected = 0, []
        for k, t in rows:
            ids = whole.encode(t or "", add_special_tokens=False).ids + [2]
            expected.append((k, start, len(ids), crc(ids)))
            start += len(ids)
        assert sorted(map(tuple, got), key=lambda r: r[1]) == expected
    assert binary_output.read_token_files(binary_output.write_token_files(table(spark).limit(0), WORD)).count() == 0


def test_packing(spark, documents):
    whole = Tokenizer.from_file(BYTE)
    for df in (documents, table(spark)):
        rows = packing.pack_documents(df, BYTE).collect()
        texts = {r.doc_id: whole.encode(r.text or "", add_special_tokens=False).ids + [0] for r in df.collect()}
        seen, room = defaultdict(set), defaultdict(list)
        for r in rows:
            ids = np.frombuffer(r.ids, "<u4").tolist()
            assert ids == texts[r.doc_id][r.start : r.start + r.length] and r.doc_tokens == len(texts[r.doc_id])
            seen[r.doc_id] |= set(range(r.start, r.start + r.length))
            room[r.sequence_id].append((r.offset, r.length))
        assert all(len(seen[k]) == len(v) for k, v in texts.items())
        assert sum(r.length for r in rows) == sum(len(texts[r.doc_id]) for r in df.collect())
        for places in room.values():
            places.sort()
            assert [a for a, _ in places] == np.cumsum([0] + [n for _, n in places])[:-1].tolist() and sum(n for _, n in places) <= 1024
        assert sorted(room) == list(range(len(room)))
    assert packing.pack_documents(table(spark).limit(0), BYTE).count() == 0
    for n in range(1024):
        assert sum(size for size, _ in packing.cut_rest(n)) == n and all(size * j <= 1024 for size, j in packing.cut_rest(n))


# --- n-gram join -----------------------------------------------------------------------------------------------------


def plain_components(docs, n, p, q):
    sets = {i: ngram_join.shingle_set(t or "", n) for i, t in docs}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    inverted = defaultdict(list)
    for i in sorted(sets):
        common = defaultdict(int)
        for e in sets[i]:
            for j in inverted[e]:
                common[j] += 1
            inverted[e].append(i)
        for j, c in common.items():
            if q * c >= p * (len(sets[i]) + len(sets[j]) - c):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def families(seed):
    rng = random.Random(seed)
    docs = []
    for _ in range(40):
        size = rng.choice([1, 2, 3, 4, 6, 8, 10, 14, 18, 25, 40, 80, 200, 700])
        base = [rng.choice("abcdefghijklmnop") + str(rng.randint(0, 400)) for _ in range(size)]
        for _ in range(rng.randint(1, 10)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, size // 25))):
                w[rng.randrange(len(w))] = f"z{rng.randint(0, 9)}"
            docs.append((len(docs), " ".join(w + [f"y{rng.randint(0, 5)}"] * (rng.random() < 0.3))))
    return docs + [(len(docs) + i, t) for i, t in enumerate(["", None, " ", "a", "A", "a b", "b\ta", "a b"])]


@pytest.mark.parametrize("n, p", [(3, 90), (5, 80)])
def test_join_loses_no_link(spark, n, p):
    docs = families(n)
    got = ngram_join.link_documents(spark.createDataFrame(docs, "doc_id long, text string"), n, p, 100).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == plain_components(docs, n, p, 100)


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(4)
    for p in (80, 90):
        at = ngram_join.bands(p, 100)
        for size in (2, 5, 9, 12, 17, 30, 64, 150, 400, 2500):
            for _ in range(20):
                a = np.unique(rng.integers(0, 1 << 62, size).astype(np.uint64))
                drop = int(len(a) * (100 - p) / 100)
                b = np.sort(a[drop:]) if drop else a
                if 100 * len(b) < p * len(a):
                    continue
                sig, owner = ngram_join.signatures(np.r_[a, b], np.array([len(a), len(b)]), at)
                assert len(a) == len(b) or set(sig[owner == 0]) & set(sig[owner == 1])


def test_join_edges(spark):
    got = ngram_join.link_documents(table(spark), 3, 90, 100)
    assert got.count() == len(TEXTS) + 2
    by_id = {r.doc_id: r.component_id for r in got.collect()}
    assert by_id[5] == 4 and by_id[0] == 0 and by_id[None] is None and by_id[1] == 1
    assert ngram_join.link_documents(table(spark).limit(0)).count() == 0
    kept = ngram_join.keep_one_of_each(table(spark))
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([0, 1, 2, 3, 4, 6, 7, 8, 9, 10, None], key=repr) and kept.columns == table(spark).columns


def thue_morse(n):
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return a, a.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("size", [1024, 2048])
def test_words_of_one_polynomial_hash_are_told_apart(spark, size):
    x, y = thue_morse(size)
    docs = [(1, x), (2, y), (3, f"{x} {y}"), (4, f"{x} one two three"), (5, f"{y} one two three"), (6, x + "\n"), (7, f"{x} {y} {x} {x} {y} {y}")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for n in (1, 3):
        got = ngram_join.link_documents(df, n, 90, 100).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == plain_components(docs, n, 90, 100)
    for kind, path in (("byte", BYTE), ("word", WORD)):
        library = Tokenizer.from_file(path)
        library.no_truncation()
        library.no_padding()
        texts = [t for _, t in docs]
        assert [e.tolist() for e in tokens.encoder(kind, path).encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    pairs = bpe.BytePairs(BYTE)
    assert [pairs.decode(x.tolist()) for x in pairs.encoder().encode(texts)] == texts


def test_repeated_and_null_ids_are_judged_by_their_texts(spark):
    near = " ".join(f"w{i}" for i in range(60))
    rows = [(1, near, "a"), (1, "quite another text of its own", "b"), (2, near + " end", "c"), (None, near, "d"), (None, "null ids have texts too, this one", "e"), (3, "null ids have texts too, this one", "f"),
            (1, "quite another text of its own", "g"), (None, None, "h"), (None, "only here and nowhere else, no copy", "i"), (4, "", "j"), (4, "", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _block string")
    got = {r._block for r in ngram_join.keep_one_of_each(docs).collect()}
    assert got in ({"a", "b", "f", "h", "i", "j", "k"}, {"a", "g", "f", "h", "i", "j", "k"})


def test_tiles_cover_large_groups(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "TILE", 3)
    docs = families(9)
    got = ngram_join.link_documents(spark.createDataFrame(docs, "doc_id long, text string"), 2, 70, 100).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == plain_components(docs, 2, 70, 100)


def plain_links(docs, n, p):
    sets = [(i, ngram_join.shingle_set(t or "", n)) for i, t in docs]
    near = lambda x, y: bool(x) and bool(y) and 100 * len(x & y) >= p * len(x | y)
    return [(i, sum(near(x, y) for k, (_, y) in enumerate(sets) if k != j)) for j, (i, x) in enumerate(sets)], sum(near(x, y) for j, (_, x) in enumerate(sets) for _, y in sets[:j])


@pytest.mark.parametrize("n, p, tile", [(3, 90, 1024), (2, 70, 3)])
def test_every_link_is_counted_and_returned(spark, monkeypatch, n, p, tile):
    monkeypatch.setattr(ngram_join, "TILE", tile)
    # three mutually near texts, copies of one of them, and an id that is repeated with other, near texts
    triple = [(900 + i, " ".join(f"w{k}" for k in range(100)) + f" end{i}") for i in (0, 1, 2, 2)] + [(900, " ".join(f"w{k}" for k in range(100)) + " end9")]
    docs = families(n) + triple
    each, total = plain_links(docs, n, p)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = ngram_join.count_links(df, n, p, 100)
    assert sorted((r.doc_id, r.n_links) for r in got.collect()) == sorted(each)
    parts = lambda d: sorted((r.doc_id, r.n_shingles, r.component_id) for r in d.collect())
    assert parts(got) == parts(ngram_join.link_documents(df, n, p, 100))
    pairs, members = ngram_join.link_pairs(df, n, p, 100)
    rows = {(r.class_id, r.class_key): r.class_rows for r in members.collect() if r.class_key is not None}
    found = [((r.a, r.a_key), (r.b, r.b_key)) for r in pairs.collect()]
    assert len(found) == len({frozenset(x) for x in found})
    assert sum(rows[a] * rows[b] for a, b in found) + sum(r * (r - 1) // 2 for r in rows.values()) == total and members.count() == len(docs)


def test_count_links_edges(spark):
    got = ngram_join.count_links(table(spark), 3, 90, 100)
    assert got.count() == len(TEXTS) + 2 and ngram_join.count_links(table(spark).limit(0)).count() == 0
    assert sorted((r.doc_id, r.n_links) for r in got.collect() if r.doc_id in (4, 5)) == [(4, 2), (4, 2), (5, 2)] and {r.n_links for r in got.collect() if r.doc_id in (None, 0, 1, 2)} == {0}


# --- personal data ---------------------------------------------------------------------------------------------------

FOUND = [
    ("card 4785380592391139 and 4785-3805-9239-1139.", 2), ("bad 4785380592391138", 0), ("+1 (743) 555-3824%%% (212) 555-0199", 2), ("+1 (152) 555-8590, +1 (152) 055-8590 4111", 1), ("+1 (000) 000-0000 and +1 (000) 555-0000", 0), ("ip 233.233.171.252!!", 1), ("999.1.1.1", 0),
    ("1970-01-31 1970-02-31 31/12/1999", 2), ("hein.19@mail5.example.com", 1), ('token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"###', 1), ("GB82WEST12345698765432", 1),
    ("123-45-6789", 1), ("000-12-3456", 0), (None, 0), ("", 0), ("plain text: none", 0),
]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def test_pseudonyms(spark):
    df = spark.createDataFrame([(i, t, "x") for i, (t, _) in enumerate(FOUND)], "doc_id long, text string, kind string")
    got = pii.pseudonymize(df, "k", count_col="n").orderBy("doc_id").collect()
    shape = lambda t: t and "".join("9" if c.isdigit() else "a" if c.islower() else "A" if c.isupper() else c for c in t)
    for (text, n), r in zip(FOUND, got):
        assert r.n == n and (r.text == text) == (n == 0) and r.kind == "x"
        if text and "ip" not in text:
            assert shape(r.text) == shape(text)
    cards = got[0].text.replace("-", "").rstrip(".").split()
    assert cards[1] == cards[3] and luhn(cards[1])
    assert pii.pseudonymize(df, "other").orderBy("doc_id").collect()[0].text != got[0].text
    assert pii.pseudonymize(df.limit(0), "k").count() == 0


LONG = "aB3" * 100
MORE = [
    ("+33 1 23 45 67 89", 1), ("tel +33 6 12 34 56 78.", 1), ("+61 2 9374 4000", 1), ("+44 (0)20 7946 0958", 1), ("1-800-555-0199", 1), ("1 (800) 555-0199", 1), ("+33 1 23", 0),
    ("GB82 WEST 1234 5698 7654 32", 1), ("BE68 5390 0754 7034 PAID", 1), ("GB82 WEST 1234 5698 7654 33", 0), ("BE68 4785 3805 9239 1139", 1), ("BE68 5390 0754 7034 2024", 1), ("DE89 3704 0044 0532 0130 00 and FR14 2004 1010 0505 0001 3M02 606", 2),
    ("12/25/2024", 1), ("25/12/2024", 1), ("13/13/2024", 0), ("02/30/2024", 0), (f"token={LONG}", 1), (f"api_key: '{LONG}xyz' end", 1), ("+44 20 7946 0958 2024-05-06", 2),
]


def test_pseudonyms_of_further_forms(spark):
    df = spark.createDataFrame(list(enumerate(t for t, _ in MORE)), "doc_id long, text string")
    got = [(r.text, r.n) for r in pii.pseudonymize(df, "k", count_col="n").orderBy("doc_id").collect()]
    shape = lambda t: "".join("9" if c.isdigit() else "a" if c.islower() else "A" if c.isupper() else c for c in t)
    for (text, n), (new, found) in zip(MORE, got):
        assert (found, new == text, shape(new)) == (n, n == 0, shape(text)), (text, new)
    at = {t: new for (t, _), (new, _) in zip(MORE, got)}
    iban = at["GB82 WEST 1234 5698 7654 32"].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    whole = pii.pseudonymize(spark.createDataFrame([(0, "GB82WEST12345698765432")], "doc_id long, text string"), "k").collect()[0].text
    assert whole == iban and at["BE68 5390 0754 7034 PAID"].endswith(" PAID") and luhn(at["BE68 4785 3805 9239 1139"][5:].replace(" ", ""))
    tail = at[f"token={LONG}"][6:]
    assert sum(a == b for a, b in zip(tail[128:], LONG[128:])) < 60


def test_month_first_dates_stay_different(spark):
    rows = [(y * 400 + m * 32 + d, f"{m:02}/{d:02}/{2000 + y}") for y in range(4) for m in range(1, 13) for d in range(13, 29)]
    new = [r.text for r in pii.pseudonymize(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()]
    assert len(set(new)) == len(rows) and all(int(t[:2]) <= 12 < int(t[3:5]) for t in new)


def test_feistel_is_a_permutation(spark):
    moved = [r[0] for r in spark.range(189 * 8).select(pii.feistel_number("k", "x", F.col("id"), 189, 8)).collect()]
    assert sorted(moved) == list(range(189 * 8)) and moved != sorted(moved)


def test_every_pseudonym_leads_back(spark, documents):
    cases = [t for t, _ in [*FOUND, *MORE]] + [None, "", "+1 (150) 555-0100 " * 3000]
    rows = spark.createDataFrame([(i, t, i, "x", [i]) for i, t in enumerate(cases)], "doc_id long, text string, _found int, _new string, _row array<int>")
    there = pii.pseudonymize(rows, "secret-key")
    assert there.columns == rows.columns and "secret-key" not in there._jdf.queryExecution().toString()
    back = pii.restore(there, "secret-key")
    assert sorted(map(tuple, back.collect()), key=lambda r: r[0]) == sorted(map(tuple, rows.collect()), key=lambda r: r[0])
    docs = documents.select("doc_id", "text")
    there = pii.pseudonymize(docs, "k").collect()
    assert sum(a.text != b.text for a, b in zip(there, docs.collect())) > 5
    got = pii.restore(spark.createDataFrame(there, docs.schema), "k").collect()
    assert {(r.doc_id, r.text) for r in got} == {(r.doc_id, r.text) for r in docs.collect()}
    same = pii.pseudonymize(spark.createDataFrame([(1, cases[0]), (1, cases[0])], "doc_id long, text string"), "k").distinct()
    assert same.count() == 1


# --- search ----------------------------------------------------------------------------------------------------------


def plain_top_k(rows, k=10):
    clean = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    expected = []
    for q, v in clean:
        if q % 100 == 0:
            scored = sorted(((-sum(a * b for a, b in zip(v, w)), i) for i, w in clean if i != q))[:k]
            expected += [(q, j + 1, i, -s) for j, (s, i) in enumerate(scored)]
    return sorted(expected)


@pytest.mark.parametrize("block, sample, pivots", [(4096, 2048, 128), (64, 40, 6), (64, 5, 128)])
def test_top_k(spark, monkeypatch, block, sample, pivots):
    for name, value in (("BLOCK", block), ("QUERY_BLOCK", block // 16), ("SAMPLE", sample), ("PIVOTS", pivots)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=8) * (i % 3 + 0.1) + 40 * np.eye(8)[i % 7]]) for i in range(500)]
    rows += [(500, None), (600, [float("nan")] * 8), (700, [None] * 8), (800, rows[0][1]), (900, []), (None, rows[1][1]), (7, rows[7][1]), (1000, [3.0] * 11)]
    rows += [(1100, [2.0**25] * 8)] * (block == 64)  # beyond exact doubles: all of its pairs are summed as integers
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, rank int")
    assert sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 100 == 0, 10).collect())) == plain_top_k(rows)


def test_top_k_of_an_empty_table(spark):
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0).count() == 0


def test_top_k_stops_exactly_and_early():
    rng = np.random.default_rng(6)
    middle = rng.integers(-3000, 3000, (30, 16))
    x = (np.repeat(middle, 100, axis=0) + rng.integers(-40, 40, (3000, 16))).astype(float)  # thirty groups
    ids = np.arange(3000)
    pivots = topk.choose_pivots(x[::7], 64)
    table = topk.distances(x, pivots)
    for floors in (np.full(5, -np.inf), np.sort(x[:5] @ x[::7].T, 1)[:, -11]):
        seen = []
        got = topk.search_block(ids[:5], x[:5], table[:, :5], floors, ids, x, table, 10, seen)
        for q in range(5):
            scores = x @ x[q]
            best = [i for i in np.lexsort((ids, -scores)) if i != q][:10]
            assert [(a, b, c) for a, b, c in got if a == q] == [(q, i, int(scores[i])) for i in best]
        assert max(seen) < 0.3 * len(x)


def test_blocks_out_of_reach_are_not_moved(spark, monkeypatch):
    for name, value in (("BLOCK", 50), ("QUERY_BLOCK", 4)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(8)
    middle = 10 * rng.normal(size=(40, 12))
    rows = [(i, [float(v) for v in middle[i % 40] + 0.01 * rng.normal(size=12)]) for i in range(2000)]
    moved = []
    monkeypatch.setattr(topk, "written", lambda df, name, write=topk.written: moved.append((name, out := write(df, name))) or out)
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0, 10).collect()
    tables = dict(moved)
    assert sorted(map(tuple, got)) == plain_top_k(rows)
    assert tables["reached"].count() < 0.5 * tables["candidates"].count() * tables["probes"].count()


# --- classifiers -----------------------------------------------------------------------------------------------------


def plain_code_length(train: bytes, text: bytes) -> float:
    """Method C with exclusion, byte by byte, from a table of followers."""
    order = language.ORDER
    followers = defaultdict(lambda: defaultdict(int))
    for n in range(order + 1):
        for i in range(n, len(train)):
            followers[n, train[i - n : i]][train[i]] += 1
    bits, whole = 0.0, b"\n" * order + text
    for i in range(order, len(whole)):
        excluded = set()
        for n in range(order, -1, -1):
            seen = followers.get((n, whole[i - n : i]), {})
            left = {b: c for b, c in seen.items() if b not in excluded}
            if not left:
                continue
            escapes = len(left) if len(seen) < 256 else 0
            if whole[i] in left:
                bits += np.log2((sum(left.values()) + escapes) / left[whole[i]])
                break
            bits += np.log2((sum(left.values()) + escapes) / escapes)
            excluded |= set(left)
        else:
            bits += np.log2(256 - len(excluded))
    return bits


def test_code_lengths_agree_with_plain_matching():
    rng = np.random.default_rng(7)
    words = ["the", "cat", "sat", "mat", "über", "日本", "x9"]
    texts = {k: [" ".join(rng.choice(w, 60)).encode() for _ in range(3)] for k, w in (("a", words[:4]), ("b", words[2:]), ("c", ["q"]), ("all", [bytes(range(256)).decode("latin1")]))}
    model = language.PartialMatching.learn(texts)
    asked = [b"", b"the cat", "über 日本 sat".encode(), bytes(range(256)), b"\n\nThe CAT", b"q q q\xff\xfe"]
    got = model.bits(asked)
    for j, k in enumerate(model.languages):
        folded = [t.lower() if t.isascii() else bytes(language._FOLD[np.frombuffer(t, np.uint8)]) for t in texts[k]]
        train = b"\n" * language.ORDER + (b"\n" * language.ORDER).join(folded)
        for i, t in enumerate(asked):
            assert np.isclose(got[i, j], plain_code_length(train, bytes(language._FOLD[np.frombuffer(t, np.uint8)])), rtol=1e-5, atol=1e-4)


def test_remembered_windows_change_nothing(monkeypatch):
    model = language.PartialMatching.learn({"a": [b"abcabc def " * 50], "b": [b"xyz zyx abd " * 50]})
    texts = [bytes(np.random.default_rng(i).integers(97, 123, 400, dtype=np.uint8)) for i in range(40)]
    fresh = [language.PartialMatching(dict(zip(model.languages, model.trees))).bits([t])[0] for t in texts]
    monkeypatch.setattr(language, "CACHE_BYTES", 0)
    assert (model.bits(texts) == fresh).all() and (model.bits(texts[::-1])[::-1] == fresh).all()


def test_long_texts_have_the_same_bits(monkeypatch):
    model = language.PartialMatching.learn({"a": [b"abcabc def " * 50], "b": [b"xyz zyx abd " * 50]})
    texts = [b"abc xyz " * 300, b"", b"q", b"def def abd zyx" * 90]
    whole = model.bits(texts)
    monkeypatch.setattr(language, "CHUNK", 64)
    assert np.allclose(model.bits(texts), whole, rtol=1e-5)


def test_language(spark, documents):
    model = language.learn_from(documents)
    got = language.identify(documents, model).join(documents.select("doc_id", "lang"), "doc_id").where(language.held_out()).collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)
    odd = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(table(spark), model).collect()}
    assert odd[0] == odd[1] == odd[10] == ("und", 0.0) and odd[4][0] in model.languages
    empty = language.learn_from(documents.limit(0))
    assert {r.lang_pred for r in language.identify(table(spark), empty).collect()} == {"und"}
    kept = language.keep_identified(documents, model)
    assert kept.columns == documents.columns and kept.count() >= 0.95 * documents.count()


def test_every_language_is_learnt(spark):
    say = {"aa": "the cat and the dog sat on the mat ", "bb": "der hund und die katze sind im haus ", "cc": "le chat et le chien sont dans la maison "}
    rows = [(i, say["aa"] * 3, "aa") for i in range(20)] + [(100, say["aa"] * 20_000, "aa")]  # one long text beside short ones
    rows += [(200 + i, say["bb"] * 2_000, "bb") for i in range(4)]  # long texts alone
    rows += [(300 + i, say["cc"] * 3, "cc") for i in range(20)] + [(400 + i, say["cc"] * 40, "cc") for i in range(20)]
    docs = spark.createDataFrame([r for i in range(8) for r in [(k + 1000 * i, t, g) for k, t, g in rows]], "doc_id long, text string, lang string")
    for sample in (9_000, 12_000, 30_000):
        model = language.learn_from(docs, sample)
        assert model.languages == ["aa", "bb", "cc"]
        got = language.identify(docs, model).join(docs, "doc_id").select("lang", "lang_pred").distinct().collect()
        assert all(r.lang == r.lang_pred for r in got)


def test_more_than_a_thousand_languages_are_learnt(spark):
    names = [f"l{i:04d}" for i in range(1100)]
    docs = spark.createDataFrame([(j * 2000 + i, f"{n} says {n[::-1]} and {n}", n) for i, n in enumerate(names) for j in range(6)], "doc_id long, text string, lang string")
    model = language.learn_from(docs)
    assert set(model.languages) == {r.lang for r in docs.where(~language.held_out()).select("lang").distinct().collect()} and len(model.languages) > 1050
    assert all(r.lang == r.lang_pred for r in language.identify(docs.limit(300), model).join(docs, "doc_id").where(F.col("lang").isin(model.languages)).collect())


def test_language_edges(spark):
    model = language.PartialMatching.learn({"aa": [b"the cat sat on the mat " * 30], "bb": [b"der hund im haus " * 30]})
    long = "The CAT sat " * 300_000
    rows = [(1, long, 5, "v"), (1, long, 5, "v"), (None, "der hund", 6, "w"), (2, None, 7, "x"), (3, "zz", 8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang_pred int, score string")
    got = language.identify(docs, model)
    assert got.columns == ["doc_id", "lang_pred", "score"] and sorted((r.lang_pred for r in got.collect() if r.doc_id == 1)) == ["aa", "aa"]
    assert {tuple(r) for r in language.keep_identified(docs, model).collect()} >= {rows[0], rows[2]}
    even = language.PartialMatching.learn({"bb": [b"abc"], "aa": [b"abc"]})  # a tie goes to the first in order
    assert {r.lang_pred for r in language.identify(docs.where("doc_id = 3"), even).collect()} == {"aa"}


def test_quality(spark, small):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    # learn on one half of the labels, judge on the other
    weights = quality.learn_evidence(docs, labels.where("doc_id % 2 = 0"))
    got = quality.score_documents(docs, weights).join(labels.select("doc_id", F.col("quality").alias("label")), "doc_id").where("doc_id % 2 = 1").collect()
    good, bad = [r.good for r in got if r.label == 1], [r.good for r in got if r.label == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.25 * len(bad)
    odd = quality.score_documents(table(spark), weights).collect()
    assert len(odd) == len(TEXTS) + 2 and not any(r.good for r in odd if r.doc_id in (0, 1, 2, 10))
    assert quality.keep_good(table(spark).limit(0), weights).count() == 0
    assert quality.keep_good(docs, weights).columns == docs.columns
    assert quality.learn_evidence(docs, labels.limit(0)) == list(quality.PRIOR_WEIGHTS)


def plain_quality(rows, weights):
    """Evidence given, sites and posteriors by plain loops. rows: (id, evidence or None, host, path)."""
    from collections import Counter

    p = lambda z: 0 if z is None else round(1e6 / (1 + np.exp(-z)))
    n, good = Counter(), Counter()
    for _, z, host, path in rows:
        n[host, path] += 1
        good[host, path] += p(z) / 1e6
    hn, hg = Counter(), Counter()
    for (h, _), c in n.items():
        hn[h] += c
    for (h, _), c in good.items():
        hg[h] += c
    world = min(max(sum(hg.values()) / sum(hn.values()), 0.001), 0.999)

    def strength(groups):  # (n, good, parent rate)
        total = sum(g[0] for g in groups)
        spread = sum(c * (g / c - r) ** 2 for c, g, r in groups) / total
        between = max(spread - sum(r * (1 - r) for _, _, r in groups) / total, 1e-6)
        return min(max(sum(c * r * (1 - r) for c, _, r in groups) / total / between - 1, 1), 1e6)

    k = strength([(hn[h], hg[h], world) for h in hn])
    rate = {h: (hg[h] + k * world) / (hn[h] + k) for h in hn}
    k = strength([(n[s], good[s], rate[s[0]]) for s in n])
    site = {s: (good[s] + k * rate[s[0]]) / (n[s] + k) for s in n}
    odds = lambda r: np.log(min(max(r, 0.001), 0.999) / (1 - min(max(r, 0.001), 0.999)))
    return [(i, 0.0 if z is None else 1 / (1 + np.exp(-(z + odds(site[h, q]) - odds(world))))) for i, z, h, q in rows]


@pytest.mark.parametrize("most", [100_000, 0])
def test_posteriors_agree_with_plain_loops(spark, monkeypatch, most):
    monkeypatch.setattr(quality, "BROADCAST_SITES", most)
    rng = random.Random(5)
    rows = [(i, rng.choice(["good plain words here. ", "#$%^ ||| !!! ", "ALL CAPS AND 12345 "]) * rng.randint(1, 9), rng.choice(["http://A.com/x/1", "a.com/y", "b.org", "b.org/x?q", None, "c.net/z"])) for i in range(200)]
    rows += [(200, None, "a.com/y"), (201, " \n", "b.org"), (201, " \n", "b.org"), (None, "no id", "c.net/z")]
    weights = list(quality.PRIOR_WEIGHTS)
    got = quality.score_documents(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights).collect()
    place = lambda s: ((s or "").lower().removeprefix("http://").split("/")[0], ((s or "").removeprefix("http://").split("/") + [""])[1].split("?")[0])
    source = {r[0]: r[2] for r in rows}
    expected = plain_quality([(r.doc_id, r.evidence, *place(source[r.doc_id])) for r in got], weights)
    assert len(got) == len(rows) and all(np.isclose(r.quality, q, atol=1e-6) and r.good == (q >= 0.5) for r, (_, q) in zip(got, expected))
    # paths of one host have rates of their own
    assert len({r.path_rate for r in got if source[r.doc_id] in ("b.org", "b.org/x?q")}) == 2


def test_sparse_sites_shrink_to_the_whole(spark):
    clean, noise = "The words of a plain text stand here in order. " * 5, "*** $$$ ### %%% &&& " * 12
    rows = [(i, clean if i % 10 else noise, "big.example/a") for i in range(200)] + [(1000 + i, noise, "bad.example") for i in range(60)] + [(2000, noise, "one.example")]
    got = quality.score_documents(spark.createDataFrame(rows, "doc_id long, text string, source string"), list(quality.PRIOR_WEIGHTS)).collect()
    rate = {r.doc_id: r.host_rate for r in got}
    assert rate[1] > 0.8 and rate[1000] < 0.2 and rate[1000] < rate[2000] < rate[1]


# --- registered queries ----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_registered_queries_agree_with_sql(spark, small, name):
    con = duckdb.connect()
    for t in os.listdir(small):
        con.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{small}/{t}'")
    found = con.sql(queries.ORACLE_SQL[name])
    df = queries.QUERIES[name](spark, small)
    got = [tuple(r[c] for c in found.columns) for r in df.collect()]
    assert sorted(got, key=repr) == sorted(found.fetchall(), key=repr) and sorted(df.columns) == sorted(found.columns)


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
