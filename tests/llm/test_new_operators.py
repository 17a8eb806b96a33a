"""Filter audit, collocations and page differencing against plain code, with nulls, ties, repeats and empty tables."""

import itertools
import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from docquarry.llm import collocations, filter_audit, page_diff, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [None, "", " \t", "one two " * 120, "One Two THREE #", "one two " * 120, " ".join(f"w{i}" for i in range(250)), "a" * 100_000, "\x1c \x85 x　y\xa0z", "é " * 300 + "$", "A\nB\x0bC"]


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words int, digest string")


def plain_audit(rows, labels):
    good, toxic, first = defaultdict(bool), defaultdict(bool), {}
    for i, q, t in labels:
        if i is not None:
            good[i] |= q == 1
            toxic[i] |= t == 1
    for i, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    fails = defaultdict(list)
    for i, t, lang, *_ in rows:
        t = t or ""
        words = WORD.findall(t)
        failed = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
            "D": any(c in "#$%&*|" for c in t),
            "E": i is not None and i > first[t],
        }
        fails[lang or ""].append(({k for k, v in failed.items() if v}, i is not None and good[i], i is not None and toxic[i]))
    out = {}
    for part, docs in fails.items():
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, x in enumerate(order, 1):
                before = set(order[: step - 1])
                gone = [d for d in docs if x in d[0] and not d[0] & before]
                out[part, order, step] = (
                    sum(not d[0] & (before | {x}) for d in docs), len(gone), sum(x in d[0] and bool(d[0] & before) for d in docs), sum(d[0] == {x} for d in docs),
                    sum(d[1] for d in gone), sum(d[2] for d in gone),
                )
    shapley = defaultdict(int)
    for (part, order, step), row in out.items():
        shapley[part, order[step - 1]] += row[1]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit(spark, small):
    rows = [(i, t, ["en", None, "", "de"][i % 4], 1, "x") for i, t in enumerate(TEXTS * 3)] + [(4, TEXTS[4], "en", 0, ""), (None, TEXTS[3], "en", 0, ""), (None, "alone", None, 0, "")]
    labels = [(1, 1, 0), (3, 1, 1), (3, 0, 0), (5, None, 1), (None, 1, 1), (4, 1, None), (99, 1, 1)]
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit_documents(docs_of(spark, rows), frame).collect()
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got} == plain_audit(rows, labels) and len(got) == 3 * 600
    assert filter_audit.audit_documents(docs_of(spark, []), frame).count() == 0
    stats = filter_audit.text_statistics(docs_of(spark, [(0, "word " * 2_000_000, "en", 0, ""), (1, "end", "en", 0, "")])).collect()
    assert [(r.n_words, r.n_distinct) for r in stats] == [(2_000_000, 1), (1, 1)]


def plain_phrases(rows, least, first):
    f, n = defaultdict(Counter), Counter()
    fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(fold)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 6):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        frequent = {g: a for g, a in counts.items() if len(g) > 1 and a >= least}
        held = {g[i : i + k] for g, a in frequent.items() for k in range(2, len(g)) for i in range(len(g) - k + 1) if a >= counts[g[i : i + k]]}
        scored = []
        for g, a in frequent.items():
            if g not in held:
                score, k = min((1000 * a * n[lang] // (counts[g[:k]] * counts[g[k:]]), k) for k in range(1, len(g)))
                scored.append((-score, -a, " ".join(g).encode(), counts[g[:k]], counts[g[k:]]))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(scored)[:first], 1)]
    return sorted(out)


def phrase_rows(rng, n):
    lines = [" ".join(rng.choice("abcde") for _ in range(6)) for _ in range(4)]
    return [("".join(rng.choice(["a ", "b ", "The ", "é\xa0ß ", "c. ", "d\t", "x\n", "y!", rng.choice(lines) + " ", f"r{rng.randint(0, 40)} "]) for _ in range(rng.randint(0, 60))), rng.choice(["en", "en", None, "und", "de"])) for _ in range(n)]


@pytest.mark.parametrize("sizes", [None, (40, 64, 16, 50)])
def test_collocations(spark, sizes, monkeypatch):
    for name, size in zip(("BLOCK", "CHUNK", "GROUP", "BUCKET"), sizes or (), strict=bool(sizes)):
        monkeypatch.setattr(collocations, name, size)
    rows = [*phrase_rows(random.Random(7), 300), (None, "en"), ("", None), (" \n.", "fr"), ("no blank " * 3000, "long")]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    for least, first in ((3, 2000), (12, 7)):
        assert sorted(map(tuple, collocations.collocations(docs, least, first).collect())) == plain_phrases(rows, least, first)
    assert collocations.collocations(docs.limit(0)).count() == 0


def test_phrase_scores_pass_64_bits(spark):
    grams = spark.createDataFrame([("en", bytes(7) + b"\1" + bytes(7) + b"\2", 2, 4 * 10**12)], "lang string, gram binary, n int, f long")
    numbered = spark.createDataFrame([("en", "a", 5 * 10**12, 1), ("en", "b", 4 * 10**12, 2)], "lang string, word string, f long, id long")
    totals = spark.createDataFrame([("en", 9 * 10**15)], "lang string, n long")
    assert [r.score for r in collocations.score(grams, numbered, totals).collect()] == [1000 * 4 * 9 * 10**27 // (5 * 4 * 10**24)]


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_pivot_collocations"])
def test_sql_agrees(spark, name):
    folder = "/root/testdata/sf0.01"
    db = duckdb.connect()
    for t in ("documents", "labels"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got = queries.QUERIES[name](spark, folder)
    expected = db.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in expected.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(expected.fetchall())


# --- pages -----------------------------------------------------------------------------------------------------------


def plain_common(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, j in itertools.product(range(len(a)), range(len(b))):
        table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_common_lines():
    rng = random.Random(3)
    for _ in range(500):
        a, b = ([rng.randint(0, 5) for _ in range(rng.randint(0, 15))] for _ in "ab")
        places, rest = page_diff.common_lines(a, b), iter(b)
        assert len(set(places)) == plain_common(a, b) and places == sorted(places) and all(any(y == a[i] for y in rest) for i in places)


FRAMED = """<!doctype html><html><head><title>no</title><style>p{}</style></head><body class="with-sidebar"><header><h2>Site</h2></header><nav><ul><li><a href=x>Menu</a></li></ul></nav>
<div id="cookieBanner">We use cookies</div><main><article><header><h1>Caf&eacute;  &amp;&nbsp;bar</h1></header><p>One <b>t</b>wo<br>three<p class="ad">Buy<p>Four <span class="share">Tell</span> five
<script>var t="</p>";</script><!-- <p>no</p> --><table><tr><td>six<td>seven</table><form><p>Name<input></form><section class="comments"><article><p>Nice!</p></article></section><div hidden>h</div></article></main>
<aside><p>Also</p></aside><footer>&copy;</footer></body></html>"""


def test_page_lines():
    kept = [t for t, k in page_diff.page_lines(FRAMED) if k == page_diff.MAIN]
    assert kept == ["Café & bar", "One two three", "Four", "five", "six", "seven"]
    assert page_diff.page_lines("") == [] and page_diff.page_lines("a < b & c") == [("a < b & c", page_diff.OPEN)]
    assert page_diff.page_lines("<div class=page-sidebar><article>x") == [("x", page_diff.MAIN)]
    assert page_diff.page_lines('<p "' * 3000)[0][1] == page_diff.OPEN


def soup(i, body):
    return f"<html><body><table><tr><td>Daily paper</td><td>Weather: fine</td></tr></table><div>{''.join(f'<p>{b}</p>' for b in body)}</div><p>All rights of the paper</p><p>Visits: {i // 1000}</p></body></html>"


def test_pages_without_marks_are_told_by_their_neighbours(spark):
    bodies = {i: [f"story {i} begins here and goes on for a while", f"it ends with {i * 7} at last", "same words"] for i in range(40)}
    pages = [(i, f"https://paper.example/{'ab'[i % 2]}/{i:03d}?x={i}", soup(i, bodies[i])) for i in bodies]
    pages += [(100 + i, f"https://paper.example/c/{i}", soup(i, bodies[0])) for i in range(3)]  # copies among themselves
    pages += [(200, "https://other.example/", soup(0, ["alone"])), (201, None, FRAMED), (202, "http://[bad", soup(0, ["odd"])), (203, "https://paper.example/z", None), (None, "https://paper.example/y", ""), pages[3]]
    frame = spark.createDataFrame([(*p, "own", 5) for p in pages], "page_id long, url string, html string, text string, n_shared int").repartition(4)
    rows = page_diff.main_texts(frame).collect()
    got = defaultdict(list)
    for r in rows:
        got[r.page_id].append(r)
        assert r.n_chars == len(r.text)
    assert len(rows) == len(pages) and len(got[3]) == 2
    for i in range(40):
        assert got[i][0].text == " ".join(bodies[i][:2]) and got[i][0].n_shared == 5
    whole = "Daily paper Weather: fine {} All rights of the paper Visits: 0"
    assert got[200][0].text == whole.format("alone") and got[202][0].text == whole.format("odd")
    assert got[201][0].text == "Café & bar One two three Four five six seven"
    assert got[203][0].text == got[None][0].text == ""
    assert all(got[100 + i][0].text == got[100][0].text and bodies[0][0] in got[100][0].text for i in range(3))
    assert page_diff.main_texts(frame.limit(0)).count() == 0


def test_articles_of_the_test_pages(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    from html import unescape

    for r in page_diff.main_texts(pages).join(pages.select("page_id", "html"), "page_id").collect():
        article = re.sub(r"</?(p|h1|br)>", " ", re.search(r"<article>(.*)</article>", r.html, re.S)[1])
        assert r.text == " ".join(unescape(re.sub("<.*?>", "", article)).split())
    assert queries.QUERIES["op13_page_differencing"](spark, small).where(F.col("n_shared") + F.col("n_marked") == 0).count() == 0


def test_words_are_dealt_once_for_counts_and_places(spark):
    """Each word that reaches the least count has one number, beside all its places; rarer words have larger numbers."""
    texts = [("en", " ".join(f"w{i % m}" for i in range(400))) for m in (3, 7, 40, 90)] + [("de", "w1 w1 x. x"), (None, "x x")]
    docs = spark.createDataFrame([(t, lang) for lang, t in texts], "text string, lang string").repartition(3)
    blocks = collocations.encode_blocks(docs).cache()
    placed = collocations.place_words(blocks, 2)
    lists = {r.block: (r.lang, r.words) for r in blocks.collect()}
    counts = {}
    for lang, text in texts:
        for w in text.replace(".", "").split():
            counts[lang or "und", w] = counts.get((lang or "und", w), 0) + 1
    rows, ids = placed.collect(), {}
    assert {(r.block, r.place, r.lang, r.word) for r in rows} == {(b, i, lang, w) for b, (lang, words) in lists.items() for i, w in enumerate(words) if counts[lang, w] >= 2} and len(rows) == len({(r.block, r.place) for r in rows})
    for r in rows:
        assert r.f == counts[r.lang, r.word] and ids.setdefault((r.lang, r.word), r.id) == r.id
    assert sorted(ids.values()) == list(range(1, len(ids) + 1))
    assert sorted((r.lang, r.word) for r in rows if r.first) == sorted(ids)
    assert all(counts[b] <= 1.2 * counts[a] for a in ids for b in ids if ids[a] < ids[b])
    # the blocks meet the numbers without dealing words anew
    plan = collocations.fragments(blocks, placed, 1)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(block" in plan and "hashpartitioning(lang" not in plan


def test_places_go_on_as_lists(spark, monkeypatch):
    """A task hands on one list of places for each block, however many words reach the least count, and no row for each place."""
    texts = [(" ".join(f"w{(i * k) % 997}" for i in range(3000)), "en") for k in (1, 5, 7, 11)]
    blocks = collocations.encode_blocks(spark.createDataFrame(texts, "text string, lang string").repartition(4)).cache()
    tables, writes = {}, collocations.written
    monkeypatch.setattr(collocations, "written", lambda df, name: tables.setdefault(name, writes(df, name)))
    places = collocations.place_words(blocks, 2)
    assert places.count() == sum(len(r.words) for r in blocks.collect()) > 2900
    words, tasks = tables["words"], tables["words"].select("part").distinct().count()
    assert words.where("block IS NOT NULL").count() <= tasks * blocks.count() and words.count() < 300
    assert words.where("block IS NULL").selectExpr("sum(size(words))").first()[0] == 997
