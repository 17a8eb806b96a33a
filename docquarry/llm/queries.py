"""The registered queries opN_<name>, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: The key of the registered queries; a production run passes its own secret.
PII_KEY = "registered-query-key"


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


def op1_byte_range_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_by_bytes

    return shard_by_bytes(_documents(spark, sf_dir, "doc_id", "text"), 16)


def op2_multiset_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import fingerprint_documents

    return fingerprint_documents(_documents(spark, sf_dir, "doc_id", "text"))


def op3_elias_fano_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .binary_output import read_token_files, write_token_files

    return read_token_files(write_token_files(_documents(spark, sf_dir, "doc_id", "text"), tokenizer_file("word_bpe_49k.json"), end_id=2))


def op4_partenum_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import link_documents

    return link_documents(_documents(spark, sf_dir, "doc_id", "text"), n=3, p=90, q=100)


def op5_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import pseudonymize

    return pseudonymize(_documents(spark, sf_dir, "doc_id", "text"), PII_KEY, "text", "n_replaced")


def op6_rank_array_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import round_trip_digests

    return round_trip_digests(_documents(spark, sf_dir, "doc_id", "text"), tokenizer_file("byte_bpe_50k.json"))


def op7_pivot_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(vectors, F.col("vec_id") % 100 == 0, 10)


def op8_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import language

    docs = _documents(spark, sf_dir, "doc_id", "text", "lang")
    found = language.identify(docs, language.learn_from(docs))
    return found.select("doc_id", F.coalesce(language.held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op9_site_bayes_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    docs = _documents(spark, sf_dir, "doc_id", "text", "source")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return quality.score_documents(docs, quality.learn_evidence(docs, labels))


def op10_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import cut_documents, place_pieces

    pieces = cut_documents(_documents(spark, sf_dir, "doc_id", "text"), tokenizer_file("byte_bpe_50k.json"), end_id=0)
    return place_pieces(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .filter_audit import audit_documents

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    return audit_documents(_documents(spark, sf_dir, "doc_id", "text", "lang"), labels)


def op12_pivot_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .collocations import collocations

    return collocations(_documents(spark, sf_dir, "text", "lang"), least=100, first=2000)


def op13_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .page_diff import main_texts

    return main_texts(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_byte_range_shards,
        op2_multiset_fingerprints,
        op3_elias_fano_tokens,
        op4_partenum_join,
        op5_feistel_pseudonyms,
        op6_rank_array_bpe,
        op7_pivot_top_k,
        op8_ppm_language,
        op9_site_bayes_quality,
        op10_harmonic_packing,
        op11_filter_audit,
        op12_pivot_collocations,
        op13_page_differencing,
    )
}

#: crc32 of the UTF-8 bytes of t.text, from its table by the rule of the polynomial.
_CRC32_SQL = """(SELECT list(list_reduce(range(8), lambda a, _: xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END), i) ORDER BY i) FROM range(256) r(i))"""

ORACLE_SQL: dict[str, str] = {
    "op1_byte_range_shards": f"""
WITH k AS MATERIALIZED (SELECT {_CRC32_SQL} AS crc),
d AS (
    SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size,
        xor(list_reduce(list_transform(regexp_extract_all(hex(coalesce(text, '')), '..'), lambda h: ('0x' || h)::BIGINT),
            lambda a, b: xor(a >> 8, k.crc[1 + (xor(a, b) & 255)]), 4294967295::BIGINT), 4294967295::BIGINT) AS text_crc32
    FROM documents, k
), r AS (
    SELECT *, coalesce(sum(size) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
        (sum(size) OVER ())::BIGINT AS total
    FROM d
), s AS (SELECT *, CAST(((2 * before + size) * 16) // (2 * total) AS INTEGER) AS shard FROM r)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, NULL::INTEGER AS grown_shard
FROM s
""",
    "op2_multiset_fingerprints": """
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
a AS (SELECT doc_id, t, coalesce(lead(t) OVER w, first_value(t) OVER w) AS nx, coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS next_id FROM t WINDOW w AS (ORDER BY doc_id)),
e AS (SELECT *, left(t, length(t) - length(t) // 2) || left(nx, length(t) // 2) AS edited FROM a),
p AS (
    SELECT doc_id, 0 AS kind, unnest(string_split(t, chr(10))) AS p FROM e
    UNION ALL SELECT doc_id, 1, unnest(string_split(edited, chr(10))) FROM e
), h AS (SELECT doc_id, kind, sha256('0:' || p) || sha256('1:' || p) AS h FROM p),
w AS (SELECT doc_id, kind, i, ('0x' || substr(h, 16 * i + 1, 16))::UBIGINT AS w FROM h, range(8) r(i)),
l AS (
    SELECT doc_id, kind, i AS k, sum(w & 1048575) % 1048576 AS x, sum((w >> 21) & 1048575) % 1048576 AS y, sum((w >> 42) & 1048575) % 1048576 AS z FROM w GROUP BY ALL
    UNION ALL
    SELECT doc_id, kind, 8 + 8 * s + i, sum((w >> s) & 1) % 1048576, sum((w >> (s + 21)) & 1) % 1048576, sum((w >> (s + 42)) & 1) % 1048576 FROM w, range(2) q(s) GROUP BY doc_id, kind, s, i
), n AS (SELECT doc_id, kind, count(*) AS n FROM p GROUP BY ALL),
f AS (
    SELECT doc_id, kind, any_value(n) AS n, printf('%08x', any_value(n) % 4294967296) || string_agg(printf('%016x', (x + y * 2097152 + z * 4398046511104)::BIGINT), '' ORDER BY k) AS hex
    FROM l JOIN n USING (doc_id, kind) GROUP BY doc_id, kind
), pairs AS (
    SELECT doc_id, 'edited' AS what, doc_id AS other, 1 AS other_kind FROM e UNION ALL SELECT doc_id, 'next', next_id, 0 FROM e
), g AS (
    SELECT q.doc_id, q.what, any_value(na.n) AS an, any_value(nb.n) AS bn,
        sum(pow(2 * (((la.x - lb.x + 1572864) % 1048576) - 524288) - (na.n - nb.n), 2) + pow(2 * (((la.y - lb.y + 1572864) % 1048576) - 524288) - (na.n - nb.n), 2)
            + pow(2 * (((la.z - lb.z + 1572864) % 1048576) - 524288) - (na.n - nb.n), 2)) AS total
    FROM pairs q JOIN n na ON na.doc_id = q.doc_id AND na.kind = 0 JOIN n nb ON nb.doc_id = q.other AND nb.kind = q.other_kind
        JOIN l la ON la.doc_id = q.doc_id AND la.kind = 0 AND la.k >= 8 JOIN l lb ON lb.doc_id = q.other AND lb.kind = q.other_kind AND lb.k = la.k
    GROUP BY q.doc_id, q.what
), s AS (
    SELECT g.doc_id, g.what, CASE WHEN fa.hex = fb.hex THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1.0::DOUBLE - total::DOUBLE / (48 * (an + bn))::DOUBLE) END AS near
    FROM g JOIN pairs q USING (doc_id, what) JOIN f fa ON fa.doc_id = g.doc_id AND fa.kind = 0 JOIN f fb ON fb.doc_id = q.other AND fb.kind = q.other_kind
)
SELECT e.doc_id, length(e.t) AS n_chars, sha256(e.edited) AS edited_sha256, f0.hex AS fingerprint, f1.hex AS edited_fingerprint, se.near AS near_edited, sn.near AS near_next
FROM e JOIN f f0 ON f0.doc_id = e.doc_id AND f0.kind = 0 JOIN f f1 ON f1.doc_id = e.doc_id AND f1.kind = 1
    JOIN s se ON se.doc_id = e.doc_id AND se.what = 'edited' JOIN s sn ON sn.doc_id = e.doc_id AND sn.what = 'next'
""",
    "op4_partenum_join": r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
    FROM documents
), g AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS s
    FROM w
), n AS (
    SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
), c AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY ALL
), l AS (
    SELECT c.a, c.b FROM c JOIN n x ON x.doc_id = c.a JOIN n y ON y.doc_id = c.b WHERE 100 * c.c >= 90 * (x.n + y.n - c.c)
), r AS (
    SELECT doc_id AS a, doc_id AS b FROM documents
    UNION
    SELECT r.a, l.b FROM r JOIN l ON l.a = r.b
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) m ON m.a = d.doc_id
""",
    "op7_pivot_top_k": """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS c
    FROM embeddings
    WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, x.vec_id, CAST(list_dot_product(q.c, x.c) AS BIGINT) AS score
    FROM v q JOIN v x ON q.vec_id <> x.vec_id
    WHERE q.vec_id % 100 = 0
), r AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
    FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
""",
    "op11_filter_audit": r"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
        min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id
    FROM documents
), l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (
    SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
        [len(ws) < 200, 100 * len(list_distinct(ws)) < 50 * len(ws), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t),
            regexp_matches(t, '[#$%&*|]'), coalesce(d.doc_id > first_id, false)] AS fails
    FROM d LEFT JOIN l USING (doc_id)
), c AS (
    SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic, len(list_filter(fails, lambda x: x)) AS size FROM f GROUP BY ALL
), one AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x), o AS (
    SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM one a JOIN one b ON a.x <> b.x JOIN one c ON c.x NOT IN (a.x, b.x)
        JOIN one d ON d.x NOT IN (a.x, b.x, c.x) JOIN one e ON e.x NOT IN (a.x, b.x, c.x, d.x)
), s AS (
    SELECT filter_order, step, fails[ascii(filter_order[step]) - 64] AS own, c.*,
        len(list_filter(range(1, step), lambda i: fails[ascii(filter_order[i]) - 64])) > 0 AS earlier
    FROM o, range(1, 6) r(step), c
)
SELECT part, filter_order, step::INTEGER AS step,
    coalesce(sum(n) FILTER (NOT own AND NOT earlier), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (own AND NOT earlier), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (own AND earlier), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (own AND size = 1), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (own AND NOT earlier), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (own AND NOT earlier), 0)::BIGINT AS toxic_lost,
    coalesce(sum(n * 120 // greatest(size, 1)) FILTER (own), 0)::BIGINT AS shapley
FROM s GROUP BY part, filter_order, step
""",
    "op12_pivot_collocations": r"""
WITH d AS (
    SELECT coalesce(lang, 'und') AS lang, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces
    FROM documents
), p AS (SELECT lang, unnest(list_transform(pieces, lambda x: regexp_extract_all(x, '[^\x20\x09]+'))) AS ws FROM d),
g AS (
    SELECT lang, k, phrase, count(*) AS f
    FROM (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase FROM p, range(1, 6) r(k))
    GROUP BY ALL
), t AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM g WHERE k > 1 AND f >= 100),
cut AS (
    SELECT lang, phrase, k, f AS a, unnest(range(1, k)) AS j, string_split(phrase, ' ') AS ws FROM c
), s AS (
    SELECT cut.lang, cut.phrase, cut.k, cut.a, cut.j, x.f AS l, y.f AS r, t.n,
        ((1000::HUGEINT * cut.a * t.n) // (x.f::HUGEINT * y.f))::BIGINT AS score
    FROM cut JOIN t USING (lang)
        JOIN g x ON x.lang = cut.lang AND x.phrase = array_to_string(ws[1:j], ' ')
        JOIN g y ON y.lang = cut.lang AND y.phrase = array_to_string(ws[j + 1:cut.k], ' ')
), b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
sub AS (
    SELECT DISTINCT lang, a, unnest(list_transform(range(1, k - m + 2), lambda i: array_to_string(ws[i:i + m - 1], ' '))) AS phrase
    FROM (SELECT lang, f AS a, k, string_split(phrase, ' ') AS ws FROM c), range(2, 5) r(m)
    WHERE m < k
), kept AS (SELECT * FROM b ANTI JOIN sub ON sub.lang = b.lang AND sub.phrase = b.phrase AND 100 * sub.a >= 100 * b.a)
SELECT lang, rank, phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
WHERE rank <= 2000
""",
}
