"""Document fingerprints: a homomorphic multiset hash of paragraphs (lines).

A paragraph's SHA-256 digests give eight 64-bit words. From them come two parts of its wide vector:

* 24 lanes of 20 bits, added modulo 2^20: equal multisets have equal sums, others differ but for chance (2^-480);
* 48 lanes of one bit, added modulo 2^20: with the number of paragraphs they give a +1/-1 projection, so the
  difference of two fingerprints estimates how many paragraphs (with repeats) the two texts don't share.

Three lanes lie in one long, each with a guard bit that is cleared after an addition. Sums don't depend on the order;
``insert`` and ``delete`` change a fingerprint without the rest of the text.

Defined results: null text is the empty text, which has one empty paragraph; equal texts have equal fingerprints;
rows with a null id come first; rows of equal id are ordered by a hash of the text, then by text; an empty table gives no
rows; in a table of one row the next document is the row itself; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

STARTS = (0, 21, 42)
LANES = sum(0xFFFFF << s for s in STARTS)
BITS = sum(1 << s for s in STARTS)
GUARDS = sum(1 << s + 20 for s in STARTS)
WORDS, PROJECTIONS = 8, 2  # 64-bit words of digests; one-bit vectors drawn from each


def _bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once: it is bound by a transform over a one-element array."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _words(paragraph: Column) -> Column:
    """array<long> of 8 + 16 packed lanes."""

    def read(digests: Column) -> Column:
        return F.array(*[F.conv(F.substring(digests, 16 * i + 1, 16), 16, -10).cast("long") for i in range(WORDS)])

    def bits(words: Column, shift: int) -> Column:
        return F.transform(words, lambda x: F.shiftrightunsigned(x, shift).bitwiseAND(F.lit(BITS)))

    def lanes(words: Column) -> Column:
        return F.concat(F.transform(words, lambda x: x.bitwiseAND(F.lit(LANES))), *[bits(words, s) for s in range(PROJECTIONS)])

    digests = F.concat(F.sha2(F.concat(F.lit("0:"), paragraph), 256), F.sha2(F.concat(F.lit("1:"), paragraph), 256))
    return _bound(_bound(digests, read), lanes)


def _combine(a: Column, b: Column, sign: int) -> Column:
    if sign > 0:
        return F.zip_with(a, b, lambda x, y: (x + y).bitwiseAND(F.lit(LANES)))
    return F.zip_with(a, b, lambda x, y: (x.bitwiseOR(F.lit(GUARDS)) - y).bitwiseAND(F.lit(LANES)))


def vector(text: Column) -> Column:
    """struct<n: long, lanes: array<long>> of a text."""
    paragraphs = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    zero = F.array_repeat(F.lit(0).cast("long"), WORDS * (1 + PROJECTIONS))
    return F.struct(
        F.size(paragraphs).cast("long").alias("n"),
        F.aggregate(paragraphs, zero, lambda acc, p: _combine(acc, _words(p), 1)).alias("lanes"),
    )


def insert(fp: Column, paragraph: Column) -> Column:
    """The vector of the text with one more paragraph, wherever it is put."""
    return F.struct((fp["n"] + 1).alias("n"), _combine(fp["lanes"], _words(paragraph), 1).alias("lanes"))


def delete(fp: Column, paragraph: Column) -> Column:
    """The vector of the text without one copy of a paragraph that it has."""
    return F.struct((fp["n"] - 1).alias("n"), _combine(fp["lanes"], _words(paragraph), -1).alias("lanes"))


def as_hex(fp: Column) -> Column:
    """The fingerprint as lowercase hex: 8 digits of the count modulo 2^32, then 16 of each long."""
    count = F.lpad(F.lower(F.hex(fp["n"].bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")
    return F.concat(count, F.array_join(F.transform(fp["lanes"], lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """1 - (estimated paragraphs not shared) / (paragraphs of both), from 0 to 1; 1 for equal fingerprints."""
    gap = a["n"] - b["n"]
    first, last = WORDS + 1, WORDS * PROJECTIONS

    def squares(x: Column, y: Column) -> Column:
        parts = []
        for s in STARTS:
            d = F.shiftright(x, s).bitwiseAND(F.lit(0xFFFFF)) - F.shiftright(y, s).bitwiseAND(F.lit(0xFFFFF))
            d = (d + F.lit(3 << 19)).bitwiseAND(F.lit(0xFFFFF)) - F.lit(1 << 19)  # back from modulo 2^20
            parts.append((d * 2 - gap) * (d * 2 - gap))
        return parts[0] + parts[1] + parts[2]

    pairs = F.zip_with(F.slice(a["lanes"], first, last), F.slice(b["lanes"], first, last), squares)
    total = F.aggregate(pairs, F.lit(0).cast("long"), lambda acc, x: acc + x)
    lanes = len(STARTS) * WORDS * PROJECTIONS
    return F.when(a == b, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.lit(1.0) - total.cast("double") / (F.lit(lanes) * (a["n"] + b["n"])).cast("double")))


#: Bytes of a block of texts that the number of blocks aims at, and bounds of that number.
BLOCK_BYTES, LEAST_BLOCKS, MOST_BLOCKS = 128 << 20, 256, 65_536


def _block_count(docs: DataFrame) -> int:
    """From the size that the plan's statistics tell, without a scan."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(MOST_BLOCKS, max(LEAST_BLOCKS, -(-size // BLOCK_BYTES)))


def _block_number(id_: Column, hash_: Column, cuts: list[int]) -> Column:
    """The block of a row: the number of cuts up to the id, looked up in two steps, and for null ids and ids that fill more
    than one block a part of them by the high bits of the hash."""
    part = F.shiftright(hash_, 56) + 128
    heavy = sorted({a for a, b in zip(cuts, cuts[1:]) if a == b})
    cuts = sorted(set(cuts))
    literal = lambda values: F.array(*[F.lit(c).cast("long") for c in values])
    below = lambda values: F.size(F.filter(values, lambda c: c <= id_))
    if len(cuts) <= 256:
        block = below(literal(cuts)) if cuts else F.lit(0)
    else:
        groups = [cuts[i : i + 256] for i in range(0, len(cuts), 256)]
        group = F.greatest(below(literal(g[0] for g in groups)) - 1, F.lit(0))
        block = _bound(group, lambda g: g * 256 + below(F.get(F.array(*[literal(x) for x in groups]), g)))
    inside = F.when(id_.isin(heavy), part).otherwise(F.lit(256)) if heavy else F.lit(256)
    return F.when(id_.isNull(), part - 512).otherwise(block * 512 + inside).cast("long")


def with_next(docs: DataFrame, id_col: str, text_col: str, blocks: int | None = None) -> DataFrame:
    """id, text, fp and those of the row with the next id (after the last: the first), with one shuffle of the texts.

    Ids are cut into ranges at their approximate quantiles; how many follows from the bytes of the table. Null ids, and ids
    that alone fill more than one range, are cut further by a hash of the text. One copy of each block's first row is also
    dealt to the block before, as its last row's successor, so a window over a block is complete.
    """
    blocks = blocks or _block_count(docs)
    cuts = docs.agg(F.percentile_approx(id_col, [i / blocks for i in range(1, blocks)], 10 * blocks)).first()[0] if blocks > 1 else []
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("hash", F.xxhash64("text")).withColumn("block", _block_number(F.col("id").cast("long"), F.col("hash"), cuts or []))
    place = F.struct(F.col("id").isNotNull().alias("has"), F.col("id").alias("id"), F.col("hash").alias("hash"))
    firsts = rows.groupBy("block").agg(F.min(place).alias("least"))  # a row for each block
    before = F.coalesce(F.lag("block").over(Window.orderBy("block")), F.max("block").over(Window.partitionBy(F.lit(1))))
    firsts = written(firsts.select("block", "least", before.alias("before")), "blocks")
    guests = rows.withColumn("place", place).join(F.broadcast(firsts), "block").where(F.col("place").eqNullSafe(F.col("least"))).dropDuplicates(["block"])
    fp = vector(F.col("text")).alias("fp")
    dealt = rows.select("id", "text", "hash", "block", F.lit(0).alias("guest"), fp).union(guests.select("id", "text", "hash", F.col("before").alias("block"), F.lit(1).alias("guest"), fp))
    window = Window.partitionBy("block").orderBy("guest", F.col("id").asc_nulls_first(), "hash", "text")
    following = F.lead(F.struct("text", "fp")).over(window)
    return dealt.select("id", "text", "fp", "guest", following.alias("next")).where("guest = 0").drop("guest")


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", blocks: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last half gives way to the next document's beginning."""
    rows = with_next(docs.select(id_col, text_col), id_col, text_col, blocks)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next.text"), F.lit(1), half)))
    rows = rows.select("id", n.cast("long").alias("n_chars"), "fp", F.col("next.fp").alias("next_fp"), F.sha2("edited", 256).alias("edited_sha256"), vector(F.col("edited")).alias("edited_fp"))
    return rows.select(
        F.col("id").alias(id_col),
        "n_chars",
        "edited_sha256",
        as_hex(F.col("fp")).alias("fingerprint"),
        as_hex(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
