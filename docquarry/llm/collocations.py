"""Phrases of two to five words that stand together more often than chance, mined by pivot partitioning (as in MG-FSM).

A phrase's pivot is its rarest word (ties: the later in byte order). All occurrences of a phrase can be counted where the
fragments of its pivot are, so texts are rewritten for each pivot: around every occurrence of a frequent word only the
four neighbours on either side stay that are at least as frequent; the rest is cut off. Fragments go to the pivot's
partition; there phrases are counted, shorter ones first, and only those that hold the pivot are given out.

1. ``encode_blocks``: texts become blocks of a million word numbers with their own word list, so words are
   handled as strings once. The blocks are written; word counts come from their lists alone.
2. The words of all blocks are dealt by word once: there they are counted, and those that reach ``least`` are numbered. What
   a task knows of a block's words goes on as one list, not as a row for each place (``list_words``): of a larger table a larger
   share of the words reaches ``least``, so such rows would grow faster than the table. Numbers follow falling frequency by steps
   of a quarter of its binary logarithm; totals of steps and partitions tell where each begins.
3. ``fragments``: each block meets the numbers of its own words (no table of all words is sent to anyone, and no word
   is shuffled again) and emits the rewritten fragments, equal ones counted once, a row for each bucket of pivots and two million words.
4. ``mine``: each bucket by itself; their number grows with the words. A pivot of more than ``GROUP`` occurrences is
   split over several buckets by a salt, whose counts are added up afterwards. What doesn't reach ``least`` where a pivot
   is whole ends there.
5. Scores, the phrases that a longer one explains, and the first rows of each language are joins and aggregations.

Nulls and odd rows: a null text is empty, a null language is ``und``, repeated rows count again, ids aren't read. Texts
without a word, or an empty table, give no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Words of a block, of what is rewritten at once, and of a group that is mined as a whole.
BLOCK, CHUNK, GROUP = 1 << 20, 1 << 21, 1 << 19
#: Words whose fragments one bucket holds on average; a bucket is mined at once.
BUCKET = 1 << 21
#: Places that a task holds before their lists go on.
PLACES = 1 << 20
LONGEST, AROUND = 5, 4
#: A-Z to a-z, blank for tab, and a line end for whatever ends a piece: [.,;:!?] and \x0A to \x0D.
_FOLD = bytes(ord(chr(c).lower()) if 65 <= c <= 90 else 32 if c == 9 else 10 if c in b".,;:!?\x0a\x0b\x0c\x0d" else c for c in range(256))


class _Block:
    """Word numbers of one language; 0 ends a piece."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = {}
        self.codes: list[np.ndarray] = []
        self.size = 0

    def add(self, text: bytes) -> None:
        number = self.number
        # a line end is a word of its own here, with number 0
        words = text.translate(_FOLD).replace(b"\n", b" \n ").split(b" ")
        codes = np.fromiter((0 if w == b"\n" else number.setdefault(w, len(number) + 1) for w in words if w), np.uint32)
        self.codes += [codes, np.zeros(1, np.uint32)]
        self.size += len(codes) + 1

    def row(self) -> dict:
        codes = np.concatenate(self.codes)
        codes = codes[np.append(True, (codes[1:] != 0) | (codes[:-1] != 0))]  # one end is enough
        counts = np.bincount(codes, minlength=len(self.number) + 1)[1:]
        return {"codes": zlib.compress(_narrow(codes), 6), "words": [w.decode() for w in self.number], "counts": counts.tolist()}


def encode_blocks(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Rows (block, lang, codes, words, counts): the word numbers of many texts of one language."""
    schema = pa.schema([("block", pa.int64()), ("lang", pa.string()), ("codes", pa.binary()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[str, _Block] = {}
        block_id, open_words = TaskContext.get().partitionId() << 33, 0

        def flush(langs: list[str]) -> Iterator[pa.RecordBatch]:
            nonlocal block_id, open_words
            for lang in langs:
                block = blocks.pop(lang)
                open_words -= block.size
                yield pa.RecordBatch.from_pylist([{"block": block_id, "lang": lang} | block.row()], schema)
                block_id += 1

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                block = blocks.setdefault(lang, _Block())
                open_words -= block.size
                block.add(text or b"")
                open_words += block.size
                if block.size >= BLOCK:
                    yield from flush([lang])
                elif open_words >= 4 * BLOCK:
                    yield from flush(list(blocks))
        yield from flush(list(blocks))

    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "block long, lang string, codes binary, words array<string>, counts array<long>")


def list_words(blocks: DataFrame, least: int) -> DataFrame:
    """Lists of the words that reach ``least``, of two kinds of rows, with where each of their steps begins (``bases``).

    Rows without a block: the ``words`` of a language, their counts ``f``, ``step`` and ``known``, the number in the step. Rows
    with one: the ``place`` of such words in the block's list, their ``step``, and in ``known`` the number below the
    groups of the pivot (40 bits). Of two words of a language the one with the larger id, bases[step] + number, isn't
    more than a fifth more frequent. A phrase's count doesn't depend on which of its words is the pivot, only the work does.
    """
    each = blocks.select("block", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("place", "w")).select("lang", F.col("w.words").alias("word"), "block", "place", F.col("w.counts").alias("n"))
    word = Window.partitionBy("lang", "word")
    met = each.repartition("lang", "word").withColumn("f", F.sum("n").over(word)).where(F.col("f") >= least)
    step = F.floor(F.log2("f") * 4).cast("int").alias("step")
    salts = F.least(F.ceil(F.col("f") / GROUP), F.lit(1 << 22)).cast("long").alias("salts")
    most = PLACES
    schema = pa.schema([("part", pa.int32()), ("lang", pa.string()), ("block", pa.int64()), ("words", pa.list_(pa.string())), ("f", pa.list_(pa.int64())), ("place", pa.list_(pa.int32())), ("step", pa.list_(pa.int32())), ("known", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, counts, last, number = TaskContext.get().partitionId(), {}, None, 0
        held: list[list[np.ndarray]] = []

        def rows(cuts: np.ndarray, **columns) -> pa.RecordBatch:
            """A row for each piece between the cuts: whole columns are cut to lists, those of ``schema`` without a list are given by row."""
            n, ends = len(cuts) - 1, pa.array(cuts, pa.int32())
            out = {"part": pa.array(np.full(n, part, np.int32))}
            for field in schema:
                if field.name in columns:
                    x = columns[field.name]
                    out[field.name] = pa.ListArray.from_arrays(ends, pa.array(x, field.type.value_type)) if pa.types.is_list(field.type) else pa.array(x, field.type)
            return pa.RecordBatch.from_arrays([out.get(f.name, pa.nulls(n, f.type)) for f in schema], schema=schema)

        def by_block() -> pa.RecordBatch:
            block, *columns = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.argsort(block, kind="stable")
            block, (place, step, known) = block[order], (x[order] for x in columns)
            begin = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
            return rows(np.append(begin, len(block)), block=block[begin], place=place, step=step, known=known)

        for batch in batches:  # rows of one word follow each other
            if not batch.num_rows:
                continue
            langs, words = batch.column(0), batch.column(1)
            f, block, place, step, salts = (batch.column(i).to_numpy() for i in range(2, 7))
            fresh = np.append((langs[0].as_py(), words[0].as_py()) != last, pc.or_(pc.not_equal(langs[1:], langs[:-1]), pc.not_equal(words[1:], words[:-1])).to_numpy(zero_copy_only=False))
            last = langs[-1].as_py(), words[-1].as_py()
            begin, numbers = np.flatnonzero(fresh), [number]
            for s in step[begin].tolist():
                numbers.append(counts.get(s, 0))
                counts[s] = numbers[-1] + 1
            number = numbers[-1]
            known = np.repeat(np.array(numbers, np.int64), np.diff(np.concatenate([[0], begin, [len(f)]])))
            held.append([block, place, step, (salts << 40) | known])
            if len(begin):
                at = pa.array(begin)
                own = langs.take(at)
                cuts = np.flatnonzero(np.append(True, pc.not_equal(own[1:], own[:-1]).to_numpy(zero_copy_only=False)))
                yield rows(np.append(cuts, len(begin)), lang=own.take(pa.array(cuts)), words=words.take(at), f=f[begin], step=step[begin], known=known[begin])
            if sum(len(x[0]) for x in held) >= most:
                yield by_block()
        if held:
            yield by_block()

    listed = met.select("lang", "word", "f", "block", "place", step, salts).mapInArrow(run, "part int, lang string, block long, words array<string>, f array<long>, place array<int>, step array<int>, known array<long>")
    listed = written(listed, "words")
    sizes = listed.where("block IS NULL").select("part", F.explode("step").alias("step")).groupBy("step", "part").agg(F.count("*").alias("_size"))  # about a hundred steps for each partition at most
    before = Window.orderBy(F.desc("step"), "part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("part", F.struct("step", (F.coalesce(F.sum("_size").over(before), F.lit(0)) + 1).alias("base")).alias("_base"))
    of_part = bases.groupBy("part").agg(F.map_from_entries(F.collect_list("_base")).alias("_bases"))
    of_part = of_part.select("part", F.transform(F.sequence(F.lit(0), F.lit(255)), lambda s: F.col("_bases")[s]).alias("bases"))
    return listed.join(F.broadcast(of_part), "part")


def _numbered(listed: DataFrame) -> DataFrame:
    """Rows (lang, word, f, id) of the lists' words."""
    each = listed.where("block IS NULL").select("lang", "bases", F.explode(F.arrays_zip("words", "f", "step", "known")).alias("w"))
    return each.select("lang", F.col("w.words").alias("word"), F.col("w.f").alias("f"), (F.col("bases")[F.col("w.step")] + F.col("w.known")).alias("id"))


def _lists_of_blocks(listed: DataFrame) -> DataFrame:
    """Rows (block, place, known): the places of numbered words, and the ids of those words below the groups of their pivots."""
    known = F.zip_with("step", "known", lambda s, k: F.col("bases")[s] + k).alias("known")
    return listed.where("block IS NOT NULL").select("block", "place", known)


def place_words(blocks: DataFrame, least: int) -> DataFrame:
    """Rows (lang, word, f, id, first, block, place): where the words that reach ``least`` stand in the lists of the blocks.

    ``first`` is true in one row of each word. This has a row for each place; ``collocations`` goes on with the lists.
    """
    listed = list_words(blocks, least)
    each = _lists_of_blocks(listed).select("block", F.explode(F.arrays_zip("place", "known")).alias("w"))
    each = each.select("block", F.col("w.place").alias("place"), F.col("w.known").bitwiseAND(F.lit((1 << 40) - 1)).alias("id"))
    first = F.row_number().over(Window.partitionBy("id").orderBy("block", "place")) == 1
    return each.withColumn("first", first).join(_numbered(listed), "id").select("lang", "word", "f", "id", "first", "block", "place")


def number_words(blocks: DataFrame, least: int) -> DataFrame:
    """Rows (lang, word, f, id) of the words that reach ``least``."""
    return _numbered(list_words(blocks, least))


def _mixed(columns: list[np.ndarray]) -> np.ndarray:
    """A 64-bit mix of each row; rows that meet in it are compared before they count as one."""
    h = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        h = (h ^ c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def _runs(columns: list[np.ndarray], first: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal rows together (sorted by ``first``, if given) and where in it each run of equal rows begins.

    Should unlike rows share a mix, equal ones may stand apart: they make more runs, which are added up later.
    """
    mix = _mixed(columns)
    order = np.argsort(mix, kind="stable") if first is None else np.lexsort((mix, first))
    fresh = np.ones(len(order), bool)
    if len(order) > 1:
        fresh[1:] = False
        for c in columns if first is None else [first, *columns]:
            sorted_c = c[order]
            fresh[1:] |= sorted_c[1:] != sorted_c[:-1]
    return order, np.flatnonzero(fresh)


def _rewritten(ids: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Places of the words with a neighbour left, and their left and right neighbours (nearest first, 0 where cut off).

    A phrase that holds its pivot several times is found at the first of them: words on the left must be more frequent."""
    n = len(ids)
    padded = np.concatenate([np.zeros(AROUND, ids.dtype), ids, np.zeros(AROUND, ids.dtype)])
    left, right = [], []
    for side, out, sign in (("left", left, -1), ("right", right, 1)):
        stands = ids != 0
        for d in range(1, AROUND + 1):
            x = padded[AROUND + sign * d : AROUND + sign * d + n]
            stands = stands & (x != 0) & ((x < ids) if side == "left" else (x <= ids))
            out.append(np.where(stands, x, 0))
    some = (left[0] != 0) | (right[0] != 0)
    return np.flatnonzero(some), [x[some] for x in left], [x[some] for x in right]


def _packed(ids: np.ndarray, salts_of: np.ndarray, buckets: int) -> Iterator[tuple[int, int, bytes]]:
    """(bucket, fragments, packed) of ``ids``, equal fragments counted. ``salts_of``: groups of each word's pivot."""
    some, left, right = _rewritten(ids)
    if not len(some):
        return
    pivot, salts = ids[some], salts_of[some]
    order, begins = _runs([*left, *right], pivot)
    times = np.diff(np.append(begins, len(order)))
    order = order[begins]
    context = np.stack([x[order] for x in [*left, *right]], axis=1)
    pivot, salts = pivot[order], salts[order]
    mix = _mixed([context[:, 0], context[:, AROUND], context[:, 1], context[:, AROUND + 1]])
    bucket = (_mixed([pivot, mix % salts.astype(np.uint64)]) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")  # pivots stay in order
    cuts = np.append(np.flatnonzero(np.append(True, np.diff(bucket[order]) != 0)), len(order))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        at = order[a:b]
        part = context[at]
        sizes = ((part[:, :AROUND] != 0).sum(1) * 8 + (part[:, AROUND:] != 0).sum(1)).astype(np.uint8)
        words = np.concatenate([part[:, k][part[:, k] != 0] for k in range(2 * AROUND)])
        fields = [np.diff(pivot[at], prepend=0), salts[at] > 1, times[at], sizes, words]
        yield int(bucket[at[0]]), len(at), zlib.compress(b"".join(_narrow(x) for x in fields), 1)


def _narrow(values: np.ndarray) -> bytes:
    """Whole numbers in as few bytes as the largest needs, byte by byte (the high bytes of all, then the next)."""
    width = next(w for w in (1, 2, 4, 8) if int(values.max(initial=0)) < 1 << (8 * w))
    planes = values.astype(f">u{width}").view(np.uint8).reshape(-1, width).T
    return bytes([width]) + len(values).to_bytes(8, "little") + np.ascontiguousarray(planes).tobytes()


def _fields(data: bytes) -> list[np.ndarray]:
    """What :func:`_narrow` packed, one after the other."""
    at, fields = 0, []
    while at < len(data):
        width, n = data[at], int.from_bytes(data[at + 1 : at + 9], "little")
        planes = np.frombuffer(data, np.uint8, width * n, at + 9).reshape(width, n)
        fields.append(np.ascontiguousarray(planes.T).view(f">u{width}").reshape(-1).astype(np.int64))
        at += 9 + width * n
    return fields


def _unpacked(packed: bytes) -> list[np.ndarray]:
    """pivot, split, times, left and right contexts."""
    gaps, split, times, sizes, words = _fields(zlib.decompress(packed))
    stands = np.concatenate([np.arange(AROUND) < (sizes // 8)[:, None], np.arange(AROUND) < (sizes % 8)[:, None]], axis=1)
    context = np.zeros((2 * AROUND, len(sizes)), np.int64)
    context[stands.T] = words  # row by row: all nearest left neighbours first
    return [np.cumsum(gaps), split.astype(bool), times, context[:AROUND].T, context[AROUND:].T]


_FRAGMENTS = pa.schema([("lang", pa.string()), ("bucket", pa.int64()), ("n", pa.int32()), ("packed", pa.binary())])


def fragments(blocks: DataFrame, placed: DataFrame, buckets: int) -> DataFrame:
    """The rewritten fragments of every bucket of pivots (a language's own), many in a row."""
    salts = F.least(F.ceil(F.col("f") / GROUP), F.lit(1 << 22)).cast("long")
    known = F.shiftleft(salts, 40).bitwiseOR(F.col("id"))  # both in one number, so that lists are short
    return _fragments(blocks, placed.select("block", F.array("place").alias("place"), F.array(known).alias("known")), buckets)


def _fragments(blocks: DataFrame, lists: DataFrame, buckets: int) -> DataFrame:
    ids = lists.groupBy("block").agg(F.flatten(F.collect_list("place")).alias("places"), F.flatten(F.collect_list("known")).alias("known"))
    joined = blocks.select("block", "lang", "codes").join(ids, "block").select("lang", "codes", "places", "known")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, list[np.ndarray]] = {}
        total = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, parts in waiting.items():
                known = np.concatenate(parts)
                for bucket, n, packed in _packed(known & ((1 << 40) - 1), known >> 40, buckets):
                    yield pa.RecordBatch.from_pylist([{"lang": lang, "bucket": bucket, "n": n, "packed": packed}], _FRAGMENTS)
            waiting.clear()

        for batch in batches:
            for i in range(batch.num_rows):
                lang, codes = (batch.column(k)[i].as_py() for k in range(2))
                places, known = (batch.column(k)[i].values.to_numpy() for k in (2, 3))
                (words,) = _fields(zlib.decompress(codes))
                of = np.zeros(int(words.max(initial=0)) + 1, np.int64)  # words without a number are ends of pieces here
                of[places + 1] = known
                waiting.setdefault(lang, []).append(of[words])
                total += len(words)
                if total >= CHUNK:
                    yield from flush()
                    total = 0
        yield from flush()

    return joined.mapInArrow(run, "lang string, bucket long, n int, packed binary")


def _mined(pivot: np.ndarray, times: np.ndarray, left: np.ndarray, right: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(phrases as rows of ids, counts) for every phrase that holds its row's pivot; shorter phrases come first, and those
    that don't reach ``least`` aren't made longer."""
    fits = {(i, j): np.ones(len(pivot), bool) for i, j in ((0, 0),)}
    for n in range(2, LONGEST + 1):
        kinds = [(i, n - 1 - i) for i in range(n)]
        rows, shape = [], []
        for i, j in kinds:
            ok = np.ones(len(pivot), bool)
            if i:
                ok &= (left[:, i - 1] != 0) & fits[i - 1, j]
            if j:
                ok &= (right[:, j - 1] != 0) & fits[i, j - 1]
            at = np.flatnonzero(ok)
            rows.append(at)
            shape.append(np.concatenate([left[at, :i][:, ::-1], pivot[at, None], right[at, :j]], axis=1))
        at, grams = np.concatenate(rows), np.concatenate(shape)
        if not len(at):
            return
        order, begins = _runs([grams[:, k] for k in range(n)])
        sums = np.add.reduceat(times[at[order]], begins)
        yield grams[order[begins]], sums
        good = np.repeat(sums >= least, np.diff(np.append(begins, len(order))))
        enough = np.zeros(len(at), bool)
        enough[order] = good
        begin = 0
        for kind, taken in zip(kinds, rows, strict=True):
            mask = np.zeros(len(pivot), bool)
            mask[taken] = enough[begin : begin + len(taken)]
            fits[kind] = mask
            begin += len(taken)


def mine(fragment_rows: DataFrame, least: int) -> DataFrame:
    """Rows (lang, gram, n, f) of all phrases of 2 to 5 words that occur ``least`` times; gram: 8 bytes for each word's id."""
    dealt = fragment_rows.repartition("lang", "bucket").sortWithinPartitions("lang", "bucket")
    schema = pa.schema([("lang", pa.string()), ("gram", pa.binary()), ("n", pa.int32()), ("f", pa.int64())])

    def mined(lang: str, rows: list[bytes]) -> Iterator[pa.RecordBatch]:
        pivot, split, *rest = (np.concatenate(x) for x in zip(*map(_unpacked, rows), strict=True))
        for part, most in ((split, 1), (~split, least)):
            if part.any():
                times, left, right = (x[part] for x in rest)
                for grams, f in _mined(pivot[part], times, left, right, most):
                    kept = f >= most
                    grams, f = grams[kept].astype(">u8"), f[kept]
                    for k in range(0, len(f), 1 << 16):
                        here = grams[k : k + (1 << 16)]
                        cells = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * here.shape[1]), len(here), [None, pa.py_buffer(here.tobytes())]).cast(pa.binary())
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(here), pa.string()), cells, pa.array(np.full(len(here), here.shape[1], np.int32)), pa.array(f[k : k + (1 << 16)])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for batch in batches:
            for lang, bucket, packed in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if (lang, bucket) != key:
                    if rows:
                        yield from mined(key[0], rows)
                    key, rows = (lang, bucket), []
                rows.append(packed)
        if rows:
            yield from mined(key[0], rows)

    found = dealt.select("lang", "bucket", "packed").mapInArrow(run, "lang string, gram binary, n int, f long")
    return found.groupBy("lang", "gram", "n").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def _words_of(gram: Column, first: Column | int, count: Column) -> Column:
    """``count`` words of a gram from the ``first`` (0: the first) on."""
    return F.substring(gram, (8 * first + 1) if isinstance(first, Column) else F.lit(8 * first + 1), 8 * count)


def score(grams: DataFrame, numbered: DataFrame, totals: DataFrame) -> DataFrame:
    """Rows (lang, gram, n_words, a, l, r, n, score) of the phrases that no longer phrase of the same count holds.

    The cut of the lowest score counts, the earliest of equal ones. A longer phrase of the same count need only be sought
    among those of one word more: between a phrase and a longer one of its count all phrases have that count.
    """
    one = numbered.select("lang", F.unhex(F.lpad(F.hex("id"), 16, "0")).alias("gram"), "f")
    counts = one.union(grams.where(F.col("n") < LONGEST).select("lang", "gram", "f"))
    cuts = grams.select("lang", "gram", F.col("n").alias("n_words"), F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("k"))
    cuts = cuts.withColumns({"left": _words_of(F.col("gram"), 0, F.col("k")), "rest": _words_of(F.col("gram"), F.col("k"), F.col("n_words") - F.col("k"))})
    cuts = cuts.join(counts.select(F.col("gram").alias("left"), F.col("f").alias("l")), "left")
    cuts = cuts.join(counts.select(F.col("gram").alias("rest"), F.col("f").alias("r")), "rest")
    cuts = written(cuts.join(totals, "lang"), "cuts")
    exact = "(1000BD * CAST(a AS DECIMAL(19,0)) * CAST(n AS DECIMAL(19,0))) div (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0)))"
    best = cuts.groupBy("lang", "gram", "n_words", "a", "n").agg(F.min(F.struct(F.expr(exact).alias("score"), "k", "l", "r")).alias("cut"))
    held = cuts.where((F.col("k") == F.col("n_words") - 1) & (F.col("l") == F.col("a"))).select(F.col("left").alias("gram"))
    held = held.union(cuts.where((F.col("k") == 1) & (F.col("r") == F.col("a"))).select("rest")).where(F.length("gram") > 8).distinct()
    return best.join(held, "gram", "left_anti").select("lang", "gram", "n_words", "a", "cut.l", "cut.r", "n", "cut.score")


def collocations(docs: DataFrame, least: int = 100, first: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The ``first`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    ``least`` is the count that a phrase must reach; n is the number of all words of the language.
    """
    blocks = written(encode_blocks(docs, text_col, lang_col), "blocks")
    listed = list_words(blocks, least)
    numbered = written(_numbered(listed), "numbers")
    totals = blocks.groupBy("lang").agg(F.sum(F.expr("aggregate(counts, 0L, (s, x) -> s + x)")).alias("n"))
    n_words = totals.agg(F.sum("n")).first()[0] or 0
    grams = written(mine(_fragments(blocks, _lists_of_blocks(listed), max(1, n_words // BUCKET)), least), "grams")
    scored = score(grams, numbered, totals)
    # first in each of 16 parts of a language, so that the last window gets a bounded number of rows (but for ties)
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("gram"), F.lit(16))).orderBy(F.desc("score"), F.desc("a"))
    near = scored.withColumn("_place", F.rank().over(part)).where(F.col("_place") <= first).drop("_place")
    each = near.select("gram", F.posexplode(F.sequence(F.lit(0), F.col("n_words") - 1)).alias("i", "_"))
    each = each.select("gram", "i", F.conv(F.hex(_words_of(F.col("gram"), F.col("i"), F.lit(1))), 16, 10).cast("long").alias("id"))
    phrases = each.join(numbered.select("id", "word"), "id").groupBy("gram").agg(F.array_join(F.expr("transform(array_sort(collect_list(struct(i, word))), x -> x.word)"), " ").alias("phrase"))
    named = near.join(phrases, "gram")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = named.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= first)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
