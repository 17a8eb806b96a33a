"""How filters overlap: which rows each removes in every order, which alone, and its fair share of all removals.

The words of every text are exploded, counted by (document, word) and then by document for totals and distinct words.
A document is one row, so both aggregations happen where the row lies, in Arrow tables of a few megabytes; no word is
shuffled. Flags from the text's characters come along, copies are found by the SHA-256 of the text, and labels are
outer-joined. One aggregation with a conditional count for each set of failed filters (32 for five filters, and again for
good and for toxic rows) holds all that the orders need: 120 orders and 5 steps are then worked out for each part from
its one row.

Nulls: a null text is empty, a null part is the empty string, a null id has no label and is neither a copy of another row
nor an original of one. Rows that repeat an id count one by one; none of them is a copy of another with the same id.
Repeated labels of an id count as one: it is good (toxic) if any of them says so. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text that are exploded to words at a time (a longer text is taken alone).
SLICE = 8 << 20
SYMBOLS = np.frombuffer(b"#$%&*|", np.uint8)


def _word_counts(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and distinct words of each text; ``data`` holds the texts, with a blank behind each, from ``starts`` on."""
    inside = (data != 32) & ((data < 9) | (data > 13))
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    at = np.flatnonzero(first)
    letters = data[inside]
    offsets = np.append((np.cumsum(inside)[at] - 1), len(letters)).astype("<i8")
    words = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
    exploded = pa.table({"doc": np.searchsorted(starts, at, "right") - 1, "word": words.dictionary_encode().indices})
    by_word = exploded.group_by(["doc", "word"], use_threads=False).aggregate([([], "count_all")])
    by_doc = by_word.group_by("doc", use_threads=False).aggregate([("count_all", "sum"), ("count_all", "count")])
    total, distinct = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
    total[by_doc["doc"].to_numpy()], distinct[by_doc["doc"].to_numpy()] = by_doc["count_all_sum"].to_numpy(), by_doc["count_all_count"].to_numpy()
    return total, distinct


def _slices(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    begin = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > SLICE:
            yield begin, i
            begin, size = i, 0
        size += len(t) + 1
    if begin < len(texts):
        yield begin, len(texts)


def text_statistics(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id", "lang")) -> DataFrame:
    """The columns ``keep`` of every row with n_words, n_distinct, n_chars, n_upper, has_symbol and digest of its text."""
    kept = [docs.schema[c] for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column(0).cast(pa.binary()).to_pylist()]
            for begin, end in _slices(texts):
                part = texts[begin:end]
                sizes = np.array([len(t) + 1 for t in part], np.int64)
                starts = np.cumsum(sizes) - sizes
                data = np.frombuffer(b" ".join(part) + b" ", np.uint8)
                total, distinct = _word_counts(data, starts)
                chars = np.add.reduceat(((data & 0xC0) != 0x80).astype(np.int64), starts) - 1
                upper = np.add.reduceat(((data >= 65) & (data <= 90)).astype(np.int64), starts)
                symbol = np.logical_or.reduceat(np.isin(data, SYMBOLS), starts)
                digests = pa.array([hashlib.sha256(t).digest() for t in part], pa.binary())
                columns = [batch.column(k + 1).slice(begin, end - begin) for k in range(len(keep))]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(total), pa.array(distinct), pa.array(chars), pa.array(upper), pa.array(symbol), digests],
                    names=[*keep, "n_words", "n_distinct", "n_chars", "n_upper", "has_symbol", "digest"],
                )

    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["n_words long, n_distinct long, n_chars long, n_upper long, has_symbol boolean, digest binary"]
    return docs.select(text_col, *keep).mapInArrow(run, ", ".join(schema))


def failures(stats: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``stats`` with the five flags A to E: short, repetitive, upper case, symbols, copy of a text with a smaller id."""
    first = stats.groupBy("digest").agg(F.min(id_col).alias("_first"))
    joined = stats.join(first, "digest")
    return joined.select(
        *[c for c in stats.columns if c != "digest"],
        (F.col("n_words") < 200).alias("A"),
        (100 * F.col("n_distinct") < 50 * F.col("n_words")).alias("B"),
        (100 * F.col("n_upper") > 3 * F.col("n_chars")).alias("C"),
        F.col("has_symbol").alias("D"),
        F.coalesce(F.col(id_col) > F.col("_first"), F.lit(False)).alias("E"),
    )


def with_labels(flags: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``flags`` with good and toxic of the label of the id, false where there is none."""
    marks = labels.groupBy(id_col).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    joined = flags.drop("good", "toxic").join(marks, id_col, "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})


def audit(flags: DataFrame, filters: str = "ABCDE", part_col: str = "lang") -> DataFrame:
    """For every part, order of the filters and step: what the step's filter does there.

    ``flags`` has a boolean column of each letter of ``filters`` (failing; null: passing), good and toxic. Columns: part,
    filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.
    """
    k = len(filters)
    sets = range(1 << k)
    failed = sum((F.when(F.col(f), 1 << i).otherwise(0) for i, f in enumerate(filters)), F.lit(0))
    rows = flags.select(F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), failed.alias("_failed"), "good", "toxic")
    kinds = {"_n": F.lit(True), "_good": F.col("good"), "_toxic": F.col("toxic")}
    counts = rows.groupBy("part").agg(*[F.count_if((F.col("_failed") == m) & c).alias(f"{name}{m}") for name, c in kinds.items() for m in sets])
    wide = counts.select("part", *[F.array(*[f"{name}{m}" for m in sets]).alias(name) for name in kinds])

    orders = F.array(*[F.lit("".join(o)) for o in itertools.permutations(filters)])
    steps = wide.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(k))))

    def bits(letters: Column) -> Column:
        return sum((F.when(F.contains(letters, F.lit(f)), 1 << i).otherwise(0) for i, f in enumerate(filters)), F.lit(0))

    steps = steps.withColumn("_own", bits(F.expr("substring(filter_order, step, 1)"))).withColumn("_before", bits(F.expr("left(filter_order, step - 1)")))
    each = steps.select("part", "filter_order", "step", "_own", "_before", F.posexplode(F.arrays_zip(*kinds)).alias("_set", "_count"))
    fails, earlier = F.col("_set").bitwiseAND(F.col("_own")) != 0, F.col("_set").bitwiseAND(F.col("_before")) != 0
    shares = F.element_at(F.array(*[F.lit(math.factorial(k) // max(1, m.bit_count())) for m in sets]), F.col("_set") + 1)

    def total(which: Column, count: Column) -> Column:
        return F.sum(F.when(which, count).otherwise(0)).cast("long")

    n, good, toxic = (F.col(f"_count.{name}") for name in kinds)
    return each.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~earlier, n).alias("kept"),
        total(fails & ~earlier, n).alias("removed"),
        total(fails & earlier, n).alias("redundant"),
        total(F.col("_set") == F.col("_own"), n).alias("unique_fails"),
        total(fails & ~earlier, good).alias("good_lost"),
        total(fails & ~earlier, toxic).alias("toxic_lost"),
        total(fails, n * shares).alias("shapley"),
    )


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """:func:`audit` of the five text filters over ``docs`` (doc_id, text, lang), by lang."""
    return audit(with_labels(failures(text_statistics(docs)), labels))
