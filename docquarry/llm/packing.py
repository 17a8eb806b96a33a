"""Harmonic packing of token ids into sequences of a fixed capacity.

A document's ids, with its end id, are cut into slices of the capacity and a rest. The rest is cut where lengths of the
form ``capacity // j`` allow, so a piece of class j all but fills a j-th of a sequence. A sequence of class j holds
exactly j pieces of that class, so its pieces' places follow from their numbers: every worker numbers its own pieces of
each class, and sums of the workers' counts give the places everywhere. Only the last, partly filled sequence of each
class (at most one for each class) is then put together with others by first fit.

Defined results: null text is the empty text, one end id; repeated rows are packed one by one; an empty table gives no
rows; a null id is kept as null; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .common import written

CAPACITY, MOST_CUTS = 1024, 3


def cut_rest(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(length, class) of the pieces of a rest shorter than the capacity."""
    out = []
    while length:
        j = capacity // length
        slot = capacity // j
        if slot - length <= slot // 64 or len(out) == MOST_CUTS:
            return [*out, (length, j)]
        j = -(-capacity // length)
        out.append((capacity // j, j))
        length -= capacity // j
    return out


def cut_documents(docs: DataFrame, path: str, end_id: int = 0, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: ``id_col``, start, length, ids (little-endian unsigned 32-bit), doc_tokens, and the class,
    worker and number that ``place_pieces`` needs."""
    rests = [cut_rest(n, capacity) for n in range(capacity)]
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder("byte", path)
        worker = TaskContext.get().partitionId()
        count = np.zeros(capacity + 1, np.int64).tolist()
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                rows: list[tuple] = []
                for i, x in enumerate(encoder.encode(part.column(1).to_pylist())):
                    x = np.append(x, np.uint32(end_id)).astype("<u4")
                    n = len(x)
                    data, at = x.tobytes(), 0
                    for size, j in [(capacity, 1)] * (n // capacity) + rests[n % capacity]:
                        rows.append((i, at, size, data[4 * at : 4 * (at + size)], n, j, count[j]))
                        count[j] += 1
                        at += size
                which, start, size, ids, n, j, nth = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(which)), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(ids, pa.binary()), pa.array(n, pa.int64()), pa.array(j, pa.int32()), pa.array([worker] * len(rows), pa.int32()), pa.array(nth, pa.int64())],
                    names=[id_col, "start", "length", "ids", "doc_tokens", "_class", "_worker", "_nth"],
                )

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, start long, length long, ids binary, doc_tokens long, _class int, _worker int, _nth long")


def _last_sequences(totals: list[tuple[int, int]], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """For (class, pieces): class, first sequence, pieces in full sequences, sequence of the others, place in it."""
    out, full = [], 0
    for j, n in totals:
        out.append([j, full, n - n % j])
        full += n // j
    bins: list[list[int]] = []  # room, groups in it
    placed = {}
    for j, n in sorted(totals, key=lambda x: -(x[1] % x[0]) * (capacity // x[0])):
        need = (n % j) * (capacity // j)
        if not need:
            placed[j] = (0, 0)
            continue
        at = next((i for i, b in enumerate(bins) if b[0] >= need), len(bins))
        if at == len(bins):
            bins.append([capacity, 0])
        placed[j] = (full + at, bins[at][1])
        bins[at][0] -= need
        bins[at][1] += 1
    return [(j, first, whole, *placed[j]) for j, first, whole in out]


def place_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with sequence_id and offset. ``pieces`` is written once, so the numbers in it are settled."""
    rows = written(pieces, "pieces")
    spark = rows.sparkSession
    counts = rows.groupBy("_class", "_worker").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("_class").orderBy("_worker").rowsBetween(Window.unboundedPreceding, -1)
    counts = written(counts.withColumn("_base", F.coalesce(F.sum("_n").over(earlier), F.lit(0))), "counts")
    totals = [(r[0], r[1]) for r in counts.groupBy("_class").agg(F.sum("_n")).orderBy("_class").collect()]  # at most `capacity` rows
    plan = spark.createDataFrame(_last_sequences(totals, capacity), "_class int, _first long, _whole long, _last long, _place int")
    rows = rows.join(counts.drop("_n"), ["_class", "_worker"]).join(F.broadcast(plan), "_class")
    number = F.col("_base") + F.col("_nth")
    rows = rows.withColumn("_number", number)
    in_full = F.col("_number") < F.col("_whole")
    rows = rows.withColumn("sequence_id", F.when(in_full, F.expr("_first + _number DIV _class")).otherwise(F.col("_last")))
    rows = rows.withColumn("_place", F.when(in_full, F.lit(0)).otherwise(F.col("_place")))
    before = Window.partitionBy("sequence_id").orderBy("_place", "_number").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
    return rows.select(*[c for c in pieces.columns if not c.startswith("_")], "sequence_id", "offset")


def pack_documents(docs: DataFrame, path: str, end_id: int = 0, capacity: int = CAPACITY, **columns: str) -> DataFrame:
    """Pieces with their ids and places: ``cut_documents`` and ``place_pieces``."""
    return place_pieces(cut_documents(docs, path, end_id, capacity, **columns), capacity)
