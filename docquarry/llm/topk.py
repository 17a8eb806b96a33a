"""Exact top-k search by inner product with a pivot table.

Vectors are turned into integers, floor(scale * x). From a bounded sample (``SAMPLE`` rows, the first by a hash of the id)
``PIVOTS`` pivots are chosen, each the row farthest from those before. Rows are dealt by their nearest pivot and packed into
blocks, and each block is written with its rows' distances to all pivots: that is the pivot table, computed beforehand. By
the triangle inequality |d(q, p) - d(x, p)| is a lower bound of d(q, x) for every pivot p; the greatest of them bounds the
inner product from above, since 2<q, x> = |q|^2 + |x|^2 - d(q, x)^2.

The k-th best score of a query in the sample is its threshold from the start. Blocks of queries meet ranges of the blocks'
distances first, and only where some query's bound for a whole block reaches its threshold is the block moved to the
queries. There a query's candidates are evaluated in the order of their bounds, in steps that double, until the next bound
is below the threshold or the k-th best score: then no candidate left can enter the result, so it is exact.
Sample and pivots only decide how much is evaluated. On vectors without structure little can be left out: of 2,000 random
unit vectors of 64 dimensions the bounds of 128 pivots leave about four fifths to be evaluated.

Defined results: a vector that is null, or holds a null, NaN or infinite component, takes no part, as query or
candidate; a null id takes no part; vectors of different lengths are compared as if the shorter ended in zeros; an empty
vector scores 0 with all; components too large for exact doubles are summed as Python integers, and a score beyond a
long becomes the nearest long; ties go to the smaller id; rows of the same id other than the query's count one by one;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, written

BLOCK, QUERY_BLOCK, PIVOTS, SAMPLE, STEP, SALTS, BOXES = 4096, 1024, 128, 2048, 256, 32, 1024
EXACT, LONG = 1 << 53, (1 << 63) - 1


def _matrix(lists: pa.Array, scale: int) -> np.ndarray:
    lengths = np.diff(lists.offsets.to_numpy())
    wide = int(lengths.max()) if len(lengths) else 0
    flat = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    out = np.zeros((len(lengths), wide))
    out[np.arange(wide) < lengths[:, None]] = np.floor(scale * flat)
    return out


def usable(vector: Column) -> Column:
    """No null and no component that is null, NaN or infinite."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return vector.isNotNull() & ~F.exists(vector, bad)


def _padded(m: np.ndarray, wide: int) -> np.ndarray:
    return np.pad(m, ((0, 0), (0, wide - m.shape[1])))


def _exact(wide: int, most: float) -> bool:
    """Inner products of integers up to ``most`` are exact as doubles."""
    return wide * max(1.0, most) ** 2 < EXACT / 4


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """[pivot, row] float32; components that only one side has count against zeros."""
    wide = max(x.shape[1], pivots.shape[1])
    x, p = _padded(x, wide), _padded(pivots, wide)
    with np.errstate(over="ignore", invalid="ignore"):
        square = (p * p).sum(1)[:, None] + (x * x).sum(1) - 2 * (p @ x.T)
        return np.sqrt(np.maximum(square, 0)).astype("<f4")


def choose_pivots(x: np.ndarray, most: int) -> np.ndarray:
    """Rows far from each other: each is the farthest from those before."""
    if not len(x):
        return x
    chosen, left = [0], distances(x, x[:1])[0]
    while len(chosen) < min(most, len(x)) and left.max() > 0:
        chosen.append(int(left.argmax()))
        left = np.minimum(left, distances(x, x[chosen[-1:]])[0])
    return x[chosen]


class Sample:
    """Rows to start from: pivots, and a threshold for each query."""

    def __init__(self, rows: list, scale: int, k: int):
        wide = max((len(v) for _, v in rows), default=0)
        x = np.zeros((len(rows), wide))
        for i, (_, v) in enumerate(rows):
            x[i, : len(v)] = np.floor(scale * np.array(v, float))
        small = wide * np.abs(x).max(1, initial=1) ** 2 < EXACT / 4
        self.ids, self.x, self.k = np.array([i for i, _ in rows], np.int64)[small], x[small], k
        self.pivots = choose_pivots(self.x, PIVOTS)

    def thresholds(self, ids: np.ndarray, q: np.ndarray) -> np.ndarray:
        wide = max(q.shape[1], self.x.shape[1])
        if len(self.x) <= self.k or not _exact(wide, max(np.abs(q).max(initial=0), np.abs(self.x).max(initial=0))):
            return np.full(len(q), -np.inf)
        scores = _padded(q, wide) @ _padded(self.x, wide).T
        scores[ids[:, None] == self.ids] = -np.inf
        return np.partition(scores, -self.k, axis=1)[:, -self.k]


BLOCK_COLUMNS = "part int, number int, ids binary, dims int, data binary, dist binary, low binary, high binary, longest double, most double, floors binary"


def _blocks(rows: DataFrame, scale: int, size: int, sample: Sample, seeded: bool, name: str) -> DataFrame:
    """Packed blocks of at most ``size`` vectors (id, v, cell) of one cell, with the pivot table; ``seeded``: with thresholds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        held: list[tuple[np.ndarray, np.ndarray]] = []
        have, cell = 0, None

        def block() -> pa.RecordBatch:
            nonlocal number, have
            wide = max(m.shape[1] for _, m in held)
            x, ids = np.concatenate([_padded(m, wide) for _, m in held]), np.concatenate([i for i, _ in held])
            dist = distances(x, sample.pivots)
            floors = sample.thresholds(ids, x) if seeded else np.empty(0)
            values = [part, number, ids.astype("<i8").tobytes(), wide, x.astype("<f8").tobytes(), dist.tobytes(), dist.min(1).tobytes(), dist.max(1).tobytes(), float((x * x).sum(1).max(initial=0)), float(np.abs(x).max(initial=0)), floors.astype("<f8").tobytes()]
            kinds = [pa.int32(), pa.int32(), pa.binary(), pa.int32(), *[pa.binary()] * 4, pa.float64(), pa.float64(), pa.binary()]
            number, have = number + 1, 0
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)], names=[c.split()[0] for c in BLOCK_COLUMNS.split(", ")])

        for batch in batches:
            cells = batch.column(2).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(cells[1:] != cells[:-1]) + 1 if not seeded else []
            for k, end in zip([0, *cuts], [*cuts, batch.num_rows]):
                if 4 * have >= size and not seeded and cells[k] != cell:  # small cells share a block
                    yield block()
                while k < end:
                    piece = batch.slice(k, min(size - have, end - k))
                    vectors = piece.column(1)
                    vectors = pa.ListArray.from_arrays(pa.array(vectors.offsets.to_numpy() - vectors.offsets[0].as_py(), pa.int32()), vectors.flatten())
                    held.append((piece.column(0).to_numpy(zero_copy_only=False).astype(np.int64), _matrix(vectors, scale)))
                    have, k, cell = have + piece.num_rows, k + piece.num_rows, cells[k]
                    if have == size:
                        yield block()
        if have:
            yield block()

    return written(rows.mapInArrow(run, BLOCK_COLUMNS), name)


def _with_cells(rows: DataFrame, scale: int, sample: Sample) -> DataFrame:
    """(id, v, cell): the nearest pivot of each row (id, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                vectors = batch.column(1)
                vectors = pa.ListArray.from_arrays(pa.array(vectors.offsets.to_numpy() - vectors.offsets[0].as_py(), pa.int32()), vectors.flatten())
                near = distances(_matrix(vectors, scale), sample.pivots).argmin(0) if len(sample.pivots) else np.zeros(batch.num_rows)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near.astype(np.int32))], names=["id", "v", "cell"])

    return rows.mapInArrow(run, f"id long, v {rows.schema['v'].dataType.simpleString()}, cell int")


def _reached(probes: DataFrame, candidates: DataFrame, pivots: int) -> DataFrame:
    """(q_at, at): the blocks of queries and of candidates of which some query's bound reaches its threshold."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, BOXES):
                rows = batch.slice(k, BOXES)
                yield pa.RecordBatch.from_arrays([pa.array([x.to_pylist()], pa.list_(x.type)) for x in rows.columns], names=rows.schema.names)

    kinds = {"part": "int", "number": "int", "dims": "int", "low": "binary", "high": "binary", "longest": "double", "most": "double"}
    boxes = candidates.select(*kinds).mapInArrow(chunks, ", ".join(f"{k} array<{v}>" for k, v in kinds.items()))
    boxes = boxes.select(*[F.col(k).alias(f"x_{k}") for k in kinds], F.pmod(F.xxhash64("part", "number"), F.lit(SALTS)).cast("int").alias("salt"))
    # blocks of queries are repeated for each salt, so one of them is held against the boxes by many tasks
    asked = probes.select("part", "number", "dims", "data", "dist", "floors", "most", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    pairs = asked.join(boxes, "salt").drop("salt").select("part", "number", "dims", "data", "dist", "floors", "most", *[f"x_{k}" for k in kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                part, number, dims, data, dist, floors, most, x_part, x_number, x_dims, low, high, longest, x_most = (batch.column(i)[r].as_py() for i in range(14))
                floors = np.frombuffer(floors, "<f8")
                d = np.frombuffer(dist, "<f4").reshape(pivots, -1)
                q2 = (np.frombuffer(data, "<f8").reshape(len(floors), dims) ** 2).sum(1)
                keep = []
                for i, (lo, hi) in enumerate(zip(low, high)):
                    lo, hi = np.frombuffer(lo, "<f4")[:, None], np.frombuffer(hi, "<f4")[:, None]
                    far = np.maximum(d - hi, lo - d).max(0, initial=0)
                    if not _exact(max(dims, x_dims[i]), max(most, x_most[i])) or (_bound(q2, longest[i], far) >= floors).any():
                        keep.append(i)
                at = [pa.array([{"part": x_part[i], "number": x_number[i]} for i in keep], pa.struct([("part", pa.int32()), ("number", pa.int32())]))]
                q_at = [pa.array([{"part": part, "number": number}] * len(keep), at[0].type)]
                yield pa.RecordBatch.from_arrays([*q_at, *at], names=["q_at", "at"])

    return pairs.mapInArrow(run, "q_at struct<part int, number int>, at struct<part int, number int>")


def _bound(q2, x2, far):
    """The most that an inner product can be; the margin covers the rounding of roots, squares and 32-bit distances."""
    return (q2 + x2 - far.astype(np.float64) ** 2) / 2 + 2e-6 * (q2 + x2) + 1


def search_block(qi: np.ndarray, q: np.ndarray, q_dist: np.ndarray, floors: np.ndarray, xi: np.ndarray, x: np.ndarray, x_dist: np.ndarray, k: int, seen: list | None = None) -> list[tuple[int, int, int]]:
    """(query id, id, score) of each query's k best in one block, if they reach its threshold, by pivot-table elimination.

    ``seen`` gets the number of candidates evaluated for each query.
    """
    wide = max(q.shape[1], x.shape[1])
    q, x = _padded(q, wide), _padded(x, wide)
    if not _exact(wide, max(np.abs(q).max(initial=1), np.abs(x).max(initial=1))):
        return _search_large(qi, q, xi, x, k)
    # integers below 2^53 are exact as doubles
    q2, x2 = (q * q).sum(1), (x * x).sum(1)
    out = []
    for i in range(len(q)):
        far = x_dist - q_dist[:, i : i + 1]
        far = np.abs(far, out=far).max(0, initial=0)
        bound = _bound(q2[i], x2, far)
        order = np.flatnonzero(bound >= floors[i])
        order = order[np.argsort(-bound[order], kind="stable")]
        best_ids, best, met = np.empty(0, np.int64), np.empty(0), 0
        at, step = 0, STEP
        while at < len(order) and not (len(best) == k and bound[order[at]] < best[-1]):
            some = order[at : at + step]
            at, step = at + step, 2 * step
            some = some[xi[some] != qi[i]]
            met += len(some)
            ids, scores = np.r_[best_ids, xi[some]], np.r_[best, x[some] @ q[i]]
            if len(scores) > k:  # ties of the k-th best stay for the order of ids
                high = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
                ids, scores = ids[high], scores[high]
            keep = np.lexsort((ids, -scores))[:k]
            best_ids, best = ids[keep], scores[keep]
        out += [(int(qi[i]), int(a), int(b)) for a, b in zip(best_ids, best)]
        if seen is not None:
            seen.append(met)
    return out


def _search_large(qi: np.ndarray, q: np.ndarray, xi: np.ndarray, x: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    rows = [[int(v) for v in r] for r in x.tolist()]
    out = []
    for i, a in zip(qi.tolist(), q.tolist()):
        a = [int(v) for v in a]
        scored = [(max(-LONG, min(LONG, sum(u * v for u, v in zip(a, r)))), j) for j, r in zip(xi.tolist(), rows) if j != i]
        out += [(i, j, s) for s, j in sorted(scored, key=lambda p: (-p[0], p[1]))[:k]]
    return out


def top_k(vectors: DataFrame, queries: Column, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), ``id_col`` and score of the ``k`` best rows for each row that fulfils ``queries``."""
    clean = vectors.where(F.col(id_col).isNotNull() & usable(F.col(vector_col)))
    rows = clean.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), queries.alias("is_query"))
    first = rows.select("id", "v").orderBy(F.xxhash64("id"), "id", "v").limit(SAMPLE).collect()
    sample = Sample([(r["id"], r["v"]) for r in first], scale, k)
    # an unusual length or a hot cell doesn't matter: ranges of (cell, id) are cut at equal numbers of rows
    celled = _with_cells(rows.select("id", "v"), scale, sample).repartitionByRange("cell", "id").sortWithinPartitions("cell")
    candidates = _blocks(celled, scale, BLOCK, sample, False, "candidates")
    # queries of many partitions come together first, or each partition would make a small block
    asked = _with_cells(rows.where("is_query").select("id", "v"), scale, sample)
    n = rows.where("is_query").count()
    probes = _blocks(asked.repartition(max(1, -(-n // (4 * QUERY_BLOCK))), "id").sortWithinPartitions("cell"), scale, QUERY_BLOCK, sample, True, "probes")
    spark = vectors.sparkSession
    with small_batches(spark, 8):  # a row holds a block
        met = written(_reached(probes, candidates, len(sample.pivots)), "reached")
    asked_blocks = probes.select(F.struct("part", "number").alias("q_at"), F.col("ids").alias("q_ids"), F.col("dims").alias("q_dims"), F.col("data").alias("q_data"), F.col("dist").alias("q_dist"), "floors")
    blocks = candidates.select(F.struct("part", "number").alias("at"), "ids", "dims", "data", "dist")
    pairs = met.join(blocks, "at").join(asked_blocks, "q_at").select("q_ids", "q_dims", "q_data", "q_dist", "floors", "ids", "dims", "data", "dist")
    pivots = len(sample.pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                a, b, c, qd, floors, d, e, f, xd = (batch.column(i)[r].as_py() for i in range(9))
                qi, xi = np.frombuffer(a, "<i8"), np.frombuffer(d, "<i8")
                q, x = np.frombuffer(c, "<f8").reshape(len(qi), b), np.frombuffer(f, "<f8").reshape(len(xi), e)
                found = search_block(qi, q, np.frombuffer(qd, "<f4").reshape(pivots, len(qi)), np.frombuffer(floors, "<f8"), xi, x, np.frombuffer(xd, "<f4").reshape(pivots, len(xi)), k)
                columns = zip(*found) if found else ([], [], [])
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in columns], names=["query_id", "id", "score"])

    with small_batches(spark, 8):
        partial = written(pairs.mapInArrow(run, "query_id long, id long, score long"), "found")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = partial.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")
