"""Self-join of documents by the Jaccard similarity of their word n-grams, with PartEnum signatures.

Sets of about equal size, similar to at least p/q, differ in at most k = r(q-p)/p elements, where r is the smaller size.
Sizes are cut into bands; a set has signatures for its own band and for the bands below that may hold partners. In a
band, a hash deals the domain to n1 partitions, each of n2 cells. Of more than k/(k2+1) partitions some differ in at
most k2 elements, so there some n2-k2 cells agree: each partition gives a signature for every n2-k2 of its cells, and
any two similar sets share one. Signatures of empty cells alone are left out: there are m more partitions than needed,
and a set in which more than m partitions have only empty choices has the signatures of further hash functions too,
in the end one that all such sets share. So no link is lost.

Words up to seven bytes are told apart by their bytes, longer ones by 128-bit BLAKE2b digests; a shingle is known by 128 bits
made from its words', and a set by the 128-bit digest of its sorted shingles. Equal sets are one class from the
start, and a class, not a document id, is what is linked. Signatures, links and components know a class by the first 64
bits alone: different sets that agree in those get one component. Classes that share a signature are compared with the least of
them; exact links come from the words of the whole texts. Where a signature's classes are then still in different
components, they are compared among each other, in tiles of about TILE classes dealt by a hash, first by size and by parity
bits (whose number of differences never exceeds that of the sets; about as many bits as the set has shingles), then by words. Of a
tile's pairs that may be similar only as many go on as bring its classes together (a spanning forest). Where words refute some of
them, more forests of the pairs that are left follow (FORESTS times as many in each round), until none is refuted. Components need no more than that.
``link_pairs`` and ``count_links`` compare all classes that share a signature, also those already in one component, so
they have every link.

Defined results: words are lower-cased in A-Z only and separated by blank, tab, line ends, vertical tab and form feed;
with fewer than n words the whole sequence is one shingle; null, empty or blank texts have none and are linked with
nothing, not even each other; a null id has no component and is linked with nothing (``keep_one_of_each`` compares such rows
too); rows that repeat an id are judged each by its text; an empty table gives no rows; other columns are ignored, and
``keep_one_of_each`` hands them through, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import IdFilter, small_batches, written
from .components import connected_components
from .tokens import SHORT, _mix, distinct, short_keys

CHUNK, TILE, SEEDS, HELD, REMEMBERED = 150_000, 512, 4, 30_000, 50_000
#: The least and the most parity bits of a set; too few of them rule nothing out, and then whole texts are shuffled for each pair.
PARITY, PARITY_MOST = 512, 1 << 15
#: Bits of a signature that are shuffled. Where two agree by chance, their sets are compared in vain; no link is lost.
SIG_BITS = 40
#: By what the number of a tile's forests grows from round to round.
FORESTS = 8
#: Rows that a worker gets at a time: a row may hold two whole texts.
ROWS = 100
U = np.uint64
SEPARATORS = (32, 9, 10, 11, 12, 13)
_SPACE = np.zeros(256, bool)
_SPACE[list(SEPARATORS)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Digests of words, remembered by a worker.
_DIGESTS: dict[bytes, bytes] = {}


def words(text: str) -> list[bytes]:
    """The words of a text, as bytes."""
    return text.encode().translate(bytes(_LOWER.tolist())).split()


def shingle_set(text: str, n: int) -> frozenset:
    w = words(text)
    if len(w) < n:
        return frozenset([tuple(w)] if w else [])
    return frozenset(zip(*(w[i:] for i in range(n))))


def _identities(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """[2, word]: 128 bits of each word data[start:stop]; up to seven bytes are mixed one to one, longer ones digested."""
    raw, length = data.tobytes(), stops - starts
    short = short_keys(raw, starts, length)
    out = np.stack([_mix(short ^ U(0xA0761D6478BD642F)), _mix(short ^ U(0xE7037ED1A0B428DB))])
    long = np.flatnonzero(length > SHORT)
    if len(long):
        where, back = distinct(raw, starts[long], stops[long])
        if len(_DIGESTS) > REMEMBERED:
            _DIGESTS.clear()
        found = [raw[a:b] for a, b in zip(starts[long][where].tolist(), stops[long][where].tolist())]
        for word in found:
            if word not in _DIGESTS:
                _DIGESTS[word] = hashlib.blake2b(word, digest_size=16).digest()
        out[:, long] = np.frombuffer(b"".join(map(_DIGESTS.__getitem__, found)), np.uint64).reshape(-1, 2).T[:, back]
    return out


def shingles(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingles of each text, text by text: their two 64-bit values, sorted, and their numbers."""
    data = _LOWER[np.frombuffer(b"\n".join([*texts, b""]), np.uint8)]
    first = np.cumsum([0, *[len(t) + 1 for t in texts]])[:-1]
    edge = np.flatnonzero(np.diff(np.r_[True, _SPACE[data]].astype(np.int8)))
    starts, stops = edge[::2], edge[1::2]
    word = _identities(data, starts, stops)
    of = np.searchsorted(first, starts, "right") - 1
    each = np.bincount(of, minlength=len(texts))
    whole = np.flatnonzero(of[n - 1 :] == of[: len(of) - n + 1]) if len(of) >= n else np.zeros(0, np.int64)
    spelt = lambda at, size: [_run(word, at, size, side) for side in (0, 1)]
    value, more = spelt(whole, n)
    owner = of[whole]
    few = np.flatnonzero((each > 0) & (each < n))
    if len(few):
        begin = np.cumsum(each) - each
        short = [spelt(begin[d : d + 1], each[d]) for d in few]
        value, more, owner = np.r_[value, [x[0][0] for x in short]].astype(np.uint64), np.r_[more, [x[1][0] for x in short]].astype(np.uint64), np.r_[owner, few]
    order = np.lexsort((value, owner))
    if ((value[order][1:] == value[order][:-1]) & (more[order][1:] != more[order][:-1])).any():
        order = np.lexsort((more, value, owner))
    value, more, owner = value[order], more[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (more[1:] != more[:-1]) | (owner[1:] != owner[:-1])
    return value[new], more[new], np.bincount(owner[new], minlength=len(texts))


def _run(word: np.ndarray, at: np.ndarray, size: int, side: int) -> np.ndarray:
    """64 bits of ``size`` words from each place on: the one side mixed word by word, the other summed up."""
    value = np.full(len(at), size, np.uint64)
    for i in range(size):
        value = value + word[side, at + i] * U(2 * i + 3)
        value = value if side else _mix(value)
    return value


def set_keys(value: np.ndarray, more: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of each set's 128-bit key."""
    ends = np.r_[0, np.cumsum(count)].tolist()
    both = np.stack([value, more], 1)
    keys = [hashlib.blake2b(both[a:b].tobytes(), digest_size=16).digest() for a, b in zip(ends, ends[1:])]
    return tuple(np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2).T)


def parities(value: np.ndarray, count: np.ndarray) -> list[bytes]:
    """Each set's parity bits: how many of its shingles, modulo 2, have each remainder by a power of two not below its size."""
    bits = np.clip(2 ** np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64), PARITY, PARITY_MOST)
    ends = np.cumsum(bits)
    place = np.repeat(ends - bits, count) + (value & np.repeat(bits - 1, count).astype(np.uint64)).astype(np.int64)
    packed = np.packbits((np.bincount(place, minlength=int(bits.sum())) & 1).astype(np.uint8)).tobytes()
    return [packed[a:b] for a, b in zip(((ends - bits) // 8).tolist(), (ends // 8).tolist())]


def _folded(cells: list[bytes], size: int) -> np.ndarray:
    """Parity bits as rows of ``size`` bytes: a longer row's remainders by the lower power are the sums of its parts."""
    lengths = np.array([len(x) for x in cells])
    out = np.empty((len(cells), size), np.uint8)
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        whole = np.frombuffer(b"".join([cells[i] for i in at]), np.uint8).reshape(len(at), -1, size)
        out[at] = np.bitwise_xor.reduce(whole, axis=1)
    return out


class Bands:
    """Size bands and each band's partitions for a similarity of at least p / q."""

    def __init__(self, p: int, q: int):
        self.p, self.q = p, q
        ratio, self.low, at = max(1.2, (q / p) ** 1.6), [], 1
        while at < 1 << 31:
            self.low.append(at)
            at = max(at + 1, int(at * ratio))
        self.low.append(at)
        self.low = np.array(self.low)
        self.plan = [self._plan(int(a), int(b)) for a, b in zip(self.low, self.low[1:])]

    def of(self, size: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, size, "right") - 1

    def _plan(self, low: int, high: int) -> tuple[int, int, int, int, int]:
        """k, n1, k2, n2, m"""
        k = (high - 1) * (self.q - self.p) // self.p
        if k <= 3:
            return k, 1, k, k + 3, 0
        # the most partitions, each one cell: a third fewer signatures than by two cells of three, and each of about as many elements
        k2, n2 = (2, 5) if k <= 11 else (0, 1)
        m, base = 0, k // (k2 + 1) + 1
        while True:
            n1 = base + m
            full = 1 - math.exp(-low / n1 / n2)
            weak = n1 * sum(math.comb(n2, i) * full**i * (1 - full) ** (n2 - i) for i in range(k2 + 1))
            need = math.ceil(weak + 4 * math.sqrt(weak))
            if m >= min(need, base // 2):
                return k, n1, k2, n2, m
            m = min(need, base // 2)


@lru_cache
def bands(p: int, q: int) -> Bands:
    return Bands(p, q)


def signatures(value: np.ndarray, count: np.ndarray, at: Bands) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of all sets, and the number of the set that each belongs to."""
    own = at.of(np.maximum(count, 1))
    least = at.of(np.maximum((count * at.p + at.q - 1) // at.q, 1))
    begin = np.cumsum(count) - count
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for down in range(int((own - least).max(initial=0)) + 1):
        band = own - down
        some = np.flatnonzero((count > 0) & (band >= least))
        some = some[[at.plan[b][0] > 0 for b in band[some]]] if len(some) else some
        for seed in range(SEEDS):
            if not len(some):
                break
            some = some[_one_round(value, count, begin, some, band[some], seed, at, out)]
        if len(some):  # all that every hash leaves with too many empty choices
            out.append((_mix(band[some].astype(np.uint64) + U(0x5BD1E995)), some))
    if not out:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate([s for s, _ in out]), np.concatenate([d for _, d in out])


def _one_round(value, count, begin, some, band, seed, at, out) -> np.ndarray:
    """Appends the signatures of sets ``some`` under one hash function; which of them have too many empty choices."""
    plan = np.array([at.plan[b] for b in band])
    n1, k2, n2, m = plan[:, 1], plan[:, 2], plan[:, 3], plan[:, 4]
    n = count[some]
    local = np.repeat(np.arange(len(some)), n)
    e = value[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[some], n)]
    dealt = _mix(e + U(0x9E3779B97F4A7C15 * (seed + 1) % (1 << 64)))
    p1 = ((dealt >> U(32)) % n1[local].astype(np.uint64)).astype(np.int64)
    p2 = ((dealt & U(0xFFFFFFFF)) % n2[local].astype(np.uint64)).astype(np.int64)
    base = np.cumsum(n1 * n2) - n1 * n2
    cell = base[local] + p1 * n2[local] + p2
    order = np.argsort(cell, kind="stable")
    sums = np.r_[U(0), np.cumsum(_mix(e ^ U(0x2545F4914F6CDD1D))[order], dtype=np.uint64)]
    filled = np.bincount(cell, minlength=int((n1 * n2).sum()))
    ends = np.r_[0, np.cumsum(filled)]
    content = sums[ends[1:]] - sums[ends[:-1]]
    weak = np.zeros(len(some), np.int64)
    for kind in set(zip(k2.tolist(), n2.tolist())):
        a, b = kind
        sets = np.flatnonzero((k2 == a) & (n2 == b))
        parts = n1[sets]
        owner = np.repeat(sets, parts)
        number = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        cells = (base[owner] + number * b)[:, None] + np.arange(b)
        inside, have = content[cells], filled[cells] > 0
        weak += np.bincount(owner[have.sum(1) <= a], minlength=len(some))
        tag = _mix(band[owner].astype(np.uint64) * U(1 << 34) + number.astype(np.uint64) * U(64) + U(seed))
        for c, chosen in enumerate(combinations(range(b), b - a)):
            sig = tag + U((c + 1) * 0xC2B2AE3D27D4EB4F % (1 << 64))
            for x in chosen:
                sig = _mix(sig + inside[:, x] * U(2 * x + 1))
            keep = have[:, list(chosen)].any(1)
            out.append((sig[keep], some[owner[keep]]))
    return weak > m


def _grouped(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about CHUNK bytes: the first's number and the texts."""
    at, group, size = 0, [], 0
    for i, t in enumerate(texts):
        b = (t or "").encode()
        if group and size + len(b) > CHUNK:
            yield at, group
            at, group, size = i, [], 0
        group.append(b)
        size += len(b)
    if group:
        yield at, group


def _describe(docs: DataFrame, n: int) -> DataFrame:
    """id, n_shingles, key, key2, parity of every row of (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, group in _grouped(batch.column(1).to_pylist()):
                value, more, count = shingles(group, n)
                key, key2 = set_keys(value, more, count)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(group)), pa.array(count, pa.int64()), pa.array(key), pa.array(key2), pa.array(parities(value, count), pa.binary())],
                    names=["id", "n_shingles", "key", "key2", "parity"],
                )

    return docs.mapInArrow(run, "id long, n_shingles long, key long, key2 long, parity binary")


def _signature_rows(docs: DataFrame, n: int, p: int, q: int) -> DataFrame:
    """key, sig: a row for each signature of each row of (id, text); the bytes that a signature leaves empty come last, where
    the shuffle's compression takes them together with the next row's head."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = bands(p, q)
        for batch in batches:
            for _, group in _grouped(batch.column(1).to_pylist()):
                value, more, count = shingles(group, n)
                sig, owner = signatures(value, count, at)
                sig = (sig >> U(64 - SIG_BITS)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(set_keys(value, more, count)[0][owner]), pa.array(sig)], names=["key", "sig"])

    return docs.mapInArrow(run, "key long, sig long")


def _keyed(docs: DataFrame, n: int) -> DataFrame:
    """(id, key, text) of rows (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, group in _grouped(batch.column(1).to_pylist()):
                part = batch.slice(at, len(group))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(set_keys(*shingles(group, n))[0]), part.column(1)], names=["id", "key", "text"])

    return docs.mapInArrow(run, "id long, key long, text string")


def _verified(pairs: DataFrame, docs: DataFrame, n: int, p: int, q: int) -> DataFrame:
    """Those of the pairs (a, b, a_key, b_key) whose sets of whole words are similar enough."""
    pairs = pairs.select("a", "b", "a_key", "b_key")
    wanted = pairs.select(F.col("a").alias("id"), F.col("a_key").alias("key")).union(pairs.select("b", "b_key")).distinct()
    wanted = written(wanted, "wanted")
    # only texts that may be wanted are shuffled; an id may be repeated with other texts, so the set tells which is meant
    some = IdFilter(wanted.select("id")).marked(docs, "id").where("_maybe").drop("_maybe")
    texts = _keyed(some, n).join(wanted, ["id", "key"], "left_semi").dropDuplicates(["id", "key"])
    left = pairs.join(texts.select(F.col("id").alias("a"), F.col("key").alias("a_key"), F.col("text").alias("a_text")), ["a", "a_key"])
    both = left.join(texts.select(F.col("id").alias("b"), F.col("key").alias("b_key"), F.col("text").alias("b_text")), ["b", "b_key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[tuple[int, int], frozenset] = {}
        room = HELD

        def held(key: tuple[int, int], text: str) -> frozenset:
            nonlocal room
            if key not in sets:
                found = shingle_set(text, n)
                if len(found) > room:
                    sets.clear()
                    room = HELD
                room -= len(found)
                sets[key] = found
            return sets[key]

        for batch in batches:
            ids = zip(*(batch.column(i).to_pylist() for i in range(4)))
            keep = []
            for i, (a, b, a_key, b_key) in enumerate(ids):
                text, other = batch.column(4)[i].as_py(), batch.column(5)[i].as_py()  # one pair at a time, since texts may be long
                x, y = held((a, a_key), text), held((b, b_key), other)
                common = len(x & y)
                keep.append(q * common >= p * (len(x) + len(y) - common))
            yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1, 2, 3])

    return both.select("a", "b", "a_key", "b_key", "a_text", "b_text").mapInArrow(run, "a long, b long, a_key long, b_key long").distinct()


def _close(a_n, b_n, differ, p: int, q: int):
    """Whether sets of these sizes with at least ``differ`` differences can be similar enough: numbers, arrays or columns."""
    return (q * (a_n + b_n - differ) >= p * (a_n + b_n + differ)) & (q * a_n >= p * b_n) & (q * b_n >= p * a_n)


def _maybe_similar(pairs: DataFrame, classes: DataFrame, p: int, q: int) -> DataFrame:
    """(a_key, b_key) with the classes of both, without those that sizes or parities rule out."""
    side = lambda s: classes.select(F.col("key").alias(f"{s}_key"), F.col("rep").alias(s), F.col("n_shingles").alias(f"{s}_n"), F.col("parity").alias(f"{s}_parity"))
    both = pairs.join(side("a"), "a_key").join(side("b"), "b_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (batch.column(i).to_pylist() for i in (6, 7))
                a_n, b_n = (batch.column(i).to_numpy() for i in (4, 5))
                sizes = np.array([min(len(a), len(b)) for a, b in zip(x, y)])
                differ = np.zeros(len(sizes), np.int64)
                for size in np.unique(sizes).tolist():
                    at = np.flatnonzero(sizes == size)
                    differ[at] = np.bitwise_count(_folded([x[i] for i in at], size) ^ _folded([y[i] for i in at], size)).sum(1, dtype=np.int64)
                keep = _close(a_n, b_n, differ, p, q)
                yield batch.filter(pa.array(keep)).select([0, 1, 2, 3])

    columns = both.where("a_key <> b_key").select("a", "b", "a_key", "b_key", "a_n", "b_n", "a_parity", "b_parity")
    return columns.mapInArrow(run, "a long, b long, a_key long, b_key long")


def _forests(pairs: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, forests: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of the pairs (i, j), those of each i together, so many spanning forests, no pair twice; what has one label is one node."""
    for _ in range(forests):
        if not pairs:
            return
        group, later = np.unique(label, return_inverse=True)[1], []
        for i, j in pairs:
            met, first = np.unique(group[j], return_index=True)
            first = first[met != group[i[0]]]
            if len(first):
                yield i[first], j[first]
                group[np.isin(group, met)] = group[i[0]]
                i, j = np.delete(i, first), np.delete(j, first)
            if len(j):
                later.append((i, j))
        pairs = later


def _tile_pairs(tiles: DataFrame, p: int, q: int, forests: int | None) -> DataFrame:
    """Pairs (sig, a, b, a_key, b_key) in different components that sizes and parities don't rule out, tile by tile.

    tiles: sig, t1, t2, t, rep, key, label, n_shingles, parity, refuted (keys with which a class isn't linked), sorted by the
    first three; a tile has about 2 * TILE rows at most. forests: all pairs, if None, else so many spanning forests of them,
    with no pair twice and none that is refuted: fewer pairs than rows for each forest.
    """

    def pairs(rows: pa.RecordBatch) -> pa.RecordBatch | None:
        sig, t1, t2, t, rep, key, label, n = (rows.column(i).to_numpy() for i in range(8))
        cells = rows.column(8).to_pylist()
        parity = _folded(cells, min(map(len, cells))).view(np.uint64)
        left, right = (np.flatnonzero(t == t1), np.flatnonzero(t == t2))
        taken = np.zeros((len(key), len(key)) if forests else 0, bool)
        if forests:
            for i in np.flatnonzero(rows.column(9).value_lengths().to_numpy()):
                j = np.isin(key, rows.column(9)[int(i)].values.to_numpy())
                taken[i, j] = taken[j, i] = True
        found = []
        for i in left:
            j = right[right > i] if t1[0] == t2[0] else right
            j = j[(label[j] != label[i]) & (key[j] != key[i]) & _close(n[i], n[j], 0, p, q)]
            j = j[~taken[i, j]] if forests else j
            if len(j):
                differ = np.bitwise_count(parity[j] ^ parity[i]).sum(1, dtype=np.int64)
                j = j[_close(n[i], n[j], differ, p, q)]
            if len(j):
                found.append((np.full(len(j), i), j))
        found = list(_forests(found, label, forests)) if forests else found
        if not found:
            return None
        i, j = (np.concatenate(x) for x in zip(*found))
        swap = (rep[i] > rep[j]) | (rep[i] == rep[j]) & (key[i] > key[j])
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (sig[i], rep[i], rep[j], key[i], key[j])], names=["sig", "a", "b", "a_key", "b_key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def joined() -> pa.RecordBatch:
            return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

        for batch in batches:
            if not batch.num_rows:
                continue
            head = [batch.column(i).to_numpy() for i in range(3)]
            cuts = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in head])) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
                if held and any(held[0].column(i)[0].as_py() != batch.column(i)[int(a)].as_py() for i in range(3)):
                    if (got := pairs(joined())) is not None:
                        yield got
                    held = []
                held.append(batch.slice(a, b - a))
        if held and (got := pairs(joined())) is not None:
            yield got

    return tiles.mapInArrow(run, "sig long, a long, b long, a_key long, b_key long")


def link_documents(docs: DataFrame, n: int = 5, p: int = 80, q: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_shingles and component_id (the least id reached by links) of every row."""
    with small_batches(docs.sparkSession, ROWS):
        return _link_documents(docs, n, p, q, id_col, text_col)


def _sets_and_members(rows: DataFrame, n: int, p: int, q: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The sets of (id, text), the classes of equal sets, and the classes (sig, pivot, key) of every signature of two or more."""
    described = written(_describe(rows, n), "sets")
    known = described.where("id IS NOT NULL AND n_shingles > 0")
    classes = known.groupBy("key", "key2", "n_shingles").agg(F.min("id").alias("rep"), F.min("parity").alias("parity"), F.count("*").alias("rows"))
    classes = written(classes, "classes")
    dealt = _signature_rows(rows.where("id IS NOT NULL"), n, p, q).repartition("sig")
    ends = dealt.groupBy("sig").agg(F.min("key").alias("pivot"), F.max("key").alias("most")).where("pivot < most").select("sig", "pivot")
    return described, classes, written(dealt.join(ends, "sig").select("sig", "pivot", "key").distinct(), "members")


def _stars(members: DataFrame, classes: DataFrame, p: int, q: int) -> DataFrame:
    """The pairs of a signature's least class and its others that may be similar."""
    stars = members.where("key <> pivot").select(F.col("pivot").alias("a_key"), F.col("key").alias("b_key")).distinct()
    return _maybe_similar(stars, classes, p, q)


def _pairs_within(members: DataFrame, named: DataFrame, p: int, q: int, forests: int | None = None, refuted: DataFrame | None = None) -> DataFrame:
    """The pairs (sig, a, b, a_key, b_key) of one signature's classes (key, rep, n_shingles, parity, label) with different labels that may be similar.

    With ``forests`` no more than that many spanning forests of a tile's pairs, without those of ``refuted`` (a_key, b_key).
    Signatures of two classes are left to ``_stars``. Many signatures hold the same classes: those are looked at once. They
    are recognized by the sums of eight 32-bit parts of the classes' SHA-256 digests, taken in the same pass as their labels. Tiles
    are dealt by a hash of the class, so no task has to number the classes of a signature.
    """
    digest = F.sha2(F.col("key").cast("string"), 256)
    parts = [F.sum(F.conv(F.substring("_digest", 8 * i + 1, 8), 16, 10).cast("long")).alias(f"_sum{i}") for i in range(8)]
    labelled = members.join(named.select("key", "label"), "key").withColumn("_digest", digest)
    groups = labelled.groupBy("sig").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("size"), *parts)
    apart = groups.where("low < high AND size > 2").groupBy("size", *[f"_sum{i}" for i in range(8)]).agg(F.min("sig").alias("sig"))
    inside = members.join(apart.select("sig", "size"), "sig").join(named, "key")
    none = F.array().cast("array<long>")
    if refuted is None:
        inside = inside.withColumn("refuted", none)
    else:
        lists = refuted.groupBy(F.col("a_key").alias("key")).agg(F.collect_set("b_key").alias("refuted"))
        inside = inside.join(lists, "key", "left").withColumn("refuted", F.coalesce("refuted", none))
    tiles = F.expr(f"CAST((size - 1) DIV {TILE} + 1 AS INT)")
    tiled = inside.withColumn("t", F.pmod(F.xxhash64("key"), tiles).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), tiles - 1)))
    there = F.filter("refuted", lambda x: F.pmod(F.xxhash64(x), tiles) == F.col("o")).alias("refuted")
    tiled = tiled.select("sig", F.least("t", "o").alias("t1"), F.greatest("t", "o").alias("t2"), "t", "rep", "key", "label", "n_shingles", "parity", there)
    tiled = tiled.repartition("sig", "t1", "t2").sortWithinPartitions("sig", "t1", "t2")
    return _tile_pairs(tiled, p, q, forests)


def _components(links: DataFrame) -> DataFrame:
    """key, label: of every linked class the least class of its component."""
    return connected_components(links.select(F.col("a_key").alias("a"), F.col("b_key").alias("b"))).withColumnRenamed("node", "key")


def _linked(rows: DataFrame, n: int, p: int, q: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The sets and classes of rows (id, text), and the labels of linked classes."""
    described, classes, members = _sets_and_members(rows, n, p, q)
    texts, pair = rows.where("id IS NOT NULL"), ["a", "b", "a_key", "b_key"]
    links = written(_verified(written(_stars(members, classes, p, q), "stars"), texts, n, p, q), "first-links")
    labels = _components(links)

    # signatures whose classes the pivots have not brought together; each round links classes or refutes pairs. Rounds are small
    # where the table is: the fewer jobs and shuffles each has, the less of their threads and plans the driver holds at once
    refuted, forests = None, 1
    while True:
        named = classes.join(labels, "key", "left").select("key", "rep", "n_shingles", "parity", F.coalesce("label", "key").alias("label"))
        tried = written(_pairs_within(members, named, p, q, forests, refuted), "tile-pairs")
        if tried.isEmpty():
            break
        found = written(_verified(tried, texts, n, p, q), "more-links")
        if not found.isEmpty():
            links = links.union(found)
            labels = _components(links)
        wrong = written(tried.join(found, pair, "left_anti"), "refuted-pairs")
        if wrong.isEmpty():  # all that a tile might link is linked
            break
        # pairs that are left have ends in the components of refuted ones of their signature
        label = F.coalesce("label", "key").alias("label")
        ends = wrong.select("sig", F.col("a_key").alias("key")).union(wrong.select("sig", "b_key"))
        open_ends = ends.join(labels, "key", "left").select("sig", label)
        members = members.join(labels, "key", "left").select("sig", "pivot", "key", label).join(open_ends, ["sig", "label"], "left_semi")
        members = written(members.drop("label"), "members")
        more = wrong.select("a_key", "b_key")
        refuted = more if refuted is None else refuted.union(more)
        forests *= FORESTS
    return described, classes, labels


def _link_documents(docs: DataFrame, n: int, p: int, q: int, id_col: str, text_col: str) -> DataFrame:
    return _with_components(*_linked(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), n, p, q), id_col)


def _with_components(described: DataFrame, classes: DataFrame, labels: DataFrame, id_col: str, *more: str) -> DataFrame:
    of = classes.select("key", "rep").join(labels, "key")
    least = of.join(of.groupBy("label").agg(F.min("rep").alias("least")), "label").select("key", "least").distinct()
    class_label = classes.join(least, "key", "left").select("key", "key2", "n_shingles", F.coalesce("least", "rep").alias("least"), *more)
    out = described.join(class_label, ["key", "key2", "n_shingles"], "left")
    linked = F.when(F.col("n_shingles") > 0, F.col("least"))
    known = [F.when(F.col("id").isNotNull() & (F.col("n_shingles") > 0), F.col(c)).alias(c) for c in more]
    return out.select(F.col("id").alias(id_col), "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce(linked, F.col("id"))).alias("component_id"), *known)


def _all_links(rows: DataFrame, n: int, p: int, q: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The sets, their classes, and every link (a, b, a_key, b_key) of two classes, once."""
    described, classes, members = _sets_and_members(rows, n, p, q)
    # each class has a label of its own, so none is spared the comparison
    named = classes.select("key", "rep", "n_shingles", "parity", F.col("key").alias("label"))
    turned = F.expr("a > b OR a = b AND a_key > b_key")
    side = lambda x, y: F.when(turned, F.col(y)).otherwise(F.col(x)).alias(x)
    stars = _stars(members, classes, p, q).select(side("a", "b"), side("b", "a"), side("a_key", "b_key"), side("b_key", "a_key"))
    maybe = written(stars.union(_pairs_within(members, named, p, q).drop("sig")).distinct(), "maybe-links")
    return described, classes, written(_verified(maybe, rows.where("id IS NOT NULL"), n, p, q), "links")


def link_pairs(docs: DataFrame, n: int = 5, p: int = 80, q: int = 100, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Every link: the linked pairs of classes (a, a_key, b, b_key), each once, and the members of the classes.

    Members are all rows: ``id_col``, n_shingles, class_id, class_key, class_rows. A class holds the rows of one set and is
    told by its least id and its key (an id that is repeated with other texts may be the least of more than one). Rows
    without a class (null id, no words) have nulls there. Rows of one class are linked among themselves.
    """
    with small_batches(docs.sparkSession, ROWS):
        described, classes, links = _all_links(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), n, p, q)
    of = classes.select("key", "key2", "n_shingles", F.col("rep").alias("class_id"), F.col("key").alias("class_key"), F.col("rows").alias("class_rows"))
    known = F.col("id").isNotNull() & (F.col("n_shingles") > 0)
    shown = [F.when(known, F.col(c)).alias(c) for c in ("class_id", "class_key", "class_rows")]
    return links.select("a", "a_key", "b", "b_key"), described.join(of, ["key", "key2", "n_shingles"], "left").select(F.col("id").alias(id_col), "n_shingles", *shown)


def count_links(docs: DataFrame, n: int = 5, p: int = 80, q: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of ``link_documents`` and n_links: how many other rows each row is linked with itself, not over others."""
    with small_batches(docs.sparkSession, ROWS):
        described, classes, links = _all_links(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), n, p, q)
        labels = _components(links)
        ends = links.select(F.col("a_key").alias("key"), F.col("b_key").alias("other")).union(links.select("b_key", "a_key"))
        beside = ends.join(classes.select(F.col("key").alias("other"), "rows"), "other").groupBy("key").agg(F.sum("rows").alias("beside"))
        counted = classes.join(beside, "key", "left").withColumn("n_links", F.col("rows") - 1 + F.coalesce("beside", F.lit(0)))
        return _with_components(described, written(counted, "counted"), labels, id_col, "n_links").withColumn("n_links", F.coalesce("n_links", F.lit(0)))


def keep_one_of_each(docs: DataFrame, n: int = 5, p: int = 80, q: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each component of linked texts one row of ``docs``, with all columns: that of the least id (null ids last).

    Texts are judged each by itself, also where rows repeat an id. Texts without words all stay.
    """
    # null ids stand behind all others here; what a row is, its id and its set tell together
    number = F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1))
    with small_batches(docs.sparkSession, ROWS):
        described, classes, labels = _linked(docs.select(number.alias("id"), F.col(text_col).alias("text")), n, p, q)
        rows = described.where("n_shingles > 0").groupBy("id", "key").agg(F.count("*").alias("rows"))
        rows = rows.join(labels, "key", "left").select("id", "key", "rows", F.coalesce("label", "key").alias("label"))
        first = rows.groupBy("label").agg(F.min(F.struct("id", "key")).alias("first"))
        judged = rows.join(first, "label").select("id", "key", "rows", (F.struct("id", "key") != F.col("first")).alias("goes"))
        special = written(judged.where("goes OR rows > 1").select("id", "key", "goes"), "special")
        # rows that may go or are repeated are the few that need a shuffle; all others pass as they are
        marked = IdFilter(special.select("id")).marked(docs.select(F.struct("*").alias("row"), number.alias("id")), "id")
        few = _with_keys(marked.where("_maybe").select("id", "row"), n, docs.schema.fieldNames().index(text_col))
        met = few.join(special, ["id", "key"], "left")
        again = met.where("NOT goes").dropDuplicates(["id", "key"])
        kept = met.where("goes IS NULL").select("row.*").union(again.select("row.*"))
        return marked.where("NOT _maybe").select("row.*").union(kept)


def _with_keys(rows: DataFrame, n: int, text_at: int) -> DataFrame:
    """Rows (id, row) with the key of the set of the text, which is the row's field ``text_at``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, group in _grouped(batch.column(1).field(text_at).to_pylist()):
                part = batch.slice(at, len(group))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(set_keys(*shingles(group, n))[0])], names=["id", "row", "key"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("key", T.LongType())]))
