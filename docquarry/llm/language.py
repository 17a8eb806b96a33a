"""Language identification by prediction by partial matching.

For each language a byte context tree is learnt: counts of the byte that follows each context of 4, 3, 2, 1 and 0
bytes. A byte is coded in the longest context that was seen. If it wasn't seen there, that costs the context's escape
(method C: as many escapes as different followers), the followers are excluded, and it is looked for one byte shorter;
at the bottom all bytes that are left are equally likely. All 256 bytes have their own contexts, whatever the number of
languages; only what occurs is stored (sorted windows of up to five bytes, exact in 64 bits). The statistics are frozen
after learning. The language of the shortest code wins. Capital A-Z count as small letters.

Followers of a context also follow its shorter contexts, so what is excluded after an escape is a sum that can be stored
with the escaped context: code lengths with full exclusion come from one lookup for each order. A worker keeps the code
lengths of windows that it has met in a table of bounded size (``CACHE_BYTES``); that table only saves time.

Learning uses a bounded sample: about ``sample_bytes`` of whole texts in all, shared evenly by the languages (but
``LEAST_SAMPLE`` for each, so with very many languages that much for each), chosen in the order of a hash of the id.
Texts larger than a language's share are not learnt from, unless it has no others: then the beginning of its shortest is.
So every language with a text is learnt, and none is left out.

Defined results: null text or text without a letter gives ``und`` and score 0; with no language learnt too; ties go to
the language first in order; repeated rows get equal results; an empty table gives no rows; ``identify`` ignores other
columns and ``keep_identified`` hands them through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ORDER = 4
LEAST_SAMPLE, CACHE_BYTES, CHUNK = 16_384, 24_000_000, 1 << 19
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
U = np.uint64


def held_out(id_col: str = "doc_id"):
    """Column: the id is in the part that is never learnt from."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def _windows(x: np.ndarray, size: int) -> np.ndarray:
    """The numbers that each run of ``size`` bytes spells, most significant byte first."""
    n = max(0, len(x) - size + 1)
    code = np.zeros(n, np.uint64)
    for i in range(size):
        code = code << U(8) | x[i : i + n].astype(np.uint64)
    return code


def _mask(size: int) -> np.uint64:
    return U((1 << 8 * size) - 1)


class _Tree:
    """One language's contexts. For each order: seen windows with counts, and contexts with their number of occurrences,
    of different followers, and of occurrences of those followers in the next shorter context."""

    def __init__(self, x: np.ndarray):
        self.windows, self.counts, self.contexts, self.total, self.kinds, self.below = [], [], [], [], [], []
        for order in range(ORDER + 1):
            window, count = np.unique(_windows(x, order + 1), return_counts=True)
            context, first = np.unique(window >> U(8), return_index=True)
            ends = np.r_[first, len(window)]
            sums = np.r_[0, np.cumsum(count)]
            shorter = np.zeros(len(window), np.int64)
            if order:
                shorter = self.counts[order - 1][np.searchsorted(self.windows[order - 1], window & _mask(order))].astype(np.int64)
            under = np.r_[0, np.cumsum(shorter)]
            self.windows.append(window)
            self.counts.append(count.astype(np.uint32))
            self.contexts.append(context)
            self.total.append((sums[ends[1:]] - sums[ends[:-1]]).astype(np.uint32))
            self.kinds.append(np.diff(ends).astype(np.uint16))
            self.below.append((under[ends[1:]] - under[ends[:-1]]).astype(np.uint32))

    def bits(self, window: np.ndarray) -> np.ndarray:
        """Code lengths of the last byte of each window of ORDER + 1 bytes."""
        out = np.zeros(len(window))
        open_ = np.arange(len(window))
        gone, gone_kinds = np.zeros(len(window)), np.zeros(len(window))  # excluded occurrences and bytes, of the open ones
        for order in range(ORDER, -1, -1):
            if not len(self.windows[order]) or not len(open_):
                continue
            w = window[open_] & _mask(order + 1)
            context = w >> U(8)
            at = np.minimum(np.searchsorted(self.contexts[order], context), len(self.contexts[order]) - 1)
            seen = self.contexts[order][at] == context
            total, kinds = self.total[order][at] - gone, self.kinds[order][at] - gone_kinds
            escapes = np.where(self.kinds[order][at] < 256, kinds, 0)
            spot = np.minimum(np.searchsorted(self.windows[order], w), len(self.windows[order]) - 1)
            here = self.windows[order][spot] == w
            with np.errstate(divide="ignore", invalid="ignore"):
                coded = np.log2((total + escapes) / self.counts[order][spot])
                escaped = np.where(seen & (kinds > 0), np.log2((total + escapes) / escapes), 0)
            out[open_] += np.where(here, coded, escaped)
            left = ~here
            gone, gone_kinds = (np.where(seen, v[order][at], 0).astype(float)[left] for v in (self.below, self.kinds))
            open_ = open_[left]
        out[open_] += np.log2(np.maximum(256 - gone_kinds, 1))
        return out


class PartialMatching:
    """Frozen trees of all languages, by name."""

    def __init__(self, trees: dict[str, _Tree]):
        self.languages = sorted(trees)
        self.trees = [trees[k] for k in self.languages]
        self._keys = self._table = None

    @classmethod
    def learn(cls, texts: dict[str, list[bytes]]) -> PartialMatching:
        return cls({k: _Tree(_FOLD[np.frombuffer(b"\n" * ORDER + (b"\n" * ORDER).join(v), np.uint8)]) for k, v in texts.items()})

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_keys": None, "_table": None}

    def _costs(self, window: np.ndarray) -> np.ndarray:
        """[window, language]: code lengths, remembered by window."""
        if self._keys is None:
            slots = 1 << max(8, (CACHE_BYTES // (8 + 4 * len(self.trees))).bit_length() - 1)
            self._shift = U(65 - slots.bit_length())
            self._keys, self._table = np.full(slots, 1 << 63, np.uint64), np.zeros((slots, len(self.trees)), np.float32)
        place = lambda w: ((w * U(0x9E3779B97F4A7C15)) >> self._shift).astype(np.int64)
        slot = place(window)
        out = self._table[slot]
        miss = np.flatnonzero(self._keys[slot] != window)
        if len(miss):
            new, back = np.unique(window[miss], return_inverse=True)
            costs = np.empty((len(new), len(self.trees)), np.float32)
            for j, tree in enumerate(self.trees):
                costs[:, j] = tree.bits(new)
            out[miss] = costs[back]
            spot, one = np.unique(place(new), return_index=True)
            self._keys[spot], self._table[spot] = new[one], costs[one]
        return out

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """[text, language]: code lengths. Long texts are read in chunks that overlap by a context."""
        out = np.zeros((len(texts), max(1, len(self.languages))))
        if not self.languages:
            return out
        most = max(4096, min(CHUNK, 8 * CHUNK // len(self.languages)))
        group: list[tuple[int, bytes]] = []  # pieces with their contexts, and the texts that they belong to
        size = 0
        for i, t in enumerate(texts):
            whole = b"\n" * ORDER + t
            for k in range(0, len(t), most):
                piece = whole[k : k + most + ORDER]
                if group and size + len(piece) > most:
                    self._add(out, group)
                    group, size = [], 0
                group.append((i, piece))
                size += len(piece)
        if group:
            self._add(out, group)
        return out

    def _add(self, out: np.ndarray, group: list[tuple[int, bytes]]) -> None:
        costs = self._costs(_windows(_FOLD[np.frombuffer(b"".join(p for _, p in group), np.uint8)], ORDER + 1))
        at = 0
        for i, p in group:  # windows that reach from one piece into the next are left out
            out[i] += costs[at : at + len(p) - ORDER].sum(0, dtype=np.float64)
            at += len(p)


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text) if not text.isascii() else any("a" <= c <= "z" for c in text.lower())


def learn_from(docs: DataFrame, sample_bytes: int = 4_000_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> PartialMatching:
    """Learn from documents with a language that are not held out: at most about ``sample_bytes`` of whole texts."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.coalesce(~held_out(id_col), F.lit(False)))
    known = known.select(F.col(lang_col).alias("l"), F.col(text_col).alias("t"), F.octet_length(text_col).alias("size"), F.xxhash64(F.col(id_col)).alias("hash"))
    languages = sorted(r["l"] for r in known.select("l").distinct().collect())
    if not languages:
        return PartialMatching({})
    share = max(LEAST_SAMPLE, sample_bytes // len(languages))
    eligible = known.where(F.col("size") <= share)
    sizes = {r["l"]: r["bytes"] for r in eligible.groupBy("l").agg(F.sum("size").alias("bytes")).collect()}
    texts: dict[str, list[bytes]] = {k: [] for k in languages}
    if sizes:
        # about twice the share, of which the first in hash order are taken
        at_most = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, 2 * share / max(1, n)))])
        place = F.pmod(F.col("hash"), F.lit(1 << 40)) / F.lit(float(1 << 40))
        room = dict.fromkeys(languages, share)
        for r in sorted(eligible.where(place < at_most[F.col("l")]).select("l", "t", place.alias("place")).collect(), key=lambda r: (r["place"], r["t"])):
            text = r["t"].encode()
            if len(text) <= room[r["l"]]:
                room[r["l"]] -= len(text)
                texts[r["l"]].append(text)
    missing = [k for k, v in texts.items() if not any(v)]
    if missing:
        # what chance or the length of all its texts left out: one text, the first in hash order that fits or else the shortest
        order = F.struct(F.col("size") == 0, F.col("size") > share, F.when(F.col("size") > share, F.col("size")), F.col("hash"))
        first = known.where(F.col("l").isin(missing)).withColumn("t", F.substring("t", 1, share)).groupBy("l").agg(F.min_by("t", order).alias("t"))
        for r in first.collect():
            texts[r["l"]] = [r["t"].encode()[:share]]
    return PartialMatching.learn({k: sorted(v) for k, v in texts.items()})


def _predict(m: PartialMatching, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """The winner's share of 2^-bits is the score, one bit counting as 1/8 so that very short texts aren't sure."""
    usable = [bool(m.languages) and t is not None and has_letter(t) for t in texts]
    bits = m.bits([t.encode() if u else b"" for t, u in zip(texts, usable)])
    langs = [m.languages[b.argmin()] if u else "und" for b, u in zip(bits, usable)]
    scores = [float(1 / np.exp2((b.min() - b) / 8).sum()) if u else 0.0 for b, u in zip(bits, usable)]
    return langs, scores


def identify(docs: DataFrame, model: PartialMatching, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, lang_pred and score (0 to 1) of every row; only the text is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                langs, scores = _predict(shared.value, part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[id_col, "lang_pred", "score"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: PartialMatching, least_score: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, in a learnt language with at least ``least_score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                langs, scores = _predict(shared.value, part.column(at).to_pylist())
                yield part.filter(pa.array([x != "und" and s >= least_score for x, s in zip(langs, scores)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
