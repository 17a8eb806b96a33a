"""Byte-level BPE encoding and decoding with a contiguous rank array.

A piece's parts lie in one short array, and beside it the ranks of all adjacent pairs. The least rank is looked for by
a scan, its boundary is deleted and the two neighbouring ranks are refreshed, until no pair has a rank. Pieces of over
``LONG`` bytes use a heap over linked parts with the same order of merges, so their time isn't quadratic. Merges never
cross pieces; each distinct piece is merged once while a worker remembers it (see ``tokens``).

Defined results: null text is the empty text, with no ids and an empty decoded text; special tokens in a text are one
id each; bytes that don't form characters decode to U+FFFD; repeated rows give equal results; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import tokens

LONG = 256
NO_RANK = 1 << 60


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in a vocabulary file: printable Latin-1 as it is, the rest
    from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class BytePairs:
    """Vocabulary and merges of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        vocab = data["model"]["vocab"]
        chars = byte_characters()
        byte_of = {c: b for b, c in enumerate(chars)}
        self.byte_id = [vocab[c] for c in chars]
        self.rank: dict[int, int] = {}
        self.result: list[int] = []
        for r, pair in enumerate(data["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank.setdefault(vocab[a] << 32 | vocab[b], r)
            self.result.append(vocab[a + b])
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.bytes_of: list[bytes] = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        names = sorted(self.special, key=len, reverse=True)
        self._special = regex.compile("|".join(map(regex.escape, names))) if names else None
        self._pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

    def merge(self, piece: bytes) -> list[int]:
        """ids of one piece."""
        parts = [self.byte_id[b] for b in piece]
        if len(parts) > LONG:
            return self._merge_long(parts)
        get = self.rank.get
        ranks = [get(a << 32 | b, NO_RANK) for a, b in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == NO_RANK:
                break
            i = ranks.index(least)
            parts[i] = self.result[least]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(parts[i - 1] << 32 | parts[i], NO_RANK)
            if i < len(ranks):
                ranks[i] = get(parts[i] << 32 | parts[i + 1], NO_RANK)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        n = len(parts)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := self.rank.get(parts[i] << 32 | parts[i + 1])) is not None]
        heapq.heapify(heap)
        gone = [False] * n
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j < 0 or parts[i] != a or parts[j] != b:
                continue
            parts[i], gone[j], after[i] = self.result[r], True, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x in (before[i], i):
                if x >= 0 and (y := after[x]) >= 0 and (s := self.rank.get(parts[x] << 32 | parts[y])) is not None:
                    heapq.heappush(heap, (s, x, parts[x], parts[y]))
        return [p for p, g in zip(parts, gone) if not g]

    def encode_text(self, text: str) -> list[int]:
        """ids of a text, special tokens and contractions included."""
        out, at = [], 0
        for m in self._special.finditer(text) if self._special else ():
            for piece in self._pieces.findall(text[at : m.start()]):
                out += self.merge(piece.encode())
            out.append(self.special[m.group()])
            at = m.end()
        for piece in self._pieces.findall(text[at:]):
            out += self.merge(piece.encode())
        return out

    def encoder(self) -> tokens.Encoder:
        def plain(t: str) -> bool:
            return not ("'" in t and tokens._CONTRACTION.search(t) or self._special and self._special.search(t))

        return tokens.Encoder(tokens.spaced_pieces, lambda pieces: [self.merge(p.encode()) for p in pieces], self.encode_text, lambda t: t, plain)

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_OPENED: dict[str, tuple[BytePairs, tokens.Encoder]] = {}


def opened(path: str) -> tuple[BytePairs, tokens.Encoder]:
    """The worker's tables of a file; they stay for the next task."""
    if path not in _OPENED:
        pairs = BytePairs(path)
        _OPENED[path] = pairs, pairs.encoder()
    return _OPENED[path]


def _kind(docs: DataFrame, col: str) -> str:
    return docs.schema[col].dataType.simpleString()


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ids (array<int>) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, encoder = opened(path)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                ids = encoder.encode(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.astype("int32") for x in ids], pa.list_(pa.int32()))], names=[id_col, "ids"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {_kind(docs, id_col)}, ids array<int>")


def decode_documents(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col`` and the text of every row's ids; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, _ = opened(path)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                texts = [pairs.decode(x or []) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {_kind(encoded, id_col)}, text string")


def round_trip_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_tokens and the SHA-256 of the ids (decimal, joined by commas) and of the text decoded from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, encoder = opened(path)
        digits = [str(i) for i in range(len(pairs.bytes_of))]
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                lists = [x.tolist() for x in encoder.encode(part.column(1).to_pylist())]
                shown = [hashlib.sha256(",".join(map(digits.__getitem__, x)).encode()).hexdigest() for x in lists]
                texts = [hashlib.sha256(pairs.decode(x).encode()).hexdigest() for x in lists]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(map(len, lists), pa.int64()), pa.array(shown, pa.string()), pa.array(texts, pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
                )

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {_kind(docs, id_col)}, n_tokens long, ids_sha256 string, decoded_sha256 string")
