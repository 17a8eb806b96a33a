"""Token ids as binary files: one concatenated id array each, with Elias-Fano encoded document boundaries.

A file image is::

    magic "EFTK" | width u8 | low bits u8 | 2 bytes 0 | documents u64 | ids u64 | first id's number u64
    | low parts | high parts | select samples u32 | ids (little-endian, 2 or 4 bytes each)

The boundaries are the documents' ends. Each end's low bits lie in a packed array; its high bits set bit
``(end >> low) + i`` of a bit string of under 3 bits for each document. Every 64th set bit's place is kept, so the i-th end
is found by a scan of a few bytes: about 2 + log2(ids / documents) bits for each document in all.

Images are rows of a Parquet dataset in the shared folder (part, number, doc_ids, image), so any store that Spark writes to
will do, and each is bounded by ``image_ids`` ids and ``image_docs`` documents (a longer document is an image alone).

Defined results: null text is the empty text, one end id; null ids come first; equal ids are ordered by a hash of the
text, then by text (so one id may fill many ranges); repeated rows have a place each; an id of the vocabulary that doesn't fit
the width is an error; an empty table gives no files and no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .common import written

IMAGE_IDS, IMAGE_DOCS = 131_072, 1024
HEADER = struct.Struct("<4sBBxxQQQ")
SAMPLE = 64


class EliasFano:
    """A non-decreasing sequence of n numbers up to a bound."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @staticmethod
    def sizes(n: int, bound: int) -> tuple[int, int, int, int]:
        """Low bits of each number; bytes of low parts, high parts and samples."""
        low_bits = max(0, (bound // n).bit_length() - 1) if n else 0
        return low_bits, -(-n * low_bits // 8), -(-(n + (bound >> low_bits) + 1) // 8), 4 * -(-n // SAMPLE)

    @classmethod
    def of(cls, values: np.ndarray, bound: int) -> EliasFano:
        n = len(values)
        low_bits, _, high_bytes, _ = cls.sizes(n, bound)
        v = values.astype(np.uint64)
        bits = ((v[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        ones = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(8 * high_bytes, np.uint8)
        high[ones] = 1
        return cls(n, low_bits, np.packbits(bits.ravel(), bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes(), ones[::SAMPLE].astype("<u4"))

    def _low(self, i: int) -> int:
        first = i * self.low_bits
        got = int.from_bytes(self.low[first // 8 : (first + self.low_bits) // 8 + 1], "little")
        return got >> first % 8 & (1 << self.low_bits) - 1

    def select(self, i: int) -> int:
        """The i-th number, from the nearest sample on."""
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte, mask = at // 8, 0xFF << at % 8 & 0xFF
        while True:
            b = self.high[byte] & mask
            if (ones := b.bit_count()) > left:
                while left:
                    b &= b - 1
                    left -= 1
                return (8 * byte + (b & -b).bit_length() - 1 - i) << self.low_bits | self._low(i)
            left, byte, mask = left - ones, byte + 1, 0xFF

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))[: self.n]
        bits = np.unpackbits(np.frombuffer(self.low, np.uint8), count=self.n * self.low_bits, bitorder="little").reshape(self.n, self.low_bits)
        low = (bits.astype(np.int64) << np.arange(self.low_bits)).sum(1)
        return ((ones - np.arange(self.n)) << self.low_bits) | low


def write_image(documents: list[np.ndarray], first: int, width: int) -> bytes:
    if any(len(x) and int(x.max()) >> 8 * width for x in documents):
        raise ValueError(f"an id doesn't fit {width} bytes")
    ends = np.cumsum([len(x) for x in documents])
    total = int(ends[-1]) if len(ends) else 0
    ef = EliasFano.of(ends, total)
    ids = np.concatenate(documents).astype(f"<u{width}") if documents else np.empty(0, f"<u{width}")
    return b"".join((HEADER.pack(b"EFTK", width, ef.low_bits, len(documents), total, first), ef.low, ef.high, ef.samples.tobytes(), ids.tobytes()))


class Image:
    """A file image, read without a table of offsets."""

    def __init__(self, data: bytes):
        magic, width, low_bits, self.documents, self.total, self.first = HEADER.unpack_from(data)
        if magic != b"EFTK":
            raise ValueError("not a token file")
        _, low, high, samples = EliasFano.sizes(self.documents, self.total)
        at = HEADER.size
        self.ends = EliasFano(self.documents, low_bits, data[at : at + low], data[at + low : at + low + high], np.frombuffer(data, "<u4", samples // 4, at + low + high))
        self.ids = np.frombuffer(data, f"<u{width}", self.total, at + low + high + samples)

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.ends.select(i - 1) if i else 0 : self.ends.select(i)]


def write_token_files(docs: DataFrame, path: str, end_id: int = 2, kind: str = "word", width: int = 2, id_col: str = "doc_id", text_col: str = "text", image_ids: int = IMAGE_IDS, image_docs: int = IMAGE_DOCS) -> DataFrame:
    """Encode and write all documents in ascending order of ``id_col``; the dataset of images, read back.

    The texts are range-partitioned by id, so a partition's files follow the one before it.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    order = [F.col(id_col).asc_nulls_first(), F.xxhash64(text_col), F.col(text_col).asc_nulls_first()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(kind, path)
        part, number, base = TaskContext.get().partitionId(), 0, 0
        held: list[np.ndarray] = []
        names: list = []
        size = 0

        def image() -> pa.RecordBatch:
            nonlocal number, base, size
            data = write_image(held, base, width)
            out = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([size], pa.int64()), pa.array([list(names)], pa.list_(name_type)), pa.array([data], pa.binary())],
                names=["part", "number", "n_ids", "doc_ids", "image"],
            )
            number, base, size = number + 1, base + size, 0
            held.clear()
            names.clear()
            return out

        for batch in batches:
            name_type = batch.column(0).type
            for k in range(0, batch.num_rows, 256):
                rows = batch.slice(k, 256)
                for name, ids in zip(rows.column(0).to_pylist(), encoder.encode(rows.column(1).to_pylist())):
                    if held and (size + len(ids) >= image_ids or len(held) == image_docs):
                        yield image()
                    held.append(np.append(ids, np.uint32(end_id)))
                    names.append(name)
                    size += len(ids) + 1
        if held:
            yield image()

    # ranges are found from ids and hashes: a sample of those, not of texts, goes to the driver
    ordered = docs.select(id_col, text_col).repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    return written(ordered.mapInArrow(run, f"part int, number int, n_ids long, doc_ids array<{id_type}>, image binary"), "tokens")


def read_token_files(images: DataFrame, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """``id_col``, start, n_tokens, ids_crc32 (and ids) of every document, from the images alone."""
    id_type = images.schema["doc_ids"].dataType.elementType.simpleString()
    parts = images.groupBy("part").agg(F.sum("n_ids").alias("n"))  # a row for each partition that wrote
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                image = Image(batch.column(2)[k].as_py())
                # offsets come one by one from the select structure; no table of them is unpacked
                ends = np.fromiter(map(image.ends.select, range(image.documents)), np.int64, image.documents)
                starts = np.r_[0, ends[:-1]]
                ids = image.ids.astype("<u4")
                sums = [zlib.crc32(ids[a:b]) for a, b in zip(starts, ends)]
                base = batch.column(0)[k].as_py() + image.first
                columns = [batch.column(1)[k].values, pa.array(starts + base, pa.int64()), pa.array(ends - starts, pa.int64()), pa.array(sums, pa.int64())]
                if with_ids:
                    columns.append(pa.array([ids[a:b].astype("int32") for a, b in zip(starts, ends)], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "start", "n_tokens", "ids_crc32", *["ids"] * with_ids])

    joined = images.join(F.broadcast(bases), "part").select("base", "doc_ids", "image")
    return joined.mapInArrow(run, f"`{id_col}` {id_type}, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)
