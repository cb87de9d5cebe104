"""Token-ID files: one concatenated id array per shard, with Elias-Fano encoded document boundaries.

Documents are dealt out by ranges of doc_id and sorted, and each task streams the ids of its documents to one file in
the shared folder. A boundary table of n 64-bit offsets would take 8 n bytes; Elias-Fano takes about 2 + log2(u / n)
bits each, for u ids, and a sparse directory of every 256th set bit answers ``select``, and so any offset, by looking
at a few words. A shard's place in the whole is one sum per file, kept in the list of files.

A file: the ids (little-endian, 16 or 32 bits), the doc_ids (64 bits), the boundaries, then a JSON footer and its
length. Names are unique to a task attempt, and the list of files holds those of successful attempts alone, so a lost
executor leaves no wrong or partial file in it.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvex.llm import bpe, library_ids
from corvex.llm._common import fresh_path, partitions_for, slices, stage

#: Ids that a reader holds at a time.
READ_IDS = 1 << 18


class EliasFano:
    """A non-decreasing sequence of integers from 0 to ``top``, compressed, with access to any element."""

    EVERY = 256

    def __init__(self, size: int, width: int, high: np.ndarray, low: np.ndarray, marks: np.ndarray):
        self.size, self.width, self.high, self.low, self.marks = size, width, high, low, marks

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.int64)
        n = len(values)
        if not n:
            return cls(0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint8), np.zeros(0, np.uint32))
        width = max(0, (int(values[-1]) // n).bit_length() - 1)
        ones = (values >> width) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1, dtype=np.uint8)
        bits[ones] = 1
        low = (values[:, None] >> np.arange(width) & 1).astype(np.uint8).ravel() if width else np.zeros(0, np.uint8)
        return cls(n, width, np.packbits(bits, bitorder="little"), np.packbits(low, bitorder="little"), ones[:: cls.EVERY].astype(np.uint32))

    def select(self, i: int) -> int:
        """The place of set bit i: from the mark before it, byte by byte."""
        place, left = int(self.marks[i // self.EVERY]), i % self.EVERY
        byte = place >> 3
        word = int(self.high[byte]) >> (place & 7) << (place & 7)
        while (ones := word.bit_count()) <= left:
            left -= ones
            byte += 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        return (byte << 3) + (word & -word).bit_length() - 1

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.size:
            raise IndexError(i)
        low = 0
        for k in range(self.width):
            at = i * self.width + k
            low |= (int(self.low[at >> 3]) >> (at & 7) & 1) << k
        return (self.select(i) - i) << self.width | low

    def slice(self, start: int, stop: int) -> np.ndarray:
        """Elements start to stop, at once."""
        stop = min(stop, self.size)
        if start >= stop:
            return np.zeros(0, np.int64)
        a, b = self.select(start), self.select(stop - 1)
        bits = np.unpackbits(self.high[a >> 3 : (b >> 3) + 1], bitorder="little")
        ones = np.flatnonzero(bits) + (a >> 3 << 3)
        ones = ones[(ones >= a) & (ones <= b)]
        first, last = start * self.width, stop * self.width
        low = np.unpackbits(self.low[first >> 3 : -(-last // 8)], bitorder="little")[first - (first >> 3 << 3) :][: last - first]
        low = low.reshape(-1, self.width).astype(np.int64) @ (1 << np.arange(self.width, dtype=np.int64)) if self.width else 0
        return ((ones - np.arange(start, stop)) << self.width) + low

    def to_bytes(self) -> bytes:
        return np.array([self.size, self.width, len(self.high), len(self.low), len(self.marks)], "<i8").tobytes() + self.high.tobytes() + self.low.tobytes() + self.marks.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> EliasFano:
        n, width, a, b, c = np.frombuffer(raw, "<i8", 5).tolist()
        return cls(n, width, np.frombuffer(raw, np.uint8, a, 40), np.frombuffer(raw, np.uint8, b, 40 + a), np.frombuffer(raw, "<u4", c, 40 + a + b))


FILES = "part int, path string, first_doc long, n_docs long, n_tokens long"


def write(docs: DataFrame, folder: str | None = None, path: str | None = None, *, end: int | None = 0, files: int | None = None) -> DataFrame:
    """Writes the token files of docs in ascending doc_id order to folder, and returns the list of files.

    A null or empty text is the end id alone. Null doc_ids come first, equal ones side by side. The result has a row
    for each file in order, with ``base``, the ids of all files before it; no documents give no files. Columns other
    than doc_id and text are not read.
    """
    spark = docs.sparkSession
    folder, path = folder or fresh_path(spark, "token-files"), path or bpe.default_path("byte_bpe_50k.json")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartitionByRange(files or partitions_for(spark, rows), "doc_id").sortWithinPartitions("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        model = library_ids.model(path)
        kind = "<u2" if model.narrow else "<u4"
        tail = b"" if end is None else np.array([end], dtype=kind).tobytes()
        fs, inner = pa.fs.FileSystem.from_uri(folder)
        part = TaskContext.get().partitionId()
        name = f"ids-{part:05d}-{uuid.uuid4().hex}.bin"
        out, ids, ends, nulls, total, item = None, [], [], 0, 0, int(kind[-1])
        for batch in batches:
            for some in slices(batch):
                if out is None:
                    out = fs.open_output_stream(f"{inner}/{name}", compression=None)
                found = some.column(0).to_pylist()
                nulls += found.count(None)
                ids.append(np.array([x or 0 for x in found], dtype="<i8"))
                encoded = [x + tail for x in model.encode_many(some.column(1).to_pylist(), model.narrow)]
                lengths = np.cumsum([len(x) // item for x in encoded])
                ends.append(total + lengths)
                total += int(lengths[-1])
                out.write(b"".join(encoded))
        if out is None:
            return
        keys = np.concatenate(ids)
        bounds = EliasFano.of(np.concatenate([[0], *ends])).to_bytes()
        footer = json.dumps({"kind": kind, "n_docs": len(keys), "n_null": nulls, "n_tokens": total, "bounds": len(bounds)}).encode()
        out.write(keys.tobytes() + bounds + footer + len(footer).to_bytes(8, "little"))
        out.close()
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [f"{folder}/{name}"], "first_doc": pa.array([int(keys[0])], pa.int64()), "n_docs": pa.array([len(keys)], pa.int64()), "n_tokens": pa.array([total], pa.int64())})

    done = stage(rows.mapInArrow(run, FILES), "token-file-list")
    base, listed = 0, []  # a row per file
    for r in sorted(done.collect(), key=lambda r: r["part"]):
        listed.append((*r, base))
        base += r["n_tokens"]
    return spark.createDataFrame(listed, FILES + ", base long")


class TokenFile:
    """A reader of one file, by ranges."""

    def __init__(self, uri: str):
        fs, inner = pa.fs.FileSystem.from_uri(uri)
        self.file = fs.open_input_file(inner)
        size = self.file.size()
        length = int.from_bytes(self.file.read_at(8, size - 8), "little")
        self.meta = json.loads(self.file.read_at(length, size - 8 - length))
        self.kind, self.n_docs = self.meta["kind"], self.meta["n_docs"]
        self.item = int(self.kind[-1])
        at = size - 8 - length - self.meta["bounds"]
        self.bounds = EliasFano.from_bytes(self.file.read_at(self.meta["bounds"], at))
        self.keys_at = at - 8 * self.n_docs

    def keys(self, start: int, stop: int) -> list[int | None]:
        found = np.frombuffer(self.file.read_at(8 * (stop - start), self.keys_at + 8 * start), "<i8").tolist()
        return [None if start + i < self.meta["n_null"] else x for i, x in enumerate(found)]

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of the array."""
        return np.frombuffer(self.file.read_at((stop - start) * self.item, start * self.item), self.kind)

    def document(self, i: int) -> np.ndarray:
        return self.ids(self.bounds[i], self.bounds[i + 1])


def read(files: DataFrame, *, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if wanted, ids of every document.

    ids are binary, 32-bit little-endian, and ids_crc32 is their unsigned CRC-32.
    """
    spark = files.sparkSession
    n = max(1, files.count())
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                f, at = TokenFile(uri), 0
                while at < f.n_docs:
                    ahead = f.bounds.slice(at, min(f.n_docs, at + 1024) + 1)
                    k = max(1, int(np.searchsorted(ahead, ahead[0] + READ_IDS, side="right")) - 1)
                    k = min(k, len(ahead) - 1)
                    raw = memoryview(f.ids(int(ahead[0]), int(ahead[k])).astype("<u4")).cast("B")
                    cut = (4 * (ahead[: k + 1] - ahead[0])).tolist()
                    each = [raw[a:b] for a, b in zip(cut, cut[1:], strict=False)]
                    out = [pa.array(f.keys(at, at + k), pa.int64()), pa.array(base + ahead[:k]), pa.array(np.diff(ahead[: k + 1])), pa.array([zlib.crc32(x) for x in each], pa.int64())]
                    yield pa.RecordBatch.from_arrays([*out, pa.array(each, pa.binary())] if with_ids else out, names)
                    at += k

    return files.select("path", "base").repartition(min(n, 4 * partitions_for(spark)), "path").mapInArrow(run, schema)


def digests(docs: DataFrame) -> DataFrame:
    """Writes the files and reads them back: each document's place, number of ids and their CRC-32."""
    return read(write(docs), with_ids=False)
