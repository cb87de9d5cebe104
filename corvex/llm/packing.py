"""Packing of token sequences into windows of a fixed capacity by Karmarkar-Karp multiway differencing.

Each task packs its own documents, a block of bounded size at a time, so nothing is shuffled and no group grows with
the input. A document's ids are cut into full windows, which stand alone, and a remainder. The remainders of a block
go to the least number of windows that could hold them: the two partial partitions with the largest spreads are merged
again and again, the fullest window of one with the emptiest of the other, until one near-equal partition is left. The
window count rises whenever the capacity is exceeded.

With ``max_cuts``, the excess of the fullest windows is instead cut off and put where there is room, unless that takes
more than this share of the pieces; by default nothing shorter than a window is cut. Every id is in one piece.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvex.llm import bpe, library_ids
from corvex.llm._common import slices

CAPACITY, END = 4096, 2
#: Ids of a block's remainders at most; they are held in memory until the block is packed.
BLOCK_IDS = 1 << 20


def difference(sizes: list[int], windows: int) -> list[list[int]]:
    """The items of each window, by Karmarkar-Karp differencing of sizes into the given number of near-equal windows.

    A partial partition is kept sparse: its non-empty windows alone, as most hold few. Ties go by position.
    """
    if windows == 1:
        return [list(range(len(sizes)))]
    heap: list[tuple[int, int, list[tuple[int, list[int]]]]] = [(-s, i, [(s, [i])]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    made = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        # a falls; b's fullest joins a's emptiest. Windows beyond len(a) are empty.
        free = windows - len(a)
        if len(b) <= free:
            both = a + b
        else:
            alone, joined = b[:free], b[free:]  # empty windows of a take b's fullest
            k = len(joined)
            both = a[: len(a) - k] + alone + [(x[0] + y[0], x[1] + y[1]) for x, y in zip(reversed(a[len(a) - k :]), joined, strict=True)]
        both.sort(key=lambda w: -w[0])
        least = both[-1][0] if len(both) == windows else 0
        heapq.heappush(heap, (least - both[0][0], made, both))
        made += 1
    found = [w[1] for w in heap[0][2]] if heap else []
    return found + [[] for _ in range(windows - len(found))]


def windows_of(sizes: list[int], capacity: int = CAPACITY, max_cuts: float = 0.0) -> list[list[tuple[int, int, int]]]:
    """Windows of (item, start, length), none over capacity, for items of at most capacity each."""
    items = [i for i, s in enumerate(sizes) if s]
    if not items:
        return []
    own = [sizes[i] for i in items]
    count = -(-sum(own) // capacity)
    while True:
        split = difference(own, count)
        found = [[(items[i], 0, own[i]) for i in w] for w in split]
        loads = [sum(p[2] for p in w) for w in found]
        over = [k for k, x in enumerate(loads) if x > capacity]
        if not over:
            return [w for w in found if w]
        if len(over) <= max_cuts * len(own):
            break
        count += 1
    spare = sorted((k for k, x in enumerate(loads) if x < capacity), key=lambda k: loads[k])
    for k in over:
        while loads[k] > capacity:
            item, start, length = found[k][-1]
            to = spare[-1]  # the fullest with room: few cuts are cut again
            for other in reversed(spare):
                if capacity - loads[other] >= loads[k] - capacity:
                    to = other
                    break
            cut = min(length, loads[k] - capacity, capacity - loads[to])
            if cut == length:
                found[k].pop()
            else:
                found[k][-1] = (item, start, length - cut)
            found[to].append((item, start + length - cut, cut))
            loads[k] -= cut
            loads[to] += cut
            if loads[to] == capacity:
                spare.remove(to)
    return [w for w in found if w]


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, path: str | None = None, *, capacity: int = CAPACITY, end: int | None = END, block_ids: int = BLOCK_IDS, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if wanted.

    The ids of a document are those of the tokenizers library for the file ``path``, then ``end``; a piece has them as
    32-bit little-endian integers, and their unsigned CRC-32. A null or empty text is the end id alone. A sequence_id is
    unique and the same on a retry: the task's partition number, then a count. Documents longer than a window are cut at
    its multiples; equal rows are packed like others; an empty table gives no rows. Columns other than doc_id and text
    are not read.
    """
    path = path or bpe.default_path()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    tail = b"" if end is None else np.array([end], dtype="<u4").tobytes()
    schema = PIECES + ", ids binary" * with_ids
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = library_ids.model(path)
        base, made = TaskContext.get().partitionId() << 32, 0
        rest: list[tuple[int | None, int, bytes, int]] = []  # doc_id, start, ids, ids of its document
        held = 0

        def batch(out: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) if out else [[] for _ in range(7)]
            ids = cols.pop(3)
            arrays = [pa.array(c, pa.int64()) for c in cols]
            arrays.insert(3, pa.array([zlib.crc32(x) for x in ids], pa.int64()))
            return pa.RecordBatch.from_arrays([*arrays, pa.array(ids, pa.binary())] if with_ids else arrays, names)

        def flush() -> pa.RecordBatch:
            nonlocal made, held
            out = []
            for w in windows_of([len(r[2]) // 4 for r in rest], capacity):
                at = 0
                for item, start, length in w:
                    doc, first, ids, n = rest[item]
                    out.append((doc, first + start, length, ids[4 * start : 4 * (start + length)], n, base + made, at))
                    at += length
                made += 1
            rest.clear()
            held = 0
            return batch(out)

        for b in batches:
            for part in slices(b):
                out = []
                for doc, ids in zip(part.column(0).to_pylist(), model.encode_many(part.column(1).to_pylist()), strict=True):
                    ids += tail
                    n, at = len(ids) // 4, 0
                    while n - at >= capacity:
                        out.append((doc, at, capacity, ids[4 * at : 4 * (at + capacity)], n, base + made, 0))
                        at += capacity
                        made += 1
                    if n > at:
                        rest.append((doc, at, ids[4 * at :], n))
                        held += n - at
                    if held >= block_ids:
                        yield flush()
                if out:
                    yield batch(out)
        yield flush()

    return rows.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The pieces, with the CRC-32 of their ids but not the ids."""
    return pack(docs, path, with_ids=False)
