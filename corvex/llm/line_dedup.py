"""Line deduplication: sharded cuckoo filters backed by exact reference-count tables.

The reference-count table holds, for each line key, in how many documents it is (each row is a document). The keys
that reach the threshold are *common*; each shard, a range of key hashes, has them in a cuckoo filter and, sorted, in
an exact list. A line that the filter of its shard rejects is kept at once; only the others are held against the exact
list. Filters and counts take deletions as well as insertions, so adding documents and removing them again restores
the state.

A key is the line with blanks stripped at both ends and A-Z lower-cased, and is known by its 128-bit hash. Counting is
one shuffle of (hash, count) rows that were summed per batch before, so a line in a third of all documents is a few
rows. The common keys are read by each worker if they take at most ``worker_bytes``; beyond that, the keys of all lines
are sorted by shard and held against one shard after the other, so that a worker has one at a time and the same filters
and lists answer. Shards are laid out anew when insertions have filled them to twice their size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.dataset
import pyarrow.fs
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvex.llm._common import fresh_path, partitions_for, slices, stage, utf8

THRESHOLD = 10
#: Common keys of a shard, about, when shards are laid out.
SHARD_KEYS = 1 << 15
#: Bytes of common keys that each worker may hold.
WORKER_BYTES = 64 << 20


class Cuckoo:
    """A cuckoo filter of 16-bit fingerprints in buckets of four, over pairs of 64-bit hashes."""

    KICKS = 500

    def __init__(self, table: np.ndarray):
        self.table = table  # (buckets, 4) of uint16; 0 is empty
        self.mask = len(table) - 1

    @classmethod
    def sized(cls, keys: int) -> Cuckoo:
        return cls(np.zeros((1 << max(2, int(np.ceil(np.log2(max(1, keys) / 3)))), 4), dtype=np.uint16))

    @classmethod
    def of(cls, lo: np.ndarray) -> Cuckoo:
        """The filter of all the keys, as large as it takes."""
        room = len(lo)
        while True:
            out = cls.sized(room)
            if all(out.insert(x) for x in lo.tolist()):
                return out
            room = 2 * room + 1

    @staticmethod
    def _print(lo: int) -> int:
        return (lo & 0xFFFF) or 1

    def _other(self, bucket: int, fp: int) -> int:
        return (bucket ^ (fp * 0x5BD1E995 & 0xFFFFFFFF)) & self.mask

    def insert(self, lo: int) -> bool:
        fp = self._print(lo)
        bucket = (lo >> 16) & self.mask
        for b in (bucket, self._other(bucket, fp)):
            row = self.table[b]
            for i in range(4):
                if not row[i]:
                    row[i] = fp
                    return True
        for kick in range(self.KICKS):
            i = (fp + kick) & 3
            fp, self.table[bucket, i] = int(self.table[bucket, i]), fp
            bucket = self._other(bucket, fp)
            row = self.table[bucket]
            for j in range(4):
                if not row[j]:
                    row[j] = fp
                    return True
        return False

    def delete(self, lo: int) -> bool:
        """Removes one copy of a key that was inserted."""
        fp = self._print(lo)
        bucket = (lo >> 16) & self.mask
        for b in (bucket, self._other(bucket, fp)):
            at = np.flatnonzero(self.table[b] == fp)
            if at.size:
                self.table[b, at[0]] = 0
                return True
        return False

    def __contains__(self, lo: int) -> bool:
        fp = self._print(lo)
        bucket = (lo >> 16) & self.mask
        return bool((self.table[bucket] == fp).any() or (self.table[self._other(bucket, fp)] == fp).any())


class Common:
    """The common keys of all shards: their filters side by side, and the sorted keys behind them."""

    def __init__(self, rows: list[tuple[int, bytes, bytes]], bits: int):
        self.bits = bits
        tables = {s: np.frombuffer(f, dtype=np.uint16).reshape(-1, 4) for s, f, _ in rows}
        blank = np.zeros((1, 4), dtype=np.uint16)
        all_ = [tables.get(s, blank) for s in range(1 << bits)]
        self.first = np.cumsum([0, *(len(t) for t in all_[:-1])])
        self.mask = np.array([len(t) - 1 for t in all_], dtype=np.uint64)
        self.table = np.concatenate(all_)
        keys = np.concatenate([np.frombuffer(k, dtype=">u8").reshape(-1, 2) for *_, k in sorted(rows)] or [np.zeros((0, 2))]).astype(np.uint64)
        self.hi, self.lo = keys[:, 0], keys[:, 1]

    def probable(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """Which keys the filters of their shards have."""
        shard = (hi >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(hi), dtype=np.int64)
        fp = np.maximum(lo & np.uint64(0xFFFF), np.uint64(1))
        mask = self.mask[shard]
        bucket = (lo >> np.uint64(16)) & mask
        other = (bucket ^ (fp * np.uint64(0x5BD1E995) & np.uint64(0xFFFFFFFF))) & mask
        first, fp = self.first[shard], fp.astype(np.uint16)[:, None]
        return (self.table[first + bucket.astype(np.int64)] == fp).any(axis=1) | (self.table[first + other.astype(np.int64)] == fp).any(axis=1)

    def has(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """Which keys are common: by the filters, then by the exact lists."""
        out = self.probable(hi, lo)
        for i in np.flatnonzero(out).tolist():
            at = int(np.searchsorted(self.hi, hi[i]))
            while at < len(self.hi) and self.hi[at] == hi[i] and self.lo[at] != lo[i]:
                at += 1
            out[i] = at < len(self.hi) and self.hi[at] == hi[i]
        return out


_STORED = [("filter", pa.binary()), ("keys", pa.binary())]


@lru_cache(maxsize=2)
def common_at(path: str, bits: int) -> Common:
    """The common keys of all shards."""
    fs, inner = pa.fs.FileSystem.from_uri(path)
    found = pyarrow.dataset.dataset(inner, filesystem=fs, format="parquet", partitioning="hive", schema=pa.schema([*_STORED, ("shard", pa.int32())])).to_table()
    return Common(list(zip(*(found[c].to_pylist() for c in ("shard", "filter", "keys")), strict=True)), bits)


@lru_cache(maxsize=2)
def shard_at(path: str, shard: int) -> Common:
    """The common keys of one shard."""
    fs, inner = pa.fs.FileSystem.from_uri(f"{path}/shard={shard}")
    if fs.get_file_info(inner).type == pa.fs.FileType.NotFound:
        return Common([], 0)
    found = pyarrow.dataset.dataset(inner, filesystem=fs, format="parquet", schema=pa.schema(_STORED)).to_table()
    return Common([(0, f, k) for f, k in zip(found["filter"].to_pylist(), found["keys"].to_pylist(), strict=True)], 0)


def hashes(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, lines)), dtype=">u8").reshape(-1, 2).astype(np.uint64)
    return both[:, 0], both[:, 1]


def key_of(line: bytes) -> bytes:
    return line.strip().lower()


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def count_lines(docs: DataFrame) -> DataFrame:
    """hi, lo, n: in how many rows of docs each non-empty line key is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[bytes] = []
            for part in slices(batch):
                for text in utf8(part.column(0)):
                    keys = {key_of(x) for x in text.split(b"\n")}
                    keys.discard(b"")
                    found += map(xxhash.xxh3_128_digest, keys)
            if found:
                keys, n = _unique(found)
                yield pa.RecordBatch.from_arrays([signed(keys[:, 0].copy()), signed(keys[:, 1].copy()), pa.array(n)], ["hi", "lo", "n"])

    return docs.select("text").mapInArrow(run, "hi long, lo long, n long").groupBy("hi", "lo").agg(F.sum("n").alias("n"))


def _unique(found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(found), dtype=">u8").reshape(-1, 2).astype(np.uint64)
    both = both[np.lexsort((both[:, 1], both[:, 0]))]
    new = np.flatnonzero(np.concatenate([[True], (both[1:] != both[:-1]).any(axis=1)]))
    return np.ascontiguousarray(both[new]), np.diff(np.append(new, len(both))).astype(np.int64)


def _shard(bits: int):
    return F.shiftrightunsigned("hi", 64 - bits).cast("int") if bits else F.lit(0)


SHARDS = "shard int, filter binary, keys binary, n long"


def _shards(common: DataFrame, bits: int) -> DataFrame:
    """One row per shard that has common keys."""

    def build(key, group):
        keys = np.stack([group["hi"].to_numpy().view(np.uint64), group["lo"].to_numpy().view(np.uint64)], axis=1)
        keys = keys[np.lexsort((keys[:, 1], keys[:, 0]))]
        return pa.table({"shard": [key[0].as_py()], "filter": [Cuckoo.of(keys[:, 1]).table.tobytes()], "keys": [keys.astype(">u8").tobytes()], "n": [len(keys)]}, schema=pa.schema([("shard", pa.int32()), ("filter", pa.binary()), ("keys", pa.binary()), ("n", pa.int64())]))

    return common.select(_shard(bits).alias("shard"), "hi", "lo").groupBy("shard").applyInArrow(build, SHARDS)


class LineState:
    """The reference counts and shards of a corpus, as tables in the shared folder."""

    def __init__(self, refs: DataFrame, shards: DataFrame, path: str, bits: int, common: int, threshold: int):
        self.refs, self.shards, self.path, self.bits, self.common, self.threshold = refs, shards, path, bits, common, threshold

    @classmethod
    def build(cls, docs: DataFrame, threshold: int = THRESHOLD) -> LineState:
        return cls._of(stage(count_lines(docs), "line-refs"), threshold)

    @classmethod
    def _of(cls, refs: DataFrame, threshold: int, bits: int | None = None, shards: DataFrame | None = None) -> LineState:
        spark, common = refs.sparkSession, refs.filter(F.col("n") >= threshold)
        n = common.count()
        if bits is None or n >> bits > 2 * SHARD_KEYS:
            bits, shards = max(0, int(np.ceil(np.log2(max(1, n) / SHARD_KEYS)))), None
        path = fresh_path(spark, "line-shards")
        shards = (shards if shards is not None else _shards(common, bits)).repartition("shard")
        shards.write.mode("overwrite").partitionBy("shard").parquet(path)
        return cls(refs, spark.read.schema(SHARDS).parquet(path), path, bits, n, threshold)

    def insert(self, docs: DataFrame) -> LineState:
        """The state with these documents added."""
        return self._updated(count_lines(docs))

    def delete(self, docs: DataFrame) -> LineState:
        """The state without these documents, which must have been added."""
        return self._updated(count_lines(docs).withColumn("n", -F.col("n")))

    def _updated(self, change: DataFrame) -> LineState:
        """Counts are added up; keys that cross the threshold enter or leave the filters of their shards alone."""
        t, bits = self.threshold, self.bits
        both = self.refs.withColumn("old", F.col("n")).unionByName(change.withColumn("old", F.lit(0).cast("long")))
        both = stage(both.groupBy("hi", "lo").agg(F.sum("n").alias("n"), F.sum("old").alias("old")).filter("n != 0 or old != 0"), "line-refs")
        crossed = both.filter((F.col("n") >= t) != (F.col("old") >= t)).select(_shard(bits).alias("shard"), "hi", "lo", (F.col("n") >= t).alias("enters"))

        def apply(key, old, new):
            raw = old["filter"][0].as_py() if old.num_rows else Cuckoo.sized(16).table.tobytes()
            kept = {k for k in np.frombuffer(old["keys"][0].as_py() if old.num_rows else b"", dtype="V16").tolist()}
            cuckoo, fits = Cuckoo(np.frombuffer(raw, dtype=np.uint16).reshape(-1, 4).copy()), True
            for hi, lo, enters in zip(new["hi"].to_pylist(), new["lo"].to_pylist(), new["enters"].to_pylist(), strict=True):
                raw = (hi & (1 << 64) - 1).to_bytes(8) + (lo & (1 << 64) - 1).to_bytes(8)
                if enters:
                    kept.add(raw)
                    fits &= cuckoo.insert(lo & (1 << 64) - 1)
                else:
                    kept.discard(raw)
                    cuckoo.delete(lo & (1 << 64) - 1)
            keys = b"".join(sorted(kept))
            if not fits:  # it is full: a larger one from the exact list
                cuckoo = Cuckoo.of(np.frombuffer(keys, dtype=">u8").reshape(-1, 2)[:, 1].astype(np.uint64))
            return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "filter": pa.array([cuckoo.table.tobytes()], pa.binary()), "keys": pa.array([keys], pa.binary()), "n": pa.array([len(kept)], pa.int64())})

        shards = self.shards.groupBy("shard").cogroup(crossed.groupBy("shard")).applyInArrow(apply, SHARDS)
        return self._of(both.filter("n != 0").select("hi", "lo", "n"), t, bits, shards)


def dedup(docs: DataFrame, state: LineState | None = None, *, threshold: int = THRESHOLD, worker_bytes: int = WORKER_BYTES, counts: bool = False) -> DataFrame:
    """docs with every common line removed from ``text``: lines whose key is in ``threshold`` documents or more.

    All columns stay, and only ``text`` changes; with ``counts`` the result is doc_id, n_lines, n_dropped, text. The
    lines left are joined by newlines. Empty keys are never common. A null text is one empty line: it is empty in the
    result with ``counts`` and stays null otherwise. Repeated rows are documents of their own.
    """
    state = state or LineState.build(docs, threshold)
    path, bits = state.path, state.bits
    docs = docs.select("doc_id", "text") if counts else docs
    small = 24 * state.common <= worker_bytes
    names = docs.columns
    at = names.index("text")
    extra = [] if small else ["common_keys"]
    if not small:
        docs = _with_common(docs, state)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = common_at(path, bits) if small else None
        for batch in batches:
            for part in slices(batch):
                lines = [t.split(b"\n") for t in utf8(part.column(at))]
                hi, lo = hashes([key_of(x) for doc in lines for x in doc])
                if small:
                    drop = common.has(hi, lo).tolist()
                else:
                    drop, k = [], 0
                    for doc, keys in zip(lines, part.column(len(names)).to_pylist(), strict=True):
                        held = {(x["hi"], x["lo"]) for x in keys or ()}
                        drop += [(h, w) in held for h, w in zip(hi[k : k + len(doc)].view(np.int64).tolist(), lo[k : k + len(doc)].view(np.int64).tolist(), strict=True)]
                        k += len(doc)
                kept, n, gone, k = [], [], [], 0
                for doc in lines:
                    flags = drop[k : k + len(doc)]
                    k += len(doc)
                    n.append(len(doc))
                    gone.append(sum(flags))
                    kept.append(b"\n".join([x for x, d in zip(doc, flags, strict=True) if not d]) if gone[-1] else b"\n".join(doc))
                text = pa.array(kept, pa.binary()).cast(pa.string())
                if counts:
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), text], ["doc_id", "n_lines", "n_dropped", "text"])
                else:
                    if part.column(at).null_count:
                        text = pa.compute.if_else(part.column(at).is_null(), pa.scalar(None, pa.string()), text)
                    yield pa.RecordBatch.from_arrays([text if i == at else part.column(i) for i in range(len(names))], names)

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_lines long, n_dropped long, text string" if counts else docs.select(names).schema
    return docs.select(*names, *extra).mapInArrow(run, schema)


def _with_common(docs: DataFrame, state: LineState) -> DataFrame:
    """docs with the common keys of each document, for any number of them: a task has one shard at a time.

    Keys are dealt by shard, key and document, so a line that many documents share is in many tasks.
    """
    path, bits = state.path, state.bits
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                at, keys = [], []
                for i, text in enumerate(utf8(part.column(2))):
                    own = {key_of(x) for x in text.split(b"\n")}
                    own.discard(b"")
                    at += [i] * len(own)
                    keys += own
                if keys:
                    hi, lo = hashes(keys)
                    at = pa.array(at, pa.int64())
                    yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), signed(np.ascontiguousarray(hi)), signed(np.ascontiguousarray(lo))], ["of", "h", "hi", "lo"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hi, lo = (batch.column(i).to_numpy().view(np.uint64) for i in (2, 3))
            shard = (hi >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hi), np.int64)
            edges = [*np.flatnonzero(np.diff(shard, prepend=-1)).tolist(), len(shard)]
            common = np.zeros(len(hi), bool)
            for a, b in zip(edges, edges[1:], strict=False):
                common[a:b] = shard_at(path, int(shard[a])).has(hi[a:b], lo[a:b])
            yield batch.filter(pa.array(common))

    lines = docs.select("doc_id", F.xxhash64("text").alias("h"), "text").mapInArrow(run, f"of {kind}, h long, hi long, lo long")
    n = partitions_for(docs.sparkSession, docs)
    order = F.col("hi").bitwiseXOR(-(1 << 63))  # as unsigned, so that a shard is a range
    lines = lines.withColumn("at", order).repartitionByRange(n, "at", "lo", "of").sortWithinPartitions("at").drop("at")
    held = lines.mapInArrow(check, lines.schema).groupBy("of", "h").agg(F.collect_set(F.struct("hi", "lo")).alias("common_keys"))
    return docs.join(held, docs["doc_id"].eqNullSafe(held["of"]) & (F.xxhash64(docs["text"]) == held["h"]), "left").drop(held["of"], held["h"])


def digests(docs: DataFrame) -> DataFrame:
    """Of each document, its lines, those dropped, and the digest of the text that is left."""
    return dedup(docs, counts=True).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def digests_sql(threshold: int = THRESHOLD) -> str:
    blank = r"[\x20\x09-\x0D]"
    return f"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT r, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM docs),
keyed AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^{blank}+', ''), '{blank}+$', ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
common AS (SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT r) >= {threshold})
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (k IN (SELECT k FROM common)))::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (k NOT IN (SELECT k FROM common)), '')) AS kept_sha256
FROM keyed GROUP BY r"""
