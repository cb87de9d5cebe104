"""Language-model scoring by deleted interpolation.

The model mixes the maximum-likelihood estimates of bigrams and unigrams and a uniform one:

    P(w | h) = l2[b] c(h w) / c(h) + l1[b] c(w) / N + l0[b] / (V + 1)

with weights for each bucket b of the context's count, floor(log2 c(h)). They are learned by expectation-maximisation
on held-out counts: each training token is deleted in turn, that is, predicted from the counts of all others. Tokens
with like estimates are counted together, in cells of an eighth of an octave, so that EM sees every token in one pass
and its input has a bounded size whatever the corpus.

Texts become blocks of about ``BLOCK_TOKENS`` tokens that are coded by a vocabulary of their own. A block sends the
hashes of its distinct words and word pairs, with their training counts, to shards by ranges of the hash; a shard adds
them up over all blocks and answers each with the totals, in the block's order and so without keys. What is shuffled
are packed arrays, a few bytes for each distinct pair of a block; a word that a third of all tokens are is one entry
for each block, and no task holds counts beyond its shard, of which there are more the more tokens there are.

Blocks and shards both grow with the corpus, so a block never addresses all shards: it addresses 2 ** ``FAN`` ranges,
those of as many blocks are added up to one list and that addresses as many narrower ranges, and so on to the shards,
and the totals come back along the same path. The rows of a level are then at most a constant number for each block.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvex.llm._common import partitions_for, release, slices, stage, utf8

FOLDS, HELD_OUT = 5, 1
BLOCK_TOKENS = 1 << 19
#: Tokens for each shard, about.
SHARD_TOKENS = 1 << 20
#: Bits of the hash by which a level tells ranges apart.
FAN = 8
BUCKETS, STEPS_PER_OCTAVE, EM_ROUNDS = 40, 8, 200
END = b""

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def tokens_of(text: bytes) -> list[bytes]:
    """Words, A-Z lower-cased, then the end."""
    return [*text.lower().split(), END]


def is_held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == HELD_OUT


_squeeze = zstandard.ZstdCompressor(level=1).compress  # the planes' lesser ones don't yield to what shuffles use
_expand = zstandard.ZstdDecompressor().decompress


def _narrow(x: np.ndarray) -> bytes:
    """An array of counts in the narrowest unsigned type, which its first byte tells, byte plane by byte plane, compressed."""
    top = int(x.max()) if x.size else 0
    size = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
    return _squeeze(bytes([size]) + np.ascontiguousarray(x.astype(f"<u{size}").view(np.uint8).reshape(-1, size).T).tobytes())


def _wide(raw: bytes) -> np.ndarray:
    raw = _expand(raw)
    planes = np.frombuffer(raw, np.uint8, offset=1).reshape(raw[0], -1)
    return np.ascontiguousarray(planes.T).view(f"<u{raw[0]}").ravel().astype(np.int64)


def _pack(sorted_: np.ndarray) -> bytes:
    """Sorted hashes as differences, byte plane by byte plane, so that the high planes compress."""
    return _squeeze(np.ascontiguousarray(np.diff(sorted_, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T).tobytes())


def _unpack(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(_expand(raw), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


BLOCKS = "block long, docs binary, missing binary, sizes binary, train binary, vocab binary, tokens binary, n_tokens long"


def blocks(docs: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The texts as coded blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = TaskContext.get().partitionId() << 32, 0
        own: defaultdict[bytes, int] = defaultdict()
        own.default_factory = own.__len__
        ids: list[int | None] = []
        arrays: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, made
            h = np.array(list(map(xxhash.xxh3_64_intdigest, own)), dtype=np.uint64)
            order = np.argsort(h)
            place = np.empty(len(h), np.int64)
            place[order] = np.arange(len(h))
            row = {
                "block": pa.array([base + made], pa.int64()),
                "docs": [np.array([i or 0 for i in ids], "<i8").tobytes()],
                "missing": [np.array([i is None for i in ids]).tobytes()],
                "sizes": [np.array([len(a) for a in arrays], "<i8").tobytes()],
                "train": [np.array([not is_held_out(i) for i in ids]).tobytes()],
                "vocab": [_pack(h[order])],
                "tokens": [_narrow(place[np.concatenate(arrays)])],
                "n_tokens": pa.array([held], pa.int64()),
            }
            own.clear()
            ids.clear()
            arrays.clear()
            held, made = 0, made + 1
            return pa.RecordBatch.from_pydict(row)

        for batch in batches:
            for part in slices(batch):
                for doc, text in zip(part.column(0).to_pylist(), utf8(part.column(1)), strict=True):
                    a = np.array(list(map(own.__getitem__, tokens_of(text))), dtype=np.uint32)
                    ids.append(doc)
                    arrays.append(a)
                    held += len(a)
                    if held >= block_tokens:
                        yield flush()
        if ids:
            yield flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, BLOCKS)


class _Block:
    """A block's arrays: tokens and their contexts, and its distinct pairs in the order of their hashes."""

    def __init__(self, row: dict):
        self.sizes = np.frombuffer(row["sizes"], "<i8")
        self.vocab = _unpack(row["vocab"])
        self.tokens = _wide(row["tokens"])
        self.train = np.repeat(np.frombuffer(row["train"], bool), self.sizes)
        end = int(np.searchsorted(self.vocab, np.uint64(xxhash.xxh3_64_intdigest(END))))
        self.context = np.empty_like(self.tokens)
        self.context[1:] = self.tokens[:-1]
        self.context[0] = end  # every other text follows the end of one

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """The sorted hashes of the pairs, and each token's place among them."""
        codes, back = np.unique(self.context * len(self.vocab) + self.tokens, return_inverse=True)
        h = _mix(self.vocab[codes // len(self.vocab)] * _ODD + self.vocab[codes % len(self.vocab)])
        order = np.argsort(h)
        place = np.empty(len(h), np.int64)
        place[order] = np.arange(len(h))
        return h[order], place[back]


REQUESTS = "shard long, block long, kind int, hashes binary, counts binary"
_KINDS = {"shard": pa.int64(), "block": pa.int64(), "kind": pa.int32(), "hashes": pa.binary(), "counts": pa.binary(), "n": pa.int64(), "types": pa.int64()}


def _columns(rows: list[tuple], names: str) -> tuple[list[pa.Array], list[str]]:
    names = [x.split()[0] for x in names.split(", ")]
    cols = zip(*rows, strict=True) if rows else [[] for _ in names]
    return [pa.array(c, _KINDS[n]) for c, n in zip(cols, names, strict=True)], names


def _split(shard: int, block: int, kind: int, hashes: np.ndarray, counts: np.ndarray, used: int, width: int) -> Iterator[tuple]:
    """A request for each narrower range of sorted hashes that share their first ``used`` bits."""
    own = hashes << np.uint64(used) >> np.uint64(64 - width) if width else np.zeros(len(hashes), np.uint64)
    edges = np.searchsorted(own, np.arange((1 << width) + 1, dtype=np.uint64)).tolist()
    for i, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
        if hi > lo:
            yield shard << width | i, block, kind, _pack(hashes[lo:hi]), _narrow(counts[lo:hi])


def _requests(coded: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                row = part.to_pylist()[0]
                b = _Block(row)
                h, place = b.pairs()
                for kind, hashes, at in ((0, b.vocab, b.tokens), (1, h, place)):
                    counts = np.bincount(at[b.train], minlength=len(hashes))
                    yield pa.RecordBatch.from_arrays(*_columns(list(_split(0, row["block"], kind, hashes, counts, 0, width)), REQUESTS))

    return coded.mapInArrow(run, REQUESTS)


def _summed(lists: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct hashes of all lists, and the sums of their counts."""
    hashes, counts = (np.concatenate([x[i] for x in lists]) for i in (0, 1))
    order = np.argsort(hashes, kind="stable")
    hashes = hashes[order]
    new = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
    return hashes[new], np.add.reduceat(counts[order], new)


def _by_kind(group: pa.Table) -> Iterator[tuple[int, list[tuple[int, np.ndarray, np.ndarray]]]]:
    rows: dict[int, list] = {0: [], 1: []}
    for r in group.select(["block", "kind", "hashes", "counts"]).to_pylist():
        rows[r["kind"]].append((r["block"], _unpack(r["hashes"]), _wide(r["counts"])))
    return ((k, own) for k, own in rows.items() if own)


ANSWERS = "block long, kind int, shard long, counts binary, n long, types long"


def _dealt(df: DataFrame, groups: int, *keys: str) -> DataFrame:
    """df dealt by keys that have so many values, a few to a task, so that a task's share doesn't grow with their number."""
    return df.repartition(max(partitions_for(df.sparkSession), groups // 2), *keys)


def _answers(requests: DataFrame, shards: int) -> DataFrame:
    """The totals of each request. One answer of each shard has, for words, the sum and number of the counts."""

    def run(key, group):
        out = []
        for kind, own in _by_kind(group):
            hashes, totals = _summed([x[1:] for x in own])
            for i, (block, h, _) in enumerate(own):
                first = i == 0 and kind == 0
                out.append((block, kind, key[0].as_py(), _narrow(totals[np.searchsorted(hashes, h)]), int(totals.sum()) if first else 0, int((totals > 0).sum()) if first else 0))
        return pa.table(*_columns(out, ANSWERS))

    return _dealt(requests, shards, "shard").groupBy("shard").applyInArrow(run, ANSWERS)


def _resolved(requests: DataFrame, widths: list[int], level: int, blocks: int) -> DataFrame:
    """The answers to requests of blocks, that are by the first ``level + 1`` widths of the hash."""
    if level + 1 == len(widths):
        return stage(_answers(requests, 1 << sum(widths)), "lm-answers")
    used, width = sum(widths[: level + 1]), widths[level + 1]
    more = -(-blocks >> FAN)
    requests = stage(requests.withColumn("of", F.pmod(F.xxhash64("block"), F.lit(more))), "lm-requests")

    def merge(key, group):
        out = []
        for kind, own in _by_kind(group):
            out += _split(key[0].as_py(), key[1].as_py(), kind, *_summed([x[1:] for x in own]), used, width)
        return pa.table(*_columns(out, REQUESTS))

    def fill(key, left, right):
        out, back = [], sorted(right.to_pylist(), key=lambda r: (r["kind"], r["shard"]))
        n, types = (sum(r[c] for r in back) for c in ("n", "types"))
        for kind, own in _by_kind(left):
            hashes, _ = _summed([x[1:] for x in own])
            totals = np.concatenate([_wide(r["counts"]) for r in back if r["kind"] == kind])
            for block, h, _ in own:
                out.append((block, kind, key[0].as_py(), _narrow(totals[np.searchsorted(hashes, h)]), n, types))
                n = types = 0
        return pa.table(*_columns(out, ANSWERS))

    groups = more << used
    merged = _dealt(requests, groups, "shard", "of").groupBy("shard", "of").applyInArrow(merge, REQUESTS)
    found = _resolved(merged, widths, level + 1, more).select(F.shiftright("shard", width).alias("above"), F.col("block").alias("whole"), "shard", "kind", "counts", "n", "types")
    asked, told = _dealt(requests, groups, "shard", "of").groupBy("shard", "of"), _dealt(found, groups, "above", "whole").groupBy("above", "whole")
    return stage(asked.cogroup(told).applyInArrow(fill, ANSWERS), "lm-answers")


def _widths(bits: int) -> list[int]:
    return [min(FAN, bits - at) for at in range(0, bits, FAN)] or [0]


def _cells(pair: np.ndarray, context: np.ndarray, word: np.ndarray, n: int, types: int) -> tuple[np.ndarray, ...]:
    """The bucket, the cell and the estimates of tokens with these counts."""
    p2 = np.divide(pair, context, out=np.zeros(len(pair)), where=context > 0)
    p1 = word / max(n, 1)
    bucket = np.zeros(len(pair), np.int64)
    seen = context > 0
    bucket[seen] = np.minimum(np.floor(np.log2(context[seen])).astype(np.int64) + 1, BUCKETS - 1)
    return bucket, p2, p1


FACTS = "block long, docs binary, missing binary, sizes binary, train binary, words binary, pairs binary, cells binary"


def _facts(coded: DataFrame, answers: DataFrame, blocks: int, n: int, types: int) -> DataFrame:
    """Of each block, the counts of each token and its pair, and the cells of its training tokens."""

    def run(key, left, right):
        row = left.to_pylist()[0]
        b = _Block(row)
        found = sorted(right.select(["kind", "shard", "counts"]).to_pylist(), key=lambda r: (r["kind"], r["shard"]))
        word, pair = (np.concatenate([_wide(r["counts"]) for r in found if r["kind"] == k]) for k in (0, 1))
        _, place = b.pairs()
        words, contexts, pairs = word[b.tokens], word[b.context], pair[place]
        t = b.train
        bucket, p2, p1 = _cells(pairs[t] - 1, contexts[t] - 1, words[t] - 1, n - 1, types)
        q = [np.where(p > 0, np.floor(STEPS_PER_OCTAVE * np.log2(np.maximum(p, 1e-18) * (types + 1))) + 512, 0).astype(np.int64) for p in (p2, p1)]
        codes, back = np.unique((bucket << 24) + (q[0] << 12) + q[1], return_inverse=True)
        cells = [codes.astype("<u4"), np.bincount(back, minlength=len(codes)).astype("<u4"), np.bincount(back, p2, len(codes)).astype("<f4"), np.bincount(back, p1, len(codes)).astype("<f4")]
        return pa.table({**{c: [row[c]] for c in ("block", "docs", "missing", "sizes", "train")}, "words": [_narrow(words)], "pairs": [_narrow(pairs)], "cells": [b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(-1, 4).T).tobytes() for c in cells)]}, schema=pa.schema([("block", pa.int64()), *((c, pa.binary()) for c in ("docs", "missing", "sizes", "train", "words", "pairs", "cells"))]))

    both = (_dealt(df, blocks, "block").groupBy("block") for df in (coded, answers))
    return next(both).cogroup(next(both)).applyInArrow(run, FACTS)


def _cell_rows(facts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                planes = np.frombuffer(raw, np.uint8).reshape(4, 4, -1).transpose(0, 2, 1)
                c = [np.ascontiguousarray(x).view(k).ravel() for x, k in zip(planes, ("<u4", "<u4", "<f4", "<f4"), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c[0].astype(np.int64)), *(pa.array(x.astype(np.float64)) for x in c[1:])], ["cell", "n", "s2", "s1"])

    return facts.select("cells").mapInArrow(run, "cell long, n double, s2 double, s1 double").groupBy("cell").agg(*(F.sum(c).alias(c) for c in ("n", "s2", "s1")))


def learn(cells: list[tuple[int, float, float, float]], types: int, rounds: int = EM_ROUNDS) -> np.ndarray:
    """The weights (bucket; pair, word, uniform) that make the held-out tokens likeliest, by EM.

    cells: (bucket << 24, ...; tokens, sum of pair estimates, sum of word estimates). A bucket without tokens has
    the weights of all tokens together; without any token at all they are equal.
    """
    x = np.array(sorted(cells), dtype=float).reshape(-1, 4)
    bucket, n = (x[:, 0].astype(np.int64) >> 24), x[:, 1]
    p = np.stack([x[:, 2] / np.maximum(n, 1), x[:, 3] / np.maximum(n, 1), np.full(len(x), 1 / (types + 1))], axis=1)

    def em(p: np.ndarray, n: np.ndarray) -> np.ndarray:
        w = np.full(3, 1 / 3)
        for _ in range(rounds if len(n) else 0):
            part = p * w
            new = (part / part.sum(axis=1, keepdims=True) * n[:, None]).sum(axis=0) / n.sum()
            if np.abs(new - w).max() < 1e-9:
                break
            w = new
        return np.maximum(w, 1e-6) / np.maximum(w, 1e-6).sum()  # any token stays possible

    out = np.tile(em(p, n), (BUCKETS, 1))
    for b in np.unique(bucket):
        out[b] = em(p[bucket == b], n[bucket == b])
    return out


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, *, block_tokens: int = BLOCK_TOKENS, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """The log10 probabilities of every text, under the unigram base model and the mixed model.

    The model is learned from the documents that are not held out, over whole texts. A null or empty text is the end
    alone; a document without doc_id is a training one; repeated rows count and are scored each; without training
    tokens both models are uniform over one type. Columns other than doc_id and text are not read.
    """
    coded = stage(blocks(docs, block_tokens), "lm-blocks")
    size = coded.agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("blocks")).first()
    widths = _widths(max(0, int(np.ceil(np.log2(max(1, size["tokens"] or 0) / shard_tokens)))))
    answers = _resolved(_requests(coded, widths[0]), widths, 0, size["blocks"])
    sums = answers.agg(F.sum("n").alias("n"), F.sum("types").alias("types")).first()
    n, types = sums["n"] or 0, sums["types"] or 0
    release(docs.sparkSession)  # the requests have been answered
    facts = stage(_facts(coded, answers, size["blocks"], n, types), "lm-facts")
    weights = learn([tuple(r) for r in _cell_rows(facts).collect()], types)
    release(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                row = part.to_pylist()[0]
                sizes = np.frombuffer(row["sizes"], "<i8")
                words = _wide(row["words"])
                contexts = np.concatenate([words[-1:], words[:-1]])  # a block ends in an end, which is also before its first word
                bucket, p2, p1 = _cells(_wide(row["pairs"]), contexts, words, n, types)
                w = weights[bucket]
                each = np.log10(w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] / (types + 1))
                base = np.log10((words + 0.5) / (n + 0.5 * (types + 1)))
                at = np.cumsum(np.append(0, sizes[:-1]))
                missing = np.frombuffer(row["missing"], bool)
                out = [
                    pa.array(np.frombuffer(row["docs"], "<i8"), mask=missing),
                    pa.array(~np.frombuffer(row["train"], bool)),
                    pa.array(sizes),
                    pa.array(np.add.reduceat((words > 0).astype(np.int64), at)),
                    pa.array(np.full(len(sizes), n, np.int64)),
                    pa.array(np.add.reduceat(base, at)),
                    pa.array(np.add.reduceat(each, at)),
                ]
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return facts.drop("cells", "block").mapInArrow(run, SCORES)
