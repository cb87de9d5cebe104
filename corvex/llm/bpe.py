"""BPE encoding and decoding. A segment tree over the ranks of adjacent pairs picks each merge.

A leaf holds ``rank * width + position`` of the pair that starts there, an inner node the smaller of its children. The
root therefore names the leftmost pair of the lowest rank. A merge changes three leaves at most, so a word of n
symbols takes O(n log n) steps, whatever its length.

The scheme is that of ``word_bpe_49k.json``: NFC, white space to one space, lower case, a split into letter runs,
single digits and other runs, bytes as letters, ``</w>`` on each last symbol. Texts are cut at white space, where no
token can cross, and the ids of short words are memoised in a table of bounded size.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvex.llm._common import slices

_BITS = 17
_MASK = (1 << _BITS) - 1
_NONE = 1 << 62
#: Entries of a worker's table of words, and the longest word that enters it.
MEMO_WORDS, MEMO_CHARS = 600_000, 40


def default_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def merge(ids: list[int], pairs: dict[int, int]) -> list[int]:
    """Applies merges to ids until no pair is in ``pairs``, the lowest rank first, the leftmost of equals first.

    pairs: ``left << 17 | right`` to ``rank << 17 | merged``.
    """
    n = len(ids)
    if n < 2:
        return ids
    width = 1 << (n - 1).bit_length()
    tree = [_NONE] * (2 * width)
    for i in range(n - 1):
        found = pairs.get(ids[i] << _BITS | ids[i + 1])
        if found is not None:
            tree[width + i] = (found >> _BITS) * width + i
    for i in range(width - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b

    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    low = width - 1

    def put(i: int, key: int) -> None:
        i += width
        tree[i] = key
        while i > 1:
            i >>= 1
            a, b = tree[2 * i], tree[2 * i + 1]
            least = a if a < b else b
            if tree[i] == least:
                return
            tree[i] = least

    while tree[1] < _NONE:
        i = tree[1] & low
        j = after[i]
        ids[i] = pairs[ids[i] << _BITS | ids[j]] & _MASK
        ids[j] = -1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            found = pairs.get(ids[i] << _BITS | ids[k])
        else:
            found = None
        if tree[width + j] != _NONE:
            put(j, _NONE)
        put(i, _NONE if found is None else (found >> _BITS) * width + i)
        h = before[i]
        if h >= 0:
            found = pairs.get(ids[h] << _BITS | ids[i])
            put(h, _NONE if found is None else (found >> _BITS) * width + h)
    return [x for x in ids if x >= 0]


class Forest:
    """Segment trees of many short words, merged in step: one numpy operation serves the same level of all trees."""

    WIDTHS = (8, 16, 32, 64)

    def __init__(self, pairs: dict[int, int]):
        keys = np.array(sorted(pairs), dtype=np.int64)
        self.keys = np.append(keys, np.int64(1) << 62)
        self.found = np.array([pairs[k] for k in keys.tolist()] + [0], dtype=np.int64)

    def look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ranks of pairs (_NONE: not mergeable), and what they become."""
        key = left << _BITS | right
        at = np.searchsorted(self.keys, key)
        found, hit = self.found[at], self.keys[at] == key
        return np.where(hit, found >> _BITS, _NONE), found & _MASK

    def merge(self, words: list[list[int]]) -> list[list[int]]:
        """Of each list of ids, what is left of it when all is merged."""
        size = np.array([len(w) for w in words], dtype=np.int64)
        flat, size = self.merge_flat(np.fromiter((x for w in words for x in w), dtype=np.int64, count=int(size.sum())), size)
        flat, ends = flat.tolist(), np.cumsum(size).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def merge_flat(self, ids: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same of lists that lie side by side, of these lengths; longer ones than the widest tree stay as they are."""
        start = np.cumsum(size) - size
        length, found, least = size.copy(), [], 1
        for width in self.WIDTHS:
            rows = np.flatnonzero((size >= least) & (size <= width))
            least = width + 1
            for at in range(0, len(rows), 1 << 14):
                some = rows[at : at + (1 << 14)]
                inside = np.arange(width)[None, :] < size[some, None]
                table = np.full((len(some), width + 1), _MASK, dtype=np.int64)  # _MASK is no token: its pairs never merge
                table[:, :width][inside] = ids[(start[some, None] + np.arange(width))[inside]]
                keep = self._merge(table, width) & inside
                length[some] = keep.sum(axis=1)
                found.append((some, table[:, :width][keep]))
        rows = np.flatnonzero(size >= least)
        if len(rows):
            found.append((rows, ids[_ranges(start[rows], size[rows])]))
        out, to = np.empty(int(length.sum()), np.int64), np.cumsum(length) - length
        for some, part in found:
            out[_ranges(to[some], length[some])] = part
        return out, length

    def _merge(self, ids: np.ndarray, width: int) -> np.ndarray:
        """Merges in place; returns which places still have an id."""
        n = len(ids)
        rank, new = self.look(ids[:, :-1], ids[:, 1:])
        tree = np.full((n, 2 * width), _NONE, dtype=np.int64)
        tree[:, width:] = np.where(rank < _NONE, rank * width + np.arange(width), _NONE)
        k = width
        while k > 1:
            k >>= 1
            tree[:, k : 2 * k] = np.minimum(tree[:, 2 * k : 4 * k : 2], tree[:, 2 * k + 1 : 4 * k : 2])
        after = np.tile(np.arange(1, width + 2), (n, 1))
        before = np.tile(np.arange(-1, width), (n, 1))
        before[:, 0] = width
        while (row := np.nonzero(tree[:, 1] < _NONE)[0]).size:
            i = tree[row, 1] & (width - 1)
            j = after[row, i]
            k, h = after[row, j], before[row, i]
            ids[row, i] = new[row, i]
            ids[row, j] = -1
            after[row, i] = k
            before[row, k] = i
            rank, made = self.look(ids[row, i], ids[row, k])
            new[row, i] = made
            tree[row, width + j] = _NONE
            tree[row, width + i] = np.where(rank < _NONE, rank * width + i, _NONE)
            left = h < width
            rank, made = self.look(ids[row, h], ids[row, i])
            rl, hl = row[left], h[left]
            new[rl, hl] = made[left]
            tree[rl, width + hl] = np.where(rank[left] < _NONE, rank[left] * width + hl, _NONE)
            for r, leaf in ((row, width + j), (row, width + i), (rl, width + hl)):
                node = leaf >> 1
                while node.size and node[0] >= 1:  # all leaves are at one depth
                    tree[r, node] = np.minimum(tree[r, 2 * node], tree[r, 2 * node + 1])
                    node = node >> 1
        return ids[:, :width] >= 0


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of the given ranges, one range after the other."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where it is printable, else one above U+00FF."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, more = [""] * 256, 256
    for b in range(256):
        if b in own:
            out[b] = chr(b)
        else:
            out[b], more = chr(more), more + 1
    return out


class SegmentTreeBPE:
    """An encoder and decoder for a tokenizer file in JSON with word ends."""

    #: Letters of which libraries may think differently, and controls that only Python takes for white space.
    _ODD = re.compile("[\x1c-\x1f\u0250-\U0010ffff" + "".join(c for c in map(chr, range(0x250)) if max(c.lower()) > "\u024f") + "]")
    _SPACED = re.compile("[\x1c-\x1f]")

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.end = spec["model"].get("end_of_word_suffix") or ""
        self.tokens = [""] * (1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]))
        for token, i in vocab.items():
            self.tokens[i] = token
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, i in self.added.items():
            self.tokens[i] = token
        self.pairs: dict[int, int] = {}
        for rank, (a, b) in enumerate(spec["model"]["merges"]):
            key = vocab[a] << _BITS | vocab[b]
            self.pairs[key] = rank << _BITS | vocab[a + b]
        self.forest = Forest(self.pairs)
        letters = byte_letters()
        self.inner = [vocab.get(x) for x in letters]
        self.last = [vocab.get(x + self.end) for x in letters]
        self.of_letter = {x: b for b, x in enumerate(letters)}
        self.complete = None not in self.inner and None not in self.last
        self.inner_ids, self.last_ids = (np.array([x or 0 for x in some], dtype=np.int64) for some in (self.inner, self.last))
        self.marked = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+|\n").findall
        self.at_added = re.compile("|".join(re.escape(x) for x in sorted(self.added, key=len, reverse=True)))
        library = Tokenizer.from_file(path)
        self.normalize, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.memo: dict[str, bytes] = {}

    def _symbols(self, raw: bytes) -> list[int]:
        ids = [self.inner[b] for b in raw[:-1]]
        ids.append(self.last[raw[-1]])
        return [x for x in ids if x is not None]

    def _words(self, words: list[str]) -> list[bytes]:
        """The ids of words, as 32-bit integers. A word may be any text; white space in it only separates pieces."""
        plain = [not self._ODD.search(w) and self.complete for w in words]
        easy = iter(self._plain_words([w for w, p in zip(words, plain, strict=True) if p]))
        odd = iter(self._odd_words([w for w, p in zip(words, plain, strict=True) if not p]))
        return [next(easy) if p else next(odd) for p in plain]

    def _plain_words(self, words: list[str]) -> list[bytes]:
        """Of words without white space and odd letters, all at once: a newline ends each."""
        if not words:
            return []
        found = self.marked("\n".join([*words, ""]).lower())
        number = {x: i for i, x in enumerate(dict.fromkeys(found))}
        at = np.array(list(map(number.__getitem__, found)), dtype=np.int64)
        pieces = [x.encode() for x in number]
        raw, size = np.frombuffer(b"".join(pieces), np.uint8), np.array(list(map(len, pieces)), dtype=np.int64)
        ids, ends = self.inner_ids[raw], np.cumsum(size)
        ids[ends - 1] = self.last_ids[raw[ends - 1]]
        newline = number["\n"]
        flat, length = self.forest.merge_flat(ids, size)
        if (size > Forest.WIDTHS[-1]).any():
            each = np.split(flat, np.cumsum(length)[:-1])
            for i in np.flatnonzero(size > Forest.WIDTHS[-1]).tolist():
                each[i] = np.array(merge(each[i].tolist(), self.pairs), dtype=np.int64)
            flat, length = np.concatenate(each), np.array(list(map(len, each)), dtype=np.int64)
        start, length = np.cumsum(length) - length, np.where(np.arange(len(length)) == newline, 0, length)
        out = flat[_ranges(start[at], length[at])].astype("<u4").tobytes()
        ends = (4 * np.cumsum(length[at])[at == newline]).tolist()
        return [out[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _odd_words(self, words: list[str]) -> list[bytes]:
        """Of any words: libraries may think differently of their letters, so that the library itself splits them."""
        of = self.of_letter
        split = [[bytes(of[c] for c in x) for x, _ in self.split(self.normalize(w))] for w in words]
        some = dict.fromkeys(x for w in split for x in w)
        symbols = [self._symbols(x) for x in some]
        ids = self.forest.merge(symbols)
        for i, x in enumerate(symbols):
            if len(x) > Forest.WIDTHS[-1]:
                ids[i] = merge(x, self.pairs)
        some = {x: np.array(v, dtype="<u4").tobytes() for x, v in zip(some, ids, strict=True)}
        return [b"".join([some[x] for x in w]) for w in split]

    def _units(self, text: str) -> list[str]:
        if not self._ODD.search(text):
            return text.lower().split()  # fewer words differ
        return [text] if self._SPACED.search(text) else text.split()

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as 32-bit integers. Words that the table lacks are merged together."""
        get = self.memo.get
        units, parts, lacking = [], [], {}
        for t in texts:
            if "<|" in t and (hits := list(self.at_added.finditer(t))):
                u, p, at = [], [], 0
                for m in hits:
                    u += [*self._units(t[at : m.start()]), None]
                    at = m.end()
                u += self._units(t[at:])
                added = iter(hits)
                p = [np.array([self.added[next(added)[0]]], dtype="<u4").tobytes() if w is None else get(w) for w in u]
            else:
                u = self._units(t)
                p = list(map(get, u))
            if None in p:
                lacking.update((w, None) for w, x in zip(u, p, strict=True) if x is None)
            units.append(u)
            parts.append(p)
        if lacking:
            lacking = dict(zip(lacking, self._words(list(lacking)), strict=True))
            for w, x in lacking.items():
                if len(w) <= MEMO_CHARS and len(self.memo) < MEMO_WORDS:
                    self.memo[w] = x
            parts = [[lacking[w] if x is None else x for w, x in zip(u, p, strict=True)] if None in p else p for u, p in zip(units, parts, strict=True)]
        return [b"".join(p) for p in parts]

    def encode_bytes(self, text: str) -> bytes:
        return self.encode_many([text])[0]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), dtype="<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """As the library without a decoder: the tokens joined by one space, special ones included."""
        return " ".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def model(path: str) -> SegmentTreeBPE:
    return SegmentTreeBPE(path)


def as_lists(values: list[bytes], kind: str = "<i4") -> pa.ListArray:
    """Id bytes as one Arrow list array, without a Python object for each id."""
    flat = np.frombuffer(b"".join(values), dtype=kind)
    ends = np.cumsum([0, *(len(v) // flat.itemsize for v in values)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))


def encode(docs: DataFrame, path: str | None = None, *, key: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """``key``, ``ids array<int>`` and, if asked for, ``decoded string`` made from those ids, for each row of docs.

    A null text is empty and has no ids; very long texts and words are encoded whole; equal rows give equal rows; an
    empty table gives an empty one. Other columns of docs are not read, so their names can't clash.
    """
    path = path or default_path()
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path)
        for batch in batches:
            for part in slices(batch):
                ids = bpe.encode_many(part.column(1).to_pylist())
                out = [part.column(0), as_lists(ids)]
                if decoded:
                    out.append(pa.array([bpe.decode(np.frombuffer(x, dtype="<u4").tolist()) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(out, ["key", "ids", "decoded"][: len(out)])

    out = rows.mapInArrow(run, f"key {kind}, ids array<int>" + ", decoded string" * decoded)
    return out.withColumnRenamed("key", key)


def decode(df: DataFrame, path: str | None = None, *, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key`` and ``decoded string`` for each row of ids; a null array is empty, and null ids are left out."""
    path = path or default_path()
    rows = df.select(F.col(key).alias("key"), F.expr(f"coalesce(filter(`{ids}`, x -> x is not null), array())").cast("array<int>").alias("ids"))
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path)
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([bpe.decode(x) for x in part.column(1).to_pylist()], pa.string())], ["key", "decoded"])

    return rows.mapInArrow(run, f"key {kind}, decoded string").withColumnRenamed("key", key)


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Of each document, the number of ids and the SHA-256 of the ids and of what they decode to."""
    done = encode(docs, path, decoded=True)
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
