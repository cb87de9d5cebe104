"""Secret scans by a trigram index.

From each rule's regular expression a Boolean query over trigrams is derived: what any match must contain. A shard of
documents is indexed by the trigrams that some rule asks for: a sorted posting array for each. A rule's query
intersects and unites postings, and only the documents it leaves are scanned with the expression itself. A rule
without mandatory trigrams scans every document of the shard. Shards are slices of a task's rows, so no posting list
leaves its task and none grows with the table. Trigrams are of UTF-8 bytes with A-Z lower-cased, for the index and
the queries alike, so expressions that ignore case need no second index.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

try:
    from re import _constants as sre
    from re import _parser as sre_parse
except ImportError:  # before Python 3.11
    import sre_constants as sre
    import sre_parse

from corvex.llm._common import slices


@dataclass(frozen=True)
class Rule:
    """A kind of secret. A match counts if ``group`` has ``least`` characters; base rules go by the contract."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False

    def expression(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII)


BASE_RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]+", 0, 24, True),
)
#: Formats that nothing but a credential has; they add spans and take none away.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END (?:[A-Z]+ )*PRIVATE KEY-----)?"),
    Rule("github", r"(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{60,}"),
    Rule("slack", r"xox[abposr]-[A-Za-z0-9-]{20,}"),
    Rule("stripe", r"(?:sk|rk)_live_[A-Za-z0-9]{20,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
RULES = BASE_RULES + MORE_RULES

# --- Boolean trigram queries -----------------------------------------------------------------------------------------

#: A query: True (anything), ("tri", code), ("and", queries) or ("or", queries).
ANY = True
_EXACT = 64  # strings at most in a set that is tracked exactly


def _and(*qs):
    out = []
    for q in qs:
        if q is not ANY:
            out += q[1] if q[0] == "and" else [q]
    out = list(dict.fromkeys(out))
    return ANY if not out else out[0] if len(out) == 1 else ("and", tuple(out))


def _or(*qs):
    if any(q is ANY for q in qs):
        return ANY
    out = []
    for q in qs:
        out += q[1] if q[0] == "or" else [q]
    out = list(dict.fromkeys(out))
    return out[0] if len(out) == 1 else ("or", tuple(out))


def _of_string(s: bytes):
    return _and(*(("tri", s[i] << 16 | s[i + 1] << 8 | s[i + 2]) for i in range(len(s) - 2)))


def _of_set(strings: set[bytes]):
    return _or(*(_of_string(s) for s in strings)) if strings else ANY


@dataclass
class _Part:
    """What matches of an expression are known to be: all of ``exact`` if it is a set; else starts, ends, a query."""

    exact: set[bytes] | None
    head: set[bytes]
    tail: set[bytes]
    query: object = ANY

    def loose(self) -> _Part:
        if self.exact is None:
            return self
        return _Part(None, {s[:2] for s in self.exact}, {s[-2:] if s else b"" for s in self.exact}, _and(self.query, _of_set(self.exact)))


_FREE = _Part(None, {b""}, {b""})


def _cat(a: _Part, b: _Part) -> _Part:
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= _EXACT:
        return _Part({x + y for x, y in product(a.exact, b.exact)}, set(), set(), _and(a.query, b.query))
    head = {x + y for x, y in product(a.exact, b.exact if b.exact is not None else b.head)} if a.exact is not None and len(a.exact) * len(b.exact if b.exact is not None else b.head) <= _EXACT else None
    tail = {x + y for x, y in product(a.exact if a.exact is not None else a.tail, b.exact)} if b.exact is not None and len(b.exact) * len(a.exact if a.exact is not None else a.tail) <= _EXACT else None
    left = a.exact if a.exact is not None else a.tail
    right = b.exact if b.exact is not None else b.head
    across = _of_set({x + y for x, y in product(left, right)}) if len(left) * len(right) <= _EXACT else ANY
    la, lb = a.loose(), b.loose()
    return _Part(None, head if head is not None else la.head, tail if tail is not None else lb.tail, _and(la.query, lb.query, across, _of_set(head) if head else ANY, _of_set(tail) if tail else ANY))


def _alt(parts: list[_Part]) -> _Part:
    if all(p.exact is not None for p in parts) and sum(len(p.exact) for p in parts) <= _EXACT:
        return _Part(set().union(*(p.exact for p in parts)), set(), set(), _or(*(p.query for p in parts)))
    ps = [p.loose() for p in parts]
    heads, tails = set().union(*(p.head for p in ps)), set().union(*(p.tail for p in ps))
    return _Part(None, heads if len(heads) <= _EXACT else {b""}, tails if len(tails) <= _EXACT else {b""}, _or(*(p.query for p in ps)))


def _class(items, flags: int) -> _Part:
    chars: set[bytes] = set()
    for op, arg in items:
        if op is sre.LITERAL:
            chars.add(chr(arg).lower().encode() if arg < 128 else chr(arg).encode())
        elif op is sre.RANGE and arg[1] - arg[0] < _EXACT and arg[1] < 128:
            chars.update(chr(c).lower().encode() for c in range(arg[0], arg[1] + 1))
        else:
            return _FREE
    return _Part(chars, set(), set()) if len(chars) <= 8 else _FREE


def _walk(tree, flags: int) -> _Part:
    out = _Part({b""}, set(), set())
    for op, arg in tree:
        if op is sre.LITERAL:
            fold = arg >= 128 and flags & re.IGNORECASE
            p = _FREE if fold else _Part({(chr(arg).lower() if arg < 128 else chr(arg)).encode()}, set(), set())
        elif op is sre.IN:
            p = _class(arg, flags)
        elif op is sre.SUBPATTERN:
            p = _walk(arg[3], (flags | arg[1]) & ~arg[2])
        elif op is sre.BRANCH:
            p = _alt([_walk(x, flags) for x in arg[1]])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, getattr(sre, "POSSESSIVE_REPEAT", None)):
            low, high, inner = arg
            p = _walk(inner, flags)
            if low == 0:
                p = _alt([_Part({b""}, set(), set()), p]) if high == 1 else _FREE
            elif not (low == high == 1):
                once = p
                for _ in range(min(low, 3) - 1):
                    p = _cat(p, once)
                if low > 3 or high != low:
                    p = p.loose()
                    p = _Part(None, p.head, p.tail, p.query)
        elif op is sre.AT:
            continue
        else:
            p = _FREE
        out = _cat(out, p)
    return out


def trigram_query(pattern: str):
    """The Boolean trigram query that every text with a match of pattern satisfies; True if there is none."""
    tree = sre_parse.parse(pattern, re.ASCII)
    return _walk(tree, tree.state.flags).loose().query


def trigrams(query) -> set[int]:
    if query is ANY:
        return set()
    return {query[1]} if query[0] == "tri" else set().union(*(trigrams(q) for q in query[1]))


_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32


class Shard:
    """The postings of a slice of documents for the wanted trigrams."""

    def __init__(self, texts: list[bytes], slot: np.ndarray, wanted: int):
        self.size = len(texts)
        flat = _LOWER[np.frombuffer(b"\x00\x00".join(texts), dtype=np.uint8)]
        starts = np.cumsum([0, *(len(t) + 2 for t in texts[:-1])])
        if flat.size >= 3:
            code = flat[:-2] << np.uint32(16)
            code |= flat[1:-1] << np.uint32(8)
            code |= flat[2:]
            of = slot[code]
            at = np.flatnonzero(of)
            pair = np.unique(of[at].astype(np.int64) * self.size + np.searchsorted(starts, at, side="right") - 1)
        else:
            pair = np.zeros(0, dtype=np.int64)
        edge = np.searchsorted(pair, np.arange(1, wanted + 2, dtype=np.int64) * self.size)
        self.postings = [pair[a:b] % self.size for a, b in zip(edge, edge[1:], strict=False)]

    def find(self, query, slot_of: dict[int, int]) -> np.ndarray:
        """The documents that satisfy query, in order."""
        if query is ANY:
            return np.arange(self.size)
        if query[0] == "tri":
            return self.postings[slot_of[query[1]] - 1]
        if query[0] == "or":
            return np.unique(np.concatenate([self.find(q, slot_of) for q in query[1]]))
        out = None
        for found in sorted((self.find(q, slot_of) for q in query[1]), key=len):
            out = found if out is None else np.intersect1d(out, found, assume_unique=True)
            if not out.size:
                break
        return out


class Scanner:
    """Rules with their queries, and the table from trigram to posting list."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = [(r, self._fast(r), trigram_query(r.pattern)) for r in rules]
        codes = sorted(set().union(*(trigrams(q) for *_, q in self.rules)))
        self.slot_of = {c: i for i, c in enumerate(codes, 1)}
        self.slot = np.zeros(1 << 24, dtype=np.uint8 if len(codes) < 255 else np.uint16)
        self.slot[codes] = np.arange(1, len(codes) + 1)

    @staticmethod
    def _fast(rule: Rule) -> re.Pattern:
        """A run of one class that must be long is looked for as such; its matches are the same."""
        m = re.fullmatch(r"(\[[^\]]+\])\+", rule.pattern)
        return re.compile(f"{m[1]}{{{rule.least},}}" if m and not rule.group else rule.pattern, re.ASCII)

    def scan(self, texts: list[str]) -> list[list[tuple[str, int, int]]]:
        """Of each text, the spans (kind, start, end) in code points, by start and then in the order of the rules."""
        shard = Shard([t.encode("utf-8", "surrogatepass") for t in texts], self.slot, len(self.slot_of))
        out: list[list[tuple[int, int, str, int]]] = [[] for _ in texts]
        for order, (rule, expression, query) in enumerate(self.rules):
            for i in shard.find(query, self.slot_of).tolist():
                for m in expression.finditer(texts[i]):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        out[i].append((m.start(), order, rule.kind, m.end()))
        return [[(kind, start, end) for start, _, kind, end in sorted(found)] for found in out]


_scanners: dict[tuple[Rule, ...], Scanner] = {}


def scanner(rules: tuple[Rule, ...]) -> Scanner:
    if rules not in _scanners:
        _scanners[rules] = Scanner(rules)
    return _scanners[rules]


SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def _spans_array(found: list[list[tuple[str, int, int]]]) -> pa.Array:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    return pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in f] for f in found], kind)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and ``spans``, an array of (kind, start, end), for each row of docs.

    Offsets are code points of the whole text, the end exclusive. A null or empty text has no spans. Equal rows give
    equal rows, an empty table an empty one; columns other than doc_id and text are not read.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scanner(rules)
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), _spans_array(s.scan(part.column(1).to_pylist()))], ["doc_id", "spans"])

    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, spans {SPANS}")


def redact_text(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each maximal run of overlapping spans replaced by a mark that names the first span's kind."""
    out, at, upto = [], 0, -1
    for kind, start, end in spans:
        if start >= upto:
            out += [text[at:start] if start >= at else "", f"[{kind.upper()}]"]
        upto = max(upto, end)
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mask: Callable[[str, list], str] = redact_text) -> DataFrame:
    """docs with the spans of every text masked, all columns kept; a text without spans, or null, stays as it is."""
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scanner(rules)
        for batch in batches:
            for part in slices(batch):
                texts = part.column(at).to_pylist()
                found = s.scan([t or "" for t in texts])
                new = [mask(t, f) if f else t for t, f in zip(texts, found, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if i == at else part.column(i) for i in range(len(names))], names)

    return docs.mapInArrow(run, docs.schema)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(docs: DataFrame) -> DataFrame:
    """Of each document, the counts and the digest of the base spans, and all spans."""
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in BASE_RULES]))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scan(docs).select("doc_id", *(count(r.kind) for r in BASE_RULES), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
