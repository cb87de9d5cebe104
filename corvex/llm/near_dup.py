"""Near-duplicate detection by SetSketch registers over word shingles.

A set's sketch has M registers: register i is floor(1 - log_b h), cut to 0..Q+1, for the least h among exponentially
distributed hashes h_i of its elements. Registers of a union are the maxima of the sets' registers, so sketches merge;
equal registers are the likelier the more similar the sets are, so bands of them make candidates. Candidates are held
against the joint likelihood of their registers given both sizes, and those that may reach the threshold are verified
on their full shingle sets.

Documents with one shingle set form a class, numbered by itself; only classes are compared. Pairs inside a
bucket of a band are never all made. Each round elects one leader in each bucket that still holds several components,
another in each band and round, and pairs it with the members outside its component: as many pairs as members. Links
found join components, and buckets of one component are done. After the rounds, buckets of up to ``SMALL`` members
make all their pairs across components. The members of larger ones are joined by exact prefixes instead: with shingles
in one order for all, rare ones first, sets that reach the threshold share one of their first few, and drifting copies
below it don't, as those are their own. Counts for the order are kept in ``SLOTS`` slots, whatever the corpus: any order
finds every pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.dataset
import pyarrow.fs
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvex.llm._common import fresh_path, slices, stage, utf8
from corvex.llm.components import components

M, ROWS = 252, 6
BANDS = M // ROWS
BASE, RATE, Q = 1.001, 20.0, (1 << 16) - 2
WORDS, THRESHOLD = 5, 80
ROUNDS, SMALL, SLOTS = 3, 48, 1 << 20
#: Of a shared token, members outside its main component that one task holds against all, about.
OTHERS = 256
#: Below the threshold by five standard errors of the estimate.
MARGIN = 5 * (0.8 * 0.2 / M) ** 0.5

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MULT = (np.random.default_rng(20_240_229).integers(0, 1 << 31, M, dtype=np.uint64) * 2 + 1).astype(np.uint32)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes, words: int) -> np.ndarray:
    """The sorted 64-bit hashes of a text's distinct shingles. Words are runs without blanks, A-Z lower-cased.

    With fewer words than a shingle has, all of them are one; without words there is none.
    """
    found = text.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    h = np.array(list(map(xxhash.xxh3_64_intdigest, found)), dtype=np.uint64)
    k = min(words, len(h))
    n = len(h) - k + 1
    out = h[:n].copy()
    for i in range(1, k):
        out *= _ODD
        out += h[i : i + n]
    return np.unique(_mix(out + np.uint64(k)))


def registers(elements: np.ndarray) -> np.ndarray:
    """The SetSketch registers of a non-empty set of 64-bit hashes."""
    least = np.full(M, 0xFFFFFFFF, np.uint32)
    half = M // 2
    low, high = elements.astype(np.uint32), (elements >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(elements), 512):
        a = np.multiply.outer(low[at : at + 512], _MULT[:half]).min(axis=0)
        b = np.multiply.outer(high[at : at + 512], _MULT[half:]).min(axis=0)
        np.minimum(least, np.concatenate([a, b]), out=least)
    h = -np.log1p(-(least.astype(np.float64) + 0.5) / 4294967296.0) / RATE
    return np.clip(np.floor(1 - np.log(h) / np.log(BASE)), 0, Q + 1).astype(np.uint16)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The registers of the union of two sketched sets."""
    return np.maximum(a, b)


_GRID = np.linspace(0.0, 1.0, 401)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """The Jaccard similarities of pairs of sketched sets of known sizes, by maximum joint likelihood.

    a, b: (pairs, M). Given similarity j, a register of a is larger with probability p(u - v j), that of b with
    p(v - u j), for the shares u and v of the sizes, and p(x) = -log_b(1 - x (b - 1) / b).
    """
    up, down = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - up - down
    u = (na / (na + nb))[:, None]
    v = 1 - u
    j = np.minimum(_GRID[None, :], np.minimum(u / v, v / u))  # no larger similarity is possible
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    more, less = p(u - v * j), p(v - u * j)
    log = lambda x: np.log(np.maximum(x, 1e-12))
    fit = up[:, None] * log(more) + down[:, None] * log(less) + same[:, None] * log(1 - more - less)
    return j[np.arange(len(fit)), fit.argmax(axis=1)]


def sketches(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, h (a hash of the text), n_shingles, hi and lo (a 128-bit hash of the whole set) and the registers of each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                n, hashes, regs = [], [], []
                for text in utf8(part.column(2)):
                    s = shingles(text, words)
                    n.append(len(s))
                    hashes.append(xxhash.xxh3_128_digest(s.tobytes()))
                    regs.append(registers(s).tobytes() if len(s) else b"")
                both = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), pa.array(regs, pa.binary())], ["doc_id", "h", "n_shingles", "hi", "lo", "regs"])

    return _keyed(docs).mapInArrow(run, "doc_id long, h long, n_shingles long, hi long, lo long, regs binary")


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, h and text: what tells rows apart, so that rows of one id and different texts are documents of their own."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")


def _bands(reps: DataFrame) -> DataFrame:
    """key, rep: the bucket of each band, a hash of the band's number and registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 4096):
                regs = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint16).reshape(-1, BANDS, ROWS).astype(np.uint64)
                key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), regs.shape[:2])
                for i in range(ROWS):
                    key = _mix(key * _ODD + regs[:, :, i] + np.uint64(1))
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(part.column(0).to_numpy(), BANDS))], ["key", "rep"])

    return reps.select("rep", "regs").mapInArrow(run, "key long, rep long")


def _verified(pairs: DataFrame, texts: DataFrame, words: int, threshold: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the threshold."""
    a = texts.select(F.col("rep").alias("a"), F.col("n_shingles").alias("na"), F.col("regs").alias("ra"), F.col("text").alias("ta"))
    b = texts.select(F.col("rep").alias("b"), F.col("n_shingles").alias("nb"), F.col("regs").alias("rb"), F.col("text").alias("tb"))
    near = f"100 * least(na, nb) >= {threshold} * greatest(na, nb)"
    rows = pairs.join(a, "a").join(b, "b").filter(near).select("a", "b", "na", "nb", "ra", "rb", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                col = lambda i, part=part: part.column(i)
                ra, rb = (np.frombuffer(b"".join(col(i).to_pylist()), np.uint16).reshape(-1, M) for i in (4, 5))
                likely = np.flatnonzero(estimate(ra, rb, col(2).to_numpy().astype(float), col(3).to_numpy().astype(float)) >= threshold / 100 - MARGIN)
                held, out = {}, []
                pa_, pb = col(0).to_pylist(), col(1).to_pylist()
                for i in likely.tolist():
                    sets = []
                    for node, column in ((pa_[i], 6), (pb[i], 7)):
                        if node not in held:
                            if len(held) > 64:
                                held.clear()
                            held[node] = shingles(col(column)[i].as_py().encode(), words)
                        sets.append(held[node])
                    x, y = sets
                    common = np.intersect1d(x, y, assume_unique=True).size
                    if 100 * common >= threshold * (len(x) + len(y) - common):
                        out.append(i)
                yield pa.RecordBatch.from_arrays([col(0).take(pa.array(out, pa.int64())), col(1).take(pa.array(out, pa.int64()))], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def _leaders(members: DataFrame, labels: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b) of a bucket's leader and the members of other components, each once, in buckets that have such.

    The leader is that with the least doc_id XOR key: another one in each band and turn.
    """
    m = members.join(labels, "rep")
    mask = F.xxhash64("key", F.lit(turn))
    lead = m.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min(F.col("rep").bitwiseXOR(mask)).alias("x")).filter("low != high").select("key", F.col("x").bitwiseXOR(mask).alias("a"))
    lead = lead.join(labels.select(F.col("rep").alias("a"), F.col("label").alias("of")), "a")
    return m.join(lead, "key").filter("label != of").groupBy("a", F.col("rep").alias("b")).agg(F.count(F.lit(1)).alias("hits"))


def _all_pairs(members: DataFrame, labels: DataFrame, small: int) -> DataFrame:
    """All pairs across components in buckets of up to ``small`` members, each in the first bucket that both are in."""
    m = members.join(labels, "rep")
    open_ = m.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("c")).filter(f"low != high and c <= {small}").select("key")
    m = stage(m.join(open_, "key"), "near-open")
    m = m.join(m.groupBy("rep").agg(F.collect_set("key").alias("keys")), "rep")
    a, b = (m.select("key", F.col("rep").alias(x), F.col("label").alias(f"label_{x}"), F.col("keys").alias(f"keys_{x}")) for x in "ab")
    first = F.array_min(F.array_intersect("keys_a", "keys_b")) == a["key"]
    return a.join(b, (a["key"] == b["key"]) & (F.col("a") < F.col("b")) & (F.col("label_a") != F.col("label_b")) & first).select("a", "b")


class _Search:
    def __init__(self, members: DataFrame, texts: DataFrame, words: int, threshold: int):
        self.members, self.texts, self.words, self.threshold = members, texts, words, threshold
        self.labels = stage(texts.select("rep", F.col("rep").alias("label")), "near-labels")
        self.tried: DataFrame | None = None

    def link(self, pairs: DataFrame) -> bool:
        """Verifies pairs that were not tried before, and joins the components of those that hold."""
        if self.tried is not None:
            pairs = pairs.join(self.tried, ["a", "b"], "left_anti")
        pairs = stage(pairs.select("a", "b"), "near-pairs")
        if pairs.isEmpty():
            return False
        self.tried = pairs if self.tried is None else self.tried.union(pairs)
        links = _verified(pairs, self.texts, self.words, self.threshold)
        of = lambda x: self.labels.select(F.col("rep").alias(x), F.col("label").alias(f"label_{x}"))
        links = stage(links.join(of("a"), "a").join(of("b"), "b").filter("label_a != label_b").select("label_a", "label_b").distinct(), "near-links")
        if not links.isEmpty():
            found = components(links, "label_a", "label_b").select(F.col("node").alias("label"), F.col("label").alias("new"))
            self.labels = stage(self.labels.join(found, "label", "left").select("rep", F.coalesce("new", "label").alias("label")), "near-labels")
        return True


def _labelled(docs: DataFrame, words: int, threshold: int) -> DataFrame:
    """doc_id, h, n_shingles, label and component_id of each row; rows without shingles have no label."""
    sk = stage(sketches(docs, words), "near-sketches")
    some = sk.filter("n_shingles > 0")
    # a class is a shingle set, and a row of its least doc_id stands for it
    sets = some.groupBy("hi", "lo").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("own"), F.first("n_shingles").alias("n_shingles"), F.first("regs").alias("regs"))
    reps = stage(sets.select("hi", "lo", F.col("own.doc_id").alias("least"), F.col("own.h").alias("h"), "n_shingles", "regs", F.monotonically_increasing_id().alias("rep")), "near-classes")

    bands = _bands(reps)
    shared = bands.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("key")
    members = stage(bands.join(shared, "key"), "near-members")
    held = reps.join(members.select("rep").distinct(), "rep", "left_semi").select("rep", "n_shingles", "regs", "least", F.col("h").alias("of"))
    rows = _keyed(docs)
    texts = rows.join(held, (rows["h"] == held["of"]) & rows["doc_id"].eqNullSafe(held["least"])).dropDuplicates(["rep"])
    texts = stage(texts.select("rep", "n_shingles", "regs", "text"), "near-texts")

    s = _Search(members, texts, words, threshold)
    pairs = stage(_leaders(members, s.labels, 0), "near-candidates")
    best = pairs.groupBy("b").agg(F.max(F.struct("hits", F.col("a"))).alias("best")).select(F.col("best.a").alias("a"), "b")
    s.link(best)
    of = lambda x: s.labels.select(F.col("rep").alias(x), F.col("label").alias(f"label_{x}"))
    s.link(pairs.join(of("a"), "a").join(of("b"), "b").filter("label_a != label_b"))
    for turn in range(1, ROUNDS):
        if not s.link(_leaders(s.members, s.labels, turn)):
            break
    s.link(_all_pairs(s.members, s.labels, SMALL))
    s.link(_by_prefixes(s))

    of_class = stage(reps.select("rep", "hi", "lo", "least").join(s.labels, "rep", "left").select("hi", "lo", "least", F.coalesce("label", "rep").alias("label")), "near-labels")
    least = of_class.groupBy("label").agg(F.min("least").alias("component_id"))
    known = of_class.select("hi", "lo", "label").join(least, "label")
    out = some.select("doc_id", "h", "n_shingles", "hi", "lo").join(known, ["hi", "lo"]).drop("hi", "lo")
    none = sk.filter("n_shingles = 0").select("doc_id", "h", "n_shingles", F.lit(None).cast("long").alias("label"), F.col("doc_id").alias("component_id"))
    return out.select(*none.columns).union(none)


def classes(docs: DataFrame, *, words: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of docs.

    Two documents are linked if 100 * (shingles of both) >= threshold * (shingles of either); component_id is the
    smallest doc_id reachable by links, and kept is whether it is the document's own. A null or empty text, or one
    of blanks alone, has no shingles and no links. Rows of one doc_id and text count as one document, and rows of one
    doc_id with different texts are compared each; a null doc_id is compared like others, but is never a component_id,
    unless the component has no other. An empty table gives no rows.
    """
    found = _labelled(docs, words, threshold).select("doc_id", "n_shingles", "component_id")
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


@lru_cache(maxsize=2)
def _counts_at(path: str) -> np.ndarray:
    fs, inner = pa.fs.FileSystem.from_uri(path)
    found = pyarrow.dataset.dataset(inner, filesystem=fs, format="parquet", schema=pa.schema([("slot", pa.int64()), ("c", pa.int64())])).to_table()
    out = np.zeros(SLOTS, np.int64)
    out[found["slot"].to_numpy()] = found["c"].to_numpy()
    return out


def _by_prefixes(s: _Search) -> DataFrame:
    """Pairs (a, b) across components, each once, that may reach the threshold, among members of large open buckets."""
    words, threshold = s.words, s.threshold
    m = s.members.join(s.labels, "rep")
    large = m.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("c")).filter(f"low != high and c > {SMALL}").select("key")
    inside = s.members.join(large, "key").select("rep").distinct()
    own = stage(s.texts.select("rep", "text").join(inside, "rep", "left_semi").join(s.labels, "rep").select("rep", "text", "label"), "near-dense")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for part in slices(batch):
                for text in utf8(part.column(1)):
                    total = np.zeros(SLOTS, np.int64) if total is None else total
                    np.add.at(total, (shingles(text, words) & np.uint64(SLOTS - 1)).astype(np.int64), 1)
        if total is not None:
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["slot", "c"])

    path = fresh_path(own.sparkSession, "near-counts")
    own.mapInArrow(count, "slot long, c long").groupBy("slot").agg(F.sum("c").alias("c")).write.mode("overwrite").parquet(path)

    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _counts_at(path)
        for batch in batches:
            for part in slices(batch):
                size, tokens = [], []
                for text in utf8(part.column(1)):
                    x = shingles(text, words)
                    size.append(len(x))
                    x = x[np.lexsort((x, counts[(x & np.uint64(SLOTS - 1)).astype(np.int64)]))]
                    tokens.append(x[: len(x) - -(-threshold * len(x) // 100) + 1].view(np.int64))
                each = [len(t) for t in tokens]
                rep, label = (np.repeat(part.column(i).to_numpy(), each) for i in (0, 2))
                at = np.concatenate([np.arange(n) for n in each])
                yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(label), pa.array(np.repeat(size, each)), pa.array(at), pa.array(np.concatenate(tokens))], ["rep", "label", "n", "at", "token"])

    tokens = stage(own.mapInArrow(prefix, "rep long, label long, n long, at long, token long"), "near-prefixes")
    # of each token, the component that most have: others are held against all, so that its own members make no pairs
    most = tokens.groupBy("token", "label").agg(F.count(F.lit(1)).alias("c")).groupBy("token").agg(F.max_by("label", "c").alias("main"), F.count(F.lit(1)).alias("k"), (F.sum("c") - F.max("c")).alias("others")).filter("k > 1")
    # a token that thousands share is dealt out by those others, and all come to each part
    most = stage(most.select("token", "main", F.ceil(F.col("others") / OTHERS).cast("int").alias("parts")), "near-tokens")
    of = lambda x: [F.col(c).alias(f"{c}_{x}") for c in ("rep", "n", "at", "label")]
    a = tokens.join(most, "token").filter("label != main").select("token", "main", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int").alias("part"), *of("a"))
    b = tokens.join(most, "token").select("token", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), *of("b"))
    # of a pair's common tokens the first passes: what stands before it in either set is not in the other
    room = f"{100 + threshold} * least(n_a - at_a, n_b - at_b) >= {threshold} * (n_a + n_b)"
    near = f"label_a != label_b and (label_b = main or rep_a < rep_b) and {room}"
    pairs = a.join(b, ["token", "part"]).filter(near)
    return pairs.select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b")).distinct()


def keep(docs: DataFrame, *, words: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """One document of each component, with all its columns: that of the smallest doc_id.

    Of several texts under that id the one of the least hash stays, and a component without any doc_id keeps one too.
    Rows of one doc_id and text stay together, and documents without shingles all stay.
    """
    found = _labelled(docs, words, threshold)
    best = found.filter("label is not null").groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("own")).select("own.doc_id", "own.h")
    kept = best.union(found.filter("label is null").select("doc_id", "h")).distinct().select(F.col("doc_id").alias("of"), "h")
    h = F.xxhash64(docs["text"])
    return docs.join(kept, (h == kept["h"]) & docs["doc_id"].cast("long").eqNullSafe(kept["of"]), "left_semi")


def classes_sql(words: int = WORDS, threshold: int = THRESHOLD) -> str:
    """The same by joining all sets on their shingles, and the links' transitive closure. For small tables."""
    return rf"""
WITH RECURSIVE docs AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {words} THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - {words - 2}), lambda i: array_to_string(w[i:i + {words - 1}], ' '))) END AS s FROM docs),
flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM flat a JOIN flat b USING (x) WHERE a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= {threshold} * greatest(a.n, b.n) GROUP BY ALL),
links AS (SELECT a, b FROM pairs WHERE 100 * c >= {threshold} * (na + nb - c)),
reach(a, b) AS (SELECT doc_id, doc_id FROM sets UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least USING (doc_id)"""
