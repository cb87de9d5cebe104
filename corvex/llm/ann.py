"""Approximate nearest neighbours by a hash-prefix forest over the whole table.

A row has a long hash string in each of ``TREES`` trees: rounds of a *symbol*, the axis of a random rotation that the
vector lies nearest to, with its sign, and ``SIDES`` bits for the sides of hyperplanes. A tree is the sorted array of
its strings, cut into blocks of ``LEAF`` and dealt out by ranges. A query goes to the blocks that share the first bits
of its string, finds its longest matches there by bisection, and ascends in all trees at once, a level at a time, until
the matches of all trees number ``PROBE`` times the root of the number of rows. Whole prefix ranges are taken. Only if
the blocks it was sent to hold too few does it go to more of them, in the end to all. The distinct rows found go to the
blocks of their vectors and are measured exactly there, so that nothing is held against all rows, a query asks for a
number of rows that grows with their root alone, and what comes back is linear in the queries.

Equal vectors are one *class*: it is hashed, searched and measured once, and stands for the ``k + 1`` smallest of its
ids, which are all that the nearest ``k`` of any query can have of it. So copies never fill a task or end an ascent.

The forest is fitted on nothing but the middle of ``SAMPLE`` rows. By pigeonhole, ``trees * (k + 1)`` matches are
``k + 1`` rows at least, so that ``k`` others are found wherever there are as many.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvex.llm._common import partitions_for, slices, stage

TREES, SIDES, PROBE, EVERY, SEED = 64, 3, 36.0, 100, 7
#: Strings of a block of a tree, vectors of a block that are measured together, and rows that the middle is taken from.
LEAF, VECTORS, SAMPLE = 4096, 2048, 4096
#: Axes of a rotation at most; vectors of more dimensions are projected.
AXES = 256


class Strings:
    """The hash strings of vectors: ``bits`` long, with ``levels`` the numbers of bits at which a prefix may end."""

    def __init__(self, dim: int, trees: int, rounds: int):
        self.trees, axes = trees, min(dim, AXES)
        self.symbol = max(1, (2 * axes - 1).bit_length())
        self.levels = [0]
        for _ in range(rounds):
            self.levels += [self.levels[-1] + self.symbol + i for i in range(SIDES + 1)]
        self.bits = self.levels[-1]
        self.turns, self.planes = [], []
        for t in range(trees):
            rng = np.random.default_rng((SEED, t))
            for _ in range(rounds):
                turn = rng.standard_normal((dim, axes))
                self.turns.append((np.linalg.qr(turn)[0] if axes == dim else turn).astype(np.float32))
                self.planes.append(rng.standard_normal((dim, SIDES)).astype(np.float32))

    def codes(self, x: np.ndarray) -> np.ndarray:
        """(rows, trees) of integers whose highest of ``bits`` bits is the string's first."""
        x = x.astype(np.float32)
        out, rounds, every = np.zeros((len(x), self.trees), np.int64), len(self.turns) // self.trees, np.arange(len(x))
        for i, (turn, planes) in enumerate(zip(self.turns, self.planes, strict=True)):
            z = x @ turn
            axis = np.abs(z).argmax(axis=1)
            own = 2 * axis + (z[every, axis] > 0)
            for side in (x @ planes >= 0).T:
                own = 2 * own + side
            at = i // rounds
            out[:, at] = out[:, at] << (self.symbol + SIDES) | own
        return out

    def range(self, code: np.ndarray, level: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
        """The strings from which and below which the first bits are those of code, as many as the level has."""
        shift = self.bits - np.asarray(self.levels)[level]
        low = code >> shift << shift
        return low, low + (np.int64(1) << shift)


def rounds_for(n: int, dim: int) -> int:
    """Rounds of strings that some ten bits tell apart beyond a number for each row, in 62 bits at most."""
    each = max(1, (2 * min(dim, AXES) - 1).bit_length()) + SIDES
    return max(1, min(62 // each, -(-(max(1, n).bit_length() + 10) // each)))


@lru_cache(maxsize=2)
def strings(dim: int, trees: int, rounds: int) -> Strings:
    return Strings(dim, trees, rounds)


def matrix(column: pa.Array, rows: int) -> np.ndarray:
    return np.array(column.flatten().to_numpy(zero_copy_only=False), dtype=float).reshape(rows, -1)


def nearest(rows: np.ndarray, ids: np.ndarray, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids and exact distances of the k nearest rows, ties to the smaller id."""
    d = np.sqrt(((rows - query) ** 2).sum(axis=1))
    best = np.lexsort((ids, d))[:k]
    return ids[best], d[best]


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and x (array<double>) of the rows that take part, an id once.

    Left out are null ids, null or zero vectors, vectors with null or non-finite components, and those of another
    dimension than most (of equally many, the larger one). Of different vectors under one id, the least counts.
    """
    x = F.col("embedding").cast("array<double>")
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).filter("vec_id is not null and x is not null and size(x) > 0")
    rows = rows.filter(~F.exists("x", bad) & F.exists("x", lambda v: v != 0))
    dims = rows.groupBy(F.size("x").alias("dim")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), F.desc("dim")).limit(1)
    return rows.join(F.broadcast(dims.select("dim")), F.size("x") == F.col("dim"), "left_semi").groupBy("vec_id").agg(F.min("x").alias("x"))


def _coded(rows: DataFrame, dim: int, middle: list[float], trees: int, rounds: int) -> DataFrame:
    """tree, code, cid: the strings of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, centre = strings(dim, trees, rounds), np.array(middle)
        for batch in batches:
            for part in slices(batch, 1024):
                codes = made.codes(matrix(part.column(1), part.num_rows) - centre)
                tree = np.tile(np.arange(trees, dtype=np.int32), part.num_rows)
                yield pa.RecordBatch.from_arrays([pa.array(tree), pa.array(codes.ravel()), pa.array(np.repeat(part.column(0).to_numpy(), trees))], ["tree", "code", "cid"])

    return rows.select("cid", "x").mapInArrow(run, "tree int, code long, cid long")


def _blocks(entries: DataFrame, leaf: int) -> DataFrame:
    """The sorted arrays in blocks of one tree and up to ``leaf`` strings each."""
    names = ["block", "tree", "first", "last", "codes", "cids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = TaskContext.get().partitionId() << 32, 0
        held = [np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)]

        def cut(most: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, made
            tree, code, cid = held
            edges = np.append(np.flatnonzero(np.diff(tree, prepend=-1)), len(tree)).tolist()
            at = 0
            for a, b in zip(edges, edges[1:], strict=False):
                for at in range(a, b, leaf):
                    to = min(at + leaf, b)
                    if most and to == len(tree):
                        break  # it may go on in the next batch
                    yield pa.RecordBatch.from_arrays([pa.array([base + made]), pa.array([int(tree[at])], pa.int32()), pa.array([code[at]]), pa.array([code[to - 1]]), pa.array([code[at:to].tobytes()]), pa.array([cid[at:to].tobytes()])], names)
                    made += 1
                    at = to
            held = [x[at:] for x in held]

        for batch in batches:
            held = [np.concatenate([h, batch.column(i).to_numpy()]) for i, h in enumerate(held)]
            yield from cut(True)
        yield from cut(False)

    dealt = entries.repartitionByRange(partitions_for(entries.sparkSession), "tree", "code", "cid").sortWithinPartitions("tree", "code", "cid")
    return dealt.mapInArrow(run, "block long, tree int, first long, last long, codes binary, cids binary")


class _Forest:
    def __init__(self, classes: DataFrame, n: int, dim: int, trees: int, leaf: int):
        self.n, self.trees, self.leaf = n, trees, leaf
        sample = classes.limit(SAMPLE).select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("v"))
        self.how = dim, [r["v"] for r in sorted(sample.collect())], trees, rounds_for(n, dim)
        self.strings = strings(dim, trees, self.how[3])
        self.blocks = stage(_blocks(_coded(classes, *self.how), leaf), "ann-blocks")

    def _asks(self, queries: DataFrame, bits: int) -> DataFrame:
        """queries (cid, tree, code, ...) with each block that has strings of the same first bits."""
        shift = self.strings.bits - bits
        spans = self.blocks.select("block", "tree", F.explode(F.sequence(F.shiftright("first", shift), F.shiftright("last", shift))).alias("root"))
        return queries.withColumn("root", F.shiftright("code", shift)).join(spans, ["tree", "root"]).drop("tree", "root")

    def _counts(self, asks: DataFrame, levels: list[int]) -> DataFrame:
        """cid and m<level>, the matches in a block at each level."""
        of = self.how[0], self.how[2], self.how[3]

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            made, code = strings(*of), right["code"].to_numpy()
            own = np.frombuffer(left["codes"][0].as_py(), np.int64)
            out = {"cid": right["cid"]}
            for level in levels:
                low, high = made.range(code, level)
                out[f"m{level}"] = pa.array(np.searchsorted(own, high) - np.searchsorted(own, low))
            return pa.table(out)

        schema = "cid long, " + ", ".join(f"m{level} long" for level in levels)
        return self.blocks.select("block", "codes").groupBy("block").cogroup(asks.groupBy("block")).applyInArrow(_both(run, schema), schema)

    def _matches(self, asks: DataFrame) -> DataFrame:
        """cid and of, a query and a class of its prefix range."""
        of = self.how[0], self.how[2], self.how[3]

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            made = strings(*of)
            own, cids = (np.frombuffer(left[c][0].as_py(), np.int64) for c in ("codes", "cids"))
            low, high = made.range(right["code"].to_numpy(), right["level"].to_numpy())
            a, b = np.searchsorted(own, low), np.searchsorted(own, high)
            at = np.concatenate([np.arange(i, j) for i, j in zip(a.tolist(), b.tolist(), strict=True)])
            return pa.table({"cid": pa.array(np.repeat(right["cid"].to_numpy(), b - a)), "of": pa.array(cids[at])})

        schema = "cid long, of long"
        return self.blocks.select("block", "codes", "cids").groupBy("block").cogroup(asks.groupBy("block")).applyInArrow(_both(run, schema), schema)

    def candidates(self, queries: DataFrame, wanted: int) -> DataFrame:
        """cid and of, each pair once or more: the classes found for each query by synchronous ascent."""
        levels = self.strings.levels
        coded = stage(_coded(queries, *self.how), "ann-strings")
        start = max(0, (self.n // self.leaf).bit_length() - 1)
        roots = [b for b in levels if b <= start][::-1]  # a block has the strings of about one root of the first
        out = None
        for bits in roots:
            asks = stage(self._asks(coded, bits), "ann-asks")
            use = [i for i, b in enumerate(levels) if b >= bits]
            total = self._counts(asks, use).groupBy("cid").agg(*(F.sum(f"m{i}").alias(f"m{i}") for i in use))
            enough = [F.when(F.col(f"m{i}") >= wanted, i) for i in reversed(use)]
            depth = stage(total.select("cid", F.coalesce(*enough, F.lit(0 if bits == 0 else None).cast("int")).alias("level")), "ann-depths")
            found = self._matches(asks.join(depth.filter("level is not null"), "cid"))
            out = found if out is None else out.union(found)
            if bits == 0:
                break
            # a query in an empty region has no block, and so no row here
            lacking = coded.join(depth.filter("level is not null"), "cid", "left_anti")
            if lacking.isEmpty():
                break
            coded = stage(lacking, "ann-strings")
        return out


def _both(run, schema: str):
    """run on the tables of both sides; none of a group that one side has alone."""
    empty = pa.schema([(c.split()[0], pa.int64()) for c in schema.split(", ")]).empty_table()
    return lambda left, right: run(left, right) if left.num_rows and right.num_rows else empty


def _measured(pairs: DataFrame, classes: DataFrame, queries: DataFrame, blocks: int, k: int) -> DataFrame:
    """cid, of, score: of each query, the k nearest classes in each block of vectors that has candidates."""
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks))
    asked = pairs.groupBy("cid", at("of").alias("at")).agg(F.collect_set("of").alias("some")).join(queries, "cid")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = left["cid"].to_numpy()
        order = np.argsort(ids)
        ids, x = ids[order], matrix(left["x"].combine_chunks(), left.num_rows)[order]
        out = []
        for batch in right.select(["cid", "some", "x"]).to_batches(256):
            q = matrix(batch.column(2), batch.num_rows)
            for i, own in enumerate(batch.column(0).to_pylist()):
                some = np.searchsorted(ids, np.sort(batch.column(1)[i].values.to_numpy()))
                found, d = nearest(x[some], ids[some], q[i], k)
                out.append((np.full(len(found), own), found, d))
        cols = [np.concatenate([o[i] for o in out]) for i in range(3)]
        return pa.table({"cid": pa.array(cols[0]), "of": pa.array(cols[1]), "score": pa.array(cols[2])})

    empty = pa.schema([("cid", pa.int64()), ("of", pa.int64()), ("score", pa.float64())]).empty_table()
    both = lambda left, right: run(left, right) if left.num_rows and right.num_rows else empty
    dealt = classes.select("cid", "x", at("cid").alias("at"))
    return dealt.groupBy("at").cogroup(asked.groupBy("at")).applyInArrow(both, "cid long, of long, score double")


def search(vectors: DataFrame, *, k: int = 10, every: int = EVERY, trees: int = TREES, probe: float = PROBE, leaf: int = LEAF, block: int = VECTORS) -> DataFrame:
    """query_id, rank, vec_id, score: of each row whose vec_id is divisible by ``every``, its k nearest others found.

    score is the Euclidean distance in double precision, ties go to the smaller vec_id, and all others are found if
    there are fewer than k. Vectors that take no part (see ``usable``) are neither found nor queries; an empty table
    gives no rows. Columns other than vec_id and embedding are not read.
    """
    spark = vectors.sparkSession
    rows = stage(usable(vectors), "vectors")
    first = rows.withColumn("r", F.row_number().over(Window.partitionBy("x").orderBy("vec_id"))).filter(F.col("r") <= k + 1)
    classes = stage(first.groupBy("x").agg(F.min("vec_id").alias("cid"), F.collect_list("vec_id").alias("ids")), "ann-classes")
    n = classes.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = classes.select(F.size("x")).first()[0]
    asked = stage(rows.filter(F.col("vec_id") % every == 0).join(classes.select("x", "cid"), "x").select(F.col("vec_id").alias("query_id"), "cid"), "ann-asked")
    queries = stage(classes.join(asked.select("cid").distinct(), "cid", "left_semi").select("cid", "x"), "ann-queries")

    wanted = max(int(probe * n**0.5), trees * (k + 1))
    pairs = _Forest(classes, n, dim, trees, leaf).candidates(queries, wanted)
    found = _measured(pairs, classes, queries, -(-n // block), k + 1)
    near = found.withColumn("r", F.row_number().over(Window.partitionBy("cid").orderBy("score", "of"))).filter(F.col("r") <= k + 1).drop("r")
    near = near.join(classes.select(F.col("cid").alias("of"), "ids"), "of").select("cid", "score", F.explode("ids").alias("vec_id"))
    out = asked.join(near, "cid").filter("vec_id != query_id")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
