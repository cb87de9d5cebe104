"""From documents to postings: term frequencies, positions and weights, in each task's own documents, without a shuffle."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvex.config import IndexConfig
from corvex.functions.analysis import terms

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("doc_key", T.StringType())])
POSTINGS = T.StructType(
    [
        T.StructField("field", T.StringType()),
        T.StructField("term", T.StringType()),
        T.StructField("doc_id", T.LongType()),
        T.StructField("tf", T.IntegerType()),
        T.StructField("positions", T.ArrayType(T.IntegerType())),
        T.StructField("w_d", T.DoubleType()),
    ]
)
#: Postings of one field.
POSTED = T.StructType(POSTINGS.fields[1:])
STATS = T.StructType([T.StructField("field", T.StringType()), T.StructField("term", T.StringType()), T.StructField("df", T.LongType())])
WEIGHTS = T.StructType([T.StructField("field", T.StringType()), T.StructField("doc_id", T.LongType()), T.StructField("n_terms", T.IntegerType()), T.StructField("w_d", T.DoubleType())])

#: Terms of a run that a task sorts at once, bytes of one that is made of others, and rows of a batch that it gives.
RUN, RUN_BYTES, ROWS = 1 << 22, 128 << 20, 100_000


@dataclass
class Tables:
    """What a search reads. ``docs`` are the live ones; statistics include the removed until ``optimize``."""

    config: IndexConfig
    docs: DataFrame
    postings: DataFrame
    term_stats: DataFrame
    doc_weights: DataFrame
    #: field to average weight
    averages: dict[str, float]
    max_id: int
    #: field and term pairs, and their postings in memory
    hot: tuple[frozenset, DataFrame] | None = None


def staged(rows: DataFrame, config: IndexConfig) -> DataFrame:
    """rows with ``t0``, ``t1``, ... instead of the fields: the terms of each; and ``n0``, ``n1``, ...: how many they are."""
    out = rows.select(*(c for c in rows.columns if c not in config.doc_fields), *(terms(F.col(f), config).alias(f"t{i}") for i, f in enumerate(config.doc_fields)))
    return out.select("*", *(F.size(f"t{i}").alias(f"n{i}") for i in range(len(config.doc_fields))))


def _weight(n: str) -> Column:
    return F.round(1 + F.ln(F.col(n) + F.lit(1.0)), 5)


def weights(docs: DataFrame, config: IndexConfig) -> DataFrame:
    """A row for each staged document and field; the terms themselves are not read."""
    each = F.array(*(F.struct(F.lit(name).alias("field"), F.col(f"n{i}").alias("n_terms"), _weight(f"n{i}").alias("w_d")) for i, name in enumerate(config.doc_fields)))
    return docs.select("doc_id", F.explode(each).alias("f")).select("f.field", "doc_id", "f.n_terms", "f.w_d")


def postings(docs: DataFrame, config: IndexConfig) -> dict[str, DataFrame]:
    """Of each field, a row for each term and staged document, with the document's weight, which no search then needs to join.

    Each task inverts its own documents, some millions of terms at a time, and gives runs that are sorted by term:
    nothing is shuffled, and a common term is in as many tasks as its documents.
    """
    places = config.proximity_index
    return {name: docs.select("doc_id", F.col(f"t{i}").alias("terms"), _weight(f"n{i}").alias("w_d")).mapInArrow(lambda batches: _inverted(batches, places), POSTED) for i, name in enumerate(config.doc_fields)}


def resorted(posted: DataFrame) -> DataFrame:
    """Postings of one field, in longer runs by term than they come in."""
    return posted.select(*POSTED.fieldNames()).mapInArrow(_resorted, POSTED)


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, int]]:
    """Slices of a batch with no more than RUN terms, or with one document, and their numbers of terms."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column("terms")), 0).to_numpy(zero_copy_only=False))
    i, before = 0, 0
    while i < len(ends):
        j = max(i + 1, int(np.searchsorted(ends, before + RUN, "right")))
        yield batch.slice(i, j - i), int(ends[j - 1]) - before
        i, before = j, int(ends[j - 1])


def _inverted(batches: Iterator[pa.RecordBatch], places: bool) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for batch in batches:
        for piece, more in _pieces(batch):
            if held and n + more > RUN:
                yield from _run(held, places)
                held, n = [], 0
            held.append(piece)
            n += more
    if held:
        yield from _run(held, places)


def _ranks(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Of each word its rank among the distinct ones, and those in order."""
    found = words.dictionary_encode()
    order = pc.array_sort_indices(found.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank[found.indices.to_numpy()], found.dictionary.take(pa.array(order))


def _run(held: list[pa.RecordBatch], places: bool) -> Iterator[pa.RecordBatch]:
    """The postings of some documents by term. A term's number and its place in the run are one integer, which is sorted."""
    table = pa.Table.from_batches(held)
    lists = table["terms"].combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    if not (n := int(lengths.sum())):
        return
    ids, w_d = table["doc_id"].to_numpy(), table["w_d"].to_numpy()
    ranks, words = _ranks(lists.flatten())
    bits = n.bit_length()
    key = (ranks << bits) | np.arange(n)
    key.sort()
    at, term = key & ((1 << bits) - 1), key >> bits
    doc = np.repeat(np.arange(len(ids)), lengths)[at]
    place = (at - (np.cumsum(lengths) - lengths)[doc] + 1).astype(np.int32)
    heads = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (doc[1:] != doc[:-1]))))
    ends = np.append(heads, n)
    for i in range(0, len(heads), ROWS):
        own = heads[i : i + ROWS]
        offsets = ends[i : i + len(own) + 1]
        at_ = pa.ListArray.from_arrays(pa.array((offsets - offsets[0]).astype(np.int32)), pa.array(place[offsets[0] : offsets[-1]])) if places else pa.nulls(len(own), pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([words.take(pa.array(term[own])), pa.array(ids[doc[own]]), pa.array(np.diff(offsets).astype(np.int32)), at_, pa.array(w_d[doc[own]])], POSTED.fieldNames())


def _resorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size > RUN_BYTES:
            yield from _by_term(held)
            held, size = [], 0
    if held:
        yield from _by_term(held)


def _by_term(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(held).combine_chunks()
    if table.num_rows:
        ranks, _ = _ranks(table["term"].combine_chunks())
        yield from table.take(pa.array(np.lexsort((table["doc_id"].to_numpy(), ranks)))).to_batches(ROWS)


def term_stats(posted: DataFrame) -> DataFrame:
    return posted.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))
