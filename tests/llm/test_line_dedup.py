from __future__ import annotations

import numpy as np

from corvex.llm import line_dedup
from corvex.llm.line_dedup import Cuckoo, LineState
from tests.llm import brute
from tests.llm.data import awkward, frame, got, pairs, wanted

COLUMNS = ("doc_id", "n_lines", "n_dropped", "kept_sha256")


def test_awkward_documents(spark):
    rows = awkward()
    rows += [(900 + i, "Kelvin K line\nshared", None, None, 1) for i in range(10)] + rows[16:18]
    df = frame(spark, rows, clashing=True)
    want = wanted(brute.line_dedup(pairs(rows)))
    assert got(line_dedup.digests(df), *COLUMNS) == want
    from pyspark.sql import functions as F

    joined = line_dedup.dedup(df, counts=True, worker_bytes=0).withColumn("kept_sha256", F.sha2("text", 256))
    assert got(joined, *COLUMNS) == want  # the way for more common keys than a worker holds


def test_shard_by_shard(spark, monkeypatch):
    """Many small shards, of which a worker holds one at a time; rows with null and repeated ids; shards laid out anew."""
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 4)
    rows = [(None if i % 5 == 0 else i % 40, "\n".join(f"line {j}" for j in range(i % 7, 90, 1 + i % 3)) + f"\nown {i}", None, None, 1) for i in range(120)]
    rows += [(None, None, None, None, None), (None, "", None, None, 1), *rows[:3]]
    df = frame(spark, rows)
    want = got(line_dedup.dedup(df, counts=True), "doc_id", "n_lines", "n_dropped", "text")
    state = LineState.build(df)
    assert state.bits >= 4 and any(r[2] for r in want)
    assert got(line_dedup.dedup(df, state, counts=True, worker_bytes=0), "doc_id", "n_lines", "n_dropped", "text") == want
    grown = LineState.build(frame(spark, rows[:9])).insert(frame(spark, rows[9:]))
    assert grown.bits == state.bits and state_of(grown) == state_of(state)


def test_empty_table(spark):
    assert got(line_dedup.digests(frame(spark, [])), *COLUMNS) == []


def test_whole_rows_stay(spark):
    rows = awkward()
    out = line_dedup.dedup(frame(spark, rows, clashing=True))
    assert out.columns == frame(spark, rows, clashing=True).columns
    texts = dict(got(out, "doc_id", "text"))
    assert texts[0] is None and len(texts) == len(rows)


def test_common_lines_of_ten_documents_and_not_of_nine(spark):
    rows = [(i, f"own {i}\nnine" if i < 9 else f"own {i}", None, None, 1) for i in range(10)]
    rows = [(i, t + "\nTEN\t", *r) for i, t, *r in rows]
    found = dict(got(line_dedup.dedup(frame(spark, rows)), "doc_id", "text"))
    assert found == {i: f"own {i}\nnine" if i < 9 else f"own {i}" for i in range(10)}


def state_of(s: LineState):
    refs = sorted(tuple(r) for r in s.refs.collect())
    return refs, sorted((r["shard"], bytes(r["keys"])) for r in s.shards.filter("n > 0").collect())


def test_insertions_and_deletions_are_reversible(spark):
    rows = awkward()
    half = len(rows) // 2
    first, rest = frame(spark, rows[:half]), frame(spark, rows[half:])
    start, whole = LineState.build(first), LineState.build(frame(spark, rows))
    added = start.insert(rest)
    assert state_of(added) == state_of(whole)
    assert state_of(added.delete(rest)) == state_of(start)
    assert got(line_dedup.dedup(frame(spark, rows), added), "doc_id", "text") == got(line_dedup.dedup(frame(spark, rows)), "doc_id", "text")
    assert state_of(whole.delete(frame(spark, rows))) == ([], [])


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    keys = rng.integers(1, 1 << 63, 5000, dtype=np.uint64).tolist()
    f = Cuckoo.of(np.array(keys, dtype=np.uint64))
    assert all(k in f for k in keys)
    others = rng.integers(1, 1 << 63, 5000, dtype=np.uint64).tolist()
    assert sum(k in f for k in others) < 20
    assert all(f.delete(k) for k in keys) and not f.table.any()
    assert not f.delete(keys[0])
