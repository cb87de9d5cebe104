from __future__ import annotations

import random
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from corvex.llm import packing
from tests.llm import brute
from tests.llm.data import awkward, frame, got, pairs


def gapless(pieces) -> int:
    at = 0
    for start, length in sorted(pieces):
        assert start == at and length > 0
        at += length
    return at


def check(found, rows, capacity=4096):
    ids = defaultdict(list)
    for doc, text in pairs(rows):
        ids[doc].append([*brute.ids_of(text, "word_bpe_49k.json"), 2])
    docs, windows = defaultdict(list), defaultdict(list)
    for doc, start, length, crc, n, seq, offset in found:
        assert brute.crc(ids[doc][0][start : start + length]) == crc and n == len(ids[doc][0])
        docs[doc].append((start, length))
        windows[seq].append((offset, length))
    assert set(docs) == set(ids)
    for doc, copies in ids.items():
        if len(copies) == 1:
            assert gapless(docs[doc]) == len(copies[0])
        else:  # each id is in as many pieces as there are copies
            edges = Counter()
            for start, length in docs[doc]:
                edges[start] += 1
                edges[start + length] -= 1
            at, covered = 0, []
            for place in sorted(edges):
                at += edges[place]
                covered.append((place, at))
            assert {n for place, n in covered if place < len(copies[0])} == {len(copies)} and covered[-1] == (len(copies[0]), 0) and covered[0][0] == 0
    assert all(gapless(w) <= capacity for w in windows.values())
    return 1 - sum(f[2] for f in found) / (capacity * len(windows))


COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def test_awkward_documents(spark):
    rows = awkward()
    rows += rows[16:18]
    check(got(packing.digests(frame(spark, rows, 1, clashing=True)), *COLUMNS), rows)


def test_empty_table_and_null_ids(spark):
    assert got(packing.digests(frame(spark, [])), *COLUMNS) == []
    assert len(got(packing.digests(frame(spark, [(None, None, None, None, None)])), *COLUMNS)) == 1


def test_small_windows_and_blocks(spark):
    rows = awkward(4)
    found = packing.pack(frame(spark, rows, 2), capacity=64, end=2, block_ids=500)
    loads = defaultdict(int)
    for r in found.collect():
        loads[r["sequence_id"]] += r["length"]
        assert len(r["ids"]) == 4 * r["length"]
    assert max(loads.values()) <= 64


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 100), max_size=60), st.sampled_from([0.0, 0.1, 0.25, 1.0]))
def test_windows_hold_every_id_once(sizes, cuts):
    found = packing.windows_of(sizes, 100, cuts)
    by = defaultdict(list)
    for w in found:
        assert 0 < sum(p[2] for p in w) <= 100
        for item, start, length in w:
            by[item].append((start, length))
    assert {i: gapless(p) for i, p in by.items()} == {i: s for i, s in enumerate(sizes) if s}


def test_differencing_is_near_equal():
    rng = random.Random(0)
    sizes = [rng.randrange(1, 4096) for _ in range(500)]
    loads = [sum(sizes[i] for i in w) for w in packing.difference(sizes, 60)]
    assert sum(loads) == sum(sizes) and max(loads) - min(loads) < 0.02 * max(loads)
    assert sorted(sum([8, 7, 6, 5, 4][i] for i in w) for w in packing.difference([8, 7, 6, 5, 4], 2)) == [14, 16]


def test_the_count_rises_when_capacity_is_exceeded():
    assert len(packing.windows_of([60, 60, 60], 100, max_cuts=0)) == 3
    assert len(packing.windows_of([60, 60, 60], 100, max_cuts=1)) == 2


def test_by_default_no_item_is_cut():
    assert len(packing.windows_of([60, 60, 60], 100)) == 3
    rng = random.Random(3)
    sizes = [rng.randrange(1, 4096) for _ in range(400)]
    found = packing.windows_of(sizes)
    assert sorted(p for w in found for p in w) == [(i, 0, s) for i, s in enumerate(sizes)]
    assert len(found) < 1.05 * sum(sizes) / packing.CAPACITY + 1
