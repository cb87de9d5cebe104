from __future__ import annotations

import random

import numpy as np
import pytest

from corvex.llm import near_dup
from corvex.llm.components import components
from tests.llm import brute
from tests.llm.data import awkward, frame, got, pairs, wanted, words

COLUMNS = ("doc_id", "n_shingles", "component_id", "kept")


@pytest.mark.parametrize("k", [4, 5])
def test_awkward_documents(spark, k):
    rows = awkward(ids=range(3000, 0, -7))
    assert got(near_dup.classes(frame(spark, rows, clashing=True), words=k), *COLUMNS) == wanted(brute.near_dup(pairs(rows), k))


def test_chains_and_large_groups_of_near_copies(spark, monkeypatch):
    """Drifting copies, of which neighbours are linked alone, in buckets that are joined by prefixes."""
    monkeypatch.setattr(near_dup, "SMALL", 4)
    rng, rows = random.Random(9), []
    for chain in range(4):
        own = words(rng, 150, 10_000).split()
        for _ in range(40):
            own[rng.randrange(150)] = f"n{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(own), None, None, None))
    star = words(rng, 200, 10_000).split()
    for _ in range(60):
        own = list(star)
        for _ in range(rng.randrange(6)):
            own[rng.randrange(200)] = f"m{rng.randrange(10**6)}"
        rows.append((len(rows), " ".join(own), None, None, None))
    rng.shuffle(rows)
    assert got(near_dup.classes(frame(spark, rows), words=4), *COLUMNS) == wanted(brute.near_dup(pairs(rows), 4))


def test_at_the_threshold(spark):
    """With 9 of 11 shingles in common and with 8 of 10."""
    a = [f"a{i}" for i in range(13)]
    rows = [(1, " ".join(a), None, None, None), (2, " ".join([*a[:12], "x"]), None, None, None), (3, " ".join(f"b{i}" for i in range(12)), None, None, None), (4, " ".join([*(f"b{i}" for i in range(11)), "y"]), None, None, None), (5, " ".join(f"b{i}" for i in range(11)), None, None, None)]
    assert got(near_dup.classes(frame(spark, rows), words=4), *COLUMNS) == wanted(brute.near_dup(pairs(rows), 4))


def test_repeated_rows_nulls_and_empty_table(spark):
    text = "some text of more than five words here"
    rows = [(7, text, None, None, None), (7, text, None, None, None), (None, text, None, None, None), (3, text.upper(), None, None, None), (None, None, None, None, None), (9, None, None, None, None)]
    found = got(near_dup.classes(frame(spark, rows)), *COLUMNS)
    assert found == wanted([(7, 4, 3, False), (7, 4, 3, False), (None, 4, 3, False), (3, 4, 3, True), (None, 0, None, True), (9, 0, 9, True)])
    assert got(near_dup.classes(frame(spark, [])), *COLUMNS) == []


def test_null_ids_and_ids_with_several_texts_are_compared(spark):
    rng = random.Random(6)
    a, b, c = (words(rng, 100) for _ in range(3))
    one = lambda i, t: (i, t, None, None, None)
    rows = [one(None, a + " x"), one(None, a + " y"), one(5, b), one(5, c), one(3, b + " z"), one(9, c + " z"), one(None, b + " q")]
    found = got(near_dup.classes(frame(spark, rows)), "doc_id", "component_id", "kept")
    assert found == wanted([(None, None, True), (None, None, True), (5, 3, False), (5, 5, True), (3, 3, True), (9, 5, False), (None, 3, False)])
    kept = got(near_dup.keep(frame(spark, [*rows, one(None, a + " x"), one(None, ""), one(None, None), one(4, " ")])), "doc_id", "text")
    first = [t for d, t in kept if d is None and t and t.startswith(a)]
    assert len(set(first)) == 1 and len(first) in (1, 2)
    assert [k for k in kept if k[1] not in first] == wanted([(3, b + " z"), (5, c), (None, ""), (None, None), (4, " ")])


def test_a_long_text_and_a_token_that_thousands_share(spark, monkeypatch):
    """Prefixes of 20,000 shingles, and short texts of which all have one shingle in common."""
    monkeypatch.setattr(near_dup, "SMALL", 2)
    monkeypatch.setattr(near_dup, "OTHERS", 16)
    rng = random.Random(12)
    long = words(rng, 20_000, 10**7).split()
    rows = []
    for i in range(6):
        own = list(long)
        for _ in range(300 * i):
            own[rng.randrange(len(own))] = f"z{rng.randrange(10**9)}"
        rows.append((i, " ".join(own), None, None, None))
    tail = "one two three four five six seven"
    rows += [(100 + i, f"{tail} v{i % 700}" + " w" * (i % 3 == 0), None, None, None) for i in range(1500)]
    assert got(near_dup.classes(frame(spark, rows), words=4), *COLUMNS) == wanted(brute.near_dup(pairs(rows), 4))


def test_one_of_each_group_stays(spark):
    rows = awkward()
    out = near_dup.keep(frame(spark, rows, clashing=True), words=4)
    assert out.columns == frame(spark, rows, clashing=True).columns
    assert got(out, "doc_id") == wanted([(d,) for d, _, _, kept in brute.near_dup(pairs(rows), 4) if kept])


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(2)
    for share in (0.5, 0.8, 0.95):
        found = []
        for _ in range(30):
            x = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
            n = int(1000 * share)
            a, b = x[:1000], np.concatenate([x[:n], x[1000 : 2000 - n]])
            ra, rb = near_dup.registers(a), near_dup.registers(b)
            assert (near_dup.merged(ra, rb) == near_dup.registers(np.union1d(a, b))).all()
            found.append(near_dup.estimate(ra[None], rb[None], np.array([1000.0]), np.array([1000.0]))[0])
        assert abs(np.mean(found) - share / (2 - share)) < 0.02


def test_components(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(100), rng.randrange(100)) for _ in range(60)]
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in links:
        root[max(find(a), find(b))] = min(find(a), find(b))
    found = dict(got(components(spark.createDataFrame(links, "a long, b long")), "node", "label"))
    assert found == {i: find(i) for i in {x for ab in links for x in ab if ab[0] != ab[1]}}
