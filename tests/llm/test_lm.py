from __future__ import annotations

import math

import numpy as np
import pytest

from corvex.llm import lm
from tests.llm import brute
from tests.llm.data import awkward, frame, pairs

COLUMNS = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def scored(df, **how) -> dict:
    return {r["doc_id"]: tuple(r) for r in lm.score(df, **how).select(*COLUMNS).collect()}


@pytest.mark.parametrize("how", [{}, {"block_tokens": 2000, "shard_tokens": 10_000}])
def test_awkward_documents(spark, how):
    rows = awkward()
    found, mixed = scored(frame(spark, rows, clashing=True), **how), brute.lm_mixed(pairs(rows))
    for want in brute.lm_base(pairs(rows)):
        have = found.pop(want[0])
        assert have[:5] == want[:5]
        assert math.isclose(have[5], want[5], rel_tol=1e-9)
        assert math.isclose(have[6], mixed[want[0]], rel_tol=2e-3)
    assert not found


def test_blocks_and_shards_change_nothing(spark):
    rows = awkward(2)
    a, b = (scored(frame(spark, rows, p), **how) for p, how in ((1, {}), (5, {"block_tokens": 500, "shard_tokens": 5000})))
    assert all(math.isclose(a[d][6], b[d][6], rel_tol=1e-7) for d in a) and set(a) == set(b)


def test_levels_change_nothing(spark, monkeypatch):
    """A fan of two ranges: seven levels of requests and of answers."""
    rows = awkward(2)
    want = scored(frame(spark, rows))
    monkeypatch.setattr(lm, "FAN", 1)
    assert lm._widths(7) == [1] * 7
    found = scored(frame(spark, rows, 4), block_tokens=3000, shard_tokens=2000)
    assert all(found[d][:5] == want[d][:5] and math.isclose(found[d][6], want[d][6], rel_tol=1e-7) for d in want) and set(found) == set(want)


def test_a_block_addresses_a_bounded_number_of_ranges():
    rng = np.random.default_rng(1)
    hashes = np.unique(rng.integers(0, 1 << 64, 5000, dtype=np.uint64))
    counts, used, own = np.arange(len(hashes)), 0, [(0, hashes, np.arange(len(hashes)))]
    for width in lm._widths(11):
        out = []
        for shard, h, c in own:
            some = list(lm._split(shard, 5, 1, h, c, used, width))
            assert len(some) <= 1 << lm.FAN
            out += [(s, lm._unpack(a), lm._wide(b)) for s, _, _, a, b in some]
        own, used = out, used + width
    assert (np.concatenate([x[1] for x in own]) == hashes).all() and (np.concatenate([x[2] for x in own]) == counts).all()
    assert all((x[1] >> np.uint64(53) == x[0]).all() for x in own)


def test_every_word_is_possible_and_a_frequent_pair_likelier(spark):
    train = [(d, "a b a c a b b", None, None, 1) for d in range(30)]
    held = [d for d in range(100, 400) if brute.held_out(d)][:5]
    rows = train + [(d, t, None, None, 1) for d, t in zip(held, ["a", "a a", "a b", "a c", "a never"], strict=True)]
    found = scored(frame(spark, rows, 1))
    alone, after = found[held[0]][6], [found[d][6] for d in held[1:]]
    assert all(math.isfinite(x) and x < 0 for x in (alone, *after)) and max(after) == found[held[2]][6]


def test_it_predicts_better_than_the_base(spark):
    import random

    rng, after = random.Random(3), {w: f"n{w}" for w in range(50)}
    text = lambda: " ".join(f"{w} {after[w]}" for w in (rng.randrange(50) for _ in range(60)))
    rows = [(d, text(), None, None, 1) for d in range(200)]
    held = [r for r in scored(frame(spark, rows)).values() if r[1]]
    assert sum(r[6] for r in held) > 0.7 * sum(r[5] for r in held)


def test_nulls_repeated_rows_and_empty_table(spark):
    rows = [(None, None, None, None, None), (2, "x y", None, None, 1), (2, "x y", None, None, 1)]
    found = lm.score(frame(spark, rows)).collect()
    assert len(found) == 3 and {r["n_tokens"] for r in found} == {1, 3} and {r["train_tokens"] for r in found} == {7}
    assert lm.score(frame(spark, [])).collect() == []


def test_held_out_alone(spark):
    """Without training tokens every token has the probability of one type."""
    doc = next(d for d in range(100) if brute.held_out(d))
    (row,) = scored(frame(spark, [(doc, "a b", None, None, 1)])).values()
    assert row[1:5] == (True, 3, 0, 0) and math.isclose(row[5], 0.0, abs_tol=1e-12) and math.isfinite(row[6])


def test_expectation_maximisation_finds_the_mixture():
    rng = np.random.default_rng(0)
    cells = []
    for _ in range(400):
        p2, p1 = rng.random(2)
        weight = 1000 * (0.7 * p2 + 0.25 * p1 + 0.05 / 2)
        cells.append((3 << 24, weight, weight * p2, weight * p1))
    w = lm.learn(cells, 1)[3]
    assert w.sum() == pytest.approx(1) and (w > 0).all()
    like = lambda w: sum(n * math.log(w[0] * a / n + w[1] * b / n + w[2] / 2) for _, n, a, b in cells)
    for _ in range(200):
        assert like(w) >= like(rng.dirichlet([1, 1, 1])) - 1e-6
    assert lm.learn([], 0)[0] == pytest.approx([1 / 3] * 3)
