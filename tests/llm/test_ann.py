from __future__ import annotations

import numpy as np

from corvex.llm import ann
from tests.llm import brute

SCHEMA = "vec_id long, embedding array<float>, label int, block int, x string, dim int"
SF = "/root/testdata/sf0.01"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, 0, 1, "x", 2) for i, v in rows], SCHEMA).repartition(parts)


def found(df) -> dict[int, list[tuple[int, float]]]:
    out: dict = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def vectors(n: int, dim: int = 16, seed: int = 0) -> list[tuple]:
    rng = np.random.default_rng(seed)
    return [(i, [float(x) for x in v]) for i, v in enumerate(rng.standard_normal((n, dim)).astype(np.float32))]


def recall(have, want) -> float:
    return sum(len({i for i, _ in want[q]} & {i for i, _ in have[q]}) for q in want) / sum(map(len, want.values()))


def test_few_rows_are_found_exactly(spark):
    rows = vectors(9) + [(100, [1.0] * 16)]
    assert found(ann.search(frame(spark, rows))) == brute.neighbours(rows)


def test_vectors_that_take_no_part(spark):
    rows = vectors(120) + [(200, None), (300, [0.0] * 16), (400, [None] + [1.0] * 15), (500, [float("nan")] * 16), (600, [float("inf")] * 16), (700, [])]
    have = found(ann.search(frame(spark, rows)))
    assert have.keys() == {0, 100} and recall(have, brute.neighbours(rows)) >= 0.9
    odd = [*rows, (None, [1.0] * 16), (800, [1.0, 2.0])]  # no id, another dimension
    assert found(ann.search(frame(spark, odd))) == have


def test_ties_go_to_the_smaller_id(spark):
    rows = [(i, [1.0, float(i % 2)] + [0.0] * 14) for i in range(60)]
    assert found(ann.search(frame(spark, rows))) == brute.neighbours(rows)


def test_repeated_rows_are_one(spark):
    rows = vectors(40)
    assert found(ann.search(frame(spark, rows + rows[:20]))) == found(ann.search(frame(spark, rows)))


def test_empty_table(spark):
    assert ann.search(frame(spark, [])).collect() == []
    assert ann.search(frame(spark, [(7, [1.0])])).collect() == []
    assert ann.search(frame(spark, [(100, [1.0])])).collect() == []


def test_recall_over_blocks(spark):
    rows = vectors(6000, 64)
    have, want = found(ann.search(frame(spark, rows), leaf=300, block=500)), brute.neighbours(rows)
    assert have.keys() == want.keys() and recall(have, want) >= 0.9
    exact = {i: np.array(v) for i, v in rows}
    assert all(d == np.sqrt(((exact[q] - exact[i]) ** 2).sum()) for q, some in have.items() for i, d in some)


def test_recall_and_share_visited_of_fifty_thousand_rows():
    """The forest's own strings and levels over vectors without any structure, as many as the check tool has."""
    n, dim, rng = 51_200, 64, np.random.default_rng(11)
    x = rng.standard_normal((n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    made = ann.strings(dim, ann.TREES, ann.rounds_for(n, dim))
    codes = made.codes(x - x[: ann.SAMPLE].mean(axis=0))
    sorted_ = np.sort(codes, axis=0)
    hits, visited, queries = 0, [], rng.choice(n, 60, replace=False)
    for q in queries.tolist():
        for level in reversed(range(len(made.levels))):
            low, high = made.range(codes[q], level)
            if sum(np.searchsorted(sorted_[:, t], high[t]) - np.searchsorted(sorted_[:, t], low[t]) for t in range(made.trees)) >= ann.PROBE * n**0.5:
                break
        inside = ((codes >= low) & (codes < high)).any(axis=1)
        inside[q] = False
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        hits += inside[np.argpartition(d, 10)[:10]].sum()
        visited.append(inside.mean())
    assert hits >= 0.9 * 10 * len(queries) and np.mean(visited) < 0.25


def test_a_query_in_an_empty_region_ascends_to_other_blocks(spark):
    rng = np.random.default_rng(2)
    rows = [(i + 1, [float(v) for v in [10 + a, *b]]) for i, (a, *b) in enumerate(rng.standard_normal((2500, 12)) * 0.1)]
    rows = [r for r in rows if r[0] % 100] + [(100, [-10.0] + [1.0] * 11), (200, rows[0][1])]
    have, want = found(ann.search(frame(spark, rows), trees=4, leaf=64)), brute.neighbours(rows)
    assert have.keys() == want.keys() == {100, 200} and all(len(x) == 10 for x in have.values())
    assert have[200][0] == want[200][0]


def test_ids_of_copies_and_an_id_with_two_vectors(spark):
    rows = [*vectors(50), *((1000 + i, vectors(50)[7][1]) for i in range(30))]
    assert found(ann.search(frame(spark, rows), every=7)) == brute.neighbours(rows, every=7)
    twice = [*rows, (300, [5.0] * 16), (300, [-5.0] * 16)]
    want = brute.neighbours([*rows, (300, [-5.0] * 16)], every=7)
    assert found(ann.search(frame(spark, twice), every=7)) == want


def test_recall_on_the_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    want = brute.neighbours([(r["vec_id"], r["embedding"]) for r in df.collect()])
    assert recall(found(ann.search(df)), want) >= 0.9


def test_strings_share_prefixes_with_near_vectors():
    x = np.random.default_rng(5).standard_normal((500, 8))
    made = ann.Strings(8, 4, 3)
    codes = made.codes(x)
    assert codes.shape == (500, 4) and made.bits == made.levels[-1] == 3 * (4 + ann.SIDES) and int(codes.max()) < 1 << made.bits
    assert (made.codes(x * 3) == codes).all()
    near = made.codes(x + 1e-3)
    shared = lambda a, b: np.mean([[max(level for level, w in enumerate(made.levels) if p >> made.bits - w == q >> made.bits - w) for p, q in zip(*r, strict=True)] for r in zip(a.tolist(), b.tolist(), strict=True)])
    assert shared(codes, near) > 11 and shared(codes, codes[::-1]) < 2
    low, high = made.range(codes[:, 0], 1)
    assert ((low <= codes[:, 0]) & (codes[:, 0] < high)).all() and (high - low == 1 << made.bits - 4).all()


def test_copies_of_the_query_do_not_end_the_ascent(spark):
    for n, copies in ((60, 3), (150, 4), (300, 6)):
        rows = vectors(n, 64)
        rows += [(n + 1000 + i, rows[0][1]) for i in range(1, copies)]
        have, want = found(ann.search(frame(spark, rows), every=10**6)), brute.neighbours(rows, every=10**6)
        assert len(have[0]) == 10 and recall(have, want) >= 0.9
