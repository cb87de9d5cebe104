from __future__ import annotations

import math
import random

import pytest

from corvex.llm import quality
from tests.llm import brute
from tests.llm.data import awkward, frame, got, pairs, wanted, words

BASE = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_awkward_documents(spark):
    rows = awkward()
    rows += [(900, "x y " * 4 + "z", None, None, 1), (901, "one two three four five six seven eight " * 2, None, None, 1), (902, "a\r\na\r\n\xa0\n\xa0\n \n", None, None, 1)]
    assert got(quality.verdicts(frame(spark, rows, clashing=True)), *BASE) == wanted(brute.quality(pairs(rows)))


def test_random_repeats(spark):
    rng = random.Random(8)
    rows = [(i, words(rng, rng.randrange(0, 60), 2), None, None, 1) for i in range(300)]
    assert got(quality.verdicts(frame(spark, rows)), *BASE) == wanted(brute.quality(pairs(rows)))


def test_repeated_rows_and_empty_table(spark):
    rows = awkward()[:20]
    assert len(got(quality.verdicts(frame(spark, rows + rows)), *BASE)) == 40
    assert got(quality.verdicts(frame(spark, [])), *BASE) == []


def mixed(rng: random.Random) -> list[tuple]:
    """Two languages and sources of plain documents, with junk in one of them, and a small source."""
    rows = []
    for _ in range(400):
        lang, source = rng.choice(["en", None]), rng.choice(["s1", None])
        rows.append((len(rows), " ".join(rng.choice("abcdefghij") * rng.randrange(2, 9) for _ in range(rng.randrange(80, 300))), lang, source, 1))
    rows += [(len(rows) + i, "#$%&*" * 3 + " " + words(rng, 60) + " ###|||" * 40, "en", "s1", 1) for i in range(8)]
    return rows + [(1000 + i, words(rng, 100), "de", "rare", 1) for i in range(5)]


def test_verdicts_against_brute_force(spark):
    rows = mixed(random.Random(2))
    stats = quality.statistics(frame(spark, rows))
    found = {r["doc_id"]: r for r in quality.judge(stats).collect()}
    want = brute.mcd([r.asDict() for r in stats.collect()], quality.FLOORS, quality.SUPPORT, quality.STEPS, quality.LEAST)
    for doc, r in found.items():
        assert (r["d2"] is None) == (want[doc] is None)
        if want[doc] is not None:
            assert r["d2"] == pytest.approx(want[doc], rel=1e-6, abs=1e-6)
        assert r["kept"] == (not r["base_failed"] and not (want[doc] or 0) > quality.CUTOFF)
    assert not any(found[i]["kept"] for i in range(400, 408))  # junk
    assert all(found[i]["kept"] for i in [*range(400), *range(1000, 1005)])  # plain ones, and those without an estimate


def test_determinants_against_exhaustive_search(spark):
    """Small groups, of which every subset of the support's size is tried."""
    import itertools

    import numpy as np

    rng, rows, points = np.random.default_rng(4), [], {}
    for g in range(12):
        x = rng.standard_normal((13, 5)) * [0.5, 0.2, 0.1, 0.3, 0.3]
        x[: g % 4] += rng.choice([-3.0, 3.0], 5)
        points[f"g{g}"] = x
        rows += [(len(rows) + i, f"g{g}", *map(float, p)) for i, p in enumerate(x)]
    clean = spark.createDataFrame(rows, "doc_id long, g string, " + ", ".join(f"{x} double" for x in quality.FEATURES))
    fit, _ = quality.estimates(clean, least=10)
    found = dict(got(fit, "g", "log_det"))
    floor, size, gaps = np.diag(np.square(quality.FLOORS)), math.ceil(quality.SUPPORT * 13), []
    for g, x in points.items():
        least = min(np.linalg.slogdet(np.cov(x[list(some)].T, bias=True) + floor)[1] for some in itertools.combinations(range(13), size))
        gaps.append(found[g] - least)
    assert min(gaps) > -1e-6 and max(gaps) < 0.35 and sum(gap < 1e-6 for gap in gaps) >= 6


def test_rows_of_one_id_have_verdicts_of_their_own(spark):
    rows = mixed(random.Random(2))
    junk = next(r for r in rows if r[0] == 402)
    out = quality.keep(frame(spark, [*rows, (7, junk[1], "en", "s1", 1), (None, junk[1], "en", "s1", 1), (None, rows[0][1], rows[0][2], rows[0][3], 1)]))
    found = got(out, "doc_id", "text")
    assert found.count((7, rows[7][1])) == 1 and (7, junk[1]) not in found
    assert [t for d, t in found if d is None] == [rows[0][1]]


def test_it_withstands_many_outliers(spark):
    """A fifth of a group is junk, which would draw a plain mean and covariance to itself."""
    rng = random.Random(1)
    rows = [(i, words(rng, rng.randrange(80, 200)), "en", "s", 1) for i in range(160)]
    rows += [(1000 + i, "##### " * 60 + words(rng, 40), "en", "s", 1) for i in range(40)]
    found = dict(got(quality.verdicts(frame(spark, rows)), "doc_id", "kept"))
    assert all(found[i] == (i < 1000) for i in found)


def test_whole_rows_stay(spark):
    rows = mixed(random.Random(2))
    df = frame(spark, rows, clashing=True)
    out = quality.keep(df)
    assert out.columns == df.columns
    assert got(out, "doc_id") == wanted([(r["doc_id"],) for r in quality.verdicts(df).filter("kept").collect()])


def test_salted_joins_change_nothing(spark, monkeypatch):
    stats = quality.statistics(frame(spark, mixed(random.Random(2))))
    want = {r["doc_id"]: (r["d2"] and round(r["d2"], 9), r["kept"]) for r in quality.judge(stats).collect()}
    monkeypatch.setattr(quality, "GROUPS", 0)
    assert {r["doc_id"]: (r["d2"] and round(r["d2"], 9), r["kept"]) for r in quality.judge(stats).collect()} == want


def test_the_cutoff_is_a_chi_square_quantile():
    x = quality.CUTOFF
    beyond = math.erfc(math.sqrt(x / 2)) + math.sqrt(2 * x / math.pi) * math.exp(-x / 2) * (1 + x / 3)  # five degrees of freedom
    assert beyond == pytest.approx(0.001, rel=1e-3)


def test_labelled_junk_goes_and_clean_documents_stay(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "quality")
    found = quality.verdicts(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).filter("not base_failed").join(labels, "doc_id").collect()
    rejected = {q: [not r["kept"] for r in found if r["quality"] == q] for q in (0, 1)}
    assert sum(rejected[0]) >= 0.9 * len(rejected[0]) > 0
    assert sum(rejected[1]) <= 0.02 * len(rejected[1])


def test_every_document_gets_a_verdict(spark, monkeypatch):
    """A small source of a large language, and rare languages, are judged by the whole language and by all."""
    rng = random.Random(4)
    plain = lambda: words(rng, rng.randrange(80, 200))
    junk = lambda: "##### " * 60 + words(rng, 40)
    rows = [(i, plain(), "en", "large", 1) for i in range(120)]
    rows += [(200, plain(), "en", "small", 1), (201, junk(), "en", "small", 1), (202, plain(), "xx", "s", 1), (203, junk(), "xx", "s", 1), (204, junk(), None, None, 1), (205, "few", "yy", "s", 1)]
    found = {r["doc_id"]: (r["kept"], r["d2"]) for r in quality.verdicts(frame(spark, rows)).collect()}
    assert all(d2 is not None for _, d2 in found.values())
    assert {i: found[i][0] for i in range(200, 206)} == {200: True, 201: False, 202: True, 203: False, 204: False, 205: False}
    stats = [r.asDict() for r in quality.statistics(frame(spark, rows)).collect()]
    for pool, ids in (("en", [200, 201]), (None, [202, 203, 204])):
        alike = [r | {"lang": "one", "source": "one"} for r in stats if pool in (r["lang"], None)]
        want = brute.mcd(alike, quality.FLOORS, quality.SUPPORT, quality.STEPS, quality.LEAST)
        assert {i: found[i][1] for i in ids} == pytest.approx({i: want[i] for i in ids}, rel=1e-6)
    monkeypatch.setattr(quality, "GROUPS", 0)
    assert {r["doc_id"]: r["d2"] for r in quality.verdicts(frame(spark, rows)).collect()} == pytest.approx({i: d2 for i, (_, d2) in found.items()})


def test_tables_of_any_size_get_verdicts(spark):
    rng = random.Random(6)
    for n in (1, 2, 49):
        rows = [(i, words(rng, 100), f"l{i % 3}", "s", 1) for i in range(n)]
        assert all(r["kept"] and r["d2"] is not None for r in quality.verdicts(frame(spark, rows)).collect())
