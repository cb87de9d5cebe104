from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corvex.llm import token_files
from corvex.llm.token_files import EliasFano
from tests.llm import brute
from tests.llm.data import awkward, frame, got, pairs, wanted

COLUMNS = ("doc_id", "start", "n_tokens", "ids_crc32")


def test_awkward_documents(spark):
    rows = awkward(ids=range(5000, -1, -3))
    assert got(token_files.digests(frame(spark, rows, clashing=True)), *COLUMNS) == wanted(brute.token_files(pairs(rows)))


def test_nulls_and_repeated_rows(spark):
    rows = [(None, "null id", None, None, None), (3, "b c", None, None, None), (3, "b c", None, None, None), (1, None, None, None, None)]
    found = got(token_files.digests(frame(spark, rows)), *COLUMNS)
    n = {t: len(brute.ids_of(t, "byte_bpe_50k.json")) + 1 for t in ("null id", "b c")}
    assert sorted((f[0] if f[0] is not None else -1, f[1], f[2]) for f in found) == [(-1, 0, n["null id"]), (1, n["null id"], 1), (3, n["null id"] + 1, n["b c"]), (3, n["null id"] + 1 + n["b c"], n["b c"])]


def test_empty_table(spark):
    assert got(token_files.digests(frame(spark, [])), *COLUMNS) == []


def test_random_access(spark):
    rows = awkward()
    files = token_files.write(frame(spark, rows), files=3).collect()
    at = 0
    want = {d: [*brute.ids_of(t, "byte_bpe_50k.json"), 0] for d, t in pairs(rows)}
    for r in files:
        f = token_files.TokenFile(r["path"])
        assert r["base"] == at
        for i, doc in enumerate(f.keys(0, f.n_docs)):
            assert f.document(i).tolist() == want.pop(doc)
        at += r["n_tokens"]
    assert not want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 1 << 20), max_size=700).map(sorted), st.sampled_from([1, 3, 1 << 22]))
def test_elias_fano(values, scale):
    values = [v * scale for v in values]
    e = EliasFano.from_bytes(EliasFano.of(np.array(values, dtype=np.int64)).to_bytes())
    assert [e[i] for i in range(len(values))] == values
    assert e.slice(0, len(values)).tolist() == values and e.slice(2, 5).tolist() == values[2:5]
    with pytest.raises(IndexError):
        e[len(values)]


def test_elias_fano_is_small():
    values = np.cumsum(np.random.default_rng(0).integers(1, 2000, 100_000))
    assert len(EliasFano.of(values).to_bytes()) < 1.6 * len(values)  # 64-bit offsets would take 8 bytes each
