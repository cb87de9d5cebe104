from __future__ import annotations

import json
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corvex.llm import library_ids
from corvex.llm._common import slices
from tests.llm import brute
from tests.llm.data import awkward

FILES = ("word_bpe_49k.json", "byte_bpe_50k.json")


def ids(file: str, texts: list[str], narrow: bool = False) -> list[list[int]]:
    found = library_ids.model(public_tokenizers.path(file)).encode_many(texts, narrow)
    return [np.frombuffer(x, "<u2" if narrow else "<u4").tolist() for x in found]


@pytest.mark.parametrize("file", FILES)
def test_both_files_are_rank_tables(file):
    assert library_ids.model(public_tokenizers.path(file)).ranks is not None


@pytest.mark.parametrize("file", FILES)
@settings(max_examples=300, deadline=None)
@given(text=st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.characters(max_codepoint=0x250), st.sampled_from("abc 'strevmld\n\t  <|>!1²½İȺµ")), max_size=50))
def test_ids_are_those_of_the_library(file, text):
    assert ids(file, [text], True) == [brute.ids_of(text, file)]


@pytest.mark.parametrize("file", FILES)
def test_awkward_and_long_texts(file, monkeypatch):
    texts = [r[1] or "" for r in awkward()]
    rng = random.Random(5)
    texts += ["x" * 200_000, " " * 200_000, "".join(rng.choice("ab 'st,.\n1") for _ in range(200_000)), "word " * 50_000]
    want = [brute.ids_of(t, file) for t in texts]
    assert ids(file, texts) == want
    monkeypatch.setattr(library_ids, "CHUNK", 50)
    assert ids(file, texts) == want


def test_a_file_of_another_kind_goes_to_the_library(tmp_path):
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    spec["normalizer"] = {"type": "Lowercase"}
    path = tmp_path / "other.json"
    path.write_text(json.dumps(spec))
    m = library_ids.LibraryIds(str(path))
    assert m.ranks is None
    assert np.frombuffer(m.encode_many(["Some TEXT"])[0], "<u4").tolist() == m.library.encode("some text").ids


def test_slices_are_bounded_by_rows_and_by_bytes():
    rows = ["a" * 10, None, "b" * 3000, "c", "d" * 900, "e" * 200] + ["f"] * 10
    batch = pa.RecordBatch.from_pydict({"i": list(range(len(rows))), "t": rows})
    parts = list(slices(batch, 4, 1000))
    assert [x for p in parts for x in p.column(1).to_pylist()] == rows
    assert all(p.num_rows <= 4 and (p.num_rows == 1 or sum(len(x or "") for x in p.column(1).to_pylist()) <= 1000) for p in parts)
    assert [p.num_rows for p in slices(batch, 7)] == [7, 7, 2]
