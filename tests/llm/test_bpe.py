from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corvex.llm import bpe
from tests.llm import brute
from tests.llm.data import awkward, frame, got, pairs, wanted

COLUMNS = ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@pytest.fixture(scope="module")
def model():
    return bpe.model(bpe.default_path())


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("abcXYZ'’ \n\t\x1cİ<|>123 ")), max_size=60))
def test_ids_are_those_of_the_library(text):
    m = bpe.model(bpe.default_path())
    ids = brute.ids_of(text, "word_bpe_49k.json")
    assert m.encode(text) == ids
    assert m.decode(ids) == brute.library("word_bpe_49k.json").decode(ids, skip_special_tokens=False)


def test_added_tokens_and_contractions(model):
    for text in ("<|endoftext|>", "a<|startoftext|>b <|endoftext|>", "<|endoftext", "it's'sly 'LL x", "a'b''c"):
        assert model.encode(text) == brute.ids_of(text, "word_bpe_49k.json")


def test_long_words_take_the_single_tree(model):
    rng = random.Random(3)
    for n in (63, 64, 65, 1000, 20_000):
        text = "".join(rng.choice("abcde") for _ in range(n))
        assert model.encode(text) == brute.ids_of(text, "word_bpe_49k.json")


def test_merge_takes_the_leftmost_of_the_lowest_rank():
    pairs = {1 << 17 | 1: 5 << 17 | 2, 2 << 17 | 1: 1 << 17 | 3}
    assert bpe.merge([1, 1, 1, 1, 1], dict(pairs)) == [3, 2]
    assert bpe.Forest(pairs).merge([[1, 1, 1, 1, 1], [1, 1], [1]]) == [[3, 2], [2], [1]]
    assert bpe.merge([], pairs) == [] and bpe.merge([1], pairs) == [1]


def test_a_full_memo_changes_nothing(model, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_WORDS", 0)
    fresh = bpe.SegmentTreeBPE(bpe.default_path())
    text = "some words that a table of no size can't hold, some words"
    assert fresh.encode(text) == model.encode(text) and not fresh.memo


def test_awkward_documents(spark):
    rows = awkward()
    rows += rows[15:18]
    assert got(bpe.digests(frame(spark, rows, clashing=True)), *COLUMNS) == wanted(brute.bpe(pairs(rows)))


def test_null_ids_and_empty_table(spark):
    assert got(bpe.digests(frame(spark, [(None, "a b", None, None, None)])), "doc_id", "n_tokens") == [(None, 2)]
    assert got(bpe.digests(frame(spark, [])), *COLUMNS) == []


def test_decoding(spark):
    df = spark.createDataFrame([(1, [320, 49407]), (2, None), (3, [])], "doc_id long, ids array<int>")
    lib = brute.library("word_bpe_49k.json")
    assert got(bpe.decode(df), "doc_id", "decoded") == [(1, lib.decode([320, 49407], skip_special_tokens=False)), (2, ""), (3, "")]
