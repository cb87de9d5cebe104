from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corvex.config import GeneralError, IndexConfig, QueryError
from corvex.functions.analysis import terms
from corvex.functions.highlight import highlight, snippets
from corvex.index import SearchIndex, collection_count
from corvex.sources import store
from corvex.sources.loaders import numbered, paragraphs
from corvex.streaming.ingest import ingest


@pytest.fixture
def make(spark, tmp_path):
    def new(**options):
        config = IndexConfig(**{"collection": "test", "doc_fields": ("doc",), **options})
        return SearchIndex(spark, f"file://{tmp_path}/index", config).initialize()

    return new


def add(index, **docs):
    return index.add({k.lstrip("_"): {"doc": v} for k, v in docs.items()})


def found(index, query, **how):
    try:
        return index.unscored_search({"doc": query}, **how)
    except QueryError:
        return []


def test_reads_between_writes(make):
    ix = make()
    assert add(ix, _1="a bunch of words", _2="a bunch of different words") == 2
    assert set(ix.search({"doc": "words"})) == {"1", "2"}
    assert add(ix, _3="a bunch of different words, and more words") == 1
    assert set(ix.search({"doc": "more"})) == {"3"}
    assert ix.indexed("1") == 1 and ix.indexed("9") is None
    assert ix.last_indexed_key() == "3" and ix.max_indexed_id() == 3
    assert [r["doc_id"] for r in ix.all_doc_ids().collect()] == [1, 2, 3]
    assert ix.stat("total_words") == 4 + 5 + 7 and ix.stat("other") is None
    again = SearchIndex(ix.spark, ix.store.path)
    assert again.config == ix.config and set(again.search({"doc": "more"})) == {"3"}


def test_stop_word_message(make):
    ix = make(stoplist=("en",), proximity_index=False)
    add(ix, _1="a bunch of words", _2="a bunch of different words")
    with pytest.raises(QueryError, match="These common words were not included in the search: a"):
        ix.search({"doc": "a"})


def test_upsert(make):
    ix = make()
    docs = [
        "foo ist bar und das ist wunderbar",
        "und jetzt wollte ich noch einmal sage, das ich foobar finde!",
        "questions that besieged us in live are testaments of our helplessness",
        "Der Sinn, der sich aussprechen FOO!",
        "und und und und und",
    ]
    add(ix, **{f"_{i}": d for i, d in enumerate(docs, 1)})
    assert set(found(ix, "und")) == {"1", "2", "5"}
    for text in ("wie ist und das und foo bar", "unverfänglicher Text mit dem Wort und"):
        add(ix, _1=text)
        assert set(found(ix, "und")) == {"1", "2", "5"}
    add(ix, _1="Text mit dem Wort")
    assert set(found(ix, "und")) == {"2", "5"}
    assert ix.max_indexed_id() == 8 and ix.indexed("1") == 8
    assert ix.remove("5", "no such") == 1 and ix.remove(["5"]) == 0
    assert found(ix, "und") == ["2"] and found(ix, "und OR sinn") == ["2", "4"]
    ix.optimize()
    assert found(ix, "und") == ["2"] and ix.stat("total_words") == 10 + 11 + 5 + 4


def test_batches_and_last_of_equal_keys(make, spark):
    ix = make(update_commit_interval=3)
    with ix:
        add(ix, a="one", b="two")
        add(ix, a="three", c="four")
        assert ix.max_indexed_id() == 3
        add(ix, d="five")
    assert found(ix, "one") == [] and found(ix, "three") == ["a"] and found(ix, "five") == ["d"]


def test_source_by_key(make, spark):
    ix = make(key="id")
    source = spark.createDataFrame([(1, "red isle"), (2, "blue isle"), (3, None)], "id int, doc string")
    ix.set_source(source)
    assert ix.add_doc(1, 7) == 1 and ix.add_doc([2, 3]) == 2
    assert found(ix, "isle") == ["1", "2"]
    assert ix.indexed(3) == 3


def test_masks(make):
    ix = make()
    add(ix, a="x", b="x", c="x", d="x")
    ix.add_mask("ab", ["a", "b", "nothing"])
    ix.add_mask("bc", ["b", "c"])
    assert found(ix, "x", and_mask=["ab", "bc"]) == ["b"]
    assert found(ix, "x", not_mask=["ab"]) == ["c", "d"]
    assert found(ix, "x", or_mask=["ab", "bc"]) == ["a", "b", "c"]
    assert found(ix, "x", or_mask_set=[["ab"], ["bc", "unknown"], ["unknown"]]) == ["b"]
    assert found(ix, "x", and_mask=["unknown", ["a", "d"]]) == ["a", "d"]
    assert ix.delete_mask("ab") and not ix.delete_mask("ab")
    assert found(ix, "x", not_mask=["ab"]) == ["a", "b", "c", "d"]
    with pytest.raises(GeneralError):
        ix.find({"doc": "x"}, nonsense=["a"])


def test_phrases_and_proximity(make):
    ix = make()
    add(ix, a="light airs and fair winds", b="light winds", c="winds light", d="a b b x c", e="a b c")
    assert found(ix, '"light winds"') == ["b"] and found(ix, '"LIGHT WINDS"~4') == ["a", "b"]
    assert found(ix, '"a b c"') == ["e"] and found(ix, '"a b c"~2') == ["d", "e"]
    assert found(ix, "light-winds") == ["b"] and found(ix, '"wind* light"') == []


def test_phrases_without_positions(make, spark):
    ix = make(proximity_index=False, key="id")
    source = spark.createDataFrame([("a", "fair  winds"), ("b", "winds fair"), ("c", "Fair winds!")], "id string, doc string")
    ix.set_source(source)
    ix.add_table(source)
    assert found(ix, '"fair winds"') == ["c"]
    assert ix.tables().postings.filter("positions is not null").isEmpty()


def test_wildcards(make):
    ix = make(max_wildcard_term_expansion=3, min_wildcard_length=2)
    add(ix, a="aba abb abc abd", b="xyz x_z")
    assert found(ix, "xy*") == ["b"] and found(ix, "xy?") == ["b"] and found(ix, "ab?d") == []
    for broad in ("ab*", "x*"):
        with pytest.raises(QueryError):
            ix.search({"doc": broad})


def test_common_terms_are_not_scored(make):
    ix = make()
    add(ix, **{f"d{i:02}": "every word" + (" rare" if i == 7 else "") for i in range(20)})
    with pytest.raises(QueryError):
        ix.search({"doc": "every"})
    assert len(found(ix, "every")) == 20 and list(ix.search({"doc": "rare"})) == ["d07"]


def test_errors(make):
    ix = make()
    add(ix, a="x")
    for query in (None, {}, {"doc": " "}):
        with pytest.raises(QueryError):
            ix.search(query)
    with pytest.raises(GeneralError):
        ix.search({"other": "x"})
    with pytest.raises(GeneralError):
        ix.search({"doc": "x"}, scoring_method="none")
    ix.delete()
    assert not ix.exists()
    with pytest.raises(GeneralError):
        SearchIndex(ix.spark, ix.store.path)


def test_two_writers(make):
    ix = make()
    m = ix.manifest()
    ix.store.publish(m)
    with pytest.raises(GeneralError, match="another writer"):
        ix.store.publish(m)


def test_analysis(spark):
    c = IndexConfig("c", ("t",))
    got = lambda text, config=c: spark.createDataFrame([(text,)], "t string").select(terms(F.col("t"), config).alias("x")).first()["x"]
    assert got("A<b>c</b>d <i\n>e") == ["a", "c", "d", "i", "e"]
    assert got("&lt;b&gt; &#228;&#xE4; &amp;lt; &nosuch; &eacute &#1114112;") == ["b", "aa", "lt", "nosuch", "e", "1114112"]
    assert got("Größe ÆŒ naïve_x") == ["grosse", "aeoe", "naive", "x"]
    assert got("x" * 30) == ["x" * 20] and got(None) == [] and got("") == []
    assert got("Žluťoučký kůň", c.with_(charset="iso-8859-2")) == ["zlutoucky", "kun"]
    assert got("the isle of x", c.with_(stoplist=("en", "cz"))) == ["isle", "x"]


def test_highlight(spark):
    df = spark.createDataFrame([("That cat, that concat",)], "t string")
    assert df.select(highlight(F.col("t"), ["that", "c*t"])).first()[0] == "<b><u>That</u></b> <b><u>cat</u></b>, <b><u>that</u></b> <b><u>concat</u></b>"
    assert df.select(snippets(F.col("t"), ["cat"], 3)).first()[0] == ["at cat, t"]


def test_loaders(spark, tmp_path):
    (tmp_path / "book.txt").write_text("one\nline\n\ntwo\n\n\n\nthree")
    assert [tuple(r) for r in paragraphs(spark, str(tmp_path / "book.txt")).orderBy("doc_id").collect()] == [(1, "one line"), (2, "two"), (3, "three")]
    rows = numbered(spark.range(1000).selectExpr("id * 7 % 1000 as k"), ["k"], start=5).orderBy("k").collect()
    assert [r["doc_id"] for r in rows] == list(range(6, 1006))


def test_stream(make, spark, tmp_path):
    ix = make()
    folder = tmp_path / "in"
    spark.createDataFrame([("a", "one", False), ("b", "two", False)], "doc_key string, doc string, gone boolean").write.parquet(f"{folder}/1")
    stream = spark.readStream.schema("doc_key string, doc string, gone boolean").parquet(f"{folder}/*")
    ingest(stream, ix, str(tmp_path / "cp"), removed="gone", availableNow=True).awaitTermination()
    assert found(ix, "one OR two") == ["a", "b"]
    spark.createDataFrame([("a", None, True), ("c", "two", False)], "doc_key string, doc string, gone boolean").write.parquet(f"{folder}/2")
    ingest(stream, ix, str(tmp_path / "cp"), removed="gone", availableNow=True).awaitTermination()
    assert found(ix, "one OR two") == ["b", "c"]


def test_collections(make, spark, tmp_path):
    make()
    assert collection_count(spark, f"file://{tmp_path}") == 1


def test_all_tables_of_a_commit_agree_when_executors_are_lost(make, spark):
    """Documents whose order and ties a second evaluation would change get one set of ids, which all tables have."""
    rows = spark.range(400).repartition(7).select((F.col("id") % 300).cast("string").alias("doc_key"), F.concat_ws(" ", F.lit("word"), F.concat(F.lit("n"), F.rand().cast("string"))).alias("doc"))
    ix = make()
    ix.add_table(rows)
    t = ix.tables()
    plans = [df._jdf.queryExecution().toString() for df in (t.docs, t.postings, t.doc_weights)]
    assert all("InMemoryRelation" not in p and "rand(" not in p for p in plans)
    assert spark.sparkContext._jsc.getPersistentRDDs().isEmpty()
    ids = {r["doc_id"] for r in t.docs.collect()}
    assert ids == set(range(1, 301)) == {r["doc_id"] for r in t.postings.collect()} == {r["doc_id"] for r in t.doc_weights.collect()}
    assert not ix.store.files.exists(f"{ix.store.path}/staging")


def test_a_common_term_is_in_many_files(make, spark, monkeypatch):
    monkeypatch.setattr(store, "CHUNK_BITS", 8)
    ix = make()
    ix.add_table(spark.range(4000).select(F.col("id").cast("string").alias("doc_key"), F.lit("same").alias("doc")))
    ix.store.files.delete(f"{ix.store.path}/staging")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ix.optimize()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = ix.tables().postings.groupBy(F.input_file_name().alias("f")).count().collect()
    assert len(files) == 4 and max(r["count"] for r in files) < 2500
    assert set(found(ix, "same")) == {str(i) for i in range(4000)}


def test_batches_are_merged_and_averages_kept(make):
    ix, texts = make(max_batches=3), {}
    for i in range(9):
        texts |= {f"k{i}": f"word{i} common text" + " more" * i, f"k{i // 2}": f"again{i} common"}
        assert ix.add({f"k{i}": {"doc": texts[f"k{i}"]}, f"k{i // 2}": {"doc": texts[f"k{i // 2}"]}}) in (1, 2)
        if i == 4:
            assert ix.remove("k4") == 1 and not texts.pop("k4") == ""
    m = ix.manifest()
    assert len(m.batches) <= 3 and sum(m.sizes.values()) == m.max_id
    assert set(found(ix, "common")) == set(texts)
    live = ix.store.doc_weights(m).join(ix.store.dead(m), "doc_id", "left_anti").agg(F.sum("w_d")).first()[0]
    assert m.sums["doc"] == pytest.approx(live) and m.averages["doc"] == pytest.approx(live / m.max_id)
    assert ix.tables().term_stats.filter("term = 'common'").first()["df"] == m.max_id


def test_what_a_batch_adds_counts_when_it_is_added(make, spark, tmp_path):
    ix, path = make(), str(tmp_path / "source")
    spark.createDataFrame([("a", "first")], "doc_key string, doc string").write.parquet(path)
    with ix:
        ix.add_table(spark.read.parquet(path))
        spark.createDataFrame([("a", "second")], "doc_key string, doc string").write.mode("overwrite").parquet(path)
    assert found(ix, "first") == ["a"] and found(ix, "second") == []


def test_all_hits_without_a_limit(make, spark):
    ix = make()
    rows = spark.range(2600).select(F.col("id").cast("string").alias("doc_key"), F.when(F.col("id") < 1200, "some word").otherwise("other").alias("doc"))
    ix.add_table(rows)
    assert len(ix.search({"doc": "some"})) == 1200 and len(ix.search({"doc": "some"}, k=5)) == 5


def test_phrases_on_both_sides_of_the_threshold(make, spark):
    for most, want in ((None, ["c"]), (3, ["c"]), (2, ["a", "b", "c"])):
        ix = make(proximity_index=False, phrase_threshold=most)
        source = spark.createDataFrame([("a", "fair  winds"), ("b", "winds fair"), ("c", "fair winds")], "doc_key string, doc string")
        ix.set_source(source)
        ix.add_table(source)
        assert found(ix, '"fair winds"') == want
        ix.delete()


def test_vacuum(make):
    ix = make()
    add(ix, a="one", b="two")
    add(ix, a="three")
    ix.add_mask("m", ["a"])
    ix.optimize()
    assert ix.vacuum() == 3 and ix.vacuum() == 0  # two batches and a tombstone
    assert found(ix, "three", and_mask=["m"]) == ["a"] and found(ix, "one OR two") == ["b"]
    again = SearchIndex(ix.spark, ix.store.path)
    assert again.manifest() == ix.manifest() and add(again, c="four") == 1 and found(ix, "four") == ["c"]


def test_one_writer_publishes_a_name(make):
    ix = make()
    path = f"{ix.store.path}/manifests/x"
    assert ix.store.files.write_new(path, "one") and not ix.store.files.write_new(path, "two")
    assert ix.store.files.read(path) == "one"


def test_postings_of_repeated_terms(make):
    ix = make()
    add(ix, a="x y x z x", b="", c="y")
    rows = {(r["term"], r["doc_id"]): (r["tf"], r["positions"]) for r in ix.tables().postings.collect()}
    assert rows == {("x", 1): (3, [1, 3, 5]), ("y", 1): (1, [2]), ("z", 1): (1, [4]), ("y", 3): (1, [1])}
    assert {r["doc_id"]: r["n_terms"] for r in ix.tables().doc_weights.collect()} == {1: 5, 2: 0, 3: 1}


def test_fetch_and_warm(make, spark):
    ix = make(key="id")
    source = spark.createDataFrame([(1, "red isle"), (2, None)], "id int, doc string")
    with pytest.raises(GeneralError):
        ix.fetch(1, "doc")
    ix.set_source(source)
    ix.add_table(source)
    assert ix.fetch(1, "doc") == "red isle" and ix.fetch(2, "doc") is None and ix.fetch(3, "doc") is None
    with pytest.raises(GeneralError):
        ix.fetch(1, "other")
    assert ix.warm({"doc": "red isle"}) == 2
    plan = ix.find({"doc": "isle"}, scored=False)._jdf.queryExecution().toString()
    assert "InMemoryRelation" in plan and found(ix, "isle") == ["1"]
    ix.add_table(spark.createDataFrame([(3, "isle")], "id int, doc string"))
    assert found(ix, "isle") == ["1", "3"] and ix.tables().hot is None


def test_marks_are_plain_text(spark):
    df = spark.createDataFrame([("a cat",)], "t string")
    assert df.select(highlight(F.col("t"), ["cat"], "$1\\", "$")).first()[0] == "a $1\\cat$"
