"""What failed, or grew too fast, on larger tables."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

import pyspark
import pytest
from pyspark.sql import functions as F

from corvex.config import IndexConfig
from corvex.functions.analysis import terms
from corvex.index import SearchIndex
from corvex.operators import build, search
from tests.conftest import ROOT


@pytest.fixture
def make(spark, tmp_path):
    def new(**options):
        config = IndexConfig(**{"collection": "test", "doc_fields": ("doc",), **options})
        return SearchIndex(spark, f"file://{tmp_path}/index", config).initialize()

    return new


def test_a_wildcard_that_stands_for_very_many_terms(make, spark, monkeypatch):
    ix = make(max_wildcard_term_expansion=5000)
    ix.add_table(spark.range(1500).select(F.col("id").cast("string").alias("doc_key"), F.concat(F.lit("wher"), "id", F.lit(" other")).alias("doc")))
    every = ix.search({"doc": "wher*"})
    assert len(every) == 1500 and len(set(every.values())) == 1
    few = ix.search({"doc": "(wher1? -wher17) other"})
    monkeypatch.setattr(search, "MANY", 0)
    assert ix.search({"doc": "(wher1? -wher17) other"}) == pytest.approx(few) and len(few) > 0


def test_postings_are_made_in_runs_without_a_shuffle(make, spark, monkeypatch):
    monkeypatch.setattr(build, "RUN", 5)
    rows = spark.createDataFrame([("a", "b a b"), ("b", None), ("c", "c b a c c d e f"), ("d", "a")], "doc_key string, doc string").coalesce(1)
    config = IndexConfig("test", ("doc",))
    docs = build.staged(rows.withColumn("doc_id", F.ascii("doc_key").cast("long")), config)
    posted = build.postings(docs, config)["doc"]
    assert "Exchange" not in posted._jdf.queryExecution().toString()
    found = {(r["term"], r["doc_id"] - 96): (r["tf"], r["positions"]) for r in posted.collect()}
    assert found == {("a", 1): (1, [2]), ("b", 1): (2, [1, 3]), ("a", 3): (1, [3]), ("b", 3): (1, [2]), ("c", 3): (3, [1, 4, 5]), ("d", 3): (1, [6]), ("e", 3): (1, [7]), ("f", 3): (1, [8]), ("a", 4): (1, [1])}


def test_the_texts_of_a_commit_are_shuffled_once(make, spark, monkeypatch):
    made = []
    monkeypatch.setattr("corvex.index.numbered", lambda rows, *a, **b: made.append(rows._jdf.queryExecution().executedPlan().toString()) or numbered(rows, *a, **b))
    from corvex.sources.loaders import numbered

    make().add_table(spark.createDataFrame([("a", "x"), ("b", "y"), ("a", "z")], "doc_key string, doc string"))
    assert made[0].count("Exchange ") == 1


def test_texts_are_not_read_for_phrases_that_count_unverified(make, spark, tmp_path):
    spark.createDataFrame([("a", "fair winds"), ("b", "winds fair")], "doc_key string, doc string").write.parquet(f"{tmp_path}/source")
    ix, source = make(proximity_index=False, phrase_threshold=1), spark.read.parquet(f"{tmp_path}/source")
    ix.set_source(source)
    ix.add_table(source)
    found = ix.find({"doc": '"fair winds"'}, scored=False)
    assert found.count() == 2 and not any("/source/" in f for f in found.inputFiles())


def test_entities_without_a_semicolon(spark):
    df = spark.createDataFrame([("a&ampb &lt;c &amp;amp d&copy",)], "t string")
    got = [df.select(terms(F.col("t"), IndexConfig("p", ("t",), strict_entities=strict))).first()[0] for strict in (True, False)]
    assert got == [["a", "ampb", "c", "amp", "d", "copy"], ["a", "ampb", "c", "amp", "d"]]


_CLUSTER = """
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "{0}").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from corvex.plans import registry
print("rows", registry.QUERIES["database_search"](s, "/root/testdata/sf0.001").count())
"""


def test_an_embedded_database_is_the_drivers(tmp_path):
    """Executors in JVMs of their own don't see it."""
    env = {**os.environ, "PYTHONPATH": ROOT, "PYSPARK_PYTHON": sys.executable, "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_SCALA_VERSION": "2.13"}
    env.pop("PYSPARK_GATEWAY_PORT", None)
    spark_home, home = Path(pyspark.__file__).parent, tmp_path / "home"
    (home / "work").mkdir(parents=True)
    for p in spark_home.iterdir():
        if p.name != "work":
            (home / p.name).symlink_to(p)
    env["SPARK_HOME"] = str(home)
    done = subprocess.run([sys.executable, "-c", _CLUSTER.format(tmp_path)], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=200)
    assert "rows" in done.stdout, done.stderr[-3000:]
