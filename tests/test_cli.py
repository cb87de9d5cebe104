from __future__ import annotations

import pytest

from corvex.cli import main
from corvex.config import IndexConfig, QueryError
from corvex.index import SearchIndex
from corvex.operators.search import search
from corvex.sources import database


def test_commands(spark, tmp_path):
    root = f"file://{tmp_path}/root"
    rows = [(1, "White whale", "a book"), (2, "Whales", "of the whale"), (3, "Ships", None)]
    spark.createDataFrame(rows, "id int, title string, doc string").write.parquet(f"{tmp_path}/t")
    assert main(["index", f"{root}/books", f"{tmp_path}/t", "--key", "id", "--fields", "title,doc"], spark) == ["3 documents added"]
    assert main(["list", root], spark) == ["books"]
    assert main(["search", f"{root}/books", "title=whale+", "--unscored"], spark) == ["1", "2"]
    scored = main(["search", f"{root}/books", "title=ships", "-k", "1"], spark)
    assert len(scored) == 1 and scored[0].startswith("3\t")
    assert main(["remove", f"{root}/books", "2", "9"], spark) == ["1 documents removed"]
    assert main(["optimize", f"{root}/books"], spark) == ["optimized"]
    with pytest.raises(QueryError):
        main(["search", f"{root}/books", "title=whales"], spark)
    assert main(["drop", f"{root}/books"], spark) == ["dropped"] and main(["list", root], spark) == []


def test_paragraphs_of_a_file(spark, tmp_path):
    (tmp_path / "book.txt").write_text("one isle\n\ntwo\nisles\n\nthree")
    args = ["index", f"file://{tmp_path}/x", str(tmp_path / "book.txt"), "--fields", "doc", "--format", "paragraphs"]
    assert main(args, spark) == ["3 documents added"]
    assert main(["search", f"file://{tmp_path}/x", 'doc="two isles"', "--unscored"], spark) == ["2"]


@pytest.mark.parametrize("positions", [True, False])
def test_an_index_in_a_database(spark, tmp_path, positions):
    config = IndexConfig("c", ("doc",), proximity_index=positions)
    ix = SearchIndex(spark, f"file://{tmp_path}/index", config).initialize()
    ix.add({"a": {"doc": "light winds"}, "b": {"doc": "winds light"}, "c": {"doc": ""}, "d": {"doc": "x " * 3000}})
    url = f"jdbc:derby:memory:{tmp_path.name};create=true"
    for _ in range(2):
        database.save(ix.tables(), url, "t_")
    t = database.load(spark, url, "t_")
    assert t.config == ix.config and t.max_id == 4 and t.averages == ix.tables().averages
    for query in ('"light winds"', "winds", "x"):
        want, _ = search(ix.tables(), {"doc": query}, scored=query == "x")
        found, _ = search(t, {"doc": query}, scored=query == "x")
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
