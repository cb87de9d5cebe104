"""The command line: load a table, index it, search it, remove documents, list and drop indexes.

    python -m corvex.cli index ROOT/books books.parquet --key id --fields title,text
    python -m corvex.cli search ROOT/books text='+whale "white whale"~3' -k 10
    python -m corvex.cli remove ROOT/books 17 18
    python -m corvex.cli list ROOT
    python -m corvex.cli drop ROOT/books
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from corvex.config import IndexConfig, SearchError
from corvex.index import SearchIndex, collections
from corvex.sources.loaders import paragraphs, table


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="corvex")
    does = top.add_subparsers(dest="does", required=True)
    p = does.add_parser("index", help="index a table, or add to an index that is there")
    p.add_argument("path")
    p.add_argument("source")
    p.add_argument("--key", default="doc_id")
    p.add_argument("--fields", default="text")
    p.add_argument("--format", default="parquet", help="parquet, json, csv, ...; paragraphs: a text file whose paragraphs are column doc")
    p.add_argument("--stoplist", default="")
    p.add_argument("--charset", default="iso-8859-1")
    p.add_argument("--no-positions", action="store_true")
    p = does.add_parser("search", help="print keys and scores")
    p.add_argument("path")
    p.add_argument("query", nargs="+", help="field=query")
    p.add_argument("-k", type=int)
    p.add_argument("--unscored", action="store_true")
    p = does.add_parser("remove", help="remove documents by their keys")
    p.add_argument("path")
    p.add_argument("keys", nargs="+")
    for name in ("optimize", "drop", "list"):
        does.add_parser(name).add_argument("path")
    return top


def _index(spark: SparkSession, a: argparse.Namespace) -> list[str]:
    names = IndexConfig(a.path.rstrip("/").split("/")[-1][:100], tuple(a.fields.split(",")), key=a.key, stoplist=tuple(filter(None, a.stoplist.split(","))), charset=a.charset, proximity_index=not a.no_positions)
    ix = SearchIndex(spark, a.path, names)
    if not ix.exists():
        ix.initialize()
    rows = paragraphs(spark, a.source) if a.format == "paragraphs" else table(spark, a.source, a.format)
    return [f"{ix.add_table(rows)} documents added"]


def _search(spark: SparkSession, a: argparse.Namespace) -> list[str]:
    ix, query = SearchIndex(spark, a.path), dict(q.split("=", 1) for q in a.query)
    if a.unscored:
        return ix.unscored_search(query)[: a.k]
    return [f"{key}\t{score:.4f}" for key, score in ix.search(query, k=a.k).items()]


def main(args: list[str], spark: SparkSession | None = None) -> list[str]:
    """Runs a command and returns the lines that it prints."""
    a = _parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("corvex").getOrCreate()
    if a.does == "index":
        return _index(spark, a)
    if a.does == "search":
        return _search(spark, a)
    if a.does == "list":
        return collections(spark, a.path)
    ix = SearchIndex(spark, a.path)
    if a.does == "remove":
        return [f"{ix.remove(*a.keys)} documents removed"]
    if a.does == "drop":
        ix.delete()
        return ["dropped"]
    ix.optimize()
    return ["optimized"]


if __name__ == "__main__":
    try:
        print("\n".join(main(sys.argv[1:])))
    except SearchError as e:
        sys.exit(str(e))
