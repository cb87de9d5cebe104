"""The pipeline against its stages by brute force."""

from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline
from corvex.llm import quality, secrets
from corvex.llm._common import stage
from tests.llm import brute
from tests.llm.data import DOCS, awkward, frame, got, pairs, wanted
from tests.llm.test_packing import COLUMNS, check
from tests.llm.test_quality import mixed

SF = "/root/testdata/sf0.001"


def documents(spark) -> list[tuple]:
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select(*(c.split()[0] for c in DOCS.split(", "))).collect()]


def test_stages_against_brute_force(spark):
    import random

    extra = [(d + 10_000, *r) for d, *r in mixed(random.Random(2))]
    extra += [(d + 50_000, *r) for d, *r in extra[:7]]
    rows = documents(spark) + extra + [(90_000, None, None, None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    columns = docs.columns

    docs = stage(corpus_pipeline.quality_rules(spark, docs, SF), "q")
    assert docs.columns == columns
    stats = [r.asDict() for r in quality.statistics(spark.createDataFrame(rows, DOCS)).collect()]
    d2 = brute.mcd(stats, quality.FLOORS, quality.SUPPORT, quality.STEPS, quality.LEAST, everyone=True)
    failed = {r[0] for r in brute.quality(pairs(rows)) if r[6]}
    rows = [r for r in rows if r[0] not in failed and not (d2[r[0]] or 0) > quality.CUTOFF]
    assert got(docs, *columns) == wanted(rows)

    docs = stage(corpus_pipeline.drop_common_lines(spark, docs, SF), "l")
    assert docs.columns == columns
    found = {r["doc_id"]: r["text"] for r in docs.collect()}
    want = {d: digest for d, _, _, digest in brute.line_dedup(pairs(rows))}
    assert {d: brute.sha(t or "") for d, t in found.items()} == want
    rows = [(d, found[d], a, b, None if found[d] is None else len(found[d])) for d, _, a, b, _ in rows]
    assert got(docs, *columns) == wanted(rows)

    docs = stage(corpus_pipeline.drop_near_duplicates(spark, docs, SF), "n")
    stay = {d for d, _, _, kept in brute.near_dup(pairs(rows), 5) if kept}
    rows = [r for r in rows if r[0] in stay]
    assert got(docs, *columns) == wanted(rows)

    docs = stage(corpus_pipeline.mask_secrets(spark, docs, SF), "s")
    found = {r["doc_id"]: r["text"] for r in docs.collect()}
    marked = {d for d, *n, _ in brute.secrets(pairs(rows)) if any(n)}
    assert all((found[d] == t) or d in marked or any(f"[{r.kind.upper()}]" in found[d] for r in secrets.MORE_RULES) for d, t in pairs(rows))
    assert all("[" in found[d] for d in marked)
    assert not [d for d, *n, _ in brute.secrets(list(found.items())) if any(n)]
    rows = [(d, found[d], a, b, None if found[d] is None else len(found[d])) for d, _, a, b, _ in rows]
    assert got(docs, *columns) == wanted(rows)

    check(got(corpus_pipeline.pack_windows(spark, docs, SF), *COLUMNS), rows)


def test_run_is_its_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, step in corpus_pipeline.STAGES:
        docs = stage(step(spark, docs, SF), name)
    assert got(corpus_pipeline.run(spark, SF), "doc_id", "start", "length", "ids_crc32") == got(docs, "doc_id", "start", "length", "ids_crc32")


def test_empty_documents(spark):
    docs = spark.createDataFrame([], DOCS)
    for name, step in corpus_pipeline.STAGES:
        docs = stage(step(spark, docs, SF), name)
    assert docs.count() == 0


def test_extra_columns_with_clashing_names(spark):
    rows = awkward() + [(d + 20_000, *r) for d, *r in awkward(3)] + [(None, "a null id, " * 9 + "and other words of its own to pass the rules", None, None, 1)]
    docs = frame(spark, rows, clashing=True).withColumn("row", F.lit("x")).withColumn("h", F.lit("x"))
    want, plain = docs, frame(spark, rows)
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs, plain = stage(step(spark, docs, SF), name), stage(step(spark, plain, SF), name)
        assert docs.columns == want.columns
        assert got(docs, *plain.columns) == got(plain, *plain.columns)
    assert got(docs, "row", "h", "spans", "kept")[0] == ("x",) * 4 and plain.count() > 20
    check(got(corpus_pipeline.pack_windows(spark, docs, SF), *COLUMNS), [tuple(r) for r in plain.collect()])
