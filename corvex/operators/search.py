"""Matching and ranking in one pass: the postings of a query's terms are grouped by document once.

Each leaf of the query is a flag of the group, each scored term adds to its sum, and the fold of the query is a filter
over the flags. Postings carry their document's weight, so ranking joins nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvex.config import B, K1
from corvex.functions.analysis import fold, fold_word
from corvex.operators.build import Tables
from corvex.plans import planner
from corvex.plans.planner import Leaf, Plan

#: Terms of a query beyond which they are joined as a table, and no longer are in its expressions.
MANY = 64


def _follows(at: Column, slop: int):
    return lambda y: F.exists(at, lambda x: (y > x) & (y <= x + slop))


def in_order(positions: list[Column], slop: int) -> Column:
    """Whether some places of the terms rise by 1 to ``slop`` each."""
    at = positions[0]
    for p in positions[1:]:
        if slop == 1:
            at = F.array_intersect(p, F.transform(at, lambda x: x + 1))
        else:
            at = F.filter(p, _follows(at, slop))
    return F.size(at) > 0


def any_of(pairs: list[tuple[str, str]]) -> Column:
    """Whether a row's field and term are one of the pairs."""
    by_field: dict[str, list[str]] = {}
    for name, term in pairs:
        by_field.setdefault(name, []).append(term)
    out = F.lit(False)
    for name, own in by_field.items():
        out = out | ((F.col("field") == name) & F.col("term").isin(own))
    return out


def _range(pairs) -> Column:
    """A condition that rows of the pairs fulfil, and that Parquet answers by its statistics."""
    by_field: dict[str, list[str]] = {}
    for name, term in pairs:
        by_field.setdefault(name, []).append(term)
    out = F.lit(False)
    for name, own in by_field.items():
        out = out | ((F.col("field") == name) & F.col("term").between(min(own), max(own)))
    return out


def of_pairs(postings: DataFrame, pairs: set[tuple[str, str]]) -> DataFrame:
    """The postings of the pairs; many pairs are a table that is joined, as no expression may grow with them."""
    if len(pairs) <= MANY:
        return postings.filter(any_of(sorted(pairs)))
    known = postings.sparkSession.createDataFrame(sorted(pairs), "field string, term string")
    return postings.filter(_range(pairs)).join(F.broadcast(known), ["field", "term"], "left_semi")


def _hits_of_many(t: Tables, p: Plan, source: DataFrame, scored: bool) -> tuple[DataFrame, list[Column], list[Column]]:
    """The postings of a query with very many terms, the aggregates of its score, and whether a posting is of each leaf."""
    weights = planner.weights(p, t.max_id) if scored else {}
    needed, of = p.needed(), {}
    for i, leaf in enumerate(p.leaves):
        for term in leaf.terms:
            of.setdefault((leaf.field, term), []).append(i)
    rows = [(name, term, weights.get((name, term)), t.averages.get(name) or 1.0, of[name, term]) for name, term in sorted(needed)]
    known = t.docs.sparkSession.createDataFrame(rows, "field string, term string, _w double, _average double, _leaves array<int>")
    hits = source.filter(_range(needed)).join(F.broadcast(known), ["field", "term"])
    tf = (K1 + 1) * F.col("tf") / (K1 * ((1 - B) + B * F.col("w_d") / F.col("_average")) + F.col("tf"))
    score = [F.sum(F.coalesce(tf * F.col("_w"), F.lit(0.0))).alias("score"), F.max(F.col("_w").isNotNull()).alias("scorable")] if scored else []
    return hits, score, [F.array_contains("_leaves", i) for i in range(len(p.leaves))]


def _hits(t: Tables, p: Plan, scored: bool) -> tuple[DataFrame, list[Column]]:
    """One row for each document that has any of the terms, with the score, and the Column of each leaf's flag."""
    needed = p.needed()
    source = t.hot[1] if t.hot and needed <= t.hot[0] else t.postings
    many = len(needed) > MANY
    hits, score_of_many, of_leaf = _hits_of_many(t, p, source, scored) if many else (of_pairs(source, needed), [], [])
    aggs: list[Column] = []
    flags: list[Column] = []
    for i, leaf in enumerate(p.leaves):
        if leaf.slop is None or len(leaf.terms) == 1:
            here = of_leaf[i] if many else (F.col("field") == leaf.field) & F.col("term").isin(list(leaf.terms)) if leaf.terms else F.lit(False)
            aggs.append(F.max(here).alias(f"l{i}"))
            flags.append(F.coalesce(f"l{i}", F.lit(False)))
            continue
        names, what = {}, "positions" if t.config.proximity_index else "tf"
        for j, term in enumerate(dict.fromkeys(leaf.terms)):
            names[term] = f"p{i}_{j}"
            aggs.append(F.first(F.when((F.col("field") == leaf.field) & (F.col("term") == term), F.col(what)), ignorenulls=True).alias(names[term]))
        there = F.lit(True)
        for name in names.values():
            there = there & F.col(name).isNotNull()
        ordered = in_order([F.col(names[term]) for term in leaf.terms], leaf.slop) if t.config.proximity_index else F.lit(True)
        flags.append(F.when(there, ordered).otherwise(False))
    if many:
        aggs += score_of_many
    elif scored:
        score, weights = F.lit(0.0), planner.weights(p, t.max_id)
        for (name, term), w in weights.items():
            average = t.averages.get(name) or 1.0
            tf = (K1 + 1) * F.col("tf") / (K1 * ((1 - B) + B * F.col("w_d") / average) + F.col("tf"))
            score = score + F.when((F.col("field") == name) & (F.col("term") == term), tf * w).otherwise(0.0)
        aggs += [F.sum(score).alias("score"), F.max(any_of(sorted(weights))).alias("scorable")]
    return hits.groupBy("doc_id").agg(*aggs or [F.count(F.lit(1)).alias("hits")]), flags  # all words may be stop words


def search(t: Tables, query: dict[str, str], *, masks: list[tuple[DataFrame, bool]] = (), scored: bool = True, source: DataFrame | None = None) -> tuple[DataFrame, Plan]:
    """doc_id, doc_key and, if scored, score of each live document that matches, and the plan.

    masks: doc_ids to keep (True) or to leave out. A scored search returns documents with a scored term alone.
    """
    p = planner.plan(query, t.config, t.term_stats)
    rows, flags = _hits(t, p, scored)
    if source is not None and not t.config.proximity_index:
        rows, flags = _by_text(rows, flags, p.leaves, source, t)
    everywhere = planner.matches(p, lambda i: False, True)
    if everywhere is True:  # documents without any of the terms match too
        rows = t.docs.join(rows, "doc_id", "left")
    found = rows.filter(planner.matches(p, lambda i: flags[i], F.lit(True)))
    if everywhere is not True:
        found = found.join(t.docs, "doc_id")
    for ids, keep in masks:
        found = found.join(ids, "doc_id", "left_semi" if keep else "left_anti")
    if not scored:
        return found.select("doc_id", "doc_key"), p
    return found.filter("scorable").select("doc_id", "doc_key", "score"), p


def _by_text(rows: DataFrame, flags: list[Column], leaves: list[Leaf], source: DataFrame, t: Tables) -> tuple[DataFrame, list[Column]]:
    """For an index without positions: phrases are looked for in the folded source text.

    source: doc_key and the fields. What is shuffled is whether a text has a phrase, not the text. With a
    ``phrase_threshold``, candidates beyond that number count unverified, and no text is read for them.
    """
    out, most, has = list(flags), t.config.phrase_threshold, {}
    for i, leaf in enumerate(leaves):
        if leaf.slop is None or len(leaf.terms) == 1:
            continue
        if most is None or rows.filter(flags[i]).limit(most + 1).count() <= most:
            text = fold(F.coalesce(F.col(leaf.field).cast("string"), F.lit("")), t.config.charset)
            has[f"has{i}"] = F.contains(text, F.lit(" ".join(fold_word(leaf.text, t.config.charset).split())))
            out[i] = flags[i] & F.coalesce(f"has{i}", F.lit(False))
    if not has:
        return rows, out
    texts = source.select("doc_key", *(c.alias(name) for name, c in has.items())).filter(" OR ".join(has))
    return rows.join(texts.join(t.docs, "doc_key").drop("doc_key"), "doc_id", "left"), out


def top(found: DataFrame, k: int) -> DataFrame:
    """The k best by score, ties by key."""
    return found.orderBy(F.desc("score"), "doc_key").limit(k)
