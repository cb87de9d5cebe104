"""From clauses to a plan: fields are bound, bare words get their implicit AND, wildcards and plurals expand.

The fold of clauses is compiled to one boolean Column over the flags of a document's leaves.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvex.config import IDF_LEAST, K3, GeneralError, IndexConfig, QueryError
from corvex.plans.parser import AND, NOT, OR, Clause, Group, Phrase, Plural, Query, Term, Wild, parse


@dataclass(frozen=True)
class Leaf:
    """One test of a document: any of the terms in the field, or with a slop all of them in order."""

    field: str
    terms: tuple[str, ...]
    slop: int | None = None
    text: str = ""


@dataclass
class Plan:
    leaves: list[Leaf] = field(default_factory=list)
    roots: list[tuple[str, tuple[Clause, ...]]] = field(default_factory=list)
    of: dict[int, int] = field(default_factory=dict)  # of a clause's body, by place, its leaf
    scored: dict[tuple[str, str], int] = field(default_factory=dict)  # occurrences in the query
    df: dict[tuple[str, str], int] = field(default_factory=dict)
    stopped: list[str] = field(default_factory=list)

    def needed(self) -> set[tuple[str, str]]:
        return {(x.field, t) for x in self.leaves for t in x.terms}


def _wild_terms(stats: DataFrame, name: str, pattern: str, config: IndexConfig) -> dict[str, int]:
    """The terms of a pattern, with their document frequencies."""
    prefix = pattern.replace("?", "*").split("*")[0]
    if len(prefix) < config.min_wildcard_length:
        raise QueryError(config.message("wildcard_length", n=config.min_wildcard_length))
    like = pattern.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%").replace("?", "_")
    found = stats.filter((F.col("field") == name) & F.startswith("term", F.lit(prefix)) & F.col("term").like(like)).select("term", "df").limit(config.max_wildcard_term_expansion + 1).collect()
    if len(found) > config.max_wildcard_term_expansion:
        raise QueryError(config.message("wildcard_expansion"))
    return {r["term"]: r["df"] for r in sorted(found)}


def _all_terms(clauses: tuple[Clause, ...], name: str, config: IndexConfig):
    """The (field, term) pairs that clauses could ask statistics of."""
    for c in clauses:
        own = c.field if c.field in config.doc_fields else name
        b = c.body
        if isinstance(b, Group):
            yield from _all_terms(b.clauses, own, config)
        elif isinstance(b, Term):
            yield from ((own, b.term), (name, b.term))
        elif isinstance(b, Plural):
            yield from ((own, b.term), (own, b.term + "s"), (name, b.term))
        elif isinstance(b, Phrase):
            yield from ((own, t) for t in b.terms)


def frequencies(stats: DataFrame, pairs: set[tuple[str, str]]) -> dict[tuple[str, str], int]:
    """The document frequency of each pair that is in the index, by one job."""
    if not pairs:
        return {}
    by_field: dict[str, list[str]] = {}
    for name, term in sorted(pairs):
        by_field.setdefault(name, []).append(term)
    hit = F.lit(False)
    for name, own in by_field.items():
        hit = hit | ((F.col("field") == name) & F.col("term").isin(own))
    return {(r["field"], r["term"]): r["df"] for r in stats.filter(hit).collect()}


def implicit_and(clauses: tuple[Clause, ...], df: Callable[[str], int]) -> tuple[Clause, ...]:
    """Bare words with their implicit AND: phrases, and the rarest two words, or three of more than four.

    Clauses with an operator or a sub-query are left as they are. df is that of the outer field; a wildcard's is 0.
    """
    if any(c.conj or c.mod != OR or isinstance(c.body, Group) for c in clauses):
        return clauses
    bare = [i for i, c in enumerate(clauses) if not isinstance(c.body, Phrase)]
    key = lambda i: 0 if isinstance(clauses[i].body, Wild) else df(clauses[i].body.term)
    order = sorted(bare, key=key)
    must = set(order[: 3 if len(bare) > 4 else 2])
    must |= {i for i, c in enumerate(clauses) if isinstance(c.body, Phrase)}
    return tuple(replace(c, mod=AND) if i in must else c for i, c in enumerate(clauses))


def plan(query: dict[str, str], config: IndexConfig, stats: DataFrame) -> Plan:
    out, parsed = Plan(), {}
    for name, text in query.items():
        if text is None or not str(text).strip():
            continue
        if name not in config.doc_fields:
            raise GeneralError(f"there is no field {name}")
        parsed[name] = parse(str(text), config)
    if not parsed:
        raise QueryError(config.message("empty_query"))
    order = sorted(parsed, key=config.field_no)
    out.df = frequencies(stats, {p for n in order for p in _all_terms(parsed[n].clauses, n, config)})
    for name in order:
        q: Query = parsed[name]
        out.stopped += [w for w in q.stopped if w not in out.stopped]
        clauses = implicit_and(q.clauses, lambda t, name=name: out.df.get((name, t), 0))
        out.roots.append((name, _bind(clauses, name, out, config, stats, True)))
    return out


def _bind(clauses, name, out: Plan, config, stats, scored: bool):
    """Registers the leaves of clauses, and the terms that are scored: those that no NOT is above."""
    for c in clauses:
        own = c.field if c.field in config.doc_fields else name
        b, counts = c.body, scored and c.mod != NOT
        if isinstance(b, Group):
            _bind(b.clauses, own, out, config, stats, counts)
            continue
        if isinstance(b, Phrase):
            terms, leaf = b.terms, Leaf(own, b.terms, b.slop, b.text)
        else:
            if isinstance(b, Term):
                terms = (b.term,)
            elif isinstance(b, Plural):
                terms = (b.term, b.term + "s")
                found = [out.df[own, t] for t in terms if (own, t) in out.df]
                if found and counts:
                    out.df[own, b.term, "idf"] = sum(found) // len(found)
            else:
                found = _wild_terms(stats, own, b.pattern, config)
                out.df |= {(own, t): n for t, n in found.items()}
                terms = tuple(found)
            leaf = Leaf(own, tuple(terms))
        if leaf not in out.leaves:
            out.leaves.append(leaf)
        out.of[id(c)] = out.leaves.index(leaf)
        if counts:
            for t in terms:
                out.scored[own, t] = out.scored.get((own, t), 0) + 1
    return clauses


def fold(clauses: tuple[Clause, ...], leaf: Callable[[Clause], Column | bool], all_: Column | bool = True):
    """The left-to-right fold of clauses, of Columns or of booleans."""
    both, either, no = (lambda a, b: a & b), (lambda a, b: a | b), (lambda a: not a if isinstance(a, bool) else ~a)
    f, ors, any_ = all_, [], False

    def join(xs):
        u = xs[0]
        for x in xs[1:]:
            u = either(u, x)
        return u

    for c in clauses:
        v = fold(c.body.clauses, leaf, all_) if isinstance(c.body, Group) else leaf(c)
        any_ |= c.mod != NOT
        if c.mod == NOT:
            f = both(f, no(v))
        elif c.mod == AND or c.conj == AND:
            f = both(f, v)
        elif c.conj == OR:
            if ors:
                f, ors = both(f, join(ors)), []
            f = either(f, v)
        else:
            ors.append(v)
    if not any_:
        return False if isinstance(all_, bool) else F.lit(False)
    return both(f, join(ors)) if ors else f


def matches(p: Plan, flag: Callable[[int], Column | bool], all_: Column | bool):
    """Whether a document matches: in any of the fields."""
    out = None
    for _, clauses in p.roots:
        v = fold(clauses, lambda c: flag(p.of[id(c)]), all_)
        out = v if out is None else out | v
    return out


def weights(p: Plan, n: int) -> dict[tuple[str, str], float]:
    """Of each scored term, its inverse document frequency times its weight in the query; common terms are left out."""
    import math

    out = {}
    for (name, term), f_qt in p.scored.items():
        df = p.df.get((name, term, "idf"), p.df.get((name, term), 0))
        ratio = (n - df + 0.5) / (df + 0.5)
        if not df or ratio <= 0 or math.log(ratio) < IDF_LEAST:
            continue
        out[name, term] = math.log(ratio) * (K3 + 1) * f_qt / (K3 + f_qt)
    return out
