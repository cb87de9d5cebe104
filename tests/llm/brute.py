"""Brute-force versions of the queries, in plain Python over rows of (doc_id, text)."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


@lru_cache
def library(name: str):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.no_truncation()
    t.no_padding()
    return t


def ids_of(text: str | None, name: str) -> list[int]:
    return library(name).encode(text or "", add_special_tokens=False).ids


def crc(ids: list[int]) -> int:
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def bpe(docs) -> list[tuple]:
    out = []
    for doc, text in docs:
        ids = ids_of(text, "word_bpe_49k.json")
        out.append((doc, len(ids), sha(" ".join(map(str, ids))), sha(library("word_bpe_49k.json").decode(ids, skip_special_tokens=False))))
    return out


def secrets(docs) -> list[tuple]:
    kinds = (
        ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
        ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
    )
    out = []
    for doc, text in docs:
        found = [(m.start(), k, name, m.end()) for k, (name, p, ok) in enumerate(kinds) for m in p.finditer(text or "") if ok(m)]
        n = Counter(f[2] for f in found)
        out.append((doc, n["assign"], n["access"], n["hex"], sha(",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found)))))
    return out


def shingle_set(text: str | None, words: int) -> frozenset:
    w = WORD.findall((text or "").translate(UPPER))
    if not w:
        return frozenset()
    k = min(words, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def near_dup(docs, words: int, threshold: int = 80) -> list[tuple]:
    """Every pair that shares a shingle is measured."""
    sets = [shingle_set(t, words) for _, t in docs]
    by = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            by[x].append(i)
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(sets):
        common = Counter(j for x in s for j in by[x] if j < i)
        for j, c in common.items():
            if 100 * c >= threshold * (len(s) + len(sets[j]) - c):
                root[find(i)] = find(j)
    least: dict[int, int] = {}
    for i, (doc, _) in enumerate(docs):
        r = find(i)
        least[r] = min(least.get(r, doc), doc)
    return [(doc, len(sets[i]), least[find(i)], doc == least[find(i)]) for i, (doc, _) in enumerate(docs)]


BLANK = " \t\n\x0b\x0c\r"


def line_dedup(docs, threshold: int = 10) -> list[tuple]:
    key = lambda line: line.strip(BLANK).translate(UPPER)
    seen = Counter(k for _, t in docs for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for doc, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if seen[key(x)] < threshold]
        out.append((doc, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return out


def token_files(docs) -> list[tuple]:
    out, start = [], 0
    for doc, text in sorted(docs, key=lambda d: d[0]):
        ids = [*ids_of(text, "byte_bpe_50k.json"), 0]
        out.append((doc, start, len(ids), crc(ids)))
        start += len(ids)
    return out


def warc(pages) -> list[tuple]:
    of = defaultdict(list)
    for page, _, html in pages:
        of[(html or "").encode()].append(page)
    out = []
    for page, _, html in pages:
        raw = (html or "").encode()
        first = max(of[raw]) if len(raw) >= 1000 else page
        out.append((page, len(raw), hashlib.sha1(raw).hexdigest(), "response" if first == page else "revisit", None if first == page else first))
    return out


def tokens_of(text: str | None) -> list[str]:
    return [*WORD.findall((text or "").translate(UPPER)), "\n"]


def held_out(doc) -> bool:
    return zlib.crc32(str(doc).encode()) % 5 == 1


def lm_base(docs) -> list[tuple]:
    counts = Counter(t for doc, text in docs if not held_out(doc) for t in tokens_of(text))
    n, v = sum(counts.values()), len(counts)
    return [(doc, held_out(doc), len(ts := tokens_of(text)), sum(counts[t] > 0 for t in ts), n, sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts)) for doc, text in docs]


def lm_mixed(docs, rounds: int = 200) -> dict:
    """log10 probabilities by deleted interpolation, where each training token is left out in turn."""
    train = [tokens_of(t) for doc, t in docs if not held_out(doc)]
    one, two = Counter(t for ts in train for t in ts), Counter(p for ts in train for p in zip(["\n", *ts], ts, strict=False))
    n, v = sum(one.values()), len(one)
    bucket = lambda c: min(c.bit_length(), 39)
    ways = lambda h, w, less: ((two[h, w] - less) / (one[h] - less) if one[h] > less else 0.0, (one[w] - less) / max(n - less, 1), 1 / (v + 1))
    points = defaultdict(list)
    for ts in train:
        for h, w in zip(["\n", *ts], ts, strict=False):
            points[bucket(one[h] - 1)].append(ways(h, w, 1))
    points[-1] = [p for b in list(points) for p in points[b]]
    mix = {}
    for b, ps in points.items():
        p, w = np.array(ps).reshape(-1, 3), np.full(3, 1 / 3)
        for _ in range(rounds if len(p) else 0):
            part = p * w
            w = (part / part.sum(axis=1, keepdims=True)).mean(axis=0)
        w = np.maximum(w, 1e-6)
        mix[b] = w / w.sum()
    score = lambda ts: sum(math.log10(mix.get(bucket(one[h]), mix[-1]) @ np.array(ways(h, w, 0))) for h, w in zip(["\n", *ts], ts, strict=False))
    return {doc: score(tokens_of(t)) for doc, t in docs}


def neighbours(vectors, k: int = 10, every: int = 100) -> dict[int, list[tuple[int, float]]]:
    good = [(i, np.array(v, float)) for i, v in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    ids, x = np.array([i for i, _ in good]), np.array([v for _, v in good])
    out = {}
    for i, v in good:
        if i % every == 0:
            d = np.sqrt(((x - v) ** 2).sum(axis=1))
            order = [j for j in np.lexsort((ids, d)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), float(d[j])) for j in order]
    return out


def quality(docs) -> list[tuple]:
    out = []
    for doc, text in docs:
        text = text or ""
        w = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
        out.append((doc, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed))
    return out


def least_determinant(own, floors, support: float, steps: int, quantile) -> tuple:
    """The mean, the covariance and the log determinant by concentration from four starts."""
    floor = np.diag(np.square(floors))
    m = quantile(own, 0.5)
    mad = 1.4826 * quantile(np.abs(own - m), 0.5)
    width = np.sqrt(mad**2 + np.diag(floor))
    z = (own - m) / width
    u = z / np.sqrt(np.maximum((z**2).sum(axis=1, keepdims=True), 1e-12))
    starts = [(m, np.diag(mad**2) + floor), (own.mean(axis=0), np.cov(own.T, bias=True) + floor), (m, own.shape[1] * (u.T @ u) / len(own) * np.outer(width, width) + floor)]

    def step(m, cov):
        d = np.einsum("ij,jk,ik->i", own - m, np.linalg.inv(cov), own - m)
        some = own[d <= quantile(d, support)]
        cov = np.cov(some.T, bias=True) + floor
        return some.mean(axis=0), cov, np.linalg.slogdet(cov)[1]

    near = own[(z**2).sum(axis=1) <= quantile((z**2).sum(axis=1), 0.5)]
    starts.append((near.mean(axis=0), np.cov(near.T, bias=True) + floor))
    ends = []
    for m, cov in starts:
        for _ in range(steps):
            m, cov, det = step(m, cov)
        ends.append((m, cov, det))
    best = min(ends, key=lambda e: e[2])
    for _ in range(30):
        new = step(*best[:2])
        fell = new[2] < best[2] - 1e-6
        best = new if new[2] < best[2] else best
        if not fell:
            break
    return best


def mcd(stats: list[dict], floors, support: float, steps: int, least: int, everyone: bool = False) -> dict:
    """doc_id to squared robust distance, or None: concentration steps over each group's transformed statistics.

    A group is a source of a language, or the small ones of it. With everyone, what is still too small is judged by the
    whole language, or by all documents.
    """
    share = lambda part, whole: math.asin(math.sqrt(min(1.0, part / max(whole, 1))))
    x = {r["doc_id"]: np.array([math.log1p(r["n_words"]), math.log((r["word_chars"] + 250) / (r["n_words"] + 50)), share(r["n_symbols"], r["word_chars"]), share(r["n_dup_lines"], r["n_lines"]), share(r["n_repeat_words"], r["n_words"])]) for r in stats}
    clean = [r for r in stats if not r["base_failed"]]
    size = Counter((r["lang"], r["source"]) for r in clean)
    group = {r["doc_id"]: (r["lang"], r["source"]) if size[r["lang"], r["source"]] >= least else (r["lang"],) for r in stats}
    quantile = lambda v, p: np.sort(v, axis=0)[max(0, math.ceil(p * len(v)) - 1)]
    members = {g: [r["doc_id"] for r in clean if group[r["doc_id"]] == g] for g in set(group.values())}
    if everyone:
        lang = {r["doc_id"]: r["lang"] for r in stats}
        whole = {v: [r["doc_id"] for r in clean if r["lang"] == v] for v in set(lang.values())}
        small = {g for g, own in members.items() if len(own) < least}
        for i, g in group.items():
            if g in small:
                group[i] = ("whole", lang[i], None) if len(whole[lang[i]]) >= least else ("all",) * 4
        members |= {("whole", v, None): own for v, own in whole.items()} | {("all",) * 4: [r["doc_id"] for r in clean]}
    d2 = lambda v, m, cov: np.einsum("ij,jk,ik->i", v - m, np.linalg.inv(cov), v - m)
    out = dict.fromkeys(x)
    for g in set(group.values()):
        own = np.array([x[i] for i in members[g]]).reshape(-1, 5)
        if len(own) < (least if len(g) < 4 else 1):
            continue
        m, cov, _ = least_determinant(own, floors, support, steps, quantile)
        scale = max(1.0, quantile(d2(own, m, cov), 0.5) / 4.351)
        ids = [i for i in x if group[i] == g]
        out |= dict(zip(ids, (d2(np.array([x[i] for i in ids]), m, cov) / scale).tolist(), strict=True))
    return out
