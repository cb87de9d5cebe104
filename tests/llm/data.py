"""Small tables with every awkward case."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use themselves.
CLASHING = "key string, ids string, decoded string, spans string, a string, b string, rep string, g string, own string, label string, regs string, of string, hi string, lo string, n string, common_keys string, x0 string, d2 string, kept string, t string, w string, lines string"


def words(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def awkward(seed: int = 1, ids=range(0, 10_000)) -> list[tuple]:
    """Rows of documents: nulls in any column, empty, blank and very long texts, ties, copies, near copies."""
    rng, ids = random.Random(seed), iter(ids)
    base = words(rng, 300)
    texts = [None, "", " ", "\n\n", "\t \r\n", "one", "one two three", "Ärger ÜBER Straße İstanbul ǅ 漢字   x", "a" * 5000, "\x1c\x1d sep \x85 nel", "<|endoftext|> and <|startoftext|>text", "don't it's I'll 've 12345", "é ẛ̣ ﬁ", "😀😀 \U0001f468‍\U0001f469"]
    texts += [words(rng, 60_000, 5000), words(rng, 9000).replace(" ", "\n")]
    texts += [base, base, base.upper(), base + " tail", base.replace(" ", "  ", 3)]
    many = [words(rng, 120) for _ in range(12)]
    texts += [f"{t}\n  Licence Line \nmore {i}\nlicence line\n" for i, t in enumerate(many)]
    texts += [t + f" end{i}" for i, t in enumerate(many)] + ["licence line", "LICENCE LINE\n\nlast"]
    texts += ["password = 'hunter2hunter2' token:abc SECRET=zzzzzzz apikey = x api_key: \"A1b2C3d4\"", "AKIA" + "A" * 16 + "B7 deadbeefdeadbeefdeadbeef AKIAshort 0123456789abcdef0123456789abcdef", "ſecret=abcdefgh toKen=abcdefgh", "é password=longenough1 " * 3]
    texts += [("the same eight words come again and again here " * 9).strip(), " ".join("x" for _ in range(40)), "$$$ ### " * 30 + words(rng, 30)]
    rows = [(next(ids), t, rng.choice(["en", "fr", None]), rng.choice(["s1", None, "hot"]), None if t is None else len(t)) for t in texts]
    return rows + [(next(ids), words(rng, rng.randrange(25, 200)), "en", "hot", 1) for _ in range(60)]


def frame(spark, rows: list[tuple], parts: int = 3, clashing: bool = False):
    df = spark.createDataFrame(rows, DOCS)
    if clashing:
        from pyspark.sql import functions as F

        df = df.select("*", *(F.lit("x").alias(c.split()[0]) for c in CLASHING.split(", ")))
    return df.repartition(parts)


def pairs(rows: list[tuple]) -> list[tuple]:
    return [(r[0], r[1]) for r in rows]


def got(df, *columns: str) -> list[tuple]:
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def wanted(rows) -> list[tuple]:
    return sorted(rows, key=repr)
