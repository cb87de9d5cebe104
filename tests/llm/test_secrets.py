from __future__ import annotations

import random
import re

import pytest

from corvex.llm import secrets
from tests.llm import brute
from tests.llm.data import awkward, frame, got, pairs, wanted

COLUMNS = ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def test_awkward_documents(spark):
    rows = awkward()
    rows += rows[-70:-60]
    assert got(secrets.digests(frame(spark, rows, clashing=True)), *COLUMNS) == wanted(brute.secrets(pairs(rows)))


def test_empty_table(spark):
    assert got(secrets.digests(frame(spark, [])), *COLUMNS) == []


def test_random_texts_against_the_plain_expressions():
    rng, s = random.Random(5), secrets.scanner(secrets.RULES)
    bits = ["password", "PassWd", "token", "api_key", "apikey", "secret", "=", ":", " ", "  ", '"', "'", "abcdef", "AKIA", "A1B2C3D4E5F6G7H8", "deadbeef", "0123456789", "é", "ſ", "K", "\n", "-----BEGIN RSA PRIVATE KEY-----", "ghp_", "x" * 36, "xoxb-", "eyJ", "."]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(30))) for _ in range(3000)]
    for text, found in zip(texts, s.scan(texts), strict=True):
        plain = sorted((m.start(), i, r.kind, m.end()) for i, r in enumerate(secrets.RULES) for m in r.expression().finditer(text) if m.end(r.group) - m.start(r.group) >= r.least)
        assert found == [(k, a, b) for a, _, k, b in plain]


@pytest.mark.parametrize("pattern", [r"abc", r"a?bcd", r"(foo|bar)baz", r"x[ab]yz", r"(ab|cd){2,}e", r"[a-z]+", r"ab{3}c", r"(?i:KeY)=", r"a(?=bcd)b", r"(?:ab)*cde", r"qu(?:ick|iet)ly|slow"])
def test_every_match_satisfies_the_query(pattern):
    """Texts that match always hold what the query asks for."""
    rng, query, p = random.Random(pattern), secrets.trigram_query(pattern), re.compile(pattern, re.A)

    def holds(q, text: bytes) -> bool:
        if q is secrets.ANY:
            return True
        if q[0] == "tri":
            return bytes([q[1] >> 16, q[1] >> 8 & 255, q[1] & 255]) in text
        return (all if q[0] == "and" else any)(holds(x, text) for x in q[1])

    letters = sorted(set(re.sub(r"[^a-zA-Z=]", "", pattern)))
    for _ in range(20_000):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(3, 14)))
        if p.search(text):
            assert holds(query, text.lower().encode())


def test_queries_of_the_rules():
    of = {r.kind: secrets.trigram_query(r.pattern) for r in secrets.RULES}
    assert of["hex"] is secrets.ANY  # scanned fully
    assert of["access"] == ("and", (("tri", 0x616B69), ("tri", 0x6B6961)))
    assert all(q is not secrets.ANY for k, q in of.items() if k != "hex")


def test_planted_credentials_and_their_look_alikes(spark):
    """Spans of the added kinds, worked out from how each text was put together."""
    long = "Ab1" * 14
    real = {
        "private_key": "-----BEGIN RSA PRIVATE KEY-----\nMIIEow\nIBAAK=\n-----END RSA PRIVATE KEY-----",
        "github": "ghp_" + long[:36],
        "slack": "xoxb-" + "1234567890-abcdefghij",
        "stripe": "sk_live_" + long[:24],
        "google": "AIza" + long[:35],
        "jwt": "eyJ" + long[:12] + ".eyJ" + long[:20] + "." + long[:30],
    }
    rows = [(i, f"é before {x} after", None, None, 1) for i, x in enumerate(real.values())]
    rows += [(100, " | ".join(real.values()), None, None, 1)]
    alike = ["ghp_short", "xoxz-" + "Z" * 30, "sk_test_" + long, "AIza" + long[:30], "eyJ" + long[:12] + "." + long, "-----BEGIN PUBLIC KEY-----"]
    rows += [(200 + i, f"a {x} b", None, None, 1) for i, x in enumerate(alike)]
    found = dict(got(secrets.digests(frame(spark, rows)), "doc_id", "spans"))
    for i, (kind, x) in enumerate(real.items()):
        assert found[i] == f"{kind}:9:{9 + len(x)}"
    at, want = 0, []
    for kind, x in real.items():
        want.append(f"{kind}:{at}:{at + len(x)}")
        at += len(x) + 3
    assert found[100] == ",".join(want) and all(found[200 + i] == "" for i in range(len(alike)))


def test_redaction(spark):
    rows = [(1, "my password = hunter2hunter2, and more", "en", "s", 5), (2, None, None, None, None), (3, "clean", "en", "s", 5)]
    out = secrets.redact(frame(spark, rows, clashing=True))
    assert out.columns == frame(spark, rows, clashing=True).columns
    assert got(out, "doc_id", "text") == [(1, "my [ASSIGN], and more"), (2, None), (3, "clean")]
    assert secrets.redact_text("abcdefgh", [("x", 1, 4), ("y", 3, 6), ("z", 6, 7)]) == "a[X][Z]h"
