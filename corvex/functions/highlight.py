"""Marks the terms of a query in text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def pattern(terms: list[str]) -> str:
    """A regular expression of whole words, the longest first; a * or ? in a term stands for letters and digits."""
    words = [re.escape(t).replace(r"\*", "[A-Za-z0-9]*").replace(r"\?", "[A-Za-z0-9]") for t in sorted(set(terms), key=lambda t: (-len(t), t))]
    return rf"(?i)\b({'|'.join(words)})\b" if words else r"(?!)"


def highlight(text: Column, terms: list[str], before: str = "<b><u>", after: str = "</u></b>") -> Column:
    plain = lambda x: x.replace("\\", "\\\\").replace("$", "\\$")
    return F.regexp_replace(text, pattern(terms), f"{plain(before)}$1{plain(after)}")


def count(text: Column, terms: list[str]) -> Column:
    return F.regexp_count(text, F.lit(pattern(terms)))


def snippets(text: Column, terms: list[str], width: int = 40) -> Column:
    """The places of the terms with up to ``width`` characters around each."""
    inner = pattern(terms).removeprefix("(?i)")
    return F.regexp_extract_all(text, F.lit(rf"(?is)(.{{0,{width}}}{inner}.{{0,{width}}})"), F.lit(1))
