"""The analysis of text into terms, as Column functions, and the same for the words of a query.

In order: tags give way to a blank, HTML entities are decoded, accents and case are folded, runs of other characters
than a-z and 0-9 separate terms, terms are cut to their greatest length, and stop words go. Positions count the terms
that are left, from 1. All of it is built in: nothing leaves the JVM.
"""

from __future__ import annotations

import re
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvex.config import IndexConfig
from corvex.functions.stopwords import stop_words

TAG = r"<[^\n]*?>"
ENTITY = r"^&(#[xX][0-9A-Fa-f]+|#[0-9]+|\w+);?"

_LATIN_1 = {"àáâãäåÀÁÂÃÄÅ": "a", "çÇ": "c", "èéêëÈÉÊË": "e", "ìíîïÌÍÎÏ": "i", "ñÑ": "n", "òóôõöÒÓÔÕÖ": "o", "ùúûüÙÚÛÜ": "u", "ýÝÿ": "y"}
_LATIN_2 = {"áâăäąÁÂĂÄĄ": "a", "ćčçĆČÇ": "c", "ďđĎĐ": "d", "éęëěÉĘËĚ": "e", "íîÍÎ": "i", "ĺľłĹĽŁ": "l", "ńňŃŇ": "n", "óôőöÓÔŐÖ": "o", "ŕřŔŘ": "r", "śšşŚŠŞ": "s", "ťţŤŢ": "t", "ůúűüŮÚŰÜ": "u", "ýÝ": "y", "źžżŹŽŻ": "z"}
_WIDE = (("ß", "ss"), ("æ", "ae"), ("Æ", "ae"), ("œ", "oe"), ("Œ", "oe"))


def accents(charset: str) -> tuple[str, str]:
    """The letters that lose an accent in texts of charset, and what each becomes."""
    table = _LATIN_2 if charset.lower().replace("_", "-") == "iso-8859-2" else _LATIN_1
    return "".join(table), "".join(to * len(letters) for letters, to in table.items())


def fold(text: Column, charset: str = "iso-8859-1") -> Column:
    """text without accents, in lower case."""
    out = F.translate(text, *accents(charset))
    for letter, both in _WIDE:
        out = F.replace(out, F.lit(letter), F.lit(both))
    return F.lower(out)


def fold_word(word: str, charset: str = "iso-8859-1") -> str:
    """What fold makes of a word of a query."""
    word = word.translate(str.maketrans(*accents(charset)))
    for letter, both in _WIDE:
        word = word.replace(letter, both)
    return word.lower()


def decode_entities(text: Column, strict: bool = False) -> Column:
    """text with HTML entities decoded, each once; names are those of HTML 4, and unknown ones stay.

    strict: so do those without their semicolon.
    """
    entity = ENTITY.removesuffix("?") if strict else ENTITY
    names = F.create_map(*[F.lit(x) for name, code in name2codepoint.items() for x in (name, chr(code))])

    def piece(x: Column) -> Column:
        name = F.regexp_extract(x, entity, 1)
        whole = F.regexp_extract(x, entity, 0)
        number = F.when(F.lower(F.substring(name, 2, 1)) == "x", F.try_to_number(F.conv(F.substring(name, 3, 8), 16, 10), F.lit("9999999999"))).otherwise(F.try_to_number(F.substring(name, 2, 10), F.lit("9999999999"))).cast("long")
        valid = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
        letter = F.when(F.startswith(name, F.lit("#")), F.when(valid, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))).otherwise(F.try_element_at(names, name))
        return F.when(letter.isNull() | (whole == ""), x).otherwise(F.concat(letter, F.substr(x, F.length(whole) + 1)))

    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(F.split(text, "(?=&)"), piece), "")).otherwise(text)


def clean(text: Column, config: IndexConfig) -> Column:
    """text without tags, entities, accents and upper case."""
    out = F.coalesce(text.cast("string"), F.lit(""))
    out = F.when(F.contains(out, F.lit("<")), F.regexp_replace(out, TAG, " ")).otherwise(out)
    if config.decode_html_entities:
        out = decode_entities(out, config.strict_entities)
    return fold(out, config.charset)


def terms(text: Column, config: IndexConfig) -> Column:
    """The array of a text's terms, in order."""
    stopped = sorted(stop_words(config.stoplist))
    out = F.regexp_extract_all(clean(text, config), F.lit(f"([a-z0-9]{{1,{config.max_word_length}}}+)[a-z0-9]*+"), F.lit(1))
    return F.filter(out, lambda t: ~t.isin(stopped)) if stopped else out


def query_terms(text: str, config: IndexConfig) -> tuple[list[str], list[str]]:
    """The terms of a phrase in a query, and the stop words that were left out."""
    stopped = stop_words(config.stoplist)
    found = [t[: config.max_word_length] for t in re.split("[^a-z0-9]+", fold_word(text, config.charset)) if t]
    return [t for t in found if t not in stopped], [t for t in found if t in stopped]
