"""Words too common to search for, by language."""

from __future__ import annotations

# The lists that results must agree with, in alphabetical order. The Czech words have no diacritics.
ENGLISH = """
a about after all also an and any are as at be because been but by can could for from had has have he her his i if in
into is it its last like many me miss more most much mr mrs ms my no not of on one only or other out over s says she
should so some such than that the their them there these they this those thus to too up us was we were when which who
whose will with would you
"""
CZECH = """
a aniz ano at az bude budu by bych bychom byl byla bylo bysme co do i ja je jeho jeji jejich jejim jemu ji jim jsem jsi
jsou k kam komu ma maji mam mel mela meli me mi mit moci mohl moje mu musel muset nac nam nas nase nasemu nasich nasim ne
nem nich o od on ona ono presto pro proc proto protoze s se snad te tebe tem ti ty u v vam vas vase vasemu vasich vasim
vedel vedeli vedet vi vim vis z za ze
"""

STOP_WORDS: dict[str, frozenset[str]] = {"en": frozenset(ENGLISH.split()), "cz": frozenset(CZECH.split())}


def stop_words(names: tuple[str, ...]) -> frozenset[str]:
    """The union of the named lists."""
    out: frozenset[str] = frozenset()
    for name in names:
        if name not in STOP_WORDS:
            raise ValueError(f"no stop list {name}; there are {sorted(STOP_WORDS)}")
        out |= STOP_WORDS[name]
    return out
