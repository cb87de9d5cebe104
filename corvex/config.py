"""Options of an index, and the exceptions of the engine."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace

#: Terms whose inverse document frequency is below this are not scored.
IDF_LEAST = -1.8
K1, B, K3 = 1.2, 0.75, 7.0
SCHEMA_VERSION = 1

MESSAGES = {
    "empty_query": "The query is empty.",
    "quote_count": "Quotes must come in pairs.",
    "parentheses": "Parentheses must come in pairs.",
    "no_results": "No document matches the query.",
    "no_results_stop": "No document matches the query. These common words were not included in the search:",
    "wildcard_length": "A wildcard must follow at least {n} letter(s) or digit(s).",
    "wildcard_expansion": "The wildcard stands for too many terms; use more letters around it.",
}


class SearchError(Exception):
    """The base of all; ``detail`` may say more."""

    def __init__(self, message: str, detail: str | None = None):
        super().__init__(message)
        self.detail = detail


class GeneralError(SearchError):
    """A wrong call: an unknown field, mask key or option."""


class QueryError(SearchError):
    """A query that can't be answered, with a message for the one who asked it."""


@dataclass(frozen=True)
class IndexConfig:
    collection: str
    doc_fields: tuple[str, ...]
    key: str = "doc_key"
    charset: str = "iso-8859-1"
    stoplist: tuple[str, ...] = ()
    proximity_index: bool = True
    max_word_length: int = 20
    min_wildcard_length: int = 1
    max_wildcard_term_expansion: int = 30
    phrase_threshold: int | None = None
    max_batches: int = 16
    result_threshold: int = 5000
    decode_html_entities: bool = True
    strict_entities: bool = False
    scoring_method: str = "okapi"
    update_commit_interval: int = 20_000
    doc_key_type: str = "string"
    doc_key_length: int = 200
    strict_terms: bool = True
    doc_table: str | None = None
    errors: dict = field(default_factory=dict, hash=False)

    def __post_init__(self):
        if not self.collection or len(self.collection) > 100:
            raise GeneralError("collection must be a name of 1 to 100 characters")
        if not self.doc_fields:
            raise GeneralError("doc_fields must name at least one field")
        if unknown := set(self.errors) - set(MESSAGES):
            raise GeneralError(f"unknown messages: {', '.join(sorted(unknown))}")
        object.__setattr__(self, "doc_fields", tuple(self.doc_fields))
        object.__setattr__(self, "stoplist", tuple([self.stoplist] if isinstance(self.stoplist, str) else self.stoplist))

    def message(self, name: str, **values) -> str:
        return self.errors.get(name, MESSAGES[name]).format(**values)

    def field_no(self, name: str) -> int:
        return self.doc_fields.index(name)

    def with_(self, **changes) -> IndexConfig:
        return replace(self, **changes)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, raw: str) -> IndexConfig:
        return cls(**upgraded(json.loads(raw)))


#: Names of options in older metadata.
RENAMED = {"document_fields": "doc_fields", "document_table": "doc_table", "document_id_field": "key", "doc_id_field": "key", "max_wildcard_expansion": "max_wildcard_term_expansion"}
LANGUAGES = {"cz": "iso-8859-2", "en": "iso-8859-1"}


def upgraded(found: dict) -> dict:
    """Metadata of any older version in today's names: renamed options, and a language or Czech flag as a charset."""
    out = {RENAMED.get(k, k): v for k, v in found.items()}
    language = out.pop("language", None) or ("cz" if out.pop("czech_language", False) else None)
    out.pop("czech_language", None)
    if language and "charset" not in out:
        out["charset"] = LANGUAGES.get(language, "iso-8859-1")
    known = set(IndexConfig.__dataclass_fields__)
    return {k: v for k, v in out.items() if k in known}
