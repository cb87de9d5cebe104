"""The ids that the tokenizers library gives for a BPE file in JSON, from a table of ranks where that gives the same.

A file whose merged tokens are numbered in the order of their merges is as well a table of byte strings by rank, which
``tiktoken`` applies several times faster. Word ends become blanks: each piece of a text is set off by one, and the
table has the last symbol of a piece with its blank. Texts with an added token, or with letters of which libraries may
think differently, go to the library itself, and so does every text of a file of another kind.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache

from corvex.llm.bpe import byte_letters

#: Characters of a text that are encoded at a time, about; longer texts are cut at blanks where no token crosses.
CHUNK = 1 << 16
#: The splits that rank tables are made for, as the files state them (fixed values).
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
BYTE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class LibraryIds:
    #: Letters of which libraries may think differently, in either case, and controls that only some take for white space.
    _ODD = re.compile("[\x1c-\x1fɐ-\U0010ffff" + "".join(c for c in map(chr, range(0x250)) if max(c.lower()) > "ɏ") + "]")
    #: Not a letter below U+0250, after lower-casing, nor a blank.
    _OTHER = re.compile("[^a-z \xaa\xb5\xba\xdf-\xf6\xf8-ɏ]+")
    _CUT = re.compile(r"(?<=\S) (?=[A-Za-z])")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.narrow = self.library.get_vocab_size() <= 1 << 16
        self.added = [t["content"] for t in spec["added_tokens"]]
        self.end = spec["model"].get("end_of_word_suffix") or ""
        self.pieces = regex.compile(WORD_SPLIT).findall
        self.apart: dict[str, str] = {}
        self.ranks = self._ranks(spec)

    def _ranks(self, spec: dict):
        """The encoder by ranks, or None for a file that isn't such a table."""
        import tiktoken

        model, vocab = spec["model"], spec["model"]["vocab"]
        if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
            return None
        merged = [vocab.get(a + b, -1) for a, b in model["merges"]]
        single = set(vocab.values()) - set(merged) - {t["id"] for t in spec["added_tokens"]}
        if any(a >= b for a, b in zip([max(single), *merged], merged, strict=False)):
            return None
        letters = {x: b for b, x in enumerate(byte_letters())}
        if self.end:
            steps = spec["normalizer"].get("normalizers", []), spec["pre_tokenizer"].get("pretokenizers", [])
            if [s["type"] for s in steps[0]] != ["NFC", "Replace", "Lowercase"] or [s["type"] for s in steps[1]] != ["Split", "ByteLevel"] or steps[1][0]["pattern"] != {"Regex": WORD_SPLIT}:
                return None
        elif spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"] or not spec["pre_tokenizer"]["use_regex"]:
            return None
        table: dict[bytes, int] = {}
        added = {t["content"] for t in spec["added_tokens"]}
        for token, i in vocab.items():
            if token in added:
                continue
            last = bool(self.end) and token.endswith(self.end)
            key = bytes(letters[c] for c in (token[: -len(self.end)] if last else token)) + b" " * last
            if key in table:
                return None
            table[key] = i
        if self.end:
            if any(bytes([b, 32]) not in table for b in range(256) if b != 32):
                return None
            table.setdefault(b" ", 1 << 30)  # never left alone: every last byte has a token with its blank
        return tiktoken.Encoding("ranks", pat_str="[^ ]+ " if self.end else BYTE_SPLIT, mergeable_ranks=table, special_tokens={}).encode_ordinary

    def _set_off(self, found: re.Match) -> str:
        run = found[0]
        out = self.apart.get(run)
        if out is None:
            out = " " + "".join([x + " " for x in self.pieces(run)])
            if len(run) < 16 and len(self.apart) < 1 << 16:
                self.apart[run] = out
        return out

    def _ready(self, text: str) -> str:
        """text as the rank table wants it."""
        if not self.end:
            return text
        low = text.lower()
        if "'" in low:  # what belongs to an apostrophe depends on the letters after it
            return " ".join(self.pieces(low)) + " "
        return self._OTHER.sub(self._set_off, low) + " "

    def _chunks(self, text: str) -> list[str]:
        out, at = [], 0
        while at + CHUNK < len(text) and (cut := self._CUT.search(text, at + CHUNK)):
            out.append(text[at : cut.start()])
            at = cut.start()
        return [*out, text[at:]]

    def encode_many(self, texts: list[str], narrow: bool = False) -> list[bytes]:
        """The ids of each text, as unsigned integers of 32 bits, or 16 if narrow."""
        kind = "H" if narrow else "I"
        out: list[bytes | None] = []
        for t in texts:
            if self.ranks is None or self._ODD.search(t) or any(a in t for a in self.added):
                out.append(None)
            elif len(t) <= CHUNK:
                out.append(array(kind, self.ranks(self._ready(t))).tobytes())
            else:
                out.append(b"".join([array(kind, self.ranks(self._ready(c))).tobytes() for c in self._chunks(t)]))
        left = [i for i, x in enumerate(out) if x is None]
        for at in range(0, len(left), 64):
            some = left[at : at + 64]
            for i, e in zip(some, self.library.encode_batch([texts[i] for i in some], add_special_tokens=False), strict=True):
                out[i] = array(kind, e.ids).tobytes()
        return out


@lru_cache(maxsize=2)
def model(path: str) -> LibraryIds:
    return LibraryIds(path)
