"""Tokenising with the public vocabularies: exact, with caches over units of text.

A unit is a stretch of text that no token crosses, so the ids of a text are the ids of its units in
order. For the word vocabulary units are what white space separates. For the byte vocabulary a unit
is white space with a run of letters, or with all up to the next white space, after it; texts with
rare white space or numerals that aren't decimal digits are one unit each, as the rules of
runs differ there. A unit not met before is encoded by the library: a word of Latin letters, which is
one pre-token, by its model alone, anything else by all of it.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache
from unicodedata import is_normalized

from bytesift.llm.common import worker_cache

BYTE_UNIT = re.compile(r"[ \t\r\n]*[^\W\d_]+|[ \t\r\n]*[^ \t\r\n]+|[ \t\r\n]+")
WORD_UNIT = re.compile(r"[^\W\d_]+|[^ \t\r\n]+")
SPACED = re.compile(r"[^ \t\r\n]+")
#: Python takes these for white space, the library doesn't.
SEPARATORS = "\x1c\x1d\x1e\x1f"
#: Longer units are encoded each time, so a cache's size is bounded.
LONGEST_CACHED = 48
CACHED = 700_000


@lru_cache(maxsize=1)
def rare() -> frozenset[str]:
    """Other white space (or what a library may take for it), and numerals that aren't decimal digits."""
    numerals = {c for c in map(chr, range(0x110000)) if c.isalnum() and not c.isalpha() and not c.isdecimal()}
    spaces = {c for c in map(chr, range(0x110000)) if c.isspace()} - set(" \t\r\n")
    return frozenset(numerals | spaces | set("\u180e\u200b\u2060\ufeff"))


def word_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=4)
def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def byte_units(text: str) -> list[str]:
    if any(c in text for c in SEPARATORS + "\x0b\x0c") or not text.isascii() and not rare().isdisjoint(set(text)):
        return [text]
    return BYTE_UNIT.findall(text)


def word_units(text: str) -> list[str]:
    return SPACED.findall(text) if any(c in text for c in SEPARATORS) else text.split()


def _parts(unit: str) -> list[str]:
    """Runs of letters and what is between them; a mark may join the letter before it in a unit not in form NFC, and U+0130's lower case ends in one."""
    return WORD_UNIT.findall(unit) if is_normalized("NFC", unit) and "\u0130" not in unit else [unit]


@lru_cache(maxsize=1)
def _byte_alphabet() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 characters stand for themselves, the other bytes for U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(256 + k) for k, b in enumerate(other)}


class Encoder:
    """Ids of units that weren't met before. ``words``: for the word vocabulary."""

    def __init__(self, path: str, words: bool):
        self.path, self.words = path, words
        self.other: dict[str, list[int]] = {}
        self.letters: dict[str, list[int] | None] = {}

    def part(self, unit: str) -> list[int] | None:
        """As ``latin_word``, remembered: parts of units with punctuation recur."""
        if unit not in self.letters:
            if len(self.letters) > 200_000:
                self.letters = {}
            self.letters[unit] = self.latin_word(unit)
        return self.letters[unit]

    def latin_word(self, unit: str) -> list[int] | None:
        """Ids of a word of Latin letters (with one space before it, for the byte vocabulary), else None."""
        word = unit if self.words or unit[:1] != " " else unit[1:]
        if not word.isalpha() or max(word) >= "\u0250" or "\u0130" in word:
            return None
        if self.words:
            unit = unit.lower()
        spelled = unit if self.words and unit.isascii() else unit.encode().decode("latin-1").translate(_byte_alphabet())
        return [t.id for t in load(self.path).model.tokenize(spelled)]

    def __call__(self, units: list[str]) -> list[list[int]]:
        out, rest, new = [], {}, set()
        for k, u in enumerate(units):
            out.append(ids := self.latin_word(u))
            if ids is None:
                rest[k] = [(p, self.part(p)) for p in _parts(u)] if self.words else [(u, None)]
                new.update(p for p, found in rest[k] if found is None and p not in self.other)
        if new:
            new = list(new)
            encoded = load(self.path).encode_batch_fast(new, add_special_tokens=False)
            self.other.update((p, e.ids) for p, e in zip(new, encoded, strict=True))
        for k, parts in rest.items():
            out[k] = [i for p, found in parts for i in (self.other[p] if found is None else found)]
        if len(self.other) > 50_000:
            self.other = {}
        return out


class UnitCache:
    """Of one worker: unit -> what ``keep`` makes of its ids, beginning with the fixed table ``first``."""

    def __init__(self, path: str, keep, words: bool, first: dict | None = None, cached: int = CACHED):
        self.encoder, self.keep, self.first, self.cached = Encoder(path, words), keep, first or {}, cached
        self.found = dict(self.first)

    def __call__(self, lists: list[list[str]]) -> list[list]:
        """For each list of units, the kept values in order."""
        units = set().union(*lists) if lists else set()
        if len(self.found) > self.cached:  # what this batch needs stays, usual units above all
            self.found = self.first | {u: self.found[u] for u in units.intersection(self.found)}
        found, long = self.found, []
        new = list(units.difference(found))
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            found.update(zip(part, map(self.keep, self.encoder(part)), strict=True))
            long += [u for u in part if len(u) > LONGEST_CACHED]
        out = [list(map(found.__getitem__, units)) for units in lists]
        for u in long:
            del found[u]
        return out


def ids_as_bytes(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


def id_cache(path: str, cached: int = CACHED) -> UnitCache:
    return worker_cache(("ids", path, cached), lambda: UnitCache(path, ids_as_bytes, True, cached=cached))


def word_ids(path: str, texts: list[str], cached: int = CACHED) -> list[bytes]:
    """Ids of each text as little-endian unsigned 32-bit integers."""
    return [b"".join(parts) for parts in id_cache(path, cached)([word_units(t) for t in texts])]
