"""Cutting text into the pre-tokens of byte-level BPE vocabularies."""

from __future__ import annotations

import re
from functools import lru_cache

import regex

#: Fixed value: the split pattern of these vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_WHOLE = regex.compile(PATTERN)
# The same pattern over code points below U+0250 in the faster engine, with its classes spelt out.
_LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
_NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
_SPACES = "\t-\r \x85\xa0"
_NARROW = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^{_SPACES}{_LETTERS}{_NUMBERS}]+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+")
_WIDE = re.compile("[^\0-ɏ]")

LONGEST = 64  # longer pre-tokens are answered each time


def split(text: str) -> list[str]:
    return _WHOLE.findall(text) if _WIDE.search(text) else _NARROW.findall(text)


class Cache(dict):
    """Answers for pre-tokens in two generations, so memory is bounded and frequent ones stay."""

    def __init__(self, answer, size: int):
        super().__init__()
        self.answer, self.size, self.old = answer, size, {}

    def __missing__(self, piece: str):
        value = self.old.get(piece)
        if value is None:
            value = self.answer(piece)
        if len(piece) > LONGEST:
            return value
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[piece] = value
        return value


@lru_cache(2)
def byte_alphabet() -> dict[str, int]:
    """The printable characters that stand for bytes in vocabulary files of this kind."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}
