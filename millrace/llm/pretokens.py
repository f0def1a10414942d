"""Pre-tokens: the pieces of a text that byte-level BPE encodes one by one.

PATTERN is the fixed value that the vocabularies come with. Texts without unusual characters take an equal pattern with
explicit Latin classes, which Python's own matcher runs faster; others take one with Unicode properties. White space is
spelt out in both, since Python counts four more control characters as space."""

from __future__ import annotations

import re
from collections.abc import Callable

import regex

#: Unicode white space as the vocabularies' pattern has it; Latin letters and numbers up to U+024F.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LETTER, NUMBER = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", r"0-9\xb2\xb3\xb9\xbc-\xbe"


def _pattern(letter: str, number: str) -> str:
    """PATTERN with its classes spelt out; the alternatives that most pieces take come first, which no piece can tell."""
    return rf" ?[{letter}]++| ?[{number}]++|'(?:[stmd]|re|ve|ll)| ?[^{SPACE}{letter}{number}]++|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]++"


_latin: Callable[[str], list[str]] = re.compile(_pattern(LETTER, NUMBER)).findall
_any: Callable[[str], list[str]] = regex.compile(_pattern(r"\p{L}", r"\p{N}"), regex.V0).findall
_usual = re.compile(r"[\x00-\u024f\u2010-\u2027]*").fullmatch


def split(text: str) -> list[str]:
    """The pieces of a text in order; joined they are the text."""
    return _latin(text) if _usual(text) else _any(text)
