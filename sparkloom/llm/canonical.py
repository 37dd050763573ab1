"""Canonical forms of messages, shared by the operators on copies and overlaps."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable
from functools import lru_cache

#: What stands between labelled fields, in the order tried.
_SEPARATORS = (re.compile(r"[\r\n;|  \x85]+"), re.compile(r"[\r\n  \x85]+"), re.compile(r"\|"), re.compile(r";"))
_LABEL = re.compile(r"[\W_]*[^\W\d_][^:]{0,48}:(?!//)")
_WORDS = re.compile(r"[^\W_]+")


def _character_class(codes: Iterable[int]) -> str:
    """Code points in rising order as ranges of a character class."""
    out: list[list[int]] = []
    for c in codes:
        if out and c == out[-1][1] + 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in out)


def _unseen(code: int) -> bool:
    """Whether a mark only chooses how others are shown: variation selectors and the grapheme joiner."""
    return 0xFE00 <= code <= 0xFE0F or 0xE0100 <= code <= 0xE01EF or code in (0x34F, 0x180B, 0x180C, 0x180D, 0x180F)


#: Marks that tell letters apart, as vowel signs do; they belong to the letter before them.
_MARKS = _character_class(c for c in range(0x300, 0x20000) if unicodedata.category(chr(c)) in ("Mn", "Mc") and not _unseen(c))
_HAS_MARK = re.compile(f"[{_MARKS}]")
_MARKED_WORDS = re.compile(rf"(?:[^\W_]+[{_MARKS}]*)+")
_INVISIBLE = re.compile("[" + _character_class(c for c in range(0x80, 0xE0200) if unicodedata.category(chr(c)) == "Cf" or _unseen(c)) + "]+")
_ASCII_WORDS = re.compile(r"[a-z0-9]+")
#: Bytes of ASCII text that are neither letters nor digits.
_ASCII_DROP = bytes(c for c in range(128) if not chr(c).isalnum())


@lru_cache(4096)
def role_of(role: str | None) -> str:
    """A role without case, outer white space and invisible characters; null gives ''."""
    return "".join(c for c in role if not c.isspace() and unicodedata.category(c) != "Cf").lower() if role else ""


def fold(text: str) -> str:
    """Text without letter case and with one code point per composed letter."""
    return text.lower() if text.isascii() else unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())


def letters(folded: str) -> str:
    """The letters and digits of folded text with their marks, in order."""
    if folded.isascii():
        return folded.encode().translate(None, _ASCII_DROP).decode()
    return "".join(_MARKED_WORDS.findall(_INVISIBLE.sub("", folded)) if _HAS_MARK.search(folded) else _WORDS.findall(folded))


def words(folded: str) -> list[str]:
    """Runs of letters and digits of folded text with their marks, in order. Invisible characters between letters part nothing."""
    if folded.isascii():
        return _ASCII_WORDS.findall(folded)
    return (_MARKED_WORDS if _HAS_MARK.search(folded) else _WORDS).findall(_INVISIBLE.sub("", folded))


def fields(folded: str) -> list[str] | None:
    """The labelled fields a message consists of, or None if it doesn't consist of at least two."""
    if folded.count(":") < 2:
        return None
    for separator in _SEPARATORS:
        parts = [p for p in separator.split(folded) if p.strip()]
        if len(parts) > 1 and all(_LABEL.match(p) for p in parts):
            return parts
    return None


def canonical_letters(content: str | None) -> tuple[str, str]:
    """(letters and digits in order, the same with labelled fields in sorted order) of a content; null gives ('', '')."""
    if not content:
        return "", ""
    folded = fold(content)
    plain = letters(folded)
    parts = fields(folded)
    return (plain, "\x1f".join(sorted(map(letters, parts)))) if parts else (plain, plain)


def canonical_forms(content: str | None) -> tuple[list[str], str, str]:
    """(words of a content with labelled fields in sorted order, and its two forms of :func:`canonical_letters`)."""
    if not content:
        return [], "", ""
    folded = fold(content)
    own = words(folded)
    plain = "".join(own)
    parts = fields(folded)
    if not parts:
        return own, plain, plain
    by_part = sorted(map(words, parts))
    return [w for p in by_part for w in p], plain, "\x1f".join(sorted(map("".join, by_part)))


def canonical_words(content: str | None) -> list[str]:
    """Words of a content, labelled fields in sorted order; null gives []."""
    return canonical_forms(content)[0]
