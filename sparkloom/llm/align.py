"""Longest common subsequence and shingles of word sequences."""

from __future__ import annotations

from collections.abc import Hashable, Sequence


def lcs_length(a: Sequence[Hashable], b: Sequence[Hashable]) -> int:
    """Length of the longest sequence common to both, gaps allowed. One machine step a word of ``b`` for each 64 words or so of ``a``."""
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return 0
    head = 0
    while head < len(b) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < len(b) - head and a[len(a) - 1 - tail] == b[len(b) - 1 - tail]:
        tail += 1
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    if not b:
        return head + tail
    places: dict[Hashable, int] = {}
    bit = 1
    for x in a:
        places[x] = places.get(x, 0) | bit
        bit <<= 1
    mask = bit - 1
    row = mask
    for x in b:
        here = places.get(x)
        if here is not None:
            kept = row & here
            row = ((row + kept) | (row - kept)) & mask
    return head + tail + len(a) - row.bit_count()


def shingles(words: Sequence[str], n: int) -> list[tuple[str, ...]]:
    """Each run of n neighbouring words; the whole where it is shorter."""
    return [tuple(words[i : i + n]) for i in range(len(words) - n + 1)] if len(words) >= n else [tuple(words)] if words else []


def containment(inner: Sequence[str], outer: Sequence[str], n: int) -> float:
    """Share of the shingles of ``inner`` that stand in ``outer`` too; 0 for an empty ``inner``."""
    own = shingles(inner, n)
    known = set(shingles(outer, n))
    return sum(s in known for s in own) / len(own) if own else 0.0
