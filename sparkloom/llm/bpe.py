"""Byte-level byte-pair encoding of many distinct pieces at once, as numpy matrices.

Pieces of equal length lie in one matrix of symbols. Each round every row joins its
leftmost pair of least rank; the matrix is then compacted by one column, as each row
that is still at work has lost exactly one symbol. Rows without a pair that has a rank
are done and leave the matrix. Ranks are found by hashing the pair into an open table.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterable

import numpy as np
import regex

#: How byte-level tokenizers split text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters with the White_Space property, for a character class.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_UNICODE = regex.compile(PATTERN.replace(r"[^\s\p{L}\p{N}]", rf"[^{_SPACE}\p{{L}}\p{{N}}]").replace(r"\s+(?!\S)|\s+", rf"[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"))
_ASCII = re.compile(r"'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)
#: Rows of a matrix, and the length beyond which a piece is merged by itself, with a heap: in a matrix it would take rounds as many as bytes. The ids are the same.
ROWS, LONG = 16384, 256
_NONE = np.int32(2**31 - 1)


def split(text: str) -> list[str]:
    """The pieces of a text; joined they give the text. A lone surrogate counts as the replacement character when encoded."""
    return _ASCII.findall(text) if text.isascii() else _UNICODE.findall(text)


def _byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files of this kind."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """Ranked merges of a byte-level tokenizer file (``tokenizers`` JSON, as bytes), with a hashed pair table.

    Raises ``ValueError`` for another model, a normalizer, or another way of splitting.
    """

    def __init__(self, data: bytes) -> None:
        whole = json.loads(data)
        model, splitter = whole["model"], whole.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or whole.get("normalizer") or splitter.get("type") != "ByteLevel" or splitter.get("add_prefix_space") or not splitter.get("use_regex", True) or model.get("ignore_merges"):
            raise ValueError("not a byte-level BPE without normalizer")
        vocab: dict[str, int] = model["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self._vocab, self._bytes = vocab, None
        self.byte_ids = np.full(256, -1, np.int32)
        for symbol, byte in _byte_symbols().items():
            self.byte_ids[byte] = vocab[symbol]
        left = np.array([vocab[a] for a, _ in pairs], np.uint64)
        right = np.array([vocab[b] for _, b in pairs], np.uint64)
        self._fill((left << np.uint64(32)) | right, np.arange(len(pairs), dtype=np.int32), np.array([vocab[a + b] for a, b in pairs], np.int32))

    def _fill(self, keys: np.ndarray, ranks: np.ndarray, ids: np.ndarray) -> None:
        bits = max(4, int(len(keys) * 4 - 1).bit_length())
        self._shift, self._mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self._keys = np.full(1 << bits, 2**64 - 1, np.uint64)
        self._ranks = np.full(1 << bits, _NONE, np.int32)
        self.merged = ids
        todo, at = np.arange(len(keys)), self._slot(keys)
        self.probes = 0
        while len(todo):
            self.probes += 1
            free = self._keys[at] == np.uint64(2**64 - 1)
            _, first = np.unique(at, return_index=True)
            won = np.zeros(len(todo), bool)
            won[first] = True
            won &= free
            self._keys[at[won]], self._ranks[at[won]] = keys[todo[won]], ranks[todo[won]]
            todo, at = todo[~won], (at[~won] + 1) & self._mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self._shift).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair; the greatest int32 where it has none."""
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        at = self._slot(keys)
        out = np.where(self._keys[at] == keys, self._ranks[at], _NONE)
        open_ = (self._keys[at] != keys) & (self._keys[at] != np.uint64(2**64 - 1))
        for _ in range(self.probes - 1):
            if not open_.any():
                break
            at = (at + 1) & self._mask
            hit = open_ & (self._keys[at] == keys)
            out[hit] = self._ranks[at[hit]]
            open_ &= (self._keys[at] != keys) & (self._keys[at] != np.uint64(2**64 - 1))
        return out

    def encode(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of each piece, in order; an empty piece gives none."""
        out: list[np.ndarray] = [np.empty(0, np.int32)] * len(pieces)
        by_length: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            by_length.setdefault(len(p), []).append(i)
        for length, rows in by_length.items():
            if length > LONG:
                for i in rows:
                    out[i] = self._encode_long(self.byte_ids[np.frombuffer(pieces[i], np.uint8)])
            elif length:
                step = max(1, ROWS * 16 // length)
                for a in range(0, len(rows), step):
                    part = rows[a : a + step]
                    flat = np.frombuffer(b"".join([pieces[i] for i in part]), np.uint8)
                    self._encode_matrix(self.byte_ids[flat].reshape(len(part), length), np.array(part), out)
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that form no character become the replacement character."""
        if self._bytes is None:
            of = _byte_symbols()
            self._bytes = {i: bytes(of[c] for c in symbol) for symbol, i in self._vocab.items() if all(c in of for c in symbol)}
        return b"".join([self._bytes[i] for i in ids]).decode("utf-8", "replace")

    def _encode_matrix(self, ids: np.ndarray, rows: np.ndarray, out: list[np.ndarray]) -> None:
        ranks = self.rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), -1)
        while ids.shape[1] > 1:
            at = ranks.argmin(axis=1)
            every = np.arange(len(ids))
            least = ranks[every, at]
            busy = least != _NONE
            if not busy.all():
                for i, row in zip(rows[~busy].tolist(), ids[~busy]):
                    out[i] = row
                ids, ranks, rows, at, least = ids[busy], ranks[busy], rows[busy], at[busy], least[busy]
                if not len(ids):
                    return
                every = np.arange(len(ids))
            ids[every, at] = self.merged[least]
            keep = np.ones(ids.shape, bool)
            keep[every, at + 1] = False
            ids = ids[keep].reshape(len(ids), -1)
            keep = np.ones(ranks.shape, bool)
            keep[every, at] = False
            ranks = ranks[keep].reshape(len(ids), -1)
            width = ids.shape[1]
            has = at + 1 < width
            if has.any():
                r, c = every[has], at[has]
                ranks[r, c] = self.rank(ids[r, c], ids[r, c + 1])
            has = at > 0
            if has.any():
                r, c = every[has], at[has]
                ranks[r, c - 1] = self.rank(ids[r, c - 1], ids[r, c])
        for i, row in zip(rows.tolist(), ids):
            out[i] = row

    def _encode_long(self, ids: np.ndarray) -> np.ndarray:
        """One long piece: pairs wait in a heap by rank and place; a joined pair adds those with its neighbours. Places are linked, so a join takes a few steps, whatever the length."""
        n = len(ids)
        ranks = self.rank(ids[:-1], ids[1:])
        symbols, before, after = ids.tolist(), list(range(-1, n - 1)), list(range(1, n + 1))
        places = np.flatnonzero(ranks != _NONE)
        heap = list(zip(ranks[places].tolist(), places.tolist(), ids[places].tolist(), ids[places + 1].tolist()))
        heapq.heapify(heap)
        known: dict[tuple[int, int], int] = {}
        none, merged = int(_NONE), self.merged

        def push(at: int, other: int) -> None:
            pair = symbols[at], symbols[other]
            rank = known.get(pair)
            if rank is None:
                rank = known[pair] = int(self.rank(np.array([pair[0]], np.int32), np.array([pair[1]], np.int32))[0])
            if rank != none:
                heapq.heappush(heap, (rank, at, *pair))

        while heap:
            rank, at, left, right = heapq.heappop(heap)
            other = after[at]
            if symbols[at] != left or other >= n or symbols[other] != right:  # one of them has been joined since
                continue
            symbols[at], symbols[other] = int(merged[rank]), -1
            following = after[at] = after[other]
            if following < n:
                before[following] = at
                push(at, following)
            if before[at] >= 0:
                push(before[at], at)
        return np.array([s for s in symbols if s >= 0], np.int32)


class Pieces:
    """Ids of distinct pieces, kept between batches.

    ``limit`` bounds the memory: beyond so many pieces the store starts anew, which
    changes no result.
    """

    def __init__(self, data: bytes, limit: int = 400_000) -> None:
        self.merges, self.limit = Merges(data), limit
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self._chunks: list[np.ndarray] = []
        self._flat, self._starts = np.empty(0, np.int32), np.zeros(1, np.int64)

    def learn(self, pieces: Iterable[str]) -> None:
        """Encode the pieces not known yet."""
        new = [p for p in dict.fromkeys(pieces) if p not in self.index]
        if len(self.index) + len(new) > self.limit and self.index:
            raise OverflowError
        if not new:
            return
        ids = self.merges.encode([p.encode("utf-8", "replace") for p in new])
        self.index.update(zip(new, range(len(self.index), len(self.index) + len(new))))
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        self._flat = np.concatenate([self._flat, *ids])
        self._starts = np.concatenate([self._starts, self._starts[-1] + np.cumsum(lengths)])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each text); null and empty texts have none."""
        split_texts = [split(t) if t else [] for t in texts]
        try:
            self.learn(p for ps in split_texts for p in ps)
        except OverflowError:
            self._clear()
            self.learn(p for ps in split_texts for p in ps)
        n_pieces = np.fromiter(map(len, split_texts), np.int64, len(texts))
        get = self.index.__getitem__
        where = np.fromiter((get(p) for ps in split_texts for p in ps), np.int64, int(n_pieces.sum()))
        lengths = self._starts[where + 1] - self._starts[where]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        at = np.arange(total, dtype=np.int64) + np.repeat(self._starts[where] - (ends - lengths), lengths)
        ends = np.concatenate(([0], ends))
        cuts = np.concatenate(([0], np.cumsum(n_pieces)))
        return self._flat[at], ends[cuts[1:]] - ends[cuts[:-1]]
