"""Words of many texts at once, as arrays: where they lie, in which text and piece, and two 64-bit hashes of each."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np

#: classes of bytes: part of a word, between words, between pieces (the line feed that joins texts must be one of the last)
WORD, SPACE, BREAK = 0, 1, 2
#: bytes of text that are worked on together
CHUNK = 1 << 20
LOW_BITS = 16
_random = np.random.default_rng(12)
#: random values of bytes, and the odd bases of the polynomials, of the two hashes
VALUES = _random.integers(0, 1 << 64, (2, 256), np.uint64)
BASES = [int(x) | 1 for x in _random.integers(0, 1 << 64, 2, np.uint64)]


def byte_classes(spaces: bytes, breaks: bytes) -> np.ndarray:
    """Class of each byte."""
    out = np.zeros(256, np.uint8)
    out[list(spaces)] = SPACE
    out[list(breaks)] = BREAK
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalising mix."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@lru_cache(64)
def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64."""
    out = np.ones(n, np.uint64)
    np.multiply.accumulate(np.full(n - 1, base, np.uint64), out=out[1:])
    return out


def power_at(base: int, at: np.ndarray | int, n: int) -> np.ndarray:
    """base**at for places below n, from two short tables."""
    low = powers(base, 1 << LOW_BITS)
    high = powers(pow(base, 1 << LOW_BITS, 1 << 64), 1 << max(4, (n >> LOW_BITS).bit_length()))
    return low[at & ((1 << LOW_BITS) - 1)] * high[at >> LOW_BITS]


class Words:
    """The words of texts, joined by line feeds in `data`: starts and ends in it, number of the text, number of the piece."""

    def __init__(self, texts: Sequence[bytes], classes: np.ndarray) -> None:
        self.data = b"\n".join(texts)
        self.bytes = np.frombuffer(self.data, np.uint8)
        kind = classes[self.bytes]
        inside = np.zeros(len(kind) + 2, np.int8)
        inside[1:-1] = kind == WORD
        edge = np.diff(inside)
        self.starts, self.ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.text_starts = np.cumsum(lengths + 1) - lengths - 1
        self.text = np.searchsorted(self.text_starts, self.starts, side="right") - 1
        self.piece = np.cumsum(kind == BREAK)[self.starts] if len(self.starts) else self.starts

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self, which: int, *, lower: bool = False) -> np.ndarray:
        """Hash of each word's bytes, or of those with A-Z in lower case."""
        n, base = len(self.bytes), BASES[which]
        total = np.zeros(n + 1, np.uint64)
        own = np.frombuffer(self.data.lower(), np.uint8) if lower else self.bytes
        np.cumsum(VALUES[which][own] * power_at(base, np.arange(n), n), out=total[1:])
        back = power_at(pow(base, -1, 1 << 64), self.starts, n)
        return mixed((total[self.ends] - total[self.starts]) * back + (self.ends - self.starts).astype(np.uint64))

    def phrase(self, first: int, size: int) -> str:
        """Words joined by one space."""
        return b" ".join(self.data[a:b] for a, b in zip(self.starts[first : first + size].tolist(), self.ends[first : first + size].tolist(), strict=True)).decode()


def windows(text: bytes, breaks: bytes, size: int, overlap: int) -> Iterator[tuple[bytes, int]]:
    """(part, counted): parts of about `size` bytes at most, unless single words are longer. What begins before `counted` in a part has `overlap` further words of its piece in it, and begins in this part alone."""
    at = 0
    while len(text) - at > size:
        cut = max(text.rfind(b, at + 1, at + size) for b in (bytes([c]) for c in breaks))
        if cut >= 0:
            yield text[at:cut], cut - at
            at = cut
            continue
        end = max(text.rfind(b" ", at + 1, at + size), text.rfind(b"\t", at + 1, at + size))
        head = text[at : max(at, end)].rsplit(None, overlap)
        if len(head) <= overlap or not head[0].strip():
            break
        counted = text.index(head[0].lstrip(), at) + len(head[0].lstrip()) - at
        yield text[at:end], counted
        at += counted
    yield text[at:], len(text) - at


def chunks(texts: Sequence[bytes], breaks: bytes, overlap: int, size: int = CHUNK) -> Iterator[tuple[list[int], list[bytes], np.ndarray]]:
    """(number of the text, part, counted) of the texts' parts, in groups of about `size` bytes."""
    owners: list[int] = []
    parts: list[bytes] = []
    counted: list[int] = []
    held = 0
    for i, text in enumerate(texts):
        for part, n in windows(text, breaks, size, overlap):
            if held and held + len(part) > size:
                yield owners, parts, np.array(counted)
                owners, parts, counted, held = [], [], [], 0
            owners.append(i)
            parts.append(part)
            counted.append(n)
            held += len(part) + 1
    if parts:
        yield owners, parts, np.array(counted)
