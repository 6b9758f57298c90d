"""Words of whole texts as numpy arrays: byte ranges and 64-bit hashes, without a Python object for each word.

A word is a run of bytes that are not ASCII white space, which is `[^\\x20\\x09-\\x0D]+` over the text. Hashes are the
same in every process, so that they can be shuffle keys.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are taken at a time; only a longer single word needs more.
BLOCK = 1 << 20

_U = np.uint64
_P = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads every input bit over the whole word."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTER = mix(np.arange(1, 257, dtype=_U))
_LOWER = _LETTER.copy()
_LOWER[65:91] = _LETTER[97:123]
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i up to n at least; the usual length is kept."""
    size = max(BLOCK + (BLOCK >> 3), n + 1)
    if (got := _powers.get(size)) is None:
        got = tuple(np.cumprod(np.concatenate([np.ones(1, _U), np.full(size - 1, p & (2**64 - 1), _U)]), dtype=_U) for p in (_P, pow(_P, -1, 2**64)))
        if size == BLOCK + (BLOCK >> 3):
            _powers[size] = got
    return got


@dataclass
class Block:
    """Part of a batch of texts. doc: row of each segment; at: where each segment starts in data, and the end."""

    data: np.ndarray
    doc: np.ndarray
    at: np.ndarray
    #: True where the segment ends its text.
    last: np.ndarray

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """First byte of each word and the byte after it."""
        n = len(self.data)
        ink = ~SPACE[self.data]
        edge = np.zeros(n + 1, bool)
        edge[self.at] = True
        before = np.concatenate([[False], ink[:-1]]) if n else ink
        after = np.concatenate([ink[1:], [False]]) if n else ink
        return np.flatnonzero(ink & (~before | edge[:-1])), np.flatnonzero(ink & (~after | edge[1:])) + 1

    def sums(self, lower: bool = False) -> np.ndarray:
        """Prefix sums from which hashes() gets the hash of any range."""
        pw, _ = _power(len(self.data))
        out = np.zeros(len(self.data) + 1, _U)
        np.cumsum((_LOWER if lower else _LETTER)[self.data] * pw[: len(self.data)], out=out[1:])
        return out

    def hashes(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        _, inverse = _power(len(self.data))
        return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(_U))

    def segment(self, start: np.ndarray) -> np.ndarray:
        """The segment that each byte position is in."""
        return np.searchsorted(self.at, start, side="right") - 1


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts one after another and their offsets; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _cuts(data: np.ndarray, start: int, end: int, limit: int) -> Iterator[tuple[int, int]]:
    """A long text in parts; each but the first starts at white space that follows a word."""
    while end - start > limit:
        stop = 0
        for a, b in ((start + limit // 2, start + limit), (start + limit, end)):
            gap = SPACE[data[a:b]]
            if len(found := np.flatnonzero(gap[1:] & ~gap[:-1])):
                stop = a + 1 + int(found[0])
                break
        if not stop:
            break
        yield start, stop
        start = stop
    yield start, end


def blocks(texts: pa.Array, limit: int = BLOCK) -> Iterator[Block]:
    """The texts in order, some at a time, long ones in several segments. Empty texts have an empty segment."""
    data, offsets = _buffers(texts)
    begin, doc, at, last = 0, [], [], []
    for i in range(len(offsets) - 1):
        for a, b in _cuts(data, int(offsets[i]), int(offsets[i + 1]), limit):
            if doc and b - begin > limit:
                yield Block(data[begin:a], np.array(doc), np.array([*at, a]) - begin, np.array(last))
                begin, doc, at, last = a, [], [], []
            doc.append(i)
            at.append(a)
            last.append(b == offsets[i + 1])
    if doc:
        yield Block(data[begin : offsets[-1]], np.array(doc), np.array([*at, offsets[-1]]) - begin, np.array(last))
