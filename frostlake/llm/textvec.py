"""Words of many texts at once, as numpy arrays: boundaries and 64-bit hashes without a Python step per word.

A word is a run of bytes other than 0x20 and 0x09-0x0D, which no UTF-8 sequence contains inside a
character, or of other bytes that the caller names. A word's hash depends on its bytes only, never on where it stands.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Texts are handled in chunks of about so many bytes; a longer text is a chunk of its own, whole.
CHUNK_BYTES = 2 << 20

_WORD = np.ones(256, bool)
_WORD[[9, 10, 11, 12, 13, 32]] = False
#: Bytes of letters, digits and everything beyond ASCII, for words without the marks around them.
LETTERS = np.zeros(256, bool)
LETTERS[48:58] = LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_powers = {"n": 0, "up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base, and of its inverse modulo 2**64, up to n at least."""
    if _powers["n"] < n:
        size = max(n + 1, CHUNK_BYTES + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
        _powers["n"] = size - 1
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    data: np.ndarray  # bytes of all texts, one after the other
    starts: np.ndarray  # of each word
    ends: np.ndarray
    first: np.ndarray  # the first word of each text, and the number of words
    sums: np.ndarray  # running polynomial sums, for hashes of any stretch

    def doc(self) -> np.ndarray:
        """The text that each word is in."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self, starts: np.ndarray | None = None, ends: np.ndarray | None = None) -> np.ndarray:
        """Hashes of the words, or of other stretches of bytes."""
        starts, ends = (self.starts, self.ends) if starts is None else (starts, ends)
        down = _power_tables(len(self.data))[1]
        return mix((self.sums[ends] - self.sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def chunks(texts: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(row, slice) with about most bytes in each slice, a text at least."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, int)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, texts.slice(at, end - at)
        at = end


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the texts and the n + 1 offsets between them. Nulls have no bytes."""
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if texts.buffers()[2] is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def words(texts: pa.Array, lower: bool = False, inside: np.ndarray = _WORD) -> Words:
    """inside tells which bytes make a word."""
    data, offsets = raw_bytes(texts)
    if lower:
        data = _LOWER[data]
    n = len(data)
    word = inside[data]
    opens, closes = word.copy(), word.copy()
    opens[1:] &= ~word[:-1]
    closes[:-1] &= ~word[1:]
    edge = offsets[:-1][np.diff(offsets) > 0]
    opens[edge] = word[edge]
    edge = offsets[1:][np.diff(offsets) > 0] - 1
    closes[edge] = word[edge]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power_tables(n)[0][:n], out=sums[1:])
    return Words(data, starts, ends, np.searchsorted(starts, offsets), sums)


def grams(hashes: np.ndarray, first: np.ndarray, offsets: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words at i + offsets, for each i where all are in one text, and the i of each.
    (0, 1) are word pairs, (0, 2) pairs that skip a word."""
    span = offsets[-1]
    n = len(hashes) - span
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = np.ones(n, bool)
    for back in range(span):  # a start in the last span words of a text would leave it
        cut = first[1:] - 1 - back
        cut = cut[(cut >= 0) & (cut < n) & (cut >= first[:-1])]
        inside[cut] = False
    out = np.full(n, np.uint64(len(offsets) * 0x51ED27 + span), np.uint64)
    for k in offsets:
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + hashes[k : k + n])
    at = np.flatnonzero(inside)
    return out[at], at
