"""Hashed word features of many texts at once, for the linear models."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from frostlake.llm import textvec

#: Lengths, in bytes, of the ends of words.
ENDS = (1, 2, 3)


@dataclass
class Rows:
    """Sparse rows: the columns of row i are column[first[i]:first[i + 1]], each once, with counts."""

    column: np.ndarray
    count: np.ndarray
    first: np.ndarray
    words: np.ndarray  # of each row


def _features(w: textvec.Words, skips: bool, ends: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of features, and the text of each."""
    doc = w.doc()
    hashes = w.hashes()
    values, owners = [hashes], [doc]
    for offsets in ((0, 1), (0, 2), (0, 3)) if skips else ((0, 1),):
        got, at = textvec.grams(hashes, w.first, offsets)
        values.append(got)
        owners.append(doc[at])
    if ends:
        length = w.ends - w.starts
        for n in ENDS:
            at = np.flatnonzero(length >= n)
            values.append(textvec.mix(w.hashes(w.ends[at] - n, w.ends[at]) + np.uint64(64 + n)))
            owners.append(doc[at])
        again = np.flatnonzero((hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1]))
        values.append(np.full(len(again), np.uint64(0xA24BAED4963EE407)))  # a word that follows itself, whichever
        owners.append(doc[again])
    return np.concatenate(values), np.concatenate(owners)


def rows(texts: pa.Array, bits: int, skips: bool = True, ends: bool = False, lower: bool = True, letters: bool = True) -> Iterator[tuple[int, Rows]]:
    """(row, Rows) for chunks of the texts: words and neighbouring pairs, with skips also pairs that skip one or two words,
    with ends also the ends of words. letters: words are runs of letters and digits, without the marks around them."""
    for base, part in textvec.chunks(texts):
        w = textvec.words(part, lower, textvec.LETTERS if letters else textvec._WORD)
        values, owners = _features(w, skips, ends)
        keys = (owners.astype(np.uint64) << np.uint64(32)) | (values >> np.uint64(64 - bits))
        keys.sort()
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        at = np.flatnonzero(new)
        count = np.diff(np.append(at, len(keys)))
        keys = keys[at]
        owner = (keys >> np.uint64(32)).astype(np.int64)
        yield base, Rows((keys & np.uint64(0xFFFFFFFF)).astype(np.int64), count, np.searchsorted(owner, np.arange(len(part) + 1)), np.diff(w.first))


def strength(count: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The value of a feature that occurs count times in a text of so many words: more for one of a short text."""
    return np.minimum(4.0, (1.0 + np.log(count)) * np.sqrt(200.0 / np.maximum(words, 20)))


def matrix(texts: pa.Array, bits: int, **kinds: bool) -> list[tuple[np.ndarray, np.ndarray]]:
    """(columns, values) of every text, for training."""
    out = []
    for _, r in rows(texts, bits, **kinds):
        values = strength(r.count, np.repeat(r.words, np.diff(r.first))).astype(np.float32)
        columns = r.column.astype(np.int32)
        out += [(columns[a:b], values[a:b]) for a, b in zip(r.first[:-1].tolist(), r.first[1:].tolist(), strict=True)]
    return out


def linear(texts: pa.Array, weights: np.ndarray, bits: int, **kinds: bool) -> np.ndarray:
    """The weighted sum of every text's features."""
    out = [np.zeros(0)]
    for _, r in rows(texts, bits, **kinds):
        out.append(sums(weights[r.column] * strength(r.count, np.repeat(r.words, np.diff(r.first))), r.first))
    return np.concatenate(out)


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The sum of each row's values; 0 for a row without any."""
    total = np.concatenate([[0.0], np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]
