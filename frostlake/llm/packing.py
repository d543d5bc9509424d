"""Packing documents into windows of fixed capacity by Karmarkar-Karp multiway differencing.

A document is its token ids and then the end id. Every full window's worth is a sequence by itself; the rest is
cut into halves down to CUT ids. Groups of such pieces are divided among as few windows as their
total allows: the two partial divisions with the largest imbalance are merged, largest loads against
smallest, until one is left, whose windows are nearly equal. Where one exceeds the capacity, the
group is divided anew among one window more.

Defined cases: a null or empty text is the end id alone; texts of any length are cut, never shortened;
rows that repeat an identifier are packed each, with equal columns; an empty table gives no rows;
further columns are left alone, whatever their names.
"""

from __future__ import annotations

import heapq
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostlake.llm.common import text_of

CAPACITY = 2048
END_ID = 1
#: What is left of a document is halved until it has at most so many ids.
CUT = 64
#: Pieces that are divided together.
GROUP = 1024
#: Words whose ids a worker remembers.
REMEMBERED = 600_000


def divide(sizes: np.ndarray, windows: int) -> np.ndarray:
    """The window of each piece: Karmarkar-Karp differencing into that many windows."""
    n = len(sizes)
    if windows <= 1 or n == 0:
        return np.zeros(n, np.int64)
    # A partial division has its loads, largest first and the smallest taken off all of them.
    heap: list = []
    nodes: list = []  # (left, right, order) or a piece
    for i in np.argsort(-sizes, kind="stable").tolist():
        loads = np.zeros(windows, np.int64)
        loads[0] = sizes[i]
        heapq.heappush(heap, (-int(sizes[i]), len(nodes), loads))
        nodes.append(i)
    while len(heap) > 1:
        _, a, x = heapq.heappop(heap)
        _, b, y = heapq.heappop(heap)
        loads = x + y[::-1]
        order = np.argsort(-loads, kind="stable")
        loads = loads[order]
        loads -= loads[-1]
        heapq.heappush(heap, (-int(loads[0]), len(nodes), loads))
        nodes.append((a, b, order))
    out = np.zeros(n, np.int64)
    walk = [(heap[0][1], np.arange(windows))]  # a division, and the window of each of its places
    while walk:
        node, place = walk.pop()
        if isinstance(nodes[node], int):
            out[nodes[node]] = place[0]
            continue
        a, b, order = nodes[node]
        mine = np.empty_like(place)
        mine[order] = place
        walk += [(a, mine), (b, mine[::-1])]
    return out


def windows_for(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The window of each piece, with no window over the capacity."""
    count = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        window = divide(sizes, count)
        if not len(sizes) or np.bincount(window, sizes, count).max() <= capacity:
            return window
        count += 1


def vocabulary() -> str:
    """The public vocabulary that the contract of packing names."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder(dict):
    """Ids, as bytes, of the stretches between blanks. No token reaches over a blank, so a text's ids are those of its
    stretches; most of them come back again and again."""

    #: The printable stand-ins of bytes in byte-level vocabularies.
    _PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(vocabulary)
        rest = iter(range(256, 512))
        self.stand_in = [chr(b if b in self._PLAIN else next(rest)) for b in range(256)]
        self.special = [x.content.lower().encode() for x in self.tokenizer.get_added_tokens_decoder().values()]

    def _ids(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, stretch: bytes) -> bytes:
        if stretch.isascii() and not stretch.islower():
            # The tokenizer ignores case; other letters go to it as they are, for accents may join them before it looks.
            low = stretch.lower()
            if low != stretch:
                return self._kept(stretch, self[low])
        if stretch.isalpha():  # lower-case letters of ASCII stand for themselves
            return self._kept(stretch, self._ids([t.id for t in self.tokenizer.model.tokenize(stretch.decode())]))
        if len(stretch) > 1 and stretch[-1] in b".,|!" and stretch[-2:-1].isalnum():
            return self[stretch[:-1]] + self[stretch[-1:]]
        word = stretch.decode()
        low = word.lower()
        if word.isalpha() and len(low) == len(word) and max(low) < "ɐ" and unicodedata.is_normalized("NFC", word):
            out = self._ids([t.id for t in self.tokenizer.model.tokenize("".join([self.stand_in[b] for b in low.encode()]))])
        else:
            out = self._ids(self.tokenizer.encode(word, add_special_tokens=False).ids)
        return self._kept(stretch, out)

    def _kept(self, stretch: bytes, out: bytes) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        if len(stretch) <= 64:
            self[stretch] = out
        return out

    def encode(self, text: str) -> bytes:
        raw = text.encode()
        low = raw.lower()
        if any(x in low for x in self.special):
            return self._ids(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return b"".join([self[x] for x in (low if raw.isascii() else raw).split()])


_encoders: dict[str, Encoder] = {}


def _encoder(vocabulary: str) -> Encoder:
    if vocabulary not in _encoders:
        _encoders[vocabulary] = Encoder(vocabulary)
    return _encoders[vocabulary]


def cuts(n: int, capacity: int = CAPACITY, cut: int = CUT) -> list[int]:
    """Lengths of a document's pieces: full windows, then halves of what is left until it is at most cut. Pieces of
    many sizes let the differencing even out its windows to a few ids."""
    full, rest = divmod(n, capacity)
    out = [capacity] * full
    while rest > cut:
        out.append(rest - rest // 2)
        rest //= 2
    return [*out, rest] if rest else out


_PIECES = "id long, start long, length long, crc long, total long"
_PACKED = _PIECES + ", sequence long, offset long"


def pieces(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(id, start, length, crc, total) of every piece."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            out: list[tuple] = []
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
                ids = encoder.encode(text.as_py()) + end
                at, total = 0, len(ids) // 4
                for n in cuts(total, capacity):
                    out.append((i, at, n, zlib.crc32(ids[4 * at : 4 * (at + n)]), total))
                    at += n
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in zip(*out, strict=True)], names=["id", "start", "length", "crc", "total"])

    return df.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text")).mapInArrow(rows, _PIECES)


def pack(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        held: list[pa.Table] = []

        def done(table: pa.Table) -> pa.RecordBatch:
            nonlocal number
            sizes = table.column("length").to_numpy()
            window = windows_for(sizes, capacity)
            order = np.argsort(window, kind="stable")
            ends = np.cumsum(sizes[order])
            first = np.searchsorted(window[order], np.arange(window.max() + 1))
            before = (ends - sizes[order])[first]
            offset = ends - sizes[order] - before[window[order]]
            table = table.take(pa.array(order)).append_column("sequence", pa.array(number + window[order])).append_column("offset", pa.array(offset))
            number += int(window.max()) + 1
            return table.combine_chunks().to_batches()[0]

        for batch in batches:
            full = batch.filter(pa.array(batch.column("length").to_numpy() == capacity))
            if full.num_rows:
                yield full.append_column("sequence", pa.array(number + np.arange(full.num_rows))).append_column("offset", pa.array(np.zeros(full.num_rows, np.int64)))
                number += full.num_rows
            part = batch.filter(pa.array(batch.column("length").to_numpy() < capacity))
            if part.num_rows:
                held.append(pa.Table.from_batches([part]))
            while sum(x.num_rows for x in held) >= 2 * GROUP:
                table = pa.concat_tables(held)
                yield done(table.slice(0, GROUP))
                held = [table.slice(GROUP)]
        if held:
            yield done(pa.concat_tables(held))

    cut = pieces(df, vocabulary, id_col, text_col, capacity)
    # Small inputs come together in few parts, as the partitions' own sizes decide; the order makes a lost part's windows the same again.
    dealt = cut.repartition(F.xxhash64("id", "start")).sortWithinPartitions(F.xxhash64("id", "start"), "id", "start", "crc")
    got = dealt.mapInArrow(rows, _PACKED)
    return got.select(F.col("id").alias(id_col), "start", "length", F.col("crc").alias("ids_crc32"), F.col("total").alias("doc_tokens"), F.col("sequence").alias("sequence_id"), "offset")
