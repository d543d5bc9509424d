"""Near duplicates by SimHash fingerprints, compared exactly in tiles.

A fingerprint has a bit for each of the 64 bits that is set in over half of the XXH64 hashes (seed 42) of the
text's word shingles, repeats included. Distinct fingerprints are put in cells by the population
counts of their four 16-bit quarters. Two fingerprints within the radius have counts that differ by at
most the radius in sum, so only such cells meet: tiles of theirs are compared whole, with exclusive-or and
bit counts, and tile pairs whose counts differ by more are never formed. Equal fingerprints are
one row from the start, and a tile pair gives a spanning forest of its links, not all of them.

Defined cases: a null text is an empty text; texts without words have the fingerprint zero, which links like
any other; fewer words than a shingle make one shingle; rows that repeat an identifier get their own
fingerprints; null identifiers count as larger than any other; an empty table gives no rows; further
columns are left alone, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostlake.llm.common import materialise, text_of
from frostlake.llm.components import components

SHINGLE = 4
RADIUS = 4
SEED = 42
#: Fingerprints in a tile, about; a cell that holds more is dealt over several tiles.
TILE = 1024


def fingerprint_of(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.lower().split()  # bytes: A-Z only, and the six blanks only
    n = len(words)
    if n <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED) if n else 0
    joined = b" ".join(words)
    starts = np.zeros(n + 1, np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1, out=starts[1:])
    cuts = map(slice, starts[: n - shingle + 1].tolist(), (starts[shingle:] - 1).tolist())
    count = n - shingle + 1
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(joined.__getitem__, cuts), repeat(SEED)), np.uint64, count)
    total = np.zeros(64, np.int64)
    for at in range(0, count, 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > count, bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE) -> DataFrame:
    """(id, fp long)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.array([fingerprint_of(x.as_py(), shingle) for x in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(own.view(np.int64))], names=["id", "fp"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.encode(text_of(text_col), "UTF-8").alias("text")).mapInArrow(rows, "id long, fp long")


def _stars(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links left[i] - right[i]: each node with the least of its component."""
    nodes, ends = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b = ends[: len(left)], ends[len(left) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        np.minimum.at(new, label, new.copy())
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    keep = label != np.arange(len(nodes))
    return nodes[keep], nodes[label[keep]]


def _links_of(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between two tiles, or inside one."""
    other = a if b is None else b
    near = np.bitwise_count(a[:, None] ^ other[None, :]) <= radius
    if b is None:
        near = np.triu(near, 1)
    if not near.any():
        return a[:0], a[:0]
    i, j = np.nonzero(near)
    return _stars(a[i].view(np.int64), other[j].view(np.int64))


def _compare(radius: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right, same = batch.column("a"), batch.column("b"), batch.column("same").to_pylist()
            u, v = [], []
            lo, ro = left.offsets.to_numpy(), right.offsets.to_numpy()
            lv, rv = (x.values.to_numpy().view(np.uint64) for x in (left, right))
            for i in range(batch.num_rows):
                a, b = lv[lo[i] : lo[i + 1]], rv[ro[i] : ro[i + 1]]
                x, y = _links_of(a, None if same[i] else b, radius)
                if len(x):
                    u.append(x.view(np.int64))
                    v.append(y.view(np.int64))
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], names=["u", "v"])

    return rows


def links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(u, v): links between distinct fingerprints (fp) that span every component, from comparing all
    tile pairs whose population counts allow a link."""
    spark = distinct.sparkSession
    digit = [F.bit_count(F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF))).cast("int") for i in range(4)]
    cell = sum((d * (32**i) for i, d in enumerate(digit)), F.lit(0))
    rows = distinct.select("fp", cell.alias("cell"))
    # At most 17**4 cells, whatever the input, each with its number of tiles.
    cells = rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("k"))
    tiles = rows.join(F.broadcast(cells), "cell").groupBy("cell", F.pmod(F.xxhash64("fp", F.lit(7)), "k").cast("int").alias("part"), "k").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    tiles = materialise(tiles)
    cells = materialise(tiles.select("cell", "k").distinct())
    # Differences of the four counts that are within the radius, each pair of cells once. Counts are 0 to 16 in
    # digits of 32, so a sum that leaves that range is no cell's number.
    steps = [sum(x * 32**i for i, x in enumerate(d)) for d in product(range(-radius, radius + 1), repeat=4) if sum(map(abs, d)) <= radius and d[::-1] >= (0, 0, 0, 0)]
    met = cells.select(F.col("cell").alias("from"), F.explode(F.lit(steps)).alias("step")).select("from", (F.col("from") + F.col("step")).alias("to"))
    met = met.join(F.broadcast(cells.select(F.col("cell").alias("to"), F.col("k").alias("to_k"))), "to")
    pairs = tiles.join(met, F.col("cell") == F.col("from")).select("cell", "part", F.col("fps").alias("a"), "to", F.explode(F.expr("sequence(if(`to` = cell, part, 0), to_k - 1)")).alias("to_part"))
    other = tiles.select(F.col("cell").alias("to"), F.col("part").alias("to_part"), F.col("fps").alias("b"))
    pairs = pairs.join(other, ["to", "to_part"]).select("a", "b", ((F.col("cell") == F.col("to")) & (F.col("part") == F.col("to_part"))).alias("same"))
    return pairs.mapInArrow(_compare(radius), "u long, v long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(id, fingerprint, component_id) for every row."""
    fps = materialise(fingerprints(df, id_col, text_col, shingle))
    # A node is (least identifier, fingerprint), so that a component's root has its least identifier; null is the largest.
    none = F.lit((1 << 63) - 1)
    distinct = materialise(fps.groupBy("fp").agg(F.coalesce(F.min("id"), none).alias("low")))
    named = distinct.select(F.col("fp").alias("own"), F.struct("low", "fp").alias("node"))
    found = materialise(links(distinct, radius, tile))
    ends = found.join(named.withColumnsRenamed({"own": "u", "node": "x"}), "u").join(named.withColumnsRenamed({"own": "v", "node": "y"}), "v")
    roots = materialise(components(materialise(ends.select(F.col("x").alias("u"), F.col("y").alias("v")))))
    place = distinct.join(roots.select(F.col("node.fp").alias("fp"), F.col("root.low").alias("least")), "fp", "left").select("fp", F.coalesce("least", "low").alias("least"))
    return fps.join(materialise(place), "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.nullif(F.col("least"), none).alias("component_id"))
