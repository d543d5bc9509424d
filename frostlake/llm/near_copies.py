"""One row of each group of near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more,
and what these link together.

SimHash proposes pairs: fingerprints of 128 bits (the majority of the XXH3 hashes of a text's distinct shingles) within
RADIUS bits. Similarity 0.8 takes sets whose sizes are within a quarter of each other, so that only tiles of such
sizes meet, and are compared whole, with exclusive-or and bit counts. Texts that have a neighbour then get a bitmap
of their shingles, with 8 to 16 bits for each: what two bitmaps differ in, their sets differ in, so that most pairs
that are not similar enough are ruled out without their sets. A pair counts if its sets, as 64-bit hashes,
really are that similar. Equal sets are one from the start. A round tries in each pair of tiles a forest of the
closest pairs that would join different groups, so that a large group gives about a pair for each of its texts; when a
round joins few, one last round tries all pairs between groups that are left. So no pair is left out.

Defined cases: a null text is an empty text; texts without words are copies of each other; fewer words than a
shingle make one shingle; of a group the row with the smallest identifier stays, null counting as the largest, and
of its rows the one that the table has first; an empty table gives no rows; further columns are carried
along, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import starmap

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frostlake.llm.common import materialise, text_of
from frostlake.llm.components import components

SHINGLE = 5
#: Bits that differ at most: in all 128, and in the first 64, which are compared first. Pairs of similarity 0.8 differ in
#: about 19 and 10.
RADIUS = 36
FIRST_RADIUS = 22
#: Rounds of forests go on while they join such a share of the pairs that they try.
WORTH = 0.2
#: Bytes of fingerprints or bitmaps in a tile.
TILE_BYTES = 1 << 20


def shingles_of(text: bytes) -> np.ndarray:
    """The 128-bit hashes of the distinct shingles as (n, 2), by the first 64 bits, which tell them apart."""
    words = text.lower().split()  # bytes: A-Z only, and the six blanks only
    n = len(words)
    if not n:
        return np.zeros((0, 2), np.uint64)
    joined = b" ".join(words)
    count = max(1, n - SHINGLE + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = np.concatenate([[0], ends[:-1]])[:count]
    cuts = starmap(slice, zip(starts.tolist(), (ends[n - count :] - 1).tolist(), strict=True))
    hashes = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, map(joined.__getitem__, cuts))), "<u8").reshape(-1, 2)
    return hashes[np.unique(hashes[:, 0], return_index=True)[1]]


def sketch_of(text: bytes) -> tuple[int, int, int, int]:
    """The set's own hash, its size, and the two halves of the fingerprint; ties go by the least shingle."""
    hashes = shingles_of(text)
    n = len(hashes)
    if not n:
        return 0, 0, 0, 0
    total = np.zeros(128, np.int64)
    for at in range(0, n, 1 << 14):
        total += np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 16), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    least = np.unpackbits(hashes[0].view(np.uint8), bitorder="little")
    low, high = np.packbits(np.where(total * 2 == n, least, total * 2 > n).astype(bool), bitorder="little").view(np.int64).tolist()
    return int(np.uint64(xxhash.xxh3_64_intdigest(hashes[:, 0].tobytes())).view(np.int64)), n, low, high


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = np.array([sketch_of(x.as_py()) for x in batch.column("text")], np.int64).reshape(-1, 4)
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), *[pa.array(own[:, i]) for i in range(4)]], names=["row", "id", "own", "n", "low", "high"])


def bitmap(shingles: np.ndarray, size: int) -> np.ndarray:
    """A bit for each shingle, by its lowest bits; size is a power of two, 64 at least."""
    out = np.zeros(size, np.uint8)
    out[(shingles & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").view(np.uint64)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingles_of(x.as_py())[:, 0] for x in batch.column("text")]
        bits = [bitmap(x, n).tobytes() for x, n in zip(sets, batch.column("size").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64())), pa.array(bits, pa.binary())], names=["node", "shingles", "bits"])


# Tiles ---------------------------------------------------------------------------------------------------------


def _band() -> Column:
    """Sizes within a quarter of each other are in the same band or in neighbouring ones."""
    return F.floor(F.log(F.greatest(F.col("n"), F.lit(1))) / F.log(F.lit(1.2501))).cast("int")


def _bits() -> Column:
    """Bits of the bitmaps of a band: a power of two, 8 to 16 for each shingle of its largest sets."""
    return F.greatest(F.lit(64), F.pow(F.lit(2), F.ceil(F.log2(8 * F.pow(F.lit(1.2501), F.col("band") + 1))))).cast("int")


def _met(nodes: DataFrame, fields: list[str], weight: Column) -> DataFrame:
    """(a, b, same): pairs of tiles of nodes in bands that can hold similar sets, each pair once. weight: a node's bytes."""
    rows = nodes.withColumn("band", _band())
    bands = materialise(rows.groupBy("band").agg(F.ceil(F.sum(weight) / TILE_BYTES).cast("int").alias("k")))
    tiles = rows.join(F.broadcast(bands), "band").groupBy("band", F.pmod(F.xxhash64("node", F.lit(7)), "k").cast("int").alias("part"), "k")
    tiles = materialise(tiles.agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("held")))
    met = bands.select("band", F.explode(F.array("band", F.col("band") + 1)).alias("to")).join(F.broadcast(bands.select(F.col("band").alias("to"), F.col("k").alias("to_k"))), "to")
    pairs = tiles.join(F.broadcast(met), "band").select("band", "part", F.col("held").alias("a"), "to", F.explode(F.expr("sequence(if(`to` = band, part, 0), to_k - 1)")).alias("to_part"))
    other = tiles.select(F.col("band").alias("to"), F.col("part").alias("to_part"), F.col("held").alias("b"))
    return pairs.join(other, ["to", "to_part"]).select("a", "b", ((F.col("band") == F.col("to")) & (F.col("part") == F.col("to_part"))).alias("same"))


def _tile(column: pa.ListArray, i: int) -> dict:
    rows = column.values.slice(column.offsets[i].as_py(), column.offsets[i + 1].as_py() - column.offsets[i].as_py())
    out: dict = {}
    for field, values in zip(rows.type, rows.flatten(), strict=True):
        if field.name == "bits":
            out["bits"] = np.frombuffer(b"".join(values.to_pylist()), np.uint64).reshape(len(values), -1)
        else:
            out[field.name] = values.to_numpy(zero_copy_only=False)
    return out | {k: out[k].view(np.uint64) for k in ("low", "high")}


def _near(a: dict, b: dict, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in both tiles of the pairs within the radius, of sizes within a quarter and of different groups, each once."""
    size = len(b["low"])
    step = max(1, (1 << 17) // max(1, size))
    for at in range(0, len(a["low"]), step):
        i, j = np.divmod(np.flatnonzero(np.bitwise_count(a["low"][at : at + step, None] ^ b["low"][None, :]) <= FIRST_RADIUS), size)
        i += at
        keep = 5 * np.minimum(a["n"][i], b["n"][j]) >= 4 * np.maximum(a["n"][i], b["n"][j])
        if same:
            keep &= i < j
        if "label" in a:
            keep &= a["label"][i] != b["label"][j]
        i, j = i[keep], j[keep]
        keep = np.bitwise_count(a["low"][i] ^ b["low"][j]).astype(int) + np.bitwise_count(a["high"][i] ^ b["high"][j]) <= RADIUS
        if keep.any():
            yield i[keep], j[keep]


def _folded(x: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps as smaller ones have them."""
    while x.shape[1] > words:
        half = x.shape[1] // 2
        x = x[:, :half] | x[:, half:]
    return x


def _possible(a: dict, b: dict, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The near pairs that their bitmaps do not rule out, and the share in which these differ: sets of a similarity of 0.8
    differ in a ninth of their sizes' sum at most."""
    words = min(a["bits"].shape[1], b["bits"].shape[1])
    x, y = _folded(a["bits"], words), _folded(b["bits"], words)
    out = []
    for i, j in _near(a, b, same):
        for at in range(0, len(i), step := max(1, (1 << 21) // words)):
            p, q = i[at : at + step], j[at : at + step]
            apart = np.bitwise_count(x[p] ^ y[q]).sum(axis=1, dtype=np.int64)
            both = a["n"][p] + b["n"][q]
            keep = 9 * apart <= both
            out.append((p[keep], q[keep], apart[keep] / np.maximum(both[keep], 1)))
    if not out:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    return tuple(np.concatenate(z) for z in zip(*out, strict=True))


def forest(u: np.ndarray, v: np.ndarray, apart: np.ndarray, size: int) -> np.ndarray:
    """Of the links u[k] - v[k] between size nodes those of a spanning forest with the least distances: in turns, each
    tree takes its nearest link to another."""
    label = np.arange(size)
    order = np.lexsort((v, u, apart))
    rank = np.empty(len(u), np.int64)
    rank[order] = np.arange(len(u))
    taken = np.zeros(len(u), bool)
    open_ = np.arange(len(u))
    while True:
        open_ = open_[label[u[open_]] != label[v[open_]]]
        if not len(open_):
            return np.flatnonzero(taken)
        best = np.full(size, len(u))
        np.minimum.at(best, label[u[open_]], rank[open_])
        np.minimum.at(best, label[v[open_]], rank[open_])
        links = order[np.unique(best[best < len(u)])]
        taken[links] = True
        while True:  # trees that are linked get the least label of theirs
            x, y = label[u[links]], label[v[links]]
            least = np.minimum(x, y)
            new = np.arange(size)
            np.minimum.at(new, x, least)
            np.minimum.at(new, y, least)
            merged = new[label]
            if np.array_equal(merged, label):
                break
            label = merged


# Rounds --------------------------------------------------------------------------------------------------------


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k, same in enumerate(batch.column("same").to_pylist()):
            a, b = _tile(batch.column("a"), k), _tile(batch.column("b"), k)
            seen = np.zeros(len(a["node"]), bool), np.zeros(len(b["node"]), bool)
            for i, j in _near(a, b, same):
                seen[0][i] = seen[1][j] = True
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate([a["node"][seen[0]], b["node"][seen[1]]])))], names=["node"])


def _tried(all_pairs: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, same in enumerate(batch.column("same").to_pylist()):
                a, b = _tile(batch.column("a"), k), _tile(batch.column("b"), k)
                i, j, apart = _possible(a, b, same)
                if not all_pairs and len(i):
                    # Groups, not texts, are what the links of a round are to join.
                    labels, place = np.unique(np.concatenate([a["label"][i], b["label"][j]]), return_inverse=True)
                    keep = forest(place[: len(i)], place[len(i) :], apart, len(labels))
                    i, j = i[keep], j[keep]
                yield pa.RecordBatch.from_arrays([pa.array(a["node"][i]), pa.array(b["node"][j])], names=["u", "v"])

    return rows


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose sets of shingles have a Jaccard similarity of 0.8 or more."""
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("b")), "v")
    # Of the union a share of 0.8 or more: inner >= 0.8 * (a + b - inner).
    return materialise(both.where(9 * F.size(F.array_intersect("a", "b")) >= 4 * (F.size("a") + F.size("b"))).select("u", "v"))


def _links(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(u, v): links between nodes (node, n, low, high) that span every group."""
    near = materialise(_met(nodes, ["node", "n", "low", "high"], F.lit(32)).mapInArrow(_neighbours, "node long").distinct())
    known = nodes.join(near, "node").withColumn("band", _band()).withColumn("size", _bits())
    sets = materialise(texts.join(known.select(F.col("node").alias("row"), "size"), "row").select("row", "text", "size").mapInArrow(_sets, "node long, shingles array<long>, bits binary"))
    known = materialise(known.drop("band", "size").join(sets.select("node", "bits"), "node"))
    active, links = known.withColumn("label", F.col("node")), None
    fields = ["node", "n", "low", "high", "label", "bits"]
    weight = F.octet_length("bits") + 40
    while True:
        tried = materialise(_met(active, fields, weight).mapInArrow(_tried(False), "u long, v long"))
        good = _confirmed(tried, sets)
        links = good if links is None else links.unionByName(good)
        n_tried, n_good = tried.count(), good.count()
        if not n_tried:
            return links
        labels = components(links).select("node", F.col("root").alias("label"))
        active = materialise(known.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))
        if n_good <= WORTH * n_tried:
            rest = materialise(_met(active, fields, weight).mapInArrow(_tried(True), "u long, v long"))
            return links.unionByName(_confirmed(rest, sets))


def drop(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df without all but one of each group."""
    numbered = materialise(df.withColumn("__row", F.monotonically_increasing_id()))
    texts = numbered.select(F.col("__row").alias("row"), F.col(id_col).cast("long").alias("id"), F.encode(text_of(text_col), "UTF-8").alias("text"))
    sketches = materialise(texts.mapInArrow(_sketches, "row long, id long, own long, n long, low long, high long"))
    # Of equal sets the row that would stay is the node; by its key the least of a component is what stays of that.
    nodes = materialise(sketches.groupBy("own", "n", "low", "high").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("key"), F.count(F.lit(1)).alias("rows")).withColumn("node", F.col("key.row")))
    links = _links(nodes.select("node", "n", "low", "high"), texts)
    key = nodes.select("node", "key")
    ends = links.join(key.withColumnsRenamed({"node": "u", "key": "x"}), "u").join(key.withColumnsRenamed({"node": "v", "key": "y"}), "v")
    roots = components(ends.select(F.col("x").alias("u"), F.col("y").alias("v")))
    stays = nodes.join(roots.select(F.col("node.row").alias("node"), F.col("root.row").alias("stays")), "node", "left").where("stays is not null or rows > 1")
    stays = materialise(stays.select("own", "n", "low", "high", F.coalesce("stays", "node").alias("stays")))
    gone = materialise(sketches.join(stays, ["own", "n", "low", "high"]).where("row <> stays").select(F.col("row").alias("__row")))
    return numbered.join(gone, "__row", "left_anti").select(*[F.col(f"`{c}`") for c in df.columns])
