"""Document fingerprints: bottom-k sketches of word shingles.

A sketch holds the k smallest distinct 64-bit hashes of a text's shingles of five lower-cased words
(A-Z only; of fewer words, the whole sequence is the one shingle). Sketches of parts merge into the
sketch of the whole, and two of them estimate resemblance, containment and the number of distinct shingles;
with fewer than k shingles the figures are exact.

Defined cases: a null text is an empty text; a text without words has an empty sketch, like only to
another empty one (1.0); equal texts have equal sketches; repeated identifiers are rows of their
own, ordered by their text; null identifiers come last in descending order; an empty table gives no
rows; further columns are left alone, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostlake.llm import textvec
from frostlake.llm.common import materialise, parts_for, shuffle_partitions, text_of

SHINGLE = 5
K = 128
#: Keys whose sketches a task holds at once.
KEYS = 20_000
#: Rows whose sketches are made together.
ROWS = 1500
#: Stands for a null identifier where ranges are made: below all others.
_NONE = -1e19


def sketches(texts: pa.Array, k: int = K, shingle: int = SHINGLE) -> list[np.ndarray]:
    """The sketch of each text: sorted, at most k numbers."""
    out: list[np.ndarray] = []
    for _, part in textvec.chunks(texts):
        w = textvec.words(part, lower=True)
        hashes = w.hashes()
        grams, at = textvec.grams(hashes, w.first, tuple(range(shingle)))
        bounds = np.searchsorted(at, w.first)
        for i in range(len(part)):
            n = w.first[i + 1] - w.first[i]
            if n == 0:
                out.append(np.zeros(0, np.uint64))
            elif n < shingle:
                short = np.uint64(n)
                own = np.array([short], np.uint64)
                for h in hashes[w.first[i] : w.first[i + 1]]:
                    own = textvec.mix(own * np.uint64(0xD6E8FEB86659FD93) + h)
                out.append(own)
            else:
                own = np.sort(grams[bounds[i] : bounds[i + 1]])
                keep = np.ones(len(own), bool)
                keep[1:] = own[1:] != own[:-1]
                out.append(own[keep][:k])
    return out


def merge(parts: Iterable[np.ndarray], k: int = K) -> np.ndarray:
    """The sketch of all parts together."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *parts]))[:k]


def distinct(sketch: np.ndarray, k: int = K) -> float:
    """The number of distinct shingles."""
    return float(len(sketch)) if len(sketch) < k else (k - 1) / (float(sketch[k - 1]) / 2.0**64)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """The share of their distinct shingles that both have."""
    if not len(a) and not len(b):
        return 1.0
    both = np.sort(np.concatenate([a, b]))
    again = np.zeros(len(both), bool)
    again[1:] = both[1:] == both[:-1]
    seen = np.cumsum(~again)
    union = min(int(seen[-1]), k)
    return float(np.count_nonzero(again & (seen <= union)) / union)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """The share of a's distinct shingles that b has too."""
    if not len(a):
        return 1.0
    union = distinct(merge([a, b], k), k)
    return min(1.0, resemblance(a, b, k) * union / distinct(a, k))


def encode(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype(">u8").tobytes()).decode()


def decode(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), ">u8").astype(np.uint64)


def fingerprint(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, fingerprint, n_shingles) for every row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = sketches(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n"), pa.array(map(encode, own), pa.string()), pa.array(map(distinct, own), pa.float64())], names=["id", "n", "f", "d"])

    got = df.select(F.col(id_col).cast("long").alias("id"), F.length(text_of(text_col)).cast("long").alias("n"), text_of(text_col).alias("text")).mapInArrow(rows, "id long, n long, f string, d double")
    return got.select(F.col("id").alias(id_col), F.col("n").alias("n_chars"), F.col("f").alias("fingerprint"), F.col("d").alias("n_shingles"))


def merged(df: DataFrame, key: str, fingerprint_col: str = "fingerprint") -> DataFrame:
    """(key, fingerprint) of all rows of each key: merged in every task first, KEYS keys at a time, so that a key with
    most rows brings few sketches from each task; then, sorted by key, one after the other."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            for k, f in zip(batch.column("k").to_pylist(), batch.column("f").to_pylist(), strict=True):
                held[k] = merge([held.get(k, np.zeros(0, np.uint64)), decode(f or "")])
                if len(held) >= KEYS:
                    yield told(held)
                    held = {}
        yield told(held)

    def told(held: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([encode(x) for x in held.values()], pa.string())], names=["k", "f"])

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            done: dict = {}
            for k, f in zip(batch.column("k").to_pylist(), batch.column("f").to_pylist(), strict=True):
                if held and k not in held:
                    done |= held
                    held = {}
                held[k] = merge([held.get(k, np.zeros(0, np.uint64)), decode(f)])
            yield told(done)
        yield told(held)

    rows = df.select(F.col(key).cast("string").alias("k"), F.col(fingerprint_col).alias("f")).mapInArrow(partial, "k string, f string")
    return rows.repartition("k").sortWithinPartitions("k").mapInArrow(final, "k string, f string").select(F.col("k").alias(key), F.col("f").alias(fingerprint_col))


def _beside_next(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(bucket, halo, id, text), sorted by descending id inside buckets that are ranges of ids, those of an id with more
    rows than a bucket should have by ranges of their texts' hashes; the row that follows a bucket's last one is in
    it too, marked halo. Splitters come from the id column alone."""
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    at = F.coalesce(F.col("id").cast("double"), F.lit(_NONE))
    n = max(4 * shuffle_partitions(spark), parts_for(df))
    found = rows.select(at.alias("at")).approxQuantile("at", [i / n for i in range(1, n)], 0.25 / n) if n > 1 else []
    times = Counter(found)
    # A splitter that comes again has a bucket of its own, from it to the next number.
    ends = {float(np.nextafter(v, np.inf)) for v, k in times.items() if k > 1}
    splits = [float("-inf"), *sorted({*times, *ends}), float("inf")]
    splits = splits if len(splits) > 2 else [float("-inf"), 0.0, float("inf")]
    deal = Bucketizer(splits=splits, inputCol="at", outputCol="range").transform
    seen = deal(rows.select("id", at.alias("at"))).groupBy("range").agg(F.max("id").alias("top"), F.min("id").alias("low"), F.count("id").alias("n"), F.count(F.lit(1)).alias("all")).collect()  # a row for each range
    pieces = {r.range: times[splits[int(r.range)]] + 1 for r in seen if times.get(splits[int(r.range)], 0) > 1 and (r.top == r.low and r.n == r.all or r.n == 0)}
    known = spark.createDataFrame([(r.range, r.top, pieces.get(r.range, 1)) for r in seen] or [(0.0, None, 1)], "range double, top long, pieces int")
    part = F.floor(F.least(F.lit(0.9999999), F.xxhash64("text") / float(1 << 64) + 0.5) * F.col("pieces"))
    dealt = deal(rows.withColumn("at", at)).join(F.broadcast(known), "range")
    # In descending order of ids, and inside one id in ascending order of hashes.
    place = -F.col("range") * (1 << 20) + F.when(F.col("pieces") > 1, part).otherwise(0)
    dealt = dealt.select(place.cast("long").alias("bucket"), "id", "text", "top")
    firsts = materialise(dealt.where(F.col("id").eqNullSafe(F.col("top"))).groupBy("bucket").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", "id")).alias("x")))
    order = sorted(r.bucket for r in firsts.select("bucket").collect())  # a row for each bucket
    to = spark.createDataFrame([(b, order[i - 1]) for i, b in enumerate(order)] or [(0, 0)], "bucket long, target long")
    halo = firsts.join(F.broadcast(to), "bucket").select(F.col("target").alias("bucket"), F.lit(True).alias("halo"), "x.id", "x.text")
    both = dealt.select("bucket", F.lit(False).alias("halo"), "id", "text").unionByName(halo)
    return both.repartition(n, "bucket").sortWithinPartitions("bucket", "halo", F.col("id").desc_nulls_last(), F.xxhash64("text"), "text")


def edited(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row its sketch, the sketch of its text with the last half replaced by as much of the next row's
    text (descending identifier; after the last, the first), and the likeness of both pairs."""
    names = ["id", "n", "sha", "f", "e", "near_e", "near_n"]
    schema = "id long, n long, sha string, f string, e string, near_e double, near_n double"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row so far: its next one is still to come
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                part = pa.Table.from_batches([whole.slice(at, ROWS)])
                part = part if held is None else pa.concat_tables([held, part])
                held = part.slice(part.num_rows - 1)
                if part.num_rows < 2:
                    continue
                part = part.combine_chunks()
                text_col_ = part.column("text").combine_chunks()
                text_col_ = text_col_.chunk(0) if isinstance(text_col_, pa.ChunkedArray) else text_col_
                texts, ids = text_col_.to_pylist(), part.column("id").to_pylist()
                bucket, halo = part.column("bucket").to_pylist(), part.column("halo").to_pylist()
                own = sketches(text_col_)
                use = [i for i in range(len(texts) - 1) if not halo[i] and bucket[i] == bucket[i + 1]]
                new = [texts[i][: len(texts[i]) - len(texts[i]) // 2] + texts[i + 1][: len(texts[i]) // 2] for i in use]
                other = sketches(pa.array(new, pa.large_string()))
                out = [
                    [ids[i] for i in use],
                    [len(texts[i]) for i in use],
                    [hashlib.sha256(x.encode()).hexdigest() for x in new],
                    [encode(own[i]) for i in use],
                    [encode(x) for x in other],
                    [resemblance(own[i], x) for i, x in zip(use, other, strict=True)],
                    [resemblance(own[i], own[i + 1]) for i in use],
                ]
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=names)

    got = _beside_next(df, id_col, text_col).mapInArrow(rows, schema)
    return got.select(F.col("id").alias(id_col), F.col("n").alias("n_chars"), F.col("sha").alias("edited_sha256"), F.col("f").alias("fingerprint"), F.col("e").alias("edited_fingerprint"), F.col("near_e").alias("near_edited"), F.col("near_n").alias("near_next"))
