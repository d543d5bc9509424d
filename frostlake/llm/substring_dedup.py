"""Substring duplicates: windows of 13 words that start in an earlier document are removed.

Super-k-mer partitioning. The minimiser of a window is the word triple in it with the smallest hash. Consecutive
windows that share a minimiser travel as one packed string (their words joined by one space) to the
minimiser's bucket. Documents are dealt to batches; a batch sends an equal string once, with the smallest
identifier that has it, so a passage held by a third of all documents costs a string for each batch. In a
bucket all windows are sorted by hash, equal neighbours are compared in full, and each gets the smallest
identifier of its sequence. Strings with a window that starts in an earlier document go back to their batches,
where the documents' words are removed.

Minimisers that many different strings share (a frequent line or word pair) are counted first, over all
documents; their windows travel one by one to buckets by the hash of the whole window, so that such a
bucket is split however large it is. They are broadcast: HOT_MOST at most, for a minimiser is one of them only with
more than that share of all strings.

Defined cases: a null text has no words; a text of fewer words than a window loses nothing; a window
that repeats inside one document only is kept; rows that repeat an identifier are the same document to
the rule (neither is earlier) and each gives a row; null identifiers count as the smallest; an empty
table gives no rows; further columns are left alone, whatever their names.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostlake.llm import textvec
from frostlake.llm.common import materialise, shuffle_partitions, text_of

WINDOW = 13
MINIMISER = 3
#: Bytes of text in a batch, and of strings in a bucket, about: what a task holds at once.
BATCH_BYTES = 6 << 20
BUCKET_BYTES = 6 << 20
LEVEL = 3
#: A minimiser is split when it has more different strings than so many average buckets.
HOT = 0.5
#: Minimisers that are split at most.
HOT_MOST = 1 << 20

_BUCKET_SEED = np.uint64(0x2545F4914F6CDD1D)


def _joined(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """Texts with their words joined by one space, and the number of words of each."""
    split = [t.split() for t in texts]
    return pa.array([b" ".join(x) for x in split], pa.large_binary()), np.array([len(x) for x in split], np.int64)


def super_kmers(texts: pa.Array, window: int, minimiser: int) -> tuple[textvec.Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of the texts, and for each run of windows that share a minimiser: the first word, the number of
    windows, the minimiser's hash and the text. Windows never leave a text."""
    w = textvec.words(texts)
    none = np.zeros(0, np.int64)
    spots = window - minimiser + 1
    doc = w.doc()
    n = len(w.starts) - window + 1
    if n <= 0:
        return w, none, none, none.astype(np.uint64), none
    hashes = w.hashes()
    triple = np.zeros(len(hashes) - minimiser + 1, np.uint64)
    for k in range(minimiser):
        triple = textvec.mix(triple * np.uint64(0xD6E8FEB86659FD93) + hashes[k : k + len(triple)])
    least, width = triple, 1
    while width < spots:  # sliding minimum by doubling
        step = min(width, spots - width)
        least = np.minimum(least[: len(least) - step], least[step:])
        width += step
    least = least[:n]
    whole = doc[:n] == doc[window - 1 :]
    opens = whole.copy()
    opens[1:] &= ~(whole[:-1] & (least[1:] == least[:-1]) & (doc[1:n] == doc[: n - 1]))
    at = np.flatnonzero(opens)
    if not len(at):
        return w, none, none, none.astype(np.uint64), none
    run = np.cumsum(opens) - 1
    count = np.bincount(run[whole], minlength=len(at))
    return w, at, count, least[at], doc[at]


def _strings(w: textvec.Words, joined: bytes, at: np.ndarray, count: np.ndarray, window: int) -> list[bytes]:
    starts, ends = w.starts[at].tolist(), w.ends[at + count + window - 2].tolist()
    return [joined[a:b] for a, b in zip(starts, ends, strict=True)]


def _flat(texts: pa.Array) -> bytes:
    return textvec.raw_bytes(texts)[0].tobytes()


def _routes(w, at, count, key, doc, hot: np.ndarray, window: int):
    """Runs whose minimiser is in hot, cut into single windows with the window's own hash as key."""
    if not len(hot) or not len(at):
        return at, count, key, doc
    is_hot = hot[np.minimum(np.searchsorted(hot, key), len(hot) - 1)] == key
    if not is_hot.any():
        return at, count, key, doc
    n = count[is_hot]
    single = np.repeat(at[is_hot], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    own = w.hashes(w.starts[single], w.ends[single + window - 1])
    return (
        np.concatenate([at[~is_hot], single]),
        np.concatenate([count[~is_hot], np.ones(len(single), count.dtype)]),
        np.concatenate([key[~is_hot], own]),
        np.concatenate([doc[~is_hot], np.repeat(doc[is_hot], n)]),
    )


def _lowest(ids: list) -> list[int]:
    """Identifiers as numbers; null is the smallest."""
    return [-(1 << 63) if x is None else x for x in ids]


def _pack(strings: list[bytes], lows: np.ndarray) -> bytes:
    body = b"\n".join(strings)
    return zstandard.ZstdCompressor(level=LEVEL).compress(struct.pack("<q", len(strings)) + lows.astype("<i8").tobytes() + body)


def _unpack(blob: bytes) -> tuple[bytes, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = struct.unpack_from("<q", raw)[0]
    return raw[8 + 8 * n :], np.frombuffer(raw, "<i8", n, 8)


_COUNTED = pa.schema([("k", pa.int64()), ("n", pa.int64())])


def _hot_minimisers(docs: DataFrame, window: int, minimiser: int, share: float) -> np.ndarray:
    """Minimisers with more than a share of all strings, counted over all documents. A task sends those that have a
    quarter of the share of its own strings, however many tasks there are: of what the others have, less than half the share is missed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        totals: list[np.ndarray] = []
        held = strings = 0

        def shrunk():
            k, where = np.unique(np.concatenate(keys), return_inverse=True)
            return k, np.bincount(where, np.concatenate(totals)).astype(np.int64)

        for batch in batches:
            for _, part in textvec.chunks(batch.column("text")):
                got, n = np.unique(super_kmers(part, window, minimiser)[3], return_counts=True)
                keys.append(got)
                totals.append(n)
                held += len(got)
                strings += int(n.sum())
            if held > 4_000_000:
                k, n = shrunk()
                often = n > 1  # what is seen once in millions adds nothing to a share
                keys, totals, held = [k[often]], [n[often]], int(often.sum())
        if keys:
            k, n = shrunk()
            often = n >= 0.25 * share * strings
            yield pa.RecordBatch.from_arrays([pa.array([None]), pa.array([strings])], schema=_COUNTED)
            yield pa.RecordBatch.from_arrays([pa.array(k[often].view(np.int64)), pa.array(n[often])], schema=_COUNTED)

    counted = docs.select("text").mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))
    found = materialise(counted)
    strings = found.where("k is null").agg(F.sum("n")).first()[0] or 0
    return np.sort(np.array([r.k for r in found.where(F.col("k").isNotNull() & (F.col("n") > 0.5 * share * strings)).select("k").collect()], np.int64).view(np.uint64))


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, minimiser: int = MINIMISER) -> DataFrame:
    """(id, n_words, n_removed, kept): the text left of every row, its words joined by one space."""
    spark = df.sparkSession
    parts = shuffle_partitions(spark)
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.encode(text_of(text_col), "UTF-8").alias("text"))
    # A string has about (spots + 1) / 2 windows; words are counted as one for six bytes at the least.
    size = docs.agg(F.sum(F.octet_length("text")).alias("b")).first().b or 0
    spread = (window - minimiser + 2) / 2
    strings = max(1.0, size / 6 / spread)
    # By size, and small inputs still over as many tasks as there are partitions.
    packed = size * (spread + window) / spread
    n_batches = int(max(1, size / BATCH_BYTES, min(parts, size / (1 << 20))))
    n_buckets = int(max(1, packed / BUCKET_BYTES, min(parts, packed / (1 << 20))))
    share = max(200.0 / strings, HOT / n_buckets, 2.0 / HOT_MOST)
    hot_list = spark.sparkContext.broadcast(_hot_minimisers(docs, window, minimiser, share) if size else np.zeros(0, np.uint64))
    # Rows of one identifier, or of none, are spread by their texts.
    dealt = docs.withColumn("batch", F.pmod(F.xxhash64("id", "text"), F.lit(n_batches)).cast("int"))

    def runs_of(texts: list[bytes]):
        """For each chunk: where it begins, and (words, joined bytes, at, count, key, doc) of it."""
        joined, n_words = _joined(texts)
        hot = hot_list.value
        for at, part in textvec.chunks(joined):
            w, first, count, key, doc = super_kmers(part, window, minimiser)
            yield at, len(part), w, _flat(part), *_routes(w, first, count, key, doc, hot, window), n_words

    def send(table: pa.Table) -> pa.Table:
        """A batch's documents, to its strings by bucket."""
        ids = np.array(_lowest(table.column("id").to_pylist()), np.int64)
        low: dict[bytes, int] = {}
        bucket: dict[bytes, int] = {}
        for base, _, w, flat, at, count, key, doc, _ in runs_of(table.column("text").to_pylist()):
            where = (textvec.mix(key ^ _BUCKET_SEED) % np.uint64(n_buckets)).tolist()
            for s, i, b in zip(_strings(w, flat, at, count, window), ids[base + doc].tolist(), where, strict=True):
                old = low.get(s)
                if old is None:
                    low[s], bucket[s] = i, b
                elif i < old:
                    low[s] = i
        order = sorted(low)  # neighbours that begin alike pack well
        order.sort(key=bucket.__getitem__)
        where = np.array([bucket[s] for s in order], np.int64)
        lows = np.array([low[s] for s in order], np.int64)
        cuts = np.flatnonzero(np.diff(where, prepend=-1))
        out = [(int(where[a]), _pack(order[a:b], lows[a:b])) for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)], strict=True)]
        own = table.column("batch")[0].as_py() if table.num_rows else 0
        return pa.table([pa.array([x[0] for x in out], pa.int32()), pa.array([own] * len(out), pa.int32()), pa.array([x[1] for x in out], pa.binary())], names=["bucket", "batch", "blob"])

    def count(table: pa.Table) -> pa.Table:
        """A bucket's strings, to those with a window that starts in an earlier document; for each the
        smallest identifiers of its windows."""
        blobs = [_unpack(b) for b in table.column("blob").to_pylist()]
        batches = table.column("batch").to_pylist()
        flat = b"\n".join(b for b, _ in blobs)
        lows = np.concatenate([x for _, x in blobs])
        owner = np.repeat(np.array(batches), [len(x) for _, x in blobs])
        text = np.frombuffer(flat, np.uint8)
        cuts = np.flatnonzero(text == 10)
        offsets = np.concatenate([[0], cuts + 1, [len(flat) + 1]])
        string = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer((np.minimum(offsets, len(flat))).astype(np.int64).tobytes()), pa.py_buffer(flat)])
        w = textvec.words(string)
        inside = np.diff(w.first) - window + 1  # windows of each string
        of = np.repeat(np.arange(len(inside)), inside)
        first = np.repeat(w.first[:-1], inside) + np.arange(len(of)) - np.repeat(np.cumsum(inside) - inside, inside)
        starts, ends = w.starts[first], w.ends[first + window - 1]
        hashes = w.hashes(starts, ends)
        order = np.argsort(hashes, kind="stable")
        same = hashes[order][1:] == hashes[order][:-1]
        least = lows[of].copy()
        # Runs of equal hashes; their sequences are compared byte for byte.
        opens = np.flatnonzero(np.concatenate([[True], ~same]))
        lengths = np.diff(np.concatenate([opens, [len(order)]]))
        for a, n in zip(opens[lengths > 1].tolist(), lengths[lengths > 1].tolist(), strict=True):
            group = order[a : a + n]
            seqs = [flat[s:e] for s, e in zip(starts[group].tolist(), ends[group].tolist(), strict=True)]
            if seqs.count(seqs[0]) == n:
                least[group] = least[group].min()
            else:
                best: dict[bytes, int] = {}
                for s, v in zip(seqs, least[group].tolist(), strict=True):
                    best[s] = min(v, best.get(s, v))
                least[group] = [best[s] for s in seqs]
        # The batch knows its own smallest identifier of the string; it is told where another one has a smaller.
        told = np.flatnonzero(np.bincount(of, least < lows[of], minlength=len(inside)) > 0)
        bounds = np.concatenate([[0], np.cumsum(inside)])
        out = [(int(owner[i]), flat[offsets[i] : offsets[i + 1] - 1], least[bounds[i] : bounds[i + 1]].astype("<i8").tobytes()) for i in told.tolist()]
        by: dict[int, list] = {}
        for b, s, m in out:
            by.setdefault(b, []).append((s, m))
        blobs_out = [(b, zstandard.ZstdCompressor(level=LEVEL).compress(b"".join(struct.pack("<ii", len(s), len(m)) + s + m for s, m in x))) for b, x in sorted(by.items())]
        return pa.table([pa.array([x[0] for x in blobs_out], pa.int32()), pa.array([x[1] for x in blobs_out], pa.binary())], names=["batch", "reply"])

    def remove(key, left: pa.Table, right: pa.Table) -> pa.Table:
        known: dict[bytes, np.ndarray] = {}
        for blob in right.column("reply").to_pylist():
            raw, at = zstandard.ZstdDecompressor().decompress(blob), 0
            while at < len(raw):
                a, b = struct.unpack_from("<ii", raw, at)
                known[raw[at + 8 : at + 8 + a]] = np.frombuffer(raw, "<i8", b // 8, at + 8 + a)
                at += 8 + a + b
        real = left.column("id").to_pylist()
        ids = np.array(_lowest(real), np.int64)
        total, gone, kept = [], [], []
        low: dict[bytes, int] = {}  # of the batch's own documents
        held = []
        for base, n, w, flat, at, count_, _, doc, n_words in runs_of(left.column("text").to_pylist()):
            w.sums = None
            strings, owners = _strings(w, flat, at, count_, window), ids[base + doc].tolist()
            for s, own in zip(strings, owners, strict=True):
                old = low.get(s)
                if old is None or own < old:
                    low[s] = own
            held.append((base, n, w, flat, at, strings, owners, n_words))
        for base, n, w, flat, at, strings, owners, n_words in held:
            drop = np.zeros(len(w.starts) + 1, np.int64)
            for s, first, own in zip(strings, at.tolist(), owners, strict=True):
                least = known.get(s)
                if least is not None:
                    for k in np.flatnonzero(least < own).tolist():
                        drop[first + k] += 1
                        drop[first + k + window] -= 1
                elif low[s] < own:
                    drop[first] += 1
                    drop[first + s.count(b" ") + 1] -= 1
            out = np.cumsum(drop[:-1]) > 0
            for i in range(n):
                a, b = int(w.first[i]), int(w.first[i + 1])
                mask = out[a:b]
                removed = int(mask.sum())
                total.append(int(n_words[base + i]))
                gone.append(removed)
                if removed:
                    stay = np.flatnonzero(~mask) + a
                    kept.append(b" ".join([flat[s:e] for s, e in zip(w.starts[stay].tolist(), w.ends[stay].tolist(), strict=True)]))
                else:
                    kept.append(flat[w.starts[a] : w.ends[b - 1]] if b > a else b"")
        return pa.table([pa.array(real, pa.int64()), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary())], names=["id", "n", "r", "kept"])

    sent = dealt.groupBy("batch").applyInArrow(send, "bucket int, batch int, blob binary")
    replies = sent.groupBy("bucket").applyInArrow(count, "batch int, reply binary")
    return dealt.groupBy("batch").cogroup(replies.groupBy("batch")).applyInArrow(remove, "id long, n long, r long, kept binary").select(F.col("id").alias(id_col), F.col("n").alias("n_words"), F.col("r").alias("n_removed"), F.decode("kept", "UTF-8").alias("kept"))
