"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are its lower-cased words (runs of letters and digits), neighbouring pairs, and pairs that skip one
or two words, hashed to 2**BITS columns. Each coordinate has its own learning rate, and the L1 term leaves most
weights at exactly zero: what is broadcast is the list of the others. Training takes at most SAMPLE labelled
rows, those whose identifiers have the smallest hashes.

Defined cases: null and empty texts have the score of the bias alone; without labels every score is 0.5 or
what the bias says; a repeated identifier is scored in each of its rows; a null identifier is never held
out; an empty table gives no rows; further columns are left alone, whatever their names.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frostlake.llm import hashed_text
from frostlake.llm.common import text_of
from frostlake.llm.training import fit, labelled_sample

BITS = 20
SAMPLE = 16_000
EPOCHS = 4
#: Of the step sizes, and what a feature must gather before its weight leaves zero: less than half a dozen rare texts don't.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 6.0, 1.0


def train(texts: pa.Array, labels: pa.Array, skips: bool = True) -> bytes:
    """The nonzero weights, the bias first, as (column, weight)."""
    size = 1 << BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    target = labels.to_numpy(zero_copy_only=False)
    one = np.array([size], np.int32), np.ones(1, np.float32)
    data = [(np.concatenate([c, one[0]]), np.concatenate([v, one[1]])) for c, v in hashed_text.matrix(texts, BITS, skips=skips)]

    def weights(at: np.ndarray) -> np.ndarray:
        zs = z[at]
        l1 = np.where(at == size, 0.0, L1)  # the bias is free
        return np.where(np.abs(zs) <= l1, 0.0, -(zs - np.sign(zs) * l1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in order.permutation(len(data)):
            at, value = data[i]
            p = 1.0 / (1.0 + np.exp(-np.clip(np.dot(weights(at), value), -35, 35)))
            g = (p - (target[i] > 0)) * value
            rate = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - rate * weights(at)
            n[at] += g * g
    final = weights(np.arange(size + 1))
    keep = np.flatnonzero(final)
    return struct.pack("<d", final[size]) + keep.astype("<i4").tobytes() + final[keep].astype("<f4").tobytes()


def _dense(model: bytes) -> tuple[float, np.ndarray]:
    n = (len(model) - 8) // 8
    weights = np.zeros((1 << BITS) + 1, np.float64)
    weights[np.frombuffer(model, "<i4", n, 8)] = np.frombuffer(model, "<f4", n, 8 + 4 * n)
    return struct.unpack_from("<d", model)[0], weights[:-1]


def fitted(df: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", learn: Column | None = None, most: int = SAMPLE) -> bytes:
    """A model from the rows of labels; learn is a condition on their id."""
    return fit(labelled_sample(df, labels, label, most, id_col, text_col, learn), train)


def score(df: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row."""
    held = df.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bias, weights = _dense(held.value)
        for batch in batches:
            logit = bias + hashed_text.linear(batch.column("text"), weights, BITS)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(1.0 / (1.0 + np.exp(-np.clip(logit, -35, 35))))], names=["id", "score"])

    got = df.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text")).mapInArrow(rows, "id long, score double")
    return got.select(F.col("id").alias(id_col), "score")
