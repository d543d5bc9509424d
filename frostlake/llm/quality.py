"""Quality selection: ordinal cumulative-link regression on graded ratings.

P(grade <= j) = logistic(threshold j - text . weights), with one weight vector over hashed text features for all
grades and thresholds in order. A text's expected grade and the probability of the wanted grade or
a better one come from it; selection goes by the latter. Features are words, neighbouring pairs, ends of words
(as they stand: capitals count) and words that follow themselves, hashed to 2**BITS columns. Training takes at
most SAMPLE rated rows, those whose identifiers have the smallest hashes.

Defined cases: null and empty texts have no features and get the thresholds' own probabilities; grades are
whole numbers, of any sign and size, whose order counts: those that occur are the levels, at most LEVELS of
them, beyond which neighbouring ones are put together under the lower one; with no ratings, or one grade
only, every text is expected to have that grade (0 without any); repeated identifiers are scored in each of
their rows; an empty table gives no rows; further columns are carried along, whatever their names.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostlake.llm import hashed_text
from frostlake.llm.common import text_of
from frostlake.llm.training import fit, labelled_sample

BITS = 18
SAMPLE = 8000
EPOCHS = 3
RATE = 0.05
DECAY = 1e-6
KINDS = {"skips": False, "ends": True, "lower": False, "letters": False}
#: Grades that are told apart at most.
LEVELS = 64


def _logistic(x: np.ndarray | float) -> np.ndarray | float:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def train(texts: pa.Array, labels: pa.Array) -> bytes:
    """The levels, the thresholds between them and the weights."""
    rated = labels.to_numpy(zero_copy_only=False).astype(np.int64)
    levels = np.unique(rated) if len(rated) else np.zeros(1, np.int64)
    if len(levels) > LEVELS:
        levels = levels[np.arange(LEVELS) * len(levels) // LEVELS]
    grade, grades = np.searchsorted(levels, rated, "right") - 1, len(levels)
    weights, seen = np.zeros(1 << BITS), np.full(1 << BITS, 1e-8)
    if grades > 1:
        share = np.clip(np.cumsum(np.bincount(grade, minlength=grades))[:-1] / len(grade), 0.01, 0.99)
        cuts = np.maximum.accumulate(np.log(share / (1 - share)))
        cut_seen = np.full(grades - 1, 1e-8)
        data = hashed_text.matrix(texts, BITS, **KINDS)
        order = np.random.default_rng(7)
        for _ in range(EPOCHS):
            for i in order.permutation(len(data)):
                at, value = data[i]
                j = int(grade[i])
                own = np.dot(weights[at], value)
                high = _logistic(cuts[j] - own) if j < grades - 1 else 1.0
                low = _logistic(cuts[j - 1] - own) if j else 0.0
                g = (1.0 - high - low) * value
                seen[at] += g * g
                weights[at] -= RATE * (g / np.sqrt(seen[at]) + DECAY * weights[at])
                # The thresholds on either side of the grade part from each other, and stay in order.
                p = max(high - low, 1e-9)
                move = np.zeros(grades - 1)
                if j < grades - 1:
                    move[j] -= high * (1 - high) / p
                if j:
                    move[j - 1] += low * (1 - low) / p
                cut_seen += move * move
                cuts = np.maximum.accumulate(cuts - RATE * move / np.sqrt(cut_seen))
    else:
        cuts = np.zeros(0)
    keep = np.flatnonzero(weights)
    return struct.pack("<ii", grades, len(keep)) + levels.astype("<i8").tobytes() + cuts.astype("<f8").tobytes() + keep.astype("<i4").tobytes() + weights[keep].astype("<f4").tobytes()


def fitted(df: DataFrame, ratings: DataFrame, rating: str = "quality", id_col: str = "doc_id", text_col: str = "text", most: int = SAMPLE) -> bytes:
    return fit(labelled_sample(df, ratings, rating, most, id_col, text_col), train)


def _loaded(model: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    grades, n = struct.unpack_from("<ii", model)
    at = 8 + 8 * grades + 8 * (grades - 1)
    weights = np.zeros(1 << BITS)
    weights[np.frombuffer(model, "<i4", n, at)] = np.frombuffer(model, "<f4", n, at + 4 * n)
    return np.frombuffer(model, "<i8", grades, 8), np.frombuffer(model, "<f8", grades - 1, 8 + 8 * grades), weights


def grade(df: DataFrame, model: bytes, wanted: int = 1, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The carried columns of every row as a struct "row", its expected grade, and the probability of the
    wanted grade or a better one."""
    held = df.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, cuts, weights = _loaded(held.value)
        first = int(np.searchsorted(levels, wanted))  # the lowest level that will do
        for batch in batches:
            own = hashed_text.linear(batch.column("text"), weights, BITS, **KINDS)
            over = 1.0 - _logistic(cuts[None, :] - own[:, None])  # of each grade but the lowest
            tail = over[:, first - 1] if 0 < first <= len(cuts) else np.full(len(own), float(first == 0))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(levels[0] + over @ np.diff(levels).astype(float)), pa.array(tail)], names=["row", "expected_grade", "tail_probability"])

    got = df.select(F.struct(*[F.col(f"`{c}`") for c in carry or df.columns]).alias("row"), text_of(text_col).alias("text"))
    schema = got.select("row").schema.add("expected_grade", "double").add("tail_probability", "double")
    return got.mapInArrow(rows, schema)


def select(df: DataFrame, model: bytes, wanted: int = 1, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of df whose probability of the wanted grade or a better one is at least least."""
    kept = grade(df, model, wanted, text_col).where(F.col("tail_probability") >= least)
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in df.columns])
