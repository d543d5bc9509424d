"""Fitting a model on a bounded sample of labelled rows, in one task on an executor."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frostlake.llm.common import text_of


def labelled_sample(df: DataFrame, labels: DataFrame, label: str, most: int, id_col: str, text_col: str, learn: Column | None = None) -> DataFrame:
    """(key, label, text) of at most so many labelled rows: those whose identifiers have the smallest hashes.
    Null labels and identifiers are none; of several labels of one identifier the largest counts, and of its rows the
    one with the first text in order, which each task finds among its own before they meet."""
    wanted = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("int").alias("label")).where("id is not null and label is not null")
    if learn is not None:
        wanted = wanted.where(learn)
    wanted = wanted.groupBy("id").agg(F.max("label").alias("label")).select("id", "label", F.xxhash64(F.col("id"), F.lit(11)).alias("key")).orderBy("key", "id").limit(most)
    rows = df.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    return rows.join(F.broadcast(wanted), "id").groupBy("id", "key", "label").agg(F.min("text").alias("text")).select("key", "label", "text")


def fit(sample: DataFrame, train: Callable[[pa.Array, pa.Array], bytes]) -> bytes:
    """train(texts, labels) over the whole sample, in an order that repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        texts = pa.chunked_array([b.column("text") for b in got], pa.string()).combine_chunks() if got else pa.array([], pa.string())
        labels = pa.chunked_array([b.column("label") for b in got], pa.int32()).combine_chunks() if got else pa.array([], pa.int32())
        texts, labels = (x.chunk(0) if isinstance(x, pa.ChunkedArray) and x.num_chunks else x for x in (texts, labels))
        yield pa.RecordBatch.from_arrays([pa.array([train(texts, labels)], pa.binary())], names=["model"])

    model = sample.repartition(1).sortWithinPartitions("key", "text").mapInArrow(run, "model binary").first()
    return bytes(model.model) if model else train(pa.array([], pa.string()), pa.array([], pa.int32()))
