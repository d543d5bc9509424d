"""From documents to packed training sequences: each stage calls one operator on what the stage before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again
for the next. All stages but the last return rows with the columns of documents. Whole texts are read a few rows at a
time, so that many tasks fit into a small heap.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frostlake.llm import exact_dedup, mixing, near_copies, packing, quality
from frostlake.llm.common import materialise, read_few_rows, table

#: Wanted shares of tokens by language, near those of the corpus; documents are kept or left out, never repeated.
MIX = {"en": 0.60, "fr": 0.15, "de": 0.15, "es": 0.10}
#: Tokens wanted, of those that come in.
BUDGET = 0.95

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def stage(work: Stage) -> Stage:
    @wraps(work)
    def bounded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read_few_rows(spark)
        return work(spark, docs, sf_dir)

    return bounded


@stage
def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are as likely as not of good quality, by a model fitted on the rated ones."""
    return quality.select(docs, quality.fitted(docs, table(spark, sf_dir, "labels")))


@stage
def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest identifier."""
    return exact_dedup.distinct_rows(docs)


@stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that SimHash proposes and five-word shingles of similarity 0.8 or more link, one row: that with the
    smallest identifier, null counting as the largest, and of its rows one."""
    return near_copies.drop(docs)


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents at the rates that bring the languages' expected tokens to their targets."""
    whole, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    labelled = whole.select("doc_id", F.col("lang").alias("domain")).join(labels.select("doc_id"), "doc_id", "left_semi")
    model = mixing.classifier(whole, labelled, list(MIX))
    return mixing.mix(docs, mixing.rates(mixing.posteriors(docs, model), list(MIX.values()), BUDGET, most=1.0))


@stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens."""
    return packing.pack(docs, packing.vocabulary())


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", select_quality),
    ("exact dedup", drop_exact_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The classifiers and the packing are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over all documents, each written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for _, work in STAGES[:-1]:
        docs = materialise(work(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
