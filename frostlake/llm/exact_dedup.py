"""Exact duplicates by content sort.

Texts are equal when identical after each run of blanks is replaced by one space. Rows are dealt by
sampled splitters over (first bytes, hash, identifier) of the normalised text, each part is sorted
externally by the whole text, and neighbours are compared in full. The splitters reach down to the
identifier, so a text held by a third of all rows is spread over as many parts as its rows need, and the number
of parts follows the size of the table. A part is read through a batch at a time: a run of equal texts
that ends in its batch is told at once, what of longer ones is known at their end is joined to their rows;
the first and last run of each part, which may go on in the next one, are joined by their whole text
first (at most two rows a part).

Defined cases: null texts count as empty and are equal to each other; rows that repeat an identifier
are rows of their own, and of equal rows with the smallest identifier one is kept; a null identifier
comes before all others; an empty table gives no rows; further columns are left alone, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from frostlake.llm.common import BLANKS, materialise, parts_for, text_of

#: Code points of the normalised text that go into the splitters.
SPLITTER_PREFIX = 24


def _sorted_parts(df: DataFrame, id_col: str, text_col: str, rest: list[str]) -> DataFrame:
    """Rows (id, norm, rest as a struct) in parts whose ranges of content don't overlap."""
    norm = F.regexp_replace(text_of(text_col), BLANKS, " ")
    rows = df.select(F.col(id_col).alias("id"), norm.alias("norm"), *([F.struct(*[F.col(f"`{c}`") for c in rest]).alias("rest")] if rest else []))
    order = [F.substring("norm", 1, SPLITTER_PREFIX), F.xxhash64("norm"), F.col("id")]
    parts = rows.repartitionByRange(parts_for(df), *order)
    return parts.sortWithinPartitions(*order[:2], "norm", "id")


#: A row: its run's first identifier and rows, n null where that is not known yet; or, with id and sha null and whole set, a
#: run whose rows had none, with its text if it may go on in another part.
_RUNS = pa.schema([("id", pa.int64()), ("sha", pa.string()), ("head", pa.int64()), ("n", pa.int64()), ("first", pa.bool_()), ("run", pa.int64()), ("part", pa.int64()), ("whole", pa.bool_()), ("edge", pa.string())])


def _starts(norm: pa.Array, before: pa.Scalar | None) -> np.ndarray:
    """Whether each row's text differs from the text of the row before it; whole texts are compared."""
    n = len(norm)
    starts = np.ones(n, bool)
    if n > 1:
        starts[1:] = pc.not_equal(norm.slice(1), norm.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    starts[0] = before is None or norm[0] != before
    return starts


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sorted rows with their runs. Holds one batch, and the text of the run that is open."""
    part = TaskContext.get().partitionId()
    run, head, n, text = -1, None, 0, None  # the open run
    none = pa.scalar(None, pa.int64())
    fixed = lambda value, count, kind: pa.array([value] * count, kind)

    def told(edge: str | None) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"head": head, "n": n, "run": run, "part": part, "whole": True, "edge": edge}], schema=_RUNS)

    for batch in batches:
        size = batch.num_rows
        if not size:
            continue
        norm, ids = batch.column("norm"), batch.column("id")
        new = _starts(norm, text)
        of = run + np.cumsum(new)
        at = np.flatnonzero(new)
        counts = np.diff(np.append(at, size))
        if run >= 0:
            n += int(at[0]) if len(at) else size
            if len(at):
                yield told(text.as_py() if run == 0 else None)
        heads = ids.take(pa.array(at)) if len(at) else ids.slice(0, 0)
        # Runs that begin and end here, apart from the part's first, are known.
        known = np.zeros(size, bool)
        if len(at) > 1:
            known[at[0] : at[-1]] = of[at[0] : at[-1]] > 0
        place = np.cumsum(new) - 1
        total = np.where(known, counts[np.maximum(place, 0)] if len(at) else 0, 0)
        if len(at) and run < 0 and len(at) > 1:
            run, head, n = 0, heads[0].as_py(), int(counts[0])
            yield told(norm[0].as_py())
        row_head = heads.take(pa.array(np.maximum(place, 0))) if len(at) else pa.nulls(size, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [ids, batch.column("sha"), pc.if_else(pa.array(known), row_head, none), pc.if_else(pa.array(known), pa.array(total.astype(np.int64)), none), pa.array(new), pa.array(of.astype(np.int64)), fixed(part, size, pa.int64()), fixed(False, size, pa.bool_()), pa.nulls(size, pa.string())],
            schema=_RUNS,
        )
        if len(at):
            run, head, n = int(of[-1]), heads[len(at) - 1].as_py(), int(counts[-1])
        text = norm[size - 1]
    if run >= 0:
        yield told(text.as_py())


def _firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of each run, with at_edge set for the first and last run of the part."""
    last, held, opening = None, None, True
    for batch in batches:
        if not batch.num_rows:
            continue
        norm = batch.column("norm")
        new = batch.filter(pa.array(_starts(norm, last)))
        last = norm[batch.num_rows - 1]
        if not new.num_rows:
            continue
        if held is not None:
            yield held.append_column("at_edge", pa.array([opening]))
            opening = False
        if new.num_rows > 1:
            done = new.slice(0, new.num_rows - 1)
            yield done.append_column("at_edge", pa.array([opening and i == 0 for i in range(done.num_rows)]))
            opening = False
        held = new.slice(new.num_rows - 1)
    if held is not None:
        yield held.append_column("at_edge", pa.array([True]))


def mark(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) for every row of df."""
    parts = _sorted_parts(df, id_col, text_col, [])
    rows = parts.select("id", F.sha2(F.encode("norm", "UTF-8"), 256).alias("sha"), "norm")
    runs = materialise(rows.mapInArrow(_runs, "id long, sha string, head long, n long, first boolean, run long, part long, whole boolean, edge string"))
    # At most two runs a part go on elsewhere; they are joined where their whole texts are equal.
    edges = runs.where("whole and edge is not null").select("part", "run", "edge", "head", "n")
    groups = edges.groupBy("edge").agg(F.min_by(F.struct("head", "part"), F.struct(F.col("head").isNotNull(), "head", "part")).alias("won"), F.sum("n").alias("total"))
    known = edges.join(groups, "edge").select("part", "run", F.col("won.head").alias("keep"), F.col("won.part").alias("keep_part"), "total")
    known = known.unionByName(runs.where("whole and edge is null").select("part", "run", F.col("head").alias("keep"), F.col("part").alias("keep_part"), F.col("n").alias("total")))
    inner = runs.where("not whole and n is not null").select("id", F.col("head").alias("keep"), F.col("n").alias("total"), "first", "sha")
    outer = runs.where("not whole and n is null").select("id", "sha", "first", "part", "run").join(known, ["part", "run"])
    outer = outer.select("id", "keep", "total", (F.col("first") & (F.col("part") == F.col("keep_part"))).alias("first"), "sha")
    return inner.unionByName(outer).select(F.col("id").alias(id_col), F.col("keep").alias("keep_id"), F.col("total").alias("group_size"), F.col("first").alias("kept"), F.col("sha").alias("text_sha256"))


def distinct_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that stay, with all their columns."""
    parts = _sorted_parts(df, id_col, text_col, df.columns)
    schema = StructType([*parts.schema.fields, StructField("at_edge", BooleanType())])
    firsts = parts.mapInArrow(_firsts, schema)
    rest = [F.col(f"rest.`{c}`").alias(c) for c in df.columns]
    inner = firsts.where(~F.col("at_edge")).select(*rest)
    outer = firsts.where("at_edge").groupBy("norm").agg(F.min_by("rest", F.struct(F.col("id").isNotNull(), "id")).alias("rest")).select(*rest)
    return inner.unionByName(outer)
