"""Versioned tables over Parquet with a commit log: appends, upserts, time travel, compaction, expiry, evolution.

A version is a JSON file in _log that lists the data files by partition, so that no reader sees half a write and no
commit rewrites files that a reader may hold. Upserts rewrite only the partitions that the new rows touch. A
commit may carry a (writer, batch) mark: a batch that is replayed changes nothing. Of several writers that commit
at once one wins a version, by a rename that fails where the file is there; the others start again from it.

Files are written below _tmp and get to data by one rename. Those of a marked append get to data/writer/batch, which
so holds whole batches only and each once: a stream may read it. What upserts and compaction write goes elsewhere.

The log goes through Hadoop's file systems, so any store that Spark reads will do.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_json_string

from frostlake.sources.schemas import TABLES, Table

WEEK_MS = 7 * 24 * 3600 * 1000
#: Files under this size are put together by optimize.
SMALL_BYTES = 128 << 20
#: Attempts of a commit that other writers keep getting ahead of.
ATTEMPTS = 20
#: Local file systems look before they rename, in two steps; writers of one process take turns at it.
_turns: dict[str, threading.Lock] = defaultdict(threading.Lock)


class Conflict(Exception):
    """Another writer has made the version."""


def _below(place: str, path: str) -> str:
    """What follows place in a path, whether or not it is escaped as part of an address."""
    return unquote(unquote(path.rsplit(place + "/", 1)[1]))


class Store:
    """Text files and listings in whatever file system the path names."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark.sparkContext._jvm
        self.root = root.rstrip("/")
        self.fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.no_options = spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)

    def _path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, path: str) -> bool:
        return self.fs.exists(self._path(f"{self.root}/{path}"))

    def names(self, path: str) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self._path(f"{self.root}/{path}"))] if self.exists(path) else []

    def files(self, path: str) -> list[tuple[str, int, int]]:
        """(path below the root, bytes, time of change) of the data files below path."""
        out: list[tuple[str, int, int]] = []
        if self.exists(path):
            found = self.fs.listFiles(self._path(f"{self.root}/{path}"), True)
            base = self.fs.makeQualified(self._path(self.root)).toString().rstrip("/") + "/"
            while found.hasNext():
                s = found.next()
                if s.getPath().getName().endswith(".parquet"):
                    out.append((s.getPath().toString()[len(base) :], s.getLen(), s.getModificationTime()))
        return out

    def read(self, path: str) -> str:
        stream = self.fs.open(self._path(f"{self.root}/{path}"))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_once(self, path: str, text: str) -> None:
        """A whole file at once; Conflict if it is there: of two commits of one version one is refused."""
        temporary = f"_tmp/{uuid.uuid4().hex}"
        stream = self.fs.create(self._path(f"{self.root}/{temporary}"), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        self.fs.mkdirs(self._path(f"{self.root}/{path}").getParent())
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.fs.getConf())
        with _turns[self.root]:
            try:
                context.rename(self._path(f"{self.root}/{temporary}"), self._path(f"{self.root}/{path}"), self.no_options)
            except Py4JJavaError as e:
                self.delete(temporary)
                if "FileAlreadyExists" in str(e.java_exception.getClass().getName()):
                    raise Conflict(path) from e
                raise

    def publish(self, folder: str, place: str) -> None:
        """Moves a folder to where its files count, unless that has been done."""
        with _turns[self.root]:
            if self.exists(place):
                self.delete(folder)
                return
            self.fs.mkdirs(self._path(f"{self.root}/{place}").getParent())
            self.fs.rename(self._path(f"{self.root}/{folder}"), self._path(f"{self.root}/{place}"))

    def make(self, path: str) -> str:
        self.fs.mkdirs(self._path(f"{self.root}/{path}"))
        return f"{self.root}/{path}"

    def delete(self, path: str) -> None:
        self.fs.delete(self._path(f"{self.root}/{path}"), True)


@dataclass(frozen=True)
class Snapshot:
    version: int
    parent: int | None
    committed_at: int
    operation: str
    summary: dict
    #: Per file: path, bytes, and the values of the partition columns that were in force when it was written.
    files: tuple[dict, ...]
    schema: str
    partition: tuple[str, ...]
    marks: dict[str, int]


class LakeTable:
    def __init__(self, spark: SparkSession, root: str, table: Table):
        self.spark, self.table = spark, table
        self.root = f"{root.rstrip('/')}/{table.name.replace('.', '/')}"
        self.store = Store(spark, self.root)

    # Log ----------------------------------------------------------------------------------------------------------

    def versions(self) -> list[int]:
        return sorted(int(n.split(".")[0]) for n in self.store.names("_log") if n.endswith(".json"))

    def snapshot(self, version: int | None = None) -> Snapshot | None:
        have = self.versions()
        if version is None:
            if not have:
                return None
            version = have[-1]
        elif version not in have:
            raise ValueError(f"{self.table.name} has no version {version}")
        d = json.loads(self.store.read(f"_log/{version:020d}.json"))
        return Snapshot(**{**d, "files": tuple(d["files"]), "partition": tuple(d["partition"])})

    def _commit(self, operation: str, files: list[dict], summary: dict, before: Snapshot | None, schema: StructType | None = None, partition: tuple[str, ...] | None = None, mark: tuple[str, int] | None = None) -> Snapshot:
        marks = dict(before.marks) if before else {}
        if mark:
            marks[mark[0]] = mark[1]
        new = Snapshot(
            before.version + 1 if before else 0, before.version if before else None, int(time.time() * 1000), operation, summary, tuple(files),
            schema.json() if schema else before.schema if before else self.table.schema.json(),
            partition if partition is not None else before.partition if before else self.table.partition, marks,
        )
        self.store.write_once(f"_log/{new.version:020d}.json", json.dumps(new.__dict__))
        return new

    def _until_done(self, attempt: Callable[[Snapshot], Snapshot]) -> Snapshot:
        """attempt on the newest version, again from the one that another writer has made meanwhile."""
        for _ in range(ATTEMPTS):
            try:
                return attempt(self.create().snapshot())
            except Conflict:
                continue
        raise Conflict(f"{self.table.name}: other writers were ahead {ATTEMPTS} times")

    def create(self) -> LakeTable:
        """Makes the table if it isn't there."""
        if self.snapshot() is None:
            try:
                self._commit("create", [], {}, None)
            except Conflict:
                pass  # it is there now
        return self

    def schema(self, version: int | None = None) -> StructType:
        now = self.snapshot(version)
        return _parse_datatype_json_string(now.schema) if now else self.table.schema

    # Reading ------------------------------------------------------------------------------------------------------

    def _read(self, files: list[dict], schema: StructType) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{f['path']}" for f in files])

    def read(self, version: int | None = None, where: dict | None = None) -> DataFrame:
        """The rows of a version, by default the newest. where keeps files by their partition values."""
        now = self.snapshot(version)
        files = list(now.files) if now else []
        for column, value in (where or {}).items():
            files = [f for f in files if f["values"].get(column, str(value)) == str(value)]
        return self._read(files, self.schema(version))

    def snapshots(self) -> DataFrame:
        rows = [(s.version, s.parent, s.committed_at, s.operation, {k: str(v) for k, v in s.summary.items()}) for s in map(self.snapshot, self.versions())]
        return self.spark.createDataFrame(rows, "snapshot_id bigint, parent_id bigint, committed_ms bigint, operation string, summary map<string, string>")

    def partitions(self) -> DataFrame:
        """(partition, record_count, file_count) of the newest version."""
        now = self.snapshot()
        files = list(now.files) if now else []
        by: dict[str, list[int]] = {}
        for f in files:
            own = by.setdefault(json.dumps(f["values"], sort_keys=True), [0, 0])
            own[0] += f["rows"]
            own[1] += 1
        return self.spark.createDataFrame([(k, *v) for k, v in by.items()], "partition string, record_count bigint, file_count bigint")

    # Writing ------------------------------------------------------------------------------------------------------

    def _write(self, rows: DataFrame, schema: StructType, partition: tuple[str, ...], place: str | None = None) -> list[dict]:
        """New data files of rows, which no version lists yet. Partition columns stay in the files. Rows are dealt by
        partition; Spark splits a partition that is too large for a task over several, and puts small ones together."""
        place = place or f"data/rows/{uuid.uuid4().hex}"
        if not self.store.exists(place):
            shaped = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])
            keys = {f"_p{i}": F.expr(p) for i, p in enumerate(partition)}
            dealt = shaped.withColumns(keys).hint("rebalance", *[F.col(k) for k in keys]) if keys else shaped
            temporary = f"_tmp/{uuid.uuid4().hex}"
            dealt.write.option("compression", "zstd").partitionBy(*keys).parquet(f"{self.root}/{temporary}")
            self.store.publish(temporary, place)
        found = self.store.files(place)
        counts: dict[str, int] = {}
        if found:
            path = F.col("_metadata.file_path")
            counted = self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{self.root}/{place}").groupBy(path.alias("p")).count().collect()  # a row for each new file
            counts = {_below(place, r.p): r["count"] for r in counted}
        out = []
        for name, size, _ in found:
            own = dict(part.split("=", 1) for part in name.removeprefix(place + "/").split("/")[:-1])
            out.append({"path": name, "bytes": size, "rows": counts.get(_below(place, name), 0), "values": {partition[int(k[2:])]: unquote(v) for k, v in own.items()}})
        return out

    def _done(self, before: Snapshot | None, mark: tuple[str, int] | None) -> bool:
        return bool(mark and before and before.marks.get(mark[0], -1) >= mark[1])

    def append(self, rows: DataFrame, mark: tuple[str, int] | None = None) -> Snapshot:
        before = self.create().snapshot()
        if self._done(before, mark):
            return before
        new = self._write(rows, self.schema(), before.partition, f"data/{mark[0]}/{mark[1]:020d}" if mark else None)

        def attempt(now: Snapshot) -> Snapshot:
            return now if self._done(now, mark) else self._commit("append", [*now.files, *new], {"added_rows": sum(f["rows"] for f in new)}, now, mark=mark)

        return self._until_done(attempt)

    def tail(self, writer: str) -> str:
        """The folder that a writer's appends get to, a whole batch at once."""
        return self.store.make(f"data/{writer}")

    def upsert(self, rows: DataFrame, order: list | None = None, mark: tuple[str, int] | None = None) -> Snapshot:
        """Rows by key: new ones replace old ones; of several new ones the last by order. Only the files of touched
        partitions are read and replaced."""
        return self._until_done(lambda before: before if self._done(before, mark) else self._upsert(before, rows, order, mark))

    def _upsert(self, before: Snapshot, rows: DataFrame, order: list | None, mark: tuple[str, int] | None) -> Snapshot:
        schema, key = self.schema(), list(self.table.key)
        by = [F.col(c).desc() if isinstance(c, str) else c for c in order or key]
        latest = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*by))).where("_n = 1").drop("_n").persist()
        try:
            touched = list(before.files)
            if before.partition:
                hit = {tuple(None if v is None else str(v) for v in r) for r in latest.select(*[F.expr(p).cast("string") for p in before.partition]).distinct().collect()}  # partitions of one batch
                nothing = "__HIVE_DEFAULT_PARTITION__"
                own = lambda f: tuple(None if f["values"].get(p) == nothing else f["values"].get(p) for p in before.partition)
                # Files of an older partitioning have other values; they may hold any key.
                touched = [f for f in before.files if set(f["values"]) != set(before.partition) or own(f) in hit]
            old = self._read(touched, schema).join(latest.select(*key), key, "left_anti") if touched else None
            merged = latest if old is None else old.unionByName(latest.select(*[c for c in schema.names if c in latest.columns]), allowMissingColumns=True)
            new = self._write(merged, schema, before.partition)
        finally:
            latest.unpersist()
        gone = {f["path"] for f in touched}
        return self._commit("upsert", [*[f for f in before.files if f["path"] not in gone], *new], {"touched_files": len(touched)}, before, mark=mark)

    # Maintenance --------------------------------------------------------------------------------------------------

    def optimize(self, small: int = SMALL_BYTES) -> Snapshot:
        """Small files of each partition put together; the rows stay the same."""
        return self._until_done(lambda before: self._optimized(before, small))

    def _optimized(self, before: Snapshot, small: int) -> Snapshot:
        by: dict[str, list[dict]] = {}
        for f in before.files:
            if f["bytes"] < small:
                by.setdefault(json.dumps(f["values"], sort_keys=True), []).append(f)
        old = [f for group in by.values() if len(group) > 1 for f in group]
        if not old:
            return before
        new = self._write(self._read(old, self.schema()), self.schema(), before.partition)
        gone = {f["path"] for f in old}
        return self._commit("replace", [*[f for f in before.files if f["path"] not in gone], *new], {"replaced_files": len(old), "new_files": len(new)}, before)

    def expire_snapshots(self, older_than_ms: int = WEEK_MS, now_ms: int | None = None) -> list[int]:
        """Versions committed before that are forgotten; the newest never is."""
        limit = (now_ms or int(time.time() * 1000)) - older_than_ms
        gone = [v for v in self.versions()[:-1] if self.snapshot(v).committed_at < limit]
        for v in gone:
            self.store.delete(f"_log/{v:020d}.json")
        return gone

    def remove_orphans(self, older_than_ms: int = WEEK_MS, now_ms: int | None = None) -> list[str]:
        """Data files of no version, and unchanged for that long, are deleted."""
        limit = (now_ms or int(time.time() * 1000)) - older_than_ms
        held = {f["path"] for v in self.versions() for f in self.snapshot(v).files}
        gone = [name for folder in ("data", "_tmp") for name, _, changed in self.store.files(folder) if name not in held and changed < limit]
        for name in gone:
            self.store.delete(name)
        return gone

    def add_column(self, name: str, kind: str) -> Snapshot:
        """Old rows read as null in it."""
        field = StructField(name, self.spark.createDataFrame([], f"x {kind}").schema[0].dataType)

        def attempt(before: Snapshot) -> Snapshot:
            schema = _parse_datatype_json_string(before.schema)
            return before if name in schema.names else self._commit("add column", list(before.files), {"column": name}, before, schema=StructType([*schema.fields, field]))

        return self._until_done(attempt)

    def set_partitioning(self, *expressions: str) -> Snapshot:
        """New files go by these expressions; old ones stay as they are. bucket(n, column) is pmod(hash(column), n)."""
        return self._until_done(lambda before: self._commit("set partitioning", list(before.files), {"partition": ", ".join(expressions)}, before, partition=tuple(expressions)))


class Lake:
    """All tables below one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def __getitem__(self, name: str) -> LakeTable:
        return LakeTable(self.spark, self.root, TABLES[name])

    def create(self) -> Lake:
        for name in TABLES:
            self[name].create()
        return self

    def tables(self) -> DataFrame:
        """(table_schema, table_name) of the tables that exist."""
        rows = [tuple(n.split(".")) for n in TABLES if self[n].versions()]
        return self.spark.createDataFrame(rows, "table_schema string, table_name string").orderBy("table_schema", "table_name")

    def register(self) -> None:
        """Temporary views, named layer_table, over the newest versions."""
        for name in TABLES:
            if self[name].versions():
                self[name].read().createOrReplaceTempView(name.replace(".", "_"))
