"""Sharded tables by size-tiered compaction, with built-in DataFrame operations only.

An arrival is written as a small immutable run of files. Runs are put in tiers by the size of their files; when a
tier holds ``fanout`` runs they are merged into one run of target-sized files, without a shuffle. A manifest lists
the runs of a version. A version is committed by renaming a finished file to the next number, which fails if another
writer took it; the loser reads the new version and tries again. So readers see whole versions only, and a lost job
leaves the last one in place. Merged runs keep their files while a kept version names them: ``vacuum`` deletes what
none does. The rename must be atomic, as in HDFS and local folders; a store without that needs a committer of its own.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import asdict, dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

FANOUT = 4
BASE_BYTES = 1 << 20
TARGET_BYTES = 128 << 20
ARRIVALS = 24
TRIES = 20


@dataclass(frozen=True)
class Run:
    path: str
    rows: int
    bytes: int

    @property
    def tier(self) -> int:
        return max(0, int(math.log(max(self.bytes, 1) / BASE_BYTES, FANOUT)) + 1) if self.bytes >= BASE_BYTES else 0


class Store:
    """A table under ``root``; sizes are those of the written files."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _manifest(self, version: int) -> str:
        return f"{self.root}/_manifests/v{version:010d}.json"

    def version(self) -> int:
        """The last committed version; 0 if there is none."""
        folder = self._path(f"{self.root}/_manifests")
        if not self._fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return max([int(n[1:11]) for n in names if n.startswith("v") and n.endswith(".json")], default=0)

    def runs(self, version: int | None = None) -> list[Run]:
        version = self.version() if version is None else version
        if not version:
            return []
        stream = self._fs.open(self._path(self._manifest(version)))
        try:
            return [Run(**x) for x in json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["runs"]]
        finally:
            stream.close()

    def commit(self, runs: list[Run], after: int) -> int:
        """Make ``runs`` the version that follows ``after``; raises if another writer has made that version."""
        jvm = self.spark._jvm
        draft = self._path(f"{self.root}/_manifests/.draft-{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps({"version": after + 1, "runs": [asdict(r) for r in runs]}).encode()))
        out.close()
        target = self._path(self._manifest(after + 1))
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.makeQualified(target).toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context.rename(self._fs.makeQualified(draft), self._fs.makeQualified(target), options)
        return after + 1

    def _changed(self, change) -> int:
        """Commit ``change(runs)`` after the last version; if another writer was faster, after that one's. None: nothing to commit."""
        for _ in range(TRIES):
            before = self.version()
            runs = change(self.runs(before))
            if runs is None:
                return before
            try:
                return self.commit(runs, before)
            except Py4JJavaError:
                if self.version() == before:
                    raise
        raise RuntimeError("other writers were always faster")

    def _bytes(self, folder: str) -> int:
        return self._fs.getContentSummary(self._path(folder)).getLength()

    def append(self, df: DataFrame, arrival: F.Column | None = None) -> int:
        """Write ``df`` as one run, or as one run for each value of ``arrival`` (bounded: each is a manifest entry)."""
        folder = f"{self.root}/runs/{uuid.uuid4().hex}"
        if arrival is None:
            df.write.parquet(folder)
            found = {folder: self.spark.read.schema(df.schema).parquet(folder).count()}
        else:
            name = "arrival"
            while name in df.columns:
                name += "_"
            df.withColumn(name, arrival.cast("int")).write.partitionBy(name).parquet(folder)
            counts = self.spark.read.schema(df.withColumn(name, arrival.cast("int")).schema).parquet(folder).groupBy(name).count().orderBy(name).collect()
            found = {f"{folder}/{name}={r[0]}": r[1] for r in counts}
        added = [Run(path, n, self._bytes(path)) for path, n in found.items() if n]
        return self._changed(lambda runs: runs + added)

    def compact(self, schema, fanout: int = FANOUT, target_bytes: int = TARGET_BYTES) -> int:
        """Merge tiers until each holds fewer than ``fanout`` runs; returns the version. A merge whose runs another writer merged meanwhile is dropped."""
        while True:
            runs = self.runs()
            full = [t for t in sorted({r.tier for r in runs}) if sum(r.tier == t for r in runs) >= fanout]
            if not full:
                return self.version()
            old = {r.path: r for r in runs if r.tier == full[0]}
            folder = f"{self.root}/runs/{uuid.uuid4().hex}"
            merged = self.spark.read.schema(schema).parquet(*old)
            merged.coalesce(max(1, math.ceil(sum(r.bytes for r in old.values()) / target_bytes))).write.parquet(folder)
            new = Run(folder, sum(r.rows for r in old.values()), self._bytes(folder))

            def swapped(now: list[Run]) -> list[Run] | None:
                if not set(old) <= {r.path for r in now}:
                    return None
                return [r for r in now if r.path not in old] + [new]

            self._changed(swapped)

    def vacuum(self, keep_versions: int = 1) -> int:
        """Delete manifests but the last ``keep_versions`` and the files of runs that none of those names; returns the runs deleted.

        Runs that are being written are named by no manifest yet: call it when no writer is at work.
        """
        last = self.version()
        kept = range(max(1, last - keep_versions + 1), last + 1)
        named = {r.path for v in kept for r in self.runs(v)}
        gone = 0
        for top in self._fs.listStatus(self._path(f"{self.root}/runs")) if self._fs.exists(self._path(f"{self.root}/runs")) else ():
            path = top.getPath()
            mine = {p for p in named if f"{p}/".startswith(f"{self.root}/runs/{path.getName()}/")}
            for child in [path] if not mine else [c.getPath() for c in self._fs.listStatus(path) if c.isDirectory()]:
                if child.getName() not in {p.rsplit("/", 1)[-1] for p in mine}:
                    self._fs.delete(child, True)
                    gone += 1
        for status in self._fs.listStatus(self._path(f"{self.root}/_manifests")):
            name = status.getPath().getName()
            if name.startswith("v") and int(name[1:11]) not in kept:
                self._fs.delete(status.getPath(), False)
        return gone

    def read(self, schema, version: int | None = None) -> DataFrame:
        runs = self.runs(version)
        if not runs:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[r.path for r in runs])


def compacted(docs: DataFrame, root: str, arrival: F.Column | None = None, fanout: int = FANOUT, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """``docs`` appended to the store at ``root``, compacted, and read back through its manifest.

    Rows are kept as they are: nulls, repeated rows, empty and long texts. An empty table commits a version
    without runs and reads back empty. Columns may have any names.
    """
    store = Store(docs.sparkSession, root)
    store.append(docs, arrival)
    store.compact(docs.schema, fanout, target_bytes)
    return store.read(docs.schema)


def op3_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrival = F.pmod(F.coalesce(F.xxhash64("doc_id"), F.lit(0)), F.lit(ARRIVALS))
    table = compacted(common.documents(spark, sf_dir), common.fresh_path(spark, "store"), arrival)
    text = common.text_or_empty()
    return table.select("doc_id", "lang", "source", "n_chars", F.octet_length(text).cast("bigint").alias("n_bytes"), F.sha2(text, 256).alias("text_sha256"))


OP3_SQL = """
SELECT doc_id, lang, source, n_chars, strlen(coalesce(text, ''))::BIGINT AS n_bytes, sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
