"""Keyed tables that streams keep up to date: a snapshot, the batches since, and a manifest that names both.

A batch is written as a delta; after ``merge_every`` of them snapshot and deltas become a new snapshot. Either
way the new state is one manifest, made visible by a rename that fails if the name is taken, so readers see whole batches only and two
writers cannot both win. A batch that is replayed finds its number in the manifest and changes nothing. Files that neither the last
two manifests name are deleted, so their number stays bounded while batches keep coming.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

MERGE_EVERY = 8


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    batch: int = -1
    snapshot: str | None = None
    deltas: tuple[tuple[int, str], ...] = field(default=())

    @property
    def folders(self) -> set[str]:
        return {f for f in (self.snapshot, *[d[1] for d in self.deltas]) if f}


class KeyedTable:
    """Rows of ``schema`` under ``root``, one for each ``keys``; of two rows of a key the later batch's counts, within a batch the greater ``order``."""

    def __init__(self, spark: SparkSession, root: str, schema: StructType, keys: tuple[str, ...], order: str | None = None, merge_every: int = MERGE_EVERY):
        self.spark, self.root, self.schema, self.keys, self.order, self.merge_every = spark, root.rstrip("/"), schema, keys, order, merge_every
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self.values = [f.name for f in schema if f.name not in keys]

    # ------------------------------------------------ manifests

    def _put(self, name: str, body: str) -> bool:
        """Create ``name`` with ``body`` at once; False if it is there already."""
        jvm = self.spark._jvm
        draft, target = (self._fs.makeQualified(self._path(f"{self.root}/{n}")) for n in (f"_drafts/{uuid.uuid4().hex}", name))
        out = self._fs.create(draft, False)
        out.write(bytearray(body.encode()))
        out.close()
        self._fs.mkdirs(target.getParent())
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(draft, target, self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
            return True
        except Exception:
            self._fs.delete(draft, False)
            if self._fs.exists(target):
                return False
            raise

    def _get(self, name: str) -> str:
        stream = self._fs.open(self._path(f"{self.root}/{name}"))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _versions(self) -> list[int]:
        folder = self._path(f"{self.root}/_manifests")
        return sorted(int(s.getPath().getName()[:-5]) for s in self._fs.listStatus(folder)) if self._fs.exists(folder) else []

    def manifest(self, version: int | None = None) -> Manifest:
        """That of ``version``, else the last."""
        version = max(self._versions(), default=0) if version is None else version
        if not version:
            return Manifest()
        found = json.loads(self._get(f"_manifests/{version:010d}.json"))
        return Manifest(**found | {"deltas": tuple((b, f) for b, f in found["deltas"])})

    # ------------------------------------------------ rows

    def _latest(self, rows: DataFrame, by) -> DataFrame:
        return rows.groupBy(*self.keys).agg(F.max_by(F.struct(*self.values), by).alias("_r")).select(*self.keys, "_r.*").select(*self.schema.names)

    def read(self, version: int | None = None) -> DataFrame:
        """The table's rows at ``version``; empty before the first."""
        found = self.manifest(version)
        parts = ([(-1, found.snapshot)] if found.snapshot else []) + list(found.deltas)
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        rows = [self.spark.read.schema(self.schema).parquet(f"{self.root}/{folder}").withColumn("_b", F.lit(b)) for b, folder in parts]
        if len(rows) == 1:
            return rows[0].drop("_b")  # a snapshot or a delta has each key once
        whole = rows[0]
        for part in rows[1:]:
            whole = whole.unionByName(part)
        return self._latest(whole, "_b")

    def apply(self, batch: DataFrame, number: int) -> bool:
        """Upsert ``batch``; False if batch ``number`` is in the table already."""
        before = self.manifest()
        if number <= before.batch:
            return False
        folder = f"delta-{number}-{uuid.uuid4().hex}"
        place = F.struct(*([self.order] if self.order else []), *[c for c in self.values if c != self.order])
        self._latest(batch, place).write.parquet(f"{self.root}/{folder}")
        after = Manifest(before.version + 1, number, before.snapshot, (*before.deltas, (number, folder)))
        if not self._put(f"_manifests/{after.version:010d}.json", json.dumps(asdict(after))):
            raise RuntimeError(f"another writer changed {self.root}")
        if len(after.deltas) >= self.merge_every:
            self._merge(after)
        self._clean()
        return True

    def _merge(self, before: Manifest) -> None:
        folder = f"snapshot-{before.batch}-{uuid.uuid4().hex}"
        self.read(before.version).write.parquet(f"{self.root}/{folder}")
        after = Manifest(before.version + 1, before.batch, folder)
        if not self._put(f"_manifests/{after.version:010d}.json", json.dumps(asdict(after))):
            raise RuntimeError(f"another writer changed {self.root}")

    def _clean(self) -> None:
        versions = self._versions()
        named = set().union(*[self.manifest(v).folders for v in versions[-2:]])
        for status in self._fs.listStatus(self._path(self.root)):
            name = status.getPath().getName()
            if name.startswith(("delta-", "snapshot-")) and name not in named:
                self._fs.delete(status.getPath(), True)
        for v in versions[:-2]:
            self._fs.delete(self._path(f"{self.root}/_manifests/{v:010d}.json"), False)

    def pinned(self, batch: int, reader: str) -> int:
        """The version that ``reader`` uses for its ``batch``: the last one when it first asked, the same when the batch is replayed."""
        name = f"_pins/{reader}-{batch}"
        self._put(name, str(self.manifest().version))
        return int(self._get(name))


def keep(stream: DataFrame, table: KeyedTable, checkpoint: str) -> StreamingQuery:
    """Run ``stream`` to its present end and upsert its rows into ``table``, batch by batch."""
    return stream.writeStream.foreachBatch(lambda batch, number: table.apply(batch, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keep_enriched(stream: DataFrame, dimension: KeyedTable, on: str, table: KeyedTable, checkpoint: str, reader: str = "stream") -> StreamingQuery:
    """``stream`` joined with ``dimension`` as it stands when a batch begins, upserted into ``table``.

    The version is pinned for each batch: a change of the dimension shows from the next batch on, also if this one is replayed.
    """

    def write(batch: DataFrame, number: int) -> None:
        now = dimension.read(dimension.pinned(number, reader))
        table.apply(batch.join(now, on, "left").select(*table.schema.names), number)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
