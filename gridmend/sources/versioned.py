"""Tables whose versions are committed one by one, also by several writers and by replayed micro-batches.

A version is a small record file, and the record of version n can be created once only: of two writers that both prepared
version n + 1, one wins and the other starts over from the new state. A version adds one folder of changed rows; every
sixteenth folds all of them into a snapshot, so readers merge a bounded number of folders and writers never rewrite the
table for a few rows. Records also carry, per stream, the last micro-batch they hold, so a batch that is replayed after a
crash finds itself done.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmend.functions.distributed import latest_by

FOLD_EVERY = 16


class Conflict(Exception):
    """Another writer committed first, more often than was to be retried."""


class VersionedTable:
    """Rows by ``keys``; of several with one key the last by ``order`` counts, and among equals the last committed.

    Without keys the table only grows: versions are added up, and a snapshot names the folders so far instead of
    rewriting them. ``partition_by`` names columns by which folders are cut, for readers that want a part.
    """

    def __init__(self, spark: SparkSession, root: str, keys: list[str], order: list[str], partition_by: list[str] | None = None):
        self.spark, self.root, self.keys, self.order = spark, root.rstrip("/"), list(keys), list(order)
        self.partition_by = list(partition_by or [])
        self._fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._fs_path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    @classmethod
    def opened(cls, spark: SparkSession, root: str) -> VersionedTable:
        """A table that exists, with the keys and the order that its last version names."""
        found = cls(spark, root, [], [])
        record = found.record(found.version())
        return cls(spark, root, record["keys"], record["order"], record["partition_by"])

    def _record_path(self, version: int):
        return self._fs_path(f"{self.root}/_commits/{version:012d}.json")

    def version(self) -> int | None:
        """Number of the last version; records are named by it."""
        folder = self._fs_path(f"{self.root}/_commits")
        if not self._fs.exists(folder):
            return None
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)]
        return max((int(n[:12]) for n in names if n.endswith(".json")), default=None)

    def record(self, version: int) -> dict:
        stream = self._fs.open(self._record_path(version))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _create(self, version: int, record: dict) -> bool:
        """Write the record aside and move it into place, which fails if the place is taken."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        aside, place = self._fs_path(f"{self.root}/_commits/.{uuid.uuid4().hex}"), self._record_path(version)
        out = self._fs.create(aside, False)
        out.write(bytearray(json.dumps(record).encode()))
        out.close()
        files = hadoop.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        no_overwrite = self.spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0)
        try:
            files.rename(aside, place, no_overwrite)
            return True
        except Exception:
            taken = self._fs.exists(place)
            self._fs.delete(aside, False)
            if taken:
                return False
            raise

    def read(self, version: int | None = None) -> DataFrame | None:
        """The table as of a version (the last by default); None before the first."""
        at = self.version() if version is None else version
        if at is None:
            return None
        folders: list[tuple[int, str, str]] = []
        while True:
            record = self.record(at)
            folders.append((at, record["folder"], record["schema"]))
            if record["snapshot"]:
                folders += [(-1, f, record["schema"]) for f in record["base"]]
                break
            at -= 1
        # the schema is given: a version may have added no row
        parts = [self.spark.read.schema(kind).parquet(f"{self.root}/{name}").withColumn("__v", F.lit(v)) for v, name, kind in folders]
        rows = parts[-1]
        for p in reversed(parts[:-1]):
            rows = rows.unionByName(p, allowMissingColumns=True)
        return (latest_by(rows, self.keys, [*self.order, "__v"]) if self.keys and len(parts) > 1 else rows).drop("__v")

    def _folders(self, at: int | None) -> list[str]:
        out: list[str] = []
        while at is not None and at >= 0:
            record = self.record(at)
            out.append(record["folder"])
            if record["snapshot"]:
                return record["base"] + out[::-1]
            at -= 1
        return out

    def done(self, stream: str) -> int:
        """The last micro-batch of a stream that the table holds, -1 before the first."""
        at = self.version()
        return -1 if at is None else self.record(at)["streams"].get(stream, -1)

    def commit(self, build: Callable[[DataFrame | None], DataFrame], stream: str | None = None, batch: int | None = None, retries: int = 20) -> int | None:
        """Add what ``build`` makes of the current table as the next version; its number, or None for a batch already held.

        If another writer takes the number meanwhile, the rows are built again from the table that it left.
        """
        for _ in range(retries + 1):
            at = self.version()
            before = {"streams": {}} if at is None else self.record(at)
            if stream is not None and before["streams"].get(stream, -1) >= batch:
                return None
            current = None if at is None else self.read(at)
            rows = build(current)
            nxt = 0 if at is None else at + 1
            snapshot = nxt % FOLD_EVERY == 0
            base = self._folders(at) if snapshot and not self.keys else []
            if snapshot and self.keys:
                both = rows.withColumn("__v", F.lit(1))
                if current is not None:
                    both = current.withColumn("__v", F.lit(0)).unionByName(both, allowMissingColumns=True)
                rows = latest_by(both, self.keys, [*self.order, "__v"]).drop("__v")
            folder, kind = f"data-{uuid.uuid4().hex}", ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
            (rows.write.partitionBy(*self.partition_by) if self.partition_by else rows.write).parquet(f"{self.root}/{folder}")
            streams = before["streams"] | ({} if stream is None else {stream: batch})
            if self._create(nxt, {"folder": folder, "snapshot": snapshot, "base": base, "schema": kind, "streams": streams, "keys": self.keys, "order": self.order, "partition_by": self.partition_by}):
                return nxt
            self._fs.delete(self._fs_path(f"{self.root}/{folder}"), True)  # this writer's own folder, named by no record
        raise Conflict(self.root)

    def upsert(self, updates: DataFrame) -> int:
        """Insert or replace rows. The updates do not depend on what the table holds."""
        return self.commit(lambda current: updates)
