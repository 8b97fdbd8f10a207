"""A key-value store on shared storage, with the log as the truth and runs as its compacted form."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.operators import changelog, compaction, reads, runs
from keystrata.sources.shared import SharedFiles

SCHEMA = "store_id bigint, sequence bigint, key binary, value binary, tombstone boolean"
STORE = 1
#: Seconds that a folder or manifest outlives its last use at least; longer than any write or read takes.
KEEP_S = 7 * 86_400.0


class NotFound(KeyError):
    """The key was never written, or was deleted last."""


class Engine:
    """Open, put, get, delete, scan, snapshot, flush and compact.

    State is a list of Parquet folders named by numbered manifests.  A write adds a folder of log records and
    commits by creating the next manifest, so readers see all of a batch or nothing, and opening an engine again is
    reading its last manifest.  One writer at a time can commit; another gets an error and writes nothing.

    Each commit costs a folder.  With ``group`` above 1, changes written one by one are kept here until there are so
    many, or until ``sync``: a change is durable, and seen by readers, from then on.  Sequences are given in the
    order of the writes either way.
    """

    def __init__(self, spark: SparkSession, root: str, group: int = 1):
        self.spark, self.files, self.group = spark, SharedFiles(spark, root), group
        self._waiting: list[tuple[bytes, bytes | None]] = []

    @classmethod
    def open(cls, spark: SparkSession, root: str, *, group: int = 1) -> Engine:
        """Open a store, a new one if the folder has no manifest."""
        return cls(spark, root, group)

    def _manifests(self) -> list[str]:
        return [n for n in self.files.list("manifests") if not n.startswith(".")]

    def _manifest(self) -> dict:
        names = self._manifests()
        if not names:
            return {"number": 0, "log": [], "runs": [], "next_sequence": 1}
        return json.loads(self.files.read(f"manifests/{names[-1]}"))

    def _commit(self, manifest: dict) -> None:
        manifest = manifest | {"number": manifest["number"] + 1}
        name = f"manifests/{manifest['number']:010d}.json"
        if not self.files.create(name, json.dumps(manifest)):
            raise RuntimeError("another writer committed first")
        if self._manifests()[-1] != name.split("/")[1]:
            # the number was free only because its manifest had been cleaned up
            self.files.delete(name)
            raise RuntimeError("other writers committed long ago")

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(*[f"{self.files.root}/{f}" for f in folders])

    @property
    def next_sequence(self) -> int:
        return self._manifest()["next_sequence"]

    def entries(self) -> DataFrame:
        """All versions that log and runs hold."""
        now = self._manifest()
        return self._read(now["log"] + now["runs"])

    def write(self, changes: Iterable[tuple[bytes, bytes | None]]) -> int:
        """Apply changes in order: (key, value), or (key, None) to delete.  Returns the last sequence.

        All of them become durable together, after those that wait.
        """
        changes = [*self._waiting, *changes]
        last = self._write(changes)
        self._waiting = []
        return last

    def sync(self) -> int:
        """Make durable what waits; returns the last sequence."""
        return self.write([])

    def _write(self, changes: list[tuple[bytes, bytes | None]]) -> int:
        now = self._manifest()
        first = now["next_sequence"]
        rows = [(STORE, first + i, k, b"" if v is None else v, v is None) for i, (k, v) in enumerate(changes)]
        if not rows:
            return first - 1
        return self._append(now, self.spark.createDataFrame(rows, SCHEMA).coalesce(1), len(rows))

    def write_frame(self, changes: DataFrame, order: str) -> int:
        """Apply a frame (key, value, and null values to delete) in the order of a unique column.

        The range partitions of the order are numbered one after the other, so no task sees all rows.
        """
        self.sync()
        now = self._manifest()
        numbered = changelog.assign_sequences(changes.select("key", "value", order), order, now["next_sequence"] - 1)
        rows = numbered.select(
            F.lit(STORE).cast("long").alias("store_id"), "sequence", "key",
            F.coalesce("value", F.lit(b"")).alias("value"), F.col("value").isNull().alias("tombstone"),
        )
        return self._append(now, rows, None)

    def _append(self, now: dict, rows: DataFrame, count: int | None) -> int:
        folder = f"log/{now['number'] + 1:010d}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.files.root}/{folder}")
        count = self._read([folder]).count() if count is None else count
        last = now["next_sequence"] + count - 1
        self._commit(now | {"log": [*now["log"], folder], "next_sequence": last + 1})
        return last

    def _one(self, key: bytes, value: bytes | None) -> int:
        self._waiting.append((key, value))
        if len(self._waiting) >= self.group:
            return self.sync()
        return self._manifest()["next_sequence"] + len(self._waiting) - 1

    def put(self, key: bytes, value: bytes) -> int:
        """Write a key; returns the sequence of the change."""
        return self._one(key, value)

    def delete(self, key: bytes) -> int:
        """Delete a key, known or not; returns the sequence of the change."""
        return self._one(key, None)

    def get(self, key: bytes) -> bytes:
        rows = reads.live(self.entries().where(F.col("key") == F.lit(key))).select("value").take(1)
        if not rows:
            raise NotFound(key)
        return bytes(rows[0]["value"])

    def scan(self, start: bytes | None = None, end: bytes | None = None, **how) -> DataFrame:
        return reads.scan(self.entries(), start, end, **how)

    def snapshot(self, sequence: int) -> DataFrame:
        """The content as of a sequence; only what compaction has kept can be seen."""
        return reads.snapshot(self.entries(), sequence)

    def compact(self, snapshots: list[int] | None = None) -> None:
        """Merge log and runs to one run, with what the given snapshots still see, and drop what it replaces.

        The new manifest names the new run instead; readers of the old one keep theirs, so its folders stay until
        ``vacuum``.
        """
        now = self._manifest()
        entries = self._read(now["log"] + now["runs"])
        kept = compaction.compact_with_snapshots(entries, snapshots, bottom=True) if snapshots else compaction.compact(entries, bottom=True)
        folder = f"runs/{now['number'] + 1:010d}-{uuid.uuid4().hex}"
        rows = kept.select("store_id", "sequence", "key", "value", F.coalesce(kept["tombstone"], F.lit(False)).alias("tombstone"))
        rows.repartitionByRange("key", "sequence").sortWithinPartitions("key", F.col("sequence").desc()).write.parquet(f"{self.files.root}/{folder}")
        self._commit(now | {"log": [], "runs": [folder]})

    def flush(self) -> None:
        """Turn the log into a run of level 0, ordered by key, and empty the log: its folders are named no more."""
        self.sync()
        now = self._manifest()
        if not now["log"]:
            return
        folder = f"runs/{now['number'] + 1:010d}-{uuid.uuid4().hex}"
        runs.flush(self._read(now["log"]), f"{self.files.root}/{folder}")
        self._commit(now | {"log": [], "runs": [*now["runs"], folder]})

    @contextmanager
    def pinned(self) -> Iterator[DataFrame]:
        """All versions as they are now, with their folders kept from ``vacuum`` as long as the block lasts."""
        name = None
        while name is None:
            now = self._manifest()
            name = f"pins/{now['number']:010d}-{uuid.uuid4().hex}.json"
            self.files.create(name, json.dumps(now))
            if self._manifest()["number"] != now["number"]:
                # a vacuum may have looked before the pin was there; what it could take is not the newest
                self.files.delete(name)
                name = None
        try:
            yield self._read(now["log"] + now["runs"])
        finally:
            self.files.delete(name)

    def vacuum(self, keep_s: float = KEEP_S) -> None:
        """Delete folders that no reader or writer can still need, and manifests and pins left behind.

        What is younger than ``keep_s`` stays: a writer may have finished it and be about to commit.  So does what
        the last manifest names, or one that is pinned or younger than that, as readers began with it.
        """
        manifests = self._manifests()
        kept = {f"manifests/{n}" for n in manifests[-1:]}
        kept |= {f"manifests/{n}" for n in manifests if self.files.age(f"manifests/{n}") <= keep_s}
        kept |= {f"pins/{n}" for n in self.files.list("pins") if not n.startswith(".")}
        named: set[str] = set()
        for name in kept:
            one = json.loads(self.files.read(name))
            named |= {*one["log"], *one["runs"]}
        for kind in ("log", "runs", "manifests"):
            for name in self.files.list(kind):
                path = f"{kind}/{name}"
                if path not in named and path not in kept and self.files.age(path) > keep_s:
                    self.files.delete(path)
