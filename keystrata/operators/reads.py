"""Reads: current state, point and multi-key lookups, scans and snapshots.

Sequences alone decide which version of a key wins, and keys order as raw bytes.  A tombstone is dropped only
after the newest version is known: dropped before, deleted keys would come back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["store_id", "key"]


def newest(entries: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Last writer wins: of each key the entry with the highest sequence, tombstones included.

    Pre-aggregated before the shuffle, so a hot key sends one row per task.
    """
    rest = [c for c in ("tombstone", "value") if c in entries.columns]
    return entries.groupBy(*keys).agg(F.max(F.struct("sequence", *rest)).alias("e")).select(*keys, "e.*")


def live(entries: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """The current content: newest entries that are no tombstones."""
    return newest(entries, keys).where(~F.col("tombstone")).drop("tombstone")


def get(entries: DataFrame, key: bytes, stores: DataFrame | None = None) -> DataFrame:
    """One key in every store: ``status`` 'ok' with the value, or 'not_found' with null.

    The key's filter goes below the aggregation down to the scan.  ``stores`` (store_id) are those that answer, a
    store that never had the key too; without it only stores whose log has the key do, and nothing else is read.
    """
    found = newest(entries.where(F.col("key") == F.lit(key)))
    found = found.select("store_id", F.when(~F.col("tombstone"), F.col("value")).alias("value"))
    if stores is not None:
        found = stores.select("store_id").distinct().join(found, "store_id", "left")
    return found.select("store_id", F.lit(key).alias("key"), status().alias("status"), "value")


def status() -> Column:
    return F.when(F.col("value").isNull(), "not_found").otherwise("ok")


def multi_get(entries: DataFrame, probes: DataFrame) -> DataFrame:
    """Each probed (store_id, key) once, with ``status`` and value.  Null probes find nothing."""
    return probes.select(*KEY).distinct().join(live(entries), KEY, "left").select(*KEY, status().alias("status"), "value")


def layered_get(layers: list[DataFrame]) -> DataFrame:
    """Newest entry per key over layers from newest to oldest: the first layer that holds a key decides.

    One union and one aggregation instead of a chain of joins.
    """
    union = None
    for rank, layer in enumerate(layers):
        part = layer.select(*KEY, "sequence", "tombstone", "value", F.lit(rank).alias("layer"))
        union = part if union is None else union.unionByName(part)
    best = F.min(F.struct("layer", (-F.col("sequence")).alias("back"), "tombstone", "value")).alias("e")
    return union.groupBy(*KEY).agg(best).select(*KEY, "e.layer", (-F.col("e.back")).alias("sequence"), "e.tombstone", "e.value")


def scan(
    entries: DataFrame, start: bytes | None = None, end: bytes | None = None, *, reverse: bool = False, limit: int | None = None, offset: int = 0
) -> DataFrame:
    """Live entries with start <= key < end in byte order (or reverse), ``limit`` of them after the first ``offset``.

    Either end may be open.  The range is filtered before the newest version is taken.  With a limit Spark takes
    the first rows of each partition instead of sorting all.
    """
    if start is not None:
        entries = entries.where(F.col("key") >= F.lit(start))
    if end is not None:
        entries = entries.where(F.col("key") < F.lit(end))
    order = [F.col("key").desc() if reverse else F.col("key").asc(), F.col("store_id").asc()]
    found = live(entries).orderBy(*order)
    found = found.offset(offset) if offset else found
    return found if limit is None else found.limit(limit)


def prefix_end(prefix: bytes) -> bytes | None:
    """The least key above all keys with the prefix; None if there is none."""
    kept = prefix.rstrip(b"\xff")
    return kept[:-1] + bytes([kept[-1] + 1]) if kept else None


def seek(entries: DataFrame, key: bytes) -> DataFrame:
    """Of each store the first live key at or after ``key``."""
    return live(entries.where(F.col("key") >= F.lit(key))).groupBy("store_id").agg(F.min("key").alias("key"))


def snapshot(entries: DataFrame, sequence: int | Column) -> DataFrame:
    """What a read as of ``sequence`` sees: newer entries do not exist for it."""
    bound = F.lit(sequence) if isinstance(sequence, int) else sequence
    return live(entries.where(F.col("sequence") <= bound))


def stale_read(entries: DataFrame, lag: int) -> DataFrame:
    """A follower's read, ``lag`` sequences behind each store's newest."""
    last = entries.groupBy("store_id").agg((F.max("sequence") - lag).alias("bound"))
    return snapshot(entries.join(last, "store_id"), F.col("bound"))


def versions(entries: DataFrame) -> DataFrame:
    """All versions in the order of a multi-version iterator: key up, sequence down."""
    return entries.orderBy("key", "store_id", F.col("sequence").desc())
