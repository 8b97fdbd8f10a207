"""Merging runs, compaction, manifests, levels, expiry and value-log collection."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystrata.operators.reads import KEY, newest


def compact(entries: DataFrame, *, bottom: bool) -> DataFrame:
    """Merge runs to the newest entry per key.

    Tombstones go only if the merge has the deepest level (``bottom``); otherwise older versions below would
    come back.
    """
    merged = newest(entries)
    return merged.where(~F.col("tombstone")) if bottom else merged


def compact_with_snapshots(entries: DataFrame, snapshots: list[int], *, bottom: bool) -> DataFrame:
    """Merge runs and keep what the live snapshots can still see.

    An entry is kept if it is the newest of its key at or below one of the snapshots, or the newest of all, or
    above the oldest snapshot.  A tombstone that is the oldest kept entry of its key goes at the bottom level.
    The newest per snapshot are found by one aggregation, with one maximum per snapshot.
    """
    row = F.struct("sequence", "tombstone", "value")
    oldest = min(snapshots) if snapshots else None
    maxima = [F.max(F.when(F.col("sequence") <= s, row)).alias(f"s{i}") for i, s in enumerate(snapshots)]
    grouped = entries.groupBy(*KEY).agg(*maxima, F.max(row).alias("top"))
    visible = F.array_distinct(F.array_compact(F.array(*[f"s{i}" for i in range(len(snapshots))], "top")))
    kept = grouped.select(*KEY, F.explode(visible).alias("e")).select(*KEY, "e.*")
    if oldest is not None:
        newer = entries.where(F.col("sequence") > oldest).select(*KEY, "sequence", "tombstone", "value")
        kept = kept.unionByName(newer).dropDuplicates([*KEY, "sequence"])
    if bottom:
        first = kept.groupBy(*KEY).agg(F.min("sequence").alias("first"))
        kept = kept.join(first, KEY).where(~F.col("tombstone") | (F.col("sequence") != F.col("first"))).drop("first")
    return kept


def live_runs(manifest: DataFrame) -> DataFrame:
    """Runs whose last edit adds them, with what that addition says.  Repeated edits count once."""
    facts = ["level", "smallest_key", "largest_key", "entry_count", "bytes", "edited_at"]
    last = manifest.dropna(subset=["store_id", "run_id", "edit_seq"]).groupBy("store_id", "run_id").agg(
        F.max(F.struct("edit_seq", "action", *facts)).alias("e")
    )
    return last.where(F.col("e.action") == "add").select("store_id", "run_id", *[f"e.{f}" for f in facts])


def pick_leveled(runs: DataFrame, trigger: int = 4) -> DataFrame:
    """Leveling: where level 0 has ``trigger`` runs or more, all of them and the runs of level 1 that they overlap."""
    level0 = runs.where(F.col("level") == 0).groupBy("store_id").agg(
        F.count("*").alias("n"), F.min("smallest_key").alias("low"), F.max("largest_key").alias("high")
    )
    full = runs.join(level0.where(F.col("n") >= trigger), "store_id")
    overlaps = (F.col("smallest_key") <= F.col("high")) & (F.col("largest_key") >= F.col("low"))
    return full.where((F.col("level") == 0) | ((F.col("level") == 1) & overlaps)).select("store_id", "run_id", "level")


def pick_tiered(runs: DataFrame, ratio: int = 4) -> DataFrame:
    """Tiering: runs of a store and size tier (powers of ``ratio``) that has ``ratio`` runs or more."""
    tier = F.floor(F.log(F.greatest(F.col("bytes"), F.lit(1)).cast("double")) / math.log(ratio) + 1e-9)
    tiered = runs.withColumn("tier_no", tier)
    full = tiered.groupBy("store_id", "tier_no").agg(F.count("*").alias("n")).where(F.col("n") >= ratio)
    return tiered.join(full, ["store_id", "tier_no"], "left_semi").select("store_id", "run_id", "tier_no")


def pick_expired(runs: DataFrame, before: Column) -> DataFrame:
    """FIFO: runs written before a moment, to be dropped whole."""
    return runs.where(F.col("edited_at") < before).select("store_id", "run_id", "level")


def level_count(runs: DataFrame, memtable_bytes: DataFrame, ratio: int = 10) -> DataFrame:
    """Levels that a store's bytes need when each is ``ratio`` times the one above."""
    total = runs.groupBy("store_id").agg(F.sum("bytes").alias("bytes"))
    sized = total.join(memtable_bytes, "store_id")
    levels = F.ceil(F.log(F.greatest(F.col("bytes") / F.col("capacity"), F.lit(1.0))) / math.log(ratio) - 1e-9)
    return sized.select("store_id", "bytes", F.greatest(levels, F.lit(1)).alias("levels"))


def amplification(log: DataFrame, entries: DataFrame) -> DataFrame:
    """Per store: bytes written to runs per byte logged, runs per key, and bytes in runs per live byte.

    ``log`` and ``entries`` have store_id, key, value; entries also run_id, sequence, tombstone.
    """
    size = (F.octet_length("key") + F.octet_length("value")).cast("long")
    logged = log.groupBy("store_id").agg(F.sum(size).alias("logged_bytes"))
    stored = entries.groupBy("store_id").agg(F.sum(size).alias("run_bytes"))
    per_key = entries.groupBy(*KEY).agg(
        F.count_distinct("run_id").alias("runs"), F.max(F.struct("sequence", "tombstone", size.alias("size"))).alias("e")
    )
    keys = per_key.groupBy("store_id").agg(
        F.sum("runs").alias("key_runs"),
        F.count("*").alias("keys"),
        F.sum(F.when(~F.col("e.tombstone"), F.col("e.size")).otherwise(0)).alias("live_bytes"),
    )
    return (
        logged.join(stored, "store_id", "full").join(keys, "store_id", "full")
        .select(
            "store_id", "logged_bytes", "run_bytes", "live_bytes",
            F.round(F.col("run_bytes") / F.col("logged_bytes"), 6).alias("write_amplification"),
            F.round(F.col("key_runs") / F.col("keys"), 6).alias("read_amplification"),
            F.round(F.col("run_bytes") / F.nullif(F.col("live_bytes"), F.lit(0)), 6).alias("space_amplification"),
        )
    )


def expire(entries: DataFrame, written: str, now: Column, ttl: str) -> DataFrame:
    """Newest entries younger than ``ttl``; the time is an argument, never the clock.  No time means no expiry.

    ``written`` is the column of the moment of writing.
    """
    last = entries.groupBy(*KEY).agg(F.max(F.struct("sequence", "tombstone", "value", written)).alias("e"))
    at = F.col(f"e.{written}")
    young = at.isNull() | (at + F.expr(f"INTERVAL {ttl}") > now)
    return last.where(~F.col("e.tombstone") & young).select(*KEY, "e.sequence", "e.value", f"e.{written}")


def reclaimable(pointers: DataFrame, log: DataFrame) -> DataFrame:
    """Value-log collection: per file its bytes and those that no newest entry points to."""
    top = pointers.groupBy(*KEY).agg(F.max(F.struct("sequence", "tombstone", "value_file", "value_offset")).alias("e"))
    alive = top.where(~F.col("e.tombstone") & F.col("e.value_file").isNotNull()).select(
        "store_id", "e.value_file", "e.value_offset", F.lit(True).alias("alive")
    )
    at = ["store_id", "value_file", "value_offset"]
    return log.join(alive.distinct(), at, "left").groupBy("store_id", "value_file").agg(
        F.sum("value_size").alias("log_bytes"),
        F.sum(F.when(F.col("alive").isNull(), F.col("value_size")).otherwise(0)).alias("dead_bytes"),
    )
