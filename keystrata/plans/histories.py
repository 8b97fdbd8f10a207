"""Queries of the history, incremental-load and change-feed problems, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.operators.history import version_history
from keystrata.operators.incremental import IncrementalLoad, carried_by, latest_runs
from keystrata.sources.shared import shared_dir
from keystrata.sources.tables import table
from keystrata.streaming.cdc import apply_changes, change_rows, current_state, merge_upserts, rebuild_from_files


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every version of every key of a store, with the sequences in which it was valid."""
    entries = table(spark, sf_dir, "internal_key")
    versions = version_history(entries, ["store_id", "user_key"], "sequence", "tombstone", "value")
    return versions.select("store_id", F.hex("user_key").alias("key_hex"), "valid_from", "valid_to")


P1_SQL = """
WITH r AS (
  SELECT store_id, user_key, sequence, bool_or(coalesce(tombstone, false)) AS dead,
         max(CASE WHEN NOT coalesce(tombstone, false) THEN value END) AS v
  FROM internal_key
  WHERE store_id IS NOT NULL AND user_key IS NOT NULL AND sequence IS NOT NULL
  GROUP BY ALL
), c AS (
  SELECT *, row_number() OVER w AS n,
         lag(dead) OVER w IS DISTINCT FROM dead OR lag(v) OVER w IS DISTINCT FROM v AS changed
  FROM r WINDOW w AS (PARTITION BY store_id, user_key ORDER BY sequence)
), p AS (
  SELECT store_id, user_key, sequence, dead,
         lead(sequence) OVER (PARTITION BY store_id, user_key ORDER BY sequence) AS next_sequence
  FROM c WHERE changed OR n = 1
)
SELECT store_id, hex(user_key) AS key_hex, sequence AS valid_from, coalesce(next_sequence, -1) AS valid_to
FROM p WHERE NOT dead
"""


def p1_chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same versions, with every key of more than a few rows taken as one that is too large for one array."""
    entries = table(spark, sf_dir, "internal_key")
    versions = version_history(entries, ["store_id", "user_key"], "sequence", "tombstone", "value", group_rows=20, chunk_sequences=64)
    return versions.select("store_id", F.hex("user_key").alias("key_hex"), "valid_from", "valid_to")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records that the next run of each store and source has to carry onward, as that run carries them.

    The load begins from what the log of runs says to be carried; then one run is made, and its committed output is
    the answer.
    """
    keys = ["source_name", "store_id"]
    records = None
    for name in ("wal_entry", "internal_key"):
        part = table(spark, sf_dir, name).select(F.lit(name).alias("source_name"), "store_id", "sequence", "arrived_at")
        records = part if records is None else records.unionByName(part)
    runs = latest_runs(table(spark, sf_dir, "sync_run"), keys, "started_at", "status", "committed_sequence")
    load = IncrementalLoad(spark, shared_dir(spark, "load"), keys, "sequence")
    load.adopt(carried_by(records, runs, keys, "arrived_at"))
    named = records.select(*keys, "sequence")
    load.run(named)
    carried = load.output()
    return spark.createDataFrame([], named.schema) if carried is None else carried


P4_SQL = """
WITH a AS (
  SELECT 'wal_entry' AS source_name, store_id, sequence, min(arrived_at) AS first_arrival FROM wal_entry GROUP BY ALL
  UNION ALL
  SELECT 'internal_key', store_id, sequence, min(arrived_at) FROM internal_key GROUP BY ALL
), r AS (
  SELECT source_name, store_id, max(started_at) AS since FROM sync_run WHERE status = 'ok' GROUP BY ALL
)
SELECT a.source_name, a.store_id, a.sequence FROM a LEFT JOIN r USING (source_name, store_id)
WHERE a.store_id IS NOT NULL AND a.sequence IS NOT NULL AND (since IS NULL OR coalesce(first_arrival > since, true))
"""


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live keys of each store after all puts and deletes of the change log."""
    live = rebuild_from_files(spark, f"{sf_dir}/wal_entry.parquet", {"store_id": "store_id", "key": "key"})
    return live.select("store_id", F.hex("key").alias("key_hex"), "sequence")


def p5_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same live keys, from a feed that grows between two runs, the second of which resumes the first's state."""
    path = shared_dir(spark, "feed")
    feed = table(spark, sf_dir, "wal_entry")
    halves = F.pmod(F.xxhash64("store_id", "key", "sequence", "arrived_at"), F.lit(2))
    keys, target = ["store_id", "key"], f"{path}/upserts"
    for half in (0, 1):
        feed.where(halves == half).repartition(4).write.mode("append").parquet(f"{path}/changes")
        stream = spark.readStream.schema(feed.schema).option("maxFilesPerTrigger", 3).parquet(f"{path}/changes")
        changes = change_rows(stream, {"store_id": "store_id", "key": "key"}, "op", "sequence", "tombstone", "value")
        apply_changes(spark, changes, keys, target, f"{path}/state")
        merge_upserts(spark, target, keys)
    live = current_state(spark, target, keys, changes.schema)
    return live.select("store_id", F.hex("key").alias("key_hex"), "sequence")


P5_SQL = """
WITH c AS (
  SELECT store_id, key, sequence,
         CASE WHEN lower(trim(op)) IN ('del', '1') THEN true WHEN lower(trim(op)) IN ('put', '0') THEN false
              ELSE coalesce(tombstone, false) END AS dead
  FROM wal_entry WHERE store_id IS NOT NULL AND key IS NOT NULL AND sequence IS NOT NULL
)
SELECT store_id, hex(key) AS key_hex, max(sequence) AS sequence FROM c
GROUP BY store_id, key HAVING NOT arg_max(dead, sequence)
"""

QUERIES = {"p1_found": p1_found, "p1_chunked": p1_chunked, "p4_found": p4_found, "p5_found": p5_found, "p5_resumed": p5_resumed}
SQL = {"p1_found": P1_SQL, "p1_chunked": P1_SQL, "p4_found": P4_SQL, "p5_found": P5_SQL, "p5_resumed": P5_SQL}
