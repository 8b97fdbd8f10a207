"""The change log: the one relation that everything else is a query over."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keystrata.sources.shared import shared_dir
from keystrata.streaming.cdc import is_delete

#: Bytes of a log record besides key and value, and of an internal key besides the user key.
RECORD_BYTES = 26
INTERNAL_KEY_BYTES = 17
#: Bytes of an empty table's head node (12 + 12 * 8) and of a node of one level (12 + 8).
HEAD_BYTES, NODE_BYTES = 108, 20


def changes(df: DataFrame) -> DataFrame:
    """Records as they were delivered: store_id, sequence, key, value, tombstone, op.

    Spellings of ``op`` are united, and a delete's value is empty, never null.  Rows without store, sequence or key
    are no records.  Timestamps are advisory and take no part.  Copies are left in: reads by sequence are the same
    with them, and need no shuffle to drop them.
    """
    rows = df.dropna(subset=["store_id", "sequence", "key"])
    deleted = is_delete(F.col("op"), F.col("tombstone"))
    empty = F.lit(b"")
    return (
        rows.select(
            "store_id",
            "sequence",
            "key",
            F.when(deleted, empty).otherwise(F.coalesce("value", empty)).alias("value"),
            deleted.alias("tombstone"),
        )
        .withColumn("op", F.when(F.col("tombstone"), "del").otherwise("put"))
    )


def change_log(df: DataFrame) -> DataFrame:
    """Records as they were written: like ``changes``, with copies of a record made one."""
    return changes(df).distinct()


def delivered_entries(df: DataFrame) -> DataFrame:
    """Entries of sorted runs: store_id, run_id, level, key, sequence, tombstone, value; copies are left in."""
    dead = F.coalesce("tombstone", F.lit(False))
    return (
        df.dropna(subset=["store_id", "run_id", "user_key", "sequence"])
        .select(
            "store_id",
            "run_id",
            "level",
            F.col("user_key").alias("key"),
            "sequence",
            dead.alias("tombstone"),
            F.when(dead, F.lit(b"")).otherwise(F.coalesce("value", F.lit(b""))).alias("value"),
        )
    )


def entries_of_runs(df: DataFrame) -> DataFrame:
    """Like ``delivered_entries``, with copies in a run made one."""
    return delivered_entries(df).distinct()


def next_sequence(*logs: DataFrame) -> DataFrame:
    """Per store the sequence that the next write gets: one above all of the log and the runs, 1 for an empty store."""
    union = None
    for log in logs:
        part = log.select("store_id", "sequence")
        union = part if union is None else union.unionByName(part)
    return union.groupBy("store_id").agg((F.coalesce(F.max("sequence"), F.lit(0)) + 1).alias("next_sequence"))


def assign_sequences(df: DataFrame, order: str, base: int = 0) -> DataFrame:
    """Number new writes densely after ``base`` in order of ``order`` (unique), as ``sequence``.

    Range partitions of the order are written to the shared folder and counted; each numbers its own rows after all
    rows of the partitions before it.  No task sees more than its partition.
    """
    spark = df.sparkSession
    path = shared_dir(spark, "numbered")
    # the columns travel as one struct, so none of their names can clash
    packed = df.select(F.struct(*df.columns).alias("row"), F.col(order).alias("at"))
    placed = packed.repartitionByRange("at").withColumn("part", F.spark_partition_id())
    placed.write.parquet(path)
    stored = spark.read.schema(placed.schema).parquet(path)
    # one row per partition
    before = F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = stored.groupBy("part").count().select("part", before.alias("base"))
    nth = F.row_number().over(Window.partitionBy("part").orderBy("at"))
    numbered = stored.join(F.broadcast(offsets), "part").select("row", (nth + F.col("base") + base).cast("long").alias("sequence"))
    return numbered.select(*[F.col("row")[c].alias(c) for c in df.columns], "sequence")


def record_bytes() -> F.Column:
    return F.lit(RECORD_BYTES) + F.octet_length("key") + F.octet_length("value")


def node_bytes() -> F.Column:
    """Bytes that a write adds to the in-memory table, with nodes of height one (heights are random in general)."""
    return F.lit(NODE_BYTES + INTERNAL_KEY_BYTES) + F.octet_length("key") + F.octet_length("value")


def block_entry_bytes() -> F.Column:
    """Bytes that an entry counts for in a data block: both lengths, internal key and value."""
    return F.lit(8 + INTERNAL_KEY_BYTES) + F.octet_length("key") + F.octet_length("value")


def valid_prefix(log: DataFrame, bad: F.Column) -> DataFrame:
    """Lenient recovery: a store's records before its first bad one (``bad`` null means good)."""
    first_bad = log.where(F.coalesce(bad, F.lit(False))).groupBy("store_id").agg(F.min("sequence").alias("first_bad"))
    joined = log.join(first_bad, "store_id", "left")
    return joined.where(F.col("first_bad").isNull() | (F.col("sequence") < F.col("first_bad"))).drop("first_bad")
