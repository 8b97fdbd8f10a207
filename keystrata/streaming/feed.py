"""Change feeds: watching a key range, and a live table of the current content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from keystrata.operators.reads import KEY
from keystrata.streaming.cdc import apply_changes, change_rows, current_state, latest_entries, merge_upserts

CHANGES = "store_id bigint, key binary, sequence bigint, deleted boolean, value binary"


def log_stream(spark: SparkSession, path: str, schema, *, files_per_batch: int = 32) -> DataFrame:
    """The change log of a folder as a stream; each file is one group of commits."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return change_rows(rows, {"store_id": "store_id", "key": "key"}, "op", "sequence", "tombstone", "value")


def watch(changes: DataFrame, start: bytes | None = None, end: bytes | None = None) -> DataFrame:
    """The changes of a range of keys; a filter, so it needs no state and keeps the feed's order within a file."""
    if start is not None:
        changes = changes.where(F.col("key") >= F.lit(start))
    return changes if end is None else changes.where(F.col("key") < F.lit(end))


def write_feed(changes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the changes to Parquet files, each exactly once, up to what there is now."""
    return (
        changes.writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


class LiveTable:
    """The current content of a change feed, kept on shared storage; ``refresh`` takes in what has come since.

    State and upserts are those of ``apply_changes``: sequence alone decides, however late a change comes, so there is
    no watermark, and state grows with the keys.  Nothing is kept on the driver.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def refresh(self, changes: DataFrame) -> None:
        """Apply all changes that the stream (store_id, key, sequence, deleted, value) has by now, and merge old upserts."""
        apply_changes(self.spark, changes, KEY, f"{self.root}/upserts", f"{self.root}/state")
        merge_upserts(self.spark, f"{self.root}/upserts", KEY)

    def entries(self) -> DataFrame:
        """The newest change of each key, deletes included."""
        return latest_entries(self.spark, f"{self.root}/upserts", KEY, CHANGES)

    def rows(self) -> DataFrame:
        """The live keys with sequence and value."""
        return current_state(self.spark, f"{self.root}/upserts", KEY, CHANGES)
