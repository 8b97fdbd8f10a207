"""Applying a stream of inserts, updates and deletes."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.sources.shared import SharedFiles, shared_dir

#: How operations are written, after trimming and lower-casing.
PUT_NAMES = ["put", "0"]
DELETE_NAMES = ["del", "1"]


def is_delete(op: Column, tombstone: Column) -> Column:
    """Whether a change deletes: by its operation, else by its tombstone, else not."""
    name = F.lower(F.trim(op))
    return F.coalesce(
        F.when(name.isin(DELETE_NAMES), F.lit(True)).when(name.isin(PUT_NAMES), F.lit(False)), tombstone, F.lit(False)
    )


def latest_changes(changes: DataFrame, keys: list[str]) -> DataFrame:
    """The newest change of each key, from rows (``keys``, ``sequence``, ``deleted``, ``value``).

    On a stream this is keyed state: it holds each key's last sequence, its tombstone and its payload, and takes
    only a change with a higher sequence, so repeated and out-of-order changes alter nothing.  Of contradicting
    copies of one sequence the greatest by (deleted, value) counts.
    """
    return changes.groupBy(*keys).agg(F.max(F.struct("sequence", "deleted", "value")).alias("last"))


def apply_changes(
    spark: SparkSession,
    stream: DataFrame,
    keys: list[str],
    target: str,
    checkpoint: str,
    *,
    state_partitions: int | None = None,
) -> None:
    """Apply all changes that ``stream`` has by now, as upserts below ``target``.

    Each batch writes the rows it changed to a hidden folder, which then gets the batch's number as its name: readers
    see all of a batch or nothing.  A batch that is repeated after its folder is there has the same rows in it and
    leaves it as it is; what an attempt that failed left behind is hidden and goes with the next batch.  State is kept in RocksDB, which
    spills to disk, and saved as change logs below ``checkpoint``; a lost executor's state is built from there.
    """
    settings = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    }
    if state_partitions:
        settings["spark.sql.shuffle.partitions"] = str(state_partitions)
    before = {k: spark.conf.get(k, None) for k in settings}

    def upsert(batch: DataFrame, number: int) -> None:
        files = SharedFiles(spark, target)
        for name in files.list(""):
            if name.startswith(".batch-"):
                files.delete(name)
        if any(n == f"version={number}" or n.startswith(f"version={number}-") for n in files.list("")):
            return
        hidden = f".batch-{number}-{uuid.uuid4().hex}"
        batch.select(*keys, "last.sequence", "last.deleted", "last.value").write.parquet(f"{target}/{hidden}")
        files.rename(hidden, f"version={number}")

    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        query = (
            latest_changes(stream, keys)
            .writeStream.outputMode("update")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .foreachBatch(upsert)
            .start()
        )
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    query.awaitTermination()


def latest_entries(spark: SparkSession, target: str, keys: list[str], schema) -> DataFrame:
    """The newest change of each key (``keys``, ``sequence``, ``deleted``, ``value``) in all batches written below ``target``.

    One batch holds a key once, so with a single batch nothing is left to merge.
    """
    versions = [n for n in SharedFiles(spark, target).list("") if n.startswith("version=")]
    if not versions:
        return spark.createDataFrame([], schema).select(*keys, "sequence", "deleted", "value")
    rows = spark.read.parquet(*[f"{target}/{v}" for v in versions])
    return latest_changes(rows, keys).select(*keys, "last.*") if len(versions) > 1 else rows


def current_state(spark: SparkSession, target: str, keys: list[str], schema) -> DataFrame:
    """The live rows (``keys``, ``sequence``, ``value``) after all batches written below ``target``."""
    return latest_entries(spark, target, keys, schema).where(~F.col("deleted")).select(*keys, "sequence", "value")


def merge_upserts(spark: SparkSession, target: str, keys: list[str]) -> None:
    """Merge all upsert folders but the newest into one, so that their number does not grow with the batches.

    The merged folder takes the number of the last that it replaces.  It is whole before any of those goes, and
    ``latest_changes`` of it beside them is the same, so readers that begin at any time see the same state.
    """
    files = SharedFiles(spark, target)
    versions = sorted((n for n in files.list("") if n.startswith("version=")), key=lambda n: int(n.split("=")[1].split("-")[0]))
    old = versions[:-1]
    if len(old) < 2:
        return
    rows = latest_changes(spark.read.parquet(*[f"{target}/{v}" for v in old]), keys).select(*keys, "last.*")
    hidden = f".merged-{uuid.uuid4().hex}"
    rows.write.parquet(f"{target}/{hidden}")
    files.rename(hidden, f"{old[-1].split('-')[0]}-{uuid.uuid4().hex[:8]}")
    for v in old:
        files.delete(v)


def change_rows(df: DataFrame, keys: dict[str, str], op: str, sequence: str, tombstone: str, value: str) -> DataFrame:
    """Changes in the form the operator takes; ``keys`` maps its key names to columns.

    Rows without a sequence or a key column name no change and are left out.  A delete has no payload.
    """
    rows = df.dropna(subset=[*keys.values(), sequence])
    deleted = is_delete(F.col(op), F.col(tombstone))
    return rows.select(
        *[F.col(c).alias(k) for k, c in keys.items()],
        F.col(sequence).cast("long").alias("sequence"),
        deleted.alias("deleted"),
        F.when(~deleted, F.col(value)).alias("value"),
    )


def rebuild_from_files(
    spark: SparkSession,
    path: str,
    keys: dict[str, str],
    *,
    op: str = "op",
    sequence: str = "sequence",
    tombstone: str = "tombstone",
    value: str = "value",
    files_per_batch: int | None = None,
) -> DataFrame:
    """Run the change feed of a Parquet file or folder through the operator and return the live rows.

    A batch takes as much as one round of tasks reads, or ``files_per_batch`` files, so batches grow with the
    cluster and their number does not grow with the feed alone.
    """
    schema = spark.read.parquet(path).schema
    # a stream reads a folder; a single file is named by a pattern that only it matches
    watched = f"{path[:-1]}[{path[-1]}]" if SharedFiles(spark, path).is_file() else path
    source = spark.readStream.schema(schema)
    if files_per_batch:
        source = source.option("maxFilesPerTrigger", files_per_batch)
    else:
        split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
        source = source.option("maxBytesPerTrigger", split * spark.sparkContext.defaultParallelism)
    stream = source.parquet(watched)
    changes = change_rows(stream, keys, op, sequence, tombstone, value)
    work = shared_dir(spark, "changes")
    apply_changes(spark, changes, list(keys), f"{work}/upserts", f"{work}/state")
    SharedFiles(spark, work).delete("state")
    return current_state(spark, f"{work}/upserts", list(keys), changes.schema)
