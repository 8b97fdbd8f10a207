"""Sorted immutable runs: rotation, data blocks, block index, offsets, lookups and flushing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keystrata.operators.changelog import block_entry_bytes
from keystrata.operators.ordered import greedy_cut, last_before, sum_before

#: Bytes of a data block's header, of a footer, and of an index entry besides key and key length.
HEADER_BYTES, FOOTER_BYTES, INDEX_ENTRY_BYTES = 20, 8, 16
#: Default size at which a data block is complete.
BLOCK_BYTES = 4096


def generations(log: DataFrame, capacities: DataFrame, node_bytes: F.Column, head_bytes: int) -> DataFrame:
    """The in-memory table (``generation``) that each record of a log went to.

    A table is full with the write that takes its bytes above the store's capacity; overwritten nodes still count,
    and every table has the same capacity.  ``capacities``: store_id, capacity.
    """
    sized = log.join(capacities, "store_id").withColumn("bytes", node_bytes).withColumn("room", F.col("capacity") - head_bytes)
    return greedy_cut(sized.select("store_id", "sequence", "bytes", "room"), ["store_id"], ["sequence"], "bytes", "room", "generation")


def blocks(entries: DataFrame, target: int = BLOCK_BYTES) -> DataFrame:
    """Cut each run's entries, in key order and newest first, to data blocks: adds ``bytes`` and ``block_no``."""
    sized = entries.select(
        "store_id", "run_id", "key", "sequence", (-F.col("sequence")).alias("newest_first"),
        block_entry_bytes().cast("long").alias("bytes"), F.lit(target - 1).cast("long").alias("room"),
    )
    cut = greedy_cut(sized, ["store_id", "run_id"], ["key", "newest_first"], "bytes", "room", "block_no")
    return cut.drop("room", "newest_first")


def block_index(cut: DataFrame) -> DataFrame:
    """One row per block: entry count, size with header, smallest key, and offset in the run's file."""
    one = cut.groupBy("store_id", "run_id", "block_no").agg(
        F.count("*").alias("entry_count"),
        (F.sum("bytes") + HEADER_BYTES).alias("block_size"),
        F.min("key").alias("smallest_key"),
    )
    return sum_before(one, ["store_id", "run_id"], ["block_no"], "block_size", "block_offset")


def footers(index: DataFrame) -> DataFrame:
    """One row per run: where its index begins and how long it is."""
    from keystrata.functions.codec import varint_size

    length = F.octet_length("smallest_key")
    return index.groupBy("store_id", "run_id").agg(
        F.count("*").alias("blocks"),
        F.sum("entry_count").alias("entry_count"),
        F.max(F.col("block_offset") + F.col("block_size")).alias("index_offset"),
        (F.sum(varint_size(length) + length + INDEX_ENTRY_BYTES) + 4).alias("index_size"),
    )


def locate_blocks(probes: DataFrame, index: DataFrame) -> DataFrame:
    """The block of a run that may hold a key: the last whose smallest key is not above it; null if there is none.

    ``probes``: store_id, run_id, key and more; ``index``: store_id, run_id, smallest_key, block_id.  Both are put in one order per run and the last block seen is carried on, chunk by chunk,
    instead of comparing each key with each block.
    """
    names = [c for c in probes.columns if c not in ("store_id", "run_id", "key")]
    # the other columns travel as one struct, so none of their names can clash
    rest = F.struct(*names) if names else F.lit(None).cast("struct<none:int>")
    left = probes.select("store_id", "run_id", "key", F.lit(1).alias("side"), rest.alias("rest"), F.lit(None).cast("long").alias("begins"))
    right = index.groupBy("store_id", "run_id", F.col("smallest_key").alias("key")).agg(F.max("block_id").cast("long").alias("begins"))
    right = right.select("store_id", "run_id", "key", F.lit(0).alias("side"), F.lit(None).cast(left.schema["rest"].dataType).alias("rest"), "begins")
    both = last_before(left.unionByName(right), ["store_id", "run_id"], ["key", "side"], "begins", "block_id")
    return both.where(F.col("side") == 1).select("store_id", "run_id", "key", *[F.col("rest")[n].alias(n) for n in names], "block_id")


def prefix_lengths(cut: DataFrame, restart: int = 16) -> DataFrame:
    """Front coding: bytes each key shares with the one before it in its block, 0 at every ``restart``-th key."""
    order = Window.partitionBy("store_id", "run_id", "block_no").orderBy("key", F.col("sequence").desc())
    before, at = F.lag("key").over(order), F.row_number().over(order) - 1
    rows = cut.withColumn("before", F.when(at % restart != 0, before))
    a, b = F.col("key"), F.col("before")
    common = F.least(F.octet_length(a), F.octet_length(b))
    differs = F.array_position(
        F.transform(F.sequence(F.lit(1), common), lambda i: F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1))), F.lit(False)
    )
    shared = F.when(b.isNull() | (common == 0), 0).when(differs == 0, common).otherwise(differs - 1)
    return rows.withColumn("shared", shared.cast("long")).drop("before")


def separate_values(entries: DataFrame, threshold: int) -> tuple[DataFrame, DataFrame]:
    """Key-value separation: entries with pointers (file, offset, size), and the value log that they point to.

    Values longer than ``threshold`` bytes go to the log of their run, in key order.
    """
    large = F.octet_length("value") > threshold
    size = F.octet_length("value").cast("long")
    own = entries.select("store_id", "run_id", "key", "sequence", "tombstone", "value")
    counted = own.withColumn("log_bytes", F.when(large, size).otherwise(0)).withColumn("newest_first", -F.col("sequence"))
    placed = sum_before(counted, ["store_id", "run_id"], ["key", "newest_first"], "log_bytes", "value_offset").drop("log_bytes", "newest_first")
    pointers = placed.select(
        "store_id", "run_id", "key", "sequence", "tombstone",
        F.when(~large, F.col("value")).alias("value"),
        F.when(large, F.col("run_id")).alias("value_file"),
        F.when(large, F.col("value_offset")).alias("value_offset"),
        F.when(large, size).alias("value_size"),
    )
    log = placed.where(large).select("store_id", F.col("run_id").alias("value_file"), "value_offset", size.alias("value_size"), "value")
    return pointers, log


def open_run(spark: SparkSession, path: str, key: bytes | None = None) -> DataFrame:
    """Read what ``flush`` wrote; with ``key`` only its entries, past all row groups whose filter or statistics exclude it."""
    rows = spark.read.parquet(path)
    return rows if key is None else rows.where(F.col("key") == F.lit(key))


def flush(entries: DataFrame, path: str, *, compression: str = "zstd", bloom: bool = True, row_group_bytes: int | None = None) -> None:
    """Write runs as Parquet, ordered by key within each file, so that row-group statistics serve as block index.

    Ranges go by sequence too, so the versions of a hot key are spread.  With ``bloom`` each row group gets a filter on the key for point lookups.
    """
    writer = (
        entries.repartitionByRange("store_id", "key", "sequence").sortWithinPartitions("store_id", "key", F.col("sequence").desc())
        .write.mode("errorifexists").option("compression", compression)
    )
    if bloom:
        writer = writer.option("parquet.bloom.filter.enabled#key", "true")
    if row_group_bytes:
        writer = writer.option("parquet.block.size", row_group_bytes)
    writer.parquet(path)
