"""Joins and scans that adapt to measured sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes up to which a side of a join is sent to all tasks.
BROADCAST_BYTES = 32 << 20
#: Bytes that a row takes in memory besides its values.
ROW_OVERHEAD = 32


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row takes in memory; the length of strings and binaries counts as it is."""
    size = F.lit(ROW_OVERHEAD)
    for f in df.schema:
        kind = f.dataType.typeName()
        if kind in ("string", "binary", "varchar", "char"):
            size = size + 8 + F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0))
        elif kind in ("array", "map", "struct"):
            size = size + 8 + F.coalesce(F.octet_length(F.to_json(F.struct(f"`{f.name}`"))), F.lit(0))
        else:
            size = size + 8
    return size


def broadcast_if_small(df: DataFrame, limit_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Mark ``df`` for broadcast if its rows take at most ``limit_bytes``, which is measured; else leave the join to the planner.

    Measuring runs the plan once more, so ``df`` should be a written table or a small aggregation.
    """
    taken = df.agg(F.sum(row_bytes(df).cast("long"))).first()[0] or 0
    return F.broadcast(df) if taken <= limit_bytes else df


def use_all_cores(df: DataFrame) -> DataFrame:
    """Spread a small input, such as one file of one row group, over all cores before heavy work per row.

    An input with as many partitions as there are cores is left as it is, so nothing large is ever shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
