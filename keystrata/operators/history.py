"""History of changing attributes: every version of every entity with the range in which it was valid."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keystrata.functions.skew import hot_condition

#: An entity with more rows than this is cut into chunks by sequence.
GROUP_ROWS = 50_000
#: Sequences per chunk of such an entity; bounds the distinct records of a chunk.
CHUNK_SEQUENCES = 32_768


def _changes(arrays: DataFrame) -> DataFrame:
    """Fold the sorted array ``a`` of each row to its points of change, ``p``.

    The fold goes once over the array.  What it carries is the record before, so it is written as a filter with
    index, which appends in linear time; an accumulator array would be copied at each append.  Of copies of one
    sequence the last in sort order counts.
    """
    record = F.col("a")
    last_copy = F.filter(
        record, lambda x, i: (i == F.size(record) - 1) | (F.get(record, i + 1)["sequence"] != x["sequence"])
    )
    arrays = arrays.withColumn("a", F.when(F.size("a") > 1, last_copy).otherwise(record))
    return arrays.withColumn(
        "p", F.filter("a", lambda x, i: (i == 0) | ~F.get(F.col("a"), i - 1)["state"].eqNullSafe(x["state"]))
    ).drop("a")


def version_history(
    df: DataFrame,
    entity: list[str],
    sequence: str,
    tombstone: str,
    value: str,
    *,
    group_rows: int = GROUP_ROWS,
    chunk_sequences: int = CHUNK_SEQUENCES,
) -> DataFrame:
    """One row per version: the entity columns, ``value``, ``valid_from``, ``valid_to``.

    A version is a longest series of an entity's successive records that are no deletes and have the same value
    (null equals null).  ``valid_from`` is its first sequence, ``valid_to`` the sequence of the next record that
    is a delete or has another value, or -1 if there is none.  Repeated records count once; of copies of one
    record that contradict each other, the greatest by (delete, value) counts.  A null tombstone means no delete.
    Rows without a sequence or without one of the entity columns name no record and are left out.

    Each entity's records are gathered in one sorted array and folded by a higher-order function.  An entity of
    more than ``group_rows`` rows never becomes one array: its records are cut into chunks by sequence, folded
    chunk by chunk, and only one small summary per chunk is ordered per entity to join the chunks' edges.
    """
    dead = F.coalesce(F.col(tombstone), F.lit(False))
    rows = df.where(F.col(sequence).isNotNull())
    for c in entity:
        rows = rows.where(F.col(c).isNotNull())
    keys = [f"k{i}" for i in range(len(entity))]
    rows = rows.select(
        *[F.col(c).alias(k) for c, k in zip(entity, keys)],
        F.struct(
            F.col(sequence).cast("long").alias("sequence"),
            F.struct(dead.alias("dead"), F.when(~dead, F.col(value)).alias("value")).alias("state"),
        ).alias("r"),
    )
    hot = hot_condition(rows, keys, group_rows)
    gathered = F.array_sort(F.collect_list("r")).alias("a")

    cold = _changes(rows.where(~hot).groupBy(*keys).agg(gathered))
    cold = cold.select(
        *keys,
        F.explode(
            F.transform(
                "p",
                lambda x, i: F.struct(
                    x["sequence"].alias("valid_from"),
                    F.coalesce(F.get(F.col("p"), i + 1)["sequence"], F.lit(-1)).alias("valid_to"),
                    x["state"].alias("state"),
                ),
            )
        ).alias("v"),
    )

    chunk = F.floor(F.col("r.sequence") / F.lit(chunk_sequences)).alias("chunk")
    chunks = rows.where(hot).select(*keys, chunk, "r")
    # as a set, so that copies go before the shuffle and a chunk's array is bounded by its sequences
    chunks = _changes(chunks.groupBy(*keys, "chunk").agg(F.array_sort(F.collect_set("r")).alias("a")))
    first, second = F.get(F.col("p"), F.lit(0)), F.get(F.col("p"), F.lit(1))
    edge = chunks.select(
        *keys,
        "chunk",
        first["sequence"].alias("first_sequence"),
        first["state"].alias("first_state"),
        second["sequence"].alias("second_sequence"),
        F.element_at("p", -1)["state"].alias("last_state"),
    )
    forward = Window.partitionBy(*keys).orderBy("chunk")
    backward = Window.partitionBy(*keys).orderBy(F.col("chunk").desc()).rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.withColumn("carried", F.lag("last_state").over(forward))
    goes_on = F.col("carried").isNotNull() & F.col("carried").eqNullSafe(F.col("first_state"))
    edge = edge.withColumn("opens", F.when(goes_on, F.col("second_sequence")).otherwise(F.col("first_sequence")))
    edge = edge.select(
        *[F.col(k).alias(f"e_{k}") for k in keys],
        F.col("chunk").alias("e_chunk"),
        goes_on.alias("goes_on"),
        F.last("opens", ignorenulls=True).over(backward).alias("next_opens"),
    )
    same = [F.col(k) == F.col(f"e_{k}") for k in [*keys, "chunk"]]
    joined = chunks.join(edge, on=same)
    joined = joined.withColumn("p", F.when(F.col("goes_on"), F.slice("p", 2, F.size("p"))).otherwise(F.col("p")))
    hot_versions = joined.select(
        *keys,
        F.explode(
            F.transform(
                "p",
                lambda x, i: F.struct(
                    x["sequence"].alias("valid_from"),
                    F.coalesce(F.get(F.col("p"), i + 1)["sequence"], F.col("next_opens"), F.lit(-1)).alias("valid_to"),
                    x["state"].alias("state"),
                ),
            )
        ).alias("v"),
    )
    return (
        cold.unionByName(hot_versions)
        .where(~F.col("v.state.dead"))
        .select(
            *[F.col(k).alias(c) for c, k in zip(entity, keys)],
            F.col("v.state.value").alias(value),
            F.col("v.valid_from").alias("valid_from"),
            F.col("v.valid_to").alias("valid_to"),
        )
    )


def as_of(history: DataFrame, sequence: int) -> DataFrame:
    """The versions valid at ``sequence``."""
    return history.where(
        (F.col("valid_from") <= sequence) & ((F.col("valid_to") == -1) | (F.col("valid_to") > sequence))
    )
