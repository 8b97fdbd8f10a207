"""Has this key been seen before?  Filters for sealed batches, exact answers for the current one."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.llm.xorfilter import XorFilter

#: Batches into which a replayed history is sealed.
GENERATIONS = 8
#: Rows per shard; a shard's filters and the keys of one batch are what a task holds.
SHARD_ROWS = 65_536


def compounded_rate(filters: int, fingerprint_bits: int) -> float:
    """Rate at which a new key gets a wrong "maybe" from at least one of so many filters."""
    return 1 - (1 - 2.0**-fingerprint_bits) ** filters


def _shards(rows: int, shard_rows: int) -> int:
    return max(1, math.ceil(rows / shard_rows))


def first_rows(df: DataFrame, source: str, entity: list[str], order: str, generation_rows: dict[str, int]) -> DataFrame:
    """The exact part: the first row of each key in each batch (``generation``), as ``row_no``.

    Combined before the shuffle, so a key that holds a third of all rows sends one row per task and batch.
    """
    width = F.lit(None).cast("long")
    for name, rows in generation_rows.items():
        width = F.when(F.col(source) == name, F.lit(rows)).otherwise(width)
    generation = F.floor(F.col(order) / width).cast("int")
    return (
        df.select(source, *entity, generation.alias("generation"), F.col(order).alias("row_no"))
        .groupBy(source, *entity, "generation")
        .agg(F.min("row_no").alias("row_no"))
    )


def build_filters(firsts: DataFrame, source: str, entity: list[str], shards: int, fingerprint: type = np.uint16) -> DataFrame:
    """Seal batches: one immutable filter per shard and batch, as rows (``shard``, ``generation``, ``keys``, ``filter``)."""

    def build(table: pa.Table) -> pa.Table:
        hashes = table["hash"].to_numpy()
        generations = table["generation"].to_numpy()
        out = []
        for g in np.unique(generations):
            own = hashes[generations == g]
            out.append((table["shard"][0].as_py(), int(g), len(own), XorFilter.build(own, fingerprint).to_bytes()))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["shard", "generation", "keys", "filter"])

    types = [pa.int64(), pa.int32(), pa.int64(), pa.binary()]
    hashed = firsts.select(*_sharded(source, entity, shards), "generation")
    return hashed.groupBy("shard").applyInArrow(build, "shard bigint, generation int, keys bigint, filter binary")


def probe_filters(firsts: DataFrame, filters: DataFrame, source: str, entity: list[str], shards: int) -> DataFrame:
    """Probe a batch's keys against stored filters of earlier batches; adds ``maybe_earlier``."""
    fields = [f for f in firsts.schema if f.name in (source, *entity, "generation", "row_no")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", maybe_earlier boolean"
    names = [f.name for f in fields]

    def probe(rows: pa.Table, stored: pa.Table) -> pa.Table:
        hashes, generations = rows["hash"].to_numpy(), rows["generation"].to_numpy()
        maybe = np.zeros(len(hashes), bool)
        for g, data in zip(stored["generation"].to_pylist(), stored["filter"].to_pylist()):
            later = generations > g
            if later.any():
                maybe[later] |= XorFilter.from_bytes(data).contains(hashes[later])
        return rows.select(names).append_column("maybe_earlier", pa.array(maybe))

    left = firsts.select("*", *_sharded(source, entity, shards))
    return left.groupBy("shard").cogroup(filters.groupBy("shard")).applyInArrow(probe, schema)


def _sharded(source: str, entity: list[str], shards: int) -> list:
    hashed = F.xxhash64(source, *entity)
    return [hashed.alias("hash"), F.pmod(F.shiftrightunsigned(hashed, 7), F.lit(shards)).alias("shard")]


def screen(firsts: DataFrame, source: str, entity: list[str], shards: int, fingerprint: type = np.uint16) -> DataFrame:
    """Replay all batches: adds ``maybe_earlier`` and ``maybe_later``, the answers of the other batches' filters.

    A shard's batches come in order; each is probed against the filters sealed before it, then sealed.  A second
    look at the later filters tells which keys can be what a later "maybe" points at.  No answer is a false "no".
    """
    fields = [f for f in firsts.schema if f.name in (source, *entity, "generation", "row_no")]
    names = [f.name for f in fields]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)

    def replay(table: pa.Table) -> pa.Table:
        hashes, generations = table["hash"].to_numpy(), table["generation"].to_numpy()
        earlier, later = np.zeros(len(hashes), bool), np.zeros(len(hashes), bool)
        filters: list[XorFilter] = []
        batches = [np.flatnonzero(generations == g) for g in np.unique(generations)]
        for rows in batches:
            own = hashes[rows]
            for sealed in filters:
                earlier[rows] |= sealed.contains(own)
            filters.append(XorFilter.build(own, fingerprint))
        for i, rows in enumerate(batches):
            for sealed in filters[i + 1 :]:
                later[rows] |= sealed.contains(hashes[rows])
        return (
            table.select(names)
            .append_column("maybe_earlier", pa.array(earlier))
            .append_column("maybe_later", pa.array(later))
        )

    return (
        firsts.select(*names, *_sharded(source, entity, shards))
        .groupBy("shard")
        .applyInArrow(replay, f"{schema}, maybe_earlier boolean, maybe_later boolean")
    )


def prepared(df: DataFrame, source: str, entity: list[str], order: str, generations: int, shard_rows: int):
    """The rows with a key, the first row of each key in each of ``generations`` batches, and a number of shards."""
    rows = df.select(source, *entity, F.col(order).cast("long").alias(order)).dropna()
    # the sources are the few tables the records come from
    spans = rows.groupBy(source).agg(F.max(order).alias("last"), F.count("*").alias("n")).collect()
    widths = {s[source]: max(1, math.ceil((s["last"] + 1) / generations)) for s in spans}
    shards = _shards(sum(s["n"] for s in spans), shard_rows)
    return rows, first_rows(rows, source, entity, order, widths), shards


def seen_before(
    df: DataFrame,
    source: str,
    entity: list[str],
    order: str,
    *,
    generations: int = GENERATIONS,
    shard_rows: int = SHARD_ROWS,
    fingerprint: type = np.uint16,
) -> DataFrame:
    """The rows (``source``, ``row_no``) whose key occurred in an earlier row of the same source.

    ``order`` is unique within a source.  Rows with a null in ``source``, ``entity`` or ``order`` have no key and
    are never reported; an empty key is a key.

    Within a batch the answer is exact.  Across batches the filters answer: a key that neither an earlier nor a
    later batch may hold is new for certain and settled; only the others take part in the exact check, which
    groups them by all bytes of their key.  Rows of the result are the input without those found new; this last
    step compares row numbers only, so no hot key meets in one task.
    """
    rows, firsts, shards = prepared(df, source, entity, order, generations, shard_rows)
    screened = screen(firsts, source, entity, shards, fingerprint)
    doubtful = F.col("maybe_earlier") | F.col("maybe_later")
    checked = screened.select(
        source,
        *[F.when(doubtful, F.col(c)).alias(c) for c in entity],
        F.when(~doubtful, F.col("row_no")).alias("settled"),
        "row_no",
    )
    new = checked.groupBy(source, *entity, "settled").agg(F.min("row_no").alias("row_no")).select(source, "row_no")
    # an anti-join written as an aggregation: it sorts nothing, and the filters' part of the plan runs once
    marked = rows.select(source, F.col(order).alias("row_no"), F.lit(False).alias("new")).unionByName(
        new.withColumn("new", F.lit(True))
    )
    return marked.groupBy(source, "row_no").agg(F.bool_or("new").alias("new")).where(~F.col("new")).select(source, "row_no")


def error_rates(
    df: DataFrame,
    source: str,
    entity: list[str],
    order: str,
    *,
    generations: int = GENERATIONS,
    shard_rows: int = SHARD_ROWS,
    fingerprint: type = np.uint16,
) -> DataFrame:
    """Per source and batch: keys probed, "maybe" answers, wrong ones by the exact check, and the expected rate."""
    _, firsts, shards = prepared(df, source, entity, order, generations, shard_rows)
    screened = screen(firsts, source, entity, shards, fingerprint)
    oldest = screened.groupBy(source, *entity).agg(
        F.min(F.struct("generation", F.col("maybe_earlier"))).alias("oldest"),
        F.collect_list(F.struct("generation", "maybe_earlier")).alias("all"),
    )
    each = oldest.select(source, "oldest", F.explode("all").alias("x"))
    is_new = F.col("x.generation") == F.col("oldest.generation")
    bits = 8 * np.dtype(fingerprint).itemsize
    return (
        each.groupBy(source, F.col("x.generation").alias("generation"))
        .agg(
            F.count("*").alias("keys_probed"),
            F.count_if(F.col("x.maybe_earlier")).alias("maybe_answers"),
            F.count_if(is_new).alias("new_keys"),
            F.count_if(is_new & F.col("x.maybe_earlier")).alias("wrong_answers"),
        )
        .withColumn("measured_rate", F.col("wrong_answers") / F.greatest(F.col("new_keys"), F.lit(1)))
        .withColumn("expected_rate", 1 - F.pow(F.lit(1 - 2.0**-bits), F.col("generation")))
    )
