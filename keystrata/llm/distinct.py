"""Distinct counts over huge identifier sets, from fixed bitmaps that merge by bitwise union."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Standard error, relative to the count, for which bitmaps are sized, and the count up to which it is kept.  Both are
#: parameters of the bitmaps and not of the day's data: partial results merge whenever they were made.
TARGET_ERROR, CAPACITY = 0.01, 50_000_000
WORD_BITS = 64
#: Rows of words that a task merges at once, for all combinations; beyond it what has the same ``word_no``.
CHUNK_ROWS = 400_000


def relative_error(n: float, bits: int) -> float:
    """Standard error of the estimate of ``n`` identifiers from a bitmap of ``bits`` bits, relative to ``n``."""
    if n <= 0:
        return 0.0
    t = n / bits
    if t > 700:
        return math.inf
    if t < 1e-4:
        return math.sqrt(0.5 / bits)
    return math.sqrt((math.exp(t) - t - 1) / bits) / t


def bitmap_bits(most: int, target_error: float = TARGET_ERROR) -> int:
    """The smallest power of two that keeps the error of every count up to ``most`` within the target.

    The error grows with the count, so the largest possible count decides; the number of rows bounds it.
    """
    bits = 1024
    while relative_error(max(most, 1), bits) > target_error:
        bits *= 2
    return bits


def bitmap_words(df: DataFrame, cell: list[str], identifier: list[str], bits: int) -> DataFrame:
    """Partial results: one row per cell and non-empty 64-bit word of its bitmap (``bits``, ``word_no``, ``word``).

    Each identifier sets the bit that its hash names.  A cell's bitmap is ``bits`` long, a power of two that is kept
    with the words; words without a set bit are not stored, so a small cell costs as little as its identifiers and no
    task ever holds a whole bitmap.  Rows whose identifier is null throughout count nothing; a null cell column is a
    cell value of its own.  Words are combined before the shuffle, so a hot identifier or cell sends one row per word
    and task.
    """
    if bits < WORD_BITS or bits & (bits - 1):
        raise ValueError("a bitmap has a power of two of bits, 64 at least")
    at = F.pmod(F.xxhash64(*identifier), F.lit(bits))
    known = F.coalesce(*[F.col(c) for c in identifier]).isNotNull()
    return (
        df.where(known)
        .select(*cell, at.alias("at"))
        .select(
            *cell,
            F.shiftright("at", 6).alias("word_no"),
            F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(F.lit(WORD_BITS - 1)).cast("int")).alias("word"),
        )
        .groupBy(*cell, "word_no")
        .agg(F.bit_or("word").alias("word"))
        .select(F.lit(bits).cast("long").alias("bits"), "*")
    )


def smallest_bits(words: DataFrame) -> int | None:
    """The size of the smallest bitmaps among the partial results; None if there are none."""
    return words.agg(F.min("bits")).first()[0]


def union_words(words: DataFrame, cell: list[str], bits: int | None = None) -> DataFrame:
    """Merge partial results (of other days, inputs or finer cells) by bitwise union.

    Bitmaps of different sizes are folded to the smallest of them, or to ``bits``: a place in a larger bitmap, modulo
    the smaller size, is the identifier's place there, as sizes are powers of two.  Without ``bits`` the sizes are read
    first.  A bitmap cannot be made larger, so one that is smaller than ``bits`` is an error.
    """
    smallest = smallest_bits(words)
    bits = bits or smallest or WORD_BITS
    if smallest is not None and smallest < bits:
        raise ValueError(f"a bitmap of {smallest} bits cannot be merged into one of {bits}")
    folded = words.select(*cell, F.pmod("word_no", F.lit(bits // WORD_BITS)).alias("word_no"), "word")
    merged = folded.groupBy(*cell, "word_no").agg(F.bit_or("word").alias("word"))
    return merged.select(F.lit(bits).cast("long").alias("bits"), "*")


def cell_counts(words: DataFrame, cell: list[str], bits: int) -> DataFrame:
    """Estimated distinct identifiers per cell (``distinct_keys``, ``relative_error``), from words of one size."""
    counted = words.groupBy(*cell).agg(F.sum(F.bit_count("word").cast("long")).alias("ones"))
    estimate = estimate_column(F.col("ones"), bits)
    return counted.select(*cell, F.round(estimate).cast("long").alias("distinct_keys"), error_column(estimate, bits).alias("relative_error"))


def estimate_column(ones: Column, bits: int) -> Column:
    """The count for which ``ones`` set bits are expected; a full bitmap gives the count of one empty bit."""
    empty = F.greatest(F.lit(bits) - ones, F.lit(1)) / F.lit(float(bits))
    return F.lit(float(bits)) * -F.log(empty)


def error_column(estimate: Column, bits: int) -> Column:
    """Standard error of an estimate, relative to it."""
    t = estimate / F.lit(float(bits))
    return F.when(t < 1e-4, F.lit(math.sqrt(0.5 / bits))).otherwise(
        F.sqrt((F.exp(t) - t - 1) / F.lit(float(bits))) / t
    )


def distinct_counts(words: DataFrame, dims: list[str], bits: int, *, fixed: list[str], dependent: dict[str, str] | None = None) -> DataFrame:
    """Estimated distinct identifiers for every combination of the dimensions, from the words of the finest cells.

    ``dependent`` maps a dimension to the one that determines it (a store's tier): grouping by both is the same
    as by the latter, so such combinations are counted once and labelled afterwards.

    There is one shuffle of words, by ``word_no``.  A word number is a piece of a uniform hash, so partitions are
    even whatever the cells' sizes.  There the words of each combination are merged where they are, in arrays: sorted
    by cell, united by bitwise or, and counted; what goes on is one number per cell and task.
    ``fixed`` columns are part of every combination.  Columns: those, the dimensions (null where not grouped), ``grouped_by``, ``distinct_keys``, ``relative_error``,
    ``bitmap_bits``.  A dimension's own null appears as a null with its name in ``grouped_by``.
    """
    dependent = dependent or {}
    sets = [c for n in range(len(dims) + 1) for c in combinations(dims, n)]
    kept: dict[tuple[str, ...], list[tuple[str, ...]]] = {}
    for c in sets:
        kept.setdefault(tuple(d for d in c if dependent.get(d) not in c), []).append(c)
    reduced = list(kept)
    # the labels of dependent dimensions ride along: they are fixed by the dimension grouped by
    labels = [d for d in dims if d in dependent]
    labelled = [f"label_{d}" for d in labels]
    names = [*fixed, *dims]

    def merge(table: pa.Table) -> Iterator[pa.RecordBatch]:
        number, word = table["word_no"].to_numpy(), table["word"].to_numpy().view(np.uint64)
        place = np.concatenate(([0], np.cumsum(number[1:] != number[:-1])))
        codes, sizes = {}, {}
        for name in names:
            encoded = table[name].combine_chunks().dictionary_encode()
            codes[name] = encoded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
            sizes[name] = len(encoded.dictionary) + 1
        for set_no, by in enumerate(reduced):
            cell, cells = np.zeros(len(word), np.int64), 1
            for name in [*fixed, *by]:
                cell, cells = cell * sizes[name] + codes[name], cells * sizes[name]
            if cells * (int(place[-1]) + 1) >= 1 << 62:
                raise OverflowError("too many cells for one chunk")
            key = place * cells + cell
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            ones = np.bitwise_count(np.bitwise_or.reduceat(word[order], first))
            _, example, inverse = np.unique(key[first] % cells, return_index=True, return_inverse=True)
            row = pa.array(order[first][example])
            columns = [pa.array(np.full(len(row), set_no, np.int32))]
            for name in names:
                values = table[name].combine_chunks()
                columns.append(values.take(row) if name in fixed or name in by else pa.nulls(len(row), values.type))
            for name in labels:
                values = table[name].combine_chunks()
                columns.append(values.take(row) if dependent[name] in by else pa.nulls(len(row), values.type))
            columns.append(pa.array(np.bincount(inverse, weights=ones).astype(np.int64)))
            yield pa.RecordBatch.from_arrays(columns, names=["set_no", *names, *labelled, "ones"])

    def merge_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) >= CHUNK_ROWS:
                table = pa.Table.from_batches(held)
                number = table["word_no"].to_numpy()
                cut = int(np.searchsorted(number, number[-1]))  # the last word may go on in the next batch
                if cut:
                    yield from merge(table.slice(0, cut))
                    held = table.slice(cut).to_batches()
        if held:
            yield from merge(pa.Table.from_batches(held))

    kinds = {f.name: f.dataType.simpleString() for f in words.schema}
    schema = ", ".join(["set_no int", *[f"`{n}` {kinds[n]}" for n in names], *[f"`label_{d}` {kinds[d]}" for d in labels], "ones bigint"])
    spread = words.select(*names, "word_no", "word").repartition("word_no").sortWithinPartitions("word_no")
    counted = spread.mapInArrow(merge_all, schema).groupBy("set_no", *names, *labelled).agg(F.sum("ones").alias("ones"))
    wanted = F.array(
        *[
            F.struct(F.lit(i).alias("set_no"), F.array(*[F.lit(x) for x in full]).cast("array<string>").alias("names"))
            for i, c in enumerate(reduced)
            for full in kept[c]
        ]
    )
    out = counted.withColumn("w", F.explode(F.filter(wanted, lambda x: x["set_no"] == F.col("set_no"))))
    named = [
        F.when(
            F.array_contains("w.names", d),
            F.coalesce(F.col(d), F.col(f"label_{d}")) if d in dependent else F.col(d),
        ).alias(d)
        for d in dims
    ]
    estimate = estimate_column(F.col("ones"), bits)
    return out.select(
        *fixed,
        *named,
        F.array_join("w.names", ",").alias("grouped_by"),
        F.round(estimate).cast("long").alias("distinct_keys"),
        error_column(estimate, bits).alias("relative_error"),
        F.lit(bits).cast("long").alias("bitmap_bits"),
    )
