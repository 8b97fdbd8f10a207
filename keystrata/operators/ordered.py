"""Going once over each group's rows in order, where what comes next depends on what was before.

A window function would bring a whole group to one task.  Here ordered rows are cut into chunks that know nothing of
groups; each chunk is summed up; the summaries of a group that runs over several chunks, one small row each, are gone
over in order; and each chunk then starts from the state it was handed.  No task ever needs more than a chunk of rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.functions.bounded import broadcast_if_small
from keystrata.sources.shared import shared_dir

#: Rows of a chunk, at most.
CHUNK_ROWS = 10_000


def _segments(batch: pa.RecordBatch | pa.Table, group: list[str]) -> list[tuple[int, int]]:
    """Begin and end of each stretch of rows of one group."""
    changes = np.zeros(max(0, batch.num_rows - 1), bool)
    for g in group:
        column = batch.column(batch.schema.get_field_index(g)).to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else batch[g].to_numpy()
        changes |= column[1:] != column[:-1]
    edges = (np.flatnonzero(changes) + 1).tolist()
    return list(zip([0, *edges], [*edges, batch.num_rows]))


def ordered_scan(
    df: DataFrame,
    group: list[str],
    order: list[str],
    name: str,
    kind: str,
    summarize: Callable[[pa.Table], Any],
    step: Callable[[Any, Any], Any],
    assign: Callable[[pa.Table, Any], pa.Array],
    *,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Add the column ``name`` of type ``kind`` that a fold over each group's rows, in order, gives.

    ``summarize`` makes of a stretch of rows what ``step`` needs to get from the state before it to the state after
    it; the state before a group is None.  ``assign`` gives a stretch its values from the state before it.  Summaries
    and states are small and can be pickled.  Groups are of integers without nulls.  Equal order keys may come in
    either order, so order by a unique column last.

    Rows are range partitioned by group and order, so a group may lie in any number of partitions, and are written
    once to the shared folder with the number of their chunk: what follows reads the same chunks, whatever is run again.
    """
    spark = df.sparkSession
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    names = df.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, chunk = TaskContext.get().partitionId(), 0
        for whole in batches:
            for begin in range(0, whole.num_rows, chunk_rows):
                batch = whole.slice(begin, chunk_rows)
                summaries: list[bytes | None] = [None] * batch.num_rows
                segments = _segments(batch, group)
                for start, stop in {segments[0], segments[-1]}:
                    summaries[start] = pickle.dumps(summarize(pa.Table.from_batches([batch.slice(start, stop - start)])))
                n = batch.num_rows
                extra = [pa.array([part] * n, pa.int32()), pa.array([chunk] * n, pa.int64()), pa.array(np.arange(n), pa.int32()), pa.array(summaries, pa.binary())]
                yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*names, "scan_part", "scan_chunk", "scan_nth", "scan_summary"])
                chunk += 1

    path = shared_dir(spark, "ordered")
    placed = df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    placed.mapInArrow(cut, f"{fields}, scan_part int, scan_chunk bigint, scan_nth int, scan_summary binary").write.parquet(f"{path}/rows")
    stored = spark.read.parquet(f"{path}/rows")

    def fold(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table[c].to_pylist() for c in ("scan_part", "scan_chunk", "scan_nth", "scan_summary"))), key=lambda r: r[:3])
        out, state = [], None
        for part, chunk, nth, summary in rows:
            if nth == 0 and state is not None:
                out.append((part, chunk, pickle.dumps(state)))
            state = step(state, pickle.loads(summary))
        columns = list(zip(*out)) if out else [[], [], []]
        types = [pa.int32(), pa.int64(), pa.binary()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names=["scan_part", "scan_chunk", "scan_state"])

    summed = stored.where(F.col("scan_summary").isNotNull()).select(*group, "scan_part", "scan_chunk", "scan_nth", "scan_summary")
    several = summed.groupBy(*group).count().where("count > 1").drop("count")
    states = summed.join(several, group, "left_semi").groupBy(*group).applyInArrow(fold, "scan_part int, scan_chunk bigint, scan_state binary")
    states.write.parquet(f"{path}/states")
    states = broadcast_if_small(spark.read.parquet(f"{path}/states"))

    def give(table: pa.Table) -> pa.Table:
        table = table.sort_by("scan_nth").combine_chunks()
        state = table["scan_state"][0].as_py()
        values = []
        for i, (start, stop) in enumerate(_segments(table, group)):
            before = pickle.loads(state) if i == 0 and state is not None else None
            values.append(assign(table.slice(start, stop - start), before))
        return table.select(names).append_column(name, pa.concat_arrays(values))

    joined = stored.drop("scan_summary").join(states, ["scan_part", "scan_chunk"], "left")
    return joined.groupBy("scan_part", "scan_chunk").applyInArrow(give, f"{fields}, `{name}` {kind}")


def _next_cut(sums: np.ndarray, limit: int) -> np.ndarray:
    """For each place after which a piece begins, the place of the row that closes it; ``len(sums)`` if none here."""
    starts = np.concatenate(([0], sums))
    return np.searchsorted(sums, starts + limit, side="right")


def cut_summary(size: str, capacity: str) -> Callable[[pa.Table], tuple]:
    """What greedy cuts do to a stretch, for any bytes that its first piece has already.

    Which row closes the first piece depends on those bytes; where the cuts go on from there depends on the row
    only.  Rows whose cuts meet soon give the same end, and such rows are one entry.
    """

    def summarize(table: pa.Table) -> tuple:
        sums = np.cumsum(table[size].to_numpy().astype(np.int64))
        limit = int(table[capacity][0].as_py())
        after = _next_cut(sums, limit)  # by place of a beginning: 0, or the row before plus one
        n = len(sums)
        jump = np.append(after[1:] + 1, n + 1).astype(np.int64)  # from a closing row's beginning to the next one's
        jump[n] = n + 1
        # count of cuts and last beginning from each place on, by doubling
        where = np.minimum(np.concatenate((after + 1, [n + 1])), n + 1)
        count = (where <= n).astype(np.int64)
        last = np.where(where <= n, where, np.arange(n + 2))
        while True:
            more = count[np.minimum(where, n + 1)] > 0
            if not more.any():
                break
            count = count + np.where(where <= n, count[np.minimum(where, n + 1)], 0)
            last = np.where(where <= n, last[np.minimum(where, n + 1)], last)
            where = where[np.minimum(where, n + 1)]
        total = int(sums[-1])
        # rows that may close the first piece: all up to the one that closes an empty one
        first = min(int(after[0]), n - 1)
        cuts = count[1 : first + 2] + 1
        rest = total - np.concatenate(([0], sums))[last[1 : first + 2]]
        same = np.flatnonzero(np.concatenate(([True], (cuts[1:] != cuts[:-1]) | (rest[1:] != rest[:-1]))))
        ends = np.append(same[1:], first + 1) - 1
        return limit, total, sums[ends], cuts[same], rest[same]

    return summarize


def cut_step(state: tuple[int, int] | None, summary: tuple) -> tuple[int, int]:
    """(bytes in the open piece, its number) after a stretch."""
    held, number = state or (0, 0)
    limit, total, ends, cuts, rest = summary
    if held + total <= limit:
        return held + total, number
    # the first row with which the piece exceeds its limit: in which entry it is, by the sums at the entries' ends
    entry = int(np.searchsorted(ends, limit - held, side="right"))
    return int(rest[entry]), number + int(cuts[entry])


def cut_assign(size: str, capacity: str) -> Callable[[pa.Table, Any], pa.Array]:
    def assign(table: pa.Table, state: tuple[int, int] | None) -> pa.Array:
        held, number = state or (0, 0)
        sums, limit = np.cumsum(table[size].to_numpy().astype(np.int64)), int(table[capacity][0].as_py())
        pieces, at, base = np.empty(len(sums), np.int64), 0, -held
        while at < len(sums):
            last = int(np.searchsorted(sums, base + limit, side="right"))
            pieces[at : last + 1] = number
            if last >= len(sums):
                break
            number, base, at = number + 1, int(sums[last]), last + 1
        return pa.array(pieces)

    return assign


def greedy_cut(df: DataFrame, group: list[str], order: list[str], size: str, capacity: str, name: str, *, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Number the pieces (from 0) into which each group's ordered rows are cut.

    A piece is closed by the row with which its sizes exceed ``capacity``, the same for all rows of a group; the next
    row begins the next piece, from zero again.  Where a piece begins depends on all cuts before; see ``ordered_scan``
    for how that is had without bringing a group together.
    """
    return ordered_scan(
        df, group, order, name, "bigint", cut_summary(size, capacity), cut_step, cut_assign(size, capacity), chunk_rows=chunk_rows
    )


def sum_before(df: DataFrame, group: list[str], order: list[str], size: str, name: str, *, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add the sum of ``size`` over the rows of the group before each."""

    def assign(table: pa.Table, state: int | None) -> pa.Array:
        sizes = table[size].to_numpy().astype(np.int64)
        return pa.array(np.cumsum(sizes) - sizes + (state or 0))

    return ordered_scan(
        df, group, order, name, "bigint", lambda t: int(t[size].to_numpy().astype(np.int64).sum()), lambda s, x: (s or 0) + x, assign, chunk_rows=chunk_rows
    )


def last_before(df: DataFrame, group: list[str], order: list[str], value: str, name: str, *, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add the last value (an integer) that is not null, of the group's rows up to and with each; null if there is none."""

    def latest(table: pa.Table) -> int | None:
        kept = table[value].drop_null()
        return kept[-1].as_py() if len(kept) else None

    def assign(table: pa.Table, state: int | None) -> pa.Array:
        own = table[value].combine_chunks()
        own = own.chunk(0) if isinstance(own, pa.ChunkedArray) else own
        known = own.is_valid().to_numpy(zero_copy_only=False)
        at = np.maximum.accumulate(np.where(known, np.arange(len(own)), -1))
        filled = own.take(pa.array(np.where(at < 0, 0, at)))
        return pa.array([state if i < 0 else v for i, v in zip(at.tolist(), filled.to_pylist())], pa.int64()) if (at < 0).any() else filled.cast(pa.int64())

    return ordered_scan(df, group, order, name, "bigint", latest, lambda s, x: s if x is None else x, assign, chunk_rows=chunk_rows)
