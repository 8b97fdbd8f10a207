"""A data source for logs in their byte form: ``spark.read.format("keystrata_wal").load(path)``.

Each file is one log of variable-length records and is read as one partition, record by record.  Strict reading
fails at the first broken record; with ``mode=lenient`` it ends there, and with ``mode=marked`` it ends there with a
row whose ``op`` is null.  A missing file fails, an empty one is an empty log.  Writing gives one file per task and is
committed by renaming.  Files may be on any file system that ``sources.files`` knows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from keystrata.functions.codec import RECORD, Corrupted, decode_record, encode_record
from keystrata.sources.files import list_files, locate, scheme, size_of

SCHEMA = "file string, record_no bigint, op string, sequence bigint, key binary, value binary, tombstone boolean"


def read_log(path: str, mode: str = "strict") -> Iterator[tuple]:
    """The records of a file; what is held is one record."""
    files, at = locate(path)
    size, done, number = size_of(files, at), 0, 0
    with files.open_input_stream(at, buffer_size=1 << 20) as log:
        while True:
            head = log.read(8)
            if not head:
                return
            done += len(head)
            length = int.from_bytes(head[:4], "little") if len(head) == 8 else 0
            try:
                if len(head) < 8 or length > size - done or length < RECORD.size - 8:
                    raise Corrupted("record is cut off")
                record, _ = decode_record(head + log.read(length))
                done += length
            except Corrupted as e:
                if mode == "marked":
                    yield (path, number, None, None, None, None, None)
                if mode in ("lenient", "marked"):
                    return
                raise Corrupted(f"{path}, record {number}: {e}") from None
            yield (path, number, record["op"], record["sequence"], record["key"], record["value"], record["tombstone"])
            number += 1


@dataclass
class LogFile(InputPartition):
    path: str


class WalReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.mode = options["path"], options.get("mode", "strict")

    def partitions(self):
        files, at = locate(self.path)
        found = list_files(files, at, ".wal")
        for f in found:
            size_of(files, f)
        return [LogFile(scheme(self.path) + f) for f in found]

    def read(self, partition):
        yield from read_log(partition.path, self.mode)


@dataclass
class Written(WriterCommitMessage):
    hidden: str
    final: str


class WalWriter(DataSourceWriter):
    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite

    def write(self, rows):
        files, at = locate(self.path)
        files.create_dir(at)
        name = f"{uuid.uuid4().hex}.wal"
        with files.open_output_stream(f"{at}/.{name}") as out:
            for r in rows:
                out.write(encode_record(r["op"], r["sequence"], bytes(r["key"]), bytes(r["value"]), r["tombstone"]))
        return Written(f"{at}/.{name}", f"{at}/{name}")

    def commit(self, messages):
        files, at = locate(self.path)
        old = list_files(files, at, ".wal") if self.overwrite else []
        for m in messages:
            if m is not None:
                files.move(m.hidden, m.final)
        for f in old:
            if f != at:
                files.delete_file(f)

    def abort(self, messages):
        files, _ = locate(self.path)
        for m in messages:
            if m is not None and files.get_file_info(m.hidden).is_file:
                files.delete_file(m.hidden)


class WalDataSource(DataSource):
    @classmethod
    def name(cls):
        return "keystrata_wal"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WalReader(self.options)

    def writer(self, schema, overwrite):
        return WalWriter(self.options, overwrite)


def register(spark) -> None:
    spark.dataSource.register(WalDataSource)


def write_segments(records: DataFrame, path: str, segment: int = 1 << 16) -> DataFrame:
    """Write each store's log as segments of so many sequences, ``<store>-<number>.wal`` below ``path``; names them.

    ``records``: store_id, sequence, record (its bytes).  A segment is bounded, so a store's log is written by many
    tasks.  A file gets its name when it is whole, so a task that is repeated leaves the same file.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, at = locate(path)
        files.create_dir(at)
        out, current, hidden = None, None, None

        def close():
            out.close()
            files.move(hidden, f"{at}/{current[0]}-{current[1]:012d}.wal")

        for batch in batches:
            done = []
            for store, number, record in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if (store, number) != current:
                    if out is not None:
                        close()
                    current, hidden = (store, number), f"{at}/.{uuid.uuid4().hex}"
                    out = files.open_output_stream(hidden)
                    done.append(current)
                out.write(record)
            if done:
                yield pa.RecordBatch.from_pylist([{"store_id": s, "segment": n} for s, n in done])
        if out is not None:
            close()

    cut = records.select("store_id", F.floor(F.col("sequence") / segment).alias("segment"), "record", "sequence")
    ordered = cut.repartition("store_id", "segment").sortWithinPartitions("store_id", "segment", "sequence").drop("sequence")
    return ordered.mapInArrow(write, "store_id bigint, segment bigint")


def recover_segments(spark: SparkSession, path: str) -> DataFrame:
    """What a recovery keeps of the logs that ``write_segments`` wrote: each store's records before its first broken one.

    Every segment is read up to its own first broken record; the first segment of a store that has one ends the log.
    """
    register(spark)
    rows = spark.read.format("keystrata_wal").option("mode", "marked").load(path)
    named = rows.select(
        F.regexp_extract("file", r"(\d+)-(\d+)\.wal$", 1).cast("long").alias("store_id"),
        F.regexp_extract("file", r"(\d+)-(\d+)\.wal$", 2).cast("long").alias("segment"),
        "record_no", "op", "sequence", "key", "value", "tombstone",
    )
    # one row per broken segment
    ends = named.where("op IS NULL").groupBy("store_id").agg(F.min("segment").alias("last_segment"))
    kept = named.where("op IS NOT NULL").join(F.broadcast(ends), "store_id", "left")
    return kept.where(F.col("last_segment").isNull() | (F.col("segment") <= F.col("last_segment"))).drop("last_segment", "record_no")
