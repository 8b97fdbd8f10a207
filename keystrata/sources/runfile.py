"""Run files in their byte form: data blocks, block index and footer.

A file is a sequence of data blocks, then the index, then the footer.  A block has a header (entry count, both
sizes, compression, checksum) and entries of an internal key and a value, each with a varint length.  Blocks are
closed when the size that their entries count for reaches the target.  The checksum of a block is over its body as it
is stored.  Two things are options of a block and told by its header: a codec for its body, and keys that leave out
what they share with the key before them.
"""

from __future__ import annotations

import bisect
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.functions.codec import (
    KEY_TAIL, Corrupted, decode_footer, decode_index, decode_varint, encode_footer, encode_index, encode_varint,
)
from keystrata.sources.files import locate, scheme, size_of

HEADER = struct.Struct("<IIIII")
BLOCK_BYTES = 4096
#: Numbers of the codecs in a header, the first two as the format has them; and the sign of shared keys.
CODECS = {"none": 0, "lz4": 1, "zstd": 2, "snappy": 3}
SHARED_KEYS = 1 << 8
#: Keys from one that is stored whole to the next.
RESTART = 16
_CODEC_NAMES = {0: None, 1: "lz4_raw", 2: "zstd", 3: "snappy"}


def _shared(a: bytes, b: bytes) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def encode_block(entries: list[tuple[bytes, bytes]], codec: str = "none", restart: int = 0) -> bytes:
    """A block; with ``restart`` only every so many keys are stored whole, the others after what they share."""
    parts, before = [], b""
    for i, (key, value) in enumerate(entries):
        if restart:
            shared = _shared(before, key) if i % restart else 0
            parts += [encode_varint(shared), encode_varint(len(key) - shared), key[shared:]]
            before = key
        else:
            parts += [encode_varint(len(key)), key]
        parts += [encode_varint(len(value)), value]
    raw = b"".join(parts)
    name = _CODEC_NAMES[CODECS[codec]]
    body = pa.compress(raw, codec=name, asbytes=True) if name and raw else raw
    kind = CODECS[codec] | (SHARED_KEYS if restart else 0)
    return HEADER.pack(len(entries), len(raw), len(body), kind, zlib.crc32(body)) + body


def decode_block(data: bytes) -> list[tuple[bytes, bytes]]:
    if len(data) < HEADER.size:
        raise Corrupted("block is cut off")
    count, raw_size, size, kind, checksum = HEADER.unpack_from(data)
    body = data[HEADER.size : HEADER.size + size]
    if len(body) != size or zlib.crc32(body) != checksum:
        raise Corrupted("block's checksum differs")
    if kind & ~SHARED_KEYS not in _CODEC_NAMES:
        raise Corrupted("block's compression is unknown")
    name = _CODEC_NAMES[kind & ~SHARED_KEYS]
    if name and raw_size:
        body = pa.decompress(body, decompressed_size=raw_size, codec=name, asbytes=True)

    def take(at: int, before: bytes = b"") -> tuple[bytes, int]:
        n, at = decode_varint(body, at)
        if at + n > raw_size:
            raise Corrupted("entry is cut off")
        return before + body[at : at + n], at + n

    at, out, key = 0, [], b""
    for _ in range(count):
        if kind & SHARED_KEYS:
            shared, at = decode_varint(body, at)
            if shared > len(key):
                raise Corrupted("key shares more than there is")
            key, at = take(at, key[:shared])
        else:
            key, at = take(at)
        value, at = take(at)
        out.append((key, value))
    return out


def encode_run(entries: Iterable[tuple[bytes, int, int, bool, bytes]], target: int = BLOCK_BYTES, codec: str = "none", restart: int = 0) -> Iterator[bytes]:
    """The bytes of a run, block by block, of (user key, sequence, timestamp, tombstone, value) in key order."""
    block, counted, index, offset = [], 0, [], 0

    def close() -> bytes:
        data = encode_block(block, codec, restart)
        index.append((block[0][0][: -KEY_TAIL.size], offset, len(data)))
        return data

    for key, sequence, timestamp, tombstone, value in entries:
        internal = key + KEY_TAIL.pack(sequence, timestamp, tombstone)
        block.append((internal, value))
        counted += 8 + len(internal) + len(value)
        if counted >= target:
            data = close()
            yield data
            offset, block, counted = offset + len(data), [], 0
    if block:
        data = close()
        yield data
        offset += len(data)
    tail = encode_index(index)
    yield tail
    yield encode_footer(offset, len(tail))


class RunFile:
    """A run opened for reading: footer and index are held, blocks are read one at a time."""

    def __init__(self, path: str):
        self._files, self.path = locate(path)
        size = size_of(self._files, self.path)
        if not size:
            raise Corrupted("file is empty")
        with self._files.open_input_file(self.path) as f:
            f.seek(max(0, size - 8))
            offset, length = decode_footer(f.read())
            if offset + length + 8 > size:
                raise Corrupted("footer points outside the file")
            f.seek(offset)
            self.index = decode_index(f.read(length))
        self._smallest = [k for k, _, _ in self.index]

    def block(self, number: int) -> list[tuple[bytes, int, int, bool, bytes]]:
        _, offset, size = self.index[number]
        with self._files.open_input_file(self.path) as f:
            f.seek(offset)
            pairs = decode_block(f.read(size))
        return [(k[: -KEY_TAIL.size], *self._tail(k), v) for k, v in pairs]

    @staticmethod
    def _tail(key: bytes) -> tuple[int, int, bool]:
        if len(key) < KEY_TAIL.size:
            raise Corrupted("internal key is cut off")
        sequence, timestamp, tombstone = KEY_TAIL.unpack(key[-KEY_TAIL.size :])
        return sequence, timestamp, bool(tombstone)

    def get(self, key: bytes) -> tuple[bytes, int, int, bool, bytes] | None:
        """The newest entry of a key, a tombstone too; None if the run never had it.

        The last block that begins below the key may hold it, and so may those that begin with it: a key's
        versions can run over a block's end.
        """
        first = max(0, bisect.bisect_left(self._smallest, key) - 1)
        best = None
        for number in range(first, bisect.bisect_right(self._smallest, key)):
            for entry in self.block(number):
                if entry[0] == key and (best is None or entry[1] > best[1]):
                    best = entry
        return best

    def __iter__(self):
        for number in range(len(self.index)):
            yield from self.block(number)


def write_runs(entries: DataFrame, path: str, target: int = BLOCK_BYTES, *, codec: str = "none", restart: int = 0) -> DataFrame:
    """Write each (store_id, run_id) below ``path``, a folder that all executors share, and name the files.

    Rows are range partitioned by run and key, so a run of any size is written by many tasks: it is one file, or
    several of successive keys, with their first and last key.  No block but the current one is held.  A file gets
    its name when it is whole, so a task that is repeated leaves the same file.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, at = locate(path)
        files.create_dir(at)
        part = TaskContext.get().partitionId()
        rows = (r for b in batches for r in zip(*[b.column(i).to_pylist() for i in range(7)]))
        row = next(rows, None)
        while row is not None:
            store, run = row[:2]
            first = last = row[2]

            def own():
                nonlocal row, last
                while row is not None and row[:2] == (store, run):
                    last = row[2]
                    yield row[2], row[3], row[4] or 0, bool(row[5]), row[6] or b""
                    row = next(rows, None)

            name, hidden, size = f"{at}/{store}-{run}-{part:05d}.run", f"{at}/.{uuid.uuid4().hex}", 0
            with files.open_output_stream(hidden) as out:
                for data in encode_run(own(), target, codec, restart):
                    out.write(data)
                    size += len(data)
            files.move(hidden, name)
            yield pa.RecordBatch.from_pylist(
                [{"store_id": store, "run_id": run, "path": scheme(path) + name, "bytes": size, "first_key": first, "last_key": last}]
            )

    ordered = entries.select("store_id", "run_id", "key", "sequence", "timestamp_ms", "tombstone", "value").withColumn("newest", -F.col("sequence"))
    ordered = ordered.repartitionByRange("store_id", "run_id", "key", "newest").sortWithinPartitions("store_id", "run_id", "key", "newest").drop("newest")
    return ordered.mapInArrow(write, "store_id bigint, run_id bigint, path string, bytes bigint, first_key binary, last_key binary")


def read_runs(spark: SparkSession, paths: DataFrame) -> DataFrame:
    """The entries of run files, from a frame with their ``path``; block by block, checksums verified."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "block_no", "key", "sequence", "timestamp_ms", "tombstone", "value"]
        types = [pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
        for batch in batches:
            for path in batch.column(0).to_pylist():
                run = RunFile(path)
                for number in range(len(run.index)):
                    rows = run.block(number)
                    columns = [[path] * len(rows), [number] * len(rows), *map(list, zip(*rows))]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    schema = "path string, block_no bigint, key binary, sequence bigint, timestamp_ms bigint, tombstone boolean, value binary"
    return paths.select("path").mapInArrow(read, schema)
