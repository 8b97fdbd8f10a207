"""Byte layouts of log records, internal keys, index entries and footers.

Sizes, checksums and fixed-width parts are expressions; a whole log in its byte form is read by
``keystrata.sources.wal``.  All integers are little-endian.
"""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed layout: length, checksum, operation, sequence, tombstone, key length, value length.
RECORD = struct.Struct("<IIBQBII")
#: Fixed layout of the 17 bytes after the user key: sequence, timestamp, tombstone.
KEY_TAIL = struct.Struct("<QQB")
FOOTER = struct.Struct("<II")
OPERATIONS = ("put", "del")


class Corrupted(ValueError):
    """The bytes are no valid record."""


def encode_record(op: str, sequence: int, key: bytes, value: bytes, tombstone: bool) -> bytes:
    """A log record; its length counts what follows length and checksum, its checksum covers the same bytes."""
    body = RECORD.pack(0, 0, OPERATIONS.index(op), sequence, tombstone, len(key), len(value))[8:] + key + value
    return struct.pack("<II", len(body), zlib.crc32(body)) + body


def decode_record(data: bytes, at: int = 0) -> tuple[dict, int]:
    """The record at ``at`` and the place after it.  EOFError at the end, ``Corrupted`` for anything broken."""
    left = len(data) - at
    if left == 0:
        raise EOFError
    if left < RECORD.size:
        raise Corrupted("record header is cut off")
    length, checksum, op, sequence, tombstone, key_length, value_length = RECORD.unpack_from(data, at)
    end = at + 8 + length
    if length < RECORD.size - 8 or end > len(data):
        raise Corrupted("record is cut off")
    if zlib.crc32(data[at + 8 : end]) != checksum:
        raise Corrupted("checksum differs")
    key_at = at + RECORD.size
    if key_at + key_length + value_length > end or op >= len(OPERATIONS):
        raise Corrupted("lengths exceed the record")
    key = data[key_at : key_at + key_length]
    value = data[key_at + key_length : key_at + key_length + value_length]
    return {"op": OPERATIONS[op], "sequence": sequence, "key": key, "value": value, "tombstone": bool(tombstone)}, end


def encode_varint(number: int) -> bytes:
    """Seven bits a byte, lowest first; the high bit says that more follow."""
    if not 0 <= number < 1 << 64:
        raise ValueError("varints hold 64 unsigned bits")
    out = bytearray()
    while number > 0x7F:
        out.append(number & 0x7F | 0x80)
        number >>= 7
    out.append(number)
    return bytes(out)


def decode_varint(data: bytes, at: int = 0) -> tuple[int, int]:
    number = 0
    for i in range(10):
        if at + i >= len(data):
            raise Corrupted("varint is cut off")
        number |= (data[at + i] & 0x7F) << (7 * i)
        if data[at + i] < 0x80:
            return number, at + i + 1
    raise Corrupted("varint is too long")


def encode_index(entries: list[tuple[bytes, int, int]]) -> bytes:
    """Block index: a count, then per block its smallest key with a varint length, its offset and its size."""
    out = [struct.pack("<I", len(entries))]
    for key, offset, size in entries:
        out.append(encode_varint(len(key)) + key + struct.pack("<QQ", offset, size))
    return b"".join(out)


def decode_index(data: bytes) -> list[tuple[bytes, int, int]]:
    if len(data) < 4:
        raise Corrupted("index is cut off")
    at, out = 4, []
    for _ in range(struct.unpack_from("<I", data)[0]):
        length, at = decode_varint(data, at)
        if at + length + 16 > len(data):
            raise Corrupted("index is cut off")
        out.append((data[at : at + length], *struct.unpack_from("<QQ", data, at + length)))
        at += length + 16
    return out


def encode_footer(offset: int, size: int) -> bytes:
    return FOOTER.pack(offset, size)


def decode_footer(data: bytes) -> tuple[int, int]:
    """The last eight bytes: offset, then size."""
    if len(data) < FOOTER.size:
        raise Corrupted("footer is cut off")
    return FOOTER.unpack(data[-FOOTER.size :])


def varint_size(number: Column) -> Column:
    """Bytes that a non-negative number takes as a varint."""
    size = F.lit(9)
    for n in range(8, 0, -1):
        size = F.when(number < F.lit(1 << (7 * n)), n).otherwise(size)
    return size


def little_endian(number: Column, width: int = 8) -> Column:
    """The bytes of a non-negative number, lowest first, through its hexadecimal form."""
    digits = F.lpad(F.hex(number.cast("long")), 2 * width, "0")
    return F.unhex(F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(width))]))


def from_little_endian(data: Column) -> Column:
    """The number in up to eight bytes, lowest first."""
    digits = F.hex(data)
    turned = F.array_join(F.reverse(F.regexp_extract_all(digits, F.lit("(..)"), 1)), "")
    return F.conv(turned, 16, 10).cast("long")


def encode_internal_key(key: Column, sequence: Column, timestamp: Column, tombstone: Column) -> Column:
    """User key, sequence, timestamp and tombstone as one byte string."""
    mark = F.when(tombstone, F.unhex(F.lit("01"))).otherwise(F.unhex(F.lit("00")))
    return F.concat(key, little_endian(sequence), little_endian(timestamp), mark)


def decode_internal_key(data: Column) -> Column:
    """Its parts, taken from the end; null where the bytes are fewer than the 17 of an empty key."""
    n = F.octet_length(data)
    parts = F.struct(
        F.substring(data, F.lit(1), n - 17).alias("user_key"),
        from_little_endian(F.substring(data, n - 16, F.lit(8))).alias("sequence"),
        from_little_endian(F.substring(data, n - 8, F.lit(8))).alias("timestamp_ms"),
        (F.hex(F.substring(data, n, F.lit(1))) == "01").alias("tombstone"),
    )
    return F.when(n >= 17, parts)


def encode_wal(op: Column, sequence: Column, key: Column, value: Column, tombstone: Column) -> Column:
    """A log record as an expression, with its checksum."""
    one, zero = F.unhex(F.lit("01")), F.unhex(F.lit("00"))
    body = F.concat(
        F.when(op == "del", one).otherwise(zero),
        little_endian(sequence),
        F.when(tombstone, one).otherwise(zero),
        little_endian(F.octet_length(key), 4),
        little_endian(F.octet_length(value), 4),
        key,
        value,
    )
    return F.concat(little_endian(F.octet_length(body), 4), little_endian(F.crc32(body), 4), body)


def interleave(a: Column, b: Column, bits: int = 31) -> Column:
    """Z-order: the low ``bits`` bits of two non-negative numbers, taken in turn; ``a`` has the lower of each pair."""

    def spread(x: Column) -> Column:
        # one term per bit: a fold by masks would name its operand twice in each step
        x = x.cast("long")
        terms = [F.shiftleft(F.shiftright(x, i).bitwiseAND(F.lit(1).cast("long")), 2 * i) for i in range(bits)]
        out = terms[0]
        for term in terms[1:]:
            out = out.bitwiseOR(term)
        return out

    return spread(a).bitwiseOR(F.shiftleft(spread(b), 1))
