import random
import zlib

import pytest
from pyspark.sql import functions as F

from keystrata.functions import codec
from keystrata.sources.runfile import RunFile, decode_block, encode_block, read_runs, write_runs
from keystrata.sources.shared import shared_dir
from keystrata.sources.wal import read_log, register

# the golden vectors of the documented layout
GOLDEN = [
    (("put", 42, b"hello", b"world", False), "1c0000001a863b59002a0000000000000000050000000500000068656c6c6f776f726c64"),
    (("del", 100, b"removed", b"", True), "1900000099bf21eb01640000000000000001070000000000000072656d6f766564"),
    (("put", 0, b"", b"", False), "120000004dcf1b67000000000000000000000000000000000000"),
    (("put", 1, b"k", b"v", False), "140000002bc5c6c30001000000000000000001000000010000006b76"),
]


@pytest.mark.parametrize("record, data", GOLDEN)
def test_records(spark, record, data):
    assert codec.encode_record(*record).hex() == data
    decoded, end = codec.decode_record(bytes.fromhex(data))
    assert end == len(data) // 2
    assert (decoded["op"], decoded["sequence"], decoded["key"], decoded["value"], decoded["tombstone"]) == record
    row = spark.createDataFrame([record], "op string, sequence bigint, key binary, value binary, tombstone boolean")
    encoded = codec.encode_wal(*[F.col(c) for c in row.columns[:4]], F.col("tombstone"))
    assert bytes(row.select(encoded.alias("r")).first()["r"]).hex() == data


def test_broken_records():
    good = bytes.fromhex(GOLDEN[0][1])
    with pytest.raises(EOFError):
        codec.decode_record(b"")
    for bad in (good[:25], good[:30], good[:4] + bytes([good[4] ^ 1]) + good[5:], good[:10] + bytes([good[10] ^ 1]) + good[11:]):
        with pytest.raises(codec.Corrupted):
            codec.decode_record(bad)
    body = bytearray(good[8:])
    body[10:14] = (9999).to_bytes(4, "little")
    with pytest.raises(codec.Corrupted):
        codec.decode_record(good[:4] + zlib.crc32(bytes(body)).to_bytes(4, "little") + bytes(body))


def test_varints(spark):
    assert codec.encode_varint(300) == b"\xac\x02"
    sizes = {0: 1, 1: 1, 127: 1, 128: 2, 300: 2, 16384: 3, 1 << 20: 3, 1 << 21: 4, 1 << 32: 5, (1 << 63) - 1: 9}
    for n, size in sizes.items():
        assert len(codec.encode_varint(n)) == size and codec.decode_varint(codec.encode_varint(n)) == (n, size)
    df = spark.createDataFrame([(n,) for n in sizes], "n bigint")
    assert {r.n: r.s for r in df.withColumn("s", codec.varint_size(F.col("n"))).collect()} == sizes
    assert codec.decode_varint(codec.encode_varint((1 << 64) - 1))[0] == (1 << 64) - 1
    for bad in (b"\x80", b"\x80" * 11, b""):
        with pytest.raises(codec.Corrupted):
            codec.decode_varint(bad)


def test_footer_and_index():
    assert codec.encode_footer(0x11223344, 0x55667788).hex() == "4433221188776655"
    assert codec.decode_footer(b"xx" + codec.encode_footer(7, 9)) == (7, 9)
    entries = [(b"alpha", 10, 7), (b"bravo", 200, 77), (b"charlie", 3000, 777)]
    data = "0300000005616c7068610a00000000000000070000000000000005627261766fc8000000000000004d0000000000000007636861726c6965b80b0000000000000903000000000000"
    assert codec.encode_index(entries).hex() == data and codec.decode_index(bytes.fromhex(data)) == entries
    with pytest.raises(codec.Corrupted):
        codec.decode_index(bytes.fromhex(data)[:-1])


def test_internal_keys_and_checksums(spark):
    rows = [(b"hello", 42, 42, False), (b"k", 1, 1, True), (b"", 0, 0, False), (b"\xff\x00\xfe", (1 << 62) + 5, 7, True)]
    df = spark.createDataFrame(rows, "user_key binary, sequence bigint, timestamp_ms bigint, tombstone boolean")
    encoded = df.select("*", codec.encode_internal_key(*[F.col(c) for c in df.columns]).alias("e"))
    got = encoded.select(F.hex("e").alias("h"), codec.decode_internal_key(F.col("e")).alias("d"), "user_key", "sequence", "timestamp_ms", "tombstone").collect()
    assert got[0].h == "68656C6C6F2A000000000000002A0000000000000000" and got[1].h == "6B0100000000000000010000000000000001"
    for r in got:
        assert (bytes(r.d.user_key), r.d.sequence, r.d.timestamp_ms, r.d.tombstone) == (bytes(r.user_key), r.sequence, r.timestamp_ms, r.tombstone)
    assert spark.createDataFrame([(b"short",)], "e binary").select(codec.decode_internal_key(F.col("e")).alias("d")).first().d is None
    words = {b"": 0, b"123456789": 0xCBF43926, b"The quick brown fox jumps over the lazy dog": 0x414FA339}
    df = spark.createDataFrame([(w,) for w in words], "w binary")
    assert {bytes(r.w): r.c for r in df.withColumn("c", F.crc32("w")).collect()} == words


def test_z_order(spark):
    df = spark.createDataFrame([(3, 5), (0, 0), ((1 << 31) - 1, 0), (None, 1)], "a bigint, b bigint")
    got = [r.z for r in df.select(codec.interleave(F.col("a"), F.col("b")).alias("z")).collect()]
    assert got == [0b100111, 0, int("01" * 31, 2), None]


def test_log_files(spark, tmp_path):
    register(spark)
    rows = [("put" if i % 3 else "del", i, f"k{i}".encode(), b"" if i % 3 == 0 else b"v" * i, i % 3 == 0) for i in range(1, 60)]
    df = spark.createDataFrame(rows, "op string, sequence bigint, key binary, value binary, tombstone boolean").repartition(3)
    folder = str(tmp_path / "log")
    df.write.format("keystrata_wal").mode("append").save(folder)
    back = spark.read.format("keystrata_wal").load(folder)
    assert sorted((r.op, r.sequence, bytes(r.key), bytes(r.value), r.tombstone) for r in back.collect()) == sorted(rows)
    single = tmp_path / "one.wal"
    data = b"".join(codec.encode_record(*r) for r in rows[:3])
    single.write_bytes(data)
    assert [r[3] for r in read_log(str(single))] == [1, 2, 3]
    broken = bytearray(data)
    broken[len(codec.encode_record(*rows[0])) + 9] ^= 1
    single.write_bytes(bytes(broken))
    assert [r[3] for r in read_log(str(single), "lenient")] == [1]
    assert [r[2:4] for r in read_log(str(single), "marked")] == [("put", 1), (None, None)]
    assert [r[3] for r in read_log(single.as_uri(), "lenient")] == [1]
    with pytest.raises(codec.Corrupted):
        list(read_log(str(single)))
    with pytest.raises(Exception, match="record 1"):
        spark.read.format("keystrata_wal").load(str(single)).collect()
    assert spark.read.format("keystrata_wal").option("mode", "lenient").load(str(single)).count() == 1
    single.write_bytes(b"")
    assert spark.read.format("keystrata_wal").load(str(single)).count() == 0
    with pytest.raises(Exception):
        spark.read.format("keystrata_wal").load(str(tmp_path / "absent.wal")).collect()


def test_run_files(spark):
    block = encode_block([(b"a" * 18, b"v"), (b"", b"")])
    assert decode_block(block) == [(b"a" * 18, b"v"), (b"", b"")]
    with pytest.raises(codec.Corrupted):
        decode_block(block[:-1] + b"x")
    rows = []
    for run in (1, 2):
        for i in range(300):
            rows.append((1, run, f"k{i:04d}".encode(), 1000 * run + i, i, i % 7 == 0, b"" if i % 7 == 0 else b"v" * (i % 50)))
        rows += [(1, run, b"same", 5000 + i, 0, False, b"w" * 100) for i in range(60)]
    df = spark.createDataFrame(rows, "store_id bigint, run_id bigint, key binary, sequence bigint, timestamp_ms bigint, tombstone boolean, value binary")
    folder = shared_dir(spark, "runs")
    files = write_runs(df, folder, target=512).collect()
    assert {(f.store_id, f.run_id) for f in files} == {(1, 1), (1, 2)} and all(f.first_key <= f.last_key for f in files)
    back = read_runs(spark, spark.createDataFrame([(f.path,) for f in files], "path string")).collect()
    assert sorted((bytes(r.key), r.sequence, r.timestamp_ms, r.tombstone, bytes(r.value)) for r in back) == sorted(r[2:] for r in rows)
    def get(number, key):
        """The newest entry over the files of a run that may hold the key."""
        found = [RunFile(f.path).get(key) for f in files if f.run_id == number and f.first_key <= key <= f.last_key]
        return max((e for e in found if e), key=lambda e: e[1], default=None)

    assert sum(len(RunFile(f.path).index) for f in files) > 20 and get(1, b"k0008") == (b"k0008", 1008, 8, False, b"v" * 8)
    assert get(2, b"k0007")[3] and get(2, b"same")[1] == 5059
    assert get(1, b"") is None and get(1, b"k00075") is None and get(1, b"zz") is None
    run = RunFile(files[0].path)
    assert [e[0] for e in run] == sorted(e[0] for e in run)
    local = files[0].path.removeprefix("file://")
    data = open(local, "rb").read()
    open(local, "wb").write(data[:30] + bytes([data[30] ^ 1]) + data[31:])
    with pytest.raises(codec.Corrupted):
        list(RunFile(files[0].path))
    open(local, "wb").write(b"")
    with pytest.raises(codec.Corrupted):
        RunFile(files[0].path)


@pytest.mark.parametrize("name", ["none", "lz4", "zstd", "snappy"])
@pytest.mark.parametrize("restart", [0, 1, 4, 16])
def test_blocks_with_codecs_and_shared_keys(name, restart):
    rng = random.Random(restart)
    for n in (0, 1, 2, 40):
        keys = sorted(bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12))) + b"t" * 17 for _ in range(n))
        entries = [(k, b"v" * rng.randint(0, 300)) for k in keys]
        data = encode_block(entries, name, restart)
        assert decode_block(data) == entries
        if n == 40:
            assert len(data) < len(encode_block(entries)) or (name, restart) in (("none", 0), ("none", 1))
            for at in (0, 12, len(data) - 1):
                with pytest.raises(codec.Corrupted):
                    decode_block(data[:at] + bytes([data[at] ^ 255]) + data[at + 1 :] if at else data[:-1])


def test_segments_of_logs_end_at_the_first_broken_record(spark):
    from keystrata.sources.wal import recover_segments, write_segments

    rows, expected = [], {}
    for store, bad in ((1, 25), (2, None), (3, 1)):
        for q in range(1, 41):
            record = codec.encode_record("put", q, f"k{q}".encode(), b"v", False)
            rows.append((store, q, record[:-1] + bytes([record[-1] ^ 1]) if q in (bad, 33 if bad else None) else record))
        expected[store] = list(range(1, bad or 41))
    random.Random(2).shuffle(rows)
    path = shared_dir(spark, "segments")
    assert write_segments(spark.createDataFrame(rows, "store_id bigint, sequence bigint, record binary"), path, 10).count() == 15
    got = {}
    for r in recover_segments(spark, path).collect():
        got.setdefault(r.store_id, []).append(r.sequence)
    assert {s: sorted(q) for s, q in got.items()} == {s: q for s, q in expected.items() if q}
