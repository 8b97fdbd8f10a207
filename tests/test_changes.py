import random
from datetime import datetime

from keystrata.sources.shared import shared_dir
from keystrata.streaming.cdc import apply_changes, change_rows, current_state, rebuild_from_files

SCHEMA = "store_id bigint, op string, sequence bigint, key binary, value binary, tombstone boolean, arrived_at timestamp_ntz, last string, deleted string"
NAMES = {False: ["put", "PUT ", "0", " Put"], True: ["del", "DEL", " 1", "Del "]}


def rows_of(n, seed):
    rng = random.Random(seed)
    known, rows = {}, []
    for _ in range(n):
        store, sequence = rng.randint(1, 2), rng.randint(1, n)
        if (store, sequence) not in known:
            key = b"hot" if rng.random() < 0.35 else bytes([rng.randint(0, 9)]) * rng.randint(0, 2)
            known[store, sequence] = (key, rng.random() < 0.3, bytes([rng.randint(0, 3)]))
        key, dead, value = known[store, sequence]
        op, tombstone = (rng.choice(NAMES[dead]), dead) if rng.random() < 0.8 else (None, dead) if rng.random() < 0.5 else (rng.choice(NAMES[dead]), None)
        rows.append((store, op, sequence, key, (None if rng.random() < 0.5 else b"") if dead else value, tombstone, datetime(2025, 1, 1), "x", "y"))
    return rows


def brute(rows):
    last = {}
    for store, op, sequence, key, value, tombstone, *_ in rows:
        if store is None or sequence is None or key is None:
            continue
        dead = op.strip().lower() in ("del", "1") if op is not None else bool(tombstone)
        if sequence >= last.get((store, key), (-1,))[0]:
            last[store, key] = (sequence, dead, value)
    return {(s, k, q, v) for (s, k), (q, d, v) in last.items() if not d}


def collected(df):
    return {(r.store_id, bytes(r.key), r.sequence, None if r.value is None else bytes(r.value)) for r in df.collect()}


def test_files_in_any_order(spark, tmp_path):
    rows = rows_of(400, 1)
    for i in range(4):
        spark.createDataFrame(rows[i::4], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "feed"))
    found = rebuild_from_files(spark, str(tmp_path / "feed"), {"store_id": "store_id", "key": "key"}, files_per_batch=1)
    assert collected(found) == brute(rows)


def test_later_files_and_repeated_batches(spark, tmp_path):
    feed, work = str(tmp_path / "feed"), shared_dir(spark, "test")
    rows = rows_of(300, 2)
    keys = {"store_id": "store_id", "key": "key"}
    for part in (rows[:150], rows[150:], rows[:50]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(feed)
        stream = change_rows(spark.readStream.schema(SCHEMA).parquet(feed), keys, "op", "sequence", "tombstone", "value")
        apply_changes(spark, stream, list(keys), f"{work}/out", f"{work}/state")
    schema = change_rows(spark.createDataFrame([], SCHEMA), keys, "op", "sequence", "tombstone", "value").schema
    assert collected(current_state(spark, f"{work}/out", list(keys), schema)) == brute(rows)


def test_nulls_and_empty(spark, tmp_path):
    none = str(tmp_path / "none")
    spark.createDataFrame([], SCHEMA).write.parquet(none)
    assert rebuild_from_files(spark, none, {"store_id": "store_id", "key": "key"}).count() == 0
    rows = [
        (None, "put", 1, b"k", b"v", False, None, "", ""), (1, "put", None, b"k", b"v", False, None, "", ""),
        (1, "put", 1, None, b"v", False, None, "", ""), (1, None, 2, b"", b"", None, None, "", ""),
        (1, "put", 3, b"long", b"v" * 300_000, False, None, None, None), (1, "gone?", 4, b"odd", b"v", True, None, "", ""),
    ]
    some = str(tmp_path / "some")
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(some)
    found = rebuild_from_files(spark, some, {"store_id": "store_id", "key": "key"})
    assert collected(found) == {(1, b"", 2, b""), (1, b"long", 3, b"v" * 300_000)}
