import random

from pyspark.sql import functions as F

from keystrata.operators.history import as_of, version_history

SCHEMA = "store_id bigint, user_key binary, sequence bigint, tombstone boolean, value binary, p string, chunk int, k0 string"


def brute(rows):
    records = {}
    for store, key, sequence, dead, value, *_ in rows:
        if store is None or key is None or sequence is None:
            continue
        state = (bool(dead), b"" if dead or value is None else value, bool(dead) or value is None)
        at = records.setdefault((store, key), {})
        at[sequence] = max(at.get(sequence, state), state)
    out = set()
    for (store, key), by in records.items():
        last, opened = None, None
        for sequence in sorted(by):
            state = by[sequence]
            if state != last:
                if opened is not None:
                    out.add((store, key, opened, sequence))
                opened = None if state[0] else sequence
                last = state
        if opened is not None:
            out.add((store, key, opened, -1))
    return out


def run(spark, rows, **how):
    df = spark.createDataFrame(rows, SCHEMA)
    found = version_history(df, ["store_id", "user_key"], "sequence", "tombstone", "value", **how).collect()
    got = [(r.store_id, bytes(r.user_key), r.valid_from, r.valid_to) for r in found]
    assert len(got) == len(set(got))
    return set(got)


def random_rows(n, seed):
    rng = random.Random(seed)
    state = {}
    rows = []
    for _ in range(n):
        store, sequence = rng.randint(1, 2), rng.randint(1, n)
        if (store, sequence) not in state:
            key = b"hot" if rng.random() < 0.4 else bytes([rng.randint(0, 255) for _ in range(rng.randint(0, 2))])
            dead = rng.choice([True, False, False, None])
            state[store, sequence] = (key, dead, rng.choice([b"", b"a", b"b"]) if not dead else rng.choice([None, b""]))
        rows.append((store, state[store, sequence][0], sequence, *state[store, sequence][1:], "x", 1, "y"))
    return rows


def test_against_brute_force(spark):
    rows = random_rows(600, 1)
    assert run(spark, rows) == brute(rows)


def test_hot_entities_in_chunks(spark):
    rows = random_rows(600, 2)
    assert run(spark, rows, group_rows=20, chunk_sequences=16) == brute(rows)
    assert run(spark, rows, group_rows=1, chunk_sequences=1) == brute(rows)


def test_nulls_ties_and_empty(spark):
    assert run(spark, []) == set()
    rows = [
        (None, b"k", 1, False, b"a", "", 0, ""),
        (1, None, 1, False, b"a", "", 0, ""),
        (1, b"k", None, False, b"a", "", 0, ""),
        (1, b"k", 5, False, None, "", 0, ""),
        (1, b"k", 6, None, None, "", 0, ""),
        (1, b"k", 7, False, b"a", None, None, None),
        (1, b"k", 7, False, b"b", None, None, None),  # contradicts: the greater value counts
        (1, b"k", 8, False, b"b", None, None, None),
        (1, b"k", 9, True, None, None, None, None),
        (1, b"k", 9, True, b"", None, None, None),
        (1, b"", 3, True, None, None, None, None),
        (1, b"L", 4, False, b"x" * 200_000, None, None, None),
    ]
    expected = {(1, b"k", 5, 7), (1, b"k", 7, 9), (1, b"L", 4, -1)}
    assert run(spark, rows) == expected
    assert run(spark, rows, group_rows=1, chunk_sequences=2) == expected


def test_as_of(spark):
    rows = [(1, b"k", 1, False, b"a", "", 0, ""), (1, b"k", 5, True, None, "", 0, ""), (1, b"k", 9, False, b"c", "", 0, "")]
    history = version_history(spark.createDataFrame(rows, SCHEMA), ["store_id", "user_key"], "sequence", "tombstone", "value")
    assert [bytes(r.value) for r in as_of(history, 3).collect()] == [b"a"]
    assert as_of(history, 6).count() == 0
    assert [bytes(r.value) for r in as_of(history, 100).select(F.col("value")).collect()] == [b"c"]
