import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from keystrata.operators import incremental
from keystrata.operators.incremental import IncrementalLoad, carried_by, latest_runs, sequence_words, word_sequences
from keystrata.sources.shared import SharedFiles, shared_dir

T0 = datetime(2025, 1, 1)
KEYS = ["source_name", "store_id"]
RECORDS = "source_name string, store_id bigint, sequence bigint, arrived_at timestamp_ntz, since string, watermark string"
RUNS = "source_name string, store_id bigint, started_at timestamp_ntz, status string, committed_sequence bigint"


def at(n):
    return None if n is None else T0 + timedelta(minutes=n)


def pending(spark, records, runs):
    rec = spark.createDataFrame([(*r[:3], at(r[3]), "x", "y") for r in records], RECORDS).drop("since")
    log = spark.createDataFrame([(*r[:2], at(r[2]), *r[3:]) for r in runs], RUNS)
    load = IncrementalLoad(spark, shared_dir(spark, "load"), KEYS, "sequence")
    load.adopt(carried_by(rec, latest_runs(log, KEYS, "started_at", "status", "committed_sequence"), KEYS, "arrived_at"))
    load.run(rec)
    out = load.output()
    return [] if out is None else sorted((r.source_name, r.store_id, r.sequence) for r in out.collect())


def test_late_repeated_and_failed(spark):
    runs = [
        ("w", 1, 10, "ok", 5), ("w", 1, 10, "ok", 5), ("w", 1, 20, "failed", 99), ("w", 1, 5, "ok", 3),
        ("w", 1, None, "ok", 9), ("w", 1, 30, None, 50), ("w", 3, 10, "running", 7),
    ]
    records = [
        ("w", 1, 5, 9), ("w", 1, 5, 40),  # carried, then delivered again
        ("w", 1, 4, 11), ("w", 1, 4, 12),  # late, below the watermark, twice
        ("w", 1, 6, 10),  # arrived just when the run began
        ("w", 1, 8, 15),
        ("w", 2, 1, 1), ("w", 3, 2, 1),  # no successful run
        ("w", 1, 3, None),  # never seen to arrive
        (None, 1, 1, 50), ("w", None, 1, 50), ("w", 1, None, 50),
    ]
    assert pending(spark, records, runs) == [("w", 1, 3), ("w", 1, 4), ("w", 1, 8), ("w", 2, 1), ("w", 3, 2)]


def test_empty(spark):
    assert pending(spark, [], []) == []
    assert pending(spark, [("w", 1, 1, 1)], []) == [("w", 1, 1)]


def test_words_hold_every_sequence(spark):
    numbers = [-130, -64, -1, 0, 1, 62, 63, 64, 127, 2**40, 2**62]
    df = spark.createDataFrame([(1, n) for n in numbers] * 2 + [(None, 5), (1, None)], "k int, s bigint")
    words = sequence_words(df, ["k"], "s")
    assert sorted(r.s for r in word_sequences(words, ["k"], "s").collect()) == numbers
    assert words.count() == 6


def frame(spark, rows):
    return spark.createDataFrame([(s, q, at(t), "p") for s, q, t in rows], "store_id bigint, sequence bigint, arrived_at timestamp_ntz, mark_word string")


def carried(load):
    out = load.output()
    return [] if out is None else sorted((r.store_id, r.sequence) for r in out.collect())


def test_nothing_that_lands_late_is_lost(spark):
    load = IncrementalLoad(spark, shared_dir(spark, "load"), ["store_id"], "sequence")
    first = [(1, 1, 1), (1, 5, 10)]
    load.run(frame(spark, first))
    # after the run: an equal time, an earlier time, no time; and a copy of what was carried
    second = [*first, (1, 3, 10), (1, 4, 9), (1, 9, None), (1, 5, 11), (1, 2, 0)]
    load.run(frame(spark, second))
    assert carried(load) == [(1, 1), (1, 2), (1, 3), (1, 4), (1, 5), (1, 9)]
    assert load.run(frame(spark, second)) is None
    mark = load.watermarks().first()
    assert (mark.watermark, mark.missing_below) == (9, 3)


@pytest.mark.parametrize("step", ["pending", "output", "state", "commit"])
def test_a_crash_after_any_step_skips_and_repeats_nothing(spark, step, monkeypatch):
    monkeypatch.setattr(incremental, "MERGE_RUNS", 1)

    class Crashing(IncrementalLoad):
        crash = None

        def reached(self, now):
            if now == self.crash:
                raise RuntimeError("lost")

    root = shared_dir(spark, "load")
    load = Crashing(spark, root, ["store_id"], "sequence")
    load.run(frame(spark, [(1, 1, 1), (2, 1, 1)]))
    load.crash = step
    rows = [(1, 1, 1), (2, 1, 1), (1, 3, 2), (2, 2, 2)]
    with pytest.raises(RuntimeError):
        load.run(frame(spark, rows))
    # what the source gets after the crash is carried too
    again = IncrementalLoad(spark, root, ["store_id"], "sequence")
    again.run(frame(spark, [*rows, (1, 2, 1)]))
    assert carried(again) == [(1, 1), (1, 2), (1, 3), (2, 1), (2, 2)]
    again.vacuum(older_than_s=-1)
    assert carried(again) == [(1, 1), (1, 2), (1, 3), (2, 1), (2, 2)]
    assert again.run(frame(spark, rows)) is None


def test_a_source_that_grows_during_a_run(spark, tmp_path):
    source = f"file://{tmp_path}/source"
    frame(spark, [(1, 1, 1), (1, 2, 1)]).write.parquet(source)

    class Growing(IncrementalLoad):
        def reached(self, now):
            if now == "pending":
                frame(spark, [(1, 7, 1), (1, 0, 1)]).write.mode("append").parquet(source)

    load = Growing(spark, shared_dir(spark, "load"), ["store_id"], "sequence")
    load.run(spark.read.parquet(source))
    spark.catalog.clearCache()
    assert carried(load) == [(1, 1), (1, 2)] and load.watermarks().first().watermark == 2
    IncrementalLoad.run(load, spark.read.parquet(source))
    assert carried(load)[:4] == [(1, 0), (1, 1), (1, 2), (1, 7)]


def test_random_deliveries_are_each_carried_once(spark, monkeypatch):
    monkeypatch.setattr(incremental, "MERGE_RUNS", 2)
    rng, delivered = random.Random(6), []
    load = IncrementalLoad(spark, shared_dir(spark, "load"), ["store_id"], "sequence")
    for _ in range(4):
        delivered += [(rng.choice([1, 1, 2]), rng.randint(-50, 400), rng.choice([None, 1, 2, 3])) for _ in range(120)]
        load.run(frame(spark, delivered))
        assert carried(load) == sorted({d[:2] for d in delivered})


def test_contradicting_copies_and_two_runs_at_once(spark):
    root = shared_dir(spark, "load")
    load, other = (IncrementalLoad(spark, root, ["store_id"], "sequence") for _ in range(2))
    rows = spark.createDataFrame([(1, 1, "a"), (1, 1, "b"), (1, 1, None)], "store_id int, sequence bigint, v string")
    last = load._last()
    load.run(rows)
    assert [r.v for r in load.output().collect()] == ["b"]
    with pytest.raises(RuntimeError):
        other._commit(last, [], [], 0)
    load.run(rows.union(spark.createDataFrame([(1, 2, "x")], rows.schema)), lambda df: df.withColumn("v", F.upper("v")))
    assert sorted(r.v for r in load.output().collect()) == ["X", "b"]
    with pytest.raises(ValueError):
        load.adopt(rows)


def test_commit_is_not_replaced(spark):
    files = SharedFiles(spark, shared_dir(spark, "files"))
    assert files.create("commits/1.json", "a") and not files.create("commits/1.json", "b")
    assert files.read("commits/1.json") == "a"
    assert [n for n in files.list("commits") if not n.startswith(".")] == ["1.json"]
