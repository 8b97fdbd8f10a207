import random

import pytest
from pyspark.sql import functions as F

from keystrata.engine import Engine, NotFound
from keystrata.sources.shared import shared_dir


@pytest.fixture
def engine(spark):
    return Engine.open(spark, shared_dir(spark, "engine"))


def content(df):
    return {bytes(r.key): bytes(r.value) for r in df.collect()}


def test_scenarios(spark, engine):
    with pytest.raises(NotFound):
        engine.get(b"missing")
    assert engine.next_sequence == 1 and engine.scan().count() == 0
    assert engine.write([]) == 0
    engine.put(b"key1", b"value1")
    assert engine.get(b"key1") == b"value1"
    engine.write([(b"key", b"v1"), (b"key", b"v2"), (b"a", b"1"), (b"ghost", None), (b"twice", b"x"), (b"twice", None), (b"twice", None)])
    assert engine.get(b"key") == b"v2"
    for gone in (b"ghost", b"twice"):
        with pytest.raises(NotFound):
            engine.get(gone)
    engine.delete(b"key")
    engine.compact()
    engine.write([(b"key", b"v3"), (b"", b""), (b"k" * 1024, b"v" * 65_536)])
    again = Engine.open(spark, engine.files.root)
    assert again.get(b"key") == b"v3" and again.get(b"") == b"" and again.get(b"k" * 1024) == b"v" * 65_536
    assert again.next_sequence == 13
    again.write([(b"key", str(i).encode()) for i in range(100)])
    assert engine.get(b"key") == b"99"


def test_against_a_dictionary(spark, engine):
    rng, model, history = random.Random(5), {}, {}
    for step in range(4):
        changes = [(bytes([rng.randint(0, 30)]) * rng.randint(0, 2), None if rng.random() < 0.3 else bytes([rng.randint(0, 255)])) for _ in range(40)]
        for k, v in changes:
            model.pop(k, None) if v is None else model.__setitem__(k, v)
        history[engine.write(changes)] = dict(model)
        if step == 1:
            engine.compact(snapshots=[40])
    assert content(engine.scan()) == model
    assert content(engine.snapshot(40)) == history[40] and content(engine.snapshot(120)) == history[120]
    assert content(engine.scan(b"\x05", b"\x10")) == {k: v for k, v in model.items() if b"\x05" <= k < b"\x10"}
    assert [bytes(r.key) for r in engine.scan(reverse=True, limit=5).collect()] == sorted(model, reverse=True)[:5]
    engine.compact()
    engine.vacuum(keep_s=-1)
    assert content(engine.scan()) == model


def test_frames_and_conflicts(spark, engine):
    df = spark.range(500).select(F.concat(F.lit("k"), F.col("id") % 50).cast("binary").alias("key"), F.when(F.col("id") % 7 != 0, F.col("id").cast("string").cast("binary")).alias("value"), "id")
    assert engine.write_frame(df, "id") == 500
    model = {}
    for i in range(500):
        model.pop(f"k{i % 50}".encode(), None) if i % 7 == 0 else model.__setitem__(f"k{i % 50}".encode(), str(i).encode())
    assert content(engine.scan()) == model
    stale = engine._manifest()
    engine.put(b"x", b"y")
    with pytest.raises(RuntimeError):
        engine._commit(stale)
    assert engine.get(b"x") == b"y"


def test_vacuum_spares_what_is_about_to_be_committed_and_what_is_read(spark, engine):
    engine.write([(b"a", b"1"), (b"b", b"2")])
    with engine.pinned() as entries:
        engine.write([(b"a", None)])
        engine.compact()
        engine.vacuum(keep_s=-1)
        assert content(entries.where("NOT tombstone").select("key", "value")) == {b"a": b"1", b"b": b"2"}
        assert len(engine.files.list("pins")) == 1
    engine.vacuum(keep_s=-1)
    assert len(engine.files.list("log")) == 0 and len(engine.files.list("runs")) == 1 and len(engine.files.list("manifests")) == 1

    class Slow(Engine):
        def _commit(self, manifest):
            Engine.open(spark, self.files.root).vacuum()  # with its age limit, between write and commit
            super()._commit(manifest)

    Slow.open(spark, engine.files.root).write([(b"c", b"3")])
    assert content(engine.scan()) == {b"b": b"2", b"c": b"3"}


def test_a_writer_that_slept_through_a_vacuum_cannot_commit(spark, engine):
    engine.put(b"a", b"1")
    stale = engine._manifest()
    for i in range(3):
        engine.put(b"a", bytes([i]))
    engine.vacuum(keep_s=-1)
    with pytest.raises(RuntimeError):
        engine._commit(stale)
    assert engine.get(b"a") == b"\x02" and len(engine._manifests()) == 1


def test_group_commit_and_flush(spark, engine):
    grouped = Engine.open(spark, engine.files.root, group=3)
    assert [grouped.put(b"a", b"1"), grouped.put(b"b", b"2")] == [1, 2]
    with pytest.raises(NotFound):
        engine.get(b"a")
    assert grouped.delete(b"a") == 3 and engine.get(b"b") == b"2"
    grouped.put(b"d", b"4")
    assert grouped.sync() == 4 and len(engine._manifests()) == 2
    engine.flush()
    now = engine._manifest()
    assert now["log"] == [] and len(now["runs"]) == 1 and now["next_sequence"] == 5
    engine.put(b"b", b"5")
    assert content(engine.scan()) == {b"b": b"5", b"d": b"4"} and content(engine.snapshot(4)) == {b"b": b"2", b"d": b"4"}
    Engine.open(spark, engine.files.root).flush()
    Engine.open(spark, engine.files.root).flush()
    assert len(engine._manifest()["runs"]) == 2 and content(engine.scan()) == {b"b": b"5", b"d": b"4"}
