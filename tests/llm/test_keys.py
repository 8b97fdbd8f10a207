import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from keystrata.llm import distinct, seen
from keystrata.llm.xorfilter import XorFilter


@pytest.mark.parametrize("n", [0, 1, 2, 7, 1000, 70_000])
@pytest.mark.parametrize("kind", [np.uint8, np.uint16, np.uint32])
def test_filter_never_misses_and_errs_at_its_rate(n, kind):
    rng = np.random.default_rng(n)
    own = rng.integers(-(2**63), 2**63 - 1, n, dtype=np.int64)
    f = XorFilter.build(np.concatenate([own, own[: n // 2]]), kind)
    assert f.contains(own).all()
    other = rng.integers(-(2**63), 2**63 - 1, 400_000, dtype=np.int64)
    wrong = f.contains(other).mean()
    assert wrong <= f.false_rate * 1.5 + 4e-5
    again = XorFilter.from_bytes(f.to_bytes())
    assert (again.contains(other) == f.contains(other)).all()


SCHEMA = "source_name string, store_id bigint, key binary, row_no bigint, generation int, hash string, shard string, new string"


def arrivals(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(1, n + 1):
        key = b"hot" if rng.random() < 0.35 else bytes([rng.randint(0, 40)]) * rng.randint(0, 2)
        rows.append((rng.choice(["a", "b"]), rng.randint(1, 3), key, i, 0, "", "", ""))
    return rows


def brute(rows):
    known, out = set(), set()
    for source, store, key, no, *_ in sorted(rows, key=lambda r: r[3] or 0):
        if None in (source, store, key, no):
            continue
        if (source, store, key) in known:
            out.add((source, no))
        known.add((source, store, key))
    return out


@pytest.mark.parametrize("how", [{}, {"generations": 3, "shard_rows": 50}, {"fingerprint": np.uint8, "generations": 40}])
def test_seen_before(spark, how):
    rows = arrivals(700, 3)
    rows += [(None, 1, b"x", 9001, 0, "", "", ""), ("a", None, b"x", 9002, 0, "", "", ""), ("a", 1, None, 9003, 0, "", "", ""), ("a", 1, b"x", None, 0, "", "", "")]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    got = seen.seen_before(df, "source_name", ["store_id", "key"], "row_no", **how).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == brute(rows)


def test_seen_before_empty_and_long(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert seen.seen_before(empty, "source_name", ["store_id", "key"], "row_no").count() == 0
    rows = [("a", 1, b"k" * 100_000, i, 0, "", "", "") for i in (1, 2)] + [("a", 1, b"", i, 0, "", "", "") for i in (3, 4)]
    got = seen.seen_before(spark.createDataFrame(rows, SCHEMA), "source_name", ["store_id", "key"], "row_no").collect()
    assert {tuple(r) for r in got} == {("a", 2), ("a", 4)}


def test_stored_filters_and_rates(spark):
    rows = arrivals(500, 5)
    df = spark.createDataFrame(rows, SCHEMA).select("source_name", "store_id", "key", "row_no")
    entity = ["store_id", "key"]
    firsts = seen.first_rows(df, "source_name", entity, "row_no", {"a": 100, "b": 100})
    filters = seen.build_filters(firsts, "source_name", entity, 3)
    probed = seen.probe_filters(firsts, filters, "source_name", entity, 3).collect()
    least = {}
    for r in probed:
        k = (r.source_name, r.store_id, bytes(r.key))
        least[k] = min(least.get(k, 99), r.generation)
    assert all(r.maybe_earlier for r in probed if r.generation > least[r.source_name, r.store_id, bytes(r.key)])
    rates = seen.error_rates(df, "source_name", entity, "row_no", generations=5).collect()
    assert sum(r.new_keys for r in rates) == len(least)
    assert all(r.maybe_answers - r.wrong_answers == r.keys_probed - r.new_keys for r in rates)
    assert seen.compounded_rate(3, 16) == pytest.approx(3 * 2**-16, rel=1e-3)


def test_distinct_counts_within_the_stated_error(spark):
    rng = random.Random(7)
    rows = [(rng.choice(["x", "y", None]), rng.randint(1, 4), bytes(str(rng.randint(0, 6000)), "ascii"), 1, "e") for _ in range(20_000)]
    rows += [("x", 1, None, 1, "e")] * 5 + [("x", 1, b"", 1, "e")]
    df = spark.createDataFrame(rows, "day string, store_id int, id binary, word_no int, word string")
    bits = distinct.bitmap_bits(df.count(), 0.01)
    words = distinct.bitmap_words(df.withColumn("src", F.lit("s")), ["src", "day", "store_id"], ["id"], bits)
    tier = spark.createDataFrame([(1, "t1"), (2, "t1"), (3, None), (4, "t2")], "store_id int, tier string")
    out = distinct.distinct_counts(words.join(tier, "store_id"), ["day", "store_id", "tier"], bits, fixed=["src"], dependent={"tier": "store_id"}).collect()
    tiers = {1: "t1", 2: "t1", 3: None, 4: "t2"}
    assert {r.grouped_by for r in out} == {"", "day", "store_id", "tier", "day,store_id", "day,tier", "store_id,tier", "day,store_id,tier"}
    for r in out:
        by = [x for x in r.grouped_by.split(",") if x]
        exact = {i for d, s, i, *_ in rows if i is not None and all({"day": d, "store_id": s, "tier": tiers[s]}[b] == r[b] for b in by)}
        assert abs(r.distinct_keys - len(exact)) <= 5 * max(r.relative_error, 0.004) * len(exact) + 1, r
        assert r.relative_error <= 0.011
    assert len(out) == len({(r.grouped_by, r.day, r.store_id, r.tier) for r in out})


def test_merging_by_chunks_changes_nothing(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(rng.choice(["x", None]), rng.randint(1, 3), bytes(str(rng.randint(0, 900)), "ascii")) for _ in range(3000)]
    words = distinct.bitmap_words(spark.createDataFrame(rows, "day string, store_id int, id binary"), ["day", "store_id"], ["id"], 4096)
    whole = distinct.distinct_counts(words, ["day", "store_id"], 4096, fixed=[])
    key = lambda df: sorted(map(str, df.collect()))
    before = key(whole)
    monkeypatch.setattr(distinct, "CHUNK_ROWS", 1)
    assert key(distinct.distinct_counts(words.repartition(3), ["day", "store_id"], 4096, fixed=[])) == before and len(before) == 1 + 2 + 3 + 6
    assert distinct.distinct_counts(words.limit(0), ["day", "store_id"], 4096, fixed=[]).count() == 0


def test_bitmaps_merge(spark):
    rows = [(i % 5, str(i).encode()) for i in range(3000)]
    df = spark.createDataFrame(rows, "d int, id binary")
    bits = distinct.bitmap_bits(3000)
    whole = distinct.bitmap_words(df, ["d"], ["id"], bits)
    parts = distinct.bitmap_words(df.where("d % 2 = 0"), ["d"], ["id"], bits).unionByName(distinct.bitmap_words(df, ["d"], ["id"], bits))
    key = lambda x: sorted(map(tuple, x.select("d", "word_no", "word").collect()))
    assert key(distinct.union_words(parts, ["d"])) == key(whole)
    assert distinct.union_words(whole.limit(0), ["d"]).count() == 0
    # days stored with larger bitmaps fold to the smaller size
    large = distinct.bitmap_words(df.where("d % 2 = 0"), ["d"], ["id"], bits * 8)
    mixed = large.unionByName(distinct.bitmap_words(df.where("d % 2 = 1"), ["d"], ["id"], bits))
    assert key(distinct.union_words(mixed, ["d"])) == key(whole) and distinct.smallest_bits(mixed) == bits
    assert {r.bits for r in distinct.union_words(mixed, ["d"]).collect()} == {bits}
    with pytest.raises(ValueError):
        distinct.union_words(mixed, ["d"], bits * 2)
    with pytest.raises(ValueError):
        distinct.bitmap_words(df, ["d"], ["id"], 1000)
    for r in distinct.cell_counts(distinct.union_words(mixed, ["d"]), ["d"], bits).collect():
        assert abs(r.distinct_keys - 600) <= 5 * max(r.relative_error, 0.004) * 600 + 1
    assert distinct.relative_error(10, 1 << 20) < 0.001 and distinct.bitmap_bits(10**9) < 10**9
