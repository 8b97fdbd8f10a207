import random

import pytest
from pyspark.sql import functions as F

from keystrata.operators import changelog, compaction, indexes, ordered, reads, runs
from keystrata.operators.script import last_before, run_script

LOG = "store_id bigint, sequence bigint, key binary, value binary, tombstone boolean"


def log_rows(n, seed, stores=2):
    rng = random.Random(seed)
    rows = []
    for s in range(1, stores + 1):
        for q in range(1, n + 1):
            key = b"hot" if rng.random() < 0.35 else bytes([rng.randint(0, 20)]) * rng.randint(0, 3)
            dead = rng.random() < 0.25
            rows.append((s, q, key, b"" if dead else bytes([rng.randint(0, 255)]) * rng.randint(0, 60), dead))
    rng.shuffle(rows)
    return rows


def newest(rows, upto=None):
    last = {}
    for s, q, k, v, d in sorted(rows, key=lambda r: r[1]):
        if upto is None or q <= upto:
            last[s, k] = (q, v, d)
    return last


def pairs(df):
    return {(r.store_id, bytes(r.key)): r.sequence for r in df.collect()}


def test_order_of_keys(spark):
    keys = [b"", b"\x00", b"a", b"ab", b"\x7f", b"\xff"]
    df = spark.createDataFrame([(1, i, k, b"v", False) for i, k in enumerate(reversed(keys))], LOG)
    assert [bytes(r.key) for r in reads.scan(df).collect()] == keys
    assert [bytes(r.key) for r in reads.scan(df, reverse=True).collect()] == keys[::-1]
    assert reads.prefix_end(b"a") == b"b" and reads.prefix_end(b"a\xff") == b"b" and reads.prefix_end(b"\xff") is None
    assert [bytes(r.key) for r in reads.scan(df, b"a", reads.prefix_end(b"a")).collect()] == [b"a", b"ab"]


def test_reads_against_a_dictionary(spark):
    rows = log_rows(200, 1)
    df = spark.createDataFrame(rows, LOG)
    last = newest(rows)
    assert pairs(reads.newest(df)) == {k: v[0] for k, v in last.items()}
    live = {k: v[0] for k, v in last.items() if not v[2]}
    assert pairs(reads.live(df)) == live
    assert pairs(reads.snapshot(df, 77)) == {k: v[0] for k, v in newest(rows, 77).items() if not v[2]}
    assert pairs(reads.stale_read(df, 50)) == {k: v[0] for k, v in newest(rows, 150).items() if not v[2]}
    layers = [df.where("sequence > 120"), df.where("sequence <= 120")]
    assert pairs(reads.layered_get(layers)) == {k: v[0] for k, v in last.items()}
    probes = spark.createDataFrame([(1, b"hot"), (1, b"none"), (9, b"hot"), (1, b"hot"), (None, b"hot")], "store_id bigint, key binary")
    got = {(r.store_id, bytes(r.key)): (r.status, r.value is None) for r in reads.multi_get(df, probes).collect()}
    assert len(got) == 4 and got[1, b"none"] == ("not_found", True)
    assert got[1, b"hot"][0] == ("ok" if (1, b"hot") in live else "not_found")
    assert reads.newest(df.limit(0)).count() == 0 and reads.multi_get(df.limit(0), probes).count() == 4
    assert {r.store_id: bytes(r.key) for r in reads.seek(df, b"\x05").collect()} == {s: min(k for t, k in live if t == s and k >= b"\x05") for s in (1, 2)}


def test_key_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "log")
    spark.createDataFrame(log_rows(50, 2), LOG).write.parquet(path)
    plan = reads.get(spark.read.parquet(path), b"hot")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(key" in plan


def test_change_log_unites_copies_and_spellings(spark):
    rows = [(1, 1, b"k", b"v", "PUT ", None), (1, 1, b"k", b"v", "0", False), (1, 2, b"k", None, " del", None), (1, 2, b"k", b"", "1", True), (1, 3, b"", None, None, None), (None, 1, b"k", b"", "put", None), (1, None, b"k", b"", "put", None), (1, 4, None, b"", "put", None)]
    df = spark.createDataFrame(rows, "store_id bigint, sequence bigint, key binary, value binary, op string, tombstone boolean")
    got = sorted((r.sequence, bytes(r.key), bytes(r.value), r.tombstone, r.op) for r in changelog.change_log(df).collect())
    assert got == [(1, b"k", b"v", False, "put"), (2, b"k", b"", True, "del"), (3, b"", b"", False, "put")]
    assert changelog.next_sequence(df.dropna()).count() in (0, 1)
    numbered = changelog.assign_sequences(spark.createDataFrame([(5,), (9,), (7,)], "at int"), "at", base=10).collect()
    assert {r["at"]: r.sequence for r in numbered} == {5: 11, 7: 12, 9: 13}


def brute_cut(sizes, capacity):
    out, total, n = [], 0, 0
    for s in sizes:
        out.append(n)
        total += s
        if total > capacity:
            n, total = n + 1, 0
    return out


def test_greedy_cut_over_batches(spark):
    rng = random.Random(3)
    rows = [(g, i, rng.randint(0, 30), 50 + g) for g in range(5) for i in range(rng.choice([1, 7, 400]))]
    df = spark.createDataFrame(rows, "g bigint, i bigint, size bigint, capacity bigint")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        got = {(r.g, r.i): r.piece for r in runs.greedy_cut(df, ["g"], ["i"], "size", "capacity", "piece").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for g in range(5):
        own = [r for r in rows if r[0] == g]
        assert [got[g, r[1]] for r in own] == brute_cut([r[2] for r in own], 50 + g)
    assert runs.greedy_cut(df.limit(0), ["g"], ["i"], "size", "capacity", "piece").count() == 0


@pytest.mark.parametrize("chunk", [1, 7, 64])
def test_scans_over_chunks(spark, chunk):
    rng = random.Random(chunk)
    rows = [(g, i, rng.randint(0, 30), 50 + g, rng.choice([None, None, i])) for g in range(4) for i in range(rng.choice([1, 9, 300]))]
    df = spark.createDataFrame(rows, "g bigint, i bigint, size bigint, capacity bigint, v bigint").repartition(5)
    cut = {(r.g, r.i): r.piece for r in ordered.greedy_cut(df, ["g"], ["i"], "size", "capacity", "piece", chunk_rows=chunk).collect()}
    sums = {(r.g, r.i): r.s for r in ordered.sum_before(df, ["g"], ["i"], "size", "s", chunk_rows=chunk).collect()}
    last = {(r.g, r.i): r.l for r in ordered.last_before(df, ["g"], ["i"], "v", "l", chunk_rows=chunk).collect()}
    for g in range(4):
        own = [r for r in rows if r[0] == g]
        assert [cut[g, r[1]] for r in own] == brute_cut([r[2] for r in own], 50 + g)
        assert [sums[g, r[1]] for r in own] == [sum(x[2] for x in own[:n]) for n in range(len(own))]
        assert [last[g, r[1]] for r in own] == [next((x[4] for x in reversed(own[: n + 1]) if x[4] is not None), None) for n in range(len(own))]


def test_no_task_needs_a_whole_group(spark):
    """One group of all rows: no window or aggregation by group sees more than a row per chunk."""
    df = spark.range(20_000).select(F.lit(1).cast("long").alias("g"), "id", F.lit(3).cast("long").alias("size"), F.lit(100).cast("long").alias("capacity"))
    out = ordered.greedy_cut(df, ["g"], ["id"], "size", "capacity", "piece", chunk_rows=500)
    text = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in text and "hashpartitioning(g" not in text and "hashpartitioning(scan_part" in text
    assert out.agg(F.max("piece")).first()[0] == (20_000 - 1) // 34


def test_blocks_and_lookup(spark):
    rows = [(1, r, q, k, v, d) for r in (1, 2) for _, q, k, v, d in log_rows(150, r, 1)]
    df = spark.createDataFrame(rows, "store_id bigint, run_id bigint, sequence bigint, key binary, value binary, tombstone boolean")
    cut = runs.blocks(df, target=256)
    index = runs.block_index(cut).collect()
    for r in (1, 2):
        own = sorted([x for x in rows if x[1] == r], key=lambda x: (x[3], -x[2]))
        sizes = [25 + len(x[3]) + len(x[4]) for x in own]
        pieces = brute_cut(sizes, 255)
        mine = sorted((i for i in index if i.run_id == r), key=lambda i: i.block_no)
        assert [i.entry_count for i in mine] == [pieces.count(p) for p in sorted(set(pieces))]
        assert [bytes(i.smallest_key) for i in mine] == [own[pieces.index(p)][3] for p in sorted(set(pieces))]
        assert [i.block_offset for i in mine] == [sum(x.block_size for x in mine[:n]) for n in range(len(mine))]
    ix = runs.block_index(cut).withColumnRenamed("block_no", "block_id")
    probes = spark.createDataFrame([(1, 1, b"", "x"), (1, 2, b"hot", "y"), (1, 3, b"hot", None), (1, 1, b"\xff", "z")], "store_id bigint, run_id bigint, key binary, tag string")
    got = {(r.run_id, bytes(r.key)): r.block_id for r in runs.locate_blocks(probes, ix).collect()}
    for (r, k), block in got.items():
        below = [i.block_no for i in index if i.run_id == r and bytes(i.smallest_key) <= k]
        assert block == (max(below) if below else None)


def test_prefixes_and_value_logs(spark):
    keys = [b"", b"a", b"ab", b"abc", b"abd", b"b\xff", b"b\xff\xff"]
    df = spark.createDataFrame([(1, 1, 0, k, 1, b"v" * 10 * i, False) for i, k in enumerate(keys)], "store_id bigint, run_id bigint, block_no bigint, key binary, sequence bigint, value binary, tombstone boolean")
    got = {bytes(r.key): r.shared for r in runs.prefix_lengths(df, restart=16).collect()}
    assert got == {b"": 0, b"a": 0, b"ab": 1, b"abc": 2, b"abd": 2, b"b\xff": 0, b"b\xff\xff": 2}
    assert {bytes(r.key): r.shared for r in runs.prefix_lengths(df, restart=2).collect()}[b"ab"] == 0
    pointers, log = runs.separate_values(df, 25)
    at = {bytes(r.key): (r.value_offset, r.value_size) for r in pointers.collect()}
    assert at[b"a"] == (None, None) and at[b"abc"] == (0, 30) and at[b"abd"] == (30, 40) and log.count() == 4
    dead = compaction.reclaimable(pointers.where("value_offset is null or value_offset <> 30"), log).collect()
    assert [(r.log_bytes, r.dead_bytes) for r in dead] == [(180, 40)]


def test_flush_writes_sorted_files_once(spark, tmp_path):
    path = str(tmp_path / "run")
    df = spark.createDataFrame(log_rows(100, 4), LOG)
    runs.flush(df, path)
    assert spark.read.parquet(path).exceptAll(df).count() == 0
    with pytest.raises(Exception):
        runs.flush(df, path)


@pytest.mark.parametrize("snapshots", [[], [60], [20, 60, 150]])
@pytest.mark.parametrize("bottom", [True, False])
def test_compaction_changes_no_read(spark, snapshots, bottom):
    rows = log_rows(200, 6)
    df = spark.createDataFrame(rows, LOG)
    kept = compaction.compact_with_snapshots(df, snapshots, bottom=bottom)
    assert kept.count() == kept.dropDuplicates(["store_id", "key", "sequence"]).count()
    for s in [*snapshots, 10_000]:
        assert pairs(reads.snapshot(kept, s)) == {k: v[0] for k, v in newest(rows, s).items() if not v[2]}


def test_partial_compaction_keeps_tombstones(spark):
    old = spark.createDataFrame([(1, 1, b"k", b"v", False)], LOG)
    new = spark.createDataFrame([(1, 2, b"k", b"", True)], LOG)
    merged = compaction.compact(new, bottom=False)
    assert reads.live(merged.unionByName(old.select(merged.columns))).count() == 0
    assert compaction.compact(new.unionByName(old), bottom=True).count() == 0


def test_expiry(spark):
    df = spark.createDataFrame([(1, b"a", 1, False, b"", "2025-01-01"), (1, b"b", 2, False, b"", "2025-02-01"), (1, b"c", 3, True, b"", "2025-02-01"), (1, b"d", 4, False, b"", None)], "store_id bigint, key binary, sequence bigint, tombstone boolean, value binary, w string").withColumn("at", F.col("w").cast("timestamp_ntz"))
    got = compaction.expire(df, "at", F.expr("TIMESTAMP_NTZ '2025-02-10 00:00:00'"), "30 DAYS").collect()
    assert sorted(bytes(r.key) for r in got) == [b"b", b"d"]


def test_scripts(spark):
    lines = ["PUT a 1", "GET a", "put a 2", "GET  b", "", None, "PUT a", "DEL a", "GET a", "PUT a 2 ", " PUT a  3", "GET a", "GET a b", "DEL", "EXIT", "GET a"]
    df = spark.createDataFrame(list(enumerate(lines)), "line_no bigint, line string")
    got = {r.line_no: r.reply for r in run_script(df).collect()}
    assert got == {0: "OK", 1: "1", 2: "Unknown command: put", 3: "(nil)", 6: "Usage: PUT <key> <value>", 7: "OK", 8: "(nil)", 9: "OK", 10: "OK", 11: "3", 12: "Usage: GET <key>", 13: "Usage: DEL <key>"}
    assert run_script(df.limit(0)).count() == 0
    assert run_script(df.where("line_no < 2")).count() == 2


def test_last_before_over_chunks(spark):
    rng = random.Random(2)
    rows = [(i, "h" if rng.random() < 0.5 else str(rng.randint(0, 9)), rng.choice([None, i])) for i in range(300)]
    df = spark.createDataFrame(rows, "o bigint, k string, p bigint")
    got = {r.o: r.x for r in last_before(df, ["k"], "o", "p", "x", chunk=17).collect()}
    last = {}
    for o, k, p in rows:
        assert got[o] == last.get(k)
        last[k] = p if p is not None else last.get(k)


def test_nearest_over_blocks(spark):
    rng = random.Random(8)
    rows = [(i, [rng.random() for _ in range(6)]) for i in range(200)] + [(500, None), (None, [0.0] * 6)]
    rows += [(300, rows[0][1]), (301, rows[0][1])]
    df = spark.createDataFrame(rows, "id bigint, v array<float>")
    good = {i: df_v for i, df_v in ((r.id, r.v) for r in df.dropna().collect())}
    found = indexes.nearest(df, df.where("id % 50 = 0"), "id", "v", 5, query_block=2).collect()
    for q in (0, 50, 300):
        own = sorted((sum((a - b) ** 2 for a, b in zip(good[q], v)) ** 0.5, i) for i, v in good.items() if i != q)[:5]
        assert [r.neighbour for r in sorted((x for x in found if x.query == q), key=lambda x: x.rank)] == [i for _, i in own]
    assert indexes.nearest(df.limit(0), df, "id", "v", 5).count() == 0


def test_workloads_have_their_shares(spark):
    df = spark.range(4000).select(F.col("id").alias("n"), F.col("id").cast("string").alias("k"))
    for name, shares in indexes.YCSB.items():
        counts = {r.operation: r["count"] for r in indexes.workload(df, "k", "n", name).groupBy("operation").count().collect()}
        for operation, share in zip(indexes.YCSB_OPERATIONS, shares):
            assert abs(counts.get(operation, 0) / 4000 - share) < 0.03
    node = indexes.rendezvous(F.col("k"), ["a", "b", "c"])
    more = indexes.rendezvous(F.col("k"), ["a", "b", "c", "d"])
    assert df.where((node != more) & (more != "d")).count() == 0


def test_sequences_are_dense_over_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1009).alias("at"), F.col("id").alias("order_base"))
    got = sorted((r.at, r.sequence) for r in changelog.assign_sequences(df.repartition(7), "at", 40).collect())
    assert [q for _, q in got] == list(range(41, 1041)) and [a for a, _ in got] == sorted(a for a, _ in got)
    assert changelog.assign_sequences(df.limit(0), "at").count() == 0


def test_pages_of_a_scan(spark):
    df = spark.createDataFrame([(1, i, bytes([i]), b"v", i % 3 == 0) for i in range(1, 40)], LOG)
    keys = [bytes([i]) for i in range(1, 40) if i % 3]
    assert [bytes(r.key) for r in reads.scan(df, limit=5, offset=7).collect()] == keys[7:12]
    assert [bytes(r.key) for r in reads.scan(df, offset=20).collect()] == keys[20:] and reads.scan(df, offset=99).count() == 0
    assert {r.store_id: r.status for r in reads.get(df, b"\x03", spark.range(1, 3).withColumnRenamed("id", "store_id")).collect()} == {1: "not_found", 2: "not_found"}
    assert [r.status for r in reads.get(df, b"\x02").collect()] == ["ok"] and reads.get(df, b"none").count() == 0


def test_inverted_lists_find_most_neighbours(spark):
    rng = random.Random(11)
    centres = [[rng.uniform(-9, 9) for _ in range(8)] for _ in range(12)]
    rows = [(i, [c + rng.gauss(0, 1) for c in centres[0 if i % 3 == 0 else i % 12]]) for i in range(1200)] + [(5000, None)]
    df = spark.createDataFrame(rows, "id bigint, v array<double>")
    centroids = indexes.train_centroids(df, "id", "v", 10, sample_rows=400)
    index = indexes.inverted_lists(df, "id", "v", centroids).cache()
    assert index.count() == 1200 and index.select("key").distinct().count() == 1200
    asked = df.where("id % 50 = 0")
    exact = {(r.query, r.neighbour) for r in indexes.nearest(df, asked, "id", "v", 5).collect()}
    found = {(r.query, r.neighbour) for r in indexes.nearest_in_lists(index, asked, "id", "v", centroids, 5, 3).collect()}
    assert len(exact & found) >= 0.9 * len(exact)
    all_lists = indexes.nearest_in_lists(index, asked, "id", "v", centroids, 5, len(centroids))
    assert {(r.query, r.neighbour) for r in all_lists.collect()} == exact
    assert indexes.nearest_in_lists(index.limit(0), asked, "id", "v", centroids, 5, 3).count() == 0


def hilbert_place(x, y, bits):
    place, side = 0, 1 << (bits - 1)
    while side:
        right, up = bool(x & side), bool(y & side)
        place = place * 4 + {(False, False): 0, (False, True): 1, (True, True): 2, (True, False): 3}[right, up]
        x, y = x & (side - 1), y & (side - 1)
        if not up:
            if right:
                x, y = side - 1 - x, side - 1 - y
            x, y = y, x
        side >>= 1
    return place


def test_hilbert_neighbours_are_neighbours(spark):
    df = spark.range(16).withColumnRenamed("id", "x").crossJoin(spark.range(16).withColumnRenamed("id", "y"))
    places = sorted((r.d, r.x, r.y) for r in df.select("x", "y", indexes.hilbert(F.col("x"), F.col("y"), 4).alias("d")).collect())
    assert [p[0] for p in places] == list(range(256))
    assert all(abs(a[1] - b[1]) + abs(a[2] - b[2]) == 1 for a, b in zip(places, places[1:]))
    assert all(d == hilbert_place(x, y, 4) for d, x, y in places)
    one = spark.createDataFrame([(2**31 - 1, 0), (12345678, 87654321), (None, 1)], "x bigint, y bigint")
    got = [r[0] for r in one.select(indexes.hilbert(F.col("x"), F.col("y"))).collect()]
    assert got == [hilbert_place(2**31 - 1, 0, 31), hilbert_place(12345678, 87654321, 31), None]


def rows_scanned(df):
    """Rows that the scan of a frame gives to the plan above it, after it has run."""
    df.collect()
    plan, todo = None, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if "Scan parquet" in node.nodeName():
            plan = node
        todo += [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
    return plan.metrics().apply("numOutputRows").value()


def test_row_groups_outside_a_box_are_skipped(spark, tmp_path):
    df = spark.range(40_000).select((F.col("id") % 200).alias("a"), F.floor(F.col("id") / 200).alias("b"), F.lit("x" * 40).alias("c")).orderBy(F.rand(1))
    path = str(tmp_path / "z")
    indexes.write_z_ordered(df, "a", "b", path, row_group_bytes=32 << 10)
    found = indexes.box(spark.read.parquet(path), "a", "b", (20, 20), (40, 40))
    assert sorted((r.a, r.b) for r in found.collect()) == [(a, b) for a in range(20, 41) for b in range(20, 41)]
    assert rows_scanned(found) < 20_000


def test_filters_on_keys_skip_row_groups(spark, tmp_path):
    # every file and row group holds keys from the whole range, so statistics exclude nothing
    df = spark.range(60_000).select(F.lit(1).cast("long").alias("store_id"), F.sha2(F.col("id").cast("string"), 256).cast("binary").alias("key"), F.col("id").alias("sequence"), F.lit(b"v").alias("value"))
    for bloom, least, most in ((True, 0, 20_000), (False, 40_000, 60_000)):
        path = str(tmp_path / f"run-{bloom}")
        rows = df.orderBy(F.rand(1)).repartition(12)
        writer = rows.write.option("parquet.bloom.filter.enabled#key", str(bloom).lower()).option("parquet.enable.dictionary", "false")
        writer.parquet(path)
        key = df.where("sequence = 777").first().key
        found = runs.open_run(spark, path, bytes(key))
        assert [r.sequence for r in found.collect()] == [777]
        assert least <= rows_scanned(found) <= most, (bloom, rows_scanned(found))


def test_ring_and_ranges(spark):
    df = spark.range(4000).select(F.col("id").cast("string").cast("binary").alias("k"))
    ring, more = indexes.hash_ring(["a", "b", "c"]), indexes.hash_ring(["a", "b", "c", "d"])
    before, after = indexes.ring_node(F.col("k"), ring), indexes.ring_node(F.col("k"), more)
    counts = {r.n: r["count"] for r in df.groupBy(before.alias("n")).count().collect()}
    assert set(counts) == {"a", "b", "c"} and min(counts.values()) > 800
    assert df.where((before != after) & (after != "d")).count() == 0 and df.where(before != after).count() > 400
    bounds = indexes.range_bounds(df, "k", 8, sample_rows=2000)
    sizes = {r.p: r["count"] for r in df.groupBy(indexes.range_of(F.col("k"), bounds).alias("p")).count().collect()}
    assert len(bounds) == 7 and sorted(sizes) == list(range(8)) and max(sizes.values()) < 800
    assert indexes.range_bounds(df.limit(0), "k", 8) == [] and df.select(indexes.range_of(F.lit(None), bounds).alias("p")).first().p == 0


def test_phrases_against_brute_force(spark):
    rng = random.Random(4)
    texts = [(i, " ".join(rng.choice(["Да", "нет", "a", "b"]) + rng.choice(["", ",", "!"]) for _ in range(40))) for i in range(60)] + [(90, ""), (91, None), (None, "a b a")]
    df = spark.createDataFrame(texts, "term bigint, text string")
    index = indexes.postings(df.withColumnRenamed("term", "doc").withColumn("term", F.lit("clash")), "doc", "text", indexes.ANY_WORDS, positions=True)
    got = {r.doc: sorted(r.starts) for r in indexes.phrase(index, "doc", ["да", "a", "да"]).collect()}
    want = {}
    for i, t in texts[:60]:
        w = [x.strip(",!").lower() for x in t.split()]
        at = [k for k in range(38) if w[k : k + 3] == ["да", "a", "да"]]
        if at:
            want[i] = at
    assert got == want and got
    assert indexes.phrase(index, "doc", ["none", "a"]).count() == 0
