from keystrata.sources.shared import shared_dir
from keystrata.sources.shared import SharedFiles
from keystrata.streaming.feed import LiveTable, log_stream, watch, write_feed

SCHEMA = "store_id bigint, op string, sequence bigint, key binary, value binary, tombstone boolean"


def test_watch_and_live_table(spark, tmp_path):
    path, work = str(tmp_path / "log"), shared_dir(spark, "feed")
    first = [(1, "put", 2, b"a", b"2", False), (1, "del", 3, b"b", None, True)]
    second = [(1, "put", 1, b"a", b"1", False), (1, "put", 4, b"c", b"4", False), (1, "put", 2, b"b", b"x", False)]
    seen = []
    for rows in (first, second):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
        stream = watch(log_stream(spark, path, spark.read.parquet(path).schema), b"b", b"d")
        write_feed(stream, f"{work}/out", f"{work}/state").awaitTermination()
        seen.append(sorted(r.sequence for r in spark.read.parquet(f"{work}/out").collect()))
    assert seen == [[3], [2, 3, 4]]
    live = LiveTable(spark, f"{work}/live")
    assert live.rows().count() == 0
    for _ in range(2):  # nothing new comes the second time
        live.refresh(log_stream(spark, path, spark.read.parquet(path).schema, files_per_batch=1))
    assert {bytes(r.key): (r.sequence, r.deleted) for r in live.entries().collect()} == {b"a": (2, False), b"b": (3, True), b"c": (4, False)}
    spark.createDataFrame([(1, "put", 9, b"b", b"9", False), (1, "del", 1, b"c", None, True)], SCHEMA).write.mode("append").parquet(path)
    live.refresh(log_stream(spark, path, spark.read.parquet(path).schema, files_per_batch=1))
    assert {bytes(r.key): r.sequence for r in live.rows().collect()} == {b"a": 2, b"b": 9, b"c": 4}
    assert len(SharedFiles(spark, f"{work}/live/upserts").list("")) <= 2
