"""Plans and bounds that must hold whatever the data's size."""

from pyspark.sql import functions as F

from keystrata.functions.bounded import broadcast_if_small, use_all_cores
from keystrata.functions.skew import MAX_HOT_BUCKETS, hot_condition
from keystrata.operators import changelog, reads
from keystrata.sources.tables import table

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_condition_holds_for_every_row_of_a_hot_group(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    hot = hot_condition(df, ["k"], 500)
    counts = {r.h: r.n for r in df.groupBy(hot.alias("h")).agg(F.count_if(F.col("k") == "hot").alias("n")).collect()}
    assert counts.get(True) == df.where("k = 'hot'").count() and not counts.get(False)
    assert df.where(hot).count() < 10_000
    assert df.where(hot_condition(df, ["k"], 100_000)).count() == 0
    assert df.limit(0).where(hot_condition(df.limit(0), ["k"], 0)).count() == 0
    assert MAX_HOT_BUCKETS <= 1 << 14


def test_broadcast_only_what_was_counted(spark):
    small, large = spark.range(10), spark.range(1000)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" in plan(large.join(broadcast_if_small(small, 10 * 40), "id"))
        assert "BroadcastHashJoin" not in plan(large.join(broadcast_if_small(small, 10 * 40 - 1), "id"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_only_small_inputs_are_spread(spark):
    assert use_all_cores(spark.range(0, 10, 1, 1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    wide = spark.range(0, 10, 1, 64)
    assert use_all_cores(wide) is wide


def test_current_state_takes_one_shuffle(spark):
    log = changelog.changes(table(spark, DATA, "wal_entry"))
    text = plan(reads.live(log))
    assert text.count("Exchange hashpartitioning") == 1
    assert "timestamp_ms" not in text and "arrived_at" not in text
