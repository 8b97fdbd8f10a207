"""Queries of the distinct-count and seen-before problems, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.functions.bounded import broadcast_if_small
from keystrata.llm import distinct, seen
from keystrata.sources.shared import shared_dir
from keystrata.sources.tables import table

DIMS = ["day", "store_id", "level", "tier", "zone_code"]


def _identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_name, day, store_id, level, id) of internal_key and index_entry.

    A block's level is that of its run, as the manifest's addition says; null where the manifest has none.
    """
    keys = table(spark, sf_dir, "internal_key").select(
        F.lit("internal_key").alias("source_name"),
        F.to_date("arrived_at").alias("day"),
        "store_id",
        "level",
        F.col("user_key").alias("id"),
    )
    runs = (
        table(spark, sf_dir, "manifest")
        .where(F.lower(F.trim("action")) == "add")
        .groupBy("store_id", "run_id")
        .agg(F.max("level").alias("level"))
    )
    blocks = table(spark, sf_dir, "index_entry").join(runs, ["store_id", "run_id"], "left")
    return keys.unionByName(
        blocks.select(
            F.lit("index_entry").alias("source_name"),
            F.to_date("built_at").alias("day"),
            "store_id",
            "level",
            F.col("smallest_key").alias("id"),
        )
    )


def _stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "engine_config").select(
        "store_id",
        F.nullif(F.lower(F.trim("tier")), F.lit("")).alias("tier"),
        F.nullif(F.trim("zone_code"), F.lit("")).alias("zone_code"),
    )


FINEST = ["source_name", "day", "store_id", "level"]


def p2_distinct_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimated distinct keys of each table for each day, store, level, tier, zone_code and combination."""
    bits = distinct.bitmap_bits(distinct.CAPACITY)
    words = distinct.bitmap_words(_identifiers(spark, sf_dir), FINEST, ["id"], bits)
    words = words.join(broadcast_if_small(_stores(spark, sf_dir)), "store_id", "left")
    return distinct.distinct_counts(
        words, DIMS, bits, fixed=["source_name"], dependent={"tier": "store_id", "zone_code": "store_id"}
    )


#: Standard errors within which an estimate must be, beside rounding.
ERRORS = 5


def _judged(estimates: DataFrame, exact: DataFrame, cell: list[str]) -> DataFrame:
    """Exact counts with whether the estimate is within its bound; a cell that only one side has is not."""
    same = [estimates[c].eqNullSafe(exact[c]) for c in cell]
    bound = F.col("exact_keys") * F.greatest(F.col("relative_error"), F.lit(0.002)) * ERRORS + 1
    within = F.abs(F.col("distinct_keys") - F.col("exact_keys")) <= bound
    return exact.join(estimates, same, "full").select(
        *[F.coalesce(exact[c], estimates[c]).alias(c) for c in cell], "exact_keys", F.coalesce(within, F.lit(False)).alias("within_bound")
    )


IDS_CTE = """s AS (SELECT store_id, nullif(lower(trim(tier)), '') AS tier, nullif(trim(zone_code), '') AS zone_code FROM engine_config),
m AS (SELECT store_id, run_id, max(level) AS level FROM manifest WHERE lower(trim(action)) = 'add' GROUP BY ALL),
ids AS (
  SELECT 'internal_key' AS source_name, CAST(arrived_at AS DATE) AS day, store_id, level, user_key AS id FROM internal_key WHERE user_key IS NOT NULL
  UNION ALL
  SELECT 'index_entry', CAST(built_at AS DATE), i.store_id, m.level, smallest_key FROM index_entry i
  LEFT JOIN m ON m.store_id = i.store_id AND m.run_id = i.run_id WHERE smallest_key IS NOT NULL
)"""


P2_ERROR_SQL = f"""WITH {IDS_CTE}
SELECT source_name, grouped_by, value, count(DISTINCT id) AS exact_keys, true AS within_bound FROM (
  SELECT source_name, 'day' AS grouped_by, CAST(day AS VARCHAR) AS value, id FROM ids
  UNION ALL SELECT source_name, 'store_id', CAST(store_id AS VARCHAR), id FROM ids
  UNION ALL SELECT source_name, 'level', CAST(level AS VARCHAR), id FROM ids
  UNION ALL SELECT source_name, 'tier', tier, id FROM ids LEFT JOIN s USING (store_id)
  UNION ALL SELECT source_name, 'zone_code', zone_code, id FROM ids LEFT JOIN s USING (store_id)
  UNION ALL SELECT source_name, '', NULL, id FROM ids
) GROUP BY ALL"""


def p2_error_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each table, and of each day, store, level, tier and zone_code of it: the exact count, and whether the estimate keeps its bound."""
    estimates = p2_distinct_keys(spark, sf_dir).where(~F.col("grouped_by").contains(","))
    value = F.coalesce(*[F.when(F.col("grouped_by") == d, F.col(d).cast("string")) for d in DIMS], F.lit(None).cast("string"))
    estimates = estimates.select("source_name", "grouped_by", value.alias("value"), "distinct_keys", "relative_error")
    # one row per key of a finest cell, then one per key and coarse cell: distinct before counting, with combining before the shuffle
    ids = _identifiers(spark, sf_dir).where("id IS NOT NULL").distinct().join(broadcast_if_small(_stores(spark, sf_dir)), "store_id", "left")
    cells = F.array(*[F.struct(F.lit(d).alias("by"), F.col(d).cast("string").alias("value")) for d in DIMS], F.struct(F.lit("").alias("by"), F.lit(None).cast("string").alias("value")))
    each = ids.select("source_name", "id", F.explode(cells).alias("c")).select("source_name", F.col("c.by").alias("grouped_by"), "c.value", "id").distinct()
    exact = each.groupBy("source_name", "grouped_by", "value").agg(F.count("*").alias("exact_keys"))
    return _judged(estimates, exact, ["source_name", "grouped_by", "value"])


P2_MERGED_SQL = f"""WITH {IDS_CTE} SELECT source_name, store_id, count(DISTINCT id) AS exact_keys, true AS within_bound FROM ids GROUP BY ALL"""


def p2_merged_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial results of odd and even days, stored apart with bitmaps of two sizes, merged to one count per store."""
    ids, cell = _identifiers(spark, sf_dir), ["source_name", "day", "store_id", "level"]
    bits = distinct.bitmap_bits(distinct.CAPACITY)
    path = shared_dir(spark, "partial-counts")
    odd = F.coalesce(F.dayofmonth("day") % 2 == 1, F.lit(False))
    distinct.bitmap_words(ids.where(odd), cell, ["id"], bits).write.parquet(f"{path}/odd")
    distinct.bitmap_words(ids.where(~odd), cell, ["id"], bits // 4).write.parquet(f"{path}/even")
    stored = spark.read.parquet(f"{path}/odd", f"{path}/even")
    merged = distinct.union_words(stored, ["source_name", "store_id"], bits // 4)
    estimates = distinct.cell_counts(merged, ["source_name", "store_id"], bits // 4)
    exact = ids.where("id IS NOT NULL").select("source_name", "store_id", "id").distinct().groupBy("source_name", "store_id").agg(F.count("*").alias("exact_keys"))
    return _judged(estimates, exact, ["source_name", "store_id"])


def _arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [("internal_key", "user_key", "entry_no"), ("index_entry", "smallest_key", "block_no")]
    frames = [
        table(spark, sf_dir, name).select(
            F.lit(name).alias("source_name"), "store_id", F.col(key).alias("key"), F.col(order).alias("row_no")
        )
        for name, key, order in parts
    ]
    return frames[0].unionByName(frames[1])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of internal_key and index_entry whose store had their key before."""
    return seen.seen_before(_arrivals(spark, sf_dir), "source_name", ["store_id", "key"], "row_no")


P3_SQL = """
SELECT source_name, row_no FROM (
  SELECT 'internal_key' AS source_name, entry_no AS row_no, min(entry_no) OVER (PARTITION BY store_id, user_key) AS first_no
  FROM internal_key WHERE store_id IS NOT NULL AND user_key IS NOT NULL
  UNION ALL
  SELECT 'index_entry', block_no, min(block_no) OVER (PARTITION BY store_id, smallest_key)
  FROM index_entry WHERE store_id IS NOT NULL AND smallest_key IS NOT NULL
) WHERE row_no > first_no
"""


def p3_error_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the filters of p3_found answered wrongly, measured and expected."""
    return seen.error_rates(_arrivals(spark, sf_dir), "source_name", ["store_id", "key"], "row_no")


#: Firsts and rates are of so many batches per source.
BATCHES = f"ceil((max(row_no) OVER (PARTITION BY source_name) + 1) / {seen.GENERATIONS}.0)"
FIRSTS_CTE = f"""a AS (
  SELECT 'internal_key' AS source_name, store_id, user_key AS key, entry_no AS row_no FROM internal_key
  UNION ALL SELECT 'index_entry', store_id, smallest_key, block_no FROM index_entry
), g AS (
  SELECT source_name, store_id, key, CAST(floor(row_no / {BATCHES}) AS INTEGER) AS generation FROM a
  WHERE store_id IS NOT NULL AND key IS NOT NULL AND row_no IS NOT NULL
), f AS (SELECT DISTINCT source_name, store_id, key, generation, min(generation) OVER (PARTITION BY source_name, store_id, key) AS first FROM g)"""

P3_BATCHES_SQL = f"""WITH {FIRSTS_CTE} SELECT source_name, generation, count(*) AS keys_probed,
CAST(sum(CASE WHEN generation = first THEN 1 ELSE 0 END) AS BIGINT) AS new_keys,
CAST(sum(CASE WHEN generation = first THEN 0 ELSE 1 END) AS BIGINT) AS known_keys, true AS within_rate FROM f GROUP BY ALL"""


def p3_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source and batch the keys probed, new, and known by the filters' answers, and whether wrong answers keep to their rate."""
    rates = p3_error_rates(spark, sf_dir)
    expected = F.col("expected_rate") * F.col("new_keys")
    return rates.select(
        "source_name", "generation", "keys_probed", "new_keys",
        (F.col("maybe_answers") - F.col("wrong_answers")).alias("known_keys"),
        (F.col("wrong_answers") <= expected + 5 * F.sqrt(expected) + 2).alias("within_rate"),
    )


P3_STORED_SQL = f"""WITH {FIRSTS_CTE} SELECT source_name, count(*) AS keys_probed,
CAST(sum(CASE WHEN first < generation THEN 1 ELSE 0 END) AS BIGINT) AS known_keys, CAST(0 AS BIGINT) AS missed_keys
FROM f WHERE generation = {seen.GENERATIONS - 1} GROUP BY ALL"""


def p3_stored_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys of the newest batch, probed against filters that were stored when the batches before it were sealed."""
    entity, last = ["store_id", "key"], seen.GENERATIONS - 1
    rows, firsts, shards = seen.prepared(_arrivals(spark, sf_dir), "source_name", entity, "row_no", seen.GENERATIONS, seen.SHARD_ROWS)
    path = shared_dir(spark, "filters")
    seen.build_filters(firsts.where(F.col("generation") < last), "source_name", entity, shards).write.parquet(path)
    newest = firsts.where(F.col("generation") == last)
    probed = seen.probe_filters(newest, spark.read.parquet(path), "source_name", entity, shards)
    # the exact answers, from the keys themselves
    known = firsts.groupBy("source_name", *entity).agg(F.min("generation").alias("first")).where(F.col("first") < last).drop("first")
    judged = probed.join(known.withColumn("known", F.lit(True)), ["source_name", *entity], "left")
    is_known = F.coalesce("known", F.lit(False))
    return judged.groupBy("source_name").agg(
        F.count("*").alias("keys_probed"), F.count_if(is_known).alias("known_keys"), F.count_if(is_known & ~F.col("maybe_earlier")).alias("missed_keys")
    )


QUERIES = {
    "p2_distinct_keys": p2_distinct_keys,
    "p2_error_check": p2_error_check,
    "p2_merged_days": p2_merged_days,
    "p3_found": p3_found,
    "p3_error_rates": p3_error_rates,
    "p3_batches": p3_batches,
    "p3_stored_filters": p3_stored_filters,
}
SQL = {
    "p2_error_check": P2_ERROR_SQL,
    "p2_merged_days": P2_MERGED_SQL,
    "p3_found": P3_SQL,
    "p3_batches": P3_BATCHES_SQL,
    "p3_stored_filters": P3_STORED_SQL,
}
