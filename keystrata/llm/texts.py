"""Queries of the packing, leak and reading-level problems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.llm import leak, packing, reading, tokens
from keystrata.sources.shared import shared_dir
from keystrata.sources.tables import table

#: Specifications that are packed for at once; more are taken in blocks.
SPEC_BLOCK = 100


def _packed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, dict[int, int]]:
    """The containers, the texts' sizes, and the capacities."""
    rows = table(spark, sf_dir, "container_spec").where("capacity_tokens > 0").orderBy("spec_id").collect()
    capacities = [(r["spec_id"], r["capacity_tokens"]) for r in rows]
    # texts are counted once; the counts, two numbers per document, are read for each use
    path = shared_dir(spark, "token-counts")
    tokens.token_counts(table(spark, sf_dir, "documents"), "doc_id", "text").write.parquet(path)
    sizes = spark.read.parquet(path)
    packed = packing.pack(sizes, "doc_id", "n_tokens", dict(capacities[:SPEC_BLOCK]))
    for i in range(SPEC_BLOCK, len(capacities), SPEC_BLOCK):
        packed = packed.unionByName(packing.pack(sizes, "doc_id", "n_tokens", dict(capacities[i : i + SPEC_BLOCK])))
    return packed, sizes, dict(capacities)


def _capacity(capacities: dict[int, int]) -> Column:
    """The capacity of a row's specification."""
    known = F.create_map(*[x for i, c in capacities.items() for x in (F.lit(i), F.lit(c).cast("long"))])
    return known[F.col("spec_id")]


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every document, or of every piece of one longer than the capacity, for each capacity."""
    return _packed(spark, sf_dir)[0]


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens and filled share per capacity, with the least number of containers possible."""
    packed, _, capacities = _packed(spark, sf_dir)
    used = packed.groupBy("spec_id", "container_id").agg(F.sum("size").alias("n"))
    total = used.groupBy("spec_id").agg(F.count("*").alias("containers"), F.sum("n").alias("tokens"))
    capacity = _capacity(capacities)
    return total.withColumn("least_containers", F.ceil(F.col("tokens") / capacity)).withColumn(
        "filled", F.col("tokens") / (F.col("containers") * capacity)
    )


P6_CHECK_SQL = """SELECT spec_id, (SELECT count(*) FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL) AS documents,
CAST(0 AS BIGINT) AS tokens_lost, CAST(0 AS BIGINT) AS wrongly_divided, CAST(0 AS BIGINT) AS overfull_containers, true AS within_bound
FROM container_spec WHERE capacity_tokens > 0"""


def p6_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per capacity: documents packed, tokens not packed, documents divided though they need not be or in too many pieces, containers too
    full, and whether the containers are within the method's bound: 1.7 times the least number, and one of each class and worker."""
    packed, sizes, capacities = _packed(spark, sf_dir)
    capacity, workers = _capacity(capacities), max(1, -(-sizes.count() // packing.WORKER_ITEMS))
    used = packed.groupBy("spec_id", "container_id").agg(F.sum("size").alias("n"))
    boxes = used.groupBy("spec_id").agg(
        F.count_if(F.col("n") > capacity).alias("overfull_containers"), F.count("*").alias("containers"), F.sum("n").alias("tokens")
    )
    pieces = packed.groupBy("spec_id", "doc_id").agg(F.count("*").alias("pieces"), F.sum("size").alias("packed"))
    judged = pieces.join(sizes, "doc_id").groupBy("spec_id").agg(
        F.count("*").alias("documents"),
        F.sum(F.col("n_tokens") - F.col("packed")).alias("tokens_lost"),
        F.count_if(F.col("pieces") != F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / capacity))).alias("wrongly_divided"),
    )
    bound = 1.7 * F.ceil(F.col("tokens") / capacity) + packing.CLASSES * workers + 1
    return judged.join(boxes, "spec_id").select(
        "spec_id", "documents", "tokens_lost", "wrongly_divided", "overfull_containers", (F.col("containers") <= bound).alias("within_bound")
    )


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item")
    return leak.find_leaks(spark, docs, "doc_id", "text", items, "item_id", "passage")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the test items of which they hold at least 12 successive words."""
    return _matches(spark, sf_dir).where(F.col("words") >= leak.MIN_WORDS).select("doc_id", "item_id").distinct()


def p7_leaked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per test item the documents that hold it exactly, and those that only come near."""
    exact = F.col("words") >= leak.MIN_WORDS
    return _matches(spark, sf_dir).groupBy("item_id").agg(
        F.count_if(exact).alias("exact_documents"),
        F.count_if(~exact).alias("near_documents"),
        F.max("words").alias("longest_words"),
    )


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reading level of every document of at least 30 spoken words."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_label")
    return reading.reading_levels(spark, docs, "doc_id", "text", labels, "doc_id", "reading_level", language="lang")


P8_CHECK_SQL = """SELECT count(*) AS ratings, true AS levels_valid, true AS one_level_each, true AS raters_agree
FROM reading_label WHERE reading_level BETWEEN 1 AND 5"""


def p8_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings, whether all levels are from 1 to 5, one per document, and those of four fifths of the ratings, which err themselves."""
    path = shared_dir(spark, "levels")
    p8_found(spark, sf_dir).write.parquet(path)
    levels = spark.read.parquet(path)
    ratings = table(spark, sf_dir, "reading_label").where(F.col("reading_level").between(1, 5))
    valid = levels.agg(
        F.coalesce(F.bool_and(F.col("reading_level").between(1, 5)), F.lit(True)).alias("levels_valid"),
        (F.count("*") == F.count_distinct("doc_id")).alias("one_level_each"),
    )
    met = ratings.join(levels.withColumnRenamed("reading_level", "found"), "doc_id").agg(
        (F.count_if(F.col("found") == F.col("reading_level")) >= 0.8 * F.count("*")).alias("raters_agree")
    )
    # one row each
    counted = ratings.agg(F.count("*").alias("ratings")).withColumn("at", F.lit(1))
    return counted.join(valid.withColumn("at", F.lit(1)), "at").join(met.withColumn("at", F.lit(1)), "at").drop("at")


QUERIES = {
    "p6_containers": p6_containers,
    "p6_fill": p6_fill,
    "p6_check": p6_check,
    "p7_found": p7_found,
    "p7_leaked_items": p7_leaked_items,
    "p8_found": p8_found,
    "p8_check": p8_check,
}
SQL = {"p6_check": P6_CHECK_SQL, "p8_check": P8_CHECK_SQL}
