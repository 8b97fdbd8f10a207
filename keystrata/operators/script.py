"""Scripts of commands, run as one query."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Lines per chunk; within one chunk and key the lines are ordered together.
CHUNK_LINES = 65_536


def last_before(df: DataFrame, keys: list[str], order: str, payload: str, name: str, chunk: int = CHUNK_LINES) -> DataFrame:
    """Add the last non-null ``payload`` of an earlier row with the same keys.

    A window over chunks of ``chunk`` order values finds it within the chunk.  What a key brings along from the
    chunks before is one row per key and chunk, so a hot key's rows are not ordered in one place.
    """
    cut = df.withColumn("_chunk", F.floor(F.col(order) / chunk))
    near = Window.partitionBy(*keys, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    cut = cut.withColumn("_near", F.last(payload, ignorenulls=True).over(near))
    ends = cut.groupBy(*keys, "_chunk").agg(
        F.max(F.when(F.col(payload).isNotNull(), F.struct(F.col(order).alias("o"), F.col(payload).alias("p")))).alias("_end")
    )
    chunks = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*keys, "_chunk", F.last("_end", ignorenulls=True).over(chunks)["p"].alias("_far"))
    return cut.join(ends, [*keys, "_chunk"]).withColumn(name, F.coalesce("_near", "_far")).drop("_near", "_far", "_chunk")


def run_script(lines: DataFrame) -> DataFrame:
    """Run (line_no, line): one row per line that answers, with ``reply``.

    Words are split at single spaces and empty ones dropped.  Verbs are case-sensitive.  PUT and DEL answer OK,
    GET the value or (nil), a wrong number of words its usage, another verb "Unknown command: X".  EXIT or QUIT
    ends the script.  Blank lines and null lines answer nothing.
    """
    words = F.filter(F.split("line", " ", -1), lambda w: w != "")
    rows = lines.where(F.col("line_no").isNotNull()).select("line_no", words.alias("w")).where(F.size("w") > 0)
    verb, n = F.get("w", F.lit(0)), F.size("w")
    rows = rows.select("line_no", "w", verb.alias("verb"), n.alias("n"))
    stop = rows.where(F.col("verb").isin("EXIT", "QUIT")).agg(F.min("line_no"))
    rows = rows.where(F.col("line_no") < F.coalesce(stop.scalar(), F.lit((1 << 63) - 1)))
    put, get, delete = ((F.col("verb") == v) & (F.col("n") == k) for v, k in (("PUT", 3), ("GET", 2), ("DEL", 2)))
    known = put | get | delete
    other = rows.where(~known).select(
        "line_no",
        F.when(F.col("verb") == "PUT", "Usage: PUT <key> <value>")
        .when(F.col("verb") == "GET", "Usage: GET <key>")
        .when(F.col("verb") == "DEL", "Usage: DEL <key>")
        .otherwise(F.concat(F.lit("Unknown command: "), F.col("verb")))
        .alias("reply"),
    )
    change = F.when(put, F.struct(F.lit(False).alias("dead"), F.get("w", F.lit(2)).alias("value"))).when(
        delete, F.struct(F.lit(True).alias("dead"), F.lit(None).cast("string").alias("value"))
    )
    keyed = rows.where(known).select("line_no", "verb", F.get("w", F.lit(1)).alias("key"), change.alias("change"))
    seen = last_before(keyed, ["key"], "line_no", "change", "last")
    answered = seen.select(
        "line_no",
        F.when(F.col("verb") != "GET", "OK")
        .when(F.col("last").isNull() | F.col("last.dead"), "(nil)")
        .otherwise(F.col("last.value"))
        .alias("reply"),
    )
    return answered.unionByName(other)
