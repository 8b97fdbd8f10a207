"""Finding hot groups with a bounded pre-pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: No more hot buckets than this are kept on the driver; beyond it every row counts as hot.
MAX_HOT_BUCKETS = 4096
MAX_BUCKETS = 1 << 20


def hot_condition(df: DataFrame, keys: list[str], group_rows: int, total: int | None = None) -> Column:
    """A condition that holds for every row of a group of more than ``group_rows`` rows (and for few others).

    Groups are hashed to buckets and only the buckets are counted, with map-side combining: at most
    ``MAX_BUCKETS`` counters exist however many groups there are, and only the ids of hot buckets come to the
    driver, at most ``MAX_HOT_BUCKETS``.  If there are more, the condition is true for all rows, so callers must
    treat a hot row in a way that is right for any row.
    """
    total = df.count() if total is None else total
    if total <= group_rows:
        return F.lit(False)
    buckets = 256
    while buckets < MAX_BUCKETS and total / buckets > group_rows / 16:
        buckets *= 2
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    hot = (
        df.select(bucket.alias("bucket"))
        .groupBy("bucket")
        .count()
        .where(F.col("count") > group_rows)
        .select("bucket")
        .limit(MAX_HOT_BUCKETS + 1)
        .collect()
    )
    if not hot:
        return F.lit(False)
    if len(hot) > MAX_HOT_BUCKETS:
        return F.lit(True)
    return bucket.isin([r.bucket for r in hot])
