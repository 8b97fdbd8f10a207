"""Filling containers of fixed capacity with items of varying length."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Number of classes.  Class k below the last takes k items per container; the last takes all smaller items.
CLASSES = 32
#: Items of a worker; each worker leaves at most one container per class partly filled.
WORKER_ITEMS = 100_000


def pieces(sizes: DataFrame, key: str, size: str, capacities: dict[int, int]) -> DataFrame:
    """Items of at most the capacity, for each specification: (spec_id, capacity, key, piece_no, start, size).

    Only what is longer than the capacity is divided, into full pieces and a last one of what remains.
    """
    specs = F.array(*[F.struct(F.lit(i).alias("spec_id"), F.lit(c).cast("long").alias("capacity")) for i, c in capacities.items()])
    each = sizes.dropna(subset=[key, size]).select(key, F.col(size).alias("n"), F.explode(specs).alias("spec")).select(key, "n", "spec.*")
    last = F.greatest(F.ceil(F.col("n") / F.col("capacity")) - 1, F.lit(0))
    cut = each.withColumn("piece_no", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    start = F.col("piece_no") * F.col("capacity")
    return cut.select("spec_id", "capacity", key, "piece_no", start.alias("start"), F.least(F.col("n") - start, F.col("capacity")).alias("size"))


def pack(sizes: DataFrame, key: str, size: str, capacities: dict[int, int], *, worker_items: int = WORKER_ITEMS) -> DataFrame:
    """Assign items to containers: (spec_id, container_id, key, piece_no, start, size).

    ``capacities`` maps a spec to its capacity.  Harmonic packing: an item of more than 1/(k+1) and at most 1/k of
    the capacity is of class k, and k items of a class fill a container whatever their sizes, so containers are
    numbered by counting.  The last class, of at most 1/``CLASSES``, is numbered by running sums: a container takes
    the items that begin within its capacity less the largest of that class.  Items are spread over workers by a
    hash of their key, and each worker counts for itself.
    What an item of more than half leaves free takes one item of the class whose largest size fits there: the i-th
    such item of a worker takes the i-th item of that class, and the rest of the class goes to containers of its own.

    A key in several rows is an item for each.  Items of size 0 are of the last class.  Negative and null sizes and null keys are none and are left out.
    """
    capacity = F.col("capacity")
    classes = F.least(F.lit(CLASSES), capacity)
    k = F.least(F.floor(capacity / F.greatest(F.col("size"), F.lit(1))), classes)
    free = capacity - F.col("size")
    j = F.ceil(capacity / F.when(free > 0, free))
    host = (k == 1) & (free > 0) & (j < classes)
    parts = pieces(sizes.where(F.col(size) >= 0), key, size, capacities).select(
        "spec_id", key, "piece_no", "start", "size", k.alias("k"),
        F.coalesce(host, F.lit(False)).alias("host"), F.when(host, j).otherwise(k).alias("j"),
        classes.alias("classes"), (capacity - F.floor(capacity / classes)).alias("room"),
    )
    workers = max(1, -(-sizes.count() // worker_items))
    spread = parts.withColumn("worker", F.pmod(F.xxhash64(key, "piece_no"), F.lit(workers))).repartition("spec_id", "worker", "j")
    place = ["spec_id", "worker", "j"]
    in_order = Window.partitionBy(*place, "host").orderBy(key, "piece_no")
    before = F.coalesce(F.sum("size").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = spread.select(
        "*",
        (F.row_number().over(in_order) - 1).alias("nth"),
        F.when(F.col("k") == F.col("classes"), before).alias("before"),
        F.count_if("host").over(Window.partitionBy(*place)).alias("hosts"),
    )
    guest = ~F.col("host") & (F.col("nth") < F.col("hosts"))
    shared = F.col("host") | guest
    number = (
        F.when(shared, F.col("nth"))
        .when(F.col("before").isNotNull(), F.floor(F.col("before") / F.greatest(F.col("room"), F.lit(1))))
        .otherwise(F.floor((F.col("nth") - F.col("hosts")) / F.col("k")))
    )
    name = F.concat_ws("-", F.col("worker"), F.when(shared, "h").otherwise("c"), F.col("j"), number)
    return numbered.select("spec_id", name.alias("container_id"), key, "piece_no", "start", "size")
