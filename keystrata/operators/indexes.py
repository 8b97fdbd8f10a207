"""Secondary, inverted, vector and spatial access, partitioning, and workload generation."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keystrata.functions.bounded import use_all_cores
from keystrata.functions.codec import interleave
from keystrata.sources.files import locate
from keystrata.sources.shared import shared_dir

#: Query vectors and rows that a task multiplies at once.
QUERY_BLOCK, ROW_BLOCK = 512, 20_000
#: Rows from which centroids, or bounds of ranges, are taken at most, and rounds of fitting centroids.
SAMPLE_ROWS, ROUNDS = 50_000, 12


def secondary_index(df: DataFrame, attribute: str, key: str) -> DataFrame:
    """Attribute value to key, in attribute order within each file; rows without either are not indexed.

    Ranges are of both columns, so the keys of a frequent value go over several files.
    """
    return df.dropna(subset=[attribute, key]).select(attribute, key).repartitionByRange(attribute, key).sortWithinPartitions(attribute, key)


#: Runs of letters and digits of any script, and of ASCII alone.
ANY_WORDS, ASCII_WORDS = r"[^\p{L}\p{N}]+", "[^a-z0-9]+"


def postings(df: DataFrame, key: str, text: str, between: str = ASCII_WORDS, positions: bool = False) -> DataFrame:
    """Inverted index: (term, key, n) over the lower-case words of whole texts, with their ``positions`` if asked.

    ``between`` is the pattern of what stands between words.  ``positions`` (from 0, ascending) are places among the
    text's words.  Rows with a null key or text are not indexed.  A key in several rows has its texts counted together,
    each with its own positions from 0 on.
    """
    words = F.filter(F.split(F.lower(F.col(text)), between), lambda t: t != "")
    rows = use_all_cores(df.dropna(subset=[key, text]).select(F.col(key).alias("key"), F.col(text).alias("text")))
    if not positions:
        return rows.select(F.col("key").alias(key), F.explode(words).alias("term")).groupBy("term", key).agg(F.count("*").alias("n"))
    placed = rows.select("key", F.posexplode(words).alias("place", "term"))
    found = placed.groupBy("term", "key").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("place")).alias("positions"))
    return found.select("term", F.col("key").alias(key), "n", "positions")


def phrase(index: DataFrame, key: str, terms: list[str]) -> DataFrame:
    """(key, starts): where the terms stand one after the other, from an index with positions.

    Each list is moved back by its term's place in the phrase, and the lists of a document are intersected.
    """
    found = None
    for i, term in enumerate(terms):
        moved = F.transform("positions", lambda p: p - F.lit(i))
        one = index.where(F.col("term") == term).select(key, moved.alias("here"))
        found = one.withColumnRenamed("here", "starts") if found is None else found.join(one, key).select(key, F.array_intersect("starts", "here").alias("starts"))
    return found.where(F.size("starts") > 0)


def _matrix(column: pa.ChunkedArray | pa.Array, n: int) -> np.ndarray:
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))


def _best(ids: np.ndarray, vectors: np.ndarray, asked: np.ndarray, asked_vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, key, distance) of the ``k`` rows nearest to each query, itself left out, by exact distances; ties: the smaller key."""
    d = (asked_vectors**2).sum(1)[:, None] - 2 * asked_vectors @ vectors.T + (vectors**2).sum(1)[None, :]
    d[asked[:, None] == ids[None, :]] = np.inf
    out: list[list] = [[], [], []]
    for i in range(len(asked)):
        order = np.lexsort((ids, d[i]))[: k + 1]
        order = order[np.isfinite(d[i][order])][:k]
        out[0].append(np.full(len(order), asked[i]))
        out[1].append(ids[order])
        out[2].append(np.sqrt(((vectors[order] - asked_vectors[i]) ** 2).sum(1)))
    return tuple(np.concatenate(c) if c else np.zeros(0) for c in out)


def _ranked(met: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy("distance", "key")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        F.col("q").alias("query"), "rank", F.col("key").alias("neighbour"), "distance"
    )


def _vectors(df: DataFrame, key: str, vector: str, names: tuple[str, str]) -> DataFrame:
    return df.dropna(subset=[key, vector]).select(F.col(key).cast("long").alias(names[0]), F.col(vector).cast("array<double>").alias(names[1]))


def nearest(df: DataFrame, queries: DataFrame, key: str, vector: str, k: int, query_block: int = QUERY_BLOCK) -> DataFrame:
    """Exact search: for each query the ``k`` rows at the least Euclidean distance (ties: the smaller key), itself not.

    Rows stay where they are.  The queries are written to the shared folder, and each task goes through them in
    blocks of ``query_block`` for every ``ROW_BLOCK`` of its rows, one matrix product each; only each block's best
    ``k`` are shuffled.  Rows without a vector are left out; all vectors have the same length.  Keys are integers.
    Columns: query, ``rank`` (from 1), neighbour, distance.
    """
    path = shared_dir(df.sparkSession, "queries")
    _vectors(queries, key, vector, ("q", "qv")).write.parquet(path)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def met() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held)
            ids, vectors = rows["key"].to_numpy(), _matrix(rows["v"], len(rows))
            files, at = locate(path)
            for block in ds.dataset(at, format="parquet", filesystem=files).to_batches(batch_size=query_block):
                if block.num_rows:
                    found = _best(ids, vectors, block.column("q").to_numpy(), _matrix(block.column("qv"), block.num_rows), k)
                    yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.float64())], names=["q", "key", "distance"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= ROW_BLOCK:
                yield from met()
                held = []
        if held:
            yield from met()

    rows = use_all_cores(_vectors(df, key, vector, ("key", "v")))
    return _ranked(rows.mapInArrow(best, "q bigint, key bigint, distance double"), k)


def train_centroids(df: DataFrame, key: str, vector: str, lists: int, sample_rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Centroids of ``lists`` groups of vectors, fitted by k-means on the at most ``sample_rows`` rows of least hash."""
    rows = _vectors(df, key, vector, ("key", "v")).orderBy(F.xxhash64("key"), "key").limit(sample_rows).collect()
    x = np.array([r["v"] for r in rows])
    if not len(x):
        return np.zeros((0, 0))
    centroids = x[np.linspace(0, len(x) - 1, min(lists, len(x))).astype(int)].copy()
    for _ in range(ROUNDS):
        own = _nearest_centroids(x, centroids, 1)[:, 0]
        for c in range(len(centroids)):
            if (own == c).any():
                centroids[c] = x[own == c].mean(0)
    return centroids


def _nearest_centroids(x: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    d = -2 * x @ centroids.T + (centroids**2).sum(1)[None, :]
    return np.argsort(d, axis=1, kind="stable")[:, :n]


def inverted_lists(df: DataFrame, key: str, vector: str, centroids: np.ndarray, n: int = 1) -> DataFrame:
    """(key, v, list_no) of every row with a vector: the list of its nearest centroid, or of each of its ``n`` nearest."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = _nearest_centroids(_matrix(batch.column(1), batch.num_rows), centroids, n)
                rows = batch.take(pa.array(np.repeat(np.arange(batch.num_rows), near.shape[1])))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(near.ravel(), pa.int32())], names=["key", "v", "list_no"])

    return _vectors(df, key, vector, ("key", "v")).mapInArrow(assign, "key bigint, v array<double>, list_no int")


def nearest_in_lists(index: DataFrame, queries: DataFrame, key: str, vector: str, centroids: np.ndarray, k: int, probes: int) -> DataFrame:
    """Approximate search: like ``nearest``, among the rows of the ``probes`` lists nearest to each query only.

    ``index`` is a written table of ``inverted_lists``.  Lists, and the queries that probe one, are cut into blocks
    by hash, so a list that holds a third of all rows is searched by many tasks.
    """
    asked = inverted_lists(queries, key, vector, centroids, probes).select(F.col("key").alias("q"), F.col("v").alias("qv"), "list_no")
    # one row per list
    parts = index.groupBy("list_no").agg(F.ceil(F.count("*") / ROW_BLOCK).alias("row_parts"))
    blocks = asked.groupBy("list_no").agg(F.ceil(F.count("*") / QUERY_BLOCK).alias("query_parts"))
    sizes = F.broadcast(parts.join(blocks, "list_no"))

    def to_all(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    rows = index.join(sizes, "list_no").select("list_no", "key", "v", F.pmod(F.xxhash64("key"), "row_parts").alias("row_part"), to_all("query_parts").alias("query_part"))
    asked = asked.join(sizes, "list_no").select("list_no", "q", "qv", F.pmod(F.xxhash64("q"), "query_parts").alias("query_part"), to_all("row_parts").alias("row_part"))
    at = ["list_no", "row_part", "query_part"]

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = not len(left) or not len(right)
        found = ([], [], []) if empty else _best(left["key"].to_numpy(), _matrix(left["v"], len(left)), right["q"].to_numpy(), _matrix(right["qv"], len(right)), k)
        types = (pa.int64(), pa.int64(), pa.float64())
        return pa.table([pa.array(c, t) for c, t in zip(found, types)], names=["q", "key", "distance"])

    met = rows.groupBy(*at).cogroup(asked.groupBy(*at)).applyInArrow(best, "q bigint, key bigint, distance double")
    return _ranked(met, k)


def z_order(df: DataFrame, a: str, b: str) -> DataFrame:
    """Add ``z``, the interleaved bits of two non-negative integer columns; null where one is null."""
    return df.withColumn("z", interleave(F.col(a), F.col(b)))


def box(df: DataFrame, a: str, b: str, low: tuple[int, int], high: tuple[int, int]) -> DataFrame:
    """Rows with both numbers within the box.

    The range of ``z`` from the low to the high corner holds them all and is what a sorted file is pruned by; the
    exact condition drops the rest.
    """

    def code(x: int, y: int) -> int:
        return sum(((x >> i & 1) << (2 * i)) | ((y >> i & 1) << (2 * i + 1)) for i in range(31))

    inside = F.col(a).between(low[0], high[0]) & F.col(b).between(low[1], high[1])
    return df.where(inside & F.col("z").between(code(*low), code(*high)))


def write_z_ordered(df: DataFrame, a: str, b: str, path: str, row_group_bytes: int = 1 << 20) -> None:
    """Write rows sorted by ``z``, so that each row group covers a small box of both columns and a box read skips the others.

    Ranges go by all of ``z``, ``a`` and ``b``; rows with a null in either come first.
    """
    rows = z_order(df, a, b).repartitionByRange("z", a, b).sortWithinPartitions("z")
    rows.write.option("parquet.block.size", row_group_bytes).parquet(path)


def hilbert(a: Column, b: Column, bits: int = 31) -> Column:
    """The place of two non-negative numbers of ``bits`` bits on a Hilbert curve; null where one is null.

    From the highest bit on, each pair of bits names a quarter, and the quarter's turn is undone for what follows.
    """
    state = F.struct(a.cast("long").alias("x"), b.cast("long").alias("y"), F.lit(0).cast("long").alias("d"))

    def step(s: Column, i: Column) -> Column:
        side = F.call_function("shiftleft", F.lit(1).cast("long"), i)
        right, up = (s["x"].bitwiseAND(side) != 0), (s["y"].bitwiseAND(side) != 0)
        quarter = F.when(right, F.when(up, 2).otherwise(3)).otherwise(F.when(up, 1).otherwise(0))
        x, y = s["x"].bitwiseAND(side - 1), s["y"].bitwiseAND(side - 1)
        x, y = F.when(up | ~right, x).otherwise(side - 1 - x), F.when(up | ~right, y).otherwise(side - 1 - y)
        return F.struct(
            F.when(up, x).otherwise(y).alias("x"), F.when(up, y).otherwise(x).alias("y"),
            (s["d"] * 4 + quarter).alias("d"),
        )

    folded = F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), state, step, lambda s: s["d"])
    return F.when(a.isNotNull() & b.isNotNull(), folded)


def shard_of(key: Column, shards: int, portable: bool = False) -> Column:
    """Hash partitioning: which of ``shards`` holds a key; with ``portable`` by an MD5 digest, as other systems have it too."""
    if portable:
        return (portable_hash(key) % shards).cast("int")
    return F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")


def portable_hash(key: Column) -> Column:
    """The first 32 bits of the MD5 digest."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")


def hash_ring(nodes: list[str], points: int = 64) -> list[tuple[int, str]]:
    """The places on the ring of each node, in order."""
    return sorted((int(hashlib.md5(f"{n}|{i}".encode()).hexdigest()[:8], 16), n) for n in nodes for i in range(points))


def ring_node(key: Column, ring: list[tuple[int, str]]) -> Column:
    """The node of the first place on the ring at or after the key's hash, past its end the first of all.

    A node that joins takes keys from its successors only.
    """
    places, names = F.array(*[F.lit(p).cast("long") for p, _ in ring]), F.array(*[F.lit(n) for _, n in ring])
    before = F.size(F.filter(places, lambda p: p < portable_hash(key)))
    return F.get(names, before % F.lit(len(ring)))


def range_bounds(df: DataFrame, key: str, parts: int, sample_rows: int = SAMPLE_ROWS) -> list:
    """Keys that cut a table into about equal ranges, from the at most ``sample_rows`` rows of least hash."""
    sample = df.where(F.col(key).isNotNull()).select(key).orderBy(F.xxhash64(key), key).limit(sample_rows)
    keys = sorted(r[0] for r in sample.collect())
    return sorted({keys[len(keys) * i // parts] for i in range(1, parts)}) if keys else []


def range_of(key: Column, bounds: list) -> Column:
    """Range partitioning: how many of the bounds are not above the key; a null key is in the first range."""
    if not bounds:
        return F.lit(0)
    return F.coalesce(F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= key)), F.lit(0))


def rendezvous(key: Column, nodes: list[str]) -> Column:
    """The node with the highest hash of key and node; adding a node moves only the keys that it takes."""
    return F.greatest(*[F.struct(F.xxhash64(key, F.lit(n)).alias("h"), F.lit(n).alias("node")) for n in nodes])["node"]


#: Shares of read, update, insert, scan and read-modify-write in the public YCSB workloads.
YCSB = {
    "A": (0.5, 0.5, 0.0, 0.0, 0.0),
    "B": (0.95, 0.05, 0.0, 0.0, 0.0),
    "C": (1.0, 0.0, 0.0, 0.0, 0.0),
    "D": (0.95, 0.0, 0.05, 0.0, 0.0),
    "E": (0.0, 0.0, 0.05, 0.95, 0.0),
    "F": (0.5, 0.0, 0.0, 0.0, 0.5),
}
YCSB_OPERATIONS = ("read", "update", "insert", "scan", "read_modify_write")


def hash_fraction(*parts: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of an MD5 digest."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def workload(df: DataFrame, key: str, order: str, name: str, seed: int = 42) -> DataFrame:
    """Operations of workload ``name`` over the rows' keys: (order, key, operation), the same for the same seed."""
    at = hash_fraction(F.lit(f"{seed}{name}"), F.col(order).cast("string"))
    chosen, bound = None, 0.0
    for operation, share in zip(YCSB_OPERATIONS, YCSB[name]):
        if share:
            bound += share
            chosen = F.when(at < bound, operation) if chosen is None else chosen.when(at < bound, operation)
    last = next(o for o, s in reversed(list(zip(YCSB_OPERATIONS, YCSB[name]))) if s)
    return df.select(F.col(order).alias("op_no"), F.col(key).alias("key"), chosen.otherwise(last).alias("operation"))
