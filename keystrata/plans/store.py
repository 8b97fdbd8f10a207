"""Queries of the key-value engine over the store tables, with their SQL."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keystrata.functions import codec
from keystrata.operators import changelog, compaction, indexes, reads, runs
from keystrata.operators.script import run_script
from keystrata.sources import runfile, wal
from keystrata.sources.shared import shared_dir
from keystrata.sources.tables import table
from keystrata.streaming.feed import watch

#: A key that every store has, and one that none has.
SHARED_KEY, ABSENT_KEY = b"meta/agent/heartbeat", b"no/such/key"
SNAPSHOT = 1500
LAG = 500
NOW, TTL = "2025-05-20 00:00:00", "30 DAYS"
VALUE_THRESHOLD = 32
TOP = 100

LOG_CTE = """log AS (
  SELECT DISTINCT store_id, sequence, key,
    CASE WHEN dead THEN ''::BLOB ELSE coalesce(value, ''::BLOB) END AS value, dead AS tombstone
  FROM (SELECT *, CASE WHEN lower(trim(op)) IN ('del', '1') THEN true WHEN lower(trim(op)) IN ('put', '0') THEN false
                       ELSE coalesce(tombstone, false) END AS dead FROM wal_entry)
  WHERE store_id IS NOT NULL AND sequence IS NOT NULL AND key IS NOT NULL
)"""
RUNS_CTE = """runs AS (
  SELECT DISTINCT store_id, run_id, level, user_key AS key, sequence, coalesce(tombstone, false) AS tombstone,
    CASE WHEN coalesce(tombstone, false) THEN ''::BLOB ELSE coalesce(value, ''::BLOB) END AS value
  FROM internal_key
  WHERE store_id IS NOT NULL AND run_id IS NOT NULL AND user_key IS NOT NULL AND sequence IS NOT NULL
)"""
LATEST_CTE = f"""{LOG_CTE}, latest AS (
  SELECT store_id, key, max(sequence) AS sequence, arg_max(tombstone, sequence) AS tombstone, arg_max(value, sequence) AS value
  FROM log GROUP BY ALL
)"""


def log_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changelog.change_log(table(spark, sf_dir, "wal_entry"))


def runs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changelog.entries_of_runs(table(spark, sf_dir, "internal_key"))


def changes_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log with its copies, for reads that they do not alter."""
    return changelog.changes(table(spark, sf_dir, "wal_entry"))


def delivered_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs' entries with their copies, for merges that they do not alter."""
    return changelog.delivered_entries(table(spark, sf_dir, "internal_key"))


def stores_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "engine_config").select("store_id")


def shown(df: DataFrame, *names: str) -> DataFrame:
    """The columns with keys and values in hexadecimal."""
    hidden = {"key": "key_hex", "value": "value_hex", "smallest_key": "smallest_key_hex"}
    return df.select(*[F.hex(n).alias(hidden[n]) if n in hidden else F.col(n) for n in names])


QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    """Register a function as the query of its name, with its SQL."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


@query(f"WITH {LATEST_CTE} SELECT store_id, hex(key) AS key_hex, hex(value) AS value_hex FROM latest WHERE NOT tombstone")
def kv_latest(spark, sf_dir):
    """The current content of every store."""
    return shown(reads.live(changes_of(spark, sf_dir)), "store_id", "key", "value")


@query(f"WITH {LATEST_CTE} SELECT store_id, hex(key) AS key_hex, sequence, tombstone FROM latest")
def kv_entries_with_tombstones(spark, sf_dir):
    """Newest entries, deletes included."""
    return shown(reads.newest(changes_of(spark, sf_dir)), "store_id", "key", "sequence", "tombstone")


GET_SQL = f"""WITH {LATEST_CTE}, s AS (SELECT DISTINCT store_id FROM log)
SELECT s.store_id, hex('%s'::BLOB) AS key_hex, CASE WHEN l.key IS NULL THEN 'not_found' ELSE 'ok' END AS status, hex(l.value) AS value_hex
FROM s LEFT JOIN latest l ON l.store_id = s.store_id AND l.key = '%s'::BLOB AND NOT l.tombstone"""


@query(GET_SQL % (SHARED_KEY.decode(), SHARED_KEY.decode()))
def kv_get(spark, sf_dir):
    """A key that all stores have."""
    return shown(reads.get(changes_of(spark, sf_dir), SHARED_KEY, stores_of(spark, sf_dir)), "store_id", "key", "status", "value")


@query(GET_SQL % ("", ""))
def kv_get_empty_key(spark, sf_dir):
    """The empty key, which is a key like any other."""
    return shown(reads.get(changes_of(spark, sf_dir), b"", stores_of(spark, sf_dir)), "store_id", "key", "status", "value")


@query(GET_SQL % (ABSENT_KEY.decode(), ABSENT_KEY.decode()))
def kv_get_missing(spark, sf_dir):
    """A key that no store has."""
    return shown(reads.get(changes_of(spark, sf_dir), ABSENT_KEY, stores_of(spark, sf_dir)), "store_id", "key", "status", "value")


@query(f"""WITH {LATEST_CTE}, p AS (SELECT DISTINCT store_id, smallest_key AS key FROM index_entry WHERE smallest_key IS NOT NULL)
SELECT p.store_id, hex(p.key) AS key_hex, CASE WHEN l.key IS NULL THEN 'not_found' ELSE 'ok' END AS status, hex(l.value) AS value_hex
FROM p LEFT JOIN latest l ON l.store_id = p.store_id AND l.key = p.key AND NOT l.tombstone""")
def kv_multi_get(spark, sf_dir):
    """The keys with which blocks begin, looked up in the log."""
    probes = table(spark, sf_dir, "index_entry").select("store_id", F.col("smallest_key").alias("key")).dropna()
    return shown(reads.multi_get(changes_of(spark, sf_dir), probes), "store_id", "key", "status", "value")


@query(f"""WITH {LOG_CTE} SELECT store_id, count(*) AS writes, count(DISTINCT key) AS distinct_keys, min(sequence) AS min_sequence,
max(sequence) AS max_sequence, CAST(sum(CASE WHEN tombstone THEN 1 ELSE 0 END) AS BIGINT) AS deletes FROM log GROUP BY store_id""")
def kv_write_counts(spark, sf_dir):
    """Writes, keys, sequences and deletes per store."""
    return log_of(spark, sf_dir).groupBy("store_id").agg(
        F.count("*").alias("writes"),
        F.count_distinct("key").alias("distinct_keys"),
        F.min("sequence").alias("min_sequence"),
        F.max("sequence").alias("max_sequence"),
        F.count_if("tombstone").alias("deletes"),
    )


@query("""SELECT store_id, max(sequence) + 1 AS next_sequence FROM (
SELECT store_id, sequence FROM wal_entry WHERE key IS NOT NULL UNION ALL
SELECT store_id, sequence FROM internal_key WHERE user_key IS NOT NULL)
WHERE store_id IS NOT NULL AND sequence IS NOT NULL GROUP BY store_id""")
def kv_next_sequence(spark, sf_dir):
    """The sequence of each store's next write, over log and runs."""
    wal = table(spark, sf_dir, "wal_entry").dropna(subset=["store_id", "sequence", "key"])
    entries = table(spark, sf_dir, "internal_key").dropna(subset=["store_id", "sequence", "user_key"])
    return changelog.next_sequence(wal, entries)


@query(f"""WITH {LOG_CTE} SELECT store_id, hex(key) AS key_hex FROM log GROUP BY store_id, key
HAVING NOT arg_max(tombstone, sequence) AND bool_or(tombstone)""")
def kv_delete_then_put(spark, sf_dir):
    """Live keys that were deleted at some time before."""
    grouped = changes_of(spark, sf_dir).groupBy("store_id", "key").agg(
        F.max(F.struct("sequence", "tombstone")).alias("e"), F.bool_or("tombstone").alias("deleted")
    )
    return shown(grouped.where(F.col("deleted") & ~F.col("e.tombstone")), "store_id", "key")


def event_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a command script."""
    user = F.col("user_id").cast("string")
    line = (
        F.when(F.col("event_type") == "click", F.concat(F.lit("PUT "), user, F.lit("  v"), F.col("event_id").cast("string")))
        .when(F.col("event_type") == "error", F.concat(F.lit("DEL "), user))
        .when(F.col("event_type") == "view", F.concat(F.lit(" GET "), user))
        .when(F.col("event_type") == "signup", F.concat(F.lit("put "), user))
        .otherwise(F.concat(F.lit("PUT "), user))
    )
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("line_no"), line.alias("line"))


@query("""WITH e AS (SELECT event_id AS line_no, user_id, event_type FROM events),
c AS (SELECT *, last_value(CASE WHEN event_type IN ('click', 'error') THEN line_no END IGNORE NULLS) OVER
  (PARTITION BY user_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS at FROM e
  WHERE event_type IN ('click', 'error', 'view'))
SELECT c.line_no, CASE WHEN c.event_type <> 'view' THEN 'OK' WHEN p.event_type = 'click' THEN 'v' || p.line_no ELSE '(nil)' END AS reply
FROM c LEFT JOIN e p ON p.line_no = c.at
UNION ALL SELECT line_no, 'Unknown command: put' FROM e WHERE event_type = 'signup'
UNION ALL SELECT line_no, 'Usage: PUT <key> <value>' FROM e WHERE event_type NOT IN ('click', 'error', 'view', 'signup')""")
def kv_script_replay(spark, sf_dir):
    """The events as a script of PUT, GET, DEL, unknown and incomplete commands, run as one query."""
    return run_script(event_script(spark, sf_dir))


@query(f"""WITH {LOG_CTE} SELECT store_id, sequence, CAST(26 + octet_length(key) + octet_length(value) AS BIGINT) AS record_bytes,
CAST(octet_length(key) + octet_length(value) + 33 AS BIGINT) AS entry_bytes FROM log""")
def wal_record_sizes(spark, sf_dir):
    """Bytes of each log record, and of the same entry in memory."""
    entry = F.octet_length("key") + F.octet_length("value") + 33
    return log_of(spark, sf_dir).select(
        "store_id", "sequence", changelog.record_bytes().cast("long").alias("record_bytes"), entry.cast("long").alias("entry_bytes")
    )


@query(f"""WITH {LOG_CTE} SELECT store_id, CAST(sum(26 + octet_length(key) + octet_length(value)) AS BIGINT) AS log_bytes,
CAST(108 + sum(37 + octet_length(key) + octet_length(value)) AS BIGINT) AS table_bytes FROM log GROUP BY store_id""")
def wal_bytes(spark, sf_dir):
    """Bytes of each store's log and of one in-memory table that held it."""
    return log_of(spark, sf_dir).groupBy("store_id").agg(
        F.sum(changelog.record_bytes().cast("long")).alias("log_bytes"),
        (F.sum(changelog.node_bytes().cast("long")) + changelog.HEAD_BYTES).alias("table_bytes"),
    )


def _encoded(log: DataFrame) -> DataFrame:
    record = codec.encode_wal(F.col("op"), F.col("sequence"), F.col("key"), F.col("value"), F.col("tombstone"))
    return log.withColumn("record", record)


def _le(x: str, width: int) -> str:
    digits = f"printf('%0{2 * width}X', {x})"
    return "(" + " || ".join(f"substr({digits}, {i}, 2)" for i in range(2 * width - 1, 0, -2)) + ")"


# a table of the checksum's steps for each byte, then one step per byte
CRC_SQL = f"""WITH {LOG_CTE}, t AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]),
    lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS steps
), r AS (
  SELECT store_id, sequence, CASE WHEN tombstone THEN '01' ELSE '00' END || {_le('sequence', 8)} || CASE WHEN tombstone THEN '01' ELSE '00' END ||
    {_le('octet_length(key)', 4)} || {_le('octet_length(value)', 4)} || hex(key) || hex(value) AS body FROM log
), b AS (
  SELECT store_id, sequence, length(body) // 2 + 8 AS n,
    list_transform(range(length(body) // 2), lambda i: CAST('0x' || substr(body, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)) AS bytes FROM r
)
SELECT store_id, sequence, xor(list_reduce(list_concat([4294967295], bytes), lambda c, x: xor(c // 256, steps[xor(c, x) % 256 + 1])), 4294967295) AS crc32,
  CAST(n AS INTEGER) AS n FROM b, t"""


@query(CRC_SQL)
def wal_crc(spark, sf_dir):
    """The checksum in each encoded log record, and the record's bytes."""
    rows = _encoded(log_of(spark, sf_dir))
    return rows.select("store_id", "sequence", F.crc32(F.substring("record", 9, 1 << 30)).alias("crc32"), F.octet_length("record").alias("n"))


@query(f"""WITH {LOG_CTE} SELECT store_id, sequence, hex(key) AS key_hex, hex(value) AS value_hex, tombstone FROM log""")
def wal_round_trip(spark, sf_dir):
    """Every record encoded to bytes and decoded again."""
    record = F.col("record")
    n_key = codec.from_little_endian(F.substring(record, 19, 4)).cast("int")
    decoded = _encoded(log_of(spark, sf_dir)).select(
        "store_id",
        codec.from_little_endian(F.substring(record, 10, 8)).alias("sequence"),
        F.substring(record, F.lit(27), n_key).alias("key"),
        F.substring(record, n_key + 27, F.octet_length(record)).alias("value"),
        (F.hex(F.substring(record, 18, 1)) == "01").alias("tombstone"),
    )
    return shown(decoded, "store_id", "sequence", "key", "value", "tombstone")


BAD_BYTES = 96


@query(f"""WITH {LOG_CTE}, b AS (SELECT store_id, min(sequence) AS bad FROM log WHERE octet_length(value) >= {BAD_BYTES} GROUP BY store_id)
SELECT log.store_id, count(*) AS records, max(sequence) AS last_sequence FROM log LEFT JOIN b USING (store_id)
WHERE bad IS NULL OR sequence < bad GROUP BY log.store_id""")
def wal_valid_prefix(spark, sf_dir):
    """Lenient recovery where records with long values count as broken: what is before each store's first one."""
    kept = changelog.valid_prefix(log_of(spark, sf_dir), F.octet_length("value") >= BAD_BYTES)
    return kept.groupBy("store_id").agg(F.count("*").alias("records"), F.max("sequence").alias("last_sequence"))


@query(f"""WITH {LOG_CTE}, b AS (SELECT store_id, min(sequence) AS bad FROM log WHERE octet_length(value) >= {BAD_BYTES} GROUP BY store_id)
SELECT log.store_id, count(*) AS records, max(sequence) AS last_sequence, CAST(sum(octet_length(key) + octet_length(value)) AS BIGINT) AS bytes,
  CAST(sum(CASE WHEN tombstone THEN 1 ELSE 0 END) AS BIGINT) AS deletes FROM log LEFT JOIN b USING (store_id)
WHERE bad IS NULL OR sequence < bad GROUP BY log.store_id""")
def wal_damaged_read(spark, sf_dir):
    """Logs written as files in which a byte of each record with a long value is damaged, and what a recovery keeps of them."""
    def encode(batches):
        for batch in batches:
            records = []
            for op, sequence, key, value, dead in zip(*(batch.column(n).to_pylist() for n in ("op", "sequence", "key", "value", "tombstone"))):
                record = codec.encode_record(op, sequence, key, value, dead)
                records.append(record[:-1] + bytes([record[-1] ^ 1]) if len(value) >= BAD_BYTES else record)
            yield pa.RecordBatch.from_arrays([batch.column("store_id"), batch.column("sequence"), pa.array(records, pa.binary())], names=["store_id", "sequence", "record"])

    rows = log_of(spark, sf_dir).mapInArrow(encode, "store_id bigint, sequence bigint, record binary")
    path = shared_dir(spark, "segments")
    wal.write_segments(rows, path).count()
    return wal.recover_segments(spark, path).groupBy("store_id").agg(
        F.count("*").alias("records"), F.max("sequence").alias("last_sequence"),
        F.sum((F.octet_length("key") + F.octet_length("value")).cast("long")).alias("bytes"), F.count_if("tombstone").alias("deletes"),
    )


@query(f"""WITH {LOG_CTE} SELECT store_id, sequence, row_number() OVER (ORDER BY sequence, store_id, key) AS assigned FROM log""")
def sequence_assign(spark, sf_dir):
    """Writes numbered anew, densely over all stores, in the order of their old sequences."""
    order = F.struct("sequence", "store_id", "key").alias("at")
    numbered = changelog.assign_sequences(log_of(spark, sf_dir).select("store_id", F.col("sequence").alias("old"), order), "at")
    return numbered.select("store_id", F.col("old").alias("sequence"), F.col("sequence").alias("assigned"))


@query(f"""WITH RECURSIVE {LOG_CTE}, c AS (
  SELECT store_id, sequence, 37 + octet_length(key) + octet_length(value) AS b, memtable_capacity - 108 AS room,
    sum(37 + octet_length(key) + octet_length(value)) OVER (PARTITION BY store_id ORDER BY sequence) AS total
  FROM log JOIN engine_config USING (store_id)
), g AS (
  SELECT store_id, 0 AS generation, CAST(0 AS HUGEINT) AS base,
    (SELECT min(x.total) FROM c x WHERE x.store_id = e.store_id AND x.total > e.memtable_capacity - 108) AS upto FROM engine_config e
  UNION ALL
  SELECT g.store_id, g.generation + 1, g.upto,
    (SELECT min(x.total) FROM c x WHERE x.store_id = g.store_id AND x.total > g.upto + x.room) FROM g WHERE g.upto IS NOT NULL
)
SELECT c.store_id, CAST(g.generation AS BIGINT) AS generation, count(*) AS writes, min(sequence) AS first_sequence,
  max(sequence) AS last_sequence, CAST(sum(b) AS BIGINT) AS bytes
FROM c JOIN g ON g.store_id = c.store_id AND c.total > g.base AND (g.upto IS NULL OR c.total <= g.upto)
GROUP BY ALL""")
def memtable_generations(spark, sf_dir):
    """The in-memory tables that each store's log filled, one after the other."""
    capacities = table(spark, sf_dir, "engine_config").select("store_id", F.col("memtable_capacity").alias("capacity"))
    cut = runs.generations(log_of(spark, sf_dir), capacities, changelog.node_bytes().cast("long"), changelog.HEAD_BYTES)
    return cut.groupBy("store_id", "generation").agg(
        F.count("*").alias("writes"),
        F.min("sequence").alias("first_sequence"),
        F.max("sequence").alias("last_sequence"),
        F.sum("bytes").alias("bytes"),
    )


BLOCKS_CTE = f"""{RUNS_CTE}, c AS (
  SELECT store_id, run_id, key, sequence, 25 + octet_length(key) + octet_length(value) AS b,
    sum(25 + octet_length(key) + octet_length(value)) OVER (PARTITION BY store_id, run_id ORDER BY key, sequence DESC) AS total
  FROM runs
), s AS (SELECT DISTINCT store_id, run_id FROM c), g AS (
  SELECT store_id, run_id, 0 AS block_no, CAST(0 AS HUGEINT) AS base,
    (SELECT min(x.total) FROM c x WHERE x.store_id = s.store_id AND x.run_id = s.run_id AND x.total >= 4096) AS upto FROM s
  UNION ALL
  SELECT g.store_id, g.run_id, g.block_no + 1, g.upto,
    (SELECT min(x.total) FROM c x WHERE x.store_id = g.store_id AND x.run_id = g.run_id AND x.total >= g.upto + 4096)
  FROM g WHERE g.upto IS NOT NULL
), blocks AS (
  SELECT c.store_id, c.run_id, CAST(g.block_no AS BIGINT) AS block_no, count(*) AS entry_count,
    CAST(sum(b) + 20 AS BIGINT) AS block_size, min(key) AS smallest_key
  FROM c JOIN g ON g.store_id = c.store_id AND g.run_id = c.run_id AND c.total > g.base AND (g.upto IS NULL OR c.total <= g.upto)
  GROUP BY ALL
), placed AS (
  SELECT *, CAST(sum(block_size) OVER (PARTITION BY store_id, run_id ORDER BY block_no) - block_size AS BIGINT) AS block_offset FROM blocks
)"""


def _index(spark, sf_dir):
    return runs.block_index(runs.blocks(runs_of(spark, sf_dir)))


@query(f"WITH RECURSIVE {BLOCKS_CTE} SELECT store_id, run_id, block_no, entry_count, block_size FROM placed")
def sst_blocks(spark, sf_dir):
    """The data blocks into which each run's entries are cut."""
    return _index(spark, sf_dir).select("store_id", "run_id", "block_no", "entry_count", "block_size")


@query(f"WITH RECURSIVE {BLOCKS_CTE} SELECT store_id, run_id, block_no, hex(smallest_key) AS smallest_key_hex, block_offset, block_size FROM placed")
def sst_index(spark, sf_dir):
    """The block index of each run: smallest keys, offsets and sizes."""
    return shown(_index(spark, sf_dir), "store_id", "run_id", "block_no", "smallest_key", "block_offset", "block_size")


@query(f"""WITH RECURSIVE {BLOCKS_CTE} SELECT store_id, run_id, count(*) AS blocks, CAST(sum(entry_count) AS BIGINT) AS entry_count,
CAST(max(block_offset + block_size) AS BIGINT) AS index_offset,
CAST(4 + sum(CASE WHEN octet_length(smallest_key) < 128 THEN 1 WHEN octet_length(smallest_key) < 16384 THEN 2 ELSE 3 END
 + octet_length(smallest_key) + 16) AS BIGINT) AS index_size FROM placed GROUP BY ALL""")
def sst_footers(spark, sf_dir):
    """The footer of each run."""
    return runs.footers(_index(spark, sf_dir))


@query(f"""WITH {RUNS_CTE} SELECT store_id, run_id, count(*) AS entries, CAST(sum(octet_length(key)) AS BIGINT) AS key_bytes,
CAST(sum(octet_length(value)) AS BIGINT) AS value_bytes, CAST(sum(CASE WHEN tombstone THEN 1 ELSE 0 END) AS BIGINT) AS deletes,
CAST(sum(sequence) AS BIGINT) AS sequences, true AS in_order FROM runs GROUP BY ALL""")
def run_file_round_trip(spark, sf_dir):
    """Runs written as files of compressed blocks whose keys leave out what they share, and read again block by block."""
    rows = runs_of(spark, sf_dir).withColumn("timestamp_ms", F.lit(0).cast("long"))
    path = shared_dir(spark, "runs")
    files = runfile.write_runs(rows, path, codec="lz4", restart=runfile.RESTART)
    files.write.parquet(f"{path}-files")
    back = runfile.read_runs(spark, spark.read.parquet(f"{path}-files"))
    named = back.withColumns({n: F.regexp_extract("path", r"(\d+)-(\d+)-\d+\.run$", i).cast("long") for i, n in ((1, "store_id"), (2, "run_id"))})
    # blocks follow each other: the least key of one is not below the greatest of the one before it in its file
    spans = named.groupBy("store_id", "run_id", "path", "block_no").agg(
        F.min("key").alias("low"), F.max("key").alias("high"), F.count("*").alias("entries"),
        F.sum(F.octet_length("key").cast("long")).alias("key_bytes"), F.sum(F.octet_length("value").cast("long")).alias("value_bytes"),
        F.count_if("tombstone").alias("deletes"), F.sum("sequence").alias("sequences"),
    )
    before = F.lag("high").over(Window.partitionBy("path").orderBy("block_no"))
    spans = spans.withColumn("follows", before.isNull() | (before <= F.col("low")))
    sums = [F.sum(c).alias(c) for c in ("entries", "key_bytes", "value_bytes", "deletes", "sequences")]
    return spans.groupBy("store_id", "run_id").agg(*sums, F.bool_and("follows").alias("in_order"))


@query(f"""WITH {RUNS_CTE}, i AS (SELECT DISTINCT store_id, run_id, block_id, smallest_key FROM index_entry WHERE smallest_key IS NOT NULL)
SELECT r.store_id, r.run_id, CAST(i.block_id AS BIGINT) AS block_id, count(*) AS entries
FROM runs r ASOF LEFT JOIN (SELECT store_id, run_id, smallest_key, max(block_id) AS block_id FROM i GROUP BY ALL) i
  ON r.store_id = i.store_id AND r.run_id = i.run_id AND r.key >= i.smallest_key
GROUP BY ALL""")
def sst_index_lookup(spark, sf_dir):
    """Entries by the block that the recorded index gives for their key."""
    index = table(spark, sf_dir, "index_entry").select("store_id", "run_id", "block_id", "smallest_key").dropna().distinct()
    found = runs.locate_blocks(runs_of(spark, sf_dir).select("store_id", "run_id", "key", "sequence"), index)
    return found.groupBy("store_id", "run_id", "block_id").agg(F.count("*").alias("entries"))


@query(f"""WITH {LOG_CTE}, {RUNS_CTE}, u AS (
  SELECT store_id, key, sequence, tombstone, value, 0 AS layer FROM log UNION ALL
  SELECT store_id, key, sequence, tombstone, value, 1 + CASE WHEN level = 0 THEN 0 ELSE 1 END FROM runs
), f AS (SELECT *, row_number() OVER (PARTITION BY store_id, key ORDER BY layer, sequence DESC) AS n FROM u)
SELECT store_id, hex(key) AS key_hex, layer, sequence, tombstone FROM f WHERE n = 1""")
def layered_get(spark, sf_dir):
    """Every key looked up in log, level 0 and deeper levels: the first layer that holds it decides."""
    entries = delivered_of(spark, sf_dir)
    layers = [changes_of(spark, sf_dir), entries.where(F.col("level") == 0), entries.where(F.coalesce(F.col("level"), F.lit(1)) != 0)]
    return shown(reads.layered_get(layers), "store_id", "key", "layer", "sequence", "tombstone")


@query(f"""WITH {LOG_CTE} SELECT store_id, sequence, CAST(1 + floor(log2(greatest(octet_length(value), 1)) / 7) AS BIGINT) AS length_bytes,
CAST(1 + floor(log2(greatest(sequence, 1)) / 7) AS BIGINT) AS sequence_bytes FROM log""")
def varint_sizes(spark, sf_dir):
    """Bytes of value lengths and sequences as varints."""
    size = codec.varint_size
    return log_of(spark, sf_dir).select(
        "store_id", "sequence",
        size(F.octet_length("value")).cast("long").alias("length_bytes"),
        size(F.col("sequence")).cast("long").alias("sequence_bytes"),
    )


def _hex_le(x: str) -> str:
    digits = f"printf('%016X', {x})"
    return " || ".join(f"substr({digits}, {i}, 2)" for i in range(15, 0, -2))


@query(f"""SELECT DISTINCT store_id, sequence, hex(user_key) || {_hex_le('sequence')} || {_hex_le('sequence')} ||
CASE WHEN coalesce(tombstone, false) THEN '01' ELSE '00' END AS internal_key_hex
FROM internal_key WHERE store_id IS NOT NULL AND user_key IS NOT NULL AND sequence IS NOT NULL""")
def internal_key_codec(spark, sf_dir):
    """Internal keys as bytes, built, taken apart and built again; the sequence stands in for the advisory time."""
    rows = table(spark, sf_dir, "internal_key").dropna(subset=["store_id", "user_key", "sequence"])
    dead = F.coalesce(F.col("tombstone"), F.lit(False))
    encoded = codec.encode_internal_key(F.col("user_key"), F.col("sequence"), F.col("sequence"), dead)
    parts = rows.select("store_id", codec.decode_internal_key(encoded).alias("k"))
    again = codec.encode_internal_key(F.col("k.user_key"), F.col("k.sequence"), F.col("k.timestamp_ms"), F.col("k.tombstone"))
    return parts.select("store_id", "k.sequence", F.hex(again).alias("internal_key_hex")).distinct()


SCAN_SQL = f"WITH {LATEST_CTE} SELECT store_id, hex(key) AS key_hex, hex(value) AS value_hex FROM latest WHERE NOT tombstone AND %s"


@query(SCAN_SQL % "key >= 'blob/'::BLOB AND key < 'user/'::BLOB")
def scan_range(spark, sf_dir):
    """Live keys from 'blob/' to before 'user/'."""
    return shown(reads.scan(changes_of(spark, sf_dir), b"blob/", b"user/"), "store_id", "key", "value")


@query(SCAN_SQL % "key >= 'idx/'::BLOB AND key < 'idx0'::BLOB")
def scan_prefix(spark, sf_dir):
    """Live keys that begin with 'idx/'."""
    return shown(reads.scan(changes_of(spark, sf_dir), b"idx/", reads.prefix_end(b"idx/")), "store_id", "key", "value")


@query(f"""WITH {LATEST_CTE}, t AS (SELECT store_id, key FROM latest WHERE NOT tombstone ORDER BY key, store_id LIMIT {TOP})
SELECT row_number() OVER (ORDER BY key, store_id) AS n, store_id, hex(key) AS key_hex FROM t""")
def scan_limit(spark, sf_dir):
    """The first 100 live keys, numbered."""
    first = reads.scan(changes_of(spark, sf_dir), limit=TOP)
    return shown(first.withColumn("n", F.row_number().over(Window.orderBy("key", "store_id"))), "n", "store_id", "key")


@query(f"""WITH {LATEST_CTE} SELECT store_id, hex(key) AS key_hex FROM (
SELECT store_id, key FROM latest WHERE NOT tombstone ORDER BY key, store_id LIMIT {TOP} OFFSET {TOP})""")
def scan_page(spark, sf_dir):
    """The second hundred of live keys."""
    return shown(reads.scan(changes_of(spark, sf_dir), limit=TOP, offset=TOP), "store_id", "key")


@query(f"WITH {LOG_CTE} SELECT store_id, hex(key) AS key_hex, sequence, tombstone FROM log WHERE key >= 'idx/'::BLOB AND key < 'idx0'::BLOB")
def version_scan(spark, sf_dir):
    """All versions of the keys that begin with 'idx/', keys up and sequences down."""
    some = watch(log_of(spark, sf_dir), b"idx/", reads.prefix_end(b"idx/"))
    return shown(reads.versions(some), "store_id", "key", "sequence", "tombstone")


@query(f"""WITH {LATEST_CTE}, t AS (SELECT store_id, key FROM latest WHERE NOT tombstone ORDER BY key DESC, store_id LIMIT {TOP})
SELECT row_number() OVER (ORDER BY key DESC, store_id) AS n, store_id, hex(key) AS key_hex FROM t""")
def scan_reverse(spark, sf_dir):
    """The last 100 live keys, from the end."""
    last = reads.scan(changes_of(spark, sf_dir), reverse=True, limit=TOP)
    return shown(last.withColumn("n", F.row_number().over(Window.orderBy(F.col("key").desc(), "store_id"))), "n", "store_id", "key")


@query(f"""WITH {LATEST_CTE} SELECT store_id, hex(min(key)) AS key_hex FROM latest
WHERE NOT tombstone AND key >= 'idx/'::BLOB GROUP BY store_id""")
def seek_key(spark, sf_dir):
    """Each store's first live key at or after 'idx/'."""
    return shown(reads.seek(changes_of(spark, sf_dir), b"idx/"), "store_id", "key")


SNAPSHOT_SQL = f"""WITH {LOG_CTE} SELECT store_id, hex(key) AS key_hex, max(sequence) AS sequence FROM log
WHERE sequence <= %s GROUP BY store_id, key HAVING NOT arg_max(tombstone, sequence)"""


@query(SNAPSHOT_SQL % SNAPSHOT)
def snapshot_scan(spark, sf_dir):
    """What a read as of a sequence sees."""
    return shown(reads.snapshot(changes_of(spark, sf_dir), SNAPSHOT), "store_id", "key", "sequence")


@query(f"""WITH {LOG_CTE}, s AS (SELECT DISTINCT store_id FROM log), v AS (
SELECT store_id, arg_max(value, sequence) AS value, arg_max(tombstone, sequence) AS dead FROM log
WHERE key = '{SHARED_KEY.decode()}'::BLOB AND sequence <= {SNAPSHOT} GROUP BY store_id)
SELECT s.store_id, CASE WHEN v.dead = false THEN 'ok' ELSE 'not_found' END AS status, CASE WHEN v.dead = false THEN hex(v.value) END AS value_hex
FROM s LEFT JOIN v USING (store_id)""")
def snapshot_get(spark, sf_dir):
    """A key as of a sequence."""
    found = reads.snapshot(changes_of(spark, sf_dir).where(F.col("key") == F.lit(SHARED_KEY)), SNAPSHOT).select("store_id", "value")
    return shown(stores_of(spark, sf_dir).join(found, "store_id", "left").withColumn("status", reads.status()), "store_id", "status", "value")


@query(f"""WITH {LOG_CTE}, m AS (SELECT store_id, max(sequence) - {LAG} AS bound FROM log GROUP BY store_id)
SELECT store_id, hex(key) AS key_hex, max(sequence) AS sequence FROM log JOIN m USING (store_id)
WHERE sequence <= bound GROUP BY store_id, key HAVING NOT arg_max(tombstone, sequence)""")
def stale_read(spark, sf_dir):
    """What a follower some sequences behind would serve."""
    return shown(reads.stale_read(changes_of(spark, sf_dir), LAG), "store_id", "key", "sequence")


MERGE_SQL = f"""WITH {RUNS_CTE} SELECT store_id, hex(key) AS key_hex, max(sequence) AS sequence,
arg_max(tombstone, sequence) AS tombstone, hex(arg_max(value, sequence)) AS value_hex FROM runs %s GROUP BY store_id, key %s"""
MERGED = ("store_id", "key", "sequence", "tombstone", "value")


@query(MERGE_SQL % ("", ""))
def merge_runs(spark, sf_dir):
    """All runs as one merged iteration: the newest entry per key."""
    return shown(compaction.compact(delivered_of(spark, sf_dir), bottom=False), *MERGED)


@query(MERGE_SQL % ("WHERE level = 0", ""))
def compact_partial(spark, sf_dir):
    """Level 0 merged; tombstones stay, as level 1 may hold older versions."""
    return shown(compaction.compact(delivered_of(spark, sf_dir).where("level = 0"), bottom=False), *MERGED)


@query(MERGE_SQL % ("", "HAVING NOT arg_max(tombstone, sequence)"))
def compact_full(spark, sf_dir):
    """All runs merged down to the deepest level; tombstones go."""
    return shown(compaction.compact(delivered_of(spark, sf_dir), bottom=True), *MERGED)


@query(f"""WITH {RUNS_CTE}, d AS (SELECT DISTINCT store_id, key, sequence, tombstone FROM runs),
k AS (SELECT *, sequence > {SNAPSHOT} OR sequence = max(CASE WHEN sequence <= {SNAPSHOT} THEN sequence END) OVER (PARTITION BY store_id, key) AS kept FROM d),
f AS (SELECT *, min(sequence) OVER (PARTITION BY store_id, key) AS first FROM k WHERE kept)
SELECT store_id, hex(key) AS key_hex, sequence, tombstone FROM f WHERE NOT tombstone OR sequence <> first""")
def compact_with_snapshot(spark, sf_dir):
    """All runs merged with what a live snapshot still sees."""
    kept = compaction.compact_with_snapshots(delivered_of(spark, sf_dir), [SNAPSHOT], bottom=True)
    return shown(kept, "store_id", "key", "sequence", "tombstone")


@query(f"""WITH {LOG_CTE}, {RUNS_CTE}, l AS (SELECT store_id, sum(octet_length(key) + octet_length(value)) AS logged FROM log GROUP BY 1),
r AS (SELECT store_id, sum(octet_length(key) + octet_length(value)) AS stored FROM runs GROUP BY 1),
k AS (SELECT store_id, key, count(DISTINCT run_id) AS n, arg_max(tombstone, sequence) AS dead,
  arg_max(octet_length(key) + octet_length(value), sequence) AS size FROM runs GROUP BY 1, 2),
g AS (SELECT store_id, sum(n) AS kr, count(*) AS ks, sum(CASE WHEN dead THEN 0 ELSE size END) AS alive FROM k GROUP BY 1)
SELECT store_id, CAST(logged AS BIGINT) AS logged_bytes, CAST(stored AS BIGINT) AS run_bytes, CAST(alive AS BIGINT) AS live_bytes,
  round(stored::DOUBLE / logged, 6) AS write_amplification, round(kr::DOUBLE / ks, 6) AS read_amplification,
  round(stored::DOUBLE / nullif(alive, 0), 6) AS space_amplification
FROM l FULL JOIN r USING (store_id) FULL JOIN g USING (store_id)""")
def level_amplification(spark, sf_dir):
    """Write, read and space amplification per store."""
    return compaction.amplification(log_of(spark, sf_dir), runs_of(spark, sf_dir))


LIVE_CTE = """lr AS (SELECT store_id, run_id, arg_max(action, edit_seq) AS action, arg_max(level, edit_seq) AS level,
  arg_max(smallest_key, edit_seq) AS smallest_key, arg_max(largest_key, edit_seq) AS largest_key,
  arg_max(entry_count, edit_seq) AS entry_count, arg_max(bytes, edit_seq) AS bytes, arg_max(edited_at, edit_seq) AS edited_at
  FROM manifest GROUP BY 1, 2 HAVING arg_max(action, edit_seq) = 'add')"""


@query(f"WITH {LIVE_CTE} SELECT store_id, run_id, level, entry_count, bytes FROM lr")
def manifest_live_runs(spark, sf_dir):
    """The runs that the manifest's edits leave."""
    return compaction.live_runs(table(spark, sf_dir, "manifest")).select("store_id", "run_id", "level", "entry_count", "bytes")


@query(f"""WITH {LIVE_CTE}, z AS (SELECT store_id, count(*) AS n, min(smallest_key) AS low, max(largest_key) AS high FROM lr WHERE level = 0 GROUP BY 1)
SELECT lr.store_id, run_id, level FROM lr JOIN z USING (store_id)
WHERE n >= 4 AND (level = 0 OR (level = 1 AND smallest_key <= high AND largest_key >= low))""")
def pick_leveled(spark, sf_dir):
    """The runs that a leveled compaction takes next."""
    return compaction.pick_leveled(compaction.live_runs(table(spark, sf_dir, "manifest")))


@query(f"""WITH {LIVE_CTE}, t AS (SELECT store_id, run_id, CAST(floor(ln(greatest(bytes, 1)) / ln(4) + 1e-9) AS BIGINT) AS tier_no FROM lr)
SELECT store_id, run_id, tier_no FROM t SEMI JOIN (SELECT store_id, tier_no FROM t GROUP BY 1, 2 HAVING count(*) >= 4) f USING (store_id, tier_no)""")
def pick_tiered(spark, sf_dir):
    """The runs that a tiered compaction takes next."""
    return compaction.pick_tiered(compaction.live_runs(table(spark, sf_dir, "manifest")))


@query(f"WITH {LIVE_CTE} SELECT store_id, run_id, level FROM lr WHERE edited_at < TIMESTAMP '{NOW}' - INTERVAL 30 DAYS")
def pick_expired(spark, sf_dir):
    """The runs old enough to be dropped whole."""
    before = F.expr(f"TIMESTAMP_NTZ '{NOW}' - INTERVAL {TTL}")
    return compaction.pick_expired(compaction.live_runs(table(spark, sf_dir, "manifest")), before)


@query(f"""WITH {LIVE_CTE} SELECT store_id, CAST(sum(bytes) AS BIGINT) AS bytes,
CAST(greatest(ceil(ln(greatest(sum(bytes)::DOUBLE / memtable_capacity, 1.0)) / ln(10) - 1e-9), 1) AS BIGINT) AS levels
FROM lr JOIN engine_config USING (store_id) GROUP BY store_id, memtable_capacity""")
def level_sizing(spark, sf_dir):
    """Levels that each store needs at a size ratio of ten."""
    capacity = table(spark, sf_dir, "engine_config").select("store_id", F.col("memtable_capacity").alias("capacity"))
    return compaction.level_count(compaction.live_runs(table(spark, sf_dir, "manifest")), capacity)


@query(f"""WITH a AS (SELECT store_id, user_key AS key, sequence, coalesce(tombstone, false) AS dead, min(arrived_at) AS arrived_at
  FROM internal_key WHERE user_key IS NOT NULL GROUP BY ALL),
f AS (SELECT store_id, key, max(sequence) AS sequence, arg_max(dead, sequence) AS dead, arg_max(arrived_at, sequence) AS written FROM a GROUP BY 1, 2)
SELECT store_id, hex(key) AS key_hex, sequence FROM f WHERE NOT dead AND written + INTERVAL {TTL} > TIMESTAMP '{NOW}'""")
def ttl_expire(spark, sf_dir):
    """Live entries that arrived within the last 30 days of a given moment."""
    rows = table(spark, sf_dir, "internal_key").dropna(subset=["store_id", "user_key", "sequence"])
    dead = F.coalesce(F.col("tombstone"), F.lit(False)).alias("tombstone")
    first = rows.groupBy("store_id", F.col("user_key").alias("key"), "sequence", dead).agg(F.min("arrived_at").alias("arrived_at"))
    young = compaction.expire(first.withColumn("value", F.lit(None).cast("binary")), "arrived_at", F.expr(f"TIMESTAMP_NTZ '{NOW}'"), TTL)
    return shown(young, "store_id", "key", "sequence")


@query(f"""WITH {LOG_CTE} SELECT store_id, sequence, hex(key) AS key_hex, tombstone FROM log
WHERE key >= 'idx/'::BLOB AND key < 'idx0'::BLOB""")
def cdc_key_range(spark, sf_dir):
    """The change feed of a range of keys."""
    return shown(watch(log_of(spark, sf_dir), b"idx/", b"idx0").orderBy("store_id", "sequence"), "store_id", "sequence", "key", "tombstone")


@query(f"""WITH RECURSIVE {BLOCKS_CTE}, o AS (
  SELECT c.store_id, c.run_id, g.block_no, c.key, row_number() OVER w - 1 AS nth, lag(c.key) OVER w AS before
  FROM c JOIN g ON g.store_id = c.store_id AND g.run_id = c.run_id AND c.total > g.base AND (g.upto IS NULL OR c.total <= g.upto)
  WINDOW w AS (PARTITION BY c.store_id, c.run_id, g.block_no ORDER BY c.key, c.sequence DESC)
), h AS (SELECT *, CASE WHEN nth % 16 = 0 OR before IS NULL THEN '' ELSE hex(before) END AS b, hex(key) AS a FROM o),
p AS (SELECT *, least(length(a), length(b)) // 2 AS n FROM h),
shares AS (SELECT *, CASE WHEN n = 0 THEN 0 ELSE coalesce(list_position(list_transform(range(n), lambda i: substr(a, 2 * i + 1, 2) = substr(b, 2 * i + 1, 2)), false) - 1, n) END AS shared FROM p)
SELECT store_id, run_id, count(*) AS entries, CAST(sum(octet_length(key)) AS BIGINT) AS key_bytes, CAST(sum(shared) AS BIGINT) AS shared_bytes
FROM shares GROUP BY ALL""")
def prefix_encoding_stats(spark, sf_dir):
    """Key bytes that front coding saves, per run."""
    shared = runs.prefix_lengths(runs.blocks(runs_of(spark, sf_dir)))
    return shared.groupBy("store_id", "run_id").agg(
        F.count("*").alias("entries"),
        F.sum(F.octet_length("key").cast("long")).alias("key_bytes"),
        F.sum("shared").alias("shared_bytes"),
    )


VALUE_CTE = f"""{RUNS_CTE}, v AS (SELECT *, CASE WHEN octet_length(value) > {VALUE_THRESHOLD} THEN octet_length(value) ELSE 0 END AS n FROM runs),
placed AS (SELECT *, sum(n) OVER (PARTITION BY store_id, run_id ORDER BY key, sequence DESC) - n AS pos FROM v)"""


@query(f"""WITH {VALUE_CTE} SELECT store_id, run_id, hex(key) AS key_hex, sequence, CASE WHEN n > 0 THEN run_id END AS value_file,
CASE WHEN n > 0 THEN CAST(pos AS BIGINT) END AS value_offset, CASE WHEN n > 0 THEN CAST(n AS BIGINT) END AS value_size FROM placed""")
def value_separation(spark, sf_dir):
    """Entries with pointers to the value logs that hold their long values."""
    pointers, _ = runs.separate_values(runs_of(spark, sf_dir), VALUE_THRESHOLD)
    return shown(pointers, "store_id", "run_id", "key", "sequence", "value_file", "value_offset", "value_size")


@query(f"""WITH {VALUE_CTE}, t AS (SELECT *, row_number() OVER (PARTITION BY store_id, key ORDER BY sequence DESC, tombstone DESC, CASE WHEN n > 0 THEN run_id END DESC NULLS LAST, pos DESC) AS k FROM placed)
SELECT store_id, run_id AS value_file, CAST(sum(n) AS BIGINT) AS log_bytes, CAST(sum(CASE WHEN k = 1 AND NOT tombstone THEN 0 ELSE n END) AS BIGINT) AS dead_bytes
FROM t WHERE n > 0 GROUP BY ALL""")
def value_log_gc(spark, sf_dir):
    """Bytes of each value log that no newest entry points to."""
    return compaction.reclaimable(*runs.separate_values(runs_of(spark, sf_dir), VALUE_THRESHOLD))


@query("SELECT o_custkey, count(*) AS n, min(o_orderkey) AS first_order, max(o_orderkey) AS last_order FROM orders GROUP BY 1")
def secondary_index(spark, sf_dir):
    """Orders by customer through a secondary index."""
    index = indexes.secondary_index(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey")
    return index.groupBy("o_custkey").agg(
        F.count("*").alias("n"), F.min("o_orderkey").alias("first_order"), F.max("o_orderkey").alias("last_order")
    )


@query("""SELECT c_custkey, o_orderkey, o_totalprice FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_nationkey = 7""")
def secondary_lookup(spark, sf_dir):
    """Orders of one nation's customers: index, then primary key."""
    orders = table(spark, sf_dir, "orders")
    index = indexes.secondary_index(orders, "o_custkey", "o_orderkey")
    some = table(spark, sf_dir, "customer").where("c_nationkey = 7").select("c_custkey")
    keys = some.join(index, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "o_orderkey")
    return keys.join(orders.select("o_orderkey", "o_totalprice"), "o_orderkey").select("c_custkey", "o_orderkey", "o_totalprice")


@query("""WITH t AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS term FROM documents)
SELECT term, count(DISTINCT doc_id) AS documents, count(*) AS occurrences FROM t WHERE term <> '' GROUP BY term""")
def inverted_index(spark, sf_dir):
    """Documents and occurrences per term, from an inverted index."""
    index = indexes.postings(table(spark, sf_dir, "documents"), "doc_id", "text")
    return index.groupBy("term").agg(F.count("*").alias("documents"), F.sum("n").alias("occurrences"))


PHRASE = ["on", "the", "way"]


@query(f"""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> '') AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, list_filter(range(len(w)), lambda i: w[i + 1] = '{PHRASE[0]}' AND w[i + 2] = '{PHRASE[1]}' AND w[i + 3] = '{PHRASE[2]}') AS starts FROM t)
SELECT doc_id, len(starts) AS occurrences, starts[1] AS first_start FROM s WHERE len(starts) > 0""")
def phrase_search(spark, sf_dir):
    """Documents that have three words one after the other, from lists of positions."""
    found = indexes.phrase(indexes.postings(table(spark, sf_dir, "documents"), "doc_id", "text", positions=True), "doc_id", PHRASE)
    return found.select("doc_id", F.size("starts").cast("long").alias("occurrences"), F.array_min("starts").cast("long").alias("first_start"))


@query("""WITH q AS (SELECT vec_id AS query, embedding AS a FROM embeddings WHERE vec_id % 50 = 0),
d AS (SELECT query, vec_id AS neighbour, list_distance(a::DOUBLE[], embedding::DOUBLE[]) AS distance FROM q, embeddings WHERE vec_id <> query),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, neighbour) AS rank FROM d)
SELECT query, CAST(rank AS INTEGER) AS rank, neighbour FROM r WHERE rank <= 10""")
def knn_exact(spark, sf_dir):
    """The ten nearest vectors of every vector whose id is divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings")
    found = indexes.nearest(vectors, vectors.where("vec_id % 50 = 0"), "vec_id", "embedding", 10)
    return found.select("query", "rank", "neighbour")


#: The vectors of the test tables have no clusters, so most lists must be probed; real embeddings need few.
LISTS, PROBES = 16, 13


@query("""SELECT count(*) AS queries, true AS recall_reached, (SELECT count(*) FROM embeddings WHERE embedding IS NOT NULL) AS rows_indexed
FROM embeddings WHERE vec_id % 50 = 0 AND embedding IS NOT NULL""")
def knn_inverted_lists(spark, sf_dir):
    """Approximate search through inverted lists: whether at least nine tenths of the exact neighbours are found."""
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id % 50 = 0")
    centroids = indexes.train_centroids(vectors, "vec_id", "embedding", LISTS)
    path = shared_dir(spark, "lists")
    indexes.inverted_lists(vectors, "vec_id", "embedding", centroids).write.partitionBy("list_no").parquet(path)
    index = spark.read.parquet(path)
    found = indexes.nearest_in_lists(index, asked, "vec_id", "embedding", centroids, 10, PROBES)
    exact = indexes.nearest(vectors, asked, "vec_id", "embedding", 10)
    hit = exact.join(found.select("query", "neighbour", F.lit(True).alias("hit")), ["query", "neighbour"], "left")
    return hit.agg(
        F.count_distinct("query").alias("queries"), (F.count("hit") >= 0.9 * F.count("*")).alias("recall_reached"),
    ).withColumn("rows_indexed", F.lit(index.count()))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_partkey BETWEEN 20 AND 400 AND l_suppkey BETWEEN 2 AND 40""")
def zorder_scan(spark, sf_dir):
    """A box of two attributes, read from a file laid out by interleaved keys, whose row groups outside are skipped."""
    path = shared_dir(spark, "by-z")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    indexes.write_z_ordered(lines, "l_partkey", "l_suppkey", path)
    found = indexes.box(spark.read.parquet(path), "l_partkey", "l_suppkey", (20, 2), (400, 40))
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


DIGEST = "CAST('0x' || substr(md5(key), 1, 8) AS BIGINT)"
NODES = ["n0", "n1", "n2", "n3"]


@query(f"""WITH {LATEST_CTE} SELECT CAST({DIGEST} % 16 AS INTEGER) AS shard, count(*) AS keys FROM latest WHERE NOT tombstone GROUP BY 1""")
def shard_counts(spark, sf_dir):
    """Live keys by hash shard."""
    keys = reads.live(changes_of(spark, sf_dir))
    return keys.groupBy(indexes.shard_of(F.col("key"), 16, portable=True).alias("shard")).agg(F.count("*").alias("keys"))


@query(f"""WITH {LATEST_CTE}, p AS (SELECT CAST('0x' || substr(md5(n || '|' || i), 1, 8) AS BIGINT) AS place, n AS node
  FROM (SELECT unnest({NODES}) AS n), (SELECT unnest(range(64)) AS i)),
k AS (SELECT {DIGEST} AS h FROM latest WHERE NOT tombstone)
SELECT coalesce(p.node, (SELECT arg_min(node, place) FROM p)) AS node, count(*) AS keys FROM k ASOF LEFT JOIN p ON k.h <= p.place GROUP BY 1""")
def ring_counts(spark, sf_dir):
    """Live keys by node of a hash ring."""
    node = indexes.ring_node(F.col("key"), indexes.hash_ring(NODES)).alias("node")
    return reads.live(changes_of(spark, sf_dir)).groupBy(node).agg(F.count("*").alias("keys"))


@query(f"""WITH {LATEST_CTE} SELECT CASE WHEN key < 'blob/'::BLOB THEN 0 WHEN key < 'idx/'::BLOB THEN 1 WHEN key < 'user/'::BLOB THEN 2 ELSE 3 END AS part,
count(*) AS keys FROM latest WHERE NOT tombstone GROUP BY 1""")
def range_counts(spark, sf_dir):
    """Live keys by range partition, for given bounds."""
    part = indexes.range_of(F.col("key"), [b"blob/", b"idx/", b"user/"]).alias("part")
    return reads.live(changes_of(spark, sf_dir)).groupBy(part).agg(F.count("*").alias("keys"))


@query(f"""WITH {LATEST_CTE} SELECT count(*) AS keys, true AS spread, true AS little_moves FROM latest WHERE NOT tombstone""")
def rendezvous_moves(spark, sf_dir):
    """Live keys by rendezvous node: whether nodes have about equal shares, and whether a fifth node takes keys for itself only."""
    keys = reads.live(changes_of(spark, sf_dir)).select(
        indexes.rendezvous(F.col("key"), NODES).alias("a"), indexes.rendezvous(F.col("key"), [*NODES, "n4"]).alias("b"), F.lit(1).alias("one")
    )
    counts = [F.count_if(F.col("a") == n).alias(n) for n in NODES]
    seen = keys.agg(F.count("*").alias("keys"), *counts, F.count_if((F.col("a") != F.col("b")) & (F.col("b") != "n4")).alias("astray"))
    fair = F.col("keys") / len(NODES)
    spread = [F.abs(F.col(n) - fair) <= 6 * F.sqrt(fair) + 1 for n in NODES]
    return seen.select("keys", (spread[0] & spread[1] & spread[2] & spread[3]).alias("spread"), (F.col("astray") == 0).alias("little_moves"))


def _ycsb_sql(name: str) -> str:
    shares, bound, cases = [(o, x) for o, x in zip(indexes.YCSB_OPERATIONS, indexes.YCSB[name]) if x], 0.0, ""
    for operation, share in shares[:-1]:
        bound += share
        cases += f" WHEN f < {bound} THEN '{operation}'"
    chosen = f"CASE{cases} ELSE '{shares[-1][0]}' END" if cases else f"'{shares[-1][0]}'"
    return f"""SELECT sequence AS op_no, hex(key) AS key_hex, {chosen} AS operation, store_id FROM (
SELECT DISTINCT store_id, sequence, key, ('0x' || substr(md5('42{name}|' || sequence::VARCHAR), 1, 8))::BIGINT / 4294967296.0 AS f FROM wal_entry
WHERE store_id IS NOT NULL AND sequence IS NOT NULL AND key IS NOT NULL)"""


def _ycsb(name: str):
    def run(spark, sf_dir):
        rows = table(spark, sf_dir, "wal_entry").dropna(subset=["store_id", "sequence", "key"]).select("store_id", "sequence", "key").distinct()
        ops = indexes.workload(rows.withColumn("at", F.struct("store_id", "key")), "at", "sequence", name)
        return ops.select("op_no", F.hex("key.key").alias("key_hex"), "operation", "key.store_id")

    run.__name__, run.__doc__ = f"ycsb_workload_{name.lower()}", f"Reproducible operations of YCSB workload {name} over the log's keys."
    return run


for _name in indexes.YCSB:
    query(_ycsb_sql(_name))(_ycsb(_name))


@query("""SELECT source_name, count(*) AS runs, round(quantile_cont(s, 0.5), 6) AS p50, round(quantile_cont(s, 0.99), 6) AS p99,
round(quantile_cont(s, 0.999), 6) AS p999, round(max(s), 6) AS longest FROM (
SELECT DISTINCT sync_no, source_name, epoch_us(finished_at - started_at) / 1e6 AS s FROM sync_run WHERE finished_at IS NOT NULL AND started_at IS NOT NULL)
GROUP BY source_name""")
def latency_percentiles(spark, sf_dir):
    """Exact percentiles of the seconds that runs took."""
    took = (F.unix_micros(F.col("finished_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))) / 1e6
    rows = table(spark, sf_dir, "sync_run").dropna(subset=["started_at", "finished_at"]).select("sync_no", "source_name", took.alias("s")).distinct()
    ranks = [F.round(F.percentile("s", p), 6).alias(n) for n, p in (("p50", 0.5), ("p99", 0.99), ("p999", 0.999))]
    return rows.groupBy("source_name").agg(F.count("*").alias("runs"), *ranks, F.round(F.max("s"), 6).alias("longest"))
