"""Processing only new or changed records, each exactly once."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.functions.bounded import broadcast_if_small
from keystrata.sources.shared import SharedFiles

#: Records are marked as carried in words of this many sequences, one bit each.
WORD = 64
#: After so many runs the words of all of them are merged to one table.
MERGE_RUNS = 8


def latest_runs(runs: DataFrame, keys: list[str], started: str, status: str, committed: str, ok: str = "ok") -> DataFrame:
    """The latest successful run of each key: ``since`` (its start) and ``watermark`` (its committed sequence).

    Failed, unfinished and repeated runs count for nothing, whatever they say they committed.
    """
    good = runs.where((F.col(status) == ok) & F.col(started).isNotNull())
    return good.groupBy(*keys).agg(
        F.max(F.struct(F.col(started).alias("since"), F.col(committed).alias("watermark"))).alias("run")
    ).select(*keys, "run.since", "run.watermark")


def carried_by(records: DataFrame, runs: DataFrame, keys: list[str], arrived: str) -> DataFrame:
    """The copies that had arrived when the latest successful run of their key began (``runs``: see ``latest_runs``).

    This is what a log of earlier runs says to be carried.  A record is carried if one of its copies is here.
    A copy without an arrival time never is, nor is any copy of a key without a run.
    """
    since = broadcast_if_small(runs.select(*keys, "since"))
    return records.join(since, keys, "inner").where(F.col(arrived) <= F.col("since")).drop("since")


def _bit(sequence: str) -> list[Column]:
    at = F.col(sequence).cast("long")
    return [
        F.shiftright(at, 6).alias("word_no"),
        F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(WORD - 1)).cast("int")).alias("word"),
    ]


def sequence_words(records: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """Which sequences occur: per key and ``word_no`` (64 sequences) a word with a bit for each.

    Copies meet in their bit, and bits are combined before the one shuffle, so a key that holds a third of all rows
    sends one row per word and task, spread by word.  Rows without a key or sequence name no record.
    """
    rows = records.dropna(subset=[*keys, sequence]).select(*keys, *_bit(sequence))
    return rows.groupBy(*keys, "word_no").agg(F.bit_or("word").alias("word"))


def word_sequences(words: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """The sequences whose bits are set, one row each; the inverse of ``sequence_words``."""
    places = F.filter(
        F.sequence(F.lit(0), F.lit(WORD - 1)), lambda i: F.call_function("shiftright", F.col("word"), i).bitwiseAND(F.lit(1)) == 1
    )
    return words.select(*keys, "word_no", F.explode(places).alias("at")).select(
        *keys, (F.col("word_no") * WORD + F.col("at")).alias(sequence)
    )


class IncrementalLoad:
    """Runs that each carry onward what is new since the last committed one, every record once.

    What was carried is known by sequence alone: a key's high watermark, and below it a bit for each sequence, since
    records come late.  No clock takes part, so a record that lands after a run with an earlier time, an equal time,
    or none, is carried by the next run like any other.  A 64-bit word stands for 64 sequences, so this costs a
    fraction of a percent of the records.

    A run goes through four steps, and a crash after any of the first three leaves nothing but a folder that nobody
    reads:

    1. ``pending``: the sequences seen in the source and not carried are written.  This fixes the run's upper limit:
       what comes to the source later is not among them and is left to the next run.
    2. ``output``: their rows, through the transformation, are written, and counted against step 1.
    3. ``state``: after every ``MERGE_RUNS`` runs the words of all runs are merged to one table.
    4. ``commit``: output and watermark become visible together by creating the next numbered manifest, which names
       both folders.  Of two runs at once only one can create it; the other fails and carries nothing.

    The watermark committed is that of step 1's table, not of a second look at the source.
    """

    def __init__(self, spark: SparkSession, root: str, keys: list[str], sequence: str):
        self.spark, self.keys, self.sequence = spark, keys, sequence
        self.files = SharedFiles(spark, root)

    def manifests(self) -> list[dict]:
        names = [n for n in self.files.list("commits") if not n.startswith(".")]
        return [json.loads(self.files.read(f"commits/{n}")) for n in names]

    def _last(self) -> dict:
        names = [n for n in self.files.list("commits") if not n.startswith(".")]
        return json.loads(self.files.read(f"commits/{names[-1]}")) if names else {"run": 0, "words": [], "outputs": []}

    def _read(self, folders: list[str]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.files.root}/{f}" for f in folders])

    def reached(self, step: str) -> None:
        """Called after each step, for those who want to watch a run; an error raised here ends it."""

    def _commit(self, last: dict, words: list[str], outputs: list[str], records: int) -> dict:
        manifest = {"run": last["run"] + 1, "words": words, "outputs": outputs, "records": records}
        if not self.files.create(f"commits/{manifest['run']:08d}.json", json.dumps(manifest)):
            raise RuntimeError("another run committed first; its records are carried, ours are not")
        return manifest

    def adopt(self, carried: DataFrame) -> dict:
        """Begin from records (keys, sequence) that were carried elsewhere, such as ``carried_by`` a log of runs."""
        last = self._last()
        if last["run"]:
            raise ValueError("there are runs already")
        folder = f"runs/00000001-{uuid.uuid4().hex}"
        sequence_words(carried, self.keys, self.sequence).write.parquet(f"{self.files.root}/{folder}/words")
        return self._commit(last, [f"{folder}/words"], [], 0)

    def pending(self, records: DataFrame, last: dict | None = None) -> DataFrame:
        """Words of the sequences that ``records`` hold and no committed run has carried.

        Both sides are one row per key and word, and the union with its aggregation takes the one shuffle of the
        words; no hot key meets in one task.
        """
        last = self._last() if last is None else last
        seen = sequence_words(records, self.keys, self.sequence)
        if not last["words"]:
            return seen
        done = self._read(last["words"]).select(*self.keys, "word_no", F.lit(0).cast("long").alias("word"), F.col("word").alias("done"))
        both = seen.withColumn("done", F.lit(0).cast("long")).unionByName(done)
        left = both.groupBy(*self.keys, "word_no").agg(F.bit_or("word").alias("word"), F.bit_or("done").alias("done"))
        return left.select(*self.keys, "word_no", F.col("word").bitwiseAND(F.bitwise_not("done")).alias("word")).where("word <> 0")

    def _rows(self, records: DataFrame, pending: DataFrame) -> DataFrame:
        """The pending records' rows, of contradicting copies the greatest by all their other columns."""
        keys, rest = self.keys, [c for c in records.columns if c not in (*self.keys, self.sequence)]
        if not rest:
            return word_sequences(pending, keys, self.sequence).select(*records.columns)
        # the other columns travel as one struct, so none of their names can clash
        rows = records.dropna(subset=[*keys, self.sequence]).select(*keys, self.sequence, F.struct(*rest).alias("kept_row"))
        rows = rows.select("*", *_bit(self.sequence))
        met = rows.join(pending.withColumnRenamed("word", "asked"), [*keys, "word_no"])
        met = met.where(F.col("word").bitwiseAND(F.col("asked")) != 0)
        one = met.groupBy(*keys, self.sequence).agg(F.max("kept_row").alias("kept_row"))
        return one.select(*[F.col("kept_row")[c].alias(c) if c in rest else F.col(c) for c in records.columns])

    def run(self, records: DataFrame, transform: Callable[[DataFrame], DataFrame] | None = None) -> dict | None:
        """Carry the pending records through ``transform``; None if nothing is new.

        Rows without a key or sequence name no record and are not carried.  All columns but the keys and the
        sequence must be orderable, as of contradicting copies the greatest is taken.
        """
        last = self._last()
        folder = f"runs/{last['run'] + 1:08d}-{uuid.uuid4().hex}"
        at = f"{self.files.root}/{folder}"
        self.pending(records, last).write.parquet(f"{at}/words")
        self.reached("pending")
        frozen = self.spark.read.parquet(f"{at}/words")
        asked = frozen.agg(F.sum(F.bit_count("word").cast("long"))).first()[0]
        if not asked:
            self.files.delete(folder)
            return None
        carried = self._rows(records, frozen)
        (transform(carried) if transform else carried).write.parquet(f"{at}/output")
        if transform is None:
            written = self.spark.read.parquet(f"{at}/output").count()
            if written != asked:
                raise RuntimeError(f"the source lost records while they were read: {asked} seen, {written} written")
        self.reached("output")
        words = [*last["words"], f"{folder}/words"]
        if len(words) > MERGE_RUNS:
            merged = self._read(words).groupBy(*self.keys, "word_no").agg(F.bit_or("word").alias("word"))
            merged.write.parquet(f"{at}/state")
            words = [f"{folder}/state"]
        self.reached("state")
        manifest = self._commit(last, words, [*last["outputs"], f"{folder}/output"], asked)
        self.reached("commit")
        return manifest

    def watermarks(self) -> DataFrame | None:
        """Per key its high watermark and how many sequences below it, from its first on, were not carried (so far)."""
        last = self._last()
        if not last["words"]:
            return None
        words = self._read(last["words"]).groupBy(*self.keys, "word_no").agg(F.bit_or("word").alias("word")).where("word <> 0")
        places = F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda i: F.call_function("shiftright", F.col("word"), i).bitwiseAND(F.lit(1)) == 1)
        base = F.col("word_no") * WORD
        each = words.select(*self.keys, (base + F.element_at(places, 1)).alias("low"), (base + F.element_at(places, -1)).alias("high"), F.bit_count("word").cast("long").alias("n"))
        return each.groupBy(*self.keys).agg(
            F.max("high").alias("watermark"), (F.max("high") - F.min("low") + 1 - F.sum("n")).alias("missing_below")
        )

    def output(self) -> DataFrame | None:
        """All committed output."""
        outputs = self._last()["outputs"]
        return self._read(outputs) if outputs else None

    def vacuum(self, older_than_s: float = 86_400) -> None:
        """Delete folders that no manifest names and that are older than any run may still take."""
        named = {f.rsplit("/", 1)[0] for m in self.manifests() for f in (*m["words"], *m["outputs"])}
        for name in self.files.list("runs"):
            if f"runs/{name}" not in named and self.files.age(f"runs/{name}") > older_than_s:
                self.files.delete(f"runs/{name}")
