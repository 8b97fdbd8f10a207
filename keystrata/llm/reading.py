"""Reading level of documents: familiar words and sentence length, put on the raters' scale."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.functions.bounded import use_all_cores
from keystrata.llm.subtitles import spoken, tokens, word_key
from keystrata.sources.shared import SharedFiles, shared_dir

#: Spoken words below which a document has no level.
MIN_WORDS = 30
#: Each gives a list of familiar words: those in at least this share of their language's documents.
FAMILIAR_SHARES = (0.02, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.6, 0.7, 0.8)
#: The list by which languages are told apart.
COMMON_SHARE = 0.3
#: A label names a language if it has at least this share of the documents, and so many.
LABEL_SHARE, LABEL_DOCUMENTS = 0.001, 20
#: Labels with lists at least as similar (cosine) are one language; a text with less of its words in any list is of none.
SAME_LANGUAGE, COVERED = 0.6, 0.15
#: Labelled rows from which the scale is fitted, at most.
LABEL_ROWS = 50_000
#: Entries that a task counts before it passes them on.
FLUSH = 200_000
LEVELS = 5
#: What is added to the spread of each measure within a level, divided by the number of labels, so that few do not fit noise.
RIDGE = 3.0


class _Words(dict):
    """Token to (key, whether a sentence ends with it); None for no word."""

    limit = 1 << 18

    def __missing__(self, token: str):
        if len(self) >= self.limit:
            self.clear()
        entry, key = None, word_key(token)
        if key is not None:
            plain = token.rstrip("\"”»')]")
            entry = (key, plain[-1:] in (".", "!", "?", "…", "。", "！", "？") and not plain.endswith(".."))
        self[token] = entry
        return entry


def _counted(text: str, known: _Words) -> tuple[list[tuple[tuple, int]], int]:
    """Word entries with counts, and number of words of a text's spoken part."""
    entries = [(known[t], n) for t, n in Counter(tokens(spoken(text))).items()]
    entries = [(e, n) for e, n in entries if e is not None]
    return entries, sum(n for _, n in entries)


def document_frequencies(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(label, word, n): in how many documents of a label a word occurs; the word '' counts the documents.

    ``docs``: text, label.  All documents of at least ``min_words`` spoken words count.  Each task adds up what it
    sees and passes on sums, so a word of all documents sends a few rows per task.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = _Words(), Counter()

        def sums() -> pa.RecordBatch:
            keys = list(seen)
            columns = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string())]
            return pa.RecordBatch.from_arrays([*columns, pa.array([seen[k] for k in keys], pa.int64())], names=["label", "word", "n"])

        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1)):
                entries, total = _counted(text.as_py(), known)
                if total < min_words:
                    continue
                name = label.as_py()
                seen.update((name, w) for w in {e[0] for e, _ in entries})
                seen[name, ""] += 1
                if len(seen) > FLUSH:
                    yield sums()
                    seen.clear()
        yield sums()

    counted = docs.select("text", "label").mapInArrow(count, "label string, word string, n bigint")
    return counted.groupBy("label", "word").agg(F.sum("n").alias("n"))


def languages(frequencies: DataFrame) -> dict[str, int]:
    """Which labels are the same language, from the words that their documents have in common.

    Labels may be missing, wrong for some documents, or spelled in several ways; a label's frequent words tell
    whose they are.  Labels of too few documents name none; their documents take part in no list and are measured by
    the lists that fit them.  There are at most 1 / ``LABEL_SHARE`` labels, and few words per label, whatever the corpus.
    """
    totals = frequencies.where("word = ''").select("label", F.col("n").alias("documents"))
    every = totals.agg(F.sum("documents")).first()[0] or 0
    kept = totals.where(F.col("documents") >= max(LABEL_DOCUMENTS, every * LABEL_SHARE))
    frequent = frequencies.where("word <> ''").join(F.broadcast(kept), "label").where(F.col("n") >= F.col("documents") * COMMON_SHARE)
    vectors: dict[tuple[int, str], dict[str, float]] = defaultdict(dict)
    for row in frequent.collect():
        vectors[-row["documents"], row["label"]][row["word"]] = row["n"] / row["documents"]
    groups: list[dict[str, float]] = []
    out: dict[str, int] = {}
    for (_, label), vector in sorted(vectors.items()):
        size = math.sqrt(sum(x * x for x in vector.values()))
        alike = [sum(x * g.get(w, 0.0) for w, x in vector.items()) / (size * math.sqrt(sum(x * x for x in g.values()))) for g in groups]
        best = max(range(len(groups)), key=alike.__getitem__, default=-1)
        if best < 0 or alike[best] < SAME_LANGUAGE:
            groups.append(vector)
            best = len(groups) - 1
        out[label] = best
    return out


def familiar_words(spark: SparkSession, frequencies: DataFrame, shares: tuple[float, ...] = FAMILIAR_SHARES) -> tuple[dict[str, list[int]], int]:
    """Per word, for each language, on how many of the lists of familiar words it is; and the number of languages.

    Shares of all words add up to the mean number of different words of a document, so a language has at most that
    mean divided by the least share of them, however large the corpus: the lists are small by construction.  Without
    labels of enough documents all documents count as one language.
    """
    groups = languages(frequencies)
    if groups:
        known = spark.createDataFrame([*groups.items()], "label string, language int")
        named = frequencies.join(F.broadcast(known), "label")
    else:
        named = frequencies.withColumn("language", F.lit(0))
    summed = named.groupBy("language", "word").agg(F.sum("n").alias("n"))
    totals = {r["language"]: r["n"] for r in summed.where("word = ''").collect()}
    count = max(totals, default=0) + 1
    if not totals:
        return {}, count
    least = F.lit(None).cast("double")
    for language, documents in totals.items():
        least = F.when(F.col("language") == language, documents * min(shares)).otherwise(least)
    out: dict[str, list[int]] = {}
    for row in summed.where((F.col("word") != "") & (F.col("n") >= least)).collect():
        on = sum(row["n"] >= totals[row["language"]] * x for x in shares)
        out.setdefault(row["word"], [0] * count)[row["language"]] = on
    return out, count


def features(docs: DataFrame, familiar: dict[str, list[int]], count: int, shares: tuple[float, ...], id_type: str, min_words: int = MIN_WORDS) -> DataFrame:
    """(id, language, n_words, u0, u1, ..., sentence) of documents of at least ``min_words`` spoken words.

    ``u``: the share of words outside each list; ``sentence``: logarithm of words per sentence, null for a text
    without a single sentence end.  The language is that whose common words cover most of the text; if none covers
    ``COVERED`` of it, -1, and no word is familiar.
    """
    lists = len(shares)
    common = sum(x <= COMMON_SHARE for x in shares)  # on so many lists or more is on the common one
    number = {w: i for i, w in enumerate(familiar)}
    on = np.array([familiar[w] for w in number] + [[0] * count], np.int64).reshape(-1, count)
    is_common = (on >= common).astype(np.float64)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for batch in batches:
            ids, spoken_in, totals, outside, sentence = [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                entries, total = _counted(text.as_py(), known)
                if total < min_words:
                    continue
                rows = np.array([number.get(e[0], -1) for e, _ in entries])
                times = np.array([n for _, n in entries], np.float64)
                covered = times @ is_common[rows]
                language = int(covered.argmax())
                if covered[language] < COVERED * total:
                    language = -1
                    of = np.zeros(lists + 1)
                    of[0] = total
                else:
                    of = np.bincount(on[rows, language], weights=times, minlength=lists + 1)
                ends = sum(n for e, n in entries if e[1])
                ids.append(i)
                spoken_in.append(language)
                totals.append(total)
                outside.append(np.cumsum(of)[:lists] / total)
                sentence.append(math.log(total / ends) if ends else None)
            if ids:
                columns = np.stack(outside, axis=1)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(ids)), pa.array(spoken_in, pa.int32()), pa.array(totals, pa.int64()),
                        *[pa.array(c) for c in columns], pa.array(sentence, pa.float64()),
                    ],
                    names=["id", "language", "n_words", *[f"u{i}" for i in range(lists)], "sentence"],
                )

    measures = "".join(f"u{i} double, " for i in range(lists))
    return docs.select("id", "text").mapInArrow(measure, f"id {id_type}, language int, n_words bigint, {measures}sentence double")


def with_products(z: np.ndarray) -> np.ndarray:
    """The measures and the products of any two of them, as their weight changes along the scale."""
    i, j = np.triu_indices(z.shape[1])
    return np.concatenate([z, z[:, i] * z[:, j]], axis=1)


def fit_scale(x: np.ndarray, levels: np.ndarray, ridge: float = RIDGE) -> tuple[np.ndarray, np.ndarray]:
    """Linear discriminant of the levels: weights and constants, one row per level.  Levels without rows never win."""
    k = x.shape[1]
    weights, constants = np.zeros((LEVELS, k)), np.full(LEVELS, -1e9)
    within = sum(np.cov(x[levels == c].T, bias=True).reshape(k, k) * (levels == c).sum() for c in np.unique(levels)) / max(len(levels), 1)
    inverse = np.linalg.inv(within + ridge / max(len(levels), 1) * np.eye(k))
    for c in np.unique(levels):
        mean = x[levels == c].mean(0)
        weights[c - 1] = inverse @ mean
        constants[c - 1] = -0.5 * mean @ inverse @ mean + math.log((levels == c).mean())
    return weights, constants


def reading_levels(
    spark: SparkSession,
    docs: DataFrame,
    key: str,
    text: str,
    labels: DataFrame,
    label_key: str,
    level: str,
    *,
    language: str | None = None,
    shares: tuple[float, ...] = FAMILIAR_SHARES,
    min_words: int = MIN_WORDS,
    label_rows: int = LABEL_ROWS,
) -> DataFrame:
    """(key, level) of each document of at least ``min_words`` spoken words; the others, and null texts, have none.

    A familiar-word formula and nothing beside it: the shares of words outside lists of words that many documents
    of the language have, and the mean length of sentences (the language's median where a text has no sentence
    end), with their products.  Each measure is put on one scale for all languages by its median (to a thousandth of the ranks) and
    spread over all documents of the language.  The formula's weights, for each measure and its square, come from a
    linear discriminant fitted on at most ``label_rows`` labelled rows (those with the least hash of their key).
    Null levels and levels outside 1 to 5 are no labels.  Without any label all documents get the middle level.

    ``language`` names a column that tells the language of most documents, however spelled; see ``languages``.

    Two passes over the texts; what they give, a few numbers per word and per document, is written to the shared
    folder, and only the latter stays until the session ends.
    """
    rows = docs.select(
        F.col(key).alias("id"), F.col(text).cast("string").alias("text"),
        F.lower(F.trim(F.coalesce(F.col(language) if language else F.lit(None).cast("string"), F.lit("")))).alias("label"),
    )
    rows = use_all_cores(rows.dropna())
    id_type = rows.schema["id"].dataType.simpleString()
    path = shared_dir(spark, "reading")
    # both tables are read more than once: written, the texts are not gone over again
    document_frequencies(rows, min_words).write.parquet(f"{path}/frequencies")
    familiar, count = familiar_words(spark, spark.read.parquet(f"{path}/frequencies"), shares)
    SharedFiles(spark, path).delete("frequencies")
    features(rows, familiar, count, shares, id_type, min_words).write.parquet(f"{path}/measures")
    measured = spark.read.parquet(f"{path}/measures")
    names = [*[f"u{i}" for i in range(len(shares))], "sentence"]
    spread = measured.groupBy("language").agg(
        *[F.percentile_approx(f, 0.5, 1000).alias(f"{f}_m") for f in names], *[F.stddev_pop(f).alias(f"{f}_s") for f in names]
    )
    # one row per language, and one for none
    scale = {r["language"]: (np.array([r[f"{f}_m"] for f in names], float), np.array([r[f"{f}_s"] for f in names], float) + 1e-6) for r in spread.collect()}

    def scaled(language: np.ndarray, x: np.ndarray) -> np.ndarray:
        out = np.zeros(x.shape)
        for number, (middle, width) in scale.items():
            at = language == number
            out[at] = (x[at] - middle) / width
        return np.nan_to_num(out, nan=0.0)

    valid = labels.where(F.col(level).between(1, LEVELS)).select(F.col(label_key).alias("id"), F.col(level).cast("int").alias("level"))
    sample = valid.join(measured, "id").orderBy(F.xxhash64("id"), "id", "level").limit(label_rows).collect()
    if not sample:
        return measured.select(F.col("id").alias(key), F.lit((LEVELS + 1) // 2).alias("reading_level"))
    x = np.array([[np.nan if r[f] is None else r[f] for f in names] for r in sample], float)
    x = with_products(scaled(np.array([r["language"] for r in sample]), x))
    weights, constants = fit_scale(x, np.array([r["level"] for r in sample]))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(i + 2).to_numpy(zero_copy_only=False).astype(float) for i in range(len(names))], axis=1)
            scores = with_products(scaled(batch.column(1).to_numpy(zero_copy_only=False), x)) @ weights.T + constants
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores.argmax(axis=1) + 1, pa.int32())], names=["id", "reading_level"])

    judged = measured.select("id", "language", *names).mapInArrow(judge, f"id {id_type}, reading_level int")
    return judged.select(F.col("id").alias(key), "reading_level")
