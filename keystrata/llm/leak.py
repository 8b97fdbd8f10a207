"""Evaluation texts leaking into training text: a distributed positional inverted index and phrase search in it."""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.functions.bounded import broadcast_if_small, use_all_cores
from keystrata.llm.subtitles import CUE_MARK, UNKNOWN, is_word, spoken, tokens, word_key
from keystrata.sources.shared import SharedFiles, shared_dir

#: Successive words of a passage that make a leak, and how many of so many, in order, make a near match.
MIN_WORDS, NEAR_WORDS = 12, 9
#: Rarest terms of each window of ``MIN_WORDS`` words from which lists are intersected, and how many must meet.
ANCHORS, MIN_HITS = 4, 2
#: Words by which the places of two terms may differ in a near match, and words that an advert may have.
SLACK, ADVERT_WORDS = 4, 40
#: Letters from which a word may have a damaged one, and from which it may if its neighbours are whole.
DAMAGED_LETTERS, FLANKED_LETTERS = 5, 3
#: A word is read as damage of another if it is in at most this share of the other's documents, or in so few.
DAMAGE_SHARE, DAMAGE_DOCUMENTS = 0.05, 2
#: Words of documents whose postings a task puts together to one row per term.
FLUSH_WORDS = 400_000
#: Bytes of passages searched for at once; what is sent to all tasks grows with this only.
BLOCK_BYTES = 16 << 20
#: Pairs of posting and anchor that a task looks at at once.
PAIRS = 4_000_000
#: The term under which the beginnings of cues are posted.
CUES = ""
#: A term's rows of one task are spread over one more partition for each such share of the task's words.
SALTS = 1024

#: Words of adverts and credits.  They count only for a cue that stands between two halves of a passage.
ADVERT_SIGNS = (
    "ad ads advert advertise advertisement app available bet bonus buy casino corrected corrections credits deal discount "
    "download encoded exclusive follow free http https join member membership offer online order presented promo provided rate "
    "released ripped shop site sponsor sponsored sponsors store stream subscribe subs subtitle subtitles support sync synced "
    "timing transcript transcribed translated translation vip visit watch web website www "
    "untertitel werbung anzeige übersetzung besuchen kaufen kostenlos abonnieren angebot "
    "sous-titres traduction traduit publicité visitez achetez gratuit abonnez offre "
    "subtítulos traducción traducido publicidad visita compra gratis suscríbete oferta"
).split()


class _Codes(dict):
    """Token to the number of its term in this task; -1 for what is no word, -2 between cues."""

    limit = 1 << 18

    def __init__(self):
        super().__init__()
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.terms: list[str] = []
        self._numbers: dict[str, int] = {}
        self[CUE_MARK] = -2

    def __missing__(self, token: str) -> int:
        key = word_key(token)
        number = -1
        if key is not None:
            number = self._numbers.get(key)
            if number is None:
                number = self._numbers[key] = len(self.terms)
                self.terms.append(key)
        self[token] = number
        return number


def words(text: str | None) -> list[str]:
    """The keys of a passage's words."""
    return [k for k in map(word_key, tokens(text or "")) if k is not None]


def _lists(offsets: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)


def _edges(starts: np.ndarray, end: int) -> np.ndarray:
    return np.append(starts, end)


def _postings(ids: pa.Array, coded: list[np.ndarray], terms: list[str], batch: int) -> Iterator[pa.RecordBatch]:
    """The rows of some documents: one per term, with documents, counts and positions as arrays."""
    names = ["term", "batch", "documents", "salts", "ids", "counts", "positions", "marks"]
    lengths = np.array([(c >= 0).sum() for c in coded], np.int64)
    code = np.concatenate([c[c >= 0] for c in coded])
    doc = np.repeat(np.arange(len(coded), dtype=np.int32), lengths)
    first = np.cumsum(lengths) - lengths
    at = (np.arange(len(code)) - np.repeat(first, lengths)).astype(np.int32)
    if len(code):
        order = np.argsort(code, kind="stable")
        code_s, doc_s, at_s = code[order], doc[order], at[order]
        new_term = np.flatnonzero(np.concatenate(([True], code_s[1:] != code_s[:-1])))
        new_doc = np.flatnonzero(np.concatenate(([True], (code_s[1:] != code_s[:-1]) | (doc_s[1:] != doc_s[:-1]))))
        term_docs = np.searchsorted(new_doc, new_term)
        counts = np.diff(_edges(new_doc, len(code_s))).astype(np.int32)
        sizes = np.diff(_edges(new_term, len(code_s)))
        per_term = np.diff(_edges(term_docs, len(new_doc))).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(terms, pa.string()).take(pa.array(code_s[new_term])),
                pa.array(np.full(len(new_term), batch, np.int64)),
                pa.array(per_term),
                pa.array((1 + sizes * SALTS // len(code_s)).astype(np.int32)),
                _lists(_edges(term_docs, len(new_doc)), ids.take(pa.array(doc_s[new_doc]))),
                _lists(_edges(term_docs, len(new_doc)), pa.array(counts)),
                _lists(_edges(new_term, len(at_s)), pa.array(at_s)),
                pa.nulls(len(new_term), pa.list_(pa.int32())),
            ],
            names=names,
        )
    # cues: where each begins, and a hash of its words
    starts, owners = [], []
    for d, c in enumerate(coded):
        begins = np.cumsum(c >= 0)[c == -2]
        begins = np.unique(np.concatenate(([0], begins)))
        begins = begins[begins < lengths[d]]
        starts.append(begins + first[d])
        owners.append(len(begins))
    begin = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    if not len(begin):
        return
    size = np.diff(_edges(begin, len(code)))
    weight = np.cumprod(np.full(int(size.max()), 31, np.uint32), dtype=np.uint32)
    known = np.array([zlib.crc32(t.encode()) for t in terms], np.uint32)
    weighted = known[code] * weight[np.arange(len(code)) - np.repeat(begin, size)]
    mark = np.add.reduceat(weighted, begin, dtype=np.uint32).view(np.int32)
    owners = np.array(owners, np.int32)
    kept = np.flatnonzero(owners)
    relative = (begin - np.repeat(first, owners)).astype(np.int32)
    one = np.array([0, len(kept)])
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([CUES]), pa.array([batch], pa.int64()), pa.array([len(kept)], pa.int32()), pa.array([SALTS], pa.int32()),
            _lists(one, ids.take(pa.array(kept))), _lists(one, pa.array(owners[kept])),
            _lists(np.array([0, len(relative)]), pa.array(relative)), _lists(np.array([0, len(mark)]), pa.array(mark)),
        ],
        names=names,
    )


@dataclass
class Index:
    """A stored index: ``postings`` (term, batch, documents, ids, counts, positions, marks) and ``vocabulary`` (term, documents)."""

    postings: DataFrame
    vocabulary: DataFrame


def build_index(spark: SparkSession, docs: DataFrame, key: str, text: str, path: str, *, flush_words: int = FLUSH_WORDS) -> Index:
    """Write the positional inverted index of all terms of all documents below ``path``, once for any number of searches.

    Texts are gone over once.  Each task puts the postings of some documents (``batch``) together to one row per
    term: the documents that have it, how often, and at which places of their spoken text, so what is shuffled is
    numbers.  Rows are clustered and sorted by term; a term that many words are is spread over several partitions,
    by a share that its task has counted.  Under ``CUES`` the beginnings of cues are posted, with hashes of their
    words.  Rows with a null key or text are not indexed; a key in several rows is indexed for each.
    """
    rows = use_all_cores(docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text")).dropna())
    id_type = rows.schema["id"].dataType.simpleString()

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Codes()
        ids, coded, held, number = [], [], 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            id_column = batch.column(0)
            for i, text in enumerate(batch.column(1)):
                found = tokens(spoken(text.as_py(), f"\n{CUE_MARK}\n"))
                codes = np.fromiter(map(known.__getitem__, found), np.int32, len(found))
                ids.append(id_column.slice(i, 1))
                coded.append(codes[codes != -1])
                held += len(codes)
                if held >= flush_words:
                    yield from _postings(pa.concat_arrays(ids), coded, known.terms, number)
                    ids, coded, held, number = [], [], 0, number + 1
                    if len(known) > known.limit:
                        known.clear()
        if ids:
            yield from _postings(pa.concat_arrays(ids), coded, known.terms, number)

    schema = f"term string, batch bigint, documents int, salts int, ids array<{id_type}>, counts array<int>, positions array<int>, marks array<int>"
    posted = rows.mapInArrow(post, schema)
    spread = posted.repartition("term", F.pmod("batch", "salts")).drop("salts").sortWithinPartitions("term", "batch")
    spread.write.parquet(f"{path}/postings")
    stored = spark.read.parquet(f"{path}/postings")
    frequencies = stored.where(F.col("term") != CUES).groupBy("term").agg(F.sum("documents").alias("documents"))
    frequencies.write.parquet(f"{path}/vocabulary")
    return Index(stored, spark.read.parquet(f"{path}/vocabulary"))


def open_index(spark: SparkSession, path: str) -> Index:
    return Index(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/vocabulary"))


def _letters_only(term: str = "term"):
    return ~F.col(term).rlike(r"[0-9~]")


def _shortened(term: str = "term"):
    """The term and each that it is without one of its letters."""
    n = F.length(term)
    places = F.sequence(F.lit(1), n)
    return F.array_append(
        F.transform(places, lambda i: F.concat(F.substring(F.col(term), F.lit(1), i - 1), F.substring(F.col(term), i + 1, n))), F.col(term)
    )


def damaged_forms(vocabulary: DataFrame, asked: DataFrame) -> DataFrame:
    """(form, term, documents): words of the vocabulary that are an asked word with one damaged letter.

    Two words within one edit share a form without one letter, so they are found by an equal join.  A word is taken
    for damage only if it is rare beside the one it resembles, else it is another word.  Digits are not judged so.
    ``asked``: term, and documents, how many have it.
    """
    left = asked.where(_letters_only() & (F.length("term") >= FLANKED_LETTERS)).select(
        F.col("term").alias("asked_term"), F.col("documents").alias("asked_documents"), F.explode(F.array_distinct(_shortened())).alias("part")
    )
    right = vocabulary.where(_letters_only() & (F.length("term") >= FLANKED_LETTERS - 1)).select(
        F.col("term").alias("form"), "documents", F.explode(F.array_distinct(_shortened())).alias("part")
    )
    near = right.join(broadcast_if_small(left), "part").where(
        (F.col("form") != F.col("asked_term"))
        & (F.col("documents") <= F.greatest(F.lit(DAMAGE_DOCUMENTS), F.col("asked_documents") * DAMAGE_SHARE))
        & (F.levenshtein("form", "asked_term", 1) >= 0)
    )
    return near.select("form", F.col("asked_term").alias("term"), "documents").distinct()


def anchors(passages: list[np.ndarray], frequency: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(term, item, offset) of the rarest terms of each window of ``min_words`` words of each passage.

    A stretch of that many words has a whole window, so it has all anchors of one.
    """
    out: list[tuple[np.ndarray, int]] = []
    for item, passage in enumerate(passages):
        if not len(passage):
            continue
        rank = frequency[passage].astype(np.float64) + np.arange(len(passage)) / (len(passage) + 1)
        width = min(min_words, len(passage))
        windows = np.lib.stride_tricks.sliding_window_view(rank, width)
        chosen = np.argpartition(windows, min(ANCHORS, width) - 1, axis=1)[:, :ANCHORS] + np.arange(len(windows))[:, None]
        chosen = np.unique(chosen)
        out.append((chosen[np.isfinite(rank[chosen])], item))
    if not out:
        return (np.zeros(0, np.int64),) * 3
    offsets = np.concatenate([o for o, _ in out])
    items = np.concatenate([np.full(len(o), i) for o, i in out])
    return np.concatenate([passages[i][o] for o, i in out]).astype(np.int64), items.astype(np.int64), offsets.astype(np.int64)


def _rows(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For pieces of an array, given by first place and size: the places, and of which piece each is."""
    piece = np.repeat(np.arange(len(size)), size)
    return np.repeat(first - np.cumsum(size) + size, size) + np.arange(len(piece)), piece


class _Searched:
    """One block of passages and what tasks need to search for them."""

    def __init__(self, passages, forms, n_codes, frequency, signs, min_words, near_words):
        self.n_items, self.n_codes, self.signs = len(passages), n_codes, signs
        self.min_words, self.near_words = min_words, near_words
        self.sizes = np.array([len(p) for p in passages], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.codes = np.concatenate(passages) if passages else np.zeros(0, np.int32)
        # pairs (form, term) that count as equal: anywhere, or only between whole neighbours
        self.anywhere = np.array(sorted(f * n_codes + t for f, t, n in forms if n >= DAMAGED_LETTERS), np.int64)
        self.flanked = np.array(sorted(f * n_codes + t for f, t, n in forms if n < DAMAGED_LETTERS), np.int64)
        self.is_form = np.zeros(n_codes + 1, bool)  # the last is for -1, which is no term
        self.is_form[[f for f, _, _ in forms]] = True
        term, item, offset = anchors(passages, frequency, min_words)
        order = np.lexsort((offset, item, term))
        self.item, self.offset = item[order], offset[order]
        self.first = np.searchsorted(term[order], np.arange(n_codes + 1))

    def _in(self, pairs: np.ndarray, keys: np.ndarray) -> np.ndarray:
        if not len(pairs) or not len(keys):
            return np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(pairs, keys), len(pairs) - 1)
        return pairs[at] == keys

    def equal(self, passage: np.ndarray, text: np.ndarray, inner: np.ndarray) -> np.ndarray:
        """Which words are the same, one of them perhaps damaged; ``inner``: neither first nor last of its passage."""
        same = passage == text
        open_ = np.flatnonzero(self.is_form[text] & ~same)
        if len(open_):
            keys = text[open_].astype(np.int64) * self.n_codes + passage[open_]
            damaged = self._in(self.anywhere, keys)
            # both are judged by the state before, so that a damaged word is never another one's whole neighbour
            flanked = self._in(self.flanked, keys) & inner[open_]
            if flanked.any():
                damaged[flanked] |= same[open_[flanked] - 1] & same[open_[flanked] + 1]
            same[open_[damaged]] = True
        return same

    def hits(self, doc: np.ndarray, at: np.ndarray, code: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Intersect the anchors' lists: (document, item, start, met) where enough of an item's anchors meet.

        Each posting of an anchor, moved back by its offset, names the place where the passage would begin.  All
        places of a document and item are given if at one of them anchors meet, which ``met`` marks.  Postings come
        by document; they are taken in pieces of at most ``PAIRS`` pairs, and one document with more in pieces of items.
        """
        n = self.first[code + 1] - self.first[code]
        some = n > 0
        doc, at, code, n = doc[some], at[some], code[some], n[some]
        if not len(doc):
            return
        total = np.cumsum(n)
        new = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
        ends = np.append(new[1:], len(doc))
        low = 0
        while low < len(new):
            base = total[new[low]] - n[new[low]]
            high = max(low + 1, int(np.searchsorted(total[ends - 1], base + PAIRS, side="right")))
            part = slice(new[low], ends[high - 1])
            pairs = int(n[part].sum())
            pieces = -(-pairs // PAIRS) if high == low + 1 else 1
            bounds = np.linspace(0, self.n_items, min(pieces, max(1, self.n_items)) + 1).astype(np.int64)
            for a, b in zip(bounds[:-1], bounds[1:]):
                yield self._met(doc[part], at[part], code[part], int(a), int(b))
            low = high

    def _met(self, doc, at, code, item_low, item_high):
        first, last = self.first[code], self.first[code + 1]
        if item_low > 0 or item_high < self.n_items:
            # anchors of a term are sorted by item
            key = self.item + np.repeat(np.arange(self.n_codes), np.diff(self.first)) * self.n_items
            first = np.searchsorted(key, code * self.n_items + item_low)
            last = np.searchsorted(key, code * self.n_items + item_high)
        which, posting = _rows(first, last - first)
        d, item, start = doc[posting].astype(np.int64), self.item[which], at[posting] - self.offset[which]
        order = np.lexsort((start, item, d))
        d, item, start = d[order], item[order], start[order]
        group = d * self.n_items + item
        near = (group[1:] == group[:-1]) & (start[1:] - start[:-1] <= SLACK)
        met = np.zeros(len(d), bool)
        met[1:] |= near
        met[:-1] |= near
        new = np.concatenate(([True], group[1:] != group[:-1])) if len(d) else np.zeros(0, bool)
        kept = np.zeros(len(d), bool)
        if len(d):
            begins = np.flatnonzero(new)
            kept = np.repeat(np.logical_or.reduceat(met, begins), np.diff(_edges(begins, len(d))))
        once = kept & np.concatenate(([True], (group[1:] != group[:-1]) | (start[1:] != start[:-1])))[: len(d)]
        return d[once], item[once], start[once], met[once]

    def laid(self, full: np.ndarray, base: np.ndarray, length: np.ndarray, item: np.ndarray, start: np.ndarray):
        """Passages laid over texts (``base`` and ``length`` in ``full``) at the starts; the words of all, one after the other."""
        size = self.sizes[item]
        place, piece = _rows(self.begins[item], size)
        offset = place - self.begins[item][piece]
        at = start[piece] + offset
        words = self.codes[place]
        inner = (offset > 0) & (offset < size[piece] - 1)

        def at_shift(shift: int) -> np.ndarray:
            p = at + shift
            inside = (p >= 0) & (p < length[piece])
            return self.equal(words, np.where(inside, full[base[piece] + np.where(inside, p, 0)], -1), inner)

        return at_shift, np.cumsum(size) - size, offset

    def runs(self, same: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The longest unbroken stretch of each passage."""
        places = np.arange(len(same))
        stop = np.where(same, -1, places)
        stop[first] = np.maximum(stop[first], first - 1)
        return np.maximum.reduceat(np.where(same, places - np.maximum.accumulate(stop), 0), first)

    def windows(self, same: np.ndarray, first: np.ndarray, offset: np.ndarray) -> np.ndarray:
        """The most words of any window of ``min_words`` of each passage."""
        total = np.concatenate(([0], np.cumsum(same)))
        back = np.minimum(offset + 1, self.min_words)
        end = np.arange(1, len(same) + 1)
        return np.maximum.reduceat(total[end] - total[end - back], first)

    def joined(self, item: int, starts: np.ndarray, cues: np.ndarray, marks: np.ndarray, full: np.ndarray) -> tuple[int, int, list[int]]:
        """The longest stretch with single cues in between that may be adverts: words, words without, cues to be judged."""
        one = np.zeros(len(starts), np.int64)
        at_shift, first, _ = self.laid(full, one, one + len(full), np.full(len(starts), item), starts)
        runs = []
        for start, same in zip(starts.tolist(), np.split(at_shift(0), first[1:])):
            edges = np.flatnonzero(np.diff(np.concatenate(([0], same.view(np.int8), [0]))))
            runs += [(a, b, start) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()) if b - a > 1]
        runs.sort(key=lambda r: (r[2] + r[0], r[0]))
        best: list[tuple[int, list[int]]] = []
        for i, (low, high, start) in enumerate(runs):
            mine = (high - low, [])
            for j in range(i):
                a_low, a_high, a_start = runs[j]
                if not 0 < start - a_start <= ADVERT_WORDS or a_high < low:
                    continue
                for o in range(max(low, a_low + 1), min(a_high, high - 1) + 1):
                    c = int(np.searchsorted(cues, a_start + o))
                    if c + 1 >= len(cues) or cues[c] != a_start + o or cues[c + 1] != start + o:
                        continue
                    judged = [] if np.isin(full[a_start + o : start + o], self.signs).any() else [int(marks[c])]
                    words = best[j][0] - (a_high - o) + (high - o)
                    if words > mine[0]:
                        mine = (words, best[j][1] + judged)
            best.append(mine)
        sure = max((b[0] for b in best if not b[1]), default=0)
        most = max(best, key=lambda b: b[0], default=(0, []))
        return most[0], sure, most[1] if most[0] > sure else []

    def in_order(self, shifted: np.ndarray) -> int:
        """Of a window of successive words, the most in rising order, from which of them stand where, by shift and word."""
        row, offsets = np.nonzero(shifted)
        places = offsets + row
        order = np.lexsort((-places, offsets))
        tails: list[int] = []
        back: list[int] = []
        tail_nodes: list[int] = []
        nodes = list(zip(offsets[order].tolist(), places[order].tolist()))
        # longest increasing chain: offsets up, places up
        for i, (_, p) in enumerate(nodes):
            k = bisect_left(tails, p)
            back.append(tail_nodes[k - 1] if k else -1)
            if k == len(tails):
                tails.append(p)
                tail_nodes.append(i)
            else:
                tails[k], tail_nodes[k] = p, i
        chain = []
        at = tail_nodes[-1] if tail_nodes else -1
        while at >= 0:
            chain.append(nodes[at][0])
            at = back[at]
        chain.reverse()
        low = most = 0
        for high, o in enumerate(chain):
            while chain[low] <= o - self.min_words:
                low += 1
            most = max(most, high - low + 1)
        return most

    def search(self, table: pa.Table) -> list[list]:
        """(id, item number, words, joined words, cues to be judged, shared) of one batch of documents."""
        out: list[list] = [[], [], [], [], [], []]
        codes = table["code"].to_numpy()
        ids = [x.values for x in table["ids"]]
        numbered = pa.concat_arrays(ids).dictionary_encode()
        counts = np.concatenate([np.asarray(x.values) for x in table["counts"]])
        position = np.concatenate([np.asarray(x.values) for x in table["positions"]])
        doc = np.repeat(numbered.indices.to_numpy(), counts)
        code = np.repeat(np.repeat(codes, [len(x) for x in ids]), counts)
        cue = code < 0
        mark = [np.asarray(table["marks"][i].values) for i in np.flatnonzero(codes < 0).tolist()]
        cue_doc, cue_at, cue_mark = doc[cue], position[cue], np.concatenate(mark) if mark else np.zeros(0, np.int32)
        order = np.lexsort((cue_at, cue_doc))
        cue_doc, cue_at, cue_mark = cue_doc[order], cue_at[order], cue_mark[order]
        doc, position, code = doc[~cue], position[~cue].astype(np.int64), code[~cue]
        order = np.lexsort((position, doc))
        doc, position, code = doc[order], position[order], code[order]
        # the texts as far as they have postings, one after the other; -1 where another word stands
        last = np.flatnonzero(np.append(doc[1:] != doc[:-1], True)) if len(doc) else np.zeros(0, np.int64)
        length = np.zeros(len(numbered.dictionary), np.int64)
        length[doc[last]] = position[last] + 1
        base = np.cumsum(length) - length
        full = np.full(int(length.sum()), -1, np.int32)
        full[base[doc] + position] = code
        cue_first = np.searchsorted(cue_doc, np.arange(len(length) + 1))
        for d, item, start, met in self.hits(doc, position, code):
            groups = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (item[1:] != item[:-1]))) if len(d) else np.zeros(0, np.int64)
            cuts = [0]
            for g in groups[1:].tolist():
                if self.sizes[item[cuts[-1] : g]].sum() * (2 * SLACK + 1) > PAIRS:
                    cuts.append(g)
            for low, high in zip(cuts, [*cuts[1:], len(d)]):
                if high > low:
                    self._judge(d[low:high], item[low:high], start[low:high], met[low:high], full, base, length, cue_first, cue_at, cue_mark, numbered.dictionary, out)
        return out

    def _judge(self, d, item, start, met, full, base, length, cue_first, cue_at, cue_mark, names, out) -> None:
        at_shift, first, _ = self.laid(full, base[d], length[d], item, start)
        run = self.runs(at_shift(0), first)
        group_first = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (item[1:] != item[:-1])))
        group_end = np.append(group_first[1:], len(d))
        best = np.maximum.reduceat(run, group_first)
        of = np.repeat(np.arange(len(group_first)), group_end - group_first)
        # near: only where no stretch is long enough
        wanted = np.flatnonzero(met & (best[of] < self.min_words))
        shared = np.minimum(best, self.min_words)
        if len(wanted):
            at_shift, first, offset = self.laid(full, base[d[wanted]], length[d[wanted]], item[wanted], start[wanted])
            shifted = np.stack([at_shift(x) for x in range(-SLACK, SLACK + 1)])
            near = self.windows(shifted[SLACK], first, offset)
            bound = self.windows(shifted.any(axis=0), first, offset)
            for i in np.flatnonzero((near < self.near_words) & (bound >= self.near_words)).tolist():
                end = first[i + 1] if i + 1 < len(first) else len(offset)
                near[i] = max(near[i], self.in_order(shifted[:, first[i] : end]))
            np.maximum.at(shared, of[wanted], near)
        # stretches with a cue in between: the two longest of a group must be enough together
        two = np.zeros(len(group_first), np.int64)
        ranked = np.lexsort((-run, of))
        second = group_first + 1
        more = second < group_end
        two[more] = run[ranked][group_first[more]] + run[ranked][second[more]]
        for g in range(len(group_first)):
            words, joined, judged, i = int(best[g]), int(best[g]), [], int(group_first[g])
            n, number = int(d[i]), int(item[i])
            if words < self.min_words <= two[g]:
                a, b = cue_first[n], cue_first[n + 1]
                text = full[base[n] : base[n] + length[n]]
                joined, sure, judged = self.joined(number, start[i : group_end[g]], cue_at[a:b], cue_mark[a:b], text)
                words = max(words, sure)
                joined = max(joined, words)
            if joined < self.min_words and shared[g] < self.near_words:
                continue
            for column, x in zip(out, (names[n].as_py(), number, words, joined, judged, int(max(shared[g], min(words, self.min_words))))):
                column.append(x)


def _search_block(spark: SparkSession, index: Index, asked: DataFrame, id_type: str, min_words: int, near_words: int) -> DataFrame:
    """(id, row, words, joined, judged, shared) for the passages of one block (row, words)."""
    rows = asked.collect()
    each = asked.select(F.explode("words").alias("term"))
    signs = sorted({k for w in ADVERT_SIGNS for k in words(w)})
    extra = spark.createDataFrame([(s,) for s in signs], "term string")
    terms = each.unionByName(extra).distinct()
    known = terms.join(index.vocabulary, "term", "left").select("term", F.coalesce("documents", F.lit(0)).alias("documents"))
    known = [(r["term"], r["documents"]) for r in known.collect()]
    asked_terms = spark.createDataFrame(known, "term string, documents bigint")
    forms = [tuple(r) for r in damaged_forms(index.vocabulary, asked_terms).select("form", "term").collect()]
    names = sorted({t for t, _ in known} | {f for f, _ in forms})
    codes = {t: i for i, t in enumerate(names)}
    frequency = np.zeros(max(1, len(names)))
    for t, n in known:
        frequency[codes[t]] = n
    if UNKNOWN in codes:
        frequency[codes[UNKNOWN]] = np.inf
    passages = [np.array([codes[w] for w in r["words"]], np.int32) for r in rows]
    numbers = [r["row"] for r in rows]
    searched = _Searched(
        passages, [(codes[f], codes[t], len(t)) for f, t in forms], len(names), frequency,
        np.array([codes[s] for s in signs], np.int32), min_words, near_words,
    )
    # a block's terms are bounded by its bytes
    wanted = spark.createDataFrame([*((t, c) for t, c in codes.items()), (CUES, -1)], "term string, code int")
    lists = index.postings.join(broadcast_if_small(wanted), "term").select("batch", "code", "ids", "counts", "positions", "marks")

    def match(table: pa.Table) -> pa.Table:
        found = searched.search(table)
        found[1] = [numbers[i] for i in found[1]]
        types = [table.schema.field("ids").type.value_type, pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.int32()]
        return pa.table([pa.array(c, t) for c, t in zip(found, types)], names=["id", "row", "words", "joined", "judged", "shared"])

    schema = f"id {id_type}, row bigint, words int, joined int, judged array<bigint>, shared int"
    return lists.groupBy("batch").applyInArrow(match, schema)


def _adverts(index: Index, marks: DataFrame) -> DataFrame:
    """(mark): those of the given cues that stand in more than one document, as what is said once seldom does."""
    pairs = F.explode(F.arrays_zip(F.transform("marks", lambda m: m.cast("long")).alias("mark"), _owners().alias("id")))
    cues = index.postings.where(F.col("term") == CUES).select(pairs.alias("c")).select("c.mark", "c.id")
    found = cues.join(broadcast_if_small(marks), "mark", "left_semi").distinct()
    return found.groupBy("mark").count().where("count > 1").select("mark")


def _owners():
    """The document of each posting of a row, from its documents and counts."""
    return F.flatten(F.transform(F.arrays_zip("ids", "counts"), lambda x: F.array_repeat(x["ids"], x["counts"])))


def search(
    spark: SparkSession,
    index: Index,
    items: DataFrame,
    item: str,
    passage: str,
    *,
    min_words: int = MIN_WORDS,
    near_words: int = NEAR_WORDS,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Search the index for passages: (id, item_id, words, shared); no text is gone over.

    Passages are the stated query set and are taken in blocks of about ``block_bytes``.  A block reads the lists of
    its own terms, of their damaged forms and of the beginnings of cues, and brings lists of the same documents
    together.  There they are intersected from the rarest terms on: where enough anchors meet, moved by their
    offsets, the passage is laid over the other lists.

    Exact: ``words`` successive words, at least ``min_words``, stand unbroken.  One damaged letter makes no
    difference (see ``damaged_forms`` and ``skeleton``), nor does a single cue in between that is an advert: it has
    a word of ``ADVERT_SIGNS`` or the same cue stands in another document too.  Near: of ``min_words`` successive
    words ``shared``, at least ``near_words``, stand in the same order, with up to ``SLACK`` words more or fewer in
    between (what stands without such words counts if it is enough, else what stands with them).
    """
    id_type = index.postings.schema["ids"].dataType.elementType.simpleString()
    asked = items.select(F.col(item).cast("long").alias("item"), F.col(passage).cast("string").alias("passage")).dropna()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            found = [words(p.as_py()) for p in batch.column(1)]
            rows = pa.array(np.arange(number, number + len(found)), pa.int64())
            number += len(found)
            yield pa.RecordBatch.from_arrays([rows, batch.column(0), pa.array(found, pa.list_(pa.string()))], names=["row", "item", "words"])

    path = shared_dir(spark, "search")
    asked.mapInArrow(split, "row bigint, item bigint, words array<string>").write.parquet(f"{path}/passages")
    passages = spark.read.parquet(f"{path}/passages")
    size = passages.agg(F.sum(F.octet_length(F.array_join("words", " ")))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    for block in range(blocks):
        part = passages.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == block).select("row", "words")
        _search_block(spark, index, part, id_type, min_words, near_words).write.parquet(f"{path}/matches/block={block}")
    matches = spark.read.parquet(*[f"{path}/matches/block={b}" for b in range(blocks)])
    if matches.where(F.size("judged") > 0).limit(1).count():
        marks = matches.select(F.explode("judged").alias("mark")).distinct()
        adverts = _adverts(index, marks)
        adverts.write.parquet(f"{path}/adverts")
        adverts = spark.read.parquet(f"{path}/adverts").withColumn("advert", F.lit(True))
        open_ = matches.where(F.size("judged") > 0).select("id", "row", "joined", F.explode("judged").alias("mark"))
        settled = open_.join(broadcast_if_small(adverts), "mark", "left").groupBy("id", "row").agg(
            F.min(F.coalesce("advert", F.lit(False))).alias("all_adverts")
        )
        matches = matches.join(settled, ["id", "row"], "left").withColumn(
            "words", F.when(F.coalesce("all_adverts", F.lit(False)), F.col("joined")).otherwise(F.col("words"))
        )
    kept = matches.where((F.col("words") >= min_words) | (F.col("shared") >= near_words))
    return kept.join(broadcast_if_small(passages.select("row", "item")), "row").select("id", F.col("item").alias("item_id"), "words", "shared")


def find_leaks(
    spark: SparkSession,
    docs: DataFrame,
    key: str,
    text: str,
    items: DataFrame,
    item: str,
    passage: str,
    **how,
) -> DataFrame:
    """Documents and the items whose passage they hold wholly or partly: (key, item_id, words, shared).

    Builds the index of all documents (``build_index``), searches it (``search``, which says what a match is and
    takes ``how``), and deletes it; to search for other items later, build and keep it.  Null texts and passages
    match nothing; passages shorter than ``min_words`` have only near matches, if they have ``near_words`` words.  A
    key or an item that occurs in several rows is answered for each row.
    """
    path = shared_dir(spark, "leaks")
    index = build_index(spark, docs, key, text, f"{path}/index")
    search(spark, index, items, item, passage, **how).write.parquet(f"{path}/found")
    SharedFiles(spark, path).delete("index")
    return spark.read.parquet(f"{path}/found").select(F.col("id").alias(key), "item_id", "words", "shared")
