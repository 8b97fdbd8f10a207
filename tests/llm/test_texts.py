import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from keystrata.llm import leak, packing, reading, tokens
from keystrata.llm.subtitles import UNKNOWN, cues, skeleton, spoken, tokens as text_tokens, word_key
from keystrata.sources.shared import shared_dir


def srt(lines, start=1):
    return "".join(f"{i}\n00:00:{i % 60:02d},000 --> 00:00:{i % 60:02d},900\n{x}\n\n" for i, x in enumerate(lines, start))


def test_spoken_text():
    text = srt(["<i>Hello</i> there.", "[dog barks", "- ANNA: We go ♪ la la ♪ home,\n63", "Subtitles by lineloft.example", "S u b s b y X1", "(CROWD\nGASPS) Yes {sigh} no."])
    assert spoken(text).split() == ["Hello", "there.", "We", "go", "home,", "63", "Yes", "no."]
    assert spoken(text.replace("\n", "\r\n")).split() == spoken(text).split()
    assert spoken("WEBVTT\n\n00:00.000-->00:01.000\nHi &amp; bye\n\n7\n00:02.000 --> 00:03.000\n").split() == ["Hi", "&", "bye"]
    assert cues("") == [] and cues("no times at all") == [] and spoken("1\n00:00 --> 00:01") == ""
    long = srt(["word " * 50] * 4000)
    assert len(spoken(long).split()) == 200_000


def test_skeleton_unites_what_is_confused():
    for a, b in [("of", "0f"), ("turns", "tums"), ("that", "tliat"), ("winter", "vvinter"), ("aus", "aii5"), ("dragó", "dragÃ³"), ("1534", "l534"), ("Oil", "OlL"), ("mossy.", "rnossy"), ("quartz", "quarfz")]:
        assert skeleton(a) == skeleton(b), (a, b)
    assert skeleton("Kazan") != skeleton("Vazan") and skeleton("à") == ""


def test_word_keys_in_all_scripts():
    russian = "Привет"
    assert word_key(russian.upper()) == word_key(russian.encode().decode("latin-1")) == "привет" != word_key("Привёт")
    assert word_key("für") == word_key("fьr") == word_key("fÃ¼r") == "tr"
    assert word_key("à") == word_key("а") == word_key("Ã©") == UNKNOWN and word_key("…") is None and word_key("東") == "東"
    assert text_tokens("東京 is 大") == ["東", "京", "is", "大"] and text_tokens("привет мир") == ["привет", "мир"]


@pytest.fixture(scope="module")
def encode():
    return tokens.encoding().encode_ordinary


def test_token_counts(spark, encode):
    texts = ["", "Hello world's  end\n\n", "é½ ①\t日本語", "<|endoftext|>", "x" * 50_000]
    df = spark.createDataFrame([*enumerate(texts), (9, None), (None, "a")], "doc_id bigint, text string").withColumn("n_tokens", F.lit("clash"))
    got = {r.doc_id: r.n_tokens for r in tokens.token_counts(df, "doc_id", "text").collect()}
    assert got == {i: len(encode(t)) for i, t in enumerate(texts)}


def check_packing(rows, sizes, capacities):
    for spec, capacity in capacities.items():
        own = [r for r in rows if r.spec_id == spec]
        used = {}
        pieces = {}
        for r in own:
            used[r.container_id] = used.get(r.container_id, 0) + r.size
            pieces.setdefault(r.doc_id, []).append((r.piece_no, r.start, r.size))
        assert max(used.values()) <= capacity
        assert set(pieces) == set(sizes)
        for doc, size in sizes.items():
            cut = sorted(pieces[doc])
            assert sum(p[2] for p in cut) == size and [p[1] for p in cut] == [i * capacity for i in range(len(cut))]
            assert len(cut) == max(1, -(-size // capacity))
        yield spec, sum(used.values()) / (len(used) * capacity)


def test_packing(spark):
    rng = random.Random(1)
    sizes = {i: int(rng.lognormvariate(5, 1.4)) for i in range(12_000)} | {5000: 0, 5001: 512, 5002: 513, 5003: 100_000}
    capacities = {1: 512, 2: 2048, 3: 8192}
    df = spark.createDataFrame([*sizes.items(), (None, 5), (6000, None), (6001, -1)], "doc_id bigint, n bigint")
    rows = packing.pack(df.withColumn("k", F.lit(1)).withColumn("size", F.lit(2)), "doc_id", "n", capacities).collect()
    fills = dict(check_packing(rows, sizes, capacities))
    assert all(f > 0.8 for f in fills.values()), fills
    rows = packing.pack(df, "doc_id", "n", capacities, worker_items=500).collect()
    dict(check_packing(rows, sizes, capacities))
    assert packing.pack(df.limit(0), "doc_id", "n", capacities).count() == 0
    same = {i: 300 for i in range(100)}
    rows = packing.pack(spark.createDataFrame([*same.items()], "doc_id bigint, n bigint"), "doc_id", "n", {1: 1000}).collect()
    assert dict(check_packing(rows, same, {1: 1000}))[1] == pytest.approx(100 * 300 / (34 * 1000))


PASSAGES = {
    1: "Once the pale blue flag of Kerin rises, 922 boats leave Bobel with felt on board and all the bells ring.",
    2: "In 1451 the weavers of Bosequil traded 687 bolts of cloth for 860 terns from Lumond, says the old register.",
    3: "Too short a passage.",
    4: None,
}


def brute_leaks(docs, passages, least):
    out = set()
    for d, text in docs:
        if text is None or d is None:
            continue
        sk = [skeleton(t) for t in spoken(text).split() if any(c.isalnum() for c in t)]
        for i, p in passages.items():
            w = leak.words(p)
            if any(sk[a : a + least] == w[b : b + least] for a in range(len(sk) - least + 1) for b in range(len(w) - least + 1)):
                out.add((d, i))
    return out


def test_leaks_against_brute_force(spark):
    rng = random.Random(4)
    filler = "the cat sold a cold map by the pond and the flag of boats on board with cloth for bells in the old sea".split()
    docs = []
    for d in range(120):
        words = [rng.choice(filler) for _ in range(60)]
        for _ in range(rng.randint(0, 2)):
            p = PASSAGES[rng.choice([1, 2])].split()
            n = rng.randint(8, len(p))
            at = rng.randint(0, len(p) - n)
            part = p[at : at + n]
            if rng.random() < 0.3:
                part = [x.replace("e", "c").replace("rn", "m").upper() if rng.random() < 0.2 else x.replace("o", "0") for x in part]
            words[30:30] = part
        lines = [" ".join(words[i : i + 6]) for i in range(0, len(words), 6)]
        if rng.random() < 0.5:
            lines.insert(6, "Sync & corrections by VOLTREX")
            lines.insert(7, "[door creaks]")
        docs.append((d, srt(lines)))
    docs += [(200, ""), (201, None), (None, "x"), (202, srt([PASSAGES[1]] * 3000)), (203, "no cues"), (204, PASSAGES[1])]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("terms", F.lit(1)).withColumn("id", F.lit("x"))
    items = spark.createDataFrame([*PASSAGES.items(), (None, "a b"), (2, "another text of item two")], "item_id bigint, passage string").withColumn("id", F.lit(0))
    for how in ({}, {"block_bytes": 60}):
        found = leak.find_leaks(spark, df, "doc_id", "text", items, "item_id", "passage", **how)
        got = {(r.doc_id, r.item_id) for r in found.collect() if r.words >= 12}
        assert got == brute_leaks(docs, PASSAGES, 12) and len(got) > 20


LONG = "The tall keeper of Kerin counted seventeen grey geese before breakfast while thunder rolled over empty harbour walls tonight"
RUSSIAN = "Старый хранитель маяка считал серых гусей до завтрака пока гром катился над пустыми стенами гавани и город спал"


def leaks(spark, docs, items, **how):
    df = spark.createDataFrame([*docs.items()], "doc_id bigint, text string")
    asked = spark.createDataFrame([*items.items()], "item_id bigint, passage string")
    found = leak.find_leaks(spark, df, "doc_id", "text", asked, "item_id", "passage", **how).collect()
    return {(r.doc_id, r.item_id): (r.words, r.shared) for r in found}


def halves(middle):
    w = LONG.split()
    return srt([" ".join(w[:5]), " ".join(w[5:9]), *middle, " ".join(w[9:14]), " ".join(w[14:])])


def test_leaks_in_other_scripts_with_damage_and_with_adverts(spark):
    w = RUSSIAN.split()
    unlisted = "Zorblat makes your kitchen shine"
    docs = {
        1: srt([" ".join(w[:8]), " ".join(w[8:])]), 2: srt([RUSSIAN.encode().decode("latin-1").replace("\x85", "")]), 3: srt([" ".join(w[:11])]),
        4: srt([LONG.replace("Kerin", "Xerin")]), 5: srt([LONG.replace("the", "tbe").replace("grey", "gray")]),
        6: halves(["Visit our shop for the best kites"]), 7: halves([unlisted]), 8: srt(["hello there", unlisted]),
        9: halves(["I never saw him again after that"]), 10: halves(["Buy kites", "Go home now"]),
        11: srt([LONG.replace("Kerin", "Bobel")]), 12: srt([LONG.replace("seventeen", "eighteen")]),
    }
    docs |= {20 + i: srt(["old Bobel sold eighteen maps in Bobel"]) for i in range(5)}
    got = leaks(spark, docs, {1: RUSSIAN, 2: LONG})
    exact = {k for k, (n, _) in got.items() if n >= 12}
    assert {(1, 1), (4, 2), (5, 2), (6, 2), (7, 2)} <= exact
    assert not exact & {(3, 1), (9, 2), (8, 2)} and got[11, 2][0] == len(LONG.split()) - 5
    assert got[4, 2][0] == len(LONG.split()) and got[6, 2][0] == got[7, 2][0] == len(LONG.split())
    assert (12, 2) in exact  # twelve words follow the one that differs


def test_near_matches_are_found(spark):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(rng.randint(2, 4))) for _ in range(1500)]
    items = {i: " ".join(rng.choice(vocabulary) for _ in range(30)) for i in range(40)}
    docs, planted = {}, set()
    for d in range(300):
        words = [rng.choice(vocabulary) for _ in range(80)]
        if d % 2 == 0:
            item = rng.randrange(40)
            at = rng.randint(0, 18)
            part = items[item].split()[at : at + 12]
            for _ in range(rng.randint(1, 2)):
                k = rng.randint(2, 9)
                how = rng.choice(["insert", "drop", "change"])
                part[k : k + (how != "insert")] = [] if how == "drop" else [rng.choice(vocabulary)]
            words[40:40] = part
            planted.add((d, item))
        docs[d] = srt([" ".join(words[i : i + 6]) for i in range(0, len(words), 6)])
    got = set(leaks(spark, docs, items))
    assert len(got & planted) >= 0.9 * len(planted)
    assert len(got - planted) <= 0.02 * len(docs)


def test_one_index_serves_several_searches(spark):
    docs = spark.createDataFrame([("a", srt([LONG] * 40)), ("b", srt([PASSAGES[1]])), ("b", srt([PASSAGES[1]])), ("c", "")], "doc_id string, text string")
    index = leak.build_index(spark, docs, "doc_id", "text", shared_dir(spark, "index"), flush_words=50)
    assert {r.documents for r in index.vocabulary.where("term = 'rlngs'").collect()} <= {2}
    for number, passage, docs_with in ((1, LONG, ["a"]), (2, PASSAGES[1], ["b", "b"])):
        found = leak.search(spark, index, spark.createDataFrame([(number, passage)], "item_id bigint, passage string"), "item_id", "passage")
        assert sorted(r.id for r in found.collect()) == docs_with


def test_pieces_of_pairs_change_nothing(spark, monkeypatch):
    docs = {d: srt([LONG, PASSAGES[1]] * (3 if d else 200)) for d in range(6)}
    items = {1: LONG, 2: PASSAGES[1], 3: LONG + " " + PASSAGES[1]}
    whole = leaks(spark, docs, items)
    searched = leak._Searched([np.array([0, 1, 2]), np.array([1, 2, 0])], [], 3, np.array([3.0, 2.0, 1.0]), np.zeros(0, np.int32), 12, 9)
    doc, at, code = np.repeat([0, 1, 2], 300), np.tile(np.arange(300), 3), np.tile([0, 1, 2], 300)
    everything = lambda: sorted(x for part in searched.hits(doc, at, code) for x in zip(*(c.tolist() for c in part)))
    one = everything()
    monkeypatch.setattr(leak, "PAIRS", 100)
    assert everything() == one and {x[:2] for x in one} == {(d, i) for d in range(3) for i in range(2)}
    assert len(whole) == 18


def test_leaks_empty(spark):
    docs, items = spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame([], "item_id bigint, passage string")
    assert leak.find_leaks(spark, docs, "doc_id", "text", items, "item_id", "passage").count() == 0
    some = spark.createDataFrame([(1, PASSAGES[1])], "item_id bigint, passage string")
    assert leak.find_leaks(spark, docs, "doc_id", "text", some, "item_id", "passage").count() == 0


def level_docs(n, seed):
    rng = random.Random(seed)
    easy, hard = "the cat dog sat ran map red hat bag bed".split(), "constitutional parliament methodology accountability jurisdiction approximately".split()
    out = []
    for d in range(n):
        level = d % 5 + 1
        words = []
        while len(words) < 80:
            sentence = [rng.choice(hard) if rng.random() < (level - 1) * 0.18 else rng.choice(easy) for _ in range(4 + 3 * level)]
            words += [*sentence[:-1], sentence[-1] + "."]
        out.append((d, srt([" ".join(words[i : i + 5]) for i in range(0, len(words), 5)]), level))
    return out


def test_reading_levels_on_held_out_documents(spark):
    rows = level_docs(300, 2)
    docs = spark.createDataFrame([r[:2] for r in rows] + [(900, "few words"), (901, None), (902, ""), (None, "x")], "doc_id bigint, text string").withColumn("level", F.lit(9)).withColumn("id", F.lit(9))
    labels = [(d, level) for d, _, level in rows[:150]] + [(3, None), (None, 2), (4, 17), (5000, 1)]
    marked = spark.createDataFrame(labels, "doc_id bigint, reading_level int")
    found = reading.reading_levels(spark, docs, "doc_id", "text", marked, "doc_id", "reading_level").collect()
    got = {r.doc_id: r.reading_level for r in found}
    assert len(found) == len(got) == 300
    assert sum(got[d] == level for d, _, level in rows[150:]) >= 0.9 * 150
    none = reading.reading_levels(spark, docs, "doc_id", "text", marked.limit(0), "doc_id", "reading_level").collect()
    assert {r.reading_level for r in none} == {3}
    assert reading.reading_levels(spark, docs.limit(0), "doc_id", "text", marked, "doc_id", "reading_level").count() == 0


def test_familiar_words_are_those_of_many_documents(spark):
    texts = [(i, srt(["the cat sat " * 12 + ("rare" if i == 0 else "mat")]), "en") for i in range(30)]
    docs = spark.createDataFrame(texts, "id bigint, text string, label string")
    lists, count = reading.familiar_words(spark, reading.document_frequencies(docs), (0.01, 0.5, 0.97))
    assert count == 1 and lists[skeleton("the")] == [3] and lists[skeleton("mat")] == [2] and lists[skeleton("rare")] == [1]


def test_languages_are_told_by_their_words(spark):
    rng, texts = random.Random(3), []
    own = {"a": ["lo", "mi", "ra", "tu", "so", "ne"], "b": ["der", "und", "ist", "ein", "das", "wir"], "ж": ["мир", "дом", "лес", "кот", "снег", "путь"]}
    for i in range(480):
        language = "abж"[i % 3]
        label = rng.choice([language, language, language.upper() + "-x", None] if i % 10 else ["a"])
        words = [rng.choice(own[language]) for _ in range(40)]
        texts.append((i, srt([" ".join(words[k : k + 8]) + "." for k in range(0, 40, 8)]), (label or "").lower()))
    docs = spark.createDataFrame(texts, "id bigint, text string, label string")
    frequencies = reading.document_frequencies(docs)
    groups = reading.languages(frequencies)
    assert groups["a"] == groups["a-x"] != groups["b"] == groups["b-x"] != groups["ж"] == groups["ж-x"]
    shares = (0.05, 0.3, 0.5)
    familiar, count = reading.familiar_words(spark, frequencies, shares)
    odd = spark.createDataFrame([(999, srt(["qqq www eee rrr zzz " * 8]), "a")], docs.schema)
    found = {r.id: r for r in reading.features(docs.union(odd), familiar, count, shares, "bigint").collect()}
    for i in range(480):
        assert found[i].language == groups["abж"[i % 3]] and found[i].u1 == 0 and found[i].sentence is not None
    assert found[999].language == -1 and found[999].u0 == 1 and found[999].sentence is None
