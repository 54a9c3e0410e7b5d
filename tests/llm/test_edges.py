"""Very long texts, ties, odd letters, partitioning and clashing columns, and brute-force versions of the measures."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("tidemark.llm")
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontaminate, fertility, lang_id, licence_texts, licences, near_dup, passages, quality_rank, sharding, suffix_tree
from test_operators import PIECES, SMALL, VOCABULARY, words

RULE = "crc32(cast(doc_id as string)) % 4 = 2"


def test_an_item_in_a_very_long_text(spark):
    item = [f"item{k}" for k in range(30)]
    long = [f"w{k % 977}" for k in range(40_000)] + item + [f"w{k % 991}" for k in range(32_000)]
    repeats = item * 1200  # windows that lie close together
    docs = spark.createDataFrame([(1, " ".join(long)), (2, " ".join(repeats)), (3, " ".join(long[:40_000]))], "doc_id long, text string")
    found = {f.doc_id: (f.score, f.end_word) for f in decontaminate.contaminated(docs, spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()}
    assert set(found) == {1, 2} and found[1] == (1.0, 40_029) and found[2][0] == 1.0
    huge = [f"h{k}" for k in range(9_000)]
    docs = spark.createDataFrame([(1, " ".join(["x"] * 500 + huge[:8_000] + ["x"] * 500))], "doc_id long, text string")
    row = decontaminate.contaminated(docs, spark.createDataFrame([(8, " ".join(huge))], "item_id long, text string")).first()
    assert row.score == pytest.approx(8_000 / 9_000)


def test_letters_beyond_the_first_plane_are_letters(spark):
    rows = [(i, "the river and the rain " * 5, "en") for i in range(20)] + [(100 + i, "".join(chr(0x10400 + (k * 7 + i) % 40) for k in range(60)), "xx") for i in range(20)]
    rows += [(200, "\U00020020" * 8, None), (201, "\U0001f600 123", None)]
    found = {f.doc_id: f for f in lang_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), RULE).collect()}
    assert found[200].lang_pred != "und" and found[201].lang_pred == "und" and found[201].score == 0
    assert all(found[100 + i].lang_pred == "xx" for i in range(20)) and all(found[i].lang_pred == "en" for i in range(20))


def test_language_models_sum_to_one(spark):
    rows = [("the rain in the plain", "a"), ("der regen und das tal", "b")]
    models = lang_id.fit(spark.createDataFrame(rows, "text string, lang string"), 100)
    alphabet = np.unique(models.keys[1])
    for context in models.keys[lang_id.ORDER][:20] >> np.uint64(16):
        p = models._look(lang_id.ORDER, (context << np.uint64(16)) | alphabet)
        rest = np.array([models._look(lang_id.ORDER, np.array([(context << np.uint64(16)) | np.uint64(0xE123)]))[:, 0]])  # any unseen letter
        assert np.allclose(p.sum(1) + rest[0], 1, atol=1e-6)


def test_ranking_does_not_depend_on_partitions(spark):
    r = random.Random(15)
    rows = [(i, " ".join(r.choice(["river", "rain", "###", "flood", "!!", "street"] if i % 3 else ["!!", "###", "zz"]) for _ in range(r.randint(5, 80)))) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)], "doc_id long, quality int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one, many = ({f.doc_id: f.score for f in quality_rank.rank(d, labels, RULE).collect()} for d in (docs.coalesce(1), docs.repartition(7, F.xxhash64("doc_id"))))
    assert one == pytest.approx(many, abs=1e-9)


def plain(text):
    out = []
    for w in re.split(r"[\x20\x09-\x0D]+", text):
        w = re.sub(r"^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+$", "", w).translate(SMALL)
        out += [w] if w else []
    return out


def cosine_by_hand(texts, templates):
    """The best cosine of any passage of each text with each template, from word counts."""
    vectors = {n: Counter(plain(t)) for n, t in templates.items()}
    known = set().union(*vectors.values())
    holders = Counter(w for t in texts for w in set(plain(t)) & known)
    idf = {w: math.log((len(texts) + 1) / (holders[w] + 1)) + 1 for w in known}
    other = max(idf.values())
    weigh = lambda counts: {w: n * idf.get(w, other) for w, n in counts.items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    out = []
    for t in texts:
        w, best = plain(t), (0.0, None)
        for name, counts in vectors.items():
            size, v = sum(counts.values()), weigh(counts)
            for a in range(max(1, len(w) - size + 1)):
                d = weigh(Counter(w[a : a + size]))
                if d:
                    best = max(best, (round(sum(x * v.get(k, 0) for k, x in d.items()) / norm(d) / norm(v), 9), name), key=lambda x: x[0])
        out.append(best)
    return out


def test_licence_cosines_equal_counting_by_hand(spark):
    r = random.Random(16)
    templates = {"A": "released to all under the alpha licence", "B": "this work may be copied by anyone for any purpose under beta terms now", "C": "beta"}
    templates = {n: " ".join((t + " and more words of law follow here" * 3).split()[:size]) for (n, t), size in zip(templates.items(), (7, 13, 30))}
    texts = ["", "alpha", templates["A"], "x y " + templates["B"] + " z"]
    for _ in range(60):
        base = list(r.choice(list(templates.values())).split())
        for _ in range(r.randint(0, 5)):
            base[r.randrange(len(base))] = r.choice(["river", "the", "under", "rain", "licence"])
        texts.append(" ".join([r.choice(["rain", "the", "flood", "all"]) for _ in range(r.randint(0, 12))] + base + ["tail"] * r.randint(0, 6)).replace(" ", r.choice([" ", "\n"]), 3))
    docs = spark.createDataFrame([(i, f"d/{i}", t) for i, t in enumerate(texts)], "doc_id long, path string, text string").repartition(3)
    found = {f.doc_id: f for f in licences.scan(docs, templates, least=0.7).collect()}
    sizes = {n: len(plain(t)) for n, t in templates.items()}
    assert len({sizes[n] * 10 // 11 for n in sizes}) == 3
    for i, (value, name) in enumerate(cosine_by_hand(texts, templates)):
        if value >= 0.7:
            assert found[i].cosine == pytest.approx(value, abs=1e-8) and found[i].own_licence == name
        else:
            assert found[i].own_licence is None and found[i].cosine == 0


def test_headers_and_licence_files_are_found(spark):
    r = random.Random(17)
    prose = lambda k: " ".join(r.choice(["river", "rain", "old", "bridge", "the", "of", "a", "flood"]) for _ in range(k))
    gpl = licence_texts.HEADERS["GPL-3.0/header"].replace("\n", " ")
    wrapped = "\n".join("# " + gpl[a : a + 60] for a in range(0, len(gpl), 60))
    rows = [
        (1, "p/LICENSE", "Copyright 2020 Somebody\n\n" + licence_texts.TEXTS["MIT/text"]),
        (2, "p/q/COPYING.txt", licence_texts.TEXTS["BSD-3-Clause/text"].replace("COPYRIGHT HOLDERS", "AUTHORS")),
        (3, "p/q/r/code.py", wrapped + "\n" + prose(300)),
        (4, "p/q/r/one-line.txt", prose(500) + " " + licence_texts.HEADERS["Apache-2.0/header"].replace("\n", " ") + " " + prose(500)),
        (5, "p/q/r/s/t/none.txt", prose(400)),
        (6, "p/other.txt", prose(50)),
        (7, "z/LICENSE.b", "Licensed under CC BY 4.0."), (8, "z/LICENSE.a", "Released under the MIT License."), (9, "z/y/x.txt", prose(20)),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, path string, text string").withColumns({c: F.lit(1) for c in ("folder", "near", "cosine", "licence")})
    got = {f.doc_id: (f.own_licence, f.licence, f.licence_dir) for f in licences.scan(docs).collect()}
    assert [got[k][0] for k in (1, 2, 3, 4, 5)] == ["MIT", "BSD-3-Clause", "GPL-3.0", "Apache-2.0", None]
    assert got[5][1:] == ("BSD-3-Clause", "p/q") and got[6][1:] == ("MIT", "p")
    assert got[9] == (None, "MIT", "z")  # two files of cosine 1: the smallest path


def test_fertility_measures_by_hand(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = ["The river rose over the old stone bridge  and 水 came", "a b", "", "x " * 50]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    for f in fertility.rules(docs, PIECES).collect():
        tokens = [i for w in words(texts[f.doc_id]) for i in model.encode(w)]
        counts, n = Counter(tokens), len(tokens)
        entropy = -sum(c / n * math.log2(c / n) for c in counts.values()) / math.log2(max(n, 2)) if n else 0.0
        assert f.n_tokens == n and f.token_entropy == pytest.approx(entropy)
        assert f.byte_share == pytest.approx(sum(model.is_byte(t) for t in tokens) / max(n, 1)) and f.chars_per_token == pytest.approx(sum(map(len, words(texts[f.doc_id]))) / max(n, 1))


def test_clashing_columns_nulls_and_empty_tables(spark):
    names = ["n", "h", "row", "c", "rep", "band", "label", "x", "slot", "shard", "score", "level", "copies", "run", "word", "component", "bin", "base", "model", "item_id"]
    docs = spark.createDataFrame([(1, "some text here " * 9, "en", "s"), (2, None, None, None), (None, "", "en", "s"), (2, None, None, None)], "doc_id long, text string, lang string, source string").withColumns({n: F.lit(3) for n in names})
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, None)], "doc_id long, quality int").withColumns({n: F.lit(3) for n in ("text", "x", "label")})
    items = spark.createDataFrame([(1, "some text here"), (2, None)], "item_id long, text string").withColumn("doc_id", F.lit(9))
    runs = {
        "bpe": lambda d: bpe.round_trip(d, VOCABULARY), "tree": lambda d: suffix_tree.score(d, "doc_id = 5"), "items": lambda d: decontaminate.contaminated(d, items), "rank": lambda d: quality_rank.rank(d, labels, RULE),
        "scan": lambda d: licences.scan(d.withColumn("path", F.lit("a/b"))), "near": lambda d: near_dup.near_duplicates(d), "lang": lambda d: lang_id.identify(d, RULE), "rules": lambda d: fertility.rules(d, PIECES),
        "cut": lambda d: passages.cut_repeats(d), "place": lambda d: sharding.place(d, "doc_id", ["a", "b"], 101),
    }
    counts = {n: f(docs).count() for n, f in runs.items()}
    assert counts == {n: 4 for n in runs} | {"near": 3, "cut": 3, "items": 1}
    assert all(f(docs.limit(0)).count() == 0 for f in runs.values())
    placed = sharding.place(docs.withColumn("slot", F.col("doc_id")), "slot", ["a", "b"], 101)
    assert placed.columns == ["slot", "slot_", "shard"] and placed.count() == 4


def test_very_long_texts(spark):
    long = " ".join(f"w{k % 5003}" for k in range(150_000))
    docs = spark.createDataFrame([(1, long, "en"), (2, long + " end", "en"), (3, "short text", "en")], "doc_id long, text string, lang string")
    assert {f.doc_id: f.component_id for f in near_dup.near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 3}
    assert suffix_tree.score(docs, "doc_id = 5").count() == 3 and lang_id.identify(docs, RULE).count() == 3 and fertility.rules(docs, PIECES).count() == 3
    cut = {f.doc_id: f for f in passages.cut_repeats(docs).collect()}
    assert bytes(cut[3].kept) == b"short text" and len(bytes(cut[2].kept)) <= 60
    assert quality_rank.rank(docs, spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int"), "doc_id = 9").count() == 3


def test_equal_names_of_different_strings_are_told_apart():
    data = np.frombuffer(b"abcabcabcab" b"abcabcabcax" b"abcabcabcab" b"abcabcabcay", np.uint8)
    at, name = np.array([0, 11, 22, 33, 0]), np.array([5, 5, 5, 7, 9], np.uint64)
    order, begin, run = passages._classes(name, data, at, 11)
    groups = {frozenset(order[run == k].tolist()) for k in range(len(begin))}
    assert groups == {frozenset({0, 2}), frozenset({1}), frozenset({3}), frozenset({4})}
    later = passages._later(name, np.array([1, 2, 3, 4, 5]), data, at, 11)
    assert later.tolist() == [False, False, True, False, False]


def test_removal_keeps_whole_characters(spark):
    shared = "é" * 40
    docs = spark.createDataFrame([(1, "a" + shared + "b"), (2, "xé" + shared + "éy�")], "doc_id long, text string")
    found = {f.doc_id: bytes(f.kept).decode() for f in passages.cut_repeats(docs, whole_characters=True).collect()}
    assert found[1] == "a" + shared + "b" and found[2] in ("xéy�", "xy�", "xééy�")


def test_placement_table_by_hand(spark):
    import hashlib

    number = lambda t: int(hashlib.md5(t.encode()).hexdigest()[:15], 16)
    names, slots = ["north", "east", "south", "west", "core"], 211
    wishes = [[(number(f"{n}/offset") + k * (number(f"{n}/step") % (slots - 1) + 1)) % slots for k in range(slots)] for n in names]
    assert all(len(set(w)) == slots for w in wishes)
    owner = {}
    while len(owner) < slots:
        for name, wish in zip(names, wishes):
            free = next((s for s in wish if s not in owner), None)
            if free is not None:
                owner[free] = name
    docs = spark.createDataFrame([(i,) for i in range(3000)], "doc_id long")
    for g in sharding.place(docs, "doc_id", names, slots).collect():
        slot = number(str(g.doc_id)) % slots
        assert (g.slot, g.shard) == (slot, owner[slot])
