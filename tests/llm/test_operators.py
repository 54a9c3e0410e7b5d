"""The document operators against brute force, on small rows with the awkward cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

pytest.importorskip("tidemark.llm")
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontaminate, fertility, lang_id, licences, near_dup, passages, quality_rank, sharding, suffix_tree
from tidemark.llm.components import components
from tidemark.llm.text import Scratch

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bin int, ids string, row long, score double"


def corpus(seed=1, n=60):
    """Texts with copies, near copies, shared passages, odd characters, empty and null ones; extra columns that clash."""
    r = random.Random(seed)
    words = ["the", "of", "to", "Rain", "été", "größe", "river", "flood", "###", "a|b", "it's", "we'll", "中文", "x" * 70, "1234", "　", "don't"]
    make = lambda k: "".join(r.choice(words) + r.choice([" ", " ", "  ", "\n", "\t", " "]) for _ in range(k))
    passage = make(40)
    texts = [None, "", " ", "word", "two words", "a b c d"]
    while len(texts) < n:
        kind = r.random()
        if kind < 0.15 and len(texts) > 8:
            texts.append(r.choice(texts[6:]))
        elif kind < 0.35 and len(texts) > 8:
            t = list(r.choice(texts[6:]))
            if t:
                t[r.randrange(len(t))] = "Q"
            texts.append("".join(t))
        elif kind < 0.55:
            texts.append(make(20) + passage + make(15))
        else:
            texts.append(make(r.randint(1, 120)))
    texts.append("ab" * 4000)
    rows = [(i, t, "en" if i % 2 else None, "s", 1, 1, "x", 1, 0.5) for i, t in enumerate(texts)]
    return rows + [rows[10]]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def test_bpe_equals_tiktoken_and_round_trips(docs, rows, none):
    ranks = bpe.Vocabulary.at(VOCABULARY).ranks
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    text = {r[0]: r[1] or "" for r in rows}
    found = bpe.round_trip(docs, VOCABULARY).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.ids == encoding.encode_ordinary(text[r.doc_id])
        assert bytes(r.decoded).decode() == text[r.doc_id]
    apart = bpe.decode(bpe.encode(docs, VOCABULARY), VOCABULARY).collect()
    assert {(r.doc_id, bytes(r.decoded)) for r in apart} == {(i, t.encode()) for i, t in text.items()}
    assert bpe.round_trip(none, VOCABULARY).count() == 0


def test_bpe_boundaries_of_random_strings():
    vocab = bpe.Vocabulary.at(VOCABULARY)
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocab.ranks, special_tokens={})
    r = random.Random(3)
    pieces = list("abstrevldm'  '' \n\t\x0b\x1c\x85\xa0 ​09٣é漢!?_-#\U0001f600́Ⅷªㅏ") + ["'s", "'re", "'ll", "  ", "x" * 70, "\x00"]
    for _ in range(500):
        text = "".join(r.choice(pieces) for _ in range(r.randint(0, 40)))
        ids, counts = vocab.encode([text, "y"])
        assert ids[: counts[0]].tolist() == encoding.encode_ordinary(text)


def test_suffix_tree_base_is_exact_and_beaten(spark, none):
    r = random.Random(2)
    vocabulary = [f"w{k}" for k in range(300)]
    rows = []
    for i in range(400):
        text = []
        for _ in range(60):
            w = vocabulary[min(int(r.expovariate(0.03)), 299)]
            text += [w, w + "x"] if w in ("w1", "w2", "w3") else [w]  # a pair that a context predicts
        rows.append((i, " ".join(text)))
    rows += [(400, None), (401, ""), (None, "w1 w1x"), (5, rows[5][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = suffix_tree.score(docs, "crc32(cast(doc_id as string)) % 7 = 2").collect()
    assert len(found) == len(rows)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    tokens = lambda t: [w.translate(SMALL) for w in words(t)] + [None]
    counts = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    text, base, model = dict(rows), 0.0, 0.0
    for f in found:
        own = tokens(text[f.doc_id])
        want = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own)
        assert (f.n_tokens, f.n_known, f.train_tokens, f.held_out) == (len(own), sum(counts[w] > 0 for w in own), n, held(f.doc_id))
        assert f.base_score == pytest.approx(want, rel=1e-9)
        base, model = base + want * f.held_out, model + f.score * f.held_out
    assert model > 0.98 * base
    assert suffix_tree.score(none, "doc_id = 1").count() == 0


def test_decontamination_finds_edited_copies_only(spark, none):
    r = random.Random(4)
    vocabulary = [f"word{k}" for k in range(2000)]
    items = [(k, " ".join(r.choice(vocabulary) for _ in range(30))) for k in range(20)] + [(20, None), (21, ""), (22, "tiny item")]
    filler = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    rows, planted = [(0, None), (1, ""), (2, filler(300))], set()
    for k in range(20):
        copy = items[k][1].split()
        for _ in range(k % 5):
            copy[r.randrange(30)] = "edited"
        rows.append((10 + k, f"{filler(50)} {' '.join(copy).title()}! {filler(50)}"))
        planted.add((10 + k, k))
        rows.append((100 + k, filler(120)))
    rows.append((500, "see the Tiny item, here"))
    planted.add((500, 22))
    docs, benchmark = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contaminated(docs, benchmark).collect()
    assert {(f.doc_id, f.item_id) for f in found} == planted
    assert {f.score for f in found if f.item_id % 5 == 0} == {1.0}
    blocks = decontaminate.contaminated(docs, benchmark, block_bytes=400).collect()
    assert {(f.doc_id, f.item_id, f.score) for f in blocks} == {(f.doc_id, f.item_id, f.score) for f in found}
    assert decontaminate.contaminated(none, benchmark).count() == 0 and decontaminate.contaminated(docs, benchmark.limit(0)).count() == 0


def best_alignment(item, text):
    """Best local alignment: 1 for equal words, -1 for a replaced, added or missing one."""
    above, best = [0] * (len(text) + 1), 0
    for w in item:
        now = [0]
        for j, x in enumerate(text, 1):
            now.append(max(0, above[j - 1] + (1 if x == w else -1), above[j] - 1, now[j - 1] - 1))
        best, above = max(best, *now), now
    return best


def test_decontamination_equals_alignment_of_all_pairs(spark):
    r = random.Random(14)
    vocabulary = [f"v{k}" for k in range(60)]  # few words, so that pairs of them are everywhere
    items = [(k, [r.choice(vocabulary) for _ in range(r.choice([3, 4, 7, 12, 30]))]) for k in range(25)]
    items += [(25, [f"u{k}" for k in range(30)]), (26, [f"o{k % 4}" for k in range(20)])]
    texts = [items[25][1]] * 20  # exact copies make the surviving seeds the common ones
    texts += [[w if k % 6 != 2 else "new" for k, w in enumerate(items[25][1])], items[25][1][:16], items[25][1][:14]]
    texts += [[x for k, w in enumerate(items[25][1]) for x in ((w, "more") if k % 2 else (w,))]]  # no three neighbours
    for _ in range(150):
        copy, n = list(r.choice(items)[1]), r.randint(0, 14)
        for _ in range(n):
            at = r.randrange(len(copy) + 1)
            copy[at : at + r.choice([0, 1, 1])] = r.choice([[], ["new"], ["new"]])
        texts.append([r.choice(vocabulary) for _ in range(r.randint(0, 20))] + copy + [r.choice(vocabulary) for _ in range(r.randint(0, 20))])
    want = {(d, k): best_alignment(item, text) / len(item) for d, text in enumerate(texts) for k, item in items}
    want = {pair: score for pair, score in want.items() if score >= 0.5}
    assert {(20, 25), (21, 25), (23, 25)} <= set(want) and (22, 25) not in want
    docs = spark.createDataFrame([(d, " ".join(t)) for d, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    benchmark = spark.createDataFrame([(k, " ".join(t)) for k, t in items], "item_id long, text string")
    found = decontaminate.contaminated(docs, benchmark).collect()
    assert {(f.doc_id, f.item_id): f.score for f in found} == pytest.approx(want)
    assert decontaminate.contaminated(spark.createDataFrame([(1, "u0 u1 x y z")], "doc_id long, text string"), benchmark).count() == 0


def test_quality_ranking_separates_held_out_labels(spark, none):
    r = random.Random(5)
    good = lambda: " ".join("".join(r.choice("etaoinshr") for _ in range(r.randint(2, 8))) for _ in range(80))
    bad = lambda: " ".join("".join(r.choice("ETAOIN") for _ in range(5)) + r.choice(["###", "!!", "$$$"]) for _ in range(80))
    rows = [(i, good() if i % 4 else bad()) for i in range(400)] + [(400, None), (401, ""), (None, "x")]
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(400)] + [(402, None), (None, 1)], "doc_id long, quality int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    rule = "crc32(cast(doc_id as string)) % 4 = 2"
    found = quality_rank.rank(docs, labels, rule).collect()
    assert len(found) == len(rows) and all(0 <= f.score <= 1 and f.predicted == int(f.score >= 0.7) for f in found)
    held = [f for f in found if f.held_out and f.doc_id < 400]
    assert sum(f.predicted == int(f.doc_id % 4 > 0) for f in held) >= 0.95 * len(held)
    assert quality_rank.rank(docs, labels.limit(0), rule).count() == len(rows) and quality_rank.rank(none, labels, rule).count() == 0


def test_licences_are_found_and_inherited(spark):
    files = [
        (1, "a/LICENSE", "Released under the MIT License.\nmore words here"), (2, "a/b/x.txt", "plain text about rivers"), (3, "a/b/LICENSE", "Licensed under the Apache License, Version 2.0."),
        (4, "a/b/c/y.txt", None), (5, "z/q.txt", ""), (6, None, "nothing"), (7, "a/w.txt", "Header\nLicensed under CC BY-NC 4.0.\n"), (8, "a/b/x.txt", "plain text about rivers"),
    ]
    docs = spark.createDataFrame(files, "doc_id long, path string, text string")
    got = {r.doc_id: (r.own_licence, r.licence, r.licence_dir) for r in licences.scan(docs).collect()}
    assert got == {
        1: ("MIT", "MIT", None), 2: (None, "Apache-2.0", "a/b"), 3: ("Apache-2.0", "Apache-2.0", None), 4: (None, "Apache-2.0", "a/b"), 5: (None, None, None),
        6: (None, None, None), 7: ("CC-BY-NC-4.0", "CC-BY-NC-4.0", None), 8: (None, "Apache-2.0", "a/b"),
    }
    assert licences.scan(docs.limit(0)).count() == 0


def near_groups(rows, size, percent):
    def shingles(text):
        w = [x.translate(SMALL) for x in words(text)]
        return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())

    sets = [(i, shingles(t)) for i, t, *_ in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in sets:
        for j, b in sets:
            if j < i and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
def test_near_duplicates_equal_all_pairs(docs, rows, none, size, percent):
    want = near_groups(rows, size, percent)
    found = near_dup.near_duplicates(docs, size, percent).collect()
    assert len(found) == len(rows)
    for f in found:
        assert (f.n_shingles, f.component_id, f.kept) == (*want[f.doc_id], want[f.doc_id][1] == f.doc_id)
    assert near_dup.near_duplicates(none, size, percent).count() == 0


def test_near_duplicates_of_a_family_without_its_base(spark):
    r = random.Random(6)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for i in range(120):
        text = list(base)
        for _ in range(r.choice([1, 2, 3, 6, 9])):
            text[r.randrange(150)] = f"e{r.randrange(40)}"
        rows.append((i, " ".join(text)))
    want = near_groups(rows, 3, 85)
    found = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert {f.doc_id: (f.n_shingles, f.component_id) for f in found} == want


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)], "a long, b long")
    with Scratch(spark) as scratch:
        got = {r.node: r.component for r in components(edges, scratch).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_language_models_on_held_out_rows(spark, none):
    r = random.Random(7)
    parts = {"en": ["the", "ing", "tion", "er", "and", "wh"], "de": ["sch", "ung", "ein", "ß", "der", "ä"], "fr": ["eau", "que", "é", "ment", "les", "è"]}
    rows = [(i, " ".join("".join(r.choice(parts[lang]) for _ in range(3)) for _ in range(r.randint(5, 60))), lang) for i, lang in ((i, r.choice(list(parts))) for i in range(400))]
    rows += [(400, None, "en"), (401, "", "de"), (402, "123 !!", None), (403, "THE AND", None), (None, "eau que", "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    rule = "crc32(cast(doc_id as string)) % 4 = 2"
    found = {f.doc_id: f for f in lang_id.identify(docs, rule).collect()}
    held = [f for f in found.values() if f.held_out and f.doc_id < 400]
    assert len(held) > 50 and sum(f.lang_pred == rows[f.doc_id][2] for f in held) >= 0.97 * len(held)
    assert [found[k].lang_pred for k in (400, 401, 402)] == ["und"] * 3 and found[403].lang_pred == "en" and found[402].score == 0
    assert lang_id.identify(none.select("doc_id", "text", "lang"), rule).count() == 0


def test_fertility_base_columns_equal_brute_force(docs, rows, none):
    found = {f.doc_id: f for f in fertility.rules(docs, PIECES).collect()}
    for i, text, *_ in rows:
        w, f = words(text), found[i]
        seen, repeats = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)), set()
        for k in range(len(w) - 4):
            if seen[tuple(w[k : k + 5])] > 1:
                repeats |= set(range(k, k + 5))
        lines = [x for x in (text or "").split("\n") if words(x)]
        failed = len(w) < 10 or 100 * len(repeats) > 20 * len(w)
        assert (f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words, f.base_failed) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeats), failed)
        assert not (failed and f.kept)
    assert fertility.rules(none, PIECES).count() == 0


def test_fertility_bands_reject_junk_in_sparse_groups(spark):
    r = random.Random(8)
    plain = "the river rose over the old stone bridge and water came into houses near market while people carried chairs upstairs then rain stopped after noon".split()
    prose = lambda k: " ".join(r.choice(plain) + r.choice(["", "s", "ed", ",", "."]) for _ in range(k))
    junk = lambda k: " ".join("".join(chr(r.randrange(0xE000, 0xE100)) for _ in range(5)) for _ in range(k))
    rows = [(i, prose(r.randint(60, 200)), "en") for i in range(300)]
    rows += [(1000 + i, prose(r.randint(60, 200)), "xx") for i in range(8)]
    rows += [(2000, junk(100), "xx"), (2001, junk(100), "yy"), (2002, junk(100), None), (2003, junk(4000), "en")]
    few = [*rows[:9], (2000, junk(100), "xx")]  # a table smaller than any group
    few += [(3000 + i, " ".join(f"{w}{i}" for w in plain[:12]), "en") for i in range(3)] + [(2004, "\ue000 \ue001 \ue002 \ue003 \ue004 \ue005 \ue006 \ue007 \ue008 \ue009", "en")]  # short ones
    for table in (rows, few):
        found = {f.doc_id: f for f in fertility.rules(spark.createDataFrame(table, "doc_id long, text string, lang string"), PIECES).collect()}
        assert not any(f.base_failed for f in found.values())
        assert not any(f.kept for i, f in found.items() if 2000 <= i < 3000)
        assert sum(f.kept for i, f in found.items() if not 2000 <= i < 3000) >= 0.97 * sum(not 2000 <= i < 3000 for i in found)


def cut_by_hand(rows, length=50):
    first, out = {}, {}
    for i, text in sorted({(i, (t or "").encode()) for i, t, *_ in rows}):
        covered = bytearray(len(text))
        for p in range(len(text) - length + 1):
            if first.setdefault(text[p : p + length], i) < i:
                covered[p : p + length] = b"\1" * length
        spans = sum(1 for k in range(len(text)) if covered[k] and not (k and covered[k - 1]))
        out[i] = (len(text), sum(covered), spans, bytes(b for b, c in zip(text, covered) if not c))
    return out


def test_repeats_equal_brute_force(docs, rows, none):
    want = cut_by_hand(rows)
    found = passages.cut_repeats(docs, carry=("lang",)).collect()
    assert len(found) == len(rows) and sum(w[1] for w in want.values()) > 1000
    for f in found:
        assert (f.n_bytes, sum(s.end - s.start for s in f.spans), len(f.spans), bytes(f.kept)) == want[f.doc_id]
        assert f.carried == [rows[f.doc_id][2]]
    assert passages.cut_repeats(none).count() == 0


def test_sharding_is_even_stable_and_minimal(spark, docs, rows):
    names = [f"s{k}" for k in range(7)]
    table = sharding.fill(names, 1009)
    counts = Counter(table)
    assert max(counts.values()) - min(counts.values()) <= 1 and len(table) == 1009
    fewer = sharding.fill(names[:-1], 1009)
    moved = sum(1 for a, b in zip(table, fewer) if a != 6 and a != b)
    assert moved < 0.2 * 1009
    got = sharding.place(docs, "doc_id", names, 1009).collect()
    assert len(got) == len(rows)
    for g in got:
        slot = int(hashlib.md5(str(g.doc_id).encode()).hexdigest()[:15], 16) % 1009
        assert (g.slot, g.shard) == (slot, names[table[slot]])
    lone = sharding.place(spark.createDataFrame([(None,)], "doc_id long"), "doc_id", names, 1009).first()
    assert lone.slot == 0
    with pytest.raises(ValueError):
        sharding.fill(names, 1000)


def test_null_ids_do_not_crash(spark):
    docs = spark.createDataFrame([(None, "some text here " * 9, None), (1, "some text here " * 9, "en"), (2, None, None)], "doc_id long, text string, lang string")
    assert bpe.round_trip(docs, VOCABULARY).count() == 3 and fertility.rules(docs, PIECES).count() == 3
    assert near_dup.near_duplicates(docs).count() == 2 and passages.cut_repeats(docs).count() == 2
    assert sharding.place(docs, "doc_id", ["a", "b"], 101).where(F.col("shard").isNull()).count() == 0


@pytest.mark.parametrize("good", [90, 20])
def test_every_labelled_row_is_in_a_pair(spark, good):
    rows = [(int(k < good), [float(k), 0.0] if k < good else [0.0, -float(k)]) for k in range(110)]  # a pair's difference names both
    taught = spark.createDataFrame(rows, "label int, x array<float>")
    with Scratch(spark) as scratch:
        pairs = [tuple(r.d) for r in quality_rank.paired(taught, {1: good, 0: 110 - good}, scratch, chunk=7).collect()]
    counts = [Counter(p[k] for p in pairs) for k in (0, 1)]
    assert set(counts[0]) == set(map(float, range(good))) and set(counts[1]) == set(map(float, range(good, 110)))
    few, many = sorted(counts, key=len)
    assert set(many.values()) == {1} and max(few.values()) - min(few.values()) <= 1
