"""Whitening, the Merkle manifest and token counts against brute force."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("tidemark.llm")
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import lang_id, merkle, near_dup, token_counts, whitening
from tidemark.llm.text import Scratch

H = lambda nodes: hashlib.sha256("".join(nodes).encode()).hexdigest()


def climb(nodes):
    """Root of a list of hashes, and each one's siblings level by level."""
    paths, at, place = [[] for _ in nodes], list(nodes), list(range(len(nodes)))
    while len(at) > 1:
        for k, i in enumerate(place):
            run = at[i - i % 3 : i - i % 3 + 3]
            paths[k].append((i % 3, run[: i % 3] + run[i % 3 + 1 :]))
            place[k] = i // 3
        at = [H(at[i : i + 3]) for i in range(0, len(at), 3)]
    return at[0], paths


@pytest.mark.parametrize("levels", [1, 2, 6])
def test_merkle(spark, levels):
    r = random.Random(levels)
    rows = [(k if k % 17 else None, r.choice(["a", "b", None, "é"]) if k < 150 else f"s{k}", None if k % 7 == 0 else f"line\n{k}" * (k % 5), k, "x") for k in range(200)]
    rows += [(5, "a", "again", 1, "x"), (5, "a", "again", 1, "x"), (5, "a", "other", 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, hash long, grp string")
    docs = docs.withColumn("leaf", merkle.digest("doc_id", "source", "text"))
    found = merkle.manifest(docs, "leaf", "source", "doc_id", levels=levels)
    proof, folded = merkle.proof_hash(F.col("witness")).alias("proof"), merkle.folded(F.col("leaf"), F.col("witness")).alias("folded")
    found = found.select("row.doc_id", "row.source", "leaf", "subroot", "root", "witness", proof, folded)
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    groups = {}
    for i, s, t, _, _ in rows:
        groups.setdefault(s, []).append((i if i is not None else -1, H([part(i), part(s), part(t)])))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([h for _, h in sorted(groups[s])]) for s in names}
    root, tops = climb([trees[s][0] for s in names])
    want = []
    for s, top in zip(names, tops):
        for (i, leaf), path in zip(sorted(groups[s]), trees[s][1]):
            want.append((i, s or "", leaf, trees[s][0], root, [(p, x) for p, x in path + top]))
    all_rows = found.collect()
    got = [(f.doc_id if f.doc_id is not None else -1, f.source or "", f.leaf, f.subroot, f.root, [(w.place, list(w.siblings)) for w in f.witness]) for f in all_rows]
    assert sorted(got) == sorted(want)
    assert all(f.folded == f.root for f in all_rows)
    assert {f.proof for f in all_rows} == {H([x for _, sibs in w[5] for x in sibs]) for w in want}


def test_merkle_small_tables(spark):
    docs = spark.createDataFrame([(1, "a", "text")], "doc_id long, source string, text string").withColumn("leaf", merkle.digest("doc_id", "text"))
    row = merkle.manifest(docs, "leaf", "source", "doc_id").first()
    assert row.leaf == row.subroot == row.root and row.witness == []
    assert merkle.manifest(docs.limit(0), "leaf", "source", "doc_id").count() == 0
    long = spark.createDataFrame([(1, "a", "é" * 3_000_000)], "doc_id long, source string, text string")
    assert long.select(merkle.digest("text")).first()[0] == H(["6000000:" + "é" * 3_000_000])


def test_tampered_leaf_does_not_verify(spark):
    docs = spark.range(50).withColumn("source", (F.col("id") % 3).cast("string")).withColumn("leaf", merkle.digest("id"))
    proofs = merkle.manifest(docs, "leaf", "source", "id")
    wrong = proofs.select((merkle.folded(F.sha2(F.lit("other"), 256), F.col("witness")) == F.col("root")).alias("ok"))
    assert wrong.where("ok").count() == 0


def exact_whitening(x, most):
    n = len(x)
    centred = (x - x.mean(0)).astype(float)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:most]
    return centred @ vectors[:, order] / np.sqrt(values[order]), values[order] / values.sum()


@pytest.mark.parametrize("spread", [0.3, 40.0, 3e9])
def test_whitening(spark, spread):
    rng = np.random.default_rng(3)
    c = (rng.normal(size=(700, 9)) @ rng.normal(size=(9, 9)) * spread).astype(np.float32)
    rows = [(k, [float(v) for v in row], "x") for k, row in enumerate(c)]
    bad = [(-1, None, "x"), (-2, [], "x"), (-3, [1.0] * 8 + [None], "x"), (-4, [math.nan] * 9, "x"), (-5, [1.0] * 8 + [math.inf], "x"), (-6, [1.0] * 4, "x"), (None, rows[0][1], "y")]
    table = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, v string").repartition(5)
    found = whitening.whiten(table, components=6).toPandas()
    x = np.floor(np.vstack([c, c[:1]]).astype(float) * 64).astype(np.int64) + 1_000_000
    want, explained = exact_whitening(x, 6)
    assert len(found) == 701 * 6 and set(found.vec_id.dropna()) == set(range(700)) and (found.n == 701).all()
    whitened = found[found.vec_id.notna()].pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    sign = np.sign((whitened * want[:700]).sum(0))
    assert np.allclose(whitened * sign, want[:700], atol=1e-6)
    assert np.allclose(found.groupby("component").explained.first(), explained, rtol=1e-6) and (found.identity_error < 1e-6).all() and found.identity_error.nunique() == 1
    sums = [sum(int(v) for v in x[:, d]) for d in range(9)]
    exact = [sum((701 * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x]
    got = whitening.squared_deviation(x, 701, sums)
    assert got == [v if v < 1 << 63 else None for v in exact]
    if spread < 1e9:
        assert dict(zip(found.vec_id, found.deviation))[3] == exact[3]


def test_product_sums_are_exact():
    rng = np.random.default_rng(4)
    for low, high in ((0, 1), (-5, 5), (-(1 << 40), 1 << 40), (-(1 << 62), 1 << 62)):
        x = rng.integers(low, high, (131, 3), endpoint=True)
        products, sums = whitening.product_sums(x)
        big = x.astype(object)
        assert (products == big.T @ big).all() and sums == big.sum(0).tolist()


def test_deviation_of_many_rows():
    """Counts beyond what one table here has: squares that need two limbs, and those that no long holds."""
    rng = np.random.default_rng(5)
    x = rng.integers(-40, 40, (50, 40)) + 1_000_000
    for n in (10**4, 3 * 10**6, 10**9, 10**13):
        sums = [n * 1_000_000 + int(k) for k in rng.integers(-n, n, 40)]
        exact = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x]
        assert whitening.squared_deviation(x, n, sums) == [v if v < 1 << 63 else None for v in exact]


def test_whitening_without_variance(spark):
    table = spark.createDataFrame([(k, [1.0, 2.0]) for k in range(5)], "vec_id long, embedding array<double>")
    assert whitening.whiten(table).count() == 0 and whitening.whiten(table.limit(0)).count() == 0
    flat = spark.createDataFrame([(k, [float(k), float(k), 0.0]) for k in range(9)], "vec_id long, embedding array<double>")
    found = whitening.whiten(flat).toPandas()
    assert len(found) == 9 and np.allclose(found.explained, 1) and np.isclose(found.whitened.std(ddof=0), 1)


@pytest.mark.parametrize("hot_bits", [0, 4, 20])
def test_token_counts(spark, hot_bits):
    r = random.Random(8)
    bits = ["'", "'s", "'re", "'ll", " ", "  ", "\n", "word", "rain", "s", "é", "1", "42", "²", "!", "#", " ", "　", "日本", "\x00", "<|endoftext|>", "e", "ve", "\U0001f600", "́", "Ᲊ", "Ɤ"]
    texts = [None, "", " ", "<|endoftext|>", "<|endoftext|><|endoftext|> a", "x" * 100_000, "word " * 300_000, "abc'" * 40_000] + ["".join(r.choice(bits) for _ in range(r.randint(0, 60))) for _ in range(600)]
    rows = [(k % 580 if k % 9 else None, t, 1) for k, t in enumerate(texts)]
    path = public_tokenizers.path("byte_bpe_50k.json")
    found = token_counts.count_tokens(spark.createDataFrame(rows, "doc_id long, text string, piece int").repartition(3), path, hot_bits=hot_bits)
    library = Tokenizer.from_file(path)
    want = sorted((-1 if i is None else i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False))) for i, t, _ in rows)
    assert sorted((-1 if f.doc_id is None else f.doc_id, f.n_bytes, f.n_tokens) for f in found.collect()) == want


def test_token_counts_of_nothing(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert token_counts.count_tokens(spark.createDataFrame([], "doc_id long, text string"), path).count() == 0
    with pytest.raises(ValueError):
        token_counts.Vocabulary(public_tokenizers.path("word_bpe_49k.json"))


def test_every_assigned_letter_and_sign_starts_as_the_library_says():
    vocabulary = token_counts.Vocabulary.at(public_tokenizers.path("byte_bpe_50k.json"))
    points = [c for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    texts = [f"a{chr(c)}1{chr(c)}!{chr(c)} {chr(c)}" for c in points]
    mine = np.bincount(token_counts.Pretokens(texts, vocabulary).row, minlength=len(texts))
    assert mine.tolist() == [len(vocabulary.tokenizer.pre_tokenizer.pre_tokenize_str(t)) for t in texts]


def near_by_hand(rows, size, percent):
    """Component of every id by comparing all pairs; rows of one id have the shingles of all their texts, and link with
    whatever has the shingles of one."""
    sets, each = {}, {}
    for i, text in rows:
        w = text.split()
        grams = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
        sets.setdefault(i, set()).update(grams)
        each.setdefault(i, set()).add(frozenset(grams))
    label = {i: i for i in sets}
    ids = sorted(sets)
    for x in ids:
        for y in ids:
            shared = len(sets[x] & sets[y])
            linked = 100 * shared >= percent * len(sets[x] | sets[y]) or each[x] & each[y]
            if x < y and shared and linked and label[x] != label[y]:
                low, high = sorted((label[x], label[y]))
                label = {k: low if v == high else v for k, v in label.items()}
    return label


@pytest.mark.parametrize("percent", [80, 85])
def test_templates_and_chains_near_the_threshold(spark, percent):
    """Texts that share most of a template, at similarities on both sides of the threshold, in families and alone."""
    r = random.Random(percent)
    rows = []
    for t in range(4):
        template = [f"t{t}w{k}" for k in range(120)]
        for k in range(70):
            text = list(template)
            for _ in range(r.choice([1, 2, 3, 4, 5, 6, 8])):
                text[r.randrange(120)] = f"x{r.randrange(10**6)}" if r.random() < 0.7 else f"y{r.randrange(6)}"
            rows.append((len(rows), " ".join(text[: r.choice([120, 120, 110, 100])])))
    rows += [(1000 + k, rows[k][1] + " tail") for k in range(12)] + [(5, "an id with another text of its own"), (2000, "an id with another text of its own")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = {f.doc_id: f.component_id for f in near_dup.near_duplicates(docs, 3, percent).collect()}
    assert found == near_by_hand(rows, 3, percent)


def test_a_template_below_the_threshold_makes_few_pairs(spark):
    """170 of 200 words in common, no link: the pairs that meet do not grow with the square of the texts."""
    r = random.Random(2)
    rows = [(k, " ".join(f"w{j}" if j % 20 > 2 else f"x{r.randrange(10**9)}" for j in range(200))) for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = near_dup.full_sets(docs, 3).toDF("rep", "shingles")
    with Scratch(spark) as scratch:
        firsts = near_dup._first_shingles(docs.select(F.col("doc_id").alias("rep"), F.col("doc_id").alias("component")), sets, 85, scratch)
        assert near_dup._met(firsts, 85).count() < 600
    assert near_dup.near_duplicates(docs, 3, 85).where("kept").count() == 600


def kneser_ney_by_hand(samples, text, order=4, discount=0.75):
    """Bits a character of a text under the samples' language, from the definition, and of how many characters."""
    def sequence(t):
        letters = "".join(x.lower() if x.isalpha() else " " for x in t)
        return " " * (order - 1) + " " + " ".join(letters.split()) + (" " if letters.split() else "")

    def grams(t, k):
        s = sequence(t)
        return [s[i - k + 1 : i + 1] for i in range(order, len(s))]

    counts = {order: Counter(g for t in samples for g in grams(t, order))}
    for k in range(1, order):
        counts[k] = Counter(g[1:] for g in {g[-(k + 1) :] for g in counts[order]})
    alphabet = len({g[-1] for g in ALPHABET}) + 1

    def p(g):
        if not g:
            return 1 / alphabet
        k = len(g)
        same = {x: n for x, n in counts[k].items() if x[:-1] == g[:-1]}
        total = sum(same.values())
        if not total:
            return p(g[1:])
        return max(same.get(g, 0) - discount, 0) / total + discount * len(same) / total * p(g[1:])

    found = grams(text, order)
    return sum(-math.log2(p(g)) for g in found) / len(found)


ALPHABET: set = set()


def test_language_entropies_equal_kneser_ney_by_hand(spark):
    rows = [("The rain in the plain, the river and the rain.", "a"), ("a plain rain", "a"), ("Der Regen und das Tal; der Fluss", "b"), ("über das Tal", "b")]
    texts = ["the river rain", "das Regental", "Über, the!", "zzz qq"]
    ALPHABET.update({x for t, _ in rows for x in t.lower() if x.isalpha()} | {" "})
    models = lang_id.fit(spark.createDataFrame(rows, "text string, lang string"), 100)
    bits, has = models.entropies(texts)
    assert has.all() and models.langs == ["a", "b"]
    for k, text in enumerate(texts):
        for j, lang in enumerate("ab"):
            assert bits[k, j] == pytest.approx(kneser_ney_by_hand([t for t, x in rows if x == lang], text), rel=1e-5)
