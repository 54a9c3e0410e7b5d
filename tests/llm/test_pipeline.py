"""The pipeline's stages against brute-force versions of their rules."""

import pytest

pytest.importorskip("corpus_pipeline")
import corpus_pipeline as P

from test_operators import corpus, cut_by_hand, near_groups, words


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pipeline"))
    rows = [(*r[:4], len(r[1] or "")) for r in corpus(9, 120)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    item = " ".join(next(r[1] for r in rows if len(words(r[1])) > 60).split()[5:40])
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def aligned(item, text):
    """Best local alignment: 1 for equal words, -1 for a replaced, added or missing one."""
    above, best = [0] * (len(text) + 1), 0
    for w in item:
        now = [0]
        for j, x in enumerate(text, 1):
            now.append(max(0, above[j - 1] + (1 if x == w else -1), above[j] - 1, now[j - 1] - 1))
        best, above = max(best, *now), now
    return best


def test_each_stage_on_its_input(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for k, (name, stage) in enumerate(P.STAGES):
        before = docs.collect()
        stage(spark, docs, folder).write.parquet(f"{folder}/stage-{k}")
        docs = spark.read.parquet(f"{folder}/stage-{k}")
        after = {r.doc_id: r for r in docs.collect()}
        if k < len(P.STAGES) - 1:
            assert tuple(docs.columns) == P.COLUMNS
        if name == "quality rules":
            assert all(len(words(r.text)) >= 10 for r in after.values()) and len(after) < len(before)
        elif name == "MinHash near-dedup":
            groups = near_groups([(r.doc_id, r.text) for r in before], 5, 80)
            assert set(after) == {i for i, (_, root) in groups.items() if i == root}
        elif name == "suffix-array dedup":
            for i, (_, _, _, kept) in cut_by_hand([(r.doc_id, r.text) for r in before]).items():
                rest = kept.decode("utf-8", "ignore")
                assert (after[i].text == rest and after[i].n_chars == len(rest)) if words(rest) else i not in after
        elif name == "benchmark decontamination":
            item = [w.lower() for w in spark.read.parquet(f"{folder}/benchmark.parquet").first().text.split()]
            gone = {r.doc_id: r.text for r in before if r.doc_id not in after}
            assert set(after) <= {r.doc_id for r in before} and all(aligned(item, t.lower().split()) >= 0.4 * len(item) for t in gone.values())
        else:
            assert set(after) == {r.doc_id for r in before} and all(r.n_tokens == len(r.ids) for r in after.values())


def test_run_chains_the_stages(spark, folder):
    got = {r.doc_id for r in P.run(spark, folder).collect()}
    assert got == {r.doc_id for r in spark.read.parquet(f"{folder}/stage-4").collect()}


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_empty_and_odd_tables(spark, tmp_path):
    spark.createDataFrame([(1, "some test item of eight words in all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.read.parquet(f"{tmp_path}/benchmark.parquet").limit(0).coalesce(1).write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert P.run(spark, f"{tmp_path}/none").count() == 0
    good = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(None, good, "en", "s", 1), (None, "bad", "en", "s", 1), (None, None, None, None, None), (1, good, "en", "s", 1), (1, good, "en", "s", 1), (2, None, None, None, None), (3, "", "en", "s", 0), (4, "short", None, "s", 5)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    first = P.STAGES[0][1](spark, docs, str(tmp_path)).collect()
    assert sorted((r.doc_id is None, r.text) for r in first) == [(False, good), (False, good), (True, good)]
    assert {r.doc_id for r in P.run(spark, str(tmp_path)).collect()} == {1}
