"""MinHash near-deduplication with min-max hashing.

Every permutation of the shingle hashes yields two signature values, its minimum and its maximum, so half as many
hashes are evaluated for a signature length. Signatures are banded; documents that agree in a band are candidates,
and a link is confirmed on the full shingle sets.

Documents with equal sets form a class first and take part once. In each band's group all members are compared with
a leader, the member whose groups are largest over all bands, which in a family of copies is the least edited one.
Only documents of groups that are then in different components are left, and those meet by their rarest shingles alone:
shingles that one component has to itself come first, the others by how many of these documents hold them. Of two linked
sets the smaller has a common shingle among its first n - ceil(2 p n / (100 + p)) + 1, which the larger has among its
first n - ceil(p n / 100) + 1; so documents that share a template, but not enough of it to link, share none of those. In
the group of a shingle the largest component is met with the others only. So neither a large family of copies nor a
template costs a comparison of all its pairs, and no link is lost. Pairs are not compared if sizes or the places of the
shingle rule the link out, or if their signatures agree so little that a link would be 4.5 standard deviations off.

A document's set: distinct word shingles in lower case (A-Z); with fewer words than a shingle has, the whole sequence;
without a word, empty, and then it links with nothing. Rows without an id are left out; rows that repeat an id are one
node, which has the shingles of all their texts and is in the class of each. Ids are whole numbers (or text of such). An empty table gives no rows; texts are read whole, whatever their
length; other columns are not read. Results do not depend on partitioning.

What is not exact: a pair whose sets have a similarity of exactly ``percent`` shares no band with a probability of
(1 - t^4)^24 (2e-8 at 0.85, 3e-6 at 0.8), and its sketches fall below the limit with one of 3e-6; both fall fast above it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.text import Scratch, SliceHash, Texts, chunks, id_and_text, list_array, lower, mix

PERMUTATIONS = 48
ROWS = 4  # signature values in a band: 24 bands of 4; a pair at 0.8 is missed by all with probability 3e-6

_U = np.uint64
_rng = np.random.default_rng(6)
_FACTORS = _rng.integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64) * _U(2) + _U(1)
_ADDENDS = _rng.integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64)


def shingle_sets(batch: pa.RecordBatch, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Concatenated sorted distinct shingle hashes of each text, and their counts."""
    texts = Texts(batch.column(1))
    start, end, _ = texts.words()
    word = SliceHash(lower(texts.data))(start, end)
    first = np.searchsorted(start, texts.offsets)
    fold = lambda h, w: mix(h * _U(0x9E3779B97F4A7C15) + w)
    n = max(len(word) - words + 1, 0)
    shingle = np.full(n, words, np.uint64)
    for k in range(words):
        shingle = fold(shingle, word[k : k + n])
    sets = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= words:
            sets.append(np.unique(shingle[a : b - words + 1]))
        elif b > a:
            whole = np.full(1, b - a, np.uint64)
            for k in range(a, b):
                whole = fold(whole, word[k])
            sets.append(whole)
        else:
            sets.append(word[:0])
    return np.concatenate(sets) if sets else word[:0], np.array([len(s) for s in sets], np.int64)


def signatures(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, n long, key1 and key2 long (equal for equal sets), sketch array<int>: for each permutation the minimum
    and the maximum. Empty sets have a null sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            shingles, counts = shingle_sets(part, words)
            full = counts > 0
            at = (np.cumsum(counts) - counts)[full]
            keys = np.zeros((2, len(counts)), np.uint64)
            sketch = np.zeros((len(at), 2 * PERMUTATIONS), np.int32)
            if len(at):
                keys[0, full] = np.add.reduceat(mix(shingles), at)
                keys[1, full] = np.bitwise_xor.reduceat(mix(shingles + _U(1)), at)
                for k in range(PERMUTATIONS):
                    value = shingles * _FACTORS[k] + _ADDENDS[k]
                    sketch[:, 2 * k] = (np.minimum.reduceat(value, at) >> _U(32)).astype(np.uint32).view(np.int32)
                    sketch[:, 2 * k + 1] = (np.maximum.reduceat(value, at) >> _U(32)).astype(np.uint32).view(np.int32)
            lists = list_array(sketch.ravel(), full * 2 * PERMUTATIONS)
            lists = pa.ListArray.from_arrays(lists.offsets, lists.values, mask=pa.array(~full))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts), *(pa.array(k.view(np.int64)) for k in keys), lists], names=["doc_id", "n", "key1", "key2", "sketch"])

    return docs.mapInArrow(run, "doc_id long, n long, key1 long, key2 long, sketch array<int>")


def full_sets(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, shingles array<long>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            shingles, counts = shingle_sets(part, words)
            yield pa.RecordBatch.from_arrays([part.column(0), list_array(shingles.view(np.int64), counts)], names=["doc_id", "shingles"])

    return docs.mapInArrow(run, "doc_id long, shingles array<long>")


def _agree() -> F.Column:
    """In how many values the two sketches agree."""
    return F.aggregate(F.zip_with("sketch_a", "sketch_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda t, x: t + x)


def _close(percent: int) -> F.Column:
    """What sizes and sketches leave open."""
    t = percent / 100
    floor = t - 4.5 * (t * (1 - t) / (2 * PERMUTATIONS)) ** 0.5
    return (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")) & (_agree() >= floor * 2 * PERMUTATIONS)


def _sides(pairs: DataFrame, table: DataFrame, *columns: str) -> DataFrame:
    """Joins columns of table(rep, ...) to both ends of pairs(a, b)."""
    for side in ("b", "a"):
        pairs = pairs.join(table.select(F.col("rep").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in columns)), side)
    return pairs


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets have 100 * intersection >= percent * union."""
    found = _sides(pairs, sets, "shingles").withColumn("shared", F.size(F.array_intersect("shingles_a", "shingles_b")))
    return found.where(100 * F.col("shared") >= percent * (F.size("shingles_a") + F.size("shingles_b") - F.col("shared"))).select("a", "b")


def _still_open(members: DataFrame, labels: DataFrame) -> DataFrame:
    """rep, component of the members of groups that are in more than one component."""
    labelled = members.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    mixed = labelled.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    return labelled.join(mixed.select("band"), "band", "left_semi").select("rep", "component").distinct()


def _first_shingles(open_: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """shingle, rep, component, n, place, early of the first shingles of each open document that another component has;
    early ones are first enough for the smaller document of a pair, all are for the larger one."""
    held = open_.join(sets, "rep").select("rep", "component", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    spread = held.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("often"))
    several = spread.where("low <> high").select("shingle", "often")
    own = held.join(several, "shingle").groupBy("rep", "component", "n").agg(F.array_sort(F.collect_list(F.struct("often", "shingle"))).alias("own"))  # at most one set's size
    n, alone = F.col("n"), F.col("n") - F.size("own")
    probe = n - F.ceil(percent * n / 100) + 1
    index = n - F.ceil(2 * percent * n / (100 + percent)) + 1
    first = F.slice("own", F.lit(1), F.greatest(probe - alone, F.lit(0)).cast("int"))
    rows = own.select("rep", "component", "n", alone.alias("alone"), index.alias("index"), F.posexplode(first).alias("at", "own"))
    place = F.col("alone") + F.col("at")
    return scratch.cut(rows.select("own.shingle", "rep", "component", "n", place.alias("place"), (place < F.col("index")).alias("early")))


def _met(firsts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that meet in one of their first shingles and may link."""
    sizes = firsts.groupBy("shingle", "component").agg(F.count("*").alias("size"))
    largest = sizes.groupBy("shingle").agg(F.max_by("component", F.struct("size", -F.col("component"))).alias("largest"), F.count("*").alias("components")).where("components > 1")
    rows = firsts.join(largest.drop("components"), "shingle").withColumn("most", F.col("component") == F.col("largest")).drop("largest")
    x, y = (rows.select(*(F.col(c).alias(f"{c}_{side}") for c in rows.columns)) for side in ("x", "y"))
    order = F.struct("n_x", "rep_x") < F.struct("n_y", "rep_y")
    left = F.least(F.col("n_x") - F.col("place_x"), F.col("n_y") - F.col("place_y"))  # shingles that they may still share
    enough = (100 * F.col("n_x") >= percent * F.col("n_y")) & ((100 + percent) * left >= percent * (F.col("n_x") + F.col("n_y")))
    link = (F.col("shingle_x") == F.col("shingle_y")) & (F.col("component_x") != F.col("component_y")) & order & enough
    smaller = x.where("early_x")
    pairs = [smaller.where("not most_x").join(y, link), smaller.where("most_x").join(y.where("not most_y"), link)]
    ends = (F.least("rep_x", "rep_y").alias("a"), F.greatest("rep_x", "rep_y").alias("b"))
    return pairs[0].select(*ends).union(pairs[1].select(*ends)).distinct()


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles long, component_id (the smallest id that its links reach, itself included), kept boolean."""
    docs = id_and_text(docs, id_col, text_col).where("doc_id is not null").select(F.col("doc_id").cast("long"), "text")
    with Scratch(docs.sparkSession) as scratch:
        return scratch.result(_near_duplicates(docs, words, percent, scratch))


def _near_duplicates(docs: DataFrame, words: int, percent: int, scratch: Scratch) -> DataFrame:
    keys, cut = ["n", "key1", "key2"], scratch.cut
    signed = cut(signatures(docs, words))
    classes = cut(signed.where("n > 0").groupBy(*keys).agg(F.min_by("sketch", "doc_id").alias("sketch"), F.min("doc_id").alias("rep")))
    marks = cut(signed.select("doc_id", *keys).join(classes.select(*keys, "rep"), keys, "left").select("doc_id", "n", "rep"))
    scratch.drop(signed)
    bands = [F.xxhash64(F.lit(k), F.slice("sketch", k * ROWS + 1, ROWS)) for k in range(2 * PERMUTATIONS // ROWS)]
    members = classes.select("rep", F.explode(F.array(*bands)).alias("band"))
    groups = members.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    sized = cut(members.join(groups, "band"))
    fame = sized.groupBy("rep").agg(F.sum("size").alias("fame"))
    members = cut(sized.join(fame, "rep").select("band", "rep", "fame"))
    famous = cut(members.select("rep").distinct())
    marked = cut(classes.join(famous, "rep", "left_semi").select("rep", "n", "sketch"))
    scratch.drop(classes, sized)

    leaders = cut(members.groupBy("band").agg(F.max_by("rep", F.struct("fame", -F.col("rep"))).alias("leader")))
    stars = members.join(leaders, "band").where("rep <> leader").select(F.least("leader", "rep").alias("a"), F.greatest("leader", "rep").alias("b")).distinct()
    tested = cut(_sides(stars, marked, "n", "sketch").where(_close(percent)).select("a", "b"))
    sets = full_sets(docs.join(famous.toDF("doc_id"), "doc_id", "left_semi"), words)
    sets = cut(sets.groupBy(F.col("doc_id").alias("rep")).agg(F.array_distinct(F.flatten(F.collect_list("shingles"))).alias("shingles")))
    links = cut(_confirm(tested, sets, percent))
    labels = cut(components(links, scratch))

    open_ = cut(_still_open(members, labels))
    scratch.drop(members, leaders)
    if not open_.isEmpty():
        firsts = _first_shingles(open_, sets, percent, scratch)
        met = cut(_met(firsts, percent).join(tested, ["a", "b"], "left_anti"))
        scratch.drop(firsts, open_)
        rest = cut(_sides(met, marked, "n", "sketch").where(_close(percent)).select("a", "b").distinct())
        if not rest.isEmpty():
            labels = components(links.union(cut(_confirm(rest, sets, percent))), scratch)

    out = marks.join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
