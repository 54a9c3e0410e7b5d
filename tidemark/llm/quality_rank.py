"""Quality classification by Bradley-Terry ranking.

Every text has surface features (shares of character kinds, word lengths, repetition, line structure), each also as a
logarithm, so small shares count, and the shares of its lower-case three-byte strings in ``GRAMS`` hash buckets, whose
weights are learnt only. Preference pairs set a good text against a bad one; a text's worth is linear in the
features and a pair's loss is log(1 + exp(-(worth of the better - worth of the worse))), minimised by Newton's method
on feature differences. Every labelled row is in a pair: rows of each label are numbered by a hash of their features, and
each one of the more frequent label meets the one of the other label whose number is its own modulo their count, so these
are used equally often. Spark adds up each step's slope and curvature over all pairs; their size does not depend on the
data. The threshold is an exact quantile of the labelled rows' worths: the share of bad labels. score =
1 / (1 + exp(-(worth - threshold) * steepness - logit(cut))), so a text at the threshold scores ``cut``.

Null texts are empty texts and are scored. Repeated labels count repeatedly; rows without a label teach nothing. If
either label is missing, the worth is 0 and the score ``cut``. Features are found once a text and kept as floats in a
table; numbers and pairs do not depend on the partitioning. An empty table gives no rows; texts are read whole, whatever
their length; repeated rows and null ids get rows of their own; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.text import Scratch, SliceHash, Texts, chunks, id_and_text, list_array, lower, mix, sums_by
from tidemark.operators.quantiles import exact_quantiles

# classes of bytes
_KINDS = {
    "upper": range(0x41, 0x5B), "digit": range(0x30, 0x3A), "symbol": [ord(c) for c in "#*$%&<>~^=+@\\_"], "bar": [ord("|")], "shout": [ord("!")],
    "stop": [ord(c) for c in ".,;:?"], "quote": [ord(c) for c in "\"'()[]{}/-"], "white": [0x20, 0x09, 0x0B, 0x0C, 0x0D], "line": [0x0A], "high": range(0x80, 0x100),
}
_CLASS = np.full(256, len(_KINDS), np.uint8)
for _i, _bytes in enumerate(_KINDS.values()):
    _CLASS[list(_bytes)] = _i
EPS = 1e-3
GRAMS = 128


def features(batch: pa.RecordBatch) -> np.ndarray:
    """One row of features a text."""
    texts = Texts(batch.column(1))
    n, size = texts.n, np.diff(texts.offsets).astype(float)
    owner = np.repeat(np.arange(n), size.astype(np.int64))
    shares = np.bincount(owner * (len(_KINDS) + 1) + _CLASS[texts.data], minlength=n * (len(_KINDS) + 1)).reshape(n, -1)[:, : len(_KINDS)] / np.maximum(size, 1)[:, None]
    start, end, row = texts.words()
    length = (end - start).astype(float)
    words = np.maximum(sums_by(row, n), 1).astype(float)
    h = SliceHash(lower(texts.data))(start, end)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    key = mix(h + mix(row.astype(np.uint64)))
    value, first, back, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    distinct = sums_by(row[first], n)
    odd = ~(((texts.data[end - 1] | 0x20) >= 0x61) & ((texts.data[end - 1] | 0x20) <= 0x7A) | (texts.data[end - 1] >= 0x80)) if len(end) else np.zeros(0, bool)
    pairs = mix(key[1:] ^ (key[:-1] << np.uint64(1))) if len(key) else key
    inner = np.flatnonzero(row[1:] == row[:-1]) if len(row) else np.zeros(0, np.int64)
    _, p_first, p_count = np.unique(pairs[inner], return_index=True, return_counts=True)
    p_distinct = sums_by(row[inner][p_first], n)
    top = np.zeros(n)
    np.maximum.at(top, row[first], count)
    shares = np.column_stack([
        shares, sums_by(row, n, same.astype(float)) / words, 1 - distinct / words, 1 - (p_distinct + 1) / words, top / words, sums_by(row, n, odd.astype(float)) / words,
        sums_by(row, n, (length > 20).astype(float)) / words, sums_by(row, n, (length < 3).astype(float)) / words,
    ])
    mean = sums_by(row, n, length) / words
    spread = np.sqrt(np.maximum(sums_by(row, n, length**2) / words - mean**2, 0))
    grams = np.zeros((n, GRAMS))
    if len(texts.data) > 2:
        small = lower(texts.data).astype(np.uint32)
        at = np.flatnonzero(owner[2:] == owner[:-2])
        bucket = ((small[at] | small[at + 1] << 8 | small[at + 2] << 16) * np.uint32(0x9E3779B1)) >> np.uint32(25)
        grams = np.bincount(owner[at] * GRAMS + bucket, minlength=n * GRAMS).reshape(n, GRAMS) / np.maximum(size - 2, 1)[:, None]
    return np.column_stack([np.sqrt(grams), shares, np.log(np.maximum(shares, 0) + EPS), np.log1p(size), np.log1p(size) ** 2, np.log(words), mean, np.log1p(mean), spread])


def _lists(values: np.ndarray) -> pa.ListArray:
    return list_array(values.astype(np.float32).ravel(), np.full(len(values), values.shape[1]))


def _rows(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    return np.asarray(column.flatten(), float).reshape(len(column), -1)


def _added(rows: DataFrame, column: str, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of ``part`` (an array whose length is fixed) over the rows' matrices: added up in tasks, then by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                total = part(_rows(batch.column(0))) + (0 if total is None else total)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["k", "v"])

    found = rows.select(column).mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).toPandas()
    return found.sort_values("k")["v"].to_numpy()


def paired(taught: DataFrame, sizes: dict[int, int], scratch: Scratch, chunk: int = 20_000) -> DataFrame:
    """d: the features of a good row less those of a bad one, for as many pairs as the more frequent label of
    taught(label, x) has rows. Rows are numbered by chunks of hashes, which begin after those before; equal rows are
    counted first, so a chunk does not grow with copies."""
    rows = taught.withColumn("h", F.xxhash64("x")).groupBy("label", "h", "x").agg(F.count("*").alias("copies"))
    rows = rows.withColumn("chunk", F.pmod("h", F.lit(1 + sum(sizes.values()) // chunk)))
    earlier = lambda n: F.coalesce(F.sum(n).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    by = Window.partitionBy("label").orderBy("chunk")
    offsets = rows.groupBy("label", "chunk").agg(F.sum("copies").alias("n")).select("label", "chunk", earlier("n").alias("before"))
    by = Window.partitionBy("label", "chunk").orderBy("h")
    first = rows.withColumn("own", earlier("copies")).join(offsets, ["label", "chunk"]).withColumn("first", F.col("own") + F.col("before"))
    numbered = scratch.cut(first.select("label", F.explode(F.sequence("first", F.col("first") + F.col("copies") - 1)).alias("number"), "x"))
    many, few = sorted(sizes, key=lambda k: (-sizes[k], k))
    sign = 1.0 if many == 1 else -1.0
    left = numbered.where(F.col("label") == many).select((F.col("number") % sizes[few]).alias("number"), "x")
    both = left.join(numbered.where(F.col("label") == few).select("number", F.col("x").alias("y")), "number").select("x", "y")

    def less(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([_lists(sign * (_rows(batch.column(0)) - _rows(batch.column(1))))], names=["d"])

    return scratch.cut(both.mapInArrow(less, "d array<float>"))


def fit(taught: DataFrame, sizes: dict[int, int], scratch: Scratch, ridge: float = 1e-3, steps: int = 25) -> np.ndarray:
    """Weights of the features, from all rows of taught(label, x)."""
    total, pairs = sum(sizes.values()), max(sizes.values())
    first, second = np.split(_added(taught, "x", lambda x: np.concatenate([x.sum(0), (x * x).sum(0)])) / total, 2)
    scale = np.sqrt(np.maximum(second - first**2, 0)) + 1e-9
    differences = paired(taught, sizes, scratch)
    size = len(scale)
    w = np.zeros(size)
    for _ in range(steps):

        def part(d: np.ndarray, w: np.ndarray = w) -> np.ndarray:
            d = d / scale
            p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
            return np.concatenate([d.T @ p, ((d * (p * (1 - p))[:, None]).T @ d).ravel()])

        found = _added(differences, "d", part) / pairs
        step = np.linalg.solve(found[size:].reshape(size, size) + ridge * np.eye(size), found[:size] - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w / scale


def rank(docs: DataFrame, labels: DataFrame, held_out: str, cut: float = 0.7, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """doc_id, held_out boolean, score double, predicted int, worth double."""
    docs = id_and_text(docs, id_col, text_col)
    labels = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).where(f"label in (0, 1) and not coalesce({held_out}, false)")
    with Scratch(docs.sparkSession) as scratch:
        return scratch.result(_rank(docs, labels, held_out, cut, scratch))


def _rank(docs: DataFrame, labels: DataFrame, held_out: str, cut: float, scratch: Scratch) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), _lists(features(part))], names=["doc_id", "x"])

    found = scratch.cut(docs.mapInArrow(learn, f"doc_id {kind}, x array<float>"))
    taught = scratch.cut(found.join(labels, "doc_id").select("label", "x"))
    sizes = {r[0]: r[1] for r in taught.groupBy("label").count().collect()}
    w, threshold = None, 0.0
    if len(sizes) == 2:
        w = fit(taught, sizes, scratch)
    lift = float(np.log(cut / (1 - cut)))

    def worths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            worth = np.zeros(part.num_rows) if w is None or not part.num_rows else _rows(part.column(1)) @ w
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(worth)], names=[part.schema.names[0], "worth"])

    if w is not None:
        bad = (sizes[0] - 1) / (sum(sizes.values()) - 1)
        threshold = exact_quantiles(taught.mapInArrow(worths, "label int, worth double"), [], "worth", {"t": bad}).first()[0]
    scored = found.mapInArrow(worths, f"doc_id {kind}, worth double").withColumn("worth", F.col("worth") - float(threshold))
    scored = scored.withColumn("score", 1 / (1 + F.exp(-F.greatest(F.least(F.col("worth") + lift, F.lit(500.0)), F.lit(-500.0)))))
    return scored.select("doc_id", F.coalesce(F.expr(held_out), F.lit(False)).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"), "worth")
