"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

The alignment gives 1 for equal words and takes 1 for a replaced, added or missing word; the score is the best
alignment's sum divided by the item's number of words. Seeds are pairs of neighbouring words of the test items, and the
bound that prunes by them is exact. An item of m words reaches ``least`` with a sum of L = ceil(least * m) or more: with
E edits at least L + E words match, in at most E + 1 runs, so at least L - 1 of its m - 1 pairs stand unbroken in the
document, and at most m - L do not. (Longer seeds have no such bound: a word added after every second word leaves no
three neighbours.) So of any m - L + k pairs of the item, k are in the document, within 2 m - L words.

The documents that hold each pair are counted over the whole corpus, and an item keeps its rarest m - L + ``SPARE``
pairs, so that common phrases propose little; pairs that no document holds count among them. Where k kept pairs are as
close as that, the words around are aligned.

Items are taken in blocks of at most ``block_bytes`` of text; each block's seed table is bounded by that and is
broadcast, and all documents are searched for every block, so test sets of any size work. Words are compared in lower
case (A-Z) without leading and trailing punctuation. Items of one or two words have to occur whole (one word of two
would reach 0.5 by itself); longer items that one word can bring to ``least`` have single words as seeds. Items and
texts without words, null ones included, match nothing. Rows with equal ids are searched row by row. Item ids are whole
numbers (or text of such); document ids are of any kind and may be null. An empty table on either side finds nothing.
Texts and items are read whole, whatever their length; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import SliceHash, Texts, chunks, id_and_text, lower, mix, sums_by

SPARE = 3
HITS = 4_000_000
_PLAIN = np.ones(256, bool)
_PLAIN[[c for c in range(0x21, 0x7F) if not chr(c).isalnum()]] = False


def plain_words(batch: pa.RecordBatch, text: int = 1) -> tuple[np.ndarray, np.ndarray, int]:
    """Hash and text number of every word; punctuation around a word does not count, words of nothing else are left out."""
    texts = Texts(batch.column(text))
    start, end, row = texts.words()
    if not len(start):
        return np.zeros(0, np.uint64), row, texts.n
    at = np.flatnonzero(_PLAIN[texts.data])
    first, last = np.searchsorted(at, start), np.searchsorted(at, end) - 1
    good = last >= first
    start, end = at[first[good]], at[last[good]] + 1
    return SliceHash(lower(texts.data))(start, end), row[good], texts.n


def _grams(h: np.ndarray, row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of every n-gram within a text."""
    out = np.full(max(len(h) - size + 1, 0), size, np.uint64)
    for k in range(size):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(out)])
    at = np.flatnonzero(row[size - 1 :] == row[: len(out)]) if len(out) else np.zeros(0, np.int64)
    return out[at], at


class Items:
    """A block of test items: word hashes, and a sorted table of seeds with the items that hold them and how often."""

    def __init__(self, ids: list[int], texts: list[str | None], least: float):
        batch = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([t or "" for t in texts], pa.string())], names=["i", "t"])
        self.ids = np.array(ids, np.int64)
        self.words, row, n = plain_words(batch)
        self.count = sums_by(row, n)
        self.first = np.cumsum(self.count) - self.count
        sums = np.ceil(least * self.count - 1e-9).astype(np.int64)
        self.lost = np.where(self.count > 2, np.maximum(self.count - np.maximum(sums, 1), 0), 0)  # seeds that edits may break
        self.span = self.count + self.lost
        length = np.where(self.count > 2, np.where(sums > 1, 2, 1), self.count)
        parts, self.sizes = [], []
        for k in (1, 2):
            seed, at = _grams(self.words, row, k)
            item = row[at] if len(at) else at
            mine = length[item] == k
            if mine.any():
                self.sizes.append(k)
                parts.append(pd.DataFrame({"seed": seed[mine], "item": item[mine]}))
        table = pd.concat(parts) if parts else pd.DataFrame({"seed": np.zeros(0, np.uint64), "item": np.zeros(0, np.int64)})
        self._set(table.groupby(["seed", "item"]).size().rename("times").reset_index())

    def _set(self, table: pd.DataFrame) -> None:
        self.table = table
        self.seeds, self.start = np.unique(table["seed"].to_numpy(np.uint64), return_index=True)
        self.stop = np.append(self.start[1:], len(table)).astype(np.int64)
        self.holders = table["item"].to_numpy(np.int64)
        held = sums_by(self.holders, len(self.ids), table["times"].to_numpy(float)).astype(np.int64)
        self.need = np.maximum(held - self.lost, 1)

    def keep_rare(self, documents: np.ndarray) -> None:
        """Keeps every item's rarest seeds, by the number of documents of each seed and ties in hash order: as many as
        edits may break, and ``SPARE`` more."""
        table = self.table.assign(n=np.repeat(documents, self.stop - self.start)).sort_values(["item", "n", "seed"])
        before = table.groupby("item")["times"].cumsum() - table["times"]
        self._set(table[before < self.lost[table["item"]] + SPARE].drop(columns="n").sort_values(["seed", "item"]).reset_index(drop=True))

    def proposals(self, number: np.ndarray, at: np.ndarray, row: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Items and places of their seeds, from hits, as far as enough are close together; a few million at a time."""
        total = int((self.stop - self.start)[number].sum())
        n = len(self.ids)
        key = np.repeat(np.arange(len(self.seeds)), self.stop - self.start) * n + self.holders
        cuts = np.linspace(0, n, min(n, 1 + total // HITS) + 1).astype(np.int64)
        for a, b in zip(cuts[:-1], cuts[1:]):
            first = np.searchsorted(key, np.arange(len(self.seeds)) * n + a)
            times = (np.searchsorted(key, np.arange(len(self.seeds)) * n + b) - first)[number]
            item = self.holders[np.repeat(first[number], times) + np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)]
            place = np.repeat(at, times)
            order = np.lexsort((place, item))
            item, place = item[order], place[order]
            last = np.arange(len(item)) + self.need[item] - 1
            here = np.flatnonzero(last < len(item))
            last = last[here]
            near = (item[last] == item[here]) & (row[place[last]] == row[place[here]]) & (place[last] - place[here] < self.span[item[here]])
            here, last = here[near], last[near]
            cover = np.bincount(here, minlength=len(item) + 1) - np.bincount(last + 1, minlength=len(item) + 1)
            close = np.cumsum(cover)[:-1] > 0
            if close.any():
                yield item[close], place[close]

    def hits(self, h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of seeds found and the places of their first words."""
        found = [_grams(h, row, k) for k in self.sizes]
        gram, at = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in (0, 1))
        if not len(self.seeds) or not len(gram):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        found = np.minimum(np.searchsorted(self.seeds, gram), len(self.seeds) - 1)
        hit = self.seeds[found] == gram
        return found[hit], at[hit]


def smith_waterman(item: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment sum of an item with each row of windows (0: no word), and where in the window it ends."""
    n, width = windows.shape
    place = np.arange(width, dtype=np.int32)
    above, best, end = np.zeros((n, width), np.int32), np.zeros(n, np.int32), np.zeros(n, np.int64)
    for word in item:
        diagonal = np.zeros((n, width), np.int32)
        diagonal[:, 1:] = above[:, :-1]
        cell = np.maximum(np.maximum(diagonal + np.where(windows == word, np.int32(1), np.int32(-1)), above - 1), 0)
        above = np.maximum.accumulate(cell + place, axis=1) - place  # words added in the window
        at = above.argmax(1)
        top = above[np.arange(n), at]
        better = top > best
        best, end = np.where(better, top, best), np.where(better, at, end)
    return best, end


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = 0.5, block_bytes: int = 16 << 20, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, score double, end_word long (the last aligned word's number in the document): one row for a
    document and an item whose score reaches ``least``."""
    docs, spark = id_and_text(docs, id_col, text_col), docs.sparkSession
    items = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_bytes))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id long, score double, end_word long"
    found = spark.createDataFrame([], schema)
    for b in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").toPandas()
        block = Items(mine["item_id"].tolist(), mine["text"].tolist(), least)
        found = found.union(_search(docs, block, least, schema))
    return found


def _search(docs: DataFrame, block: Items, least: float, schema: str) -> DataFrame:
    sc = docs.sparkSession.sparkContext
    every = sc.broadcast(block)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = every.value
        seen = np.zeros(len(items.seeds), np.int64)
        for part in chunks(batches):
            h, row, n = plain_words(part)
            number, at = items.hits(h, row)
            pair = np.unique(number * (n + 1) + row[at])
            seen += np.bincount(pair // (n + 1), minlength=len(seen))
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[some])], names=["number", "n"])

    counts = docs.mapInArrow(count, "number long, n long").groupBy("number").agg(F.sum("n").alias("n")).toPandas()
    documents = np.zeros(len(block.seeds), np.int64)
    documents[counts["number"].to_numpy(np.int64)] = counts["n"].to_numpy(np.int64)
    block.keep_rare(documents)
    rare = sc.broadcast(block)

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = rare.value
        for part in chunks(batches):
            h, row, n = plain_words(part)
            number, at = items.hits(h, row)
            if not len(at):
                continue
            out: list[list] = [[], [], [], []]
            for item, at in items.proposals(number, at, row):
                reach = 2 * items.count[item]
                text_first = np.searchsorted(row, row[at])
                text_last = np.searchsorted(row, row[at], side="right")
                low, high = np.maximum(at - reach, text_first), np.minimum(at + reach, text_last)
                new = np.ones(len(at), bool)  # places of one item and text within reach of each other share a window
                new[1:] = (item[1:] != item[:-1]) | (row[at[1:]] != row[at[:-1]]) | (at[1:] - at[:-1] > reach[1:])
                cut = np.flatnonzero(new)
                low, high, item = low[cut], high[np.append(cut[1:], len(at)) - 1], item[cut]
                base = text_first[cut]
                for k in np.unique(item).tolist():
                    mine = np.flatnonzero(item == k)
                    mine = mine[np.argsort((high - low)[mine], kind="stable")]
                    size = int(items.count[k])
                    while len(mine):  # windows of like width together, at most a few million cells at once
                        width = int(high[mine[0]] - low[mine[0]])
                        fit = (high - low)[mine] <= max(2 * width, 64)
                        now = mine[fit][: max(1, 2_000_000 // max(2 * width, 64))]
                        mine = mine[len(now) :]
                        widest = int((high - low)[now].max())
                        window = np.zeros((len(now), widest), np.uint64)
                        columns = low[now][:, None] + np.arange(widest)
                        inside = columns < high[now][:, None]
                        window[inside] = h[columns[inside]]
                        best, end = smith_waterman(items.words[items.first[k] : items.first[k] + size], window)
                        good = np.flatnonzero(best >= least * size)
                        out[0] += row[low[now[good]]].tolist()
                        out[1] += [int(items.ids[k])] * len(good)
                        out[2] += (best[good] / size).tolist()
                        out[3] += (low[now[good]] + end[good] - base[now[good]]).tolist()
            if out[0]:
                rows = pd.DataFrame(dict(zip(("row", "item_id", "score", "end_word"), out))).sort_values(["row", "item_id", "score", "end_word"], ascending=[True, True, False, True])
                rows = rows.drop_duplicates(["row", "item_id"])
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows["row"].to_numpy())), pa.array(rows["item_id"].to_numpy(np.int64)), pa.array(rows["score"].to_numpy(float)), pa.array(rows["end_word"].to_numpy(np.int64))], names=["doc_id", "item_id", "score", "end_word"])

    return docs.mapInArrow(align, schema)
