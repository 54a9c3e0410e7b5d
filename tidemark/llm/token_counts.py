"""Token counts of texts without their ids.

A byte-level vocabulary cuts a text into pre-tokens and each of them into pieces by itself, so a text's count is the sum
of its pre-tokens' counts. The first pass counts every distinct pre-token over all texts in Spark; the library then says
once for each of them how many pieces it has. The second pass takes each text's pre-token frequencies. Pre-tokens that
make up at least one in ``2 ** HOT_BITS`` of all occurrences are at most that many, whatever the corpus: their counts are
broadcast as sorted hash arrays and summed where the text is read. The frequencies of all others, none of which is a hot
key, are joined with their counts and summed for each text.

Special strings of the vocabulary are cut out first and are one token each. Null texts are empty and have no tokens.
Rows are counted one by one: ids may be null or repeated. Texts are read whole; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import json
import os
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bpe import BREAK, LAST_SPACE, LAST_WHITE, LETTER, NUMBER, OTHER, WHITE, code_point_classes
from tidemark.llm.text import Scratch, SliceHash, chunks, cut, id_and_text, list_array, mix

HOT_BITS = 20
_BEGINS = np.ones(81, bool)  # by class before and class: letters, numbers and others go on or join a space, white space goes on
for _kind in (LETTER, NUMBER, OTHER):
    _BEGINS[[_kind * 9 + _kind, LAST_SPACE * 9 + _kind]] = False
_BEGINS[WHITE * 9 + WHITE] = False
_HELD = 1 << 20  # pre-tokens that a task holds before it hands them on
_loaded: dict = {}


class Vocabulary:
    """A byte-level vocabulary file of the tokenizers library, read once per Python worker."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        cutter, added = held["pre_tokenizer"] or {}, held.get("added_tokens") or []
        if held["normalizer"] or cutter.get("type") != "ByteLevel" or not cutter.get("use_regex", True) or cutter.get("add_prefix_space"):
            raise ValueError(f"{path} is not a plain byte-level vocabulary")
        if any(t[k] for t in added for k in ("lstrip", "rstrip", "single_word")):
            raise ValueError(f"{path} has special strings that take their surroundings along")
        names = sorted((t["content"] for t in added), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, names))) if names else None
        self.tokenizer = Tokenizer.from_file(path)
        self.classes = code_point_classes().copy()
        self.open = np.array([unicodedata.category(chr(c)) == "Cn" for c in range(sys.maxunicode + 1)])

    @classmethod
    def at(cls, path: str) -> Vocabulary:
        if path not in _loaded:
            _loaded[path] = cls(path)
        return _loaded[path]

    def learn(self, points: np.ndarray) -> None:
        """Asks the library for the classes of code points that Python's Unicode version does not assign."""
        for c in np.unique(points[self.open[points]]).tolist():
            joins = (kind for kind, before in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")) if len(self.tokenizer.pre_tokenizer.pre_tokenize_str(before + chr(c))) == 1)
            self.classes[c], self.open[c] = next(joins, WHITE), False

    def starts(self, points: np.ndarray, breaks: np.ndarray) -> np.ndarray:
        """Where pre-tokens start in an array of code points; at ``breaks`` stand separators, each one of its own.

        A start depends on a code point's class and the one before, but for contractions, whose letters belong to the
        apostrophe unless that continues a run of other characters or a space."""
        if points.dtype != np.uint8 and self.open[points].any():
            self.learn(points)
        kind = self.classes[points]
        kind[breaks] = BREAK
        following = np.append(kind[1:], BREAK)
        last = np.flatnonzero((kind == WHITE) & (following != WHITE) & (following != BREAK))
        kind[last] = np.where(points[last] == 0x20, LAST_SPACE, LAST_WHITE)
        before = np.empty_like(kind)
        before[0], before[1:] = BREAK, kind[:-1]
        found = _BEGINS[before * np.uint8(9) + kind]
        quote = np.flatnonzero(points == 0x27)
        quote = quote[(before[quote] != OTHER) & (before[quote] != LAST_SPACE) & (kind[quote] != BREAK)]
        if len(quote):
            at = np.concatenate((points, np.zeros(2, points.dtype)))
            ended = np.concatenate((kind, np.full(2, BREAK, np.uint8))) == BREAK
            x, y = np.where(ended[quote + 1], 0, at[quote + 1]), np.where(ended[quote + 2], 0, at[quote + 2])
            one = np.isin(x, [ord(c) for c in "stmd"])
            two = ((x == ord("r")) | (x == ord("v"))) & (y == ord("e")) | (x == ord("l")) & (y == ord("l"))
            found[np.concatenate((quote[one] + 1, quote[two] + 1, quote[two] + 2))] = False
            after = np.concatenate((quote[one] + 2, quote[two] + 3))
            found[after[after < len(found)]] = True
        return np.flatnonzero(found)

    def pieces(self, pretokens: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(pretokens, add_special_tokens=False)]


class Pretokens:
    """The pre-tokens of some texts: ``data[start:end]``, the text that each is in, and each text's special strings."""

    def __init__(self, texts: list[str], vocabulary: Vocabulary):
        special = vocabulary.special
        self.specials = np.zeros(len(texts), np.int64)
        owner = np.arange(len(texts))
        if special is not None and any(special.search(t) for t in texts):
            parts = [special.split(t) for t in texts]
            self.specials = np.array([len(p) - 1 for p in parts], np.int64)
            texts, owner = [x for p in parts for x in p], np.repeat(owner, self.specials + 1)
        joined = "\x00".join(texts) + "\x00"
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1  # the separators' places
        self.data = np.frombuffer(joined.encode(), np.uint8)
        if len(self.data) == len(joined):
            starts = vocabulary.starts(self.data, ends)
        else:
            places = np.flatnonzero((self.data & 0xC0) != 0x80)
            starts = places[vocabulary.starts(np.frombuffer(joined.encode("utf-32-le"), "<u4"), ends)]
            ends = places[ends]
        stop = np.append(starts[1:], len(self.data))
        separator = np.zeros(len(self.data), bool)
        separator[ends] = True
        kept = ~separator[starts]
        self.start, self.end = starts[kept], stop[kept]
        self.row = owner[np.repeat(np.arange(len(ends)), np.diff(np.searchsorted(self.start, ends), prepend=0))]
        self.hash = SliceHash(self.data)(self.start, self.end)

    def text(self, which: np.ndarray) -> pa.Array:
        """Some of the pre-tokens as Arrow strings."""
        size = self.end[which] - self.start[which]
        ends = np.concatenate(([0], np.cumsum(size)))
        at = np.repeat(self.start[which] - ends[:-1], size) + np.arange(ends[-1])
        return pa.Array.from_buffers(pa.large_string(), len(which), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(self.data[at]))])


def _parts(batches: Iterator[pa.RecordBatch], vocabulary: str) -> Iterator[tuple[pa.RecordBatch, Pretokens]]:
    for part in chunks(batches):
        yield part, Pretokens(part.column(1).to_pylist(), Vocabulary.at(vocabulary))


def distinct_pretokens(docs: DataFrame, vocabulary: str) -> DataFrame:
    """piece string, n long: every distinct pre-token of (doc_id, text) with its occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def handed() -> pa.RecordBatch:
            hashes, counts = np.concatenate([h for h, _, _ in held]), np.concatenate([n for _, n, _ in held])
            _, first, back = np.unique(hashes, return_index=True, return_inverse=True)
            texts = pa.chunked_array([t for _, _, t in held]).take(pa.array(first)).combine_chunks()
            return pa.RecordBatch.from_arrays([texts.cast(pa.string()), pa.array(np.bincount(back, counts, len(first)).astype(np.int64))], names=["piece", "n"])

        for _, found in _parts(batches, vocabulary):
            if len(found.hash):
                hashes, first, counts = np.unique(found.hash, return_index=True, return_counts=True)
                held.append((hashes, counts, found.text(first)))
                size += len(hashes)
            if size > _HELD:
                yield handed()
                held, size = [], 0
        if held:
            yield handed()

    return docs.mapInArrow(run, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))


def piece_counts(pretokens: DataFrame, vocabulary: str) -> DataFrame:
    """piece, n, pieces int: how many tokens the library makes of every distinct pre-token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = Vocabulary.at(vocabulary)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tokenizer.pieces(batch.column(0).to_pylist()), pa.int32())], names=["piece", "n", "pieces"])

    return pretokens.select("piece", "n").mapInArrow(run, "piece string, n long, pieces int")


def _hot(table: DataFrame, total: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted hashes, byte lengths and piece counts of the pre-tokens that are frequent enough; 2 ** bits at most."""
    rows = table.where(F.col("n") * F.lit(1 << bits) >= total).select("piece", "pieces").toArrow()
    texts = rows.column(0).combine_chunks().cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if len(texts) else np.zeros(0, np.uint8)
    hashes = SliceHash(data)(ends[:-1], ends[1:])
    order = np.argsort(hashes)
    return hashes[order], np.diff(ends)[order].astype(np.int32), np.asarray(rows.column(1).combine_chunks(), np.int32)[order]


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", hot_bits: int = HOT_BITS) -> DataFrame:
    """doc_id, n_bytes long, n_tokens long of every whole text.

    ``vocabulary`` is the path of a tokenizer file that every executor can open (it comes with a Python package)."""
    docs = id_and_text(docs, id_col, text_col)
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    with Scratch(spark) as scratch:
        table = scratch.cut(piece_counts(distinct_pretokens(docs, vocabulary), vocabulary))
        total = table.agg(F.sum("n")).first()[0] or 0
        hot = spark.sparkContext.broadcast(_hot(table, total, hot_bits))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes, lengths, pieces = hot.value
            for part, found in _parts(batches, vocabulary):
                n = part.num_rows
                _, first, times = np.unique(mix(found.hash + mix(found.row.astype(np.uint64))), return_index=True, return_counts=True)
                order = np.argsort(first)
                first, times = first[order], times[order]  # by text again
                row, h = found.row[first], found.hash[first]
                at = np.minimum(np.searchsorted(hashes, h), max(len(hashes) - 1, 0))
                known = (hashes[at] == h) & (lengths[at] == found.end[first] - found.start[first]) if len(hashes) else np.zeros(len(h), bool)
                tokens = found.specials + np.bincount(row[known], times[known] * pieces[at[known]], n)[:n].astype(np.int64) if len(h) else found.specials
                rest, often = first[~known], times[~known]
                pairs = pa.StructArray.from_arrays([found.text(rest).cast(pa.string()), pa.array(often.astype(np.int64))], names=["piece", "times"])
                size = np.bincount(found.row[rest], minlength=n)[:n] if len(rest) else np.zeros(n, np.int64)
                column = part.column(1).cast(pa.large_binary())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1])), pa.array(tokens), list_array(pairs, size)], names=["doc_id", "n_bytes", "known", "rest"])

        read = docs.mapInArrow(run, f"doc_id {kind}, n_bytes long, known long, rest array<struct<piece:string,times:long>>")
        texts = scratch.cut(read.withColumn("row", F.monotonically_increasing_id()))
        rest = texts.select("row", F.explode("rest").alias("r")).select("row", "r.piece", "r.times")
        counts = table.where(F.col("n") * F.lit(1 << hot_bits) < total).select("piece", "pieces")
        sums = rest.join(counts, "piece").groupBy("row").agg(F.sum(F.col("times") * F.col("pieces")).alias("more"))
        found = texts.drop("rest").join(sums, "row", "left")
        return cut(found.select("doc_id", "n_bytes", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_tokens")))
