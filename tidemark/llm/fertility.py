"""Quality rules: tokeniser fertility, with rejection bands per language.

Each word is encoded by a public vocabulary with byte fallback. A text's characters per token, share of byte-fallback
tokens and token entropy (bits, against what its number of tokens allows) are compared with the band of its language
and length class (each doubling of the number of tokens): the middle half of all such texts that pass the base rules,
widened by ``width`` times its range on either side. Where that group has fewer than ``least_texts`` texts, the first
larger one that has enough gives the band: the language and four length classes, the language, the main script, and the
whole corpus however small it is (then wider by the root of the factor that it lacks). So every text is held against a
band. The measures of texts with fewer than ``least_tokens`` tokens spread more, and their bands are wider by the factor
that they lack. Rows without a language are banded by their main script. Bands are statistics over all texts
(approximate quantiles), found in one aggregation; they are broadcast as long as they are few.

Null and empty texts have no words and fail the base rules; an empty table gives no rows. Texts are judged whole,
whatever their length, and row by row: repeated rows and null ids get rows of their own. Values at a band's edge pass.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import SliceHash, Texts, chunks, cut, mix, sums_by

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
MEASURES = ("chars_per_token", "byte_share", "token_entropy")
SCRIPTS = (("Latin", ((0xC0, 0x24F), (0x1E00, 0x1EFF))), ("Cyrillic", ((0x400, 0x52F),)), ("Arabic", ((0x600, 0x6FF),)), ("Han", ((0x3400, 0x4DBF), (0x4E00, 0x9FFF))), ("Hangul", ((0x1100, 0x11FF), (0xAC00, 0xD7AF))), ("Devanagari", ((0x900, 0x97F),)))
_LETTER = np.zeros(256, bool)
_LETTER[[ord(c) for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = True
LEVELS = (("group_name", "length_class"), ("group_name", "length_range"), ("group_name",), ("script",), ())
MOST_BANDS = 20_000  # bands that are broadcast (under 4 MB); more are joined
_loaded: dict = {}


def _pieces(path: str):
    if path not in _loaded:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        _loaded[path] = model, np.array([model.is_byte(i) for i in range(model.get_piece_size())])
    return _loaded[path]


def _distinct(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per element the number of equal elements of its row, and whether it is the first of them in sort order."""
    key = mix(h + mix(row.astype(np.uint64)))
    _, first, back, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    is_first = np.zeros(len(key), bool)
    is_first[first] = True
    return count[back] if len(key) else np.zeros(0, np.int64), is_first


def measure(batch: pa.RecordBatch, vocabulary: str) -> dict[str, np.ndarray]:
    texts = Texts(batch.column(1))
    n, data = texts.n, texts.data
    start, end, row = texts.words()
    hashed = SliceHash(data)
    h = hashed(start, end)
    words = sums_by(row, n)
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    chars = points[end] - points[start]
    symbols = np.concatenate(([0], np.cumsum(_SYMBOL[data])))

    breaks = np.zeros(len(data) + 1, bool)
    breaks[1:][data == 0x0A] = True
    breaks[texts.offsets] = True
    line_start = np.flatnonzero(breaks)[:-1] if len(data) else np.zeros(0, np.int64)
    line_end = np.append(line_start[1:], len(data)) if len(line_start) else line_start
    worded = np.searchsorted(start, line_end) > np.searchsorted(start, line_start)
    line_start, line_end = line_start[worded], line_end[worded]
    line_end = line_end - (data[line_end - 1] == 0x0A) if len(line_end) else line_end
    line_row = np.searchsorted(texts.offsets, line_start, side="right") - 1
    _, first_line = _distinct(line_row, hashed(line_start, line_end))

    repeated = np.zeros(n)
    if len(h) >= 5:
        gram = np.full(len(h) - 4, 5, np.uint64)
        for k in range(5):
            gram = mix(gram * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(gram)])
        at = np.flatnonzero(row[4:] == row[:-4])
        times, _ = _distinct(row[at], gram[at])
        cover = np.zeros(len(h) + 1, np.int64)
        np.add.at(cover, at[times > 1], 1)
        np.add.at(cover, at[times > 1] + 5, -1)
        repeated = sums_by(row, n, (np.cumsum(cover)[:-1] > 0).astype(float))

    model, is_byte = _pieces(vocabulary)
    _, first, back = np.unique(h, return_index=True, return_inverse=True)
    raw = data.tobytes()
    encoded = model.encode([raw[a:b].decode("utf-8", "replace") for a, b in zip(start[first].tolist(), end[first].tolist())], num_threads=1)
    size = np.array([len(e) for e in encoded], np.int64)
    flat = np.fromiter((i for e in encoded for i in e), np.int64, int(size.sum()))
    byte_count = sums_by(np.repeat(np.arange(len(size)), size), len(size), is_byte[flat].astype(float))
    each = size[back] if len(h) else size[:0]
    tokens = sums_by(row, n, each.astype(float))
    spread = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
    token = flat[np.repeat((np.cumsum(size) - size)[back] if len(h) else each, each) + spread]
    key, count = np.unique(np.repeat(row, each) * (1 << 20) + token, return_counts=True)
    owner, p = key >> 20, count / np.maximum(tokens[key >> 20], 1)
    entropy = sums_by(owner, n, -p * np.log2(p))
    return {
        "n_words": words, "word_chars": sums_by(row, n, chars.astype(float)).astype(np.int64), "n_symbols": symbols[texts.offsets[1:]] - symbols[texts.offsets[:-1]],
        "n_dup_lines": sums_by(line_row, n) - sums_by(line_row, n, first_line.astype(float)).astype(np.int64), "n_repeat_words": repeated.astype(np.int64), "n_tokens": tokens.astype(np.int64),
        "chars_per_token": sums_by(row, n, chars.astype(float)) / np.maximum(tokens, 1), "byte_share": sums_by(row, n, (byte_count[back] if len(h) else byte_count[:0])) / np.maximum(tokens, 1),
        "token_entropy": entropy / np.log2(np.maximum(tokens, 2)),
    }


def _code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and code points of the characters of two and three bytes."""
    two, three = np.flatnonzero((data & 0xE0) == 0xC0), np.flatnonzero((data & 0xF0) == 0xE0)
    tail = lambda at: (data[at] & 0x3F).astype(np.int64)
    points = ((data[two] & 0x1F).astype(np.int64) << 6) | tail(two + 1), ((data[three] & 0x0F).astype(np.int64) << 12) | (tail(three + 1) << 6) | tail(three + 2)
    return np.concatenate((two, three)), np.concatenate(points)


def main_script(column: pa.Array) -> np.ndarray:
    """The main script of every text by its letters in the scripts' main blocks."""
    texts = Texts(column)
    latin = np.concatenate(([0], np.cumsum(_LETTER[texts.data])))[texts.offsets]
    at, point = _code_points(texts.data)
    row = np.searchsorted(texts.offsets, at, side="right") - 1
    counts = np.stack([sums_by(row[mine], texts.n) for mine in (np.any([(point >= a) & (point <= b) for a, b in spans], axis=0) for _, spans in SCRIPTS)])
    counts[0] += np.diff(latin)
    names = np.array([f"script:{name}" for name, _ in SCRIPTS], object)
    return np.where(counts.max(0) > 0, names[counts.argmax(0)], "script:other")


def rules(docs: DataFrame, vocabulary: str, width: float = 3.0, least_tokens: int = 40, least_texts: int = 50, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, group_name, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_tokens long, the three
    measures double, base_failed and kept boolean."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    longs = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            found = measure(part, vocabulary)
            script = pa.array(main_script(part.column(1)), pa.string())
            columns = [part.column(0), pc.coalesce(part.column(2), script), script, *(pa.array(found[c].astype(np.int64)) for c in longs), *(pa.array(found[c].astype(float)) for c in MEASURES)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "group_name", "script", *longs, *MEASURES])

    schema = ", ".join([f"doc_id {kind}", "group_name string", "script string", *(f"{c} long" for c in longs), *(f"{c} double" for c in MEASURES)])
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    measured = cut(docs.mapInArrow(run, schema).withColumn("base_failed", failed)).withColumn("length_class", F.floor(F.log2(F.greatest("n_tokens", F.lit(1)))))
    quartiles = [F.percentile_approx(c, [0.25, 0.75], 10_000).alias(c) for c in MEASURES]
    measured = measured.withColumn("length_range", F.floor(F.col("length_class") / 4))
    keys = sorted({k for level in LEVELS for k in level})
    sets = [[F.col(k) for k in level] for level in LEVELS]
    grouped = measured.where(~F.col("base_failed")).groupingSets(sets, *keys).agg(F.grouping_id(*keys).alias("level"), F.count("*").alias("n"), *quartiles)
    table = cut(grouped)
    few, bands = table.count() <= MOST_BANDS, []
    for k, level in enumerate(LEVELS):
        mark = sum(1 << (len(keys) - 1 - i) for i, key in enumerate(keys) if key not in level)
        band = table.where((F.col("level") == mark) & (F.col("n") >= (least_texts if level else 1))).select(*level, F.struct(*MEASURES, "n").alias(f"band_{k}"))
        if level:
            measured = measured.join(F.broadcast(band) if few else band, list(level), "left")
        bands.append(F.col(f"band_{k}") if level else band.scalar())
    inside, band = F.lit(True), F.coalesce(*bands)
    wide = width * F.greatest(least_tokens / F.greatest("n_tokens", F.lit(1)), F.lit(1.0)) * F.sqrt(F.greatest(least_texts / band["n"], F.lit(1.0)))
    for c in MEASURES:
        low, high, spare = band[c][0], band[c][1], 0.02 * (c == "byte_share")
        inside = inside & F.col(c).between(low - wide * (high - low) - spare, high + wide * (high - low) + spare)
    return measured.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(True))).select("doc_id", "group_name", *longs, *MEASURES, "base_failed", "kept")
