"""Language identification by interpolated Kneser-Ney character models.

One model of ``ORDER`` characters per language is learnt from a bounded sample of labelled texts (about ``sample`` of
each language, picked by a hash of the row, whole texts). Texts are lower-cased and every run of other characters than
letters is one space. Probabilities stand in sorted arrays of packed character sequences, the same sequences for all
languages. A text gets the language of the lowest cross-entropy per character; ``accepted`` is false where that is
above the limit that the language's own sample texts stay under (their 99.9th percentile).

Null texts and texts without a letter are ``und`` with score 0, as is everything if no row is labelled. Ties go to the
language that sorts first. An empty table gives no rows; texts are read whole, whatever their length; repeated rows
and null ids get rows of their own; other columns are not read.

A letter has a code of 16 bits: its own, and beyond the first plane one of the ``SPARE`` codes that no character has
(surrogates and private use), by its number, so letters of one script keep apart and none becomes a space.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import chunks

ORDER = 4
DISCOUNT = 0.75
SPARE = np.array([*range(0xD800, 0xE000), *range(0xE000, 0xF900)], np.uint16)
CELLS = 1 << 22  # characters times languages at once
_U = np.uint64
_letters: np.ndarray | None = None


def letter_map() -> np.ndarray:
    """Lower-case letter for every code point that is a letter, else a space; 16 bits."""
    global _letters
    if _letters is None:
        out = np.full(sys.maxunicode + 1, 0x20, np.uint16)
        for c in range(sys.maxunicode + 1):
            if unicodedata.category(chr(c))[0] == "L":
                small = chr(c).lower()
                code = ord(small) if len(small) == 1 else c
                out[c] = code if code <= 0xFFFF else SPARE[code % len(SPARE)]
        _letters = out
    return _letters


def characters(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed ORDER-character sequences that end at each character, the text of each, and whether texts have letters.

    A text is its letters with single spaces between words, one before and one after; before that there are spaces."""
    joined = "".join("\x00" + (t or "") + "\x00" for t in texts)
    points = np.frombuffer(joined.encode("utf-32-le"), "<u4")
    owner = np.repeat(np.arange(len(texts)), [len(t or "") + 2 for t in texts])
    chars = letter_map()[points]
    new = np.ones(len(chars), bool)
    new[1:] = (chars[1:] != 0x20) | (chars[:-1] != 0x20) | (owner[1:] != owner[:-1])
    chars, owner = chars[new], owner[new]
    first = np.ones(len(chars), bool)
    first[1:] = owner[1:] != owner[:-1]
    begin = np.maximum.accumulate(np.where(first, np.arange(len(chars)), 0))
    depth = np.arange(len(chars)) - begin
    gram = chars.astype(np.uint64)
    for k in range(1, ORDER):
        before = np.full(len(chars), 0x20, np.uint64)
        before[k:] = chars[:-k]
        before[depth < k] = 0x20
        gram |= before << _U(16 * k)
    has = np.bincount(owner, chars != 0x20, len(texts)) > 0
    return gram[~first], owner[~first], has


def gram_counts(docs: DataFrame) -> DataFrame:
    """lang, gram long, c long of docs(text, lang)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, text=0):
            names = np.array(part.column(1).to_pylist(), object)
            for lang in sorted(set(names)):
                mine = part.column(0).filter(pa.array(names == lang)).to_pylist()
                gram, count = np.unique(characters(mine)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram.view(np.int64)), pa.array(count)], names=["lang", "gram", "c"])

    return docs.mapInArrow(run, "lang string, gram long, c long").groupBy("lang", "gram").agg(F.sum("c").alias("c"))


class Models:
    """Interpolated Kneser-Ney models of all languages over one set of sequences."""

    def __init__(self, counts: pd.DataFrame):
        self.langs = sorted(counts["lang"].unique())
        grams = counts["gram"].to_numpy().view(np.uint64)
        lang = np.searchsorted(self.langs, counts["lang"].to_numpy(object)) if self.langs else np.zeros(0, np.int64)
        c, n = counts["c"].to_numpy(float), len(self.langs)
        self.keys: list[np.ndarray] = [np.zeros(1, np.uint64)]
        alphabet = len(np.unique(grams & _U(0xFFFF))) + 1
        self.p: list[np.ndarray] = [np.full((n, 1), 1.0 / alphabet)]
        self.share: list[np.ndarray] = []  # mass that a context of this length leaves to the shorter one
        for k in range(1, ORDER + 1):
            if k == ORDER:
                level, value, who = grams, c, lang
            else:  # how many different characters stand before
                pair = np.unique(np.stack([lang.astype(np.uint64), grams & _U((1 << 16 * (k + 1)) - 1)], 1), axis=0)
                who, level = pair[:, 0].astype(np.int64), pair[:, 1] & _U((1 << 16 * k) - 1)
                value = np.ones(len(who))
            keys = np.unique(level)
            table = np.zeros((n, len(keys)))
            np.add.at(table, (who, np.searchsorted(keys, level)), value)
            context = keys >> _U(16)  # all but the last character
            spots = np.unique(context)
            at = np.searchsorted(spots, context)
            total = np.stack([np.bincount(at, row, len(spots)) for row in table]) if n else np.zeros((0, len(spots)))
            kinds = np.stack([np.bincount(at, row > 0, len(spots)) for row in table]) if n else total
            share = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
            below = self._look(k - 1, keys & _U((1 << 16 * (k - 1)) - 1))
            self.p.append(np.where(total[:, at] > 0, np.maximum(table - DISCOUNT, 0) / np.maximum(total[:, at], 1), 0) + share[:, at] * below)
            self.keys.append(keys)
            self.share.append(share)
            if k == 1:
                self.spots = [spots]
            else:
                self.spots.append(spots)
        self.logs = [np.ascontiguousarray(np.log2(p).T.astype(np.float32)) for p in self.p]

    def _look(self, k: int, grams: np.ndarray) -> np.ndarray:
        """P(last character | those before it) for sequences of k characters, seen or not: languages x sequences."""
        if k == 0:
            return np.broadcast_to(self.p[0], (len(self.langs), len(grams)))
        at = np.minimum(np.searchsorted(self.keys[k], grams), len(self.keys[k]) - 1)
        hit = self.keys[k][at] == grams
        out = self.p[k][:, at].copy()
        if not hit.all():
            miss = grams[~hit]
            spot = np.minimum(np.searchsorted(self.spots[k - 1], miss >> _U(16)), len(self.spots[k - 1]) - 1)
            share = np.where(self.spots[k - 1][spot] == miss >> _U(16), self.share[k - 1][:, spot], 1.0)
            out[:, ~hit] = share * self._look(k - 1, miss & _U((1 << 16 * (k - 1)) - 1))
        return out

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Bits per character, texts x languages, and whether the text has letters."""
        gram, owner, has = characters(texts)
        out, step = np.zeros((len(texts), len(self.langs))), max(1, CELLS // max(len(self.langs), 1))
        for a in range(0, len(gram), step):  # in blocks, so that many languages or a long text take no more memory
            part, whose = gram[a : a + step], owner[a : a + step]
            at = np.minimum(np.searchsorted(self.keys[ORDER], part), len(self.keys[ORDER]) - 1)
            logs = self.logs[ORDER][at]
            miss = np.flatnonzero(self.keys[ORDER][at] != part)
            if len(miss):
                logs[miss] = np.log2(self._look(ORDER, part[miss])).T
            first = np.flatnonzero(np.diff(whose, prepend=-1))
            out[whose[first]] -= np.add.reduceat(logs, first, axis=0, dtype=np.float64)
        return out / np.maximum(np.bincount(owner, minlength=len(texts)), 1)[:, None], has


def sampled(labelled: DataFrame, sample: int, *salt: F.Column) -> DataFrame:
    """About ``sample`` rows of each language by a hash of the row. The table of languages is broadcast while it is
    small (a language is a row), so that texts do not move to their language's task."""
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("n"))
    rate = F.pmod(F.xxhash64("text", "lang", *salt), F.lit(1 << 30)) < F.lit(float(1 << 30)) * F.least(F.lit(1.0), F.lit(float(sample)) / F.col("n"))
    return labelled.join(F.broadcast(sizes) if sizes.count() <= 10_000 else sizes, "lang").where(rate).select("text", "lang")


def fit(labelled: DataFrame, sample: int = 3000) -> Models:
    """Models from labelled(text, lang) without nulls; about ``sample`` texts of a language."""
    return Models(gram_counts(sampled(labelled, sample)).toPandas())


def classify(docs: DataFrame, models: Models, limits: dict[str, float] | None = None) -> DataFrame:
    """doc_id, lang_pred, score double, bits double (per character), accepted boolean for docs(doc_id, text)."""
    sc, kind = docs.sparkSession.sparkContext, docs.schema["doc_id"].dataType.simpleString()
    shared = sc.broadcast((models, limits or {}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, limits = shared.value
        for part in chunks(batches):
            n = part.num_rows
            if not models.langs:
                lang, score, bits, fine = ["und"] * n, np.zeros(n), np.full(n, np.nan), np.zeros(n, bool)
            else:
                every, has = models.entropies(part.column(1).to_pylist())
                best = every.argmin(1)
                bits = every[np.arange(n), best]
                score = np.where(has, 1 / np.exp2((bits[:, None] - every) * 16).sum(1), 0.0)
                lang = [models.langs[b] if h else "und" for b, h in zip(best.tolist(), has.tolist())]
                fine = has & (bits <= np.array([limits.get(x, np.inf) for x in lang]))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(bits), pa.array(fine)], names=["doc_id", "lang_pred", "score", "bits", "accepted"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, bits double, accepted boolean")


def identify(docs: DataFrame, held_out: str, sample: int = 3000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits, accepted; rows on which ``held_out`` (SQL over doc_id) holds teach
    nothing, nor do those without a language."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    docs = docs.withColumn("held_out", F.coalesce(F.expr(held_out), F.lit(False)))
    labelled = docs.where("not held_out and lang is not null and text is not null").select("text", "lang")
    models = fit(labelled, sample)
    limits: dict[str, float] = {}
    if models.langs:
        own = sampled(labelled, sample, F.lit(1))
        own = classify(own.select(F.col("lang").alias("doc_id"), "text"), models)
        limits = {r[0]: r[1] for r in own.where("doc_id = lang_pred").groupBy("lang_pred").agg(F.percentile_approx("bits", 0.999)).collect()}
    found = classify(docs, models, limits)
    return found.select("doc_id", F.coalesce(F.expr(held_out), F.lit(False)).alias("held_out"), "lang_pred", "score", "bits", "accepted")
