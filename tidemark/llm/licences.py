"""License scans: sparse TF-IDF cosine of passages to templates, then nearest-ancestor directory inheritance.

Templates are grants, file headers and licence texts. Every passage of a text that is as long as a template (in words,
across line breaks; a shorter text is one passage) is compared with the templates of about that length as a sparse
TF-IDF vector over words. Document frequencies are counted over all texts for the templates' words; a word of no
template weighs as much as the rarest of them. A text's own licence is the template of the highest cosine, if that
reaches ``least``; of equal cosines (to 9 digits) the longer template wins, then the smaller name.

Passages are pruned by an exact bound: with unit templates the cosine is at most h / sqrt(h^2 + u * other^2), where h is
no more than the sum of the weights of the passage's template words and u the number of its other words. Both are
differences of running sums, so all passages are tried and only promising ones get vectors.

A text without an own licence inherits that of the licence file in its directory or the nearest one above, found by
joining the ancestors of its directory with the directories that hold such a file. If a directory has several, the
strongest match counts (cosines to 9 digits), then the smallest path.

Null and empty texts have no own licence; a null path has no ancestors; an empty table gives no rows. Texts are read
whole, whatever their length; repeated rows and ids are scanned row by row; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.decontaminate import plain_words
from tidemark.llm.licence_texts import TEMPLATES
from tidemark.llm.text import chunks, cut, mix

TOKENS = 1_000_000  # words of promising passages at once


class Templates:
    """Unit vectors of the templates as postings by word, and their lengths in classes of about a tenth."""

    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(self.names))), pa.array([templates[n] for n in self.names])], names=["i", "t"])
        h, row, n = plain_words(batch)
        self.size = np.bincount(row, minlength=n)
        self.licences = [name.split("/")[0] for name in self.names]
        self.terms, back = np.unique(h, return_inverse=True)
        pair, self.tf = np.unique(back * n + row, return_counts=True)
        self.term, self.template = pair // n, pair % n
        self.begin = np.searchsorted(self.term, np.arange(len(self.terms) + 1))
        order, self.classes = np.argsort(self.size), []
        for k in order.tolist():
            if self.classes and self.size[k] <= 1.1 * self.size[self.classes[-1][0]]:
                self.classes[-1].append(k)
            elif self.size[k]:
                self.classes.append([k])

    def places(self, h: np.ndarray) -> np.ndarray:
        """The number of each word's term, or -1."""
        at = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
        return np.where(self.terms[at] == h, at, -1)

    def weigh(self, holders: np.ndarray, texts: int) -> None:
        self.idf = np.log((texts + 1) / (holders + 1)) + 1
        self.other = float(self.idf.max())
        weight = self.tf * self.idf[self.term]
        self.unit = weight / np.sqrt(np.bincount(self.template, weight**2, len(self.names)))[self.template]

    def cosines(self, h: np.ndarray, term: np.ndarray, start: np.ndarray, length: np.ndarray, chosen: list[int]) -> np.ndarray:
        """Cosine of each passage (start and length in words) with the chosen templates."""
        n = len(start)
        owner = np.repeat(np.arange(n), length)
        word = np.repeat(start - np.cumsum(length) + length, length) + np.arange(len(owner))
        known = term[word] >= 0
        pair, tf = np.unique(owner[known] * len(self.terms) + term[word[known]], return_counts=True)
        passage, t = pair // len(self.terms), pair % len(self.terms)
        weight = tf * self.idf[t]
        rest = mix(h[word[~known]] + mix(owner[~known].astype(np.uint64)))
        _, first, times = np.unique(rest, return_index=True, return_counts=True)
        norm = np.bincount(passage, weight**2, n) + np.bincount(owner[~known][first], (times * self.other) ** 2, n)
        counts = self.begin[t + 1] - self.begin[t]
        posting = np.repeat(self.begin[t] - np.cumsum(counts) + counts, counts) + np.arange(int(counts.sum()))
        dot = np.bincount(np.repeat(passage, counts) * len(self.names) + self.template[posting], np.repeat(weight, counts) * self.unit[posting], n * len(self.names))
        return dot.reshape(n, -1)[:, chosen] / np.sqrt(np.maximum(norm, 1e-12))[:, None]

    def best(self, h: np.ndarray, row: np.ndarray, n: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        """For each of n texts the highest cosine that reaches ``least`` and its template (0.0 and -1 without)."""
        value, which = np.zeros(n), np.full(n, -1)
        term = self.places(h)
        begin = np.searchsorted(row, np.arange(n + 1))
        weight = np.concatenate(([0], np.cumsum(np.where(term >= 0, self.idf[term], 0))))
        known = np.concatenate(([0], np.cumsum(term >= 0)))
        ratio = least**2 / (1 - least**2) * self.other**2 if least < 1 else np.inf
        for chosen in self.classes:
            size = int(self.size[chosen[-1]])
            start = np.arange(len(h))
            start = start[(start + size <= begin[row + 1]) | (start == begin[row])] if len(h) else start
            length = np.minimum(size, begin[row[start] + 1] - start)
            mass, others = weight[start + length] - weight[start], length - (known[start + length] - known[start])
            start, length = (x[(mass > 0) & (mass**2 >= ratio * others - 1e-9)] for x in (start, length))
            block = max(1, TOKENS // size)
            for a in range(0, len(start), block):
                found = np.round(self.cosines(h, term, start[a : a + block], length[a : a + block], chosen), 9)
                at, k = found.argmax(1), row[start[a : a + block]]
                top = found[np.arange(len(at)), at]
                for i in np.flatnonzero(top >= least).tolist():
                    if (top[i], self.size[chosen[at[i]]], -chosen[at[i]]) > (value[k[i]], self.size[which[k[i]]] if which[k[i]] >= 0 else 0, -which[k[i]]):
                        value[k[i]], which[k[i]] = top[i], chosen[at[i]]
        return value, which


def scan(files: DataFrame, templates: dict[str, str] | None = None, least: float = 0.7, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text", licence_file: str = r"(?i)(^|/)(licen[cs]e|copying|notice)[^/]*$") -> DataFrame:
    """id, path, own_licence, cosine double (0 below ``least``), licence (own or inherited), licence_dir (of the
    inherited one)."""
    files = files.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(path_col).cast("string").alias("path"))
    known, sc = Templates(templates or TEMPLATES), files.sparkSession.sparkContext
    kind = files.schema["doc_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, texts = np.zeros(len(known.terms), np.int64), 0
        for part in chunks(batches):
            h, row, n = plain_words(part)
            at = known.places(h)
            seen += np.bincount(np.unique(at[at >= 0] * (n + 1) + row[at >= 0]) // (n + 1), minlength=len(seen))
            texts += n
        yield pa.RecordBatch.from_arrays([pa.array([-1, *range(len(seen))]), pa.array([texts, *seen.tolist()])], names=["term", "n"])

    counts = {r[0]: r[1] for r in files.select("doc_id", "text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n")).collect()}  # a row a template word
    known.weigh(np.array([counts.get(k, 0) for k in range(len(known.terms))]), counts.get(-1, 0))
    shared = sc.broadcast(known)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            value, which = shared.value.best(*plain_words(part), least)
            names = [shared.value.licences[w] if w >= 0 else None for w in which.tolist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(names, pa.string()), pa.array(value)], names=["doc_id", "path", "own_licence", "cosine"])

    found = cut(files.select("doc_id", "text", "path").mapInArrow(match, f"doc_id {kind}, path string, own_licence string, cosine double"))
    found = found.withColumn("folder", F.regexp_replace("path", "/?[^/]*$", ""))
    holders = found.where("own_licence is not null").where(F.col("path").rlike(licence_file)).groupBy(F.col("folder").alias("licence_dir")).agg(F.min_by("own_licence", F.struct(-F.col("cosine"), "path")).alias("inherited"))
    bare = found.where("own_licence is null and path is not null").select("folder").distinct()
    parts = F.split("folder", "/")
    above = bare.select("folder", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/")))).alias("licence_dir"))
    nearest = above.join(holders, "licence_dir").groupBy("folder").agg(F.max_by(F.struct("inherited", "licence_dir"), F.length("licence_dir")).alias("near"))
    out = found.join(nearest, "folder", "left")
    free = F.col("own_licence").isNull()
    return out.select("doc_id", "path", "own_licence", "cosine", F.coalesce("own_licence", F.when(free, F.col("near.inherited"))).alias("licence"), F.when(free, F.col("near.licence_dir")).alias("licence_dir"))
