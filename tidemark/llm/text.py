"""Array helpers that the document operators run inside Spark tasks.

Words are maximal runs of bytes outside space and 0x09-0x0D. Every helper takes whole texts in chunks of about
``CHUNK`` bytes, so a task's memory follows the chunk (or its longest single text), never the partition.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 1 << 19
WORD_SPLIT = "[\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_U = np.uint64
_MASK = (1 << 64) - 1
_STEP = 0x9E3779B97F4A7C15
_UNSTEP = pow(_STEP, -1, 1 << 64)
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_TO_LOWER = np.arange(256, dtype=np.uint8)
_TO_LOWER[0x41:0x5B] += 32
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash multiplier and of its inverse, modulo 2^64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_STEP, _UNSTEP)):
            steps = np.full(max(n, CHUNK + 1), base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> _U(33))
    h = h * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


class SliceHash:
    """64-bit hashes of any slices of a byte array, from one running sum."""

    def __init__(self, data: np.ndarray):
        self.p, self.inv = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * self.p[:-1], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inv[start])


def lower(data: np.ndarray) -> np.ndarray:
    return _TO_LOWER[data]


class Texts:
    """Some texts as one byte array; text i is ``data[offsets[i]:offsets[i + 1]]``; null texts are empty."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_binary())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        raw = column.buffers()[2]
        self.data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and len(offsets) and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        self.offsets = offsets - offsets[0]
        self.n = len(column)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text number of every word."""
        space = _IS_SPACE[self.data]
        edge = np.ones(len(space) + 1, bool)
        if len(space):
            edge[1:-1] = space[1:] != space[:-1]
        edge[self.offsets] = True
        cuts = np.flatnonzero(edge)
        start, end = cuts[:-1], cuts[1:]
        word = ~space[start] if len(start) else np.zeros(0, bool)
        start, end = start[word], end[word]
        return start, end, np.searchsorted(self.offsets, start, side="right") - 1


def chunks(batches: Iterator[pa.RecordBatch], text: int = 1, limit: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold about ``limit`` bytes of text each; a longer text has a slice of its own.

    Nulls in the text column become empty strings.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(text)
        if column.null_count:
            column = column.fill_null("")
            batch = pa.RecordBatch.from_arrays([column if i == text else c for i, c in enumerate(batch.columns)], names=batch.schema.names)
        size = np.asarray(pc.binary_length(column), np.int64)
        part = (np.cumsum(size) - 1).clip(0) // limit
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [batch.num_rows]))
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield batch.slice(a, b - a)


def list_array(values: pa.Array | np.ndarray, counts: np.ndarray) -> pa.ListArray:
    """An Arrow list column from concatenated values and each row's count."""
    ends = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), values if isinstance(values, pa.Array) else pa.array(values))


def sums_by(owner: np.ndarray, n: int, values: np.ndarray | None = None) -> np.ndarray:
    """Per owner 0..n-1 the sum of the values, or the count."""
    return np.bincount(owner, values, n)[:n] if len(owner) else np.zeros(n, np.int64 if values is None else np.float64)


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns that the operators read, under fixed names; other columns cannot clash with theirs."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def bucket_bits(total: int) -> int:
    """log2 of the number of hash buckets for so many bytes of text: about 4 MB each, and 256 buckets at least."""
    return max(8, (total >> 22).bit_length())


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share: the cluster's spark.checkpoint.dir. One of this run's own where none is set
    and all tasks run in the driver's process; elsewhere that would be a different folder on every machine."""
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if spark.sparkContext.master.split("[")[0] != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
            folder = tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(folder)
    return context.getCheckpointDir().get()


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Tables that an operator writes to the shared folder to cut its lineage, so that a lost executor costs no more
    than the step that runs. A step's shuffle files go when its table is written, the tables when they are dropped or
    the ``with`` block ends; only ``result`` stays."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.tables = spark, f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}", []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        remove(self.spark, self.folder)

    def _write(self, df: DataFrame, folder: str) -> DataFrame:
        setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = self.spark.conf.get(setting, "false")
        self.spark.conf.set(setting, "true")
        try:
            df.write.parquet(folder)
        finally:
            self.spark.conf.set(setting, before)
        return self.spark.read.schema(df.schema).parquet(folder)

    def cut(self, df: DataFrame) -> DataFrame:
        """The same rows, read from a table of their own."""
        folder = f"{self.folder}/{len(self.tables)}"
        self.tables.append((table := self._write(df, folder), folder))
        return table

    def drop(self, *tables: DataFrame) -> None:
        for table, folder in self.tables:
            if any(table is t for t in tables):
                remove(self.spark, folder)

    def result(self, df: DataFrame) -> DataFrame:
        return self._write(df, self.folder.replace("/scratch-", "/result-"))


def cut(df: DataFrame) -> DataFrame:
    """The same rows from a table in the shared folder that stays there, for results that are read lazily."""
    return Scratch(df.sparkSession).result(df)
