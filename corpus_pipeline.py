"""The corpus pipeline: quality rules, near-duplicates, repeated passages, benchmark copies, tokens.

Each stage takes (spark, docs, sf_dir), works on all rows of its docs and returns a DataFrame, which ``run`` writes as
Parquet to the folder that the cluster shares and reads again for the next stage, when the one before is removed. All
but the last return the columns of documents. Rows that repeat an id are one document: it stays as long as one of them
passes. Rows without an id pass the quality rules row by row and end at the stages that compare documents. Null and empty
texts fail the rules; an empty table gives no rows; texts are read whole, whatever their length; other columns end.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontaminate, fertility, near_dup, passages
from tidemark.llm.text import remove, shared_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _only(docs: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    return docs.join(ids.select("doc_id").distinct(), "doc_id", how).select(*COLUMNS)


def _key() -> F.Column:
    """A row's id, and for a row without one its text, so that such rows are judged apart."""
    return F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce("text", F.lit("")).cast("binary")), F.coalesce("lang", F.lit(""))))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and their language's fertility bands."""
    keyed = docs.withColumn("_key", _key())
    verdicts = fertility.rules(keyed, public_tokenizers.path("piece_bpe_32k.model"), id_col="_key")
    return keyed.join(verdicts.where("kept").select(F.col("doc_id").alias("_key")), "_key", "left_semi").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of every group (five-word shingles, similarity 0.8 or more)."""
    return _only(docs, near_dup.near_duplicates(docs, words=5, percent=80).where("kept").select("doc_id"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without what an earlier document has and without characters cut in part; none without words."""
    cut = passages.cut_repeats(docs, carry=("lang", "source"), whole_characters=True)
    rest = cut.select("doc_id", F.col("kept").cast("string").alias("text"), F.col("carried")[0].alias("lang"), F.col("carried")[1].alias("source"))
    return rest.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no copy, edited or not, of a test item."""
    found = decontaminate.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _only(docs, found.select("doc_id").distinct(), "left_anti")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, decoded_sha256."""
    decoded = bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", benchmark_copies),
    ("byte-level BPE", tokens),
]
ORACLE_SQL = None  # tokenisers, alignment and suffix ranks are beyond SQL; tests/llm compares with a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
    return docs
