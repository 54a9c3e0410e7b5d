"""One query per document operator, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontaminate, fertility, lang_id, licences, merkle, near_dup, oracles, passages, quality_rank, sharding, suffix_tree, token_counts, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    decoded = bpe.round_trip(table(spark, sf_dir, "documents"), path)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score(table(spark, sf_dir, "documents"), held_out="crc32(cast(doc_id as string)) % 7 = 2", every_word=True, every_context=True)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rank.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out="crc32(cast(doc_id as string)) % 4 = 2")


def op5_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no paths: a source is a tree of folders of 1000 and 50 documents by id, and of every 50 documents
    one stands for the licence file of the folder of 50, one of every 250 for that of 1000, and one of every 2000 for
    that of the source."""
    docs, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    folder = lambda n: F.floor(i / n).cast("string")
    source, number = F.coalesce("source", F.lit("none")), i.cast("string")
    path = (
        F.when(i % 2000 == 3, F.concat_ws("/", source, F.concat(F.lit("COPYING."), number)))
        .when(i % 250 == 7, F.concat_ws("/", source, folder(1000), F.concat(F.lit("LICENSE."), number)))
        .otherwise(F.concat_ws("/", source, folder(1000), folder(50), F.when(i % 50 == 0, F.lit("LICENSE")).otherwise(F.concat(number, F.lit(".txt")))))
    )
    return licences.scan(docs.withColumn("path", path))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


def op7_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.identify(table(spark, sf_dir, "documents"), held_out="crc32(cast(doc_id as string)) % 4 = 2")


def op8_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.rules(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = passages.cut_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


SHARDS = [f"shard-{i:02d}" for i in range(64)]


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents"), "doc_id", SHARDS)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), scale=64, offset=1_000_000, components=32)


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's proof is checked against its text as stored, for every other row (by a checksum of the id) one whose
    line feeds have been taken out."""
    docs = table(spark, sf_dir, "documents")
    hashed = lambda text: merkle.digest("doc_id", "source", "lang", "n_chars", text)
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False)) & F.contains("text", F.lit("\n"))
    rows = docs.select("doc_id", "source", hashed("text").alias("leaf"), F.when(tampered, hashed(F.replace("text", F.lit("\n"), F.lit("")))).alias("tampered"))
    proofs = merkle.manifest(rows, leaf="leaf", group="source", order="doc_id")
    found = merkle.folded(F.coalesce("row.tampered", "leaf"), F.col("witness"))
    checked = proofs.select("row.doc_id", "leaf", "subroot", "root", merkle.proof_hash(F.col("witness")).alias("proof_sha256"), found.alias("folded_root"))
    return checked.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_bpe, op2_suffix_tree, op3_decontaminate, op4_bradley_terry, op5_licence_scan, op6_minhash, op7_kneser_ney)
    found += (op8_fertility, op9_suffix_dedup, op10_sharding, op11_whitening, op12_merkle, op13_token_counts)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """SQL for the operators that SQL can express; the others are tested against brute force in tests/llm."""
    return {
        "op6_minhash": oracles.near_duplicates(3, 85),
        "op9_suffix_dedup": oracles.repeats(50),
        "op10_sharding": oracles.placement(SHARDS),
        "op12_merkle": oracles.merkle(),
    }
