"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, chat_format, decontaminate, jaccard_join, jaccard_sql, license_scan, lm_scoring, mixing, periodic_runs, quality_rules, quality_sql, ranked_search, ranked_sql, repeats_sql, sharding, substring_dedup, token_output
from ._common import tables

#: Output shards of the sharding and mixing queries.
SHARDS = [f"shard-{k:03d}" for k in range(64)]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    (docs,) = tables(spark, sf_dir, "documents")
    return license_scan.scan_licenses(docs).drop("matches")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    (docs,) = tables(spark, sf_dir, "documents")
    return lm_scoring.score_documents(docs)


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    (docs,) = tables(spark, sf_dir, "documents")
    return jaccard_join.jaccard_components(docs)


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = tables(spark, sf_dir, "documents", "benchmark")
    return decontaminate.find_leaks(docs, benchmark)


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    (turns,) = tables(spark, sf_dir, "conversations")
    return chat_format.format_chats(*chat_format.from_turns(turns), chat_format.REPLY)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    (docs,) = tables(spark, sf_dir, "documents")
    out = quality_rules.judge(docs.select("doc_id", "text"))
    return out.select(F.col("row.doc_id").alias("doc_id"), *[c for c in out.columns if c not in ("row", "clean_text")])


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    (docs,) = tables(spark, sf_dir, "documents")
    out = mixing.mix(docs.select("doc_id", "text", "source"), shards=len(SHARDS))
    return out.select(F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", "taken", F.array_join("shards", ",").alias("shards"))


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    (docs,) = tables(spark, sf_dir, "documents")
    return token_output.write_and_digest(docs, tokenizer_path()).drop("shard")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    (docs,) = tables(spark, sf_dir, "documents")
    return substring_dedup.remove_repeats(docs).drop("spans")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    (docs,) = tables(spark, sf_dir, "documents")
    return sharding.place(docs, "doc_id", SHARDS)


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = tables(spark, sf_dir, "documents", "benchmark")
    return ranked_search.search(docs, benchmark)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    (docs,) = tables(spark, sf_dir, "documents")
    return periodic_runs.digest(periodic_runs.find_runs(docs, seed=F.crc32(F.col("doc_id").cast("string"))))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    (docs,) = tables(spark, sf_dir, "documents")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.digest(byte_bpe.encode(docs, path, public_tokenizers.PATTERN, decoded=True))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op3_jaccard_join": jaccard_sql.JACCARD, "op4_benchmark_decontamination": repeats_sql.LEAKS, "op6_quality_rules": quality_sql.QUALITY, "op9_substring_dedup": repeats_sql.REPEATS, "op11_ranked_search": ranked_sql.SEARCH}
