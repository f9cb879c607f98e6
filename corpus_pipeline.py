"""A training-data pipeline over `documents`: five stages, each written and read again before the next.

All stages but the last keep all columns, whatever their names. Rows with null ids pass all stages, as rows of their own; null and empty texts are
rejected by `quality` as too short. Equal rows are copies: `near_duplicates` keeps one where they have an id. Texts of any length go whole. An
empty table stays empty."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glyphweave.llm import decontaminate, jaccard_join, mixing, quality_rules, queries, token_output
from glyphweave.llm._common import materialise, tables
from glyphweave.session import ship


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail are removed; texts that the rules reject go."""
    ship(spark)
    return quality_rules.keep_clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One text of each group of linked texts stays."""
    ship(spark)
    return jaccard_join.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in which a benchmark item lies go."""
    ship(spark)
    (benchmark,) = tables(spark, sf_dir, "benchmark")
    return decontaminate.drop_contaminated(docs, benchmark)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each text as often as the mix takes it, dealt to the output shards."""
    ship(spark)
    return mixing.mixed_rows(docs, shards=len(queries.SHARDS))


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-ID files, and the texts' digests read back from them."""
    ship(spark)
    return token_output.write_and_digest(docs, queries.tokenizer_path())


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
    ("token_files", token_files),
]

#: Link components, block draws and a tokenizer are beyond SQL. Tests compare the rows of near_duplicates, decontamination and token_files with plain
#: Python, those of quality and source_mixing with their operators' verdicts and draws, chained on a small corpus with edge rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    (docs,) = tables(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
