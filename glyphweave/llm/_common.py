"""Helpers that the operators of this subpackage share: the shared folder and materialised tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import scratch

#: Words that white space separates, as a Java regular expression.
SPACE_WORD = r"[^\x20\x09-\x0D]+"


def no_clash(id_col: str, results: list[str]) -> None:
    """An error where the id column has the name of a result (`name` or `name type`)."""
    if id_col in {r.split()[0] for r in results}:
        raise ValueError(f"the id column has the name of a result: {id_col}")


def integer_ids(df: DataFrame, *columns: str) -> None:
    """An error, before anything runs, where an id column does not hold integers."""
    for c in columns:
        kind = df.schema[c].dataType.simpleString()
        if kind not in ("tinyint", "smallint", "int", "bigint", "void"):
            raise TypeError(f"ids must be integers, but the column {c} is {kind}")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table in the shared folder and read it: lineage ends there and lost executors cost nothing."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialise_by(df: DataFrame, name: str, by: str) -> DataFrame:
    """As materialise, in as many buckets of a column as the session has parts: joins by that column do not shuffle the table again."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    table = "glyphweave_" + path.rsplit("-", 1)[-1]
    df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(partitions(spark), by).saveAsTable(table)
    return spark.table(table)


def partitions(spark: SparkSession) -> int:
    """How many parts the session wants a shuffle to have; it is the user's knob for the input size."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def buckets_for(size: int, least: int, most_bytes: int = 16 << 20) -> int:
    """Into how many buckets so many bytes go for none to have more than most_bytes on average; `least` at least."""
    return max(least, -(-int(size) // most_bytes))


def tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    """The named Parquet tables of a data folder."""
    return [spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in names]


def space_words(text: Column) -> Column:
    """The words of a text, white space between them; null counts as empty."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SPACE_WORD), F.lit(0))


def settled(df: DataFrame) -> DataFrame:
    """The same rows behind a generator. Filters on costly columns stay above it; the optimizer would otherwise put
    the columns' expressions in place of their names, inside lambdas too, and evaluate them per element."""
    return df.select(F.explode(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns]))).alias("x")).select("x.*")
