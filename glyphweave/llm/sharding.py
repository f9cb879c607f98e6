"""Sharding by a permutation-filled lookup table.

Every shard has its own permutation of the slots of a prime-sized table, given by an offset and a step. Shards
take turns; in its turn a shard claims the first slot of its permutation that is still free. Slots per shard
differ by one at most, and most slots keep their shard when one shard is added or removed. The table's size is a
parameter, so it is broadcast whatever the input; a row's shard is one hash and one lookup.

A null key has the hash of a null and so one fixed slot. Equal keys share a slot, repeated rows too. Texts of any length are hashed whole. An empty
table stays empty. Other columns are not read by `place`, and kept inside `row` by `write_shards`, so their names cannot clash; a key named like a
result raises an error.
"""

from __future__ import annotations

from zlib import crc32

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import no_clash

TABLE_SIZE = 65_537


def lookup_table(shards: list[str], size: int = TABLE_SIZE) -> list[int]:
    """The shard number of each slot."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct names, one at least")
    if size <= len(shards) or any(size % i == 0 for i in range(2, int(size**0.5) + 1)):
        raise ValueError("size must be a prime above the number of shards")
    at = [crc32(f"offset {s}".encode()) % size for s in shards]
    step = [crc32(f"step {s}".encode()) % (size - 1) + 1 for s in shards]
    owner, free = [-1] * size, size
    while free:
        for k in range(len(shards)):
            while owner[at[k]] >= 0:
                at[k] = (at[k] + step[k]) % size
            owner[at[k]] = k
            free -= 1
            if not free:
                break
    return owner


def slot(key: Column, size: int = TABLE_SIZE) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(size)).cast("int")


def place(df: DataFrame, key: str, shards: list[str], size: int = TABLE_SIZE) -> DataFrame:
    """The key with its slot and shard number; the table of `size` rows is broadcast."""
    no_clash(key, ["slot", "shard"])
    table = df.sparkSession.createDataFrame(list(enumerate(lookup_table(shards, size))), "slot int, shard int")
    return df.select(F.col(f"`{key}`").alias(key), slot(F.col(f"`{key}`"), size).alias("slot")).join(F.broadcast(table), "slot").select(f"`{key}`", "slot", "shard")


def write_shards(df: DataFrame, key: str, shards: list[str], path: str, parts: int = 8, size: int = TABLE_SIZE) -> None:
    """All columns under path/shard=k. Each shard is dealt over `parts` tasks, so a shard of any size takes many."""
    table = df.sparkSession.createDataFrame([(i, k) for i, k in enumerate(lookup_table(shards, size))], "slot int, shard int")
    cells = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), slot(F.col(key), size).alias("slot"))
    cells = cells.join(F.broadcast(table), "slot").withColumn("part", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(parts)))
    cells.repartition(len(shards) * parts, "shard", "part").select("row", "shard").write.partitionBy("shard").parquet(path)
