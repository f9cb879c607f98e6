"""Packed arrays of hashes that cross a shuffle as bytes.

A chunk of texts sorts its hashes once. Neighbouring chunks make a team, which grows with the input up to a fixed size; each bucket (a range of
hash values) gets one row per team with the packed runs of its chunks, so rows are few and large, and a bucket holds about the same share of
all hashes. The answers come back in the same rows, and a team's chunks are then taken one by one.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import buckets_for, integer_ids, materialise, partitions
from ._words import U64, blocks

#: Bytes of text of a chunk, and of a team at most; a longer text is a chunk, and ends a team.
CHUNK, TEAM = 3 << 20, 32 << 20
#: Low bits of a chunk's number: its place among those of its part that one task wrote.
PLACE_BITS = 28


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers as byte planes, compressed. Ascending ones as differences take few bytes each."""
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize) if len(values) else np.zeros((0, 1), np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(raw.T).tobytes())


def unpack(data: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(width, len(raw) // width).T).reshape(-1).view(kind)


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=values.dtype.type(0)))


def unpack_sorted(data: bytes, kind=U64) -> np.ndarray:
    return np.cumsum(unpack(data, kind), dtype=kind)


def bucket_borders(ordered: np.ndarray, buckets: int, bits: int = 64) -> np.ndarray:
    """Where each bucket's run begins in ascending values of so many bits, and their end."""
    limits = (np.arange(1, buckets, dtype=object) * (1 << bits) // buckets).astype(U64)
    return np.concatenate([[0], np.searchsorted(ordered, limits), [len(ordered)]])


SENT = "kind int, bucket int, part int, team long, chunks array<long>, sizes array<int>, keys binary, counts binary"
COUNTED = "team long, part int, kind int, bucket int, chunks array<long>, sizes array<int>, counts binary, in_part_1 binary, in_part_2 binary, n_keys long, n_total long, n_part_1 long, n_repeated long"


def chunk_table(docs: DataFrame, id_col: str, text_col: str, part: Column | None = None, most: int = CHUNK) -> DataFrame:
    """The texts in compressed chunks of about `most` bytes, written once, so that later passes see the same chunks.

    A chunk holds rows of one part only. Null texts are empty; null ids stay null. `size` is the bytes of its texts, `at` those of the chunks of
    its part that the same task wrote before it."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, written = TaskContext.get().partitionId() << 32, {}
        squeeze = zstandard.ZstdCompressor(level=6).compress  # a chunk crosses several shuffles
        for batch in batches:
            parts = np.asarray(batch.column("part"))
            for k in np.unique(parts).tolist():
                for block in blocks(iter([batch.filter(pa.array(parts == k))]), "text", most):
                    text = block.column("text").fill_null("").cast(pa.large_string()).take(pa.array(np.arange(block.num_rows)))
                    offsets = np.frombuffer(text.buffers()[1], np.int64)[: len(text) + 1]
                    data = text.buffers()[2]
                    seq, at = written.get(k, (0, 0))
                    size = int(offsets[-1])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([base + (k << PLACE_BITS) + seq], pa.int64()), pa.array([k], pa.int32()), pa.array([block.column("id").to_pylist()], pa.list_(pa.int64())), pa.array([pack(np.diff(offsets))], pa.binary()), pa.array([squeeze(data.to_pybytes() if data is not None else b"")], pa.binary()), pa.array([size], pa.int64()), pa.array([at], pa.int64())],
                        ["chunk", "part", "ids", "lengths", "text", "size", "at"],
                    )
                    written[k] = seq + 1, at + size

    integer_ids(docs, id_col)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), (F.lit(0) if part is None else part).cast("int").alias("part"))
    return materialise(base.mapInArrow(rows, "chunk long, part int, ids array<long>, lengths binary, text binary, size long, at long"), "chunks")


def in_teams(chunks: DataFrame) -> tuple[DataFrame, int]:
    """The chunks with their `team`, and the number of buckets for the hashes of their words.

    A team is the chunks of one part that one task wrote within a stretch of text: the session's parts get two stretches each, of a chunk's size at
    least and TEAM at most. A bucket is about 6 MB of text, which is at most as much of packed hashes; no fewer than the session's parts."""
    total, p = chunks.agg(F.sum("size")).first()[0] or 0, partitions(chunks.sparkSession)
    stretch, low = min(max(total // (2 * p), CHUNK), TEAM), (1 << PLACE_BITS) - 1
    return chunks.withColumn("team", F.expr(f"chunk - (chunk & {low}L) + at div {stretch}L")), buckets_for(total, p, 6 << 20)


def chunk_texts(lengths: bytes, text: bytes) -> pa.Array:
    """The texts of a chunk."""
    sizes = unpack(lengths, np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    data = zstandard.ZstdDecompressor().decompress(text)
    return pa.Array.from_buffers(pa.large_string(), len(sizes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])


def sent_rows(kind: int, part: int, team: int, runs: dict[int, tuple[np.ndarray, np.ndarray]], buckets: int, bits: int) -> list[tuple]:
    """One row per bucket of a team. runs: by chunk its distinct ascending keys and their counts."""
    borders = {c: bucket_borders(keys, buckets, bits) for c, (keys, _) in runs.items()}
    full = np.flatnonzero(sum(np.diff(at) for at in borders.values())) if runs else []
    out = []
    for k in map(int, full):
        cuts = {c: slice(int(at[k]), int(at[k + 1])) for c, at in borders.items() if at[k + 1] > at[k]}
        keys, counts = (np.concatenate([runs[c][x][cut] for c, cut in cuts.items()]) for x in (0, 1))
        # a run's first key may be below the last one of the run before it: their difference wraps around, and back
        out.append((kind, k, part, team, list(cuts), [x.stop - x.start for x in cuts.values()], pack_sorted(keys), pack(counts.astype(np.uint64))))
    return out


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in SENT.split(", ")])


def count_keys(sent: DataFrame, name: str, most: int | None = None, held_from: int | None = None) -> DataFrame:
    """For each sent row the corpus counts of its keys, in its order: over parts 0 and 1; over part 1 alone, for rows of that part; and, of
    kinds from held_from on, for rows of parts 0 and 1 whether part 2 has them, as bits. most: larger counts are given as that, where
    their size is not asked for.

    n_keys, n_total, n_part_1, n_repeated: of the bucket, on one of its rows; keys and counts over parts 0 and 1, and keys counted twice or more."""

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = [unpack_sorted(x) for x in pdf["keys"]]
        sizes = np.array([len(k) for k in keys])
        count = np.concatenate([unpack(x, np.uint64) for x in pdf["counts"]]).astype(np.float64)  # exact to 2 ** 53
        part = np.repeat(pdf["part"].to_numpy(), sizes)
        uniq, at = np.unique(np.concatenate(keys), return_inverse=True)
        every, one = np.bincount(at, count * (part < 2), len(uniq)), np.bincount(at, count * (part == 1), len(uniq))
        two = np.bincount(at, part == 2, len(uniq)) > 0
        ends = np.cumsum(sizes)
        limited = every if most is None else np.minimum(every, most)
        cuts = [at[b - n : b] for b, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
        of_part, flagged = pdf["part"].tolist(), held_from is not None and int(pdf["kind"].iloc[0]) >= held_from
        counts = [pack(limited[c].astype(np.uint64)) for c in cuts]
        in_part_1 = [pack(one[c].astype(np.uint64)) if p == 1 else None for c, p in zip(cuts, of_part, strict=True)]
        in_part_2 = [pack(np.packbits(two[c])) if flagged and p < 2 else None for c, p in zip(cuts, of_part, strict=True)]
        first = np.zeros(len(pdf), np.int64)
        first[0] = 1
        of = {"n_keys": (every > 0).sum(), "n_total": every.sum(), "n_part_1": one.sum(), "n_repeated": (every > 1).sum()}
        return pd.DataFrame({**{c: pdf[c] for c in ("team", "part", "kind", "bucket", "chunks", "sizes")}, "counts": counts, "in_part_1": in_part_1, "in_part_2": in_part_2, **{k: first * int(v) for k, v in of.items()}})

    return materialise(sent.groupBy("kind", "bucket").applyInPandas(total, COUNTED), name)


def counts_by_chunk(rows: pd.DataFrame, kind: int, column: str) -> dict[int, np.ndarray]:
    """The counts (of in_part_2 the bits) of the ascending keys of each of a team's chunks, from its rows of count_keys, in as few bytes each as do."""
    out: dict[int, list[np.ndarray]] = {}
    of = rows[(rows["kind"] == kind) & rows[column].notna()].sort_values("bucket")
    for data, chunks, sizes in zip(of[column], of["chunks"], of["sizes"], strict=True):
        ends = np.cumsum(sizes)
        found = np.unpackbits(unpack(data, np.uint8), count=int(ends[-1])) if column == "in_part_2" else unpack(data, np.uint64)
        found = found.astype(np.min_scalar_type(found.max()))
        for c, x in zip(chunks, np.split(found, ends[:-1]), strict=True):
            out.setdefault(int(c), []).append(x)
    return {c: np.concatenate(x) for c, x in out.items()}


#: The counts of a chunk's keys, by kind and column.
Counts = Callable[[int, str], np.ndarray]


def _answers(rows: pd.DataFrame) -> Callable[[int], Counts]:
    """Each chunk's counts, from its team's rows, which are unpacked once."""
    known: dict[tuple[int, str], dict[int, np.ndarray]] = {}

    def counts(chunk: int, kind: int, column: str) -> np.ndarray:
        if (kind, column) not in known:
            known[kind, column] = counts_by_chunk(rows, kind, column)
        return known[kind, column].get(chunk, np.zeros(0)).astype(np.int64)

    return lambda chunk: functools.partial(counts, chunk)


def send(chunks: DataFrame, kinds: list[int], runs_of: Callable[[dict, Counts | None], list[tuple[np.ndarray, np.ndarray]]], buckets: int, bits: int, counted: DataFrame | None = None) -> DataFrame:
    """Rows of SENT, one per team, kind and bucket. runs_of(chunk's row, its counts so far): its distinct ascending keys and their counts, by kind."""
    columns = [c.split()[0] for c in SENT.split(", ")]

    def team_rows(team: int, part: int, runs: dict[int, list[tuple[np.ndarray, np.ndarray]]]) -> list[tuple]:
        return [row for x, kind in enumerate(kinds) for row in sent_rows(kind, part, team, {c: r[x] for c, r in runs.items()}, buckets, bits)]

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, dict]] = {}  # by part the team that is read, and its chunks' runs
        done: list[tuple[int, int, dict]] = []
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                if r["part"] in held and held[r["part"]][0] != r["team"]:
                    team, runs = held.pop(r["part"])
                    done = [(team, r["part"], runs)]
                held.setdefault(r["part"], (r["team"], {}))[1][r["chunk"]] = runs_of(r, None)
                for x in done:
                    if rows := team_rows(*x):
                        yield as_batch(rows)
                done = []
        for part, (team, runs) in held.items():
            if rows := team_rows(team, part, runs):
                yield as_batch(rows)

    def later(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        counts, rows = _answers(right), left.sort_values("chunk").to_dict("records")
        runs = {r["chunk"]: runs_of(r, counts(r["chunk"])) for r in rows}
        return pd.DataFrame(team_rows(rows[0]["team"], rows[0]["part"], runs) if rows else [], columns=columns)

    read = chunks.select("team", "chunk", "part", "lengths", "text")
    if counted is None:
        return read.mapInArrow(first, SENT)
    return read.groupBy("team").cogroup(counted.groupBy("team")).applyInPandas(later, SENT)


def with_counts(chunks: DataFrame, counted: DataFrame, f: Callable[[pd.Series, Counts], pd.DataFrame], schema: str) -> DataFrame:
    """f(chunk's row, its counts) of each chunk."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        counts = _answers(right)
        return pd.concat([f(r, counts(r["chunk"])) for _, r in left.iterrows()]) if len(left) else pd.DataFrame({c.split()[0].strip("`"): [] for c in schema.split(", ")})

    return chunks.groupBy("team").cogroup(counted.groupBy("team")).applyInPandas(run, schema)
