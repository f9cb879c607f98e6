"""Work on the rows of a page at once, many pages to an Arrow batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.lineage import written


def _column(column: pa.Array) -> np.ndarray:
    """One page's column; lists, and vectors of 32-bit floats that are packed as binary, as rows of a matrix, absent ones left out."""
    if pa.types.is_binary(column.type):
        whole = column.drop_null()
        cuts, data = np.frombuffer(whole.buffers()[1], np.int32), whole.buffers()[2]
        a, b = (cuts[whole.offset], cuts[whole.offset + len(whole)]) if len(whole) else (0, 0)
        flat = np.frombuffer(data, np.float32, (b - a) // 4, a) if b > a else np.zeros(0, np.float32)
        return flat.reshape(len(whole), -1) if len(whole) else flat.reshape(0, 0)
    if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        return np.asarray(column.flatten()).reshape(max(len(column) - column.null_count, 1), -1)[: len(column) - column.null_count]
    return column.to_numpy(zero_copy_only=False)


#: Rows of results that a task puts together before it hands them on.
MOST_ROWS = 200_000


def over_pages(df: DataFrame, columns: list[str], order: list[str], f: Callable[..., tuple | Iterator[tuple]], returns: dict[str, str], together: bool = False) -> DataFrame:
    """doc_id and f's columns (name: type) of each page: f gets the page's `columns` as arrays, its rows in `order`. f may also be a generator of such columns, for
    pages whose results are made in pieces.

    together: f gets the rows of a whole batch of pages at once, before them the pages' numbers, and returns such numbers before its columns (Arrow arrays stay as they are).

    Pages are dealt by doc_id, where they are not yet, and sorted, as a window over them asks for; a batch of rows is cut where the page changes, so no group is made per
    page. Only the page at a batch's end is held for the next one: a task holds a batch and a page."""
    kind = df.schema["doc_id"].dataType.simpleString()
    names = list(returns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def results(rows: pa.RecordBatch, cuts: list[int]) -> Iterator[pa.RecordBatch]:
            if together:
                page, *values = f(np.repeat(np.arange(len(cuts) - 1), np.diff(cuts)), *[_column(rows.column(c).slice(0, cuts[-1])) for c in columns])
                yield pa.RecordBatch.from_arrays([rows.column("doc_id").take(pa.array(np.array(cuts)[page])), *[v if isinstance(v, pa.Array) else pa.array(v) for v in values]], ["doc_id", *names])
                return
            whole = [rows.column(c) if pa.types.is_nested(rows.column(c).type) or pa.types.is_binary(rows.column(c).type) else _column(rows.column(c)) for c in columns]
            found, of, n = [], [], 0
            for a, b in zip(cuts, cuts[1:], strict=False):
                made = f(*[_column(c.slice(a, b - a)) if isinstance(c, pa.Array) else c[a:b] for c in whole])
                for piece in [made] if isinstance(made, tuple) else made:
                    found.append(piece)
                    of.append((a, len(piece[0])))
                    n += len(piece[0])
                    if n >= MOST_ROWS:
                        yield joined(rows, found, of)
                        found, of, n = [], [], 0
            if found:
                yield joined(rows, found, of)

        def joined(rows: pa.RecordBatch, found: list[tuple], of: list[tuple[int, int]]) -> pa.RecordBatch:
            at = np.repeat(*np.array(of, np.int64).T)
            return pa.RecordBatch.from_arrays([rows.column("doc_id").take(pa.array(at)), *[pa.array(np.concatenate(c)) for c in zip(*found, strict=True)]], ["doc_id", *names])

        for batch in batches:
            if not batch.num_rows:
                continue
            if held and batch.column("doc_id")[0] == batch.column("doc_id")[-1] == held[-1].column("doc_id")[-1]:
                held.append(batch)
                continue
            rows = pa.Table.from_batches([*held, batch]).combine_chunks().to_batches()[0] if held else batch
            ids = rows.column("doc_id").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist()]
            if len(cuts) > 1:
                yield from results(rows, cuts)
            held = [rows.slice(cuts[-1])]
        if held:
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            yield from results(rows, [0, rows.num_rows])

    wanted = list(dict.fromkeys([*columns, *order]))
    page = Window.partitionBy("doc_id")
    place = F.row_number().over(page.orderBy(*order)) if order else F.count("*").over(page)
    dealt = df.filter("doc_id is not null").select("doc_id", *wanted, place.alias("place_in_page"))
    return dealt.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{n} {t}" for n, t in returns.items()))


def as_lists(x: np.ndarray) -> pa.Array:
    """The rows of a matrix as one cell each."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Half away from 0."""
    scaled = x * 10.0**digits
    return np.trunc(scaled + np.copysign(0.5, scaled)) / 10.0**digits


def squared_distances(x: np.ndarray) -> np.ndarray:
    """Of all pairs of rows; from inner products, but where those leave few digits."""
    size = (x * x).sum(1)
    d2 = np.maximum(size[:, None] + size[None, :] - 2 * (x @ x.T), 0)
    i, j = np.nonzero(d2 < 1e-9 * (size[:, None] + size[None, :]))
    d2[i, j] = ((x[i] - x[j]) ** 2).sum(1)
    return d2


def pairs_and_words(found: DataFrame, vectors: DataFrame) -> DataFrame:
    """Words (kind 0: doc_id, a, vec) and pairs (kind 1: doc_id, a, b, label, confidence) in one table, for over_pages in the order of (kind, a, b)."""
    words = vectors.select("doc_id", F.lit(0).alias("kind"), F.col("word_id").alias("a"), F.lit(None).cast("int").alias("b"), F.lit(None).cast("int").alias("label"), F.lit(None).cast("double").alias("confidence"), "vec")
    return words.union(found.select("doc_id", F.lit(1), "a", "b", "label", "confidence", F.lit(None)))


def places(page: np.ndarray, kind: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch of pages as pairs_and_words has them: which pairs have both words, and the words' places among the batch's words."""
    pair = kind == 1
    ends = [a[pair].astype(np.int64), b[pair].astype(np.int64)]
    low = min([int(a.min()), *(int(e.min()) for e in ends if len(e))])
    span = max([int(a.max()), *(int(e.max()) for e in ends if len(e))]) - low + 1
    keys = page[~pair] * span + (a[~pair].astype(np.int64) - low)
    if not len(keys):
        return np.zeros(pair.sum(), bool), *(np.zeros(0, int) for _ in ends)
    wanted = [page[pair] * span + (e - low) for e in ends]
    at = [np.minimum(np.searchsorted(keys, w), len(keys) - 1) for w in wanted]
    ok = (keys[at[0]] == wanted[0]) & (keys[at[1]] == wanted[1])
    return ok, at[0][ok], at[1][ok]


#: Words of a page that a task may square; larger pages are cut into tiles of about as many.
TILE = 2048


def over_tiles(df: DataFrame, f: Callable[..., tuple[np.ndarray, ...]], returns: dict[str, str], size: int = TILE) -> DataFrame:
    """doc_id and f's columns (name: type) of each ordered pair of tiles of each page, a tile with itself included: f(ids, x, other ids, other x) gets the words (word_id, vec) of
    both, by id. A tile is dealt by a hash of the word, about `size` words to each, and a task holds one pair of them."""
    kind = df.schema["doc_id"].dataType.simpleString()
    vec = F.col("vec")
    if df.schema["vec"].dataType == T.BinaryType():
        vec = F.pandas_udf(lambda cells: cells.map(lambda c: np.frombuffer(c, np.float32)), "array<float>")(vec)
    words = df.filter("doc_id is not null").select("doc_id", F.col("word_id").cast("int").alias("word_id"), F.transform(vec, lambda v: v.cast("double")).alias("vec"))
    tiles = words.groupBy("doc_id").agg(F.ceil(F.count("*") / size).cast("int").alias("tiles"))
    cut = words.join(tiles, "doc_id").withColumn("tile", F.pmod(F.xxhash64("word_id"), F.col("tiles")).cast("int"))
    packed = written(cut.groupBy("doc_id", "tile").agg(F.array_sort(F.collect_list(F.struct("word_id", "vec"))).alias("of")).select("doc_id", "tile", F.col("of.word_id").alias("ids"), F.flatten("of.vec").alias("x")), "tiles")
    other = packed.select("doc_id", F.col("tile").alias("other_tile"), F.col("ids").alias("other_ids"), F.col("x").alias("other_x"))
    pairs = packed.join(other, "doc_id").select("doc_id", "ids", "x", "other_ids", "other_x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                ids, x, other_ids, other_x = (np.asarray(row.column(c).flatten()) for c in ("ids", "x", "other_ids", "other_x"))
                found = f(ids, x.reshape(len(ids), -1), other_ids, other_x.reshape(len(other_ids), -1))
                doc = row.column("doc_id").take(pa.array(np.zeros(len(found[0]), np.int64)))
                yield pa.RecordBatch.from_arrays([doc, *map(pa.array, found)], ["doc_id", *returns])

    return pairs.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{n} {t}" for n, t in returns.items()))


def by_size(df: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """The rows of pages of up to `most` rows, and those of larger pages, None if there is none."""
    large = written(df.filter("doc_id is not null").groupBy("doc_id").count().filter(F.col("count") > most).select("doc_id"), "large-pages")
    if large.limit(1).count() == 0:
        return df, None
    return df.join(large, "doc_id", "left_anti"), df.join(large, "doc_id", "left_semi")
