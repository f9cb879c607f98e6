"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Test items are partitioned by their number of distinct 5-word shingles, powers of two. An item's sketch is its bottom-k
MinHash: its k smallest shingle hashes, where k is fixed per partition such that an item of which `containment` or more lies
in a text must share a sketch hash with it, however long that text is: of n shingles at most (1 - containment) n are missing, and
k is larger. Texts are probed for sketch hashes; texts with a hit are verified against the items' whole shingle sets.

The index is built from the benchmark table alone. Its size is checked: up to most_broadcast characters it is sent to the
executors and texts are read once, without a shuffle. Beyond that, a bitmap of fixed size of all sketch hashes is sent in its place: texts' shingles
that it rules out go nowhere, the others are joined with the sketches by hash, and the shingles of texts with a hit alone are joined with the
items'. There rows are known by a key of the text itself, and each row takes the result of its text. Both ways give the same rows. Ids are
carried along and never joined.

Words are runs of letters and digits, A-Z in lower case. Null and empty texts match nothing, and neither does an item of fewer
than five words. A very long text is a batch of its own. Repeated rows give repeated results, equal items too; rows and items with a null id keep
it. Empty tables give no rows. Other columns are kept inside `row`, so names cannot clash; an id named item_id or containment raises an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import materialise, no_clash
from ._words import NOT_ALNUM, U64, Texts, blocks, windows

SHINGLE = 5
#: What an item's row counts beside its text where items are measured for broadcasting.
ITEM_BYTES = 100


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each distinct shingle, sorted by text and hash."""
    t = Texts(column, NOT_ALNUM)
    h, of = windows(t.hashes(), t.first, SHINGLE)
    doc = np.repeat(np.arange(len(of) - 1), np.diff(of))
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    return doc[new], h[new]


def sketch_size(n: np.ndarray, containment: float) -> np.ndarray:
    """k of the partition (a power of two up to below the next) that holds sets of n shingles."""
    largest = (1 << (np.floor(np.log2(np.maximum(n, 1))).astype(np.int64) + 1)) - 1
    return np.floor((1 - containment) * largest + 1e-9).astype(np.int64) + 1


class Index:
    """Postings of hashes, with a bitmap that rules out nearly all others. items[first[k]:first[k + 1]] have hash k."""

    def __init__(self, hashes: np.ndarray, items: np.ndarray):
        order = np.lexsort((items, hashes))
        self.items = items[order]
        self.hashes, at = np.unique(hashes[order], return_index=True)
        self.first = np.append(at, len(order))
        bits = max(16, int(np.ceil(np.log2(max(len(self.hashes), 1)))) + 6)
        self.shift = U64(64 - bits)
        self.bitmap = np.zeros(1 << bits, bool)
        self.bitmap[self.hashes >> self.shift] = True

    def probe(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of h are known, and as which."""
        at = np.flatnonzero(self.bitmap[h >> self.shift])
        if not len(at) or not len(self.hashes):
            return at[:0], at[:0]
        k = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
        hit = self.hashes[k] == h[at]
        return at[hit], k[hit]


def build_index(texts: list[str | None], containment: float) -> tuple[Index, Index, np.ndarray]:
    """Index of the sketches, index of all shingles, and the items' sizes."""
    item, h = shingle_sets(pa.array(texts, pa.string()))
    n = np.bincount(item, minlength=len(texts))
    first = np.concatenate([[0], np.cumsum(n)])
    place = np.arange(len(h)) - first[item]
    low = place < sketch_size(n, containment)[item]
    return Index(h[low], item[low]), Index(h, item), n


def find_in_block(texts: pa.Array, sketches: Index, shingles: Index, sizes: np.ndarray, containment: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, item, shared shingles) of each contained item."""
    t = Texts(texts, NOT_ALNUM)
    h, of = windows(t.hashes(), t.first, SHINGLE)
    hit, _ = sketches.probe(h)
    if not len(hit):
        return hit, hit, hit
    docs = np.unique(np.searchsorted(of, hit, "right") - 1)
    at = np.concatenate([np.arange(of[d], of[d + 1]) for d in docs])
    got, k = shingles.probe(h[at])
    pair = np.unique((np.searchsorted(of, at[got], "right") - 1) * len(shingles.hashes) + k)
    doc, k = np.divmod(pair, len(shingles.hashes))
    each = shingles.first[k + 1] - shingles.first[k]
    before = np.cumsum(each) - each
    item = shingles.items[np.repeat(shingles.first[k] - before, each) + np.arange(each.sum())]
    pair, shared = np.unique(np.repeat(doc, each) * len(sizes) + item, return_counts=True)
    doc, item = np.divmod(pair, len(sizes))
    ok = shared >= containment * sizes[item] - 1e-9
    return doc[ok], item[ok], shared[ok]


def askable(benchmark: DataFrame, text_col: str) -> DataFrame:
    """The items that have a shingle's words, which their characters bound: shorter ones cannot be found in any text."""
    return benchmark.filter(F.length(text_col) >= 2 * SHINGLE - 1)


def _small(items: DataFrame, text_col: str, most: int) -> bool:
    """Whether the items' texts and their rows, of ITEM_BYTES each, are no more than `most` bytes."""
    return (items.agg(F.sum(F.octet_length(text_col) + ITEM_BYTES)).first()[0] or 0) <= most


def mark_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", containment: float = 0.8) -> DataFrame:
    """All columns of docs and `leaks`: an array of (item position, containment), empty for a clean text. The benchmark is broadcast."""
    rows = askable(benchmark, item_text_col).select(F.col(item_col).alias("i"), F.col(item_text_col).alias("t")).orderBy("i", "t").collect()
    ids = [r["i"] for r in rows]
    sent = docs.sparkSession.sparkContext.broadcast(build_index([r["t"] for r in rows], containment))
    schema = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketches, shingles, sizes = sent.value
        for block in blocks(batches, "text"):
            doc, item, shared = find_in_block(block.column("text"), sketches, shingles, sizes, containment)
            at = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=block.num_rows))])
            values = pa.StructArray.from_arrays([pa.array([ids[i] for i in item], pa.int64()), pa.array(shared / sizes[item])], ["item_id", "containment"])
            yield pa.RecordBatch.from_arrays([block.column("row"), pa.ListArray.from_arrays(pa.array(at, pa.int32()), values)], ["row", "leaks"])

    out = schema.schema
    return schema.mapInArrow(scan, f"row {out['row'].dataType.simpleString()}, leaks array<struct<item_id: long, containment: double>>")


def _text_key(text: Column) -> Column:
    """128 bits of the text's SHA-256, null for a null text: rows of equal keys have equal shingles, in every retry."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def _hash_rows(df: DataFrame, text_col: str, containment: float | None) -> DataFrame:
    """k (the text's key), h (a distinct shingle's hash), n (the set's size), low (whether it is in the sketch)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "t"):
            doc, h = shingle_sets(block.column("t"))
            n = np.bincount(doc, minlength=block.num_rows)
            place = np.arange(len(h)) - (np.cumsum(n) - n)[doc]
            low = place < sketch_size(n, containment)[doc] if containment is not None else np.zeros(len(h), bool)
            yield pa.RecordBatch.from_arrays([block.column("k").take(pa.array(doc)), pa.array(h.view(np.int64)), pa.array(n[doc]), pa.array(low)], ["k", "h", "n", "low"])

    return df.select(_text_key(F.col(text_col)).alias("k"), F.col(text_col).alias("t")).mapInArrow(rows, "k binary, h long, n long, low boolean")


def _sketch_bitmap(low: DataFrame, bits: int) -> np.ndarray:
    """Which of the 2 ** bits leading values of a hash some sketch has. 2 ** bits / 64 rows go to the driver at most."""
    lead = low.select(F.shiftrightunsigned("h", 64 - bits).alias("x")).distinct()
    words = np.zeros(1 << (bits - 6), U64)
    for r in lead.groupBy(F.shiftright("x", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(x & 63 as int))")).alias("b")).toLocalIterator():
        words[r["w"]] = r["b"] & 0xFFFFFFFFFFFFFFFF
    return words


def _probed(docs: DataFrame, text_col: str, bitmap: np.ndarray, bits: int) -> DataFrame:
    """d, h: the shingles of each text that the bitmap does not rule out."""
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = sent.value
        for block in blocks(batches, "t"):
            t = Texts(block.column("t"), NOT_ALNUM)
            h, of = windows(t.hashes(), t.first, SHINGLE)
            lead = h >> U64(64 - bits)
            at = np.flatnonzero(words[lead >> U64(6)] >> (lead & U64(63)) & U64(1))
            yield pa.RecordBatch.from_arrays([block.column("d").take(pa.array(np.searchsorted(of, at, "right") - 1)), pa.array(h[at].view(np.int64))], ["d", "h"])

    return docs.select(_text_key(F.col(text_col)).alias("d"), F.col(text_col).alias("t")).mapInArrow(rows, "d binary, h long").distinct()


def _leaks_by_text(docs: DataFrame, benchmark: DataFrame, text_col: str, item_text_col: str, containment: float, bits: int = 27) -> DataFrame:
    """d, i, containment: the keys of each text and item text of which the second lies in the first. Joins shingles by hash; no ids."""
    items = materialise(_hash_rows(benchmark, item_text_col, containment).withColumnRenamed("k", "i").distinct(), "items")
    low = items.filter("low").select("h", "i")
    near = materialise(_probed(docs, text_col, _sketch_bitmap(low, bits), bits).join(low, "h").select("d", "i").distinct(), "near")
    hit = docs.select(F.col(text_col).alias("t"), _text_key(F.col(text_col)).alias("d")).join(near.select("d").distinct(), "d", "left_semi").dropDuplicates(["d"])
    hashes = _hash_rows(hit, "t", None).select(F.col("k").alias("d"), "h")
    both = hashes.join(items.select("h", "i", "n"), "h").join(near, ["d", "i"], "left_semi")
    found = both.groupBy("d", "i", "n").agg(F.count("*").alias("shared"))
    return found.filter(F.col("shared") >= containment * F.col("n") - 1e-9).select("d", "i", (F.col("shared") / F.col("n")).alias("containment"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", containment: float = 0.8, most_broadcast: int = 32 << 20) -> DataFrame:
    """id, item_id, containment of each text and item whose shingles lie in it to `containment` or more."""
    no_clash(id_col, ["item_id", "containment"])
    benchmark = askable(benchmark, item_text_col)
    if _small(benchmark, item_text_col, most_broadcast):
        marked = mark_contaminated(docs.select(id_col, text_col), benchmark, text_col, item_col, item_text_col, containment)
        return marked.select(F.col("row")[id_col].alias(id_col), F.explode("leaks").alias("x")).select(id_col, "x.item_id", "x.containment")
    found = _leaks_by_text(docs, benchmark, text_col, item_text_col, containment)
    texts = docs.select(F.struct(F.col(id_col)).alias("row"), _text_key(F.col(text_col)).alias("d"))
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), _text_key(F.col(item_text_col)).alias("i"))
    return texts.join(found, "d").join(items, "i").select(F.col("row")[id_col].alias(id_col), F.col("item").alias("item_id"), "containment")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_broadcast: int = 32 << 20, **kw) -> DataFrame:
    """The rows of docs in which no item lies, all columns."""
    benchmark = askable(benchmark, kw.get("item_text_col", "text"))
    if _small(benchmark, kw.get("item_text_col", "text"), most_broadcast):
        marked = mark_contaminated(docs, benchmark, text_col, **kw).filter(F.size("leaks") == 0)
        return marked.select(*[F.col("row")[c].alias(c) for c in docs.columns])
    found = _leaks_by_text(docs, benchmark, text_col, kw.get("item_text_col", "text"), kw.get("containment", 0.8)).select("d").distinct()
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _text_key(F.col(text_col)).alias("d"))
    return keyed.join(found, "d", "left_anti").select(*[F.col("row")[c].alias(c) for c in docs.columns])
