"""Token-ID output: one wavelet matrix per shard, in one compressed file.

Texts are ranged by id, tokenised and cut into shards of about shard_tokens ids, whole texts each. A shard's ids
become bit-planes: plane k holds bit k (highest first) of all ids in the order that plane k - 1 left them in, zeros
before ones, each half in its old order. With a count of ones before every block of 512 bits (rank directory),
access, counting and the k-th occurrence of an id take one step per plane. A file holds a header, the texts' ids
and lengths, the planes and the directories, each compressed; Spark's Parquet writer commits it as one row, so a
lost task leaves nothing behind.

A null text is an empty one and has its end id alone. Ids are integers; others are an error. A null id sorts first. Texts with the same id stand in the order
of their texts; repeated rows are each written. A very long text makes its shard as long. An empty table writes no shard. Only the id and the text
are read, so other columns cannot clash; an id named like a result raises an error.
"""

from __future__ import annotations

import functools
import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.lineage import scratch
from ._common import integer_ids, no_clash, partitions
from ._words import blocks

MAGIC, BLOCK = b"WMX1", 512
DIGESTS = ["start", "n_tokens", "ids_crc32", "shard", "at", "before"]


class WaveletShard:
    """ids in texts: built from arrays or read from a file's bytes."""

    def __init__(self, planes: list[np.ndarray], n: int, doc_ids: np.ndarray, known: np.ndarray, lengths: np.ndarray):
        self.planes, self.n, self.doc_ids, self.known, self.lengths = planes, n, doc_ids, known, lengths
        self.ranks = [np.concatenate([[0], np.cumsum(np.add.reduceat(np.bitwise_count(p), np.arange(0, len(p), BLOCK // 8), dtype=np.int64))]) if len(p) else np.zeros(1, np.int64) for p in planes]
        self.zeros = [n - int(r[-1]) for r in self.ranks]

    @classmethod
    def build(cls, ids: np.ndarray, doc_ids: np.ndarray, known: np.ndarray, lengths: np.ndarray, levels: int) -> WaveletShard:
        planes = []
        for k in range(levels - 1, -1, -1):
            bit = (ids & ids.dtype.type(1 << k)) != 0
            planes.append(np.packbits(bit, bitorder="little"))
            ids = np.concatenate([ids[~bit], ids[bit]])
        return cls(planes, len(ids), doc_ids, known, lengths)

    def to_bytes(self) -> bytes:
        packed = zstandard.ZstdCompressor(level=1).compress
        parts = [packed(np.ascontiguousarray(x).tobytes()) for x in (self.doc_ids.astype("<i8"), np.packbits(self.known), self.lengths.astype("<u8"), *self.planes, *(r.astype("<u8") for r in self.ranks))]
        head = struct.pack(f"<4sIQQ{len(parts)}Q", MAGIC, len(self.planes), self.n, len(self.lengths), *map(len, parts))
        return b"".join([head, *parts])

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletShard:
        magic, levels, n, docs = struct.unpack_from("<4sIQQ", data)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        count = 3 + 2 * levels
        sizes = struct.unpack_from(f"<{count}Q", data, 24)
        at = 24 + 8 * count + np.concatenate([[0], np.cumsum(sizes)]).astype(int)
        part = lambda i, kind: np.frombuffer(zstandard.ZstdDecompressor().decompress(data[at[i] : at[i + 1]]), kind)
        out = cls.__new__(cls)
        out.n, out.doc_ids, out.lengths = n, part(0, "<i8"), part(2, "<u8").astype(np.int64)
        out.known = np.unpackbits(part(1, np.uint8), count=docs).astype(bool)
        out.planes = [part(3 + k, np.uint8) for k in range(levels)]
        out.ranks = [part(3 + levels + k, "<u8").astype(np.int64) for k in range(levels)]
        out.zeros = [n - int(r[-1]) for r in out.ranks]
        return out

    def _ones(self, k: int, i: int) -> int:
        """Ones before place i of plane k."""
        block = i // BLOCK
        bits = np.unpackbits(self.planes[k][block * BLOCK // 8 : (i + 7) // 8], bitorder="little")
        return int(self.ranks[k][block]) + int(bits[: i - block * BLOCK].sum())

    def access(self, i: int) -> int:
        """The id at place i."""
        out = 0
        for k in range(len(self.planes)):
            bit = int(self.planes[k][i // 8] >> (i % 8) & 1)
            ones = self._ones(k, i)
            i = self.zeros[k] + ones if bit else i - ones
            out = out << 1 | bit
        return out

    def _range(self, token: int, end: int) -> tuple[int, int]:
        """Where the token's occurrences before `end` stand below the last plane."""
        a, b = 0, end
        for k in range(len(self.planes)):
            oa, ob = self._ones(k, a), self._ones(k, b)
            a, b = (self.zeros[k] + oa, self.zeros[k] + ob) if token >> (len(self.planes) - 1 - k) & 1 else (a - oa, b - ob)
        return a, b

    def count(self, token: int, end: int | None = None) -> int:
        """How often the token stands before place `end`."""
        a, b = self._range(token, self.n if end is None else end)
        return b - a

    def occurrence(self, token: int, nth: int) -> int:
        """The place of the token's nth occurrence, from 0."""
        a, b = self._range(token, self.n)
        if not 0 <= nth < b - a:
            raise IndexError(nth)
        i = a + nth
        for k in range(len(self.planes) - 1, -1, -1):
            one = bool(token >> (len(self.planes) - 1 - k) & 1)
            want = i - self.zeros[k] + 1 if one else i + 1  # the want-th one (or zero) of plane k
            before = self.ranks[k] if one else np.minimum(np.arange(len(self.ranks[k])) * BLOCK, self.n) - self.ranks[k]
            block = int(np.searchsorted(before, want, "left")) - 1
            bits = np.unpackbits(self.planes[k][block * BLOCK // 8 : (block + 1) * BLOCK // 8], bitorder="little")[: self.n - block * BLOCK] == one
            i = block * BLOCK + int(np.flatnonzero(bits)[want - int(before[block]) - 1])
        return i

    def tokens(self) -> np.ndarray:
        """All ids in order: the planes undone from the last to the first."""
        ids = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for k in range(len(self.planes) - 1, -1, -1):
            bit = np.unpackbits(self.planes[k], count=self.n, bitorder="little").view(bool)
            up = np.empty_like(ids)
            up[~bit] = ids[: self.zeros[k]]
            up[bit] = ids[self.zeros[k] :] | ids.dtype.type(1 << (len(self.planes) - 1 - k))
            ids = up
        return ids


#: A space before other white space or the end of a text: one that does not join its follower.
LOOSE_SPACE = re.compile(r" (?:\s|\Z)")
# Classes of bytes: what may follow a space in white space (all ASCII control bytes, and first bytes of longer white space); ASCII letters;
# ASCII marks and the newline, with which no letter joins.
_BYTES = np.arange(256)
_MAYBE_WHITE = (_BYTES <= 0x20) | np.isin(_BYTES, [0xC2, 0xE1, 0xE2, 0xE3])
_LETTER = np.isin(_BYTES & 0xDF, np.arange(0x41, 0x5B)) & (_BYTES < 0x80)
_MARK = (_BYTES > 0x20) & (_BYTES < 0x7F) & ~_LETTER & ~np.isin(_BYTES, np.arange(0x30, 0x3A))
# Second bytes that end a letter after C3, C4 or C5: all of U+00C0 to U+017F but the signs of multiplication and division.
_LATIN_FIRST = np.isin(_BYTES, [0xC3, 0xC4, 0xC5])
_SIGN_SECOND = np.isin(_BYTES, [0x97, 0xB7])
_NEWLINE, _SPACE = 0x0A, 0x20


def piece_borders(buffer: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Where the texts' pieces begin, and the last one's end: at each space, where a letter meets a mark or a newline, and where a newline after
    a letter or mark meets a letter. No token of a byte-level pre-tokenizer crosses such a border, where each space joins its follower."""
    cut = np.zeros(len(buffer) + 1, bool)
    cut[texts] = True
    if len(buffer) > 1:
        before, here = buffer[:-1], buffer[1:]
        letter = _LETTER[before]
        latin = _LATIN_FIRST[before[:-1]] & (here[:-1] >= 0x80) & ~((before[:-1] == 0xC3) & _SIGN_SECOND[here[:-1]])
        letter[1:] |= latin
        cut[1:-1] |= (here == _SPACE) | (letter & (_MARK[here] | (here == _NEWLINE)))
        line = np.flatnonzero((before[1:] == _NEWLINE) & _LETTER[here[1:]])
        cut[line[letter[line] | _MARK[before[line]]] + 2] = True
    return np.flatnonzero(cut)


class PieceTokenizer:
    """The library's ids of whole texts.

    Texts are cut into pieces (see piece_borders), a batch's pieces are dictionary-encoded, and the library encodes those that are new, once each.
    Those that begin with a space are encoded as one text: the ids that begin with a space part them. Pieces' ids are kept for reuse
    in two generations: of about `most` pieces each, those used since the last change, and the ones before, which go at the next change
    unless used again. Texts with a loose space or an added token, and all texts where the library's file has another pre-tokenizer or a
    normalizer, are encoded as they are."""

    def __init__(self, path: str, most: int = 150_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.kind = np.uint16 if self.library.get_vocab_size() <= 1 << 16 else np.uint32
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        rule = json.loads(self.library.pre_tokenizer.__getstate__()) if self.library.pre_tokenizer else {}
        self.by_pieces = self.library.normalizer is None and rule.get("type") == "ByteLevel" and rule["use_regex"] and not rule["add_prefix_space"]
        vocabulary = self.library.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.spaced[[i for t, i in vocabulary.items() if t[0] == "\u0120"]] = True  # the space of the byte alphabet
        self.recent: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.most = most

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        spaced = [p for p in pieces if p[0] == _SPACE]
        others = [p for p in pieces if p[0] != _SPACE]
        found = dict(zip(others, self.whole([p.decode() for p in others]), strict=True))
        if spaced:
            (raw,) = self.whole([b"".join(spaced).decode()])
            ids = np.frombuffer(raw, self.kind)
            at = (np.flatnonzero(self.spaced[ids]) * ids.itemsize).tolist()
            found |= zip(spaced, (raw[i:j] for i, j in zip(at, [*at[1:], len(raw)], strict=True)), strict=True)
        return found

    def _known(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of different pieces."""
        found = list(map(self.recent.get, pieces))
        lacking = [k for k, x in enumerate(found) if x is None]
        if lacking:
            others = {pieces[k]: self.older.get(pieces[k]) for k in lacking}
            others |= self._learn([p for p, x in others.items() if x is None])
            for k in lacking:
                found[k] = others[pieces[k]]
            self.recent |= others
            if len(self.recent) > self.most:
                self.older, self.recent = self.recent, {}
        return found

    def _by_pieces(self, buffer: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts buffer[texts[d]:texts[d + 1]], and their number by text."""
        borders = piece_borders(buffer, texts)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(borders) - 1, [None, pa.py_buffer(borders.astype(np.int64)), pa.py_buffer(buffer)]).dictionary_encode()
        raw = self._known(pieces.dictionary.to_pylist())
        flat, size = np.frombuffer(b"".join(raw), self.kind), np.fromiter(map(len, raw), np.int64, len(raw)) // np.dtype(self.kind).itemsize
        start, of = np.cumsum(size) - size, np.asarray(pieces.indices)
        n = size[of]
        to = np.cumsum(n)
        at = np.repeat(start[of] - (to - n), n)
        at += np.arange(len(at))
        return flat[at], np.diff(np.concatenate([[0], to])[np.searchsorted(borders, texts)])

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a column of texts, and their number by text; a null text has none."""
        column = column.fill_null("").cast(pa.large_string()).take(pa.array(np.arange(len(column))))
        texts = np.frombuffer(column.buffers()[1], np.int64)[: len(column) + 1] if len(column) else np.zeros(1, np.int64)
        data = column.buffers()[2]
        buffer = np.frombuffer(data, np.uint8)[: texts[-1]] if data is not None else np.zeros(0, np.uint8)
        simple = np.full(len(column), self.by_pieces)
        if self.by_pieces:
            space = np.flatnonzero(buffer == _SPACE)
            after = np.minimum(space + 1, len(buffer) - 1)
            odd = np.unique(np.searchsorted(texts, space[_MAYBE_WHITE[buffer[after]] | np.isin(space + 1, texts)], "right") - 1)
            if any(t.encode() in memoryview(buffer).tobytes() for t in self.added):
                odd = np.arange(len(column))
            for d in odd.tolist():
                text = column[d].as_py()
                simple[d] = LOOSE_SPACE.search(text) is None and not any(t in text for t in self.added)
        if simple.all() and len(column):
            return self._by_pieces(buffer, texts)
        parts: list[np.ndarray] = [np.zeros(0, self.kind)] * len(column)
        for d, ids in zip(np.flatnonzero(~simple).tolist(), self.whole([x.as_py() for x in column.filter(pa.array(~simple))]), strict=True):
            parts[d] = np.frombuffer(ids, self.kind)
        if simple.any():
            kept = np.flatnonzero(simple)
            sizes = np.diff(texts)[kept]
            ids, n = self._by_pieces(np.concatenate([buffer[texts[d] : texts[d + 1]] for d in kept.tolist()]), np.concatenate([[0], np.cumsum(sizes)]))
            for d, x in zip(kept.tolist(), np.split(ids, np.cumsum(n)[:-1]), strict=True):
                parts[d] = x
        return np.concatenate([np.zeros(0, self.kind), *parts]), np.array([len(x) for x in parts], np.int64)


@functools.lru_cache(maxsize=1)
def piece_tokenizer(path: str) -> PieceTokenizer:
    """One per Python worker: its tasks share the kept pieces."""
    return PieceTokenizer(path)


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, shard_tokens: int = 1 << 23) -> DataFrame:
    """Write the shards (shard, n_tokens, content) under path in ascending id order, and return that table."""
    spark = docs.sparkSession
    no_clash(id_col, DIGESTS)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = piece_tokenizer(tokenizer_path)
        levels = max(1, (max(tokenizer.library.get_vocab_size() - 1, end_id)).bit_length())
        base, seq = TaskContext.get().partitionId() << 32, 0
        ids: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        keys: list[pa.Array] = []
        size = 0

        def shard() -> pa.RecordBatch:
            key = pa.chunked_array(keys, pa.int64())
            made = WaveletShard.build(np.concatenate(ids), np.asarray(key.fill_null(0)), np.asarray(key.is_valid()), np.concatenate(lengths), levels)
            return pa.RecordBatch.from_arrays([pa.array([base + seq], pa.int64()), pa.array([made.n], pa.int64()), pa.array([made.to_bytes()], pa.binary())], ["shard", "n_tokens", "content"])

        for block in blocks(batches, "text", 4 << 20):
            found, n = tokenizer.encode(block.column("text"))
            to = np.cumsum(n + 1)
            every = np.full(len(found) + len(n), end_id, tokenizer.kind)
            inside = np.ones(len(every), bool)
            inside[to - 1] = False
            every[inside] = found
            ids.append(every)
            lengths.append(n + 1)
            keys.append(block.column("id"))
            size += len(every)
            if size >= shard_tokens:
                yield shard()
                seq, size = seq + 1, 0
                for held in (ids, lengths, keys):
                    held.clear()
        if keys:
            yield shard()

    integer_ids(docs, id_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # where many rows have one id, or none, its texts are ranged by their beginnings, which the ranges' sample must read; the order is the same
    by, p = [F.col("id").asc_nulls_first()], partitions(spark)
    most = rows.groupBy("id").agg(F.count("*").alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("every")).first()
    if (most["most"] or 0) * p > (most["every"] or 0):
        by.append(F.substring("text", 1, 64).asc_nulls_first())
    rows = rows.repartitionByRange(p, *by).sortWithinPartitions("id", "text")
    rows.mapInArrow(encode, "shard long, n_tokens long, content binary").write.option("compression", "none").option("maxRecordsPerFile", 1).parquet(path)
    return read_shards(spark, path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("shard long, n_tokens long, content binary").parquet(path)


def read_digests(shards: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per text, from the files: id, start (ids of all texts before it), n_tokens, ids_crc32 of its 32-bit little-endian ids, shard."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, content in zip(batch.column("shard").to_pylist(), batch.column("content"), strict=True):
                made = WaveletShard.from_bytes(content.as_py())
                ids = made.tokens().astype("<u4")
                to = np.cumsum(made.lengths)
                crc = [zlib.crc32(ids[b - n : b]) for b, n in zip(to.tolist(), made.lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(made.doc_ids, mask=~made.known), pa.array(to - made.lengths), pa.array(made.lengths), pa.array(crc, pa.int64()), pa.array([k] * len(crc), pa.int64())], [id_col, "at", "n_tokens", "ids_crc32", "shard"])

    docs = shards.select("shard", "content").mapInArrow(decode, f"`{id_col}` long, at long, n_tokens long, ids_crc32 long, shard long")
    # One row per shard, a few bytes each, meets here: shards before a shard are summed.
    before = shards.select("shard", (F.sum("n_tokens").over(Window.orderBy("shard")) - F.col("n_tokens")).alias("before"))
    return docs.join(before, "shard").select(id_col, (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "shard")


def write_and_digest(docs: DataFrame, tokenizer_path: str, **kw) -> DataFrame:
    """Write the shards in the shared folder and read the texts' digests back from the files."""
    shards = write_tokens(docs, scratch(docs.sparkSession, "tokens"), tokenizer_path, **kw)
    return read_digests(shards, kw.get("id_col", "doc_id"))
