"""Byte-level BPE: encoding by the global table of distinct words, decoding by the table of token bytes.

Texts are cut into pre-tokens by the tokenizer's pattern. A chunk of texts keeps its pre-tokens as a row of numbers, in their places, and its distinct words,
dealt to buckets by a hash and packed, one row for each chunk and bucket. All chunks' words meet in one shuffle by bucket, where each distinct word is encoded
once; the ids go back to the chunks by a join, and each chunk puts its texts together by the numbers. A word is sent once per chunk at most, however often
a text repeats it.

Decoding looks every id up in the token-byte table, which is broadcast: a vocabulary's size bounds it.

A null text is an empty one and has no ids. A null id stays null; repeated rows each have a row. A very long text is a chunk of its own, a very long
word is one row. An empty table gives no rows. Only the id and the text are read, so other columns cannot clash; an id named like a result raises
an error.
"""

from __future__ import annotations

import base64
import itertools
import math
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialise_by, no_clash, partitions
from ._exchange import pack, unpack
from ._words import blocks
from .token_output import LOOSE_SPACE, piece_borders

RESULTS = ["ids", "decoded", "n_tokens", "ids_sha256", "decoded_sha256"]


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file: a token's bytes in base64 and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class PreTokens:
    """Numbers of the pre-tokens of a chunk's texts, and its distinct words in the order of their numbers.

    Texts are first cut where no pre-token crosses (see piece_borders); the pattern cuts each distinct piece once. Texts with a loose
    space are cut by the pattern alone."""

    def __init__(self, pattern: str):
        self.pattern = regex.compile(pattern)
        self.numbers: dict[str, int] = {}

    def _cut(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the texts' pre-tokens, and how many each has."""
        numbers, find, flat, ends = self.numbers, self.pattern.findall, array("q"), np.zeros(len(texts) + 1, np.int64)
        for k, x in enumerate(texts):
            flat.extend([numbers.setdefault(w, len(numbers)) for w in find(x)])
            ends[k + 1] = len(flat)
        return np.frombuffer(flat, np.int64) if flat else np.zeros(0, np.int64), np.diff(ends)

    def cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        whole = texts.fill_null("").cast(pa.large_string())
        loose = np.array([LOOSE_SPACE.search(x) is not None for x in whole.to_pylist()], bool)
        plain = whole.filter(pa.array(~loose))
        counts = np.zeros(len(whole), np.int64)
        own, counts[loose] = self._cut(whole.filter(pa.array(loose)).to_pylist())
        joined, counts[~loose] = self._by_pieces(plain)
        if not loose.any():
            return joined, counts
        out, of = np.empty(counts.sum(), np.int64), np.repeat(loose, counts)
        out[of], out[~of] = own, joined
        return out, counts

    def _by_pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        raw = b"".join(x.encode() for x in texts.to_pylist())
        ends = np.concatenate([[0], np.cumsum(np.asarray(pa.compute.binary_length(texts), np.int64))]) if len(texts) else np.zeros(1, np.int64)
        if not raw:
            return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        buffer = np.frombuffer(raw, np.uint8)
        borders = piece_borders(buffer, ends)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(borders) - 1, [None, pa.py_buffer(borders.astype(np.int64)), pa.py_buffer(buffer)]).dictionary_encode()
        flat, size = self._cut([x.decode() for x in pieces.dictionary.to_pylist()])
        return spread(flat, size, np.asarray(pieces.indices), np.searchsorted(borders, ends))


def spread(flat: np.ndarray, size: np.ndarray, of: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of each entry of `of`, one after another, where entry k has size[k] of them, and their number between the cuts of `of`."""
    n = size[of]
    to = np.cumsum(n)
    at = np.repeat((np.cumsum(size) - size)[of] - (to - n), n)
    at += np.arange(len(at))
    return flat[at], np.diff(np.concatenate([[0], to])[cuts])


def bucket_of(word: bytes, bits: int) -> int:
    """One of 2 ** bits buckets."""
    return zlib.crc32(word) >> (32 - bits)


#: Least number of buckets, as a power of two, and words that a bucket has of all chunks, about.
BUCKET_BITS, BUCKET_WORDS = 4, 1 << 20


def pack_words(words: list[bytes]) -> bytes:
    """Words as their number, their lengths and their bytes."""
    return zstandard.ZstdCompressor(level=3).compress(struct.pack("<I", len(words)) + np.array([len(w) for w in words], "<u4").tobytes() + b"".join(words))


def unpack_words(data: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    (n,) = struct.unpack_from("<I", raw)
    ends = (4 + 4 * n + np.concatenate([[0], np.cumsum(np.frombuffer(raw, "<u4", n, 4), dtype=np.int64)])).tolist()
    return [raw[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def chunks_of(docs: DataFrame, id_col: str, text_col: str, pattern: str, most: int, bits: int) -> DataFrame:
    """The texts in chunks of about `most` bytes, written once: the rows' ids, how many pre-tokens each has, their numbers, the words by bucket, and the number of each
    word in the buckets' order."""
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    fields = pa.struct([("bucket", pa.int32()), ("n", pa.int64()), ("words", pa.binary())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for block in blocks(batches, "text", most):
            pre = PreTokens(pattern)
            numbers, counts = pre.cut(block.column("text"))
            # frequent words get small numbers, whose upper bytes are then mostly zero
            order = np.argsort(-np.bincount(numbers, minlength=len(pre.numbers)), kind="stable")
            renamed = np.empty(len(order), np.uint32)
            renamed[order] = np.arange(len(order), dtype=np.uint32)
            dealt = sorted((bucket_of(w, bits), w, k) for w, k in zip((w.encode() for w in pre.numbers), renamed.tolist(), strict=True))
            held = [{"bucket": b, "n": len(of), "words": pack_words([w for _, w, _ in of])} for b, of in ((b, list(g)) for b, g in itertools.groupby(dealt, key=lambda x: x[0]))]
            places = np.array([k for _, _, k in dealt], np.uint32)
            ids, column = pa.ListArray.from_arrays(pa.array([0, block.num_rows], pa.int32()), block.column("id")), lambda x: pa.array([pack(x)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), ids, column(counts), column(renamed[numbers]), column(places), pa.array([held], pa.list_(fields))], ["chunk", "ids", "counts", "numbers", "places", "buckets"])
            chunk += 1

    kind = base.schema["id"].dataType.simpleString()
    return materialise_by(base.mapInArrow(rows, f"chunk long, ids array<{kind}>, counts binary, numbers binary, places binary, buckets array<struct<bucket:int,n:long,words:binary>>"), "pre-tokens", "chunk")


def encode_words(sent: DataFrame, path: str, pattern: str) -> DataFrame:
    """chunk, bucket, sizes and ids of each row (chunk, bucket, words): how many ids each of its words has, and the ids. A word that several chunks of a
    bucket have is encoded once, as one piece."""
    ranks = sent.sparkSession.sparkContext.broadcast(read_ranks(path))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import tiktoken

        piece = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks.value, special_tokens={})._encode_single_piece
        known: dict[bytes, list[int]] = {}
        sizes, ids = [], []
        for data in pdf["words"]:
            words = unpack_words(data)
            known.update((w, piece(w)) for w in words if w not in known)
            found = [known[w] for w in words]
            sizes.append(pack(np.fromiter(map(len, found), np.uint32, len(found))))
            ids.append(pack(np.fromiter(itertools.chain.from_iterable(found), np.uint32)))
        return pd.DataFrame({"chunk": pdf["chunk"], "bucket": pdf["bucket"], "sizes": sizes, "ids": ids})

    return sent.groupBy("bucket").applyInPandas(run, "chunk long, bucket int, sizes binary, ids binary")


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", most: int = 8 << 20, decoded: bool = False) -> DataFrame:
    """Per row: id, ids (the text's, little-endian, 32 bits each); decoded: also what `decode` makes of these ids, in the same tasks."""
    no_clash(id_col, RESULTS)
    spark = docs.sparkSession
    # as many buckets as words of the texts' size may need, and as the session wants parts, in powers of two
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    bits = min(30, max(BUCKET_BITS, math.ceil(math.log2(max(1, partitions(spark), size // (8 * BUCKET_WORDS))))))
    chunks = chunks_of(docs, id_col, text_col, pattern, most, bits)
    sent = chunks.select("chunk", F.explode("buckets").alias("b")).select("chunk", F.col("b.bucket").alias("bucket"), "b.words")
    answers = encode_words(sent, path, pattern).groupBy("chunk").agg(F.collect_list(F.struct("bucket", "sizes", "ids")).alias("answers"))
    kind = chunks.schema["ids"].dataType.elementType.simpleString()
    table = token_bytes(docs, path) if decoded else None

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                of = lambda c, kind, row=row: unpack(row.column(c)[0].as_py(), kind)
                answer = sorted(row.column("answers")[0].as_py(), key=lambda x: x["bucket"])
                sizes = np.concatenate([np.zeros(0, np.uint32), *[unpack(x["sizes"], np.uint32) for x in answer]]).astype(np.int64)
                flat = np.concatenate([np.zeros(0, np.uint32), *[unpack(x["ids"], np.uint32) for x in answer]])
                # the words stand by bucket; a text's numbers say where
                at = np.empty(len(sizes), np.int64)
                at[of("places", np.uint32)] = np.arange(len(sizes))
                ids, n = spread(flat, sizes, at[of("numbers", np.uint32)], np.concatenate([[0], np.cumsum(of("counts", np.int64))]))
                ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
                # some texts at a time, as the ids' bytes take several times their room
                for a, b in pieces_of(ends, 1 << 19):
                    columns = [row.column("ids").flatten().slice(a, b - a), binaries(ids[ends[a] : ends[b]].astype("<u4"), ends[a : b + 1] - ends[a])]
                    if table is not None:
                        columns.append(binaries(*looked_up(table.value, ids[ends[a] : ends[b]], ends[a : b + 1] - ends[a])))
                    yield pa.RecordBatch.from_arrays(columns, ["id", "ids", "decoded"][: len(columns)])

    # a chunk of empty texts alone has no words, and so no answers
    joined = chunks.select("chunk", "ids", "counts", "numbers", "places").join(answers, "chunk", "left")
    joined = joined.withColumn("answers", F.coalesce("answers", F.array().cast(answers.schema["answers"].dataType)))
    return joined.select("ids", "counts", "numbers", "places", "answers").mapInArrow(rows, f"id {kind}, ids binary" + ", decoded binary" * decoded).withColumnRenamed("id", id_col)


def pieces_of(ends: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Stretches of texts of about `most` ids, one text at least."""
    out, a = [], 0
    while a < len(ends) - 1:
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + most, "right")) - 1)
        out.append((a, b))
        a = b
    return out


def binaries(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """values[ends[d]:ends[d + 1]] as the bytes of text d."""
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends * values.dtype.itemsize), pa.py_buffer(np.ascontiguousarray(values).tobytes())]).cast(pa.binary())


def token_bytes(df: DataFrame, path: str):
    """The token-byte table, broadcast: all tokens' bytes by id, and how many each has."""
    ranks = read_ranks(path)
    table = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return df.sparkSession.sparkContext.broadcast((np.frombuffer(b"".join(table), np.uint8), np.array([len(x) for x in table], np.int64)))


def looked_up(table: tuple[np.ndarray, np.ndarray], ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes that ids stand for, and where those of each text end."""
    data, size = table
    if len(ids) and (ids.max() >= len(size) or not size[ids].all()):
        raise ValueError("an id is not in the vocabulary")
    found, n = spread(data, size, ids, ends)
    return found, np.concatenate([[0], np.cumsum(n)]).astype(np.int64)


def decode(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """All columns of rows of ids (as `encode` gives them) and `decoded`, the bytes that the ids stand for. An id that the vocabulary lacks is an error; null
    ids are none."""
    if "decoded" in encoded.columns:
        raise ValueError("a column has the name of a result: decoded")
    sent = token_bytes(encoded, path)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, ids_col, 2 << 20):
            raw = block.column(ids_col).fill_null(b"").to_pylist()
            ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in raw])]).astype(np.int64)
            decoded = binaries(*looked_up(sent.value, np.frombuffer(b"".join(raw), "<u4"), ends))
            yield pa.RecordBatch.from_arrays([*block.columns, decoded], [*block.schema.names, "decoded"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(rows, f"{kinds}, decoded binary")


def digest(decoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per row of decode: id, n_tokens, and the digests of the ids and of the decoded bytes."""
    return decoded.select(id_col, F.expr("length(ids) div 4").cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
