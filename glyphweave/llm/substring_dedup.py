"""Substring deduplication by level-wise doubling.

A window can repeat only where both its halves do. Windows of about five words are counted first; those that repeat alone are extended to twice
their length (to the asked length at the end) and counted again, until the asked length is reached or no candidate survives. A level's
hashes are sent sorted, one row per bucket of hashes for a team of neighbouring chunks of texts; the answers come back in the same order. Lower levels only rule windows
out, so short hashes serve them; the last level has 64-bit hashes of whole windows.

Words that a repeated window covers, in whatever text, are removed; windows are judged on the input. A null text has no words. A text of
fewer words than a window keeps all. A very long text is a chunk of its own. Repeated rows are copies of one another and lose what their windows cover. Ids are integers; others are an error. Null ids stay null. An empty
table gives no rows. Only the id and the text are read, so other columns cannot clash; an id named like a result
raises an error.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import no_clash
from ._exchange import Counts, chunk_table, chunk_texts, count_keys, in_teams, send, with_counts
from ._words import U64, Texts, windows

#: Bits of the lower levels' hashes: they may take a few windows more for repeated.
SHORT_BITS = 44
RESULTS = ["n_words", "n_removed", "kept_sha256", "spans"]


def level_lengths(window: int, shortest: int) -> list[int]:
    """Window lengths, the last the asked one, each at most twice the one before, the first `shortest` at most."""
    out = [window]
    while out[0] > max(shortest, 1):
        out.insert(0, -(-out[0] // 2))
    return out


def _hashes(t: Texts, words: np.ndarray, length: int, last: bool) -> tuple[np.ndarray, np.ndarray]:
    h, of = windows(words, t.first, length)
    return (h if last else h >> U64(64 - SHORT_BITS)), of


def _extended(alive: np.ndarray, of: np.ndarray, of_next: np.ndarray, step: int) -> np.ndarray:
    """Which windows of the next length begin and end with repeated windows; step is the second half's distance."""
    n = np.diff(of_next)
    start = np.arange(of_next[-1]) + np.repeat(of[:-1] - of_next[:-1], n)
    return alive[start] & alive[start + step]


def _alive(t: Texts, words: np.ndarray, lengths: list[int], counts: Counts | None, known: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """After `known` counted levels: hashes of the next level's windows (or the last's), their places by text, which are candidates
    (after the last level: which repeat)."""
    alive = None
    for k, length in enumerate(lengths[: known + 1]):
        h, of = _hashes(t, words, length, k == len(lengths) - 1)
        alive = np.ones(len(h), bool) if alive is None else _extended(alive, of_before, of, length - lengths[k - 1])
        if k < known:
            at = np.flatnonzero(alive)
            _, back = np.unique(h[at], return_inverse=True)
            found = counts(k, "counts") >= 2
            alive = np.zeros(len(h), bool)
            alive[at] = found[back]
        of_before = of
    return h, of, alive


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, shortest: int = 5) -> DataFrame:
    """Per row: id, n_words, n_removed, kept_sha256 (kept words, one space between), spans (first and last removed word of each stretch)."""
    no_clash(id_col, RESULTS)
    chunks, buckets = in_teams(chunk_table(docs, id_col, text_col))
    lengths = level_lengths(window, shortest)
    counted = None

    def level_of(k: int):
        def runs(r: dict, counts: Counts | None) -> list[tuple[np.ndarray, np.ndarray]]:
            t = Texts(chunk_texts(r["lengths"], r["text"]), lower=False)
            h, _, alive = _alive(t, t.hashes(), lengths, counts, k)
            keys, n = np.unique(h[alive], return_counts=True)
            return [(keys, np.minimum(n, 2))]

        return runs

    for k in range(len(lengths)):
        rows = send(chunks, [k], level_of(k), buckets, 64 if k == len(lengths) - 1 else SHORT_BITS, counted)
        level = count_keys(rows, f"level-{lengths[k]}", 2)
        counted = level if counted is None else counted.union(level)
        if not (level.agg(F.sum("n_repeated")).first()[0] or 0):
            break
    survivors = k + 1 == len(lengths)

    def finish(r: pd.Series, counts: Counts) -> pd.DataFrame:
        t = Texts(chunk_texts(r["lengths"], r["text"]), lower=False)
        repeated = np.zeros(0, bool)
        if survivors:
            _, of, repeated = _alive(t, t.hashes(), lengths, counts, len(lengths))
        # a stretch of covered words begins with a repeated window's start and ends `window` words after the last one's
        start = np.flatnonzero(repeated)
        if len(start):
            start += np.repeat(t.first[:-1] - of[:-1], np.diff(of))[start]
        edge = np.zeros(len(t.starts) + 1, np.int64)
        np.add.at(edge, start, 1)
        np.add.at(edge, start + window, -1)
        keep = np.cumsum(edge)[:-1] == 0
        out = []
        for d, (i, a, b) in enumerate(zip(r["ids"], t.first[:-1].tolist(), t.first[1:].tolist(), strict=True)):
            words, stay = t.raw[t.offsets[d] : t.offsets[d + 1]].split(), keep[a:b]
            gone = int((b - a) - stay.sum())
            cuts = np.flatnonzero(np.diff(np.concatenate([[True], stay, [True]]).astype(np.int8))) if gone else np.zeros(0, int)
            kept = b" ".join(compress(words, stay.tolist()) if gone else words)
            out.append((i, b - a, gone, hashlib.sha256(kept).hexdigest(), [{"from": int(x), "to": int(y) - 1} for x, y in zip(cuts[::2], cuts[1::2], strict=True)]))
        return pd.DataFrame(out, columns=[id_col, "n_words", "n_removed", "kept_sha256", "spans"]).astype({id_col: "Int64"})

    return with_counts(chunks, counted, finish, f"`{id_col}` long, n_words long, n_removed long, kept_sha256 string, spans array<struct<from:long,to:long>>")
