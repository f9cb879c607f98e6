"""Periodic runs of words, found with a dictionary of basic factors.

Level k of the dictionary names each stretch of 2 ** k words, so that equal stretches of a text have equal names; a level's names come from pairs of
the level before. Between a stretch and its next occurrence lies a period: within a run of period q, the stretches of the least power of two from
q on stand exactly q apart, in an arithmetic progression, and the progression's first and last members extend to the run's borders. Stretches that
occur once in their text have no longer repeats and leave the dictionary, so that ordinary prose ends after a few levels.

Texts are worked on in batches, one task's rows at a time; nothing is shuffled. A null or empty text has no words and no runs. A very long text is a
batch of its own. Repeated rows give repeated rows; a null id stays null and its text is never rewritten. An empty table gives no rows. Only the
id and the text are read, so other columns cannot clash; an id named like a result raises an error. Words are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import no_clash
from ._words import Texts, blocks

RESULTS = ["n_words", "runs", "longest", "collapsed"]
RUN = "struct<start:long,length:long,period:long>"


def dense(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts the keys, equal ones by place, and their ranks from 0 in that order."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    return order, np.cumsum(np.diff(ordered, prepend=ordered[:1]) != 0)


def find_batch(words: np.ndarray, first: np.ndarray, least: int = 6, times: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of each run of at least `least` words and `times` periods, by start and period; starts count from the batch's first word.

    words: a hash of each word. first[d]:first[d + 1] are the words of text d."""
    if times < 3:
        raise ValueError("runs of fewer than three periods are not looked for")
    n = len(words)
    counts = np.diff(first)
    of, end = np.repeat(np.arange(len(counts)), counts), np.repeat(first[1:], counts)
    # names differ between texts from the start, so that equal ones always lie in one text
    order, rank = dense(words)
    at = np.empty(n, np.int64)
    at[order] = rank
    keys, place, size, found = at * max(len(counts), 1) + of, np.arange(n), 1, []
    name = np.full(n, -1, np.int64)
    while len(place):
        order, rank = dense(keys)
        where = place[order]
        again = np.flatnonzero(rank[1:] == rank[:-1])
        here, gap = where[again], where[again + 1] - where[again]
        near = (gap <= size) & (2 * gap > size)
        found.append(_progressions(here[near], gap[near], size, least, times))
        # of the next level: both halves occur elsewhere in their text
        repeated = np.zeros(len(where), bool)
        repeated[again] = repeated[again + 1] = True
        name[:] = -1
        name[where[repeated]] = rank[repeated]
        place = where[repeated & (where + 2 * size <= end[where])]
        place = np.sort(place[name[place + size] >= 0])
        keys = name[place] * (int(rank[-1]) + 1) + name[place + size]
        size *= 2
        if not len(place) or times * (size // 2 + 1) > counts.max():
            break
    start, length, period = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _progressions(here: np.ndarray, gap: np.ndarray, size: int, least: int, times: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs from stretches of `size` words whose next occurrence is `gap` further: neighbours with one gap belong to one run, which they cover."""
    order = np.argsort(here)
    here, gap = here[order], gap[order]
    new = np.ones(len(here), bool)
    new[1:] = (np.diff(here) != 1) | (np.diff(gap) != 0)
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(here))[: len(head)] - 1
    start, period = here[head], gap[head]
    length = here[tail] + size + period - start
    long = length >= np.maximum(least, times * period)
    return start[long], length[long], period[long]


def greatest(start: np.ndarray, length: np.ndarray, period: np.ndarray) -> int:
    """Which run has the greatest exact length / period; of ties the first. The runs stand by start and period."""
    best = 0
    while len(better := np.flatnonzero(length * period[best] > length[best] * period)):
        best = int(better[np.argmax(length[better] / period[better])])
    return int(np.flatnonzero(length * period[best] == length[best] * period)[0])


def planted(counts: np.ndarray, seeds: list[int | None]) -> np.ndarray:
    """For each word of a batch the place, from its text's first, of the word that it becomes. A text whose seed is a multiple of 10 repeats from
    word a on the p words from there: g is a tenth of the seed, a = g % n, p = 1 + (n - a) // (3 + g % 8)."""
    place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    a, p = counts.copy(), np.ones(len(counts), np.int64)
    for d, (n, seed) in enumerate(zip(counts.tolist(), seeds, strict=True)):
        if n and seed is not None and seed % 10 == 0:
            g = seed // 10
            a[d] = g % n
            p[d] = 1 + (n - a[d]) // (3 + g % 8)
    a, p = np.repeat(a, counts), np.repeat(p, counts)
    return np.where(place >= a, a + (place - a) % p, place)


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, times: int = 4, seed: Column | None = None) -> DataFrame:
    """Per row: id, n_words, runs (by start, then period), longest (the run of most periods, null if there is none), collapsed (the text's words without
    those that a run repeats, one space between). seed: where given, texts are rewritten by it first (see `planted`)."""
    no_clash(id_col, RESULTS)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            t = Texts(block.column("text"), lower=False)
            # on this side of the rewriting words have places in the buffer, on the other places in the new texts
            source = np.repeat(t.first[:-1], t.counts) + planted(t.counts, block.column("seed").to_pylist())
            start, length, period = find_batch(t.hashes()[source], t.first, least, times)
            edge = np.zeros(len(source) + 1, np.int64)
            np.add.at(edge, start + period, 1)
            np.add.at(edge, start + length, -1)
            keep = np.cumsum(edge)[:-1] == 0
            cut = np.searchsorted(start, t.first)
            changed = np.add.reduceat(np.append((source != np.arange(len(source))) | ~keep, False), t.first[:-1]) > 0 if len(t.counts) else np.zeros(0, bool)
            collapsed, longest = [], []
            for d, (a, b, i, j) in enumerate(zip(t.first[:-1].tolist(), t.first[1:].tolist(), cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
                words = t.raw[t.offsets[d] : t.offsets[d + 1]].split()
                if b > a and changed[d]:
                    words = [words[k] for k in compress((source[a:b] - a).tolist(), keep[a:b].tolist())]
                collapsed.append(b" ".join(words).decode())
                best = i + greatest(start[i:j], length[i:j], period[i:j]) if j > i else None
                longest.append(None if best is None else {"start": int(start[best]) - a, "length": int(length[best]), "period": int(period[best])})
            fields = [pa.array(x, pa.int64()) for x in (start - np.repeat(t.first[:-1], np.diff(cut)), length, period)]
            runs = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
            kinds = pa.struct([(k, pa.int64()) for k in ("start", "length", "period")])
            yield pa.RecordBatch.from_arrays([block.column("id"), pa.array(t.counts, pa.int64()), runs, pa.array(longest, kinds), pa.array(collapsed, pa.string())], ["id", "n_words", "runs", "longest", "collapsed"])

    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), (F.lit(None) if seed is None else seed).cast("long").alias("seed"))
    kind = base.schema["id"].dataType.simpleString()
    return base.mapInArrow(rows, f"id {kind}, n_words long, runs array<{RUN}>, longest {RUN}, collapsed string").withColumnRenamed("id", id_col)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per row of find_runs: id, n_runs, the run of most periods and its periods in thousandths, and the digests of all runs and of the collapsed text."""
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return found.select(
        id_col,
        F.size("runs").cast("long").alias("n_runs"),
        "longest.start",
        "longest.length",
        "longest.period",
        F.expr("(1000 * longest.length) div longest.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
