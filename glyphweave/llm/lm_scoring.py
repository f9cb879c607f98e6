"""LM scoring by deleted interpolation.

A token's probability given the tokens before it mixes maximum-likelihood estimates of n-grams, from the longest order to single tokens, with a
uniform one. The mixture weights depend on how often the contexts of two and three tokens' n-grams were seen (buckets of powers of two) and are
learned by expectation-maximisation on held-out counts: one deleted part of the training texts is scored with the counts of the rest. Final
scores use the counts of all training texts.

Counts never leave Spark. A chunk of texts sends each distinct token and bigram once, with its count in the chunk, in one row per bucket with its
neighbours'; buckets of hashes add them up and answer each chunk in its own order. Longer n-grams are sent after that, and only where the shorter ones leave their count open: an n-gram
occurs no more often than either n-gram in it that is one token shorter. A training text's n-gram with a shorter one seen once is itself seen
once, and a held-out text's with a shorter one never seen is never seen. Each round of the expectation-maximisation is one aggregation over the deleted part's exact estimates, in tasks; the driver gets one sum per
bucket and order, whatever the corpus.

Tokens are words in lower case (A-Z), and one end per text. N-grams are compared by 64-bit hashes. A null text has its end alone. A null id has
no remainder: it counts as training. Repeated rows each count and are each scored. Very long texts stand in a chunk of their own. An empty table
gives no rows. Only the id and the text are read, so other columns cannot clash; an id named like a result raises an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialise, no_clash
from ._exchange import Counts, chunk_table, chunk_texts, count_keys, in_teams, pack, send, unpack, with_counts
from ._words import U64, Texts, mix

END, START = U64(0x9AE16A3B2F90404F), U64(0xC949D7C7509E6557)
#: Context buckets: not seen, then one per power of two, the last open.
BUCKETS = 24
SCORED = ["held_out boolean", "n_tokens long", "n_known long", "train_tokens long", "base_score double", "score double"]


class Tokens:
    """A chunk's tokens, ends included; first[d]:first[d + 1] are those of text d."""

    def __init__(self, lengths: bytes, text: bytes, part: int):
        t = Texts(chunk_texts(lengths, text))
        docs = len(t.counts)
        self.part, self.training = part, part < 2
        self.first = t.first + np.arange(docs + 1)
        self.token = np.full(len(t.starts) + docs, END, U64)
        word = np.ones(len(self.token), bool)
        word[self.first[1:] - 1] = False
        self.token[word] = t.hashes()
        self.heads, self.ends = self.first[:-1], self.first[1:] - 1

    def grams(self, order: int) -> np.ndarray:
        """The n-gram that ends at each token; before a text stand starts."""
        gram, start = self.token, START
        for _ in range(order - 1):
            before = np.empty_like(gram)
            before[1:] = gram[:-1]
            before[self.heads] = start
            gram, start = mix(mix(before) + self.token), mix(mix(np.array([start], U64)) + START)[0]
        return gram

    def contexts(self, counts: list[np.ndarray], texts: int) -> list[np.ndarray]:
        """How often the contexts of each token's n-grams of two tokens and more were seen; a text's start as often as there are texts."""
        out = []
        for c in counts[:-1]:
            before = np.empty_like(c)
            before[1:] = c[:-1]
            before[self.heads] = texts
            out.append(before)
        return out

    def counted(self, counts: Counts, orders: int) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
        """By order from 1 to `orders`, of which answers are there: training counts of the n-grams at each token; in the deleted part's texts those
        of that part (what is seen once is theirs); in training texts, from two tokens on, whether held-out texts have them."""
        every, deleted, held = [], [], []
        for k in range(1, orders + 1):
            asked = np.flatnonzero(self.open(every, held, k))
            _, at = np.unique(self.grams(k)[asked], return_inverse=True)
            every.append(np.full(len(self.token), int(self.training), np.int64))
            every[-1][asked] = counts(k - 1, "counts")[at]
            if self.part == 1:
                deleted.append(np.ones(len(self.token), np.int64))
                deleted[-1][asked] = counts(k - 1, "in_part_1")[at]
            held.append(np.zeros(len(self.token), np.int64))
            if self.training and k > 1:
                held[-1][asked] = counts(k - 1, "in_part_2")[at]
        return every, deleted, held

    def open(self, every: list[np.ndarray], held: list[np.ndarray], order: int) -> np.ndarray:
        """Whose n-grams' counts the shorter ones' leave open. Tokens and bigrams are all asked for; so is what is seen once in training where
        held-out texts may have it, as these cannot know."""
        if order <= 2:
            return np.ones(len(self.token), bool)

        def least(x: np.ndarray) -> np.ndarray:
            before = np.empty_like(x)
            before[1:] = x[:-1]
            before[self.heads] = x[self.heads]
            return np.minimum(x, before)

        n = least(every[-1])
        return (n > 1) | ((n == 1) & (least(held[-1]) > 0)) if self.training else n > 0


def context_bucket(n: np.ndarray) -> np.ndarray:
    return np.minimum(np.floor(np.log2(np.maximum(n, 0) + 1)).astype(int), BUCKETS - 1)


def cell_of(contexts: list[np.ndarray], n: int) -> np.ndarray:
    """A number for the buckets of the two longest contexts of n tokens."""
    cell = np.zeros(n, np.int64)
    for c in contexts[-2:]:
        cell = cell * BUCKETS + context_bucket(c)
    return cell


def em_round(p: np.ndarray, cell: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Expected uses of each estimate by cell. p: one row per event, one column per estimate."""
    share = p * weights[cell]
    share /= share.sum(1, keepdims=True)
    return np.stack([np.bincount(cell, share[:, k], len(weights)) for k in range(p.shape[1])], 1)


def new_weights(uses: np.ndarray) -> np.ndarray:
    """Weights by cell from the expected uses; a cell without events has those of all."""
    total = uses.sum(0)
    every = total / total.sum() if total.sum() > 0 else np.full(len(total), 1 / len(total))
    n = uses.sum(1, keepdims=True)
    out = np.maximum(np.where(n > 0, uses / np.where(n > 0, n, 1), every), 1e-6)
    return out / out.sum(1, keepdims=True)


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_out: int = 2, deleted: int = 3, order: int = 3, rounds: int = 20, settled: float = 1e-3) -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score, score. Texts are dealt to folds by crc32 of the id as text.

    order: the longest n-grams. Expectation-maximisation ends after so many rounds, or when no weight of all events' changes by more than `settled`."""
    no_clash(id_col, SCORED)
    if order < 1:
        raise ValueError("order must be 1 or more")
    rest = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds, F.lit(-1))
    # parts: 0 and 1 train, 1 is the deleted part, 2 is held out
    chunks, buckets = in_teams(chunk_table(docs, id_col, text_col, F.when(rest == held_out, 2).when(rest == deleted, 1).otherwise(0)))
    read = lambda r: Tokens(r["lengths"], r["text"], r["part"])

    def run_of(t: Tokens, k: int, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(t.grams(k)[asked], return_counts=True)

    def first_orders(r: dict, _: Counts | None) -> list[tuple[np.ndarray, np.ndarray]]:
        t = read(r)
        return [run_of(t, k, np.ones(len(t.token), bool)) for k in range(1, min(order, 2) + 1)]

    counted = count_keys(send(chunks, list(range(min(order, 2))), first_orders, buckets, 64), "counts", held_from=1)
    for k in range(3, order + 1):

        def longer(r: dict, counts: Counts | None, k: int = k) -> list[tuple[np.ndarray, np.ndarray]]:
            t = read(r)
            return [run_of(t, k, t.open(*t.counted(counts, k - 1)[::2], k))]

        counted = counted.union(count_keys(send(chunks, [k - 1], longer, buckets, 64, counted), f"counts-{k}", held_from=1))
    total = counted.filter("kind = 0").agg(F.sum("n_keys"), F.sum("n_total"), F.sum("n_part_1")).first()
    distinct, n_all, n_deleted = (int(x or 0) for x in total)
    uniform = 1 / (distinct + 1)
    parts = chunks.select("part", F.size("ids").alias("n")).groupBy("part").agg(F.sum("n").alias("n")).collect()
    texts = {r["part"]: r["n"] for r in parts}
    ends, ends_deleted = texts.get(0, 0) + texts.get(1, 0), texts.get(1, 0)

    def estimates(counts: list[np.ndarray], contexts: list[np.ndarray], n: int) -> np.ndarray:
        """One column per order, the longest first, and the uniform one."""
        found = [c / np.maximum(x, 1) for c, x in zip(counts[:0:-1], contexts[::-1], strict=True)]
        return np.stack([*found, counts[0] / max(n, 1), np.full(len(counts[0]), uniform)], 1)

    def deleted_events(r: pd.Series, found: Counts) -> pd.DataFrame:
        t = read(r)
        counts = [a - b for a, b in zip(*t.counted(found, order)[:2], strict=True)]
        contexts = t.contexts(counts, ends - ends_deleted)
        return pd.DataFrame({"events": [[pack(x.astype(np.uint64)) for x in (*counts, *contexts)]]})

    events = materialise(with_counts(chunks.filter("part = 1"), counted.filter("part = 1"), deleted_events, "events array<binary>"), "events")
    cells = BUCKETS ** min(order - 1, 2)
    weights = np.full((cells, order + 1), 1 / (order + 1))

    def uses_of(weights: np.ndarray) -> np.ndarray:
        def uses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((cells, order + 1))
            for batch in batches:
                for row in batch.column("events").to_pylist():
                    found = [unpack(x, np.uint64).astype(np.int64) for x in row]
                    out += em_round(estimates(found[:order], found[order:], n_all - n_deleted), cell_of(found[order:], len(found[0])), weights)
            at = np.flatnonzero(out)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(out.ravel()[at])], ["at", "uses"])

        out = np.zeros(cells * (order + 1))
        for r in events.mapInArrow(uses, "at int, uses double").groupBy("at").agg(F.sum("uses").alias("uses")).collect():
            out[r["at"]] = r["uses"]
        return out.reshape(cells, order + 1)

    before = None
    for _ in range(rounds):
        uses = uses_of(weights)
        weights, every = new_weights(uses), uses.sum(0) / max(uses.sum(), 1)
        if before is not None and np.abs(every - before).max() <= settled:
            break
        before = every

    def score(r: pd.Series, found: Counts) -> pd.DataFrame:
        t = read(r)
        counts = t.counted(found, order)[0]
        contexts = t.contexts(counts, ends)
        p = (estimates(counts, contexts, n_all) * weights[cell_of(contexts, len(t.token))]).sum(1)
        base = np.log10((counts[0] + 1) / (n_all + distinct + 1))
        add = lambda x: np.add.reduceat(x, t.heads) if len(t.heads) else x[:0]
        out = pd.DataFrame({id_col: pd.array([None if i is None or i != i else int(i) for i in r["ids"]], "Int64")})
        out["held_out"] = bool(r["part"] == 2)
        out["n_tokens"], out["n_known"], out["train_tokens"] = np.diff(t.first), add((counts[0] > 0).astype(np.int64)), n_all
        out["base_score"], out["score"] = add(base), add(np.log10(p))
        return out

    return with_counts(chunks, counted, score, ", ".join([f"`{id_col}` long", *SCORED]))
