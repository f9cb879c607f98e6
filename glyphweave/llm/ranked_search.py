"""Ranked lexical search over document FP-trees.

Each text keeps those of its terms that some item asks for, the most frequent first. Texts whose vectors begin alike share a path of a prefix tree; a tree's
nodes are runs of texts in the order of their vectors, and a node knows the greatest tf of its term and the smallest m among its texts. A search goes
depth first over the item's terms in the tree's order: a state is a node's texts with the greatest score that the terms met so far can give them,
and is dropped where that and the most that the later terms can add stay below the tenth best score found so far. States that remain at the end are
scored exactly. Nothing of equal score is dropped before its id is compared.

One pass over the texts writes the restricted vectors; statistics (texts with a term, all terms, texts of each term) are sums over that table. A task builds
trees of bounded size from its rows, keeps each item's best texts over all of them, and hands these on; a window puts the tasks' answers together. Items
are broadcast in groups of bounded size; a larger benchmark is searched group by group.

A null text has no terms. An item without terms, or whose terms no text has, finds nothing. Equal scores stand by id, null ids last; repeated rows
each count and each may be found. Each row of the benchmark is an item of its own, repeated ones and those with a null id too. A very long text is a tree's member
like any other. Empty tables give no rows. Only ids and texts are read, so other columns cannot clash; an id named like a result raises an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialise, no_clash
from ._exchange import pack, unpack
from ._words import NOT_ALNUM, Texts, blocks

#: States that one step of a search takes from the stack.
STEP = 1024
RESULTS = ["rank", "score"]


class Tree:
    """A document FP-tree. Texts stand in the order of their vectors; a node is a term and a run of texts.

    order: the texts' places in the input. length, rank, tf: each text's number of terms, and the terms and frequencies of all, the most frequent term (rank 0) first."""

    def __init__(self, length: np.ndarray, rank: np.ndarray, tf: np.ndarray, m: np.ndarray, terms: int):
        cuts = np.concatenate([[0], np.cumsum(length)])
        raw = rank.astype(">u4").tobytes()
        keys = [raw[4 * a : 4 * b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        self.order = np.array(sorted(range(len(keys)), key=keys.__getitem__), np.int64)
        n = length[self.order]
        self.first = np.concatenate([[0], np.cumsum(n)])
        row, depth = np.repeat(np.arange(len(n)), n), np.arange(self.first[-1]) - np.repeat(self.first[:-1], n)
        at = np.repeat(cuts[:-1][self.order], n) + depth
        self.rank, self.tf, self.m, self.terms = rank[at].astype(np.int64), tf[at], m[self.order], terms
        self.cell = row * terms + self.rank  # ascending: a text's terms ascend
        shared = self._shared(row, depth, n)
        # at each depth, neighbours whose vectors agree so far are one node
        by_depth = np.argsort(depth, kind="stable")
        row, depth = row[by_depth], depth[by_depth]
        start = np.flatnonzero(shared[row] <= depth)
        node_rank = self.rank[by_depth][start]
        low = row[start]
        size = np.diff(np.append(start, len(row)))
        most = np.maximum.reduceat(self.tf[by_depth], start) if len(start) else start
        least = np.minimum.reduceat(self.m[row], start) if len(start) else start
        # the header table: each term's nodes, in the order of their texts
        header = np.lexsort((low, node_rank))
        self.low, self.high, self.most, self.least = low[header], (low + size)[header], most[header], least[header]
        self.nodes = np.searchsorted(node_rank[header], np.arange(terms + 1))
        self.most_of = np.zeros(terms, np.int64)
        np.maximum.at(self.most_of, self.rank, self.tf)

    def _shared(self, row: np.ndarray, depth: np.ndarray, n: np.ndarray) -> np.ndarray:
        """How many first terms each text has in common with the one before."""
        inside = np.minimum(n, np.concatenate([[0], n[:-1]]))
        both = depth < inside[row]
        here = np.flatnonzero(both)
        there = self.first[np.maximum(row[here] - 1, 0)] + depth[here]
        out = inside.copy()
        differ = here[self.rank[here] != self.rank[there]]
        np.minimum.at(out, row[differ], depth[differ])
        return out

    def search(self, ranks: np.ndarray, weights: np.ndarray, most: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """(place in the input, score) of the texts that may be among the `most` best, whose score is above 0 and `floor` at least.

        ranks: an item's terms, ascending. weights: theirs."""
        held = self.nodes[ranks + 1] > self.nodes[ranks]
        ranks, weights = ranks[held], weights[held]
        least = int(self.m.min()) if len(self.m) else 0
        later = np.concatenate([np.cumsum((weights * parts(self.most_of[ranks], least))[::-1])[::-1], [0]])
        found, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        floor = max(floor, 1)
        # states of a level are runs of texts, no two with a text in common: there are never more than texts
        stack = [(0, np.array([0]), np.array([len(self.m)]), np.array([0]))]
        while stack:
            level, low, high, bound = stack.pop()
            alive = bound + later[level] >= floor
            if not alive.any():
                continue
            low, high, bound = low[alive], high[alive], bound[alive]
            if len(low) > STEP:
                best = np.argsort(-bound, kind="stable")
                low, high, bound = low[best], high[best], bound[best]
                stack.append((level, low[STEP:], high[STEP:], bound[STEP:]))
                low, high, bound = low[:STEP], high[:STEP], bound[:STEP]
            if level == len(ranks):
                rows, score = self._score(low, high, ranks, weights, floor)
                found.append(rows)
                scores.append(score)
                every = np.concatenate(scores)
                if len(every) >= most:
                    floor = max(floor, int(np.partition(every, len(every) - most)[len(every) - most]))
                continue
            stack.append((level + 1, *self._split(low, high, bound, int(ranks[level]), int(weights[level]))))
        rows, score = np.concatenate(found), np.concatenate(scores)
        return self.order[rows[score >= floor]], score[score >= floor]

    def _split(self, low: np.ndarray, high: np.ndarray, bound: np.ndarray, rank: int, weight: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The states below: the term's nodes in each run, with what the term adds at most, and the runs between them as they were."""
        a, b = self.nodes[rank], self.nodes[rank + 1]
        begin, end = np.searchsorted(self.low[a:b], low), np.searchsorted(self.low[a:b], high)
        n = end - begin
        if not n.any():
            return low, high, bound
        node = a + np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
        inside, outside = np.cumsum(n + 1) - n - 1, np.cumsum(n + 1) - 1
        opens, closes = np.ones((n + 1).sum(), bool), np.ones((n + 1).sum(), bool)
        opens[inside], closes[outside] = False, False
        begins, ends = np.empty(len(opens), np.int64), np.empty(len(opens), np.int64)
        begins[inside], begins[opens], ends[outside], ends[closes] = low, self.high[node], high, self.low[node]
        left = np.repeat(bound, n + 1)
        between = begins < ends
        with_term = np.repeat(bound, n) + weight * parts(self.most[node], self.least[node])
        return np.concatenate([self.low[node], begins[between]]), np.concatenate([self.high[node], ends[between]]), np.concatenate([with_term, left[between]])

    def _score(self, low: np.ndarray, high: np.ndarray, ranks: np.ndarray, weights: np.ndarray, floor: int) -> tuple[np.ndarray, np.ndarray]:
        edge = np.zeros(len(self.m) + 1, np.int64)
        np.add.at(edge, low, 1)
        np.add.at(edge, high, -1)
        rows = np.flatnonzero(np.cumsum(edge[:-1]))
        score = np.zeros(len(rows), np.int64)
        for r, w in zip(ranks.tolist(), weights.tolist(), strict=True):
            at = np.searchsorted(self.cell, rows * self.terms + r)
            at[at == len(self.cell)] = 0
            has = self.cell[at] == rows * self.terms + r
            score[has] += w * parts(self.tf[at[has]], self.m[rows[has]])
        stay = score >= floor
        return rows[stay], score[stay]


def parts(tf: np.ndarray, m) -> np.ndarray:
    """What a term's weight is multiplied by."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def term_hashes(texts: list[str | None]) -> list[np.ndarray]:
    """The distinct terms' hashes of each text."""
    t = Texts(pa.array(texts, pa.string()), NOT_ALNUM)
    h = t.hashes()
    return [np.unique(h[a:b]) for a, b in zip(t.first[:-1].tolist(), t.first[1:].tolist(), strict=True)]


def _restricted(docs: DataFrame, id_col: str, text_col: str, vocabulary: np.ndarray) -> DataFrame:
    """The texts' vectors over the vocabulary, some thousands to a row, with what the statistics sum."""
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sent = base.sparkSession.sparkContext.broadcast(vocabulary)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = sent.value
        for block in blocks(batches, "text", 4 << 20):
            t = Texts(block.column("text"), NOT_ALNUM)
            h = t.hashes()
            at = np.searchsorted(terms, h)
            at[at == len(terms)] = 0
            known = np.flatnonzero(terms[at] == h) if len(terms) else np.zeros(0, np.int64)
            of = np.searchsorted(t.first, known, "right") - 1
            cell, tf = np.unique(of * max(len(terms), 1) + at[known], return_counts=True)
            doc, term = np.divmod(cell, max(len(terms), 1))
            kept = np.unique(doc)  # a text without a known term cannot be found; it counts all the same
            held, df = np.unique(term, return_counts=True)
            column = lambda x: pa.array([pack(x)], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([int((t.counts > 0).sum())], pa.int64()), pa.array([int(t.counts.sum())], pa.int64()),
                    pa.ListArray.from_arrays(pa.array([0, len(kept)], pa.int32()), block.column("id").take(pa.array(kept))),
                    column(t.counts[kept]), column(np.bincount(doc, minlength=block.num_rows)[kept]), column(term.astype(np.uint32)), column(tf.astype(np.uint32)),
                    pa.array([held.tolist()], pa.list_(pa.int32())), pa.array([df.tolist()], pa.list_(pa.int64())),
                ],
                ["n_texts", "n_terms", "ids", "counts", "lengths", "terms", "tfs", "held", "df"],
            )

    kind = base.schema["id"].dataType.simpleString()
    return materialise(base.mapInArrow(rows, f"n_texts long, n_terms long, ids array<{kind}>, counts binary, lengths binary, terms binary, tfs binary, held array<int>, df array<long>"), "vectors")


def _best(scored: list[tuple], most: int) -> list[tuple]:
    """The best of (score, id), equal scores by id, null ids last."""
    return sorted(scored, key=lambda x: (-x[0], x[1] is None, x[1] if x[1] is not None else 0))[:most]


def _answers(vectors: DataFrame, items: list[np.ndarray], weights: np.ndarray, rank: np.ndarray, texts: int, words: int, most: int, tree_cells: int) -> DataFrame:
    """item (place in the list), score, id: of each task's trees the best texts of each item. items: their terms' places in the vocabulary.
    rank: a term's place in the order of frequency."""
    sent = vectors.sparkSession.sparkContext.broadcast((items, weights, rank))
    kind = vectors.schema["ids"].dataType.elementType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights, rank = sent.value
        by_rank = np.empty_like(weights)
        by_rank[rank] = weights
        asked = [np.sort(rank[x]) for x in items]
        best: list[list[tuple]] = [[] for _ in items]
        held: list[tuple] = []
        kept_kind = None

        def searched() -> None:
            ids = pa.concat_arrays([x[0] for x in held])
            counts, length, term, tf = (np.concatenate([x[k] for x in held]) for k in range(1, 5))
            held.clear()
            m = np.array([10 + (90 * n * texts) // words for n in counts.tolist()], np.int64)  # of any size
            row = np.repeat(np.arange(len(length)), length)
            order = np.argsort(row * len(rank) + rank[term])
            tree = Tree(length, rank[term][order], tf[order].astype(np.int64), m, len(rank))
            for k, of in enumerate(asked):
                place, score = tree.search(of, by_rank[of], most, best[k][-1][0] if len(best[k]) == most else 0)
                if not len(place):
                    continue
                # of texts with the least score that stays, as many as there may be, only the first by id go on
                if len(place) > 4 * most:
                    by_id = pa.compute.rank(ids.take(pa.array(place)), sort_keys="ascending", null_placement="at_end", tiebreaker="first").to_numpy()
                    first = np.lexsort((by_id, -score))[:most]
                    place, score = place[first], score[first]
                best[k] = _best(best[k] + list(zip(score.tolist(), ids.take(pa.array(place)).to_pylist(), strict=True)), most)

        for batch in batches:
            kept_kind = batch.schema.field("ids").type.value_type
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                arrays = [unpack(row.column(c)[0].as_py(), kind) for c, kind in (("counts", np.int64), ("lengths", np.int64), ("terms", np.uint32), ("tfs", np.uint32))]
                held.append((row.column("ids").flatten(), *arrays))
                if sum(len(x[3]) for x in held) >= tree_cells:
                    searched()
        if held:
            searched()
        out = [(k, score, i) for k, of in enumerate(best) for score, i in of]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], kept_kind)], ["item", "score", "id"])

    return vectors.select("ids", "counts", "lengths", "terms", "tfs").mapInArrow(rows, f"item int, score long, id {kind}")


def search(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", most: int = 10, group_bytes: int = 8 << 20, group_rows: int = 50_000, tree_cells: int = 4_000_000
) -> DataFrame:
    """item id, rank (from 1), id, score: the `most` texts of the highest score above 0 of each item, equal scores by id.

    Items go in groups of about group_bytes of text and group_rows rows; a tree has about tree_cells terms of texts."""
    no_clash(id_col, [item_col, *RESULTS])
    no_clash(item_col, RESULTS)
    asked = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text"))
    size = asked.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    groups = max(1, -(-(size["bytes"] or 0) // group_bytes), -(-size["n"] // group_rows))
    asked = asked if groups == 1 else materialise(asked.withColumn("part", F.floor(F.rand(7) * groups).cast("int")), "items")
    out = None
    for g in range(groups):
        rows = asked.collect() if groups == 1 else asked.filter(F.col("part") == g).drop("part").collect()
        one = _search_group(docs, rows, asked.schema["item_id"].dataType.simpleString(), id_col, text_col, item_col, most, tree_cells)
        out = one if out is None else out.unionByName(one)
    return out


def _search_group(docs: DataFrame, rows: list, item_kind: str, id_col: str, text_col: str, item_col: str, most: int, tree_cells: int) -> DataFrame:
    spark = docs.sparkSession
    hashes = term_hashes([r["text"] for r in rows])
    vocabulary = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)
    vectors = _restricted(docs, id_col, text_col, vocabulary)
    total = vectors.agg(F.sum("n_texts").alias("texts"), F.sum("n_terms").alias("terms")).first()
    texts, words = total["texts"] or 0, total["terms"] or 0
    df = np.zeros(len(vocabulary), np.int64)  # a group's terms at most
    for r in vectors.select(F.explode(F.arrays_zip("held", "df")).alias("x")).groupBy("x.held").agg(F.sum("x.df").alias("n")).toLocalIterator():
        df[r["held"]] = r["n"]
    weights = np.array([math.floor(1000 * math.log((2 * texts + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)
    rank = np.empty(len(df), np.int64)
    rank[np.argsort(-df, kind="stable")] = np.arange(len(df))
    answers = _answers(vectors, [np.searchsorted(vocabulary, h) for h in hashes], weights, rank, texts, max(words, 1), most, tree_cells)
    items = F.broadcast(spark.createDataFrame([(k, r["item_id"]) for k, r in enumerate(rows)], f"item int, item_id {item_kind}"))
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id")))
    ranked = answers.withColumn("rank", place).filter(F.col("rank") <= most)
    return ranked.join(items, "item").select(F.col("item_id").alias(item_col), "rank", F.col("id").alias(id_col), "score")
