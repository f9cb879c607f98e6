"""LM scoring and substring deduplication against plain Python."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from glyphweave.llm import _exchange, lm_scoring, substring_dedup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE_WORD = r"[^\x20\x09-\x0D]+"


def removed_by_hand(rows, window):
    words = [re.findall(SPACE_WORD, r["text"] or "") for r in rows]
    seen = collections.Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for r, w in zip(rows, words, strict=True):
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        out.append((r["doc_id"], len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()))
    return collections.Counter(out)


@pytest.mark.parametrize(("window", "shortest"), [(35, 5), (7, 2), (1, 5), (3000, 5)])
def test_substring_dedup(docs, rows, empty, clashing, window, shortest):
    out = substring_dedup.remove_repeats(docs, window=window, shortest=shortest).collect()
    assert collections.Counter(tuple(r)[:4] for r in out) == removed_by_hand(rows, window)
    assert all(sum(s["to"] - s["from"] + 1 for s in r["spans"]) == r["n_removed"] for r in out)
    if window == 35:
        assert substring_dedup.remove_repeats(empty).count() == 0 and substring_dedup.remove_repeats(clashing).count() == 1
    assert substring_dedup.level_lengths(35, 5) == [5, 9, 18, 35] and substring_dedup.level_lengths(1, 5) == [1]


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_lm_scoring(docs, rows, empty, clashing, order):
    """Counts, expectation-maximisation and scores in plain Python, over n-grams as tuples."""
    rounds = 4
    got = lm_scoring.score_documents(docs, order=order, rounds=rounds, settled=0).collect()
    fold = lambda i: zlib.crc32(str(i).encode()) % 7 if i is not None else -1
    tokens = [([*re.findall(SPACE_WORD, (r["text"] or "").translate(LOWER)), None], r["doc_id"]) for r in rows]

    def grams(t):
        padded = ["<s>"] * (order - 1) + t
        return [tuple(padded[i : i + order]) for i in range(len(t))]

    all_, deleted, texts = collections.Counter(), collections.Counter(), collections.Counter()
    for t, i in tokens:
        if fold(i) != 2:
            texts["all"] += 1
            texts["deleted"] += fold(i) == 3
            for g in grams(t):
                for k in range(order):
                    all_[g[k:]] += 1
                    deleted[g[k:]] += fold(i) == 3
    kept = all_ - deleted
    n, v = sum(c for g, c in all_.items() if len(g) == 1), sum(len(g) == 1 for g in all_)
    n_deleted = sum(c for g, c in deleted.items() if len(g) == 1)

    def estimates(g, counts, total, starts):
        p, cell = [], []
        for k in range(order - 1):
            h = g[k:-1]
            seen = starts if h[-1] == "<s>" else counts[h]
            p.append(counts[g[k:]] / seen if seen else 0)
            cell.append(min(int(math.log2(seen + 1)), 23))
        return tuple(cell[:2]), np.array([*p, counts[g[-1:]] / total, 1 / (v + 1)])

    events = [estimates(g, kept, n - n_deleted, texts["all"] - texts["deleted"]) for t, i in tokens if fold(i) == 3 for g in grams(t)]
    weights, every = {}, np.full(order + 1, 1 / (order + 1))
    for _ in range(rounds):
        uses = collections.defaultdict(lambda: np.zeros(order + 1))
        for cell, p in events:
            share = p * weights.get(cell, every)
            uses[cell] += share / share.sum()
        normal = lambda x: np.maximum(x / x.sum(), 1e-6) / np.maximum(x / x.sum(), 1e-6).sum()
        weights, every = {c: normal(u) for c, u in uses.items()}, normal(sum(uses.values()))
    want = {}
    for t, i in tokens:
        base = sum(math.log10((all_[x,] + 1) / (n + v + 1)) for x in t)
        found = [estimates(g, all_, n, texts["all"]) for g in grams(t)]
        score = sum(math.log10(np.dot(weights.get(c, every), p)) for c, p in found)
        want.setdefault(i, []).append((fold(i) == 2, len(t), sum(all_[x,] > 0 for x in t), n, base, score))
    assert len(got) == len(rows)
    for r in got:
        close = [w for w in want[r["doc_id"]] if tuple(r)[1:5] == w[:4] and math.isclose(w[4], r["base_score"], rel_tol=1e-9) and math.isclose(w[5], r["score"], rel_tol=1e-9)]
        assert close, (tuple(r), want[r["doc_id"]])
    if order == 3:
        held = [r for r in lm_scoring.score_documents(docs).collect() if r["held_out"]]
        assert held and sum(r["score"] for r in held) > sum(r["base_score"] for r in held)  # held-out texts are better predicted than by the base model
        assert lm_scoring.score_documents(empty).count() == 0 and lm_scoring.score_documents(clashing).count() == 1
        with pytest.raises(ValueError, match="name of a result"):
            lm_scoring.score_documents(clashing.withColumnRenamed("doc_id", "score"), "score")


def test_em_recovers_weights():
    rng = np.random.default_rng(3)
    w = np.array([0.6, 0.3, 0.1])
    p = np.stack([rng.random(50_000), rng.random(50_000), np.full(50_000, 0.5)], 1)
    p = p[rng.random(50_000) < p @ w]
    got = np.full((24, 3), 1 / 3)
    for _ in range(100):
        got = lm_scoring.new_weights(lm_scoring.em_round(p, np.full(len(p), 4), got))
    assert np.allclose(got.sum(1), 1) and np.allclose(got[4], w, atol=0.05)


def test_counts_beyond_32_bits(spark):
    """Large counts pass the exchange whole."""
    keys, most = np.array([3, 1 << 63], np.uint64), (1 << 40) + 1
    rows = [_exchange.sent_rows(0, part, chunk, {chunk: (keys, np.array([most, 1], np.uint64))}, 4, 64) for chunk, part in ((1, 0), (2, 1))]
    out = _exchange.count_keys(spark.createDataFrame(sum(rows, []), _exchange.SENT), "large").toPandas()
    for chunk in (1, 2):
        assert _exchange.counts_by_chunk(out[out["team"] == chunk], 0, "counts")[chunk].tolist() == [2 * most, 2]
    assert _exchange.counts_by_chunk(out[out["team"] == 2], 0, "in_part_1")[2].tolist() == [most, 1]
    assert out["n_total"].sum() == 2 * most + 2 and out["n_keys"].sum() == out["n_repeated"].sum() == 2


def test_counts_of_a_team(spark):
    """Runs of several chunks in one row each way, whatever buckets they miss."""
    rng = np.random.default_rng(5)
    runs = {7: np.unique(rng.integers(0, 1 << 63, 300).astype(np.uint64)), 8: np.array([1 << 63], np.uint64), 9: np.zeros(0, np.uint64)}
    runs[10] = np.unique(np.concatenate([runs[7][::3], runs[8]]))
    sent = _exchange.sent_rows(0, 0, 5, {c: (x, np.arange(len(x)) + 1) for c, x in runs.items()}, 6, 64)
    assert len(sent) <= 6
    out = _exchange.count_keys(spark.createDataFrame(sent, _exchange.SENT), "team").toPandas()
    want = collections.Counter()
    for x in runs.values():
        want.update(dict(zip(x.tolist(), range(1, len(x) + 1), strict=True)))
    got = _exchange.counts_by_chunk(out, 0, "counts")
    assert set(got) == {7, 8, 10} and all(got[c].tolist() == [want[k] for k in runs[c].tolist()] for c in got)
    assert out["n_keys"].sum() == len(want) and _exchange.sent_rows(0, 0, 5, {9: (runs[9], runs[9])}, 6, 64) == []


def test_sent_rows_grow_with_teams(spark, monkeypatch):
    """A level sends a row per team and bucket at most, however many chunks the texts are in, and the results do not depend on either."""
    docs = spark.range(400, numPartitions=2).selectExpr("id as doc_id", "concat_ws(' ', transform(sequence(1, 60), x -> cast((x * 7 + id % 23 * x) % 97 as string))) as text")

    def level(docs, chunk, team):
        monkeypatch.setattr(_exchange, "CHUNK", team)
        monkeypatch.setattr(_exchange, "TEAM", team)
        chunks, buckets = _exchange.in_teams(_exchange.chunk_table(docs, "doc_id", "text", most=chunk))
        hashes = lambda r, _: [np.unique(np.array([zlib.crc32(w) for t in _exchange.chunk_texts(r["lengths"], r["text"]).to_pylist() for w in t.encode().split()], np.uint64) << np.uint64(32), return_counts=True)]
        counted = _exchange.count_keys(_exchange.send(chunks, [0], hashes, buckets, 64), "level")
        total = counted.selectExpr("sum(n_keys)", "sum(n_total)").first()
        return chunks.count(), chunks.select("team").distinct().count(), counted.count() / buckets, tuple(total)

    one, two = level(docs, 200, 4000), level(docs.union(docs), 200, 4000)
    alone = level(docs, 200, 200)
    assert one[0] == alone[0] and one[0] > 100 and alone[1] > 4 * one[1] and alone[3] == one[3] and two[3] == (one[3][0], 2 * one[3][1])
    assert one[2] <= one[1] and two[2] <= two[1] and two[1] <= 2 * one[1] + 4

    def results(chunk, team):
        monkeypatch.setattr(_exchange, "CHUNK", team)
        monkeypatch.setattr(_exchange, "TEAM", team)
        table = _exchange.chunk_table
        for module in (substring_dedup, lm_scoring):
            monkeypatch.setattr(module, "chunk_table", lambda *a: table(*a, most=chunk))
        gone = sorted(map(tuple, substring_dedup.remove_repeats(docs, window=9).select("doc_id", "n_removed", "kept_sha256").collect()))
        scores = sorted(map(tuple, lm_scoring.score_documents(docs).collect()))
        monkeypatch.undo()
        return gone, scores

    (gone, scores), (gone_alone, scores_alone) = results(300, 5000), results(1 << 20, 1 << 20)
    assert gone == gone_alone and any(r[1] for r in gone)
    assert all(a[:5] == b[:5] and np.allclose(a[5:], b[5:]) for a, b in zip(scores, scores_alone, strict=True))
