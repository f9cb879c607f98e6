"""The Jaccard join against all pairs of small corpora."""

import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from glyphweave.llm import jaccard_join

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1)))}


def by_hand(rows):
    """rows: (id, text). (id, size, component, links) of each."""
    sets = [(i, shingles(t)) for i, t in rows]
    up = list(range(len(sets)))
    root = lambda x: x if up[x] == x else root(up[x])
    links = [0] * len(sets)
    for x in range(len(sets)):
        for y in range(x):
            (i, a), (j, b) = sets[x], sets[y]
            if i is None or j is None or not a or not b or min(len(a), len(b)) < 0.8 * max(len(a), len(b)):
                continue
            both = len(a & b)
            if 100 * both >= 80 * (len(a) + len(b) - both):
                links[x] += 1
                links[y] += 1
                up[root(x)] = root(y)
    low = {}
    for x, (i, _) in enumerate(sets):
        if i is not None:
            low[root(x)] = min(low.get(root(x), i), i)
    return sorted([(i, len(s), low[root(x)] if i is not None else None, links[x]) for x, (i, s) in enumerate(sets)], key=str)


def got(df):
    return sorted([tuple(r) for r in jaccard_join.jaccard_components(df).collect()], key=str)


def near_copies(seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    line = [word() for _ in range(60)]
    rows = []
    for g in range(6):
        original = [word() for _ in range(rng.choice([6, 40, 150, 300]))]
        for _ in range(rng.choice([2, 5, 60])):
            copy = list(original)
            for _ in range(rng.randrange(0, max(1, len(copy) // 40) + 1)):
                copy[rng.randrange(len(copy))] = word()
            copy += [word() for _ in range(rng.choice([0, 0, len(copy) // 30]))]
            rows.append((len(rows) + 10, " ".join(copy)))
    for _ in range(40):
        rows.append((len(rows) + 10, " ".join([word() for _ in range(50)] + line)))
    rng.shuffle(rows)
    return rows


def test_near_copies(spark, monkeypatch):
    rows = near_copies(7)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = by_hand(rows)
    assert got(df) == want and len({r[2] for r in want}) < len(want) - 50
    monkeypatch.setattr(jaccard_join, "SMALL", 6)  # large labels in pairs of blocks, strips of six
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    assert got(df) == want
    kept = jaccard_join.keep_one(df)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({r[2] for r in want})


def test_corpus(spark, docs, rows, empty, clashing):
    want = by_hand([(r["doc_id"], r["text"]) for r in rows])
    assert got(docs) == want
    kept = jaccard_join.keep_one(docs)
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == docs.columns and sorted(map(str, ids)) == sorted([str(x) for x in {r[2] for r in want if r[2] is not None}] + ["None"])
    assert got(empty) == [] and got(clashing) == [(1, 2, 1, 0)] and jaccard_join.keep_one(clashing).columns == clashing.columns


def test_unlike_texts_of_one_id(spark):
    """Rows that share an id: unlike texts all stay, copies and near copies once, whatever the partitions."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    near = a + " more"
    rows = [(7, a), (7, b), (7, a), (7, near), (3, c), (9, c), (9, b + " tail"), (5, ""), (5, ""), (5, None), (None, a), (None, a)]
    want = [(7, {a, near}, 1), (7, {b}, 1), (3, {c}, 1), (5, {""}, 1), (5, {None}, 1), (None, {a}, 2)]
    for n in (1, 4):
        kept = [tuple(r) for r in jaccard_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(n)).collect()]
        assert len(kept) == sum(k for _, _, k in want)
        assert all(sum(i == j and t in texts for j, t in kept) == k for i, texts, k in want), kept


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 30), min_size=1), min_size=1, max_size=8), st.lists(st.sets(st.integers(0, 30), min_size=1), min_size=1, max_size=8))
def test_linked_pairs(left, right):
    arrays = lambda x: [np.array(sorted(s), np.uint64) for s in x]
    want = [[100 * len(a & b) >= 80 * len(a | b) for b in right] for a in left]
    assert jaccard_join.linked_pairs(arrays(left), arrays(right)).tolist() == want
