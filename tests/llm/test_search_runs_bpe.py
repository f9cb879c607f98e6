"""Ranked search, periodic runs and byte-level BPE against plain Python, with edge rows."""

import hashlib
import math
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from glyphweave.llm import byte_bpe, periodic_runs, queries, ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


def ranked(docs, items, most=10):
    """Rows (item, rank, doc, score) by scoring every text for every item."""
    bags = [(i, Counter(TERM.findall(lowered(t)))) for i, t in docs]
    texts, words = sum(bool(b) for _, b in bags), sum(b.total() for _, b in bags)
    df = Counter(w for _, b in bags for w in b)
    out = []
    for item, text in items:
        scores = []
        for i, bag in bags:
            m = 10 + (90 * bag.total() * texts) // max(words, 1)
            score = sum(math.floor(1000 * math.log((2 * texts + 2) / (2 * df[w] + 1))) * ((1_000_000_000 * bag[w]) // (1000 * bag[w] + 8 * m)) for w in set(TERM.findall(lowered(text))) if w in bag)
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(item, k + 1, None if null else i, -s) for k, (s, null, i) in enumerate(sorted(scores)[:most])]
    return out


ITEMS = [(1, "Mit license, the permission notice"), (2, None), (3, ""), (None, "tok1 tok2 tok19 x"), (5, "x y z x"), (5, "x y z x"), (6, "nowhere-to-be-found-term qqqqq"), (7, "null id Apache one two")]


def test_ranked_search(spark, sf, docs, rows):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string").unionByName(spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text"))
    want = ranked([(r["doc_id"], r["text"]) for r in rows], [tuple(r) for r in bench.collect()])
    order = lambda x: sorted(x, key=repr)
    columns = ["item_id", "rank", "doc_id", "score"]
    for kw in ({}, {"tree_cells": 500, "group_rows": 7}):
        got = [tuple(r) for r in ranked_search.search(docs, bench, **kw).select(*columns).collect()]
        assert order(got) == order(want)


def test_ranked_search_edges(spark, docs, empty, clashing):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert ranked_search.search(empty, bench).count() == 0
    assert ranked_search.search(docs, bench.limit(0)).count() == 0
    copies = spark.createDataFrame([(i % 700, "x y z", "a") for i in range(2000)] + [(5000 + i, "other words", "b") for i in range(4000)], "doc_id long, text string, item string").repartition(7)
    got = [(r["rank"], r["doc_id"]) for r in ranked_search.search(copies, bench.filter("text = 'x y z x'").limit(1)).orderBy("rank").collect()]
    assert got == [(k + 1, i) for k, i in enumerate([0, 0, 0, 1, 1, 1, 2, 2, 2, 3])]
    named = copies.selectExpr("cast(doc_id as string) as doc_id", "text", "item as rank")
    assert [r["doc_id"] for r in ranked_search.search(named, bench.filter("item_id = 5").limit(1)).orderBy("rank").limit(4).collect()] == ["0", "0", "0", "1"]
    assert ranked_search.search(clashing, bench.selectExpr("item_id as words", "text"), item_col="words").columns == ["words", "rank", "doc_id", "score"]
    with pytest.raises(ValueError):
        ranked_search.search(clashing.withColumnRenamed("doc_id", "score"), bench, id_col="score")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.dictionaries(st.integers(0, 7), st.integers(1, 4), max_size=8), min_size=1, max_size=25), st.sets(st.integers(0, 7), min_size=1), st.integers(1, 4), st.randoms())
def test_tree(vectors, asked, most, random):
    """The search keeps all texts that are among the best, ties included, whatever the floor below them."""
    weights = np.array([random.randint(0, 9) for _ in range(8)], np.int64)
    m = np.array([random.randint(1, 99) for _ in vectors], np.int64)
    pairs = [sorted(v.items()) for v in vectors]
    tree = ranked_search.Tree(np.array([len(p) for p in pairs]), np.array([k for p in pairs for k, _ in p], np.int64), np.array([t for p in pairs for _, t in p], np.int64), m, 8)
    every = [sum(int(weights[k]) * int(ranked_search.parts(np.int64(t), m[d])) for k, t in p if k in asked) for d, p in enumerate(pairs)]
    ranks = np.array(sorted(asked))
    bar = max(sorted(every)[-most] if len(every) >= most else 1, 1)
    for floor in (0, bar):
        place, score = tree.search(ranks, weights[ranks], most, floor)
        assert sorted(zip(place.tolist(), score.tolist(), strict=True)) == sorted((d, s) for d, s in enumerate(every) if s >= bar)


def runs_by_hand(words, least=6, times=4):
    out, n = [], len(words)
    periodic = lambda s, size, q: all(words[s + k] == words[s + k + q] for k in range(size - q))
    names = {w: k for k, w in enumerate(dict.fromkeys(words))}
    x = np.array([names[w] for w in words], np.int64)
    for q in range(1, n // times + 1):
        same = np.flatnonzero(np.diff(np.concatenate([[0], (x[:-q] == x[q:]).astype(int), [0]])))
        for a, b in zip(same[::2].tolist(), same[1::2].tolist(), strict=True):
            if b - a + q >= max(least, times * q) and not any(periodic(a, b - a + q, p) for p in range(1, q)):
                out.append((a, b - a + q, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def digest_by_hand(doc_id, text):
    words = SPACED.findall(text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    runs = runs_by_hand(words)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{size},{q}\n" for s, size, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_periodic_runs(spark, sf, docs, rows, tmp_path):
    odd = [(7, "a " * 9), (8, "a b a b a b a b a b c c c c c c c"), (9, "a b c " * 4 + "a b c d " * 5), (10, " x  x " * 6), (11, "aa " * 6 + "b " + "aa " * 7), (12, "a a b " * 3 + "a a"), (13, "p q r s " * 300 + "p"), (None, "z z z z z z z")]
    extra = spark.createDataFrame(odd, "doc_id long, text string")
    path = tmp_path / "documents.parquet"
    docs.select("doc_id", "text").unionByName(extra).write.parquet(str(path))
    got = sorted((tuple(r) for r in queries.op12_periodic_runs(spark, str(tmp_path)).collect()), key=repr)
    want = sorted((digest_by_hand(i, t) for i, t in [*((r["doc_id"], r["text"]) for r in rows), *odd]), key=repr)
    assert got == want and sum(r[1] for r in want) > 10


def test_periodic_runs_edges(spark, empty, clashing):
    assert periodic_runs.digest(periodic_runs.find_runs(empty)).count() == 0
    named = clashing.selectExpr("'k' as doc_id", "'a a a a a a b' as text", "words as runs")
    (row,) = periodic_runs.find_runs(named).collect()
    assert row["doc_id"] == "k" and row["collapsed"] == "a b" and tuple(row["longest"]) == (0, 6, 1) and row["n_words"] == 7
    with pytest.raises(ValueError):
        periodic_runs.find_runs(clashing.withColumnRenamed("doc_id", "runs"), id_col="runs")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=70), max_size=4), st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=9), st.integers(1, 9)), max_size=5))
def test_runs_of_any_words(texts, repeats):
    texts = [*texts, [w for word, n in repeats for w in word * n]]
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    words = np.array([w for t in texts for w in t], np.uint64)
    got = list(zip(*(x.tolist() for x in periodic_runs.find_batch(words, first)), strict=True))
    assert got == [(int(first[d]) + s, size, q) for d, t in enumerate(texts) for s, size, q in runs_by_hand(t)]


@pytest.fixture(scope="session")
def bpe():
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return path, public_tokenizers.PATTERN, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})


ODD_TEXTS = ["a  b \n c", "  ", "\n\n  x", "it's we'll 'S x's", "été 你好 \U0001f600‍ 12 a1b2", "tab\tsep\r\nline\x1c\x85 end ", "x" * 5000, "<|endoftext|>", "\x00\x7f ́a", "naïve--word... ??", "trailing "]


def test_byte_bpe(spark, docs, rows, tmp_path, bpe):
    path, pattern, library = bpe
    odd = [(200 + k, t) for k, t in enumerate(ODD_TEXTS)]
    docs.select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string")).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((tuple(r) for r in queries.op13_byte_bpe(spark, str(tmp_path)).collect()), key=repr)
    sha, want = lambda x: hashlib.sha256(x).hexdigest(), []
    for i, t in [*((r["doc_id"], r["text"]) for r in rows), *odd]:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha((t or "").encode())))
    assert got == sorted(want, key=repr)


def test_byte_bpe_edges(spark, docs, rows, empty, clashing, bpe):
    path, pattern, library = bpe
    assert byte_bpe.digest(byte_bpe.decode(byte_bpe.encode(empty, path, pattern), path)).count() == 0
    small = byte_bpe.encode(docs, path, pattern, most=2000)
    assert Counter((r["doc_id"], bytes(r["ids"])) for r in small.collect()) == Counter((r["doc_id"], np.array(library.encode_ordinary(r["text"] or ""), "<u4").tobytes()) for r in rows)
    together = byte_bpe.encode(docs, path, pattern, most=2000, decoded=True)
    assert Counter(map(repr, together.collect())) == Counter(map(repr, byte_bpe.decode(small, path).collect()))
    empties = spark.createDataFrame([("k", ""), (None, None)], "doc_id string, text string").coalesce(1)
    assert sorted(((r["doc_id"], bytes(r["ids"]), bytes(r["decoded"])) for r in byte_bpe.decode(byte_bpe.encode(empties, path, pattern), path).collect()), key=repr) == [("k", b"", b""), (None, b"", b"")]
    assert byte_bpe.encode(clashing, path, pattern).columns == ["doc_id", "ids"]
    with pytest.raises(Exception, match="not in the vocabulary"):
        byte_bpe.decode(spark.createDataFrame([(bytearray(b"\xff\xff\xff\x00"),)], "ids binary"), path).collect()
    with pytest.raises(ValueError):
        byte_bpe.encode(clashing.withColumnRenamed("doc_id", "ids"), path, pattern, id_col="ids")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t'stre.a1  \u0085")), max_size=30), max_size=5))
def test_pre_tokens(texts):
    """Numbers of the pre-tokens against the pattern on whole texts."""
    import public_tokenizers

    pre = byte_bpe.PreTokens(public_tokenizers.PATTERN)
    numbers, counts = pre.cut(pa.array(texts, pa.string()))
    words = list(pre.numbers)
    want = [regex.findall(public_tokenizers.PATTERN, t) for t in texts]
    assert counts.tolist() == [len(w) for w in want] and [words[k] for k in numbers.tolist()] == [w for ws in want for w in ws]


def test_white_space_as_the_library_has_it(bpe):
    """The pattern's classes are the library's: texts of all characters of the basic plane, a few hundred to a text."""
    _, pattern, library = bpe
    cut = regex.compile(pattern)
    for a in range(0, 0x10000, 256):
        text = "".join(f"a{chr(i)}{chr(i)} b" for i in range(a, a + 256) if not 0xD800 <= i < 0xE000)
        want = [i for w in cut.findall(text) for i in library._encode_single_piece(w.encode())]
        assert library.encode_ordinary(text) == want, hex(a)
