"""The pipeline's stages, chained on the small corpus."""

import re
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
from tokenizers import Tokenizer

from glyphweave.llm import mixing, quality_rules, queries

from test_jaccard_join import by_hand


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts[0] > counts[1] >= counts[2] >= counts[3] > 0 and counts[4] > 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert len(last) == counts[4]
    at = sorted((r["start"], r["n_tokens"]) for r in last)
    assert all(a + n == b for (a, n), (b, _) in zip(at, at[1:], strict=False))


def test_rows_of_stages(spark, sf, docs):
    """Ids, texts and multiplicities after quality, decontamination and mixing, chained, with edge rows."""
    stages, columns = dict(corpus_pipeline.STAGES), docs.columns
    bench = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    item = next(t for _, t in bench if len(t.split()) > 20)
    filler = " ".join(f"prose{i}" for i in range(60))
    bad, end = "click here to go on", " ".join(f"more{i}" for i in range(60))
    odd = [(None, f"{filler}\n{item}", None, "s", 1), (None, f"{filler} null id and clean", None, "s", 1), (300001, f"{filler}\n{bad}\n{end}", None, None, 1), (300001, f"{filler}\n{bad}\n{end}", None, None, 1)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema)).cache()

    clean = stages["quality"](spark, docs, sf).select(*columns).cache()
    want = Counter()
    for r in quality_rules.judge(docs).filter("kept").collect():
        row = r["row"].asDict()
        if r["n_lines_removed"]:
            row |= {"text": r["clean_text"], "n_chars": len(r["clean_text"])}
        want[tuple(row[c] for c in columns)] += 1
    assert Counter(map(tuple, clean.collect())) == want
    assert want[(300001, f"{filler}\n{end}", None, None, len(f"{filler}\n{end}"))] == 2

    # one row of each group of near copies stays: that of the smallest id; rows without an id all do
    ids = [(r["doc_id"], r["text"]) for r in clean.collect()]
    component = {i: c for i, _, c, _ in by_hand(ids) if i is not None}
    single = stages["near_duplicates"](spark, clean, sf).cache()
    every = Counter(map(tuple, clean.collect()))
    stay = Counter({r: n if r[0] is None else 1 for r, n in every.items() if r[0] is None or component[r[0]] == r[0]})
    assert Counter(map(tuple, single.collect())) == stay and len(stay) < len(every)

    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    grams = lambda t: {tuple(w[i : i + 5]) for w in [words(t)] for i in range(len(w) - 4)}
    sets = [g for _, t in bench if (g := grams(t))]
    hit = lambda t, g: any(100 * len(s & g) >= 80 * len(s) for s in sets)
    pure = stages["decontamination"](spark, clean, sf).cache()
    kept = Counter(r for r in map(tuple, clean.collect()) if not hit(r[1], grams(r[1])))
    assert Counter(map(tuple, pure.collect())) == kept and kept[odd[1]] == 1 and kept[odd[0]] == 0 and want[odd[0]] == 1

    times = Counter()
    for r in mixing.mix(pure, shards=len(queries.SHARDS)).collect():
        times[tuple(r["row"])] += len(r["shards"])
    mixed = stages["source_mixing"](spark, pure, sf).cache()
    assert Counter(map(tuple, mixed.collect())) == +times

    tokenizer, want, start = Tokenizer.from_file(queries.tokenizer_path()), [], 0
    for r in sorted(map(tuple, mixed.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        tokens = np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((r[0], start, len(tokens), zlib.crc32(tokens.tobytes())))
        start += len(tokens)
    assert sorted((tuple(r)[:4] for r in stages["token_files"](spark, mixed, sf).collect()), key=lambda r: r[1]) == want


def test_stages_of_empty_and_odd_tables(spark, sf, empty, clashing):
    """Each stage on no rows, on a row of nulls, on equal rows, and with columns of the names that stages use."""
    nulls = spark.createDataFrame([(None, None, None, None, None)] * 2, empty.schema)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0
        got = stage(spark, nulls, sf)
        assert got.count() == (0 if name == "quality" else 2) or name == "source_mixing", name
        odd = stage(spark, clashing.union(clashing), sf)
        assert name == "token_files" or odd.columns == clashing.columns
        assert odd.count() == {"quality": 0, "near_duplicates": 1, "decontamination": 2, "source_mixing": 2, "token_files": 2}[name]
