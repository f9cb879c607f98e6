"""Operators that judge a row by itself, against plain Python."""

import collections
import json
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from glyphweave.llm import chat_format, decontaminate, jaccard_join, license_scan, lm_scoring, mixing, quality_rules, queries, sharding, substring_dedup, token_output

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
KEY = lambda r: tuple((v is not None, v) for v in r)


def same(got, want):
    got, want = collections.Counter(map(tuple, got)), collections.Counter(map(tuple, want))
    assert got == want, f"extra {list((got - want).items())[:3]}, missing {list((want - got).items())[:3]}"


def test_license_scan(docs, rows, empty, clashing):
    got = license_scan.scan_licenses(docs).collect()
    phrases = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    want = []
    for r in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (r["text"] or "").translate(LOWER))
        at = [(i, label) for p, label in phrases.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        places = [i for i, _ in at]
        want.append((r["doc_id"], len(words), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at}))))
    same([tuple(r)[:6] for r in got], want)
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in got)
    assert license_scan.scan_licenses(empty).count() == 0
    assert license_scan.scan_licenses(clashing).count() == 1


def labels_by_hand(words, idf, templates):
    """Labels and score of a file's words, template by template, from every start that any of its words may mean."""
    labels, score = set(), 0.0
    for t in templates:
        indexed = license_scan.places(t)
        at = lambda w: [i for i, x in enumerate(words) if x == w]
        for s in sorted({x - i for w, i in indexed for x in at(w)}):
            ok = all(any(words[x : x + len(k)] == k for x in range(max(0, s + i - t.drift), s + i + t.drift + 1)) for k, i in license_scan.key_places(t))
            share = sum(idf[w] for w, i in indexed if ok and any(abs(x - i - s) <= t.drift for x in at(w))) / sum(idf[w] for w, _ in indexed)
            if ok and share >= t.covered:
                labels.add(t.label)
                score = max(score, share)
    return ",".join(sorted(labels)), score


def test_edited_licenses_in_long_files(spark):
    """A copy without some of its rarest words is found, whether or not these stand elsewhere in the file."""
    texts = {t.label: t.text for t in license_scan.TEMPLATES if t.drift}
    filler = "prose of its own that goes on for long " * 400
    made = []
    for label, x in texts.items():
        t = next(t for t in license_scan.TEMPLATES if t.drift and t.label == label)
        keys = {w for k in t.keys for w in k.split()}
        rare = [w for w in sorted({w for w, _ in license_scan.places(t)} - keys, key=x.split().count)][:2]
        edited = " ".join(w for w in x.split() if w not in rare)
        made += [(label, edited), (label, f"{filler} {edited} {filler} {' '.join(rare)} {filler}"), (label, f"{' '.join(rare)} {filler} {edited}")]
    frame = spark.createDataFrame([(k, x) for k, (_, x) in enumerate(made)], "doc_id long, text string")
    got = {r["doc_id"]: (set(r["labels"].split(",")), r["score"]) for r in license_scan.scan_licenses(frame).collect()}
    for k in range(0, len(made), 3):
        found = [made[k][0] in got[k + j][0] for j in range(3)]
        assert found in ([True] * 3, [False] * 3), (made[k][0], found)
    assert sum(made[k][0] in got[k][0] for k in range(0, len(made), 3)) >= 8


def test_license_texts(spark):
    texts = {t.label: t.text for t in license_scan.TEMPLATES if t.drift}
    prose = "some prose before it with words of its own "
    made = [prose + x.upper() + " and after. " + prose for x in texts.values()]
    made += [texts["bsd"].replace("source code", "source, code; of Example Inc."), texts["mit"].replace("without warranty", "with warranty"), texts["gpl"][: len(texts["gpl"]) // 3]]
    made += [texts["mit"] + " " + texts["apache"] + " MIT License " + texts["bsd"], texts["isc"].replace(" copies ", " copies " + prose * 2), prose, "", None, "permission " * 50 + "sublicense", texts["zlib"] * 2]
    rng = np.random.default_rng(4)
    for x in texts.values():  # with words lost and put in
        words = [w for w in x.split() if rng.random() > 0.04]
        made.append(" ".join(f"{w} really" if rng.random() < 0.02 else w for w in words))
    frame = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    words = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (x or "").translate(LOWER)) for x in made]
    seen = collections.Counter(w for x in words for w in set(x))
    idf = {w: math.log(1 + (len(made) + 1) / (seen[w] + 1)) for w in license_scan.vocabulary(license_scan.TEMPLATES)}
    assert not any("k" in w for w in idf)
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in license_scan.scan_licenses(frame).collect()}
    for i, x in enumerate(words):
        labels, score = labels_by_hand(x, idf, license_scan.TEMPLATES)
        # another of a match's starts, within the drift, may have a word more in place
        assert got[i][0] == labels and min(score, 1) - 0.05 <= got[i][1] <= min(score, 1) + 1e-9, (made[i], got[i], labels, score)
    assert all(label in got[i][0].split(",") for i, label in enumerate(texts)) and len(texts) >= 10
    n = len(texts)
    assert [got[n + k][0] for k in range(3)] == ["bsd", "", "gpl"] and {"apache", "bsd", "mit"} <= set(got[n + 3][0].split(","))
    with pytest.raises(ValueError, match="name of a result"):
        license_scan.scan_licenses(frame.withColumnRenamed("doc_id", "score"), "score")


def quality_by_hand(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_quality_rules(docs, rows, empty, clashing):
    out = quality_rules.judge(docs)
    got = [(r["row"]["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in out.collect()]
    want = [(r["doc_id"], *quality_by_hand(r["text"])) for r in rows]
    same(got, want)
    assert out.filter("base_failed and kept").count() == 0
    kept = quality_rules.keep_clean(docs)
    assert kept.columns == docs.columns and kept.count() == out.filter("kept").count()
    assert quality_rules.judge(empty).count() == 0 and quality_rules.judge(clashing).select("row.*").columns == clashing.columns


def bad_lines(text):
    """Which lines fail, in plain Python."""
    lines = text.split("\n")
    words = [re.findall(r"[^\x20\x09-\x0D]+", x) for x in lines]
    end = quality_rules.END_MARK.replace("\\z", r"\Z")
    item = [0 < len(w) <= 4 and not re.search(end, x) for x, w in zip(lines, words, strict=True)]
    out = []
    for i, (x, w) in enumerate(zip(lines, words, strict=True)):
        low, n = x.translate(str.maketrans(quality_rules.UPPER, quality_rules.LOWER)), len(w)
        run = any(a >= 0 and item[a : a + 3] == [True] * 3 for a in (i - 2, i - 1, i))
        phrase = any(re.search(rf"(?<![a-z0-9]){re.escape(p)}(?![a-z0-9])", low) for p in quality_rules.BOILERPLATE)
        date = re.search(quality_rules.DATE_LINE.replace("\\z", r"\Z"), low)
        links = len(re.findall(r"https?://|www[.]", x))
        capitals = sum("A" <= c <= "Z" for c in x) if not re.search("[a-z]", x) else 0
        out.append(
            len(re.findall(quality_rules.ODD_MARKS, x)) > 0.25 * n or x.endswith(("...", "…")) or capitals >= 10 or sum(c in "|»›·" for c in x) > 0.25 * n or (links > 0 and 2 * links >= n)
            or bool(0 < n <= 8 and date) or (item[i] and run) or (0 < n <= 20 and phrase)
        )
    return out


LINES = [
    "Home", "About us", "Contact", "", " ", "The first sentence stands here.", "In the catalog in front of the blog in question.", "Please log in", "LOG IN!", "Mentions légales", "Aviso legal.", "xaviso legal", "Posted on 12/03/2021", "12:30 am",
    "2021-03-12", "They met on 12/03/2021 at noon and left.", "https://a.example/b", "See https://a.example/b for the rest of it.", "www.a.example www.b.example", "Read more about this in the long report that follows below, which has many more words than twenty.",
    "To be continued...", "And so on…", "ALL CAPITALS HERE", "NASA", "ÉCOLE NORMALE SUPÉRIEURE DE PARIS", "a | b | c", "Home › News › Sport", "What?! No!!", "x # y", "one two three four", "one two three four five", "end\r", "Nutzungsbedingungen", "conditions d'utilisation", "\u2028", "Zum Inhalt springen",
]


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from(LINES), max_size=12), min_size=1, max_size=40))
def test_quality_line_rules(spark, texts):
    frame = spark.createDataFrame([(i, "\n".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in quality_rules.judge(frame).collect():
        lines = r["row"]["text"].split("\n")
        bad = bad_lines(r["row"]["text"])
        assert r["clean_text"].split("\n") == ([x for x, b in zip(lines, bad, strict=True) if not b] or [""]), (lines, bad)
        assert r["n_lines_removed"] == sum(bad)


def test_quality_lines(spark):
    prose = " ".join(f"word{i}" for i in range(60)) + "."
    junk = " ".join(f"w{i}$$$" for i in range(10))
    bars = " | ".join(f"m{i}" for i in range(10))
    df = spark.createDataFrame([(1, f"{prose}\n{junk}\n{bars}\nRead our cookie policy"), (2, f"{prose}\n{junk}{junk}{junk} {junk}\n" * 1 + "\n".join(f"a{i}** b{i}**" for i in range(60))), (3, prose)], "doc_id long, text string")
    got = {r["row"]["doc_id"]: r for r in quality_rules.judge(df).collect()}
    assert got[1]["clean_text"] == prose and got[1]["n_lines_removed"] == 3 and got[1]["kept"]
    assert not got[2]["kept"] and not got[2]["base_failed"]
    assert got[3]["kept"] and got[3]["n_lines_removed"] == 0
    assert [r["text"] for r in quality_rules.keep_clean(df).orderBy("doc_id").collect()] == [prose, prose]


def test_mixing(docs, rows, empty, clashing):
    out = mixing.mix(docs, shards=5)
    got = out.collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    per = collections.Counter()
    for r in rows:
        per[r["source"]] += size(r["text"])
    goal = mixing.targets(per, (5, 2, 1), 3, sum(per.values()))
    assert abs(sum(goal.values()) - sum(per.values())) < 1e-6
    assert all(goal[s] <= 3 * per[s] + 1e-6 for s in per)
    took = collections.Counter()
    for r in got:
        row = r["row"]
        assert r["size"] == size(row["text"]) and r["source_size"] == per[row["source"]] and abs(r["target"] - goal[row["source"]]) < 1e-9
        assert r["taken"] == r["size"] * len(r["shards"]) <= 3 * r["size"]
        took[row["source"]] += r["taken"]
    # no source misses by more than half of its longest text
    longest = {s: max(size(r["text"]) for r in rows if r["source"] == s) for s in per}
    assert all(abs(goal[s] - took[s]) <= longest[s] / 2 + 1 for s in per), [(s, goal[s], took[s]) for s in per]
    again = mixing.mix(docs.repartition(7), shards=5).collect()
    assert collections.Counter(map(str, again)) == collections.Counter(map(str, got))
    mixed = mixing.mixed_rows(docs, shards=5)
    assert mixed.columns == docs.columns and mixed.count() == sum(len(r["shards"]) for r in got)
    assert mixing.mix(empty).count() == 0 and mixing.mix(clashing).select("row.*").columns == clashing.columns
    with pytest.raises(ValueError):
        mixing.mix(docs, most_sources=2)


def test_mixing_of_many_sources(spark):
    """More sources than the old cap of 10,000, most of one text, null among them: targets and draws as the rules have them."""
    texts = [(i, "w " * (1 + i % 7), None if i % 5003 == 0 else f"www.{i}.example") for i in range(10_500)]
    texts += [(20_000 + i, "v " * (1 + i % 9), "www.large.example") for i in range(3000)] + [(None, None, "empty"), (30_000, "", "empty")]
    docs = spark.createDataFrame(texts, "doc_id long, text string, source string")
    got = mixing.mix(docs, shards=5).collect()
    per = collections.Counter()
    for _, text, source in texts:
        per[source] += len((text or "").split())
    goal = mixing.targets(per, (5, 2, 1), 3, sum(per.values()))
    took, load = collections.Counter(), collections.Counter()
    for r in got:
        assert r["source_size"] == per[r["row"]["source"]] and abs(r["target"] - goal[r["row"]["source"]]) < 1e-6
        assert r["taken"] == r["size"] * len(r["shards"]) <= 3 * r["size"]
        took[r["row"]["source"]] += r["taken"]
        load.update(r["shards"])
    assert len(got) == len(texts) and len(per) > 10_000
    # each source misses by half of its text at most, which is all there is of most
    assert all(abs(goal[s] - took[s]) <= per[s] / 2 + 1 for s in per)
    assert abs(goal["www.large.example"] - took["www.large.example"]) <= 5
    assert set(load) == set(range(5)) and max(load.values()) < 1.2 * min(load.values())
    again = mixing.mix(docs.repartition(7), shards=5).collect()
    assert collections.Counter(map(str, again)) == collections.Counter(map(str, got))


def test_targets_of_few_texts_are_met_nearly(spark):
    """Sources of one to six texts of any size: the words taken are within half of the longest text of the target."""
    rng = np.random.default_rng(6)
    texts = [(i, "w " * int(rng.integers(0, 400)), f"s{s}") for i, s in enumerate(np.repeat(np.arange(150), rng.integers(1, 7, 150)).tolist())]
    texts += [(9001, "w " * 1000, "x"), (9002, "w " * 1000, "y"), (9003, "w " * 710, "z")]
    docs = spark.createDataFrame(texts, "doc_id long, text string, source string").repartition(4)
    for driver in (1000, 1):
        took, goal, longest = collections.Counter(), {}, collections.Counter()
        for r in mixing.mix(docs, shards=3, driver_sources=driver).collect():
            s = r["row"]["source"]
            took[s] += r["taken"]
            goal[s], longest[s] = r["target"], max(longest[s], r["size"])
            assert r["taken"] == r["size"] * len(r["shards"]) <= 3 * r["size"]
        assert all(abs(goal[s] - took[s]) <= longest[s] / 2 + 1 for s in goal), [(s, goal[s], took[s], longest[s]) for s in goal if abs(goal[s] - took[s]) > longest[s] / 2 + 1]


def test_mixing_of_any_driver_limit(spark, docs):
    """The rows do not depend on where the draws are made."""
    many = docs.unionByName(docs.limit(0)).withColumn("source", F.concat("source", F.pmod(F.col("doc_id"), F.lit(90))))
    for frame in (docs, many):
        here, there = (collections.Counter(map(str, mixing.mix(frame, shards=5, driver_sources=n).select("row", "taken", "shards").collect())) for n in (1000, 1))
        assert here == there


def test_rows_equal_in_id_and_text_stay_in_order(spark):
    rows = [(1, "a b c", "s", k) for k in range(50)] + [(None, "d e", "t", k) for k in range(9)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, other int")
    first, second = (collections.Counter(map(str, mixing.mix(frame.repartition(n), shards=3).collect())) for n in (1, 6))
    assert first == second


def test_splitting_tree():
    rng = np.random.default_rng(3)
    sizes = np.array([5, 0, 3, 9])
    out = mixing.split_quotas(np.array([10, 7]), 4, rng, sizes)
    assert (out.sum(0) == [10, 7]).all() and (out.sum(1) == sizes).all()
    rng = np.random.default_rng(1)
    quotas = np.array([1000, 0, 17, 333])
    out = mixing.split_quotas(quotas, 7, rng)
    assert (out.sum(0) == quotas).all() and out.sum(1).max() - out.sum(1).min() <= 1
    assert mixing.targets({"a": 10, "b": 1000, None: 5}, (5, 2, 1), 3, 1015) == {"a": 30.0, None: 15.0, "b": 970.0}
    assert mixing.targets({"a": 0}, (5,), 3, 0) == {"a": 0.0}


def test_sharding(spark, docs, rows, empty):
    table = sharding.lookup_table([f"s{i}" for i in range(7)], 1009)
    counts = collections.Counter(table)
    assert set(table) == set(range(7)) and max(counts.values()) - min(counts.values()) <= 1
    more = sharding.lookup_table([f"s{i}" for i in range(8)], 1009)
    assert sum(a == b for a, b in zip(table, more, strict=True)) > 0.7 * 1009
    # by hand: shards take turns, each the first free slot of its own permutation
    owner = [-1] * 1009
    orders = [iter([(zlib.crc32(f"offset s{k}".encode()) + i * (zlib.crc32(f"step s{k}".encode()) % 1008 + 1)) % 1009 for i in range(1009)]) for k in range(7)]
    turn = 0
    while -1 in owner:
        owner[next(s for s in orders[turn % 7] if owner[s] < 0)] = turn % 7
        turn += 1
    assert owner == table
    got = sharding.place(docs, "doc_id", queries.SHARDS).collect()
    full = sharding.lookup_table(queries.SHARDS)
    assert sorted([r["doc_id"] for r in got], key=lambda x: (x is not None, x)) == sorted([r["doc_id"] for r in rows], key=lambda x: (x is not None, x))
    assert all(full[r["slot"]] == r["shard"] for r in got)
    assert sharding.place(empty, "doc_id", ["a"]).count() == 0
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.lookup_table(bad)
    with pytest.raises(ValueError):
        sharding.lookup_table(["a"], 10)


def test_write_shards(tmp_path, docs):
    path = str(tmp_path / "out")
    sharding.write_shards(docs, "doc_id", ["a", "b", "c"], path, parts=2)
    back = docs.sparkSession.read.parquet(path)
    assert back.count() == docs.count() and back.select("shard").distinct().count() == 3


def test_token_output(docs, rows, empty, clashing):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    order = sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or ""))
    want, start = [], 0
    for r in order:
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids + [0]
        want.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    out = token_output.write_and_digest(docs, queries.tokenizer_path(), shard_tokens=20_000)
    assert sorted([tuple(r)[:4] for r in out.collect()], key=lambda r: r[1]) == want
    assert token_output.write_and_digest(empty, queries.tokenizer_path()).count() == 0
    assert token_output.write_and_digest(clashing, queries.tokenizer_path()).count() == 1


def piece_ids(t, texts):
    ids, n = t.encode(pa.array(texts, pa.string()))
    return [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] if texts else []


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(alphabet=" \n\tab'sé1.,²_ª \x1c\u2003<|endoft>X漢🙂ǅ", max_size=40), max_size=5))
def test_pieces_equal_whole_texts(texts):
    texts = [*texts, "a <|endoftext|> b", "it's  two", "x \n y", "x\u00a0 \u00a0y", "tail ", " head", " "]
    for t in (token_output.piece_tokenizer(queries.tokenizer_path()), token_output.PieceTokenizer(queries.tokenizer_path().replace("byte_bpe_50k", "word_bpe_49k"), most=2)):
        assert piece_ids(t, texts) == [t.library.encode(x, add_special_tokens=False).ids for x in texts]


def test_pieces_are_kept_in_two_generations():
    t = token_output.PieceTokenizer(queries.tokenizer_path(), most=2)
    for x in ("a b c", "d b", "e f g b", "b c d e f g h"):
        assert piece_ids(t, [x, x]) == [t.library.encode(x, add_special_tokens=False).ids] * 2
        assert len(t.recent) <= 2 and len(t.older) < 12


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("aZ' .,\n\t1é×÷ßĀſ\u0301\u00a0\u3000“日\x1c<|"), max_size=14), max_size=6))
def test_pieces_are_the_library_s_tokens(texts):
    t = token_output.piece_tokenizer(queries.tokenizer_path())
    assert piece_ids(t, texts) == [t.library.encode(x, add_special_tokens=False).ids for x in texts]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=1300), st.integers(6, 9))
def test_wavelet_shard(values, levels):
    ids = np.array(values, np.uint16)
    made = token_output.WaveletShard.build(ids, np.array([3]), np.array([True]), np.array([len(ids)]), levels)
    made = token_output.WaveletShard.from_bytes(made.to_bytes())
    assert made.tokens().tolist() == values
    rng = random.Random(1)
    for i in rng.sample(range(len(values)), min(8, len(values))):
        assert made.access(i) == values[i]
        assert made.count(values[i], i) == values[:i].count(values[i])
        assert made.occurrence(values[i], values[:i].count(values[i])) == i
    assert made.count(41) == 0


def leaks_by_hand(rows, items):
    norm = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    sets = [(i, grams(norm(t))) for i, t in items]
    return sorted([(r["doc_id"], i, round(len(s & g) / len(s), 9)) for r in rows for g in [grams(norm(r["text"]))] for i, s in sets if s and 100 * len(s & g) >= 80 * len(s)], key=KEY)


def test_decontamination(spark, sf, docs, rows, empty, clashing):
    benchmark = spark.read.parquet(f"{sf}/benchmark.parquet")
    text = benchmark.filter("item_id = 3").first()["text"]
    words = text.split()
    near = words[:2] + ["other"] + words[3:]
    more = [(200001, "start " * 3000 + " ".join(words).upper() + " end" * 3000, None, None, None), (200002, " ".join(near), None, None, None), (200003, " ".join(words[: len(words) // 2]), None, None, None)]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema))
    rows = rows + [dict(zip(docs.columns, m, strict=True)) for m in more]
    benchmark = benchmark.unionByName(spark.createDataFrame([(900, None), (901, "too short"), (None, "tok1 tok2 tok3 tok4 tok5 tok6"), (902, text)], "item_id long, text string"))
    want = leaks_by_hand(rows, [tuple(r) for r in benchmark.collect()])
    small = decontaminate.find_leaks(docs, benchmark)
    assert sorted([(a, b, round(c, 9)) for a, b, c in small.collect()], key=KEY) == want and len(want) > 5
    known = benchmark.filter("item_id is not null")
    joined = decontaminate.find_leaks(docs.dropDuplicates(["doc_id"]), known, most_broadcast=0)
    assert sorted([(a, b, round(c, 9)) for a, b, c in joined.collect()], key=KEY) == sorted({w for w in want if w[1] is not None}, key=KEY)
    kept = decontaminate.drop_contaminated(docs, benchmark)
    assert kept.columns == docs.columns and sorted(r["doc_id"] or -1 for r in kept.collect()) == sorted(r["doc_id"] or -1 for r in rows if r["doc_id"] not in {w[0] for w in want})
    assert decontaminate.find_leaks(empty, benchmark).count() == 0 and decontaminate.find_leaks(docs, benchmark.limit(0)).count() == 0
    assert decontaminate.drop_contaminated(clashing, benchmark).columns == clashing.columns
    nulls = spark.range(300).selectExpr("id as item_id", "cast(null as string) as text").unionByName(benchmark)
    assert sorted([(a, b, round(c, 9)) for a, b, c in decontaminate.find_leaks(docs, nulls, most_broadcast=60_000).collect()], key=KEY) == want
    assert decontaminate.askable(nulls, "text").count() < 300


def test_decontamination_by_shuffle(spark):
    """Null and repeated ids of texts and items: the same rows whether the benchmark is sent or joined."""
    words = [" ".join(f"{c}{i}" for i in range(12)) for c in "abcde"]
    texts = [
        (None, words[0]), (None, "x y " + words[1] + " z"), (None, "clean text of a null id here"), (None, None), (None, ""),
        (1, words[0][: len(words[0]) // 2]), (1, words[0][len(words[0]) // 2 :]), (1, "clean text of a shared id here"), (2, words[2]), (2, "another clean text of that id"),
        (3, words[3] + " " + words[4]), (3, words[3] + " " + words[4]), (4, words[4]), (4, words[4]), (5, "short"), (6, words[3].upper()), (7, words[0] + " " + words[1]),
    ]
    items = [(None, words[0]), (None, words[2]), (8, words[1]), (8, words[3] + " tail of the same item id"), (9, words[4]), (9, words[4]), (10, None), (11, ""), (12, "too few words"), (None, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("d", F.lit(1)).withColumn("item_id", F.lit("x"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    key = lambda r: [(x is None, x) for x in r]
    for containment in (0.5, 0.8, 1.0):
        sent, joined = (sorted(map(tuple, decontaminate.find_leaks(docs, bench, containment=containment, most_broadcast=most).collect()), key=key) for most in (32 << 20, 0))
        assert joined == sent and any(r[0] is None for r in sent) and any(r[1] is None for r in sent)
        kept, by_join = (decontaminate.drop_contaminated(docs, bench, containment=containment, most_broadcast=most) for most in (32 << 20, 0))
        assert by_join.columns == docs.columns
        assert sorted(map(tuple, by_join.collect()), key=key) == sorted(map(tuple, kept.collect()), key=key)
    assert joined.count((4, 9, 1.0)) == 4 and (None, None, 1.0) in joined and (2, None, 1.0) in joined


def chats_by_hand(messages, calls, fields):
    """All rows of format_chats in plain Python: (conv_id, turn, kind, call_id, linked, valid, problems, order_turn, order_depth, json)."""
    most = lambda *x: max((v for v in x if v is not None), default=None)
    text = lambda d: json.dumps({k: v for k, v in sorted(d.items()) if v is not None}, separators=(",", ":"), ensure_ascii=False, sort_keys=True)
    first, n = {}, collections.Counter()
    nulls_first = lambda t: tuple((v is not None, v) if not isinstance(v, list) else (True, [(x is not None, x) for x in v]) for v in t)
    for conv, turn, call, tool, arguments, uses in calls:
        if call is not None:
            n[conv, call] += 1
            row = (turn, tool, arguments, uses or [])
            first[conv, call] = min(first.get((conv, call), row), row, key=nulls_first)
    result_turns = collections.defaultdict(list)
    for conv, turn, _, _, of in messages:
        if of is not None:
            result_turns[conv, of].append(turn)
    result_at = {k: min((t for t in v if t is not None), default=None) for k, v in result_turns.items()}
    uses = {k: {(k[0], u) for u in v[3] if (k[0], u) in first} for k, v in first.items()}
    unknown = {k for k, v in first.items() if any(u is not None and (k[0], u) not in first for u in v[3])}
    at = {k: v[0] for k, v in first.items()}
    for _ in range(len(first) + 1):
        at = {k: most(t, *[most(at[u], result_at.get(u)) for u in uses[k]]) for k, t in at.items()}
    tied = {k: {u for u in uses[k] if most(at[u], result_at.get(u)) == at[k] and at[k] is not None} for k in first}
    waits = {k: {u for u in tied[k] if at[u] == at[k]} for k in first}
    depth: dict = {}
    for _ in range(len(first) + 1):
        for k in first:
            if all(u in depth for u in waits[k]):
                depth[k] = max([3 if tied[k] - waits[k] else 1, *[depth[u] + 2 for u in waits[k]]])

    def wrong(tool, arguments, more):
        try:
            v = json.loads(arguments) if arguments is not None else None
        except ValueError:
            v = None
        out = ([] if tool in {f.tool for f in fields} else ["unknown tool"]) + ([] if isinstance(v, dict) else ["arguments are not an object"])
        for f in fields:
            if tool == f.tool:
                x = v.get(f.name) if isinstance(v, dict) else None
                kinds = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict}
                if x is None:
                    out += [f"{f.name} is missing"] * f.required
                elif not isinstance(x, kinds[f.kind]) or (isinstance(x, bool) and f.kind != "boolean"):
                    out.append(f"{f.name} is not {f.kind}")
        return out + more, v

    out = []
    for conv, turn, role, content, of in messages:
        if of is None:
            out.append((conv, turn, "message", None, False, True, (), turn, 0, text({"content": content, "role": role})))
        elif (conv, of) in first:
            k = (conv, of)
            to = most(turn, at[k])
            out.append((conv, turn, "result", of, True, True, (), to, depth.get(k, 1) + 1 if to is not None and to == at[k] else 2, text({"content": content, "name": first[k][1], "role": "tool", "tool_call_id": of})))
        else:
            out.append((conv, turn, "result", of, False, False, ("no such call",), turn, 2, text({"content": content, "role": "tool", "tool_call_id": of})))
    for conv, turn, call, tool, arguments, _ in calls:
        k = (conv, call)
        if call is None:
            found, v = wrong(tool, arguments, [])
            out.append((conv, turn, "call", None, False, False, ("no identifier", *found), turn, 1, text({"arguments": v, "name": tool, "role": "tool_call"})))
            continue
        found, v = wrong(tool, arguments, ["repeated identifier"] * (n[k] > 1) + ["uses an unknown call"] * (k in unknown) + ["circular use"] * (k not in depth))
        later = turn is not None and at[k] is not None and turn > at[k]
        out.append((conv, turn, "call", call, k in result_at, not found, tuple(found), most(turn, at[k]), 1 if later else depth.get(k, 1), text({"arguments": v, "id": call, "name": tool, "role": "tool_call"})))
    return out


CHAT_COLUMNS = ["conv_id", "turn", "kind", "call_id", "linked", "valid", "problems", "order_turn", "order_depth", "json"]
MESSAGES = "conv_id long, turn long, role string, text string, result_of string"
CALLS = "conv_id long, turn long, call_id string, tool string, arguments string, uses array<string>"


def chats(found):
    return [tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in found.select(*CHAT_COLUMNS).collect()]


def test_chat_formatting(spark, sf):
    """The whole table, row by row."""
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    messages, calls = [], []
    for r in turns.collect():
        messages.append((r["conv_id"], r["turn"], r["role"], r["text"], f"{r['conv_id']}:{r['turn'] - 1}" if r["role"] == "assistant" else None))
        if r["role"] == "user":
            arguments = {"words": len(re.split(r"\s+", r["text"].strip(" "))), "prompt": r["text"]}
            calls.append((r["conv_id"], r["turn"], f"{r['conv_id']}:{r['turn']}", "reply", json.dumps(arguments), [f"{r['conv_id']}:{r['turn'] - 2}"] if r["turn"] >= 2 else []))
    got = chats(chat_format.format_chats(*chat_format.from_turns(turns), chat_format.REPLY))
    same(got, chats_by_hand(messages, calls, chat_format.REPLY))
    assert sum(r[4] for r in got) > 50 and len(got) == len(messages) + len(calls)


def test_chat_graphs(spark):
    """Random calls that use one another, before and after, in circles and twice, with nulls and equal rows."""
    rng = np.random.default_rng(9)
    some = lambda *x: x[int(rng.integers(0, len(x)))]
    turn = lambda: some(None, *range(5), *range(5), *range(5))
    conv = lambda: some(None, *range(12))
    name = lambda: some(None, *"abcdefgh", *"abcdefgh", "zz")
    bodies = [None, "{}", "[1]", "{bad", '{"words":2,"prompt":"p"}', '{"prompt":"é","words":1,"more":{"z":1,"b":[1,2,null]}}', '{"words":"2","prompt":1}', '{"words":true,"prompt":"p"}']
    messages = [(conv(), turn(), some("user", "tool", None), some("x", "", None), some(None, name())) for _ in range(300)]
    calls = [(conv(), turn(), name(), some("reply", "nope", None), some(*bodies), [name() for _ in range(int(rng.integers(0, 3)))]) for _ in range(160)]
    calls += calls[:5]
    chain = [(50, 1, f"c{i}", "reply", bodies[4], [f"c{i - 1}"] if i else None) for i in range(4)]
    got = chats(chat_format.format_chats(spark.createDataFrame(messages, MESSAGES), spark.createDataFrame(calls + chain, CALLS), chat_format.REPLY))
    same(got, chats_by_hand(messages, calls + chain, chat_format.REPLY))
    assert {r[3]: r[8] for r in got if r[0] == 50} == {"c0": 1, "c1": 3, "c2": 5, "c3": 7}
    assert any("circular use" in r[6] for r in got) and any("uses an unknown call" in r[6] for r in got) and any("repeated identifier" in r[6] for r in got)


def test_turns_with_nulls_and_repeats(spark):
    """Nulls in any column, equal rows, columns of other names and an empty table."""
    schema = "conv_id long, turn long, role string, text string, call_id string, valid int"
    turns = [(1, 0, "user", "a b", None, 1), (1, 1, "assistant", "c", "x", 1), (1, 2, "user", None, None, 1), (1, 2, "user", None, None, 1), (None, 0, "user", "d", None, 1), (2, None, "assistant", "e", None, None), (3, 0, None, "f", None, 1), (3, 1, "assistant", None, None, 1)]
    frame = spark.createDataFrame(turns, schema)
    messages, calls = [], []
    for conv, turn, role, text, _, _ in turns:
        known = conv is not None and turn is not None
        messages.append((conv, turn, role, text, f"{conv}:{turn - 1}" if role == "assistant" and known else None))
        if role == "user":
            arguments = {"words": len(re.split(r"\s+", text.strip(" ")))} | {"prompt": text} if text is not None else {"words": None}
            calls.append((conv, turn, f"{conv}:{turn}" if known else None, "reply", json.dumps({k: v for k, v in arguments.items() if v is not None}), [f"{conv}:{turn - 2}"] if known and turn >= 2 else None))
    got = chats(chat_format.format_chats(*chat_format.from_turns(frame), chat_format.REPLY))
    same(got, chats_by_hand(messages, calls, chat_format.REPLY))
    assert chat_format.format_chats(*chat_format.from_turns(frame.limit(0)), chat_format.REPLY).count() == 0


def test_ids_that_are_no_integers(spark):
    """Operators that need integers say so at once; the others carry ids as they are."""
    named = spark.createDataFrame([("k1", "a b c d e f g", "s"), (None, None, "s")], "doc_id string, text string, source string")
    for f in (lm_scoring.score_documents, jaccard_join.jaccard_components, jaccard_join.keep_one, substring_dedup.remove_repeats, lambda d: token_output.write_and_digest(d, queries.tokenizer_path())):
        with pytest.raises(TypeError, match="ids must be integers"):
            f(named)
    for f in (license_scan.scan_licenses, lambda d: mixing.mix(d).select("row.doc_id"), lambda d: quality_rules.judge(d).select("row.doc_id")):
        assert sorted(str(r["doc_id"]) for r in f(named).collect()) == ["None", "k1"]


def test_token_output_of_one_id(spark):
    """Texts of one id, and of none, in the order of their texts, over many parts."""
    rng = random.Random(5)
    texts = [(rng.choice([None, 7, 7, 8]), " ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(9)))) for _ in range(300)] + [(7, None)]
    frame = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    got = sorted((r["start"], r["doc_id"], r["n_tokens"]) for r in token_output.write_and_digest(frame, queries.tokenizer_path(), shard_tokens=200).collect())
    tokenizer, want, start = token_output.piece_tokenizer(queries.tokenizer_path()).library, [], 0
    for i, t in sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode())):
        n = len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1
        want.append((start, i, n))
        start += n
    assert got == want


def test_ids_named_like_results(spark, clashing):
    for call in (
        lambda: sharding.place(clashing.withColumnRenamed("doc_id", "slot"), "slot", ["a"], 101),
        lambda: token_output.write_and_digest(clashing.withColumnRenamed("doc_id", "start"), queries.tokenizer_path(), id_col="start"),
        lambda: decontaminate.find_leaks(clashing.withColumnRenamed("doc_id", "item_id"), clashing, "item_id"),
    ):
        with pytest.raises(ValueError, match="name of a result"):
            call()
    assert sharding.place(clashing.withColumnRenamed("doc_id", "a.b").withColumn("slot", F.lit(1)), "a.b", ["x", "y"], 101).columns == ["a.b", "slot", "shard"]


def test_chat_cases(spark):
    messages = spark.createDataFrame(
        [(1, 0, "user", "hi", None), (1, 1, "tool", "late", "b"), (1, 3, "tool", None, "a"), (1, 4, "tool", "x", "zz"), (None, 1, "tool", "n", "a"), (2, None, "user", None, None), (1, 3, "tool", None, "a")], "conv_id long, turn long, role string, text string, result_of string"
    )
    calls = spark.createDataFrame(
        [
            (1, 1, "a", "reply", '{"words": 2, "prompt":"p", "more": {"z":1, "b":[1, 2]}}', 1),
            (1, 2, "b", "reply", '{"prompt": 3}', 1),
            (1, 2, "b", "reply", '{"prompt": 3}', 1),
            (1, 2, "c", "nope", "[1]", 1),
            (1, 2, None, "reply", "{bad", 1),
            (None, 0, "a", None, None, 1),
        ],
        "conv_id long, turn long, call_id string, tool string, arguments string, extra int",
    )
    got = chat_format.format_chats(messages, calls, chat_format.REPLY).collect()
    assert sum(r["kind"] == "call" for r in got) == 6  # those of one identifier are rows of their own
    call = {(r["conv_id"], r["call_id"]): r for r in got if r["kind"] == "call"}
    assert call[1, "a"]["valid"] and call[1, "a"]["linked"]
    assert call[1, "a"]["json"] == '{"arguments":{"more":{"b":[1,2],"z":1},"prompt":"p","words":2},"id":"a","name":"reply","role":"tool_call"}'
    assert call[1, "b"]["problems"] == ["prompt is not string", "words is missing", "repeated identifier"]
    assert call[1, "c"]["problems"] == ["unknown tool", "arguments are not an object"]
    assert call[1, None]["problems"][0] == "no identifier" and call[None, "a"]["linked"]
    late = next(r for r in got if r["kind"] == "result" and r["call_id"] == "b")
    assert (late["order_turn"], late["order_depth"]) == (2, 2)
    unlinked = [r for r in got if r["kind"] == "result" and not r["linked"]]
    assert [r["call_id"] for r in unlinked] == ["zz"] and sum(r["kind"] == "result" for r in got) == 5
    assert chat_format.format_chats(messages.limit(0), calls.limit(0), chat_format.REPLY).count() == 0
