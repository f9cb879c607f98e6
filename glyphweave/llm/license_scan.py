"""License scans: a positional index of rare licence words, with DataFrame functions alone.

1. Each file's licence words are found with their positions in one pass; the hits are written to the shared
   folder (they are few, the texts are not carried on).
2. Document frequencies of the licence words over all files give their IDF. The vocabulary of the templates
   bounds that table.
3. For each template its highest-IDF words are looked up, down to the first that a match cannot lack: a key phrase's word, or the one with which
   the looked-up words' rarity is more than a match may miss. So each match has one of them in place, whichever words an edited copy has
   lost or has elsewhere. A word's positions less its places in the template are possible starts.
4. A start counts when all key phrases of the template stand, word by word, at their places after it, within the drift, and when
   the template's postings, intersected by their places relative to it, cover enough of the rarity of all its words. Of starts that lie no further apart
   than the drift, one after another, the first counts.

Nulls and empty texts have no words, no labels and a score of 0. A text of any length is one row's work, on its licence words alone. Equal starts
of a template count once. Repeated rows give repeated results; a null id stays null. An empty table gives no rows. Other columns are not
read, so their names cannot clash; an id named like a result raises an error.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import materialise, no_clash
from .license_texts import STOP_WORDS, TEMPLATES, Template

#: Runs of ASCII letters and digits and of characters beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
RESULTS = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"]


def places(t: Template) -> list[tuple[str, int]]:
    """The template's indexed words with their places."""
    return [(w, i) for i, w in enumerate(t.text.split()) if w not in STOP_WORDS]


def key_places(t: Template) -> list[tuple[list[str], int]]:
    """The words of each key phrase and its first place in the template."""
    words = t.text.split()
    found = []
    for key in t.keys:
        k = key.split()
        found.append((k, next(i for i in range(len(words)) if words[i : i + len(k)] == k)))
    return found


def vocabulary(templates: list[Template]) -> list[str]:
    """The words whose positions are kept: indexed ones and those of key phrases."""
    return sorted({w for t in templates for w, _ in places(t)} | {w for t in templates for k in t.keys for w in k.split()})


def word_hits(docs: DataFrame, id_col: str, text_col: str, words: list[str]) -> DataFrame:
    """Per file: number of words, and the ascending positions of each licence word that it holds."""
    split = docs.select(F.col(id_col).alias("id"), F.regexp_extract_all(F.coalesce(text_col, F.lit("")), F.lit(WORD), F.lit(0)).alias("words"))
    placed = F.transform("words", lambda w, i: F.struct(F.lower(w).alias("w"), i.alias("pos")))
    hits = split.select("id", F.size("words").cast("long").alias("n_words"), F.filter(placed, lambda h: h["w"].isin(words)).alias("hits"))
    return hits.select("id", "n_words", F.array_distinct(F.transform("hits", lambda h: h["w"])).alias("held"), "hits")


def _literal(rows: list[tuple], fields: str) -> Column:
    """A constant array of structs, in one expression."""
    names = [f.split(":")[0] for f in fields.split(", ")]
    return F.from_json(F.lit(json.dumps([dict(zip(names, r, strict=True)) for r in rows])), f"array<struct<{fields}>>")


def _at(word: Column) -> Column:
    return F.coalesce(F.col("at")[word], F.array().cast("array<int>"))


def _key_stands(words: list[str], place: int, near: Callable[[Column, Column], Column]) -> Callable[[Column], Column]:
    """Whether a key phrase's words follow one another near their place after a start."""
    rest = _literal(list(enumerate(words))[1:], "k:int, w:string") if len(words) > 1 else None
    follow = lambda x: F.lit(True) if rest is None else F.forall(rest, lambda q: F.array_contains(_at(q["w"]), x + q["k"]))
    return lambda s: F.exists(_at(F.lit(words[0])), lambda x: near(x, s + place) & follow(x))


def looked_up(t: Template, idf: dict[str, float]) -> list[tuple[str, int]]:
    """The template's rarest words with their places: one of them at least stands in place in every match."""
    indexed = sorted(places(t), key=lambda p: (-idf[p[0]], p[1]))
    needed = {(w, i + k) for words, i in key_places(t) for k, w in enumerate(words)}
    spare, out = (1 - t.covered) * sum(idf[w] for w, _ in indexed) + 1e-9, []
    for place in indexed:
        out.append(place)
        spare -= idf[place[0]]
        if place in needed or spare < 0:
            break
    return out


def _match(t: Template, idf: dict[str, float]) -> Column:
    """The template's verified starts, and the largest share of its words' IDF that stands in place after one of those."""
    indexed = _literal([(w, i, idf[w]) for w, i in places(t)], "w:string, i:int, idf:double")
    near = lambda x, y: F.abs(x - y) <= t.drift
    lists = F.transform(_literal(looked_up(t, idf), "w:string, i:int"), lambda q: F.transform(_at(q["w"]), lambda x: x - q["i"]))
    starts = F.array_sort(F.array_distinct(F.flatten(lists)))
    for words, i in key_places(t):
        starts = F.filter(starts, _key_stands(words, i, near))
    every = sum(idf[w] for w, _ in places(t))
    share = lambda s: F.aggregate(indexed, F.lit(0.0), lambda a, q: a + F.when(F.exists(_at(q["w"]), lambda x: near(x, s + q["i"])), q["idf"]).otherwise(0.0)) / every
    found = F.filter(F.transform(starts, lambda s: F.struct(s.alias("start"), share(s).alias("share"))), lambda m: m["share"] >= t.covered)
    if t.drift:
        # looked-up words may lie a drift apart, and so may their starts; a chain of those is one match, with the best of its shares
        none = F.array().cast("array<struct<start:int,last:int,share:double>>")
        joins = lambda a, m: F.coalesce(m["start"] - F.get(a, F.size(a) - 1)["last"] <= t.drift, F.lit(False))
        ended = lambda a, m: F.struct(F.get(a, F.size(a) - 1)["start"].alias("start"), m["start"].alias("last"), F.greatest(F.get(a, F.size(a) - 1)["share"], m["share"]).alias("share"))
        fresh = lambda m: F.struct(m["start"].alias("start"), m["start"].alias("last"), m["share"].alias("share"))
        chains = F.aggregate(found, none, lambda a, m: F.when(joins(a, m), F.concat(F.slice(a, 1, F.size(a) - 1), F.array(ended(a, m)))).otherwise(F.concat(a, F.array(fresh(m)))))
        found = F.transform(chains, lambda m: F.struct(m["start"].alias("start"), m["share"].alias("share")))
    return F.struct(F.lit(t.label).alias("label"), F.lit(t.base).alias("base"), found.alias("found"))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[Template] = TEMPLATES) -> DataFrame:
    """Per file: id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches.

    matches: label and start words of each template that was found. score: the largest IDF share of a found
    template's words that stand in their places, 0 when none is found."""
    no_clash(id_col, RESULTS)
    words = vocabulary(templates)
    hits = materialise(word_hits(docs, id_col, text_col, words), "license-hits")
    total = hits.count()
    seen = {r["w"]: r["n"] for r in hits.select(F.explode("held").alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}
    idf = {w: math.log(1 + (total + 1) / (seen.get(w, 0) + 1)) for w in words}

    by_word = F.map_from_arrays("held", F.transform("held", lambda w: F.transform(F.filter("hits", lambda h: h["w"] == w), lambda h: h["pos"])))
    placed = hits.select("id", "n_words", F.when(F.size("held") > 0, by_word).alias("at"))
    matched = [_match(t, idf) for t in templates]
    tried = placed.select("id", "n_words", F.when(F.col("at").isNotNull(), F.filter(F.array(*matched), lambda m: F.size(m["found"]) > 0)).alias("m"))
    found = tried.select("id", "n_words", F.coalesce("m", F.array().cast(tried.schema["m"].dataType)).alias("m"))
    base = F.filter("m", lambda m: m["base"])
    starts = F.flatten(F.transform(base, lambda m: F.transform(m["found"], lambda f: f["start"])))
    joined = lambda ms: F.array_join(F.array_sort(F.array_distinct(F.transform(ms, lambda m: m["label"]))), ",")
    shares = F.flatten(F.transform("m", lambda m: F.transform(m["found"], lambda f: f["share"])))
    return found.select(
        F.col("id").alias(id_col),
        "n_words",
        F.size(starts).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.col("m")).alias("labels"),
        F.least(F.coalesce(F.array_max(shares), F.lit(0.0)), F.lit(1.0)).alias("score"),
        F.transform("m", lambda m: F.struct(m["label"].alias("label"), F.transform(m["found"], lambda f: f["start"]).alias("starts"))).alias("matches"),
    )
