"""Registration of queries with their SQL twins, and SQL that several twins share."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import layout
from ..sources.pages import duckdb_prefix, page_views

_QUERIES: dict = {}
_SQL: dict[str, str] = {}

OVERLAP = """case when least(u.w * u.h, v.w * v.h) = 0 then 0 else greatest(0, least(u.l + u.w, v.l + v.w) - greatest(u.l, v.l))
  * greatest(0, least(u.t + u.h, v.t + v.h) - greatest(u.t, v.t)) / least(u.w * u.h, v.w * v.h) end"""
CLEAN = """, base as (select * from fx_words where score >= 0.1 and length(text) > 0),
p as (select doc_id, round(quantile_cont(w * h, 0.2), 12) as p20 from base group by doc_id),
clean as (select base.* from base join p using (doc_id) where not (case when round(w * h, 12) > p20 then 2.0 else 5.0 end * w < h))"""
EDGES = """, m as (select doc_id, least(1.0, min(h)) as min_h from clean group by doc_id),
edges as (select u.doc_id, u.word_id as src, v.word_id as dst, greatest(v.l - (u.l + u.w), 0) / greatest(u.h, v.h) as dist
  from clean u join clean v on u.doc_id = v.doc_id and u.word_id <> v.word_id join m on m.doc_id = u.doc_id
  where u.l + u.w / 2 <= v.l + v.w / 2 and abs((u.t + u.h / 2) - (v.t + v.h / 2)) <= min_h / 2 and greatest(v.l - (u.l + u.w), 0) / greatest(u.h, v.h) < 0.55)"""
REACH = """, both_ways as (select doc_id, src as a, dst as b from edges union select doc_id, dst, src from edges),
reach as (select doc_id, a, b from both_ways union select r.doc_id, r.a, e.b from reach r join both_ways e on r.doc_id = e.doc_id and r.b = e.a),
comp as (select doc_id, a as word_id, least(a, min(b)) as root from reach group by doc_id, a)"""


def register(name: str, views: tuple[str, ...], sql: str | None = None, packed: bool = False, given: tuple[str, ...] | None = None):
    """Register f(*views) under a name; sql follows the views' `with` clause. packed: f gets vectors as pages.packed_vectors has them. given: the views that f gets in place of
    those that the SQL is told of, where it makes the same rows of others."""

    def add(f):
        _QUERIES[name] = lambda spark, sf_dir: f(*page_views(spark, sf_dir, *(given or views), packed=packed))
        if sql is not None:
            _SQL[name] = f"{duckdb_prefix(*views)}{sql}"
        return f

    return add


def by_word(found, sums: dict[str, int] | None = None):
    """One row per word a of pairs (doc_id, a, b, ...): their number, the sums of b and of its square, and those of further columns, rounded to so many digits."""
    b = F.col("b").cast("long")
    return found.groupBy("doc_id", "a").agg(F.count("*").alias("n"), F.sum(b).alias("b_sum"), F.sum(b * b).alias("b_squares"), *[F.round(F.sum(c), n).alias(f"{c}_sum") for c, n in (sums or {}).items()])


def register_by_word(name: str, views: tuple[str, ...], ctes: str, select: str, sums: dict[str, int] | None = None, summed: bool = False, packed: bool = False):
    """Register pairs (doc_id, a, b, ...) that are too many to return one by one: all are made, and each word a has one row with their number, the
    sums of b and of its square, and the sums of further columns, rounded to so many digits."""
    sums = sums or {}
    more = "".join(f", round(sum({c}), {n}) as {c}_sum" for c, n in sums.items())
    sql = f"{ctes} select doc_id, a, count(*) as n, cast(sum(b) as bigint) as b_sum, cast(sum(b * b) as bigint) as b_squares{more} from ({select}) group by doc_id, a"

    def add(f):
        rows = (lambda found: found.withColumns({f"{c}_sum": F.round(f"{c}_sum", n) for c, n in sums.items()})) if summed else (lambda found: by_word(found, sums))
        register(name, views, sql, packed)(lambda *frames: rows(f(*frames)))
        return f

    return add


#: Queries that stand first: those that a check of all queries last left out for want of time.
FIRST = [
    "f14_allowed_must", "j13_word_phrase", "j14_word_cluster", "j21_case_pairs", "j23_drop_violating", "g7_ground_truth", "v2_combined", "a4_area_p20", "j18_cannot_pairs", "f12_ner_code", "j16_phrase_pairs", "s1_all_pairs",
    "f19_without_contradictions", "j9_geometric_distance", "j10_box_gaps", "a13_pair_weights", "g6_entity_clusters", "j3_overlap_candidates", "g5_phrases", "j11_affinity_mean", "j11_affinity_middle_without_log", "t3_mutual_neighbours",
]
#: Queries of a million rows and more stand last, in this order, and those that take longest or have no SQL.
LAST = [
    "s2_last_written", "g3_dbscan", "u1_custom_distance", "a12_online_loss", "v4_gram_rbf", "j11_affinity_mean_without_log", "j11_affinity_middle", "j12_embedding_distance", "g1_threshold_graph", "t1_nearest_words", "t2_farthest_words",
    "v8_refined", "v10_epoch_vectors", "v11_principal", "v14_head_scores", "v3_kernel_components", "t4_capped_height_pairs", "t4_capped_ner_case_pairs",
]


def queries() -> dict:
    first, last = ([k for k in names if k in _QUERIES] for names in (FIRST, LAST))
    return {k: _QUERIES[k] for k in [*first, *[k for k in _QUERIES if k not in first and k not in last], *last]}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


W, L, V = "fx_words", "fx_lines", "fx_vec"
M, MV = "fx_members", "fx_mvec"


def clean(words):
    """Scored, worded, not slim: the words that phrases are made of."""
    return layout.drop_slim(layout.keep_worded(layout.keep_scored(words, 0.1)))
