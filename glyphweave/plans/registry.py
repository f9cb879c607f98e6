"""The registered queries of the document-affinity operators and their SQL twins, by one name."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..operators import constraints, graph, layout, linking, measures
from . import choice_queries, pair_queries, score_queries  # noqa: F401
from .vector_queries import FARTHEST_SQL, MUTUAL_SQL, NEAREST_SQL
from .catalog import CLEAN, EDGES, L, OVERLAP, REACH, V, W, clean, oracle_sql, queries, register, register_by_word  # noqa: F401


@register("f1_word_score", (W,), " select doc_id, word_id, score from fx_words where score >= 0.1")
def _f1(w):
    return layout.keep_scored(w, 0.1).select("doc_id", "word_id", "score")


@register("f2_line_score", (L,), " select doc_id, line_id, cast(score as double) as score from fx_lines where score >= 0.8")
def _f2(lines):
    return layout.keep_scored(lines, 0.8).select("doc_id", "line_id", F.col("score").cast("double").alias("score"))


@register("f3_worded", (W,), " select doc_id, word_id, text from fx_words where text is not null and length(text) > 0")
def _f3(w):
    return layout.keep_worded(w).select("doc_id", "word_id", "text")


@register("f5_aspect_filter", (W,), CLEAN + " select doc_id, word_id, w, h from clean")
def _f5(w):
    return clean(w).select("doc_id", "word_id", "w", "h")


@register("f7_geometry", (W,), " select doc_id, word_id, l + w as box_right, t + h as box_bottom, w * h as area, l + w / 2 as centre_x, t + h / 2 as centre_y from fx_words")
def _f7(w):
    return w.select("doc_id", "word_id", geo.right().alias("box_right"), geo.bottom().alias("box_bottom"), geo.area().alias("area"), geo.centre_x().alias("centre_x"), geo.centre_y().alias("centre_y"))


@register("f8_geometry_embedding", (W,), " select doc_id, word_id, [l, t, h, w] as vec from fx_words")
def _f8(w):
    return w.select("doc_id", "word_id", F.array("l", "t", "h", "w").alias("vec"))


@register("f13_caps_class", (W,), " select doc_id, word_id, case when regexp_matches(text, '\\p{Lu}') and not regexp_matches(text, '\\p{Ll}') then 0 when regexp_matches(text, '\\p{Ll}') and not regexp_matches(text, '\\p{Lu}') then 1 else 2 end as caps from fx_words")
def _f13(w):
    return w.select("doc_id", "word_id", geo.caps_class(F.col("text")).alias("caps"))


@register("j1_word_line", (W, L), f""", best as (select u.doc_id, u.word_id, v.line_id, {OVERLAP} as overlap from fx_words u join fx_lines v on u.doc_id = v.doc_id where v.score >= 0.8)
select doc_id, word_id, line_id from (select *, row_number() over (partition by doc_id, word_id order by overlap desc, line_id) as k from best where overlap > 0.7) where k = 1""")
def _j1(w, lines):
    return layout.assign_lines(w, layout.keep_scored(lines, 0.8)).select("doc_id", "word_id", "line_id")


@register("f6_line_snap", (W, L), f""", best as (select u.doc_id, u.word_id, v.line_id, u.l, v.t, u.w, v.h, {OVERLAP} as overlap from fx_words u join fx_lines v on u.doc_id = v.doc_id where v.score >= 0.8)
select doc_id, word_id, l, t, w, h from (select *, row_number() over (partition by doc_id, word_id order by overlap desc, line_id) as k from best where overlap > 0.7) where k = 1""")
def _f6(w, lines):
    return layout.assign_lines(w, layout.keep_scored(lines, 0.8)).select("doc_id", "word_id", "l", "t", "w", "h")


@register("j3_overlap_candidates", (W,), f" select u.doc_id, u.word_id as i, v.word_id as j from fx_words u join fx_words v on u.doc_id = v.doc_id and u.word_id <> v.word_id where u.w * u.h >= v.w * v.h and {OVERLAP} > 0.7")
def _j3(w):
    return layout.overlap_candidates(w)


@register("j3_duplicate_boxes", (W,), f""", cand as (select u.doc_id, u.word_id as i, v.word_id as j from fx_words u join fx_words v on u.doc_id = v.doc_id and u.word_id <> v.word_id where u.w * u.h >= v.w * v.h and {OVERLAP} > 0.7),
steps as (select doc_id, i, list(j) as js, row_number() over (partition by doc_id order by i) as k from cand group by doc_id, i),
run as (select distinct doc_id, 0::bigint as k, []::int[] as gone from steps union all
  select r.doc_id, s.k, case when len(list_filter(s.js, lambda j: j > s.i or not list_contains(r.gone, j))) > 0 then list_append(r.gone, s.i) else r.gone end from run r join steps s on s.doc_id = r.doc_id and s.k = r.k + 1),
lost as (select doc_id, unnest(arg_max(gone, k)) as word_id from run group by doc_id)
select w.doc_id, w.word_id from fx_words w anti join lost on lost.doc_id = w.doc_id and lost.word_id = w.word_id""")
def _j3_drop(w):
    return layout.drop_duplicate_boxes(w).select("doc_id", "word_id")


@register("a1_min_sizes", (W,), " select doc_id, least(1.0, min(w)) as min_w, least(1.0, min(h)) as min_h from fx_words group by doc_id")
def _a1(w):
    return layout.min_sizes(w)


@register("a4_area_p20", (W,), " select doc_id, round(quantile_cont(w * h, 0.2), 12) as p20 from fx_words group by doc_id")
def _a4(w):
    return layout.area_p20(w)


@register("j4_horizontal_edges", (W,), CLEAN + EDGES + " select doc_id, src, dst, round(dist, 9) as dist from edges")
def _j4(w):
    return layout.horizontal_edges(clean(w)).withColumn("dist", F.round("dist", 9))


@register("g2_components", (W,), CLEAN + EDGES + REACH + " select doc_id, word_id, root from comp")
def _g2(w):
    return layout.row_roots(clean(w))


@register("g5_phrases", (W,), CLEAN + EDGES + REACH + """ select doc_id, phrase_id, min(l) as l, min(t) as t, max(l + w) - min(l) as w, max(t + h) - min(t) as h,
  string_agg(text, ' ' order by l + w / 2, word_id) as text, count(*) as n_words
from (select clean.*, coalesce(root, clean.word_id) as phrase_id from clean left join comp using (doc_id, word_id)) group by doc_id, phrase_id""")
def _g5(w):
    return layout.phrases(clean(w))


@register("a6_isolated", (W,), """, gaps as (select u.doc_id, u.word_id, greatest(v.l - (u.l + u.w), u.l - (v.l + v.w), 0) as dx, greatest(v.t - (u.t + u.h), u.t - (v.t + v.h), 0) as dy
  from fx_words u join fx_words v on u.doc_id = v.doc_id and u.word_id <> v.word_id),
near as (select doc_id, word_id, min(case when dx = 0 and dy = 0 then 'inf'::double else sqrt(dx * dx + dy * dy) end) as nn from gaps group by doc_id, word_id)
select doc_id, word_id, round(nn, 9) as nn, round(nn, 9) > round(avg(nn) over (partition by doc_id) * 2.0, 9) as isolated from near""")
def _a6(w):
    return layout.nearest_gaps(w).withColumn("nn", F.round("nn", 9))


@register("j17_must_pairs", ("fx_must",), " select distinct u.doc_id, u.word_id as a, v.word_id as b, 1 as label, 1.5::double as confidence from fx_must u join fx_must v on u.doc_id = v.doc_id and u.group_id = v.group_id and u.word_id < v.word_id")
def _j17(m):
    return constraints.group_pairs(m, "group_id", 1, 1.5)


@register("j18_cannot_pairs", ("fx_cannot",), """ select distinct u.doc_id, least(u.word_id, v.word_id) as a, greatest(u.word_id, v.word_id) as b, 0 as label, 1.5::double as confidence
from fx_cannot u join fx_cannot v on u.doc_id = v.doc_id and u.pair_id = v.pair_id where u.side = 'A' and v.side = 'B'""")
def _j18(c):
    return constraints.side_pairs(c)


@register_by_word("j22_height_pairs", (W,), "", "select u.doc_id, u.word_id as a, v.word_id as b from fx_words u join fx_words v on u.doc_id = v.doc_id and u.word_id < v.word_id where greatest(u.h, v.h) >= 1.5 * least(u.h, v.h)")
def _j22(w):
    return constraints.height_pairs(w)


# pages as the views lay them out have 70 words at most
@register("t1_nearest_words", (V,), NEAREST_SQL, packed=True)
def _t1(v):
    return constraints.nearest_columns(v, 6)


@register("t2_farthest_words", (V,), FARTHEST_SQL, packed=True)
def _t2(v):
    return constraints.nearest_columns(v, 3, farthest=True)


@register("t3_mutual_neighbours", (V,), MUTUAL_SQL, packed=True)
def _t3(v):
    return constraints.mutual_in_pages(v, 6, 9)


@register("g5_two_pass", (W,), CLEAN + EDGES + REACH + f""", ph as (select doc_id, phrase_id, min(l) as l, min(t) as t, max(l + w) - min(l) as w, max(t + h) - min(t) as h, string_agg(text, ' ' order by l + w / 2, word_id) as text, count(*) as n
  from (select clean.*, coalesce(root, clean.word_id) as phrase_id from clean left join comp using (doc_id, word_id)) group by doc_id, phrase_id),
s as (select doc_id, least(1.0, min(w)) as min_w from ph group by doc_id),
down as (select u.doc_id, u.phrase_id as a, v.phrase_id as b from ph u join ph v on u.doc_id = v.doc_id and u.phrase_id <> v.phrase_id join s on s.doc_id = u.doc_id
  where u.t + u.h / 2 <= v.t + v.h / 2 and v.l - (u.l + u.w) <= s.min_w / 2 and u.l - (v.l + v.w) <= s.min_w / 2 and greatest(v.t - (u.t + u.h), 0) / ((u.h + v.h) / 2) < 0.8),
ways as (select doc_id, a, b from down union select doc_id, b, a from down),
reach2 as (select doc_id, a, b from ways union select r.doc_id, r.a, e.b from reach2 r join ways e on r.doc_id = e.doc_id and r.b = e.a), comp2 as (select doc_id, a as phrase_id, least(a, min(b)) as root from reach2 group by doc_id, a)
select doc_id, phrase_id, min(l) as l, min(t) as t, max(l + w) - min(l) as w, max(t + h) - min(t) as h, string_agg(text, ' ' order by t + h / 2, id) as text, cast(sum(n) as bigint) as n_words
from (select ph.doc_id, ph.phrase_id as id, coalesce(root, ph.phrase_id) as phrase_id, l, t, w, h, text, n from ph left join comp2 using (doc_id, phrase_id)) group by doc_id, phrase_id""")
def _g5_two(w):
    return linking.two_pass_phrases(clean(w), 0.55, 0.8)


_NER = " ".join(f"when '{k}' then {v}" for k, v in constraints.NER_CODES.items())


@register("f12_ner_code", ("fx_tagged",), f""", t as (select doc_id, word_id, string_split(tagged, ' ') as tokens from fx_tagged),
g as (select *, list_filter(tokens, lambda x: starts_with(x, '<') and ends_with(x, '>') and length(x) > 4) as tags from t),
c as (select *, len(tags) as n, (len(tags) = 0 and len(tokens) = 1) or (len(tags) = 1 and len(tokens) = 2) as alone from g)
select doc_id, word_id, case when alone and starts_with(tokens[1], '$') and regexp_matches(substr(tokens[1], 2), '{constraints.NUMBER}') then 13
  when alone and ends_with(tokens[1], 'g') and regexp_matches(substr(tokens[1], 1, greatest(length(tokens[1]) - 2, 0)), '{constraints.NUMBER}') then 15
  when alone and tokens[1] in ('MAY', 'May') then 11 when n = 1 and len(tokens) = 2 then case substr(tags[1], 4, length(tags[1]) - 4) {_NER} else -1 end when n >= 3 then 14 else -1 end as ner_tag from c""")
def _f12(t):
    return t.select("doc_id", "word_id", constraints.ner_code(F.col("tagged")).alias("ner_tag"))


@register("a15_contingency", (V,), " select doc_id, cast(floor((word_id % 64) / 8) as int) as pred, label as truth, count(*) as n from fx_vec group by all")
def _a15(v):
    return measures.contingency(v.withColumn("row_no", F.floor((F.col("word_id") % 64) / 8).cast("int")), "row_no", "label")


@register("a16_nmi", (V,), """, c as (select doc_id, cast(floor((word_id % 64) / 8) as int) as pred, label as truth, count(*) as n from fx_vec group by all),
m as (select *, sum(n) over (partition by doc_id) as total, sum(n) over (partition by doc_id, pred) as np, sum(n) over (partition by doc_id, truth) as nt from c),
mi as (select doc_id, sum(n / total * ln(n * total / (np * nt))) as mi from m group by doc_id),
hp as (select doc_id, -sum(np / total * ln(np / total)) as h from (select distinct doc_id, pred, np, total from m) group by doc_id),
ht as (select doc_id, -sum(nt / total * ln(nt / total)) as h from (select distinct doc_id, truth, nt, total from m) group by doc_id)
select mi.doc_id, round(coalesce(case when hp.h * ht.h = 0 then 0 else greatest(mi, 0) / sqrt(abs(hp.h * ht.h)) end, 0), 6) as nmi from mi join hp using (doc_id) join ht using (doc_id)""")
def _a16(v):
    return measures.nmi(measures.contingency(v.withColumn("row_no", F.floor((F.col("word_id") % 64) / 8).cast("int")), "row_no", "label"))
