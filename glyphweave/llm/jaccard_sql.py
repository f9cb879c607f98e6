"""DuckDB SQL with the rows of the Jaccard join's query, for tables whose ids are set and differ."""

from __future__ import annotations

JACCARD = r"""with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
w as (select doc_id, len(ws) as n, unnest(ws) as word, generate_subscripts(ws, 1) as i from d),
g as (select doc_id, n, i, word as w1, lead(word) over p as w2, lead(word, 2) over p as w3, lead(word, 3) over p as w4, lead(word, 4) over p as w5 from w window p as (partition by doc_id order by i)),
s as (select distinct doc_id, concat_ws(' ', w1, w2, w3, w4, w5) as shingle from g where w5 is not null or (n < 5 and i = 1)),
size as (select doc_id, count(*) as n from s group by doc_id),
shared as (select u.doc_id as a, v.doc_id as b, count(*) as c from s u join s v on u.shingle = v.shingle and u.doc_id <> v.doc_id group by all),
link as (select a, b from shared join size u on u.doc_id = a join size v on v.doc_id = b where 100 * c >= 80 * (u.n + v.n - c)),
reach as (select a, b from link union select r.a, l.b from reach r join link l on r.b = l.a),
root as (select a as doc_id, min(b) as low from reach group by a),
degree as (select a as doc_id, count(*) as n_links from link group by a)
select doc_id, coalesce(n, 0) as n_shingles, least(doc_id, coalesce(low, doc_id)) as component_id, coalesce(n_links, 0) as n_links
from d left join size using (doc_id) left join root using (doc_id) left join degree using (doc_id)"""
