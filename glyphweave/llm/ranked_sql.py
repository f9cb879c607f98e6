"""DuckDB SQL of the ranked lexical search."""

_TERMS = r"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"

SEARCH = f"""
with d as (select doc_id, row_number() over () as row, text from documents),
words as (select row, {_TERMS} as term from d),
n as (select row, count(*) as n from words group by row),
total as (select count(*) as texts, sum(n)::bigint as terms from n),
asked as (select distinct item_id, term from (select item_id, {_TERMS} as term from benchmark)),
tf as (select row, term, count(*) as tf from words where term in (select term from asked) group by row, term),
w as (select term, floor(1000 * ln((2 * texts + 2)::double / (2 * count(*) + 1)))::bigint as w from tf, total group by term, texts),
scored as (select item_id, row, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * texts) // terms))))::bigint as score
  from asked join tf using (term) join w using (term) join n using (row), total group by item_id, row),
ranked as (select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score from scored join d using (row) where score > 0)
select * from ranked where rank <= 10"""
