"""DuckDB SQL with the rows of the substring deduplication's and the decontamination's queries: exact windows and shingles as text."""

from __future__ import annotations

_SEVEN = " || ' ' || ".join(["word", *(f"lead(word, {k}) over p" for k in range(1, 7))])
_ALL = " || ' ' || ".join(["seven", *(f"lead(seven, {k}) over p" for k in (7, 14, 21, 28))])

#: Windows of 35 words as five times seven; near a text's end they are null.
REPEATS = rf"""with d as (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
w as (select r, unnest(ws) as word, generate_subscripts(ws, 1) as i from d),
s as (select r, i, {_SEVEN} as seven from w window p as (partition by r order by i)),
e as (select r, i, {_ALL} as x from s window p as (partition by r order by i)),
repeated as (select r, i from (select r, i, count(*) over (partition by x) as n from e where x is not null) where n >= 2),
covered as (select distinct r, i + k as i from repeated, range(35) as x(k)),
k as (select w.r, count(*) as n, count(c.i) as gone, string_agg(word, ' ' order by w.i) filter (c.i is null) as kept from w left join covered c on c.r = w.r and c.i = w.i group by w.r)
select doc_id, coalesce(n, 0) as n_words, coalesce(gone, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join k using (r)"""


def _shingles(table: str, key: str) -> str:
    words = rf"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"select distinct {key}, array_to_string(ws[i:i + 4], ' ') as shingle from (select {key}, ws, unnest(range(1, len(ws) - 3)) as i from (select {key}, {words} as ws from {table}))"


LEAKS = f"""with t as ({_shingles("documents", "doc_id")}), b as ({_shingles("benchmark", "item_id")}), size as (select item_id, count(*) as n from b group by item_id)
select doc_id, item_id, count(*) / any_value(n) as containment from t join b using (shingle) join size using (item_id) group by doc_id, item_id having count(*) >= 0.8 * any_value(n) - 1e-9"""
