"""DuckDB SQL with the rows of the quality query: words, windows and lines are unnested there, one row each."""

from __future__ import annotations

from .quality_rules import CAPITALS, CUT_OFF, DATE_LINE, DATE_WORDS, END_MARK, LINKS, LOWER, ODD_MARKS, PHRASE, SEPARATORS, SHORT, SYMBOLS, UPPER

_WORD = r"'[^\x20\x09-\x0D]+'"



def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


QUALITY = rf"""with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
s as (select r, regexp_extract_all(t, {_WORD}) as ws from d),
w as (select r, unnest(ws) as word, generate_subscripts(ws, 1) as i from s),
g as (select r, i, word as w1, lead(word) over p as w2, lead(word, 2) over p as w3 from w window p as (partition by r order by i)),
repeated as (select r, i from (select r, i, count(*) over (partition by r, w1, w2, w3) as n from g where w3 is not null) where n >= 2),
covered as (select r, count(distinct i + k) as n_repeat_words from repeated, range(3) as x(k) group by r),
split as (select r, unnest(ls) as line, generate_subscripts(ls, 1) as i from (select r, string_split(t, chr(10)) as ls from d)),
counted as (select r, i, line, len(regexp_extract_all(line, {_WORD})) as n, len(regexp_extract_all(line, '{ODD_MARKS}')) as odd, len(regexp_extract_all(line, '[{SEPARATORS}]')) as bars, translate(line, '{UPPER}', '{LOWER}') as low,
  case when regexp_matches(line, '[a-z]') then 0 else len(regexp_extract_all(line, '[A-Z]')) end as capitals, len(regexp_extract_all(line, '{LINKS}')) as links, regexp_matches(line, '{_quoted(END_MARK)}') as ended from split),
items as (select *, n between 1 and {SHORT} and not ended as item from counted),
near as (select *, lag(item, 1, false) over p as b1, lag(item, 2, false) over p as b2, lead(item, 1, false) over p as a1, lead(item, 2, false) over p as a2 from items window p as (partition by r order by i)),
judged as (select *, odd > 0.25 * n or regexp_matches(line, '{CUT_OFF}') or capitals >= {CAPITALS} or bars > 0.25 * n or (links > 0 and 2 * links >= n) or (n between 1 and {DATE_WORDS} and regexp_matches(low, '{DATE_LINE}'))
  or (item and ((b1 and b2) or (b1 and a1) or (a1 and a2))) or (n between 1 and 20 and regexp_matches(low, '{_quoted(PHRASE)}')) as bad from near),
lines as (select r, count(*) filter (bad) as n_lines_removed, cast(coalesce(sum(n) filter (bad), 0) as bigint) as n_words_lost, count(*) filter (n > 0) - count(distinct line) filter (n > 0) as n_dup_lines from judged group by r),
base as (select doc_id, cast(len(ws) as bigint) as n_words, cast(length(array_to_string(ws, '')) as bigint) as word_chars, cast(length(t) - length(regexp_replace(t, '{SYMBOLS}', '', 'g')) as bigint) as n_symbols, n_dup_lines,
  coalesce(n_repeat_words, 0) as n_repeat_words, n_lines_removed, n_words_lost from d join s using (r) join lines using (r) left join covered using (r)),
failed as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from base)
select *, not base_failed and 100 * n_words_lost <= 50 * n_words as kept from failed"""
