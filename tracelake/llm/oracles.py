"""DuckDB SQL for the queries that SQL can express over whole tables."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = r"'[^\x20\x09-\x0D]+'"

OP1 = rf"""with d as (select row_number() over () as rid, doc_id, source, coalesce(text, '') as text from documents),
w as (select rid, regexp_extract_all(text, {_WORDS}) as ws from d),
g as (select rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as g from (select rid, ws, unnest(range(1, len(ws) - 1)) as i from w) x),
again as (select rid, i from (select *, count(*) over (partition by rid, g) as n from g) x where n > 1),
rep as (select rid, count(*) as n from (select distinct rid, i + k as at from again, (select unnest(range(0, 3)) as k) k) x group by rid),
l as (select rid, source, text, i, line, regexp_extract_all(translate(line, '{_UPPER}', '{_LOWER}'), {_WORDS}) as ws from (select rid, source, text, unnest(range(1, len(ls) + 1)) as i, unnest(ls) as line from (select rid, source, text, string_split(text, chr(10)) as ls from d) x) y),
full_ as (select *, array_to_string(ws, ' ') as norm from l where len(ws) > 0),
dup as (select rid, sum(n - 1) as n from (select rid, line, count(*) as n from full_ group by rid, line) x group by rid),
held as (select source, norm, count(distinct text) as n from full_ group by source, norm),
hosts as (select source, count(distinct text) as n from d group by source),
often as (select h.source, h.norm from held h join hosts o on h.source is not distinct from o.source where h.n > 20 and h.n > 0.02 * o.n),
gone as (select f.rid, count(distinct f.norm) as n, sum(len(f.ws)) as words from full_ f join often o on f.source is not distinct from o.source and f.norm = o.norm group by f.rid),
s as (select d.rid, d.doc_id, len(w.ws) as n_words, length(array_to_string(w.ws, ''))::bigint as word_chars, len(regexp_extract_all(d.text, '[#*$%&|<>]')) as n_symbols,
 coalesce(dup.n, 0)::bigint as n_dup_lines, coalesce(rep.n, 0)::bigint as n_repeat_words, coalesce(gone.n, 0)::bigint as n_lines_removed, coalesce(gone.words, 0)::bigint as n_words_removed
 from d join w using (rid) left join dup using (rid) left join rep using (rid) left join gone using (rid))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
 not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and n_words - n_words_removed >= 0.3 * n_words as kept, n_lines_removed, n_words_removed from s"""

_BENCH_WORDS = r"'[^\x01-\x2F\x3A-\x60\x7B-\x7F]+'"

OP3 = rf"""with d as (select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), {_BENCH_WORDS}) as ws from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), {_BENCH_WORDS}) as ws from benchmark),
win as (select distinct item_id, len, window_ from (select item_id, least(len(ws), 10) as len, array_to_string(ws[i:i + 9], ' ') as window_ from (select *, unnest(range(1, greatest(len(ws) - 8, least(len(ws), 1) + 1))) as i from b) x) y),
own as (select rid, len, i, array_to_string(ws[i:i + len - 1], ' ') as window_ from (select rid, len, ws, unnest(range(1, len(ws) - len + 2)) as i from d, (select distinct len from win) k) x),
hit as (select o.rid, o.i, o.len, w.item_id from own o join win w on o.len = w.len and o.window_ = w.window_),
words as (select rid, count(*) as n from (select distinct rid, unnest(range(i, i + len)) as at from hit) x group by rid),
items as (select rid, count(*) as n, string_agg(item, ',' order by item) as list from (select distinct rid, cast(item_id as varchar) as item from hit) x group by rid)
select doc_id, len(ws) as n_words, coalesce(words.n, 0) as n_hit, coalesce(items.n, 0) as n_items, sha256(coalesce(items.list, '')) as items_sha256, coalesce(words.n, 0) > 0 as contaminated
from d left join words using (rid) left join items using (rid)"""

OP5 = rf"""with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), {_WORDS}) as ws from documents),
s as (select distinct doc_id, array_to_string(ws[i:i + 3], ' ') as g from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 2, least(len(ws), 1) + 1))) as i from d) x),
n as (select doc_id, count(*) as n from s group by doc_id),
both_ as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
link as (select a, b from both_ join n x on a = x.doc_id join n y on b = y.doc_id where 100 * k >= 85 * (x.n + y.n - k)),
edge as (select a, b from link union all select b, a from link),
reach(a, b) as (select a, b from edge union select r.a, e.b from reach r join edge e on r.b = e.a)
select d.doc_id, coalesce(n.n, 0) as n_shingles, least(d.doc_id, coalesce((select min(b) from reach where a = d.doc_id), d.doc_id)) as component_id from d left join n on d.doc_id = n.doc_id"""

_ESCAPED = "length({0}) + len(regexp_extract_all({0}, '[<\\[\\\\]'))"

OP10 = f"""with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]')
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256, coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
 sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
 sum(case role when 'user' then 18 + {_ESCAPED.format("text")} when 'assistant' then 6 + {_ESCAPED.format("text")} else 26 + {_ESCAPED.format("text")} + {_ESCAPED.format("role")} end)::bigint as formatted_chars, false as rewrites
from t group by conv_id"""
