"""DuckDB SQL for the operators' queries that SQL can express."""

from __future__ import annotations

from tidepool.llm import op05_decontaminate as op5
from tidepool.llm import op06_minhash as op6
from tidepool.llm import op07_quality as op7
from tidepool.llm.op08_warc import OP8_SQL
from tidepool.llm.op11_manifest import OP11_SQL
from tidepool.llm.op13_filter_audit import OP13_SQL

WS = r"[\x20\x09-\x0D]+"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# windows of 100 bytes that start earlier elsewhere; runs of starts that touch are one span
OP4_SQL = """
with d as (select doc_id, encode(coalesce(text, '')) as b, cast(octet_length(encode(coalesce(text, ''))) as bigint) as n from documents),
w as (select doc_id, i, array_slice(b, i + 1, i + 100) as w from (select doc_id, b, unnest(range(n - 99)) as i from d where n >= 100)),
later as (select doc_id, i from (select doc_id, i, row_number() over (partition by w order by doc_id, i) as k from w) where k > 1),
marked as (select doc_id, i, i > lag(i) over (partition by doc_id order by i) + 100 as new from later),
numbered as (select doc_id, i, sum(case when new then 1 else 0 end) over (partition by doc_id order by i) as island from marked),
spans as (select doc_id, min(i) as s, max(i) + 100 as e from numbered group by doc_id, island),
gaps as (
  select doc_id, s as at, coalesce(lag(e) over (partition by doc_id order by s), 0) as f, s as t from spans
  union all select doc_id, 1 + max(e), max(e), null from spans group by doc_id),
kept as (
  select g.doc_id, string_agg(substring(hex(d.b), 2 * g.f + 1, 2 * (coalesce(g.t, d.n) - g.f)), '' order by g.at) as hx
  from gaps g join d on d.doc_id = g.doc_id group by g.doc_id),
sums as (select doc_id, sum(e - s) as removed, count(*) as k from spans group by doc_id)
select d.doc_id, d.n as n_bytes, cast(coalesce(s.removed, 0) as bigint) as n_removed, cast(coalesce(s.k, 0) as bigint) as n_spans,
  case when s.k is null then sha256(d.b) else sha256(unhex(k.hx)) end as kept_sha256
from d left join sums s on s.doc_id = d.doc_id left join kept k on k.doc_id = d.doc_id
"""

_ITEM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
OP5_SQL = f"""
with iw as (select cast(item_id as varchar) as item, regexp_extract_all({LOWER}, '{_ITEM_WORD}') as ws from benchmark),
win as (
  select item, least(len(ws), {op5.WINDOW}) as k, array_to_string(ws[i + 1 : i + least(len(ws), {op5.WINDOW})], ' ') as w
  from (select item, ws, unnest(range(greatest(len(ws) - {op5.WINDOW - 1}, 1))) as i from iw where len(ws) > 0)),
dw as (select doc_id, regexp_extract_all({LOWER}, '{_ITEM_WORD}') as ws from documents),
grams as (
  select doc_id, i, k, array_to_string(ws[i + 1 : i + k], ' ') as w
  from (select doc_id, ws, k, unnest(range(len(ws) - k + 1)) as i from dw, (select distinct k from win) where len(ws) >= k)),
hits as (select g.doc_id, g.i, g.k, win.item from grams g join win on win.k = g.k and win.w = g.w),
covered as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + k)) as p from hits) group by doc_id),
items as (select doc_id, count(*) as n, string_agg(item, ',' order by item) as s from (select distinct doc_id, item from hits) group by doc_id)
select d.doc_id, cast(len(d.ws) as bigint) as n_words, cast(coalesce(c.n, 0) as bigint) as n_hit, cast(coalesce(i.n, 0) as bigint) as n_items,
  sha256(coalesce(i.s, '')) as items_sha256, coalesce(c.n, 0) > 0 as contaminated
from dw d left join covered c on c.doc_id = d.doc_id left join items i on i.doc_id = d.doc_id
"""

OP6_SQL = f"""
with recursive dw as (
  select doc_id, list_filter(regexp_split_to_array({LOWER}, '{WS}'), lambda x: x <> '') as ws from documents),
sh as (
  select distinct doc_id, array_to_string(ws[i + 1 : i + least(len(ws), {op6.SHINGLE})], ' ') as s
  from (select doc_id, ws, unnest(range(greatest(len(ws) - {op6.SHINGLE - 1}, 1))) as i from dw where len(ws) > 0)),
n as (select doc_id, count(*) as n from sh group by doc_id),
pairs as (
  select a.doc_id as u, b.doc_id as v, count(*) as common from sh a join sh b on a.s = b.s and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id),
links as (
  select u, v from pairs join n x on x.doc_id = u join n y on y.doc_id = v where 100 * common >= {op6.PERCENT} * (x.n + y.n - common)),
reach(u, v) as (select doc_id, doc_id from n union select r.u, l.v from reach r join links l on l.u = r.v),
comp as (select u, min(v) as c from reach group by u)
select d.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, coalesce(comp.c, d.doc_id) as component_id,
  d.doc_id = coalesce(comp.c, d.doc_id) as kept
from dw d left join n on n.doc_id = d.doc_id left join comp on comp.u = d.doc_id
"""


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_SYMBOLS = "[#*$%&|<>]"
_PHRASES = " or ".join(f"contains(lower(l), {_q(p)})" for p in op7.BOILERPLATE)
OP7_SQL = f"""
with d as (
  select doc_id, coalesce(text, '') as t, list_filter(regexp_split_to_array(coalesce(text, ''), '{WS}'), lambda x: x <> '') as ws from documents),
grams as (
  select doc_id, i, array_to_string(ws[i + 1 : i + {op7.WINDOW}], ' ') as w
  from (select doc_id, ws, unnest(range(len(ws) - {op7.WINDOW - 1})) as i from d where len(ws) >= {op7.WINDOW})),
again as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, w) as k from grams) where k > 1),
repeats as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + {op7.WINDOW})) as p from again) group by doc_id),
raw as (select doc_id, unnest(string_split(t, chr(10))) as l, unnest(range(len(string_split(t, chr(10))))) as i from d),
lines as (select doc_id, l, length(l) as n, row_number() over (partition by doc_id, l order by i) > 1 as seen from raw),
judged as (
  select doc_id, n, seen, regexp_matches(l, '[^\\x20\\x09-\\x0D]') as has_word,
    regexp_matches(l, '[^\\x20\\x09-\\x0D]') and (
      (n - length(regexp_replace(l, '{_SYMBOLS}', '', 'g')) > n * {op7.MAX_SYMBOL_SHARE}) or not regexp_matches(l, '[\\p{{L}}\\p{{N}}]')
      or (n <= {op7.MENU_CHARS} and regexp_matches(l, {_q(op7.MENU_RE)}))
      or (len(regexp_split_to_array(l, {_q(op7.SEPARATORS_RE)})) >= {op7.MIN_ENTRIES}
          and n <= {op7.ENTRY_CHARS} * len(regexp_split_to_array(l, {_q(op7.SEPARATORS_RE)})))
      or (n <= {op7.BOILERPLATE_CHARS} and ({_PHRASES})) or (seen and n >= {op7.MIN_REPEAT_CHARS})) as bad
  from lines),
per_doc as (
  select doc_id, sum(case when has_word and seen then 1 else 0 end) as dup, sum(case when bad then 1 else 0 end) as bad,
    sum(case when bad then n else 0 end) as lost
  from judged group by doc_id),
f as (
  select d.doc_id, len(d.ws) as n_words, length(d.t) as chars, length(array_to_string(d.ws, '')) as word_chars,
    length(d.t) - length(regexp_replace(d.t, '{_SYMBOLS}', '', 'g')) as n_symbols, p.dup, coalesce(r.n, 0) as rep, p.bad, p.lost
  from d join per_doc p on p.doc_id = d.doc_id left join repeats r on r.doc_id = d.doc_id),
g as (select *, n_words < {op7.MIN_WORDS} or 100 * rep > {op7.MAX_REPEAT_PCT} * n_words as base_failed from f)
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols,
  cast(dup as bigint) as n_dup_lines, cast(rep as bigint) as n_repeat_words, cast(bad as bigint) as n_bad_lines, cast(lost as bigint) as lost_chars,
  base_failed, not base_failed and lost <= chars * {op7.MAX_LOST} as kept
from g
"""

ORACLE = {
    "op4_suffix_dedup": OP4_SQL,
    "op5_decontaminate": OP5_SQL,
    "op6_minhash_near_dedup": OP6_SQL,
    "op7_quality_rules": OP7_SQL,
    "op8_warc": OP8_SQL,
    "op11_merkle_manifest": OP11_SQL,
    "op13_filter_audit": OP13_SQL,
}
