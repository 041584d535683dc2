"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

OP2 = """
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as size,
         md5('0|' || coalesce(cast(doc_id as varchar), '')) as tie
  from documents),
sums as (select source, sum(size)::bigint as source_size from sized group by source),
weighed as (
  select *, case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as w
  from sums),
-- the level: for each source as the first that is not capped, what is left for it and those after it
ranked as (select *, source_size * 2.0::double / w as cap_at from weighed),
levels as (
  select r.source, r.cap_at,
         ((select sum(source_size) from ranked)::double * 1.5::double
           - coalesce((select sum(source_size * 2.0::double) from ranked b where (b.cap_at, coalesce(b.source, chr(1114111))) < (r.cap_at, coalesce(r.source, chr(1114111)))), 0))
         / ((select sum(w) from ranked) - coalesce((select sum(w) from ranked b where (b.cap_at, coalesce(b.source, chr(1114111))) < (r.cap_at, coalesce(r.source, chr(1114111)))), 0)) as level
  from ranked r),
level as (select arg_min(level, cap_at) as level from levels where level < cap_at),
targets as (
  select source, source_size,
         case when level.level is null or cap_at <= level.level then source_size * 2.0::double else w * level.level end as target
  from ranked, level),
classed as (
  select *, case when size < 8 then size else length(bin(size)) * 4 + ((size >> (length(bin(size)) - 3)) & 3) end as class
  from sized),
numbered as (select *, row_number() over (partition by source order by class, tie[1], size, tie, doc_id) as rank from classed),
stepped as (
  select n.doc_id, n.size, t.source_size, t.target, n.rank::double as rank,
         case when t.source_size > 0 then least(2.0::double, t.target / t.source_size) else 0 end as expected,
         ('0x' || substr(md5('offset0|' || coalesce(n.source, chr(0))), 1, 8))::bigint::double / 4294967296.0::double as u
  from numbered n join targets t on n.source is not distinct from t.source)
select doc_id, size::bigint as size, source_size::bigint as source_size, target,
       (least(ceil(expected), floor(expected * rank + u) - floor(expected * (rank - 1) + u)) * size)::bigint as taken,
       least(ceil(expected), floor(expected * rank + u) - floor(expected * (rank - 1) + u))::bigint as copies
from stepped
"""

ORACLES: dict[str, str] = {"op2_mixing": OP2}

OP4 = r"""
with turns as (select distinct conv_id, turn, coalesce(role, 'unknown') as role, coalesce(text, '') as text from conversations),
numbered as (select *, row_number() over (partition by conv_id order by turn nulls last, role nulls first, text nulls first) - 1 as nth from turns),
speakers as (select distinct conv_id, role as speaker from turns where role <> 'system'),
pieces as (
  select n.conv_id, speaker, nth // 128 as part, nth, role = speaker as own,
         case when role = speaker then '<|assistant|>' when role = 'system' then '<|system|>'
              else '<|user:' || replace(replace(role, '\', '\\'), '<|', '<\|') || '|>' end || chr(10) as head,
         replace(replace(text, '\', '\\'), '<|', '<\|') as body
  from numbered n join speakers s on n.conv_id is not distinct from s.conv_id),
placed as (
  select *, head || body || '<|end|>' || chr(10) as piece,
         coalesce(sum(length(head) + length(body) + 8) over (partition by conv_id, speaker, part order by nth rows between unbounded preceding and 1 preceding), 0) + length(head) as body_at
  from pieces)
select conv_id, speaker, part::bigint as part, count(*)::bigint as n_turns, md5(string_agg(piece, '' order by nth)) as rendered_md5,
       coalesce(string_agg(body_at::bigint::varchar || '-' || (body_at + length(body))::bigint::varchar, ',' order by nth) filter (own), '') as spans
from placed group by conv_id, speaker, part
"""

OP3 = r"""
with lines as (
  select doc_id, p - 1 as line_no, line, list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda w: w <> '') as words
  from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as p from documents)),
able as (select *, len(words) as n from lines where len(words) >= 5),
firsts as (select words, n, min((doc_id, line_no)) as place from able group by words, n),
-- every line with a gap in place of a word, and with a gap between two words
gapped as (
  select words, place, words[1:i - 1] || ['<gap>'] || words[i + 1:] as form from firsts, unnest(range(1, n + 1)) t(i) where n >= 10
  union all
  select words, place, words[1:i - 1] || ['<gap>'] || words[i:] from firsts, unnest(range(1, n + 2)) t(i) where n >= 10),
leads as (select md5(array_to_string(form, ' ')) as form, min(place) as place from gapped group by 1 having count(distinct words) > 1),
near as (select distinct g.words from gapped g join leads l on md5(array_to_string(g.form, ' ')) = l.form where l.place < g.place),
verdicts as (
  select a.doc_id, a.line_no, near.words is not null as near, near.words is not null or (a.doc_id, a.line_no) <> f.place as gone
  from able a join firsts f on a.words = f.words left join near on a.words = near.words)
select l.doc_id, count(*)::bigint as n_lines, count(*) filter (gone and not near)::bigint as n_exact, count(*) filter (gone and near)::bigint as n_near,
       md5(coalesce(string_agg(line, chr(10) order by l.line_no) filter (gone is not true), '')) as kept_md5
from lines l left join verdicts v on l.doc_id = v.doc_id and l.line_no = v.line_no
group by l.doc_id
"""

ORACLES |= {"op4_chat": OP4, "op3_lines": OP3}
