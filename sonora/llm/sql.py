"""DuckDB SQL of the queries that SQL can express."""

_W = r"[^\x20\x09-\x0D]+"

OP1 = rf"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
w as (select r, regexp_extract_all(t, '{_W}') as ws from d),
p as (select r, i, ws[i] || chr(0) || ws[i + 1] || chr(0) || ws[i + 2] as g from w, lateral (select unnest(range(1, len(ws) - 1)) as i)),
g as (select r, i, count(*) over (partition by r, g) as c from p),
rep as (select r, count(distinct i + k) as n_repeat_words from g, (values (0), (1), (2)) v(k) where c > 1 group by r),
l as (select r, unnest(string_split(t, chr(10))) as line from d),
lg as (select r, line, count(*) as c from l where regexp_matches(line, '{_W}') group by r, line),
li as (select r, sum(c)::bigint as n_lines, sum(c - 1)::bigint as n_dup_lines, sum((c - 1) * strlen(line))::bigint as dup_line_bytes from lg group by r),
m as (
  select d.doc_id, len(w.ws)::bigint as n_words, list_sum(list_transform(w.ws, lambda x: length(x)))::bigint as wc,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
    coalesce(li.n_dup_lines, 0)::bigint as n_dup_lines, coalesce(rep.n_repeat_words, 0)::bigint as n_repeat_words,
    coalesce(li.n_lines, 0)::bigint as n_lines, coalesce(li.dup_line_bytes, 0)::bigint as dup_line_bytes, strlen(t)::bigint as n_bytes,
    length(regexp_replace(t, '[^A-ZÀ-ÖØ-Þ]', '', 'g'))::bigint as n_upper,
    length(regexp_replace(t, '[^A-Za-z\x{{00C0}}-\x{{10FFFF}}]', '', 'g'))::bigint as n_letters,
    len(list_distinct(w.ws))::bigint as n_distinct
  from d join w using (r) left join li using (r) left join rep using (r)),
b as (
  select * exclude (wc), coalesce(wc, 0)::bigint as word_chars,
    [n_words < 50, 100 * n_repeat_words > 50 * n_words, n_words > 1000000, coalesce(wc, 0) < 2 * n_words or coalesce(wc, 0) > 15 * n_words,
     10 * n_symbols > n_words, 10 * n_dup_lines > 3 * n_lines, 10 * dup_line_bytes > 3 * n_bytes, 10 * n_upper > 5 * n_letters,
     10 * n_letters < 6 * coalesce(wc, 0), n_words >= 50 and 100 * n_distinct < 5 * least(n_words, 2000)] as f
  from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (f[1] or f[2]) as base_failed, not list_bool_or(f) as kept,
  list_sum([case when f[i] then 1::bigint << (i - 1) else 0 end for i in range(1, 11)])::bigint as fail_bits,
  [['too_short', 'repeated_windows', 'too_long', 'word_length', 'symbols', 'repeated_lines', 'repeated_line_bytes', 'upper_case', 'few_letters', 'few_distinct'][i] for i in range(1, 11) if f[i]] as failed,
  n_lines, dup_line_bytes, n_bytes, n_upper, n_letters, n_distinct
from b
"""

OP7 = """
with u as (select page_id, split_part(substr(url, strpos(url, '://') + 3), '#', 1) as rest from pages where strpos(url, '://') > 0
  union all select page_id, '' from pages where url is null or strpos(url, '://') = 0),
h as (
  select page_id, translate(regexp_extract(rest, '^[^/?]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    split_part(substr(rest, length(regexp_extract(rest, '^[^/?]*')) + 1), '?', 1) as path, substr(rest, length(regexp_extract(rest, '^[^/?]*')) + 1) as tail from u),
r(action, rhost, rpath) as (values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
m as (
  select h.*, (select max_by(rhost || rpath, length(rhost || rpath)) from r where (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath)) as rule,
    (select max_by(action, length(rhost || rpath)) from r where (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath)) as action,
    [x.p for x in [{'p': '*casino*' || chr(0) || '*', 'f': contains(host, 'casino')}, {'p': '*cheap-pills*' || chr(0) || '*', 'f': contains(host, 'cheap-pills')},
      {'p': '*free-bets*' || chr(0) || '*', 'f': contains(host, 'free-bets')}, {'p': '*spam-farm*' || chr(0) || '*', 'f': contains(host, 'spam-farm')},
      {'p': '*adult-*' || chr(0) || '*', 'f': contains(host, 'adult-')}, {'p': '*ads-track*' || chr(0) || '*', 'f': contains(host, 'ads-track')},
      {'p': '*' || chr(0) || '*/wp-admin/*', 'f': contains(tail, '/wp-admin/')}, {'p': '*' || chr(0) || '*.exe', 'f': ends_with(tail, '.exe')}] if x.f] as matched
  from h)
select page_id, host, path, rule, coalesce(action, case when len(matched) > 0 then 'block' else 'allow' end) as verdict, matched from m
"""

OP6 = r"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as txt from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
t as (
  select *, replace(replace(replace(txt, '\', '\b'), '</turn>', '\e'), '###', '\h') as body,
    '### ' || replace(replace(replace(replace(role, '\', '\b'), '</turn>', '\e'), '###', '\h'), ':', '\c') || ': ' as head,
    len(regexp_extract_all(txt, '[^\x20\x09-\x0D]+')) + 4 as tokens
  from c),
a as (select *, row_number() over o as pos from t window o as (partition by conv_id order by turn nulls first, role, body)),
s as (
  select *, coalesce(sum(case when pos = 1 and role = 'system' then 0 else tokens end) over (partition by conv_id order by pos rows between unbounded preceding and 1 preceding), 0) as before,
    length(head || body || '</turn>' || chr(10)) as chars, pos = 1 and role = 'system' as opens
  from a),
e as (select *, before // 384 as begins, (before + tokens - 1) // 384 as ends from s),
b as (select *, case when not opens then [ends, (begins = ends)::int] end as cell from e),
f as (select *, coalesce(lag(cell) over (partition by conv_id order by pos) <> cell, pos = 1) as first from b),
h as (
  select *, case when opens then 0 else coalesce(lead(first, 1) over (partition by conv_id order by pos), false)::int + coalesce(lead(first, 2) over (partition by conv_id order by pos), false)::int end as again from f)
select conv_id, count(*)::bigint as n_turns, sha256(string_agg(role || chr(10) || txt || chr(10), '' order by pos)) as turns_sha256,
  coalesce(sum(length(txt)) filter (role = 'assistant'), 0)::bigint as loss_chars, sha256(coalesce(string_agg(txt, '' order by pos) filter (role = 'assistant'), '')) as loss_sha256,
  (sum(chars * (1 + again)) + coalesce(sum(chars) filter (opens), 0) * (count(*) filter (first) - 1))::bigint as formatted_chars
from h group by conv_id
"""

OP4 = rf"""
with l as (
  select doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no, unnest(string_split(text, chr(10))) as line from documents),
w as (select doc_id, line_no, regexp_extract_all(line, '{_W}') as ws from l),
o as (select * from w where len(ws) > 0),
e as (select ws, min([doc_id, line_no]) as place, count(*) as n from o group by ws),
d as (
  select *, case when len(ws) >= 8 then 'words' when length(array_to_string(ws, ' ')) >= 12 then 'characters' end as unit,
    case when len(ws) >= 8 then ws else regexp_extract_all(array_to_string(ws, ' '), '(?s).') end as us from e),
v as (select ws, place, unit, i, us[:i - 1] || us[i + 1:] as variant from (select *, unnest(range(1, len(us) + 1)) as i from d where unit is not null)),
f as (select unit, variant, i, min(place) as first from v group by unit, variant, i),
p as (
  select v.ws, f.first as other from v join f on v.unit = f.unit and v.variant = f.variant and v.i = f.i where f.first < v.place
  union all select v.ws, d.place from v join d on d.unit = v.unit and d.us = v.variant where d.place < v.place
  union all select d.ws, v.place from v join d on d.unit = v.unit and d.us = v.variant where v.place < d.place),
n as (select ws, min(other) as near from p group by ws)
select o.doc_id, o.line_no::integer as line_no, case when n.near is not null then 'near' else 'exact' end as kind,
  coalesce(n.near, d.place)[1] as first_doc_id, coalesce(n.near, d.place)[2]::integer as first_line_no
from o join d on o.ws = d.ws left join n on o.ws = n.ws
where n.near is not null or [o.doc_id, o.line_no] <> d.place
"""

OP2 = rf"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '{_W}')), 0)::bigint as size, md5(coalesce(doc_id::varchar, '') || chr(10) || coalesce(text, '')) as h,
    case when source is null then '0' else '1' || source end as source_key from documents),
s as (select source_key, sum(size)::bigint as source_size, ((row_number() over (order by any_value(source) nulls last) - 1) % 3 + 1)::double as weight from d group by source_key),
r as (
  select *, (3 * source_size)::double as cap, row_number() over o as pos,
    (sum(source_size) over () - coalesce(sum((3 * source_size)::double) over (o rows between unbounded preceding and 1 preceding), 0))
    / (sum(weight) over () - coalesce(sum(weight) over (o rows between unbounded preceding and 1 preceding), 0)) as level
  from s window o as (order by (3 * source_size)::double / weight, source_key)),
f as (select min(pos) as pos, min_by(level, pos) as level from r where cap > level * weight),
t as (select r.source_key, source_size, case when f.pos is null or r.pos < f.pos then cap else f.level * weight end as target from r cross join f),
k as (
  select d.*, source_size, target, row_number() over (partition by d.source_key order by size, substr(h, 1, 3), doc_id nulls first, h) as rank,
    case when source_size > 0 then target / source_size else 0 end as rate, ('0x' || substr(md5('11/' || d.source_key), 1, 5))::bigint / 1048576::double as u
  from d join t using (source_key)),
c as (select *, (floor(u + rate * rank) - floor(u + rate * (rank - 1)))::int as copies from k)
select doc_id, size, source_size, target, size * copies as taken, copies from c
"""

OP5 = rf"""
with recursive w as materialized (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_W}') as ws from documents),
sh as materialized (
  select distinct r, unnest(case when len(ws) >= 3 then [ws[i] || chr(0) || ws[i + 1] || chr(0) || ws[i + 2] for i in range(1, len(ws) - 1)] when len(ws) > 0 then [array_to_string(ws, chr(0))] else [] end) as g
  from w),
n as materialized (select r, count(*) as n from sh group by r),
m as materialized (select a.r as a, b.r as b, count(*) as c from sh a join sh b on a.g = b.g and a.r <> b.r group by 1, 2),
e as materialized (select a, b from m join n x on x.r = a join n y on y.r = b where 100 * c >= 85 * (x.n + y.n - c)),
reach(r, o) as (select r, r from w union select reach.r, e.b from reach join e on e.a = reach.o)
select w.doc_id, coalesce(any_value(n.n), 0)::bigint as n_shingles, min(v.doc_id) as component_id, w.doc_id = min(v.doc_id) as kept
from w join reach using (r) join w v on v.r = reach.o left join n on n.r = w.r group by w.r, w.doc_id
"""
