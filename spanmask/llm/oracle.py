"""DuckDB texts of the queries that SQL can express."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: Every window of 35 words as its words' text, counted over all starts of all documents.
OP4 = f"""
with docs as (select row_number() over () as r, doc_id, {_WORDS} as w from documents),
starts as (select r, unnest(range(1, len(w) - 33)) as i from docs where len(w) >= 35),
windows as (select s.r, s.i, md5(array_to_string(d.w[s.i : s.i + 34], ' ')) as h from starts s join docs d using (r)),
repeated as (select r, i from (select r, i, count(*) over (partition by h) as n from windows) where n > 1),
gone as (select distinct r, unnest(range(i, i + 35)) as p from repeated),
marked as (select r, list(p) as ps, count(*) as n from gone group by r)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(m.n, 0)::bigint as n_removed,
  sha256(array_to_string(case when m.n is null then d.w else list_transform(list_filter(range(1, len(d.w) + 1), lambda p: not list_contains(m.ps, p)), lambda p: d.w[p]) end, ' ')) as kept_sha256
from docs d left join marked m using (r)
"""

#: Sources are filled to a common level in the order of limit / weight; each source's rows lie
#: end to end in the order of their shuffle key, and the mix takes the first ``target`` words
#: of that stream, starting over once.  The stream lies in equal blocks, and the r-th golden-ratio
#: point that falls into a source's share is the slot of its r-th block.
OP10 = f"""
with docs as (select doc_id, source, len({_WORDS})::bigint as size from documents),
sizes as (select source, sum(size)::bigint as source_size from docs group by source),
weighted as (select *, [3.0, 1.0, 2.0][1 + (row_number() over (order by source nulls last) - 1) % 3]::double as w from sizes),
ordered as (select *, 2.0::double * source_size as lim, row_number() over (order by 2.0::double * source_size / w, source nulls last) as o from weighted),
tried as (select a.o, (1.5::double * (select sum(source_size) from sizes) - coalesce(sum(b.lim) filter (b.o < a.o), 0)) / sum(b.w) filter (b.o >= a.o) as level
  from ordered a cross join ordered b group by a.o),
level as (select min_by(t.level, t.o) as level from tried t join ordered a using (o) where a.lim / a.w >= t.level),
goal as (select source, source_size, least(lim, (select level from level) * w)::double as target from ordered),
placed as (select d.*, coalesce(sum(size) over (partition by d.source order by md5('mix|' || coalesce(doc_id::varchar, 'null') || '|' || size::varchar), doc_id, size rows between unbounded preceding and 1 preceding), 0)::bigint as start from docs d),
numbers as (select *, row_number() over (order by source nulls last) as s, round(target)::bigint as words,
  (select greatest(ceil(1.5::double * sum(source_size) / 65536), 1)::bigint from sizes) as block from goal),
blocks as (select *, ceil(source_size / block)::bigint as n_blocks from numbers),
due as (select *, case when words <= source_size then ceil(words / block)::bigint else n_blocks + ceil((words - source_size) / block)::bigint end as k from blocks),
shares as (select *, (sum(k) over (order by s) - k)::double / sum(k) over () as low, (sum(k) over (order by s))::double / sum(k) over () as high from due where k > 0),
points as (select slot, (slot + 0.5::double) * 0.6180339887498949::double - floor((slot + 0.5::double) * 0.6180339887498949::double) as x
  from (select unnest(range(0, (select 2 * coalesce(sum(k), 0) + 16 from due)::bigint)) as slot)),
dealt as (select s, slot, row_number() over (partition by s order by slot) - 1 as r from points join shares on x >= low and x < high),
taken as (select p.*, g.s, g.source_size, g.target, g.words, g.block, g.n_blocks,
  (greatest(least(words - p.start, p.size), 0) + greatest(least(words - g.source_size - p.start, p.size), 0))::bigint as taken from placed p join blocks g on p.source is not distinct from g.source)
select t.doc_id, t.source, t.size, t.source_size::bigint as source_size, round(t.target, 6)::double as target, t.taken,
  case when t.size > 0 and t.start < t.words then a.slot end::bigint as first_slot, case when t.size > 0 and t.start < t.words - t.source_size then b.slot end::bigint as second_slot
from taken t left join dealt a on a.s = t.s and a.r = t.start // t.block left join dealt b on b.s = t.s and b.r = t.n_blocks + t.start // t.block
"""

#: Exact search: every query against every other usable vector; squares are added in order.
OP2 = """
with v as (select vec_id, embedding::double[] as e from embeddings
  where embedding is not null and len(embedding) > 0 and vec_id is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs as (select q.vec_id as query_id, c.vec_id, sqrt(list_reduce(list_prepend(0.0::double, list_transform(list_zip(q.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), lambda a, b: a + b)) as score from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0),
ranked as (select *, row_number() over (partition by query_id order by score, vec_id) as r from pairs)
select query_id, r::integer as rank, vec_id, score from ranked where r <= 10
"""

#: The rules as plain conditions on host and path.
OP5 = r"""
with parsed as (select page_id,
    case when contains(url, '://') then translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else '' end as host,
    case when contains(url, '://') then regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) else '' end as path from pages),
rules(rule, h, p, v) as (values ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'), ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
numbered as (select row_number() over () as n, * from parsed),
fits as (select n, rule, v, row_number() over (partition by n order by length(rule) desc, rule) as o from numbered, rules where (host = h or ends_with(host, '.' || h)) and starts_with(path, p))
select page_id, host, path, rule, coalesce(v, 'allow') as verdict from numbered left join (select * from fits where o = 1) using (n)
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: All phrases of up to four words of all pieces, counted one by one.
OP11 = rf"""
with pieces as (select lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) as p from (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') as t from documents)),
places as (select lang, w, unnest(range(1, len(w) + 1)) as i from (select lang, regexp_extract_all(p, '[^\x20\x09]+') as w from pieces)),
counts as (select lang, m, array_to_string(w[i : i + m - 1], ' ') as phrase, count(*) as f from places, (values (1), (2), (3), (4)) s(m) where i + m - 1 <= len(w) group by all),
total as (select lang, sum(f) as n from counts where m = 1 group by lang),
found as (select lang, m, phrase, f as a, string_split(phrase, ' ') as w from counts where m > 1 and f >= 30),
around as (select lang, array_to_string(w[i : i + k - 1], ' ') as phrase, max(a) as b from found, (values (2), (3)) s(k), (values (1), (2), (3)) t(i) where k < m and i + k - 1 <= m group by all),
kept as (select f.* from found f left join around o using (lang, phrase) where o.b is null or 100 * o.b < 80 * f.a),
cuts as (select c.lang, c.phrase, c.a, k, h.f as l, r.f as r, (2000000::hugeint * c.a) // (h.f + r.f) as score from kept c cross join (values (1), (2), (3)) s(k)
  join counts h on h.lang = c.lang and h.phrase = array_to_string(c.w[1 : k], ' ') join counts r on r.lang = c.lang and r.phrase = array_to_string(c.w[k + 1 : c.m], ' ') where k < c.m),
worst as (select *, row_number() over (partition by lang, phrase order by score, k) as o from cuts),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as place from worst where o = 1)
select lang, place::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score from ranked join total using (lang) where place <= 2000
"""

#: Every group's count of every kept term, zeros included, term by term.
OP13 = rf"""
with docs as (select row_number() over () as d, coalesce(lang, '') as lang, coalesce(source, '') as source, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') as t from documents),
terms as (select d, lang, source, unnest(regexp_extract_all(t, '[a-z\x{{80}}-\x{{10FFFF}}]+')) as term from docs),
kept as (select lang, term from terms group by all having count(distinct d) >= 10),
many as (select lang, count(*)::hugeint as v from kept group by lang),
groups as (select distinct lang, source from docs),
used as (select lang, source, term, count(*) as c from terms join kept using (lang, term) group by all),
cells as (select g.lang, g.source, k.term, coalesce(u.c, 0)::hugeint as c from groups g join kept k using (lang) left join used u on u.lang = g.lang and u.source = g.source and u.term = k.term),
rates as (select *, 1 + (1000000000::hugeint * (c + 2)) // (sum(c) over (partition by lang, source)::hugeint + 2 * v) as p from cells join many using (lang)),
whole as (select lang, term, 1 + (1000000000::hugeint * (c + 2)) // (sum(c) over (partition by lang)::hugeint + 2 * v) as q from (select lang, term, sum(c)::hugeint as c, v from rates group by all)),
pairs as (select a.lang, a.source, b.source as item, coalesce(s.value, 0) as value from groups a join groups b on a.lang = b.lang and a.source <> b.source
  left join (select x.lang, x.source, y.source as item, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) as value from rates x join rates y using (lang, term) where x.source <> y.source group by all) s
  on s.lang = a.lang and s.source = a.source and s.item = b.source),
single as (select r.lang, r.source, r.term as item, ((p - q) * (p - q)) // (p + q) as value from rates r join whole using (lang, term) where r.c > 0 and p > q),
parts as (select lang, source, 'pair' as part, item, value from pairs union all select lang, source, 'term' as part, item, value from single),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item) as place from parts)
select lang, source, part, item, value::bigint as value, place::integer as rank from ranked where part = 'pair' or place <= 10
"""

ORACLE = {"op2_vector_search": OP2, "op5_url_filter": OP5, "op4_substring_dedup": OP4, "op10_mixing": OP10, "op11_collocations": OP11, "op13_source_divergence": OP13}
