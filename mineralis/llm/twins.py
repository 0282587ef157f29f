"""SQL twins for DuckDB, each written on its own."""

OP10 = r"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         md5(coalesce(doc_id::varchar, '')) as k from documents),
per as (
  select source, sum(size)::bigint as source_size, (row_number() over (order by source nulls last) - 1) % 3 as c
  from sized group by source),
weighed as (select *, [5, 2, 1][c + 1]::bigint as w, 3 * source_size as cap from per),
marked as (
  select *, cap * sum(w) over (order by source_size / w, source nulls last rows between current row and unbounded following)
      <= ((select sum(source_size) from per) - coalesce(sum(cap) over (order by source_size / w, source nulls last
          rows between unbounded preceding and 1 preceding), 0)) * w as is_full
  from weighed),
left_over as (
  select (select sum(source_size) from per) - sum(case when is_full then cap else 0 end) as words,
         sum(case when is_full then 0 else w end) as weight from marked),
targets as (
  select source, source_size, c, case when is_full then cap::double else (w * words)::double / weight::double end as target
  from marked, left_over),
placed as (
  select s.doc_id, s.size, t.source_size, t.target, t.c, floor(t.target)::bigint as whole,
         coalesce(sum(s.size) over (partition by s.source order by s.k, s.doc_id nulls first, s.size
             rows between unbounded preceding and 1 preceding), 0)::bigint as before
  from sized s join targets t on s.source is not distinct from t.source),
timed as (select *, before::double / target as u from placed)
select doc_id, size, source_size, target,
       (least(greatest(whole - before, 0), size) + least(greatest(whole - before - source_size, 0), size)
        + least(greatest(whole - before - 2 * source_size, 0), size))::bigint as taken,
       case when size > 0 and before < whole then
         case c when 0 then 0.0::double + 2 * u / (1.5::double + sqrt(2.25::double + -2.0::double * u))
                when 1 then 0.0::double + 2 * u / (1.0::double + sqrt(1.0::double + 0.0::double * u))
                else 0.0::double + 2 * u / (0.5::double + sqrt(0.25::double + 2.0::double * u)) end end as position
from timed
"""

OP8 = r"""
with p as (select page_id, coalesce(html, '') as html from pages),
r as (select page_id, octet_length(encode(html)) as n, sha1(html) as digest,
      max(page_id) over (partition by html) as top from p)
select page_id, n::bigint as payload_bytes, digest as payload_digest,
       case when n >= 1000 and page_id is distinct from top and top is not null then 'revisit' else 'response' end as record_type,
       case when n >= 1000 and page_id is distinct from top then top end as refers_to, null::varchar as error
from r
"""

OP2 = r"""
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and vec_id is not null),
s as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.v::double[], c.v::double[])::bigint as score
  from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""

OP12 = r"""
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and vec_id is not null and label is not null),
s as (
  select a.vec_id as anchor_id, c.vec_id, a.label = c.label as same, list_inner_product(a.v::double[], c.v::double[])::bigint as score
  from v a join v c on a.vec_id % 50 = 0 and c.vec_id <> a.vec_id),
p as (select anchor_id, vec_id as positive_id, score as positive_score from s where same
      qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
n as (
  select p.*, s.vec_id as negative_id, s.score as negative_score,
         row_number() over (partition by anchor_id, positive_id order by s.score desc, s.vec_id)::int as rank
  from p join s using (anchor_id) where not s.same and 50 * positive_score <= 100 * s.score and 100 * s.score <= 95 * positive_score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= 3
"""

# counted document by document: each order keeps the documents that no earlier filter of it rejects
OP13 = r"""
with d as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as text,
         regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') as words from documents),
f as (
  select doc_id, part, len(words) < 200 as a, 100 * len(list_distinct(words)) < 50 * len(words) as b,
         100 * len(regexp_extract_all(text, '[A-Z]')) > 2 * length(text) as c, regexp_matches(text, '[#$%&*|]') as d,
         coalesce(doc_id > min(doc_id) over (partition by text), false) as e from d),
l as (select doc_id, bool_or(coalesce(quality = 1, false)) as good, bool_or(coalesce(toxic = 1, false)) as bad from labels group by doc_id),
m as (
  select part, [a, b, c, d, e] as fails, count(*) as n, count(*) filter (coalesce(good, false)) as good, count(*) filter (coalesce(bad, false)) as bad
  from f left join l using (doc_id) group by all),
letter as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
orders as (select p.x || q.x || r.x || s.x || t.x as filter_order from letter p, letter q, letter r, letter s, letter t
           where len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
stepped as (
  select filter_order, step, ascii(filter_order[step]) - 64 as own, list_transform(range(1, step), lambda i: ascii(filter_order[i]) - 64) as earlier
  from orders, (select unnest(range(1, 6)) as step)),
judged as (
  select part, filter_order, step, own, n, good, bad, fails[own] as hit, len(list_filter(earlier, lambda k: fails[k])) > 0 as gone,
         len(list_filter(fails, lambda y: y)) = 1 and fails[own] as lone from m, stepped),
counted as (
  select part, filter_order, step, own, sum(case when not gone and not hit then n else 0 end)::bigint as kept,
         sum(case when not gone and hit then n else 0 end)::bigint as removed, sum(case when gone and hit then n else 0 end)::bigint as redundant,
         sum(case when lone then n else 0 end)::bigint as unique_fails, sum(case when not gone and hit then good else 0 end)::bigint as good_lost,
         sum(case when not gone and hit then bad else 0 end)::bigint as toxic_lost from judged group by part, filter_order, step, own)
select part, filter_order, step::int as step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) over (partition by part, own))::bigint as shapley from counted
"""

SQL = {"op12_hardneg": OP12, "op13_filter_audit": OP13, "op2_topk": OP2, "op8_warc": OP8, "op10_mixing": OP10}
