"""The queries of this package, and SQL for those that SQL can express (ids are taken as distinct there, as in the tables)."""

from __future__ import annotations

from .bpe_codec import op5_bpe_codec
from .decontaminate import op3_decontaminate
from .embedding_dedup import op7_embedding_dedup
from .lm_score import op9_lm_score
from .near_dup import op1_near_duplicates
from .quality import op6_quality
from .substring_dedup import op8_substring_dedup
from .token_counts import op2_token_counts
from .token_files import op10_token_files
from .toxicity import op4_toxicity

QUERIES = {
    "op4_toxicity": op4_toxicity,
    "op6_quality": op6_quality,
    "op3_decontaminate": op3_decontaminate,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_lm_score": op9_lm_score,
    "op1_near_duplicates": op1_near_duplicates,
    "op5_bpe_codec": op5_bpe_codec,
    "op10_token_files": op10_token_files,
    "op2_token_counts": op2_token_counts,
}

#: Every pair of rows, for the small tables that SQL is run on.
_LINKS = """
with recursive v as (
  select vec_id, embedding::double[] as e from embeddings
  where vec_id is not null and embedding is not null and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x))) and list_bool_or(list_transform(embedding, lambda x: x <> 0))
), l as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.95
), r(id, reached) as (
  select vec_id, vec_id from embeddings union select r.id, l.b from r join l on l.a = r.reached
), c as (select id, min(reached) as component_id from r group by id), n as (select a, count(*) as n from l group by a)
select e.vec_id, coalesce(n.n, 0)::bigint as n_links, c.component_id, e.vec_id = c.component_id as kept
from embeddings e left join c on c.id = e.vec_id left join n on n.a = e.vec_id
"""

#: Every string of 50 bytes, as 100 hexadecimal digits.
_SPANS = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
s as (select doc_id, i, substr(h, 2 * i + 1, 100) as g from (select doc_id, h, unnest(range(0, greatest(length(h) // 2 - 49, 0))) as i from d)),
f as (select g, min(doc_id) as first from s group by g having count(distinct doc_id) > 1),
c as (select s.doc_id, s.i, case when s.i <= lag(s.i) over (partition by s.doc_id order by s.i) + 50 then 0 else 1 end as new from s join f on f.g = s.g where f.first < s.doc_id),
m as (select doc_id, min(i) as a, max(i) + 50 as b from (select doc_id, i, sum(new) over (partition by doc_id order by i) as k from c) group by doc_id, k),
k as (select doc_id, a, b, lag(b, 1, 0) over (partition by doc_id order by a) as before from m),
j as (select k.doc_id, count(*) as n_spans, sum(b - a) as n_removed, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' order by a) || substr(max(h), 2 * max(b) + 1) as kept from k join d on d.doc_id = k.doc_id group by k.doc_id)
select d.doc_id, (length(h) // 2)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(coalesce(kept, h))) as kept_sha256
from d left join j on j.doc_id = d.doc_id
"""

#: crc32 a bit at a time, then counts of runs of one to three words. Digests of the scores' sums are left to rounding.
_SCORES = """
with recursive ids as (select distinct doc_id, doc_id::varchar as t from documents),
crc(doc_id, t, k, v) as (
  select doc_id, t, 0, 4294967295::bigint from ids
  union all
  select doc_id, t, k + 1, xor(u >> 1, case when u % 2 = 1 then 3988292384 else 0 end)
  from (select *, case when k % 8 = 0 then xor(v, ascii(substr(t, k // 8 + 1, 1))::bigint) else v end as u from crc)
  where k < 8 * length(t)
), held as (select doc_id, xor(v, 4294967295) % 5 = 1 as held_out from crc where k = 8 * length(t)),
w as (
  select doc_id, held_out, unnest(list_concat([chr(1) || 'start'], list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> ''), [chr(1) || 'end'])) as w,
    generate_subscripts(list_concat([''], list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> ''), ['']), 1) as p
  from documents join held using (doc_id)
),
g as (select *, lag(w) over (partition by doc_id order by p) as b, lag(w, 2) over (partition by doc_id order by p) as a from w),
c1 as (select w, count(*) as n from g where not held_out group by w),
c2 as (select b, w, count(*) as n from g where not held_out and b is not null group by b, w),
c3 as (select a, b, w, count(*) as n from g where not held_out and a is not null group by a, b, w),
t as (select sum(n) as total, sum(n) + 0.5 * (count(*) + 1) as floor from c1 where w <> chr(1) || 'start'),
p as (
  select g.doc_id, g.held_out, (coalesce(c1.n, 0) + 0.5) / t.floor as p1, coalesce(c1.n, 0) > 0 as known, coalesce(c2.n, 0) as n2, coalesce(h1.n, 0) as h1, g.a is not null as longer, coalesce(c3.n, 0) as n3, coalesce(h2.n, 0) as h2
  from g cross join t left join c1 on c1.w = g.w left join c2 on c2.b = g.b and c2.w = g.w left join c3 on c3.a = g.a and c3.b = g.b and c3.w = g.w
    left join c1 h1 on h1.w = g.b left join c2 h2 on h2.b = g.a and h2.w = g.b
  where g.b is not null
)
select doc_id, held_out, count(*) as n_tokens, count(*) filter (where known) as n_known, (select total::bigint from t) as train_tokens, round(sum(log10(p1)), 6) as base_score,
  round(sum(log10(case when longer then (n3 + 4 * (n2 + 4 * p1) / (h1 + 4)) / (h2 + 4) else (n2 + 4 * p1) / (h1 + 4) end)), 6) as score
from p group by doc_id, held_out
"""

ORACLE_SQL: dict[str, str] = {"op7_embedding_dedup": _LINKS, "op8_substring_dedup": _SPANS, "op9_lm_score": _SCORES}
