"""SQL of the operators' queries, where SQL can express them over whole tables. The space class of words is space and U+0009 to U+000D."""

from __future__ import annotations

_FINE = "embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0"
_SPLIT = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_ESCAPE = r"replace(replace(replace(replace({}, '\', '\b'), '<', '\l'), '#', '\h'), ':' || chr(10), '\c' || chr(10))"

TOPK = f"""
with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * cast(x as double))) as e from embeddings where {_FINE}),
s as (select q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.e, c.e) as bigint) as score from v q join v c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as int) as rank, vec_id, score from r where rank <= 20"""

CHAT = f"""
with said as (
  select conv_id, turn, coalesce(role, 'user') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\\### Assistant: </turn> ok')
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
  sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn nulls first, role, text), '')) as loss_sha256,
  cast(sum(14 + length({_ESCAPE.format('role')}) + length({_ESCAPE.format('text')})) as bigint) as formatted_chars
from said group by conv_id"""

# Base32 of the SHA-1: five hexadecimal digits are four letters.
WARC = """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as n, sha1(coalesce(html, '')) as x from pages),
g as (select x, max(page_id) as first from p group by x)
select page_id, cast(n as bigint) as payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast((cast('0x' || substr(x, (i // 4) * 5 + 1, 5) as bigint) >> (15 - 5 * (i % 4))) & 31 as int) + 1, 1)), '') as payload_digest,
  case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id <> first then first end as refers_to
from p join g using (x)"""

SUBSTRINGS = f"""
with d as (select doc_id, row_number() over () as r, {_SPLIT.format("coalesce(text, '')")} as w from documents),
t as (select r, i, array_to_string(w[i:i + 34], ' ') as s from (select r, w, unnest(range(1, len(w) - 33)) as i from d where len(w) >= 35)),
twice as (select s from t group by s having count(*) > 1),
gone as (select distinct r, unnest(range(i, i + 35)) as p from t join twice using (s)),
kept as (select r, p, word from (select r, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from d) anti join gone using (r, p)),
k as (select r, count(*) as n, string_agg(word, ' ' order by p) as s from kept group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(s, '')) as kept_sha256 from d left join k using (r)"""

EMBEDDINGS = f"""
with recursive v as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings where len(embedding) > 0 and {_FINE}),
n as (select vec_id, e, sqrt(list_dot_product(e, e)) as n from v where list_dot_product(e, e) > 0),
l as (select a.vec_id as a, b.vec_id as b from n a join n b on a.vec_id <> b.vec_id and list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.95),
reach(a, b) as (select vec_id, vec_id from embeddings union select r.a, l.b from reach r join l on r.b = l.a),
c as (select a as vec_id, min(b) as component_id from reach group by a), k as (select a as vec_id, count(*) as n from l group by a)
select vec_id, coalesce(k.n, 0) as n_links, component_id, vec_id = component_id as kept from c left join k using (vec_id)"""

JACCARD = f"""
with recursive d as (select doc_id, {_SPLIT.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as w from documents),
s as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') as s from (select doc_id, w, unnest(range(1, len(w) - 3)) as i from d where len(w) >= 5)
  union all select doc_id, array_to_string(w, ' ') from d where len(w) between 1 and 4),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)),
reach(a, b) as (select doc_id, doc_id from documents union select r.a, l.b from reach r join l on r.b = l.a),
c as (select a as doc_id, min(b) as component_id from reach group by a)
select doc_id, coalesce(n, 0) as n_shingles, component_id from c left join n using (doc_id)"""
