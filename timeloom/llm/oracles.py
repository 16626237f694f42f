"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

ORACLES["op1_decontaminate"] = r"""
with d as (
  select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w
  from documents),
b as (
  select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark),
bw as (
  select distinct item_id, least(len(w), 10) as k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') as g
  from (select item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) as i from b where len(w) > 0)),
dw as (
  select doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') as g
  from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i
        from d cross join (select distinct k from bw) where len(w) >= k)),
hits as (select dw.doc_id, dw.i, dw.k, bw.item_id from dw join bw using (k, g)),
pos as (select distinct doc_id, unnest(range(i, i + k)) as p from hits),
np as (select doc_id, count(*) as n_hit from pos group by doc_id),
ni as (select doc_id, count(*) as n_items, string_agg(s, ',' order by s) as items
       from (select distinct doc_id, cast(item_id as varchar) as s from hits) group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
       cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(items, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 as contaminated
from d left join np using (doc_id) left join ni using (doc_id)
"""

ORACLES["op6_substrings"] = r"""
with d as (select doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as w from documents),
win as (select doc_id, i, array_to_string(w[i:i + 12], ' ') as g
        from (select doc_id, w, unnest(range(1, len(w) - 11)) as i from d where len(w) >= 13)),
least_doc as (select g, min(doc_id) as m from win group by g),
gone as (select distinct doc_id, unnest(range(i, i + 13)) as p from win join least_doc using (g) where doc_id > m),
words as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from d),
kept as (select words.doc_id, string_agg(word, ' ' order by words.p) as t, count(*) as n
         from words anti join gone on words.doc_id = gone.doc_id and words.p = gone.p group by words.doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n, 0) as bigint) as n_removed,
       sha256(coalesce(t, '')) as kept_sha256
from d left join kept using (doc_id)
"""

ORACLES["op10_suffixes"] = r"""
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
hashed as (select doc_id, i, hash(substr(h, 2 * i - 1, 100)) as k
           from (select doc_id, h, unnest(range(1, len(h) // 2 - 48)) as i from d where len(h) >= 100)),
many as (select k from hashed group by k having count(*) > 1),
win as (select doc_id, i, substr(h, 2 * i - 1, 100) as g from hashed semi join many using (k) join d using (doc_id)),
least_doc as (select g, min(doc_id) as m from win group by g having count(distinct doc_id) > 1),
gone as (select distinct doc_id, unnest(range(i, i + 50)) as p from win join least_doc using (g) where doc_id > m),
spans as (select doc_id, count(*) as n_removed, count(*) filter (where new) as n_spans
          from (select doc_id, p, p - 1 is distinct from lag(p) over (partition by doc_id order by p) as new from gone)
          group by doc_id),
bytes as (select doc_id, unnest(range(1, len(h) // 2 + 1)) as p, h from d),
kept as (select b.doc_id, string_agg(substr(b.h, 2 * b.p - 1, 2), '' order by b.p) as k
         from bytes b anti join gone g on b.doc_id = g.doc_id and b.p = g.p
         where b.doc_id in (select doc_id from gone) group by b.doc_id)
select d.doc_id, cast(len(h) // 2 as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed,
       cast(coalesce(n_spans, 0) as bigint) as n_spans,
       sha256(unhex(case when n_removed is null then h else coalesce(k, '') end)) as kept_sha256
from d left join spans using (doc_id) left join kept using (doc_id)
"""

# base32 from the hex digits: 32 groups of 5 bits
ORACLES["op4_warc"] = r"""
with p as (select page_id, encode(coalesce(html, '')) as b from pages),
d as (select page_id, octet_length(b) as n, sha1(b) as h from p),
k as (select page_id, n, array_to_string(list_transform(range(32),
        lambda i : substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
          1 + ((cast('0x' || substr(h || '0', cast((5 * i) // 4 + 1 as int), 2) as int) >> cast(3 - (5 * i) % 4 as int)) & 31), 1)), '') as g
      from d),
t as (select g, max(page_id) as top from k group by g)
select page_id, cast(n as bigint) as payload_bytes, g as payload_digest,
       case when page_id = top then 'response' else 'revisit' end as record_type,
       case when page_id = top then null else top end as refers_to
from k join t using (g)
"""
