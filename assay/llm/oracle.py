"""DuckDB SQL of the queries that SQL can express."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SMALL = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"

#: Five bits after the other of the digest's hexadecimal digits; captures a second apart from the first of 2024; hosts from the last label to the first.
OP2 = r"""
with p as (select page_id, coalesce(url, '') as url, coalesce(html, '') as html, sha1(coalesce(html, '')) as h from pages),
o as (select html, max(page_id) as owner from p group by 1),
u as (select *, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)', 1)) as host, regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', ''), '#.*', '', 's') as rest from p)
select u.page_id, strlen(u.html) as payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((((instr('0123456789abcdef', substr(h || '0', (5 * i) // 4 + 1, 1)) - 1) * 16 + instr('0123456789abcdef', substr(h || '0', (5 * i) // 4 + 2, 1)) - 1) >> (3 - (5 * i) % 4)) & 31)::int + 1, 1)), '') as payload_digest,
  case when u.page_id = owner then 'response' else 'revisit' end as record_type, case when u.page_id <> owner then owner end as refers_to,
  case when host = '' then rest else array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || rest end as url_key,
  strftime(timestamp '2024-01-01' + to_seconds(u.page_id % 1000000000), '%Y-%m-%dT%H:%M:%SZ') as captured
from u join o on u.html = o.html
"""

#: Windows of every size that an item has, as joined words; a document's words are marked by all that it holds.
OP3 = rf"""
with d as (select doc_id, regexp_extract_all({SMALL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id::varchar as item_id, regexp_extract_all({SMALL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
k as (select item_id, least(10, len(w)) as n, unnest(range(1, len(w) - least(10, len(w)) + 2)) as place, w from b where len(w) > 0),
windows as (select distinct item_id, n, array_to_string(list_slice(w, place, place + n - 1), ' ') as t from k),
sizes as (select distinct n from windows),
s as (select doc_id, n, unnest(range(1, len(w) - n + 2)) as place, w from d, sizes where len(w) >= n),
hits as (select distinct s.doc_id, s.place, s.n, x.item_id from s join windows x on s.n = x.n and array_to_string(list_slice(s.w, s.place, s.place + s.n - 1), ' ') = x.t),
places as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(place, place + n)) as p from hits) group by 1),
items as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct doc_id, item_id from hits) group by 1)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join places using (doc_id) left join items using (doc_id)
"""

OP8 = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(x::double * 256)::bigint) as v from embeddings),
s as (select q.vec_id as query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::bigint as score from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 5
"""

#: Links by common shingles, then the smallest document that each reaches.
OP9 = rf"""
with recursive w as (select doc_id, regexp_extract_all({SMALL}, '[^\x20\x09-\x0D]+') as w from documents),
s as (select doc_id, list_distinct(case when len(w) >= 4 then list_transform(range(1, len(w) - 2), lambda i: array_to_string(list_slice(w, i, i + 3), ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else []::varchar[] end) as s from w),
g as (select doc_id, len(s) as n, unnest(s) as g from s),
common as (select a.doc_id as a, b.doc_id as b, a.n as na, b.n as nb, count(*) as shared from g a join g b on a.g = b.g and a.doc_id <> b.doc_id and 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) group by all),
link as (select a, b from common where 100 * shared >= 85 * (na + nb - shared)),
reach as (select a as doc_id, b as r from link union select reach.doc_id, link.b from reach join link on reach.r = link.a),
least_of as (select doc_id, min(r) as r from reach group by 1)
select s.doc_id, len(s.s)::bigint as n_shingles, least(s.doc_id, coalesce(l.r, s.doc_id)) as component_id from s left join least_of l using (doc_id)
"""

#: The table of crc32 by its rule, bytes as hexadecimal digits; then every spelling with one code point less, marked by the place, brings near words together.
OP12 = rf"""
with recursive crc as (select list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, b)) as t),
runs as (select coalesce(doc_id::varchar, '') as d, unnest(regexp_extract_all({SMALL}, '[A-Za-zÀ-ÿ]+')) as w from documents),
r as (select d, w, count(*) as n, hex(encode(d || ':' || w)) as x from runs group by d, w),
h as (select d, w, n, xor(list_reduce(range(length(x) // 2), lambda c, i: xor(c >> 8, t[(xor(c, (instr('0123456789ABCDEF', substr(x, 2 * i + 1, 1)) - 1) * 16 + instr('0123456789ABCDEF', substr(x, 2 * i + 2, 1)) - 1) & 255) + 1]), 4294967295::bigint), 4294967295) as h from r, crc),
s as (select n, case when h % 199 = 0 then substr(w, 1, (h % length(w))::int) || substr(w, (h % length(w))::int + 2) else w end as word from h),
words as (select word, sum(n)::bigint as n from s where length(word) >= 6 group by word having sum(n) >= 5),
less as (select word, n, place, substr(word, 1, place::int) || substr(word, place::int + 2) as part from (select word, n, unnest(range(length(word))) as place from words)),
near as (select distinct a.word, a.n, b.word as other, b.n as m from less a join less b on a.part = b.part and a.place = b.place and a.word <> b.word
  union select a.word, a.n, b.word, b.n from less a join words b on a.part = b.word union select b.word, b.n, a.word, a.n from less a join words b on a.part = b.word),
best as (select word, any_value(n) as n, count(*) as n_near, arg_min(other, (-m, other)) as top, max(m) as m from near group by word),
forms as (select w.word, w.n, coalesce(n_near, 0) as n_near, case when m >= 5 * w.n then top end as form, case when m >= 5 * w.n then m end as form_n from words w left join best using (word)),
walk as (select word, word as at from forms union all select walk.word, forms.form from walk join forms on walk.at = forms.word where forms.form is not null),
ends as (select walk.word, walk.at as root from walk join forms on walk.at = forms.word where forms.form is null)
select word, form, root, n, n_near, form_n::bigint as form_n from forms join ends using (word)
"""

OP13 = rf"""
with d as (select row_number() over () as d, coalesce(lang, '') as lang, coalesce(source, '') as source, regexp_extract_all({SMALL}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
t as (select lang, source, term, count(*)::hugeint as n, count(distinct d) as docs from (select d, lang, source, unnest(w) as term from d) group by all),
kept as (select lang, term, sum(n)::hugeint as total from t group by all having sum(docs) >= 10),
v as (select lang, count(*)::hugeint as v, sum(total)::hugeint as size from kept group by all),
g as (select lang, source, coalesce(s.size, 0)::hugeint as size from (select distinct lang, source from d) left join (select lang, source, sum(n) as size from t semi join kept using (lang, term) group by all) s using (lang, source)),
p as (select g.lang, g.source, k.term, k.total, coalesce(t.n, 0) as n, 1 + (1000000000::hugeint * (coalesce(t.n, 0) + 2)) // (g.size + 2 * v.v) as p from g join v using (lang) join kept k using (lang) left join t on t.lang = g.lang and t.source = g.source and t.term = k.term),
pairs as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
terms as (select lang, source, term as item, (p - q) * (p - q) // (p + q) as value from (select p.*, 1 + (1000000000::hugeint * (total + 2)) // (v.size + 2 * v.v) as q from p join v using (lang)) where n > 0 and p > q),
a as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0)::bigint as value from g a join g b on a.lang = b.lang and a.source <> b.source left join pairs on pairs.lang = a.lang and pairs.source = a.source and pairs.item = b.source union all select lang, source, 'term', item, value::bigint from terms),
r as (select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from a)
select * from r where part = 'pair' or rank <= 10
"""

ORACLE = {"op2_warc_index": OP2, "op3_decontamination": OP3, "op8_topk": OP8, "op9_ngram_join": OP9, "op12_spelling": OP12, "op13_divergence": OP13}
