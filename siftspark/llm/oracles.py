"""DuckDB SQL of the queries that SQL can express by brute force on small tables.

What joins all documents with each other grows with the square of a table, which is why the
operators don't work so; on tables of some thousand documents it tells whether they are right.
"""

from __future__ import annotations

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SPACED = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"
ALNUM = f"regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

#: Smallest node that each node reaches over links (u, v).
REACHED = "reach as (select u as node, v as other from links union select v, u from links union select r.node, l.other from reach r join (select u, v as other from links union select v, u from links) l on l.u = r.other)"

OP5 = f"""with recursive w as materialized (select doc_id, {SPACED.format(LOWER)} as ws from documents),
 s as materialized (select distinct doc_id, unnest(case when len(ws) > 1 then list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) when len(ws) = 1 then ws else [] end) as x from w),
 n as materialized (select doc_id, count(*) as n from s group by 1),
 links as materialized (select a.doc_id as u, b.doc_id as v from s a join s b on a.x = b.x and a.doc_id < b.doc_id join n na on na.doc_id = a.doc_id join n nb on nb.doc_id = b.doc_id where 100 * least(na.n, nb.n) >= 80 * greatest(na.n, nb.n) group by a.doc_id, b.doc_id, na.n, nb.n having 100 * count(*) >= 80 * (na.n + nb.n - count(*))),
 {REACHED}, c as (select node, min(other) as least from reach group by 1)
 select d.doc_id, coalesce(n, 0) as n_shingles, least(d.doc_id, coalesce(least, d.doc_id)) as component_id, d.doc_id = least(d.doc_id, coalesce(least, d.doc_id)) as kept from documents d left join n using (doc_id) left join c on c.node = d.doc_id"""

OP6 = f"""with recursive e as materialized (select vec_id, label, list_transform(embedding, lambda x: x::double) as v from embeddings where label is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
 links as materialized (select a.vec_id as u, b.vec_id as v from e a join e b on a.label = b.label and len(a.v) = len(b.v) and a.vec_id < b.vec_id where list_inner_product(a.v, b.v) / sqrt(list_inner_product(a.v, a.v)) / sqrt(list_inner_product(b.v, b.v)) >= 0.98),
 {REACHED}, c as (select node, min(other) as least from reach group by 1), k as (select x, count(*) as n from (select u as x from links union all select v from links) group by 1)
 select vec_id, coalesce(n, 0) as n_links, least(vec_id, coalesce(least, vec_id)) as component_id, vec_id = least(vec_id, coalesce(least, vec_id)) as kept from embeddings left join k on k.x = vec_id left join c on c.node = vec_id"""

OP7 = f"""with w as materialized (select doc_id, {SPACED.format("coalesce(text, '')")} as ws from documents),
 v as materialized (select doc_id, unnest(range(1, len(ws) - 33)) as i, unnest(list_transform(range(1, len(ws) - 33), lambda i: md5(array_to_string(ws[i:i + 34], ' ')))) as h from w where len(ws) >= 35),
 again as (select doc_id, i from v where h in (select h from v group by 1 having count(*) > 1)), gone as (select distinct doc_id, unnest(range(i, i + 35)) as k from again),
 words as (select doc_id, unnest(ws) as x, unnest(range(1, len(ws) + 1)) as k from w), kept as (select doc_id, string_agg(x, ' ' order by k) as t, count(*) as n from words anti join gone using (doc_id, k) group by 1)
 select doc_id, len(ws) as n_words, len(ws) - coalesce(n, 0) as n_removed, sha256(coalesce(t, '')) as kept_sha256 from w left join kept using (doc_id)"""

OP8 = f"""with b as materialized (select item_id::varchar as item, {ALNUM} as ws from benchmark where item_id is not null), sizes as (select distinct least(10, len(ws)) as k from b where len(ws) > 0),
 g as materialized (select distinct item, least(10, len(ws)) as k, unnest(list_transform(range(1, len(ws) - least(10, len(ws)) + 2), lambda i: array_to_string(ws[i:i + least(10, len(ws)) - 1], ' '))) as x from b where len(ws) > 0),
 w as materialized (select doc_id, {ALNUM} as ws from documents),
 v as (select doc_id, k, unnest(range(1, len(ws) - k + 2)) as i, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) as x from w, sizes where len(ws) >= k),
 hits as materialized (select doc_id, v.k, i, item from v join g on g.k = v.k and g.x = v.x), covered as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + k)) as p from hits) group by 1),
 found as (select doc_id, count(distinct item) as n_items, sha256(string_agg(distinct item, ',' order by item)) as items from hits group by 1)
 select doc_id, len(ws) as n_words, coalesce(n, 0) as n_hit, coalesce(n_items, 0) as n_items, coalesce(items, sha256('')) as items_sha256, coalesce(n, 0) > 0 as contaminated from w left join covered using (doc_id) left join found using (doc_id)"""

#: The level at which sources share what others' limits leave: words and weights that are still open, round by round.
OP11 = f"""with recursive d as materialized (select doc_id, source, len({SPACED.format("coalesce(text, '')")})::bigint as size, sha256(coalesce(doc_id::varchar, '')) as digest from documents),
 s as materialized (select source, sum(size)::hugeint as words, [5, 2, 1][(row_number() over (order by source nulls last) - 1) % 3 + 1]::hugeint as w from d group by source),
 open as (select 0 as i, sum(words) as r, sum(w) as ws from s union all select i + 1, (select sum(words) from s) - sum(case when w * r > 3 * words * ws then 3 * words else 0 end), sum(case when w * r > 3 * words * ws then 0 else w end) from open, s where i < (select count(*) from s) group by i, r, ws having sum(case when w * r > 3 * words * ws then 0 else w end) > 0),
 t as (select source, words, case when w * r > 3 * words * ws then (3 * words)::double else (w * r)::double / ws::double end as target from s, (select r, ws from open order by i desc limit 1)),
 f as materialized (select source, words, target, floor(rate) as whole, rate - floor(rate) as part from (select *, case when words > 0 then target / words::double else 0 end as rate from t)),
 x as materialized (select d.*, k, ('0x' || substr(digest, 8 * k + 1, 8))::bigint / 4294967296.0::double as draw from d, (select unnest(range(8)) as k)),
 off as (select x.source, k, abs(sum(case when draw < part then size else 0 end)::double - (target - whole * words::double)) as miss from x join f on x.source is not distinct from f.source group by x.source, k, target, whole, words),
 best as (select source, k from off qualify row_number() over (partition by source order by miss, k) = 1)
 select x.doc_id, x.size, words::bigint as source_size, target, (whole + case when draw < part then 1 else 0 end)::bigint as copies, (x.size * (whole + case when draw < part then 1 else 0 end))::bigint as taken from x join best b on x.source is not distinct from b.source and x.k = b.k join f on x.source is not distinct from f.source"""

OP12 = f"""with v as materialized (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as ws from (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array({LOWER}, '[.,;:!?\\x0A-\\x0D]')) as piece from documents)),
 total as materialized (select lang, sum(len(ws))::hugeint as n from v group by 1),
 c as materialized (select lang, k, phrase, count(*)::hugeint as f from (select lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) as phrase from v, (select unnest(range(1, 6)) as k) where len(ws) >= k) group by all having count(*) >= 100),
 p as materialized (select lang, k as size, phrase, f as a, string_split(phrase, ' ') as ws from c where k > 1),
 cuts as (select p.lang, size, p.phrase, a, l.f as l, r.f as r, n, cut, (1000 * a * n) // (l.f * r.f) as score from (select *, unnest(range(1, size)) as cut from p) p join total using (lang) join c l on l.lang = p.lang and l.phrase = array_to_string(ws[1:cut], ' ') join c r on r.lang = p.lang and r.phrase = array_to_string(ws[cut + 1:size], ' ')),
 scored as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
 inside as (select lang, phrase, max(a) as held from (select lang, a, array_to_string(ws[i:i + k - 1], ' ') as phrase from (select *, unnest(range(1, size - k + 2)) as i from (select *, unnest(range(2, size)) as k from p))) group by all),
 ranked as (select lang, row_number() over (partition by lang order by score desc, a desc, s.phrase) as rank, s.phrase, a, l, r, n, score from scored s left join inside i using (lang, phrase) where held is null or 100 * held < 100 * a)
 select lang, rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score from ranked where rank <= 2000"""

OP13 = f"""with q as materialized (select item_id, term, count(*) as times from (select item_id, unnest({ALNUM}) as term from benchmark where item_id is not null) group by all),
 d as materialized (select doc_id, {ALNUM} as ws from documents), s as materialized (select count(*) as documents, sum(len(ws))::bigint as words from d where len(ws) > 0),
 tf as materialized (select doc_id, n, term, count(*) as tf from (select doc_id, len(ws)::bigint as n, unnest(ws) as term from d) where term in (select term from q) group by all),
 w as materialized (select term, floor(1000 * ln((2 * documents + 2)::double / (2 * count(*) + 1)::double))::bigint as w from tf, s group by term, documents),
 scored as (select item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * documents) // words))))::bigint as score from q join tf using (term) join w using (term), s group by all),
 ranked as (select item_id, row_number() over (partition by item_id order by score desc, doc_id) as rank, doc_id, score from scored where score > 0)
 select item_id, rank::int as rank, doc_id, score from ranked where rank <= 10"""


def oracle_sql() -> dict[str, str]:
    return {"op5_minhash_docs": OP5, "op6_embedding_dedup": OP6, "op7_substring_dedup": OP7, "op8_decontaminate": OP8, "op11_mixing": OP11, "op12_phrases": OP12, "op13_lexical_search": OP13}
