"""DuckDB SQL with the rows of the queries that SQL can express."""

from __future__ import annotations

CRC32 = """
with recursive bits(i, c, k) as (
    select range, range, 0 from range(256)
    union all
    select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from bits where k < 8
), crc as (select list(c order by i) as t from bits where k = 8)
"""

OP10 = (
    CRC32
    + """
, d as (
    select doc_id, coalesce('=' || source, '') as src, coalesce(text, '') as text, t from documents, crc
), rows_ as (
    select doc_id, src, substr(md5('17|' || coalesce(doc_id::varchar, '')), 1, 16) as turn, strlen(text) + 1 as size,
        coalesce(xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, strlen(text) + 1), lambda i: ('0x' || substr(hex(encode(text)), 2 * i::bigint - 1, 2))::bigint)),
            lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295), 0) as text_crc32
    from d
), ranked as (
    select *, (row_number() over (partition by src order by turn, doc_id, size, text_crc32)
        - ('0x' || substr(md5('17|' || src), 1, 13))::bigint / 4503599627370496.0::double) / count(*) over (partition by src) as fraction
    from rows_
), placed as (
    select *, row_number() over (order by fraction, src, turn, doc_id, size, text_crc32) - 1 as place, count(*) over () as total from ranked
)
select doc_id, size, text_crc32, 'rows' as law, (place * 16 // total)::int as shard,
    place - (place * 16 // total * total + 15) // 16 as slot, null::int as grown_shard, fraction
from placed
"""
)


OP1 = """
with words as (
    select rowid as doc, list_filter(string_split_regex(lower(coalesce(text, '')), '[ \\t\\n\\r\\x0b\\x0c]+'), lambda w: w != '') as w, doc_id
    from (select row_number() over () as rowid, * from documents)
), tok as (
    select doc, unnest(w) as word, unnest(range(1, len(w) + 1)) as i from words
), near as (
    select doc, i, word, lag(word) over (partition by doc order by i) as p, lag(word, 2) over (partition by doc order by i) as q from tok
), gram as (
    select doc, i, 1 as k, word as g, null as context from near
    union all select doc, i, 2, p || ' ' || word, p from near where p is not null
    union all select doc, i, 3, q || ' ' || p || ' ' || word, q || ' ' || p from near where q is not null
), every as (select g, count(*) as c from gram group by 1), own as (select doc, g, count(*) as c from gram group by 1, 2),
size_own as (select doc, count(*) as c from tok group by 1), size_all as (select count(*) as c from tok),
seen as (
    select gram.doc, gram.i, gram.k, e.c - o.c as n, sa.c - so.c as total, case when gram.k = 1 then sa.c - so.c else ec.c - oc.c end as base
    from gram join every e on e.g = gram.g join own o on o.g = gram.g and o.doc = gram.doc
    join size_own so on so.doc = gram.doc cross join size_all sa
    left join every ec on ec.g = gram.context left join own oc on oc.g = gram.context and oc.doc = gram.doc
), best as (
    select doc, i, max(k) as depth, coalesce(max(k) filter (n > 0), 1) as level,
        coalesce(max_by(log10(n / greatest(base, 1)), k) filter (n > 0), log10(1 / greatest(any_value(total), 1))) as value
    from seen group by 1, 2
), summed as (select doc, count(*) as n, sum((level < depth)::int) as off, sum(value + log10(0.4) * (depth - level)) as s from best group by 1)
select doc_id, coalesce(n, 0)::bigint as n_tokens, coalesce(off, 0)::bigint as n_backoff, round(coalesce(s, 0), 4) as log_score, round(s / n, 6) as mean_score
from words left join summed using (doc)
"""


OP4 = """
with recursive words as (
    select row_number() over () as doc, doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[ \\t\\n\\r\\x0b\\x0c]+'), lambda w: w != '') as w from documents
), shingle as (
    select distinct doc, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from words
), size as (select doc, count(*) as n from shingle group by 1),
both_ as (select a.doc as a, b.doc as b, count(*) as n from shingle a join shingle b on a.s = b.s and a.doc < b.doc group by 1, 2),
link as (select a, b from both_ join size x on x.doc = a join size y on y.doc = b where both_.n >= 0.8::double * (x.n + y.n - both_.n) - 1e-9),
sym as (select a, b from link union all select b, a from link),
reach as (select doc, doc as other from words union select r.doc, s.b from reach r join sym s on s.a = r.other),
component as (select r.doc, min(w.doc_id) as component_id from reach r join words w on w.doc = r.other group by 1),
links as (select a as doc, count(*) as n from sym group by 1)
select doc_id, coalesce(links.n, 0)::bigint as n_links, component_id, doc_id is not distinct from component_id as kept
from words join component using (doc) left join links using (doc)
"""


OP7 = """
with raw as (
    select doc_id, i - 1 as line, coalesce(text, '') as text, string_split(coalesce(text, ''), chr(10))[i] as s
    from documents, lateral (select unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) as i)
), word as (
    select distinct doc_id, line, unnest(list_filter(string_split_regex(lower(s), '[ \\t\\n\\r\\x0b\\x0c]+'), lambda w: w != '')) as w from raw
), class as (
    select doc_id, line, string_agg(w, ' ' order by w) as c, count(*) as n from word group by 1, 2
), first as (
    select c, any_value(n) as n, min((doc_id, line)) as place from class group by 1
), numbered as (select *, row_number() over () as id from first),
cw as (select id, n, unnest(string_split(c, ' ')) as w from numbered),
pair as (
    select x.id as a, y.id as b, count(*) as both_n, any_value(x.n) as m, any_value(y.n) as n from cw x join cw y on x.w = y.w and x.id < y.id
        and least(x.n, y.n) >= 0.8 * greatest(x.n, y.n) - 1e-9 group by 1, 2
), sim as (select a, b from pair where both_n >= 0.8::double * (m + n - both_n) - 1e-9),
sym as (select a, b from sim union all select b, a from sim),
earliest as (select x.c, least(x.place, coalesce(min(y.place), x.place)) as place from numbered x left join sym on sym.a = x.id left join numbered y on y.id = sym.b group by x.c, x.place),
gone as (select class.doc_id, class.line from class join earliest using (c) where (class.doc_id, class.line) > earliest.place)
select raw.doc_id, count(gone.line)::int as n_removed, md5(coalesce(string_agg(s, chr(10) order by raw.line) filter (gone.line is null), '')) as kept_md5
from raw left join gone using (doc_id, line) group by 1
"""


OP5 = """
with recursive v as (
    select row_number() over () as r, vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings
), pair as (
    select a.r as a, b.r as b from v a join v b on a.label = b.label and a.r <> b.r and list_cosine_similarity(a.e, b.e) >= 0.98
), reach as (select r, r as other from v union select x.r, p.b from reach x join pair p on p.a = x.other)
select vec_id, (select count(*) from pair where pair.a = v.r) as n_links, c.component_id, vec_id = c.component_id as kept
from v join (select x.r, min(y.vec_id) as component_id from reach x join v y on y.r = x.other group by 1) c using (r)
"""


CRC32_ID = (
    CRC32
    + """
, crc_id as (
    select doc_id, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, strlen(doc_id::varchar) + 1), lambda i: ascii((doc_id::varchar)[i::bigint])::bigint)),
        lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) as h
    from documents, crc
)
"""
)


OP11 = """
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
windows as (select doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) as x from d, lateral (select unnest(range(1, len(w) - 18)) as i) where len(w) >= 20),
later as (select doc_id, i from windows qualify row_number() over (partition by x order by doc_id, i) > 1),
gone as (select distinct doc_id, i + k as i from later, range(20) as r(k)),
lists as (select doc_id, list(i) as l from gone group by 1)
select doc_id, len(w)::bigint as n_words, coalesce(len(l), 0)::bigint as n_removed,
    sha256(coalesce(array_to_string(case when l is null then w else (select list(w[k] order by k) from range(1, len(w) + 1) as r(k) where not list_contains(l, k)) end, ' '), '')) as kept_sha256
from d left join lists using (doc_id)
"""


def _field(value: str) -> str:
    return f"coalesce(strlen(({value})::varchar) || ':' || ({value})::varchar, '-')"


_PLAIN = " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))
_FORGED = " || ".join(_field("n_chars + 1" if c == "n_chars" else c) for c in ("doc_id", "source", "lang", "n_chars", "text"))


def _tree(name: str, leaves: str) -> str:
    """Recursive levels of the trees over `leaves` (tree, i, n, d), and the path of each leaf (tree, i, path, top)."""
    return f"""
, {name} as (
    select tree, 0 as level, i, n, d from {leaves}
    union all
    select tree, level + 1, i // 2, (n + 1) // 2, sha256(string_agg(d, '' order by i)) from {name} where n > 1 group by tree, level, i // 2, n
), {name}_path as (
    select l.tree, l.i, list(case when s.d is null then '' when s.i & 1 = 1 then 'R' || s.d else 'L' || s.d end order by p.level) filter (p.n > 1) as path,
        max(p.d) filter (p.n = 1) as top
    from {leaves} l join {name} p on p.tree is not distinct from l.tree and p.i = l.i >> p.level
    left join {name} s on s.tree is not distinct from p.tree and s.level = p.level and s.i = xor(p.i, 1) and p.n > 1
    group by l.tree, l.i
)
"""


OP12 = (
    CRC32_ID
    + f"""
, leaf as (
    select lang as tree, row_number() over (partition by lang order by doc_id) - 1 as i, count(*) over (partition by lang) as n,
        sha256({_PLAIN}) as d, sha256({_FORGED}) as forged, n_chars, doc_id from documents
)"""
    + _tree("low", "leaf")
    + """
, sub as (select null::varchar as tree, row_number() over (order by tree nulls first) - 1 as i, count(*) over () as n, d, tree as name from low where n = 1)
"""
    + _tree("high", "sub")
    + """
, joined as (
    select doc_id, leaf.d as leaf, low_path.top as subroot, high_path.top as root, list_concat(coalesce(low_path.path, []), coalesce(high_path.path, [])) as path,
        case when h % 7 = 0 and n_chars is not null then forged else leaf.d end as start
    from leaf join crc_id using (doc_id) join low_path on low_path.tree is not distinct from leaf.tree and low_path.i = leaf.i
    join sub on sub.name is not distinct from leaf.tree join high_path on high_path.i = sub.i
), told as (
    select *, sha256(array_to_string(list_transform(path, lambda s: substr(s, 2)), '')) as proof_sha256,
        list_reduce(list_prepend(start, path), lambda a, s: sha256(case when s[1] = 'L' then substr(s, 2) || a when s[1] = 'R' then a || substr(s, 2) else a end)) as folded_root
    from joined
)
select doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root as verified from told
"""
)


OP13 = (
    CRC32_ID
    + """
, plain as (select doc_id, h, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents join crc_id using (doc_id)),
sized as (select *, len(w) as n, h // 10 as g from plain),
cut as (select *, g % greatest(n, 1) as a from sized),
d as (
    select doc_id, n, case when h % 10 = 0 and n > 0 then list_transform(range(0, n), lambda i: case when i < a then w[i + 1] else w[(a + (i - a) % (1 + (n - a) // (3 + g % 8))) + 1] end) else w end as w
    from cut
), word as (select doc_id, n, unnest(range(0, n)) as i, unnest(w) as x from d),
same as (select a.doc_id, a.i, b.i - a.i as q from word a join word b on a.doc_id = b.doc_id and a.x = b.x and b.i > a.i and 3 * (b.i - a.i) <= a.n),
island as (select doc_id, q, i, i - row_number() over (partition by doc_id, q order by i) as part from same),
stretch as (select doc_id, q, min(i) as start, count(*) + q as length from island group by doc_id, q, part having count(*) + q >= greatest(24, 3 * q)),
run as (select doc_id, start, length, min(q) as period from stretch group by doc_id, start, length),
gone as (select distinct doc_id, unnest(range(start + period, start + length)) as i from run),
best as (select * from run qualify row_number() over (partition by doc_id order by length / period desc, start, period) = 1),
told as (select doc_id, count(*) as n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as runs from run group by 1),
kept as (select doc_id, string_agg(x, ' ' order by i) as text from word anti join gone using (doc_id, i) group by 1)
select d.doc_id, coalesce(n_runs, 0)::bigint as n_runs, start::bigint as start, length::bigint as length, period::bigint as period, (1000 * length // period)::bigint as exponent_milli,
    sha256(coalesce(runs, '')) as runs_sha256, sha256(coalesce(kept.text, '')) as collapsed_sha256
from d left join best using (doc_id) left join told using (doc_id) left join kept using (doc_id)
"""
)


def all_sql() -> dict[str, str]:
    return {"op1_lm_scoring": OP1, "op4_ngram_join": OP4, "op5_embedding_dedup": OP5, "op7_line_dedup": OP7, "op10_sharding": OP10, "op11_substring_dedup": OP11, "op12_merkle_manifest": OP12, "op13_periodic_runs": OP13}
