"""SQL that gives the same rows as a query, over whole tables, where SQL can express it."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _kind(name: str, pattern: str, value: str, least: int) -> str:
    """Spans of one kind: doc_id, source, k, s, e, value; places from the lengths of matches and of the pieces between."""
    p = pattern.replace("'", "''")
    return f"""select doc_id, source, {name} k, s, s + len(m[i]) e, v[i] as value from (
        select *, unnest(range(1, len(m) + 1)) i, coalesce(list_sum(list_transform(p[1:i], lambda x: len(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: len(x))), 0) s
        from (select doc_id, source, regexp_extract_all(t, '{p}') m, regexp_extract_all(t, '{p}', {value}) v, string_split_regex(t, '{p}') p from texts)
    ) where len(v[i]) >= {least}"""


_ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
OP1 = f"""
with texts as (select doc_id, coalesce(source, '') source, coalesce(text, '') t from documents),
base as ({_kind("0", _ASSIGN, "2", 6)} union all {_kind("1", "AKIA[A-Z0-9]+", "0", 20)} union all {_kind("2", "[0-9a-f]+", "0", 24)}),
runs as (
    select * from ({_kind("3", "[A-Za-z0-9+/_-]{20,}", "0", 20)}) r
    where len(list_distinct(string_split(r.value, ''))) >= 10 and len(regexp_replace(r.value, '[^0-9]', '', 'g')) >= 3 and regexp_matches(r.value, '[A-Za-z]')
    and not exists (select 1 from base b where b.doc_id = r.doc_id and b.s < r.e and r.s < b.e)
),
each as (select * from base union all select * from runs),
held as (select value, count(distinct split_part(source, '/', 1)) > 1 shared from each group by value),
marked as (select each.*, held.shared from each join held using (value)),
per as (
    select doc_id, count(*) filter (k = 0) n_assign, count(*) filter (k = 1) n_access, count(*) filter (k = 2) n_hex,
        string_agg(['assign', 'access', 'hex', 'owned'][k + 1] || ':' || s || ':' || e, ',' order by s, k) filter (k < 3) base,
        string_agg(['assign', 'access', 'hex', 'owned'][k + 1] || ':' || s || ':' || e, ',' order by s, k) filter (k < 3 or not shared) spans,
        count(*) filter (not shared) n_live, count(*) filter (shared) n_copied
    from marked group by doc_id
)
select doc_id, coalesce(n_assign, 0) n_assign, coalesce(n_access, 0) n_access, coalesce(n_hex, 0) n_hex, sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans, coalesce(n_live, 0) n_live, coalesce(n_copied, 0) n_copied
from texts left join per using (doc_id)
"""  # noqa: S608

OP2 = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
win as (select doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) h from (select doc_id, w, unnest(range(1, len(w) - 48)) i from d)),
first as (select h, min(doc_id) f from win group by h),
gone as (select distinct doc_id, p from (select doc_id, unnest(range(i, i + 50)) p from win join first using (h) where f < doc_id)),
words as (select doc_id, p, w[p] x from (select doc_id, w, unnest(range(1, len(w) + 1)) p from d)),
per as (select words.doc_id, count(gone.p) n_removed, string_agg(x, ' ' order by words.p) filter (gone.p is null) kept from words left join gone on gone.doc_id = words.doc_id and gone.p = words.p group by 1)
select d.doc_id, len(w)::bigint n_words, coalesce(n_removed, 0) n_removed, sha256(coalesce(kept, '')) kept_sha256 from d left join per using (doc_id)
"""

OP3 = rf"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
item as (select distinct item_id, k, array_to_string(w[i:i + k - 1], ' ') h from (select item_id, w, k, unnest(range(1, len(w) - k + 2)) i from (select *, least(len(w), 13) k from b where len(w) > 0))),
sizes as (select distinct k from item),
win as (select doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') h from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) i from d, sizes where len(w) >= k)),
hits as (select doc_id, win.k, i, item_id from win join item on win.k = item.k and win.h = item.h),
n as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + k)) p from hits) group by 1),
m as (select doc_id, count(*) n_items, string_agg(item_id, ',' order by item_id) items from (select distinct doc_id, item_id::varchar item_id from hits) group by 1)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 and 20 * n_hit >= len(w) contaminated
from d left join n using (doc_id) left join m using (doc_id)
"""

OP4 = rf"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') w from documents),
s as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') h from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) i from d where len(w) > 0)),
n as (select doc_id, count(*) n from s group by doc_id),
shared as (select a.doc_id a, b.doc_id b, count(*) n from s a join s b on a.h = b.h and a.doc_id <> b.doc_id group by 1, 2),
links as (select a, b from shared join n x on x.doc_id = a join n y on y.doc_id = b where 100 * shared.n >= 85 * (x.n + y.n - shared.n)),
reach as (select doc_id, doc_id r from d union select reach.doc_id, b from reach join links on a = r)
select d.doc_id, coalesce(any_value(n.n), 0) n_shingles, min(r) component_id, d.doc_id = min(r) kept from d left join n using (doc_id) join reach using (doc_id) group by d.doc_id
"""
