"""SQL of the corpus queries that SQL can express on whole tables, for the oracle."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"'[^\x20\x09-\x0D]+'"
_FOLDED = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP2 = f"""
with d as (select doc_id, {_FOLDED} as w from documents),
it as (select cast(item_id as varchar) as item_id, {_FOLDED} as w from benchmark where item_id is not null),
iw as (select distinct item_id, w[s:s + least(len(w), 10) - 1] as win from (select *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as s from it where len(w) > 0)),
dp as (select doc_id, l, s, w[s:s + l - 1] as win from (select doc_id, w, l, unnest(range(1, len(w) - l + 2)) as s from d, (select distinct len(win) as l from iw) where len(w) >= l)),
hits as (select doc_id, l, s, item_id from dp join iw using (win)),
places as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(s, s + l)) as p from hits) group by doc_id),
owners as (select doc_id, count(distinct item_id) as n, string_agg(distinct item_id, ',' order by item_id) as ids from hits group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(p.n, 0) as bigint) as n_hit, cast(coalesce(o.n, 0) as bigint) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, p.n is not null as contaminated
from d left join places p using (doc_id) left join owners o using (doc_id)
"""


def _repeats(seq: str, window: str, length: str) -> str:
    """Runs (doc_id, a, b) of windows of 50 that also start in a document with a smaller doc_id."""
    return f"""
d as (select doc_id, {seq} as w from documents),
win as (select doc_id, s, {window} as k from (select doc_id, w, unnest(range(1, {length} - 48)) as s from d where {length} >= 50)),
firsts as (select k, min(doc_id) as first from win group by k),
hit as (select doc_id, s from win join firsts using (k) where first < doc_id),
cut as (select *, case when s <= lag(s) over (partition by doc_id order by s) + 50 then 0 else 1 end as new from hit),
runs as (select doc_id, min(s) as a, max(s) + 49 as b from (select *, sum(new) over (partition by doc_id order by s) as r from cut) group by doc_id, r),
gone as (select doc_id, sum(b - a + 1) as n_removed, count(*) as n_spans from runs group by doc_id),
edges as (select doc_id, a, b from runs union all select doc_id, {length} + 1, {length} from d),
kept as (select doc_id, coalesce(lag(b) over (partition by doc_id order by a), 0) + 1 as x, a - 1 as y from edges)"""


OP3 = f"""
with {_repeats("encode(coalesce(text, ''))", "w[s:s + 49]", "octet_length(w)")},
bytes as (select doc_id, unhex(coalesce(string_agg(hex(w[x:y]), '' order by x) filter (where y >= x), '')) as k from kept join d using (doc_id) group by doc_id)
select d.doc_id, cast(octet_length(w) as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, cast(coalesce(n_spans, 0) as bigint) as n_spans, sha256(k) as kept_sha256
from d join bytes using (doc_id) left join gone using (doc_id)
"""

OP6 = f"""
with {_repeats(f"regexp_extract_all(coalesce(text, ''), {_WORD})", "array_to_string(w[s:s + 49], ' ')", "len(w)")},
words as (select doc_id, coalesce(string_agg(array_to_string(w[x:y], ' '), ' ' order by x) filter (where y >= x), '') as k from kept join d using (doc_id) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_removed, 0) as bigint) as n_removed, sha256(k) as kept_sha256
from d join words using (doc_id) left join gone using (doc_id)
"""

OP7 = f"""
with l as (select doc_id, unnest(range(0, len(t))) as line_no, unnest(t) as line from (select doc_id, string_split(text, chr(10)) as t from documents)),
ln as (select doc_id, line_no, {{'d': doc_id, 'l': line_no}} as place, regexp_extract_all(line, {_WORD}) as w from l where regexp_matches(line, {_WORD})),
f as (select w, min(place) as first from ln group by w),
v as (select first, i, list_concat(w[:i - 1], w[i + 1:]) as k from (select *, unnest(range(1, len(w) + 1)) as i from f where len(w) >= 5)),
near as (
  select a.first from v a join v b on a.k = b.k and a.i = b.i where b.first < a.first
  union select case when f.first < v.first then v.first else f.first end from f join v on f.w = v.k where len(f.w) >= 5),
why as (select doc_id, line_no, case when f.first < place then 'equal' when n.first is not null then 'near' end as why from ln join f using (w) left join near n on n.first = f.first),
r as (select doc_id, count(*) as n_lines, count(*) filter (where why = 'equal') as n_equal, count(*) filter (where why = 'near') as n_near,
  string_agg(cast(line_no as varchar), ',' order by line_no) filter (where why is not null) as removed from why group by doc_id)
select doc_id, cast(coalesce(n_lines, 0) as bigint) as n_lines, cast(coalesce(n_equal, 0) as bigint) as n_equal, cast(coalesce(n_near, 0) as bigint) as n_near, coalesce(removed, '') as removed
from documents left join r using (doc_id)
"""

_CRC_TABLE = "(select list(c order by i) as crc_table from (select i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c from (select unnest(range(256)) as i)))"


def _crc(t: str) -> str:
    """The crc32 of a text, byte by byte through a table of 256 remainders."""
    b = f"list_transform(range(0, octet_length(encode({t})), 1), lambda k: cast('0x' || hex(encode({t}))[2 * k + 1:2 * k + 2] as bigint))"
    return f"xor(list_reduce(list_concat([4294967295], {b}), lambda c, x: xor(c >> 8, crc_table[(xor(c, x) & 255) + 1])), 4294967295)"


def _leaf(text: str) -> str:
    field = lambda v: f"coalesce(octet_length(encode(cast({v} as varchar))) || ':' || {v}, '-')"
    return "sha256(" + " || ".join(field(v) for v in ("doc_id", "source", "lang", "n_chars", text)) + ")"


OP13 = f"""
with recursive leaves as (select source, doc_id, {_leaf('text')} as leaf,
    case when {_crc('cast(doc_id as varchar)')} % 5 = 0 then {_leaf(f"translate(text, '{_UPPER}', '{_LOWER}')")} else {_leaf('text')} end as other from documents, {_CRC_TABLE}),
places as (select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by source) as n from leaves),
lv as (select source, 0 as lvl, pos, leaf as h, n from places
  union all select source, lvl + 1, pos // 16, sha256(string_agg(h, '' order by pos)), (n + 15) // 16 from lv where n > 1 group by source, lvl, pos // 16, n),
subs as (select source, h as subroot, row_number() over (order by encode(source) nulls first) - 1 as pos, count(*) over () as n from lv where n = 1),
top as (select 0 as lvl, pos, subroot as h, n from subs
  union all select lvl + 1, pos // 16, sha256(string_agg(h, '' order by pos)), (n + 15) // 16 from top where n > 1 group by lvl, pos // 16, n),
steps as (
  select p.source, p.doc_id, p.pos as leaf_pos, a.lvl as step, coalesce(string_agg(b.h, '' order by b.pos) filter (where b.pos < a.pos), '') as l, coalesce(string_agg(b.h, '' order by b.pos) filter (where b.pos > a.pos), '') as r
  from places p join lv a on a.source is not distinct from p.source and a.n > 1 and a.pos = p.pos // (16 ** a.lvl)::bigint
    join lv b on b.source is not distinct from a.source and b.lvl = a.lvl and b.pos // 16 = a.pos // 16 group by all
  union all
  select p.source, p.doc_id, p.pos, 100 + a.lvl, coalesce(string_agg(b.h, '' order by b.pos) filter (where b.pos < a.pos), ''), coalesce(string_agg(b.h, '' order by b.pos) filter (where b.pos > a.pos), '')
  from places p join subs s on s.source is not distinct from p.source join top a on a.n > 1 and a.pos = s.pos // (16 ** a.lvl)::bigint
    join top b on b.lvl = a.lvl and b.pos // 16 = a.pos // 16 group by all),
ordered as (select *, row_number() over (partition by source, leaf_pos order by step) as k from steps),
fold as (select source, pos, 0::bigint as k, other as h from places
  union all select f.source, f.pos, o.k, sha256(o.l || f.h || o.r) from fold f join ordered o on o.source is not distinct from f.source and o.leaf_pos = f.pos and o.k = f.k + 1),
proof as (select source, leaf_pos, sha256(string_agg(l || r, '' order by k)) as proof_sha256, max(k) as k from ordered group by all),
root as (select h as root from top where n = 1)
select p.doc_id, p.leaf, s.subroot, root, coalesce(q.proof_sha256, sha256('')) as proof_sha256, f.h as folded_root, f.h = root as verified
from places p join subs s on s.source is not distinct from p.source cross join root
  left join proof q on q.source is not distinct from p.source and q.leaf_pos = p.pos
  join fold f on f.source is not distinct from p.source and f.pos = p.pos and f.k = coalesce(q.k, 0)
"""

OP11 = f"""
with d as (select doc_id, {_FOLDED} as w from documents), it as (select unnest({_FOLDED}) as w from benchmark),
dw as (select row, doc_id, unnest(w) as w from (select *, row_number() over () as row from d)),
known as (select w, {_crc('w')} % 10000 as bucket from (select w from dw union select w from it), {_CRC_TABLE}),
s as (select bucket, count(*) as s from dw join known using (w) group by bucket), t as (select bucket, count(*) as t from it join known using (w) group by bucket),
totals as (select (select count(*) from dw) as ss, (select count(*) from it) as tt),
gain as (select bucket, floor(1000 * ln((coalesce(t, 0) + 1)::double * (ss + 10000)::double / ((coalesce(s, 0) + 1)::double * (tt + 10000)::double))) as gain from s full join t using (bucket) cross join totals),
weights as (select row, count(*) as n, cast(floor(sum(gain) / count(*)) as bigint) as weight from dw join known using (w) join gain using (bucket) group by row),
noise as (select *, cast(('0x' || substr(sha256('2024:' || coalesce(cast(doc_id as varchar), '')), 1, 8)) as bigint) as h from (select doc_id, row_number() over () as row from d)),
scored as (select doc_id, coalesce(n, 0) as n_features, coalesce(weight, 0) as weight, coalesce(weight, 0) + cast(floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296::double))) as bigint) as score from noise left join weights using (row)),
ranked as (select *, row_number() over (partition by n_features >= 20 order by score desc, doc_id nulls first) as r, count(*) filter (where n_features >= 20) over () as long from scored)
select doc_id, cast(n_features as bigint) as n_features, weight, score, case when n_features >= 20 and r <= 10 * long // 100 then r end as rank from ranked
"""

OP12 = """
with recursive v as (select row_number() over () as row, vec_id, cast(embedding as double[]) as e from embeddings),
ok as (select * from v where len(e) > 0 and len(list_filter(e, lambda x: x is not null and isfinite(x))) = len(e) and len(list_filter(e, lambda x: x <> 0)) > 0),
links as (select a.row as a, b.row as b, b.vec_id from ok a join ok b on a.row <> b.row and list_cosine_similarity(a.e, b.e) >= 0.9),
reach as (select row, row as at, vec_id from v union select r.row, l.b, l.vec_id from reach r join links l on l.a = r.at),
found as (select row, min(vec_id) as component_id from reach group by row),
counts as (select a as row, count(*) as n from links group by a)
select vec_id, cast(coalesce(n, 0) as bigint) as n_links, component_id, vec_id is not distinct from component_id as kept from v join found using (row) left join counts using (row)
"""
