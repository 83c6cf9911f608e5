"""DuckDB SQL for the queries that SQL can express."""

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_ESC = "replace(replace(t, '\\', '\\s'), '<', '\\l')"


def _crc32(text: str) -> str:
    """SQL for the unsigned crc32 of a text's UTF-8 bytes, a byte at a time over the usual table."""
    steps = []
    for i in range(256):
        for _ in range(8):
            i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
        steps.append(i)
    digits = f"list_transform(string_split(hex(encode({text})), ''), lambda h: cast(strpos('123456789ABCDEF', h) as ubigint))"
    values = f"list_transform(list_zip({digits}[1:-1:2], {digits}[2:-1:2]), lambda p: p[1] * 16 + p[2])"
    return f"cast(xor(list_reduce(list_concat([4294967295::ubigint], {values}), lambda c, b: xor(c >> 8, {steps}[cast(xor(c, b) & 255 as bigint) + 1]::ubigint)), 4294967295::ubigint) as bigint)"


OP5 = rf"""
with c as (
  select conv_id, turn, coalesce(role, '') as r, coalesce(text, '') as t from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
), w as (
  select *, row_number() over (partition by conv_id order by turn nulls first, r, t) as i,
    count(*) over (partition by conv_id) as n,
    length(replace(replace(replace(replace(r, '\', '\s'), '<', '\l'), '>', '\g'), chr(10), '\n')) + length({_ESC}) + 16 as chars
  from c
), x as (select *, sum(chars) over (partition by conv_id order by i) as upto from w)
select conv_id, max(n) as n_turns,
  sha256(string_agg(r || chr(10) || t || chr(10), '' order by i)) as turns_sha256,
  cast(coalesce(sum(length(t)) filter (where r = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(t, '' order by i) filter (where r = 'assistant'), '')) as loss_sha256,
  cast(sum(upto) filter (where r = 'assistant' or i = n) as bigint) as formatted_chars
from x group by conv_id
"""

OP6 = """
with t as (
  select doc_id, source, coalesce(strlen(text), 0) + 1 as size, CRC32_OF(coalesce(text, '')) as text_crc32 from documents
), d as (
  select *, md5('strandlake-6:' || coalesce(cast(doc_id as varchar), '') || ':' || size || ':' || text_crc32) as key from t
), k as (
  select *, (2 * (row_number() over (partition by source order by key, doc_id, size, text_crc32) - 1) + 1)::double
      / (2 * count(*) over (partition by source))::double as fraction
  from d
), p as (
  select *, row_number() over (order by fraction, key, source nulls first, doc_id, size, text_crc32) - 1 as position, count(*) over () as n from k
)
select doc_id, cast(size as bigint) as size, cast(position * 16 // n as integer) as shard,
  cast(position - ((position * 16 // n) * n + 15) // 16 as bigint) as slot, 'rows' as law,
  cast(null as integer) as grown_shard,
  text_crc32
from p
"""

OP7 = rf"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words from documents
), sets as (
  select doc_id, case when len(words) = 0 then [] when len(words) < 4 then [array_to_string(words, ' ')]
    else list_distinct(list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i : i + 3], ' '))) end as s
  from w
), classes as (
  select min(doc_id) as rep, s, hash(list_sort(s)) as h from (select doc_id, list_sort(s) as s from sets where len(s) > 0) group by s
), shingles as (select rep, len(s) as n, unnest(s) as g from classes
), common as (
  select a.rep as x, b.rep as y, count(*) as c, any_value(a.n) as n, any_value(b.n) as m
  from shingles a join shingles b on a.g = b.g and a.rep < b.rep and a.n * 100 >= 80 * b.n and b.n * 100 >= 80 * a.n group by all
), links as (select x, y from common where 100 * c >= 80 * (n + m - c)
), edges as (select x, y from links union select y, x from links
), reach as (select x, x as y from edges union select r.x, e.y from reach r join edges e on r.y = e.x
), root as (select x, min(y) as root from reach group by x)
select d.doc_id, cast(len(d.s) as bigint) as n_shingles, coalesce(root.root, c.rep, d.doc_id) as component_id,
  d.doc_id = coalesce(root.root, c.rep, d.doc_id) as kept
from sets d left join classes c on len(d.s) > 0 and c.s = list_sort(d.s) left join root on root.x = c.rep
"""

_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP8 = rf"""
with items as (select item_id, {_WORDS} as w from benchmark),
windows as (
  select distinct item_id, len(w[i : i + least(len(w), 13) - 1]) as k, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') as win
  from (select item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) as i from items where len(w) > 0)
), docs as (select row_number() over () as r, doc_id, {_WORDS} as w from documents),
sizes as (select distinct k from windows),
places as (select r, w, k, unnest(range(1, len(w) - k + 2)) as i from docs, sizes where len(w) >= k),
hits as (select p.r, p.i, p.k, v.item_id from (select r, k, i, array_to_string(w[i : i + k - 1], ' ') as win from places) p join windows v on v.k = p.k and v.win = p.win),
hit_words as (select r, count(distinct j) as n_hit from (select r, unnest(range(i, i + k)) as j from hits) group by r),
hit_items as (select r, count(distinct item_id) as n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as ids from hits group by r)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from docs left join hit_words using (r) left join hit_items using (r)
"""

ORACLES = {"op5_chat_format": OP5, "op6_sharding": OP6.replace("CRC32_OF(coalesce(text, ''))", _crc32("coalesce(text, '')")), "op7_minhash": OP7, "op8_decontaminate": OP8}
