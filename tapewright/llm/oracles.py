"""SQL for DuckDB that gives the rows of the queries that SQL can express."""

from __future__ import annotations

import math

from . import mixing as _mixing

PREFERENCES = r"""
with turns as (select conv_id pair_id, turn, role, text from conversations where conv_id is not null and turn is not null),
ends as (select pair_id, max(turn) last_turn from turns where role = 'assistant' group by 1),
last_answer as (
  select pair_id, coalesce(min(turn) filter (where role = 'assistant' and 4 * turn >= (1 + ((pair_id % 4) + 4) % 4) * last_turn), max(last_turn)) last_turn
  from turns join ends using (pair_id) group by 1),
stale as (select t.pair_id, arg_max(t.text, t.turn) stale from turns t join last_answer l using (pair_id) where role = 'assistant' and turn < last_turn group by 1),
chosen as (select t.*, row_number() over (partition by pair_id order by turn, role, text) - 1 place from turns t join last_answer using (pair_id)),
rejected as (
  select pair_id, turn, role, text, row_number() over (partition by pair_id order by turn, role, text) - 1 place
  from (select t.pair_id, turn, role, case when turn = last_turn and role = 'assistant' then coalesce(stale, '') else text end as text
        from turns t join last_answer l using (pair_id) left join stale s using (pair_id) where turn <= last_turn)),
shared as (
  select pair_id, coalesce(min(place) filter (where not same), max(place) + 1) n_shared from (
    select coalesce(c.pair_id, r.pair_id) pair_id, coalesce(c.place, r.place) place,
           c.place is not null and r.place is not null and c.role is not distinct from r.role and c.text is not distinct from r.text same
    from chosen c full join rejected r on c.pair_id = r.pair_id and c.place = r.place) group by 1),
parts as (
  select pair_id, case when place < n_shared then 'prompt' else 'chosen' end part, case when place < n_shared then place else place - n_shared end place, role, text, place >= n_shared and role = 'assistant' counted
  from chosen join shared using (pair_id)
  union all
  select pair_id, 'rejected', place - n_shared, role, text, role = 'assistant' from rejected join shared using (pair_id) where place >= n_shared),
pieces as (
  select *, place // 256 chunk, '<|' || coalesce(role, '') || '|>' || chr(10) as head,
         '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) as piece from parts),
upto as (select *, sum(length(piece)) over (partition by pair_id, part, chunk order by place) e from pieces)
select pair_id, part, cast(chunk as bigint) chunk, count(*) n_turns, string_agg(piece, '' order by place) as text,
       coalesce(string_agg(cast(e - length(piece) + length(head) as varchar) || ':' || cast(e - 1 as varchar), ',' order by place) filter (where counted), '') loss_spans
from upto group by pair_id, part, chunk
"""


def mixing(shares: dict[str, int] = _mixing.SHARES, rest: int = _mixing.REST, block: int = _mixing.BLOCK) -> str:
    """Earliest deadline first, slot by slot, as a recursive query; every source that occurs has a share of its own, as weights_by_source() gives it."""
    listed, unit = ", ".join(f"'{s}'" for s in shares), math.gcd(*shares.values())
    weights = " union all ".join(f"select {k} stream, '{s}' source, {a} * n w from others_n" for k, (s, a) in enumerate(shares.items()))
    return f"""
with recursive others as (select source, {len(shares) - 1} + row_number() over (order by source) stream from (select distinct source from documents where source is not null and source not in ({listed}))),
others_n as (select named, greatest(1, named + nulls) n from (select count(*) named from others), (select least(1, count(*)) nulls from documents where source is null)),
weights as (
  select stream, source, w // gcd({rest}, {unit} * n) a from others_n, (
    {weights} union all select stream, source, {rest} from others union all select {len(shares)} + named, null, {rest} from others_n)),
streamed as (select doc_id, d.source, coalesce(w.stream, (select max(stream) from weights)) stream from documents d left join weights w on d.source = w.source),
docs as (select *, row_number() over (partition by stream order by md5(coalesce(cast(doc_id as varchar), '')), doc_id) - 1 row_ from streamed),
sizes as (select list(a order by stream) a, list(coalesce(b, 0) order by stream) b, sum(coalesce(b, 0)) n_blocks, list(stream order by stream) streams
          from weights left join (select stream, (count(*) + {block - 1}) // {block} b from docs group by 1) using (stream)),
steps as (
  select cast(-1 as bigint) slot, cast(-1 as bigint) pick, cast(-1 as bigint) block, cast(0 as bigint) t, list_transform(b, lambda x : cast(0 as bigint)) c, list_transform(b, lambda x : cast(0 as bigint)) p from sizes
  union all
  select slot + 1, pick, c[pick + 1], case when last_one then 0 else t + 1 end,
         list_transform(streams, lambda k : c[k + 1] + (k = pick)::bigint), list_transform(streams, lambda k : case when last_one then 0 else p[k + 1] + (k = pick)::bigint end)
  from (select slot, t, c, p, streams, pick, c[pick + 1] + 1 = b[pick + 1] last_one
        from (select *, list_position(keys, list_min(keys)) - 1 pick
              from (select *, list_transform(streams, lambda k : case when c[k + 1] < b[k + 1] and p[k + 1] * q // a[k + 1] <= t
                                then ((p[k + 1] + 1) * q + a[k + 1] - 1) // a[k + 1] * 10000000000 + (99999 - a[k + 1]) * 100000 + k else 9000000000000000000 end) keys
                    from (select slot, t, c, p, a, b, streams, list_sum(list_transform(streams, lambda k : case when c[k + 1] < b[k + 1] then a[k + 1] else 0 end))::bigint q
                          from steps, sizes where slot + 1 < n_blocks))))
)
select doc_id, source, cast(docs.stream as bigint) stream, cast(row_ // {block} as bigint) block, slot, cast(row_ % {block} as bigint) place,
       row_number() over (order by slot, row_ % {block}) - 1 as position
from docs join steps on docs.stream = pick and row_ // {block} = steps.block
"""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR_DUPLICATES = rf"""
with recursive texts as (select doc_id, list_filter(string_split_regex({_LOWER.format("coalesce(text, '')")}, '[\x20\x09-\x0D]+'), lambda w : w <> '') w from documents),
sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
                 else list_distinct(list_transform(range(len(w) - 3), lambda i : array_to_string(w[i + 1 : i + 4], ' '))) end s from texts),
items as (select doc_id, len(s) n, unnest(s) item from sets),
links as (
  select a.doc_id a, b.doc_id b from items a join items b on a.item = b.item and a.doc_id <> b.doc_id
  group by a.doc_id, b.doc_id having 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
reached as (select doc_id a, doc_id b from documents union select reached.a, links.b from reached join links on reached.b = links.a)
select doc_id, cast(len(s) as bigint) n_shingles, component_id, doc_id = component_id kept
from sets join (select a doc_id, min(b) component_id from reached group by 1) using (doc_id)
"""

COLLOCATIONS = rf"""
with pieces as (select coalesce(lang, 'und') lang, unnest(string_split_regex({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) piece from documents),
lists as (select lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w : w <> '') w from pieces),
grams as (
  select lang, unnest(list_transform(range(len(w)), lambda i : w[i + 1 : i + 1])) g from lists
  union all select lang, unnest(list_transform(range(len(w) - 1), lambda i : w[i + 1 : i + 2])) from lists
  union all select lang, unnest(list_transform(range(len(w) - 2), lambda i : w[i + 1 : i + 3])) from lists),
counts as (select lang, g, count(*) f from grams group by all having count(*) >= 10),
totals as (select lang, sum(len(w))::bigint n from lists group by 1),
found as (select lang, g, f a from counts where len(g) > 1),
cuts as (
  select lang, found.g, a, k, x.f l, y.f r, ((a::hugeint * a * 1000000) // (x.f::hugeint * y.f))::bigint score
  from (select *, unnest(range(1, len(g))) k from found) found join counts x using (lang) join counts y using (lang)
  where x.g = found.g[1 : k] and y.g = found.g[k + 1 : len(found.g)]),
weakest as (select * from cuts qualify row_number() over (partition by lang, g order by score, k) = 1),
longer as (
  select lang, g[1 : len(g) - 1] g, a f from found where len(g) > 2 union all select lang, g[2 : len(g)], a from found where len(g) > 2),
left_ as (select w.* from weakest w anti join (select l.lang, l.g from longer l join found on found.lang = l.lang and found.g = l.g where 100 * l.f >= 50 * found.a) d on w.lang = d.lang and w.g = d.g),
ranked as (select lang, array_to_string(g, ' ') phrase, a, l, r, score, row_number() over (partition by lang order by score desc, a desc, array_to_string(g, ' ')) as rank from left_)
select lang, rank, phrase, a, l, r, n, score from ranked join totals using (lang) where rank <= 2000
"""


def merkle(levels: int = 6, top_levels: int = 5) -> str:
    """The manifest level by level, for sources of up to 16 ** levels rows and 16 ** top_levels sources."""
    field = "coalesce(strlen({0}) || ':' || {0}, '-')"
    leaf = lambda text: "sha256(" + " || ".join(field.format(c) for c in ("doc_id::varchar", "source", "lang", "n_chars::varchar", text)) + ")"
    steps = []

    def tree(name: str, key: str, depth: int) -> None:
        """name0 (key, idx, n, d) -> name1 ... and name_runs1 ..., name_root."""
        for j in range(1, depth + 1):
            steps.append(f"{name}_runs{j} as (select {key}, idx // 16 up, list(d order by idx) ds, any_value(n) n from {name}{j - 1} where n > 1 group by {key}, idx // 16)")
            steps.append(f"{name}{j} as (select {key}, up idx, sha256(array_to_string(ds, '')) d, (n + 15) // 16 n from {name}_runs{j})")
        steps.append(f"{name}_root as (" + " union all ".join(f"select {key}, d from {name}{j} where n = 1" for j in range(depth + 1)) + ")")

    def climb(path: str, name: str, key: str, place: str, depth: int, first: int) -> None:
        for j in range(1, depth + 1):
            at, k = f"{path}{first + j - 1}", f"p.{place} // {16 ** (j - 1)} % 16"
            steps.append(
                f"{path}{first + j} as (select p.* exclude (h, proof), case when ds is null then h else sha256(array_to_string(list_transform(ds, lambda x, i : case when i - 1 = {k} then h else x end), '')) end h, "
                f"proof || coalesce(array_to_string(list_filter(ds, lambda x, i : i - 1 <> {k}), ''), '') proof from {at} p left join {name}_runs{j} r on p.{key} is not distinct from r.{key} and p.{place} // {16 ** j} = r.up)"
            )

    tree("s", "source", levels)
    steps.append("ranked as (select source, d, row_number() over (order by source nulls first) - 1 tree, count(*) over () n_trees from s_root)")
    steps.append("t0 as (select 0 one, tree idx, n_trees n, d from ranked)")
    tree("t", "one", top_levels)
    steps.append("p0 as (select l.*, tree, 0 one, r.d subroot, claimed h, '' proof from leaves l join ranked r on l.source is not distinct from r.source)")
    climb("p", "s", "source", "idx", levels, 0)
    climb("p", "t", "one", "tree", top_levels, levels)
    return f"""
with crc_table as (select list_transform(range(256), lambda n : list_reduce(range(8), lambda c, i : case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end, n)) t),
sums as (select d.*, xor(list_reduce(list_transform(string_split(doc_id::varchar, ''), lambda x : ord(x)::bigint), lambda c, b : xor(c // 256, t[xor(c, b) % 256 + 1]), 4294967295), 4294967295) crc from documents d, crc_table),
leaves as (
  select *, row_number() over (partition by source order by doc_id nulls first, d, claimed) - 1 idx, count(*) over (partition by source) n
  from (select doc_id, source, {leaf("text")} d, case when crc % 5 = 0 then {leaf(_LOWER.format("text"))} else {leaf("text")} end claimed from sums)),
s0 as (select source, idx, n, d from leaves),
{", ".join(steps)}
select doc_id, p.d leaf, subroot, r.d root, sha256(proof) proof_sha256, h folded_root, h = r.d verified from p{levels + top_levels} p, t_root r
"""
