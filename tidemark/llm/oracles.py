"""DuckDB SQL for the rows of those document queries that SQL can express."""

from __future__ import annotations

from tidemark.llm import sharding
from tidemark.llm.text import LOWER, UPPER

WORDS = f"list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"


def near_duplicates(words: int, percent: int) -> str:
    """All pairs that share a shingle, then everything that a document reaches."""
    return f"""with recursive w as (select doc_id, {WORDS} as w from documents where doc_id is not null),
s as (select distinct doc_id, shingle from (select doc_id, unnest(case when len(w) >= {words} then list_transform(generate_series(1, len(w) - {words - 1}), lambda i: array_to_string(w[i : i + {words - 1}], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as shingle from w)),
n as (select doc_id, count(*) as n from s group by 1), p as (select a.doc_id as x, b.doc_id as y, count(*) as i from s a join s b on a.shingle = b.shingle and a.doc_id < b.doc_id group by 1, 2),
l as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * i >= {percent} * (a.n + b.n - i)), e as (select x, y from l union all select y, x from l),
reach as (select distinct doc_id, doc_id as other from w union select reach.doc_id, e.y from reach join e on e.x = reach.other), c as (select doc_id, min(other) as component_id from reach group by 1)
select w.doc_id, coalesce(n, 0) as n_shingles, component_id, w.doc_id = component_id as kept from w join c on c.doc_id = w.doc_id left join n on n.doc_id = w.doc_id"""


def repeats(length: int) -> str:
    """Every string of ``length`` bytes (as hex text) with the smallest document that it starts in."""
    return f"""with t as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents where doc_id is not null),
o as (select doc_id, k * 1024 as begins, substr(h, k * 2048 + 1, {2048 + 2 * length - 2}) as h from (select doc_id, h, unnest(generate_series(0, (length(h) // 2 - {length}) // 1024)) as k from t where length(h) >= {2 * length})),
p as (select doc_id, begins + i as i, unhex(substr(h, 2 * i + 1, {2 * length})) as w from (select doc_id, begins, h, unnest(generate_series(0, length(h) // 2 - {length})) as i from o)),
f as (select w, min(doc_id) as first from p group by w), c as (select p.doc_id, p.i from p join f on f.w = p.w where first < p.doc_id),
r as (select doc_id, min(i) as a, max(i) + {length} as b from (select *, sum(new) over (partition by doc_id order by i) as run from (select *, case when i - lag(i) over (partition by doc_id order by i) <= {length} then 0 else 1 end as new from c)) group by doc_id, run),
k as (select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) as before from r),
g as (select t.doc_id, any_value(h) as h, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' order by a) as rest, max(b) as last, sum(b - a) as removed, count(a) as spans from t left join k on k.doc_id = t.doc_id group by t.doc_id)
select doc_id, length(h) // 2 as n_bytes, cast(coalesce(removed, 0) as bigint) as n_removed, spans as n_spans, sha256(unhex(coalesce(rest, '') || substr(h, 2 * coalesce(last, 0) + 1))) as kept_sha256 from g"""


def placement(shards: list[str], slots: int = sharding.SLOTS) -> str:
    """The look-up table is written out; it is filled by the rule that ``sharding`` states."""
    names = ", ".join(f"'{s}'" for s in shards)
    table = ", ".join(str(i + 1) for i in sharding.fill(shards, slots))
    return f"""with t as (select [{names}] as names, [{table}] as slots), k as (select doc_id, coalesce(cast('0x' || substr(md5(cast(doc_id as varchar)), 1, 15) as bigint) % {slots}, 0) as slot from documents) select doc_id, slot, names[slots[slot + 1]] as shard from k, t"""


def _levels(name: str, count: int) -> str:
    """CTEs {name}0 .. {name}{count} of a tree's nodes (g, i, n, h), and {name}s0 .. with what stands on either side."""
    out = []
    for k in range(count):
        sides = "over (partition by g, i // 3 order by i rows between"
        out.append(
            f"""{name}s{k} as (select *, case when n = 1 then '' else coalesce(string_agg(h, '') {sides} unbounded preceding and 1 preceding), '') end as lft,
case when n = 1 then '' else coalesce(string_agg(h, '') {sides} 1 following and unbounded following), '') end as rgt from {name}{k}),
{name}{k + 1} as (select g, i // 3 as i, (any_value(n) + 2) // 3 as n, case when any_value(n) = 1 then any_value(h) else sha256(string_agg(h, '' order by i)) end as h from {name}{k} group by g, i // 3)"""
        )
    return ",\n".join(out)


def _climb(name: str, source: str, count: int) -> str:
    """CTEs {name}0 .. {name}{count}: each document's folded hash f and siblings so far, one level up at a time."""
    out = []
    for k in range(count):
        before = f"{name}{k}"
        out.append(
            f"""{name}{k + 1} as (select d.doc_id, d.row, d.g, d.i // 3 as i, case when s.n = 1 then d.f else sha256(s.lft || d.f || s.rgt) end as f, d.proof || s.lft || s.rgt as proof
from {before} d join {source}s{k} s on s.g = d.g and s.i = d.i)"""
        )
    return ",\n".join(out)


def merkle(levels: int = 13, top_levels: int = 7) -> str:
    """The trees level by level: as many as 3 ** levels rows of a source and 3 ** top_levels sources."""
    part = lambda c: f"coalesce(cast(strlen(cast({c} as varchar)) as varchar) || ':' || cast({c} as varchar), '-')"
    leaf = lambda text: f"sha256({' || '.join(part(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"
    bits = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    crc = f"xor(list_reduce(list_prepend(cast(4294967295 as bigint), list_transform(string_split(cast(doc_id as varchar), ''), lambda x: cast(ord(x) as bigint))), lambda c, b: {bits}), 4294967295)"
    return f"""with b as (select doc_id, coalesce('=' || source, '-') as g, {leaf("text")} as leaf, case when {crc} % 2 = 0 then {leaf("replace(text, chr(10), '')")} else {leaf("text")} end as changed from documents),
o as (select *, row_number() over (order by g, doc_id nulls first, leaf) as row, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by g) as n from b),
a0 as (select g, i, n, leaf as h from o),
{_levels("a", levels)},
t0 as (select '' as g, row_number() over (order by g) - 1 as i, count(*) over () as n, h, g as name from a{levels}),
{_levels("t", top_levels)},
c0 as (select doc_id, row, g, i, changed as f, '' as proof from o),
{_climb("c", "a", levels)},
e0 as (select c.doc_id, c.row, t.g, t.i, c.f, c.proof from c{levels} c join t0 t on t.name = c.g),
{_climb("e", "t", top_levels)}
select o.doc_id, o.leaf, s.h as subroot, r.h as root, sha256(e.proof) as proof_sha256, e.f as folded_root, e.f = r.h as verified
from o join a{levels} s on s.g = o.g join e{top_levels} e on e.row = o.row cross join t{top_levels} r"""
