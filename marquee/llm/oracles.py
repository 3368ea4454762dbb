"""SQL over the same tables for the queries that SQL can express."""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]+"

# Capping by level: with sources ordered by limit per weight, the capped ones come first.
OP9 = rf"""
with docs as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::bigint as size,
         ('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 15))::bigint as h
  from documents
), per as (
  select source, sum(size)::bigint as source_size from docs group by source
), ranked as (
  select source, source_size, 2.0::double * source_size as cap,
         list_extract([5.0::double, 2.0::double, 1.0::double],
                      1 + cast((row_number() over (order by source nulls last) - 1) % 3 as int)) as weight
  from per
), levels as (
  select *, row_number() over (order by cap / weight, source nulls last) as place,
         (sum(source_size) over () * 1.5::double
          - coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))
         / sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following) as level
  from ranked
), goals as (
  select source, source_size, least(cap, coalesce(
      (select min_by(level, place) from levels where level * weight <= cap) * weight, cap)) as target
  from levels
), shares as (
  select source, source_size, target,
         case when source_size > 0 then floor(target / source_size) else 0 end as copies,
         target - case when source_size > 0 then floor(target / source_size) else 0 end * source_size as rest
  from goals
), running as (
  select d.*, s.source_size, s.target, s.copies, s.rest,
         sum(size) over (partition by d.source order by h range between unbounded preceding and current row) as upto,
         sum(size) over (partition by d.source, h) as words
  from docs d join shares s on d.source is not distinct from s.source
)
select doc_id, size, source_size, target,
       cast(size * (copies + case when upto <= rest or (upto - words <= rest and (rest - (upto - words)) * 2 >= words)
                             then 1 else 0 end) as bigint) as taken
from running
"""



def _field(value: str, is_text: bool = False) -> str:
    text = value if is_text else f"cast({value} as varchar)"
    return f"coalesce(cast(strlen({text}) as varchar) || ':' || {text}, '-')"


def _leaf(text: str) -> str:
    head = [_field(c) for c in ("doc_id", "source", "lang", "n_chars")]
    return f"sha256({' || '.join([*head, _field(text, True)])})"


# CRC-32 of the decimal digits, bit by bit; only its parity is used.
_BITS = "flatten(list_transform(string_split(cast(doc_id as varchar), ''), lambda c: list_transform(range(8), lambda j: (ord(c) >> j) & 1)))"
_CRC = (
    f"xor(list_reduce(list_prepend(4294967295::bigint, {_BITS}::bigint[]), "
    "lambda a, b: xor(a >> 1, 3988292384::bigint * (xor(a, b) & 1))), 4294967295::bigint)"
)


def _tree(name: str, leaves: str) -> str:
    """All levels of the trees of ``leaves`` (tree, idx, h): three consecutive nodes become one, until one is left."""
    return f"""
{name} as (
  select tree, 0 as lv, idx, h from {leaves}
  union all
  select tree, lv + 1, idx // 3, sha256(string_agg(h, '' order by idx))
  from (select *, count(*) over (partition by tree) as n from {name})
  where n > 1 group by tree, lv, idx // 3
)"""


def _witness(name: str, leaves: str, tree: str) -> str:
    """Siblings before and after each leaf's subtree, by level."""
    return f"""
{name} as (
  select l.id, t.lv,
         coalesce(string_agg(t.h, '' order by t.idx) filter (t.idx < l.idx // cast(pow(3, t.lv) as bigint)), '') as lefts,
         coalesce(string_agg(t.h, '' order by t.idx) filter (t.idx > l.idx // cast(pow(3, t.lv) as bigint)), '') as rights
  from {leaves} l join {tree} t
    on t.tree = l.tree and t.idx // 3 = l.idx // cast(pow(3, t.lv) as bigint) // 3
   and t.lv < (select max(lv) from {tree} x where x.tree = l.tree)
  group by l.id, t.lv
)"""


OP11 = f"""
with recursive docs as (
  select row_number() over () as id, doc_id, coalesce('=' || source, '') as tree,
         {_leaf('text')} as h,
         {_leaf("case when " + _CRC + " % 2 = 0 then replace(text, chr(10), '') else text end")} as changed
  from documents
), leaves as (
  select *, row_number() over (partition by tree order by doc_id nulls first, h, id) - 1 as idx from docs
), {_tree('nodes', 'leaves')}, subroots as (
  select tree as source, h from nodes n
  where lv = (select max(lv) from nodes x where x.tree = n.tree)
), sources as (
  select source as id, '' as tree, h, row_number() over (order by encode(source)) - 1 as idx from subroots
), {_tree('tops', 'sources')}, {_witness('below', 'leaves', 'nodes')}, {_witness('above', 'sources', 'tops')},
steps as (
  select id, lv, lefts, rights from below
  union all
  select l.id, 1000 + a.lv, a.lefts, a.rights from leaves l join above a on a.id = l.tree
), proofs as (
  select id, string_agg(lefts || rights, '' order by lv) as siblings,
         list(struct_pack(a := lefts, b := rights) order by lv) as path
  from steps group by id
), folded as (
  select id, 0 as done, changed as h, path from leaves left join proofs using (id)
  union all
  select id, done + 1, sha256(path[done + 1].a || h || path[done + 1].b), path from folded where done < len(path)
), ends as (
  select id, h from folded where done = coalesce(len(path), 0)
)
select doc_id, leaves.h as leaf, subroots.h as subroot, root.h as root,
       sha256(coalesce(siblings, '')) as proof_sha256, ends.h as folded_root, ends.h = root.h as verified
from leaves join subroots on subroots.source = leaves.tree join ends using (id) left join proofs using (id)
join (select h from tops where lv = (select max(lv) from tops)) root on true
"""

OP13 = """
with v as (
  select row_number() over () as rid, vec_id,
         case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(256 * x::double)) as e
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: coalesce(not isfinite(x), true))) = 0
), pairs as (
  select a.rid as anchor_rid, a.vec_id as anchor_id, v.vec_id, a.label = v.label as same,
         list_dot_product(a.e, v.e)::bigint as score
  from v a join v on a.rid <> v.rid and len(a.e) = len(v.e) where a.vec_id % 100 = 0
), positives as (
  select *, row_number() over (partition by anchor_rid order by score desc, vec_id) as place
  from pairs where same qualify place <= 5
), found as (
  select p.anchor_id, p.vec_id as positive_id, n.vec_id as negative_id, p.score as positive_score,
         n.score as negative_score,
         row_number() over (partition by p.anchor_rid, p.place order by n.score desc, n.vec_id) as rank
  from positives p join pairs n on n.anchor_rid = p.anchor_rid and not n.same
   and 80 * p.score <= 100 * n.score and n.score <= p.score
)
select anchor_id, positive_id, cast(rank as int) as rank, negative_id, positive_score, negative_score
from found where rank <= 5
"""

_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP12 = f"""
with docs as (
  select row_number() over () as id, doc_id, coalesce({_WORDS}, []) as words from documents
), items as (
  select cast(item_id as varchar) as item, {_WORDS} as words from benchmark where item_id is not null and text is not null
), windows as (
  select distinct item, list_slice(words, i, i + 9) as window_words
  from (select item, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) as i from items where len(words) > 0)
), lengths as (
  select distinct len(window_words) as length from windows
), places as (
  select id, length, words, unnest(range(1, len(words) - length + 2)) as place
  from docs, lengths where len(words) >= length
), hits as (
  select id, place, length, item
  from (select id, place, length, list_slice(words, place, place + length - 1) as window_words from places)
  join windows using (window_words)
), covered as (
  select id, count(distinct word) as n_hit
  from (select id, unnest(range(place, place + length)) as word from (select distinct id, place, length from hits)) group by id
), held as (
  select id, count(*) as n_items, string_agg(item, ',' order by item) as items
  from (select distinct id, item from hits) group by id
)
select doc_id, len(words)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(items, '')) as items_sha256, n_hit is not null as contaminated
from docs left join covered using (id) left join held using (id)
"""

ORACLES: dict[str, str] = {
    "op9_source_mix": OP9,
    "op11_merkle_manifest": OP11,
    "op12_benchmark_decontamination": OP12,
    "op13_hard_negatives": OP13,
}
