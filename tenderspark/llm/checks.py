"""DuckDB SQL for the operators of this package that SQL can express."""

from __future__ import annotations

COLLOCATIONS = r"""
with pieces as (
  select lang, regexp_extract_all(piece, '[^ \t]+') as w
  from (select coalesce(lang, 'und') as lang,
               unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
        from documents)),
f as (
  select lang, words, count(*)::hugeint as f
  from (select lang, unnest(list_transform(w, lambda x: [x])) as words from pieces
        union all
        select lang, unnest(list_transform(range(1, len(w)), lambda i: w[i:i + 1])) from pieces
        union all
        select lang, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2])) from pieces)
  group by all),
totals as (select lang, sum(f)::bigint as n from f where len(words) = 1 group by lang),
c as (select * from f where len(words) > 1 and f >= 10),
held as (
  select lang, words[1:2] as words, f from c where len(words) = 3
  union all
  select lang, words[2:3], f from c where len(words) = 3),
kept as (
  select * from c
  where not exists (select 1 from held h where h.lang = c.lang and h.words = c.words and len(c.words) = 2 and 100 * h.f >= 50 * c.f)),
cuts as (select kept.*, k, words[1:k] as p, words[k + 1:] as q from kept, range(1, 3) t(k) where k < len(words)),
scored as (
  select cuts.lang, cuts.words, cuts.f as a, l.f as l, r.f as r, k, (1000000 * cuts.f * cuts.f) // (l.f * r.f) as score
  from cuts join f l on l.lang = cuts.lang and l.words = p join f r on r.lang = cuts.lang and r.words = q),
best as (select * from scored qualify row_number() over (partition by lang, words order by score, k) = 1),
ranked as (
  select lang, array_to_string(words, ' ') as phrase, a, l, r, score,
         row_number() over (partition by lang order by score desc, a desc, encode(array_to_string(words, ' '))) as rank
  from best)
select lang, rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n, score::bigint as score
from ranked join totals using (lang) where rank <= 2000
"""


def _merkle(leaf_levels: int = 5, group_levels: int = 3) -> str:
    """Trees of up to ``16 ** leaf_levels`` leaves a source and ``16 ** group_levels`` sources, level by level."""
    def field(value: str) -> str:
        return f"coalesce(strlen({value})::varchar || ':' || {value}, '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(map(field, ("doc_id::varchar", "source", "lang", "n_chars::varchar", text))) + ")"

    def tree(name: str, depth: int) -> str:
        """From the nodes ``{name}0 (source, pos, h, cnt)``: the runs and the nodes of each level."""
        return ",".join(f"""
{name}_runs{k} as (select source, pos // 16 as run, string_agg(h, '' order by pos) as s, any_value(cnt) as cnt from {name}{k} where cnt > 1 group by source, pos // 16),
{name}{k + 1} as (select source, run as pos, sha256(s) as h, (cnt + 15) // 16 as cnt from {name}_runs{k} union all select * from {name}{k} where cnt = 1)""" for k in range(depth))

    def climb(rows: str, name: str, depth: int) -> str:
        """The proof and the folded node of `rows`, level by level."""
        out, last = [], rows
        for k in range(depth):
            at = f"(pos // {16 ** k}) % 16"
            out.append(f"""
{rows}_{name}{k} as (select x.* exclude (proof, node), proof || coalesce(s[1:64 * ({at})] || s[64 * ({at}) + 65:], '') as proof,
  case when s is null then node else sha256(s[1:64 * ({at})] || node || s[64 * ({at}) + 65:]) end as node
  from {last} x left join {name}_runs{k} y on x.src is not distinct from y.source and x.pos // {16 ** (k + 1)} = y.run)""")
            last = f"{rows}_{name}{k}"
        return ",".join(out)

    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
with crc as (select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, b: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as step),
leaves as (
  select doc_id, source, {leaf('text')} as leaf, {leaf(lowered)} as tampered,
         xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint)), lambda c, b: xor(c >> 8, step[(xor(c, b) & 255) + 1])), 4294967295) as crc
  from documents, crc),
placed as (select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by source) as cnt from leaves),
leaf0 as (select source, pos, leaf as h, cnt from placed),{tree('leaf', leaf_levels)},
subroots as (select source, h as subroot from leaf{leaf_levels}),
group0 as (select 0 as source, row_number() over (order by source nulls first) - 1 as pos, subroot as h, count(*) over () as cnt from subroots),{tree('group', group_levels)},
ordered as (select source as own, row_number() over (order by source nulls first) - 1 as place, subroot from subroots),
rows0 as (select *, source as src, '' as proof, case when crc % 5 = 0 then tampered else leaf end as node from placed),{climb('rows0', 'leaf', leaf_levels)},
above as (select x.* exclude (pos, src), place as pos, 0 as src, subroot from rows0_leaf{leaf_levels - 1} x join ordered on x.source is not distinct from own),{climb('above', 'group', group_levels)}
select doc_id, leaf, subroot, root, sha256(proof) as proof_sha256, node as folded_root, node = root as verified
from above_group{group_levels - 1}, (select h as root from group{group_levels})
"""


MERKLE = _merkle()
