"""SQL building blocks for holding queries against DuckDB: repertoires, tokenisers, edges, weights and forward passes as CTEs."""

from __future__ import annotations

_B = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' '"

REP = rf"""rep as (select trim(junction_aa, {_B}) as seq, cast(sum(greatest(coalesce(duplicate_count, 1), 1)) as bigint) as abundance from regression_input
    where lower(trim(productive, {_B})) in ('t', 'true', '1', 'yes') and regexp_full_match(trim(junction_aa, {_B}), '[*.\-]*\p{{L}}[\p{{L}}*.\-]*') group by 1)"""
BASES = REP.replace("junction_aa", "junction")
UNIT_GENES = rf"""unit_genes as (select trim(seq, {_B}) as seq, v_gene, j_gene, cast(sum(greatest(coalesce(abundance, 1), 1)) as bigint) as abundance from unit_repertoire
    where regexp_full_match(trim(seq, {_B}), '[*.\-]*\p{{L}}[\p{{L}}*.\-]*') group by 1, 2, 3)"""
UNIT = UNIT_GENES + ", unit as (select seq, cast(sum(abundance) as bigint) as abundance from unit_genes group by 1)"
#: Query sequences: those of the unit repertoire and the probes.
ASKED = "asked as (select distinct seq from (select seq from unit_repertoire union all select seq from probes) where seq is not null)"


#: tk (node, mass, sym, split, ord) of public nodes and sl (ord, lane, off, mass), their places in the scaffold, from deg.
SLOTS = r"""tk as (select node, greatest(in_cnt, out_cnt) as mass, regexp_extract(node, '(?s)^(.*)_(\d+)\{(\d+)\}$', 1) as sym, cast(regexp_extract(node, '(?s)^(.*)_(\d+)\{(\d+)\}$', 2) as integer) as split,
        cast(regexp_extract(node, '(?s)^(.*)_(\d+)\{(\d+)\}$', 3) as integer) as ord from deg where not starts_with(node, '@') and not contains(node, '$')),
    sl as (select ord, case when split = 0 then 'center' else 'front' end as lane, unnest(range(case when split = 0 then length(sym) else split end)) as off, mass from tk where ord > 0
        union all select ord, 'back', unnest(range(length(sym) - split)), mass from tk where ord > 0 and split > 0)"""


def lz(rel: str, p: str, variant: str = "aap") -> str:
    """p_tok (seq, toks), p_lab (+ labels), p_tr (seq, i, src, dst, tok, emitted) for the strings of a relation."""
    end = "cast(cast(list_sum(list_transform(toks[1:i], lambda t: length(t))) as bigint) as varchar)"
    label = "toks[i]" if variant == "naive" else f"toks[i] || '_' || {end}"
    return f"""
    {p}_st(seq, rest, cur, toks) as (select distinct seq, '@' || seq || '$', '', cast([] as varchar[]) from {rel} where seq <> ''
        union all select seq, rest[2:], case when list_contains(toks, cur || rest[1]) then cur || rest[1] else '' end,
            case when list_contains(toks, cur || rest[1]) then toks else list_append(toks, cur || rest[1]) end from {p}_st where rest <> ''),
    {p}_tok as (select seq, case when cur <> '' then list_append(toks, cur) else toks end as toks from {p}_st where rest = ''),
    {p}_lab as (select seq, toks, list_transform(range(1, len(toks) + 1), lambda i: {label}) as labels from {p}_tok),
    {p}_tr as (select seq, i, labels[i] as src, labels[i + 1] as dst, toks[i + 1] as tok, toks[1:i] as emitted from (select *, unnest(range(1, len(labels))) as i from {p}_lab))"""


def peel(rel: str, p: str) -> str:
    """p_lv (seq, ord, a, z, a_run, z_run, mid, label), p_tr (seq, i, src, dst, tok) by run peeling."""
    return f"""
    {p}_st(seq, ord, rest) as (select distinct seq, 0, '@' || seq || '$' from {rel} where seq <> ''
        union all select seq, ord + 1, rtrim(inner_, right(inner_, 1)) from (select seq, ord, ltrim(rest, left(rest, 1)) as inner_ from {p}_st where rest <> '')),
    {p}_in as (select seq, ord, rest, ltrim(rest, left(rest, 1)) as inner_ from {p}_st where rest <> ''),
    {p}_mid as (select *, rtrim(inner_, right(inner_, 1)) as mid from {p}_in),
    {p}_lv as (select seq, ord, left(rest, 1) as a, right(rest, 1) as z, length(rest) - length(inner_) as a_run, length(inner_) - length(mid) as z_run, mid,
        rest[1:length(rest) - length(inner_)] || inner_[length(mid) + 1:] || '_' || case when mid = '' then 0 else length(rest) - length(inner_) end || '{{' || ord || '}}' as label from {p}_mid),
    {p}_tr as (select * from (select seq, ord + 1 as i, label as src, lead(label) over (partition by seq order by ord) as dst, lead(label) over (partition by seq order by ord) as tok from {p}_lv) where dst is not null)"""


def edges(rel: str, p: str, smoothing: float = 0.0) -> str:
    """p_e (src, dst, tok, cnt) and p_w (+ w) from p_tr and the abundances of a relation."""
    return f"""
    {p}_e as (select src, dst, tok, cast(sum(abundance) as bigint) as cnt from {p}_tr join {rel} using (seq) group by 1, 2, 3),
    {weights(f"{p}_e", f"{p}_w", smoothing)}"""


def weights(edge: str, name: str, smoothing: float = 0.0) -> str:
    return f"{name} as (select *, (cnt + {smoothing}) / (sum(cnt) over (partition by src) + {smoothing} * count(*) over (partition by src)) as w from {edge})"


def model(rel: str, p: str, variant: str, smoothing: float = 0.0) -> str:
    return (peel(rel, p) if variant == "flashback" else lz(rel, p, variant)) + "," + edges(rel, p, smoothing)


def forward(w: str, name: str, root: str, values: dict[str, tuple[str, str]]) -> str:
    """name (step, node, values): forward pass over weighted edges; values: name -> (start, sum over edges with d. the state and w the weight)."""
    start = ", ".join(f"cast({s} as double) as {k}" for k, (s, _) in values.items())
    step = ", ".join(f"sum({t}) as {k}" for k, (_, t) in values.items())
    return f"""{name} as (select 0 as step, '{root}' as node, {start}
        union all select d.step + 1 as step, e.dst as node, {step} from {name} d join {w} e on e.src = d.node group by d.step + 1, e.dst)"""


def sinks(edge: str, name: str) -> str:
    return f"{name} as (select distinct dst as node from {edge} where dst not in (select src from {edge}))"


def query(*ctes: str, select: str) -> str:
    return "with recursive " + ",\n".join(ctes) + "\n" + select
