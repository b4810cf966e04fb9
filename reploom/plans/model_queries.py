"""Queries of the repertoire models and the SQL they are held against."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reploom.functions import text as tx
from reploom.functions import tokens as tk
from reploom.operators import algebra, analytics, genes, grammar, occupancy, scaffold, score, simulate, spectrum, structure
from reploom.plans import model as md
from reploom.plans import oracle as o
from reploom.session import cut, table, work_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
SEED = 20


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def rep(spark: SparkSession, d: str) -> DataFrame:
    """Productive, well-formed junctions of regression_input with their counts."""
    return md.repertoire(table(spark, d, "regression_input", "junction_aa", "duplicate_count", "productive"), "junction_aa", "duplicate_count", productive="productive")


def bases(spark: SparkSession, d: str) -> DataFrame:
    """Productive nucleotide junctions, as they are."""
    return md.repertoire(table(spark, d, "regression_input", "junction", "duplicate_count", "productive"), "junction", "duplicate_count", productive="productive")


def unit_genes(spark: SparkSession, d: str) -> DataFrame:
    return md.repertoire(table(spark, d, "unit_repertoire"), "seq", "abundance", "v_gene", "j_gene")


def unit(spark: SparkSession, d: str) -> DataFrame:
    return md.repertoire(table(spark, d, "unit_repertoire"), "seq", "abundance")


def asked(spark: SparkSession, d: str) -> DataFrame:
    """Sequences of the unit repertoire and probes, as they are."""
    return table(spark, d, "unit_repertoire", "seq").unionAll(table(spark, d, "probes", "seq")).filter("seq is not null").distinct()


def _r(c: str, n: int = 6):
    return F.round(c, n).alias(c)


# tokenisers


@query(o.query(o.REP, o.lz("rep", "t"), select="select seq, toks as tokens from t_tok"))
def lz76_tokens(spark, d):
    return md.labelled(rep(spark, d), "aap").select("seq", F.col("toks").alias("tokens"))


_PLAIN = """ust(seq, rest, cur, n, toks) as (select seq, seq, '', 0, cast([] as varchar[]) from asked
        union all select seq, rest[2:], case when list_contains(toks, cur || rest[1]) then cur || rest[1] else '' end, case when list_contains(toks, cur || rest[1]) then n else n + 1 end,
            case when list_contains(toks, cur || rest[1]) then toks else list_append(toks, cur || rest[1]) end from ust where rest <> ''),
    len as (select seq, n + case when cur <> '' then 1 else 0 end as n from ust where rest = '')"""


@query(o.query(o.ASKED, _PLAIN, select="select seq, case when cur <> '' then list_append(toks, cur) else toks end as tokens from ust where rest = ''"))
def lz76_decompose(spark, d):
    """The parse of a string by itself, without end marks."""
    return asked(spark, d).select("seq", tk.lz76(F.col("seq")).alias("tokens"))


@query(o.query(o.REP, o.peel("rep", "t"), select="select seq, list(label order by ord) as tokens from t_lv group by seq"))
def flashback_tokens(spark, d):
    return md.labelled(rep(spark, d), "flashback").select("seq", F.col("labels").alias("tokens"))


@query(o.query(o.REP, select="select seq, seq as back from rep"))
def flashback_reverse(spark, d):
    return rep(spark, d).select("seq", tk.flashback_reverse(tk.flashback(F.col("seq"))).alias("back"))


# edges and structure

_ROWS = {"aap": (rep, o.REP), "naive": (rep, o.REP), "ndp": (bases, o.BASES)}
for _variant in md.VARIANTS:

    def _edges(spark, d, variant=_variant):
        return md.fit(_ROWS[variant][0](spark, d), variant).edges.select("src", "dst", "cnt", _r("w"))

    _edges.__name__ = f"lz_edges_{_variant}"
    query(o.query(_ROWS[_variant][1], o.model("rep", "m", _variant), select="select src, dst, cnt, round(w, 6) as w from m_w"))(_edges)


@query(o.query(o.REP, o.model("rep", "m", "aap", 0.5), select="select src, dst, cnt, round(w, 6) as w from m_w"))
def lz_edges_smoothed(spark, d):
    return md.fit(rep(spark, d), "aap", 0.5).edges.select("src", "dst", "cnt", _r("w"))


@query(o.query(o.REP, o.model("rep", "m", "flashback"), select="select src, dst, cnt, round(w, 6) as w from m_w"))
def flashback_edges(spark, d):
    return md.fit(rep(spark, d), "flashback").edges.select("src", "dst", "cnt", _r("w"))


@query(o.query(o.REP, o.model("rep", "m", "flashback"), o.sinks("m_e", "s"), select="select node from s"))
def flashback_sinks(spark, d):
    return md.fit(rep(spark, d), "flashback").sinks()


@query(o.query(o.REP, o.model("rep", "m", "aap"), select="select distinct node, not starts_with(node, '@') and not contains(node, '$') as is_public from (select src as node from m_e union all select dst from m_e)"))
def lz_nodes_aap(spark, d):
    return md.fit(rep(spark, d), "aap").nodes().withColumn("is_public", md.is_public(F.col("node")))


@query(o.query(o.REP, select="select length(seq) as length, cast(sum(abundance) as bigint) as cnt from rep group by 1"))
def length_distribution(spark, d):
    return md.count_lengths(rep(spark, d))


_DEGREES = "deg as (select node, cast(sum(o) as bigint) as out_degree, cast(sum(i) as bigint) as in_degree, cast(sum(o * cnt) as bigint) as out_cnt, cast(sum(i * cnt) as bigint) as in_cnt from (select src as node, 1 as o, 0 as i, cnt from m_e union all select dst, 0, 1, cnt from m_e) group by node)"


@query(o.query(o.REP, o.model("rep", "m", "aap"), _DEGREES, select="select * from deg"))
def node_degrees(spark, d):
    return structure.degrees(md.fit(rep(spark, d), "aap"))


@query(o.query(o.REP, o.model("rep", "m", "aap"), _DEGREES, select="select node, out_degree + in_degree as degree from deg order by 2 desc, 1 limit 20"))
def hub_nodes(spark, d):
    return structure.hubs(md.fit(rep(spark, d), "aap"))


@query(o.query(o.REP, o.model("rep", "m", "aap"), select="select 'next' as side, dst as node, cnt, round(w, 6) as w from m_w where src = 'S_4' union all select 'before', src, cnt, round(w, 6) from m_w where dst = 'S_4'"))
def successors(spark, d):
    m = md.fit(rep(spark, d), "aap")
    return structure.successors(m, "S_4").select(F.lit("next").alias("side"), "node", "cnt", _r("w")).unionAll(structure.predecessors(m, "S_4").select(F.lit("before").alias("side"), "node", "cnt", _r("w")))


@query(
    o.query(
        o.REP, o.model("rep", "m", "aap"), _DEGREES,
        "pub as (select * from m_e where not starts_with(src, '@') and not contains(src, '$') and not starts_with(dst, '@') and not contains(dst, '$'))",
        select="""select count(*) as n_nodes, cast(sum(out_degree) as bigint) as n_edges, cast(1 as bigint) as n_initial, (select count(distinct dst) from m_e where tok like '%$') as n_terminal,
        (select cast(sum(abundance) as bigint) from rep) as n_sequences, max(out_degree) as max_out_degree, max(in_degree) as max_in_degree, round(sum(out_degree) / (count(*) * (count(*) - 1)), 12) as density,
        (select count(*) from deg where not starts_with(node, '@') and not contains(node, '$') and node not in (select src from pub) and node not in (select dst from pub)) as n_isolated from deg""",
    )
)
def graph_summary(spark, d):
    return structure.summary(md.fit(rep(spark, d), "aap").persist())


# scoring


@query(
    o.query(
        o.REP, o.ASKED, o.model("rep", "m", "flashback"), o.sinks("m_e", "s"), o.peel("asked", "q"),
        "sc as (select seq, sum(ln(w)) as lp, bool_or(w is null) as miss, arg_max(dst, i) as last from q_tr left join (select src, dst, w from m_w) using (src, dst) group by seq)",
        select="select seq, round(case when not miss and last in (select node from s) then lp else -690.7755278982137 end, 6) as log_pgen from asked left join sc using (seq)",
    )
)
def flashback_pgen(spark, d):
    return score.log_pgen(md.fit(rep(spark, d), "flashback"), asked(spark, d)).select("seq", _r("log_pgen"))


_LZ_SCORE = [
    o.REP, o.ASKED, o.model("rep", "m", "aap"), o.lz("asked", "q"),
    """open as (select q.seq, q.i, q.dst as want, m.dst, m.w from q_tr q left join m_w m on m.src = q.src and
        case when length(m.tok) = 1 then not list_contains(q.emitted, m.tok) else not list_contains(q.emitted, m.tok) and list_contains(q.emitted, m.tok[:-2]) end)""",
    "st as (select seq, i, sum(w) as z, sum(case when dst = want then w end) as w from open group by 1, 2)",
    "sc as (select seq, sum(ln(w / z)) as lp, bool_and(w is not null) as ok from st group by 1)",
    "pg as (select asked.seq, case when ok then lp else -690.7755278982137 end as log_pgen from asked left join sc using (seq))",
]


@query(o.query(*_LZ_SCORE, select="select seq, round(log_pgen, 6) as log_pgen from pg"))
def lz_pgen_raw(spark, d):
    return score.log_pgen(md.fit(rep(spark, d), "aap"), asked(spark, d)).select("seq", _r("log_pgen"))


@query(o.query(*_LZ_SCORE, select="select seq, case when log_pgen > -690.0 then round(log_pgen, 6) end as raw, true as shifted from pg"))
def lz_pgen(spark, d):
    """The normalised score beside the raw one: every sequence in the model is shifted by the log of one absorption between 0 and 1."""
    m = md.fit(rep(spark, d), "aap")
    a = simulate.absorption(m)
    both = score.log_pgen(m, asked(spark, d)).join(score.log_pgen(m, asked(spark, d), log_absorption=math.log(a)).withColumnRenamed("log_pgen", "own"), "seq")
    inside = F.col("log_pgen") > md.IN_MODEL
    shifted = F.when(inside, F.abs(F.col("own") - F.col("log_pgen") + math.log(a)) < 1e-9).otherwise(F.col("own") == md.LOG_EPS) & F.lit(0 < a <= 1)
    return both.select("seq", F.when(inside, F.round("log_pgen", 6)).alias("raw"), shifted.alias("shifted"))


@query(o.query(*_LZ_SCORE, select="select seq, log_pgen > -690.0 as in_model from pg"))
def membership(spark, d):
    return score.contains(md.fit(rep(spark, d), "aap"), asked(spark, d))


@query(o.query(*_LZ_SCORE, _PLAIN, select="select seq, n as n_tokens, case when log_pgen > -690 and n > 0 then round(exp(-log_pgen / n), 6) else cast('infinity' as double) end as perplexity, case when log_pgen > -690 and n > 0 then round(-log_pgen / n / ln(2), 6) end as bits_per_token from pg join len using (seq)"))
def sequence_perplexity(spark, d):
    return score.sequence_perplexity(score.log_pgen(md.fit(rep(spark, d), "aap"), asked(spark, d))).select("seq", "n_tokens", _r("perplexity"), _r("bits_per_token"))


@query(o.query(*_LZ_SCORE, _PLAIN, select="select case when count(*) filter (not (log_pgen > -690 and n > 0)) > 0 then cast('infinity' as double) else round(exp2(avg(-log_pgen / n / ln(2))), 6) end as perplexity, round(coalesce(avg(case when log_pgen > -690 and n > 0 then -log_pgen / n / ln(2) end), 0), 6) as entropy_rate from pg join len using (seq)".replace("exp2(", "pow(2, ")))
def repertoire_perplexity(spark, d):
    p = score.repertoire_perplexity(score.log_pgen(md.fit(rep(spark, d), "aap"), asked(spark, d)))
    return p.select(_r("perplexity"), _r("entropy_rate"))


@query(
    o.query(
        *[x.replace("asked as (", "asked as (select seq from unit), unused as (") if x == o.ASKED else x for x in [o.REP, o.UNIT, *_LZ_SCORE[1:]]],
        "s as (select seq, abundance as n, log_pgen, log_pgen > -690 as hit from unit join pg using (seq))",
        "c as (select *, n / (select sum(n) from s where hit) as q from s where hit)",
        "r as (select log_pgen, n, rank() over (order by n) + (count(*) over (partition by n) - 1) / 2.0 as rn, rank() over (order by log_pgen) + (count(*) over (partition by log_pgen) - 1) / 2.0 as rl from c)",
        select="""select (select count(*) from s) as n_types, round((select count(*) from c) / (select count(*) from s), 6) as coverage_types, round((select sum(n) from c) / (select sum(n) from s), 6) as coverage_mass,
        round((select sum(-q * log_pgen) from c), 6) as cross_entropy, round((select sum(-q * ln(q)) from c), 6) as entropy, round((select sum(-q * log_pgen) + sum(q * ln(q)) from c), 6) as kl, round((select exp(sum(-q * log_pgen)) from c), 0) as perplexity,
        round((select avg(log_pgen) from c), 6) as mean_log_pgen, round((select median(log_pgen) from c), 6) as median_log_pgen, round((select corr(rn, rl) from r), 4) as spearman""",
    )
)
def approximation_diagnostics(spark, d):
    out = score.approximation_diagnostics(md.fit(rep(spark, d), "aap"), unit(spark, d))
    return out.select("n_types", *[_r(c) for c in out.columns if c not in ("n_types", "perplexity", "spearman")], _r("perplexity", 0), _r("spearman", 4))


# exact distribution of the Markov model

_FB = [o.REP, o.model("rep", "m", "flashback"), o.sinks("m_e", "s")]
_ROOT = "@$_1{0}"


def _fb(spark, d) -> md.Model:
    return md.fit(rep(spark, d), "flashback")


def _absorbed(values: dict[str, tuple[str, str]], select: str) -> str:
    return o.query(*_FB, o.forward("m_w", "dp", _ROOT, values), "f as (select " + ", ".join(f"sum({k}) as {k}" for k in values) + " from dp join s using (node))", select=select)


_MASS, _ENT, _ONE = ("1", "d.m * e.w"), ("0", "e.w * (d.h - d.m * ln(e.w))"), ("1", "d.n")


@query(_absorbed({"n": _ONE}, "select round(log10(n), 6) as log10_paths from f"))
def path_count(spark, d):
    return analytics.support(_fb(spark, d)).select(_r("log10_paths"))


@query(_absorbed({"m": _MASS, "h": _ENT}, "select round(h, 6) as entropy_nats, round(h / ln(2), 6) as entropy_bits, round(exp(h), 3) as effective_diversity, round(m, 6) as absorbed, abs(m - 1) < 1e-6 as is_proper from f"))
def effective_diversity(spark, d):
    return analytics.entropy(_fb(spark, d)).select(_r("entropy_nats"), _r("entropy_bits"), _r("effective_diversity", 3), _r("absorbed"), "is_proper")


_ORDERS = (0.5, 1.5, 2.0, 3.0, 5.0)
_POWERS = {f"p{i}": ("1", f"d.p{i} * pow(e.w, {a})") for i, a in enumerate(_ORDERS)}


@query(_absorbed(_POWERS, " union all ".join(f"select cast({a} as double) as alpha, round(ln(p{i}), 6) as log_power_sum from f" for i, a in enumerate(_ORDERS))))
def power_sums(spark, d):
    return analytics.power_sums(_fb(spark, d), list(_ORDERS)).select("alpha", F.round(F.log("power_sum"), 6).alias("log_power_sum"))


@query(_absorbed(_POWERS | {"m": _MASS, "h": _ENT, "n": _ONE}, "select cast(0 as double) as alpha, round(ln(n), 6) as log_hill from f union all select 1, round(h, 6) from f union all " + " union all ".join(f"select {a}, round(ln(p{i}) / (1 - {a}), 6) from f" for i, a in enumerate(_ORDERS))))
def hill_curve(spark, d):
    return analytics.hill_curve(_fb(spark, d), (0.0, 1.0, *_ORDERS)).select("alpha", F.round(F.log("hill"), 6).alias("log_hill"))


@query(o.query(*_FB, "dp as (select 0 as step, '@$_1{0}' as node, cast(0 as double) as lo, cast(0 as double) as hi union all select d.step + 1, e.dst, min(d.lo + ln(e.w)), max(d.hi + ln(e.w)) from dp d join m_w e on e.src = d.node group by d.step + 1, e.dst)", select="select round(min(lo), 6) as min_log_pgen, round(max(hi), 6) as max_log_pgen, round(max(hi) - min(lo), 6) as dynamic_range from dp join s using (node)"))
def dynamic_range(spark, d):
    return analytics.dynamic_range(_fb(spark, d)).select(_r("min_log_pgen"), _r("max_log_pgen"), _r("dynamic_range"))


def _jet(order: int, q: float = 1.0) -> dict[str, tuple[str, str]]:
    from math import comb

    return {f"v{j}": ("1" if j == 0 else "0", f"pow(e.w, {q}) * (" + " + ".join(f"{comb(j, i)} * pow(ln(e.w), {j - i}) * d.v{i}" for i in range(j + 1)) + ")") for j in range(order + 1)}


_MOMENTS = """round(v1 / v0, 6) as mean, round(v2 / v0 - pow(v1 / v0, 2), 6) as variance, round(v0, 6) as mass, round(sqrt(v2 / v0 - pow(v1 / v0, 2)), 6) as std,
        round((v3 / v0 - 3 * v1 / v0 * v2 / v0 + 2 * pow(v1 / v0, 3)) / pow(v2 / v0 - pow(v1 / v0, 2), 1.5), 4) as skewness,
        round((v4 / v0 - 4 * v1 / v0 * v3 / v0 + 6 * pow(v1 / v0, 2) * v2 / v0 - 3 * pow(v1 / v0, 4)) / pow(v2 / v0 - pow(v1 / v0, 2), 2) - 3, 3) as excess_kurtosis"""


@query(_absorbed(_jet(4), f"select {_MOMENTS} from f"))
def pgen_moments(spark, d):
    return _moments(_fb(spark, d))


def _moments(m: md.Model) -> DataFrame:
    return analytics.moments_row(m).select(_r("mean"), _r("variance"), _r("mass"), _r("std"), _r("skewness", 4), _r("excess_kurtosis", 3))


@query(_absorbed(_jet(4), "select round(-v1 / v0, 6) as k1, round(v2 / v0 - pow(v1 / v0, 2), 6) as k2, round(-(v3 / v0 - 3 * v1 / v0 * v2 / v0 + 2 * pow(v1 / v0, 3)), 3) as k3 from f"))
def surprisal_cumulants(spark, d):
    return spectrum.surprisal_moments(_fb(spark, d)).select(_r("k1"), _r("k2"), _r("k3", 3))


@query(_absorbed({"a": ("1", "d.a * pow(e.w, 0.5)"), "b": ("1", "d.b * pow(e.w, 2.0)")}, "select cast(0.5 as double) as t, round(ln(a), 6) as cgf from f union all select -1.0, round(ln(b), 6) from f"))
def surprisal_cgf(spark, d):
    return spectrum.cgf(_fb(spark, d), [0.5, -1.0]).select("t", _r("cgf"))


@query(_absorbed(_jet(3, 1.5), " union all ".join(f"select cast({j} as integer) as j, round(ln(v0), 6) as log_mass, round(v{j} / v0, 6) as ratio from f" for j in range(4))))
def mellin_derivatives(spark, d):
    m = spectrum.mellin(_fb(spark, d), [1.5], 3)
    total = m.filter("j = 0").select("value").scalar()
    return m.select("j", F.round(F.log(total), 6).alias("log_mass"), F.round(F.col("value") / total, 6).alias("ratio"))


@query(o.query(o.REP, o.model("rep", "m", "aap"), "s as (select distinct dst as node from m_e where tok like '%$')", o.forward("m_w", "dp", "@_1", _jet(4)), "f as (select sum(v0) as v0, sum(v1) as v1, sum(v2) as v2, sum(v3) as v3, sum(v4) as v4 from dp join s using (node))", select=f"select {_MOMENTS} from f"))
def lz_pgen_moments(spark, d):
    """Moments of the unconstrained forward pass over an LZ model."""
    return _moments(md.fit(rep(spark, d), "aap"))


@query(
    o.query(
        *_FB,
        """dp as (select 0 as step, '@$_1{0}' as node, cast(0 as bigint) as len, cast(1 as double) as p, cast(1 as double) as c, cast(0 as double) as h union all
        select d.step + 1, e.dst, d.len + length(regexp_replace(e.dst, '_[0-9]+\\{[0-9]+\\}$', '')), sum(d.p * e.w), sum(d.c), sum(e.w * (d.h + d.p * ln(e.w))) from dp d join m_w e on e.src = d.node group by d.step + 1, e.dst, d.len + length(regexp_replace(e.dst, '_[0-9]+\\{[0-9]+\\}$', '')))""",
        select="select cast(len as integer) as length, round(sum(p), 9) as prob, round(log10(sum(c)), 6) as log10_sequences, round(-sum(h) / sum(p), 5) as mean from dp join s using (node) group by 1",
    )
)
def length_profile(spark, d):
    return spectrum.length_profile(_fb(spark, d)).select("length", _r("prob", 9), F.round(F.log10("n_sequences"), 6).alias("log10_sequences"), _r("mean", 5))


@query(_absorbed({"m": _MASS}, "select round(m, 6) as mass, true as in_range from f"))
def histogram_spectrum(spark, d):
    h = spectrum.histogram(_fb(spark, d))
    return h.agg(F.round(F.sum("weight"), 6).alias("mass"), F.min(F.col("weight") >= 0).alias("in_range"))


# small model with every path: the probes' own

_SMALL = ["pr as (select seq, cast(count(*) as bigint) as abundance from probes where regexp_full_match(seq, '[A-Z]+') group by 1)", o.model("pr", "m", "flashback"), o.sinks("m_e", "s")]
_PATHS = "pa(node, labels, lp) as (select '@$_1{0}', ['@$_1{0}'], cast(0 as double) union all select e.dst, list_append(p.labels, e.dst), p.lp + ln(e.w) from pa p join m_w e on e.src = p.node), full_ as (select labels, lp from pa join s using (node))"


def _small(spark, d) -> md.Model:
    return md.fit(md.repertoire(table(spark, d, "probes").filter("seq rlike '^[A-Z]+$'"), "seq"), "flashback").persist()


@query(o.query(*_SMALL, _PATHS, select="select count(*) as n, round(sum(exp(lp)), 6) as mass, round(min(lp), 6) as lo, round(max(lp), 6) as hi from full_"))
def exact_atoms(spark, d):
    a = spectrum.atoms(_small(spark, d))
    return a.agg(F.count_distinct("seq").alias("n"), F.round(F.sum(F.exp("log_pgen")), 6).alias("mass"), F.round(F.min("log_pgen"), 6).alias("lo"), F.round(F.max("log_pgen"), 6).alias("hi"))


@query(o.query(*_SMALL, _PATHS, select=" union all ".join(f"select cast({n} as double) as depth, round(sum(1 - pow(1 - exp(lp), {n})), 6) as richness from full_" for n in (10, 100, 1000))))
def expected_richness(spark, d):
    return spectrum.expected_richness(spectrum.atoms(_small(spark, d)), [10, 100, 1000]).select("depth", _r("richness"))


@query(o.query(*_SMALL, _PATHS, select=" union all ".join(f"select {k} as count, round(sum(exp(lgamma(101) - lgamma({k + 1}) - lgamma({101 - k}) + {k} * lp + {100 - k} * ln(1 - exp(lp)))), 6) as expected from full_" for k in (1, 2, 3, 4))))
def frequency_spectrum(spark, d):
    return spectrum.frequency_spectrum(spectrum.atoms(_small(spark, d)), 100, 4).select("count", _r("expected"))


@query(o.query(*_SMALL, _PATHS, select="select rank, round(lp, 6) as log_pgen from (select row_number() over (order by lp desc) as rank, lp from full_) where rank <= 10").replace("select rank, round", "select cast(rank as integer) as rank, round"))
def top_k(spark, d):
    return analytics.top_sequences(_small(spark, d), 10).select("rank", _r("log_pgen"))


_SCORED = "own as (select seq, sum(ln(w)) as lp from m_tr join (select src, dst, w from m_w) using (src, dst) group by seq)"


@query(o.query(*_SMALL, _PATHS, _SCORED, "t as (select seq, lp, round(lp, 9) as k from own)", select="select seq, round(lp, 6) as log_pgen, round((select sum(exp(f.lp)) from full_ f where round(f.lp, 9) <= t.k), 6) as cdf_generated, round((select count(*) from full_ f where round(f.lp, 9) <= t.k) / (select count(*) from full_), 6) as cdf_counting from t"))
def position(spark, d):
    p = spectrum.position(spectrum.atoms(_small(spark, d)), table(spark, d, "probes", "seq"))
    return p.select("seq", _r("log_pgen"), _r("cdf_generated"), _r("cdf_counting"))


_GRID = (0.1, 0.3, 0.5, 0.7, 0.9)


@query(o.query(*_SMALL, _PATHS, "x as (select unnest(range(1, 6)) as i), lim as (select min(lp) as lo, max(lp) as hi from full_)", "place as (select i, lo + (hi - lo) * (i - 0.5) / 5 as x from x, lim)", select="select round(x, 6) as log_p, round((select sum(exp(lp)) from full_ where lp <= x), 6) as exact, true as close from place"))
def saddlepoint_check(spark, d):
    """The approximation at five places of the range beside the exact mass of all sequences that are no more probable: within 0.1."""
    m = _small(spark, d)
    a = cut(spectrum.atoms(m))
    r = a.agg(F.min("log_pgen").alias("lo"), F.max("log_pgen").alias("hi")).first()
    xs = [r["lo"] + (r["hi"] - r["lo"]) * f for f in _GRID]
    exact = a.agg(*[F.sum(F.when(F.col("log_pgen") <= x, F.exp("log_pgen"))).alias(f"e{i}") for i, x in enumerate(xs)]).first()
    rows = spark.createDataFrame([(x, exact[f"e{i}"]) for i, x in enumerate(xs)], "log_p double, exact double")
    return rows.join(spectrum.saddlepoint(m, xs), "log_p").select(_r("log_p"), _r("exact"), (F.abs(F.col("cdf") - F.col("exact")) < 0.1).alias("close"))


@query(o.query(*_FB, _SCORED, "bar as (select lp from own order by lp desc limit 1 offset 19)",
    "pa(node, labels, lp) as (select '@$_1{0}', ['@$_1{0}'], cast(0 as double) union all select e.dst, list_append(p.labels, e.dst), p.lp + ln(e.w) from pa p join m_w e on e.src = p.node where p.lp + ln(e.w) >= (select lp from bar) - 1e-9)",
    select="select cast(row_number() over (order by lp desc, labels) as integer) as rank, round(lp, 6) as log_pgen from pa join s using (node) order by lp desc limit 20"))
def top_k_large(spark, d):
    return analytics.top_sequences(_fb(spark, d), 20).select("rank", _r("log_pgen"))


# algebra

_TWO = [o.REP, o.UNIT, o.model("rep", "a", "flashback"), o.model("unit", "b", "flashback")]
_OUT = "select src, dst, cnt, round(w, 6) as w from x_w"


def _two(spark, d, variant="flashback"):
    return md.fit(rep(spark, d), variant), md.fit(unit(spark, d), variant)


def _edges_of(m: md.Model) -> DataFrame:
    return m.edges.select("src", "dst", "cnt", _r("w"))


@query(o.query(*_TWO, "x as (select src, dst, cast(sum(cnt) as bigint) as cnt from (select src, dst, cnt from a_e union all select src, dst, cnt from b_e) group by 1, 2)", o.weights("x", "x_w"), select=_OUT))
def graph_union(spark, d):
    return _edges_of(algebra.union(*_two(spark, d)))


@query(o.query(*_TWO, "x as (select a.src, a.dst, least(a.cnt, b.cnt) as cnt from a_e a join b_e b using (src, dst))", o.weights("x", "x_w"), select=_OUT))
def graph_intersection(spark, d):
    return _edges_of(algebra.intersection(*_two(spark, d)))


@query(o.query(*_TWO, "x as (select src, dst, a.cnt - coalesce(b.cnt, 0) as cnt from a_e a left join b_e b using (src, dst) where a.cnt - coalesce(b.cnt, 0) > 0)", o.weights("x", "x_w"), select=_OUT))
def graph_difference(spark, d):
    return _edges_of(algebra.difference(*_two(spark, d)))


@query(o.query(*_TWO, "y as (select src, dst, cast(round(0.3 * cnt) as bigint) as cnt from a_e union all select src, dst, cast(round(1.5 * cnt) as bigint) from b_e)", "x as (select src, dst, cast(sum(cnt) as bigint) as cnt from y where cnt > 0 group by 1, 2)", o.weights("x", "x_w"), select=_OUT))
def weighted_merge(spark, d):
    return _edges_of(algebra.weighted_merge(*_two(spark, d), 0.3, 1.5))


_SHARES = "na as (select src as node, sum(cnt) as c from a_e group by 1), nb as (select src as node, sum(cnt) as c from b_e group by 1), pq as (select node, coalesce(na.c, 0) / (select sum(c) from na) as p, coalesce(nb.c, 0) / (select sum(c) from nb) as q from na full join nb using (node))"
_JSD = "round((sum(case when p > 0 then p * ln(2 * p / (p + q)) else 0 end) + sum(case when q > 0 then q * ln(2 * q / (p + q)) else 0 end)) / 2, 6)"


@query(o.query(*_TWO, _SHARES, select=f"select {_JSD} as jsd from pq"))
def jsd(spark, d):
    return algebra.jensen_shannon(*_two(spark, d)).select(_r("jsd"))


@query(
    o.query(
        *_TWO, _SHARES, "va as (select src as node from a_e union select dst from a_e), vb as (select src as node from b_e union select dst from b_e)",
        "ni as (select count(*) as s from va join vb using (node)), ei as (select count(*) as s from a_e join b_e using (src, dst))",
        select=f"""select {_JSD} as jsd, round((select s from ni) / ((select count(*) from va) + (select count(*) from vb) - (select s from ni)), 6) as node_jaccard,
        round((select s from ei) / ((select count(*) from a_e) + (select count(*) from b_e) - (select s from ei)), 6) as edge_jaccard, (select s from ni) as shared_nodes, (select s from ei) as shared_edges from pq""",
    )
)
def compare_jaccard(spark, d):
    return algebra.compare(*_two(spark, d)).select(_r("jsd"), _r("node_jaccard"), _r("edge_jaccard"), "shared_nodes", "shared_edges")


@query(o.query(*_TWO, _SHARES, "va as (select src as node from a_e union select dst from a_e)", select="select node, round(coalesce(c / (select sum(c) from nb), 0), 9) as share from va left join nb using (node)"))
def feature_aligned(spark, d):
    return algebra.aligned_features(*_two(spark, d)).select("node", _r("share", 9))


def _posterior_sql(variant: str) -> str:
    return o.query(
        o.REP, o.UNIT, o.model("rep", "a", variant), o.model("unit", "b", variant), "va as (select src as node from a_e union select dst from a_e)",
        "known as (select src, dst, cnt as c from b_e where src in (select node from va) and dst in (select node from va))", "tot as (select src, sum(c) as n from known group by 1)",
        "raw as (select a.src, a.dst, a.cnt, (10.0 * w + coalesce(c, 0)) / (10.0 + coalesce(n, 0)) as r from a_w a left join known using (src, dst) left join tot on tot.src = a.src)",
        select="select src, dst, cnt, round(r / sum(r) over (partition by src), 6) as w from raw",
    )


@query(_posterior_sql("flashback"))
def posterior_flashback(spark, d):
    return _edges_of(algebra.posterior(md.fit(rep(spark, d), "flashback"), unit(spark, d), 10.0))


@query(_posterior_sql("aap"))
def posterior_lz(spark, d):
    return _edges_of(algebra.posterior(md.fit(rep(spark, d), "aap"), unit(spark, d), 10.0))


@query(o.query(*_TWO, "x as (select src, dst, a.cnt - coalesce(b.cnt, 0) as cnt from a_e a left join b_e b using (src, dst) where a.cnt - coalesce(b.cnt, 0) > 0)", o.weights("x", "x_w"), select=_OUT))
def without_flashback(spark, d):
    return _edges_of(algebra.without(md.fit(rep(spark, d), "flashback"), unit(spark, d)))


@query(o.query(o.REP, o.model("rep", "m", "aap"), _DEGREES, "s as (select distinct dst as node from m_e where tok like '%$')", select="select count(*) as n_nodes, cast(sum(out_degree) as bigint) as n_edges, (select count(*) from s) as n_sinks, round((select count(*) from s) / count(*), 6) as sink_share, max(out_degree) as max_out_degree from deg"))
def feature_sizes(spark, d):
    return algebra.degree_features(md.fit(rep(spark, d), "aap")).select("n_nodes", "n_edges", "n_sinks", _r("sink_share"), "max_out_degree")


@query(
    o.query(
        o.REP, o.model("rep", "m", "flashback"), o.sinks("m_e", "s"), _DEGREES, o.forward("m_w", "dp", _ROOT, {"n": _ONE, "a": ("1", "d.a * pow(e.w, 0.5)"), "m": _MASS, "h": _ENT, "b": ("1", "d.b * pow(e.w, 2.0)"), "c": ("1", "d.c * pow(e.w, 5.0)")}),
        "f as (select sum(n) as n, sum(a) as a, sum(h) as h, sum(b) as b, sum(c) as c from dp join s using (node))",
        "ex as (select 0 as step, '@$_1{0}' as node, cast(0 as double) as lo, cast(0 as double) as hi union all select d.step + 1, e.dst, min(d.lo + ln(e.w)), max(d.hi + ln(e.w)) from ex d join m_w e on e.src = d.node group by d.step + 1, e.dst)",
        "r as (select (max(hi) - min(lo)) / ln(10) as orders from ex join s using (node)), k as (select count(*) as k from s)",
        select="""select cast(count(*) as double) as n_nodes, cast(sum(out_degree) as double) as n_edges, cast(1 as double) as n_roots, cast(any_value(k) as double) as n_sinks, round(ln(any_value(n)), 6) as d0, round(2 * ln(any_value(a)), 6) as d0_5, round(any_value(h), 6) as d1,
            round(-ln(any_value(b)), 6) as d2, round(-ln(any_value(c)) / 4, 6) as d5, round(any_value(h), 6) as entropy_nats, round(any_value(orders), 6) as dynamic_range_orders, cast(any_value(k) as double) as n_sinks_again,
            round(any_value(k) / count(*), 6) as sink_share, cast(max(out_degree) as double) as max_out_degree, round(any_value(h) - ln(any_value(n)), 6) as uniformity from deg, f, r, k""",
    )
)
def feature_stats(spark, d):
    """All fifteen numbers; Hill numbers and uniformity by their logarithms."""
    r = algebra.feature_stats(_fb(spark, d))
    logs = ("d0", "d0_5", "d1", "d2", "d5", "uniformity")
    return r.select(*[F.round(F.log(c), 6).alias(c) if c in logs else _r(c) for c in algebra.STATS])


# genes

_GENES = [o.UNIT_GENES, "known as (select * from unit_genes where v_gene is not null and j_gene is not null)"]


def _with_genes(spark, d) -> md.Model:
    return md.fit(unit_genes(spark, d), "aap", genes=True)


@query(o.query(*_GENES, "g as (select 'v' as kind, v_gene as gene, abundance from known union all select 'j', j_gene, abundance from known)", select="select kind, gene, cast(sum(abundance) as bigint) as cnt, round(sum(abundance) / (select sum(abundance) from known), 6) as prob from g group by 1, 2"))
def gene_marginals(spark, d):
    return genes.marginals(_with_genes(spark, d)).select("kind", "gene", "cnt", _r("prob"))


@query(o.query(*_GENES, select="select v_gene, j_gene, cast(sum(abundance) as bigint) as cnt, round(sum(abundance) / (select sum(abundance) from known), 6) as prob from known group by 1, 2"))
def vj_joint(spark, d):
    return genes.joint(_with_genes(spark, d)).select("v_gene", "j_gene", "cnt", _r("prob"))


@query(o.query(*_GENES, o.lz("known", "t"), "g as (select src, dst, 'v' as kind, v_gene as gene, abundance from t_tr join known using (seq) union all select src, dst, 'j', j_gene, abundance from t_tr join known using (seq))", "c as (select src, dst, kind, gene, cast(sum(abundance) as bigint) as cnt from g group by 1, 2, 3, 4)", select="select *, round(cnt / sum(cnt) over (partition by src, dst, kind), 6) as prob from c"))
def edge_gene_counts(spark, d):
    return genes.edge_gene_probability(_with_genes(spark, d)).select("src", "dst", "kind", "gene", "cnt", _r("prob"))


# grammar

_RULES = """r_e as (select ord = 0 as is_start, a, z, case when mid <> '' then 'internal' when z_run > 0 then 'leaf_pair' when a_run = 1 then 'leaf_single' else 'leaf_run' end as kind, a_run, z_run, left(mid, 1) as dst_a, right(mid, 1) as dst_z,
        cast(sum(abundance) as double) as cnt from t_lv join rep using (seq) group by all),
    r_w as (select *, cnt / sum(cnt) over (partition by is_start, a, z) as w from r_e)"""
_GR = [o.REP, o.peel("rep", "t"), _RULES]


def _grammar(spark, d) -> grammar.Grammar:
    return grammar.fit(rep(spark, d))


@query(o.query(*_GR, select="select is_start, a, z, kind, cast(a_run as integer) as a_run, cast(z_run as integer) as z_run, dst_a, dst_z, cnt, round(w, 6) as w from r_w"))
def grammar_rules(spark, d):
    return _grammar(spark, d).rules.select(*grammar.NT, *grammar.RULE, "cnt", _r("w"))


_ASKED_STEPS = "qs as (select seq, ord = 0 as is_start, a, z, case when mid <> '' then 'internal' when z_run > 0 then 'leaf_pair' when a_run = 1 then 'leaf_single' else 'leaf_run' end as kind, a_run, z_run, left(mid, 1) as dst_a, right(mid, 1) as dst_z from q_lv)"
_FULL_KEY = "is_start, a, z, kind, a_run, z_run, dst_a, dst_z"
_FORM = "a, z, kind, a_run, z_run, dst_a, dst_z"


@query(o.query(*_GR, o.ASKED, o.peel("asked", "q"), _ASKED_STEPS, f"sc as (select seq, sum(ln(w)) as lp, bool_and(w is not null) as ok from qs left join r_w using ({_FULL_KEY}) group by 1)", select="select seq, round(case when ok then lp else -690.7755278982137 end, 6) as log_pgen from asked left join sc using (seq)"))
def grammar_pgen_mle(spark, d):
    return grammar.log_pgen(_grammar(spark, d), asked(spark, d), "none").select("seq", _r("log_pgen"))


@query(
    o.query(
        *_GR, o.ASKED, o.peel("asked", "q"), _ASKED_STEPS, "nt as (select is_start, a, z, least(count(*) filter (cnt <= 1) / sum(cnt), 0.5) as delta from r_e group by 1, 2, 3)",
        f"mg as (select {_FORM}, sum(cnt) / (select sum(cnt) from r_e) as marg from r_e group by {_FORM})",
        f"p as (select seq, case when w is not null then (1 - delta) * w else delta * marg end as p from qs left join r_w using ({_FULL_KEY}) left join nt using (is_start, a, z) left join mg using ({_FORM}))",
        "sc as (select seq, sum(case when p > 0 then ln(p) end) as lp, bool_and(coalesce(p > 0, false)) as ok from p group by 1)",
        select="select seq, round(case when ok then lp else -690.7755278982137 end, 6) as log_pgen from asked left join sc using (seq)",
    )
)
def grammar_pgen_gt(spark, d):
    return grammar.log_pgen(_grammar(spark, d), asked(spark, d)).select("seq", _r("log_pgen"))


def _lengths_sql(weight: str, out: str) -> str:
    return o.query(
        *_GR,
        f"""gl as (select dst_a as a, dst_z as z, cast(0 as bigint) as len, cast(sum({weight}) as double) as p from r_w where is_start group by 1, 2
            union all select r.dst_a, r.dst_z, g.len + r.a_run + r.z_run, sum(g.p * {weight}) from gl g join r_w r on r.a = g.a and r.z = g.z and not r.is_start
            where g.a <> '' and g.len + r.a_run + r.z_run <= 40 group by 1, 2, 3)""",
        select=f"select cast(len as integer) as length, {out} from gl where a = '' and len <= 40 group by 1",
    )


@query(_lengths_sql("w", "round(sum(p), 9) as prob"))
def grammar_length_pmf(spark, d):
    return grammar.length_table(_grammar(spark, d), 40).filter("n_derivations > 0").select("length", _r("prob", 9))


@query(_lengths_sql("1", "round(log10(sum(p)), 6) as log10_n"))
def grammar_path_count_series(spark, d):
    return grammar.length_table(_grammar(spark, d), 40).filter("n_derivations > 0").select("length", F.round(F.log10("n_derivations"), 6).alias("log10_n"))


_FLOW = """fl as (select 0 as step, true as is_start, '@' as a, '$' as z, cast(1 as double) as m, cast(1 as double) as q, cast(1 as double) as c
        union all select f.step + 1, false, r.dst_a, r.dst_z, sum(f.m * r.w), sum(f.q * r.w * r.w), sum(f.c * pow(r.w, 3)) from fl f join r_w r on r.is_start = f.is_start and r.a = f.a and r.z = f.z and r.kind = 'internal' where f.step < 200 group by f.step + 1, r.dst_a, r.dst_z),
    one as (select is_start, a, z, sum(-w * ln(w)) as h, sum(case when kind <> 'internal' then w * w end) as l2, sum(case when kind <> 'internal' then pow(w, 3) end) as l3 from r_w group by 1, 2, 3),
    tot as (select sum(m * h) as h, sum(q * l2) as p2, sum(c * l3) as p3 from fl join one using (is_start, a, z)), rho as (select sum(case when step = 160 then m end) / sum(case when step = 159 then m end) as r from fl)"""


@query(o.query(*_GR, _FLOW, select="select 'spectral_radius' as measure, round(r, 4) as value from rho union all select 'consistent', 1.0 from rho where r < 1 union all select 'entropy_nats', round(h, 6) from tot union all select 'log_hill_2', round(-ln(p2), 6) from tot union all select 'log_hill_3', round(-ln(p3) / 2, 6) from tot"))
def grammar_entropy(spark, d):
    p = grammar.profile(_grammar(spark, d), (2.0, 3.0)).filter("measure <> 'effective_diversity'")
    hill = F.col("measure").startswith("hill")
    return p.select(F.when(hill, F.concat(F.lit("log_"), "measure")).otherwise(F.col("measure")).alias("measure"), F.when(F.col("measure") == "spectral_radius", F.round("value", 4)).otherwise(F.round(F.when(hill, F.log("value")).otherwise(F.col("value")), 6)).alias("value"))


_DERIVED = """sq as (select seq, ord = 0 as is_start, a, z, case when mid <> '' then 'internal' when z_run > 0 then 'leaf_pair' when a_run = 1 then 'leaf_single' else 'leaf_run' end as kind, a_run, z_run, left(mid, 1) as dst_a, right(mid, 1) as dst_z from t_lv),
    own as (select seq, sum(ln(w)) as lp from sq join r_w using (is_start, a, z, kind, a_run, z_run, dst_a, dst_z) where length(seq) <= 30 group by seq), bar as (select lp from own order by lp desc limit 1 offset 9),
    de(kind, na, nz, front, back, lp) as (select 'internal', dst_a, dst_z, '', '', ln(w) from r_w where is_start
        union all select r.kind, r.dst_a, r.dst_z, d.front || repeat(r.a, cast(r.a_run as bigint)), repeat(r.z, cast(r.z_run as bigint)) || d.back, d.lp + ln(r.w) from de d join r_w r on d.kind = 'internal' and not r.is_start and r.a = d.na and r.z = d.nz where d.lp + ln(r.w) >= (select lp from bar) - 1e-9)"""


@query(o.query(*_GR, _DERIVED, select="select cast(row_number() over (order by lp desc, front || back) as integer) as rank, front || back as seq, round(lp, 6) as log_pgen from de where kind <> 'internal' and length(front || back) <= 30 order by lp desc, seq limit 10"))
def grammar_top_k(spark, d):
    return grammar.top_sequences(_grammar(spark, d), 10).select("rank", "seq", _r("log_pgen"))


@query(o.query(*_GR, select="select dst_a as first, dst_z as last, round(w, 6) as w from r_w where is_start and kind = 'internal'"))
def grammar_sentinels(spark, d):
    return grammar.sentinel_rule_weights(_grammar(spark, d)).select("first", "last", _r("w"))


@query(o.query(*_GR, "nt as (select is_start, a, z, count(*) as n_rules, sum(cnt) as total, round(least(count(*) filter (cnt <= 1) / sum(cnt), 0.5), 6) as unseen from r_e group by 1, 2, 3)", select="select * from nt"))
def grammar_nonterminals(spark, d):
    return grammar.nonterminals(_grammar(spark, d)).select(*grammar.NT, "n_rules", "total", _r("unseen"))


@query(o.query(*_GR, "gl as (select dst_a as a, dst_z as z, cast(0 as bigint) as len, min(ln(w)) as lo, max(ln(w)) as hi from r_w where is_start group by 1, 2 union all select r.dst_a, r.dst_z, g.len + r.a_run + r.z_run, min(g.lo + ln(r.w)), max(g.hi + ln(r.w)) from gl g join r_w r on r.a = g.a and r.z = g.z and not r.is_start where g.a <> '' and g.len + r.a_run + r.z_run <= 30 group by 1, 2, 3)", select="select round(min(lo), 6) as min_log_pgen, round(max(hi), 6) as max_log_pgen, round(max(hi) - min(lo), 6) as dynamic_range from gl where a = '' and len <= 30"))
def grammar_dynamic_range(spark, d):
    return grammar.dynamic_range(_grammar(spark, d)).select(_r("min_log_pgen"), _r("max_log_pgen"), _r("dynamic_range"))


@query(
    o.query(
        *_GR, o.UNIT, o.peel("unit", "u"),
        "n_e as (select ord = 0 as is_start, a, z, case when mid <> '' then 'internal' when z_run > 0 then 'leaf_pair' when a_run = 1 then 'leaf_single' else 'leaf_run' end as kind, a_run, z_run, left(mid, 1) as dst_a, right(mid, 1) as dst_z, cast(sum(abundance) as double) as c from u_lv join unit using (seq) group by all)",
        f"x as (select {_FULL_KEY}, 10.0 * w + coalesce(c, 0) as cnt from r_w left join n_e using ({_FULL_KEY}))",
        select=f"select is_start, a, z, kind, cast(a_run as integer) as a_run, cast(z_run as integer) as z_run, dst_a, dst_z, round(cnt, 6) as cnt, round(cnt / sum(cnt) over (partition by is_start, a, z), 6) as w from x",
    )
)
def grammar_posterior(spark, d):
    return grammar.posterior(_grammar(spark, d), unit(spark, d), 10.0).rules.select(*grammar.NT, *grammar.RULE, _r("cnt"), _r("w"))


@query(
    o.query(
        *_GR, o.UNIT, o.peel("unit", "u"),
        "n_e as (select ord = 0 as is_start, a, z, case when mid <> '' then 'internal' when z_run > 0 then 'leaf_pair' when a_run = 1 then 'leaf_single' else 'leaf_run' end as kind, a_run, z_run, left(mid, 1) as dst_a, right(mid, 1) as dst_z, cast(sum(abundance) as double) as c from u_lv join unit using (seq) group by all)",
        f"x as (select {_FULL_KEY}, cnt - coalesce(c, 0) as cnt from r_w left join n_e using ({_FULL_KEY}) where cnt - coalesce(c, 0) > 1e-9)",
        select=f"select is_start, a, z, kind, cast(a_run as integer) as a_run, cast(z_run as integer) as z_run, dst_a, dst_z, cnt, round(cnt / sum(cnt) over (partition by is_start, a, z), 6) as w from x",
    )
)
def grammar_without(spark, d):
    return grammar.without(_grammar(spark, d), unit(spark, d)).rules.select(*grammar.NT, *grammar.RULE, "cnt", _r("w"))


# reading


@query(rf"select row_id, regexp_full_match(trim(junction_aa, {o._B}), '[*.\-]*\p{{L}}[\p{{L}}*.\-]*') as wellformed, coalesce(lower(trim(productive, {o._B})) in ('t', 'true', '1', 'yes'), false) as productive from regression_input")
def wellformed_filter(spark, d):
    return table(spark, d, "regression_input", "row_id", "junction_aa", "productive").select("row_id", tx.is_sequence(F.col("junction_aa")).alias("wellformed"), tx.is_productive(F.col("productive")).alias("productive"))


@query(
    r"""with t as (select gene_segment, regexp_replace(upper(coalesce(string_agg(germline_nt, ''), '')), '[-.*_ \t]', '', 'g') as s from gene_reference group by 1)
    select gene_segment, case when s = '' then 'ambiguous' when length(regexp_replace(s, '[ACGTUNRYSWKMBDHV]', '', 'g')) = 0 and length(regexp_replace(s, '[^ACGTUN]', '', 'g')) >= 0.65 * length(s) then 'nucleotide' else 'amino_acid' end as alphabet from t"""
)
def alphabet_inference(spark, d):
    rows = table(spark, d, "gene_reference", "gene_segment", "germline_nt")
    return rows.groupBy("gene_segment").agg(tx.alphabet_of(F.col("germline_nt")).alias("alphabet"))


# samples, saturation, scaffold


@query(
    o.query(
        "rows_ as (select row_number() over (order by seq) as idx, seq from (select distinct seq from unit_repertoire where seq <> ''))", o.lz("rows_", "t"),
        "nf as (select label, min(idx) as f from (select seq, unnest(labels) as label from t_lab) join rows_ using (seq) group by 1)", "ef as (select src, dst, min(idx) as f from t_tr join rows_ using (seq) group by 1, 2)",
        "pt as (select distinct least(cast(ceil(idx / 100.0) * 100 as bigint), (select max(idx) from rows_)) as n_seqs from rows_)",
        select="select n_seqs, (select count(*) from nf where f <= n_seqs) as n_nodes, (select count(*) from ef where f <= n_seqs) as n_edges from pt",
    )
)
def saturation_curve(spark, d):
    from reploom.session import running_total

    seqs = table(spark, d, "unit_repertoire", "seq").filter("seq <> ''").distinct().withColumn("one", F.lit(1))
    return occupancy.saturation(running_total(seqs, "seq", "one", "idx").select("idx", "seq"), "aap", 100)


@query(
    o.query(
        o.REP, o.model("rep", "m", "flashback"), _DEGREES,
        o.SLOTS,
        select='select ord, lane, cast(off as integer) as "offset", cast(sum(mass) as bigint) as mass, count(*) as n_tokens from sl group by 1, 2, 3',
    )
)
def scaffold_slot_counts(spark, d):
    return scaffold.slots(md.fit(rep(spark, d), "flashback"))


@query(o.query(o.UNIT, o.peel("unit", "u"), select="select seq, list(label order by ord) filter (ord > 0) as tokens, cast(count(*) filter (ord > 0) as integer) as n_latent, true as same_shape from u_lv group by seq"))
def scaffold_alignment(spark, d):
    """Observed tokens, and the latent ones by their number and by whether each has the shape of the token it stands for."""
    a = scaffold.align(md.fit(unit(spark, d), "flashback"), unit(spark, d))
    shape = lambda t: F.struct(F.length(F.regexp_extract(t, r"(?s)^(.*)_(\d+)\{(\d+)\}$", 1)), F.regexp_extract(t, r"(?s)^(.*)_(\d+\{\d+\})$", 2))
    same = F.forall(F.zip_with("tokens", "latent", lambda x, y: shape(x) == shape(y)), lambda b: b)
    return a.select("seq", "tokens", F.size("latent").alias("n_latent"), same.alias("same_shape"))


@query(
    o.query(
        o.REP, o.UNIT, o.model("rep", "m", "flashback"), _DEGREES, o.SLOTS, o.peel("unit", "u"),
        """uf as (select ord, case when mid = '' then 'center' else 'front' end as lane, unnest(range(case when mid = '' then a_run + z_run else a_run end)) as off from u_lv where ord > 0
            union all select ord, 'back', unnest(range(case when mid = '' then 0 else z_run end)) from u_lv where ord > 0)""",
        "us as (select ord, lane, off, count(*) as n_seqs from uf group by all), kn as (select distinct ord, lane, off, true as known from sl), n as (select count(*) as n from unit where seq <> '')",
        select='select ord, lane, cast(off as integer) as "offset", coalesce(n_seqs, 0) as n_seqs, round(coalesce(n_seqs, 0) / (select n from n), 9) as occupancy, coalesce(known, false) as in_scaffold from kn full join us using (ord, lane, off)',
    )
)
def scaffold_occupancy(spark, d):
    r = scaffold.occupancy(md.fit(rep(spark, d), "flashback"), unit(spark, d))
    return r.select("ord", "lane", "offset", "n_seqs", _r("occupancy", 9), "in_scaffold")


N_SIM = 10_000  # fixed value: walks of a Monte Carlo estimate
_ENTROPY = "select round(h, 6) as entropy"


def _sims(spark, d, n: int = N_SIM) -> DataFrame:
    return simulate.simulate(md.fit(unit(spark, d), "aap"), n, SEED)


def _checked(sims: DataFrame, scores: DataFrame) -> DataFrame:
    """One row: draws, different numbers of draws, draws whose own log probability equals that of the scorer."""
    both = sims.join(scores, "seq")
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("i").alias("n_ids"), F.count_if(F.abs(F.col("log_prob") - F.col("log_pgen")) < 1e-6).alias("n_scored_alike"))


@query(f"select {N_SIM} as n, {N_SIM} as n_ids, {N_SIM} as n_scored_alike")
def simulate_lz(spark, d):
    """Every draw scored by the model, normalised by the same absorption."""
    m = md.fit(unit(spark, d), "aap")
    sims = cut(simulate.simulate(m, N_SIM, SEED))
    return _checked(sims, score.log_pgen(m, sims, log_absorption=math.log(simulate.absorption(m))))


@query(_absorbed({"m": _MASS, "h": _ENT}, f"{_ENTROPY}, {N_SIM} as n, {N_SIM} as n_ids, {N_SIM} as n_scored_alike, true as mean_within from f"))
def simulate_flashback(spark, d):
    """Every draw scored by the model, and the mean of -log p within five standard errors of the exact entropy."""
    m = _fb(spark, d)
    sims = cut(simulate.simulate(m, N_SIM, SEED))
    h = analytics.entropy(m).first()["entropy_nats"]
    within = sims.agg((F.abs(F.avg(-F.col("log_prob")) - h) < 5 * F.stddev_samp("log_prob") / F.sqrt(F.count(F.lit(1)))).alias("w")).scalar()
    return _checked(sims, score.log_pgen(m, sims)).select(F.lit(round(h, 6)).alias("entropy"), "*", within.alias("mean_within"))


@query(o.query(*_GR, _FLOW, select=f"{_ENTROPY}, {N_SIM} as n, {N_SIM} as n_ids, {N_SIM} as n_scored_alike, true as mean_within from tot"))
def simulate_grammar(spark, d):
    g = _grammar(spark, d)
    sims = cut(simulate.simulate_grammar(g, N_SIM, SEED))
    h = grammar.Solver(g).entropy()
    within = sims.agg((F.abs(F.avg(-F.col("log_prob")) - h) < 5 * F.stddev_samp("log_prob") / F.sqrt(F.count(F.lit(1)))).alias("w")).scalar()
    return _checked(sims, grammar.log_pgen(g, sims, "none")).select(F.lit(round(h, 6)).alias("entropy"), "*", within.alias("mean_within"))


@query(o.query(*_GENES, select="select v_gene, true as share_within from known group by v_gene having sum(abundance) >= 0.05 * (select sum(abundance) from known)"))
def simulate_genes(spark, d):
    """The frequent V genes, and whether their share of 2,000 draws is within five standard errors of the model's."""
    m, n = _with_genes(spark, d), 2000
    drawn = simulate.simulate_genes(m, n, SEED).filter("seq <> ''").groupBy("v_gene").agg(F.count(F.lit(1)).alias("c"))
    want = genes.marginals(m).filter("kind = 'v' and prob >= 0.05").select(F.col("gene").alias("v_gene"), "prob")
    p = F.col("prob")
    return want.join(drawn, "v_gene", "left").select("v_gene", (F.abs(F.coalesce("c", F.lit(0)) / n - p) < 5 * F.sqrt(p * (1 - p) / n) + 0.005).alias("share_within"))


@query(_absorbed({"m": _MASS, "h": _ENT, "q": ("1", "d.q * pow(e.w, 1.5)")}, "select cast(1 as double) as alpha, round(h, 6) as log_hill, true as within from f union all select 1.5, round(ln(q) / -0.5, 6), true from f"))
def hill_mc(spark, d):
    """Hill numbers from draws of a run-peeling model beside the exact ones: logarithms within 0.15."""
    m = _fb(spark, d)
    exact = analytics.hill_curve(m, (1.0, 1.5)).withColumnRenamed("hill", "e")
    mc = analytics.monte_carlo(simulate.simulate(m, N_SIM, SEED), (1.0, 1.5))
    return exact.join(mc, "alpha").select("alpha", F.round(F.log("e"), 6).alias("log_hill"), (F.abs(F.log("hill") - F.log("e")) < 0.15).alias("within"))


@query(_absorbed({"m": _MASS, "h": _ENT}, f"{_ENTROPY}, {N_SIM} as n_walks, true as entropy_within, true as range_within from f"))
def sampled_profile(spark, d):
    """The profile that LZ models get from walks, here of a run-peeling model beside its exact entropy and range."""
    m = _fb(spark, d)
    h, r = analytics.entropy(m).first()["entropy_nats"], analytics.dynamic_range(m).first()
    p = analytics.sampled_profile(simulate.simulate(m, N_SIM, SEED))
    inside = (F.col("min_log_pgen") >= r["min_log_pgen"] - 1e-9) & (F.col("max_log_pgen") <= r["max_log_pgen"] + 1e-9)
    return p.select(F.lit(round(h, 6)).alias("entropy"), "n_walks", (F.abs(F.col("entropy_nats") - h) < 5 * F.col("entropy_error")).alias("entropy_within"), inside.alias("range_within"))


@query("select true as whole, true as mean_within, true as rising, true as drawn_within")
def pgen_mixture(spark, d):
    """Invariants of the mixture: weights sum to 1, its mean is that of the draws, the distribution function rises to 1, its own draws have its mean."""
    sims = cut(_sims(spark, d))
    mix = cut(analytics.mixture(sims))
    m = mix.agg(F.sum("weight").alias("w"), F.sum(F.col("weight") * F.col("mean")).alias("m")).first()
    curve = analytics.mixture_curve(mix, [-80.0, -40.0, -20.0, 20.0]).agg(F.sort_array(F.collect_list("cdf")).alias("c"), F.collect_list("cdf").alias("o"), F.max("cdf").alias("top"))
    drawn = analytics.mixture_sample(mix, 20_000, SEED).agg(F.avg("log_pgen").alias("a")).scalar()
    return curve.select(F.lit(abs(m["w"] - 1) < 1e-9).alias("whole"), (F.abs(sims.agg(F.avg("log_prob")).scalar() - m["m"]) < 0.2).alias("mean_within"), ((F.col("c") == F.col("o")) & (F.col("top") > 0.999)).alias("rising"), (F.abs(drawn - m["m"]) < 0.3).alias("drawn_within"))


_DEPTHS = (50.0, 100.0, 200.0)


def _small_sims(spark, d) -> DataFrame:
    return cut(simulate.simulate(_small(spark, d), N_SIM, SEED))


@query(o.query(*_SMALL, _PATHS, select=" union all ".join(f"select cast({n} as double) as depth, round(sum(1 - exp(-{n} * exp(lp))), 6) as exact, true as within from full_" for n in _DEPTHS)))
def predicted_richness(spark, d):
    """Richness predicted from draws beside the exact sum over all sequences: within 3 %."""
    a = spectrum.atoms(_small(spark, d))
    exact = a.agg(*[F.sum(-F.expm1(-F.lit(n) * F.exp("log_pgen"))).alias(f"e{i}") for i, n in enumerate(_DEPTHS)]).first()
    rows = spark.createDataFrame([(n, exact[f"e{i}"]) for i, n in enumerate(_DEPTHS)], "depth double, exact double")
    return rows.join(occupancy.richness_curve(_small_sims(spark, d), list(_DEPTHS)), "depth").select("depth", _r("exact"), (F.abs(F.col("richness") / F.col("exact") - 1) < 0.03).alias("within"))


@query(o.query(*_SMALL, _PATHS, select="select round(sum((1 - exp(-50 * exp(lp))) * (1 - exp(-100 * exp(lp)))), 6) as exact, true as within from full_"))
def predicted_overlap(spark, d):
    """Overlap of two samples predicted from draws beside the exact sum: within 5 %."""
    a = spectrum.atoms(_small(spark, d)).agg(F.sum(F.expm1(-50 * F.exp("log_pgen")) * F.expm1(-100 * F.exp("log_pgen"))).alias("exact"))
    return a.select(_r("exact"), (F.abs(occupancy.predicted_overlap(_small_sims(spark, d), 50.0, 100.0).scalar() / F.col("exact") - 1) < 0.05).alias("within"))


@query("select k, true as positive, true as whole from range(1, 11) t(k)")
def predict_sharing(spark, d):
    """Sequences shared by exactly k of ten samples: each positive, and all of them together, k times each, the ten samples' own sequences."""
    mix, draws = cut(analytics.mixture(cut(_sims(spark, d)))), 1000.0
    p = occupancy.predict_sharing(mix, [draws] * 10).collect()
    one = occupancy.predict_sharing(mix, [draws]).first()["expected"]
    whole = abs(sum(r["k"] * r["expected"] for r in p) / (10 * one) - 1) < 1e-6
    return spark.createDataFrame([(r["k"], r["expected"] > 0, whole) for r in p], "k bigint, positive boolean, whole boolean")


@query(o.query("rows_ as (select distinct seq from unit_repertoire where seq <> '')", o.lz("rows_", "t"), select="select cast(count(distinct tok) as double) as mean, cast(0 as double) as std, true as inside from (select unnest(toks) as tok from t_tok)"))
def k_diversity(spark, d):
    """Draws of all sequences have every token; draws of 100 have fewer, with their mean inside its interval."""
    seqs = table(spark, d, "unit_repertoire", "seq").filter("seq <> ''").distinct()
    some = occupancy.k_diversity(seqs, 100).first()
    return occupancy.k_diversity(seqs, 1_000_000_000, draws=3).select("mean", "std", (F.lit(some["mean"]).between(some["ci_low"], some["ci_high"]) & (F.col("mean") >= some["mean"])).alias("inside"))


@query(o.query(o.ASKED, select="select count(*) as n, count(*) as n_finite, true as centred from asked"))
def scale_scores(spark, d):
    """All queries scaled by a calibration that went through its file; the draws it came from have a median scale of about 0."""
    m = _fb(spark, d)
    sims, folder = cut(simulate.simulate(m, simulate.SCALE_DRAWS, SEED)), work_folder(spark, "calibration")
    simulate.save_calibration(simulate.calibrate_scale(sims), folder)
    cal = simulate.load_calibration(spark, folder)
    own = simulate.scale_scores(sims.select("seq", F.col("log_prob").alias("log_pgen")), cal).agg((F.abs(F.percentile_approx("scale", 0.5, 10_000)) < 0.05).alias("c"))
    rows = simulate.scale_scores(score.log_pgen(m, asked(spark, d)), cal)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.abs("scale") < float("inf")).alias("n_finite")).withColumn("centred", own.scalar())


@query(o.query(*_FB, """dp as (select 0 as step, '@$_1{0}' as node, cast(0 as bigint) as len, cast(1 as double) as p union all
        select d.step + 1, e.dst, d.len + length(regexp_replace(e.dst, '_[0-9]+\\{[0-9]+\\}$', '')), sum(d.p * e.w) from dp d join m_w e on e.src = d.node group by d.step + 1, e.dst, d.len + length(regexp_replace(e.dst, '_[0-9]+\\{[0-9]+\\}$', '')))""",
    "l as (select least(len, 30) as length, sum(p) as p from dp join s using (node) group by 1)", select="select cast(length as integer) as length, round(p, 6) as exact, true as within from l where p >= 0.01"))
def feature_mass_profile(spark, d):
    """Share of draws by length beside the exact mass: within five standard errors where it is at least 1 %."""
    m = _fb(spark, d)
    exact = spectrum.mass_by_length(m, squared=False).withColumnRenamed("mass", "p").filter("p >= 0.01")
    mc = simulate.mass_profile(simulate.simulate(m, N_SIM, SEED), squared=False)
    return exact.join(mc, "length", "left").select("length", F.round("p", 6).alias("exact"), (F.abs(F.col("mass") - F.col("p")) < 5 * F.sqrt(F.col("p") * (1 - F.col("p")) / N_SIM)).alias("within"))


# stores


@query(ORACLE["flashback_edges"])
def model_store(spark, d):
    """Edges of a model that was saved and loaded."""
    folder = work_folder(spark, "model")
    md.save(_fb(spark, d), folder)
    return _edges_of(md.load(spark, folder))


@query(ORACLE["grammar_rules"])
def grammar_store(spark, d):
    folder = work_folder(spark, "grammar")
    grammar.save(_grammar(spark, d), folder)
    return grammar.load(spark, folder).rules.select(*grammar.NT, *grammar.RULE, "cnt", _r("w"))


@query(o.query(o.REP, o.model("rep", "m", "aap"), select="select src as node, list(dst order by dst) as targets from m_e group by src"))
def adjacency(spark, d):
    return structure.adjacency(md.fit(rep(spark, d), "aap")).filter("size(targets) > 0").select("node", "targets")


@query(ORACLE["flashback_edges"])
def streaming_build(spark, d):
    """The same edges through micro-batches of a stream over the table's files."""
    import os

    from reploom.streaming.builder import StreamBuilder

    work = work_folder(spark, "stream")
    path = f"{d}/regression_input.parquet"
    src = table(spark, d, "regression_input")
    stream = spark.readStream.schema(src.schema).parquet(path if os.path.isdir(path) else path.replace("regression_input.parquet", "regression_input*.parquet"))
    rows = stream.filter(tx.is_productive(F.col("productive"))).select(tx.strip(F.col("junction_aa")).alias("seq"), F.greatest(F.coalesce("duplicate_count", F.lit(1)), F.lit(1)).alias("abundance")).filter(F.col("seq").rlike(tx.SEQUENCE_PATTERN))
    b = StreamBuilder(spark, f"{work}/state")
    b.attach(rows, f"{work}/ckpt").awaitTermination()
    return b.finalize().edges.select("src", "dst", "cnt", _r("w"))
