"""Generation probability of sequences under a model.

Only distinct queries are scored. What a model cannot produce gets the floor LOG_EPS. Up to MAX_BROADCAST edges, a checked bound, whole sequences are
scored in Arrow batches over a broadcast of the model, without a shuffle of steps; larger models are joined step by step, by source and target.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reploom.functions import tokens as tk
from reploom.plans.dp import LocalGraph
from reploom.plans.model import IN_MODEL, LOG_EPS, Model, ModelError, labelled, spread, transitions
from reploom.session import cut, running_total

#: Edges of a model that is broadcast for scoring: some hundred megabytes a worker at most.
MAX_BROADCAST = 500_000
# The letters that the validity rule tells apart where others share one place.
_STANDARD = list("ACDEFGHIKLMNPQRSTVWY@$")


def distinct_queries(df: DataFrame, seq: str = "seq") -> DataFrame:
    """(seq): distinct non-null queries; the empty string is one that scores the floor."""
    return df.select(F.col(seq).alias("seq")).filter("seq is not null").distinct()


def log_pgen(model: Model, queries: DataFrame, shared_symbols: bool = False, log_absorption: float = 0.0, limit: int = MAX_BROADCAST) -> DataFrame:
    """(seq, log_pgen) for every distinct query.

    Run-peeling: the sum of log weights along the path, which has to end in a sink. LZ: each weight is taken relative to those
    edges that are valid after the tokens emitted so far, and log_absorption, the log of the share of walks that reach a sink, is
    subtracted: 0 gives the raw score, simulate.absorption the normalised one. shared_symbols gives all non-standard letters one place in the
    validity rule. limit is the number of edges up to which the model is broadcast.
    """
    if model.variant == "naive":
        raise ModelError("the naive variant may be cyclic and is not scored")
    q = distinct_queries(queries)
    g = LocalGraph.within(model, limit=limit)
    if g is not None:
        lp = F.coalesce(_scorer(model, g, shared_symbols, log_absorption)(F.col("seq")), F.lit(LOG_EPS))
        return spread(q).select("seq", lp.alias("log_pgen"))
    if model.variant == "flashback":
        steps = transitions(labelled(q, "flashback"), "seq")
        hit = steps.join(model.edges.select("src", "dst", "w"), ["src", "dst"], "left")
        ended = model.sinks().withColumnRenamed("node", "end").withColumn("is_sink", F.lit(True))
        agg = hit.groupBy("seq").agg(F.sum(F.log("w")).alias("lp"), F.max(F.col("w").isNull()).alias("miss"), F.max_by("dst", "i").alias("end"))
        scored = agg.join(ended, "end", "left").select("seq", F.when(~F.col("miss") & F.col("is_sink"), F.col("lp")).alias("lp"))
    else:
        scored = _lz_scores(model, q, shared_symbols, log_absorption)
    return q.join(scored, "seq", "left").select("seq", F.coalesce("lp", F.lit(LOG_EPS)).alias("log_pgen"))


def _scorer(model: Model, g: LocalGraph, shared: bool, log_absorption: float):
    """Arrow function: log probability of whole sequences over the broadcast model; null for what it cannot produce."""
    out: dict[str, list[tuple[str, str, float]]] = {}
    for s, d, w in zip(g.src.tolist(), g.dst.tolist(), g.w.tolist()):
        out.setdefault(g.labels[s], []).append((g.labels[d], g.toks[d], w))
    table = {k: {d: math.log(w) for d, _, w in v} for k, v in out.items()} if model.variant == "flashback" else out
    shared_table, variant, sinks = model.spark.sparkContext.broadcast(table), model.variant, None
    if variant == "flashback":
        sinks = model.spark.sparkContext.broadcast({g.labels[i] for i in range(len(g.labels)) if g.sink[i]})

    @F.pandas_udf("double")
    def run(seqs: pd.Series) -> pd.Series:
        table = shared_table.value
        if variant == "flashback":
            return pd.Series([score_path(table, sinks.value, tk.peel_labels(s)) if s else None for s in seqs], dtype="float64")
        return pd.Series([None if not s or (lp := score_lz(table, *tk.lz_nodes(s), shared)) is None else lp - log_absorption for s in seqs], dtype="float64")

    return run.asNondeterministic()


def score_path(table: dict[str, dict[str, float]], sinks: set[str], labels: list[str]) -> float | None:
    """Sum of log weights along labels that end in a sink; None off the model."""
    total = 0.0
    for a, b in zip(labels, labels[1:]):
        lw = table.get(a, {}).get(b)
        if lw is None:
            return None
        total += lw
    return total if labels[-1] in sinks and len(labels) > 1 else None


def score_lz(table: dict[str, list[tuple[str, str, float]]], toks: list[str], labels: list[str], shared: bool = False) -> float | None:
    """Sum of log(w / total of the valid edges) along a parse; None off the model. As valid_after, on the tokens emitted so far."""
    emitted, odd, total = {toks[0]}, False, 0.0
    for i in range(1, len(labels)):
        z = hit = 0.0
        for dst, tok, w in table.get(labels[i - 1], ()):
            if len(tok) == 1:
                if odd if shared and tok not in _STANDARD else tok in emitted:
                    continue
            elif tok in emitted or tok[:-1] not in emitted:
                continue
            z += w
            if dst == labels[i]:
                hit = w
        if not hit > 0:
            return None
        total += math.log(hit / z)
        emitted.add(toks[i])
        odd = odd or (len(toks[i]) == 1 and toks[i] not in _STANDARD)
    return total if toks[-1].endswith(tk.END) and len(labels) > 1 else None


def valid_after(tok: Column, emitted: Column, shared_symbols: bool = False) -> Column:
    """Whether a token may follow the tokens emitted: a single character must be new as a token, a longer one must be new with a known prefix.

    The end mark's token is longer than its prefix like any other; the start mark is emitted first.
    """
    fresh = ~F.array_contains(emitted, tok)
    if shared_symbols:
        odd = ~tok.isin(*_STANDARD)
        fresh_single = F.when(odd, ~F.exists(emitted, lambda t: (F.length(t) == 1) & ~t.isin(*_STANDARD))).otherwise(fresh)
    else:
        fresh_single = fresh
    return F.when(F.length(tok) == 1, fresh_single).otherwise(fresh & F.array_contains(emitted, F.left(tok, F.length(tok) - 1)))


def _lz_scores(model: Model, q: DataFrame, shared: bool, log_absorption: float) -> DataFrame:
    lab = labelled(q.filter("seq <> ''"), model.variant)
    steps = F.transform(F.sequence(F.lit(1), F.size("labels") - 1), lambda i: F.struct(i.alias("i"), F.col("labels")[i - 1].alias("src"), F.col("labels")[i].alias("dst"), F.slice("toks", 1, i).alias("emitted")))
    t = lab.select("seq", F.explode(steps).alias("t")).select("seq", "t.*")
    fan = model.edges.groupBy("src").agg(F.collect_list(F.struct("dst", "tok", "w")).alias("fan"))  # bounded by a node's out-degree, not by rows
    j = t.join(fan, "src", "left")
    open_ = F.filter("fan", lambda e: valid_after(e["tok"], F.col("emitted"), shared))
    p = j.select("seq", "i", "dst", open_.alias("open")).select(
        "seq", "i", "dst",
        F.aggregate("open", F.lit(0.0), lambda a, e: a + e["w"]).alias("z"),
        F.aggregate(F.filter("open", lambda e: e["dst"] == F.col("dst")), F.lit(0.0), lambda a, e: a + e["w"]).alias("w"),
    )
    ok = F.coalesce((F.col("w") > 0) & (F.col("z") > 0), F.lit(False))
    agg = p.groupBy("seq").agg(F.sum(F.when(ok, F.log(F.col("w") / F.col("z")))).alias("lp"), F.min(ok).alias("all_ok"))
    return agg.filter("all_ok").select("seq", (F.col("lp") - F.lit(log_absorption)).alias("lp"))


def contains(model: Model, queries: DataFrame, **how) -> DataFrame:
    """(seq, in_model): whether the model can produce each distinct query."""
    return log_pgen(model, queries, **how).select("seq", (F.col("log_pgen") > IN_MODEL).alias("in_model"))


def sequence_perplexity(scores: DataFrame) -> DataFrame:
    """(seq, n_tokens, perplexity, bits_per_token) of scored sequences, by the token count of the unwrapped parse; infinite when out of the model."""
    n = F.size(tk.lz76(F.col("seq")))
    ok, rate = (F.col("log_pgen") > IN_MODEL) & (F.col("n_tokens") > 0), -F.col("log_pgen") / F.col("n_tokens")
    return scores.select("seq", "log_pgen", n.alias("n_tokens")).select(
        "seq", "n_tokens", F.when(ok, F.exp(rate)).otherwise(F.lit(float("inf"))).alias("perplexity"), F.when(ok, rate / F.log(F.lit(2.0))).alias("bits_per_token")
    )


def repertoire_perplexity(scores: DataFrame) -> DataFrame:
    """One row: perplexity (infinite if any sequence is out of the model), entropy_rate in bits over those in the model (0 for none)."""
    p = sequence_perplexity(scores)
    miss = F.count_if(F.col("bits_per_token").isNull())
    mean = F.avg("bits_per_token")
    return p.agg(miss.alias("miss"), mean.alias("mean")).select(
        F.when(F.col("miss") > 0, F.lit(float("inf"))).otherwise(F.pow(F.lit(2.0), "mean")).alias("perplexity"), F.coalesce("mean", F.lit(0.0)).alias("entropy_rate")
    )


def approximation_diagnostics(model: Model, test: DataFrame, **how) -> DataFrame:
    """One row over counted test sequences (seq, abundance): coverage, cross-entropy, entropy, KL, perplexity, mean and median log pgen, Spearman.

    coverage_types and coverage_mass are shares of distinct and of all sequences in the model; entropies are of the covered part in nats. Spearman's
    rank correlation of count and log pgen is null below three covered sequences or without spread.
    """
    counts = test.groupBy("seq").agg(F.sum("abundance").alias("n"))
    s = cut(counts.join(log_pgen(model, counts, **how), "seq")).withColumn("hit", F.col("log_pgen") > IN_MODEL)
    base = s.agg(F.count(F.lit(1)).alias("n_types"), F.count_if("hit").alias("n_hit"), F.sum("n").alias("mass"), F.sum(F.when(F.col("hit"), F.col("n"))).alias("hit_mass"))
    c = cut(s.filter("hit").withColumn("q", F.col("n") / base.select("hit_mass").scalar()))
    e = c.agg(
        F.sum(-F.col("q") * F.col("log_pgen")).alias("cross_entropy"), F.sum(-F.col("q") * F.log("q")).alias("entropy"), F.avg("log_pgen").alias("mean_log_pgen"),
    )
    ranks, median = c, None
    for col, name in (("n", "rn"), ("log_pgen", "rl")):
        # average ranks from the counts of distinct values
        values = running_total(c.groupBy(F.col(col).alias("v")).agg(F.count(F.lit(1)).alias("c")), "v", "c", "upto")
        if col == "log_pgen":  # the two middle values, from the same running counts
            half = values.agg(F.sum("c").alias("n")).select(F.col("n") / 2).scalar()
            median = values.agg(((F.min(F.when(F.col("upto") >= half, F.col("v"))) + F.min(F.when(F.col("upto") >= F.floor(half) + 1, F.col("v")))) / 2).alias("m"))
        ranks = ranks.join(values.select("v", (F.col("upto") - F.col("c") / 2 + 0.5).alias(name)), F.col(col) == F.col("v")).drop("v")
    rho = ranks.agg(F.when(F.count(F.lit(1)) >= 3, F.try_divide(F.covar_pop("rn", "rl"), F.stddev_pop("rn") * F.stddev_pop("rl"))).alias("spearman"))
    return base.select("n_types", F.try_divide("n_hit", "n_types").alias("coverage_types"), F.try_divide(F.coalesce("hit_mass", F.lit(0)), F.col("mass")).alias("coverage_mass"), *[e.select(x).scalar().alias(x) for x in e.columns]).select(
        "n_types", "coverage_types", "coverage_mass", "cross_entropy", "entropy", (F.col("cross_entropy") - F.col("entropy")).alias("kl"), F.exp("cross_entropy").alias("perplexity"), "mean_log_pgen", median.scalar().alias("median_log_pgen"), rho.scalar().alias("spearman")
    )
