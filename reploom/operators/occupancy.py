"""Richness, overlap and sharing between samples, saturation and k-diversity."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reploom.plans.model import labelled, transitions
from reploom.session import cut, running_total

TERMS = 50  # fixed value: power sums of the residual series


def wynn(partial: list[float]) -> float:
    """Limit of a series by the epsilon algorithm's even columns; the last partial sum where it breaks down."""
    if not partial:
        return 0.0
    prev, cur, best = [0.0] * (len(partial) + 1), list(partial), partial[-1]
    for col in range(1, len(partial)):
        nxt = []
        for i in range(len(cur) - 1):
            d = cur[i + 1] - cur[i]
            if d == 0 or not math.isfinite(d):
                return cur[i + 1] if (col - 1) % 2 == 0 else best
            nxt.append(prev[i + 1] + 1 / d)
        prev, cur = cur, nxt
        if col % 2 == 0 and cur and math.isfinite(cur[-1]):
            best = cur[-1]
    return best


def richness_curve(sims: DataFrame, depths: list[float], power_sums: list[float] | None = None) -> DataFrame:
    """(depth, richness): expected distinct sequences in depth draws.

    Distinct simulated sequences count exactly, 1 - exp(-d p) each; the rest by the alternating series over residual power sums
    M(k) - sum p^k with accelerated summation, 0 where it is negative or diverges. power_sums has M(1..); estimated from the samples otherwise.
    """
    uniq = cut(sims.groupBy("seq").agg(F.max("log_prob").alias("lp")))
    large = uniq.agg(*[F.sum(-F.expm1(-F.lit(float(d)) * F.exp("lp"))).alias(f"d{i}") for i, d in enumerate(depths)]).first()
    found = uniq.agg(*[F.sum(F.exp(F.lit(k) * F.col("lp"))).alias(f"k{k}") for k in range(1, TERMS + 1)]).first()
    total = power_sums
    if power_sums is None:
        row = sims.agg(*[F.avg(F.exp(F.lit(k - 1) * F.col("log_prob"))).alias(f"k{k}") for k in range(1, TERMS + 1)]).first()
        total = [row[f"k{k}"] for k in range(1, TERMS + 1)]
    rest = [max(t - (found[f"k{k}"] or 0.0), 0.0) for k, t in enumerate(total, 1)]
    rows = []
    for i, d in enumerate(depths):
        partial, s = [], 0.0
        for k, m in enumerate(rest, 1):
            term = (-1) ** (k + 1) * math.exp(k * math.log(d) - math.lgamma(k + 1)) * m if d > 0 else 0.0
            s += term
            partial.append(s)
            if k >= 5 and abs(term) < 1e-15 * abs(s):
                break
        small = wynn(partial)
        rows.append((float(d), float((large[f"d{i}"] or 0.0) + (small if math.isfinite(small) and small > 0 else 0.0))))
    return sims.sparkSession.createDataFrame(rows, "depth double, richness double")


def predicted_overlap(sims: DataFrame, di: float, dj: float, power_sums: list[float] | None = None) -> DataFrame:
    """One row, overlap: F(di) + F(dj) - F(di + dj), at least 0."""
    f = [r["richness"] for r in richness_curve(sims, [di, dj, di + dj], power_sums).collect()]
    return sims.sparkSession.createDataFrame([(max(f[0] + f[1] - f[2], 0.0),)], "overlap double")


def sharing_pmf(p: float, draws: np.ndarray, max_k: int) -> np.ndarray:
    """Probability that a sequence of probability p is in exactly k = 1..max_k samples; normal approximation above 500 samples."""
    q = -np.expm1(-draws * p)
    if len(q) <= 500:
        pmf = np.zeros(max_k + 1)
        pmf[0] = 1.0
        for x in q:
            pmf[1:] = pmf[1:] * (1 - x) + pmf[:-1] * x
            pmf[0] *= 1 - x
        return np.maximum(pmf[1:], 0.0)
    mu, var, k = q.sum(), (q * (1 - q)).sum(), np.arange(1, max_k + 1)
    if var < 1e-15:
        return np.exp(-mu + k * math.log(mu) - np.array([math.lgamma(x + 1) for x in k])) if mu > 1e-15 else np.zeros(max_k)
    phi = np.vectorize(lambda x: 0.5 * math.erfc(-x / math.sqrt(2)))
    return np.maximum(phi((k + 0.5 - mu) / math.sqrt(var)) - phi((k - 0.5 - mu) / math.sqrt(var)), 0.0)


def predict_sharing(components: DataFrame, draws: list[float], max_k: int | None = None, points: int = 20) -> DataFrame:
    """(k, expected): expected number of sequences shared by exactly k of the samples, over a mixture of log pgen by Gauss-Hermite quadrature."""
    max_k = max_k or min(len(draws), 500)
    x, wx = np.polynomial.hermite.hermgauss(points)
    d, total = np.asarray(draws, dtype=float), np.zeros(max_k)
    for c in components.collect():  # one row a walk length
        for xi, wi in zip(x, wx):
            lp = min(c["mean"] + math.sqrt(2) * c["std"] * xi, 0.0)
            # a sequence of probability p stands for 1/p of them in the mass
            total += c["weight"] * wi / math.sqrt(math.pi) * math.exp(-lp) * sharing_pmf(math.exp(lp), d, max_k)
    return components.sparkSession.createDataFrame([(k + 1, float(v)) for k, v in enumerate(total)], "k int, expected double")


def saturation(rows: DataFrame, variant: str = "aap", every: int = 1000) -> DataFrame:
    """(n_seqs, n_nodes, n_edges): distinct nodes and edges after every so many sequences and at the end, in the order of idx (from 1, gapless).

    First occurrences are a minimum per node and edge; the curve is a running total over as many rows as it has points.
    """
    lab = labelled(rows.select("idx", "seq"), variant)
    node = lab.select("idx", F.explode("labels").alias("x")).groupBy("x").agg(F.min("idx").alias("f")).select("f", F.lit(1).alias("nn"), F.lit(0).alias("ne"))
    edge = transitions(lab, "idx").groupBy("src", "dst").agg(F.min("idx").alias("f")).select("f", F.lit(0).alias("nn"), F.lit(1).alias("ne"))
    n = rows.agg(F.max("idx").alias("n")).scalar()
    at = F.least(F.ceil(F.col("f") / every) * every, n).cast("bigint")
    new = node.unionAll(edge).groupBy(at.alias("n_seqs")).agg(F.sum("nn").alias("nn"), F.sum("ne").alias("ne"))
    points = rows.select(F.least(F.ceil(F.col("idx") / every) * every, n).cast("bigint").alias("n_seqs")).distinct()
    curve = points.join(new, "n_seqs", "left").na.fill(0, ["nn", "ne"])
    both = running_total(running_total(curve, "n_seqs", "nn", "n_nodes"), "n_seqs", "ne", "n_edges")
    return both.select("n_seqs", "n_nodes", "n_edges")


def k_diversity(seqs: DataFrame, k: int, variant: str = "aap", draws: int = 100, seed: int = 12345) -> DataFrame:
    """One row: mean, std, ci_low and ci_high of the distinct tokens in k sequences drawn without replacement, over that many draws.

    A draw keeps the k rows of least hash with the draw's number, which is local top-k and a merge per draw; fewer rows than k are all taken.
    """
    src = cut(seqs.select("seq").filter("seq is not null").withColumn("rid", F.monotonically_increasing_id()))
    dealt = src.select("rid", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw")).withColumn("h", F.xxhash64("rid", "draw", F.lit(seed)))
    # threshold first: a hash below twice the wanted share almost surely holds the k least, the exact rank follows on those few
    n = src.count()
    share = min(1.0, (k + 10 * math.sqrt(k) + 20) / max(n, 1))
    near = dealt if share >= 1.0 else dealt.filter(F.col("h") < int(-(2**63) + share * 2**64))
    picked = near.withColumn("r", F.row_number().over(Window.partitionBy("draw").orderBy("h", "rid"))).filter(F.col("r") <= k)
    toks = labelled(src, variant).select("rid", F.explode(F.array_distinct("toks")).alias("tok"))
    per = picked.join(toks, "rid").groupBy("draw").agg(F.count_distinct("tok").alias("d"))
    s = per.agg(F.avg("d").alias("mean"), F.stddev_pop("d").alias("std"), F.count(F.lit(1)).alias("n"))
    half = 1.96 * F.col("std") / F.sqrt("n")
    return s.select("mean", "std", (F.col("mean") - half).alias("ci_low"), (F.col("mean") + half).alias("ci_high"))
