"""What a model's distribution looks like: diversity, power sums, moments, range; exact for Markov models."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reploom.plans import dp
from reploom.plans.model import Model

#: Orders of a diversity curve.
CURVE = (0.0, 0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0, 5.0, 7.0, 10.0)


def hill(sums: float, alpha: float) -> float:
    """Hill number of order alpha from a power sum."""
    return sums ** (1.0 / (1.0 - alpha)) if sums > 0 else 0.0


def power_sums(model: Model, alphas: list[float], graph: dp.LocalGraph | None = None) -> DataFrame:
    """(alpha, power_sum): sums of p^alpha over all sequences; order 1 is 1 by definition."""
    got = dp.jets(model, [(a, 0) for a in alphas], graph)
    return model.spark.createDataFrame([(float(a), 1.0 if a == 1 else got[a, 0][0]) for a in alphas], "alpha double, power_sum double")


def hill_curve(model: Model, orders=CURVE, graph: dp.LocalGraph | None = None) -> DataFrame:
    """(alpha, hill): one transport pass for all orders; order 1 is exp of the entropy."""
    specs = [(a, 0) if a != 1 else (1.0, 1) for a in orders]
    got = dp.jets(model, specs, graph)
    rows = [(float(a), math.exp(-got[s][1]) if a == 1 else hill(got[s][0], a)) for a, s in zip(orders, specs)]
    return model.spark.createDataFrame(rows, "alpha double, hill double")


def moments(model: Model, graph: dp.LocalGraph | None = None) -> dict[str, float]:
    """Mean, variance, standard deviation, skewness and excess kurtosis of log p under the model itself, and the mass absorbed."""
    m = dp.jets(model, [(1.0, 4)], graph)[1.0, 4]
    mass = m[0]
    if mass <= 0:
        return dict.fromkeys(("mean", "variance", "std", "skewness", "excess_kurtosis"), float("nan")) | {"mass": 0.0}
    r = [x / mass for x in m]
    var = max(r[2] - r[1] ** 2, 0.0)
    c3 = r[3] - 3 * r[1] * r[2] + 2 * r[1] ** 3
    c4 = r[4] - 4 * r[1] * r[3] + 6 * r[1] ** 2 * r[2] - 3 * r[1] ** 4
    ok = var > 1e-300
    return {"mean": r[1], "variance": var, "std": math.sqrt(var), "skewness": c3 / var**1.5 if ok else 0.0, "excess_kurtosis": c4 / var**2 - 3 if ok else 0.0, "mass": mass}


def entropy(model: Model, graph: dp.LocalGraph | None = None) -> DataFrame:
    """One row: entropy in nats and bits, effective_diversity, absorbed mass, is_proper; one pass."""
    got = dp.jets(model, [(1.0, 1)], graph)[1.0, 1]
    h = -got[1]
    return model.spark.createDataFrame([(h, h / math.log(2), math.exp(h), got[0], abs(got[0] - 1) < 1e-6)], "entropy_nats double, entropy_bits double, effective_diversity double, absorbed double, is_proper boolean")


def support(model: Model, graph: dp.LocalGraph | None = None) -> DataFrame:
    """One row: path_count and its log10."""
    n = dp.path_count(model, graph)
    return model.spark.createDataFrame([(float(n), math.log10(n) if n else float("-inf"))], "path_count double, log10_paths double")


def dynamic_range(model: Model, graph: dp.LocalGraph | None = None) -> DataFrame:
    """One row: least and greatest log pgen, their distance in nats and in orders of ten, and the diversity of order infinity."""
    low, high = dp.extremes(model, graph)
    return model.spark.createDataFrame([(low, high, high - low, (high - low) / math.log(10), math.exp(-high))], "min_log_pgen double, max_log_pgen double, dynamic_range double, dynamic_range_orders double, d_infinity double")


def profile(model: Model, graph: dp.LocalGraph | None = None) -> DataFrame:
    """One row of entropy, support and dynamic_range together, with the uniformity: effective diversity over the number of paths."""
    g = dp.LocalGraph.within(model, graph)
    e, s, r = entropy(model, g).first(), support(model, g).first(), dynamic_range(model, g).first()
    row = (s["path_count"], *e[:3], e["effective_diversity"] / s["path_count"] if s["path_count"] else 0.0, *r[:3], e["absorbed"], e["is_proper"])
    return model.spark.createDataFrame(
        [row], "path_count double, entropy_nats double, entropy_bits double, effective_diversity double, uniformity double, min_log_pgen double, max_log_pgen double, dynamic_range double, absorbed double, is_proper boolean"
    )


def sampled_profile(sims: DataFrame) -> DataFrame:
    """One row for a model that is only sampled: n_walks, path_count (mean of 1/p), entropy, diversity, least and greatest log pgen met, their range, d_infinity.

    The path count is a lower bound in practice: sequences too rare to be drawn do not add to the mean.
    """
    x = F.col("log_prob")
    one = sims.agg(F.count(F.lit(1)).alias("n_walks"), F.avg(F.exp(-x)).alias("path_count"), (-F.avg(x)).alias("entropy_nats"), F.stddev_samp(x).alias("sd"), F.min(x).alias("min_log_pgen"), F.max(x).alias("max_log_pgen"))
    spread = F.col("max_log_pgen") - F.col("min_log_pgen")
    return one.select(
        "n_walks", "path_count", "entropy_nats", (F.col("sd") / F.sqrt("n_walks")).alias("entropy_error"), F.exp("entropy_nats").alias("effective_diversity"), F.try_divide(F.exp("entropy_nats"), F.col("path_count")).alias("uniformity"),
        "min_log_pgen", "max_log_pgen", spread.alias("dynamic_range"), (spread / math.log(10)).alias("dynamic_range_orders"), F.exp(-F.col("max_log_pgen")).alias("d_infinity"),
    )


def moments_row(model: Model, graph: dp.LocalGraph | None = None) -> DataFrame:
    m = moments(model, graph)
    return model.spark.createDataFrame([tuple(float(v) for v in m.values())], ", ".join(f"{k} double" for k in m))


def top_sequences(model: Model, k: int, most: bool = True, graph: dp.LocalGraph | None = None) -> DataFrame:
    """(rank, seq, log_pgen) of the k most or least probable sequences of a run-peeling model."""
    from reploom.functions import tokens as tk

    rows = [(i + 1, path, lp) for i, (lp, path) in enumerate(dp.k_best(model, k, most, graph))]
    df = model.spark.createDataFrame(rows, "rank int, labels array<string>, log_pgen double")
    return df.select("rank", tk.flashback_reverse(F.col("labels")).alias("seq"), "log_pgen")


def monte_carlo(sims: DataFrame, orders=CURVE) -> DataFrame:
    """(alpha, hill) from simulated log probabilities: the mean of p^(alpha-1) estimates the power sum. For history-dependent models."""
    terms = [F.avg(F.exp(F.lit(a - 1.0) * F.col("log_prob"))).alias(f"a{i}") if a != 1 else F.avg("log_prob").alias(f"a{i}") for i, a in enumerate(orders)]
    one = sims.agg(*terms)
    rows = F.explode(F.array(*[F.struct(F.lit(float(a)).alias("alpha"), (F.exp(-F.col(f"a{i}")) if a == 1 else F.pow(F.col(f"a{i}"), F.lit(1.0 / (1.0 - a)))).alias("hill")) for i, a in enumerate(orders)])).alias("r")
    return one.select(rows).select("r.alpha", "r.hill")


def mixture(sims: DataFrame, least: int = 5) -> DataFrame:
    """(n_tokens, weight, mean, std): log pgen as a mixture of one normal for each walk length with at least that many samples."""
    by = sims.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n"), F.avg("log_prob").alias("mean"), F.sqrt(F.greatest(F.var_pop("log_prob"), F.lit(1e-12))).alias("std")).filter(F.col("n") >= least)
    return by.select("n_tokens", (F.col("n") / by.agg(F.sum("n").alias("n")).scalar()).alias("weight"), "mean", "std")


def mixture_curve(components: DataFrame, points: list[float]) -> DataFrame:
    """(x, pdf, cdf) of the mixture at some points; zeros without components."""
    rows = components.collect()  # one row a walk length
    x = np.asarray(points, dtype=float)
    pdf, cdf = np.zeros(len(x)), np.zeros(len(x))
    for r in rows:
        z = (x - r["mean"]) / r["std"]
        pdf += r["weight"] * np.exp(-0.5 * z**2) / (r["std"] * math.sqrt(2 * math.pi))
        cdf += r["weight"] * 0.5 * np.array([math.erfc(-v / math.sqrt(2)) for v in z])
    return components.sparkSession.createDataFrame([(float(a), float(b), float(c)) for a, b, c in zip(x, pdf, cdf)], "x double, pdf double, cdf double")


def mixture_sample(components: DataFrame, n: int, seed: int = 42, chunk: int = 65_536) -> DataFrame:
    """(i, log_pgen): n draws from the mixture, dealt in chunks with a generator each."""
    rows = sorted((r["n_tokens"], r["weight"], r["mean"], r["std"]) for r in components.collect())  # one row a walk length
    if not rows:
        return components.sparkSession.createDataFrame([], "i bigint, log_pgen double")
    _, weight, mean, std = map(np.array, zip(*rows))

    def run(batches):
        for pdf in batches:
            for c in pdf["id"]:
                rng, size = np.random.default_rng([seed, int(c)]), min(chunk, n - int(c) * chunk)
                at = rng.choice(len(weight), size, p=weight / weight.sum())
                yield pd.DataFrame({"i": int(c) * chunk + np.arange(size), "log_pgen": rng.normal(mean[at], std[at])})

    k = -(-n // chunk)
    return components.sparkSession.range(0, k, 1, max(1, min(k, 100_000))).mapInPandas(run, "i bigint, log_pgen double")
