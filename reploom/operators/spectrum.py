"""The p-sequence spectrum of a Markov model: transforms, cumulants, atoms, histogram, saddlepoint, occupancy of samples."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reploom.plans import dp
from reploom.plans.model import Model, ModelError


def mellin(model: Model, qs: list[float], order: int = 0, graph: dp.LocalGraph | None = None) -> DataFrame:
    """(q, j, value): derivatives of order j of M(q), the sum of p^q, for j = 0..order."""
    got = dp.jets(model, [(q, order) for q in qs], graph)
    return model.spark.createDataFrame([(float(q), j, float(v)) for (q, _), vs in got.items() for j, v in enumerate(vs)], "q double, j int, value double")


def cumulants(model: Model, q: float = 1.0, graph: dp.LocalGraph | None = None) -> list[float]:
    """The first four cumulants of log p under weights p^q, from normalised moments."""
    m = dp.jets(model, [(q, 4)], graph)[q, 4]
    r = [x / m[0] for x in m]
    k2 = r[2] - r[1] ** 2
    k3 = r[3] - 3 * r[1] * r[2] + 2 * r[1] ** 3
    k4 = r[4] - 4 * r[1] * r[3] - 3 * r[2] ** 2 + 12 * r[1] ** 2 * r[2] - 6 * r[1] ** 4
    return [r[1], k2, k3, k4]


def cgf(model: Model, points: list[float], graph: dp.LocalGraph | None = None) -> DataFrame:
    """(t, cgf): log of the mean of exp(t S) for the surprisal S = -ln p of a generated sequence, from M(1 - t) / M(1)."""
    qs = sorted({1.0, *(1.0 - float(t) for t in points)})
    got = {q: v[0] for (q, _), v in dp.jets(model, [(q, 0) for q in qs], graph).items()}
    rows = [(float(t), math.log(got[1.0 - float(t)] / got[1.0]) if got[1.0] > 0 else float("nan")) for t in points]
    return model.spark.createDataFrame(rows, "t double, cgf double")


def surprisal_moments(model: Model, graph: dp.LocalGraph | None = None) -> DataFrame:
    """One row: cumulants k1 to k4 of the surprisal -ln p, and mean, variance, std, skewness and excess_kurtosis from them."""
    k1, k2, k3, k4 = cumulants(model, 1.0, graph)
    ok = k2 > 1e-300
    row = (-k1, k2, -k3, k4, -k1, k2, math.sqrt(max(k2, 0.0)), -k3 / k2**1.5 if ok else 0.0, k4 / k2**2 if ok else 0.0)
    return model.spark.createDataFrame([row], ", ".join(f"{c} double" for c in ("k1", "k2", "k3", "k4", "mean", "variance", "std", "skewness", "excess_kurtosis")))


def _emitted(label: str) -> int:
    """Characters that a run-peeling node emits, end marks aside."""
    return 0 if label.startswith("@") else len(label[: label.rindex("_")])


def _emitted_col(label: Column) -> Column:
    return F.when(label.startswith("@"), F.lit(0)).otherwise(F.length(F.regexp_extract(label, r"(?s)^(.*)_\d+\{\d+\}$", 1)))


def length_derivatives(model: Model, q: float = 1.0, order: int = 4, graph: dp.LocalGraph | None = None) -> DataFrame:
    """(length, j, value): derivatives of order j = 0..order of the sum of p^q over the sequences of each length."""
    got = dp.by_length(model, [(float(q), order)], _emitted, _emitted_col, graph)
    return model.spark.createDataFrame([(n, j, v) for n, by in got.items() for j, v in enumerate(by[float(q), order])], "length int, j int, value double")


def length_profile(model: Model, graph: dp.LocalGraph | None = None) -> DataFrame:
    """(length, prob, n_sequences, mean, variance): mass, number and surprisal of the sequences by length; one sweep keyed by length."""
    rows = []
    for n, by in dp.by_length(model, [(1.0, 2), (0.0, 0)], _emitted, _emitted_col, graph).items():
        m = by[1.0, 2]
        rows.append((n, m[0], by[0.0, 0][0], -m[1] / m[0], max(m[2] / m[0] - (m[1] / m[0]) ** 2, 0.0)))
    return model.spark.createDataFrame(rows, "length int, prob double, n_sequences double, mean double, variance double")


def mass_by_length(model: Model, longest: int = 30, squared: bool = True, graph: dp.LocalGraph | None = None) -> DataFrame:
    """(length, mass): exact form of simulate.mass_profile, lengths above the last bin in it."""
    q, out = 2.0 if squared else 1.0, {}
    for n, by in dp.by_length(model, [(q, 0)], _emitted, _emitted_col, graph).items():
        out[min(n, longest)] = out.get(min(n, longest), 0.0) + by[q, 0][0]
    total = sum(out.values())
    return model.spark.createDataFrame([(n, v / total) for n, v in sorted(out.items())], "length int, mass double")


def atoms(model: Model, max_paths: int = 1_000_000) -> DataFrame:
    """(seq, log_pgen) of every sequence the model can produce, distributed by frontier joins; refused above max_paths."""
    from reploom.functions import tokens as tk

    if dp.jets(model, [(0.0, 0)])[0.0, 0][0] > max_paths + 0.5:
        raise ModelError(f"more than {max_paths} sequences")
    edges, sinks = model.edges.select("src", "dst", F.log("w").alias("lw")), model.sinks().withColumnRenamed("node", "end")
    from reploom.session import cut

    edges, sinks = cut(edges), cut(sinks)
    state = model.spark.createDataFrame([(model.root, [model.root], 0.0)], "node string, labels array<string>, log_pgen double")
    done = None
    for _ in range(dp.MAX_STEPS):
        state = state.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), F.array_append("labels", F.col("dst")).alias("labels"), (F.col("log_pgen") + F.col("lw")).alias("log_pgen"))
        state = cut(state)
        end = state.join(sinks, F.col("node") == F.col("end"), "left_semi")
        done = end if done is None else done.unionAll(end)
        state = state.join(sinks, F.col("node") == F.col("end"), "left_anti")
        if state.isEmpty():
            break
    seq = tk.flashback_reverse(F.col("labels")) if model.variant == "flashback" else F.array_join(F.transform("labels", lambda x: F.regexp_replace(x, r"_\d+$", "")), "")
    return done.select((seq if model.variant == "flashback" else F.substring(seq, F.lit(2), F.length(seq) - 2)).alias("seq"), "log_pgen")


def expected_richness(atom_rows: DataFrame, depths: list[float]) -> DataFrame:
    """(depth, richness): expected number of distinct sequences among depth draws."""
    terms = [F.sum(-F.expm1(F.lit(float(d)) * F.log1p(-F.least(F.exp("log_pgen"), F.lit(1 - 1e-15))))).alias(f"d{i}") for i, d in enumerate(depths)]
    rows = F.explode(F.array(*[F.struct(F.lit(float(d)).alias("depth"), F.col(f"d{i}").alias("richness")) for i, d in enumerate(depths)])).alias("r")
    return atom_rows.agg(*terms).select(rows).select("r.*")


def frequency_spectrum(atom_rows: DataFrame, n: int, max_count: int) -> DataFrame:
    """(count, expected): expected number of sequences drawn exactly count times among n."""
    p = F.least(F.exp("log_pgen"), F.lit(1 - 1e-15))
    terms = [F.sum(F.exp(F.lit(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)) + F.lit(k) * F.log(p) + F.lit(n - k) * F.log1p(-p))).alias(f"k{k}") for k in range(1, max_count + 1)]
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("count"), F.col(f"k{k}").alias("expected")) for k in range(1, max_count + 1)])).alias("r")
    return atom_rows.agg(*terms).select(rows).select("r.*")


def position(atom_rows: DataFrame, queries: DataFrame) -> DataFrame:
    """(seq, log_pgen, cdf_generated, cdf_counting) of queries in the support: mass and share of sequences no more probable. Queries outside are left out."""
    levels = atom_rows.groupBy(F.round("log_pgen", 9).alias("lp")).agg(F.sum(F.exp("log_pgen")).alias("mass"), F.count(F.lit(1)).alias("n"))
    from reploom.session import running_total

    both = running_total(running_total(levels, "lp", "mass", "cdf_mass"), "lp", "n", "cdf_n")
    total = atom_rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    hit = queries.select("seq").distinct().join(atom_rows, "seq")
    return hit.join(both.select("lp", "cdf_mass", "cdf_n"), F.round("log_pgen", 9) == F.col("lp")).select("seq", "log_pgen", F.col("cdf_mass").alias("cdf_generated"), (F.col("cdf_n") / total).alias("cdf_counting"))


def histogram(model: Model, bins: int = 512, measure: str = "generated", length: int | None = None, graph: dp.LocalGraph | None = None) -> DataFrame:
    """(bin, surprisal, weight): mass (generated) or number (counting) of sequences on a grid of -log p, of one length only if given.

    Each step splits its mass linearly between the two nearest grid points, so a sequence lies within steps * spacing of its place.
    """
    g = graph or dp.LocalGraph.of(model)
    low, _ = dp.extremes(model, g)
    depth = sum(1 for _ in g.steps())
    spacing = -low / max(1, bins - 1 - depth) if low < 0 else 1.0
    out = np.zeros(bins)
    lw = -np.log(g.w) / spacing
    size = [_emitted(x) if length is not None else 0 for x in g.labels]
    start = np.zeros(bins)
    start[0] = 1.0

    def edge(v, i):
        k, f, by = int(lw[i]), float(lw[i] - int(lw[i])), size[int(g.dst[i])]
        f0 = float(g.w[i]) if measure == "generated" else 1.0
        moved = {}
        for n, x in v.items():
            if length is not None and n + by > length:
                continue
            r = np.zeros(bins)
            r[k:] += f0 * (1 - f) * x[: bins - k]
            r[k + 1 :] += f0 * f * x[: bins - k - 1]
            moved[n + by] = r
        return moved

    def absorb(_d, v):
        out[:] += v.get(length or 0, 0.0)

    dp.sweep(g, {0: start}, edge, absorb, lambda a, b: {n: a.get(n, 0.0) + b.get(n, 0.0) for n in a.keys() | b.keys()})
    return model.spark.createDataFrame([(i, float(i * spacing), float(w)) for i, w in enumerate(out)], "bin int, surprisal double, weight double")


def _grid(hist: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """Surprisals, shares and total of a histogram, as many rows as bins."""
    pdf = hist.orderBy("bin").toPandas()
    w = pdf["weight"].to_numpy()
    return pdf["surprisal"].to_numpy(), w / w.sum() if w.sum() > 0 else w, float(w.sum())


def histogram_curve(hist: DataFrame, points: list[float]) -> DataFrame:
    """(x, cdf, pdf) of a histogram at surprisals x, linear between grid points; zeros for an empty one."""
    s, w, total = _grid(hist)
    x = np.asarray(points, dtype=float)
    step = s[1] - s[0] if len(s) > 1 else 0.0
    cdf = np.interp(x, s, np.cumsum(w), left=0.0, right=1.0) if total > 0 else np.zeros(len(x))
    pdf = np.interp(x, s, w / step, left=0.0, right=0.0) if total > 0 and step > 0 else np.zeros(len(x))
    return hist.sparkSession.createDataFrame([(float(a), float(b), float(c)) for a, b, c in zip(x, cdf, pdf)], "x double, cdf double, pdf double")


def histogram_quantiles(hist: DataFrame, probabilities: list[float]) -> DataFrame:
    """(probability, surprisal); a probability outside 0 to 1 is an error."""
    if any(not 0 <= p <= 1 for p in probabilities):
        raise ModelError("a probability has to be from 0 to 1")
    s, w, _ = _grid(hist)
    return hist.sparkSession.createDataFrame([(float(p), float(np.interp(p, np.cumsum(w), s))) for p in probabilities], "probability double, surprisal double")


#: Up to so many sequences the saddlepoint gives way to the exact ones.
FEW = 64


def saddlepoint(model: Model, log_p: list[float], graph: dp.LocalGraph | None = None) -> DataFrame:
    """(log_p, cdf, pdf): Lugannani-Rice approximation of the generated mass of sequences at most that probable, and the density of log p.

    Saddle points of all values asked for are found together by Newton steps inside a bracket. A model of at most FEW sequences is answered
    exactly, its density from a histogram. Below the least probable sequence the mass is 0, at it that of the least probable ones, from the most
    probable one on 1; outside this range the density is 0.
    """
    g = graph or dp.LocalGraph.of(model)
    low, high = dp.extremes(model, g)
    x = np.asarray(log_p, dtype=float)
    make = lambda cdf, pdf: model.spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in zip(x, cdf, pdf)], "log_p double, cdf double, pdf double")
    if dp.path_count(model, g) <= FEW:
        lp = np.array([v for v, _ in dp.k_best(model, FEW, graph=g)])
        density = {r["x"]: r["pdf"] for r in histogram_curve(histogram(model, 4096, graph=g), [-v for v in x]).collect()}
        return make([np.exp(lp[lp <= v + 1e-9]).sum() for v in x], [density[-v] for v in x])
    cdf, pdf = np.where(x < low, 0.0, 1.0), np.zeros(len(x))
    cdf[x == low] = dp.least_mass(model, g) if (x == low).any() else 0.0
    inside = np.flatnonzero((x > low) & (x < high))
    if not len(inside):
        return make(cdf, pdf)
    want = x[inside]

    def derivatives(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        got = dp.jets(model, [(1.0 + float(v), 2) for v in s], g)
        m = np.array([got[1.0 + float(v), 2] for v in s])
        with np.errstate(all="ignore"):
            k1 = m[:, 1] / m[:, 0]
            return np.log(m[:, 0]), k1, m[:, 2] / m[:, 0] - k1**2

    a, b, s = np.full(len(want), -40.0), np.full(len(want), 40.0), np.zeros(len(want))
    for _ in range(60):
        k, k1, k2 = derivatives(s)
        left = ~np.isfinite(k1) & (s < 0) | (k1 < want)  # sums that overflow lie far on the improbable side
        a, b = np.where(left, s, a), np.where(left, b, s)
        with np.errstate(all="ignore"):
            step = s - (k1 - want) / k2
        nxt = np.where(np.isfinite(step) & (step > a) & (step < b), step, (a + b) / 2)
        done = np.abs(nxt - s) < 1e-10
        s = nxt
        if done.all():
            break
    k, k1, k2 = derivatives(s)
    _, mean, var = derivatives(np.zeros(1))
    normal = lambda z: 0.5 * math.erfc(-z / math.sqrt(2))
    for i, at in enumerate(inside):
        w = math.copysign(math.sqrt(max(2 * (s[i] * want[i] - k[i]), 0.0)), s[i])
        u = s[i] * math.sqrt(max(k2[i], 1e-300))
        if abs(s[i]) < 1e-8 or abs(w) < 1e-10 or abs(u) < 1e-10:
            value = normal((want[i] - mean[0]) / math.sqrt(max(var[0], 1e-300)))
        else:
            value = normal(w) + math.exp(-w * w / 2) / math.sqrt(2 * math.pi) * (1 / w - 1 / u)
        cdf[at] = min(1.0, max(0.0, value))
        pdf[at] = math.exp(k[i] - s[i] * want[i]) / math.sqrt(2 * math.pi * k2[i]) if k2[i] > 0 else 0.0
    return make(cdf, pdf)
