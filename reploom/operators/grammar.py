"""Boundary-indexed grammars: non-terminals named by the first and last character of a span, rules by run peeling.

Rules come from one aggregation over derivation steps. The non-terminals number at most the square of the alphabet, so linear systems over them are
solved on the driver from the rules, whose number is checked.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reploom.functions import tokens as tk
from reploom.plans.model import FLUSH, LOG_EPS, ModelError, count_lengths, spread
from reploom.session import cut

NT = ["is_start", "a", "z"]
RULE = ["kind", "a_run", "z_run", "dst_a", "dst_z"]
MAX_RULES = 4_000_000


@dataclass(frozen=True)
class Grammar:
    """rules (NT, RULE, cnt, w) and lengths; backoff is none or good_turing."""

    rules: DataFrame
    lengths: DataFrame
    smoothing: float = 0.0
    backoff: str = "good_turing"


def _weight(mode: str) -> Column:
    a = F.col("abundance")
    return {"none": F.lit(1.0), "linear": a.cast("double"), "log": F.log1p(a.cast("double"))}[mode]


def steps(rep: DataFrame, *keep: str) -> DataFrame:
    """(keep, i, NT, RULE): one row a derivation step; empty sequences have none."""
    return spread(rep.filter("seq <> ''")).select(*keep, F.posexplode(tk.grammar_steps_arrow(F.col("seq"))).alias("i", "s")).select(*keep, "i", "s.*")


def count_rules(rep: DataFrame, abundance_mode: str) -> DataFrame:
    """(NT, RULE, cnt): weighted counts of (seq, abundance), counted in Arrow batches first; the rules number far fewer than the steps."""
    schema = pa.schema([("is_start", pa.bool_()), ("a", pa.string()), ("z", pa.string()), ("kind", pa.string()), ("a_run", pa.int32()), ("z_run", pa.int32()), ("dst_a", pa.string()), ("dst_z", pa.string()), ("cnt", pa.float64())])

    def rows(counts: dict[tuple, float]) -> pa.RecordBatch:
        cols = [*zip(*counts)] if counts else [()] * 8
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([*cols, list(counts.values())], schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple, float] = {}
        for batch in batches:
            for s, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for rule in tk.grammar_rules(s):
                    counts[rule] = counts.get(rule, 0.0) + n
            if len(counts) >= FLUSH:
                yield rows(counts)
                counts = {}
        yield rows(counts)

    src = spread(rep.filter("seq <> '' and abundance is not null").select("seq", _weight(abundance_mode).alias("wt")))
    keys = "is_start boolean, a string, z string, kind string, a_run int, z_run int, dst_a string, dst_z string"
    return src.mapInArrow(run, f"{keys}, cnt double").groupBy(*NT, *RULE).agg(F.sum("cnt").alias("cnt"))


def _weighted(counts: DataFrame, smoothing: float) -> DataFrame:
    w = Window.partitionBy(*NT)
    return counts.withColumn("w", (F.col("cnt") + F.lit(smoothing)) / (F.sum("cnt").over(w) + F.lit(smoothing) * F.count(F.lit(1)).over(w)))


def fit(rep: DataFrame, abundance_mode: str = "linear", smoothing: float = 0.0, backoff: str = "good_turing") -> Grammar:
    """Grammar of (seq, abundance). abundance_mode none, linear or log weighs a sequence 1, its abundance or log(1 + abundance)."""
    if abundance_mode not in ("none", "linear", "log") or smoothing < 0:
        raise ModelError("unknown abundance mode or negative smoothing")
    counts = count_rules(rep, abundance_mode)
    return Grammar(cut(_weighted(counts, smoothing)), count_lengths(rep), smoothing, backoff)


def nonterminals(g: Grammar) -> DataFrame:
    """(NT, n_rules, total, unseen): unseen is the Good-Turing mass, rules counted at most once over the total, at most a half."""
    agg = g.rules.groupBy(*NT).agg(F.count(F.lit(1)).alias("n_rules"), F.sum("cnt").alias("total"), F.count_if(F.col("cnt") <= 1.0).alias("n_once"))
    return agg.select(*NT, "n_rules", "total", F.least(F.when(F.col("total") > 0, F.col("n_once") / F.col("total")).otherwise(F.lit(0.5)), F.lit(0.5)).alias("unseen"))


def backoff_marginal(g: Grammar) -> DataFrame:
    """(RULE, a, z, marginal): share of a rule's form, wherever it occurs, in all counts."""
    forms = g.rules.groupBy("a", "z", *RULE).agg(F.sum("cnt").alias("c"))
    return forms.select("a", "z", *RULE, (F.col("c") / g.rules.agg(F.sum("cnt").alias("c")).scalar()).alias("marginal"))


def log_pgen(g: Grammar, queries: DataFrame, backoff: str | None = None) -> DataFrame:
    """(seq, log_pgen) of distinct queries: sum of log rule weights; with good_turing a seen rule has (1 - unseen) w, an unseen one unseen times its marginal.

    An unseen non-terminal, an unseen rule without backoff and the empty string score the floor.
    """
    mode = backoff or g.backoff
    q = queries.select("seq").filter("seq is not null").distinct()
    s = steps(q, "seq").join(g.rules.select(*NT, *RULE, "w"), [*NT, *RULE], "left")
    if mode == "none":
        p = F.col("w")
    else:
        s = s.join(nonterminals(g).select(*NT, "unseen"), NT, "left").join(backoff_marginal(g), ["a", "z", *RULE], "left")
        p = F.when(F.col("w").isNotNull(), (1 - F.col("unseen")) * F.col("w")).otherwise(F.col("unseen") * F.col("marginal"))
    agg = s.withColumn("p", p).groupBy("seq").agg(F.sum(F.when(F.col("p") > 0, F.log("p"))).alias("lp"), F.min(F.coalesce(F.col("p") > 0, F.lit(False))).alias("ok"))
    return q.join(agg.filter("ok").select("seq", "lp"), "seq", "left").select("seq", F.coalesce("lp", F.lit(LOG_EPS)).alias("log_pgen"))


def top_rules(g: Grammar, k: int = 20, by: str = "w") -> DataFrame:
    """The k rules of highest weight (by='w') or count (by='cnt'); ties by rule."""
    return g.rules.orderBy(F.desc(by), *NT, *RULE).limit(k)


def rules_at(g: Grammar, a: str, z: str, is_start: bool = False) -> DataFrame:
    return g.rules.filter((F.col("a") == a) & (F.col("z") == z) & (F.col("is_start") == is_start))


def sentinel_rule_weights(g: Grammar) -> DataFrame:
    """(first, last, w): distribution of the outer characters of a string, the rules at the start."""
    return g.rules.filter("is_start and kind = 'internal'").select(F.col("dst_a").alias("first"), F.col("dst_z").alias("last"), "w")


def counts(g: Grammar) -> DataFrame:
    """One row: n_nonterminals, n_rules, n_internal, n_leaf."""
    return g.rules.agg(F.count_distinct(*NT).alias("n_nonterminals"), F.count(F.lit(1)).alias("n_rules"), F.count_if(F.col("kind") == "internal").alias("n_internal"), F.count_if(F.col("kind") != "internal").alias("n_leaf"))


class Solver:
    """The rules as arrays, for what needs the whole system at once."""

    def __init__(self, g: Grammar):
        pdf = g.rules.limit(MAX_RULES + 1).toArrow().to_pandas()
        if len(pdf) > MAX_RULES:
            raise ModelError(f"more than {MAX_RULES} rules")
        pdf = pdf.sort_values([*NT, *RULE], ignore_index=True)
        names = sorted({*zip(pdf["is_start"], pdf["a"], pdf["z"])}, key=lambda x: (not x[0], x[1], x[2]))
        self.at = {n: i for i, n in enumerate(names)}
        self.names = names
        self.n = len(names)
        self.nt = np.array([self.at[x] for x in zip(pdf["is_start"], pdf["a"], pdf["z"])], dtype=int)
        self.kind = pdf["kind"].to_numpy()
        self.dst = np.array([self.at.get((False, a, z), -1) if k == "internal" else -2 for k, a, z in zip(self.kind, pdf["dst_a"], pdf["dst_z"])], dtype=int)
        self.w = pdf["w"].to_numpy(dtype=float)
        self.a_run, self.z_run = pdf["a_run"].to_numpy(dtype=int), pdf["z_run"].to_numpy(dtype=int)
        start = np.array([names[i][0] for i in self.nt], dtype=bool) if self.n else np.zeros(0, dtype=bool)
        self.eats = np.where(start, 0, self.a_run + self.z_run)
        self.start = self.at.get((True, tk.START, tk.END), 0)
        self.inner = self.dst >= 0

    def transfer(self, alpha: float = 1.0) -> np.ndarray:
        t = np.zeros((self.n, self.n))
        np.add.at(t, (self.nt[self.inner], self.dst[self.inner]), self.w[self.inner] ** alpha)
        return t

    def spectral_radius(self, alpha: float = 1.0) -> float:
        """Greatest eigenvalue by power iteration; below 1 the grammar is consistent."""
        t, v, rho = self.transfer(alpha), np.full(self.n, 1.0 / max(self.n, 1)), 0.0
        for _ in range(400):
            x = t @ v + v  # shifted, so that periodic systems settle
            norm = x.sum()
            if norm <= 0:
                return 0.0
            x /= norm
            if abs(norm - 1 - rho) < 1e-13:
                return float(norm - 1)
            rho, v = norm - 1, x
        return float(rho)

    def entropy(self) -> float:
        h = np.zeros(self.n)
        np.add.at(h, self.nt, -self.w * np.log(self.w))
        return float(np.linalg.solve(np.eye(self.n) - self.transfer(), h)[self.start])

    def power_sum(self, alpha: float) -> float:
        """Sum of p^alpha over derivations: 1 for order 1, infinite for 0 and where the weighted system diverges."""
        if alpha == 1:
            return 1.0
        if alpha == 0 or self.spectral_radius(alpha) >= 1 - 1e-9:
            return math.inf
        leaf = np.zeros(self.n)
        np.add.at(leaf, self.nt[self.dst == -2], self.w[self.dst == -2] ** alpha)
        v = float(np.linalg.solve(np.eye(self.n) - self.transfer(alpha), leaf)[self.start])
        return v if v > 0 else math.inf

    def hill(self, alpha: float) -> float:
        if alpha == 1:
            return math.exp(self.entropy())
        s = self.power_sum(alpha)
        return math.inf if math.isinf(s) and alpha < 1 else s ** (1 / (1 - alpha))

    def by_length(self, longest: int, counted: bool = False) -> np.ndarray:
        """Probability (or number, if counted) of derivations by output length 0..longest."""
        z = np.zeros((longest + 1, self.n))
        weight = np.ones_like(self.w) if counted else self.w
        others = np.flatnonzero(self.nt != self.start)
        for length in range(longest + 1):
            leaf = others[(self.dst[others] == -2) & (self.eats[others] == length)]
            np.add.at(z[length], self.nt[leaf], weight[leaf])
            go = others[self.inner[others] & (self.eats[others] <= length)]
            np.add.at(z[length], self.nt[go], weight[go] * z[length - self.eats[go], self.dst[go]])
            s = np.flatnonzero((self.nt == self.start) & self.inner)
            z[length, self.start] = (weight[s] * z[length, self.dst[s]]).sum()
        return z[:, self.start]

    def extremes(self, longest: int = 30) -> tuple[float, float]:
        """(least, greatest) log probability of a string of at most longest characters; nan without any."""
        lo, hi = np.full((longest + 1, self.n), np.inf), np.full((longest + 1, self.n), -np.inf)
        lw, others, found = np.log(self.w), np.flatnonzero(self.nt != self.start), []
        for length in range(longest + 1):
            leaf = others[(self.dst[others] == -2) & (self.eats[others] == length)]
            go = others[self.inner[others] & (self.eats[others] <= length)]
            for t, at in ((lo, np.minimum), (hi, np.maximum)):
                at.at(t[length], self.nt[leaf], lw[leaf])
                at.at(t[length], self.nt[go], lw[go] + t[length - self.eats[go], self.dst[go]])
            s = np.flatnonzero((self.nt == self.start) & self.inner)
            found.append(((lw[s] + lo[length, self.dst[s]]).min(initial=np.inf), (lw[s] + hi[length, self.dst[s]]).max(initial=-np.inf)))
        low, high = min(f[0] for f in found), max(f[1] for f in found)
        return (float(low), float(high)) if np.isfinite(low) else (math.nan, math.nan)

    def best(self, k: int, most: bool = True, longest: int = 30) -> list[tuple[str, float]]:
        """The k most or least probable strings of at most longest characters, ties by string."""
        key = (lambda x: (-x[0], x[1])) if most else (lambda x: (x[0], x[1]))
        table: list[dict[int, list[tuple[float, str]]]] = [{} for _ in range(longest + 1)]
        rules: dict[int, list[int]] = {}
        for r, n in enumerate(self.nt):
            rules.setdefault(int(n), []).append(r)
        for length in range(longest + 1):
            for n, own in rules.items():
                if n == self.start:
                    continue
                _, a, z = self.names[n]
                found = []
                for r in own:
                    lw, inner = math.log(self.w[r]), length - int(self.eats[r])
                    front, back = a * int(self.a_run[r]), z * int(self.z_run[r])
                    if self.dst[r] == -2 and inner == 0:
                        found.append((lw, front + back))
                    elif self.dst[r] >= 0 and inner >= 0:
                        found += [(lw + lp, front + s + back) for lp, s in table[inner].get(int(self.dst[r]), ())]
                if found:
                    table[length][n] = sorted(found, key=key)[:k]
        done = [(math.log(self.w[r]) + lp, s) for length in range(longest + 1) for r in rules.get(self.start, ()) if self.dst[r] >= 0 for lp, s in table[length].get(int(self.dst[r]), ())]
        return [(s, lp) for lp, s in sorted(done, key=key)[:k]]


def dynamic_range(g: Grammar, longest: int = 30) -> DataFrame:
    """One row: least and greatest log pgen among strings of at most longest characters, and their distance."""
    low, high = Solver(g).extremes(longest)
    return g.rules.sparkSession.createDataFrame([(low, high, high - low)], "min_log_pgen double, max_log_pgen double, dynamic_range double")


def length_table(g: Grammar, longest: int) -> DataFrame:
    """(length, prob, n_derivations) for output lengths 0..longest."""
    s = Solver(g)
    p, n = s.by_length(longest), s.by_length(longest, counted=True)
    return g.rules.sparkSession.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(p, n))], "length int, prob double, n_derivations double")


def profile(g: Grammar, orders=(0.5, 2.0, 3.0)) -> DataFrame:
    """(measure, value): spectral radius, consistency, entropy, diversity and Hill numbers."""
    s = Solver(g)
    rows = [("spectral_radius", s.spectral_radius()), ("consistent", float(s.spectral_radius() < 1)), ("entropy_nats", s.entropy()), ("effective_diversity", math.exp(s.entropy())), *[(f"hill_{a:g}", s.hill(a)) for a in orders]]
    return g.rules.sparkSession.createDataFrame([(m, float(v)) for m, v in rows], "measure string, value double")


def top_sequences(g: Grammar, k: int, most: bool = True, longest: int = 30) -> DataFrame:
    """(rank, seq, log_pgen)."""
    return g.rules.sparkSession.createDataFrame([(i + 1, s, float(lp)) for i, (s, lp) in enumerate(Solver(g).best(k, most, longest))], "rank int, seq string, log_pgen double")


def posterior(g: Grammar, rep: DataFrame, kappa: float, abundance_mode: str = "linear") -> Grammar:
    """Dirichlet update per non-terminal on the prior's rules; steps that the prior lacks count towards nothing. kappa + n = 0 keeps the prior."""
    if kappa < 0:
        raise ModelError("kappa is negative")
    new = count_rules(rep, abundance_mode).withColumnRenamed("cnt", "c")
    e = g.rules.join(new, [*NT, *RULE], "left").na.fill(0.0, ["c"])
    n = F.sum("c").over(Window.partitionBy(*NT))
    e = e.withColumn("n", n)
    k = F.lit(float(kappa))
    post = e.select(*NT, *RULE, F.when(F.col("n") + k > 0, k * F.col("w") + F.col("c")).otherwise(F.col("w")).alias("cnt"))
    return replace(g, rules=_weighted(post, 0.0), smoothing=0.0)


def without(g: Grammar, rep: DataFrame, abundance_mode: str = "linear") -> Grammar:
    """Counts less those of the sequences; rules without any left are dropped. A start without rules is an error."""
    gone = count_rules(rep, abundance_mode).withColumnRenamed("cnt", "c")
    left = g.rules.join(gone, [*NT, *RULE], "left").select(*NT, *RULE, (F.col("cnt") - F.coalesce("c", F.lit(0.0))).alias("cnt")).filter("cnt > 1e-9")
    left = cut(left)
    if left.filter("is_start").isEmpty():
        raise ModelError("nothing is left at the start")
    return replace(g, rules=_weighted(left, g.smoothing))


def save(g: Grammar, path: str) -> None:
    g.rules.write.mode("overwrite").parquet(f"{path}/rules")
    g.lengths.write.mode("overwrite").parquet(f"{path}/lengths")
    meta = g.rules.sparkSession.createDataFrame([(g.smoothing, g.backoff)], "smoothing double, backoff string")
    meta.write.mode("overwrite").parquet(f"{path}/meta")


def load(spark, path: str) -> Grammar:
    m = spark.read.parquet(f"{path}/meta").first()
    return Grammar(spark.read.parquet(f"{path}/rules"), spark.read.parquet(f"{path}/lengths"), m["smoothing"], m["backoff"])
