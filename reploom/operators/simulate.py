"""Sampling from a model: walks in Arrow batches over a broadcast model.

Work is dealt in numbered chunks, each with its own generator seeded by (seed, chunk), so results do not depend on the cluster. A model is
broadcast only below a checked number of edges. Beyond it the walks of a run-peeling model are joined with its edges step by step, with numbers drawn
from (seed, walk, step); that of an LZ model, whose valid edges depend on the walk, is refused.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reploom.functions import tokens as tk
from reploom.plans.dp import MAX_STEPS, LocalGraph
from reploom.plans.model import LOG_EPS, ConvergenceError, Model, ModelError
from reploom.session import cut

CHUNK = 512
#: Walks that may leak one after another before drawing again is given up.
MAX_REDRAWS = 10_000
#: Edges that a worker holds as an adjacency list.
MAX_WALKER = 2_000_000
SCHEMA = "i bigint, seq string, log_prob double, n_tokens int"
ABSORPTION_WALKS = 4096
SCALE_DRAWS = 200_000  # fixed value: draws of a calibration
MAX_BLOCKED = 64  # fixed value: edges that one walk may block while stepping back


class Walker:
    """Adjacency of a model in plain lists; walks one sequence at a time."""

    def __init__(self, g: LocalGraph, variant: str):
        self.variant, self.root, self.toks, self.sink = variant, g.root, g.toks, g.sink.tolist()
        self.out: list[list[tuple[int, float]]] = [[] for _ in g.labels]
        for s, d, w in zip(g.src.tolist(), g.dst.tolist(), g.w.tolist()):
            self.out[s].append((d, w))
        self.cum = [np.cumsum([w for _, w in o]).tolist() for o in self.out]
        self.labels = g.labels

    def valid(self, node: int, emitted: set[str]) -> list[tuple[int, float]]:
        keep = []
        for d, w in self.out[node]:
            t = self.toks[d]
            if t not in emitted and (len(t) == 1 or t[:-1] in emitted):
                keep.append((d, w))
        return keep

    def walk_within(self, rng, allowed: set[tuple[int, int]]) -> tuple[list[int], float] | None:
        """A walk over allowed edges that steps back from dead ends and blocks the edge into them; None where that fails.

        The probability is that of the kept edges among the allowed valid ones.
        """
        path, steps, blocked = [self.root], [], set()
        emitted = [self.toks[self.root]]
        while len(path) <= MAX_STEPS:
            node = path[-1]
            if self.sink[node]:
                return path, sum(steps)
            open_ = [(d, w) for d, w in (self.out[node] if self.variant == "flashback" else self.valid(node, set(emitted))) if (node, d) in allowed]
            free = [(d, w) for d, w in open_ if (node, d) not in blocked]
            if free:
                d, w = free[min(bisect_right(cum := np.cumsum([w for _, w in free]).tolist(), rng.random() * cum[-1]), len(free) - 1)]
                steps.append(math.log(w / sum(x for _, x in open_)))
                path.append(d)
                emitted.append(self.toks[d])
            elif len(path) == 1 or len(blocked) >= MAX_BLOCKED:
                return None
            else:
                blocked.add((path[-2], node))
                path.pop(), steps.pop(), emitted.pop()
        return None

    def walk(self, rng, allowed=None) -> tuple[list[int], float] | None:
        """(nodes, log probability) or None for a walk that leaks: no way on, or too long."""
        node, path, lp = self.root, [self.root], 0.0
        markov = self.variant == "flashback"
        emitted = {self.toks[node]}
        for _ in range(MAX_STEPS):
            if self.sink[node]:
                return path, lp
            if markov and allowed is None:
                cum = self.cum[node]
                if not cum:
                    return None
                at = min(bisect_right(cum, rng.random() * cum[-1]), len(cum) - 1)
                nxt, w = self.out[node][at]
                z = cum[-1]
            else:
                open_ = self.out[node] if markov else self.valid(node, emitted)
                if allowed is not None:
                    open_ = [(d, w) for d, w in open_ if (node, d) in allowed]
                z = sum(w for _, w in open_)
                if z <= 0:
                    return None
                u = rng.random() * z
                for nxt, w in open_:
                    u -= w
                    if u <= 0:
                        break
            lp += math.log(w / z)
            node = nxt
            path.append(node)
            if not markov:
                emitted.add(self.toks[node])
        return None

    def text(self, path: list[int]) -> str:
        if self.variant == "flashback":
            s = ""
            for n in reversed(path):
                sym, split = self.labels[n][: self.labels[n].rindex("{")].rsplit("_", 1)
                s = sym[: int(split)] + s + sym[int(split) :]
        else:
            s = "".join(self.toks[n] for n in path)
        return s[1:-1]

    def exact_absorption(self, max_paths: int = 200_000) -> float:
        """Mass of the walks that reach a sink, by enumeration; refused above max_paths."""
        total, stack, seen = 0.0, [(self.root, frozenset({self.toks[self.root]}), 1.0)], 0
        while stack:
            node, emitted, p = stack.pop()
            if self.sink[node]:
                total += p
                continue
            seen += 1
            if seen > max_paths:
                raise ModelError("too many walks to enumerate")
            open_ = self.valid(node, emitted)
            z = sum(w for _, w in open_)
            stack += [(d, emitted | {self.toks[d]}, p * w / z) for d, w in open_]
        return total


def _chunks(model: Model, n: int) -> DataFrame:
    k = -(-n // CHUNK)
    return model.spark.range(0, k, 1, max(1, min(k, 100_000)))


def absorption(model: Model, how: str = "mc", seed: int = 11, graph: LocalGraph | None = None) -> float:
    """Probability that a raw walk ends in a sink: mc from ABSORPTION_WALKS walks, dealt in chunks, exact by enumeration, none is 1. Markov models give 1."""
    if how == "none" or model.variant == "flashback":
        return 1.0
    walker = Walker(graph or LocalGraph.of(model, MAX_WALKER), model.variant)
    return walker.exact_absorption() if how == "exact" else _absorbed(model, model.spark.sparkContext.broadcast(walker), seed)


def _absorbed(model: Model, shared, seed: int) -> float:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n = 0
            for c in pdf["id"]:
                rng = np.random.default_rng([seed, int(c)])
                n += sum(shared.value.walk(rng) is not None for _ in range(min(CHUNK, ABSORPTION_WALKS - int(c) * CHUNK)))
            yield pd.DataFrame({"n": [n]})

    return (_chunks(model, ABSORPTION_WALKS).mapInPandas(run, "n bigint").agg(F.sum("n")).first()[0] or 0) / ABSORPTION_WALKS


def simulate(model: Model, n: int, seed: int = 42, normalise: str = "mc", graph: LocalGraph | None = None) -> DataFrame:
    """(i, seq, log_prob, n_tokens) for i in 0..n-1. LZ walks that leak are drawn again and log_prob is divided by the absorption.

    A model whose walks leak MAX_REDRAWS times in a row, or of which none is absorbed, is an error. Run-peeling models above MAX_WALKER edges are walked by joins.
    """
    if model.variant == "naive":
        raise ModelError("the naive variant may be cyclic and is not sampled")
    if model.variant == "flashback" and (graph := LocalGraph.within(model, graph, MAX_WALKER)) is None:
        return _walk_joined(model, n, seed)
    g = graph or LocalGraph.of(model, MAX_WALKER)
    if g.root < 0:
        raise ModelError("the model is empty")
    shared = model.spark.sparkContext.broadcast(Walker(g, model.variant))
    log_a = 0.0
    if model.variant != "flashback" and normalise != "none":
        share = _absorbed(model, shared, 11) if normalise == "mc" else shared.value.exact_absorption()
        if share <= 0:
            raise ConvergenceError("no walk reaches an end")
        log_a = math.log(share)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = shared.value
        for pdf in batches:
            for c in pdf["id"]:
                rng, rows = np.random.default_rng([seed, int(c)]), []
                for i in range(int(c) * CHUNK, min(n, (int(c) + 1) * CHUNK)):
                    got, tries = w.walk(rng), 0
                    while got is None:
                        if (tries := tries + 1) > MAX_REDRAWS:
                            raise ConvergenceError(f"{MAX_REDRAWS} walks in a row reached no end")
                        got = w.walk(rng)
                    rows.append((i, w.text(got[0]), got[1] - log_a, len(got[0])))
                yield pd.DataFrame(rows, columns=["i", "seq", "log_prob", "n_tokens"])

    return _chunks(model, n).mapInPandas(run, SCHEMA)


def _guide(model: Model) -> DataFrame:
    """(src, place, dst, lo, hi, lw, fan): the edges of a node by their share lo..hi of the unit interval, in label order.

    A node with n edges has n places; an edge has a row for each place that its share touches, less than 2 n rows a node, so a draw meets two rows on
    average whatever the node. fan is the number of places of dst, null where walks end.
    """
    by, upto = Window.partitionBy("src"), Window.partitionBy("src").orderBy("dst")
    e = model.edges.select("src", "dst", "w").withColumn("to", F.sum("w").over(upto.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    e = e.withColumn("z", F.max("to").over(by)).withColumn("n", F.count(F.lit(1)).over(by)).withColumn("from", F.coalesce(F.lag("to").over(upto), F.lit(0.0)))
    e = e.select("src", "dst", "n", (F.col("from") / F.col("z")).alias("lo"), (F.col("to") / F.col("z")).alias("hi"), F.log(F.col("w") / F.col("z")).alias("lw"))
    fans = model.edges.groupBy(F.col("src").alias("dst")).agg(F.count(F.lit(1)).alias("fan"))
    places = F.explode(F.sequence(F.floor(F.col("lo") * F.col("n")), F.least(F.floor(F.col("hi") * F.col("n")), F.col("n") - 1)))
    return e.join(fans, "dst", "left").select("src", places.alias("place"), "dst", "lo", "hi", "lw", "fan")


def _walk_joined(model: Model, n: int, seed: int) -> DataFrame:
    """simulate for a run-peeling model of any size: all walks go on together, each step one join; the edges are dealt to the executors once."""
    spark = model.spark
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    fan = model.edges.filter(F.col("src") == model.root).count()
    if not fan:
        raise ModelError("the model is empty")
    guide = _guide(model).repartition(parts, "src", "place").persist()
    state, done = spark.range(n).select(F.col("id").alias("i"), F.lit(model.root).alias("node"), F.lit(fan).cast("bigint").alias("fan"), F.lit(0.0).alias("log_prob"), F.array(F.lit(model.root)).alias("path")), []
    for t in range(MAX_STEPS):
        u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "i", F.lit(t)), 11) * F.lit(2.0**-53)
        drawn = state.select("i", "node", "log_prob", "path", u.alias("u"), F.least(F.floor(u * F.col("fan")), F.col("fan") - 1).alias("at")).hint("shuffle_hash")
        hit = drawn.join(guide, (F.col("node") == F.col("src")) & (F.col("at") == F.col("place")) & (F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi")))
        state = cut(hit.select("i", F.col("dst").alias("node"), "fan", (F.col("log_prob") + F.col("lw")).alias("log_prob"), F.array_append("path", F.col("dst")).alias("path")))
        done.append(state.filter("fan is null"))
        state = state.filter("fan is not null")
        if state.isEmpty():
            break
    else:
        raise ConvergenceError("a walk is longer than the limit: the model is cyclic")
    guide.unpersist()
    return reduce(DataFrame.unionAll, done).coalesce(parts).select("i", tk.flashback_reverse(F.col("path")).alias("seq"), "log_prob", F.size("path").alias("n_tokens"))


def simulate_genes(model: Model, n: int, seed: int = 42, v_gene: str | None = None, j_gene: str | None = None, attempts: int = 10) -> DataFrame:
    """(i, seq, log_prob, n_tokens, v_gene, j_gene): walks over edges that carry both genes, the pair drawn from the joint unless given.

    log_prob is conditional on the genes. A walk without a way on steps back and does not take that edge again, up to MAX_BLOCKED edges. A draw without
    success in that many attempts gives the empty string and the floor.
    """
    from reploom.operators.genes import joint

    pairs = joint(model)
    for col, value in (("v_gene", v_gene), ("j_gene", j_gene)):
        if value is not None:
            pairs = pairs.filter(F.col(col) == value)
    table = pairs.orderBy("v_gene", "j_gene").toArrow().to_pandas()  # as many rows as known gene pairs
    if not len(table):
        raise ModelError("no such genes")
    g = LocalGraph.of(model, MAX_WALKER)
    at = {x: i for i, x in enumerate(g.labels)}
    sets: dict[tuple[str, str], set[tuple[int, int]]] = {}
    rows = model.edge_genes.select("src", "dst", "kind", "gene").limit(8_000_001).toArrow().to_pandas()
    if len(rows) > 8_000_000:
        raise ModelError("too many annotated edges to broadcast")
    for s, d, k, gene in rows.itertuples(index=False, name=None):
        sets.setdefault((k, gene), set()).add((at[s], at[d]))
    prob = (table["cnt"] / table["cnt"].sum()).to_numpy()
    names = list(zip(table["v_gene"], table["j_gene"]))
    shared = model.spark.sparkContext.broadcast((Walker(g, model.variant), sets, names, prob))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, sets, names, prob = shared.value
        for pdf in batches:
            for c in pdf["id"]:
                rng, out = np.random.default_rng([seed, int(c)]), []
                for i in range(int(c) * CHUNK, min(n, (int(c) + 1) * CHUNK)):
                    got = None
                    for _ in range(attempts):
                        v, j = names[int(rng.choice(len(names), p=prob))]
                        got = w.walk_within(rng, sets.get(("v", v), set()) & sets.get(("j", j), set()))
                        if got:
                            break
                    out.append((i, w.text(got[0]), got[1], len(got[0]), v, j) if got else (i, "", LOG_EPS, 0, v, j))
                yield pd.DataFrame(out, columns=["i", "seq", "log_prob", "n_tokens", "v_gene", "j_gene"])

    return _chunks(model, n).mapInPandas(run, SCHEMA + ", v_gene string, j_gene string")


def simulate_grammar(g, n: int, seed: int = 42) -> DataFrame:
    """(i, seq, log_prob, n_tokens) from a grammar, top down; n_tokens is the depth of the derivation."""
    from reploom.operators.grammar import Solver

    s = Solver(g)
    by_nt: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for nt in range(s.n):
        r = np.flatnonzero(s.nt == nt)
        by_nt[nt] = (r, np.cumsum(s.w[r]))
    spark = g.rules.sparkSession
    shared = spark.sparkContext.broadcast((s, by_nt))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s, by_nt = shared.value
        for pdf in batches:
            for c in pdf["id"]:
                rng, out = np.random.default_rng([seed, int(c)]), []
                for i in range(int(c) * CHUNK, min(n, (int(c) + 1) * CHUNK)):
                    nt, front, back, lp, depth = s.start, [], [], 0.0, 0
                    while nt >= 0:
                        rules, cum = by_nt[nt]
                        r = int(rules[min(np.searchsorted(cum, rng.random() * cum[-1], side="right"), len(rules) - 1)])
                        _, a, z = s.names[nt]
                        front.append(a * int(s.a_run[r]))
                        back.append(z * int(s.z_run[r]))
                        lp += math.log(s.w[r])
                        depth, nt = depth + 1, int(s.dst[r])
                    out.append((i, ("".join(front) + "".join(reversed(back)))[1:-1], lp, depth))
                yield pd.DataFrame(out, columns=["i", "seq", "log_prob", "n_tokens"])

    k = -(-n // CHUNK)
    return spark.range(0, k, 1, max(1, min(k, 100_000))).mapInPandas(run, SCHEMA)


def mass_profile(sims: DataFrame, longest: int = 30, squared: bool = True) -> DataFrame:
    """(length, mass): share of simulated sequences by length, lengths above the last bin in it. squared weighs each sample by its probability again."""
    w = F.exp("log_prob") if squared else F.lit(1.0)
    by = sims.groupBy(F.least(F.length("seq"), F.lit(longest)).alias("length")).agg(F.sum(w).alias("m"))
    return by.select("length", (F.col("m") / by.agg(F.sum("m").alias("m")).scalar()).alias("mass"))


def calibrate_scale(sims: DataFrame, min_count: int = 50, accuracy: int = 100_000) -> DataFrame:
    """(length, n, median, iqr) of -log p by length of simulated sequences, plus length null for all; lengths below min_count are left to that.

    Quartiles come from mergeable summaries: off by at most 1 / accuracy of the ranks, exact up to about that many draws.
    """
    q = F.percentile_approx(-F.col("log_prob"), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), accuracy).alias("q")
    by = sims.groupBy(F.length("seq").alias("length")).agg(F.count(F.lit(1)).alias("n"), q).filter(F.col("n") >= min_count)
    every = sims.agg(F.count(F.lit(1)).alias("n"), q).select(F.lit(None).cast("int").alias("length"), "n", "q")
    return by.unionByName(every).select("length", "n", F.col("q")[1].alias("median"), (F.col("q")[2] - F.col("q")[0]).alias("iqr"))


def save_calibration(calibration: DataFrame, path: str) -> None:
    """One JSON line a length; the line without a length is that of all."""
    calibration.coalesce(1).write.mode("overwrite").json(path)  # as many rows as lengths


def load_calibration(spark, path: str) -> DataFrame:
    return spark.read.schema("length int, n bigint, median double, iqr double").json(path)


def scale_scores(scores: DataFrame, calibration: DataFrame) -> DataFrame:
    """(seq, log_pgen, scale): (-log p - median) / iqr of the sequence's length, of all where the length or its spread is missing."""
    total = calibration.filter("length is null")
    med, iqr = total.select("median").scalar(), total.select("iqr").scalar()
    j = scores.withColumn("l", F.length("seq")).join(calibration.filter("length is not null").withColumnRenamed("length", "l"), "l", "left")
    spread = F.when(F.col("iqr") > 0, F.col("iqr")).when(iqr > 0, iqr).otherwise(F.lit(1.0))
    return j.select("seq", "log_pgen", ((-F.col("log_pgen") - F.coalesce("median", med)) / spread).alias("scale"))
