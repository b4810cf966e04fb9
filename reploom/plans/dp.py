"""Linear dynamic programming from the root to the sinks of a model.

Every quantity asked for is a jet: for a pair (q, order) the transported values are sums over paths of p^q (ln p)^j, j up to order. One pass
carries all jets. Models of at most MAX_LOCAL edges, a checked bound, are swept as arrays on the driver; larger ones by a frontier of nodes
that is joined with the edges step by step. Walks of different length that meet in a node are summed, so no order of nodes is needed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reploom.plans.model import Model, ModelError
from reploom.session import cut

MAX_LOCAL = 4_000_000
MAX_STEPS = 128  # fixed value: longest walk
Spec = tuple[float, int]
_CYCLIC = "a walk is longer than the limit: the model is cyclic"


class TooLargeError(ModelError):
    """A model above the bound of a local sweep."""


@dataclass
class LocalGraph:
    """A model's edges as arrays, nodes numbered in label order, edges in order of (src, dst)."""

    labels: list[str]
    toks: list[str]
    src: np.ndarray
    dst: np.ndarray
    cnt: np.ndarray
    w: np.ndarray
    sink: np.ndarray
    root: int

    @classmethod
    def of(cls, model: Model, limit: int = MAX_LOCAL) -> LocalGraph:
        """Collect a model; an error beyond limit edges, before any is collected. Labels come once a batch, edges as numbers."""
        edges = model.edges.select("src", "dst", "tok", F.col("cnt").cast("bigint"), "w")
        if edges.count() > limit:
            raise TooLargeError(f"more than {limit} edges do not fit a local sweep")
        batches = edges.mapInArrow(_packed, "labels array<string>, toks array<string>, src binary, dst binary, cnt binary, w binary").toArrow().to_pylist()
        seen: dict[str, str] = {}
        for b in batches:
            seen.update((x, t) for x, t in zip(b["labels"], b["toks"]) if t is not None or x not in seen)
        labels = sorted(seen)
        at = {x: i for i, x in enumerate(labels)}
        numbers = [np.array([at[x] for x in b.pop("labels")], dtype=np.int64) for b in batches]
        src, dst = (_joined([k[np.frombuffer(b.pop(c), dtype=np.int32)] for k, b in zip(numbers, batches)], np.int64) for c in ("src", "dst"))
        order = np.lexsort((dst, src))
        src, dst = src[order], dst[order]
        cnt, w = (_joined([np.frombuffer(b.pop(c), dtype=t) for b in batches], t)[order] for c, t in (("cnt", np.int64), ("w", np.float64)))
        toks = [seen[x] or "" for x in labels]
        if model.variant == "flashback":
            sink = np.ones(len(labels), dtype=bool)
            sink[src] = False
        else:
            sink = np.array([t.endswith("$") for t in toks], dtype=bool)
        root = at.get(model.root, -1)
        if root >= 0:
            toks[root] = "@" if model.variant != "flashback" else model.root
        return cls(labels, toks, src, dst, cnt, w, sink, root)

    @classmethod
    def within(cls, model: Model, graph: LocalGraph | None = None, limit: int = MAX_LOCAL) -> LocalGraph | None:
        """The graph given or collected; None for a model above the limit, which goes the distributed way."""
        try:
            return graph or cls.of(model, limit)
        except TooLargeError:
            return None

    def acyclic(self) -> bool:
        """Whether nodes without predecessors can be peeled off until none are left."""
        left, indeg = len(self.labels), np.bincount(self.dst, minlength=len(self.labels))
        ready = np.flatnonzero(indeg == 0)
        starts = self.starts()
        while len(ready):
            left -= len(ready)
            out = self.dst[_ranges(starts, ready)]
            np.subtract.at(indeg, out, 1)
            ready = np.unique(out[indeg[out] == 0])
        return left == 0

    def starts(self) -> np.ndarray:
        """Where the edges of each node begin."""
        return np.searchsorted(self.src, np.arange(len(self.labels) + 1))

    def steps(self) -> Iterator[np.ndarray]:
        """The edges that walks of one length more can take, step by step until every walk has ended."""
        if self.root < 0:
            return
        starts, nodes = self.starts(), np.array([self.root])
        for _ in range(MAX_STEPS):
            nodes = nodes[~self.sink[nodes]]
            e = _ranges(starts, nodes)
            if not len(e):
                return
            yield e
            nodes = np.unique(self.dst[e])
        if (~self.sink[nodes]).any():
            raise ModelError(_CYCLIC)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a batch of edges: its labels with the tokens of those that are targets, and the columns as bytes, nodes by their place among the labels."""
    for b in batches:
        both, n = pa.concat_arrays([b.column(0), b.column(1)]).dictionary_encode(), b.num_rows
        at = both.indices.to_numpy().astype(np.int32)
        toks = np.full(len(both.dictionary), None, dtype=object)
        toks[at[n:]] = b.column(2).to_numpy(zero_copy_only=False)
        raw = (at[:n], at[n:], b.column(3).to_numpy(), b.column(4).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array([both.dictionary.to_pylist()], pa.list_(pa.string())), pa.array([toks.tolist()], pa.list_(pa.string())), *[pa.array([x.tobytes()], pa.binary()) for x in raw]], names=["labels", "toks", "src", "dst", "cnt", "w"])


def _joined(parts: list[np.ndarray], dtype) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, dtype=dtype)


def _ranges(starts: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """The concatenated edge numbers of some nodes."""
    first, n = starts[nodes], starts[nodes + 1] - starts[nodes]
    if not n.sum():
        return np.zeros(0, dtype=np.int64)
    return np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())


def _mix(order: int) -> list[tuple[int, int, int]]:
    """(to, from, binomial) terms of a jet's transport."""
    return [(j, i, comb(j, i)) for j in range(order + 1) for i in range(j + 1)]


def jets(model: Model, specs: list[Spec], graph: LocalGraph | None = None, limit: int = MAX_LOCAL) -> dict[Spec, list[float]]:
    """For each (q, order): sums over all complete paths of p^q (ln p)^j for j = 0..order. No path gives zeros."""
    g, specs = LocalGraph.within(model, graph, limit), list(dict.fromkeys(specs))
    if g is None:
        return _frontier(model, specs)
    n, lw = len(g.labels), np.log(g.w)
    out = {s: [0.0] * (s[1] + 1) for s in specs}
    if g.root < 0:
        return out
    value = {s: np.zeros((s[1] + 1, n)) for s in specs}
    for s in specs:
        value[s][0, g.root] = 1.0
    for e in g.steps():
        s_, d_, l_ = g.src[e], g.dst[e], lw[e]
        for spec in specs:
            q, order = spec
            v, f = value[spec], g.w[e] ** q
            nxt = np.zeros_like(v)
            with np.errstate(over="ignore", invalid="ignore"):
                for j, i, c in _mix(order):
                    nxt[j] += np.bincount(d_, c * f * l_ ** (j - i) * v[i, s_], minlength=n)
                for j in range(order + 1):
                    out[spec][j] += float(nxt[j, g.sink].sum())
            nxt[:, g.sink] = 0.0
            value[spec] = nxt
    return out


def walk(model: Model, start: dict[str, object], moved: dict[str, Column], combine: Callable[[DataFrame], DataFrame], schema: str) -> Iterator[DataFrame]:
    """The distributed pass: states (node, schema) joined with the edges (w, lw) step by step; yields the states that reached a sink.

    moved gives the state's columns after an edge, combine brings states that meet in a node together.
    """
    edges = cut(model.edges.select("src", "dst", "w", F.log("w").alias("lw")))
    sinks = cut(model.sinks().withColumnRenamed("node", "end"))
    state = model.spark.createDataFrame([(model.root, *start.values())], f"node string, {schema}")
    for _ in range(MAX_STEPS):
        j = state.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), *[c.alias(k) for k, c in moved.items()])
        state = cut(combine(j))
        yield state.join(sinks, F.col("node") == F.col("end"), "left_semi")
        state = state.join(sinks, F.col("node") == F.col("end"), "left_anti")
        if state.isEmpty():
            return
    raise ModelError(_CYCLIC)


def _frontier(model: Model, specs: list[Spec]) -> dict[Spec, list[float]]:
    """jets by joins: one column a transported value, one small row of absorbed sums a step."""
    names = {(k, j): f"v{k}_{j}" for k, s in enumerate(specs) for j in range(s[1] + 1)}
    moved = {
        names[k, j]: F.pow("w", F.lit(q)) * sum((F.lit(float(comb(j, i))) * F.pow("lw", F.lit(j - i)) * F.col(names[k, i]) for i in range(j + 1)), F.lit(0.0))
        for k, (q, order) in enumerate(specs) for j in range(order + 1)
    }
    out = {s: [0.0] * (s[1] + 1) for s in specs}
    summed = lambda df: df.groupBy("node").agg(*[F.sum(c).alias(c) for c in names.values()])
    for done in walk(model, {c: float(j == 0) for (_, j), c in names.items()}, moved, summed, ", ".join(f"{c} double" for c in names.values())):
        row = done.agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in names.values()]).first()
        for (k, j), c in names.items():
            out[specs[k]][j] += row[c]
    return out


def sweep(g: LocalGraph, start, edge, absorb, empty):
    """Generic forward pass for what is no array: state objects per node, combined by `empty`; used for histograms."""
    frontier = {g.root: start} if g.root >= 0 else {}
    starts = g.starts().tolist()
    for _ in range(MAX_STEPS):
        nxt: dict[int, object] = {}
        for node, value in frontier.items():
            for i in range(starts[node], starts[node + 1]):
                d = int(g.dst[i])
                moved = edge(value, i)
                if g.sink[d]:
                    absorb(d, moved)
                else:
                    nxt[d] = moved if d not in nxt else empty(nxt[d], moved)
        if not nxt:
            return
        frontier = nxt
    raise ModelError(_CYCLIC)


def path_count(model: Model, graph: LocalGraph | None = None) -> int:
    """Number of complete paths: exact up to MAX_LOCAL edges, to double precision beyond."""
    g = LocalGraph.within(model, graph)
    if g is None:
        return int(_frontier(model, [(0.0, 0)])[0.0, 0][0])
    total, v = 0, np.zeros(len(g.labels), dtype=object)
    if len(v):
        v[g.root] = 1
    for e in g.steps():
        nxt = np.zeros(len(g.labels), dtype=object)
        np.add.at(nxt, g.dst[e], v[g.src[e]])
        total += sum(nxt[g.sink].tolist())
        nxt[g.sink] = 0
        v = nxt
    return total


def extremes(model: Model, graph: LocalGraph | None = None) -> tuple[float, float]:
    """(least, greatest) log probability of a complete path; nan without any."""
    g = LocalGraph.within(model, graph)
    low, high = np.inf, -np.inf
    if g is None:
        best = lambda df: df.groupBy("node").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        for done in walk(model, {"lo": 0.0, "hi": 0.0}, {"lo": F.col("lo") + F.col("lw"), "hi": F.col("hi") + F.col("lw")}, best, "lo double, hi double"):
            row = done.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).first()
            if row["lo"] is not None:
                low, high = min(low, row["lo"]), max(high, row["hi"])
    else:
        lw, n = np.log(g.w), len(g.labels)
        lo, hi = np.zeros(n), np.zeros(n)
        for e in g.steps():
            nlo, nhi = np.full(n, np.inf), np.full(n, -np.inf)
            np.minimum.at(nlo, g.dst[e], lo[g.src[e]] + lw[e])
            np.maximum.at(nhi, g.dst[e], hi[g.src[e]] + lw[e])
            if g.sink.any():
                low, high = min(low, nlo[g.sink].min()), max(high, nhi[g.sink].max())
            lo, hi = nlo, nhi
    return (float(low), float(high)) if np.isfinite(low) else (float("nan"), float("nan"))


def by_length(model: Model, specs: list[Spec], size: Callable[[str], int], size_col: Callable[[Column], Column], graph: LocalGraph | None = None) -> dict[int, dict[Spec, list[float]]]:
    """jets of the complete paths of each length, counted in characters that their nodes emit; two forms of the same size function."""
    g = LocalGraph.within(model, graph)
    names = {(k, j): f"v{k}_{j}" for k, s in enumerate(specs) for j in range(s[1] + 1)}
    out: dict[int, np.ndarray] = {}

    def add(rows) -> None:
        for n, *v in rows:
            out[int(n)] = out.get(int(n), np.zeros(len(names))) + np.array(v, dtype=float)

    def transported(row, w, lw) -> dict:
        """Columns of a frame, or of a DataFrame, after an edge."""
        return {names[k, j]: w**q * sum(comb(j, i) * lw ** (j - i) * row(names[k, i]) for i in range(j + 1)) for k, (q, order) in enumerate(specs) for j in range(order + 1)}

    start = {c: float(j == 0) for (_, j), c in names.items()}
    if g is None:
        moved = {"len": F.col("len") + size_col(F.col("dst")), **transported(F.col, F.col("w"), F.col("lw"))}
        summed = lambda df: df.groupBy("node", "len").agg(*[F.sum(c).alias(c) for c in names.values()])
        for done in walk(model, {"len": 0, **start}, moved, summed, "len int, " + ", ".join(f"{c} double" for c in names.values())):
            add(tuple(r) for r in done.groupBy("len").agg(*[F.sum(c) for c in names.values()]).collect())  # one row a length
    elif len(g.labels):
        sizes, lw = np.array([size(x) for x in g.labels], dtype=np.int64), np.log(g.w)
        state = pd.DataFrame({"node": [g.root], "len": [0], **{c: [v] for c, v in start.items()}})
        for e in g.steps():
            j = state.merge(pd.DataFrame({"node": g.src[e], "dst": g.dst[e], "w": g.w[e], "lw": lw[e]}), on="node")
            j = pd.DataFrame({"node": j["dst"], "len": j["len"] + sizes[j["dst"]], **transported(lambda c, j=j: j[c], j["w"], j["lw"])})
            j = j.groupby(["node", "len"], sort=False, as_index=False).sum()
            ended = g.sink[j["node"].to_numpy()]
            add(j[ended].groupby("len")[list(names.values())].sum().itertuples(name=None))
            state = j[~ended]
    return {n: {s: [float(v[list(names).index((k, j))]) for j in range(s[1] + 1)] for k, s in enumerate(specs)} for n, v in sorted(out.items())}


def least_mass(model: Model, graph: LocalGraph | None = None) -> float:
    """Probability that a path is one of the least probable ones, equal ones together."""
    g = LocalGraph.within(model, graph)
    if g is None:
        low, _ = extremes(model)
        two = lambda df: df.withColumn("_b", F.min("lo").over(Window.partitionBy("node"))).filter(F.col("lo") <= F.col("_b") + 1e-9).groupBy("node").agg(F.min("lo").alias("lo"), F.sum("m").alias("m"))
        moved = {"lo": F.col("lo") + F.col("lw"), "m": F.col("m") * F.col("w")}
        return float(sum(done.filter(F.col("lo") <= F.lit(low + 1e-9)).agg(F.coalesce(F.sum("m"), F.lit(0.0))).first()[0] for done in walk(model, {"lo": 0.0, "m": 1.0}, moved, two, "lo double, m double")))
    n, lw, best, total = len(g.labels), np.log(g.w), np.inf, 0.0
    lo, mass = np.full(n, np.inf), np.zeros(n)
    if n:
        lo[g.root], mass[g.root] = 0.0, 1.0
    for e in g.steps():
        s_, d_, cand = g.src[e], g.dst[e], lo[g.src[e]] + lw[e]
        nlo = np.full(n, np.inf)
        np.minimum.at(nlo, d_, cand)
        hit = cand <= nlo[d_] + 1e-9
        m = np.bincount(d_[hit], mass[s_[hit]] * g.w[e][hit], minlength=n)
        ended = g.sink & np.isfinite(nlo)
        if ended.any():
            low = nlo[ended].min()
            here = m[ended & (nlo <= low + 1e-9)].sum()
            best, total = (low, here) if low < best - 1e-9 else (best, total + here) if low <= best + 1e-9 else (best, total)
        lo, mass = nlo, m
    return float(total)


def k_best(model: Model, k: int, most: bool = True, graph: LocalGraph | None = None) -> list[tuple[float, list[str]]]:
    """The k most (or least) probable complete paths as (log probability, node labels); ties by labels.

    A backward pass gives the best way on from every node. With it a beginning is worth its best completion, and as different beginnings of one
    length have different completions, only the k best of them, with the paths that have ended, go on: no path is lost.
    """
    g, sign = LocalGraph.within(model, graph), 1.0 if most else -1.0
    root, onward = (model.root, _onward_joined(model, sign)) if g is None else (g.root, _onward(g, sign))
    live, done = [(0.0, 0.0, (root,), g is not None and g.root < 0)], []
    for _ in range(MAX_STEPS):
        live = [x for x in live if not x[3]]
        if not live:
            # nodes are numbered in label order, so paths of numbers compare as their labels do
            best = sorted(((lp, p) for lp, _, p, _ in done), key=lambda x: (-sign * x[0], x[1]))
            return [(lp, list(p) if g is None else [g.labels[n] for n in p]) for lp, p in best]
        at: dict[object, list[tuple[float, tuple]]] = {}
        for lp, _, path, _ in live:
            at.setdefault(path[-1], []).append((lp, path))
        new = [(lp + lw, rest, (*path, d), end) for s, d, lw, rest, end in onward(list(at)) for lp, path in at[s]]
        live = sorted([*done, *new], key=lambda x: (-round(sign * (x[0] + x[1]), 10), x[2]))[:k]
        done = [x for x in live if x[3]]
    raise ModelError(_CYCLIC)


Onward = Callable[[list], list[tuple[object, object, float, float, bool]]]


def _onward(g: LocalGraph, sign: float) -> Onward:
    """The steps (from, to, log weight, that of the best way on from there, whether it ends there) of some nodes; the way on by one pass back from the sinks."""
    lw, starts, rest = np.log(g.w), g.starts(), np.where(g.sink, 0.0, -np.inf)
    for nodes in reversed([np.unique(g.src[e]) for e in g.steps()]):
        e = _ranges(starts, nodes)
        rest[nodes] = -np.inf
        np.maximum.at(rest, g.src[e], sign * lw[e] + rest[g.dst[e]])

    def steps(nodes: list[int]) -> list:
        e = _ranges(starts, np.array(nodes))
        e = e[np.isfinite(rest[g.dst[e]])]
        d = g.dst[e]
        return list(zip(g.src[e].tolist(), d.tolist(), lw[e].tolist(), (sign * rest[d]).tolist(), g.sink[d].tolist()))

    return steps


def _onward_joined(model: Model, sign: float) -> Onward:
    """_onward by joins: the way on from each node until a round changes none of them."""
    sinks = cut(model.sinks())
    edges = cut(model.edges.select("src", "dst", F.log("w").alias("lw")).join(sinks.withColumnRenamed("node", "src"), "src", "left_anti"))
    ends = sinks.select("node", F.lit(0.0).alias("rest"))
    rest, before = ends, None
    for _ in range(MAX_STEPS + 1):
        back = edges.join(rest, F.col("dst") == F.col("node")).groupBy(F.col("src").alias("node")).agg(F.max(F.lit(sign) * F.col("lw") + F.col("rest")).alias("rest"))
        rest = cut(back.unionAll(ends))
        now = tuple(rest.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("node", "rest"))).first())
        if now == before:
            break
        before = now
    else:
        raise ModelError(_CYCLIC)
    known = cut(edges.join(rest, F.col("dst") == F.col("node")).join(sinks.select(F.col("node").alias("end")), F.col("dst") == F.col("end"), "left").select("src", "dst", "lw", (F.lit(sign) * F.col("rest")).alias("rest"), F.col("end").isNotNull().alias("is_end")))
    return lambda nodes: [tuple(r) for r in known.filter(F.col("src").isin(nodes)).collect()]  # the edges of at most k nodes
