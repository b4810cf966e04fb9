"""Fixed scaffold of a run-peeling model: residues of sequences placed in slots, with a latent token path.

A slot is (order, lane, offset): how deep a residue lies, whether in the front, the back or the centre, and its place in the run. Slots and their
token counts come from one aggregation over the model; sequences are aligned in Arrow batches over a broadcast of those counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reploom.functions import tokens as tk
from reploom.operators.structure import degrees
from reploom.plans.model import Model, ModelError, is_public

FLOOR = 1e-9
MAX_TOKENS = 2_000_000


def node_masses(model: Model) -> DataFrame:
    """(token, mass): the larger of incoming and outgoing count of each public node."""
    return degrees(model).filter(is_public(F.col("node"))).select(F.col("node").alias("token"), F.greatest("in_cnt", "out_cnt").alias("mass"))


def slot_counts(model: Model) -> DataFrame:
    """(ord, lane, offset, token, mass): the tokens seen at each slot. A last token fills the centre, others the front and the back from outside."""
    pattern = r"(?s)^(.*)_(\d+)\{(\d+)\}$"
    t = node_masses(model).filter("mass > 0").select("token", "mass", F.regexp_extract("token", pattern, 1).alias("sym"), F.regexp_extract("token", pattern, 2).cast("int").alias("split"), F.regexp_extract("token", pattern, 3).cast("int").alias("ord"))
    n = F.length("sym")
    front = F.transform(F.sequence(F.lit(0), F.when(F.col("split") == 0, n).otherwise(F.col("split")) - 1), lambda i: F.struct(F.when(F.col("split") == 0, "center").otherwise("front").alias("lane"), i.alias("offset")))
    back = F.when((F.col("split") > 0) & (n > F.col("split")), F.transform(F.sequence(F.lit(0), n - F.col("split") - 1), lambda i: F.struct(F.lit("back").alias("lane"), i.alias("offset")))).otherwise(F.array().cast("array<struct<lane:string,offset:int>>"))
    return t.filter("ord > 0").select("ord", "token", "mass", F.explode(F.concat(front, back)).alias("s")).select("ord", "s.lane", "s.offset", "token", "mass")


def slots(model: Model) -> DataFrame:
    """(ord, lane, offset, mass, n_tokens): the columns of the scaffold."""
    return slot_counts(model).groupBy("ord", "lane", "offset").agg(F.sum("mass").alias("mass"), F.count(F.lit(1)).alias("n_tokens"))


def residues(seqs: DataFrame) -> DataFrame:
    """(seq, ord, lane, offset, residue): every residue of each sequence in its slot."""
    p = seqs.filter("seq <> ''").select("seq", F.explode(tk.peel(F.col("seq"))).alias("t")).filter("t.ord > 0")
    chars = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    whole, lane = F.when(F.col("t.last"), F.concat("t.front", "t.back")).otherwise(F.col("t.front")), F.when(F.col("t.last"), "center").otherwise("front")
    front = F.transform(chars(whole), lambda c, i: F.struct(lane.alias("lane"), i.cast("int").alias("offset"), c.alias("residue")))
    back = F.when(~F.col("t.last"), F.transform(chars(F.reverse(F.col("t.back"))), lambda c, i: F.struct(F.lit("back").alias("lane"), i.cast("int").alias("offset"), c.alias("residue")))).otherwise(F.array().cast("array<struct<lane:string,offset:int,residue:string>>"))
    return p.select("seq", F.col("t.ord").alias("ord"), F.explode(F.concat(front, back)).alias("r")).select("seq", "ord", "r.lane", "r.offset", "r.residue")


def _symbols(token: str) -> tuple[str, int, int]:
    body, order = token[:-1].rsplit("{", 1)
    sym, split = body.rsplit("_", 1)
    return sym, int(split), int(order)


class Scaffold:
    """Slot token counts and neighbourhoods of a model, for alignment on executors."""

    def __init__(self, model: Model, neighbours: int = 5, candidates: int = 20, graph_weight: float = 0.5, symbol_weight: float = 0.5, transition_weight: float = 1.0, smoothing: float = 1e-3):
        masses = node_masses(model).limit(MAX_TOKENS + 1).toArrow().to_pandas()
        edges = model.edges.select("src", "dst", "cnt", "w").limit(2 * MAX_TOKENS + 1).toArrow().to_pandas()
        if len(masses) > MAX_TOKENS or len(edges) > 2 * MAX_TOKENS:
            raise ModelError("the model is too large to broadcast")
        self.mass = dict(zip(masses["token"], masses["mass"]))
        self.prob = {(s, d): w for s, d, w in zip(edges["src"], edges["dst"], edges["w"])}
        self.limit, self.gw, self.sw, self.tw, self.smoothing = candidates, graph_weight, symbol_weight, transition_weight, smoothing
        self.near: dict[str, tuple[frozenset, frozenset, int, int]] = {}
        ordered = edges.sort_values(["cnt", "w", "src", "dst"], ascending=[False, False, True, True])
        succ, pred = ordered.groupby("src", sort=False)["dst"].agg(list).to_dict(), ordered.groupby("dst", sort=False)["src"].agg(list).to_dict()
        for t in self.mass:
            p, s = pred.get(t, []), succ.get(t, [])
            self.near[t] = (frozenset(p[:neighbours]), frozenset(s[:neighbours]), len(p), len(s))
        self.by_shape: dict[tuple, list[tuple[str, float]]] = {}
        for t, m in sorted(self.mass.items(), key=lambda x: (-x[1], x[0])):
            self.by_shape.setdefault(self.shape(t), []).append((t, m))
        self.total = {k: sum(m for _, m in v) for k, v in self.by_shape.items()}

    @staticmethod
    def shape(token: str) -> tuple:
        sym, split, order = _symbols(token)
        return order, split, len(sym) - split

    @staticmethod
    def _jaccard(a: frozenset, b: frozenset) -> float:
        return len(a & b) / len(a | b) if a or b else 1.0

    def similarity(self, a: str, b: str) -> float:
        """Shape, shared neighbours and degrees of two tokens, with the share of equal symbols; from FLOOR to 1."""
        na, nb = self.near.get(a), self.near.get(b)
        none = (frozenset(), frozenset(), 0, 0)
        x, y = na or none, nb or none
        # fixed values: weights of shape, neighbours before and after, and degrees, and their sum
        graph = float(self.shape(a) == self.shape(b)) + 1.5 * self._jaccard(x[0], y[0]) + 1.5 * self._jaccard(x[1], y[1])
        if na and nb:
            graph += 0.25 * (abs(x[2] - y[2]) <= 2) + 0.25 * (abs(x[3] - y[3]) <= 2)
        s, t = _symbols(a)[0], _symbols(b)[0]
        same = sum(p == q for p, q in zip(s, t)) / max(len(s), len(t), 1)
        return max(FLOOR, self.gw * graph / 4.5 + self.sw * same)

    def path(self, observed: list[str], root: str) -> tuple[list[str], float]:
        """Latent tokens of the best path through candidates of the same shape, and its log score."""
        if not observed:
            return [], 0.0
        back, score = [], {}
        for pos, obs in enumerate(observed):
            shape = self.shape(obs)
            pool, total = self.by_shape.get(shape, [])[: self.limit], self.total.get(shape, 0.0)
            if all(t != obs for t, _ in pool):
                pool = [*pool, (obs, self.mass.get(obs, 0.0))]
            now, ptr = {}, {}
            for t, m in pool:
                prior = m / total if total else 0.0
                emit = math.log(max(prior, FLOOR)) + math.log(self.similarity(obs, t))
                best, came = -math.inf, None
                for prev, value in (score.items() if pos else [(root, 0.0)]):
                    v = value + self.tw * math.log(max(self.prob.get((prev, t), 0.0) + self.smoothing * prior, FLOOR))
                    if v > best:
                        best, came = v, prev
                now[t], ptr[t] = emit + best, came
            score = now
            back.append(ptr)
        last = max(sorted(score), key=score.get)
        top, out = score[last], [last]
        for ptr in reversed(back[1:]):
            out.append(ptr[out[-1]])
        return out[::-1], top


def align(model: Model, seqs: DataFrame, **how) -> DataFrame:
    """(seq, tokens, latent, log_path): observed and latent run-peeling tokens of every distinct sequence; empty and null ones are left out."""
    shared = model.spark.sparkContext.broadcast(Scaffold(model, **how))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = shared.value
        for pdf in batches:
            rows = []
            for seq, labels in pdf.itertuples(index=False, name=None):
                labels = list(labels)
                latent, lp = s.path(labels[1:], labels[0])
                rows.append((seq, labels[1:], latent, lp))
            yield pd.DataFrame(rows, columns=["seq", "tokens", "latent", "log_path"])

    q = seqs.select("seq").filter("seq <> ''").distinct().withColumn("labels", tk.flashback(F.col("seq")))
    return q.mapInPandas(run, "seq string, tokens array<string>, latent array<string>, log_path double")


def occupancy(model: Model, seqs: DataFrame) -> DataFrame:
    """(ord, lane, offset, n_seqs, occupancy, in_scaffold): share of the distinct sequences with a residue in each slot."""
    q = seqs.select("seq").filter("seq <> ''").distinct()
    n = q.agg(F.count(F.lit(1)).alias("n")).scalar()
    used = residues(q).groupBy("ord", "lane", "offset").agg(F.count(F.lit(1)).alias("n_seqs"))
    known = slots(model).select("ord", "lane", "offset", F.lit(True).alias("in_scaffold"))
    return known.join(used, ["ord", "lane", "offset"], "full_outer").select("ord", "lane", "offset", F.coalesce("n_seqs", F.lit(0)).cast("bigint").alias("n_seqs"), F.coalesce(F.try_divide(F.coalesce("n_seqs", F.lit(0)), n), F.lit(0.0)).alias("occupancy"), F.coalesce("in_scaffold", F.lit(False)).alias("in_scaffold"))
