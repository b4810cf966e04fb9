"""Algebra of models over the same variant: set operations, merges, Bayesian updates, removal, comparison, features."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reploom.operators import analytics
from reploom.operators.structure import degrees
from reploom.plans.dp import LocalGraph
from reploom.plans.model import Model, ModelError, count_edges

_KEY = ["src", "dst", "tok"]


def _same(a: Model, b: Model) -> None:
    if a.variant != b.variant:
        raise ModelError(f"{a.variant} and {b.variant} do not mix")


def _added(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    return a.select(*keys, "cnt").unionAll(b.select(*keys, "cnt")).groupBy(*keys).agg(F.sum("cnt").alias("cnt"))


def union(a: Model, b: Model) -> Model:
    """Counts added: the model of both repertoires together."""
    _same(a, b)
    return a.with_edges(_added(a.edges, b.edges, *_KEY), _added(a.lengths, b.lengths, "length"))


def intersection(a: Model, b: Model) -> Model:
    """Edges of both with the smaller count; lengths are added."""
    _same(a, b)
    both = a.edges.select(*_KEY, "cnt").join(b.edges.select(*_KEY, F.col("cnt").alias("other")), _KEY)
    return a.with_edges(both.select(*_KEY, F.least("cnt", "other").alias("cnt")), _added(a.lengths, b.lengths, "length"))


def difference(a: Model, b: Model) -> Model:
    """Counts of a less those of b, edges without any left dropped; lengths are those of a."""
    _same(a, b)
    both = a.edges.select(*_KEY, "cnt").join(b.edges.select(*_KEY, F.col("cnt").alias("other")), _KEY, "left")
    return a.with_edges(both.select(*_KEY, (F.col("cnt") - F.coalesce("other", F.lit(0))).alias("cnt")).filter("cnt > 0"))


def weighted_merge(a: Model, b: Model, alpha: float, beta: float) -> Model:
    """round(alpha * a) + round(beta * b), halves away from zero; sides that round to nothing are dropped."""
    _same(a, b)
    scaled = lambda df, f, *k: df.select(*k, F.round(F.col("cnt") * F.lit(float(f))).cast("bigint").alias("cnt")).filter("cnt > 0")
    return a.with_edges(_added(scaled(a.edges, alpha, *_KEY), scaled(b.edges, beta, *_KEY), *_KEY), _added(scaled(a.lengths, alpha, "length"), scaled(b.lengths, beta, "length"), "length"))


def posterior(model: Model, rep: DataFrame, kappa: float) -> Model:
    """Dirichlet update of the weights on the prior's edges by a repertoire (seq, abundance): (kappa w + c) / (kappa + n), renormalised.

    n counts the steps whose two nodes the prior has, though it may lack the edge; counts and lengths stay the prior's. kappa below 0 is an error;
    kappa + n = 0 keeps the prior's weight.
    """
    if kappa < 0:
        raise ModelError("kappa is negative")
    new = count_edges(rep, model.variant).groupBy("src", "dst").agg(F.sum("cnt").alias("c"))
    nodes = model.nodes()
    known = new.join(nodes.withColumnRenamed("node", "src"), "src", "left_semi").join(nodes.withColumnRenamed("node", "dst"), "dst", "left_semi")
    n = known.groupBy("src").agg(F.sum("c").alias("n"))
    e = model.edges.join(known, ["src", "dst"], "left").join(n, "src", "left").na.fill(0, ["c", "n"])
    raw = F.when(F.col("n") + F.lit(kappa) > 0, (F.lit(float(kappa)) * F.col("w") + F.col("c")) / (F.lit(float(kappa)) + F.col("n"))).otherwise(F.col("w"))
    e = e.withColumn("raw", raw)
    total = F.sum("raw").over(Window.partitionBy("src"))
    return replace(model, edges=e.select(*_KEY, "cnt", F.when(total > 0, F.col("raw") / total).otherwise(F.col("w")).alias("w")), edge_genes=None, pairs=None)


def without(model: Model, rep: DataFrame) -> Model:
    """The model as if the sequences (seq, abundance) had not been counted: counts less theirs, not below 0, empty edges dropped.

    Lengths stay; a run-peeling node left without a way on becomes a sink.
    """
    gone = count_edges(rep, model.variant).withColumnRenamed("cnt", "gone")
    both = model.edges.select(*_KEY, "cnt").join(gone, _KEY, "left")
    return model.with_edges(both.select(*_KEY, (F.col("cnt") - F.coalesce("gone", F.lit(0))).alias("cnt")).filter("cnt > 0"))


def _out_shares(model: Model) -> DataFrame:
    """(node, p): share of a node in all outgoing counts; nothing when there are none."""
    out = model.edges.groupBy(F.col("src").alias("node")).agg(F.sum("cnt").alias("c"))
    return out.select("node", (F.col("c") / out.agg(F.sum("c").alias("c")).scalar()).alias("p"))


def jensen_shannon(a: Model, b: Model) -> DataFrame:
    """One row, jsd in nats between the shares of outgoing counts by node; 0 when either model is empty."""
    _same(a, b)
    x = _out_shares(a).join(_out_shares(b).withColumnRenamed("p", "q"), "node", "full_outer").na.fill(0.0, ["p", "q"])
    m = (F.col("p") + F.col("q")) / 2
    part = lambda c: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / m)).otherwise(F.lit(0.0))
    s = x.agg(F.sum(part("p") + part("q")).alias("s"), F.sum("p").alias("sp"), F.sum("q").alias("sq"))
    return s.select(F.when((F.col("sp") > 0) & (F.col("sq") > 0), F.greatest(F.col("s") / 2, F.lit(0.0))).otherwise(F.lit(0.0)).alias("jsd"))


def compare(a: Model, b: Model) -> DataFrame:
    """One row: jsd, node_jaccard, edge_jaccard, shared_nodes, shared_edges."""
    node = a.nodes().withColumn("a", F.lit(1)).join(b.nodes().withColumn("b", F.lit(1)), "node", "full_outer").agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("s"), F.count(F.lit(1)).alias("n"))
    k = ["src", "dst"]
    edge = a.edges.select(*k, F.lit(1).alias("a")).join(b.edges.select(*k, F.lit(1).alias("b")), k, "full_outer").agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("s"), F.count(F.lit(1)).alias("n"))
    share = lambda df: df.select(F.when(F.col("n") > 0, F.col("s") / F.col("n")).otherwise(F.lit(0.0)).alias("x")).scalar()
    return jensen_shannon(a, b).select("jsd", share(node).alias("node_jaccard"), share(edge).alias("edge_jaccard"), node.select("s").scalar().alias("shared_nodes"), edge.select("s").scalar().alias("shared_edges"))


def aligned_features(reference: Model, query: Model) -> DataFrame:
    """(node, share): for every node of the reference the query's share of outgoing counts, 0 where it lacks the node."""
    return reference.nodes().join(_out_shares(query), "node", "left").select("node", F.coalesce("p", F.lit(0.0)).alias("share"))


def degree_features(model: Model) -> DataFrame:
    """One row of size features: n_nodes, n_edges, n_sinks, sink_share, max_out_degree."""
    sinks = model.sinks().agg(F.count(F.lit(1)).alias("n")).scalar()
    return degrees(model).agg(F.count(F.lit(1)).alias("n_nodes"), F.sum("out_degree").alias("n_edges"), F.max("out_degree").alias("max_out_degree")).select(
        "n_nodes", "n_edges", sinks.alias("n_sinks"), F.try_divide(sinks, F.col("n_nodes")).alias("sink_share"), "max_out_degree"
    )


#: The numbers of feature_stats in order, and the orders of its Hill numbers.
STATS = ("n_nodes", "n_edges", "n_roots", "n_sinks", "d0", "d0_5", "d1", "d2", "d5", "entropy_nats", "dynamic_range_orders", "n_sinks_again", "sink_share", "max_out_degree", "uniformity")
STAT_ORDERS = (0.0, 0.5, 1.0, 2.0, 5.0)


def feature_stats(model: Model, sims: DataFrame | None = None) -> DataFrame:
    """One row of the fifteen STATS. Hill numbers, entropy, range and uniformity are exact for a run-peeling model and estimated from sims for an LZ model."""
    size = degree_features(model).first()
    if sims is None:
        g = LocalGraph.within(model)
        hill = [r["hill"] for r in analytics.hill_curve(model, STAT_ORDERS, g).orderBy("alpha").collect()]
        p, orders = analytics.entropy(model, g).first(), analytics.dynamic_range(model, g).first()["dynamic_range_orders"]
        h, uniformity = p["entropy_nats"], p["effective_diversity"] / hill[0] if hill[0] else 0.0
    else:
        hill = [r["hill"] for r in analytics.monte_carlo(sims, STAT_ORDERS).orderBy("alpha").collect()]
        p = analytics.sampled_profile(sims).first()
        h, orders, uniformity = p["entropy_nats"], p["dynamic_range_orders"], p["uniformity"]
    n, e, k = (float(size[c] or 0) for c in ("n_nodes", "n_edges", "n_sinks"))
    row = (n, e, 1.0, k, *map(float, hill), float(h), float(orders), k, k / n if n else 0.0, float(size["max_out_degree"] or 0), float(uniformity))
    return model.spark.createDataFrame([row], ", ".join(f"{c} double" for c in STATS))
