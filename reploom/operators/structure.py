"""Structure of a model: nodes, edges, degrees, neighbours, summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reploom.plans.model import ConvergenceError, Model, UnknownNodeError, is_public
from reploom.session import cut, running_total


def public_edges(model: Model) -> DataFrame:
    """Edges between nodes without start or end marks."""
    return model.edges.filter(is_public(F.col("src")) & is_public(F.col("dst")))


def public_nodes(model: Model) -> DataFrame:
    return model.nodes().filter(is_public(F.col("node")))


def degrees(model: Model) -> DataFrame:
    """(node, out_degree, in_degree, out_cnt, in_cnt) of every node, from one pass over the edges."""
    ends = F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")
    e = model.edges.select(ends, "cnt").select("e.node", "e.o", "e.i", "cnt")
    return e.groupBy("node").agg(
        F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"), F.sum(F.col("o") * F.col("cnt")).alias("out_cnt"), F.sum(F.col("i") * F.col("cnt")).alias("in_cnt")
    )


def hubs(model: Model, k: int = 20) -> DataFrame:
    """The k nodes of highest total degree; ties by label."""
    return degrees(model).select("node", (F.col("out_degree") + F.col("in_degree")).alias("degree")).orderBy(F.desc("degree"), "node").limit(k)


def successors(model: Model, label: str, strict: bool = False) -> DataFrame:
    """(node, cnt, w) that follow a node; for an unknown node empty, or an error if strict."""
    return _neighbours(model, label, "src", "dst", strict)


def predecessors(model: Model, label: str, strict: bool = False) -> DataFrame:
    """(node, cnt, w) that a node follows; as successors."""
    return _neighbours(model, label, "dst", "src", strict)


def _neighbours(model: Model, label: str, near: str, far: str, strict: bool) -> DataFrame:
    if strict and model.edges.filter((F.col("src") == label) | (F.col("dst") == label)).isEmpty():
        raise UnknownNodeError(f"the model has no node {label}")
    return model.edges.filter(F.col(near) == label).select(F.col(far).alias("node"), "cnt", "w")


def adjacency(model: Model) -> DataFrame:
    """(node, first, targets, weights): out-edges of each node in order of the target, first counting the edges of the nodes before it in label order.

    An array is as long as a node's out-degree.
    """
    out = model.edges.groupBy(F.col("src").alias("node")).agg(F.sort_array(F.collect_list(F.struct("dst", "w"))).alias("e"))
    rows = model.nodes().join(out, "node", "left").withColumn("n", F.coalesce(F.size("e"), F.lit(0)))
    both = running_total(rows, "node", "n", "upto")
    none = lambda t: F.array().cast(f"array<{t}>")
    return both.select("node", (F.col("upto") - F.col("n")).alias("first"), F.coalesce(F.col("e.dst"), none("string")).alias("targets"), F.coalesce(F.col("e.w"), none("double")).alias("weights"))


def initial_nodes(model: Model) -> DataFrame:
    """Nodes without predecessors that carry no start mark; for these models there are usually none."""
    return public_nodes(model).join(model.edges.select(F.col("dst").alias("node")).distinct(), "node", "left_anti")


def terminal_nodes(model: Model) -> DataFrame:
    return model.sinks()


def isolated_nodes(model: Model) -> DataFrame:
    """Nodes left without any edge once those at start and end marks are gone."""
    e = public_edges(model)
    return public_nodes(model).join(e.select(F.col("src").alias("node")).unionAll(e.select(F.col("dst").alias("node"))).distinct(), "node", "left_anti")


def summary(model: Model) -> DataFrame:
    """One row: n_nodes, n_edges, n_initial (always 1), n_terminal, n_sequences, max_out_degree, max_in_degree, density, n_isolated.

    An empty model has zeros and a density of 0.
    """
    d = degrees(model).agg(F.count(F.lit(1)).alias("n_nodes"), F.coalesce(F.max("out_degree"), F.lit(0)).alias("max_out_degree"), F.coalesce(F.max("in_degree"), F.lit(0)).alias("max_in_degree"), F.coalesce(F.sum("out_degree"), F.lit(0)).alias("n_edges"))
    sinks = model.sinks().agg(F.count(F.lit(1)).alias("n"))
    n = model.lengths.agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("n"))
    isolated = isolated_nodes(model).agg(F.count(F.lit(1)).alias("n"))
    density = F.when(F.col("n_nodes") > 1, F.col("n_edges") / (F.col("n_nodes") * (F.col("n_nodes") - 1))).otherwise(F.lit(0.0))
    return d.select("n_nodes", "n_edges", F.lit(1).cast("bigint").alias("n_initial"), sinks.scalar().alias("n_terminal"), n.scalar().alias("n_sequences"), "max_out_degree", "max_in_degree", F.round(density, 12).alias("density"), isolated.scalar().alias("n_isolated"))


def has_gene_data(model: Model) -> bool:
    """Whether gene operators may be used on the model."""
    return model.edge_genes is not None and model.pairs is not None


def is_dag(model: Model, max_rounds: int = 4096) -> bool:
    """Whether the transitions have no cycle: nodes without predecessors are peeled off until none are left.

    As arrays up to the local bound of edges, by anti joins beyond it, a round a level of the graph; more rounds than max_rounds are an error.
    """
    from reploom.plans.dp import LocalGraph

    g = LocalGraph.within(model)
    if g is not None:
        return g.acyclic()
    left = cut(model.edges.select("src", "dst"))
    for _ in range(max_rounds):
        nxt = cut(left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").select("src", "dst"))
        if nxt.isEmpty():
            return True
        if nxt.count() == left.count():
            return False
        left = nxt
    raise ConvergenceError("the levels did not end")
