"""Gene annotations of a model: marginals, joint, per-edge counts and membership."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reploom.plans.model import Model, NoGeneDataError


def _pairs(model: Model) -> DataFrame:
    if model.pairs is None:
        raise NoGeneDataError("the model has no genes")
    return model.pairs


def joint(model: Model) -> DataFrame:
    """(v_gene, j_gene, cnt, prob) by sequence weight."""
    p = _pairs(model)
    return p.withColumn("prob", F.col("cnt") / p.agg(F.sum("cnt").alias("n")).scalar())


def marginals(model: Model) -> DataFrame:
    """(kind, gene, cnt, prob) for v and j genes."""
    p = _pairs(model)
    both = p.select(F.explode(F.expr("array(struct('v' kind, v_gene gene), struct('j' kind, j_gene gene))")).alias("g"), "cnt").groupBy("g.kind", "g.gene").agg(F.sum("cnt").alias("cnt"))
    return both.withColumn("prob", F.col("cnt") / p.agg(F.sum("cnt").alias("n")).scalar())


def edge_gene_probability(model: Model) -> DataFrame:
    """(src, dst, kind, gene, cnt, prob): a gene's share of the annotated count on an edge."""
    if model.edge_genes is None:
        raise NoGeneDataError("the model has no genes")
    return model.edge_genes.withColumn("prob", F.col("cnt") / F.sum("cnt").over(Window.partitionBy("src", "dst", "kind")))


def edges_with_gene(model: Model, kind: str, gene: str) -> DataFrame:
    """Edges that some sequence of the gene goes over, by a semi join."""
    if model.edge_genes is None:
        raise NoGeneDataError("the model has no genes")
    return model.edges.join(model.edge_genes.filter((F.col("kind") == kind) & (F.col("gene") == gene)), ["src", "dst"], "left_semi")
