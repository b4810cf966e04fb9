"""Transition models as DataFrames: repertoire, edges, weights, lengths, genes; saved and loaded as a folder of parquet."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reploom.functions import text as tx
from reploom.functions import tokens as tk
from reploom.session import cut

VARIANTS = ("aap", "ndp", "naive")
LOG_EPS = -690.7755278982137  # fixed value: log(1e-300), the score of what a model cannot produce
IN_MODEL = -690.0  # fixed value: scores above it are in the model


class ModelError(ValueError):
    """A model that cannot be built or used as asked."""


class NoGeneDataError(ModelError):
    """Gene operators on a model without genes."""


class UnknownNodeError(ModelError):
    """A node that the model does not have."""


class ConvergenceError(ModelError):
    """An iteration, or drawing again, that came to no end."""


class CorruptFileError(ModelError):
    """A stored model that is incomplete or not one of ours."""


def repertoire(df: DataFrame, seq: str = "seq", abundance: str | None = None, v_gene: str | None = None, j_gene: str | None = None, productive: str | None = None) -> DataFrame:
    """(seq, abundance[, v_gene, j_gene]) with one row a distinct combination; the form all builders take.

    Sequences are stripped; null, empty and malformed ones are dropped, as are rows whose productive flag, if asked for, is not affirmative.
    A null abundance or one below 1 counts 1. Null genes stay null. Extra columns are ignored.
    """
    cols = [tx.strip(F.col(seq)).alias("seq"), (F.greatest(F.coalesce(F.col(abundance).cast("bigint"), F.lit(1)), F.lit(1)) if abundance else F.lit(1)).cast("bigint").alias("abundance")]
    genes = [F.col(g).alias(n) for g, n in ((v_gene, "v_gene"), (j_gene, "j_gene")) if g]
    keep = df.filter(tx.is_productive(F.col(productive))) if productive else df
    rows = keep.select(*cols, *genes).filter(F.col("seq").rlike(tx.SEQUENCE_PATTERN))
    keys = ["seq", *[n for g, n in ((v_gene, "v_gene"), (j_gene, "j_gene")) if g]]
    return rows.groupBy(*keys).agg(F.sum("abundance").alias("abundance"))


def spread(rep: DataFrame) -> DataFrame:
    """Distinct sequences over all cores: parsing costs far more than their bytes, by which AQE would put them into a few tasks."""
    spark = rep.sparkSession
    return rep.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "seq")


def labelled(rep: DataFrame, variant: str) -> DataFrame:
    """rep plus toks (tokens) and labels (nodes) of every sequence."""
    if variant not in (*VARIANTS, "flashback"):
        raise ModelError(f"unknown variant {variant}")
    return spread(rep).withColumn("_p", tk.labels_arrow(variant)(F.col("seq"))).select(*rep.columns, "_p.toks", "_p.labels")


def transitions(rows: DataFrame, *keep: str) -> DataFrame:
    """(keep, i, src, dst, tok, dst_pos): one row a step between consecutive nodes."""
    steps = F.transform(F.sequence(F.lit(1), F.size("labels") - 1), lambda i: F.struct(i.alias("i"), F.col("labels")[i - 1].alias("src"), F.col("labels")[i].alias("dst"), F.col("toks")[i].alias("tok")))
    return rows.filter(F.size("labels") > 1).select(*keep, F.explode(steps).alias("t")).select(*keep, "t.i", "t.src", "t.dst", "t.tok")


def weighted(edges: DataFrame, smoothing: float = 0.0) -> DataFrame:
    """edges plus w: (cnt + smoothing) over the source's total with smoothing for each of its edges."""
    w = Window.partitionBy("src")
    return edges.withColumn("w", (F.col("cnt") + F.lit(smoothing)) / (F.sum("cnt").over(w) + F.lit(smoothing) * F.count(F.lit(1)).over(w)))


@dataclass(frozen=True)
class Model:
    """edges (src, dst, tok, cnt BIGINT, w DOUBLE), lengths (length, cnt) and how they were made."""

    edges: DataFrame
    lengths: DataFrame
    variant: str
    smoothing: float = 0.0
    edge_genes: DataFrame | None = None
    pairs: DataFrame | None = None

    @property
    def spark(self) -> SparkSession:
        return self.edges.sparkSession

    @property
    def root(self) -> str:
        return {"flashback": "@$_1{0}", "naive": "@"}.get(self.variant, "@_1")

    def nodes(self) -> DataFrame:
        """(node): every source and target once."""
        return self.edges.select(F.col("src").alias("node")).unionAll(self.edges.select(F.col("dst").alias("node"))).distinct()

    def sinks(self) -> DataFrame:
        """(node): LZ nodes whose token ends with the end mark; run-peeling nodes without a way on."""
        if self.variant == "flashback":
            return self.edges.select(F.col("dst").alias("node")).distinct().join(self.edges.select(F.col("src").alias("node")).distinct(), "node", "left_anti")
        return self.edges.filter(F.col("tok").endswith(tk.END)).select(F.col("dst").alias("node")).distinct()

    def with_edges(self, counts: DataFrame, lengths: DataFrame | None = None) -> Model:
        """Same kind of model over other counts (src, dst, tok, cnt)."""
        return replace(self, edges=weighted(counts, self.smoothing), lengths=self.lengths if lengths is None else lengths, edge_genes=None, pairs=None)

    def persist(self) -> Model:
        """The edges kept for several uses; spills to disk and is recomputed where an executor is lost."""
        self.edges.persist()
        return self


#: Different edges that a task counts before it hands them on.
FLUSH = 200_000


def count_edges(rep: DataFrame, variant: str) -> DataFrame:
    """(src, dst, tok, cnt) of (seq, abundance): parsed and counted in Arrow batches, bounded tables of counts, then one shuffle of those."""
    if variant not in (*VARIANTS, "flashback"):
        raise ModelError(f"unknown variant {variant}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str, str], int] = {}
        for batch in batches:
            for s, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                labels = tk.peel_labels(s) if variant == "flashback" else None
                toks, labels = (labels, labels) if labels is not None else tk.lz_nodes(s, variant != "naive")
                for i in range(1, len(labels)):
                    key = labels[i - 1], labels[i], toks[i]
                    counts[key] = counts.get(key, 0) + n
            if len(counts) >= FLUSH:
                yield _rows(counts)
                counts = {}
        yield _rows(counts)

    parsed = spread(rep.select("seq", "abundance").filter("seq is not null and abundance is not null")).mapInArrow(run, "src string, dst string, tok string, cnt bigint")
    return parsed.groupBy("src", "dst", "tok").agg(F.sum("cnt").alias("cnt"))


def _rows(counts: dict[tuple[str, str, str], int]) -> pa.RecordBatch:
    src, dst, tok = zip(*counts) if counts else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(src, pa.string()), pa.array(dst, pa.string()), pa.array(tok, pa.string()), pa.array(counts.values(), pa.int64())], names=["src", "dst", "tok", "cnt"])


def count_lengths(rep: DataFrame) -> DataFrame:
    """(length, cnt): sequences by length, weighted by abundance."""
    return rep.groupBy(F.length("seq").alias("length")).agg(F.sum("abundance").alias("cnt"))


def fit(rep: DataFrame, variant: str = "aap", smoothing: float = 0.0, genes: bool = False) -> Model:
    """Model of a repertoire; with genes also (src, dst, kind, gene, cnt) per edge and the pair counts (v_gene, j_gene, cnt).

    The weighted edges, far fewer than the rows, are materialised in the shared folder: what uses them several times parses once.
    """
    if smoothing < 0:
        raise ModelError("smoothing is negative")
    if genes and not {"v_gene", "j_gene"} <= set(rep.columns):
        raise NoGeneDataError("both v_gene and j_gene are needed")
    plain = rep.groupBy("seq").agg(F.sum("abundance").alias("abundance")) if genes else rep
    model = Model(cut(weighted(count_edges(plain, variant), smoothing)), count_lengths(rep), variant, smoothing)
    if not genes:
        return model
    known = rep.filter("v_gene is not null and j_gene is not null")
    steps = transitions(labelled(known, variant), "abundance", "v_gene", "j_gene")
    kinds = F.explode(F.expr("array(struct('v' kind, v_gene gene), struct('j' kind, j_gene gene))")).alias("g")
    per_edge = steps.select("src", "dst", kinds, "abundance").groupBy("src", "dst", F.col("g.kind").alias("kind"), F.col("g.gene").alias("gene")).agg(F.sum("abundance").alias("cnt"))
    return replace(model, edge_genes=per_edge, pairs=known.groupBy("v_gene", "j_gene").agg(F.sum("abundance").alias("cnt")))


def save(model: Model, path: str) -> None:
    """Parquet folder with edges, lengths, meta and, if any, genes. The kind of model is in meta."""
    model.edges.write.mode("overwrite").parquet(f"{path}/edges")
    model.lengths.write.mode("overwrite").parquet(f"{path}/lengths")
    if model.edge_genes is not None:
        model.edge_genes.write.mode("overwrite").parquet(f"{path}/edge_genes")
        model.pairs.write.mode("overwrite").parquet(f"{path}/pairs")
    meta = json.dumps({"variant": model.variant, "smoothing": model.smoothing, "genes": model.edge_genes is not None, "format": 1})
    model.spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load(spark: SparkSession, path: str) -> Model:
    """The model stored in a folder; an error if its parts are missing or its description is not one of ours."""
    try:
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        known = meta["format"] == 1 and meta["variant"] in (*VARIANTS, "flashback")
        parts = [spark.read.parquet(f"{path}/{n}").columns for n in ("edges", "lengths")]
    except (AnalysisException, ValueError, KeyError, TypeError) as e:
        raise CorruptFileError(f"{path} holds no model") from e
    if not known or not {"src", "dst", "tok", "cnt", "w"} <= set(parts[0]):
        raise CorruptFileError(f"{path} holds no model of this format")
    genes = [spark.read.parquet(f"{path}/{n}") for n in ("edge_genes", "pairs")] if meta["genes"] else [None, None]
    return Model(spark.read.parquet(f"{path}/edges"), spark.read.parquet(f"{path}/lengths"), meta["variant"], meta["smoothing"], *genes)


def is_public(label: Column) -> Column:
    """Nodes that carry no start or end mark."""
    return ~label.startswith(tk.START) & ~label.contains(tk.END)
