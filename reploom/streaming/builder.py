"""Models that grow with a stream: counts of edges merged batch by batch, read at any time.

Each micro-batch appends its own aggregated counts under its number to the state folder, replacing what an earlier attempt of the
same batch left, so a retried batch counts once. Sums commute: the model equals that of one batch over the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from reploom.plans.model import Model, ModelError, count_edges, count_lengths, labelled, weighted


class StreamBuilder:
    """Accumulates (seq, abundance) batches into a model."""

    def __init__(self, spark: SparkSession, state: str, variant: str = "flashback", smoothing: float = 0.0):
        self.spark, self.state, self.variant, self.smoothing = spark, state, variant, smoothing
        self.closed, self.next = False, 0
        self.query: StreamingQuery | None = None

    def _open(self) -> None:
        if self.closed:
            raise RuntimeError("the builder is closed")

    def add(self, batch: DataFrame, number: int | None = None) -> None:
        """Count a batch; null and empty sequences and abundances below 1 are skipped, a missing abundance column counts 1 each."""
        self._open()
        number = self.next if number is None else number
        self.next = max(self.next, number + 1)
        a = F.coalesce(F.col("abundance").cast("bigint"), F.lit(1)) if "abundance" in batch.columns else F.lit(1).cast("bigint")
        rep = batch.select("seq", a.alias("abundance")).filter("seq <> '' and abundance > 0").groupBy("seq").agg(F.sum("abundance").alias("abundance"))
        count_edges(rep, self.variant).write.mode("overwrite").parquet(f"{self.state}/edges/batch={number}")
        count_lengths(rep).write.mode("overwrite").parquet(f"{self.state}/lengths/batch={number}")

    def attach(self, stream: DataFrame, checkpoint: str, **options) -> StreamingQuery:
        """Start a streaming query that adds every micro-batch; options go to the writer's trigger."""
        self._open()
        self.query = stream.writeStream.foreachBatch(lambda df, number: self.add(df, number)).option("checkpointLocation", checkpoint).trigger(**(options or {"availableNow": True})).start()
        return self.query

    def snapshot(self) -> Model:
        """The model so far; the stream goes on."""
        self._open()
        if not self.next and self.query is None:
            raise ModelError("nothing has been added")
        e = self.spark.read.parquet(f"{self.state}/edges").groupBy("src", "dst", "tok").agg(F.sum("cnt").alias("cnt"))
        n = self.spark.read.parquet(f"{self.state}/lengths").groupBy("length").agg(F.sum("cnt").alias("cnt"))
        return Model(weighted(e, self.smoothing), n, self.variant, self.smoothing)

    def peek(self) -> tuple[int, int]:
        """(nodes, edges) so far; zeros once closed."""
        if self.closed or (not self.next and self.query is None):
            return 0, 0
        m = self.snapshot()
        return m.nodes().count(), m.edges.count()

    def finalize(self) -> Model:
        """The model; the builder takes nothing more."""
        m = self.snapshot()
        self.abort()
        return m

    def abort(self) -> None:
        """Stop the query and close; may be called again."""
        if self.query is not None and self.query.isActive:
            self.query.stop()
        self.closed = True

    def __enter__(self) -> StreamBuilder:
        return self

    def __exit__(self, *exc) -> None:
        self.abort()


def windowed_counts(stream: DataFrame, time_col: str, late: str = "1 day", width: str = "1 day", variant: str = "flashback") -> DataFrame:
    """(window, src, dst, tok, cnt) per event-time window of a stream of (seq, time); rows later than the watermark are left out.

    An extension: batch models have no notion of time.
    """
    rows = stream.filter("seq <> ''").withWatermark(time_col, late).withColumn("abundance", F.lit(1).cast("bigint"))
    lab = labelled(rows, variant)
    steps = F.explode(F.transform(F.sequence(F.lit(1), F.size("labels") - 1), lambda i: F.struct(F.col("labels")[i - 1].alias("src"), F.col("labels")[i].alias("dst"), F.col("toks")[i].alias("tok")))).alias("t")
    return lab.filter(F.size("labels") > 1).select(F.col(time_col), steps).groupBy(F.window(time_col, width), "t.src", "t.dst", "t.tok").agg(F.count(F.lit(1)).alias("cnt"))
