"""Per-key results where a few keys hold most rows.

Native algebraic aggregates combine on the map side in bounded hash tables that spill, so a hot key reaches the shuffle
as one partial state a task. Coarser keys are merged from the finer key's states, so the rows are read once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pair_states(df: DataFrame, left: str = "v_call", right: str = "j_call", weight: str = "duplicate_count") -> DataFrame:
    """Mergeable state of every (left, right): rows, known weights, their sum, least and largest. Null keys are keys."""
    w = F.col(weight)
    return df.groupBy(F.col(left).alias("v_key"), F.col(right).alias("j_key")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(w).alias("n_weighted"), F.sum(w).alias("sum_weight"), F.min(w).alias("min_weight"), F.max(w).alias("max_weight")
    )


def merge_states(states: DataFrame, *keys: str) -> DataFrame:
    """States of coarser keys from finer ones; without keys one row for all."""
    return states.groupBy(*keys).agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n_weighted").alias("n_weighted"), F.sum("sum_weight").alias("sum_weight"), F.min("min_weight").alias("min_weight"), F.max("max_weight").alias("max_weight")
    )


def _pairs(df: DataFrame) -> DataFrame:
    """States of every pair of calls, null keys as the empty string."""
    pairs = pair_states(df.select("v_call", "j_call", "duplicate_count"))
    return merge_states(pairs.withColumns({k: F.coalesce(k, F.lit("")) for k in ("v_key", "j_key")}), "v_key", "j_key")


def _kinds(pairs: DataFrame) -> DataFrame:
    sets = F.explode(F.expr("array(struct('pair' key_kind, v_key v, j_key j), struct('v_call' key_kind, v_key v, '-' j), struct('j_call' key_kind, '-' v, j_key j))")).alias("k")
    measures = ["n_rows", "n_weighted", "sum_weight", "min_weight", "max_weight"]
    keyed = pairs.select(sets, *measures).select("k.key_kind", F.col("k.v").alias("v_key"), F.col("k.j").alias("j_key"), *measures)
    return merge_states(keyed, "key_kind", "v_key", "j_key")


def per_key(df: DataFrame) -> DataFrame:
    """key_kind (v_call, j_call, pair), v_key, j_key and the state of each key.

    Null keys come out as the empty string and are merged with it; the side that a kind does not use is '-'. An empty table gives no rows.
    """
    return _kinds(_pairs(df))


def heavy_keys(df: DataFrame, share: float = 0.04) -> DataFrame:
    """(key_kind, v_key, j_key, n_rows): the keys that hold at least that share of all rows.

    The total is the sum over the pair states, a scalar subquery over the same exchange, so the rows are read once.
    """
    pairs = _pairs(df)
    total = pairs.agg(F.sum("n_rows").alias("n"))
    return _kinds(pairs).filter(F.col("n_rows") >= F.lit(share) * total.scalar()).select("key_kind", "v_key", "j_key", "n_rows")
