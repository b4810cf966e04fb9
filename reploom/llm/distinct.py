"""Distinct counts over huge identifier sets: bit matrices of hash ranks with stochastic averaging.

A value's hash picks one of M rows of a bit matrix and sets the bit of its rank (trailing zeros of the rest). A group's matrix
is kept sparse, one BIGINT a non-empty row, so small groups cost no more than their values. Matrices merge by bitwise OR: coarser groups
come from finer ones. The distinct count is the maximum-likelihood estimate under the Poisson model, and the Fisher
information at the estimate bounds its variance; the relative standard error tends to 0.65 / sqrt(M) for large counts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a matrix: a relative standard error of about 1 %.
M = 4096
#: Bits of a row: ranks 0 to LEVELS - 1, the last one standing for all higher ones.
LEVELS = 40


def matrix(df: DataFrame, value: Column, *keys: Column, m: int = M) -> DataFrame:
    """(keys, slot, bits): the sparse bit matrix of each group. Null values are left out; null keys are keys of their own."""
    h = F.xxhash64(value)
    rest = F.shiftrightunsigned(h, m.bit_length() - 1)
    low = rest.bitwiseAND(-rest)  # the lowest set bit; ranks beyond the last level share it
    top = F.lit(1 << (LEVELS - 1)).cast("bigint")
    bit = F.when((low <= 0) | (low > top), top).otherwise(low)
    slot = h.bitwiseAND(F.lit(m - 1)).cast("int")
    return df.filter(value.isNotNull()).groupBy(*keys, slot.alias("slot")).agg(F.bit_or(bit).alias("bits"))


def merge(matrices: DataFrame, *keys: str) -> DataFrame:
    """Union of matrices over coarser keys."""
    return matrices.groupBy(*keys, "slot").agg(F.bit_or("bits").alias("bits"))


def likeliest(counts: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """(estimate, standard error) of each row of counts: set bits by level, over the m rows of a matrix.

    Rows are Poisson with mean n/m and level r has rate 2^-(r+1), the last level the rest; the score is monotone in n, so
    bisection on log n finds its zero.
    """
    counts = np.asarray(counts, dtype=float)
    rate = np.array([2.0 ** -(r + 1) for r in range(LEVELS - 1)] + [2.0 ** -(LEVELS - 1)]) / m
    lo, hi = np.full(len(counts), -3.0), np.full(len(counts), 45.0)
    for _ in range(60):
        mid = (lo + hi) / 2
        x = np.exp(mid)[:, None] * rate
        with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
            score = (rate * (counts / np.expm1(x) - (m - counts))).sum(axis=1)
        up = score > 0
        lo, hi = np.where(up, mid, lo), np.where(up, hi, mid)
    n = np.exp((lo + hi) / 2)
    x = n[:, None] * rate
    with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
        info = (m * rate**2 / np.expm1(x)).sum(axis=1)
    se = 1 / np.sqrt(info)
    # below the number of set rows' resolution the Poisson spread of n itself is no error of the count: only collisions are
    return n, np.minimum(se, np.sqrt(np.maximum(n * n / (2 * m), 0.25)))


def estimate(matrices: DataFrame, *keys: str, m: int = M, sigmas: float = 3.0) -> DataFrame:
    """(keys, n_estimate, std_error, n_low, n_high): one row a group, n_low and n_high sigmas standard errors away."""
    levels = [F.count_if(F.col("bits").bitwiseAND(F.lit(1 << r).cast("bigint")) != 0) for r in range(LEVELS)]
    counted = matrices.groupBy(*keys).agg(F.array(*levels).alias("levels"))

    @F.pandas_udf("n double, se double")
    def solve(levels: pd.Series) -> pd.DataFrame:
        n, se = likeliest(np.stack(levels.to_numpy()), m) if len(levels) else (np.zeros(0), np.zeros(0))
        return pd.DataFrame({"n": n, "se": se})

    out = counted.withColumn("e", solve("levels"))
    return out.select(*keys, F.col("e.n").alias("n_estimate"), F.col("e.se").alias("std_error"), F.greatest(F.lit(0.0), F.col("e.n") - sigmas * F.col("e.se")).alias("n_low"), (F.col("e.n") + sigmas * F.col("e.se")).alias("n_high"))


def by_day_and_call(df: DataFrame, m: int = M) -> DataFrame:
    """(level, day, v_call, slot, bits): mergeable matrices of junction_aa for the levels day_call, day, call and all.

    Null days and calls are groups of their own; day and v_call are null where a level does not use them. Values count as stored.
    """
    fine = matrix(df.select("run_ts", "v_call", "junction_aa"), F.col("junction_aa"), F.to_date("run_ts").alias("day"), F.col("v_call"), m=m)
    sets = F.explode(F.expr("array(struct('day_call' level, day d, v_call v), struct('day' level, day d, cast(null as string) v), struct('call' level, cast(null as date) d, v_call v), struct('all' level, cast(null as date) d, cast(null as string) v))")).alias("g")
    wide = fine.select(sets, "slot", "bits").select("g.level", F.col("g.d").alias("day"), F.col("g.v").alias("v_call"), "slot", "bits")
    return merge(wide, "level", "day", "v_call")
