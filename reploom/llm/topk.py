"""Most frequent items: exact, in bounded memory.

Counts come from a hash aggregate with map-side combining that spills to disk; the ordered limit keeps k rows in each partition and
merges those, so neither a task nor the driver holds more than k candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reploom.functions import text as tx


def counts(df: DataFrame, value: Column, name: str = "item") -> DataFrame:
    """(item, n) of every non-null value."""
    return df.select(value.alias(name)).filter(F.col(name).isNotNull()).groupBy(name).agg(F.count(F.lit(1)).alias("n"))


def top_k(df: DataFrame, value: Column, k: int, name: str = "item") -> DataFrame:
    """The k most frequent values with exact counts; ties go by value. An empty table gives no rows."""
    return counts(df, value, name).orderBy(F.desc("n"), F.asc(name)).limit(k)


def junction(df: DataFrame) -> Column:
    """junction_aa without outer blanks in upper case."""
    return F.upper(tx.strip(df["junction_aa"]))


def heavy(df: DataFrame, share: float = 0.002) -> DataFrame:
    """(junction_aa, n): values in at least that share of all rows. No more than 1/share values can be, so they are among the top k for that k.

    The total, null rows included, is the sum of all counts: a scalar subquery over the same exchange, so the rows are read once.
    """
    every = df.select(junction(df).alias("junction_aa")).groupBy("junction_aa").agg(F.count(F.lit(1)).alias("n"))
    total = every.agg(F.sum("n").alias("n"))
    # the null group may be among them, hence one more; filtering above the limit leaves both uses of the counts one exchange
    top = every.orderBy(F.desc("n"), F.asc("junction_aa")).limit(int(1 / share) + 2)
    return top.filter(F.col("junction_aa").isNotNull() & (F.col("n") >= F.lit(share) * total.scalar()))
