"""Queries of this subpackage and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reploom.llm import bpe, distinct, neardup, packing, repetition, topk
from reploom.session import cut, table


def p3_distinct(spark: SparkSession, d: str) -> DataFrame:
    return distinct.estimate(distinct.by_day_and_call(table(spark, d, "regression_input", "run_ts", "v_call", "junction_aa")), "level", "day", "v_call")


def p3_bound(spark: SparkSession, d: str) -> DataFrame:
    """Exact counts of every group of every level beside the estimates: within five standard errors."""
    src = table(spark, d, "regression_input", "run_ts", "v_call", "junction_aa").filter("junction_aa is not null")
    fine = src.select(F.to_date("run_ts").alias("day"), "v_call", "junction_aa").distinct()
    exact = None
    for level, keys in (("day_call", ["day", "v_call"]), ("day", ["day"]), ("call", ["v_call"]), ("all", [])):
        one = fine.select(*keys, "junction_aa").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("n_exact"))
        one = one.select(F.lit(level).alias("level"), (F.col("day") if "day" in keys else F.lit(None).cast("date")).alias("day"), (F.col("v_call") if "v_call" in keys else F.lit(None).cast("string")).alias("v_call"), "n_exact")
        exact = one if exact is None else exact.unionAll(one)
    e = p3_distinct(spark, d).toDF("l", "dd", "v", "n_estimate", "std_error", "n_low", "n_high")
    both = exact.join(e, (F.col("level") == F.col("l")) & F.col("day").eqNullSafe(F.col("dd")) & F.col("v_call").eqNullSafe(F.col("v")), "left")
    return both.select("level", "day", "v_call", "n_exact", (F.abs(F.col("n_estimate") - F.col("n_exact")) <= 5 * F.col("std_error")).alias("within"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.found(table(spark, d, "regression_input", "row_id", "junction"), "row_id")


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.grouped(table(spark, d, "regression_input", "row_id", "junction"), "row_id", neardup.bases(F.col("junction")), 90)


def p5_residue_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.grouped(table(spark, d, "regression_input", "row_id", "junction_aa"), "row_id", neardup.residues(F.col("junction_aa")), 30, letters=20)


def p5_recall(spark: SparkSession, d: str) -> DataFrame:
    """Links of every row whose id is divisible by 100 against all rows; the SQL counts them by brute force, so equal rows are a recall of 1."""
    return neardup.linked(table(spark, d, "regression_input", "row_id", "junction"), "row_id", neardup.bases(F.col("junction")), 90)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return topk.heavy(table(spark, d, "regression_input", "junction_aa")).select("junction_aa")


def p6_top(spark: SparkSession, d: str) -> DataFrame:
    src = table(spark, d, "regression_input", "junction_aa")
    return topk.top_k(src, topk.junction(src), 100, "junction_aa")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_table(table(spark, d, "documents", "doc_id", "text"))


def p8_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Texts whose ids decode to something else: none. Null texts decode to the empty string."""
    both = table(spark, d, "documents", "doc_id", "text").withColumn("back", bpe.decoded(bpe.ids(F.col("text"))))
    return both.agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(F.col("back") == F.coalesce("text", F.lit(""))).alias("n_same"))


def _packed(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "doc_id", "text")
    return packing.containers(docs.select("doc_id", bpe.n_tokens(F.col("text")).alias("n_tokens")), "doc_id", "n_tokens")


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d).withColumnRenamed("id", "doc_id").withColumnRenamed("size", "n_tokens")


def p9_fill(spark: SparkSession, d: str) -> DataFrame:
    """Invariants of the packing: every document once and whole, no container over its capacity, at least 99 % of all but one container filled."""
    rows = cut(_packed(spark, d))
    boxes = rows.groupBy("container").agg(F.sum("size").alias("fill"))
    a = boxes.agg(F.count_if(F.col("fill") > packing.CAPACITY).alias("n_over"), (F.sum("fill") >= 0.99 * packing.CAPACITY * (F.count(F.lit(1)) - 1)).alias("well_filled"))
    b = rows.agg(F.count_distinct("id").alias("n_docs"), F.count_if((F.col("piece_no") > 1) & (F.col("size") < 1)).alias("n_empty_pieces"))
    return b.withColumn("n_over", a.select("n_over").scalar()).withColumn("well_filled", a.select("well_filled").scalar())


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "doc_id", "text")
    return repetition.found(repetition.measured(docs), repetition.train(docs))


def p10_shares(spark: SparkSession, d: str) -> DataFrame:
    rows = repetition.shares(table(spark, d, "documents", "doc_id", "text"))
    return rows.select("doc_id", "n_letters", "n_repeated", F.round("repeated_share", 9).alias("repeated_share"))


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    """Statistics, anomaly and suspicion of every document."""
    docs = table(spark, d, "documents", "doc_id", "text")
    return repetition.scored(repetition.measured(docs), repetition.train(docs)).drop("text")


def p10_recall(spark: SparkSession, d: str) -> DataFrame:
    """Cases by the exact rule over all documents, and those that come through the forest and its bound."""
    docs = table(spark, d, "documents", "doc_id", "text")
    every = repetition.shares(docs).filter(repetition.case("n_repeated")).agg(F.count(F.lit(1)).alias("n_cases"))
    return every.withColumn("n_found", p10_found(spark, d).agg(F.count(F.lit(1)).alias("n")).scalar())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p3_distinct, p3_bound, p5_found, p5_groups, p5_residue_groups, p5_recall, p6_found, p6_top, p8_ids, p8_round_trip, p9_containers, p9_fill, p10_found, p10_shares, p10_scores, p10_recall)
}



def _similar_sql(column: str, least: int) -> str:
    """cls (s, n, class_id), edge (a, b) both ways, rows_ (row_id, s): strings within a tenth of the longer one's letters."""
    return f"""
        rows_ as (select row_id, regexp_replace(upper({column}), '[^A-Z]', '', 'g') as s from regression_input where {column} is not null),
        cls as (select s, length(s) as n, min(row_id) as class_id from rows_ where length(s) >= {least} group by s),
        pair as (select a.class_id as a, b.class_id as b from cls a join cls b on a.class_id < b.class_id and abs(a.n - b.n) * 10 <= greatest(a.n, b.n) where levenshtein(a.s, b.s) * 10 <= greatest(a.n, b.n)),
        edge as (select a, b from pair union all select b, a from pair), deg as (select a as class_id, count(*) as n_links from edge group by 1)"""


def _groups_sql(column: str, least: int) -> str:
    return f"""
        with recursive {_similar_sql(column, least)},
        reach as (select class_id as a, class_id as b from cls union select r.a, e.b from reach r join edge e on e.a = r.b),
        grp as (select a as class_id, min(b) as group_id from reach group by 1)
        select row_id as id, class_id, group_id, coalesce(n_links, 0) as n_links from rows_ join cls using (s) join grp using (class_id) left join deg using (class_id)"""


_BLANKS = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' '"
#: Letters n of each text and the repeated ones.
_REPEATED = r"""
        t as (select doc_id, coalesce(length(regexp_replace(lower(text), '[^\p{L}\p{N}]', '', 'g')), 0) as n, coalesce(regexp_replace(lower(text), '[^\p{L}\p{N}]', '', 'g'), '') as s from documents),
        w as (select doc_id, n, s, unnest(range(1, n - 30)) as p from t where n > 32),
        x as (select doc_id, n, p, count(*) over (partition by doc_id, substr(s, p, 32)) as k from w),
        y as (select doc_id, n, p, coalesce(lag(p) over (partition by doc_id order by p), -40) as before from x where k > 1),
        c as (select doc_id, n, sum(least(32, p - before)) as rep from y group by doc_id, n)"""
ORACLE: dict[str, str] = {
    "p3_bound": """
        with t as (select cast(run_ts as date) as day, v_call, junction_aa from regression_input where junction_aa is not null)
        select 'day' as level, day, cast(null as varchar) as v_call, count(distinct junction_aa) as n_exact, true as within from t group by day
        union all select 'day_call', day, v_call, count(distinct junction_aa), true from t group by day, v_call
        union all select 'call', cast(null as date), v_call, count(distinct junction_aa), true from t group by v_call
        union all select 'all', cast(null as date), cast(null as varchar), count(distinct junction_aa), true from t""",
    "p5_found": """
        with t as (select distinct regexp_replace(upper(junction), '[^A-Z]', '', 'g') as s from regression_input where junction is not null),
        u as (select s, length(s) as n from t where length(s) >= 90)
        select a.s as junction_a, b.s as junction_b from u a join u b on a.s < b.s and abs(a.n - b.n) * 10 <= greatest(a.n, b.n)
        where levenshtein(a.s, b.s) * 10 <= greatest(a.n, b.n)""",
    "p5_groups": _groups_sql("junction", 90),
    "p5_residue_groups": _groups_sql("junction_aa", 30),
    "p5_recall": f"with {_similar_sql('junction', 90)} select row_id as id, coalesce(n_links, 0) as n_links from rows_ join cls using (s) left join deg using (class_id) where row_id % 100 = 0",
    "p6_found": f"""
        select upper(trim(junction_aa, {_BLANKS})) as junction_aa from regression_input where junction_aa is not null
        group by 1 having count(*) >= 0.002 * (select count(*) from regression_input)""",
    "p6_top": f"""
        select upper(trim(junction_aa, {_BLANKS})) as junction_aa, count(*) as n from regression_input where junction_aa is not null
        group by 1 order by n desc, junction_aa limit 100""",
    "p8_round_trip": "select count(*) as n_docs, count(*) as n_same from documents",
    "p9_fill": "select count(distinct doc_id) as n_docs, 0 as n_empty_pieces, 0 as n_over, true as well_filled from documents",
    "p10_found": f"with {_REPEATED} select doc_id from c where 10 * rep >= 4 * n and n >= 64",
    "p10_shares": f"with {_REPEATED} select doc_id, cast(n as integer) as n_letters, cast(coalesce(rep, 0) as integer) as n_repeated, case when n > 0 then round(coalesce(rep, 0) / n, 9) else 0.0 end as repeated_share from t left join c using (doc_id, n)",
    "p10_recall": f"with {_REPEATED} select count(*) as n_cases, count(*) as n_found from c where 10 * rep >= 4 * n and n >= 64",
}
