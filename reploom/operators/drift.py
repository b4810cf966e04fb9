"""Schemas that drift between the files of a feed: change report and one consistent table.

Each file's records are a schema graph: a record node with one node a field, linked to its name, its JSON types and its nested
keys. For consecutive files of a feed, similarity flooding propagates match scores between the fields that went and those
that came, starting from name likeness and the agreement of values on records delivered in both files, until they converge.
The pairs that flooding keeps are the only ones that the exact value check sees, and that check decides what counts as renamed.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reploom.functions import text as tx
from reploom.session import cut

#: A pair is a correspondence if its flooded score is at least this share of the best score of either of its fields.
FLOOR = 0.2
#: Shares of name likeness and of value agreement in the scores that flooding starts from.
NAME_SHARE, VALUE_SHARE = 0.4, 0.6


def parse_payloads(records: DataFrame, id_col: str = "record_id", file_col: str = "file_id", payload_col: str = "payload", key: str = "sequence_id") -> DataFrame:
    """(record_id, file_id, seq_id, fields): each key of the JSON object with its type, canonical value and nested keys, parsed in the JVM.

    A payload that is null, no JSON or no object is left out. Of a key that occurs twice the last counts. Kinds are string, boolean, integer,
    number, array and object, null for a JSON null; numbers with a point keep one in their canonical value and object keys are in order.
    """
    src = records.select(F.col(id_col).alias("record_id"), F.col(file_col).alias("file_id"), F.expr(f"map_entries(from_json(`{payload_col}`, 'map<string,variant>'))").alias("e")).filter("e is not null")
    kind = """case when is_variant_null(y.value) then null when y.t like 'ARRAY%' then 'array' when y.t like 'OBJECT%' then 'object' when y.t = 'STRING' then 'string' when y.t = 'BOOLEAN' then 'boolean'
        when y.t like '%INT' or y.t rlike '^DECIMAL[(](19|[23][0-9]),0[)]$' then 'integer' else 'number' end"""
    typed = src.withColumn("e", F.expr("transform(e, x -> struct(x.key as key, x.value as value, schema_of_variant(x.value) as t))"))
    typed = typed.withColumn("e", F.expr(f"transform(e, y -> struct(y.key as name, {kind} as kind, to_json(y.value) as text))"))
    field = """struct(x.name as name, x.kind as kind, case when x.kind is null then null when x.kind = 'number' and not x.text rlike '[.eE]' then concat(x.text, '.0') else x.text end as value,
        case when x.kind = 'object' then array_sort(json_object_keys(x.text)) else array() end as nested)"""
    last = "case when size(array_distinct(transform(e, x -> x.name))) < size(e) then filter(e, (x, i) -> not exists(slice(e, i + 2, size(e)), y -> y.name = x.name)) else e end"
    rows = typed.withColumn("e", F.expr(last)).withColumn("fields", F.expr(f"transform(e, x -> {field})"))
    return rows.select("record_id", "file_id", F.get(F.filter("fields", lambda f: f["name"] == key), F.lit(0))["value"].alias("seq_id"), "fields")


def file_schemas(parsed: DataFrame) -> DataFrame:
    """(file_id, name, kinds, nested): the fields of each file; kinds without those of nulls. Combined on the map side."""
    f = parsed.select("file_id", F.explode("fields").alias("f")).select("file_id", "f.name", "f.kind", "f.nested")
    return f.groupBy("file_id", "name").agg(F.sort_array(F.collect_set("kind")).alias("kinds"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("nested")))).alias("nested"))


def consecutive(files: DataFrame) -> DataFrame:
    """(feed, file_id, prev_id): each file with the one of the same feed and next smaller file_no; null for the first.

    Files without a file_no are left out; of equal numbers the smaller file_id goes first.
    """
    w = Window.partitionBy("feed").orderBy("file_no", "file_id")
    return files.select("feed", "file_id", "file_no").filter("file_no is not null").withColumn("prev_id", F.lag("file_id").over(w)).select("feed", "file_id", "prev_id")


def _paired(parsed_schemas: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, prev_id, name, old_kinds, new_kinds, old_nested, new_nested) over the full outer match by name."""
    steps = consecutive(files).filter("prev_id is not null").select("file_id", "prev_id")
    new = steps.join(parsed_schemas, "file_id").select("file_id", "prev_id", "name", F.col("kinds").alias("new_kinds"), F.col("nested").alias("new_nested"))
    old = steps.join(parsed_schemas.withColumnRenamed("file_id", "prev_id"), "prev_id").select("file_id", "prev_id", "name", F.col("kinds").alias("old_kinds"), F.col("nested").alias("old_nested"))
    return old.join(new, ["file_id", "prev_id", "name"], "full_outer")


def _prepare(files: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parsed records and paired schemas, each materialised once in the shared checkpoint folder."""
    parsed = cut(parse_payloads(records))
    return parsed, cut(_paired(file_schemas(parsed), files))


def name_likeness(a: str, b: str) -> float:
    """Similarity of two field names from 0 to 1: shared letter pairs and shared words, without case."""
    x, y = a.lower(), b.lower()
    if x == y:
        return 1.0
    pairs = [{s[i : i + 2] for i in range(len(s) - 1)} for s in (x, y)]
    words = [set(re.findall(r"[a-z]+|\d+", re.sub(r"([a-z])([A-Z])", r"\1 \2", s).lower())) for s in (a, b)]
    dice = 2 * len(pairs[0] & pairs[1]) / max(1, len(pairs[0]) + len(pairs[1]))
    return max(dice, len(words[0] & words[1]) / max(1, len(words[0] | words[1])))


@lru_cache(maxsize=100_000)
def flood(old: tuple, new: tuple, agreement: tuple, rounds: int = 50, eps: float = 1e-4) -> dict[tuple[str, str], float]:
    """Scores of the pairs (old name, new name) at convergence, the best being 1. Equal graphs are flooded once a worker.

    old, new: (name, kinds, nested keys) of each field; agreement: ((old name, new name), share of equal values). Graph nodes are the record, fields, types
    and nested keys; an edge label links equal roles, and a pair of nodes passes its score to the pairs of its neighbours in equal parts by label.
    """
    agree, root = dict(agreement), ("record", "", "")
    start: dict[tuple, float] = {root: 1.0}
    links: dict[tuple, set[tuple]] = {root: set()}

    def link(a: tuple, b: tuple) -> None:
        links.setdefault(a, set()).add(b)
        links.setdefault(b, set()).add(a)

    for a, ka, na in old:
        for b, kb, nb in new:
            pair = ("field", a, b)
            start[pair] = max(0.01, NAME_SHARE * name_likeness(a, b) + VALUE_SHARE * agree.get((a, b), 0.0))
            link(root, pair)
            for x in ka or ("none",):
                for y in kb or ("none",):
                    t = ("type", x, y)
                    start[t] = 1.0 if x == y else 0.1
                    link(pair, t)
            for x in na:
                for y in nb:
                    t = ("nested", x, y)
                    start[t] = name_likeness(x, y)
                    link(pair, t)
    nodes = list(start)
    at = {n: i for i, n in enumerate(nodes)}
    passes = np.zeros((len(nodes), len(nodes)))
    for node, near in links.items():
        roles = Counter(n[0] for n in near)
        for n in near:
            passes[at[n], at[node]] = 1 / roles[n[0]]
    base = np.array([start[n] for n in nodes])
    score = base
    for _ in range(rounds):
        nxt = base + score + passes @ score
        nxt = nxt / nxt.max()
        moved = float(np.linalg.norm(nxt - score))
        score = nxt
        if moved < eps:
            break
    fields = {(n[1], n[2]): float(score[at[n]]) for n in nodes if n[0] == "field"}
    top = max(fields.values(), default=1.0)
    return {k: v / top for k, v in fields.items()}


def agreement(parsed: DataFrame, paired: DataFrame) -> DataFrame:
    """(file_id, old_name, old_kinds, old_nested, new_name, new_kinds, new_nested, n_both, n_equal) of every field that went with every one that came.

    n_both counts the different value pairs under one sequence_id, both not null, n_equal those of equal values. Only values of fields that went or came
    are exploded, picked by two small lists a file.
    """
    gone = paired.filter("new_kinds is null").select("file_id", "prev_id", F.col("name").alias("old_name"), "old_kinds", "old_nested")
    came = paired.filter("old_kinds is null").select("file_id", F.col("name").alias("new_name"), "new_kinds", "new_nested")
    pairs = gone.join(came, "file_id")
    # one row a file, its lists as wide as a schema
    steps = gone.groupBy("file_id", "prev_id").agg(F.collect_set("old_name").alias("went")).join(came.groupBy("file_id").agg(F.collect_set("new_name").alias("new")), "file_id")
    sides = steps.select(F.explode(F.array(F.struct(F.col("prev_id").alias("file"), F.lit(True).alias("old"), F.col("went").alias("names")), F.struct(F.col("file_id").alias("file"), F.lit(False).alias("old"), F.col("new").alias("names")))).alias("s"), F.col("file_id").alias("step")).select("step", "s.*")
    picked = parsed.filter("seq_id is not null").join(sides, F.col("file_id") == F.col("file")).select(
        "step", "old", "seq_id", F.explode(F.filter("fields", lambda f: f["value"].isNotNull() & F.array_contains("names", f["name"]))).alias("f")
    ).select("step", "old", "seq_id", "f.name", "f.value").distinct()
    side = lambda old, name: picked.filter(F.col("old") == F.lit(old)).select("step", "seq_id", F.col("name").alias(f"{name}_name"), F.col("value").alias(f"{name}_value"))
    same = side(True, "old").join(side(False, "new"), ["step", "seq_id"]).groupBy(F.col("step").alias("file_id"), "old_name", "new_name").agg(
        F.count(F.lit(1)).alias("n_both"), F.count_if(F.col("old_value") == F.col("new_value")).alias("n_equal")
    )
    return pairs.join(same, ["file_id", "old_name", "new_name"], "left").na.fill(0, ["n_both", "n_equal"])


def correspondences(known: DataFrame) -> DataFrame:
    """(file_id, old_name, new_name, score, chosen, n_both, n_equal): the pairs of agreement() that flooding proposes, and no others.

    score is the flooded similarity, at least FLOOR of the best of either field; chosen marks the consistent one-to-one selection (stable, best
    score first).
    """
    out = "array<struct<old_name:string,new_name:string,score:double,chosen:boolean,n_both:bigint,n_equal:bigint>>"

    @F.pandas_udf(out)
    def select(files: pd.Series) -> pd.Series:
        return pd.Series([propose(pairs) for pairs in files])

    # one row is the fields that came and went in one file: bounded by the width of a schema, not by its records
    cols = ["old_name", "old_kinds", "old_nested", "new_name", "new_kinds", "new_nested", "n_both", "n_equal"]
    grouped = known.groupBy("file_id").agg(F.collect_list(F.struct(*cols)).alias("pairs")).repartition(4 * known.sparkSession.sparkContext.defaultParallelism, "file_id")
    return grouped.select("file_id", F.inline(select("pairs")))


def propose(pairs, scores: Callable[[tuple, tuple, tuple], dict[tuple[str, str], float]] = flood) -> list[dict]:
    """One file's pairs whose flooded score reaches FLOOR of the best of either field, with the stable one-to-one choice, best score first.

    A pair without a score above 0 is not proposed, whatever its values.
    """
    old = tuple(sorted({(p["old_name"], tuple(p["old_kinds"]), tuple(p["old_nested"])) for p in pairs}))
    new = tuple(sorted({(p["new_name"], tuple(p["new_kinds"]), tuple(p["new_nested"])) for p in pairs}))
    agree = {(p["old_name"], p["new_name"]): p["n_equal"] / p["n_both"] if p["n_both"] else 0.0 for p in pairs}
    score = scores(old, new, tuple(sorted(agree.items())))
    top: dict[tuple[int, str], float] = {}
    for (a, b), s in score.items():
        top[0, a], top[1, b] = max(top.get((0, a), 0.0), s), max(top.get((1, b), 0.0), s)
    kept = {k for k, s in score.items() if s > 0 and s >= FLOOR * max(top[0, k[0]], top[1, k[1]])}
    left, right, chosen = {x[0] for x in old}, {x[0] for x in new}, set()
    for a, b in sorted(kept, key=lambda x: (-score[x], x)):
        if a in left and b in right:
            chosen.add((a, b))
            left.discard(a)
            right.discard(b)
    keep = ("old_name", "new_name", "n_both", "n_equal")
    named = [((p["old_name"], p["new_name"]), p) for p in pairs]
    return [{k: p[k] for k in keep} | {"score": score[at], "chosen": at in chosen} for at, p in named if at in kept]


def proposal_recall(files: DataFrame, records: DataFrame) -> DataFrame:
    """One row: n_agreeing pairs of fields that pass the value check on their own, and n_proposed of them that flooding proposes."""
    known = cut(agreement(*_prepare(files, records)))
    passes = (F.col("n_both") > 0) & (F.col("n_both") == F.col("n_equal"))
    proposed = correspondences(known).agg(F.count_if(passes).alias("n")).scalar()
    return known.agg(F.count_if(passes).alias("n_agreeing")).select("n_agreeing", proposed.alias("n_proposed"))


def changes(files: DataFrame, records: DataFrame) -> DataFrame:
    """(file_id, change_kind, field_name, new_name): renamed, added, removed and type_changed against the feed's previous file.

    A file of no readable record has no field, so the next one adds all of its own. Types of nulls do not count; a field that is
    null throughout in either file has not changed type. Where several proposed pairs pass the value check all are reported.
    """
    parsed, paired = _prepare(files, records)
    renamed = cut(correspondences(agreement(parsed, paired)).filter("n_both > 0 and n_both = n_equal").select("file_id", "old_name", "new_name"))
    gone = paired.filter("new_kinds is null").select("file_id", F.col("name").alias("field_name")).join(renamed.select("file_id", F.col("old_name").alias("field_name")), ["file_id", "field_name"], "left_anti")
    came = paired.filter("old_kinds is null").select("file_id", F.col("name").alias("field_name")).join(renamed.select("file_id", F.col("new_name").alias("field_name")), ["file_id", "field_name"], "left_anti")
    typed = paired.filter("old_kinds <> new_kinds and size(old_kinds) > 0 and size(new_kinds) > 0").select("file_id", F.col("name").alias("field_name"))

    def kind(df: DataFrame, name: str, new: Column) -> DataFrame:
        return df.select("file_id", F.lit(name).alias("change_kind"), "field_name", new.alias("new_name"))

    none = F.lit("")
    out = kind(renamed.withColumnRenamed("old_name", "field_name"), "renamed", F.col("new_name"))
    return out.unionAll(kind(came, "added", none)).unionAll(kind(gone, "removed", none)).unionAll(kind(typed, "type_changed", none))


def canonical_names(files: DataFrame, renamed: DataFrame) -> DataFrame:
    """(file_id, name, canonical) for every file in which a field goes by another name than its first one in the feed.

    renamed: (file_id, old_name, new_name), at most one pair a name and file. A group holds one row a file of the feed, not its records.
    """
    events = renamed.groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("old_name", "new_name"))).alias("pairs"))
    steps = files.select("feed", "file_id", "file_no").filter("file_no is not null").join(events, "file_id", "left")

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, alias = [], {}
        for r in pdf.sort_values(["file_no", "file_id"]).itertuples():
            moved = [(p["old_name"], p["new_name"]) for p in (r.pairs if r.pairs is not None else ())]
            roots = {new: alias.get(old, old) for old, new in moved}
            for old, _ in moved:
                alias.pop(old, None)
            alias.update({new: root for new, root in roots.items() if new != root})
            for new, root in roots.items():
                if new == root:
                    alias.pop(new, None)
            rows += [(r.file_id, name, root) for name, root in alias.items()]
        return pd.DataFrame(rows, columns=["file_id", "name", "canonical"])

    return steps.groupBy("feed").applyInPandas(follow, "file_id bigint, name string, canonical string")


def consistent_table(files: DataFrame, records: DataFrame) -> DataFrame:
    """record_id, file_id, seq_id, the main fields typed, and all fields by their first name as MAP<STRING, JSON text>.

    Values that do not cast are null in the typed columns and stay in the map. Two fields of a record that end under one name keep the
    first non-null one in name order. Records that are no JSON object are left out.
    """
    parsed, paired = _prepare(files, records)
    pairs = correspondences(agreement(parsed, paired)).filter("chosen and n_both > 0 and n_both = n_equal").select("file_id", "old_name", "new_name")
    names = canonical_names(files, pairs).groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "canonical"))).alias("alias"))
    rows = parsed.join(names, "file_id", "left")
    named = F.transform("fields", lambda f: F.struct(F.coalesce(F.col("alias")[f["name"]], f["name"]).alias("k"), f["value"].alias("v")))
    sort = F.filter(F.array_sort(named), lambda e: e["v"].isNotNull())
    keys = F.array_distinct(F.transform("e", lambda e: e["k"]))
    rows = rows.select("record_id", "file_id", "seq_id", sort.alias("e")).select(
        "record_id", "file_id", "seq_id", F.map_from_arrays(keys, F.transform(keys, lambda k: F.filter("e", lambda e: e["k"] == k)[0]["v"])).alias("fields")
    )

    def text(name: str) -> Column:
        v = F.col("fields")[name]
        array = F.array_join(F.from_json(v, "array<string>"), ",")
        gene = F.concat_ws("*", F.get_json_object(v, "$.gene"), F.get_json_object(v, "$.allele"))
        return F.when(v.startswith("["), array).when(v.startswith("{"), gene).when(v.startswith('"'), F.get_json_object(F.concat(F.lit('{"x":'), v, F.lit("}")), "$.x")).otherwise(v)

    return rows.select(
        "record_id", "file_id", text("sequence_id").alias("sequence_id"), text("junction_aa").alias("junction_aa"), text("v_call").alias("v_call"), text("j_call").alias("j_call"),
        text("duplicate_count").try_cast("double").cast("bigint").alias("duplicate_count"), tx.as_flag(text("productive")).alias("productive"), "fields",
    )
