"""Queries of the general preparation operators and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reploom.operators import bad_rows, drift, hot_keys, packed
from reploom.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return bad_rows.found(table(spark, d, "raw_lines"), table(spark, d, "regression_input", "row_id", "junction_aa", "productive"))


def p1_valid_lines(spark: SparkSession, d: str) -> DataFrame:
    """The valid lines as typed rows; the fields that have no column of their own as name=value lines in name order."""
    rows = bad_rows.typed_lines(bad_rows.parse_lines(table(spark, d, "raw_lines")))
    pairs = F.transform(F.array_sort(F.map_entries("rest")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return rows.withColumn("rest", F.array_join(pairs, "\n"))


def p1_valid_records(spark: SparkSession, d: str) -> DataFrame:
    return bad_rows.typed_records(table(spark, d, "regression_input"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return hot_keys.heavy_keys(table(spark, d, "regression_input")).select("key_kind", "v_key", "j_key")


def p2_keys(spark: SparkSession, d: str) -> DataFrame:
    return hot_keys.per_key(table(spark, d, "regression_input"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return packed.split_calls(table(spark, d, "regression_input"), table(spark, d, "gene_reference"), only_packed=True)


def p4_calls(spark: SparkSession, d: str) -> DataFrame:
    return packed.split_calls(table(spark, d, "regression_input"), table(spark, d, "gene_reference"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.changes(table(spark, d, "feed_files"), table(spark, d, "feed_records"))


def p7_table(spark: SparkSession, d: str) -> DataFrame:
    return drift.consistent_table(table(spark, d, "feed_files"), table(spark, d, "feed_records"))


def p7_recall(spark: SparkSession, d: str) -> DataFrame:
    return drift.proposal_recall(table(spark, d, "feed_files"), table(spark, d, "feed_records"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_valid_lines, p1_valid_records, p2_found, p2_keys, p4_found, p4_calls, p7_found, p7_recall, p7_table)
}

_B = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' '"
_SEQ_OK = f"(regexp_full_match(trim(x, {_B}), '[\\p{{L}}*.\\-]+') and regexp_matches(x, '\\p{{L}}'))"
_FLAG_OK = f"(lower(trim(x, {_B})) in ('', 't', 'true', '1', 'yes', 'f', 'false', '0', 'no'))"


def _ok(rule: str, x: str) -> str:
    return rule.replace("(x", f"({x}")


_LINES = rf"""
    heads as (select file_name, regexp_replace(regexp_replace(raw_line, '^\x{{FEFF}}', ''), '\r$', '') as header from raw_lines where line_no = 1),
    delims as (select file_name, header, case when contains(header, chr(9)) then chr(9) else ',' end as d from heads),
    lines as (select line_id, line_no, file_name, d, header, str_split(header, d) as names, regexp_replace(raw_line, '\r$', '') as line
        from raw_lines join delims using (file_name) where line_no <> 1 and trim(raw_line, {_B} || chr(65279)) <> ''),
    judged as (select *, case when d = ',' then regexp_full_match(line, '("([^"]|"")*"|[^",][^,]*|)(,("([^"]|"")*"|[^",][^,]*|))*')
            else regexp_full_match(line, '("([^"]|"")*"|[^"\t][^\t]*|)(\t("([^"]|"")*"|[^"\t][^\t]*|))*') end as quoted_well,
            case when d = ',' then regexp_extract_all(',' || line, ',("(?:[^"]|"")*"|[^",][^,]*|)', 1)
            else regexp_extract_all(chr(9) || line, '\t("(?:[^"]|"")*"|[^"\t][^\t]*|)', 1) end as raw
        from lines where regexp_replace(line, '^\x{{FEFF}}', '') <> header),
    fields as (select *, list_transform(raw, lambda f: case when starts_with(f, '"') then replace(f[2:-2], '""', '"') else f end) as v from judged)"""

#: Fields of each file, steps from file to file, and what became of each field.
_DRIFT = """
    f as (select file_id, lag(file_id) over (partition by feed order by file_no, file_id) as prev_id from feed_files where file_no is not null),
    r as (select file_id, cast(payload as json) as j from feed_records where json_valid(payload) and json_type(payload) = 'OBJECT'),
    kv as (select file_id, json_extract_string(j, '$.sequence_id') as seq, unnest(json_keys(j)) as name, j from r),
    ty as (select file_id, seq, name, json_type(j, '$."' || name || '"') as t, json_extract(j, '$."' || name || '"') as x from kv),
    v as (select file_id, seq, name, case t when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean' when 'BIGINT' then 'integer' when 'UBIGINT' then 'integer' when 'DOUBLE' then 'number' when 'ARRAY' then 'array' when 'OBJECT' then 'object' end as kind,
        case when t = 'OBJECT' then cast(list_sort(list_transform(json_keys(x), lambda k: k || '=' || json_extract(x, '$."' || k || '"'))) as varchar) else cast(x as varchar) end as value from ty),
    s as (select file_id, name, list_sort(list(distinct kind) filter (kind is not null)) as kinds from v group by 1, 2),
    o as (select f.file_id, f.prev_id, s.name, s.kinds from f join s on s.file_id = f.prev_id),
    n as (select f.file_id, f.prev_id, s.name, s.kinds from f join s on s.file_id = f.file_id where f.prev_id is not null),
    went as (select * from o anti join n using (file_id, name)), came as (select * from n anti join o using (file_id, name)),
    ov as (select distinct went.file_id, went.name, seq, value from went join v on v.file_id = went.prev_id and v.name = went.name where seq is not null and kind is not null),
    nv as (select distinct came.file_id, came.name, seq, value from came join v on v.file_id = came.file_id and v.name = came.name where seq is not null and kind is not null),
    ren as (select file_id, ov.name as field_name, nv.name as new_name from ov join nv using (file_id, seq) group by all having bool_and(ov.value = nv.value))"""

ORACLE: dict[str, str] = {
    "p7_found": f"""
        with {_DRIFT}
        select file_id, 'renamed' as change_kind, field_name, new_name from ren
        union all select file_id, 'removed', name, '' from went where (file_id, name) not in (select (file_id, field_name) from ren)
        union all select file_id, 'added', name, '' from came where (file_id, name) not in (select (file_id, new_name) from ren)
        union all select file_id, 'type_changed', name, '' from o join n using (file_id, name) where o.kinds <> n.kinds and len(o.kinds) > 0 and len(n.kinds) > 0""",
    "p7_recall": f"with {_DRIFT} select count(*) as n_agreeing, count(*) as n_proposed from ren",
    "p1_found": f"""
        with {_LINES}
        select 'raw_lines' as table_name, line_id as rec_id, 'quoting' as reason from fields where not quoted_well
        union all select 'raw_lines', line_id, 'column_count' from fields where quoted_well and len(v) <> len(names)
        union all select 'raw_lines', line_id, 'junction_aa' from fields where quoted_well and len(v) = len(names) and not {_ok(_SEQ_OK, "v[list_position(names, 'junction_aa')]")}
        union all select 'raw_lines', line_id, 'productive' from fields where quoted_well and len(v) = len(names) and not {_ok(_FLAG_OK, "v[list_position(names, 'productive')]")}
        union all select 'regression_input', row_id, 'junction_aa' from regression_input where not {_ok(_SEQ_OK, "junction_aa")}
        union all select 'regression_input', row_id, 'productive' from regression_input where not {_ok(_FLAG_OK, "productive")}""",
    "p1_valid_lines": f"""
        with {_LINES},
        named as (select *, v[nullif(list_position(names, 'junction_aa'), 0)] as x, v[nullif(list_position(names, 'productive'), 0)] as y from fields where quoted_well and len(v) = len(names)),
        ok as (select *, trim(x, {_B}) as aa, lower(trim(y, {_B})) as flag, try_cast(v[nullif(list_position(names, 'duplicate_count'), 0)] as decimal(38,6)) as n from named
            where coalesce({_SEQ_OK}, true) and coalesce({_ok(_FLAG_OK, "y")}, true))
        select line_id as rec_id, file_name as file, line_no, {", ".join(f"v[nullif(list_position(names, '{c}'), 0)] as {c}" for c in ("sequence_id", "v_call", "d_call", "j_call", "c_call", "note"))},
            aa as junction_aa, case when n = floor(n) then cast(n as bigint) end as duplicate_count, case when flag in ('t','true','1','yes') then true when flag in ('f','false','0','no') then false end as productive,
            coalesce(list_aggregate(list_sort(list_transform(list_filter(range(1, len(names) + 1), lambda i: names[i] not in ('sequence_id', 'v_call', 'd_call', 'j_call', 'c_call', 'junction_aa', 'duplicate_count', 'productive', 'note')),
                lambda i: names[i] || '=' || v[i])), 'string_agg', chr(10)), '') as rest
        from ok""",
    "p1_valid_records": f"""
        select row_id, sequence_id, trim(junction_aa, {_B}) as junction_aa,
            case when lower(trim(productive, {_B})) in ('t','true','1','yes') then true when lower(trim(productive, {_B})) in ('f','false','0','no') then false end as productive,
            v_call, d_call, j_call, duplicate_count, run_ts
        from regression_input where coalesce({_ok(_SEQ_OK, "junction_aa")}, true) and coalesce({_ok(_FLAG_OK, "productive")}, true)""",
    "p2_found": """
        with k as (select coalesce(v_call, '') as v, coalesce(j_call, '') as j from regression_input), t as (select count(*) as n from k)
        select 'v_call' as key_kind, v as v_key, '-' as j_key from k group by v having count(*) >= 0.04 * (select n from t)
        union all select 'j_call', '-', j from k group by j having count(*) >= 0.04 * (select n from t)
        union all select 'pair', v, j from k group by v, j having count(*) >= 0.04 * (select n from t)""",
    "p2_keys": """
        with k as (select coalesce(v_call, '') as v, coalesce(j_call, '') as j, duplicate_count as w from regression_input),
        s as (select 'v_call' as key_kind, v as v_key, '-' as j_key, w from k union all select 'j_call', '-', j, w from k union all select 'pair', v, j, w from k)
        select key_kind, v_key, j_key, count(*) as n_rows, count(w) as n_weighted, cast(sum(w) as bigint) as sum_weight, min(w) as min_weight, max(w) as max_weight
        from s group by all""",
    "p4_found": r"""
        with t as (select row_id, unnest(['v_call', 'd_call', 'j_call']) as field_name, unnest([v_call, d_call, j_call]) as x from regression_input),
        m as (select row_id, field_name, regexp_extract_all(x, '"(?:[^"]|"")*"|[A-Za-z0-9*/\-]+') as raw from t where x is not null),
        c as (select row_id, field_name, list_filter(list_transform(list_filter(raw, lambda r: lower(r) <> 'or'),
            lambda r: case when starts_with(r, '"') then trim(replace(r[2:-2], '""', '"'), chr(9)||chr(10)||chr(13)||' ') else r end), lambda r: r <> '') as calls from m)
        select row_id, field_name, unnest(range(1, len(calls) + 1)) as call_no, unnest(calls) as gene_call from c where len(calls) >= 2""",
}
ORACLE["p4_calls"] = ORACLE["p4_found"].replace("where len(calls) >= 2", "where len(calls) >= 1")
