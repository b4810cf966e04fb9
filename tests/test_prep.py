"""Rows that fail to parse, hot keys, packed fields, drifting schemas: brute force, nulls, empties, ties, clashing names."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from reploom.operators import bad_rows, drift, hot_keys, packed

HEAD = "sequence_id\tjunction_aa\tproductive\tnote"


def parsed(spark, lines, header=HEAD):
    rows = [(i + 1, "f", i + 1, x) for i, x in enumerate([header, *lines])]
    df = spark.createDataFrame(rows, "line_id bigint, file_name string, line_no int, raw_line string")
    return {r["rec_id"]: r for r in bad_rows.parse_lines(df).collect()}


def test_lines(spark):
    lines = ["a\tCASS\tTrue\t", 'b\tCASS\tTrue\t"x\ty"', 'c\tCASS\tTrue\t"x', "d\tCASS\tTrue", "e\t12\tmaybe\t", "   ", HEAD, "﻿" + HEAD + "\r", 'f\t"C""S"\tno\t', "g\t caß \t\tq\r", 'h\tCASS\tTrue\tx"y', None, 'i\tCASS\tTrue\t"a"b', 'j\t***\tTrue\t""']
    got = parsed(spark, lines)
    reasons = {k: list(r["reasons"]) for k, r in got.items()}
    assert reasons == {2: [], 3: [], 4: ["quoting"], 5: ["column_count"], 6: ["junction_aa", "productive"], 10: ["junction_aa"], 11: [], 12: [], 14: ["quoting"], 15: ["junction_aa"]}
    assert got[3]["note"] == "x\ty" and got[12]["note"] == 'x"y'


def test_typed_lines(spark):
    rows = [(1, "f", 1, "duplicate_count,productive,junction_aa"), (2, "f", 2, "3.0,yes, CASS "), (3, "f", 3, "x,,CASS"), (4, "g", 2, "1,t,CASS")]
    p = bad_rows.parse_lines(spark.createDataFrame(rows, "line_id bigint, file_name string, line_no int, raw_line string"))
    got = {r["rec_id"]: (r["duplicate_count"], r["productive"], r["junction_aa"]) for r in bad_rows.typed_lines(p).collect()}
    assert got == {2: (3, True, "CASS"), 3: (None, None, "CASS")}
    assert [list(r["reasons"]) for r in p.filter("rec_id = 4").collect()] == [["no_header"]]


def test_other_fields_are_kept(spark):
    got = parsed(spark, ["CASS\tu1\t7\tu2", "CASS\tu1\t7\tu2\t"], "junction_aa\tumi\tNovel\tumi")
    assert got[2]["rest"] == {"umi": "u1", "novel": "7", "umi#2": "u2"} and got[2]["junction_aa"] == "CASS"
    assert list(got[3]["reasons"]) == ["column_count"] and got[3]["rest"] is None


def test_whole_row_pattern_matches_valid_tab_lines():
    schema = bad_rows.LineSchema("sequence_id\tproductive\tjunction_aa")
    for line in ("a\tTrue\tCASS", "a\t\t CASS ", 'a\t" t "\t"\tCASS"', '"x\ty"\tno\tcas*'):
        assert schema.whole.match(line) and schema.parse(line)[1] == []
    assert schema.whole.match("a\tTrue\tCASS\t") is None and schema.parse("a\tTrue\tCASS\t")[1] == ["column_count"]


def test_lines_empty_and_long(spark):
    empty = spark.createDataFrame([], "line_id bigint, file_name string, line_no int, raw_line string")
    assert bad_rows.parse_lines(empty).count() == 0
    long = "a\tCASS\tTrue\t" + '"' + '""' * 50_000 + '"'
    assert list(parsed(spark, [long])[2]["reasons"]) == []


def _by_hand(line, delim, n):
    fields, i = [], 0
    while True:
        if line[i : i + 1] == '"':
            j = i + 1
            while True:
                k = line.find('"', j)
                if k < 0:
                    return "quoting"
                if line[k + 1 : k + 2] == '"':
                    j = k + 2
                    continue
                break
            if k + 1 < len(line) and line[k + 1] != delim:
                return "quoting"
            fields.append(line[i + 1 : k].replace('""', '"'))
            i = k + 1
        else:
            k = line.find(delim, i)
            k = len(line) if k < 0 else k
            fields.append(line[i:k])
            i = k
        if i >= len(line):
            break
        i += 1
    return fields if len(fields) == n else "column_count"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet='a",\n ', max_size=14))
def test_line_pattern_against_scanner(line):
    schema = bad_rows.LineSchema("x,y,z")
    values, reasons = schema.parse(line)
    assert (values if not reasons else reasons[0]) == _by_hand(line, ",", 3)


def test_records(spark):
    df = spark.createDataFrame([(1, "CASS", "t"), (2, None, None), (3, "", ""), (4, " cas* ", " No "), (5, "..", "01")], "row_id bigint, junction_aa string, productive string")
    got = {r["row_id"]: list(r["reasons"]) for r in bad_rows.record_reasons(df).collect()}
    assert got == {1: [], 2: [], 3: ["junction_aa"], 4: [], 5: ["junction_aa", "productive"]}


def test_hot_keys(spark):
    rows = [("A", "x", 1)] * 60 + [("B", None, None)] * 38 + [("C", "z", 2)] * 2
    df = spark.createDataFrame(rows, "v_call string, j_call string, duplicate_count bigint")
    got = {tuple(r[:3]): tuple(r[3:]) for r in hot_keys.per_key(df).collect()}
    assert got["v_call", "A", "-"] == (60, 60, 60, 1, 1) and got["pair", "B", ""] == (38, 0, None, None, None) and got["j_call", "-", "z"] == (2, 2, 4, 2, 2)
    assert {tuple(r[:3]) for r in hot_keys.heavy_keys(df).collect()} == {("v_call", "A", "-"), ("v_call", "B", "-"), ("j_call", "-", "x"), ("j_call", "-", ""), ("pair", "A", "x"), ("pair", "B", "")}
    assert hot_keys.per_key(df.limit(0)).count() == 0 and hot_keys.heavy_keys(df.limit(0)).count() == 0


KNOWN = ["TRBV1*01", "TRAV29/DV5*01", "TRBD1*01"]


@pytest.mark.parametrize(
    ("value", "calls"),
    [
        ("TRBV1*01,TRBD1*01", ["TRBV1*01", "TRBD1*01"]),
        ('"TRBV1*01; low","X ""p"""', ["TRBV1*01; low", 'X "p"']),
        ("TRAV29/DV5*01 Or TRBV1*01", ["TRAV29/DV5*01", "TRBV1*01"]),
        ("{a: b: c}", ["a", "b", "c"]),
        ("TRBV1*01x", ["TRBV1*01x"]),
        ('a "', ["a"]),
        ('"" , " "', []),
        ("ORF1 or", ["ORF1"]),
        ("", []),
        ("a,,a", ["a", "a"]),
    ],
)
def test_segment(value, calls):
    assert packed.segment(value, packed.automaton(KNOWN)) == calls
    assert packed.segment(value, None) == calls


def test_dictionary_protects_delimiters(spark):
    words = [*KNOWN, "IGHV1-2 (F), partial", "IGHD1;IGHD2"]
    value = "IGHV1-2 (F), partial; TRBV1*01,IGHD1;IGHD2|IGHD1"
    assert packed.segment(value, packed.automaton(words)) == ["IGHV1-2 (F), partial", "TRBV1*01", "IGHD1;IGHD2", "IGHD1"]
    assert packed.segment(value, None) == ["IGHV1-2", "F", "partial", "TRBV1*01", "IGHD1", "IGHD2", "IGHD1"]
    known, df = spark.createDataFrame([(w,) for w in words], "gene_call string"), spark.createDataFrame([(1, value, None, None)], "row_id bigint, v_call string, d_call string, j_call string")
    assert [r["gene_call"] for r in packed.split_calls(df, known, only_packed=True).orderBy("call_no").collect()] == packed.segment(value, packed.automaton(words))


def test_fields_are_segmented_once(spark):
    known = spark.createDataFrame([("a",)], "gene_call string")
    df = spark.createDataFrame([(1, "a|b", "x", None)], "row_id bigint, v_call string, d_call string, j_call string")
    for packed_only in (True, False):
        plan = packed.split_calls(df, known, only_packed=packed_only)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1


def test_split_calls(spark):
    known = spark.createDataFrame([(k,) for k in [*KNOWN, None]], "gene_call string")
    df = spark.createDataFrame([(1, "TRBV1*01", "a|b", None, 9), (2, None, "", "or", 9), (3, " x ", ";;", '"q,r"', 9)], "row_id bigint, v_call string, d_call string, j_call string, field_name int")
    every = sorted(tuple(r) for r in packed.split_calls(df, known).collect())
    assert every == [(1, "d_call", 1, "a"), (1, "d_call", 2, "b"), (1, "v_call", 1, "TRBV1*01"), (3, "j_call", 1, "q,r"), (3, "v_call", 1, "x")]
    assert sorted(tuple(r) for r in packed.split_calls(df, known, only_packed=True).collect()) == every[:2]
    assert packed.split_calls(df.limit(0), known).count() == 0


FILES = [(1, "A", 1), (2, "A", 3), (3, "A", 7), (4, "B", 1)]
RECORDS = [
    (1, {"sequence_id": "s1", "v_call": "V1", "n": 1, "note": None}), (1, {"sequence_id": "s2", "v_call": "V2", "n": 2}),
    (2, {"sequence_id": "s2", "bestv": "V2", "n": 2.5}), (2, {"sequence_id": "s3", "bestv": "V3", "n": 1.0, "extra": [1]}),
    (3, {"sequence_id": "s3", "V_CALL": "V9", "n": 1.0, "extra": {"a": 1}}), (4, {"x": True}),
]


def _feeds(spark, records=RECORDS):
    files = spark.createDataFrame(FILES, "file_id bigint, feed string, file_no int")
    rows = [(i, f, json.dumps(p)) for i, (f, p) in enumerate(records)] + [(98, 1, "[1]"), (99, 1, "{broken"), (100, 1, None)]
    return files, spark.createDataFrame(rows, "record_id bigint, file_id bigint, payload string")


def test_drift(spark):
    got = {tuple(r) for r in drift.changes(*_feeds(spark)).collect()}
    assert got == {
        (2, "renamed", "v_call", "bestv"), (2, "removed", "note", ""), (2, "added", "extra", ""), (2, "type_changed", "n", ""),
        (3, "removed", "bestv", ""), (3, "added", "V_CALL", ""), (3, "type_changed", "extra", ""),
    }


def test_consistent_table(spark):
    rows = {r["record_id"]: r for r in drift.consistent_table(*_feeds(spark)).collect()}
    assert set(rows) == set(range(6)) and rows[2]["v_call"] == "V2" and rows[2]["fields"]["v_call"] == '"V2"' and "v_call" not in rows[4]["fields"]


def test_drift_empty(spark):
    files, records = _feeds(spark)
    assert drift.changes(files, records.limit(0)).count() == 0 and drift.changes(files.limit(0), records).count() == 0


def test_payload_kinds(spark):
    text = '{"a": 1, "b": 1.0, "c": "x\\"y", "d": null, "e": [1, 2], "f": {"z": 1, "y": "q"}, "g": true, "h": 1e3, "i": 12345678901234567890123, "a": "2"}'
    rows = [(1, 1, text), (2, 1, "[1]"), (3, 1, "{broken"), (4, 1, None), (5, 1, "{}")]
    got = {r["record_id"]: {f["name"]: (f["kind"], f["value"], list(f["nested"])) for f in r["fields"]} for r in drift.parse_payloads(spark.createDataFrame(rows, "record_id bigint, file_id bigint, payload string")).collect()}
    assert got[5] == {} and set(got) == {1, 5} and got[1] == {
        "a": ("string", '"2"', []), "b": ("number", "1.0", []), "c": ("string", '"x\\"y"', []), "d": (None, None, []), "e": ("array", "[1,2]", []), "f": ("object", '{"y":"q","z":1}', ["y", "z"]),
        "g": ("boolean", "true", []), "h": ("number", "1000.0", []), "i": ("integer", "12345678901234567890123", []),
    }


def _pair(old, new, both=2, equal=2):
    return {"old_name": old, "old_kinds": ["string"], "old_nested": [], "new_name": new, "new_kinds": ["string"], "new_nested": [], "n_both": both, "n_equal": equal}


def test_flooding_decides_what_is_checked():
    pairs = [_pair("v_call", "bestv"), _pair("v_call", "memo", equal=0), _pair("note", "bestv", equal=0), _pair("note", "memo")]
    names = lambda rows: {(r["old_name"], r["new_name"]) for r in rows}
    right = {("v_call", "bestv"), ("note", "memo")}
    assert right <= names(drift.propose(pairs)) and names(r for r in drift.propose(pairs) if r["chosen"]) == right
    assert drift.propose(pairs, lambda old, new, agree: {k: 0.0 for k, _ in agree}) == []
    wrong = lambda old, new, agree: {k: 0.1 if k == ("v_call", "bestv") else 1.0 for k, _ in agree}
    assert ("v_call", "bestv") not in names(drift.propose(pairs, wrong))


def test_flooding_prefers_likely_names():
    old = (("v_call", ("string",), ()), ("n", ("integer",), ()))
    new = (("vcall", ("string",), ()), ("copies", ("integer",), ()))
    s = drift.flood(old, new, ())
    assert s["v_call", "vcall"] > s["v_call", "copies"] and s["n", "copies"] > s["n", "vcall"]
