"""Rows that fail to parse: valid rows typed, the others apart with the reason.

Delimited lines: the header of each file is a schema; every schema gets one anchored pattern that matches a whole valid
row, judged fields included. A line that fails it goes through single-field prefix patterns, left to right, which find the
first field whose quoting is broken, the wrong number of fields, or the judged fields that are invalid.
Records of a table are judged by the same value patterns as Catalyst expressions, without Python.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reploom.functions import text as tx

_FLAG = "|".join(sorted({*tx.TRUE_WORDS, *tx.FALSE_WORDS}, key=len, reverse=True))


def _rules(blanks: str) -> dict[str, str]:
    """Judged fields: the pattern of a valid value, blanks around it included."""
    b = f"[{blanks}]*+"
    return {"junction_aa": rf"{b}(?=[*.\-]*+\p{{L}})[\p{{L}}*.\-]++{b}", "productive": rf"{b}(?i:{_FLAG})?{b}"}


RULES = _rules(tx.BLANKS)
LINE_FIELDS = ("sequence_id", "v_call", "d_call", "j_call", "c_call", "junction_aa", "duplicate_count", "productive", "note")


class LineSchema:
    """The patterns of one header."""

    def __init__(self, header: str):
        line = clean_line(header.removeprefix("\ufeff"))
        self.line = line
        delim = "\t" if "\t" in line else ","
        self.field = regex.compile(rf'(?:"((?:[^"]++|"")*+)"|((?!")[^{delim}]*+))({delim}|\Z)')
        names = self.split(line)
        self.names = [n.strip().lower() for n in (names if names is not None else line.split(delim))]
        parts = []
        bare = _rules(tx.BLANKS.replace(delim, ""))  # outside quotes the delimiter is no blank
        for n in self.names:
            if rule := RULES.get(n):
                parts.append(rf'((?:"(?:{rule})"|(?:{bare[n]}))(?={delim}|\Z))')
            else:
                parts.append(rf'("(?:[^"]++|"")*+"(?={delim}|\Z)|(?!")[^{delim}]*+)')
        self.whole = regex.compile(r"\A" + delim.join(parts) + r"\Z")
        self.judged = [(i, n, regex.compile(RULES[n])) for i, n in enumerate(self.names) if n in RULES]
        self.keys: list[str] = []
        for n in self.names:
            seen = sum(k == n or k.startswith(f"{n}#") for k in self.keys)
            self.keys.append(f"{n}#{seen + 1}" if seen else n)

    def split(self, line: str) -> list[str] | None:
        """Field values by successive prefix matches; None where a quoted field is broken."""
        out, pos = [], 0
        while True:
            m = self.field.match(line, pos)
            if m is None:
                return None
            out.append(m[1].replace('""', '"') if m[1] is not None else m[2])
            if not m[3]:
                return out
            pos = m.end()

    def parse(self, line: str) -> tuple[list[str] | None, list[str]]:
        """(values, reasons): values without reasons are a valid row."""
        if m := self.whole.match(line):
            return [v[1:-1].replace('""', '"') if v[:1] == '"' else v for v in m.groups()], []
        values = self.split(line)
        if values is None:
            return None, ["quoting"]
        if len(values) != len(self.names):
            return None, ["column_count"]
        return values, list(dict.fromkeys(n for i, n, rule in self.judged if rule.fullmatch(values[i]) is None))


def clean_line(line: str) -> str:
    return line[:-1] if line.endswith("\r") else line


@lru_cache(maxsize=512)
def line_schema(header: str) -> LineSchema:
    return LineSchema(header)


def parse_lines(lines: DataFrame, id_col: str = "line_id", file_col: str = "file_name", no_col: str = "line_no", text_col: str = "raw_line") -> DataFrame:
    """rec_id, file, line_no, reasons ARRAY<STRING> (empty: valid), one STRING column for each of LINE_FIELDS and rest MAP<STRING, STRING>.

    Not judged and left out: line 1, null lines, lines of white space only, repeats of the file's header.
    A file without a line 1 gives the reason no_header for each of its lines. One carriage return at the end is no data.
    rest holds the fields of the header that are not in LINE_FIELDS; a name that occurs again goes there as name#2 and so on.
    Lines with a reason of quoting, column_count or no_header have neither. Extra input columns are ignored. Headers meet their
    lines in an equi join: a side that is small at run time is broadcast by AQE below the session's threshold, otherwise a file
    with a large share of the lines is split as a skewed join.
    """
    src = lines.select(F.col(id_col).alias("rec_id"), F.col(file_col).alias("file"), F.col(no_col).cast("int").alias("line_no"), F.col(text_col).alias("line"))
    heads = src.filter("line_no = 1").groupBy("file").agg(F.min_by("line", "rec_id").alias("header"))
    body = src.filter("line_no is distinct from 1 and line is not null").filter(tx.strip(F.regexp_replace("line", "^\ufeff", "")) != "")
    both = body.join(heads.withColumnRenamed("file", "_hf"), F.col("file").eqNullSafe(F.col("_hf")), "left").drop("_hf")
    fields = ", ".join(f"{f} string" for f in LINE_FIELDS)
    none = [None] * len(LINE_FIELDS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for rec_id, file, no, line, header in pdf.itertuples(index=False, name=None):
                if not isinstance(header, str):
                    rows.append((rec_id, file, no, ["no_header"], *none, None))
                    continue
                schema, line = line_schema(header), clean_line(line)
                if line.removeprefix("\ufeff") == schema.line:
                    continue
                values, reasons = schema.parse(line)
                if values is None:
                    rows.append((rec_id, file, no, reasons, *none, None))
                    continue
                got = dict(zip(schema.keys, values))
                rows.append((rec_id, file, no, reasons, *[got.pop(f, None) for f in LINE_FIELDS], got))
            yield pd.DataFrame(rows, columns=["rec_id", "file", "line_no", "reasons", *LINE_FIELDS, "rest"])

    return both.select("rec_id", "file", "line_no", "line", "header").mapInPandas(run, f"rec_id bigint, file string, line_no int, reasons array<string>, {fields}, rest map<string,string>")


def typed_lines(parsed: DataFrame) -> DataFrame:
    """The valid rows of parse_lines, typed: duplicate_count BIGINT (null unless integral), productive BOOLEAN (null if empty); rest as text."""
    n = F.col("duplicate_count").try_cast("decimal(38,6)")
    return parsed.filter(F.size("reasons") == 0).select(
        "rec_id", "file", "line_no", "sequence_id", "v_call", "d_call", "j_call", "c_call",
        tx.strip(F.col("junction_aa")).alias("junction_aa"),
        F.when(n == F.floor(n), n.try_cast("bigint")).alias("duplicate_count"),
        tx.as_flag(F.col("productive")).alias("productive"), "note", "rest",
    )


def record_reasons(df: DataFrame, seq_col: str = "junction_aa", flag_col: str = "productive") -> DataFrame:
    """df plus reasons ARRAY<STRING>: the names of the two judged fields that are invalid; null fields are valid."""
    bad = [F.when(~tx.is_sequence(F.col(seq_col)), F.lit("junction_aa")), F.when(~tx.is_flag(F.col(flag_col)), F.lit("productive"))]
    return df.withColumn("reasons", F.array_compact(F.array(*bad)))


def typed_records(df: DataFrame) -> DataFrame:
    """The valid records with productive as BOOLEAN and junction_aa stripped; null fields stay null."""
    ok = record_reasons(df).filter(F.size("reasons") == 0)
    return ok.select("row_id", "sequence_id", tx.strip(F.col("junction_aa")).alias("junction_aa"), tx.as_flag(F.col("productive")).alias("productive"), "v_call", "d_call", "j_call", "duplicate_count", "run_ts")


def found(lines: DataFrame, records: DataFrame) -> DataFrame:
    """(table_name, rec_id, reason) of every line and record that does not parse."""
    a = parse_lines(lines).select(F.lit("raw_lines").alias("table_name"), "rec_id", F.explode("reasons").alias("reason")).filter("reason <> 'no_header'")
    b = record_reasons(records.select("row_id", "junction_aa", "productive")).select(F.lit("regression_input").alias("table_name"), F.col("row_id").alias("rec_id"), F.explode("reasons").alias("reason"))
    return a.unionAll(b)
