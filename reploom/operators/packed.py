"""Several values packed in one field: one value a row, with field and place.

Values that are a single call are passed on in the JVM. The others are segmented: an Aho-Corasick automaton over the known
calls finds whole dictionary values, and dynamic programming picks the best cover of the text by quoted stretches, dictionary
values and runs of call characters, so delimiters inside a legitimate value are kept and everything else separates.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from reploom.functions import text as tx

_RUN = re.compile(r"[A-Za-z0-9*/\-]+")
_QUOTED = re.compile(r'"((?:[^"]|"")*)"')
_CALL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789*/-")
#: Cost of an arc: fewer and better known pieces win; a skipped call character is dear.
_KNOWN, _PLAIN, _SKIP, _LOST = 0.5, 1.0, 0.01, 50.0
#: Segmented values a task remembers.
_MEMO = 100_000


def automaton(known: list[str]) -> ahocorasick.Automaton | None:
    """Automaton of the known whole values; None without any."""
    auto = ahocorasick.Automaton()
    for word in known:
        if word:
            auto.add_word(word, word)
    if not len(auto):
        return None
    auto.make_automaton()
    return auto


def segment(value: str, auto: ahocorasick.Automaton | None) -> list[str]:
    """The calls of a value in order: the cheapest cover of the text."""
    n = len(value)
    arcs: dict[int, list[tuple[int, float, str | None]]] = {}
    inside = bytearray(n + 1)
    pos = 0
    while (m := _QUOTED.search(value, pos)) is not None:
        body = m[1].replace('""', '"').strip(tx.BLANKS)
        arcs[m.start()] = [(m.end(), _PLAIN, body or None)]
        inside[m.start() + 1 : m.end()] = b"\x01" * (m.end() - m.start() - 1)
        pos = m.end()

    def whole(a: int, b: int) -> bool:
        return (a == 0 or value[a - 1] not in _CALL_CHARS) and (b == n or value[b] not in _CALL_CHARS)

    if auto is not None:
        for last, word in auto.iter(value):
            a, b = last - len(word) + 1, last + 1
            if whole(a, b) and not inside[a] and value[a] != '"':
                arcs.setdefault(a, []).append((b, _KNOWN, word))
    for m in _RUN.finditer(value):
        if not inside[m.start()]:
            arcs.setdefault(m.start(), []).append((m.end(), _PLAIN, m[0]) if m[0].lower() != "or" else (m.end(), _SKIP, None))
    best, came = [float("inf")] * (n + 1), [None] * (n + 1)
    best[0] = 0.0
    for i in range(n):
        if best[i] == float("inf"):
            continue
        out = arcs.get(i)
        if not (out and value[i] == '"'):
            out = [*(out or ()), (i + 1, _LOST if value[i] in _CALL_CHARS else _SKIP, None)]
        for j, cost, piece in out:
            if best[i] + cost < best[j]:
                best[j], came[j] = best[i] + cost, (i, piece)
    calls, j = [], n
    while j > 0:
        j, piece = came[j]
        if piece is not None:
            calls.append(piece)
    return calls[::-1]


def split_calls(df: DataFrame, known: DataFrame, id_col: str = "row_id", fields: tuple[str, ...] = ("v_call", "d_call", "j_call"), known_col: str = "gene_call", only_packed: bool = False, max_known: int = 100_000) -> DataFrame:
    """(id, field_name, call_no from 1, gene_call), no shuffle, each field segmented once.

    Null, empty and blank fields give no row; repeated calls are kept; a quote that is never closed separates like any other
    mark. only_packed keeps fields of two calls or more. The dictionary is collected to the driver up to max_known entries
    and an error beyond; it guides the cover but a call that it lacks is still found as a run.
    """
    words = [r[0] for r in known.select(known_col).filter(F.col(known_col).isNotNull()).distinct().limit(max_known + 1).collect()]
    if len(words) > max_known:
        raise ValueError(f"the dictionary has more than {max_known} entries")
    words.sort()
    pairs = ", ".join(f"'{f}', `{f}`" for f in fields)
    long = df.select(F.col(id_col).alias("row_id"), *fields).selectExpr("row_id", f"stack({len(fields)}, {pairs}) as (field_name, value)").filter("value is not null")
    single = F.col("value").rlike(r"^[A-Za-z0-9*/\-]+$") & (F.lower("value") != "or")

    @F.pandas_udf("array<string>")
    def cut_up(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        auto = automaton(words)
        memo: dict[str, list[str]] = {}
        for values in batches:
            if len(memo) > _MEMO:
                memo.clear()
            yield pd.Series([None if v is None else memo[v] if v in memo else memo.setdefault(v, segment(v, auto)) for v in values], dtype="object")

    # nondeterministic, so that no filter on its result is pushed below it and segments every field again
    cut_up = cut_up.asNondeterministic()
    long = long.filter(F.col("value").rlike(r"[^,;|&\s]"))
    if only_packed:
        calls = long.filter(~single).select("row_id", "field_name", cut_up("value").alias("calls")).filter(F.size("calls") >= 2)
    else:
        calls = long.withColumn("one", single).select("row_id", "field_name", "value", "one", cut_up(F.when(~F.col("one"), F.col("value"))).alias("many"))
        calls = calls.select("row_id", "field_name", F.when(F.col("one"), F.array("value")).otherwise(F.col("many")).alias("calls"))
    return calls.select("row_id", "field_name", F.posexplode("calls").alias("p", "gene_call")).select("row_id", "field_name", (F.col("p") + 1).cast("bigint").alias("call_no"), "gene_call")
