"""Tokenisers as Catalyst expressions: greedy dictionary parse (LZ76) and bilateral run peeling (FlashBack).

All of them work on single characters of any script and have a defined result for the empty string (no LZ token, one level of end marks);
null gives null. The same parses exist as Arrow functions, which the builders use: a state machine over growing arrays is interpreted row by
row in Catalyst and measured about fifty times slower. Either way callers aggregate abundances first and parse distinct strings.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

START, END = "@", "$"
_LEVEL = "array<struct<front:string,back:string,ord:int,last:boolean,dst_a:string,dst_z:string>>"


def wrapped(s: Column) -> Column:
    return F.concat(F.lit(START), s, F.lit(END))


def chars(s: Column) -> Column:
    """ARRAY<STRING> of single characters."""
    return F.filter(F.split(s, ""), lambda c: c != "")


def lz76(s: Column) -> Column:
    """ARRAY<STRING>: extend while the current piece is a token already, emit at the first new piece; a trailing match is emitted as it is."""
    empty = F.struct(F.lit("").alias("cur"), F.array().cast("array<string>").alias("toks"))

    def step(acc: Column, c: Column) -> Column:
        x = F.concat(acc["cur"], c)
        known = F.array_contains(acc["toks"], x)
        return F.struct(F.when(known, x).otherwise(F.lit("")).alias("cur"), F.when(known, acc["toks"]).otherwise(F.array_append(acc["toks"], x)).alias("toks"))

    done = F.aggregate(chars(s), empty, step, lambda a: F.when(a["cur"] != "", F.array_append(a["toks"], a["cur"])).otherwise(a["toks"]))
    return F.when(s.isNotNull(), done)


def peel(s: Column, wrap: bool = True) -> Column:
    """ARRAY<STRUCT<front, back, ord, last, dst_a, dst_z>>: at each level the leading run of the first and the trailing run of the last character.

    A rest of one repeated character is a last token with an empty back; dst_a and dst_z are the outer characters of what lies inside.
    Levels of a string are at most half its length and one.
    """
    text = wrapped(s) if wrap else s
    empty = F.struct(text.alias("rest"), F.array().cast(_LEVEL).alias("toks"))

    def level(acc: Column, i: Column) -> Column:
        rest = acc["rest"]
        inner = F.ltrim(rest, F.left(rest, F.lit(1)))
        front = F.left(rest, F.length(rest) - F.length(inner))
        mid = F.rtrim(inner, F.right(inner, F.lit(1)))
        back = F.right(inner, F.length(inner) - F.length(mid))
        tok = F.struct(front.alias("front"), back.alias("back"), i.cast("int").alias("ord"), (mid == "").alias("last"), F.left(mid, F.lit(1)).alias("dst_a"), F.right(mid, F.lit(1)).alias("dst_z"))
        return F.when(rest == "", acc).otherwise(F.struct(mid.alias("rest"), F.array_append(acc["toks"], tok).alias("toks")))

    levels = F.sequence(F.lit(0), F.ceil(F.length(text) / 2).cast("int"))
    return F.when(s.isNotNull(), F.aggregate(levels, empty, level, lambda a: a["toks"]))


def peel_label(t: Column) -> Column:
    """SYMBOLS_SPLIT{ORDER}; the split of a last token is 0."""
    split = F.when(t["last"], F.lit(0)).otherwise(F.length(t["front"]))
    return F.concat(t["front"], t["back"], F.lit("_"), split.cast("string"), F.lit("{"), t["ord"].cast("string"), F.lit("}"))


def flashback(s: Column) -> Column:
    """ARRAY<STRING> of run-peeling labels."""
    return F.transform(peel(s), peel_label)


def flashback_reverse(labels: Column) -> Column:
    """The string that a sequence of run-peeling labels came from, without the end marks; the labels' own order counts."""

    def nest(inner: Column, label: Column) -> Column:
        sym = F.regexp_extract(label, r"(?s)^(.*)_(\d+)\{\d+\}$", 1)
        split = F.regexp_extract(label, r"(?s)^(.*)_(\d+)\{\d+\}$", 2).cast("int")
        return F.concat(F.left(sym, split), inner, F.right(sym, F.length(sym) - split))

    whole = F.aggregate(F.reverse(labels), F.lit(""), nest)
    return F.substring(whole, F.lit(2), F.length(whole) - 2)


def grammar_steps(s: Column) -> Column:
    """ARRAY<STRUCT<is_start, a, z, kind, a_run, z_run, dst_a, dst_z>>: the derivation of a string.

    The non-terminal is named by its boundary characters; a rule is internal (peels both runs and goes on inside) or one of the leaves
    leaf_single, leaf_run and leaf_pair.
    """
    first = lambda t: F.left(t["front"], F.lit(1))
    last = lambda t: F.when(t["back"] == "", F.left(t["front"], F.lit(1))).otherwise(F.right(t["back"], F.lit(1)))

    def step(t: Column) -> Column:
        kind = F.when(~t["last"], "internal").when(t["back"] != "", "leaf_pair").when(F.length(t["front"]) == 1, "leaf_single").otherwise("leaf_run")
        return F.struct((t["ord"] == 0).alias("is_start"), first(t).alias("a"), last(t).alias("z"), kind.alias("kind"), F.length(t["front"]).alias("a_run"), F.length(t["back"]).alias("z_run"), t["dst_a"].alias("dst_a"), t["dst_z"].alias("dst_z"))

    return F.transform(F.when(F.length(s) > 0, peel(s)), step)


def parse_lz(s: str) -> list[str]:
    """As lz76, of one string."""
    seen: set[str] = set()
    out, start = [], 0
    for end in range(1, len(s) + 1):
        piece = s[start:end]
        if piece not in seen:
            seen.add(piece)
            out.append(piece)
            start = end
    if start < len(s):
        out.append(s[start:])
    return out


def parse_peel(s: str) -> list[tuple[str, str, bool]]:
    """(front, back, last) of each level of an already wrapped string."""
    out, lo, hi = [], 0, len(s)
    while lo < hi:
        a, z = s[lo], s[hi - 1]
        i, j = lo + 1, hi - 1
        while i < hi and s[i] == a:
            i += 1
        if i == hi:
            out.append((s[lo:hi], "", True))
            break
        while j > i and s[j - 1] == z:
            j -= 1
        out.append((s[lo:i], s[j:hi], i >= j))
        lo, hi = i, j
    return out


def peel_labels(s: str) -> list[str]:
    """Run-peeling nodes of a string, as flashback."""
    return [f"{f}{b}_{0 if last else len(f)}{{{i}}}" for i, (f, b, last) in enumerate(parse_peel(f"{START}{s}{END}"))]


def lz_nodes(s: str, with_place: bool = True) -> tuple[list[str], list[str]]:
    """(tokens, nodes) of a wrapped parse; nodes are token_end, or the tokens themselves without places."""
    toks = parse_lz(f"{START}{s}{END}")
    if not with_place:
        return toks, toks
    at, labels = 0, []
    for t in toks:
        at += len(t)
        labels.append(f"{t}_{at}")
    return toks, labels


def labels_arrow(variant: str) -> Callable[[Column], Column]:
    """STRUCT<toks, labels> of a string by an Arrow function; the variant is flashback, aap, ndp or naive."""

    def one(s: str | None) -> tuple[list[str] | None, list[str] | None]:
        if s is None:
            return None, None
        if variant == "flashback":
            labels = peel_labels(s)
            return labels, labels
        return lz_nodes(s, variant != "naive")

    @F.pandas_udf("toks array<string>, labels array<string>")
    def run(seqs: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(s) for s in seqs], columns=["toks", "labels"])

    # declared nondeterministic so that filters on its result are not pushed below the aggregation, which would parse every row
    return run.asNondeterministic()


def grammar_rules(s: str | None) -> list[tuple[bool, str, str, str, int, int, str, str]]:
    """The derivation of one string as grammar_steps; none for the empty one."""
    levels = parse_peel(f"{START}{s}{END}") if s else []
    rules = []
    for i, (f, b, last) in enumerate(levels):
        inner = None if last else levels[i + 1]
        kind = "internal" if not last else "leaf_pair" if b else "leaf_single" if len(f) == 1 else "leaf_run"
        rules.append((i == 0, f[0], (b or f)[-1], kind, len(f), len(b), inner[0][0] if inner else "", (inner[1] or inner[0])[-1] if inner else ""))
    return rules


def grammar_steps_arrow(s: Column) -> Column:
    """As grammar_steps, by an Arrow function."""
    names = ("is_start", "a", "z", "kind", "a_run", "z_run", "dst_a", "dst_z")

    @F.pandas_udf("array<struct<is_start:boolean,a:string,z:string,kind:string,a_run:int,z_run:int,dst_a:string,dst_z:string>>")
    def run(seqs: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(names, r)) for r in grammar_rules(x)] for x in seqs])

    return run.asNondeterministic()(s)
