"""Near-duplicate strings with small edits.

Candidates come from pivotal grams and none is missed: of tau + 1 disjoint grams of a string, tau edits leave at least one whole, so a
string within tau edits holds that gram, shifted by no more than the edits on either side. Every string posts all its grams in inverted
lists; the longer one of a pair probes with tau + 1 of its own, the rarest disjoint ones, so that grams many strings share (the ends) are
rarely asked for. No list is dropped, cut or sampled. Before a hit becomes a pair that is shuffled, the letters next to the gram have to
fit as well (see pivotal), so the pairs follow the similar strings and not the square of all. The exact edit distance verifies what is
left. Similar strings are grouped by connected components, and copies of a string are joined to its group, never expanded into pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType

from reploom.session import cut

#: Longest pivotal grams, for four letters and for more.
GRAM, GRAM_WIDE = 8, 5
#: Bits of a hashed gram, strings sampled for the weights of grams, letters up to which pivots are chosen by weight.
BITS, SAMPLE, LONG = 17, 4000, 2000
#: Places of a string that share a key with a gram.
SPAN = 16
#: Letters of a context, two bits each, and regions of it that are looked at.
CONTEXT, DEPTH = 31, 3


def bases(c: Column) -> Column:
    """Upper case, nothing but A to Z; null stays null."""
    return F.regexp_replace(F.upper(c), "[^A-Z]", "")


def residues(c: Column) -> Column:
    """As bases, for amino-acid text."""
    return bases(c)


def strings(df: DataFrame, value: Column, min_length: int, id_col: str | None = None) -> DataFrame:
    """(sid, s, n): the distinct strings of at least min_length letters; nulls and shorter ones are left out.

    sid is the least id of a string's rows, so different strings never share one; without an id column it is a 64-bit hash.
    """
    s = df.select(value.alias("s"), *([F.col(id_col).alias("sid")] if id_col else [])).filter(F.length("s") >= min_length)
    s = s.groupBy("s").agg(F.min("sid").alias("sid")) if id_col else s.distinct().withColumn("sid", F.xxhash64("s"))
    return s.select("sid", "s", F.length("s").alias("n"))


def gram_length(texts: DataFrame, letters: int = 4, max_rate: float = 0.1) -> int:
    """Letters of a pivotal gram: short enough that the shortest string holds one more, disjoint, than the edits allowed."""
    least = texts.agg(F.min("n")).first()[0] or 1
    return max(1, min(GRAM if letters == 4 else GRAM_WIDE, int(least / (max_rate * least + 1) + 1e-9)))


def _codes(x: np.ndarray, q: int) -> np.ndarray:
    """Hash of every gram of the rows of x, BITS bits."""
    wide = x.shape[1] - q + 1
    h = np.zeros((len(x), wide), dtype=np.uint64)
    for i in range(q):
        h = h * np.uint64(0x100000001B3) + x[:, i : i + wide]
    return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64)


def _points(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le"), dtype="<u4")


def gram_weights(texts: DataFrame, q: int) -> np.ndarray:
    """Counts of hashed grams in a bounded sample. They decide which grams are asked for first, never which pairs are found."""
    weight = np.ones(1 << BITS, dtype=np.float32)
    every = max(1, texts.count() // SAMPLE)
    for r in texts.filter(F.pmod("sid", F.lit(every)) == 0).select(F.substring("s", 1, LONG).alias("s")).collect():
        if len(r["s"]) >= q:
            np.add.at(weight, _codes(_points(r["s"])[None, :], q)[0], 1)
    return weight


def rarest(x: np.ndarray, q: int, m: int, weight: np.ndarray) -> np.ndarray:
    """(rows, m): places from 0 of the m disjoint grams of each row of x that weigh least together, in order."""
    rows, n = x.shape
    cost = weight[_codes(x, q)]
    best = [np.full((rows, m + 1), np.inf, dtype=np.float32)]
    best[0][:, 0] = 0
    take = [None]
    for i in range(1, n + 1):
        now, took = best[-1], None
        if i >= q:
            with_it = best[i - q][:, :-1] + cost[:, i - q, None]
            took = with_it < now[:, 1:]
            now = now.copy()
            np.minimum(now[:, 1:], with_it, out=now[:, 1:])
        best.append(now)
        take.append(took)
    out, left, at = np.zeros((rows, m), dtype=np.int32), np.full(rows, m), np.full(rows, n)
    for i in range(n, q - 1, -1):
        here = np.flatnonzero((at == i) & (left > 0))
        used = take[i][here, left[here] - 1]
        hit = here[used]
        at[here] = i - 1
        left[hit] -= 1
        out[hit, left[hit]] = i - q
        at[hit] = i - q
    return out


def _contexts(s: str) -> np.ndarray:
    """At i the CONTEXT letters that end with the i-th, i from 0 to all, the last in the low bits.

    Two bits tell A, C, G and T apart; other letters share them, which may only make strings look more alike.
    """
    x = np.zeros(len(s) + 1, dtype=np.int64)
    x[1:] = (_points(s) >> 1) & 3
    done = 1
    while done < CONTEXT:  # x holds done letters at each place
        more = min(done, CONTEXT - done)
        before = np.zeros_like(x)
        before[done:] = x[: max(0, len(x) - done)]
        x |= (before & ((1 << (2 * more)) - 1)) << (2 * done)
        done += more
    return x


def _alike(x: np.ndarray) -> np.ndarray:
    """Equal letters before the first difference of two contexts, x being their exclusive or."""
    return (np.bitwise_count(((x - 1) & ~x).view(np.uint64)) >> 1).astype(np.int64)


def fits(x: np.ndarray, y: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether for every e up to DEPTH the nearest sizes[:, e] letters of context x come from y by at most e edits.

    Furthest reach by edits and diagonal; the other end of y is free.
    """

    def on(i: np.ndarray, d: int) -> np.ndarray:
        i = np.minimum(i, CONTEXT)
        return np.minimum(i + _alike((x >> (2 * i)) ^ (y >> np.minimum(2 * (i + d), 2 * CONTEXT))), CONTEXT)

    reach = {0: on(np.zeros(len(x), dtype=np.int64), 0)}
    good = reach[0] >= sizes[:, 0]
    for e in range(1, DEPTH + 1):
        now = {}
        for d in range(-e, e + 1):
            ways = [reach[k] + step for k, step in ((d, 1), (d - 1, 0), (d + 1, 1)) if k in reach]
            now[d] = on(np.maximum.reduce(ways), d)
        reach = now
        good &= np.maximum.reduce(list(reach.values())) >= sizes[:, e]
    return good


@F.pandas_udf(ArrayType(LongType()))
def _posted(s: pd.Series, q: pd.Series) -> pd.Series:
    """Contexts in the order of postings: the string's end for each of its beginnings, the longest first, then what lies before each gram."""

    def one(t: str, k: int) -> np.ndarray:
        x = _contexts(t)
        return np.concatenate([np.full(min(CONTEXT, len(t)) - k + 1, x[-1]), x[: len(t) - k + 1]])

    return pd.Series([one(t, k) for t, k in zip(s, q)], dtype=object)


@F.pandas_udf(ArrayType(LongType()))
def _asked(s: pd.Series, at: pd.Series) -> pd.Series:
    """The context before each place; of the first, the string's end."""

    def one(t: str, places: np.ndarray) -> np.ndarray:
        x = _contexts(t)
        return np.concatenate([x[-1:], x[np.asarray(places[1:], dtype=np.int64) - 1]])

    return pd.Series([one(t, p) for t, p in zip(s, at)], dtype=object)


@F.pandas_udf(BooleanType())
def _fitting(x: pd.Series, y: pd.Series, sizes: pd.Series) -> pd.Series:
    return pd.Series(fits(x.to_numpy(), y.to_numpy(), (sizes.to_numpy()[:, None] >> (5 * np.arange(DEPTH + 1))) & 31))


def placed(texts: DataFrame, q: int, max_rate: float) -> DataFrame:
    """(sid, n, s, tau, at): one more disjoint gram than the edits allowed, the rarest; at are their places from 1, in order.

    Strings over LONG letters take evenly spaced grams.
    """
    weight = gram_weights(texts, q)

    @F.pandas_udf("array<int>")
    def chosen(s: pd.Series, tau: pd.Series) -> pd.Series:
        found: list[np.ndarray] = [np.zeros(0, dtype=np.int32)] * len(s)
        size = s.str.len()
        for (n, t), at in s.groupby([size.to_numpy(), tau.to_numpy()]).indices.items():
            m = t + 1
            if n > LONG:
                for i in at:
                    found[i] = (np.arange(m, dtype=np.int64) * (n - q) // max(1, m - 1) + 1).astype(np.int32)
                continue
            step = max(1, 4_000_000 // (n * m))
            for k in range(0, len(at), step):
                some = at[k : k + step]
                for i, p in zip(some, rarest(np.stack([_points(s.iat[i]) for i in some]), q, m, weight)):
                    found[i] = p + 1
        return pd.Series(found)

    tau = F.floor(F.col("n") * F.lit(max_rate) + F.lit(1e-9)).cast("int")
    some = texts.withColumn("tau", tau).filter(F.col("n") >= q * (F.col("tau") + 1))
    return some.select("sid", "n", "s", "tau", chosen("s", "tau").alias("at"))


def pivots(texts: DataFrame, q: int, max_rate: float) -> DataFrame:
    """(sid, n, s, tau, j, pos): the grams of placed, one a row; j counts from 0, pos from 1."""
    return placed(texts, q, max_rate).select("sid", "n", "s", "tau", F.posexplode("at").alias("j", "pos"))


def _sizes(q: int) -> Column:
    """Letters of the context that come from it with at most e edits, e from 0 to DEPTH, five bits each."""
    end = lambda k: F.element_at("at", k + 1) + F.lit(q - 1)  # noqa: E731  # the last letter of region k
    packed = F.lit(0)
    for e in range(DEPTH + 1):
        start = F.when(F.col("j") > e, end(F.greatest(F.col("j") - 1 - e, F.lit(0)))).otherwise(0)
        last = F.lit(0) if e == 0 else F.col("n") - end(F.greatest(F.col("tau") - e, F.lit(0)))
        size = F.when(F.col("j") > 0, F.col("pos") - 1 - start).otherwise(last)
        packed = packed + F.shiftleft(F.least(size, F.lit(CONTEXT - e)), 5 * e)
    return packed.cast("int")


def _near(x: Column, y: Column, sizes: Column) -> Column:
    """The first two sizes of fits, in the join itself: as many letters alike, and with one edit."""
    same = lambda u, v: F.shiftright(F.bit_count((u.bitwiseXOR(v) - F.lit(1)).bitwiseAND(F.bitwise_not(u.bitwiseXOR(v)))), 1)
    after = lambda c, k: F.call_function("shiftright", c, (k * 2).cast("int"))
    t = same(x, y)
    whole, one = sizes.bitwiseAND(F.lit(31)), F.shiftright(sizes, 5).bitwiseAND(F.lit(31))
    edit = (same(after(x, t + 1), after(y, t + 1)) >= one - t - 1) | (same(after(x, t + 1), after(y, t)) >= one - t - 1) | (same(after(x, t), after(y, t + 1)) >= one - t)
    return (t >= whole) & ((t >= one) | edit)


def pivotal(texts: DataFrame, q: int, max_rate: float = 0.1) -> DataFrame:
    """(a, b): every pair of string ids within the edits allowed to the longer one, and some more; a is the longer one.

    The pivots part the longer string into tau + 1 regions, each from behind the last pivot to the end of its own; the last one goes on to the
    string's end. Let e(i) be the edits in region i, an inserted letter counting where the next one lies; they sum to tau at most.
    If e(0) > 0, take the first j at which e(0) + ... + e(j) < j + 1: region j is whole, j edits lie before it, at most tau - j behind it, and
    the l regions before it hold at most l edits, for every l. If e(0) = 0, look for such a j from region 1 on: it has j - 1 edits before it,
    at most tau - j + 1 behind it and the same bound on the regions before it. If there is none, the edits are exactly tau, the last l
    regions hold at most l of them, for every l, and region 0 is the beginning of both strings. So a pivot j > 0 is asked for as a
    gram, with its shift and the regions before it as filters; the first one as a beginning, with the string's last regions.
    """
    gram = lambda at: F.substring(F.col("s"), at, F.lit(q))
    head = lambda size: F.xxhash64(F.substring(F.col("s"), F.lit(1), size), F.lit(-1).cast("bigint"))
    every = texts.filter(F.col("n") >= q).select("sid", "n", "s", F.posexplode(_posted("s", F.lit(q))).alias("i", "x"))
    every = every.withColumn("p", F.col("i") - F.least(F.lit(CONTEXT), F.col("n")) + F.lit(q))  # up to 0: beginnings of q - p letters
    key = F.when(F.col("p") > 0, F.xxhash64(gram(F.col("p")), F.floor(F.col("p") / SPAN))).otherwise(head(F.lit(q) - F.col("p")))
    posted = every.select(key.alias("key"), F.col("sid").alias("b"), F.col("n").alias("nb"), F.greatest("p", F.lit(0)).alias("pb"), F.coalesce("x", F.lit(0)).alias("y"))
    own = placed(texts, q, max_rate).withColumn("xs", _asked("s", "at")).select("*", F.posexplode("at").alias("j", "pos"))
    reach = F.sequence(F.floor(F.greatest(F.col("pos") - F.col("j"), F.lit(1)) / SPAN), F.floor((F.col("pos") + F.least(F.col("j"), F.col("tau") - F.col("j") + 1)) / SPAN))
    probe = own.select("sid", "n", "tau", "j", "pos", F.element_at("xs", F.col("j") + 1).alias("x"), _sizes(q).alias("sizes"), gram(F.col("pos")).alias("g"), head(F.least(F.col("pos") + q - 1, F.lit(CONTEXT))).alias("head"), F.explode(F.when(F.col("j") > 0, reach).otherwise(F.array(F.lit(-1).cast("bigint")))).alias("span"))
    key = F.when(F.col("j") > 0, F.xxhash64("g", "span")).otherwise(F.col("head"))
    probe = probe.select(key.alias("key"), F.col("sid").alias("a"), F.col("n").alias("na"), F.when(F.col("j") > 0, F.col("pos")).otherwise(0).alias("pa"), "j", "tau", F.coalesce("x", F.lit(0)).alias("x"), "sizes")
    shorter = (F.col("nb") < F.col("na")) | ((F.col("nb") == F.col("na")) & (F.col("b") < F.col("a")))
    before, behind = F.abs(F.col("pa") - F.col("pb")), F.abs((F.col("na") - F.col("pa")) - (F.col("nb") - F.col("pb")))
    shift = (before <= F.col("j")) & (behind <= F.col("tau") - F.col("j") + 1) & (before + behind <= F.col("tau"))
    hits = probe.join(posted, "key").filter(shorter & shift & _near(F.col("x"), F.col("y"), F.col("sizes")))
    return hits.filter(_fitting("x", "y", "sizes")).select("a", "b").repartition("a").distinct()


def similar(texts: DataFrame, max_rate: float = 0.1, letters: int = 4) -> DataFrame:
    """(a, b, sa, sb, distance), sa < sb: pairs of distinct strings whose edit distance is at most max_rate of the longer one's length."""
    spread = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = cut(texts.repartition(spread, "sid"))
    pairs = pivotal(texts, gram_length(texts, letters, max_rate), max_rate)
    a, b = texts.select(F.col("sid").alias("a"), F.col("s").alias("x")), texts.select(F.col("sid").alias("b"), F.col("s").alias("y"))
    both = pairs.join(a, "a").join(b, "b")
    limit = F.floor(F.greatest(F.length("x"), F.length("y")) * F.lit(max_rate) + F.lit(1e-9)).cast("int")
    both = both.withColumn("limit", limit).withColumn("distance", F.expr("levenshtein(x, y, `limit`)")).filter("distance >= 0")
    first = F.col("x") < F.col("y")
    return both.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("b"), F.least("x", "y").alias("sa"), F.greatest("x", "y").alias("sb"), "distance")


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, label): the least node id of each node's component, for edges (a, b).

    Alternating large-star and small-star steps; each round is cut in the shared checkpoint folder and the number of rounds grows with
    the logarithm of the longest chain. Edges without a change end it; the rounds running out is an error.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    for _ in range(max_rounds):
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionAll(low2.select("u", F.col("m").alias("v"))).distinct()
        small = cut(small)
        same = small.join(e, ["u", "v"], "left_anti").isEmpty() and e.join(small, ["u", "v"], "left_anti").isEmpty()
        e = small
        if same:
            break
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct()


def links(pairs: DataFrame) -> DataFrame:
    """(sid, n_links): the number of other distinct strings within the distance, of strings with any."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("sid"))
    return ends.groupBy("sid").agg(F.count(F.lit(1)).alias("n_links"))


def grouped(df: DataFrame, id_col: str, value: Column, min_length: int, **how) -> DataFrame:
    """(id, class_id, group_id, n_links) of every row long enough: class_id names the exact copies, group_id the similar ones.

    class_id is the least id of the rows of that string, group_id the least class_id of the group, its own for strings similar to no other;
    n_links is the number of other distinct strings within the distance. Null ids are left out.
    """
    known = df.filter(F.col(id_col).isNotNull())
    texts = cut(strings(known, value, min_length, id_col))
    pairs = cut(similar(texts, **how).select("a", "b"))
    member = texts.join(components(pairs), F.col("sid") == F.col("node"), "left").drop("node").join(links(pairs), "sid", "left")
    member = member.select("s", F.col("sid").alias("class_id"), F.coalesce("label", "sid").alias("group_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
    rows = known.select(F.col(id_col).alias("id"), value.alias("s")).filter(F.length("s") >= min_length)
    return rows.join(member, "s").select("id", "class_id", "group_id", "n_links")


def linked(df: DataFrame, id_col: str, value: Column, min_length: int, every: int = 100, **how) -> DataFrame:
    """(id, n_links): a search with every row whose id is divisible by that number against all rows; n_links as in grouped."""
    known = df.filter(F.col(id_col).isNotNull())
    texts = cut(strings(known, value, min_length, id_col))
    counts = texts.join(links(similar(texts, **how)), "sid", "left").select("s", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
    rows = known.filter(F.pmod(F.col(id_col), F.lit(every)) == 0).select(F.col(id_col).alias("id"), value.alias("s")).filter(F.length("s") >= min_length)
    return rows.join(counts, "s").select("id", "n_links")


def found(df: DataFrame, id_col: str | None = None) -> DataFrame:
    """(junction_a, junction_b): similar long junctions."""
    s = strings(df, bases(F.col("junction")), 90, id_col)
    return similar(s).select(F.col("sa").alias("junction_a"), F.col("sb").alias("junction_b"))
