"""Repetition inside a single document: rule statistics, an isolation forest over them, and an exact share for its suspects.

Rule statistics of a text are cheap shares of repeated lines, sentences, word runs and top words, and a bound on the repeated letters from counts
of hashed 32-letter stretches, which is never below the truth. An isolation forest is grown on a bounded sample of documents; the mean path
length over its random splits gives every document an anomaly score, and the threshold is calibrated on the sample's labelled rows.
Suspects are the documents over it, and those whose bound reaches the share of a case, so that no case depends on the sample. Only
suspects are measured exactly, which decides.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 32
MIN_LETTERS = 64
MIN_SHARE = 0.4
#: Bound of the labelled sample the forest is grown and calibrated on.
SAMPLE = 4000
STATS = ("bound_share", "line_share", "sentence_share", "phrase_share", "top_word_share")
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SENTENCE = regex.compile(r"[.!?。！？\n]+")
_WORD = regex.compile(r"\w+")
_NO_LETTER = re.compile(r"[\W_]+")  # all that str.isalnum denies


def letters(text: str) -> str:
    """Lower case, letters and digits of any script only."""
    return _NO_LETTER.sub("", text.lower())


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _hashes(s: str, window: int) -> np.ndarray:
    """A 64-bit hash of every stretch of window letters, doubled up from single letters; a window is a power of two."""
    with np.errstate(over="ignore"):
        h = _mix(np.frombuffer(s.encode("utf-32-le"), dtype="<u4").astype(np.uint64) * _ODD)
        step = 1
        while step < window:
            h = _mix(h[:-step] * np.uint64(0xD6E8FEB86659FD93) + h[step:] + np.uint64(step))
            step *= 2
    return h


def _covered(twice: np.ndarray, n: int, window: int) -> int:
    """Letters in the stretches that begin where twice is true."""
    edge = np.zeros(n + 1, dtype=np.int64)
    at = np.flatnonzero(twice)
    edge[at] += 1
    np.subtract.at(edge, at + window, 1)
    return int((np.cumsum(edge[:n]) > 0).sum())


def bound(text: str | None, window: int = WINDOW) -> tuple[int, int]:
    """(letters, at most so many repeated ones), never below repeated() and without sorting.

    A stretch may be repeated if another one falls into its cell in each of three tables of counts, one for each part of the hash.
    """
    s = letters(text or "")
    n = len(s)
    if n <= window:
        return n, 0
    h, bits = _hashes(s, window), max(10, (16 * n).bit_length())
    twice = np.ones(len(h), dtype=bool)
    for part in (h >> np.uint64(64 - bits), h >> np.uint64(max(0, 64 - 2 * bits)), h):
        cell = (part & np.uint64((1 << bits) - 1)).astype(np.int64)
        twice &= np.bincount(cell)[cell] > 1
        if not twice.any():
            return n, 0
    return n, _covered(twice, n, window)


def repeated(text: str | None, window: int = WINDOW) -> tuple[int, int]:
    """(letters, repeated letters): those in a stretch of window letters that occurs at two places or more, overlapping or not.

    Stretches are compared by their 64-bit hash. Null gives zeros.
    """
    s = letters(text or "")
    n = len(s)
    if n <= window:
        return n, 0
    h = _hashes(s, window)
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return n, 0
    twice = np.zeros(len(h), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return n, _covered(twice, n, window)


def _dup_share(parts: list[str]) -> float:
    """Share of the characters in parts that occur before or again."""
    total = sum(map(len, parts))
    if not total:
        return 0.0
    seen = Counter(parts)
    return sum(len(p) * c for p, c in seen.items() if c > 1) / total


def statistics(text: str | None) -> tuple[int, int, float, float, float, float, float]:
    """n_letters, n_bound and the STATS of a text; zeros for null, empty and blank texts."""
    text = text or ""
    n, rep = bound(text)
    low = text.lower()
    words = _WORD.findall(low)
    runs = Counter(zip(words, words[1:], words[2:], words[3:], words[4:]))
    phrase = sum(c for c in runs.values() if c > 1) / max(1, len(words) - 4) if runs else 0.0
    top = max(Counter(words).values()) / len(words) if len(words) > 4 else 0.0
    lines = [x.strip() for x in low.split("\n") if x.strip()]
    sentences = [x.strip() for x in _SENTENCE.split(low) if x.strip()]
    return n, rep, rep / n if n else 0.0, _dup_share(lines), _dup_share(sentences), phrase, top


def measured(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, n_letters, n_bound and STATS) of every row."""
    schema = "n_letters int, n_bound int, " + ", ".join(f"{s} double" for s in STATS)

    @F.pandas_udf(schema)
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([statistics(t) for t in texts], columns=["n_letters", "n_bound", *STATS])

    run = run.asNondeterministic()  # filters on its result stay above it
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("m", run("text")).select("doc_id", "text", "m.*")


def shares(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_letters, n_repeated, repeated_share) of every row, exactly; the share of a text without letters is 0."""

    @F.pandas_udf("n_letters int, n_repeated int")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([repeated(t) for t in texts], columns=["n_letters", "n_repeated"])

    run = run.asNondeterministic()
    rows = df.select(F.col(id_col).alias("doc_id"), run(F.col(text_col)).alias("m")).select("doc_id", "m.*")
    return rows.withColumn("repeated_share", F.when(F.col("n_letters") > 0, F.col("n_repeated") / F.col("n_letters")).otherwise(F.lit(0.0)))


def _mean_path(n: float) -> float:
    """Mean path length of an unsuccessful search among n rows."""
    return 0.0 if n <= 1 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0


class IsolationForest:
    """Trees of random splits on random statistics, as flat arrays, with vectorised path lengths."""

    def __init__(self, trees: int = 100, rows: int = 256, seed: int = 7):
        self.trees, self.rows, self.seed = trees, rows, seed
        self.grown: list[tuple[np.ndarray, ...]] = []
        self.threshold = 0.5

    def fit(self, x: np.ndarray) -> IsolationForest:
        rng = np.random.default_rng(self.seed)
        size = min(self.rows, len(x))
        self.norm = max(_mean_path(size), 1.0)
        depth = int(np.ceil(np.log2(max(size, 2))))
        for _ in range(self.trees):
            feature, cut, kids, leaf = [], [], [], []

            def grow(rows: np.ndarray, level: int) -> int:
                me = len(feature)
                feature.append(0), cut.append(0.0), kids.append((me, me)), leaf.append(level + _mean_path(len(rows)))
                low, high = (rows.min(0), rows.max(0)) if len(rows) else (np.zeros(1), np.zeros(1))
                open_ = np.flatnonzero(high > low)
                if level < depth and len(rows) > 1 and len(open_):
                    f = int(rng.choice(open_))
                    c = rng.uniform(low[f], high[f])
                    left = rows[:, f] <= c
                    feature[me], cut[me] = f, c
                    kids[me] = (grow(rows[left], level + 1), grow(rows[~left], level + 1))
                return me

            grow(x[rng.choice(len(x), size, replace=False)], 0)
            self.grown.append((np.array(feature), np.array(cut), np.array(kids), np.array(leaf)))
        self.depth = depth
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly from 0 to 1: 2 ** -(mean path / usual path)."""
        if not len(x) or not self.grown:
            return np.zeros(len(x))
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, cut_, kids, leaf in self.grown:
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                at = kids[at, (x[rows, feature[at]] > cut_[at]).astype(np.int64)]
            total += leaf[at]
        return 2.0 ** -(total / len(self.grown) / self.norm)

    def calibrate(self, x: np.ndarray, label: np.ndarray, margin: float = 0.5) -> IsolationForest:
        """Threshold between the labelled classes that keeps every labelled case: the least score of a case, less margin times its
        distance to the median of the other rows; without cases, the highest score seen."""
        s = self.score(x)
        if label.any():
            least = s[label].min()
            usual = np.median(s[~label]) if (~label).any() else 0.0
            self.threshold = float(least - margin * max(least - usual, 0.0))
        elif len(s):
            self.threshold = float(s.max())
        return self


def is_case(n: np.ndarray, rep: np.ndarray) -> np.ndarray:
    """The exact rule on letters and repeated letters."""
    return (n >= MIN_LETTERS) & (rep * 10 >= n * 4)


def case(rep: str) -> Column:
    """is_case on columns, rep naming that of the repeated letters."""
    return (F.col("n_letters") >= MIN_LETTERS) & (F.col(rep) * 10 >= F.col("n_letters") * 4)


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, seed: int = 7) -> IsolationForest:
    """Forest on at most sample documents (those of the least hashes of their id, one row an id), labelled by the exact rule."""
    some = df.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col), F.lit(seed)).alias("h")).distinct().orderBy("h", "doc_id").limit(sample).select("doc_id")
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(some), "doc_id", "left_semi")  # at most sample rows
    docs = docs.dropDuplicates(["doc_id"])

    @F.pandas_udf("int")
    def exact(texts: pd.Series) -> pd.Series:
        return pd.Series([repeated(t)[1] for t in texts], dtype="int32")

    rows = measured(docs).withColumn("n_repeated", exact("text")).select("n_letters", "n_repeated", *STATS).toPandas()
    x = rows[list(STATS)].to_numpy(dtype=float)
    forest = IsolationForest(seed=seed).fit(x) if len(x) else IsolationForest(seed=seed)
    return forest.calibrate(x, is_case(rows["n_letters"].to_numpy(), rows["n_repeated"].to_numpy())) if len(x) else forest


def scored(stats: DataFrame, forest: IsolationForest) -> DataFrame:
    """stats plus anomaly and suspect: anomaly at or over the calibrated threshold, or a bound that reaches the share of a case."""

    @F.pandas_udf("double")
    def run(*cols: pd.Series) -> pd.Series:
        return pd.Series(forest.score(np.column_stack([c.to_numpy(dtype=float) for c in cols])))

    return stats.withColumn("anomaly", run.asNondeterministic()(*STATS)).withColumn("suspect", (F.col("anomaly") >= F.lit(forest.threshold)) | case("n_bound"))


def found(stats: DataFrame, forest: IsolationForest) -> DataFrame:
    """(doc_id) of the suspects whose exact repeated share is at least MIN_SHARE of at least MIN_LETTERS letters."""
    return shares(scored(stats, forest).filter("suspect")).filter(case("n_repeated")).select("doc_id")
