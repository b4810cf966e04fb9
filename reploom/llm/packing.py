"""Filling fixed-capacity containers: best fit, then swap-based local search.

Items are dealt by their place in the table into blocks of bounded size, packed block by block in parallel. Within a block a
best-fit-decreasing packing is improved by moving an item, exchanging one for one or two for one between containers that are not full;
every step increases the sum of squared fills, which empties containers, and the search ends when no step is left. The least filled
containers of each block are then opened and packed together with those of other blocks, round after round, until one block is
left. Only items longer than a container are split, into full ones and a rest.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reploom.session import cut

CAPACITY = 2048
#: Items of a block on average: memory and the time of a task stay bounded.
BLOCK = 4096
#: Least filled containers that a block hands on, and the blocks whose containers meet in the next round.
HANDED, FAN_IN = 2, 16


class _Bins:
    """Containers of one block with the fill of each."""

    def __init__(self, capacity: int):
        self.capacity, self.fill, self.items = capacity, [], []

    def open(self) -> int:
        self.fill.append(0)
        self.items.append([])
        return len(self.fill) - 1


def best_fit(sizes: np.ndarray, capacity: int) -> _Bins:
    """Best fit decreasing: each item into the fullest container that takes it. Free space is kept sorted."""
    bins, free = _Bins(capacity), []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        s = int(sizes[i])
        at = bisect_left(free, (s, -1))
        if at < len(free):
            _, b = free.pop(at)
        else:
            b = bins.open()
        bins.fill[b] += s
        bins.items[b].append(i)
        insort(free, (capacity - bins.fill[b], b))
    return bins


def improve(bins: _Bins, sizes: np.ndarray) -> None:
    """Local search between containers that are not full, least filled first as givers, until a pass changes nothing.

    A giver's item of size x goes to a container with gap g: alone if x <= g, for a smaller item y if x - y <= g, or for two
    whose sum is smaller than x by at most g. Receivers are at least as full as the giver, so the squared fill grows each time and the
    search ends by itself.
    """
    cap = bins.capacity
    while True:
        changed = False
        order = sorted((b for b in range(len(bins.fill)) if 0 < bins.fill[b] < cap), key=lambda b: bins.fill[b])
        for giver in order:
            if not bins.items[giver]:
                continue
            for to in reversed(order):
                if to == giver or not (gap := cap - bins.fill[to]) or bins.fill[to] < bins.fill[giver] or not bins.items[giver]:
                    continue
                best = _exchange(bins, sizes, giver, to, gap)
                if best is None:
                    continue
                out, back = best
                for i in out:
                    bins.items[giver].remove(i)
                for i in back:
                    bins.items[to].remove(i)
                bins.items[to] += out
                bins.items[giver] += back
                moved = int(sum(sizes[i] for i in out) - sum(sizes[i] for i in back))
                bins.fill[to] += moved
                bins.fill[giver] -= moved
                changed = True
        if not changed:
            break


def _exchange(bins: _Bins, sizes: np.ndarray, giver: int, to: int, gap: int) -> tuple[list[int], list[int]] | None:
    """The exchange that fills the receiver's gap best; None where none fills any of it."""
    mine, theirs = bins.items[giver], sorted(bins.items[to], key=lambda i: sizes[i])
    values = [int(sizes[i]) for i in theirs]
    best, gain = None, 0
    for i in mine:
        x = int(sizes[i])
        if x <= gap:
            if x > gain:
                best, gain = ([i], []), x
            continue
        at = bisect_left(values, x - gap)
        if at < len(values) and 0 < x - values[at] and x - values[at] > gain:
            best, gain = ([i], [theirs[at]]), x - values[at]
        for p, y in enumerate(values):  # two of theirs for one of mine
            need = x - gap - y
            if y >= x:
                break
            at = max(bisect_left(values, need), p + 1)
            if at < len(values) and 0 < (d := x - y - values[at]) <= gap and d > gain:
                best, gain = ([i], [theirs[p], theirs[at]]), d
        if gain == gap:
            break
    for p in range(len(mine)):  # two of mine for one of theirs
        if gain == gap:
            break
        for r in range(p + 1, len(mine)):
            s = int(sizes[mine[p]] + sizes[mine[r]])
            if s <= gap:
                if s > gain:
                    best, gain = ([mine[p], mine[r]], []), s
                continue
            at = bisect_left(values, s - gap)
            if at < len(values) and gain < s - values[at] <= gap:
                best, gain = ([mine[p], mine[r]], [theirs[at]]), s - values[at]
    return best


def pack(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Container number of each item, none larger than capacity; numbers are dense from 0. Items of size 0 go to container 0."""
    sizes = np.asarray(sizes, dtype=np.int64)
    out = np.zeros(len(sizes), dtype=np.int64)
    real = np.flatnonzero(sizes > 0)
    if not len(real):
        return out
    own = sizes[real]
    bins = best_fit(own, capacity)
    improve(bins, own)
    for no, items in enumerate(x for x in bins.items if x):
        out[real[items]] = no
    return out


def pieces(df: DataFrame, id_col: str, size_col: str, capacity: int = CAPACITY) -> DataFrame:
    """(id, piece_no from 1, size): one row an item, several only for items longer than a container."""
    n = F.greatest(F.ceil(F.col(size_col) / capacity), F.lit(1)).cast("int")
    src = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(size_col), F.lit(0)).cast("bigint").alias("total"), F.explode(F.sequence(F.lit(1), F.coalesce(n, F.lit(1)))).alias("piece_no"))
    return src.select("id", "piece_no", F.least(F.lit(capacity), F.col("total") - (F.col("piece_no") - 1) * capacity).cast("int").alias("size"))


def containers(df: DataFrame, id_col: str, size_col: str, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """(id, piece_no, size, container STRING): every item once, split only above the capacity.

    The sizes are materialised first, so what computes them runs once. Empty and null items have size 0 and share a container with
    others; ids that repeat are packed as the separate items they are, wherever they stand. An empty table gives no rows.
    """
    sized = cut(df.select(F.col(id_col).alias("id"), F.col(size_col).alias("n")))
    blocks = max(1, -(-sized.count() // block))
    items = pieces(sized, "id", "n", capacity).withColumn("place", F.monotonically_increasing_id())
    rows = items.select("id", "piece_no", "size", F.pmod(F.xxhash64("place"), F.lit(blocks)).alias("blk"))
    done, level = None, 0
    while True:
        packed = rows.groupBy("blk").applyInPandas(_packer(capacity, level, blocks == 1), "id bigint, piece_no int, size int, container string, blk bigint, open boolean")
        packed = packed if blocks == 1 else cut(packed)
        closed = packed.filter("not open").select("id", "piece_no", "size", "container")
        done = closed if done is None else done.unionAll(closed)
        if blocks == 1:
            return done
        rows, blocks, level = packed.filter("open").select("id", "piece_no", "size", "blk"), -(-blocks // FAN_IN), level + 1


def _packer(capacity: int, level: int, last: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Packs one block; open marks the items of the containers that it hands on to the next round."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "id", "piece_no"], ascending=[False, True, True]).reset_index(drop=True)
        size, blk = pdf["size"].to_numpy(), int(pdf["blk"].iloc[0])
        no = np.full(len(pdf), -1)
        full = size == capacity  # full pieces need no search
        no[~full] = pack(size[~full], capacity)
        fill = np.bincount(no[~full], weights=size[~full]) if (~full).any() else np.zeros(0)
        least = [] if last else [b for b in np.argsort(fill, kind="stable")[:HANDED] if fill[b] < capacity]
        name = [f"full-{i}-{p}" if f else f"{level}-{blk}-{x}" for i, p, f, x in zip(pdf["id"], pdf["piece_no"], full, no)]
        return pd.DataFrame({"id": pdf["id"], "piece_no": pdf["piece_no"], "size": size, "container": name, "blk": blk // FAN_IN, "open": np.isin(no, least)})

    return run
