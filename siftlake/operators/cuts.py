"""Supervised cuts of numeric features by entropy and description length (MDL), from sorted counts of all rows.

1. Counts by feature, value and class are sorted by feature and value over range partitions. Sums and first values of
   partitions, a row for each partition and feature in it, give every partition what stands before and after it, so each
   distinct value gets the class counts up to it, and the value that follows.
2. A level of recursion looks at all open intervals of all features at once: each task finds the best cut of each
   interval among its values, and an aggregation the best of all. What pays for its description length is cut, and the
   two halves are the open intervals of the next level.

No group is gathered: a task streams its part of the sorted values. The driver holds the cuts, and counts by class of
open intervals.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.session import cut

#: Most classes, and most open intervals of one level, of all features.
CLASSES = 256
OPEN = 200_000


def entropy(n: np.ndarray) -> np.ndarray:
    p = n / np.maximum(n.sum(-1, keepdims=True), 1)
    return -(p * np.log2(np.where(p > 0, p, 1))).sum(-1)


def pays(whole: np.ndarray, left: np.ndarray, cost: float) -> bool:
    """Whether a cut of an interval gains more than its description takes."""
    n, right = whole.sum(), whole - left
    parts = [(c > 0).sum() for c in (whole, left, right)]
    h = [float(entropy(c)) for c in (whole, left, right)]
    delta = np.log2(3.0 ** parts[0] - 2) - (parts[0] * h[0] - parts[1] * h[1] - parts[2] * h[2])
    return h[0] - cost > (np.log2(n - 1) + delta) / n


@dataclass
class Interval:
    """Open values of a feature: the class counts before it and in it, and its first value's lower end and last value."""

    feature: int
    before: np.ndarray
    whole: np.ndarray
    low: float
    high: float


def _columns(batch: pa.RecordBatch, n_classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    col = lambda c: batch.column(batch.schema.get_field_index(c))
    return col("f").to_numpy(), col("value").to_numpy(), col("n").flatten().to_numpy().reshape(-1, n_classes)


def _totals(n_classes: int):
    """Of each feature in a partition its class counts and first value."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, sums, first = TaskContext.get().partitionId(), {}, {}
        for batch in batches:
            f, value, n = _columns(batch, n_classes)
            for own in np.unique(f).tolist():
                at = f == own
                sums[own] = sums.get(own, 0) + n[at].sum(0)
                first.setdefault(own, float(value[at][0]))
        rows = sorted(sums)
        yield pa.RecordBatch.from_arrays([pa.array([part] * len(rows), pa.int32()), pa.array(rows, pa.int32()), pa.array([first[f] for f in rows], pa.float64()), pa.array([sums[f].tolist() for f in rows], pa.list_(pa.int64()))], ["part", "f", "first", "n"])

    return add


def _prefix(n_classes: int, before: dict[tuple[int, int], np.ndarray], after: dict[tuple[int, int], float]):
    """Of each value the class counts up to it, and the value that follows (null for the last of a feature)."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held = None

        def out(f: np.ndarray, value: np.ndarray, upto: np.ndarray, following: np.ndarray) -> pa.RecordBatch:
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, upto.size + 1, n_classes, dtype=np.int32)), pa.array(upto.reshape(-1)))
            return pa.RecordBatch.from_arrays([pa.array(f), pa.array(value), pa.array(following, mask=np.isnan(following)), lists], ["f", "value", "following", "n"])

        for batch in batches:
            if not batch.num_rows:
                continue
            f, value, n = _columns(batch, n_classes)
            upto = np.empty_like(n)
            edges = np.flatnonzero(np.concatenate([[True], f[1:] != f[:-1], [True]]))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                goes_on = held is not None and a == 0 and held[0][0] == f[0]
                start = held[2][0] if goes_on else before.get((part, int(f[a])), np.zeros(n_classes, np.int64))
                upto[a:b] = start + n[a:b].cumsum(0)
            if held is not None:
                following = value[0] if held[0][0] == f[0] else np.nan
                yield out(*held, np.array([following]))
            ends = np.where(f[1:] == f[:-1], value[1:], np.nan)
            if len(f) > 1:
                yield out(f[:-1], value[:-1], upto[:-1], ends)
            held = (f[-1:], value[-1:], upto[-1:])
        if held is not None:
            yield out(*held, np.array([after.get((part, int(held[0][0])), np.nan)]))

    return add


def _best(n_classes: int, intervals: list[Interval]):
    """The best cut of each open interval among the values of a task."""
    by_feature: dict[int, list[tuple[int, Interval]]] = {}
    for k, i in enumerate(intervals):
        by_feature.setdefault(i.feature, []).append((k, i))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[float, float, float, np.ndarray]] = {}
        for batch in batches:
            f, value, upto = _columns(batch, n_classes)
            following = batch.column(batch.schema.get_field_index("following")).to_numpy(zero_copy_only=False)
            for own, listed in by_feature.items():
                low, high = np.searchsorted(f, [own, own + 1])
                v = value[low:high]
                for k, i in listed:
                    a, b = low + np.searchsorted(v, i.low, "right"), low + np.searchsorted(v, i.high)
                    if a >= b:
                        continue
                    left = upto[a:b] - i.before
                    right = i.whole - left
                    cost = (left.sum(1) * entropy(left) + right.sum(1) * entropy(right)) / i.whole.sum()
                    j = int(cost.argmin())
                    if k not in best or cost[j] < best[k][0]:
                        best[k] = (float(cost[j]), float(value[a + j]), float(following[a + j]), left[j])
        rows = sorted(best)
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), *(pa.array([best[k][c] for k in rows], pa.float64()) for c in range(3)), pa.array([best[k][3].tolist() for k in rows], pa.list_(pa.int64()))], ["k", "cost", "value", "following", "n"])

    return find


def mdl_cuts(data: DataFrame, features: list[str], label: str) -> dict[str, list[float]]:
    """The cut points of each feature; rows without a class and values that are null or NaN stay out."""
    classes = sorted(r.c for r in data.select(F.col(label).cast("string").alias("c")).where("c IS NOT NULL").distinct().limit(CLASSES + 1).collect())
    if len(classes) > CLASSES:
        raise ValueError(f"more than {CLASSES} classes")
    n_classes = len(classes)
    out: dict[str, list[float]] = {f: [] for f in features}
    if not classes or not features:
        return out
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("f"), F.col(f).cast("double").alias("value")) for k, f in enumerate(features))))
    rows = data.where(F.col(label).isNotNull()).select(pairs.alias("p"), F.col(label).cast("string").alias("c")).where("p.value IS NOT NULL AND NOT isnan(p.value)")
    counts = rows.groupBy("p.f", (F.col("p.value") + 0.0).alias("value")).agg(F.array(*(F.count_if(F.col("c") == c) for c in classes)).alias("n"))
    # Written, so that every later pass sees the same partitions.
    table = cut(counts.repartitionByRange("f", "value").sortWithinPartitions("f", "value"))
    before: dict[tuple[int, int], np.ndarray] = {}
    after: dict[tuple[int, int], float] = {}
    whole: dict[int, np.ndarray] = {}
    last: dict[int, int] = {}
    for r in sorted(table.mapInArrow(_totals(n_classes), "part int, f int, first double, n array<long>").collect(), key=lambda r: (r.f, r.part)):
        n = np.array(r.n, np.int64)
        if r.f in whole:
            before[r.part, r.f] = whole[r.f]
            after[last[r.f], r.f] = r.first
        whole[r.f], last[r.f] = whole.get(r.f, 0) + n, r.part
    prefixed = cut(table.mapInArrow(_prefix(n_classes, before, after), "f int, value double, following double, n array<long>"))
    # An interval's last value can't be cut after: its high end stays out.
    intervals = [Interval(f, np.zeros(n_classes, np.int64), n, -np.inf, np.inf) for f, n in whole.items()]
    bounds = prefixed.where("following IS NOT NULL")
    while intervals:
        if len(intervals) > OPEN:
            raise ValueError(f"more than {OPEN} intervals at once")
        found = bounds.mapInArrow(_best(n_classes, intervals), "k int, cost double, value double, following double, n array<long>")
        best = found.groupBy("k").agg(F.min_by(F.struct("cost", "value", "following", "n"), F.struct("cost", "value")).alias("b"))
        new = []
        for r in best.collect():
            i, left = intervals[r.k], np.array(r.b.n, np.int64)
            if pays(i.whole, left, r.b.cost):
                out[features[i.feature]].append((r.b.value + r.b.following) / 2)
                new.append(Interval(i.feature, i.before, left, i.low, r.b.value))
                new.append(Interval(i.feature, i.before + left, i.whole - left, r.b.value, i.high))
        intervals = new
    return {f: sorted(c) for f, c in out.items()}
