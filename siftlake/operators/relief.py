"""ReliefF by a join of blocks: no process holds the table.

1. Features are scaled to 0..1. Rows are sorted by class and by their distance from the middle, and packed into blocks of
   at most BLOCK rows of one class, which know the range of those distances.
2. Blocks are dealt into groups in their order. A task compares two groups: for each row of the one, the nearest of each
   class in the other. By the triangle inequality two rows are at least as far apart as their distances from the middle
   differ, so a block that is farther from all rows at hand than their nearest so far is passed over. Of the other blocks
   all distances are first counted in whole steps, which bounds them, and only what may be near is summed exactly.
3. The nearest of all tasks are ranked by a window, for each row and class.
4. The pairs that remain meet their two groups of blocks again, and the weighted differences are summed by feature.

Each row is compared with every other unless the bound rules it out, so time grows with the square of the rows where the
bound doesn't help; memory is that of two groups of blocks. Distances are sums of absolute differences. Of equally far
rows the first in the order of class, distance from the middle and values is nearer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftlake.session import cut

BLOCK = 1_024
#: Asking blocks of a task at most; four times as many are asked.
GROUP = 16
#: Rows that are compared with a block at once, and pairs that are summed at once.
QUERIES = 128
PAIRS = 1 << 15
CLASSES = 256
#: What a bound made of rounded sums is lowered by.
SLACK = 1e-9


def _pack(width: int, block_rows: int):
    """Blocks of rows sorted by class."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        held: list[tuple[np.ndarray, np.ndarray]] = []
        kind, size = -1, 0

        def out() -> pa.RecordBatch:
            far, x = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([kind], pa.int32()), pa.array([far.min()]), pa.array([far.max()]), pa.array([x.tobytes()], pa.binary())], ["block", "kind", "low", "high", "rows"])

        for batch in batches:
            col = lambda c, batch=batch: batch.column(batch.schema.get_field_index(c))
            y, far, x = col("y").to_numpy(), col("far").to_numpy(), col("x").flatten().to_numpy().reshape(-1, width)
            at = 0
            while at < len(y):
                if size and (size == block_rows or y[at] != kind):
                    yield out()
                    number, held, size = number + 1, [], 0
                kind = int(y[at])
                end = at + min(block_rows - size, int(np.searchsorted(y[at:], kind, "right")))
                held.append((far[at:end], x[at:end]))
                size, at = size + end - at, end
        if size:
            yield out()

    return pack


class Grid:
    """Features in whole steps: a sum of absolute differences counted in steps is at most width steps off, and tells which pairs are worth their exact sum."""

    def __init__(self, width: int) -> None:
        self.kind = np.int16 if width <= 256 else np.int32
        self.top = np.iinfo(self.kind).max
        self.width, self.steps = width, (self.top - 63) // max(width, 1)

    def of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The steps of rows, and half of what they sum to."""
        q = np.rint(x * self.steps).astype(self.kind)
        return q, (q.sum(1, dtype=np.int64) + 1) // 2


def _near_ones(grid: Grid, steps: np.ndarray, others: np.ndarray, half: np.ndarray, same: np.ndarray | None, limit: np.ndarray, k: int, buffers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of others (by feature) that may be nearer than limit, or, where it is infinite, among the k nearest; same: what column is the row itself.

    |a - b| is twice the greater of both less their sum, so the greater ones are summed, less half of the others' sums.
    """
    total, most = buffers[0, : len(steps), : others.shape[1]], buffers[1, : len(steps), : others.shape[1]]
    total[:] = -half.astype(grid.kind)
    for f in range(grid.width):
        np.maximum(steps[:, f : f + 1], others[f], out=most)
        total += most
    if same is not None:
        total[np.arange(len(steps)), same] = grid.top
    bound = np.full(len(steps), grid.top - 1, np.int64)
    known = np.isfinite(limit)
    bound[known] = np.floor((limit[known] * grid.steps + grid.width + 1 + steps[known].sum(1, dtype=np.int64)) / 2)
    if not known.all() and total.shape[1] > k:
        bound[~known] = np.partition(total[~known], k - 1, axis=1)[:, k - 1].astype(np.int64) + grid.width + 2
    return np.nonzero(total <= np.clip(bound, np.iinfo(grid.kind).min, grid.top - 1).astype(grid.kind)[:, None])


def _take(far: np.ndarray, places: np.ndarray, row: np.ndarray, d: np.ndarray, place: np.ndarray) -> None:
    """Keeps of each row the nearest of those held and those found (by ascending row), the first place of equals."""
    k = far.shape[1]
    touched, at, counts = np.unique(row, return_inverse=True, return_counts=True)
    rows = np.concatenate([np.repeat(np.arange(len(touched)), k), at])
    both, where = np.concatenate([far[touched].ravel(), d]), np.concatenate([places[touched].ravel(), place])
    order = np.lexsort((where, both, rows))
    first = np.cumsum(counts + k) - counts - k
    kept = order[(first[:, None] + np.arange(k)).ravel()]
    far[touched], places[touched] = both[kept].reshape(-1, k), where[kept].reshape(-1, k)


def _matrix(rows: bytes, width: int) -> np.ndarray:
    return np.frombuffer(rows, np.float64).reshape(-1, width)


NEAR = "place long, own int, kind int, near long, far double"


def _nearest(width: int, block_rows: int, k: int):
    """For each row of the asking blocks of a group the k nearest of each class among its other blocks."""

    def near(table: pa.Table) -> pa.Table:
        rows = table.select(["asks", "block", "kind", "low", "high", "rows"]).to_pylist()
        targets = [r for r in rows if not r["asks"]]
        grid = Grid(width)
        buffers = np.empty((2, QUERIES, max((len(t["rows"]) // (8 * width) for t in targets), default=0)), grid.kind)
        out: list[list[np.ndarray]] = [[] for _ in range(5)]
        for q, low in ((r, low) for r in rows if r["asks"] for low in range(0, len(r["rows"]) // (8 * width), QUERIES)):
            x, first = _matrix(q["rows"], width)[low : low + QUERIES], q["block"] * block_rows + low
            steps, by_feature = grid.of(x)[0], np.ascontiguousarray(x.T)
            bound = lambda t, q=q: max(0.0, t["low"] - q["high"], q["low"] - t["high"])
            far: dict[int, np.ndarray] = {}
            places: dict[int, np.ndarray] = {}
            for t in sorted(targets, key=lambda t: (bound(t), t["block"])):
                c = t["kind"]
                if c not in far:
                    far[c], places[c] = np.full((len(x), k), np.inf), np.full((len(x), k), -1)
                worst, start = far[c].max(1), t["block"] * block_rows
                # Nothing is nearer than a copy, and an earlier copy goes before a later one.
                done = (worst == 0) & (places[c].max(1) < start)
                if bound(t) - SLACK > worst.max() or done.all():
                    continue
                if "x" not in t:
                    t["x"] = np.ascontiguousarray(_matrix(t["rows"], width).T)
                    q_steps, t["half"] = grid.of(t["x"].T)
                    t["steps"] = np.ascontiguousarray(q_steps.T)
                same = np.arange(low, low + len(x)) if t["block"] == q["block"] else None
                row, col = _near_ones(grid, steps, t["steps"], t["half"], same, np.where(done, -4.0 * width, worst), k, buffers)
                for some in (slice(at, at + PAIRS) for at in range(0, len(row), PAIRS)):
                    r, j = row[some], col[some]
                    # By feature, so that they are added one after another, as a plain sum does.
                    gap = np.take(by_feature, r, axis=1)
                    gap -= np.take(t["x"], j, axis=1)
                    d = np.abs(gap, out=gap).sum(0)
                    kept = d <= worst[r]
                    if kept.any():
                        _take(far[c], places[c], r[kept], d[kept], start + j[kept])
            for c, d in far.items():
                row, j = np.nonzero(np.isfinite(d))
                for held, values in zip(out, (first + row, np.full(len(row), q["kind"], np.int32), np.full(len(row), c, np.int32), places[c][row, j], d[row, j])):
                    held.append(values)
        kinds = (np.int64, np.int32, np.int32, np.int64, np.float64)
        return pa.table([pa.array(np.concatenate(v) if v else np.zeros(0, t), pa.from_numpy_dtype(t)) for v, t in zip(out, kinds)], names=["place", "own", "kind", "near", "far"])

    return near


def _differences(width: int, block_rows: int):
    """The weighted differences of pairs by feature, given the blocks of both their ends."""

    def add(table: pa.Table) -> pa.Table:
        asks = table["asks"].to_pylist()
        total = np.zeros(width)
        ends = []
        for side in (True, False):
            at = [k for k, a in enumerate(asks) if a is side]
            blocks = table["block"].take(pa.array(at, pa.int64())).to_numpy()
            order = np.argsort(blocks)
            x = [_matrix(table["rows"][at[k]].as_py(), width) for k in order.tolist()]
            first = np.cumsum([0, *map(len, x)])
            ends.append((blocks[order], first, np.concatenate(x) if x else np.zeros((0, width))))
        pairs = table.filter(pa.compute.is_null(table["asks"]))
        place, near, weight = (pairs[c].to_numpy() for c in ("place", "near", "weight"))
        for low in range(0, len(place), PAIRS):
            some = slice(low, low + PAIRS)
            own = []
            for (blocks, first, x), p in zip(ends, (place[some], near[some])):
                own.append(x[first[np.searchsorted(blocks, p // block_rows)] + p % block_rows])
            total += weight[some] @ np.abs(own[0] - own[1])
        return pa.table([pa.array(np.arange(width, dtype=np.int32)), pa.array(total)], names=["f", "total"])

    return add


def relieff(data: DataFrame, features: list[str], label: str, neighbours: int = 10) -> DataFrame:
    """feature, relieff: how much farther the nearest misses of all rows are than the nearest hits; rows with a null or NaN stay out."""
    spark, width = data.sparkSession, len(features)
    spans = data.agg(*(f(F.nanvl(F.col(c).cast("double"), F.lit(None))).alias(f"{k}{j}") for j, c in enumerate(features) for k, f in (("a", F.min), ("b", F.max)))).first()
    unit = [((F.col(c).cast("double") - (spans[f"a{j}"] or 0.0)) / (((spans[f"b{j}"] or 0.0) - (spans[f"a{j}"] or 0.0)) or 1.0)) for j, c in enumerate(features)]
    rows = data.select(F.array(*unit).alias("x"), F.col(label).cast("string").alias("class")).where(F.col("class").isNotNull() & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v)))
    sizes = sorted((r["class"], r.n) for r in rows.groupBy("class").agg(F.count("*").alias("n")).limit(CLASSES + 1).collect())
    if len(sizes) > CLASSES:
        raise ValueError(f"more than {CLASSES} classes")
    names = spark.createDataFrame(list(enumerate(features)), "f int, feature string")
    if not sizes:
        return names.select("feature", F.lit(0.0).alias("relieff"))
    total = sum(n for _, n in sizes)
    kinds = F.array(*(F.lit(c) for c, _ in sizes))
    far = F.aggregate("x", F.lit(0.0), lambda a, v: a + F.abs(v - 0.5))
    placed = rows.select((F.array_position(kinds, F.col("class")) - 1).cast("int").alias("y"), far.alias("far"), "x")
    packed = placed.repartitionByRange("y", "far", "x").sortWithinPartitions("y", "far", "x")
    blocks = cut(packed.mapInArrow(_pack(width, BLOCK), "block long, kind int, low double, high double, rows binary"))
    # Numbered in their order, so that a group of asked blocks is of few classes, and few nearest ones are sent on.
    order = blocks.select("block", (F.row_number().over(Window.orderBy("block")) - 1).alias("n"))
    count = blocks.count()
    asks, asked = max(1, min(GROUP, -(-count // 12))), max(1, min(4 * GROUP, -(-count // 4)))
    group = lambda n, size: F.floor(n / size).cast("int")
    every = lambda size: F.explode(F.sequence(F.lit(0), F.lit((count - 1) // size)))
    placed_blocks = blocks.join(F.broadcast(order), "block")
    asking = placed_blocks.select(group(F.col("n"), asks).alias("g"), every(asked).alias("h"), F.lit(True).alias("asks"), *blocks.columns)
    others = placed_blocks.select(every(asks).alias("g"), group(F.col("n"), asked).alias("h"), F.lit(False).alias("asks"), *blocks.columns)
    # A number of our own, as tasks of a few blocks' bytes take long and shouldn't be put together.
    both = asking.unionByName(others).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "g", "h")
    near = both.groupBy("g", "h").applyInArrow(_nearest(width, BLOCK, neighbours), NEAR)
    own = Window.partitionBy("place", "kind")
    best = near.withColumn("k", F.row_number().over(own.orderBy("far", "near"))).where(F.col("k") <= neighbours).withColumn("found", F.count("*").over(own))
    prior = F.array(*(F.lit(n / total) for _, n in sizes))
    share = F.when(F.col("kind") == F.col("own"), F.lit(-1.0)).otherwise(F.get(prior, F.col("kind")) / (1 - F.get(prior, F.col("own"))))
    block = lambda place: F.floor(F.col(place) / BLOCK).cast("long")
    of = lambda place, size, name: F.broadcast(order.select(F.col("block").alias(f"_{place}"), group(F.col("n"), size).alias(name)))
    pairs = best.select(block("place").alias("_place"), block("near").alias("_near"), "place", "near", (share / F.col("found")).alias("weight"))
    pairs = pairs.join(of("place", asks, "g"), "_place").join(of("near", asked, "h"), "_near").select("g", "h", "place", "near", "weight")
    meet = both.select("g", "h", "asks", "block", "rows").unionByName(pairs, allowMissingColumns=True)
    sums = meet.groupBy("g", "h").applyInArrow(_differences(width, BLOCK), "f int, total double").groupBy("f").agg((F.sum("total") / total).alias("relieff"))
    return sums.join(F.broadcast(names), "f").select("feature", "relieff")
