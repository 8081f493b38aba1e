"""Training and testing of classifiers on feature subsets, as aggregates over distributed data.

No table leaves the executors. What is learned from training data is a table of sums that doesn't grow with its rows:

- naive Bayes: count, mean and variance by class and feature, from one aggregation. They serve every subset, whose
  classifier is the sum of its features' log densities.
- decision trees: counts by node, feature, bin and class, one aggregation for each level of all trees at once. The best
  split of a node comes from running sums over its bins. Rows aren't moved: a row's node follows from the tree so far.
- forests: trees whose rows are weighed by a Poisson draw from the row's hash, and whose nodes see features drawn anew.

Testing reads the test data once for all subsets: each task counts right and wrong guesses by subset, and the counts are
summed. Subsets and learned parameters are sent to the tasks; their sizes are checked (SUBSETS, CELLS).

Rows with a null or NaN are left out. The class is the last column; the first class is the normal one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Most classes, candidates of one evaluation, and numbers of learned parameters.
CLASSES = 256
SUBSETS = 200_000
CELLS = 20_000_000
#: Numbers that a task holds at a time.
HELD = 4_000_000
BINS = 64
DEPTH = 8
LEAST = 2
TREES = 25
#: A gain or ratio must exceed this to split.
TINY = 1e-9


def confusion(actual: Column, predicted: Column, normal: Column | str) -> list[Column]:
    """Counts of a test: the normal class is negative; a wrong guess of another class than normal is a false positive."""
    normal = F.lit(normal) if isinstance(normal, str) else normal
    right = actual == predicted
    return [
        F.count_if(right & (predicted != normal)).alias("tp"),
        F.count_if(right & (predicted == normal)).alias("tn"),
        F.count_if(~right & (predicted != normal)).alias("fp"),
        F.count_if(~right & (predicted == normal)).alias("fn"),
    ]


def metrics(counts: DataFrame) -> DataFrame:
    """Accuracy, precision, recall and F1 in percent of rows with tp, tn, fp, fn; a zero denominator gives 0."""
    ratio = lambda a, b: F.when(b > 0, 100.0 * a / b).otherwise(0.0)
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    out = counts.withColumns({"accuracy": ratio(tp + tn, tp + tn + fp + fn), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn)})
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0))


def evaluate(predictions: DataFrame, actual: str, predicted: str, normal: str, keys: list[str] | None = None) -> DataFrame:
    """Metrics of predictions, by keys."""
    return metrics(predictions.groupBy(*(keys or [])).agg(*confusion(F.col(actual), F.col(predicted), normal)))


@dataclass
class Problem:
    """Training and test rows: x (features as doubles), y (the class's place), h (a hash of the row)."""

    train: DataFrame
    test: DataFrame
    classes: list[str]
    features: list[str]
    learned: dict[str, object] = field(default_factory=dict)

    @classmethod
    def of(cls, train: DataFrame, test: DataFrame, normal: str | None = None) -> Problem:
        label = train.columns[-1]
        names = train.columns[:-1]
        known = train.select(F.col(f"`{label}`").cast("string").alias("c")).union(test.select(F.col(f"`{label}`").cast("string"))).where("c IS NOT NULL").distinct()
        found = sorted(r.c for r in known.limit(CLASSES + 1).collect())
        if len(found) > CLASSES:
            raise ValueError(f"more than {CLASSES} classes")
        classes = sorted(found, key=lambda c: (c != normal, c))

        def coded(data: DataFrame) -> DataFrame:
            whole = data.select(F.array(*(F.col(f"`{c}`").cast("double") for c in names)).alias("x"), F.col(f"`{label}`").cast("string").alias("c"))
            place = F.array_position(F.array(*map(F.lit, classes)), F.col("c")) - 1 if classes else F.lit(0)
            kept = whole.where(F.col("c").isNotNull() & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v)))
            return kept.select("x", place.cast("int").alias("y"), F.xxhash64("x", "c").alias("h"))

        return cls(coded(train), coded(test), classes, names)

    @property
    def width(self) -> int:
        return len(self.features)


def _arrays(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    col = lambda c: batch.column(batch.schema.get_field_index(c))
    return col("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width), col("y").to_numpy(), col("h").to_numpy()


class Bayes:
    """Normal densities by class and feature."""

    def __init__(self, problem: Problem, subsets: list[list[int]]) -> None:
        if "bayes" not in problem.learned:
            problem.learned["bayes"] = _moments(problem)
        self.prior, self.mean, self.var = problem.learned["bayes"]
        self.members = np.zeros((len(subsets), problem.width))
        for k, subset in enumerate(subsets):
            self.members[k, [f - 1 for f in subset]] = 1

    def guesses(self, x: np.ndarray, h: np.ndarray, some: slice) -> np.ndarray:
        """The class of each row (columns) by each of some subsets (rows)."""
        apart = x[:, None, :] - self.mean
        log = -0.5 * (np.log(2 * np.pi * self.var) + apart**2 / self.var)
        n, c, f = log.shape
        total = self.members[some] @ log.reshape(n * c, f).T
        return (total.reshape(-1, n, c) + self.prior).argmax(2)

    def cells(self) -> int:
        return self.mean.size


def _moments(problem: Problem) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log priors, means and variances of all classes and features, from one aggregation of the training rows."""
    n_classes, width = len(problem.classes), problem.width
    if n_classes * width > CELLS:
        raise ValueError(f"more than {CELLS} means")
    prior, mean, var = np.full(n_classes, np.log(1e-9)), np.zeros((n_classes, width)), np.ones((n_classes, width))
    spread = np.zeros(width)
    rows = problem.train.select("y", F.posexplode("x").alias("f", "v"))
    sums = rows.groupBy("y", "f").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.var_pop("v").alias("var"))
    found = sums.collect()
    size = np.zeros((n_classes, width))
    for r in found:
        size[r.y, r.f], mean[r.y, r.f], var[r.y, r.f] = r.n, r.mean, r.var
    total = size.sum(0)
    if width and total.max(initial=0) > 0:
        middle = (size * mean).sum(0) / np.maximum(total, 1)
        spread = (size * np.where(size > 0, var + (mean - middle) ** 2, 0)).sum(0) / np.maximum(total, 1)
        prior = np.log(np.maximum(size[:, 0], 1e-9) / total[0])
    return prior, mean, var + 1e-9 * max(float(spread.max(initial=0)), 1e-9) + 1e-12


@dataclass
class Tree:
    """Nodes as arrays: feature (-1 for a leaf), last bin that goes left, first child, class."""

    subset: int
    features: list[int]
    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    child: list[int] = field(default_factory=lambda: [-1])
    guess: list[int] = field(default_factory=lambda: [0])

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row, given the bins of its features."""
        feature, last, child = (np.array(v) for v in (self.feature, self.bin, self.child))
        at = np.zeros(len(bins), np.int64)
        for _ in range(DEPTH + 1):
            f = feature[at]
            inner = np.flatnonzero(f >= 0)
            if not len(inner):
                break
            own = at[inner]
            at[inner] = child[own] + (bins[inner, f[inner]] > last[own])
        return at


#: The cumulative probabilities of a Poisson draw with mean 1.
_POISSON = np.cumsum(np.exp(-1.0) / np.cumprod(np.concatenate([[1.0], np.arange(1.0, 12.0)])))


def _weights(h: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row stands in a tree's bootstrap sample."""
    x = h.view(np.uint64) ^ np.uint64((tree * 0x9E3779B97F4A7C15 + seed * 0xBF58476D1CE4E5B9) & (1 << 64) - 1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return np.searchsorted(_POISSON, (x ^ (x >> np.uint64(31))) / 2.0**64, "right").astype(np.int64)


class Trees:
    """One tree for each subset by gain ratio, or a forest."""

    def __init__(self, problem: Problem, subsets: list[list[int]], forest: int = 0, seed: int = 1) -> None:
        self.n_classes, self.subsets, self.forest, self.seed = len(problem.classes), len(subsets), forest, seed
        if "edges" not in problem.learned:
            problem.learned["edges"] = _edges(problem)
        self.edges = problem.learned["edges"]
        self.trees = [Tree(k, [f - 1 for f in subset]) for k, subset in enumerate(subsets) for _ in range(max(forest, 1))]
        self.grow(problem)

    def seen(self, tree: int, node: int) -> list[int]:
        """The features that a node is split by: all, or in a forest some that are drawn for it."""
        own = self.trees[tree].features
        pick = max(1, int(np.log2(max(len(own), 1)) + 1))
        if not self.forest or pick >= len(own):
            return own
        return sorted(np.random.default_rng([self.seed, tree, node]).choice(own, pick, replace=False).tolist())

    def grow(self, problem: Problem) -> None:
        todo = {(t, 0): self.seen(t, 0) for t in range(len(self.trees))}
        for depth in range(DEPTH):
            new: dict[tuple[int, int], list[int]] = {}
            # A job holds the counts of so many nodes; each has its features, bins and classes.
            for some in _shares(todo, BINS * self.n_classes):
                for r in best_splits(self.histograms(problem, some), self.n_classes).collect():
                    tree = self.trees[r.tree]
                    left, right = np.array(r.left), np.array(r.right)
                    tree.guess[r.node] = int((left + right).argmax())
                    if r.ratio is None:
                        continue
                    first = len(tree.feature)
                    tree.feature[r.node], tree.bin[r.node], tree.child[r.node] = r.feature, r.bin, first
                    for k, counts in enumerate((left, right)):
                        tree.feature.append(-1)
                        tree.bin.append(0)
                        tree.child.append(-1)
                        tree.guess.append(int(counts.argmax()))
                        if depth + 1 < DEPTH and counts.max() < counts.sum() and counts.sum() >= 2 * LEAST:
                            new[r.tree, first + k] = self.seen(r.tree, first + k)
            todo = new
            if not todo:
                break

    def histograms(self, problem: Problem, todo: dict[tuple[int, int], list[int]]) -> DataFrame:
        """tree, node, feature, bin, class and n of the training rows that are in a node of todo."""
        by_tree: dict[int, list[int]] = {}
        for t, node in todo:
            by_tree.setdefault(t, []).append(node)
        width, n_classes, grown = problem.width, self.n_classes, self

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = {key: np.zeros((len(features), BINS, n_classes), np.int64) for key, features in todo.items()}
            for batch in batches:
                x, y, h = _arrays(batch, width)
                bins = grown.binned(x)
                for t, nodes in by_tree.items():
                    at = grown.trees[t].nodes(bins)
                    weight = _weights(h, t, grown.seed) if grown.forest else None
                    for node in nodes:
                        rows = np.flatnonzero(at == node)
                        for k, f in enumerate(todo[t, node]):
                            cell = bins[rows, f] * n_classes + y[rows]
                            sums[t, node][k] += np.bincount(cell, None if weight is None else weight[rows], BINS * n_classes).astype(np.int64).reshape(BINS, n_classes)
            for (t, node), held in sums.items():
                k, b, c = np.nonzero(held)
                features = np.array(todo[t, node], np.int32)[k]
                columns = [np.full(len(k), t, np.int32), np.full(len(k), node, np.int32), features, b.astype(np.int32), c.astype(np.int32), held[k, b, c]]
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in columns], ["tree", "node", "feature", "bin", "class", "n"])

        found = problem.train.mapInArrow(count, "tree int, node int, feature int, bin int, class int, n long")
        return found.groupBy("tree", "node", "feature", "bin", "class").agg(F.sum("n").alias("n"))

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(edges, x[:, f], "left") for f, edges in enumerate(self.edges)]) if len(self.edges) else np.zeros((len(x), 0), np.int64)

    def guesses(self, x: np.ndarray, h: np.ndarray, some: slice) -> np.ndarray:
        bins, each = self.binned(x), max(self.forest, 1)
        out = []
        for k in range(*some.indices(self.subsets)):
            votes = np.zeros((len(x), self.n_classes), np.int32)
            for tree in self.trees[k * each : (k + 1) * each]:
                votes[np.arange(len(x)), np.array(tree.guess)[tree.nodes(bins)]] += 1
            out.append(votes.argmax(1))
        return np.array(out).reshape(-1, len(x))

    def cells(self) -> int:
        return sum(len(t.feature) for t in self.trees)


def _shares(todo: dict, cells: int) -> Iterator[dict]:
    """Nodes in shares whose counts are at most HELD numbers, or of one node."""
    own, size = {}, 0
    for key, features in todo.items():
        if own and size + len(features) * cells > HELD:
            yield own
            own, size = {}, 0
        own[key] = features
        size += len(features) * cells
    if own:
        yield own


def _edges(problem: Problem) -> list[np.ndarray]:
    """Up to BINS - 1 quantiles of each feature, as the upper ends of its bins."""
    shares = [k / BINS for k in range(1, BINS)]
    rows = problem.train.select(F.posexplode("x").alias("f", "v")).groupBy("f").agg(F.percentile_approx("v", shares, 10_000).alias("q")).collect()
    found = {r.f: np.unique(r.q) for r in rows}
    return [found.get(f, np.zeros(0)) for f in range(problem.width)]


def best_splits(counts: DataFrame, n_classes: int) -> DataFrame:
    """tree, node, feature, bin, ratio, and class counts left and right of the best split of each node, by gain ratio.

    counts has tree, node, feature, bin, class, n. Ties go to the first feature, then the first bin; a node without a
    split that gains has a null ratio, and all its rows left.
    """
    by_class = [F.coalesce(F.sum(F.when(F.col("class") == c, F.col("n"))), F.lit(0)).alias(f"n{c}") for c in range(n_classes)]
    table = counts.groupBy("tree", "node", "feature", "bin").agg(*by_class)
    own = Window.partitionBy("tree", "node", "feature")
    upto = own.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    sums = lambda w: F.array(*(F.sum(f"n{c}").over(w) for c in range(n_classes)))
    table = table.select("tree", "node", "feature", "bin", sums(upto).alias("left"), sums(own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("whole"))
    table = table.withColumn("right", F.zip_with("whole", "left", lambda a, b: a - b))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, b: a + b)
    # n log n terms give entropies; those of a split are weighted by their rows.
    plogp = lambda n: F.when(n > 0, n * F.log2(n.cast("double"))).otherwise(0.0)
    bits = lambda c, n: plogp(n) - F.aggregate(c, F.lit(0.0), lambda a, b: a + plogp(b))
    table = table.withColumns({"a": total("left"), "b": total("right"), "n": total("whole")})
    table = table.withColumn("gain", (bits("whole", F.col("n")) - bits("left", F.col("a")) - bits("right", F.col("b"))) / F.col("n"))
    table = table.withColumn("split", (plogp(F.col("n")) - plogp(F.col("a")) - plogp(F.col("b"))) / F.col("n"))
    fits = (F.col("a") >= LEAST) & (F.col("b") >= LEAST) & (F.col("gain") > TINY)
    # Rounded, so that equal ratios of differently summed logarithms are ties.
    table = table.withColumn("ratio", F.when(fits, F.round(F.col("gain") / F.greatest("split", F.lit(TINY)), 12)))
    best = F.max_by(F.struct("feature", "bin", "ratio", "left", "right"), F.struct(F.coalesce("ratio", F.lit(-1.0)), -F.col("feature"), -F.col("bin")))
    out = table.groupBy("tree", "node").agg(best.alias("s"), F.first("whole").alias("whole"))
    left, right = F.when(F.col("s.ratio").isNull(), F.col("whole")).otherwise(F.col("s.left")), F.when(F.col("s.ratio").isNull(), F.transform("whole", lambda v: v * 0)).otherwise(F.col("s.right"))
    return out.select("tree", "node", "s.feature", "s.bin", "s.ratio", left.alias("left"), right.alias("right"))


CLASSIFIERS = {"J48": Trees, "NB": Bayes, "NAIVEBAYES": Bayes, "RF": Trees, "RANDOMFOREST": Trees}
FORESTS = ("RF", "RANDOMFOREST")


def classifier(name: str) -> str:
    """The name in capitals, if there is such a classifier."""
    if name.upper() not in CLASSIFIERS:
        raise ValueError(f"no classifier {name!r}; there are {sorted(CLASSIFIERS)}")
    return name.upper()


def _model(problem: Problem, subsets: list[list[int]], name: str):
    return Trees(problem, subsets, TREES) if name in FORESTS else CLASSIFIERS[name](problem, subsets)


def confusions(problem: Problem, subsets: list[list[int]], name: str) -> DataFrame:
    """subset, tp, tn, fp and fn on the test rows of the classifier that is trained on each subset."""
    model = _model(problem, subsets, classifier(name))
    width, n_classes = problem.width, len(problem.classes)
    if model.cells() > CELLS:
        raise ValueError(f"classifiers of more than {CELLS} numbers")
    # Rows and subsets that a task takes at a time.
    rows = max(1, min(1024, HELD // max(width * n_classes, 1)))
    step = max(1, HELD // (rows * n_classes))
    sent = problem.test.sparkSession.sparkContext.broadcast((model, subsets))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, subsets = sent.value
        sums = np.zeros((len(subsets), 4), np.int64)
        for batch in batches:
            all_x, all_y, all_h = _arrays(batch, width)
            for low in range(0, len(all_x), rows):
                x, y, h = all_x[low : low + rows], all_y[low : low + rows], all_h[low : low + rows]
                for k in range(0, len(subsets), step):
                    some = slice(k, k + step)
                    guess = model.guesses(x, h, some)
                    right, attack = guess == y, guess != 0
                    sums[some] += np.stack([(right & attack).sum(1), (right & ~attack).sum(1), (~right & attack).sum(1), (~right & ~attack).sum(1)], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(subsets, pa.list_(pa.int32())), *(pa.array(sums[:, k]) for k in range(4))], ["subset", "tp", "tn", "fp", "fn"])

    found = problem.test.mapInArrow(count, "subset array<int>, tp long, tn long, fp long, fn long")
    return found.groupBy("subset").agg(*(F.sum(c).alias(c) for c in ("tp", "tn", "fp", "fn")))


def evaluate_subsets(candidates: DataFrame, problem: Problem, name: str) -> DataFrame:
    """Counts and metrics of each candidate (column features: places from 1, others are passed over), with its other columns."""
    subset = F.array_sort(F.array_distinct(F.filter("features", lambda f: (f >= 1) & (f <= problem.width))))
    candidates = candidates.withColumn("subset", F.coalesce(subset, F.array().cast("array<int>")))
    listed = candidates.where(F.size("subset") > 0).select("subset").limit(SUBSETS + 1).collect()
    subsets = sorted(map(list, {tuple(r.subset) for r in listed}))
    if len(listed) > SUBSETS:
        raise ValueError(f"more than {SUBSETS} candidates at once")
    counts = ("tp", "tn", "fp", "fn")
    found = confusions(problem, subsets, name) if subsets and problem.classes else None
    own = candidates.join(found, "subset", "left") if found is not None else candidates.withColumns({c: F.lit(None).cast("long") for c in counts})
    rest = [c for c in candidates.columns if c not in ("features", "subset")]
    return metrics(own.select(*rest, "features", *(F.coalesce(c, F.lit(0)).alias(c) for c in counts)))
