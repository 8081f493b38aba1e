"""MinHash near-duplicate groups by an LSH forest, confirmed on whole shingle sets.

1. A text becomes its set of distinct 5-word shingles (64-bit hashes) and a signature of 128 minima. Equal sets form a
   class, which stands for all its documents from here on.
2. The forest has TREES orders of the classes: order t sorts them by the signature that is rotated to start at its
   minimum 4t. A region of an order is a run of classes that share a prefix, and its depth adapts to how crowded it is:
   the shortest prefix of DEPTHS that at most REGION_MAX classes share. So sparse places are compared from two minima
   on, and crowded ones from three or four. At similarity 0.75 two classes share no region with a probability of
   (1 - 0.75**d)**32 at depth d: 3e-12 at two minima, 3e-8 at three, 5e-6 at four.
3. In a region, sorted, the neighbours of the longest common prefix are the first candidates: those whose signatures
   agree in LEAST_AGREE minima or more (5 standard deviations below 0.75). Only where that leaves the region in several
   groups are its other pairs looked at, all of them. A region that is still too crowded at the last depth isn't listed
   by pairs but joined whole to one of its classes, so it loses no candidate; deeper prefixes would.
4. Connected components of the candidates are clusters. A cluster is confirmed on full sets by one task, if it is small.
   A large one is dealt into blocks, each confirmed together with some pivot classes of the cluster; the classes that
   this leaves outside the cluster's largest group are then compared with every block. Either way exactly the pairs
   with 100 * intersection >= 75 * union are linked, and a spanning forest of the links is emitted.
5. Connected components of the links, over classes that are ordered by their least doc_id, give that of each document.

Only signatures, class keys and the sets of classes with candidates are shuffled, never a text of any other document.
Crowded regions are told apart by a broadcast of their keys, behind a check of their number, and never sent to one task.

Cases: null and empty texts, and texts without words, have no shingles and are linked with nothing; fewer than five
words are one shingle; repeated rows are one class; ties go to the least doc_id; a null doc_id takes part in links, but
is never the least (its component is null if it reaches no other) and is not kept; an empty table gives an empty
result; of other columns, deduplicate() passes all through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake.llm import textkernel as tk
from siftlake.llm.graphs import components
from siftlake.session import cut

SHINGLE = 5
MINIMA = 128
TREES = 32
#: Order t starts at minimum t * STEP. Prefixes of a region, from sparse to crowded ones, in minima; at most STEP.
STEP = MINIMA // TREES
DEPTHS = (2, 3, 4)
REGION_MAX = 1024
LEAST_AGREE = 70
#: A cluster that one task confirms has at most so many classes and shingles; a block of a larger one has half.
CLUSTER_CLASSES = 512
CLUSTER_SHINGLES = 2_000_000
PIVOTS = 32
#: Ids of classes with candidates, and keys of crowded regions, are broadcast up to this count, checked before; beyond it
#: they are joined by a shuffle.
BROADCAST_IDS = 500_000

_MULTIPLY = tk._splitmix(0xC0FFEE, MINIMA) | np.uint64(1)
_EMPTY = np.zeros(0, np.uint64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    starts, ends, first = tk.words(data, offsets)
    hashes = tk.word_hashes(data, starts, ends)
    windows = tk.window_hashes(hashes, SHINGLE)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= SHINGLE:
            yield np.unique(windows[a : b - SHINGLE + 1])
        else:
            yield np.array([tk.sequence_hash(hashes[a:b])], np.uint64) if b > a else _EMPTY


def set_keys(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit keys of each set."""
    flat = np.concatenate(sets) if sets else _EMPTY
    ends = np.cumsum([len(s) for s in sets])
    keys = []
    for salt in (0x1234567, 0x7654321):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tk.mix(flat ^ np.uint64(salt)), dtype=np.uint64)])
        keys.append(tk.mix(sums[ends] - sums[ends - [len(s) for s in sets]]))
    return keys[0], keys[1]


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """The minima of each set; zeros for an empty one."""
    out = np.zeros((len(sets), MINIMA), np.uint32)
    full = [k for k, s in enumerate(sets) if len(s)]
    if full:
        flat = np.concatenate([sets[k] for k in full])
        starts = np.concatenate([[0], np.cumsum([len(sets[k]) for k in full])[:-1]])
        for j in range(MINIMA):
            out[full, j] = np.minimum.reduceat((flat * _MULTIPLY[j]) >> np.uint64(32), starts)
    return out


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, data, offsets in tk.slices(batch, "text"):
            sets = list(shingle_sets(data, offsets))
            k1, k2 = set_keys(sets)
            minima = signatures(sets)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(batch.schema.get_field_index("doc_id")).slice(low, high - low),
                    batch.column(batch.schema.get_field_index("text_hash")).slice(low, high - low),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(tk.signed(k1)),
                    pa.array(tk.signed(k2)),
                    pa.array([row.tobytes() if len(s) else None for row, s in zip(minima, sets)], pa.binary()),
                    pa.array([row.tobytes() if len(s) else None for row, s in zip(minima.astype(np.uint8), sets)], pa.binary()),
                ],
                ["doc_id", "text_hash", "n_shingles", "k1", "k2", "minima", "sketch"],
            )


def _places(classes: DataFrame, depth: int, within: DataFrame | None = None) -> DataFrame:
    """node, tree and region: the key of its prefix of so many minima in each order, or in the orders that within names."""
    prefix = lambda t: F.xxhash64(F.lit(t), F.substring(F.col("minima"), 4 * STEP * t + 1, 4 * depth))
    keys = F.array(*(prefix(t) for t in range(TREES)))
    if within is None:
        return classes.select("node", F.posexplode(keys).alias("tree", "region"))
    return within.select("node", "tree").join(classes.select("node", "minima"), "node").select("node", "tree", F.element_at(keys, F.col("tree") + 1).alias("region"))


def _regions(classes: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(node, tree, region of the regions to list; node, pivot of regions too crowded at the last depth, if there are any)."""
    places, leaves = _places(classes, DEPTHS[0]), []
    for depth in DEPTHS:
        if depth > DEPTHS[0]:
            places = cut(_places(classes, depth, within))
        sizes = cut(places.groupBy("region").agg(F.count("*").alias("m"), F.min("node").alias("pivot")).where("m > 1"))
        crowded = cut(sizes.where(F.col("m") > REGION_MAX).select("region", "pivot"))
        n = crowded.count()
        keys = F.broadcast(crowded) if n <= BROADCAST_IDS else crowded
        sparse = places.join(keys, "region", "left_anti") if n else places
        leaves.append(sparse.join(sizes.where(F.col("m") <= REGION_MAX).select("region"), "region"))
        within = places.join(keys, "region").select("node", "tree", "pivot")
        if not n:
            return _union(leaves), None
    return _union(leaves), within.select("node", "pivot")


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _whole(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows in tables that hold runs of equal keys whole, of batches sorted by key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy()
        # the last run may go on in the next batch
        others = np.flatnonzero(keys != keys[-1])
        start = int(others[-1]) + 1 if len(others) else 0
        if start:
            yield pa.Table.from_batches([*held, batch.slice(0, start)])
            held = [batch.slice(start)]
        elif held and held[0].column(batch.schema.get_field_index(key))[0].as_py() != keys[0]:
            yield pa.Table.from_batches(held)
            held = [batch]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def forest(n: int, near: Callable[[int], np.ndarray]) -> list[tuple[int, int]]:
    """Stars that span the components of n nodes, given the neighbours of a node: each node with the first of its component."""
    seen, out = np.zeros(n, bool), []
    for root in range(n):
        if seen[root]:
            continue
        seen[root], todo = True, [root]
        while todo:
            new = [b for b in near(todo.pop()).tolist() if not seen[b]]
            seen[new] = True
            out += [(root, b) for b in new]
            todo += new
    return out


def neighbours(region: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """The group of each entry of sorted regions (rows of labels): entries of one group are joined by candidates."""
    same = region[1:] == region[:-1]
    near = same & ((labels[1:] == labels[:-1]).sum(1) >= LEAST_AGREE)
    group = np.concatenate([[0], np.cumsum(~near)])
    bounds = np.concatenate([[0], np.flatnonzero(~same) + 1, [len(region)]])
    # Regions whose neighbours in the order don't all agree: every pair is looked at.
    for k in np.flatnonzero((np.diff(bounds) > 2) & (group[bounds[1:] - 1] > group[bounds[:-1]])).tolist():
        a, b = bounds[k], bounds[k + 1]
        own = labels[a:b]
        for root, other in forest(b - a, lambda x, own=own: np.flatnonzero((own == own[x]).sum(1) >= LEAST_AGREE)):
            group[a + other] = group[a + root]
    return group


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates of the regions as stars: (least node of a group, other node)."""
    for table in _whole(batches, "region"):
        region, node = table["region"].to_numpy(), table["node"].to_numpy()
        labels = np.frombuffer(b"".join(table["label"].to_pylist()), np.uint8).reshape(-1, MINIMA)
        group = neighbours(region, labels)
        order = np.lexsort((node, group))
        group, node = group[order], node[order]
        first = np.concatenate([[True], group[1:] != group[:-1]])
        least = node[first][np.cumsum(first) - 1]
        yield pa.RecordBatch.from_arrays([pa.array(least[~first]), pa.array(node[~first])], ["a", "b"])


def linked(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Stars that span the components of the sets under 100 * intersection >= 75 * union."""
    sizes = np.array([len(s) for s in sets])
    if len(sets) == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True)) if 4 * sizes.min() >= 3 * sizes.max() else 0
        return [(0, 1)] if both and 100 * both >= 75 * (sizes.sum() - both) else []
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, shingle = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(shingle, kind="stable")
    holders, first = owner[order], np.concatenate([[0], np.cumsum(np.bincount(shingle))])
    bounds = np.concatenate([[0], np.cumsum(sizes)])

    def near(k: int) -> np.ndarray:
        own = shingle[bounds[k] : bounds[k + 1]]
        counts = first[own + 1] - first[own]
        ends = np.cumsum(counts)
        at = np.repeat(first[own] - (ends - counts), counts) + np.arange(ends[-1])
        both = np.bincount(holders[at], minlength=len(sets))
        return np.flatnonzero(100 * both >= 75 * (sizes + sizes[k] - both))

    return forest(len(sets), near)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, data, offsets in tk.slices(batch, "text"):
            sets = list(shingle_sets(data, offsets))
            k1, k2 = set_keys(sets)
            yield pa.RecordBatch.from_arrays([pa.array(tk.signed(k1)), pa.array(tk.signed(k2)), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "k2", "shingles"])


def _named(least: str, node: str) -> Column:
    """A class as a node of the last graph: classes are ordered by their least doc_id, null last."""
    return F.struct(F.col(least).isNull().alias("no_id"), F.col(least).alias("least"), F.col(node).alias("node"))


def _confirm(tasks: DataFrame) -> DataFrame:
    """Links (a, b) of the classes of each task: task, least, node, shingles.

    The grouping is part of the plan: a repartition by task above a join by cluster counts as done, and adaptive
    execution may then read a cluster in parts.
    """

    def links(table: pa.Table) -> pa.Table:
        pairs = linked([np.frombuffer(s, np.uint64) for s in table["shingles"].to_pylist()]) if table.num_rows > 1 else []
        at = np.array(pairs, np.int64).reshape(-1, 2)
        ends = [table[c].take(pa.array(at[:, k])) for k in (0, 1) for c in ("least", "node")]
        return pa.table(ends, names=["a_least", "a", "b_least", "b"])

    found = tasks.select("task", "least", "node", "shingles").groupBy("task").applyInArrow(links, "a_least long, a long, b_least long, b long")
    return found.select(_named("a_least", "a").alias("a"), _named("b_least", "b").alias("b"))


def _confirm_clusters(members: DataFrame) -> DataFrame:
    """Links within clusters: node, least, cluster, n_shingles, shingles."""
    size = members.groupBy("cluster").agg(F.count("*").alias("m"), F.sum("n_shingles").alias("total"))
    blocks = F.greatest(F.ceil(F.col("m") * 2 / CLUSTER_CLASSES), F.ceil(F.col("total") * 2 / CLUSTER_SHINGLES))
    large = cut(size.where((F.col("m") > CLUSTER_CLASSES) | (F.col("total") > CLUSTER_SHINGLES)).withColumn("blocks", blocks.cast("int")))
    n = large.count()
    if not n:
        return _confirm(members.withColumn("task", F.col("cluster")))
    # Only the few large clusters are named to all tasks, so none of them is sent to one task whole.
    keys = F.broadcast(large) if n <= BROADCAST_IDS else large
    links = _confirm(members.join(keys, "cluster", "left_anti").withColumn("task", F.col("cluster")))
    big = cut(members.join(keys, "cluster").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")))
    own = ["cluster", "node", "least", "shingles"]
    pivot = F.pmod(F.xxhash64("node", F.lit(5)), F.ceil(F.col("m") / PIVOTS)) == 0
    pivots = big.where(pivot).withColumn("home", F.col("block")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = big.select(*own, "block").unionByName(pivots.where("block <> home").select(*own, "block"))
    found = cut(_confirm(dealt.withColumn("task", F.xxhash64("cluster", "block"))))
    # The classes outside their cluster's largest group are compared with all blocks.
    roots = components(found).select(F.col("node.node").alias("node"), F.col("root.node").alias("root"))
    groups = big.select("cluster", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    main = groups.groupBy("cluster", "root").agg(F.count("*").alias("n")).groupBy("cluster").agg(F.max_by("root", F.struct("n", "root")).alias("main"))
    main = F.broadcast(main) if n <= BROADCAST_IDS else main
    outside = groups.join(main, "cluster").where("root <> main").select("node")
    rest = cut(big.join(outside, "node"))
    if rest.isEmpty():
        return links.union(found)
    counts = rest.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") * 2 / CLUSTER_CLASSES), F.ceil(F.sum("n_shingles") * 2 / CLUSTER_SHINGLES)).cast("int").alias("others"))
    counts = F.broadcast(counts) if n <= BROADCAST_IDS else counts
    rest = rest.join(counts, "cluster").select(*own, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("node", F.lit(9)), F.col("others")).cast("int").alias("other"))
    all_blocks = big.join(counts, "cluster").select(*own, "block", F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("other"))
    against = rest.unionByName(all_blocks).dropDuplicates(["cluster", "block", "other", "node"])
    return links.union(found).union(_confirm(against.withColumn("task", F.xxhash64("cluster", "block", "other"))))


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, k1, k2 (keys of the set), root and component_id of each document."""
    texts = documents.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    base = cut(texts.mapInArrow(_sign, "doc_id long, text_hash long, n_shingles long, k1 long, k2 long, minima binary, sketch binary"))
    classes = cut(base.where("n_shingles > 0").groupBy(F.col("k1").alias("node"), "k2").agg(F.min("doc_id").alias("least"), *(F.first(c).alias(c) for c in ("n_shingles", "minima", "sketch"))))
    listed, joined = _regions(classes)
    start = F.col("tree") * STEP
    label = F.concat(F.substring(F.col("sketch"), start + 1, F.lit(MINIMA)), F.substring(F.col("sketch"), F.lit(1), start))
    listed = listed.join(classes.select("node", "sketch"), "node").select("region", "node", label.alias("label"))
    # By an expression, so that no partitioning beneath can count as this one.
    listed = listed.repartition(F.xxhash64("region", F.lit(3))).sortWithinPartitions("region", "label")
    near = listed.mapInArrow(_agreeing, "a long, b long")
    clusters = cut(components(near.union(joined) if joined else near).select("node", F.col("root").alias("cluster")))
    candidates = cut(classes.drop("minima", "sketch").join(clusters, "node"))
    ids = candidates.select(F.col("least").alias("id")).distinct()
    ids = F.broadcast(ids) if candidates.count() <= BROADCAST_IDS else ids
    chosen = documents.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    sets = chosen.select("text").mapInArrow(_sets, "node long, k2 long, shingles binary")
    members = cut(sets.join(candidates, ["node", "k2"]).dropDuplicates(["node", "k2"]).select("node", "least", "cluster", "n_shingles", "shingles"))
    roots = components(_confirm_clusters(members)).select(F.col("node.node").alias("node"), "root")
    to = classes.select("node", "k2", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", _named("least", "node")))
    to = cut(to.select(F.col("node").alias("k1"), "k2", "root"))
    out = base.drop("minima", "sketch").join(to, ["k1", "k2"], "left")
    return out.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("root.least")).otherwise(F.col("doc_id")))


def op7_near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    return near_duplicates(documents).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def deduplicate(documents: DataFrame) -> DataFrame:
    """The documents, with one row of each group: that of the least doc_id, null last. Texts without words all stay."""
    own = documents.columns
    found = cut(near_duplicates(documents))
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    best = found.where("n_shingles > 0").groupBy("root").agg(F.min(rank).alias("best")).select("best.doc_id", "best.text_hash")
    rows = found.groupBy("doc_id", "text_hash").agg(F.count("*").alias("copies"), F.max("n_shingles").alias("n"))
    best = best.alias("b").join(rows.alias("r"), F.col("b.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("b.text_hash") == F.col("r.text_hash"))).select(F.col("r.doc_id").alias("best_id"), F.col("r.text_hash").alias("best_hash"), "copies")
    best = best.union(rows.where("n = 0").select("doc_id", "text_hash", F.lit(1)))
    packed = documents.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("row"), "doc_id", F.xxhash64("text").alias("text_hash"))
    kept = packed.join(best, F.col("doc_id").eqNullSafe(F.col("best_id")) & (F.col("text_hash") == F.col("best_hash")))
    once = kept.where("copies > 1").dropDuplicates(["doc_id", "text_hash"])
    return kept.where("copies = 1").unionByName(once).select(*(F.col(f"row.`{c}`").alias(c) for c in own))
