"""SimHash near-duplicates by the generalised pigeonhole principle.

1. A text becomes a 64-bit fingerprint: a bit is set if it is set in over half of the XXH64 values of its 4-word
   shingles, repeats included. Equal fingerprints are one node from here on.
2. Bits are dealt into parts so that correlated bits share a part: co-occurrence counts of all bit pairs over all nodes
   are summed, and each part is grown from its most correlated pair. If two fingerprints differ in at most DISTANCE bits
   and thresholds t of the parts have a sum of t + 1 of DISTANCE + 1 (-1 skips a part), then some part differs in at
   most its own threshold.
3. Each node gets thresholds of its own by dynamic programming over the parts. The price of a threshold is the estimated
   number of candidates, which is the convolution of the distance distributions of the part's chunks (histograms of
   all nodes), and the number of probes that enumerate it. The number of parts is the one of PARTS that costs least.
4. Each node stands in one bucket for each part, and probes all values within its thresholds. Buckets are streams
   sorted by Spark; candidates are verified on the whole fingerprint and leave the task as stars that span its links.
5. A bucket of more than CROWD nodes isn't compared in one task: its nodes, and those that probe it, emit every value
   within half of DISTANCE instead. Two of them are linked exactly if they share such a value, so every value's nodes
   are one star; its cost is linear in the nodes, however many are close to one another.
6. Connected components of the links, and the least doc_id of each.

What the driver collects is 4,096 counts of bit pairs and the histograms of chunks of up to 8 bits, whatever the input.

Cases: null and empty texts, and texts without words, have fingerprint zero and are linked like any other; fewer than
four words are one shingle; repeated rows are one node; ties go to the least doc_id; a null doc_id takes part in links,
and its component is null if it reaches no other; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.llm import textkernel as tk
from siftlake.llm.graphs import components
from siftlake.llm.neardup import _whole as whole_runs
from siftlake.session import cut

BITS = 64
SHINGLE = 4
SEED = 42
DISTANCE = 4
#: Numbers of parts that are weighed, and bits of a chunk whose values are counted.
PARTS = (2, 3, 4, 5)
CHUNK = 8
#: What a probe costs, in candidates: it is shuffled and sorted, a candidate is one XOR.
PROBE = 16.0
#: Nodes of a bucket that one task compares.
CROWD = 4096
#: Candidates, hashes and nodes that a task holds at a time.
PAIRS = 1 << 21
BLOCK = 1 << 17
NODES = 1024
#: Keys and ids up to this count, checked before, are broadcast; beyond it they are joined by a shuffle.
BROADCAST_IDS = 500_000

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingle_hashes(text: bytes) -> list[int]:
    """XXH64 of each shingle of a text."""
    words = text.translate(_LOWER).split()
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return [xxhash.xxh64_intdigest(joined, SEED)] if words else []
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-SHINGLE] + 1])
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[SHINGLE - 1 :].tolist())]


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """The fingerprint of each text."""
    counts, sizes = np.zeros((len(texts), BITS), np.int64), np.zeros(len(texts), np.int64)
    held: list[int] = []
    owner: list[tuple[int, int]] = []

    def flush() -> None:
        if held:
            bits = np.unpackbits(np.array(held, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
            at = np.cumsum([0, *(n for _, n in owner[:-1])])
            np.add.at(counts, [k for k, _ in owner], np.add.reduceat(bits, at, axis=0, dtype=np.int64))
            held.clear()
            owner.clear()

    for k, text in enumerate(texts):
        hashes = shingle_hashes(text)
        sizes[k] = len(hashes)
        for low in range(0, len(hashes), BLOCK):
            part = hashes[low : low + BLOCK]
            held.extend(part)
            owner.append((k, len(part)))
            if len(held) >= BLOCK:
                flush()
    flush()
    ones = (2 * counts > sizes[:, None]).astype(np.uint8)
    return np.packbits(ones, axis=1).view(">u8").reshape(-1).astype(np.uint64)


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, data, offsets in tk.slices(batch, "text"):
            raw = data.tobytes()
            out = fingerprints([raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())])
            ids = batch.column(batch.schema.get_field_index("doc_id")).slice(low, high - low)
            yield pa.RecordBatch.from_arrays([ids, pa.array(tk.signed(out))], ["doc_id", "fp"])


def deal_bits(both: np.ndarray, n: int, m: int) -> list[list[int]]:
    """The bits of each of m parts: grown from the most correlated pair left, a bit at a time, up to an equal share."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    near = np.round(np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread), 9)
    np.fill_diagonal(near, 0)
    free, parts = list(range(BITS)), []
    for k in range(m):
        size = BITS // m + (k < BITS % m)
        own = [max(free, key=lambda b: (near[b, free].max(), -b))]
        free.remove(own[0])
        while len(own) < size:
            b = max(free, key=lambda b: (near[b, own].sum(), -b))
            own.append(b)
            free.remove(b)
        parts.append(own)
    return parts


def _value(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(fps), np.int64)
    for k, b in enumerate(bits):
        out |= ((fps >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << k
    return out


def _chunks(part: list[int]) -> list[list[int]]:
    return [part[k : k + CHUNK] for k in range(0, len(part), CHUNK)]


_POPCOUNT = np.bitwise_count(np.arange(1 << CHUNK)[:, None] ^ np.arange(1 << CHUNK)[None, :])


def _shares(histogram: np.ndarray) -> np.ndarray:
    """For each value of a chunk the share of nodes at each distance up to DISTANCE."""
    apart = _POPCOUNT[: len(histogram), : len(histogram)]
    total = max(histogram.sum(), 1)
    return np.stack([(apart == e) @ histogram / total for e in range(DISTANCE + 1)], axis=1)


def _add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The distribution of the sum of two distances, up to DISTANCE."""
    out = np.zeros_like(a)
    for e in range(DISTANCE + 1):
        out[:, e:] += a[:, e : e + 1] * b[:, : DISTANCE + 1 - e]
    return out


@dataclass
class Layout:
    """Parts, what their chunks hold, and the number of nodes."""

    parts: list[list[int]]
    shares: list[list[np.ndarray]]
    n: int

    def prices(self, near: list[np.ndarray]) -> list[np.ndarray]:
        """Of each part the price of thresholds -1 to DISTANCE, given its distance distributions."""
        out = []
        for part, dist in zip(self.parts, near):
            price = self.n * np.cumsum(dist, axis=1) + PROBE * np.cumsum([comb(len(part), e) for e in range(DISTANCE + 1)])
            price[:, _reach(part) + 1 :] = np.inf
            out.append(np.concatenate([np.zeros((len(price), 1)), price], axis=1))
        return out

    def thresholds(self, fps: np.ndarray) -> np.ndarray:
        """The thresholds of each part for each fingerprint."""
        near = []
        for part, shares in zip(self.parts, self.shares):
            dist = None
            for bits, table in zip(_chunks(part), shares):
                own = table[_value(fps, bits)]
                dist = own if dist is None else _add(dist, own)
            near.append(dist)
        return cheapest(self.prices(near))[0]

    def cost(self) -> float:
        """The price of a mean node."""
        near = []
        for part, shares in zip(self.parts, self.shares):
            dist = None
            for table, weights in zip(shares, self.weights[len(near)]):
                own = (weights @ table)[None, :]
                dist = own if dist is None else _add(dist, own)
            near.append(dist)
        return float(cheapest(self.prices(near))[1][0])

    @cached_property
    def weights(self) -> list[list[np.ndarray]]:
        # the share at distance 0 is the value's own share
        return [[t[:, 0] for t in own] for own in self.shares]

    @cached_property
    def masks(self) -> list[list[np.ndarray]]:
        """Of each part the values to XOR, sorted by distance, up to each threshold."""
        out = []
        for part in self.parts:
            own = [np.zeros(1, np.uint64)]
            for e in range(1, DISTANCE + 1):
                more = combinations(part, e) if e <= _reach(part) else ()
                own.append(np.concatenate([own[-1], np.array([sum(1 << b for b in c) for c in more], np.uint64)]))
            out.append(own)
        return out

    @cached_property
    def whole(self) -> np.ndarray:
        return np.array([sum(1 << b for b in part) for part in self.parts], np.uint64)


def _reach(part: list[int]) -> int:
    """The greatest threshold of a part: wide ones have too many values at DISTANCE, and any sum can do without."""
    return DISTANCE if len(part) <= 24 else DISTANCE - 1


def cheapest(prices: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Thresholds whose t + 1 have a sum of DISTANCE + 1, at the least total price, for each row; and that price."""
    rows, goal = len(prices[0]), DISTANCE + 1
    best, taken = prices[0], []
    for price in prices[1:]:
        options = np.full((rows, goal + 1, goal + 1), np.inf)
        for s in range(goal + 1):
            for k in range(s + 1):
                options[:, s, k] = best[:, s - k] + price[:, k]
        taken.append(options.argmin(axis=2))
        best = options.min(axis=2)
    out, left = np.zeros((rows, len(prices)), np.int64), np.full(rows, goal)
    for i in range(len(prices) - 1, 0, -1):
        out[:, i] = taken[i - 1][np.arange(rows), left]
        left = left - out[:, i]
    out[:, 0] = left
    return out - 1, best[:, goal]


def _counted(nodes: DataFrame, count, bins: int) -> np.ndarray:
    """Sums over all nodes of count(fingerprints), an array of so many numbers."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(bins, np.int64)
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            for low in range(0, len(fps), BLOCK):
                total += count(fps[low : low + BLOCK])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bin", "n"])

    out = np.zeros(bins, np.int64)
    for r in nodes.select("fp").mapInArrow(add, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect():
        out[r.bin] = r.n
    return out


def _pairs_of_bits(fps: np.ndarray) -> np.ndarray:
    ones = ((fps[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.float32)
    return np.rint(ones.T @ ones).astype(np.int64).reshape(-1)


def layout(nodes: DataFrame, n: int) -> Layout:
    """The cheapest way to deal the bits of the nodes into parts."""
    both = _counted(nodes, _pairs_of_bits, BITS * BITS).reshape(BITS, BITS)
    ways = [deal_bits(both, n, m) for m in PARTS]
    chunks = [c for parts in ways for part in parts for c in _chunks(part)]
    width = 1 << CHUNK
    held = _counted(nodes, lambda fps: np.concatenate([np.bincount(_value(fps, c), minlength=width) for c in chunks]), len(chunks) * width).reshape(-1, width)
    rows = iter(held)
    out = [Layout(parts, [[_shares(next(rows)[: 1 << len(c)]) for c in _chunks(part)] for part in parts], n) for parts in ways]
    return min(out, key=lambda way: way.cost())


def _bucket(values: np.ndarray, part: int) -> np.ndarray:
    """The key of a value of a part. Should two values have the same, they only share a bucket: links are verified."""
    return tk.signed(tk.mix(values + np.uint64(part * 0x9E3779B97F4A7C15 & (1 << 64) - 1)))


INDEX, BOTH, ONLY_PROBE = 0, 1, 2


def _places(way: Layout, probes: bool):
    """Rows (bucket, kind, fp) of each node: where it stands, and what it probes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_fps = batch.column(0).to_numpy().view(np.uint64)
            for low in range(0, len(all_fps), NODES):
                fps = all_fps[low : low + NODES]
                limit = way.thresholds(fps)
                for i, whole in enumerate(way.whole):
                    own = fps & whole
                    kind = np.where(limit[:, i] >= 0, BOTH, INDEX).astype(np.int8)
                    yield pa.RecordBatch.from_arrays([pa.array(_bucket(own, i)), pa.array(kind), pa.array(tk.signed(fps))], ["bucket", "kind", "fp"])
                    for t in range(1, DISTANCE + 1) if probes else ():
                        at = np.flatnonzero(limit[:, i] == t)
                        step = max(1, PAIRS // len(way.masks[i][t]))
                        for k in range(0, len(at), step):
                            some = at[k : k + step]
                            others = (own[some, None] ^ way.masks[i][t][None, 1:]).reshape(-1)
                            who = np.repeat(fps[some], len(way.masks[i][t]) - 1)
                            yield pa.RecordBatch.from_arrays([pa.array(_bucket(others, i)), pa.array(np.full(len(who), ONLY_PROBE, np.int8)), pa.array(tk.signed(who))], ["bucket", "kind", "fp"])

    return rows


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links as stars of the same components: (least of a component, another of it)."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(names))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    other = np.flatnonzero(label != np.arange(len(names)))
    return names[label[other]], names[other]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verified links within buckets, as stars, of rows sorted by bucket and kind."""
    for table in whole_runs(batches, "bucket"):
        bucket, kind, fp = (table[c].to_numpy() for c in ("bucket", "kind", "fp"))
        first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        run = np.cumsum(np.concatenate([[0], (bucket[1:] != bucket[:-1]).astype(np.int64)]))
        standing = np.add.reduceat((kind < ONLY_PROBE).astype(np.int64), first)
        asks = np.flatnonzero((kind > INDEX) & (standing[run] > 0))
        wanted = standing[run[asks]]
        low = 0
        found: list[tuple[np.ndarray, np.ndarray]] = []
        ends = np.cumsum(wanted)
        while low < len(asks):
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + PAIRS, "right")))
            who, n = asks[low:high], wanted[low:high]
            upto = np.cumsum(n)
            to = fp[np.arange(upto[-1]) + np.repeat(first[run[who]] - (upto - n), n)]
            of = np.repeat(fp[who], n)
            near = np.bitwise_count((of ^ to).view(np.uint64)) <= DISTANCE
            near &= of != to
            if near.any():
                found.append(stars(of[near], to[near]))
            low = high
        if found:
            a, b = stars(np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])) if len(found) > 1 else found[0]
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _balls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every value within half of DISTANCE of each fingerprint."""
    masks = np.array([sum(1 << b for b in c) for e in range(DISTANCE // 2 + 1) for c in combinations(range(BITS), e)], np.uint64)
    for batch in batches:
        fps = batch.column(0).to_numpy().view(np.uint64)
        for low in range(0, len(fps), NODES // 4):
            own = fps[low : low + NODES // 4]
            yield pa.RecordBatch.from_arrays([pa.array(tk.signed((own[:, None] ^ masks).reshape(-1))), pa.array(tk.signed(np.repeat(own, len(masks))))], ["bucket", "fp"])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A star of the fingerprints of each value, of rows sorted by value; a value has as many as a ball has at most."""
    for table in whole_runs(batches, "bucket"):
        bucket, fp = table["bucket"].to_numpy(), table["fp"].to_numpy()
        new = np.concatenate([[True], bucket[1:] != bucket[:-1]])
        least = fp[np.flatnonzero(new)][np.cumsum(new) - 1]
        if not new.all():
            a, b = stars(least[~new], fp[~new])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def links(nodes: DataFrame, n: int, crowd: int = CROWD) -> DataFrame:
    """(a, b): stars that span, together, the links of all fingerprints (column fp, distinct)."""
    way = layout(nodes, n)
    rows = nodes.select("fp").mapInArrow(_places(way, True), "bucket long, kind byte, fp long")
    standing = nodes.select("fp").mapInArrow(_places(way, False), "bucket long, kind byte, fp long")
    crowded = cut(standing.groupBy("bucket").agg(F.count("*").alias("m")).where(F.col("m") > crowd).select("bucket"))
    hot = crowded.count()
    extra = None
    if hot:
        keys = F.broadcast(crowded) if hot <= BROADCAST_IDS else crowded
        close = rows.join(keys, "bucket", "left_semi").select("fp").distinct()
        balls = close.mapInArrow(_balls, "bucket long, fp long")
        extra = balls.repartition(F.xxhash64("bucket")).sortWithinPartitions("bucket", "fp").mapInArrow(_meet, "a long, b long")
        rows = rows.join(keys, "bucket", "left_anti")
    dealt = rows.repartition(F.xxhash64("bucket", F.lit(3))).sortWithinPartitions("bucket", "kind")
    found = dealt.mapInArrow(_links, "a long, b long")
    return found.union(extra) if hot else found


def near_duplicates(documents: DataFrame, crowd: int = CROWD) -> DataFrame:
    """doc_id, fp (signed 64 bits) and component_id of each document."""
    base = cut(documents.select("doc_id", "text").mapInArrow(_fingerprint, "doc_id long, fp long"))
    nodes = cut(base.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")))
    roots = components(links(nodes, nodes.count(), crowd)).select(F.col("node").alias("fp"), "root")
    of = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    # Only nodes that reach another document are named to the documents; any other is its own component.
    groups = of.groupBy("root").agg(F.min("least").alias("component"), F.sum("copies").alias("documents")).where("documents > 1")
    named = of.join(groups, "root").select("fp", "component")
    named = cut(named)
    named = F.broadcast(named) if named.count() <= BROADCAST_IDS else named
    return base.join(named.withColumn("grouped", F.lit(True)), "fp", "left").select("doc_id", "fp", F.when(F.col("grouped"), F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))


def op11_simhash(documents: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 lower-case hex digits), component_id."""
    return near_duplicates(documents).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
