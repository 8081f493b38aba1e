"""Ranked lexical search with block-max pruning.

1. The items are the queries. Their distinct terms are the vocabulary of a search; items are dealt into query blocks of
   bounded bytes, so what is sent to the tasks and gathered by the driver is bounded whatever the number of items.
2. One pass makes the forward index: rows of up to DOCS neighbouring documents with their lengths and the frequencies of
   the vocabulary's terms. It is written to the shared folder. N, L and the document frequencies are sums over it.
3. A block holds the maximum of each of its terms over its documents; with the weights these bound any of its scores.
   Each item's SEEDS blocks of the highest bounds are found and scored first, and give it a threshold that no document
   of its answer is under.
4. Then each task sorts its blocks by an item's bound and scores them until the bound drops below the item's threshold,
   which rises with every better document that the task meets. What is left of all tasks, at most K rows of each, is
   ranked by a window of the item.

Every document is counted and every block bounded; pruning only skips blocks that can't hold one of the answer, so the
result is that of scoring all. Scores are integers of 64 bits; weights are made from logarithms in doubles. Terms are
compared by hashes of 64 bits.

Cases: null and empty texts have no terms, and are not counted in N; an item without terms has no rows; repeated rows of
documents are ranked each, repeated rows of items are answered each; equal scores go by ascending doc_id, null last; empty
tables give an empty result; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftlake.llm import textkernel as tk
from siftlake.session import cut

K = 50
DOCS = 64
#: Blocks of each item that are scored first.
SEEDS = 4
#: Bytes of the items of one query block, of which each counts ITEM_BYTES besides its text.
QUERY_BYTES = 8 << 20
ITEM_BYTES = 64
#: Blocks that a task holds at a time.
HELD = 128
#: Fixed values of the score.
SCALE, SLOPE, BASE = 1_000_000_000, 1000, 20
PERCENT, HALF = 100, 50
WEIGHT = 1000.0

INDEX = "block long, total long, doc_id array<long>, n array<long>, held array<int>, term array<int>, tf array<int>"


@dataclass
class Queries:
    """Items with the places of their terms in the sorted vocabulary (CSR), and later the weights of the terms."""

    item_id: list[int | None]
    vocabulary: np.ndarray
    terms: np.ndarray
    bounds: np.ndarray
    weight: np.ndarray | None = None
    n: int = 0
    length: int = 0

    def of(self, item: int) -> np.ndarray:
        return self.terms[self.bounds[item] : self.bounds[item + 1]]


def _term_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms, and for each text the index of its first."""
    starts, ends, first = tk.words(data, offsets, tk.LETTERS)
    return tk.word_hashes(data, starts, ends), first


def parse(items: pa.Table) -> Queries:
    """The queries of items (item_id, text) that have a term."""
    ids, found = [], []
    for batch in items.combine_chunks().to_batches():
        own = batch.column(batch.schema.get_field_index("item_id")).to_pylist()
        for low, high, data, offsets in tk.slices(batch, "text"):
            hashes, first = _term_hashes(data, offsets)
            for k in range(high - low):
                if first[k + 1] > first[k]:
                    ids.append(own[low + k])
                    found.append(np.unique(hashes[first[k] : first[k + 1]]))
    flat = np.concatenate(found) if found else np.zeros(0, np.uint64)
    vocabulary, terms = np.unique(flat, return_inverse=True)
    return Queries(ids, vocabulary, terms, np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int64))


def _forward(vocabulary: np.ndarray):
    """Blocks of documents: their lengths, and the terms of the vocabulary that each holds, with frequencies."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            for low, high, data, offsets in tk.slices(batch, "text"):
                hashes, first = _term_hashes(data, offsets)
                place = np.searchsorted(vocabulary, hashes)
                hit = np.flatnonzero(vocabulary[np.minimum(place, len(vocabulary) - 1)] == hashes)
                doc = np.searchsorted(first, hit, "right") - 1
                key, tf = np.unique(doc * len(vocabulary) + place[hit], return_counts=True)
                owner, term = key // len(vocabulary), (key % len(vocabulary)).astype(np.int32)
                n = np.diff(first)
                cuts = np.minimum(np.arange(0, high - low + DOCS, DOCS), high - low)
                posts = np.searchsorted(owner, cuts)
                count = len(cuts) - 1
                lists = lambda at, values: pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), values)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(block + np.arange(count)),
                        pa.array(np.add.reduceat(n, cuts[:-1])),
                        lists(cuts, ids.slice(low, high - low)),
                        lists(cuts, pa.array(n.astype(np.int64))),
                        lists(cuts, pa.array(np.bincount(owner, minlength=high - low).astype(np.int32))),
                        lists(posts, pa.array(term)),
                        lists(posts, pa.array(tf.astype(np.int32))),
                    ],
                    ["block", "total", "doc_id", "n", "held", "term", "tf"],
                )
                block += count

    return blocks


def _frequencies(size: int):
    """How many documents hold each term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["term", "n"])

    return count


class Block:
    """The impacts of a block: a row for each term that it holds, a column for each document."""

    def __init__(self, row: dict[str, np.ndarray], queries: Queries) -> None:
        m = PERCENT - HALF + HALF * row["n"] * queries.n // max(queries.length, 1)
        doc = np.repeat(np.arange(len(row["held"])), row["held"])
        tf = row["tf"].astype(np.int64)
        self.term, self.doc = row["term"], doc
        self.impact = SCALE * tf // (SLOPE * tf + BASE * m[doc])
        self.size = len(row["held"])

    def bounds(self, queries: Queries) -> np.ndarray:
        """The most that any of its documents can score, for each item."""
        most = np.zeros(len(queries.vocabulary), np.int64)
        np.maximum.at(most, self.term, self.impact)
        return np.add.reduceat((most * queries.weight)[queries.terms], queries.bounds[:-1])

    def matrix(self) -> tuple[np.ndarray, np.ndarray]:
        present, row = np.unique(self.term, return_inverse=True)
        out = np.zeros((len(present), self.size), np.int32)
        out[row, self.doc] = self.impact
        return present, out


def _scores(present: np.ndarray, matrix: np.ndarray, terms: np.ndarray, weight: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(present, terms), len(present) - 1)
    here = present[at] == terms
    return weight[terms[here]] @ matrix[at[here]]


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, dict[str, np.ndarray]]]:
    """(block, ids, whether each is null, arrays) of the blocks that hold a posting."""
    columns = {c: batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "n", "held", "term", "tf")}
    offsets = {c: a.offsets.to_numpy() for c, a in columns.items()}
    values = {c: a.values.to_numpy(zero_copy_only=False) for c, a in columns.items() if c != "doc_id"}
    ids = columns["doc_id"].values
    missing, known = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
    for k, block in enumerate(batch.column(batch.schema.get_field_index("block")).to_pylist()):
        span = {c: slice(o[k], o[k + 1]) for c, o in offsets.items()}
        if span["term"].stop > span["term"].start:
            yield block, known[span["doc_id"]], missing[span["doc_id"]], {c: v[span[c]] for c, v in values.items()}


def _best_blocks(queries: Queries):
    """(item, bound, block): the SEEDS blocks of a task with the highest bounds of each item."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = len(queries.item_id)
        top = np.zeros((items, SEEDS), np.int64)
        named = np.full((items, SEEDS), -1, np.int64)
        for batch in batches:
            for block, _, _, row in _rows(batch):
                bound, lowest = Block(row, queries).bounds(queries), top.argmin(axis=1)
                better = np.flatnonzero(bound > top[np.arange(items), lowest])
                top[better, lowest[better]], named[better, lowest[better]] = bound[better], block
        item, k = np.nonzero(named >= 0)
        yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), pa.array(top[item, k]), pa.array(named[item, k])], ["item", "bound", "block"])

    return best


def _groups(blocks: Iterator) -> Iterator[list]:
    while own := list(islice(blocks, HELD)):
        yield own


class Answers:
    """The best K documents of an item so far, and the score that the next must reach."""

    def __init__(self, threshold: int) -> None:
        self.least = max(threshold, 1)
        self.score, self.doc, self.missing = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, scores: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> None:
        at = np.flatnonzero(scores >= self.least)
        if not len(at):
            return
        score, doc, null = np.concatenate([self.score, scores[at]]), np.concatenate([self.doc, ids[at]]), np.concatenate([self.missing, missing[at]])
        order = np.lexsort((doc, null, -score))[:K]
        self.score, self.doc, self.missing = score[order], doc[order], null[order]
        if len(order) == K:
            self.least = max(self.least, int(self.score[-1]))


def _answers(queries: Queries, threshold: np.ndarray, only: dict[int, list[int]] | None = None):
    """(item, doc_id, score): a task's best K of each item; of the blocks that are named for an item, if only is given."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answers: dict[int, Answers] = {}
        for blocks in _groups(row for batch in batches for row in _rows(batch) if only is None or row[0] in only):
            own = [Block(row, queries) for *_, row in blocks]
            bound = np.stack([b.bounds(queries) for b in own])
            if only is not None:
                asked = np.zeros(bound.shape, bool)
                for k, (block, *_) in enumerate(blocks):
                    asked[k, only[block]] = True
                bound = np.where(asked, bound, 0)
            matrices: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for item in np.flatnonzero(bound.max(axis=0) >= np.maximum(threshold, 1)).tolist():
                mine = answers.setdefault(item, Answers(int(threshold[item])))
                terms = queries.of(item)
                for k in np.argsort(-bound[:, item], kind="stable").tolist():
                    if bound[k, item] < mine.least:
                        break
                    if k not in matrices:
                        matrices[k] = own[k].matrix()
                    mine.add(_scores(*matrices[k], terms, queries.weight), blocks[k][1], blocks[k][2])
        for item, a in answers.items():
            if len(a.score):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a.score), item, np.int32)), pa.array(a.doc, mask=a.missing), pa.array(a.score)], ["item", "doc_id", "score"])

    return search


def _search(documents: DataFrame, queries: Queries) -> DataFrame:
    """item, item_id, rank, doc_id, score of the queries of one block."""
    spark = documents.sparkSession
    size = len(queries.vocabulary)
    index = cut(documents.select("doc_id", "text").mapInArrow(_forward(queries.vocabulary), INDEX))
    totals = index.select(F.expr("aggregate(n, 0L, (a, x) -> a + if(x > 0, 1L, 0L))").alias("n"), "total").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("total"), F.lit(0)).alias("length")).first()
    frequency = np.zeros(size, np.int64)
    for r in index.select("term").mapInArrow(_frequencies(size), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        frequency[r.term] = r.n
    queries.n, queries.length = totals.n, totals.length
    queries.weight = np.array([math.floor(WEIGHT * math.log((2 * totals.n + 2) / (2 * df + 1))) for df in frequency.tolist()], np.int64)
    first = index.mapInArrow(_best_blocks(queries), "item int, bound long, block long")
    order = Window.partitionBy("item").orderBy(F.desc("bound"), "block")
    seeds: dict[int, list[int]] = {}
    for r in first.withColumn("k", F.row_number().over(order)).where(F.col("k") <= SEEDS).select("item", "block").collect():
        seeds.setdefault(r.block, []).append(r.item)
    threshold = np.zeros(len(queries.item_id), np.int64)
    named = F.broadcast(spark.createDataFrame([(b,) for b in seeds], "block long"))
    tried = index.join(named, "block", "left_semi").select(*index.columns).mapInArrow(_answers(queries, threshold, seeds), "item int, doc_id long, score long")
    kth = Window.partitionBy("item").orderBy(F.desc("score"))
    for r in tried.withColumn("k", F.row_number().over(kth)).where(F.col("k") == K).select("item", "score").collect():
        threshold[r.item] = r.score
    found = index.mapInArrow(_answers(queries, threshold), "item int, doc_id long, score long")
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= K)
    names = spark.createDataFrame(list(enumerate(queries.item_id)), "item int, item_id long")
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def rank(documents: DataFrame, items: DataFrame, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the K best documents (doc_id, text) of each item (item_id, text)."""
    own = items.select("item_id", "text")
    total = own.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + ITEM_BYTES), F.lit(0)).alias("bytes")).first().bytes
    count = max(1, math.ceil(total / query_bytes))
    out = None
    for k in range(count):
        part = own if count == 1 else own.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k)
        queries = parse(part.toArrow())
        if queries.item_id:
            found = _search(documents, queries)
            out = found if out is None else out.unionByName(found)
    return items.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out


def op13_ranked(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """item_id, rank, doc_id, score."""
    return rank(documents, benchmark)
