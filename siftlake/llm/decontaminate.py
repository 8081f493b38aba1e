"""Benchmark decontamination: seeds of word pairs, then Smith-Waterman alignment.

Words are runs of letters and digits of the text in normal form (NFKC) with all of Unicode's case folded; start and end
count these words. Each benchmark item is a sequence of n words. The score of a
document is the best local alignment's share of the item's own (match 2, mismatch -1, gap -1); from LEAST_SCORE on the
item counts as leaked. Seeds lose no such alignment. Call two neighbouring words of the item kept if the document holds
both with at most one word between them. An alignment of m matches and e edits has 2m - e >= n at LEAST_SCORE 0.5. Of
its m - 1 gaps between matches those that aren't kept either leave out words of the item (one edit and one match each)
or hold two edits, so at least n/3 - 1 pairs are kept, within 2n words. So the commonest half of that number of pairs
(by occurrences in the whole corpus) can be left out of the seeds, and the words around places with at least as many
seeds as must remain are aligned. The choice of seeds changes the cost, not the result. Of an item of three words the
outer two are a pair as well.

The benchmark is the query set: it is collected in blocks of about BLOCK_ITEMS items or BLOCK_BYTES at most, each block is broadcast and all
documents pass it, twice (frequencies, alignment). Documents are never shuffled, and only matches are returned.

Cases: null and empty texts match nothing; items with null ids or texts, or of fewer than LEAST_WORDS words, match nothing;
repeated items match alike, each under its id; repeated rows of a doc_id give one match with the best score; a null
doc_id keeps its matches; an empty benchmark or corpus gives no match; clean() passes all columns through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from unicodedata import normalize

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.llm import textkernel as tk

LEAST_WORDS = 3
#: The bound of kept pairs holds for this score and these weights.
LEAST_SCORE = 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
BLOCK_ITEMS = 50_000
BLOCK_BYTES = 16_000_000
HITS = 2_000_000
_BITS = 20


def fold(text: str) -> str:
    """The text without differences of case and of composition; ASCII needs none of it, as word hashes fold A-Z."""
    return text if text.isascii() else normalize("NFKC", normalize("NFKC", text).casefold())


def word_sequence(text: str) -> np.ndarray:
    raw = np.frombuffer(fold(text or "").encode(), np.uint8)
    starts, ends, _ = tk.words(raw, np.array([0, len(raw)]), tk.LETTERS)
    return tk.word_hashes(raw, starts, ends)


def kept_pairs(n: int) -> int:
    """The least number of kept pairs in an alignment that counts."""
    return max(1, -(-n // 3) - 1)


@dataclass
class Pairs:
    """Pairs of items, sorted by hash, with a bitmap that most other pairs fail."""

    hashes: np.ndarray
    items: np.ndarray
    places: np.ndarray
    bitmap: np.ndarray

    @classmethod
    def of(cls, hashes: np.ndarray, items: np.ndarray, places: np.ndarray) -> Pairs:
        order = np.argsort(hashes, kind="stable")
        bitmap = np.zeros(1 << _BITS, bool)
        bitmap[hashes >> np.uint64(64 - _BITS)] = True
        return cls(hashes[order], items[order], places[order], bitmap)

    def hits(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of words that start a pair, their texts, and the first entry of the pair, in order of the texts."""
        found = []
        for apart in (1, 2):
            pairs = tk.pair_hashes(words, apart)
            at = np.flatnonzero(self.bitmap[pairs >> np.uint64(64 - _BITS)])
            entry = np.searchsorted(self.hashes, pairs[at])
            good = (entry < len(self.hashes)) & (self.hashes[np.minimum(entry, len(self.hashes) - 1)] == pairs[at]) if len(self.hashes) else np.zeros(len(at), bool)
            at, entry = at[good], entry[good]
            text = np.searchsorted(first, at, "right") - 1
            inside = at + apart < first[text + 1]
            found.append((at[inside], text[inside], entry[inside]))
        at, text, entry = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(text, kind="stable")
        return at[order], text[order], entry[order]


def align(item: np.ndarray, words: np.ndarray) -> tuple[int, int]:
    """The best local alignment's score, and where it ends in words."""
    slope = np.arange(len(words) + 1) * GAP
    row, best, end = np.zeros(len(words) + 1, np.int64), 0, 0
    for word in item:
        new = np.maximum(row + GAP, 0)
        new[1:] = np.maximum(new[1:], row[:-1] + np.where(words == word, MATCH, MISMATCH))
        row = np.maximum.accumulate(new - slope) + slope
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top
    return best, end


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, word hashes and first words of the texts, in bounded runs of rows."""
    folded = pa.array(map(fold, tk.string_column(batch, "text").to_pylist()), pa.large_string())
    for low, _, data, offsets in tk.slices(pa.RecordBatch.from_arrays([folded], ["text"]), "text"):
        starts, ends, first = tk.words(data, offsets, tk.LETTERS)
        yield low, tk.word_hashes(data, starts, ends), first


def _spans(seeds: Pairs, sizes: np.ndarray, needed: np.ndarray, hashes: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """(text, item, spans of words to align) wherever 2n words hold as many seeds of the item as are needed."""
    at, text, entry = seeds.hits(hashes, first)
    many = np.searchsorted(seeds.hashes, seeds.hashes[entry], "right") - entry
    sums = np.concatenate([[0], np.cumsum(many)])
    low = 0
    while low < len(at):
        # whole texts of at most HITS entries, or one text
        high = max(int(np.searchsorted(sums, sums[low] + HITS, "right")) - 1, low + 1)
        if high < len(at):
            start = int(np.searchsorted(text, text[high]))
            high = start if start > low else int(np.searchsorted(text, text[low], "right"))
        n = many[low:high]
        each = np.repeat(entry[low:high] - (sums[low:high] - sums[low]), n) + np.arange(n.sum())
        place, t, item = np.repeat(at[low:high], n), np.repeat(text[low:high], n), seeds.items[each]
        order = np.lexsort((place, item, t))
        place, t, item, own = place[order], t[order], item[order], seeds.places[each[order]]
        last = np.arange(len(order)) + needed[item] - 1
        end = np.minimum(last, len(order) - 1)
        good = np.flatnonzero((last < len(order)) & (t[end] == t) & (item[end] == item) & (place[end] - place < 2 * sizes[item]))
        place, t, item, own = place[good], t[good], item[good], own[good]
        size = sizes[item]
        # At most n words are inserted on either side.
        opens = np.maximum(first[t], place - own - size)
        closes = np.minimum(first[t + 1], place - own + 2 * size)
        cuts = np.flatnonzero((t[1:] != t[:-1]) | (item[1:] != item[:-1])) + 1
        for a, b in zip([0, *cuts], [*cuts, len(t)] if len(t) else []):
            yield int(t[a]), int(item[a]), list(zip(opens[a:b].tolist(), closes[a:b].tolist()))
        low = high


def _matches(seeds: Pairs, needed: np.ndarray, items: list[np.ndarray], batch: pa.RecordBatch) -> Iterator[tuple[int, int, float, int, int]]:
    """(row, item, score, first word, end word) of the leaks in a batch."""
    sizes = np.array([len(w) for w in items])
    for low, hashes, first in _slices(batch):
        for t, item, found in _spans(seeds, sizes, needed, hashes, first):
            best = (0.0, 0, 0)
            for a, b in _merged(found):
                score, end = align(items[item], hashes[a:b])
                share = score / (MATCH * len(items[item]))
                if share >= LEAST_SCORE and share > best[0]:
                    _, back = align(items[item][::-1], hashes[a : a + end][::-1])
                    best = (share, a + end - back - int(first[t]), a + end - int(first[t]))
            if best[0] >= LEAST_SCORE:
                yield low + t, item, *best


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _blocks(documents: DataFrame, benchmark: DataFrame) -> Iterator[tuple[list[int], list[np.ndarray], Pairs, np.ndarray]]:
    """Ids, words, seeds, and the number of seeds that an alignment holds at least, of the items of each block."""
    usable = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text")
    size = usable.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    blocks = max(-(-size.n // BLOCK_ITEMS), -(-size.bytes // BLOCK_BYTES))
    for k in range(blocks):
        rows = usable.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()
        items = [word_sequence(r.text) for r in rows]
        pairs = [tk.pair_hashes(w, 1) if len(w) >= LEAST_WORDS else w[:0] for w in items]
        owner = np.repeat(np.arange(len(items)), [len(p) for p in pairs])
        places = np.concatenate([np.arange(len(p)) for p in pairs]) if pairs else np.zeros(0, np.int64)
        three = [i for i, w in enumerate(items) if len(w) == 3]
        owner, places = np.concatenate([owner, three]).astype(np.int64), np.concatenate([places, np.zeros(len(three))]).astype(np.int64)
        every = Pairs.of(np.concatenate([*pairs, *(tk.pair_hashes(items[i], 2) for i in three)]) if len(owner) else np.zeros(0, np.uint64), owner, places)
        if not len(every.hashes):
            continue
        counts = _frequencies(documents, every)[np.searchsorted(every.hashes, every.hashes)]
        least = np.array([kept_pairs(len(w)) for w in items])
        order = np.lexsort((every.places, -counts, every.items))
        sorted_items = every.items[order]
        rank = np.arange(len(order)) - np.searchsorted(sorted_items, sorted_items)
        # What no text holds is no seed; what is left out for being common is taken off the number that is needed.
        common = rank < (least // 2)[sorted_items]
        seeds = order[~common & (counts[order] > 0)]
        yield [r.item_id for r in rows], items, Pairs.of(every.hashes[seeds], every.items[seeds], every.places[seeds]), least - least // 2


def _frequencies(documents: DataFrame, pairs: Pairs) -> np.ndarray:
    """How often the corpus holds each entry's pair, at the entry that is first of its hash."""
    sent = documents.sparkSession.sparkContext.broadcast(pairs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        counts = np.zeros(len(table.hashes), np.int64)
        for batch in batches:
            for _, hashes, first in _slices(batch):
                _, _, entry = table.hits(hashes, first)
                counts += np.bincount(entry, minlength=len(counts))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["entry", "n"])

    counts = np.zeros(len(pairs.hashes), np.int64)
    for r in documents.select("text").mapInArrow(count, "entry long, n long").groupBy("entry").agg(F.sum("n").alias("n")).collect():
        counts[r.entry] = r.n
    return counts


def matches(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, score, and the first and end word of the leaked passage: a row for each leak."""
    schema = "doc_id long, item_id long, score double, start long, end long"
    out = documents.sparkSession.createDataFrame([], schema)
    for ids, items, seeds, needed in _blocks(documents, benchmark):
        sent = documents.sparkSession.sparkContext.broadcast((ids, items, seeds, needed))

        def find(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, items, seeds, needed = sent.value
            for batch in batches:
                rows = list(_matches(seeds, needed, items, batch))
                if rows:
                    row, item, score, start, end = zip(*rows)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array([ids[i] for i in item], pa.int64()), pa.array(score, pa.float64()), pa.array(start, pa.int64()), pa.array(end, pa.int64())], ["doc_id", "item_id", "score", "start", "end"])

        out = out.union(documents.select("doc_id", "text").mapInArrow(find, schema))
    best = F.max_by(F.struct("start", "end"), F.struct("score", -F.col("start"))).alias("at")
    return out.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"), best).select("doc_id", "item_id", "score", "at.start", "at.end")


def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no benchmark item is leaked, with all their columns."""
    out = documents
    for _, items, seeds, needed in _blocks(documents, benchmark):
        sent = documents.sparkSession.sparkContext.broadcast((items, seeds, needed))

        def sift(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items, seeds, needed = sent.value
            for batch in batches:
                leaked = np.zeros(batch.num_rows, bool)
                for row, *_ in _matches(seeds, needed, items, batch):
                    leaked[row] = True
                yield batch.filter(pa.array(~leaked))

        out = out.mapInArrow(sift, documents.schema)
    return out


def op10_decontamination(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, score (rounded to 6 digits) and the words of each leaked passage."""
    return matches(documents, benchmark).withColumn("score", F.round("score", 6))
