"""Toxicity: a linear classifier of character n-grams, scaled by naive Bayes log-count ratios.

The features of a text are the hashed character n-grams (bytes, A-Z taken as a-z, white space as one kind) of the
lengths in SIZES that it holds, each counted once however often it occurs, so a long text is no more toxic for being
long. Training takes at most LABELLED labelled rows (those of the least hash):

1. how many toxic and other texts hold each bucket: summed per partition, then over partitions;
2. the log-count ratio r of each bucket; the FEATURES buckets whose ratio is surest (most standard errors from 0) stay;
3. logistic regression with an L2 penalty on r-scaled presence of these, fitted by Newton steps with conjugate
   gradients; texts carry at most FEATURES ids of two bytes, so what comes to the driver is bounded.

Scoring looks every position of a text up in the table of weights; whole texts, no shuffle, no cap.

Cases: null and empty texts have no features and get the score of the intercept; labels that are null, or of rows whose
crc32 is held out, don't train, and a doc_id labelled twice counts as toxic if one label says so; without labels of
both classes all weights are 0 and the score is the share of toxic labels (0 without labels); repeated rows get equal
scores; a null doc_id isn't held out and matches no label; no column but doc_id and text is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake.llm import textkernel as tk
from siftlake.llm.sampling import least_hashed
from siftlake.session import cut

SIZES = (4, 5, 6)
LABELLED = 12_000
BUCKET_BITS = 21
FEATURES = 4096
SUREST = 4.0
PENALTY = 1.0
THRESHOLD = 0.3
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[9, 10, 11, 12, 13]] = 32
_LETTER = (tk._splitmix(0xBEEF, 256) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def buckets(data: np.ndarray, size: int) -> np.ndarray:
    """The bucket of the n-gram that starts at each byte."""
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    code = _LETTER[_FOLD[data]]
    total = np.full(n, size * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
    for k in range(size):
        total = (total ^ code[k : k + n]) * np.uint32(0x85EBCA6B)
        total ^= total >> np.uint32(15)
    return (total * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BUCKET_BITS)


def _present(data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of the wanted buckets that each text holds, once each, by text."""
    found = []
    for size in SIZES:
        b = buckets(data, size)
        at = np.flatnonzero(wanted[b])
        text = np.searchsorted(offsets, at, "right") - 1
        inside = at + size <= offsets[text + 1]
        found.append((text[inside].astype(np.int64) << BUCKET_BITS) | b[at[inside]])
    once = np.unique(np.concatenate(found))
    return once >> BUCKET_BITS, once & ((1 << BUCKET_BITS) - 1)


@dataclass
class Model:
    weights: np.ndarray  # of buckets, log-count ratio included
    intercept: float

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        text, bucket = _present(data, offsets, self.weights != 0)
        z = self.intercept + np.bincount(text, self.weights[bucket], len(offsets) - 1)
        with np.errstate(over="ignore"):
            return 1 / (1 + np.exp(-z))


def fit(sizes: np.ndarray, features: np.ndarray, y: np.ndarray, ratio: np.ndarray, penalty: float = PENALTY, steps: int = 25) -> tuple[np.ndarray, float]:
    """Weights of presence scaled by ratio, and the intercept; sizes: number of features of each text."""
    row = np.repeat(np.arange(len(y)), sizes)
    value = ratio[features]
    times = lambda w: np.bincount(row, value * w[features], len(y)) + w[-1]
    back = lambda v: np.append(np.bincount(features, value * v[row], len(ratio)), v.sum())
    w, lam = np.zeros(len(ratio) + 1), np.append(np.full(len(ratio), penalty), 1e-6)
    w[-1] = np.log((y.mean() + 1e-9) / (1 - y.mean() + 1e-9))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(times(w), -50, 50)))
        gradient = back(p - y) + lam * w
        if np.abs(gradient).max() < 1e-5:
            break
        curve = np.maximum(p * (1 - p), 1e-6)
        step, r = np.zeros_like(w), -gradient
        d, rr = r.copy(), r @ r
        for _ in range(60):
            hd = back(curve * times(d)) + lam * d
            a = rr / (d @ hd)
            step, r = step + a * d, r - a * hd
            new = r @ r
            if new < 1e-10 * (gradient @ gradient):
                break
            d, rr = r + new / rr * d, new
        w = w + np.clip(step, -5, 5)
    return w[:-1] * ratio, float(w[-1])


def train(documents: DataFrame, labels: DataFrame) -> Model:
    """The model of labelled documents that aren't held out."""
    marks = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("y"))
    marks = least_hashed(marks, ["doc_id"], LABELLED)
    # The few labelled texts are read once, and written for the two passes over them.
    rows = cut(documents.select("doc_id", "text").join(F.broadcast(marks), "doc_id").select("y", "text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = np.ones(1 << BUCKET_BITS, bool)
        counts = np.zeros((2, 1 << BUCKET_BITS), np.int32)
        texts = np.zeros(2, np.int64)
        for batch in batches:
            y = (batch.column(0).to_numpy() > 0).astype(int)
            texts += np.bincount(y, minlength=2)
            for low, high, data, offsets in tk.slices(batch, "text"):
                text, bucket = _present(data, offsets, every)
                for kind in (0, 1):
                    counts[kind] += np.bincount(bucket[y[low:high][text] == kind], minlength=counts.shape[1]).astype(np.int32)
        some = np.flatnonzero(counts.any(0))
        if texts.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), *(pa.array(np.append(counts[k][some], texts[k]).astype(np.int64)) for k in (0, 1))], ["bucket", "n0", "n1"])

    held = cut(rows.mapInArrow(count, "bucket long, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))
    empty = Model(np.zeros(1 << BUCKET_BITS), -np.inf)
    # Ratios need the sizes of the classes, which are the row of bucket -1.
    whole = held.where("bucket = -1").first()
    if whole is None:
        return empty
    if not whole.n0 or not whole.n1:
        return Model(empty.weights, -np.inf if not whole.n1 else np.inf)
    rate = lambda n, of: (F.col(n) + 0.5) / (of + 1.0)
    odds = lambda n, of: F.log(rate(n, of) / (1 - rate(n, of)))
    spread = lambda n, of: 1 / (F.col(n) + 0.5) + 1 / (F.lit(of) - F.col(n) + 0.5)
    ratio = odds("n1", whole.n1) - odds("n0", whole.n0)
    sure = F.abs(ratio) / F.sqrt(spread("n1", whole.n1) + spread("n0", whole.n0))
    best = held.where("bucket >= 0").select("bucket", ratio.alias("r"), sure.alias("sure")).where(F.col("sure") >= SUREST).orderBy(F.desc("sure"), "bucket").limit(FEATURES).collect()
    if not best:
        return Model(empty.weights, float(np.log(whole.n1 / whole.n0)))
    chosen, ratios = np.array([r.bucket for r in best]), np.array([r.r for r in best])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(1 << BUCKET_BITS, -1, np.int32)
        place[chosen] = np.arange(len(chosen))
        for batch in batches:
            for low, high, data, offsets in tk.slices(batch, "text"):
                text, bucket = _present(data, offsets, place >= 0)
                bounds = np.searchsorted(text, np.arange(high - low + 1))
                ids = place[bucket].astype("<u2")
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low).cast(pa.int64()), pa.array([ids[a:b].tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary())], ["y", "ids"])

    got = rows.mapInArrow(encode, "y long, ids binary").collect()
    got.sort(key=lambda r: (r.y, bytes(r.ids)))
    sizes = np.array([len(r.ids) // 2 for r in got])
    features = np.frombuffer(b"".join(bytes(r.ids) for r in got), "<u2").astype(np.int64)
    weights, intercept = fit(sizes, features, np.array([float(r.y > 0) for r in got]), ratios)
    empty.weights[chosen] = weights
    return Model(empty.weights, intercept)


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of each document."""
    some = np.flatnonzero(model.weights)
    sent = documents.sparkSession.sparkContext.broadcast((some, model.weights[some], model.intercept))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, values, intercept = sent.value
        weights = np.zeros(1 << BUCKET_BITS)
        weights[some] = values
        own = Model(weights, intercept)
        for batch in batches:
            for low, high, data, offsets in tk.slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(own.score(data, offsets))], ["doc_id", "score"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def op5_toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    out = score(documents, train(documents, labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
