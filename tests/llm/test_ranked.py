"""Ranked search against the scores of every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from siftlake.llm import ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(documents, items, k=50):
    docs = [(i, Counter(terms(t))) for i, t in documents]
    docs = [(i, c) for i, c in docs if c]
    n, length = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    weight = lambda t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
    out = []
    for item, text in items:
        scored = []
        for i, c in docs:
            m = 100 - 50 + (50 * sum(c.values()) * n) // length
            score = sum(weight(t) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                scored.append((-score, i is None, i))
        scored.sort(key=lambda s: (s[0], s[1], s[2] or 0))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(scored[:k])]
    return sorted(out, key=str)


def corpus(seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 4))) for _ in range(300)]
    text = lambda n: rng.choice((" ", ", ", "-", "_")).join(rng.choice(words[: rng.choice((10, 60, 300))]) for _ in range(n))
    documents = [(k, text(rng.choice((1, 5, 40, 400)))) for k in rng.sample(range(10_000), 700)]
    documents += [(20_000, None), (20_001, ""), (20_002, " .,- "), (None, text(9)), (None, text(9)), (20_003, "ABC abc aBc"), (20_003, "ABC abc aBc")]
    documents += [(30_000 + k, "one and the same text") for k in range(90)] + [(50_000, text(60_000))]
    items = [(k, text(rng.randint(1, 30))) for k in range(25)] + [(100, None), (101, ""), (102, "the same same"), (103, "nowhere"), (None, "abc"), (104, "abc"), (104, "abc"), (105, "É é ÉE")]
    return documents, items


@pytest.mark.parametrize("query_bytes, docs, held", [(ranked.QUERY_BYTES, ranked.DOCS, ranked.HELD), (400, 3, 5)])
def test_answers_equal_scoring_all(spark, monkeypatch, query_bytes, docs, held):
    monkeypatch.setattr(ranked, "DOCS", docs)
    monkeypatch.setattr(ranked, "HELD", held)
    documents, items = corpus()
    d = spark.createDataFrame(documents, "doc_id long, text string").selectExpr("*", "1 AS block", "2 AS n", "3 AS term").repartition(5)
    q = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS rank", "2 AS item")
    got = [tuple(r) for r in ranked.rank(d, q, query_bytes).collect()]
    assert sorted(got, key=str) == brute(documents, items)


def test_empty_tables(spark):
    documents, items = corpus()
    d, q = spark.createDataFrame(documents, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for found in (ranked.op13_ranked(d.limit(0), q), ranked.op13_ranked(d, q.limit(0)), ranked.op13_ranked(d.where("text = ''"), q), ranked.op13_ranked(d, q.where("item_id = 103"))):
        assert found.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
        assert found.collect() == []


def test_bounds_hold_and_prune():
    """No document of a block scores more than its bound, and blocks under the threshold are never made into matrices."""
    rng = np.random.default_rng(4)
    queries = ranked.Queries([1], np.arange(40, dtype=np.uint64), np.arange(0, 40, 3), np.array([0, 14]), rng.integers(0, 5000, 40), 900, 30_000)
    row = {"n": rng.integers(20, 90, 16), "held": np.full(16, 10, np.int32), "term": np.concatenate([rng.permutation(40)[:10] for _ in range(16)]), "tf": rng.integers(1, 9, 160).astype(np.int32)}
    block = ranked.Block(row, queries)
    scores = ranked._scores(*block.matrix(), queries.of(0), queries.weight)
    assert scores.max() <= block.bounds(queries)[0] and scores.max() > 0
    answers = ranked.Answers(int(scores.max()))
    answers.add(scores, np.arange(16), np.zeros(16, bool))
    assert answers.score.tolist() == [scores.max()] * int((scores == scores.max()).sum())


def test_pruning_skips_most_blocks(spark, monkeypatch):
    """Of blocks with rare terms of their own only few are scored."""
    made = []
    matrix = ranked.Block.matrix
    monkeypatch.setattr(ranked.Block, "matrix", lambda self: made.append(1) or matrix(self))
    queries = ranked.Queries([7], np.arange(2, dtype=np.uint64), np.array([0, 1]), np.array([0, 2]), np.array([10, 900]), 6400, 64_000)
    import pyarrow as pa

    def block(k):
        rare = k % 50 == 0
        term = [t for _ in range(64) for t in ((0, 1) if rare else (0,))]
        return [k, 640, list(range(64 * k, 64 * k + 64)), [10] * 64, [2 if rare else 1] * 64, term, [1] * len(term)]

    rows = [block(k) for k in range(100)]
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32())]
    batch = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["block", "total", "doc_id", "n", "held", "term", "tf"])
    (found,) = ranked._answers(queries, np.zeros(1, np.int64))(iter([batch]))
    assert found["doc_id"].to_pylist() == list(range(50)) and len(made) < 10
