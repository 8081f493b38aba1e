import random
import zlib

import numpy as np

from siftlake.llm import toxicity


def test_held_out_accuracy_and_corner_cases(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice(["th", "er", "an", "ou", "in", "st"]) for _ in range(rng.randint(1, 3)))
    rows, labels = [], []
    for k in range(900):
        words = [word() for _ in range(rng.randint(15, 120))]
        bad = k % 6 == 0
        for _ in range(3 if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["foulword", "nastiness", "vileterm"]))
        rows.append((k, " ".join(words)))
        labels.append((k, int(bad)))
    rows += [(2000, None), (2001, ""), (None, "so much foulword and nastiness here"), (5, rows[5][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS score", "0 AS y")
    marks = spark.createDataFrame([*labels, (None, 1), (7, None)], "doc_id long, toxic int")
    out = toxicity.op5_toxicity(docs, marks).collect()
    assert len(out) == len(rows)
    held = [r for r in out if r.doc_id is not None and r.doc_id < 900 and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out if r.doc_id is not None)
    assert sum(r.predicted == (r.doc_id % 6 == 0) for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    assert next(r for r in out if r.doc_id is None).predicted == 1
    assert {r.predicted for r in out if r.doc_id in (2000, 2001)} == {0}
    # held-out labels must not matter
    lied = marks.selectExpr("doc_id", "IF(crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 4 = 2, 1 - toxic, toxic) AS toxic")
    again = {(r.doc_id, round(r.score, 9)) for r in toxicity.op5_toxicity(docs, lied).collect()}
    assert again == {(r.doc_id, round(r.score, 9)) for r in out}
    none = toxicity.op5_toxicity(docs, marks.limit(0)).collect()
    assert {r.score for r in none} == {0.0}
    assert toxicity.op5_toxicity(docs.limit(0), marks).count() == 0


def dense(rows, y, keep):
    """Counts, ratios, the choice of features and the fit as the module's text says, on a dense matrix."""
    grams = []
    for t in rows:
        b = bytes(32 if c in b"\t\n\v\f\r" else c for c in t.encode().lower())
        grams.append({(n, b[k : k + n]) for n in toxicity.SIZES for k in range(len(b) - n + 1)})
    bucket = {g: int(toxicity.buckets(np.frombuffer(g[1], np.uint8), g[0])[0]) for own in grams for g in own}
    held = [{bucket[g] for g in own} for own in grams]
    n = [sum(1 for v in y if v == k) for k in (0, 1)]
    scored = []
    for b in set().union(*held):
        c = [sum(b in h for h, v in zip(held, y) if v == k) for k in (0, 1)]
        odds = [np.log((c[k] + 0.5) / (n[k] + 1) / (1 - (c[k] + 0.5) / (n[k] + 1))) for k in (0, 1)]
        spread = sum(1 / (c[k] + 0.5) + 1 / (n[k] - c[k] + 0.5) for k in (0, 1))
        scored.append((abs(odds[1] - odds[0]) / spread**0.5, b, odds[1] - odds[0]))
    best = [s for s in sorted(scored, key=lambda s: (-round(s[0], 9), s[1])) if s[0] >= toxicity.SUREST][:keep]
    x = np.array([[s[2] * (s[1] in h) for s in best] + [1.0] for h in held])
    target, lam = np.array(y, float), np.append(np.full(len(best), toxicity.PENALTY), 1e-6)
    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-x @ w))
        w = w - np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(lam), x.T @ (p - target) + lam * w)
    return {s[1]: s[2] * v for s, v in zip(best, w)}, w[-1], held


def test_training_equals_a_dense_fit(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice(["th", "er", "An", "ou", "é"]) for _ in range(rng.randint(1, 3)))
    texts, y = [], []
    for k in range(120):
        words = [word() for _ in range(rng.randint(3, 15))]
        y.append(int(k % 4 == 0))
        if y[-1] ^ (k % 10 == 0):
            words.insert(rng.randrange(len(words)), rng.choice(["Foulword", "vile\tterm"]))
        texts.append(" ".join(words))
    ids = [k for k in range(1000) if zlib.crc32(str(k).encode()) % 4 != 2][: len(texts)]
    docs = spark.createDataFrame([*zip(ids, texts), (5000, "foulword unlabelled"), (5001, "")], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([*zip(ids, y), (next(k for k in range(1000) if zlib.crc32(str(k).encode()) % 4 == 2), 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    weights, intercept, held = dense(texts, y, toxicity.FEATURES)
    assert set(np.flatnonzero(model.weights)) == set(weights) and len(weights) > 10
    assert np.allclose([model.weights[b] for b in weights], list(weights.values()), atol=1e-3) and abs(model.intercept - intercept) < 1e-3
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    for i, h in zip(ids, held):
        assert abs(got[i] - 1 / (1 + np.exp(-intercept - sum(weights.get(b, 0.0) for b in h)))) < 1e-3
    assert abs(got[5001] - 1 / (1 + np.exp(-intercept))) < 1e-3
