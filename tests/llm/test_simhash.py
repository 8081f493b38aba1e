"""SimHash groups against all pairs of fingerprints that are made anew here."""

import random
import re

import numpy as np
import pytest
import xxhash

from siftlake.llm import simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fingerprint(text):
    w = WORD.findall((text or "").translate(LOWER))
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 4]).encode(), seed=42) for k in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(ids, fps):
    """The least id that each reaches over all pairs."""
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                root[find(a)] = find(b)
    least = {}
    for k, i in enumerate(ids):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [least.get(find(k)) for k in range(len(ids))]


def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    rows = [(900, None), (901, ""), (902, " \t\n"), (903, "One Two three"), (904, "one two\nTHREE"), (None, "a b c d e f"), (905, "a b c d e f"), (None, "only here and nowhere else"), (906, "É x é y z"), (906, "É x é y z")]
    for g in range(20):
        text = [word() for _ in range(rng.choice((30, 300, 900)))]
        for c in range(rng.randint(1, 9)):
            own = list(text)
            own[rng.randrange(len(own))] = word()
            rows.append((1000 - g * 20 + c, "  ".join(own) if c % 2 else " ".join(own).upper()))
    return rows + [(5000, " ".join(word() for _ in range(200_000)))]


@pytest.mark.parametrize("crowd", [simhash.CROWD, 1])
def test_documents_equal_all_pairs(spark, crowd):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS fp", "2 AS bucket", "3 AS component_id")
    fps = [fingerprint(t) for _, t in rows]
    want = sorted(zip([i for i, _ in rows], [f"{f:016x}" for f in fps], groups([i for i, _ in rows], fps)), key=str)
    got = simhash.near_duplicates(df, crowd).selectExpr("doc_id", "lpad(lower(hex(fp)), 16, '0')", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == want
    assert simhash.op11_simhash(df.limit(0)).collect() == []


def test_query_has_its_columns(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "doc_id long, text string")
    got = simhash.op11_simhash(df)
    assert got.dtypes == [("doc_id", "bigint"), ("fingerprint", "string"), ("component_id", "bigint")]
    assert {r.doc_id: r.component_id for r in got.collect()} == {1: 1, 2: 1, 3: 3}
    assert {r.fingerprint for r in got.where("doc_id = 3").collect()} == {"0" * 16}


def near(rng, base, most):
    for b in rng.sample(range(64), rng.randint(0, most)):
        base ^= 1 << b
    return base


@pytest.mark.parametrize("parts, crowd", [((2,), 4096), ((3,), 4096), ((4,), 4096), ((5,), 4096), ((2, 3, 4, 5), 8)])
def test_links_of_any_layout_span_all_pairs(spark, monkeypatch, parts, crowd):
    """Chains of near fingerprints, a dense ball, and many that agree in their low bits."""
    monkeypatch.setattr(simhash, "PARTS", parts)
    rng = random.Random(7)
    fps = {rng.getrandbits(64) for _ in range(150)} | {rng.getrandbits(44) << 20 for _ in range(120)}
    for base in list(fps)[:25]:
        fps |= {near(rng, base, 6) for _ in range(5)}
    ball = rng.getrandbits(64)
    fps = sorted(fps | {near(rng, ball, 3) for _ in range(120)})
    nodes = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    got = {(r.a & (1 << 64) - 1, r.b & (1 << 64) - 1) for r in simhash.links(nodes, len(fps), crowd).collect()}
    at = {f: k for k, f in enumerate(fps)}
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in got:
        root[max(find(at[a]), find(at[b]))] = min(find(at[a]), find(at[b]))
    assert [find(k) for k in range(len(fps))] == groups(range(len(fps)), fps)


def test_thresholds_are_unequal_where_a_part_is_dense():
    """Nodes that share a part's value skip it and spend its threshold on others; the sum of t + 1 holds for each."""
    rng = np.random.default_rng(3)
    fps = rng.integers(0, 1 << 64, 4000, dtype=np.uint64)
    fps[:3000] &= np.uint64(0xFFFFFFFFFFFF0000)
    both = simhash._pairs_of_bits(fps).reshape(64, 64)
    parts = simhash.deal_bits(both, len(fps), 4)
    assert sorted(b for p in parts for b in p) == list(range(64))
    assert any(set(p) == set(range(16)) for p in parts), "bits that go together share a part"
    shares = [[simhash._shares(np.bincount(simhash._value(fps, c), minlength=1 << len(c))) for c in simhash._chunks(p)] for p in parts]
    way = simhash.Layout(parts, shares, len(fps))
    limit = way.thresholds(fps)
    assert ((limit + 1).sum(axis=1) == simhash.DISTANCE + 1).all()
    dense = next(k for k, p in enumerate(parts) if set(p) == set(range(16)))
    assert (limit[:3000, dense] == -1).all() and (limit[:3000].max(axis=1) > 0).all()
    assert (limit[3000:, dense] >= 0).any()


def test_cheapest_equals_every_allocation():
    rng = np.random.default_rng(1)
    prices = [np.concatenate([np.zeros((9, 1)), np.sort(rng.random((9, 5)), axis=1)], axis=1) for _ in range(3)]
    limit, price = simhash.cheapest(prices)
    for r in range(9):
        ways = [(i, j, 5 - i - j) for i in range(6) for j in range(6 - i)]
        assert price[r] == pytest.approx(min(sum(prices[k][r, w[k]] for k in range(3)) for w in ways))
        assert price[r] == pytest.approx(sum(prices[k][r, limit[r, k] + 1] for k in range(3)))


def test_stars_keep_components():
    rng = random.Random(2)
    a, b = [rng.randrange(60) for _ in range(45)], [rng.randrange(60) for _ in range(45)]
    x, y = simhash.stars(np.array(a), np.array(b))
    root = list(range(60))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for p, q in zip(a, b):
        root[max(find(p), find(q))] = min(find(p), find(q))
    assert dict(zip(y.tolist(), x.tolist())) == {k: find(k) for k in range(60) if find(k) != k}
