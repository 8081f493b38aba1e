import os
import random
import re
from collections import Counter

import pytest

from siftlake.llm import neardup
from siftlake.llm.graphs import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Exact results of the driver's documents, computed once.
EXACT: dict = {}
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute_by_shingle(rows):
    """As brute, over the pairs that share a shingle."""
    classes, holders, pairs, sizes = {}, {}, [], {}
    for k, (_, t) in enumerate(rows):
        classes.setdefault(frozenset(shingles(t)), []).append(k)
    for own, ks in classes.items():
        pairs += [(k, ks[0]) for k in ks[1:]]
        sizes[ks[0]] = len(own)
        both = Counter(k for x in own for k in holders.get(x, ()))
        pairs += [(ks[0], k) for k, n in both.items() if 100 * n >= 75 * (len(own) + sizes[k] - n)]
        for x in own:
            holders.setdefault(x, []).append(ks[0])
    return brute(rows, pairs)


def brute(rows, pairs=None):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs if pairs is not None else ((a, b) for a in range(len(rows)) for b in range(a)):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            root[find(a)] = find(b)
    out, ids = {}, {}
    for k, (i, _) in enumerate(rows):
        ids.setdefault(find(k), []).extend([] if i is None else [i])
    for k, (i, _) in enumerate(rows):
        out.setdefault((i, rows[k][1]), set()).add((len(sets[k]), min(ids[find(k)], default=None)))
    return out


def corpus(n=25, copies=8, seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(3))
    rows = [(900, None), (901, ""), (902, " \n"), (903, "Three Short words"), (904, "three short words"), (905, "three short"), (None, "x y z a b c d")]
    rows += [(906, "Ä b c d e f"), (907, "ä b c d e f"), (908, "x y z a b c d")]
    for g in range(n):
        text = [word() for _ in range(rng.randint(8, 120))]
        for c in range(rng.randint(1, copies)):
            own = list(text)
            for _ in range(rng.randint(0, max(1, len(own) // 25))):
                own[rng.randrange(len(own))] = word()
            rows.append((g * 100 + c, (" " if c % 2 else "\n").join(own).upper() if c == 1 else " ".join(own)))
    return rows + [rows[-1], (5000, " ".join(word() for _ in range(20_000)))]


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS k1", "2 AS minima", "3 AS component_id")
    got = neardup.op7_near_duplicates(df).collect()
    assert len(got) == len(rows)
    want = brute(rows)
    by_id = {}
    for (i, _), v in want.items():
        by_id.setdefault(i, set()).update(v)
    for r in got:
        assert (r.n_shingles, r.component_id) in by_id[r.doc_id], r
        assert r.kept == (r.doc_id is not None and r.doc_id == r.component_id)
    return df


def test_against_all_pairs(spark):
    df = check(spark, corpus())
    out = neardup.deduplicate(df)
    assert out.columns == df.columns
    kept = out.collect()
    assert len(kept) == 3 + len({c for v in brute(corpus()).values() for n, c in v if n})
    assert neardup.op7_near_duplicates(df.limit(0)).count() == 0


def test_large_regions_and_clusters_lose_nothing(spark, monkeypatch):
    rows = corpus(6, 60, 5)
    for name, value in (("REGION_MAX", 5), ("CLUSTER_CLASSES", 8), ("PIVOTS", 3), ("BROADCAST_IDS", 0)):
        monkeypatch.setattr(neardup, name, value)
    check(spark, rows)


def test_depth_adapts_to_each_region(spark, monkeypatch):
    """Leaves are the shortest prefixes that few enough classes share, and only the last depth is joined whole."""
    monkeypatch.setattr(neardup, "REGION_MAX", 4)
    rng = random.Random(3)
    common = [rng.randrange(1 << 32) for _ in range(neardup.MINIMA)]
    sign = {}
    for k in range(40):
        own = list(common) if k < 20 else [rng.randrange(1 << 32) for _ in common]
        # 0 to 5 share four minima of each order, 6 to 9 three, 10 to 19 two
        keep = 4 if k < 6 else 3 if k < 10 else 2
        sign[k] = [m if k >= 20 or j % neardup.STEP < keep else rng.randrange(1 << 32) for j, m in enumerate(own)]
    rows = [(k, bytearray(b"".join(m.to_bytes(4, "little") for m in ms))) for k, ms in sign.items()]
    listed, joined = neardup._regions(spark.createDataFrame(rows, "node long, minima binary"))
    by_region = {}
    for r in listed.collect():
        by_region.setdefault((r.tree, r.region), set()).add(r.node)
    assert all(len(v) <= 4 for v in by_region.values())
    assert {r.node for r in joined.collect()} == set(range(6)) and joined.count() == 6 * neardup.TREES
    deep = sorted(map(sorted, by_region.values()))
    assert deep == []  # 3 minima are shared by 10 classes, 4 by 6; 10 to 19 are alone beyond two


def test_neighbours_are_the_components_of_agreeing_pairs():
    import numpy as np

    rng = np.random.default_rng(5)
    base = rng.integers(0, 256, (6, neardup.MINIMA), dtype=np.uint8)
    labels, region = [], []
    for r in range(30):
        own = []
        for _ in range(rng.integers(2, 12)):
            row = base[rng.integers(0, 6)].copy()
            at = rng.integers(0, neardup.MINIMA, rng.integers(0, 60))
            row[at] = rng.integers(0, 256, len(at))
            own.append(row.tobytes())
        labels += sorted(own)
        region += [r] * len(own)
    labels = np.frombuffer(b"".join(labels), np.uint8).reshape(-1, neardup.MINIMA)
    got = neardup.neighbours(np.array(region), labels)
    for r in range(30):
        at = [k for k, x in enumerate(region) if x == r]
        want = {k: {k} for k in at}
        for a in at:
            for b in at:
                if (labels[a] == labels[b]).sum() >= neardup.LEAST_AGREE and want[a] is not want[b]:
                    both = want[a] | want[b]
                    for k in both:
                        want[k] = both
        assert all((got[a] == got[b]) == (b in want[a]) for a in at for b in at)


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(k, k + 1) for k in range(0, 60)] + [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(150)] + [(500, k) for k in range(501, 560)] + [(7, 7)]
    root = {x: x for e in links for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[x] == find(x) for x in got) and {x for e in links if e[0] != e[1] for x in e} == set(got)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="the driver's tables are not there")
@pytest.mark.parametrize("partitions", [4, 8, 211])
def test_documents_against_all_pairs(spark, partitions):
    """Every document of the driver's table, at a size where adaptive execution acts."""
    df = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    if not EXACT:
        rows = [tuple(r) for r in df.collect()]
        EXACT.update({i: v for (i, _), vs in brute_by_shingle(rows).items() for v in vs})
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.op7_near_duplicates(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == EXACT
