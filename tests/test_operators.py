import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftlake import schemas as S
from siftlake.functions import labels, payload
from siftlake.operators import cuts, evaluation, feed, monitor, relief, runs, scoring, search, series

T0 = dt.datetime(2026, 3, 19, 10, 0)


def events(spark, rows):
    """rows: dicts of event fields; the rest is null."""
    names = [f.split()[0] for f in S.EVENT.split(", ")]
    full = [tuple((r | {"event_id": k} if "event_id" not in r else r).get(n, "kafka.update" if n == "event_type" else None) for n in names) for k, r in enumerate(rows)]
    return spark.createDataFrame(full, S.EVENT)


def message(seed, minute, topic, **more):
    return {"seed_id": seed, "created_at": T0 + dt.timedelta(minutes=minute), "topic": topic} | more


def test_lifecycle_cases(spark):
    cases = {
        "restart after best": ([("VND", 1, S.INITIAL), ("VND", 1, S.SOLUTIONS), ("VND", 1, S.BEST), ("VND", 1, S.RESTART)], False),
        "late best": ([("RVND", 0, S.INITIAL), ("RVND", 3, S.SOLUTIONS), ("RVND", 3, S.BEST)], True),
        "reopened": ([("RVND", 3, S.SOLUTIONS), ("RVND", 2, S.PROGRESS), ("RVND", 2, S.SOLUTIONS)], False),
        "completed progress": ([("VND", 3, S.SOLUTIONS), ("VND", 3, S.PROGRESS), ("VND", 3, S.BEST)], True),
    }
    rows = []
    for seed, (steps, _) in cases.items():
        for minute, (strategy, iteration, topic) in enumerate(steps):
            status = "completed" if topic == S.PROGRESS and seed == "completed progress" else "running"
            rows.append(message(seed, minute, topic, neighborhood=strategy, iteration_neighborhood=iteration, status=status))
    cycles = F.when(F.col("seed_id") == "restart after best", 2).when(F.col("seed_id") == "completed progress", 1).otherwise(3)
    searches = F.when(F.col("seed_id") == "completed progress", 3).otherwise(2)
    got = {r.seed_id: r.completed for r in runs.lifecycle(events(spark, rows), cycles, searches).collect()}
    assert got == {seed: done for seed, (_, done) in cases.items()}


def test_research_summary_fixture(spark):
    at = lambda s: dt.datetime(2026, 3, 30, 12, 0, s)
    own = spark.createDataFrame(
        [
            ("seed-1", "req-1", "IG", "BIT_FLIP", "VND", "train-a.arff", "test-a.arff", 96.0, 96.0, 50.0, 40.0, [1, 2], [3, 4, 5], at(0), at(10)),
            ("seed-2", "req-2", "GR", "IWSS", "RVND", "train-b.arff", "test-b.arff", 90.0, 90.0, None, None, [2, 3], [4, 5, 6], at(3), at(20)),
        ],
        "seed_id string, request_id string, rcl_algorithm string, local_search string, neighborhood string, training_file_name string, testing_file_name string, best_score double, current_score double, "
        "cpu_usage double, memory_usage_percent double, solution_features array<int>, rcl_features array<int>, created_at timestamp, updated_at timestamp",
    )
    history = spark.createDataFrame([("seed-1", "req-1", at(2), 88.0, 8.0, True), ("seed-1", "req-1", at(7), 96.0, 8.0, True), ("seed-2", "req-2", at(9), 90.0, 3.0, True)], "seed_id string, request_id string, at timestamp, score double, delta double, improved boolean")
    seen = spark.createDataFrame([("req-1", at(1), None), ("req-2", at(4), 97.0)], "request_id string, at timestamp, score double")
    r = runs.research_summary(own, history, seen).first()
    assert (r.runs, r.dataset_pairs, r.high_quality_runs, r.seconds_to_high_quality, r.best_seed, r.best_score) == (2, 2, 1, 7, "seed-1", 96.0)
    assert (r.improvements, r.avg_improvement, r.max_improvement, r.requests) == (3, round(19 / 3, 6), 8.0, 2)
    assert (r.runs_with_history, r.runs_with_telemetry, r.history_coverage, r.telemetry_coverage, r.avg_history_depth) == (2, 1, 1.0, 0.5, 1.5)
    assert (r.observation_seconds, r.unique_features, r.avg_solution_size, r.avg_rcl_size) == (20, 3, 2.0, 3.0)
    assert (r.searches, r.strategies) == ("BIT_FLIP,IWSS", "RVND,VND")


def test_payload_paths(spark):
    rows = [
        '{"payload":{"historyEntry":{"f1Score":"91.5"},"f1Score":1}}', '{"payload":{"bestF1Score":"","f1Score":2},"f1Score":3}', '{"f1Score":-4}',
        '{"f1Score":"1e5"}', '{"f1Score":"+5"}', '{"f1Score":".5"}', "not json", None,
    ]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in rows], "payload string").select(payload.score()).collect()]
    assert got == [91.5, None, -4.0, None, None, None, None, None]


def test_labels(spark):
    row = spark.range(1).select(
        labels.byte_size(F.lit(1536)).alias("a"), labels.byte_size(F.lit(500)).alias("b"), labels.byte_size(F.lit(20 * 1024**2)).alias("c"), labels.family_key(F.lit("KDD_Train+.arff")).alias("d"),
        labels.role_of(F.lit("x-TESTING.csv")).alias("e"), labels.export_name("runs", [F.lit("Seed 1/2"), F.lit(""), F.lit(None).cast("string")], "json").alias("f"), labels.feature_list(F.lit("1, 2  3")).alias("g"),
        labels.dataset_pair(F.lit(" "), F.lit("t")).alias("h"), runs.enabled_searches(F.array(F.lit("iwss "), F.lit("IWSS"), F.lit("x"))).alias("i"), runs.enabled_searches(F.lit(None).cast("array<string>")).alias("j"),
    ).first()
    assert tuple(row) == ("1.50 KB", "500 B", "20.0 MB", "kdd", "testing", "runs-seed-1-2.json", ["1", "2", "3"], "--|t", ["IWSS"], list(S.LOCAL_SEARCHES))


def test_feed_filters(spark):
    e = events(spark, [message("a", 1, S.BEST, score=1.0, local_search="Iwss"), message("b", 2, S.PROGRESS, score=2.0), message("a%", 3, S.BEST, score=None, event_type="gateway")])
    n = lambda **f: feed.count(e, feed.Filters(**f)).first().n
    assert (n(), n(seed_id="a"), n(local_search="IWSS"), n(text="BEST"), n(least_score=1.5), n(since=T0 + dt.timedelta(minutes=2)), n(topics=[S.BEST, S.BEST])) == (2, 1, 1, 1, 1, 1, 1)
    assert feed.pages(0) == 1 and feed.pages(51, 25) == 3 and feed.page(e, feed.Filters(), 1, 1).first().seed_id == "b"
    assert e.where(feed.within("created_at", T0 + dt.timedelta(minutes=3), None)).count() == 1


def test_null_scores_and_ties(spark):
    e = events(spark, [message("a", 1, S.SOLUTIONS, score=None), message("a", 2, S.SOLUTIONS, score=0.0), message("a", 2, S.SOLUTIONS, score=5.0), message("a", 3, S.SOLUTIONS, score=5.0), message(None, 4, S.SOLUTIONS, score=9.0)])
    assert [r.event_id for r in monitor.verified_best(e).orderBy("event_id").collect()] == [0, 2]
    assert [r.event_id for r in monitor.improvements(e).collect()] == [2]
    run = monitor.fold_runs(e).first()
    assert (run.seed_id, run.best_score, run.current_score, run.updates) == ("a", 5.0, 5.0, 4)
    assert monitor.fold_runs(e.limit(0)).count() == 0


def test_downsample_keeps_extremes(spark):
    rng = random.Random(1)
    ys = [rng.random() for _ in range(500)]
    out = series.downsample(spark.createDataFrame([("s", k, y) for k, y in enumerate(ys)], "s string, x int, y double"), ["s"], "x", "y", 50).collect()
    kept = {r.x: r.y for r in out}
    assert len(kept) <= 52 and {0, 499} <= set(kept) and {min(ys), max(ys)} <= set(kept.values())


def test_scores_of_known_tables(spark):
    data = spark.createDataFrame([("a", "x", "p", 1), ("a", "y", "p", 1), ("b", "x", "q", 0), ("b", "y", "q", None)] * 2, "same string, noise string, copy string, k int").withColumn("class", F.col("copy"))
    got = {r.feature: (r.info_gain, r.gain_ratio, r.symmetrical_uncertainty) for r in scoring.scores(data, ["same", "noise"], "class").collect()}
    assert got == {"same": (1.0, 1.0, 1.0), "noise": (0.0, 0.0, 0.0)}
    assert [r.feature for r in scoring.top_features(scoring.scores(data, ["noise", "same"], "class"), "info_gain", ["noise", "same"], 1).collect()] == ["same"]


def mdl(x, y):
    """The cuts of a feature by recursion over its sorted rows."""
    order = np.argsort(x, kind="stable")
    x, y = x[order], np.eye(len(set(y.tolist())), dtype=np.int64)[np.unique(y, return_inverse=True)[1]][order]
    at = [k for k in range(1, len(x)) if x[k] > x[k - 1]]
    costs = [(k, sum(len(p) * float(cuts.entropy(p.sum(0))) for p in (y[:k], y[k:])) / len(x)) for k in at]
    if not costs:
        return []
    k, cost = min(costs, key=lambda c: (round(c[1], 12), c[0]))
    n, parts = len(x), [p.sum(0) for p in (y, y[:k], y[k:])]
    h, kinds = [float(cuts.entropy(p)) for p in parts], [(p > 0).sum() for p in parts]
    delta = np.log2(3.0 ** kinds[0] - 2) - sum(s * a * b for s, a, b in zip((1, -1, -1), kinds, h))
    if h[0] - cost <= (np.log2(n - 1) + delta) / n:
        return []
    back = y.argmax(1)
    return sorted([*mdl(x[:k], back[:k]), float((x[k - 1] + x[k]) / 2), *mdl(x[k:], back[k:])])


@pytest.mark.parametrize("partitions", [1, 7])
def test_cuts_equal_recursion_over_rows(spark, partitions):
    rng = np.random.default_rng(0)
    n = 900
    step, noise = rng.integers(0, 60, n).astype(float), rng.normal(size=n)
    y = (step > 20).astype(int) + (step > 45) * (rng.random(n) < 0.9)
    normal = rng.normal(size=n)
    rows = [(float(a), float(b), float(c), None if k % 50 == 0 else float(a + b), f"c{d}") for k, (a, b, c, d) in enumerate(zip(step, noise, normal, y))]
    df = spark.createDataFrame([*rows, (float("nan"), None, 1.0, 1.0, "c0"), (1.0, 1.0, 1.0, 1.0, None)], "step double, noise double, normal double, both double, class string").repartition(partitions)
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = cuts.mdl_cuts(df, ["step", "noise", "normal", "both"], "class")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    at = {c: k for k, c in enumerate(("step", "noise", "normal", "both"))}
    for name, k in at.items():
        own = [(r[k], r[4]) for r in [*rows, (np.nan, None, 1.0, 1.0, "c0")] if r[k] is not None and r[k] == r[k]]
        assert got[name] == mdl(np.array([v for v, _ in own]), np.array([int(c[1]) for _, c in own])), name
    assert len(got["step"]) == 2 and got["normal"] == []


def test_bins(spark):
    # Whichever of two values has the lesser hash, the few rows of the other are seen beside more than 50,000 of it.
    for many in (0, 1):
        df = spark.range(60_000).selectExpr(f"CAST(IF(id < 55000, {many}, {1 - many}) AS DOUBLE) AS f").selectExpr("f", "IF(f = 0, 'r', 's') AS class")
        df = df.unionByName(spark.createDataFrame([(float("nan"), "s"), (None, "s")], "f double, class string"))
        assert sorted((r.f, r["count"]) for r in scoring.binned(df, ["f"], "class").where("f IS NOT NULL").groupBy("f").count().collect()) == [(0, 55_000 if not many else 5_000), (1, 5_001 if not many else 55_001)]
    assert cuts.mdl_cuts(df.limit(0), ["f"], "class") == {"f": []} and cuts.mdl_cuts(df, [], "class") == {}
    assert scoring.binned(df.where("f = 0"), ["f"], "class").select("f").distinct().collect() == [(0,)]


@pytest.mark.parametrize("block, group", [(1024, 8), (32, 2)])
def test_relieff_equals_all_pairs(spark, monkeypatch, block, group):
    rng = np.random.default_rng(5)
    x, y = rng.random((500, 3)), rng.choice(["a", "b", "b", "c"], 500)
    x[:60] = np.round(x[:60], 1)
    x[60:70] = x[60]
    x = (x - x.min(0)) / (x.max(0) - x.min(0))
    # Equally far rows go by class, distance from the middle, and values.
    order = np.lexsort((*x.T[::-1], np.abs(x - 0.5).sum(1), y))
    x, y = x[order], y[order]
    far = np.zeros((500, 500))
    for f in range(3):
        far += np.abs(x[:, f][:, None] - x[:, f])
    want = np.zeros(3)
    for i in range(500):
        for c in "abc":
            near = [j for j in np.argsort(far[i], kind="stable") if y[j] == c and j != i][:10]
            want += np.abs(x[near] - x[i]).mean(0) * (-1 if c == y[i] else (y == c).mean() / (1 - (y == y[i]).mean()))
    rows = [(*map(float, r), c) for r, c in zip(x, y)]
    df = spark.createDataFrame([*rows, (0.5, None, 0.5, "a"), (0.5, float("nan"), 0.5, "a"), (0.5, 0.5, 0.5, None)], "f0 double, f1 double, f2 double, class string").repartition(3)
    monkeypatch.setattr(relief, "BLOCK", block)
    monkeypatch.setattr(relief, "GROUP", group)
    got = {r.feature: r.relieff for r in relief.relieff(df, ["f0", "f1", "f2"], "class").collect()}
    assert np.allclose([got[f"f{k}"] for k in range(3)], want / 500, atol=1e-12)


def test_relieff_of_little_data(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "b")], "x double, class string")
    assert [(r.feature, r.relieff) for r in scoring.relieff(df, ["x"], "class").collect()] == [("x", 1.0)]
    assert [(r.feature, r.relieff) for r in scoring.relieff(df.limit(0), ["x"], "class").collect()] == [("x", 0.0)]
    assert [(r.feature, r.relieff) for r in scoring.relieff(df.limit(1), ["x"], "class").collect()] == [("x", 0.0)]


def test_relief_passes_over_far_blocks():
    """Blocks farther than the nearest so far aren't compared: their rows aren't even read."""
    import pyarrow as pa

    rows = lambda low: np.linspace(low, low + 0.01, 20)
    block = lambda k, low, asks, data: {"asks": asks, "block": k, "kind": 0, "low": 0.5 - low - 0.01, "high": 0.5 - low, "rows": data}
    near = [block(0, 0.0, True, rows(0.0).tobytes()), block(0, 0.0, False, rows(0.0).tobytes()), block(1, 0.4, False, rows(float("nan")).tobytes())]
    table = relief._nearest(1, 1024, 5)(pa.Table.from_pylist(near))
    assert table.num_rows == 100 and set((table["near"].to_numpy() // 1024).tolist()) == {0}


@pytest.mark.parametrize("width", [2, 64, 300])
def test_relief_sums_only_what_may_be_near(width):
    """Steps rule out most pairs, and none of the nearest, whether a limit is known or not."""
    rng = np.random.default_rng(8)
    x, grid = rng.random((700, width)), relief.Grid(width)
    x[5] = x[900 % 700]
    far = np.abs(x[:100, None] - x[None]).sum(2)
    far[np.arange(100), np.arange(100)] = np.inf
    worst = np.sort(far, 1)[:, 9]
    steps, half = grid.of(x)
    for limit in (worst, np.where(np.arange(100) % 2, worst, np.inf)):
        row, col = relief._near_ones(grid, steps[:100], np.ascontiguousarray(steps.T), half, np.arange(100), limit, 10, np.empty((2, 128, 700), grid.kind))
        got = set(zip(row.tolist(), col.tolist()))
        assert got >= set(zip(*(v.tolist() for v in np.nonzero(far <= worst[:, None])))) and len(got) < 5_000


@pytest.fixture(scope="module")
def problem(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(300):
        c = k % 3
        rows.append((float(rng.normal(c, 0.3)), float(rng.normal()), float(rng.normal(-c, 0.5)), float(rng.normal()), ["normal", "dos", "probe"][c]))
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, class string")
    return search.Problem.of(df.limit(200), df, "normal")


def one(spark, problem, subsets, name):
    rows = search.evaluate_subsets(spark.createDataFrame(list(enumerate(subsets)), "k int, features array<int>"), problem, name).collect()
    return [r for r in sorted(rows, key=lambda r: r.k)]


@pytest.mark.parametrize("name", ["J48", "NB", "RF"])
def test_classifiers_and_confusion(spark, problem, name):
    good, bad, none, beyond, again = one(spark, problem, [[1, 3], [2, 4], [], [99], [3, 1, 3, 77]], name)
    assert good.f1 > 90 > bad.f1 and good.tp + good.tn + good.fp + good.fn == 300
    assert none.f1 == beyond.f1 == 0.0 and none.tp + none.tn + none.fp + none.fn == 0
    assert again.features == [3, 1, 3, 77] and (again.tp, again.fn) == (good.tp, good.fn)


def test_nulls_and_empty_data(spark):
    rows = [(1.0, 0.0, "a"), (2.0, 1.0, "b"), (None, 1.0, "b"), (float("nan"), 1.0, "a"), (3.0, 5.0, None)]
    df = spark.createDataFrame(rows, "x double, z double, class string")
    p = search.Problem.of(df, df, "a")
    assert p.classes == ["a", "b"] and p.train.count() == 2
    for name in ("NB", "J48", "RF"):
        (got,) = one(spark, p, [[1, 2]], name)
        assert got.tp + got.tn + got.fp + got.fn == 2
        (got,) = one(spark, search.Problem.of(df.limit(0), df.limit(0)), [[1, 2]], name)
        assert got.f1 == 0.0
        (got,) = one(spark, search.Problem.of(df.limit(0), df, "a"), [[1]], name)
        assert got.tp + got.tn + got.fp + got.fn == 2


def test_bayes_equals_densities_of_all_rows(spark, problem):
    """Against densities made from the rows themselves."""
    rows = [(r.x, r.y) for r in problem.train.collect()]
    x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    tested = [(r.x, r.y) for r in problem.test.collect()]
    eps = 1e-9 * x.var(0).max() + 1e-12
    for subset in ([1], [2, 3], [1, 2, 3, 4]):
        at = [f - 1 for f in subset]
        want = [0, 0, 0, 0]
        for v, c in tested:
            log = [np.log((y == k).mean()) - 0.5 * sum(np.log(2 * np.pi * (x[y == k, f].var() + eps)) + (v[f] - x[y == k, f].mean()) ** 2 / (x[y == k, f].var() + eps) for f in at) for k in range(3)]
            g = int(np.argmax(log))
            want[0 if g == c and g else 1 if g == c else 2 if g else 3] += 1
        (got,) = one(spark, problem, [subset], "NB")
        assert [got.tp, got.tn, got.fp, got.fn] == want


def entropy(counts):
    p = counts[counts > 0] / counts.sum()
    return -(p * np.log2(p)).sum()


def grown(bins, y, features, depth):
    """A tree on binned rows, made recursively: (class,) or (feature, bin, left, right)."""
    counts = np.bincount(y, minlength=3)
    best = (-1.0, None, None)
    if depth and counts.max() < len(y) and len(y) >= 4:
        for f in features:
            for b in range(evaluation.BINS):
                low = bins[:, f] <= b
                if 2 <= low.sum() <= len(y) - 2:
                    share = low.mean()
                    gain = entropy(counts) - share * entropy(np.bincount(y[low], minlength=3)) - (1 - share) * entropy(np.bincount(y[~low], minlength=3))
                    ratio = round(gain / entropy(np.array([share, 1 - share])), 12)
                    if gain > 1e-9 and ratio > best[0]:
                        best = (ratio, f, b)
    if best[1] is None:
        return (int(counts.argmax()),)
    low = bins[:, best[1]] <= best[2]
    return best[1], best[2], grown(bins[low], y[low], features, depth - 1), grown(bins[~low], y[~low], features, depth - 1)


def as_tuple(tree, node=0):
    if tree.feature[node] < 0:
        return (tree.guess[node],)
    return tree.feature[node], tree.bin[node], as_tuple(tree, tree.child[node]), as_tuple(tree, tree.child[node] + 1)


@pytest.mark.parametrize("held", [evaluation.HELD, 1])
def test_trees_equal_trees_of_all_rows(spark, problem, monkeypatch, held):
    """Level by level, all nodes in one job or each in its own, the trees are those of a recursion over the rows."""
    monkeypatch.setattr(evaluation, "HELD", held)
    monkeypatch.setattr(evaluation, "DEPTH", 4 if held > 1 else 2)
    subsets = [[1], [2, 4], [1, 2, 3, 4]] if held > 1 else [[1, 2]]
    trees = evaluation.Trees(problem, subsets)
    rows = problem.train.collect()
    x, y = np.array([r.x for r in rows]), np.array([r.y for r in rows])
    for tree, subset in zip(trees.trees, subsets):
        assert as_tuple(tree) == grown(trees.binned(x), y, [f - 1 for f in subset], evaluation.DEPTH)


def test_forest_weighs_rows_by_their_hash(spark, problem):
    h = np.random.default_rng(1).integers(-(1 << 63), 1 << 63, 50_000)
    w = evaluation._weights(h, 3, 1)
    assert abs(w.mean() - 1) < 0.02 and abs((w == 0).mean() - np.exp(-1)) < 0.01
    assert (w == evaluation._weights(h, 3, 1)).all() and (w != evaluation._weights(h, 4, 1)).any()


def lists(spark, **columns):
    made = spark.range(1).select(*(F.array(*map(F.lit, v)).cast("array<int>").alias(k) for k, v in columns.items()))
    return lambda expr: [list(x) for x in made.select(expr.alias("x")).first().x]


def test_candidates(spark):
    at = lists(spark, f=[1, 2], r=[3, 4, 5], none=[])
    f, r, none = F.col("f"), F.col("r"), F.col("none")
    assert at(search.incremental(f, r, 2)) == [[1, 2, 3], [1, 2, 3, 4]] and at(search.incremental(f, none, 2)) == []
    assert at(search.incremental_replace(f, r, 1)) == [[1, 2, 3], [2, 3], [1, 3], [1, 2]] and at(search.incremental_replace(none, r, 1)) == [[3]]
    walk = at(search.bit_flip(f, r, 50, F.lit("s"), F.lit(1)))
    assert len(walk) == 50 and all(len(set(c)) == 2 for c in walk) and walk == at(search.bit_flip(f, r, 50, F.lit("s"), F.lit(1)))
    assert walk != at(search.bit_flip(f, r, 50, F.lit("s"), F.lit(2))) and len({tuple(c) for c in walk}) > 5
    assert at(search.bit_flip(f, none, 3, F.lit("s"), F.lit(1))) == [] and at(search.bit_flip(none, r, 5, F.lit("s"), F.lit(1)))[2:] != []


def test_starts(spark):
    rows = search.construct(spark, [9, 4, 7, 1], 5, 2, 3).collect()
    assert [len(x.features) for x in rows] == [2] * 5 and all(sorted([*x.features, *x.rcl]) == [1, 4, 7, 9] for x in rows)
    assert len({tuple(x.features) for x in rows}) > 1 and rows == search.construct(spark, [9, 4, 7, 1], 5, 2, 3).collect()
    assert [x.rcl for x in search.construct(spark, [1, 2], 1, 9, 3).collect()] == [[]]


@pytest.mark.parametrize("strategy", S.STRATEGIES)
def test_search_improves_and_repeats(spark, problem, strategy):
    ask = search.Request(generations=2, cutoff=4, sample=1, classifier="NB", strategy=strategy, cycles=2, steps={"BIT_FLIP": 3, "IWSS": 3, "IWSSR": 2}, seed=4)
    rows = search.run_search(spark, [2, 4, 1, 3], problem, ask).orderBy("seed_id", "iteration", "step").collect()
    assert {r.topic for r in rows} == {S.INITIAL, S.PROGRESS, S.SOLUTIONS}
    for seed in {r.seed_id for r in rows}:
        own = [r for r in rows if r.seed_id == seed]
        told = [r for r in own if r.topic != S.PROGRESS]
        assert [r.best_f1 for r in told] == sorted(r.best_f1 for r in told)
        assert len(told) - 1 <= 2 * (3 if strategy == "VND" else 1)
        for before, r in zip(told, told[1:]):
            steps = [p for p in own if p.topic == S.PROGRESS and p.iteration == r.iteration]
            assert [p.step for p in steps] == list(range(1, len(steps) + 1)) and {p.best_f1 for p in steps} <= {before.best_f1}
            assert r.best_f1 == max([before.best_f1, *(p.f1 for p in steps)]) and r.f1 == max([p.f1 for p in steps], default=before.best_f1)


def test_request_checks():
    assert search.Request(searches=["iwss", "nope", "IWSS"]).searches == ["IWSS"] and search.Request(searches=[]).searches == list(S.LOCAL_SEARCHES)
    for bad in ({"cutoff": 0}, {"strategy": "VNS"}, {"classifier": "SVM"}):
        with pytest.raises(ValueError):
            search.Request(**bad)
