import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from siftlake import schemas as S
from siftlake.operators import feed, monitor, runs, views
from siftlake.plans import registry, service
from siftlake.sources import arff, eventlog, sinks

T0 = dt.datetime(2026, 3, 19, 10, 0)
NAMES = [f.split()[0] for f in S.EVENT.split(", ")]


def events(spark, rows):
    full = [tuple(({"event_id": k, "event_type": "kafka.update"} | r).get(n) for n in NAMES) for k, r in enumerate(rows)]
    return spark.createDataFrame(full, S.EVENT)


def folded(messages, cycles=2, searches=3):
    """The state of one seed, message by message."""
    s = {"best_score": None, "updates": 0, "status": None, "completed_at": None, "history_count": 0}
    for m in messages:
        budget = cycles * searches if (m.get("neighborhood") or "").upper() == "VND" else cycles
        ends = m["topic"] == S.SOLUTIONS and m.get("iteration_neighborhood") is not None and m["iteration_neighborhood"] >= budget
        keeps = s["status"] == "completed" and not ends
        score, before = m.get("score"), s["best_score"]
        fresh = {"current_score": score, "previous_best": before, "delta": None if score is None or before is None else round(score - before, 6), "improved": score is not None and (before is None or score > before)}
        for c, v in fresh.items():
            s[c] = (s.get(c) if s.get(c) is not None else v) if keeps else v
        for c in ("local_search", "neighborhood", "iteration_neighborhood", "solution_features", "rcl_features"):
            old, new = s.get(c), m.get(c)
            first, second = (old, new) if keeps else (new, old)
            s[c] = first if first not in (None, "") else second
        for c in ("request_id", "rcl_algorithm", "classifier", "training_file_name", "testing_file_name"):
            s[c] = m.get(c) or s.get(c)
        for c in ("cpu_usage", "memory_usage", "memory_usage_percent"):
            s[c] = m.get(c)
        if not keeps:
            s |= {"stage": m["stage"], "topic": m["topic"], "status": "completed" if ends else "running"}
        if ends:
            s["completed_at"] = m["created_at"]
        if score is not None:
            s["best_score"] = score if before is None else max(before, score)
        s["updates"] += 1
        s["history_count"] += m["topic"] != S.PROGRESS
        s["created_at"], s["updated_at"] = s.get("created_at", m["created_at"]), m["created_at"]
    return s


def test_run_states_against_a_fold(spark):
    rng = random.Random(3)
    some = lambda *v: rng.choice([*v, None])
    rows = []
    for seed in range(60):
        strategy = rng.choice(S.STRATEGIES)
        for k in range(rng.randint(1, 14)):
            topic = rng.choice([*S.TOPICS, S.SOLUTIONS, S.SOLUTIONS])
            rows.append({
                "seed_id": f"s{seed}", "created_at": T0 + dt.timedelta(minutes=k), "topic": topic, "stage": f"stage {k}", "neighborhood": strategy, "iteration_neighborhood": some(0, 1, 2, 6),
                "score": some(1.0, 2.5, 3.25, 9.0), "local_search": some("IWSS", "BIT_FLIP", ""), "request_id": some("r1", "r2", ""), "rcl_algorithm": some("IG"), "classifier": some("J48", "NB"),
                "cpu_usage": some(0.5), "solution_features": some([1, 2], [3]), "training_file_name": some("a.arff"),
            })
    want = {f"s{k}": folded([r for r in rows if r["seed_id"] == f"s{k}"]) for k in range(60)}
    got = {r.seed_id: r.asDict() for r in runs.run_states(events(spark, rows).repartition(3), F.lit(2), F.lit(3)).collect()}
    assert set(got) == set(want) and sum(w["status"] == "completed" for w in want.values()) > 10
    for seed, w in want.items():
        g = got[seed]
        assert {c: g[c] or None for c in w} == {c: v or None for c, v in w.items()}, seed


def test_launch_window(spark):
    """Runs and events of a launch: its algorithms, files and classifier, from its start to the next one; open fields take any."""
    at = lambda m: T0 + dt.timedelta(minutes=m)
    launches = spark.createDataFrame(
        [(1, "q1", 9, at(0), at(1), ["ig ", "GR"], "a", "b", "J48"), (2, "q2", 9, at(200), None, ["IG"], "a", "b", "J48"), (3, "q3", 9, at(300), at(301), ["IG"], "", None, None), (4, "q4", 9, at(400), at(401), ["RF"], "a", "b", "J48")],
        "launch_id long, request_id string, requested_by long, requested_at timestamp, started_at timestamp, algorithms array<string>, training_file_name string, testing_file_name string, classifier string",
    )
    run = lambda seed, algorithm, classifier, m, train="a": (seed, algorithm, train, "b", classifier, at(m), at(m + 1), True, 1.0)
    own = spark.createDataFrame(
        [run("early", "IG", "J48", 0), run("mine", "IG", "J48", 90), run("other", "IG", "NB", 90), run("queued", "IG", "J48", 250), run("any", "IG", "NB", 301, "z"), run("gone", "IG", "J48", 401)],
        "seed_id string, rcl_algorithm string, training_file_name string, testing_file_name string, classifier string, created_at timestamp, updated_at timestamp, completed boolean, best_score double",
    )
    found = runs.launch_runs(launches, own)
    assert {(r.launch_id, r.seed_id) for r in found.collect()} == {(1, "mine"), (1, "queued"), (2, "queued"), (3, "any")}
    e = events(spark, [{"seed_id": s, "request_id": q, "created_at": at(m), "topic": S.BEST} for s, q, m in (("x", "q1", 0), ("x", "q1", 300), ("x", "q1", 301), ("mine", None, 120), ("mine", "q1", 121), ("mine", "q1", 350), ("any", "q9", 320))])
    got = {(r.launch_id, r.event_id) for r in runs.launch_events(launches, e, found.select("launch_id", "seed_id")).collect()}
    assert got == {(1, 0), (1, 1), (1, 3), (1, 4), (3, 6)}
    assert runs.launch_runs(launches.limit(0), own).count() == 0 and runs.launch_runs(launches, own.limit(0)).count() == 0


def test_queue_places_go_on_over_days(spark):
    rows = [(k, T0 + dt.timedelta(hours=7 * (k % 9)), "queued" if k % 4 else "started") for k in range(40)]
    got = {r.launch_id: r.place for r in runs.queue_position(spark.createDataFrame(rows, "launch_id long, requested_at timestamp, state string")).collect()}
    order = sorted((t, k) for k, t, state in rows if state == "queued")
    assert got == {k: n + 1 for n, (_, k) in enumerate(order)}


def test_first_high_quality(spark):
    at = lambda m: T0 + dt.timedelta(minutes=m)
    run = spark.createDataFrame([("a", at(0), at(5), 90.0), ("b", at(1), at(6), 97.0), ("c", at(2), at(9), 99.0)], "seed_id string, created_at timestamp, updated_at timestamp, best_score double").withColumn("current_score", F.lit(None).cast("double"))
    log = lambda *x: spark.createDataFrame(list(x), "seed_id string, at timestamp, score double")
    high = lambda r, h, e: runs.first_high_quality(r, h, e).first().high_at
    assert high(run, log(), log()) == at(6)  # the first run that reached it, by its last update
    assert high(run, log(("c", at(3), 96.0)), log()) == at(3)  # a history that shows it earlier
    assert high(run, log(("a", at(8), 96.0)), log()) == at(8)  # shown by a run before that one
    assert high(run.where("seed_id = 'a'"), log(), log(("x", at(7), 95.0), ("x", at(4), 94.0))) == at(7)
    assert high(run.limit(0), log(), log()) is None


def test_snapshot_export(spark):
    own = [{"solution_features": [1, 2, 3], "score": 95.5, "seed_id": "s\"1", "created_at": T0, "topic": S.BEST}]
    rows = events(spark, own).withColumnRenamed("score", "current_score").withColumns({"best_score": F.lit(96.0), "previous_best": F.lit(90.0), "delta": F.lit(5.5)})
    r = sinks.flat(rows).first()
    assert list(r.asDict()) == list(sinks.SNAPSHOT_COLUMNS) and len(r) == 20
    assert (r.timestamp, r.currentF1Score, r.bestF1Score, r.previousBestF1Score, r.scoreDelta, r.seedId, r.solutionFeatures, r.cpuUsage) == ("2026-03-19T10:00:00.000Z", "95.5", "96.0", "90.0", "5.5", 's"1', "1 | 2 | 3", "")
    two = spark.createDataFrame([("a", "r1"), ("b", None)], "seed_id string, request_id string")
    s = sinks.export_summary(two, spark.createDataFrame([("a", "r2"), ("c", "")], "seed_id string, request_id string"), "r2").first()
    assert (s.runs, s.snapshots, s.seeds, s.requests) == (2, 2, 3, 2)


def test_payload_places(spark):
    body = [
        ('{"payload":{"seedId":"s","f1Score":1,"rclfeatures":[1,2],"historyEntry":{"f1Score":2,"rclFeatures":[7],"topic":"T2","enabledLocalSearches":["IWSS"],"improved":true}}}', (2.0, 1.0, [7], 1, "T2", ["IWSS"], True)),
        ('{"seedId":"s","currentF1Score":3,"bestF1Score":4,"rclFeatures":[1,2],"rclSize":9,"classfier":"NB"}', (3.0, 4.0, [1, 2], 9, "T", [], None)),
        ("no json", (None, None, [], 0, "T", [], None)),
    ]
    df = spark.createDataFrame([(k, None, None, "T", "kafka.update", None, T0, b) for k, (b, _) in enumerate(body)], "event_id long, seed_id string, request_id string, topic string, event_type string, stage string, created_at timestamp, payload string")
    got = {r.event_id: (r.current_score, r.best_score, r.rcl_features, r.rcl_size, r.topic, r.enabled_local_searches, r.improved) for r in eventlog.feed_snapshots(df).collect()}
    assert got == {k: w for k, (_, w) in enumerate(body)}


def test_options_windows_and_labels(spark):
    none = spark.createDataFrame([], S.EVENT)
    empty = none.select("rcl_algorithm", "training_file_name", "testing_file_name", "local_search", "neighborhood", "status")
    assert {(r.kind, r.value) for r in runs.option_values(empty, none).collect()} == {("status", "running"), ("status", "completed")}
    assert views.window_bounds("1h", T0) == (T0 - dt.timedelta(hours=1), T0) and views.window_bounds("custom", T0, T0) == (T0, None) and views.window_bounds("all", T0) == (None, None)
    shown = [r[0] for r in spark.createDataFrame([(5,), (65,), (3_700,), (90_000,), (-3,)], "n long").select(views.duration_label(F.col("n"))).collect()]
    assert shown == ["5s", "1m 5s", "1h 1m", "1d 1h", "0s"]


def test_topic_records_and_confirmations(spark):
    rows = spark.createDataFrame([("s", "J48", "a", None)], "seed_id string, classifier string, training_file_name string, testing_file_name string")
    r = sinks.to_topic(rows, S.BEST).first()
    assert (r.topic, r.key) == (S.BEST, "s") and r.value == '{"seed_id":"s","classifier":"J48","training_file_name":"a"}'
    box = service.Confirmations()
    assert box.poll(0.01) is None and box.offer(1) and not box.offer(2) and box.poll(1) == 1 and box.offer(3)


def test_arff_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1.5, 2.0, "x"), (None, 3.0, "@home"), (4.0, None, "x")], "a double, b double, class string")
    arff.write(df, f"{tmp_path}/d")
    back = arff.read(spark, f"{tmp_path}/d")
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect())) and back.schema["class"].metadata["values"] == ["@home", "x"]
    (tmp_path / "at.arff").write_text("@relation r\n@attribute w string\n@attribute class {a,b}\n@data\n@handle,a\nplain,b\n")
    assert sorted(r.w for r in arff.read(spark, f"{tmp_path}/at.arff").collect()) == ["@handle", "plain"]
    old, arff.ATTRIBUTES = arff.ATTRIBUTES, 1
    try:
        with pytest.raises(ValueError):
            arff.header(spark, f"{tmp_path}/at.arff")
    finally:
        arff.ATTRIBUTES = old


def test_feed_options():
    of = feed.Filters.of
    assert of({}) == of({"topics": None, "status": "odd", "datasetKey": "all", "start": "x", "minF1Score": "", "maxF1Score": "NaN", "query": "  ", "seedId": " "}) == feed.Filters()
    f = of({"topics": ["A", " A ", None, "B"], "status": " running ", "datasetKey": "--|b.arff", "start": 86_400_000, "end": "2024-01-02T03:04:05+02:00", "minF1Score": 0, "maxF1Score": "1e2", "searchLabel": " iwss", "seedId": 7})
    assert f.topics == ["A", "B"] and f.status == "RUNNING" and (f.training, f.testing) == (None, "b.arff") and (f.least_score, f.greatest_score) == (0.0, 100.0) and f.seed_id == "7"
    assert f.since == dt.datetime(1970, 1, 2) and f.until == dt.datetime(2024, 1, 2, 1, 4, 5) and f.local_search == "iwss"
    assert feed.files_of("a|b|c") == ("a", "b") and feed.files_of("a") == ("a", None) and feed.files_of(None) == (None, None)
    assert [feed.page_of(o) for o in ({}, {"page": "3", "pageSize": "7.9"}, {"page": 0, "pageSize": -1}, {"page": "x", "pageSize": 1e9}, {"page": 2.9, "pageSize": float("inf")})] == [(1, 25), (3, 7), (1, 25), (1, 100), (2, 25)]


def test_feed_topics_of_none(spark):
    rows = spark.createDataFrame([("kafka.update", None), ("kafka.update", "T"), ("kafka.update", "U")], "event_type string, topic string")
    assert rows.where(feed.Filters(topics=["UNSPECIFIED", "T"]).column()).count() == 2 and rows.where(feed.Filters(topics=["T"]).column()).count() == 1


def test_timelines_scan_once(spark):
    """All three from one scan, with the two exchanges of a distinct count."""
    plan = monitor.timelines(registry._ev(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan =="):]
    assert physical.count("FileScan") == 1 and physical.count("Exchange hashpartitioning") <= 2 and physical.count("Expand") == 1


def test_launches_of_one_interval_share_their_counts(spark):
    """Counts by interval are those of the pairs, and no join makes a row for each launch and event."""
    at = lambda m: T0 + dt.timedelta(minutes=m)
    launches = spark.createDataFrame([(k, f"q{k % 2}", at(0), at(1) if k % 3 else None) for k in range(40)] + [(40, "q0", at(5), None), (41, "q9", at(6), at(7)), (42, None, at(8), None)], "launch_id long, request_id string, requested_at timestamp, started_at timestamp")
    e = events(spark, [{"seed_id": f"s{k % 4}", "request_id": f"q{k % 3}" if k % 5 else None, "created_at": at(k % 11), "topic": S.BEST} for k in range(60)])
    e = e.union(e.where("event_id < 20"))
    seeds = spark.createDataFrame([(k, f"s{j}") for k in range(0, 43, 2) for j in (1, 3)], "launch_id long, seed_id string")
    pairs = {}
    for r in runs.launch_events(launches, e, seeds).collect():
        pairs.setdefault(r.launch_id, set()).add(r.event_id)
    got = {r.launch_id: (r.events, r.first_event) for r in runs.launch_event_counts(launches, e, seeds).collect()}
    assert len(got) > 20 and got == {k: (len(v), min(v)) for k, v in pairs.items()}


def test_history_snapshots_read_each_json_once(spark):
    df = registry.QUERIES["history_snapshots"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1
