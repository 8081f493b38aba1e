import datetime as dt
import json
import tempfile

import pytest
from pyspark.sql import functions as F

from siftlake import schemas as S
from siftlake.operators import feed, monitor, runs, search, views
from siftlake.plans import registry
from siftlake.sources import arff, arffsource, catalog, incremental, keyed, sinks
from siftlake.streaming import folds

ARFF = "% comment\n@relation 'net flow'\n\n@attribute duration numeric\n@attribute proto {tcp,udp}\n@ATTRIBUTE 'src bytes' REAL\n@attribute class {normal, attack}\n@data\n% more\n1.5,tcp,?,normal\n2,udp,3,attack\n\n"


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "flow_train.arff").write_text(ARFF)
    (tmp_path / "flow_test.arff").write_text(ARFF + "3,tcp,4,attack\n")
    (tmp_path / "plain.csv").write_text("# c\na,b,c\n1,2,3\n")
    (tmp_path / "wide.data").write_text("1 2\t3 4\n")
    (tmp_path / "note.md").write_text("no data set")
    return tmp_path


def test_arff(spark, folder):
    data = arff.read(spark, f"{folder}/flow_train.arff")
    assert data.dtypes == [("duration", "double"), ("proto", "string"), ("src bytes", "double"), ("class", "string")]
    assert [tuple(r) for r in data.collect()] == [(1.5, "tcp", None, "normal"), (2.0, "udp", 3.0, "attack")]
    assert data.schema["class"].metadata == {"class": True, "values": ["normal", "attack"]}
    assert arff.subset(data, [3, 1, 3, 99][:3]).columns == ["duration", "src bytes", "class"]
    with pytest.raises(ValueError):
        arff.subset(data, [1, 2, 3, 4])


def test_cache_follows_the_file(spark, folder):
    cache = arff.Cache()
    path = f"{folder}/flow_train.arff"
    one = cache.get(spark, path)
    assert cache.get(spark, path) is one
    (folder / "flow_train.arff").write_text(ARFF + "9,tcp,1,normal\n")
    assert cache.get(spark, path).count() == 3


def test_catalog(spark, folder):
    files = catalog.listing(spark, str(folder))
    assert {r.name: (r.role, r.family) for r in files.collect()} == {"flow_train.arff": ("training", "flow"), "flow_test.arff": ("testing", "flow"), "plain.csv": ("unspecified", "plain"), "wide.data": ("unspecified", "wide")}
    a = {r.name: (r.relation, r.attributes, r.instances, r["class"], r.class_values) for r in catalog.profile_arff(spark, str(folder)).collect()}
    assert a == {"flow_train.arff": ("'net flow'", 4, 2, "class", ["normal", "attack"]), "flow_test.arff": ("'net flow'", 4, 3, "class", ["normal", "attack"])}
    d = {r.name: (r.attributes, r.instances, r.preview) for r in catalog.profile_delimited(spark, str(folder)).collect()}
    assert d == {"plain.csv": (3, 2, ["a", "b", "c"]), "wide.data": (4, 1, ["1", "2", "3", "4"])}
    sizes = catalog.profile_arff(spark, str(folder)).select("name", "attributes", "instances")
    full = files.join(sizes, "name")
    pair = catalog.best_pairs(full).first()
    assert (pair.training_name, pair.testing_name, pair.attributes_gap, pair.instances_gap) == ("flow_train.arff", "flow_test.arff", 0, 1)
    total = catalog.summary(full, catalog.pairs(full)).first()
    assert (total.files, total.families, total.formats, total.richest, total.pairs) == (2, 1, "arff", "flow_test.arff", 1)


@pytest.mark.parametrize("split", [1, 7, 1 << 20])
def test_arff_as_a_data_source(spark, folder, split):
    """Rows, types and metadata equal those of arff.read(), however the file is split."""
    spark.dataSource.register(arffsource.ArffSource)
    lines = ARFF + "\n".join(["3, 'tcp' ,4,attack", " 4,udp,x,normal", "@odd,tcp,1,normal", "5,'a,b',6,'it is'", "%c", "", "6,tcp"]) + "\n7,tcp,é,normal"
    (folder / "some.arff").write_text(lines)
    load = lambda **o: spark.read.format("arff").options(splitBytes=split, **o).load(f"{folder}/some.arff")
    want = arff.read(spark, f"{folder}/some.arff")
    got = load()
    assert got.schema == want.schema and [f.metadata for f in got.schema] == [f.metadata for f in want.schema]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    some = load(features="3,1,99")
    assert some.schema == arff.subset(want, [3, 1, 99]).schema
    assert sorted(map(tuple, some.collect()), key=str) == sorted(map(tuple, arff.subset(want, [3, 1, 99]).collect()), key=str)
    with pytest.raises(Exception):
        load(features="1,2,3,4").collect()


def test_catalog_keeps_profiles(spark, folder):
    (folder / "sub").mkdir()
    (folder / "sub" / "plain.csv").write_text("p,q\n")
    kept = tempfile.mkdtemp()
    sets = catalog.Catalog(spark, str(folder), kept)
    shown = lambda: sorted((r.path.removeprefix(f"file:{folder}/"), r.attributes, r.instances, r.relation) for r in sets.datasets().collect())
    want = [("flow_test.arff", 4, 3, "'net flow'"), ("flow_train.arff", 4, 2, "'net flow'"), ("plain.csv", 3, 2, None), ("sub/plain.csv", 2, 1, None), ("wide.data", 4, 1, None)]
    assert shown() == want and sets.scanned == 5
    assert shown() == want and sets.scanned == 0
    (folder / "plain.csv").write_text("# c\na,b,c\n1,2,3\n4,5,6\n")
    (folder / "wide.data").unlink()
    again = catalog.Catalog(spark, str(folder), kept)
    found = sorted((r.path.removeprefix(f"file:{folder}/"), r.instances) for r in again.datasets().collect())
    assert found == [("flow_test.arff", 3), ("flow_train.arff", 2), ("plain.csv", 3), ("sub/plain.csv", 1)] and again.scanned == 1


def test_keyed_store(spark, tmp_path):
    store = keyed.KeyedStore(spark, f"{tmp_path}/store", ["k"], ["at"], buckets=8)
    rows = lambda *v: spark.createDataFrame(v, "k string, at int, x double")
    held = lambda: {r.k: (r["at"], r.x) for r in store.read().collect()}
    assert store.read() is None and store.upsert(rows().limit(0)) == [] and store.read().count() == 0
    assert len(store.upsert(rows(*((f"k{n}", 1, float(n)) for n in range(200)), ("k0", 2, -1.0), (None, 1, 0.0)), "w", 0)) == 8
    assert len(held()) == 200 and held()["k0"] == (2, -1.0)
    # a batch again changes nothing; an older row doesn't replace a newer one, an equal one does; only its buckets are written
    assert store.upsert(rows(("k1", 9, 9.0)), "w", 0) == [] and held()["k1"] == (1, 1.0)
    before = store.version()[1]["buckets"]
    touched = store.upsert(rows(("k0", 1, 5.0), ("k1", 1, 7.0)), "w", 1)
    after = store.version()[1]["buckets"]
    assert held()["k0"] == (2, -1.0) and held()["k1"] == (1, 7.0) and len(touched) <= 2
    assert {b for b in after if after[b] != before[b]} == {str(b) for b in touched}
    # two writers: who comes second to a version makes the next
    other, lost = keyed.KeyedStore(spark, f"{tmp_path}/store", ["k"], ["at"], buckets=8), []
    create = store._create
    store._create = lambda number, content: create(number, content) if lost else (lost.append(1), other.upsert(rows(("k2", 5, 5.0))), create(number, content))[2]
    store.upsert(rows(("k3", 5, 6.0)))
    assert held()["k2"] == (5, 5.0) and held()["k3"] == (5, 6.0) and lost
    # a column more: what was stored has nulls there
    store.upsert(spark.createDataFrame([("k4", 5, 6.0, "y")], "k string, at int, x double, y string"))
    assert {r.k: r.y for r in store.read().where("k IN ('k3', 'k4')").collect()} == {"k3": None, "k4": "y"}


def test_incremental_model_equals_all_events_anew(spark, tmp_path):
    e = log(spark)
    model = incremental.TopicModel(spark, f"{tmp_path}/model")
    shown = lambda df: sorted(tuple(r) for r in df.collect())
    # newest first, so every later batch is late; a quarter of the events comes twice
    batches = [e.where("event_id % 4 <> 0").orderBy(F.desc("created_at")).limit(300), e.where("event_id % 3 = 0"), e.where("event_id % 2 = 0")]
    taken = None
    for k, batch in enumerate(batches):
        taken = batch if taken is None else taken.unionByName(batch)
        if k == 2:
            # a crash after the events were noted, before the sums were: the batch comes again
            upsert, model.hours.upsert = model.hours.upsert, lambda *a: 1 / 0
            with pytest.raises(ZeroDivisionError):
                model.take(batch, k)
            model.hours.upsert = upsert
        model.take(batch, k)
        assert shown(model.activity()) == shown(incremental.recomputed(taken.dropDuplicates(["event_id"])))
    model.take(batches[2], 2)
    assert shown(model.activity()) == shown(incremental.recomputed(taken.dropDuplicates(["event_id"])))
    want = {r.topic: (r.n, r.seeds, r.best_score) for r in monitor.topic_metrics(taken.dropDuplicates(["event_id"])).collect()}
    assert {r.topic: (r.n, r.seeds, r.best_score) for r in model.topics().collect()} == want


def test_keyed_store_as_a_sink(spark, tmp_path):
    """A stream's batches are taken in once, though the stream is run anew from its beginning."""
    rows = log(spark)
    store = keyed.KeyedStore(spark, f"{tmp_path}/store", ["event_id"], ["created_at"], buckets=4)
    (tmp_path / "a").mkdir()
    source = stream(spark, tmp_path / "a", rows, per_file=400)
    for run in range(2):
        folds.into(source, f"{tmp_path}/ck{run}", store.sink("events")).awaitTermination(240)
    assert {r.event_id for r in store.read().collect()} == {r.event_id for r in rows.collect()} and store.read().count() == rows.count()


def log(spark):
    return registry._ev(spark, "/root/testdata/sf0.001").cache()


def test_sinks(spark, tmp_path):
    e = log(spark).limit(20)
    sinks.snapshots_csv(e, f"{tmp_path}/s")
    back = spark.read.option("header", True).csv(f"{tmp_path}/s")
    assert back.columns == list(sinks.SNAPSHOT_COLUMNS) and back.count() == 20 and " | " in back.first().solutionFeatures
    sinks.metrics_csv(spark.createDataFrame([("a", 1.23456, float("nan")), ("b", None, 2.0)], "k string, x double, y double"), f"{tmp_path}/m", ["x", "y"])
    assert sorted(open(p).read() for p in (tmp_path / "m").glob("part*"))[-1].startswith("k;x;y\n")
    row = sinks.export_summary(monitor.fold_runs(e), e).first()  # of runs and rows
    assert row.snapshots == 20 and row.seeds == row.runs
    sinks.json_export(monitor.fold_runs(e), e, f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/j/snapshots").count() == 20
    twice = e.unionByName(e.withColumn("created_at", e.created_at + dt.timedelta(seconds=1)))
    assert sinks.latest_events(twice, ["event_id"]).count() == 20


def test_read_model(spark, tmp_path):
    e = log(spark)
    model = sinks.ReadModel(spark, f"{tmp_path}/model")
    made = []
    make = lambda: made.append(1) or {"topics": monitor.topic_metrics(e)}
    mark = monitor.watermark(e, monitor.fold_runs(e))
    model.serve(mark, make)
    model.serve(mark, make)
    assert len(made) == 1 and model.table("topics").count() == 5
    older = monitor.watermark(e.limit(10), monitor.fold_runs(e.limit(10)))
    model.serve(older, make)
    assert len(made) == 2 and not model.fresh(mark)


def stream(spark, tmp_path, rows, per_file=300):
    """Rows as JSON files in order of time, read as a stream."""
    src = tmp_path / "in"
    src.mkdir()
    lines = [r.value for r in rows.orderBy("created_at", "event_id").selectExpr("to_json(struct(*)) AS value").collect()]
    for k in range(0, len(lines), per_file):
        (src / f"{k:06d}.json").write_text("\n".join([*lines[k : k + per_file], "broken {", ""]))
    return folds.topic_source(spark, S.EVENT, str(src))


def drain(spark, out, tmp_path, mode="append"):
    query = out.writeStream.format("memory").queryName("out").outputMode(mode).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    query.awaitTermination(240)
    return spark.table("out").collect()


def test_streamed_verify_equals_batch(spark, tmp_path):
    rows = log(spark).where(f"topic = '{S.SOLUTIONS}'")
    got = {(r.seed_id, r.event_id) for r in drain(spark, folds.verify(stream(spark, tmp_path, rows)), tmp_path)}
    assert got == {(r.seed_id, r.event_id) for r in monitor.verified_best(rows).collect()} and got


def test_streamed_fold_equals_batch(spark, tmp_path):
    rows = log(spark)
    last = {}
    for r in drain(spark, folds.fold_runs(stream(spark, tmp_path, rows)), tmp_path):
        if r.seed_id not in last or r.updates > last[r.seed_id].updates:
            last[r.seed_id] = r
    want = {r.seed_id: r for r in monitor.fold_runs(rows).collect()}
    assert {s: (r.updates, r.best_score, r.completed) for s, r in last.items()} == {s: (r.updates, r.best_score, r.completed) for s, r in want.items()}


def test_streamed_states_equal_batch(spark, tmp_path):
    rows = log(spark)
    out = folds.fold_states(stream(spark, tmp_path, rows), 2, history=5)
    last = {}
    for r in drain(spark, out, tmp_path):
        if r.seed_id not in last or r.updates > last[r.seed_id].updates:
            last[r.seed_id] = r
    want = {r.seed_id: r for r in runs.run_states(rows, F.lit(2), F.lit(3)).collect()}
    assert set(last) == set(want)
    same = [c for c in (*folds.FOLLOWED, *folds.CARRIED, *folds.FRESH, *folds.LATEST, "status", "stage", "topic", "best_score", "updates")]
    for seed, r in last.items():
        assert {c: r[c] for c in same} == {c: want[seed][c] for c in same}, seed
    newest = {r.seed_id: [h.event_id for h in r.history] for r in views.runs_with_events(want_runs(rows), rows, 5).collect()}
    times = {r.event_id: r.us for r in rows.selectExpr("event_id", "unix_micros(created_at) AS us").collect()}
    assert all([h.us // 1000 for h in reversed(last[s].history)] == [times[i] // 1000 for i in ids] for s, ids in newest.items())


def want_runs(rows):
    return monitor.fold_runs(rows)


def test_notify_and_live_window(spark, tmp_path):
    rows = log(spark).where(f"topic = '{S.SOLUTIONS}'")
    got = {(r.seed_id, r.event_id) for r in drain(spark, folds.notify(stream(spark, tmp_path, rows)), tmp_path)}
    first = {r.seed_id: r.event_id for r in rows.orderBy(F.desc("created_at"), F.desc("event_id")).collect()}
    assert got == {(r.seed_id, r.event_id) for r in monitor.verified_best(rows).collect()} - set(first.items())
    window, told = folds.LiveWindow(4), []
    window.rehydrate(rows.where("event_id % 2 = 0"))
    leave = window.join(lambda kind, value: told.append((kind, value)))
    window.take(rows.where("event_id % 2 = 1"))
    leave()
    window.take(rows.limit(1))
    assert [r.event_id for r in window.held] == [r.event_id for r in rows.orderBy(F.desc("created_at"), F.desc("event_id")).limit(4).collect()]
    assert told[0][0] == "snapshot" and len(told[0][1]) == 4 and [k for k, _ in told[1:]] == ["event"] * 4


def test_request_as_a_whole(spark, folder):
    lines = ARFF + "".join(f"{k % 7},{'tcp' if k % 2 else 'udp'},{k % 5},{'attack' if k % 2 else 'normal'}\n" for k in range(40))
    for name in ("flow_train.arff", "flow_test.arff"):
        (folder / name).write_text(lines.replace("?", "1"))
    payload = {"maxGenerations": "2", "rclCutoff": 3, "sampleSize": 1, "datasetTrainingName": "flow_train.arff", "datasetTestingName": "flow_test.arff", "classifier": "NB", "algorithms": ["ig", "IG", "rf", "x"], "localSearches": "iwss, what", "neighborhoodMaxIterations": 1, "useTrainingCache": "yes"}
    out = search.execute(spark, str(folder), payload).collect()
    assert {r.rcl_algorithm for r in out} == {"IG", "RF"} and {r.local_search for r in out} == {"", "IWSS"}
    assert max(r.best_f1 for r in out if r.rcl_algorithm == "IG") > 95
    assert all(len({r.seed_id for r in out if r.rcl_algorithm == a}) == 2 for a in ("IG", "RF"))
    for bad in ({"rclCutoff": ""}, {"sampleSize": 1.5}, {"maxGenerations": 0}, {"localSearches": ["no"]}, {"useTrainingCache": "maybe"}, {"neighborhoodStrategy": "XND"}, {"algorithms": ["no"]}, {"classifier": "no"}):
        with pytest.raises(ValueError):
            search.Launch.of(payload | bad)


def test_tables_and_run_history(spark):
    rows = spark.createDataFrame([(k, f"name {k % 3}", None if k == 4 else float(-k)) for k in range(9)], "k int, name string, x double")
    at = lambda **a: [r.k for r in feed.table_view(rows, "k", **a).collect()]
    assert at(query="NAME 1") == [1, 4, 7] and at(sort="x") == [8, 7, 6, 5, 3, 2, 1, 0, 4] and at(sort="x", descending=True, number=2, size=3) == [3, 5, 6] and at(query="none") == []
    e = log(spark)
    one = feed.run_history(e, "7", ["kafka.update"], dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 20))
    assert one.count() == e.where("seed_id = '7' AND event_type = 'kafka.update' AND created_at BETWEEN '2024-01-05' AND '2024-01-20'").count() > 0


def test_routes_stay_within_budget(spark, tmp_path):
    rows = log(spark).where(f"topic = '{S.SOLUTIONS}'")
    out = drain(spark, folds.route(stream(spark, tmp_path, rows), "VND", cycles=2), tmp_path)
    by = {}
    for r in out:
        by.setdefault(r.seed_id, []).append(r)
    assert out and all(max(r.iteration for r in rs) <= 6 for rs in by.values())
    assert all(int(s) % 2 == 0 for s in by) and {r.action for r in out} <= {"next", "restart", "done"}


def result(score, step=None, search=None, searches=None, cycles=None):
    return {"score": score, "step": step, "local_search": search, "enabled_local_searches": searches, "neighborhood_max_iterations": cycles}


def walk(messages, turns=True, cycles=10):
    held, out = None, []
    for m in messages:
        held, told = folds.routed(held, m, turns, cycles, lambda step, n: step % n)
        out.append(told and told[1:] and (told[0], told[1], told[3]))
    return out, held


def test_routes_follow_each_message():
    two = ["iwss", None, "nope", "BIT_FLIP", "IWSS"]
    # the message's own search and list decide what is next: IWSS, BIT_FLIP, and a new cycle if the last one improved
    assert walk([result(1.0, 1, "IWSS", two), result(2.0, 2, "BIT_FLIP", two)])[0] == [(2, "BIT_FLIP", "next"), (3, "IWSS", "restart")]
    assert walk([result(2.0, 1, "IWSS", two), result(1.0, 2, "BIT_FLIP", two)])[0] == [(2, "BIT_FLIP", "next"), (2, None, "done")]
    # the same seed under three searches goes on
    assert walk([result(2.0, 1, "BIT_FLIP"), result(1.0, 2, "IWSS"), result(1.0, 3, "IWSSR")])[0] == [(2, "IWSS", "next"), (3, "IWSSR", "next"), (3, None, "done")]
    # budgets: cycles times searches for VND, cycles for RVND; zero and null take the default
    assert walk([result(1.0, 2, "IWSS", two, 1)]) == ([(2, None, "done")], None) and walk([result(1.0, 2, "IWSS", two, 0)], cycles=1) == ([(2, None, "done")], None)
    assert walk([result(1.0, 3, "IWSS", two, 1)]) == ([None], None)
    assert walk([result(1.0, 1, "IWSS", ["IWSS"], 2)], turns=False)[0] == [(2, "IWSS", "next")]
    assert walk([result(1.0, 1, None, None, 5), result(3.0, 2, None, None, 5), result(None, 3, None, None, 5), result(9.0, 5, None, None, 5)], turns=False)[0] == [(2, "IWSSR", "next"), (3, "BIT_FLIP", "restart"), (4, "IWSS", "next"), (5, None, "done")]
    # a message from an unknown search starts at the first, and counts for itself
    assert walk([result(1.0, None, "?", two), result(1.0, None, None, two)])[0] == [(1, "IWSS", "next"), (2, "BIT_FLIP", "next")]


def test_budget_and_terminal_messages_of_runs():
    m = {c: None for c in folds._MESSAGE} | {"topic": S.SOLUTIONS, "neighborhood": "VND", "us": 1, "score": 1.0}
    ends = lambda **a: folds.advance({}, m | a)[0]["status"]
    assert ends(iteration_neighborhood=29) == "running" and ends(iteration_neighborhood=30) == "completed"
    assert ends(iteration_neighborhood=2, neighborhood_max_iterations=1, enabled_local_searches=["IWSS", "iwss", "BIT_FLIP"]) == "completed"
    assert ends(iteration_neighborhood=4, neighborhood_max_iterations=4, neighborhood="RVND") == "completed" and ends(iteration_neighborhood=9, topic=S.PROGRESS, neighborhood_max_iterations=1) == "running"
    # what an earlier message told of the budget holds; a later restart leaves a completed run as it is, and it stays so
    run, _ = folds.advance({}, m | {"topic": S.INITIAL, "neighborhood_max_iterations": 1, "enabled_local_searches": ["IWSS"], "score": 5.0})
    run, _ = folds.advance(run, m | {"iteration_neighborhood": 1, "score": 7.0, "us": 2})
    assert run["status"] == "completed" and run["completed_us"] == 2
    later, _ = folds.advance(run, m | {"topic": S.RESTART, "score": 9.0, "us": 3})
    assert later["status"] == "completed" and later["current_score"] == 7.0 and later["best_score"] == 9.0 and later["topic"] == S.SOLUTIONS


def states_of(rows):
    last = {}
    for r in rows:
        if r.seed_id not in last or r.updated_us >= last[r.seed_id].updated_us:
            last[r.seed_id] = r
    return last


def test_restart_from_stored_rows_equals_unbroken_run(spark, tmp_path):
    rows = log(spark).where("CAST(seed_id AS INT) < 40")
    middle = rows.selectExpr("percentile_approx(created_at, 0.5) AS t").first().t
    early, late = rows.where(F.col("created_at") <= middle), rows.where(F.col("created_at") > middle)
    for name in ("whole", "early", "late"):
        (tmp_path / name).mkdir()
    whole = states_of(drain(spark, folds.fold_states(stream(spark, tmp_path / "whole", rows), 2, history=6), tmp_path / "whole"))
    stored = list(states_of(drain(spark, folds.fold_states(stream(spark, tmp_path / "early", early), 2, history=6), tmp_path / "early")).values())
    store = spark.createDataFrame(stored, folds.STATE)
    again = states_of([*stored, *drain(spark, folds.fold_states(stream(spark, tmp_path / "late", late), 2, history=6, initial=store), tmp_path / "late")])
    assert again == whole and any(len(r.history) == 6 for r in whole.values())


def test_idle_seeds_expire(spark, tmp_path):
    """A seed whose last message lies too far behind the newest of the stream starts anew; one that is heard of goes on."""
    day = lambda k, seed, n: {"event_id": n, "seed_id": seed, "created_at": f"2026-01-{k:02d}T00:00:00.000Z", "score": float(n)}
    batches = [[day(1, "a", 1), day(1, "b", 2)], [day(2, "a", 3), day(2, "b", 4)], [day(6, "a", 5)], [day(10, "a", 6)], [day(11, "b", 7), day(11, "a", 8)]]
    src = tmp_path / "in"
    src.mkdir()
    for k, batch in enumerate(batches):
        (src / f"{k}.json").write_text("\n".join(json.dumps(r) for r in batch))
        out = folds.fold_runs(folds.topic_source(spark, S.EVENT, str(src)), idle=5 * 24 * 3600)
        out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(240)
    got = sorted((r.seed_id, r.created_us // 1000, r.updates) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    first = int(dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc).timestamp() * 1000)
    assert [(s, n) for s, _, n in got] == [("a", 1), ("a", 2), ("a", 3), ("a", 4), ("a", 5), ("b", 1), ("b", 2), ("b", 1)]
    assert {at for s, at, _ in got if s == "a"} == {first} and [at - first for s, at, _ in got if s == "b"] == [0, 0, 10 * 24 * 3600 * 1000]


def test_message_keys_and_progress(spark):
    df = spark.createDataFrame([("s", "J48", None, "t"), (None, "J48", None, "t")], "seed_id string, classifier string, training_file_name string, testing_file_name string")
    assert [r.key for r in folds.message_key(df).collect()] == ["s", "J48|null|t"]
    steps = spark.createDataFrame([("s", k, 10, float(v)) for k, v in enumerate([1, 3, 2, 5, 4, 4, 6, 1, 1, 2])], "seed_id string, step int, steps int, score double")
    kept = lambda *a: sorted(r.step for r in folds.progress_kept(steps, *a).collect())
    assert kept("off") == [] and kept("full") == list(range(10)) and kept("sampled", 4) == [0, 3, 7, 9] and kept("improvement") == [0, 1, 3, 6, 9]


def test_pairs_of_one_large_family_are_made_by_many_tasks(spark, monkeypatch):
    """A family is dealt over cells: each pair is there once, and no task makes most of them."""
    monkeypatch.setattr(catalog, "SIDE", 20, raising=False)
    sets = spark.range(300).selectExpr("'f' AS family", "concat('n', id) AS name", "if(id < 200, 'training', 'testing') AS role", "id AS attributes", "2 * id AS instances")
    lone = spark.createDataFrame([("g", "a", "training", 1, 5), ("g", "b", "testing", 3, 1), ("h", "c", "training", 1, 1), (None, "d", "training", 1, 1), (None, "e", "testing", 1, 1)], "family string, name string, role string, attributes long, instances long")
    out = catalog.pairs(sets.union(lone))
    got = {(r.family, r.training_name, r.testing_name, r.attributes_gap, r.instances_gap) for r in out.collect()}
    want = {("f", f"n{a}", f"n{b}", b - a, 2 * (b - a)) for a in range(200) for b in range(200, 300)} | {("g", "a", "b", 2, 4)}
    assert out.count() == len(want) == 20_001 and got == want
    parts = [r.n for r in out.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(parts) == 4 and max(parts) < 12_000


def test_a_seed_is_folded_from_rows(spark):
    """The fold of a seed takes and gives plain rows, so no frame is made for each seed; whole numbers stay so beside nulls."""
    from types import SimpleNamespace

    from pyspark.sql import Row

    class Held:
        value = None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

    fold, timers = folds.Runs(), []
    fold.held, fold.last, fold.handle = Held(), Held(), SimpleNamespace(registerTimer=timers.append)
    message = lambda event_id, us, score: Row(seed_id="s", event_id=event_id, us=us, score=score, status="running", topic="t", local_search=None)
    rows = list(fold.handleInputRows(("s",), iter([message(None, 5_000, 1.0), message(2, 5_000, float("nan")), message(1, 3_000, 2.0)]), None))
    assert [(r.updates, r.current_score, r.best_score, r.created_us, r.updated_us) for r in rows] == [(1, 2.0, 2.0, 3_000, 3_000), (2, 2.0, 2.0, 3_000, 5_000), (3, 1.0, 2.0, 3_000, 5_000)]
    assert fold.last.value == (5,) and timers == [6]
    assert not list(fold.handleInputRows(("s",), iter([message(3, 9_000, 0.5)]), None))[0].improved and fold.last.value == (9,) and timers == [6]
