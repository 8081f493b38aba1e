"""Run comparison, feature sets, launches and their runs, seed lifecycles, the research summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftlake import schemas as S
from siftlake.functions import labels
from siftlake.operators.monitor import mean, snapshots
from siftlake.session import cut

HIGH_QUALITY = 95.0


def feature_frequency(runs: DataFrame, top: int | None = 10) -> DataFrame:
    """How many runs select each feature; the most frequent ones."""
    out = runs.select(F.explode(F.array_distinct("solution_features")).alias("feature")).groupBy("feature").agg(F.count("*").alias("n"))
    return out.orderBy(F.desc("n"), "feature").limit(top) if top else out


def shared_features(runs: DataFrame) -> DataFrame:
    """Features that every run selects: those counted as often as there are runs, a one-row side."""
    n = runs.agg(F.count("*").alias("runs"))
    return feature_frequency(runs, None).join(F.broadcast(n), F.col("n") == F.col("runs")).select("feature")


def rcl_complement(runs: DataFrame) -> DataFrame:
    """The candidates left to a run: 1 to |candidates| + |solution| without the solution."""
    k = F.size("rcl_features") + F.size("solution_features")
    return runs.withColumn("complement", F.array_except(F.sequence(F.lit(1), k), "solution_features"))


def enabled_searches(requested: Column) -> Column:
    """Requested searches, upper-cased, without repetitions and unknown ones; all if none is left."""
    known = F.array_distinct(F.filter(F.transform(F.coalesce(requested, F.array().cast("array<string>")), lambda x: F.upper(F.trim(x))), lambda x: x.isin(*S.LOCAL_SEARCHES)))
    return F.when(F.size(known) > 0, known).otherwise(F.array(*map(F.lit, S.LOCAL_SEARCHES)))


def run_compare(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Comparison of the runs of each group: count, best run, spread, distinct algorithms, strategies, searches, dataset pairs, shared features."""
    score = F.coalesce("best_score", "current_score")
    own = runs.withColumn("score", score)
    out = own.groupBy(*keys).agg(
        F.count("*").alias("runs"),
        F.max_by("seed_id", F.struct("score", "updated_at", "seed_id")).alias("best_seed"),
        F.round(F.max("score") - F.min("score"), 6).alias("spread"),
        F.countDistinct("rcl_algorithm").alias("algorithms"),
        F.countDistinct("neighborhood").alias("strategies"),
        F.countDistinct("local_search").alias("searches"),
        F.countDistinct(labels.dataset_pair(F.col("training_file_name"), F.col("testing_file_name"))).alias("pairs"),
    )
    shared = own.select(*keys, F.explode(F.array_distinct("solution_features")).alias("feature")).groupBy(*keys, "feature").agg(F.count("*").alias("n"))
    shared = shared.join(out.select(*keys, "runs"), keys).where("n = runs").groupBy(*keys).agg(F.count("*").alias("shared"))
    return out.join(shared, keys, "left").withColumn("shared", F.coalesce("shared", F.lit(0)).cast("long"))


#: Seconds of the cells in which launches meet runs and events, of those in which launches are ordered, and of a queue's.
CELL, HOUR, DAY = 60, 3_600, 86_400


def _cell(column: str | Column, seconds: int = CELL) -> Column:
    return F.floor(F.unix_micros(column) / (seconds * 1_000_000))


def next_started(launches: DataFrame, span_seconds: int = HOUR) -> DataFrame:
    """Each launch with the start of the next one (by request, then id) that was ever started.

    Hours are windows of their own; the last launches of an hour take the first start of the next hour that has one, from
    a table of a row for each hour. So no task orders all launches.
    """
    rows = launches.withColumn("_day", _cell("requested_at", span_seconds))
    # Backwards, so that the frames grow: a frame up to the end would be read anew for every row.
    order = Window.partitionBy("_day").orderBy(F.desc("requested_at"), F.desc("launch_id"))
    own = F.last("started_at", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    first = F.min_by("started_at", F.when(F.col("started_at").isNotNull(), F.struct("requested_at", "launch_id"))).alias("_first")
    days = rows.groupBy("_day").agg(first)
    later = Window.orderBy(F.desc("_day")).rowsBetween(Window.unboundedPreceding, -1)
    days = days.select("_day", F.last("_first", ignorenulls=True).over(later).alias("_next_day"))
    return rows.withColumn("_next", own).join(days, "_day").withColumn("next_started_at", F.coalesce("_next", "_next_day")).drop("_day", "_next", "_next_day")


def _in_cells(launches: DataFrame, since: Column, until: DataFrame) -> DataFrame:
    """Launches in each cell of time from since to the next start, or to the newest time of the one row of until.

    Intervals of started launches follow each other, so there are about as many rows as launches and cells together.
    """
    return _cells(next_started(launches).withColumn("_since", since), until)


def _cells(spans: DataFrame, until: DataFrame) -> DataFrame:
    asked = spans.crossJoin(F.broadcast(until))
    end = F.least(F.coalesce("next_started_at", "_newest"), F.col("_newest"))
    return asked.where(F.col("_since") <= end).withColumn("_cell", F.explode(F.sequence(_cell("_since"), _cell(end)))).drop("_newest")


def launch_runs(launches: DataFrame, runs: DataFrame) -> DataFrame:
    """Runs of each launch: of its algorithms, files and classifier, created from its start (or request) to the next start.

    A file or classifier that a launch leaves open takes any. Launches without a match stay out. Both sides meet in a
    minute and an algorithm, so the join is one of equal keys whatever is left open.
    """
    newest = runs.agg(F.max("created_at").alias("_newest"))
    asked = _in_cells(launches, F.coalesce("started_at", "requested_at"), newest)
    open_keys = ("training_file_name", "testing_file_name", "classifier")
    algorithms = F.filter(F.transform(F.array_distinct("algorithms"), lambda x: F.upper(F.trim(x))), lambda x: x != "")
    asked = asked.select("launch_id", "started_at", "next_started_at", "_since", "_cell", F.explode(algorithms).alias("rcl_algorithm"), *(F.nullif(F.col(c), F.lit("")).alias(f"_{c}") for c in open_keys))
    rows = runs.select("seed_id", "rcl_algorithm", *open_keys, "created_at", "updated_at", "completed", "best_score").withColumn("_cell", _cell("created_at"))
    found = asked.join(rows, ["_cell", "rcl_algorithm"])
    for c in open_keys:
        found = found.where(F.col(f"_{c}").isNull() | (F.col(f"_{c}") == F.col(c)))
    inside = (F.col("created_at") >= F.col("_since")) & (F.col("next_started_at").isNull() | (F.col("created_at") < F.col("next_started_at")))
    return found.where(inside).drop("_since", "_cell", *(f"_{c}" for c in open_keys))


def launch_progress(launches: DataFrame, runs: DataFrame) -> DataFrame:
    """Expected, observed, completed and pending results of each started launch, and its reconciled state."""
    seen = launch_runs(launches, runs).where("started_at IS NOT NULL").groupBy("launch_id").agg(F.count("*").alias("observed"), F.count_if("completed").alias("done"), F.min("created_at").alias("first_at"), F.max("updated_at").alias("last_at"))
    expected = (F.size("algorithms") * F.greatest("generations", F.lit(1))).cast("long")
    out = launches.where("started_at IS NOT NULL").select("launch_id", expected.alias("expected")).join(seen, "launch_id", "left")
    out = out.withColumns({"observed": F.coalesce("observed", F.lit(0)), "done": F.coalesce("done", F.lit(0))})
    state = F.when(F.col("done") >= F.col("expected"), "completed").when(F.col("observed") > 0, "monitoring").otherwise("dispatched")
    return out.withColumns({"pending": F.greatest(F.col("expected") - F.col("done"), F.lit(0)), "state": state})


def queue_position(launches: DataFrame) -> DataFrame:
    """The place of each queued launch, by request time: its place in its day after the launches of the days before."""
    queued = launches.where(F.col("state") == "queued").withColumn("_day", _cell("requested_at", DAY))
    before = Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = queued.groupBy("_day").agg(F.count("*").alias("_n")).select(F.col("_day").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_day").orderBy("requested_at", "launch_id"))
    return queued.withColumn("_own", own).join(days, F.col("_day").eqNullSafe(F.col("_of"))).withColumn("place", F.col("_before") + F.col("_own")).drop("_day", "_of", "_own", "_before")


def lifecycle(events: DataFrame, cycles: Column, searches: Column) -> DataFrame:
    """Whether each seed is completed: its last terminal or processing message is a terminal one."""
    terminal = labels.is_terminal(F.col("topic"), F.col("neighborhood"), F.col("iteration_neighborhood"), cycles, searches)
    rows = snapshots(events).withColumn("terminal", terminal)
    rows = rows.withColumn("processing", labels.is_processing(F.col("topic"), F.col("status"), F.col("terminal")))
    rows = rows.where("seed_id IS NOT NULL AND (terminal OR processing)")
    at = F.struct("created_at", "event_id")
    return rows.groupBy("seed_id").agg(
        F.max_by("terminal", at).alias("completed"),
        F.count_if("terminal").alias("terminals"),
        F.count_if("processing").alias("processings"),
        F.max(F.when(F.col("terminal"), F.unix_micros("created_at"))).alias("last_terminal"),
    )


def launch_events(launches: DataFrame, events: DataFrame, seeds: DataFrame) -> DataFrame:
    """Events of launches (launch_id, event_id), each once: of its request, or of a seed of the launch (launch_id, seed_id).

    Of either only those from the launch's request (or start) to the next start. Events of its gateway carry its id and
    are taken by request as well.
    """
    newest = events.agg(F.max("created_at").alias("_newest"))
    asked = _in_cells(launches, F.coalesce("requested_at", "started_at"), newest).select("launch_id", "request_id", "_since", "next_started_at", "_cell")
    rows = events.select("event_id", "seed_id", F.col("request_id"), "created_at", _cell("created_at").alias("_cell"))
    by_request = asked.join(rows, ["_cell", "request_id"])
    by_seed = asked.drop("request_id").join(seeds.select("launch_id", "seed_id").distinct(), "launch_id").join(rows.drop("request_id"), ["_cell", "seed_id"])
    inside = (F.col("created_at") >= F.col("_since")) & (F.col("next_started_at").isNull() | (F.col("created_at") < F.col("next_started_at")))
    return by_request.where(inside).select("launch_id", "event_id").union(by_seed.where(inside).select("launch_id", "event_id")).distinct()


def launch_event_counts(launches: DataFrame, events: DataFrame, seeds: DataFrame) -> DataFrame:
    """launch_id, events, first_event: how many events launch_events() has of each launch, and the least event_id.

    Launches of one request and interval have the same events by request, so these are counted once for all of them: the
    work grows with intervals and events, not with launches times events. Of the events of a launch's seeds those of
    other requests are added. Ids of launches and events are theirs alone; repeated rows of an event count once.
    """
    newest = events.agg(F.max("created_at").alias("_newest"))
    asked = next_started(launches).select("launch_id", "request_id", "next_started_at", F.coalesce("requested_at", "started_at").alias("_since"))
    rows = events.select("event_id", "seed_id", F.col("request_id").alias("_request"), "created_at", _cell("created_at").alias("_cell"))
    inside = (F.col("created_at") >= F.col("_since")) & (F.col("next_started_at").isNull() | (F.col("created_at") < F.col("next_started_at")))
    of = [F.count_distinct("event_id").alias("events"), F.min("event_id").alias("first_event")]
    spans = _cells(asked.select("request_id", "_since", "next_started_at").distinct(), newest)
    met = spans.join(rows.drop("seed_id").withColumnRenamed("_request", "request_id"), ["_cell", "request_id"]).where(inside).groupBy("request_id", "_since", "next_started_at").agg(*of)
    met = met.select(F.col("request_id").alias("_r"), F.col("_since").alias("_s"), F.col("next_started_at").alias("_n"), "events", "first_event")
    same = (F.col("request_id") == F.col("_r")) & (F.col("_since") == F.col("_s")) & F.col("next_started_at").eqNullSafe(F.col("_n"))
    by_request = asked.join(met, same).select("launch_id", "events", "first_event")
    theirs = _cells(asked.join(seeds.select("launch_id", "seed_id").distinct(), "launch_id"), newest)
    other = ~F.coalesce(F.col("_request") == F.col("request_id"), F.lit(False))
    by_seed = theirs.join(rows, ["_cell", "seed_id"]).where(inside & other).groupBy("launch_id").agg(*of)
    return by_request.union(by_seed).groupBy("launch_id").agg(F.sum("events").alias("events"), F.min("first_event").alias("first_event"))


def launch_users(launches: DataFrame, users: DataFrame) -> DataFrame:
    """Launches with name, mail and role of who asked for them; all stay. users: user_id and those."""
    known = users.select(F.col("user_id").alias("requested_by"), *(F.col(c).alias(f"user_{c}") for c in ("name", "mail", "role")))
    return launches.join(known, "requested_by", "left")


def gateway_dispatches(stored: DataFrame, dispatched: DataFrame) -> DataFrame:
    """Launches after an upsert by request: a dispatched one replaces what was stored; of repeated dispatches the latest holds."""
    at = [F.desc("_new"), F.desc("requested_at"), F.desc("launch_id")]
    both = stored.withColumn("_new", F.lit(0)).unionByName(dispatched.withColumn("_new", F.lit(1)))
    return both.withColumn("_rank", F.row_number().over(Window.partitionBy("request_id").orderBy(*at))).where("_rank = 1").drop("_rank", "_new")


def gateway_events(launches: DataFrame) -> DataFrame:
    """The event that each dispatch leaves in the log, one for each request: its fingerprint makes a repetition an update."""
    return launches.where("request_id IS NOT NULL").select(
        F.concat(F.lit("gateway:"), "request_id").alias("fingerprint"), F.lit(S.GATEWAY_EVENT).alias("event_type"), F.lit(S.GATEWAY_TOPIC).alias("topic"),
        F.lit("REQUESTED").alias("status"), "request_id", "launch_id", F.col("requested_at").alias("created_at"),
    )


def run_states(events: DataFrame, cycles: Column, searches: Column) -> DataFrame:
    """The whole state of each seed's run after its messages in order of time, as the monitor keeps it.

    A message that ends a run completes it. From then on what the run shows is kept, but for another ending message: its
    status, stage, topic, search, strategy, steps, scores and features; only what it doesn't hold yet is still filled.
    Request, algorithm, classifier and files follow the latest message that names them, resources the latest message.
    Two passes by seed over one shuffle: the first end of each seed, then one aggregation of ordered structs.
    """
    ends = labels.is_terminal(F.col("topic"), F.col("neighborhood"), F.col("iteration_neighborhood"), cycles, searches)
    at = F.struct("created_at", "event_id")
    rows = snapshots(events).where("seed_id IS NOT NULL").withColumns({"_ends": F.coalesce(ends, F.lit(False)), "_at": at})
    seed = Window.partitionBy("seed_id")
    rows = rows.withColumns({"_first": F.min(F.when(F.col("_ends"), F.col("_at"))).over(seed), "_last": F.max(F.when(F.col("_ends"), F.col("_at"))).over(seed)})
    before = F.max("score").over(seed.orderBy("created_at", "event_id").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumns({"_before": before, "_shown": F.col("_first").isNull() | (F.col("_at") <= F.col("_first")) | F.col("_ends")})
    rows = rows.withColumns({"_delta": F.col("score") - F.col("_before"), "_improved": F.col("score").isNotNull() & (F.col("_before").isNull() | (F.col("score") > F.col("_before"))), "_late": ~F.col("_shown") & (F.col("_at") > F.col("_last"))})
    given = lambda c: F.col(c).isNotNull() & ((F.col(c) != "") if dict(rows.dtypes)[c] == "string" else F.lit(True))
    latest = lambda c: F.max_by(c, F.when(given(c), F.col("_at")))
    # carried: the last value that is there; fresh: that of the last message that shows, even if it is null
    carried = lambda c: F.coalesce(F.max_by(c, F.when(F.col("_shown") & given(c), F.col("_at"))), F.min_by(c, F.when(~F.col("_shown") & given(c), F.col("_at"))))
    fresh = lambda c: F.coalesce(F.max_by(c, F.when(F.col("_shown"), F.col("_at"))), F.min_by(c, F.when(F.col("_late") & F.col(c).isNotNull(), F.col("_at"))))
    return rows.groupBy("seed_id").agg(
        *(latest(c).alias(c) for c in ("request_id", "rcl_algorithm", "classifier", "training_file_name", "testing_file_name")),
        *(carried(c).alias(c) for c in ("local_search", "neighborhood", "iteration_neighborhood", "solution_features", "rcl_features")),
        F.when(F.max("_ends"), "completed").otherwise("running").alias("status"),
        F.max_by("stage", F.when(F.col("_shown"), F.col("_at"))).alias("stage"),
        F.max_by("topic", F.when(F.col("_shown"), F.col("_at"))).alias("topic"),
        fresh("score").alias("current_score"),
        F.max("score").alias("best_score"),
        F.round(fresh("_before"), 6).alias("previous_best"),
        F.round(fresh("_delta"), 6).alias("delta"),
        fresh("_improved").alias("improved"),
        *(F.max_by(c, "_at").alias(c) for c in ("cpu_usage", "memory_usage", "memory_usage_percent")),
        F.min("created_at").alias("created_at"),
        F.max("created_at").alias("updated_at"),
        F.max("_last.created_at").alias("completed_at"),
        F.count("*").alias("updates"),
        F.count_if(F.col("topic") != S.PROGRESS).alias("history_count"),
    )


def comparison_runs(runs: DataFrame, total: str | None = None) -> DataFrame:
    """Runs without their history, and its length: that of the array, or of a column that tells it."""
    length = F.when(F.col("history").isNotNull(), F.size("history")).otherwise(F.coalesce(F.col(total), F.lit(0)) if total else F.lit(0))
    return runs.withColumn("history_count", length.cast("long")).drop("history", *([total] if total else []))


def timeline_comparison(visible: DataFrame, requested: DataFrame, featured: DataFrame) -> DataFrame:
    """The visible runs, with what the requested runs and then the featured one tell of them; other seeds stay out. Same columns."""
    fields = [c for c in visible.columns if c != "seed_id"]
    out = visible.where("seed_id IS NOT NULL")
    for told in (requested, featured):
        own = told.select("seed_id", *(F.col(c).alias(f"_{c}") for c in fields if c in told.columns)).dropDuplicates(["seed_id"])
        out = out.join(own, "seed_id", "left").select("seed_id", *((F.coalesce(f"_{c}", c) if f"_{c}" in own.columns else F.col(c)).alias(c) for c in fields))
    return out


def option_values(runs: DataFrame, events: DataFrame) -> DataFrame:
    """What filters can choose from, over runs and events: (kind, value) of algorithms, dataset pairs, searches and states."""
    pair = labels.dataset_pair(F.col("training_file_name"), F.col("testing_file_name"))
    some = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.alias("value"))
    state = F.nullif(F.lower(F.trim("status")), F.lit(""))
    kinds = F.array(
        some("algorithm", F.nullif(F.col("rcl_algorithm"), F.lit(""))), some("dataset", F.nullif(pair, F.lit(f"{S.NO_FILE}|{S.NO_FILE}"))),
        some("search", F.nullif(F.upper("local_search"), F.lit(""))), some("search", F.nullif(F.upper("neighborhood"), F.lit(""))), some("status", state),
    )
    columns = ["rcl_algorithm", "training_file_name", "testing_file_name", "local_search", "neighborhood", "status"]
    both = runs.select(*columns).union(snapshots(events).select(*columns))
    found = both.select(F.explode(kinds).alias("o")).select("o.*").where("value IS NOT NULL").distinct()
    return found.union(_no_states(found))


def _no_states(found: DataFrame) -> DataFrame:
    """The two states that are offered where none is known."""
    none = found.agg(F.count_if(F.col("kind") == "status").alias("n")).where("n = 0")
    return none.select(F.lit("status").alias("kind"), F.explode(F.array(F.lit("running"), F.lit("completed"))).alias("value"))


def merge_runs(stored: DataFrame, live: DataFrame) -> DataFrame:
    """One row for each seed of either source: the greater topic priority, then score, then the latest, live before stored."""
    both = stored.withColumn("_live", F.lit(0)).unionByName(live.withColumn("_live", F.lit(1)))
    order = [F.desc(labels.topic_priority(F.col("topic"))), F.desc_nulls_last(F.coalesce("best_score", "current_score")), F.desc("updated_at"), F.desc("_live")]
    return both.withColumn("_rank", F.row_number().over(Window.partitionBy("seed_id").orderBy(*order))).where("_rank = 1").drop("_rank", "_live")


def dataset_usage(datasets: DataFrame, runs: DataFrame) -> DataFrame:
    """Runs that use each dataset for training or testing (one that uses it for both counts once) and their best score."""
    used = runs.select("seed_id", F.coalesce("best_score", "current_score").alias("score"), F.explode(F.array_distinct(F.array("training_file_name", "testing_file_name"))).alias("name"))
    by = used.groupBy("name").agg(F.count("*").alias("runs"), F.max("score").alias("best_score"))
    return datasets.select("name").join(by, "name", "left").withColumn("runs", F.coalesce("runs", F.lit(0)))


def stage_distribution(events: DataFrame) -> DataFrame:
    """Messages of the initial, local final and best stage."""
    stage = F.when(F.col("topic") == S.INITIAL, "initial").when(F.col("topic") == S.SOLUTIONS, "local_final").when(F.col("topic") == S.BEST, "best")
    return snapshots(events).select(stage.alias("stage")).where("stage IS NOT NULL").groupBy("stage").agg(F.count("*").alias("n"))


def research_by_algorithm(runs: DataFrame) -> DataFrame:
    """By algorithm: runs, the best score and its seed (the first of equals), mean resource use."""
    score = F.coalesce("best_score", "current_score")
    first = F.struct(score, -F.unix_micros("created_at"), F.col("seed_id"))
    return runs.groupBy(F.upper(F.coalesce(F.nullif("rcl_algorithm", F.lit("")), F.lit("UNKNOWN"))).alias("algorithm")).agg(
        F.count("*").alias("runs"), F.max(score).alias("best_score"), F.max_by("seed_id", F.when(score.isNotNull(), first)).alias("best_seed"),
        mean("cpu_usage").alias("avg_cpu"), mean("memory_usage_percent").alias("avg_memory_percent"),
    )


def research_counts(runs: DataFrame, events: DataFrame) -> DataFrame:
    """(kind, name, n, best_score): runs by stage and by search (with the best score), events by topic."""
    score = F.coalesce("best_score", "current_score")
    told = lambda *c: F.coalesce(*(F.nullif(F.col(x), F.lit("")) for x in c[:-1]), F.lit(c[-1]))
    of_runs = F.array(F.struct(F.lit("stage").alias("kind"), told("stage", "topic", "unknown").alias("name"), F.lit(None).cast("double").alias("score")), F.struct(F.lit("search").alias("kind"), told("local_search", "neighborhood", "pipeline").alias("name"), score.alias("score")))
    rows = runs.select(F.explode(of_runs).alias("x")).select("x.*")
    topics = events.select(F.lit("topic").alias("kind"), told("topic", S.NO_TOPIC).alias("name"), F.lit(None).cast("double").alias("score"))
    return rows.union(topics).groupBy("kind", "name").agg(F.count("*").alias("n"), F.max("score").alias("best_score"))


def first_high_quality(runs: DataFrame, history: DataFrame, events: DataFrame, threshold: float = HIGH_QUALITY) -> DataFrame:
    """When the threshold was first reached, as one row.

    The first history entry that reached it; if, in order of creation, a run reached it before any run whose history
    shows it, that run's last update where that is earlier; if neither is known, the first event whose score reached it.
    history: seed_id, at, score; events: at, score.
    """
    score = F.coalesce("best_score", "current_score")
    high = history.where(F.col("score") >= threshold).groupBy("seed_id").agg(F.min("at").alias("_at"))
    rows = runs.select("seed_id", "created_at", F.coalesce("updated_at", "created_at").alias("_told"), (score >= threshold).alias("_reached")).join(high, "seed_id", "left")
    place = F.struct("created_at", "seed_id")
    told = rows.agg(
        F.min("_at").alias("_entry"), F.min(F.when(F.col("_at").isNotNull(), place)).alias("_shown"),
        F.min(F.when(F.col("_reached"), place)).alias("_run"), F.min_by("_told", F.when(F.col("_reached"), place)).alias("_told"),
    )
    seen = events.agg(F.min(F.when(F.col("score") >= threshold, F.col("at"))).alias("_event"))
    from_run = F.when(F.col("_run").isNotNull() & (F.col("_shown").isNull() | (F.col("_shown") > F.col("_run"))), F.col("_told"))
    return told.crossJoin(seen).select(F.coalesce(F.least("_entry", from_run), F.col("_event")).alias("high_at"))


def research_summary(runs: DataFrame, history: DataFrame, events: DataFrame, threshold: float = HIGH_QUALITY) -> DataFrame:
    """The research summary as one row. history: seed_id, request_id, at, score, delta, improved; events: request_id, at, score.

    Runs, history by seed and events by request are each made once and written: they are far fewer than the events, and
    the sections are aggregates of one row each of them, joined side by side.
    """
    score = F.coalesce("best_score", "current_score")
    size = lambda c: F.when(F.size(c) > 0, F.size(c))
    has = lambda c: c in runs.columns
    none = F.lit(0).cast("long")
    telemetry = F.coalesce("cpu_usage", "memory_usage_percent").isNotNull()
    gain = F.when(F.col("delta") > 0, F.col("delta"))
    high = F.min(F.when(F.col("score") >= threshold, F.col("at"))).alias("high")
    seen_at = (F.min("at").alias("first"), F.max("at").alias("last"), F.count("*").alias("n"))
    runs = cut(runs)
    by_seed = cut(history.groupBy("seed_id").agg(F.count(gain).alias("gains"), F.sum(gain).alias("gain"), F.max(gain).alias("most"), high, *seen_at, F.collect_set("request_id").alias("requests")))
    by_request = cut(events.groupBy("request_id").agg(high, *seen_at))
    totals = runs.agg(
        F.count("*").alias("runs"),
        F.countDistinct(labels.dataset_pair(F.col("training_file_name"), F.col("testing_file_name"))).alias("dataset_pairs"),
        F.count_if(score >= threshold).alias("high_quality_runs"),
        F.max(score).alias("best_score"),
        F.max_by("seed_id", F.struct(score, "updated_at", "seed_id")).alias("best_seed"),
        F.count_if(telemetry).alias("runs_with_telemetry"),
        mean(size("solution_features")).alias("avg_solution_size"),
        mean(size("rcl_features")).alias("avg_rcl_size"),
        F.array_join(F.array_sort(F.collect_set(F.upper("local_search"))), ",").alias("searches"),
        F.array_join(F.array_sort(F.collect_set(F.upper("neighborhood"))), ",").alias("strategies"),
        (F.count_if(F.col("topic") == S.BEST) if has("topic") else none).alias("best_solutions"),
        (F.count_if("completed") if has("completed") else none).alias("completed_runs"),
        F.countDistinct(F.nullif("rcl_algorithm", F.lit(""))).alias("algorithms"),
        (mean(size("enabled_local_searches")) if has("enabled_local_searches") else F.lit(None).cast("double")).alias("avg_enabled_searches"),
        F.min("created_at").alias("_run_first"),
        F.max("updated_at").alias("_run_last"),
    )
    gains = by_seed.agg(
        F.coalesce(F.sum("gains"), none).alias("improvements"),
        F.round(F.sum("gain") / F.nullif(F.sum("gains"), F.lit(0)), 6).alias("avg_improvement"),
        F.max("most").alias("max_improvement"),
        F.count("*").alias("runs_with_history"),
        F.min("first").alias("_first"),
        F.max("last").alias("_last"),
        F.coalesce(F.sum("n"), none).alias("history_entries"),
        F.coalesce(F.max("n"), none).alias("max_history_depth"),
    )
    seen = by_request.agg(F.coalesce(F.sum("n"), none).alias("events"), F.min("first").alias("_event_first"), F.max("last").alias("_event_last"))
    requests = runs.select("request_id").union(by_seed.select(F.explode("requests"))).union(by_request.select("request_id")).agg(F.countDistinct("request_id").alias("requests"))
    features = runs.select(F.explode("solution_features").alias("f")).agg(F.countDistinct("f").alias("unique_features"))
    reached = lambda rows, *keys: rows.where("high IS NOT NULL").select(*keys, F.col("high").alias("at"), F.lit(threshold).alias("score"))
    first_high = first_high_quality(runs, reached(by_seed, "seed_id"), reached(by_request), threshold)
    row = totals.crossJoin(gains).crossJoin(seen).crossJoin(requests).crossJoin(features).crossJoin(first_high)
    first, last = F.least("_run_first", "_first", "_event_first"), F.greatest("_run_last", "_last", "_event_last")
    seconds = lambda a, b: F.round((F.unix_micros(b) - F.unix_micros(a)) / 1_000_000, 0).cast("long")
    share = lambda n: F.round(F.col(n) / F.greatest("runs", F.lit(1)), 6)
    return row.select(
        "runs", "dataset_pairs", "high_quality_runs", share("high_quality_runs").alias("high_quality_ratio"), F.greatest(seconds(first, F.col("high_at")), F.lit(0)).alias("seconds_to_high_quality"),
        "events", "best_solutions", "completed_runs", (F.col("runs") - F.col("completed_runs")).alias("active_runs"), "algorithms", "max_history_depth", "avg_enabled_searches",
        "best_score", "best_seed", "improvements", "avg_improvement", "max_improvement", "requests", "runs_with_history", "runs_with_telemetry",
        share("runs_with_history").alias("history_coverage"), share("runs_with_telemetry").alias("telemetry_coverage"), share("history_entries").alias("avg_history_depth"),
        seconds(first, last).alias("observation_seconds"), "unique_features", "avg_solution_size", "avg_rcl_size", "searches", "strategies",
    )
