"""Projections that clients of the event log read: runs with their events, workflow steps, chart rankings, live windows."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftlake import schemas as S
from siftlake.functions import labels
from siftlake.operators.feed import within
from siftlake.operators.monitor import activity, best, first_per, improvements, latest, mean, snapshots, topic_metrics

#: Topics that a stage lens lets through.
LENSES = {"all": S.TOPICS, "initial": (S.INITIAL,), "local": (S.PROGRESS, S.SOLUTIONS), "best": (S.BEST,), "restart": (S.RESTART,)}


def runs_with_events(runs: DataFrame, events: DataFrame, newest: int = 30) -> DataFrame:
    """Each run with its newest events, newest first, as an array of at most so many."""
    place = F.row_number().over(Window.partitionBy("seed_id").orderBy(*latest()))
    some = snapshots(events).withColumn("_place", place).where(F.col("_place") <= newest)
    held = some.groupBy("seed_id").agg(F.sort_array(F.collect_list(F.struct("_place", "event_id", "topic", "score", "created_at"))).alias("history"))
    return runs.join(held, "seed_id", "left").withColumn("history", F.coalesce(F.transform("history", lambda x: x.dropFields("_place")), F.array()))


def best_events(events: DataFrame) -> DataFrame:
    """The best-solution message of each seed, latest among equals, as a run row that is completed."""
    rows = first_per(snapshots(events).where((F.col("topic") == S.BEST) & F.col("seed_id").isNotNull()), ["seed_id"], best())
    return rows.select("seed_id", "request_id", F.col("score").alias("best_score"), "rcl_algorithm", "local_search", "neighborhood", "training_file_name", "testing_file_name", F.lit("completed").alias("status"), F.col("created_at").alias("updated_at"))


def of_seeds(events: DataFrame, seeds: DataFrame) -> DataFrame:
    """Events of listed seeds; the list may be of any size."""
    return events.join(seeds.select("seed_id").distinct(), "seed_id", "left_semi")


def workflow_steps(events: DataFrame) -> DataFrame:
    """The steps of each run in words: candidate list, strategy, searches in the order they first reported, best solution."""
    rows = snapshots(events).where("seed_id IS NOT NULL")
    first = rows.where(F.col("topic").isin(S.PROGRESS, S.SOLUTIONS)).groupBy("seed_id", "local_search").agg(F.min(F.struct("created_at", "event_id")).alias("at"))
    searches = first.groupBy("seed_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "local_search"))), lambda x: x["local_search"]).alias("searches"))
    ends = rows.groupBy("seed_id").agg(F.max_by("rcl_algorithm", F.struct("created_at", "event_id")).alias("rcl"), F.max_by("neighborhood", F.struct("created_at", "event_id")).alias("strategy"), F.max(F.col("topic") == S.BEST).alias("solved"))
    steps = F.concat(F.array(F.concat(F.lit("RCL "), "rcl"), F.col("strategy")), F.coalesce("searches", F.array().cast("array<string>")), F.when(F.col("solved"), F.array(F.lit("BEST"))).otherwise(F.array().cast("array<string>")))
    return ends.join(searches, "seed_id", "left").select("seed_id", F.array_distinct(F.filter(steps, lambda x: x.isNotNull() & (x != ""))).alias("steps"))


def chart_ranking(runs: DataFrame, history: DataFrame, featured: str | None = None, top: int = 8) -> DataFrame:
    """Runs in the order in which charts show them: featured, completed, score, depth of history, latest; the first ones, the featured one always."""
    depth = history.groupBy("seed_id").agg(F.count("*").alias("depth"))
    rows = runs.join(depth, "seed_id", "left").withColumns({"depth": F.coalesce("depth", F.lit(0)), "featured": F.col("seed_id") == F.lit(featured) if featured else F.lit(False), "score": F.coalesce("best_score", "current_score", F.lit(-1.0))})
    return rows.orderBy(F.desc("featured"), F.desc("completed"), F.desc("score"), F.desc("depth"), F.desc("updated_at"), "seed_id").limit(top)


def lens_topics(topics: list[str], lens: str = "all") -> list[str]:
    """The listed topics that a stage lens lets through, in their order; an empty list means all topics."""
    return [t for t in (topics or S.TOPICS) if t in LENSES.get(lens, S.TOPICS)]


def selection(algorithm: str | None = None, pair: str | None = None, lens: str = "all", status: str | None = None, search: str | None = None, request: str | None = None, since: datetime | None = None, until: datetime | None = None) -> Column:
    """The workspace's filter of snapshots; what is not given passes, and so does a null time."""
    out = F.col("topic").isin(*lens_topics([], lens))
    for given, column in ((algorithm, F.col("rcl_algorithm")), (pair, labels.dataset_pair(F.col("training_file_name"), F.col("testing_file_name"))), (status, F.col("status")), (search and search.upper(), F.upper("local_search")), (request, F.col("request_id"))):
        if given:
            out = out & (column == given)
    if since:
        out = out & (F.col("created_at").isNull() | (F.col("created_at") >= F.lit(since)))
    if until:
        out = out & (F.col("created_at").isNull() | (F.col("created_at") <= F.lit(until)))
    return out


def time_text(query: str, column: str = "created_at", order: str | None = None) -> Column:
    """Whether a time, in ISO form, as local date and minute, or by its place in the timeline (#n), holds a text."""
    place = [F.concat(F.lit("#"), F.col(order).cast("string"))] if order else []
    shown = F.concat_ws(" ", F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.date_format(column, "yyyy-MM-dd HH:mm"), *place)
    return F.contains(F.lower(shown), F.lit(query.strip().lower()))


#: Seconds of the named windows of time.
WINDOWS = {"15m": 900, "1h": 3_600, "6h": 21_600, "24h": 86_400, "7d": 604_800}


def window_bounds(name: str, now: datetime, since: datetime | None = None, until: datetime | None = None) -> tuple[datetime | None, datetime | None]:
    """The closed range of a named window that ends now; custom has its own bounds, and any other name none."""
    if name == "custom":
        return since, until
    return (now - timedelta(seconds=WINDOWS[name]), now) if name in WINDOWS else (None, None)


def in_window(rows: DataFrame, name: str, now: datetime, since: datetime | None = None, until: datetime | None = None, column: str = "created_at") -> DataFrame:
    """Rows of a named window; a null time passes."""
    low, high = window_bounds(name, now, since, until)
    return rows.where(within(column, low, high)) if low or high else rows


def duration_label(seconds: Column) -> Column:
    """A span of time in its two greatest units."""
    part = lambda n, unit: F.concat(n.cast("long").cast("string"), F.lit(unit))
    whole = F.greatest(F.floor(seconds), F.lit(0))
    pair = lambda big, small, u, v: F.concat_ws(" ", part(F.floor(whole / big), u), part(F.floor(F.pmod(whole, F.lit(big)) / small), v))
    return F.when(whole < 60, part(whole, "s")).when(whole < 3600, pair(60, 1, "m", "s")).when(whole < 86400, pair(3600, 60, "h", "m")).otherwise(pair(86400, 3600, "d", "h"))


def newest(events: DataFrame, n: int = 300) -> DataFrame:
    """The live window: the newest events over all seeds."""
    return snapshots(events).orderBy(*latest()).limit(n)


def live_projection(events: DataFrame, n: int = 300) -> tuple[DataFrame, DataFrame]:
    """Topic metrics and minute activity of the live window."""
    window = newest(events, n)
    return topic_metrics(window), activity(window, 60, None)


def by_initial_algorithm(events: DataFrame) -> DataFrame:
    rows = snapshots(events).where(F.col("topic") == S.INITIAL)
    return rows.groupBy("rcl_algorithm").agg(F.countDistinct("seed_id").alias("seeds"), mean("score").alias("avg_score"), F.max("score").alias("best_score"))


def improvement_summary(events: DataFrame) -> DataFrame:
    """Number of improvements, and the strongest and the latest of them."""
    order = F.struct("delta", "created_at", "event_id")
    return improvements(events).agg(F.count("*").alias("improvements"), F.max("delta").alias("strongest"), F.max_by("seed_id", order).alias("strongest_seed"), F.max_by("seed_id", F.struct("created_at", "event_id")).alias("latest_seed"))


def queue_counts(launches: DataFrame) -> DataFrame:
    return launches.groupBy("state").agg(F.count("*").alias("launches"))


def launch_view(launches: DataFrame, places: DataFrame, progress: DataFrame | None = None) -> DataFrame:
    """Launches with their place in the queue, their counts and reconciled state, and whether they can still be cancelled.

    progress: launch_id, expected, observed, done, pending, state; launches it doesn't name have counts of 0.
    """
    out = launches.join(places.select("launch_id", "place"), "launch_id", "left")
    if progress is not None:
        counts = ("expected", "observed", "done", "pending")
        out = out.join(progress.select("launch_id", *counts, F.col("state").alias("_state")), "launch_id", "left")
        out = out.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in counts} | {"state": F.coalesce("_state", "state")}).drop("_state")
        out = out.withColumn("pipeline_completed", F.col("state") == "completed")
    return out.withColumn("can_cancel", F.col("state").isin("queued", "dispatching", "cancelling"))


def latest_and_best(runs: DataFrame, events: DataFrame) -> DataFrame:
    """Runs with score and time of their best-solution message, where there is one, over the run's own."""
    top = best_events(events).select("seed_id", F.col("best_score").alias("solved_score"), F.col("updated_at").alias("solved_at"))
    return runs.join(top, "seed_id", "left").withColumn("shown_score", F.coalesce("solved_score", "best_score", "current_score"))
