"""Aggregates over the event log: overview, topics, activity, resources, outcomes, timelines.

Every operator takes an event log (siftlake.schemas.EVENT) or the runs folded from it and returns a DataFrame. Nothing
is ordered but where the order is the feature (top-N, pages); rankings are row_number filters, which Spark turns into
group limits before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftlake import schemas as S


def snapshots(events: DataFrame) -> DataFrame:
    """Events that carry a search snapshot."""
    return events.where(F.col("event_type").isin(*S.SNAPSHOT_EVENTS))


def mean(column: str | Column) -> Column:
    return F.round(F.avg(column), 6)


def micros(column: str = "created_at") -> Column:
    return F.unix_micros(column)


def bucket(column: str, seconds: int) -> Column:
    """Start of the bucket of a timestamp, in epoch seconds."""
    return (F.floor(F.unix_micros(column) / F.lit(seconds * 1_000_000)) * seconds).cast("long")


def overview(events: DataFrame) -> DataFrame:
    topic = F.coalesce("topic", F.lit(S.NO_TOPIC))
    return snapshots(events).agg(
        F.count("*").alias("events"),
        F.countDistinct("seed_id").alias("seeds"),
        F.countDistinct(topic).alias("topics"),
        mean(F.when(F.col("topic") == S.INITIAL, F.col("score"))).alias("avg_initial"),
    )


def topic_metrics(events: DataFrame) -> DataFrame:
    by = snapshots(events).groupBy(F.coalesce("topic", F.lit(S.NO_TOPIC)).alias("topic"))
    return by.agg(F.count("*").alias("n"), F.countDistinct("seed_id").alias("seeds"), mean("score").alias("avg_score"), F.max("score").alias("best_score")).orderBy(F.desc("n"), "topic")


def activity(events: DataFrame, seconds: int = 3600, newest: int | None = 336) -> DataFrame:
    """Counts and averages of time buckets; the newest buckets, oldest first."""
    out = snapshots(events).groupBy(bucket("created_at", seconds).alias("bucket")).agg(
        F.count("*").alias("n"), F.countDistinct("seed_id").alias("seeds"), mean("score").alias("avg_score"), mean("cpu_usage").alias("avg_cpu"),
        mean("memory_usage_percent").alias("avg_memory_percent"), F.max("score").alias("best_score"),
    )
    return (out.orderBy(F.desc("bucket")).limit(newest) if newest else out).orderBy("bucket")


def resources(events: DataFrame, by: str, topics: tuple[str, ...]) -> DataFrame:
    """Mean resource use by a column, over messages of some topics that carry telemetry."""
    told = F.coalesce("cpu_usage", "memory_usage", "memory_usage_percent").isNotNull()
    rows = snapshots(events).where(F.col("topic").isin(*topics) & told)
    return rows.groupBy(by).agg(F.count("*").alias("samples"), mean("cpu_usage").alias("avg_cpu"), mean("memory_usage").alias("avg_memory"), mean("memory_usage_percent").alias("avg_memory_percent"))


def resources_by_algorithm(events: DataFrame) -> DataFrame:
    return resources(events, "rcl_algorithm", (S.INITIAL,))


def resources_by_search(events: DataFrame) -> DataFrame:
    return resources(events, "local_search", (S.PROGRESS, S.SOLUTIONS))


def first_per(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order; a null key is a key."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")


def latest() -> list[Column]:
    return [F.desc("created_at"), F.desc("event_id")]


def best() -> list[Column]:
    return [F.desc_nulls_last("score"), F.desc("created_at"), F.desc("event_id")]


def initial_latest(events: DataFrame) -> DataFrame:
    """The latest initial message of each seed."""
    return first_per(snapshots(events).where(F.col("topic") == S.INITIAL), ["seed_id"], latest())


def initial_counts(events: DataFrame) -> DataFrame:
    return initial_latest(events).groupBy("rcl_algorithm").agg(F.count("*").alias("initial_seeds"))


def fold_runs(events: DataFrame) -> DataFrame:
    """Runs: the state of each seed after its messages in order of time.

    The last message gives the current fields, the greatest score is the best one, and a run is completed from its
    first completed message on. Of the latest initial message its score and algorithm are kept, and of the best
    best-solution message its features. One aggregation: ordered structs stand for windows, so nothing is sorted.
    """
    at = F.struct("created_at", "event_id")
    last = lambda c: F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), at))
    initial = F.when(F.col("topic") == S.INITIAL, at)
    solved = F.when(F.col("topic") == S.BEST, F.struct("score", "created_at", "event_id"))
    fields = ["request_id", "topic", "stage", "rcl_algorithm", "classifier", "local_search", "neighborhood", "training_file_name", "testing_file_name", "cpu_usage", "memory_usage", "memory_usage_percent", "solution_features", "rcl_features"]
    return snapshots(events).where("seed_id IS NOT NULL").groupBy("seed_id").agg(
        *(last(c).alias(c) for c in fields),
        last("score").alias("current_score"),
        F.max("score").alias("best_score"),
        F.min("created_at").alias("created_at"),
        F.max("created_at").alias("updated_at"),
        F.count("*").alias("updates"),
        F.max(F.col("status") == "completed").alias("completed"),
        F.max_by("score", initial).alias("initial_score"),
        F.max_by("rcl_algorithm", initial).alias("initial_algorithm"),
        F.max_by("solution_features", solved).alias("best_features"),
    )


def final_rows(runs: DataFrame) -> DataFrame:
    """Runs that have a score, with the algorithm that they count for."""
    rows = runs.where(F.coalesce("best_score", "current_score").isNotNull())
    return rows.withColumn("algorithm", F.coalesce(F.nullif("rcl_algorithm", F.lit("")), "initial_algorithm", F.lit(S.UNKNOWN))).withColumn("final_score", F.coalesce("best_score", "current_score"))


def final_summary(runs: DataFrame) -> DataFrame:
    """By algorithm: seeds, best run, mean final score and gain, searches and datasets."""
    pair = F.concat_ws("|", "training_file_name", "testing_file_name")
    order = F.struct("final_score", "updated_at", "seed_id")
    return final_rows(runs).groupBy("algorithm").agg(
        F.count("*").alias("seeds"),
        F.max("final_score").alias("best_score"),
        F.max_by("seed_id", order).alias("best_seed"),
        mean("final_score").alias("avg_final"),
        mean(F.col("final_score") - F.col("initial_score")).alias("avg_gain"),
        F.array_join(F.array_sort(F.collect_set("local_search")), ",").alias("searches"),
        F.array_join(F.array_sort(F.collect_set(pair)), ",").alias("datasets"),
    )


def search_outcomes(events: DataFrame, runs: DataFrame) -> DataFrame:
    """By local search: seeds, seeds that it won, best outcome, mean score and gain over the best message of each seed and search."""
    rows = snapshots(events).where(F.col("topic").isin(S.PROGRESS, S.SOLUTIONS) & (F.col("local_search") != S.UNKNOWN))
    top = first_per(rows, ["seed_id", "local_search"], best())
    final = runs.select("seed_id", "initial_score", F.coalesce(F.nullif("local_search", F.lit("")), F.nullif("neighborhood", F.lit("")), F.lit(S.UNKNOWN)).alias("final_search"))
    return top.join(final, "seed_id", "left").groupBy("local_search").agg(
        F.countDistinct("seed_id").alias("seeds"),
        F.countDistinct(F.when(F.col("final_search") == F.col("local_search"), F.col("seed_id"))).alias("won_seeds"),
        F.max("score").alias("best_score"),
        mean("score").alias("avg_score"),
        mean(F.col("score") - F.col("initial_score")).alias("avg_gain"),
    )


def timeline(events: DataFrame, keys: list[str], seconds: int = 60, newest: int | None = None) -> DataFrame:
    """Time buckets by keys: counts, means, and the latest score and stage of each bucket; newest buckets of a key if a number is given."""
    at = F.struct("created_at", "event_id")
    out = snapshots(events).groupBy(*keys, bucket("created_at", seconds).alias("bucket")).agg(
        F.count("*").alias("n"), F.countDistinct("seed_id").alias("seeds"), F.max_by("score", at).alias("latest_score"), F.max_by("stage", at).alias("latest_stage"),
        mean("score").alias("avg_score"), F.max("score").alias("best_score"), mean("cpu_usage").alias("avg_cpu"), mean("memory_usage_percent").alias("avg_memory_percent"),
        F.max("request_id").alias("request_id"), F.max("rcl_algorithm").alias("algorithm"),
    )
    if newest and not keys:
        return out.orderBy(F.desc("bucket")).limit(newest)
    if newest:
        order = Window.partitionBy(*keys).orderBy(F.desc("bucket"))
        out = out.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= newest).drop("_rank")
    return out


def timelines(events: DataFrame, seed_seconds: int = 3600, seconds: int = 60) -> DataFrame:
    """The timelines of seeds, of algorithms and of all messages, from one scan and one aggregation of grouping sets.

    scope says which: seed (seed_id, buckets of seed_seconds), algorithm (rcl_algorithm) or overview, with what timeline()
    gives; latest score and stage are those of the bucket.
    """
    at = F.struct("created_at", "event_id")
    wide, narrow = bucket("created_at", seed_seconds).alias("_wide"), bucket("created_at", seconds).alias("_narrow")
    rows = snapshots(events).select("*", wide, narrow, F.col("seed_id").alias("_seed"), F.col("rcl_algorithm").alias("_algorithm"))
    keys = [F.col(c) for c in ("_seed", "_algorithm", "_wide", "_narrow")]
    out = rows.groupingSets([[keys[0], keys[2]], [keys[1], keys[3]], [keys[3]]], *keys).agg(
        F.grouping_id(*keys).alias("_set"),
        F.count("*").alias("n"), F.countDistinct("seed_id").alias("seeds"), F.max_by("score", at).alias("latest_score"), F.max_by("stage", at).alias("latest_stage"),
        mean("score").alias("avg_score"), F.max("score").alias("best_score"), mean("cpu_usage").alias("avg_cpu"), mean("memory_usage_percent").alias("avg_memory_percent"),
        F.max("request_id").alias("request_id"), F.max("rcl_algorithm").alias("algorithm"),
    )
    # A bit of the set is 1 for a key that it leaves out.
    scope = F.when(F.col("_set") == 0b0101, "seed").when(F.col("_set") == 0b1010, "algorithm").otherwise("overview")
    own = [c for c in out.columns if not c.startswith("_")]
    return out.select(scope.alias("scope"), F.col("_seed").alias("seed_id"), F.col("_algorithm").alias("rcl_algorithm"), F.coalesce("_wide", "_narrow").alias("bucket"), *own)


def run_timeline(events: DataFrame, seed_id: str, seconds: int = 60, newest: int = 240) -> DataFrame:
    """The newest buckets of one run, numbered from the oldest."""
    out = timeline(events.where(F.col("seed_id") == seed_id), ["seed_id"], max(seconds, 10), newest)
    return out.withColumn("place", F.row_number().over(Window.partitionBy("seed_id").orderBy("bucket")).cast("long"))


def score_deltas(events: DataFrame) -> DataFrame:
    """Each scored message with the best score before it, the gain, and whether it improved (the first one did)."""
    before = Window.partitionBy("seed_id").orderBy("created_at", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = snapshots(events).where("score IS NOT NULL").withColumn("previous_best", F.max("score").over(before))
    return rows.withColumn("delta", F.round(F.col("score") - F.col("previous_best"), 6)).withColumn("improved", F.col("previous_best").isNull() | (F.col("score") > F.col("previous_best")))


def improvements(events: DataFrame, newest: int | None = None) -> DataFrame:
    """Messages whose score beat all before it of their seed; the first of a seed isn't one."""
    rows = score_deltas(events).where("previous_best IS NOT NULL AND improved")
    return rows.orderBy(*latest()).limit(newest) if newest else rows


def verified_best(events: DataFrame) -> DataFrame:
    """New best solutions as a verifier emits them: solution messages whose score (null: 0) beats all before it of their seed."""
    rows = events.where((F.col("topic") == S.SOLUTIONS) & F.col("seed_id").isNotNull()).withColumn("value", F.coalesce("score", F.lit(0.0)))
    before = Window.partitionBy("seed_id").orderBy("created_at", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("prior", F.max("value").over(before)).where("prior IS NULL OR value > prior")


def watermark(events: DataFrame, runs: DataFrame) -> DataFrame:
    """What a read model is fresh against: the newest event, and the numbers of events and runs."""
    return events.agg(F.max(micros()).alias("newest"), F.count("*").alias("events")).crossJoin(runs.agg(F.count("*").alias("runs")))


def elapsed(events: DataFrame) -> DataFrame:
    """Seconds of each message since the first of its seed."""
    start = F.min("created_at").over(Window.partitionBy("seed_id"))
    return events.withColumn("elapsed", F.floor((F.unix_micros("created_at") - F.unix_micros(start)) / 1_000_000).cast("long"))


def newest_per(events: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The newest n rows of each key, numbered from the newest."""
    return events.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*latest()))).where(F.col("place") <= n)


def deduplicate(live: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """The union of two sources with one row of each key: of the live source before the stored one, then the newest."""
    both = live.withColumn("_source", F.lit(0)).unionByName(stored.withColumn("_source", F.lit(1)))
    return first_per(both, keys, [F.col("_source"), *latest()]).drop("_source")


def preferred(candidates: DataFrame, keys: list[str], priority: Column) -> DataFrame:
    """The preferred row of each key: greatest priority, then score (null least), then latest."""
    return first_per(candidates.withColumn("_priority", priority), keys, [F.desc("_priority"), *best()]).drop("_priority")
