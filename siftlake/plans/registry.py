"""Queries of the analytics engine over the driver's tables, and DuckDB SQL of the same results, by name.

Times are given as epoch microseconds or seconds, arrays as sorted joined text, averages rounded to 6 digits and feature
scores to 8, so that results can be compared by value.
"""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake import schemas as S
from siftlake.functions import labels
from siftlake.operators import feed, monitor, runs, scoring, search, series, views
from siftlake.plans import searchsql
from siftlake.session import shared_dir, table
from siftlake.sources import arff, arffsource, catalog, eventlog, incremental, keyed, sinks, topiclog
from siftlake.streaming import folds

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

_EV = """ev AS (
  SELECT event_id, CAST(user_id AS VARCHAR) AS seed_id, 'req-' || CAST(user_id % 10 AS VARCHAR) AS request_id, user_id,
    CASE event_type WHEN 'signup' THEN 'INITIAL_SOLUTION_TOPIC' WHEN 'view' THEN 'LOCAL_SEARCH_PROGRESS_TOPIC' WHEN 'click' THEN 'SOLUTIONS_TOPIC'
      WHEN 'error' THEN 'NEIGHBORHOOD_RESTART_TOPIC' WHEN 'purchase' THEN 'BEST_SOLUTION_TOPIC' END AS topic,
    k, value AS score, epoch_us(ts) AS us, CAST(k AS DOUBLE) AS cpu, k * 1.5 AS mem, CAST((k * 7) % 100 AS DOUBLE) AS memp,
    list_extract(['IG','GR','RF','SU'], CAST(user_id % 4 + 1 AS INTEGER)) AS algorithm, list_extract(['BIT_FLIP','IWSS','IWSSR'], k % 3 + 1) AS search,
    list_extract(['VND','RVND'], CAST(user_id % 2 + 1 AS INTEGER)) AS strategy, k % 13 AS iteration,
    CASE WHEN k % 11 = 0 THEN 'completed' ELSE 'running' END AS status,
    'train-' || CAST(user_id % 3 AS VARCHAR) || '.arff' AS training, 'test-' || CAST(user_id % 3 AS VARCHAR) || '.arff' AS testing,
    [k % 7 + 1, k % 5 + 8, k % 3 + 13] AS features, [k % 4 + 16, k % 6 + 20] AS rcl, list_extract(['J48','NB'], CAST(user_id % 5 % 2 + 1 AS INTEGER)) AS classifier
  FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k FROM events)),
st AS (SELECT *, CASE topic WHEN 'INITIAL_SOLUTION_TOPIC' THEN 'initial_solution' WHEN 'NEIGHBORHOOD_RESTART_TOPIC' THEN 'neighborhood_restart'
      WHEN 'BEST_SOLUTION_TOPIC' THEN 'best_solution' ELSE lower(search) END AS stage FROM ev)"""
_RUNS = """runs AS (SELECT seed_id, arg_max(request_id, us) AS request_id, arg_max(topic, us) AS topic, arg_max(algorithm, us) AS algorithm, arg_max(search, us) AS search, arg_max(strategy, us) AS strategy,
    arg_max(training, us) AS training, arg_max(testing, us) AS testing, arg_max(features, us) AS features, arg_max(rcl, us) AS rcl, arg_max(classifier, us) AS classifier, arg_max(cpu, us) AS cpu, arg_max(memp, us) AS memp, arg_max(score, us) AS current_score, max(score) AS best_score,
    min(us) AS created_us, max(us) AS updated_us, count(*) AS updates, bool_or(status = 'completed') AS completed FROM ev GROUP BY seed_id)"""
_INITIAL = "initial AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY us DESC, event_id DESC) AS rk FROM ev WHERE topic = 'INITIAL_SOLUTION_TOPIC') WHERE rk = 1)"
_LAUNCH = """launch AS (SELECT o_orderkey AS launch_id, 'req-' || CAST(o_custkey % 10 AS VARCHAR) AS request_id, CASE WHEN o_orderstatus = 'O' THEN 'queued' ELSE 'started' END AS state,
    1704067200000000 + (o_orderkey % 43200) * 60000000 - 30000000 AS requested_us, CASE WHEN o_orderstatus <> 'O' THEN 1704067200000000 + (o_orderkey % 43200) * 60000000 END AS started_us,
    [list_extract(['IG','GR','RF','SU'], CAST(o_custkey % 4 + 1 AS INTEGER)), list_extract(['IG','GR','RF','SU'], CAST((o_custkey + 1) % 4 + 1 AS INTEGER))] AS algorithms,
    'train-' || CAST(o_custkey % 3 AS VARCHAR) || '.arff' AS training, 'test-' || CAST(o_custkey % 3 AS VARCHAR) || '.arff' AS testing, o_orderkey % 5 + 1 AS generations,
    CASE WHEN o_orderkey % 7 > 0 THEN list_extract(['J48','NB'], CAST(o_custkey % 5 % 2 + 1 AS INTEGER)) END AS classifier, o_custkey AS requested_by FROM orders)"""
_NEXT = "nxt AS (SELECT *, first_value(started_us IGNORE NULLS) OVER (ORDER BY requested_us, launch_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_us FROM launch)"
_MATCH = """matched AS (SELECT l.launch_id, r.* FROM (SELECT *, unnest(algorithms) AS alg FROM nxt) l JOIN runs r ON r.algorithm = l.alg AND r.training = l.training AND r.testing = l.testing
    AND (l.classifier IS NULL OR l.classifier = r.classifier) AND r.created_us >= coalesce(l.started_us, l.requested_us) AND (l.next_us IS NULL OR r.created_us < l.next_us))"""
#: The whole state of runs: shown messages are those up to the first end of a run, and further ends.
_STATES = """s1 AS (SELECT *, topic = 'SOLUTIONS_TOPIC' AND iteration >= CASE WHEN strategy = 'VND' THEN 6 ELSE 2 END AS ends FROM st),
s2 AS (SELECT *, min(us) FILTER (ends) OVER (PARTITION BY seed_id) AS first_end, max(us) FILTER (ends) OVER (PARTITION BY seed_id) AS last_end,
    max(score) OVER (PARTITION BY seed_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s1),
s3 AS (SELECT *, first_end IS NULL OR us <= first_end OR ends AS shown, before IS NULL OR score > before AS improved FROM s2),
states AS (SELECT seed_id, arg_max(request_id, us) AS request_id, arg_max(algorithm, us) AS rcl_algorithm, arg_max(classifier, us) AS classifier, arg_max(training, us) AS training_file_name, arg_max(search, us) FILTER (shown) AS local_search,
    arg_max(iteration, us) FILTER (shown) AS iteration_neighborhood, CASE WHEN bool_or(ends) THEN 'completed' ELSE 'running' END AS status, arg_max(stage, us) FILTER (shown) AS stage, arg_max(topic, us) FILTER (shown) AS topic,
    arg_max(score, us) FILTER (shown) AS current_score, max(score) AS best_score, round(coalesce((array_agg(before ORDER BY us DESC) FILTER (shown))[1], arg_min(before, us) FILTER (NOT shown AND us > last_end)), 6) AS previous_best,
    round(coalesce((array_agg(score - before ORDER BY us DESC) FILTER (shown))[1], arg_min(score - before, us) FILTER (NOT shown AND us > last_end AND before IS NOT NULL)), 6) AS delta, arg_max(improved, us) FILTER (shown) AS improved,
    arg_max(cpu, us) AS cpu_usage, max(last_end) AS completed_us, count(*) AS updates, count(*) FILTER (topic <> 'LOCAL_SEARCH_PROGRESS_TOPIC') AS history_count, arg_max(features, us) FILTER (shown) AS features FROM s3 GROUP BY seed_id)"""


def launches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver's orders in the shape of launch requests."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    o = table(spark, sf_dir, "orders")
    start = F.timestamp_micros(F.lit(1_704_067_200_000_000) + (F.col("o_orderkey") % 43_200) * 60_000_000)
    pick = lambda n: F.element_at(F.array(*map(F.lit, ("IG", "GR", "RF", "SU"))), (n % 4 + 1).cast("int"))
    name = lambda role: F.concat(F.lit(f"{role}-"), (F.col("o_custkey") % 3).cast("string"), F.lit(".arff"))
    return o.select(
        F.col("o_orderkey").alias("launch_id"), F.concat(F.lit("req-"), (F.col("o_custkey") % 10).cast("string")).alias("request_id"),
        F.when(F.col("o_orderstatus") == "O", "queued").otherwise("started").alias("state"), (start - F.expr("INTERVAL 30 SECONDS")).alias("requested_at"),
        F.when(F.col("o_orderstatus") != "O", start).alias("started_at"), F.array(pick(F.col("o_custkey")), pick(F.col("o_custkey") + 1)).alias("algorithms"),
        name("train").alias("training_file_name"), name("test").alias("testing_file_name"), (F.col("o_orderkey") % 5 + 1).alias("generations"),
        F.when(F.col("o_orderkey") % 7 > 0, F.element_at(F.array(F.lit("J48"), F.lit("NB")), (F.col("o_custkey") % 5 % 2 + 1).cast("int"))).alias("classifier"), F.col("o_custkey").alias("requested_by"),
    )


def _query(name: str, sql: str | None = None, ctes: str = _EV):
    def keep(make: Query) -> Query:
        QUERIES[name] = make
        if sql:
            ORACLE_SQL[name] = f"WITH {ctes} {sql}" if ctes else sql
        return make

    return keep


def _ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eventlog.of_events(spark, sf_dir)


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.fold_runs(_ev(spark, sf_dir))


def _us(df: DataFrame, *names: str) -> DataFrame:
    """Timestamps as epoch microseconds under the name of the column with _us for _at."""
    return df.select(*(F.unix_micros(c).alias(c.replace("_at", "_us")) if c in names else F.col(c) for c in df.columns))


def _on_events(name: str, op: Callable[[DataFrame], DataFrame], sql: str | None, ctes: str = _EV) -> None:
    _query(name, sql, ctes)(lambda s, d: op(_ev(s, d)))


_A = "round(avg({0}), 6) AS {1}".format
_on_events("overview", monitor.overview, f"SELECT count(*) AS events, count(DISTINCT seed_id) AS seeds, count(DISTINCT topic) AS topics, {_A('CASE WHEN topic = $$INITIAL_SOLUTION_TOPIC$$ THEN score END', 'avg_initial')} FROM ev")
_on_events("topic_metrics", monitor.topic_metrics, f"SELECT topic, count(*) AS n, count(DISTINCT seed_id) AS seeds, {_A('score', 'avg_score')}, max(score) AS best_score FROM ev GROUP BY topic")
_BUCKET = f"count(*) AS n, count(DISTINCT seed_id) AS seeds, {_A('score', 'avg_score')}, {_A('cpu', 'avg_cpu')}, {_A('memp', 'avg_memory_percent')}, max(score) AS best_score"
_on_events("hourly_activity", lambda e: monitor.activity(e, 3600, 336), f"SELECT us // 3600000000 * 3600 AS bucket, {_BUCKET} FROM ev GROUP BY 1 ORDER BY 1 DESC LIMIT 336")
_on_events("minute_activity", lambda e: monitor.activity(e, 60, None), f"SELECT us // 60000000 * 60 AS bucket, {_BUCKET} FROM ev GROUP BY 1")
_RES = f"count(*) AS samples, {_A('cpu', 'avg_cpu')}, {_A('mem', 'avg_memory')}, {_A('memp', 'avg_memory_percent')}"
_on_events("resource_by_algorithm", monitor.resources_by_algorithm, f"SELECT algorithm AS rcl_algorithm, {_RES} FROM ev WHERE topic = 'INITIAL_SOLUTION_TOPIC' GROUP BY 1")
_on_events("resource_by_search", monitor.resources_by_search, f"SELECT search AS local_search, {_RES} FROM ev WHERE topic IN ('LOCAL_SEARCH_PROGRESS_TOPIC', 'SOLUTIONS_TOPIC') GROUP BY 1")
_on_events("initial_latest_per_seed", lambda e: _us(monitor.initial_latest(e).select("seed_id", "event_id", "created_at", "score", "rcl_algorithm"), "created_at"), "SELECT seed_id, event_id, us AS created_us, score, algorithm AS rcl_algorithm FROM initial", f"{_EV}, {_INITIAL}")
_on_events("initial_seed_count", monitor.initial_counts, "SELECT algorithm AS rcl_algorithm, count(*) AS initial_seeds FROM initial GROUP BY 1", f"{_EV}, {_INITIAL}")
_RUN_COLUMNS = ["seed_id", "request_id", "topic", "rcl_algorithm", "local_search", "neighborhood", "current_score", "best_score", "created_at", "updated_at", "updates", "completed"]
_query("run_fold", "SELECT seed_id, request_id, topic, algorithm AS rcl_algorithm, search AS local_search, strategy AS neighborhood, current_score, best_score, created_us, updated_us, updates, completed FROM runs", f"{_EV}, {_RUNS}")(
    lambda s, d: _us(_runs(s, d).select(*_RUN_COLUMNS), "created_at", "updated_at")
)
_query(
    "final_run_summary",
    "SELECT r.algorithm, count(*) AS seeds, max(r.best_score) AS best_score, (array_agg(r.seed_id ORDER BY r.best_score DESC, r.updated_us DESC, r.seed_id DESC))[1] AS best_seed, round(avg(r.best_score), 6) AS avg_final, round(avg(r.best_score - i.score), 6) AS avg_gain, "
    "array_to_string(list_sort(list_distinct(array_agg(r.search))), ',') AS searches, array_to_string(list_sort(list_distinct(array_agg(r.training || '|' || r.testing))), ',') AS datasets FROM runs r LEFT JOIN initial i USING (seed_id) GROUP BY 1",
    f"{_EV}, {_INITIAL}, {_RUNS}",
)(lambda s, d: monitor.final_summary(_runs(s, d)))
_query(
    "dls_outcome_summary",
    "SELECT t.search AS local_search, count(DISTINCT t.seed_id) AS seeds, count(DISTINCT CASE WHEN r.search = t.search THEN t.seed_id END) AS won_seeds, max(t.score) AS best_score, round(avg(t.score), 6) AS avg_score, round(avg(t.score - i.score), 6) AS avg_gain "
    "FROM (SELECT *, row_number() OVER (PARTITION BY seed_id, search ORDER BY score DESC NULLS LAST, us DESC, event_id DESC) AS rk2 FROM ev WHERE topic IN ('LOCAL_SEARCH_PROGRESS_TOPIC', 'SOLUTIONS_TOPIC')) t LEFT JOIN initial i USING (seed_id) LEFT JOIN runs r USING (seed_id) WHERE t.rk2 = 1 GROUP BY 1",
    f"{_EV}, {_INITIAL}, {_RUNS}",
)(lambda s, d: monitor.search_outcomes(_ev(s, d), _runs(s, d)))
_TL = f"count(*) AS n, count(DISTINCT seed_id) AS seeds, arg_max(score, us) AS latest_score, arg_max(stage, us) AS latest_stage, {_A('score', 'avg_score')}, max(score) AS best_score, {_A('cpu', 'avg_cpu')}, {_A('memp', 'avg_memory_percent')}, max(request_id) AS request_id, max(algorithm) AS algorithm"
_on_events("timeline_seed", lambda e: monitor.timeline(e, ["seed_id"], 3600), f"SELECT seed_id, us // 3600000000 * 3600 AS bucket, {_TL} FROM st GROUP BY 1, 2")
_on_events("timeline_algorithm", lambda e: monitor.timeline(e, ["rcl_algorithm"], 60), f"SELECT st.algorithm AS rcl_algorithm, us // 60000000 * 60 AS bucket, {_TL.replace('max(algorithm)', 'max(st.algorithm)')} FROM st GROUP BY 1, 2")
_on_events("timeline_overview", lambda e: monitor.timeline(e, [], 60), f"SELECT us // 60000000 * 60 AS bucket, {_TL.replace('max(algorithm)', 'max(st.algorithm)')} FROM st GROUP BY 1")
_on_events(
    "timelines", monitor.timelines,
    f"SELECT 'seed' AS scope, seed_id, CAST(NULL AS VARCHAR) AS rcl_algorithm, us // 3600000000 * 3600 AS bucket, {_TL} FROM st GROUP BY seed_id, bucket UNION ALL "
    f"SELECT 'algorithm', NULL, st.algorithm, us // 60000000 * 60 AS bucket, {_TL.replace('max(algorithm)', 'max(st.algorithm)')} FROM st GROUP BY st.algorithm, bucket UNION ALL "
    f"SELECT 'overview', NULL, NULL, us // 60000000 * 60 AS bucket, {_TL.replace('max(algorithm)', 'max(st.algorithm)')} FROM st GROUP BY bucket",
)
_on_events(
    "feed_options", lambda e: feed.count(e, feed.Filters.of({"topics": " SOLUTIONS_TOPIC,,BEST_SOLUTION_TOPIC ", "status": "completed", "datasetKey": "train-1.arff|--", "start": "2024-01-03T00:00:00Z", "end": "not a time", "minF1Score": "10", "maxF1Score": "", "query": " IWSS "})),
    "SELECT count(*) AS n FROM st WHERE topic IN ('SOLUTIONS_TOPIC', 'BEST_SOLUTION_TOPIC') AND status = 'completed' AND training = 'train-1.arff' AND us >= epoch_us(TIMESTAMP '2024-01-03 00:00:00') AND score >= 10 AND (lower(search) LIKE '%iwss%' OR lower(stage) LIKE '%iwss%')",
)
_on_events("run_timeline", lambda e: monitor.run_timeline(e, "7", 3600, 240), f"SELECT *, row_number() OVER (ORDER BY bucket) AS place FROM (SELECT seed_id, us // 3600000000 * 3600 AS bucket, {_TL} FROM st WHERE seed_id = '7' GROUP BY 1, 2 ORDER BY bucket DESC LIMIT 240)")
_DELTA = "dl AS (SELECT *, max(score) OVER (PARTITION BY seed_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_best FROM ev WHERE score IS NOT NULL)"
_on_events("score_deltas", lambda e: monitor.score_deltas(e).select("event_id", "seed_id", "previous_best", "delta", "improved"), "SELECT event_id, seed_id, previous_best, round(score - previous_best, 6) AS delta, previous_best IS NULL OR score > previous_best AS improved FROM dl", f"{_EV}, {_DELTA}")
_on_events("improvements", lambda e: monitor.improvements(e).select("event_id", "seed_id", "score", "delta"), "SELECT event_id, seed_id, score, round(score - previous_best, 6) AS delta FROM dl WHERE score > previous_best", f"{_EV}, {_DELTA}")
_on_events("newest_improvements", lambda e: monitor.improvements(e, 8).select("event_id", "seed_id", "score", "delta"), "SELECT event_id, seed_id, score, round(score - previous_best, 6) AS delta FROM dl WHERE score > previous_best ORDER BY us DESC, event_id DESC LIMIT 8", f"{_EV}, {_DELTA}")
_on_events(
    "verified_best", lambda e: _us(monitor.verified_best(e).select("event_id", "seed_id", "created_at", "score"), "created_at"),
    "SELECT event_id, seed_id, us AS created_us, score FROM (SELECT *, max(score) OVER (PARTITION BY seed_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM ev WHERE topic = 'SOLUTIONS_TOPIC') WHERE prior IS NULL OR score > prior",
)
_on_events("elapsed", lambda e: monitor.elapsed(e).select("event_id", "elapsed"), "SELECT event_id, (us - min(us) OVER (PARTITION BY seed_id)) // 1000000 AS elapsed FROM ev")
_on_events("newest_per_seed", lambda e: monitor.newest_per(e, ["seed_id"], 5).select("seed_id", "event_id", F.col("place").cast("long").alias("place")), "SELECT * FROM (SELECT seed_id, event_id, row_number() OVER (PARTITION BY seed_id ORDER BY us DESC, event_id DESC) AS place FROM ev) WHERE place <= 5")
_query("source_watermark", "SELECT max(us) AS newest, count(*) AS events, (SELECT count(*) FROM runs) AS runs FROM ev", f"{_EV}, {_RUNS}")(lambda s, d: monitor.watermark(_ev(s, d), _runs(s, d)))
_FILTERS = feed.Filters(topics=[S.SOLUTIONS, S.BEST], algorithm="GR", least_score=10.0, greatest_score=400.0, text="iwss")
_WHERE = "topic IN ('SOLUTIONS_TOPIC', 'BEST_SOLUTION_TOPIC') AND algorithm = 'GR' AND score >= 10 AND score <= 400 AND (lower(search) LIKE '%iwss%' OR lower(stage) LIKE '%iwss%' OR lower(topic) LIKE '%iwss%')"
_on_events("feed_page", lambda e: _us(feed.page(e, _FILTERS, 2, 25).select("event_id", "created_at", "score"), "created_at"), f"SELECT event_id, us AS created_us, score FROM st WHERE {_WHERE} ORDER BY us DESC, event_id DESC LIMIT 25 OFFSET 25")
_on_events("feed_count", lambda e: feed.count(e, _FILTERS), f"SELECT count(*) AS n FROM st WHERE {_WHERE}")
_on_events("feed_export", lambda e: feed.export(e, _FILTERS).select("event_id", "score"), f"SELECT event_id, score FROM st WHERE {_WHERE} ORDER BY us DESC, event_id DESC LIMIT 50000")
_on_events("free_text_search", lambda e: e.where(feed.free_text("t_f_ip")).groupBy("local_search").agg(F.count("*").alias("n")), "SELECT search AS local_search, count(*) AS n FROM st WHERE lower(search) LIKE '%t_f_ip%' OR lower(stage) LIKE '%t_f_ip%' GROUP BY 1")
_on_events("time_range", lambda e: feed.anchored(e, 24).agg(F.count("*").alias("n"), F.min(monitor.micros()).alias("first_us")), "SELECT count(*) AS n, min(us) AS first_us FROM ev WHERE us >= (SELECT max(us) FROM ev) - 86400000000")
_on_events(
    "event_dedup", lambda e: monitor.deduplicate(e.where("event_id % 3 = 0").withColumn("score", F.col("score") + 1000), e.where("event_id % 2 = 0").unionByName(e.where("event_id % 4 = 0").withColumn("score", F.lit(-1.0)).withColumn("created_at", F.col("created_at") - F.expr("INTERVAL 1 DAY"))), ["event_id"]).select("event_id", "topic", "score"),
    "SELECT event_id, topic, CASE WHEN event_id % 3 = 0 THEN score + 1000 ELSE score END AS score FROM ev WHERE event_id % 3 = 0 OR event_id % 2 = 0",
)
_on_events(
    "preferred_event", lambda e: monitor.preferred(e, ["seed_id"], labels.topic_priority(F.col("topic"))).select("seed_id", "event_id", "score"),
    "SELECT seed_id, event_id, score FROM (SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY CASE WHEN topic IN ('BEST_SOLUTION_TOPIC', 'SOLUTIONS_TOPIC') THEN 2 WHEN topic = 'LOCAL_SEARCH_PROGRESS_TOPIC' THEN 1 ELSE 0 END DESC, score DESC NULLS LAST, us DESC, event_id DESC) AS rk FROM ev) WHERE rk = 1",
)
_PRIORITY = "CASE WHEN topic IN ('BEST_SOLUTION_TOPIC', 'SOLUTIONS_TOPIC') THEN 2 WHEN topic = 'LOCAL_SEARCH_PROGRESS_TOPIC' THEN 1 ELSE 0 END"
_HALF = "(SELECT seed_id, arg_max(topic, us) AS topic, max(score) AS best_score, max(us) AS us, '{1}' AS source FROM ev WHERE {0} GROUP BY 1)".format
_query(
    "merge_runs", f"SELECT seed_id, topic, best_score, source FROM (SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY {_PRIORITY} DESC, best_score DESC, us DESC, source) AS rk FROM ({_HALF('event_id % 3 > 0', 'stored')} UNION ALL {_HALF('event_id % 2 = 0 AND event_id % 7 < 4', 'live')})) WHERE rk = 1"
)(lambda s, d: runs.merge_runs(*(monitor.fold_runs(_ev(s, d).where(some)).withColumn("source", F.lit(name)) for some, name in (("event_id % 3 > 0", "stored"), ("event_id % 2 = 0 AND event_id % 7 < 4", "live")))).select("seed_id", "topic", "best_score", "source"))
_on_events(
    "seed_lifecycle", lambda e: runs.lifecycle(e, F.lit(2), F.lit(3)),
    "SELECT seed_id, arg_max(terminal, us) AS completed, count(*) FILTER (terminal) AS terminals, count(*) FILTER (processing) AS processings, max(CASE WHEN terminal THEN us END) AS last_terminal FROM (SELECT *, CASE WHEN topic IN ('INITIAL_SOLUTION_TOPIC', 'NEIGHBORHOOD_RESTART_TOPIC') THEN true "
    "WHEN topic = 'LOCAL_SEARCH_PROGRESS_TOPIC' THEN status <> 'completed' WHEN topic = 'SOLUTIONS_TOPIC' THEN NOT terminal ELSE false END AS processing FROM (SELECT *, topic = 'SOLUTIONS_TOPIC' AND iteration >= CASE WHEN strategy = 'VND' THEN 6 ELSE 2 END AS terminal FROM ev)) WHERE terminal OR processing GROUP BY 1",
)
_on_events("stage_distribution", runs.stage_distribution, "SELECT CASE topic WHEN 'INITIAL_SOLUTION_TOPIC' THEN 'initial' WHEN 'SOLUTIONS_TOPIC' THEN 'local_final' ELSE 'best' END AS stage, count(*) AS n FROM ev WHERE topic IN ('INITIAL_SOLUTION_TOPIC', 'SOLUTIONS_TOPIC', 'BEST_SOLUTION_TOPIC') GROUP BY 1")
_query("feature_frequency", "SELECT feature, count(*) AS n FROM (SELECT unnest(list_distinct(features)) AS feature FROM runs) GROUP BY 1 ORDER BY n DESC, feature LIMIT 10", f"{_EV}, {_RUNS}")(lambda s, d: runs.feature_frequency(_runs(s, d)))
_query("shared_features", "SELECT feature FROM (SELECT unnest(list_distinct(features)) AS feature FROM runs WHERE list_contains(features, 3)) GROUP BY 1 HAVING count(*) = (SELECT count(*) FROM runs WHERE list_contains(features, 3))", f"{_EV}, {_RUNS}")(
    lambda s, d: runs.shared_features(_runs(s, d).where(F.array_contains("solution_features", 3)))
)
_query("rcl_complement", "SELECT seed_id, array_to_string(list_filter(range(1, len(rcl) + len(features) + 1), lambda x: NOT list_contains(features, x)), ',') AS complement FROM runs", f"{_EV}, {_RUNS}")(lambda s, d: runs.rcl_complement(_runs(s, d)).select("seed_id", F.array_join("complement", ",").alias("complement")))
_query(
    "run_compare",
    "SELECT c.*, coalesce(f.shared, 0) AS shared FROM (SELECT training AS training_file_name, count(*) AS runs, (array_agg(seed_id ORDER BY best_score DESC, updated_us DESC, seed_id DESC))[1] AS best_seed, round(max(best_score) - min(best_score), 6) AS spread, count(DISTINCT algorithm) AS algorithms, "
    "count(DISTINCT strategy) AS strategies, count(DISTINCT search) AS searches, count(DISTINCT training || '|' || testing) AS pairs FROM runs GROUP BY 1) c LEFT JOIN (SELECT training, count(*) AS shared FROM (SELECT training, feature, count(*) AS n FROM (SELECT training, unnest(list_distinct(features)) AS feature FROM runs) GROUP BY 1, 2) x "
    "JOIN (SELECT training, count(*) AS m FROM runs GROUP BY 1) y USING (training) WHERE n = m GROUP BY 1) f ON f.training = c.training_file_name",
    f"{_EV}, {_RUNS}",
)(lambda s, d: runs.run_compare(_runs(s, d), ["training_file_name"]))
_query("next_launch", "SELECT launch_id, started_us, next_us AS next_started_us FROM nxt", f"{_LAUNCH}, {_NEXT}")(lambda s, d: _us(runs.next_started(launches(s, d)).select("launch_id", "started_at", "next_started_at"), "started_at", "next_started_at"))
_query("launch_runs", "SELECT launch_id, seed_id, best_score FROM matched", f"{_EV}, {_RUNS}, {_LAUNCH}, {_NEXT}, {_MATCH}")(lambda s, d: runs.launch_runs(launches(s, d), _runs(s, d)).select("launch_id", "seed_id", "best_score"))
_query(
    "launch_progress",
    "SELECT launch_id, expected, observed, done, greatest(expected - done, 0) AS pending, CASE WHEN done >= expected THEN 'completed' WHEN observed > 0 THEN 'monitoring' ELSE 'dispatched' END AS state FROM (SELECT l.launch_id, len(l.algorithms) * l.generations AS expected, count(m.seed_id) AS observed, "
    "count(*) FILTER (m.completed) AS done FROM launch l LEFT JOIN matched m USING (launch_id) WHERE l.started_us IS NOT NULL GROUP BY l.launch_id, l.algorithms, l.generations)",
    f"{_EV}, {_RUNS}, {_LAUNCH}, {_NEXT}, {_MATCH}",
)(lambda s, d: runs.launch_progress(launches(s, d), _runs(s, d)).select("launch_id", "expected", "observed", "done", "pending", "state"))
_query("queue_position", "SELECT launch_id, row_number() OVER (ORDER BY requested_us, launch_id) AS place FROM launch WHERE state = 'queued'", _LAUNCH)(lambda s, d: runs.queue_position(launches(s, d)).select("launch_id", F.col("place").cast("long").alias("place")))
_WITHIN = "e.us >= l.requested_us AND (l.next_us IS NULL OR e.us < l.next_us)"
_query(
    "launch_events", f"SELECT launch_id, count(*) AS events, min(event_id) AS first_event FROM (SELECT l.launch_id, e.event_id FROM nxt l JOIN ev e USING (request_id) WHERE {_WITHIN} UNION SELECT l.launch_id, e.event_id FROM nxt l JOIN matched m USING (launch_id) JOIN ev e ON e.seed_id = m.seed_id WHERE {_WITHIN}) GROUP BY 1",
    f"{_EV}, {_RUNS}, {_LAUNCH}, {_NEXT}, {_MATCH}",
)(lambda s, d: runs.launch_event_counts(launches(s, d), _ev(s, d), runs.launch_runs(launches(s, d), _runs(s, d)).select("launch_id", "seed_id")))
_query("launch_users", "SELECT launch_id, c_name AS user_name, lower(c_mktsegment) AS user_role FROM launch LEFT JOIN customer ON c_custkey = requested_by AND c_custkey % 2 = 0", _LAUNCH)(
    lambda s, d: runs.launch_users(launches(s, d), table(s, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"), F.lit(None).cast("string").alias("mail"), F.lower("c_mktsegment").alias("role"))).select("launch_id", "user_name", "user_role")
)


def _dispatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = launches(spark, sf_dir).withColumn("request_id", F.concat(F.lit("r"), F.floor(F.col("launch_id") / 4).cast("string")))
    return runs.gateway_dispatches(asked.where("launch_id % 2 = 0"), asked.where("launch_id % 3 = 0"))


_GATEWAY = "gateway AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request ORDER BY fresh DESC, requested_us DESC, launch_id DESC) AS rk FROM (SELECT *, 'r' || CAST(launch_id // 4 AS VARCHAR) AS request, 0 AS fresh FROM launch WHERE launch_id % 2 = 0 UNION ALL SELECT *, 'r' || CAST(launch_id // 4 AS VARCHAR), 1 FROM launch WHERE launch_id % 3 = 0)) WHERE rk = 1)"
_query("gateway_events", "SELECT 'gateway:' || request AS fingerprint, 'gateway.dispatch' AS event_type, 'API_GATEWAY' AS topic, 'REQUESTED' AS status, launch_id, requested_us AS created_us FROM gateway", f"{_LAUNCH}, {_GATEWAY}")(
    lambda s, d: _us(runs.gateway_events(_dispatches(s, d)).drop("request_id"), "created_at")
)
_query(
    "dataset_usage", "SELECT name, count(r.seed_id) AS runs, max(r.best_score) AS best_score FROM (SELECT DISTINCT training AS name FROM launch UNION SELECT DISTINCT testing FROM launch) f LEFT JOIN runs r ON r.training = f.name OR r.testing = f.name GROUP BY 1", f"{_EV}, {_RUNS}, {_LAUNCH}"
)(lambda s, d: runs.dataset_usage(launches(s, d).select(F.explode(F.array("training_file_name", "testing_file_name")).alias("name")).distinct(), _runs(s, d)))


@_query(
    "research_summary",
    "SELECT r.*, g.*, rc.*, ne.events, dp.max_history_depth, q.requests, u.unique_features, round(g.runs_with_history / r.runs, 6) AS history_coverage, round(r.runs_with_telemetry / r.runs, 6) AS telemetry_coverage, round(g2.n / r.runs, 6) AS avg_history_depth, CAST(round((o.hi - o.lo) / 1000000.0, 0) AS BIGINT) AS observation_seconds, "
    "CAST(round((h.at - o.lo) / 1000000.0, 0) AS BIGINT) AS seconds_to_high_quality FROM (SELECT count(*) AS runs, count(DISTINCT training || '|' || testing) AS dataset_pairs, count(*) FILTER (best_score >= 95) AS high_quality_runs, round(count(*) FILTER (best_score >= 95) / count(*), 6) AS high_quality_ratio, max(best_score) AS best_score, "
    "(array_agg(seed_id ORDER BY best_score DESC, updated_us DESC, seed_id DESC))[1] AS best_seed, count(*) AS runs_with_telemetry, round(avg(len(features)), 6) AS avg_solution_size, round(avg(len(rcl)), 6) AS avg_rcl_size, array_to_string(list_sort(list_distinct(array_agg(search))), ',') AS searches, "
    "array_to_string(list_sort(list_distinct(array_agg(strategy))), ',') AS strategies FROM runs) r, (SELECT count(*) FILTER (delta > 0) AS improvements, round(avg(delta) FILTER (delta > 0), 6) AS avg_improvement, max(delta) FILTER (delta > 0) AS max_improvement, count(DISTINCT seed_id) AS runs_with_history "
    "FROM (SELECT *, round(score - previous_best, 6) AS delta FROM dl)) g, (SELECT count(*) AS n FROM dl) g2, (SELECT count(DISTINCT request_id) AS requests FROM ev) q, (SELECT count(DISTINCT f) AS unique_features FROM (SELECT unnest(features) AS f FROM runs)) u, (SELECT min(us) AS lo, max(us) AS hi FROM ev) o, (SELECT min(us) AS at FROM dl WHERE score >= 95) h, (SELECT count(*) AS events FROM ev) ne, (SELECT max(n) AS max_history_depth FROM (SELECT count(*) AS n FROM dl GROUP BY seed_id)) dp, "
    "(SELECT count(*) FILTER (topic = 'BEST_SOLUTION_TOPIC') AS best_solutions, count(*) FILTER (completed) AS completed_runs, count(*) FILTER (NOT completed) AS active_runs, count(DISTINCT algorithm) AS algorithms, CAST(NULL AS DOUBLE) AS avg_enabled_searches FROM runs) rc",
    f"{_EV}, {_RUNS}, {_DELTA}",
)
def research_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _ev(spark, sf_dir)
    history = monitor.score_deltas(events).select("seed_id", "request_id", F.col("created_at").alias("at"), "score", "delta", "improved")
    return runs.research_summary(_runs(spark, sf_dir), history, events.select("request_id", F.col("created_at").alias("at"), "score"))


_on_events(
    "payload_extraction",
    lambda e: eventlog.from_payload(eventlog.stored(e)).groupBy("topic", "local_search", "training_file_name").agg(F.count("*").alias("n"), F.countDistinct("seed_id").alias("seeds"), monitor.mean("score").alias("avg_score"), monitor.mean("cpu_usage").alias("avg_cpu"), F.sum(F.size("solution_features")).alias("features"), F.max("iteration_neighborhood").alias("iteration")),
    f"SELECT topic, search AS local_search, training AS training_file_name, count(*) AS n, count(DISTINCT seed_id) AS seeds, {_A('score', 'avg_score')}, {_A('cpu', 'avg_cpu')}, CAST(sum(len(features)) AS BIGINT) AS features, max(iteration) AS iteration FROM ev GROUP BY 1, 2, 3",
)
_on_events(
    "payload_topic_metrics", lambda e: monitor.topic_metrics(eventlog.from_payload(eventlog.stored(e))),
    f"SELECT topic, count(*) AS n, count(DISTINCT seed_id) AS seeds, {_A('score', 'avg_score')}, max(score) AS best_score FROM ev GROUP BY topic",
)

_query("runs_with_events", "SELECT seed_id, array_to_string(list_slice(array_agg(event_id ORDER BY us DESC, event_id DESC), 1, 3), ',') AS newest FROM ev GROUP BY 1")(
    lambda s, d: views.runs_with_events(_runs(s, d), _ev(s, d), 3).select("seed_id", F.array_join(F.transform("history", lambda x: x["event_id"].cast("string")), ",").alias("newest"))
)
_SOLVED = "solved AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY score DESC NULLS LAST, us DESC, event_id DESC) AS rk FROM ev WHERE topic = 'BEST_SOLUTION_TOPIC') WHERE rk = 1)"
_on_events("best_events", lambda e: _us(views.best_events(e).select("seed_id", "best_score", "local_search", "updated_at"), "updated_at"), "SELECT seed_id, score AS best_score, search AS local_search, us AS updated_us FROM solved", f"{_EV}, {_SOLVED}")
_query("run_with_best_event", "SELECT seed_id, coalesce(s.score, r.best_score) AS shown_score FROM runs r LEFT JOIN solved s USING (seed_id)", f"{_EV}, {_RUNS}, {_SOLVED}")(lambda s, d: views.latest_and_best(_runs(s, d), _ev(s, d)).select("seed_id", "shown_score"))
_query("events_of_seeds", "SELECT count(*) AS n FROM ev WHERE seed_id IN (SELECT seed_id FROM runs WHERE best_score > 400)", f"{_EV}, {_RUNS}")(lambda s, d: views.of_seeds(_ev(s, d), _runs(s, d).where("best_score > 400")).agg(F.count("*").alias("n")))
_on_events(
    "workflow_steps", lambda e: views.workflow_steps(e).select("seed_id", F.array_join("steps", " > ").alias("steps")),
    "SELECT a.seed_id, 'RCL ' || a.rcl || ' > ' || a.strategy || coalesce(' > ' || b.searches, '') || CASE WHEN a.solved THEN ' > BEST' ELSE '' END AS steps FROM (SELECT seed_id, arg_max(algorithm, us) AS rcl, arg_max(strategy, us) AS strategy, bool_or(topic = 'BEST_SOLUTION_TOPIC') AS solved FROM ev GROUP BY 1) a "
    "LEFT JOIN (SELECT seed_id, string_agg(search, ' > ' ORDER BY first_us) AS searches FROM (SELECT seed_id, search, min(us) AS first_us FROM ev WHERE topic IN ('LOCAL_SEARCH_PROGRESS_TOPIC', 'SOLUTIONS_TOPIC') GROUP BY 1, 2) GROUP BY 1) b USING (seed_id)",
)
_query("chart_ranking", "SELECT seed_id, best_score FROM runs JOIN (SELECT seed_id, count(*) AS depth FROM ev GROUP BY 1) USING (seed_id) ORDER BY seed_id = '7' DESC, completed DESC, best_score DESC, depth DESC, updated_us DESC, seed_id LIMIT 8", f"{_EV}, {_RUNS}")(
    lambda s, d: views.chart_ranking(_runs(s, d), _ev(s, d), "7").select("seed_id", "best_score")
)
_on_events("workspace_selection", lambda e: e.where(views.selection("IG", "train-1.arff|test-1.arff", "local", "running", "iwss")).agg(F.count("*").alias("n")), "SELECT count(*) AS n FROM ev WHERE algorithm = 'IG' AND training = 'train-1.arff' AND topic IN ('LOCAL_SEARCH_PROGRESS_TOPIC', 'SOLUTIONS_TOPIC') AND status = 'running' AND search = 'IWSS'")
_on_events("time_text", lambda e: e.where(views.time_text("2024-01-02T03")).agg(F.count("*").alias("n")), "SELECT count(*) AS n FROM ev WHERE strftime(make_timestamp(us), '%Y-%m-%dT%H') = '2024-01-02T03'")
_LIVE = "live AS (SELECT * FROM ev ORDER BY us DESC, event_id DESC LIMIT 300)"
_on_events("live_topics", lambda e: views.live_projection(e)[0], f"SELECT topic, count(*) AS n, count(DISTINCT seed_id) AS seeds, {_A('score', 'avg_score')}, max(score) AS best_score FROM live GROUP BY 1", f"{_EV}, {_LIVE}")
_on_events("live_activity", lambda e: views.live_projection(e)[1], f"SELECT us // 60000000 * 60 AS bucket, {_BUCKET} FROM live GROUP BY 1", f"{_EV}, {_LIVE}")
_on_events("initial_by_algorithm", views.by_initial_algorithm, f"SELECT algorithm AS rcl_algorithm, count(DISTINCT seed_id) AS seeds, {_A('score', 'avg_score')}, max(score) AS best_score FROM ev WHERE topic = 'INITIAL_SOLUTION_TOPIC' GROUP BY 1")
_on_events(
    "improvement_summary", views.improvement_summary,
    "SELECT count(*) AS improvements, max(d) AS strongest, (array_agg(seed_id ORDER BY d DESC, us DESC, event_id DESC))[1] AS strongest_seed, (array_agg(seed_id ORDER BY us DESC, event_id DESC))[1] AS latest_seed FROM (SELECT *, round(score - previous_best, 6) AS d FROM dl WHERE score > previous_best)", f"{_EV}, {_DELTA}",
)
_query("queue_counts", "SELECT state, count(*) AS launches FROM launch GROUP BY 1", _LAUNCH)(lambda s, d: views.queue_counts(launches(s, d)))
_query(
    "launch_view",
    "SELECT l.launch_id, q.place, coalesce(p.expected, 0) AS expected, coalesce(p.observed, 0) AS observed, coalesce(p.done, 0) AS done, coalesce(greatest(p.expected - p.done, 0), 0) AS pending, CASE WHEN p.launch_id IS NULL THEN l.state WHEN p.done >= p.expected THEN 'completed' WHEN p.observed > 0 THEN 'monitoring' ELSE 'dispatched' END AS state, "
    "coalesce(p.done >= p.expected, false) AS pipeline_completed, l.state = 'queued' AS can_cancel FROM launch l LEFT JOIN (SELECT launch_id, row_number() OVER (ORDER BY requested_us, launch_id) AS place FROM launch WHERE state = 'queued') q USING (launch_id) "
    "LEFT JOIN (SELECT l.launch_id, len(l.algorithms) * l.generations AS expected, count(m.seed_id) AS observed, count(*) FILTER (m.completed) AS done FROM launch l LEFT JOIN matched m USING (launch_id) WHERE l.started_us IS NOT NULL GROUP BY l.launch_id, l.algorithms, l.generations) p ON p.launch_id = l.launch_id",
    f"{_EV}, {_RUNS}, {_LAUNCH}, {_NEXT}, {_MATCH}",
)(
    lambda s, d: views.launch_view(launches(s, d), runs.queue_position(launches(s, d)), runs.launch_progress(launches(s, d), _runs(s, d))).select(
        "launch_id", F.col("place").cast("long").alias("place"), "expected", "observed", "done", "pending", "state", "pipeline_completed", "can_cancel"
    )
)
_STATE_COLUMNS = ["seed_id", "request_id", "rcl_algorithm", "classifier", "training_file_name", "local_search", "iteration_neighborhood", "status", "stage", "topic", "current_score", "best_score", "previous_best", "delta", "improved", "cpu_usage", "completed_at", "updates", "history_count"]


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_states(_ev(spark, sf_dir), F.lit(2), F.lit(3))


_query("run_states", f"SELECT {', '.join(c.replace('_at', '_us') if c == 'completed_at' else c for c in _STATE_COLUMNS)} FROM states", f"{_EV}, {_STATES}")(lambda s, d: _us(_states(s, d).select(*_STATE_COLUMNS), "completed_at"))


def _listed(column: str, name: str) -> Column:
    """An array as text."""
    return F.array_join(F.col(column).cast("array<string>"), "|").alias(name)


_ENTRY_SQL = (
    "event_id, seed_id, request_id, topic, stage, score, CASE WHEN event_id % 3 = 0 THEN round(score - cpu, 6) END AS previous_best, CASE WHEN event_id % 3 = 0 THEN cpu END AS delta, CASE WHEN event_id % 3 = 0 THEN cpu > 0 END AS improved, "
    "CASE WHEN event_id % 3 = 0 THEN 2 ELSE 3 END AS solution_size, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 2 END AS rcl_size, CASE WHEN event_id % 3 = 0 THEN CAST(rcl[1] AS VARCHAR) ELSE array_to_string(rcl, '|') END AS rcl, search AS enabled, us AS created_us"
)
_on_events(
    "history_entries", lambda e: _us(eventlog.history_entries(eventlog.stored(e)).select("event_id", "seed_id", "request_id", "topic", "stage", "score", F.round("previous_best", 6).alias("previous_best"), "delta", "improved", "solution_size", "rcl_size", _listed("rcl_features", "rcl"), _listed("enabled_local_searches", "enabled"), "created_at"), "created_at"),
    f"SELECT {_ENTRY_SQL} FROM st",
)
_on_events(
    "feed_snapshots", lambda e: _us(eventlog.feed_snapshots(eventlog.stored(e)).select("event_id", "event_type", "seed_id", "request_id", "topic", "stage", "status", "rcl_algorithm", "classifier", "local_search", "neighborhood", "current_score", "best_score", "training_file_name", "testing_file_name", "iteration_neighborhood", "iteration_local_search", "delta", "memory_usage", "memory_usage_percent", "cpu_usage", _listed("solution_features", "features"), "created_at"), "created_at"),
    "SELECT event_id, CASE WHEN topic = 'LOCAL_SEARCH_PROGRESS_TOPIC' THEN 'kafka.progress' ELSE 'kafka.update' END AS event_type, seed_id, request_id, topic, stage, status, algorithm AS rcl_algorithm, classifier, search AS local_search, strategy AS neighborhood, score AS current_score, score AS best_score, training AS training_file_name, testing AS testing_file_name, "
    "iteration AS iteration_neighborhood, CAST(NULL AS INTEGER) AS iteration_local_search, CASE WHEN event_id % 3 = 0 THEN cpu END AS delta, mem AS memory_usage, memp AS memory_usage_percent, cpu AS cpu_usage, array_to_string(features, '|') AS features, us AS created_us FROM st",
)
_query(
    "history_snapshots", "SELECT h.event_id, h.seed_id, h.topic, h.stage, h.score AS current_score, h.score AS best_score, h.iteration AS iteration_neighborhood, CASE WHEN event_id % 3 = 0 THEN h.cpu ELSE s.delta END AS delta, CASE WHEN event_id % 3 = 0 THEN h.cpu > 0 ELSE s.improved END AS improved, s.rcl_algorithm, s.classifier, s.training_file_name, s.status FROM st h JOIN states s USING (seed_id)",
    f"{_EV}, {_STATES}",
)(lambda s, d: eventlog.history_snapshots(_states(s, d), eventlog.history_entries(eventlog.stored(_ev(s, d)))).select("event_id", "seed_id", "topic", "stage", "current_score", "best_score", "iteration_neighborhood", "delta", "improved", "rcl_algorithm", "classifier", "training_file_name", "status"))
_query("comparison_runs", "SELECT seed_id, best_score, least(count(*), 30) AS history_count FROM runs JOIN ev USING (seed_id) GROUP BY 1, 2", f"{_EV}, {_RUNS}")(
    lambda s, d: runs.comparison_runs(views.runs_with_events(_runs(s, d), _ev(s, d))).select("seed_id", "best_score", "history_count")
)
_query(
    "timeline_comparison", "SELECT seed_id, CASE WHEN seed_id = '7' THEN 0.5 WHEN user_id % 3 = 0 THEN best_score + 1 ELSE best_score END AS best_score, topic FROM (SELECT *, CAST(seed_id AS INTEGER) AS user_id FROM runs) WHERE user_id % 2 = 1", f"{_EV}, {_RUNS}"
)(
    lambda s, d: runs.timeline_comparison(
        _runs(s, d).where("CAST(seed_id AS INT) % 2 = 1").select("seed_id", "best_score", "topic"),
        _runs(s, d).where("CAST(seed_id AS INT) % 3 = 0").select("seed_id", (F.col("best_score") + 1).alias("best_score"), F.lit(None).cast("string").alias("topic")),
        _runs(s, d).where("seed_id = '7'").select("seed_id", F.lit(0.5).alias("best_score")),
    )
)
_query(
    "option_values",
    "SELECT 'algorithm' AS kind, algorithm AS value FROM ev UNION SELECT 'dataset', training || '|' || testing FROM ev UNION SELECT 'search', search FROM ev UNION SELECT 'search', strategy FROM ev UNION SELECT 'status', status FROM ev",
)(lambda s, d: runs.option_values(_runs(s, d).withColumn("status", F.lit(None).cast("string")), _ev(s, d)))
_query(
    "research_by_algorithm", f"SELECT algorithm, count(*) AS runs, max(best_score) AS best_score, (array_agg(seed_id ORDER BY best_score DESC, created_us, seed_id DESC))[1] AS best_seed, {_A('cpu', 'avg_cpu')}, {_A('memp', 'avg_memory_percent')} FROM runs GROUP BY 1", f"{_EV}, {_RUNS}"
)(lambda s, d: runs.research_by_algorithm(_runs(s, d)))
_query(
    "research_counts",
    "SELECT 'stage' AS kind, stage AS name, count(*) AS n, CAST(NULL AS DOUBLE) AS best_score FROM (SELECT seed_id, arg_max(stage, us) AS stage FROM st GROUP BY 1) GROUP BY 2 UNION ALL SELECT 'search', search, count(*), max(best_score) FROM runs GROUP BY 2 UNION ALL SELECT 'topic', topic, count(*), NULL FROM ev GROUP BY 2",
    f"{_EV}, {_RUNS}",
)(lambda s, d: runs.research_counts(_runs(s, d), _ev(s, d)))
_query(
    "first_high_quality", "SELECT least((SELECT min(us) FROM ev WHERE user_id % 2 = 0 AND score >= 480), (SELECT CASE WHEN s.created_us IS NULL OR s.created_us > r.created_us THEN r.updated_us END FROM (SELECT * FROM runs WHERE best_score >= 480 ORDER BY created_us, seed_id LIMIT 1) r "
    "LEFT JOIN (SELECT min(created_us) AS created_us FROM runs WHERE seed_id IN (SELECT seed_id FROM ev WHERE user_id % 2 = 0 AND score >= 480)) s ON true)) AS high_us", f"{_EV}, {_RUNS}"
)(lambda s, d: _us(runs.first_high_quality(_runs(s, d), _ev(s, d).where("CAST(seed_id AS INT) % 2 = 0").select("seed_id", F.col("created_at").alias("at"), "score"), _ev(s, d).select(F.col("created_at").alias("at"), "score"), 480.0), "high_at"))
_NOON = datetime.datetime(2024, 1, 15, 12)
for _name, _span in (("15m", 900), ("6h", 21_600), ("7d", 604_800)):
    _on_events(f"window_{_name}", lambda e, w=_name: views.in_window(e, w, _NOON).agg(F.count("*").alias("n"), F.min(monitor.micros()).alias("first_us")), f"SELECT count(*) AS n, min(us) AS first_us FROM ev WHERE us <= epoch_us(TIMESTAMP '2024-01-15 12:00:00') AND us >= epoch_us(TIMESTAMP '2024-01-15 12:00:00') - {_span}000000")
_on_events("time_text_place", lambda e: e.where(views.time_text(" #12", order="event_id")).agg(F.count("*").alias("n")), "SELECT count(*) AS n FROM ev WHERE contains('#' || CAST(event_id AS VARCHAR), '#12')")
_on_events(
    "duration_labels", lambda e: monitor.elapsed(e).groupBy(views.duration_label(F.col("elapsed")).alias("label")).agg(F.count("*").alias("n")),
    "SELECT CASE WHEN t < 60 THEN t || 's' WHEN t < 3600 THEN t // 60 || 'm ' || t % 60 || 's' WHEN t < 86400 THEN t // 3600 || 'h ' || t % 3600 // 60 || 'm' ELSE t // 86400 || 'd ' || t % 86400 // 3600 || 'h' END AS label, count(*) AS n FROM (SELECT (us - min(us) OVER (PARTITION BY seed_id)) // 1000000 AS t FROM ev) GROUP BY 1",
)
_DAY = "strftime(make_timestamp(us), '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"
_on_events(
    "snapshot_export", lambda e: sinks.flat(eventlog.feed_snapshots(eventlog.stored(e))).select(*(F.col(c).alias(c.lower()) for c in sinks.SNAPSHOT_COLUMNS)),
    f"SELECT {_DAY} AS timestamp, topic, stage, status, algorithm, search, strategy AS neighborhood, CAST(score AS VARCHAR) AS currentf1score, CAST(score AS VARCHAR) AS bestf1score, CASE WHEN event_id % 3 = 0 THEN CAST(score - cpu AS VARCHAR) ELSE '' END AS previousbestf1score, CASE WHEN event_id % 3 = 0 THEN CAST(cpu AS VARCHAR) ELSE '' END AS scoredelta, seed_id AS seedid, "
    "request_id AS requestid, training AS trainingfilename, testing AS testingfilename, array_to_string(features, ' | ') AS solutionfeatures, CASE WHEN event_id % 3 = 0 THEN CAST(rcl[1] AS VARCHAR) ELSE array_to_string(rcl, ' | ') END AS rclfeatures, CAST(cpu AS VARCHAR) AS cpuusage, CAST(mem AS VARCHAR) AS memoryusage, CAST(memp AS VARCHAR) AS memoryusagepercent FROM st",
)
_query("export_summary", "SELECT (SELECT count(*) FROM runs) AS runs, count(*) AS snapshots, count(DISTINCT seed_id) AS seeds, count(DISTINCT request_id) + 1 AS requests FROM ev", f"{_EV}, {_RUNS}")(lambda s, d: sinks.export_summary(_runs(s, d), _ev(s, d), "another"))
_on_events(
    "metrics_rows", lambda e: sinks.metrics_rows(e.select("event_id", "solution_features", F.col("score").alias("f1_score"), "cpu_usage", F.lit(float("nan")).alias("memory_usage"), "classifier", F.lit(None).cast("string").alias("training_file_name")), {"id": "event_id", "features": "solution_features", "f1": "f1_score", "cpu": "cpu_usage", "memory": "memory_usage", "classifier": "classifier", "training": "training_file_name"}),
    "SELECT CAST(event_id AS VARCHAR) AS id, '[' || array_to_string(features, ', ') || ']' AS features, printf('%.4f', score) AS f1, printf('%.4f', cpu) AS cpu, '0.0000' AS memory, classifier, 'null' AS training FROM ev",
)
_on_events(
    "event_upsert", lambda e: sinks.latest_events(e.unionByName(e.where("event_id % 3 = 0").withColumns({"score": F.col("score") + 1, "created_at": F.col("created_at") + F.expr("INTERVAL 1 SECOND")})), ["event_id"]).select("event_id", "score"),
    "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN score + 1 ELSE score END AS score FROM ev",
)
_query("run_upsert", f"SELECT coalesce(n.seed_id, o.seed_id) AS seed_id, CASE WHEN n.seed_id IS NULL THEN o.best_score ELSE n.best_score END AS best_score FROM {_HALF('event_id % 3 > 0', 'stored')} o FULL JOIN {_HALF('event_id % 2 = 0 AND user_id % 4 > 0', 'new')} n ON n.seed_id = o.seed_id")(
    lambda s, d: sinks.upsert_runs(monitor.fold_runs(_ev(s, d).where("event_id % 3 > 0")), monitor.fold_runs(_ev(s, d).where("event_id % 2 = 0 AND CAST(seed_id AS INT) % 4 > 0"))).select("seed_id", "best_score")
)


_query("run_history", "SELECT event_id, topic, score FROM ev WHERE seed_id = '7' AND topic <> 'LOCAL_SEARCH_PROGRESS_TOPIC' AND us >= epoch_us(TIMESTAMP '2024-01-05 00:00:00') AND us <= epoch_us(TIMESTAMP '2024-01-20 00:00:00')")(
    lambda s, d: feed.run_history(_ev(s, d), "7", ["kafka.update"], datetime.datetime(2024, 1, 5), datetime.datetime(2024, 1, 20)).select("event_id", "topic", "score")
)
_query("table_page", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE contains(lower(c_mktsegment), 'build') ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 10 OFFSET 20", "")(
    lambda s, d: feed.table_view(table(s, d, "customer").where(F.contains(F.lower("c_mktsegment"), F.lit("build"))), "c_custkey", "", "c_acctbal", True, 3, 10).select("c_custkey", "c_name", "c_acctbal")
)


def _shared(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@_query("read_model", ORACLE_SQL["topic_metrics"], "")
def read_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _ev(spark, sf_dir)
    model = sinks.ReadModel(spark, _shared(spark, "model"))
    model.serve(monitor.watermark(e, monitor.fold_runs(e)), lambda: {"topics": monitor.topic_metrics(e)})
    return model.table("topics")


@_query("keyed_store", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN score + 1 ELSE score END AS score, 0 AS rewritten FROM ev")
def keyed_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in three batches of a writer: as they are, a third of them again with new scores, and the first batch once more after a crash."""
    rows = _ev(spark, sf_dir).select("event_id", "seed_id", "created_at", "score")
    again = rows.where("event_id % 3 = 0").withColumns({"score": F.col("score") + 1, "created_at": F.col("created_at") + F.expr("INTERVAL 1 SECOND")})
    store = keyed.KeyedStore(spark, _shared(spark, "store"), ["event_id"], ["created_at"])
    store.upsert(rows, "log", 0)
    store.upsert(again, "log", 1)
    rewritten = len(store.upsert(rows.withColumn("score", F.lit(-1.0)), "log", 0))
    return store.read().select("event_id", "score", F.lit(rewritten).alias("rewritten"))


@_query("catalog_profiles", "SELECT o_orderstatus AS status, CAST(3 AS BIGINT) AS attributes, count(*) AS instances, 0 AS scanned FROM orders GROUP BY 1", "")
def catalog_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data sets of a folder with kept profiles: scanned is how many files the second look reads."""
    folder = _shared(spark, "sets")
    lines = table(spark, sf_dir, "orders").select("o_orderstatus", F.concat_ws(",", "o_orderkey", "o_custkey", "o_totalprice").alias("value"))
    lines.repartition("o_orderstatus").write.partitionBy("o_orderstatus").text(folder)
    sets = catalog.Catalog(spark, folder, _shared(spark, "profiles"))
    sets.datasets()
    found = sets.datasets()
    status = F.regexp_extract("path", "o_orderstatus=([^/]*)", 1)
    return found.groupBy(status.alias("status")).agg(F.max("attributes").alias("attributes"), F.sum("instances").alias("instances")).withColumn("scanned", F.lit(sets.scanned))


@_query("arff_scan", "SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(sum(l_discount), 2) AS discount FROM lineitem GROUP BY 1", "")
def arff_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _shared(spark, "arff")
    arff.write(table(spark, sf_dir, "lineitem").select("l_quantity", "l_tax", "l_discount", "l_returnflag"), path)
    data = arff.subset(arff.Cache().get(spark, path), [1, 3])
    return data.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum("l_discount"), 2).alias("discount"))


@_query("incremental_model", ORACLE_SQL["topic_metrics"], "")
def incremental_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topic metrics of a model that took three batches: late events, many of them twice, and one batch again."""
    e = _ev(spark, sf_dir)
    model = incremental.TopicModel(spark, _shared(spark, "incremental"))
    for batch_id, some in enumerate(("event_id % 3 <> 1", "event_id % 2 = 0", "event_id % 4 <> 2")):
        model.take(e.where(some), batch_id)
    model.take(e.where("event_id % 2 = 0"), 1)
    return model.topics()


@_query("arff_source", "SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(sum(l_discount), 2) AS discount FROM lineitem GROUP BY 1", "")
def arff_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.dataSource.register(arffsource.ArffSource)
    path = _shared(spark, "arff")
    arff.write(table(spark, sf_dir, "lineitem").select("l_quantity", "l_tax", "l_discount", "l_returnflag"), path)
    data = spark.read.format("arff").option("features", "1,3").load(path)
    return data.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum("l_discount"), 2).alias("discount"))


def _streamed(spark: SparkSession, rows: DataFrame, fold: Callable[[DataFrame], DataFrame], schema: str = S.EVENT) -> DataFrame:
    """What a fold of the rows as a stream of JSON messages emits, through files in the shared folder."""
    folder = _shared(spark, "stream")
    rows.repartitionByRange("created_at", "event_id").sortWithinPartitions("created_at", "event_id").select(F.to_json(F.struct("*"), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}).alias("value")).write.text(f"{folder}/in")
    out = fold(folds.topic_source(spark, schema, f"{folder}/in"))
    out.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/out").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


@_query("stream_verified_best", "SELECT event_id, seed_id, us AS created_us, score FROM (SELECT *, max(score) OVER (PARTITION BY seed_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM ev WHERE topic = 'SOLUTIONS_TOPIC') WHERE prior IS NULL OR score > prior")
def stream_verified_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _us(_streamed(spark, _ev(spark, sf_dir).where(F.col("topic") == S.SOLUTIONS), folds.verify), "created_at")


@_query("stream_run_fold", "SELECT seed_id, best_score, updates, created_us, updated_us FROM runs", f"{_EV}, {_RUNS}")
def stream_run_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _streamed(spark, _ev(spark, sf_dir), folds.fold_runs)
    last = out.groupBy("seed_id").agg(F.max_by(F.struct("best_score", "updates", "created_us", "updated_us"), "updates").alias("r"))
    return last.select("seed_id", "r.*")


@_query("stream_states", f"SELECT {', '.join(c.replace('completed_at', 'completed_us') for c in _STATE_COLUMNS if c != 'history_count')} FROM states", f"{_EV}, {_STATES}")
def stream_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _streamed(spark, _ev(spark, sf_dir).where(F.col("event_type").isin(*S.SNAPSHOT_EVENTS)), lambda rows: folds.fold_states(rows, 2, history=5))
    last = out.groupBy("seed_id").agg(F.max_by(F.struct(*out.columns[1:]), "updates").alias("r"))
    return last.select("seed_id", "r.*").select(*(c.replace("completed_at", "completed_us") for c in _STATE_COLUMNS if c != "history_count"))


@_query("topic_log", "SELECT topic, seed_id AS key, count(*) AS n, count(*) AS gapless, min(event_id) AS first_id, max(event_id) AS last_id FROM ev GROUP BY ALL")
def topic_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events sent to a log in two batches, sent all again after a crash, and read from the beginning in bounded batches: none is lost or repeated.

    gapless: of the messages of a key those whose offset no other message of the partition has.
    """
    spark.dataSource.register(topiclog.TopicLog)
    folder = _shared(spark, "log")
    rows = _ev(spark, sf_dir).select("topic", F.coalesce("seed_id", F.lit("")).alias("key"), F.to_json(F.struct("event_id", "created_at")).alias("value"))
    rows.repartitionByRange(2, "value").write.parquet(f"{folder}/in")
    at = f"{folder}/topics".removeprefix("file:")
    for attempt in range(2):
        sent = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        sent.writeStream.format("topiclog").option("path", at).option("producer", "search").option("checkpointLocation", f"{folder}/sent-{attempt}").trigger(availableNow=True).start().awaitTermination()
    got = spark.readStream.format("topiclog").option("path", at).option("group", "monitor").load()
    got.writeStream.format("parquet").option("path", f"{folder}/got").option("checkpointLocation", f"{folder}/monitor").trigger(availableNow=True).start().awaitTermination()
    kept = spark.read.schema(got.schema).parquet(f"{folder}/got")
    event = F.get_json_object("value", "$.event_id").cast("long")
    return kept.groupBy("topic", "key").agg(F.count("*").alias("n"), F.countDistinct("partition", "offset").alias("gapless"), F.min(event).alias("first_id"), F.max(event).alias("last_id"))


#: What the results of a seed say of its searches and cycles.
_LISTS = [["IWSS", "BIT_FLIP"], list(S.LOCAL_SEARCHES), ["IWSSR"], ["IWSSR", "IWSS", "BIT_FLIP"]]


def _route_sql(strategy: str) -> str:
    turns = strategy == "VND"
    before = f"""
  SELECT w.seed_id, m.n, m.event_id, m.step, m.searches, m.cycles * {'len(m.searches)' if turns else '1'} AS budget, coalesce(greatest(w.best, m.score), m.score) AS best, w.best IS NOT NULL AND m.score > w.best AS better,
    coalesce(w.baseline, coalesce(greatest(w.best, m.score), m.score)) AS baseline,
    coalesce(list_position(m.searches, CASE WHEN list_contains(m.searches, m.search) THEN m.search WHEN list_contains(m.searches, w.last) THEN w.last END), 0) AS place
  FROM walk w JOIN m ON m.seed_id = w.seed_id AND m.n = w.n + 1"""
    if turns:
        action = "CASE WHEN step > budget THEN NULL WHEN step = budget THEN 'done' WHEN place < len(searches) THEN 'next' WHEN best <= baseline THEN 'done' ELSE 'restart' END"
        search, base = "searches[CASE WHEN place < len(searches) THEN place + 1 ELSE 1 END]", "CASE WHEN place > 0 AND place < len(searches) THEN baseline ELSE best END"
    else:
        action = "CASE WHEN step > budget THEN NULL WHEN step = budget THEN 'done' WHEN better THEN 'restart' ELSE 'next' END"
        search, base = "searches[CAST('0x' || substr(md5('1|' || seed_id || '|' || CAST(step + 1 AS VARCHAR)), 1, 7) AS INTEGER) % len(searches) + 1]", "CAST(NULL AS DOUBLE)"
    goes = "action IN ('next', 'restart')"
    return f"""WITH RECURSIVE {_EV},
m AS (SELECT seed_id, event_id, coalesce(score, 0) AS score, CAST(iteration AS INTEGER) AS step, search, {_LISTS!r}[user_id % 4 + 1] AS searches, 1 + user_id % 3 AS cycles, row_number() OVER (PARTITION BY seed_id ORDER BY us, event_id) AS n FROM ev WHERE topic = 'SOLUTIONS_TOPIC' AND strategy = '{strategy}'),
walk AS (
  SELECT DISTINCT seed_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS DOUBLE) AS best, CAST(NULL AS DOUBLE) AS baseline, CAST(NULL AS VARCHAR) AS last, CAST(NULL AS INTEGER) AS iteration, CAST(NULL AS VARCHAR) AS local_search, CAST(NULL AS DOUBLE) AS best_score, CAST(NULL AS VARCHAR) AS action FROM m
  UNION ALL
  SELECT seed_id, n, event_id, CASE WHEN {goes} THEN best END, CASE WHEN {goes} THEN {base} END, CASE WHEN {goes} THEN {search} END, CASE WHEN {goes} THEN step + 1 ELSE step END, CASE WHEN {goes} THEN {search} END, best, action
  FROM (SELECT *, {action} AS action FROM ({before}))
)
SELECT seed_id, event_id, iteration, local_search, best_score, action FROM walk WHERE action IS NOT NULL"""


def _routes(spark: SparkSession, sf_dir: str, strategy: str) -> DataFrame:
    user = F.col("seed_id").cast("long")
    lists = F.array(*(F.array(*map(F.lit, x)) for x in _LISTS))
    told = {"enabled_local_searches": F.get(lists, user % 4), "neighborhood_max_iterations": (1 + user % 3).cast("int")}
    rows = _ev(spark, sf_dir).where(F.col("topic") == S.SOLUTIONS).withColumns(told)
    return _streamed(spark, rows, lambda r: folds.route(r, strategy), f"{S.EVENT}, enabled_local_searches array<string>, neighborhood_max_iterations int")


for _strategy in S.STRATEGIES:
    _query(f"stream_{_strategy.lower()}", _route_sql(_strategy), "")(lambda s, d, strategy=_strategy: _routes(s, d, strategy))

FEATURES = ["l_quantity", "l_discount", "l_tax", "l_linenumber", "l_linestatus"]
LABEL = "l_returnflag"
_CONTINGENCY = (
    "long AS ("
    + " UNION ALL ".join(f"SELECT '{f}' AS feature, CAST({f} AS VARCHAR) AS value, {LABEL} AS class FROM lineitem" for f in FEATURES)
    + "), c AS (SELECT feature, value, class, count(*) AS n FROM long GROUP BY 1, 2, 3), t AS (SELECT feature, sum(n) AS total, sum(n * log2(n)) AS j FROM c GROUP BY 1), "
    "v AS (SELECT feature, sum(n * log2(n)) AS v FROM (SELECT feature, value, sum(n) AS n FROM c GROUP BY 1, 2) GROUP BY 1), k AS (SELECT feature, sum(n * log2(n)) AS k FROM (SELECT feature, class, sum(n) AS n FROM c GROUP BY 1, 2) GROUP BY 1), "
    "h AS (SELECT feature, log2(total) - v / total AS hv, log2(total) - k / total AS hk, log2(total) - j / total AS hj FROM t JOIN v USING (feature) JOIN k USING (feature)), "
    "s AS (SELECT feature, round(hk + hv - hj, 8) AS info_gain, round((hk + hv - hj) / hv, 8) AS gain_ratio, round(2 * (hk + hv - hj) / (hk + hv), 8) AS symmetrical_uncertainty FROM h)"
)
for _name in ("info_gain", "gain_ratio", "symmetrical_uncertainty"):
    _query(_name, f"SELECT feature, {_name} FROM s", _CONTINGENCY)(lambda s, d, name=_name: scoring.scores(table(s, d, "lineitem"), FEATURES, LABEL).select("feature", name))
_query("rcl_top_k", f"SELECT feature, CAST(list_position({FEATURES!r}, feature) AS INTEGER) AS place, info_gain AS score FROM s ORDER BY score DESC, place LIMIT 3", _CONTINGENCY)(lambda s, d: scoring.top_features(scoring.scores(table(s, d, "lineitem"), FEATURES, LABEL), "info_gain", FEATURES, 3))
_RULE = "CASE WHEN l_quantity > 40 THEN 'R' WHEN l_discount > 0.05 THEN 'A' ELSE 'N' END"
_query(
    "confusion_metrics",
    "SELECT l_linestatus, tp, tn, fp, fn, round(100.0 * (tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(100.0 * tp / (tp + fp), 6) AS precision, round(100.0 * tp / (tp + fn), 6) AS recall, round(200.0 * tp / (2 * tp + fp + fn), 6) AS f1 FROM (SELECT l_linestatus, count(*) FILTER (a = p AND p <> 'N') AS tp, count(*) FILTER (a = p AND p = 'N') AS tn, "
    f"count(*) FILTER (a <> p AND p <> 'N') AS fp, count(*) FILTER (a <> p AND p = 'N') AS fn FROM (SELECT l_linestatus, l_returnflag AS a, {_RULE} AS p FROM lineitem) GROUP BY 1)",
    "",
)(lambda s, d: search.evaluate(table(s, d, "lineitem").withColumn("guess", F.expr(_RULE)), LABEL, "guess", "N", ["l_linestatus"]).select("l_linestatus", "tp", "tn", "fp", "fn", *(F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1"))))
_on_events("adaptive_resource_series", lambda e: series.resource_series(e, 240), f"SELECT us // 10800000000 * 10800 AS bucket, {_A('cpu', 'avg_cpu')}, {_A('memp', 'avg_memory_percent')}, count(*) AS samples, count(DISTINCT seed_id) AS runs FROM ev GROUP BY 1")
_on_events(
    "downsample_min_max", lambda e: series.downsample(e.select("seed_id", "event_id", "score"), ["seed_id"], "event_id", "score", 20),
    "SELECT seed_id, event_id, score FROM (SELECT *, row_number() OVER (PARTITION BY seed_id, run ORDER BY score, n) AS lo, row_number() OVER (PARTITION BY seed_id, run ORDER BY score DESC, n) AS hi FROM (SELECT *, CASE WHEN n > 1 AND n < cnt THEN (n - 2) // greatest(CAST(ceil((cnt - 2) / 9.0) AS BIGINT), 1) END AS run FROM (SELECT seed_id, event_id, score, "
    "row_number() OVER (PARTITION BY seed_id ORDER BY event_id) AS n, count(*) OVER (PARTITION BY seed_id) AS cnt FROM ev))) WHERE cnt <= 20 OR run IS NULL OR lo = 1 OR hi = 1",
)


@_query(
    "catalog_pairs",
    "SELECT a.family, a.name AS training_name, b.name AS testing_name, abs(a.attributes - b.attributes) AS attributes_gap, abs(a.instances - b.instances) AS instances_gap FROM (SELECT CAST(p_size AS VARCHAR) || replace(lower(p_brand), '#', '') AS family, 'Train_' || CAST(p_partkey AS VARCHAR) AS name, p_size AS attributes, p_partkey AS instances FROM part WHERE p_partkey % 2 = 0) a "
    "JOIN (SELECT CAST(p_size AS VARCHAR) || replace(lower(p_brand), '#', '') AS family, 'Test_' || CAST(p_partkey AS VARCHAR) AS name, p_size AS attributes, p_partkey AS instances FROM part WHERE p_partkey % 2 = 1) b USING (family)",
    "",
)
def catalog_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    role = F.when(F.col("p_partkey") % 2 == 0, "Train_").otherwise("Test_")
    sets = part.select(F.concat(role, F.col("p_partkey").cast("string")).alias("name"), labels.family_key(F.concat(role, F.col("p_size").cast("string"), F.lit("_"), "p_brand", F.lit(".arff"))).alias("family"), F.col("p_size").alias("attributes"), F.col("p_partkey").alias("instances"))
    return catalog.pairs(sets.withColumn("role", labels.role_of(F.col("name"))))


#: Of an embedding.
DIMENSIONS = 64


def _vectors(spark: SparkSession, sf_dir: str, *kept: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(*kept, *(F.get("embedding", F.lit(k)).cast("double").alias(f"x{k}") for k in range(DIMENSIONS)), F.concat(F.lit("c"), F.col("label").cast("string")).alias("class"))


#: Of every row the ten nearest of each class, over features scaled to 0..1.
_RELIEF_SQL = """
WITH long AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) - 1 AS f FROM embeddings),
unit AS (SELECT vec_id, label, f, (v - min(v) OVER (PARTITION BY f)) / (max(v) OVER (PARTITION BY f) - min(v) OVER (PARTITION BY f)) AS v FROM long),
rows AS (SELECT vec_id, label, list(v ORDER BY f) AS x FROM unit GROUP BY ALL),
sizes AS (SELECT label, count(*) / sum(count(*)) OVER () AS p FROM rows GROUP BY label),
pairs AS (SELECT a.vec_id, a.label AS own, b.label AS kind, b.vec_id AS near, list_sum(list_transform(range(1, 65), lambda i: abs(a.x[i] - b.x[i]))) AS far FROM rows a JOIN rows b ON a.vec_id <> b.vec_id),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id, kind ORDER BY far, near) AS k FROM pairs) WHERE k <= 10),
weighed AS (SELECT vec_id, near, CASE WHEN own = kind THEN -1.0 ELSE s.p / (1 - t.p) END / count(*) OVER (PARTITION BY vec_id, kind) AS w FROM best JOIN sizes s ON s.label = kind JOIN sizes t ON t.label = own)
SELECT 'x' || CAST(a.f AS VARCHAR) AS feature, round(sum(w * abs(a.v - b.v)) / (SELECT count(*) FROM rows), 8) AS relieff FROM weighed JOIN unit a USING (vec_id) JOIN unit b ON b.vec_id = near AND b.f = a.f GROUP BY a.f
"""


@_query("relieff_rank", _RELIEF_SQL, "")
def relieff_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.relieff(_vectors(spark, sf_dir), [f"x{k}" for k in range(DIMENSIONS)], "class").select("feature", F.round("relieff", 8).alias("relieff"))


@_query("binned_scores")
def binned_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [f"x{k}" for k in range(DIMENSIONS)]
    return scoring.scores(scoring.binned(_vectors(spark, sf_dir), names, "class"), names, "class")


SEARCH_STEPS = {"BIT_FLIP": 6, "IWSS": 4, "IWSSR": 3}


def _search(spark: SparkSession, sf_dir: str, **of) -> DataFrame:
    data, test = _vectors(spark, sf_dir, "vec_id"), F.col("vec_id") % 3 == 0
    problem = search.Problem.of(data.where(~test).drop("vec_id"), data.where(test).drop("vec_id"), "c0")
    request = search.Request(generations=2, cutoff=DIMENSIONS, sample=3, classifier="NB", cycles=1, steps=SEARCH_STEPS, **of)
    steps = search.run_search(spark, list(range(1, DIMENSIONS + 1)), problem, request)
    return steps.withColumns({"features": F.array_join("features", ","), "f1": F.round("f1", 6), "best_f1": F.round("best_f1", 6)})


def _search_sql(searches: list[str], strategy: str) -> str:
    return searchsql.search_sql(DIMENSIONS, 2, 3, 1, searches, strategy, SEARCH_STEPS)


for _name, _searches in (("bitflip", ["BIT_FLIP"]), ("iwss", ["IWSS"]), ("iwssr", ["IWSSR"])):
    _query(_name, _search_sql(_searches, "VND"), "")(lambda s, d, chosen=_searches: _search(s, d, searches=chosen))
for _strategy in S.STRATEGIES:
    _query(f"{_strategy.lower()}_search", _search_sql(list(S.LOCAL_SEARCHES), _strategy), "")(lambda s, d, strategy=_strategy: _search(s, d, strategy=strategy))
