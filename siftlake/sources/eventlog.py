"""The event log as operators read it: from stored events with a JSON payload, or from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake import schemas as S
from siftlake.functions import labels, payload
from siftlake.session import table


def from_payload(stored: DataFrame) -> DataFrame:
    """Events of stored rows (event_id, seed_id, request_id, topic, event_type, stage, created_at, payload): every field is extracted once."""
    rows = stored.withColumn("p", payload.parsed())
    f = lambda name, history=True: payload.pick("p", payload.nested(name, history))
    num = lambda name: payload.number(f(name))
    search = F.coalesce(payload.pick("p", [*payload.nested("localSearch"), *payload.nested("neighborhood")]), F.lit(S.UNKNOWN))
    score = payload.pick("p", [f"$.{where}{name}" for where in ("payload.", "") for name in ("historyEntry.f1Score", "bestF1Score", "currentF1Score", "f1Score")])
    ints = lambda name: F.from_json(f(name), "array<int>")
    return rows.select(
        "event_id",
        F.coalesce("seed_id", f("seedId", False)).alias("seed_id"),
        F.coalesce("request_id", f("requestId", False)).alias("request_id"),
        "topic",
        "event_type",
        labels.present(F.coalesce("stage", f("stage")), S.UNKNOWN).alias("stage"),
        f("status").alias("status"),
        "created_at",
        payload.number(score).alias("score"),
        num("cpuUsage").alias("cpu_usage"),
        num("memoryUsage").alias("memory_usage"),
        num("memoryUsagePercent").alias("memory_usage_percent"),
        F.coalesce(f("rclAlgorithm", False), F.lit(S.UNKNOWN)).alias("rcl_algorithm"),
        search.alias("local_search"),
        f("neighborhood").alias("neighborhood"),
        f("iterationNeighborhood").try_cast("int").alias("iteration_neighborhood"),
        F.coalesce(f("trainingFileName", False), F.lit(S.NO_FILE)).alias("training_file_name"),
        F.coalesce(f("testingFileName", False), F.lit(S.NO_FILE)).alias("testing_file_name"),
        ints("solutionFeatures").alias("solution_features"),
        ints("rclFeatures").alias("rcl_features"),
        F.coalesce(f("classifier", False), f("classfier", False)).alias("classifier"),
    )


def _pick(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver's events table in the shape of an event log."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    e = table(spark, sf_dir, "events")
    user, k = F.col("user_id"), F.get_json_object("props", "$.k").try_cast("int")
    e = e.withColumn("k", k)
    topic = F.when(F.col("event_type") == "signup", S.INITIAL).when(F.col("event_type") == "view", S.PROGRESS).when(F.col("event_type") == "click", S.SOLUTIONS).when(F.col("event_type") == "error", S.RESTART).when(F.col("event_type") == "purchase", S.BEST)
    e = e.withColumn("topic", topic).withColumn("local_search", _pick(S.LOCAL_SEARCHES, F.col("k") % 3))
    return e.select(
        "event_id",
        user.cast("string").alias("seed_id"),
        F.concat(F.lit("req-"), (user % 10).cast("string")).alias("request_id"),
        "topic",
        F.when(F.col("topic") == S.PROGRESS, "kafka.progress").otherwise("kafka.update").alias("event_type"),
        labels.stage_of(F.col("topic"), F.col("local_search")).alias("stage"),
        F.when(F.col("k") % 11 == 0, "completed").otherwise("running").alias("status"),
        F.col("ts").cast("timestamp").alias("created_at"),
        F.col("value").alias("score"),
        F.col("k").cast("double").alias("cpu_usage"),
        (F.col("k") * 1.5).alias("memory_usage"),
        ((F.col("k") * 7) % 100).cast("double").alias("memory_usage_percent"),
        _pick(("IG", "GR", "RF", "SU"), user % 4).alias("rcl_algorithm"),
        "local_search",
        _pick(S.STRATEGIES, user % 2).alias("neighborhood"),
        (F.col("k") % 13).alias("iteration_neighborhood"),
        F.concat(F.lit("train-"), (user % 3).cast("string"), F.lit(".arff")).alias("training_file_name"),
        F.concat(F.lit("test-"), (user % 3).cast("string"), F.lit(".arff")).alias("testing_file_name"),
        F.array(F.col("k") % 7 + 1, F.col("k") % 5 + 8, F.col("k") % 3 + 13).alias("solution_features"),
        F.array(F.col("k") % 4 + 16, F.col("k") % 6 + 20).alias("rcl_features"),
        _pick(("J48", "NB"), user % 5 % 2).alias("classifier"),
    )


def stored(events: DataFrame) -> DataFrame:
    """Events packed the way the store keeps them: fields in a JSON payload, wrapped for even ids, with a history entry for every third."""
    c = F.col
    before, delta = c("score") - c("cpu_usage"), c("cpu_usage")
    entry = F.struct(
        c("score").alias("f1Score"), c("cpu_usage").alias("cpuUsage"), c("local_search").alias("localSearch"), before.alias("previousBestF1Score"), delta.alias("scoreDelta"),
        (delta > 0).alias("improved"), F.lit(2).alias("solutionSize"), F.array(c("rcl_features")[0]).alias("rclFeatures"),
    )
    body = F.struct(
        F.when(c("event_id") % 3 == 0, entry).alias("historyEntry"),
        c("seed_id").alias("seedId"), c("request_id").alias("requestId"), c("score").alias("f1Score"), c("cpu_usage").alias("cpuUsage"),
        c("memory_usage").alias("memoryUsage"), c("memory_usage_percent").alias("memoryUsagePercent"), c("rcl_algorithm").alias("rclAlgorithm"),
        c("local_search").alias("localSearch"), c("neighborhood").alias("neighborhood"), c("iteration_neighborhood").alias("iterationNeighborhood"),
        c("training_file_name").alias("trainingFileName"), c("testing_file_name").alias("testingFileName"), c("status").alias("status"),
        c("solution_features").alias("solutionFeatures"), c("rcl_features").alias("rclfeatures"), F.array(c("local_search")).alias("enabledLocalSearches"),
        F.when(c("event_id") % 5 > 0, c("classifier")).alias("classifier"), F.when(c("event_id") % 5 == 0, c("classifier")).alias("classfier"),
    )
    packed = F.when(c("event_id") % 2 == 0, F.to_json(F.struct(body.alias("payload")))).otherwise(F.to_json(body))
    return events.select("event_id", F.lit(None).cast("string").alias("seed_id"), F.lit(None).cast("string").alias("request_id"), "topic", "event_type", F.col("stage"), "created_at", packed.alias("payload"))


def _snapshot(stored: DataFrame) -> DataFrame:
    """Stored rows with the structs `s`, the snapshot (wrapped or bare), and `h`, its history entry."""
    rows = stored.withColumn("p", payload.parsed())
    wrapped, fields = F.col("p.payload"), [*payload.FIELDS, "historyEntry"]
    bare = F.struct(*(F.col(f"p.{f}").alias(f) for f in fields))
    return rows.withColumn("s", F.coalesce(wrapped, bare)).withColumn("h", F.col("s.historyEntry"))


def _first(*columns: str) -> Column:
    """The first of some fields that holds text."""
    return F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in columns))


def _any(name: str) -> Column:
    return F.coalesce(F.col(f"h.{name}"), F.col(f"s.{name}"))


def _ints(*columns: str) -> Column:
    return F.coalesce(F.from_json(_first(*columns), "array<int>"), F.array().cast("array<int>"))


def feed_snapshots(stored: DataFrame) -> DataFrame:
    """The search snapshot of each stored event as flat columns: history entry before snapshot before the event itself.

    Lists that are missing are empty, and the sizes default to their lengths. The payload's JSON is read once.
    """
    number, bool_ = payload.number, lambda c: c.try_cast("boolean")
    out = _snapshot(stored).select(
        "event_id", "event_type",
        _first("s.seedId", "seed_id").alias("seed_id"), _first("s.requestId", "h.requestId", "request_id").alias("request_id"),
        _first("h.topic", "topic", "s.topic").alias("topic"), _first("h.stage", "stage", "s.stage").alias("stage"), _first("s.status").alias("status"),
        F.coalesce("created_at", F.col("s.updatedAt").try_cast("timestamp"), F.col("s.createdAt").try_cast("timestamp")).alias("created_at"),
        _first("s.rclAlgorithm").alias("rcl_algorithm"), _first("s.classifier", "s.classfier").alias("classifier"),
        _first("h.localSearch", "s.localSearch").alias("local_search"), _first("h.neighborhood", "s.neighborhood").alias("neighborhood"),
        number(F.coalesce("h.f1Score", "s.currentF1Score", "s.f1Score")).alias("current_score"),
        number(F.coalesce("s.bestF1Score", "s.currentF1Score", "s.f1Score")).alias("best_score"),
        _first("s.trainingFileName").alias("training_file_name"), _first("s.testingFileName").alias("testing_file_name"),
        _any("iterationNeighborhood").try_cast("int").alias("iteration_neighborhood"), _any("iterationLocalSearch").try_cast("int").alias("iteration_local_search"),
        number(_any("previousBestF1Score")).alias("previous_best"), number(_any("scoreDelta")).alias("delta"), bool_(_any("improved")).alias("improved"),
        _ints("h.solutionFeatures", "s.solutionFeatures").alias("solution_features"), _ints("h.rclFeatures", "s.rclFeatures").alias("rcl_features"),
        F.coalesce(F.from_json(_any("enabledLocalSearches"), "array<string>"), F.array().cast("array<string>")).alias("enabled_local_searches"),
        _any("solutionSize").try_cast("int").alias("_solution_size"), _any("rclSize").try_cast("int").alias("_rcl_size"),
        number(_any("memoryUsage")).alias("memory_usage"), number(_any("memoryUsagePercent")).alias("memory_usage_percent"), number(_any("cpuUsage")).alias("cpu_usage"),
    )
    sized = out.withColumns({"solution_size": F.coalesce("_solution_size", F.size("solution_features")), "rcl_size": F.coalesce("_rcl_size", F.size("rcl_features"))})
    return sized.drop("_solution_size", "_rcl_size")


#: Columns of a history entry.
ENTRY = (
    "event_id", "seed_id", "created_at", "request_id", "stage", "topic", "event_type", "score", "previous_best", "delta", "improved", "cpu_usage", "memory_usage", "memory_usage_percent",
    "local_search", "neighborhood", "iteration_neighborhood", "iteration_local_search", "solution_size", "rcl_size", "enabled_local_searches", "rcl_features", "solution_features",
)


def history_entries(stored: DataFrame) -> DataFrame:
    """Stored events as entries of their run's history; the score is that of the message, never the run's best."""
    return feed_snapshots(stored).withColumnRenamed("current_score", "score").select(*ENTRY)


def history_snapshots(runs: DataFrame, entries: DataFrame) -> DataFrame:
    """History entries with what only their run holds: an entry's own value goes before the run's. Runs without history have no row."""
    own = set(entries.columns) - {"seed_id"}
    r = runs.where("seed_id IS NOT NULL").select(F.col("seed_id").alias("_seed_id"), *(F.col(c).alias(f"_{c}") for c in runs.columns if c != "seed_id"))
    # Null-safe, as the plain equality would filter entries by their seed below their parsing, and read each JSON again for it.
    rows = entries.join(r, F.col("seed_id").eqNullSafe(F.col("_seed_id")))
    pick = lambda name, run: F.coalesce(*([F.col(name)] if name in own else []), *(F.col(f"_{c}") for c in run if f"_{c}" in r.columns))
    from_run = ("rcl_algorithm", "classifier", "training_file_name", "testing_file_name", "status")
    both = ("request_id", "local_search", "neighborhood", "iteration_neighborhood", "iteration_local_search", "previous_best", "delta", "improved", "solution_features", "rcl_features", "solution_size", "rcl_size", "cpu_usage", "memory_usage", "memory_usage_percent")
    known = lambda name: name in own or f"_{name}" in r.columns
    return rows.select(
        "seed_id", "event_id", "topic", "stage", F.coalesce("created_at", "_updated_at", "_created_at").alias("created_at"),
        pick("score", ["current_score"]).alias("current_score"), pick("score", ["best_score", "current_score"]).alias("best_score"),
        *(pick(c, [c]).alias(c) for c in both if known(c)), *(F.col(f"_{c}").alias(c) for c in from_run if f"_{c}" in r.columns),
    )
