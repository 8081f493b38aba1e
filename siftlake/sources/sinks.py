"""Sinks: metrics and snapshot CSV, JSON export, read models with a freshness mark, run and event upserts."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.operators.monitor import first_per, latest
from siftlake.streaming.folds import message_key

#: Headers of the exported files, in their order, with the columns that they show.
SNAPSHOT_COLUMNS = {
    "timestamp": "created_at", "topic": "topic", "stage": "stage", "status": "status", "algorithm": "rcl_algorithm", "search": "local_search", "neighborhood": "neighborhood",
    "currentF1Score": "current_score", "bestF1Score": "best_score", "previousBestF1Score": "previous_best", "scoreDelta": "delta", "seedId": "seed_id", "requestId": "request_id",
    "trainingFileName": "training_file_name", "testingFileName": "testing_file_name", "solutionFeatures": "solution_features", "rclFeatures": "rcl_features",
    "cpuUsage": "cpu_usage", "memoryUsage": "memory_usage", "memoryUsagePercent": "memory_usage_percent",
}
RCL_COLUMNS = {
    "solutionFeatures": "solution_features", "f1Score": "f1_score", "accuracy": "accuracy", "precision": "precision", "recall": "recall", "runnigTime(ms)": "running_time_ms", "cpuUsage(%)": "cpu_usage",
    "memoryUsage(MB)": "memory_usage", "memoryUsagePercent(%)": "memory_usage_percent", "classifier": "classifier", "trainingFileName": "training_file_name", "testingFileName": "testing_file_name",
}
SEARCH_COLUMNS = {
    "solutionFeatures": "solution_features", "f1Score": "f1_score", "accuracy": "accuracy", "precision": "precision", "recall": "recall", "neighborhood": "neighborhood",
    "iterationNeighborhood": "iteration_neighborhood", "localSearch": "local_search", "iterationLocalSearch": "iteration_local_search", "runnigTime(ms)": "running_time_ms", "cpuUsage(%)": "cpu_usage",
    "memoryUsage(MB)": "memory_usage", "memoryUsagePercent(%)": "memory_usage_percent", "classifier": "classifier", "trainingFileName": "training_file_name", "testingFileName": "testing_file_name",
}


def four_digits(column: str):
    """A number with four decimals; what is null or not finite is 0.0000."""
    c = F.col(column).cast("double")
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), "0.0000").otherwise(F.format_string("%.4f", c))


def metrics_csv(rows: DataFrame, path: str, numbers: list[str]) -> None:
    """Metrics rows as CSV with ; and one header for each file."""
    rows.withColumns({c: four_digits(c) for c in numbers}).write.mode("append").option("header", True).option("sep", ";").csv(path)


def metrics_rows(messages: DataFrame, columns: dict[str, str] = SEARCH_COLUMNS) -> DataFrame:
    """Messages as lines of a metrics file, all text: measures with four decimals, features as a list in brackets, null by its name."""
    kinds = dict(messages.dtypes)

    def shown(c: str):
        if kinds[c].startswith("array"):
            return F.concat(F.lit("["), F.array_join(F.col(c).cast("array<string>"), ", "), F.lit("]"))
        return four_digits(c) if kinds[c] in ("double", "float") else F.coalesce(F.regexp_replace(F.col(c).cast("string"), r"[\r\n;]", ","), F.lit("null"))

    return messages.select(*(shown(c).alias(name) for name, c in columns.items()))


def search_metrics_csv(messages: DataFrame, path: str, rcl: bool = False) -> None:
    """The metrics file of candidate lists (12 columns) or of local searches (16)."""
    metrics_rows(messages, RCL_COLUMNS if rcl else SEARCH_COLUMNS).write.mode("append").option("header", True).option("sep", ";").option("quote", "").csv(path)


def flat(rows: DataFrame) -> DataFrame:
    """The 20 columns of a snapshot export as text: arrays joined by |, times in ISO form, null or a missing column as empty."""
    kinds = dict(rows.dtypes)

    def shown(c: str):
        if c not in kinds:
            return F.lit("")
        if kinds[c].startswith("array"):
            return F.array_join(F.col(c).cast("array<string>"), " | ")
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'") if kinds[c].startswith("timestamp") else F.col(c).cast("string")

    return rows.select(*(F.coalesce(shown(c), F.lit("")).alias(name) for name, c in SNAPSHOT_COLUMNS.items()))


def snapshots_csv(rows: DataFrame, path: str) -> None:
    flat(rows).write.mode("overwrite").option("header", True).option("emptyValue", "").option("escape", '"').csv(path)


def export_summary(runs: DataFrame, rows: DataFrame, request_id: str | None = None) -> DataFrame:
    """Numbers of runs, snapshots, and the distinct seeds and requests of both and of the exported request itself."""
    both = runs.select("seed_id", "request_id").union(rows.select("seed_id", "request_id"))
    asked = both.select("request_id").union(rows.sparkSession.createDataFrame([(request_id,)], "request_id string"))
    given = lambda c: F.countDistinct(F.nullif(c, F.lit("")))
    ids = both.agg(given("seed_id").alias("seeds")).crossJoin(asked.agg(given("request_id").alias("requests")))
    return runs.agg(F.count("*").alias("runs")).crossJoin(rows.agg(F.count("*").alias("snapshots"))).crossJoin(ids)


def json_export(runs: DataFrame, rows: DataFrame, path: str, filters: dict | None = None, request: dict | None = None, events: DataFrame | None = None) -> None:
    """An export folder: head (time, filters, request, summary) as one JSON line, and runs, snapshots and events as JSON lines."""
    spark = runs.sparkSession
    asked = json.dumps(request, sort_keys=True, default=str) if request else None
    head = export_summary(runs, rows, (request or {}).get("request_id")).select(
        F.current_timestamp().alias("generated_at"), F.lit(json.dumps(filters or {}, sort_keys=True, default=str)).alias("filters"), F.lit(asked).alias("request"), F.struct("*").alias("summary")
    )
    head.coalesce(1).write.mode("overwrite").json(f"{path}/head")
    runs.write.mode("overwrite").json(f"{path}/runs")
    rows.write.mode("overwrite").json(f"{path}/snapshots")
    (events if events is not None else spark.createDataFrame([], "event_id long")).write.mode("overwrite").json(f"{path}/events")


def upsert_runs(stored: DataFrame, states: DataFrame) -> DataFrame:
    """Stored runs after an upsert by seed: a new state replaces what was stored; of several states the one of most updates holds."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(states.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return first_per(both.where("seed_id IS NOT NULL"), ["seed_id"], [F.desc("_new"), F.desc("updates"), F.desc("updated_at")]).drop("_new")


def to_topic(rows: DataFrame, topic: str) -> DataFrame:
    """Messages as Kafka records: topic, key, and the message as JSON."""
    own = [c for c in rows.columns if c != "key"]
    return message_key(rows).select(F.lit(topic).alias("topic"), "key", F.to_json(F.struct(*own)).alias("value"))


def send(rows: DataFrame, topic: str, servers: str, checkpoint: str | None = None):
    """Writes messages to a Kafka topic: a batch at once, a stream as a started query with its own checkpoint."""
    records = to_topic(rows, topic)
    if rows.isStreaming:
        return records.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("checkpointLocation", checkpoint).start()
    return records.write.format("kafka").option("kafka.bootstrap.servers", servers).save()


def latest_events(events: DataFrame, fingerprint: list[str]) -> DataFrame:
    """Stored events by fingerprint: a redelivered one replaces what was stored."""
    return first_per(events, fingerprint, latest())


class ReadModel:
    """Materialised aggregates with the mark of the source they were made from.

    A refresh writes a new version and then its pointer, a row of a small table, the newest of which holds; readers that began with
    the old pointer keep their files.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _pointer(self):
        try:
            return self.spark.read.json(f"{self.path}/pointer").orderBy(F.desc("made_us")).first()
        except Exception as error:
            if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
                return None
            raise

    def fresh(self, mark: DataFrame, max_age_seconds: int = 600) -> bool:
        """Whether the model was made from a source with this mark, and lately."""
        at = self._pointer()
        if at is None or at.mark != mark.select(F.to_json(F.struct("*"))).first()[0]:
            return False
        now = self.spark.range(1).select(F.unix_micros(F.current_timestamp())).first()[0]
        return now - at.made_us <= max_age_seconds * 1_000_000

    def refresh(self, mark: DataFrame, tables: dict[str, DataFrame]) -> None:
        version = uuid.uuid4().hex
        for name, df in tables.items():
            df.write.parquet(f"{self.path}/{version}/{name}")
        row = mark.select(F.to_json(F.struct("*")).alias("mark"), F.lit(version).alias("version"), F.unix_micros(F.current_timestamp()).alias("made_us"))
        row.coalesce(1).write.mode("append").json(f"{self.path}/pointer")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{self._pointer().version}/{name}")

    def serve(self, mark: DataFrame, make: Callable[[], dict[str, DataFrame]]) -> None:
        """Refreshes the model unless it is fresh."""
        if not self.fresh(mark):
            self.refresh(mark, make())
