"""A read model that takes in only what is new: partial aggregates, merged batch by batch.

Of each topic and hour it keeps counts, sums, maxima and the newest time, and of each topic the seeds. A batch's events
that were seen before, in an earlier batch, are left out; late ones go to their own hour. The sums of a batch are merged
with those of the keys that it touches. Each table is a keyed store that takes a batch in once, and an event remembers the
batch that it came in, so a batch that is repeated after a crash between the tables completes what is missing and adds
nothing twice. The result equals an aggregation of all events anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake import schemas as S
from siftlake.operators.monitor import mean, snapshots
from siftlake.session import cut
from siftlake.sources.keyed import KeyedStore


class TopicModel:
    """Counts, seeds, mean and best score of topics, and their activity by hour."""

    def __init__(self, spark: SparkSession, path: str, writer: str = "events") -> None:
        self.writer = writer
        self.seen = KeyedStore(spark, f"{path}/seen", ["event_id"], [])
        self.hours = KeyedStore(spark, f"{path}/hours", ["topic", "hour"], ["batch"])
        self.seeds = KeyedStore(spark, f"{path}/seeds", ["topic", "seed_id"], [])

    def take(self, batch: DataFrame, batch_id: int) -> None:
        """A batch of events, in the order of batch_id; also for foreachBatch."""
        topic, hour = F.coalesce("topic", F.lit(S.NO_TOPIC)).alias("topic"), F.date_trunc("hour", "created_at").alias("hour")
        rows = snapshots(batch).dropDuplicates(["event_id"]).select("event_id", topic, hour, "seed_id", "score", "created_at")
        before = self.seen.read()
        if before is not None:
            rows = rows.join(before.where(F.col("batch") < batch_id).select("event_id"), "event_id", "left_anti")
        new = cut(rows)
        # First the events, which say what a repeated batch is made of; an event of two batches stays with the first.
        self.seen.upsert(new.select("event_id", F.lit(batch_id).cast("long").alias("batch")), self.writer, batch_id)
        self.seeds.upsert(new.where("seed_id IS NOT NULL").select("topic", "seed_id").distinct(), self.writer, batch_id)
        sums = new.groupBy("topic", "hour").agg(F.count("*").alias("n"), F.count("score").alias("scored"), F.sum("score").alias("total"), F.max("score").alias("best"), F.max("created_at").alias("newest"))
        held = self.hours.read()
        if held is not None:
            # A key is written once a batch, so a batch that is repeated finds what it has written itself, and is passed over by the store.
            touched = held.join(F.broadcast(sums.select("topic", "hour")) if sums.count() <= 100_000 else sums.select("topic", "hour"), ["topic", "hour"], "left_semi")
            sums = sums.unionByName(touched.drop("batch")).groupBy("topic", "hour").agg(*(F.sum(c).alias(c) for c in ("n", "scored", "total")), F.max("best").alias("best"), F.max("newest").alias("newest"))
        self.hours.upsert(sums.withColumn("batch", F.lit(batch_id).cast("long")), self.writer, batch_id)

    def topics(self) -> DataFrame:
        """topic, n, seeds, avg_score, best_score."""
        sums = self.hours.read().groupBy("topic").agg(F.sum("n").alias("n"), F.round(F.sum("total") / F.sum("scored"), 6).alias("avg_score"), F.max("best").alias("best_score"))
        seeds = self.seeds.read().groupBy("topic").agg(F.count("*").alias("seeds"))
        return sums.join(seeds, "topic", "left").select("topic", "n", F.coalesce("seeds", F.lit(0)).alias("seeds"), "avg_score", "best_score")

    def activity(self) -> DataFrame:
        """topic, hour, n, avg_score, best_score."""
        return self.hours.read().select("topic", "hour", "n", F.round(F.col("total") / F.col("scored"), 6).alias("avg_score"), F.col("best").alias("best_score"))


def recomputed(events: DataFrame) -> DataFrame:
    """What activity() gives, from all events."""
    topic = F.coalesce("topic", F.lit(S.NO_TOPIC))
    return snapshots(events).groupBy(topic.alias("topic"), F.date_trunc("hour", "created_at").alias("hour")).agg(F.count("*").alias("n"), mean("score").alias("avg_score"), F.max("score").alias("best_score"))
