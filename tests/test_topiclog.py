"""The topic log: offsets, groups, replays and crashes."""

import os

import pytest
from pyspark.sql import functions as F

from siftlake.sources.topiclog import Log, TopicLog


@pytest.fixture
def log(spark, tmp_path):
    spark.dataSource.register(TopicLog)
    (tmp_path / "in").mkdir()
    for k in range(4):
        (tmp_path / "in" / f"{k}.txt").write_text("\n".join(f"T{n % 2}|k{n % 7}|{k}-{n}" for n in range(50)) + "\n")
        os.utime(tmp_path / "in" / f"{k}.txt", (1_000_000 + k, 1_000_000 + k))  # the files are taken in order of time
    return tmp_path


def produce(spark, folder, name="p", files=1, checkpoint="out"):
    parts = F.split("value", r"\|")
    rows = spark.readStream.option("maxFilesPerTrigger", files).text(f"{folder}/in").select(parts[0].alias("topic"), parts[1].alias("key"), parts[2].alias("value"))
    rows.writeStream.format("topiclog").option("path", f"{folder}/log").option("producer", name).option("partitions", 3).option("checkpointLocation", f"{folder}/{checkpoint}").trigger(availableNow=True).start().awaitTermination(120)


def table(spark, folder, **options):
    return spark.read.format("topiclog").options(path=f"{folder}/log", **options).load()


def consume(spark, folder, checkpoint, out, **options):
    rows = spark.readStream.format("topiclog").options(path=f"{folder}/log", **options).load()
    rows.writeStream.format("parquet").option("path", f"{folder}/{out}").option("checkpointLocation", f"{folder}/{checkpoint}").trigger(once=True).start().awaitTermination(120)
    return sorted(tuple(r) for r in spark.read.schema(rows.schema).parquet(f"{folder}/{out}").collect())


def test_offsets_keys_and_order(spark, log):
    produce(spark, log)
    rows = sorted(tuple(r) for r in table(spark, log).collect())
    assert len(rows) == 200 and len({r[4] for r in rows}) == 200
    for place in {(r[0], r[1]) for r in rows}:
        own = [r for r in rows if (r[0], r[1]) == place]
        assert [r[2] for r in own] == list(range(len(own)))
        for key in {r[3] for r in own}:
            assert [r[4].split("-")[0] for r in own if r[3] == key] == sorted(r[4].split("-")[0] for r in own if r[3] == key)
    assert all(len({r[1] for r in rows if (r[0], r[3]) == k}) == 1 for k in {(r[0], r[3]) for r in rows})
    assert table(spark, log, topics="T1").count() == 100 and table(spark, log, topics="none").count() == 0


def test_repeated_batches_write_nothing(spark, log):
    produce(spark, log)
    before = sorted(tuple(r) for r in table(spark, log).collect())
    # a crash after the last batch was taken in, before the query noted it: the batch runs again
    commits = log / "out" / "commits"
    last = max(commits.iterdir(), key=lambda p: int(p.name) if p.name.isdigit() else -1)
    os.unlink(last)
    for crc in commits.glob(f".{last.name}.crc"):
        os.unlink(crc)
    produce(spark, log)
    # the whole query again, from its beginning
    produce(spark, log, checkpoint="again")
    assert sorted(tuple(r) for r in table(spark, log).collect()) == before
    # another producer's messages are its own
    produce(spark, log, name="q", files=4, checkpoint="other")
    assert table(spark, log).count() == 400


def test_a_failed_task_leaves_nothing(spark, log):
    produce(spark, log)
    rows = spark.readStream.text(f"{log}/in").select(F.lit("T0").alias("topic"), F.when(F.col("value").contains("3-49"), F.raise_error(F.lit("no"))).otherwise("k").alias("key"), "value")
    query = rows.writeStream.format("topiclog").option("path", f"{log}/log").option("producer", "bad").option("checkpointLocation", f"{log}/bad").trigger(availableNow=True).start()
    with pytest.raises(Exception):
        query.awaitTermination(120)
    assert table(spark, log).count() == 200


def test_groups_and_replay(spark, log):
    produce(spark, log)
    first = consume(spark, log, "c1", "o1", group="g")
    assert len(first) == 200
    # the group goes on after the last batch that its query has left behind, under another checkpoint; a new group, or earliest, begins at the beginning
    (log / "in" / "more.txt").write_text("T0|k1|new\n")
    produce(spark, log)
    assert len(consume(spark, log, "c1", "o1", group="g")) == 201
    assert [r[4] for r in consume(spark, log, "c2", "o2", group="g")] == ["new"]
    assert len(consume(spark, log, "c3", "o3", group="h")) == 201 and len(consume(spark, log, "c4", "o4", group="g", startingOffsets="earliest")) == 201
    assert consume(spark, log, "c5", "o5", startingOffsets="latest") == []
    # the same checkpoint reads only what is new
    (log / "in" / "most.txt").write_text("T1|k1|newer\n")
    produce(spark, log)
    assert len(consume(spark, log, "c3", "o3", group="h")) == 202


def test_bounded_batches(spark, log):
    produce(spark, log)
    seen = []
    for _ in range(5):
        seen.append(len(consume(spark, log, "c", "o", messagesPerTrigger=60)))
    assert seen == [60, 120, 180, 200, 200]


def test_versions_are_made_once(tmp_path):
    log = Log(f"file:{tmp_path}")
    assert log.last() == -1 and log.make(0, {"ends": {"a/0": 3}, "producers": {}, "segments": []}) and not log.make(0, {})
    assert log.at(0)["ends"] == {"a/0": 3} and log.committed("g") is None and sorted(os.listdir(tmp_path / "versions")) == [f"{0:020d}.json"]
