"""A durable table of rows by key: bucketed files, rewritten by bucket, with versions that a batch makes once.

Rows stand in a bucket by the hash of their key. An upsert reads and writes only the buckets that its batch touches; the
other buckets' files are taken over by name. A version is one small file that names each bucket's folder and the last
batch of each writer, and is created only if no other writer made that version first. So a batch that comes again changes
nothing, readers keep the version that they began with, and a lost executor costs a task of one batch.

Folders may lie in any store that Spark reaches. Folders of old versions stay until they are removed from outside.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftlake.session import cut

BUCKETS = 64
#: Attempts to make the next version while others do.
ATTEMPTS = 20


class KeyedStore:
    """Rows by key (columns keys). Of rows with one key the last in order holds; in equal order the later batch's does."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: list[str], buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.keys, self.order, self.buckets = spark, path.rstrip("/"), keys, order, buckets
        self.files = spark._jvm.org.apache.hadoop.fs
        self.fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.files.Path(name)

    def version(self) -> tuple[int, dict]:
        """The newest version and what it names; -1 before the first."""
        log = self._path(f"{self.path}/log")
        names = [f.getPath().getName() for f in self.fs.listStatus(log)] if self.fs.exists(log) else []
        numbers = [int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_"))]
        if not numbers:
            return -1, {"schema": None, "buckets": {}, "applied": {}}
        return max(numbers), json.loads(self.spark.read.text(f"{self.path}/log/{max(numbers):020d}.json", wholetext=True).first()[0])

    def _create(self, number: int, content: dict) -> bool:
        """Makes a version unless another writer has."""
        draft, final = self._path(f"{self.path}/drafts/{uuid.uuid4().hex}"), self._path(f"{self.path}/log/{number:020d}.json")
        for folder in ("drafts", "log"):
            self.fs.mkdirs(self._path(f"{self.path}/{folder}"))
        out = self.fs.create(draft, False)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        # A rename onto a name that is there fails, so a version is whole and made by one.
        return not self.fs.exists(final) and self.fs.rename(draft, final)

    def read(self) -> DataFrame | None:
        """The rows of the newest version; None before the first."""
        _, at = self.version()
        return self._rows(at, sorted(at["buckets"])) if at["schema"] else None

    def _rows(self, at: dict, buckets: list[str]) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(at["schema"]))
        paths = [f"{self.path}/{at['buckets'][b]}" for b in buckets if b in at["buckets"]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def upsert(self, batch: DataFrame, writer: str | None = None, batch_id: int | None = None) -> list[int]:
        """Takes the rows of a batch in; the buckets that were rewritten. A batch that this writer's number says was taken in changes nothing."""
        batch = batch.where(F.forall(F.array(*(F.col(k).isNotNull() for k in self.keys)), lambda x: x))
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        new = cut(batch.withColumns({"_bucket": bucket, "_new": F.lit(1)}))
        # At most as many rows as there are buckets.
        touched = sorted(r[0] for r in new.select("_bucket").distinct().collect())
        for _ in range(ATTEMPTS):
            number, at = self.version()
            if writer is not None and batch_id is not None and at["applied"].get(writer, -1) >= batch_id:
                return []
            content = {"schema": at["schema"] or json.dumps(batch.schema.jsonValue()), "buckets": dict(at["buckets"]), "applied": dict(at["applied"])}
            if writer is not None and batch_id is not None:
                content["applied"][writer] = batch_id
            if touched:
                rows = new
                if at["schema"]:
                    rows = self._rows(at, [str(b) for b in touched]).withColumns({"_bucket": bucket, "_new": F.lit(0)}).unionByName(new, allowMissingColumns=True)
                    content["schema"] = json.dumps(rows.drop("_bucket", "_new").schema.jsonValue())
                last = Window.partitionBy("_bucket", *self.keys).orderBy(*(F.desc_nulls_last(c) for c in self.order), F.desc("_new"))
                kept = rows.withColumn("_rank", F.row_number().over(last)).where("_rank = 1").drop("_rank", "_new")
                folder = f"data/{uuid.uuid4().hex}"
                # A bucket is a file, or several if it is large.
                kept.hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
                content["buckets"] |= {str(b): f"{folder}/_bucket={b}" for b in touched}
            if self._create(number + 1, content):
                return touched
        raise RuntimeError(f"no version could be made in {ATTEMPTS} attempts: too many writers")

    def sink(self, writer: str) -> Callable[[DataFrame, int], None]:
        """For foreachBatch: each micro-batch is taken in once, whatever is repeated after a crash."""
        return lambda batch, batch_id: self.upsert(batch, writer, batch_id) and None
