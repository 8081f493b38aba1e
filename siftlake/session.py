"""Session construction and the few run-time facts every operator needs."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


ROOT = Path(__file__).resolve().parent.parent


def build_session(cpus: int | None = None, app: str = "siftlake", **conf: str) -> SparkSession:
    """A local session with the settings the library is tested under; a cluster brings its own."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.executorEnv.PYTHONPATH", str(ROOT))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors of a cluster that hasn't got it installed: call once, before the first query."""
    package = Path(tempfile.mkdtemp(prefix="siftlake-package-")) / "siftlake.zip"
    with zipfile.ZipFile(package, "w") as archive:
        for file in sorted((ROOT / "siftlake").rglob("*.py")):
            archive.write(file, file.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(package))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, read through Spark so that any store it can reach works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a local session, as in tests, gets one of our own without it."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="siftlake-checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: its lineage ends there, and a lost executor costs nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
