"""A folder of data sets: listing, text profiles, suggested pairs, summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftlake.functions import labels
from siftlake.sources.keyed import KeyedStore

EXTENSIONS = ("arff", "csv", "data", "txt")
PREVIEW, NOMINAL = 8, 12


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """name, path, extension, bytes, size label, change time, role and family of each data set file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length", "modificationTime")
    name = F.element_at(F.split("path", "/"), -1)
    rows = files.select(name.alias("name"), "path", F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("extension"), F.col("length").alias("bytes"), F.col("modificationTime").alias("changed_at"))
    return rows.where(F.col("extension").isin(*EXTENSIONS)).withColumns({"size": labels.byte_size(F.col("bytes")), "role": labels.role_of(F.col("name")), "family": labels.family_key(F.col("name"))})


def _plain_path(path: Column) -> Column:
    """A path as one text for one file: one slash after the scheme, no percent signs of an address."""
    return F.regexp_replace(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), "^([A-Za-z0-9]+):/+", "$1:/")


def _lines(spark: SparkSession, folder: str | list[str], extensions: tuple[str, ...]) -> DataFrame:
    """The lines of a folder, or of listed files, with their place."""
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    lines = spark.read.option("recursiveFileLookup", "true").text(folder).select(_plain_path(F.col("_metadata.file_path")).alias("path"), name.alias("name"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.trim("value").alias("line"))
    return lines.where(F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1)).isin(*extensions))


def profile_arff(spark: SparkSession, folder: str | list[str]) -> DataFrame:
    """Relation, attributes, instances, class attribute and values (of the class itself) of each ARFF file, in one pass over its lines."""
    rows = _lines(spark, folder, ("arff",)).where((F.col("line") != "") & ~F.col("line").startswith("%"))
    low = F.lower("line")
    declares = low.startswith("@attribute")
    attribute = F.regexp_extract("line", r"(?i)@attribute\s+('[^']*'|\"[^\"]*\"|\S+)\s+", 1)
    values = F.regexp_extract("line", r"\{(.*)\}", 1)
    last = F.struct("block", "at")
    out = rows.groupBy("path", "name").agg(
        F.max(F.when(low.startswith("@relation"), F.trim(F.regexp_replace("line", r"(?i)^@relation\s+", "")))).alias("relation"),
        F.count_if(declares).alias("attributes"),
        F.count_if(~F.col("line").startswith("@")).alias("instances"),
        F.max_by(F.when(declares, attribute), F.when(declares, last)).alias("class"),
        F.max_by(F.when(declares, values), F.when(declares, last)).alias("_values"),
    )
    split = F.filter(F.transform(F.split("_values", ","), lambda x: F.trim(x)), lambda x: x != "")
    return out.withColumn("class_values", F.slice(split, 1, NOMINAL)).drop("_values")


def profile_delimited(spark: SparkSession, folder: str | list[str]) -> DataFrame:
    """Attributes (of the first line), lines and a preview of the first values of each delimited file; # and % lines don't count."""
    rows = _lines(spark, folder, ("csv", "data", "txt")).where((F.col("line") != "") & ~F.col("line").rlike("^[#%]"))
    first = F.min_by("line", F.struct("block", "at"))
    out = rows.groupBy("path", "name").agg(first.alias("_first"), F.count("*").alias("instances"))
    cells = F.when(F.col("name").endswith(".csv"), F.split("_first", ",")).otherwise(F.split("_first", r"\s*,\s*|\s+"))
    return out.select("path", "name", F.size(cells).cast("long").alias("attributes"), "instances", F.transform(F.slice(cells, 1, PREVIEW), lambda x: F.trim(x)).alias("preview"))


PROFILE = ("relation", "attributes", "instances", "class", "class_values", "preview")


class Catalog:
    """A folder's data sets with their profiles, which are kept: only files that are new or changed are read again.

    Profiles are kept by path with the size and time of change of the file that they were made of. At most LISTED files
    are named to one scan.
    """

    LISTED = 100_000

    def __init__(self, spark: SparkSession, folder: str, kept: str) -> None:
        self.spark, self.folder = spark, folder
        self.store = KeyedStore(spark, kept, ["path"], ["changed_at"], buckets=16)
        self.scanned = 0

    def datasets(self) -> DataFrame:
        """The listing with profiles; of a file of a removed path nothing is shown."""
        found = listing(self.spark, self.folder)
        stored = self.store.read()
        new = found.select("path", "name", "extension", "bytes", "changed_at")
        if stored is not None:
            new = new.join(stored.select("path", "bytes", "changed_at"), ["path", "bytes", "changed_at"], "left_anti")
        rows = new.limit(self.LISTED + 1).collect()
        if len(rows) > self.LISTED:
            raise ValueError(f"more than {self.LISTED} new files at once")
        self.scanned = len(rows)
        if rows:
            self.store.upsert(self._profiles(self.spark.createDataFrame(rows, new.schema), [r.path for r in rows]))
        return found.join(self.store.read().select("path", "bytes", "changed_at", *PROFILE), ["path", "bytes", "changed_at"], "left") if stored is not None or rows else found

    def _profiles(self, files: DataFrame, paths: list[str]) -> DataFrame:
        ends = lambda *kinds: [p for p in paths if p.rsplit(".", 1)[-1].lower() in kinds]
        none = {"relation": "string", "class": "string", "class_values": "array<string>", "preview": "array<string>", "attributes": "long", "instances": "long"}
        parts: list[DataFrame] = []
        for profile, listed in ((profile_arff, ends("arff")), (profile_delimited, ends("csv", "data", "txt"))):
            if listed:
                own = profile(self.spark, listed)
                parts.append(own.select("path", *((F.col(c) if c in own.columns else F.lit(None)).cast(none[c]).alias(c) for c in PROFILE)))
        for part in parts[1:]:
            parts[0] = parts[0].unionByName(part)
        own = parts[0].withColumnRenamed("path", "_path")
        return files.join(own, _plain_path(F.col("path")) == F.col("_path"), "left").select("path", "bytes", "changed_at", *PROFILE)


#: Rows of a side of a family that meet in one cell.
SIDE = 1_024


def pairs(datasets: DataFrame) -> DataFrame:
    """Training and test files of a family, with the differences of their attributes and instances (columns name, family, role, attributes, instances).

    A family of more than SIDE files of a role is a grid of cells of about SIDE by SIDE files, and the cells are dealt over
    all shuffle partitions: what a task makes follows the pairs, not the bytes of the files' rows or the families.
    """
    n = int(datasets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = datasets.groupBy("family").agg(*(F.count_if(F.col("role") == role).alias(role) for role in ("training", "testing")))
    large = sizes.where(F.greatest("training", "testing") > SIDE).where(F.least("training", "testing") > 0)
    grid = F.broadcast(large.select("family", *(F.ceil(F.col(role) / SIDE).alias(f"_n_{role}") for role in ("training", "testing"))))

    def side(role: str, other: str) -> DataFrame:
        cells = lambda r: F.coalesce(f"_n_{r}", F.lit(1))
        rows = datasets.where(F.col("role") == role).join(grid, "family", "left")
        own, met = F.pmod(F.xxhash64("name", "attributes", "instances"), cells(role)), F.explode(F.sequence(F.lit(0), cells(other) - 1))
        rows = rows.select("family", *(F.col(c).alias(f"{role}_{c}") for c in ("name", "attributes", "instances")), own.alias(f"_{role}"), met.alias(f"_{other}"))
        return rows.repartition(n, "family", "_training", "_testing")

    both = side("training", "testing").join(side("testing", "training"), ["family", "_training", "_testing"])
    gap = lambda c: F.abs(F.col(f"training_{c}") - F.col(f"testing_{c}")).alias(f"{c}_gap")
    return both.select("family", "training_name", "testing_name", gap("attributes"), gap("instances"))


def best_pairs(datasets: DataFrame) -> DataFrame:
    """The closest test file of each training file: least attribute gap, then instance gap, then name."""
    rank = F.row_number().over(Window.partitionBy("family", "training_name").orderBy("attributes_gap", "instances_gap", "testing_name"))
    return pairs(datasets).withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def summary(datasets: DataFrame, suggested: DataFrame) -> DataFrame:
    """Files, bytes, instances, attributes, families, formats, the richest file and suggested pairs, as one row."""
    out = datasets.agg(
        F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.sum("instances").alias("instances"), F.sum("attributes").alias("attributes"), F.countDistinct("family").alias("families"),
        F.array_join(F.array_sort(F.collect_set("extension")), ",").alias("formats"), F.max_by("name", F.struct("attributes", "instances", "name")).alias("richest"),
    )
    return out.crossJoin(suggested.agg(F.count("*").alias("pairs")))
