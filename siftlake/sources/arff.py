"""ARFF data sets: header-declared attributes, the class last."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ATTRIBUTE = re.compile(r"""@attribute\s+('[^']*'|"[^"]*"|\S+)\s+(.+)""", re.I)
#: Most attributes of a file; one of more is refused, as its header is held by the driver.
ATTRIBUTES = 100_000


@dataclass(frozen=True)
class Attribute:
    name: str
    values: tuple[str, ...] | None  # of a nominal attribute

    @property
    def numeric(self) -> bool:
        return self.values is None


def _unquoted(text: str) -> str:
    text = text.strip()
    return text[1:-1] if len(text) > 1 and text[0] == text[-1] and text[0] in "'\"" else text


def header(spark: SparkSession, path: str) -> list[Attribute]:
    """The attributes of a file, read through Spark; only lines of the header are collected."""
    lines = spark.read.text(path).where(F.lower(F.trim("value")).startswith("@attribute")).limit(ATTRIBUTES + 1).collect()
    if len(lines) > ATTRIBUTES:
        raise ValueError(f"more than {ATTRIBUTES} attributes in {path}")
    return [a for a in (attribute_of(line.strip()) for (line,) in lines) if a]


def attribute_of(line: str) -> Attribute | None:
    """The attribute that a line declares, if it does: numeric, nominal with its values, or any other kind as text."""
    m = ATTRIBUTE.match(line)
    if not m:
        return None
    kind = m[2].strip()
    if kind.startswith("{"):
        return Attribute(_unquoted(m[1]), tuple(_unquoted(v) for v in kind[1 : kind.rindex("}")].split(",")))
    return Attribute(_unquoted(m[1]), None if kind.split()[0].lower() in ("numeric", "real", "integer") else ())


def read(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a file: numbers as double, all else as string; ? is null; a nominal column's values are in its metadata.

    The class is the last column. Declarations, blank lines and % comments are no rows; any other line is, one that
    begins with @ included.
    """
    attributes = header(spark, path)
    line = F.trim("value")
    declares = F.lower(line).rlike(r"^@(relation|attribute)\s|^@data\s*$")
    rows = spark.read.text(path).where((line != "") & ~line.startswith("%") & ~declares)
    parsed = rows.select(F.from_csv("value", ", ".join(f"`{a.name}` string" for a in attributes), {"quote": "'", "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}).alias("r"))
    out = []
    for place, a in enumerate(attributes):
        value = F.nullif(F.col("r").getField(a.name), F.lit("?"))
        meta = {"class": place == len(attributes) - 1} | ({"values": list(a.values)} if a.values else {})
        out.append((value.try_cast("double") if a.numeric else value).alias(a.name, metadata=meta))
    return parsed.select(*out)


def subset(data: DataFrame, features: list[int]) -> DataFrame:
    """The listed columns (places from 1) and the class; what is out of range, or the class itself, is passed over.

    As many features as columns, or more, are an error. The choice reaches the scan.
    """
    if len(data.columns) <= len(features):
        raise ValueError("as many features as attributes")
    own = [data.columns[f - 1] for f in sorted(set(features)) if 1 <= f < len(data.columns)]
    return data.select(*(F.col(f"`{c}`") for c in [*own, data.columns[-1]]))


def write(data: DataFrame, path: str, relation: str = "data") -> None:
    """A DataFrame as ARFF: numbers are numeric, other columns nominal by their distinct values; the class is the last column."""
    kinds = dict(data.dtypes)
    nominal = [c for c in data.columns if kinds[c] not in ("double", "float", "int", "bigint", "smallint")]
    values = data.agg(*(F.sort_array(F.collect_set(F.col(f"`{c}`"))).alias(c) for c in nominal)).first() if nominal else {}
    declared = [f"@attribute '{c}' " + ("{" + ",".join(map(str, values[c])) + "}" if c in nominal else "numeric") for c in data.columns]
    lines = [f"@relation {relation}", "", *declared, "", "@data"]
    spark = data.sparkSession
    rows = data.select(F.concat_ws(",", *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("?")) for c in data.columns)).alias("value"))
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).unionByName(rows).write.mode("overwrite").text(path)


class Cache:
    """Data sets kept by path, length and time of change; a changed file replaces what was kept of it."""

    def __init__(self) -> None:
        self.kept: dict[str, tuple[tuple, DataFrame]] = {}

    def get(self, spark: SparkSession, path: str) -> DataFrame:
        files = spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime").orderBy("path").collect()
        state = tuple(tuple(f) for f in files)
        if path in self.kept:
            if self.kept[path][0] == state:
                return self.kept[path][1]
            self.kept.pop(path)[1].unpersist()
        data = read(spark, path).persist(StorageLevel.MEMORY_AND_DISK)
        self.kept[path] = (state, data)
        return data
