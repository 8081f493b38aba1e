"""ARFF as a data source: the header is read once, by the driver, and rows by splits of the files.

    spark.dataSource.register(ArffSource)
    spark.read.format("arff").load(path)                              # all attributes, the class last
    spark.read.format("arff").option("features", "1,3").load(path)    # these places and the class; others aren't parsed

Rows, types, nulls and metadata are those of arff.read(). The files lie in a folder, or are one file, that the driver and
all executors mount. splitBytes bounds a split; a line belongs to the split that it begins in.
"""

from __future__ import annotations

import csv
import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from siftlake.sources.arff import ATTRIBUTES, Attribute, attribute_of

SPLIT_BYTES = 32 << 20
ROWS = 10_000
_DECLARES = ("@relation ", "@relation\t", "@attribute ", "@attribute\t")


def _plain(path: str) -> str:
    return path.removeprefix("file://") if path.startswith("file:///") else path.removeprefix("file:")


def files_of(path: str) -> list[str]:
    path = _plain(path)
    if not os.path.isdir(path):
        return [path]
    return sorted(os.path.join(path, n) for n in os.listdir(path) if not n.startswith(("_", ".")) and os.path.isfile(os.path.join(path, n)))


def read_header(files: list[str]) -> list[Attribute]:
    """The attributes that the first file with any declares; of a file no line after @data is read."""
    for name in files:
        out: list[Attribute] = []
        with open(name, encoding="utf-8") as file:
            for line in file:
                text = line.strip()
                if text and not text.startswith(("%", "@")):
                    break
                if text.lower().startswith("@data"):
                    break
                found = attribute_of(text)
                if found:
                    out.append(found)
                if len(out) > ATTRIBUTES:
                    raise ValueError(f"more than {ATTRIBUTES} attributes in {name}")
        if out:
            return out
    return []


@dataclass
class Split(InputPartition):
    file: str
    start: int
    end: int


class ArffReader(DataSourceReader):
    def __init__(self, files: list[str], attributes: list[Attribute], chosen: list[int], split: int) -> None:
        self.files, self.attributes, self.chosen, self.split = files, attributes, chosen, split

    def partitions(self) -> list[InputPartition]:
        return [Split(f, at, min(at + self.split, size)) for f in self.files for size in [os.path.getsize(f)] for at in range(0, size, self.split)] or [Split("", 0, 0)]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        rows: list[list[str]] = []
        for line in _lines(partition):
            text = line.strip()
            low = text.lower()
            if text and not text.startswith("%") and not low.startswith(_DECLARES) and low.rstrip() != "@data":
                rows.append(next(csv.reader([text], quotechar="'", skipinitialspace=True, escapechar="\\")))
                if len(rows) >= ROWS:
                    yield self._batch(rows)
                    rows = []
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[list[str]]) -> pa.RecordBatch:
        columns = []
        for k in self.chosen:
            values = [v if v not in ("?", "") else None for v in (r[k].strip() if k < len(r) else None for r in rows)]
            numeric = self.attributes[k].numeric
            columns.append(pa.array([_number(v) for v in values] if numeric else values, pa.float64() if numeric else pa.string()))
        return pa.RecordBatch.from_arrays(columns, [self.attributes[k].name for k in self.chosen])


def _number(text: str | None) -> float | None:
    try:
        return None if text is None else float(text)
    except ValueError:
        return None


def _lines(split: Split) -> Iterator[str]:
    """The lines that begin in a split."""
    if not split.file:
        return
    with open(split.file, "rb") as file:
        if split.start:
            # The line that the byte before belongs to is the split's before.
            file.seek(split.start - 1)
            file.readline()
        while file.tell() < split.end:
            line = file.readline()
            if not line:
                return
            yield line.decode("utf-8")


class ArffSource(DataSource):
    def __init__(self, options: dict[str, str]) -> None:
        super().__init__(options)
        own = {k.lower(): v for k, v in options.items()}
        self.files = files_of(own["path"])
        self.attributes = read_header(self.files)
        last = len(self.attributes) - 1
        places = sorted({int(p) - 1 for p in own["features"].split(",") if p.strip()}) if "features" in own else range(last)
        if "features" in own and len(own["features"].split(",")) >= len(self.attributes):
            raise ValueError("as many features as attributes")
        self.chosen = [k for k in places if 0 <= k < last] + ([last] if last >= 0 else [])
        self.split = int(own.get("splitbytes", SPLIT_BYTES))

    @classmethod
    def name(cls) -> str:
        return "arff"

    def schema(self) -> T.StructType:
        fields = []
        for k in self.chosen:
            a = self.attributes[k]
            meta = {"class": k == len(self.attributes) - 1} | ({"values": list(a.values)} if a.values else {})
            fields.append(T.StructField(a.name, T.DoubleType() if a.numeric else T.StringType(), True, meta))
        return T.StructType(fields)

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return ArffReader(self.files, self.attributes, self.chosen, self.split)
