"""Typed extraction from a schemaless JSON payload.

A value may stand at several paths. The first path that holds any value, an empty string included, decides; an empty
string then counts as missing. Numbers are plain decimals only (no exponent, sign +, or bare point).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PLAIN_NUMBER = r"^-?[0-9]+(\.[0-9]+)?$"


def nested(name: str, history: bool = True) -> list[str]:
    """The places where a field may stand: in the wrapped or bare history entry, wrapped, bare."""
    wrapped = [f"$.payload.historyEntry.{name}"] if history else []
    bare = [f"$.historyEntry.{name}"] if history else []
    return [*wrapped, f"$.payload.{name}", *bare, f"$.{name}"]


def first_of(payload: str | Column, paths: list[str]) -> Column:
    column = F.col(payload) if isinstance(payload, str) else payload
    return F.nullif(F.coalesce(*(F.get_json_object(column, p) for p in paths)), F.lit(""))


def number(value: Column) -> Column:
    """A plain decimal as double, else null."""
    return F.when(value.rlike(PLAIN_NUMBER), value.try_cast("double"))


def score(payload: str | Column = "payload") -> Column:
    return number(first_of(payload, [f"$.{where}{name}" for where in ("payload.", "") for name in ("historyEntry.f1Score", "bestF1Score", "currentF1Score", "f1Score")]))


def text_or(payload: str | Column, paths: list[str], default: str) -> Column:
    return F.coalesce(first_of(payload, paths), F.lit(default))


def int_array(payload: str | Column, paths: list[str]) -> Column:
    column = F.col(payload) if isinstance(payload, str) else payload
    return F.from_json(F.coalesce(*(F.get_json_object(column, p) for p in paths)), "array<int>")


#: Fields of a search snapshot, and of the history entry that it may hold.
HISTORY = (
    "f1Score", "cpuUsage", "memoryUsage", "memoryUsagePercent", "localSearch", "neighborhood", "stage", "status", "topic", "requestId", "iterationNeighborhood", "iterationLocalSearch",
    "previousBestF1Score", "scoreDelta", "improved", "solutionFeatures", "rclFeatures", "enabledLocalSearches", "solutionSize", "rclSize",
)
FIELDS = (*HISTORY, "bestF1Score", "currentF1Score", "seedId", "rclAlgorithm", "classifier", "classfier", "trainingFileName", "testingFileName", "createdAt", "updatedAt")


def parsed(payload: str = "payload") -> Column:
    """The payload as one struct of texts, so that the JSON is read once for all fields.

    Two spellings of the candidate list that differ by case alone, which a struct can't tell apart, are made one before.
    """
    text = F.regexp_replace(F.col(payload), '"rclfeatures"', '"rclFeatures"')
    history = "historyEntry struct<" + ", ".join(f"{f}: string" for f in HISTORY) + ">"
    fields = ", ".join([*(f"{f}: string" for f in FIELDS), history])
    return F.from_json(text, f"payload struct<{fields}>, " + ", ".join([*(f"{f} string" for f in FIELDS), history]))


def pick(struct: str, paths: list[str]) -> Column:
    """As first_of, over the struct of parsed()."""
    return F.nullif(F.coalesce(*(F.col(f"{struct}{p[1:]}") for p in paths)), F.lit(""))
