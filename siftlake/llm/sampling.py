"""Bounded samples of labelled rows and examples, the same for the same rows however they are dealt."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_RANGE = 1 << 31


def least_hashed(rows: DataFrame, columns: list[str], most: int, distinct: bool = False) -> DataFrame:
    """At most so many rows, those of the least hash of the columns, ties by the columns; each row once if distinct.

    A threshold of the hash leaves four times as many as are asked for before any are sorted, so what a task keeps and
    the driver is sent is bounded, and doesn't grow with the number of tasks. Of fewer rows all stay.
    """
    place = F.pmod(F.xxhash64(*columns), F.lit(_RANGE))
    share = min(4 * most / max(rows.count(), 1), 1.0)
    few = rows.where(place < int(share * _RANGE)) if share < 1 else rows
    few = few.distinct() if distinct else few
    return few.orderBy(place, *columns).limit(most)
