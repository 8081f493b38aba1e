"""The event feed: optional filters, free text, pages, time ranges."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timezone
from functools import reduce
from math import ceil, floor, isfinite

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake import schemas as S
from siftlake.operators.monitor import latest, snapshots

SEARCHED = ("seed_id", "request_id", "topic", "stage", "rcl_algorithm", "local_search", "training_file_name", "testing_file_name")
PAGE, LARGEST_PAGE, EXPORT_CAP = 25, 100, 50_000
#: The states that a feed can be asked for.
STATES = ("REQUESTED", "RUNNING", "COMPLETED", "FAILED")


def _text(value: object) -> str:
    return "" if value is None else str(value).strip()


def names_of(value: object) -> list[str]:
    """Names once each, in order, of a list or of text with commas."""
    parts = value if isinstance(value, (list, tuple)) else value.split(",") if isinstance(value, str) else []
    return list(dict.fromkeys(t for t in map(_text, parts) if t))


def number_of(value: object) -> float | None:
    """A finite number, or None for anything else."""
    try:
        found = float(value) if value is not None and not isinstance(value, bool) and _text(value) else None
    except (TypeError, ValueError):
        return None
    return found if found is not None and isfinite(found) else None


def time_of(value: object) -> datetime | None:
    """A time in UTC, of ISO text, milliseconds since 1970 or a datetime, or None for anything else."""
    try:
        if isinstance(value, datetime):
            at = value
        elif isinstance(value, (int, float)) and not isinstance(value, bool) and value:
            at = datetime.fromtimestamp(value / 1000, timezone.utc)
        else:
            at = datetime.fromisoformat(_text(value))
    except (ValueError, OverflowError, OSError):
        return None
    return at.astimezone(timezone.utc).replace(tzinfo=None) if at.tzinfo else at


def files_of(key: object) -> tuple[str | None, str | None]:
    """Training and test file of a data set's key; "all", an empty side or the mark of a missing file doesn't filter."""
    text = _text(key)
    both = [*("" if text == "all" else text).split("|"), ""][:2]
    return tuple(t if t not in ("", S.NO_FILE) else None for t in both)


def page_of(options: dict) -> tuple[int, int]:
    """Number and size of a page: 1 and PAGE for what is no number from 1, and at most LARGEST_PAGE rows."""
    number, size = number_of(options.get("page")), number_of(options.get("pageSize"))
    return floor(number) if number is not None and number >= 1 else 1, min(floor(size), LARGEST_PAGE) if size is not None and size >= 1 else PAGE


@dataclass
class Filters:
    """The conjuncts of a feed; what is None or empty doesn't filter."""

    topics: list[str] = field(default_factory=list)
    seed_id: str | None = None
    request_id: str | None = None
    algorithm: str | None = None
    training: str | None = None
    testing: str | None = None
    status: str | None = None
    local_search: str | None = None
    since: datetime | None = None
    until: datetime | None = None
    text: str | None = None
    least_score: float | None = None
    greatest_score: float | None = None

    @classmethod
    def of(cls, options: dict) -> Filters:
        """Options as clients send them: text is trimmed, and what can't be read, or is no known state, doesn't filter."""
        training, testing = files_of(options.get("datasetKey"))
        state = _text(options.get("status")).upper()
        return cls(
            topics=names_of(options.get("topics")), seed_id=_text(options.get("seedId")) or None, request_id=_text(options.get("requestId")) or None, algorithm=_text(options.get("algorithm")) or None,
            training=training, testing=testing, status=state if state in STATES else None, local_search=_text(options.get("searchLabel")) or None, since=time_of(options.get("start")), until=time_of(options.get("end")),
            text=_text(options.get("query")) or None, least_score=number_of(options.get("minF1Score")), greatest_score=number_of(options.get("maxF1Score")),
        )

    def column(self) -> Column:
        c = F.col
        topic = F.coalesce("topic", F.lit(S.NO_TOPIC)) if S.NO_TOPIC in self.topics else c("topic")
        parts = [
            topic.isin(*dict.fromkeys(self.topics)) if self.topics else None,
            *(c(name) == value if value else None for name, value in (("seed_id", self.seed_id), ("request_id", self.request_id), ("rcl_algorithm", self.algorithm), ("training_file_name", self.training), ("testing_file_name", self.testing))),
            F.upper("status") == self.status.upper() if self.status else None,
            F.upper("local_search") == self.local_search.upper() if self.local_search else None,
            c("created_at") >= F.lit(self.since) if self.since else None,
            c("created_at") <= F.lit(self.until) if self.until else None,
            free_text(self.text) if self.text and self.text.strip() else None,
            c("score") >= self.least_score if self.least_score is not None else None,
            c("score") <= self.greatest_score if self.greatest_score is not None else None,
        ]
        return reduce(lambda a, b: a & b, [p for p in parts if p is not None], F.lit(True))


def free_text(query: str, columns: tuple[str, ...] = SEARCHED) -> Column:
    """Whether a column holds the query, case aside; % and _ are wild, as in LIKE."""
    pattern = f"%{query.strip().lower()}%"
    return reduce(lambda a, b: a | b, (F.lower(F.coalesce(c, F.lit(""))).like(pattern) for c in columns))


def within(column: str, since: datetime | None, until: datetime | None) -> Column:
    """A closed time range; a null time passes."""
    parts = [F.col(column) >= F.lit(since) if since else None, F.col(column) <= F.lit(until) if until else None]
    return F.col(column).isNull() | reduce(lambda a, b: a & b, [p for p in parts if p is not None], F.lit(True))


def anchored(events: DataFrame, hours: float, column: str = "created_at") -> DataFrame:
    """Events of the last hours before the newest one; the newest time is a one-row side of fixed size."""
    newest = events.agg(F.max(F.unix_micros(column)).alias("_newest"))
    return events.crossJoin(F.broadcast(newest)).where(F.unix_micros(column) >= F.col("_newest") - int(hours * 3_600_000_000)).drop("_newest")


def feed(events: DataFrame, filters: Filters) -> DataFrame:
    return snapshots(events).where(filters.column())


def count(events: DataFrame, filters: Filters) -> DataFrame:
    return feed(events, filters).agg(F.count("*").alias("n"))


def page(events: DataFrame, filters: Filters, number: int = 1, size: int = PAGE) -> DataFrame:
    """A page of the feed, newest first."""
    size = min(max(size, 1), LARGEST_PAGE)
    return feed(events, filters).orderBy(*latest()).offset((max(number, 1) - 1) * size).limit(size)


def pages(n: int, size: int = PAGE) -> int:
    return max(1, ceil(n / min(max(size, 1), LARGEST_PAGE)))


def export(events: DataFrame, filters: Filters, cap: int = EXPORT_CAP) -> DataFrame:
    return feed(events, filters).orderBy(*latest()).limit(cap)


def run_history(events: DataFrame, seed_id: str, types: list[str] | None = None, since: datetime | None = None, until: datetime | None = None) -> DataFrame:
    """The stored events of one run: of some types, within a closed range of time; a null time doesn't pass a range."""
    out = events.where(F.col("seed_id") == seed_id)
    out = out.where(F.col("event_type").isin(*dict.fromkeys(types))) if types else out
    out = out.where(F.col("created_at") >= F.lit(since)) if since else out
    return out.where(F.col("created_at") <= F.lit(until)) if until else out


def table_view(rows: DataFrame, key: str, query: str = "", sort: str | None = None, descending: bool = False, number: int = 1, size: int = PAGE) -> DataFrame:
    """A page of any table: rows in which some column holds the query, case aside, sorted by a column (null last), then by the key."""
    text = [F.lower(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))) for c, kind in rows.dtypes if not kind.startswith(("array", "struct", "map"))]
    found = rows.where(reduce(lambda a, b: a | b, (F.contains(t, F.lit(query.strip().lower())) for t in text))) if query.strip() else rows
    order = [(F.desc_nulls_last if descending else F.asc_nulls_last)(sort)] if sort else []
    return found.orderBy(*order, key).offset((max(number, 1) - 1) * max(size, 1)).limit(max(size, 1))
