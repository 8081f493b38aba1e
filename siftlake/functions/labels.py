"""Scalar normalisers and labels used by the monitoring operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftlake import schemas as S


def present(column: Column, default: str) -> Column:
    return F.coalesce(F.nullif(F.trim(column), F.lit("")), F.lit(default))


def topic_priority(topic: Column) -> Column:
    return F.when(topic.isin(S.BEST, S.SOLUTIONS), 2).when(topic == S.PROGRESS, 1).otherwise(0)


def stage_of(topic: Column, local_search: Column) -> Column:
    """Stage of a message, by its topic and, for a search's messages, the search."""
    return (
        F.when(topic == S.INITIAL, "initial_solution")
        .when(topic == S.RESTART, "neighborhood_restart")
        .when(topic == S.BEST, "best_solution")
        .when(topic.isin(S.PROGRESS, S.SOLUTIONS), F.lower(F.coalesce(F.nullif(local_search, F.lit("")), F.lit("local_search"))))
        .otherwise("unknown")
    )


def dataset_pair(training: Column, testing: Column) -> Column:
    return F.concat_ws("|", present(training, S.NO_FILE), present(testing, S.NO_FILE))


def byte_size(n: Column) -> Column:
    """Bytes as B, KB, MB, GB or TB: two digits below ten of a unit, else one."""
    unit = F.least(F.floor(F.log(1024.0, F.greatest(n, F.lit(1)))), F.lit(4)).cast("int")
    value = n / F.pow(F.lit(1024.0), unit)
    shown = F.when(unit == 0, F.format_string("%d", n.cast("long"))).when(value < 10, F.format_string("%.2f", value)).otherwise(F.format_string("%.1f", value))
    return F.concat_ws(" ", shown, F.element_at(F.array(*map(F.lit, ("B", "KB", "MB", "GB", "TB"))), unit + 1))


def slug(column: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(column)), r"[^\w-]+", "-"), r"^-+|-+$", "")


def export_name(prefix: str, parts: list[Column], extension: str) -> Column:
    """File name of an export: the non-empty slugs joined by hyphens."""
    slugs = [F.nullif(slug(p), F.lit("")) for p in parts]
    return F.concat(F.concat_ws("-", F.lit(prefix), *slugs), F.lit(f".{extension}"))


def role_of(name: Column) -> Column:
    return F.when(name.rlike("(?i)train(ing)?"), "training").when(name.rlike("(?i)test(ing)?"), "testing").otherwise("unspecified")


def family_key(name: Column) -> Column:
    """A dataset's name without extension, role words and separators."""
    stem = F.regexp_replace(F.lower(name), r"\.[^.]+$", "")
    return F.regexp_replace(F.regexp_replace(stem, r"train(ing)?|test(ing)?", ""), r"[^a-z0-9]+", "")


def feature_list(text: Column) -> Column:
    """Items of a list written with white space or commas."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\s,\[\]]+"), lambda x: x != "")


def is_terminal(topic: Column, neighborhood: Column, iteration: Column, cycles: Column, searches: Column) -> Column:
    """Whether a SOLUTIONS message ends its run: VND after cycles x searches steps, RVND after cycles."""
    budget = F.when(F.upper(neighborhood) == "VND", F.greatest(cycles, F.lit(1)) * F.greatest(searches, F.lit(1))).otherwise(F.greatest(cycles, F.lit(1)))
    return (topic == S.SOLUTIONS) & F.coalesce(iteration >= budget, F.lit(False))


def is_processing(topic: Column, status: Column, terminal: Column) -> Column:
    """Whether a message shows that its seed is still worked on."""
    done = F.lower(F.coalesce(status, F.lit(""))) == "completed"
    return F.when(topic.isin(S.INITIAL, S.RESTART), True).when(topic == S.PROGRESS, ~done).when(topic == S.SOLUTIONS, ~terminal).otherwise(False)
