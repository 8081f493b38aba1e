"""Searches that improve feature subsets; their state is a table.

A seed is a row: its features, the candidates left, its best score and where it is in its searches. The candidates of a
search don't depend on each other's scores, so each round writes them all down by array expressions, evaluates them in
one job, and joins the best back to the seeds. Whatever is random is drawn from a hash of the request's seed, the seed's
name and the step, so a search repeats itself on any cluster. Only the number of seeds that go on reaches the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake import schemas as S
from siftlake.operators import scoring
from siftlake.operators.evaluation import Problem, classifier, confusion, evaluate, evaluate_subsets, metrics
from siftlake.session import cut
from siftlake.sources import arff

__all__ = ["Launch", "Problem", "Request", "bit_flip", "boolean", "confusion", "construct", "evaluate", "evaluate_subsets", "execute", "incremental", "incremental_replace", "metrics", "run_search"]


def draw(*parts: Column | str | int) -> Column:
    """A number from 0 to 2**28 - 1 that depends on the parts only."""
    named = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("-", *(p.cast("string") for p in named))), 1, 7), 16, 10).cast("int")


def construct(spark: SparkSession, rcl: list[int], generations: int, sample: int, seed: int) -> DataFrame:
    """seed_id, features, rcl: randomised starts, each a sample without repetition from the candidate list; what was sampled leaves the list."""
    name = F.concat(F.lit(f"seed-{seed}-"), F.col("id").cast("string"))
    listed = F.array(*map(F.lit, rcl)).cast("array<int>")
    order = F.array_sort(F.transform(listed, lambda f: F.struct(draw("sample", F.col("seed_id"), f).alias("o"), f.alias("f"))))
    chosen = F.transform(F.slice(order, 1, sample), lambda x: x["f"])
    starts = spark.range(generations).select(name.alias("seed_id")).withColumn("features", chosen)
    return starts.withColumn("rcl", without(listed, F.col("features")))


def without(values: Column, others: Column) -> Column:
    """The values that aren't among others, in order."""
    return F.filter(values, lambda v: ~F.array_contains(others, v))


def _drop(values: Column, place: Column) -> Column:
    """The values without that at a place (from 0)."""
    return F.concat(F.slice(values, F.lit(1), place), F.slice(values, place + 2, F.size(values)))


def bit_flip(features: Column, rcl: Column, steps: int, seed_id: Column, iteration: Column) -> Column:
    """A random walk: each step swaps a random candidate in and a random earlier member out, and is never taken back."""
    none = F.array().cast("array<array<int>>")

    def step(state: Column, k: Column) -> Column:
        f, r = state["f"], state["r"]
        take, give = draw("in", seed_id, iteration, k) % F.size(r), draw("out", seed_id, iteration, k) % F.size(f)
        left = F.when(F.size(f) > 0, F.concat(_drop(r, take), F.array(F.get(f, give)))).otherwise(_drop(r, take))
        grown = F.concat(F.when(F.size(f) > 0, _drop(f, give)).otherwise(f), F.array(F.get(r, take)))
        new = F.struct(grown.alias("f"), left.alias("r"), F.concat(state["out"], F.array(grown)).alias("out"))
        return F.when(F.size(r) > 0, new).otherwise(state)

    start = F.struct(features.cast("array<int>").alias("f"), rcl.cast("array<int>").alias("r"), none.alias("out"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda state: state["out"])


def incremental(features: Column, rcl: Column, steps: int) -> Column:
    """Growing subsets: one candidate after another is appended, and kept even if that is worse."""
    n = F.least(F.lit(steps), F.size(rcl))
    grown = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: F.concat(features, F.slice(rcl, F.lit(1), k)))
    return F.when(n > 0, grown).otherwise(F.array().cast("array<array<int>>"))


def incremental_replace(features: Column, rcl: Column, steps: int) -> Column:
    """As incremental(), and for each step also the subsets without one of its members; these don't feed the next step."""

    def with_drops(grown: Column) -> Column:
        drops = F.transform(F.sequence(F.lit(0), F.size(grown) - 1), lambda k: _drop(grown, k))
        return F.concat(F.array(grown), F.when(F.size(grown) > 1, drops).otherwise(F.array().cast("array<array<int>>")))

    return F.flatten(F.transform(incremental(features, rcl, steps), with_drops))


def boolean(value: object) -> bool | None:
    """A boolean, or a word for one; None for anything else."""
    words = {"true": True, "1": True, "yes": True, "on": True, "false": False, "0": False, "no": False, "off": False}
    return value if isinstance(value, bool) else words.get(value.strip().lower()) if isinstance(value, str) else None


@dataclass
class Request:
    """Parameters of a search, normalised and checked."""

    generations: int = 10
    cutoff: int = 20
    sample: int = 5
    classifier: str = "J48"
    strategy: str = "VND"
    searches: list[str] = field(default_factory=lambda: list(S.LOCAL_SEARCHES))
    cycles: int = 10
    steps: dict[str, int] = field(default_factory=lambda: {"BIT_FLIP": 100, "IWSS": 20, "IWSSR": 20})
    seed: int = 1

    def __post_init__(self) -> None:
        for name in ("generations", "cutoff", "sample", "cycles"):
            if int(getattr(self, name)) <= 0:
                raise ValueError(f"{name} must be positive")
        self.strategy = self.strategy.strip().upper() or "VND"
        if self.strategy not in S.STRATEGIES:
            raise ValueError(f"no strategy {self.strategy!r}")
        known = [s for s in dict.fromkeys(x.strip().upper() for x in self.searches) if s in S.LOCAL_SEARCHES]
        self.searches = known or list(S.LOCAL_SEARCHES)
        classifier(self.classifier)


#: The scores by which a candidate list can be ranked, by the algorithm's name.
RANKINGS = {"IG": "info_gain", "GR": "gain_ratio", "SU": "symmetrical_uncertainty", "RF": "relieff"}
REQUIRED = ("maxGenerations", "rclCutoff", "sampleSize", "datasetTrainingName", "datasetTestingName")
OPTIONAL = ("neighborhoodMaxIterations", "bitFlipMaxIterations", "iwssMaxIterations", "iwssrMaxIterations")


@dataclass
class Launch:
    """A request as clients send it: algorithms, the two data sets, whether parsed data may be kept, and the search."""

    algorithms: list[str]
    training: str
    testing: str
    use_cache: bool
    search: Request

    @classmethod
    def of(cls, payload: dict) -> Launch:
        """A payload checked and normalised: required fields, positive integers, words for booleans, known names only."""
        empty = lambda c: payload.get(c) in (None, "")
        missing = [c for c in REQUIRED if empty(c)]
        if missing:
            raise ValueError(f"missing: {', '.join(missing)}")
        numbers = {}
        for c in (*REQUIRED[:3], *OPTIONAL):
            if not empty(c):
                value = float(payload[c])
                if value != int(value) or value <= 0:
                    raise ValueError(f"{c} must be a positive integer")
                numbers[c] = int(value)
        given = payload.get("algorithms") or list(RANKINGS)
        algorithms = [a for a in dict.fromkeys(str(x).strip().upper() for x in (given if isinstance(given, list) else [given])) if a in RANKINGS]
        if not algorithms:
            raise ValueError(f"no algorithm known; there are {sorted(RANKINGS)}")
        listed = payload.get("localSearches") or []
        wanted = [str(x).strip().upper() for x in (listed.split(",") if isinstance(listed, str) else listed)]
        searches = [x for x in dict.fromkeys(wanted) if x in S.LOCAL_SEARCHES]
        if wanted and not searches:
            raise ValueError("no local search known")
        cache = boolean(payload.get("useTrainingCache", False))
        if cache is None:
            raise ValueError("useTrainingCache must be true or false")
        steps = {"BIT_FLIP": numbers.get("bitFlipMaxIterations", 100), "IWSS": numbers.get("iwssMaxIterations", 20), "IWSSR": numbers.get("iwssrMaxIterations", 20)}
        search = Request(
            generations=numbers["maxGenerations"], cutoff=numbers["rclCutoff"], sample=numbers["sampleSize"], classifier=payload.get("classifier") or "J48", strategy=str(payload.get("neighborhoodStrategy") or "VND"),
            searches=searches or list(S.LOCAL_SEARCHES), cycles=numbers.get("neighborhoodMaxIterations", 10), steps=steps,
        )
        return cls(algorithms, payload["datasetTrainingName"], payload["datasetTestingName"], cache, search)


def execute(spark: SparkSession, folder: str, payload: dict, cache: arff.Cache | None = None) -> DataFrame:
    """The whole of a request: both data sets of a folder, the ranking of features by each algorithm, and its search.

    One row for each evaluated step, as run_search(), with the algorithm and the data sets. Nominal features are scored
    as they are, numeric ones by their cuts.
    """
    launch = Launch.of(payload)
    kept = cache or arff.Cache()
    load = lambda name: kept.get(spark, f"{folder}/{name}") if launch.use_cache else arff.read(spark, f"{folder}/{name}")
    train, test = load(launch.training), load(launch.testing)
    label, features = train.columns[-1], train.columns[:-1]
    numeric = [c for c, kind in train.dtypes if kind == "double" and c != label]
    nominal = [c for c in features if c not in numeric]
    values = (train.schema[label].metadata or {}).get("values") or [None]
    problem = Problem.of(_coded(train, label), _coded(test, label), values[0])
    out = None
    for algorithm in launch.algorithms:
        by = RANKINGS[algorithm]
        if algorithm == "RF":
            scored = scoring.relieff(train, numeric, label)
        else:
            parts = [scoring.scores(data, names, label) for data, names in ((train, nominal), (scoring.binned(train, numeric, label) if numeric else train, numeric)) if names]
            scored = parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0]
        ranked = [r.place for r in scoring.top_features(scored, by, features, launch.search.cutoff).collect()]
        found = run_search(spark, ranked, problem, launch.search).withColumns({"rcl_algorithm": F.lit(algorithm), "training_file_name": F.lit(launch.training), "testing_file_name": F.lit(launch.testing), "classifier": F.lit(launch.search.classifier)})
        out = found if out is None else out.unionByName(found)
    return out


def _coded(data: DataFrame, label: str) -> DataFrame:
    """Nominal features as the places of their values, so that classifiers get numbers; the class stays."""

    def code(c: str, kind: str):
        values = (data.schema[c].metadata or {}).get("values") or []
        return F.col(f"`{c}`") if c == label or kind == "double" else F.array_position(F.array(*map(F.lit, values)), F.col(f"`{c}`")).cast("double").alias(c) if values else F.lit(0.0).alias(c)

    return data.select(*(code(c, kind) for c, kind in data.dtypes))


STEPS = ("seed_id", "iteration", "topic", "local_search", "step", "features", "tp", "tn", "fp", "fn", "f1", "best_f1")


def run_search(spark: SparkSession, rcl: list[int], problem: Problem, request: Request) -> DataFrame:
    """Construction, evaluation and local searches of all seeds in bounded rounds; a row for every evaluated step.

    The start of a seed is iteration 0; each further iteration has its candidates in order (topic of progress) and, as
    step 0, its outcome: the best of them, earlier ones first. best_f1 is the seed's best before or, for an outcome,
    after it. VND goes through the searches in turn and starts again after a cycle that improved; RVND draws the next
    search at random. A round evaluates the current search of every active seed in one job.
    """
    listed = list(dict.fromkeys(rcl[: request.cutoff]))
    n = len(request.searches)
    vnd = request.strategy == "VND"
    budget = request.cycles * (n if vnd else 1)
    names = F.array(*map(F.lit, request.searches))
    counts = ["tp", "tn", "fp", "fn"]
    # The state has a row for each seed of a request: one partition holds it.
    first = cut(evaluate_subsets(construct(spark, listed, request.generations, request.sample, request.seed), problem, request.classifier).coalesce(1))
    start = {"iteration": F.lit(0), "topic": F.lit(S.INITIAL), "local_search": F.lit(""), "step": F.lit(0), "best_f1": F.col("f1")}
    steps = [first.withColumns(start).select(*STEPS)]
    state = first.select("seed_id", "features", "rcl", "f1", F.lit(0).alias("place"), F.lit(False).alias("gained"))
    for k in range(1, budget + 1):
        iteration = F.lit(k)
        search = F.get(names, F.col("place") if vnd else draw("next", request.seed, F.col("seed_id"), iteration) % n)
        chosen = state.withColumns({"iteration": iteration, "local_search": search})
        last = (F.col("features"), F.col("rcl"))
        ways = {"BIT_FLIP": bit_flip(*last, request.steps.get("BIT_FLIP", 20), F.col("seed_id"), iteration), "IWSS": incremental(*last, request.steps.get("IWSS", 20)), "IWSSR": incremental_replace(*last, request.steps.get("IWSSR", 20))}
        own = reduce(lambda e, name: e.when(F.col("local_search") == name, ways[name]), request.searches[1:], F.when(F.col("local_search") == request.searches[0], ways[request.searches[0]]))
        tried = chosen.select("seed_id", "iteration", "local_search", F.col("f1").alias("best_f1"), F.posexplode(own).alias("place", "features"))
        tried = cut(evaluate_subsets(tried.select("seed_id", "iteration", "local_search", "best_f1", (F.col("place") + 1).alias("step"), "features"), problem, request.classifier))
        best = tried.groupBy("seed_id").agg(F.max_by(F.struct("f1", "features", *counts), F.struct("f1", -F.col("step"))).alias("b"))
        joined = chosen.join(best, "seed_id", "left")
        f1 = F.coalesce("b.f1", "f1")
        better = f1 > F.col("f1")
        found = F.coalesce("b.features", "features")
        after = joined.select(
            "seed_id", "iteration", "local_search", found.alias("found"), f1.alias("found_f1"), *(F.col(f"b.{c}").alias(c) for c in counts), F.greatest(f1, "f1").alias("f1"),
            F.when(better, found).otherwise(F.col("features")).alias("features"), F.when(better, without(F.array(*map(F.lit, listed)).cast("array<int>"), found)).otherwise(F.col("rcl")).alias("rcl"),
            (F.col("place") + 1).alias("place"), (F.col("gained") | better).alias("gained"),
        )
        after = cut(after.coalesce(1))
        steps.append(tried.withColumn("topic", F.lit(S.PROGRESS)).select(*STEPS))
        steps.append(after.select("seed_id", "iteration", F.lit(S.SOLUTIONS).alias("topic"), "local_search", F.lit(0).alias("step"), F.col("found").alias("features"), *counts, F.col("found_f1").alias("f1"), F.col("f1").alias("best_f1")))
        state = after.select("seed_id", "features", "rcl", "f1", "place", "gained")
        if vnd:
            # A cycle that improved nothing ends the seed; another starts anew.
            ends = F.col("place") == n
            state = state.where(~ends | F.col("gained")).withColumns({"place": F.when(ends, 0).otherwise(F.col("place")), "gained": F.col("gained") & ~ends})
            if k % n == 0 and k < budget and state.isEmpty():
                break
    return reduce(DataFrame.unionByName, steps)
