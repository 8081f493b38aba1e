"""Quality rules: base statistics of a text and a learned ordered decision list, in DataFrame operations only.

The list is grown by sequential covering. A rule is a conjunction of thresholds on statistics; it grows by the
condition of the greatest FOIL gain on two thirds of the labelled rows, is pruned on the other third to the prefix of
the greatest (bad - good) / (bad + good), and is kept while that third finds it precise enough. Rows it covers leave,
and the next rule grows. The outcome is an ordered Spark CASE expression.

Every round is one aggregation of the labelled rows, of which at most LABELLED (those of the least hash) are used;
candidate thresholds are quantiles of the statistics over them. Each statistic is an expression of the text alone.

Cases: a null or empty text has no words and fails the base; a null label doesn't train; repeated labels of a doc_id
train once (the least quality counts); without labels, or without one of the two classes, the list is empty and the
base alone decides; a null doc_id is kept and matches no label; other columns pass through keep() and may have any name.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake.llm.sampling import least_hashed
from siftlake.session import cut

#: Most labelled rows that train, candidate thresholds of a statistic, rules of a list, conditions of a rule.
LABELLED = 20_000
THRESHOLDS = 100
RULES = 8
CONDITIONS = 4
#: A rule must reject bad rows at least this precisely on rows it didn't grow on, and cover so many of them.
PRECISION = 0.9
LEAST_COVERED = 3
WORD = r"[^\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeated(words: Column) -> Column:
    """Words in windows of five that occur twice or more. Windows are compared by 64-bit hashes."""
    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 5), lambda k: F.xxhash64(*(F.get(words, k + j) for j in range(5))))

    def covered(h: Column) -> Column:
        by_hash = F.sort_array(F.transform(h, lambda x, k: F.struct(x.alias("x"), k.alias("k"))))
        twice = lambda s: F.transform(s, lambda p, k: F.when((F.get(s, k - 1)["x"] == p["x"]) | (F.get(s, k + 1)["x"] == p["x"]), p["k"]))
        starts = let(by_hash, lambda s: F.sort_array(F.filter(twice(s), lambda k: k.isNotNull())))
        steps = let(starts, lambda d: F.transform(d, lambda at, k: F.least(F.lit(5), F.coalesce(F.get(d, k + 1) - at, F.lit(5)))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    return F.when(F.size(words) < 6, F.lit(0)).otherwise(let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))))


def _measures(text: Column) -> Column:
    """A struct of counts over the whole text."""
    count = lambda cls: F.length(F.regexp_replace(text, f"[^{cls}]+", ""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    line = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    of_words = let(
        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)),
        lambda w: F.struct(
            F.size(w).alias("n"),
            F.length(F.array_join(w, "")).alias("chars"),
            _repeated(w).alias("repeat"),
            F.size(F.array_distinct(w)).alias("distinct"),
        ),
    )
    return F.struct(of_words.alias("w"), line.alias("l"), count("#*$%&|<>").alias("symbols"), count("0-9").alias("digits"), count(r"\p{Lu}").alias("upper"), count("!?").alias("bangs"))


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("n_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "distinct_share", "digit_share", "upper_share", "bang_share")


def statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds a struct `stats` of the base counts and of the statistics that rules use."""
    m = df.withColumn("m", _measures(F.coalesce(F.col(text), F.lit(""))))
    long = lambda c: F.col(f"m.{c}").cast("long")
    n, chars = F.greatest(long("w.n"), F.lit(1)), F.greatest(long("w.chars"), F.lit(1))
    values = (
        [long("w.n"), long("w.chars"), long("symbols"), long("l.dup"), long("w.repeat")],
        [
            long("w.n").cast("double"), long("w.chars") / n, long("symbols") / chars, long("l.dup") / F.greatest(long("l.n"), F.lit(1)),
            long("w.repeat") / n, long("w.distinct") / n, long("digits") / chars, long("upper") / chars, long("bangs") / chars,
        ],
    )
    base = [v.alias(k) for k, v in zip(BASE, values[0])]
    failed = ((long("w.n") < 10) | (100 * long("w.repeat") > 20 * long("w.n"))).alias("base_failed")
    features = F.struct(*(v.alias(k) for k, v in zip(FEATURES, values[1]))).alias("f")
    return m.withColumn("stats", F.struct(*base, failed, features)).drop("m")


@dataclass(frozen=True)
class Condition:
    feature: int
    above: bool
    cut: float

    def column(self, features: str = "stats.f") -> Column:
        value = F.col(f"{features}.{FEATURES[self.feature]}")
        return value > self.cut if self.above else value <= self.cut

    def __str__(self) -> str:
        return f"{FEATURES[self.feature]} {'>' if self.above else '<='} {self.cut:.6g}"


Rule = tuple[Condition, ...]


def _all(rule: Rule) -> Column:
    return reduce(lambda a, b: a & b, (c.column() for c in rule), F.lit(True))


def verdict(rules: list[Rule], features: str = "stats.f") -> Column:
    """The list as one ordered conditional expression: false at the first rule that holds, else true."""
    out = F.lit(True)
    for rule in reversed(rules):
        out = F.when(reduce(lambda a, b: a & b, (c.column(features) for c in rule)), F.lit(False)).otherwise(out)
    return out


def learn(documents: DataFrame, labels: DataFrame) -> list[Rule]:
    """Rules that reject rows like those labelled quality 0, among rows that pass the base."""
    marks = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("y"))
    marks = least_hashed(marks, ["doc_id"], LABELLED)
    rows = statistics(documents.select("doc_id", "text").join(F.broadcast(marks), "doc_id").select("doc_id", "y", "text"))
    rows = rows.where(~F.col("stats.base_failed")).select((F.col("y") == 0).alias("bad"), (F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(3)) < 2).alias("grows"), F.col("stats.f").alias("f"))
    rows = cut(rows.repartition(4))
    values = [F.col(f"f.{name}") for name in FEATURES]
    share = [k / THRESHOLDS for k in range(THRESHOLDS)]
    quantiles = rows.agg(*(F.percentile_approx(v, share, 10_000).alias(name) for v, name in zip(values, FEATURES))).first()
    cuts = [sorted(set(quantiles[name] or [])) for name in FEATURES]
    below = lambda v, c: F.size(F.filter(F.array(*map(F.lit, c)), lambda x: x < v)) if c else F.lit(0)
    # bin k of a feature: k of its cuts are below the value
    rows = cut(rows.select("bad", "grows", F.struct("f").alias("stats"), F.array(*(below(v, c) for v, c in zip(values, cuts))).alias("bins")))
    rules: list[Rule] = []
    open_rows = rows
    while len(rules) < RULES:
        rule = _prune(open_rows, _grow(open_rows, cuts))
        if not rule:
            break
        rules.append(rule)
        open_rows = open_rows.where(~_all(rule))
    return rules


def _grow(rows: DataFrame, cuts: list[list[float]]) -> Rule:
    rule: Rule = ()
    while len(rule) < CONDITIONS:
        seen = rows.where(F.col("grows") & _all(rule)).select("bad", F.posexplode("bins").alias("feature", "bin"))
        counts = seen.groupBy("feature", "bin").agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n")).collect()
        table: dict[int, dict[int, tuple[int, int]]] = {}
        for r in counts:
            table.setdefault(r.feature, {})[r.bin] = (r.p, r.n)
        all_p = sum(p for p, _ in table.get(0, {}).values())
        all_n = sum(n for _, n in table.get(0, {}).values())
        if not all_p or not all_n:
            break
        best = (0.0, None)
        for feature, bins in sorted(table.items()):
            p = n = 0
            for k, at in enumerate(cuts[feature]):
                p, n = p + bins.get(k, (0, 0))[0], n + bins.get(k, (0, 0))[1]
                for above, cp, cn in ((False, p, n), (True, all_p - p, all_n - n)):
                    gain = cp * (log2(cp / (cp + cn)) - log2(all_p / (all_p + all_n))) if cp else 0.0
                    if gain > best[0] + 1e-9:
                        best = (gain, Condition(feature, above, float(at)))
        if best[1] is None:
            break
        rule += (_centred(rows.where(F.col("grows") & _all(rule)), best[1]),)
    return rule


def _centred(rows: DataFrame, c: Condition) -> Condition:
    """The same condition with its cut halfway between the nearest values on its two sides."""
    value = F.col(f"stats.f.{FEATURES[c.feature]}")
    near = rows.agg(F.max(F.when(value <= c.cut, value)).alias("low"), F.min(F.when(value > c.cut, value)).alias("high")).first()
    return c if near.low is None or near.high is None else Condition(c.feature, c.above, (near.low + near.high) / 2)


def _prune(rows: DataFrame, rule: Rule) -> Rule:
    """The prefix of the rule that does best on the rows that didn't grow it; none if that isn't precise enough."""
    if not rule:
        return ()
    rest = rows.where(~F.col("grows"))
    columns = [c.alias(f"{k}_{n}") for n in range(1, len(rule) + 1) for k, c in (("p", F.count_if(_all(rule[:n]) & F.col("bad"))), ("n", F.count_if(_all(rule[:n]) & ~F.col("bad"))))]
    got = rest.agg(*columns).first()
    scored = [((got[f"p_{n}"] - got[f"n_{n}"]) / max(got[f"p_{n}"] + got[f"n_{n}"], 1), -n) for n in range(1, len(rule) + 1)]
    n = -max(scored)[1]
    p, bad = got[f"p_{n}"], got[f"n_{n}"]
    return rule[:n] if p + bad >= LEAST_COVERED and p >= PRECISION * (p + bad) else ()


def keep(documents: DataFrame, rules: list[Rule]) -> DataFrame:
    """The documents that pass the base and the list, with all their columns."""
    own = documents.columns
    packed = documents.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("row"), "text")
    kept = statistics(packed).where(~F.col("stats.base_failed") & verdict(rules))
    return kept.select(*(F.col(f"row.`{c}`").alias(c) for c in own))


def op1_quality_rules(documents: DataFrame, labels: DataFrame) -> DataFrame:
    rules = learn(documents, labels)
    out = statistics(documents.select("doc_id", "text"))
    return out.select("doc_id", *(F.col(f"stats.{k}").alias(k) for k in BASE), F.col("stats.base_failed").alias("base_failed"), (~F.col("stats.base_failed") & verdict(rules)).alias("kept"))
