"""Feature scores of nominal data from one contingency table, and bins of numeric features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake.operators import cuts
from siftlake.operators.relief import relieff

__all__ = ["binned", "contingency", "relieff", "scores", "top_features"]

DIGITS = 8


def contingency(data: DataFrame, features: list[str], label: str) -> DataFrame:
    """feature, value, class and count: one pass and one shuffle for all features; rows of a null class stay out."""
    pairs = F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("value")) for f in features))
    return data.where(F.col(label).isNotNull()).select(F.explode(pairs).alias("p"), F.col(label).cast("string").alias("class")).groupBy("p.feature", "p.value", "class").agg(F.count("*").alias("n"))


def scores(data: DataFrame, features: list[str], label: str) -> DataFrame:
    """Information gain, gain ratio and symmetrical uncertainty of each feature, in bits.

    With counts n(v, c), N log N terms give all entropies: H(X) = log2 N - sum(n log2 n) / N. A null value is a value
    of its own. Zero denominators give 0.
    """
    table = contingency(data, features, label)
    term = lambda n: F.sum(F.col(n) * F.log2(F.col(n)))
    joint = table.groupBy("feature").agg(F.sum("n").alias("total"), term("n").alias("joint"))
    by_value = table.groupBy("feature", "value").agg(F.sum("n").alias("n")).groupBy("feature").agg(term("n").alias("by_value"))
    by_class = table.groupBy("feature", "class").agg(F.sum("n").alias("n")).groupBy("feature").agg(term("n").alias("by_class"))
    rows = joint.join(by_value, "feature").join(by_class, "feature")
    bits = lambda c: F.log2("total") - F.col(c) / F.col("total")
    rows = rows.withColumns({"h_value": bits("by_value"), "h_class": bits("by_class"), "h_joint": bits("joint")})
    rows = rows.withColumn("ig", F.col("h_class") + F.col("h_value") - F.col("h_joint"))
    ratio = F.when(F.col("h_value") > 1e-12, F.col("ig") / F.col("h_value")).otherwise(0.0)
    uncertainty = F.when(F.col("h_value") + F.col("h_class") > 1e-12, 2 * F.col("ig") / (F.col("h_value") + F.col("h_class"))).otherwise(0.0)
    clean = lambda c: F.round(c, DIGITS) + 0.0
    return rows.select("feature", clean(F.col("ig")).alias("info_gain"), clean(ratio).alias("gain_ratio"), clean(uncertainty).alias("symmetrical_uncertainty"))


def top_features(scored: DataFrame, by: str, order: list[str], k: int) -> DataFrame:
    """The restricted candidate list: the k best features by a score, ties by their place (from 1) among the attributes."""
    places = F.create_map(*(x for place, f in enumerate(order, 1) for x in (F.lit(f), F.lit(place))))
    return scored.select("feature", places[F.col("feature")].alias("place"), F.col(by).alias("score")).orderBy(F.desc("score"), "place").limit(k)


def binned(data: DataFrame, features: list[str], label: str) -> DataFrame:
    """Numeric features replaced by their MDL bin numbers; cuts come from the value and class counts of all rows."""
    found = cuts.mdl_cuts(data, features, label)

    def place(f: str) -> Column:
        value = F.col(f).cast("double")
        return F.when(value.isNotNull(), F.size(F.filter(F.array(*map(F.lit, found[f])), lambda c: value > c)) if found[f] else F.lit(0))

    return data.withColumns({f: place(f) for f in features})
