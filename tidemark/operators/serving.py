"""Choosing answers: votes, confidence, routes, budgets, fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def majority(votes: DataFrame, questions: DataFrame, key: str, answer: str, member: str) -> DataFrame:
    """The most voted answer; of equals the one an earlier member gave. Questions without votes get ''."""
    counts = votes.groupBy(key, answer).agg(F.count("*").alias("_n"), F.min(member).alias("_first"))
    best = counts.groupBy(key).agg(F.max_by(answer, F.struct("_n", -F.col("_first"))).alias(answer))
    return questions.select(key).join(best, key, "left").withColumn(answer, F.coalesce(answer, F.lit("")))


def challenger(first: Column, first_conf: Column, second: Column, second_conf: Column) -> Column:
    """The first answer only if it is surely more confident; the second wins ties and missing figures."""
    return F.when(first_conf > second_conf, first).otherwise(second)


def routed(df: DataFrame, routes: DataFrame, key: str, default: str) -> DataFrame:
    """Adds route from a table of (key, route), or the default."""
    return df.join(routes, key, "left").withColumn("route", F.coalesce("route", F.lit(default)))


def budget_tiers(df: DataFrame, keys: list[str], order: list[Column], cost: Column, budget: float, tiers: list[tuple[float, str]]) -> DataFrame:
    """The tier of each row by the budget left before it: the first whose least rest is met."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    left = F.lit(budget) - F.coalesce(F.sum(cost).over(w), F.lit(0))
    tier = F.lit(tiers[-1][1])
    for least, name in reversed(tiers):
        tier = F.when(left >= least, name).otherwise(tier)
    return df.withColumn("left", left).withColumn("tier", tier)


def ladder(cost_left: Column, steps: dict[int, float], ceiling: Column | None = None) -> Column:
    """The largest number of frames whose cost fits and that is not above the ceiling; else the smallest."""
    out = F.lit(min(steps))
    for n in sorted(steps):
        fits = cost_left >= steps[n]
        out = F.when(fits if ceiling is None else fits & (F.lit(n) <= ceiling), n).otherwise(out)
    return out


def salvaged(final: Column, partial: Column) -> Column:
    return F.coalesce(F.nullif(final, F.lit("")), partial, F.lit(""))


def specialist_merge(general: DataFrame, special: DataFrame, keys: list[str], cls: str, owned: list[str]) -> DataFrame:
    """The specialist's rows replace the general ones of its classes; where the general detector is empty
    the specialist is not asked."""
    asked = special.join(general.select(*keys).distinct(), keys, "left_semi")
    return general.where(~F.col(cls).isin(*owned)).unionByName(asked.where(F.col(cls).isin(*owned)))


def hi_lo(score: Column, hi: float, lo: float) -> Column:
    return F.when(score >= hi, "hi").when(score >= lo, "lo")


def needed_models(text: Column, rules: dict[str, str]) -> list[Column]:
    """Which models a question needs, by its text alone."""
    return [F.rlike(text, F.lit(p)).alias(k) for k, p in rules.items()]
