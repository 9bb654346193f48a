"""Grouped statistics beyond single built-ins: modes, macro means, balance, class scores, ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.ranks import places

Keys = list[str]


def first_seen_mode(df: DataFrame, keys: Keys, value: str, order: str) -> DataFrame:
    """The most frequent value of each key; among equals the one that came first in ``order``."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("_n"), F.min(order).alias("_first"))
    return counts.groupBy(*keys).agg(F.max_by(value, F.struct("_n", -F.col("_first"))).alias(value), F.max("_n").alias("n"))


def macro_mean(df: DataFrame, keys: Keys, bucket: str, value: str) -> DataFrame:
    """Mean of the buckets' means beside the plain mean, per key (or over all)."""
    means = df.groupBy(*keys, bucket).agg(F.avg(value).alias("_m"), F.sum(value).alias("_s"), F.count(value).alias("_n"))
    return means.groupBy(*keys).agg(F.avg("_m").alias("macro"), (F.sum("_s") / F.sum("_n")).alias("micro"), F.count("*").alias("n_buckets"))


def count_vectors(df: DataFrame, keys: Keys, families: list[str]) -> DataFrame:
    """Counts of (family, value) per key, all families in one pass."""
    pairs = F.array(*[F.struct(F.lit(f).alias("family"), F.col(f).cast("string").alias("value")) for f in families])
    return df.select(*keys, F.explode(pairs).alias("_p")).groupBy(*keys, "_p.family", "_p.value").agg(F.count("*").alias("n"))


def share_range(counts: DataFrame, fold: str) -> DataFrame:
    """Largest less smallest share of each (family, value) over folds; a fold without it counts as 0.

    ``counts`` has fold, family, value, n.
    """
    shares = counts.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(fold, "family")))
    n_folds = counts.groupBy("family").agg(F.count_distinct(fold).alias("_folds"))
    out = shares.groupBy("family", "value").agg(F.max("share").alias("_hi"), F.min("share").alias("_lo"), F.count("*").alias("_n")).join(n_folds, "family")
    return out.select("family", "value", (F.col("_hi") - F.when(F.col("_n") < F.col("_folds"), 0.0).otherwise(F.col("_lo"))).alias("spread"))


def class_scores(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """Precision, recall, F1 and Jaccard of each class that is true or guessed somewhere."""
    pairs = F.array(F.struct(F.col(truth).alias("cls"), F.lit(1).alias("t"), (F.col(truth) == F.col(guess)).cast("int").alias("h"), F.lit(0).alias("g")), F.struct(F.col(guess).alias("cls"), F.lit(0).alias("t"), F.lit(0).alias("h"), F.lit(1).alias("g")))
    sums = df.select(F.explode(pairs).alias("p")).groupBy("p.cls").agg(F.sum("p.t").alias("t"), F.sum("p.h").alias("h"), F.sum("p.g").alias("g"))
    over = lambda d: F.col("h") / F.greatest(d, F.lit(1))
    return sums.select("cls", over(F.col("g")).alias("precision"), over(F.col("t")).alias("recall"), (2 * F.col("h") / F.greatest(F.col("t") + F.col("g"), F.lit(1))).alias("f1"), over(F.col("t") + F.col("g") - F.col("h")).alias("jaccard"))


def rank_auc(df: DataFrame, score: str, positive: Column, tie: str) -> DataFrame:
    """Area under the ROC curve by rank sum, ties in the order of ``tie``.

    Rows are placed range by range of the score, so no task orders all of them.
    """
    ranked = places(df.select(F.col(score).alias("_s"), F.col(tie).alias("_t"), positive.cast("int").alias("_p")).where("_s is not null"), F.col("_s"), [F.col("_t")], "_rk")
    sums = ranked.agg(F.sum(F.col("_rk") * F.col("_p")).alias("r"), F.sum("_p").alias("pos"), (F.count("*") - F.sum("_p")).alias("neg"))
    return sums.select(((F.col("r") - F.col("pos") * (F.col("pos") + 1) / 2) / (F.col("pos") * F.col("neg"))).alias("auc"), "pos", "neg")


def set_differences(df: DataFrame, truth: Column, guess: Column) -> DataFrame:
    """How often each class of two lists per row was missed or falsely named."""
    both = df.select(F.array_except(truth, guess).alias("m"), F.array_except(guess, truth).alias("f"))
    each = lambda c, kind: F.transform(c, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("cls")))
    return both.select(F.explode(F.concat(each(F.col("m"), "missed"), each(F.col("f"), "false"))).alias("x")).groupBy("x.kind", "x.cls").agg(F.count("*").alias("n"))


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows against each rule: rule, n."""
    flags = F.array(*[F.struct(F.lit(k).alias("rule"), F.coalesce(c, F.lit(False)).cast("long").alias("bad")) for k, c in rules.items()])
    return df.select(F.explode(flags).alias("x")).groupBy("x.rule").agg(F.sum("x.bad").alias("n"))
