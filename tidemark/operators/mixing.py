"""Caps, target shares and nested samples over sources, by seeded ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import seeded
from tidemark.operators.ranks import hashed_places


def _ranked(df: DataFrame, group: str, key: str, seed: str) -> DataFrame:
    return hashed_places(df, [group], seeded(seed, F.col(key)), "_rk")


def capped(df: DataFrame, group: str, key: str, caps: Column, seed: str) -> DataFrame:
    """At most ``caps`` rows of each group, drawn by seed; a null cap keeps all."""
    return _ranked(df, group, key, seed).where(F.col("_rk") <= F.coalesce(caps, F.lit(2**62))).drop("_rk")


def ratio_mix(df: DataFrame, group: str, key: str, ratios: dict[str, float], seed: str) -> DataFrame:
    """The largest sample whose groups have the ratios; groups without one are kept whole."""
    table = F.create_map(*[F.lit(x) for kv in ratios.items() for x in kv])
    counts = df.groupBy(group).agg(F.count("*").alias("_n")).withColumn("_ratio", F.try_element_at(table, F.col(group)))
    cap = counts.where("_ratio > 0").agg(F.min(F.col("_n") / F.col("_ratio")).alias("_cap"))
    limits = counts.join(F.broadcast(cap)).select(F.col(group).alias("_g"), F.when(F.col("_ratio") > 0, F.bround(F.col("_cap") * F.col("_ratio"))).alias("_limit"))
    rows = _ranked(df, group, key, seed).join(limits, F.col(group) == F.col("_g"))
    return rows.where(F.col("_limit").isNull() | (F.col("_rk") <= F.col("_limit"))).drop("_rk", "_g", "_limit")


def proportional_head(df: DataFrame, group: str, key: str, limit: int, seed: str) -> DataFrame:
    """About ``limit`` rows, each group in proportion and with one row at least."""
    sizes = df.groupBy(group).agg(F.count("*").alias("_n"))
    total = sizes.agg(F.sum("_n").alias("_all"))
    share = sizes.join(F.broadcast(total)).select(F.col(group).alias("_g"), F.greatest(F.lit(1), F.floor(F.lit(limit) * F.col("_n") / F.col("_all"))).alias("_take"))
    return _ranked(df, group, key, seed).join(share, F.col(group) == F.col("_g")).where("_rk <= _take").drop("_rk", "_g", "_take")


def weighted_mean(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """Mean of shard means by their weights, and the largest value."""
    return df.groupBy(*keys).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("mean"), F.max(value).alias("most"))


def union_all(parts: list[tuple[DataFrame, float]]) -> DataFrame:
    """Frames of different columns in one, each row with its source's weight."""
    out = None
    for df, w in parts:
        df = df.withColumn("weight", F.lit(w))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out
