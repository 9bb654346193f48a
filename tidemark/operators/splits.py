"""Leak-safe folds: groups stay together, strata are spread, rare classes reach every fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.text import seeded
from tidemark.operators.ranks import places

Keys = list[str]


def seeded_rank(df: DataFrame, keys: Keys, key: str, seed: str, name: str = "order") -> DataFrame:
    """Place of each row in a seeded shuffle of its group, from 0. Prefixes of it nest."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(seeded(seed, F.col(key)))) - 1)


def round_robin_folds(groups: DataFrame, strata: Keys, key: str, k: int, seed: str) -> DataFrame:
    """Folds of whole groups, dealt in seeded order within each stratum."""
    return seeded_rank(groups, strata, key, seed, "_o").withColumn("fold", F.pmod("_o", F.lit(k))).drop("_o")


def leaks(df: DataFrame, key: str, fold: str = "fold") -> DataFrame:
    """Keys that lie in more than one fold; must be empty."""
    return df.groupBy(key).agg(F.count_distinct(fold).alias("n_folds")).where("n_folds > 1")


def held_out(df: DataFrame, group: str, one: Column) -> DataFrame:
    """Leave one group out: its rows are the test part, all others the training part."""
    return df.withColumn("part", F.when(F.col(group) == one, "test").otherwise("train"))


def duplicate_units(df: DataFrame, key: str, digest: Column) -> DataFrame:
    """Rows of equal digest form a unit, named by its smallest key."""
    rows = df.select(key, digest.alias("_d"))
    units = rows.groupBy(F.col("_d").alias("_u")).agg(F.min(key).alias("unit"))
    return rows.join(units, F.col("_d").eqNullSafe(F.col("_u"))).select(key, "unit")


#: Rows (unit, value) that one restart holds: about 100 MB.
MOST_ROWS = 1_000_000


def stratified_greedy(vectors: DataFrame, k: int, restarts: int, rare: float = 2.0) -> DataFrame:
    """Folds of units that balance counts of many values, the best of several seeded restarts.

    ``vectors`` has unit, value, n: a slim table of at most MOST_ROWS rows, more raise. Each restart is one task: units,
    large ones first, go to the fold whose squared relative deviation from the target grows least, with a
    bonus where a fold still lacks a rare value. The restart with the least largest deviation wins.
    """
    if vectors.limit(MOST_ROWS + 1).count() > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} rows of (unit, value)")
    packed = vectors.groupBy().agg(F.collect_list(F.struct("unit", "value", "n")).alias("rows"))
    runs = vectors.sparkSession.range(restarts).withColumnRenamed("id", "seed").repartition(restarts, "seed").join(F.broadcast(packed))

    def assign(seed, pdf):
        import numpy as np
        import pandas as pd

        table = pd.DataFrame([r.asDict() if hasattr(r, "asDict") else r for r in pdf["rows"].iloc[0]])
        wide = table.pivot_table(index="unit", columns="value", values="n", aggfunc="sum", fill_value=0)
        a = wide.to_numpy(dtype=float)
        target = np.maximum(a.sum(axis=0) / k, 1e-9)
        is_rare = (a > 0).sum(axis=0) <= 2 * k
        rng = np.random.default_rng(int(seed[0]))
        order = np.lexsort((rng.random(len(a)), -a.sum(axis=1)))
        have, fold = np.zeros((k, a.shape[1])), np.zeros(len(a), dtype=np.int64)
        for u in order:
            grown = (((have + a[u] - target) ** 2 - (have - target) ** 2) / target**2).sum(axis=1)
            grown -= rare * ((have == 0) & (a[u] > 0) & is_rare).sum(axis=1)
            fold[u] = int(grown.argmin())
            have[fold[u]] += a[u]
        spread = float((np.abs(have - target) / target).max())
        return pd.DataFrame({"seed": int(seed[0]), "score": spread, "unit": wide.index.to_numpy(), "fold": fold})

    kind = dict(vectors.dtypes)["unit"]
    tried = runs.groupBy("seed").applyInPandas(assign, f"seed long, score double, unit {kind}, fold long")
    best = tried.agg(F.min(F.struct("score", "seed")).alias("b"))
    return tried.join(F.broadcast(best), tried["seed"] == F.col("b.seed")).select("unit", "fold", "score")


def rare_rebalanced(units: DataFrame, k: int, weight: str, key: str) -> DataFrame:
    """Longest-processing-time dealing in snake order: heavy units first, forth and back over the folds."""
    rank = F.col("_rk") - 1
    lap, at = F.floor(rank / F.lit(k)), F.pmod(rank, F.lit(k))
    return places(units, -F.col(weight), [F.col(key)], "_rk").withColumn("fold", F.when(lap % 2 == 0, at).otherwise(F.lit(k - 1) - at)).drop("_rk")
