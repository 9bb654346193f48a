"""Edges of a smoothed detection over a ladder of thresholds.

A rung is a threshold and a number of rows k: a row is seen if all of the k rows about it reach the threshold. Such
rows are what is left of a run of rows that reach it when its first and last few are cut off. So runs are found once for
each threshold, among the rows that reach it, and all rungs are cut from them. The first rung with any run gives the runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import times as M
from tidemark.operators.chains import run_starts
from tidemark.operators.sampling import Scene

Keys = list[str]


def rung_runs(df: DataFrame, keys: Keys, t: str, score: str, rungs: list[tuple[float, int]], step: int) -> DataFrame:
    """Runs of each key at every rung (threshold, k), from 0: keys, rung, a (first time), b (last time).

    Rows are ``step`` apart; a time without a row, or with a null score, reaches no threshold. Of k rows about a time
    k // 2 lie before it, the others at it and behind.
    """
    levels = F.array(*[F.lit(float(x)) for x in sorted({x for x, _ in rungs})])
    at = (F.round(F.col(t) / F.lit(step)).cast("long") * step).alias(t)
    reached = df.select(*keys, at, F.explode(F.filter(levels, lambda x: F.col(score) >= x)).alias("_level"))
    runs = run_starts(reached, [*keys, "_level"], t, step).groupBy(*keys, "_level", F.col("run").alias("_from")).agg(F.max(t).alias("_to"))
    cuts = F.array(*[F.struct(F.lit(i).alias("rung"), F.lit(float(x)).alias("level"), (F.col("_from") + k // 2 * step).alias("a"), (F.col("_to") - (k - 1) // 2 * step).alias("b")) for i, (x, k) in enumerate(rungs)])
    left = F.filter(cuts, lambda c: (c["level"] == F.col("_level")) & (c["a"] <= c["b"]))
    return runs.select(*keys, F.explode(left).alias("_c")).select(*keys, "_c.rung", "_c.a", "_c.b")


def first_rung(runs: DataFrame, keys: Keys) -> DataFrame:
    """The runs of the first rung of each key that has any."""
    first = F.min("rung").over(W.partitionBy(*keys))
    return runs.withColumn("_first", first).where("rung = _first").select(*keys, "rung", "a", "b")


def edge_budget(s: Scene, runs: Column, kind: Column, win: float, share: float, several: int = 1, fine: Column | None = None, narrow: float = 0.0) -> Column:
    """Points about the first run's start (kind ``first``) or the last one's end (``last``), and a uniform share.

    ``several``: the budget is shared by so many starts from the front, or ends from the back. ``fine``: runs of a
    weaker mask, among which a single edge is looked for again within ``win``; where one is found, points lie
    within ``narrow`` of it. Null without runs or for another kind.
    """
    last, n = kind == "last", F.size(runs)
    lo, hi = s.lo.cast("double"), s.hi.cast("double")
    uni = F.bround(s.n * F.lit(share))
    ends = F.when(last, F.transform(F.reverse(runs), lambda r: r["b"].cast("double"))).otherwise(F.transform(runs, lambda r: r["a"].cast("double")))
    within = lambda e, w, k: M.linspace(F.greatest(lo, e - w), F.least(hi, e + w), k)
    one = F.get(ends, F.lit(0))
    if fine is not None:
        near = F.filter(fine, lambda r: (r["b"] >= one - win) & (r["a"] <= one + win))
        again = F.when(last, F.least(F.try_element_at(near, F.lit(-1))["b"].cast("double"), one + win)).otherwise(F.greatest(F.get(near, F.lit(0))["a"].cast("double"), one - win))
        points = F.when(again.isNotNull(), within(again, F.lit(float(narrow)), s.n - uni)).otherwise(within(one, F.lit(float(win)), s.n - uni))
    else:
        points = within(one, F.lit(float(win)), s.n - uni)
    if several > 1:
        some = F.slice(ends, 1, several)
        per = F.greatest(F.lit(2), F.floor((s.n - uni) / F.size(some)))
        points = F.when(n > 1, F.flatten(F.transform(some, lambda e: within(e, F.lit(float(win)), per)))).otherwise(points)
    wished = F.concat(F.when(uni >= 1, M.linspace(lo, hi, uni)).otherwise(F.array().cast("array<double>")), points)
    return F.when((n > 0) & kind.isin("first", "last"), s.take(wished))
