"""Lookups by key, place and frame, prior answers, and the balance of folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

Keys = list[str]


def joined_by_stem(rows: DataFrame, path: str, table: DataFrame, key: str, value: str, default: Column) -> DataFrame:
    """``value`` of the table whose key is the stem of the row's path; ``default`` where there is none."""
    from tidemark.functions.text import stem

    small = table.select(F.lower(F.col(key)).alias("_stem"), F.col(value).alias("_value"))
    found = rows.withColumn("_stem", F.lower(stem(F.col(path)))).join(small, "_stem", "left")
    return found.withColumn(value, F.coalesce("_value", default)).drop("_stem", "_value")


def nearest_frame(t: Column, start: Column, fps: Column, n: Column) -> Column:
    """The index of the actual frame nearest to a time, from 0 to n - 1; halves go to the even one."""
    return F.least(F.greatest(F.bround((t - start) * fps).cast("long"), F.lit(0).cast("long")), n - 1)


def clipped_box(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> Column:
    """A box cut to its frame, null if nothing of it is left."""
    cut = lambda v, most: F.least(F.greatest(v, F.lit(0)), most)
    box = F.struct(cut(x0, width).alias("x0"), cut(y0, height).alias("y0"), cut(x1, width).alias("x1"), cut(y1, height).alias("y1"))
    return F.when((F.least(x1, width) > F.greatest(x0, F.lit(0))) & (F.least(y1, height) > F.greatest(y0, F.lit(0))), box)


def sharpest_near(wanted: DataFrame, seconds: DataFrame, keys: Keys, t: str, radius: float) -> DataFrame:
    """For each wanted time the sharpest free second within ``radius``, the earliest of equals, else the time itself.

    ``seconds`` has the keys, sec (long), sharp (null or NaN if unknown) and masked.
    """
    fine = seconds.where(F.col("sharp").isNotNull() & ~F.isnan("sharp") & ~F.col("masked")).select(*keys, "sec", "sharp")
    at = F.sequence(F.ceil(F.col(t) - F.lit(radius)), F.floor(F.col(t) + F.lit(radius)))
    near = wanted.select(*keys, t, F.explode(at).alias("sec")).distinct().join(fine, [*keys, "sec"])
    best = near.groupBy(*keys, t).agg(F.max_by("sec", F.struct("sharp", -F.col("sec"))).alias("pick"))
    return wanted.join(best, [*keys, t], "left").withColumn("pick", F.coalesce(F.col("pick").cast("double"), F.col(t).cast("double")))


def prior_answers(known: DataFrame, asked: DataFrame, template: str, form: str, answer: str) -> DataFrame:
    """The most frequent known answer of a question's template, else of its format, else ``none``; questions
    for a time get the middle of their range (lo, hi). Ties go to the least answer."""

    def modes(key: str, name: str) -> DataFrame:
        counts = known.where(F.col(form) != "time").groupBy(key, answer).agg(F.count("*").alias("_n"))
        return counts.groupBy(key).agg(F.min_by(answer, F.struct(-F.col("_n"), F.col(answer))).alias(name))

    out = asked.join(modes(template, "_t"), template, "left").join(modes(form, "_f"), form, "left")
    middle = ((F.col("lo") + F.col("hi")) / 2).cast("string")
    return out.withColumn("guess", F.when(F.col(form) == "time", middle).otherwise(F.coalesce("_t", "_f", F.lit("none")))).drop("_t", "_f")


def balance_score(counts: DataFrame, fold: str, weights: Column, rare: float, boost: float) -> DataFrame:
    """One row: how uneven folds are. Of each (family, value), the largest less the smallest share over folds,
    by the family's weight and, for rare values, by ``boost``; a rare value that a fold lacks adds half as much.

    ``counts`` has fold, family, value, n.
    """
    per_fold = counts.groupBy(fold, "family").agg(F.sum("n").alias("_fam"))
    folds = counts.select(fold).distinct()
    total = counts.groupBy("family", "value").agg(F.sum("n").alias("_n"))
    family = counts.groupBy("family").agg(F.sum("n").alias("_all"))
    grid = total.join(family, "family").crossJoin(F.broadcast(folds))  # folds are few, values are few
    rows = grid.join(counts, [fold, "family", "value"], "left").join(per_fold, [fold, "family"], "left")
    share = F.coalesce(F.col("n"), F.lit(0)) / F.greatest(F.coalesce(F.col("_fam"), F.lit(0)), F.lit(1))
    per = rows.groupBy("family", "value", "_n", "_all").agg((F.max(share) - F.min(share)).alias("_range"), F.min(F.coalesce("n", F.lit(0))).alias("_least"))
    is_rare = F.col("_n") / F.col("_all") < rare
    weight = weights * F.when(is_rare, boost).otherwise(1.0)
    return per.agg(F.sum(weight * (F.col("_range") + F.when(is_rare & (F.col("_least") == 0), 0.5).otherwise(0.0))).alias("score"), F.count("*").alias("n_values"))


#: Units (videos) of one assignment; a table of more is an error, not cut.
MOST_UNITS = 100_000


def rare_swaps(units: DataFrame, k: int) -> DataFrame:
    """Units with rare content spread over ``k`` folds, the fold sizes kept.

    ``units`` has unit, fold, kind, n (rare content, 0 for none) and draw (a hash). The rare units go, heavy
    ones first, to the fold with the least load; one that changes folds trades places with the unit of its
    kind there that has no rare content and the least draw. Adds ``new_fold``. The deciding is one bounded
    task, as each step depends on those before; a table beyond MOST_UNITS or a fold without a donor raises.
    """
    if units.limit(MOST_UNITS + 1).count() > MOST_UNITS:
        raise ValueError(f"more than {MOST_UNITS} units")

    def decide(own):
        import heapq

        fold = dict(zip(own["unit"], own["fold"]))
        kind = dict(zip(own["unit"], own["kind"]))
        rare = own[own["n"] > 0].sort_values(["n", "unit"], ascending=[False, True])
        load = [(0, f) for f in range(k)]
        target = {}
        for u, n in zip(rare["unit"], rare["n"]):
            have, f = heapq.heappop(load)
            target[u] = f
            heapq.heappush(load, (have + int(n), f))
        plain = own[own["n"] == 0].sort_values("draw")["unit"].tolist()
        for u, f in target.items():
            at = fold[u]
            if at != f:
                donor = next((d for d in plain if fold[d] == f and kind[d] == kind[u]), None)
                if donor is None:
                    raise ValueError(f"no unit of kind {kind[u]} to trade in fold {f}")
                fold[u], fold[donor] = f, at
        return own.assign(new_fold=[fold[u] for u in own["unit"]])[["unit", "fold", "new_fold"]]

    kinds = dict(units.dtypes)
    return units.groupBy().applyInPandas(decide, f"unit {kinds['unit']}, fold {kinds['fold']}, new_fold long")


def track_bounds(points: DataFrame, keys: Keys, t: str) -> DataFrame:
    """First and last time and all times in order of each track."""
    return points.groupBy(*keys).agg(F.min(t).alias("t_min"), F.max(t).alias("t_max"), F.array_sort(F.collect_set(t)).alias("times"))


def numbered_by_size(rows: DataFrame, keys: Keys, size: Column, tie: str) -> DataFrame:
    """Numbers the instances of a class in a frame, the largest first."""
    return rows.withColumn("number", F.row_number().over(W.partitionBy(*keys).orderBy(size.desc(), F.col(tie))))
