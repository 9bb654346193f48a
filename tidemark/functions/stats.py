"""Paired tests and small geometry as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mcnemar(b: Column, c: Column) -> Column:
    """Exact two-sided McNemar p of b and c discordant pairs, summed in logarithms so that it never underflows."""
    n, k = b + c, F.least(b, c)
    start = -n * F.log(F.lit(2.0))
    zero = F.struct(start.alias("term"), start.alias("sum"))

    def add(s: Column, i: Column) -> Column:
        term = s["term"] + F.log((n - i + 1) / i)
        top = F.greatest(s["sum"], term)
        total = top + F.log(F.exp(s["sum"] - top) + F.exp(term - top))
        return F.when(i > k, s).otherwise(F.struct(term.alias("term"), total.alias("sum")))

    tail = F.aggregate(F.sequence(F.lit(1), F.greatest(k, F.lit(1)).cast("int")), zero, add, lambda s: s["sum"])
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * F.exp(tail)))


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def box_iou(a: Column, b: Column) -> Column:
    """Intersection over union of boxes (x0, y0, x1, y1)."""
    side = lambda i, j: F.greatest(F.least(a[j], b[j]) - F.greatest(a[i], b[i]), F.lit(0.0))
    both = side("x0", "x1") * side("y0", "y1")
    area = lambda z: (z["x1"] - z["x0"]) * (z["y1"] - z["y0"])
    total = area(a) + area(b) - both
    return F.when(total > 0, both / total).otherwise(0.0)


def edit_score(truth: Column, guess: Column) -> Column:
    """100 less the edit distance of two label lists as a share of the longer one. Labels are single letters."""
    a, b = F.array_join(truth, ""), F.array_join(guess, "")
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 100.0).otherwise(100.0 * (1 - F.levenshtein(a, b) / longest))
