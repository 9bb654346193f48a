"""Clock texts, tolerances and grids as Column expressions. Seconds are numbers; hours may exceed 24."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import TIMESTAMP


def hhmmss(seconds: Column) -> Column:
    """``hh:mm:ss`` of a number of seconds, rounded half to even, never below zero."""
    s = F.greatest(F.bround(seconds.cast("double")), F.lit(0.0)).cast("long")
    two = lambda c: F.when(c < 10, F.concat(F.lit("0"), c.cast("string"))).otherwise(c.cast("string"))
    return F.concat_ws(":", two(F.floor(s / 3600)), two(F.floor(s / 60) % 60), two(s % 60))


def _clock(text: Column) -> Column:
    p = F.split(text, ":")
    return p[0].cast("long") * 3600 + p[1].cast("long") * 60 + p[2].cast("long")


def anchors(text: Column) -> Column:
    """All clock times in a text, in seconds."""
    return F.transform(F.regexp_extract_all(text, F.lit(TIMESTAMP), F.lit(0)), _clock)


def strict_times(text: Column) -> Column:
    """A comma list of clock times in order; null if any part is something else, or there is none."""
    parts = F.transform(F.split(text, ","), lambda x: F.trim(x))
    fine = F.forall(parts, lambda p: F.rlike(p, F.lit(rf"^{TIMESTAMP}$")))
    return F.when(fine, F.sort_array(F.transform(parts, _clock)))


def loose_times(text: Column) -> Column:
    """A comma list of h:m:s with number parts of any length; an empty list if one is none."""
    parts = F.transform(F.split(text, ","), lambda x: F.trim(x))
    fine = F.forall(parts, lambda p: F.rlike(p, F.lit(r"^[0-9]+:[0-9]+:[0-9]+$")))
    return F.when(fine, F.transform(parts, _clock)).otherwise(F.filter(F.array(F.lit(0).cast("long")), lambda x: F.lit(False)))


def with_millis(text: Column) -> Column:
    """``h:m:s`` or ``h:m:s:ms`` in seconds."""
    g = lambda i: F.regexp_extract(text, r"^([0-9]+):([0-9]+):([0-9]+)(?::([0-9]+))?$", i)
    millis = F.when(g(4) != "", g(4).cast("double") / 1000).otherwise(0.0)
    return F.when(g(1) != "", g(1).cast("double") * 3600 + g(2).cast("double") * 60 + g(3).cast("double") + millis)


def tolerance(duration: Column) -> Column:
    return F.least(F.lit(5.0), 1 + duration * 4 / 360)


def clamped(times: Column, lo: Column, hi: Column) -> Column:
    """Times moved into [lo, hi], in the order they came."""
    return F.transform(times, lambda t: F.least(F.greatest(t, lo), hi))


def centre(times: Column, k: Column) -> Column:
    """The ``k`` middle ones of a sorted list."""
    n = F.size(times)
    return F.when(n <= k, times).otherwise(F.slice(times, F.floor((n - k) / 2).cast("int") + 1, k.cast("int")))


def frames_for_stride(duration: Column, stride: float, least: int = 8, most: int = 96) -> Column:
    return F.least(F.greatest((F.floor(duration / F.lit(stride)) + 1).cast("long"), F.lit(least)), F.lit(most))


def size_for_frames(frames: Column, capacity: dict[int, int]) -> Column:
    """The largest size whose capacity holds so many frames, else the smallest size."""
    out = F.lit(min(capacity))
    for size in sorted(capacity):
        out = F.when(frames <= capacity[size], size).otherwise(out)
    return out


def coarse_stride(duration: Column) -> Column:
    """15 seconds for each begun ten minutes, 30 at most."""
    return F.least(15 * F.greatest(F.lit(1), F.ceil(duration / 600)), F.lit(30)).cast("long")


def linspace(lo: Column, hi: Column, n: Column) -> Column:
    """``n`` points from lo to hi, both included; the middle if n is 1, none if 0."""
    points = F.transform(F.sequence(F.lit(0), F.greatest(n.cast("int") - 1, F.lit(1))), lambda i: lo + (hi - lo) * i / F.greatest(n - 1, F.lit(1)))
    return F.when(n <= 0, F.filter(points, lambda x: F.lit(False))).when(n == 1, F.array((lo + hi) / 2)).otherwise(points)


def geomspace(lo: Column, hi: Column, n: int) -> Column:
    """``n`` points in geometric progression from lo to hi, both above zero."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: lo * F.pow(hi / lo, i / F.lit(max(n - 1, 1))))


def bumps(t: Column, centres: Column, sigma: float) -> Column:
    """Sum of Gaussian bumps at ``centres``."""
    return F.aggregate(centres, F.lit(0.0), lambda a, c: a + F.exp(-F.pow((t - c) / sigma, 2) / 2))
