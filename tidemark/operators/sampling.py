"""Budgeted temporal samplers as Column expressions: n time points of [lo, hi] on a grid.

A request is one row; what it samples from lies in array columns, so nothing is shuffled here. Every
sampler returns a sorted array<double>, or null where it does not apply.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.functions import times as M

NONE = "array<double>"


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _empty() -> Column:
    return F.array().cast(NONE)


def _set(times: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(times, lambda x: F.round(x, 3))))


def even_indices(n: Column, k: Column) -> Column:
    """``k`` indices from 0 to n - 1 at equal steps, rounded half to even; all if k reaches n."""
    some = F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(k.cast("int") - 1, F.lit(1))), lambda i: F.bround(i * (n - 1) / F.greatest(k - 1, F.lit(1))).cast("int")))
    return F.when(n <= 0, F.array().cast("array<int>")).when(k >= n, F.sequence(F.lit(0), n.cast("int") - 1)).when(k <= 0, F.array().cast("array<int>")).when(k == 1, F.array(F.lit(0))).otherwise(some)


def evenly(times: Column, k: Column) -> Column:
    """``k`` of the times at equal steps of their index."""
    return _let(times, lambda t: F.transform(even_indices(F.size(t), k), lambda i: F.get(t, i)))


def snapped(times: Column, lo: Column, hi: Column, grid: Column) -> Column:
    """Times on the grid that starts at lo, none behind hi; a grid of 0 keeps them."""
    last = F.floor((hi - lo) / grid + 1e-9)
    on = F.transform(times, lambda p: lo + F.least(F.greatest(F.bround((p - lo) / grid), F.lit(0.0)), last.cast("double")) * grid)
    return _set(F.when(grid > 0, on).otherwise(times))


def uniform(lo: Column, hi: Column, n: Column, grid: Column, anchors: Column | None = None) -> Column:
    """n points with both ends; each anchor then takes the place of the point nearest to it."""
    points = F.when((n <= 1) | (hi <= lo), F.array(((lo + hi) / 2).cast("double"))).otherwise(M.linspace(lo.cast("double"), hi.cast("double"), n))
    if anchors is not None:
        order = F.array_sort(F.array_distinct(F.transform(anchors, lambda a: F.least(F.greatest(a.cast("double"), lo.cast("double")), hi.cast("double")))))

        def put(have: Column, a: Column) -> Column:
            at = F.array_min(F.transform(have, lambda p, i: F.struct(F.abs(p - a).alias("d"), i.alias("i"))))["i"]
            return _let(at, lambda j: F.transform(have, lambda p, i: F.when(i == j, a).otherwise(p)))

        points = F.aggregate(order, points, put)
    return snapped(points, lo, hi, grid)


def in_any(t: Column, intervals: Column, pad: float = 0.5) -> Column:
    return F.exists(intervals, lambda v: (t >= v["a"] - pad) & (t <= v["b"] + pad))


def grid_points(lo: Column, hi: Column, grid: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.floor((hi - lo) / grid + 1e-9).cast("int")), lambda k: F.round((lo + k * grid).cast("double"), 3))


def visible(lo: Column, hi: Column, grid: Column, masked: Column) -> Column:
    """Grid points outside the masked intervals."""
    return F.filter(grid_points(lo, hi, grid), lambda t: ~in_any(t, masked))


def pick(candidates: Column, n: Column, anchors: Column, grid: Column) -> Column:
    """n candidates at equal steps of their index; anchors that a candidate lies near take the nearest place."""

    def put(cands: Column):
        def one(have: Column, a: Column) -> Column:
            at = F.array_min(F.transform(have, lambda p, i: F.struct(F.abs(p - a).alias("d"), i.alias("i"))))["i"]
            near = F.exists(cands, lambda c: F.abs(c - a) <= grid / 2 + 1e-6)
            return F.when(near & (F.size(have) > 0), _let(at, lambda j: F.transform(have, lambda p, i: F.when(i == j, a).otherwise(p)))).otherwise(have)

        return one

    wish = F.array_sort(F.array_distinct(anchors))
    start = lambda c: F.when(n == 1, F.array(F.get(c, F.floor(F.size(c) / 2).cast("int")))).otherwise(evenly(c, n))
    return _let(candidates.cast(NONE), lambda c: F.when(F.size(c) == 0, _empty()).otherwise(_set(F.aggregate(wish, start(c), put(c)))))


def unmasked(times: Column, lo: Column, hi: Column, grid: Column, masked: Column) -> Column:
    """Masked times moved to the nearest free grid point, the earlier of two as near; dropped if none is free."""
    free = visible(lo, hi, grid, masked)

    def move(cands: Column):
        def one(have: Column, t: Column) -> Column:
            left = F.filter(cands, lambda c: ~F.array_contains(have, c))
            best = F.array_min(F.transform(left, lambda c: F.struct(F.abs(c - t).alias("d"), c.alias("c"))))["c"]
            rest = F.array_remove(have, t)
            return F.when(~in_any(t, masked), have).when(best.isNull(), rest).otherwise(F.concat(rest, F.array(best)))

        return one

    return _let(free, lambda c: F.array_sort(F.aggregate(times, F.transform(times, lambda t: F.round(t, 3)), move(c))))


def sharpest_in_bins(times: Column, sharp: Column, pinned: Column) -> Column:
    """Each time moved to the sharpest second of its own bin, between the middles to its neighbours.

    ``sharp`` is array<struct<t, s>> without masked seconds; bins are half-open but for the last. Equal
    sharpness goes to the earliest second; an empty bin and pinned times keep theirs.
    """
    n = F.size(times)

    def bin_(t: Column, i: Column) -> Column:
        before, after = F.get(times, i - 1), F.get(times, i + 1)
        low = F.coalesce((before + t) / 2, t - (after - t) / 2)
        high = F.coalesce((t + after) / 2, t + (t - before) / 2)
        inside = F.filter(sharp, lambda x: (x["t"] >= low) & ((x["t"] < high) | ((i == n - 1) & (x["t"] <= high))))
        best = F.array_min(F.transform(inside, lambda x: F.struct((-x["s"]).alias("s"), x["t"].alias("t"))))["t"]
        return F.when(F.array_contains(pinned, t), t).otherwise(F.coalesce(best.cast("double"), t))

    return F.when(n < 2, times).otherwise(F.transform(times, bin_))


def dense(a: Column, b: Column, grid: Column) -> Column:
    """Every grid step from the lesser to the greater, one step beyond where they do not meet."""
    lo, hi = F.least(a, b), F.greatest(a, b)
    return F.transform(F.sequence(F.lit(0), F.ceil((hi + grid - lo) / grid).cast("int") - 1), lambda k: (lo + k * grid).cast("double"))


def take(times: Column, lo: Column, hi: Column, n: Column, grid: Column) -> Column:
    """Exactly n where the grid has as many: clipped, snapped, thinned evenly or filled evenly; null if empty."""
    on = _set(F.transform(times, lambda t: F.bround((F.least(F.greatest(t, lo.cast("double")), hi.cast("double")) - lo) / grid) * grid + lo))

    def sized(got: Column) -> Column:
        rest = F.array_except(F.transform(dense(lo, hi, grid), lambda x: F.round(x, 3)), got)
        fill = _let(rest, lambda r: evenly(r, F.least(n - F.size(got), F.size(r))))
        return F.when(F.size(got) > n, evenly(got, n)).when(F.size(got) < n, F.array_sort(F.array_distinct(F.concat(got, fill)))).otherwise(got)

    return F.when(F.size(times) > 0, _let(on, sized))


def spread(secs: Column, weights: Column, lo: Column, hi: Column, n: Column, share: float, grid: Column) -> Column:
    """Weighted points by the inverse of the cumulative weight, and a uniform share; free places are filled."""
    n_uni = F.bround(n * F.lit(share))
    total = F.aggregate(weights, F.lit(0.0), lambda a, w: a + w)
    cdf = F.aggregate(weights, _empty(), lambda a, w: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0.0)) + w)))
    m = n - n_uni
    uni = F.when(n_uni >= 1, M.linspace(lo.cast("double"), hi.cast("double"), n_uni)).otherwise(_empty())
    places = F.when(m >= 1, F.transform(F.sequence(F.lit(0), F.greatest(m.cast("int") - 1, F.lit(0))), lambda i: (i + 0.5) / m)).otherwise(_empty())
    # names for what is used again and again: the shares are made once
    drawn = _let(cdf, lambda c: _let(F.transform(c, lambda x: x / F.try_element_at(c, F.lit(-1))), lambda c: F.transform(places, lambda q: F.get(secs, F.least(F.size(F.filter(c, lambda x: x < q)), F.size(secs) - 1)).cast("double"))))
    on = _set(F.transform(F.concat(uni, drawn), lambda t: F.bround((t - lo) / grid) * grid + lo))

    def filled(got: Column) -> Column:
        rest = F.array_except(F.transform(secs, lambda s: F.round(s.cast("double"), 3)), got)
        return F.when(F.size(got) < n, F.array_sort(F.array_distinct(F.concat(got, evenly(rest, F.least(n - F.size(got), F.size(rest))))))).otherwise(got)

    return F.when(total > 0, _let(on, filled))


def on_full_grid(coarse: Column, step: int) -> Column:
    """Weights known at every ``step``-th place brought to all places: linear in between, level at the end."""
    last = F.size(coarse) - 1
    places = F.sequence(F.lit(0), (last + 1) * step - 1)

    def at(i: Column) -> Column:
        k = F.floor(i / F.lit(step)).cast("int")
        a, b = F.get(coarse, k), F.get(coarse, F.least(k + 1, last))
        return a + (b - a) * (i - k * step) / F.lit(float(step))

    return F.transform(places, at)


def dilated(weights: Column, radius: int) -> Column:
    """The largest weight within ``radius`` places."""
    return F.transform(weights, lambda w, i: F.array_max(F.slice(weights, F.greatest(i - radius, F.lit(0)) + 1, F.least(i, F.lit(radius)) + radius + 1)))


def focused(weights: Column, focus: Column) -> Column:
    """Weights of the places that have focus; all of them where none has both."""
    both = F.zip_with(weights, focus, lambda w, f: w * f)
    return F.when(F.exists(both, lambda x: x > 0), both).otherwise(weights)


def asked_window(question: Column, lo: Column, hi: Column, anchors: Column) -> tuple[Column, Column]:
    """The part of [lo, hi] that a question asks about: between two named times, or from one on."""
    a, b = F.array_min(anchors).cast("double"), F.array_max(anchors).cast("double")
    two = X.found(question, r"(?i)\bbetween\b") & (F.size(anchors) == 2) & (b > a)
    one = X.found(question, r"(?i)\bafter\b") & (F.size(anchors) == 1)
    return F.when(two, F.greatest(a, lo)).when(one, F.least(a, hi)).otherwise(lo.cast("double")), F.when(two, F.least(b, hi)).otherwise(hi.cast("double"))


def padded(runs: Column, share: float = 0.075) -> Column:
    """Runs (a, b) widened on both sides by a share of their length."""
    return F.transform(runs, lambda r: F.struct((r["a"] - (r["b"] - r["a"]) * share).alias("a"), (r["b"] + (r["b"] - r["a"]) * share).alias("b")))


def per_segment(segments: Column, n: Column) -> Column:
    """As many points in each segment of positive length, two at least."""
    return _let(F.filter(segments, lambda s: s["b"] > s["a"]), lambda own: F.flatten(F.transform(own, lambda s: M.linspace(s["a"].cast("double"), s["b"].cast("double"), F.greatest(F.lit(2), F.floor(n / F.size(own)))))))


def halved(times: Column, most: int) -> Column:
    """Every second point left out again and again, until at most ``most`` are left."""
    step = F.pow(F.lit(2), F.greatest(F.ceil(F.log2(F.size(times) / F.lit(most))), F.lit(0))).cast("int")
    return F.filter(times, lambda t, i: i % step == 0)


def refined(coarse: DataFrame, keys: list[str], t: str, hit: Column, radius: int, step: int) -> DataFrame:
    """Second pass around the hits of a coarse one: grid points of ``step`` within ``radius`` of a hit."""
    near = coarse.where(hit).select(*keys, F.explode(F.sequence(F.col(t) - radius, F.col(t) + radius, F.lit(step))).alias(t))
    return near.distinct()


@dataclass
class Scene:
    """What a rule looks at; a rule returns the times it wishes for, or null. Runs are array<struct<a, b>>, counts and firsts array<struct<t, n>> and (t, cls)."""

    question: Column
    lo: Column
    hi: Column
    n: Column
    grid: Column
    runs: Column
    any_runs: Column
    both_runs: Column
    counts: Column
    firsts: Column
    masked: Column
    anchors: Column

    def take(self, times: Column) -> Column:
        return take(times, self.lo, self.hi, self.n, self.grid)

    def around(self, times: Column, radius: float) -> Column:
        return F.flatten(F.transform(times, lambda t: dense(t - radius, t + radius, self.grid)))

    def rises(self) -> Column:
        """Times at which the count grows."""
        return F.transform(F.filter(self.counts, lambda x, i: x["n"] > F.coalesce(F.get(self.counts, i - 1)["n"], F.lit(0))), lambda x: x["t"].cast("double"))

    def span(self) -> Column:
        """(a, b) from the first run's start to the last one's end; null without runs."""
        return F.when(F.size(self.runs) > 0, F.struct(F.get(self.runs, F.lit(0))["a"].alias("a"), F.try_element_at(self.runs, F.lit(-1))["b"].alias("b")))

    def ordinal(self) -> Column:
        return F.regexp_extract(self.question, r"([0-9]+)(?:st|nd|rd|th)", 1).try_cast("int")


def _points(runs: Column, s: Scene) -> Column:
    return F.flatten(F.transform(runs, lambda r: dense(r["a"].cast("double"), r["b"].cast("double"), s.grid)))


def leave_view(s: Scene) -> Column:
    wide = padded(s.runs)
    total = F.aggregate(wide, F.lit(0.0), lambda a, r: a + (r["b"] - r["a"]))
    own = lambda r: M.linspace(r["a"], r["b"], F.greatest(F.lit(2.0), F.bround(s.n * (r["b"] - r["a"]) / F.greatest(total, F.lit(1e-9)))))
    return F.when(F.size(s.runs) > 0, (F.flatten(F.transform(wide, own))))


def last_seen_pair(s: Scene) -> Column:
    last = F.array_max(F.transform(s.any_runs, lambda r: r["b"].cast("double")))
    return F.when(last.isNotNull(), (dense(last - 120, last + 120, s.grid)))


def longest_together(s: Scene) -> Column:
    return F.when(F.size(s.any_runs) > 0, (evenly(_points(s.any_runs, s), s.n)))


def retrieval_exists(s: Scene) -> Column:
    """From the named time on, the nearer the denser, and both sides of masked intervals."""
    t = F.least(F.greatest(F.get(s.anchors, F.lit(0)).cast("double"), s.lo.cast("double")), s.hi.cast("double"))
    edges = F.flatten(F.transform(F.filter(s.masked, lambda v: (v["b"] >= t) & (v["a"] <= s.hi)), lambda v: dense(F.greatest(s.lo, v["a"] - 10).cast("double"), F.least(s.hi, v["b"] + 10).cast("double"), s.grid)))
    steps = M.geomspace(F.lit(15.0), F.greatest(F.lit(30.0), s.hi - t), 16)
    total = F.aggregate(steps, F.lit(0.0), lambda a, x: a + x)
    run = F.aggregate(steps, _empty(), lambda a, x: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0.0)) + x)))
    far = F.transform(run, lambda x: t + x / total * (s.hi - t))
    return F.when((F.size(s.anchors) > 0) & (s.hi > t), (F.concat(edges, far, F.array(t))))


def nth_inserted(s: Scene) -> Column:
    k = s.ordinal()
    near = F.filter(s.rises(), lambda t, i: F.abs(i + 1 - k) <= 1)
    sparse = evenly(_points(s.runs, s), F.floor(s.n / 4))
    return F.when((k >= 2) & (F.size(near) > 0), (F.concat(s.around(near, 60.0), sparse)))


def retrieved_when(s: Scene) -> Column:
    r = F.get(padded(s.runs), F.lit(0))
    t = F.coalesce(F.get(s.anchors, F.lit(0)).cast("double"), r["a"])
    return F.when(F.size(s.runs) > 0, (F.concat(dense(t, t + 60, s.grid), dense(r["b"] - 60, r["b"] + 60, s.grid))))


def last_visible(s: Scene) -> Column:
    ends = F.transform(F.slice(s.runs, F.greatest(F.size(s.runs) - 2, F.lit(1)), 3), lambda r: r["b"].cast("double"))
    return F.when(F.size(s.runs) > 0, (F.concat(s.around(ends, 30.0), M.linspace(s.lo.cast("double"), s.hi.cast("double"), F.floor(s.n / 6)))))


def after_first_inserted(s: Scene) -> Column:
    return F.when(F.size(s.runs) > 0, (M.linspace(s.span()["a"] - 60.0, s.span()["b"] + 60.0, s.n)))


def at_same_time(s: Scene) -> Column:
    wide = F.transform(s.both_runs, lambda r: F.struct((r["a"] - 30.0).alias("a"), (r["b"] + 30.0).alias("b")))
    return F.when(F.size(s.both_runs) > 0, (_points(wide, s))).when(F.size(s.any_runs) > 0, (evenly(_points(s.any_runs, s), s.n)))


def _peaks(s: Scene, k: int, apart: float) -> Column:
    order = F.array_sort(F.transform(s.counts, lambda x: F.struct((-x["n"]).alias("n"), x["t"].cast("double").alias("t"))))
    return F.aggregate(order, _empty(), lambda a, x: F.when((F.size(a) < k) & ~F.exists(a, lambda y: F.abs(y - x["t"]) <= apart), F.concat(a, F.array(x["t"]))).otherwise(a))


def max_count(s: Scene) -> Column:
    return F.when(F.size(s.counts) > 0, (s.around(_peaks(s, 3, 60.0), 60.0)))


def max_count_many(s: Scene) -> Column:
    most = F.array_max(F.transform(s.counts, lambda x: x["n"]))
    return F.when(most >= 5, (s.around(_peaks(s, 3, 60.0), 20.0)))


def _changes(s: Scene, a: Column, b: Column) -> Column:
    """Segments of [a, b] between changes of the count."""
    moved = F.filter(s.counts, lambda x, i: x["n"] != F.coalesce(F.get(s.counts, i - 1)["n"], F.lit(0)))
    at = F.filter(F.transform(moved, lambda x: x["t"].cast("double")), lambda t: (t > a) & (t < b))
    cuts = F.concat(F.array(a), at, F.array(b))
    return F.transform(F.sequence(F.lit(0), F.size(cuts) - 2), lambda i: F.struct(F.get(cuts, i).alias("a"), F.get(cuts, i + 1).alias("b")))


def _named_range(s: Scene) -> tuple[Column, Column]:
    return F.array_min(s.anchors).cast("double"), F.array_max(s.anchors).cast("double")


def between(s: Scene) -> Column:
    a, b = _named_range(s)
    return F.when((F.size(s.anchors) >= 2) & (b - a > 300), (per_segment(_changes(s, a, b), s.n)))


def between_long(s: Scene) -> Column:
    a, b = _named_range(s)
    return F.when((F.size(s.anchors) >= 2) & (b - a > 600), (per_segment(_changes(s, a, b), s.n)))


def all_classes(s: Scene) -> Column:
    a, b = s.span()["a"] - 60.0, s.span()["b"] + 60.0
    return F.when(F.size(s.runs) > 0, F.when(b - a > 600, (per_segment(_changes(s, a, b), s.n))).otherwise((M.linspace(a, b, s.n))))


def applied_times(s: Scene) -> Column:
    return F.when(F.size(s.rises()) > 0, (s.around(s.rises(), 30.0)))


def nth_unique(s: Scene) -> Column:
    k = s.ordinal()
    near = F.transform(F.filter(F.array_sort(s.firsts), lambda x, i: F.abs(i + 1 - k) <= 1), lambda x: x["t"].cast("double"))
    return F.when(F.size(near) > 0, (s.around(near, 60.0)))


def nth_unique_late(s: Scene) -> Column:
    a, b = s.span()["a"].cast("double"), s.span()["b"].cast("double")
    cut = a + 0.3 * (b - a)
    return F.when((s.ordinal() >= 3) & (F.size(s.runs) > 0), (F.concat(M.linspace(a, cut, F.floor(s.n * 0.3)), M.linspace(cut, b, s.n - F.floor(s.n * 0.3)))))


def count_inserted(s: Scene) -> Column:
    points = F.filter(dense(s.span()["a"] - 60.0, s.span()["b"] + 60.0, s.grid), lambda t: ~in_any(t, s.masked))
    return F.when(F.size(s.runs) > 0, (points))


def present_at(s: Scene) -> Column:
    """Quadratically denser towards the named time."""
    t = F.get(s.anchors, F.lit(0)).cast("double")
    back = F.transform(F.sequence(F.lit(0), s.n.cast("int") - 1), lambda i: t - (t - s.lo) * F.pow(i / s.n, F.lit(2.0)))
    return F.when(F.size(s.anchors) > 0, (back))


#: Rules in the order they are tried: name, pattern of the question, sampler.
RULES = [
    ("leave_fov", r"(?i)how many separate times.*leave the field of view", leave_view),
    ("lastseen_pair", r"(?i)with which other foreign object classes", last_seen_pair),
    ("longest_cooc", r"(?i)longest co-?occurrence", longest_together),
    ("retrieval_exists", r"(?i)does a retrieval of this object exist", retrieval_exists),
    ("nth_inserted", r"(?i)[0-9]+(?:st|nd|rd|th) visible .*inserted in the abdomen", nth_inserted),
    ("retrieval_when", r"(?i)when .*retrieved", retrieved_when),
    ("last_visible", r"(?i)when .*last visible", last_visible),
    ("after_first_inserted", r"(?i)after .*first inserted", after_first_inserted),
    ("and_same_time", r"(?i)both .*at the same time", at_same_time),
    ("max_count_many", r"(?i)maximum number of .* in total", max_count_many),
    ("max_count", r"(?i)maximum number", max_count),
    ("interval_long", r"(?i)how many .*between [0-9:]+ and [0-9:]+", between_long),
    ("interval_seg", r"(?i)between [0-9:]+ and [0-9:]+", between),
    ("all_classes", r"(?i)all .*classes", all_classes),
    ("applied_times", r"(?i)all .*times .*applied", applied_times),
    ("nth_unique_late", r"(?i)which late .*[0-9]+(?:st|nd|rd|th) unique", nth_unique_late),
    ("nth_unique_class", r"(?i)[0-9]+(?:st|nd|rd|th) unique", nth_unique),
    ("count_inserted", r"(?i)how many .*inserted", count_inserted),
    ("present_at_t", r"(?i)how many .*present at", present_at),
]


def rule_name(question: Column, rules=RULES) -> Column:
    """The first rule whose pattern matches."""
    return X.first_match(question, [(rule, pattern) for rule, pattern, _ in rules], None)


def edge_points(s: Scene, window: float = 90.0, share: float = 0.125) -> Column:
    """Around the first or last edge that the question names, and a uniform share."""
    first, last = F.get(s.runs, F.lit(0))["a"].cast("double"), F.try_element_at(s.runs, F.lit(-1))["b"].cast("double")
    kind = X.edge_kind(s.question)
    at = F.when(kind == "first", first).when(kind == "last", last)
    uni = M.linspace(s.lo.cast("double"), s.hi.cast("double"), F.bround(s.n * F.lit(share)))
    return F.when(at.isNotNull(), s.take(F.concat(evenly(dense(at - window, at + window, s.grid), s.n - F.bround(s.n * F.lit(share))), uni)))


def bridged(s: Scene, spread_sd: float = 30.0, share: float = 0.3) -> Column:
    """Around two named times and, with a share of the points, from one to the other; null if too few places are left."""
    a, b = _named_range(s)
    mid = F.bround(s.n * F.lit(share))
    ends = s.n - mid
    near = lambda t, k: M.linspace(t - spread_sd, t + spread_sd, k)
    inner = F.slice(M.linspace(a, b, mid + 2), F.lit(2), F.greatest(mid, F.lit(0)).cast("int"))
    points = F.concat(near(a, F.floor(ends / 2)), near(b, ends - F.floor(ends / 2)), F.when(b > a, inner).otherwise(_empty()))
    lo, hi = s.lo.cast("double"), s.hi.cast("double")
    on = snapped(F.transform(points, lambda x: F.least(F.greatest(x, lo), hi)), lo, hi, s.grid)
    return _let(on, lambda p: F.when(F.size(p) >= F.greatest(F.lit(4), F.floor(s.n / 4)), p))


def seen_weights(s: Scene, secs: Column, runs: Column, dilate: float) -> Column:
    """1 for the seconds within ``dilate`` of a run, else 0."""
    return F.transform(secs, lambda t: F.when(in_any(t, runs, dilate), 1.0).otherwise(0.0))


def towards(s: Scene, runs: Column, share: float, dilate: float = 30.0, focus: Column | None = None) -> Column:
    """Points drawn towards the runs, ``share`` of them uniform; null without runs. ``focus``: array of weights of
    the grid's points, which are looked at alone where runs and focus meet."""
    secs = grid_points(s.lo, s.hi, s.grid)

    def drawn(own: Column) -> Column:
        w = seen_weights(s, own, runs, dilate)
        w = w if focus is None else _let(w, lambda x: focused(x, focus))
        return _let(w, lambda x: spread(own, x, s.lo, s.hi, s.n, share, s.grid))

    return F.when((F.size(runs) > 0) & (s.hi > s.lo), _let(secs, drawn))


def drawn_config(key: Column, n: int, seed: str = "cfg") -> Column:
    """A number below n that is fixed for each key."""
    return F.pmod(F.conv(F.substring(X.seeded(seed, key), 1, 7), 16, 10).cast("long"), F.lit(n))
