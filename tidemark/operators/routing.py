"""Requests split by route, one sampler planned for each part.

A route has a condition on the request and a sampler of its scene. A request is written once for every route whose
condition holds, into that route's folder; each sampler reads its own folder alone; of a request's routes, the
first whose sampler gives points decides. The plan grows by one small branch per route, and routes that no
request takes are not planned.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import ladder as L
from tidemark.operators import sampling as S
from tidemark.staging import Steps


@dataclass
class Route:
    """``points`` is called for routes in use; it returns array<double>, null where the route does not serve."""

    name: str
    when: Column
    points: Callable[[], Column]


def routed(requests: DataFrame, keys: list[str], routes: list[Route]) -> DataFrame:
    """keys, route (its name) and points, for the requests that some route serves. ``keys`` name a request."""
    steps = Steps(requests.sparkSession)
    held = F.filter(F.array(*[F.when(r.when, F.lit(i)) for i, r in enumerate(routes)]), lambda i: i.isNotNull())
    parts = steps(requests.withColumn("_route", F.explode(held)), "routes", "_route")
    used = sorted(r["_route"] for r in parts.select("_route").distinct().collect())  # as many as routes at most
    out = None
    for i in used:
        own = parts.where(F.col("_route") == i).select(*keys, "_route", routes[i].points().alias("points")).where("points is not null")
        out = own if out is None else out.unionByName(own)
    if out is None:
        out = parts.select(*keys, "_route", F.lit(None).cast("array<double>").alias("points"))
    first = out.groupBy(*keys).agg(F.min(F.struct("_route", "points")).alias("_f"))
    names = F.array(*[F.lit(r.name) for r in routes])
    found = steps(first.select(*keys, F.get(names, F.col("_f._route")).alias("route"), F.col("_f.points").alias("points")), "routed")
    steps.clear(keep=1)
    return found


def rule_routes(s: S.Scene, rules=S.RULES) -> list[Route]:
    """The question rules: a request goes to the first whose pattern matches, if that wishes for any time."""
    name = S.rule_name(s.question, rules)
    wish = lambda sampler: lambda: (lambda w: F.when(F.size(w) > 0, w))(sampler(s).cast(S.NONE))
    return [Route(rule, name == rule, wish(sampler)) for rule, _, sampler in rules]


def dispatch_routes(s: S.Scene, wide: S.Scene, classes: Column, edge_runs: Column, fine_runs: Column, focus: Column) -> list[Route]:
    """All ways to choose points, in the order they are tried.

    ``wide`` is the scene as asked, which rules and named windows look at; ``s`` begins at the named time where a
    question asks when something happens after it. ``classes`` is the number of classes that the question names.
    """
    q, two = s.question, F.size(s.anchors) >= 2
    a, b = F.array_min(s.anchors).cast("double"), F.array_max(s.anchors).cast("double")
    time, kind = X.found(q, r"(?i)\bwhen\b"), X.edge_kind(q)
    lo, hi = F.greatest(a, wide.lo), F.least(b, wide.hi)
    return [
        *rule_routes(wide),
        Route("between", two & X.found(q, r"(?i)\bbetween\b") & (hi > lo), lambda: S.snapped(S.M.linspace(lo, hi, s.n), wide.lo, wide.hi, s.grid)),
        Route("bridge", two & ~X.found(q, r"(?i)\bbetween\b"), lambda: S.bridged(wide)),
        Route("edge", time & kind.isin("first", "last"), lambda: L.edge_budget(s, edge_runs, kind, 90.0, 0.25, fine=fine_runs, narrow=45.0)),
        Route("classes", time & (classes >= 2), lambda: S.towards(s, s.any_runs, 0.25)),
        Route("weak", ~time & (F.size(s.anchors) == 0), lambda: S.towards(s, s.runs, 0.5)),
        Route("phase", F.size(s.anchors) > 0, lambda: S.towards(s, s.runs, 0.25, focus=focus)),
        Route("seen", time, lambda: S.towards(s, s.runs, 0.25)),
        Route("uniform", F.lit(True), lambda: S.uniform(s.lo, s.hi, s.n, s.grid, s.anchors)),
    ]


def dispatched(requests: DataFrame, keys: list[str], routes: list[Route], s: S.Scene) -> DataFrame:
    """keys, route, points. A rule gives the times it wishes for, which are brought to the budget here, once for all."""
    rules = [name for name, *_ in S.RULES]
    kept = [*keys, *[c for c in ("lo", "hi") if c in requests.columns and c not in keys]]
    found = routed(requests, kept, routes)
    return found.withColumn("points", F.when(F.col("route").isin(*rules), s.take(F.col("points"))).otherwise(F.col("points")))
