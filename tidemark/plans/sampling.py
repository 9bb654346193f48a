"""Sampler queries. Requests come from orders, or from the timeline of each user in ``events``: an hour is a
step of 5 seconds, so a month is an hour of video, and views are the class that is asked for."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.functions import times as M
from tidemark.operators import ladder as L
from tidemark.operators import routing as R
from tidemark.operators import sampling as S
from tidemark.operators import timeline as T
from tidemark.plans.base import EV, events, table


def _requests(s, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    lo = F.pmod(k, F.lit(50))
    return table(s, d, "orders").select("o_orderkey", lo.alias("lo"), (lo + F.pmod(c, F.lit(97))).alias("hi"), F.pmod(k, F.lit(9)).alias("n"), (F.pmod(k, F.lit(2)) * 4 + 1).alias("grid"), (lo + F.pmod(c * 7, F.lit(97))).alias("anchor"))


RQ = "rq as (select o_orderkey, o_orderkey % 50 as lo, o_orderkey % 50 + o_custkey % 97 as hi, o_orderkey % 9 as n, (o_orderkey % 2) * 4 + 1 as grid, o_orderkey % 50 + (o_custkey * 7) % 97 as anchor from orders)"
_PTS = "pt as (select *, case when n <= 1 or hi <= lo then [(lo + hi) / 2.0] else [cast(lo as double) + cast(hi - lo as double) * i / (n - 1) for i in range(n)] end as p from rq)"
_SNAP = "list_sort(list_distinct([cast(lo + least(greatest(round_even((x - lo) / grid, 0), 0), floor((hi - lo) / grid + 1e-9)) * grid as bigint) for x in {p}]))"


def _ints(times):
    return F.array_join(F.transform(times, lambda x: F.bround(x).cast("long").cast("string")), ",")


def smp_uniform_grid(s, d):
    return _requests(s, d).select("o_orderkey", _ints(S.uniform(F.col("lo"), F.col("hi"), F.col("n"), F.col("grid"))).alias("t"))


def smp_uniform_anchor(s, d):
    return _requests(s, d).select("o_orderkey", _ints(S.uniform(F.col("lo"), F.col("hi"), F.col("n"), F.col("grid"), F.array("anchor"))).alias("t"))


def _masks():
    return F.array(F.struct((F.col("lo") + 10).alias("a"), (F.col("lo") + 25).alias("b")), F.struct((F.col("lo") + 40).alias("a"), (F.col("lo") + 44).alias("b")))


_FREE = "fr as (select *, list_filter([lo + k * grid for k in range(cast(floor((hi - lo) / grid) as bigint) + 1)], lambda x: not (x between lo + 9.5 and lo + 25.5 or x between lo + 39.5 and lo + 44.5)) as c from rq)"


def smp_visible(s, d):
    return _requests(s, d).select("o_orderkey", _ints(S.visible(F.col("lo"), F.col("hi"), F.col("grid"), _masks())).alias("t"))


def smp_visible_pick(s, d):
    v = S.visible(F.col("lo"), F.col("hi"), F.col("grid"), _masks())
    return _requests(s, d).where("n > 1").select("o_orderkey", _ints(S.pick(v, F.col("n"), F.array().cast("array<double>"), F.col("grid"))).alias("t"))


def smp_unmasked(s, d):
    r = _requests(s, d).where("n > 1").withColumn("u", S.uniform(F.col("lo"), F.col("hi"), F.col("n"), F.col("grid")))
    r = r.withColumn("v", S.unmasked(F.col("u"), F.col("lo"), F.col("hi"), F.col("grid"), _masks()))
    return r.select("o_orderkey", F.size("u").alias("before"), F.size("v").alias("after"), _ints(F.col("v")).alias("t"))


def smp_dense(s, d):
    return _requests(s, d).select("o_orderkey", _ints(S.dense(F.col("hi"), F.col("lo"), F.col("grid"))).alias("t"))


def smp_take_n(s, d):
    times = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: (F.col("lo") + F.pmod(i * F.col("anchor"), F.lit(60))).cast("double"))
    return _requests(s, d).where("n > 1 and hi > lo").select("o_orderkey", _ints(S.take(times, F.col("lo"), F.col("hi"), F.col("n"), F.col("grid"))).alias("t"))


def smp_equal_segments(s, d):
    seg = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.struct((F.col("lo") + i * 30).alias("a"), (F.col("lo") + i * 30 + F.pmod(F.col("anchor"), F.lit(3)) * i).alias("b")))
    return _requests(s, d).select("o_orderkey", F.transform(S.per_segment(seg, F.col("n") * 3), lambda x: F.bround(x * 10)).alias("v")).select("o_orderkey", _ints(F.col("v")).alias("t"))


def smp_halved(s, d):
    t = F.sequence(F.col("lo").cast("double").cast("long"), F.col("hi"))
    return _requests(s, d).select("o_orderkey", _ints(S.halved(t, 8)).alias("t"))


def smp_padded_runs(s, d):
    r = T.runs(events(s, d).where("cls = 'view'").select("user_id", "hr").distinct(), ["user_id"], "hr").where("n > 1")
    p = S.padded(F.array(F.struct(F.col("start").cast("double").alias("a"), F.col("end").cast("double").alias("b"))))[0]
    return r.select("user_id", "start", F.round(p["a"], 6).alias("a"), F.round(p["b"], 6).alias("b"))


def smp_inverse_cdf(s, d):
    """Twelve hours of each day part drawn by the events in them; the rest of the budget is filled evenly."""
    c = events(s, d).groupBy("user_id", F.pmod("hr", F.lit(24)).alias("h")).agg(F.count("*").alias("n"))
    a = c.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("h", "n"))).alias("x"))
    secs, w = F.transform("x", lambda x: x["h"].cast("double")), F.transform("x", lambda x: x["n"].cast("double"))
    return a.select("user_id", _ints(S.spread(secs, w, F.lit(0), F.lit(23), F.lit(6), 0.0, F.lit(1))).alias("t"))


def smp_sharpest(s, d):
    """The most valuable hour of each of eight bins."""
    e = events(s, d).where("value is not null").groupBy("user_id", F.pmod("hr", F.lit(64)).alias("t")).agg(F.max("value").alias("s"))
    a = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("t", "s"))).alias("x"))
    times = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: (i * 8 + 4).cast("double"))
    return a.select("user_id", _ints(S.sharpest_in_bins(times, F.col("x"), F.array(F.lit(20.0)))).alias("t"))


def _day(s, d):
    """Views of each user by hour of the day, as 24 numbers."""
    c = events(s, d).where("cls = 'view'").groupBy("user_id", F.pmod("hr", F.lit(24)).cast("int").alias("h")).agg(F.count("*").alias("n"))
    a = c.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("h", F.col("n").cast("double")))).alias("m"))
    return a.select("user_id", F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: F.coalesce(F.try_element_at("m", h), F.lit(0.0))).alias("n"))


def smp_detector_weighted(s, d):
    """Every second hour is looked at; hours with two views or more draw points, their neighbours too, and a
    quarter of the points is uniform."""
    mask = F.transform(F.filter("n", lambda x, i: i % 2 == 0), lambda x: F.when(x >= 2, 1.0).otherwise(0.0))
    rows = _day(s, d).withColumn("w", S.on_full_grid(mask, 2)).withColumn("w", S.dilated(F.col("w"), 1))
    secs = F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: h.cast("double"))
    return rows.select("user_id", _ints(S.spread(secs, F.col("w"), F.lit(0), F.lit(23), F.lit(8), 0.25, F.lit(1))).alias("t"))


def smp_phase_focus(s, d):
    """Views of the quarter of the day that a named hour lies in; of the whole day if that has none."""
    focus = F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: F.when(F.floor(h / 6) == F.floor(F.pmod("user_id", F.lit(24)) / 6), 1.0).otherwise(0.0))
    rows = _day(s, d).withColumn("w", S.focused(F.col("n"), focus))
    secs = F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: h.cast("double"))
    return rows.select("user_id", _ints(S.spread(secs, F.col("w"), F.lit(0), F.lit(23), F.lit(6), 0.0, F.lit(1))).alias("t"))


def smp_asked_window(s, d):
    """Uniform points of the window that a question names, its times among them."""
    r = _requests(s, d).where("n > 1")
    first, second = F.col("lo") + 5, F.col("lo") + 5 + F.pmod("anchor", F.lit(30))
    q = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("What is seen between "), M.hhmmss(first), F.lit(" and "), M.hhmmss(second), F.lit("?"))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("What is done after "), M.hhmmss(first), F.lit("?"))).otherwise(F.lit("What is seen?"))
    r = r.withColumn("q", q).withColumn("a", M.anchors(F.col("q")))
    lo, hi = S.asked_window(F.col("q"), F.col("lo"), F.col("hi"), F.col("a"))
    return r.select("o_orderkey", _ints(S.uniform(lo, hi, F.col("n"), F.lit(1))).alias("t"))


def smp_refine(s, d):
    c = events(s, d).groupBy("user_id", (F.floor(F.col("hr") / 12) * 12).alias("t")).agg(F.count("*").alias("n"))
    return S.refined(c, ["user_id"], "t", F.col("n") >= 3, 12, 3)


def smp_config_draw(s, d):
    return table(s, d, "documents").groupBy(S.drawn_config(F.col("doc_id"), 5).alias("cfg")).agg(F.count("*").alias("n"))


#: One question for each rule, and some that none fits; {a} and {b} are clock times.
QUESTIONS = (
    "How many separate times did the Clip leave the field of view?", "The Clip was last seen with which other foreign object classes?", "Which pair has the longest co-occurrence?",
    "A Clip is seen at {a}. Does a retrieval of this object exist?", "When was the 2nd visible Clip inserted in the abdomen?", "When was the Clip at {a} retrieved?", "When was the Clip last visible?",
    "What is seen after the Clip was first inserted?", "Are both Clip and Sponge visible at the same time?", "What is the maximum number of Clips in total?", "What is the maximum number of Clips?",
    "How many Clips are seen between {a} and {b}?", "What is seen between {a} and {b}?", "List all object classes.", "List all the times a Clip was applied.", "Which late class is the 3rd unique one?", "Which is the 2nd unique class?",
    "How many Clips were inserted?", "How many Clips are present at {a}?", "When was the first Clip seen?", "What was done after {a}?", "Which tool is used?",
    "What changed at {a} and at {b}?", "When were Clip and Sponge touched?", "When after {a} is the Clip touched?", "What is done from {a} on?", "When was the last Clip seen?",
)


def _scenes(s, d):
    """One row per user: runs, counts and first times as arrays; the question is drawn by the user's id.

    Hours are summed once; an hour opens a run of a kind if the one before lacks it, and ends it if the next does.
    """
    e = events(s, d)
    hours = e.groupBy("user_id", "hr").agg(F.count_if(F.col("cls") == "view").alias("n"), F.count_if(F.col("cls") == "click").alias("clicks"), F.collect_set("cls").alias("classes"))
    w = _U().orderBy("hr")
    hours = hours.withColumn("t", (F.col("hr") - F.min("hr").over(_U())) * 5)
    masks = {"runs": F.col("n") > 0, "any_runs": F.lit(True), "both_runs": (F.col("n") > 0) & (F.col("clicks") > 0)}
    aggs = [F.max("t").alias("hi"), F.array_sort(F.collect_list(F.when(F.col("n") > 0, F.struct("t", "n")))).alias("counts"), F.array_sort(F.collect_list(F.struct("t", "classes"))).alias("seen")]
    for name, mask in masks.items():
        hours = hours.withColumn(f"_{name}", mask)
    for name in masks:
        beside = lambda step: F.coalesce((step("hr").over(w) - F.col("hr") == (1 if step is F.lead else -1)) & step(f"_{name}").over(w), F.lit(False))  # noqa: B023, E731
        hours = hours.withColumn(f"_{name}_a", F.when(F.col(f"_{name}") & ~beside(F.lag), F.col("t").cast("double"))).withColumn(f"_{name}_b", F.when(F.col(f"_{name}") & ~beside(F.lead), F.col("t").cast("double")))
        aggs.append(F.zip_with(F.array_sort(F.collect_list(f"_{name}_a")), F.array_sort(F.collect_list(f"_{name}_b")), lambda x, y: F.struct(x.alias("a"), y.alias("b"))).alias(name))
    out = hours.groupBy("user_id").agg(*aggs)
    # the first time of each class, in the order of time and name
    marks = F.flatten(F.transform("seen", lambda x: F.transform(F.array_sort(x["classes"]), lambda c: F.struct(x["t"].alias("t"), c.alias("cls")))))
    new = F.filter("_marks", lambda m, i: ~F.exists(F.slice("_marks", F.lit(1), i), lambda z: z["cls"] == m["cls"]))
    out = out.withColumn("_marks", marks).withColumn("firsts", new).drop("_marks", "seen")
    q = F.element_at(F.array(*map(F.lit, QUESTIONS)), (F.pmod("user_id", F.lit(len(QUESTIONS))) + 1).cast("int"))
    q = F.replace(F.replace(q, F.lit("{a}"), M.hhmmss(F.col("hi") * 0.25)), F.lit("{b}"), M.hhmmss(F.col("hi") * 0.75))
    return out.withColumn("q", q)


def _U():
    from pyspark.sql import Window

    return Window.partitionBy("user_id")


def _scene() -> S.Scene:
    masked = F.array(F.struct((F.col("hi") * 0.4).alias("a"), (F.col("hi") * 0.45).alias("b")))
    return S.Scene(F.col("q"), F.lit(0.0), F.col("hi").cast("double"), F.lit(32), F.lit(5.0), F.col("runs"), F.col("any_runs"), F.col("both_runs"), F.col("counts"), F.col("firsts"), masked, M.anchors(F.col("q")))


def smp_rules(s, d):
    """The rule that fires for each user's question, and its points."""
    rows = _scenes(s, d).withColumn("rule", S.rule_name(F.col("q")))
    keys = ["user_id", "hi", "rule"]
    found = R.routed(rows, [*keys], R.rule_routes(_scene())).select("user_id", _scene().take(F.col("points")).alias("p"))
    return rows.select(*keys).join(found, "user_id", "left").select(*keys, F.size("p").alias("n"), _ints(F.col("p")).alias("t"))


def smp_edge_alloc(s, d):
    return _scenes(s, d).select("user_id", _ints(S.edge_points(_scene())).alias("t"))


#: Thresholds of the share of views in an hour (four are all), each with the rows that must reach it.
RUNGS = [(0.5, 2), (0.25, 2), (0.25, 1)]


def _rung_runs(s, d):
    """Runs of every rung, an hour as 5 seconds. An hour without views has a score of 0, which reaches no threshold and
    needs no row; hours are counted from the user's first once the runs are found."""
    e = events(s, d)
    n = e.where("cls = 'view'").groupBy("user_id", (F.col("hr") * 5).alias("t")).agg(F.count("*").alias("n"))
    runs = L.rung_runs(n.withColumn("score", F.least(F.col("n") / 4.0, F.lit(1.0))), ["user_id"], "t", "score", RUNGS, 5)
    start = e.groupBy(F.col("user_id").alias("_user")).agg((F.min("hr") * 5).alias("_t0"))
    runs = runs.join(start, F.col("user_id").eqNullSafe(F.col("_user")))
    return runs.select("user_id", "rung", (F.col("a") - F.col("_t0")).alias("a"), (F.col("b") - F.col("_t0")).alias("b"))


def _laddered(s, d):
    """Scenes with the runs of the first rung that has any, and those of the weakest mask, the last rung."""
    runs = _rung_runs(s, d)
    pair = F.struct(F.col("a").cast("double").alias("a"), F.col("b").cast("double").alias("b"))
    of = lambda rung: F.coalesce(F.array_sort(F.collect_list(F.when(F.col("rung") == rung, pair))), F.array().cast("array<struct<a:double,b:double>>"))
    lists = runs.groupBy("user_id").agg(*[of(i).alias(f"_r{i}") for i in range(len(RUNGS))])
    first = F.coalesce(*[F.when(F.size(f"_r{i}") > 0, F.col(f"_r{i}")) for i in range(len(RUNGS))], F.col("_r0"))
    lists = lists.select("user_id", first.alias("edge_runs"), F.col(f"_r{len(RUNGS) - 1}").alias("fine_runs"))
    out = _scenes(s, d).join(lists, "user_id", "left")
    for name in ("edge_runs", "fine_runs"):
        out = out.withColumn(name, F.coalesce(name, F.filter("runs", lambda x: F.lit(False))))
    return out


def smp_ladder_runs(s, d):
    return L.first_rung(_rung_runs(s, d), ["user_id"])


def _edge_kind():
    return F.when(F.col("user_id") % 2 == 0, "first").otherwise("last")


def smp_edge_ladder(s, d):
    """About the first or last edge of the first rung that has one, looked for again in the weakest mask."""
    points = L.edge_budget(_scene(), F.col("edge_runs"), _edge_kind(), 90.0, 0.25, fine=F.col("fine_runs"), narrow=45.0)
    return _laddered(s, d).select("user_id", _ints(points).alias("t"))


def smp_edge_several(s, d):
    """The budget shared by up to three edges."""
    return _laddered(s, d).select("user_id", _ints(L.edge_budget(_scene(), F.col("edge_runs"), _edge_kind(), 60.0, 0.125, several=3)).alias("t"))


def smp_rule_dispatch(s, d):
    """The whole choice for each user's question: rule, named window, two times, edge, classes, weak focus, phase, uniform."""
    rows = _laddered(s, d).withColumn("anchors", M.anchors(F.col("q"))).withColumn("hi", F.col("hi").cast("double"))
    after = X.found(F.col("q"), r"(?i)\bwhen\b") & X.found(F.col("q"), r"(?i)\bafter\b") & (F.size("anchors") == 1) & (F.get("anchors", F.lit(0)) > 0) & (F.get("anchors", F.lit(0)) < F.col("hi"))
    rows = rows.withColumn("lo", F.when(after, F.bround(F.get("anchors", F.lit(0)) / 5.0) * 5.0).otherwise(F.lit(0.0)))
    wide = _scene()
    own = replace(wide, lo=F.col("lo"))
    part = lambda t: F.floor(t / (F.col("hi") / 4 + 1e-9))
    focus = F.transform(S.grid_points(F.col("lo"), F.col("hi"), F.lit(5.0)), lambda t: F.when(part(t) == part(F.get("anchors", F.lit(0)).cast("double")), 1.0).otherwise(0.0))
    classes = sum(F.rlike("q", F.lit(x)).cast("int") for x in ("Clip", "Sponge"))
    routes = R.dispatch_routes(own, wide, classes, F.col("edge_runs"), F.col("fine_runs"), focus)
    found = R.dispatched(rows, ["user_id"], routes, wide)
    return found.select("user_id", F.col("hi").cast("long").alias("hi"), "route", _ints(F.col("points")).alias("t"))


# --- the rules' twin: scenes as lists, the times each rule wishes for, then one take; lo is 0, n 32, the grid 5


def _dense(a, b):
    return f"[least({a}, {b}) + k * 5.0::double for k in range(cast(ceil((greatest({a}, {b}) + 5 - least({a}, {b})) / 5.0::double) as bigint))]"


def _lin(a, b, n):
    return f"(case when ({n}) <= 0 then [] when ({n}) = 1 then [(({a}) + ({b})) / 2.0::double] else [({a}) + (({b}) - ({a})) * i / (cast({n} as double) - 1) for i in range(cast({n} as bigint))] end)"


def _even(l, k):
    return f"(case when {k} >= len({l}) then {l} when {k} <= 0 then [] when {k} = 1 then [({l})[1]] else [({l})[cast(round_even(i * (len({l}) - 1) / cast({k} - 1 as double), 0) as bigint) + 1] for i in range(cast({k} as bigint))] end)"


def _all_points(runs):
    return f"flatten([{_dense('r.a', 'r.b')} for r in {runs}])"


def _about(times, radius):
    return f"flatten([{_dense(f't - {radius}', f't + {radius}')} for t in {times}])"


def _segments(a, b, n):
    """Equal shares of n for the segments of [a, b] between changes of the count."""
    cuts = f"list_concat([{a}], list_filter(moves, lambda t: t > {a} and t < {b}), [{b}])"
    seg = f"list_filter([{{'a': c[i], 'b': c[i + 1]}} for i in range(1, len(c))], lambda s: s.b > s.a)"
    share = f"greatest(2, {n} // greatest(len(g), 1))"
    return f"(select flatten([{_lin('s.a', 's.b', share)} for s in g]) from (select {seg} as g from (select {cuts} as c)))"


def _rules_sql(asked=None, more=""):
    """Up to the table tk of points; ``asked`` takes the place of the rules' wishes; ``more`` stands before them."""
    first_a, last_b = "runs[1].a", "runs[-1].b"
    ordinal = "try_cast(nullif(regexp_extract(q, '([0-9]+)(?:st|nd|rd|th)', 1), '') as bigint)"
    wide = "[{'a': r.a - (r.b - r.a) * 0.075::double, 'b': r.b + (r.b - r.a) * 0.075::double} for r in runs]"
    whole = "list_sum([r.b - r.a for r in wide])"
    cut = f"({first_a} + 0.3::double * ({last_b} - {first_a}))"
    t0 = "least(greatest(anchors[1], 0), hi)"
    steps = f"[15.0::double * pow(greatest(30.0::double, hi - {t0}) / 15.0::double, i / 15.0::double) for i in range(16)]"
    wish = {
        "leave_fov": f"case when len(runs) > 0 then flatten([{_lin('r.a', 'r.b', f'greatest(2.0::double, round_even(32 * (r.b - r.a) / greatest({whole}, 1e-9), 0))')} for r in wide]) end",
        "lastseen_pair": f"case when len(any_runs) > 0 then {_dense('list_max([r.b for r in any_runs]) - 120', 'list_max([r.b for r in any_runs]) + 120')} end",
        "longest_cooc": f"case when len(any_runs) > 0 then {_even(_all_points('any_runs'), 32)} end",
        "retrieval_exists": f"case when len(anchors) > 0 and hi > {t0} then list_concat(case when hi * 0.45::double >= {t0} then {_dense('greatest(0, hi * 0.4::double - 10)', 'least(hi, hi * 0.45::double + 10)')} else [] end, [{t0} + list_sum(({steps})[1:j]) / list_sum({steps}) * (hi - {t0}) for j in range(1, 17)], [{t0}]) end",
        "nth_inserted": f"case when {ordinal} >= 2 and len([1 for i in range(1, len(rises) + 1) if abs(i - {ordinal}) <= 1]) > 0 then list_concat({_about(f'[rises[i] for i in range(1, len(rises) + 1) if abs(i - {ordinal}) <= 1]', 60)}, {_even(_all_points('runs'), 8)}) end",
        "retrieval_when": f"case when len(runs) > 0 then list_concat({_dense('coalesce(anchors[1], wide[1].a)', 'coalesce(anchors[1], wide[1].a) + 60')}, {_dense('wide[1].b - 60', 'wide[1].b')}) end".replace(_dense("wide[1].b - 60", "wide[1].b"), _dense("wide[1].b - 60", "wide[1].b + 60")),
        "last_visible": f"case when len(runs) > 0 then list_concat({_about('[r.b for r in runs[greatest(len(runs) - 2, 1):]]', 30)}, {_lin('0.0::double', 'hi', '5')}) end",
        "after_first_inserted": f"case when len(runs) > 0 then {_lin(f'{first_a} - 60', f'{last_b} + 60', '32')} end",
        "and_same_time": f"case when len(both_runs) > 0 then flatten([{_dense('r.a - 30', 'r.b + 30')} for r in both_runs]) when len(any_runs) > 0 then {_even(_all_points('any_runs'), 32)} end",
        "max_count_many": f"case when list_max([c.n for c in counts]) >= 5 then {_about('peaks', 20)} end",
        "max_count": f"case when len(counts) > 0 then {_about('peaks', 60)} end",
        "interval_long": f"case when len(anchors) >= 2 and list_max(anchors) - list_min(anchors) > 600 then {_segments('list_min(anchors)', 'list_max(anchors)', '32')} end",
        "interval_seg": f"case when len(anchors) >= 2 and list_max(anchors) - list_min(anchors) > 300 then {_segments('list_min(anchors)', 'list_max(anchors)', '32')} end",
        "all_classes": f"case when len(runs) > 0 then case when {last_b} - {first_a} + 120 > 600 then {_segments(f'({first_a} - 60)', f'({last_b} + 60)', '32')} else {_lin(f'{first_a} - 60', f'{last_b} + 60', '32')} end end",
        "applied_times": f"case when len(rises) > 0 then {_about('rises', 30)} end",
        "nth_unique_late": f"case when {ordinal} >= 3 and len(runs) > 0 then list_concat({_lin(first_a, cut, '9')}, {_lin(cut, last_b, '23')}) end",
        "nth_unique_class": _about(f"[firsts[i] for i in range(1, len(firsts) + 1) if abs(i - {ordinal}) <= 1]", 60),
        "count_inserted": f"case when len(runs) > 0 then list_filter({_dense(f'{first_a} - 60', f'{last_b} + 60')}, lambda t: not t between hi * 0.4::double - 0.5 and hi * 0.45::double + 0.5) end",
        "present_at_t": "case when len(anchors) > 0 then [anchors[1] - anchors[1] * pow(i / 32.0::double, 2) for i in range(32)] end",
    }
    name = "case " + " ".join(f"when regexp_matches(q, '{pattern}') then '{rule}'" for rule, pattern, _ in S.RULES) + " end"
    asks = "[" + ", ".join("'" + x + "'" for x in QUESTIONS) + "]"
    clock = lambda x: f"(lpad(cast(cast(round_even({x}, 0) as bigint) // 3600 as varchar), 2, '0') || ':' || lpad(cast(cast(round_even({x}, 0) as bigint) // 60 % 60 as varchar), 2, '0') || ':' || lpad(cast(cast(round_even({x}, 0) as bigint) % 60 as varchar), 2, '0'))"
    runs = lambda name, src: f"{name}_f as (select user_id, t, t // 5 - row_number() over (partition by user_id order by t) as g from (select distinct user_id, t from {src})), {name}_r as (select user_id, cast(min(t) as double) as a, cast(max(t) as double) as b from {name}_f group by user_id, g), {name} as (select user_id, list({{'a': a, 'b': b}} order by a) as {name} from {name}_r group by 1)"
    # peaks: the three largest counts, 60 apart, found one after another
    peak = lambda k: f"pk{k} as (select user_id, counts, rises, moves, list_concat(pk, [list_reduce(list_filter(counts, lambda c: len(list_filter(pk, lambda p: abs(p - c.t) <= 60)) = 0), lambda x, y: case when y.n > x.n or (y.n = x.n and y.t < x.t) then y else x end).t]) as pk from pk{k - 1} where len(list_filter(counts, lambda c: len(list_filter(pk, lambda p: abs(p - c.t) <= 60)) = 0)) > 0 union all select user_id, counts, rises, moves, pk from pk{k - 1} where len(list_filter(counts, lambda c: len(list_filter(pk, lambda p: abs(p - c.t) <= 60)) = 0)) = 0)"
    return (
        "with " + EV + ", e as (select user_id, cls, (hr - min(hr) over (partition by user_id)) * 5 as t from ev), sp as (select user_id, cast(max(t) as double) as hi from e group by 1), "
        + ", ".join([runs("runs", "e where cls = 'view'"), runs("any_runs", "e"), runs("both_runs", "(select user_id, t from e where cls = 'view' intersect select user_id, t from e where cls = 'click')")])
        + ", cn as (select user_id, cast(t as double) as t, count(*) as n from e where cls = 'view' group by 1, 2), cl as (select *, coalesce(lag(n) over (partition by user_id order by t), 0) as before from cn), "
        "pk0 as (select user_id, list({'t': t, 'n': n} order by t) as counts, coalesce(list(t order by t) filter (where n > before), []) as rises, coalesce(list(t order by t) filter (where n <> before), []) as moves, cast([] as double[]) as pk from cl group by 1), "
        + ", ".join(peak(k) for k in (1, 2, 3))
        + ", fi as (select user_id, list(t order by t, cls) as firsts from (select user_id, cls, cast(min(t) as double) as t from e group by 1, 2) group by 1), "
        f"qs as (select user_id, hi, replace(replace({asks}[user_id % {len(QUESTIONS)} + 1], '{{a}}', {clock('hi * 0.25::double')}), '{{b}}', {clock('hi * 0.75::double')}) as q from sp), "
        "sc as (select qs.*, coalesce(runs, []) as runs, coalesce(any_runs, []) as any_runs, coalesce(both_runs, []) as both_runs, coalesce(counts, []) as counts, coalesce(rises, []) as rises, coalesce(moves, []) as moves, coalesce(pk, []) as peaks, coalesce(firsts, []) as firsts, "
        "[cast(string_split(x, ':')[1] as double) * 3600 + cast(string_split(x, ':')[2] as double) * 60 + cast(string_split(x, ':')[3] as double) for x in regexp_extract_all(q, '[0-9]{1,2}:[0-9]{2}:[0-9]{2}')] as anchors, "
        f"{name} as rule from qs left join runs using (user_id) left join any_runs using (user_id) left join both_runs using (user_id) left join pk3 using (user_id) left join fi using (user_id)), wi as (select *, {wide} as wide from sc), " + more +
        "ws as (select user_id, hi, rule, " + (asked or "case rule " + " ".join(f"when '{k}' then {v}" for k, v in wish.items()) + " end") + " as w from wi), "
        "gt as (select *, case when len(w) > 0 then list_sort(list_distinct([round(round_even(least(greatest(x, 0.0::double), hi) / 5.0::double, 0) * 5.0::double, 3) for x in w])) end as got from ws), "
        f"rs as (select *, list_filter({_dense('0.0::double', 'hi')}, lambda x: not list_contains(got, x)) as rest from gt), ft as (select *, least(32 - len(got), len(rest)) as k from rs), "
        f"tk as (select user_id, hi, rule, case when len(got) > 32 then {_even('got', 32)} when len(got) < 32 then list_sort(list_distinct(list_concat(got, {_even('rest', 'k')}))) else got end as p from ft) "
    )


_DAY = "with " + EV + ", dy as (select user_id, [coalesce(m[h], 0.0::double) for h in range(24)] as n from (select user_id, map(list(h), list(cast(n as double))) as m from (select user_id, hr % 24 as h, count(*) as n from ev where cls = 'view' group by 1, 2) group by 1))"


def _spread_sql(n, uniform):
    """Points of the weights w of 24 places, ``uniform`` of the n at equal steps."""
    m = n - uniform
    return (
        f"a as (select user_id, [list_sum(w[1:i + 1]) / list_sum(w) for i in range(24)] as cdf from w where list_sum(w) > 0), g as (select user_id, list_sort(list_distinct(list_concat({_lin('0.0::double', '23.0::double', str(uniform))}, [cast(least(len(list_filter(cdf, lambda x: x < (i + 0.5::double) / {m})), 23) as double) for i in range({m})]))) as got from a), "
        f"r as (select *, list_filter([cast(i as double) for i in range(24)], lambda x: not list_contains(got, x)) as rest from g), k as (select *, least({n} - len(got), len(rest)) as k from r), "
        f"p as (select user_id, case when len(got) < {n} then list_sort(list_distinct(list_concat(got, {_even('rest', 'k')}))) else got end as p from k) select dy.user_id, array_to_string([cast(x as bigint) for x in p], ',') as t from dy left join p using (user_id)"
    )


# the ladder's twin: scores of every hour, the smallest of k about each, runs of the first rung that has any
def _seen(i, threshold, k):
    w = f"partition by user_id order by t rows between {k // 2} preceding and {(k - 1) // 2} following"
    return f"select user_id, {i} as rung, t from (select user_id, t, min(score) over ({w}) as low, count(*) over ({w}) as n from so) where n = {k} and low >= {threshold}"


def _ladder_sql(name, rungs):
    return (
        f"{name}_s as (" + " union all ".join(_seen(i, *r) for i, r in enumerate(rungs)) + f"), {name}_g as (select *, t // 5 - row_number() over (partition by user_id, rung order by t) as g from {name}_s), "
        f"{name}_r as (select user_id, rung, min(t) as a, max(t) as b from {name}_g group by user_id, rung, g), {name} as (select * from {name}_r r where rung = (select min(rung) from {name}_r z where z.user_id = r.user_id)), "
    )


_SCORES = "so as (select user_id, t, least(coalesce(n, 0) / 4.0::double, 1.0::double) as score from (select user_id, unnest(range(0, cast(hi as bigint) + 1, 5)) as t from sp) left join (select user_id, cast(t as bigint) as t, n from cn) using (user_id, t)), "
_LADDER = _SCORES + _ladder_sql("la", RUNGS) + _ladder_sql("lf", RUNGS[-1:])
_LADDER_LISTS = _LADDER + "ll as (select user_id, list({'a': cast(a as double), 'b': cast(b as double)} order by a) as er from la group by 1), lz as (select user_id, list({'a': cast(a as double), 'b': cast(b as double)} order by a) as fr from lf group by 1), "


def _near(e, win, n):
    return _lin(f"greatest(lo, {e} - {win})", f"least(hi, {e} + {win})", n)


def _edge_wish(kind, uni):
    """One edge, looked for again in fr; e0 is the edge, z the weaker runs near it."""
    rest = 32 - uni
    e0 = f"(case when {kind} = 'last' then er[-1].b else er[1].a end)"
    z = f"list_filter(fr, lambda r: r.b >= {e0} - 90 and r.a <= {e0} + 90)"
    again = f"(case when {kind} = 'last' then least(({z})[-1].b, {e0} + 90) else greatest(({z})[1].a, {e0} - 90) end)"
    return f"case when len(er) > 0 and {kind} in ('first', 'last') then list_concat({_lin('lo', 'hi', str(uni))}, case when len({z}) > 0 then {_near(again, 45, str(rest))} else {_near(e0, 90, str(rest))} end) end"


def _several_wish(kind):
    es = f"(case when {kind} = 'last' then list_reverse([r.b for r in er]) else [r.a for r in er] end)[1:3]"
    per = f"greatest(2, 28 // len({es}))"
    return f"case when len(er) > 0 then list_concat({_lin('lo', 'hi', '4')}, case when len(er) > 1 then flatten([{_near('e', 60, per)} for e in {es}]) else {_near(f'({es})[1]', 60, '28')} end) end"


_PARITY = "(case when user_id % 2 = 0 then 'first' else 'last' end)"
_WITH_RUNS = _LADDER_LISTS + "wj as (select wi.*, 0.0::double as lo, coalesce(er, []) as er, coalesce(fr, []) as fr from wi left join ll using (user_id) left join lz using (user_id)), "


def _edges_sql(wish):
    return _rules_sql(wish, _WITH_RUNS).replace(" as w from wi), gt", " as w from wj), gt") + "select user_id, array_to_string([cast(round_even(x, 0) as bigint) for x in p], ',') as t from tk"


def _taken(w, lo):
    """The wish of one route brought to 32 places from ``lo`` to hi, as a list or null."""
    got = f"list_sort(list_distinct([round(round_even((least(greatest(x, {lo}), hi) - {lo}) / 5.0::double, 0) * 5.0::double + {lo}, 3) for x in w]))"
    return (
        f"(select case when len(got) > 32 then {_even('got', 32)} when len(got) < 32 then list_sort(list_distinct(list_concat(got, {_even('rest', 'least(32 - len(got), len(rest))')}))) else got end "
        f"from (select got, list_filter({_dense(lo, 'hi')}, lambda x: not list_contains(got, x)) as rest from (select {got} as got from (select {w} as w) where len(w) > 0)))"
    )


def _drawn(runs, uniform, focus=None):
    """Points towards runs: every grid place within 30 s of one, by the inverse of the cumulative weight."""
    m = 32 - uniform
    seen = f"[case when len(list_filter({runs}, lambda r: x >= r.a - 30 and x <= r.b + 30)) > 0 then 1.0::double else 0.0::double end for x in secs]"
    both = seen if focus is None else f"(select case when list_max(z) > 0 then z else y end from (select [y[i] * {focus} for i in range(1, len(y) + 1)] as z, y from (select {seen} as y)))"
    return (
        f"(select case when len(got) < 32 then list_sort(list_distinct(list_concat(got, {_even('rest', 'least(32 - len(got), len(rest))')}))) else got end from (select got, list_filter(secs, lambda x: not list_contains(got, x)) as rest from "
        f"(select secs, list_sort(list_distinct([round(round_even((x - lo) / 5.0::double, 0) * 5.0::double + lo, 3) for x in list_concat({_lin('lo', 'hi', str(uniform))}, [secs[least(len(list_filter(cdf, lambda c: c < (i + 0.5::double) / {m})), len(secs) - 1) + 1] for i in range({m})])])) as got from "
        f"(select secs, [list_sum(y[1:i]) / list_sum(y) for i in range(1, len(y) + 1)] as cdf from (select secs, {both} as y) where list_sum(y) > 0)))) "
    )


def _dispatch_sql():
    a, b = "list_min(anchors)", "list_max(anchors)"
    snap = lambda pts: f"list_sort(list_distinct([round(least(greatest(round_even(x / 5.0::double, 0), 0), floor(hi / 5.0::double + 1e-9)) * 5.0::double, 3) for x in {pts}]))"
    bridge = snap(f"[least(greatest(x, 0.0::double), hi) for x in list_concat({_lin(f'{a} - 30', f'{a} + 30', '11')}, {_lin(f'{b} - 30', f'{b} + 30', '11')}, case when {b} > {a} then ({_lin(a, b, '12')})[2:11] else [] end)]")
    time, kind = "regexp_matches(q, '(?i)\\bwhen\\b')", "(case when regexp_matches(q, '(?i)\\bfirst\\b') then 'first' when regexp_matches(q, '(?i)\\blast\\b') then 'last' else 'other' end)"
    between = "regexp_matches(q, '(?i)\\bbetween\\b')"
    part = lambda t: f"floor({t} / (hi / 4 + 1e-9))"
    same_part = f"(case when {part('secs[i]')} = {part('anchors[1]')} then 1.0::double else 0.0::double end)"
    uniform = _lin("lo", "hi", "32")
    put = f"(select case when len(anchors) = 0 then u when len(anchors) = 1 then {{one}} end from (select {uniform} as u))"
    one = "[case when i = list_position([abs(x - least(greatest(anchors[1], lo), hi)) for x in u], list_min([abs(x - least(greatest(anchors[1], lo), hi)) for x in u])) then least(greatest(anchors[1], lo), hi) else u[i] end for i in range(1, len(u) + 1)]"
    onto = lambda pts: f"list_sort(list_distinct([round(lo + least(greatest(round_even((x - lo) / 5.0::double, 0), 0), floor((hi - lo) / 5.0::double + 1e-9)) * 5.0::double, 3) for x in {pts}]))"
    routes = [
        ("between", f"case when len(anchors) >= 2 and {between} and least({b}, hi) > greatest({a}, 0) then {snap(_lin(f'greatest({a}, 0)', f'least({b}, hi)', '32'))} end"),
        ("bridge", f"case when len(anchors) >= 2 and not {between} and len({bridge}) >= 8 then {bridge} end"),
        ("edge", f"case when {time} and {kind} in ('first', 'last') then {_taken(_edge_wish(kind, 8), 'lo')} end"),
        ("classes", f"case when {time} and contains(q, 'Clip') and contains(q, 'Sponge') and len(any_runs) > 0 and hi > lo then {_drawn('any_runs', 8)} end"),
        ("weak", f"case when not {time} and len(anchors) = 0 and len(runs) > 0 and hi > lo then {_drawn('runs', 16)} end"),
        ("phase", f"case when len(anchors) > 0 and len(runs) > 0 and hi > lo then {_drawn('runs', 8, same_part)} end"),
        ("seen", f"case when {time} and len(runs) > 0 and hi > lo then {_drawn('runs', 8)} end"),
        ("uniform", onto(f"(case when hi <= lo then [(lo + hi) / 2] else {put.format(one=one)} end)")),
    ]
    head = _rules_sql(None, _LADDER_LISTS)
    lo = f"case when {time} and regexp_matches(q, '(?i)\\bafter\\b') and len(anchors) = 1 and anchors[1] > 0 and anchors[1] < hi then round_even(anchors[1] / 5.0::double, 0) * 5.0::double else 0.0::double end"
    cols = ", ".join(f"{sql} as r_{name}" for name, sql in routes)
    # correlated lists are laid out as columns first
    return (
        head + f", dx as (select wi.*, {lo} as lo, coalesce(er, []) as er, coalesce(fr, []) as fr, tk.r_rule from wi join (select user_id, p as r_rule from tk) tk using (user_id) left join ll using (user_id) left join lz using (user_id)), "
        f"dy as (select *, [round(lo + k * 5.0::double, 3) for k in range(cast(floor((hi - lo) / 5.0::double + 1e-9) as bigint) + 1)] as secs from dx), dz as (select user_id, hi, rule, r_rule, {cols} from dy) "
        "select user_id, cast(hi as bigint) as hi, case when r_rule is not null then rule " + " ".join(f"when r_{n} is not null then '{n}'" for n, _ in routes) + " end as route, "
        "array_to_string([cast(round_even(x, 0) as bigint) for x in coalesce(r_rule, " + ", ".join(f"r_{n}" for n, _ in routes) + ")], ',') as t from dz"
    )


_AT = "case when regexp_matches(q, '(?i)\\bfirst\\b') then runs[1].a when regexp_matches(q, '(?i)\\blast\\b') then runs[-1].b end"
_EDGE = f"case when {_AT} is not null then list_concat({_even(_dense(f'({_AT} - 90)', f'({_AT} + 90)'), 28)}, {_lin('0.0::double', 'hi', '4')}) end"
QUERIES = {
    "smp_uniform_grid": (smp_uniform_grid, f"with {RQ}, {_PTS} select o_orderkey, array_to_string({_SNAP.format(p='p')}, ',') as t from pt"),
    "smp_uniform_anchor": (
        smp_uniform_anchor,
        f"with {RQ}, {_PTS}, an as (select *, cast(least(greatest(anchor, lo), hi) as double) as a from pt), nd as (select *, list_position([abs(x - a) for x in p], list_min([abs(x - a) for x in p])) as j from an), "
        f"rp as (select *, [case when i = j then a else p[i] end for i in range(1, len(p) + 1)] as r from nd) select o_orderkey, array_to_string({_SNAP.format(p='r')}, ',') as t from rp",
    ),
    "smp_visible": (smp_visible, f"with {RQ}, {_FREE} select o_orderkey, array_to_string(c, ',') as t from fr"),
    "smp_visible_pick": (
        smp_visible_pick,
        f"with {RQ}, {_FREE} select o_orderkey, case when n >= len(c) then array_to_string(c, ',') else array_to_string(list_sort(list_distinct([c[cast(round_even(i * (len(c) - 1) / cast(n - 1 as double), 0) as bigint) + 1] for i in range(n)])), ',') end as t from fr where n > 1",
    ),
    "smp_unmasked": (smp_unmasked, None),
    "smp_dense": (smp_dense, f"with {RQ} select o_orderkey, array_to_string([lo + k * grid for k in range(cast(ceil((hi + grid - lo) / cast(grid as double)) as bigint))], ',') as t from rq"),
    "smp_take_n": (
        smp_take_n,
        f"with {RQ}, ts as (select *, [least(greatest(lo + (i * anchor) % 60, lo), hi) for i in range(12)] as x from rq where n > 1 and hi > lo), g as (select *, list_sort(list_distinct([cast(round_even((v - lo) / cast(grid as double), 0) as bigint) * grid + lo for v in x])) as got from ts), "
        "f as (select *, list_filter([lo + k * grid for k in range(cast(ceil((hi + grid - lo) / cast(grid as double)) as bigint))], lambda z: not list_contains(got, z)) as rest from g), "
        "k as (select *, least(n - len(got), len(rest)) as tk from f), r as (select o_orderkey, case when len(got) > n then list_sort(list_distinct([got[cast(round_even(i * (len(got) - 1) / cast(n - 1 as double), 0) as bigint) + 1] for i in range(n)])) when len(got) < n and tk > 0 then "
        "list_sort(list_distinct(list_concat(got, case when tk >= len(rest) then rest when tk = 1 then [rest[1]] else [rest[cast(round_even(i * (len(rest) - 1) / cast(tk - 1 as double), 0) as bigint) + 1] for i in range(tk)] end))) else got end as t from k) select o_orderkey, array_to_string(t, ',') as t from r",
    ),
    "smp_equal_segments": (
        smp_equal_segments,
        f"with {RQ}, sg as (select *, list_filter([0, 1, 2], lambda i: (anchor % 3) * i > 0) as l from rq), pr as (select *, greatest(2, (n * 3) // greatest(len(l), 1)) as per from sg), ex as (select o_orderkey, lo, anchor, per, unnest(l) as i from pr), "
        "px as (select *, unnest(range(per)) as j from ex), ag as (select o_orderkey, string_agg(cast(round_even((lo + i * 30 + cast((anchor % 3) * i as double) * j / (per - 1)) * 10, 0) as bigint), ',' order by i, j) as t from px group by 1) select o_orderkey, coalesce(t, '') as t from rq left join ag using (o_orderkey)",
    ),
    "smp_halved": (smp_halved, f"with {RQ}, a as (select o_orderkey, range(lo, hi + 1) as l from rq), b as (select *, cast(power(2, greatest(ceil(log2(len(l) / 8.0)), 0)) as bigint) as st from a) select o_orderkey, array_to_string([l[i] for i in range(1, len(l) + 1, st)], ',') as t from b"),
    "smp_padded_runs": (
        smp_padded_runs,
        "with " + EV + ", h as (select distinct user_id, hr from ev where cls = 'view'), f as (select *, hr - row_number() over (partition by user_id order by hr) as g from h), r as (select user_id, min(hr) as a, max(hr) + 1 as b, count(*) as n from f group by user_id, g) select user_id, a as \"start\", round(a - (b - a) * 0.075::double, 6) as a, round(b + (b - a) * 0.075::double, 6) as b from r where n > 1",
    ),
    "smp_inverse_cdf": (
        smp_inverse_cdf,
        "with " + EV + ", c as (select user_id, hr % 24 as h, count(*) as n from ev group by 1, 2), w as (select user_id, h, sum(n) over (partition by user_id order by h) as cum, sum(n) over (partition by user_id) as total from c), a as (select user_id, list(h order by h) as secs, list(cast(cum as double) / cast(total as double) order by h) as cdf from w group by 1), "
        "g as (select *, list_sort(list_distinct([secs[least(len(list_filter(cdf, lambda x: x < (i + 0.5::double) / 6)), len(secs) - 1) + 1] for i in range(6)])) as got from a), r as (select *, list_filter(secs, lambda x: not list_contains(got, x)) as rest from g), k as (select *, least(6 - len(got), len(rest)) as k from r) "
        f"select user_id, array_to_string(case when len(got) < 6 then list_sort(list_distinct(list_concat(got, {_even('rest', 'k')}))) else got end, ',') as t from k",
    ),
    "smp_sharpest": (
        smp_sharpest,
        "with " + EV + ", e as (select user_id, hr % 64 as t, max(value) as s from ev where value is not null group by 1, 2), u as (select distinct user_id, unnest(range(8)) as i from e), b as (select u.user_id, u.i, arg_min(e.t, {'s': -s, 't': e.t}) as best from u left join e on e.user_id = u.user_id and e.t // 8 = u.i group by 1, 2) "
        "select user_id, string_agg(case when i = 2 then 20 else coalesce(best, i * 8 + 4) end, ',' order by i) as t from b group by 1",
    ),
    "smp_detector_weighted": (
        smp_detector_weighted,
        f"{_DAY}, m as (select user_id, [case when n[i * 2 + 1] >= 2 then 1.0::double else 0.0::double end for i in range(12)] as m from dy), gr as (select user_id, [m[i // 2 + 1] + (m[least(i // 2 + 1, 11) + 1] - m[i // 2 + 1]) * (i % 2) / 2.0::double for i in range(24)] as g from m), "
        "w as (select user_id, [list_max(g[greatest(i, 1):least(i + 2, 24)]) for i in range(24)] as w from gr), " + _spread_sql(8, 2),
    ),
    "smp_phase_focus": (
        smp_phase_focus,
        f"{_DAY}, f as (select user_id, n, [case when i // 6 = (user_id % 24) // 6 then n[i + 1] else 0.0::double end for i in range(24)] as b from dy), w as (select user_id, case when list_max(b) > 0 then b else n end as w from f), " + _spread_sql(6, 0),
    ),
    "smp_asked_window": (
        smp_asked_window,
        f"with {RQ}, a as (select *, lo + 5 as p, lo + 5 + anchor % 30 as z from rq where n > 1), b as (select o_orderkey, n, cast(case when o_orderkey % 3 = 0 and z > p then greatest(p, lo) when o_orderkey % 3 = 1 then least(p, hi) else lo end as double) as lo, cast(case when o_orderkey % 3 = 0 and z > p then least(z, hi) else hi end as double) as hi, 1 as grid from a), "
        "c as (select *, case when n <= 1 or hi <= lo then [(lo + hi) / 2.0::double] else [lo + (hi - lo) * i / (n - 1) for i in range(n)] end as p from b) "
        "select o_orderkey, array_to_string(list_sort(list_distinct([cast(round_even(lo + least(greatest(round_even(x - lo, 0), 0), floor(hi - lo + 1e-9)), 0) as bigint) for x in p])), ',') as t from c",
    ),
    "smp_refine": (smp_refine, "with " + EV + ", c as (select user_id, (hr // 12) * 12 as t, count(*) as n from ev group by 1, 2) select distinct user_id, unnest(generate_series(t - 12, t + 12, 3)) as t from c where n >= 3"),
    "smp_config_draw": (smp_config_draw, "select cast('0x' || substr(md5('cfg:' || doc_id), 1, 7) as bigint) % 5 as cfg, count(*) as n from documents group by 1"),
    "smp_rules": (smp_rules, _rules_sql() + "select user_id, cast(hi as bigint) as hi, rule, cast(len(p) as integer) as n, array_to_string([cast(round_even(x, 0) as bigint) for x in p], ',') as t from tk"),
    "smp_edge_alloc": (smp_edge_alloc, _rules_sql(_EDGE) + "select user_id, array_to_string([cast(round_even(x, 0) as bigint) for x in p], ',') as t from tk"),
    "smp_ladder_runs": (smp_ladder_runs, _rules_sql(None, _LADDER) + "select user_id, rung, a, b from la"),
    "smp_edge_ladder": (smp_edge_ladder, _edges_sql(_edge_wish(_PARITY, 8))),
    "smp_edge_several": (smp_edge_several, _edges_sql(_several_wish(_PARITY))),
    "smp_rule_dispatch": (smp_rule_dispatch, _dispatch_sql()),
}
