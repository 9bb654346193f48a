"""Timeline and interval queries over ``events``: user = video, hour = grid step, event type = class."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import intervals as I
from tidemark.operators import timeline as T
from tidemark.plans.base import EV, events

U = ["user_id"]


def _hours(s, d, cls=None):
    rows = events(s, d)
    return (rows.where(F.col("cls") == cls) if cls else rows).select("user_id", "hr").distinct()


def _counts(s, d, cls="view"):
    """Dense hourly counts of a class per user, between the user's first and last event of any class."""
    return T.dense(events(s, d), U, "hr", F.count_if(F.col("cls") == cls), "n")


#: Dense hourly counts of views for DuckDB.
DENSE = EV + """, span as (select user_id, unnest(generate_series(min(hr), max(hr))) as hr from ev group by user_id),
 marks as (select user_id, hr, count(*) filter (where cls = 'view') as n from ev group by user_id, hr),
 dense as (select user_id, hr, coalesce(n, 0) as n from span left join marks using (user_id, hr)),
 masked as (select user_id, hr, n, cast(n > 0 as integer) as mask from dense)"""


def _mask(s, d):
    return _counts(s, d).withColumn("mask", (F.col("n") > 0).cast("int"))


def tl_run_length(s, d):
    return T.runs(_hours(s, d), U, "hr")


def w06_runs(s, d):
    """Flagship: the longest run of active hours of each user, earliest first among equals."""
    return tl_run_length(s, d).groupBy("user_id").agg(F.max_by(F.struct("start", "end", "n"), F.struct("n", -F.col("start"))).alias("r")).select("user_id", "r.*")


RUNS = "with " + EV + """, h as (select distinct user_id, hr from ev),
 f as (select *, hr - row_number() over (partition by user_id order by hr) as g from h),
 r as (select user_id, min(hr) as "start", max(hr) + 1 as "end", count(*) as n from f group by user_id, g)"""


def tl_label_segments(s, d):
    rows = events(s, d).groupBy("user_id", "hr").agg(F.min("cls").alias("cls"))
    return T.label_segments(rows, U, "hr", "cls").select("user_id", "start", "end", "cls", "n")


def tl_erosion_k3(s, d):
    return T.eroded(_mask(s, d), U, "hr", "mask", 3).select("user_id", "hr")


def tl_erosion_k4(s, d):
    return T.eroded(_mask(s, d), U, "hr", "mask", 4).select("user_id", "hr")


def tl_erosion_runs(s, d):
    return T.runs(T.eroded(_mask(s, d), U, "hr", "mask", 2), U, "hr")


def tl_dilation(s, d):
    return T.dilated(_mask(s, d), U, "hr", "mask", 2).groupBy("user_id").agg(F.sum("mask").alias("n_mask"), F.sum("dilated").alias("n_dilated"))


def tl_change_points(s, d):
    return T.change_points(_counts(s, d), U, "hr", "n", 3).select("user_id", "hr", "delta")


def tl_first_last_edges(s, d):
    return T.edges(events(s, d), ["user_id", "cls"], "sec")


def tl_nth_class(s, d):
    return T.nth_class(events(s, d), U, "sec", "cls", 2)


def tl_cooccurrence_and(s, d):
    return T.both_present(events(s, d), ["user_id", "hr"], "cls")


def tl_cooccurrence_or(s, d):
    rows = events(s, d).where("cls in ('error', 'purchase')").select("user_id", "hr").distinct()
    return T.runs(rows, U, "hr").groupBy("user_id").agg(F.max("n").alias("longest"), F.count("*").alias("n_runs"))


def tl_sliding_window(s, d):
    rows = events(s, d).select("user_id", "event_id", "sec")
    return T.forward_windows(rows, U, "sec", 21600, 5, 3600).select("event_id", "n", "last_t")


def tl_greedy_thin(s, d):
    return T.thinned(events(s, d), U, "sec", 7200)


def tl_peaks(s, d):
    rows = events(s, d).groupBy("user_id", "hr").agg(F.count("*").alias("n"))
    return T.peaks(rows, U, "hr", "n", 3, 12)


def tl_phase_offsets(s, d):
    return T.strided(events(s, d).select("user_id", "event_id", "sec"), U, "event_id", 4)


def tl_even_subsample(s, d):
    return T.thinned_evenly(events(s, d).select("user_id", "event_id"), U, "event_id", 8)


def tl_cumulative(s, d):
    rows = events(s, d).groupBy("user_id", "hr").agg(F.sum("value").alias("v"))
    return T.cumulative_share(rows, U, "hr", "v").select("user_id", "hr", F.round("cdf", 6).alias("cdf"))


def tl_representatives(s, d):
    day = F.floor(F.col("hr") / 24)
    rows = events(s, d).select("user_id", "event_id", "hr", "sec")
    centre = F.abs(F.col("sec") - (F.col("bin") * 86400 + 43200))
    return T.representatives(rows, U, day, [centre, F.col("event_id")]).select("user_id", "bin", "event_id")


def tl_grid_phase(s, d):
    return T.grid_phase(events(s, d), U, "hr", 6)


def tl_coverage(s, d):
    r = tl_run_length(s, d).groupBy("user_id").agg(F.min("start").alias("lo"), F.max("end").alias("hi"), F.sum("n").alias("covered"), F.count("*").alias("n_runs"))
    kind = F.when(F.col("covered") == F.col("hi") - F.col("lo"), "full").when(F.col("n_runs") == 1, "span").otherwise("runs")
    return r.withColumn("kind", kind)


def tl_coverage_from_start(s, d):
    """The first run of each user as a list of its steps."""
    first = tl_run_length(s, d).groupBy("user_id").agg(F.min_by(F.struct("start", "end"), "start").alias("r"))
    return first.select("user_id", F.explode(F.sequence(F.col("r.start"), F.col("r.end") - 1)).alias("hr"))


def tl_max_at_once(s, d):
    rows = events(s, d).groupBy("user_id", "cls", "hr").agg(F.count("*").alias("n"))
    return rows.groupBy("user_id", "cls").agg(F.max("n").alias("most"), F.min_by("hr", F.struct(-F.col("n"), "hr")).alias("at"))


def tl_frame_reduction(s, d):
    ok = (F.col("value") > 5) & F.col("value").isNotNull()
    return events(s, d).groupBy("user_id", "hr", "cls").agg(F.round(F.max(F.when(ok, F.col("value")).otherwise(0.0)), 6).alias("score"), F.count_if(ok).alias("cnt"))


def tl_gap_windows(s, d):
    """Tumbling bins of 6 hours: rows and classes of each."""
    return events(s, d).groupBy("user_id", F.floor(F.col("hr") / 6).alias("bin")).agg(F.count("*").alias("n"), F.count_distinct("cls").alias("n_cls"))


def _purchases(s, d):
    return events(s, d).where("cls = 'purchase'").select("user_id", F.col("sec").alias("start"), (F.col("sec") + 1800).alias("end"))


def iv_point_in_interval(s, d):
    rows = events(s, d).where("cls = 'error'").select("user_id", "event_id", "sec")
    return I.in_intervals(rows, _purchases(s, d), U, "sec", "start", "end", 0.5, 3600.0).select("event_id")


def iv_overlap_clip(s, d):
    windows = events(s, d).where("cls = 'signup'").select("user_id", F.col("event_id"), F.col("sec").alias("lo"), (F.col("sec") + 7200).alias("hi"))
    return I.clipped(_purchases(s, d), windows, U, 3600.0).select("event_id", "start", "clip_start", "clip_end")


def _pair(s, d, a, b):
    e = events(s, d)
    return e.where(F.col("cls") == a).select("user_id", "hr").distinct(), e.where(F.col("cls") == b).select("user_id", "hr").distinct()


def iv_tolerance_lowest(s, d):
    return I.lowest_within(*_pair(s, d, "error", "view"), U, "hr", 15, 15)


def iv_nearest(s, d):
    return I.nearest(*_pair(s, d, "error", "view"), U, "hr")


def iv_interpolate(s, d):
    e = events(s, d)
    known = e.where("cls = 'view'").groupBy("user_id", "hr").agg(F.max("value").alias("v"))
    return I.interpolated(_pair(s, d, "error", "view")[0], known, U, "hr", "v").withColumn("v", F.floor(F.col("v") * 1000 + 0.5))


def iv_bin_audit(s, d):
    """Six-hour bins with an error and the purchases in them: does one come before the first error?"""
    e = events(s, d)
    bins = e.where("cls = 'error'").groupBy("user_id", F.floor(F.col("sec") / 21600).alias("b")).agg(F.min("sec").alias("sec"))
    seeds = e.where("cls = 'purchase'").select("user_id", "sec")
    hit = I.same_bin(bins.select("user_id", "sec"), seeds, U, "sec", 21600)
    return hit.groupBy("user_id", "sec").agg(F.count("*").alias("n_seeds"), F.max((F.col("seed_t") < F.col("sec")).cast("int")).alias("conflict"))


def iv_same_phase(s, d):
    states = events(s, d).select("user_id", "hr").distinct().withColumn("phase", F.floor(F.pmod("hr", F.lit(24)) / 6))
    anchors = states.groupBy("user_id").agg(F.min("hr").alias("hr"))
    return I.same_state(anchors, states, U, "hr", "phase").groupBy("user_id", "anchor_t", "phase").agg(F.count("*").alias("n"))


_ERODE = "with " + DENSE + ", w as (select user_id, hr, sum(mask) over (partition by user_id order by hr rows between {a} preceding and {b} following) as c from masked), k as (select user_id, hr from w where c >= {k})"

def _peaks_sql():
    """The largest hour, then twice the largest one farther than 12 from those before."""
    free = "list_filter(c, lambda x: len(list_filter(pk, lambda p: abs(p.t - x.t) <= 12)) = 0)"
    best = f"list_reduce({free}, lambda x, y: case when y.n > x.n or (y.n = x.n and y.t < x.t) then y else x end)"
    steps = [f"p{i} as (select user_id, c, case when len({free}) > 0 then list_concat(pk, [{best}]) else pk end as pk from p{i - 1})" for i in (1, 2, 3)]
    return (
        "with " + EV + ", h as (select user_id, hr, count(*) as n from ev group by 1, 2), p0 as (select user_id, list({'t': hr, 'n': n}) as c, cast([] as struct(t bigint, n bigint)[]) as pk from h group by 1), " + ", ".join(steps)
        + " select user_id, cast(i as integer) as rk, pk[i].t as hr, pk[i].n as n from (select user_id, pk, unnest(range(1, len(pk) + 1)) as i from p3)"
    )


QUERIES = {
    "tl_run_length": (tl_run_length, RUNS + " select * from r"),
    "w06_runs": (w06_runs, RUNS + ' select user_id, "start", "end", n from (select *, row_number() over (partition by user_id order by n desc, "start") as k from r) where k = 1'),
    "tl_label_segments": (
        tl_label_segments,
        "with " + EV + ', c as (select user_id, hr, min(cls) as cls from ev group by 1, 2), f as (select *, case when lag(cls) over w is distinct from cls then 1 else 0 end as fresh from c window w as (partition by user_id order by hr)), '
        'g as (select *, sum(fresh) over (partition by user_id order by hr) as seg from f) select user_id, min(hr) as "start", max(hr) as "end", min(cls) as cls, count(*) as n from g group by user_id, seg',
    ),
    "tl_erosion_k3": (tl_erosion_k3, _ERODE.format(a=1, b=1, k=3) + " select * from k"),
    "tl_erosion_k4": (tl_erosion_k4, _ERODE.format(a=2, b=1, k=4) + " select * from k"),
    "tl_erosion_runs": (
        tl_erosion_runs,
        _ERODE.format(a=1, b=0, k=2) + ', f as (select *, hr - row_number() over (partition by user_id order by hr) as g from k) select user_id, min(hr) as "start", max(hr) + 1 as "end", count(*) as n from f group by user_id, g',
    ),
    "tl_dilation": (
        tl_dilation,
        "with " + DENSE + ", w as (select user_id, mask, max(mask) over (partition by user_id order by hr rows between 2 preceding and 2 following) as dl from masked) select user_id, cast(sum(mask) as bigint) as n_mask, cast(sum(dl) as bigint) as n_dilated from w group by user_id",
    ),
    "tl_change_points": (
        tl_change_points,
        "with " + DENSE + ", w as (select user_id, hr, cast(floor(sum(n) over (partition by user_id order by hr rows between 1 preceding and 1 following) / 3.0) as bigint) as lvl from dense), c as (select user_id, hr, lvl - lag(lvl) over (partition by user_id order by hr) as delta from w) select * from c where delta <> 0",
    ),
    "tl_first_last_edges": (tl_first_last_edges, "with " + EV + " select user_id, cls, min(sec) as first_t, max(sec) as last_t, count(*) as n from ev group by 1, 2"),
    "tl_nth_class": (tl_nth_class, "with " + EV + ", f as (select user_id, cls, min(sec) as first_t from ev group by 1, 2) select user_id, cls, first_t from (select *, row_number() over (partition by user_id order by first_t, cls) as k from f) where k = 2"),
    "tl_cooccurrence_and": (tl_cooccurrence_and, "with " + EV + ", m as (select distinct user_id, hr, cls from ev) select a.cls as cls_a, b.cls as cls_b, count(*) as n from m a join m b using (user_id, hr) where a.cls < b.cls group by 1, 2"),
    "tl_cooccurrence_or": (
        tl_cooccurrence_or,
        "with " + EV + ", h as (select distinct user_id, hr from ev where cls in ('error', 'purchase')), f as (select *, hr - row_number() over (partition by user_id order by hr) as g from h), r as (select user_id, g, count(*) as n from f group by 1, 2) select user_id, max(n) as longest, count(*) as n_runs from r group by 1",
    ),
    "tl_sliding_window": (
        tl_sliding_window,
        "with " + EV + ", w as (select event_id, sec, count(*) over f as n, max(sec) over f as last_t from ev window f as (partition by user_id order by sec range between current row and 21600 following)) select event_id, n, last_t from w where n >= 5 and last_t - sec >= 3600",
    ),
    "tl_greedy_thin": (
        tl_greedy_thin,
        "with recursive " + EV + ", k as (select user_id, min(sec) as sec from ev group by 1 union all select k.user_id, (select min(e.sec) from ev e where e.user_id = k.user_id and e.sec >= k.sec + 7200) as sec from k where k.sec is not null) select user_id, sec from k where sec is not null",
    ),
    "tl_peaks": (tl_peaks, _peaks_sql()),
    "tl_phase_offsets": (tl_phase_offsets, "with " + EV + ", r as (select user_id, event_id, sec, row_number() over (partition by user_id order by event_id) - 1 as rn from ev) select user_id, event_id, sec, rn % 4 as \"offset\" from r"),
    "tl_even_subsample": (
        tl_even_subsample,
        "with " + EV + ", r as (select user_id, event_id, row_number() over (partition by user_id order by event_id) - 1 as rn, greatest(1, count(*) over (partition by user_id) // 8) as st from ev) select user_id, event_id from r where rn % st = 0 and rn / st < 8",
    ),
    "tl_cumulative": (tl_cumulative, "with " + EV + ", r as (select user_id, hr, sum(value) as v from ev group by 1, 2) select user_id, hr, round(sum(v) over (partition by user_id order by hr rows unbounded preceding) / sum(v) over (partition by user_id), 6) as cdf from r"),
    "tl_representatives": (
        tl_representatives,
        "with " + EV + ", r as (select user_id, event_id, hr // 24 as bin, row_number() over (partition by user_id, hr // 24 order by abs(sec - ((hr // 24) * 86400 + 43200)), event_id) as k from ev) select user_id, bin, event_id from r where k = 1",
    ),
    "tl_grid_phase": (
        tl_grid_phase,
        "with " + EV + ", h as (select distinct user_id, hr from ev), a as (select * from h x where not exists (select 1 from h y where y.user_id = x.user_id and abs(y.hr - x.hr) = 1)), c as (select user_id, hr % 6 as phase, count(*) as n from a group by 1, 2), "
        "b as (select *, cast(sum(n) over (partition by user_id) as bigint) as total, row_number() over (partition by user_id order by n desc, phase) as k from c) select user_id, phase, n, total from b where k = 1 and n >= 3 and 2 * n >= total",
    ),
    "tl_coverage": (
        tl_coverage,
        RUNS + ', c as (select user_id, min("start") as lo, max("end") as hi, cast(sum(n) as bigint) as covered, count(*) as n_runs from r group by 1) select *, case when covered = hi - lo then \'full\' when n_runs = 1 then \'span\' else \'runs\' end as kind from c',
    ),
    "tl_coverage_from_start": (tl_coverage_from_start, RUNS + ', b as (select user_id, "start" as a, "end" as b, row_number() over (partition by user_id order by "start") as k from r) select user_id, unnest(generate_series(a, b - 1)) as hr from b where k = 1'),
    "tl_max_at_once": (
        tl_max_at_once,
        "with " + EV + ", c as (select user_id, cls, hr, count(*) as n from ev group by 1, 2, 3), k as (select *, row_number() over (partition by user_id, cls order by n desc, hr) as k from c) select user_id, cls, n as most, hr as at from k where k = 1",
    ),
    "tl_frame_reduction": (tl_frame_reduction, "with " + EV + " select user_id, hr, cls, round(max(case when value > 5 then value else 0.0 end), 6) as score, count(*) filter (where value > 5) as cnt from ev group by 1, 2, 3"),
    "tl_gap_windows": (tl_gap_windows, "with " + EV + " select user_id, hr // 6 as bin, count(*) as n, count(distinct cls) as n_cls from ev group by 1, 2"),
    "iv_point_in_interval": (iv_point_in_interval, "with " + EV + " select event_id from ev e where cls = 'error' and exists (select 1 from ev p where p.cls = 'purchase' and p.user_id = e.user_id and e.sec between p.sec - 0.5 and p.sec + 1800.5)"),
    "iv_overlap_clip": (
        iv_overlap_clip,
        "with " + EV + ' select w.event_id, p.sec as "start", greatest(p.sec, w.sec) as clip_start, least(p.sec + 1800, w.sec + 7200) as clip_end from ev p join ev w using (user_id) where p.cls = \'purchase\' and w.cls = \'signup\' and p.sec < w.sec + 7200 and p.sec + 1800 > w.sec',
    ),
    "iv_tolerance_lowest": (
        iv_tolerance_lowest,
        "with " + EV + ", a as (select distinct user_id, hr from ev where cls = 'error'), b as (select distinct user_id, hr as t from ev where cls = 'view') select a.user_id, a.hr, min(t) as hit from a left join b on a.user_id = b.user_id and t between a.hr - 15 and a.hr + 15 group by 1, 2",
    ),
    "iv_nearest": (
        iv_nearest,
        "with " + EV + ", a as (select distinct user_id, hr from ev where cls = 'error'), b as (select distinct user_id, hr as t from ev where cls = 'view'), k as (select a.user_id, a.hr, t, row_number() over (partition by a.user_id, a.hr order by abs(t - a.hr), t) as k from a left join b on a.user_id = b.user_id) select user_id, hr, t as near from k where k = 1",
    ),
    "iv_interpolate": (
        iv_interpolate,
        "with " + EV + ", a as (select distinct user_id, hr from ev where cls = 'error'), b as (select user_id, hr as t, max(value) as v from ev where cls = 'view' group by 1, 2), "
        "l as (select a.user_id, a.hr, max(t) as lt, arg_max(v, t) as lv from a left join b on a.user_id = b.user_id and t <= a.hr group by 1, 2), h as (select a.user_id, a.hr, min(t) as ht, arg_min(v, t) as hv from a left join b on a.user_id = b.user_id and t >= a.hr group by 1, 2) "
        "select user_id, hr, cast(floor((case when lt is null then hv when ht is null or ht = lt then lv else lv + (hv - lv) * (hr - lt) / (ht - lt) end) * 1000 + 0.5) as bigint) as v from l join h using (user_id, hr)",
    ),
    "iv_bin_audit": (
        iv_bin_audit,
        "with " + EV + ", b as (select user_id, sec // 21600 as b, min(sec) as sec from ev where cls = 'error' group by 1, 2) select b.user_id, b.sec, count(*) as n_seeds, max(cast(p.sec < b.sec as integer)) as conflict from b join ev p on p.user_id = b.user_id and p.sec // 21600 = b.b and p.cls = 'purchase' group by 1, 2",
    ),
    "iv_same_phase": (
        iv_same_phase,
        "with " + EV + ", h as (select distinct user_id, hr, (hr % 24) // 6 as phase from ev), a as (select user_id, min(hr) as t from h group by 1) select a.user_id, a.t as anchor_t, x.phase, count(*) as n from a join h x on x.user_id = a.user_id and x.hr = a.t join h y on y.user_id = a.user_id and y.phase = x.phase group by 1, 2, 3",
    ),
}
