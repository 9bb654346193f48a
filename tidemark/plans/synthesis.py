"""Synthesis queries: an hour of a user is a frame, its events are instances placed by value and id."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import aggregates as A
from tidemark.operators import synthesis as Y
from tidemark.plans.base import EV, events


def _instances(s, d):
    """cx and cy in hundredths of the frame, as exact fractions of 64."""
    e = events(s, d)
    return e.select((F.col("user_id") * 1000000 + F.col("hr")).alias("frame"), "user_id", "hr", "cls", (F.pmod("event_id", F.lit(64)) / 64).alias("cx"), (F.pmod(F.col("event_id") * 7, F.lit(64)) / 64).alias("cy"))


IN = EV + """, ins as (select user_id * 1000000 + hr as frame, user_id, hr, cls, (event_id % 64) / 64.0::double as cx, ((event_id * 7) % 64) / 64.0::double as cy from ev),
 q as (select *, (case when cy * 2 < 1 then 'top' else 'bottom' end) || '/' || (case when cx * 2 < 1 then 'left' else 'right' end) as quad, power(cx - 0.5, 2) + power(cy - 0.5, 2) as dist from ins)"""


def _rows(s, d, only=None):
    return Y.families(Y.facts(_instances(s, d), "frame"), "frame", only=only)


def _family(name):
    return lambda s, d: _rows(s, d, name).select("frame", "subject", "answer")


def syn_frame_families(s, d):
    return _rows(s, d).groupBy("family", "form").agg(F.count("*").alias("n"), F.count_distinct("answer").alias("answers"))


def syn_invariants(s, d):
    r = _rows(s, d)
    return A.violations(r, {"empty": F.col("answer") == "", "bad_number": (F.col("form") == "number") & ~F.col("answer").rlike("^[1-9][0-9]*$"), "bad_yes_no": (F.col("form") == "binary") & ~F.col("answer").isin("yes", "no")})


def syn_unique_per_frame(s, d):
    return _rows(s, d).groupBy("frame", "family", "subject").agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("n"))


def syn_quota_sample(s, d):
    quotas = F.when(F.col("family") == "class_count", 50).when(F.col("family") == "list_all", 20).otherwise(30)
    return Y.quota_sample(_rows(s, d).select("frame", "family", "subject"), "frame", "family", quotas, 3, "q").select("frame", "family", "subject")


def syn_window_families(s, d):
    return Y.window_families(Y.window_facts(events(s, d), ["user_id"], "sec", "cls", 21600), ["user_id"])


def syn_boundary_safe(s, d):
    return Y.boundary_safe(events(s, d), ["user_id"], "hr", "cls", 24)


def syn_bin_plan(s, d):
    return Y.bin_plan(events(s, d).where("cls = 'purchase'"), ["user_id"], "hr", 10)


def syn_gated_notes(s, d):
    e = events(s, d)
    rows = e.select("event_id", "user_id", (F.col("user_id") * 1000000 + F.col("hr")).alias("frame"))
    arms = e.select("user_id").distinct().where("user_id % 5 <> 0").select("user_id", F.when(F.col("user_id") % 3 == 0, "control").otherwise("overlay").alias("arm"))
    notes = e.where("cls <> 'view'").groupBy((F.col("user_id") * 1000000 + F.col("hr")).alias("frame")).agg(F.when(F.count("*") > 1, F.min("cls")).otherwise("").alias("note"))
    return Y.gated(rows, arms, notes, "user_id", "frame").groupBy("status").agg(F.count("*").alias("n"))


_W = "with " + EV + ", c as (select user_id, sec // 21600 as win, cls, min(sec) as first_t, max(sec) as last_t, count(*) as n from ev group by 1, 2, 3), r as (select *, row_number() over (partition by user_id, win order by first_t, cls) as k, count(*) over (partition by user_id, win) as m from c) "
QUERIES = {
    "syn_frame_families": (syn_frame_families, None),
    "syn_inst_count": (_family("inst_count"), "with " + IN + " select frame, '' as subject, cast(count(*) as varchar) as answer from q group by 1"),
    "syn_class_diversity": (_family("class_diversity"), "with " + IN + " select frame, '' as subject, cast(count(distinct cls) as varchar) as answer from q group by 1"),
    "syn_class_count": (_family("class_count"), "with " + IN + " select frame, cls as subject, cast(count(*) as varchar) as answer from q group by 1, 2"),
    "syn_list_all": (_family("list_all"), "with " + IN + " select frame, '' as subject, string_agg(distinct cls, ', ' order by cls) as answer from q group by 1"),
    "syn_single_object": (_family("single_object"), "with " + IN + " select frame, '' as subject, min(cls) as answer from q group by 1 having count(*) = 1"),
    "syn_same_class": (_family("same_class"), "with " + IN + " select frame, '' as subject, case when count(distinct cls) = 1 then 'yes' else 'no' end as answer from q group by 1 having count(*) >= 2"),
    "syn_co_occur": (_family("co_occur"), "with " + IN + ", m as (select distinct frame, cls from q) select frame, a.cls || ' and ' || b.cls as subject, 'yes' as answer from m a join m b using (frame) where a.cls < b.cls"),
    "syn_quad_to_class": (_family("quad_to_class"), "with " + IN + " select frame, quad as subject, min(cls) as answer from q group by 1, 2 having count(*) = 1"),
    "syn_class_to_quad": (_family("class_to_quad"), "with " + IN + " select frame, cls as subject, min(quad) as answer from q group by 1, 2 having count(*) = 1"),
    "syn_closest_center": (_family("closest_center"), "with " + IN + ", k as (select *, row_number() over (partition by frame order by dist, cls, quad) as k from q), t as (select frame, max(case when k = 1 then cls end) as c, max(case when k = 1 then dist end) as d1, max(case when k = 2 then dist end) as d2 from k group by 1) select frame, '' as subject, c as answer from t where sqrt(d2) - sqrt(d1) >= 0.03 * sqrt(2.0::double)"),
    "syn_positions_all": (_family("positions_all"), "with " + IN + ", k as (select *, row_number() over (partition by frame order by quad, cls) as k, count(*) over (partition by frame) as n from q) select frame, '' as subject, string_agg(k || '. ' || cls || ': ' || quad, '; ' order by k) as answer from k where n <= 8 group by 1"),
    "syn_quad_populated": (_family("quad_populated"), "with " + IN + ", s as (select frame, list(quad) as l from q group by 1) select frame, '' as subject, array_to_string(list_filter(['top/left', 'top/right', 'bottom/left', 'bottom/right'], lambda x: list_contains(l, x)), ', ') as answer from s"),
    "syn_quad_not_populated": (_family("quad_not_populated"), "with " + IN + ", s as (select frame, list(quad) as l from q group by 1) select frame, '' as subject, coalesce(nullif(array_to_string(list_filter(['top/left', 'top/right', 'bottom/left', 'bottom/right'], lambda x: not list_contains(l, x)), ', '), ''), 'none') as answer from s"),
    "syn_invariants": (syn_invariants, "select * from (values ('empty', 0), ('bad_number', 0), ('bad_yes_no', 0)) as t(rule, n)"),
    "syn_unique_per_frame": (syn_unique_per_frame, "select 0 as n"),
    "syn_quota_sample": (syn_quota_sample, None),
    "syn_window_families": (
        syn_window_families,
        _W + "select user_id, win, 'classes_in_video' as family, string_agg(cls, ', ' order by cls) as answer from r group by 1, 2 union all select user_id, win, 'single_in_video', cls from r where m = 1 union all select distinct user_id, win, 'class_count_video', cast(m as varchar) from r "
        "union all select user_id, win, 'nth_unique_' || k, cls from r where k <= 3 union all select user_id, win, 'last_visible', cls from (select *, row_number() over (partition by user_id, win order by last_t desc, cls desc) as z from r) where z = 1 "
        "union all select user_id, win, 'most_often', cls from (select *, row_number() over (partition by user_id, win order by n desc, cls) as z from r) where z = 1",
    ),
    "syn_boundary_safe": (
        syn_boundary_safe,
        "with " + EV + ", m as (select distinct user_id, hr from ev), n as (select *, lead(hr) over (partition by user_id order by hr) as nx from m), l as (select user_id, cls, max(hr) as hr from ev group by 1, 2) select l.user_id, l.cls, l.hr, nx is null or nx - l.hr <= 24 as safe from l join n using (user_id, hr)",
    ),
    "syn_bin_plan": (
        syn_bin_plan,
        "with " + EV + ", p as (select distinct user_id, hr from ev where cls = 'purchase'), s as (select user_id, count(*) as n, unnest(generate_series(min(hr), max(hr))) as hr from p group by 1), e as (select s.*, row_number() over (partition by user_id order by hr) - 1 as rn, count(*) over (partition by user_id) as m from s anti join p using (user_id, hr)) "
        "select user_id, hr, 'positive' as kind from p union all select user_id, hr, 'negative' from e where rn % greatest(1, m // least(n, 10)) = 0 and rn / greatest(1, m // least(n, 10)) < least(n, 10)",
    ),
    "syn_gated_notes": (
        syn_gated_notes,
        "with " + EV + ", n as (select user_id, hr, case when count(*) > 1 then min(cls) else '' end as note from ev where cls <> 'view' group by 1, 2) select case when ev.user_id % 5 = 0 then 'no_arm' when ev.user_id % 3 = 0 then 'control' when note is null then 'missing' when note = '' then 'empty' else 'attached' end as status, count(*) as n from ev left join n using (user_id, hr) group by 1",
    ),
}

#: Formats of the families' answers.
_FORMS = {"number": ("inst_count", "class_diversity", "class_count"), "binary": ("same_class", "co_occur"), "multiple_choice": ("class_to_quad", "quad_populated", "quad_not_populated"), "open_ended": ("positions_all",)}
_EVERY = " union all ".join(
    f"select '{k[4:]}' as family, '{next((f for f, own in _FORMS.items() if k[4:] in own), 'fo_class')}' as form, * from ({sql})"
    for k, (_, sql) in QUERIES.items() if sql and k[4:] in ("inst_count", "class_diversity", "class_count", "list_all", "single_object", "same_class", "co_occur", "quad_to_class", "class_to_quad", "closest_center", "positions_all", "quad_populated", "quad_not_populated")
)
QUERIES["syn_frame_families"] = (syn_frame_families, f"with every as ({_EVERY}) select family, form, count(*) as n, count(distinct answer) as answers from every group by 1, 2")
_QUOTA = "(case family when 'class_count' then 50 when 'list_all' then 20 else 30 end)"


def _rounds_sql(rounds=8):
    """The rounds of offers, one after another; later rounds find nothing to do."""
    out = f"with every as ({_EVERY}), k0 as materialized (select frame, family, subject, frame || '|' || family || '|' || subject as k from every), ch0 as (select * from k0 where false)"
    for i in range(1, rounds + 1):
        out += (
            f", le{i} as materialized (select k0.*, {_QUOTA} - coalesce(h, 0) as lack, 3 - coalesce(g, 0) as room from k0 left join (select family, count(*) as h from ch{i - 1} group by 1) using (family) left join (select frame, count(*) as g from ch{i - 1} group by 1) using (frame) anti join ch{i - 1} using (k)), "
            f"of{i} as (select *, row_number() over (partition by family order by md5('q:' || k)) as a from le{i} where lack > 0 and room > 0), "
            f"ac{i} as materialized (select * from (select *, row_number() over (partition by frame order by md5('qf:' || k)) as b from of{i} where a <= lack) where b <= room), "
            f"ch{i} as materialized (select * from ch{i - 1} union all select frame, family, subject, k from ac{i})"
        )
    return out + f" select frame, family, subject from ch{rounds}"


QUERIES["syn_quota_sample"] = (syn_quota_sample, _rounds_sql())
