"""Lookups, boxes, prior answers and fold balance, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import stats
from tidemark.functions.text import seeded
from tidemark.operators import aggregates as A
from tidemark.operators import lookups as L
from tidemark.plans.base import EV, events, table


def rel_stem_default(s, d):
    """Pages with the fold of their stem, -1 where no fold is known."""
    pages = table(s, d, "pages").select("page_id", "url")
    folds = pages.where("page_id % 3 <> 0").select(F.regexp_replace(F.regexp_replace("url", r"^.*/", ""), r"(?<=.)\.[^.]*$", "").alias("stem"), F.pmod("page_id", F.lit(5)).alias("fold"))
    folds = folds.groupBy(F.lower("stem").alias("stem")).agg(F.min("fold").alias("fold"))
    return L.joined_by_stem(pages, "url", folds, "stem", "fold", F.lit(-1)).select("page_id", "fold")


def iv_nearest_frame(s, d):
    """Frames of each order's clip that its wanted times come to, at two frames and a half a second."""
    k = F.col("o_orderkey")
    want = table(s, d, "orders").select("o_orderkey", F.pmod("o_custkey", F.lit(40)).alias("start"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.pmod(k * (i + 3), F.lit(97)) / 2)).alias("t"))
    return want.select("o_orderkey", L.nearest_frame(F.col("t"), F.col("start"), F.lit(2.5), F.lit(60).cast("long")).alias("frame")).distinct()


def rel_rescored(s, d):
    """Requests that have an answer and a score in each of two runs, and how the runs differ."""
    o = table(s, d, "orders").select("o_orderkey", "o_orderpriority", "o_custkey")
    requests, answers = o.where("o_custkey % 4 <> 0").select("o_orderkey", "o_orderpriority"), o.where("o_orderkey % 3 <> 0").select("o_orderkey", (F.col("o_custkey") % 5 < 2).alias("mine"))
    first, second = (o.where(F.col("o_orderkey") % m != 0).select("o_orderkey", (F.col("o_orderkey") * m % 7 < 4).alias(n)) for m, n in ((5, "a"), (11, "b")))
    all_ = requests.join(answers, "o_orderkey").join(first, "o_orderkey").join(second, "o_orderkey")
    return all_.groupBy("o_orderpriority").agg(F.count("*").alias("n"), *[F.count_if(c).alias(f"n_{c}") for c in ("mine", "a", "b")], F.count_if(F.expr("a and not b")).alias("worse"), F.count_if(F.expr("b and not a")).alias("better"))


def _boxes(s, d):
    x, y = F.pmod("p_partkey", F.lit(130)) - 20, F.pmod(F.col("p_partkey") * 7, F.lit(130)) - 20
    return table(s, d, "part").select("p_partkey", x.alias("x0"), y.alias("y0"), (x + F.col("p_size") % 20).alias("x1"), (y + F.col("p_size") * 3 % 25).alias("y1"))


def flt_clipped_boxes(s, d):
    """Boxes cut to a frame of 100 by 100; those with nothing left go."""
    b = _boxes(s, d).select("p_partkey", L.clipped_box(*map(F.col, ("x0", "y0", "x1", "y1")), F.lit(100), F.lit(100)).alias("b")).where("b is not null")
    return b.select("p_partkey", "b.*")


def tm_box_iou(s, d):
    """Overlap of each box with the box of the part before it."""
    b = _boxes(s, d).select("p_partkey", F.struct(*[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")]).alias("b"))
    other = b.select((F.col("p_partkey") + 1).alias("p_partkey"), F.col("b").alias("o"))
    return b.join(other, "p_partkey").select("p_partkey", F.round(stats.box_iou(F.col("b"), F.col("o")), 9).alias("iou"))


def tm_centroid(s, d):
    """Centre of an instance: the mean of its points where it has any, else the middle of its box."""
    p = _boxes(s, d)
    points = table(s, d, "lineitem").where("l_quantity > 45").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.round(F.avg(F.col("l_suppkey") % 100), 6).alias("mx"), F.round(F.avg(F.col("l_orderkey") % 100), 6).alias("my"))
    mean = p.join(points, "p_partkey", "left")
    return mean.select("p_partkey", F.coalesce("mx", (F.col("x0") + F.col("x1")) / 2.0).alias("cx"), F.coalesce("my", (F.col("y0") + F.col("y1")) / 2.0).alias("cy"))


#: Words that name an operation on a hernia.
HERNIA = r"(?i)hernia|\btapp\b|\btep\b|\bipom\b|inguinal|ventral|umbilical"


def txt_is_hernia(s, d):
    """Procedures, named after market segments, that the keyword rule flags."""
    named = F.concat(F.when(F.col("c_mktsegment") == "BUILDING", "Inguinal repair, ").when(F.col("c_mktsegment") == "MACHINERY", "TEP, ").when(F.col("c_mktsegment") == "FURNITURE", "step ").otherwise(""), "c_mktsegment", F.lit(" "), "c_name")
    return table(s, d, "customer").groupBy("c_mktsegment").agg(F.count_if(F.rlike(named, F.lit(HERNIA))).alias("hits"), F.count("*").alias("n"))


def smp_sharpest_within(s, d):
    """For every twelfth hour the most valuable free hour within three."""
    e = events(s, d)
    sec = e.groupBy("user_id", F.col("hr").alias("sec")).agg(F.max("value").alias("sharp")).withColumn("masked", F.col("sec") % 7 == 0)
    want = e.where("hr % 12 = 0").select("user_id", F.col("hr").alias("t")).distinct()
    return L.sharpest_near(want, sec, ["user_id"], "t", 3.0).select("user_id", "t", "pick")


def sc_prior_answers(s, d):
    """Priors of four fifths of the orders, put to the rest."""
    o = table(s, d, "orders")
    rows = o.select("o_orderkey", F.concat_ws(" ", "o_orderpriority", F.pmod("o_custkey", F.lit(40)).cast("string")).alias("template"), F.when(F.col("o_orderkey") % 6 == 0, "time").when(F.col("o_orderkey") % 2 == 0, "number").otherwise("binary").alias("form"), F.col("o_orderstatus").alias("answer"), F.pmod("o_orderkey", F.lit(50)).alias("lo"), F.pmod("o_orderkey", F.lit(50)).alias("_w"))
    rows = rows.withColumn("hi", F.col("lo") + 9).drop("_w")
    known, asked = rows.where("o_orderkey % 5 <> 0 and o_orderkey % 7 <> 1"), rows.where("o_orderkey % 5 = 0")
    return L.prior_answers(known, asked, "template", "form", "answer").select("o_orderkey", "guess")


def _fold_counts(s, d):
    docs = table(s, d, "documents").where("source is not null and lang is not null").withColumn("fold", F.pmod("doc_id", F.lit(5)))
    return A.count_vectors(docs, ["fold"], ["lang", "source"])


def sp_balance_score(s, d):
    return L.balance_score(_fold_counts(s, d), "fold", F.when(F.col("family") == "lang", 2.0).otherwise(1.0), 0.04, 3.0).select(F.round("score", 9).alias("score"), "n_values")


def sp_rare_swaps(s, d):
    """Suppliers with very large balances spread over five folds by trades within their nation's parity."""
    u = table(s, d, "supplier")
    u = u.select(F.col("s_suppkey").alias("unit"), F.pmod("s_suppkey", F.lit(5)).cast("long").alias("fold"), (F.col("s_nationkey") % 2).alias("kind"), F.when(F.col("s_suppkey") % 9 == 1, F.floor(F.abs("s_acctbal"))).otherwise(0).cast("long").alias("n"), seeded("swap", F.col("s_suppkey")).alias("draw"))
    return L.rare_swaps(u, 5)


def flt_route_group(s, d):
    """Events whose class a table of routes puts into one of the wanted groups."""
    routes = s.createDataFrame([("view", "PASSIVE"), ("click", "PASSIVE"), ("purchase", "ACTIVE"), ("signup", "ENTRY")], "cls string, route string")  # the router's table
    wanted = F.broadcast(routes.where(F.col("route").isin("ACTIVE", "ENTRY")))
    return events(s, d).join(wanted, "cls", "left_semi").select("event_id", "cls")


def tl_track_bounds(s, d):
    t = L.track_bounds(events(s, d), ["user_id", "cls"], "hr")
    return t.select("user_id", "cls", "t_min", "t_max", F.array_join(F.col("times").cast("array<string>"), ",").alias("times"))


def rel_size_numbering(s, d):
    n = L.numbered_by_size(table(s, d, "part"), ["p_size", "p_brand"], F.col("p_retailprice"), "p_partkey")
    return n.select("p_partkey", F.col("number").cast("long").alias("number"))


_BX = "bx as (select p_partkey, p_partkey % 130 - 20 as x0, (p_partkey * 7) % 130 - 20 as y0, p_partkey % 130 - 20 + p_size % 20 as x1, (p_partkey * 7) % 130 - 20 + p_size * 3 % 25 as y1 from part)"
_STEM = "lower(case when regexp_matches(regexp_replace(url, '^.*/', ''), '^.+\\.[^.]*$') then regexp_replace(regexp_replace(url, '^.*/', ''), '\\.[^.]*$', '') else regexp_replace(url, '^.*/', '') end)"
QUERIES = {
    "rel_stem_default": (rel_stem_default, f"with p as (select page_id, {_STEM} as stem from pages), f as (select stem, min(page_id % 5) as fold from p where page_id % 3 <> 0 group by 1) select page_id, coalesce(fold, -1) as fold from p left join f using (stem)"),
    "iv_nearest_frame": (iv_nearest_frame, "with w as (select o_orderkey, o_custkey % 40 as start, unnest([((o_orderkey * (i + 3)) % 97) / 2.0::double for i in range(6)]) as t from orders) select distinct o_orderkey, least(greatest(cast(round_even((t - start) * 2.5::double, 0) as bigint), 0), 59) as frame from w"),
    "rel_rescored": (
        rel_rescored,
        "with r as (select o_orderkey, o_orderpriority from orders where o_custkey % 4 <> 0), m as (select o_orderkey, o_custkey % 5 < 2 as mine from orders where o_orderkey % 3 <> 0), a as (select o_orderkey, o_orderkey * 5 % 7 < 4 as a from orders where o_orderkey % 5 <> 0), b as (select o_orderkey, o_orderkey * 11 % 7 < 4 as b from orders where o_orderkey % 11 <> 0) "
        "select o_orderpriority, count(*) as n, count(*) filter (where mine) as n_mine, count(*) filter (where a) as n_a, count(*) filter (where b) as n_b, count(*) filter (where a and not b) as worse, count(*) filter (where b and not a) as better from r join m using (o_orderkey) join a using (o_orderkey) join b using (o_orderkey) group by 1",
    ),
    "flt_clipped_boxes": (flt_clipped_boxes, f"with {_BX}, c as (select p_partkey, least(greatest(x0, 0), 100) as x0, least(greatest(y0, 0), 100) as y0, least(greatest(x1, 0), 100) as x1, least(greatest(y1, 0), 100) as y1 from bx) select * from c where x1 > x0 and y1 > y0"),
    "tm_box_iou": (
        tm_box_iou,
        f"with {_BX}, j as (select a.p_partkey, greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) as i, (a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) as t from bx a join bx b on a.p_partkey = b.p_partkey + 1) select p_partkey, case when t - i > 0 then round(i / cast(t - i as double), 9) else 0.0 end as iou from j",
    ),
    "tm_centroid": (
        tm_centroid,
        f"with {_BX}, m as (select l_partkey as p_partkey, round(avg(l_suppkey % 100), 6) as mx, round(avg(l_orderkey % 100), 6) as my from lineitem where l_quantity > 45 group by 1) select p_partkey, coalesce(mx, (x0 + x1) / 2.0::double) as cx, coalesce(my, (y0 + y1) / 2.0::double) as cy from bx left join m using (p_partkey)",
    ),
    "txt_is_hernia": (txt_is_hernia, "select c_mktsegment, count(*) filter (where c_mktsegment in ('BUILDING', 'MACHINERY')) as hits, count(*) as n from customer group by 1"),
    "smp_sharpest_within": (
        smp_sharpest_within,
        "with " + EV + ", s as (select user_id, hr as sec, max(value) as sharp from ev group by 1, 2), w as (select distinct user_id, hr as t from ev where hr % 12 = 0), n as (select w.user_id, t, sec, row_number() over (partition by w.user_id, t order by sharp desc, sec) as k from w join s on w.user_id = s.user_id and sec between t - 3 and t + 3 where sharp is not null and sec % 7 <> 0) "
        "select w.user_id, w.t, cast(coalesce(sec, w.t) as double) as pick from w left join n on w.user_id = n.user_id and w.t = n.t and k = 1",
    ),
    "sc_prior_answers": (
        sc_prior_answers,
        "with r as (select o_orderkey, o_orderpriority || ' ' || (o_custkey % 40) as template, case when o_orderkey % 6 = 0 then 'time' when o_orderkey % 2 = 0 then 'number' else 'binary' end as form, o_orderstatus as answer, o_orderkey % 50 as lo from orders), kn as (select * from r where o_orderkey % 5 <> 0 and o_orderkey % 7 <> 1 and form <> 'time'), "
        "tm as (select template, answer, row_number() over (partition by template order by count(*) desc, answer) as k from kn group by 1, 2), fm as (select form, answer, row_number() over (partition by form order by count(*) desc, answer) as k from kn group by 1, 2) "
        "select o_orderkey, case when r.form = 'time' then cast((lo + lo + 9) / 2.0::double as varchar) else coalesce(tm.answer, fm.answer, 'none') end as guess from r left join tm on r.template = tm.template and tm.k = 1 left join fm on r.form = fm.form and fm.k = 1 where o_orderkey % 5 = 0",
    ),
    "sp_balance_score": (
        sp_balance_score,
        "with d as (select doc_id % 5 as fold, lang, source from documents where source is not null and lang is not null), c as (select fold, 'lang' as family, lang as value, count(*) as n from d group by 1, 3 union all select fold, 'source', source, count(*) from d group by 1, 3), pf as (select fold, family, sum(n) as fam from c group by 1, 2), t as (select family, value, sum(n) as n, sum(sum(n)) over (partition by family) as al from c group by 1, 2), "
        "g as (select t.family, t.value, t.n as tn, al, f.fold from t cross join (select distinct fold from d) f), s as (select g.family, g.value, tn, al, coalesce(c.n, 0) as n, coalesce(c.n, 0) / cast(greatest(coalesce(fam, 0), 1) as double) as share from g left join c using (fold, family, value) left join pf using (fold, family)), "
        "p as (select family, tn / cast(al as double) < 0.04 as rare, max(share) - min(share) as r, min(n) as least from s group by family, value, tn, al) select round(sum(case family when 'lang' then 2.0::double else 1.0::double end * case when rare then 3.0::double else 1.0::double end * (r + case when rare and least = 0 then 0.5::double else 0.0::double end)), 9) as score, count(*) as n_values from p",
    ),
    "sp_rare_swaps": (sp_rare_swaps, None),
    "flt_route_group": (flt_route_group, "select event_id, event_type as cls from events where event_type in ('purchase', 'signup')"),
    "tl_track_bounds": (tl_track_bounds, "with " + EV + " select user_id, cls, min(hr) as t_min, max(hr) as t_max, array_to_string(list_sort(list(distinct hr)), ',') as times from ev group by 1, 2"),
    "rel_size_numbering": (rel_size_numbering, "select p_partkey, row_number() over (partition by p_size, p_brand order by p_retailprice desc, p_partkey) as number from part"),
}
