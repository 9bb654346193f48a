"""Window families and their checks: six hours of a user are a window, an hour is a frame of it."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import windows as Y
from tidemark.plans.base import EV, events, table
from tidemark.functions.text import quadrant, seeded

KEYS = ["user_id", "win"]
QUADS = ("top/left", "top/right", "bottom/left", "bottom/right")
SPAN, TOLERANCE = 24, 6


def _rows(s, d):
    e = events(s, d)
    one = F.lit(1.0)
    cx, cy = F.pmod("event_id", F.lit(64)) / 64, F.pmod(F.col("event_id") * 7, F.lit(64)) / 64
    return e.select("user_id", F.floor(F.col("hr") / SPAN).alias("win"), F.col("hr").alias("t"), "cls", quadrant(cx, cy, one, one).alias("quad"))


RW = EV + f""", rw as (select user_id, hr // {SPAN} as win, hr as t, cls, (case when ((event_id * 7) % 64) / 64.0 * 2 < 1 then 'top' else 'bottom' end) || '/' || (case when (event_id % 64) / 64.0 * 2 < 1 then 'left' else 'right' end) as quad from ev),
 fr as (select *, row_number() over (partition by user_id, win order by t) - 1 as i, count(*) over (partition by user_id, win) as m, lead(t) over (partition by user_id, win order by t) as next_t, lag(t) over (partition by user_id, win order by t) as prev_t from (select distinct user_id, win, t from rw)),
 pc as (select user_id, win, t, cls, count(*) as n, case when count(*) = 1 then min(quad) end as quad from rw group by 1, 2, 3, 4)"""
_DRAW = "cast('0x' || substr(md5('{s}:' || {k}), 1, 7) as bigint)"
_KEY = "user_id || '|' || win"


def win_classes_between(s, d):
    return Y.classes_between(_rows(s, d), KEYS, "cb")


def _edge(kind):
    def query(s, d):
        rows = _rows(s, d)
        return Y.edge_times(rows, Y.frames(rows, KEYS), KEYS, ["cls"], kind, TOLERANCE)

    return query


def _pair_edge(kind):
    def query(s, d):
        rows = _rows(s, d)
        return Y.edge_times(Y.pairs_in_frames(rows, KEYS), Y.frames(rows, KEYS), KEYS, ["a", "b"], kind, TOLERANCE)

    return query


def _edge_quadrant(kind):
    return lambda s, d: Y.edge_quadrant(Y.per_class(_rows(s, d), KEYS), KEYS, kind)


def win_also_appear(s, d):
    rows = _rows(s, d)
    return Y.also_appears(Y.per_class(rows, KEYS), Y.frames(rows, KEYS), KEYS, "aa")


def _quads(seen):
    def query(s, d):
        have = F.collect_set("quad").alias("have")
        own = _rows(s, d).groupBy(*KEYS).agg(have)
        all_ = F.array(*map(F.lit, QUADS))
        found = F.filter(all_, lambda q: F.array_contains("have", q) == F.lit(seen))
        return own.select(*KEYS, F.coalesce(F.nullif(F.array_join(found, ", "), F.lit("")), F.lit("none")).alias("answer"))

    return query


def win_positions_all(s, d):
    """Places of all instances of a frame that has at most eight."""
    rows = _rows(s, d).withColumn("q", F.array_position(F.array(*map(F.lit, QUADS)), F.col("quad")))
    own = rows.groupBy(*KEYS, "t").agg(F.sort_array(F.collect_list(F.struct("q", "cls", "quad"))).alias("x")).where(F.size("x") <= 8)
    said = F.transform("x", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["cls"], F.lit(": "), x["quad"]))
    return own.select(*KEYS, "t", F.array_join(said, " ").alias("answer"))


def win_max_at_once(s, d):
    return Y.per_class(_rows(s, d), KEYS).groupBy(*KEYS, "cls").agg(F.max("n").alias("answer"))


def syn_co_occur_no(s, d):
    """Pairs of a present and an absent class, answered no, at most 1.25 times as many as the pairs answered yes."""
    frames = events(s, d).groupBy((F.col("user_id") * 1000000 + F.col("hr")).alias("frame")).agg(F.collect_set("cls").alias("c"))
    every = events(s, d).agg(F.sort_array(F.collect_set("cls")).alias("every"))  # one row of few classes
    frames = frames.crossJoin(F.broadcast(every))
    pair = lambda other, answer: frames.withColumn("x", F.explode("c")).withColumn("y", F.explode(other)).select("frame", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.lit(answer).alias("answer"))
    rows = pair("c", "yes").where("a < b").distinct().unionByName(pair(F.array_except("every", "c"), "no"))
    order = seeded("no", F.concat_ws("|", "frame", "a", "b"))
    return Y.capped_negatives(rows, F.col("answer") == "yes", 1.25, order)


def val_derived(s, d):
    """Answers derived for the questions of a family as the family words them: the n-th unique class of a window."""
    rows = _rows(s, d)
    firsts = rows.groupBy(*KEYS, "cls").agg(F.min("t").alias("t")).groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("t", "cls"))).alias("x"))
    asked = firsts.withColumn("q", F.concat(F.lit("Which is the "), (F.pmod("win", F.lit(4)) + 1).cast("string"), F.lit("th unique class?")))
    n = F.regexp_extract("q", r"([0-9]+)(?:st|nd|rd|th) unique", 1).cast("int")
    return asked.select(*KEYS, n.alias("n"), F.coalesce(F.get("x", n - 1)["cls"], F.lit("none")).alias("answer"))


def val_covered(s, d):
    """Windows that their frames cover: three or more, and both ends within a few hours of the window's."""
    own = Y.frames(_rows(s, d), KEYS).groupBy(*KEYS).agg(F.count("*").alias("n"), F.min("t").alias("a"), F.max("t").alias("b"))
    lo = F.col("win") * SPAN
    return own.where((F.col("n") >= 3) & (F.col("a") - lo <= TOLERANCE) & (lo + SPAN - F.col("b") <= TOLERANCE)).select(*KEYS, "n", "a", "b")


def val_sparse_bias(s, d):
    """Families answered from all frames of a dense window and from the thinned ones: how often they agree, and how
    far the times of those that do not lie apart."""
    own = Y.sparse_check(_rows(s, d).select("user_id", "t", "cls", "quad"), ["user_id"], "t", 6, 48, 9, 5, 12, 3)
    names = lambda keep, c: F.array_join(F.sort_array(F.collect_set(F.when(keep, F.col(c)))), ", ")
    edge = lambda f, keep: f(F.when(keep, F.col("t")))
    first = lambda keep: F.min(F.when(keep, F.struct("t", "cls")))["cls"]
    none = lambda keep: F.lit(None).cast("long")
    kinds = {
        "classes_in_video": (lambda keep: names(keep, "cls"), none), "quad_populated": (lambda keep: names(keep, "quad"), none), "nth_unique": (first, none),
        "first_visible": (lambda keep: edge(F.min, keep), lambda keep: edge(F.min, keep)), "last_visible": (lambda keep: edge(F.max, keep), lambda keep: edge(F.max, keep)),
    }
    full, thin = F.lit(True), F.col("sparse")
    per = own.groupBy("user_id", "grp").agg(*[F.struct(F.lit(k).alias("family"), answer(full).eqNullSafe(answer(thin)).alias("same"), (time(thin) - time(full)).alias("off")).alias(k) for k, (answer, time) in kinds.items()])
    return per.select(F.explode(F.array(*kinds)).alias("x")).groupBy("x.family").agg(F.count("*").alias("n"), F.count_if("x.same").alias("agree"), F.sum(F.when(~F.col("x.same"), F.abs("x.off"))).alias("off"))


def spl_negatives(s, d):
    """Orders of one status are positive; the others are capped at half as many, and positives of even keys come thrice."""
    rows = table(s, d, "orders").select("o_orderkey", "o_orderstatus")
    kept = Y.capped_negatives(rows, F.col("o_orderstatus") == "P", 2.0, seeded("neg", F.col("o_orderkey")))
    return Y.repeated(kept, F.col("o_orderkey") % 2 == 0, 3).select("o_orderkey", "o_orderstatus", F.col("copy").cast("long").alias("copy"))


def spl_other_negatives(s, d):
    """Rows of the other kind join as class ``other``: of each user every k-th, so that they are a tenth of the own ones."""
    from pyspark.sql import Window as W

    e = events(s, d)
    own = e.where("user_id % 2 = 0").select("event_id", "user_id", "cls")
    want = own.agg(F.floor(F.count("*") * 0.1).alias("want"))
    other = e.where("user_id % 2 = 1")
    users = other.agg(F.count_distinct("user_id").alias("users"))
    w = W.partitionBy("user_id").orderBy("event_id")
    ranked = other.withColumn("k", F.row_number().over(w) - 1).withColumn("m", F.count("*").over(W.partitionBy("user_id")))
    ranked = ranked.crossJoin(F.broadcast(want)).crossJoin(F.broadcast(users))
    step = F.greatest(F.lit(1), F.floor(F.col("m") * F.col("users") / F.greatest("want", F.lit(1))))
    drawn = ranked.where(F.col("k") % step == 0).select("event_id", "user_id", F.lit("other").alias("cls"))
    return own.unionByName(drawn)


def _edge_sql(kind, items, what):
    pick, beyond = ("max", "next_t") if kind == "last" else ("min", "prev_t")
    return f"with {RW}{items[0]}, et as (select user_id, win, {what}, {pick}(t) as t from {items[1]} group by all) select et.user_id, et.win, {what}, et.t from et join fr using (user_id, win, t) where {beyond} is null or abs({beyond} - et.t) <= {TOLERANCE}"


_PAIR = (", pr as (select distinct a.user_id, a.win, a.t, a.cls as a, b.cls as b from rw a join rw b on a.user_id = b.user_id and a.win = b.win and a.t = b.t and a.cls < b.cls)", "pr")
_QUAD_SQL = "with " + RW + ", h as (select user_id, win, list(distinct quad) as have from rw group by 1, 2) select user_id, win, coalesce(nullif(array_to_string(list_filter(['top/left', 'top/right', 'bottom/left', 'bottom/right'], lambda q: {n} list_contains(have, q)), ', '), ''), 'none') as answer from h"
_QEDGE = "with " + RW + ", k as (select *, row_number() over (partition by user_id, win, cls order by t {o}) as k from pc) select user_id, win, cls, t, quad as answer from k where k = 1 and n = 1"
QUERIES = {
    "win_classes_between": (
        win_classes_between,
        f"with {RW}, a as (select user_id, win, max(m) as m, list(t order by t) as ts from fr where m >= 3 group by 1, 2), b as (select *, {_DRAW.format(s='cb', k=_KEY)} % (m - 2) as i from a), c as (select *, i + 1 + {_DRAW.format(s='cbj', k=_KEY)} % (m - i - 1) as j from b), "
        "e as (select user_id, win, ts[i + 1] as t0, ts[j + 1] as t1 from c) select user_id, win, t0, t1, string_agg(distinct cls, ', ' order by cls) as answer from e join rw using (user_id, win) where t between t0 and t1 group by 1, 2, 3, 4",
    ),
    "win_last_visible": (_edge("last"), _edge_sql("last", ("", "rw"), "cls")),
    "win_first_visible": (_edge("first"), _edge_sql("first", ("", "rw"), "cls")),
    "win_pair_last": (_pair_edge("last"), _edge_sql("last", _PAIR, "a, b")),
    "win_pair_first": (_pair_edge("first"), _edge_sql("first", _PAIR, "a, b")),
    "win_first_quad": (_edge_quadrant("first"), _QEDGE.format(o="")),
    "win_last_quad": (_edge_quadrant("last"), _QEDGE.format(o="desc")),
    "win_also_appear": (
        win_also_appear,
        f"with {RW}, s as (select pc.user_id, pc.win, pc.cls, pc.t as t0, m, (i + 1 + {_DRAW.format(s='aa', k="pc.user_id || '|' || pc.win || '|' || pc.t || '|' || pc.cls")} % (m - 1)) % m as o from pc join fr using (user_id, win, t) where n = 1 and m > 1), "
        "u as (select s.user_id, s.win, s.cls, t0, fr.t as t1 from s join fr on s.user_id = fr.user_id and s.win = fr.win and s.o = fr.i) select u.user_id, u.win, u.cls, t0, t1, case when pc.n is null then 'no' else 'yes' end as answer from u left join pc on u.user_id = pc.user_id and u.win = pc.win and u.cls = pc.cls and u.t1 = pc.t",
    ),
    "win_quad_populated": (_quads(True), _QUAD_SQL.format(n="")),
    "win_quad_not_populated": (_quads(False), _QUAD_SQL.format(n="not")),
    "win_positions_all": (
        win_positions_all,
        "with " + RW + ", o as (select *, row_number() over (partition by user_id, win, t order by list_position(['top/left', 'top/right', 'bottom/left', 'bottom/right'], quad), cls) as k, count(*) over (partition by user_id, win, t) as n from rw) select user_id, win, t, string_agg(k || '. ' || cls || ': ' || quad, ' ' order by k) as answer from o where n <= 8 group by 1, 2, 3",
    ),
    "win_max_at_once": (win_max_at_once, "with " + RW + " select user_id, win, cls, max(n) as answer from pc group by 1, 2, 3"),
    "syn_co_occur_no": (
        syn_co_occur_no,
        "with " + EV + ", m as (select distinct user_id * 1000000 + hr as frame, cls from ev), y as (select a.frame, a.cls as a, b.cls as b, 'yes' as answer from m a join m b using (frame) where a.cls < b.cls), c as (select distinct cls from m), "
        "n as (select frame, least(m.cls, c.cls) as a, greatest(m.cls, c.cls) as b, 'no' as answer from m cross join c where not exists (select 1 from m z where z.frame = m.frame and z.cls = c.cls)), r as (select *, row_number() over (order by md5('no:' || frame || '|' || a || '|' || b)) as k from n) select * from y union all select frame, a, b, answer from r where k <= (select round(count(*) * 1.25) from y)",
    ),
    "val_derived": (
        val_derived,
        "with " + RW + ", f as (select user_id, win, cls, min(t) as t from rw group by 1, 2, 3), x as (select user_id, win, win % 4 + 1 as n, list(cls order by t, cls) as l from f group by 1, 2) select user_id, win, n, coalesce(l[n], 'none') as answer from x",
    ),
    "val_covered": (val_covered, f"with {RW} select user_id, win, count(*) as n, min(t) as a, max(t) as b from fr group by 1, 2 having count(*) >= 3 and min(t) - win * {SPAN} <= {TOLERANCE} and win * {SPAN} + {SPAN} - max(t) <= {TOLERANCE}"),
    "val_sparse_bias": (
        val_sparse_bias,
        "with recursive " + RW + ", a as (select distinct user_id, t from rw), b as (select *, case when lag(t) over w is null or t - lag(t) over w > 6 then t end as s from a window w as (partition by user_id order by t)), r as (select user_id, t, max(s) over (partition by user_id order by t) as run from b), "
        "st as (select user_id, run, min(t) as t from r group by 1, 2 union all select st.user_id, st.run, (select min(r.t) from r where r.user_id = st.user_id and r.run = st.run and r.t > st.t + 48) as t from st where st.t is not null), "
        "g as (select r.user_id, r.t, max(st.t) as grp from r join st on st.user_id = r.user_id and st.run = r.run and st.t <= r.t group by 1, 2), "
        "w as (select user_id, grp from g group by 1, 2 having count(*) >= 5 and max(t) - grp >= 12), v as (select g.* from g join w using (user_id, grp)), "
        "th as (select user_id, grp, min(t) as t from v group by 1, 2 union all select th.user_id, th.grp, (select min(v.t) from v where v.user_id = th.user_id and v.grp = th.grp and v.t >= th.t + 9) as t from th where th.t is not null), "
        "en as (select user_id, grp from th where t is not null group by 1, 2 having count(*) >= 3), "
        "o as (select v.user_id, grp, v.t, th.t is not null as sparse, cls, quad from v join en using (user_id, grp) left join th using (user_id, grp, t) join rw on rw.user_id = v.user_id and rw.t = v.t), "
        "p as (select user_id, grp, string_agg(distinct cls, ', ' order by cls) = string_agg(distinct cls, ', ' order by cls) filter (where sparse) as s1, string_agg(distinct quad, ', ' order by quad) = string_agg(distinct quad, ', ' order by quad) filter (where sparse) as s2, "
        "arg_min(cls, (t, cls)) = arg_min(cls, (t, cls)) filter (where sparse) as s3, min(t) = min(t) filter (where sparse) as s4, max(t) = max(t) filter (where sparse) as s5, min(t) filter (where sparse) - min(t) as d4, max(t) filter (where sparse) - max(t) as d5 from o group by 1, 2) "
        + " union all ".join(f"select '{n}' as family, count(*) as n, count(*) filter (where s{i}) as agree, {f'cast(sum(abs(d{i})) filter (where not s{i}) as bigint)' if i > 3 else 'cast(null as bigint)'} as off from p" for i, n in enumerate(("classes_in_video", "quad_populated", "nth_unique", "first_visible", "last_visible"), 1)),
    ),
    "spl_negatives": (
        spl_negatives,
        "with n as (select o_orderkey, o_orderstatus, row_number() over (order by md5('neg:' || o_orderkey)) as k from orders where o_orderstatus <> 'P'), k as (select o_orderkey, o_orderstatus from orders where o_orderstatus = 'P' union all select o_orderkey, o_orderstatus from n where k <= (select round(count(*) * 2.0) from orders where o_orderstatus = 'P')) select o_orderkey, o_orderstatus, unnest(range(1, case when o_orderkey % 2 = 0 then 4 else 2 end)) as copy from k",
    ),
    "spl_other_negatives": (
        spl_other_negatives,
        "with " + EV + ", o as (select event_id, user_id, cls from ev where user_id % 2 = 0), w as (select cast(floor(count(*) * 0.1) as bigint) as want from o), t as (select event_id, user_id, row_number() over (partition by user_id order by event_id) - 1 as k, count(*) over (partition by user_id) as m from ev where user_id % 2 = 1), "
        "u as (select count(distinct user_id) as users from t), d as (select event_id, user_id, 'other' as cls from t, w, u where k % greatest(1, cast(floor(m * users / greatest(want, 1)) as bigint)) = 0) select * from o union all select * from d",
    ),
}
