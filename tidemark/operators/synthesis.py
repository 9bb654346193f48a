"""Questions and answers made from annotated frames, under quotas and invariants.

Instances are long rows: frame key columns, cls, cx, cy (0 to 1 of the frame). Each family is one
projection of aggregated frame facts; families are put together by name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.text import quadrant, seeded
from tidemark.operators.ranks import hashed_places
from tidemark.staging import Steps

#: Instances that one task gathers into frames, about.
TASK_ROWS = 1 << 17
#: Chosen rows up to which they go to every task.
BROADCAST_ROWS = 100_000
QUADRANTS = ("top/left", "top/right", "bottom/left", "bottom/right")


def facts(instances: DataFrame, frame: str) -> DataFrame:
    """Per frame: n, sorted distinct classes, and per class and quadrant the counts, as arrays.

    There are as many tasks as the instances need, so that none gathers more than ``TASK_ROWS`` and a frame.
    """
    one = F.lit(1.0)
    parts = max(int(instances.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-instances.count() // TASK_ROWS))
    rows = instances.withColumn("quad", quadrant(F.col("cx"), F.col("cy"), one, one)).withColumn("dist", F.pow(F.col("cx") - 0.5, 2) + F.pow(F.col("cy") - 0.5, 2))
    found = rows.select(frame, F.struct("dist", "cls", "quad").alias("item")).repartition(parts, frame).groupBy(frame).agg(F.array_sort(F.collect_list("item")).alias("items"))
    classes = F.sort_array(F.array_distinct(F.array_compact(F.transform("items", lambda x: x["cls"]))))
    return found.select(frame, F.size("items").cast("long").alias("n"), classes.alias("classes"), "items")


def families(frames: DataFrame, frame: str, gap: float = 0.03, only: str | None = None) -> DataFrame:
    """One row per frame and family that applies: frame, family, subject, answer, form; of one family, if ``only`` names it.

    A frame is read once: its rows are made as one list.
    """
    none, items, quads = F.lit(""), F.col("items"), F.array(*map(F.lit, QUADRANTS))
    having = lambda field, value: F.filter(items, lambda x: x[field] == value)

    def row(family: str, subject: Column, answer: Column, form: str) -> Column:
        return F.struct(F.lit(family).alias("family"), subject.cast("string").alias("subject"), answer.cast("string").alias("answer"), F.lit(form).alias("form"))

    def one(when: Column, *args) -> Column:
        return F.filter(F.array(F.when(when, row(*args))), lambda x: x.isNotNull())

    every = F.lit(True)
    seen = F.transform(quads, lambda q: F.when(F.exists("items", lambda x: x["quad"] == q), q))
    nearest = F.sqrt(F.get("items", F.lit(1))["dist"]) - F.sqrt(F.get("items", F.lit(0))["dist"])
    places = F.transform(F.array_sort(F.transform("items", lambda x: F.struct(x["quad"].alias("quad"), x["cls"].alias("cls")))), lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["cls"], F.lit(": "), x["quad"]))
    pairs = F.flatten(F.transform("classes", lambda a: F.transform(F.filter("classes", lambda b: a < b), lambda b: row("co_occur", F.concat_ws(" and ", a, b), F.lit("yes"), "binary"))))
    alone = lambda own, field: F.get(own, F.lit(0))[field]
    parts = {
        "inst_count": one(every, "inst_count", none, F.col("n"), "number"),
        "class_diversity": one(every, "class_diversity", none, F.size("classes"), "number"),
        "class_count": F.transform("classes", lambda c: row("class_count", c, F.size(having("cls", c)), "number")),
        "list_all": one(every, "list_all", none, F.array_join("classes", ", "), "fo_class"),
        "single_object": one(F.col("n") == 1, "single_object", none, F.get("classes", F.lit(0)), "fo_class"),
        "same_class": one(F.col("n") >= 2, "same_class", none, F.when(F.size("classes") == 1, "yes").otherwise("no"), "binary"),
        "co_occur": pairs,
        "quad_to_class": F.transform(F.filter(quads, lambda q: F.size(having("quad", q)) == 1), lambda q: row("quad_to_class", q, alone(having("quad", q), "cls"), "fo_class")),
        "class_to_quad": F.transform(F.filter("classes", lambda c: F.size(having("cls", c)) == 1), lambda c: row("class_to_quad", c, alone(having("cls", c), "quad"), "multiple_choice")),
        "closest_center": one((F.col("n") >= 2) & (nearest >= gap * 2**0.5), "closest_center", none, F.get("items", F.lit(0))["cls"], "fo_class"),
        "positions_all": one(F.col("n") <= 8, "positions_all", none, F.array_join(places, "; "), "open_ended"),
        "quad_populated": one(every, "quad_populated", none, F.array_join(F.array_compact(seen), ", "), "multiple_choice"),
        "quad_not_populated": one(every, "quad_not_populated", none, F.coalesce(F.nullif(F.array_join(F.array_except(quads, F.array_compact(seen)), ", "), F.lit("")), F.lit("none")), "multiple_choice"),
    }
    rows = parts[only] if only else F.concat(*parts.values())
    return frames.select(frame, F.explode(rows).alias("_r")).select(frame, "_r.family", "_r.subject", "_r.answer", "_r.form")


def quota_sample(rows: DataFrame, frame: str, family: str, quotas: Column, per_frame: int, seed: str) -> DataFrame:
    """A seeded choice of at most the quota of each family and ``per_frame`` rows of each frame: no family stays
    short while a row of it is left whose frame has room.

    In each round the families offer as many of their rows as they still lack, in seeded order, and every frame accepts
    what it has room for; rows of full frames go. Rounds end when no family that lacks rows has any to offer. A
    round that accepts nothing cannot be: whatever is offered has a frame with room. ``quotas`` depends on the family;
    rows are told apart by frame, family and subject. Rows are written once; a round reads them beside what is chosen,
    and moves only those that may be offered.
    """
    steps = Steps(rows.sparkSession)
    held = steps(rows, "quota-rows")
    every = held.withColumn("_key", F.concat_ws("|", frame, family, "subject")).withColumn("_quota", quotas.cast("long"))
    chosen, taken, turn = None, 0, 0
    while True:
        turn += 1
        left, lack, room = every, F.col("_quota"), F.lit(per_frame)
        if chosen is not None:
            small = F.broadcast if taken <= BROADCAST_ROWS else (lambda df: df)
            of_family = small(chosen.groupBy(F.col(family).alias("_family")).agg(F.count("*").alias("_has")))
            of_frame = small(chosen.groupBy(F.col(frame).alias("_frame")).agg(F.count("*").alias("_held")))
            gone = small(chosen.select(F.col("_key").alias("_gone")))
            left = left.join(of_family, F.col(family).eqNullSafe(F.col("_family")), "left").join(of_frame, F.col(frame).eqNullSafe(F.col("_frame")), "left")
            lack, room = lack - F.coalesce("_has", F.lit(0)), room - F.coalesce("_held", F.lit(0))
            left = left.join(gone, F.col("_key") == F.col("_gone"), "left_anti")
        left = left.withColumn("_lack", lack).withColumn("_room", room).where("_lack > 0 and _room > 0").select(*rows.columns, "_key", "_lack", "_room")
        offers = hashed_places(left, [family], seeded(seed, F.col("_key")), "_rk", F.col("_lack"))
        order = F.row_number().over(W.partitionBy(frame).orderBy(seeded(seed + "f", F.col("_key"))))
        accepted = steps(offers.withColumn("_rk", order).where(F.col("_rk") <= F.col("_room")).select(*rows.columns, "_key"), f"quota-chosen-{turn}")
        new = accepted.count()
        if not new:
            break
        chosen, taken = accepted if chosen is None else chosen.unionByName(accepted), taken + new
    out = steps((held.limit(0) if chosen is None else chosen.select(*rows.columns)), "quota")
    steps.clear(keep=1)
    return out


def window_facts(events: DataFrame, keys: list[str], t: str, cls: str, span: int) -> DataFrame:
    """Tumbling windows of ``span``: classes with their first and last time, in the order of their first."""
    w = events.withColumn("win", F.floor(F.col(t) / F.lit(span)))
    per = w.groupBy(*keys, "win", cls).agg(F.min(t).alias("first_t"), F.max(t).alias("last_t"), F.count("*").alias("n"))
    order = F.array_sort(F.collect_list(F.struct("first_t", F.col(cls).alias("cls"), "last_t", "n")))
    return per.groupBy(*keys, "win").agg(order.alias("seen"), F.min("first_t").alias("t0"), F.max("last_t").alias("t1"))


def window_families(win: DataFrame, keys: list[str]) -> DataFrame:
    """One row per window and family that applies; a window is read once."""

    def row(family: str, answer: Column, when: Column | None = None) -> Column:
        own = F.struct(F.lit(family).alias("family"), answer.cast("string").alias("answer"))
        return own if when is None else F.when(when, own)

    names = F.transform("seen", lambda x: x["cls"])
    rows = F.array(
        row("classes_in_video", F.array_join(F.sort_array(names), ", ")),
        row("single_in_video", F.get(names, F.lit(0)), F.size("seen") == 1),
        row("class_count_video", F.size("seen")),
        *[row(f"nth_unique_{k}", F.get(names, F.lit(k - 1)), F.size("seen") >= k) for k in (1, 2, 3)],
        row("last_visible", F.array_max(F.transform("seen", lambda x: F.struct(x["last_t"].alias("t"), x["cls"].alias("c"))))["c"]),
        row("most_often", F.array_min(F.transform("seen", lambda x: F.struct((-x["n"]).alias("n"), x["cls"].alias("c"))))["c"]),
    )
    return win.select(*keys, "win", F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("_r")).select(*keys, "win", "_r.family", "_r.answer")


def boundary_safe(events: DataFrame, keys: list[str], t: str, cls: str, tolerance: int) -> DataFrame:
    """Last times of a class that are sure: the key's end is as near, or the next row behind lies within
    ``tolerance`` and lacks the class."""
    marks = events.groupBy(*keys, t).agg(F.collect_set(cls).alias("_c"))
    nxt = F.lead(t).over(W.partitionBy(*keys).orderBy(t))
    marks = marks.withColumn("_next", nxt).withColumn(cls, F.explode("_c"))
    last = marks.groupBy(*keys, cls).agg(F.max(F.struct(F.col(t).alias("t"), F.col("_next").alias("nxt"))).alias("x"))
    return last.select(*keys, cls, F.col("x.t").alias(t), (F.col("x.nxt").isNull() | (F.col("x.nxt") - F.col("x.t") <= tolerance)).alias("safe"))


def bin_plan(marks: DataFrame, keys: list[str], bin_: str, per_key: int) -> DataFrame:
    """Positive bins, and of the empty ones between a key's first and last as many, evenly spaced, at most ``per_key``."""
    pos = marks.select(*keys, bin_).distinct().withColumn("kind", F.lit("positive"))
    span = pos.groupBy(*keys).agg(F.min(bin_).alias("_a"), F.max(bin_).alias("_b"), F.count("*").alias("_n"))
    neg = span.select(*keys, "_n", F.explode(F.sequence("_a", "_b")).alias(bin_)).join(pos.select(*keys, bin_), [*keys, bin_], "left_anti")
    w = W.partitionBy(*keys)
    neg = neg.withColumn("_rn", F.row_number().over(w.orderBy(bin_)) - 1).withColumn("_m", F.count("*").over(w))
    cap = F.least(F.col("_n"), F.lit(per_key))
    step = F.greatest(F.lit(1), F.floor(F.col("_m") / cap))
    neg = neg.where((F.col("_rn") % step == 0) & (F.col("_rn") / step < cap)).select(*keys, bin_, F.lit("negative").alias("kind"))
    return pos.unionByName(neg)


def gated(rows: DataFrame, arms: DataFrame, notes: DataFrame, key: str, frame: str) -> DataFrame:
    """Attaches notes by gates in order: no arm, arm off, note missing, note empty, else attached."""
    out = rows.join(arms.select(key, "arm"), key, "left").join(notes.select(frame, "note"), frame, "left")
    status = F.when(F.col("arm").isNull(), "no_arm").when(F.col("arm") == "control", "control").when(F.col("note").isNull(), "missing").when(F.col("note") == "", "empty").otherwise("attached")
    return out.withColumn("status", status)
