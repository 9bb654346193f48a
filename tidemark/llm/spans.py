"""Spans of regular expressions in whole texts, as Column expressions; positions are code points."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

FOUND = "array<struct<s:int,e:int,m:string>>"
SPAN = "array<struct<s:int,o:int,e:int,kind:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def matches(text: Column, regex: str) -> Column:
    """All matches, leftmost and not overlapping: (s, e, m), the end exclusive.

    The text between the matches has one part more than there are matches; adding up lengths gives the
    positions. ``regex`` must not match the empty string.
    """

    def placed(found: Column) -> Column:
        between = F.split(text, regex)
        pairs = let(between, lambda b: F.transform(found, lambda m, i: F.struct(m.alias("m"), F.length(F.get(b, i)).alias("gap"))))
        start = F.struct(F.lit(0).alias("pos"), F.array().cast(FOUND).alias("out"))

        def step(a: Column, x: Column) -> Column:
            s, e = a["pos"] + x["gap"], a["pos"] + x["gap"] + F.length(x["m"])
            return F.struct(e.alias("pos"), F.concat(a["out"], F.array(F.struct(s.alias("s"), e.alias("e"), x["m"].alias("m")))).alias("out"))

        return F.aggregate(pairs, start, step, lambda a: a["out"])

    return let(F.regexp_extract_all(text, F.lit(regex), F.lit(0)), lambda f: F.when(F.size(f) > 0, placed(f)).otherwise(F.array().cast(FOUND)))


def gated(text: Column, gate: Column, regex: str) -> Column:
    """``matches`` of texts that pass a quick test which every match implies; none of others."""
    return F.when(gate, matches(text, regex)).otherwise(F.array().cast(FOUND))


def of_kind(found: Column, order: int, kind: str) -> Column:
    """Matches as spans (s, o, e, kind); ``order`` ranks kinds that start together."""
    return F.transform(found, lambda x: F.struct(x["s"].alias("s"), F.lit(order).alias("o"), x["e"].alias("e"), F.lit(kind).alias("kind"))).cast(SPAN)


def listed(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind, joined by commas."""
    return F.array_join(F.transform(F.sort_array(spans), lambda x: F.concat(x["kind"], F.lit(":"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string"))), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def apart_from(found: Column, taken: Column) -> Column:
    """The matches that overlap none of the spans ``taken``."""
    return F.filter(found, lambda x: ~F.exists(taken, lambda t: (t["s"] < x["e"]) & (x["s"] < t["e"])))


def blanked(text: Column, spans: Column) -> Column:
    """The text with a space in place of every character of a span; positions stay."""
    return replaced(text, spans, lambda x, start: F.repeat(F.lit(" "), x["e"] - start), True)


def replaced(text: Column, spans: Column, mark: Callable[[Column, Column], Column], again: bool = False) -> Column:
    """The text with every span replaced by ``mark`` of the span and its first character not yet replaced.

    Of overlapping spans the first one counts, and the part of a later one that reaches beyond it goes with
    it, under a mark of its own if ``again``.
    """
    start = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))

    def step(a: Column, x: Column) -> Column:
        new = F.concat(a["out"], F.substring(text, a["pos"] + 1, x["s"] - a["pos"]), mark(x, x["s"]))
        over = F.when(x["e"] > a["pos"], F.concat(a["out"], mark(x, a["pos"]))).otherwise(a["out"]) if again else a["out"]
        return F.when(x["s"] >= a["pos"], F.struct(x["e"].alias("pos"), new.alias("out"))).otherwise(F.struct(F.greatest(a["pos"], x["e"]).alias("pos"), over.alias("out")))

    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(F.sort_array(spans), start, step, lambda a: F.concat(a["out"], F.substring(text, a["pos"] + 1, F.length(text)))))
