"""Operator 7, secret scans by sliding-window entropy, with DataFrame functions alone.

Base kinds are patterns: assign, access and hex. Beside them, every run of ``SHORTEST`` or more token
characters is a candidate; base spans are blanked first, so what a run has beside one is scanned too. A
window of ``window`` characters slides over it. Two counts change by one as a character enters and another
leaves, and so does the sum of count * log2(count), kept as an integer, so a step costs the same whatever
the window and the run. Windows whose Shannon entropy reaches the limit of the candidate's character class
are hits; hits that overlap or touch make one span. A run shorter than the window is one window of its own
length; it must hold both cases and a digit, and its limit falls with the logarithm of its length.

Candidates that as a whole look like a number, a UUID, a host or a path of words add nothing, and neither
do spans with a long repeat or a placeholder's word set off by separators. All patterns use possessive
repeats or single character classes, so none recurs with the length of a run.

Nulls and the like: a null text is empty; repeated rows are scanned alike; an empty table gives an empty
result. A run of any length is linear work; other columns are left out of the report and kept by
``redacted``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.spans import SPAN, blanked, count_kind, let, listed, matches, of_kind, replaced

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]++"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
KINDS = ("assign", "access", "hex")

#: Least length of a candidate.
SHORTEST = 16
RUN = r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_=.-]{%d,}+" % SHORTEST
#: Character classes in the order they are tried: pattern of the whole candidate, least entropy in bits of a
#: window of 20. Words and names of one case need nearly as many characters as places.
CLASSES = (("^[0-9a-fA-F]++$", 3.0), ("^(?:[A-Z]?[a-z/_=.-]++|[A-Z/_=.-]++)$", 4.0), ("^(?:[0-9a-z]++|[0-9A-Z]++)$", 3.5), ("", 3.9))
VARIED = r"^(?=[^0-9]*+[0-9])(?=[^a-z]*+[a-z])(?=[^A-Z]*+[A-Z])"
#: Candidates that match one of these are no secrets.
ALLOWED = (
    r"^[0-9+/_=.-]++$",  # numbers, dates, addresses
    r"(?i)^[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}$",  # UUIDs
    # hosts and their paths: labels up to the first that is a known ending
    r"(?i)^[a-z0-9-]++(?:\.(?!(?:com|org|net|edu|gov|io|de|fr|es|uk)(?:[./]|$))[a-z0-9-]++)*+\.(?:com|org|net|edu|gov|io|de|fr|es|uk)(?:[./].*+)?$",
    r"(?i)^(?:[a-z]++[0-9]{0,4}+[._/=-]++)++[a-z]*+[0-9]{0,4}+$",  # paths and names of words with short numbers
)
#: Spans that hold one of these are no secrets.
ALLOWED_PARTS = (r"(?i)(?<![a-z0-9])(?:example|sample|dummy|placeholder|changeme|lorem)(?![a-z0-9])", r"(.)\1{7}")
#: Code points "+" to "z", of which candidates consist.
_FIRST, _N = 43, 80
#: Sums of count * log2(count) are integers of so many to the bit.
_UNIT = 1 << 32


def weight(count: int) -> int:
    return round(count * math.log2(count) * _UNIT) if count > 1 else 0


def most_weight(size: int, bits: float, window: int) -> int:
    """The largest sum of weights of a window of ``size`` characters whose entropy reaches the limit, which
    is ``bits`` for ``window`` characters."""
    return math.floor((math.log2(size) - bits * math.log2(size) / math.log2(window)) * size * _UNIT + 0.5)


def limit_of(candidate: Column, window: int, bits: float) -> Column:
    """``most_weight`` of the candidate's windows."""
    by_size = F.array(*[F.lit(most_weight(w, bits, window) if w > 1 else -1) for w in range(1, window + 1)])
    return F.element_at(by_size, F.least(F.length(candidate), F.lit(window)))


def entropy_ranges(candidate: Column, window: int, most: Column) -> Column:
    """array<struct<s, e>>: windows of a sum of at most ``most``, joined where they overlap or touch.

    The counts are a string of one character per code point, "A" for none, so that reading or changing
    one is a single step of built-in string code.
    """
    codes = F.transform(F.filter(F.split(candidate, ""), lambda c: c != ""), lambda c: F.ascii(c) - _FIRST)
    steps = F.array(*[F.lit(weight(c + 1) - weight(c)) for c in range(window + 1)])  # from c to c + 1
    size = F.least(F.length(candidate), F.lit(window))
    zero = F.struct(F.lit("A" * _N).alias("counts"), F.lit(0).cast("long").alias("sum"), F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int>>").alias("out"))

    def folded(x: Column) -> Column:
        own, width, limit = x["own"], x["size"], x["most"]
        count = lambda a, code: F.ascii(F.substring(a["counts"], code + 1, F.lit(1))) - 65
        put = lambda text, code, n: F.overlay(text, F.chr(n + 65), code + 1, F.lit(1))

        def joined(a: Column) -> Column:
            """The ranges with the window that ends before ``at``, if it is a hit."""
            start, last = a["at"] - width, F.get(a["out"], F.size(a["out"]) - 1)
            hit = (start >= 0) & (a["sum"] <= limit)
            longer = F.concat(F.slice(a["out"], F.lit(1), F.greatest(F.size(a["out"]) - 1, F.lit(0))), F.array(F.struct(last["s"].alias("s"), a["at"].alias("e"))))
            more = F.concat(a["out"], F.array(F.struct(start.alias("s"), a["at"].alias("e"))))
            return F.when(~hit, a["out"]).when(F.coalesce(last["e"] >= start, F.lit(False)), longer).otherwise(more)

        def step(a: Column, code: Column) -> Column:
            gone = F.when(a["at"] >= width, F.get(own, a["at"] - width))
            entered = lambda counts, n: put(counts, code, n + 1)

            def moved(leaves: Column) -> Column:
                less = F.coalesce(F.get(steps, leaves - 1), F.lit(0))
                counts = F.when(leaves.isNotNull(), put(a["counts"], gone, leaves - 1)).otherwise(a["counts"])
                before = count(a, code)
                return F.struct(entered(counts, before).alias("counts"), (a["sum"] - less + F.get(steps, before)).alias("sum"))

            still = F.struct(a["counts"].alias("counts"), a["sum"].alias("sum"))
            new = F.when(gone == code, still).otherwise(let(count(a, gone), moved))
            return let(new, lambda n: F.struct(n["counts"].alias("counts"), n["sum"].alias("sum"), (a["at"] + 1).alias("at"), joined(a).alias("out")))

        return F.aggregate(own, zero, step, joined)

    return let(F.struct(codes.alias("own"), size.alias("size"), most.alias("most")), folded)


def base_spans(text: Column) -> Column:
    assign = F.filter(matches(text, ASSIGN), lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 2)) >= 6)
    access = F.filter(matches(text, ACCESS), lambda x: F.length(x["m"]) >= 20)
    return F.concat(of_kind(assign, 0, "assign"), of_kind(access, 1, "access"), of_kind(matches(text, HEX), 2, "hex"))


def entropy_spans(text: Column, base: Column, window: int = 20, allowed: tuple[str, ...] = ALLOWED, parts: tuple[str, ...] = ALLOWED_PARTS) -> Column:
    """Spans of high entropy in what the base spans leave of the text."""
    holds = lambda m, patterns: F.coalesce(*[F.when(F.rlike(m, F.lit(p)), True) for p in patterns], F.lit(False))

    def ranged(x: Column) -> Column:
        fine = (F.length(x["m"]) >= window) | F.rlike(x["m"], F.lit(VARIED))
        most = F.coalesce(*[F.when(F.rlike(x["m"], F.lit(pattern)), limit_of(x["m"], window, bits)) for pattern, bits in CLASSES])
        found = F.when(fine & ~holds(x["m"], allowed), entropy_ranges(x["m"], window, most)).otherwise(F.array().cast("array<struct<s:int,e:int>>"))
        found = F.filter(found, lambda r: ~holds(F.substring(x["m"], r["s"] + 1, r["e"] - r["s"]), parts))
        return F.transform(found, lambda r: F.struct((x["s"] + r["s"]).alias("s"), F.lit(3).alias("o"), (x["s"] + r["e"]).alias("e"), F.lit("entropy").alias("kind")))

    return F.flatten(F.transform(matches(blanked(text, base), RUN), ranged)).cast(SPAN)


def scanned(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, base and all spans, and the columns ``keep``."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *keep)
    rows = rows.withColumn("base", base_spans(F.col("text")))
    return rows.withColumn("spans", F.concat("base", entropy_spans(F.col("text"), F.col("base"))))


def report(docs: DataFrame) -> DataFrame:
    base = F.col("base")
    return scanned(docs).select(
        "doc_id", *[count_kind(base, k).alias(f"n_{k}") for k in KINDS], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans")
    )


def redacted(docs: DataFrame) -> DataFrame:
    """The documents, every secret in ``text`` replaced by its kind in brackets; a null text stays null."""
    rows = scanned(docs.select(F.struct("*").alias("__row"), "doc_id", "text"), ("__row",))
    clean = F.when(F.col("__row.text").isNotNull(), replaced(F.col("text"), F.col("spans"), lambda x, _: F.concat(F.lit("["), x["kind"], F.lit("]"))))
    return rows.select(*[clean.alias(c) if c == "text" else F.col(f"__row.`{c}`") for c in docs.columns])
