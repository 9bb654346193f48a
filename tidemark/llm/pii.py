"""Operator 3, personal data by weak supervision, with DataFrame functions alone.

Base spans are patterns with their checks (email, ip, card, phone). In what they leave of a text, candidates
are drawn by wide patterns: number groups, long digit runs, account numbers, dates, e-mail addresses in
words, names behind a form of address. Six labelers vote on each candidate, yes, no or nothing: regular
expressions and check sums of its form, a second one of its make-up, a gazetteer, the words before it, the
words behind it, and other personal data near by. Each can say both yes and no.

Expectation-maximisation estimates, kind by kind, the share of true spans and each labeler's hit and
false-alarm rates from the votes alone; candidates of a kind with the same votes count as one pattern, at
most 3**6 of them, so the estimation of a kind runs on one bounded row. Its soft labels train the final
classifier, a log-odds model per kind of features that the labelers do not see alone (shape, lengths,
neighbours, words around); spans whose probability reaches ``least`` are added.

Nulls and the like: a null text is empty; repeated rows are scanned alike; without candidates nothing is
added; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import staged
from tidemark.llm.spans import SPAN, blanked, count_kind, gated, let, listed, matches, of_kind

EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
_OCTETS = r"^(0*(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(\.|$)){4}$"

#: Wide patterns of candidates: kind -> pattern.
WIDE = {
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "date": r"(?<![0-9./-])(?:[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{4}|[0-9]{4}[./-][0-9]{1,2}[./-][0-9]{1,2})(?![0-9./-]?[0-9])",
    "number": r"(?<![0-9A-Za-z+.])\(?[0-9]{2,5}\)?(?:[\x20./-][0-9]{2,5}){1,4}(?![0-9A-Za-z])",
    "digits": r"(?<![0-9A-Za-z+.,-])[0-9]{8,19}(?![0-9A-Za-z])",
    "address": r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{2,64}+\x20?(?:[\[({](?i:at)[\])}]|\x20(?i:at)\x20)\x20?[A-Za-z0-9-]{2,63}+\x20?(?:[\[({](?i:dot)[\])}]|\x20(?i:dot)\x20)\x20?[A-Za-z]{2,6}(?![A-Za-z0-9])",
    "name": r"(?=[DFHMPS])(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|M|Mme|Mlle|Madame|Monsieur|Sr|Sra|Don)\.?\x20[A-Z][a-z]{1,30}(?:\x20[A-Z][a-z]{1,30})?",
}
#: Quick tests that a text must pass to hold a match of a kind; a text without is not searched for it.
GATES = {"account": "[0-9]{2}", "date": "[0-9]{4}", "number": "[0-9]{2}", "digits": "[0-9]{8}", "address": r"(?i)[\[({\x20]dot[\])}\x20]", "name": r"[DFHMPS][A-Za-z]*+\.?\x20[A-Z]"}
#: What the gazetteer knows: given names, endings of hosts, countries of account numbers.
GIVEN = "james|mary|john|anna|peter|paul|laura|david|sarah|michael|thomas|robert|emma|william|linda|hans|klaus|petra|sabine|heike|jürgen|stefan|monika|andreas|birgit|jean|pierre|sophie|marie|luc|camille|julien|claire|michel|nathalie|juan|carlos|lucia|maria|jose|carmen|pablo|elena|miguel|isabel"
HOSTS = "com|org|net|edu|gov|info|de|fr|es|uk|it|nl|at|ch|be|eu"
COUNTRIES = "AT|BE|CH|CZ|DE|DK|ES|FI|FR|GB|HU|IE|IT|LU|NL|NO|PL|PT|SE"
#: Words that speak for and against personal data, in English, German, French and Spanish.
_FOR = "phone|tel|call|fax|mobile|cell|contact|mail|reach|ssn|account|iban|passport|name|dear|born|birth|dob|telefon|handy|anruf|konto|geboren|geburtsdatum|téléphone|portable|compte|née?|naissance|teléfono|móvil|cuenta|nacid[oa]|nacimiento"
_AGAINST = "order|invoice|version|isbn|issn|page|line|item|lot|part|section|figure|table|year|price|total|rechnung|bestellung|seite|artikel|preis|commande|facture|article|prix|pedido|factura|página|artículo|precio"
_YES_BEFORE = rf"(?i)(?<![\p{{L}}])(?:{_FOR})(?![\p{{L}}])[^\p{{L}}]{{0,6}}(?:\p{{L}}{{1,6}}[^\p{{L}}]{{1,3}}){{0,2}}$"
_NO_BEFORE = rf"(?i)(?<![\p{{L}}])(?:{_AGAINST})s?(?![\p{{L}}])[^\p{{L}}]{{0,6}}(?:\p{{L}}{{1,3}}[^\p{{L}}]{{1,3}})?$"
_YES_BEHIND = r"(?i)^[^\p{L}\n]{0,4}(?:phone|ext|fax|mobile|home|office|extension|privat|mobil|maison|bureau|casa|oficina)(?!\p{L})"
_NO_BEHIND = r"(?i)^[^\p{L}\n]{0,4}(?:km|kg|cm|mm|ml|usd|eur|euros?|percent|pages?|items|years|seiten|stück|jahre|ans|años|páginas)(?!\p{L})|^\s*[%$€]"
_NEAR = r"[A-Za-z0-9]@[A-Za-z0-9-]+\.|\+[0-9][0-9 ().-]{8}"
CONTEXT, AROUND = 32, 96


def base_spans(text: Column) -> Column:
    digits = lambda x: F.regexp_replace(x["m"], "[^0-9]", "")
    some = lambda mark, pattern: gated(text, F.contains(text, F.lit(mark)), pattern)
    ips = F.filter(some(".", IP), lambda x: F.rlike(x["m"], F.lit(_OCTETS)))
    cards = F.filter(gated(text, F.rlike(text, F.lit("[0-9]")), CARD), lambda x: let(digits(x), lambda d: F.when(F.length(d).between(14, 19), _luhn(d)).otherwise(False)))
    phones = F.filter(some("+", PHONE), lambda x: F.length(digits(x)).between(10, 15))
    return F.concat(of_kind(some("@", EMAIL), 0, "email"), of_kind(ips, 1, "ip"), of_kind(cards, 2, "card"), of_kind(phones, 3, "phone"))


def _vote(*rules: tuple[Column, int]) -> Column:
    out = F.lit(None).cast("int")
    for condition, value in reversed(rules):
        out = F.when(condition, value).otherwise(out)
    return out


def _remainder(m: Column) -> Column:
    """The check sum of an account number: letters count from 10, the first four characters go last; 1 if right."""
    bare = F.replace(m, F.lit(" "), F.lit(""))
    turned = F.filter(F.split(F.concat(F.substring(bare, F.lit(5), F.length(bare)), F.substring(bare, 1, 4)), ""), lambda c: c != "")

    def add(a: Column, c: Column) -> Column:
        v = F.when(F.rlike(c, F.lit("[0-9]")), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return (a * F.when(v > 9, 100).otherwise(10) + v) % 97

    return F.aggregate(turned, F.lit(0), add)


def _luhn(d: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""

    def add(a: Column, i: Column) -> Column:
        n = F.substring(d, -i, F.lit(1)).cast("int")
        twice = F.when(n > 4, 2 * n - 9).otherwise(2 * n)
        return a + F.when(i % 2 == 0, twice).otherwise(n)

    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add) % 10 == 0


def _form(kind: str, m: Column, n: Column) -> Column:
    like = lambda p: F.rlike(m, F.lit(p))
    if kind == "account":
        right = _remainder(m) == 1
        return _vote((right, 1), (~right, 0))
    if kind == "date":
        day = like(r"^(?:(?:0?[1-9]|[12][0-9]|3[01])[./-](?:0?[1-9]|1[0-2])[./-](?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}[./-](?:0?[1-9]|1[0-2])[./-](?:0?[1-9]|[12][0-9]|3[01]))$")
        return _vote((~day, 0), (like("19[0-9]{2}"), 1))
    if kind == "number":
        return _vote((like(r"^\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}$") | like(r"^0[0-9]{1,4}(?:[\x20./-][0-9]{2,5}){1,4}$"), 1), ((n < 7) | (n > 15), 0))
    if kind == "digits":
        right = _luhn(m)
        return _vote((right & (n >= 13), 1), (~right, 0))
    if kind == "address":
        return _vote((like(r"[\[({](?i:at)[\])}]"), 1), (like(r"\x20(?i:at)\x20.*\x20(?i:dot)\x20") & ~like("[0-9_.]"), 0))
    return _vote((like(r"\x20[A-Z][a-z]+\x20[A-Z]"), 1), (like(r"^(?:M|Don|Sr)\x20"), 0))


def _make_up(kind: str, m: Column, n: Column) -> Column:
    like = lambda p: F.rlike(m, F.lit(p))
    if kind == "account":
        return _vote((like(r"^[A-Z]{2}[0-9]{2}(?:\x20[A-Z0-9]{4})+"), 1), (~like(r"[0-9]{6}"), 0))
    if kind == "date":
        return _vote((like(r"(?:^|[./-])(?:19[3-9][0-9]|200[0-9])(?:[./-]|$)"), 1), (like(r"20[1-9][0-9]"), 0))
    if kind == "number":
        date = like(r"^(?:[0-9]{4}[./-][0-9]{2}[./-][0-9]{2}|[0-9]{2}[./-][0-9]{2}[./-](?:[0-9]{2}){1,2})$")
        return _vote((date, 0), (like(r"^[0-9]{1,3}(?:[\x20.][0-9]{3})+$"), 0), (like(r"^[0-9]{2,5}[\x20./-][0-9]{2,5}$"), 0), (like(r"^\(|^[^-]*-[^-]*-|^[^\x20]*\x20[^\x20]*\x20|^[^.]*\.[^.]*\."), 1))
    if kind == "digits":
        return _vote((like(r"([0-9])\1{4}") | like("0{4}$|^(?:19|20)[0-9]{2}(?:0[1-9]|1[0-2])"), 0), (like("^0"), 1))
    if kind == "address":
        return _vote((like(r"^(?i:the|and|look|was|is|be|of|in|it|but|or|not|all|that|this|here|there)\x20"), 0), (like(r"^[A-Za-z]+[._-]?[A-Za-z0-9]*[0-9._-]"), 1))
    return _vote((like(r"^(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Mlle)\.?\x20"), 1), (like(r"\x20[A-Z][a-z]$"), 0))


def _known(kind: str, m: Column, n: Column) -> Column:
    like = lambda p: F.rlike(m, F.lit(p))
    if kind == "account":
        return _vote((like(f"^(?:{COUNTRIES})"), 1), (~like(f"^(?:{COUNTRIES})"), 0))
    if kind == "address":
        return _vote((like(f"(?i)[^A-Za-z](?:{HOSTS})$"), 1), (~like(f"(?i)[^A-Za-z](?:{HOSTS})$"), 0))
    if kind == "name":
        return _vote((like(f"(?i)\\x20(?:{GIVEN})(?:\\x20|$)"), 1), (like(r"(?i)\x20(?:the|and|in|of|no|street|road|who|what|quijote)$"), 0))
    if kind == "number":
        return _vote((like(r"^\(?(?:800|888|877|555|0800|0900|0)"), 1), (like(r"^(?:19|20)[0-9]{2}[\x20./-]"), 0))
    return _vote((F.lit(False), 1))


def _votes(kind: str, m: Column, before: Column, behind: Column) -> Column:
    """The six labelers' votes, null for none: form, make-up, gazetteer, context before, context behind,
    personal data near by."""
    n = F.length(F.regexp_replace(m, "[^0-9]", ""))
    close_before, close_behind = F.right(before, F.lit(CONTEXT)), F.left(behind, F.lit(CONTEXT))
    near = F.rlike(before, F.lit(_NEAR)) | F.rlike(behind, F.lit(_NEAR))
    crowd = F.rlike(before, F.lit(r"[0-9][^A-Za-z]{1,3}[0-9]+[^A-Za-z]*$")) & F.rlike(behind, F.lit(r"^[^A-Za-z]*[0-9]"))
    return F.array(
        _form(kind, m, n),
        _make_up(kind, m, n),
        _known(kind, m, n),
        _vote((F.rlike(close_before, F.lit(_NO_BEFORE)), 0), (F.rlike(close_before, F.lit(_YES_BEFORE)), 1)),
        _vote((F.rlike(close_behind, F.lit(_NO_BEHIND)), 0), (F.rlike(close_behind, F.lit(_YES_BEHIND)), 1)),
        _vote((near, 1), (crowd, 0)),
    )


def _features(kind: str, m: Column, before: Column, behind: Column) -> Column:
    """Values of the classifier's features, each from a bounded set of the kind."""
    n = F.length(F.regexp_replace(m, "[^0-9]", ""))
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(m, "[0-9]+", "9"), "[A-Z][a-z]*", "A"), "[a-z]+", "a")
    side = lambda c: F.when(c == "", "none").when(F.rlike(c, F.lit(r"^\s")), "blank").when(F.rlike(c, F.lit(r"^[A-Za-z0-9]")), "word").otherwise("mark")
    word = lambda c: F.pmod(F.xxhash64(F.lower(c)), F.lit(64)).cast("string")
    own = lambda name, value: F.concat(F.lit(f"{kind}:{name}:"), value)
    return F.array(
        own("digits", F.least(n, F.lit(20)).cast("string")),
        own("shape", F.pmod(F.xxhash64(shape), F.lit(64)).cast("string")),
        own("left", side(F.reverse(before))),
        own("right", side(behind)),
        own("word", word(F.regexp_extract(F.right(before, F.lit(CONTEXT)), r"(\p{L}+)[^\p{L}]*$", 1))),
        own("next", word(F.regexp_extract(F.left(behind, F.lit(CONTEXT)), r"^[^\p{L}]*(\p{L}+)", 1))),
    )


def candidates(text: Column, base: Column) -> Column:
    """array<struct<s, e, kind, votes, features>> of the wide patterns' matches beside the base spans."""

    def judged(kind: str):
        def one(x: Column) -> Column:
            before = F.substring(text, F.greatest(x["s"] - AROUND, F.lit(0)) + 1, F.least(x["s"], F.lit(AROUND)))
            behind = F.substring(text, x["e"] + 1, F.lit(AROUND))
            votes = lambda c: _votes(kind, x["m"], c["b"], c["a"])
            features = lambda c: _features(kind, x["m"], c["b"], c["a"])
            whole = lambda c: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(kind).alias("kind"), votes(c).alias("votes"), features(c).alias("features"))
            return let(F.struct(before.alias("b"), behind.alias("a")), whole)

        return one

    # of candidates that overlap, the kind that is named first in WIDE counts
    own = lambda rest, kind: gated(rest, F.rlike(rest, F.lit(GATES[kind])), WIDE[kind])
    return let(blanked(text, base), lambda rest: F.concat(*[F.transform(own(rest, kind), judged(kind)) for kind in WIDE]))


def reliabilities(patterns: DataFrame, rounds: int = 25) -> DataFrame:
    """Expectation-maximisation over (kind, votes, n): adds ``p``, the probability of each pattern to be true,
    and ``fit``, the kind's rates.

    A kind has at most 3**6 patterns, whatever the input, so they fit one row.
    """
    one = patterns.groupBy("kind").agg(F.sort_array(F.collect_list(F.struct("votes", F.col("n").cast("double").alias("n")))).alias("p"))
    labelers = F.sequence(F.lit(0), F.lit(5))
    start = F.struct(F.lit(0.5).alias("share"), F.array_repeat(F.lit(0.7), 6).alias("hit"), F.array_repeat(F.lit(0.3), 6).alias("alarm"))

    def truth(s: Column, votes: Column) -> Column:
        def odds(a: Column, j: Column) -> Column:
            v, hit, alarm = F.get(votes, j), F.get(s["hit"], j), F.get(s["alarm"], j)
            return a + F.when(v == 1, F.log(hit / alarm)).when(v == 0, F.log((1 - hit) / (1 - alarm))).otherwise(0.0)

        return 1 / (1 + F.exp(-F.aggregate(labelers, F.log(s["share"] / (1 - s["share"])), odds)))

    def step(s: Column, _: Column) -> Column:
        soft = F.transform("p", lambda x: F.struct(x["votes"].alias("votes"), x["n"].alias("n"), truth(s, x["votes"]).alias("t")))

        def settled(w: Column) -> Column:
            def rate(j: Column, weight) -> Column:
                voted = F.aggregate(w, F.lit(2.0), lambda a, x: a + F.when(F.get(x["votes"], j).isNotNull(), weight(x)).otherwise(0.0))
                yes = F.aggregate(w, F.lit(1.0), lambda a, x: a + F.when(F.get(x["votes"], j) == 1, weight(x)).otherwise(0.0))
                return yes / voted

            hit = F.transform(labelers, lambda j: rate(j, lambda x: x["n"] * x["t"]))
            alarm = F.transform(labelers, lambda j: rate(j, lambda x: x["n"] * (1 - x["t"])))
            total = F.aggregate(w, F.lit(2.0), lambda a, x: a + x["n"])
            return F.struct((F.aggregate(w, F.lit(1.0), lambda a, x: a + x["n"] * x["t"]) / total).alias("share"), hit.alias("hit"), alarm.alias("alarm"))

        return let(soft, settled)

    fit = one.withColumn("fit", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step))
    return fit.select("kind", "fit", F.explode("p").alias("x")).select("kind", "x.votes", "x.n", truth(F.col("fit"), F.col("x.votes")).alias("p"), "fit")


def trained(found: DataFrame) -> dict[str, float]:
    """The classifier: the weights of feature values, from soft labels; ``<kind>:`` has the kind's prior log-odds.

    Feature values come from bounded sets (some 220 per kind), so the weights are a bounded table.
    """
    cands = found.select(F.explode("cands").alias("c")).select("c.kind", "c.votes", "c.features")
    counts = staged(cands.groupBy("kind", "votes", "features").agg(F.count("*").alias("n")), "pii-counts")
    patterns = staged(counts.groupBy("kind", "votes").agg(F.sum("n").alias("n")), "pii-votes")
    truths = staged(reliabilities(patterns).select("kind", "votes", "p"), "pii-truths")
    key = lambda c: F.array_join(c.cast("array<string>"), ",", "-").alias("k")
    soft = counts.select("kind", key(F.col("votes")), "features", "n").join(F.broadcast(truths.select("kind", key(F.col("votes")), "p")), ["kind", "k"])  # at most 3**6 rows a kind
    values = F.explode(F.concat("features", F.array(F.concat("kind", F.lit(":")))))
    rows = soft.select(values.alias("value"), "n", "p").groupBy("value").agg(F.sum(F.col("n") * F.col("p")).alias("yes"), F.sum(F.col("n") * (1 - F.col("p"))).alias("no"))
    table = {r["value"]: (r["yes"], r["no"]) for r in rows.collect()}
    sums = {kind: table.get(f"{kind}:", (0.0, 0.0)) for kind in WIDE}
    out = {}
    for value, (y, n) in sorted(table.items()):
        yes, no = sums[value.split(":")[0]]
        out[value] = math.log((yes + 1) / (no + 1)) if value.endswith(":") else math.log((y + 1) / (yes + 2)) - math.log((n + 1) / (no + 2))
    return out


def found(docs: DataFrame, least: float = 0.9) -> DataFrame:
    """doc_id, base spans and all spans."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("base", base_spans(F.col("text")))
    rows = staged(rows.select("doc_id", "base", candidates(F.col("text"), F.col("base")).alias("cands")), "pii-found")
    weights = trained(rows.where(F.size("cands") > 0))
    if not weights:
        return rows.select("doc_id", "base", F.col("base").alias("spans"))
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    weigh = lambda v: F.coalesce(F.try_element_at(table, v), F.lit(0.0))
    score = lambda c: F.aggregate(c["features"], weigh(F.concat(c["kind"], F.lit(":"))), lambda a, f: a + weigh(f))
    taken = F.filter("cands", lambda c: score(c) >= math.log(least / (1 - least)))
    # of spans that overlap, the one of the kind named first stays
    apart = lambda a, c: ~F.exists(a, lambda t: (t["s"] < c["e"]) & (c["s"] < t["e"]))
    bare = F.transform(taken, lambda c: F.struct(c["s"].alias("s"), F.lit(4).alias("o"), c["e"].alias("e"), c["kind"].alias("kind"))).cast(SPAN)
    added = let(bare, lambda b: F.aggregate(b, F.array().cast(SPAN), lambda a, c: F.when(apart(a, c), F.concat(a, F.array(c))).otherwise(a)))
    return rows.select("doc_id", "base", F.concat("base", added).alias("spans"))


def report(docs: DataFrame, **options) -> DataFrame:
    base = F.col("base")
    return found(docs, **options).select(
        "doc_id", *[count_kind(base, k).alias(f"n_{k}") for k in KINDS], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans")
    )
