"""Operator 9, quality rules with risk-controlled thresholds, with DataFrame functions alone.

Base figures come from one pass over the whole texts. Every rule is a score of them, high for bad
documents. Labelled documents are dealt by a hash of their id into two halves. One proposes, per stratum
and rule, the score quantile that takes most bad documents for the good ones it costs (``good_weight``);
rules without gain propose nothing. The other half is the holdout: a cutoff stands if the exact binomial
bound says so, that is if, were the true rate of false rejection above the rule's part of ``risk``, the
chance to see as few rejected good documents among the holdout's would be at most ``delta`` divided by the
number of (stratum, rule) families. Within a family the cutoffs are tested in a fixed sequence from the
most lenient down to the proposal, and the first that falls ends it, so the division by families is all
the correction that the many tests need: with a chance of 1 - ``delta`` all chosen cutoffs hold at once,
and no stratum loses more than ``risk`` of its good documents to all rules together. Too small a holdout
chooses nothing.

Strata are languages (a null language is one). Nulls and the like: a null text has no words and fails the
base rule; a null score is never rejected; labels with a null doc_id or quality are left out, and a
doc_id with several labels is good if any says so; without labels nothing is rejected beyond the base
rule; repeated rows are judged alike; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE, join_small, staged

SYMBOLS = "#*$%&|<>"
#: Rules: name -> score of the base figures, high for bad documents.
RULES = {
    "symbols": "n_symbols / word_chars",
    "shouting": "n_upper / word_chars",
    "punctuation": "n_punct / n_words",
    "repeats": "n_repeat_words / n_words",
    "dup_lines": "n_dup_lines / n_lines",
    "digits": "n_digits / word_chars",
}


def _count(text: Column, characters: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def repeat_words(words: Column, size: int = 8) -> Column:
    """Words that lie in a window of ``size`` words found twice or more in the text.

    Windows are compared as 64-bit hashes. Only texts that have fewer distinct windows than windows are
    sorted: equal windows become neighbours, their places are put in order, and each covers ``size``
    words or as many as there are to the next.
    """
    hashed = F.transform(words, lambda w: F.xxhash64(w))

    def counted(h: Column) -> Column:
        wins = F.transform(F.sequence(F.lit(0), F.greatest(F.size(h) - size, F.lit(0))), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(size)]))

        def covered(w: Column) -> Column:
            order = lambda x: F.array_sort(F.transform(x, lambda v, i: F.struct(v.alias("v"), i.alias("i"))))
            twice = lambda s: F.filter(s, lambda x, j: (F.get(s, j - 1)["v"] == x["v"]) | F.coalesce(F.get(s, j + 1)["v"] == x["v"], F.lit(False)))
            places = F.transform(F.array(order(w)), lambda s: F.sort_array(F.transform(twice(s), lambda x: x["i"])))[0]
            return F.transform(F.array(places), lambda p: F.aggregate(p, F.struct(F.lit(0).alias("n"), F.lit(-size).alias("at")), lambda a, i: F.struct((a["n"] + F.least(F.lit(size), i - a["at"])).alias("n"), i.alias("at")), lambda a: a["n"]))[0]

        return F.transform(F.array(wins), lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), covered(w)).otherwise(0))[0]

    return F.when(F.size(words) > size, F.transform(F.array(hashed), counted)[0]).otherwise(0).cast("long")


def figures(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang and the base figures of each row, and the columns ``keep``."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), text.alias("text"), *keep)
    blanks = " \t\n\x0b\x0c\r"
    trimmed = F.btrim("text", F.lit(blanks))
    rows = rows.withColumn("words", F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE)))
    filled = F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, blanks, "")) > 0)
    return rows.select(
        "doc_id",
        "lang",
        *keep,
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", blanks, "")).cast("long").alias("word_chars"),
        _count(F.col("text"), SYMBOLS).alias("n_symbols"),
        F.transform(F.array(filled), lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))[0].alias("lines"),
        repeat_words(F.col("words")).alias("n_repeat_words"),
        _count(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_upper"),
        _count(F.col("text"), "0123456789").alias("n_digits"),
        _count(F.col("text"), "!?.,;:").alias("n_punct"),
    ).select("*", F.col("lines.n").cast("long").alias("n_lines"), F.col("lines.dup").cast("long").alias("n_dup_lines")).drop("lines")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def binomial_tail(k: Column, n: Column, rate: Column) -> Column:
    """P(X <= k) for X binomial (n, rate), exactly, as a sum of terms kept relative to the largest."""
    odds = rate / (1 - rate)
    start = n * F.log1p(-rate)
    total = F.aggregate(
        F.sequence(F.lit(1), F.greatest(k, F.lit(1)).cast("int")),
        F.struct(start.alias("term"), F.lit(1.0).alias("sum"), start.alias("top")),
        lambda s, j: F.aggregate(
            F.array(s["term"] + F.log(F.greatest(n - j + 1, F.lit(0)) * odds / j)),
            s,
            lambda u, term: F.when(j > k, u).otherwise(
                F.struct(term.alias("term"), (u["sum"] * F.exp(u["top"] - F.greatest(u["top"], term)) + F.exp(term - F.greatest(u["top"], term))).alias("sum"), F.greatest(u["top"], term).alias("top"))
            ),
        ),
        lambda s: s["top"] + F.log(s["sum"]),
    )
    return F.least(F.exp(total), F.lit(1.0))


def scores(figs: DataFrame) -> DataFrame:
    """One row per document and rule: doc_id, lang, rule, score."""
    rules = F.array(*[F.struct(F.lit(name).alias("rule"), F.expr(sql).cast("double").alias("score")) for name, sql in RULES.items()])
    return figs.where("n_words > 0").select("doc_id", "lang", F.explode(rules).alias("r")).select("doc_id", "lang", "r.rule", "r.score")


def thresholds(
    figs: DataFrame, labels: DataFrame, risk: float = 0.05, delta: float = 0.05, good_weight: float = 10.0, cutoffs: int = 24, seed: int = 5
) -> DataFrame:
    """Chosen cutoffs: lang, rule, cutoff, n_good, n_rejected, bound_p. Rows at or above a cutoff go."""
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.max("quality") > 0).alias("good"))
    # of rows that repeat a labelled id, the one of the least figures, however they lie
    rows = figs.where(~base_failed()).join(marks.select("doc_id"), "doc_id", "left_semi")
    least = rows.groupBy("doc_id").agg(F.min(F.struct(*[c for c in rows.columns if c != "doc_id"])).alias("f")).select("doc_id", "f.*")
    known = scores(least).join(marks, "doc_id").where("score is not null")
    known = staged(known.withColumn("holdout", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(2)) == 1), "quality-known")
    steps = [1 - 0.5 ** (1 + i * 0.5) for i in range(cutoffs)]
    grid = known.where("not holdout").groupBy("lang", "rule").agg(F.sort_array(F.array_distinct(F.percentile("score", F.array(*map(F.lit, steps))))).alias("cuts"))
    tried = join_small(known, grid, ["lang", "rule"]).select("lang", "rule", "good", "holdout", "score", F.explode("cuts").alias("cutoff"))
    hit, half = F.col("score") >= F.col("cutoff"), F.col("holdout")
    tried = tried.groupBy("lang", "rule", "cutoff").agg(
        F.count_if(half & F.col("good")).alias("n_good"),
        F.count_if(half & F.col("good") & hit).alias("n_rejected"),
        (F.count_if(~half & ~F.col("good") & hit) / F.greatest(F.count_if(~half & ~F.col("good")), F.lit(1))).alias("bad_share"),
        (F.count_if(~half & F.col("good") & hit) / F.greatest(F.count_if(~half & F.col("good")), F.lit(1))).alias("good_share"),
    )
    # proposal: the cutoff that takes most bad documents for the good ones it costs
    family = W.partitionBy("lang", "rule")
    tried = tried.withColumn("gain", F.col("bad_share") - F.lit(good_weight) * F.col("good_share"))
    best = F.max(F.struct("gain", "cutoff")).over(family)
    tried = staged(tried.withColumn("best", best).where("best.gain > 0 and cutoff >= best.cutoff"), "quality-tried")
    sizes = tried.groupBy("lang").agg(F.count_distinct("rule").alias("n_rules"))
    tests = tried.select("lang", "rule").distinct().count() or 1
    tried = join_small(tried, sizes, ["lang"])
    tried = tried.withColumn("bound_p", binomial_tail(F.col("n_rejected"), F.col("n_good"), F.lit(risk) / F.col("n_rules")))
    # fixed sequence from the highest cutoff down to the proposal: one stands if all above it do
    stands = F.max(F.col("bound_p") > F.lit(delta / tests)).over(family.orderBy(F.col("cutoff").desc()))
    rank = F.row_number().over(family.orderBy("cutoff"))
    chosen = tried.withColumn("broken", stands).where("not broken").withColumn("rank", rank).where("rank = 1")
    return chosen.select("lang", "rule", "cutoff", "n_good", "n_rejected", "bound_p")


def judge(figs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The figures with base_failed and kept."""
    per_lang = chosen.groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cuts"))
    rows = join_small(figs, per_lang, ["lang"], "left")
    rejected = F.lit(False)
    for name, sql in RULES.items():
        score = F.when(F.col("n_words") > 0, F.expr(sql).cast("double"))
        rejected = rejected | F.coalesce(score >= F.col("cuts")[name], F.lit(False))
    return rows.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~rejected)


def fitted(docs: DataFrame, labels: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """The staged figures of all documents, and the thresholds that hold on them."""
    figs = staged(figures(docs), "quality-figures")
    return figs, staged(thresholds(figs, labels, **options), "quality-chosen")


def report(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    rows = judge(*fitted(docs, labels, **options))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that no rule rejects, with all their columns.

    The figures of each row are made a second time beside the row itself, so that rows are judged by
    their own text without a key, and no text is shuffled or written in between.
    """
    _, chosen = fitted(docs, labels, **options)
    rows = docs.select(F.struct("*").alias("__row"), "doc_id", "lang", "text")
    return judge(figures(rows, ("__row",)), chosen).where("kept").select("__row.*")
