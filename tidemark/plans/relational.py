"""Filters, joins, sets, aggregates, splits, mixing, scoring and serving over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import stats
from tidemark.functions.text import coin, seeded
from tidemark.operators import aggregates as A
from tidemark.operators import mixing as G
from tidemark.operators.ranks import quantiles
from tidemark.operators import relational as R
from tidemark.operators import serving as V
from tidemark.operators import splits as D
from tidemark.plans.base import EV, events, table


def _docs(s, d):
    return table(s, d, "documents").select("doc_id", "lang", "source", "n_chars")


def _hash(seed, key):
    return F.conv(F.substring(seeded(seed, F.col(key)), 1, 7), 16, 10).cast("long")


_H = "cast('0x' || substr(md5('{s}:' || {k}), 1, 7) as bigint)"


def _h(seed, key):
    return _H.format(s=seed, k=key)


# --- filters


def flt_fold_part(s, d):
    rows = _docs(s, d).withColumn("fold", F.pmod("doc_id", F.lit(5)))
    return R.part(rows, 2, "train").groupBy("lang").agg(F.count("*").alias("n"))


def flt_semi(s, d):
    return table(s, d, "orders").join(table(s, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi").select("o_orderkey")


def flt_anti(s, d):
    return table(s, d, "customer").join(table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


def flt_strided_shard(s, d):
    return R.strided_shard(_docs(s, d), [F.col("doc_id")], 7, 3, bucket=F.col("source")).select("doc_id")


def flt_having(s, d):
    return table(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).where("n = 10")


def flt_applicable(s, d):
    c = events(s, d).groupBy("user_id", "hr").agg(F.count("*").alias("n"), F.count_distinct("cls").alias("k"))
    return c.select("user_id", "hr", (F.col("n") == 1).alias("single"), (F.col("n") >= 2).alias("same_class"), (F.col("k") >= 2).alias("co_occur"), (F.col("n") <= 8).alias("positions"))


# --- joins


def rel_compare(s, d):
    lab = table(s, d, "labels")
    a, b = lab.select("doc_id", F.col("quality").alias("a")), lab.select("doc_id", F.col("toxic").alias("b"))
    return a.join(b, "doc_id").select("doc_id", (F.col("a") != F.col("b")).alias("changed"))


def rel_left_two_keys(s, d):
    li = table(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))
    right = table(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.col("o_orderpriority").alias("prio"))
    return li.join(right, ["l_orderkey", "l_linenumber"], "left").groupBy(F.coalesce("prio", F.lit("none")).alias("prio")).agg(F.sum("n").alias("n"))


def rel_inherit(s, d):
    o, c, n = table(s, d, "orders"), table(s, d, "customer"), table(s, d, "nation")
    return o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).groupBy("n_name").agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("customers"))


def rel_group_join(s, d):
    li = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_linenumber")).alias("l"))
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    return o.join(li, "l_orderkey", "left").select("l_orderkey", F.coalesce(F.array_join(F.col("l").cast("array<string>"), ","), F.lit("")).alias("lines"))


def rel_splice(s, d):
    part_ = table(s, d, "labels").select("doc_id", F.lit("label").alias("origin"))
    return R.spliced(part_, _docs(s, d).select("doc_id", F.lit("control").alias("origin")), "doc_id")


def rel_hybrid(s, d):
    other = table(s, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "good").alias("lang"))
    return R.overwritten(_docs(s, d), other, "doc_id", "lang", F.col("lang").isin("en", "de")).select("doc_id", "lang")


def rel_common_index(s, d):
    lab, doc = table(s, d, "labels"), _docs(s, d)
    return doc.join(lab, "doc_id").groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg("quality"), 6).alias("quality"))


def rel_priority_pick(s, d):
    pick = F.when(F.lower("p_type").contains("steel"), 1).when(F.lower("p_type").contains("brass"), 2).otherwise(3)
    return table(s, d, "part").groupBy(pick.alias("model")).agg(F.count("*").alias("n"))


def rel_missing_reference(s, d):
    return table(s, d, "lineitem").select(F.col("l_partkey").alias("p_partkey")).distinct().join(table(s, d, "part"), "p_partkey", "left_anti").agg(F.count("*").alias("n"))


def rel_round_robin(s, d):
    return R.round_robin(_docs(s, d), "source", [F.col("doc_id")], 45).select("doc_id", "source", F.col("rk").cast("long").alias("rk"))


def rel_one_per_group(s, d):
    return R.first_rows(table(s, d, "orders"), ["o_custkey"], [F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


def rel_dedupe_keep_first(s, d):
    rows = table(s, d, "documents").select("doc_id", F.md5("text").alias("k"))
    return R.first_rows(rows, ["k"], [F.col("doc_id")]).select("doc_id")


def rel_unique_ids(s, d):
    return R.unique_ids(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), "l_partkey", [F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_suppkey")]).groupBy("dup").agg(F.count("*").alias("n"))


def rel_length_grouped(s, d):
    return R.length_grouped(_docs(s, d), "n_chars", "doc_id", 8, "len").select("doc_id", "grp", F.col("pos").cast("long").alias("pos"))


def rel_full_outer_validate(s, d):
    wanted = table(s, d, "customer").select(F.col("c_custkey").alias("k"))
    given = table(s, d, "orders").where("o_orderstatus = 'F'").select((F.col("o_custkey") + 3).alias("k"), F.when(F.col("o_orderpriority") == "5-LOW", "").otherwise(F.col("o_orderpriority")).alias("content"))
    return R.reconciled(wanted, given, "k", "content")


def rel_last_wins(s, d):
    return R.last_wins(_docs(s, d).select("source", "doc_id", "lang"), "source", "doc_id")


def rel_fingerprints(s, d):
    return R.fingerprints(table(s, d, "documents"), "doc_id", F.md5("text")).select("doc_id", "alias_of")


def rel_top_k(s, d):
    return table(s, d, "lineitem").orderBy(F.col("l_extendedprice").desc(), "l_orderkey", "l_linenumber", "l_partkey").limit(20).select("l_orderkey", "l_linenumber", "l_extendedprice")


# --- sets


def set_union_by_name(s, d):
    a = table(s, d, "supplier").select(F.col("s_name").alias("name"), "s_acctbal")
    b = table(s, d, "customer").select(F.col("c_name").alias("name"), "c_mktsegment")
    u = G.union_all([(a, 1.0), (b, 0.5)])
    return u.groupBy(F.coalesce("c_mktsegment", F.lit("none")).alias("seg")).agg(F.count("*").alias("n"), F.sum("weight").alias("w"))


def set_grid_difference(s, d):
    seen = events(s, d).groupBy("user_id").agg(F.collect_set(F.pmod("hr", F.lit(24))).alias("h"))
    return seen.select("user_id", F.array_join(F.array_sort(F.array_except(F.sequence(F.lit(0), F.lit(23)).cast("array<bigint>"), "h")).cast("array<string>"), ",").alias("free"))


def set_equality(s, d):
    c = events(s, d).withColumn("half", F.pmod("event_id", F.lit(2))).groupBy("user_id").agg(F.sort_array(F.collect_set(F.when(F.col("half") == 0, F.col("cls")))).alias("a"), F.sort_array(F.collect_set(F.when(F.col("half") == 1, F.col("cls")))).alias("b"))
    return c.select("user_id", (F.col("a") == F.col("b")).alias("same"), F.array_join(F.array_except("a", "b"), ",").alias("only_a"))


def set_complement_in_order(s, d):
    order = ("view", "click", "signup", "purchase", "error")
    c = events(s, d).groupBy("user_id", "hr").agg(F.collect_set("cls").alias("seen"))
    return c.select("user_id", "hr", F.array_join(F.array_except(F.array(*map(F.lit, order)), "seen"), ",").alias("missing"))


def set_key_intersection(s, d):
    a = table(s, d, "orders").where("o_orderstatus = 'O'").select("o_custkey")
    b = table(s, d, "orders").where("o_orderstatus = 'F'").select("o_custkey")
    return a.intersect(b)


# --- aggregates


def agg_count_vectors(s, d):
    return A.count_vectors(table(s, d, "orders"), ["o_custkey"], ["o_orderstatus", "o_orderpriority"])


def agg_share_range(s, d):
    rows = table(s, d, "orders").withColumn("fold", F.pmod("o_custkey", F.lit(5)))
    return A.share_range(A.count_vectors(rows, ["fold"], ["o_orderstatus", "o_orderpriority"]), "fold").withColumn("spread", F.round("spread", 9))


def agg_conditional_sums(s, d):
    v = F.col("value")
    return events(s, d).groupBy("user_id").agg(F.count_if(v > 50).alias("n_pos"), F.count_if(v <= 50).alias("n_neg"), F.count_if(v.isNull()).alias("n_null"))


def agg_mode_first_seen(s, d):
    return A.first_seen_mode(_docs(s, d), ["source"], "lang", "doc_id")


def agg_macro_mean(s, d):
    o, c = table(s, d, "orders"), table(s, d, "customer")
    rows = o.join(c, o.o_custkey == c.c_custkey).select("c_mktsegment", "o_orderpriority", (F.col("o_orderstatus") == "F").cast("int").alias("ok"))
    out = A.macro_mean(rows, ["c_mktsegment"], "o_orderpriority", "ok")
    return out.select("c_mktsegment", F.round("macro", 9).alias("macro"), F.round("micro", 9).alias("micro"), "n_buckets")


def agg_grouping_report(s, d):
    t = table(s, d, "lineitem").groupingSets([[], [F.col("l_returnflag")], [F.col("l_linestatus")], [F.col("l_returnflag"), F.col("l_linestatus")]], F.col("l_returnflag"), F.col("l_linestatus"))
    return t.agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))


def agg_crosstab(s, d):
    return table(s, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0).select("o_orderpriority", F.col("F").alias("n_f"), F.col("O").alias("n_o"), F.col("P").alias("n_p"))


def agg_quantiles(s, d):
    rows = table(s, d, "lineitem")
    q = quantiles(rows, ["l_returnflag"], "l_extendedprice", [0.25, 0.5, 0.75, 0.9, 0.99], "q")
    t = q.join(rows.groupBy("l_returnflag").agg(F.stddev_pop("l_quantity").alias("sd")), "l_returnflag")
    return t.select("l_returnflag", *[F.round(F.col("q")[i], 4).alias(n) for i, n in enumerate(("p25", "p50", "p75", "p90", "p99"))], F.round("sd", 6).alias("sd"))


def agg_corr(s, d):
    return table(s, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 8).alias("r"))


def agg_bias(s, d):
    e = events(s, d).where("value is not null").select(F.floor(F.col("value") / 10).alias("gt"), F.pmod("event_id", F.lit(10)).alias("pred"))
    return e.groupBy("gt").agg(F.count("*").alias("n"), F.round(F.avg(F.col("pred") - F.col("gt")), 9).alias("bias"))


def agg_shard_merge(s, d):
    sh = table(s, d, "lineitem").groupBy("l_returnflag", "l_suppkey").agg(F.avg("l_quantity").alias("m"), F.count("*").alias("n"))
    return G.weighted_mean(sh, ["l_returnflag"], "m", "n").select("l_returnflag", F.round("mean", 9).alias("mean"), F.round("most", 9).alias("most"))


def _guessed(s, d):
    e = events(s, d)
    return e.withColumn("guess", F.when(_hash("g", "event_id") % 10 < 7, F.col("cls")).otherwise("view"))


def agg_confusion_prf(s, d):
    out = A.class_scores(_guessed(s, d), "cls", "guess")
    return out.select("cls", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1", "jaccard")])


def agg_auc_rank(s, d):
    e = events(s, d).where("value is not null")
    return A.rank_auc(e, "value", F.col("cls") == "purchase", "event_id").select(F.round("auc", 9).alias("auc"), "pos", "neg")


def agg_micro_iou(s, d):
    g = _guessed(s, d)
    a, b = F.col("cls") == "view", F.col("guess") == "view"
    return g.agg(F.round(F.count_if(a & b) / F.greatest(F.count_if(a | b), F.lit(1)), 9).alias("iou"))


def agg_false_positive_rate(s, d):
    g = _guessed(s, d)
    neg = F.col("cls") != "view"
    return g.agg(F.round(F.count_if(neg & (F.col("guess") == "view")) / F.greatest(F.count_if(neg), F.lit(1)), 9).alias("fp_rate"), F.round(F.count_if(~neg & (F.col("guess") == "view")) / F.greatest(F.count_if(~neg), F.lit(1)), 9).alias("hit_rate"))


def agg_rare_bins(s, d):
    return events(s, d).groupBy("cls").agg(F.count_distinct("user_id", "hr").alias("bins")).withColumn("rare", F.col("bins") < 150)


def agg_over_limit(s, d):
    return table(s, d, "orders").groupBy("o_orderstatus").agg(F.round(F.avg("o_totalprice"), 4).alias("mean"), F.max("o_totalprice").alias("most"), F.count_if(F.col("o_totalprice") > 200000).alias("over"))


def agg_reachability(s, d):
    dur = F.pmod("o_orderkey", F.lit(1000))
    rows = table(s, d, "orders").select("o_orderpriority", F.explode(F.array(*map(F.lit, (16, 32, 64, 128)))).alias("n"), dur.alias("dur"))
    return rows.groupBy("o_orderpriority", "n").agg(F.round(F.avg((F.col("dur") / F.col("n") > 5).cast("int")), 9).alias("rate"))


def agg_agreement(s, d):
    return _guessed(s, d).groupBy("cls").agg(F.round(F.avg((F.col("cls") == F.col("guess")).cast("int")), 9).alias("rate"), F.count("*").alias("n"))


def agg_histogram(s, d):
    return table(s, d, "part").groupBy("p_size").agg(F.count("*").alias("n"), F.count_distinct("p_brand").alias("brands"))


# --- splits


def sp_group_folds(s, d):
    return D.round_robin_folds(table(s, d, "customer").select("c_custkey", "c_mktsegment"), ["c_mktsegment"], "c_custkey", 5, "fold").select("c_custkey", "fold")


def sp_leak_check(s, d):
    f = sp_group_folds(s, d)
    o = table(s, d, "orders").withColumnRenamed("o_custkey", "c_custkey").join(f, "c_custkey")
    return D.leaks(o, "c_custkey").agg(F.count("*").alias("n"))


def sp_lopo(s, d):
    return D.held_out(_docs(s, d), "source", F.lit("src3")).groupBy("part", "lang").agg(F.count("*").alias("n"))


def sp_nested_prefix(s, d):
    return D.seeded_rank(_docs(s, d), ["lang"], "doc_id", "7").where("order < 40").select("doc_id", F.col("order").cast("long").alias("rank"))


def sp_dup_units(s, d):
    u = D.duplicate_units(table(s, d, "documents"), "doc_id", F.md5("text"))
    return u.groupBy("unit").agg(F.count("*").alias("members"))


def sp_stratified_greedy(s, d):
    c = A.count_vectors(table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")), ["c_nationkey"], ["o_orderpriority", "c_mktsegment"])
    return D.stratified_greedy(c.select(F.col("c_nationkey").alias("unit"), F.concat_ws("=", "family", "value").alias("value"), "n"), 5, 8)


def sp_rare_rebalance(s, d):
    u = table(s, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    return D.rare_rebalanced(u, 5, "n", "c_nationkey").select("c_nationkey", F.col("fold").cast("long").alias("fold"))


# --- mixing


def mix_caps(s, d):
    return G.capped(_docs(s, d), "source", "doc_id", F.when(F.col("source") == "src1", 5).when(F.col("source") == "src2", 12), "cap").select("doc_id")


def mix_format_ratio(s, d):
    return G.ratio_mix(_docs(s, d), "lang", "doc_id", {"en": 0.5, "de": 0.25, "fr": 0.1}, "mix").groupBy("lang").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


def mix_prop_head(s, d):
    return G.proportional_head(_docs(s, d), "source", "doc_id", 200, "head").select("doc_id")


def mix_dropout(s, d):
    return _docs(s, d).where(~coin("out", F.col("doc_id"), 0.25)).select("doc_id")


def mix_seeded_union(s, d):
    a = table(s, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("k"))
    b = table(s, d, "customer").select((F.col("c_custkey") + 10**9).alias("k"))
    rows = G.union_all([(a, 1.0), (b, 2.0)]).withColumn("bucket", F.pmod(_hash("shuffle", "k"), F.lit(16)))
    return D.seeded_rank(rows, ["bucket"], "k", "shuffle", "pos").select("k", "bucket", F.col("pos").cast("long").alias("pos"), "weight")


def mix_expected_counts(s, d):
    rules = {"no_source": F.col("source").isNull(), "short": F.col("n_chars") < 10, "long": F.col("n_chars") > 20000, "bad_lang": ~F.col("lang").isin("en", "de", "fr", "es")}
    return A.violations(_docs(s, d), rules)


# --- scoring


def _scored(s, d):
    lab = table(s, d, "labels")
    return lab.join(_docs(s, d), "doc_id").select("doc_id", "lang", "source", F.col("quality").alias("a"), F.when(F.col("toxic") == 1, 0).otherwise(F.col("quality")).alias("b"))


def sc_mcnemar_block(s, d):
    t = _scored(s, d).rollup("lang").agg(
        F.count("*").alias("n"), F.round(F.avg("a"), 9).alias("mean_a"), F.round(F.avg("b"), 9).alias("mean_b"),
        F.count_if((F.col("a") == 0) & (F.col("b") == 1)).alias("improved"), F.count_if((F.col("a") == 1) & (F.col("b") == 0)).alias("worsened"),
    )
    p = stats.mcnemar(F.col("improved"), F.col("worsened"))
    return t.select(F.coalesce("lang", F.lit("ALL")).alias("lang"), "n", "mean_a", "mean_b", "improved", "worsened", F.round(p, 8).alias("p"), stats.stars(p).alias("stars"))


def sc_edit_score(s, d):
    e = events(s, d).withColumn("c", F.substring("cls", 1, 1))
    w = W.partitionBy("user_id").orderBy("event_id")
    seg = e.withColumn("prev", F.lag("c").over(w)).where("prev is null or prev <> c")
    t = seg.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "c"))), lambda x: x["c"]).alias("s"))
    return t.select("user_id", F.round(stats.edit_score(F.col("s"), F.reverse("s")), 9).alias("score"))


def sc_set_diff_classes(s, d):
    g = _guessed(s, d).groupBy("user_id", "hr").agg(F.collect_set("cls").alias("t"), F.collect_set("guess").alias("g"))
    return A.set_differences(g, F.col("t"), F.col("g"))


def sc_prior_baseline(s, d):
    rows = _scored(s, d)
    prior = A.first_seen_mode(rows, ["source"], "a", "doc_id").select("source", F.col("a").alias("prior"))
    return rows.join(prior, "source", "left").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("prior") == F.col("a")).alias("right"))


def sc_time_match(s, d):
    """Hours of two classes, sorted: right if as many and each pair lies within the tolerance."""
    e = events(s, d).groupBy("user_id").agg(F.array_sort(F.collect_list(F.when(F.col("cls") == "signup", F.col("hr")))).alias("gt"), F.array_sort(F.collect_list(F.when(F.col("cls") == "purchase", F.col("hr")))).alias("pr"))
    near = F.forall(F.zip_with("gt", "pr", lambda a, b: F.coalesce(F.abs(a - b) <= 48, F.lit(False))), lambda x: x)
    return e.select("user_id", ((F.size("gt") == F.size("pr")) & near).alias("ok"), F.size("gt").cast("long").alias("n"))


def sc_format_scores(s, d):
    """Right or wrong by the rule of the answer's format; formats that need a judge get null."""
    form = F.element_at(F.array(*map(F.lit, ("number", "list", "text", "judged"))), (F.pmod("event_id", F.lit(4)) + 1).cast("int"))
    g = _guessed(s, d).withColumn("form", form)
    num = F.pmod("event_id", F.lit(10)) == F.pmod(F.floor(F.coalesce("value", F.lit(0.0))), F.lit(10))
    ok = F.when(F.col("form") == "number", num).when(F.col("form").isin("list", "text"), F.lower("guess") == F.lower("cls"))
    return g.groupBy("form").agg(F.count(ok).alias("n"), F.count_if(ok).alias("right"))


def sc_strata_arms(s, d):
    """Three arms against a control in one pass, by stratum."""
    x = _scored(s, d).withColumn("c", F.pmod(_hash("arm", "doc_id"), F.lit(2)).cast("int"))
    arms = F.explode(F.array(F.struct(F.lit("b").alias("arm"), F.col("b").alias("v")), F.struct(F.lit("c").alias("arm"), F.col("c").alias("v"))))
    y = x.select("lang", "a", arms.alias("x")).groupBy("lang", "x.arm").agg(F.count("*").alias("n"), F.round(F.avg(F.col("x.v") - F.col("a")), 9).alias("delta"))
    return y.withColumn("gate", F.signum("delta").cast("long"))


def sc_changed(s, d):
    c = events(s, d).withColumn("h", F.pmod("event_id", F.lit(2))).groupBy("user_id", "h").agg(F.sort_array(F.collect_list("cls")).alias("l"))
    a, b = c.where("h = 0").select("user_id", F.col("l").alias("a")), c.where("h = 1").select("user_id", F.col("l").alias("b"))
    return a.join(b, "user_id").groupBy((F.col("a") == F.col("b")).alias("same")).agg(F.count("*").alias("n"))


def sc_what_if(s, d):
    e = events(s, d).groupBy("user_id").agg(F.array_sort(F.collect_list("hr")).alias("h"))
    n = F.size("h")
    mid = F.floor((F.element_at("h", 1) + F.element_at("h", -1)) / 2)
    return e.select("user_id", F.element_at("h", 1).alias("first"), F.element_at("h", -1).alias("last"), F.element_at("h", F.floor((n + 1) / 2).cast("int")).alias("median"), mid.alias("mid"))


def sc_error_buckets(s, d):
    g = _guessed(s, d).join(events(s, d).groupBy("user_id").agg((F.max("hr") - F.min("hr")).alias("len")), "user_id")
    b = F.when(F.col("len") < 600, "short").when(F.col("len") < 660, "middle").otherwise("long")
    return g.groupBy(b.alias("bucket")).agg(F.count("*").alias("n"), F.count_if(F.col("cls") != F.col("guess")).alias("wrong"))


def sc_contamination(s, d):
    """Documents that hold any eight words in a row of a benchmark item, or a shorter item as a whole.

    Windows meet as 64-bit hashes; the words behind equal hashes are then compared.
    """
    words = F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")
    window = lambda i: F.slice("w", i, F.least(F.size("w"), F.lit(8)))
    item = table(s, d, "benchmark").select(words.alias("w"))
    item = item.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 7, F.lit(1))), window)).alias("k")).distinct()
    item = item.select(F.xxhash64("k").alias("h"), F.col("k").alias("item"), F.size("k").alias("len"))
    docs = table(s, d, "documents").select("doc_id", words.alias("w"))
    sizes = [r[0] for r in item.select("len").distinct().collect()]  # of 1 to 8
    hit = None
    for n in sizes:
        windows = F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda i: F.xxhash64(F.slice("w", i, n)))  # noqa: B023
        own = docs.where(F.size("w") >= n).select("doc_id", F.explode(windows).alias("h"))
        found = own.join(item.where(F.col("len") == n).select("h").distinct(), "h", "left_semi").select("doc_id", "h").distinct()
        # few documents are left; their words are compared
        there = found.join(item.where(F.col("len") == n), "h").join(docs, "doc_id")
        there = there.where(F.contains(F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" ")), F.concat(F.lit(" "), F.array_join("item", " "), F.lit(" ")))).select("doc_id")
        hit = there if hit is None else hit.unionByName(there)
    rows = _docs(s, d)
    hits = hit.distinct().withColumn("hit", F.lit(1)) if hit is not None else rows.select("doc_id", F.lit(1).alias("hit")).where("false")
    return rows.join(hits, "doc_id", "left").groupBy("source").agg(F.count("*").alias("n"), F.count("hit").alias("hits"))


# --- serving


def _members(s, d):
    g = events(s, d)
    return g.select(F.pmod("event_id", F.lit(500)).alias("q"), F.col("cls").alias("answer"), F.col("event_id").alias("member"))


def srv_vote_majority(s, d):
    q = table(s, d, "part").select((F.col("p_partkey") % 510).alias("q")).distinct()
    return V.majority(_members(s, d), q, "q", "answer", "member")


def srv_conf_select(s, d):
    e = events(s, d)
    return e.select("event_id", V.challenger(F.lit("frame"), F.col("value"), F.lit("video"), F.pmod("event_id", F.lit(100)).cast("double")).alias("pick"))


def srv_route_default(s, d):
    routes = _docs(s, d).where("n_chars > 4000").groupBy("source").agg(F.concat(F.lit("long_"), F.min("lang")).alias("route")).where("route <> 'long_de'")
    return V.routed(_docs(s, d), routes, "source", "OBJECT_RECOGNITION").groupBy("route").agg(F.count("*").alias("n"))


def srv_total_output(s, d):
    given = table(s, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "yes").alias("content"))
    return R.total_output(_docs(s, d), given, "doc_id", "content")


def srv_budget_tiers(s, d):
    o = table(s, d, "orders")
    t = V.budget_tiers(o, ["o_custkey"], [F.col("o_orderkey")], F.pmod("o_orderkey", F.lit(17)), 60, [(40, "full"), (20, "half"), (0, "fast"), (-(10**9), "empty")])
    return t.select("o_orderkey", "left", "tier")


def srv_frame_ladder(s, d):
    k = F.pmod("o_orderkey", F.lit(40)).cast("double")
    top = F.when(F.col("o_orderstatus") == "F", 32).otherwise(64)
    return table(s, d, "orders").select("o_orderkey", V.ladder(k, {8: 2.0, 16: 5.0, 32: 12.0, 64: 30.0}, top).cast("long").alias("frames"))


def srv_salvage(s, d):
    final = F.when(F.pmod("o_orderkey", F.lit(3)) == 0, "").otherwise(F.col("o_orderstatus"))
    partial = F.when(F.pmod("o_orderkey", F.lit(2)) == 0, F.col("o_orderpriority"))
    return table(s, d, "orders").select("o_orderkey", V.salvaged(final, partial).alias("answer"))


def srv_specialist(s, d):
    e = events(s, d).select("user_id", "hr", "cls", "event_id")
    h = F.pmod(_hash("sp", "event_id"), F.lit(3))
    return V.specialist_merge(e.where(h > 0), e.where(h == 0), ["user_id", "hr"], "cls", ["error", "signup"]).groupBy("cls").agg(F.count("*").alias("n"))


def srv_hi_lo(s, d):
    return events(s, d).groupBy(F.coalesce(V.hi_lo(F.col("value"), 60, 30), F.lit("none")).alias("band")).agg(F.count("*").alias("n"))


def srv_needed_models(s, d):
    t = table(s, d, "conversations")
    return t.select("conv_id", "turn", *V.needed_models(F.col("text"), {"phase": r"(?i)phase|the", "detector": r"(?i)clip|and", "time": r"[0-9]"}))


SC = "sc as (select doc_id, lang, source, quality as a, case when toxic = 1 then 0 else quality end as b from labels join documents using (doc_id))"
GU = EV + f", gu as (select *, case when {_h('g', 'event_id')} % 10 < 7 then cls else 'view' end as guess from ev)"
QUERIES = {
    "flt_fold_part": (flt_fold_part, "select lang, count(*) as n from documents where doc_id % 5 <> 2 group by 1"),
    "flt_semi": (flt_semi, "select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')"),
    "flt_anti": (flt_anti, "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey)"),
    "flt_strided_shard": (flt_strided_shard, "select doc_id from (select doc_id, row_number() over (partition by source order by doc_id) - 1 as r from documents) where r % 7 = 3"),
    "flt_having": (flt_having, "select o_custkey, count(*) as n from orders group by 1 having count(*) = 10"),
    "flt_applicable": (flt_applicable, "with " + EV + ", c as (select user_id, hr, count(*) as n, count(distinct cls) as k from ev group by 1, 2) select user_id, hr, n = 1 as single, n >= 2 as same_class, k >= 2 as co_occur, n <= 8 as positions from c"),
    "rel_compare": (rel_compare, "select a.doc_id, a.quality <> b.toxic as changed from labels a join labels b using (doc_id)"),
    "rel_left_two_keys": (rel_left_two_keys, "with l as (select l_orderkey, l_linenumber, count(*) as n from lineitem group by 1, 2) select coalesce(o_orderpriority, 'none') as prio, cast(sum(n) as bigint) as n from l left join orders on o_orderkey = l_orderkey and l_linenumber = 1 group by 1"),
    "rel_inherit": (rel_inherit, "select n_name, count(*) as n, count(distinct o_custkey) as customers from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1"),
    "rel_group_join": (rel_group_join, "select o_orderkey as l_orderkey, coalesce(string_agg(l_linenumber, ',' order by l_linenumber), '') as lines from orders left join lineitem on l_orderkey = o_orderkey group by 1"),
    "rel_splice": (rel_splice, "select doc_id, 'label' as origin from labels union all select doc_id, 'control' from documents where doc_id not in (select doc_id from labels)"),
    "rel_hybrid": (rel_hybrid, "select d.doc_id, case when lang in ('en', 'de') and quality = 1 then 'good' else lang end as lang from documents d left join labels l using (doc_id)"),
    "rel_common_index": (rel_common_index, "select source, count(*) as n, round(avg(quality), 6) as quality from documents join labels using (doc_id) group by 1"),
    "rel_priority_pick": (rel_priority_pick, "select case when contains(lower(p_type), 'steel') then 1 when contains(lower(p_type), 'brass') then 2 else 3 end as model, count(*) as n from part group by 1"),
    "rel_missing_reference": (rel_missing_reference, "select count(distinct l_partkey) as n from lineitem where l_partkey not in (select p_partkey from part)"),
    "rel_round_robin": (rel_round_robin, "with r as (select doc_id, source, row_number() over (partition by source order by doc_id) as rk from documents) select * from r order by rk, source limit 45"),
    "rel_one_per_group": (rel_one_per_group, "select o_custkey, min(o_orderkey) as o_orderkey from orders group by 1"),
    "rel_dedupe_keep_first": (rel_dedupe_keep_first, "select min(doc_id) as doc_id from documents group by text"),
    "rel_unique_ids": (rel_unique_ids, "with r as (select row_number() over (partition by l_partkey order by l_orderkey, l_linenumber, l_suppkey) - 1 as dup from lineitem) select dup, count(*) as n from r group by 1"),
    "rel_length_grouped": (rel_length_grouped, f"with g as (select doc_id, n_chars, {_h('len', 'doc_id')} % 8 as grp from documents) select doc_id, grp, row_number() over (partition by grp order by n_chars desc, doc_id) as pos from g"),
    "rel_full_outer_validate": (
        rel_full_outer_validate,
        "with g as (select o_custkey + 3 as k, count(*) as n, count(*) filter (where o_orderpriority = '5-LOW') as e from orders where o_orderstatus = 'F' group by 1), b as (select c_custkey as w, g.k, n, e from customer full join g on c_custkey = g.k) select count(*) filter (where n is null) as missing, count(*) filter (where w is null) as extra, count(*) filter (where n > 1) as duplicates, cast(coalesce(sum(e), 0) as bigint) as empties from b",
    ),
    "rel_last_wins": (rel_last_wins, "select source, max(doc_id) as doc_id, arg_max(lang, doc_id) as lang from documents group by 1"),
    "rel_fingerprints": (rel_fingerprints, "with m as (select doc_id, min(doc_id) over (partition by md5(text)) as f from documents) select doc_id, case when f <> doc_id then f end as alias_of from m"),
    "rel_top_k": (rel_top_k, "select l_orderkey, l_linenumber, l_extendedprice from lineitem order by l_extendedprice desc, l_orderkey, l_linenumber, l_partkey limit 20"),
    "set_union_by_name": (set_union_by_name, "with u as (select s_name as name, null as seg, 1.0::double as w from supplier union all select c_name, c_mktsegment, 0.5::double from customer) select coalesce(seg, 'none') as seg, count(*) as n, sum(w) as w from u group by 1"),
    "set_grid_difference": (set_grid_difference, "with " + EV + ", g as (select user_id, unnest(range(24)) as h from (select distinct user_id from ev)), f as (select * from g where not exists (select 1 from ev where ev.user_id = g.user_id and ev.hr % 24 = g.h)) select u.user_id, coalesce(string_agg(h, ',' order by h), '') as free from (select distinct user_id from ev) u left join f using (user_id) group by 1"),
    "set_equality": (set_equality, "with " + EV + ", c as (select user_id, coalesce(list_sort(list_distinct(list(cls) filter (where event_id % 2 = 0))), []) as a, coalesce(list_sort(list_distinct(list(cls) filter (where event_id % 2 = 1))), []) as b from ev group by 1) select user_id, a = b as same, array_to_string(list_filter(a, lambda x: not list_contains(b, x)), ',') as only_a from c"),
    "set_complement_in_order": (set_complement_in_order, "with " + EV + ", c as (select user_id, hr, list(cls) as l from ev group by 1, 2) select user_id, hr, array_to_string(list_filter(['view', 'click', 'signup', 'purchase', 'error'], lambda x: not list_contains(l, x)), ',') as missing from c"),
    "set_key_intersection": (set_key_intersection, "select o_custkey from orders where o_orderstatus = 'O' intersect select o_custkey from orders where o_orderstatus = 'F'"),
    "agg_count_vectors": (agg_count_vectors, "select o_custkey, 'o_orderstatus' as family, o_orderstatus as value, count(*) as n from orders group by 1, 3 union all select o_custkey, 'o_orderpriority', o_orderpriority, count(*) from orders group by 1, 3"),
    "agg_share_range": (
        agg_share_range,
        "with c as (select o_custkey % 5 as fold, 'o_orderstatus' as family, o_orderstatus as value, count(*) as n from orders group by 1, 3 union all select o_custkey % 5, 'o_orderpriority', o_orderpriority, count(*) from orders group by 1, 3), s as (select *, n / sum(n) over (partition by fold, family) as share from c) "
        "select family, value, round(max(share) - case when count(*) < 5 then 0 else min(share) end, 9) as spread from s group by 1, 2",
    ),
    "agg_conditional_sums": (agg_conditional_sums, "with " + EV + " select user_id, count(*) filter (where value > 50) as n_pos, count(*) filter (where value <= 50) as n_neg, count(*) filter (where value is null) as n_null from ev group by 1"),
    "agg_mode_first_seen": (agg_mode_first_seen, "with c as (select source, lang, count(*) as n, min(doc_id) as f from documents group by 1, 2), k as (select *, row_number() over (partition by source order by n desc, f) as k from c) select source, lang, n from k where k = 1"),
    "agg_macro_mean": (agg_macro_mean, "with r as (select c_mktsegment, o_orderpriority, cast(o_orderstatus = 'F' as integer) as ok from orders join customer on o_custkey = c_custkey), m as (select c_mktsegment, o_orderpriority, avg(ok) as m, sum(ok) as s, count(*) as n from r group by 1, 2) select c_mktsegment, round(avg(m), 9) as macro, round(sum(s) / sum(n), 9) as micro, count(*) as n_buckets from m group by 1"),
    "agg_grouping_report": (agg_grouping_report, "select l_returnflag, l_linestatus, count(*) as n, sum(l_quantity) as q from lineitem group by grouping sets ((), (l_returnflag), (l_linestatus), (l_returnflag, l_linestatus))"),
    "agg_crosstab": (agg_crosstab, "select o_orderpriority, count(*) filter (where o_orderstatus = 'F') as n_f, count(*) filter (where o_orderstatus = 'O') as n_o, count(*) filter (where o_orderstatus = 'P') as n_p from orders group by 1"),
    "agg_quantiles": (agg_quantiles, "with q as (select l_returnflag, quantile_cont(l_extendedprice, [0.25, 0.5, 0.75, 0.9, 0.99]) as q, stddev_pop(l_quantity) as sd from lineitem group by 1) select l_returnflag, round(q[1], 4) as p25, round(q[2], 4) as p50, round(q[3], 4) as p75, round(q[4], 4) as p90, round(q[5], 4) as p99, round(sd, 6) as sd from q"),
    "agg_corr": (agg_corr, "select l_returnflag, round(corr(l_quantity, l_extendedprice), 8) as r from lineitem group by 1"),
    "agg_bias": (agg_bias, "with " + EV + " select cast(floor(value / 10) as bigint) as gt, count(*) as n, round(avg(event_id % 10 - floor(value / 10)), 9) as bias from ev where value is not null group by 1"),
    "agg_shard_merge": (agg_shard_merge, "with s as (select l_returnflag, l_suppkey, avg(l_quantity) as m, count(*) as n from lineitem group by 1, 2) select l_returnflag, round(sum(m * n) / sum(n), 9) as mean, round(max(m), 9) as most from s group by 1"),
    "agg_confusion_prf": (
        agg_confusion_prf,
        "with " + GU + ", c as (select cls, 1 as t, cast(cls = guess as integer) as h, 0 as g from gu union all select guess, 0, 0, 1 from gu), s as (select cls, sum(t) as t, sum(h) as h, sum(g) as g from c group by 1) select cls, round(h / greatest(g, 1), 9) as precision, round(h / greatest(t, 1), 9) as recall, round(2 * h / greatest(t + g, 1), 9) as f1, round(h / greatest(t + g - h, 1), 9) as jaccard from s",
    ),
    "agg_auc_rank": (agg_auc_rank, "with " + EV + ", r as (select row_number() over (order by value, event_id) as r, cast(cls = 'purchase' as integer) as p from ev where value is not null), s as (select sum(r * p) as r, cast(sum(p) as bigint) as pos, cast(count(*) - sum(p) as bigint) as neg from r) select round((r - pos * (pos + 1) / 2) / (pos * neg), 9) as auc, pos, neg from s"),
    "agg_micro_iou": (agg_micro_iou, "with " + GU + " select round(count(*) filter (where cls = 'view' and guess = 'view') / greatest(count(*) filter (where cls = 'view' or guess = 'view'), 1), 9) as iou from gu"),
    "agg_false_positive_rate": (agg_false_positive_rate, "with " + GU + " select round(count(*) filter (where cls <> 'view' and guess = 'view') / greatest(count(*) filter (where cls <> 'view'), 1), 9) as fp_rate, round(count(*) filter (where cls = 'view' and guess = 'view') / greatest(count(*) filter (where cls = 'view'), 1), 9) as hit_rate from gu"),
    "agg_rare_bins": (agg_rare_bins, "with " + EV + ", b as (select distinct cls, user_id, hr from ev) select cls, count(*) as bins, count(*) < 150 as rare from b group by 1"),
    "agg_over_limit": (agg_over_limit, "select o_orderstatus, round(avg(o_totalprice), 4) as mean, max(o_totalprice) as most, count(*) filter (where o_totalprice > 200000) as over from orders group by 1"),
    "agg_reachability": (agg_reachability, "with r as (select o_orderpriority, unnest([16, 32, 64, 128]) as n, o_orderkey % 1000 as dur from orders) select o_orderpriority, n, round(avg(cast(dur / n > 5 as integer)), 9) as rate from r group by 1, 2"),
    "agg_agreement": (agg_agreement, "with " + GU + " select cls, round(avg(cast(cls = guess as integer)), 9) as rate, count(*) as n from gu group by 1"),
    "agg_histogram": (agg_histogram, "select p_size, count(*) as n, count(distinct p_brand) as brands from part group by 1"),
    "sp_group_folds": (sp_group_folds, "select c_custkey, (row_number() over (partition by c_mktsegment order by md5('fold:' || c_custkey)) - 1) % 5 as fold from customer"),
    "sp_leak_check": (sp_leak_check, "with f as (select c_custkey, (row_number() over (partition by c_mktsegment order by md5('fold:' || c_custkey)) - 1) % 5 as fold from customer), l as (select o_custkey from orders join f on o_custkey = c_custkey group by 1 having count(distinct fold) > 1) select count(*) as n from l"),
    "sp_lopo": (sp_lopo, "select case when source = 'src3' then 'test' else 'train' end as part, lang, count(*) as n from documents group by 1, 2"),
    "sp_nested_prefix": (sp_nested_prefix, "select doc_id, r as rank from (select doc_id, row_number() over (partition by lang order by md5('7:' || doc_id)) - 1 as r from documents) where r < 40"),
    "sp_dup_units": (sp_dup_units, "select min(doc_id) as unit, count(*) as members from documents group by md5(text)"),
    "sp_stratified_greedy": (sp_stratified_greedy, None),
    "sp_rare_rebalance": (sp_rare_rebalance, "with u as (select c_nationkey, row_number() over (order by count(*) desc, c_nationkey) - 1 as r from customer group by 1) select c_nationkey, case when (r // 5) % 2 = 0 then r % 5 else 4 - r % 5 end as fold from u"),
    "mix_caps": (mix_caps, "with r as (select doc_id, source, row_number() over (partition by source order by md5('cap:' || doc_id)) as k from documents) select doc_id from r where k <= case source when 'src1' then 5 when 'src2' then 12 else 1000000000 end"),
    "mix_format_ratio": (
        mix_format_ratio,
        "with c as (select lang, count(*) as n, case lang when 'en' then 0.5::double when 'de' then 0.25::double when 'fr' then 0.1::double end as ratio from documents group by 1), k as (select min(n / ratio) as cap from c), l as (select lang, round_even(cap * ratio, 0) as lim from c, k), "
        "r as (select lang, doc_id, row_number() over (partition by lang order by md5('mix:' || doc_id)) as rk from documents) select r.lang, count(*) as n, cast(sum(doc_id) as bigint) as ids from r join l on r.lang = l.lang where lim is null or rk <= lim group by 1",
    ),
    "mix_prop_head": (mix_prop_head, "with s as (select source, greatest(1, floor(200 * count(*) / (select count(*) from documents))) as take from documents group by 1), r as (select source, doc_id, row_number() over (partition by source order by md5('head:' || doc_id)) as rk from documents) select doc_id from r join s using (source) where rk <= take"),
    "mix_dropout": (mix_dropout, "select doc_id from documents where not substr(md5('out:' || doc_id), 1, 8) < '40000000'"),
    "mix_seeded_union": (
        mix_seeded_union,
        f"with u as (select o_orderkey as k, 1.0::double as weight from orders where o_orderstatus = 'P' union all select c_custkey + 1000000000, 2.0::double from customer), b as (select *, {_h('shuffle', 'k')} % 16 as bucket from u) select k, bucket, row_number() over (partition by bucket order by md5('shuffle:' || k)) - 1 as pos, weight from b",
    ),
    "mix_expected_counts": (
        mix_expected_counts,
        "select 'no_source' as rule, count(*) filter (where source is null) as n from documents union all select 'short', count(*) filter (where n_chars < 10) from documents union all select 'long', count(*) filter (where n_chars > 20000) from documents union all select 'bad_lang', count(*) filter (where lang not in ('en', 'de', 'fr', 'es')) from documents",
    ),
    "sc_mcnemar_block": (
        sc_mcnemar_block,
        "with recursive " + SC + ", t as (select coalesce(lang, 'ALL') as lang, count(*) as n, round(avg(a), 9) as mean_a, round(avg(b), 9) as mean_b, count(*) filter (where a = 0 and b = 1) as improved, count(*) filter (where a = 1 and b = 0) as worsened from sc group by rollup (lang)), "
        "m as (select lang, improved + worsened as m, least(improved, worsened) as k, 0 as i, -(improved + worsened) * ln(2) as term from t union all select lang, m, k, i + 1, term + ln((m - i) / (i + 1)) from m where i < k), p as (select lang, case when max(m) = 0 then 1.0 else least(1.0, 2 * sum(exp(term))) end as p from m group by 1) "
        "select lang, n, mean_a, mean_b, improved, worsened, round(p, 8) as p, case when p < 0.001 then '***' when p < 0.01 then '**' when p < 0.05 then '*' else '' end as stars from t join p using (lang)",
    ),
    "sc_edit_score": (
        sc_edit_score,
        "with " + EV + ", e as (select user_id, event_id, substr(cls, 1, 1) as c from ev), l as (select *, lag(c) over (partition by user_id order by event_id) as p from e), s as (select user_id, c, row_number() over (partition by user_id order by event_id) as k from l where p is null or p <> c), t as (select user_id, string_agg(c, '' order by k) as x from s group by 1) select user_id, round(100.0 * (1 - levenshtein(x, reverse(x)) / length(x)), 9) as score from t",
    ),
    "sc_set_diff_classes": (
        sc_set_diff_classes,
        "with " + GU + ", t as (select distinct user_id, hr, cls from gu), g as (select distinct user_id, hr, guess as cls from gu) select 'missed' as kind, cls, count(*) as n from (select * from t except select * from g) group by 2 union all select 'false', cls, count(*) from (select * from g except select * from t) group by 2",
    ),
    "sc_prior_baseline": (sc_prior_baseline, "with " + SC + ", c as (select source, a, count(*) as n, min(doc_id) as f from sc group by 1, 2), k as (select source, a as prior, row_number() over (partition by source order by n desc, f) as k from c) select lang, count(*) as n, count(*) filter (where prior = a) as \"right\" from sc left join k on sc.source = k.source and k = 1 group by 1"),
    "sc_time_match": (
        sc_time_match,
        "with " + EV + ", r as (select user_id, cls, hr, row_number() over (partition by user_id, cls order by hr) as k from ev where cls in ('signup', 'purchase')), c as (select user_id, count(*) filter (where cls = 'signup') as g, count(*) filter (where cls = 'purchase') as p from ev group by 1), "
        "m as (select a.user_id, count(*) filter (where abs(a.hr - b.hr) > 48) as bad from r a join r b on a.user_id = b.user_id and a.k = b.k and a.cls = 'signup' and b.cls = 'purchase' group by 1) select c.user_id, g = p and coalesce(bad, 0) = 0 as ok, g as n from c left join m using (user_id)",
    ),
    "sc_format_scores": (
        sc_format_scores,
        "with " + GU + ", f as (select *, ['number', 'list', 'text', 'judged'][event_id % 4 + 1] as form from gu), o as (select form, case when form = 'number' then event_id % 10 = cast(floor(coalesce(value, 0)) as bigint) % 10 when form in ('list', 'text') then lower(guess) = lower(cls) end as ok from f) select form, count(ok) as n, count(*) filter (where ok) as \"right\" from o group by 1",
    ),
    "sc_strata_arms": (
        sc_strata_arms,
        "with " + SC + f", x as (select lang, a, 'b' as arm, b as v from sc union all select lang, a, 'c', {_h('arm', 'doc_id')} % 2 from sc), y as (select lang, arm, count(*) as n, round(avg(v - a), 9) as delta from x group by 1, 2) select *, cast(sign(delta) as bigint) as gate from y",
    ),
    "sc_changed": (sc_changed, "with " + EV + ", c as (select user_id, event_id % 2 as h, list_sort(list(cls)) as l from ev group by 1, 2) select a.l = b.l as same, count(*) as n from c a join c b using (user_id) where a.h = 0 and b.h = 1 group by 1"),
    "sc_what_if": (sc_what_if, "with " + EV + ", l as (select user_id, list_sort(list(hr)) as h from ev group by 1) select user_id, h[1] as first, h[-1] as last, h[(len(h) + 1) // 2] as median, (h[1] + h[-1]) // 2 as mid from l"),
    "sc_error_buckets": (sc_error_buckets, "with " + GU + ", l as (select user_id, max(hr) - min(hr) as len from ev group by 1) select case when len < 600 then 'short' when len < 660 then 'middle' else 'long' end as bucket, count(*) as n, count(*) filter (where cls <> guess) as wrong from gu join l using (user_id) group by 1"),
    "sc_contamination": (
        sc_contamination,
        "with bw as (select regexp_split_to_array(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') as w from benchmark), b as (select distinct array_to_string(list_slice(w, i, i + 7), ' ') as k from (select w, unnest(range(1, greatest(len(w) - 6, 2))) as i from bw)), "
        "t as (select doc_id, ' ' || trim(regexp_replace(text, '\\s+', ' ', 'g')) || ' ' as t from documents), "
        "h as (select distinct doc_id from t where len(list_filter((select list(k) from b), lambda k: contains(t, ' ' || k || ' '))) > 0) select source, count(*) as n, count(h.doc_id) as hits from documents d left join h using (doc_id) group by 1",
    ),
    "srv_vote_majority": (
        srv_vote_majority,
        "with " + EV + ", c as (select event_id % 500 as q, cls as answer, count(*) as n, min(event_id) as f from ev group by 1, 2), k as (select *, row_number() over (partition by q order by n desc, f) as k from c), p as (select distinct p_partkey % 510 as q from part) select p.q, coalesce(answer, '') as answer from p left join k on p.q = k.q and k = 1",
    ),
    "srv_conf_select": (srv_conf_select, "with " + EV + " select event_id, case when value > event_id % 100 then 'frame' else 'video' end as pick from ev"),
    "srv_route_default": (srv_route_default, "with r as (select source, 'long_' || min(lang) as route from documents where n_chars > 4000 group by 1) select coalesce(route, 'OBJECT_RECOGNITION') as route, count(*) as n from documents d left join r on d.source = r.source and route <> 'long_de' group by 1"),
    "srv_total_output": (srv_total_output, "select d.doc_id, case when quality = 1 then 'yes' else '' end as content from documents d left join labels l using (doc_id)"),
    "srv_budget_tiers": (
        srv_budget_tiers,
        "with r as (select o_orderkey, cast(60 - coalesce(sum(o_orderkey % 17) over (partition by o_custkey order by o_orderkey rows between unbounded preceding and 1 preceding), 0) as bigint) as left_ from orders) select o_orderkey, left_ as \"left\", case when left_ >= 40 then 'full' when left_ >= 20 then 'half' when left_ >= 0 then 'fast' else 'empty' end as tier from r",
    ),
    "srv_frame_ladder": (srv_frame_ladder, "with r as (select o_orderkey, o_orderkey % 40 as k, case when o_orderstatus = 'F' then 32 else 64 end as c from orders) select o_orderkey, case when k >= 30 and c >= 64 then 64 when k >= 12 then 32 when k >= 5 then 16 else 8 end as frames from r"),
    "srv_salvage": (srv_salvage, "select o_orderkey, coalesce(case when o_orderkey % 3 <> 0 then nullif(o_orderstatus, '') end, case when o_orderkey % 2 = 0 then o_orderpriority end, '') as answer from orders"),
    "srv_specialist": (
        srv_specialist,
        "with " + EV + f", e as (select *, {_h('sp', 'event_id')} % 3 as h from ev), u as (select cls from e where h > 0 and cls not in ('error', 'signup') union all select cls from e x where h = 0 and cls in ('error', 'signup') and exists (select 1 from e y where y.h > 0 and y.user_id = x.user_id and y.hr = x.hr)) select cls, count(*) as n from u group by 1",
    ),
    "srv_hi_lo": (srv_hi_lo, "with " + EV + " select case when value >= 60 then 'hi' when value >= 30 then 'lo' else 'none' end as band, count(*) as n from ev group by 1"),
    "srv_needed_models": (srv_needed_models, "select conv_id, turn, regexp_matches(text, '(?i)phase|the') as phase, regexp_matches(text, '(?i)clip|and') as detector, regexp_matches(text, '[0-9]') as time from conversations"),
}
