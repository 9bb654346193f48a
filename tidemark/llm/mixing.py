"""Operator 1, mixing sources to target weights, with DataFrame functions alone.

1. Every document's words are counted once; only (row, source, size) goes on.
2. The sources, one row each, get target words: the weights share ``total_share`` of all words, no
   target exceeds ``max_repeat`` times its source, and the excess is shared again by weight.
3. A target is whole passes over the source plus a remainder. The remainders compete for blocks of
   ``block_words`` words by Sainte-Laguë's highest quotients (``common.seats``).
4. A source's documents lie in shards of about ``shard_words`` words, dealt by hash, so that a hot
   source has more shards, not larger ones. The source's blocks go to its shards by the same rule,
   level by level over at most ``FANOUT`` children, so that no group grows with the data.
5. In a shard the documents stand in seeded order; its quota is the run of consecutive blocks, in a
   circle, from a seeded start. So most documents are taken whole, and those at the ends in part.

Nulls, ties and the like: a null text has size 0 and is taken 0 times; a null source is a source of
its own, after all others; repeated rows are rows like any other; rows that agree in id, source and size
are interchangeable, and are numbered, so that a row of many copies spreads over all shards of its source;
an empty table gives an empty result. The operator reads ``doc_id``, ``text`` and
``source`` and carries no other column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import BROADCAST_ROWS, WORD, join_small, seats, staged

#: Children of one apportionment.
FANOUT = 512
#: Equal rows that one task lays out at once.
LOTS = 10_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...], total_share: float, max_repeat: float) -> DataFrame:
    """One row per source (source, source_size): adds its ``target`` words.

    The sources that reach their limit are those with the least limit per weight. In that order,
    the others get an equal level per weight, once the limits of those before are set aside.
    """
    order = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    limit = F.col("source_size") * F.lit(float(max_repeat))
    rows = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (F.pmod(order, F.lit(len(weights))) + 1).cast("int")))
    everything = W.partitionBy()
    first = W.orderBy((limit / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    rows = (
        rows.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(total_share)))
        .withColumn("set_aside", F.coalesce(F.sum(limit).over(first.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(first.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("level", F.greatest(F.col("total") - F.col("set_aside"), F.lit(0.0)) / F.col("weight_left"))
        .withColumn("free", F.col("level") * F.col("weight") <= limit)
        # the level is settled at the first source that stays below its limit
        .withColumn("settled", F.min_by("level", F.when(F.col("free"), F.struct(limit / F.col("weight"), F.coalesce("source", F.lit(""))))).over(everything))
    )
    share = F.when(F.col("settled").isNull(), limit).otherwise(F.least(limit, F.col("settled") * F.col("weight")))
    return rows.select("source", "source_size", share.alias("target"))


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (3.0, 1.0, 2.0),
    total_share: float = 1.5,
    max_repeat: float = 2.0,
    block_words: int = 16,
    shard_words: int = 1 << 16,
    seed: int = 17,
) -> DataFrame:
    """Returns doc_id, size, source_size, target, taken, shard (its shard in its source), source, and number (of
    its equals in id, source and size)."""
    sized = staged(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    # equals as one row with their count, then numbered; the numbers of many equals are laid out by many tasks
    equals = sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n"))
    lots = equals.where(F.col("n") > LOTS).withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / LOTS)))).repartition("lot")
    lots = equals.where(F.col("n") <= LOTS).withColumn("lot", F.lit(0).cast("long")).unionByName(lots)
    sized = lots.select("doc_id", "source", "size", F.explode(F.sequence(F.col("lot") * LOTS + 1, F.least("n", (F.col("lot") + 1) * LOTS))).alias("number"))
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = targets(sources, weights, total_share, max_repeat)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(0).cast("long")
    plan = plan.withColumn("passes", whole).withColumn("rest", F.greatest(F.col("target") - F.col("passes") * F.col("source_size"), F.lit(0.0)))
    plan = plan.withColumn("n_shards", F.greatest(F.ceil(F.col("source_size") / F.lit(shard_words)), F.lit(1)).cast("long"))

    # blocks to sources: one array of all sources, as there is one row for each
    parties = plan.agg(F.array_sort(F.collect_list(F.struct(F.coalesce("source", F.lit("")).alias("k"), F.col("source").isNull().alias("none"), F.col("source"), "rest", "source_size"))).alias("p"))
    quota = seats(
        F.transform("p", lambda x: x["rest"].cast("double")),
        F.transform("p", lambda x: F.ceil(x["source_size"] / F.lit(block_words)).cast("long")),
        F.round(F.aggregate("p", F.lit(0.0), lambda a, x: a + x["rest"]) / F.lit(block_words)),
    )
    quotas = parties.select("p", quota.alias("q")).select(F.explode(F.arrays_zip("p", "q")).alias("x")).select(F.col("x.p.source").alias("source"), F.col("x.q").alias("blocks"))
    plan = staged(join_small(plan, quotas, ["source"]), "mix-sources")

    # documents to shards: a hash of the id, so a source of any size has even shards
    key = F.xxhash64(F.lit(seed), "doc_id", "size", "number")
    dealt = join_small(sized, plan.drop("rest"), ["source"]).withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "size", "number"), F.col("n_shards")))
    shards = staged(dealt.groupBy("source", "shard").agg(F.sum("size").alias("shard_size")), "mix-shards")
    shards = join_small(shards, plan.select("source", "blocks", "n_shards"), ["source"])
    most = plan.agg(F.max("n_shards")).first()[0] or 1
    depth = 1
    while FANOUT**depth < most:
        depth += 1
    level = shards.select("source", "shard", "shard_size", "blocks")
    given = plan.select("source", F.lit(0).cast("long").alias("node"), F.col("blocks").alias("node_blocks"))
    for up in range(depth - 1, -1, -1):  # from the root down; a node of height `up` holds FANOUT**up shards
        nodes = level.withColumn("node", F.floor(F.col("shard") / F.lit(FANOUT**up)).cast("long")).groupBy("source", "node").agg(
            F.sum("shard_size").alias("n"), F.sum(F.ceil(F.col("shard_size") / F.lit(block_words))).cast("long").alias("cap")
        )
        families = nodes.groupBy("source", F.floor(F.col("node") / F.lit(FANOUT)).cast("long").alias("parent")).agg(F.array_sort(F.collect_list(F.struct("node", "n", "cap"))).alias("c"))
        families = families.join(given.select(F.col("source").alias("s"), F.col("node").alias("parent_node"), "node_blocks"), F.col("source").eqNullSafe(F.col("s")) & (F.col("parent") == F.col("parent_node")))
        split = seats(F.transform("c", lambda x: x["n"].cast("double")), F.transform("c", lambda x: x["cap"]), F.col("node_blocks"))
        given = families.select("source", F.explode(F.arrays_zip(F.col("c"), split.alias("q"))).alias("x")).select("source", F.col("x.c.node").alias("node"), F.col("x.q").alias("node_blocks"))
        if up:
            given = staged(given, "mix-nodes")
    chosen = staged(given.withColumnRenamed("node", "shard"), "mix-quotas")

    # a run of blocks in a circle: [first, first + blocks) of the shard's n_blocks
    place = W.partitionBy("source", "shard")
    placed = dealt.withColumn("end", F.sum("size").over(place.orderBy(key, "doc_id", "size", "number").rowsBetween(W.unboundedPreceding, 0))).withColumn("shard_size", F.sum("size").over(place))
    right = chosen.select(F.col("source").alias("s"), F.col("shard").alias("sh"), F.col("node_blocks").alias("shard_blocks"))
    placed = placed.join(right, F.col("source").eqNullSafe(F.col("s")) & (F.col("shard") == F.col("sh")), "left")
    n_blocks = F.greatest(F.ceil(F.col("shard_size") / F.lit(block_words)), F.lit(1)).cast("long")
    first = F.pmod(F.xxhash64(F.lit(seed + 2), "source", "shard"), n_blocks) * block_words
    last = first + F.col("shard_blocks") * block_words
    around = n_blocks * block_words
    start = F.col("end") - F.col("size")

    def overlap(a: Column, b: Column) -> Column:
        return F.greatest(F.least(F.col("end"), b) - F.greatest(start, a), F.lit(0))

    run = overlap(first, F.least(last, around)) + overlap(F.lit(0), last - around)
    return placed.select("doc_id", "size", "source_size", "target", (F.col("passes") * F.col("size") + F.coalesce(run, F.lit(0))).cast("long").alias("taken"), "shard", "source", "number")


def mixed(docs: DataFrame, seed: int = 17, **options) -> DataFrame:
    """The mix itself, whole documents: each as often as the words it gives, rounded by a hash of the row
    so that the expected words are those taken. Its rows have the columns of ``docs``.

    A row whose doc_id names no other gets its copies by that. Of rows that repeat an id, or have none, those that
    agree in source and size share the copies of their group in the order of their digests: equal rows get equally
    many, and what is over goes to one of them.
    """
    spark = docs.sparkSession
    taken = mix(docs, seed=seed, **options)
    draw = (F.pmod(F.xxhash64(F.lit(seed + 3), "doc_id", "source", "size", "number"), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    whole = F.floor(F.col("taken") / F.col("size"))
    copies = F.when(F.col("taken") > 0, whole + (draw < F.col("taken") / F.col("size") - whole).cast("int")).otherwise(0).cast("long")
    groups = staged(taken.select("doc_id", "source", "size", copies.alias("copies")).groupBy("doc_id", "source", "size").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows")), "mix-copies")
    ids = groups.groupBy("doc_id").agg(F.sum("rows").alias("rows"), F.sum("copies").alias("__copies"))
    alone = ids.where("doc_id is not null and rows = 1 and __copies > 0").select(F.col("doc_id").alias("__id"), F.col("__copies").cast("int").alias("__copies"))
    if alone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        alone = F.broadcast(alone)  # spares a shuffle of all texts
    rows = docs.join(alone, docs["doc_id"] == F.col("__id"))
    out = rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*[docs[c] for c in docs.columns])
    again = staged(ids.where("doc_id is null or rows > 1").select(F.col("doc_id").alias("__id")), "mix-again")
    if not again.limit(1).count():
        return out
    own = docs.join(again, docs["doc_id"].eqNullSafe(F.col("__id")), "left_semi")
    columns = [f"`{c}`" for c in docs.columns]
    digest = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    kinds = own.select(F.struct(*columns).alias("row"), digest.alias("digest"), F.col("doc_id").alias("id"), F.col("source").alias("src"), word_count(F.col("text")).alias("words"))
    kinds = staged(kinds.groupBy("digest", "id", "src", "words").agg(F.first("row").alias("row"), F.count("*").alias("n")), "mix-kinds")
    before = F.coalesce(F.sum("n").over(W.partitionBy("id", "src", "words").orderBy("digest").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = kinds.select("digest", "id", "src", "words", "n", before.alias("before"))
    same = placed["id"].eqNullSafe(groups["doc_id"]) & placed["src"].eqNullSafe(groups["source"]) & (placed["words"] == groups["size"])
    placed = placed.join(groups, same)
    base, over = F.floor(F.col("copies") / F.col("rows")), F.col("copies") % F.col("rows")
    total = F.col("n") * base + F.greatest(F.least(over - F.col("before"), F.col("n")), F.lit(0))
    counts = placed.select("digest", "id", "src", "words", total.alias("total")).where("total > 0")
    # a row of very many copies is laid out by many tasks
    lots = counts.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("total") - 1) / LOTS)))).repartition("digest", "lot")
    given = F.least(F.lit(LOTS), F.col("total") - F.col("lot") * LOTS).cast("int")
    lots = lots.select(F.col("digest").alias("d"), given.alias("__copies"))
    more = kinds.join(lots, F.col("digest") == F.col("d")).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    return out.unionByName(more.select("row.*"))
