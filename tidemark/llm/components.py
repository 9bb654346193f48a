"""Connected components of a link table, in rounds that each write their state to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch


def components(links: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """The smallest node that each linked node reaches: rows (node, root), for linked nodes alone.

    Every round each node takes the smallest root among its own and its neighbours', and hands it to
    its old root; then roots jump to their roots. The number of rounds grows with the logarithm of the
    longest chain. Sums and minima are taken before rows are dealt out, so a node with very many links
    costs its task few rows; joins on it are split by AQE. Nulls in either column are left out.
    The result lies in a table that ``scratch`` removes.
    """
    spark = links.sparkSession
    kept = Scratch(spark)
    pairs = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    edges = kept(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "cc-edges")
    last = Scratch(spark)
    state = last(edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("root")).withColumnRenamed("u", "node"), "cc-state")
    while True:
        now = Scratch(spark)
        seen = edges.join(state.select(F.col("node").alias("v"), "root"), "v").groupBy("u").agg(F.min("root").alias("near"))
        own = state.join(seen.withColumnRenamed("u", "node"), "node").select("node", "root", F.least("root", "near").alias("new"))
        own = last(own, "cc-step")
        # a root hears of the smallest root that its nodes have met
        heard = own.groupBy("root").agg(F.min("new").alias("heard")).withColumnRenamed("root", "node")
        hooked = last(own.join(heard, "node", "left").select("node", "root", F.least("new", F.coalesce("heard", "new")).alias("new")), "cc-hooked")
        up = hooked.select(F.col("node").alias("new"), F.col("new").alias("up"))
        to = F.least("new", F.coalesce("up", "new"))
        jumped = now(hooked.join(up, "new", "left").select("node", to.alias("root"), (to != F.col("root")).alias("moved")), "cc-state")
        moved = jumped.where("moved").limit(1).count()
        last.clear()
        last, state = now, jumped.drop("moved")
        if not moved:
            break
    kept.clear()
    scratch.paths += last.paths
    return state
