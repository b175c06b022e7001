"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm.common import OWN, drop_stash, hot_share, salted, stash


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """id and component (smallest id reachable) of every node of edges (a, b); loops are ignored.

    Each round links every node's larger neighbours to the smallest, then its smaller ones, until all point
    at their component's smallest id; the number of rounds grows with the log of the size. Minima are
    summed before they are shuffled, and the edges of a node with many are dealt to several tasks.
    """
    now = stash(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")

    def with_least(edges: DataFrame, of: DataFrame, n: int) -> DataFrame:
        """edges (u, v) with m, the least of u and its neighbours in ``of``."""
        least = stash(of.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")
        used.append(least)
        share = hot_share(n)  # so at most 4096 nodes have more edges
        hot = least.where(F.col("n") > share).select("u", F.ceil(F.col("n") / share).alias(OWN + "parts"))
        return salted(edges, least.select("u", F.least("u", "m").alias("m")), hot, "u", ("v",))

    for _ in range(rounds):
        used: list[DataFrame] = [now]
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        n = 2 * now.count()
        large = stash(with_least(both.where("v > u"), both, n).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        used.append(large)
        small = with_least(large, large, n)
        small = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        new = stash(small, "edges")
        # stars: every larger end has one edge, and no smaller end is a larger one
        stars = new.groupBy("u").count().where("count > 1").isEmpty() and new.join(new.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty()
        for old in used:
            drop_stash(old)
        now = new
        if stars:
            break
    else:
        raise RuntimeError(f"components: no end after {rounds} rounds")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
