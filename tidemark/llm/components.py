"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour larger than u is linked to the smallest of u and its neighbours."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours are linked to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where(F.col("u") > F.col("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where(F.col("v") > F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def roots(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(u, v): v is the smallest node reachable from u. Nodes that are roots themselves have no row.

    edges: two columns u and v of one orderable type, in any orientation. Each
    round is written to the scratch folder, so lineage stays short. Rounds grow with
    the logarithm of the longest chain; one that does not settle raises.
    """
    now = common.materialize(
        edges.where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v"))).select(
            F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
        ).distinct(),
        "links",
    )
    for _ in range(max_rounds):
        # Settled when the links are stars: no node points twice, or both points and is pointed at.
        ends = now.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionAll(now.select("v", F.lit(0), F.lit(1)))
        loose = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where((F.col("out") > 1) | ((F.col("out") == 1) & (F.col("into") == 1)))
        if loose.isEmpty():
            return now
        before, now = now, common.materialize(_small_star(_large_star(now)), "links")
        common.release(before)
        common.forget_shuffles(edges.sparkSession)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
