"""Connected components of a graph given as a table of links, by alternating large and small stars. Nothing is collected: each
round is two joins and a table in the shared folder, and a hub's links are reduced by partial aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Every node's larger (or smaller) neighbours, tied to the smallest node among it and its neighbours."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    side = both.where("v > u") if large else both.where("v < u")
    tied = side.join(least, "u").select(F.col("v").alias("b"), F.col("m").alias("a"))
    if not large:
        tied = tied.union(least.select(F.col("u").alias("b"), F.col("m").alias("a")))
    return tied.where("a < b").select("a", "b").distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """links: a, b (long). Returns id and component, the smallest id reachable, for every id with a link. Links to itself and
    links with a null end count for nothing."""
    now = written(links.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    mark = lambda t: tuple(t.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before = mark(now)
    if before[0]:
        for _ in range(most_rounds):
            now = written(_star(_star(now, large=True), large=False), "stars")
            after = mark(now)
            if after == before:
                break
            before = after
        else:
            raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("b").alias("id"), F.col("a").alias("component")).union(now.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())
